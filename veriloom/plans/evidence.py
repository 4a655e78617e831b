"""Evidence of people for skills, held against the requirements of the jobs they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.plans import resolve as R
from veriloom.sources.graph import Graph
from veriloom.sources.staging import dealt

SKILL_EDGES = ["USED", "DEMONSTRATES", "LEARNED"]
STRENGTHS = ["strong", "moderate", "weak"]
FIELDS = ["source", "source_type", "relationship", "project", "role", "education"]
ORDER = ["source_type", "source", "relationship", "project", "role", "education"]


def source_texts(g: Graph) -> DataFrame:
    """``label, key, source``: what a node is called as evidence."""
    named = [("Achievement", g.achievement, "achievement_id", "description"), ("Project", g.project, "project_id", "name"), ("Role", g.role, "role_id", "title"), ("Education", g.education, "education_id", "institution")]
    found = None
    for label, df, key, value in named:
        one = df.select(F.lit(label).alias("label"), F.col(key).alias("key"), F.col(value).alias("source"))
        found = one if found is None else found.unionByName(one)
    return found


def _professional_path(g: Graph) -> DataFrame:
    """``person_id, project, role``: project-during-role-at-company paths."""
    at = g.edge("AT").select(F.col("src_key").alias("role_id")).distinct()
    during = g.edge("DURING").select(F.col("src_key").alias("project_id"), F.col("dst_key").alias("role_id")).join(at, "role_id", "left_semi")
    built = g.edge("BUILT").select(F.col("src_key").alias("person_id"), F.col("dst_key").alias("project_id"))
    path = built.join(during, "project_id").join(g.project.select("project_id", F.col("name").alias("project")), "project_id").join(g.role.select("role_id", F.col("title").alias("role")), "role_id")
    return path.select("person_id", "project", "role")


def professional_context(g: Graph) -> DataFrame:
    """``person_id, kind, name`` of the projects and roles on a project-during-role-at-company path."""
    path = _professional_path(g)
    return path.select("person_id", F.lit("project").alias("kind"), F.col("project").alias("name")).unionByName(path.select("person_id", F.lit("role").alias("kind"), F.col("role").alias("name"))).distinct()


def provenance(g: Graph) -> DataFrame:
    """``person_id, canonical_skill`` with the six evidence fields: every skill edge with its provenance. Nodes of one name
    give equal rows, which :func:`careers` takes once.

    An achievement has the projects and roles that achieved it (all combinations), a project itself, a role itself; the
    education is the one that the project is part of. Evidence belongs to the people who built the project, had the role
    or studied there. Skill edges from other labels don't count (see :func:`rejected_edges`).
    """
    skill = g.edges.where(F.col("type").isin(SKILL_EDGES) & (F.col("dst_label") == "Skill"))
    skill = skill.select(F.col("src_label").alias("source_type"), F.col("src_key").alias("key"), F.col("type").alias("relationship"), F.col("dst_key").alias("canonical_skill"))
    project = g.project.select("project_id", F.col("name").alias("project"))
    role = g.role.select("role_id", F.col("title").alias("role"))
    built = g.edge("BUILT").select(F.col("src_key").alias("p_person"), F.col("dst_key").alias("project_id"))
    had = g.edge("HAD_ROLE").select(F.col("src_key").alias("r_person"), F.col("dst_key").alias("role_id"))
    part = g.edge("PART_OF").select(F.col("src_key").alias("project_id"), F.col("dst_key").alias("education_id")).join(g.education.select("education_id", F.col("institution").alias("education")), "education_id").select("project_id", "education")
    owned = project.join(built, "project_id").join(part, "project_id", "left")  # shuffled once for both kinds of evidence

    ach = skill.where("source_type = 'Achievement'").join(g.achievement.select(F.col("achievement_id").alias("key"), F.col("description").alias("source")), "key")
    by_project = g.edge("ACHIEVED", src="Project").select(F.col("src_key").alias("project_id"), F.col("dst_key").alias("key")).join(owned, "project_id")
    by_role = g.edge("ACHIEVED", src="Role").select(F.col("src_key").alias("role_id"), F.col("dst_key").alias("key")).join(role, "role_id").join(had, "role_id").select("key", "role", "r_person")
    ach = ach.join(by_project.select("key", "project", "p_person", "education"), "key", "left").join(by_role, "key", "left")
    ach = ach.where("p_person is null or r_person is null or p_person = r_person").withColumn("person_id", F.coalesce("p_person", "r_person"))
    pro = skill.where("source_type = 'Project'").withColumnRenamed("key", "project_id").join(owned, "project_id")
    pro = pro.withColumns({"source": F.col("project"), "role": F.lit(None).cast("string"), "person_id": F.col("p_person")})
    rol = skill.where("source_type = 'Role'").withColumnRenamed("key", "role_id").join(role, "role_id").join(had, "role_id")
    rol = rol.withColumns({"source": F.col("role"), "project": F.lit(None).cast("string"), "education": F.lit(None).cast("string"), "person_id": F.col("r_person")})
    edu = skill.where("source_type = 'Education'").withColumnRenamed("key", "education_id").join(g.education.select("education_id", F.col("institution").alias("source")), "education_id")
    studied = g.edge("STUDIED_AT").select(F.col("src_key").alias("person_id"), F.col("dst_key").alias("education_id"))
    edu = edu.join(studied, "education_id").withColumns({c: F.lit(None).cast("string") for c in ("project", "role", "education")})
    names = ["person_id", "canonical_skill", *FIELDS]
    every = ach.select(names).unionByName(pro.select(names)).unionByName(rol.select(names)).unionByName(edu.select(names))
    return every.where("person_id is not null")


def rejected_edges(g: Graph) -> DataFrame:
    """Skill edges from labels that are no evidence."""
    return g.edges.where(F.col("type").isin(SKILL_EDGES) & ~F.col("src_label").isin("Achievement", "Project", "Role", "Education"))


def strength(source_type, professional, metric):
    """Strong, moderate or weak, from the label, the professional context and a metric."""
    base = F.when(source_type == "Achievement", 2).when(source_type.isin("Project", "Role"), 1).when(source_type == "Education", -1).otherwise(0)
    score = base + F.when(professional, 2).otherwise(0) + F.when(metric, 1).otherwise(0)
    return F.get(F.array(*map(F.lit, reversed(STRENGTHS))), F.shiftright(F.greatest(score, F.lit(0)), 1))  # from 4 on strong, from 2 on moderate


def careers(g: Graph, rows: int | None = None) -> DataFrame:
    """``person_id, skills``: for every person and skill, the pieces of evidence once each, in the order of their six fields,
    with ``professional_context`` and ``evidence_strength``; names are compared within the person.

    All rows of a person, evidence and professional paths, meet in one shuffle and one aggregate, in as many tasks as there are
    ``rows`` (the edges, if not given) to share; the sorted list is then cut where the skill changes.
    """
    pieces = provenance(g).select("person_id", F.lit(True).alias("found"), "canonical_skill", *FIELDS)
    paths = _professional_path(g).select("person_id", F.struct("project", "role").alias("path"))
    every = dealt(pieces.unionByName(paths, allowMissingColumns=True), g.edges.count() if rows is None else rows, "person_id")
    order = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ORDER])
    piece = F.when(F.col("found"), F.struct("canonical_skill", order.alias("o"), *FIELDS, X.has_metric(F.col("source")).alias("metric")))
    one = every.select("person_id", "path", piece.alias("piece")).groupBy("person_id")
    one = one.agg(F.sort_array(F.collect_set("piece")).alias("pieces"), F.collect_set("path.project").alias("projects"), F.collect_set("path.role").alias("roles")).where("size(pieces) > 0")
    within = lambda p, names, c: F.coalesce(F.array_contains(names, p[c]), F.lit(False))
    one = one.withColumn("pieces", F.transform("pieces", lambda p: F.struct(p.alias("p"), (within(p, "projects", "project") | within(p, "roles", "role")).alias("professional_context"))))
    graded = lambda x: F.struct(*[x["p"][c].alias(c) for c in FIELDS], x["professional_context"].alias("professional_context"), strength(x["p"]["source_type"], x["professional_context"], x["p"]["metric"]).alias("evidence_strength"))
    skill = lambda i: F.get("pieces", i)["p"]["canonical_skill"]
    one = one.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: (i == 0) | ~skill(i).eqNullSafe(skill(i - 1))))
    length = lambda i, place: F.coalesce(F.get("starts", place + 1), F.size("pieces")) - i
    cut = F.transform("starts", lambda i, place: F.struct(skill(i).alias("canonical_skill"), F.transform(F.slice("pieces", i + 1, length(i, place)), graded).alias("pieces")))
    return one.select("person_id", cut.alias("skills"))


def by_skill(found: DataFrame) -> DataFrame:
    """:func:`careers` as one row per person and skill, with its ``pieces``."""
    return found.select("person_id", F.explode("skills").alias("s")).select("person_id", "s.canonical_skill", "s.pieces")


def graded(found: DataFrame) -> DataFrame:
    """:func:`careers` as one row per piece of evidence."""
    return by_skill(found).select("person_id", "canonical_skill", F.explode("pieces").alias("p")).select("person_id", "canonical_skill", "p.*")


ACCEPTED = ["job_id", "raw", "skill_query", "importance", "category", "canonical_skill", "match_score", "match_confidence", "match_type", "recommendation"]


def accepted(requirements: DataFrame, skill: DataFrame) -> DataFrame:
    """Resolved requirements; records that are equal in all fields collapse into the first, with its ``seq``."""
    return R.resolve_requirements(requirements, skill).groupBy(*ACCEPTED).agg(F.min("seq").alias("seq"))


def bucket(has_evidence, confidence):
    return F.when(~has_evidence, "gap").when(confidence == "high", "matched").when(confidence == "low", "partial")


def held(acc: DataFrame, applications: DataFrame, found: DataFrame, trans: DataFrame | None = None) -> DataFrame:
    """One row per job, person and requirement: its bucket, its evidence (a list, empty for a gap; never that of other
    people), the number of pieces, the strongest, and ``before``: the pieces of the requirements that come first, where
    matched ones precede partial ones, then by query.

    With ``trans``, ``given`` lists the related capabilities of a requirement, each with the person's evidence for it. A
    person's :func:`careers` meets the requirements of the job as a whole, so nothing is shuffled once a requirement.
    """
    related = ["capability_query", "capability_skill", "capability_match", "reason", "source"]
    own = [c for c in acc.columns if c != "job_id"]
    if trans is not None:
        acc = acc.join(trans.groupBy("job_id", "seq").agg(F.sort_array(F.collect_list(F.struct("place", *related))).alias("related")), ["job_id", "seq"], "left")
    lists = acc.groupBy("job_id").agg(F.collect_list(F.struct(*[c for c in acc.columns if c != "job_id"])).alias("asked"))
    known = found.select("person_id", F.map_from_entries(F.filter("skills", lambda s: s["canonical_skill"].isNotNull())).alias("known"))
    one = applications.join(known, "person_id", "left").join(lists, "job_id")
    none = F.array().cast(dict(found.dtypes)["skills"].removeprefix("array<struct<canonical_skill:string,pieces:").removesuffix(">>"))
    pieces = lambda skill: F.coalesce(F.try_element_at("known", skill), none).alias("evidence")
    given = lambda r: F.transform(r["related"], lambda c: F.struct(*[c[n].alias(n) for n in ("place", *related)], pieces(c["capability_skill"])))
    more = lambda r: [] if trans is None else [given(r).alias("given")]
    one = one.select("job_id", "person_id", F.transform("asked", lambda r: F.struct(F.struct(*[r[c].alias(c) for c in own]).alias("r"), pieces(r["canonical_skill"]), *more(r))).alias("asked"))
    place = lambda x: F.when(F.size(x["evidence"]) == 0, 2).when(x["r"]["match_confidence"] == "high", 0).otherwise(1)
    one = one.withColumn("asked", F.sort_array(F.transform("asked", lambda x: F.struct(place(x).alias("o"), x["r"]["skill_query"].alias("q"), x["r"]["seq"].alias("s"), x.alias("x")))))
    named = lambda pieces: F.filter(pieces, lambda p: p["source"].isNotNull())
    one = one.withColumn("before", F.aggregate("asked", F.array(F.lit(0)), lambda sums, a: F.concat(sums, F.array(F.element_at(sums, -1) + F.size(named(a["x"]["evidence"]))))))
    one = one.select("job_id", "person_id", F.explode(F.arrays_zip("asked", "before")).alias("z")).where("z.asked is not null")
    one = one.select("job_id", "person_id", "z.asked.x.r.*", *[F.col(f"z.asked.x.{c}").alias(c) for c in ("evidence", *(["given"] if trans is not None else []))], F.col("z.before").alias("before"))
    one = one.withColumn("n_evidence", F.size("evidence").cast("long"))
    has = F.col("n_evidence") > 0
    strengths = F.transform("evidence", lambda p: F.array_position(F.array(*map(F.lit, STRENGTHS)), p["evidence_strength"]))
    sources = F.sort_array(F.array_distinct(F.filter(F.transform("evidence", lambda p: F.coalesce(p["project"], p["role"], p["source"])), lambda x: x.isNotNull())))
    reason = F.when(F.col("canonical_skill").isNull(), "no matching skill in graph").otherwise("skill exists but no evidence recorded")
    best = F.get(F.array(*map(F.lit, STRENGTHS)), (F.array_min(strengths) - 1).cast("int"))
    return one.withColumns({"bucket": bucket(has, F.col("match_confidence")), "sources": F.when(has, sources), "gap_reason": F.when(~has, reason), "strongest": best})


def requirement_status(one: DataFrame) -> DataFrame:
    """:func:`held` without the evidence itself."""
    return one.drop("evidence", "given", "before")


def matches(one: DataFrame) -> DataFrame:
    """One row per piece of evidence of the :func:`held` requirements that are no gaps, with ``n``, its number within the job
    and person, in the order of :func:`numbered`."""
    fields = [c for c in one.columns if c not in ("evidence", "given", "before", "sources", "gap_reason", "strongest")]
    found = one.where("bucket in ('matched', 'partial')").select(*fields, "before", F.posexplode(F.filter("evidence", lambda p: p["source"].isNotNull())).alias("i", "p"))
    return found.select(*fields, "p.*", (F.col("before") + F.col("i") + 1).alias("n"))


def transferable(requirements: DataFrame, acc: DataFrame, skill: DataFrame) -> DataFrame:
    """``job_id, seq, place, capability_query, capability_skill, capability_match, reason, source``: the related capabilities of each
    accepted record. For a repeated query of a job the last requirement's list holds; unresolved ones stay."""
    last = requirements.groupBy("job_id", "skill_query").agg(F.max_by("related", "seq").alias("related"))
    caps = acc.select("job_id", "skill_query", "seq").join(last, ["job_id", "skill_query"]).select("job_id", "skill_query", "seq", F.posexplode("related").alias("place", "r"))
    found = R.capability_results(requirements, skill).select(F.col("query").alias("capability_query"), F.col("canonical_skill").alias("capability_skill"), F.col("match_type").alias("capability_match"))
    caps = caps.select("job_id", "seq", "place", F.col("r.skill_query").alias("capability_query"), "r.reason", "r.source")
    return caps.join(found, "capability_query")


def summary(status: DataFrame, trans: DataFrame) -> DataFrame:
    """Counts and shares per job and person; a hard gap has no related capability at all."""
    has = trans.select("job_id", "seq", F.lit(True).alias("has")).distinct()
    one = status.join(has, ["job_id", "seq"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    n = {b: F.count_if(F.col("bucket") == b) for b in ("matched", "partial", "gap")}
    return one.groupBy("job_id", "person_id").agg(
        F.count("*").alias("n_requirements"), n["matched"].alias("n_matched"), n["partial"].alias("n_partial"), n["gap"].alias("n_gaps"),
        F.count_if((F.col("bucket") == "gap") & F.col("has")).alias("n_transferable_gaps"), F.count_if((F.col("bucket") == "gap") & ~F.col("has")).alias("n_hard_gaps"),
        F.round(n["matched"] / F.count("*"), 4).alias("matched_share"),
    )


def review_group(status: DataFrame, trans: DataFrame) -> DataFrame:
    """Status rows with ``review_group``: matched, transferable, gap or low_confidence."""
    has = trans.select("job_id", "seq", F.lit(True).alias("has")).distinct()
    kind = F.when(F.col("bucket") == "matched", "matched").when(F.col("bucket") == "partial", "low_confidence").when(F.col("has"), "transferable").otherwise("gap")
    return status.join(has, ["job_id", "seq"], "left").withColumn("review_group", kind).drop("has")


def numbered(m: DataFrame) -> DataFrame:
    """Evidence rows of non-gaps with one explicit order per job and person: matched first, then by query and evidence."""
    blank = [F.coalesce(c, F.lit("")) for c in ORDER]
    order = Window.partitionBy("job_id", "person_id").orderBy(F.when(F.col("bucket") == "matched", 0).otherwise(1), "skill_query", "seq", *blank)
    return m.where("bucket in ('matched', 'partial') and source is not null").withColumn("n", F.row_number().over(order))
