"""Evidence packages: a person's experiences for a job, scored, ordered and recommended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.sources.graph import Graph

JP = ["job_id", "person_id"]
WEIGHTS = {"strong": 3, "moderate": 2, "weak": 1}
INCLUDE_FROM = 5.0
# Texts of the result rows.
NO_EVIDENCE = "No matched evidence found for the current job description."
REASONS = {
    "language": "Only language-skill evidence found -- relevant only if the role values that language.",
    "include": "Strong, relevant matched evidence for this job description.",
    "optional": "Some relevant evidence, but limited in strength or breadth.",
}
STATUS_ORDER = ["gap", "partial", "matched"]


def languages_of(skills: DataFrame) -> DataFrame:
    """``job_id, person_id, languages``: the names of language skills in the summary."""
    return skills.where("category = 'language'").groupBy(*JP).agg(F.collect_set("name").alias("languages"))


def education_home(s: DataFrame) -> DataFrame:
    """Stories with ``home``: the institution they fold into, if that institution is itself a story of the package."""
    homes = s.where("source_type = 'Education'").select(*JP, F.col("label").alias("home")).distinct()
    wanted = F.when(F.col("source_type") == "Education", F.col("label")).when(F.col("source_type") == "Role", F.col("company")).when(F.col("source_type") == "Project", F.col("education"))
    return s.withColumn("home", wanted).join(homes.withColumn("is_home", F.lit(True)), [*JP, "home"], "left").withColumn("home", F.when(F.col("is_home"), F.col("home"))).drop("is_home")


def partitioned(s: DataFrame) -> DataFrame:
    """Stories with ``class`` (education, professional, independent) and ``group_key``."""
    one = education_home(s)
    kind = F.when(F.col("home").isNotNull(), "education").when(F.col("professional_context"), "professional").otherwise("independent")
    company = F.coalesce(X.present("company"), X.present("role_title"), F.col("label"))
    return one.withColumn("class", kind).withColumn("group_key", F.when(F.col("class") == "education", F.col("home")).when(F.col("class") == "professional", company).otherwise(F.col("label")))


GROUP = [*JP, "class", "group_key"]


def _scores() -> dict[str, Column]:
    """What :func:`_score` needs of the stories of an experience, as aggregates."""
    weight = F.coalesce(*[F.when(F.col("evidence_strength") == k, v) for k, v in WEIGHTS.items()], F.lit(0))
    return {
        "base": 3 * F.sum("required_count") + F.max(weight) + F.sum("n_achievements") + F.when(F.bool_or("professional_context"), 2).otherwise(0),
        "supported": F.sort_array(F.array_distinct(F.flatten(F.collect_list("supports")))),
    }


def _score() -> Column:
    return F.round((F.col("base") + 2 * F.size("supported")).cast("double"), 2)


def scored(p: DataFrame) -> DataFrame:
    """``score`` per experience: 3 a required, 2 a distinct requirement, the strongest weight, 1 an achievement, 2 if professional."""
    return p.groupBy(*GROUP).agg(*[c.alias(k) for k, c in _scores().items()]).select(*GROUP, _score().alias("score"), "supported")


def recommended(score, language_only):
    """(recommendation, reason); language alone is optional whatever the score."""
    kind = F.when(language_only, "language").when(score >= INCLUDE_FROM, "include").otherwise("optional")
    reason = F.coalesce(*[F.when(kind == k, v) for k, v in REASONS.items()])
    return F.when(kind == "include", "include").otherwise("optional"), reason


def achievement_evidence(p: DataFrame, g: Graph) -> DataFrame:
    """One row per experience, story and achievement: id, text, metric, ``has_metric``, skills, provenance."""
    one = p.select(*GROUP, "label", "rank", "source_type", "project", "role_title", F.posexplode("achievements").alias("place", "a"))
    meta = g.achievement.groupBy(F.col("description").alias("text")).agg(F.max("achievement_id").alias("known_id"), F.max("metric").alias("metric"))
    one = one.select(*GROUP, "label", "rank", "place", "source_type", "project", "role_title", F.col("a.description").alias("text"), F.col("a.matched_skills").alias("skills")).join(meta, "text", "left")
    made = F.concat(F.lit("achievement:"), F.substring(X.slug(F.col("text")), 1, 60))
    metric = X.has_metric(F.col("text")) | F.coalesce(X.present("metric").isNotNull(), F.lit(False))
    return one.select(*GROUP, "label", "rank", "place", "source_type", "project", "role_title", F.coalesce(X.present("known_id"), made).alias("achievement_id"), "text", "metric", metric.alias("has_metric"), "skills")


def provenance(p: DataFrame) -> DataFrame:
    """One row per experience and story: where it comes from and how it belongs to the experience."""
    pro, edu = F.col("class") == "professional", F.col("class") == "education"
    school = edu & (F.col("source_type") == "Education")
    return p.select(*GROUP, "rank", "source_type", F.when(~school, F.col("project")).alias("project"),
        F.when(edu, F.when(F.col("source_type") == "Role", F.col("label"))).otherwise(F.col("role_title")).alias("role"),
        F.when(pro | (edu & (F.col("source_type") == "Role")), F.col("company")).alias("company"), F.when(edu, F.col("home")).alias("education"),
        F.when(pro & F.col("project").isNotNull(), "DURING").when(edu & (F.col("source_type") == "Project"), "PART_OF").alias("relationship"))


def curriculum(g: Graph) -> DataFrame:
    """``institution, projects`` that are part of each education."""
    part = g.edge("PART_OF").join(g.project.select(F.col("project_id").alias("src_key"), "name"), "src_key").join(g.education.select(F.col("education_id").alias("dst_key"), "institution"), "dst_key")
    return part.select("institution", "name").distinct()


def own_curriculum(g: Graph) -> DataFrame:
    """``person_id, institution, name``: the curriculum projects that the person built."""
    built = g.edge("BUILT").select(F.col("src_key").alias("person_id"), F.col("dst_key").alias("project_id"))
    part = g.edge("PART_OF").select(F.col("src_key").alias("project_id"), F.col("dst_key").alias("education_id"))
    return built.join(part, "project_id").join(g.project.select("project_id", "name"), "project_id").join(g.education.select("education_id", "institution"), "education_id").select("person_id", "institution", "name").distinct()


def reference_projects(p: DataFrame, g: Graph) -> DataFrame:
    """Curriculum projects of the person's institution that the experience doesn't use: ``job_id, person_id, group_key, name``."""
    homes = p.where("class = 'education'").select(*JP, "group_key").distinct()
    used = p.where("class = 'education' and source_type = 'Project'").select(*JP, "group_key", F.col("project").alias("name"))
    return homes.join(own_curriculum(g).withColumnRenamed("institution", "group_key"), ["person_id", "group_key"]).join(used, [*JP, "group_key", "name"], "left_anti")


def schooled(kinds: DataFrame, schools: DataFrame) -> DataFrame:
    """What :func:`reference_projects` needs of :func:`partitioned`, without ranks and properties of stories: those of educations
    and the projects that fold into them. ``kinds`` has ``source_type`` per story, ``schools`` the education of a person's project."""
    school = kinds.where("source_type = 'Education'").select(*JP, F.lit("education").alias("class"), F.col("label").alias("group_key"), "source_type", F.lit(None).cast("string").alias("project"))
    project = kinds.where("source_type = 'Project'").join(schools.withColumnsRenamed({"name": "label", "education": "group_key"}), ["person_id", "label"])
    project = project.join(school.select(*JP, "group_key"), [*JP, "group_key"], "left_semi")
    return school.unionByName(project.select(*JP, F.lit("education").alias("class"), "group_key", "source_type", F.col("label").alias("project")))


def _naming() -> tuple[Column, dict[str, Column]]:
    """The place of a story in its experience, and what an experience is registered under, as aggregates."""
    school = (F.col("class") == "education") & (F.col("source_type") == "Education")
    roles = F.when((F.col("class") == "education") & (F.col("source_type") == "Role"), F.col("label"))
    return F.struct(F.when(school, 0).otherwise(1), F.col("rank")), {"projects": F.array_sort(F.collect_set("project")), "roles": F.array_sort(F.collect_set(roles)), "first_rank": F.min("rank")}


def _named() -> dict[str, Column]:
    """Name, title and projects of an experience from the aggregates and its anchor ``a``."""
    pro = F.col("class") == "professional"
    return {
        "experience_id": X.slug(F.col("group_key")), "title": F.when(pro, F.coalesce(X.present("a.role_title"), F.col("a.label"))).otherwise(F.col("group_key")), "organization": F.when(pro, F.col("group_key")),
        "projects": F.when(F.col("class") == "independent", F.array().cast("array<string>")).otherwise(F.col("projects")),
    }


def named(p: DataFrame) -> DataFrame:
    """The columns of :func:`rolled_up` that name experiences, for the registry, without skills, metrics and scores."""
    place, names = _naming()
    one = p.groupBy(*GROUP).agg(F.min_by(F.struct("label", "role_title"), place).alias("a"), *[c.alias(k) for k, c in names.items()])
    return one.select(*GROUP, *[c.alias(k) for k, c in _named().items()], "roles", "first_rank")


def rolled_up(p: DataFrame, skills: DataFrame, g: Graph) -> DataFrame:
    """Experiences with evidence, one row each: the anchor's properties, skills, technologies, metrics, score, recommendation."""
    place, names = _naming()
    anchor = ["label", "role_title", "type", "person_role", "location", "start_date", "end_date", "work_mode", "program", "status", "evidence_strength"]
    one = p.groupBy(*GROUP).agg(
        F.min_by(F.struct(*anchor), place).alias("a"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("direct_skills")))).alias("skills"), F.sum("n_achievements").alias("n_achievements"),
        *[c.alias(k) for k, c in (names | _scores()).items()],
    ).withColumn("score", _score())
    kinds = skills.groupBy(*JP).agg(F.collect_set(F.when(F.col("category") == "language", F.col("name"))).alias("languages"), F.collect_set(F.when(F.col("category").isin("technical", "tool"), F.col("name"))).alias("tech"))
    metrics = achievement_evidence(p, g).groupBy(*GROUP).agg(F.array_sort(F.collect_set(X.present("metric"))).alias("metrics"))
    one = one.join(metrics, GROUP, "left").join(kinds, JP, "left").withColumn("technologies", F.array_intersect("skills", "tech"))
    empty = F.array().cast("array<string>")
    only_language = (F.col("class") == "independent") & (F.size(F.array_except("skills", F.coalesce("languages", empty))) == 0) & (F.col("n_achievements") == 0)
    kind, reason = recommended(F.col("score"), only_language)
    typed = F.when(F.col("class") == "independent", F.when(F.lower("a.type").contains("volunteer"), "volunteer").otherwise("independent_project")).otherwise(F.col("class"))
    pro, edu, own = F.col("class") == "professional", F.col("class") == "education", _named()
    return one.select(*GROUP, own["experience_id"].alias("experience_id"), typed.alias("experience_type"), own["title"].alias("title"),
        own["organization"].alias("organization"), F.when(edu, F.col("a.program")).alias("program"), F.when(edu, F.col("a.status")).alias("status"), F.when(~pro & ~edu, F.col("a.person_role")).alias("person_role"),
        F.when(~edu, F.col("a.location")).alias("location"), F.when(~edu, F.col("a.work_mode")).alias("work_mode"), "a.start_date", "a.end_date", "a.evidence_strength",
        own["projects"].alias("projects"), "roles", "skills", F.coalesce("technologies", empty).alias("technologies"), F.coalesce("metrics", empty).alias("metrics"), "n_achievements",
        "supported", "score", kind.alias("recommendation"), reason.alias("reason"), "first_rank")


def known_roles(g: Graph) -> DataFrame:
    """``person_id, role_id, title, company`` and what a zero-evidence experience needs."""
    had = g.edge("HAD_ROLE").select(F.col("src_key").alias("person_id"), F.col("dst_key").alias("role_id"))
    at = g.edge("AT").groupBy(F.col("src_key").alias("role_id")).agg(F.min("dst_key").alias("company"))
    return had.join(g.role.select("role_id", "title", "employment_type", "start_date", "end_date"), "role_id").join(at, "role_id", "left")


def known_independent_projects(g: Graph) -> DataFrame:
    """``person_id, name`` of projects that are part of no education and no role."""
    built = g.edge("BUILT").select(F.col("src_key").alias("person_id"), F.col("dst_key").alias("project_id"))
    for kind in ("PART_OF", "DURING"):
        built = built.join(g.edge(kind).select(F.col("src_key").alias("project_id")), "project_id", "left_anti")
    return built.join(g.project.select("project_id", "name"), "project_id").select("person_id", "name").distinct()


def zero_roles(x: DataFrame, p: DataFrame, applications: DataFrame, g: Graph) -> DataFrame:
    """Roles without any represented company, institution or title, one experience per company (else title)."""
    one = applications.join(known_roles(g), "person_id")
    homes = p.where("source_type = 'Education'").select(*JP, F.col("label").alias("company")).distinct()
    one = one.join(homes, [*JP, "company"], "left_anti").join(x.where("organization is not null").select(*JP, F.col("organization").alias("company")).distinct(), [*JP, "company"], "left_anti")
    one = one.join(x.select(*JP, "title").distinct(), [*JP, "title"], "left_anti")
    key = F.coalesce(X.present("company"), F.col("title"))
    one = one.groupBy(*JP, key.alias("group_key")).agg(
        F.min_by(F.struct("title", "company", "start_date", "end_date"), F.struct("title", "role_id")).alias("r"), F.count("*").alias("n"), F.array_sort(F.collect_set("title")).alias("titles"),
        F.bool_or(F.lower(F.coalesce("employment_type", F.lit(""))) == "volunteer").alias("volunteer"),
    )
    title = F.when(F.col("n") == 1, F.col("r.title")).otherwise(F.concat(F.col("r.title"), F.lit(" (+"), F.col("n") - 1, F.lit(" more role(s))")))
    return one.select(*JP, "group_key", X.slug(F.col("group_key")).alias("experience_id"), F.when(F.col("volunteer"), "volunteer").otherwise("professional").alias("experience_type"), title.alias("title"), F.col("r.company").alias("organization"),
        "r.start_date", "r.end_date", "titles", F.lit(0.0).alias("score"), F.lit("omit").alias("recommendation"), F.lit(NO_EVIDENCE).alias("reason"))


def zero_projects(x: DataFrame, applications: DataFrame, g: Graph) -> DataFrame:
    """Independent projects of the person that no experience is named after."""
    one = applications.join(known_independent_projects(g), "person_id").join(x.select(*JP, F.col("title").alias("name")).distinct(), [*JP, "name"], "left_anti")
    return one.select(*JP, F.col("name").alias("group_key"), X.slug(F.col("name")).alias("experience_id"), F.lit("independent_project").alias("experience_type"), F.col("name").alias("title"), F.lit(0.0).alias("score"),
        F.lit("omit").alias("recommendation"), F.lit(NO_EVIDENCE).alias("reason"))


def order(x: DataFrame) -> DataFrame:
    """``place`` of every experience that isn't omitted: by score, professional first, then class and first story."""
    kinds = F.array(*map(F.lit, ("professional", "independent", "education")))
    w = Window.partitionBy(*JP).orderBy(F.desc("score"), F.when(F.col("experience_type") == "professional", 0).otherwise(1), F.array_position(kinds, F.col("class")), "first_rank")
    return x.where("recommendation <> 'omit'").select(*JP, "experience_id", "title", "experience_type", "score", F.row_number().over(w).alias("place"))


def registry(x: DataFrame, zr: DataFrame, zp: DataFrame) -> DataFrame:
    """``job_id, person_id, name, experience_id``: the last registration of a name wins."""
    kinds = F.array(*map(F.lit, ("professional", "independent", "education")))
    names = F.array_union(F.array("group_key", "title"), F.array_union("projects", "roles"))
    rows = x.select(*JP, F.explode(names).alias("name"), "experience_id", F.array_position(kinds, F.col("class")).alias("step"), F.col("first_rank").cast("long").alias("place"), "group_key")
    zero = zr.select(*JP, F.explode(F.array_union(F.array("organization"), F.col("titles"))).alias("name"), "experience_id", F.lit(4).alias("step"), F.lit(0).cast("long").alias("place"), "group_key")
    more = zp.select(*JP, F.col("title").alias("name"), "experience_id", F.lit(5).alias("step"), F.lit(0).cast("long").alias("place"), "group_key")
    every = rows.unionByName(zero).unionByName(more).where(X.present("name").isNotNull())
    return every.groupBy(*JP, "name").agg(F.max_by("experience_id", F.struct("step", "place", "group_key")).alias("experience_id"))


def experience_of(names: str, p) -> Column:
    """The experience of a piece of evidence, by a map of registered names: of its project, else role, else education, else source."""
    of = {c: F.try_element_at(names, F.coalesce(p[c], F.lit(""))) for c in ("project", "role", "education", "source")}
    return F.coalesce(of["project"], of["role"], of["education"], F.when(p["source_type"] == "Education", of["source"]))


def transferable_list(trans: DataFrame, status: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per requirement and related capability, gaps before partial before matched, with the first evidence's experience.
    ``refs`` lists the located evidence of each job, person and skill."""
    first = refs.select(*JP, F.col("canonical_skill").alias("capability_skill"), F.get("evidence", F.lit(0)).alias("f"))
    one = status.select(*JP, "seq", "raw", "bucket").join(trans, ["job_id", "seq"]).join(first, [*JP, "capability_skill"], "left")
    return one.select(*JP, "seq", "raw", F.col("bucket").alias("literal_status"), F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("bucket")), F.lit(0)).cast("int").alias("status_order"), "place",
        F.coalesce("capability_skill", "capability_query").alias("capability"), "f.experience", F.col("f.evidenceStrength").alias("evidence_strength"), "reason")


def given_list(held: DataFrame, names: DataFrame) -> DataFrame:
    """:func:`transferable_list` from the held requirements, which have the evidence of their related capabilities already, and
    ``names(job_id, person_id, by_name)``, the registry: only requirements with such a capability meet it, once."""
    first = lambda c: F.transform(F.slice(c["evidence"], 1, 1), lambda p: F.struct(*[p[n].alias(n) for n in ("source", "source_type", "project", "role", "education", "evidence_strength")]))
    fields = ["place", "capability_query", "capability_skill", "reason"]
    given = F.transform("given", lambda c: F.struct(*[c[n].alias(n) for n in fields], F.get(first(c), F.lit(0)).alias("f")))
    one = held.where("given is not null").select(*JP, "seq", "raw", "bucket", F.explode(given).alias("c")).join(names, JP, "left")
    return one.select(*JP, "seq", "raw", F.col("bucket").alias("literal_status"), F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("bucket")), F.lit(0)).cast("int").alias("status_order"), "c.place",
        F.coalesce("c.capability_skill", "c.capability_query").alias("capability"), experience_of("by_name", F.col("c.f")).alias("experience"), F.col("c.f.evidence_strength").alias("evidence_strength"), "c.reason")


def relevant_skills(status: DataFrame, trans: DataFrame, skills: DataFrame) -> DataFrame:
    """``relevance`` literal for skills of matched or partial requirements, then transferable for others; no languages."""
    literal = status.where("bucket in ('matched', 'partial') and canonical_skill is not null").select(*JP, F.col("canonical_skill").alias("name")).distinct()
    other = status.select(*JP, "seq").join(trans, ["job_id", "seq"]).where("capability_skill is not null").select(*JP, F.col("capability_skill").alias("name")).distinct().join(literal, [*JP, "name"], "left_anti")
    every = literal.withColumn("relevance", F.lit("literal")).unionByName(other.withColumn("relevance", F.lit("transferable")))
    return skills.where("category <> 'language'").join(every, [*JP, "name"]).select(*JP, "name", "display_name", "category", "relevance")


def languages(s: DataFrame, skills: DataFrame) -> DataFrame:
    """Language skills with the stories that show them; the proficiency is never made up."""
    shown = s.select(*JP, "label", F.explode("direct_skills").alias("name")).groupBy(*JP, "name").agg(F.array_sort(F.collect_set("label")).alias("evidence"))
    one = skills.where("category = 'language'").join(shown, [*JP, "name"], "left")
    return one.select(*JP, "name", "display_name", F.lit(None).cast("string").alias("proficiency"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def theme_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules as rows ``name, rule, theme``, a few by construction."""
    return spark.createDataFrame([(n, i, theme) for i, (names, theme) in enumerate(X.THEMES) for n in names], "name string, rule int, theme string")


def themes(status: DataFrame, skills: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The five themes with the largest overlap per job and person; ties in rule order. ``rules(name, rule, theme)`` are
    rows, so a vocabulary of any size is joined, never collected."""
    rows = theme_rules(status.sparkSession) if rules is None else rules
    literal = status.where("bucket in ('matched', 'partial') and canonical_skill is not null").select(*JP, F.col("canonical_skill").alias("name"))
    names = literal.unionByName(skills.where("category <> 'language'").select(*JP, "name")).distinct()
    found = names.join(rows, "name").groupBy(*JP, "rule", "theme").agg(F.count("*").alias("overlap"))
    place = F.row_number().over(Window.partitionBy(*JP).orderBy(F.desc("overlap"), "rule"))
    return found.withColumn("place", place).where("place <= 5").select(*JP, "place", "theme", "overlap")
