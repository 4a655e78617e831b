"""Nested documents of a job and person: context, package and structured document, each assembled in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.plans import documents as D
from veriloom.plans import package as P
from veriloom.plans.package import GROUP, JP
from veriloom.plans.stories import PROPERTIES

BUCKETS = {"matched": "matched", "partial": "partial", "gaps": "gap"}
SECTIONS = {"experience": "experience", "projects": "project", "education": "education"}


def camel(name: str) -> str:
    """``skill_query`` as ``skillQuery``."""
    first, *rest = name.split("_")
    return first + "".join(map(str.capitalize, rest))


def doc(*columns: Column | str, **named: Column) -> Column:
    """A struct; columns that are given by name get it in camel case."""
    return F.struct(*[F.col(c).alias(camel(c.split(".")[-1])) if isinstance(c, str) else c for c in columns], *[c.alias(k) for k, c in named.items()])


def as_json(c: Column | str) -> Column:
    """JSON text with nulls kept; fields and lists in their order, so equal documents are equal texts."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def listed(order: list[Column | str], value: Column) -> Column:
    """An aggregate: the values as a list in that order, which should be unique."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), value.alias("d")))), lambda x: x["d"])


Part = tuple[DataFrame, list, Column]


def assembled(base: DataFrame, parts: dict[str, Part], keys: list[str]) -> DataFrame:
    """``base`` (one row a key) with a list for every part ``(rows, order, value)``, empty where a key has no rows.

    All rows are tagged by the column they fill and meet in one shuffle, instead of one join a part; a list follows its
    explicit order, whatever order rows arrive in. Rows of keys that the base doesn't have are left out.
    """
    rest = [c for c in base.columns if c not in keys]
    rows = base.select(*keys, F.struct(F.lit(True).alias("in_base"), *rest).alias("base"))
    kinds = {}
    for name, (df, order, value) in parts.items():
        one = df.select(*keys, F.struct(F.struct(*order).alias("o"), value.alias("d")).alias(name))
        kinds[name] = one.schema[name].dataType["d"].dataType
        rows = rows.unionByName(one, allowMissingColumns=True)
    lists = [F.transform(F.sort_array(F.collect_list(name)), lambda x: x["d"]).alias(name) for name in parts]
    one = rows.groupBy(*keys).agg(F.first("base", ignorenulls=True).alias("base"), *lists).where("base.in_base")
    return one.select(*keys, *[F.col(f"base.{c}").alias(c) for c in rest], *parts)


# ---- requirements


def names_of(reg: DataFrame) -> DataFrame:
    """The registry as one map of names per job and person, which is as small as that person's career."""
    return reg.groupBy(*JP).agg(F.map_from_entries(F.collect_list(F.struct("name", "experience_id"))).alias("by_name"))


def _reference(p: Column) -> Column:
    """A piece of evidence as a reference to its experience in ``by_name``."""
    return F.struct(P.experience_of("by_name", p).alias("experience"), *[p[c].alias(camel(c)) for c in ("source_type", "evidence_strength", "professional_context")])


def references(careers: DataFrame, reg: DataFrame, applications: DataFrame) -> DataFrame:
    """``job_id, person_id, canonical_skill, evidence``: references to the evidence of a skill, in the order of its six fields.
    A person's career and the names meet once a job and person."""
    one = applications.join(careers, "person_id").join(names_of(reg), JP, "left")
    located = F.transform("skills", lambda s: F.struct(s["canonical_skill"].alias("canonical_skill"), F.transform(s["pieces"], _reference).alias("evidence")))
    return one.select(*JP, F.explode(located).alias("s")).select(*JP, "s.canonical_skill", "s.evidence")


def requirement_summaries(held: DataFrame, reg: DataFrame) -> DataFrame:
    """``job_id, person_id, seq, bucket, summary``: every requirement with references to its evidence, in the order of its
    six fields, and to the related capabilities, in theirs, each with its first evidence. A gap stays, with empty lists.
    Requirements hold all of that already, so they are shuffled once, to the names of their job and person."""

    def related(c: Column) -> Column:
        first = _reference(F.get(c["evidence"], F.lit(0)))
        return F.struct(F.coalesce(c["capability_skill"], c["capability_query"]).alias("capability"), first["experience"].alias("experience"), c["reason"].alias("reason"), first["evidenceStrength"].alias("evidenceStrength"))

    given = F.transform("given", related)
    one = held.join(names_of(reg), JP, "left").select(*held.columns, F.transform("evidence", _reference).alias("refs"), given.alias("told"))
    lists = {"evidence": F.col("refs"), "transferableEvidence": F.coalesce("told", F.array().cast(dict(one.dtypes)["told"]))}
    summary = doc(F.col("raw").alias("requirement"), "skill_query", "importance", "category", "match_type", "match_confidence", "recommendation", F.col("bucket").alias("literalStatus"), **lists)
    return one.select(*JP, "seq", "bucket", summary.alias("summary"))


def by_bucket(df: DataFrame, value: str) -> Part:
    """One part of all buckets, in the order of requirements, which :func:`in_buckets` takes apart: rows are made once, not
    once a bucket."""
    return df, ["seq"], F.struct("bucket", F.col(value).alias("value"))


def in_buckets(one: DataFrame, name: str) -> DataFrame:
    """``matched, partial, gaps`` in place of a part of :func:`by_bucket`."""

    def of(bucket: str) -> Column:
        return F.transform(F.filter(name, lambda x: x["bucket"] == bucket), lambda x: x["value"])

    return one.withColumns({n: of(bucket) for n, bucket in BUCKETS.items()}).drop(name)


def requirement_buckets(summaries: DataFrame, applications: DataFrame) -> DataFrame:
    """``job_id, person_id, matched, partial, gaps``: lists of requirements."""
    return in_buckets(assembled(applications.select(*JP), {"held": by_bucket(summaries, "summary")}, JP), "held")


# ---- context


def requirement_matches(held: DataFrame) -> DataFrame:
    """``job_id, person_id, seq, bucket, match``: every requirement with all of its evidence and that of its related
    capabilities, row by row."""
    names = ["source", "source_type", "relationship", "project", "role", "education", "professional_context", "evidence_strength"]
    items = lambda c: F.transform(c, lambda p: F.struct(*[p[n].alias(camel(n)) for n in names]))
    related = {"capabilityQuery": "capability_query", "canonicalSkill": "capability_skill", "matchType": "capability_match", "reason": "reason", "source": "source"}
    one = held.withColumn("told", F.transform("given", lambda c: F.struct(*[c[n].alias(k) for k, n in related.items()], items(c["evidence"]).alias("evidence"))))
    lists = {"evidence": items("evidence"), "transferableEvidence": F.coalesce("told", F.array().cast(dict(one.dtypes)["told"]))}
    match = doc(F.col("raw").alias("requirement"), "skill_query", "importance", "category", "match_type", "canonical_skill", F.col("match_confidence").alias("confidence"), "recommendation", **lists)
    return one.select(*JP, "seq", "bucket", match.alias("match"))


def contexts(requirements: DataFrame, matches: DataFrame, stories: DataFrame, skills: DataFrame, applications: DataFrame, guidance: list[str]) -> DataFrame:
    """``job_id, person_id, context``: the requirements of the job, those matched, partial and missing with their evidence,
    the stories by rank, the skills by name, and the guidance."""
    related = F.transform("related", lambda r: F.struct(r["skill_query"].alias("skillQuery"), r["reason"].alias("reason"), r["source"].alias("source")))
    asked = requirements.groupBy("job_id").agg(listed(["seq"], doc("raw", "skill_query", "importance", "category", relatedCapabilities=related)).alias("requirements"))
    base = applications.select(*JP).join(asked, "job_id", "left")
    base = base.withColumn("requirements", F.coalesce("requirements", F.array().cast(dict(base.dtypes)["requirements"])))
    told = F.transform("achievements", lambda a: F.struct(a["description"].alias("description"), a["matched_skills"].alias("matchedSkills"), a["evidence_strength"].alias("evidenceStrength"), a["has_metric"].alias("hasMetric")))
    kept = stories.withColumn("told", told)
    kept = kept.withColumn("told", F.coalesce("told", F.array().cast(dict(kept.dtypes)["told"])))
    story = doc("label", "source_type", "project", *PROPERTIES, "professional_context", "evidence_strength", "direct_skills", F.col("told").alias("strongestAchievements"), F.col("supports").alias("supportsRequirements"), "required_count")
    parts = {"held": by_bucket(matches, "match"), "stories": (kept, ["rank"], story), "skills": (skills, ["name"], doc("name", "display_name", "category"))}
    one = in_buckets(assembled(base, parts, JP), "held")
    rules = F.array(*map(F.lit, guidance)).cast("array<string>")
    whole = doc("requirements", F.col("matched").alias("matchedRequirements"), F.col("partial").alias("partialRequirements"), "gaps", F.col("stories").alias("evidenceStories"), "skills", F.struct(rules.alias("targetingPrinciples")).alias("cvGuidance"))
    return one.select(*JP, whole.alias("context"))


# ---- package


def experiences(x: DataFrame, parts: DataFrame, zr: DataFrame, zp: DataFrame, g) -> DataFrame:
    """``job_id, person_id, kind, place, group_key, experience``: those with evidence (by class and first story, with
    achievements, provenance and reference projects), then roles and projects without."""
    ach = doc("achievement_id", "text", "metric", "has_metric", "skills")
    origin = doc("source_type", "project", "role", "company", "education", "relationship")
    unused = P.reference_projects(parts, g).withColumn("class", F.lit("education"))
    own = {"found": (P.achievement_evidence(parts, g), ["rank", "text"], ach), "origins": (P.provenance(parts), ["rank"], origin), "unused": (unused, ["name"], F.col("name"))}
    one = assembled(x, own, GROUP)
    edu = F.col("class") == "education"
    kind = F.array_position(F.array(*map(F.lit, ("professional", "independent", "education"))), F.col("class")).cast("int")
    names = F.array().cast("array<string>")
    types = dict(one.dtypes)

    def shaped(df: DataFrame, order: Column, place: Column, **given: Column) -> DataFrame:
        def c(name: str, default: Column) -> Column:
            return given.get(name, F.col(name) if name in df.columns else default)

        none = F.lit(None).cast("string")
        text = lambda n: c(n, none).alias(camel(n))
        many = lambda n, alias=None: c(n, names).alias(alias or camel(n))
        made = doc(*map(text, ("experience_id", "experience_type", "title", "person_role", "organization", "institution", "program", "status", "location", "start_date", "end_date", "work_mode")),
            many("projects"), many("roles"), many("unused", "referenceProjects"), F.struct(c("score", F.lit(0.0)).alias("score"), many("supported", "supportedRequirements")).alias("relevance"), many("skills"), many("technologies"),
            c("found", F.array().cast(types["found"])).alias("achievements"), many("metrics"), c("origins", F.array().cast(types["origins"])).alias("provenance"), text("recommendation"), F.col("reason").alias("recommendationReason"))
        return df.select(*JP, order.alias("kind"), place.cast("long").alias("place"), "group_key", made.alias("experience"))

    found = shaped(one, kind, F.col("first_rank"), institution=F.when(edu, F.col("group_key")))
    found = found.unionByName(shaped(zr, F.lit(4), F.lit(0)))
    return found.unionByName(shaped(zp, F.lit(5), F.lit(0)))


def packages(made: DataFrame, order: DataFrame, summaries: DataFrame, trans: DataFrame, relevant: DataFrame, languages: DataFrame, themes: DataFrame, applications: DataFrame) -> DataFrame:
    """``job_id, person_id, package``: all seven parts of the evidence package."""
    entry = doc(F.col("raw").alias("requirement"), "literal_status", "capability", "experience", "reason")
    parts = {
        "experiences": (made, ["kind", "place", "group_key"], F.col("experience")), "order": (order, ["place"], F.col("experience_id")), "held": by_bucket(summaries, "summary"), "given": (trans, ["status_order", "seq", "place"], entry),
        "relevant": (relevant, [F.col("relevance").alias("r"), "name"], doc("name", "display_name", "category", "relevance")), "languages": (languages, ["name"], doc(F.col("display_name").alias("name"), "proficiency", "evidence")),
        "themes": (themes, ["place"], F.col("theme")),
    }
    one = in_buckets(assembled(applications.select(*JP), parts, JP), "held")
    whole = doc("experiences", F.col("order").alias("recommendedExperienceOrder"), F.struct("matched", "partial", "gaps").alias("requirements"), F.col("given").alias("transferableEvidence"), F.col("relevant").alias("relevantSkills"), "languages",
        F.col("themes").alias("strongestThemes"))
    return one.select(*JP, whole.alias("package"))


# ---- structured document


def structured(bullets: DataFrame, routed: DataFrame, skills: DataFrame, applications: DataFrame, g) -> DataFrame:
    """``job_id, person_id, document``: name, profile, entries by section, skills by bucket and languages."""
    shown = F.transform("bullets", lambda b: F.struct(b["text"].alias("text"), b["evidence_ids"].alias("evidenceIds")))
    dates = ["start_date", "end_date"]
    fields = {
        "experience": ["title", "organization", "location", *dates], "projects": [F.col("title").alias("name"), F.col("organization").alias("role"), F.col("location").alias("context"), *dates],
        "education": [F.col("title").alias("institution"), F.col("location").alias("program"), *dates],
    }
    entries = D.entries(bullets)
    parts: dict[str, Part] = {name: (entries.where(F.col("section") == SECTIONS[name]), ["rank", "title"], doc(*f, bullets=shown)) for name, f in fields.items()}
    parts["buckets"] = (D.bucketed_skills(skills), ["bucket"], F.struct("bucket", "names"))
    parts["languages"] = (skills.where("category = 'language'"), ["display_name", "name"], F.col("display_name"))
    base = D.profiles(routed, skills, applications).join(g.person.select("person_id", "name"), "person_id")
    one = assembled(base, parts, JP).withColumn("buckets", F.map_from_entries("buckets"))
    grouped = F.struct(*[F.coalesce(F.try_element_at("buckets", F.lit(b)), F.array().cast("array<string>")).alias(b) for b in D.SKILL_LINES])
    return one.select(*JP, doc("name", "headline", "profile", "experience", "projects", "education", grouped.alias("skills"), "languages").alias("document"))


def prompts(texts: DataFrame, instruction: str, context: DataFrame, writing: str) -> DataFrame:
    """``kind, job_id, person_id, prompt``: one to extract the requirements of each job text, and one to write the document
    of each job and person from its context as JSON."""
    none = F.lit(None).cast("string")
    extract = texts.select(F.lit("extraction").alias("kind"), "job_id", none.alias("person_id"), F.concat(F.lit(instruction), F.coalesce("text", F.lit(""))).alias("prompt"))
    return extract.unionByName(context.select(F.lit("document").alias("kind"), *JP, F.concat(F.lit(writing), as_json("context")).alias("prompt")))
