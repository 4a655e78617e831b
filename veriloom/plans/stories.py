"""One story per experience of a person for a job, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.plans.evidence import STRENGTHS
from veriloom.sources.graph import Graph
from veriloom.sources.staging import dealt

JP = ["job_id", "person_id"]
ID = [*JP, "story_type", "label"]
LABEL_RANK = {"Achievement": 0, "Project": 1, "Role": 2, "Education": 3}


def keyed(numbered: DataFrame) -> DataFrame:
    """Evidence of non-excluded requirements with the experience it belongs to: the project, else the role, else itself."""
    project, role = X.present("project"), X.present("role")
    kind = F.when(project.isNotNull(), "Project").when(role.isNotNull(), "Role").otherwise(F.col("source_type"))
    return numbered.where("recommendation <> 'exclude'").withColumns({"story_type": kind, "label": F.coalesce(project, role, F.col("source"))})


def _rank(c):
    return F.array_position(F.array(*map(F.lit, STRENGTHS)), c)


def aggregated(k: DataFrame) -> DataFrame:
    """Professional if any evidence is; distinct skills of what isn't an achievement; the label type of the last such."""
    direct = F.col("source_type") != "Achievement"
    return k.groupBy(*ID).agg(
        F.bool_or("professional_context").alias("professional_context"),
        F.array_sort(F.collect_set(F.when(direct, F.col("canonical_skill")))).alias("direct_skills"),
        F.max_by("source_type", F.when(direct, F.col("n"))).alias("anchor"),
        F.get(F.array(*map(F.lit, STRENGTHS)), (F.min(_rank(F.col("evidence_strength"))) - 1).cast("int")).alias("evidence_strength"),
        F.min("n").alias("first_seen"),
    ).withColumn("source_type", F.coalesce("anchor", "story_type")).drop("anchor")


def story_achievements(k: DataFrame) -> DataFrame:
    """Per story and achievement text: matched skills, the strength first seen, whether it has a metric, and its place."""
    return k.where("source_type = 'Achievement'").groupBy(*ID, F.col("source").alias("description")).agg(
        F.array_sort(F.collect_set("canonical_skill")).alias("matched_skills"), F.min_by("evidence_strength", "n").alias("evidence_strength"), F.min("n").alias("first_seen")
    ).withColumn("has_metric", X.has_metric(F.col("description")))


def story_requirements(k: DataFrame) -> DataFrame:
    """Per story and requirement text: when first seen, and the importance it had then."""
    return k.groupBy(*ID, "raw").agg(F.min("n").alias("first_seen"), F.min_by("importance", "n").alias("importance"))


def project_details(g: Graph) -> DataFrame:
    """``person_id, name`` and properties; dates, place and mode fall back to the role's. Of several roles or educations
    the smallest key counts."""
    built = g.edge("BUILT").select(F.col("src_key").alias("person_id"), F.col("dst_key").alias("project_id"))
    at = g.edge("AT").select(F.col("src_key").alias("role_id"), F.col("dst_key").alias("company"))
    role = g.role.select("role_id", F.col("title").alias("role_title"), *[F.col(c).alias(f"role_{c}") for c in ("start_date", "end_date", "location", "work_mode")])
    during = g.edge("DURING").select(F.col("src_key").alias("project_id"), F.col("dst_key").alias("role_id")).join(at, "role_id").join(role, "role_id")
    during = during.groupBy("project_id").agg(F.min_by(F.struct(*[c for c in during.columns if c != "project_id"]), "role_id").alias("d"))
    part = g.edge("PART_OF").groupBy(F.col("src_key").alias("project_id")).agg(F.min("dst_key").alias("education_id")).join(g.education.select("education_id", F.col("institution").alias("education")), "education_id")
    one = built.join(g.project, "project_id").join(during, "project_id", "left").join(part.select("project_id", "education"), "project_id", "left")

    def other(c: str):
        return F.when(X.present("d.role_title").isNotNull(), F.coalesce(X.present(c), F.col(f"d.role_{c}"))).otherwise(F.col(c)).alias(c)

    one = one.select("person_id", "project_id", "name", F.col("d.role_title").alias("role_title"), "d.company", "type", "domain", "context", "description", F.col("role").alias("person_role"),
        other("start_date"), other("end_date"), other("location"), other("work_mode"), "education")
    rest = [c for c in one.columns if c not in ("person_id", "name")]
    return one.groupBy("person_id", "name").agg(F.max_by(F.struct(*rest), "project_id").alias("p")).select("person_id", "name", "p.*").drop("project_id")


def project_schools(g: Graph) -> DataFrame:
    """``person_id, name, education`` of :func:`project_details` alone, where there is one."""
    built = g.edge("BUILT").select(F.col("src_key").alias("person_id"), F.col("dst_key").alias("project_id")).join(g.project.select("project_id", "name"), "project_id")
    part = g.edge("PART_OF").groupBy(F.col("src_key").alias("project_id")).agg(F.min("dst_key").alias("education_id")).join(g.education.select("education_id", F.col("institution").alias("education")), "education_id")
    one = built.join(part.select("project_id", "education"), "project_id", "left").groupBy("person_id", "name").agg(F.max_by("education", "project_id").alias("education"))
    return one.where("education is not null")


def role_details(g: Graph) -> DataFrame:
    """``person_id, name`` (the title) and the role's properties with its company."""
    had = g.edge("HAD_ROLE").select(F.col("src_key").alias("person_id"), F.col("dst_key").alias("role_id"))
    at = g.edge("AT").groupBy(F.col("src_key").alias("role_id")).agg(F.min("dst_key").alias("company"))
    one = had.join(g.role, "role_id").join(at, "role_id", "left")
    rest = ["company", "description", "start_date", "end_date", "location", "work_mode"]
    return one.groupBy("person_id", F.col("title").alias("name")).agg(F.max_by(F.struct(*rest), "role_id").alias("r")).select("person_id", "name", "r.*")


def education_details(g: Graph) -> DataFrame:
    """``name`` (the institution) and the education's properties."""
    rest = ["description", "program", "status", "start_date", "end_date"]
    return g.education.groupBy(F.col("institution").alias("name")).agg(F.max_by(F.struct(*rest), "education_id").alias("e")).select("name", "e.*")


def skill_details(g: Graph) -> DataFrame:
    """``name, display_name, category`` with the defaults for missing values."""
    return g.skill.select("name", F.coalesce(X.present("display_name"), F.col("name")).alias("display_name"), F.coalesce(F.col("category"), F.lit("")).alias("category"))


PROPERTIES = ["role_title", "company", "type", "domain", "context", "description", "person_role", "start_date", "end_date", "location", "work_mode", "education", "program", "status"]


def stories(k: DataFrame, g: Graph, rows: int | None = None) -> DataFrame:
    """Ranked stories with details by the anchor's label, counts and arrays of what they hold."""
    none = F.lit(None).cast("string")

    def shaped(df: DataFrame, kind: str) -> DataFrame:
        return df.select("person_id" if "person_id" in df.columns else none.alias("person_id"), "name", F.lit(kind).alias("kind"), F.struct(*[F.col(c) if c in df.columns else none.alias(c) for c in PROPERTIES]).alias("p"))

    people = shaped(project_details(g), "Project").unionByName(shaped(role_details(g), "Role")).select("person_id", F.col("name").alias("label"), F.col("kind").alias("source_type"), F.col("p").alias("own"))
    schools = shaped(education_details(g), "Education").select(F.col("name").alias("label"), F.col("kind").alias("source_type"), F.col("p").alias("school"))
    # all rows of a job and person meet in one shuffle, in as many tasks as there are rows (the edges, if not given) to share; stories are made and ranked
    # there, and details joined afterwards
    found = dealt(k.select(*ID, "n", "source_type", "source", "canonical_skill", "professional_context", "evidence_strength", "raw", "importance"), g.edges.count() if rows is None else rows, *JP)
    first = F.row_number().over(Window.partitionBy(*ID, "raw").orderBy("n")) == 1
    found = found.withColumn("asked", F.when(first, F.struct("n", "raw", "importance")))
    texts = found.groupBy(*ID, "source_type", "source").agg(
        F.bool_or("professional_context").alias("professional_context"), F.min("n").alias("first_seen"), F.max("n").alias("last_seen"), F.collect_set("canonical_skill").alias("skills"),
        F.min_by("evidence_strength", "n").alias("strength_seen"), F.min(_rank(F.col("evidence_strength"))).alias("best"), F.collect_list("asked").alias("asked"),
    )
    is_ach = F.col("source_type") == "Achievement"
    achievement = F.struct("first_seen", F.col("source").alias("description"), F.sort_array("skills").alias("matched_skills"), F.col("strength_seen").alias("evidence_strength"), X.has_metric(F.col("source")).alias("has_metric"))
    texts = texts.withColumn("achievement", F.when(is_ach, achievement))
    one = texts.groupBy(*ID).agg(
        F.bool_or("professional_context").alias("professional_context"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(~is_ach, F.col("skills")))))).alias("direct_skills"),
        F.max_by("source_type", F.when(~is_ach, F.col("last_seen"))).alias("anchor"), F.get(F.array(*map(F.lit, STRENGTHS)), (F.min("best") - 1).cast("int")).alias("evidence_strength"), F.min("first_seen").alias("first_seen"),
        F.sort_array(F.collect_list("achievement")).alias("achievements"), F.bool_or("achievement.has_metric").alias("any_metric"), F.sort_array(F.flatten(F.collect_list("asked"))).alias("asked"),
    )
    one = one.select(*ID, F.coalesce("anchor", "story_type").alias("source_type"), "professional_context", "direct_skills", "evidence_strength", "first_seen", F.when(F.size("achievements") > 0, F.col("achievements")).alias("achievements"), "any_metric",
        F.transform("asked", lambda x: x["raw"]).alias("supports"), F.size(F.filter("asked", lambda x: x["importance"] == "required")).cast("long").alias("required_count"))
    n = F.coalesce(F.size("achievements"), F.lit(0))
    label = F.coalesce(*[F.when(F.col("source_type") == k, v) for k, v in LABEL_RANK.items()], F.lit(9))
    order = [F.when(n > 0, 0).otherwise(label), -F.size("supports"), F.when(F.col("required_count") > 0, 0).otherwise(1), _rank(F.col("evidence_strength")), F.when(F.coalesce("any_metric", F.lit(False)), 0).otherwise(1), "first_seen"]
    one = one.withColumn("rank", F.row_number().over(Window.partitionBy(*JP).orderBy(*order)))
    one = one.join(people, ["person_id", "label", "source_type"], "left").join(schools, ["label", "source_type"], "left")
    props = [F.coalesce(F.col(f"own.{c}"), F.col(f"school.{c}")).alias(c) for c in PROPERTIES]
    return one.select(*ID, "source_type", "rank", "first_seen", F.when(F.col("source_type") == "Project", F.col("label")).alias("project"), *props, "professional_context", "evidence_strength", "direct_skills", "achievements",
        n.alias("n_achievements"), "supports", "required_count")


def preview(s: DataFrame) -> DataFrame:
    """The top three stories, each with its first two achievements, cut to 90 characters."""
    texts = F.transform(F.slice(F.coalesce("achievements", F.array().cast(s.schema["achievements"].dataType)), 1, 2), lambda a: X.truncate(a["description"]))
    return s.where("rank <= 3").select("job_id", "person_id", "rank", "label", "source_type", "evidence_strength", "professional_context", F.array_join(texts, "\n").alias("achievements"))


def skill_summary(numbered: DataFrame, g: Graph) -> DataFrame:
    """Distinct skills of non-excluded requirements with evidence: ``job_id, person_id, name, display_name, category``."""
    names = numbered.where("recommendation <> 'exclude'").select("job_id", "person_id", F.col("canonical_skill").alias("name")).distinct()
    one = names.join(skill_details(g), "name", "left")
    return one.select("job_id", "person_id", "name", F.coalesce("display_name", "name").alias("display_name"), F.coalesce("category", F.lit("")).alias("category"))
