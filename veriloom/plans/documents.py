"""Structured documents from stories: bounded bullets with provenance, profile, rendered text, prompts and an audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.plans.package import JP, education_home, languages_of
from veriloom.sources.graph import Graph

MAX_BULLETS = 4
# The texts of a profile.
HEADLINE = "Software Engineer"
ENGINEER_USING = "Software engineer with hands-on experience building full-stack applications and AI-assisted tooling using "
ENGINEER = "Software engineer with hands-on, project-based engineering experience."
GAINED, WORK, PROJECTS = "Experience gained through ", "professional engineering work", "independent full-stack projects"
BULLETS = "array<struct<text:string,evidence_ids:array<string>>>"
# Phrases that must not reach a rendered text.
BANNED = ["Note on role alignment", "Skills used:", "Evidence-backed match", "no evidence found", "match-confidence", "matchConfidence"]


def routed(s: DataFrame, skills: DataFrame) -> DataFrame:
    """Stories with ``section``: education (by home), experience (professional), project (if substantial) or none."""
    one = education_home(s).join(languages_of(skills), JP, "left")
    substantial = (F.col("n_achievements") > 0) | (F.size(F.array_except("direct_skills", F.coalesce("languages", F.array().cast("array<string>")))) > 0)
    section = F.when(F.col("home").isNotNull(), "education").when(F.col("professional_context"), "experience").when(substantial, "project")
    return one.withColumns({"section": section, "substantial": substantial}).drop("languages")


def achievement_bullets(r: DataFrame) -> DataFrame:
    """Up to four achievements as bullets, each with its text as evidence id."""
    made = F.transform(F.slice("achievements", 1, MAX_BULLETS), lambda a: F.struct(a["description"].alias("text"), F.array(a["description"]).alias("evidence_ids")))
    return r.withColumn("bullets", F.coalesce(made, F.array()).cast(BULLETS))


def with_fallback(r: DataFrame, skills: DataFrame) -> DataFrame:
    """``bullets`` of every story: achievements, else its description, else a sentence over its skills, else none.

    Experiences name skills as they are, other sections by display name.
    """
    shown = r.select(*JP, "rank", F.explode("direct_skills").alias("name")).join(skills.select(*JP, "name", "display_name"), [*JP, "name"], "left")
    shown = shown.groupBy(*JP, "rank").agg(F.array_sort(F.collect_list(F.coalesce("display_name", "name"))).alias("shown"))
    one = achievement_bullets(r).join(shown, [*JP, "rank"], "left")
    names = F.array_join(F.when(F.col("section") == "experience", F.array_sort("direct_skills")).otherwise(F.col("shown")), ", ")
    verb = F.when(F.col("source_type") == "Role", "Served as").otherwise("Contributed to")
    sentence = F.when(F.size("direct_skills") > 0, F.concat(verb, F.lit(" "), F.col("label"), F.lit(", applying "), names, F.lit(".")))
    text = F.coalesce(X.present("description"), sentence)
    fallback = F.when(text.isNotNull(), F.array(F.struct(text.alias("text"), F.array(F.concat(F.lit("story:"), F.col("label"))).alias("evidence_ids")))).otherwise(F.array().cast(BULLETS))
    return one.withColumn("fallback", fallback.cast(BULLETS)).withColumn("bullets", F.when(F.size("bullets") > 0, F.col("bullets")).otherwise(F.col("fallback")))


def experience_entries(b: DataFrame) -> DataFrame:
    return b.where("section = 'experience'").select(*JP, "rank", F.coalesce(X.present("role_title"), F.col("label")).alias("title"), F.col("company").alias("organization"),
        F.coalesce(X.present("location"), F.col("work_mode")).alias("location"), X.partial_date(F.col("start_date")).alias("start_date"), X.partial_date(F.col("end_date")).alias("end_date"), "bullets")


def project_entries(b: DataFrame) -> DataFrame:
    return b.where("section = 'project'").select(*JP, "rank", F.col("label").alias("title"), F.col("person_role").alias("organization"), F.col("context").alias("location"),
        X.partial_date(F.col("start_date")).alias("start_date"), X.partial_date(F.col("end_date")).alias("end_date"), "bullets")


def education_entries(b: DataFrame) -> DataFrame:
    """One entry per institution: the anchor's description, then the bullets of what folds into it, four in all."""
    one = b.where("section = 'education'")
    first = F.struct(F.when(F.col("source_type") == "Education", 0).otherwise(1).alias("o"), F.col("rank").alias("r"))
    one = one.withColumn("place", F.row_number().over(Window.partitionBy(*JP, "home").orderBy(first)))
    own = F.when(X.present("description").isNotNull(), F.array(F.struct(F.col("description").alias("text"), F.array(F.concat(F.lit("education:"), F.col("home"))).alias("evidence_ids")))).otherwise(F.array().cast(BULLETS))
    one = one.withColumn("bullets", F.when(F.col("place") == 1, own.cast(BULLETS)).otherwise(F.col("bullets")))
    out = one.groupBy(*JP, "home").agg(
        F.min_by(F.struct("rank", "program", "start_date", "end_date"), "place").alias("a"),
        F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "bullets"))), lambda x: x["bullets"])), 1, MAX_BULLETS).alias("bullets"),
    )
    return out.select(*JP, F.col("a.rank").alias("rank"), F.col("home").alias("title"), F.lit(None).cast("string").alias("organization"), F.col("a.program").alias("location"),
        X.partial_date(F.col("a.start_date")).alias("start_date"), X.partial_date(F.col("a.end_date")).alias("end_date"), "bullets")


def bucketed_skills(skills: DataFrame) -> DataFrame:
    """``job_id, person_id, bucket, names``: display names by section, sorted; languages are left out."""
    one = skills.where("category <> 'language'").withColumn("bucket", X.skill_bucket(F.col("name"), F.col("category")))
    return one.groupBy(*JP, "bucket").agg(F.array_sort(F.collect_list("display_name")).alias("names"))


def language_names(skills: DataFrame) -> DataFrame:
    return skills.where("category = 'language'").groupBy(*JP).agg(F.array_sort(F.collect_list("display_name")).alias("languages"))


def prominent_tech(r: DataFrame, skills: DataFrame) -> DataFrame:
    """The first six technologies in story order (experiences, then projects), by display name."""
    one = r.where("section in ('experience', 'project')").select(*JP, F.when(F.col("section") == "experience", 0).otherwise(1).alias("s"), "rank", F.posexplode("direct_skills").alias("i", "name"))
    one = one.join(skills.where("category in ('technical', 'tool')").select(*JP, "name", "display_name"), [*JP, "name"])
    one = one.groupBy(*JP, "display_name").agg(F.min(F.struct("s", "rank", "i")).alias("at"))
    one = one.withColumn("place", F.row_number().over(Window.partitionBy(*JP).orderBy("at"))).where("place <= 6")
    names = F.transform(F.sort_array(F.collect_list(F.struct("place", "display_name"))), lambda x: x["display_name"])
    return one.groupBy(*JP).agg(names.alias("tech")).withColumn("tech_text", X.natural_list(F.col("tech")))


def profiles(r: DataFrame, skills: DataFrame, applications: DataFrame) -> DataFrame:
    """``job_id, person_id, headline, profile`` composed of the sections that are there."""
    has = r.groupBy(*JP).agg(F.bool_or(F.coalesce(F.col("section") == "experience", F.lit(False))).alias("e"), F.bool_or(F.coalesce(F.col("section") == "project", F.lit(False))).alias("p"))
    one = applications.join(has, JP, "left").join(prominent_tech(r, skills), JP, "left")
    first = F.when(F.col("tech_text").isNotNull(), F.concat(F.lit(ENGINEER_USING), F.col("tech_text"), F.lit(".")))
    first = F.coalesce(first, F.lit(ENGINEER))
    bits = F.concat_ws(", ", F.when(F.col("e"), WORK), F.when(F.col("p"), PROJECTS))
    second = F.when(F.col("e") | F.col("p"), F.concat(F.lit(GAINED), bits, F.lit(".")))
    return one.select(*JP, F.lit(HEADLINE).alias("headline"), F.concat_ws(" ", first, second).alias("profile"))


def _block(title, other, meta, start, end, bullets):
    """Lines of one rendered entry, joined."""
    when = F.when(X.present(start).isNotNull(), F.concat(start, F.lit(" – "), F.coalesce(X.present(end), F.lit("Present"))))
    line = F.concat_ws(" | ", X.present(meta), when)
    head = F.concat(F.lit("### "), title, F.coalesce(F.concat(F.lit(" — "), X.present(other)), F.lit("")))
    items = F.transform(bullets, lambda b: F.concat(F.lit("- "), b["text"]))
    return F.array_join(F.concat(F.array(head), F.when(line != "", F.array(F.concat(F.lit("*"), line, F.lit("*")))).otherwise(F.array().cast("array<string>")), F.array(F.lit("")), items, F.array(F.lit(""))), "\n")


SECTIONS = {"experience": "## Experience", "project": "## Projects", "education": "## Education"}
SKILL_LINES = {"programming": "Languages", "frameworks": "Frameworks & Libraries", "databases": "Data", "tools": "Tools", "capabilities": "Capabilities"}


def entries(b: DataFrame) -> DataFrame:
    """All entries with their ``section``."""
    made = [("experience", experience_entries(b)), ("project", project_entries(b)), ("education", education_entries(b))]
    every = None
    for name, df in made:
        one = df.withColumn("section", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return every


def rendered(b: DataFrame, r: DataFrame, skills: DataFrame, applications: DataFrame, g: Graph) -> DataFrame:
    """``job_id, person_id, text``: headed sections, left out when empty."""
    block = _block(F.col("title"), F.col("organization"), F.col("location"), F.col("start_date"), F.col("end_date"), F.col("bullets"))
    parts = entries(b).withColumn("block", block).groupBy(*JP, "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title", "block"))), lambda x: x["block"]), "\n").alias("body"))
    wide = parts.groupBy(*JP).pivot("section", list(SECTIONS)).agg(F.first("body"))
    lines = bucketed_skills(skills).groupBy(*JP).pivot("bucket", list(SKILL_LINES)).agg(F.first(F.array_join("names", ", ")))
    one = profiles(r, skills, applications).join(g.person, "person_id").join(wide, JP, "left").join(lines, JP, "left").join(language_names(skills), JP, "left")
    shown = [F.concat(F.lit(f"**{label}:** "), F.col(k)) for k, label in SKILL_LINES.items()]
    tech = F.concat_ws("\n", *shown)
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.col("name"), F.lit("\n")), F.concat(F.lit("### "), F.col("headline"), F.lit("\n")), F.concat(F.col("profile"), F.lit("\n")),
        *[F.concat(F.lit(f"{head}\n"), F.col(k)) for k, head in SECTIONS.items()], F.when(tech != "", F.concat(F.lit("## Technical Skills\n"), tech, F.lit("\n"))),
        F.when(F.size("languages") > 0, F.concat(F.lit("## Languages\n"), F.array_join("languages", ", "), F.lit("\n"))))
    return one.select(*JP, F.concat(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n")).alias("text"))


def with_faults(b: DataFrame, texts: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bullets and texts with planted faults, for holding :func:`audit` against them. The first digit of the MD5 of
    ``job_id:person_id`` says which: 0 to 3, the bullets of the first story lose their evidence; 4 to 7, the text gets a
    banned phrase; 8 to b, it names a gap."""
    mark = F.md5(F.concat_ws(":", *JP).cast("binary"))
    first = mark.substr(1, 1)
    bare = F.transform("bullets", lambda x: F.struct(x["text"].alias("text"), F.array().cast("array<string>").alias("evidence_ids")))
    bullets = b.withColumn("bullets", F.when(first.isin(*"0123") & (F.col("rank") == 1), bare).otherwise(F.col("bullets")))
    phrase = F.get(F.array(*map(F.lit, BANNED)), F.pmod(F.ascii(mark.substr(2, 1)), F.lit(len(BANNED))))
    gap = status.where("bucket = 'gap'").groupBy(*JP).agg(F.min("skill_query").alias("gap"))
    said = F.when(first.isin(*"4567"), phrase).when(first.isin(*"89ab"), F.concat(F.lit("Also "), F.col("gap")))
    return bullets, texts.join(gap, JP, "left").select(*JP, F.concat("text", F.coalesce(F.concat(said, F.lit("\n")), F.lit(""))).alias("text"))


def audit(b: DataFrame, texts: DataFrame, status: DataFrame) -> DataFrame:
    """Claims that must not be there: bullets without evidence id, banned phrases in the text of a document, and gaps that
    it names.

    The gaps of a job and person go to their text as one list, and the text is searched where it is, once for all of
    them: by its terms first, so only gaps whose rarest (longest) term it has are looked for letter by letter.
    """
    bare = entries(b).select(*JP, F.explode("bullets").alias("b")).where("size(b.evidence_ids) = 0").select(*JP, F.lit("no_evidence_id").alias("issue"), F.col("b.text").alias("what"))
    said = F.filter(F.array(*map(F.lit, BANNED)), lambda p: F.lower("text").contains(F.lower(p)))
    banned = texts.select(*JP, F.explode(said).alias("what")).select(*JP, F.lit("banned_phrase").alias("issue"), "what")
    rarest = F.array_max(F.transform(X.terms(F.col("skill_query")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    gaps = status.where("bucket = 'gap'").groupBy(*JP).agg(F.collect_set(F.struct(F.col("skill_query").alias("name"), rarest.alias("key"))).alias("gaps"))
    one = texts.withColumns({"low": F.lower("text"), "own": X.tokens(F.col("text"))}).join(gaps, JP)
    flanked = lambda n: F.regexp_instr(F.col("low"), F.concat(F.lit(r"(?<![a-z0-9])\Q"), n, F.lit(r"\E(?![a-z0-9])"))) > 0
    hit = F.filter("gaps", lambda g: (g["key"].isNull() | F.array_contains(F.col("own"), g["key"])) & F.contains(F.col("low"), g["name"]) & flanked(g["name"]))
    named = one.select(*JP, F.explode(F.transform(hit, lambda g: g["name"])).alias("what")).select(*JP, F.lit("gap_named").alias("issue"), "what")
    return bare.unionByName(banned).unionByName(named)
