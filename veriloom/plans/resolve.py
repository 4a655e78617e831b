"""Skill resolution: scored retrieval over names and aliases, then lexical acceptance, for all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import text as X

K1, B = 1.2, 0.75
CANDIDATES = 5
SUGGEST_FROM, SUGGEST = 15, 3
AMBIGUOUS = 0.7
SUGGEST_REASON = "Shares specific, non-generic vocabulary with the requirement's own wording."


def postings(skill: DataFrame) -> DataFrame:
    """Inverted index ``skill, field, term, tf, dl`` over the names and the joined aliases."""
    fields = F.array(
        F.struct(F.lit("name").alias("field"), X.terms(F.col("name")).alias("terms")),
        F.struct(F.lit("aliases").alias("field"), X.terms(F.array_join(X.list_or_empty(F.col("aliases")), " ")).alias("terms")),
    )
    one = skill.select(F.col("name").alias("skill"), F.explode(fields).alias("f")).select("skill", "f.field", F.size("f.terms").alias("dl"), F.explode("f.terms").alias("term"))
    return one.groupBy("skill", "field", "dl", "term").agg(F.count("*").alias("tf"))


def weighted(index: DataFrame) -> DataFrame:
    """``skill, term, weight``: the BM25 weight of a term for a skill, summed over the fields."""
    docs = index.select("skill", "field", "dl").distinct().groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = index.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return index.join(df, ["field", "term"]).join(docs, "field").groupBy("skill", "term").agg(F.sum(w).alias("weight"))


def retrieve(queries: DataFrame, skill: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """``queries(query)`` -> the ``k`` best ``query, skill, score, rank`` each; scores have six digits, ties go by name."""
    terms = queries.select("query").distinct().select("query", F.explode(X.tokens(F.col("query"))).alias("term"))
    scored = terms.join(weighted(postings(skill)), "term").groupBy("query", "skill").agg(F.round(F.sum("weight"), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "skill")))
    return ranked.where(F.col("rank") <= k)


def _judged(queries: DataFrame, skill: DataFrame, k: int) -> DataFrame:
    named = retrieve(queries, skill, k).join(skill.withColumnRenamed("name", "skill"), "skill")
    q, n, a = F.col("query"), F.col("skill"), F.col("aliases")
    return named.withColumns({"exact": X.exact_class(q, n, a), "overlap": X.meaningful_overlap(q, n, a)})


def resolve(queries: DataFrame, skill: DataFrame) -> DataFrame:
    """``queries(query)`` -> ``query, canonical_skill, match_score, match_confidence, match_type``, one row each.

    An exact name or alias among the candidates wins in score order; else the first candidate with a meaningful
    overlap: one shared token is low, several are high unless another overlapping candidate comes close.
    """
    c = _judged(queries, skill, CANDIDATES)
    hit = F.size("overlap") > 0
    order = Window.partitionBy("query").orderBy("rank")
    over = c.where(hit).withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    over = over.where("place = 1").select("query", F.col("skill").alias("o_skill"), F.col("score").alias("o_score"), F.size("overlap").alias("n"), "next")
    exact = c.where("exact is not null").groupBy("query").agg(F.min_by(F.struct("skill", "score", "exact"), "rank").alias("e"))
    one = queries.select("query").distinct().join(exact, "query", "left").join(over, "query", "left")
    is_exact, single = F.col("e").isNotNull(), F.col("n") < 2
    clear = F.col("next").isNull() | ((F.col("o_score") > 0) & (F.col("next") / F.col("o_score") < AMBIGUOUS))
    return one.select(
        "query",
        F.coalesce("e.skill", "o_skill").alias("canonical_skill"),
        F.coalesce("e.score", "o_score").alias("match_score"),
        F.when(is_exact, "high").when(F.col("n").isNull(), "no_match").when(single, "low").when(clear, "high").otherwise("low").alias("match_confidence"),
        F.when(is_exact, F.col("e.exact")).when(F.col("n").isNull(), "no_match").when(single, "lexical_single_token").otherwise("lexical_multi_token").alias("match_type"),
    )


def recommendation(match_type, confidence):
    return F.when(match_type.isin("canonical_exact", "alias_exact"), "include").when(match_type == "lexical_multi_token", F.when(confidence == "high", "include").otherwise("optional")).otherwise("exclude")


def resolve_requirements(requirements: DataFrame, skill: DataFrame) -> DataFrame:
    """Requirements with their resolution; each distinct query is resolved once."""
    found = resolve(requirements.select(F.col("skill_query").alias("query")), skill).withColumnRenamed("query", "skill_query")
    return requirements.join(found, "skill_query", "left").withColumn("recommendation", recommendation(F.col("match_type"), F.col("match_confidence")))


def capability_results(requirements: DataFrame, skill: DataFrame) -> DataFrame:
    """The distinct related capabilities of all requirements, resolved like requirements."""
    return resolve(requirements.select(F.explode("related.skill_query").alias("query")), skill).select("query", "canonical_skill", "match_score", "match_confidence", "match_type", F.lit("preferred").alias("importance"), F.lit("capability").alias("category"))


def suggest(texts: DataFrame, skill: DataFrame) -> DataFrame:
    """``texts(query)`` -> up to three vocabulary skills each that share specific terms: ``query, skill, score, place, shared_terms``."""
    c = _judged(texts, skill, SUGGEST_FROM).where(F.size("overlap") > 0)
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("place") <= SUGGEST)
    return c.select("query", "skill", "score", "place", F.col("overlap").alias("shared_terms"))


def autofill(requirements: DataFrame, skill: DataFrame) -> DataFrame:
    """Requirements without related capabilities get the suggestions for their query, but for the query itself."""
    empty = F.coalesce(F.size("related"), F.lit(0)) == 0
    found = suggest(requirements.where(empty).select(F.col("skill_query").alias("query")), skill).where("skill <> query")
    entry = F.struct("place", F.struct(F.col("skill").alias("skill_query"), F.lit(SUGGEST_REASON).alias("reason"), F.lit("graph_vocabulary").alias("source")).alias("entry"))
    found = found.groupBy(F.col("query").alias("skill_query")).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["entry"]).alias("filled"))
    return requirements.join(found, "skill_query", "left").withColumn("related", F.when(empty & F.col("filled").isNotNull(), F.col("filled")).otherwise(F.col("related"))).drop("filled")


def vocabulary_check(names: DataFrame, skill: DataFrame) -> DataFrame:
    """``names(query)`` -> whether each is a name or an alias of the vocabulary, and of which skill."""
    found = resolve(names, skill)
    known = skill.select(F.col("name").alias("canonical_skill"), "display_name", "category")
    real = F.col("match_type").isin("canonical_exact", "alias_exact")
    return found.join(known, "canonical_skill", "left").select("query", real.alias("exists"), "canonical_skill", "display_name", "category", "match_type")
