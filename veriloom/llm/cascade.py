"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts are columns. Each rule is a predicate that rejects; on a sample, the time and the share of rejections of
every rule are measured, and the rules are nested in the order of rejections per second, so most junk is rejected by
cheap rules. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.base import only, staged

SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: About so many documents are read to order the rules; the verdict doesn't depend on them.
SAMPLE = 2000


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a SQL predicate over ``text``, ``n_chars`` and the base counts."""

    name: str
    rejects: str


RULES = (
    Rule("symbols", "n_symbols * 10 > n_words * 3"),
    Rule("repeated_lines", "n_dup_lines * 100 > 60 * n_lines"),
    Rule("repeated_words", "n_repeat_words * 100 > 40 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("capitals", r"2 * length(regexp_replace(text, '[^\\p{Lu}]+', '')) > length(regexp_replace(text, '[^\\p{L}]+', ''))"),
    Rule("shouting", "length(text) - length(replace(text, '!', '')) > n_words / 5"),
    Rule("few_letters", r"2 * length(regexp_replace(text, '[^\\p{L}]+', '')) < word_chars"),
)


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first included; each word counts once."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(_bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = _bind(
            ranked,
            lambda s: F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    return _bind(words, of)


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` (null: empty) with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, SEPARATORS)) > 0)
    one = only(docs, "doc_id", "text").withColumn("text", F.coalesce(text, F.lit("")))
    one = one.withColumns({"words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "lines": lines})
    return one.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(text, SEPARATORS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejections per second, measured one by one on a sample of ``docs`` (by hash of the id and text)."""
    n = docs.count()
    if not n:
        return list(rules)
    share = min(1.0, sample / n)
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    part = staged(base_counts(picked), "sample")

    def measured(predicate: str) -> tuple[float, int]:
        began = time.perf_counter()
        got = part.agg(F.count_if(F.expr(predicate)).alias("n")).first().n
        return time.perf_counter() - began, got

    idle = min(measured("n_words < 0")[0] for _ in range(2))
    seen = {r.name: measured(r.rejects) for r in rules}
    return sorted(rules, key=lambda r: (-seen[r.name][1] / max(seen[r.name][0] - idle, 1e-3), r.name))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id``, the base counts, ``base_failed, kept, failed_rule`` for every row.

    ``base_failed``: under 50 words, or over half of them in repeated 3-word windows. ``kept`` is false then, else true
    if no rule rejects; ``failed_rule`` is the first that did. Null and empty texts have zero counts and fail the base.
    Repeated rows and null ids are judged like any other; an empty table gives no rows; extra columns are ignored.
    """
    docs = only(docs, "doc_id", "text")
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered(docs, rules)):
        verdict = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(verdict)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    one = base_counts(docs).withColumn("base_failed", failed)
    one = one.withColumn("failed_rule", F.when(~F.col("base_failed"), verdict))
    return one.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"), "failed_rule")


def _duckdb(rule: Rule) -> str:
    return rule.rejects.replace("\\\\", "\\").replace("+', '')", "+', '', 'g')").replace("n_words / 5", "n_words / 5.0")


ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, p, ws[p] || chr(31) || ws[p + 1] || chr(31) || ws[p + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM c)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
k AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY 1),
b AS (SELECT c.doc_id, text, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN k USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"({_duckdb(r)})" for r in RULES)}) AS kept FROM f
"""
