"""Requirements from job texts: vocabulary keywords, recognition of known documents, and their composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.functions.bloom import filter_of, may_hold
from veriloom.sources.staging import broadcast_if, staged

PROBE, LEAST_PROBE = 200, 40
SNIPPET = 60
BLOCK = 4
#: Characters of a key inside of a word, at most half of the shortest probe.
WINDOW = 20
#: Share of the texts that tells how rare a key is.
SAMPLE = 0.01


def candidate_names(skill: DataFrame) -> DataFrame:
    """``skill, place, candidate, display_name, category``: the name first, then the aliases in order; empty ones left out."""
    every = F.concat(F.array("name"), X.list_or_empty(F.col("aliases")))
    one = skill.select(F.col("name").alias("skill"), "display_name", "category", F.posexplode(every).alias("place", "candidate"))
    return one.withColumn("candidate", F.lower("candidate")).where("candidate <> ''")


def requirement_category(category):
    return F.when(category.isin("technical", "tool", "language"), "technology").otherwise("capability")


def signs(c):
    """Distinct characters besides ``[a-z0-9]``, of a lower-cased text."""
    return F.array_distinct(F.array_remove(F.split(F.regexp_replace(c, "[a-z0-9]+", ""), ""), ""))


def posted(names: DataFrame, texts: DataFrame) -> DataFrame:
    """``names(skill, place, candidate)`` with ``key``: each under its rarest term, or its rarest sign if it has no terms.

    How rare a key is comes from a sample of ``texts(text)``, then from the names themselves; whichever key is taken, a
    text that holds the name holds the key, so the choice changes the work and never the result.
    """
    own = X.tokens(F.col("candidate"))
    one = names.select("skill", "place", "candidate", F.explode(F.when(F.size(own) > 0, own).otherwise(signs(F.col("candidate")))).alias("key"))
    in_names = one.groupBy("key").agg(F.count("*").alias("n_names"))
    low = F.lower("text")
    some = texts.sample(SAMPLE, seed=1).select(F.explode(F.array_union(X.tokens(low), signs(low))).alias("key"))
    in_texts = some.groupBy("key").agg(F.count("*").alias("n_texts"))
    rare = one.join(in_names, "key").join(in_texts, "key", "left")
    return rare.groupBy("skill", "place", "candidate").agg(F.min_by("key", F.struct(F.coalesce("n_texts", F.lit(0)), "n_names", "key")).alias("key"))


def keyword_requirements(texts: DataFrame, skill: DataFrame) -> DataFrame:
    """``texts(job_id, text)`` -> one requirement per vocabulary skill that the text names literally:
    ``job_id, raw, skill_query, importance, category``.

    A hit stands free of ``[a-z0-9]`` on both sides. The vocabulary is an index of names by one key each (see
    :func:`posted`). The scan of the texts keeps only keys that a Bloom filter of the index may hold, so what meets the
    index, in memory where it is proven small and by a shuffle otherwise, is keys and never the corpus. A text with
    candidates is then read once, and all of its names are decided there. ``raw`` is the text around the first hit of the
    first candidate found.
    """
    one = texts.select("job_id", "text", F.lower("text").alias("low")).where("text is not null")
    index = staged(posted(candidate_names(skill).select("skill", "place", "candidate").distinct(), texts), "names")
    bloom = filter_of(index.select(F.xxhash64("key").alias("h")))
    by_sign = index.agg(F.coalesce(F.bool_or(~F.col("key").rlike("[a-z0-9]")), F.lit(False))).scalar()
    keys = F.concat(X.terms(F.col("low")), F.when(by_sign, signs(F.col("low"))).otherwise(F.array().cast("array<string>")))
    keys = one.select("job_id", F.explode(keys).alias("key")).where(may_hold(bloom, F.xxhash64("key")))
    met = keys.join(broadcast_if(index, 200), "key").groupBy("job_id").agg(F.collect_set(F.struct("skill", "place", "candidate")).alias("names"))

    def decided(n):
        """A name with its first hit, 0 for none; what the text doesn't contain at all is not searched for."""
        hit = F.regexp_instr(F.col("low"), F.concat(F.lit(r"(?<![a-z0-9])\Q"), n["candidate"], F.lit(r"\E(?![a-z0-9])")))
        return F.struct(n["skill"].alias("skill"), n["place"].alias("place"), F.length(n["candidate"]).alias("len"), F.when(F.contains(F.col("low"), n["candidate"]), hit).otherwise(0).alias("at"))

    start = F.greatest(F.lit(1), F.col("h.at") - SNIPPET)
    cut = F.substring("text", start, F.col("h.at") + F.col("h.len") + SNIPPET - start)
    found = one.join(met, "job_id").select("job_id", "text", F.explode(F.transform("names", decided)).alias("h")).where("h.at > 0")
    found = found.groupBy("job_id", F.col("h.skill").alias("skill")).agg(F.min(F.struct("h.place", cut.alias("cut"))).alias("h"))
    label = skill.select(F.col("name").alias("skill"), "display_name", F.col("category").alias("skill_category"))
    raw = F.coalesce(X.present(F.regexp_replace("h.cut", r"(?U)^\s+|\s+$", "")), X.present("display_name"), F.col("skill"))
    return found.join(label, "skill").select("job_id", raw.alias("raw"), F.col("skill").alias("skill_query"), F.lit("preferred").alias("importance"), requirement_category(F.col("skill_category")).alias("category"))


# The characters of the Unicode property White_Space.
WHITE = "[\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def flat(c):
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, " "))


def let(value, body):
    """``body(value)``, the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined(h, by: int):
    """Hashes of each element with the one ``by`` places on."""
    return let(h, lambda x: let(F.greatest(F.size(x) - by, F.lit(0)), lambda n: F.zip_with(F.slice(x, 1, n), F.slice(x, by + 1, n), lambda a, b: F.xxhash64(a, b))))


def _grams(w):
    """Hashes of all runs of four words."""
    return _joined(_joined(w, 1), 2)


def _windows(w):
    """Hashes of all runs of ``WINDOW`` characters inside of words."""
    long = F.filter(w, lambda x: F.length(x) >= WINDOW)
    return F.flatten(F.transform(long, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - WINDOW + 1), lambda i: F.xxhash64(F.substring(x, i, F.lit(WINDOW)), F.lit("window")))))


def _word(x):
    return F.xxhash64(x, F.lit("word"))


def probe_keys(cached: DataFrame, pasted: DataFrame) -> DataFrame:
    """``cached(item_id, text)`` -> ``item_id, probe, kind, h``: the start of each text, with the key it is looked up by.

    The inner words of a probe are whole words wherever it stands. A probe of six words or more has its rarest run of
    four inner words, one of three to five its rarest inner word, and one of fewer the first ``WINDOW`` characters of its
    longest word: it has more than 40 characters, so one of two words has 20. How rare words are comes from a sample of
    ``pasted(text)``; any choice gives the same result.
    """
    probes = cached.select("item_id", F.substring(flat(F.col("text")), 1, PROBE).alias("probe")).where(F.length("probe") > LEAST_PROBE).withColumn("w", F.split("probe", " "))
    counts = pasted.sample(SAMPLE, seed=1).select(F.explode(F.split("text", WHITE)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    inner = probes.where(F.size("w") >= 3).select("item_id", "probe", F.posexplode(F.slice("w", 2, F.size("w") - 2)).alias("at", "word")).join(counts, "word", "left")
    inner = inner.groupBy("item_id", "probe").agg(F.array_sort(F.collect_list(F.struct("at", "word", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - BLOCK + 1, F.lit(1))), lambda i: F.struct(F.array_min(F.transform(F.slice("w", i, BLOCK), lambda x: x["n"])).alias("n"), i.alias("at")))
    rarest = F.slice(F.transform("w", lambda x: x["word"]), F.array_min(runs)["at"], BLOCK)
    grams = inner.where(F.size("w") >= BLOCK).select("item_id", "probe", F.lit("gram").alias("kind"), F.get(_grams(rarest), F.lit(0)).alias("h"))
    words = inner.where(F.size("w") < BLOCK).select("item_id", "probe", F.lit("word").alias("kind"), _word(F.array_min(F.transform("w", lambda x: F.struct(x["n"], x["at"], x["word"])))["word"]).alias("h"))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))["word"]
    rest = probes.where(F.size("w") < 3).select("item_id", "probe", F.lit("window").alias("kind"), F.get(_windows(F.array(longest)), F.lit(0)).alias("h"))
    return grams.unionByName(words).unionByName(rest)


def same_document(cached: DataFrame, pasted: DataFrame) -> DataFrame:
    """``cached(item_id, text)``, ``pasted(doc_id, text)`` -> pairs where the start of the cached text (200 characters, more
    than 40) stands in the pasted one.

    Every probe is looked up by one key (see :func:`probe_keys`). The scan of the pasted texts tests their keys against a
    Bloom filter of the probes', so only keys with a hit leave it; where they meet a probe, it is looked for in the text.
    Keys of words and characters are only made where some probe needs them.
    """
    keyed = staged(probe_keys(cached, pasted), "probes")
    needs = keyed.agg(F.coalesce(F.bool_or(F.col("kind") == "word"), F.lit(False)).alias("word"), F.coalesce(F.bool_or(F.col("kind") == "window"), F.lit(False)).alias("window"))
    w = F.split("text", WHITE)  # white space at the ends makes empty words there, which no key has
    none = F.array().cast("array<long>")
    keys = [_grams(w), F.when(needs.select("word").scalar(), F.transform(w, _word)).otherwise(none), F.when(needs.select("window").scalar(), _windows(w)).otherwise(none)]
    hits = pasted.select("doc_id", F.explode(F.concat(*keys)).alias("h")).where(may_hold(filter_of(keyed), F.col("h")))
    met = hits.join(broadcast_if(keyed, 1000).select("item_id", "probe", "h"), "h").select("doc_id", "item_id", "probe").distinct()
    met = staged(met, "probe-hits")
    both = pasted.select("doc_id", "text").join(broadcast_if(met, 1000), "doc_id")
    return both.where(F.contains(flat(F.col("text")), F.col("probe"))).select("item_id", "doc_id").distinct()


def compose(texts: DataFrame, skill: DataFrame, cached: DataFrame, curated: DataFrame) -> DataFrame:
    """Requirements of each text with their ``mode``: the curated list of a recognized document, else keywords.

    ``texts(job_id, text)``, ``cached(item_id, text)``, ``curated(item_id, raw, skill_query, importance, category)``. Of
    several recognized documents the smallest item counts.
    """
    hit = same_document(cached, texts.select(F.col("job_id").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("job_id")).agg(F.min("item_id").alias("item_id"))
    known = hit.join(curated, "item_id").select("job_id", "raw", "skill_query", "importance", "category", F.lit("cached_manual").alias("mode"))
    rest = keyword_requirements(texts.join(hit, "job_id", "left_anti"), skill).withColumn("mode", F.lit("heuristic_keyword"))
    return known.unionByName(rest)


def freshness(texts: DataFrame, cached: DataFrame, valid: DataFrame) -> DataFrame:
    """``job_id, status``: missing (no list), invalid, stale (the list is for another text) or ok.

    ``texts(job_id, item_id, text)`` name the list they rely on, ``valid(item_id, ok)`` says which lists are valid, and a
    list without a cached text is taken to belong.
    """
    hit = same_document(cached, texts.select(F.col("job_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("job_id"), "item_id", F.lit(True).alias("same"))
    has = cached.select("item_id", F.lit(True).alias("has_text")).distinct()
    one = texts.select("job_id", "item_id").join(valid, "item_id", "left").join(has, "item_id", "left").join(hit, ["job_id", "item_id"], "left")
    status = F.when(F.col("ok").isNull(), "missing").when(~F.col("ok"), "invalid").when(F.col("has_text") & F.col("same").isNull(), "stale").otherwise("ok")
    return one.select("job_id", "item_id", status.alias("status"))
