"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are never shuffled to be counted. Tasks turn a batch of texts into word hashes with numpy, and prefix polynomials
over these give the fingerprint of every n-gram; equal fingerprints of a batch are added up, and the shuffle aggregates
``fingerprint, count, check, pointer``: the check is an independent hash, the pointer names a text that holds an
occurrence. One scan counts words, one pairs of frequent words, and one phrases of three and four words whose pairs are
all frequent, by filters of bounded size (what passes one wrongly is counted and drops out, so it changes no result).

Only frequent fingerprints are looked at as text. Where all occurrences have one check, the text at the pointer is
scanned for the fingerprint and its words are the phrase. Where checks differ, several phrases share the fingerprint:
their occurrences are counted again by their text. Scores, cuts and containment are joins of the frequent phrases.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.base import in_arrow, maybe_broadcast, only, staged
from veriloom.llm.decontam import _filter, _positions
from veriloom.llm.textnum import _LOWER, PIECE, U, _bounds, _hash, _pieces, _powers, mix, strings

LEAST = 30
LONGEST = 4
SCALE = 2_000_000
#: A phrase goes where a longer one holds it and has this share (in per cent) of its occurrences.
ABSORBED = 80
TOP = 2000
#: Parts of a language in the first step of its ranking.
SALTS = 64
#: Words at a time whose n-grams are hashed.
STEP = 1 << 17
#: Bits of a fingerprint; tests take few, so that phrases collide.
BITS = 64

DELIMITER = np.zeros(256, bool)
DELIMITER[[*b".,;:!?", *range(10, 14)]] = True
SEPARATOR = DELIMITER.copy()
SEPARATOR[[9, 32]] = True
_OTHER = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


class Words(NamedTuple):
    """The words of some texts: two independent hashes each, the number of its piece and of its text, and where it stands."""

    h: np.ndarray
    g: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _second(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Word hashes of another byte table."""
    power, inverse = _powers(len(a) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(a) + 1, U)
        np.cumsum(_OTHER[a] * power[: len(a)], dtype=U, out=c[1:])
        return mix((c[ends] - c[starts]) * inverse[starts] ^ (ends - starts).astype(U))


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def words_of(texts: Iterable[bytes]) -> Iterator[Words]:
    """Words of lower-cased texts, some texts at a time, a long one by itself; ``start`` and ``end`` count from the
    beginning of the text. No piece goes on from one to the next."""

    def read(raw: bytes, first: int, begins: list[int], base: int, pieces: int) -> tuple[Words, int]:
        a, s, e = _bounds(raw, SEPARATOR)
        cum = np.cumsum(DELIMITER[a], dtype=np.int32)
        which = np.searchsorted(begins, s, side="right") - 1
        off = base - np.array(begins, np.int64)[which]
        piece = pieces + cum[s] if len(s) else np.zeros(0, np.int64)
        return Words(_hash(a, s, e), _second(a, s, e), piece.astype(np.int32), (first + which).astype(np.int32), s + off, e + off), pieces + int(cum[-1] if len(cum) else 0)

    group: list[bytes] = []
    begins: list[int] = []
    size = number = 0
    for raw in texts:
        if group and size + len(raw) > PIECE:
            yield read(b"\n".join(group), number - len(group), begins, 0, 0)[0]
            group, begins, size = [], [], 0
        if len(raw) > PIECE:
            parts, at, pieces = [], 0, 0
            for part in _pieces(raw, SEPARATOR):
                one, pieces = read(part, number, [0], at, pieces)
                parts.append(one)
                at += len(part)
            yield Words(*(np.concatenate(c) for c in zip(*parts)))
        else:
            group.append(raw)
            begins.append(size)
            size += len(raw) + 1
        number += 1
    if group:
        yield read(b"\n".join(group), number - len(group), begins, 0, 0)[0]


def _poly(w: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of ``n`` values, from prefix sums."""
    power, inverse = _powers(len(w) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(w) + 1, U)
        np.cumsum(w * power[: len(w)], dtype=U, out=c[1:])
        return (c[n:] - c[:-n]) * inverse[: len(w) - n + 1]


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def grams(w: Words, seeds: np.ndarray, n: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the first word, fingerprint, check) of all n-grams within pieces, some at a time; ``seeds`` by text,
    ``width`` in bits."""
    for lo in range(0, len(w.h) - n + 1, STEP):
        hi = min(len(w.h), lo + STEP + n - 1)
        i = np.flatnonzero(w.piece[lo : hi - n + 1] == w.piece[lo + n - 1 : hi])
        with np.errstate(over="ignore"):
            seed = seeds[w.text[lo + i]] + U(n * 0x9E3779B97F4A7C15 % (1 << 64))
            yield lo + i, mix(_poly(w.h[lo:hi], n)[i] + seed) >> U(64 - width), mix(_poly(w.g[lo:hi], n)[i] ^ seed)


#: What goes with a count: so many bits of the check, above so many of the pointer.
CHECK_BITS, POINTER_BITS = 24, 40
#: Rows of n-grams that a task holds before it passes them on.
HELD_ROWS = 1 << 18
COUNTED = "lang string, key long, n long, seen long"


def _put(keys: list, counts: list, seen: list, lang: list[str], totals: list[int]) -> pa.RecordBatch:
    zeros = [0] * len(lang)
    cols = [np.concatenate([*c, np.array(t, np.int64)]) for c, t in ((keys, zeros), (counts, totals), (seen, zeros))]
    langs = pa.concat_arrays([pa.nulls(len(cols[0]) - len(lang), pa.string()), pa.array(lang, pa.string())])
    return pa.RecordBatch.from_arrays([langs, *(pa.array(c, pa.int64()) for c in cols)], ["lang", "key", "n", "seen"])


def _counted(sizes: tuple[int, ...], width: int, below: int = 0, bits: int = 0, sent: Broadcast | None = None):
    """lang, text, ptr -> the distinct n-grams of some texts with their counts; the scan of single words also gives a row
    with the number of words for each language. The filter holds the frequent phrases of ``below`` words: n-grams with
    any other inside are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(sent.value, np.uint8) if sent else None
        for b in batches:
            langs = b.column(0).to_pylist()
            names = sorted(set(langs))
            of = {x: U(_seed(x)) for x in names}
            seeds, pointer = np.array([of[x] for x in langs], U), b.column(2).to_numpy()
            totals = dict.fromkeys(names, 0)
            keys, counts, seen, rows = [], [], [], 0
            for w in words_of(_lowered(t) for t in strings(b.column(1))):
                if not sent:
                    for text, n in zip(*np.unique(w.text, return_counts=True)):
                        totals[langs[text]] += int(n)
                held = np.zeros(len(w.h), bool)  # where a frequent phrase begins
                if sent:
                    for i, key, _ in grams(w, seeds, below, width):
                        held[i] = _in(on, bits, key)
                for n in sizes:
                    for i, key, check in grams(w, seeds, n, width):
                        if sent:
                            chosen = np.logical_and.reduce([held[i + j] for j in range(n - below + 1)])
                            i, key, check = i[chosen], key[chosen], check[chosen]
                        # by check, too: phrases that share a fingerprint reach the shuffle as two rows
                        order = np.lexsort((check, key))
                        k, c = key[order], check[order]
                        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else order
                        n_of = np.diff(np.r_[first, len(k)])
                        at = i[order[first]]
                        by_place = np.argsort(at)  # rows of one text stay together and compress
                        keys.append(k[first][by_place].view(np.int64))
                        counts.append(n_of[by_place])
                        seen.append(((c[first] >> U(64 - CHECK_BITS)).astype(np.int64) << POINTER_BITS | pointer[w.text[at]])[by_place])
                        rows += len(first)
                if rows > HELD_ROWS:
                    yield _put(keys, counts, seen, [], [])
                    keys, counts, seen, rows = [], [], [], 0
            yield _put(keys, counts, seen, *((list(totals), list(totals.values())) if not sent else ([], [])))

    return run


def _in(on: np.ndarray, bits: int, key: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key."""
    bit = _positions(key, bits)
    return ((on[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).all(axis=0)


def _count(texts: DataFrame, sizes: tuple[int, ...], least: int, width: int, label: str, below: int = 0, known: DataFrame | None = None) -> DataFrame:
    """``lang (null but for totals), key, n, same (one check), ptr`` of fingerprints found ``least`` times or more. ``known``
    has the frequent ones of ``below`` words."""
    bits, sent = 0, None
    if known is not None:
        bits, bloom = _filter(known.select(F.col("key").alias("h")))
        sent = texts.sparkSession.sparkContext.broadcast(bloom)
    rows = texts.transform(in_arrow, _counted(sizes, width, below, bits, sent), COUNTED)
    one = rows.groupBy("lang", "key").agg(F.sum("n").alias("n"), F.min("seen").alias("low"), F.max("seen").alias("high"))
    one = one.where(F.col("lang").isNotNull() | (F.col("n") >= least))
    same = F.shiftrightunsigned("low", POINTER_BITS) == F.shiftrightunsigned("high", POINTER_BITS)
    return staged(one.select("lang", "key", "n", same.alias("same"), F.col("low").bitwiseAND((1 << POINTER_BITS) - 1).alias("ptr")), label)


def _phrase(raw: bytes, w: Words, i: int, n: int) -> str:
    return b" ".join(raw[w.start[i + j] : w.end[i + j]] for j in range(n)).decode("utf-8", "surrogatepass")


PHRASES = "key long, lang string, size long, phrase string"


def _found(width: int):
    """lang, text, keys -> the words of each wanted fingerprint that the text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for lang, text, wanted in zip(strings(b.column(0)), strings(b.column(1)), b.column(2)):
                raw, keys = _lowered(text), np.unique(wanted.values.to_numpy().view(U))
                w = next(words_of([raw]))
                for n in range(1, LONGEST + 1):
                    for i, key, _ in grams(w, np.array([_seed(lang)], U), n, width):
                        here, first = np.unique(key, return_index=True)
                        for k, x in zip(*(c[np.isin(here, keys, assume_unique=True)] for c in (here, first))):
                            out.append((int(k.view(np.int64)), lang, n, _phrase(raw, w, int(i[x]), n)))
            yield _table(out, [pa.int64(), pa.string(), pa.int64(), pa.string()], ["key", "lang", "size", "phrase"])

    return run


def _table(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _again(width: int, bits: int, sent: Broadcast):
    """lang, text -> key, lang, size, phrase, n of all occurrences whose fingerprint is in the filter, by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            seen: Counter = Counter()
            for lang, text in zip(strings(b.column(0)), strings(b.column(1))):
                raw = _lowered(text)
                w = next(words_of([raw]))
                for n in range(1, LONGEST + 1):
                    for i, key, _ in grams(w, np.array([_seed(lang)], U), n, width):
                        hit = _in(on, bits, key)
                        for k, x in zip(key[hit].view(np.int64).tolist(), i[hit].tolist()):
                            seen[k, lang, n, _phrase(raw, w, x, n)] += 1
            rows = [(*k, n) for k, n in seen.items()]
            yield _table(rows, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], ["key", "lang", "size", "phrase", "n"])

    return run


def frequent_phrases(documents: DataFrame, least: int = LEAST, width: int = BITS) -> tuple[DataFrame, DataFrame]:
    """``(lang, size, phrase, f)`` of all phrases of one to four words that a language has ``least`` times or more, and
    ``(lang, n)``, its number of words. See :func:`collocations` for words and languages."""
    spark = documents.sparkSession
    texts = only(documents, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("ptr", F.shiftrightunsigned(F.xxhash64("lang", "text"), 64 - POINTER_BITS))
    short = _count(texts, (1,), least, width, "words")
    totals = short.where("lang is not null").select("lang", "n")
    words = short.where("lang is null").drop("lang")
    pairs = _count(texts, (2,), least, width, "pairs", 1, words).drop("lang")
    every = words.unionByName(pairs).unionByName(_count(texts, (3, 4), least, width, "long-phrases", 2, pairs).drop("lang"))

    clear = every.where("same")
    wanted = clear.groupBy(F.col("ptr").alias("at")).agg(F.collect_list("key").alias("keys"))
    held = texts.join(maybe_broadcast(staged(clear.select("ptr").distinct(), "pointers"), 16), "ptr", "left_semi").distinct()
    found = held.join(wanted, F.col("ptr") == F.col("at")).select("lang", "text", "keys").transform(in_arrow, _found(width), PHRASES)
    found = found.dropDuplicates(["key"]).join(clear.select(F.col("key").alias("k"), "n"), F.col("key") == F.col("k"))
    phrases = found.select("lang", "size", "phrase", F.col("n").alias("f"))

    shared = every.where("not same").select("key")
    if shared.head(1):  # several phrases have one fingerprint: count them by their text
        bits, bloom = _filter(shared.select(F.col("key").alias("h")))
        rows = texts.select("lang", "text").transform(in_arrow, _again(width, bits, spark.sparkContext.broadcast(bloom)), PHRASES + ", n long")
        rows = rows.join(shared, "key", "left_semi").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        phrases = phrases.unionByName(rows.select("lang", "size", "phrase", "f"))
    return staged(phrases, "phrases"), totals


def _slice(c, start, n):
    return F.array_join(F.slice(c, start, n), " ")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, width: int = BITS) -> DataFrame:
    """``documents(lang, text)`` -> ``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of every language.

    A-Z become lower case; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words.
    A phrase is two to four words within a piece, found ``a`` (``least`` or more) times; ``l`` and ``r`` count its two
    parts at the cut with the lowest ``score``, floor(2000000 a / (l + r)), the earliest among equals; ``n`` counts the
    words of the language. A phrase that a longer candidate holds, with 80 % of its occurrences or more, goes. Ranks go by
    score and ``a``, both descending, then phrase in the order of its bytes. A null lang is ``und``, a null text empty;
    repeated rows count again; an empty table gives no rows; extra columns are ignored.
    """
    f, totals = frequent_phrases(documents, least, width)
    candidates = f.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    parts = maybe_broadcast(f.where(F.col("size") < LONGEST).select(F.col("lang").alias("_lang"), F.col("phrase").alias("part"), "f"), 200, 8 << 20)
    cuts = candidates.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _slice(F.col("w"), F.lit(1), F.col("k")).alias("left"), _slice(F.col("w"), F.col("k") + 1, F.col("size").cast("int") - F.col("k")).alias("right"))
    for side in ("left", "right"):
        count = parts.withColumnsRenamed({"f": side[0], "part": f"_{side}"})
        cuts = cuts.join(count, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col(f"_{side}"))).drop("_lang", f"_{side}")
    exact = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    sub = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size").cast("int") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: _slice(F.col("w"), i, m))))
    inside = candidates.where("size > 2").select("lang", F.explode(F.array_distinct(sub)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * ABSORBED))

    order = (F.desc("b.score"), F.desc("a"), F.asc("phrase"))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # a language's phrases aren't one task's
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score")


def _oracle() -> str:
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gram = " UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM pieces)" for n in range(1, LONGEST + 1))
    cut = f"""SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:size], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)"""
    return rf"""WITH raw AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{low}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
      pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]'), lambda x: x <> '') AS w FROM raw),
      tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
      f AS (SELECT lang, size, phrase, count(*) AS f FROM ({gram}) GROUP BY ALL HAVING count(*) >= {LEAST}),
      cand AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
      cuts AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM ({cut}) c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp),
      best AS (SELECT lang, phrase, a, arg_min(l, o) AS l, arg_min(r, o) AS r, min(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cuts) GROUP BY ALL),
      subs AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM cand WHERE size > 2))),
      longer AS (SELECT lang, phrase, max(a) AS longest FROM subs GROUP BY ALL)
      SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best b LEFT JOIN longer USING (lang, phrase)
        WHERE longest IS NULL OR 100 * longest < {ABSORBED} * a) JOIN tot USING (lang) WHERE rank <= {TOP}"""


ORACLE = _oracle()
