"""Benchmark decontamination by spaced-seed hashing with substitution-tolerant verification.

Fixed masks select some positions of a short window of words and ignore the others, so a window is found again where an
ignored word was replaced. The seeds of the benchmark are a table. Documents are read once: a Bloom filter of the seeds,
of bounded size, goes to every task, and only documents with a seed in it are written with their hits, as word hashes.
Spark joins hits with seeds by hash, all places of one hash in a document or item as one row, so texts that repeat
themselves make no more rows than others. The alignments are the differences of the places; those of a document and an
item are verified together, over the words around them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.base import in_arrow, maybe_broadcast, only, staged, without
from veriloom.llm.textnum import PUNCT, U, mix, strings, word_hashes

#: Fixed masks; 1 is a compared word, 0 an ignored one. Every stretch of 13 equal words or more of which 80 % are equal
#: holds a window in which one of the masks compares equal words only (a test proves it).
MASKS = ("11101011", "110100111", "1011001101", "111111")
#: Bits of the Bloom filter: so many a seed, within these bounds (the larger is 32 MB).
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 512, 20, 28
SLICE = 15
LEAST_WORDS = 13
IDENTITY = 0.8
#: What a difference weighs against an equal word at that share.
WEIGHT = round(IDENTITY / (1 - IDENTITY))
#: Items of so many words may differ in ``SHORT - LEAST_WORDS`` words at most; their masks survive every such choice.
SHORT = 16


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.full(n, len(mask) * 1000003, U)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                h = h * U(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(h)


def _needed(n: int) -> int:
    """Words of an item of ``n`` that must be equal: 13, or 80 % (of a shorter one), in whole numbers."""
    return min(LEAST_WORDS, -(-4 * n // 5))


def _short_masks(n: int) -> list[tuple[int, str]]:
    """(first word, mask) for items of ``n`` words: the words in groups, two more than may differ, and a mask for every
    choice of differing groups. Whichever words differ, or lie beyond the document, some mask compares none of them."""
    differ = n - _needed(n)
    groups = [g for g in np.array_split(np.arange(n), differ + 2 if differ else 1) if len(g)]
    out = []
    for left in itertools.combinations(range(len(groups)), differ):
        ones = np.concatenate([g for i, g in enumerate(groups) if i not in left])
        mask = np.full(ones[-1] - ones[0] + 1, "0")
        mask[ones - ones[0]] = "1"
        out.append((int(ones[0]), "".join(mask)))
    return out


def _words(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    return word_hashes(((x or "").lower() for x in texts), PUNCT, lower=False)


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each seed in the filter, by row."""
    return np.stack([x & U((1 << bits) - 1) for x in (h, h >> U(32), mix(h ^ U(0x5851F42D4C957F2D)))]).astype(np.int64)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, text -> item (a number of its own), item_id, n, words."""
    item = TaskContext.get().partitionId() << 36
    for b in batches:
        words = list(_words(strings(b.column(1))))
        numbers = range(item, item + len(words))
        item += len(words)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), b.column(0), pa.array(map(len, words), pa.int64()), pa.array([w.tobytes() for w in words], pa.binary())], ["item", "item_id", "n", "words"])


_PLACES = pa.list_(pa.int64())


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, words -> h, item, at: the seeds of an item and all places where their first word stands in it."""
    for b in batches:
        rows: dict[tuple[int, int], list[int]] = {}
        for number, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = np.frombuffer(raw, U)
            for first, mask in _short_masks(len(words)) if len(words) <= SHORT else [(None, m) for m in MASKS]:
                found = _seeds(words, mask)
                places = np.arange(len(found)) if first is None else np.array([first])
                for h, at in zip(found[places].view(np.int64).tolist(), places.tolist()):
                    rows.setdefault((h, number), []).append(at)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.int64()), pa.array([k[1] for k in rows], pa.int64()), pa.array(list(rows.values()), _PLACES)], ["h", "item", "at"])


def _filter(seeds: DataFrame) -> tuple[int, bytes]:
    """(bits, Bloom filter of the seeds). Tasks make slices of 4 KB; the driver puts at most 32 MB of them together."""
    bits = min(MOST_BITS, max(LEAST_BITS, (seeds.count() * BITS_PER_SEED).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_positions(b.column(0).to_numpy().view(U), bits).ravel())], ["bit"])

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                part = np.zeros(1 << SLICE, bool)
                part[x.values.to_numpy()] = True
                out.append(np.packbits(part, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["slice", "part"])

    placed_bits = seeds.select("h").transform(in_arrow, placed, "bit long").distinct()
    slices = placed_bits.groupBy(F.shiftright("bit", SLICE).alias("slice")).agg(F.collect_list(F.col("bit") % (1 << SLICE)).alias("on"))
    whole = bytearray(1 << bits - 3)
    size = 1 << SLICE - 3
    for r in slices.transform(in_arrow, sliced, "slice long, part binary").collect():
        whole[r.slice * size : (r.slice + 1) * size] = r.part
    return bits, bytes(whole)


_HIT = pa.list_(pa.struct([("h", pa.int64()), ("at", _PLACES)]))
SUSPECTS = "row long, doc_id long, n_words long, words binary, hits array<struct<h:long,at:array<long>>>"


def _suspects(masks: list[str], bits: int, sent: Broadcast):
    """Documents with seeds in the filter: their word hashes, and those seeds with the place of their first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(sent.value, np.uint8)
        row = TaskContext.get().partitionId() << 36
        out: list[tuple] = []

        def put(words: list[np.ndarray], ids: list[int | None], row: int) -> None:
            ends = np.cumsum([len(w) for w in words])
            every, text = np.concatenate(words), np.repeat(np.arange(len(words)), [len(w) for w in words])
            found: dict[int, dict[int, list[int]]] = {}
            for mask in masks:
                h = _seeds(every, mask)
                if not len(h):
                    continue
                at = np.flatnonzero(text[: len(h)] == text[len(mask) - 1 :])
                for k in range(3):
                    p = _positions(h[at], bits)[k] if k else (h[at] & U((1 << bits) - 1)).astype(np.int64)
                    at = at[(on[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)]
                for i, x in zip(at.tolist(), h[at].view(np.int64).tolist()):
                    d = int(text[i])
                    found.setdefault(d, {}).setdefault(x, []).append(i - int(ends[d]) + len(words[d]))
            out.extend((row + d, ids[d], len(words[d]), words[d].tobytes(), [{"h": h, "at": at} for h, at in hits.items()]) for d, hits in found.items())

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.binary(), _HIT])], ["row", "doc_id", "n_words", "words", "hits"])

        for b in batches:
            ids, held, first, size = b.column(0).to_pylist(), [], 0, 0
            for w in _words(strings(b.column(1))):
                held.append(w)
                size += len(w)
                if size > 200_000:
                    put(held, ids[first : first + len(held)], row + first)
                    first, held, size = first + len(held), [], 0
                    yield batch_of()
            if held:
                put(held, ids[first:], row + first)
                yield batch_of()
            row += len(ids)

    return run


def stretch(text: np.ndarray, words: np.ndarray, at: int) -> tuple[int, int, int] | None:
    """(first item word, words compared, words equal) of the best stretch of an item's words ``text`` against a document's
    ``words``, of which word ``at`` stands at the item's first, if it is a leak."""
    lo, hi = max(0, -at), min(len(text), len(words) - at)
    if hi <= lo:
        return None
    same = text[lo:hi] == words[at + lo : at + hi]
    n, least = int(same.sum()), _needed(len(text))
    if n < least:
        return None
    if len(text) <= SHORT or n >= WEIGHT * (hi - lo - n):
        return lo, hi - lo, n
    # the stretch with the largest sum, in which a difference weighs as much as IDENTITY allows
    c = np.concatenate([[0], np.cumsum(np.where(same, 1, -WEIGHT))])
    least_before = np.minimum.accumulate(c)
    end = int((c - least_before).argmax())
    begin = int(c[: end + 1].argmin())
    n = int(same[begin:end].sum())
    if n < least:
        # it is too short: of all stretches without a negative sum, the one with the most equal words; for each
        # end that is the earliest begin whose sum is not above the end's
        begins = np.searchsorted(-least_before, -c, "left")
        equal = np.concatenate([[0], np.cumsum(same)])
        end = int((equal - equal[begins]).argmax())
        begin = int(begins[end])
        n = int(equal[end] - equal[begin])
    return (lo + begin, end - begin, n) if n >= least else None


#: Pairs of places above which their differences are counted by a convolution.
DIRECT = 1 << 22


def differences(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """All different ``places - at``, in time near linear in the span of both."""
    if len(places) * len(at) <= DIRECT:
        return np.unique(np.subtract.outer(places, at))
    p, q = np.zeros(int(places.max() - places.min()) + 1), np.zeros(int(at.max() - at.min()) + 1)
    p[places - places.min()] = 1
    q[at.max() - at] = 1  # backwards
    n = 1 << (len(p) + len(q) - 2).bit_length()
    met = np.fft.irfft(np.fft.rfft(p, n) * np.fft.rfft(q, n), n)[: len(p) + len(q) - 1]
    return np.flatnonzero(met > 0.5) + places.min() - at.max()


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, item, places, at -> row, item, and the item's first word in the document."""
    for b in batches:
        rows, items = b.column(0).to_numpy(), b.column(1).to_numpy()
        (p, p_at), (q, q_at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (b.column(2), b.column(3)))
        single = (np.diff(p_at) == 1) & (np.diff(q_at) == 1)  # most hashes stand once on either side
        which, found, size = [np.flatnonzero(single)], [p[p_at[:-1][single]] - q[q_at[:-1][single]]], 0
        for i in [*np.flatnonzero(~single).tolist(), None]:
            if i is not None:
                one = differences(p[p_at[i] : p_at[i + 1]], q[q_at[i] : q_at[i + 1]])
                which.append(np.full(len(one), i))
                found.append(one)
                size += len(one)
            if i is None or size > 1 << 18:
                w = np.concatenate(which)
                yield pa.RecordBatch.from_arrays([pa.array(rows[w]), pa.array(items[w]), pa.array(np.concatenate(found).astype(np.int64))], ["row", "item", "at"])
                which, found, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, doc_id, item, item_id, ats, lo, the document's words from ``lo`` on, the item's words -> the best leak of the
    pair, if any: the most words equal, then the fewest compared, then the first."""
    for b in batches:
        out = []
        for i in range(b.num_rows):
            lo, over, words = b.column(5)[i].as_py(), np.frombuffer(b.column(6)[i].as_py(), U), np.frombuffer(b.column(7)[i].as_py(), U)
            every = ((at, stretch(words, over, at - lo)) for at in b.column(4)[i].values.to_numpy().tolist())
            best = min(((-n, size, at + first, first) for at, got in every if got for first, size, n in [got]), default=None)
            if best:
                out.append((*(b.column(c)[i].as_py() for c in (1, 3)), best[2], best[3], best[1], -best[0]))
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "doc_word", "item_word", "n_compared", "n_equal"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> one row per document and item whose passage it holds:
    ``doc_id, item_id, doc_word, item_word, n_compared, n_equal`` (word positions; the best stretch of the pair).

    Words are runs of letters and digits, lower-cased. A stretch is a leak if at least 13 of its words (or 80 % of a
    shorter item) are equal in place and 80 % of those compared are; every leak is found. Null and empty texts hold
    nothing; an empty benchmark or corpus gives no rows; repeated rows give repeated rows; an item_id with several texts
    is as many items; rows without an id are left out; extra columns are ignored.
    """
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null")
    items = only(benchmark, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long")).where("item_id is not null and text is not null")
    items = staged(items.distinct().transform(in_arrow, _items, "item long, item_id long, n long, words binary").where("n > 0"), "items")
    seeds = staged(items.select("item", "words").transform(in_arrow, _seeded, "h long, item long, at array<long>"), "seeds")
    lengths = [r.n for r in items.select(F.least("n", F.lit(SHORT + 1)).alias("n")).distinct().collect()]
    masks = [*(MASKS if SHORT + 1 in lengths else ()), *(m for n in lengths if n <= SHORT for _, m in _short_masks(n))]
    bits, filled = _filter(seeds)
    sent = docs.sparkSession.sparkContext.broadcast(filled)
    suspects = staged(docs.transform(in_arrow, _suspects(list(dict.fromkeys(masks)), bits, sent), SUSPECTS), "suspects")
    hits = suspects.select("row", F.explode("hits").alias("x")).select("row", "x.h", F.col("x.at").alias("places"))
    small = (seeds.agg(F.sum(F.size("at") * 8 + 64)).first()[0] or 0) <= 32 << 20
    met = hits.join(F.broadcast(seeds) if small else seeds, "h").select("row", "item", "places", "at")
    # at most as many alignments of a document and an item as they have words
    found = met.transform(in_arrow, _aligned, "row long, item long, at long").groupBy("row", "item").agg(F.collect_set("at").alias("ats"))
    size = items.agg(F.sum(F.length("words") + 100)).first()[0] or 0
    found = found.join(F.broadcast(items) if size <= 32 << 20 else items, "item")
    found = found.join(suspects.select("row", "doc_id", "n_words", F.col("words").alias("of")), "row")
    lo, hi = F.greatest(F.array_min("ats"), F.lit(0)), F.least(F.array_max("ats") + F.col("n"), F.col("n_words"))
    found = found.withColumns({"lo": lo, "hi": hi}).where("hi > lo")
    over = F.expr("substring(of, cast(lo * 8 + 1 as int), cast((hi - lo) * 8 as int))")  # only the words that the item lies over
    found = found.select("row", "doc_id", "item", "item_id", "ats", "lo", over.alias("over"), "words")
    return found.transform(in_arrow, _verified, "doc_id long, item_id long, doc_word long, item_word long, n_compared long, n_equal long")


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage (see :func:`leaks`), all columns.

    Rows with a null doc_id or without text stay; of an id with several texts all rows go if one of them leaks; an empty
    benchmark drops nothing; extra columns of any name pass.
    """
    bad = staged(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return without(docs, bad)
