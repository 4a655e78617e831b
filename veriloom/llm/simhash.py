"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints at a distance of at most 2 r share a point at most r from both, so every distinct fingerprint emits all
variants within r flipped bits and meets its neighbours there; who shares a variant is, by the triangle inequality, a
link, which is checked nevertheless. A variant row is never written: fingerprints are shuffled by the leading bits of
their variants (a fingerprint goes to each prefix that one of its variants has), and the variants of a prefix are made,
sorted and met where they arrive. Prefixes with more variants than a task should hold, as those of a crowd of near
copies, are split by a linear hash of the variant, which spreads the variants of any one fingerprint evenly. Of a crowd
only a spanning forest of links leaves a task, so no group's pairs are listed; its links join the fingerprints of all
prefixes into components.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.base import in_arrow, only, staged
from veriloom.llm.components import components
from veriloom.llm.textnum import _LOWER, SPACE, U, _pieces, strings

SEED = 42
#: Variants that one group should hold; groups are prefixes, and parts of prefixes that have more.
GROUP_VARIANTS = 1 << 21
#: Groups that one task should have.
TASK_GROUPS = 8
#: Variants made at a time before those of another part are left out.
BLOCK_VARIANTS = 1 << 21
MOST_PARTS = 1 << 20

# ---- fingerprints


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of all runs of ``k`` words, joined by blanks."""
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))  # one past the blank
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[k - 1 :])], U)


def _votes(h: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, the lowest first."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, k: int) -> int:
    """The fingerprint of a text; a long one is read in pieces that share ``k - 1`` words."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    votes, n, last = np.zeros(64, np.int64), 0, []
    for piece in _pieces(raw, SPACE):
        words = last + piece.split()
        if len(words) >= k:
            h = _hashes(words, k)
            votes, n, last = votes + _votes(h), n + len(h), words[len(words) - k + 1 :]
        else:
            last = words
    if not n and last:
        h = _hashes(last, len(last))
        votes, n = _votes(h), 1
    return sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist())


def fingerprints(documents: DataFrame, k: int = 4) -> DataFrame:
    """``doc_id, f``: the fingerprint of every row's text, as a signed long.

    Words are what stands between ``[\\x20\\x09-\\x0D]``, with A-Z in lower case; shingles are runs of ``k`` words, repeats
    included, and fewer words are one shingle. A bit is 1 if more than half of the shingles' XXH64 (seed 42) have it. A
    null text or one without words has the fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.fromiter((fingerprint(t, k) for t in strings(b.column(1))), U, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "f"])

    one = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return one.transform(in_arrow, run, "doc_id long, f long")


# ---- links


@functools.cache
def _masks(bits: int, most: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``most`` ones."""
    return np.array([sum(1 << i for i in c) for n in range(most + 1) for c in itertools.combinations(range(bits), n)], U)


#: A random linear map of fingerprints: a column for each bit; its hash of a variant is that of the fingerprint, xor that of the mask.
_COLUMNS = np.random.default_rng(64).integers(0, MOST_PARTS, 64, dtype=np.uint64)


def _linear(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), U)
    for i in range(64):
        out ^= np.where((x >> U(i)) & U(1), _COLUMNS[i], U(0))
    return out


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Indices of edges (i, j) that make a spanning forest over ``n`` nodes: each round, every tree takes the edge to
    its smallest neighbour."""
    label, edge, kept = np.arange(n), np.arange(len(i)), []
    while len(edge):
        a, b = label[i[edge]], label[j[edge]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        apart = lo != hi
        edge, lo, hi = edge[apart], lo[apart], hi[apart]
        if not len(edge):
            break
        order = np.lexsort((lo, hi))
        first = order[np.flatnonzero(np.r_[True, np.diff(hi[order]) != 0])]
        kept.append(edge[first])
        parent = np.arange(n)
        parent[hi[first]] = lo[first]
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _met(f: np.ndarray, prefix: int, bits: int, part: int, parts: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of one group, as a spanning forest: they share a variant with this prefix whose
    linear hash belongs to this part."""
    low = 64 - bits
    found, owner = [], []
    away = np.bitwise_count((f >> U(low) if bits else np.zeros(len(f), U)) ^ U(prefix)).astype(int)
    for d in range(half + 1):
        masks = _masks(low, half - d)
        hashes = _linear(masks) & U(parts - 1)
        mine = np.flatnonzero(away == d)
        for at in range(0, len(mine), max(1, BLOCK_VARIANTS // len(masks))):
            some = mine[at : at + max(1, BLOCK_VARIANTS // len(masks))]
            base = (f[some] & U((1 << low) - 1)) | (U(prefix << low) if bits else U(0))
            v, who = base[:, None] ^ masks, np.broadcast_to(some[:, None], (len(some), len(masks)))
            if parts > 1:
                here = ((_linear(base) & U(parts - 1))[:, None] ^ hashes) == U(part)
                v, who = v[here], who[here]
            found.append(v.ravel())
            owner.append(who.ravel().astype(np.int32))
    v, who = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(v, kind="stable")
    v, who = v[order], who[order]
    new = np.r_[True, v[1:] != v[:-1]]
    first = who[np.flatnonzero(new)][np.cumsum(new) - 1]
    pairs = np.unique((who.astype(np.int64) << 32 | first)[~new])
    i, j = pairs >> 32, pairs & 0xFFFFFFFF
    near = np.bitwise_count(f[i] ^ f[j]) <= 2 * half
    i, j = i[near], j[near]
    kept = forest(i, j, len(f))
    return f[i[kept]], f[j[kept]]


def _groups(bits: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            f = np.concatenate(held) if held else np.zeros(0, U)
            held.clear()
            if len(f) > 1:
                a, b = _met(f, key[0], bits, key[1], key[2], half)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            p, part, parts, f = (b.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero((p[1:] != p[:-1]) | (part[1:] != part[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(p)]):
                if key != (now := (int(p[s]), int(part[s]), int(parts[s]))):
                    yield from flush()
                    key = now
                held.append(f[s:e].view(U).copy())
        yield from flush()

    return run


def _prefix(f: Column, bits: int) -> Column:
    return F.shiftrightunsigned(f, 64 - bits) if bits else F.lit(0).cast("long")


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """``distinct(f)``, a staged table of distinct fingerprints -> ``a, b``: links of at most ``radius`` differing bits that
    connect all fingerprints which any such links connect. ``radius`` is even; an empty table gives no links."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius is split into two equal halves, so it has to be even")
    half = radius // 2
    each = len(_masks(64, half))
    groups = -(-distinct.count() * each // GROUP_VARIANTS)
    bits = min(62, max(0, groups - 1).bit_length())
    tasks = max(groups // TASK_GROUPS, distinct.sparkSession.sparkContext.defaultParallelism)  # few bytes make many variants
    flips = F.array(*[F.lit(int(m)).cast("long") for m in _masks(bits, half)])
    sent = distinct.select("f", F.explode(F.transform(flips, lambda m: _prefix(F.col("f"), bits).bitwiseXOR(m))).alias("p"))
    # how many variants a prefix gets from a fingerprint depends on how far its own prefix is away
    away = F.bit_count(_prefix(F.col("f"), bits).bitwiseXOR(F.col("p")))
    made = F.element_at(F.array(*[F.lit(len(_masks(64 - bits, half - d))) for d in range(half + 1)]), away + 1)
    sizes = sent.groupBy("p").agg(F.sum(made.cast("long")).alias("variants"))
    parts = F.least(F.lit(MOST_PARTS), F.pow(2, F.ceil(F.log2(F.col("variants") / GROUP_VARIANTS)))).cast("long")
    sizes = sizes.where(F.col("variants") > GROUP_VARIANTS).select("p", parts.alias("parts"))
    one = sent.join(sizes, "p", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    one = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = one.select("p", "part", "parts", "f").repartition(tasks, "p", "part").sortWithinPartitions("p", "part")
    return dealt.transform(in_arrow, _groups(bits, half), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """``documents(doc_id, text)`` -> ``doc_id, fingerprint, component_id``, one row each.

    ``fingerprint`` has 16 hexadecimal digits (see :func:`fingerprints`); documents link where theirs differ in at most
    ``radius`` bits, equal ones included, and ``component_id`` is the smallest doc_id that links reach, itself included.
    Texts that are null, empty or white space have the fingerprint zero, which links like any other. Rows with equal ids
    are rows of their own; a null id takes part, but is no one's smallest (it is null where a component has no other). An
    empty table gives no rows; extra columns are ignored.
    """
    prints = staged(fingerprints(documents, k), "fingerprints")
    distinct = staged(prints.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    named = components(links(distinct.select("f"), radius)).select(F.col("node").alias("f"), "component")
    classes = distinct.join(named, "f", "left").select("f", "least", F.coalesce("component", "f").alias("component"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select(F.col("f").alias("_f"), "component_id")
    one = prints.join(classes, F.col("f") == F.col("_f"))
    return one.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
