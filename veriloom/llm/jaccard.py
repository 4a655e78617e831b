"""Exact n-gram Jaccard join with count-vector R-trees.

Tokens (k-word shingles) are hashed into groups; a document is the point of its group counts. For two
documents the overlap is at most the sum of their coordinate minima, and a box of points bounds it by the minima against
the box's upper corner. R-trees over the points are searched with that bound, and surviving pairs are verified on the
shingle sets themselves.

How the work is spread: documents of equal shingle sets collapse into one class first. Two classes over the threshold
share at least one of each other's first ``n - ceil(t*n) + 1`` shingles in any common order; the order here is by hash,
with frequent shingles last, so a passage that many documents share doesn't bring unrelated documents together. That only
deals classes to buckets, one per shared shingle, and buckets of the same classes are kept once. Within a bucket the
R-trees find the candidates. What candidates connect is walked like a graph, and connected classes leave the trees, so a
bucket of m classes gives at most m - 1 pairs to verify. Where all of them hold, no other pair of the bucket can change a
component. Where one fails, everything that candidates connect is searched once more, as one set, for every pair between
the components that there are by then. So no link between different texts that matters to a component is lost, and n
close copies cost about n verifications.

A bucket whose points take more than ``TILE_BYTES`` (a hub) is first linked to its smallest document, a step linear in
its size; if it still holds several components, it is searched in pairs of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.base import in_arrow, maybe_broadcast, only, staged, without
from veriloom.llm.components import components
from veriloom.llm.textnum import U, mix, shingles, strings, word_hashes

GROUPS = 128
TILE_BYTES = 4 << 20
HOT_IN_PART, HOT, HOT_KEPT = 8, 48, 1 << 20
LEAF = 16


def _ceil_share(n, t: int):
    return -((-n * t) // 100)


def _needed(a, b, t: int):
    """The least overlap with which sets of a and b elements reach the Jaccard threshold of t percent."""
    return -((-(a + b) * t) // (100 + t))


def groups_for(n: int) -> int:
    """How many groups a set of n elements is counted in: a power of two, so points fold onto those of smaller sets. With
    about eight elements a group the counts of unrelated large sets differ by much more than the threshold allows."""
    return max(GROUPS, 1 << max(0, (max(n, 1) - 1) // 8).bit_length())


def grouped(s: np.ndarray, groups: int) -> np.ndarray:
    """Elements by group."""
    return np.bincount((mix(s ^ U(0xA0761D6478BD642F)) >> U(32)).astype(np.int64) % groups, minlength=groups)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The same point in fewer groups."""
    return counts if len(counts) == groups else counts.reshape(-1, groups).sum(axis=0, dtype=np.uint32)


def _packed(counts: np.ndarray) -> bytes:
    """Group counts in a byte each where they fit, else in four; the first byte says which."""
    wide = counts.max(initial=0) > 255
    return (b"\4" if wide else b"\1") + counts.astype("<u4" if wide else "u1").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[0] == 4 else "u1", offset=1)


def _frequent(k: int):
    """Shingles that occur in several documents of a part, with their number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held)) if held else np.zeros(0, U)
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            n = np.diff(np.append(at, len(h)))
            keep = n >= HOT_IN_PART
            return pa.RecordBatch.from_arrays([pa.array(h[at][keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for words in word_hashes(strings(batch.column(0))):
                held.append(shingles(words, k))
                size += len(held[-1])
                if size > 1_000_000:
                    yield counted()
                    held, size = [], 0
        yield counted()

    return run


def _points(k: int, t: int, hot: np.ndarray):
    """row number, doc_id, set size, 128-bit set hash, group counts, and the first shingles in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, n, h1, h2, counts, first = batch.column(0), [], [], [], [], []
            for words in word_hashes(strings(batch.column(1))):
                s = shingles(words, k)
                m = mix(s ^ U(0xA0761D6478BD642F))
                with np.errstate(over="ignore"):
                    n.append(len(s))
                    h1.append(int(m.sum(dtype=U).view(np.int64)))
                    h2.append(int(mix(m).sum(dtype=U).view(np.int64)))
                counts.append(_packed(grouped(s, groups_for(len(s)))))
                p = len(s) - _ceil_share(len(s), t) + 1
                # fewer than t/(100-t) common elements allow no difference at all: such sets only match equal ones
                if len(s) * (100 - t) < t or p <= 0:
                    first.append([])
                    continue
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    is_hot = hot[at] == s
                    order = s[~is_hot][:p]
                    s = order if len(order) == p else np.concatenate([order, s[is_hot][: p - len(order)]])
                first.append(s[:p].view(np.int64))
            rows = pa.array(range(row, row + len(n)), pa.int64())
            row += len(n)
            yield pa.RecordBatch.from_arrays(
                [rows, ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(counts, pa.binary()), pa.array(first, pa.list_(pa.int64()))],
                ["row", "doc_id", "n", "h1", "h2", "counts", "first"],
            )

    return run


def _verified(k: int, t: int):
    """Of pairs with both texts: those at or over the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}  # a few texts stand in many pairs

        def sets(texts: list[str]) -> None:
            if sum(map(len, known)) > 4 << 20:
                known.clear()
            new = list({x: None for x in texts if x not in known})
            known.update(zip(new, (shingles(w, k) for w in word_hashes(new))))

        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 16):
                ta, tb = (batch.column(c).slice(lo, 16).to_pylist() for c in (2, 3))
                sets(ta + tb)
                for i, (x, y) in enumerate(zip(map(known.__getitem__, ta), map(known.__getitem__, tb))):
                    need = _needed(len(x), len(y), t)
                    if min(len(x), len(y)) >= need:
                        small, large = (x, y) if len(x) <= len(y) else (y, x)
                        at = np.searchsorted(large, small)
                        at[at == len(large)] = 0
                        ok[lo + i] = int((large[at] == small).sum()) >= need
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


class Tree:
    """A bulk-loaded R-tree over group counts: points sorted by size and coordinates, leaves of ``LEAF`` points. Points can
    be taken out; boxes without points are skipped."""

    def __init__(self, counts: np.ndarray) -> None:
        spread = np.argsort(-counts.var(axis=0, dtype=np.float32), kind="stable")[:3]
        n = counts.sum(axis=1, dtype=np.int64)
        self.order = np.lexsort((*(counts[:, d] for d in spread), n))
        self.place = np.empty(len(n), np.int64)
        self.place[self.order] = np.arange(len(n))
        self.c, self.n = counts[self.order], n[self.order]
        self.alive = np.ones(len(n), bool)
        #: From the leaves up: upper corners, least and largest set size, points left.
        self.levels = [self._boxes(self.c, self.n, self.n, self.alive.astype(np.int64))]
        while len(self.levels[-1][0]) > LEAF:
            self.levels.append(self._boxes(*self.levels[-1]))

    @staticmethod
    def _boxes(high: np.ndarray, least: np.ndarray, most: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.arange(0, len(high), LEAF)
        return np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.add.reduceat(left, at)

    def take_out(self, points: np.ndarray) -> None:
        at = self.place[points]
        self.alive[at] = False
        for *_, left in self.levels:
            at = at // LEAF
            np.subtract.at(left, at, 1)

    def search(self, q: np.ndarray, t: int) -> np.ndarray:
        """The points left whose summed minima with q reach the threshold."""
        n = int(q.sum(dtype=np.int64))
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most, left = (x[nodes] for x in self.levels[depth])
            ok = (left > 0) & (least * t <= 100 * n) & (100 * most >= n * t)
            ok[ok] = np.minimum(high[ok], q).sum(axis=1, dtype=np.int64) >= _needed(n, np.maximum(least[ok], _ceil_share(n, t)), t)
            nodes = nodes[ok]
            if not len(nodes):
                return nodes
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < (len(self.c) if depth == 0 else len(self.levels[depth - 1][0]))]
        nodes = nodes[self.alive[nodes]]
        return self.order[nodes[np.minimum(self.c[nodes], q).sum(axis=1, dtype=np.int64) >= _needed(n, self.n[nodes], t)]]


class Forest:
    """The R-trees of a bucket, one per number of groups; a point and a tree of more groups meet in the smaller number."""

    def __init__(self, points: list[np.ndarray]) -> None:
        self.points = points
        width = np.array([len(p) for p in points])
        self.widths = np.unique(width)
        self.members = {w: np.flatnonzero(width == w) for w in self.widths.tolist()}
        self.within = np.empty(len(points), np.int64)
        for of in self.members.values():
            self.within[of] = np.arange(len(of))
        self.sizes = {w: (min(n := [int(points[i].sum(dtype=np.int64)) for i in of]), max(n)) for w, of in self.members.items()}
        self.trees: dict[tuple[int, int], Tree] = {}
        self.gone = {w: [np.zeros(0, np.int64)] for w in self.members}

    def _tree(self, width: int, groups: int) -> Tree:
        if (width, groups) not in self.trees:
            tree = self.trees[width, groups] = Tree(np.stack([folded(self.points[i], groups) for i in self.members[width]]))
            tree.take_out(np.concatenate(self.gone[width]))
        return self.trees[width, groups]

    def take_out(self, points: np.ndarray) -> None:
        width = np.array([len(self.points[i]) for i in points])
        for w in np.unique(width).tolist():
            at = self.within[points[width == w]]
            self.gone[w].append(at)
            for (own, _), tree in self.trees.items():
                if own == w:
                    tree.take_out(at)

    def search(self, i: int, t: int) -> np.ndarray:
        q, found = self.points[i], []
        n = int(q.sum(dtype=np.int64))
        for w, of in self.members.items():
            if self.sizes[w][0] * t <= 100 * n and self.sizes[w][1] * 100 >= n * t:
                groups = min(w, len(q))
                found.append(of[self._tree(w, groups).search(folded(q, groups), t)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def spanning(forest: Forest, comp: np.ndarray, t: int, every: bool) -> list[tuple[int, int]]:
    """Pairs of points of different components whose bound reaches the threshold: ``every`` one, or as many as connect
    what such pairs connect. Points that are connected leave the trees, so a group of copies is searched once."""
    same: dict[int, list[int]] = {}
    for i, c in enumerate(comp.tolist()):
        same.setdefault(c, []).append(i)
    out: list[tuple[int, int]] = []
    left = np.ones(len(comp), bool)

    def reach(points: list[int]) -> None:
        left[points] = False
        forest.take_out(np.array(points))

    for start in range(len(comp)):
        if not left[start]:
            continue
        queue = list(same[int(comp[start])])
        reach(queue)
        while queue and left.any():
            i = queue.pop()
            found = forest.search(i, t).tolist()
            if every:
                out.extend((i, j) for j in found)
                continue
            for j in found:
                if left[j]:
                    out.append((i, j))
                    reach(same[int(comp[j])])
                    queue.extend(same[int(comp[j])])
    return out


class _Leaves:
    """Buckets of at most ``LEAF`` documents each: trees of one leaf, all searched at once."""

    def __init__(self) -> None:
        self.number = 0
        self.bucket: list[int] = []
        self.doc: list[int] = []
        self.comp: list[int] = []
        self.points: list[np.ndarray] = []
        self.bytes = 0

    def add(self, table: pa.Table) -> None:
        self.bucket.extend([self.number] * table.num_rows)
        self.number += 1
        self.doc.extend(table.column("doc").to_pylist())
        self.comp.extend(table.column("comp").to_pylist())
        self.points.extend(map(_unpacked, table.column("counts").to_pylist()))
        self.bytes += sum(p.nbytes for p in self.points[-table.num_rows :])

    def pairs(self, t: int, every: bool) -> list[tuple[int, int]]:
        bucket, comp = np.array(self.bucket), np.array(self.comp)
        size = np.array([p.sum(dtype=np.int64) for p in self.points])
        width = np.array([len(p) for p in self.points])
        found = []
        for d in range(1, LEAF):
            i = np.flatnonzero(bucket[d:] == bucket[:-d])
            low, high = np.minimum(size[i], size[i + d]), np.maximum(size[i], size[i + d])
            i = i[(comp[i] != comp[i + d]) & (low * 100 >= high * t)]
            found.append(np.stack([i, i + d]))
        i, j = np.concatenate(found, axis=1)
        groups = np.minimum(width[i], width[j])
        ok = np.zeros(len(i), bool)
        for g in np.unique(groups).tolist():
            which = np.flatnonzero(groups == g)
            for part in np.array_split(which, len(which) * g // (1 << 20) + 1):
                x, y = (np.stack([folded(self.points[k], g) for k in side[part]]) for side in (i, j))
                ok[part] = np.minimum(x, y).sum(axis=1, dtype=np.int64) >= _needed(size[i[part]], size[j[part]], t)
        low_of: dict[tuple[int, int], tuple[int, int]] = {}

        def find(at: tuple[int, int]) -> tuple[int, int]:
            while at in low_of:
                at = low_of[at]
            return at

        out = []
        for x, y in zip(i[ok].tolist(), j[ok].tolist()):
            k = self.bucket[x]
            if not every:
                p, q = find((k, self.comp[x])), find((k, self.comp[y]))
                if p == q:
                    continue
                low_of[max(p, q)] = min(p, q)
            out.append((min(self.doc[x], self.doc[y]), max(self.doc[x], self.doc[y])))
        return out


def _searched(t: int, every: bool):
    """Rows (key, ta, tb, doc, comp, counts), sorted by the first three: pairs of different components within each
    (key, ta, tb) whose bound reaches the threshold (see :func:`spanning`). One such group, of at most two tiles, is held
    at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        leaves = _Leaves()

        def made(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            distinct = list(dict.fromkeys(rows))
            cols = list(zip(*distinct)) if distinct else [[]] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

        def done(last: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal leaves
            if held:
                group = pa.Table.from_batches(held)
                held.clear()
                if group.num_rows > LEAF:
                    ids, comp = group.column("doc").to_pylist(), group.column("comp").to_numpy()
                    forest = Forest([_unpacked(x.as_py()) for x in group.column("counts")])
                    yield made([(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in spanning(forest, comp, t, every)])
                elif group.num_rows > 1:
                    leaves.add(group)
            if leaves.number and (last or leaves.bytes > TILE_BYTES):
                yield made(leaves.pairs(t, every))
                leaves = _Leaves()

        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if (at := tuple(k[:, lo])) != now:
                    yield from done()
                    now = at
                held.append(batch.slice(lo, hi - lo))
        yield from done(last=True)

    return run


def _sparse(k: int):
    """doc_id, text -> the document as a point of 65,536 group counts, kept as the sorted group numbers of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.sort((mix(shingles(w, k) ^ U(0xA0761D6478BD642F)) >> U(48)).astype("<u2")).tobytes() for w in word_hashes(strings(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "g"])

    return run


def _close(t: int):
    """Pairs of such points whose summed minima reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), "<u2") for c in (2, 3))
                (gx, cx), (gy, cy) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
                _, ix, iy = np.intersect1d(gx, gy, assume_unique=True, return_indices=True)
                keep[i] = np.minimum(cx[ix], cy[iy]).sum() >= _needed(len(x), len(y), t)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _check(pairs: DataFrame, docs: DataFrame, k: int, t: int) -> DataFrame:
    """Verify (a, b), distinct: first by finer group counts, much smaller than texts, then on whole texts. Only the
    documents of some pair are read again; where an id has several texts, one that fits is enough."""

    def joined(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(values.select(F.col("doc_id").alias(side), F.col(name).alias(f"{name}_{side}")), side)
        return pairs.select("a", "b", f"{name}_a", f"{name}_b")

    def texts(pairs: DataFrame) -> DataFrame:
        named = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "named")
        return docs.join(maybe_broadcast(named, 16), "doc_id", "left_semi")

    fine = staged(texts(pairs).transform(in_arrow, _sparse(k), "doc_id long, g binary").distinct(), "sparse")
    near = staged(joined(pairs, fine, "g").transform(in_arrow, _close(t), "a long, b long").distinct(), "near")
    return joined(near, texts(near).distinct(), "text").transform(in_arrow, _verified(k, t), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Words are runs of other than ``\\x20\\x09-\\x0D`` with A-Z lower-cased; a document's set is its distinct ``k``-word
    shingles (with fewer words the whole sequence as one; without words, or with a null text, the empty set, which links
    with nothing). Two documents link when 100 * intersection >= ``threshold`` * union. ``component_id`` is the smallest
    doc_id reachable by links, itself included. Repeated rows are each returned; a null doc_id is returned with a null
    component. Extra columns are ignored.
    """
    if not 1 <= threshold <= 100:
        raise ValueError("the threshold is a percentage")
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    seen = docs.select("text").transform(in_arrow, _frequent(k), "h long, n long")
    hot = seen.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    # The list only orders shingles (any order gives the same links), so its size may be bounded: 8 MB.
    rows = hot.orderBy(F.desc("n"), "h").limit(HOT_KEPT).select("h").toPandas()["h"].to_numpy(np.int64)

    schema = "row long, doc_id long, n long, h1 long, h2 long, counts binary, first array<long>"
    points = staged(docs.transform(in_arrow, _points(k, threshold, np.sort(rows.view(U))), schema), "points")
    real = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    copies = points.where(real).groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "row")).alias("x"), F.count("*").alias("c")).where("c > 1")
    copies = maybe_broadcast(staged(copies.select(F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("x.doc_id").alias("rep"), F.col("x.row").alias("of")), "copies"), 48)
    known = points.join(copies, real & (F.col("n") == F.col("cn")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    # one row for each class: rows without a copy, and of each set of copies one row of the smallest document
    usable = known.where(real & (F.size("first") > 0) & (F.col("of").isNull() | (F.col("of") == F.col("row")))).withColumnRenamed("doc_id", "doc")

    entries = usable.select(F.explode("first").alias("key"), "doc", F.col("n").cast("int").alias("n"))
    shared = entries.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    shared = shared.where((F.col("m") > 1) & ((F.col("m") > 2) | (F.col("n0") * 100 >= F.col("n1") * threshold))).select("key")
    met = staged(entries.join(shared, "key"), "met")
    same = [F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    buckets = met.groupBy("key").agg(F.count("*").alias("m"), F.min("doc").alias("low"), F.sum(F.greatest(F.lit(GROUPS), F.expr("n div 4"))).alias("bytes"), *same)
    buckets = staged(buckets.groupBy("x1", "x2", "m", "low").agg(F.min("key").alias("key"), F.max("bytes").alias("bytes")), "buckets")
    counts = usable.select("doc", "counts")

    def search(inside: DataFrame, comp: DataFrame | None, every: bool) -> DataFrame:
        """(a, b), distinct, within the keys of ``inside(key, doc, bytes)``, whose points take ``bytes`` together."""
        if comp is None:
            inside = inside.withColumn("comp", F.col("doc"))
        else:
            inside = inside.join(maybe_broadcast(comp, 24), F.col("doc") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "doc"))
        tiles = F.ceil(F.col("bytes") / TILE_BYTES).cast("int")
        inside = inside.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int"))
        inside = inside.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).where("tiles = 1 or tile <> other")
        work = inside.join(counts, "doc").select("key", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "doc", "comp", "counts")
        work = work.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb", "doc")
        return staged(work.transform(in_arrow, _searched(threshold, every), "a long, b long").distinct(), "found")

    def verified(pairs: DataFrame) -> DataFrame:
        return staged(_check(pairs, docs, k, threshold), "links")

    links, comp = None, None
    hubs = buckets.where(F.col("bytes") > TILE_BYTES).select("key", "bytes", "low")
    todo = buckets.select("key", "bytes")
    if not hubs.isEmpty():
        of = met.join(maybe_broadcast(hubs, 32), "key")
        links = verified(staged(of.where("doc <> low").select(F.col("low").alias("a"), F.col("doc").alias("b")).distinct(), "star"))
        comp = staged(components(links), "components")
        of = of.join(comp, of.doc == comp.node, "left").groupBy("key").agg(F.count_distinct(F.coalesce("component", "doc")).alias("parts"))
        todo = staged(todo.join(of.where("parts = 1"), "key", "left_anti"), "todo")
    found = search(met.join(maybe_broadcast(todo, 24), "key").select("key", "doc", "bytes"), comp, every=False)
    holding = verified(found)
    links = holding if links is None else links.unionByName(holding)
    comp = staged(components(links), "components")
    if not found.join(holding, ["a", "b"], "left_anti").isEmpty():
        # What candidates connect, whether they hold or not: every link lies within such a set. Where one fell into
        # several components, all pairs between those are tried, each once.
        wide = components(links.select("a", "b").unionByName(found)).select(F.col("node").alias("doc"), F.col("component").alias("key"))
        parts = wide.join(comp, wide.doc == comp.node, "left").join(usable.select("doc", F.col("n").alias("size")).dropDuplicates(["doc"]), "doc")
        parts = parts.groupBy("key").agg(F.count_distinct(F.coalesce("component", "doc")).alias("parts"), F.sum(F.greatest(F.lit(GROUPS), F.expr("size div 4"))).alias("bytes"))
        parts = staged(parts.where("parts > 1").select("key", "bytes"), "parts")
        more = search(wide.join(maybe_broadcast(parts, 24), "key").select("key", "doc", "bytes"), comp, every=True)
        more = verified(staged(more.join(found, ["a", "b"], "left_anti"), "rest"))
        comp = staged(components(links.unionByName(more)), "components")

    named = known.withColumn("rep", F.coalesce("rep", "doc_id")).join(maybe_broadcast(comp, 24), F.col("rep") == F.col("node"), "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def keep_one_per_group(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` but for those that another document of their component (the smallest doc_id) stands for.

    Rows with a null doc_id or without words stay. Rows that repeat the smallest doc_id itself stay as they are; an empty
    table stays empty; extra columns of any name pass.
    """
    found = jaccard_components(docs, k, threshold)
    return without(docs, staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone"))
