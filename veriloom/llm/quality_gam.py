"""Quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins; cyclic boosting grows one shallow tree after another on each feature in turn (a tree of
three cuts over the bins), with a small step, and sums them into one lookup table per feature. Then the pairs whose
residuals a coarse grid explains best get tables of their own in the same way. A score is the sum of table entries, so
scoring is bin lookups and additions on whole columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.base import fold, in_arrow, only, staged

#: Bounds of the fitted model.
MAX_LABELLED = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, STEP = 150, 60, 0.1
LEAST_IN_LEAF = 5

FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "longest_run", "capitals", "letters", "digits", "symbols", "marks",
    "bars", "exclamations", "line_words", "repeated_lines", "long_words", "distinct_pairs", "white_space", "stops",
)

_LETTER = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[#*$%&<>]+")
_MARKS = re.compile(r"[,;:.]+")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪĮŁŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽА-ЯΑ-Ω]+")
_DIGIT = re.compile(r"[0-9]+")


def features(text: str) -> tuple[float, ...]:
    """The features of a whole text; an empty one has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    chars = len(text)
    counts: dict[str, int] = {}
    run = longest = 1
    last = None
    for w in words:
        if w == last:
            run += 1
        else:
            if run > longest:
                longest = run
            run, last = 1, w
        counts[w] = counts.get(w, 0) + 1
    longest = max(longest, run)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, _LETTER.findall(text)))
    per = 1 / chars
    return (
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values()) / n,
        float(np.log(longest)),
        sum(map(len, _CAPITAL.findall(text))) / max(letters, 1),
        letters * per,
        sum(map(len, _DIGIT.findall(text))) * per,
        sum(map(len, _SYMBOLS.findall(text))) / n,
        len(_MARKS.findall(text)) / n,
        text.count("|") / n,
        text.count("!") / n,
        float(np.log1p(n / max(len(lines), 1))),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(v for w, v in counts.items() if len(w) > 15) / n,
        len(set(zip(words, words[1:]))) / max(n - 1, 1),
        1 - sum(map(len, words)) * per,
        sum(v for w, v in counts.items() if len(w) <= 3) / n,
    )


@dataclass
class Model:
    """Cuts and tables; ``pairs`` holds (feature, feature, cuts, cuts, table)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            z += table[np.searchsorted(cuts, x[:, j], "right")]
        for i, j, a, b, table in self.pairs:
            z += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree that cuts the ordered bins where the loss falls most; ``depth`` 2 gives three cuts."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl, nl = (np.cumsum(v)[:-1] for v in (g, h, n))
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < LEAST_IN_LEAF) | (n.sum() - nl < LEAST_IN_LEAF)] = 0
    k = int(gain.argmax()) + 1
    if gain[k - 1] <= 1e-9:
        return out
    return np.concatenate([_tree(v[0], v[1], v[2], depth - 1) for v in ((g[:k], h[:k], n[:k]), (g[k:], h[k:], n[k:]))])


def _grid(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A shallow tree over two features: one cut of the first, then one of the second on either side."""
    best, out = -1.0, np.zeros(g.shape)
    for flip in (False, True):
        a, b, c = (v.T if flip else v for v in (g, h, n))
        for k in range(1, len(a)):
            parts = [_tree(v[0].sum(0), v[1].sum(0), v[2].sum(0), 1) for v in ((a[:k], b[:k], c[:k]), (a[k:], b[k:], c[k:]))]
            gain = sum((p * v.sum(0) - 0.5 * p * p * (w.sum(0) + 1e-9)).sum() for p, v, w in zip(parts, (a[:k], a[k:]), (b[:k], b[k:])))
            if gain > best:
                table = np.concatenate([np.tile(parts[0], (k, 1)), np.tile(parts[1], (len(a) - k, 1))])
                best, out = gain, table.T if flip else table
    return out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on rows of features and labels 0 or 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [_quantiles(x[:, j], BINS) for j in range(x.shape[1])] if len(x) else [np.zeros(0)] * x.shape[1]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    model = Model(base, cuts, tables, [])
    if len(np.unique(y)) < 2:
        return model
    z = np.full(len(y), base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = gradients()
            m = len(tables[j])
            leaf = STEP * _tree(np.bincount(b, g, m), np.bincount(b, h, m), np.bincount(b, minlength=m))
            tables[j] += leaf
            z += leaf[b]
    coarse = [_quantiles(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cbins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]
    g, h = gradients()
    found = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            m = len(coarse[j]) + 1
            cell, size = cbins[i] * m + cbins[j], (len(coarse[i]) + 1) * m
            found.append((float(_gain(np.bincount(cell, g, size), np.bincount(cell, h, size)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(found, reverse=True)[:PAIRS]]
    grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(chosen, grids):
            g, h = gradients()
            m = table.shape[1]
            cell = cbins[i] * m + cbins[j]
            leaf = STEP * _grid(*(np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h, np.ones(len(g)))))
            table += leaf
            z += leaf[cbins[i], cbins[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in zip(chosen, grids)]
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.array([features(t.as_py() or "") for t in b.column(0)]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], ["x", "quality"])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, limit: int = MAX_LABELLED) -> Model:
    """Train on labelled rows whose ``crc32(doc_id) mod modulus`` is not ``held_out``: about ``limit`` at most, by a hash."""
    known = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).where(fold("doc_id", modulus) != held_out)
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    # at most about ``limit`` rows of 12 bytes, so sending them to every task is bounded
    rows = only(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality")
    rows = staged(rows.transform(in_arrow, _featured, "x array<double>, quality int"), "features").orderBy("x", "quality").toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return train(x, rows["quality"].to_numpy(float))


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, accept: float = 0.7) -> DataFrame:
    """``docs(doc_id, text)``, ``labels(doc_id, quality)`` -> ``doc_id, held_out, score, predicted`` for every row.

    Labels are learned only from rows whose ``crc32(doc_id as text) mod modulus`` is not ``held_out``; a score depends on
    the text alone, and ``predicted`` is 1 at ``accept`` or more. Null and empty texts have zero features and are scored
    so. Without labels of both kinds every text gets the share of ones, smoothed. Null labels are ignored, of repeated
    ones the smallest counts. Repeated rows are each scored, a null doc_id has held_out null; an empty table gives no
    rows; extra columns are ignored.
    """
    model = fit(docs, labels, modulus, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "") for t in b.column(1)]).reshape(-1, len(FEATURES))
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= accept).astype(np.int32))], ["doc_id", "score", "predicted"])

    one = only(docs, "doc_id", "text").transform(in_arrow, run, "doc_id long, score double, predicted int")
    return one.withColumn("held_out", fold("doc_id", modulus) == held_out).select("doc_id", "held_out", "score", "predicted")
