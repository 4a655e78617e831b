"""Toxicity by maximum-scoring segments over token log-odds, with extreme-value calibration.

Training counts, for each word, the labelled toxic and other documents that hold it. A word's log-odds use a Dirichlet
prior whose mean comes from the word's beginnings (six letters, then four), so inflected and unseen forms borrow from
their stem. A drift is subtracted, which makes the expected score of clean text negative; then all maximal segments are
found in linear time, and the Gumbel law of the best segment of clean texts (lambda and K) turns segment scores into
expected numbers of chance hits, comparable between short and long texts. A logistic curve, fitted on labelled documents
whose words were not counted, maps them to a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.base import fold, in_arrow, only, staged

#: Bound of the fitted model: labelled documents read for it.
MAX_LABELLED = 40_000
#: Words that a task counts before it hands them on.
COUNTED = 100_000
WORD = re.compile(r"[^\W\d_]+")
STEMS = (6, 4)
PRIOR = 2.0
DRIFT = 0.7
KEEP = 0.35
SIGNIFICANT = 0.05


@dataclass
class Model:
    """Scores of words and of beginnings, as broadcast tables; any other word scores ``-drift``."""

    tables: Broadcast
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 0.1
    weights: np.ndarray = field(default_factory=lambda: np.array([-2.0, 1.0, 0.0]))

    def word(self, w: str) -> float:
        words, stems = self.tables.value
        s = words.get(w)
        if s is None:
            for n, table in zip(STEMS, stems):
                if len(w) >= n and (s := table.get(w[:n])) is not None:
                    return s - self.drift
            return -self.drift
        return s - self.drift

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Scores(dict):
    """Word scores as they come up, of bounded number."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, w: str) -> float:
        if len(self) > 100_000:
            self.clear()
        s = self[w] = self.model.word(w)
        return s


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), in linear time.

    Only words with a positive score can begin or extend one, so the scan goes from one such word to the next with
    running sums. A candidate joins the nearest earlier one that starts lower, if it also ends higher.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # begin, end, sum before, sum after, index of the nearest lower start
    for p in positive.tolist():
        begin, end, low, high = p, p + 1, float(total[p]), float(total[p + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((begin, end, low, high, j))
                break
            begin, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, h - l) for b, e, l, h, _ in stack]


def _features(model: Model, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float, int]:
    """Of the best segment, and of all significant ones, how far they pass what chance gives; and their number."""
    if not segments:
        return 0.0, 0.0, 0
    base = np.log(model.k * max(n, 1))
    bits = np.array([model.lam * s - base for _, _, s in segments])
    real = bits[bits > -np.log(SIGNIFICANT)]
    return float(np.clip(bits.max(), 0, 30)), float(np.log1p(real.sum())), len(real)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) -> (word, documents by label, occurrences in the others)."""
    by = Counter(), Counter()
    runs: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        words = list(by[0].keys() | by[1].keys())
        columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (*by, runs))]
        for c in (*by, runs):
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["w", "n0", "n1", "r0"])

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            words = WORD.findall((text.as_py() or "").lower())
            by[label].update(set(words))
            if not label:
                runs.update(words)
            if len(by[0]) + len(by[1]) > COUNTED:
                yield out()
    yield out()


def labelled(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, limit: int = MAX_LABELLED) -> DataFrame:
    """``text, toxic, part`` of the training rows: at most about ``limit``, chosen by a hash of doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold("doc_id", modulus) != held_out)
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(4))
    # the chosen labels are at most about MAX_LABELLED rows of 12 bytes, so sending them to every task is bounded
    return docs.join(F.broadcast(known), "doc_id").select("text", "toxic", part.cast("int").alias("part"))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> Model:
    """Train on labelled documents whose ``crc32(doc_id) mod modulus`` is not ``held_out``."""
    rows = staged(labelled(only(docs, "doc_id", "text"), only(labels, "doc_id", "toxic"), modulus, held_out), "labelled")
    count = {r.toxic: r.n for r in rows.where("part > 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = count.get(0, 0), count.get(1, 0)
    send = docs.sparkSession.sparkContext.broadcast
    if not n0 or not n1:
        return Model(send(({}, tuple({} for _ in STEMS))), weights=np.array([-3.0 if not n1 else 3.0, 0.0, 0.0]))
    seen = rows.where("part > 0").select("text", "toxic").transform(in_arrow, _counted, "w string, n0 long, n1 long, r0 long")
    # documents count as if there were as many of either label
    seen = seen.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("r0").alias("r0"))
    seen = staged(seen.withColumns({"c0": F.col("n0") * (n1 / n0), "c1": F.col("n1").cast("double")}), "words")
    mean, prior = F.lit(0.5), F.lit(PRIOR)
    named = seen
    tables: list[dict[str, float]] = []
    for n in sorted(STEMS):
        stem = F.when(F.length("w") >= n, F.substring("w", 1, n))
        if n == min(STEMS):
            groups = seen.withColumn("g", stem).where("g is not null").withColumn("up", F.lit(0.5))
        else:
            groups = named.withColumn("g", stem).where("g is not null").withColumn("up", F.coalesce("mean", F.lit(0.5)))
        groups = groups.groupBy("g").agg(((F.sum("c1") + 4 * F.first("up")) / (F.sum("c0") + F.sum("c1") + 4)).alias("share"))
        groups = staged(groups, "stems")
        odds = F.log(F.col("share") / (1 - F.col("share")))
        tables.append({r.g: r.s for r in groups.select("g", odds.alias("s")).where(F.abs("s") > KEEP).collect()})
        parent = groups.select(F.col("g").alias("stem"), F.col("share"))
        named = named.drop("stem").join(parent, stem == F.col("stem"), "left")
        named = named.withColumn("mean", F.coalesce("share", "mean") if "mean" in named.columns else F.coalesce("share", F.lit(0.5))).drop("share", "stem")
    s = F.log((F.col("c1") + prior * F.col("mean")) / (F.col("c0") + prior * (1 - F.col("mean"))))
    named = staged(named.withColumn("s", s), "scores")
    kept = named.where(((F.abs("s") > KEEP) | (F.abs(F.col("mean") - 0.5) > 0.05)) & (F.col("n0") + F.col("n1") > 1))
    # words of bounded numbers of documents come to the driver, and go to each executor once
    model = Model(send(({r.w: r.s for r in kept.select("w", "s").collect()}, tuple(reversed(tables)))))
    # the scores of running words of clean documents, in steps of a tenth, give lambda
    law = named.groupBy(F.round("s", 1).alias("s")).agg(F.sum("r0").alias("r")).where("r > 0").toPandas()
    x, p = law["s"].to_numpy() - model.drift, law["r"].to_numpy() / law["r"].sum()
    low, high = 1e-6, 1.0
    while (p * np.exp(high * x)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * x)).sum() < 1 else (low, mid)
    model.lam = min(low, 4.0)
    # K and the logistic curve come from documents whose words were not counted
    held = rows.where("part = 0").select("text", "toxic").transform(in_arrow, _best(model), "n long, best double, toxic int").toPandas()
    clean = held[held.toxic == 0]
    if len(clean):
        model.k = float(max(1e-6, len(clean) / max(1.0, (clean.n * np.exp(-model.lam * clean.best)).sum())))
    found = rows.where("part = 0").select("text", "toxic").transform(in_arrow, _trained(model), "f1 double, f2 double, toxic int").toPandas()
    if found.toxic.nunique() == 2:
        model.weights = logistic(found[["f1", "f2"]].to_numpy(), found.toxic.to_numpy(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a logistic curve with an unpenalised intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.eye(a.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + penalty, a.T @ (y - q) - penalty @ w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scanned(scores: Scores, texts) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    for text in texts:
        words = WORD.findall((text.as_py() or "").lower())
        yield len(words), maximal_segments(np.fromiter(map(scores.__getitem__, words), float, len(words)))


def _best(model: Model):
    def run(batches):
        scores = Scores(model)
        for b in batches:
            got = [(n, max((s for *_, s in seg), default=0.0)) for n, seg in _scanned(scores, b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64()), b.column(1)], ["n", "best", "toxic"])

    return run


def _trained(model: Model):
    def run(batches):
        scores = Scores(model)
        for b in batches:
            got = [_features(model, seg, n) for n, seg in _scanned(scores, b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.float64()), b.column(1)], ["f1", "f2", "toxic"])

    return run


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for b in batches:
            got, passages = [], []
            for n, seg in _scanned(scores, b.column(1)):
                got.append(_features(model, seg, n))
                base = np.log(model.k * max(n, 1))
                real = [(x, y, round(s, 4)) for x, y, s in seg if model.lam * s - base > -np.log(SIGNIFICANT)]
                passages.append([{"first_word": x, "end_word": y, "score": s} for x, y, s in real])
            p = model.probability(np.array([x[:2] for x in got]).reshape(-1, 2))
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(passages, kind)], ["doc_id", "score", "predicted", "passages"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """``docs(doc_id, text)``, ``labels(doc_id, toxic)`` -> ``doc_id, held_out, score, predicted, passages`` for every row.

    Labels are learned only from rows whose ``crc32(doc_id as text) mod modulus`` is not ``held_out``; a score depends on
    the text alone. A null or empty text has no segment and gets the base rate of such texts. Without labels of both
    kinds every text gets the same score on the side of the only kind (none at all: not toxic). Null or repeated labels:
    nulls are ignored, the larger counts. Repeated rows are each scored, an empty table gives no rows, a null doc_id is
    returned as such (held_out null); extra columns are ignored.
    """
    model = fit(docs, labels, modulus, held_out)
    one = only(docs, "doc_id", "text").transform(
        in_arrow, _scored(model), "doc_id long, score double, predicted int, passages array<struct<first_word:long,end_word:long,score:double>>"
    )
    return one.withColumn("held_out", fold("doc_id", modulus) == held_out).select("doc_id", "held_out", "score", "predicted", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic; null and empty texts stay."""
    model = fit(docs, labels)
    names = docs.columns
    at = names.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for b in batches:
            got = [_features(model, seg, n) for n, seg in _scanned(scores, b.column(at))]
            p = model.probability(np.array([x[:2] for x in got]).reshape(-1, 2))
            yield b.filter(pa.array((p < 0.5) | np.array([not x.as_py() for x in b.column(at)], bool)))

    return docs.transform(in_arrow, kept, docs.schema)
