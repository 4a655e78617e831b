"""Phrase mining against brute force, with colliding fingerprints, and against its SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from veriloom.llm import collocations as C

D = "/root/testdata/sf0.001"


def brute(rows, least, top=2000):
    words, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    found = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    dropped = set()
    for (lang, w), n in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * n >= 80 * f[lang, w[i : i + m]]:
                    dropped.add((lang, w[i : i + m]))
    out = []
    for lang in {x for x, _ in found}:
        mine = []
        for (x, w), a in found.items():
            if x == lang and (x, w) not in dropped:
                score, _, left, right = min((2_000_000 * a // (f[x, w[:k]] + f[x, w[k:]]), k, f[x, w[:k]], f[x, w[k:]]) for k in range(1, len(w)))
                mine.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(mine)[:top])]
    return sorted(out)


def corpus():
    r = random.Random(12)
    words = ["the", "Of", "AND", "Éa", "éa", "x y", "a-b", "q\x1f", "日本", "z" * 40, *("w%d" % i for i in range(12))]
    rows = [(None, None), ("en", ""), ("en", " \t.\n"), (None, "the of the of"), ("und", "the of; the of")]
    for i in range(120):
        n = r.choice([1, 2, 5, 30, 80])
        text = "".join(r.choice(words[: r.choice([3, 8, 22])]) + r.choice([" "] * 8 + ["\t ", ". ", ",", "\n", "\x0b"]) for _ in range(n))
        rows.append((r.choice(["en", "en", "de", None]), text))
    return rows + [("fr", "one very common line of words here")] * 40


def rows_of(df):
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize("width,top", [(64, 2000), (6, 2000), (11, 7)])
def test_phrases_equal_brute_force(spark, width, top):
    """Also where fingerprints have so few bits that many phrases share each."""
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as key", "'x' as phrase", "2 as ptr").repartition(5)
    assert rows_of(C.collocations(df, 5, top, width)) == brute(rows, 5, top)


def test_sql_agrees(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{D}/documents.parquet'")
    assert rows_of(C.collocations(spark.read.parquet(f"{D}/documents.parquet"))) == sorted(db.sql(C.ORACLE).fetchall())


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits in the score, on the expression itself."""
    a, left, right = 9_000_000_000_000_000, 9_000_000_000_000_001, 9_100_000_000_000_003
    e = f"(cast({C.SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)"
    assert spark.sql(f"select {e} from (select {a}L as a, {left}L as l, {right}L as r)").first()[0] == C.SCALE * a // (left + right)


def test_long_texts_keep_their_phrases():
    r = random.Random(1)
    text = "".join(r.choice(["alpha", "beta", "gamma", "delta"]) + r.choice([" ", " ", "\t", ". "]) for _ in range(90_000)).encode()
    assert len(text) > 2 * C.PIECE
    parts = list(C.words_of([b"before. it", text, b"", b"after"]))
    got = [text[s:e] for w in parts for s, e, t in zip(w.start, w.end, w.text) if t == 1]
    assert got == re.findall(rb"[^ \t.]+", text) and {t for w in parts for t in w.text.tolist()} == {0, 1, 3}
    long = next(w for w in parts if 1 in w.text)
    n = sum(len(i) for i, _, _ in C.grams(long, np.zeros(4, np.uint64), 3, 64))
    assert n == sum(max(0, len(p.split()) - 2) for p in text.decode().split("."))


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
