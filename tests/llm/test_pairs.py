"""Near duplicates, decontamination and the pipeline against brute force."""

import random
import re

import corpus_pipeline
import pytest
from veriloom.llm import jaccard as J
from veriloom.llm.components import components
from veriloom.llm.decontam import drop_leaking, leaks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sets_of(rows, k):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def classes(rows, k, t):
    s = sets_of(rows, k)
    low = {i: i for i in s}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(s)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            n = len(s[i] & s[j])
            if n and 100 * n >= t * len(s[i] | s[j]):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i)) for i in ids}


def corpus(seed=5):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "a b"), (5, " \t\n ")]
    for base in range(12):
        text = [r.choice(words) for _ in range(r.choice([8, 15, 40, 120, 300]))]
        for _ in range(r.choice([1, 2, 9])):
            copy = list(text)
            for _ in range(r.choice([0, 1, 2, 6])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    for _ in range(10):
        rows.append((len(rows), " ".join(passage + [r.choice(words) for _ in range(r.choice([3, 6, 20, 60]))])))
    return rows


@pytest.mark.parametrize("k,t", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, k, t):
    monkeypatch.setattr(J, "TILE_BYTES", 600)  # several tiles a bucket
    monkeypatch.setattr(J, "HOT", 2)
    monkeypatch.setattr(J, "HOT_IN_PART", 1)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as key", "2 as h1")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, k, t).collect()}
    assert got == classes(rows, k, t)


def test_tree_loses_no_point():
    import numpy as np

    g = np.random.default_rng(1)
    base = g.poisson(2, (30, J.GROUPS))
    counts = (base.repeat(10, axis=0) + (g.random((300, J.GROUPS)) < 0.1)).astype(np.uint8)
    tree, left = J.Tree(counts), np.ones(300, bool)
    n = counts.sum(axis=1, dtype=np.int64)
    for i in range(0, 300, 7):
        bound = np.minimum(counts, counts[i]).sum(axis=1, dtype=np.int64) >= J._needed(n[i], n, 80)
        want = set(np.flatnonzero(bound & left).tolist())
        assert want == set(tree.search(counts[i], 80).tolist())
        gone = np.array(sorted(want)[:4], np.int64)
        tree.take_out(gone)
        left[gone] = False
    assert not left.all()


@pytest.mark.parametrize("t", [30, 50, 80])
def test_forest_equals_all_pairs_over_sizes(t):
    """Points of 128 to 4,096 groups against the bound on every pair, for thresholds below one half too."""
    import numpy as np

    r = np.random.default_rng(2)
    points, sets = [], []
    for n in (60, 900, 1500, 2500, 5000, 9000, 20000):
        own = r.integers(0, 1 << 63, n, dtype=np.uint64)
        for share in (0.0, 0.05, 0.4, 0.7):
            s = np.unique(np.concatenate([own[int(n * share) :], r.integers(0, 1 << 63, int(n * share / 2), dtype=np.uint64)]))
            sets.append(s)
            points.append(J._unpacked(J._packed(J.grouped(s, J.groups_for(len(s))))))
    comp = np.arange(len(points))
    comp[3] = 0
    want = set()
    for i in range(len(points)):
        for j in range(i):
            g = min(len(points[i]), len(points[j]))
            low = np.minimum(J.folded(points[i], g), J.folded(points[j], g)).sum(dtype=np.int64)
            assert low >= len(np.intersect1d(sets[i], sets[j]))
            if comp[i] != comp[j] and low >= J._needed(len(sets[i]), len(sets[j]), t):
                want.add((j, i))
    got = J.spanning(J.Forest(points), comp, t, every=True)
    assert {(min(p), max(p)) for p in got} == want and len(got) == len(want)
    # the spanning pairs connect the same points
    some = J.spanning(J.Forest(points), comp, t, every=False)
    assert {(min(p), max(p)) for p in some} <= want

    def parts(pairs):
        low = {i: int(c) for i, c in enumerate(comp)}
        for _ in low:
            for a, b in pairs:
                m = min(low[a], low[b])
                low = {i: m if c in (low[a], low[b]) else c for i, c in low.items()}
        return low

    assert parts(some) == parts(want) and len(some) == len(set(comp.tolist())) - len(set(parts(want).values()))


def test_long_documents_equal_brute_force(spark):
    r = random.Random(9)
    words = ["w%d" % i for i in range(3000)]
    rows = []
    for n in (2000, 6000, 20000):
        text = [r.choice(words) for _ in range(n)]
        for changes in (0, n // 100, n // 50, n // 12):
            copy = list(text)
            for _ in range(changes):
                copy[r.randrange(n)] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(text[: n // 2])))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    want = classes(rows, 5, 80)
    assert got == want and len({c for _, c in want.values()}) == 9


def test_links_of_a_crowd_come_from_the_trees(spark, monkeypatch):
    """60 close copies fill more than one leaf: without the trees' answers no link is left."""
    r = random.Random(4)
    text = [r.choice("abcdefghij") + str(r.randrange(900)) for _ in range(200)]
    rows = []
    for i in range(60):
        copy = list(text)
        copy[r.randrange(200)] = "other%d" % i
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.component_id for x in J.jaccard_components(df, 5, 80).collect()} == {0}
    searched = J._searched

    def blind(t, every):
        run = searched(t, every)

        def without(batches):
            from veriloom.llm import jaccard

            tree, jaccard.Tree.search = jaccard.Tree.search, lambda self, q, t: self.order[:0]
            try:
                yield from run(batches)
            finally:
                jaccard.Tree.search = tree

        return without

    monkeypatch.setattr(J, "_searched", blind)
    got = {x.component_id for x in J.jaccard_components(df, 5, 80).collect()}
    assert len(got) > 30


def test_an_id_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "z " * 70)]
    got = {(x.doc_id, x.component_id) for x in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_empty_repeated_and_null_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert J.jaccard_components(empty, 3, 90).collect() == []
    rows = [(7, "a b c d"), (7, "a b c d"), (9, "a b c d"), (None, "a b c d"), (8, None)]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == [(-1, -1), (7, 7), (7, 7), (8, 8), (9, 7)]


def test_keep_one_per_group(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(5, text, "en", "s", 1), (3, text + " more", "en", "s", 1), (9, "other words here", "en", "s", 1), (4, None, "en", "s", 0)]
    kept = J.keep_one_per_group(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 9] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(links.limit(0)).collect() == []


def test_leaks_with_substitutions(spark):
    r = random.Random(3)
    words = ["v%d" % i for i in range(2000)]
    item = [r.choice(words) for _ in range(40)]
    short = ["only", "four", "little", "words"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, " ".join(short))], "item_id long, text string")

    def noise(n):
        return [r.choice(words) for _ in range(n)]

    changed = list(item)
    for i in (4, 12, 21, 30):
        changed[i] = "other"
    docs = {
        10: noise(300) + item + noise(50), 11: noise(20) + changed + noise(20), 12: item[10:30] + noise(90), 13: noise(500), 14: noise(80) + item[:8] + noise(80),
        15: [w.upper() + "," for w in item], 16: None, 17: [], 18: noise(3) + short + noise(3), 19: noise(9) + ["only", "four"],
    }
    df = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in docs.items()], "doc_id long, text string").selectExpr("*", "0 as item_id")
    assert {(x.doc_id, x.item_id) for x in leaks(df, bench).collect()} == {(10, 1), (11, 1), (12, 1), (15, 1), (18, 4)}
    assert sorted(x.doc_id for x in drop_leaking(df, bench).collect()) == [13, 14, 16, 17, 19]
    assert leaks(df, bench.limit(0)).collect() == [] and leaks(df.limit(0), bench).collect() == []


def found_leaks(spark, items, docs):
    """(document, item) -> words equal; both are lists of lists of words."""
    d, i = (spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(rows)], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id")))
    return {(r.doc_id, r.item_id): r.n_equal for r in leaks(d, i).collect()}


def brute_leaks(items, docs):
    """Every item against every document at every place, and every stretch of it."""
    want = {}
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            n = len(item)
            least = min(13, -(-4 * n // 5))
            for at in range(1 - n, len(words)):
                same = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(item)]
                if sum(same) < least:
                    continue
                if n <= 16:
                    best = sum(same)
                else:
                    c = [0]
                    for x in same:
                        c.append(c[-1] + x)
                    lo, hi = max(0, -at), min(n, len(words) - at)
                    best = max((c[y] - c[x] for x in range(lo, hi) for y in range(x + 13, hi + 1) if c[y] - c[x] >= 13 and 5 * (c[y] - c[x]) >= 4 * (y - x)), default=0)
                if best >= least:
                    want[d, i] = max(best, want.get((d, i), 0))
    return want


def test_short_items_equal_brute_force(spark):
    import itertools
    import math

    r = random.Random(11)
    items = [["what"] + [f"i{n}x{j}" for j in range(n - 1)] for n in range(2, 17)]  # the same first word in all
    items += [["lone"], ["what", "else"], ["what", "is", "what", "is", "what"], list("abcabcabcabc")]
    docs = []
    for item in items:
        n = len(item)
        differ = n - math.ceil(n * 4 / 5 - 1e-9)
        choices = [c for k in range(differ + 2) for c in itertools.combinations(range(n), min(k, n))]
        for c in choices if len(choices) < 60 else r.sample(choices, 60):
            docs.append(["noise"] * r.choice([0, 3]) + ["other" if i in c else w for i, w in enumerate(item)] + ["noise"] * r.choice([0, 2]))
        docs += [item[k:] for k in range(1, differ + 2)] + [item[: n - k] for k in range(1, differ + 2)]
    assert found_leaks(spark, items, docs) == brute_leaks(items, docs)


def test_leaks_equal_brute_force_both_ways(spark):
    """Items of 1 to 60 words, cut and with words replaced, on both sides of the rule: nothing lost, nothing more."""
    r = random.Random(21)
    items, docs = [], []
    for n in range(1, 61):
        item = [f"n{n}w{j}" for j in range(n)]
        items.append(item)
        for share in (0.1, 0.2, 0.25):
            lo, hi = sorted(r.sample(range(n + 1), 2)) if n > 16 and r.random() < 0.5 else (0, n)
            part = [w if r.random() > share else "other" for w in item[lo:hi]]
            docs.append(["noise"] * r.choice([0, 4]) + part + ["noise"] * r.choice([0, 4]))
    want = brute_leaks(items, docs)
    got = found_leaks(spark, items, docs)
    assert got.keys() == want.keys() and all(13 <= n <= want[k] or n == want[k] for k, n in got.items()) and 60 < len(want) < len(docs) - 20


def test_masks_miss_no_leak():
    """The best sum (+1 equal, -4 different) of any string of at least 13 equal words that no mask hits stays below 0, by
    dynamic programming over the last words: a stretch of 80 % has a sum of 0 or more."""
    from veriloom.llm.decontam import LEAST_WORDS, MASKS, WEIGHT

    bits = max(map(len, MASKS)) - 1
    wanted = [int(m, 2) for m in MASKS]
    best = {(0, 0): 0}
    while True:
        new = dict(best)
        for (state, n), value in best.items():
            for b in (0, 1):
                seen = state << 1 | b
                if not any(seen & w == w for w in wanted):
                    at = (seen & (1 << bits) - 1, min(LEAST_WORDS, n + b))
                    new[at] = max(new.get(at, -10**9), value + (1 if b else -WEIGHT))
        if new == best:
            break
        best = new
        assert max(best.values()) < 100
    assert max(v for (_, n), v in best.items() if n == LEAST_WORDS) < 0


def test_any_stretch_of_a_long_item_counts(spark):
    import numpy as np
    from veriloom.llm.decontam import stretch

    item = [f"i{j}" for j in range(59)]
    three = item[10:22] + ["x", "y", "z"] + item[25:37]
    fifth = [w if j % 5 else "x" for j, w in enumerate(item[20:50])]
    got = found_leaks(spark, [item], [["noise"] * 9 + three + ["noise"] * 40, ["noise"] * 40 + fifth + ["noise"] * 40, ["noise"] * 40 + item[3:15] + ["noise"] * 40])
    assert got == {(0, 0): 24, (1, 0): 24}
    # against all stretches by brute force
    r = random.Random(5)
    hashes = np.arange(59, dtype=np.uint64)
    for _ in range(300):
        same = [r.random() < 0.75 for _ in item]
        words = hashes.copy()
        words[[not x for x in same]] += np.uint64(1000)
        best = max((sum(same[i:j]) for i in range(59) for j in range(i + 13, 60) if 5 * sum(same[i:j]) >= 4 * (j - i)), default=0)
        found = stretch(hashes, words, 0)
        assert (found is not None) == (best >= 13)
        if found:
            begin, size, n = found
            assert n == sum(same[begin : begin + size]) >= 13 and 5 * n >= 4 * size


def test_leaks_find_every_whole_item(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(x.doc_id, x.item_id) for x in leaks(docs, bench).collect()}
    items = [(b.item_id, b.text) for b in bench.collect()]
    want = {(x.doc_id, i) for x in docs.collect() for i, t in items if t in x.text}
    assert want and want <= got


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
            before, out = docs, spark.createDataFrame(out.collect(), out.schema)
            assert out.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        docs = out
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3] and sizes[5] >= sizes[4]


@pytest.mark.parametrize("span", [1, 2, 3])
def test_texts_that_repeat_themselves(spark, span):
    """Documents of 20,000 words of few kinds against items of 14 to 1,000 such words, and the differences by both ways."""
    import time

    import numpy as np
    from veriloom.llm import decontam as X

    some = " ".join("abc"[i % span] for i in range(20_000))
    docs = spark.createDataFrame([(i, some + f" x{i}") for i in range(3)] + [(9, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(n, " ".join("abc"[i % span] for i in range(n))) for n in (14, 60, 1000)], "item_id long, text string")
    leaks(docs, items.where("item_id = 14")).collect()
    began = time.perf_counter()
    got = sorted(tuple(r) for r in leaks(docs, items).collect())
    assert got == [(d, n, 0, 0, n, n) for d in range(3) for n in (14, 60, 1000)] and time.perf_counter() - began < 20
    g = np.random.default_rng(span)
    p, a = np.unique(g.integers(0, 5000, 300)), np.unique(g.integers(0, 700, 90))
    direct, X.DIRECT = X.differences(p, a), 0
    try:
        assert np.array_equal(X.differences(p, a), direct)
    finally:
        X.DIRECT = 1 << 22


def kept_by_brute_force(docs, items):
    """doc_id -> text of documents that are the smallest of their class and hold no benchmark passage, word by word."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    group = classes(rows, 5, 80)
    rows = [(i, t) for i, t in rows if group[i][1] == i]
    bench = [re.findall(r"[^\W_]+", t.lower()) for _, t in items]
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        whole = any(len(b) and any(w[j : j + len(b)] == b for j in range(len(w) - len(b) + 1)) for b in bench)
        if not whole:
            out[i] = t
    return out


def test_run_of_the_pipeline(spark, tmp_path):
    """``run`` over the smallest tables with rows that repeat and are null, and over empty ones."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, "one lone short text", "en", "s", 19), (900_003, "one lone short text", "en", "s", 19)], docs.schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tamed = corpus_pipeline.toxicity(spark, docs, d)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = kept_by_brute_force(tamed, items)
    ids = {r.doc_id for r in got}
    assert {900_001, 900_002, 900_003} <= ids and ids - {900_001, 900_002, 900_003} <= set(want)
    # what goes beyond whole items holds one with some words replaced
    beyond = set(want) - ids
    assert beyond == {r.doc_id for r in leaks(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()} & set(want) and len(beyond) < len(want) / 10
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for i, p in pieces.items():
        copies = 2 if i == 900_003 else 1
        assert sum(n for _, n, _ in p) == copies * p[0][2]
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
