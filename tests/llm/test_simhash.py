"""SimHash near duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from veriloom.llm import simhash as H


def brute_print(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_classes(prints, radius=4):
    low = list(range(len(prints)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts():
    r = random.Random(13)
    words = ["w%d" % i for i in range(300)] + ["É", "ß x", "Ab"]
    rows = [None, "", " \t\r\n ", "one", "ONE", "a b", "a b c", "A B\tc", "a b c d", "a b c d e"]
    for _ in range(15):
        base = [r.choice(words) for _ in range(r.choice([5, 60, 400, 3000]))]
        for _ in range(r.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(" ".join(copy))
    return rows


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP_VARIANTS", 1 << 13)  # many prefixes, several parts each
    rows = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").selectExpr("*", "1 as f", "'x' as p", "2 as component_id")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in H.near_duplicates(df).collect())
    prints = [brute_print(t) for t in rows]
    assert got == [(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(prints, brute_classes(prints)))]


@pytest.mark.parametrize("group", [1 << 12, 1 << 16, 1 << 21])
def test_links_connect_what_is_near(spark, monkeypatch, group):
    """Fingerprints that cluster, chains at exactly the radius, and neighbours just beyond it."""
    monkeypatch.setattr(H, "GROUP_VARIANTS", group)
    r = random.Random(group)
    points = {0, (1 << 64) - 1}
    for _ in range(12):
        p = r.getrandbits(64)
        for _ in range(r.choice([1, 3, 12])):
            points.add(p)
            for bit in r.sample(range(64), r.choice([1, 2, 3, 4, 4, 5])):
                p ^= 1 << bit
    points = sorted(points)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    pairs = {(x.a % (1 << 64), x.b % (1 << 64)) for x in H.links(spark.createDataFrame([(s,) for s in signed], "f long"), 4).collect()}
    assert all(1 <= (a ^ b).bit_count() <= 4 for a, b in pairs)
    at = {p: i for i, p in enumerate(points)}
    low = list(range(len(points)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in pairs:
        x, y = find(at[a]), find(at[b])
        low[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(points))] == brute_classes(points)


def test_a_crowd_leaves_no_pairs():
    """All fingerprints within two bits of one make a forest, not a clique."""
    f = H._masks(64, 2) ^ np.uint64(0x0123456789ABCDEF)
    a, b = H._met(f, 0, 0, 0, 1, 2)
    assert len(a) == len(f) - 1


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert H.near_duplicates(empty).count() == 0
    rows = [(None, "same words stand here twice"), (7, "same words stand here twice"), (7, "same words stand here twice"), (3, None), (None, "a text that is alone, with no neighbour in sight")]
    got = [(r.doc_id or -1, r.component_id) for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert [g for g in got if g[0] == 7] == [(7, 7), (7, 7)] and (3, 3) in got and (-1, 7) in got and (-1, None) in got
    with pytest.raises(ValueError):
        H.links(empty.selectExpr("doc_id as f"), 3)


def test_long_texts_are_read_in_pieces():
    text = " ".join("w%d" % (i * i % 977) for i in range(120_000))
    assert H.fingerprint(text, 4) == brute_print(text)
