"""The operators on single texts against brute force, round trips and held-out accuracy."""

import gzip
import hashlib
import itertools
import os
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from veriloom.llm import cascade, chat, pii, quality_gam, queries, toxicity, warc
from veriloom.llm.html_main import Page, main_text, templates
from veriloom.llm.packing import Packer, Piece, pack
from veriloom.llm.textnum import shingles, word_hashes

D = "/root/testdata/sf0.001"


def compare(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, D)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.select(cols).collect()), key=key) == sorted(want.project(", ".join(cols)).fetchall(), key=key)


@pytest.mark.parametrize("name", ["op7_rule_cascade", "op10_warc_shards"])
def test_sql(spark, name):
    compare(spark, name)


def test_word_hashes_follow_words():
    long = "word " * 400_000 + "x" * 1_200_000 + " end"
    texts = [None, "", "a b  a\tb\nc", long, "B b", "é É"]
    for text, h in zip(texts, word_hashes(texts)):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert len(shingles(np.array([1, 2], np.uint64), 3)) == 1


# ---- op1


def test_main_text_of_marked_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="home"><header><a>Logo</a></header>
    <nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div><div id="wrap" class="with-sidebar"><main><article><h1>Head &amp; line</h1><p>First
    <b>bold</b> text&nbsp;here<br>next<p>Second &lt;b&gt; x&#233;</p><script>bad()</script><ul><li>one<li>two</ul><form><input value="q">Search</form>
    <div class="share-buttons">Share</div><!-- <p>no</p> --></article><section id="comments"><p>Nice!</p></section></main><aside>Side</aside></div><div class="ad">Buy</div><footer>&copy; me</footer>"""
    rows = [(1, "http://h.example/1", page), (2, "bad url", None), (3, None, ""), (4, "http://h.example/2", "just text"), (5, "http://h.example/3", '<div><p>a<p>b</div><a href="x>y">c</a> <unclosed "'), (1, "http://h.example/1", page)]
    got = [(r.page_id, r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as template")).collect()]
    first = "Head & line First bold text here next Second <b> xé one two"
    assert Counter(got) == Counter([(1, first, len(first))] * 2 + [(2, "", 0), (3, "", 0), (4, "just text", 9), (5, 'a b c <unclosed "', 17)])


def test_templates_go_and_copies_stay(spark):
    body = "<html><body><div><p>Top stories of the day</p><p>Weather: fine</p></div><div><p>{}</p></div></body></html>"
    rows = [(i, f"http://one.example/{i}", body.format(f"Own text number {i}")) for i in range(30)]
    rows += [(100 + i, "http://two.example/", body.format("The same text")) for i in range(30)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own text number {i}" for i in range(30))
    assert all("The same text" in got[100 + i] for i in range(30))
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_shapes_decide_where_wording_varies(spark):
    """No article, no mark, no subtree with the same text twice: only shapes tell the templates."""
    word = lambda *k: hashlib.md5(str(k).encode()).hexdigest()[:6]
    own = lambda i: [" ".join(word(i, p, j) for j in range(30 + (i + p) % 9)) for p in range(2 + i % 4)]
    page = lambda i, paragraphs: (
        f'<body><div class="x1"><p>You have read {i} of our free texts of this month, and may go on {word(i)}</p></div><div class="x2">'
        + "".join(f'<a href="/{word(i, k)}">{word(i, k)} {word(k, i)}</a> ' for k in range(2))
        + '</div><div class="x3">'
        + "".join(f"<p>{t}</p>" for t in paragraphs)
        + f'</div><div class="x4">Page {word(i, "last")} was shown by the house of example, all rights are ours</div></body>'
    )
    rows = [(i, f"http://one.example/{i}", page(i, own(i))) for i in range(40)]
    rows += [(100 + i, f"http://few.example/{i}", page(i, own(i))) for i in range(9)]  # too few pages
    rows += [(200 + i, "http://copies.example/", page(0, own(0))) for i in range(40)]  # one page, many times
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for marks in (True, False):
        got = {r.page_id: r.text for r in main_text(df, marks).collect()}
        for i in range(40):
            assert got[i] == " ".join(own(i)), i
            assert "all rights are ours" in got[200 + i]
        assert all("You have read" in got[100 + i] for i in range(9))
    found = {r.host: r for r in templates(df.selectExpr("*", "parse_url(url, 'HOST') as host")).collect()}
    assert list(found) == ["one.example"] and not found["one.example"].template and found["one.example"].shapes


def test_signs_estimate_similarity():
    """The mean square of summed signs against the mean Jaccard similarity by all pairs."""
    texts = [" ".join(["same"] * 3 + [f"w{j}" for j in range(12)] + [f"v{i}-{j}" for j in range(4)]) for i in range(60)]
    sets = [set(t.split()) for t in texts]
    exact = np.mean([len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]])
    pages = [Page(f"<body><p>{t}</p></body>") for t in texts]
    signs = [p.signs(p.shapes()) for p in pages]
    key = next(iter(signs[0]))
    square = np.mean((np.sum([s[key] for s in signs], axis=0) / 60) ** 2)
    assert abs((square * 60 - 1) / 59 - exact) < 0.25 and exact > 0.55
    one = Page("<body><div><p>" + "a b " * 100_000 + "</p></div></body>")
    assert len(one.signs(one.shapes())) == 4


def test_names_of_authors_are_no_marks():
    article = """<body class="page-with-sidebar"><main><article><div class="entry-header"><h1>Title</h1></div><div class="header"><p>Lead</p></div><h2 id="search-and-replace">Search it</h2><p>One</p>
    <h2 id="header-files">Files</h2><h2 id="comments">Remarks</h2><section id="related-work"><p>Works</p></section><table class="side-by-side menu"><tr><td>Cell</table><div class="notice"><p>Careful</p></div>
    <div class="social-share">Share</div><div class="share-buttons">Share</div></article><section id="comments"><p>A remark that is by far longer than all of the article, and yet only a remark on it, as it is so very long, and longer still.</p></section></main></body>"""
    assert Page(article).main_text(set(), set()) == "Title Lead Search it One Files Remarks Works Cell Careful"
    for name in ("page-with-sidebar", "header-fixed", "post comments-open", "widget"):
        page = f'<body><div class="{name}"><p>All of the text of the page</p></div><div class="related-posts">More</div><div class="cookie-notice">Cookies</div><div id="sidebar">Side</div></body>'
        assert Page(page).main_text(set(), set()) == "All of the text of the page", name


def test_deep_pages():
    assert Page("<div>" * 5000 + "x").main_text(set(), set()) == "x"


def test_broken_markup_takes_linear_time():
    import time

    for part in ('<div class="x', "<a ", "<![CDATA[ <b>", "<!", "</", "<p", "<!-- ", "<script>", "<a b='"):
        for end in ("", ">", "<p>end</p>"):
            began = time.process_time()
            Page(part * (1_000_000 // len(part)) + end).main_text(set(), set())
            assert time.process_time() - began < 10, (part, end)
    assert Page("<p>a<![CDATA[ <b> ]]>c<![CDATA[ d</p>e <!-- f").main_text(set(), set()) == "a <b> ce"
    assert Page("<p>a</p><!-- b <i>").main_text(set(), set()) == "a"


# ---- op2


def unpacked(rows):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    return seqs


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    r = np.random.default_rng(3)
    odd = ["a", "Zq", "é", "ß", "1", "٣", "!", "'s", "'", "_", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "\x1f", "\u2003", "\u200b", "\u3000", "\ufeff", "\r\n", "\x00", "𝔸", "漢字", "<|endoftext|>", "<|endof"]
    texts = ["".join(r.choice(odd, int(r.integers(0, 40)))) for _ in range(3000)]
    texts += [None, "", "a <|endoftext|> b", "x" * 30000, " " * 2_000_000, "\n" * 1_500_000, "y" * 1_100_000 + " z" * 400_000, " \n" * 600_000 + "end", "a\u2003" + "b" * 1500 + "\u2003 c", "!" * 1200 + " d" + " " * 1200 + "<|endoftext|>" + "e" * 1100 + "<|endoftext|> f"]
    more = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    docs = docs.unionByName(more)
    rows = pack(docs, with_ids=True).collect()
    unpacked(rows)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d.doc_id: [*t.encode(d.text or "", add_special_tokens=False).ids, 0] for d in docs.collect()}
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length and r.start == len(got.get(r.doc_id, [])) and r.doc_tokens == len(want[r.doc_id])
        got.setdefault(r.doc_id, []).extend(ids.tolist())
    assert got == want
    assert pack(docs.limit(0)).collect() == []


def test_packing_gives_added_tokens_their_ids(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["say <|endoftext|> now", "<|endoftext|><|endoftext|>x", "<<|endoftext|>> é", "plain", "<|endoftext"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    for rows in (queries.op2_vector_packing(spark, str(tmp_path)).collect(), corpus_pipeline.packing(spark, df, "").collect()):
        whole = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in rows if r.length == r.doc_tokens}
        assert {r.doc_id: r.doc_tokens for r in rows} == {i: n for i, (n, _) in want.items()}
        assert whole and all(want[i] == x for i, x in whole.items())


def test_packer_keeps_all_limits():
    r = np.random.default_rng(2)
    packer, out = Packer((64, 5, 50)), []
    for i in range(400):
        n = int(r.choice([1, 2, 3, 30, 90, 200]))
        out += packer.add(Piece(i, np.arange(n, dtype="<u4"), 0, n))
    out += packer.rest()
    assert sum(len(p.ids) for s in out for p in s) == sum(p.total for p in {p.doc_id: p for s in out for p in s}.values())
    for s in out:
        n = sum(len(p.ids) for p in s)
        assert n <= 64 and len(s) <= 5 and n - len(s) <= 50 and n & (n - 1) == 0


def test_loss_binds_before_tokens(spark):
    """Answers of 20 ids after prompts of 40: 50 loss-bearing ids fill a sequence long before 1,024 ids do."""
    answer, ask = " ".join(["a"] * 19), " ".join(["b"] * 40)
    df = spark.createDataFrame([(i, f"{ask} {answer}", 40) for i in range(90)] + [(90, answer, None), (91, None, 5)], "doc_id long, text string, given long")
    rows = pack(df.coalesce(1), loss_tokens=50, prompt="given").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    loss = [sum(max(0, r.length - max(1, (40 if r.doc_id < 90 else 0) - r.start)) for r in s) for s in by.values()]
    size = [sum(r.length for r in s) for s in by.values()]
    assert sum(r.length for r in rows) == 90 * 60 + 20 + 1 and max(loss) <= 50 and sum(a > 40 and n < 1024 for a, n in zip(loss, size)) > 5
    whole = pack(df.coalesce(1), prompt="given").collect()
    assert len({r.sequence_id for r in whole}) < len(by)


# ---- op3, op6


def test_maximal_segments_equal_definition():
    def slow(x):
        if not len(x):
            return []
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=None)
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return slow(x[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in slow(x[j:])]

    r = np.random.default_rng(4)
    for _ in range(200):
        x = r.choice([-3, -1.5, -1, 1, 2.25, 4.125], int(r.integers(0, 14))) + r.random() * 1e-3
        got = toxicity.maximal_segments(x)
        assert sorted((a, b, round(s, 6)) for a, b, s in got) == sorted((a, b, round(s, 6)) for a, b, s in slow(list(x)))


def test_model_equals_its_definition(spark):
    """Log-odds, lambda and K by hand, from the same split of the labelled rows."""
    r = np.random.default_rng(12)
    bad, good = ([f"{w}{a}{b}" for a in "abcdef" for b in "vwxyz"] for w in ("vile", "kind"))
    rows = []
    for i in range(300):
        toxic = int(i % 3 == 0)
        words = [*r.choice(good, 30), *r.choice(bad, 8 if toxic else 0), *(["vilest"] if i % 50 == 0 else [])]
        rows.append((i, " ".join(r.permutation(words)), toxic))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    split = toxicity.labelled(docs, labels, 5, 0).collect()
    seen, rest = [x for x in split if x.part], [x for x in split if not x.part]
    n0, n1 = (sum(x.toxic == t for x in seen) for t in (0, 1))
    count = {t: Counter(w for x in seen if x.toxic == t for w in set(x.text.split())) for t in (0, 1)}
    runs = Counter(w for x in seen if not x.toxic for w in x.text.split())
    c = {w: (count[0][w] * n1 / n0, float(count[1][w])) for w in count[0].keys() | count[1].keys()}

    def stems(n, up):
        out = {}
        for w, (a, b) in c.items():
            if len(w) >= n:
                x = out.setdefault(w[:n], [0, 0, up(w)])
                x[0], x[1] = x[0] + a, x[1] + b
        return {g: (b + 4 * u) / (a + b + 4) for g, (a, b, u) in out.items()}

    four = stems(4, lambda w: 0.5)
    six = stems(6, lambda w: four.get(w[:4], 0.5))
    mean = {w: six.get(w[:6], four.get(w[:4], 0.5)) for w in c}
    score = {w: np.log((b + toxicity.PRIOR * mean[w]) / (a + toxicity.PRIOR * (1 - mean[w]))) for w, (a, b) in c.items()}
    words, tables = model.tables.value
    for w, s in words.items():
        assert abs(s - score[w]) < 1e-9
    assert all(w in words for w in c if count[0][w] + count[1][w] > 1 and abs(score[w]) > toxicity.KEEP)
    for table, share in zip(tables, (six, four)):
        assert {g: round(s, 9) for g, s in table.items()} == {g: round(float(np.log(p / (1 - p))), 9) for g, p in share.items() if abs(np.log(p / (1 - p))) > toxicity.KEEP}
    law = Counter()
    for w, n in runs.items():
        law[round(score[w] + 1e-12, 1)] += n
    total = sum(n / sum(law.values()) * np.exp(model.lam * (s - model.drift)) for s, n in law.items())
    assert abs(total - 1) < 0.02 or model.lam == 4.0
    clean = [x.text.split() for x in rest if not x.toxic]
    best = [max((s for *_, s in toxicity.maximal_segments(np.array([model.word(w) for w in t]))), default=0.0) for t in clean]
    assert abs(model.k - max(1e-6, len(clean) / max(1.0, sum(len(t) * np.exp(-model.lam * b) for t, b in zip(clean, best))))) < 1e-9


def held(spark, name, label, modulus, rest):
    import pandas as pd

    d = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, d).toPandas()
    assert list(got.held_out) == [zlib.crc32(str(i).encode()) % modulus == rest for i in got.doc_id]
    assert got.score.between(0, 1).all()
    labels = pd.read_parquet(f"{d}/labels.parquet")
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    return (m.predicted == m[label]).mean()


def test_toxicity_held_out(spark):
    assert held(spark, "op3_toxic_segments", "toxic", 5, 0) > 0.9


def test_quality_held_out(spark):
    assert held(spark, "op6_pairwise_gam", "quality", 4, 2) > 0.95


def test_trees_against_exhaustive_search():
    """One cut and the three cuts of two features, against all cuts that there are."""
    q = quality_gam
    leaf = lambda g, h: g.sum() / (h.sum() + 1.0)

    def one_cut(g, h, n):
        cuts = [k for k in range(1, len(g)) if min(n[:k].sum(), n[k:].sum()) >= q.LEAST_IN_LEAF]
        gains = {k: q._gain(g[:k].sum(), h[:k].sum()) + q._gain(g[k:].sum(), h[k:].sum()) - q._gain(g.sum(), h.sum()) for k in cuts}
        k = max(gains, key=gains.get, default=None)
        if k is None or gains[k] <= 1e-9:
            return np.full(len(g), leaf(g, h)), None
        return np.concatenate([np.full(k, leaf(g[:k], h[:k])), np.full(len(g) - k, leaf(g[k:], h[k:]))]), k

    for seed in range(40):
        r = np.random.default_rng(seed)
        g, h, n = r.normal(0, 9, (6, 5)), r.random((6, 5)) * 20, r.integers(0, 40, (6, 5))
        one, k = one_cut(g[0], h[0], n[0])
        assert np.allclose(q._tree(g[0], h[0], n[0], 1), one)
        two = one if k is None else np.concatenate([one_cut(g[0][s], h[0][s], n[0][s])[0] for s in (slice(k), slice(k, None))])
        assert np.allclose(q._tree(g[0], h[0], n[0], 2), two)
        tables = []
        for flip in (False, True):
            a, b, c = (v.T if flip else v for v in (g, h, n))
            for k in range(1, len(a)):
                sides = [one_cut(a[s].sum(0), b[s].sum(0), c[s].sum(0))[0] for s in (slice(k), slice(k, None))]
                t = np.concatenate([np.tile(x, (m, 1)) for x, m in zip(sides, (k, len(a) - k))])
                tables.append(t.T if flip else t)
        loss = lambda t: (t * g - 0.5 * t * t * h).sum()
        assert np.isclose(loss(q._grid(g, h, n)), max(map(loss, tables)), rtol=1e-6)


@pytest.mark.parametrize("f,label", [(toxicity.toxicity, "toxic"), (quality_gam.quality, "quality")])
def test_classifiers_on_odd_tables(spark, f, label):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "word " * 3000), (4, "word " * 3000)], "doc_id long, text string").selectExpr("*", "0 as toxic", "1 as quality", "2 as score")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (4, 0), (4, 1), (None, 1)], f"doc_id long, {label} int")
    got = f(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len(f(docs, labels.limit(0)).collect()) == 5
    assert f(docs.limit(0), labels).collect() == []


# ---- op7


def test_repeated_words_by_hand(spark):
    texts = ["", None, "a b c", "a b c a b c", "a a a a", "x a b c y a b c z", "a\nb\na\n \n \nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as words", "2 as lines")
    got = {r.doc_id: r for r in cascade.cascade(df).collect()}

    def repeated(w):
        g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})

    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), repeated(w)) and got[i].base_failed and not got[i].kept
    assert got[6].n_dup_lines == 2
    assert cascade.cascade(df.limit(0)).collect() == []


# ---- op8


def repair_cost(roles):
    """Brute force over all repairs of a short conversation."""
    if not roles:
        return 0
    best = None
    for choice in itertools.product([1, 2, 3, "m"], repeat=len(roles)):
        state, cost = 0, 0
        for r, c in zip(roles, choice):
            if c == "m":
                if state == 0:
                    break
                cost += chat.MERGE + (0 if state == r else chat.RELABEL if r else chat.RELABEL_UNKNOWN)
                continue
            gap = chat.BETWEEN.get((state, c))
            if gap is None:
                break
            cost += chat.INSERT * len(gap) + (0 if c == r else chat.RELABEL if r else chat.RELABEL_UNKNOWN)
            state = c
        else:
            cost += chat.END_COST[state]
            best = cost if best is None else min(best, cost)
    return best


def test_repairs_are_cheapest_and_legal(spark):
    r = np.random.default_rng(6)
    names = ["system", "user", "assistant", "tool"]
    rows, want = [], {}
    for c in range(60):
        seq = [names[i] for i in r.integers(0, 4, int(r.integers(1, 6)))]
        want[c] = repair_cost([chat.role_of(x) for x in seq])
        rows += [(c, i, x, None if i == 2 else f"t{i}") for i, x in enumerate(seq)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as chunk", "2 as cost")
    for chunk in (2, 256):  # conversations over several chunks cost the same
        got = sorted(chat.repair(df, chunk).collect(), key=lambda x: (x.conv_id, x.chunk, x.place))
        for c, turns in itertools.groupby(got, key=lambda x: x.conv_id):
            turns = list(turns)
            assert turns[0].conv_cost == want[c]
            shown = re.findall(r"<\|(\w+)\|>", "".join(t.rendered for t in turns))
            shown = shown[1:] if shown[0] == "system" else shown
            assert shown == ["user", "assistant"] * (len(shown) // 2)
            cost = sum(chat.INSERT * t.n_inserted + chat.MERGE * (t.action == "merge") + (0 if t.new_role == t.role else chat.RELABEL if chat.role_of(t.role) else chat.RELABEL_UNKNOWN) for t in turns)
            assert cost == want[c]


def test_long_turns_make_short_pieces(spark, monkeypatch):
    """Pieces end by characters as well; every turn stays, and a repair of the same cost is found."""
    roles = ["user", "user", "assistant", "tool", "system"]
    rows = [(i % 2, i, roles[i % 5], "x" * (i % 7) * 10) for i in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = lambda: sorted((r.conv_id, r.chunk, r.place, r.turn, r.role, r.conv_cost) for r in chat.repair(df).collect())
    want = kept()
    monkeypatch.setattr(chat, "PIECE_CHARS", 50)
    assert kept() == want
    cut = df.coalesce(1).sortWithinPartitions("conv_id", "turn").select("conv_id", "turn", "role", "text").mapInArrow(chat._cut(256), chat.PIECES).collect()
    assert all(sum(len(t.text) for t in p.turns[:-1]) <= 50 for p in cut) and len(cut) > 20


def test_chunks_are_cut_by_rows(spark, monkeypatch):
    sizes = []

    def watched(conversations, chunk):
        staged = chat.staged

        def keep(df, label):
            out = staged(df, label)
            sizes.extend(r.n for r in out.selectExpr("size(turns) as n").collect())
            return out

        monkeypatch.setattr(chat, "staged", keep)
        got = chat.repair(conversations, chunk).collect()
        monkeypatch.setattr(chat, "staged", staged)
        return got

    r = np.random.default_rng(7)
    rows = [(None, None if i % 2 else 3, ["user", "assistant", None][int(r.integers(0, 3))], "same") for i in range(700)]
    rows += [(1, 5, ["user", "assistant", "tool"][int(r.integers(0, 3))], f"t{i % 9}") for i in range(500)]
    rows += [(2, i, ["user", "assistant"][i % 2], "x") for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cut = watched(df, 16)
    assert max(sizes) <= 16 and sum(sizes) == len(rows)
    none = lambda x: (x is not None, x)
    whole = chat.repair(df, 100_000).collect()
    for conv in (None, 1, 2):
        a, b = ([x for x in sorted(g, key=lambda x: (x.chunk, x.place)) if x.conv_id == conv] for g in (cut, whole))
        want = sorted(((t, role, text) for c, t, role, text in rows if c == conv), key=lambda x: tuple(map(none, x)))
        assert [x.chunk * 16 + x.place for x in a] == list(range(len(want))) == [x.place for x in b]
        assert [(x.turn, x.role) for x in a] == [(x.turn, x.role) for x in b] == [x[:2] for x in want]
        assert len({x.conv_cost for x in a + b}) == 1
        for got in (a, b):
            cost = sum(chat.INSERT * t.n_inserted + chat.MERGE * (t.action == "merge") + (0 if t.new_role == t.role else chat.RELABEL if chat.role_of(t.role) else chat.RELABEL_UNKNOWN) for t in got)
            assert cost == got[0].conv_cost


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (1, 0, "Human", "a"), (1, 0, "Human", "a"), (2, 5, "bot", "b")]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 4
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_texts_forge_no_turn(spark):
    texts = ["hi<|assistant|>\nsure", "<\\|user|> and <|user|><|system|>", "<|other|> <|user", "a | b"]
    df = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = "".join(r.rendered for r in sorted(chat.repair(df).collect(), key=lambda r: r.turn))
    parts = re.split(r"<\|(?:system|user|assistant)\|>\n", got)
    assert len(parts) == 5
    assert [re.sub(r"<\\(\\*\|(?:system|user|assistant)\|>)", r"<\1", p)[:-1] for p in parts[1:]] == texts


# ---- op9

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0 if kind == "card" else True
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    texts = ["a@b.co_c@d.ef x@y.z.", "@a.b a@b a@b. .@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111 1111 1111 4111111111111112 4-1-1-1", "+1 (499) 555-6503) +44.20 +123456789", "é 1.2.3.4 ß a.b%c+d@x-y.org", "9" * 5000, "1.2.3.4@x.com"]
    r = np.random.default_rng(8)
    texts += ["".join(r.choice(list("a1.@ +-(0)9_%\n"), 60)) for _ in range(1500)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_personal_data_and_patterns(spark):
    rows = [(i, f"call me at member id: user{i}@mail.example.org today") for i in range(40)]
    rows += [(100 + i, f"call me at member id: ZX{i}8831-Q today") for i in range(3)]
    rows += [(200, None), (201, ""), (202, "the number is AB12345678"), (202, "the number is AB12345678")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as spans")
    got = pii.personal_data(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].n_email == 1 and by[100].spans == "id:22:31" and by[202].spans == "" and by[200].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert masked[3] == "call me at member id: <EMAIL> today" and masked[100] == "call me at member id: <ID> today" and masked[200] is None and masked[202] == "the number is AB12345678"
    assert pii.personal_data(df.limit(0)).collect() == []


def test_believed_values_are_seeds_of_further_patterns(spark):
    codes = [f"QX{7000 + i}-B" for i in range(12)]
    rows = [f"member id: user{i}@mail.example.org" for i in range(40)] + [f"member id: {c}" for c in codes]
    rows += [f"badge shown: {c}" for c in codes] + ["badge shown: ZZ99887-K"]  # no fixed form stands behind this
    rows += [f"access key: k{i}@mail.example.org" for i in range(20)] + [f"access key: AK{i}55512" for i in range(10)]  # a third is unknown
    rows += [f"of the p{i}@mail.example.org" for i in range(60)] + ["of the 20240131"] + [f"some word of all the texts {'abcdefghij'[i % 10]}" for i in range(60)]
    rows += [f"batch of paint {88000000 + i}" for i in range(30)]
    got = [r.text for r in pii.redact(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[40:52] == ["member id: <ID>"] * 12 and got[52:65] == ["badge shown: <ID>"] * 13
    assert got[65:95] == ["access key: <EMAIL>"] * 20 + ["access key: <ID>"] * 10
    assert "of the 20240131" in got and got[-30:] == rows[-30:]


def test_contexts_have_no_window():
    text = "x" * 300_000 + " " * 5000 + "key=" + "AB12cd34" + "9" * 3 + ") \n next"
    at = text.index("AB12")
    got = next(pii._contexts(text, [(at, at + 11)]))
    assert [p[:2] for p in got] == ["l1", "l2", "l3", "r1"] and got[:2] == ["l1|=", "l2|key="] and got[3] == "r1|)"
    assert got[2] != next(pii._contexts("y" + text[1:], [(at, at + 11)]))[2] and len(got[2]) < 60
    assert list(pii._contexts("a\nB12345 c", [(2, 8)])) == [["r1| c"]]
    r = random.Random(9)
    for _ in range(300):
        text = "".join(r.choice(["ab", "é1", "\n", " ", "=", "B12345", "   ", "_"]) for _ in range(r.choice([3, 40])))
        tokens = [(b, e) for _, b, e in pii._spans(text)] + [(i, i + 1) for i in range(len(text)) if text[i] == "B"]
        assert list(pii._neighbours(text, tokens)) == [(pii._before(text, b), pii._after(text, e)) for b, e in tokens]


def test_a_line_of_many_candidates_takes_linear_time():
    text = "k1ab2c3 " * 100_000
    began = time.perf_counter()
    spans = pii._spans(text)
    assert len(list(pii._contexts(text, [(b, e) for _, b, e in spans]))) == 100_000 and pii._elsewhere(text) == set()
    assert time.perf_counter() - began < 15


def test_scores_equal_brute_force(spark):
    """Patterns of one round against their definition."""
    rows = [f"ticket no. {v}" for v in ["a@b.org", "c@d.org", "1.2.3.4", "ABC123456", "XYZ7654321", "soon", "later", "soon"]] + ["room QRS998877 x"] * 3 + ["plain words of text"] * 40
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.pattern: (round(r.confidence, 9), r.seeds) for r in pii.patterns(pii.scan(df), df, [], rounds=0, least=2, confident=0.3).collect()}
    want = {}
    for n, p in enumerate([".", "no.", "ticket no."], 1):
        if n > 1:
            odds = (3 + 0.5) / (2 * pii.UNKNOWN + 2 + 0.5)
            want[f"l{n}|{p} "] = (round(odds / (1 + odds), 9), 3)
    assert got == want


def test_ordinary_tokens_of_patterns(spark, monkeypatch):
    """However patterns reach the texts, they meet the same tokens: also where a context ends within a word, or is a digest. Few
    marks are looked for, and patterns of words that stand beside too many ordinary ones are left out before all texts are read."""
    rows = [f"the ticket no. {v} ci\u00f3{v} {'y' * 90} a {w} ci\u00f3{w}" for v, w in zip(["AB1234", "CD5678", "EF9012"], ["soon", "later", "once"])] + [f"room {chr(97 + i // 26)}{chr(97 + i % 26)}e" for i in range(500)] + [f"room QRS99{i}" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    names = {p for t in rows for s in [list(pii._free(pii._tokens(t), pii.base_spans(t)))] for one in pii._contexts(t, s) for p in one}
    assert any(map(pii._digested, names))
    wanted = spark.createDataFrame([(p,) for p in sorted(names) if "room" not in p], "pattern string")
    ways = []
    for listed, checked in ((1 << 20, 0), (0, 1 << 20), (0, 0)):
        monkeypatch.setattr(pii, "LISTED", listed)
        monkeypatch.setattr(pii, "CHECKED", checked)
        ways.append({(r.pattern, r.value) for r in pii._beside(pii._texts(docs), wanted, []).collect()})
    found = {p for p, _ in ways[0]}
    assert ways[0] == ways[1] == ways[2] and "l1|ci\u00f3" in found and any(map(pii._digested, found))
    assert pii._marks(['l3|token = "', *(f'r2|" {w}' for w in ("alpha", "beta", "gamma"))], frozenset()) == {'"': False}
    asked = spark.createDataFrame([("l1|room ", 20), ("l2|no. ", 20)], "pattern string, n long")
    assert [r.pattern for r in pii.possible(docs, asked, [], first=1).collect()] == ["l2|no. "]


def test_held_out_keys_are_found(spark):
    """Half of the planted keys are no seeds: the pattern, learned from the others, finds all of them, and marks nothing
    that stands elsewhere. Without any seed there is no pattern."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.where("lower(text) like '%token = \"%'").collect()}
    planted = {(d, m.start(1)): m[1] for d, t in texts.items() for m in re.finditer(r'(?i)token = "([^"\n]*)', t)}
    held = {at for at, v in planted.items() if pii._hash(v) % 100 < 50}
    scanned, frequent = pii.scan(docs), pii.frequent_words(docs)
    marked = {(r.doc_id, r.start) for r in pii.discovered(scanned, pii.patterns(scanned, docs, frequent, held_out=50)).collect()}
    assert len(held) > 40 and held <= marked and marked <= set(planted)
    assert pii.patterns(scanned, docs, frequent, held_out=100).count() == 0


def test_planted_keys_are_found(spark):
    """Every planted key is marked by the pattern, and values without a key's form beside it as well. The keys are seeds
    themselves, by their form; the next test leaves some out."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    planted = {r.doc_id: r.text for r in docs.collect() if 'token = "' in (r.text or "")}
    odd = {-1: 'a token = "swordfish-Long" b', -2: 'a token = "K9-22" b', -3: 'the word token alone, 20240131', -4: "a hash 04dbebab91ab85687d33eeaaf9ac699e1188f962"}
    more = docs.unionByName(spark.createDataFrame(list(odd.items()), "doc_id long, text string"))
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("id:")] for r in pii.personal_data(more).select("doc_id", "spans").collect()}
    found = [i for i, t in planted.items() if f"id:{t.index(chr(34), t.index('token = ')) + 1}:" in ",".join(got[i]) + ":"]
    assert len(planted) >= 8 and len(found) == len(planted)
    assert got[-1] == ["id:11:25"] and got[-3] == got[-4] == []
    assert not [i for i, s in got.items() if s and i not in planted and i >= 0]


def test_rows_without_id_are_masked(spark):
    rows = [(i, f"member id: user{i}@mail.example.org") for i in range(20)] + [(None, "member id: ZX8831-Q"), (None, "member id: ZX8832-Q, a@b.example"), (None, None)]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is null").collect()
    assert Counter(r.text for r in got) == Counter(["member id: <ID>", "member id: <ID>, <EMAIL>", None])


# ---- op10


def test_archives(spark, tmp_path):
    same = "<p>" + "é" * 700 + "</p>"
    rows = [(1, "http://a.example/\r\nx", same), (5, None, same), (3, "http://a.example/ü", same), (4, "http://b.example", "short"), (6, "http://b.example", "short"), (7, "u", None), (None, "n", same), (5, None, same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as n")
    files = []
    for name in ("one", "two"):
        folder = f"file://{tmp_path}/{name}"
        manifest = warc.write_archives(df, folder, roll_bytes=900, shards=2)
        files.append(sorted((r.file, r.sha256) for r in manifest.collect()))
        got = warc.read_archives(spark, folder).collect()
        assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter(
            [(1, 1407, "revisit", 5), (5, 1407, "response", None), (3, 1407, "revisit", 5), (4, 5, "response", None), (6, 5, "response", None), (7, 0, "response", None), (None, 1407, "revisit", 5), (5, 1407, "response", None)]
        )
        assert {r.html for r in got if r.page_id == 5} == {same} and not (tmp_path / name / "_temporary").exists()
    assert files[0] == files[1] and len(files[0]) > 2
    empty = f"file://{tmp_path}/none"
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).collect() == []


def test_archives_depend_on_the_records_alone(spark, tmp_path):
    """The same shards whatever the partitions, and more rows than a range sample holds."""
    df = spark.range(12_000).selectExpr("(id * 7919) % 12000 as page_id", "'http://h.example/' || id as url", "repeat(md5(cast(id % 9000 as string)), 40) as html")
    df = df.unionByName(df.where("page_id < 3"))
    files, old = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n, parts in ((3, 5), (11, 2)):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        manifest = warc.write_archives(df.repartition(parts), f"file://{tmp_path}/{n}", roll_bytes=60_000).collect()
        files.append(sorted((r.file, r.sha256, r.records, r.first_page, r.last_page) for r in manifest))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert files[0] == files[1] and len({f[0][:11] for f in files[0]}) > 5 and sum(f[2] for f in files[0]) == 12_003
    assert all(a[4] < b[3] for a, b in zip(files[0], files[0][1:]))
    ids = []
    for name in os.listdir(tmp_path / "3"):
        if name.endswith(".gz"):
            ids += re.findall(rb"WARC-Record-ID: (\S+)", gzip.decompress((tmp_path / "3" / name).read_bytes()))
    assert len(ids) == len(set(ids))


def test_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from veriloom.llm.base import BATCH_BYTES, in_arrow

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "bytes"])

    key, size = BATCH_BYTES
    old = spark.conf.get(key, None)
    texts = spark.range(0, 400, 1, 1).selectExpr("repeat('word ', 10000) AS text")
    try:
        spark.conf.unset(key)
        got = texts.transform(in_arrow, sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 400 and max(r.bytes for r in got) < 2 * size
        spark.conf.set(key, str(1 << 20))
        got = texts.transform(in_arrow, sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 400 and max(r.bytes for r in got) < 2 << 20
        assert spark.conf.get(key) == str(1 << 20)  # a bound that the session sets stays
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)
