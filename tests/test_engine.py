"""The evidence engine on hand-built rows, and its invariants over the star-schema tables."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F
from veriloom.functions import text as X
from veriloom.functions.bloom import filter_of, may_hold
from veriloom.operators import extract as EX
from veriloom.operators import graph_reads as GR
from veriloom.operators import ingest as IN
from veriloom.plans import evidence as E
from veriloom.plans import package as P
from veriloom.plans import resolve as R
from veriloom.plans import stories as S
from veriloom.plans.nested import assembled, requirement_buckets, requirement_matches, requirement_summaries
from veriloom.queries import QUERIES, Tables
from veriloom.sources.graph import Graph, star_graph
from veriloom.sources.staging import CLEANUP, staged

D = "/root/testdata/sf0.001"
NODE = "label string, key string, props map<string,string>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


# ---- functions


@pytest.mark.parametrize(
    "text,want",
    [
        ("more than 3,000 km", True), ("raised ~€5,000", True), ("an 800-row dataset, 20 batches, 4 customers", True), ("15,000 acres/year", True), ("more than 100 participants", True), ("reduced time by 40%.", True), ("up 3 %", True),
        ("integrated a 70B model, version 3.3", False), ("from concept to functioning MVP", False), ("used GPT-4 and a 3.7 model", False), ("", False), (None, False),
    ],
)
def test_metrics(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.has_metric(F.col("t"))).first()[0] is want


def test_text_functions(spark):
    df = spark.createDataFrame([("  C++ / Café-au lait  ",), ("",), (None,)], "t string")
    got = df.select(X.tokens(F.col("t")), X.normalize(F.col("t")), X.slug(F.col("t"))).collect()
    assert tuple(got[0]) == (["c", "caf", "au", "lait"], "c++ / café-au lait", "c-caf-au-lait") and got[1][0] == [] and got[2][0] == []
    dates = spark.createDataFrame([("2026-01-01",), ("2025-04",), ("2025",), ("2025-13",), ("2025-x",), ("soon",), ("",), (None,)], "d string")
    assert [r[0] for r in dates.select(X.partial_date(F.col("d"))).collect()] == ["Jan 2026", "Apr 2025", "2025", "2025", "2025", "soon", None, None]
    lists = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "l array<string>")
    assert [r[0] for r in lists.select(X.natural_list(F.col("l"))).collect()] == ["", "a", "a and b", "a, b and c"]


# ---- resolution

SKILLS = [
    ("postgresql", ["postgres", "psql"], "tool"), ("backend engineering", ["server side engineering"], "capability"), ("security boundary design", None, "capability"), ("professional communication", None, "capability"),
    ("typescript", None, "technical"), ("api design", ["rest api design"], "capability"), ("api design review", None, "capability"), ("german", None, "language"), ("queue design one", None, "capability"), ("queue design two", None, "capability"),
]


@pytest.fixture(scope="module")
def skill(spark):
    return spark.createDataFrame([(n, n.title(), a, c) for n, a, c in SKILLS], "name string, display_name string, aliases array<string>, category string")


def test_resolution(spark, skill):
    asked = ["postgres", "backend engineering", "infrastructure security", "professional software engineering experience", "api designer tools", "queue design", "cobol", "boundary design", "Typescript "]
    got = {r.query: (r.canonical_skill, r.match_confidence, r.match_type) for r in R.resolve(spark.createDataFrame([(q,) for q in asked], "query string"), skill).collect()}
    assert got["postgres"] == ("postgresql", "high", "alias_exact") and got["backend engineering"] == ("backend engineering", "high", "canonical_exact") and got["Typescript "][2] == "canonical_exact"
    for q in ("infrastructure security", "professional software engineering experience", "cobol"):
        assert got[q][1] == "no_match" or got[q][1] == "low" and got[q][0] != "professional communication"
    assert got["cobol"] == (None, "no_match", "no_match") and got["infrastructure security"] == (None, "no_match", "no_match")
    assert got["api designer tools"][2] == "lexical_single_token" and got["queue design"][1:] == ("low", "lexical_multi_token") and got["boundary design"][0] == "security boundary design"
    checked = {r.query: r.exists for r in R.vocabulary_check(spark.createDataFrame([("postgres",), ("production monitoring",)], "query string"), skill).collect()}
    assert checked == {"postgres": True, "production monitoring": False}


def test_autofill(spark, skill):
    req = spark.createDataFrame([("j", 1, "backend development", []), ("j", 2, "api design", []), ("j", 3, "cobol", [("x", "y", "llm_semantic")])], "job_id string, seq int, skill_query string, related array<struct<skill_query:string,reason:string,source:string>>")
    got = {r.seq: [x.skill_query for x in r.related] for r in R.autofill(req, skill).collect()}
    assert got[1] == ["backend engineering"] and "api design" not in got[2] and "api design review" in got[2] and got[3] == ["x"]


# ---- stories, in the shape of five matches


def test_stories_of_hand_built_matches(spark):
    cols = "job_id string, person_id string, bucket string, seq int, raw string, skill_query string, importance string, recommendation string, canonical_skill string, source string, source_type string, relationship string, project string, role string, education string, professional_context boolean, evidence_strength string"
    m = [
        (1, "ts", "typescript", "required", "include", "typescript", "P1", "Project", "P1", None, False, "weak"),
        (2, "fs", "full-stack development", "required", "include", "full-stack development", "a1", "Achievement", "P1", None, False, "moderate"),
        (2, "fs", "full-stack development", "required", "include", "full-stack development", "P1", "Project", "P1", None, False, "weak"),
        (3, "pe", "prompt engineering", "required", "include", "prompt engineering", "a2 for 12 customers", "Achievement", "P2", None, True, "strong"),
        (4, "llm", "llm api integration", "preferred", "include", "llm api integration", "a2 for 12 customers", "Achievement", "P2", None, True, "strong"),
        (5, "pc", "communication skills", "required", "exclude", "professional communication", "a3", "Achievement", None, "R1", False, "weak"),
    ]
    data = [("j", "p", "partial" if rec == "exclude" else "matched", i, raw, q, imp, rec, c, s, t, "USED", pr, ro, None, pro, st) for i, raw, q, imp, rec, c, s, t, pr, ro, pro, st in m]
    k = S.keyed(E.numbered(spark.createDataFrame(data, cols)))
    none = {n: spark.createDataFrame([], s) for n, s in {
        "person": "person_id string, name string", "role": "role_id string, title string, description string, start_date string, end_date string, location string, work_mode string, employment_type string", "company": "name string",
        "project": "project_id string, name string, type string, domain string, context string, description string, role string, start_date string, end_date string, location string, work_mode string",
        "education": "education_id string, institution string, program string, status string, description string, start_date string, end_date string", "achievement": "achievement_id string, description string, metric string",
        "skill": "name string, display_name string, aliases array<string>, category string", "edges": "type string, src_label string, src_key string, dst_label string, dst_key string"}.items()}
    g = Graph(**none)
    got = {r.label: r for r in S.stories(k, g).collect()}
    assert set(got) == {"P1", "P2"} and got["P2"].rank == 1 and got["P1"].rank == 2
    assert got["P1"].n_achievements == 1 and "typescript" in got["P1"].direct_skills and len(got["P1"].supports) == 2 and got["P1"].required_count == 2
    assert got["P2"].n_achievements == 1 and got["P2"].professional_context and got["P2"].evidence_strength == "strong" and got["P2"].source_type == "Project" and got["P2"].achievements[0].has_metric
    names = {r.name for r in S.skill_summary(E.numbered(spark.createDataFrame(data, cols)), g).collect()}
    assert "prompt engineering" in names and "professional communication" not in names


# ---- ingest


def test_read_graph(spark, tmp_path):
    (tmp_path / "seed.json").write_text('{"person": {"personId": "p", "name": "N"}, "skills": [{"name": "s", "aliases": ["a"]}], "relationships": [{"type": "USED", "from": {"label": "Project", "key": "x"}, "to": {"label": "Skill", "key": "s"}}]}')
    nodes, edges = IN.read_graph(spark, str(tmp_path / "seed.json"))
    assert sorted((r.label, r.key) for r in nodes.collect()) == [("Person", "p"), ("Skill", "s")]
    assert rows(edges) == [("USED", "Project", "x", "Skill", "s")]
    assert rows(IN.upsert_edges(nodes, edges.limit(0), edges)) == []


def test_upsert_nodes(spark):
    base = spark.createDataFrame([("A", "1", {"x": "1", "y": "2"}), ("A", "2", {})], NODE)
    delta = spark.createDataFrame([("A", "1", {"y": None}, 1), ("A", "1", {"z": "3"}, 2), ("B", "9", {"q": "0"}, 1), ("B", "9", {"q": "1"}, 2), ("C", "0", {}, 1)], NODE + ", seq int")
    assert {(r.label, r.key): r.props for r in IN.upsert_nodes(base, delta).collect()} == {("A", "1"): {"x": "1", "z": "3"}, ("A", "2"): {}, ("B", "9"): {"q": "1"}, ("C", "0"): {}}


def test_whitelists_and_keys(spark):
    nodes = spark.createDataFrame([("Skill", "a"), ("Tool", "b"), (None, "c"), ("Skill", "a"), ("Skill", None), ("Skill", None)], "label string, key string")
    edges = spark.createDataFrame([("USED", "Project", "x", "Skill", "y"), ("LIKES", "Person", "x", "Skill", "y")], "type string, src_label string, src_key string, dst_label string, dst_key string")
    assert rows(IN.rejected(nodes, edges)) == sorted([("node", None, "c"), ("node", "Tool", "b"), ("edge", "LIKES", "x>y")], key=str) or len(rows(IN.rejected(nodes, edges))) == 3
    assert rows(IN.duplicate_keys(nodes)) == [("Skill", "a", 2)]
    with pytest.raises(Exception, match="unknown label"):
        IN.assert_allowed(nodes).collect()


def test_requirement_lists(spark):
    good = '{"requirements":[{"raw":"r","skillQuery":"q","importance":"required","category":"domain"}]}'
    bad = ["not json", '["x"]', '{"items":[]}', good.replace("required", "must"), good.replace('"category":"domain"', '"x":"y"'), good.replace("}]}", ',"relatedCapabilities":[{"skillQuery":"a","reason":"b","source":"guess"}]}]}'), None]
    df = spark.createDataFrame([("ok", good), ("none", '{"requirements":[]}'), *[(f"bad{i}", b) for i, b in enumerate(bad)]], "job_id string, json string")
    valid, rejected = IN.parse_requirements(df)
    assert [(r.job_id, r.raw) for r in valid.collect()] == [("ok", "r")] and sorted(r.job_id for r in rejected.collect()) == [f"bad{i}" for i in range(len(bad))]


def test_job_files(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    for name, content in {"a.txt": b"a job\nof two lines", "b.txt": b" \n ", "c.txt": b"caf\xe9", "d.txt": b"x" * 101, "e.txt": b"", "f.md": b"no job"}.items():
        (d / name).write_bytes(content)
    texts, rejected = IN.read_jobs(spark, str(d), 100)
    assert rows(texts) == [("a", "a job\nof two lines")]
    assert rows(rejected) == [("b", "blank"), ("c", "undecodable"), ("d", "too_large")]  # Spark doesn't list files without bytes
    plan = texts._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,100)" in plan  # by the listing, before a file is read
    IN.write_job_files(spark.createDataFrame([("x", "é\n"), ("y", None)], "job_id string, text string"), "file://" + str(tmp_path / "out"))
    texts, rejected = IN.read_jobs(spark, str(tmp_path / "out"))
    assert rows(texts) == [("x", "é\n")] and rejected.count() == 0


def test_job_files_are_read_once(spark, tmp_path):
    jobs = [(f"job {i}", f"text {i}") for i in range(300)]
    IN.write_job_files(spark.createDataFrame(jobs, "job_id string, text string").repartition(3), "file://" + str(tmp_path))
    got = IN.job_files(spark, str(tmp_path))
    assert rows(got) == sorted((*j, None) for j in jobs)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("FileScan binaryFile" in x and "content" in x.split("Batched")[0] for x in plan) == 1
    assert len(list(tmp_path.iterdir())) == IN.FOLDERS > 32  # more folders than Spark lists in the driver


@pytest.mark.parametrize("kind", IN.KINDS)
def test_documents_round_trip(spark, tmp_path, kind):
    path = str(tmp_path / "out")
    schema = "job_id string, person_id string, doc struct<note:string,items:array<struct<k:string,v:long>>>"
    data = [(f"j{i}", None if i % 3 else "p", (None if i % 2 else f"n{i}", [("b", i), ("a", None)][: i % 3])) for i in range(300)]
    df = spark.createDataFrame(data, schema)
    IN.write_documents(df.where("job_id < 'j2'"), path, kind)
    IN.write_documents(df, path, kind, records=7)
    assert rows(IN.read_staged(spark, path, kind, df.schema)) == rows(df)  # the latest run counts
    known = IN.manifest(spark, path, kind)
    assert known.agg(F.sum("n")).first()[0] == 300 and known.agg(F.max("n")).first()[0] <= 7 and known.where("low > high").count() == 0
    some = IN.read_staged(spark, path, kind, df.schema, jobs=["j7", "j211", "none"])
    assert [r.job_id for r in some.orderBy("job_id").collect()] == ["j211", "j7"]
    assert len(some.inputFiles()) < known.count() / 4  # the others aren't opened
    (tmp_path / "out" / kind / "data-99999999999999999999-lost").mkdir()  # a run without a manifest isn't read
    (tmp_path / "out" / kind / "data-99999999999999999999-lost" / "part.json").write_text("{broken")
    assert IN.read_staged(spark, path, kind, df.schema).count() == 300
    with pytest.raises(Exception):
        IN.read_staged(spark, path, kind, "job_id long, doc string").collect()
    with pytest.raises(ValueError):
        IN.write_documents(df, path, "story")


def test_documents_of_odd_jobs_are_compressed(spark, tmp_path):
    """Files are compressed; the manifest knows the job of each line without parsing what follows, whatever signs its name has."""
    names = ['say "hi"', "back\\slash", "new\nline", "\u00e4\u00f6 \u4e2d", "", '"}', "plain", None]
    df = spark.createDataFrame([({"n": "x" * 500}, name) for name in names for _ in range(20)], "doc struct<n:string>, job_id string")
    path = str(tmp_path / "out")
    IN.write_documents(df, path, "context", records=20)
    files = list((tmp_path / "out" / "context").glob("data-*/*.json.gz"))
    assert files and sum(f.stat().st_size for f in files) < 160 * 100
    known = IN.manifest(spark, path, "context")
    assert known.agg(F.sum("n")).first()[0] == 160 and known.count() == len(files)
    assert rows(IN.read_staged(spark, path, "context", df.schema).select("job_id", "doc.n")) == rows(df.select("job_id", "doc.n"))
    lines = spark.read.text([str(f) for f in files])
    assert lines.select(IN.job_of("value").alias("j")).groupBy("j").count().where("count = 20").count() == len(names)
    ranges = {r.r for r in df.select(IN._range().alias("r")).distinct().collect()}
    assert {x for r in known.collect() for x in (r.low, r.high)} <= ranges


def test_staging_keeps_no_shuffle_files(spark):
    """What a staged table was shuffled through goes when it is written."""
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")
    before, found = kept(), staged(spark.range(5000).repartition(16, "id").groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    for _ in range(50):
        if kept() <= before:
            break
        time.sleep(0.2)
    assert kept() <= before and found.count() == 7 and spark.conf.get(CLEANUP) == "false"


# ---- extraction


def test_keywords(spark, skill):
    texts = spark.createDataFrame([("j", "We use Postgres, TypeScript and xapi design; api  design"), ("k", "typescripts"), ("l", None), ("m", "C++ or c#")], "job_id string, text string")
    signs = skill.unionByName(spark.createDataFrame([("++", "pp", None, "technical"), ("c++", "Cpp", None, "technical")], skill.schema))
    got = {(r.job_id, r.skill_query): r for r in EX.keyword_requirements(texts, signs).collect()}
    assert set(got) == {("j", "postgresql"), ("j", "typescript"), ("m", "c++")}
    assert got["j", "typescript"].raw.startswith("We use Postgres") and got["j", "postgresql"].category == "technology"


def brute_keywords(texts, names):
    found = set()
    for job, text in texts:
        low = text.lower()
        for skill, candidates in names:
            if any(re.search(f"(?<![a-z0-9]){re.escape(c.lower())}(?![a-z0-9])", low) for c in candidates if c):
                found.add((job, skill))
    return found


def test_keywords_equal_brute_force(spark):
    r = random.Random(14)
    words = ["api", "rest", "design", "c++", "c#", "++", "—", "é", "ß1", "of", "the", "x-y", "(a)", "a.b"]
    names = [(f"s{i} " + " ".join(r.sample(words, r.choice([1, 2, 3]))), [r.choice(words) + r.choice(["", " ", "-"]) + r.choice(words) for _ in range(2)] + [r.choice([*words, "", None])]) for i in range(60)]
    names = [(n.split(" ", 1)[1] if i % 2 else n, a) for i, (n, a) in enumerate(names)]
    names = list({n: a for n, a in names}.items())
    texts = [(str(i), r.choice(["", " ", "."]).join(r.choice(words) + r.choice([" ", " ", "", "-"]) for _ in range(r.choice([1, 6, 40])))) for i in range(150)]
    skill = spark.createDataFrame([(n, n.upper(), [x for x in a], "tool") for n, a in names], "name string, display_name string, aliases array<string>, category string")
    got = {(x.job_id, x.skill_query) for x in EX.keyword_requirements(spark.createDataFrame(texts, "job_id string, text string"), skill).collect()}
    assert got == brute_keywords(texts, [(n, [n, *(x or "" for x in a)]) for n, a in names])


def test_large_vocabulary(spark):
    skill = spark.range(200_000).selectExpr("concat('tool ', hex(id * 7919), ' kit') as name", "upper('x') as display_name", "array(concat('alias', id)) as aliases", "'tool' as category")
    texts = [("a", "We need tool 1EEF kit and alias77, not alias777777."), ("b", "toolkit"), ("c", "tool 0 kit" * 3), ("d", "the tool 0 kit kit")]
    df = EX.keyword_requirements(spark.createDataFrame(texts, "job_id string, text string"), skill)
    assert {(r.job_id, r.skill_query) for r in df.collect()} == {("a", "tool 1EEF kit"), ("a", f"tool {77 * 7919:X} kit"), ("d", "tool 0 kit")}
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_bloom_filter_never_says_no_to_its_own(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    other = spark.range(5000, 105_000).select(F.xxhash64("id").alias("h"))
    for bits in (10, 22):
        assert keys.where(may_hold(filter_of(keys, bits), F.col("h"), bits)).count() == 5000
    assert other.where(may_hold(filter_of(keys), F.col("h"))).count() < 500
    assert other.where(may_hold(filter_of(keys.limit(0)), F.col("h"))).count() == 0


def brute_same(cached, pasted):
    flat = lambda t: " ".join(re.split("[" + EX.WHITE[1:-2] + "]+", t or "")).strip(" ")
    probes = [(i, flat(t)[:200]) for i, t in cached]
    return sorted((i, d) for i, p in probes for d, t in pasted if len(p) > 40 and p in flat(t))


def test_same_document(spark):
    long = "This is a job description with a fair number of words in it, so that the probe is long enough to count"
    cached = [(1, long), (2, "too short to count"), (3, None), (4, "x" * 50), (5, "y" * 25 + " " + "z" * 30), (6, "one " + "w" * 45 + " end"), (7, "a b " + "v" * 40 + " c d"), (8, long + " but other in the end " * 20), (9, long)]
    pasted = [(1, "  " + long.replace(" ", "\u2003\n ") + " "), (2, "Pre" + long + "post"), (3, "unrelated text"), (4, ""), (5, None), (6, "a " + "x" * 60), (7, "q" + "y" * 25 + "\t" + "z" * 31), (8, "no " * 30 + "one " + "w" * 45 + " ending"),
        (9, "xa b " + "v" * 40 + " c dy"), (10, (long + " but other in the end " * 20)[:250]), (11, long[:-1])]
    got = rows(EX.same_document(spark.createDataFrame(cached, "item_id long, text string"), spark.createDataFrame(pasted, "doc_id long, text string")))
    assert sorted(got) == brute_same(cached, pasted) and (5, 7) in got and (6, 8) in got and (7, 9) in got and (4, 6) in got


# ---- graph


def star(spark, n, g):
    """The graph with one node that has ``n`` edges."""
    edges = spark.range(n).selectExpr("'USED' as type", "'Project' as src_label", "cast(id as string) as src_key", "'Skill' as dst_label", "'hub' as dst_key")
    return Graph(**{**g.__dict__, "edges": edges})


def test_expansion_of_a_hot_node(spark):
    g = star(spark, 200_000, Tables.of(spark, D).g)
    first = sorted(str(i) for i in range(200_000))[:21]
    assert [r.other_key for r in GR.first_neighbours(GR.neighbours(g), 21).where("key = 'hub'").orderBy("other_key").collect()] == first
    parts = GR.neighbours(g).where("key = 'hub'").groupBy(F.pmod(F.xxhash64("other_label", "other_key"), F.lit(GR.PARTS))).count()
    assert parts.agg(F.max("count")).first()[0] < 200_000 / GR.PARTS * 1.5  # what a task reads of it
    start = spark.createDataFrame([("Skill", "hub"), ("Project", "7")], "label string, key string")
    got = rows(GR.expand(g, start, hops=2, cap=10).where("hop > 0").select("root_key", "key", "hop"))
    assert got == sorted([("hub", k, 1) for k in first[:10]] + [("7", "hub", 1)] + [("7", k, 2) for k in first[:10]])


def test_expansion_shuffles_only_edges_of_the_frontier(spark):
    g = star(spark, 1000, Tables.of(spark, D).g)
    plan = GR.expand(g, spark.createDataFrame([("Project", "7")], "label string, key string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 2  # out- and in-edges


def test_equal_achievements_meet_by_number(spark, monkeypatch):
    """Tasks follow the number of lines, and no text is shuffled."""
    monkeypatch.setattr("veriloom.sources.staging.TASK_ROWS", 500)
    got = star_graph(spark, D).achievement
    plan = got._jdf.queryExecution().executedPlan().toString()
    lines = spark.read.parquet(f"{D}/lineitem.parquet").count()
    assert got.rdd.getNumPartitions() == -(-lines // 500) > 8
    assert all("Delivered" not in x for x in plan[plan.index("Exchange") :].splitlines())


def test_ranks_of_a_hot_key(spark):
    df = spark.range(5000).selectExpr("if(id < 4800, 'hot', concat('k', id % 7)) as k", "lpad(hex(id * 7919 % 5003), 6, '0') as v")
    got = GR.ranked(df.repartition(6), "k", "v")
    want = df.selectExpr("k", "v", "row_number() over (partition by k order by v) as place")
    assert rows(got) == rows(want)


def test_lists_are_assembled_in_order(spark):
    base = spark.createDataFrame([("j", "p", 1), ("j", "q", 2)], "job_id string, person_id string, n int")
    one = spark.createDataFrame([("j", "p", 2, "b"), ("j", "p", 1, None), ("x", "p", 1, "lost")], "job_id string, person_id string, o int, v string").repartition(3)
    got = assembled(base, {"names": (one, ["o"], F.col("v")), "none": (one.limit(0), ["o"], F.struct("v"))}, ["job_id", "person_id"])
    assert rows(got) == [("j", "p", 1, [None, "b"], []), ("j", "q", 2, [], [])]


def _leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_buckets_are_taken_from_one_scan(spark):
    made = spark.createDataFrame([("j", "p", i, b, f"v{i}") for i, b in enumerate(["gap", "matched", "gap", "partial", None])], "job_id string, person_id string, seq int, bucket string, summary string")
    got = requirement_buckets(made, made.select("job_id", "person_id").distinct().unionByName(spark.createDataFrame([("j", "q")], ["job_id", "person_id"])))
    assert rows(got) == [("j", "p", ["v1"], ["v3"], ["v0", "v2"]), ("j", "q", [], [], [])]
    t = Tables.of(spark, D)
    assert _leaves(requirement_buckets(t.summaries, t.app)) == 2  # applications and summaries


def test_evidence_is_located_once(spark):
    t = Tables.of(spark, D)
    assert _leaves(P.transferable_list(t.trans, t.status, t.refs)) == 3


def test_expansion_is_capped_and_never_goes_back(spark):
    t = Tables.of(spark, D)
    start = t.g.education.select(F.lit("Education").alias("label"), F.col("education_id").alias("key"))
    got = GR.expand(t.g, start, hops=2, cap=3)
    assert got.groupBy("root_key", "label", "key").count().where("count > 1").count() == 0
    assert got.where("hop = 1").groupBy("root_key").count().where("count > 3").count() == 0
    with pytest.raises(ValueError):
        GR.nodes_of(t.g, "Tool")


# ---- invariants over the tables: none of these has rows


def test_invariants(spark):
    t = Tables.of(spark, D)
    assert t.status.where("bucket is null").count() == 0
    assert t.status.where("bucket = 'gap' and n_evidence > 0 or bucket <> 'gap' and n_evidence = 0").count() == 0
    assert t.status.join(t.trans, ["job_id", "seq"]).where("bucket = 'matched' and n_evidence = 0").count() == 0
    assert t.keyed.where("recommendation = 'exclude'").count() == 0
    one = E.summary(t.status, t.trans)
    assert one.where("n_matched + n_partial + n_gaps <> n_requirements or n_transferable_gaps + n_hard_gaps <> n_gaps").count() == 0
    assert t.bullets.where(F.exists("bullets", lambda b: F.size(b["evidence_ids"]) == 0)).count() == 0
    assert t.x.where("recommendation is null or reason is null").count() == 0
    assert P.order(t.x).join(t.zr.select("job_id", "person_id", F.col("title")), ["job_id", "person_id", "title"]).count() == 0
    assert t.texts.where(F.col("text").contains("## ") & ~F.col("text").startswith("# ")).count() == 0
    assert E.rejected_edges(t.g).count() == 0


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_evidence_meets_requirements_once(spark):
    """Equal pieces count once, a person's evidence stays their own, and numbers follow the order of :func:`E.numbered`."""
    piece = "struct<source:string,source_type:string,relationship:string,project:string,role:string,education:string,professional_context:boolean,evidence_strength:string>"
    one = lambda source, kind="Project": (source, kind, "USED", source, None, None, False, "moderate")
    found = [("p1", [("a", [one("x"), one("y"), one(None)]), ("b", [one("z")]), (None, [one("w")])]), ("p2", [("b", [one("q")])])]
    found = spark.createDataFrame(found, f"person_id string, skills array<struct<canonical_skill:string,pieces:array<{piece}>>>")
    acc = [("j", f"r{i}", q, "required", "domain", skill, 1.0, how, "t", "include", i) for i, (q, skill, how) in enumerate([("q3", "b", "low"), ("q2", "a", "high"), ("q1", "b", "high"), ("q0", None, "no_match"), ("q0", "c", "high")])]
    acc = spark.createDataFrame(acc, "job_id string, raw string, skill_query string, importance string, category string, canonical_skill string, match_score double, match_confidence string, match_type string, recommendation string, seq long")
    held = E.held(acc, spark.createDataFrame([("j", "p1"), ("j", "p2"), ("j", "p3")], "job_id string, person_id string"), found)
    got = rows(held.select("person_id", "seq", "bucket", "n_evidence"))
    assert got[:5] == [("p1", 0, "partial", 1), ("p1", 1, "matched", 3), ("p1", 2, "matched", 1), ("p1", 3, "gap", 0), ("p1", 4, "gap", 0)]
    assert [g[2] for g in got[5:]] == ["partial", "gap", "matched", "gap", "gap"] + ["gap"] * 5
    m = E.matches(held)
    assert rows(m.where("person_id = 'p1'").select("n", "seq", "source")) == [(1, 2, "z"), (2, 1, "x"), (3, 1, "y"), (4, 0, "z")]
    assert rows(m.select("person_id", "n", "seq")) == rows(E.numbered(m.drop("n")).select("person_id", "n", "seq"))
    assert _shuffles(held) <= 6  # none once a requirement


def test_stories_meet_in_one_shuffle(spark):
    """Rows of evidence are shuffled once, and nothing but details is joined; the parts agree with the whole."""
    t = Tables.of(spark, D)
    texts = S.stories(t.keyed, t.g)._jdf.queryExecution().executedPlan().toString()
    assert texts.count("veriloom-held") == 1
    want = S.story_requirements(t.keyed).groupBy(*S.ID).agg(F.count("*").alias("n"), F.count_if(F.col("importance") == "required").alias("required_count"))
    assert rows(t.stories.select(*S.ID, F.size("supports"), "required_count")) == rows(want)
    assert rows(t.stories.select(*S.ID, "source_type", "direct_skills", "evidence_strength", "first_seen")) == rows(S.aggregated(t.keyed).select(*S.ID, "source_type", "direct_skills", "evidence_strength", "first_seen"))
    assert P.scored(t.parts)._jdf.queryExecution().executedPlan().toString().count("veriloom-parts") == 1


def test_tasks_of_stories_follow_the_edges(spark, monkeypatch):
    monkeypatch.setattr("veriloom.sources.staging.TASK_ROWS", 500)
    t = Tables.of(spark, D)
    n = -(-t.g.edges.count() // 500)
    plan = S.stories(t.keyed, t.g)._jdf.queryExecution().executedPlan().toString()
    assert n > 8 and re.search(rf"hashpartitioning\(job_id#\d+, person_id#\d+, {n}\)", plan)


def test_achievement_bullets_need_stories_only(spark, monkeypatch):
    n = Tables.of(spark, D).stories.count()
    for name in ("routed", "skills"):
        monkeypatch.setattr(Tables, name, property(lambda self: pytest.fail("not needed")))
    assert QUERIES["g04_achievement_bullets"](spark, D).count() == n > 0


def test_requirements_bring_their_related_evidence(spark):
    """Matches are a projection of the held requirements, and summaries join nothing but names."""
    t = Tables.of(spark, D)
    assert _leaves(requirement_matches(t.held)) == 1 and _leaves(requirement_summaries(t.held, t.reg)) == 2
    want = t.status.select("job_id", "person_id", "seq").join(t.trans, ["job_id", "seq"]).groupBy("job_id", "person_id", "seq").count()
    assert rows(t.held.where("given is not null").select("job_id", "person_id", "seq", F.size("given"))) == rows(want)


def _without(monkeypatch, *names):
    for name in names:
        monkeypatch.setattr(Tables, name, property(lambda self: pytest.fail("not needed")))


def test_careers_take_one_aggregate_and_no_staged_edges(spark, monkeypatch):
    """Pieces are cut where the skill changes, in their order; a person without evidence has no row."""
    _without(monkeypatch, "g")
    t = Tables(spark, D)
    assert t.careers.count() > 0
    plan = E.careers(t.ways, 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_set(piece") == 2 and "collect_list" not in plan  # partial and final
    edges = [("BUILT", "Person", "p", "Project", "a"), ("BUILT", "Person", "q", "Project", "b"), ("DURING", "Project", "a", "Role", "r"), ("AT", "Role", "r", "Company", "c"), ("USED", "Project", "a", "Skill", "x"), ("USED", "Project", "a", "Skill", "y"), ("DEMONSTRATES", "Achievement", "m", "Skill", "x"), ("ACHIEVED", "Project", "a", "Achievement", "m"), ("DEMONSTRATES", "Achievement", "n", "Skill", "x"), ("ACHIEVED", "Project", "a", "Achievement", "n")]
    edges = spark.createDataFrame(edges, "type string, src_label string, src_key string, dst_label string, dst_key string")
    project = spark.createDataFrame([("a", "A"), ("b", "B")], "project_id string, name string")
    role = spark.createDataFrame([("r", "R")], "role_id string, title string")
    education = spark.createDataFrame([], "education_id string, institution string")
    achievement = spark.createDataFrame([("m", "told 20 items"), ("n", None)], "achievement_id string, description string")
    found = E.careers(Graph(None, role, None, project, education, achievement, None, edges)).collect()
    want = [("x", [(None, "strong"), ("told 20 items", "strong"), ("A", "moderate")]), ("y", [("A", "moderate")])]
    assert [r.person_id for r in found] == ["p"]
    assert [(s.canonical_skill, [(p.source, p.evidence_strength) for p in s.pieces]) for s in found[0].skills] == want


def test_reference_projects_need_no_stories(spark, monkeypatch):
    t = Tables.of(spark, D)
    want = rows(P.reference_projects(t.parts, t.g).select("job_id", "person_id", "group_key", "name"))
    _without(monkeypatch, "stories", "parts")
    assert rows(QUERIES["f09_reference_projects"](spark, D)) == want != []


def test_transferable_evidence_comes_with_the_requirements(spark, monkeypatch):
    t = Tables.of(spark, D)
    want = rows(P.transferable_list(t.trans, t.status, t.refs))
    assert rows(P.named(t.parts)) == rows(t.x.select(*P.named(t.parts).columns))
    t.reg  # noqa: B018
    _without(monkeypatch, "refs", "x", "skills")
    got = QUERIES["f19_transferable_list"](spark, D)
    assert rows(got) == want != [] and _leaves(got) == 2  # held requirements and the registry
    fresh = Tables(spark, D)
    fresh.__dict__["parts"] = t.parts
    assert rows(fresh.reg) == rows(t.reg)
