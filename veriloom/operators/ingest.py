"""Ingest and staging: seed documents, upserts, validation, sources and sinks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.sources.graph import EDGE_TYPES, LABELS
from veriloom.sources.staging import tidy

IMPORTANCE = ["required", "preferred", "inferred"]
CATEGORY = ["technology", "capability", "soft_skill", "domain"]
CAPABILITY_SOURCE = ["graph_vocabulary", "llm_semantic"]

_TEXT = "map<string,string>"
SEED = f"person {_TEXT}, " + ", ".join(f"{s} array<{_TEXT}>" for s in ("roles", "companies", "projects", "education", "achievements", "skills")) + ", relationships array<struct<type:string,`from`:struct<label:string,key:string>,`to`:struct<label:string,key:string>>>"
SECTIONS = {"roles": ("Role", "roleId"), "companies": ("Company", "name"), "projects": ("Project", "projectId"), "education": ("Education", "educationId"), "achievements": ("Achievement", "achievementId"), "skills": ("Skill", "name")}
REQUIREMENT_LIST = "requirements array<struct<raw:string,skillQuery:string,importance:string,category:string,relatedCapabilities:array<struct<skillQuery:string,reason:string,source:string>>>>"


def read_graph(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Seed documents -> ``nodes(label, key, props)`` and ``edges``; a missing section is empty, lists are kept as JSON.

    A file is one document, or one a line without ``multi_line`` (which also lets Spark split it).
    """
    doc = spark.read.schema(SEED).json(path, multiLine=multi_line)
    nodes = doc.where("person is not null").select(F.lit("Person").alias("label"), F.col("person")["personId"].alias("key"), F.col("person").alias("props"))
    for section, (label, key) in SECTIONS.items():
        one = doc.select(F.explode(section).alias("p"))
        nodes = nodes.unionByName(one.select(F.lit(label).alias("label"), F.col("p")[key].alias("key"), F.col("p").alias("props")))
    r = doc.select(F.explode("relationships").alias("r"))
    edges = r.select("r.type", F.col("r.from.label").alias("src_label"), F.col("r.from.key").alias("src_key"), F.col("r.to.label").alias("dst_label"), F.col("r.to.key").alias("dst_key"))
    return nodes, edges


def upsert_nodes(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Create or overlay ``(label, key, props)`` by ``delta(label, key, props, seq)``.

    A property that the delta doesn't name is kept, one that it names as null is removed, no node is deleted. Of several
    rows of one node the later ones overlay the earlier ones, property by property.
    """
    items = delta.where("props is not null").select("label", "key", "seq", F.explode("props").alias("k", "v")).groupBy("label", "key", "k").agg(F.max_by(F.struct("v"), "seq").alias("x"))
    items = items.groupBy("label", "key").agg(F.map_from_entries(F.collect_list(F.struct("k", "x.v"))).alias("new"))
    named = delta.select("label", "key").distinct().join(items, ["label", "key"], "left")
    both = base.withColumnRenamed("props", "old").join(named, ["label", "key"], "full_outer")
    empty = F.create_map().cast(_TEXT)
    old, new = F.coalesce("old", empty), F.coalesce("new", empty)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return both.select("label", "key", F.map_concat(kept, F.map_filter(new, lambda k, v: v.isNotNull())).alias("props"))


def upsert_edges(nodes: DataFrame, base: DataFrame, delta: DataFrame) -> DataFrame:
    """All edges once; a new one only if both of its ends exist."""
    known = nodes.select("label", "key").distinct()
    fresh = delta
    for side in ("src", "dst"):
        fresh = fresh.join(known.select(F.col("label").alias(f"{side}_label"), F.col("key").alias(f"{side}_key")), [f"{side}_label", f"{side}_key"], "left_semi")
    return base.unionByName(fresh.select(base.columns)).dropDuplicates(["type", "src_label", "src_key", "dst_label", "dst_key"])


def rejected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, name, key`` of nodes and edges with a label or type that isn't known."""
    bad = nodes.where(~F.coalesce(F.col("label").isin(list(LABELS)), F.lit(False))).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "key")
    ok = F.col("type").isin(EDGE_TYPES) & F.col("src_label").isin(list(LABELS)) & F.col("dst_label").isin(list(LABELS))
    wrong = edges.where(~F.coalesce(ok, F.lit(False))).select(F.lit("edge").alias("kind"), F.col("type").alias("name"), F.concat_ws(">", "src_key", "dst_key").alias("key"))
    return bad.unionByName(wrong)


def assert_allowed(nodes: DataFrame) -> DataFrame:
    """The nodes, failing on the first unknown label when they are read."""
    known = F.coalesce(F.col("label").isin(list(LABELS)), F.lit(False))
    return nodes.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))).cast("boolean")))


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """``label, key, n`` of keys that several nodes of a label have; null keys don't count."""
    return nodes.where("key is not null").groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")


def parse_requirements(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lists(job_id, json)`` -> valid requirements and rejected lists.

    A list with another shape, a missing field or an unknown value is rejected as a whole; an empty list is valid.
    """
    j = F.from_json("json", REQUIREMENT_LIST + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    one = lists.select("job_id", "json", j.alias("j"))

    def wrong(r):
        missing = r["raw"].isNull() | r["skillQuery"].isNull() | ~F.coalesce(r["importance"].isin(IMPORTANCE), F.lit(False)) | ~F.coalesce(r["category"].isin(CATEGORY), F.lit(False))
        caps = F.exists(F.coalesce(r["relatedCapabilities"], F.array().cast("array<struct<skillQuery:string,reason:string,source:string>>")), lambda c: c["skillQuery"].isNull() | c["reason"].isNull() | ~F.coalesce(c["source"].isin(CAPABILITY_SOURCE), F.lit(False)))
        return r.isNull() | missing | caps

    bad = F.col("j").isNull() | F.col("j._bad").isNotNull() | F.col("j.requirements").isNull() | F.coalesce(F.exists("j.requirements", wrong), F.lit(False))
    valid = one.where(~bad).select("job_id", F.posexplode("j.requirements").alias("seq", "r"))
    valid = valid.select("job_id", "seq", "r.raw", F.col("r.skillQuery").alias("skill_query"), "r.importance", "r.category", F.transform(F.coalesce("r.relatedCapabilities", F.array().cast("array<struct<skillQuery:string,reason:string,source:string>>")), lambda c: F.struct(c["skillQuery"].alias("skill_query"), c["reason"].alias("reason"), c["source"].alias("source"))).alias("related"))
    return valid, one.where(bad).select("job_id", "json")


JOB_BYTES = 1 << 20


def job_files(spark: SparkSession, path: str, most: int = JOB_BYTES) -> DataFrame:
    """Job texts, one a file -> ``job_id, text, reason``. ``reason`` says why a file is rejected: ``too_large`` (more than
    ``most`` bytes), ``undecodable`` (no UTF-8) or ``blank``; the text of such a file is missing. ``job_id`` is the name of
    the file; files without bytes have no row, as Spark doesn't list them.

    The sizes come from the listing, so a file that is too large is never read; the others are read once, as bytes, and
    decoded afterwards, so a broken one is a row and not a failure.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    job = F.regexp_extract("path", r"([^/]*)\.txt$", 1).alias("job_id")
    text = F.col("content").cast("string")
    read = files.where(F.col("length") <= most).select(job, text.alias("text"), F.is_valid_utf8(text).alias("valid"))
    blank = F.regexp_replace("text", r"(?U)\s+", "") == ""
    read = read.select("job_id", "text", F.when(~F.col("valid"), "undecodable").when(blank, "blank").alias("reason"))
    large = files.where(F.col("length") > most).select(job, F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("reason"))
    return read.withColumn("text", F.when(F.col("reason").isNull(), F.col("text"))).unionByName(large)


def read_jobs(spark: SparkSession, path: str, most: int = JOB_BYTES) -> tuple[DataFrame, DataFrame]:
    """:func:`job_files` as the texts, ``job_id, text``, and the rejected files, ``job_id, reason``; each reads the files."""
    every = job_files(spark, path, most)
    return every.where("reason is null").select("job_id", "text"), every.where("reason is not null").select("job_id", "reason")


#: Folders that job files are dealt over: with so many, Spark lists them in tasks.
FOLDERS = 64


def write_job_files(texts: DataFrame, path: str) -> None:
    """``texts(job_id, text)`` as files that :func:`read_jobs` reads, ``<job_id>.txt`` in UTF-8, dealt over folders by the
    hash of the job. Tasks write them one by one, so the path is one that ``pyarrow.fs`` opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        n = 0
        for b in batches:
            for folder, job, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                with store.open_output_stream(f"{root}/{folder}/{job}.txt") as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    store, root = fs.FileSystem.from_uri(path)
    for folder in range(FOLDERS):
        store.create_dir(f"{root}/{folder}", recursive=True)
    folder = F.pmod(F.xxhash64("job_id"), F.lit(FOLDERS)).alias("folder")
    texts.select(folder, "job_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def not_blank(texts: DataFrame) -> DataFrame:
    """Texts with something besides white space."""
    return texts.where(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") != "")


#: Documents that sinks write: requirements, context, package and structured document.
KINDS = ("requirements", "context", "package", "document")
#: Ranges of the hash of job ids, as a power of two, and records of a file at most.
LOG_RANGES, FILE_RECORDS = 12, 10_000


def _range(job_id="job_id"):
    return F.shiftrightunsigned(F.xxhash64(job_id), 64 - LOG_RANGES)


def job_of(line: Column | str) -> Column:
    """The job of a written document, which is its first field: what follows isn't parsed."""
    return F.get_json_object(F.concat(F.regexp_extract(line, r'^\{"job_id":"[^"\\]*+(?:\\.[^"\\]*+)*+"', 0), F.lit("}")), "$.job_id")


def write_documents(df: DataFrame, path: str, kind: str, records: int = FILE_RECORDS) -> None:
    """``df(job_id, ...)`` as JSON documents of a kind, one a line, nulls and the order of lists kept; files are compressed, as
    documents repeat the same names and evidence many times.

    Documents are dealt by ranges of the hash of their job, so their files are few however many jobs there are; a file
    has ``records`` at most. A manifest, written last, names each file with its ranges and counts its documents: a run that
    was lost on the way has none, and what it left is never read. Writing a kind again replaces it for readers, as the
    latest manifest counts.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of document {kind!r}")
    spark, run = df.sparkSession, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    data = f"{path}/{kind}/data-{run}"
    dealt = df.select("job_id", *[c for c in df.columns if c != "job_id"]).withColumn("_range", _range())
    dealt = dealt.repartitionByRange("_range").sortWithinPartitions("_range", "job_id").drop("_range")
    with tidy(spark):
        dealt.write.option("ignoreNullFields", "false").option("maxRecordsPerFile", records).option("compression", "gzip").json(data)
    # each line's job is enough for the manifest; nothing else is parsed
    lines = spark.read.text(data).select(F.col("_metadata.file_name").alias("file"), _range(job_of("value")).alias("range"))
    files = lines.groupBy("file").agg(F.count("*").alias("n"), F.min("range").alias("low"), F.max("range").alias("high"))
    files.select(F.lit(run).alias("run"), "file", "n", "low", "high").coalesce(1).write.mode("append").json(f"{path}/{kind}/manifest")


def manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``run, file, n, low, high`` of the latest committed run of a kind."""
    every = spark.read.schema("run string, file string, n long, low long, high long").json(f"{path}/{kind}/manifest")
    latest = every.agg(F.max("run").alias("run"))
    return every.join(F.broadcast(latest), "run", "left_semi")  # one row


def read_staged(spark: SparkSession, path: str, kind: str, schema, jobs: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Staged documents of a kind under a schema; strict reading fails on a document of another shape. With ``jobs``, only
    files whose ranges can hold one of them are opened."""
    known = manifest(spark, path, kind)
    run = known.agg(F.max("run")).first()[0]
    if run is None:
        raise FileNotFoundError(f"no committed documents of kind {kind!r} in {path}")
    data = f"{path}/{kind}/data-{run}"
    files: list[str] | str = data
    if jobs is not None:
        wanted = spark.createDataFrame([(j,) for j in jobs], "job_id string").select(_range().alias("range")).distinct()
        hit = known.join(wanted, (F.col("low") <= F.col("range")) & (F.col("range") <= F.col("high")), "left_semi")
        files = [f"{data}/{r.file}" for r in hit.select("file").collect()]  # those of the given jobs
    if not files:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(files)
    return found if jobs is None else found.where(F.col("job_id").isin(jobs))
