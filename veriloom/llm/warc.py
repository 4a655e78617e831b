"""Deterministic sharded WARC archives: written, committed and read back by Spark tasks.

Records are range-sorted by page_id and digest, so every shard holds a range of them in order. The bounds of shards are
exact: they come from running sums of record sizes over all rows, so they depend on the records alone, not on samples,
partitions or settings. A task writes its shards into files
under temporary names, begins a new file once the compressed size passes the limit, and returns one manifest row per
file. Only files of returned rows are renamed to their final names; the manifest, written last, names what is valid. So
lost, repeated or speculative tasks leave nothing but temporary files, which the commit removes.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.base import in_arrow, maybe_broadcast, only, staged

ROLL_BYTES = 64 << 20
#: Payload bytes of a shard; small inputs have shards of 1 MB, up to 64 of them.
SHARD_BYTES, SMALL_SHARD, SMALL_SHARDS = 128 << 20, 1 << 20, 64
HEADER = 600
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "file string, temporary string, shard long, roll long, records long, bytes long, sha256 string, first_page long, last_page long"


def _record_id(page_id: int | None, digest: str, repeat: int = 0) -> str:
    """The id of a page's record; rows that repeat it have ids of their own."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page/{page_id}/{digest}' + f'/{repeat}' * bool(repeat))}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member, the same bytes each time (no time stamp inside)."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, refers_to: int | None, is_revisit: bool, repeat: int = 0) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone; headers and digests are made anew."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest, repeat)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-ID", "" if page_id is None else str(page_id)),
    ]
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    return _member(fields, block)


RECORD = "page_id long, url string, html string, digest string, n long, refers_to long, is_revisit boolean"


def _place(page_id: int | None, digest: str) -> tuple[bool, int, str]:
    """The sort key of a record, nulls first."""
    return page_id is not None, page_id or 0, digest


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows page_id, digest, size -> part, page_id, digest, bytes of the part before the row."""
    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        sizes = b.column(2).to_numpy()
        before = total + np.cumsum(sizes) - sizes
        total += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part), pa.int32()), b.column(0), b.column(1), pa.array(before, pa.int64()), b.column(2)], ["part", "page_id", "digest", "before", "size"])


def _bounds(records: DataFrame, shards: int | None) -> list[tuple[bool, int, str]]:
    """The first record of each shard. The rows are sorted once without their payloads; the driver gets one row for each
    partition, to add up, and one for each shard."""
    ordered = records.repartitionByRange("page_id", "digest").sortWithinPartitions("page_id", "digest")
    summed = staged(ordered.transform(in_arrow, _summed, "part int, page_id long, digest string, before long, size long"), "sizes")
    parts = sorted(summed.groupBy("part").agg(F.sum("size").alias("size")).collect())
    total = sum(p["size"] for p in parts)
    if not total:
        return []
    n = shards or max(-(-total // SHARD_BYTES), min(SMALL_SHARDS, -(-total // SMALL_SHARD)))
    starts = [0, *itertools.accumulate(p["size"] for p in parts)]
    sent = F.broadcast(records.sparkSession.createDataFrame([(p.part, s) for p, s in zip(parts, starts)], "part int, start long"))
    shard = F.floor((F.col("start") + F.col("before")).cast("decimal(38,0)") * n / total).cast("long")
    first = summed.join(sent, "part").groupBy(shard.alias("shard")).agg(F.min(F.struct("page_id", "digest")).alias("x")).select("x.*")
    return sorted({_place(r.page_id, r.digest) for r in first.collect()})


def _dealt(bounds: list[tuple[bool, int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = [bisect.bisect_right(bounds, _place(p, d)) - 1 for p, d in zip(b.column(0).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int64())], [*b.schema.names, "shard"])

    return run


def _write(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, last, repeat, attempt = -1, None, 0, f"{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        store, base = pafs.FileSystem.from_uri(folder)
        done: list[dict] = []
        out = now = hashed = None
        rolls = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                now["sha256"] = hashed.hexdigest()
                done.append(now)
                out = None

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, n, refers_to, is_revisit, of = (batch.column(c)[i].as_py() for c in range(8))
                repeat = repeat + 1 if (page_id, digest) == last else 0
                last = page_id, digest
                if of != shard:
                    close()
                    shard, rolls = of, 0
                if out is None:
                    name = f"shard-{shard:05d}-{rolls:04d}.warc.gz"
                    now = {"file": name, "temporary": f"{name}.{attempt}", "shard": shard, "roll": rolls, "records": 0, "bytes": 0, "first_page": page_id}
                    out, hashed = store.open_output_stream(f"{base}/_temporary/{now['temporary']}", compression=None), hashlib.sha256()
                    info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    hashed.update(info)
                    now["bytes"] += len(info)
                    rolls += 1
                data = record(page_id, url, (html or "").encode(), digest, n, refers_to, is_revisit, repeat)
                out.write(data)
                hashed.update(data)
                now["bytes"] += len(data)
                now["records"] += 1
                now["last_page"] = page_id
                if now["bytes"] >= roll_bytes:
                    close()
        close()
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], k) for c, k in zip(names, kinds)], names)

    return run


def _commit(folder: str):
    """Renames each file of the manifest; repeating it does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                final, temporary = f"{base}/{row['file']}", f"{base}/_temporary/{row['temporary']}"
                if store.get_file_info(temporary).type == pafs.FileType.File:
                    store.move(temporary, final)
                if store.get_file_info(final).size != row["bytes"]:
                    raise OSError(f"{final} is not what its manifest row says")
            yield batch

    return run


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` into ``folder`` (a URI that driver and executors share) and return the manifest.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least 1000 bytes the one with
    the largest page_id is a response and the others revisit it; smaller ones are all responses. Rows that repeat the
    largest page_id are each responses; a null page_id never is the largest. A null url becomes ``urn:page:<id>``. An
    empty table gives an empty manifest. Extra columns are ignored.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    one = only(pages, "page_id", "url", "html").withColumns({"digest": F.sha1(html.cast("binary")), "n": F.octet_length(html).cast("long")})
    one = one.withColumn("page_id", F.col("page_id").cast("long"))
    twins = one.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    twins = staged(twins.where("copies > 1 and first is not null").select("digest", "first"), "twins")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    revisit_of = F.col("is_revisit")
    typed = one.join(maybe_broadcast(twins, 80), "digest", "left").select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "n", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("is_revisit")
    )
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(f"{base}/_temporary", recursive=True)
    bounds = _bounds(typed.select("page_id", "digest", (F.when(revisit_of, 0).otherwise(F.col("n")) + HEADER).alias("size")), shards)
    dealt = typed.transform(in_arrow, _dealt(bounds), f"{RECORD}, shard long")
    ranged = dealt.repartition(max(1, len(bounds)), "shard").sortWithinPartitions("shard", "page_id", "digest", "url")
    written = staged(ranged.transform(in_arrow, _write(folder, roll_bytes), MANIFEST), "archives")
    written.transform(in_arrow, _commit(folder), MANIFEST).write.parquet(f"{folder}/manifest.parquet")
    store.delete_dir(f"{base}/_temporary")
    return pages.sparkSession.read.schema(written.schema).parquet(f"{folder}/manifest.parquet")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed records of an archive, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            data = z.unused_data
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
            data = data or stream.read(chunk)
        else:
            data = stream.read(chunk)
    if parts:
        raise OSError("the archive ends inside a record")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        block = rest[: int(fields["Content-Length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        if fields["WARC-Block-Digest"] != _sha1(block) or kind == "response" and (n, digest) != (len(payload), hashlib.sha1(payload).hexdigest()):
                            raise OSError(f"{name}: a digest or length of {fields['WARC-Record-ID']} doesn't hold")
                        page, other = fields["Page-ID"], fields.get("Refers-To-Page-ID")
                        rows.append((int(page) if page else None, fields["WARC-Target-URI"], n, digest, kind, int(other) if other else None, payload.decode() if kind == "response" else None))
                        size += len(payload)
                        if size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives that the manifest in ``folder`` names; every digest and length is checked again."""
    files = spark.read.parquet(f"{folder}/manifest.parquet").select("file")
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.transform(in_arrow, _read(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def new_folder(shared: str) -> str:
    """A fresh folder URI below the shared one."""
    uri = shared if "://" in shared or shared.startswith("file:") else "file://" + os.path.abspath(shared)
    return f"{uri.replace('file:///', 'file:/').replace('file:/', 'file:///')}/warc-{uuid.uuid4().hex}"


ORACLE = """
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to FROM m
"""
