"""Deterministic sharded WARC writer, and a reader that verifies what it reads.

Records are range-sorted by identifier. The ranges are those of a histogram of all records, refined until a shard holds
about ``shard_bytes`` of payload or a single identifier, and depend on the records alone: not on a sample, partitions or
the size of the cluster. Each shard is written by one task, which rolls it into files by compressed size. Every record is a gzip member of its own, with regenerated headers: record ids
come from (page, digest), dates from a parameter, digests from the payload, so that the same input gives the same bytes.
Of records with equal payloads of at least ``min_revisit_bytes`` the smallest identifier is a response and the others
are revisits without payload.

*Commit*: a task writes under a temporary name of its own attempt and renames the finished file; each file is a row of
the manifest (shard, part, path, records, bytes, sha256), written after all tasks succeeded. Readers take files from the
manifest only, so that leftovers of lost or repeated attempts are never read.

Defined cases: null html is an empty payload; a null url leaves its header out; a null ``page_id`` sorts first in the
files and is never the response of a group that has another id; rows repeated with the smallest id are all responses;
an empty table gives no file and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, small, stored, table

MIN_REVISIT_BYTES = 100
ROLL_BYTES = 64 << 20
SHARD_BYTES = 16 << 20
#: Bits of the identifier by which the histogram is refined at a time.
_BITS = 6
#: Files are read by at most so many tasks.
MOST_TASKS = 20_000
DATE = "2000-01-01T00:00:00Z"
_MANIFEST = "shard long, part long, path string, records long, bytes long, sha256 string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f"{page_id} {digest}".encode()).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, uncompressed. A revisit has no payload but its size and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _revisits(pages: DataFrame, least: int) -> DataFrame:
    """pages with columns page_id, url, payload (null for revisits), size, digest, refers_to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("bigint")).withColumn("digest", F.sha2("html", 256))
    groups = rows.filter(F.col("size") >= least).groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.filter("n > 1").drop("n"), "warc-groups")
    rows = rows.join(small(groups), F.col("digest") == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", F.when(~revisit, F.col("html").cast("binary")).alias("payload"), "size", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def shard_edges(rows: DataFrame, shard_bytes: int) -> list[int]:
    """The first identifiers of all shards but the first, in order, for rows (page_id, size). Rows without identifier are in the first."""
    keys = rows.filter("page_id is not null").select(F.col("page_id").bitwiseXOR(F.lit(-(2**63))).alias("u"), (F.col("size") + 500).alias("size"))
    low, high = (None if x is None else x + 2**63 for x in rows.agg(F.min("page_id"), F.max("page_id")).first())
    if low is None:
        return []
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    at = lambda bits: F.shiftrightunsigned("u", bits) if bits < 64 else F.lit(0).cast("bigint")
    # identifiers by their first bits; ranges that are too large are told apart by _BITS more
    bits, part, leaves = (low ^ high).bit_length(), keys, []
    while part is not None:
        below = max(0, bits - _BITS)
        wide = []
        for r in part.groupBy(at(below).alias("first")).agg(F.sum("size").alias("size")).collect():
            first = r["first"] % 2**64
            if below and r["size"] > shard_bytes:
                wide.append(signed(first))
            else:
                leaves.append((first << below, r["size"]))
        bits, part = below, keys.filter(at(below).isin(wide)) if wide else None
    edges, held = [], 0
    for first, size in sorted(leaves):
        if held and held + size > shard_bytes:
            edges.append(first - 2**63)
            held = 0
        held += size
    return edges


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``folder``, which all executors share; returns the manifest."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        fs, root = files.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (files.LocalFileSystem(), folder)
        number, attempt = -1, uuid.uuid4().hex
        out, part, done = None, 0, []

        def close() -> None:
            nonlocal out, part
            out.close()
            name = f"{root}/shard-{number:06d}-{part:05d}.warc.gz"
            fs.move(temporary, name)
            done.append((number, part, name.removeprefix(root), records, size, digest.hexdigest()))
            out, part = None, part + 1

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "size", "digest", "refers_to")]
            shards = batch.column("shard").to_pylist()
            for k in range(batch.num_rows):
                if shards[k] != number:
                    if out is not None:
                        close()
                    number, part = shards[k], 0
                if out is None:
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    temporary = f"{root}/_temporary/{attempt}-{number}-{part}"
                    out, records, size, digest = fs.open_output_stream(temporary), 0, 0, hashlib.sha256()
                data = _gzip(record(*(c[k].as_py() for c in columns), date=date))
                out.write(data)
                digest.update(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "part", "path", "records", "bytes", "sha256"), x, strict=True)) for x in done])

    spark = pages.sparkSession
    sizes = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint").alias("size"))
    edges = shard_edges(sizes, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(edges, np.int64), key.to_numpy(np.int64), "right"))

    rows = _revisits(pages, min_revisit_bytes).withColumn("shard", shard_of(F.coalesce("page_id", F.lit(-(2**63)))))
    rows = rows.repartitionByRange(len(edges) + 1, "shard").sortWithinPartitions("shard", "page_id", "url", "digest", "refers_to")
    manifest = rows.mapInArrow(shard, _MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


def read_warc(spark: SparkSession, folder: str, verify: bool = True) -> DataFrame:
    """The records of the files in the manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Digests, lengths and record counts are verified; a difference raises."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")

    def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
        z, parts = zlib.decompressobj(31), []
        while chunk := stream.read(step):
            while chunk:
                parts.append(z.decompress(chunk))
                chunk = z.unused_data
                if z.eof:
                    yield b"".join(parts)
                    z, parts = zlib.decompressobj(31), []
        if parts:
            raise ValueError("a file ends within a record")

    def parsed(data: bytes) -> tuple:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or verify and "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        http, _, payload = block.partition(b"\r\n\r\n")
        size, digest = int(http.rpartition(b": ")[2]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if fields["WARC-Type"] == "response":
            if len(payload) != size or verify and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
        number = lambda k: int(fields[k]) if k in fields and fields[k] != "None" else None
        url = fields.get("WARC-Target-URI")
        return number("X-Page"), url and urllib.parse.unquote(url) if url and "%" in url else url, size, digest, fields["WARC-Type"], number("X-Refers-To-Page")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        fs, root = files.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (files.LocalFileSystem(), folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                with fs.open_input_stream(root + path, compression=None) as stream:
                    for data in members(stream):
                        rows.append(parsed(data))
                        n += 1
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if n != records:
                    raise ValueError(f"{path} has {n} records; the manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = manifest.count()
    return manifest.repartition(max(1, min(files, MOST_TASKS))).mapInArrow(load, _RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
