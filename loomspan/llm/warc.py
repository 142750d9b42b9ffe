"""WARC archives: writing, a normaliser for whole-file gzip streams, and reading back by offset index.

Archives are tables of binary chunks (archive, chunk, data) below the shared folder, so they live in
any store Spark can write, and Spark's commit protocol covers lost executors; `export` writes plain
files. The normaliser inflates a whole-file stream once, from chunk to chunk, rewrites each record as
a gzip member of its own and notes the member's offset: the sidecar index is (archive, record,
record_id, offset, length), and any record can then be read without the ones before it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import batches, only, pin, small, stored

#: Payloads from this size on are stored once; bytes of an archive before compression; bytes of a chunk.
REVISIT_BYTES, ARCHIVE_BYTES, CHUNK_BYTES = 1000, 16 << 20, 1 << 20
LEVEL, GZIP = 1, 31
_ID = "urn:page:"


def record(page_id: str | None, url: str | None, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; with `refers_to` a revisit, whose block has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else quote(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{quote(refers_to)}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The plain bytes of a gzip stream of one or more members, a chunk at a time."""
    d = zlib.decompressobj(GZIP)
    for data in chunks:
        while data:
            yield d.decompress(data)
            data = d.unused_data
            if d.eof:
                d = zlib.decompressobj(GZIP)


def records(plain: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records cut from a stream of plain bytes; holds no more than a record and a chunk."""
    held = bytearray()
    need = 0
    for part in plain:
        held += part
        while len(held) >= need:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
                continue
            yield bytes(held[:need])
            del held[:need]
            need = 0
            if not held:
                break
    if held.strip():
        raise ValueError("the archive ends within a record")


def member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return c.compress(data) + c.flush()


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, sha1, refers_to: which records are revisits, and of which page."""
    rows = only(pages, page_id=id_col, url=url_col, html=html_col).select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    same = rows.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(small(same), "sha1", "left")
    return joined.select("page_id", "url", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Whole-file gzip archives of the rows of `decided`: archive, chunk, data. No rows: no archives."""
    batches(rows.sparkSession, 500)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, chunk, size = TaskContext.get().partitionId() << 24, 0, 0
        gz, held = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), bytearray()

        def out() -> pa.RecordBatch:
            nonlocal held, chunk
            b = pa.RecordBatch.from_arrays([pa.array([archive], pa.int64()), pa.array([chunk], pa.int32()), pa.array([bytes(held)], pa.binary())], ["archive", "chunk", "data"])
            held, chunk = bytearray(), chunk + 1
            return b

        for b in it:
            for page_id, url, payload, sha1, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = record(None if page_id is None else str(page_id), url, payload, sha1, None if refers is None else str(refers))
                held += gz.compress(data)
                size += len(data)
                if size >= archive_bytes:
                    held += gz.flush()
                    yield out()
                    archive, chunk, size, gz = archive + 1, 0, 0, zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                elif len(held) >= CHUNK_BYTES:
                    yield out()
        if size:
            held += gz.flush()
            yield out()

    return rows.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(run, "archive long, chunk int, data binary")


def _numbered(archives: DataFrame) -> DataFrame:
    """archive, nth (int, from 0 without gaps): numbered by the task that wrote them, then in order."""
    ids = archives.select("archive", F.shiftright("archive", 24).alias("task")).distinct()
    own = ids.withColumn("own", F.row_number().over(Window.partitionBy("task").orderBy("archive")) - 1)
    tasks = ids.groupBy("task").agg(F.count("*").alias("n"))  # one row for each task
    before = tasks.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return own.join(small(before), "task").select("archive", (F.col("own") + F.col("before")).cast("int").alias("nth"))


def normalise(archives: DataFrame) -> DataFrame:
    """archive, record, record_id, offset, length, data: each record as a gzip member of its own.

    An archive's chunks come together, in order, in one task; archives are bounded in size. No archives: no members.
    """
    spark = archives.sparkSession
    batches(spark, 500)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((a, d) for b in it for a, d in zip(b.column("archive").to_pylist(), b.column("data").to_pylist(), strict=True))
        ahead = next(rows, None)
        while ahead:
            archive, at, out = ahead[0], 0, []

            def chunks() -> Iterator[bytes]:
                nonlocal ahead
                while ahead and ahead[0] == archive:  # noqa: B023
                    yield ahead[1]
                    ahead = next(rows, None)

            for n, data in enumerate(records(inflate(chunks()))):
                gz = member(data)
                out.append((archive, n, headers(data[: data.index(b"\r\n\r\n")])["warc-record-id"], at, len(gz), gz))
                at += len(gz)
                if len(out) == 500:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
    names = ["archive", "record", "record_id", "offset", "length", "data"]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    numbered = pin(_numbered(archives))
    total = max(1, numbered.count())
    placed = archives.join(small(numbered), "archive").repartitionById(total, "nth")  # a task for each archive
    ordered = placed.sortWithinPartitions("archive", "chunk").select("archive", "chunk", "data")
    return ordered.mapInArrow(run, "archive long, record int, record_id string, offset long, length int, data binary")


def index(members: DataFrame) -> DataFrame:
    """The sidecar index of normalised archives."""
    return members.select("archive", "record", "record_id", "offset", "length")


def read(members: DataFrame) -> DataFrame:
    """Records from their members: page_id (text), url, payload_bytes, payload_digest, record_type, refers_to (text), payload.

    A response's payload is measured and hashed anew and must agree with its headers; a revisit has no
    payload of its own, so its headers tell the size and digest of the one it refers to. No members: no records.
    """
    from urllib.parse import unquote

    batches(members.sparkSession, 500)

    def page(uri: str | None) -> str | None:
        return unquote(uri[1:-1].removeprefix(_ID)) or None if uri else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for b in it:
            out = []
            for data in b.column("data").to_pylist():
                plain = zlib.decompress(data, GZIP)
                head, _, rest = plain.partition(b"\r\n\r\n")
                h = headers(head)
                http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
                size = int(headers(http)["content-length"])
                sha1 = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                if h["warc-type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, sha1):
                    raise ValueError(f"payload of {h['warc-record-id']} does not agree with its headers")
                url = h.get("warc-target-uri")
                out.append((page(h["warc-record-id"]), None if url is None else unquote(url), size, sha1, h["warc-type"], page(h.get("warc-refers-to")), payload))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return members.select("data").mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def export(members: DataFrame, folder: str) -> None:
    """Write normalised archives and their indexes as files <archive>.warc.gz and .idx below a mounted folder."""

    def run(rows: Iterator) -> None:
        for r in rows:
            base = Path(folder) / str(r.archive)
            with open(f"{base}.warc.gz", "wb" if r.record == 0 else "ab") as f:
                f.write(r.data)
            with open(f"{base}.idx", "w" if r.record == 0 else "a") as f:
                f.write(f"{r.record_id}\t{r.offset}\t{r.length}\n")

    members.repartition("archive").sortWithinPartitions("archive", "record").foreachPartition(run)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html counts as empty. Of repeated page ids with one payload, none revisits another. No pages: no rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = stored(write(decided(pages)), compression="none")
    got = read(stored(normalise(archives), compression="none"))
    kind = pages.schema["page_id"].dataType
    return got.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT html, max(page_id) AS first FROM p WHERE n >= {REVISIT_BYTES} GROUP BY html)
SELECT page_id, n::bigint AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html"""
