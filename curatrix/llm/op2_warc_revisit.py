"""WARC archives with revisit resolution.

Headers (id, digest, length) are shuffled by payload digest; the smallest id of each digest is the
original, and the other headers are joined to it as revisits. Payloads stay where they are read:
revisits are known by id and digest, and where these have been measured to be few they are broadcast and
no payload moves at all; else a shuffle joins payloads to the ids that are responses. Revisits are
written from their headers. Every record gets fresh headers, and is a gzip member of its own, so that
readers can start at any record; each file begins with a warcinfo record. The writer is Spark's, with an
empty gzip member as its line separator, so archives are committed like any table. They are read back
by a parser that takes a member at a time, follows Content-Length and verifies each response's digest.

Defined results
- a null page is an empty payload; empty payloads take part like any other (MIN_REVISIT_BYTES = 0);
- rows that tie for the smallest id of a digest (repeats of one row) are all responses, with record ids
  of their own; a null id sorts before all others and is written as an empty id;
- rows that share an id but not a payload are told apart by their digest;
- a payload of any length is one record; null urls are written as `urn:none`;
- an empty table gives archives without pages; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, by_place, shared_dir, small_side, staged, table

MIN_REVISIT_BYTES = 0
#: Bytes of an archive, and the blocks it is written in.
FILE_BYTES = 128 << 20
BLOCKS = 16

#: The profile of WARC/1.1 for identical payloads, and a gzip member that holds nothing.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + "\x00" * 8
WRITTEN = "2024-01-01T00:00:00Z"


def _payloads(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    flat, at = by_place(pages)
    return flat.select(
        F.coalesce(F.col(at[page_id]).cast("bigint"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(at[url]), F.lit("urn:none")).alias("url"),
        F.encode(F.coalesce(F.col(at[html]), F.lit("")), "UTF-8").alias("payload"),
    )


def resolve(headers: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """headers (id, url, sha1, n_bytes) with refers_to and refers_url, the original's id and url, for revisits, else null."""
    # Partial aggregation brings a digest that a third of all pages share down to a row a task.
    originals = headers.where(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.min(F.struct("id", "url")).alias("first"), F.max("id").alias("last"))
    originals = originals.where(F.col("first.id") < F.col("last")).select("sha1", "first")
    joined = headers.join(originals, "sha1", "left")
    again = (F.col("n_bytes") >= min_bytes) & (F.col("id") > F.col("first.id"))
    return joined.withColumn("refers_to", F.when(again, F.col("first.id"))).withColumn("refers_url", F.when(again, F.col("first.url"))).drop("first")


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%20" for c in url)


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(':'.join(map(str, parts)).encode('utf-8', 'surrogatepass')).digest())}>"


def _id(n: int) -> str:
    return "" if n == NULL_ID else str(n)


def _member(head: list[str], block: bytes = b"") -> bytes:
    """A record as one gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    return z.compress(text.encode("utf-8", "surrogatepass")) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _writer(path: str, kind: str, block_bytes: int):
    """Records of a task's rows, in blocks that end with the record that fills them; the first is a warcinfo record. A task that has no rows writes none."""

    def block_of(records):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(records)], pa.binary())], names=["records"])

    def run(batches):
        part, n, out, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            if b.num_rows and not n:
                info = b"software: curatrix\r\nformat: WARC File Format 1.1\r\n"
                out.append(_member(["WARC-Type: warcinfo", f"WARC-Record-ID: {_urn(path, kind, part)}", f"WARC-Date: {WRITTEN}", "Content-Type: application/warc-fields"], info))
            for i, row in enumerate(zip(*(b.column(c) for c in ("id", "url", "sha1", "n_bytes", "refers_to", "refers_url", "tied", "payload")), strict=True)):
                rid, url, sha1, n_bytes, to, to_url, tied, payload = (x.as_py() for x in row)
                own = _urn("page", rid, sha1) if kind == "revisit" or not tied else _urn("page", rid, sha1, part, n + i)
                head = [
                    f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {WRITTEN}", f"WARC-Target-URI: {_uri(url)}", f"X-Page-ID: {_id(rid)}",
                    f"X-Payload-Length: {n_bytes}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
                ]
                if kind == "revisit":
                    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_uri(to_url)}", f"WARC-Refers-To-Date: {WRITTEN}", f"X-Refers-To-Page-ID: {_id(to)}"]
                    head += [] if tied else [f"WARC-Refers-To: {_urn('page', to, sha1)}"]
                    block = b""
                else:
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + payload
                out.append(_member([*head, "Content-Type: application/http;msgtype=response"], block))
                size += len(out[-1])
                if size > block_bytes:
                    yield block_of(out)
                    out, size = [], 0
            n += b.num_rows
        if out:
            yield block_of(out)

    return run


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES, broadcast_bytes: int = 32 << 20, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes de-duplicated archives below path; returns the header ledger (id, url, sha1, n_bytes, refers_to, refers_url, tied).

    A task goes on to another file after BLOCKS blocks of records, so a file holds file_bytes and, for each
    block, the record that filled it at most; readers take a file whole.

    tied tells that several rows are the original: those get record ids of their own, and revisits name its address only.
    """
    source = _payloads(pages, page_id, url, html).withColumn("sha1", F.sha1("payload"))
    ledger = staged(resolve(source.select("id", "url", "sha1", F.length("payload").cast("bigint").alias("n_bytes")), min_bytes), "warc-headers")
    # Rows that share id and payload are repeats, so there are few, if any.
    ties = staged(ledger.where("refers_to IS NULL").groupBy("id", "sha1").agg(F.count("*").alias("n")).where("n > 1").select("id", "sha1", F.lit(True).alias("tied")), "warc-ties")
    none = ties.isEmpty()

    def with_ties(df: DataFrame, key: str) -> DataFrame:
        if none:
            return df.withColumn("tied", F.lit(False))
        return df.join(small_side(ties.withColumnRenamed("id", key), broadcast_bytes, "80"), [key, "sha1"], "left").withColumn("tied", F.coalesce("tied", F.lit(False)))

    revisits = ledger.where("refers_to IS NOT NULL")
    known = revisits.select("id", "sha1").distinct()
    side = small_side(known, broadcast_bytes, "80")
    # Without a broadcast the ids of responses are the side that a shuffle joins: what matches nothing there goes.
    if side is known:
        responses = source.join(ledger.where("refers_to IS NULL").select("id", "sha1").distinct(), ["id", "sha1"], "left_semi")
    else:
        responses = source.join(side, ["id", "sha1"], "left_anti")
    null = lambda kind: F.lit(None).cast(kind)
    responses = with_ties(responses, "id").select("id", "url", "sha1", F.length("payload").cast("bigint").alias("n_bytes"), null("bigint").alias("refers_to"), null("string").alias("refers_url"), "tied", "payload")
    again = with_ties(revisits, "refers_to").select("id", "url", "sha1", "n_bytes", "refers_to", "refers_url", "tied", null("binary").alias("payload"))
    for kind, rows in (("response", responses), ("revisit", again)):
        blocks = rows.mapInArrow(_writer(path, kind, file_bytes // BLOCKS), "records binary").select(F.col("records").cast("string"))
        blocks.write.options(lineSep=EMPTY_MEMBER, encoding="ISO-8859-1", maxRecordsPerFile=BLOCKS).text(f"{path}/{kind}")
    return with_ties(ledger, "id")


def members(data: bytes):
    """The contents of each gzip member, one at a time."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z = zlib.decompressobj(31)
        out, end = [], at
        while not z.eof:
            if end >= len(data):
                raise ValueError(f"the gzip member at byte {at} is cut off")
            out.append(z.decompress(view[end : end + (1 << 13)]))
            end += 1 << 13
        at = min(end, len(data)) - len(z.unused_data)
        yield b"".join(out)


def parse_records(data: bytes):
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        start = end + 4
        stop = start + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield head, data[start:stop]
        at = stop + 4


_READ_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _read(batches):
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    number = lambda x: int(x) if x else None
    for b in batches:
        for content in b.column("content"):
            rows = []
            for record in members(content.as_py()):
                for head, block in parse_records(record):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"page {head['X-Page-ID']}: the payload doesn't match its digest")
                    rows.append((number(head["X-Page-ID"]), head["WARC-Target-URI"], size, digest, kind, number(head.get("X-Refers-To-Page-ID"))))
            cols = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, each response's payload checked against its digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_read, _READ_SCHEMA)


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the records of the archives that hold all pages."""
    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda g:
           array_to_string(list_transform([32768, 1024, 32, 1], lambda s:
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(g * 5 + 1 AS INT), 5) AS BIGINT) // s) % 32 + 1 AS INT), 1)), '')), '') AS payload_digest
  FROM p
), f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f ON d.payload_digest = f.payload_digest
"""
