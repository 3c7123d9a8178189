"""Line de-duplication by range-partitioned hashes, returning compressed keep bitmaps.

Lines are reduced to a 128-bit hash of their key, range-partitioned by (hash, document) and sorted
by (hash, document descending, position). One pass over each sorted partition finds, for every
hash, the first occurrence (the largest document) and which later ones go. A hash held by a third
of all documents spreads over many ranges, as the document is part of the range key; a run that
crosses a range border is settled from one summary row for each border.

Defined results
- a null or empty text is one empty line; an empty table gives an empty result;
- a null document id counts as the smallest id;
- rows that share an id count as one document, each keeping or losing its own lines;
- a text of any length is cut into its lines by Spark, and only their hashes move;
- other columns are carried along by place, whatever their names; the findings come in one struct,
  named `_line_dedup` or with underscores before that if the name is taken.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, NULL_ID, Kept, ascii_lower, by_place, free_name, small_side, staged, table

MIN_CHARS = 20
MIN_DOCS = 3

_DROP, _OPEN, _BORDER = 0, 1, 2
_STREAM_SCHEMA = "kind int, h binary, doc bigint, row bigint, pos int, fresh int"


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, row, text): row tells apart rows that share an id."""
    flat, at = by_place(docs)
    return flat.select(
        F.coalesce(F.col(at[doc_id]).cast("bigint"), F.lit(NULL_ID)).alias("doc"),
        F.xxhash64(at[text]).alias("row"),
        F.coalesce(F.col(at[text]), F.lit("")).alias("text"),
    )


def _lines(keyed: DataFrame, min_chars: int) -> DataFrame:
    lines = keyed.select("doc", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(ASCII_SPACE)))
    return (
        lines.select("doc", "row", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.unhex(F.md5(F.encode("key", "UTF-8"))).alias("h"), "doc", "row", "pos")
    )


class _Runs:
    """State of one sorted partition: the run (equal hashes) that is open at the end of the last batch."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.h: bytes | None = None
        self.docs = 0
        self.last = self.top = 0
        self.first_run = True
        self.held: list[tuple[np.ndarray, ...]] = []  # rows of a run with fewer than min_docs documents so far

    def feed(self, h: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray):
        """h as an array of 16-byte strings; yields column tuples of the output."""
        n = len(h)
        new_run = np.empty(n, bool)
        new_run[1:] = h[1:] != h[:-1]
        new_run[0] = self.h is None or bytes(h[0]) != self.h
        starts = np.flatnonzero(new_run)
        bounds = np.concatenate(([0], starts[starts > 0], [n]))
        single = np.diff(bounds) == 1
        for i in range(len(bounds) - 1):
            a, z = bounds[i], bounds[i + 1]
            if new_run[a]:
                if self.h is not None:
                    yield from self.close(last=False)
                if single[i] and i + 2 < len(bounds) and not self.first_run:
                    self.h = None  # a lone row that no other follows
                    continue
                self.h, self.docs, self.top, self.held = bytes(h[a]), 0, int(doc[a]), []
                fresh0 = True
            else:
                fresh0 = int(doc[a]) != self.last
            d = doc[a:z]
            fresh = np.empty(z - a, bool)
            fresh[1:] = d[1:] != d[:-1]
            fresh[0] = fresh0
            rank = self.docs + np.cumsum(fresh)
            self.docs, self.last = int(rank[-1]), int(d[-1])
            part = (d, row[a:z], pos[a:z], fresh)
            if self.first_run:
                yield self.rows(_OPEN, *part, h=self.h)
                continue
            later = rank > 1
            part = tuple(x[later] for x in part)
            if self.docs >= self.min_docs:
                for kept in [*self.held, part]:
                    yield self.rows(_DROP, *kept)
                self.held = []
            elif len(part[0]):
                self.held.append(part)

    def close(self, last: bool):
        """Ends the open run; the first and the last run of a partition may go on elsewhere."""
        if self.h is None:
            return
        if self.first_run or last:
            yield [_BORDER], [self.h], [self.top], [0], [0], [self.docs]
            for part in self.held:
                yield self.rows(_OPEN, *part, h=self.h)
        self.first_run = False
        self.h, self.held = None, []

    @staticmethod
    def rows(kind, doc, row, pos, fresh, h=None):
        n = len(doc)
        return [kind] * n, [h] * n, doc, row, pos, fresh.astype(np.int32)


def _stream(min_docs: int):
    schema = pa.schema([("kind", pa.int32()), ("h", pa.binary()), ("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("fresh", pa.int32())])

    def batch(parts) -> pa.RecordBatch:
        cols = [[x for p in parts for x in (p[0])], [x for p in parts for x in p[1]]]
        rest = [np.concatenate([np.asarray(p[k], dtype=t) for p in parts]) for k, t in ((2, np.int64), (3, np.int64), (4, np.int32), (5, np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), *map(pa.array, rest)], schema=schema)

    def run(batches):
        state = _Runs(min_docs)
        for b in batches:
            if not b.num_rows:
                continue
            h = np.array(b.column("h").cast(pa.binary(16)).to_numpy(zero_copy_only=False), dtype="V16")
            out = list(state.feed(h, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row", "pos"))))
            if out:
                yield batch(out)
        if out := list(state.close(last=True)):
            yield batch(out)

    return run


def dropped_lines(docs: DataFrame, keep: Kept, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, pos) of every line that goes."""
    # Kept, as the ranges are sampled from the rows before the rows are dealt to them.
    lines = keep(_lines(_keyed(docs, doc_id, text), min_chars))
    spread = lines.repartitionByRange(F.col("h"), F.col("doc").desc()).sortWithinPartitions(F.col("h"), F.col("doc").desc(), F.col("pos"))
    found = keep(spread.mapInArrow(_stream(min_docs), _STREAM_SCHEMA))
    # Two rows for each range at most, so the number of ranges bounds what is broadcast.
    border = found.where(F.col("kind") == _BORDER).groupBy("h").agg(F.sum("fresh").alias("n"), F.max("doc").alias("top")).where(F.col("n") >= min_docs)
    settled = found.where(F.col("kind") == _OPEN).join(F.broadcast(border), "h").where(F.col("doc") < F.col("top"))
    return found.where(F.col("kind") == _DROP).select("doc", "row", "pos").unionByName(settled.select("doc", "row", "pos"))


def pack_bitmap(n_lines: int, dropped) -> bytes:
    """A zlib-compressed bitmap with a 1 for each line that stays, the first line in the highest bit."""
    bits = np.ones(n_lines, np.uint8)
    bits[np.asarray(dropped, dtype=np.int64)] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def unpack_bitmap(data: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n_lines).astype(bool)


@F.pandas_udf(T.BinaryType())
def _bitmaps(n_lines, dropped):
    import pandas as pd

    return pd.Series([None if d is None else pack_bitmap(int(n), d) for n, d in zip(n_lines, dropped, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _kept_text(text, bitmap):
    import pandas as pd

    out = []
    for t, b in zip(text, bitmap, strict=True):
        if b is None:
            out.append(None)
            continue
        lines = t.split("\n")
        out.append("\n".join(x for x, k in zip(lines, unpack_bitmap(b, len(lines)), strict=True) if k))
    return pd.Series(out, dtype=object)


def keep_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each document that loses lines: doc, row, n_dropped and the compressed keep bitmap.

    A document that is not in the result keeps every line. (doc, row) is the id and the 64-bit hash of the text.
    """
    keep = Kept()
    drops = dropped_lines(docs, keep, doc_id=doc_id, text=text, min_chars=min_chars, min_docs=min_docs)
    lists = drops.groupBy("doc", "row").agg(F.collect_set("pos").alias("at"))
    sizes = _keyed(docs, doc_id, text).select("doc", "row", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n")).join(lists, ["doc", "row"], "left_semi").distinct()
    out = staged(lists.join(sizes, ["doc", "row"]).select("doc", "row", F.size("at").cast("bigint").alias("n_dropped"), _bitmaps("n", "at").alias("keep_bitmap")), "line-bitmaps")
    keep.release()
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, doc_id: str = "doc_id", text: str = "text", out: str = "_line_dedup") -> DataFrame:
    """docs with an added struct (named out, or with underscores before it) of n_lines, n_dropped, keep_bitmap and the kept text.

    Bitmaps that have been measured to be small are broadcast, so that no text moves; others are joined by a shuffle.
    """
    flat, at = by_place(docs)
    bm = small_side(bitmaps.select(F.col("doc").alias("b_doc"), F.col("row").alias("b_row"), F.col("n_dropped").alias("b_n"), F.col("keep_bitmap").alias("b_keep")), size="24 + length(b_keep)")
    left = flat.withColumn("l_doc", F.coalesce(F.col(at[doc_id]).cast("bigint"), F.lit(NULL_ID))).withColumn("l_row", F.xxhash64(at[text]))
    body = F.coalesce(F.col(at[text]), F.lit(""))
    cut = _kept_text(F.when(F.col("b_keep").isNotNull(), body), F.col("b_keep"))
    done = left.join(bm, (F.col("l_doc") == F.col("b_doc")) & (F.col("l_row") == F.col("b_row")), "left").withColumn("cut", cut)
    facts = F.struct(
        F.size(F.split(body, "\n", -1)).cast("bigint").alias("n_lines"),
        F.coalesce("b_n", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.col("b_keep").alias("keep_bitmap"),
        F.coalesce("cut", body).alias("kept"),
    )
    return done.select(*flat.columns, facts.alias("facts")).toDF(*docs.columns, free_name(docs, out))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: n_lines, n_dropped and the hash of the kept text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = apply_bitmaps(docs, keep_bitmaps(docs))
    d = F.col("_line_dedup")
    return done.select("doc_id", d["n_lines"].alias("n_lines"), d["n_dropped"].alias("n_dropped"), F.sha2(F.encode(d["kept"], "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, ls[i] AS line,
         translate(trim(ls[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), keys AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (k.k IS NOT NULL AND l.doc_id < k.top) AS gone FROM lines l LEFT JOIN keys k ON l.k = k.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
