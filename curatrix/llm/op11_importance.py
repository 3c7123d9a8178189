"""Importance resampling towards a target distribution, over a dictionary of distinct features.

Features are all runs of 1 to n words. Their bucket is a hash of the string, the gain of a bucket tells
how much more often the target hits it than the documents do, a document's weight is the mean gain of its
features, and the draw takes the highest weights after Gumbel noise that hashes of ids make.

1. Texts are read once, into blocks of BLOCK_WORDS words: a block's distinct words, and every document as
   numbers of these. Blocks are written to the shared folder.
2. A block's distinct n-grams, with their counts, go by hash of the string to parts of the dictionary. A
   part counts each string over all blocks and hashes it once, adds the counts up by bucket, and sends
   each block the buckets of its strings. A frequent string is one entry a block, not one a document.
3. The sums of the buckets give the gains; there are as many as buckets, and only they reach the driver.
4. A block, joined with the buckets of its strings, weighs its documents' feature counts by the gains.
5. Scores are ranked by ranges, so no task sorts all documents.

The number of parts grows with the words, so that a part stays near PART_WORDS words however many there are.

Defined results
- a null or empty text has no words, no features and weight 0, and is never drawn;
- a null id is hashed as the word `null` and comes before others of the same score;
- repeated rows are scored one by one and drawn one by one; rows that share an id but not the text get the
  same noise, and of equal scores come in the order of the 64-bit hashes of their texts;
- an empty target gives every bucket the gain of a target that never hits; an empty table gives an empty result;
- a text of any length is taken whole, and a block holds whole documents;
- resample() carries the columns of the documents, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import ranked
from .common import _P, SPACE_BYTES, Kept, by_place, mix64, small_side, staged, table, word_hashes
from .op10_decontaminate import words

ORDER = 2
BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
BLOCK_WORDS = 1 << 20
PART_WORDS = 1 << 20

_BLOCKS = "block bigint, vocab binary, seq binary, docs array<bigint>, rows array<bigint>, sizes array<int>, n_words bigint"
_ENTRIES = "part bigint, block bigint, strings binary, counts binary"
_FOUND = "block bigint, part bigint, buckets binary, bucket array<int>, n array<bigint>"
_WEIGHTS = "doc bigint, row bigint, n_words bigint, n_features bigint, weight bigint"


def _pack(data) -> bytes:
    return zlib.compress(data, 1)


def _pack_numbers(a: np.ndarray) -> bytes:
    """32-bit numbers, compressed by place of byte: first the lowest bytes of all, the highest last."""
    return _pack(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data), np.uint8)
    return flat.reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)


# --- blocks --------------------------------------------------------------------------------------


def _block_pass(block_words: int):
    def run(batches):
        vocab, seqs, docs, rows, size = {}, [], [], [], 0

        def block():
            # A block is named by the number that Spark gave its first document.
            flat = np.concatenate(seqs) if seqs else np.empty(0, np.int32)
            cols = [uid, _pack(b"\n".join(vocab)), _pack_numbers(flat), docs, rows, [len(s) for s in seqs], len(flat)]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], names=names)

        names = ["block", "vocab", "seq", "docs", "rows", "sizes", "n_words"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
        uid = None
        for b in batches:
            for k in range(b.num_rows):
                if uid is None:
                    uid = b.column("uid")[k].as_py()
                ws = words(b.column("text")[k].as_py())
                seqs.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in ws), np.int32, len(ws)))
                docs.append(b.column("doc")[k].as_py())
                rows.append(b.column("row")[k].as_py())
                size += len(ws)
                if size >= block_words:
                    yield block()
                    vocab, seqs, docs, rows, size, uid = {}, [], [], [], 0, None
        if docs:
            yield block()

    return run


def _blocks(docs: DataFrame, keep: Kept, doc_id: str, text: str, block_words: int) -> DataFrame:
    flat, at = by_place(docs)
    keyed = flat.select(F.monotonically_increasing_id().alias("uid"), F.col(at[doc_id]).cast("bigint").alias("doc"), F.xxhash64(at[text]).alias("row"), F.col(at[text]).alias("text"))
    return keep.stage(keyed.mapInArrow(_block_pass(block_words), _BLOCKS), "feature-blocks")


class Features:
    """The distinct n-grams of a block and where they stand, in an order that only depends on the block."""

    def __init__(self, vocab: bytes, seq: bytes, sizes: list[int], order: int, parts: int, strings: bool):
        data = zlib.decompress(vocab)
        self.seq, self.sizes = _numbers(seq), np.asarray(sizes, np.int64)
        names = pa.array(data.split(b"\n") if data else [], pa.binary())
        hashes = word_hashes(data, SPACE_BYTES)
        left = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(len(self.seq))  # words from here to the document's end
        self.places, self.numbers = [np.arange(len(self.seq))], [self.seq]
        texts, keys, base = [names], [hashes], len(names)
        last, h, s = self.seq, hashes, names
        for n in range(2, order + 1):
            at = np.flatnonzero(left >= n)
            shorter = np.zeros(len(self.seq), np.int64)
            shorter[self.places[-1]] = last
            key = shorter[at] * len(names) + self.seq[at + n - 1]
            _, first, last = np.unique(key, return_index=True, return_inverse=True)
            head, tail = shorter[at[first]], self.seq[at[first] + n - 1]
            h = mix64(h[head] * np.uint64(_P) + hashes[tail])
            if strings:
                s = pc.binary_join_element_wise(s.take(pa.array(head)), names.take(pa.array(tail)), b" ")
                texts.append(s)
            keys.append(h)
            self.places.append(at)
            self.numbers.append(base + last)
            base += len(first)
        self.n = base
        part = (np.concatenate(keys) % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")  # n-grams by part
        part = part[self.order]
        self.cut = np.flatnonzero(np.concatenate((part[:1] >= 0, part[1:] != part[:-1])))
        self.parts = part[self.cut]
        self.cut = np.append(self.cut, base)
        self.texts = pa.concat_arrays(texts).take(pa.array(self.order)) if strings else None

    def counts(self) -> np.ndarray:
        """How often each n-gram stands in the block, in the order of parts."""
        return np.bincount(np.concatenate(self.numbers), minlength=self.n)[self.order]


def _entry_pass(order: int, parts: int):
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                block, vocab, seq, sizes = (b.column(c)[k].as_py() for c in ("block", "vocab", "seq", "sizes"))
                f = Features(vocab, seq, sizes, order, parts, True)
                lines = pc.binary_join_element_wise(f.texts, pa.scalar(b"\n", pa.binary()), b"")
                ends = np.append(0, np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False), dtype=np.int64))
                data, counts = memoryview(lines.buffers()[2]) if f.n else b"", f.counts()
                cells = list(zip(f.parts.tolist(), f.cut[:-1].tolist(), f.cut[1:].tolist(), strict=True))
                for i in range(0, len(cells), 1000):
                    some = cells[i : i + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p for p, _, _ in some], pa.int64()),
                            pa.array([block] * len(some), pa.int64()),
                            pa.array([_pack(data[ends[a] : ends[z]]) for _, a, z in some], pa.binary()),
                            pa.array([_pack_numbers(counts[a:z]) for _, a, z in some], pa.binary()),
                        ],
                        names=["part", "block", "strings", "counts"],
                    )

    return run


def _count_part(buckets: int):
    def count(t: pa.Table) -> pa.Table:
        """One part of the dictionary: every distinct string counted over all blocks and hashed once."""
        lists = []
        for data in t.column("strings"):
            raw = np.frombuffer(zlib.decompress(data.as_py()), np.uint8)
            ends = np.concatenate(([0], np.flatnonzero(raw == 10) + 1)).astype(np.int64)  # a string and its \n
            lists.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)]))
        found = pa.concat_arrays(lists).dictionary_encode()
        which = found.indices.to_numpy()
        counts = np.concatenate([_numbers(c.as_py()) for c in t.column("counts")])
        total = np.zeros(len(found.dictionary), np.int64)
        np.add.at(total, which, counts)
        bucket = np.fromiter((zlib.crc32(v[:-1]) % buckets for v in found.dictionary.to_pylist()), np.int64, len(total))
        hit, of = np.unique(bucket, return_inverse=True)
        sums = np.zeros(len(hit), np.int64)
        np.add.at(sums, of, total)
        cut = np.cumsum([len(x) for x in lists])[:-1]
        back = [_pack_numbers(x) for x in np.split(bucket[which], cut)]
        n, part = len(back), t.column("part")[0].as_py()
        return pa.table(
            [
                pa.array([*t.column("block").to_pylist(), None], pa.int64()),
                pa.array([part] * (n + 1), pa.int64()),
                pa.array([*back, None], pa.binary()),
                pa.array([None] * n + [hit.tolist()], pa.list_(pa.int32())),
                pa.array([None] * n + [sums.tolist()], pa.list_(pa.int64())),
            ],
            names=["block", "part", "buckets", "bucket", "n"],
        )

    return count


def _dictionary(blocks: DataFrame, keep: Kept, order: int, buckets: int, part_words: int) -> tuple[DataFrame, dict[int, int], int]:
    """(buckets of each block's strings, the features in every bucket, the number of parts)."""
    n = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = max(1, -(-n // part_words))
    entries = blocks.select("block", "vocab", "seq", "sizes").mapInArrow(_entry_pass(order, parts), _ENTRIES)
    found = keep.stage(entries.groupBy("part").applyInArrow(_count_part(buckets), _FOUND), "feature-buckets")
    sums = found.where(F.col("block").isNull()).select(F.explode(F.arrays_zip("bucket", "n")).alias("e")).groupBy("e.bucket").agg(F.sum("e.n").alias("n"))
    return found.where(F.col("block").isNotNull()).select("block", "part", "buckets"), {r[0]: r[1] for r in sums.collect()}, parts


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket, in doubles."""
    a, b = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log(float(target.get(i, 0) + 1) * a / (float(source.get(i, 0) + 1) * b))) for i in range(buckets)], np.int64)


def _weigh(gain: np.ndarray, order: int, parts: int):
    def weigh(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of a block, by the buckets of its strings."""
        by_part = dict(zip(right.column("part").to_pylist(), right.column("buckets"), strict=True))
        out = []
        for k in range(left.num_rows):
            vocab, seq, sizes, docs, rows = (left.column(c)[k].as_py() for c in ("vocab", "seq", "sizes", "docs", "rows"))
            f = Features(vocab, seq, sizes, order, parts, False)
            of = np.zeros(f.n, np.int64)
            for p, a, z in zip(f.parts.tolist(), f.cut[:-1], f.cut[1:], strict=True):
                of[f.order[a:z]] = gain[_numbers(by_part[p].as_py())]
            n = f.sizes
            doc = np.repeat(np.arange(len(n)), n)
            total, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for at, number in zip(f.places, f.numbers, strict=True):
                np.add.at(total, doc[at], of[number])
                count += np.bincount(doc[at], minlength=len(n))
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            out.append(pa.table([pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(n), pa.array(count), pa.array(weight)], names=["doc", "row", "n_words", "n_features", "weight"]))
        empty = pa.table([pa.array([], pa.int64())] * 5, names=["doc", "row", "n_words", "n_features", "weight"])
        return pa.concat_tables(out) if out else empty

    return weigh


def weights(
    docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    order: int = ORDER, buckets: int = BUCKETS, block_words: int = BLOCK_WORDS, part_words: int = PART_WORDS,
) -> DataFrame:
    """(doc, row, n_words, n_features, weight): a row for each document; row is the 64-bit hash of its text."""
    keep = Kept()
    blocks = _blocks(docs, keep, doc_id, text, block_words)
    found, source, parts = _dictionary(blocks, keep, order, buckets, part_words)
    wanted = _target_blocks(target, keep, target_text, block_words)
    _, hits, _ = _dictionary(wanted, keep, order, buckets, part_words)
    gain = gains(source, hits, buckets)
    out = staged(blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_weigh(gain, order, parts), _WEIGHTS), "weights")
    keep.release()
    return out


def _target_blocks(target: DataFrame, keep: Kept, text: str, block_words: int) -> DataFrame:
    flat, at = by_place(target)
    return _blocks(flat.select(F.lit(None).cast("bigint").alias("id"), F.col(at[text]).alias("text")), keep, "id", "text", block_words)


def noise(doc, seed: int):
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of sha256(`seed:id`)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, target: DataFrame, *, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT, **how) -> DataFrame:
    """weights() with score and rank: 1, 2, 3, ... for those that are drawn, the percent highest of documents with min_words words."""
    every = weights(docs, target, **how).withColumn("score", F.col("weight") + noise(F.col("doc"), seed))
    order = ranked(every.where(F.col("n_words") >= min_words), [F.col("score").desc(), F.col("doc").asc_nulls_first(), F.col("row")])
    n = percent * order.count() // 100
    drawn = order.withColumn("rank", F.when(F.col("rank") < n, F.col("rank") + 1))
    return drawn.unionByName(every.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that are drawn, with their columns as they were; rows that share id and text stay if one of them is drawn."""
    drawn = scores(docs, target, doc_id=doc_id, text=text, **how).where(F.col("rank").isNotNull())
    flat, at = by_place(docs)
    keys = F.col(at[doc_id]).cast("bigint").eqNullSafe(F.col("k_doc")) & (F.xxhash64(at[text]) == F.col("k_row"))
    return flat.join(small_side(drawn.select(F.col("doc").alias("k_doc"), F.col("row").alias("k_row"))), keys, "left_semi").toDF(*docs.columns)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: features, weight, score and rank of every document, towards the texts of the benchmark."""
    out = scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return out.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")


# crc32 goes bit by bit over the bytes of each distinct string: -1 stands for a shift, other numbers for a byte.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d) GROUP BY doc_id, f),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b) GROUP BY f),
dict AS (
  SELECT f, s, t, xor(4294967295, list_reduce(flatten(list_prepend([4294967295::BIGINT], list_transform(range(len(x) // 2),
             lambda i: [CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, c: CASE WHEN c >= 0 THEN xor(a, c) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 10000 AS bucket
  FROM (SELECT f, sum(s) AS s, sum(t) AS t, hex(encode(f)) AS x FROM (SELECT f, n AS s, 0 AS t FROM df UNION ALL SELECT f, 0, n FROM bf) GROUP BY f)
),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(sum(t) + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM dict) + 10000 AS DOUBLE)
         / (CAST(sum(s) + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM dict) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM dict GROUP BY bucket
),
w AS (SELECT df.doc_id, sum(df.n) AS n, sum(df.n * gain) AS gain FROM df JOIN dict ON df.f = dict.f JOIN g ON dict.bucket = g.bucket GROUP BY df.doc_id),
s AS (
  SELECT d.doc_id, len(d.w) AS words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_features,
         CAST(CASE WHEN w.n IS NULL THEN 0 ELSE (w.gain - ((w.gain % w.n) + w.n) % w.n) // w.n END AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || sha256('7:' || CAST(d.doc_id AS VARCHAR))[1:8] AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS noise
  FROM d LEFT JOIN w ON d.doc_id = w.doc_id
),
r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank FROM s WHERE words >= 20)
SELECT s.doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM s WHERE words >= 20) THEN rank END AS rank
FROM s LEFT JOIN r ON s.doc_id = r.doc_id
"""
