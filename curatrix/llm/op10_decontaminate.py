"""Benchmark decontamination by an FM-index for each training shard.

A shard is a bounded run of documents. Its words are mapped to the benchmark's vocabulary; a window
can only occur inside a run of such words that is at least as long as the shortest window, so the
index covers those runs, separated by unique end marks. Over them stand a suffix array (prefix
doubling), the Burrows-Wheeler transform, a wavelet matrix for ranks, and suffix positions sampled
at run starts and at every SAMPLE-th word. All windows are searched backwards at once, occurrences
are located by walking to sampled positions, and overlapping ones are merged to removal spans.

The benchmark is searched in blocks of BLOCK_WORDS words, read and broadcast one at a time; each pass
adds to the spans of the one before, and is written before the next block is read, so what the driver
and a task hold is bounded however large the benchmark grows. Ranks are taken on bit vectors, a bit a
place with a count every 64 places, and positions are kept for sampled suffixes alone.

Defined results
- null and empty texts have no words, no hits and are not contaminated; an item without words occurs nowhere;
- repeated documents are judged one by one; items that repeat a text all count, by their ids;
- a null item id is written `null`; an empty benchmark or table gives no hits or no rows;
- all columns of the documents are carried along, with the findings in one struct.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, byte_set, free_name, staged, table

WINDOW = 13
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 1_000_000
SAMPLE = 16

_WORD_BYTES = byte_set(lambda i: i >= 0x80 or chr(i).isalnum())
_TO_SPACE = bytes(i if _WORD_BYTES[i] else 0x20 for i in range(256))

FINDINGS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split() if text else []


# --- the index -----------------------------------------------------------------------------------


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Sorted suffixes of seq, whose zeros are end marks that differ from one another, by position."""
    n = len(seq)
    marks = seq == 0
    rank = seq.astype(np.int64) + int(marks.sum())
    rank[marks] = np.arange(int(marks.sum()))
    k = 1
    while True:
        key = rank * (n + int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(s[1:] != s[:-1])
        rank, k = new, k * 2
        if int(rank.max()) == n - 1 or k >= n:
            return np.argsort(rank, kind="stable")


class Bits:
    """A bit vector with ranks: 64 places a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        data = np.packbits(bits.astype(bool), bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(data)] = data
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[Bits] = []
        self.zeros: list[int] = []
        s = seq
        for level in reversed(range(self.bits)):
            bit = (s >> level) & 1
            self.ones.append(Bits(bit))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        lo = np.zeros(len(symbol), np.int64)
        i = i.astype(np.int64)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            bit = ((symbol >> level) & 1).astype(bool)
            x, y = ones.rank(i), ones.rank(lo)
            i = np.where(bit, zeros + x, i - x)
            lo = np.where(bit, zeros + y, lo - y)
        return i - lo


class FMIndex:
    def __init__(self, seq: np.ndarray, sigma: int):
        """seq: symbols 1..sigma-1 with a zero after every run."""
        self.n = len(seq)
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1].astype(np.int32)
        self.tree = WaveletMatrix(self.bwt, sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))[:-1]
        starts = np.concatenate(([True], seq[:-1] == 0))
        sampled = starts[sa] | (sa % SAMPLE == 0)
        self.sampled = Bits(sampled)
        self.positions = sa[sampled].astype(np.int32)

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all windows (rows, filled from the left) at once: their suffix ranges."""
        lo = np.zeros(len(windows), np.int64)
        hi = np.full(len(windows), self.n, np.int64)
        for back in range(1, windows.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            c = windows[live, lengths[live] - back]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled.get(at))
        while len(open_):
            c = self.bwt[at[open_]]
            at[open_] = self.before[c] + self.tree.rank(c, at[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled.get(at[open_])]
        return self.positions[self.sampled.rank(at)] + steps


# --- windows of a benchmark block ----------------------------------------------------------------


class Block:
    """Distinct windows of some items over their own vocabulary, and which items hold each."""

    def __init__(self, items: list[tuple[str, np.ndarray]], vocab: dict[bytes, int], window: int):
        """items: (id, word numbers from 1 on); windows shorter than window are filled up with zeros."""
        self.vocab, self.names = vocab, [name for name, _ in items]
        rows = [np.lib.stride_tricks.sliding_window_view(x, window) if len(x) >= window else np.pad(x, (0, window - len(x)))[None] for _, x in items]
        every = np.concatenate(rows) if rows else np.zeros((0, window), np.int32)
        self.windows, which = np.unique(every, axis=0, return_inverse=True)
        self.lengths = (self.windows != 0).sum(1).astype(np.int64)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        item = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        held = np.unique(np.stack([which.reshape(-1), item], 1), axis=0)
        self.first, self.holders = np.searchsorted(held[:, 0], np.arange(len(self.windows) + 1)), held[:, 1].astype(np.int32)

    def items(self, w: int) -> list[str]:
        """The items that hold window w."""
        return [self.names[i] for i in self.holders[self.first[w] : self.first[w + 1]]]


def blocks(benchmark: DataFrame, *, item_id: str, text: str, window: int, block_words: int):
    """The blocks of the benchmark, one at a time; there is one at least. An item is held whole."""
    items, vocab, size, none = [], {}, 0, True
    flat, at = by_place(benchmark)
    order = flat.select(F.col(at[item_id]).cast("string").alias("item"), F.col(at[text]).alias("text")).orderBy("item", "text")
    for r in order.toLocalIterator():
        if ws := words(r[1]):
            items.append((r[0] if r[0] is not None else "null", np.array([vocab.setdefault(w, len(vocab) + 1) for w in ws], np.int32)))
            size += len(ws)
        if size >= block_words:
            yield Block(items, vocab, window)
            items, vocab, size, none = [], {}, 0, False
    if items or none:
        yield Block(items, vocab, window)


# --- shards --------------------------------------------------------------------------------------


def search_shard(texts: list, earlier: list | None, block: Block) -> list[dict]:
    """Findings for each text of a shard, added to those of earlier blocks."""
    get = block.vocab.get
    ids, sizes = [], []
    for t in texts:
        ws = words(t)
        sizes.append(len(ws))
        ids.append(np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws)))
    sizes = np.array(sizes, np.int64)
    base = np.concatenate(([0], np.cumsum(sizes + 1)))  # a gap follows every document
    flat = np.zeros(int(base[-1]), np.int64)
    for b, x in zip(base, ids, strict=False):
        flat[b : b + len(x)] = x
    depth = np.zeros(len(flat) + 1, np.int32)
    named: dict[int, set[str]] = {}
    known = flat != 0
    edge = np.diff(np.concatenate(([0], known.view(np.int8), [0])))
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = z - a >= block.shortest
    a, z = a[long], z[long]
    if len(a) and len(block.windows):
        lengths = z - a + 1  # with the end mark
        first = np.concatenate(([0], np.cumsum(lengths)))
        origin = np.repeat(a - first[:-1], lengths) + np.arange(first[-1])
        seq = np.where(np.isin(np.arange(first[-1]), first[1:] - 1), 0, flat[np.minimum(origin, len(flat) - 1)])
        index = FMIndex(seq, len(block.vocab) + 1)
        lo, hi = index.search(block.windows, block.lengths)
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)))[:-1], count) + np.arange(int(count.sum()))
        start = origin[index.locate(rows)]
        np.add.at(depth, start, 1)
        np.add.at(depth, start + block.lengths[which], -1)
        doc = np.searchsorted(base, start, side="right") - 1
        for d, w in np.unique(np.stack([doc, which], 1), axis=0) if len(doc) else ():
            named.setdefault(int(d), set()).update(block.items(w))
    for i, e in enumerate(earlier or ()):
        if e and e["starts"]:
            np.add.at(depth, base[i] + np.array(e["starts"], np.int64), 1)
            np.add.at(depth, base[i] + np.array(e["ends"], np.int64), -1)
            named.setdefault(i, set()).update(e["items"])
    hit = np.cumsum(depth[:-1]) > 0
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(base, a, side="right") - 1
    out = []
    for i, n in enumerate(sizes):
        x, y = np.searchsorted(of, [i, i + 1])
        out.append({"n_words": int(n), "starts": a[x:y] - base[i], "ends": z[x:y] - base[i], "items": sorted(named.get(i, ()))})
    return out


def _pass(cast, text: str, found: str, add: bool, shard_words: int):
    def shard(held: list[pa.RecordBatch], block: Block):
        t = pa.Table.from_batches(held)
        earlier = None if add else t.column(found).to_pylist()
        got = search_shard(t.column(text).to_pylist(), earlier, block)
        col = pa.array(got, _ARROW)
        t = t.append_column(found, col) if add else t.set_column(t.schema.get_field_index(found), found, col)
        yield from t.to_batches()

    def run(batches):
        block, held, size = cast.value, [], 0
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                held.append(part)
                size += part.column(text).nbytes // 6 if part.num_rows else 0
                if size >= shard_words:
                    yield from shard(held, block)
                    held, size = [], 0
        if held:
            yield from shard(held, block)

    return run


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, str]:
    """docs with a struct of n_words, span starts and ends (in words, ends exclusive) and items; and the struct's name."""
    found = free_name(docs, "_leaks")
    out, at = by_place(docs)
    spark, last = docs.sparkSession, None
    for block in blocks(benchmark, item_id=item_id, text=item_text, window=window, block_words=block_words):
        if last is not None:
            # Only a benchmark of several blocks comes here: what the last one found is written, and the block let go.
            out = staged(out, "leaks")
            last.unpersist()
        schema = T.StructType([*(f for f in out.schema.fields if f.name != found), T.StructField(found, FINDINGS)])
        add, last = last is None, spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_pass(last, at[text], found, add, shard_words), schema)
    return out.toDF(*docs.columns, found), found


def n_hit(found: str):
    return F.aggregate(F.zip_with(f"{found}.ends", f"{found}.starts", lambda e, s: e - s), F.lit(0), lambda x, y: x + y).cast("bigint")


def contaminated(found: str):
    return (n_hit(found) > 0) & (20 * n_hit(found) >= F.col(f"{found}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    out, found = find_leaks(docs, benchmark, text=text)
    return out.where(~contaminated(found)).drop(found)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: words, hit words, items and the verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col(f"{found}.n_words").alias("n_words"),
        n_hit(found).alias("n_hit"),
        F.size(f"{found}.items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join(f"{found}.items", ","), "UTF-8"), 256).alias("items_sha256"),
        contaminated(found).alias("contaminated"),
    )


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
