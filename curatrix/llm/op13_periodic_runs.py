"""Periodic runs of words by the runs theorem, and texts without their repetitions.

A run is a stretch of words with a smallest period q that can't be extended by a word on either side. By
the runs theorem the root of every run is, under one of two orders (of the words, and of the words turned
round), the longest Lyndon word that starts at its place; and that word ends at the next smaller value of
the inverse suffix array. So in every block of whole documents

- a suffix array is built by prefix doubling, in which only suffixes that still tie are sorted again;
- the longest common prefixes (LCP) of neighbours come from the ranks of the rounds, and a sparse table
  gives the smallest LCP between any two suffixes (range minimum query), which is how far they agree;
- next smaller values come from a second sparse table by halving steps, under both orders;
- a Lyndon root is extended to the right by one such query, to the left by bisection over queries.

A root only counts in the first of its repeats in a run, which is told by one more query, so every run
comes once or, at the end of a text, once for each order.

Documents don't depend on each other, so nothing is shuffled. Suffixes of different documents never tie:
copies side by side in a block cost no round. A block holds BLOCK_WORDS words or one longer document; it
takes about 30 bytes a word and round, at most 21 rounds for two million words.

Defined results
- a null or empty text has no words, no runs and an empty kept text;
- repeated rows are judged one by one; a null id is an id like any other, and gets no planted period in the query;
- a text of any length is taken whole; an empty table gives an empty result;
- other columns are carried along by place, whatever their names; the findings come in one struct, named
  `_runs` or with underscores before that if the name is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, by_place, free_name, table

MIN_LENGTH = 6
MIN_EXPONENT = 4
BLOCK_WORDS = 200_000

FINDINGS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
        T.StructField("kept", T.StringType()),
    ]
)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("kept", pa.string())])


# --- suffixes ------------------------------------------------------------------------------------


def suffix_ranks(seq: np.ndarray, doc: np.ndarray, ends: np.ndarray, rounds: list | None = None) -> np.ndarray:
    """The inverse suffix array of seq: suffixes end with their document, later documents come first.

    ends[i] is the end of i's document. With a list, the ranks by 1, 2, 4, ... words are added to it.
    """
    n = len(seq)
    top = int(doc.max()) + 1 if n else 1
    key = (top - doc) * (int(seq.max(initial=0)) + 1) + seq
    order = np.argsort(key, kind="stable")
    slots, sorted_key, rank = np.arange(n), key[order], np.empty(n, np.int64)
    k = 1
    while len(slots):
        fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        if rounds is not None:
            rounds.append(rank.astype(np.int32))
        tied = ~fresh | np.concatenate((~fresh[1:], [False]))
        slots = slots[tied]
        at = order[slots]
        after = at + k
        second = np.where(after < ends[at], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[slots], sorted_key = at[by], key[by]
        k *= 2
    return rank


def neighbour_lcp(rank: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix with the one before it in order; 0 for the first."""
    n = len(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int32)
    open_ = np.arange(n - 1)  # neighbours that agree in their first word; the others have no common prefix
    if rounds:
        open_ = open_[rounds[0][a] == rounds[0][b]]
    a, b, got = a[open_], b[open_], np.zeros(len(open_), np.int32)
    for level in reversed(range(len(rounds))):
        r, step = rounds[level], 1 << level
        same = (np.maximum(a, b) < n) & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
        a, b, got = a + step * same, b + step * same, got + np.int32(step) * same
    out[open_ + 1] = got
    return out


class Minima:
    """A sparse table: the least value of any range, of up to 2^levels places and more."""

    def __init__(self, values: np.ndarray, longest: int):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= min(longest, len(values)):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The least value of each a..z, z exclusive and beyond a."""
        level = np.log2(z - a).astype(np.int64)
        out = np.empty(len(a), self.rows[0].dtype)
        for v in np.unique(level):
            i = np.flatnonzero(level == v)
            out[i] = np.minimum(self.rows[v][a[i]], self.rows[v][z[i] - (1 << int(v))])
        return out

    def next_smaller(self, at: np.ndarray) -> np.ndarray:
        """The first place after each with a smaller value, as far as the table's longest range reaches."""
        p, own = at + 1, self.rows[0][at]
        for level in reversed(range(len(self.rows))):
            row = self.rows[level]
            skip = (p < len(row)) & (row[np.minimum(p, len(row) - 1)] > own)
            p = p + (skip.astype(np.int64) << level)
        return p


# --- runs ----------------------------------------------------------------------------------------


def find_runs(seq: np.ndarray, bounds: np.ndarray, *, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, in this order; document d is seq[bounds[d]:bounds[d + 1]].

    seq holds numbers of words from 0 on; min_exponent is 2 at least.
    """
    none = np.zeros((0, 4), np.int64)
    if min_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    sizes = np.diff(bounds)
    if not len(seq):
        return none
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts, ends = bounds[:-1][doc], bounds[1:][doc]
    rounds: list[np.ndarray] = []
    rank = suffix_ranks(seq, doc, ends, rounds)
    lcp = neighbour_lcp(rank, rounds)
    del rounds
    # A first root agrees with what follows it for (min_exponent - 2) periods and a word.
    best = np.maximum(lcp, np.concatenate((lcp[1:], [0])))[rank]
    likely = np.flatnonzero(best >= min_exponent - 1)
    if not len(likely):
        return none
    agree = Minima(lcp, len(lcp))

    def common(i, j):
        x, y = rank[i], rank[j]
        return agree.least(np.minimum(x, y) + 1, np.maximum(x, y) + 1)

    longest = int(sizes.max()) // min_exponent + 1
    found = [none]
    for turned in (False, True):
        if turned:
            # The other order is only needed in documents that hold a likely root.
            some = np.isin(doc, np.unique(doc[likely]))
            place = np.cumsum(some) - 1
            part = np.flatnonzero(some)
            size = np.bincount(doc[part], minlength=len(sizes))
            other = suffix_ranks(int(seq.max()) - seq[part], doc[part], np.cumsum(size)[doc[part]])
            j = Minima(other.astype(np.int32), longest).next_smaller(place[likely])
            q = j - place[likely]
        else:
            q = Minima(rank.astype(np.int32), longest).next_smaller(likely) - likely
        i = likely
        fits = (i + q < ends[i]) & (q * min_exponent <= (ends - starts)[i])
        i, q = i[fits], q[fits]
        if not len(i):
            continue
        right = common(i, i + q).astype(np.int64)
        long = right >= (min_exponent - 2) * q + 1
        i, q, right = i[long], q[long], right[long]
        back = i - q >= starts[i]
        back[back] = common(i[back] - q[back], i[back]) >= q[back]
        i, q, right = i[~back], q[~back], right[~back]
        low, high = np.zeros(len(i), np.int64), np.minimum(q - 1, i - starts[i])  # words before the root that keep the period
        while len(open_ := np.flatnonzero(low < high)):
            d = (low[open_] + high[open_] + 1) // 2
            ok = common(i[open_] - d, i[open_] - d + q[open_]) >= d
            low[open_[ok]], high[open_[~ok]] = d[ok], d[~ok] - 1
        length = low + q + right
        good = length >= np.maximum(min_length, min_exponent * q)
        found.append(np.stack([doc[i], i - low - starts[i], length, q], 1)[good])
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that stay when every run (start, length, period) is cut to its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int32)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if d == 0]


def _block(texts: list[list[bytes]], min_length: int, min_exponent: int) -> pa.Array:
    vocab: dict[bytes, int] = {}
    bounds = np.concatenate(([0], np.cumsum([len(ws) for ws in texts], dtype=np.int64)))
    seq = np.fromiter((vocab.setdefault(w, len(vocab)) for ws in texts for w in ws), np.int64, int(bounds[-1]))
    runs = find_runs(seq, bounds, min_length=min_length, min_exponent=min_exponent)
    cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    kept = [b" ".join(collapse(ws, runs[a:z, 1:])) for ws, a, z in zip(texts, cut[:-1], cut[1:], strict=True)]
    rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, c])) for c in (1, 2, 3)], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rows)
    return pa.StructArray.from_arrays([pa.array(np.diff(bounds)), lists, pa.array(kept, pa.binary()).cast(pa.string())], fields=list(_ARROW))


def _pass(text: str, found: str, min_length: int, min_exponent: int, block_words: int):
    def run(batches):
        for b in batches:
            column, i = b.column(text), 0
            while i < b.num_rows:
                held, size, first = [], 0, i
                while i < b.num_rows and size < block_words:
                    # bytes.split() without arguments splits at the six white space bytes of the contract.
                    held.append((column[i].as_py() or "").encode("utf-8", "surrogatepass").split())
                    size += len(held[-1])
                    i += 1
                part = b.slice(first, i - first)
                yield pa.RecordBatch.from_arrays([*part.columns, _block(held, min_length, min_exponent)], names=[*part.schema.names, found])

    return run


def with_runs(docs: DataFrame, *, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, str]:
    """docs with a struct of n_words, runs (start, length, period; by start, then period) and the kept text; and the struct's name.

    Kept are the words outside runs and the first period of every run, joined by one space.
    """
    flat, at = by_place(docs)
    name = free_name(docs, "_runs")
    out = flat.mapInArrow(_pass(at[text], name, min_length, min_exponent, block_words), T.StructType([*flat.schema.fields, T.StructField(name, FINDINGS)]))
    return out.toDF(*docs.columns, name), name


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the contract's periods are planted in a tenth of the documents, chosen by the crc32 of their ids."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Words only where they are needed; a text without a word at either end has no empty part.
    words = F.when(h % 10 == 0, F.split(F.btrim("text", F.lit(ASCII_SPACE)), "[ \\t-\\r]+"))
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    some = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.when(F.col("w")[0] != "", F.size("w")))
    some = some.withColumn("a", F.col("g") % n).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    head, period = F.slice("w", F.lit(1), a.cast("int")), F.slice("w", (a + 1).cast("int"), p.cast("int"))
    turns = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
    return some.select("doc_id", F.when(n.isNotNull(), F.array_join(F.slice(F.concat(head, turns), F.lit(1), n), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the runs of every document with its planted period, and hashes of all runs and of what is kept."""
    done, name = with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    runs = F.col(f"{name}.runs")
    top = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    flat = done.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col(f"{name}.kept").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("top.length"), -F.col("top.period")
    return flat.select("doc_id", "n_runs", (-F.col("top.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# A run of period q is a stretch of places i that hold the same word as i + q. A stretch of at least three
# periods that a smaller period explains has the same ends for it, so the smallest period of equal ends is kept.
# crc32 goes bit by bit: -1 stands for a shift, other numbers for a byte.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_reduce(flatten(list_prepend([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) AS c
  FROM documents
), e AS (
  SELECT doc_id, w, xor(c, 4294967295) % 10 AS h, xor(c, 4294967295) // 10 AS g, len(w) AS n FROM d
), s AS (
  SELECT *, g % nullif(n, 0) AS a, 1 + (n - g % nullif(n, 0)) // (3 + g % 8) AS p FROM e
), t AS (
  SELECT doc_id, i, CASE WHEN h = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM s)
), eq AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), islands AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq) GROUP BY doc_id, q, k
), runs AS (
  SELECT doc_id, s, length, min(q) AS q FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, s, length
), per AS (
  SELECT doc_id, count(*) AS n_runs, max(struct_pack(l := length, s := -s, q := -q)) AS top,
         string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs
), kept AS (
  SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS k FROM t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.i = g.i GROUP BY t.doc_id
)
SELECT documents.doc_id, coalesce(n_runs, 0) AS n_runs, -top.s AS start, top.l AS length, -top.q AS period,
       1000 * top.l // -top.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM documents LEFT JOIN per ON documents.doc_id = per.doc_id LEFT JOIN kept ON documents.doc_id = kept.doc_id
"""
