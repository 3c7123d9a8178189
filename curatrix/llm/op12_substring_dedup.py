"""Substring de-duplication over a compacted de Bruijn graph of words.

A window of WINDOW words is an edge of the graph, between its first and its last WINDOW - 1 words. Only
the first of equal windows, by document and place, stays.

1. Every text becomes a sketch: the least hash of ANCHOR words in each window (its anchor), once for each
   stretch of windows that share it. Of equal texts only the first goes on; the others are repeats whole.
2. Equal windows have equal anchors, so a window whose anchor stands once in all texts can't repeat. Only
   the others become edges: their 128-bit hashes are shuffled once, combined before, and of each are kept
   the number of copies, its source coordinates (the first document and place) and whether one word alone follows.
3. A node is no branch where all copies of an edge go on to the same edge and that has no other copies.
   Then its sources stand side by side too, so a join of edges with edges at the next source coordinate
   finds all links; what no link enters heads a path, what no link leaves ends it, and a join by their
   order in the document makes one row of a path, however long and often repeated it is.
4. Source coordinates tell repeats from first occurrences: a candidate window that lies on no path that
   has its source there repeats an earlier one. The words of such windows go.

A passage in a third of all documents is one path and, after partial aggregation, a row for each of its
windows and tasks; no list of its places is ever made. What is gathered is one document's.

Defined results
- a null or empty text has no words and an empty kept text; a text shorter than a window loses nothing;
- a null document id counts as the smallest id;
- rows that share id and text are one document, and both keep or lose the same words; rows that share
  an id but not the text come in the order of the 64-bit hashes of their texts;
- a text of any length is taken whole; an empty table gives an empty result;
- other columns are carried along by place, whatever their names; the findings come in one struct, named
  `_repeats` or with underscores before that if the name is taken;
- windows are compared by 128-bit hashes, so two are confused with probability 2^-128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, SPACE_BYTES, Kept, _powers, arrow_rows, by_place, combine, free_name, mix64, small_side, staged, table, word_hashes

WINDOW = 20
ANCHOR = 8
#: Rows of one Arrow batch of edges.
BATCH_EDGES = 200_000
#: Rows of one Arrow batch of texts, which stands in the JVM and in Python at once, for each task.
TEXT_ROWS = 500

_SKETCH = "doc bigint, row bigint, digest binary, n_words bigint, anchors array<bigint>, starts array<int>"
_EDGES = "a bigint, b bigint, doc bigint, row bigint, pos int, next bigint"

_SPANS = T.StructType([T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])

FINDINGS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("kept", T.StringType()),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kept", pa.string())])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, row, text): row tells apart rows that share an id."""
    flat, at = by_place(docs)
    return flat.select(F.coalesce(F.col(at[doc_id]).cast("bigint"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(at[text]).alias("row"), F.col(at[text]).alias("text"))


# --- windows in numpy ----------------------------------------------------------------------------


def _hashes(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass"), SPACE_BYTES)


def anchors(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each stretch of windows that share one, and the first window of the stretch."""
    m = combine(words, anchor)
    at = np.lib.stride_tricks.sliding_window_view(m, window - anchor + 1).argmin(1)
    at += np.arange(len(at))
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return m[at[starts]], starts


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window, from prefix sums of two polynomials modulo 2^64."""
    p, q = _powers(len(words) + 1)
    out = []
    for salt in (0, 0x94D049BB133111EB):
        s = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix64(words ^ np.uint64(salt)) * p[: len(words)], out=s[1:])
        out.append(mix64((s[window:] - s[:-window]) * q[: len(words) - window + 1] + np.uint64(salt)).view(np.int64))
    return out[0], out[1]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges with those that touch or overlap made one."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((new[1:], [True]))]


def outside(starts: np.ndarray, ends: np.ndarray, own_starts: np.ndarray, own_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of the ranges lies in none of the own ranges, as sorted ranges."""
    if not len(starts):
        return starts, ends
    size = int(ends[-1]) + 1
    depth = np.zeros(size + 1, np.int32)
    for at, sign in ((starts, 1), (ends, -1)):
        np.add.at(depth, at, sign)
    inside = np.cumsum(depth) > 0
    own = np.zeros(size + 1, np.int32)
    np.add.at(own, np.minimum(own_starts, size), 1)
    np.add.at(own, np.minimum(own_ends, size), -1)
    edge = np.diff(np.concatenate(([0], (inside & (np.cumsum(own) == 0)).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# --- passes over texts ---------------------------------------------------------------------------


def _ragged(parts: list[np.ndarray], kind) -> pa.Array:
    cut = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def _sketch_pass(window: int, anchor: int):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                keep, sizes, found = [], [], []
                for k, text in enumerate(part.column("text")):
                    words = _hashes(text.as_py())
                    if len(words) >= window:
                        keep.append(k)
                        sizes.append(len(words))
                        found.append(anchors(words, window, anchor))
                if keep:
                    t = part.select(["doc", "row", "digest"]).take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays(
                        [*t.columns, pa.array(sizes, pa.int64()), _ragged([f[0].view(np.int64) for f in found], pa.int64()), _ragged([f[1] for f in found], pa.int32())],
                        names=["doc", "row", "digest", "n_words", "anchors", "starts"],
                    )

    return run


def _edge_pass(window: int):
    names = ["a", "b", "doc", "row", "pos", "next"]

    def run(batches):
        held, size = [], 0
        for b in batches:
            for k in range(b.num_rows):
                text, doc, row = (b.column(c)[k].as_py() for c in ("text", "doc", "row"))
                starts, ends = (b.column(c)[k].values.to_numpy() for c in ("starts", "ends"))
                words = _hashes(text)
                x, y = window_hashes(words, window)
                follow = np.concatenate((words[window:] | np.uint64(1), [np.uint64(0)])).view(np.int64)
                inside = np.zeros(len(x) + 1, np.int32)
                inside[starts] += 1
                inside[ends] -= 1
                pos = np.flatnonzero(np.cumsum(inside[:-1]))
                held.append((x[pos], y[pos], np.full(len(pos), doc), np.full(len(pos), row), pos.astype(np.int32), follow[pos]))
                size += len(pos)
                if size >= BATCH_EDGES:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    return run


@F.pandas_udf(_SPANS)
def _candidates(n_windows, starts, lone):
    """The ranges of windows whose anchors aren't alone; lone holds the numbers of the stretches that are."""
    import pandas as pd

    out = []
    for n, s, one in zip(n_windows, starts, lone, strict=True):
        s = np.asarray(s, np.int64)
        shared = np.ones(len(s), bool)
        if one is not None:
            shared[np.asarray(one, np.int64)] = False
        out.append(merged(s[shared], np.append(s[1:], n)[shared]))
    return pd.DataFrame({"starts": [a.astype(np.int32) for a, _ in out], "ends": [z.astype(np.int32) for _, z in out]})


def _gone(window: int):
    @F.pandas_udf(_SPANS)
    def gone(starts, ends, own):
        """Ranges of words covered by candidate windows outside the document's own paths (first window, windows)."""
        import pandas as pd

        out = []
        for s, e, paths in zip(starts, ends, own, strict=True):
            p = np.array([(x["pos"], x["pos"] + x["windows"]) for x in paths] if paths is not None else [], np.int64).reshape(-1, 2)
            a, z = outside(np.asarray(s, np.int64), np.asarray(e, np.int64), p[:, 0], p[:, 1])
            out.append(merged(a, z + window - 1))
        return pd.DataFrame({"starts": [a.astype(np.int32) for a, _ in out], "ends": [z.astype(np.int32) for _, z in out]})

    return gone


def _cut_pass(text: str, found: str, drop: list[str]):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                sizes, kept, spans = [], [], []
                for k in range(part.num_rows):
                    # bytes.split() without arguments splits at the six white space bytes of the contract.
                    words = (part.column(text)[k].as_py() or "").encode("utf-8", "surrogatepass").split()
                    sizes.append(len(words))
                    at = [np.empty(0, np.int32) if (v := part.column(c)[k]).as_py() is None else v.values.to_numpy() for c in drop]
                    spans.append(at)
                    for s, e in zip(*(x[::-1].tolist() for x in at), strict=True):
                        del words[s:e]
                    kept.append(b" ".join(words))
                facts = pa.StructArray.from_arrays(
                    [pa.array(sizes, pa.int64()), _ragged([s for s, _ in spans], pa.int32()), _ragged([e for _, e in spans], pa.int32()), pa.array(kept, pa.binary()).cast(pa.string())], fields=list(_ARROW)
                )
                rest = part.drop_columns(drop)
                yield pa.RecordBatch.from_arrays([*rest.columns, facts], names=[*rest.schema.names, found])

    return run


# --- the graph -----------------------------------------------------------------------------------


def _sketches(keyed: DataFrame, keep: Kept, window: int, anchor: int) -> DataFrame:
    """A sketch of every text that holds a window, with a number of its own."""
    found = keyed.withColumn("digest", F.unhex(F.md5("text"))).mapInArrow(_sketch_pass(window, anchor), _SKETCH)
    return keep.stage(found.withColumn("uid", F.monotonically_increasing_id()), "sketches")


def _candidate_windows(sketches: DataFrame, first: DataFrame, keep: Kept, window: int) -> DataFrame:
    """(doc, row, starts, ends): ranges of windows that may repeat, in the first of equal texts."""
    own = sketches.join(first.select("uid"), "uid", "left_semi")
    each = own.select("uid", F.posexplode("anchors").alias("k", "anchor"))
    # The largest of one row's values is its value.
    alone = each.groupBy("anchor").agg(F.count("*").alias("n"), F.max("uid").alias("uid"), F.max("k").alias("k")).where("n = 1")
    lone = alone.groupBy("uid").agg(F.collect_list("k").alias("lone"))
    found = own.join(lone, "uid", "left").select("doc", "row", _candidates(F.col("n_words") - (window - 1), "starts", "lone").alias("c"))
    return keep.stage(found.where(F.size("c.starts") > 0).select("doc", "row", "c.starts", "c.ends"), "candidates")


def _edges(keyed: DataFrame, cand: DataFrame, keep: Kept, window: int) -> DataFrame:
    """(doc, row, pos, n, goes_on): source coordinates of each distinct edge, its copies, and whether one word alone follows them."""
    texts = keyed.join(small_side(cand, size="24 + 8 * size(starts)"), ["doc", "row"])
    each = texts.select("doc", "row", "text", "starts", "ends").mapInArrow(_edge_pass(window), _EDGES)
    # Repeated rows of one id and text are one document.
    first = each.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc", "row", "pos")).alias("at"), F.min("next").alias("low"), F.max("next").alias("high"))
    return keep.stage(first.select("at.doc", "at.row", "at.pos", "n", ((F.col("low") == F.col("high")) & (F.col("low") != 0)).alias("goes_on")), "edges")


def _compact(edges: DataFrame, keep: Kept) -> DataFrame:
    """(doc, row, pos, windows, n): nonbranching paths at their source coordinates."""
    after = edges.select("doc", "row", (F.col("pos") - 1).alias("pos"), F.col("n").alias("n_after"))
    links = keep.stage(edges.where("goes_on").join(after, ["doc", "row", "pos"]).where("n = n_after").select("doc", "row", "pos"), "links")
    heads = edges.join(links.select("doc", "row", (F.col("pos") + 1).alias("pos")), ["doc", "row", "pos"], "left_anti")
    tails = edges.join(links, ["doc", "row", "pos"], "left_anti")
    order = F.row_number().over(Window.partitionBy("doc", "row").orderBy("pos"))
    ends = tails.select("doc", "row", order.alias("k"), F.col("pos").alias("last"))
    paths = heads.select("doc", "row", order.alias("k"), "pos", "n").join(ends, ["doc", "row", "k"])
    return keep.stage(paths.select("doc", "row", "pos", (F.col("last") - F.col("pos") + 1).alias("windows"), "n"), "paths")


def _paths(docs: DataFrame, keep: Kept, doc_id: str, text: str, window: int, anchor: int):
    keyed = _keyed(docs, doc_id, text)
    sketches = _sketches(keyed, keep, window, anchor)
    first = keep.stage(sketches.groupBy("digest").agg(F.min(F.struct("doc", "uid")).alias("f")).select("digest", F.col("f.doc").alias("f_doc"), F.col("f.uid").alias("uid")), "firsts")
    cand = _candidate_windows(sketches, first, keep, window)
    return sketches, first, cand, _compact(_edges(keyed, cand, keep, window), keep)


def repeated_paths(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, row, start, words, copies): every compacted path that texts hold twice or more, at its source.

    start and words are in words; (doc, row) is the id and the 64-bit hash of the text. Copies are counted
    over distinct texts, repeated rows of one id and text one by one.
    """
    keep = Kept()
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        paths = _paths(docs, keep, doc_id, text, window, anchor)[-1]
    out = staged(paths.where("n > 1").select("doc", "row", F.col("pos").alias("start"), (F.col("windows") + (window - 1)).alias("words"), F.col("n").alias("copies")), "repeated-paths")
    keep.release()
    return out


def removed_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, row, starts, ends): the words that go, for each document that loses some; ends are exclusive."""
    keep = Kept()
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        sketches, first, cand, paths = _paths(docs, keep, doc_id, text, window, anchor)
    own = paths.groupBy("doc", "row").agg(F.collect_list(F.struct("pos", "windows")).alias("own"))
    partly = cand.join(own, ["doc", "row"], "left").select("doc", "row", _gone(window)("starts", "ends", "own").alias("g")).where(F.size("g.starts") > 0).select("doc", "row", "g.starts", "g.ends")
    copies = sketches.select("doc", "row", "digest", "n_words").join(first.select("digest", "f_doc"), "digest").where("doc > f_doc").select("doc", "row", F.col("n_words").cast("int").alias("n")).distinct()
    whole = copies.select("doc", "row", F.array(F.lit(0)).alias("starts"), F.array("n").alias("ends"))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        out = staged(partly.unionByName(whole), "removed-spans")
    keep.release()
    return out


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, str]:
    """docs with a struct of n_words, starts and ends of what goes, and the kept words joined by one space; and the struct's name.

    Spans that have been measured to be small are broadcast, so that no text moves; others are joined by a shuffle.
    The texts are cut by the action on the result; inside arrow_rows() that takes less memory.
    """
    spans = removed_spans(docs, doc_id=doc_id, text=text, window=window, anchor=anchor)
    flat, at = by_place(docs)
    name = free_name(docs, "_repeats")
    side = small_side(spans.select(F.col("doc").alias("s_doc"), F.col("row").alias("s_row"), F.col("starts").alias("s_starts"), F.col("ends").alias("s_ends")), size="24 + 8 * size(s_starts)")
    keys = (F.coalesce(F.col(at[doc_id]).cast("bigint"), F.lit(NULL_ID)) == F.col("s_doc")) & (F.xxhash64(at[text]) == F.col("s_row"))
    both = flat.join(side, keys, "left").select(*flat.columns, "s_starts", "s_ends")
    out = both.mapInArrow(_cut_pass(at[text], name, ["s_starts", "s_ends"]), T.StructType([*flat.schema.fields, T.StructField(name, FINDINGS)]))
    return out.toDF(*docs.columns, name), name


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: words, removed words and the hash of the kept words of every document."""
    out, name = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = F.col(name)
    gone = F.aggregate(F.zip_with(d["ends"], d["starts"], lambda e, s: e - s), F.lit(0), lambda x, y: x + y)
    found = out.select("doc_id", d["n_words"].alias("n_words"), gone.cast("bigint").alias("n_removed"), F.sha2(d["kept"].cast("binary"), 256).alias("kept_sha256"))
    with arrow_rows(spark, TEXT_ROWS):
        return staged(found, "substring-digests")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late),
words AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.i) AS k FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
