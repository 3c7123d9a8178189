"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

Documents are sets of 64-bit hashes of their distinct word shingles. Equal sets are one class, so
only one document of each class is joined. A fixed-size count sketch over all shingles of all
documents gives one global order, rarest first, in which passages that many documents share come
last. If two sets of sizes n and m link at threshold t, they share at least ceil(t * n) tokens, and
so at least min(l, l') tokens lie in both of their prefixes of n - ceil(t * n) + l and
m - ceil(t * m) + l' tokens. Each document picks its own l: where the sketch foretells many
candidates, the prefix gets longer and more of its tokens must be shared before a pair is verified.

Candidates without all pairs of a group
1. Postings (token, document) are shuffled by token. In each list the most central document (by the
   sketch) is the hub; every other member is paired with it, which is linear in the postings.
2. Hub pairs that share a fair part of their prefixes are verified on whole sets; the links found
   give provisional components.
3. Of the lists only tokens that several components hold go on, gathered by hub and document, in blocks
   bounded by documents and by tokens. Shared tokens are counted for pairs across components only, as a
   product of incidence matrices taken in slices of tokens. A pair goes on if its count can still reach
   what its sizes, prefix ends and l demand. Its shared tokens may lie under several hubs: one hub must
   hold its share of that number, and with all that the two have under other hubs the number must be reached.
4. Those pairs are verified on whole sets. Every pair that links is then either inside a provisional
   component or among these, so the components of all links found are exact.

Defined results
- null and empty texts have no shingles and are linked with nothing; texts of fewer words than a
  shingle are one shingle, their whole sequence;
- rows that share an id but not a set are joined on their own, and rows that share both are copies;
  a null id counts as the smallest id inside and comes out as null; an empty table gives an empty result;
- a text of any length is one set of hashes, and what a task holds of a family of texts is bounded;
- keep_one keeps rows by id, and of rows that share id and text one; other columns are carried along by place,
  whatever their names;
- sets are compared by 64-bit hashes: two shingles of a pair are confused with probability 2^-64.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE_BYTES, Kept, arrow_rows, by_place, combine, mix64, small_side, staged, table, word_hashes
from .components import connected_components

WORDS = 5
THRESHOLD = 75  # percent
SKETCH_BITS = 20
_CHUNKS = 16
_FAN = 200  # partial counts that one group adds
LEVELS = (1, 2, 4, 8, 16)
CANDIDATE_COST = 4.0  # of one expected candidate, in postings
STAR_SHARE = 0.25  # of the shorter prefix that a hub pair must share to be verified early
BLOCK_DOCS = 512
BLOCK_TOKENS = 1 << 20
SLICE_CELLS = 1 << 22  # of an incidence matrix at a time
BATCH_ROWS = 1000
BROADCAST_BYTES = 8 << 20  # of ids, before a join on them moves texts


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    if not text:
        return np.empty(0, np.uint64)
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower(), SPACE_BYTES)
    return np.unique(combine(h, min(words, len(h)))) if len(h) else np.empty(0, np.uint64)


def _least(n):
    """ceil(t * n): tokens that a set of n shares with any partner."""
    return (THRESHOLD * n + 99) // 100


def links(n_a: int, n_b: int, shared: int) -> bool:
    return shared > 0 and 100 * shared >= THRESHOLD * (n_a + n_b - shared)


# --- the sketch ----------------------------------------------------------------------------------


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch_part(words: int):
    def run(batches):
        counts, held, size = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        for b in batches:
            for t in b.column("text"):
                held.append(_cells(shingles(t.as_py(), words)))
                size += len(held[-1])
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        task = TaskContext.get().partitionId()
        parts = [zlib.compress(c.astype(np.int64).tobytes(), 1) for c in np.split(counts, _CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([task] * _CHUNKS, pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "task", "counts"])

    return run


def _add(pdf):
    total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in pdf["counts"])
    return pdf.iloc[:1].assign(counts=[zlib.compress(total.tobytes(), 1)])


def sketch(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """How many shingles fall in each of 2^SKETCH_BITS cells, over all documents; its size is fixed.

    Partial counts are added up level by level, so what a group adds doesn't grow with the number of tasks.
    """
    kind = "chunk int, task int, counts binary"
    some = docs.select("text").mapInArrow(_sketch_part(words), kind)
    for level in (_FAN, _FAN**2, _FAN**4):
        some = some.groupBy("chunk", F.floor(F.col("task") / level).alias("g")).applyInPandas(_add, kind)
    rows = some.collect()
    out = np.zeros((_CHUNKS, (1 << SKETCH_BITS) // _CHUNKS), np.int64)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out.reshape(-1)


# --- documents -----------------------------------------------------------------------------------

_DOC = "doc bigint, n int, s1 bigint, s2 bigint, p int, l int, central int, end_count bigint, end_token bigint, prefix array<bigint>"


def prefix_of(h: np.ndarray, counts: np.ndarray, mean: float) -> tuple[np.ndarray, int, float, int]:
    """The prefix of a set in global order, its l, how much the set is shared, and the count at its end."""
    n = len(h)
    est = counts[_cells(h)]
    order = np.lexsort((h, est))
    excess = np.cumsum(np.maximum(est[order] - mean, 0.0))
    base = n - _least(n)
    best = None
    for level in LEVELS:
        level = min(level, _least(n))
        p = base + level
        cost = p + CANDIDATE_COST * excess[p - 1] / level
        if best is None or cost < best[0]:
            best = (cost, level, p)
    _, level, p = best
    return h[order[:p]], level, float(excess[-1]) / n, int(est[order[p - 1]])


def _documents(cast, words: int):
    names = [x.split()[0] for x in _DOC.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches):
        counts, mean = cast.value
        for b in batches:
            rows, prefixes = [], []
            for d, t in zip(b.column("doc").to_pylist(), b.column("text"), strict=True):
                h = shingles(t.as_py(), words)
                if not len(h):
                    rows.append((d, 0, 0, 0, 0, 0, 0, 0, 0))
                    prefixes.append(h)
                    continue
                pre, level, shared, end = prefix_of(h, counts, mean)
                rows.append((d, len(h), *_sums(h), len(pre), level, -int(min(shared, 1e9)), end, int(pre[-1].astype(np.int64))))
                prefixes.append(pre)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in prefixes]))).astype(np.int32)
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.empty(0, np.int64)
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=names)

    return run


# --- candidates ----------------------------------------------------------------------------------


def _hubs(batches):
    """From postings sorted by (token, central, doc): the first document of each list with every member."""
    last_token = last_hub = None
    open_ = None  # a first member whose list may have no other
    for b in batches:
        if not b.num_rows:
            continue
        token, doc = (b.column(c).to_numpy(zero_copy_only=False) for c in ("token", "doc"))
        new = np.empty(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        new[0] = last_token is None or token[0] != last_token
        run = np.cumsum(new)  # 0 while the list of the last batch goes on
        first = np.flatnonzero(new)
        hub = np.where(run > 0, doc[first[np.maximum(run - 1, 0)]] if len(first) else 0, last_hub if last_hub is not None else 0)
        alone = np.zeros(len(token), bool)
        nxt = np.append(new[1:], False)
        alone[new & nxt] = True  # the next row begins another list
        tail = new[-1]
        out = ~alone
        if tail:
            out[-1] = False
        cols = [hub[out], token[out], doc[out]]
        if open_ is not None and not new[0]:
            cols = [np.concatenate(([x], c)) for x, c in zip(open_, cols, strict=True)]
        open_ = (doc[-1], token[-1], doc[-1]) if tail else None
        last_token, last_hub = token[-1], hub[-1]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["hub", "token", "doc"])


_MEMBER = {"hub": "bigint", "b1": "int", "b2": "int", "block": "int", "doc": "bigint", "comp": "bigint", "n": "int", "p": "int", "l": "int", "hubs": "int", "elsewhere": "int", "end_count": "bigint", "end_token": "bigint"}
_FACTS = tuple(_MEMBER)[4:]


def shared_counts(doc: np.ndarray, token: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens each of the left documents shares with each of the right, from (document, token) rows.

    left and right are numbers of documents; the incidence matrix is made for a slice of tokens at a time.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(token, kind="stable")
    doc, col = doc[order], np.unique(token[order], return_inverse=True)[1]
    step = max(1, SLICE_CELLS // (len(left) + len(right)))
    n = int(col[-1]) + 1 if len(col) else 0
    where = np.full(int(doc.max(initial=-1)) + 1, -1)
    for a in range(0, n, step):
        i, z = np.searchsorted(col, [a, a + step])
        part = []
        for side in (left, right):
            where[:] = -1
            where[side] = np.arange(len(side))
            row = where[doc[i:z]]
            x = np.zeros((len(side), min(step, n - a)), np.float32)
            x[row[row >= 0], col[i:z][row >= 0] - a] = 1
            part.append(x)
        out += part[0] @ part[1].T
    return out


def cross_pairs(g: dict[str, np.ndarray], size: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a hub's documents in different components that may link: of one block, or of two with a document from each.

    g holds facts of the documents, size how many tokens each has, tokens these in a row.
    """
    comp, n, p, level, hubs, elsewhere, end_c = (g[c].astype(np.int64) for c in ("comp", "n", "p", "l", "hubs", "elsewhere", "end_count"))
    doc, end_t = g["doc"], g["end_token"].astype(np.int64).view(np.uint64)
    one = g["b1"][0] == g["b2"][0]
    left, right = np.flatnonzero(g["block"] == g["b1"][0]), np.flatnonzero(g["block"] == g["b2"][0])
    of, (_, col) = np.repeat(np.arange(len(doc)), size), np.unique(tokens, return_inverse=True)
    lo, hi = np.full(int(col.max(initial=-1)) + 1, 2**63 - 1), np.full(int(col.max(initial=-1)) + 1, -(2**63))
    np.minimum.at(lo, col, comp[of])
    np.maximum.at(hi, col, comp[of])
    use = (lo != hi)[col]
    if not use.any() or not len(left) or not len(right):
        return doc[:0], doc[:0]
    count = shared_counts(of[use], col[use], left, right)
    ii, jj = np.nonzero(count)
    k = np.rint(count[ii, jj]).astype(np.int64)
    ii, jj = left[ii], right[jj]
    ok = (comp[ii] != comp[jj]) & (100 * np.minimum(n[ii], n[jj]) >= THRESHOLD * np.maximum(n[ii], n[jj]))
    if one:
        ok &= ii < jj
    ii, jj, k = ii[ok], jj[ok], k[ok]
    need = -(-THRESHOLD * (n[ii] + n[jj]) // (100 + THRESHOLD))  # shared tokens that a link takes
    sooner = (end_c[ii] < end_c[jj]) | ((end_c[ii] == end_c[jj]) & (end_t[ii] < end_t[jj]))
    # What lies beyond the prefix that ends first can't be counted here.
    need = np.maximum(need - np.where(sooner, n[ii] - p[ii], n[jj] - p[jj]), np.minimum(level[ii], level[jj]))
    share = -(-need // np.minimum(hubs[ii], hubs[jj]))
    ok = (k >= share) & (k + np.minimum(elsewhere[ii], elsewhere[jj]) >= need)
    a, b = doc[ii[ok]], doc[jj[ok]]
    return np.minimum(a, b), np.maximum(a, b)


def _cross(batches):
    """cross_pairs for each (hub, b1, b2) of a sorted partition."""
    held: list[pa.RecordBatch] = []
    group = tuple(_MEMBER)[:3]

    def flush(t: pa.Table):
        cols = {c: t.column(c).to_numpy() for c in _MEMBER}
        lists = t.column("tokens").combine_chunks()
        size, tokens = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        at = np.concatenate(([0], np.cumsum(size)))
        edge = np.flatnonzero(np.any([np.diff(cols[c], prepend=cols[c][0]) != 0 for c in group], axis=0))
        edge = np.unique(np.concatenate(([0], edge, [t.num_rows])))
        lo, hi = (f.reduceat(cols["comp"], edge[:-1]) for f in (np.minimum, np.maximum))
        for i in np.flatnonzero(lo != hi):
            x, y = edge[i], edge[i + 1]
            a, b = cross_pairs({c: v[x:y] for c, v in cols.items()}, size[x:y], tokens[at[x] : at[y]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def same(x: pa.RecordBatch, y: pa.RecordBatch) -> bool:
        return all(x.column(c)[x.num_rows - 1].as_py() == y.column(c)[0].as_py() for c in group)

    for b in batches:
        if not b.num_rows:
            continue
        if held and not same(held[-1], b):
            yield from flush(pa.Table.from_batches(held))
            held = []
        # All but the last group of the batch are whole.
        key = [b.column(c).to_numpy() for c in group]
        cut = int(np.flatnonzero(np.any([k != k[-1] for k in key], axis=0)).max(initial=-1)) + 1
        if cut:
            yield from flush(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = []
        held.append(b.slice(cut))
    if held:
        yield from flush(pa.Table.from_batches(held))


# --- verification --------------------------------------------------------------------------------


def _sums(h: np.ndarray) -> tuple[int, int]:
    """Two sums over a set that tell it from any other."""
    return tuple(int(mix64(x).sum(dtype=np.uint64).astype(np.int64)) for x in (h, h ^ np.uint64(0x5851F42D4C957F2D)))


def _sets(words: int):
    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column("text")]
            sums = [_sums(s) for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            cols = [pa.array([len(s) for s in sets], pa.int32()), *(pa.array([x[k] for x in sums], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["n", "s1", "s2", "tokens"])

    return run


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, keep: Kept) -> DataFrame:
    """Of the pairs (a, b) of class nodes, those whose whole sets link. texts: (doc, text)."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = keep.stage(classes.join(nodes, "node", "left_semi"), "jaccard-wanted")
    some = texts.join(small_side(wanted.select(F.col("rep").alias("doc")).distinct(), BROADCAST_BYTES), "doc", "left_semi").select("text")
    sets = some.mapInArrow(_sets(words), "n int, s1 bigint, s2 bigint, tokens array<bigint>")
    sets = keep.stage(sets.join(wanted, ["s1", "s2", "n"]).dropDuplicates(["node"]).select("node", "tokens"), "jaccard-sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y")).cast("bigint")
    linked = (F.col("shared") > 0) & (100 * F.col("shared") >= THRESHOLD * (F.col("nx") + F.col("ny") - F.col("shared")))
    return keep.stage(both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), shared.alias("shared")).where(linked).select("a", "b"), "jaccard-links")


# --- the join ------------------------------------------------------------------------------------


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc, n_shingles, class_id, component_id, n_links), one row for each row of docs.

    doc is the id with NULL_ID for null; class_id is the smallest document with an equal set. n_links
    counts the links verified for the class, which are enough to connect its component.
    """
    # Every job runs before this returns, so the setting holds for them and for nothing else.
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _components(docs, doc_id, text, words, block_docs)


def _components(docs: DataFrame, doc_id: str, text: str, words: int, block_docs: int) -> DataFrame:
    spark, keep = docs.sparkSession, Kept()
    flat, at = by_place(docs)
    own = flat.select(F.coalesce(F.col(at[doc_id]).cast("bigint"), F.lit(NULL_ID)).alias("doc"), F.col(at[text]).alias("text"))
    counts = sketch(own, words)
    cast = spark.sparkContext.broadcast((counts, float(counts.mean())))
    found = keep(own.mapInArrow(_documents(cast, words), _DOC))
    # A class that a third of all documents share is one row a task after partial aggregation.
    classes = found.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep"))
    # A class is named by its smallest document, or by a hash where an id stands for several sets.
    turn = F.row_number().over(Window.partitionBy("rep").orderBy("s1", "s2", "n"))
    classes = keep.stage(classes.withColumn("turn", turn).withColumn("node", F.when(F.col("turn") == 1, F.col("rep")).otherwise(F.xxhash64("rep", "s1", "s2"))).drop("turn"), "jaccard-classes")
    whole = found.where("n > 0").join(classes, ["s1", "s2", "n"]).where("doc = rep").drop("doc").withColumnRenamed("node", "doc")
    # Rows that repeat are told apart no further: one stands for its class.
    reps = whole.dropDuplicates(["s1", "s2", "n"])
    postings = reps.select("doc", "central", F.explode("prefix").alias("token"))
    spread = postings.repartition("token").sortWithinPartitions("token", "central", "doc")
    lists = keep.stage(spread.mapInArrow(_hubs, "hub bigint, token bigint, doc bigint"), "jaccard-lists")
    stars = keep.stage(lists.groupBy("hub", "doc").agg(F.count("*").alias("k")), "jaccard-stars")
    facts = keep.stage(reps.select("doc", "n", "p", "l", "end_count", "end_token"), "jaccard-facts")

    sized = stars.where("hub <> doc").join(facts.select("doc", "n", "p"), "doc").join(facts.select(F.col("doc").alias("hub"), F.col("n").alias("hn"), F.col("p").alias("hp")), "hub")
    near = (100 * F.least("n", "hn") >= THRESHOLD * F.greatest("n", "hn")) & (F.col("k") >= F.greatest(F.lit(1), STAR_SHARE * F.least("p", "hp")))
    first = verified(sized.where(near).select(F.col("hub").alias("a"), F.col("doc").alias("b")), classes, own, words, keep)
    provisional = connected_components(first)

    # Hubs under which several components meet, then the tokens that several of them hold: all else is settled.
    star = stars.join(provisional.select(F.col("node").alias("doc"), "component"), "doc", "left").select("hub", "doc", "k", F.coalesce("component", "doc").alias("comp"))
    star = keep.stage(star, "jaccard-components-met")
    several = lambda df, by: df.groupBy(by).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(by)
    met = keep.stage(star.join(small_side(several(star, "hub"), BROADCAST_BYTES), "hub", "left_semi"), "jaccard-met")
    mixed = keep.stage(lists.join(met.select("hub", "doc", "comp"), ["hub", "doc"]), "jaccard-mixed")
    mixed = mixed.join(small_side(several(mixed, "token"), BROADCAST_BYTES), "token", "left_semi")
    # An array is as long as a document's prefix at most.
    held = keep.stage(mixed.groupBy("hub", "doc").agg(F.collect_list("token").alias("tokens")), "jaccard-held")
    sizes = held.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum(F.size("tokens")) / BLOCK_TOKENS)).cast("int").alias("blocks"))
    hubs = stars.groupBy("doc").agg(F.count("*").alias("hubs"), F.sum("k").alias("postings"))
    member = (
        held.join(met, ["hub", "doc"])
        .join(sizes, "hub")
        .join(facts.join(hubs, "doc"), "doc")
        .withColumn("elsewhere", F.col("postings") - F.col("k"))
        .withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("b1", F.least("block", "other"))
        .withColumn("b2", F.greatest("block", "other"))
    )
    member = member.select(*(F.col(c).cast(kind).alias(c) for c, kind in _MEMBER.items()), "tokens")
    cross = member.repartition("hub", "b1", "b2").sortWithinPartitions("hub", "b1", "b2").mapInArrow(_cross, "a bigint, b bigint")
    second = verified(keep.stage(cross.distinct(), "jaccard-cross"), classes, own, words, keep)
    all_links = first.union(second)
    components = connected_components(all_links)
    degree = all_links.select(F.col("a").alias("node")).union(all_links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = classes.join(components, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("component", "node"))
    roots = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = named.join(roots, "root").select("s1", "s2", "n", F.col("rep").alias("class_id"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = found.select("doc", "n", "s1", "s2").join(labels, ["s1", "s2", "n"], "left").select(
        "doc",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("component_id", "doc").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )
    out = staged(rows, "jaccard-components")
    keep.release()
    return out


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the smallest of their component, with their columns as they were; of rows that share id and text one."""
    flat, at = by_place(docs)
    seen = jaccard_components(docs, doc_id=doc_id, text=text).groupBy("doc").agg(F.max(F.col("doc") == F.col("component_id")).alias("first"), F.count("*").alias("rows"))
    flat = flat.withColumn("key", F.coalesce(F.col(at[doc_id]).cast("bigint"), F.lit(NULL_ID)))
    # Most documents stay, so those that go are the smaller side.
    gone = seen.where("NOT first").select(F.col("doc").alias("key"))
    kept = flat.join(small_side(gone, BROADCAST_BYTES), "key", "left_anti")
    again = staged(seen.where("first AND rows > 1").select(F.col("doc").alias("key")), "jaccard-repeated")
    if not again.isEmpty():
        side = small_side(again, BROADCAST_BYTES)
        once = kept.join(side, "key", "left_semi").dropDuplicates(["key", at[text]])
        kept = kept.join(side, "key", "left_anti").unionByName(once)
    return kept.select(*(c for c in flat.columns if c != "key")).toDF(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: set size and component of every document."""
    out = jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(null("doc").alias("doc_id"), "n_shingles", null("component_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM pairs JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.y) AS component_id
FROM d JOIN reach ON d.doc_id = reach.x LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id, n.n
"""
