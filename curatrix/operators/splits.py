"""Leakage-safe splits: clusters stay together, splits are stratified, files are balanced and hashed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import seeded
from ..staging import staged

#: Clusters of a wave of the deal.
WAVE = 100_000


def collapse_exact(df: DataFrame, cluster: str, text: str, pos: str) -> DataFrame:
    """The first of equal texts in a cluster."""
    rn = F.row_number().over(Window.partitionBy(cluster, F.md5(F.coalesce(F.col(text), F.lit(""))), text).orderBy(pos))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def majority_domain(df: DataFrame, cluster: str, domain: str, pos: str) -> DataFrame:
    """(cluster, domain, size): the most frequent domain, the first met of equals."""
    counts = df.groupBy(cluster, domain).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    best = F.max_by(domain, F.struct("n", (-F.col("first")).alias("first")))
    return counts.groupBy(cluster).agg(best.alias("domain"), F.sum("n").alias("size"))


def seats(sizes: dict[str, int]) -> np.ndarray:
    """The round in which splits take clusters, by split number: each as often as its size holds the smallest.

    A split of size 0 has no seat; sizes below 0, or none above 0, are refused.
    """
    each = np.array(list(sizes.values()), np.int64)
    if not len(each) or each.min() < 0 or each.max() == 0:
        raise ValueError(f"a deal takes sizes of 0 or more, one above 0: {sizes}")
    return np.repeat(np.arange(len(each)), each // each[each > 0].min())


def ranked(df: DataFrame, order: list) -> DataFrame:
    """df with `rank` from 0 in a global order, from places inside sorted ranges and the sizes of the ranges before."""
    spread = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    base, starts = 0, []
    for part, n in sorted((r[0], r[1]) for r in spread.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()):
        starts.append((part, base))
        base += n
    offsets = df.sparkSession.createDataFrame(starts, "_p bigint, _base bigint")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_base")
    return spread.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_p").withColumn("rank", place).drop("_at", "_p", "_base")


def deal_simple(df: DataFrame, sizes: dict[str, int], *, domain: str, key: str, seed: int = 7) -> DataFrame:
    """Splits for single-record clusters while no split fills up: the rank in (domain, seeded order) by the round of seats.

    The rank is global; it comes from a sort by ranges, so no task holds more than a range of a domain.
    """
    round_, names = seats(sizes), list(sizes)
    placed = ranked(df.withColumn("_s", seeded(seed, F.col(key))), [F.col(domain), F.col("_s"), F.col(key)]).drop("_s")
    split = F.get(F.array(*(F.lit(names[i]) for i in round_)), (F.col("rank") % len(round_)).cast("int"))
    return placed.withColumn("split", split)


def deal_wave(size: np.ndarray, round_: np.ndarray, room: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(split of each cluster, room left, next seat) of clusters in order.

    A cluster goes to the next seat of the round whose split has room for it; where none has, to the split
    with most room, and the round stands still. While nobody is refused, seats are taken in turn, which is
    settled for many clusters at once: a refusal is where what a split has taken exceeds its room.
    """
    out, room, k, step = np.empty(len(size), np.int32), room.copy(), 0, 64
    while k < len(size):
        some = size[k : k + step]
        turn = round_[(at + np.arange(len(some))) % len(round_)]
        load = np.zeros((len(some), len(room)), np.int64)
        load[np.arange(len(some)), turn] = some
        over = np.flatnonzero((load.cumsum(0) > room).any(1))
        good = int(over[0]) if len(over) else len(some)
        out[k : k + good] = turn[:good]
        room -= load[:good].sum(0)
        at, k, step = (at + good) % len(round_), k + good, min(4 * step, 1 << 14)
        if len(over):
            ahead = np.roll(round_, -at)
            fits = np.flatnonzero(room[ahead] >= size[k])
            out[k] = ahead[fits[0]] if len(fits) else room.argmax()
            at = (at + int(fits[0]) + 1) % len(round_) if len(fits) else at
            room[out[k]] -= size[k]
            k, step = k + 1, 64
    return out, room, at


def seat_loads(order: DataFrame, n_seats: int, wave: int) -> DataFrame:
    """(wave, seat, n, size): what the clusters of a wave that are n_seats apart weigh together.

    While no split refuses, the i-th cluster of a wave takes the i-th seat after the one the wave enters with.
    So these few sums tell what the wave puts into each split from any seat it may enter with: a wave is a
    function of the seat and the room it is given, made without knowing either.
    """
    at = F.col("rank") - F.col("wave") * wave
    return order.groupBy("wave", (at % n_seats).cast("int").alias("seat")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def deal(df: DataFrame, sizes: dict[str, int], *, cluster: str, domain: str, pos: str, seed: int = 7, wave: int = WAVE, replay: int = 8) -> DataFrame:
    """Splits for clusters of any size, in the order of majority domain and seeded cluster.

    Waves of clusters are functions of the room and seat they are given, as of seat_loads(). These are
    composed in order on the driver, which takes a sum for each seat and wave. A split never gets more room,
    so a wave whose loads fit is refused nowhere, and all such waves are dealt in one job at the end, from
    the seats they enter with. Where one doesn't fit, it and those after it, replay in number, are dealt by
    one task in turn; what that leaves goes on. So only what lies near a refusal is sequential.
    """
    spark, round_, names = df.sparkSession, seats(sizes), list(sizes)
    some = majority_domain(df, cluster, domain, pos).select(F.col(cluster).alias("c"), "domain", "size").withColumn("s", seeded(seed, F.col("c")))
    order = ranked(some, [F.col("domain"), F.col("s"), F.col("c")]).select("c", F.col("size").cast("bigint").alias("size"), "rank", F.floor(F.col("rank") / wave).cast("bigint").alias("wave"))
    order = staged(order.sortWithinPartitions("rank"), "deal-order")
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for r in seat_loads(order, len(round_), wave).toLocalIterator():
        sums.setdefault(r["wave"], np.zeros(len(round_), np.int64))[r["seat"]] = r["size"]
        counts[r["wave"]] = counts.get(r["wave"], 0) + r["n"]
    waves, kind = len(counts), order.schema["c"].dataType.simpleString()
    room, at, w, entries, replayed = np.array(list(sizes.values()), np.int64), 0, 0, [], []

    def dealt(room, at):
        def run(batches):
            free, seat = room, at
            for b in batches:
                out, free, seat = deal_wave(b.column("size").to_numpy(), round_, free, seat)
                yield pa.RecordBatch.from_arrays([b.column("c"), b.column("size"), b.column("rank"), pa.array(out, pa.int32()), pa.array(np.full(len(out), seat), pa.int32())], names=["c", "size", "rank", "split", "seat"])

        return run

    while w < waves:
        load = np.bincount(round_[(at + np.arange(len(round_))) % len(round_)], weights=sums[w], minlength=len(names)).astype(np.int64)
        if (load <= room).all():
            entries.append((w, at))
            room, at, w = room - load, (at + counts[w]) % len(round_), w + 1
            continue
        upto = min(w + replay, waves)
        one = order.where(F.col("wave").between(w, upto - 1)).coalesce(1).sortWithinPartitions("rank")
        one = staged(one.mapInArrow(dealt(room, at), f"c {kind}, size bigint, rank bigint, split int, seat int"), "deal")
        taken = {r[0]: r[1] for r in one.groupBy("split").agg(F.sum("size")).collect()}
        room, at = room - np.array([taken.get(i, 0) for i in range(len(names))], np.int64), one.agg(F.max_by("seat", "rank")).first()[0]
        replayed.append(one.select("c", "split"))
        w = upto
    known = spark.createDataFrame(entries, "wave bigint, at int")
    seat = (F.col("at") + F.col("rank") - F.col("wave") * wave) % len(round_)
    # One row for each wave.
    done = order.join(F.broadcast(known), "wave").select("c", F.get(F.array(*(F.lit(int(i)) for i in round_)), seat.cast("int")).alias("split"))
    for one in replayed:
        done = done.unionByName(one)
    named = F.get(F.array(*map(F.lit, names)), F.col("split"))
    return df.join(done.select(F.col("c").alias(cluster), named.alias("split")), cluster)


def shards(df: DataFrame, record: str, pos: str, size: int = 100) -> DataFrame:
    """A shard for each record: by falling length, dealt round, ceil(n / size) of them where there are more than size."""
    n = df.count()
    k = -(-n // size) if n > size else 1
    placed = ranked(df.withColumn("_len", F.length(record)), [F.col("_len").desc(), F.col(pos)])
    return placed.withColumn("shard", (F.col("rank") % k).cast("bigint")).drop("_len", "rank")


def content_hash(df: DataFrame, by: str, record: str, digits: int = 4) -> DataFrame:
    """(by, n_records, sha256) of each group's records, whatever their order: a tree of two levels.

    A leaf hashes the sorted hashes that share their first hexadecimal digits, the root the leaves in
    order, so no array holds more than a leaf's share of a group, or 16^digits leaves.
    """
    each = df.select(by, F.sha2(F.col(record), 256).alias("h"))
    rolled = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    leaves = each.groupBy(by, F.substring("h", 1, digits).alias("d")).agg(F.count("*").alias("n"), rolled("h").alias("h"))
    root = rolled(F.concat("d", F.lit(":"), "h"))
    return leaves.groupBy(by).agg(F.sum("n").alias("n_records"), root.alias("sha256"))


#: Files up to this size are hashed in one piece; lines of a leaf of the tree that hashes larger ones.
WHOLE_FILE = 256 << 20
LEAF_LINES = 4096


def tree_hashes(lines: DataFrame, leaf: int = LEAF_LINES) -> DataFrame:
    """(file, sha256, n_lines) from (file, _at, value), the lines of files and an order that is theirs.

    A line's hash, then that of each run of leaf lines by their hashes, then the file's by its leaves': no
    task holds more than a leaf or a file's leaves, and line numbers come from sorted ranges.
    """
    each = ranked(lines.select("file", "_at", F.sha2(F.col("value").cast("binary"), 256).alias("h"), (F.trim("value") != "").alias("full")), [F.col("file"), F.col("_at")])
    first = each.groupBy("file").agg(F.min("rank").alias("first"))
    numbered = each.join(first, "file").withColumn("no", F.col("rank") - F.col("first"))
    rolled = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"]), "\n"), 256)
    leaves = numbered.groupBy("file", F.floor(F.col("no") / leaf).alias("no")).agg(F.count_if("full").alias("n"), rolled(F.struct("no", "h")).alias("h"))
    return leaves.groupBy("file").agg(rolled(F.struct("no", "h")).alias("sha256"), F.sum("n").alias("n_lines"))


def manifest(spark: SparkSession, folder: str, *, pattern: str = "*.json*", whole: int = WHOLE_FILE, **facts) -> DataFrame:
    """(file, sha256, n_lines) of the files below a folder, by their paths from there, with the run's facts as columns.

    Files over `whole` bytes are read by line in as many tasks as they have blocks, and hashed as a tree of
    lines (tree_hashes(); a last line feed makes no difference). Others have the hash of their bytes.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    named = lambda c: F.expr(f"substring(regexp_replace({c}, '^[a-z]+:/*', '/'), {len(base) + 2})").alias("file")
    where = {"recursiveFileLookup": "true", "pathGlobFilter": pattern}
    small = spark.read.format("binaryFile").options(**where).load(folder).where(F.col("length") <= whole)
    out = small.select(named("path"), F.sha2("content", 256).alias("sha256"), F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != "")).cast("bigint").alias("n_lines"))
    large = spark.read.format("binaryFile").options(**where).load(folder).where(F.col("length") > whole).select("path")
    if not large.isEmpty():
        # A line feed alone ends a line, so all other bytes are hashed.
        lines = spark.read.options(**where, lineSep="\n").text(folder).where(F.col("_metadata.file_size") > whole)
        at = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        out = out.unionByName(tree_hashes(lines.select(named("_metadata.file_path"), at.alias("_at"), "value")))
    for k, v in facts.items():
        out = out.withColumn(k, F.lit(v))
    return out


def verify(spark: SparkSession, folder: str, expected: DataFrame, *, pattern: str = "*.json*", whole: int = WHOLE_FILE) -> bool:
    """Whether every file of the manifest is there with the same hash and number of lines, and no other.

    expected is a table that was written; a manifest() of the same folder that isn't is the folder as it is now.
    """
    now = manifest(spark, folder, pattern=pattern, whole=whole).select("file", F.col("sha256").alias("_h"), F.col("n_lines").alias("_n"))
    both = expected.join(now, "file", "full_outer")
    return both.where(~(F.col("sha256").eqNullSafe(F.col("_h")) & F.col("n_lines").eqNullSafe(F.col("_n")))).isEmpty()


def exemplars(df: DataFrame, ids: list[str], *, key: str = "id", low: int = 5000, high: int = 10000, size=None) -> DataFrame:
    """The fixed exemplars in their order; one that is missing or outside the size band fails the query."""
    want = df.sparkSession.createDataFrame(list(enumerate(ids)), f"_i int, {key} {df.schema[key].dataType.simpleString()}")
    out = want.join(df, key, "left")
    n = F.col("_size") if size is None else size
    out = out.where(F.assert_true(F.coalesce(n.between(low, high), F.lit(False)), "an exemplar is missing or outside the band").isNull())
    return out.orderBy("_i").drop("_i")


def exemplar_leaks(ids: DataFrame, train: DataFrame, *held_out: DataFrame, key: str = "id") -> DataFrame:
    """Exemplars that are not in train, or are in a held-out split."""
    bad = ids.join(train.select(key), key, "left_anti").select(key)
    for other in held_out:
        bad = bad.union(ids.join(other.select(key), key, "left_semi").select(key))
    return bad.distinct()
