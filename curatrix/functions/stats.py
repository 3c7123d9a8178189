"""Aggregates and scalar statistics: percentiles, intervals, exact tests, composite scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Weights of the five layers of the score.
WEIGHTS = {"l1": 0.25, "l2": 0.25, "l3": 0.20, "l4": 0.15, "l5": 0.15}
Z95 = 1.96


def percentile(col: Column, q: float) -> Column:
    """Linear interpolation between order statistics, q from 0 to 100."""
    if not 0 <= q <= 100:
        raise ValueError("q must be between 0 and 100")
    return F.percentile(col, F.lit(float(q) / 100))


#: Distinct values of a group that one buffer takes.
MOST_DISTINCT = 1 << 20


def _interpolated(low: Column, high: Column, at: Column) -> Column:
    """Between the order statistics at floor(at) and ceil(at)."""
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def selected_quantiles(counts: DataFrame, by: list[str], qs: tuple[float, ...]) -> DataFrame:
    """(by, q: array) from (by, v, k), the distinct values of each group and how often they stand.

    Values are dealt to sorted ranges. Sums over ranges tell which of them hold the order statistics, and only
    in those are values ranked: nothing gathers a group, however many distinct values it has.
    """
    spread = staged(counts.repartitionByRange(*by, "v").withColumn("part", F.spark_partition_id()), "value-ranges")
    ranges = spread.groupBy(*by, "part").agg(F.sum("k").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*by).orderBy("part"))
    ranges = ranges.withColumn("upto", upto).withColumn("n", F.sum("k").over(Window.partitionBy(*by)))
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ends = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(e).alias("e"), f(at(q)).cast("bigint").alias("rank")) for i, q in enumerate(qs) for e, f in enumerate((F.floor, F.ceil))))
    want = ranges.select(*by, "part", "n", "k", "upto", F.explode(ends).alias("w")).where("w.rank < upto AND w.rank >= upto - k").select(*by, "part", "n", (F.col("upto") - F.col("k")).alias("before"), "w.i", "w.e", "w.rank")
    inside = spread.join(want.select(*by, "part").distinct(), [*by, "part"], "left_semi")
    inside = inside.withColumn("last", F.sum("k").over(Window.partitionBy(*by, "part").orderBy("v")))
    hits = inside.join(want, [*by, "part"]).where("rank < before + last AND rank >= before + last - k")
    rows = hits.groupBy(*by, "i", "n").agg(F.max(F.when(F.col("e") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("e") == 1, F.col("v"))).alias("high"))
    q = F.get(F.array(*(F.lit(float(x)) for x in qs)), F.col("i"))
    value = _interpolated(F.col("low").cast("double"), F.col("high").cast("double"), (F.col("n") - 1) * q)
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"]).alias("q"))


def length_stats(df: DataFrame, length: str, by: list[str] | None = None, most: int = MOST_DISTINCT) -> DataFrame:
    """Count, mean, median, upper percentiles and maximum; zeros for an empty table.

    Records are reduced to distinct values and their counts. Where no group has more than `most` of these,
    one buffer takes a group; beyond that the percentiles are selected by ranges, with the same values.
    """
    by, qs = by or [], (0.5, 0.9, 0.95, 0.99)
    keys = {c: f"g{i}" for i, c in enumerate(by)}
    counts = staged(df.groupBy(*(F.col(c).alias(g) for c, g in keys.items()), F.col(length).alias("v")).agg(F.count("*").alias("k")), "value-counts")
    real, g = counts.where("v IS NOT NULL"), list(keys.values())
    v, k = F.col("v").cast("double"), F.col("k")
    facts = [F.coalesce(F.sum(F.when(F.col("v").isNotNull(), k)), F.lit(0)).alias("n"), F.try_divide(F.sum(v * k), F.sum(F.when(F.col("v").isNotNull(), k))).alias("mean"), F.max("v").alias("longest")]
    if real.groupBy(*g).count().where(F.col("count") > most).isEmpty():
        out = counts.groupBy(*g).agg(*facts, F.percentile("v", F.array(*map(F.lit, qs)), F.col("k")).alias("q"))
    else:
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in g]
        sides = counts.groupBy(*g).agg(*facts).alias("x"), selected_quantiles(real.withColumns({c: F.struct(c) for c in g}), g, qs).withColumns({c: F.col(c)[c] for c in g}).alias("y")
        out = (sides[0].join(sides[1], reduce(Column.__and__, same), "left") if g else sides[0].crossJoin(sides[1])).select(*(F.col(f"x.{c}") for c in g), "n", "mean", "longest", "q")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return out.select(*(F.col(x).alias(c) for c, x in keys.items()), F.col("n").alias("n_records"), F.round(zero(F.col("mean")), 6).alias("mean"), *(F.round(zero(F.get("q", i)), 6).alias(p) for i, p in enumerate(("p50", "p90", "p95", "p99"))), F.coalesce(F.col("longest").cast("bigint"), F.lit(0)).cast("bigint").alias("max_len"))


def truncation(df: DataFrame, length: str, limits: tuple[int, ...]) -> DataFrame:
    """For each limit: records strictly longer, and their share in percent. One pass, then a row for each limit."""
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(length) > x).alias(f"over{x}") for x in limits))
    rows = F.array(*(F.struct(F.lit(x).cast("bigint").alias("threshold"), F.col(f"over{x}").alias("n_over")) for x in limits))
    out = counts.select("n", F.explode(rows).alias("r"))
    share = F.when(F.col("n") > 0, 100.0 * F.col("r.n_over") / F.col("n")).otherwise(0.0)
    return out.select("r.threshold", "r.n_over", F.round(share, 6).alias("pct_over"))


def wilson(p: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval for a rate p of n, held to 0..1; null for n of 0."""
    z2 = z * z
    centre = (p + F.lit(z2) / (2 * n)) / (1 + F.lit(z2) / n)
    half = z * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n)) / (1 + F.lit(z2) / n)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), centre - half)), F.when(ok, F.least(F.lit(1.0), centre + half))


def _stirling_error(n: Column) -> Column:
    """ln(n!) less Stirling's formula, of whole numbers from 1: exact up to 20, a series beyond."""
    small = F.ln(F.factorial(n.cast("int")).cast("double")) - (n + 0.5) * F.ln(n) + n - 0.5 * math.log(2 * math.pi)
    r = 1 / (n * n)
    return F.when(n <= 20, small).otherwise((1 / 12.0 - (1 / 360.0 - (1 / 1260.0 - (1 / 1680.0 - r / 1188.0) * r) * r) * r) / n)


def _half_binomial(n: Column, k: Column) -> Column:
    """The probability of k of n at one half, 0 < k < n, by its saddle point: large counts neither underflow nor cancel."""
    d = (n - 2 * k) / n
    away = n / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    return F.exp(_stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - away) * F.sqrt(n / (2 * math.pi * k * (n - k)))


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Two-sided exact test on the pairs that differ; 1 where none do.

    The tail of the binomial is the regularised incomplete beta function of (n - k, k + 1) at one half,
    a continued fraction times the probability of k. It settles in a number of steps that grows with the
    square root of n, so two thousand million pairs take some two hundred thousand steps in one row.
    """
    n, k = (only_a + only_b).cast("double"), F.least(only_a, only_b).cast("double")
    a, b, x = n - k, k + 1, 0.5
    steps = F.sequence(F.lit(1), (60 + 5 * F.ceil(F.sqrt(n))).cast("int"))
    tiny = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    d0 = 1 / tiny(1 - (a + b) * x / (a + 1))

    def half(s, term):
        d, c = 1 / tiny(1 + term * s["d"]), tiny(1 + term / s["c"])
        return F.struct(d.alias("d"), c.alias("c"), (s["h"] * d * c).alias("h"))

    def step(s, i):
        m = i.cast("double")
        even = half(s, m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)))
        return half(even, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)))

    first = F.struct(d0.alias("d"), F.lit(1.0).alias("c"), d0.alias("h"))
    fraction = F.aggregate(steps, first, step, lambda s: s["h"])
    # 2 P(X <= k), of which the fraction's factor is half the probability of k.
    return F.when((n == 0) | (only_a == only_b), 1.0).when(k == 0, F.least(F.lit(1.0), 2 * F.exp(-n * math.log(2)))).otherwise(F.least(F.lit(1.0), _half_binomial(n, k) * fraction))


def composite(l1: Column, l2: Column, l3: Column, l5: Column, l4: Column | None = None) -> tuple[Column, Column]:
    """The weighted score, and it divided by the weight of the layers that ran."""
    parts = {"l1": l1, "l2": l2, "l3": l3, "l5": l5} | ({"l4": l4} if l4 is not None else {})
    raw = sum((WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0))
    return raw, raw / sum(WEIGHTS[k] for k in parts)


def histogram(df: DataFrame, length: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts over bins of equal width in log10; the last bin is closed, values outside are left out."""
    x = F.log10(F.col(length).cast("double"))
    bin_ = F.when(x == high, bins).otherwise(F.floor((x - low) / ((high - low) / bins)) + 1)
    return df.where((F.col(length) > 0) & (x >= low) & (x <= high)).groupBy(bin_.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def poisson_limits() -> list[str]:
    """Where 32-bit hashes, as eight hexadecimal digits, pass from one value of a Poisson variable of mean 1 to the next."""
    out, term, below = [], math.exp(-1), 0.0
    for k in range(1, 14):
        below += term
        term /= k
        if (limit := math.ceil(below * 2**32)) < 2**32:
            out.append(f"{limit:08x}")
    return out


def bootstrap_ci(pairs: DataFrame, a: str, b: str, reps: int = 2000, seed: int = 42, key: str = "id") -> DataFrame:
    """(lo, hi, observed): percentile interval of the mean paired difference a - b, of booleans or numbers; nulls without pairs.

    A Poisson bootstrap: in each replicate a pair counts as often as a hash of seed, replicate and key says,
    so replicates are sums that merge in any order, whatever the partitions. Four replicates share a hash.
    Pairs where either side is null don't count; rows that repeat a key count alike.
    """
    d = pairs.select(F.col(key).cast("string").alias("k"), (F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).where("d IS NOT NULL")
    each = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // 4)))).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "block", "k")))
    times = [sum((F.substring("h", 8 * j + 1, 8) >= x).cast("int") for x in poisson_limits()) for j in range(4)]
    each = each.select("block", "d", *(w.alias(f"w{j}") for j, w in enumerate(times)))
    sums = each.groupBy("block").agg(*(F.struct(F.sum(f"w{j}").alias("w"), F.sum(F.col(f"w{j}") * F.col("d")).alias("s")).alias(f"r{j}") for j in range(4)))
    rows = sums.select("block", F.posexplode(F.array(*(f"r{j}" for j in range(4)))).alias("j", "r")).where((F.col("block") * 4 + F.col("j") < reps) & (F.col("r.w") > 0))
    # One list of as many means as there are replicates.
    means = rows.agg(F.array_sort(F.collect_list(F.col("r.s") / F.col("r.w"))).alias("m"))
    n = F.size("m")
    at = lambda q: F.get("m", F.least(n - 1, F.floor(n * F.lit(q)).cast("int")))
    return means.select(at(0.025).alias("lo"), at(0.975).alias("hi")).crossJoin(d.agg(F.avg("d").alias("observed")))


def bootstrap_sql(pairs: str, reps: int, seed: int = 42) -> str:
    """SQL of bootstrap_ci() over a relation of (id, d)."""
    times = " + ".join(f"CAST(x >= '{v}' AS INT)" for v in poisson_limits())
    return f"""(WITH h AS (SELECT d, block, unnest(range(4)) AS j, md5('{seed}:' || block || ':' || id) AS h FROM {pairs}, (SELECT unnest(range({(reps + 3) // 4})) AS block) WHERE d IS NOT NULL),
      w AS (SELECT block * 4 + j AS rep, d, {times} AS w FROM (SELECT block, j, d, substr(h, 8 * j + 1, 8) AS x FROM h) WHERE block * 4 + j < {reps}),
      m AS (SELECT list_sort(list(m)) AS m FROM (SELECT CAST(sum(w * d) AS DOUBLE) / sum(w) AS m FROM w GROUP BY rep HAVING sum(w) > 0))
      SELECT m[least(len(m), CAST(floor(len(m) * CAST(0.025 AS DOUBLE)) AS BIGINT) + 1)] AS lo, m[least(len(m), CAST(floor(len(m) * CAST(0.975 AS DOUBLE)) AS BIGINT) + 1)] AS hi, (SELECT avg(d) FROM {pairs}) AS observed FROM m)"""
