"""Paired comparison of two runs over the same items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bootstrap_ci, mcnemar, wilson

METRICS = ("l1_parse", "l2_valid", "l5", "l5_materialize")


def paired(a: DataFrame, b: DataFrame, metric: str, *, key: str = "id", pos: str = "_pos", strict: bool = True) -> DataFrame:
    """(key, a, b): outcomes by item, the last of repeats, missing ones false. strict: the runs must hold the same items."""
    side = lambda df, out: df.groupBy(key).agg(F.max_by(F.coalesce(F.col(metric), F.lit(False)), pos).alias(out))
    both = side(a, "a").join(side(b, "b"), key, "full_outer")
    if strict:
        check = F.assert_true(F.col("a").isNotNull() & F.col("b").isNotNull(), "the runs hold different items")
        both = both.where(check.isNull())
    return both.select(key, F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))


def paired_counts(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return pairs.agg(F.count_if(a & b).alias("both_pass"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("both_fail"), F.count("*").alias("n"))


def regressions(pairs: DataFrame, key: str = "id") -> DataFrame:
    return pairs.where("a AND NOT b").select(key)


def new_passes(pairs: DataFrame, key: str = "id") -> DataFrame:
    return pairs.where("NOT a AND b").select(key)


def new_failures(pairs: DataFrame, baseline_failed: DataFrame, key: str = "id") -> DataFrame:
    """Regressions that the baseline didn't already fail."""
    return regressions(pairs, key).join(baseline_failed.select(key), key, "left_anti")


def compare_runs(a: DataFrame, b: DataFrame, metric: str, *, key: str = "id", pos: str = "_pos", reps: int = 2000, seed: int = 42) -> DataFrame:
    """One row: counts, both rates with their intervals, the difference with its bootstrap interval, and the exact test; nulls for two empty runs."""
    pairs = paired(a, b, metric, key=key, pos=pos)
    c = paired_counts(pairs)
    for side in ("a", "b"):
        c = c.withColumn(f"rate_{side}", F.try_divide(F.col("both_pass") + F.col(f"only_{side}"), F.col("n")))
    for side in ("a", "b"):
        lo, hi = wilson(F.col(f"rate_{side}"), F.col("n"))
        c = c.withColumn(f"lo_{side}", lo).withColumn(f"hi_{side}", hi)
    c = c.withColumn("diff", F.col("rate_b") - F.col("rate_a")).withColumn("p_value", mcnemar(F.col("only_a"), F.col("only_b")))
    # One row each.
    return c.crossJoin(bootstrap_ci(pairs, "b", "a", reps, seed, key).select(F.col("lo").alias("diff_lo"), F.col("hi").alias("diff_hi")))


def accepted(score_new, score_now, n_regressions, gain: float = 2.0):
    """The gate: two points better at least, and no regression on the expert items."""
    return (score_new * 100 >= score_now * 100 + gain) & (n_regressions == 0)


def run_drop(a: DataFrame, b: DataFrame, *, key: str = "id", answer: str = "predicted", right: str = "correct") -> DataFrame:
    """One row for two runs over the same questions: both accuracies, the drop in points, and how many answers differ."""
    both = a.select(key, F.col(answer).alias("x"), F.col(right).alias("ra")).join(b.select(key, F.col(answer).alias("y"), F.col(right).alias("rb")), key)
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0))
    out = both.agg(F.count("*").alias("n"), rate("ra").alias("accuracy_a"), rate("rb").alias("accuracy_b"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("n_changed"))
    return out.withColumn("drop_points", (F.col("accuracy_a") - F.col("accuracy_b")) * 100)
