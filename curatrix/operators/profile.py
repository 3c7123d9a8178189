"""Profiles of record sets: lengths, domains, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx

#: The limits of the truncation report and of the length report.
THRESHOLDS = (1024, 2048, 4096, 8192, 16384)
REPORT_LIMITS = (2048, 4096, 6144, 8192)


def known_domain(col: Column) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit("unknown"))


def domain_counts(df: DataFrame, domain: str = "domain") -> DataFrame:
    return df.groupBy(known_domain(F.col(domain)).alias("domain")).agg(F.count("*").alias("n"))


def domain_by_split(df: DataFrame, domain: str, split: str, splits: list[str]) -> DataFrame:
    """A column for each split, zero where a domain is absent."""
    wide = df.groupBy(known_domain(F.col(domain)).alias("domain"))
    return wide.agg(*(F.count_if(F.col(split) == s).alias(s) for s in splits))


def longest(df: DataFrame, length: str, pos: str, k: int = 10) -> DataFrame:
    """The k longest, the first of equals first."""
    return df.orderBy(F.desc(length), F.asc(pos)).limit(k)


def nearest_index(df: DataFrame, length: str, q: float, by: list[str] | None = None) -> DataFrame:
    """sorted[int(n * q)]: an order statistic without interpolation, from the counts of distinct lengths."""
    by = by or []
    counts = df.groupBy(*by, length).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by).orderBy(length))
    n = F.sum("_k").over(Window.partitionBy(*by))
    return counts.withColumn("_upto", upto).withColumn("_n", n).where(F.col("_upto") > F.floor(F.col("_n") * F.lit(float(q)))).groupBy(*by).agg(F.min(length).alias("value"))


def length_report(df: DataFrame, length: str, limits: tuple[int, ...] = REPORT_LIMITS) -> DataFrame:
    """How many records fit each limit."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col(length) <= x).alias(f"fit_{x}") for x in limits))


def filter_lengths(df: DataFrame, length: str, most: int) -> DataFrame:
    """df with `kept`; records that are too long are dropped, never cut."""
    return df.withColumn("kept", F.col(length) <= most)


def kept_report(df: DataFrame) -> DataFrame:
    """total, kept and dropped; the dropped keys, of which there may be any number, are dropped_keys()."""
    return df.agg(F.count("*").alias("total"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def dropped_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where("NOT kept").select(key)


def prepare_stats(df: DataFrame, split: str, limit: int | None = None) -> DataFrame:
    """(split, total, excluded, kept) of filtered records; kept is counted after a limit on the records of a split."""
    kept = F.count_if("kept") if limit is None else F.least(F.count_if("kept"), F.lit(limit))
    return df.groupBy(split).agg(F.count("*").alias("total"), F.count_if(~F.col("kept")).alias("excluded"), kept.cast("bigint").alias("kept"))


def blueprint_stats(df: DataFrame, blueprint: str) -> tuple[DataFrame, DataFrame]:
    """(total, parse_failures, missing_skill_md), and the histogram of files by blueprint."""
    v = jsonx.with_exactly(df.select(F.col(blueprint).alias("_text")), F.col("_text"), "v")
    v = v.select(F.when(jsonx.is_object(F.col("v")), F.col("v")).alias("v"))
    paths = F.transform(jsonx.elements(F.col("v"), "$.files"), lambda f: F.try_variant_get(f, "$.path", "string"))
    v = v.select(F.col("v").isNull().alias("bad"), F.size(paths).cast("bigint").alias("n_files"), F.exists(paths, lambda p: F.coalesce((p == "SKILL.md") | p.endswith("/SKILL.md"), F.lit(False))).alias("has_main"))
    stats = v.agg(F.count("*").alias("total"), F.count_if("bad").alias("parse_failures"), F.count_if(~F.col("bad") & ~F.col("has_main")).alias("missing_skill_md"))
    return stats, v.where("NOT bad").groupBy("n_files").agg(F.count("*").alias("n"))


def mode(hist: DataFrame, value: str, n: str) -> DataFrame:
    """The most frequent value, the smallest of equals."""
    return hist.agg(F.max_by(value, F.struct(n, (-F.col(value)).alias("v"))).alias("mode"))


def char_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(char, idx) of the distinct characters in order; as many rows as there are characters in use."""
    chars = df.select(F.explode(F.split(F.col(text), "")).alias("char")).where("char <> ''").distinct()
    return chars.withColumn("idx", (F.row_number().over(Window.orderBy("char")) - 1).cast("bigint"))


def context_windows(df: DataFrame, text: str, width: int = 32) -> DataFrame:
    """Every window of width characters with the character after it."""
    starts = F.when(F.length(text) > width, F.sequence(F.lit(1), F.length(text) - width)).otherwise(F.array().cast("array<int>"))
    at = df.withColumn("_i", F.explode(starts))
    return at.withColumn("window", F.substring(F.col(text), F.col("_i"), F.lit(width))).withColumn("next", F.substring(F.col(text), F.col("_i") + width, F.lit(1))).withColumnRenamed("_i", "start")


def char_codes(df: DataFrame, text: str, vocabulary: DataFrame, out: str = "codes") -> DataFrame:
    """df with the indexes of a text's characters. A vocabulary has as many rows as characters are in use, a few thousand."""
    table = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("char", "idx"))).alias("_chars"))
    codes = F.transform(F.filter(F.split(F.col(text), ""), lambda c: c != ""), lambda c: F.col("_chars")[c])
    return df.crossJoin(F.broadcast(table)).withColumn(out, codes).drop("_chars")


def char_text(df: DataFrame, codes: str, vocabulary: DataFrame, out: str = "decoded") -> DataFrame:
    """df with the text of character indexes."""
    table = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("idx", "char"))).alias("_chars"))
    return df.crossJoin(F.broadcast(table)).withColumn(out, F.array_join(F.transform(codes, lambda i: F.col("_chars")[i]), "")).drop("_chars")
