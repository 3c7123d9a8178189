"""Streaming forms of scoring and of the repair loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import score_items


def score_stream(predictions: DataFrame, refs: DataFrame, sink: str, checkpoint: str, **keys) -> StreamingQuery:
    """Scores predictions as they come: each micro-batch is joined to the references and appended to a Parquet table.

    A batch that is run again after a failure replaces its own folder, so results are written once.
    """

    def each(batch: DataFrame, number: int) -> None:
        score_items(batch, refs, **keys).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return predictions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_stream(attempts: DataFrame, sink: str, checkpoint: str, key: str = "request_id", most: int = 3, *, time: str | None = None, wait: str = "1 hour") -> StreamingQuery:
    """What every request has come to as its attempts arrive; statuses(sink) has the status of each.

    What a request needs of its attempts (the first valid and the first broken one, the last output) is
    state of the stream, kept by Spark's own aggregation, so no attempt is read again and none goes to
    Python. Each micro-batch writes what it changed to a folder of its own; one that runs again after a
    failure replaces its folder. Of attempts of one number the first to come counts as valid, the last as output.

    time names the attempts' event time. State is kept by request and slot, a sixtieth of `wait`, and goes once
    the watermark has passed the slot; statuses() puts the slots of a request together, so attempts may lie
    as far apart as they like. The watermark follows the time at a distance of `wait` and a slot. Attempts
    whose slot it has passed are late and don't count: none within `wait` of the latest is, and all are that
    lie two slots further back. So the state holds the requests of one wait and of the last batch, however
    long the stream runs; without a time it holds all that ever were. Attempts whose time is null are never late and stay.
    """
    import pandas as pd

    # Within a micro-batch current_timestamp() is one fixed value, that of its log, in a run after a failure too.
    tried = F.struct(F.col("attempt").cast("bigint").alias("attempt"), F.current_timestamp().alias("came"), F.col("output").alias("output"))
    a = attempts.where(F.col("attempt") <= most).withColumn("_tried", tried)
    if time is not None:
        slot = max(1, int(pd.Timedelta(wait).total_seconds() * 1e6) // 60)
        start = F.timestamp_micros(F.floor(F.unix_micros(F.col(time)) / slot).cast("bigint") * slot)
        a = a.withColumn("_slot", start).withWatermark("_slot", f"{int(pd.Timedelta(wait).total_seconds() * 1e6) + slot} microseconds")
    good, broken = F.min(F.when(F.col("valid"), F.col("_tried"))), F.min(F.when(F.col("failed"), F.col("_tried.attempt")))
    changed = a.groupBy(key, *(["_slot"] if time is not None else [])).agg(good.alias("good"), broken.alias("broken"), F.max("_tried").alias("last"))

    def each(batch: DataFrame, number: int) -> None:
        batch.select(key, "good", "broken", "last").write.mode("overwrite").parquet(f"{sink}/status/batch={number}")

    return changed.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(spark: SparkSession, sink: str, key: str = "request_id") -> DataFrame:
    """(key, status, n_attempts, output) of every request that status_stream() has written, as attempt_status() tells them."""
    g = spark.read.parquet(f"{sink}/status").groupBy(key).agg(F.min("good").alias("g"), F.min("broken").alias("b"), F.max("last").alias("l"))
    ok, bad = F.col("g").isNotNull() & (F.col("b").isNull() | (F.col("g.attempt") < F.col("b"))), F.col("b").isNotNull()
    status, n = F.when(ok, 200).when(bad, 502).otherwise(422), F.when(ok, F.col("g.attempt")).when(bad, F.col("b")).otherwise(F.col("l.attempt"))
    return g.select(key, status.alias("status"), n.alias("n_attempts"), F.when(ok, F.col("g.output")).when(~bad, F.substring("l.output", 1, 2000)).alias("output"))
