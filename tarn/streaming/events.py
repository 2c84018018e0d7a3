"""Streams of requests: event-time windows, a writer of micro-batches, and a live rate limit.

The windows and watermarks are an extension; the batch operators do not need them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.session import exists


#: What a counted writer says about a batch.
COUNTS = "came long, written long, late long, refused long, newest timestamp, batch int"


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Requests and errors per window and kind; what comes later than ``late`` is dropped, and state with it."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = stream.withWatermark("ts", late).groupBy(at.alias("w"), "event_type")
    return counted.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's runs of events without a longer gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append micro-batches to a Parquet table. A batch that is run again replaces its own folder, so rows are never doubled."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def limited(stream: DataFrame, limit: int, window_seconds: float = 60.0) -> DataFrame:
    """(identity, id, seconds, passed): a sliding-window limit per identity over a stream (identity, id, seconds).

    State holds the times of at most ``limit`` accepted requests, and goes when
    an identity has been silent for two windows.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["seconds", "id"])
        passed = []
        for now in rows["seconds"]:
            recent = [t for t in recent if t >= now - window_seconds]
            ok = limit <= 0 or len(recent) < limit
            if ok and limit > 0:
                recent.append(now)
            passed.append(ok)
        state.update((recent,))
        state.setTimeoutDuration(int(2000 * window_seconds))
        yield pd.DataFrame({"identity": key[0], "id": rows["id"], "seconds": rows["seconds"], "passed": passed})

    return stream.groupBy("identity").applyInPandasWithState(
        decide, "identity string, id long, seconds double, passed boolean", "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def write_counted(stream: DataFrame, path: str, checkpoint: str, valid: Column, late: str = "10 minutes", ts: str = "ts", **trigger):
    """Append the valid rows of micro-batches that are not late, and beside them, under ``<path>-counts``, how many rows came, were written, late or refused.

    A row is late if it is older than the newest row of all batches before its
    own, less ``late``; a row without time is refused.  Counts are observed
    while the batch is written, so it is read once.  A batch that is run again
    replaces its own rows and counts.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark, counts = batch.sparkSession, f"{path}-counts"
        newest = None
        if number and exists(spark, counts):
            newest = spark.read.schema(COUNTS).parquet(counts).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        too_late = F.lit(False) if newest is None else F.col(ts) < F.lit(newest) - F.expr(f"INTERVAL {late}")
        good = F.coalesce(valid, F.lit(False)) & F.col(ts).isNotNull()
        told, number_of = Observation(), lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        rows = batch.withColumns({"__good": good, "__late": good & F.coalesce(too_late, F.lit(False))})
        rows = rows.observe(told, F.count("*").alias("came"), number_of(F.col("__good") & ~F.col("__late")).alias("written"), number_of(F.col("__late")).alias("late"), number_of(~F.col("__good")).alias("refused"), F.max(ts).alias("newest"))
        rows.where("__good AND NOT __late").drop("__good", "__late").write.mode("overwrite").parquet(f"{path}/batch={number}")
        said = told.get
        row = [(said["came"], said["written"], said["late"], said["refused"], said["newest"])]
        spark.createDataFrame(row, COUNTS.replace(", batch int", "")).coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
