"""Nightly minima over an unbounded stream: windows of a day with a watermark; late rows within it still count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S


def streaming_minima(rows: DataFrame, time: str = "ts", key: str = "node", value: str = "value", lateness: str = "2 days", hours: tuple[int, int] = (0, 6)) -> DataFrame:
    """(key, day, min_value, n): minima over hours of a day. A timestamp without zone is read as UTC, as watermarks need one."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    night = timed.where(F.hour(time).between(*hours))
    got = night.groupBy(F.window(time, "1 day").alias("w"), key).agg(F.min(S.as_null(F.col(value))).alias("min_value"), F.count(F.lit(1)).alias("n"))
    return got.select(key, F.to_date("w.start").alias("day"), "min_value", "n")


def start_minima(rows: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Starts streaming_minima(rows) into Parquet below path: the windows that a batch changed, one folder a batch.

    Windows beyond the watermark leave the state. A batch that is run again overwrites its own folder, so a restart from
    the checkpoint beside it counts nothing twice. The trigger is to run to the end of what is there, unless given.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/tables/batch={batch}")

    stream = streaming_minima(rows).writeStream.outputMode("update").foreachBatch(write)
    return stream.option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def latest_minima(spark: SparkSession, path: str, key: str = "node") -> DataFrame:
    """(key, day, min_value, n) as the last batch that changed each window left them."""
    written = spark.read.parquet(f"{path}/tables")
    last = written.groupBy(key, "day").agg(F.max_by(F.struct("min_value", "n"), "batch").alias("r"))
    return last.select(key, "day", "r.min_value", "r.n")
