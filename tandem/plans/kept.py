"""Tables that several queries start from: kept between queries of one folder, released when another folder is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_held: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, df: DataFrame) -> DataFrame:
    """df, persisted (memory, then disk). At most one folder's tables of a session are held at a time."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _held if k[0] != app]:  # a session that has ended took its blocks with it
        del _held[key]
    for key in [k for k in _held if k[1] != sf_dir]:
        _held.pop(key).unpersist()
    return _held.setdefault((app, sf_dir, name), df.persist())


def release() -> None:
    """Unpersists all of them, for timings that start cold or at the end of a batch of queries."""
    for df in _held.values():
        df.unpersist()
    _held.clear()
