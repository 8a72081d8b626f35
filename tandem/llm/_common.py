"""What the operators of this subpackage share: tables, scratch tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows above which a lookup table is no longer broadcast (about 16 to 64 bytes a row).
BROADCAST_ROWS = 200_000

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tandem-scratch-")
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; a cluster's own clean-up takes the folder
        pass


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed at exit."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as it takes to clash with none of columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def lookup(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if its counted rows are within limit; a shuffled hash join otherwise."""
    return F.broadcast(df) if rows <= limit else df.hint("shuffle_hash")


def join_lookup(left: DataFrame, right: DataFrame, keys: list[str], rows: int, spread: str, how: str = "inner", limit: int | None = None) -> DataFrame:
    """left joined with a lookup table on keys (nulls match): broadcast if its counted rows are within limit.

    Beyond, both sides are dealt out by keys and a salt from the column `spread`, so a key that holds a third of left
    meets 64 copies of its one lookup row in as many tasks, whatever is done by key afterwards.
    """
    named = right.withColumnsRenamed({k: f"_jl_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_jl_{k}")) for k in keys]
    if rows <= (BROADCAST_ROWS if limit is None else limit):
        out = left.join(F.broadcast(named), on, how)
    else:
        salted = named.withColumn("_jl_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        out = left.withColumn("_jl_own", F.pmod(F.xxhash64(spread), F.lit(64)).cast("int")).join(salted, [*on, F.col("_jl_own") == F.col("_jl_salt")], how)
    return out.drop(*[f"_jl_{k}" for k in keys], "_jl_own", "_jl_salt")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that on pure ASCII, and is faster than translate()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def text_of(name: str = "text") -> Column:
    """A document's whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))
