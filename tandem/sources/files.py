"""File scans and sinks."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads it from."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def require(spark: SparkSession, paths: Iterable[str]) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


@dataclass(frozen=True)
class YearScan:
    frame: DataFrame
    missing: list[int]


def scan_years(spark: SparkSession, pattern: str, years: Iterable[int], columns: list[str] | None = None) -> YearScan:
    """Yearly Parquet files ("…{year}….parquet") as one frame with a year column; years without a file are reported."""
    found, missing = {}, []
    for y in years:
        path = pattern.format(year=y)
        if exists(spark, path):
            found[y] = path
        else:
            missing.append(y)
    if not found:
        raise FileNotFoundError(f"no file for any year: {pattern}")
    before, _, after = os.path.basename(pattern).partition("{year}")
    year = F.regexp_extract(F.input_file_name(), rf"{_quoted(before)}(\d+){_quoted(after)}(?:/[^/]*)?$", 1).cast("int")
    frame = spark.read.parquet(*found.values())
    return YearScan(frame.select(*(columns or frame.columns), year.alias("year")), missing)


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def time_column(df: DataFrame) -> DataFrame:
    """df with time_utc as a timestamp: from time_utc, else from time_iso, else an error when the plan is built."""
    if "time_utc" in df.columns:
        return df.withColumn("time_utc", F.col("time_utc").cast("timestamp"))
    if "time_iso" in df.columns:
        return df.withColumn("time_utc", F.try_to_timestamp("time_iso"))
    raise ValueError("neither time_utc nor time_iso")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_single_file(df: DataFrame, path: str) -> str:
    """df as one Parquet file at path, in place of what was there. One task writes it, so it is for summaries, not for data.

    The file is written beside path and renamed when it is whole: a lost executor leaves the former file as it was.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    beside = f"{path}.part-{uuid.uuid4().hex}"
    at, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.coalesce(1).write.parquet(beside)
        part = next(f.getPath() for f in store.listStatus(folder) if f.getPath().getName().endswith(".parquet"))
        store.delete(at, True)
        if not store.rename(part, at):
            raise OSError(f"cannot move {part} to {path}")
    finally:
        store.delete(folder, True)
    return path


def count_files(spark: SparkSession, path: str) -> int:
    """Data files at path or directly below it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sum(1 for f in found if f.isFile() and not f.getPath().getName().startswith(("_", ".")))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Comma-separated text with a header; types are inferred only if no schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; built and written there first if it doesn't exist."""
    if not exists(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path)


def _write_text(spark: SparkSession, text: str, path: str) -> str:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def write_json(spark: SparkSession, metadata: object, path: str) -> str:
    """Run metadata (a dictionary or a parameter dataclass) as one JSON file."""
    return _write_text(spark, json.dumps(asdict(metadata) if is_dataclass(metadata) else metadata, indent=2, sort_keys=True, default=str), path)


def markdown_table(df: DataFrame, rows: int = 1000) -> str:
    """A summary table as Markdown; an error if it has more rows, as reports are for small tables."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows are no report")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(map(cell, r)) for r in got)])


def write_markdown(spark: SparkSession, title: str, tables: dict[str, DataFrame], path: str) -> str:
    parts = [f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in tables.items())]
    return _write_text(spark, "\n\n".join(parts) + "\n", path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of a manifest, without comments: name."""
    lines = spark.read.text(path).select(F.trim("value").alias("name"))
    return lines.where((F.col("name") != "") & ~F.col("name").startswith("#"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below root, by the binary source's metadata alone: name (relative), bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = root.rstrip("/").removeprefix("file://")
    return files.select(F.regexp_replace("path", f"^(file:)?/*{_quoted(plain.lstrip('/'))}/", "").alias("name"), F.col("length").alias("bytes"))


def with_retries(call: Callable[[], object], attempts: int = 5, wait: float = 1.5):
    """call(), tried again after wait, 2 * wait, … seconds; the last error is raised."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(wait * attempt)


@dataclass(frozen=True)
class Catalog:
    """Named roots, each from an environment variable, else a default, else a folder beside the first."""

    root: str

    def path(self, name: str, variable: str | None = None) -> str:
        return (variable and os.environ.get(variable)) or f"{self.root.rstrip('/')}/{name}"

    def first(self, spark: SparkSession, *names: str) -> str:
        """The first of these names that exists below the root."""
        for n in names:
            if exists(spark, self.path(n)):
                return self.path(n)
        raise FileNotFoundError(f"none of {names} in {self.root}")


#: Height fields as rows: netCDF files are converted to this once, outside Spark.
HEIGHT_ROWS = "date date, level int, lat double, z array<float>"


def read_heights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEIGHT_ROWS).parquet(path)
