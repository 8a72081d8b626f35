"""Checks as DataFrames of (check, ok, detail), and guards that raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal within an absolute tolerance; two missing values are equal."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def require_rows(df: DataFrame, what: str, least: int = 1) -> DataFrame:
    """df, or an error if it has fewer rows than it takes."""
    if len(df.limit(least).collect()) < least:
        raise ValueError(f"{what} has fewer than {least} rows")
    return df


def require_columns(df: DataFrame, present: list[str], absent: list[str] = ()) -> DataFrame:
    missing, extra = [c for c in present if c not in df.columns], [c for c in absent if c in df.columns]
    if missing or extra:
        raise ValueError(f"missing columns: {missing}; unexpected columns: {extra}")
    return df


def check_all(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, ok, failures): whether a condition holds on all rows, and on how many it doesn't. One pass for all checks."""
    counted = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("failures")) for name in checks])).alias("r")
    return counted.select(rows).select("r.check", (F.col("r.failures") == 0).alias("ok"), "r.failures")


def row_count(df: DataFrame, expected: int, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), (F.col("n") == expected).alias("ok"), F.abs(F.col("n") - expected).alias("failures"))


def difference(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(column, rows, mismatches, max_abs_diff) of two tables by key, over all keys of either."""
    both = left.select(*keys, *[F.col(v).alias(f"l_{v}") for v in values]).join(right.select(*keys, *[F.col(v).alias(f"r_{v}") for v in values]), keys, "full")
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for v in values:
        a, b = F.col(f"l_{v}"), F.col(f"r_{v}")
        aggregates += [F.count_if(~close(a, b, tolerance)).alias(f"m_{v}"), F.max(F.abs(a - b)).alias(f"d_{v}")]
    got = both.agg(*aggregates)
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col("rows"), F.col(f"m_{v}").alias("mismatches"), F.col(f"d_{v}").cast("double").alias("max_abs_diff")) for v in values])).alias("r")
    return got.select(rows).select("r.*")


def ordered(columns: list[Column]) -> Column:
    """Whether values don't fall from left to right, such as mean, p95, p99."""
    ok = F.lit(True)
    for a, b in zip(columns, columns[1:]):
        ok = ok & (a <= b)
    return ok


def manifest_difference(listed: DataFrame, found: DataFrame, name: str = "name") -> DataFrame:
    """(name, status): listed but missing, or found but not listed."""
    missing = listed.select(name).distinct().join(found, name, "left_anti").select(name, F.lit("missing").alias("status"))
    extra = found.select(name).distinct().join(listed, name, "left_anti").select(name, F.lit("unlisted").alias("status"))
    return missing.unionByName(extra)


def hygiene(files: DataFrame, forbidden: list[str], most_bytes: int) -> DataFrame:
    """(name, problem) of files (name, bytes) that are too large or whose names hold a forbidden token."""
    token = F.lit(False)
    for t in forbidden:
        token = token | F.contains(F.lower("name"), F.lit(t.lower()))
    problem = F.when(F.col("bytes") > most_bytes, "too large").when(token, "forbidden name")
    return files.select("name", problem.alias("problem")).where("problem is not null")


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """(same): whether two tables hold the same distinct rows."""
    only = left.distinct().exceptAll(right.distinct()).unionByName(right.distinct().exceptAll(left.distinct()))
    return only.agg((F.count(F.lit(1)) == 0).alias("same"))


def enforce(checks: DataFrame) -> DataFrame:
    """checks, or an error that names those that failed."""
    failed = [r["check"] for r in checks.where(~F.col("ok")).collect()]  # a row per check
    if failed:
        raise AssertionError("failed checks: " + ", ".join(failed))
    return checks
