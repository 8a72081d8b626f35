"""Queries on scans, sinks, guards and parameters: tables are written by the sinks and come back through the scans."""

from __future__ import annotations

from dataclasses import asdict
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PairConfig, from_args
from ..functions import scalars as S
from ..operators import quality as D
from ..sources import files
from ..sources.scratch import scratch_path
from ..sources.tables import nodes, orders_by_year, table
from ..streaming.minima import latest_minima, start_minima
from . import sql as Q
from .network_queries import coherent_edges
from .network_queries import oracles as network_sql

YEARS = (1990, 2005)
TOKENS = ["red", "bolt"]


def yearly_scan(spark, sf_dir):
    """Orders written by year and scanned year by year; years without a file count as 0."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("yr"))
    path = files.write_table(orders.repartition("yr"), scratch_path(spark, "orders"), ("yr",))
    scan = files.scan_years(spark, path + "/yr={year}", range(YEARS[0], YEARS[1] + 1), ["o_totalprice"])
    found = scan.frame.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    absent = spark.createDataFrame([(y, 0, 0.0) for y in scan.missing], "year int, n long, total double")
    return found.unionByName(absent)


def time_fallback(spark, sf_dir):
    """Events with a timestamp column, and with text of which every fifth can't be read: n, read, first and last day."""
    events = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    forms = {"time_utc": events.select(F.col("ts").alias("time_utc")), "time_iso": events.select(text.alias("time_iso"))}
    out = None
    for name, df in forms.items():
        t = files.time_column(df)
        row = t.agg(F.count(F.lit(1)).alias("n"), F.count("time_utc").alias("n_read"), S.day_text(F.to_date(F.min("time_utc"))).alias("first_day"), S.day_text(F.to_date(F.max("time_utc"))).alias("last_day"))
        row = row.select(F.lit(name).alias("source"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def single_file_sink(spark, sf_dir):
    """The node table written twice to one file: its rows, and the number of files at its place."""
    path = scratch_path(spark, "nodes") + ".parquet"
    for _ in range(2):
        files.write_single_file(nodes(spark, sf_dir), path)
    return spark.read.parquet(path).withColumn("files", F.lit(files.count_files(spark, path)))


def edge_table(spark, sf_dir):
    """The edge table through its Parquet sink and scan."""
    return spark.read.parquet(files.write_table(coherent_edges(spark, sf_dir), scratch_path(spark, "edges")))


def csv_summary(spark, sf_dir):
    """Orders by status and year through the CSV sink and a scan that infers its types."""
    got = files.read_csv(spark, files.write_csv(orders_by_year(spark, sf_dir), scratch_path(spark, "summary")))
    return got.select("status", "year", F.col("n").cast("bigint").alias("n"))


def json_metadata(spark, sf_dir):
    """A run's parameters through the JSON sink."""
    path = files.write_json(spark, PairConfig(alpha=0.01), scratch_path(spark, "run") + ".json")
    return spark.read.option("multiLine", True).json(path).select(*sorted(asdict(PairConfig())))


def markdown_report(spark, sf_dir):
    """Lines of a Markdown report of orders by status, with how often each occurs."""
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy("status")
    path = files.write_markdown(spark, "Orders", {"By status": by}, scratch_path(spark, "report") + ".md")
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def cached_counts(spark, sf_dir):
    """Orders by status through a table that is built once and read twice."""
    path, built = scratch_path(spark, "counts"), []

    def build() -> DataFrame:
        built.append(1)
        return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))

    first, second = (files.cached_table(spark, path, build) for _ in range(2))
    return first.join(second.withColumnRenamed("n", "again"), "status").withColumn("builds", F.lit(len(built)))


def resolved_paths(spark, sf_dir):
    """Which of several names a root holds, and which tables a folder lacks."""
    catalog = files.Catalog(sf_dir)
    found = catalog.first(spark, "no_such_table.parquet", "nation.parquet", "region.parquet").rsplit("/", 1)[1]
    rows = [("first", found), ("plain", catalog.path("orders.parquet").rsplit("/", 1)[1])]
    return spark.createDataFrame(rows, "kind string, name string")


def parameters(spark, sf_dir):
    """A command line read into parameters, defaults included."""
    config = from_args(PairConfig, ["--alpha", "0.01", "--k-days", "2"])
    return spark.createDataFrame([(k, float(v)) for k, v in asdict(config).items()], "name string, value double")


def guards(spark, sf_dir):
    """Which guards raise: on a missing input, an empty frame, too few rows, missing columns and a failed check."""
    n = nodes(spark, sf_dir)
    attempts = {
        "missing input": lambda: files.require(spark, [f"{sf_dir}/nation.parquet", f"{sf_dir}/no_such_table.parquet"]),
        "present input": lambda: files.require(spark, [f"{sf_dir}/nation.parquet"]),
        "no year found": lambda: files.scan_years(spark, sf_dir + "/none_{year}.parquet", [2000]),
        "empty frame": lambda: D.require_rows(n.where("node < 0"), "nodes"),
        "too few rows": lambda: D.require_rows(n, "nodes", 26),
        "enough rows": lambda: D.require_rows(n, "nodes", 25),
        "missing column": lambda: D.require_columns(n, ["node", "height"]),
        "failed check": lambda: D.enforce(D.row_count(n, 24)),
        "no time column": lambda: files.time_column(n),
    }
    rows = []
    for name, attempt in attempts.items():
        try:
            attempt()
            rows.append((name, False))
        except (FileNotFoundError, ValueError, AssertionError):
            rows.append((name, True))
    return spark.createDataFrame(rows, "guard string, raised boolean")


def file_hygiene(spark, sf_dir):
    """Parts read as files, their size in whole units: names with forbidden tokens, and sizes beyond the cap."""
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("bytes"))
    return D.hygiene(parts, TOKENS, 45).groupBy("name", "problem").agg(F.count(F.lit(1)).alias("n"))


def missing_dropped(spark, sf_dir):
    """Event values, of which some are made NaN or null, by type: all rows, and those that are left once missing ones go."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 != 0, F.col("value"))
    rows = table(spark, sf_dir, "events").select("event_type", value.alias("value"))
    left = rows.withColumn("value", S.as_null(F.col("value"))).dropna(subset=["value"])
    sums = left.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_left"), F.round(F.avg("value"), 6).alias("mean_value"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows")).join(sums, "event_type", "left")


def annual_means(spark, sf_dir):
    """Total and mean annual orders of each status, in falling order of the total, then by status."""
    got = orders_by_year(spark, sf_dir).groupBy("status").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean_annual"))
    return got.orderBy(F.desc("total"), "status")


def streaming_daily_minima(spark, sf_dir):
    """The stream form over the event table's files, run once to the end of what is there."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(sf_dir)
    path = scratch_path(spark, "minima")
    start_minima(source.select("ts", F.col("user_id").alias("node"), "value"), path).awaitTermination()
    return latest_minima(spark, path).select("node", S.day_text(F.col("day")).alias("day"), "min_value", "n")


@cache
def oracles() -> dict[str, str]:
    defaults = asdict(PairConfig(alpha=0.01))
    status = "(select o_orderstatus as status, count(*) as n from orders group by 1)"
    raised = {"missing input": True, "present input": False, "no year found": True, "empty frame": True, "too few rows": True, "enough rows": False, "missing column": True, "failed check": True, "no time column": True}
    values = lambda rows: ", ".join(f"({', '.join(r)})" for r in rows)
    tokens = " or ".join(f"contains(lower(p_name), '{t}')" for t in TOKENS)
    return {
        "yearly_scan": f"select y::int as year, count(o_orderkey) as n, round(coalesce(sum(o_totalprice), 0), 2) as total from range({YEARS[0]}, {YEARS[1] + 1}) t(y) left join orders on year(o_orderdate) = y group by y",
        "time_fallback": "select 'time_utc' as source, count(*) as n, count(ts) as n_read, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day from events union all select 'time_iso', count(*), count(t), strftime(min(t), '%Y-%m-%d'), strftime(max(t), '%Y-%m-%d') from (select case when event_id % 5 <> 0 then ts end as t from events)",
        "single_file_sink": Q.query(Q.NODES, select="select *, 1 as files from nodes"),
        "edge_table": network_sql()["coherent_edges"],
        "csv_summary": "select o_orderstatus as status, year(o_orderdate)::int as year, count(*) as n from orders group by 1, 2",
        "json_metadata": "select " + ", ".join(f"{v}::{'double' if isinstance(v, float) else 'bigint'} as {k}" for k, v in defaults.items()),
        "markdown_report": f"select line, count(*) as n from (select unnest(['# Orders', '', '## By status', '', '| status | n |', '| --- | --- |']) as line union all select '| ' || status || ' | ' || n || ' |' from {status}) group by line",
        "cached_counts": f"select status, n, n as again, 1 as builds from {status}",
        "resolved_paths": "select * from (values ('first', 'nation.parquet'), ('plain', 'orders.parquet')) t(kind, name)",
        "parameters": f"select name, value::double as value from (values {values((f"'{k}'", str(v)) for k, v in (defaults | {'k_days': 2}).items())}) t(name, value)",
        "guards": f"select * from (values {values((f"'{k}'", str(v).lower()) for k, v in raised.items())}) t(guard, raised)",
        "file_hygiene": f"select p_name as name, case when p_size > 45 then 'too large' else 'forbidden name' end as problem, count(*) as n from part where p_size > 45 or {tokens} group by 1, 2",
        "missing_dropped": "select event_type, count(*) as n_rows, count(v) as n_left, round(avg(v), 6) as mean_value from (select event_type, case when event_id % 7 <> 0 and event_id % 11 <> 0 then value end as v from events) group by 1",
        "annual_means": "select status, sum(n)::bigint as total, round(avg(n), 6) as mean_annual from (select o_orderstatus as status, year(o_orderdate) as y, count(*) as n from orders group by 1, 2) group by 1",
        "streaming_daily_minima": "select user_id as node, strftime(ts, '%Y-%m-%d') as day, min(value) as min_value, count(*) as n from events where hour(ts) between 0 and 6 group by 1, 2",
    }


QUERIES = {f.__name__: f for f in (
    yearly_scan, time_fallback, single_file_sink, edge_table, csv_summary, json_metadata, markdown_report, cached_counts, resolved_paths, parameters,
    guards, file_hygiene, missing_dropped, annual_means, streaming_daily_minima,
)}
