"""Bundles of long-range links: clusters of edges, the nodes of their sides, daily signals and synchronised dates."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BundleConfig
from ..functions import scalars as S

ENDPOINTS = ["lon1", "lat1", "lon2", "lat2"]


def cluster_edges(edges: DataFrame, k: int, features: list[str] = ENDPOINTS, seeds: int = 10, min_km: float | None = None) -> DataFrame:
    """edges (longer than min_km) with cluster: k-means on raw coordinates, the best of several seeds."""
    far = edges if min_km is None else edges.where(F.col("dist_km") > min_km)
    points = VectorAssembler(inputCols=features, outputCol="_f").transform(far).persist()
    try:
        n = points.count()
        if n < k:
            raise ValueError(f"{n} edges cannot make {k} clusters")
        best = min((KMeans(k=k, seed=42 + s, featuresCol="_f", predictionCol="cluster", initMode="k-means||").fit(points) for s in range(seeds)), key=lambda m: m.summary.trainingCost)
    finally:
        points.unpersist()
    return best.transform(points).drop("_f")


def ranked_clusters(edges: DataFrame, top_n: int) -> DataFrame:
    """(cluster, edge_count, edge_share, rank) of the largest clusters; ties go to the lower cluster id."""
    counts = edges.groupBy("cluster").agg(F.count(F.lit(1)).alias("edge_count"))
    total = F.sum("edge_count").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("edge_count"), "cluster"))
    return counts.withColumn("edge_share", F.col("edge_count") / total).withColumn("rank", rank).where(F.col("rank") <= top_n)


def side_nodes(edges: DataFrame, sides: tuple[str, str] = ("side_a", "side_b")) -> DataFrame:
    """(cluster, side, node): distinct nodes of both sides of each cluster."""
    one = lambda c, s: edges.select("cluster", F.lit(s).alias("side"), F.col(c).alias("node"))
    return one("a", sides[0]).unionByName(one("b", sides[1])).distinct()


def daily_signal(event_days: DataFrame, sides: DataFrame, by: list[str] = ["cluster", "side"]) -> DataFrame:  # noqa: B006
    """(by, day, n, size, signal): flagged nodes of a side on a day over its fixed number of nodes. event_days: node, day."""
    size = sides.groupBy(*by).agg(F.count_distinct("node").alias("size"))
    daily = event_days.join(sides.select(*by, "node"), "node").groupBy(*by, "day").agg(F.count(F.lit(1)).alias("n"))
    return daily.join(size, by).withColumn("signal", F.col("n") / F.col("size"))


def synchronized_dates(signal: DataFrame, threshold: float, by: list[str] = ["cluster"], sides: tuple[str, str] = ("side_a", "side_b")) -> DataFrame:  # noqa: B006
    """(by, day) on which both sides' signals are above the threshold."""
    above = signal.where(F.col("signal") > threshold)
    return above.where(F.col("side") == sides[0]).select(*by, "day").join(above.where(F.col("side") == sides[1]).select(*by, "day"), [*by, "day"])


def bundle_summary(edges: DataFrame, dates: DataFrame, config: BundleConfig = BundleConfig(), mechanism: str = "Coherent") -> DataFrame:
    """A row per bundle: rank, edges, share, centroids (means over edges), node counts, dates and a file name by both regions."""
    ranks = ranked_clusters(edges, config.top_n)
    centres = edges.groupBy("cluster").agg(*[F.avg(c).alias(f"centroid_{c}") for c in ENDPOINTS], F.count_distinct("a").alias("node_count_a"), F.count_distinct("b").alias("node_count_b"))
    spans = dates.groupBy("cluster").agg(F.count(F.lit(1)).alias("date_count"), S.day_text(F.min("day")).alias("first_date"), S.day_text(F.max("day")).alias("last_date"))
    compact = mechanism == "Coherent"
    name = F.concat(S.region_name(F.col("centroid_lon1"), F.col("centroid_lat1"), compact), F.lit("_and_" if compact else "_to_"), S.region_name(F.col("centroid_lon2"), F.col("centroid_lat2"), compact))
    out = ranks.join(centres, "cluster").join(spans, "cluster", "left")
    return out.select(F.lit(mechanism).alias("mechanism"), "rank", F.col("cluster").alias("cluster_id"), "edge_count", "edge_share", *[f"centroid_{c}" for c in ENDPOINTS], "node_count_a", "node_count_b", F.coalesce("date_count", F.lit(0)).alias("date_count"), F.coalesce("first_date", F.lit("")).alias("first_date"), F.coalesce("last_date", F.lit("")).alias("last_date"), F.concat(F.lit(f"dates_{mechanism.lower()}_bundle_"), "rank", F.lit("_"), S.safe_name(name), F.lit(".csv")).alias("date_file"))


def extract_bundles(edges: DataFrame, events: DataFrame, config: BundleConfig = BundleConfig(), min_km: float = 2500.0, cold: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, dates) of the top bundles. events, cold: (node, day) of flagged days; with cold, b is the cold side."""
    clustered = cluster_edges(edges, config.clusters, min_km=min_km)
    top = ranked_clusters(clustered, config.top_n).select("cluster")
    sides = side_nodes(clustered.join(top, "cluster", "left_semi"))
    if cold is None:
        signal = daily_signal(events, sides)
    else:
        signal = daily_signal(events, sides.where("side = 'side_a'")).unionByName(daily_signal(cold, sides.where("side = 'side_b'")))
    dates = synchronized_dates(signal, config.threshold)
    return bundle_summary(clustered, dates, config, "Coherent" if cold is None else "Dipole"), dates


def reconstruction(edges: DataFrame, summary: DataFrame) -> DataFrame:
    """(cluster_id, check, ok, failures): edge and node counts recomputed from clustered edges against a summary's."""
    again = edges.groupBy(F.col("cluster").alias("cluster_id")).agg(F.count(F.lit(1)).alias("_edges"), F.count_distinct("a").alias("_a"), F.count_distinct("b").alias("_b"))
    both = summary.join(again, "cluster_id", "left")
    pairs = {"edge_count": "_edges", "node_count_a": "_a", "node_count_b": "_b"}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(F.col(k) == F.col(v), F.lit(False)).alias("ok"), F.abs(F.col(k) - F.coalesce(F.col(v), F.lit(0))).cast("bigint").alias("failures")) for k, v in pairs.items()])).alias("r")
    return both.select("cluster_id", rows).select("cluster_id", "r.*")


def fixed_groups(node: Column, k: int) -> Column:
    """A clustering that needs no model, for comparisons: the node's id modulo k."""
    return F.pmod(node, F.lit(k))
