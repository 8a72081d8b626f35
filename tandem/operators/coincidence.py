"""Event coincidence between pairs of nodes: overlap, directional counts within ±K days, Poisson screens and FDR.

Two physical forms give the same counts. The blocked one, which scoring uses, packs each node's days into bit rows, deals
pairs of node blocks to tasks and counts them by matrix products; its shuffle grows with blocks times node-days, not with
pairs times days. The relational one joins node-days on the day; it suits up to some hundred nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PairConfig
from ..functions import scalars as S

PAIR = ["a", "b"]


def valid_nodes(events: DataFrame, min_events: int, flag: str = "evt_run") -> DataFrame:
    """(node, n_events) of nodes with enough events."""
    return events.groupBy("node").agg(F.sum(flag).alias("n_events")).where(F.col("n_events") >= min_events)


def activity(events: DataFrame, flag: str = "evt_run") -> DataFrame:
    """(node, day, evt): a node is active on the days it has a row."""
    return events.select("node", "day", F.col(flag).alias("evt"))


def overlap(act: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(a, b, n_eff, n_a, n_b): common active days and the events of each side on them.

    Of one table, pairs with a < b; of two, all pairs with a <> b, a from the first.
    """
    x = act.select(F.col("node").alias("a"), "day", F.col("evt").alias("ea"))
    y = (act if other is None else other).select(F.col("node").alias("b"), "day", F.col("evt").alias("eb"))
    apart = F.col("a") < F.col("b") if other is None else F.col("a") != F.col("b")
    return x.join(y, "day").where(apart).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_eff"), F.sum("ea").alias("n_a"), F.sum("eb").alias("n_b"))


def observed(act: DataFrame, k_days: int, other: DataFrame | None = None) -> DataFrame:
    """(a, b, obs): events of a with an event of b within k_days, both on common active days. Directional."""
    right = act if other is None else other
    ev_a = act.where("evt = 1").select(F.col("node").alias("a"), F.col("day").alias("day_a"))
    ev_b = right.where("evt = 1").select(F.col("node").alias("b"), F.col("day").alias("day_b"))
    near = ev_a.withColumn("day_b", F.explode(F.sequence(F.date_sub("day_a", k_days), F.date_add("day_a", k_days)))).join(ev_b, "day_b")
    near = near.where(F.col("a") < F.col("b") if other is None else F.col("a") != F.col("b"))
    near = near.join(right.select(F.col("node").alias("b"), F.col("day").alias("day_a")), ["b", "day_a"], "left_semi")
    near = near.join(act.select(F.col("node").alias("a"), F.col("day").alias("day_b")), ["a", "day_b"], "left_semi")
    return near.groupBy(*PAIR).agg(F.count_distinct("day_a").alias("obs"))


def _block_counts(k_days: int, same: bool):
    def bits(frame: pd.DataFrame, first: int, n_days: int):
        nodes, at = np.unique(frame["node"].to_numpy(), return_inverse=True)
        act = np.zeros((len(nodes), n_days), bool)
        evt = np.zeros((len(nodes), n_days), bool)
        day = frame["d"].to_numpy() - first
        act[at, day] = True
        evt[at, day] = frame["evt"].to_numpy() == 1
        return nodes, act, evt

    def count(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = {"a": "int64", "b": "int64", "n_eff": "int64", "n_a": "int64", "n_b": "int64", "obs": "int64"}
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})
        first = int(min(left["d"].min(), right["d"].min())) - k_days  # room for a window around every event
        n_days = int(max(left["d"].max(), right["d"].max())) + k_days - first + 1
        na, act_a, evt_a = bits(left, first, n_days)
        nb, act_b, evt_b = bits(right, first, n_days)
        fa, fb = act_a.astype(np.float32), act_b.astype(np.float32)
        n_eff, n_a, n_b = fa @ fb.T, evt_a.astype(np.float32) @ fb.T, fa @ evt_b.astype(np.float32).T
        obs = np.zeros((len(na), len(nb)), np.int64)
        around = np.arange(-k_days, k_days + 1)
        for i in range(len(na)):
            days = np.flatnonzero(evt_a[i])
            window = days[:, None] + around
            hit = (evt_b[:, window] & act_a[i][window]).any(2)  # b's events on days on which a is active
            obs[i] = (hit & act_b[:, days]).sum(1)
        keep = (na[:, None] < nb[None, :]) if same else (na[:, None] != nb[None, :])
        i, j = np.nonzero(keep & (n_eff > 0))
        return pd.DataFrame({"a": na[i], "b": nb[j], **{c: m[i, j].astype(np.int64) for c, m in (("n_eff", n_eff), ("n_a", n_a), ("n_b", n_b), ("obs", obs))}})

    return count


def blocked_counts(act: DataFrame, k_days: int, other: DataFrame | None = None, block: int = 256) -> DataFrame:
    """(a, b, n_eff, n_a, n_b, obs) as overlap() and observed() give them, by pairs of blocks of nodes.

    A task holds two blocks: 2 * block nodes of days, whatever the number of nodes.
    """
    right = act if other is None else other
    day = F.datediff("day", F.to_date(F.lit("1970-01-01"))).alias("d")
    place = F.floor(F.col("node") / block).alias("blk")
    left_rows = act.select("node", day, "evt", place)
    right_rows = right.select(F.col("node").alias("node"), day, F.col("evt").alias("evt"), place)  # own column ids: both sides may be one table
    upper = F.col("blk") <= F.col("bb") if other is None else F.lit(True)
    lower = F.col("ba") <= F.col("blk") if other is None else F.lit(True)
    # The lists of blocks have a row for each `block` nodes: 10,000 of them (80 kB) would stand for 50 million pairs of blocks.
    x = left_rows.join(F.broadcast(right_rows.select(F.col("blk").alias("bb")).distinct()), upper).withColumnRenamed("blk", "ba")
    y = right_rows.join(F.broadcast(left_rows.select(F.col("blk").alias("ba")).distinct()), lower).withColumnRenamed("blk", "bb")
    schema = "a long, b long, n_eff long, n_a long, n_b long, obs long"
    return x.groupBy("ba", "bb").cogroup(y.groupBy("ba", "bb")).applyInPandas(_block_counts(k_days, other is None), schema)


def scored(counts: DataFrame, config: PairConfig) -> DataFrame:
    """Counts of pairs with enough overlap, with lam and p."""
    enough = counts.where(F.col("n_eff") >= config.min_overlap)
    lam = enough.withColumn("lam", S.expected_coincidences(F.col("n_a"), F.col("n_b"), F.col("n_eff"), config.k_days))
    return lam.withColumn("p", S.poisson_upper_tail(F.col("obs"), F.col("lam")))


def pair_scores(events: DataFrame, config: PairConfig = PairConfig(), cold: DataFrame | None = None, blocked: bool = True) -> DataFrame:
    """All tested pairs with counts, lam and p: of one event table (a < b), or hot nodes against cold ones (a hot, b cold)."""
    keep = lambda e: activity(e).join(valid_nodes(e, config.min_events).select("node"), "node", "left_semi")
    act, other = keep(events), None if cold is None else keep(cold)
    if blocked:
        return scored(blocked_counts(act, config.k_days, other), config)
    counts = overlap(act, other).join(observed(act, config.k_days, other), PAIR, "left").withColumn("obs", F.coalesce("obs", F.lit(0)))
    return scored(counts, config)


def with_distance(pairs: DataFrame, nodes: DataFrame, distance=S.haversine_km) -> DataFrame:
    """pairs with both ends' coordinates and dist_km. nodes: node, lon, lat."""
    a = nodes.select(F.col("node").alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = nodes.select(F.col("node").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return pairs.join(a, "a").join(b, "b").withColumn("dist_km", distance("lon1", "lat1", "lon2", "lat2") if distance is not S.haversine_km else S.haversine_km(*map(F.col, ("lon1", "lat1", "lon2", "lat2"))))


def edges(scores: DataFrame, nodes: DataFrame, config: PairConfig = PairConfig(), distance=S.haversine_km) -> DataFrame:
    """Pairs with p < alpha; distances are computed for those alone."""
    return with_distance(scores.where(F.col("p") < config.alpha), nodes, distance)


def test_count(hot: DataFrame, cold: DataFrame | None = None, mode: str = "union") -> DataFrame:
    """(m): the number of tests. One table: n(n-1)/2. Two: "union" 2·C(n,2) over all nodes, "product" hot·cold less shared."""
    if cold is None:
        return hot.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("bigint").alias("m"))
    h, c = hot.select("node", F.lit(1).alias("h"), F.lit(0).alias("c")), cold.select("node", F.lit(0).alias("h"), F.lit(1).alias("c"))
    both = h.unionByName(c).groupBy("node").agg(F.max("h").alias("h"), F.max("c").alias("c"))
    n = F.count(F.lit(1))
    if mode == "union":
        return both.agg((n * (n - 1)).cast("bigint").alias("m"))
    return both.agg((F.sum("h") * F.sum("c") - F.sum(F.col("h") * F.col("c"))).cast("bigint").alias("m"))


def p_rank(edges_: DataFrame) -> DataFrame:
    """edges with rank by (p, a, b) over the whole table, without sorting it in one task.

    Logarithmic bins of p are ranked each by itself; the counts of smaller bins, at most some thousand rows, shift them.
    """
    binned = edges_.withColumn("_bin", F.floor(8 * F.ln(F.greatest("p", F.lit(1e-300)))))
    counts = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = counts.select("_bin", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bin").orderBy("p", *PAIR))
    return binned.withColumn("_own", own).join(F.broadcast(shifted), "_bin").withColumn("rank", (F.col("_before") + F.col("_own")).cast("bigint")).drop("_bin", "_before", "_own")


def fdr_screen(edges_: DataFrame, m: DataFrame, q: float = 0.05, mode: str = "count") -> DataFrame:
    """Edges with rank, line = rank·q/m, cutoff and keep.

    "count" keeps as many of the smallest p as there are ranks at or below the line, wherever those are; "step_up" keeps
    all up to the last such rank. m and the sums over all edges are tables of one row.
    """
    ranked = p_rank(edges_).crossJoin(F.broadcast(m))
    ranked = ranked.withColumn("line", F.col("rank") * q / F.col("m")).withColumn("below", F.col("p") <= F.col("line"))
    n = F.count_if("below") if mode == "count" else F.max(F.when(F.col("below"), F.col("rank")))
    kept = ranked.agg(F.coalesce(n, F.lit(0)).alias("n_keep"))
    cutoff = ranked.crossJoin(F.broadcast(kept)).agg(F.max(F.when(F.col("rank") <= F.col("n_keep"), F.col("p"))).alias("cutoff"))
    return ranked.crossJoin(F.broadcast(cutoff)).withColumn("keep", F.coalesce(F.col("p") <= F.col("cutoff"), F.lit(False)))


def fdr_summary(screened: DataFrame, m: DataFrame, q: float, long_range_km: float = 2500.0) -> DataFrame:
    """candidates, tests, q, retained, cutoff and the retained edges' long-range count, percentage and median distance.

    Retained is the number of ranks at or below the line; distances are of all edges up to the cut-off, ties included.
    """
    far = F.col("dist_km") > long_range_km
    kept = F.col("keep")
    got = screened.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("below").alias("retained"), F.max("cutoff").alias("cutoff"), F.count_if(kept & far).alias("retained_long"),
        F.round(100 * F.avg(F.when(kept, far.cast("double"))), 6).alias("percent_long"), F.round(F.median(F.when(kept, F.col("dist_km"))), 6).alias("median_km"),
    )
    return got.crossJoin(m).select("candidates", F.col("m").alias("tests"), F.lit(q).alias("q"), "retained", "cutoff", "retained_long", "percent_long", "median_km")


def edge_summary(edges_: DataFrame, long_range_km: float = 2500.0, by: tuple[str, ...] = ()) -> DataFrame:
    """n_edges, long-range count and percentage, median distance."""
    far = F.col("dist_km") > long_range_km
    aggregates = (
        F.count(F.lit(1)).alias("n_edges"), F.count_if(far).alias("n_long"),
        F.round(100 * F.avg(far.cast("double")), 6).alias("percent_long"), F.round(F.median("dist_km"), 6).alias("median_km"),
    )
    return (edges_.groupBy(*by) if by else edges_).agg(*aggregates)


def alpha_sweep(scores: DataFrame, nodes: DataFrame, alphas: list[float], long_range_km: float = 2500.0) -> DataFrame:
    """edge_summary for each alpha, from one scored table."""
    widest = with_distance(scores.where(F.col("p") < max(alphas)), nodes)
    each = widest.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in sorted(alphas)]))).where("p < alpha")
    return edge_summary(each, long_range_km, ("alpha",))
