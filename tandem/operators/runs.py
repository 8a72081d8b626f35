"""Runs of event days: islands, locking of runs between linked nodes, and matching of locked runs with controls."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RunConfig
from ..functions import scalars as S


def event_runs(events: DataFrame, min_duration: int = 2, flag: str = "evt_run", value: str = "value", threshold: str = "thr") -> DataFrame:
    """Runs of consecutive calendar days whose flag is set, of at least min_duration days.

    run_id counts a node's runs before that filter; run_uid is dense over all runs after it, by node and run. Excess over
    the threshold is taken in single precision.
    """
    order = Window.partitionBy("node").orderBy("day")
    hot = events.where(F.col(flag) == 1).withColumn("excess", F.col(value).cast("float") - F.col(threshold).cast("float"))
    new = F.coalesce((F.datediff("day", F.lag("day").over(order)) != 1).cast("int"), F.lit(1))
    runs = hot.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("node", "run_id").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.count(F.lit(1)).alias("duration"),
        F.avg("excess").alias("intensity_mean"), F.max("excess").alias("intensity_max"),
    ).where(F.col("duration") >= min_duration)
    # A dense id without one global sort: ids within a node, shifted by the runs of smaller nodes.
    per_node = runs.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    before = per_node.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("node").orderBy("run_id")) - 1
    return runs.withColumn("month", F.month("start")).withColumn("dur_bin", S.duration_bin(F.col("duration"))).join(before, "node").withColumn("run_uid", (F.col("_before") + own).cast("bigint")).drop("_before")


def node_pairs(edges: DataFrame, left: str = "a", right: str = "b", ordered: bool = False, min_km: float | None = None) -> DataFrame:
    """Distinct (a, b) of edges, the smaller node first unless the order has a meaning; longer than min_km if given."""
    far = edges if min_km is None else edges.where(F.col("dist_km") > min_km)
    a, b = (F.col(left), F.col(right)) if ordered else S.canonical_pair(F.col(left), F.col(right))
    return far.select(a.alias("a"), b.alias("b")).distinct()


def locked_by_join(runs: DataFrame, pairs: DataFrame, k_days: int, cold: DataFrame | None = None) -> DataFrame:
    """(run_uid) of runs that meet a run of a linked node, both widened by k_days: the relational superset of the sweep.

    The range condition becomes an equi-join on buckets of days, so no pair of nodes is joined run by run.
    """
    width = 2 * k_days + 14
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(F.datediff(lo, F.lit("1970-01-01").cast("date")) / width), F.floor(F.datediff(hi, F.lit("1970-01-01").cast("date")) / width)))
    side = lambda r, node, x: r.select(F.col("node").alias(node), F.col("run_uid").alias(f"u{x}"), F.col("start").alias(f"s{x}"), F.col("end").alias(f"e{x}"))
    a = side(runs, "a", "a").withColumn("bkt", bucket(F.date_sub("sa", 2 * k_days), F.date_add("ea", 2 * k_days)))
    b = side(runs if cold is None else cold, "b", "b").withColumn("bkt", bucket(F.col("sb"), F.col("eb")))
    met = a.join(pairs, "a").join(b, ["b", "bkt"]).where((F.date_sub("sa", 2 * k_days) <= F.col("eb")) & (F.date_sub("sb", 2 * k_days) <= F.col("ea")))
    uids = met.select(F.col("ua").alias("run_uid"))
    return (uids if cold is not None else uids.unionByName(met.select(F.col("ub").alias("run_uid")))).distinct()


def sweep(a: list[tuple], b: list[tuple], k_days: int) -> tuple[set[int], set[int]]:
    """Uids locked by a two-pointer sweep over runs (uid, start day, end day) in start order: the run that ends first goes."""
    la, lb, i, j = set(), set(), 0, 0
    while i < len(a) and j < len(b):
        (ua, sa, ea), (ub, sb, eb) = a[i], b[j]
        if sa - k_days <= eb + k_days and sb - k_days <= ea + k_days:
            la.add(ua)
            lb.add(ub)
            i, j = (i + 1, j) if ea <= eb else (i, j + 1)
        elif sa < sb:
            i += 1
        else:
            j += 1
    return la, lb


def locked_by_sweep(runs: DataFrame, pairs: DataFrame, k_days: int, cold: DataFrame | None = None, block: int = 64) -> DataFrame:
    """(run_uid) of runs that the sweep locks, pair by pair.

    Pairs are dealt out by the blocks of their two nodes, so a run is copied to the linked blocks of its block, not to
    each of its node's links. A task holds the runs of two blocks of nodes and at most block² pairs.
    """
    one_sided = cold is not None

    def one(key, sides: pd.DataFrame, linked: pd.DataFrame) -> pd.DataFrame:
        of = {at: list(zip(f["uid"].tolist(), f["s"].tolist(), f["e"].tolist())) for at, f in sides.sort_values(["s", "uid"]).groupby(["side", "node"], sort=False)}
        locked: set[int] = set()
        for a, b in zip(linked["a"].tolist(), linked["b"].tolist()):
            la, lb = sweep(of.get((0, a), []), of.get((1, b), []), k_days)
            locked |= la if one_sided else la | lb
        return pd.DataFrame({"run_uid": np.array(sorted(locked), "int64")})

    place = lambda c: F.floor(F.col(c) / block).cast("bigint")
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    dealt = pairs.select("a", "b", place("a").alias("ba"), place("b").alias("bb"))
    met = dealt.select("ba", "bb").distinct()

    def rows(r: DataFrame, side: int, at: str) -> DataFrame:
        own = r.select(F.lit(side).alias("side"), "node", F.col("run_uid").alias("uid"), day("start").alias("s"), day("end").alias("e"), place("node").alias(at))
        return own.join(met, at).select(F.col("ba").alias("ka"), F.col("bb").alias("kb"), "side", "node", "uid", "s", "e")

    sides = rows(runs, 0, "ba").unionByName(rows(runs if cold is None else cold, 1, "bb"))
    return sides.groupBy("ka", "kb").cogroup(dealt.groupBy("ba", "bb")).applyInPandas(one, "run_uid long").distinct()


def mark_locked(runs: DataFrame, pairs: DataFrame, config: RunConfig = RunConfig(), cold: DataFrame | None = None) -> DataFrame:
    """runs with is_locked. With cold runs, pairs are (hot node, cold node) and hot runs alone are marked."""
    locked = (locked_by_sweep if config.lock_mode == "sweep" else locked_by_join)(runs, pairs, config.k_days, cold)
    return runs.join(locked.withColumn("is_locked", F.lit(True)), "run_uid", "left").withColumn("is_locked", F.coalesce("is_locked", F.lit(False)))


def nearest_unused(starts: list[int], target: int) -> int:
    """The place of the nearest start among the insertion point and its neighbours; ties go to the earlier place."""
    pos = bisect_left(starts, target)
    near = [p for p in (pos - 1, pos, pos + 1) if 0 <= p < len(starts)] or [0]
    return min(near, key=lambda p: abs(starts[p] - target))


def matched_controls(runs: DataFrame) -> DataFrame:
    """(locked_uid, control_uid): within node, month and duration bin, each locked run in start order takes the nearest free one."""

    def one(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["s", "run_uid"], kind="stable")
        free = group.loc[~group["is_locked"]]
        starts, uids, out = free["s"].tolist(), free["run_uid"].tolist(), []
        for uid, s in group.loc[group["is_locked"], ["run_uid", "s"]].itertuples(index=False):
            if not starts:
                break
            at = nearest_unused(starts, s)
            out.append((uid, uids[at]))
            del starts[at], uids[at]
        return pd.DataFrame(out, columns=["locked_uid", "control_uid"]).astype("int64")

    rows = runs.dropna(subset=["intensity_mean", "dur_bin"]).select("node", "month", "dur_bin", "run_uid", "is_locked", F.datediff("start", F.lit("1970-01-01").cast("date")).alias("s"))
    return rows.groupBy("node", "month", "dur_bin").applyInPandas(one, "locked_uid long, control_uid long")


def matched_deltas(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """matches with both mean intensities, their difference and the locked run's duration bin."""
    side = lambda x, more=(): runs.select(F.col("run_uid").alias(f"{x}_uid"), F.col("intensity_mean").alias(f"{x}_intensity_mean"), *more)
    both = matches.join(side("locked", [F.col("dur_bin")]), "locked_uid").join(side("control"), "control_uid")
    return both.withColumn("delta", F.col("locked_intensity_mean") - F.col("control_intensity_mean"))


def raw_lock_summary(runs: DataFrame) -> DataFrame:
    """n_runs, n_locked, locked_fraction and mean intensities of locked and other runs; NULL where there are none."""
    mean = lambda on: F.avg(F.when(on, F.col("intensity_mean")))
    locked = F.col("is_locked")
    return runs.agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(locked).alias("n_locked"), F.round(F.avg(locked.cast("double")), 6).alias("locked_fraction"),
        F.round(mean(locked), 4).alias("locked_mean"), F.round(mean(~locked), 4).alias("free_mean"), F.round(mean(locked) - mean(~locked), 4).alias("mean_delta"),
    )
