"""Robust trends and paired tests. Pairs within a group are joined by an equi-join on the group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clip
from ..functions.special import kendall_p, normal_upper_tail

#: The 97.5 % point of the normal distribution, by which a 95 % interval of ranks is cut.
Z95 = 1.959963984540054


def _pairs(series: DataFrame, by: list[str]) -> DataFrame:
    a = series.select(*by, F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = series.select(*by, F.col("x").alias("x2"), F.col("y").alias("y2"))
    on = a.join(b, by) if by else a.crossJoin(b)  # without a key the series itself is the group, such as 25 years
    return on.where("x1 < x2")


def _ties(series: DataFrame, by: list[str], column: str) -> DataFrame:
    """Per group: tied pairs and the two sums that the tie corrections need."""
    t = F.col("t")
    counted = series.groupBy(*by, column).agg(F.count(F.lit(1)).alias("t"))
    return counted.groupBy(*by).agg(
        F.sum(t * (t - 1) / 2).cast("bigint").alias(f"ties_{column}"),
        F.sum(t * (t - 1) * (t - 2)).cast("double").alias(f"{column}_a"),
        F.sum(t * (t - 1) * (2 * t + 5)).cast("double").alias(f"{column}_b"),
    )


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by) if by else left.crossJoin(right)  # both have one row


def theil_sen(series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """slope (median of pairwise slopes), intercept (median y less slope times median x) and Sen's 95 % interval.

    series: by, x, y. The interval cuts the sorted slopes at ranks (k ± z·sd)/2, sd corrected for tied y. Slopes are ranked
    by a sort that can spill, so a long series is never held in one row.
    """
    by = list(by)
    slopes = _pairs(series, by).select(*by, ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("s")).where("s is not null")
    middle = series.groupBy(*by).agg(F.median("x").alias("mx"), F.median("y").alias("my"), F.count(F.lit(1)).alias("n"))
    sizes = _joined(_joined(slopes.groupBy(*by).agg(F.count(F.lit(1)).alias("k")), middle, by), _ties(series, by, "y"), by)
    n = F.col("n").cast("double")
    sd = F.sqrt((n * (n - 1) * (2 * n + 5) - F.col("y_b")) / 18)
    upper = F.least(F.round((F.col("k") - (-Z95) * sd) / 2).cast("bigint"), F.col("k") - 1)
    lower = F.greatest(F.round((F.col("k") - Z95 * sd) / 2).cast("bigint") - 1, F.lit(0))
    cuts = sizes.select(*by, "k", "mx", "my", lower.alias("lower"), upper.alias("upper"))
    ranked = slopes.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("s")))
    at = lambda *ranks: F.avg(F.when(F.col("r").isin(*ranks), F.col("s")))
    half = F.floor(F.col("k") / 2)
    found = _joined(ranked, F.broadcast(cuts), by) if not by else ranked.join(cuts, by)
    got = found.groupBy(*by, "mx", "my").agg(at(F.ceil(F.col("k") / 2), half + 1).alias("slope"), at(F.col("lower") + 1).alias("low95"), at(F.col("upper") + 1).alias("high95"))
    return got.select(*by, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "low95", "high95")


def kendall_tau(series: DataFrame, by: tuple[str, ...] = (), p_value: bool = True) -> DataFrame:
    """Kendall's tau-b of x and y and, if asked for, its two-sided p. NULL where x or y is constant."""
    by = list(by)
    score = _pairs(series, by).groupBy(*by).agg(F.sum(F.signum(F.col("y2") - F.col("y1"))).cast("bigint").alias("score"))
    n = series.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    all_ = _joined(_joined(_joined(score, n, by), _ties(series, by, "x"), by), _ties(series, by, "y"), by)
    total = F.col("n") * (F.col("n") - 1) / 2
    tau = F.col("score") / F.nullif(F.sqrt((total - F.col("ties_x")) * (total - F.col("ties_y"))), F.lit(0.0))
    p = [kendall_p("n", "score", "ties_x", "ties_y", "x_a", "x_b", "y_a", "y_b").alias("p")] if p_value else []
    return all_.select(*by, "n", "score", tau.alias("tau"), *p)


def trend(series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Total, mean, Theil–Sen and Kendall of a series, in one row per group."""
    by = list(by)
    sums = series.groupBy(*by).agg(F.sum("y").alias("total"), F.avg("y").alias("mean"))
    return _joined(_joined(sums, theil_sen(series, tuple(by)), by), kendall_tau(series, tuple(by)).drop("n", "score"), by)


def wilcoxon_z(deltas: DataFrame, by: tuple[str, ...] = (), value: str = "delta") -> DataFrame:
    """Signed-rank statistic of non-zero differences: n, w_plus and z by the tie-corrected normal approximation.

    Equal sizes share their mean rank. Ranks need one order per group; without a key that is the whole table, which here
    holds one row per matched pair.
    """
    by = list(by)
    used = deltas.where(F.col(value) != 0).withColumn("_abs", F.abs(value))
    sizes = used.groupBy(*by, "_abs").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(value) > 0).alias("plus"))
    below = F.coalesce(F.sum("t").over(Window.partitionBy(*by).orderBy("_abs").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", below + (F.col("t") + 1) / 2)
    t, n = F.col("t"), F.col("n")
    got = ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w_plus"), F.sum(t * t * t - t).alias("ties"))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return got.select(*by, "n", "w_plus", ((F.col("w_plus") - mean) / F.nullif(F.sqrt(var), F.lit(0.0))).alias("z"))


def wilcoxon(deltas: DataFrame, by: tuple[str, ...] = (), value: str = "delta") -> DataFrame:
    z = wilcoxon_z(deltas, by, value)
    return z.withColumn("p_greater", normal_upper_tail("z")).withColumn("p_two_sided", clip(2 * normal_upper_tail(F.abs("z")), None, 1.0))


def bootstrap_mean(deltas: DataFrame, n_boot: int, seed: int, order: str, value: str = "delta", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, low, high): 2.5 and 97.5 percentiles of means of resamples, drawn by numpy's generator in the order given.

    The sample is one number per matched pair and is resampled as a whole, each group in one task.
    """
    names = [*by, "low", "high"]

    def one(key, group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values(order)[value].to_numpy(float)
        rng = np.random.default_rng(seed)
        index = np.arange(len(x))
        means = [np.mean(x[rng.choice(index, size=len(x), replace=True)]) for _ in range(n_boot)]
        return pd.DataFrame([(*key, *np.percentile(means, [2.5, 97.5]))], columns=names)

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in deltas.select(*by).schema.fields)
    return deltas.select(*by, order, value).groupBy(*by).applyInPandas(one, kinds + "low double, high double")


def paired_summary(deltas: DataFrame, n_boot: int, seed: int, order: str = "locked_uid", by: tuple[str, ...] = ()) -> DataFrame:
    """(by) n_pairs, mean and median difference, bootstrap interval and Wilcoxon p; without by, NULLs where there are no pairs."""
    at = list(by) or ["_k"]
    keyed = lambda df: df if by else df.withColumn("_k", F.lit(1))
    base = keyed(deltas.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta")))
    boot = keyed(bootstrap_mean(deltas, n_boot, seed, order, by=by)).withColumnsRenamed({"low": "boot95_mean_lo", "high": "boot95_mean_hi"})
    test = keyed(wilcoxon(deltas, by)).select(*at, F.col("p_greater").alias("wilcoxon_p_greater"), F.col("p_two_sided").alias("wilcoxon_p_two_sided"))
    return base.join(boot, at, "left").join(test, at, "left").drop("_k")


def stratified_summary(deltas: DataFrame, n_boot: int, seed: int, least: int = 30, bins: tuple[str, ...] = ("2", "3-4", "5+")) -> DataFrame:
    """paired_summary for each duration bin with enough pairs; the bins are summed up and resampled side by side."""
    enough = deltas.where(F.col("dur_bin").isin(*bins)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("dur_bin"))).where(F.col("_n") >= least).drop("_n")
    return paired_summary(enough, n_boot, seed, by=("dur_bin",))


def sample_rows(df: DataFrame, n: int, seed: int, *keys: str, where: Column | None = None) -> DataFrame:
    """n seeded rows without replacement, or all if there are fewer; the same rows on any partitioning.

    They are the n smallest MD5 sums of seed and keys, joined by colons, so other engines can draw the same rows.
    """
    chosen = df if where is None else df.where(where)
    return chosen.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)
