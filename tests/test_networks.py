import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandem.config import PairConfig, RunConfig
from tandem.operators import bundles as B
from tandem.operators import coincidence as C
from tandem.operators import runs as R
from tandem.operators import stats as T
from tandem.operators import surrogates as U

DAY0 = dt.date(2001, 1, 1)
day = lambda d: DAY0 + dt.timedelta(int(d))


def table(spark, rows):
    return spark.createDataFrame([(n, day(d), e) for n, d, e in rows], "node bigint, day date, evt int")


def random_series(seed, nodes=5, days=60):
    rng = random.Random(seed)
    return [(n, d, int(rng.random() < 0.3)) for n in range(nodes) for d in range(days) if rng.random() < 0.8]


def brute(rows, others, k, same):
    act_a = {n: {d for m, d, _ in rows if m == n} for n, _, _ in rows}
    evt_a = {n: {d for m, d, e in rows if m == n and e} for n in act_a}
    act_b = {n: {d for m, d, _ in others if m == n} for n, _, _ in others}
    evt_b = {n: {d for m, d, e in others if m == n and e} for n in act_b}
    out = {}
    for a in act_a:
        for b in act_b:
            if (a < b) if same else (a != b):
                common = act_a[a] & act_b[b]
                if common:
                    ea, eb = evt_a[a] & common, evt_b[b] & common
                    out[a, b] = (len(common), len(ea), len(eb), sum(any(abs(x - y) <= k for y in eb) for x in ea))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("same", [True, False])
def test_both_physical_forms_match_brute_force(spark, seed, same):
    rows, others = random_series(seed), random_series(seed + 10)
    act, other = table(spark, rows), None if same else table(spark, others)
    want = brute(rows, rows if same else others, 3, same)
    relational = C.overlap(act, other).join(C.observed(act, 3, other), ["a", "b"], "left").fillna(0)
    for got in (relational, C.blocked_counts(act, 3, other, block=2)):
        assert {(r["a"], r["b"]): (r["n_eff"], r["n_a"], r["n_b"], r["obs"]) for r in got.collect()} == want


def test_counts_are_directional(spark):
    rows = [(1, 1, 1), (1, 2, 1), (1, 3, 0), (2, 1, 1), (2, 2, 0), (2, 3, 0)]
    assert C.observed(table(spark, rows), 3).first()["obs"] == 2
    swapped = [(3 - n, d, e) for n, d, e in rows]
    assert C.observed(table(spark, swapped), 3).first()["obs"] == 1


def test_scores_need_overlap(spark):
    rows = random_series(5)
    events = table(spark, rows).withColumnRenamed("evt", "evt_run")
    got = C.pair_scores(events, PairConfig(min_events=1, min_overlap=38))
    assert 0 < got.count() < 10 and got.where("n_eff < 38").count() == 0 and got.where("p < 0 or p > 1").count() == 0


def test_fdr_counts_ranks_below_the_line(spark):
    edges = spark.createDataFrame([(1, 2, 0.03, 10.0), (1, 3, 0.04, 10.0)], "a bigint, b bigint, p double, dist_km double")
    m = spark.createDataFrame([(2,)], "m bigint")
    kept = lambda mode: sorted(r["p"] for r in C.fdr_screen(edges, m, 0.05, mode).where("keep").collect())
    assert kept("count") == [0.03] and kept("step_up") == [0.03, 0.04]


def test_ranks_in_bins_are_global(spark):
    rng = np.random.default_rng(3)
    p = [float(x) for x in np.r_[rng.uniform(size=200) ** 6, 0.0, 0.0, 1.0, 1.0]]
    edges = spark.createDataFrame([(i, i + 1, x) for i, x in enumerate(p)], "a bigint, b bigint, p double")
    got = [r["a"] for r in C.p_rank(edges).orderBy("rank").collect()]
    assert got == sorted(range(len(p)), key=lambda i: (p[i], i))


def runs_table(spark, runs):
    rows = [(n, uid, day(s), day(e), e - s + 1, float(i), i % 12 + 1, "2", uid) for i, (n, uid, s, e) in enumerate(runs)]
    return spark.createDataFrame(rows, "node bigint, run_id bigint, start date, end date, duration bigint, intensity_mean double, month int, dur_bin string, run_uid bigint")


def test_the_sweep_can_miss_what_the_join_finds(spark):
    runs = runs_table(spark, [(1, 1, 1, 2), (2, 11, 1, 3), (2, 12, 6, 7)])
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    uids = lambda df: sorted(r["run_uid"] for r in df.collect())
    assert uids(R.locked_by_sweep(runs, pairs, 3)) == [1, 11]
    assert uids(R.locked_by_join(runs, pairs, 3)) == [1, 11, 12]


def test_sweep_is_a_subset_of_the_join(spark):
    rng = random.Random(9)
    runs, uid = [], 0
    for node in range(4):
        at = rng.randint(0, 20)
        for _ in range(30):
            end = at + rng.randint(1, 6)
            runs.append((node, uid, at, end))
            uid, at = uid + 1, end + rng.randint(2, 25)
    frame = runs_table(spark, runs)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "a bigint, b bigint")
    sweep = {r["run_uid"] for r in R.locked_by_sweep(frame, pairs, 3).collect()}
    join = {r["run_uid"] for r in R.locked_by_join(frame, pairs, 3).collect()}
    by = {u: (n, s, e) for n, u, s, e in runs}
    want = {u for a, b in [(0, 1), (0, 2), (1, 3)] for u, (n, s, e) in by.items() for n2, s2, e2 in by.values() if {n, n2} == {a, b} and s - 3 <= e2 + 3 and s2 - 3 <= e + 3}
    assert sweep <= join == want


def test_matching_takes_the_nearest_free_control_and_the_earlier_of_two(spark):
    rows = [(1, 100, 10, True), (1, 1, 8, False), (1, 2, 12, False), (1, 101, 11, True), (1, 102, 30, True), (2, 103, 10, True)]
    frame = spark.createDataFrame([(n, u, day(s), l, 1.0, 1, "2") for n, u, s, l in rows], "node bigint, run_uid bigint, start date, is_locked boolean, intensity_mean double, month int, dur_bin string")
    got = {r["locked_uid"]: r["control_uid"] for r in R.matched_controls(frame).collect()}
    assert got == {100: 1, 101: 2}


def test_runs_from_flags(spark):
    rows = [(1, day(d), 5.0, 1.0, 1) for d in (1, 2, 3, 7, 9, 10)] + [(0, day(5), 3.0, 1.0, 1), (0, day(6), 4.0, 1.0, 1)]
    events = spark.createDataFrame(rows, "node bigint, day date, value double, thr double, evt_run int")
    got = R.event_runs(events, 2).orderBy("run_uid").collect()
    assert [(r["node"], r["duration"], r["run_uid"], r["intensity_mean"], r["dur_bin"]) for r in got] == [(0, 2, 0, 2.5, "2"), (1, 3, 1, 4.0, "3-4"), (1, 2, 2, 4.0, "2")]


def test_mark_locked_and_summary(spark):
    runs = runs_table(spark, [(1, 1, 1, 2), (2, 11, 1, 3), (2, 12, 60, 61)])
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    marked = R.mark_locked(runs, pairs, RunConfig())
    s = R.raw_lock_summary(marked).first()
    assert (s["n_runs"], s["n_locked"], s["locked_mean"], s["free_mean"]) == (3, 2, 0.5, 2.0)


def test_signals_and_dates(spark):
    sides = spark.createDataFrame([(0, "side_a", 1), (0, "side_a", 2), (0, "side_b", 3)], "cluster int, side string, node bigint")
    days = spark.createDataFrame([(1, day(1)), (3, day(1)), (1, day(2)), (2, day(2)), (3, day(3))], "node bigint, day date")
    signal = B.daily_signal(days, sides)
    assert {(r["side"], r["day"], r["signal"]) for r in signal.collect()} == {("side_a", day(1), 0.5), ("side_b", day(1), 1.0), ("side_a", day(2), 1.0), ("side_b", day(3), 1.0)}
    assert [r["day"] for r in B.synchronized_dates(signal, 0.05).collect()] == [day(1)]
    assert B.synchronized_dates(signal, 0.5).count() == 0  # strictly above


def test_clusters_need_enough_edges(spark):
    edges = spark.createDataFrame([(1, 2, 0.0, 0.0, 1.0, 1.0, 3000.0)], "a bigint, b bigint, lon1 double, lat1 double, lon2 double, lat2 double, dist_km double")
    with pytest.raises(ValueError):
        B.cluster_edges(edges, 2)


def test_clusters_find_separate_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 100 + i, *(float(c + x) for c, x in zip(centre, rng.normal(size=4)))) for i, centre in enumerate([(-100, 40, 10, 50)] * 20 + [(100, 30, -90, 40)] * 10)]
    edges = spark.createDataFrame(rows, "a bigint, b bigint, lon1 double, lat1 double, lon2 double, lat2 double").withColumn("dist_km", F.lit(5000.0))
    ranks = B.ranked_clusters(B.cluster_edges(edges, 2, seeds=3), 2).orderBy("rank").collect()
    assert [r["edge_count"] for r in ranks] == [20, 10]


# Two published yearly series, 2000 to 2024, and their published trend statistics.
SERIES = {
    "first": [0, 1, 0, 0, 0, 2, 10, 0, 0, 4, 10, 4, 2, 1, 0, 10, 9, 11, 39, 21, 19, 12, 47, 74, 5],
    "second": [0, 0, 2, 0, 0, 0, 0, 0, 0, 2, 9, 1, 2, 13, 1, 9, 2, 4, 2, 17, 7, 14, 11, 10, 0],
}
TRENDS = {
    "first": (281.0, 11.24, 0.8, -1605.6, 0.36363636363636365, 1.4285714285714286, 0.6045109225096396, 4.170804515831381e-05),
    "second": (106.0, 4.24, 0.2638888888888889, -528.9444444444445, 0.1, 0.5882352941176471, 0.5237229365663817, 0.0005215059932002158),
}


def test_published_trends_are_reproduced(spark):
    rows = [(k, 2000.0 + i, float(v)) for k, values in SERIES.items() for i, v in enumerate(values)]
    got = T.trend(spark.createDataFrame(rows, "name string, x double, y double"), ("name",)).collect()
    for r in got:
        assert tuple(r)[1:] == pytest.approx(TRENDS[r["name"]], rel=1e-12)


def test_trend_without_a_key(spark):
    got = T.trend(spark.createDataFrame([(2000.0 + i, float(v)) for i, v in enumerate(SERIES["first"])], "x double, y double")).first()
    assert got["slope"] == pytest.approx(0.8)


def test_wilcoxon_by_hand(spark):
    deltas = spark.createDataFrame([(x,) for x in (1.0, -2.0, 3.0, 3.0, 0.0)], "delta double")
    got = T.wilcoxon(deltas).first()
    assert (got["n"], got["w_plus"]) == (4, 8.0)  # ranks 1, 2, 3.5, 3.5; zero left out
    assert got["z"] == pytest.approx((8 - 5) / np.sqrt(4 * 5 * 9 / 24 - 6 / 48))


def test_paired_summary_of_nothing_has_nulls(spark):
    none = spark.createDataFrame([], "locked_uid bigint, delta double, dur_bin string")
    got = T.paired_summary(none, 10, 1).first()
    assert got["n_pairs"] == 0 and got["mean_delta"] is None and got["wilcoxon_p_two_sided"] is None and got["boot95_mean_lo"] is None


def test_bootstrap_follows_numpy(spark):
    x = [0.5, 1.5, -0.25, 2.0]
    got = T.bootstrap_mean(spark.createDataFrame(list(enumerate(x)), "locked_uid bigint, delta double"), 200, 101, "locked_uid").first()
    rng = np.random.default_rng(101)
    means = [np.mean(np.array(x)[rng.choice(np.arange(4), size=4, replace=True)]) for _ in range(200)]
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_surrogates_keep_counts_and_rotate(spark):
    rows = [(n, day(d), 2001, int((n + d) % 7 == 0)) for n in range(3) for d in range(0, 50, 2)]
    events = spark.createDataFrame(rows, "node bigint, day date, year int, evt_run int")
    placed = U.positions(events)
    moved = U.shifted_days(placed, 4, U.hashed_shift(7))
    counts = {(r["draw"], r["node"]): r["count"] for r in moved.groupBy("draw", "node").count().collect()}
    want = pd.DataFrame(rows, columns=["node", "day", "year", "evt"]).groupby("node").evt.sum().to_dict()
    assert counts == {(k, n): v for k in range(4) for n, v in want.items()}
    same = U.shifted_days(placed, 1, F.lit(0)).select("node", "day").exceptAll(events.where("evt_run = 1").select("node", "day"))
    assert same.isEmpty()


def test_empirical_p(spark):
    draws = spark.createDataFrame([(float(i),) for i in range(1000)], "v double")
    assert draws.agg(U.empirical_p(F.lit(2000.0), F.col("v")).alias("p")).first()["p"] == pytest.approx(1 / 1001)


def test_draws_without_a_synchronised_day_count_as_zero(spark):
    totals = spark.createDataFrame([(3, 0, 2001, 4), (3, 0, 2002, 2), (7, 0, 2001, 1)], "draw int, cluster int, year int, n long")
    sides = spark.createDataFrame([(c, s, 1) for c in (0, 1) for s in ("side_a", "side_b")], "cluster int, side string, node long")
    observed = spark.createDataFrame([(0, 2.0)], "cluster int, observed double")
    got = {r["cluster"]: r for r in U.surrogate_summary(U.dense_totals(totals, sides, 10, ["cluster"]), observed, ["cluster"]).collect()}
    values = np.array([0, 0, 0, 6, 0, 0, 0, 1, 0, 0], float)
    assert got[0]["surrogate_mean"] == pytest.approx(0.7) and got[0]["empirical_p"] == pytest.approx(2 / 11)
    assert (got[0]["surrogate_p95"], got[0]["surrogate_p99"]) == pytest.approx(tuple(np.percentile(values, [95, 99])))
    assert (got[1]["observed"], got[1]["surrogate_mean"], got[1]["empirical_p"]) == (0.0, 0.0, 1.0)


def test_registered_surrogates_have_all_draws():
    from tandem.config import SurrogateConfig
    from tandem.plans import analysis_queries as A

    assert A.DRAWS == SurrogateConfig().draws == 1000


def test_layer_slopes_against_a_plain_version(spark):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, size=(12, 2, 6)) * (rng.random((12, 2, 6)) < 0.3)
    seen = np.array([[0, 1, 0, 2, 4, 5], [0, 0, 0, 0, 0, 0]])
    totals = [(d, "AB"[k], 2000 + y, int(n)) for (d, k, y), n in np.ndenumerate(counts) if n]
    observed = [("AB"[k], 2000 + y, int(n)) for (k, y), n in np.ndenumerate(seen) if n]
    layers = spark.createDataFrame([("A",), ("B",)], "layer string")
    got = U.layer_summary(spark.createDataFrame(totals, "draw int, layer string, year int, n long"), spark.createDataFrame(observed, "layer string, year int, n long"), layers, 12, (2000, 2005))
    slope = lambda y: float(np.median([(y[j] - y[i]) / (j - i) for i in range(6) for j in range(i + 1, 6)]))
    rows = {r["layer"]: r.asDict() for r in got.collect()}
    for k, layer in enumerate("AB"):
        for name, f in (("total", lambda y: float(y.sum())), ("slope", slope)):
            o, v = f(seen[k]), np.array([f(y) for y in counts[:, k]])
            want = (o, v.mean(), *np.percentile(v, [95, 99]), ((v >= o).sum() + 1) / 13)
            assert tuple(rows[layer][f"{name}_{c}"] for c in ("observed", "surrogate_mean", "surrogate_p95", "surrogate_p99", "empirical_p")) == pytest.approx(want)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_the_sweep_by_blocks_is_the_sweep_pair_by_pair(spark, block):
    rng = random.Random(4)
    runs, uid = [], 0
    for n in range(8):
        at = 0
        for _ in range(12):
            at += rng.randrange(3, 15)
            runs.append((n, uid, at, at + rng.randrange(3)))
            uid += 1
    pairs = [(a, b) for a in range(8) for b in range(a + 1, 8) if rng.random() < 0.4]
    want, cold = set(), set()
    for a, b in pairs:
        of = [[(u, s, e) for n, u, s, e in runs if n == x] for x in (a, b)]
        la, lb = R.sweep(*of, 2)
        want |= la | lb
        cold |= la
    table_ = runs_table(spark, runs)
    linked = spark.createDataFrame(pairs, "a bigint, b bigint")
    uids = lambda df: {r["run_uid"] for r in df.collect()}
    assert uids(R.locked_by_sweep(table_, linked, 2, block=block)) == want
    assert uids(R.locked_by_sweep(table_, linked, 2, table_, block=block)) == cold


def test_both_scoring_forms_agree(spark):
    events = table(spark, random_series(6)).withColumnRenamed("evt", "evt_run")
    config = PairConfig(min_events=1, min_overlap=5)
    rows = lambda blocked: sorted(map(tuple, C.pair_scores(events, config, blocked=blocked).select("a", "b", "n_eff", "n_a", "n_b", "obs").collect()))
    assert rows(True) == rows(False) != []


def test_samples_are_the_smallest_sums(spark):
    import hashlib

    df = spark.createDataFrame([(a, b) for a in range(9) for b in range(9)], "a bigint, b bigint").repartition(3)
    got = sorted(map(tuple, T.sample_rows(df, 7, 5, "a", "b").collect()))
    every = sorted(((a, b) for a in range(9) for b in range(9)), key=lambda r: hashlib.md5(f"5:{r[0]}:{r[1]}".encode()).hexdigest())
    assert got == sorted(every[:7])


def test_registered_modes_keep_different_sets(spark):
    from tandem.plans import network_queries as N

    got = N.fdr_modes(spark, "/root/testdata/sf0.001").groupBy("mode").agg(F.count_if("keep").alias("n")).collect()
    kept = {r["mode"]: r["n"] for r in got}
    assert 0 < kept["count"] < kept["step_up"] < 300


def test_kept_tables_of_another_folder_are_released(spark):
    from tandem.plans import kept as K

    K.release()
    one, two = spark.range(3).withColumn("x", F.lit(1)), spark.range(4).withColumn("x", F.lit(2))
    K.kept(spark, "one", "t", one)
    assert one.is_cached
    K.kept(spark, "two", "t", two)
    assert two.is_cached and not one.storageLevel.useMemory
    K.release()
    assert not two.storageLevel.useMemory


@pytest.mark.parametrize("n", [2, 3, 6, 9])
def test_slopes_by_rank_against_a_plain_version(spark, n):
    rng = np.random.default_rng(n)
    rows = [(g, float(x), float(rng.integers(0, 5))) for g in "ab" for x in range(n)] + [("a", 99.0, None)]
    got = {r["g"]: r for r in T.theil_sen(spark.createDataFrame(rows, "g string, x double, y double"), ("g",)).collect()}
    y = [r[2] for r in rows if r[0] == "b"]
    slopes = sorted((y[j] - y[i]) / (j - i) for i in range(n) for j in range(i + 1, n))
    ties = sum(y.count(v) * (y.count(v) - 1) * (2 * y.count(v) + 5) for v in set(y))
    sd = ((n * (n - 1) * (2 * n + 5) - ties) / 18) ** 0.5
    half_up = lambda v: int(np.floor(v + 0.5))
    low, high = max(half_up((len(slopes) - T.Z95 * sd) / 2) - 1, 0), min(half_up((len(slopes) + T.Z95 * sd) / 2), len(slopes) - 1)
    assert got["b"]["slope"] == pytest.approx(np.median(slopes))
    assert got["b"]["intercept"] == pytest.approx(np.median(y) - np.median(slopes) * np.median(range(n)))
    assert (got["b"]["low95"], got["b"]["high95"]) == pytest.approx((slopes[low], slopes[high]))
    own = [r[2] for r in rows if r[0] == "a" and r[2] is not None]
    assert got["a"]["slope"] == pytest.approx(np.median([(own[j] - own[i]) / (j - i) for i in range(n) for j in range(i + 1, n)]))
