"""Queries on coincidence networks, runs and bundles."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BundleConfig, PairConfig, RunConfig
from ..functions import scalars as S
from ..functions.special import geodesic_km
from ..operators import bundles as B
from ..operators import coincidence as C
from ..operators import runs as R
from ..operators import sensitivity as V
from ..operators import stats as T
from ..sources.tables import node_lat, node_lon, nodes
from . import sql as Q
from .event_queries import cold_days, hot_days
from .kept import kept

#: The series are independent, so a screen at the usual level would be empty.
PAIRS = PairConfig(alpha=0.95)
ALPHAS = [0.8, 0.9, 0.95]
#: The screens of the false-discovery rate take the usual levels, on the related series of kin_days.
KIN_PAIRS = PairConfig(alpha=0.05)
FDR_Q = 0.05
KIN = 5
THRESHOLD = 0.1


def _valid_act(days: DataFrame) -> DataFrame:
    return C.activity(days).join(C.valid_nodes(days, PAIRS.min_events).select("node"), "node", "left_semi")


def valid_nodes(spark, sf_dir):
    return C.valid_nodes(hot_days(spark, sf_dir), PAIRS.min_events)


def test_counts(spark, sf_dir):
    hot, cold = C.valid_nodes(hot_days(spark, sf_dir), 60), C.valid_nodes(cold_days(spark, sf_dir), 60)
    one = lambda df, name: df.select(F.lit(name).alias("kind"), "m")
    return one(C.test_count(hot), "coherent").unionByName(one(C.test_count(hot, cold), "union")).unionByName(one(C.test_count(hot, cold, "product"), "product"))


def pair_overlap(spark, sf_dir):
    return C.overlap(_valid_act(hot_days(spark, sf_dir)))


def pair_observed(spark, sf_dir):
    return C.observed(_valid_act(hot_days(spark, sf_dir)), PAIRS.k_days)


def pair_observed_dipole(spark, sf_dir):
    return C.observed(_valid_act(hot_days(spark, sf_dir)), PAIRS.k_days, _valid_act(cold_days(spark, sf_dir)))


def pair_counts_blocked(spark, sf_dir):
    return C.blocked_counts(_valid_act(hot_days(spark, sf_dir)), PAIRS.k_days, block=8)


def pair_counts_blocked_dipole(spark, sf_dir):
    return C.blocked_counts(_valid_act(hot_days(spark, sf_dir)), PAIRS.k_days, _valid_act(cold_days(spark, sf_dir)), block=8)


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("a", "b", "n_eff", "n_a", "n_b", "obs", F.round("lam", 8).alias("lam"), F.round("p", 8).alias("p"))


def pair_scores(spark, sf_dir):
    return _rounded(C.pair_scores(hot_days(spark, sf_dir), PAIRS))


def pair_scores_dipole(spark, sf_dir):
    return _rounded(C.pair_scores(hot_days(spark, sf_dir), PAIRS, cold_days(spark, sf_dir)))


def coherent(spark, sf_dir) -> DataFrame:
    """The edge table, kept like the event tables: screens and bundles read it several times."""
    return kept(spark, sf_dir, "coherent", C.edges(C.pair_scores(hot_days(spark, sf_dir), PAIRS), nodes(spark, sf_dir), PAIRS))


def dipole(spark, sf_dir) -> DataFrame:
    return kept(spark, sf_dir, "dipole", C.edges(C.pair_scores(hot_days(spark, sf_dir), PAIRS, cold_days(spark, sf_dir)), nodes(spark, sf_dir), PAIRS))


def _edge_rows(e: DataFrame) -> DataFrame:
    return e.select("a", "b", "lon1", "lat1", "lon2", "lat2", F.round("dist_km", 5).alias("dist_km"), "n_eff", "obs", F.round("p", 8).alias("p"))


def coherent_edges(spark, sf_dir):
    return _edge_rows(coherent(spark, sf_dir))


def dipole_edges(spark, sf_dir):
    return _edge_rows(dipole(spark, sf_dir))


def kin_days(spark, sf_dir) -> DataFrame:
    """hot_days as node-days of 5 nodes for each one: its own series, and four (ids + 100, … + 400) that share 2/24 to 8/24 of its event days.

    The test tables' nations are independent; these relations give the false-discovery screens something to keep.
    """
    j = F.col("j")
    shared = (F.col("doy") * 11 + F.col("node") * 17 + F.col("year") * 5 + j * 3) % 24 < j * 2
    each = hot_days(spark, sf_dir).select("node", "day", "doy", "year", "evt_run", F.explode(F.sequence(F.lit(0), F.lit(KIN - 1))).alias("j"))
    return each.select((F.col("node") + 100 * j).alias("node"), "day", ((F.col("evt_run") == 1) & ((j == 0) | shared)).cast("int").alias("evt_run"))


def kin_edges(spark, sf_dir) -> DataFrame:
    """Screened pairs of kin_days. p is rounded far below any level, so that the last bits of a sum can't move a rank."""
    scores = C.pair_scores(kin_days(spark, sf_dir), KIN_PAIRS).withColumn("p", F.round("p", 10))
    node = F.col("node") + 100 * F.col("j")
    each = nodes(spark, sf_dir).select("node", F.explode(F.sequence(F.lit(0), F.lit(KIN - 1))).alias("j"))
    return kept(spark, sf_dir, "kin", C.edges(scores, each.select(node.alias("node"), node_lon(node).alias("lon"), node_lat(node).alias("lat")), KIN_PAIRS))


def _kin_tests(spark, sf_dir) -> DataFrame:
    return C.test_count(C.valid_nodes(kin_days(spark, sf_dir), KIN_PAIRS.min_events))


def _fdr(spark, sf_dir, mode):
    got = C.fdr_screen(kin_edges(spark, sf_dir), _kin_tests(spark, sf_dir), FDR_Q, mode)
    return got.select("a", "b", "rank", F.round("line", 8).alias("line"), F.round("cutoff", 8).alias("cutoff"), "keep")


def fdr_screen(spark, sf_dir):
    return _fdr(spark, sf_dir, "count")


def fdr_step_up(spark, sf_dir):
    return _fdr(spark, sf_dir, "step_up")


def fdr_summary(spark, sf_dir):
    m = _kin_tests(spark, sf_dir)
    got = C.fdr_summary(C.fdr_screen(kin_edges(spark, sf_dir), m, FDR_Q), m, FDR_Q, 8000.0)
    return got.withColumn("cutoff", F.round("cutoff", 8))


def fdr_modes(spark, sf_dir):
    """Both modes on p values that cross the line many times, one for each pair of nations, so that they keep different sets."""
    n = nodes(spark, sf_dir).select("node")
    pairs = n.select(F.col("node").alias("a")).join(F.broadcast(n.select(F.col("node").alias("b"))), F.col("a") < F.col("b"))  # 25 nations
    u = ((F.col("a") * 37 + F.col("b") * 101) % 997) / 997
    waves = pairs.withColumn("p", F.round(0.05 * u * (0.95 + 0.3 * F.sin(40 * u)), 10))
    m = waves.agg(F.count(F.lit(1)).alias("m"))
    each = [C.fdr_screen(waves, m, FDR_Q, mode).withColumn("mode", F.lit(mode)) for mode in ("count", "step_up")]
    return each[0].unionByName(each[1]).select("mode", "a", "b", "rank", F.round("line", 8).alias("line"), F.round("cutoff", 8).alias("cutoff"), "keep")


def edge_summary(spark, sf_dir):
    return C.edge_summary(coherent(spark, sf_dir), 8000.0)


def alpha_sweep(spark, sf_dir):
    return C.alpha_sweep(C.pair_scores(hot_days(spark, sf_dir), PAIRS), nodes(spark, sf_dir), ALPHAS, 8000.0)


SETTINGS = [(3, 0.95), (1, 0.95), (3, 0.9)]


def setting_sweep(spark, sf_dir):
    """Edges under several windows and levels: one scored table for each window, the levels as filters on it."""
    hot = hot_days(spark, sf_dir)
    out = None
    for k in sorted({k for k, _ in SETTINGS}):
        scores = C.pair_scores(hot, PairConfig(k_days=k)).withColumn("alpha", F.explode(F.array(*[F.lit(a) for kk, a in SETTINGS if kk == k])))
        far = C.with_distance(scores.where("p < alpha"), nodes(spark, sf_dir)).withColumn("k_days", F.lit(k))
        out = far if out is None else out.unionByName(far)
    label = F.when((F.col("k_days") == 3) & (F.col("alpha") == 0.95), "Primary").when(F.col("k_days") != 3, F.concat(F.lit("K="), F.col("k_days"))).otherwise(F.concat(F.lit("p<"), F.col("alpha").cast("string")))
    rows = C.edge_summary(out.withColumn("setting", label).withColumn("layer", F.lit("Coherent")), 8000.0, ("layer", "setting"))
    return V.against_primary(rows, ["layer"]).withColumn("ratio_to_primary", F.round("ratio_to_primary", 6))


def runs(spark, sf_dir) -> DataFrame:
    return R.event_runs(hot_days(spark, sf_dir), 1)


def cold_runs(spark, sf_dir) -> DataFrame:
    return R.event_runs(cold_days(spark, sf_dir), 1)


def event_runs(spark, sf_dir):
    return runs(spark, sf_dir).select("node", "run_uid", S.day_text(F.col("start")).alias("start_day"), S.day_text(F.col("end")).alias("end_day"), "duration", F.round("intensity_mean", 2).alias("intensity_mean"), F.round(F.col("intensity_max").cast("double"), 2).alias("intensity_max"), "month", F.coalesce("dur_bin", F.lit("")).alias("dur_bin"))


def locked_runs_join(spark, sf_dir):
    return R.locked_by_join(runs(spark, sf_dir), R.node_pairs(coherent(spark, sf_dir)), 3)


def locked_runs_join_dipole(spark, sf_dir):
    return R.locked_by_join(runs(spark, sf_dir), R.node_pairs(dipole(spark, sf_dir), ordered=True), 3, cold_runs(spark, sf_dir))


def locked_runs_sweep(spark, sf_dir):
    return R.locked_by_sweep(runs(spark, sf_dir), R.node_pairs(coherent(spark, sf_dir)), 3)


def locked_runs_sweep_dipole(spark, sf_dir):
    return R.locked_by_sweep(runs(spark, sf_dir), R.node_pairs(dipole(spark, sf_dir), ordered=True), 3, cold_runs(spark, sf_dir))


def _marked(spark, sf_dir, mode="join") -> DataFrame:
    marked = R.mark_locked(runs(spark, sf_dir), R.node_pairs(coherent(spark, sf_dir)), RunConfig(lock_mode=mode, k_days=1))
    return marked.withColumn("dur_bin", F.coalesce("dur_bin", F.lit("1")))


def raw_lock_summary(spark, sf_dir):
    return R.raw_lock_summary(_marked(spark, sf_dir))


def matched_controls(spark, sf_dir):
    return R.matched_controls(_marked(spark, sf_dir, "sweep"))


def matched_deltas(spark, sf_dir):
    """A row per matched pair, kept for the summaries, which read it several times."""
    marked = _marked(spark, sf_dir, "sweep")
    return kept(spark, sf_dir, "deltas", R.matched_deltas(marked, R.matched_controls(marked)))


def matched_deltas_rounded(spark, sf_dir):
    got = matched_deltas(spark, sf_dir)
    return got.select("locked_uid", "control_uid", "dur_bin", F.round("delta", 2).alias("delta"))


def paired_tests(spark, sf_dir):
    """The paired summary without its bootstrap: differences to whole units, so that single precision can't move a rank."""
    d = matched_deltas(spark, sf_dir).withColumn("delta", F.round("delta", 0))
    test = T.wilcoxon(d)
    base = d.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.median("delta").alias("median_delta"))
    both = base.crossJoin(F.broadcast(test))  # a row each
    return both.select("n_pairs", "mean_delta", "median_delta", F.round("z", 8).alias("z"), F.round("p_greater", 8).alias("p_greater"), F.round("p_two_sided", 8).alias("p_two_sided"))


def stratified_tests(spark, sf_dir):
    """The stratified summary without its bootstrap: the tests of each duration bin with enough pairs."""
    d = matched_deltas(spark, sf_dir).withColumn("delta", F.round("delta", 0))
    base = d.groupBy("dur_bin").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.median("delta").alias("median_delta"))
    test = T.wilcoxon(d, ("dur_bin",)).select("dur_bin", F.round("z", 8).alias("z"), F.round("p_greater", 8).alias("p_greater"))
    return base.where("n_pairs >= 5").join(test, "dur_bin", "left")


def layer_totals(spark, sf_dir):
    """Synchronised days summed over the bundles of a layer: a row a year, with the layer's total and mean a year."""
    yearly = dates(spark, sf_dir).groupBy(F.year("day").alias("year"), "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("year").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("bundles"))
    total = yearly.agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean_annual"))
    return yearly.crossJoin(F.broadcast(total))  # one row


def first_events(spark, sf_dir):
    """Each node's first event day and what it measured: the first row of a group, without sorting it."""
    hot = hot_days(spark, sf_dir).where("evt_run = 1")
    got = hot.groupBy("node").agg(F.min_by(F.struct("day", F.col("value").alias("v")), "day").alias("r"))
    return got.select("node", S.day_text(F.col("r.day")).alias("day"), F.col("r.v").alias("value"))


def longest_edges(spark, sf_dir):
    """The first three edges of each node by falling distance, then p and the other node."""
    order = Window.partitionBy("a").orderBy(F.desc(F.round("dist_km", 5)), F.round("p", 8), "b")
    return _edge_rows(coherent(spark, sf_dir).withColumn("_k", F.row_number().over(order)).where("_k <= 3")).select("a", "b", "dist_km", "p")


def cluster_groups(spark, sf_dir):
    """k-means on edges whose ends are moved apart by group, so that the best clustering is known: a row for each group."""
    off = (F.col("a") % 3) * 1000
    apart = coherent(spark, sf_dir).select("a", "b", *[(F.col(c) + off).alias(c) for c in B.ENDPOINTS])
    found = B.cluster_edges(apart, 3)
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("edges"), F.min("a").alias("first_a"), F.count_distinct("a").alias("nodes"), F.round(F.avg("lon1"), 6).alias("lon1"), F.round(F.avg("lat2"), 6).alias("lat2")).drop("cluster")


def paired_summary(spark, sf_dir):
    return T.paired_summary(matched_deltas(spark, sf_dir), 800, 101)


def stratified_summary(spark, sf_dir):
    return T.stratified_summary(matched_deltas(spark, sf_dir), 500, 201, bins=("1", "2", "3-4"), least=5)


def sides(spark, sf_dir) -> DataFrame:
    """Stand-in bundles that need no model: edges by the first node modulo 3."""
    return B.side_nodes(coherent(spark, sf_dir).withColumn("cluster", B.fixed_groups(F.col("a"), 3).cast("int")))


def _flagged(days: DataFrame) -> DataFrame:
    return days.where("evt_run = 1").select("node", "day")


def daily_signal(spark, sf_dir):
    got = B.daily_signal(_flagged(hot_days(spark, sf_dir)), sides(spark, sf_dir))
    return got.select("cluster", "side", S.day_text(F.col("day")).alias("day"), "n", F.round("signal", 8).alias("signal"))


def dates(spark, sf_dir) -> DataFrame:
    return B.synchronized_dates(B.daily_signal(_flagged(hot_days(spark, sf_dir)), sides(spark, sf_dir)), THRESHOLD)


def synchronized_dates(spark, sf_dir):
    return dates(spark, sf_dir).select("cluster", S.day_text(F.col("day")).alias("day"))


def bundle_summary(spark, sf_dir):
    clustered = coherent(spark, sf_dir).withColumn("cluster", B.fixed_groups(F.col("a"), 3).cast("int"))
    got = B.bundle_summary(clustered, dates(spark, sf_dir), BundleConfig(threshold=THRESHOLD))
    return got.select("mechanism", "rank", "cluster_id", "edge_count", F.round("edge_share", 8).alias("edge_share"), *[F.round(f"centroid_{c}", 6).alias(f"centroid_{c}") for c in B.ENDPOINTS], "node_count_a", "node_count_b", "date_count", "first_date", "last_date")


def bundle_reconstruction(spark, sf_dir):
    clustered = coherent(spark, sf_dir).withColumn("cluster", B.fixed_groups(F.col("a"), 3).cast("int"))
    return B.reconstruction(clustered, bundle_summary(spark, sf_dir))


def cluster_bundles(spark, sf_dir):
    summary, _ = B.extract_bundles(coherent(spark, sf_dir), _flagged(hot_days(spark, sf_dir)), BundleConfig(clusters=3, threshold=THRESHOLD), min_km=2500.0)
    return summary


def geodesic_edges(spark, sf_dir):
    e = C.with_distance(C.pair_scores(hot_days(spark, sf_dir), PAIRS), nodes(spark, sf_dir), lambda *c: geodesic_km(*c))
    return e.select("a", "b", F.round("dist_km", 3).alias("geodesic_km"))


def edge_sample(spark, sf_dir):
    return T.sample_rows(coherent_edges(spark, sf_dir), 10, 20240527, "a", "b")


@cache
def oracles() -> dict[str, str]:
    hot = (Q.ND, Q.events(), Q.valid("ev", "ok", 5), Q.active("ev", "ok", "act"))
    both = (*hot, Q.events("cd", "cold"), Q.valid("cd", "okc", 5), Q.active("cd", "okc", "actc"))
    same, cross = Q.counts("act", "act", "cc", 3, True), Q.counts("act", "actc", "cc", 3, False)
    scored = Q.scores("cc", "sc", 3, 200)
    coh = (Q.NODES, *hot, same, scored, Q.edges("sc", "e", 0.95))
    dip = (Q.NODES, *both, cross, scored, Q.edges("sc", "e", 0.95))
    score_columns = "select a, b, n_eff, n_a, n_b, obs, round(lam, 8) as lam, round(p, 8) as p from sc"
    edge_columns = "select a, b, lon1, lat1, lon2, lat2, round(dist_km, 5) as dist_km, n_eff, obs, round(p, 8) as p from e"
    kin = (
        *hot[:2], f"kn as (select node + 100 * j as node, day, (evt_run = 1 and (j = 0 or (doy * 11 + node * 17 + year * 5 + j * 3) % 24 < j * 2))::int as evt_run from ev, range(0, {KIN}) t(j))",
        f"nodes as (select node, {Q.LON} as lon, {Q.LAT} as lat from (select n_nationkey::bigint + 100 * j as node from nation, range(0, {KIN}) t(j)))",
        Q.valid("kn", "ok", 5), Q.active("kn", "ok", "act"), same, Q.scores("cc", "sk", 3, 200), "sc as (select * replace (round(p, 10) as p) from sk)", Q.edges("sc", "e", 0.05),
    )
    summary = "count(*) as n_edges, count(*) filter (where dist_km > 8000) as n_long, round(100 * avg((dist_km > 8000)::int::double), 6) as percent_long, round(median(dist_km), 6) as median_km"
    ranked = f"rk as (select *, row_number() over (order by p, a, b) as rank, (select count(*) * (count(*) - 1) / 2 from ok) as m from e), ln as (select *, rank * {FDR_Q} / m as line, p <= rank * {FDR_Q} / m as below from rk)"
    fdr = "select a, b, rank, round(line, 8) as line, round(cutoff, 8) as cutoff, coalesce(p <= cutoff, false) as keep from (select *, max(case when rank <= n_keep then p end) over () as cutoff from (select *, {} as n_keep from ln))"
    run1 = Q.runs("ev", "r", 1)
    pairs = "pr as (select distinct least(a, b) as a, greatest(a, b) as b from e)"
    met = "mt as (select x.run_uid as ua, y.run_uid as ub from r x join pr on x.node = pr.a join r y on y.node = pr.b where x.start_day - {0} <= y.end_day and y.start_day - {0} <= x.end_day)"
    locked = "lk as (select ua as run_uid from mt union select ub from mt)"
    side = "sd as (select distinct (a % 3)::int as cluster, 'side_a' as side, a as node from e union select distinct (a % 3)::int, 'side_b', b from e)"
    signal = "sg as (select cluster, side, day, count(*) as n, count(*)::double / max(size) as signal from (select * from ev where evt_run = 1) x join sd using (node) join (select cluster, side, count(*) as size from sd group by 1, 2) z using (cluster, side) group by 1, 2, 3)"
    sync = f"sy as (select x.cluster, x.day from sg x join sg y on x.cluster = y.cluster and x.day = y.day and x.side = 'side_a' and y.side = 'side_b' where x.signal > {THRESHOLD} and y.signal > {THRESHOLD})"
    sweep = []
    for i, (k, alpha) in enumerate(SETTINGS):
        label = "Primary" if (k, alpha) == (3, 0.95) else f"K={k}" if k != 3 else f"p<{alpha}"
        sweep += [Q.counts("act", "act", f"c{i}", k, True), Q.scores(f"c{i}", f"s{i}", k, 200), Q.edges(f"s{i}", f"e{i}", alpha), f"m{i} as (select 'Coherent' as layer, '{label}' as setting, {summary} from e{i})"]
    all_settings = " union all ".join(f"select * from m{i} where n_edges > 0" for i in range(len(SETTINGS)))
    return {
        "valid_nodes": Q.query(*hot, select="select * from ok"),
        "test_counts": Q.query(Q.ND, Q.events(), Q.events("cd", "cold"), Q.valid("ev", "h", 60), Q.valid("cd", "c", 60), select="select 'coherent' as kind, (select count(*) * (count(*) - 1) // 2 from h)::bigint as m union all select 'union', (select count(*) * (count(*) - 1) from (select node from h union select node from c))::bigint union all select 'product', ((select count(*) from h) * (select count(*) from c) - (select count(*) from h join c using (node)))::bigint"),
        "pair_overlap": Q.query(*hot, same, select="select * from cc_n"),
        "pair_observed": Q.query(*hot, same, select="select * from cc_o"),
        "pair_observed_dipole": Q.query(*both, cross, select="select * from cc_o"),
        "pair_counts_blocked": Q.query(*hot, same, select="select * from cc"),
        "pair_counts_blocked_dipole": Q.query(*both, cross, select="select * from cc"),
        "pair_scores": Q.query(*hot, same, scored, select=score_columns),
        "pair_scores_dipole": Q.query(*both, cross, scored, select=score_columns),
        "coherent_edges": Q.query(*coh, select=edge_columns),
        "dipole_edges": Q.query(*dip, select=edge_columns),
        "fdr_screen": Q.query(*kin, ranked, select=fdr.format("count(*) filter (where below) over ()")),
        "fdr_step_up": Q.query(*kin, ranked, select=fdr.format("coalesce(max(case when below then rank end) over (), 0)")),
        "fdr_summary": Q.query(*kin, ranked, f"fk as ({fdr.format('count(*) filter (where below) over ()').replace('select a, b, rank, round(line, 8) as line, round(cutoff, 8) as cutoff,', 'select dist_km, below, m, cutoff,')})", select=f"select count(*) as candidates, (select (count(*) * (count(*) - 1)) // 2 from ok)::bigint as tests, {FDR_Q}::double as q, count(*) filter (where below) as retained, round(max(cutoff), 8) as cutoff, count(*) filter (where keep and dist_km > 8000) as retained_long, round(100 * avg((dist_km > 8000)::int::double) filter (where keep), 6) as percent_long, round(median(dist_km) filter (where keep), 6) as median_km from fk"),
        "fdr_modes": Q.query(
            "u as (select x.n_nationkey::bigint as a, y.n_nationkey::bigint as b, ((x.n_nationkey * 37 + y.n_nationkey * 101) % 997) / 997.0::double as u from nation x join nation y on x.n_nationkey < y.n_nationkey)",
            "rk as (select a, b, p, row_number() over (order by p, a, b) as rank, (select count(*) from u) as m from (select a, b, round(0.05 * u * (0.95 + 0.3 * sin(40 * u)), 10) as p from u))",
            f"ln as (select *, rank * {FDR_Q} / m as line, p <= rank * {FDR_Q} / m as below from rk)",
            select=" union all ".join(fdr.format(n).replace("select a, b", f"select '{mode}' as mode, a, b", 1) for mode, n in (("count", "count(*) filter (where below) over ()"), ("step_up", "coalesce(max(case when below then rank end) over (), 0)"))),
        ),
        "stratified_tests": Q.query(*coh, run1, pairs, Q.sweep("r", "r", "lk", 1, True), Q.MATCHED, "dr as (select dur_bin, round(delta, 0) as delta from dl)", "wk as (select dur_bin, abs(delta) as a, count(*) as t, count(*) filter (where delta > 0) as plus from dr where delta <> 0 group by 1, 2)", "wr as (select *, coalesce(sum(t) over (partition by dur_bin order by a rows between unbounded preceding and 1 preceding), 0) + (t + 1) / 2.0 as rank from wk)", "ww as (select dur_bin, sum(t)::bigint as n, sum(plus * rank)::double as w, sum(t * t * t - t)::double as ties from wr group by 1)", "wz as (select dur_bin, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48) as z from ww)", select=f"select dur_bin, n_pairs, mean_delta, median_delta, round(z, 8) as z, round({Q.upper_tail('z')}, 8) as p_greater from (select dur_bin, count(*) as n_pairs, round(avg(delta), 6) as mean_delta, median(delta) as median_delta from dr group by 1) left join wz using (dur_bin) where n_pairs >= 5"),
        "layer_totals": Q.query(*coh, side, signal, sync, "yr as (select year(day)::int as year, count(*) as n, count(distinct cluster) as bundles from sy group by 1)", select="select year, n, bundles, (select sum(n)::bigint from yr) as total, (select round(avg(n), 6) from yr) as mean_annual from yr"),
        "first_events": Q.query(*hot[:2], select="select node, strftime(min(day), '%Y-%m-%d') as day, arg_min(value, day) as value from ev where evt_run = 1 group by node"),
        "longest_edges": Q.query(*coh, f"er as ({edge_columns})", select="select a, b, dist_km, p from (select *, row_number() over (partition by a order by dist_km desc, p, b) as k from er) where k <= 3"),
        "cluster_groups": Q.query(*coh, select="select count(*) as edges, min(a) as first_a, count(distinct a) as nodes, round(avg(lon1 + (a % 3) * 1000), 6) as lon1, round(avg(lat2 + (a % 3) * 1000), 6) as lat2 from e group by a % 3"),
        "bundle_reconstruction": Q.query(*coh, select="select c::int as cluster_id, k as \"check\", true as ok, 0::bigint as failures from (select distinct a % 3 as c from e), (select unnest(['edge_count', 'node_count_a', 'node_count_b']) as k)"),
        "geodesic_edges": Q.query(*coh, "pq as (select a, b, x.lon as lon1, x.lat as lat1, y.lon as lon2, y.lat as lat2 from sc join nodes x on x.node = a join nodes y on y.node = b)", Q.geodesic("pq", "gd"), select="select a, b, round(km, 3) as geodesic_km from gd"),
        "edge_sample": Q.query(*coh, select=f"{edge_columns} order by md5('20240527:' || a || ':' || b), a, b limit 10"),
        "edge_summary": Q.query(*coh, select=f"select {summary} from e"),
        "alpha_sweep": Q.query(*coh, select=f"select alpha::double as alpha, {summary} from e join (select unnest([0.8, 0.9, 0.95]::double[]) as alpha) on p < alpha group by alpha"),
        "setting_sweep": Q.query(Q.NODES, *hot, *sweep, f"al as ({all_settings})", select="select *, round(n_edges::double / (select n_edges from al where setting = 'Primary'), 6) as ratio_to_primary from al"),
        "event_runs": Q.query(Q.ND, Q.events(), run1, select="select node, run_uid, strftime(start_day, '%Y-%m-%d') as start_day, strftime(end_day, '%Y-%m-%d') as end_day, duration, round(intensity_mean, 2) as intensity_mean, round(intensity_max::double, 2) as intensity_max, month, case when duration = 1 then '' else dur_bin end as dur_bin from r"),
        "locked_runs_join": Q.query(*coh, run1, pairs, met.format(6), locked, select="select run_uid from lk"),
        "locked_runs_join_dipole": Q.query(*dip, run1, Q.runs("cd", "rc", 1), "pr as (select distinct a, b from e)", "mt as (select distinct x.run_uid from r x join pr on x.node = pr.a join rc y on y.node = pr.b where x.start_day - 6 <= y.end_day and y.start_day - 6 <= x.end_day)", select="select run_uid from mt"),
        "locked_runs_sweep": Q.query(*coh, run1, pairs, Q.sweep("r", "r", "lk", 3, True), select="select distinct run_uid from lk"),
        "locked_runs_sweep_dipole": Q.query(*dip, run1, Q.runs("cd", "rc", 1), "pr as (select distinct a, b from e)", Q.sweep("r", "rc", "lk", 3, False), select="select distinct run_uid from lk"),
        "matched_controls": Q.query(*coh, run1, pairs, Q.sweep("r", "r", "lk", 1, True), Q.MATCHED, select="select locked_uid, control_uid from dl"),
        "matched_deltas_rounded": Q.query(*coh, run1, pairs, Q.sweep("r", "r", "lk", 1, True), Q.MATCHED, select="select locked_uid, control_uid, dur_bin, round(delta, 2) as delta from dl"),
        "paired_tests": Q.query(*coh, run1, pairs, Q.sweep("r", "r", "lk", 1, True), Q.MATCHED, "dr as (select round(delta, 0) as delta from dl)", Q.signed_ranks("dr", "wx"), select=f"select (select count(*) from dr) as n_pairs, (select round(avg(delta), 6) from dr) as mean_delta, (select median(delta) from dr) as median_delta, round(z, 8) as z, round({Q.upper_tail('z')}, 8) as p_greater, round(case when z is not null then least(1.0, 2 * {Q.upper_tail('abs(z)')}) end, 8) as p_two_sided from wx"),
        "raw_lock_summary": Q.query(*coh, run1, pairs, met.format(2), locked, "mk as (select r.*, run_uid in (select run_uid from lk) as is_locked from r)", select="select count(*) as n_runs, count(*) filter (where is_locked) as n_locked, round(avg(is_locked::int::double), 6) as locked_fraction, round(avg(intensity_mean) filter (where is_locked), 4) as locked_mean, round(avg(intensity_mean) filter (where not is_locked), 4) as free_mean, round(avg(intensity_mean) filter (where is_locked) - avg(intensity_mean) filter (where not is_locked), 4) as mean_delta from mk"),
        "daily_signal": Q.query(*coh, side, signal, select="select cluster, side, strftime(day, '%Y-%m-%d') as day, n, round(signal, 8) as signal from sg"),
        "synchronized_dates": Q.query(*coh, side, signal, sync, select="select cluster, strftime(day, '%Y-%m-%d') as day from sy"),
        "bundle_summary": Q.query(*coh, side, signal, sync, "k as (select (a % 3)::int as cluster, count(*) as edge_count, avg(lon1) as x1, avg(lat1) as y1, avg(lon2) as x2, avg(lat2) as y2, count(distinct a) as na, count(distinct b) as nb from e group by 1)", select="select 'Coherent' as mechanism, row_number() over (order by edge_count desc, cluster)::int as rank, cluster as cluster_id, edge_count, round(edge_count::double / sum(edge_count) over (), 8) as edge_share, round(x1, 6) as centroid_lon1, round(y1, 6) as centroid_lat1, round(x2, 6) as centroid_lon2, round(y2, 6) as centroid_lat2, na as node_count_a, nb as node_count_b, coalesce(d, 0) as date_count, coalesce(f, '') as first_date, coalesce(l, '') as last_date from k left join (select cluster, count(*) as d, strftime(min(day), '%Y-%m-%d') as f, strftime(max(day), '%Y-%m-%d') as l from sy group by 1) using (cluster)"),
    }


QUERIES = {f.__name__: f for f in (
    valid_nodes, test_counts, pair_overlap, pair_observed, pair_observed_dipole, pair_counts_blocked, pair_counts_blocked_dipole, pair_scores,
    pair_scores_dipole, coherent_edges, dipole_edges, fdr_screen, fdr_step_up, fdr_summary, fdr_modes, edge_summary, alpha_sweep, setting_sweep, event_runs, locked_runs_join,
    locked_runs_join_dipole, locked_runs_sweep, locked_runs_sweep_dipole, raw_lock_summary, matched_controls, matched_deltas_rounded, paired_tests, paired_summary,
    stratified_summary, daily_signal, synchronized_dates, bundle_summary, bundle_reconstruction, cluster_bundles, geodesic_edges, edge_sample,
    stratified_tests, layer_totals, first_events, longest_edges, cluster_groups,
)}
