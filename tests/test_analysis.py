import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import exposure as X
from tandem.operators import quality as D
from tandem.operators import sensitivity as V
from tandem.operators import spectral as P
from tandem.sources import files as S
from tandem.streaming.minima import streaming_minima


def test_band_pass_forms_agree(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=36)
    frame = spark.createDataFrame([(1, z.tolist())], "k int, z array<double>")
    spectrum = np.fft.rfft(z)
    spectrum[:4] = 0
    spectrum[9:] = 0
    want = np.fft.irfft(spectrum, n=36)
    assert P.band_pass(frame).first()["wave"] == pytest.approx(want.tolist())
    sums = [r["wave"] for r in P.band_pass_sums(frame, ["k"], 36, 4, 8).orderBy("i").collect()]
    assert sums == pytest.approx(want.tolist())


def test_drift_finds_the_shift(spark):
    late = np.sin(np.arange(36) * 2 * np.pi / 36 * 5) + 0.1 * np.arange(36)
    early = np.roll(late, 3)
    pairs = spark.createDataFrame([(1, early.tolist(), late.tolist())], "k int, early array<double>, late array<double>")
    got = P.drift(P.lag_correlation(pairs, ["k"], 36), ["k"]).first()
    assert got["best_shift"] == 3 and got["drift"] == pytest.approx(-0.5)


def test_anomalies_skip_nan(spark):
    frame = spark.createDataFrame([(1, [1.0, float("nan"), 3.0]), (1, [2.0, 5.0, 2.0])], "k int, z array<double>")
    got = P.composite(frame, ["k"]).first()
    assert got["n"] == 2 and got["z"] == pytest.approx([-1.0, 2.0, 0.0])


def test_nearest_value_and_class(spark):
    waves = spark.createDataFrame([([float(i) for i in range(8)], -44.0, 100.0)], "wave array<double>, lon_a double, lon_b double")
    got = P.diagnostics(waves, 8).first()
    assert (got["wave_a"], got["wave_b"], got["abs_delta"], got["class"]) == (7.0, 2.0, 5.0, "coherent-like")


def test_nearest_days_stay_in_the_year(spark):
    dates = spark.createDataFrame([(dt.date(2001, 1, 2),)], "date date")
    heights = spark.createDataFrame([(dt.date(2000, 12, 30), [1.0]), (dt.date(2001, 1, 1), [2.0]), (dt.date(2001, 1, 9), [3.0])], "date date, z array<double>")
    assert P.nearest_days(dates, heights, -3).first()["z"] == [2.0]


def test_nearest_days_query_answers_every_order_day(spark):
    from tandem.plans import catalog

    path = "/root/testdata/sf0.001"
    z = {r[0]: r[1] for r in spark.read.parquet(f"{path}/orders.parquet").groupBy(F.to_date("o_orderdate")).agg(F.max("o_totalprice")).collect()}
    near = {d: min((abs((h - d).days + 3), h) for h in z if h.year == d.year)[1] for d in z}
    got = {r["day"]: r["z"] for r in catalog.queries()["nearest_days"](spark, path).collect()}
    assert got == {d.isoformat(): z[h] for d, h in near.items()}


def test_nearest_days_cross_any_gap_of_the_year(spark):
    dates = spark.createDataFrame([(dt.date(2001, m, 15),) for m in (1, 5, 9, 12)] + [(dt.date(2003, 5, 1),)], "date date")
    days = [dt.date(2001, 1, 1), dt.date(2001, 8, 1), dt.date(2001, 8, 29), dt.date(2002, 1, 1)]
    heights = spark.createDataFrame([(d, [float(i)]) for i, d in enumerate(days)], "date date, z array<double>")
    for offset in (0, -3, 80):
        want = {d: min((abs((h - d).days - offset), i) for i, h in enumerate(days) if h.year == d.year)[1] for d in (dt.date(2001, m, 15) for m in (1, 5, 9, 12))}
        assert {r["date"]: r["z"] for r in P.nearest_days(dates, heights, offset).collect()} == {d: [float(i)] for d, i in want.items()}


def test_bundle_diagnostics_keep_windows_far_from_any_height(spark):
    rng = np.random.default_rng(5)
    heights = spark.createDataFrame([(dt.date(2001, 1, 1), 500, 40.0, rng.normal(size=16).tolist()), (dt.date(2001, 8, 1), 500, 40.0, rng.normal(size=16).tolist())], "date date, level int, lat double, z array<double>")
    bundles = spark.createDataFrame([("C1", 0.0, 40.0, 90.0, 40.0)], "bundle string, lon_a double, lat_a double, lon_b double, lat_b double")
    dates = spark.createDataFrame([("C1", dt.date(2001, 1, 2)), ("C1", dt.date(2001, 4, 10)), ("C1", dt.date(2001, 11, 1))], "bundle string, date date")
    assert P.bundle_diagnostics(bundles, dates, heights, 16).first()["n_windows"] == 3


def test_zonal_sums_count_a_node_once(spark):
    sides = spark.createDataFrame([(0, "side_a", 1), (0, "side_b", 1), (0, "side_b", 2)], "cluster int, side string, node bigint")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.25, 0.0)], "node bigint, lon double, lat double")
    pixels = spark.createDataFrame([(0.1, 0.1, 5.0), (0.13, 0.0, 7.0), (9.0, 9.0, 100.0)], "lon double, lat double, population double")
    got = {r["footprint"]: r["population"] for r in X.zonal_sum(X.footprints(sides), nodes, pixels).collect()}
    assert got == {"side_a": 5.0, "side_b": 12.0, "bundle_union": 12.0}
    size = {r["footprint"]: (r["node_count"], r["side_sum"]) for r in X.footprint_sizes(X.footprints(sides)).collect()}
    assert size["bundle_union"] == (2, 3)


def test_person_nights_without_dates_are_zero(spark):
    pop = spark.createDataFrame([(0, "bundle_union", 10.0), (1, "bundle_union", 3.0)], "cluster int, footprint string, population double")
    dates = spark.createDataFrame([(0, dt.date(2001, 1, 1)), (0, dt.date(2002, 1, 1))], "cluster int, day date")
    got = {r["cluster"]: r["person_nights"] for r in X.person_nights(pop, dates).collect()}
    assert got == {0: 20.0, 1: 0.0}
    assert X.annual_person_nights(pop, dates).count() == 2


def test_denominators(spark):
    d = dt.date(2001, 1, 1)
    events = spark.createDataFrame([(1, d, 2001, 1), (2, d, 2001, 0), (3, d, 2001, 1)], "node bigint, day date, year int, evt_run int")
    sides = spark.createDataFrame([(0, "side_a", 1), (0, "side_a", 2), (0, "side_a", 4), (0, "side_b", 3)], "cluster int, side string, node bigint")
    panel = spark.createDataFrame([(1, 2001, 1), (3, 2001, 1), (2, 2001, 0)], "node bigint, year int, active_y int")
    got = {r["scenario"]: r["n"] for r in V.denominator_scenarios(events, sides, panel, 1, threshold=0.4).collect()}
    # side a: 1 of 3 nodes flagged (fixed), 1 of 2 rows (active, two thirds covered), 1 of 1 urban node (a third covered)
    assert got == {
        "annual_urban_active_denominator": 1, "active_denominator_any_coverage": 1, "active_denominator_min50pct_coverage": 1,
        "stable_urban_core_fixed_denominator": 1, "stable_urban_core_active_denominator": 1,
    }


def test_nearest_primary_may_swap_sides(spark):
    rows = [("Primary", "Coherent", 1, 0.0, 0.0, 50.0, 0.0), ("K=1", "Coherent", 1, 50.0, 0.0, 0.0, 0.0), ("K=1", "Dipole", 1, 0.0, 0.0, 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "setting string, layer string, rank int, a_lon double, a_lat double, b_lon double, b_lat double")
    got = {(r["setting"], r["layer"]): (r["closest_primary_km"], r["within_1500km"]) for r in V.nearest_primary(frame).collect()}
    assert got["K=1", "Coherent"] == (0.0, True) and got["K=1", "Dipole"] == (None, False)


def test_ratio_and_override(spark):
    frame = spark.createDataFrame([("c", "Primary", 10), ("c", "K=1", 5), ("d", "K=1", 4)], "layer string, setting string, n_edges int")
    got = {(r["layer"], r["setting"]): r["ratio_to_primary"] for r in V.against_primary(frame, ["layer"]).collect()}
    assert got == {("c", "Primary"): 1.0, ("c", "K=1"): 0.5, ("d", "K=1"): None}
    new = V.override(frame, spark.createDataFrame([("c", "K=1", 7)], frame.schema), ["layer", "setting"], ["n_edges"])
    assert {r["n_edges"] for r in new.collect()} == {10, 7, 4}


def test_checks(spark):
    frame = spark.createDataFrame([(1, 2.0), (2, None)], "a int, b double")
    got = {r["check"]: (r["ok"], r["failures"]) for r in D.check_all(frame, {"a": F.col("a") > 0, "b": F.col("b") > 0}).collect()}
    assert got == {"a": (True, 0), "b": (False, 1)}
    with pytest.raises(AssertionError):
        D.enforce(D.check_all(frame, {"b": F.col("b") > 0}))
    with pytest.raises(ValueError):
        D.require_rows(frame, "frame", 3)
    with pytest.raises(ValueError):
        D.require_columns(frame, ["c"])
    diff = D.difference(frame, frame.withColumn("b", F.col("b") + 0.5), ["a"], ["b"]).first()
    assert (diff["rows"], diff["mismatches"], diff["max_abs_diff"]) == (2, 1, 0.5)


def test_hygiene(spark):
    files = spark.createDataFrame([("a.csv", 10), ("Draft_b.csv", 10), ("c.csv", 10**9)], "name string, bytes long")
    assert {tuple(r) for r in D.hygiene(files, ["draft"], 10**8).collect()} == {("Draft_b.csv", "forbidden name"), ("c.csv", "too large")}


def test_yearly_scans_and_sinks(spark, tmp_path):
    root = str(tmp_path)
    for y in (2000, 2002):
        S.write_table(spark.createDataFrame([(1.0, y)], "x double, y int"), f"{root}/grid_{y}.parquet")
    scan = S.scan_years(spark, root + "/grid_{year}.parquet", range(2000, 2003))
    assert scan.missing == [2001] and {r["year"] for r in scan.frame.collect()} == {2000, 2002}
    with pytest.raises(FileNotFoundError):
        S.scan_years(spark, root + "/none_{year}.parquet", [2000])
    table = spark.createDataFrame([("a", 1.5)], "k string, v double")
    S.write_csv(table, f"{root}/t.csv")
    assert S.read_csv(spark, f"{root}/t.csv").first()["v"] == 1.5
    assert "| a | 1.5 |" in S.markdown_table(table)
    S.write_markdown(spark, "Report", {"t": table}, f"{root}/r.md")
    S.write_json(spark, {"a": 1}, f"{root}/m.json")
    assert (tmp_path / "r.md").read_text().startswith("# Report") and '"a": 1' in (tmp_path / "m.json").read_text()
    (tmp_path / "list.txt").write_text("# comment\nr.md\n\nmissing.csv\n")
    found = S.list_files(spark, root).where("name like '%.md'")
    assert {tuple(r) for r in D.manifest_difference(S.read_manifest(spark, f"{root}/list.txt"), found).collect()} == {("missing.csv", "missing")}


def test_materialise_once_and_retry(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert S.cached_table(spark, f"{tmp_path}/c", build).count() == 3
    assert made == [1]
    calls = []

    def flaky():
        calls.append(time.time())
        if len(calls) < 3:
            raise OSError("not yet")
        return 7

    assert S.with_retries(flaky, wait=0.01) == 7
    with pytest.raises(FileNotFoundError):
        S.require(spark, [f"{tmp_path}/none"])


def test_time_column_fallback(spark):
    iso = spark.createDataFrame([("2020-01-01T00:00:00",), ("x",)], "time_iso string")
    assert [r["time_utc"] is None for r in S.time_column(iso).collect()] == [False, True]
    with pytest.raises(ValueError):
        S.time_column(spark.range(1))


def test_streaming_minima_equal_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 03:00:00", 2.0), (1, "2024-01-01 05:00:00", 1.0), (1, "2024-01-01 12:00:00", 0.0), (2, "2024-01-02 00:30:00", 4.0)]
    frame = spark.createDataFrame(rows, "node bigint, t string, value double").select("node", F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    frame.write.parquet(f"{tmp_path}/in")
    stream = streaming_minima(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("nights").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("nights").collect())) == sorted(map(tuple, streaming_minima(frame).collect()))
