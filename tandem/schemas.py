"""Declared schemas of the entities that operators read and return."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(ddl)


URBAN_PANEL = "lon double, lat double, year int, urban_frac double, active_y tinyint"
WEATHER = "time_utc timestamp, lon double, lat double, temperature_2m double, dewpoint_temperature_2m double"
NODE_DAYS = "node bigint, day date, value double, year int"
EVENT_DAYS = "node bigint, day date, value double, year int, month int, doy int, thr_raw double, thr double, evt int, evt_run int"
COHERENT_EDGES = "a bigint, b bigint, n_eff bigint, n_a bigint, n_b bigint, obs bigint, lam double, p double, dist_km double"
RUNS = "node bigint, run_id bigint, start date, end date, duration bigint, intensity_mean double, intensity_max float, month int, dur_bin string, run_uid bigint"
MATCHES = "locked_uid bigint, control_uid bigint"
PAIRED_SUMMARY = "n_pairs bigint, mean_delta double, median_delta double, boot95_mean_lo double, boot95_mean_hi double, wilcoxon_p_greater double, wilcoxon_p_two_sided double"
