"""Building blocks of the queries' SQL: the same definitions as common table expressions, for an independent engine."""

from __future__ import annotations

LON = "((node * 37) % 360 - 180)::double"
LAT = "((node * 17) % 140 - 70)::double"

ND = """nd as (
    select s_nationkey::bigint as node, l_shipdate::date as day, round(sum(l_extendedprice * (1 - l_discount)), 4) as value,
           year(l_shipdate::date)::int as year, month(l_shipdate::date)::int as month, dayofyear(l_shipdate::date)::int as doy
    from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey, l_shipdate::date)"""

NODES = f"""nodes as (select n_nationkey::bigint as node, {LON.replace('node', 'n_nationkey')} as lon, {LAT.replace('node', 'n_nationkey')} as lat from nation)"""

BASE = (1996, 2000)


def warm(n: int, src: str = "nd") -> str:
    return f"""warm as (
    select node, month, mean_value, warm_rank from (
        select *, row_number() over (partition by node order by mean_value desc, month)::int as warm_rank
        from (select node, month, avg(value) as mean_value from {src} where year between {BASE[0]} and {BASE[1]} group by node, month))
    where warm_rank <= {n})"""


def events(name: str = "ev", kind: str = "hot", src: str = "nd", length: int = 2) -> str:
    """CTEs {name}_thr, {name}_sm, {name}_fl, {name}: thresholds, smoothed thresholds, flags and run flags."""
    q, cmp = (0.95, ">=") if kind == "hot" else (0.05, "<=")
    return f"""{name}_thr as (
    select node, doy, quantile_cont(value, {q}) as thr_raw from {src} where year between {BASE[0]} and {BASE[1]} group by node, doy),
{name}_sm as (
    select *, round(avg(thr_raw) over (partition by node order by doy rows between 7 preceding and 7 following) + 1e-9, 7) as thr from {name}_thr),
{name}_fl as (
    select {src}.*, thr_raw, thr, coalesce(value {cmp} thr, false)::int as evt from {src} left join {name}_sm using (node, doy)),
{name} as (
    select * exclude (grp), (evt = 1 and sum(evt) over (partition by node, grp order by day) >= {length})::int as evt_run
    from (select *, sum(1 - evt) over (partition by node order by day) as grp from {name}_fl))"""


def calendar_runs(src: str, out: str, length: int, flag: str = "evt") -> str:
    return f"""{out}_b as (
    select *, case when {flag} <> 1 or coalesce(day - lag(day) over (partition by node order by day), 0) <> 1 then 1 else 0 end as brk from {src}),
{out}_c as (select *, sum(brk) over (partition by node order by day) as cgrp from {out}_b),
{out} as (select * exclude (brk, cgrp), ({flag} = 1 and sum({flag}) over (partition by node, cgrp order by day) >= {length})::int as by_day from {out}_c)"""


def valid(src: str, out: str, least: int) -> str:
    return f"{out} as (select node, sum(evt_run)::bigint as n_events from {src} group by node having sum(evt_run) >= {least})"


def active(src: str, ok: str, out: str) -> str:
    return f"{out} as (select node, day, evt_run as evt from {src} where node in (select node from {ok}))"


def counts(a: str, b: str, out: str, k: int, same: bool) -> str:
    """CTEs {out}_o and {out}: overlap, observed and both joined."""
    cmp = "x.node < y.node" if same else "x.node <> y.node"
    return f"""{out}_n as (
    select x.node as a, y.node as b, count(*) as n_eff, sum(x.evt)::bigint as n_a, sum(y.evt)::bigint as n_b
    from {a} x join {b} y on x.day = y.day and {cmp} group by 1, 2),
{out}_o as (
    select a, b, count(distinct day_a) as obs from (
        select x.node as a, y.node as b, x.day as day_a, y.day as day_b from {a} x join {b} y
        on y.day between x.day - {k} and x.day + {k} and {cmp} where x.evt = 1 and y.evt = 1) c
    where exists (select 1 from {b} z where z.node = c.b and z.day = c.day_a)
      and exists (select 1 from {a} z where z.node = c.a and z.day = c.day_b)
    group by a, b),
{out} as (select n.*, coalesce(obs, 0) as obs from {out}_n n left join {out}_o using (a, b))"""


def scores(src: str, out: str, k: int, least: int) -> str:
    return f"""{out}_l as (
    select *, n_a::double * n_b * {2 * k + 1} / greatest(n_eff, 1) as lam from {src} where n_eff >= {least}),
{out} as (
    select *, case when obs <= 0 or lam <= 0 then 1.0
                   else least(1.0, greatest(0.0, 1 - list_sum(list_transform(range(0, obs), lambda i: exp(i * ln(lam) - lam - lgamma(i + 1)))))) end as p
    from {out}_l)"""


HAVERSINE = """2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)
    + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"""


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return HAVERSINE.format(lon1=lon1, lat1=lat1, lon2=lon2, lat2=lat2)


def edges(src: str, out: str, alpha: float) -> str:
    return f"""{out} as (
    select s.*, x.lon as lon1, x.lat as lat1, y.lon as lon2, y.lat as lat2, {haversine('x.lon', 'x.lat', 'y.lon', 'y.lat')} as dist_km
    from {src} s join nodes x on x.node = a join nodes y on y.node = b where p < {alpha})"""


def runs(src: str, out: str, least: int = 2) -> str:
    return f"""{out}_i as (
    select node, run_id, min(day) as start_day, max(day) as end_day, count(*) as duration,
           avg(excess) as intensity_mean, max(excess) as intensity_max
    from (select *, sum(brk) over (partition by node order by day) as run_id from (
        select node, day, value::float - thr::float as excess,
               case when day - lag(day) over (partition by node order by day) = 1 then 0 else 1 end as brk
        from {src} where evt_run = 1))
    group by node, run_id having count(*) >= {least}),
{out} as (
    select node, run_id::bigint as run_id, start_day, end_day, duration, intensity_mean, intensity_max, month(start_day)::int as month,
           case when duration = 2 then '2' when duration <= 4 then '3-4' else '5+' end as dur_bin,
           (row_number() over (order by node, run_id) - 1)::bigint as run_uid
    from {out}_i)"""


def sweep(runs_: str, other: str, out: str, k: int, both: bool) -> str:
    """CTEs up to {out}: run_uid of runs that the two-pointer sweep over the pairs of pr locks, state by state."""
    indexed = "select node, run_uid, (start_day - date '1970-01-01')::int as s, (end_day - date '1970-01-01')::int as e, row_number() over (partition by node order by start_day, run_uid) as k from {}"
    meet = f"x.s - {k} <= y.e + {k} and y.s - {k} <= x.e + {k}"
    second = f" union select y.run_uid from {out}_s join {out}_x x on x.node = a and x.k = i join {out}_y y on y.node = b and y.k = j where {meet}" if both else ""
    return f"""{out}_x as ({indexed.format(runs_)}),
{out}_y as ({indexed.format(other)}),
{out}_s(a, b, i, j) as (
    select a, b, 1::bigint, 1::bigint from pr
    union all
    select a, b, case when ({meet} and x.e <= y.e) or (not ({meet}) and x.s < y.s) then i + 1 else i end,
           case when ({meet} and x.e <= y.e) or (not ({meet}) and x.s < y.s) then j else j + 1 end
    from {out}_s join {out}_x x on x.node = a and x.k = i join {out}_y y on y.node = b and y.k = j),
{out} as (select x.run_uid from {out}_s join {out}_x x on x.node = a and x.k = i join {out}_y y on y.node = b and y.k = j where {meet}{second})"""


MATCHED = """mk as (
    select run_uid, node, month, case when duration = 1 then '1' else dur_bin end as bin, (start_day - date '1970-01-01')::int as s, intensity_mean,
           run_uid in (select run_uid from lk) as is_locked from r),
lo as (select *, row_number() over (partition by node, month, bin order by s, run_uid) as t from mk where is_locked),
ct as (select node, month, bin, list({'s': s, 'u': run_uid} order by s, run_uid) as free from mk where not is_locked group by 1, 2, 3),
mt(node, month, bin, t, free, locked_uid, control_uid) as (
    select node, month, bin, 0::bigint, free, null::bigint, null::bigint from ct
    union all
    select node, month, bin, t, list_filter(free, lambda x: x.u <> best.u), run_uid, best.u
    from (select m.node, m.month, m.bin, lo.t, m.free, lo.run_uid, list_sort(list_transform(m.free, lambda x: {'d': abs(x.s - lo.s), 's': x.s, 'u': x.u}))[1] as best
          from mt m join lo on lo.node = m.node and lo.month = m.month and lo.bin = m.bin and lo.t = m.t + 1 where len(m.free) > 0)),
dl as (
    select locked_uid, control_uid, a.bin as dur_bin, a.intensity_mean as locked_intensity_mean, b.intensity_mean as control_intensity_mean,
           a.intensity_mean - b.intensity_mean as delta
    from mt join mk a on a.run_uid = locked_uid join mk b on b.run_uid = control_uid)"""


def upper_tail(z: str) -> str:
    """P(Z >= z) of the normal distribution by Simpson's rule on [0, z]."""
    f = f"(case when i in (0, 1000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-pow(i * ({z}) / 1000, 2) / 2)"
    return f"(0.5 - ({z}) / 3000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 1001), lambda i: {f})))"


def signed_ranks(src: str, out: str) -> str:
    """CTEs up to {out}: n, w_plus and z of the non-zero delta in src."""
    return f"""{out}_k as (select abs(delta) as a, count(*) as t, count(*) filter (where delta > 0) as plus from {src} where delta <> 0 group by 1),
{out}_r as (select *, coalesce(sum(t) over (order by a rows between unbounded preceding and 1 preceding), 0) + (t + 1) / 2.0 as rank from {out}_k),
{out}_w as (select sum(t)::bigint as n, sum(plus * rank)::double as w_plus, sum(t * t * t - t)::double as ties from {out}_r),
{out} as (select n, w_plus, (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48) as z from {out}_w)"""


# The trigonometry of one turn of Vincenty's iteration, from u1, u2 (reduced latitudes), lam and wide (longitude difference).
_TURN = """select *, atan2(ss, cs) as sigma, case when ss > 0 then cos(u1) * cos(u2) * sin(lam) / ss else 0 end as sa
    from (select *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) as ss,
                 sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) as cs from {src})"""


def geodesic(src: str, out: str, turns: int = 60) -> str:
    """CTEs up to {out}: src (a, b, lon1, lat1, lon2, lat2) with km, the WGS84 geodesic of pairs that aren't nearly antipodal."""
    f = "(1 / 298.257223563)"
    middle = f"select *, case when 1 - sa * sa > 1e-15 then cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) else 0 end as cm, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) as c from ({{}})"
    step = middle.format(_TURN.format(src=f"{out}_i where turn < {turns}"))
    last = middle.format(_TURN.format(src=f"{out}_i where turn = {turns}"))
    return f"""{out}_u as (
    select *, atan((1 - {f}) * tan(radians(lat1))) as u1, atan((1 - {f}) * tan(radians(lat2))) as u2,
           radians(lon2 - lon1) - 2 * pi() * round((lon2 - lon1) / 360) as wide from {src}),
{out}_i(a, b, u1, u2, wide, lam, turn) as (
    select a, b, u1, u2, wide, wide, 0 from {out}_u
    union all
    select a, b, u1, u2, wide, wide + (1 - c) * {f} * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))), turn + 1 from ({step})),
{out}_k as (
    select *, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) as small, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) as big
    from (select *, (1 - sa * sa) * (1 / pow(1 - {f}, 2) - 1) as k from ({last}))),
{out} as (
    select a, b, 6378.137 * (1 - {f}) * big * (sigma - small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) as km
    from {out}_k)"""


def query(*ctes: str, select: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + select
