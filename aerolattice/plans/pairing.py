"""Observations joined with weather, snapshots and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairing as J
from ..operators import tables as TB
from .adapters import adapter, duck


def asof_nearest_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").select("row_id", "station", "t")
    return J.asof_nearest(o, adapter(spark, d, "weather").select("station", "t", "temp", "sw"), "station", "t", ["temp", "sw"], 1200)


_NEAR = """c as (select o.row_id, o.station, o.t, w.t as match_time, abs(o.t - w.t) as gap, w.temp, w.sw, row_number() over (partition by o.row_id order by abs(o.t - w.t), w.t) as k
 from obs o left join {w} w on {on} and abs(o.t - w.t) <= 1200)"""
ASOF = f"{duck('obs', 'weather')}, {_NEAR.format(w='weather', on='o.station = w.station')} select row_id, station, t, match_time, gap, temp, sw from c where k = 1"


def asof_with_global(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").select("row_id", "station", "t")
    wx = adapter(spark, d, "weather").select(F.when(F.col("station").isin("S100", "S101", "S102"), "GLOBAL").otherwise(F.col("station")).alias("station"), "t", "temp", "sw")
    return J.asof_station_then_global(o, wx, "station", "t", ["temp", "sw"], 1200).select("row_id", "series", "match_time", "temp")


ASOF_GLOBAL = f"""{duck('obs', 'weather')}, g as (select case when station in ('S100', 'S101', 'S102') then 'GLOBAL' else station end as station, t, temp, sw from weather),
 u as (select station, t, min(row(temp, sw)) as v from g group by station, t), s as (select distinct station from u where station <> 'GLOBAL'),
 x as (select o.row_id, o.t, coalesce(s.station, 'GLOBAL') as series from obs o left join s on o.station = s.station),
 c as (select x.row_id, x.series, u.t as match_time, u.v[1] as temp, row_number() over (partition by x.row_id order by abs(x.t - u.t), u.t) as k from x left join u on x.series = u.station and abs(x.t - u.t) <= 1200)
 select row_id, series, match_time, temp from c where k = 1"""


def interp_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").select("row_id", "station", "t")
    wx = adapter(spark, d, "weather").filter("station <> 'S103'").select("station", "t", "temp", "rh")
    out = J.interp_at(o, wx, "station", "t", ["temp", "rh"])
    return out.select("row_id", F.round("temp", 8).alias("temp"), F.round("rh", 8).alias("rh"), "status")


INTERP = f"""{duck('obs', 'weather')}, w as (select station, t, temp, rh from weather where station <> 'S103'),
 a as (select o.row_id, max(w.t) as ta, arg_max(temp, w.t) as xa, arg_max(rh, w.t) as ra from obs o join w on o.station = w.station and w.t <= o.t group by o.row_id),
 b as (select o.row_id, min(w.t) as tb, arg_min(temp, w.t) as xb, arg_min(rh, w.t) as rb from obs o join w on o.station = w.station and w.t >= o.t group by o.row_id)
 select o.row_id, round(case when ta is null then xb when tb is null or ta = tb then xa else xa + (xb - xa) * ((o.t - ta) / (tb - ta)) end, 8) as temp,
  round(case when ta is null then rb when tb is null or ta = tb then ra else ra + (rb - ra) * ((o.t - ta) / (tb - ta)) end, 8) as rh, case when ta is null and tb is null then 'no_forecast_for_station' else 'ok' end as status
 from obs o left join a on o.row_id = a.row_id left join b on o.row_id = b.row_id"""


def best_snapshot_pair(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").groupBy("station", "t").agg(F.min("y").alias("y"))
    c = J.match_mode(J.pair_neighbours(o, adapter(spark, d, "snapshots").groupBy("location", "valid", "issue").agg(F.min("temp").alias("temp"))))
    return J.pick_best_pair(c).select("station", "t", "source", "used", "operational", "mode", "issue", F.round("age_h", 6).alias("age_h"), "temp")


BEST = f"""{duck('obs', 'snapshots')}, o as (select station, t, t - t % 3600 as valid, min(y) as y from obs group by station, t), n as (select location, valid, issue, min(temp) as temp from snapshots group by all),
 c as (select o.*, 'station' as source, issue, temp from o left join n on n.location = o.station and n.valid = o.valid union all select o.*, 'area', issue, temp from o left join n on n.location = 'AOI' and n.valid = o.valid),
 m as (select *, (t - issue) / 3600.0 as a from c), f as (select *, coalesce(a >= -0.1 and a <= 72, false) as operational, coalesce(abs(a) <= 72, false) as used from m),
 r as (select *, row_number() over (partition by station, t order by used desc, (source = 'station') desc, operational desc, abs(a) nulls last, issue desc nulls last) as k from f)
 select station, t, source, used, operational, case when operational then 'operational_forecast' when used then 'posthoc_hindcast_or_forecast' when issue is not null then 'stale_or_too_far' else 'no_weather_match' end as mode, issue, round(a, 6) as age_h, temp from r where k = 1"""


def nearest_station(spark: SparkSession, d: str) -> DataFrame:
    c = adapter(spark, d, "cells").select("cell", (1.33 + F.col("y") / 1e5).alias("lat"), (103.85 + F.col("x") / 1e5).alias("lon"))
    stations = adapter(spark, d, "nodes").filter("node <= 27").select(F.concat(F.lit("S"), F.col("node").cast("string")).alias("station"), (1.33 + F.col("ny") / 1e5).alias("slat"), (103.85 + F.col("nx") / 1e5).alias("slon"))
    return J.nearest_station(c, stations, "cell").withColumn("distance_m", F.round("distance_m", 3))


NEAREST = f"""{duck('cells', 'nodes')}, p as (select cell, 1.33 + y / 1e5 as la, 103.85 + x / 1e5 as lo from cells), s as (select 'S' || node as station, 1.33 + ny / 1e5 as sa, 103.85 + nx / 1e5 as so from nodes where node <= 27),
 h as (select cell, station, power(sin(radians(sa - la) / 2), 2) + cos(radians(la)) * cos(radians(sa)) * power(sin(radians(so - lo) / 2), 2) as a from p cross join s),
 k as (select *, row_number() over (partition by cell order by a, station) as k from h), m as (select cell, station, 2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)) as m from k where k = 1)
 select cell, station, round(m, 3) as distance_m, case when m <= 1000 then 'local' when m <= 3000 then 'nearby' else 'regional' end as distance_class from m"""


def outer_latest(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").filter("row_id % 3 <> 0").select("station", "t", "y")
    return J.outer_latest("station", "t", obs=o.groupBy("station", "t").agg(F.max("y").alias("y")), wx=adapter(spark, d, "weather").filter("station <> 'S105'").select("station", "t", "temp"))


OUTER = f"""{duck('obs', 'weather')}, o as (select station, max(t) as obs_t, arg_max(y, (t, y)) as obs_y from obs where row_id % 3 <> 0 group by station), w as (select station, max(t) as wx_t, arg_max(temp, t) as wx_temp from weather where station <> 'S105' group by station)
 select coalesce(o.station, w.station) as station, obs_t, obs_y, wx_t, wx_temp from o full join w on o.station = w.station"""


def enrich_and_prefer(spark: SparkSession, d: str) -> DataFrame:
    c = adapter(spark, d, "cells").select("cell", "svf", "shade")
    new = c.filter("cell % 3 = 0").select("cell", (F.col("svf") / 2).alias("svf"), F.lit("sim").alias("origin"))
    preferred = J.join_prefer_new(c, new, ["cell"])
    extra = J.enrich(preferred, adapter(spark, d, "cells").select("cell", "svf", "gvi"), ["cell"])
    replaced = TB.preserve_and_replace(extra.withColumnRenamed("svf", "svf_new").withColumn("svf", F.col("gvi") / 100), "svf", "svf_new", "svf_old")
    return replaced.select("cell", "shade", "origin", "gvi", F.round("svf", 6).alias("svf"), F.round("svf_old", 6).alias("svf_old"), "svf_source", F.round("svf_delta", 6).alias("svf_delta"))


ENRICH = f"""{duck('cells')} select cell, shade, case when cell % 3 = 0 then 'sim' end as origin, gvi, round(case when cell % 3 = 0 then svf / 2 else gvi / 100 end, 6) as svf, round(gvi / 100, 6) as svf_old,
 case when cell % 3 = 0 then 'new' else 'old' end as svf_source, round(case when cell % 3 = 0 then svf / 2 - gvi / 100 end, 6) as svf_delta from cells"""


def fallback_key_join(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").select("row_id", "station", (F.col("t") - F.pmod("t", F.lit(3600))).alias("h"))
    wx = adapter(spark, d, "weather").filter("station <> 'S104'").select("station", F.col("t").alias("h"), "temp")
    return J.fallback_key_join(o, wx, ["station", "h"], ["station"], ["temp"]).select("row_id", F.round("temp", 6).alias("temp"))


FALLBACK = f"""{duck('obs', 'weather')}, w as (select * from weather where station <> 'S104'), k as (select station, t as h, avg(temp) as x from w group by all), s as (select station, avg(temp) as x from w group by all)
 select row_id, round(coalesce(k.x, s.x, (select quantile_cont(temp, 0.5) from w)), 6) as temp from obs o left join k on k.station = o.station and k.h = o.t - o.t % 3600 left join s on s.station = o.station"""


def unmatched_hours(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").select("station", (F.col("t") - F.pmod("t", F.lit(3600))).alias("t")).distinct()
    wx = adapter(spark, d, "weather")
    return J.members(o, wx, ["station", "t"], inside=False).withColumn("known", F.lit(0)).unionByName(J.members(o, wx, ["station", "t"]).withColumn("known", F.lit(1)))


UNMATCHED = f"{duck('obs', 'weather')}, o as (select distinct station, t - t % 3600 as t from obs) select o.station, o.t, case when w.t is null then 0 else 1 end as known from o left join weather w on w.station = o.station and w.t = o.t"

QUERIES = {
    "asof_nearest_pairs": (asof_nearest_pairs, ASOF), "asof_with_global": (asof_with_global, ASOF_GLOBAL), "interp_pairs": (interp_pairs, INTERP), "best_snapshot_pair": (best_snapshot_pair, BEST), "nearest_station": (nearest_station, NEAREST),
    "outer_latest": (outer_latest, OUTER), "enrich_and_prefer": (enrich_and_prefer, ENRICH), "fallback_key_join": (fallback_key_join, FALLBACK), "unmatched_hours": (unmatched_hours, UNMATCHED),
}
