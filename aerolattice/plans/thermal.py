"""Thermal indices, hotspots and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import thermal as T
from ..operators import aggregates as A
from ..operators import cellhours as H
from ..operators import pairing as J
from ..operators import ranking as R
from .adapters import adapter, duck

STULL = "({t} * atan(0.151977 * sqrt({rh} + 8.313659)) + atan({t} + {rh}) - atan({rh} - 1.676331) + 0.00391838 * power({rh}, 1.5) * atan(0.023101 * {rh}) - 4.686035)"


def stull(t: str, rh: str) -> str:
    return STULL.format(t=t, rh=rh)


def thermal_indices(spark: SparkSession, d: str) -> DataFrame:
    w = adapter(spark, d, "weather")
    t, rh, wind, sw = (F.col(c) for c in ("temp", "rh", "wind", "sw"))
    weather = T.wbgt_weather_only(t, rh, wind, sw)
    return w.select(
        "station", "t", F.round(T.stull_wet_bulb(t, rh), 6).alias("wet_bulb"), F.round(weather, 6).alias("wbgt_weather"), F.round(T.wbgt_shaded(t, rh), 6).alias("wbgt_shaded"),
        F.round(T.wbgt_radiative(t, rh, sw, wind), 6).alias("wbgt_radiative"), F.round(T.utci_proxy(t, t + 5, wind, rh), 6).alias("utci"), T.wbgt_class(F.round(weather, 6)).alias("wbgt_class"),
        F.round(T.radiation_fraction(F.col("direct"), sw), 6).alias("direct_fraction"), F.round(S.unit_to_ms(wind, F.lit("knots")), 6).alias("wind_from_knots"),
    )


THERMAL_SQL = f"""{duck("weather")} select station, t, round({stull('temp', 'rh')}, 6) as wet_bulb,
 round(0.7 * {stull('temp', 'rh')} + 0.2 * (temp + 0.0045 * sw / sqrt(greatest(wind, 0.1) + 0.25)) + 0.1 * temp, 6) as wbgt_weather,
 round(0.567 * temp + 0.393 * (rh / 100 * 6.105 * exp(17.27 * temp / (237.7 + temp))) + 3.94, 6) as wbgt_shaded,
 round(0.7 * {stull('temp', 'rh')} + 0.3 * temp + 0.002 * sw - 0.1 * wind, 6) as wbgt_radiative,
 round(temp + 0.46 * 5 + 0.055 * (rh - 50) - 1.15 * ln(1 + wind), 6) as utci,
 case when wbgt_weather < 31 then 'low' when wbgt_weather < 33 then 'moderate' else 'high' end as wbgt_class,
 round(case when sw > 1 then least(direct / sw, 1) else 0 end, 6) as direct_fraction, round(wind * 0.514444, 6) as wind_from_knots from weather"""


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    return adapter(spark, d, "weather").groupBy("t").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("temp", "rh", "wind", "sw")))


def _local(rows: DataFrame) -> DataFrame:
    parts = T.local_microclimate(*(F.col(c) for c in ("temp", "wind", "sw", "gvi", "park", "density", "road", "svf", "shade")))
    local = rows.select("t", "cell", "rh", "elderly", "outdoor", *(parts[k].alias(k) for k in ("tair_local_c", "wind_local_ms", "tmrt_proxy_c")))
    x = [F.col(c) for c in ("tair_local_c", "tmrt_proxy_c", "wind_local_ms", "rh")]
    return local.select("t", "cell", "elderly", "outdoor", F.round(T.utci_proxy(*x), 6).alias("utci_c"), F.round(T.wbgt_screening(*x), 6).alias("wbgt_c"))


CELL_HOURS = f"""{duck("weather", "cells")}, hourly as (select t, round(avg(temp), 6) as temp, round(avg(rh), 6) as rh, round(avg(wind), 6) as wind, round(avg(sw), 6) as sw from weather group by t),
 l1 as (select *, temp + 1.15 * density + 0.85 * road - 0.75 * least(gvi / 60.0, 1) - 0.35 * exp(-park / 250.0) as ta, wind * (0.35 + 0.75 * svf) * (1.0 - 0.35 * density) as slow from hourly cross join cells),
 l2 as (select *, least(greatest(slow, 0.15), greatest(wind, 0.15)) as wl, ta + 22.0 * least(sw / 900.0, 1) * (1 - shade) * (0.45 + 0.75 * svf) + 0.4 * (1 - svf) * greatest(ta - 26.0, 0) - 1.2 * least(gvi / 60.0, 1) as tr from l1),
 ch as (select t, cell, elderly, outdoor, round(ta + 0.46 * (tr - ta) + 0.055 * (rh - 50) - 1.15 * ln(1 + wl), 6) as utci_c,
  round(0.7 * {stull('ta', 'rh')} + 0.2 * (ta + 0.32 * (tr - ta) - 0.55 * ln(1 + wl)) + 0.1 * ta, 6) as wbgt_c from l2)"""


def hotspot_ranking(spark: SparkSession, d: str) -> DataFrame:
    agg = H.hotspot_agg(_hourly(spark, d), adapter(spark, d, "cells"), ["elderly", "outdoor"], lambda hours, cells: _local(J.expand_over_grid(hours, cells)))
    agg = agg.withColumns({c: F.round(c, 6) for c in ("mean_utci_c", "p90_utci_c", "mean_wbgt_c", "p90_wbgt_c")})
    out = R.hazard_scores(agg, "elderly", "outdoor")
    return out.select("cell", "rank", *(F.round(c, 6).alias(c) for c in ("hazard_score", "vulnerability_score", "exposure_score", "risk_priority_score", "max_utci_c", "mean_utci_c", "p90_wbgt_c")), "strong_utci_hours", "moderate_wbgt_hours", "forecast_hours", T.utci_class(F.col("max_utci_c")).alias("peak_utci_class"))


def _pr(c: str) -> str:
    return f"((rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0) / count(*) over ())"


HOTSPOT_SQL = f"""{CELL_HOURS}, a as (select cell, max(utci_c) as mu, round(avg(utci_c), 6) as au, round(quantile_cont(utci_c, 0.9), 6) as pu, max(wbgt_c) as mw, round(quantile_cont(wbgt_c, 0.9), 6) as pw,
  count(*) filter (utci_c >= 32) as su, count(*) filter (wbgt_c >= 31) as gm, count(*) filter (wbgt_c >= 33) as gh, max(elderly) as e, max(outdoor) as o, count(*) as n from ch group by cell),
 s as (select *, {_pr('mw')} as rw, 0.5 * {_pr('mu')} + 0.3 * {_pr('pu')} + 0.2 * {_pr('au')} as ru, {_pr('e')} as v, {_pr('o')} as x from a),
 h as (select *, 0.30 * rw + 0.25 * ru + 0.15 * greatest(0, least(1, (mu - 26) / 20.0)) + 0.10 * greatest(0, least(1, (mw - 27) / 8.0)) + 0.10 * (su / n) + 0.06 * least(1, gm / 18.0) + 0.04 * least(1, gh / 6.0) as hz from s),
 r as (select *, 0.62 * hz + 0.23 * v + 0.15 * x as rs from h)
 select cell, row_number() over (order by round(rs, 9) desc, round(hz, 9) desc, mu desc, cell) as rank, round(hz, 6) as hazard_score, round(v, 6) as vulnerability_score, round(x, 6) as exposure_score, round(rs, 6) as risk_priority_score,
  round(mu, 6) as max_utci_c, round(au, 6) as mean_utci_c, round(pw, 6) as p90_wbgt_c, su as strong_utci_hours, gm as moderate_wbgt_hours, n as forecast_hours,
  case when mu < 26 then 'no heat stress' when mu < 32 then 'moderate heat stress' when mu < 38 then 'strong heat stress' when mu < 46 then 'very strong heat stress' else 'extreme heat stress' end as peak_utci_class from r"""


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = H.event_windows(_hourly(spark, d), adapter(spark, d, "cells"))
    w = T.wbgt_alert(F.col("cells_high"), F.col("cells_moderate_or_high"), F.col("max_wbgt_c"), F.col("cell_count"))
    u = T.utci_alert(*(F.col(c) for c in ("cells_extreme_utci", "cells_very_strong_utci", "cells_strong_utci", "cells_moderate_utci", "max_utci_c", "cell_count")))
    out = e.withColumns({"wbgt_alert": w, "utci_alert": u}).withColumn("combined_alert", T.combined_alert(F.col("wbgt_alert"), F.col("utci_alert")))
    return out.withColumns({c: F.round(c, 8) for c in ("p90_wbgt_c", "p90_utci_c")}).select("t", "cell_count", "max_wbgt_c", "max_utci_c", *(c for c in out.columns if c.startswith("cells_")), "p90_wbgt_c", "p90_utci_c", "wbgt_alert", "utci_alert", "combined_alert")


EVENTS_SQL = f"""{CELL_HOURS}, e as (select t, count(distinct cell) as cell_count, max(wbgt_c) as max_wbgt_c, round(quantile_cont(wbgt_c, 0.9), 8) as p90_wbgt_c, max(utci_c) as max_utci_c, round(quantile_cont(utci_c, 0.9), 8) as p90_utci_c,
  count(*) filter (wbgt_c >= 31) as cells_moderate_or_high, count(*) filter (wbgt_c >= 33) as cells_high, count(*) filter (utci_c >= 26) as cells_moderate_utci, count(*) filter (utci_c >= 32) as cells_strong_utci,
  count(*) filter (utci_c >= 38) as cells_very_strong_utci, count(*) filter (utci_c >= 46) as cells_extreme_utci from ch group by t),
 a as (select *, case when cells_high > 0 or max_wbgt_c >= 33 then 'high' when cells_moderate_or_high >= greatest(1, ceil(0.1 * cell_count)) or max_wbgt_c >= 31 then 'moderate' else 'low' end as wbgt_alert,
  case when max_utci_c >= 46 then 'extreme' when max_utci_c >= 38 then 'very_strong' when max_utci_c >= 32 then 'strong' when max_utci_c >= 26 then 'moderate' else 'low' end as utci_alert from e)
 select *, case when wbgt_alert = 'high' or utci_alert in ('very_strong', 'extreme') then 'high' when wbgt_alert = 'moderate' or utci_alert = 'strong' then 'elevated' when utci_alert = 'moderate' then 'watch' else 'low' end as combined_alert from a"""


def time_features(spark: SparkSession, d: str) -> DataFrame:
    f = S.time_features(F.col("t"))
    return adapter(spark, d, "obs").select("row_id", *(F.round(v, 6).alias(k) if k.startswith("hour") else v.alias(k) for k, v in f.items()), S.period(S.hour_fraction(F.col("t")), S.DAY_NIGHT).alias("day_night"), S.round_half_even(F.col("t"), 900).alias("t15"))


TIME_SQL = f"""{duck("obs")}, h as (select row_id, t, t % 86400 // 3600 + (t % 3600 // 60) / 60.0 as h from obs)
 select row_id, round(h, 6) as hour_num, round(sin(2 * pi() * h / 24), 6) as hour_sin, round(cos(2 * pi() * h / 24), 6) as hour_cos, (h >= 7 and h < 19)::int as is_daytime, (h >= 12 and h < 16)::int as is_peak, (h < 7 or h >= 19)::int as is_night,
  case when h >= 7 and h < 12 then 'morning' when h >= 12 and h < 16 then 'peak' when h >= 16 and h < 19 then 'shoulder' else 'night' end as period,
  case when h >= 11 and h < 16 then 'peak' when h >= 7 and h < 19 then 'daytime' else 'nighttime' end as day_night,
  (round_even(t / 900.0, 0) * 900)::bigint as t15 from h"""


def cell_scalars(spark: SparkSession, d: str) -> DataFrame:
    c = adapter(spark, d, "cells")
    height = S.assigned_height(F.when(F.col("cell") % 5 == 0, F.col("gvi")), F.when(F.col("cell") % 7 == 0, F.lit(4.0)), F.col("land_use"), F.lit("x"), F.col("park"))
    return c.select("cell", S.simplify_land_use(F.col("land_use")).alias("land_class"), *(v.alias(k) for k, v in height.items()), F.round(S.overhead_shade(F.col("shade"), F.col("density"), F.col("road")), 6).alias("over_shade"), F.round(S.haversine_m(1.33 + F.col("y") / 1e5, 103.85 + F.col("x") / 1e5, F.lit(1.335), F.lit(103.855)), 3).alias("to_centre_m"), S.norm_name(F.concat_ws("-", "land_use", "cell")).alias("name"))


CELL_SCALARS_SQL = f"""{duck("cells")}, k as (select *, case when cell % 5 = 0 and gvi between 2 and 180 then gvi end as e, case when cell % 7 = 0 then 12.0 end as l, upper(land_use) || ' X' as u, 1.33 + y / 1e5 as la, 103.85 + x / 1e5 as lo from cells)
 select cell, case when u like '%HOUSEHOLD%' then 'other' when u like '%HOUSING%' then 'residential' else 'other' end as land_class,
  greatest(3.0, coalesce(e, l, case when park < 50 then 5.0 when park > 1000 then 12.0 else 10.0 end))::double as height_m,
  case when e is not null then 'explicit' when l is not null then 'levels_x_3m' when park < 50 then 'area_default:unknown_small' when park > 1000 then 'area_default:unknown_large' else 'area_default:unknown_normal' end as height_source,
  case when e is not null or l is not null then 'medium_high' else 'low' end as height_confidence,
  round(1 - (1 - shade) * (1 - least(1, density / least(1, greatest(0.01, road)))), 6) as over_shade,
  round(2 * 6371000.0 * atan2(sqrt(power(sin(radians(1.335 - la) / 2), 2) + cos(radians(la)) * cos(radians(1.335)) * power(sin(radians(103.855 - lo) / 2), 2)),
    sqrt(1 - (power(sin(radians(1.335 - la) / 2), 2) + cos(radians(la)) * cos(radians(1.335)) * power(sin(radians(103.855 - lo) / 2), 2)))), 3) as to_centre_m,
  trim(regexp_replace(upper(land_use || '-' || cell), '[^A-Z0-9]+', ' ', 'g')) as name from k"""

def morphology_proxies(spark: SparkSession, d: str) -> DataFrame:
    c = adapter(spark, d, "cells").withColumn("lu", F.element_at(F.array(*(F.lit(x) for x in ("commercial", "residential", "park_open_space", "transport"))), (F.col("cell") % 4 + 1).cast("int")))
    tree, height = S.canopy_proxy(F.col("park"), F.col("lu")), S.height_proxy(F.col("density"), F.col("lu"))
    green = S.greenery_fraction(tree, F.col("shade"), F.col("svf"))
    parts = S.morphology_proxy(F.col("density"), height, F.col("road"), tree) | {"tree": tree, "height": height, "green": green, "impervious": S.impervious_fraction(F.col("density"), F.col("road"), F.col("elderly"), green, F.col("outdoor"))}
    return c.select("cell", *(F.round(v, 6).alias(k) for k, v in parts.items()))


MORPHOLOGY_SQL = f"""{duck("cells")}, k as (select *, case cell % 4 when 0 then 'commercial' when 1 then 'residential' when 2 then 'park_open_space' else 'transport' end as lu from cells),
 t as (select *, least(0.75, greatest(0.02, 0.05 + 0.35 * exp(-park / 300.0) + case lu when 'park_open_space' then 0.25 when 'residential' then 0.05 else 0 end)) as tree,
  case when lu = 'park_open_space' then 2.0 else least(55, greatest(2, 4 + 42 * density + case lu when 'commercial' then 8 when 'residential' then 4 else 0 end)) end as height from k),
 g as (select *, least(1, greatest(tree, 0.55 * shade, 0.45 * least(1, greatest(0, (svf - 0.12) / 0.6)))) as green from t)
 select cell, round(least(0.98, greatest(0.18, 1.0 / (1.0 + 0.55 * height / 100 + 1.8 * density) + 0.1 * road)), 6) as svf,
  round(least(0.9, greatest(0.04, 0.08 + 0.55 * density + 0.28 * least(1, height / 40.0) + 0.25 * tree - 0.15 * road)), 6) as shade_fraction, round(tree, 6) as tree, round(height, 6) as height, round(green, 6) as green,
  round(least(1, greatest(0, 0.5 * least(1, density + road) + 0.5 * elderly - 0.35 * green - 0.75 * outdoor)), 6) as impervious from g"""

QUERIES = {"morphology_proxies": (morphology_proxies, MORPHOLOGY_SQL), "thermal_indices": (thermal_indices, THERMAL_SQL), "hotspot_ranking": (hotspot_ranking, HOTSPOT_SQL), "event_windows": (event_windows, EVENTS_SQL), "time_features": (time_features, TIME_SQL), "cell_scalars": (cell_scalars, CELL_SCALARS_SQL)}
