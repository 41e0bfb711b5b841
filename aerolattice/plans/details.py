"""Further forms of cell statistics, health reports, model ladders, heights, rings and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import thermal as T
from ..operators import aggregates as A
from ..operators import calibration as C
from ..operators import metrics as M
from ..operators import rings as RG
from .adapters import adapter, duck
from .calibration import R6, SKILL, O, _obs
from .geo import P, _pieces
from .ingest import _ringed
from .thermal import stull


def zonal_layers(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.zonal_layers(adapter(spark, d, "pixels"), 100.0, "height", "svf", 2.0))


ZONAL = f"""{duck('pixels')}, l as (select floor(x / 100)::bigint as cx, floor(y / 100)::bigint as cy, 'all' as layer, svf from pixels union all select floor(x / 100)::bigint, floor(y / 100)::bigint, case when height <= 0.5 then 'open' else 'building' end, svf from pixels)
 select cx, cy, layer, count(*) as pixels, round(count(*) / max(count(*)) over (partition by cx, cy), 6) as fraction, count(*) * 4.0::double as area_m2, round(avg(svf), 6) as mean, min(svf) as min, max(svf) as max, round(quantile_cont(svf, 0.1), 6) as p10, round(quantile_cont(svf, 0.5), 6) as p50,
 round(quantile_cont(svf, 0.9), 6) as p90 from l group by cx, cy, layer"""
_GROUPS = {"pedestrian_shelter": ["Manufacturer#1", "Manufacturer#2"], "transport_deck": ["Manufacturer#3", "Manufacturer#4"]}


def type_shares(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.type_shares(_pieces(spark, d), "zone", "type", "area", 40_000.0, _GROUPS, (0.1, 0.3)))


SHARES = f"""{P}, e as (select zone, type, sum(area) as a, least(1, sum(area) / 40000.0) as f from p group by zone, type), s as (select zone, least(1, sum(a) / 40000.0) as fraction, least(1, coalesce(sum(f) filter (type in ('Manufacturer#1', 'Manufacturer#2')), 0)) as ps,
  least(1, coalesce(sum(f) filter (type in ('Manufacturer#3', 'Manufacturer#4')), 0)) as td from e group by zone)
 select zone, round(fraction, 6) as fraction, round(ps, 6) as pedestrian_shelter_fraction, round(td, 6) as transport_deck_fraction, case when fraction < 0.1 then 'clean_or_minor' when fraction < 0.3 then 'moderate_confounding' else 'major_confounding' end as flag,
 case when ps >= 0.02 and td >= 0.02 then 'mixed' when ps >= 0.02 then 'pedestrian_shelter' when td >= 0.02 then 'transport_deck' else 'minor_or_none' end as interpretation from s"""


def completeness_total(spark: SparkSession, d: str) -> DataFrame:
    area = lambda test: F.when(test, F.col("area")).otherwise(F.lit(0.0))
    z = _pieces(spark, d).groupBy("zone").agg(F.sum(area(F.col("box") % 3 == 0)).alias("old"), F.sum(area(F.col("box") % 3 != 1)).alias("new"), F.sum("area").alias("ref"))
    return R6(A.completeness_total(z, "old", "new", "ref"))


COMPLETE = f"{P} select sum(area) filter (box % 3 = 0) as old_sum, sum(area) filter (box % 3 <> 1) as new_sum, sum(area) as ref_sum, round(sum(area) filter (box % 3 = 0) / sum(area), 6) as old_ratio, round(sum(area) filter (box % 3 <> 1) / sum(area), 6) as new_ratio from p"


def archive_by_day(spark: SparkSession, d: str) -> DataFrame:
    return A.archive_by_day(adapter(spark, d, "obs"), "station", "t", "y")


BY_DAY = f"{duck('obs')} select t // 86400 as day, count(*) as rows, count(distinct station) as stations, max(y) as max, count(*) filter (y >= 31) as ge_31, count(*) filter (y >= 33) as ge_33 from obs group by 1 order by 1 desc limit 7"


def station_coverage(spark: SparkSession, d: str) -> DataFrame:
    return A.station_coverage(adapter(spark, d, "obs"), "station", "t", 5)


COVERAGE = f"""{duck('obs')}, m as (select max(t) as n from obs), p as (select station, count(*) filter (t >= n - 86400) as c, max(n) - max(t) as lag from obs cross join m group by station)
 select count(*) filter (c > 0) as stations_seen, min(c) filter (c > 0) as least_rows, max(c) as most_rows, count(*) filter (c between 1 and 4) as near_silent, max(lag) as longest_lag_s from p"""


def ladder_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Bias models under three schemes of folds, with event metrics at two thresholds."""
    o = _obs(spark, d)
    schemes = {"loso": C.folds_loso(o, "station"), "blocks": C.folds_time_block(o, "day", 5), "groups": C.folds_group_k(o, "station", 5)}
    out = None
    for name, folds in schemes.items():
        part = C.model_ladder(C.oof_bias(folds.withColumn("fold", F.col("fold").cast("string")), "p", "y", "period"), ["m0", "m1"], "y").select(F.lit(name).alias("scheme"), "model", "prediction", "y")
        out = part if out is None else out.unionByName(part)
    return R6(M.ladder_metrics(out, "prediction", "y", [29, 31], ["scheme", "model"]).drop("p90_abs", "r2", "corr"))


_FOLDS = f"""{O}, dd as (select day, 'block_' || ntile(5) over (order by day) as fold from (select distinct day from b) x), s as (select station, row_number() over (order by count(*) desc, station) - 1 as k from b group by station),
 f as (select 'loso' as scheme, station as fold, y, p from b union all select 'blocks', dd.fold, y, p from b join dd on b.day = dd.day union all select 'groups', (case when k // 5 % 2 = 0 then k % 5 else 4 - k % 5 end)::varchar, y, p from b join s on b.station = s.station),
 g as (select scheme, fold, sum(y - p) as e, count(*) as n from f group by 1, 2), w as (select a.scheme, a.fold, sum(c.e) / sum(c.n) as m1 from g a join g c on c.scheme = a.scheme and c.fold <> a.fold group by 1, 2),
 l as (select scheme, 'm0' as model, p as x, y from f union all select f.scheme, 'm1', p + m1, y from f join w on w.scheme = f.scheme and w.fold = f.fold)"""
_EV = "count(*) filter (y >= {t} and x >= {t}) as ge_{t}_tp, count(*) filter (y < {t} and x >= {t}) as ge_{t}_fp, count(*) filter (y >= {t} and x < {t}) as ge_{t}_fn"
_RT = "ge_{t}_tp, ge_{t}_fp, ge_{t}_fn, round(ge_{t}_tp / nullif(ge_{t}_tp + ge_{t}_fp, 0), 6) as ge_{t}_precision, round(ge_{t}_tp / nullif(ge_{t}_tp + ge_{t}_fn, 0), 6) as ge_{t}_recall, round(2 * ge_{t}_tp / nullif(case when ge_{t}_tp > 0 then 2 * ge_{t}_tp + ge_{t}_fp + ge_{t}_fn end, 0), 6) as ge_{t}_f1"
LADDER = f"""{_FOLDS}, a as (select scheme, model, count(*) as n, round(avg(x - y), 6) as bias, round(avg(abs(x - y)), 6) as mae, round(sqrt(avg(power(x - y, 2))), 6) as rmse, {_EV.format(t=29)}, {_EV.format(t=31)} from l group by 1, 2)
 select scheme, model, n, bias, mae, rmse, {_RT.format(t=29)}, {_RT.format(t=31)} from a"""
_KS = {"k000": 0.0, "k045": 0.0045, "k065": 0.0065}


def _formulas(spark: SparkSession, d: str) -> DataFrame:
    wx = adapter(spark, d, "weather").withColumn("y", F.col("temp") * 0.9 + F.col("sw") * 0.002)
    return wx.select("y", *(F.round(T.wbgt_weather_only(*(F.col(c) for c in ("temp", "rh", "wind", "sw")), k=v), 8).alias(n) for n, v in _KS.items()))


_WIDE = f"{duck('weather')}, v as (select temp * 0.9 + sw * 0.002 as y, " + ", ".join(f"round(0.7 * {stull('temp', 'rh')} + 0.2 * (temp + {k} * sw / sqrt(greatest(wind, 0.1) + 0.25)) + 0.1 * temp, 8) as {n}" for n, k in _KS.items()) + " from weather)"


def formula_flips(spark: SparkSession, d: str) -> DataFrame:
    return M.event_flips(_formulas(spark, d), "k045", ["k000", "k065"], "y", [27.0, 29.0])


FLIPS = _WIDE + " " + " union all ".join(f"select '{n}' as variant, {t}::double as threshold, count(*) as n, count(*) filter ({n} >= {t} and k045 < {t}) as up, count(*) filter ({n} < {t} and k045 >= {t}) as down, count(*) filter (({n} >= {t}) = (k045 >= {t})) as same from v" for n in ("k000", "k065") for t in (27, 29))


def bias_corrected(spark: SparkSession, d: str) -> DataFrame:
    out = M.bias_corrected_confusion(C.model_ladder(_formulas(spark, d), list(_KS), "y"), "model", "prediction", "y", [27.0, 29.0])
    return R6(out, "bias", "precision", "recall", "specificity", "f1", "balanced")


CORRECTED = f"""{_WIDE}, l as ({' union all '.join(f"select '{n}' as model, {n} as p, y from v" for n in _KS)}), m as (select model, avg(p - y) as bias from l group by 1), c as (select l.model, bias, p - bias as s, y, th from l join m using (model), unnest([27::double, 29]) t(th)),
 g as (select model, bias, th as threshold, count(*) filter (y >= th and s >= th) as tp, count(*) filter (y < th and s >= th) as fp, count(*) filter (y >= th and s < th) as fn, count(*) filter (y < th and s < th) as tn from c group by 1, 2, 3),
 r as (select *, tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as r, tn / nullif(tn + fp, 0) as sp from g)
 select model, round(bias, 6) as bias, threshold, tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, round(sp, 6) as specificity, round(2 * p * r / nullif(p + r, 0), 6) as f1, round((r + sp) / 2, 6) as balanced from r"""


def reviewed_heights(spark: SparkSession, d: str) -> DataFrame:
    b = adapter(spark, d, "boxes").select("box", F.when(F.col("box") % 5 == 0, F.col("size").cast("double")).alias("explicit"), F.when(F.col("box") % 5 == 1, F.col("size") / 2.0).alias("levels"), F.when(F.col("box") % 5 == 2, "Bus Shelter").when(F.col("box") % 5 == 3, "Hotel").alias("kind"), (F.pow(10 + F.col("size"), 2)).alias("area"), F.when(F.col("box") % 7 == 0, 250.0).when(F.col("box") % 7 == 1, -1.0).alias("manual"))
    args = [F.col("explicit"), F.col("levels"), F.lit(None).cast("string"), F.col("kind"), F.col("area")]
    return b.select("box", *(v.alias(k) for k, v in S.reviewed_height(S.assigned_height(*args), F.col("manual")).items()), S.height_warning(*args).alias("height_warning"))


HEIGHTS = f"""{duck('boxes')}, b as (select box, box % 5 as k, size, power(10 + size, 2) as area, box % 7 = 0 as given from boxes), h as (select *, case when k = 0 and size between 2 and 180 then 'explicit' when k = 1 and size / 2.0 between 1 and 60 then 'levels_x_3m' when k = 2 then 'type_default_shelter' when k = 3 then 'lu_default:HOTEL'
  when area < 50 then 'area_default:unknown_small' when area > 1000 then 'area_default:unknown_large' else 'area_default:unknown_normal' end as src from b)
 select box, case when given then 180 else least(180, greatest(3, case src when 'explicit' then size when 'levels_x_3m' then size / 2.0 * 3 when 'type_default_shelter' then 4 when 'lu_default:HOTEL' then 30 when 'area_default:unknown_small' then 5 when 'area_default:unknown_large' then 12 else 10 end)) end::double as height_m,
 case when given then 'manual' else src end as height_source, case when given then 'high' when src in ('explicit', 'levels_x_3m') then 'medium_high' when src = 'type_default_shelter' then 'medium_low' when src = 'lu_default:HOTEL' then 'medium' else 'low' end as height_confidence,
 case when src = 'type_default_shelter' then 'possible_shelter_not_ground_up_building' when src = 'area_default:unknown_large' then 'manual_review_large_unknown_height' else '' end as height_warning from h"""


def ring_shapes(spark: SparkSession, d: str) -> DataFrame:
    r = _ringed(spark, d)
    c = S.ring_centroid(F.col("ring"))
    return r.select("box", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), F.round(S.line_area(F.slice("ring", 1, 3), F.lit(4.0)), 6).alias("line_area"))


SHAPES = f"{duck('boxes')} select box, round((x_min + x_max) / 2, 6) as cx, round((y_min + y_max) / 2, 6) as cy, (2.0 * (10 + size) * 4)::double as line_area from boxes"


def hls_view(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the masks of each image, with a confidence label."""
    p = adapter(spark, d, "pixels").select(F.pmod(F.floor(F.col("x") / 50), F.lit(12)).alias("image"), F.pmod(F.col("x") * 7, F.lit(256)).alias("r"), F.pmod(F.col("y") * 5, F.lit(256)).alias("g"), F.pmod(F.col("x") + F.col("y"), F.lit(256)).alias("b"))
    m = p.withColumns(S.hls_masks(F.col("r"), F.col("g"), F.col("b"))).groupBy("image").agg(F.count("*").alias("pixels"), *((100.0 * F.sum(c) / F.count("*")).alias(c) for c in ("hls_green", "high_vis", "hls_strong")))
    return R6(m.withColumn("confidence", S.mask_confidence(F.col("hls_green") - F.col("hls_strong"), F.col("high_vis"))))


_LIN = lambda c: f"case when {c} / 255 <= 0.04045 then {c} / 255 / 12.92 else power(({c} / 255 + 0.055) / 1.055, 2.4) end"
_ROOT = lambda c: f"case when {c} > 0.008856 then power({c}, 1.0 / 3) else 7.787 * {c} + 16.0 / 116 end"
HLS = f"""{duck('pixels')}, p as (select floor(x / 50)::bigint % 12 as image, x * 7 % 256 as r, y * 5 % 256 as g, (x + y) % 256 as b from pixels), t as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from p),
 c as (select *, case when hi = lo then 0 else (60 * case when hi = r then (g - b) / (hi - lo) when hi = g then 2 + (b - r) / (hi - lo) else 4 + (r - g) / (hi - lo) end + 360) % 360 end as hue, (hi + lo) / 5.1 as li, case when hi = lo then 0 else 100 * case when hi + lo <= 255 then (hi - lo) / (hi + lo) else (hi - lo) / (510 - hi - lo) end end as sa, hi / 2.55 as va, (2.0 * g - r - b) / (r + g + b + 1.0) as ex from t),
 w as (select *, {_LIN('r')} as lr, {_LIN('g')} as lg, {_LIN('b')} as lb from c), x as (select *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 as cx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb as cy from w),
 z as (select *, -round(500 * ({_ROOT('cx')} - {_ROOT('cy')})) as lab from x),
 v as (select *, hue between 46 and 109 and sa >= 10 and li between 0 and 95 as green, hue between 45 and 105 and sa >= 42 and li >= 45 and (ex >= 0.075 or (sa >= 68 and li >= 55) or (sa >= 75 and va >= 70)) as vivid from z),
 m as (select image, count(*) as pixels, 100.0 * count(*) filter (green) / count(*) as hls_green, 100.0 * count(*) filter (vivid) / count(*) as high_vis, 100.0 * count(*) filter (green and not vivid and (ex >= 0.026 or lab >= 3 or (g >= r * 1.03 and g >= b * 1.03))) / count(*) as hls_strong from v group by image)
 select image, pixels, round(hls_green, 6) as hls_green, round(high_vis, 6) as high_vis, round(hls_strong, 6) as hls_strong, case when hls_green - hls_strong > 38 or high_vis > 26 then 'low' when hls_green - hls_strong > 22 or high_vis > 14 then 'medium' else 'high' end as confidence from m"""

def nearest_large_park(spark: SparkSession, d: str) -> DataFrame:
    """The nearest large box of each cell's centre, however far."""
    p = adapter(spark, d, "cells").select("cell", (F.col("x") + 50).alias("px"), (F.col("y") + 50).alias("py"))
    out = RG.nearest_polygon_anywhere(p, _ringed(spark, d), "cell", "box", 200.0, 2500.0)
    return out.withColumn("distance", F.round("distance", 6))


LARGE_PARK = f"""{duck('cells', 'boxes')}, j as (select cell, box, sqrt(power(greatest(x_min - x - 50, 0, x + 50 - x_max), 2) + power(greatest(y_min - y - 50, 0, y + 50 - y_max), 2)) as d from cells join boxes on power(10 + size, 2) >= 2500),
 k as (select *, row_number() over (partition by cell order by d, box) as k from j) select cell, round(d, 6) as distance, box from k where k = 1"""

QUERIES = {
    "zonal_layers": (zonal_layers, ZONAL), "type_shares": (type_shares, SHARES), "completeness_total": (completeness_total, COMPLETE), "archive_by_day": (archive_by_day, BY_DAY), "station_coverage": (station_coverage, COVERAGE), "ladder_metrics": (ladder_metrics, LADDER),
    "formula_flips": (formula_flips, FLIPS), "bias_corrected": (bias_corrected, CORRECTED), "reviewed_heights": (reviewed_heights, HEIGHTS), "ring_shapes": (ring_shapes, SHAPES), "hls_view": (hls_view, HLS), "nearest_large_park": (nearest_large_park, LARGE_PARK),
}
