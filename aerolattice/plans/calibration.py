"""Skill, thresholds, and calibration under left-out folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import thermal as T
from ..operators import calibration as C
from ..operators import metrics as M
from .adapters import adapter, duck
from .thermal import stull


def R6(df: DataFrame, *skip: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, k in df.dtypes if k == "double" and c not in skip})


def _obs(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs")
    return o.withColumns({"h": S.hour_fraction(F.col("t")), "day": S.day(F.col("t"))}).withColumn("period", S.period(F.col("h")))


O = f"""{duck('obs')}, o as (select *, t % 86400 // 3600 + (t % 3600 // 60) / 60.0 as h, t // 86400 as day from obs),
 b as (select *, case when h >= 7 and h < 12 then 'morning' when h >= 12 and h < 16 then 'peak' when h >= 16 and h < 19 then 'shoulder' else 'night' end as period from o)"""
SKILL = "count(*) as n, round(avg(p - y), 6) as bias, round(avg(abs(p - y)), 6) as mae, round(sqrt(avg((p - y) * (p - y))), 6) as rmse, round(quantile_cont(abs(p - y), 0.9), 6) as p90_abs, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) as r2, round(case when count(*) > 2 then corr(p, y) end, 6) as corr"


def skill_by_station(spark: SparkSession, d: str) -> DataFrame:
    return R6(M.skill(_obs(spark, d), "p", "y", ["station"]))


def skill_by_period(spark: SparkSession, d: str) -> DataFrame:
    return R6(M.skill_by_overlapping_periods(_obs(spark, d), "p", "y", "h"))


BY_PERIOD = f"""{O}, e as (select 'overall' as period, p, y from b union all select case when h >= 7 and h < 19 then 'daytime' else 'night' end, p, y from b union all select 'peak', p, y from b where h >= 12 and h < 16) select period, {SKILL} from e group by period"""
RATES = """round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(tn / nullif(tn + fp, 0), 6) as specificity,
 round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) as f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) as balanced"""


def confusion_31(spark: SparkSession, d: str) -> DataFrame:
    return R6(M.confusion(_obs(spark, d), "y", "p", 31, 30.5, ["kind"]))


CONFUSION = f"{O}, c as (select kind, count(*) filter (y >= 31 and p >= 30.5) as tp, count(*) filter (y < 31 and p >= 30.5) as fp, count(*) filter (y >= 31 and p < 30.5) as fn, count(*) filter (y < 31 and p < 30.5) as tn from b group by kind) select *, {RATES} from c"


def threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    return R6(M.threshold_scan(_obs(spark, d), "y", "p", 31, 2700, 3400, 5, ["kind"]))


_SCAN = "g as (select kind, th as threshold from (select distinct kind from b) k, unnest(range(2700, 3401, 5)) as t(th)), c as (select g.kind, threshold, count(*) filter (y >= 31 and p * 100 >= threshold - 1e-6) as tp, count(*) filter (y < 31 and p * 100 >= threshold - 1e-6) as fp, count(*) filter (y >= 31 and p * 100 < threshold - 1e-6) as fn, count(*) filter (y < 31 and p * 100 < threshold - 1e-6) as tn from g join b on g.kind = b.kind group by g.kind, threshold)"
SCAN = f"{O}, {_SCAN} select *, {RATES} from c"


def operating_points(spark: SparkSession, d: str) -> DataFrame:
    return M.operating_points(threshold_scan(spark, d), 3100, ["kind"])


_PICK = "select kind, '{n}' as point, arg_max(row(threshold, precision, recall, f1, tp, fp, fn), ({s}, -threshold)) filter ({w}) as v from s group by kind"
POINTS = f"""{O}, {_SCAN}, s as (select *, {RATES} from c), u as ({_PICK.format(n='fixed', s='-abs(threshold - 3100)', w='true')} union all {_PICK.format(n='best_f1', s='f1', w='f1 is not null')}
 union all {_PICK.format(n='recall_90', s='precision', w='recall >= 0.9 and precision is not null')} union all {_PICK.format(n='precision_70', s='recall', w='precision >= 0.7 and recall is not null')})
 select kind, point, v is not null as available, v[1] as threshold, v[2] as precision, v[3] as recall, v[4] as f1, v[5] as tp, v[6] as fp, v[7] as fn from u"""


def residual_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return R6(M.residual_by_hour(_obs(spark, d).withColumn("hour", S.hour(F.col("t"))), "p", "y", "hour"))


BY_HOUR = f"{O} select (t % 86400 // 3600)::int as hour, count(*) as n, round(avg(y - p), 6) as mean, round(quantile_cont(y - p, 0.5), 6) as median, round(quantile_cont(abs(y - p), 0.9), 6) as p90_abs from b group by hour"


def grouped_bias(spark: SparkSession, d: str) -> DataFrame:
    return R6(M.grouped_bias(_obs(spark, d), ["p", "p2"], "y", ["station"]))


GROUPED = f"{O}, l as (select station, 'p' as variant, p as x, y from b union all select station, 'p2', p2, y from b) select station, variant, count(*) as n, round(avg(x - y), 6) as bias, round(avg(abs(x - y)), 6) as mae from l group by station, variant"


def fit_linear(spark: SparkSession, d: str) -> DataFrame:
    return R6(C.slope_diagnostics(C.fit_linear(_obs(spark, d), "p", "y", ["station"])))


FIT = f"""{O}, f as (select station, count(*) as n, regr_slope(y, p) as slope, regr_intercept(y, p) as intercept, sqrt(avg((y - p) * (y - p))) as rb, sqrt(greatest(0, var_pop(y) - covar_pop(p, y) * covar_pop(p, y) / var_pop(p))) as ra from b group by station)
 select station, n, round(case when n >= 3 then slope end, 6) as slope, round(case when n >= 3 then intercept end, 6) as intercept, round(rb, 6) as rmse_before, round(case when n >= 3 then ra end, 6) as rmse_after, case when n < 3 then 'missing' when slope > 2 then 'unstable' when slope > 1.5 then 'steep' else 'ok' end as slope_flag from f"""


def apply_linear(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d)
    return R6(C.apply_linear(o, C.fit_linear(o, "p", "y"), "p").select("row_id", "prediction"))


APPLY = f"{O}, f as (select regr_slope(y, p) as s, regr_intercept(y, p) as i from b) select row_id, round(i + s * p, 6) as prediction from b cross join f"


def loso_bias_oof(spark: SparkSession, d: str) -> DataFrame:
    o = C.oof_bias(C.folds_loso(_obs(spark, d), "station"), "p", "y", "period")
    return R6(C.oof_linear(o, "p", "y").select("row_id", "fold", "m0", "m1", "m1b", "m2"))


LOSO = f"""{O}, w as (select a.station as fold, avg(c.y - c.p) as m1, regr_slope(c.y, c.p) as s, regr_intercept(c.y, c.p) as i from (select distinct station from b) a join b c on c.station <> a.station group by a.station),
 q as (select a.station as fold, c.period, avg(c.y - c.p) as m from (select distinct station from b) a join b c on c.station <> a.station group by a.station, c.period)
 select row_id, station as fold, round(p, 6) as m0, round(p + w.m1, 6) as m1, round(p + coalesce(q.m, w.m1), 6) as m1b, round(i + s * p, 6) as m2 from b join w on w.fold = b.station left join q on q.fold = b.station and q.period = b.period"""


def time_block_oof(spark: SparkSession, d: str) -> DataFrame:
    o = C.folds_time_block(_obs(spark, d), "day", 5)
    return R6(M.skill(C.oof_bias(o, "p", "y", "period"), "m1b", "y", ["fold"]))


BLOCK = f"""{O}, dd as (select day, 'block_' || ntile(5) over (order by day) as fold from (select distinct day from b) x), f as (select b.*, fold from b join dd on b.day = dd.day), k as (select distinct fold from f),
 w as (select k.fold, avg(y - p) as m1 from k join f on f.fold <> k.fold group by k.fold), q as (select k.fold, period, avg(y - p) as m from k join f on f.fold <> k.fold group by k.fold, period),
 r as (select f.fold, f.p + coalesce(q.m, w.m1) as p, y from f join w on w.fold = f.fold left join q on q.fold = f.fold and q.period = f.period) select fold, {SKILL} from r group by fold"""


def group_folds(spark: SparkSession, d: str) -> DataFrame:
    return C.folds_group_k(_obs(spark, d), "station", 5).groupBy("fold").agg(F.count("*").alias("rows"), F.countDistinct("station").alias("stations"))


GROUPS = f"""{O}, s as (select station, row_number() over (order by count(*) desc, station) - 1 as k from b group by station), f as (select station, case when k // 5 % 2 = 0 then k % 5 else 4 - k % 5 end as fold from s)
 select fold::int as fold, count(*) as rows, count(distinct b.station) as stations from b join f on b.station = f.station group by fold"""


def loso_ridge_oof(spark: SparkSession, d: str) -> DataFrame:
    o = C.folds_loso(_obs(spark, d).withColumn("p2", F.when(F.col("row_id") % 9 != 0, F.col("p2"))).withColumn("empty", F.lit(None).cast("double")), "station")
    return R6(C.oof_ridge(o, ["p", "p2", "h", "empty"], "y").select("row_id", "fold", "ridge", "ridge_features"))


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_R = [["k", "r12", "r13"], ["r12", "k", "r23"], ["r13", "r23", "k"]]
_TRAIN = f"""{O}, f as (select distinct station as fold from b), t as (select fold, y, p as x1, case when row_id % 9 <> 0 then p2 end as q, h as x3 from b join f on station <> fold),
 m as (select fold, quantile_cont(x1, 0.5) as m1, quantile_cont(q, 0.5) as m2, quantile_cont(x3, 0.5) as m3 from t group by fold)"""
#: Three features; the fourth has no values. The standardised system is solved by Cramer's rule.
RIDGE = f"""{_TRAIN}, u as (select t.fold, y, x1, coalesce(q, m2) as x2, x3 from t join m on m.fold = t.fold),
 s as (select fold, 1 + 1.0 / count(*) as k, avg(y) as my, avg(x1) as a1, avg(x2) as a2, avg(x3) as a3, stddev_pop(x1) as s1, stddev_pop(x2) as s2, stddev_pop(x3) as s3, corr(x1, x2) as r12, corr(x1, x3) as r13, corr(x2, x3) as r23,
  covar_pop(x1, y) / stddev_pop(x1) as c1, covar_pop(x2, y) / stddev_pop(x2) as c2, covar_pop(x3, y) / stddev_pop(x3) as c3 from u group by fold),
 w as (select *, {', '.join(f"{_det([[f'c{i + 1}' if j == k else v for j, v in enumerate(r)] for i, r in enumerate(_R)])} / {_det(_R)} / s{k + 1} as w{k + 1}" for k in range(3))} from s)
 select row_id, station as fold, round(my + w1 * (p - a1) + w2 * (coalesce(case when row_id % 9 <> 0 then p2 end, m2) - a2) + w3 * (h - a3), 6) as ridge, 'p,p2,h' as ridge_features from b join w on w.fold = station join m on m.fold = station"""


def left_out_medians(spark: SparkSession, d: str) -> DataFrame:
    """The medians that each left-out fit fills its gaps with."""
    o = C.folds_loso(_obs(spark, d).withColumn("p2", F.when(F.col("row_id") % 9 != 0, F.col("p2"))), "station")
    return R6(C.left_out_medians(o, "fold", ["p", "p2", "h"]).select("fold", F.col("_med_p").alias("p"), F.col("_med_p2").alias("p2"), F.col("_med_h").alias("h")))


LEFT_OUT = f"{_TRAIN} select fold, round(m1, 6) as p, round(m2, 6) as p2, round(m3, 6) as h from m"


def model_ladder(spark: SparkSession, d: str) -> DataFrame:
    o = C.oof_linear(C.oof_bias(C.folds_loso(_obs(spark, d), "station"), "p", "y", "period"), "p", "y")
    return R6(M.skill(C.model_ladder(o, ["m0", "m1", "m1b", "m2"], "y"), "prediction", "y", ["model"]))


_L = LOSO.replace("round(p, 6)", "p").replace("round(p + w.m1, 6)", "p + w.m1").replace("round(p + coalesce(q.m, w.m1), 6)", "p + coalesce(q.m, w.m1)").replace("round(i + s * p, 6)", "i + s * p").replace("select row_id, station as fold", "select row_id, y, station as fold")
_HEAD, _TAIL = _L[: _L.rindex("select row_id, y")], _L[_L.rindex("select row_id, y") :]
_LONG = f"{_HEAD}, z as ({_TAIL}), l as (" + " union all ".join(f"select '{m}' as model, fold, {m} as p, y from z" for m in ("m0", "m1", "m1b", "m2")) + ")"
LADDER = f"{_LONG} select model, {SKILL} from l group by model"


def fold_delta(spark: SparkSession, d: str) -> DataFrame:
    o = C.oof_linear(C.oof_bias(C.folds_loso(_obs(spark, d), "station"), "p", "y", "period"), "p", "y")
    return R6(C.fold_delta(C.model_ladder(o, ["m1b", "m2"], "y"), "m1b", "m2", "y"))


DELTA = f"{_LONG} select fold, count(*) filter (model = 'm1b') as n, round(avg(abs(y - p)) filter (model = 'm1b'), 6) as mae_a, round(avg(abs(y - p)) filter (model = 'm2'), 6) as mae_b, round(avg(abs(y - p)) filter (model = 'm2') - avg(abs(y - p)) filter (model = 'm1b'), 6) as delta from l group by fold"


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return C.bootstrap_ci(fold_delta(spark, d), "delta", 5000).withColumns({c: F.round(c, 6) for c in ("mean", "low", "high", "p")})


BOOTSTRAP = f"""with v as (select delta as v, row_number() over (order by delta) - 1 as k, count(*) over () as m from ({DELTA}) x where delta is not null),
 d as (select iter, ('0x' || substr(md5('42:' || iter || ':' || draw), 1, 8))::bigint % m as k from (select max(m) as m from v) z, range(0, 5000) i(iter), range(1, 100000) w(draw) where draw <= m), g as (select iter, avg(v) as mu from d join v using (k) group by iter)
 select (select count(*) from v) as n, round((select avg(v) from v), 6) as mean, round(quantile_cont(mu, 0.025), 6) as low, round(quantile_cont(mu, 0.975), 6) as high, round(least(1, 2 * least(avg((mu <= 0)::int), avg((mu >= 0)::int))), 6) as p, cast(null as varchar) as note from g"""


def ablation(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).withColumns({"has_match": F.col("row_id") % 4 != 0, "run": F.when(F.col("row_id") % 3 == 0, "old_1").otherwise("v11_7"), "used": F.col("row_id") % 5 != 0, "core": F.when(F.col("row_id") % 7 != 0, F.col("p"))})
    out = C.ablation(C.pairing_flags(o, ["core"], "run", "v11_%"), list(C.FILTER_MODES), ["p", "p2"], "y")
    return out.withColumns({c: F.round(c, 8) for c in ("mae_p", "mae_p2")})


_AB = "select '{m}' as mode, count(*) as n, round(avg(abs(y - p)), 8) as mae_p, round(avg(abs(y - p2)), 8) as mae_p2 from b where {w}"
ABLATION = f"{O} " + " union all ".join(_AB.format(m=m, w=w) for m, w in {"all": "true", "retrospective_calibration": "row_id % 4 <> 0 and row_id % 7 <> 0", "collector_pair_used": "row_id % 5 <> 0", "fresh_only": "row_id % 3 <> 0", "migrated_only": "row_id % 3 = 0"}.items())


def proxy_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    return R6(C.proxy_diagnostic(_obs(spark, d), ["p", "p2"], "y"))


DIAGNOSTIC = f"{O}, l as (select 'p' as proxy, p as x, y from b union all select 'p2', p2, y from b) select proxy, count(*) as n, round(avg(x - y), 6) as bias, round(avg(abs(x - y)), 6) as mae, round(sqrt(avg((x - y) * (x - y))), 6) as rmse from l group by proxy"


def formula_variants(spark: SparkSession, d: str) -> DataFrame:
    wx = adapter(spark, d, "weather").withColumn("y", F.col("temp") * 0.9 + F.col("sw") * 0.002)
    ks = {f"k{int(k * 10000):03d}": k for k in (0.0, 0.0045, 0.0065)}
    wide = wx.select("y", *(T.wbgt_weather_only(*(F.col(c) for c in ("temp", "rh", "wind", "sw")), k=v).alias(n) for n, v in ks.items()))
    return R6(M.skill(C.model_ladder(wide, list(ks), "y"), "prediction", "y", ["model"]))


_V = " union all ".join(f"select 'k{int(k * 10000):03d}' as model, 0.7 * {stull('temp', 'rh')} + 0.2 * (temp + {k} * sw / sqrt(greatest(wind, 0.1) + 0.25)) + 0.1 * temp as p, temp * 0.9 + sw * 0.002 as y from weather" for k in (0.0, 0.0045, 0.0065))
VARIANTS = f"{duck('weather')}, l as ({_V}) select model, {SKILL} from l group by model"


def random_forest_cv(spark: SparkSession, d: str) -> DataFrame:
    o = C.folds_time_block(_obs(spark, d).select("day", "y", "p", "p2", "h", "kind"), "day", 3)
    return C.random_forest_cv(o, ["p", "p2", "h"], "y", trees=120, categorical=["kind"])


def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """Of a fitted forest."""
    o = C.forest_rows(_obs(spark, d).select("row_id", "y", "p", "p2", "kind"))
    return C.permutation_importance(o, C.forest_pipeline(["p", "p2"], "y", ["kind"], 20).fit(o).transform, ["p", "p2", "kind"], "y", 2)


def linear_importance(spark: SparkSession, d: str) -> DataFrame:
    """Of a fixed linear model, by the rows' own key."""
    o = _obs(spark, d).select("row_id", "y", "p", "p2", "h")
    return R6(C.permutation_importance(o, F.col("p") * 0.7 + F.col("p2") * 0.3, ["p", "p2", "h"], "y", 2, key="row_id"))


_DEALT = " union all ".join(
    f"select '{f}' as feature, {k} as k, sqrt(avg(power(a.y - ({'b.v' if f == 'p' else 'a.p'} * 0.7 + {'b.v' if f == 'p2' else 'a.p2'} * 0.3), 2))) as rmse from a join (select {f} as v, row_number() over (order by md5('0:{k}:{f}:' || row_id), row_id) as place from o) b using (place)"
    for f in ("p", "p2", "h") for k in range(2)
)
LINEAR = f"""{O}, a as (select *, row_number() over (order by row_id) as place from o), x as ({_DEALT}), z as (select sqrt(avg(power(y - (p * 0.7 + p2 * 0.3), 2))) as base from o)
 select feature, round(avg(rmse - base), 6) as rise from x cross join z group by feature"""


def focus_timeline(spark: SparkSession, d: str) -> DataFrame:
    o = C.oof_linear(C.oof_bias(C.folds_loso(_obs(spark, d), "station"), "p", "y", "period"), "p", "y")
    return R6(o.groupBy("station", "t").agg(F.max("m1b").alias("m1b"), F.max("m2").alias("m2"), F.max("y").alias("y"))).withColumn("alert", F.col("m1b") >= 29.0)


FOCUS = f"{_HEAD}, z as ({_TAIL}), t as (select z.*, b.t from z join b using (row_id)) select fold as station, t, round(max(m1b), 6) as m1b, round(max(m2), 6) as m2, max(y) as y, round(max(m1b), 6) >= 29.0 as alert from t group by fold, t"

QUERIES = {
    "skill_by_station": (skill_by_station, f"{O} select station, {SKILL} from b group by station"), "skill_by_period": (skill_by_period, BY_PERIOD), "confusion_31": (confusion_31, CONFUSION), "threshold_scan": (threshold_scan, SCAN),
    "operating_points": (operating_points, POINTS), "residual_by_hour": (residual_by_hour, BY_HOUR), "grouped_bias": (grouped_bias, GROUPED), "fit_linear": (fit_linear, FIT), "apply_linear": (apply_linear, APPLY), "loso_bias_oof": (loso_bias_oof, LOSO),
    "time_block_oof": (time_block_oof, BLOCK), "group_folds": (group_folds, GROUPS), "loso_ridge_oof": (loso_ridge_oof, RIDGE), "left_out_medians": (left_out_medians, LEFT_OUT), "model_ladder": (model_ladder, LADDER), "fold_delta": (fold_delta, DELTA), "bootstrap_ci": (bootstrap_ci, BOOTSTRAP),
    "ablation": (ablation, ABLATION), "proxy_diagnostic": (proxy_diagnostic, DIAGNOSTIC), "formula_variants": (formula_variants, VARIANTS), "random_forest_cv": (random_forest_cv, None), "permutation_importance": (permutation_importance, None), "linear_importance": (linear_importance, LINEAR), "focus_timeline": (focus_timeline, FOCUS),
}
