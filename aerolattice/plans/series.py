"""Station series: lags, rolling values, sums, ranks, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import windows as W
from .adapters import adapter, duck

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def _wx(spark: SparkSession, d: str) -> DataFrame:
    return adapter(spark, d, "weather").withColumn("day", S.day(F.col("t")))


WX = f"{duck('weather')}, w as (select *, t // 86400 as day from weather)"


def rolling_lag_features(spark: SparkSession, d: str) -> DataFrame:
    w = W.row_lag(_wx(spark, d), ["sw", "temp"], 4, ["station", "day"], "t")
    w = W.rolling_mean(W.row_lag(w, ["sw"], 8, ["station", "day"], "t"), ["sw"], 12, ["station", "day"], "t")
    w = W.rolling_mean(w, ["temp"], 3, ["station", "day"], "t")
    w = W.diff(w, "temp", ["station"], "t")
    return R6(w.select("station", "t", "sw_lag4", "sw_lag8", "temp_lag4", "sw_mean12", "temp_mean3", "temp_diff"), "sw_mean12", "temp_mean3", "temp_diff")


ROLLING = f"""{WX} select station, t, coalesce(lag(sw, 4) over d, sw) as sw_lag4, coalesce(lag(sw, 8) over d, sw) as sw_lag8, coalesce(lag(temp, 4) over d, temp) as temp_lag4,
 round(avg(sw) over (partition by station, day order by t rows 11 preceding), 6) as sw_mean12, round(avg(temp) over (partition by station, day order by t rows 2 preceding), 6) as temp_mean3,
 round(temp - lag(temp) over (partition by station order by t), 6) as temp_diff from w window d as (partition by station, day order by t)"""


def time_lag(spark: SparkSession, d: str) -> DataFrame:
    return W.time_lag(_wx(spark, d), ["temp"], 3600, ["station"], "t", 7200).select("station", "t", "temp_ago")


TIME_LAG = f"""{WX} select a.station, a.t, arg_max(b.temp, b.t) as temp_ago from w a left join w b on a.station = b.station and b.t between a.t - 10800 and a.t - 3600 group by a.station, a.t"""


def day_cumsum(spark: SparkSession, d: str) -> DataFrame:
    w = _wx(spark, d).withColumn("sw", F.when(F.col("sw") > 100, F.col("sw")))
    a = W.day_cumsum(w, "sw", ["station", "day"], "t", 0.25).withColumnRenamed("sw_cumsum", "kept_missing")
    return R6(W.day_cumsum(a, "sw", ["station", "day"], "t", 0.25, fill=True).select("station", "t", "kept_missing", F.col("sw_cumsum").alias("filled")), "kept_missing", "filled")


CUMSUM = f"""{WX}, m as (select *, case when sw > 100 then sw end as s from w) select station, t, round(case when s is not null then sum(s) over d * 0.25 end, 6) as kept_missing,
 round(sum(coalesce(s, 0)) over d * 0.25, 6) as filled from m window d as (partition by station, day order by t)"""


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    w = _wx(spark, d).withColumn("mark", F.when(F.col("sw") > 600, F.col("sw")))
    return W.carry_forward(w, "mark", "last_mark", ["station"], "t").select("station", "t", "last_mark")


CARRY = f"{WX} select station, t, last_value(case when sw > 600 then sw end ignore nulls) over (partition by station order by t rows unbounded preceding) as last_mark from w"


def latest_per_station(spark: SparkSession, d: str) -> DataFrame:
    return W.latest_per_key(adapter(spark, d, "obs").select("station", "t", "row_id", "y"), ["station"], "t", "row_id")


LATEST = f"{duck('obs')} select station, max(t) as t, arg_max(row_id, (t, row_id)) as row_id, arg_max(y, (t, row_id)) as y from obs group by station"


def pct_rank_scores(spark: SparkSession, d: str) -> DataFrame:
    c = adapter(spark, d, "cells").withColumn("gvi", F.when(F.col("gvi") > 3, F.col("gvi")))
    c = W.rank_desc(W.pct_rank(c, "gvi", "pct"), "gvi", "rank_high")
    c = W.pct_rank(c, "park", "pct_in_class", ["land_use"])
    return R6(W.row_rank(c, [F.desc_nulls_last("gvi"), F.col("cell")], "row").select("cell", "pct", "rank_high", "pct_in_class", "row"), "pct", "pct_in_class")


PCT = f"""{duck('cells')}, g as (select cell, land_use, park, case when gvi > 3 then gvi end as v from cells),
 k as (select cell, (rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0) / (select count(v) from g) as p, rank() over (order by v desc) as r from g where v is not null)
 select g.cell, round(coalesce(p, 0), 6) as pct, r as rank_high, round((rank() over (partition by land_use order by park) + (count(*) over (partition by land_use, park) - 1) / 2.0) / count(*) over (partition by land_use), 6) as pct_in_class,
 row_number() over (order by v desc nulls last, g.cell) as row from g left join k on g.cell = k.cell"""


def row_rank(spark: SparkSession, d: str) -> DataFrame:
    return W.row_rank(adapter(spark, d, "obs").select("row_id", "y"), [F.desc("y"), F.asc("row_id")]).select("row_id", "rank")


ROW_RANK = f"{duck('obs')} select row_id, row_number() over (order by y desc, row_id) as rank from obs"


def robust_minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    return R6(W.robust_minmax(adapter(spark, d, "cells"), ["park", "gvi"]).select("cell", "park_scaled", "gvi_scaled"), "park_scaled", "gvi_scaled")


ROBUST = f"""{duck('cells')}, q as (select quantile_cont(park, 0.05) as pl, quantile_cont(park, 0.95) as ph, quantile_cont(gvi, 0.05) as gl, quantile_cont(gvi, 0.95) as gh from cells)
 select cell, round(greatest(0, least(1, (park - pl) / (ph - pl))), 6) as park_scaled, round(greatest(0, least(1, (gvi - gl) / (gh - gl))), 6) as gvi_scaled from cells cross join q"""


def time_blocks(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").withColumn("day", S.day(F.col("t")))
    return W.time_blocks(o, "day", 4).groupBy("block").agg(F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


BLOCKS = f"""{duck('obs')}, d as (select distinct t // 86400 as day from obs), b as (select day, ntile(4) over (order by day) as block from d)
 select block, count(*) as rows, min(b.day) as first_day, max(b.day) as last_day from obs o join b on o.t // 86400 = b.day group by block"""


def kth_score_shift(spark: SparkSession, d: str) -> DataFrame:
    return R6(W.kth_score_shift(adapter(spark, d, "obs"), "y", "p", 31.0), "kth_score", "shift_rank", "shift_max", "shift_p99")


KTH = f"""{duck('obs')}, f as (select count(*) filter (y >= 31) as events, max(y) as my, max(p) as mp, quantile_cont(y, 0.99) as qy, quantile_cont(p, 0.99) as qp from obs),
 r as (select p, row_number() over (order by p desc) as k from obs)
 select events, round(p, 6) as kth_score, round(31 - p, 6) as shift_rank, round(my - mp, 6) as shift_max, round(qy - qp, 6) as shift_p99 from f join r on r.k = f.events"""


def hourly_buckets(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.hourly_buckets(adapter(spark, d, "obs"), "y", ["station"], "t", ["p"]), "mean", "p90")


BUCKETS = f"{duck('obs')} select station, t - t % 3600 as hour_start, round(avg(y), 6) as mean, max(y) as max, round(quantile_cont(y, 0.9), 6) as p90, min(y) as min, count(y) as n, arg_min(p, (t, p)) as p from obs group by station, hour_start"

QUERIES = {
    "rolling_lag_features": (rolling_lag_features, ROLLING), "time_lag": (time_lag, TIME_LAG), "day_cumsum": (day_cumsum, CUMSUM), "carry_forward": (carry_forward, CARRY), "latest_per_station": (latest_per_station, LATEST),
    "pct_rank_scores": (pct_rank_scores, PCT), "row_rank": (row_rank, ROW_RANK), "robust_minmax_scores": (robust_minmax_scores, ROBUST), "time_blocks": (time_blocks, BLOCKS), "kth_score_shift": (kth_score_shift, KTH), "hourly_buckets": (hourly_buckets, BUCKETS),
}
