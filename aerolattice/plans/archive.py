"""Archives: summaries, health, upserts, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import tables as TB
from .adapters import adapter, duck

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.event_counts(adapter(spark, d, "obs").withColumn("y", F.when(F.col("row_id") % 11 != 0, F.col("y"))), "y", ["station"], "t"), "mean", "missing_pct")


EVENTS = f"""{duck('obs')}, o as (select station, t, case when row_id % 11 <> 0 then y end as y, t % 86400 // 3600 as h from obs) select station, count(*) as rows, count(distinct t // 86400) as days, max(t) - min(t) as span_s, round(avg(y), 6) as mean, max(y) as max,
 round(100.0 * count(*) filter (y is null) / count(*), 6) as missing_pct, count(*) filter (y >= 29) as ge_29, count(*) filter (y >= 31) as ge_31, count(*) filter (y >= 33) as ge_33, count(*) filter (h between 13 and 16) as peak_rows from o group by station"""


def missingness(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").withColumns({"y": F.when(F.col("row_id") % 7 != 0, F.col("y")), "p": F.when(F.col("row_id") % 13 != 0, F.col("p"))})
    return R6(A.missingness(o, ["station", "y", "p"]), "missing_pct")


MISSING = f"""{duck('obs')}, o as (select station, case when row_id % 7 <> 0 then y end as y, case when row_id % 13 <> 0 then p end as p from obs), c as (select count(*) as n, count(station) as s, count(y) as y, count(p) as p from o)
 select 'station' as "column", s as non_null, round(100.0 * (n - s) / n, 6) as missing_pct from c union all select 'y', y, round(100.0 * (n - y) / n, 6) from c union all select 'p', p, round(100.0 * (n - p) / n, 6) from c"""


def duplicate_count(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicate_count(adapter(spark, d, "obs").withColumn("h", F.floor(F.col("t") / 3600)), ["station", "h"])


DUPLICATES = f"{duck('obs')}, k as (select count(*) as n from obs group by station, t // 3600) select sum(n - 1)::bigint as duplicates, count(*) as keys from k"


def value_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.value_breakdown(adapter(spark, d, "obs"), "kind"), "pct")


BREAKDOWN = f"{duck('obs')} select kind, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from obs group by kind"


def distribution(spark: SparkSession, d: str) -> DataFrame:
    out = A.distribution(adapter(spark, d, "obs"), ["y", "p"], ["kind"])
    return R6(out, *(c for c in out.columns if c not in ("kind", "column", "n")))


_QS = ", ".join(f"round(quantile_cont(v, {q}), 6) as {n}" for n, q in A.QUANTILES.items())
DISTRIBUTION = f"""{duck('obs')}, l as (select kind, 'y' as "column", y as v from obs union all select kind, 'p', p from obs) select kind, "column", count(v) as n, round(min(v), 6) as min, round(max(v), 6) as max, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std,
 {_QS}, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) as iqr from l group by kind, "column" """


def variable_summary(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.variable_summary(adapter(spark, d, "obs"), ["kind"], "station", "t", "y"), "mean")


VARIABLES = f"{duck('obs')} select kind, count(*) as rows, count(distinct station) as stations, count(distinct t) as timestamps, count(*) filter (y is null) as missing, min(y) as min, round(avg(y), 6) as mean, max(y) as max from obs group by kind"


def station_summary(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").withColumns({"lat": 1.3 + F.col("row_id") % 100 / 1e3, "lon": 103.8 + F.col("row_id") % 70 / 1e3, "k": F.struct("t", "row_id")})
    return R6(A.station_summary(o, "station", "k", "lat", "lon", "kind", ["click", "view", "error"], (1.335, 103.855)), "lat", "lon", "to_centre_m").drop("to_centre_m")


STATIONS = f"""{duck('obs')} select station, round(1.3 + arg_min(row_id, (t, row_id)) % 100 / 1e3, 6) as lat, round(103.8 + arg_min(row_id, (t, row_id)) % 70 / 1e3, 6) as lon, count(*) as rows,
 count(*) filter (kind = 'click') as n_click, count(*) filter (kind = 'view') as n_view, count(*) filter (kind = 'error') as n_error from obs group by station"""


def archive_health(spark: SparkSession, d: str) -> DataFrame:
    return A.archive_health(adapter(spark, d, "obs"), "station", "t", 3)


HEALTH = f"""{duck('obs')}, m as (select max(t) as n, min(t) as s, count(*) as rows from obs), p as (select station, count(*) filter (t > n - 86400) as d, count(*) filter (t > n - 604800) as w from obs cross join m group by station),
 q as (select count(*) as stations, sum(d)::bigint as rows_24h, sum(w)::bigint as rows_7d, count(*) filter (d < 3) as silent from p)
 select rows, n - s as span_s, stations, rows_24h, rows_7d, silent, case when silent = 0 then 'GREEN' when silent * 2 <= stations then 'YELLOW' else 'RED' end as verdict from m cross join q"""


def readiness(spark: SparkSession, d: str) -> DataFrame:
    return A.readiness(adapter(spark, d, "obs"), "y", "station", "t")


READINESS = f"""{duck('obs')}, a as (select count(y) as pairs, count(distinct station) as stations, count(distinct t // 86400) as days, count(*) filter (y >= 31) as ge_31, count(*) filter (y >= 33) as ge_33 from obs)
 select *, 1 + (ge_31 > 0)::int + (ge_33 > 0)::int as regimes, case when pairs < 30 or days < 3 then 'collect_more' when ge_31 = 0 then 'bias_only' else 'calibrate' end as advice from a"""


def static_constancy(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").withColumns({"fixed": F.substring("station", 1, 1), "varied": F.col("row_id") % 3, "often": F.when(F.col("station") > "S110", F.col("row_id") % 2).otherwise(1)})
    return A.static_constancy(o, "station", ["fixed", "varied", "often"])


CONSTANCY = f"""{duck('obs')}, c as (select station, count(distinct substr(station, 1, 1)) as f, count(distinct row_id % 3) as v, count(distinct case when station > 'S110' then row_id % 2 else 1 end) as o from obs group by station),
 l as (select station, 'fixed' as "column", f as n_values from c union all select station, 'varied', v from c union all select station, 'often', o from c) select * from l where n_values > 1"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    return adapter(spark, d, "obs").select("station", (F.col("t") - F.pmod("t", F.lit(3600))).alias("h"), "row_id", F.col("kind").alias("variable"), F.col("y").alias("value"))


def upsert_keep_last(spark: SparkSession, d: str) -> DataFrame:
    rows = _long(spark, d)
    old, new = rows.filter("row_id % 2 = 0"), rows.filter("row_id % 3 <> 1")
    return TB.upsert_keep_last(old, new.drop("variable"), ["station", "h"], ["row_id"]).select("station", "h", "row_id", "variable", "value")


UPSERT = f"""{duck('obs')}, l as (select station, t - t % 3600 as h, row_id, kind, y from obs), u as (select *, 0 as n from l where row_id % 2 = 0 union all select station, h, row_id, null, y, 1 from l where row_id % 3 <> 1),
 r as (select *, row_number() over (partition by station, h order by row_id desc, n desc) as k from u) select station, h, row_id, kind as variable, y as value from r where k = 1"""


def rows_added(spark: SparkSession, d: str) -> DataFrame:
    rows = _long(spark, d)
    return TB.rows_added(rows.filter("row_id % 2 = 0"), rows.filter("row_id % 3 <> 1"), ["station", "h"])


ADDED = f"{duck('obs')}, l as (select station, t - t % 3600 as h, row_id from obs) select count(*) as rows_added from (select distinct station, h from l where row_id % 3 <> 1 except select station, h from l where row_id % 2 = 0)"


def migrate_legacy(spark: SparkSession, d: str) -> DataFrame:
    rows = _long(spark, d)
    legacy = rows.filter("row_id % 2 = 0").select("station", "h", "row_id", "value")
    return TB.migrate_legacy([legacy, rows.filter("row_id % 5 = 0")], ["station", "h", "variable"], "row_id").select("station", "h", "row_id", "value", "variable")


MIGRATE = f"""{duck('obs')}, l as (select station, t - t % 3600 as h, row_id, kind, y from obs), u as (select station, h, row_id, y, null as kind, 0 as n from l where row_id % 2 = 0 union all select station, h, row_id, y, kind, 1 from l where row_id % 5 = 0),
 r as (select *, row_number() over (partition by station, h order by row_id desc, n desc) as k from u) select station, h, row_id, y as value, kind as variable from r where k = 1"""


def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    return TB.pivot_wide(_long(spark, d), ["station", "h"], "variable", "value", "row_id", ["click", "view", "error"])


PIVOT = f"""{duck('obs')}, l as (select station, t - t % 3600 as h, row_id, kind, y from obs) select station, h, arg_max(y, row_id) filter (kind = 'click') as click, arg_max(y, row_id) filter (kind = 'view') as view, arg_max(y, row_id) filter (kind = 'error') as error from l group by station, h"""


def payload_props(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", S.safe_double(k).alias("k"), S.norm_station_id(F.concat(F.lit(" s"), F.col("user_id").cast("string"), F.lit(" "))).alias("station"), S.station_from_path(F.concat(F.lit("/a/S"), (F.col("user_id") + 100).cast("string"), F.lit("/x.csv"))).alias("from_path"), S.coalesce_non_empty(F.lit(""), F.col("event_type")).alias("kind"))


PROPS = """select event_id, cast(json_extract_string(props, '$.k') as double) as k, 'S' || user_id as station, 'S' || (user_id + 100) as from_path, event_type as kind from events"""


def validate_cells(spark: SparkSession, d: str) -> DataFrame:
    return A.conditions(adapter(spark, d, "cells").withColumn("svf", F.col("svf") + F.col("cell") % 4 / 10), ["cell", "svf", "shade", "zone"], "cell", ["svf", "shade"])


VALIDATE = f"""{duck('cells')}, c as (select cell, svf + cell % 4 / 10.0 as svf, shade from cells) select 'zone' as missing_columns, count(*) - count(distinct cell) as duplicate_keys, count(*) filter (cell is null) as null_cell, count(*) filter (svf is null) as null_svf,
 count(*) filter (shade is null) as null_shade, count(*) filter (svf < 0 or svf > 1) as outside_svf, count(*) filter (shade < 0 or shade > 1) as outside_shade from c"""

QUERIES = {
    "event_counts": (event_counts, EVENTS), "missingness": (missingness, MISSING), "duplicate_count": (duplicate_count, DUPLICATES), "value_breakdown": (value_breakdown, BREAKDOWN), "distribution": (distribution, DISTRIBUTION),
    "variable_summary": (variable_summary, VARIABLES), "station_summary": (station_summary, STATIONS), "archive_health": (archive_health, HEALTH), "readiness": (readiness, READINESS), "static_constancy": (static_constancy, CONSTANCY),
    "upsert_keep_last": (upsert_keep_last, UPSERT), "rows_added": (rows_added, ADDED), "migrate_legacy": (migrate_legacy, MIGRATE), "pivot_wide": (pivot_wide, PIVOT), "payload_props": (payload_props, PROPS), "validate_cells": (validate_cells, VALIDATE),
}
