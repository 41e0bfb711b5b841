"""Payloads, streams and rings. Payloads are made from the driver's tables, so that their rows are known."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming as ST
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import rings as RG
from ..session import shared_dir, stored
from ..sources import payloads as P
from .adapters import SPARK_EPOCH, STATION, adapter, duck
from .calibration import R6





def _readings(spark: SparkSession, d: str) -> DataFrame:
    return adapter(spark, d, "obs").filter("kind = 'view'").select("station", (F.col("t") - F.pmod("t", F.lit(900))).alias("t"), "y").groupBy("station", "t").agg(F.max("y").alias("y"))


READINGS = f"{duck('obs')}, r as (select station, t - t % 900 as t, max(y) as y from obs where kind = 'view' group by 1, 2)"
PLACE = lambda s: F.struct(s.alias("id"), s.alias("device_id"), s.alias("deviceId"), F.concat(F.lit("Place "), s).alias("name"), F.struct((1.3 + F.substring(s, 2, 3).cast("int") / 1e3).alias("latitude"), F.lit(103.8).alias("longitude")).alias("location"))


def payload_v1(spark: SparkSession, d: str) -> DataFrame:
    r = _readings(spark, d).groupBy("t").agg(F.collect_list(F.struct(F.col("station").alias("station_id"), F.col("y").alias("value"))).alias("readings"), F.collect_set(PLACE(F.col("station"))).alias("stations"))
    doc = F.to_json(F.struct(F.struct("stations", F.lit("deg C").alias("reading_unit")).alias("metadata"), F.array(F.struct(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "readings")).alias("items")))
    rows = P.flatten_v1(r.select(doc.alias("payload"), F.lit("made").alias("source_file")), "official_wbgt_c")
    return rows.select("station_id", "station_name", "value", "unit", F.round("station_lat", 6).alias("station_lat"), "value_missing")


V1 = f"{READINGS} select station as station_id, 'Place ' || station as station_name, y as value, 'deg C' as unit, round(1.3 + substr(station, 2, 3)::int / 1e3, 6) as station_lat, false as value_missing from r"


def payload_v2(spark: SparkSession, d: str) -> DataFrame:
    r = _readings(spark, d).groupBy("t").agg(F.collect_list(F.struct(F.col("station").alias("stationId"), F.col("y").alias("value"))).alias("data"), F.collect_set(PLACE(F.col("station"))).alias("stations"))
    doc = F.to_json(F.struct(F.lit(0).alias("code"), F.struct("stations", F.array(F.struct(F.lit("x").alias("timestamp"), "data")).alias("readings"), F.lit("c").alias("readingUnit")).alias("data")))
    rows = P.flatten_v2(r.select(doc.alias("payload"), F.lit("made").alias("source_file")), "air_temperature_c")
    return rows.groupBy("station_id", "variable", "unit").agg(F.count("*").alias("rows"), F.max("value").alias("top"))


V2 = f"{READINGS} select station as station_id, 'air_temperature_c' as variable, 'c' as unit, count(*) as rows, max(y) as top from r group by station"


def payload_weather(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("station")
    reading = F.struct(F.struct(s.alias("id"), s.alias("name"), F.lit("T").alias("townCenter")).alias("station"), F.struct(F.lit("1.3").alias("latitude"), F.lit("103.8").alias("longtitude")).alias("location"), F.when(F.col("y") < 31, "Low").otherwise("Moderate").alias("heatStress"), F.col("y").cast("string").alias("wbgt"))
    r = _readings(spark, d).groupBy("t").agg(F.collect_list(reading).alias("readings"))
    doc = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("x").alias("datetime"), F.struct("readings").alias("item"))).alias("records")).alias("data")))
    return P.flatten_weather(r.select(doc.alias("payload"), F.lit("made").alias("source_file")), "official_wbgt_c").groupBy("station_id", "heat_stress_category").agg(F.count("*").alias("rows"), F.max("value").alias("top"), F.max("station_lon").alias("lon"))


WEATHER = f"{READINGS} select station as station_id, case when y < 31 then 'Low' else 'Moderate' end as heat_stress_category, count(*) as rows, max(y) as top, 103.8::double as lon from r group by 1, 2"


def payload_any(spark: SparkSession, d: str) -> DataFrame:
    """Documents of three versions in one table, some with a field that none of them has, and some that aren't JSON."""
    s, y, at = F.col("station"), F.col("y"), F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss")
    place = F.struct(s.alias("id"), F.concat(F.lit("Place "), s).alias("name"))
    item = lambda *fields: F.array(F.struct(*fields))
    v1 = F.struct(F.struct(F.array(place).alias("stations"), F.lit("deg C").alias("reading_unit")).alias("metadata"), item(at.alias("timestamp"), item(s.alias("station_id"), y.alias("value")).alias("readings")).alias("items"))
    v2 = F.struct(F.struct(F.array(place).alias("stations"), item(at.alias("timestamp"), item(s.alias("stationId"), y.alias("value"), F.lit("new").alias("sensorState")).alias("data")).alias("readings"), F.lit("c").alias("readingUnit")).alias("data"))
    v3 = F.struct(F.struct(item(at.alias("datetime"), F.struct(item(place.alias("station"), y.cast("string").alias("wbgt"), F.lit("Low").alias("heatStress")).alias("readings")).alias("item")).alias("records")).alias("data"))
    kind = F.pmod(F.floor(F.col("t") / 900), F.lit(4))
    doc = F.when(kind == 0, F.to_json(v1)).when(kind == 1, F.to_json(v2)).when(kind == 2, F.to_json(v3)).otherwise(F.lit("<html>not found</html>"))
    rows = P.flatten_any(_readings(spark, d).select(doc.alias("payload"), kind.cast("string").alias("source_file")), "air_temperature_c")
    return rows.select("source_file", "station_id", "station_name", "timestamp", "value", "unit", "value_missing", F.col("unread").cast("long").alias("unread"))


ANY = f"""{READINGS} select (t // 900 % 4)::varchar as source_file, station as station_id, 'Place ' || station as station_name, strftime(to_timestamp(t) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') as timestamp, y as value,
 case t // 900 % 4 when 0 then 'deg C' when 1 then 'c' end as unit, false as value_missing, (t // 900 % 4 = 1)::bigint as unread from r where t // 900 % 4 < 3"""


def payload_hourly(spark: SparkSession, d: str) -> DataFrame:
    w = adapter(spark, d, "weather").groupBy("station").agg(F.array_sort(F.collect_list(F.struct("t", "temp", "rh"))).alias("a"))
    arrays = F.struct(F.transform("a", lambda x: x["t"].cast("string")).alias("time"), F.transform("a", lambda x: x["temp"]).alias("temperature_2m"), F.slice(F.transform("a", lambda x: x["rh"]), F.lit(1), F.size("a") - 1).alias("relative_humidity_2m"))
    doc = F.to_json(F.struct(F.lit(1.3).alias("latitude"), F.lit(103.8).alias("longitude"), arrays.alias("hourly")))
    rows = P.flatten_hourly(w.select(doc.alias("payload"), F.col("station").alias("source_file")), ["temperature_2m", "relative_humidity_2m"])
    return rows.select(F.col("source_file").alias("station"), F.col("time").cast("long").alias("t"), F.col("temperature_2m").alias("temp"), F.col("relative_humidity_2m").alias("rh"))


HOURLY = f"{duck('weather')} select station, t, temp, case when t < max(t) over (partition by station) then rh end as rh from weather"


def met_forcing(spark: SparkSession, d: str) -> DataFrame:
    w = adapter(spark, d, "weather").withColumn("cloud", F.lit(None).cast("double"))
    return P.hours_to_met_forcing(w, "S110", 19725, (0, 23)).select("iy", "id", "it", "wind", "rh", "temp", "kdown", "cloud")


FORCING = f"{duck('weather')} select 2024 as iy, (19725 - 19723 + 1)::int as id, (t % 86400 // 3600)::int as it, greatest(wind, 0.5) as wind, rh, temp, sw as kdown, 0::double as cloud from weather where station = 'S110' and t // 86400 = 19725"


def _ringed(spark: SparkSession, d: str) -> DataFrame:
    b = adapter(spark, d, "boxes")
    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))))
    return b.withColumn("ring", ring)


def ring_overlay(spark: SparkSession, d: str) -> DataFrame:
    pieces = RG.overlay_rings(adapter(spark, d, "cells"), _ringed(spark, d), 100.0, ("type",))
    return pieces.groupBy("cell", "type").agg(F.round(F.sum("piece_area"), 3).alias("area"))


RING_OVERLAY = f"""{duck('cells', 'boxes')}, p as (select cell, type, (least(x_max, x + 100) - greatest(x_min, x)) * (least(y_max, y + 100) - greatest(y_min, y)) as a from cells join boxes on x_max > x and x_min < x + 100 and y_max > y and y_min < y + 100)
 select cell, type, round(sum(a), 3) as area from p group by cell, type"""


def ring_iou(spark: SparkSession, d: str) -> DataFrame:
    return RG.ring_iou_pairs(_ringed(spark, d), "box", 100.0).select("a", "b", F.round("intersection", 3).alias("intersection"), F.round("iou", 6).alias("iou"))


RING_IOU = f"""{duck('boxes')}, j as (select a.box as a, b.box as b, (least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * (least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)) as i, power(10 + a.size, 2) as aa, power(10 + b.size, 2) as ba
 from boxes a join boxes b on a.box < b.box and a.x_min < b.x_max and b.x_min < a.x_max and a.y_min < b.y_max and b.y_min < a.y_max) select a, b, round(i, 3) as intersection, round(i / (aa + ba - i), 6) as iou from j"""


def nearest_park(spark: SparkSession, d: str) -> DataFrame:
    p = adapter(spark, d, "cells").select("cell", (F.col("x") + 50).alias("px"), (F.col("y") + 50).alias("py"))
    return RG.nearest_polygon(p, _ringed(spark, d).filter("box % 5 = 0"), "cell", "box", 200.0).withColumn("distance", F.round("distance", 6))


NEAREST_PARK = f"""{duck('cells', 'boxes')}, j as (select cell, box, sqrt(power(greatest(x_min - x - 50, 0, x + 50 - x_max), 2) + power(greatest(y_min - y - 50, 0, y + 50 - y_max), 2)) as d from cells join boxes on box % 5 = 0 and x_min <= x + 250 and x_max >= x - 150 and y_min <= y + 250 and y_max >= y - 150),
 k as (select *, row_number() over (partition by cell order by d, box) as k from j where d <= 200) select c.cell, round(coalesce(d, 9999), 6) as distance, box from cells c left join k on k.cell = c.cell and k = 1"""


def demographics(spark: SparkSession, d: str) -> DataFrame:
    c = adapter(spark, d, "cells").select(F.lit("g").alias("part"), "cell", F.when(F.col("cell") % 10 == 1, F.concat(F.lit("Area "), F.col("cell").cast("string"), F.lit(" - Total"))).otherwise(F.concat(F.lit("Block "), F.col("cell").cast("string"))).alias("label"), (F.col("park") + 10).alias("total"), "gvi", "elderly")
    c = c.withColumn("part", F.floor(F.col("cell") / 500))
    return R6(A.demographics(c, "label", "cell", ["part"], "total", ["gvi"], ["elderly", "gvi"])).drop("part")


DEMOGRAPHICS = f"""{duck('cells')}, l as (select cell // 500 as part, cell, case when cell % 10 = 1 then 'Area ' || cell || ' - Total' else 'Block ' || cell end as label, park + 10 as total, gvi, elderly from cells)
 select cell, label, last_value(case when label like '%- Total' then replace(label, ' - Total', '') end ignore nulls) over (partition by part order by cell rows unbounded preceding) as parent, label like '%- Total' as is_parent, round(gvi / total, 6) as young_share, round((elderly + gvi) / total, 6) as old_share from l"""


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of files, as station readings."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern, as a stream's plain path must be a folder
    return e.filter("event_type = 'view'").selectExpr(f"{STATION} as station_id", f"timestamp_seconds({SPARK_EPOCH}) as event_time", "24 + (cast(floor(value * 100) as bigint) % 1000) / 1e2 as value", "event_id")


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there, and gives the last state of its result."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    kept: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        part = stored(batch, "stream-batch")
        kept[:] = [part] if mode == "complete" else [*kept, part]

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    out = _run(ST.tumbling_hour(_stream(spark, d), "value"), "complete")
    return out.select("station_id", F.unix_seconds("hour").alias("hour"), F.round("mean", 6).alias("mean"), "max", "min", "n")


STREAM_HOURLY = f"{duck('obs')} select station as station_id, t - t % 3600 as hour, round(avg(y), 6) as mean, max(y) as max, min(y) as min, count(y) as n from obs where kind = 'view' group by 1, 2"


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = _run(ST.sliding_3h(_stream(spark, d), "value"), "complete")
    return out.select("station_id", F.unix_seconds("at").alias("window_end"), F.round("mean_3h", 6).alias("mean_3h"))


STREAM_SLIDING = f"{duck('obs')}, e as (select station, y, unnest(range(t - t % 900 + 900, t - t % 900 + 900 + 10800, 900)) as window_end from obs where kind = 'view') select station as station_id, window_end, round(avg(y), 6) as mean_3h from e group by 1, 2"


def stream_silence(spark: SparkSession, d: str) -> DataFrame:
    out = _run(ST.silent_station(_stream(spark, d), "6 hours"), "complete")
    return out.groupBy("station_id").agg(F.count("*").alias("sessions"), F.sum("rows").alias("rows"), F.max(F.unix_seconds("silent_since")).alias("last"))


STREAM_SILENCE = f"""{duck('obs')}, g as (select station, t, case when t - lag(t) over (partition by station order by t) < 21600 then 0 else 1 end as s from obs where kind = 'view')
 select station as station_id, sum(s)::bigint as sessions, count(*) as rows, max(t) + 21600 as last from g group by station"""


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d).withColumn("slot", F.date_trunc("hour", "event_time"))
    return _run(ST.dedup_stream(s, ["station_id", "slot"], "60 days"), "append").groupBy("station_id").agg(F.count("*").alias("slots"))


STREAM_DEDUP = f"{duck('obs')} select station as station_id, count(distinct t // 3600) as slots from obs where kind = 'view' group by station"


def stream_alarms(spark: SparkSession, d: str) -> DataFrame:
    """Silences of stations beyond 30 and 90 minutes, told by timers; those at the end as far as the watermark reaches."""
    name, value = ST.ROCKSDB
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        return _run(ST.silence_alarms(_stream(spark, d)), "append")
    finally:
        spark.conf.set(name, before)


STREAM_ALARMS = f"""{duck('obs')}, e as (select distinct station, t from obs where kind = 'view'), g as (select station, t, coalesce(lead(t) over (partition by station order by t), (select max(t) from e) - 600) as until from e)
 select station as station_id, t as silent_since, t + 60 * minutes as alarm_at, minutes, level from g, (values (30::int, 'YELLOW'), (90, 'RED')) l(minutes, level) where t + 60 * minutes <= until"""


QUERIES = {
    "payload_v1": (payload_v1, V1), "payload_v2": (payload_v2, V2), "payload_weather": (payload_weather, WEATHER), "payload_any": (payload_any, ANY), "payload_hourly": (payload_hourly, HOURLY), "met_forcing": (met_forcing, FORCING), "ring_overlay": (ring_overlay, RING_OVERLAY),
    "ring_iou": (ring_iou, RING_IOU), "nearest_park": (nearest_park, NEAREST_PARK), "demographics": (demographics, DEMOGRAPHICS), "stream_hourly": (stream_hourly, STREAM_HOURLY), "stream_sliding": (stream_sliding, STREAM_SLIDING),
    "stream_silence": (stream_silence, STREAM_SILENCE), "stream_dedup": (stream_dedup, STREAM_DEDUP), "stream_alarms": (stream_alarms, STREAM_ALARMS),
}
