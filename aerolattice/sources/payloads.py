"""Readers of station, forecast and map payloads: JSON and text files to long tables, in Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ring_area, safe_double
from ..operators.tables import union_evolving

LOCATION = "struct<latitude:double,longitude:double>"
#: JSON v1: stations in the metadata, readings in items.
V1 = f"struct<metadata:struct<stations:array<struct<id:string,device_id:string,name:string,location:{LOCATION}>>,reading_type:string,reading_unit:string>,items:array<struct<timestamp:string,readings:array<struct<station_id:string,value:double>>>>>"
#: JSON v2: stations and readings in data.
V2 = f"struct<code:int,data:struct<stations:array<struct<id:string,deviceId:string,name:string,location:{LOCATION}>>,readings:array<struct<timestamp:string,data:array<struct<stationId:string,value:double>>>>,readingType:string,readingUnit:string>>"
#: JSON v2 weather: records, with station and place in each reading (one source misspells longitude).
WEATHER = "struct<data:struct<records:array<struct<datetime:string,updatedTimestamp:string,item:struct<readings:array<struct<station:struct<id:string,name:string,townCenter:string>,location:struct<latitude:string,longitude:string,longtitude:string>,heatStress:string,wbgt:string,value:string>>>>>>>"


def read_payloads(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Whole JSON files, one row each: ``payload, source_file, source_kind``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("source_file"), F.lit(kind).alias("source_kind")).filter(F.trim("payload") != "")


def read_tables(spark: SparkSession, paths: Sequence[str], kind: str) -> DataFrame:
    """CSV, JSON lines and JSON files (wrapped in records, data, items, observations or results) with text columns united
    by name; empty files give no rows."""
    parts = []
    for path in paths:
        plain = path.lower().removesuffix(".gz")
        if plain.endswith((".csv", ".txt")):
            df = spark.read.option("header", True).csv(path)
        else:
            df = spark.read.option("multiLine", plain.endswith(".json")).json(path)
            wrapped = [c for c in ("records", "data", "items", "observations", "results") if c in df.columns and df.schema[c].dataType.typeName() == "array"]
            if wrapped:
                df = df.select(F.explode(wrapped[0]).alias("x"), F.col("_metadata.file_path").alias("source_file")).select("x.*", "source_file")
        if "source_file" not in df.columns:
            df = df.withColumn("source_file", F.col("_metadata.file_path"))
        parts.append(df.withColumn("source_kind", F.lit(kind)))
    return union_evolving(parts)


def scan_long_archive(archive: DataFrame, variable: str) -> DataFrame:
    """One variable's complete rows; the filter reaches the scan."""
    return archive.filter(F.col("variable") == variable).na.drop(subset=["station_id", "timestamp", "value"])


def flatten_v1(payloads: DataFrame, variable: str) -> DataFrame:
    """Rows of readings, with the station's name and place by id; readings without a value stay."""
    j = payloads.select("*", F.from_json("payload", V1).alias("j"))
    by_id = F.map_from_entries(F.transform(F.array_distinct(F.coalesce("j.metadata.stations", F.array().cast(f"array<struct<id:string,device_id:string,name:string,location:{LOCATION}>>"))), lambda s: F.struct(s["id"], s)))
    rows = j.select("source_file", by_id.alias("s"), F.col("j.metadata.reading_unit").alias("unit"), F.explode_outer("j.items").alias("item"))
    rows = rows.select("source_file", "s", "unit", F.col("item.timestamp").alias("timestamp"), F.explode_outer("item.readings").alias("r"))
    return _long(rows, F.col("r.station_id"), F.col("r.value"), variable, "v1")


def flatten_v2(payloads: DataFrame, variable: str) -> DataFrame:
    j = payloads.select("*", F.from_json("payload", V2).alias("j"))
    by_id = F.map_from_entries(F.transform(F.array_distinct(F.coalesce("j.data.stations", F.array().cast(f"array<struct<id:string,deviceId:string,name:string,location:{LOCATION}>>"))), lambda s: F.struct(s["id"], s)))
    rows = j.select("source_file", by_id.alias("s"), F.col("j.data.readingUnit").alias("unit"), F.explode_outer("j.data.readings").alias("item"))
    rows = rows.select("source_file", "s", "unit", F.col("item.timestamp").alias("timestamp"), F.explode_outer("item.data").alias("r"))
    return _long(rows, F.col("r.stationId"), F.col("r.value"), variable, "v2")


def _long(rows: DataFrame, station: Column, value: Column, variable: str, version: str) -> DataFrame:
    at = F.try_element_at("s", station)
    return rows.filter(station.isNotNull()).select(
        F.lit(variable).alias("variable"), value.alias("value"), "unit", "timestamp", station.alias("station_id"), at["name"].alias("station_name"),
        at["location"]["latitude"].alias("station_lat"), at["location"]["longitude"].alias("station_lon"), F.lit(version).alias("api_version"), value.isNull().alias("value_missing"), "source_file",
    )


def flatten_weather(payloads: DataFrame, variable: str) -> DataFrame:
    """The wrapper with records: values are texts, and longitude may be misspelt."""
    j = payloads.select("*", F.from_json("payload", WEATHER).alias("j"))
    rows = j.select("source_file", F.explode("j.data.records").alias("rec")).select("source_file", "rec.datetime", "rec.updatedTimestamp", F.explode("rec.item.readings").alias("r"))
    value = safe_double(F.coalesce("r.wbgt", "r.value"))
    return rows.select(
        F.lit(variable).alias("variable"), value.alias("value"), F.coalesce("datetime", "updatedTimestamp").alias("timestamp"), F.col("r.station.id").alias("station_id"), F.col("r.station.name").alias("station_name"),
        F.col("r.station.townCenter").alias("station_town_center"), F.col("r.location.latitude").try_cast("double").alias("station_lat"), F.coalesce("r.location.longitude", "r.location.longtitude").try_cast("double").alias("station_lon"),
        F.col("r.heatStress").alias("heat_stress_category"), F.lit("v2_weather").alias("api_version"), value.isNull().alias("value_missing"), "source_file",
    )


def flatten_hourly(payloads: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Parallel arrays to a row for each hour; arrays that are too short give null."""
    inner = ",".join(["time:array<string>", *(f"{v}:array<double>" for v in variables)])
    j = payloads.select("*", F.from_json("payload", f"struct<latitude:double,longitude:double,elevation:double,hourly:struct<{inner}>>").alias("j"))
    zipped = F.arrays_zip(F.col("j.hourly.time").alias("time"), *(F.col(f"j.hourly.{v}").alias(v) for v in variables))
    return j.select("source_file", "j.latitude", "j.longitude", F.explode(zipped).alias("h")).filter("h.time is not null").select("source_file", "latitude", "longitude", "h.time", *(F.col(f"h.{v}").alias(v) for v in variables))


def flatten_map_elements(payloads: DataFrame, min_area: float = 5.0) -> DataFrame:
    """Map elements with ways: closed rings are polygons (of ``min_area`` at least, in the units of their coordinates
    times 111 320 m), others lines; tags stay a map."""
    schema = "struct<elements:array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>>"
    e = payloads.select("source_file", F.explode(F.from_json("payload", schema)["elements"]).alias("e")).filter("e.type = 'way' and size(e.geometry) >= 2")
    metres = 111_320.0
    ring = F.transform("e.geometry", lambda p: F.struct((p["lon"] * metres * F.cos(F.radians(p["lat"]))).alias("x"), (p["lat"] * metres).alias("y")))
    closed = (F.element_at("e.geometry", 1) == F.element_at("e.geometry", -1)) & (F.size("e.geometry") >= 4)
    out = e.select("source_file", F.col("e.id").alias("id"), F.col("e.tags").alias("tags"), ring.alias("ring"), F.when(closed, "polygon").otherwise("line").alias("shape"))
    out = out.withColumn("area_m2", F.when(F.col("shape") == "polygon", ring_area(F.col("ring"))).otherwise(F.lit(0.0)))
    return out.filter((F.col("shape") == "line") | (F.col("area_m2") >= min_area))


def read_features(payloads: DataFrame, properties: str) -> DataFrame:
    """A feature collection's properties (a DDL struct body), and for each polygon of a feature its outer ring, its ``shape``
    (all rings, the outline first, then holes), which ``part`` of a multipolygon it is (0 for polygons), and the name of the
    reference system (WGS 84 where none is named). Features without a ring are dropped."""
    schema = f"struct<crs:struct<properties:struct<name:string>>,features:array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>>"
    j = payloads.select("source_file", F.from_json("payload", schema).alias("j"))
    f = j.select("source_file", F.coalesce("j.crs.properties.name", F.lit("EPSG:4326")).alias("crs"), F.explode("j.features").alias("f"))
    rings = "array<array<array<double>>>"
    one, many = F.from_json("f.geometry.coordinates", rings), F.from_json("f.geometry.coordinates", f"array<{rings}>")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    f = f.select("source_file", "crs", "f.properties", F.posexplode(parts).alias("part", "rings")).filter("size(rings) > 0")
    shape = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return f.select("source_file", "properties.*", F.element_at(shape, 1).alias("ring"), "part", "crs", shape.alias("shape"))


def raster_to_pixels(df: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """Centres of pixels (row, col) of a grid whose north-west corner is (x0, y0)."""
    return df.withColumns({"x": x0 + (F.col("col") + 0.5) * res, "y": y0 - (F.col("row") + 0.5) * res})


def hours_to_met_forcing(df: DataFrame, station: str, day: int, hours: tuple[int, int]) -> DataFrame:
    """One station's hours of a day (days since 1970) as a forcing table: year, day of year, hour, constants, bounds."""
    h = F.floor(F.pmod("t", F.lit(86400)) / 3600).cast("int")
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / 86400).cast("int"))
    rows = df.filter((F.col("station") == station) & (F.floor(F.col("t") / 86400) == day) & h.between(*hours))
    return rows.select(
        F.year(date).alias("iy"), F.dayofyear(date).alias("id"), h.alias("it"), F.lit(0).alias("imin"), F.greatest(F.coalesce("wind", F.lit(0.5)), F.lit(0.5)).alias("wind"), F.col("rh"), F.col("temp"),
        F.lit(1010.0).alias("pressure"), F.lit(-999.0).alias("rain"), F.lit(270.0).alias("wind_direction"), F.col("sw").alias("kdown"), (F.coalesce("cloud", F.lit(0.0)) / 100.0).alias("cloud"),
    ).orderBy("it")


def merge_csvs(spark: SparkSession, path: str, column: str, value: str, required: Sequence[str]) -> DataFrame:
    """CSV files with one header, one kind of row, complete in the required columns."""
    return spark.read.option("header", True).csv(path).filter(F.col(column) == value).na.drop(subset=list(required))


# Where readings, station lists, times and values lie in the versions of the payload; the first path that is
# there counts.
ITEMS = ("$.data.readings", "$.data.records", "$.items")
STATIONS = ("$.data.stations", "$.metadata.stations")
TIMES = ("$.timestamp", "$.datetime", "$.updatedTimestamp")
READINGS_OF_ITEM = ("$.data", "$.readings", "$.item.readings")
STATION_OF_READING = ("$.stationId", "$.station_id", "$.station.id")
VALUE_OF_READING = ("$.value", "$.wbgt")
UNITS = ("$.data.readingUnit", "$.metadata.reading_unit")
#: Fields of a reading that some version is known to have.
KNOWN_FIELDS = ("stationId", "station_id", "station", "value", "wbgt", "heatStress", "location")


def first_path(v: Column, paths: Sequence[str], kind: str) -> Column:
    """The value at the first of the paths where it is, and can be read as ``kind``."""
    return F.coalesce(*(F.try_variant_get(v, p, kind) for p in paths))


def flatten_any(payloads: DataFrame, variable: str) -> DataFrame:
    """Long rows of payloads of any known version, mixed in one table: ``variable, value, unit, timestamp, station_id,
    station_name, value_missing, unread, source_file``. Documents are parsed once, without a schema; each field is looked for
    along its paths, and values come as numbers or texts. ``unread`` counts fields of a reading that no version is known to
    have, so that a change of the source shows. Texts that aren't JSON, documents without readings and readings without a
    station give no rows."""
    doc = payloads.select("source_file", F.try_parse_json("payload").alias("v"))
    names = F.map_from_entries(F.array_compact(F.transform(F.coalesce(first_path(F.col("v"), STATIONS, "array<variant>"), F.array().cast("array<variant>")), lambda s: F.when(F.try_variant_get(s, "$.id", "string").isNotNull(), F.struct(F.try_variant_get(s, "$.id", "string").alias("id"), F.try_variant_get(s, "$.name", "string").alias("name"))))))
    doc = doc.select("source_file", first_path(F.col("v"), UNITS, "string").alias("unit"), F.explode(first_path(F.col("v"), ITEMS, "array<variant>")).alias("item"), names.alias("names"))
    rows = doc.select("source_file", "unit", "names", first_path(F.col("item"), TIMES, "string").alias("timestamp"), F.explode(first_path(F.col("item"), READINGS_OF_ITEM, "array<variant>")).alias("r"))
    fields = F.map_keys(F.try_variant_get("r", "$", "map<string, variant>"))
    value = F.coalesce(*(safe_double(F.try_variant_get("r", p, "string")) for p in VALUE_OF_READING))
    station = first_path(F.col("r"), STATION_OF_READING, "string")
    rows = rows.select("source_file", "unit", "names", "timestamp", station.alias("station_id"), value.alias("value"), F.try_variant_get("r", "$.station.name", "string").alias("own_name"), F.size(F.filter(fields, lambda f: ~f.isin(*KNOWN_FIELDS))).alias("unread"))
    return rows.filter("station_id is not null").select(
        F.lit(variable).alias("variable"), "value", "unit", "timestamp", "station_id", F.coalesce("own_name", F.try_element_at("names", F.col("station_id"))).alias("station_name"), F.col("value").isNull().alias("value_missing"), "unread", "source_file",
    )


def payload_shapes(payloads: DataFrame) -> DataFrame:
    """``source_file, documents, bad, shape``: for each file how many documents it has, how many aren't JSON, and the schema
    that covers the others, merged over all of them."""
    v = payloads.select("source_file", F.try_parse_json("payload").alias("v"))
    return v.groupBy("source_file").agg(F.count("*").alias("documents"), F.count_if(F.col("v").isNull()).alias("bad"), F.schema_of_variant_agg("v").alias("shape"))
