"""Readers, sinks, archives, table utilities and streams that ``ingest`` doesn't cover. Files are written from the driver's
tables to the shared folder and read back, so that their rows are known."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming as ST
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import calibration as C
from ..operators import geo as G
from ..operators import pairing as J
from ..operators import tables as TB
from ..session import shared_dir, stored
from ..sources import archive as AR
from ..sources import commits as CM
from ..sources import payloads as P
from .adapters import SPARK_EPOCH, STATION, adapter, duck
from .ingest import PLACE, READINGS, _readings, _ringed, _run


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _day(epoch: str = "t") -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(epoch) / 86400).cast("int"))


def read_tables(spark: SparkSession, d: str) -> DataFrame:
    """A third of the events each as CSV, as JSON lines and as wrapped JSON documents of some thousand records."""
    base = _folder(spark, "tables")
    rows = _events(spark, d).select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("value").cast("string").alias("value"), F.pmod("event_id", F.lit(3)).alias("part"))
    rows.filter("part = 0").drop("part").write.option("header", True).csv(f"{base}/a.csv")
    rows.filter("part = 1").drop("part").write.json(f"{base}/b.jsonl")
    docs = rows.filter("part = 2").groupBy(F.floor(F.col("event_id").cast("long") / 5000).alias("k")).agg(F.to_json(F.struct(F.collect_list(F.struct("event_id", "event_type", "value")).alias("records"))).alias("value"))
    docs.repartition("k").write.partitionBy("k").text(f"{base}/c.json")
    out = P.read_tables(spark, [f"{base}/a.csv", f"{base}/b.jsonl", f"{base}/c.json"], "made")
    return out.select(F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("value").cast("double").alias("value"), "source_kind")


READ_TABLES = "select event_id, event_type, value, 'made' as source_kind from events"


def scan_long_archive(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").select(F.col("station").alias("station_id"), F.col("t").alias("timestamp"), F.col("kind").alias("variable"), F.when(F.col("row_id") % 5 != 0, F.col("y")).alias("value"), "row_id")
    return P.scan_long_archive(stored(o, "long-archive"), "view")


SCAN = f"{duck('obs')} select station as station_id, t as timestamp, kind as variable, y as value, row_id from obs where kind = 'view' and row_id % 5 <> 0"


def map_elements(spark: SparkSession, d: str) -> DataFrame:
    point = lambda x, y: F.struct((F.col(y) / 111_320.0).alias("lat"), (F.col(x) / 111_320.0).alias("lon"))
    corners = [point(x, y) for x, y in (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"), ("x_min", "y_min"))]
    way = F.struct(F.when(F.col("box") % 11 == 0, "node").otherwise("way").alias("type"), F.col("box").alias("id"), F.create_map(F.lit("building"), F.col("type")).alias("tags"), F.when(F.col("box") % 3 == 0, F.array(*corners[:2])).otherwise(F.array(*corners)).alias("geometry"))
    docs = adapter(spark, d, "boxes").select(F.to_json(F.struct(F.array(way).alias("elements"))).alias("payload"), F.lit("made").alias("source_file"))
    out = P.flatten_map_elements(docs, 500.0)
    return out.select("id", F.col("tags")["building"].alias("building"), "shape", F.round("area_m2", 3).alias("area_m2"), F.size("ring").alias("points"))


MAP_ELEMENTS = f"""{duck('boxes')}, e as (select box as id, type as building, box % 3 <> 0 as closed, (10 + size) * (10 + size) * (cos(radians(y_min / 111320)) + cos(radians(y_max / 111320))) / 2 as a from boxes where box % 11 <> 0)
 select id, building, case when closed then 'polygon' else 'line' end as shape, case when closed then round(a, 3) else 0 end as area_m2, case when closed then 5 else 2 end as points from e where not closed or a >= 500"""


def map_features(spark: SparkSession, d: str) -> DataFrame:
    ring = lambda dx: F.array(*(F.array(F.col(x) + dx, F.col(y)) for x, y in (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"), ("x_min", "y_min"))))
    text = lambda c: F.to_json(c)
    coordinates = F.when(F.col("box") % 4 == 0, text(F.array(F.array(ring(0.0)), F.array(ring(1000.0))))).otherwise(text(F.array(ring(0.0))))
    geometry = F.when(F.col("box") % 7 == 0, "null").otherwise(F.concat(F.lit('{"type":"'), F.when(F.col("box") % 4 == 0, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), coordinates, F.lit("}")))
    crs = F.when(F.col("box") % 2 == 0, '"crs":{"properties":{"name":"EPSG:3414"}},').otherwise("")
    doc = F.concat(F.lit("{"), crs, F.lit('"features":[{"properties":{"box":'), F.col("box").cast("string"), F.lit("},\"geometry\":"), geometry, F.lit("}]}"))
    rows = P.read_features(adapter(spark, d, "boxes").select(doc.alias("payload"), F.lit("made").alias("source_file")), "box:long")
    return rows.select("box", "part", "crs", F.round(S.ring_area(F.col("ring")), 6).alias("area"), F.array_min(F.transform("ring", lambda p: p["x"])).alias("west"))


MAP_FEATURES = f"""{duck('boxes')} select box, p::int as part, case when box % 2 = 0 then 'EPSG:3414' else 'EPSG:4326' end as crs, power(10 + size, 2)::double as area, x_min + 1000 * p as west
 from boxes, range(0, 2) r(p) where box % 7 <> 0 and (p = 0 or box % 4 = 0)"""


def pixel_centres(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 500).alias("row"), (F.col("l_partkey") % 500).alias("col"))
    return P.raster_to_pixels(p, 1000.0, 5000.0, 2.0).groupBy("row", "col", "x", "y").agg(F.count("*").alias("n"))


PIXEL_CENTRES = """select l_orderkey % 500 as "row", l_partkey % 500 as col, 1000 + (l_partkey % 500 + 0.5::double) * 2 as x, 5000 - (l_orderkey % 500 + 0.5::double) * 2 as y, count(*) as n from lineitem group by 1, 2, 3, 4"""


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return adapter(spark, d, "obs").select(F.col("station").alias("station_id"), F.col("kind").alias("variable"), F.col("y").alias("value"), "row_id", _day().alias("obs_date"))


def archive_appends(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _folder(spark, "appended"), _dated(spark, d)
    AR.partitioned_append(rows.filter("row_id % 2 = 0"), path)
    AR.partitioned_append(rows.filter("row_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy(F.col("obs_date").cast("string").alias("obs_date"), "variable").agg(F.count("*").alias("rows"), F.sum("row_id").alias("ids"))


APPENDS = f"{duck('obs')} select strftime(date '1970-01-01' + (t // 86400)::int, '%Y-%m-%d') as obs_date, kind as variable, count(*) as rows, sum(row_id)::bigint as ids from obs group by 1, 2"


def archive_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two upserts into a partitioned archive: what is there afterwards, beside the number of keys added."""
    path, rows = _folder(spark, "merged"), _dated(spark, d)
    AR.merge_into_archive(spark, rows.filter("row_id % 3 <> 0"), path, ["station_id", "variable"], ["row_id"])
    added = AR.merge_into_archive(spark, rows.filter("row_id % 2 = 0"), path, ["station_id", "variable"], ["row_id"])
    out = spark.read.parquet(path).groupBy("variable").agg(F.count("*").alias("rows"), F.sum("row_id").alias("last_ids"))
    return out.crossJoin(F.broadcast(added.select("rows_added")))


MERGED = f"""{duck('obs')}, o as (select station, kind, row_id, t // 86400 as d from obs where row_id % 3 <> 0 or row_id % 2 = 0), k as (select station, kind, d, max(row_id) as r from o group by all),
 n as (select count(*) as rows_added from (select distinct station, kind, t // 86400 from obs where row_id % 2 = 0 except select station, kind, t // 86400 from obs where row_id % 3 <> 0))
 select kind as variable, count(*) as rows, sum(r)::bigint as last_ids, max(rows_added) as rows_added from k cross join n group by kind"""


def archive_commits(spark: SparkSession, d: str) -> DataFrame:
    """Batches of three parts of the observations, each committed as one version; the last version's rows."""
    rows = _dated(spark, d)
    archive = CM.Archive(spark, _folder(spark, "committed"))
    for k in range(3):
        version, added = archive.commit(rows.filter(F.pmod("row_id", F.lit(3)) == k), ["station_id", "variable"], ["row_id"])
    out = archive.read(rows.schema).groupBy("variable").agg(F.count("*").alias("rows"), F.sum("row_id").alias("last_ids"), F.countDistinct("obs_date").alias("days"))
    return out.withColumns({"version": F.lit(version).cast("long"), "added_last": F.lit(added).cast("long")})


COMMITS = f"""{duck('obs')}, k as (select station, kind, t // 86400 as d, max(row_id) as r from obs group by all),
 n as (select count(*) as added from (select distinct station, kind, t // 86400 from obs where row_id % 3 = 2 except select station, kind, t // 86400 from obs where row_id % 3 <> 2))
 select kind as variable, count(*) as rows, sum(r)::bigint as last_ids, count(distinct d) as days, 3::bigint as version, max(added) as added_last from k cross join n group by kind"""


def weekly_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct stations and hours of each week from stored daily sketches: whether they are within three standard errors of
    the exact counts, which are given too."""
    o = adapter(spark, d, "obs").select("kind", F.floor(F.col("t") / 86400).alias("day"), "station", F.floor(F.col("t") / 3600).alias("hour"), "row_id")
    daily = stored(A.daily_sketches(o, "day", ["station", "hour", "row_id"], ["kind"]), "daily-sketches")
    weeks = A.united_counts(daily.withColumn("week", F.floor(F.col("day") / 7)), ["station", "hour", "row_id"], ["kind", "week"])
    exact = o.groupBy("kind", F.floor(F.col("day") / 7).alias("week")).agg(F.countDistinct("station").alias("stations"), F.countDistinct("hour").alias("hours"), F.countDistinct("row_id").alias("ids"))
    near = lambda got, want: F.abs(F.col(got) - F.col(want)) <= F.greatest(F.lit(1.0), 3 * 0.01625 * F.col(want))
    both = weeks.join(exact, ["kind", "week"])
    return both.select("kind", "week", "rows", "stations", "hours", "ids", (near("station_count", "stations") & near("hour_count", "hours") & near("row_id_count", "ids")).alias("near"))


WEEKLY = f"{duck('obs')} select kind, t // 86400 // 7 as week, count(*) as rows, count(distinct station) as stations, count(distinct t // 3600) as hours, count(distinct row_id) as ids, true as near from obs group by 1, 2"


def clustered_window(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in files of neighbours, and those that meet a window, read by its bounds."""
    path = _folder(spark, "clustered")
    G.write_clustered(adapter(spark, d, "boxes"), path, 8)
    return J.clip_to_box(spark.read.parquet(path), (1000.0, 1200.0, 1900.0, 2100.0), 25.0).select("box", "x_min", "y_max", "type")


WINDOW_SQL = f"{duck('boxes')} select box, x_min, y_max, type from boxes where x_max >= 975 and x_min <= 1925 and y_max >= 1175 and y_min <= 2125"


def archive_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Observations as one good archive and one with broken lines, counted by kind."""
    base = _folder(spark, "inventory")
    o = adapter(spark, d, "obs").select("row_id", "station", F.round("y", 2).alias("y"))
    o.write.json(f"{base}/good")
    o.select(F.when(F.col("row_id") % 97 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("row_id", "station"))).alias("value")).write.text(f"{base}/mixed")
    read = lambda name, schema: spark.read.schema(f"{schema}, _corrupt_record string").json(f"{base}/{name}")
    out = AR.inventory_by_kind({"good": read("good", "row_id long, station string, y double"), "mixed": read("mixed", "row_id long, station string")})
    return out.select("kind", "rows", "known", "columns", "bad_rows")


INVENTORY = f"{duck('obs')} select 'good' as kind, count(*) as rows, count(*) as known, 3 as columns, 0 as bad_rows from obs union all select 'mixed', count(*), count(*) filter (row_id % 97 <> 0), 2, count(*) filter (row_id % 97 = 0) from obs"


def merge_csvs(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file for each fifty users, written by one task; one type is kept, rows without a value go."""
    base = _folder(spark, "csvs")
    e = _events(spark, d).select("event_id", "event_type", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("value"), F.floor(F.col("user_id") / 50).alias("k"))
    e.repartition("k").write.partitionBy("k").option("header", True).csv(base)
    return P.merge_csvs(spark, base, "event_type", "purchase", ["value"]).select(F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))


MERGE_CSVS = "select event_id, value from events where event_type = 'purchase' and event_id % 6 <> 0 and value is not null"


def feature_sink(spark: SparkSession, d: str) -> DataFrame:
    cells = adapter(spark, d, "cells").select("cell", "land_use")
    features, missing = AR.feature_sink(cells, _ringed(spark, d).filter("box % 3 <> 0").select(F.col("box").alias("cell"), "ring"), "cell")
    path = _folder(spark, "features")
    features.write.text(path)
    j = lambda p: F.get_json_object("value", p)
    back = spark.read.text(path).select(j("$.properties.cell").cast("long").alias("cell"), j("$.properties.land_use").alias("land_use"), j("$.geometry.type").alias("shape"), j("$.geometry.coordinates[0][0][0]").cast("double").alias("west"))
    return back.unionByName(missing.select("cell", "land_use", F.lit(None).cast("string").alias("shape"), F.lit(None).cast("double").alias("west")))


FEATURE_SINK = f"{duck('cells', 'boxes')} select cell, land_use, case when box is not null then 'Polygon' end as shape, x_min as west from cells left join boxes on box = cell and box % 3 <> 0"


def retain_days(spark: SparkSession, d: str) -> DataFrame:
    return AR.retain_days(_dated(spark, d), "obs_date", 7).select("row_id", F.col("obs_date").cast("string").alias("obs_date"))


RETAIN = f"{duck('obs')} select row_id, strftime(date '1970-01-01' + (t // 86400)::int, '%Y-%m-%d') as obs_date from obs where t // 86400 > (select max(t // 86400) from obs) - 7"


def tolerant_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns found under other names, added, copied under an alias, and made unique."""
    c = adapter(spark, d, "cells").select(F.col("cell").alias("Cell-ID"), F.col("svf").alias("SVF"), "shade")
    c = c.withColumnRenamed(TB.first_present(c, ["cell_id", "id"]), "cell").withColumnRenamed(TB.first_present(c, ["sky_view", "svf"]), "svf")
    c = TB.alias_columns(TB.ensure_columns(c, {"cell": F.lit(None), "zone": F.lit("unknown"), "park": F.lit(9999.0)}), {"svf": "sky_view_factor", "shade_fraction": "shade"})
    return TB.dedupe_column_names(c.select(*c.columns, "svf"))


COLUMNS = f"{duck('cells')} select cell, 'unknown' as zone, 9999::double as park, svf, shade, svf as sky_view_factor, shade as shade_fraction, svf as svf__dup1 from cells"


def filter_modes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and mean of each of the five filters, one station left out."""
    o = adapter(spark, d, "obs").select("row_id", "station", "y", F.when(F.col("row_id") % 5 != 0, F.col("p")).alias("p"), (F.col("row_id") % 3 != 0).alias("has_match"), (F.col("row_id") % 2 == 0).alias("used"), F.when(F.col("row_id") % 4 == 0, "old_1").otherwise("v11_2").alias("run"))
    o = C.pairing_flags(o, ["p"], "run", "v11%")
    out = None
    for mode in C.FILTER_MODES:
        part = C.filter_mode(o, mode, ["S104"]).agg(F.lit(mode).alias("mode"), F.count("*").alias("rows"), F.round(F.avg("y"), 6).alias("mean"))
        out = part if out is None else out.unionByName(part)
    return out


MODES = f"""{duck('obs')}, o as (select * from obs where station <> 'S104'), f as (select 'all' as mode, y from o union all select 'retrospective_calibration', y from o where row_id % 3 <> 0 and row_id % 5 <> 0 union all select 'collector_pair_used', y from o where row_id % 2 = 0
 union all select 'fresh_only', y from o where row_id % 4 <> 0 union all select 'migrated_only', y from o where row_id % 4 = 0) select mode, count(*) as rows, round(avg(y), 6) as mean from f group by mode"""


def wbgt_only(spark: SparkSession, d: str) -> DataFrame:
    """The long and the wide form of the same rows give the same result."""
    o = adapter(spark, d, "obs").select("row_id", F.col("kind").alias("variable"), F.when(F.col("row_id") % 7 != 0, F.col("y")).alias("value"), F.when(F.col("row_id") % 5 != 0, 1.3).alias("station_lat"), F.lit(103.8).alias("station_lon"))
    wide = o.filter("variable = 'view'").select("row_id", F.col("value").alias("view"), "station_lat", "station_lon")
    return TB.wbgt_only(o, "view").select("row_id", "view", F.lit("long").alias("form")).unionByName(TB.wbgt_only(wide, "view").select("row_id", "view", F.lit("wide").alias("form")))


WBGT_ONLY = f"{duck('obs')} select row_id, y as view, form from obs cross join (values ('long'), ('wide')) v(form) where kind = 'view' and row_id % 7 <> 0 and row_id % 5 <> 0"


def inner_pair(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").select("row_id", "station", (F.col("t") - F.pmod("t", F.lit(3600))).alias("t"), "y")
    return J.inner_pair(adapter(spark, d, "weather").select("station", "t", "temp"), o, ["station", "t"])


INNER_PAIR = f"{duck('obs', 'weather')} select o.station, w.t, w.temp, o.row_id, o.y from obs o join weather w on w.station = o.station and w.t = o.t - o.t % 3600"


def nearest_cell(spark: SparkSession, d: str) -> DataFrame:
    s = adapter(spark, d, "obs").select("station").distinct().withColumn("n", F.substring("station", 2, 3).cast("int"))
    s = s.select("station", (1.3 + (F.col("n") - 100) * 0.004).alias("slat"), (103.8 + (F.col("n") - 100) * 0.001).alias("slon"))
    g = adapter(spark, d, "cells").select("cell", (1.3 + F.col("y") / 111_320.0).alias("lat"), (103.8 + F.col("x") / 111_320.0).alias("lon"), "svf", "shade")
    return J.nearest_cell(s, g, "cell", ["svf", "shade"]).withColumn("nearest_grid_distance_m", F.round("nearest_grid_distance_m", 4))


NEAREST_CELL = f"""{duck('obs', 'cells')}, s as (select station, 1.3 + (substr(station, 2, 3)::int - 100) * 0.004 as slat, 103.8 + (substr(station, 2, 3)::int - 100) * 0.001 as slon from (select distinct station from obs)),
 g as (select cell, 1.3 + y / 111320.0 as lat, 103.8 + x / 111320.0 as lon, svf, shade from cells), h as (select *, power(sin(radians(lat - slat) / 2), 2) + cos(radians(slat)) * cos(radians(lat)) * power(sin(radians(lon - slon) / 2), 2) as a from s cross join g),
 r as (select *, 2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)) as dist from h), k as (select *, row_number() over (partition by station order by dist, cell) as k from r)
 select station, cell as nearest_grid_cell, round(dist, 4) as nearest_grid_distance_m, case when dist <= 1000 then 'local_grid_proxy' when dist <= 3000 then 'nearby_grid_proxy' else 'regional_distance_not_representative' end as morphology_representativeness,
 svf as station_nearest_grid_svf, shade as station_nearest_grid_shade from k where k = 1"""


def local_times(spark: SparkSession, d: str) -> DataFrame:
    """Times written in UTC, with two offsets, in local time without a zone, and as something else."""
    e = _events(spark, d).selectExpr("event_id", f"{SPARK_EPOCH} as t").withColumn("kind", F.pmod("event_id", F.lit(5)))
    text = lambda shift, tail: F.concat(F.date_format(F.timestamp_seconds(F.col("t") + shift), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(tail))
    written = F.when(F.col("kind") == 0, text(0, "Z")).when(F.col("kind") == 1, text(8 * 3600, "+08:00")).when(F.col("kind") == 2, text(-5400, "-01:30")).when(F.col("kind") == 3, text(8 * 3600, "")).otherwise("not a time")
    return e.select("event_id", S.to_local_epoch(written).alias("local"), S.round_half_even(S.to_local_epoch(written), 900).alias("local_15"))


LOCAL_TIMES = """with e as (select event_id, case when event_id % 5 < 4 then date_diff('second', timestamp '1970-01-01 00:00:00', ts) + 28800 end as t from events)
 select event_id, t as local, 900 * (t // 900 + case when t % 900 > 450 or (t % 900 = 450 and t // 900 % 2 = 1) then 1 else 0 end) as local_15 from e"""
_TAGS = ["Covered Walkway 3", "highway footbridge", "MRT track", "bus station canopy", "PIE flyover", "Expressway slip", "bridge over canal", "LRT rail bridge", "plain wall", "linkway to bridge", "platform roof"]


def overhead_types(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", F.element_at(F.array(*map(F.lit, _TAGS)), (F.col("p_partkey") % len(_TAGS) + 1).cast("int")).alias("tag"))
    given = F.when(F.col("p_partkey") % 13 == 0, "Elevated Rail").when(F.col("p_partkey") % 13 == 1, "tunnel").when(F.col("p_partkey") % 13 == 2, " viaduct ")
    return p.select("p_partkey", S.overhead_type(F.col("tag"), F.col("p_name"), explicit=given).alias("overhead_type"))


_RULES = " ".join("when " + " or ".join(f"contains(tags, '{w}')" for w in words) + f" then '{label}'" for label, words in S.OVERHEAD)
OVERHEAD = f"""with p as (select p_partkey, lower([{', '.join(f"'{t}'" for t in _TAGS)}][p_partkey % {len(_TAGS)} + 1] || ' ' || p_name) as tags from part)
 select p_partkey, case p_partkey % 13 when 0 then 'elevated_rail' when 2 then 'viaduct' else case {_RULES} else 'unknown_overhead' end end as overhead_type from p"""


def hours_from_names(spark: SparkSession, d: str) -> DataFrame:
    two = F.lpad(F.pmod("event_id", F.lit(31)).cast("string"), 2, "0")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a/tmrt_h"), two, F.lit("/x.tif"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("shadow_"), two, F.lit("00D.tif"))).otherwise(F.concat(F.lit("plain"), two))
    return _events(spark, d).select("event_id", S.hour_from_name(name).alias("hour"))


HOURS = "select event_id, case when event_id % 3 < 2 and event_id % 31 < 24 then (event_id % 31)::int end as hour from events"


def fill_sources(spark: SparkSession, d: str) -> DataFrame:
    y = F.when(F.col("row_id") % 4 != 0, F.col("y"))
    return adapter(spark, d, "obs").select(S.fill_source(y, F.concat(F.lit("station:"), F.col("kind"))).alias("source"), y.isNull().alias("value_missing"), y.alias("y")).groupBy("source", "value_missing").agg(F.count("*").alias("rows"), F.round(F.sum("y"), 4).alias("total"))


FILL = f"{duck('obs')}, o as (select case when row_id % 4 = 0 then 'missing' else 'station:' || kind end as source, row_id % 4 = 0 as value_missing, case when row_id % 4 <> 0 then y end as y from obs) select source, value_missing, count(*) as rows, round(sum(y), 4) as total from o group by 1, 2"


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """A grid over the nodes' extent, which is no multiple of its size, with the nodes in each cell."""
    n = adapter(spark, d, "nodes").select("nx", "ny")
    top = n.agg(F.max("nx").alias("x"), F.max("ny").alias("y")).first()  # one row
    grid = G.make_grid(spark, (0.0, 0.0, top.x + 130.0, top.y + 40.0), 300.0, "G", (1.3, 103.8))
    held = n.groupBy(F.floor(F.col("nx") / 300).alias("col"), F.floor(F.col("ny") / 300).alias("row")).agg(F.count("*").alias("nodes"))
    return grid.join(held, ["row", "col"], "left").select("cell", "x", "y", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.coalesce("nodes", F.lit(0)).alias("nodes"))


GRID = f"""{duck('nodes')}, m as (select max(nx) + 130 as x1, max(ny) + 40 as y1 from nodes), c as (select i * 300.0::double as x from m, range(0, 100) r(i) where i * 300 + 150 <= x1), w as (select j * 300.0::double as y from m, range(0, 100) r(j) where j * 300 + 150 <= y1),
 g as (select x, y, row_number() over (order by y, x) as k from c cross join w) select 'G' || lpad(k::varchar, 6, '0') as cell, x, y, round(1.3 + (y + 150) / 111320.0, 9) as lat, round(103.8 + (x + 150) / (111320.0 * cos(radians(1.3))), 9) as lon,
 (select count(*) from nodes where floor(nx / 300) * 300 = x and floor(ny / 300) * 300 = y) as nodes from g"""


def standard_sources(spark: SparkSession, d: str) -> DataFrame:
    b, s = adapter(spark, d, "boxes").select("box", "label", "size"), spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name")
    out = TB.standardise_sources({
        "official": (b, {"id": F.concat(F.lit("o"), F.col("box").cast("string")), "kind": F.col("label"), "height_m": F.col("size").cast("double")}, 1),
        "volunteered": (s, {"id": F.concat(F.lit("v"), F.col("s_suppkey").cast("string")), "name": F.col("s_name")}, 3),
    })
    return out.select("id", "kind", "height_m", "name", "source_name", "source_priority", F.coalesce(F.get_json_object("raw", "$.box"), F.get_json_object("raw", "$.s_suppkey")).cast("long").alias("raw_key"))


STANDARD = f"""{duck('boxes')} select 'o' || box as id, label as kind, size::double as height_m, null as name, 'official' as source_name, 1 as source_priority, box as raw_key from boxes
 union all select 'v' || s_suppkey, null, null, s_name, 'volunteered', 3, s_suppkey from supplier"""


def _buildings(spark: SparkSession, d: str) -> DataFrame:
    return adapter(spark, d, "boxes").select("box", F.col("size").cast("double").alias("height_m"))


def corrections(spark: SparkSession, d: str) -> DataFrame:
    """Buildings after adjustments, removals and moves; the log's counts stand beside them under their own names."""
    b = _buildings(spark, d)
    decision = F.when(F.col("box") % 10 == 0, "height_adjust").when(F.col("box") % 10 == 1, "remove").when(F.col("box") % 10 == 2, "move_to_overhead").otherwise("repaint")
    changes = b.filter("box % 10 < 4").select((F.col("box") + F.when(F.col("box") % 20 == 11, 10_000_000).otherwise(0)).alias("target_id"), decision.alias("decision"), F.when(F.col("box") % 10 == 0, F.col("height_m") + 3).alias("height"))
    out, log = TB.apply_corrections(b, changes, "box")
    status = log.groupBy("decision", "status").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
    return status.unionByName(out.agg(F.lit("buildings").alias("decision"), F.lit("kept").alias("status"), F.count("*").alias("n"), F.sum("height_m").alias("total")))


CORRECTIONS = f"""{duck('boxes')}, c as (select case box % 10 when 0 then 'height_adjust' when 1 then 'remove' when 2 then 'move_to_overhead' else 'repaint' end as decision, case when box % 10 = 3 then 'unsupported' when box % 20 = 11 then 'not_found' else 'applied' end as status from boxes where box % 10 < 4)
 select decision, status, count(*) as n, null::double as total from c group by 1, 2 union all select 'buildings', 'kept', count(*), sum(size + case when box % 10 = 0 then 3 else 0 end)::double from boxes where not (box % 10 = 1 and box % 20 <> 11) and box % 10 <> 2"""


def reviewed_footprints(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts that a review accepts, buildings that pieces replace, and footprints drawn anew."""
    b = _buildings(spark, d)
    base, apart = b.filter("box % 5 <> 0"), b.filter("box % 5 = 0").withColumn("height_m", F.when(F.col("box") % 3 == 0, F.col("height_m")))
    decisions = apart.filter("box % 2 = 0").select(F.col("box").alias("target_id"), F.lit("merge_conflict").alias("decision"), F.when(F.col("box") % 4 == 0, 21.0).alias("height"))
    decisions = decisions.unionByName(base.filter("box % 6 = 1").select(F.col("box").alias("target_id"), F.lit("split_complex").alias("decision"), F.lit(9.0).alias("height")))
    pieces = base.filter("box % 12 = 1").select((F.col("box") * 10 + 1_000_000).alias("box"), F.col("box").alias("parent_id"), F.lit(None).cast("double").alias("height_m")).unionByName(base.filter("box % 12 = 1").select((F.col("box") * 10 + 1_000_001).alias("box"), F.col("box").alias("parent_id"), F.col("height_m")))
    missing = b.filter("box % 50 = 7").select((F.col("box") + F.when(F.col("box") % 100 == 7, 0).otherwise(5_000_000)).alias("box"), F.lit(-1.0).alias("height_m"))
    out, log = TB.merge_reviewed(base, decisions, "box", apart, pieces, missing)
    status = log.groupBy(F.concat_ws(":", "decision", "status").alias("change")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
    return status.unionByName(out.groupBy("change").agg(F.count("*").alias("n"), F.sum("height_m").alias("total")))


REVIEWED = f"""{duck('boxes')}, b as (select box, size::double as h, box % 5 <> 0 as base from boxes),
 o as (select 'kept' as change, h from b where base and box % 12 <> 1 union all select 'merge_conflict', case when box % 4 = 0 then 21 when box % 3 = 0 then h else 10 end from b where not base and box % 2 = 0
  union all select 'split_complex', 9 from b where base and box % 12 = 1 union all select 'split_complex', h from b where base and box % 12 = 1 union all select 'add_missing', 10 from b where box % 50 = 7 and box % 100 <> 7)
 select change, count(*) as n, sum(h) as total from o group by change union all select 'merge_conflict:applied', count(*), null from b where not base and box % 2 = 0 having count(*) > 0
 union all select 'split_complex:applied', count(*), null from b where base and box % 12 = 1 having count(*) > 0 union all select 'split_complex:not_found', count(*), null from b where base and box % 12 = 7 having count(*) > 0"""


def qa_targets(spark: SparkSession, d: str) -> DataFrame:
    """Buildings to review by three rules and cells by two, the best of each type."""
    b = adapter(spark, d, "boxes").select(F.concat(F.lit("b"), F.col("box").cast("string")).alias("id"), F.lit("building").alias("target_type"), F.pow(10 + F.col("size"), 2).alias("area"), "label", "priority")
    c = adapter(spark, d, "cells").select(F.concat(F.lit("c"), F.col("cell").cast("string")).alias("id"), F.lit("cell").alias("target_type"), F.lit(0.0).alias("area"), "density", "shade")
    parts = {"large_low_conf": b.filter("area >= 2000 and priority = 3"), "transport_like": b.filter(F.col("label").contains("STEEL") & (F.col("area") >= 1000)), "very_large": b.filter("area >= 3000"), "negative_gain": c.filter("density < 0.2"), "old_top_hazard": c.filter("shade < 0.1")}
    kind = F.col("category")
    score = F.least(F.col("area") / 1000.0, F.lit(10.0)) + F.when(kind.contains("large_low_conf"), 8.0).otherwise(0.0) + F.when(kind.contains("transport"), 7.0).otherwise(0.0) + F.when(kind.contains("negative_gain"), 5.0).otherwise(0.0) + F.when(kind.contains("old_top_hazard"), 5.0).otherwise(0.0)
    return TB.qa_targets(parts, "id", score, {"building": 250, "cell": 150}).select("id", "target_type", "category", F.round("priority", 6).alias("priority"))


QA_TARGETS = f"""{duck('boxes', 'cells')}, b as (select 'b' || box as id, 'building' as target_type, power(10 + size, 2) as area, label, priority from boxes), c as (select 'c' || cell as id, 'cell' as target_type, 0.0::double as area, density, shade from cells),
 p as (select id, target_type, area, 'large_low_conf' as k from b where area >= 2000 and priority = 3 union all select id, target_type, area, 'transport_like' from b where contains(label, 'STEEL') and area >= 1000 union all select id, target_type, area, 'very_large' from b where area >= 3000
  union all select id, target_type, area, 'negative_gain' from c where density < 0.2 union all select id, target_type, area, 'old_top_hazard' from c where shade < 0.1),
 g as (select target_type, id, string_agg(k, ';' order by k) as category, max(area) as area from p group by 1, 2),
 s as (select *, least(area / 1000.0, 10) + case when contains(category, 'large_low_conf') then 8 else 0 end + case when contains(category, 'transport') then 7 else 0 end + case when contains(category, 'negative_gain') then 5 else 0 end + case when contains(category, 'old_top_hazard') then 5 else 0 end as priority from g),
 r as (select *, row_number() over (partition by target_type order by priority desc, id) as k from s) select id, target_type, category, round(priority, 6) as priority from r where k <= case target_type when 'building' then 250 else 150 end"""


def sim_vs_proxy(spark: SparkSession, d: str) -> DataFrame:
    sim = adapter(spark, d, "pixels").groupBy(F.pmod(F.floor(F.col("x") / 100) + F.floor(F.col("y") / 100) * 7, F.lit(40)).alias("cell"), "hour").agg((30 + F.avg("svf") * 10).alias("tmrt"))
    proxy = adapter(spark, d, "obs").select(F.pmod("row_id", F.lit(37)).alias("cell"), F.floor(F.pmod("t", F.lit(86400)) / 3600).cast("int").alias("hour"), F.when(F.col("row_id") % 9 != 0, F.col("y")).alias("tmrt"))
    parts = [J.sim_vs_proxy(sim, proxy, "tmrt", mode).select("mode", "cell", "hour", F.round("tmrt", 6).alias("tmrt"), F.round("proxy", 6).alias("proxy"), F.round("delta", 6).alias("delta")) for mode in ("cell_hour", "hour", "period_mean")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SIM = f"""{duck('pixels', 'obs')}, s as (select (floor(x / 100)::bigint + floor(y / 100)::bigint * 7) % 40 as cell, hour, 30 + avg(svf) * 10 as tmrt from pixels group by 1, 2), p as (select row_id % 37 as cell, t % 86400 // 3600 as hour, y from obs where row_id % 9 <> 0),
 m as (select 'cell_hour' as mode, s.*, q.v from s left join (select cell, hour, avg(y) as v from p group by 1, 2) q on q.cell = s.cell and q.hour = s.hour union all select 'hour', s.*, q.v from s left join (select hour, avg(y) as v from p group by 1) q on q.hour = s.hour
  union all select 'period_mean', s.*, q.v from s left join (select cell, avg(y) as v from p group by 1) q on q.cell = s.cell) select mode, cell, hour, round(tmrt, 6) as tmrt, round(v, 6) as proxy, round(tmrt - v, 6) as delta from m"""


def stream_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A payload file for some readings each, read as a stream of files."""
    folder = _folder(spark, "payloads")
    r = _readings(spark, d).groupBy("t").agg(F.collect_list(F.struct(F.col("station").alias("station_id"), F.col("y").alias("value"))).alias("readings"), F.collect_set(PLACE(F.col("station"))).alias("stations"))
    item = F.struct(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "readings")
    day = r.groupBy(F.floor(F.col("t") / 86400).alias("day")).agg(F.array_distinct(F.flatten(F.collect_list("stations"))).alias("stations"), F.collect_list(item).alias("items"))
    day.select("day", F.to_json(F.struct(F.struct("stations").alias("metadata"), "items")).alias("value")).repartition("day").write.partitionBy("day").text(folder)
    out = _run(ST.stream_observations(spark, f"{folder}/*", P.flatten_v1, "official_wbgt_c"), "append")
    return out.select("station_id", "station_name", "value", F.unix_seconds("event_time").alias("t"))


STREAM_PAYLOADS = f"{READINGS} select station as station_id, 'Place ' || station as station_name, y as value, t from r"


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    return e.selectExpr(f"{STATION} as station_id", f"timestamp_seconds({SPARK_EPOCH}) as seen", "event_id", "event_type", "value")


def stream_late(spark: SparkSession, d: str) -> DataFrame:
    s = _arrivals(spark, d).withColumn("primary", F.when(F.col("event_id") % 4 != 0, F.col("seen"))).withColumn("second", F.when(F.col("event_id") % 8 != 0, F.timestamp_seconds(F.unix_seconds("seen") - 60)))
    s = s.withColumn("fetched", F.timestamp_seconds(F.unix_seconds("seen") + F.pmod(F.col("event_id"), F.lit(100)) * 3600 - 3600))
    flagged = _run(ST.arrival_flags(ST.with_event_time(s, "primary", "second"), "fetched"), "append")
    return flagged.groupBy("station_id").agg(F.count("*").alias("rows"), F.count_if("is_late").alias("late"), F.count_if("is_early").alias("early"), F.count_if(F.col("primary").isNull()).alias("by_fallback"))


STREAM_LATE = """with e as (select 'S' || (100 + user_id % 27) as station_id, event_id, event_id % 100 * 3600 - 3600 + case when event_id % 4 = 0 then 60 else 0 end as age from events where event_id % 8 <> 0)
 select station_id, count(*) as rows, count(*) filter (age > 259200) as late, count(*) filter (age < -360) as early, count(*) filter (event_id % 4 = 0) as by_fallback from e group by 1"""


def stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Observations of a stream with the snapshot of their hour, from a table and from a second stream."""
    obs = _arrivals(spark, d).filter("event_type = 'view'").select("station_id", F.col("seen").alias("event_time"), "event_id")
    w = stored(adapter(spark, d, "weather").select(F.col("station").alias("station_id"), F.timestamp_seconds("t").alias("valid_hour"), "temp"), "snapshots")
    fixed = _run(ST.pair_stream(obs, w), "append").select("event_id", "temp", F.lit("table").alias("side"))
    path = _folder(spark, "snapshot-stream")
    w.write.parquet(path)
    moving = _run(ST.pair_streams(obs, spark.readStream.schema(w.schema).parquet(path)), "append").filter("temp is not null")
    return fixed.unionByName(moving.select("event_id", "temp", F.lit("stream").alias("side")))


STREAM_PAIRS = f"""{duck('weather')}, o as (select event_id, 'S' || (100 + user_id % 27) as station, date_diff('second', timestamp '1970-01-01 00:00:00', ts) as t from events where event_type = 'view'),
 j as (select event_id, temp from o left join weather w on w.station = o.station and w.t = o.t - o.t % 3600) select event_id, temp, 'table' as side from j union all select event_id, temp, 'stream' from j where temp is not null"""


def stream_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A stream upserted into an archive, with the manifest's totals beside what the archive holds."""
    path, manifest = _folder(spark, "stream-archive"), _folder(spark, "manifest")
    s = _arrivals(spark, d).filter("event_type = 'view'").select("station_id", F.lit("y").alias("variable"), "value", "event_id", F.to_date("seen").alias("obs_date"))
    run = ST.upsert_batches(path, manifest, ["station_id", "variable"], ["event_id"])
    s.writeStream.foreachBatch(run).option("checkpointLocation", _folder(spark, "manifest-state")).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(manifest).agg(F.sum("rows_added").alias("rows_added"), F.max(F.size("warnings")).cast("long").alias("warnings"))
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.sum("event_id").alias("last_ids"), F.count_distinct("station_id").alias("stations")).crossJoin(told)


MANIFEST = """with k as (select user_id % 27 as s, ts::date as d, max(event_id) as e from events where event_type = 'view' group by 1, 2) select count(*) as rows, sum(e)::bigint as last_ids, count(distinct s) as stations, count(*) as rows_added, 0 as warnings from k"""


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", "seen")
    key = F.pmod(F.pmod(F.col("event_id"), F.lit(60)) * 7 + F.unix_seconds(hour) / 3600, F.lit(1000))
    s = _arrivals(spark, d).select(F.pmod("event_id", F.lit(60)).alias("cell"), F.col("seen").alias("event_time"), (24 + key / 100).alias("wbgt_c"), (22 + key / 50).alias("utci_c"))
    out = _run(ST.alert_stream(s, "60 days"), "complete")
    return out.select(F.unix_seconds("hour").alias("hour"), "cells", F.round("max_wbgt_c", 6).alias("max_wbgt_c"), "wbgt_alert", "utci_alert", "alert")


ALERTS = """with e as (select distinct event_id % 60 as cell, date_diff('second', timestamp '1970-01-01 00:00:00', ts) // 3600 as h from events), v as (select h, (cell * 7 + h) % 1000 as k from e),
 g as (select h, count(*) as cells, max(24 + k / 100.0) as w, max(22 + k / 50.0) as u, count(*) filter (24 + k / 100.0 >= 31) as mod, count(*) filter (22 + k / 50.0 >= 32) as strong from v group by h),
 a as (select *, case when w >= 33 then 'high' when mod >= greatest(1, ceil(0.1 * cells)) or w >= 31 then 'moderate' else 'low' end as wa, case when u >= 46 then 'extreme' when u >= 38 then 'very_strong' when u >= 32 then 'strong' when u >= 26 then 'moderate' else 'low' end as ua from g)
 select h * 3600 as hour, cells, round(w, 6) as max_wbgt_c, wa as wbgt_alert, ua as utci_alert, case when wa = 'high' or ua in ('very_strong', 'extreme') then 'high' when wa = 'moderate' or ua = 'strong' then 'elevated' when ua = 'moderate' then 'watch' else 'low' end as alert from a"""

QUERIES = {
    "read_tables": (read_tables, READ_TABLES), "scan_long_archive": (scan_long_archive, SCAN), "map_elements": (map_elements, MAP_ELEMENTS), "map_features": (map_features, MAP_FEATURES), "pixel_centres": (pixel_centres, PIXEL_CENTRES), "archive_appends": (archive_appends, APPENDS),
    "archive_merge": (archive_merge, MERGED), "archive_commits": (archive_commits, COMMITS), "weekly_sketches": (weekly_sketches, WEEKLY), "clustered_window": (clustered_window, WINDOW_SQL), "archive_inventory": (archive_inventory, INVENTORY), "merge_csvs": (merge_csvs, MERGE_CSVS), "feature_sink": (feature_sink, FEATURE_SINK), "retain_days": (retain_days, RETAIN), "tolerant_columns": (tolerant_columns, COLUMNS),
    "filter_modes": (filter_modes, MODES), "wbgt_only": (wbgt_only, WBGT_ONLY), "inner_pair": (inner_pair, INNER_PAIR), "nearest_cell": (nearest_cell, NEAREST_CELL), "local_times": (local_times, LOCAL_TIMES), "overhead_types": (overhead_types, OVERHEAD), "hours_from_names": (hours_from_names, HOURS),
    "fill_sources": (fill_sources, FILL), "grid_cells": (grid_cells, GRID), "standard_sources": (standard_sources, STANDARD), "corrections": (corrections, CORRECTIONS), "reviewed_footprints": (reviewed_footprints, REVIEWED), "qa_targets": (qa_targets, QA_TARGETS), "sim_vs_proxy": (sim_vs_proxy, SIM),
    "stream_payloads": (stream_payloads, STREAM_PAYLOADS), "stream_late": (stream_late, STREAM_LATE), "stream_pairs": (stream_pairs, STREAM_PAIRS), "stream_manifest": (stream_manifest, MANIFEST), "stream_alerts": (stream_alerts, ALERTS),
}
