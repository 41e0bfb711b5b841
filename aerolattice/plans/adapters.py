"""Station, weather, grid and pixel tables derived from the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_EPOCH = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
DUCK_EPOCH = "date_diff('second', timestamp '1970-01-01 00:00:00', ts)"
STATION = "concat('S', cast(100 + user_id % 27 as string))"

#: name -> (source table, SQL over it). EPOCH and FROM are put in for each engine.
ADAPTERS: dict[str, tuple[str, str]] = {
    "obs": ("events", f"""select event_id as row_id, {STATION} as station, EPOCH as t, 24 + (cast(floor(value * 100) as bigint) % 1000) / 1e2 as y,
        23 + (event_id * 37 % 1100) / 1e2 as p, 25 + (event_id * 61 % 900) / 1e2 as p2, event_type as kind from FROM where event_type in ('click', 'view', 'error')"""),
    "weather": ("events", f"""select station, hour_start as t, temp, rh, wind, sw, direct from (select *, row_number() over (partition by station, hour_start order by event_id) as k from (
        select event_id, {STATION} as station, EPOCH - EPOCH % 3600 as hour_start, 24 + (event_id * 53 % 1000) / 1e2 as temp, 55e0 + event_id * 29 % 45 as rh,
        (event_id * 17 % 500) / 1e2 as wind, 0e0 + event_id * 71 % 950 as sw, 0e0 + event_id * 31 % 500 as direct from FROM where event_type in ('purchase', 'signup')) e) r where k = 1"""),
    "snapshots": ("events", f"""select event_id as snap_id, EPOCH as issue, EPOCH - EPOCH % 3600 + (event_id % 97 - 24) * 3600 as valid,
        case when event_id % 3 = 0 then 'AOI' else {STATION} end as location, 24 + (event_id * 53 % 1000) / 1e2 as temp from FROM where event_type in ('purchase', 'signup')"""),
    "cells": ("customer", """select c_custkey as cell, (c_custkey % 40) * 1e2 as x, floor(c_custkey / 4e1) * 1e2 as y, (c_custkey * 37 % 101) / 1e2 as density, (c_custkey * 53 % 101) / 1e2 as road,
        0.18e0 + (c_custkey * 29 % 81) / 1e2 as svf, 0.04e0 + (c_custkey * 41 % 87) / 1e2 as shade, 0e0 + c_custkey * 17 % 71 as gvi, 0e0 + c_custkey * 97 % 1500 as park,
        (c_custkey * 11 % 97) / 1e2 as elderly, (c_custkey * 13 % 89) / 1e2 as outdoor, c_mktsegment as land_use from FROM"""),
    "nodes": ("part", "select p_partkey as node, 0e0 + p_partkey * 131 % 4000 as nx, 0e0 + p_partkey * 173 % 4000 as ny, concat('Manufacturer#', cast(p_partkey % 5 + 1 as string)) as type, p_size / 1e1 as weight from FROM"),
    "boxes": ("part", """select p_partkey as box, 0e0 + p_partkey * 131 % 4000 as x_min, 10e0 + p_partkey * 131 % 4000 + p_size as x_max, 0e0 + p_partkey * 173 % 4000 as y_min,
        10e0 + p_partkey * 173 % 4000 + p_size as y_max, p_partkey % 3 + 1 as priority, concat('Manufacturer#', cast(p_partkey % 5 + 1 as string)) as type, p_type as label, p_size as size from FROM"""),
    "pixels": ("lineitem", """select (l_orderkey * 7 % 500) * 2e0 + 1 as x, (l_partkey * 11 % 500) * 2e0 + 1 as y, case when l_quantity > 35 then cast(l_quantity as double) else 0e0 end as height,
        cast(l_discount as double) * 10 as svf, 10 + l_linenumber as hour, case when l_tax > 0.04 then 1 else 0 end as shaded from FROM"""),
}


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = ADAPTERS[name]
    frame = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(sql.replace("EPOCH", SPARK_EPOCH).replace("FROM where", "{src} where").replace("from FROM", "from {src}").replace("FROM", "{src}"), src=frame)


def duck(*names: str) -> str:
    """A ``with`` clause that defines the adapters named."""
    parts = []
    for n in names:
        source, sql = ADAPTERS[n]
        parts.append(f"{n} as ({sql.replace('EPOCH', DUCK_EPOCH).replace('FROM', source)})")
    return "with " + ",\n".join(parts)
