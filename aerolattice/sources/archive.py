"""Partitioned archives and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import rows_added, union_evolving, upsert_keep_last


def partitioned_append(df: DataFrame, path: str, day: str = "obs_date") -> None:
    df.write.mode("append").partitionBy(day).parquet(path)


def merge_into_archive(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], day: str = "obs_date") -> DataFrame:
    """Upserts rows into the days that they touch, and gives the number of keys added. Only those days are read and
    written: a merged copy is stored first, then swapped in by dynamic partition overwrite. For one writer; where several
    write, or readers must see all days of a batch at once, use ``commits.Archive``."""
    from ..session import stored

    days = [r[0] for r in new.select(day).distinct().collect()]  # the days of one batch
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        old = spark.read.schema(new.schema).parquet(path).filter(F.col(day).isin(days)).select(*new.columns)
    else:
        old = new.limit(0)
    keys = [*keys, day] if day not in keys else list(keys)
    added = rows_added(old, new, keys).first()[0]
    merged = stored(upsert_keep_last(old, new, keys, order), "merge")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return spark.createDataFrame([(added, len(days))], "rows_added long, days int")


def archive_inventory(df: DataFrame, columns: int) -> DataFrame:
    """Files with their rows and columns, from the scan's metadata."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows")).withColumn("columns", F.lit(columns))


def inventory_by_kind(frames: Mapping[str, DataFrame], corrupt: str = "_corrupt_record") -> DataFrame:
    """``kind, files, rows, known, columns, bad_rows, bad_files`` of tables read with a column for corrupt records: partial sums
    over the rows of each file, then of each kind. ``known`` counts the rows with a value in the first column."""
    parts = []
    for kind, df in frames.items():
        names = [c for c in df.columns if c != corrupt]
        bad = F.count_if(F.col(corrupt).isNotNull()) if corrupt in df.columns else F.lit(0).cast("long")
        files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.count(names[0]).alias("known"), bad.alias("bad"))
        parts.append(files.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("known").alias("known"), F.sum("bad").alias("bad_rows"), F.count_if(F.col("bad") > 0).alias("bad_files")).select(F.lit(kind).alias("kind"), "files", "rows", "known", F.lit(len(names)).alias("columns"), "bad_rows", "bad_files"))
    return union_evolving(parts)


def retain_days(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days up to the newest one."""
    newest = df.agg(F.max(day).alias("_newest"))
    return df.crossJoin(F.broadcast(newest)).filter(F.col(day) > F.date_sub("_newest", days)).drop("_newest")


def feature_sink(df: DataFrame, shapes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """One JSON feature for each row that has a ring, and the rows without one."""
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    properties = F.struct(*(F.col(c) for c in df.columns))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    return df.join(shapes.select(key, "ring"), key).select(F.to_json(feature).alias("value")), df.join(shapes, key, "left_anti")
