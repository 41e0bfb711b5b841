"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, shared_dir, stored  # noqa: F401

#: The white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Bits of the filters for ids: 16 MB at most, whatever the corpus. With far more than 10^8 ids most bits are set, and
#: more rows go through the exact join behind the filter; results don't change.
FILTER_BITS = 1 << 27
#: A key is hot from this share of all rows on, and from this many rows on. There are at most ``HOT_SHARE`` hot keys,
#: since their rows are part of all rows: that bound allows a broadcast at any size of the input.
HOT_SHARE, HOT_ROWS = 10_000, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it literally, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def as_row(docs: DataFrame) -> Column:
    """All columns in one struct ``row``. Stages work beside it, so that a column may have any name."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")


def row_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` from the struct that ``as_row`` made of them."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def marked_by(rows: DataFrame, key: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows``, none of whose columns begin with ``_``, with ``_maybe``: false where ``key`` is surely not in the only column of ``keys``. A bitmap of hashed keys,
    bounded in size, goes to all tasks, so that rows without a partner needn't be shuffled. Join the rest by an inner or
    left join: Catalyst would push a semi or anti join below the filter, and all rows would be shuffled."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    made = keys.select(place(F.col(keys.columns[0])).alias("_h")).select("_h", F.bitmap_bucket_number("_h").alias("_bucket"))
    # Keys are dealt by bucket first: eight bytes of a key travel, and not a map of all bits from each task.
    made = made.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    out = rows.withColumn("_h", place(F.col(key)))
    out = out.withColumn("_bucket", F.bitmap_bucket_number("_h")).withColumn("_p", F.bitmap_bit_position("_h")).join(F.broadcast(made), "_bucket", "left")
    bit = F.expr("getbit(cast(conv(hex(substring(_bits, cast(_p div 8 as int) + 1, 1)), 16, 10) as int), cast(_p % 8 as int)) = 1")
    return out.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_h", "_bucket", "_p", "_bits")


def hot_keys(counts: DataFrame, key: str, rows: int) -> DataFrame:
    """``key, _salts``: the hot keys of ``counts`` (a row for each key, its number in ``rows``) among ``rows`` rows, and
    over how many tasks each one's rows should be dealt."""
    return counts.filter(F.col("rows") > max(HOT_ROWS, rows // HOT_SHARE)).select(key, F.ceil(F.col("rows") / HOT_ROWS).cast("int").alias("_salts"))


def salted(rows: DataFrame, key: str, by: str, hot: DataFrame, salts: int = 1) -> DataFrame:
    """``rows`` with ``_salt``, by a hash of ``by``: as many salts as ``hot`` says, for other keys ``salts``."""
    return rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(salts))).cast("int")).drop("_salts")


def salted_join(rows: DataFrame, side: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined with the one row of ``side`` for their key. The rows of a hot key are dealt over tasks by a hash of
    ``by``, and the one row of ``side`` goes to each of them."""
    spread = side.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted(rows, key, by, hot).join(spread, [key, "_salt"]).drop("_salt")


def slices(batches, column: str, most_bytes: int):
    """Arrow batches cut so that a slice's texts stay under ``most_bytes``, or a slice is one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
