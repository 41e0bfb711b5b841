"""Window operators over station series and rankings. Times are seconds since 1970 (long)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.thermal import clip
from ..session import stored


def running_totals(counts: DataFrame, value: str, n: str, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``counts`` (distinct ``value`` within ``by``, with its number ``n``) with ``_below``, the total of ``n`` of the values
    that come before it, and ``_total``. Values are dealt over ranges, which are stored once, so that all steps agree on
    them; only the sums of ranges meet in one place."""
    keys, order = list(by), F.desc(value) if descending else F.asc(value)
    ranged = stored(counts.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts, w = ranged.groupBy(*keys, "_part").agg(F.sum(n).alias("_n")), Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_part").alias("_of_part"), earlier.alias("_earlier"), F.sum("_n").over(w).alias("_total"))
    same = F.col("_part") == F.col("_of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return ranged.withColumn("_inside", inside).join(parts, same).select(*counts.columns, (F.col("_earlier") + F.col("_inside")).alias("_below"), "_total")


def range_quantiles(long: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """``keys`` and ``_q``, the exact, interpolated quantiles of ``value`` at the ``shares``, in their order, for groups of any
    size: distinct values are counted and dealt over ranges, so no task holds all values of a group. Null values don't
    count; a group without others has no row."""
    totals = running_totals(long.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")), value, "_n", keys)
    place = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    holds = lambda at: (F.col("_below") <= at) & (at < F.col("_below") + F.col("_n"))
    hits = []
    for q in dict.fromkeys(shares):
        low = F.floor(place(q))
        hits += [F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(low + 1), F.col(value))), F.max(place(q) - low)]
    found = totals.groupBy(*keys).agg(*(h.alias(f"_h{k}") for k, h in enumerate(hits)))
    at = {q: F.col(f"_h{3 * k}") + F.coalesce(F.col(f"_h{3 * k + 1}") - F.col(f"_h{3 * k}"), F.lit(0.0)) * F.col(f"_h{3 * k + 2}") for k, q in enumerate(dict.fromkeys(shares))}
    return found.select(*keys, F.array(*(at[q] for q in shares)).alias("_q"))


def in_long_form(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``column`` and its value ``v``: a row for each value of ``cols``."""
    return df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols))).alias("x")).select(*by, "x.column", "x.v")


def column_quantiles(df: DataFrame, wanted: Mapping[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and a column for each of ``wanted``: the quantile of a column, as (column, share). One row without ``by``."""
    cols, shares = sorted({c for c, _ in wanted.values()}), sorted({q for _, q in wanted.values()})
    found = range_quantiles(in_long_form(df, cols, by), [*by, "column"], "v", shares)
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("column") == c, F.col("_q")[shares.index(q)])).alias(name) for name, (c, q) in wanted.items()))


def pct_ranks(df: DataFrame, outs: Mapping[str, str], base: DataFrame | None = None) -> DataFrame:
    """Average-tie percentile ranks of numeric columns over the whole table, ``outs`` from column to result; null gives 0.
    Ranks are made on counts of distinct values, of all columns together. ``base`` has the values, where ``df`` is a
    longer plan over the same rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in outs))
    counts = (df if base is None else base).select(F.explode(pairs).alias("x")).select("x.*").filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("_ties"))
    ranks = running_totals(counts, "value", "_ties", ["name"]).select("name", "value", ((F.col("_below") + (F.col("_ties") + 1) / 2) / F.col("_total")).alias("_rank"))
    out = df
    for c, name in outs.items():
        own = ranks.filter(F.col("name") == c).select(F.col("value").alias("_value"), F.col("_rank").alias(name))
        out = out.join(own, F.col(c).cast("double") == F.col("_value"), "left").select(*out.columns, clip(F.coalesce(name, F.lit(0.0)), 0, 1).alias(name))
    return out


def pct_rank(df: DataFrame, col: str, out: str, by: Sequence[str] = (), base: DataFrame | None = None) -> DataFrame:
    """Average-tie percentile rank within ``by``; null gives 0. Ranks are made on counts of distinct values, not on rows.
    ``base`` has the values, where ``df`` is a longer plan over the same rows."""
    if not by:
        return pct_ranks(df, {col: out}, base)
    keys = list(by)
    counts = (df if base is None else base).filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_ties"))
    below = F.coalesce(F.sum("_ties").over(Window.partitionBy(*keys).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_ties").over(Window.partitionBy(*keys))
    ranks = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(col).alias("_value"), ((below + (F.col("_ties") + 1) / 2) / total).alias(out))
    condition = F.col(col) == F.col("_value")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(ranks, condition, "left").select(*df.columns, clip(F.coalesce(out, F.lit(0.0)), 0, 1).alias(out))


def rank_desc(df: DataFrame, col: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Competition rank, 1 for the largest; null stays null. Over the whole table, ranks come from counts of values."""
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(col))
        return df.withColumn(out, F.when(F.col(col).isNotNull(), F.rank().over(w)).cast("long"))
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_value")).agg(F.count("*").alias("_ties"))
    ranks = running_totals(counts, "_value", "_ties", descending=True).select("_value", (F.col("_below") + 1).cast("long").alias(out))
    return df.join(ranks, F.col(col) == F.col("_value"), "left").drop("_value")


def row_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1..n over the whole table by a total order. Rows are sorted in ranges and stored with their places, so that the
    ranges' sizes and the places agree; only the sizes meet in one place."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33))
    ranged = stored(ranged, "ranked-ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def exact_quantile(df: DataFrame, by: Sequence[str], outs: Mapping[str, str], q: float, width: float) -> DataFrame:
    """``by`` and the exact, interpolated quantile of each column in ``outs``, for groups of any size. Counts of values on
    a grid of ``width`` show the square that holds the quantile; only the rows of that square are ordered."""
    keys = [*by, "_name"]
    pairs = F.array(*(F.struct(F.lit(c).alias("n"), F.col(c).cast("double").alias("v")) for c in outs))
    long = df.select(*by, F.explode(pairs).alias("x")).select(*by, F.col("x.n").alias("_name"), F.col("x.v").alias("_v"), F.floor(F.col("x.v") / width).alias("_bin")).filter("_v is not null")
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = long.groupBy(*keys, "_bin").agg(F.count("*").alias("_n")).withColumn("_below", upto - F.col("_n")).withColumn("_place", (F.sum("_n").over(w) - 1) * F.lit(q))
    low = F.floor("_place")
    wanted = stored(bins.filter((low < F.col("_below") + F.col("_n")) & (low + 1 >= F.col("_below"))).select(*keys, "_bin", "_below", low.alias("_low"), (F.col("_place") - low).alias("_part")), "quantile-squares")
    rank = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy("_v")) - 1 + F.col("_below")
    near = long.join(wanted, [*keys, "_bin"]).withColumn("_rank", rank).filter("_rank in (_low, _low + 1)")
    at = lambda k: F.max(F.when(F.col("_rank") == F.col("_low") + k, F.col("_v")))
    ends = near.groupBy(*keys).agg(at(0).alias("_a"), at(1).alias("_b"), F.first("_part").alias("_part"))
    ends = ends.withColumn("_value", F.col("_a") + F.coalesce(F.col("_b") - F.col("_a"), F.lit(0.0)) * F.col("_part"))
    return ends.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == c, F.col("_value"))).alias(name) for c, name in outs.items()))


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, *ties: str) -> DataFrame:
    """The last row of each key by time, then by ``ties``; a partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, *ties)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def row_lag(df: DataFrame, cols: Sequence[str], n: int, by: Sequence[str], time: str) -> DataFrame:
    """``<col>_lag<n>``: the value n rows before within ``by``, the row's own where there is none."""
    w = Window.partitionBy(*by).orderBy(time)
    return df.withColumns({f"{c}_lag{n}": F.coalesce(F.lag(c, n).over(w), F.col(c)) for c in cols})


def time_lag(df: DataFrame, cols: Sequence[str], seconds: int, by: Sequence[str], time: str, tolerance: int = 0) -> DataFrame:
    """``<col>_ago``: the last value at least ``seconds`` before, and at most ``tolerance`` more."""
    w = Window.partitionBy(*by).orderBy(time).rangeBetween(-seconds - tolerance, -seconds)
    return df.withColumns({f"{c}_ago": F.last(c, ignorenulls=True).over(w) for c in cols})


def rolling_mean(df: DataFrame, cols: Sequence[str], rows: int, by: Sequence[str], time: str) -> DataFrame:
    """``<col>_mean<rows>`` over the last rows, missing ones skipped."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(1 - rows, 0)
    return df.withColumns({f"{c}_mean{rows}": F.avg(c).over(w) for c in cols})


def day_cumsum(df: DataFrame, col: str, by: Sequence[str], time: str, scale: float = 1.0, fill: bool = False) -> DataFrame:
    """``<col>_cumsum`` within ``by``: missing values stay missing, or count as 0 with ``fill``."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce(F.col(col), F.lit(0.0)) if fill else F.col(col)
    total = F.sum(value).over(w) * scale
    return df.withColumn(f"{col}_cumsum", total if fill else F.when(F.col(col).isNotNull(), total))


def diff(df: DataFrame, col: str, by: Sequence[str], time: str) -> DataFrame:
    return df.withColumn(f"{col}_diff", F.col(col) - F.lag(col).over(Window.partitionBy(*by).orderBy(time)))


def carry_forward(df: DataFrame, col: str, out: str, by: Sequence[str], order: str) -> DataFrame:
    """The last value that isn't null, up to the row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(col, ignorenulls=True).over(w))


def reverse_cumulative(counts: DataFrame, bucket: str, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``<col>_ge``: totals of buckets from the row's own upwards."""
    w = Window.partitionBy(*by).orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({f"{c}_ge": F.sum(c).over(w) for c in cols})


def time_blocks(df: DataFrame, day: str, k: int, out: str = "block") -> DataFrame:
    """Consecutive blocks of near-equal numbers of distinct days (1..k); only the distinct days are ordered."""
    days = df.select(day).filter(F.col(day).isNotNull()).distinct().withColumn(out, F.ntile(k).over(Window.orderBy(day)))
    return df.join(days, day, "left").select(*df.columns, out)


def robust_minmax(df: DataFrame, cols: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``<col>_scaled``: scaled by two quantiles and clipped; null and constant columns give 0. One row is broadcast."""
    bounds = column_quantiles(df, {f"_{c}_{name}": (c, q) for c in cols for q, name in ((low, "lo"), (high, "hi"))})
    scaled = {f"{c}_scaled": F.coalesce(clip(F.try_divide(F.col(c) - F.col(f"_{c}_lo"), F.col(f"_{c}_hi") - F.col(f"_{c}_lo")), 0, 1), F.lit(0.0)) for c in cols}
    return df.crossJoin(F.broadcast(bounds)).select(*df.columns, *(v.alias(k) for k, v in scaled.items()))


def kth_score_shift(df: DataFrame, obs: str, score: str, threshold: float) -> DataFrame:
    """One row: the events, the score of rank k (k events), and three shifts: by rank, by maximum, by 99th percentile."""
    rows = df.filter(F.col(obs).isNotNull() & F.col(score).isNotNull())
    facts = rows.agg(F.count_if(F.col(obs) >= threshold).alias("events"), F.max(obs).alias("_mo"), F.max(score).alias("_ms")).crossJoin(F.broadcast(column_quantiles(rows, {"_po": (obs, 0.99), "_ps": (score, 0.99)})))
    counts = running_totals(rows.groupBy(score).agg(F.count("*").alias("_n")), score, "_n", descending=True)
    kth = counts.crossJoin(F.broadcast(facts)).filter("_below + _n >= events and events > 0").agg(F.max(score).alias("kth_score"))
    return facts.crossJoin(kth).select("events", "kth_score", (F.lit(threshold) - F.col("kth_score")).alias("shift_rank"), (F.col("_mo") - F.col("_ms")).alias("shift_max"), (F.col("_po") - F.col("_ps")).alias("shift_p99"))
