"""Aggregates over archives, cells and pieces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import day, hour
from ..session import stored
from .windows import exact_quantile, in_long_form, range_quantiles


def hotspot_agg(cell_hours: DataFrame, static: Sequence[str] = ()) -> DataFrame:
    """One row for each cell: extremes, means, 90th percentiles, hours over each threshold, static columns, row count."""
    stats = []
    for c in ("utci_c", "wbgt_c"):
        stats += [F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}"), F.percentile(c, F.lit(0.9)).alias(f"p90_{c}")]
    over = {"moderate_wbgt_hours": F.col("wbgt_c") >= 31, "high_wbgt_hours": F.col("wbgt_c") >= 33, "strong_utci_hours": F.col("utci_c") >= 32, "very_strong_utci_hours": F.col("utci_c") >= 38, "extreme_utci_hours": F.col("utci_c") >= 46}
    return cell_hours.groupBy("cell").agg(*stats, *(F.count_if(v).alias(k) for k, v in over.items()), *(F.max(c).alias(c) for c in static), F.count("*").alias("forecast_hours"))


def event_windows(cell_hours: DataFrame, time: str = "t") -> DataFrame:
    """One row for each hour: cells (a cell has one row in an hour), extremes, exact 90th percentiles, and cells over each
    threshold. The percentiles come from counts on a grid of 0.05 degrees and the rows of one of its squares. The product of
    hours and cells is stored, as three steps read it."""
    cell_hours = stored(cell_hours.select(time, "cell", "wbgt_c", "utci_c"), "cell-hours")
    over = {"cells_moderate_or_high": F.col("wbgt_c") >= 31, "cells_high": F.col("wbgt_c") >= 33, "cells_moderate_utci": F.col("utci_c") >= 26, "cells_strong_utci": F.col("utci_c") >= 32, "cells_very_strong_utci": F.col("utci_c") >= 38, "cells_extreme_utci": F.col("utci_c") >= 46}
    rows = cell_hours.groupBy(time).agg(F.count("cell").alias("cell_count"), F.max("wbgt_c").alias("max_wbgt_c"), F.max("utci_c").alias("max_utci_c"), *(F.count_if(v).alias(k) for k, v in over.items()))
    high = exact_quantile(cell_hours, [time], {"wbgt_c": "p90_wbgt_c", "utci_c": "p90_utci_c"}, 0.9, 0.05)
    return rows.join(high, time, "left")


def hourly_buckets(df: DataFrame, target: str, by: Sequence[str], time: str, first: Sequence[str] = ()) -> DataFrame:
    """Target statistics for each hour, and the first known value of other columns in order of time."""
    rows = df.withColumn("hour_start", F.col(time) - F.pmod(time, F.lit(3600)))
    known = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(F.col(time), F.col(c)))).alias(c) for c in first]
    return rows.groupBy(*by, "hour_start").agg(F.avg(target).alias("mean"), F.max(target).alias("max"), F.percentile(target, F.lit(0.9)).alias("p90"), F.min(target).alias("min"), F.count(target).alias("n"), *known)


def static_constancy(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """Groups and columns with more than one distinct value."""
    counts = df.groupBy(by).agg(*(F.count_distinct(c).alias(c) for c in cols))
    long = counts.select(by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in cols))).alias("x"))
    return long.select(by, "x.column", "x.n_values").filter("n_values > 1")


def event_counts(df: DataFrame, value: str, by: Sequence[str], time: str, cuts: Sequence[int] = (29, 31, 33), peak: tuple[int, int] = (13, 16)) -> DataFrame:
    h = hour(F.col(time))
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_distinct(day(F.col(time))).alias("days"), (F.max(time) - F.min(time)).alias("span_s"),
        F.avg(value).alias("mean"), F.max(value).alias("max"), (100.0 * F.count_if(F.col(value).isNull()) / F.count("*")).alias("missing_pct"),
        *(F.count_if(F.col(value) >= c).alias(f"ge_{c}") for c in cuts), F.count_if((h >= peak[0]) & (h <= peak[1])).alias("peak_rows"),
    )


def daily_sketches(df: DataFrame, day: str, columns: Sequence[str], by: Sequence[str] = (), size: int = 12) -> DataFrame:
    """``by``, the day, its rows, and a sketch of the distinct values of each column: a few kilobytes, whatever the day holds.
    Sketches are stored and united over any span of days by ``united_counts``, so that no span reads the rows again."""
    return df.groupBy(*by, day).agg(F.count("*").alias("rows"), *(F.hll_sketch_agg(c, F.lit(size)).alias(f"{c}_sketch") for c in columns))


def united_counts(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, rows and the estimated number of distinct values of each column over the days of a group. The standard error is
    about 1.04 / sqrt(2^size): 1.6 % at 12."""
    united = sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *(F.hll_union_agg(f"{c}_sketch").alias(f"{c}_sketch") for c in columns))
    return united.select(*by, "rows", *(F.hll_sketch_estimate(f"{c}_sketch").alias(f"{c}_count") for c in columns))


def missingness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    one = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in cols))
    long = one.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null")) for c in cols))).alias("x"))
    return long.select("x.column", "x.non_null", F.coalesce(F.try_divide(100.0 * (F.col("_n") - F.col("x.non_null")), F.col("_n")), F.lit(0.0)).alias("missing_pct"))


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, from one aggregate by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("keys"))


def value_breakdown(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


# The percentiles of a distribution report.
QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def distribution(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row for each column: n, extremes, mean, deviation and percentiles."""
    long, keys = in_long_form(df, cols, by), [*by, "column"]
    out = long.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    quantiles = range_quantiles(long, keys, "v", list(QUANTILES.values())).withColumnsRenamed({k: f"_{k}" for k in keys})
    out = out.join(quantiles, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left")
    return out.select(*by, "column", "n", "min", "max", "mean", "std", *(F.col("_q")[k].alias(name) for k, name in enumerate(QUANTILES)), (F.col("_q")[4] - F.col("_q")[2]).alias("iqr"))


def variable_summary(long: DataFrame, keys: Sequence[str], station: str, time: str, value: str) -> DataFrame:
    return long.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(station).alias("stations"), F.count_distinct(time).alias("timestamps"), F.count_if(F.col(value).isNull()).alias("missing"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def station_summary(df: DataFrame, station: str, time: str, lat: str, lon: str, category: str, labels: Sequence[str], centre: tuple[float, float]) -> DataFrame:
    from ..functions.scalars import haversine_m

    out = df.groupBy(station).agg(F.min_by(lat, time).alias("lat"), F.min_by(lon, time).alias("lon"), F.count("*").alias("rows"), *(F.count_if(F.col(category) == x).alias(f"n_{x}") for x in labels))
    return out.withColumn("to_centre_m", haversine_m(F.col("lat"), F.col("lon"), F.lit(centre[0]), F.lit(centre[1])))


def area_weighted_mean(pieces: DataFrame, key: str, value: str, area: str, label: str, known_only: bool = True) -> DataFrame:
    """Area-weighted mean, the dominant label and the labels' shares. By default the mean divides by the area whose value
    is known; with ``known_only`` false by all."""
    parts = pieces.groupBy(key, label).agg(F.sum(area).alias("_a"), F.sum(F.when(F.col(value).isNotNull(), F.col(area))).alias("_k"), F.sum(F.col(area) * F.col(value)).alias("_w"))
    whole = F.sum("_k") if known_only else F.sum("_a")
    share = F.concat_ws("=", F.col(label), F.format_number(F.col("_a"), 0))
    out = parts.groupBy(key).agg(F.try_divide(F.sum("_w"), whole).alias("mean"), F.max_by(label, F.struct(F.col("_a"), F.col(label))).alias("dominant"), F.max("_a").alias("_top"), F.sum("_a").alias("area"), F.array_join(F.array_sort(F.collect_list(share)), ";").alias("shares"))
    return out.withColumn("dominant_fraction", F.try_divide("_top", "area")).drop("_top")


def zonal_stats(pixels: DataFrame, size: float, height: str, value: str, ground: float = 0.5) -> DataFrame:
    """For each square cell: pixels, built and open share, and statistics of a value over open pixels (height at most
    ``ground``). The cell is arithmetic on the pixel's place, so pixels aren't joined with anything."""
    open_ = F.col(height) <= ground
    v = F.when(open_, F.col(value))
    q = F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    key = [F.floor(F.col(c) / size).cast("long").alias(k) for c, k in (("x", "cx"), ("y", "cy"))]
    out = pixels.groupBy(*key).agg(F.count("*").alias("pixels"), F.count_if(open_).alias("open_pixels"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), q.alias("_q"), F.avg(F.when(~open_, F.col(height))).alias("mean_height"))
    return out.select("cx", "cy", "pixels", "open_pixels", (F.col("open_pixels") / F.col("pixels")).alias("open_fraction"), "mean", "min", "max", *(F.col("_q")[k].alias(n) for k, n in enumerate(("p10", "p50", "p90"))), "mean_height")


def shade_hours(pixels: DataFrame, size: float, hours: Sequence[int]) -> DataFrame:
    """Shaded share of each cell's pixels by hour, with mean and maximum over the hours given."""
    key = [F.floor(F.col(c) / size).cast("long").alias(k) for c, k in (("x", "cx"), ("y", "cy"))]
    each = pixels.groupBy(*key, "hour").agg(F.avg(F.col("shaded").cast("double")).alias("share"))
    wide = each.groupBy("cx", "cy").agg(*(F.max(F.when(F.col("hour") == h, F.col("share"))).alias(f"h{h}") for h in hours), F.avg(F.when(F.col("hour").isin(list(hours)), F.col("share"))).alias("mean_share"), F.max("share").alias("max_share"))
    return wide


def type_breakdown(pieces: DataFrame, key: str, kind: str, area: str, feature: str, opacity: Mapping[str, float], kinds: Sequence[str]) -> DataFrame:
    """For each cell: area by kind, features, and the area weighted by each kind's opacity."""
    weight = F.lit(0.0)
    for name, value in opacity.items():
        weight = F.when(F.col(kind) == name, F.lit(value)).otherwise(weight)
    return pieces.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(area))), F.lit(0.0)).alias(f"area_{n}") for n, k in enumerate(kinds)), F.sum(area).alias("area"), F.count_distinct(feature).alias("features"), F.sum(F.col(area) * weight).alias("weighted_area"))


def completeness(zones: DataFrame, old: str, new: str, ref: str) -> DataFrame:
    """Area ratios of old and new against a reference, and the gain, for each zone."""
    return zones.withColumns({"old_ratio": F.try_divide(old, ref), "new_ratio": F.try_divide(new, ref)}).withColumn("gain", F.col("new_ratio") - F.col("old_ratio"))


def demographics(rows: DataFrame, label: str, order: str, by: Sequence[str], total: str, young: Sequence[str], old: Sequence[str]) -> DataFrame:
    """Hierarchical rows: ``X - Total`` opens parent X, which its children carry; age bands are summed to shares."""
    from .windows import carry_forward

    is_parent = F.col(label).rlike(r" - Total$")
    marked = rows.withColumn("_p", F.when(is_parent, F.regexp_replace(label, r" - Total$", "")))
    marked = carry_forward(marked, "_p", "parent", by, order)
    add = lambda cols: sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return marked.select(*by, order, label, "parent", is_parent.alias("is_parent"), F.try_divide(add(young), F.col(total)).alias("young_share"), F.try_divide(add(old), F.col(total)).alias("old_share"))


def top_vs_all(df: DataFrame, rank: str, n: int, cols: Sequence[str]) -> DataFrame:
    """Mean and median of features over all rows and over the first n."""
    rows = in_long_form(df.withColumn("_top", F.coalesce(F.col(rank) <= n, F.lit(False))), cols, ["_top"])
    sets = rows.select("column", "v", F.explode(F.when(F.col("_top"), F.array(F.lit("all"), F.lit("top"))).otherwise(F.array(F.lit("all")))).alias("set"))
    means = sets.groupBy("column", "set").agg(F.avg("v").alias("mean"))
    found = means.join(range_quantiles(sets, ["column", "set"], "v", [0.5]), ["column", "set"], "left")
    of = lambda name, c: F.max(F.when(F.col("set") == name, c))
    named = [of(s, v).alias(f"{kind}_{s}") for s in ("all", "top") for kind, v in (("mean", F.col("mean")), ("median", F.col("_q")[0]))]
    return found.groupBy(F.col("column").alias("feature")).agg(*named)


def archive_health(df: DataFrame, station: str, time: str, least: int = 50) -> DataFrame:
    """One row: span, rows of the last day and week before the newest row, silent stations, and a verdict."""
    newest = df.agg(F.max(time).alias("_now"), F.min(time).alias("_start"), F.count("*").alias("rows"))
    per = df.crossJoin(F.broadcast(newest.select("_now"))).groupBy(station).agg(F.count_if(F.col(time) > F.col("_now") - 86400).alias("d"), F.count_if(F.col(time) > F.col("_now") - 7 * 86400).alias("w"))
    sums = per.agg(F.count("*").alias("stations"), F.sum("d").alias("rows_24h"), F.sum("w").alias("rows_7d"), F.count_if(F.col("d") < least).alias("silent"))
    verdict = F.when(F.col("silent") == 0, "GREEN").when(F.col("silent") * 2 <= F.col("stations"), "YELLOW").otherwise("RED")
    return newest.crossJoin(sums).select("rows", (F.col("_now") - F.col("_start")).alias("span_s"), "stations", "rows_24h", "rows_7d", "silent", verdict.alias("verdict"))


def readiness(df: DataFrame, obs: str, station: str, time: str) -> DataFrame:
    out = df.agg(F.count(obs).alias("pairs"), F.count_distinct(station).alias("stations"), F.count_distinct(day(F.col(time))).alias("days"), F.count_if(F.col(obs) >= 31).alias("ge_31"), F.count_if(F.col(obs) >= 33).alias("ge_33"))
    regimes = (F.col("ge_31") > 0).cast("int") + (F.col("ge_33") > 0).cast("int") + 1
    advice = F.when((F.col("pairs") < 30) | (F.col("days") < 3), "collect_more").when(F.col("ge_31") == 0, "bias_only").otherwise("calibrate")
    return out.withColumn("regimes", regimes).withColumn("advice", advice)


def role_delta(df: DataFrame, key: str, scenario: str, value: str, base: str, other: str, cuts: Sequence[float] = (-2.0, -0.5, 0.5, 2.0)) -> DataFrame:
    """Two scenarios side by side with their difference and a class of five."""
    pick = lambda s: F.avg(F.when(F.col(scenario) == s, F.col(value)))
    out = df.groupBy(key).agg(pick(base).alias("base"), pick(other).alias("other")).withColumn("delta", F.col("other") - F.col("base"))
    from ..functions.thermal import classify

    return out.withColumn("delta_class", classify(F.col("delta"), cuts, ("strong_cooling", "cooling", "neutral", "warming", "strong_warming")))


def source_summary(df: DataFrame, source: str, area: str, height: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"), F.sum(area).alias("area_sum"), F.avg(area).alias("area_mean"), F.count(height).alias("heights"))


def median_by_group(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in cols))


def point_density(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Points for each square cell, and points per square kilometre."""
    counts = points.groupBy(F.floor(F.col("px") / size).alias("_kx"), F.floor(F.col("py") / size).alias("_ky")).agg(F.count("*").alias("_n"))
    here = cells.withColumn("_kx", F.floor(F.col("x") / size)).withColumn("_ky", F.floor(F.col("y") / size))
    n = F.coalesce(F.col("_n"), F.lit(0))
    return here.join(counts, ["_kx", "_ky"], "left").select("cell", n.alias("points"), (n / (size * size / 1e6)).alias("per_km2"))


def conditions(df: DataFrame, required: Sequence[str], key: str, unit: Sequence[str]) -> DataFrame:
    """Validation in one pass: missing required columns, duplicate keys, nulls, and values outside [0, 1]."""
    present = [c for c in required if c in df.columns]
    one: list[Column] = [F.lit(",".join(sorted(set(required) - set(df.columns)))).alias("missing_columns"), (F.count("*") - F.count_distinct(key)).alias("duplicate_keys")]
    one += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present]
    one += [F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias(f"outside_{c}") for c in unit if c in df.columns]
    return df.agg(*one)


def zonal_layers(pixels: DataFrame, size: float, height: str, value: str, res: float, ground: float = 0.5) -> DataFrame:
    """Statistics of a value for each square cell over open pixels (height at most ``ground``), building pixels and all
    pixels, with their share of the cell's pixels and their area."""
    layers = F.array(F.lit("all"), F.when(F.col(height) <= ground, "open").otherwise("building"))
    key = [F.floor(F.col(c) / size).cast("long").alias(k) for c, k in (("x", "cx"), ("y", "cy"))]
    rows = pixels.select(*key, F.col(value).alias("_v"), F.explode(layers).alias("layer"))
    q = F.percentile("_v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.groupBy("cx", "cy", "layer").agg(F.count("*").alias("pixels"), F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"), q.alias("_q"))
    whole = F.max(F.when(F.col("layer") == "all", F.col("pixels"))).over(Window.partitionBy("cx", "cy"))
    return out.select("cx", "cy", "layer", "pixels", (F.col("pixels") / whole).alias("fraction"), (F.col("pixels") * res * res).alias("area_m2"), "mean", "min", "max", *(F.col("_q")[k].alias(n) for k, n in enumerate(("p10", "p50", "p90"))))


def type_shares(pieces: DataFrame, key: str, kind: str, area: str, cell_area: float, groups: Mapping[str, Sequence[str]], cuts: tuple[float, float], least: float = 0.02) -> DataFrame:
    """For each cell the covered fraction, the fractions of groups of kinds (all in [0, 1]; a group sums its kinds' clipped
    fractions), a flag by two cuts, and which group is present."""
    each = pieces.groupBy(key, kind).agg(F.sum(area).alias("_a")).withColumn("_f", F.least(F.col("_a") / cell_area, F.lit(1.0)))
    sums = [F.least(F.sum(F.when(F.col(kind).isin(list(kinds)), F.col("_f")).otherwise(F.lit(0.0))), F.lit(1.0)).alias(f"{name}_fraction") for name, kinds in groups.items()]
    out = each.groupBy(key).agg(F.least(F.sum("_a") / cell_area, F.lit(1.0)).alias("fraction"), *sums)
    flag = F.when(F.col("fraction") < cuts[0], "clean_or_minor").when(F.col("fraction") < cuts[1], "moderate_confounding").otherwise("major_confounding")
    present = [F.when(F.col(f"{name}_fraction") >= least, F.lit(name)) for name in groups]
    named = F.array_compact(F.array(*present))
    return out.withColumns({"flag": flag, "interpretation": F.when(F.size(named) == 0, "minor_or_none").when(F.size(named) == 1, named[0]).otherwise("mixed")})


def completeness_total(zones: DataFrame, old: str, new: str, ref: str) -> DataFrame:
    """One row: the sums of all zones and their ratios."""
    sums = zones.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for c, n in ((old, "old_sum"), (new, "new_sum"), (ref, "ref_sum"))))
    ratio = lambda c: F.when(F.col("ref_sum") > 0, F.col(c) / F.col("ref_sum"))
    return sums.withColumns({"old_ratio": ratio("old_sum"), "new_ratio": ratio("new_sum")})


def archive_by_day(df: DataFrame, station: str, time: str, value: str, days: int = 7) -> DataFrame:
    """The newest ``days`` days with rows, stations, maximum and events of each; a report of that length."""
    each = df.groupBy(day(F.col(time)).alias("day")).agg(F.count("*").alias("rows"), F.count_distinct(station).alias("stations"), F.max(value).alias("max"), F.count_if(F.col(value) >= 31).alias("ge_31"), F.count_if(F.col(value) >= 33).alias("ge_33"))
    return each.orderBy(F.desc("day")).limit(days)


def station_coverage(df: DataFrame, station: str, time: str, least: int = 50) -> DataFrame:
    """One row: stations seen in the last day before the newest row, their least and most rows, how many are near silent,
    and the longest time since a station's last row."""
    newest = df.agg(F.max(time).alias("_now"))
    per = df.crossJoin(F.broadcast(newest)).groupBy(station).agg(F.count_if(F.col(time) >= F.col("_now") - 86400).alias("n"), F.max(F.col(time)).alias("_last"), F.first("_now").alias("_now"))
    seen = F.when(F.col("n") > 0, F.col("n"))
    return per.agg(F.count(seen).alias("stations_seen"), F.min(seen).alias("least_rows"), F.max(seen).alias("most_rows"), F.count_if((F.col("n") > 0) & (F.col("n") < least)).alias("near_silent"), F.max(F.col("_now") - F.col("_last")).alias("longest_lag_s"))
