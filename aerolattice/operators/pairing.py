"""Joins of observations with forecasts and places. Times are seconds since 1970 (long)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.thermal import clip
from ..session import stored
from .neighbours import Sphere, by_classes, nearest
from .windows import column_quantiles


def expand_over_grid(weather: DataFrame, cells: DataFrame) -> DataFrame:
    """Every hour for every cell. This product is the result itself; Spark broadcasts the smaller side if it is small. The
    hours are few rows that would sit in one partition, so they are dealt out first: the product is made by all cores."""
    return weather.repartition(max(2, weather.sparkSession.sparkContext.defaultParallelism)).crossJoin(cells)


def expand_by_cell(weather: DataFrame, cells: DataFrame, hours: int = 100_000) -> DataFrame:
    """``expand_over_grid`` with all hours of a cell in one task, so that what is computed for a cell needs no shuffle. The
    hours go to all tasks if they are at most ``hours`` rows, as they are for any forecast; else it is the plain product."""
    weather = stored(weather, "hours")
    if weather.limit(hours + 1).count() > hours:
        return expand_over_grid(weather, cells)
    return cells.repartition(max(2, weather.sparkSession.sparkContext.defaultParallelism), "cell").crossJoin(F.broadcast(weather))


def enrich(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that takes only the columns that ``df`` doesn't have."""
    new = [c for c in dim.columns if c not in df.columns]
    return df.join(dim.select(*keys, *new), list(keys), "left").select(*df.columns, *new)


def join_prefer_new(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which columns of both sides come from ``new``."""
    kept = [c for c in base.columns if c not in new.columns or c in keys]
    return base.select(*kept).join(new, list(keys), "left")


def inner_pair(pred: DataFrame, obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pred.join(obs, list(keys))


def outer_latest(key: str, time: str, **sources: DataFrame) -> DataFrame:
    """The latest row of each source for each key, side by side; values are prefixed by the source's name."""
    from .windows import latest_per_key

    sides = []
    for name, df in sources.items():
        last = latest_per_key(df, [key], time, *sorted(c for c in df.columns if c not in (key, time)))
        sides.append(last.select(key, *(F.col(c).alias(f"{name}_{c}") for c in last.columns if c != key)))
    return reduce(lambda a, b: a.join(b, key, "full"), sides)


def asof_nearest(left: DataFrame, right: DataFrame, by: str, time: str, values: Sequence[str], tolerance: int) -> DataFrame:
    """Each left row with the values of the nearest right row of its key within ``tolerance`` seconds; of two as near, the
    earlier. Right times are made unique first (the least values stay).

    Both sides are cut into buckets of the tolerance's width; a right row lies in reach of its own and the two
    neighbouring buckets only, so a key's series is dealt over many tasks and no window runs over a whole series.
    """
    width = max(tolerance, 1)
    packed = right.filter(F.col(time).isNotNull()).groupBy(by, time).agg(F.min(F.struct(*values)).alias("_v"))
    near = packed.select(F.col(by).alias("_by"), F.col(time).alias("match_time"), "_v", F.explode(F.array(*(F.floor(F.col(time) / width) + k for k in (-1, 0, 1)))).alias("_bucket"))
    asked = left.select(F.col(by), F.col(time)).filter(F.col(time).isNotNull()).distinct().withColumn("_own", F.floor(F.col(time) / width))
    gap = F.abs(F.col(time) - F.col("match_time"))
    hit = asked.join(near, (F.col(by) == F.col("_by")) & (F.col("_own") == F.col("_bucket"))).filter(gap <= tolerance)
    best = hit.groupBy(by, time).agg(F.min(F.struct(gap.alias("gap"), F.col("match_time").alias("t"), F.col("_v").alias("v"))).alias("_best"))
    found = best.select(by, time, F.col("_best.t").alias("match_time"), F.col("_best.gap").alias("gap"), *(F.col(f"_best.v.{v}").alias(v) for v in values))
    return left.join(found, [by, time], "left").select(*left.columns, "match_time", "gap", *values)


def asof_station_then_global(obs: DataFrame, wx: DataFrame, by: str, time: str, values: Sequence[str], tolerance: int, shared: str = "GLOBAL") -> DataFrame:
    """``asof_nearest`` by station; stations without a series of their own take the shared one. ``series`` says which."""
    own = wx.filter(F.col(by) != shared).select(F.col(by).alias("_s")).distinct()
    marked = obs.join(own, F.col(by) == F.col("_s"), "left").withColumn("series", F.when(F.col("_s").isNotNull(), F.col(by)).otherwise(F.lit(shared))).drop("_s")
    return asof_nearest(marked, wx.withColumnRenamed(by, "series"), "series", time, values, tolerance)


def interp_at(obs: DataFrame, series: DataFrame, by: str, time: str, values: Sequence[str], width: int = 86_400) -> DataFrame:
    """Values interpolated linearly in time at the observations, constant beyond the ends; ``status`` tells stations
    without a series.

    Both sides are cut into buckets of ``width`` seconds, so a station's series is dealt over tasks: rows look for their
    neighbours within the bucket, and beyond it among the first and last points of the station's buckets, which are one
    slim row each."""
    packed = series.filter(F.col(time).isNotNull()).groupBy(by, time).agg(F.min(F.struct(*values)).alias("_v"))
    at_bucket = F.floor(F.col(time) / width)
    right = packed.select(F.col(by), F.col(time), at_bucket.alias("_bucket"), F.struct(F.col(time).alias("t"), F.col("_v").alias("v")).alias("_p"))
    left = obs.select(F.col(by), F.col(time), at_bucket.alias("_bucket"), F.struct(*obs.columns).alias("_l"))
    ends = right.groupBy(by, "_bucket").agg(F.min_by("_p", time).alias("_first"), F.max_by("_p", time).alias("_last"))
    ends = ends.unionByName(left.select(by, "_bucket").distinct(), allowMissingColumns=True).groupBy(by, "_bucket").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    w = Window.partitionBy(by)
    nearest = lambda c, order: F.last(c, ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(by, "_bucket", nearest("_last", F.asc("_bucket")).alias("_before"), nearest("_first", F.desc("_bucket")).alias("_after"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(by, "_bucket")
    inside = lambda order: F.last("_p", ignorenulls=True).over(w.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_a", inside(F.asc(time))).withColumn("_b", inside(F.desc(time))).filter("_l is not null")
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_own"))
    both = both.join(ends.withColumnsRenamed({by: "_by", "_bucket": "_own"}), same, "left")
    both = both.withColumn("_a", F.coalesce("_a", "_before")).withColumn("_b", F.coalesce("_b", "_after"))

    def at(v: str):
        a, b = F.col(f"_a.v.{v}"), F.col(f"_b.v.{v}")
        part = F.try_divide(F.col("_l")[time] - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
        return F.when(F.col("_a").isNull(), b).when(F.col("_b").isNull() | (F.col("_b.t") == F.col("_a.t")), a).otherwise(a + (b - a) * part)

    status = F.when(F.col("_a").isNull() & F.col("_b").isNull(), "no_forecast_for_station").otherwise("ok")
    return both.select("_l.*", *(at(v).alias(v) for v in values), status.alias("status"))


def pair_candidates(obs: DataFrame, snapshots: DataFrame, area: str = "AOI") -> DataFrame:
    """Observations (``station, t``) with all snapshots (``location, valid, issue``) of their hour: at their own place and
    at the area's, as ``source`` station or area. Rows without a match stay."""
    rows = obs.withColumn("valid", F.col("t") - F.pmod("t", F.lit(3600)))
    own = rows.join(snapshots.withColumnRenamed("location", "station"), ["station", "valid"], "left").withColumn("source", F.lit("station"))
    wide = rows.join(snapshots.filter(F.col("location") == area).drop("location"), "valid", "left").withColumn("source", F.lit("area"))
    return own.unionByName(wide)


def pair_neighbours(obs: DataFrame, snapshots: DataFrame, area: str = "AOI") -> DataFrame:
    """``pair_candidates`` without those that ``pick_best_pair`` can't choose: of a place's snapshots for an hour, the last
    one issued up to the observation and the first one behind it. Whatever ``match_mode`` allows, the best is one of these
    two, as it is the nearest on its side. They are found by one pass over each place and hour in order of time, so rows
    grow with the inputs and not with their product. Snapshots without an issue don't count."""
    rest = [c for c in snapshots.columns if c not in ("location", "valid")]
    rows = obs.withColumn("valid", F.col("t") - F.pmod("t", F.lit(3600)))
    asked = rows.filter("t is not null").select(F.col("station").alias("location"), "valid", "t")
    asked = asked.unionByName(asked.withColumn("location", F.lit(area))).distinct()
    given = snapshots.filter("issue is not null").select("location", "valid", F.col("issue").alias("t"), F.struct(*rest).alias("_s"))
    w = Window.partitionBy("location", "valid")
    last = F.last("_s", ignorenulls=True).over(w.orderBy(F.asc("t")).rangeBetween(Window.unboundedPreceding, 0))
    behind = F.last("_s", ignorenulls=True).over(w.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1))
    both = asked.unionByName(given, allowMissingColumns=True).select("location", "valid", "t", F.col("_s").isNull().alias("_asked"), F.array_compact(F.array(last, behind)).alias("_near")).filter("_asked").drop("_asked")
    out = None
    for source, place in (("station", F.col("station")), ("area", F.lit(area))):
        side = rows.withColumn("location", place).join(both, ["location", "valid", "t"], "left")
        side = side.select(*rows.columns, F.explode_outer("_near").alias("_s")).select(*rows.columns, "_s.*", F.lit(source).alias("source"))
        out = side if out is None else out.unionByName(side)
    return out


def match_mode(cands: DataFrame, max_age_h: float = 72.0, jitter_h: float = 0.10) -> DataFrame:
    """Issue age in hours and what kind of match it is: ``operational``, ``posthoc``, ``used`` and ``mode``."""
    age = (F.col("t") - F.col("issue")) / 3600.0
    has = F.col("issue").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = cands.withColumn("age_h", age).withColumn("operational", yes(has & (age >= -jitter_h) & (age <= max_age_h))).withColumn("posthoc", yes(has & (F.abs(age) <= max_age_h)))
    mode = F.when(F.col("operational"), "operational_forecast").when(F.col("posthoc"), "posthoc_hindcast_or_forecast").when(has, "stale_or_too_far").otherwise("no_weather_match")
    return out.withColumn("used", F.col("posthoc")).withColumn("mode", mode)


def pick_best_pair(cands: DataFrame, keys: Sequence[str] = ("station", "t")) -> DataFrame:
    """One pair for each key: used first, own place first, operational first, youngest issue, latest issue. A partial
    aggregate over an order, so the many candidates of a key combine before the shuffle."""
    rest = [c for c in cands.columns if c not in keys]
    order = F.struct(
        (~F.col("used")).cast("int"), F.when(F.col("source") == "station", 0).otherwise(1), (~F.col("operational")).cast("int"),
        F.coalesce(F.abs("age_h"), F.lit(float("inf"))), -F.coalesce(F.col("issue"), F.lit(0)),
    )
    best = cands.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def nearest_station(points: DataFrame, stations: DataFrame, key: str) -> DataFrame:
    """Each point (``lat, lon``) with its nearest station (``station, slat, slon``; ties by name), its distance and class.
    Both sides may have any number of rows, and any distance is found."""
    places = stations.select("station", F.col("slon").alias("x"), F.col("slat").alias("y"))
    best = nearest(points.select(key, F.col("lon").alias("x"), F.col("lat").alias("y")), places, key, "station", metric=Sphere)
    return best.select(key, "station", F.col("d").alias("distance_m"), by_classes(F.col("d"), [(1000, "local"), (3000, "nearby")], "regional").alias("distance_class"))


def nearest_cell(stations: DataFrame, grid: DataFrame, key: str, columns: Sequence[str], local_m: float = 1000, nearby_m: float = 3000) -> DataFrame:
    """Each station (``station, slat, slon``) with its nearest cell (``lat, lon``; ties by id), its distance, how far the
    cell stands for it, and the cell's ``columns`` prefixed by ``station_nearest_grid_``."""
    cells = grid.select(key, F.col("lon").alias("x"), F.col("lat").alias("y"), *columns)
    best = nearest(stations.select("station", F.col("slon").alias("x"), F.col("slat").alias("y")), cells, "station", key, metric=Sphere, keep=columns)
    cls = by_classes(F.col("d"), [(local_m, "local_grid_proxy"), (nearby_m, "nearby_grid_proxy")], "regional_distance_not_representative")
    return best.select("station", F.col(key).alias("nearest_grid_cell"), F.col("d").alias("nearest_grid_distance_m"), cls.alias("morphology_representativeness"), *(F.col(c).alias(f"station_nearest_grid_{c}") for c in columns))


def sim_vs_proxy(sim: DataFrame, proxy: DataFrame, value: str, mode: str) -> DataFrame:
    """Simulated values beside proxy values, their difference and a label of the mode: matched by ``cell_hour`` or by
    ``hour`` alone, or with the cell's mean over the period (``period_mean``). Rows without a partner stay."""
    keys = {"cell_hour": ["cell", "hour"], "hour": ["hour"], "period_mean": ["cell"]}[mode]
    mean = proxy.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("proxy"))
    return sim.join(mean, keys, "left").withColumns({"delta": F.col(value) - F.col("proxy"), "mode": F.lit(mode)})


def fallback_key_join(a: DataFrame, b: DataFrame, keys: Sequence[str], fallback: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join on ``keys``; values missing after it come from the means by ``fallback``, then from the medians of ``b``."""
    exact = b.groupBy(*keys).agg(*(F.avg(v).alias(f"_k_{v}") for v in values))
    wider = b.groupBy(*fallback).agg(*(F.avg(v).alias(f"_f_{v}") for v in values))
    middle = column_quantiles(b, {f"_m_{v}": (v, 0.5) for v in values})  # one row
    joined = a.join(exact, list(keys), "left").join(wider, list(fallback), "left").crossJoin(F.broadcast(middle))
    return joined.select(*a.columns, *(F.coalesce(f"_k_{v}", f"_f_{v}", f"_m_{v}").alias(v) for v in values))


def decay_access(cells: DataFrame, nodes: DataFrame, decay: float, radius: float) -> DataFrame:
    """For each cell (``cell, x, y``) and node type: sum of weight * exp(-d / decay) over nodes (``nx, ny, type, weight``)
    within ``radius``, and their number. Nodes of one place and type are summed first, then copied to the nine buckets that
    can reach them, so this is an equi-join of places; sums are partial aggregates."""
    places = nodes.groupBy("nx", "ny", "type").agg(F.sum("weight").alias("weight"), F.count("*").alias("nodes"))
    near = places.select("nx", "ny", "type", "weight", "nodes", F.explode(F.array(*(F.struct((F.floor(F.col("nx") / radius) + i).alias("bx"), (F.floor(F.col("ny") / radius) + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("b"))
    near = near.select("nx", "ny", "type", "weight", "nodes", "b.bx", "b.by")
    here = cells.select("cell", "x", "y", F.floor(F.col("x") / radius).alias("bx"), F.floor(F.col("y") / radius).alias("by"))
    d = F.sqrt(F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2))
    hit = here.join(near, ["bx", "by"]).withColumn("d", d).filter(F.col("d") <= radius)
    return hit.groupBy("cell", "type").agg(F.sum(F.col("weight") * F.exp(-F.col("d") / decay)).alias("access"), F.sum("nodes").alias("nodes"))


def members(df: DataFrame, other: DataFrame, keys: Sequence[str], inside: bool = True) -> DataFrame:
    """Rows whose key is, or isn't, in ``other``."""
    return df.join(other, list(keys), "left_semi" if inside else "left_anti")


def clip_to_box(df: DataFrame, box: tuple[float, float, float, float], buffer: float = 0.0) -> DataFrame:
    """Rows whose bounding box (``x_min, y_min, x_max, y_max``) meets a buffered box; range tests that reach the scan."""
    x0, y0, x1, y1 = box
    return df.filter((F.col("x_max") >= x0 - buffer) & (F.col("x_min") <= x1 + buffer) & (F.col("y_max") >= y0 - buffer) & (F.col("y_min") <= y1 + buffer))


def overlay_area(cells: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Share of each square cell (``cell, x, y``: south-west corner) that boxes (``x_min..y_max``) cover, summed and clipped
    to [0, 1]; 0 where none does. A box goes to the cells that it touches by key."""
    at = lambda c: F.floor(F.col(c) / size)
    spread = boxes.withColumn("kx", F.explode(F.sequence(at("x_min"), at("x_max")))).withColumn("ky", F.explode(F.sequence(at("y_min"), at("y_max"))))
    here = cells.withColumn("kx", F.floor(F.col("x") / size)).withColumn("ky", F.floor(F.col("y") / size))
    wide = clip(F.least(F.col("x_max"), F.col("x") + size) - F.greatest(F.col("x_min"), F.col("x")), 0)
    high = clip(F.least(F.col("y_max"), F.col("y") + size) - F.greatest(F.col("y_min"), F.col("y")), 0)
    area = here.join(spread, ["kx", "ky"]).groupBy("cell").agg(F.sum(wide * high).alias("_area"))
    return cells.join(area, "cell", "left").select("cell", clip(F.coalesce(F.col("_area"), F.lit(0.0)) / (size * size), 0, 1).alias("covered"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, key: str, box_id: str) -> DataFrame:
    """Each point (``px, py``) with the first box, by id, that holds it; null where none does."""
    at = lambda c: F.floor(F.col(c) / size)
    spread = boxes.withColumn("kx", F.explode(F.sequence(at("x_min"), at("x_max")))).withColumn("ky", F.explode(F.sequence(at("y_min"), at("y_max"))))
    here = points.withColumn("kx", at("px")).withColumn("ky", at("py"))
    inside = (F.col("px") >= F.col("x_min")) & (F.col("px") <= F.col("x_max")) & (F.col("py") >= F.col("y_min")) & (F.col("py") <= F.col("y_max"))
    hit = here.join(spread, ["kx", "ky"]).filter(inside).groupBy(key).agg(F.min(box_id).alias(box_id))
    return points.join(hit, key, "left").select(key, box_id)
