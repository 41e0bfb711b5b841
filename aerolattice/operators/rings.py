"""Areas of overlap of shapes, in one vectorised pandas UDF or pass over Arrow batches each; joins stay equi-joins by cell key.

A shape is an array of rings under the even-odd rule: outlines, holes and parts alike. A ring is a shape of one ring.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import in_shape, ring_area, ring_box, shape_area, shape_distance
from ..session import ship_package, stored
from .batches import groups_of
from .geo import pairs_of_members
from .neighbours import SIDES, nearest_boxed


def _points(ring) -> list[tuple[float, float]]:
    pts = [(p["x"], p["y"]) for p in ring]
    return pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts


def signed_area(pts: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1])) / 2


def clipped(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a ring inside a convex counter-clockwise window, edge by edge (Sutherland and Hodgman). Degenerate
    edges of a concave subject cancel in the area."""
    out = subject
    for a, b in zip(window, window[1:] + window[:1]):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: E731, B023
        ring, out = out, []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            dp, dq = side(p), side(q)
            if dp >= 0:
                out.append(p)
            if (dp > 0 > dq) or (dp < 0 < dq):
                t = dp / (dp - dq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            break
    return out


Ring = Sequence[tuple[float, float]]
#: Numbers that the sweep holds in one array.
BLOCK = 2_000_000


def _edges(shape: Sequence[Ring]) -> np.ndarray:
    """``x1, y1, x2, y2`` of the edges that aren't upright, from left to right."""
    parts = []
    for ring in shape:
        if len(ring) > 2:
            p = np.asarray(ring, float)
            parts.append(np.hstack([p, np.roll(p, -1, axis=0)]))
    e = np.concatenate(parts) if parts else np.zeros((0, 4))
    e = e[e[:, 0] != e[:, 2]]
    return np.where((e[:, 0] > e[:, 2])[:, None], e[:, [2, 3, 0, 1]], e)


def covered_area(subject: Sequence[Ring], others: Sequence[Sequence[Ring]], window: Ring | None = None) -> float:
    """Area of the part of ``subject`` that lies in any of ``others`` (and in the ``window``), by a sweep over x.

    Between two neighbouring x of ends and crossings of edges, edges don't cross, so an upright line in the middle tells the
    area: it is walked upwards, and each edge switches its shape on or off."""
    shapes = [subject, *([] if window is None else [[window]]), *others]
    first = len(shapes) - len(others)
    every = [_edges(s) for s in shapes]
    if not others or any(not len(e) for e in every[:first]):
        return 0.0
    low, high = max(e[:, 0].min() for e in every[:first]), min(e[:, 2].max() for e in every[:first])
    edges, of = np.concatenate(every), np.repeat(np.arange(len(shapes)), [len(e) for e in every])
    near = (edges[:, 2] > low) & (edges[:, 0] < high)
    (x1, y1, x2, y2), of = edges[near].T, of[near]
    if low >= high:
        return 0.0
    slope = (y2 - y1) / (x2 - x1)
    base = y1 - slope * x1
    cuts, step = [x1, x2, np.array([low, high])], max(1, BLOCK // len(x1))
    for k in range(0, len(x1), step):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (base[None, :] - base[k : k + step, None]) / (slope[k : k + step, None] - slope[None, :])
        cuts.append(x[(x > np.maximum(x1[k : k + step, None], x1)) & (x < np.minimum(x2[k : k + step, None], x2))])
    cuts = np.unique(np.concatenate(cuts))
    cuts = cuts[(cuts >= low) & (cuts <= high)]
    total = 0.0
    for k in range(0, len(cuts) - 1, step):
        ends = cuts[k : k + step + 1]
        middle = ((ends[1:] + ends[:-1]) / 2)[:, None]
        on = (x1 <= middle) & (middle < x2)
        y = np.where(on, slope * middle + base, np.inf)
        order = np.argsort(y, axis=1, kind="stable")
        y, owner = np.take_along_axis(y, order, axis=1), np.where(np.take_along_axis(on, order, axis=1), of[order], -1)
        switched = lambda s: np.cumsum(owner == s, axis=1) % 2 == 1  # noqa: B023, E731
        inside, any_other = switched(0), np.zeros(owner.shape, bool)
        for s in range(1, first):
            inside &= switched(s)
        for s in range(first, len(shapes)):
            any_other |= switched(s)
        with np.errstate(invalid="ignore"):
            gaps = np.where((inside & any_other)[:, :-1], y[:, 1:] - y[:, :-1], 0.0)
        total += float(((ends[1:] - ends[:-1]) * np.nansum(gaps, axis=1)).sum())
    return total


def _flat_edges(shapes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``_edges`` of an array of shapes, as columns, and the number of each one's shape. Shapes with unknown coordinates have
    none."""
    counts = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    per_shape, rings = counts(shapes), shapes.flatten()
    per_ring, points = counts(rings), rings.flatten()
    x, y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
    of = np.repeat(np.repeat(np.arange(len(shapes)), per_shape), per_ring)
    ends = np.cumsum(per_ring)
    follower = np.arange(1, len(x) + 1)
    follower[ends[per_ring > 0] - 1] = (ends - per_ring)[per_ring > 0]
    e = np.stack([x, y, x[follower], y[follower]])
    unknown = np.zeros(len(shapes), bool)
    unknown[of[np.isnan(x) | np.isnan(y)]] = True
    use = (e[0] != e[2]) & ~unknown[of]
    e, of = e[:, use], of[use]
    return np.where(e[0] > e[2], e[[2, 3, 0, 1]], e), of


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ranges, and each number of them, one range after another."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[which]


def _crossings(e: np.ndarray, of: np.ndarray, asked: np.ndarray) -> list[np.ndarray]:
    """Places (x) where edges cross that aren't of two shapes asked about. Edges are in order of their left ends, and only
    those that have an x in common are compared, as many at once as an array may hold."""
    x1, y1, x2, y2 = e
    slope = (y2 - y1) / (x2 - x1)
    base, out, n = y1 - slope * x1, [], len(x1)
    later = np.searchsorted(x1, x2) - np.arange(1, n + 1)
    if not slope.any():
        return out
    upto, i = np.cumsum(later), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BLOCK // 4, side="right")))
        a, b = _ranges(np.arange(i + 1, j + 1), later[i:j])
        a += i
        use = (slope[a] != slope[b]) & (~asked[of[a]] | ~asked[of[b]] | (of[a] == of[b]))
        a, b = a[use], b[use]
        x = (base[b] - base[a]) / (slope[a] - slope[b])
        out.append(x[(x > x1[b]) & (x < np.minimum(x2[a], x2[b]))])
        i = j
    return out


def _covered_strip(e: np.ndarray, of: np.ndarray, asked: np.ndarray, window: tuple[float, float, float, float], out: np.ndarray) -> None:
    """Adds the covered areas in a window (x0, x1, y0, y1) to ``out``.

    Between two neighbouring x of ends and crossings, what an upright line in the middle meets tells the areas. Walked
    upwards, each edge switches its shape on or off. The length of the line that others cover below each edge is summed up,
    so the part of it that is covered inside a shape is the sum at its upper edges less that at its lower ones."""
    left, right, low, high = window
    near = (e[2] > left) & (e[0] < right)
    e, of = e[:, near], of[near]
    if not asked[of].any() or asked[of].all():
        return
    order = np.argsort(e[0], kind="stable")
    (x1, y1, x2, y2), of = e[:, order], of[order]
    slope = (y2 - y1) / (x2 - x1)
    cuts = [x1, x2, np.array([left, right]), *_crossings(e[:, order], of, asked)]
    bent = slope != 0
    for y in (low, high):
        x = x1[bent] + (y - y1[bent]) / slope[bent]
        cuts.append(x[(x > x1[bent]) & (x < x2[bent])])
    cuts = np.unique(np.concatenate(cuts))
    cuts = cuts[(cuts >= left) & (cuts <= right)]
    begin, end = np.searchsorted(cuts, np.maximum(x1, left)), np.searchsorted(cuts, np.minimum(x2, right))
    met = np.cumsum(np.cumsum(np.bincount(begin, minlength=len(cuts)) - np.bincount(end, minlength=len(cuts))))
    k = 0
    while k < len(cuts) - 1:
        to = min(len(cuts) - 1, max(k + 1, int(np.searchsorted(met, (met[k - 1] if k else 0) + BLOCK // 4, side="right"))))
        first, last = np.maximum(begin, k), np.minimum(end, to)
        here = np.flatnonzero(first < last)
        which, slab = _ranges(first[here], (last - first)[here])
        edge = here[which]
        y = y1[edge] + slope[edge] * ((cuts[slab] + cuts[slab + 1]) / 2 - x1[edge])
        by = np.lexsort((y, of[edge], slab))
        edge, slab, y = edge[by], slab[by], np.clip(y[by], low, high)
        # A shape has an even number of edges in each slab, so they open and close it by turns.
        step = 1 - 2 * (np.arange(len(edge)) % 2)
        by = np.lexsort((y, slab))
        edge, slab, y, step = edge[by], slab[by], y[by], step[by]
        mine = asked[of[edge]]
        on = np.cumsum(np.where(mine, 0, step)) > 0
        below = np.concatenate([[0.0], np.cumsum(np.where(on[:-1] & (slab[1:] == slab[:-1]), y[1:] - y[:-1], 0.0))])
        out += np.bincount(of[edge[mine]], weights=(-step * below * (cuts[slab + 1] - cuts[slab]))[mine], minlength=len(out))
        k = to


#: Shapes from which a window is cut into strips, where that leaves each strip clearly fewer.
CROWD = 64


def covered_parts(shapes: pa.Array, asked: np.ndarray, window: tuple[float, float, float, float]) -> np.ndarray:
    """For each shape that is ``asked`` about, the area of its part in the window (x0, x1, y0, y1) that the other ones, those
    not asked about, cover together. One sweep serves all shapes."""
    out = np.zeros(len(shapes))
    e, of = _flat_edges(shapes)
    bottom, top = np.full(len(shapes), np.inf), np.full(len(shapes), -np.inf)
    np.minimum.at(bottom, of, np.minimum(e[1], e[3]))
    np.maximum.at(top, of, np.maximum(e[1], e[3]))
    strips = [(window[2], window[3], np.flatnonzero((bottom < window[3]) & (top > window[2])))]
    while strips:
        low, high, held = strips.pop()
        middle = (low + high) / 2
        if len(held) > CROWD and low < middle < high:
            halves = held[bottom[held] < middle], held[top[held] > middle]
            if len(halves[0]) + len(halves[1]) < 1.5 * len(held):
                strips += [(low, middle, halves[0]), (middle, high, halves[1])]
                continue
        use = np.zeros(len(shapes), bool)
        use[held] = True
        use = use[of]
        _covered_strip(e[:, use], of[use], asked, (window[0], window[1], low, high), out)
    return out


def _covered_cells(batches: Iterator[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    """``covered_parts`` of each cell (``kx, ky``) of batches that are ordered by it: ``_class, part``. Shapes without a class
    are the others."""
    for t in groups_of(batches, "kx", "ky"):
        asked = t["_class"].is_valid().to_numpy()
        if asked.all() or not asked.any():
            continue
        x, y = t["kx"][0].as_py() * size, t["ky"][0].as_py() * size
        part = covered_parts(t["shape"].chunk(0), asked, (x, x + size, y, y + size))
        yield pa.record_batch({"_class": t["_class"].filter(pa.array(asked)).combine_chunks(), "part": pa.array(part[asked])})


def overlap(a: Ring, b: Ring) -> float:
    """Area common to two rings."""
    return covered_area([a], [[b]])


def _overlap_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([covered_area([_points(r) for r in x], [[_points(r) for r in y]]) for x, y in zip(a, b)], dtype="float64")


def _window_series(ring: pd.Series, x: pd.Series, y: pd.Series, size: pd.Series) -> pd.Series:
    squares = ([(u, v), (u + s, v), (u + s, v + s), (u, v + s)] for u, v, s in zip(x, y, size))
    return pd.Series([abs(signed_area(clipped(_points(r), w))) for r, w in zip(ring, squares)], dtype="float64")


def shape_overlap(a: Column, b: Column) -> Column:
    return F.pandas_udf(_overlap_series, "double")(a, b)


def with_shape(rows: DataFrame) -> DataFrame:
    """``rows`` with ``shape``: their own, or their ``ring`` as one."""
    return rows if "shape" in rows.columns else rows.withColumn("shape", F.array("ring"))


def _shape_classes(rows: DataFrame) -> DataFrame:
    """The distinct shapes, numbered (``_class``)."""
    return stored(rows.select("shape").distinct().withColumn("_class", F.monotonically_increasing_id()), "shape-classes")


def _first_of_equal(rows: DataFrame, name: str) -> DataFrame:
    """Of rows with equal shapes the first by name, which wins all ties with the others."""
    return rows.groupBy("shape").agg(F.min(F.struct(name)).alias("_first")).select(F.col(f"_first.{name}").alias(name), "shape")


def _in_cells(rows: DataFrame, size: float, reach: float = 0.0) -> DataFrame:
    """A row for each square cell (``kx, ky``) that the box of a shape, made larger by ``reach``, touches, with the box."""
    at = lambda c: F.floor(c / size)
    rows = rows.withColumns(ring_box(F.flatten("shape")))
    rows = rows.withColumn("kx", F.explode(F.sequence(at(F.col("x_min") - reach), at(F.col("x_max") + reach))))
    return rows.withColumn("ky", F.explode(F.sequence(at(F.col("y_min") - reach), at(F.col("y_max") + reach))))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` by their cells over all cores: the work on shapes that meet is much for few bytes, by which Spark would put
    the cells together again."""
    return rows.repartition(4 * max(2, rows.sparkSession.sparkContext.defaultParallelism), "kx", "ky")


def covered_share(shapes: DataFrame, others: DataFrame, key: str, size: float) -> DataFrame:
    """``key, area, covered, share``: how much of each shape the ``others`` cover together; where they overlap each other,
    once. Shapes and others meet by the square cells of width ``size`` that their boxes touch: a cell's distinct shapes and
    others come as rows of their own, and one sweep over all of them tells the part of each shape there. A shape without an area has no share. Rows have a ``ring`` or a ``shape``, of which the first ring is the outline
    and the others are holes."""
    ship_package(shapes.sparkSession)
    rows = with_shape(shapes).select(key, "shape")
    own = _shape_classes(rows)
    theirs = with_shape(others).select("shape").distinct()
    plain = F.transform("shape", lambda ring: F.transform(ring, lambda p: F.struct(*(p[c].cast("double").alias(c) for c in "xy"))))
    both = own.select("_class", plain.alias("shape")).unionByName(theirs.select(F.lit(None).cast("long").alias("_class"), plain.alias("shape")))
    cells = _dealt(_in_cells(both, size).select("kx", "ky", "_class", "shape")).sortWithinPartitions("kx", "ky")
    found = cells.mapInArrow(lambda batches: _covered_cells(batches, float(size)), "_class long, part double").groupBy("_class").agg(F.sum("part").alias("covered"))
    found = own.join(found, "_class").select("shape", "covered")
    out = rows.join(found, "shape", "left").select(key, shape_area(F.col("shape")).alias("area"), F.coalesce("covered", F.lit(0.0)).alias("covered"))
    return out.withColumn("share", F.when(F.col("area") > 0, F.least(F.col("covered") / F.col("area"), F.lit(1.0))))


def overlay_rings(cells: DataFrame, rings: DataFrame, size: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of rings (``ring``) in square cells (``cell, x, y``): ``cell, piece_area`` and columns of the ring. A ring
    goes to the cells that its box touches by key."""
    ship_package(cells.sparkSession)
    spread = rings.withColumns(ring_box(F.col("ring")))
    at = lambda c: F.floor(F.col(c) / size)
    spread = spread.withColumn("kx", F.explode(F.sequence(at("x_min"), at("x_max")))).withColumn("ky", F.explode(F.sequence(at("y_min"), at("y_max"))))
    here = cells.select("cell", "x", "y", at("x").alias("kx"), at("y").alias("ky"))
    area = F.pandas_udf(_window_series, "double")("ring", "x", "y", F.lit(float(size)))
    return here.join(spread.select("kx", "ky", "ring", *keep), ["kx", "ky"]).withColumn("piece_area", area).filter("piece_area > 0").select("cell", "piece_area", *keep)


def ring_iou_pairs(rings: DataFrame, key: str, size: float) -> DataFrame:
    """Pairs of rings or shapes (a before b) that overlap, with intersection and IoU; a pair is computed in its first common
    square. Distinct shapes are compared once; only the result holds each pair of rows."""
    ship_package(rings.sparkSession)
    rows = with_shape(rings).select(key, "shape")
    classes = _shape_classes(rows)
    spread = _in_cells(classes, size)
    cols = ["_class", "shape", "x_min", "x_max", "y_min", "y_max"]
    a, b = (spread.select("kx", "ky", *(F.col(c).alias(f"{s}_{c}") for c in cols)) for s in ("a", "b"))
    left, low = F.greatest("a_x_min", "b_x_min"), F.greatest("a_y_min", "b_y_min")
    meet = (F.col("a__class") <= F.col("b__class")) & (F.least("a_x_max", "b_x_max") > left) & (F.least("a_y_max", "b_y_max") > low)
    j = _dealt(a).join(b, ["kx", "ky"]).filter(meet & (F.floor(left / size) == F.col("kx")) & (F.floor(low / size) == F.col("ky")))
    j = j.withColumn("intersection", shape_overlap(F.col("a_shape"), F.col("b_shape"))).filter("intersection > 0")
    union = shape_area(F.col("a_shape")) + shape_area(F.col("b_shape")) - F.col("intersection")
    pairs = stored(j.select(F.col("a__class").alias("a"), F.col("b__class").alias("b"), "intersection", (F.col("intersection") / union).alias("iou")), "shape-pairs")
    return pairs_of_members(pairs, rows.join(classes, "shape").select(key, "_class"), key)


def nearest_polygon(points: DataFrame, rings: DataFrame, key: str, name: str, reach: float, none: float = 9999.0) -> DataFrame:
    """Distance of each point (``px, py``) to the nearest ring or shape within ``reach`` (0 inside) and its name; ``none``
    where there is none. Shapes go to the cells of width ``reach`` within reach of their boxes, of equal ones the first."""
    at = lambda c: F.floor(c / reach)
    spread = _in_cells(_first_of_equal(with_shape(rings), name), reach, reach)
    here = points.select(key, "px", "py", at(F.col("px")).alias("kx"), at(F.col("py")).alias("ky"))
    d = shape_distance(F.col("px"), F.col("py"), F.col("shape"))
    off = lambda c, s: F.greatest(F.col(f"{s}_min") - c, c - F.col(f"{s}_max"), F.lit(0.0))
    met = _dealt(here).join(spread, ["kx", "ky"]).filter((off(F.col("px"), "x") <= reach) & (off(F.col("py"), "y") <= reach))
    near = met.withColumn("d", d).filter(F.col("d") <= reach).groupBy(key).agg(F.min(F.struct("d", name)).alias("b"))
    return points.select(key).join(near, key, "left").select(key, F.coalesce("b.d", F.lit(none)).alias("distance"), F.col(f"b.{name}").alias(name))


def nearest_polygon_anywhere(points: DataFrame, rings: DataFrame, key: str, name: str, radius: float, least_area: float = 0.0) -> DataFrame:
    """``nearest_polygon`` for all points, however far. ``least_area`` leaves smaller polygons out. Points without
    coordinates have no polygon. With ``radius``, points look for polygons within it first, by cells; those that find none
    go down the polygons' tree of squares (see ``neighbours``), so no cell grows with the distance."""
    large = stored(_first_of_equal(with_shape(rings).filter(shape_area(F.col("shape")) >= least_area), name), "rings")
    points = points.filter("px is not null and py is not null")
    found = nearest_polygon(points, large, key, name, radius)
    if not large.limit(1).count():
        return found
    found = stored(found, "nearest")
    far = points.join(found.filter(F.col(name).isNull()).select(key), key, "left_semi").select(key, F.col("px").alias("x"), F.col("py").alias("y"))
    boxed = large.withColumns(ring_box(F.flatten("shape"))).filter("x_min is not null")
    boxed = boxed.select(name, "shape", ((F.col("x_min") + F.col("x_max")) / 2).alias("x"), ((F.col("y_min") + F.col("y_max")) / 2).alias("y"), *(F.col(f"{s[0]}_{e}").alias(s) for s, e in zip(SIDES, ("min", "max", "min", "max"))))
    best = nearest_boxed(far, boxed, key, name, lambda x, y: shape_distance(x, y, F.col("shape")))
    return found.filter(F.col(name).isNotNull()).unionByName(best.select(key, F.col("d").alias("distance"), name))


def first_containing(points: DataFrame, rings: DataFrame, key: str, name: str, size: float) -> DataFrame:
    """Each point with the first ring or shape, by name, that holds it; points in a hole aren't held."""
    at = lambda c: F.floor(F.col(c) / size)
    spread = _in_cells(_first_of_equal(with_shape(rings), name), size)
    boxed = F.col("px").between(F.col("x_min"), F.col("x_max")) & F.col("py").between(F.col("y_min"), F.col("y_max"))
    hit = _dealt(points.select(key, "px", "py", at("px").alias("kx"), at("py").alias("ky"))).join(spread, ["kx", "ky"]).filter(boxed).filter(in_shape(F.col("px"), F.col("py"), F.col("shape")))
    first = F.row_number().over(Window.partitionBy(key).orderBy(name))
    return points.select(key).join(hit.withColumn("_k", first).filter("_k = 1").select(key, name), key, "left")
