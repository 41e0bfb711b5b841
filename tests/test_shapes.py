"""Shapes with holes and unions, against points on a fine grid and against parts that add up."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aerolattice.functions import scalars as S
from aerolattice.operators import geo, rings


def inside(x, y, shape):
    odd = False
    for ring in shape:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


def star(rng, cx, cy, r):
    import math

    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 9)))
    return [(cx + (k := rng.uniform(0.3, 1) * r) * math.cos(t), cy + k * math.sin(t)) for t in turns]


def test_covered_area_equals_counted_points():
    rng = random.Random(5)
    for _ in range(25):
        shapes = [[star(rng, rng.uniform(3, 7), rng.uniform(3, 7), 3), *([star(rng, 5, 5, 1.2)] if rng.random() < 0.5 else [])] for _ in range(rng.randint(2, 5))]
        n = 160
        points = [((i + 0.5) * 10 / n, (j + 0.5) * 10 / n) for i in range(n) for j in range(n)]
        hits = [p for p in points if inside(*p, shapes[0]) and any(inside(*p, s) for s in shapes[1:])]
        got = rings.covered_area(shapes[0], shapes[1:])
        assert got == pytest.approx(len(hits) * 100 / n / n, rel=0.03, abs=0.15)
        # Windows that tile the plane share the area out; order of rings and of shapes doesn't matter.
        tiles = [[(x, y), (x + 4, y), (x + 4, y + 4), (x, y + 4)] for x in range(-4, 12, 4) for y in range(-4, 12, 4)]
        assert sum(rings.covered_area(shapes[0], shapes[1:], t) for t in tiles) == pytest.approx(got, abs=1e-9)
        assert rings.covered_area([r[::-1] for r in shapes[0][::-1]], shapes[:0:-1]) == pytest.approx(got, abs=1e-9)


def test_covered_area_of_courtyards():
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    yard = [square(0, 10), square(2, 8)]
    assert rings.covered_area(yard, [yard]) == pytest.approx(64)
    assert rings.covered_area(yard, [[square(3, 7)]]) == 0  # stands in the courtyard
    assert rings.covered_area([square(3, 7)], [yard]) == 0
    assert rings.covered_area([square(0, 10)], [yard, [square(1, 9)]]) == pytest.approx(100)
    assert rings.covered_area([square(0, 10)], [[square(0, 4)], [square(2, 6)], [square(2, 6)]]) == pytest.approx(16 + 16 - 4)
    assert rings.covered_area([square(0, 1), square(5, 6)], [[square(0, 10)]]) == pytest.approx(2)  # two parts
    assert rings.covered_area([], [yard]) == rings.covered_area(yard, []) == rings.covered_area([[(0, 0), (1, 1)]], [yard]) == 0


def test_union_area_of_boxes(spark):
    rng = random.Random(2)
    for _ in range(6):
        boxes = [(a, a + rng.randint(1, 6), b, b + rng.randint(1, 6)) for a, b in ((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(1, 8)))]
        want = sum(any(a <= x < b and c <= y < d for a, b, c, d in boxes) for x in range(16) for y in range(16))
        own = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x0", "x1", "y0", "y1"), b))) for b in boxes))
        assert spark.range(1).select(geo.union_area(own).alias("a")).first().a == pytest.approx(want)


def test_points_in_courtyards(spark):
    ring = lambda a, b: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((a, a), (b, a), (b, b), (a, b))))
    yard = F.array(ring(0, 10), ring(2, 8))
    points = spark.createDataFrame([(1, 1.0, 5.0), (2, 5.0, 4.0), (3, 13.0, 14.0), (4, None, 1.0)], "p long, px double, py double")
    got = {r.p: (r.i, r.d) for r in points.select("p", S.in_shape(F.col("px"), F.col("py"), yard).alias("i"), S.shape_distance(F.col("px"), F.col("py"), yard).alias("d")).collect()}
    assert got[1] == (True, 0.0) and got[2] == (False, 2.0) and got[3] == (False, 5.0)
    assert spark.range(1).select(S.shape_area(yard).alias("a"), S.shape_area(F.array(ring(0, 3))).alias("b"), S.shape_area(F.slice(yard, 1, 0)).alias("c")).first() == (64.0, 9.0, 0.0)
    shapes = spark.createDataFrame([("a",)], "name string").withColumn("shape", yard)
    assert {r.p: r.name for r in rings.first_containing(points, shapes, "p", "name", 4.0).collect()} == {1: "a", 2: None, 3: None, 4: None}
    assert {r.p: (r.distance, r.name) for r in rings.nearest_polygon_anywhere(points, shapes, "p", "name", 1.0).collect()} == {1: (0.0, "a"), 2: (2.0, "a"), 3: (5.0, "a")}


def test_covered_share_of_odd_rows(spark):
    ring = lambda a, b: F.array(*(F.struct((F.col("k") * 0 + x).alias("x"), (F.col("k") * 0 + y).alias("y")) for x, y in ((a, a), (b, a), (b, b), (a, b))))
    one = spark.createDataFrame([(1.0,)], "k double")
    shapes = one.withColumn("shape", F.array(ring(0.0, 10.0))).unionByName(one.select(F.lit(2.0).alias("k"), F.array(ring(50.0, 60.0)).alias("shape"))).unionByName(one.select(F.lit(3.0).alias("k"), F.array(ring(1.0, 1.0)).alias("shape")))
    others = one.withColumn("ring", ring(5.0, 20.0))
    got = {r.k: (r.covered, r.share) for r in rings.covered_share(shapes, others.union(others), "k", 3.0).collect()}
    assert got == {1.0: (pytest.approx(25), pytest.approx(0.25)), 2.0: (0.0, 0.0), 3.0: (0.0, None)}
    assert {r.share for r in rings.covered_share(shapes, others.limit(0), "k", 3.0).collect()} == {0.0, None}


def test_one_sweep_covers_all_shapes_of_a_window(monkeypatch):
    rng = random.Random(8)
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    for block, crowd in ((2_000_000, 64), (64, 2)):
        for whole in (True, False):
            number = (lambda a, b: float(rng.randint(a, b))) if whole else rng.uniform
            ring = lambda: [(number(-9, 9), number(-9, 9)) for _ in range(rng.choice((2, 3, 4, 6)))]
            shapes = [[ring() for _ in range(rng.choice((0, 1, 2, 3)))] for _ in range(14)]
            asked = np.array([rng.random() < 0.5 for _ in shapes])
            window = (-5.0, 6.0, -7.0, 4.0)
            others = [s for s, a in zip(shapes, asked) if not a]
            want = [rings.covered_area(s, others, [(-5, -7), (6, -7), (6, 4), (-5, 4)]) if a else 0.0 for s, a in zip(shapes, asked)]
            lists = pa.array([[[{"x": x, "y": y} for x, y in r] for r in s] for s in shapes], kind)
            monkeypatch.setattr(rings, "BLOCK", block)
            monkeypatch.setattr(rings, "CROWD", crowd)
            assert rings.covered_parts(lists, asked, window) == pytest.approx(np.array(want), abs=1e-9)
            monkeypatch.undo()


def test_crowded_cells_of_shapes_are_swept_once(spark):
    ring = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((0, 0), (30, 0), (30, 20), (0, 20))))
    rows = spark.range(900).select("id", (F.col("id") * 7 % 90 / 10.0).alias("x"), (F.col("id") * 11 % 80 / 10.0 + F.col("id") / 1000).alias("y")).withColumn("ring", ring)
    got = rings.covered_share(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1 and id < 450"), "id", 100.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join Inner, ((kx" not in plan  # no list, nor pairs, of what each shape meets
    boxes = [(r.x, r.y) for r in rows.orderBy("id").collect()]
    sample = {r.id: r.covered for r in got.filter("id % 100 = 0").collect()}
    cover = lambda k: rings.covered_area([square_at(*boxes[k])], [[square_at(*boxes[i])] for i in range(1, 450, 2)])
    assert len(sample) == 9 and sample[100] == pytest.approx(cover(100))


def square_at(x, y):
    return [(x, y), (x + 30, y), (x + 30, y + 20), (x, y + 20)]
