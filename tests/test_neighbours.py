"""Nearest neighbours at any distance against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from aerolattice.operators import geo, neighbours, pairing


def places(rng, n, centre=(0.0, 0.0), spread=1000.0):
    return [(centre[0] + rng.uniform(-spread, spread), centre[1] + rng.uniform(-spread, spread)) for _ in range(n)]


def frame(spark, rows, name):
    return spark.createDataFrame([(k, float(x) if x is not None else None, float(y) if y is not None else None) for k, (x, y) in enumerate(rows)], f"{name} long, x double, y double")


def haversine(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_in_the_plane(spark, k):
    rng = random.Random(k)
    # A wide field, a cluster many times denser, a place with many targets, and points far from all.
    targets = places(rng, 60) + places(rng, 150, (5000, 5000), 2.0) + [(100.0, 100.0)] * 60
    points = places(rng, 40, spread=1500.0) + places(rng, 25, (5000, 5000), 3.0) + [(1e6, -2e6), (-3e5, 4.0), (100.0, 100.0), (None, 1.0)]
    got = {}
    for r in neighbours.nearest(frame(spark, points, "p"), frame(spark, targets, "t"), "p", "t", k).collect():
        got.setdefault(r.p, []).append((r["rank"], r.t, r.d))
    for i, p in enumerate(points):
        if p[0] is None:
            assert i not in got
            continue
        best = sorted((math.dist(p, t), j) for j, t in enumerate(targets))[:k]
        assert [(n, j) for n, j, _ in sorted(got[i])] == [(n + 1, j) for n, (_, j) in enumerate(best)]
        assert [d for *_, d in sorted(got[i])] == pytest.approx([d for d, _ in best])


def test_nearest_on_the_sphere(spark):
    rng = random.Random(9)
    targets = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(150)] + [(179.9, 10.0), (-179.8, -20.0), (0.0, 90.0)]
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(120)] + [(-179.9, 10.0), (179.95, -20.0), (77.0, 89.9), (12.0, -90.0)]
    got = {r.p: r.d for r in neighbours.nearest(frame(spark, points, "p"), frame(spark, targets, "t"), "p", "t", metric=neighbours.Sphere).collect()}
    for i, p in enumerate(points):
        assert got[i] == pytest.approx(min(haversine(p, t) for t in targets), rel=1e-9, abs=1e-6)


def test_few_and_no_targets(spark):
    points, one = frame(spark, [(0, 0), (5, 5)], "p"), frame(spark, [(3, 4)], "t")
    assert {(r.p, r.t, r.d) for r in neighbours.nearest(points, one, "p", "t", 3).collect()} == {(0, 0, 5.0), (1, 0, math.sqrt(5))}
    assert neighbours.nearest(points, one.limit(0), "p", "t").count() == 0 and neighbours.nearest(points.limit(0), one, "p", "t").count() == 0


def test_knn_distance_leaves_the_point_itself_out(spark):
    rng = random.Random(3)
    pts = places(rng, 120) + [(7.0, 7.0)] * 30
    got = {r.id: r.kth_distance for r in geo.knn_distance(frame(spark, pts, "id"), "id", 4).collect()}
    for i, p in enumerate(pts):
        assert got[i] == pytest.approx(sorted(math.dist(p, q) for j, q in enumerate(pts) if j != i)[3])
    assert {r.kth_distance for r in geo.knn_distance(frame(spark, pts[:4], "id"), "id", 4).collect()} == {None}


def test_plans_have_no_keyless_join(spark):
    """With broadcasts off, nothing but the tree's root, one row, is joined without keys."""
    points = frame(spark, [(k, 2 * k % 17) for k in range(300)], "p")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stations = points.filter("p % 10 = 0").select(F.col("p").cast("string").alias("station"), (F.col("y") / 10).alias("slat"), (F.col("x") / 10).alias("slon"))
        grid = points.select("p", (F.col("y") / 10).alias("lat"), (F.col("x") / 10).alias("lon"))
        for out in (pairing.nearest_station(grid, stations, "p"), pairing.nearest_cell(stations, grid, "p", [])):
            assert out.count() and "Cartesian" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_points_of_one_file_are_dealt(spark, monkeypatch):
    files, plain = [], neighbours.stored

    def seen(df, name):
        out = plain(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(neighbours, "stored", seen)
    rng = random.Random(8)
    points, targets = places(rng, 200), places(rng, 30)
    out = neighbours.nearest(frame(spark, points, "p").coalesce(1), frame(spark, targets, "t"), "p", "t").collect()
    assert {r.p: r.t for r in out} == {i: min(range(30), key=lambda j: math.dist(p, targets[j])) for i, p in enumerate(points)}
    assert dict(files)["points"] > 1
