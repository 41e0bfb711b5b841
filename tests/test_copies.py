"""Tables that hold many rows of few distinct places: work grows with rows and distinct places, not with their pairs."""

import random

import pytest
from pyspark.sql import functions as F

from aerolattice.functions import scalars as S
from aerolattice.operators import geo as G
from aerolattice.operators import pairing as J

BOXES = "id long, priority int, x_min double, x_max double, y_min double, y_max double"


def some_boxes(seed, distinct, rows):
    rng = random.Random(seed)
    places = [(x, x + rng.choice((8, 10, 12)), y, y + rng.choice((8, 10))) for x, y in ((rng.randint(0, 30), rng.randint(0, 30)) for _ in range(distinct))]
    return [(i, rng.randint(1, 3), *(float(v) for v in rng.choice(places))) for i in range(rows)]


def overlap(a, b):
    w, h = min(a[3], b[3]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[4], b[4])
    return w * h if w > 0 and h > 0 else 0.0


def area(a):
    return (a[3] - a[2]) * (a[5] - a[4])


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], -area(r), r[0]))


@pytest.fixture()
def writes(monkeypatch):
    """Rows of each table that is stored."""
    from aerolattice import session

    seen, plain = [], session.stored

    def counted(df, name):
        out = plain(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(session, "stored", counted)
    return seen


def test_station_numbers_of_any_length(spark):
    paths = spark.createDataFrame([("/a/S900099/x.csv",), ("/a/S104_b/S128.csv",), ("/a/S1/x.csv",)], "p string")
    assert [r[0] for r in paths.select(S.station_from_path(F.col("p"))).collect()] == ["S900099", "S128", None]


def test_snapshot_neighbours_hold_the_best_pair(spark):
    rng = random.Random(4)
    hours = [k * 3600 for k in range(3)]
    obs = [(rng.choice("AB"), rng.choice(hours) + rng.randint(0, 3599)) for _ in range(60)] + [("A", None), ("C", 5 * 3600)]
    o = spark.createDataFrame(sorted(set(obs), key=str), "station string, t long")
    rows = {(rng.choice(["A", "B", "AOI"]), rng.choice(hours), rng.choice(hours) + rng.choice((rng.randint(-4000, 4000), rng.randint(-400_000, 400_000)))) for _ in range(300)}
    s = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(sorted(rows))], "location string, valid long, issue long, temp double")
    near = J.pair_neighbours(o, s)
    assert near.count() <= 4 * o.count() < J.pair_candidates(o, s).count() / 4
    best = lambda c: sorted((tuple(r) for r in J.pick_best_pair(J.match_mode(c)).select("station", "t", "source", "used", "operational", "mode", "issue", "temp").collect()), key=str)
    assert best(near) == best(J.pair_candidates(o, s))


def test_access_joins_places_not_nodes(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "cell long, x double, y double")
    nodes = spark.range(20_000).select((F.col("id") % 2 * 300.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit("a").alias("type"), F.lit(0.5).alias("weight"))
    out = J.decay_access(cells, nodes, 300.0, 400.0)
    import math

    got = {r.cell: (r.access, r.nodes) for r in out.collect()}
    assert got[1] == (pytest.approx(5000 * (1 + math.exp(-1))), 20_000) and got[2] == (pytest.approx(5000 * math.exp(-200 / 300)), 10_000)
    assert "Aggregate [" in out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]  # summed below the copies


def test_local_regression_joins_places(spark, writes):
    rng = random.Random(1)
    rows = [(i, 100.0 * rng.randint(0, 3), 100.0 * rng.randint(0, 3), float(rng.randint(1, 9)), rng.random()) for i in range(200)] + [(200, None, 1.0, 2.0, 3.0)]
    got = {r.id: r for r in G.gwr(spark.createDataFrame(rows, "id long, x double, y double, u double, v double"), "id", "u", "v", 150.0).collect()}
    assert ("places", 16) in writes and len(got) == 201 and got[200].n == 1 and got[200].slope is None
    for i, x, y, _, _ in rows[:8]:
        near = [((1 - ((x - a) ** 2 + (y - b) ** 2) / 150.0**2) ** 2, u, v) for _, a, b, u, v in rows[:200] if (x - a) ** 2 + (y - b) ** 2 <= 150.0**2]
        sw, mu, mv = sum(w for w, _, _ in near), 0.0, 0.0
        mu, mv = sum(w * u for w, u, _ in near) / sw, sum(w * v for w, _, v in near) / sw
        slope = sum(w * (u - mu) * (v - mv) for w, u, v in near) / sum(w * (u - mu) ** 2 for w, u, _ in near)
        assert got[i].n == len(near) and got[i].slope == pytest.approx(slope) and got[i].intercept == pytest.approx(mv - slope * mu)


def test_equal_boxes_are_compared_once(spark, writes):
    rows = some_boxes(3, 12, 150) + [(500, 1, 5.0, 5.0, 5.0, 9.0), (501, 1, 5.0, 5.0, 5.0, 9.0), (502, 1, None, 5.0, 5.0, 9.0)]
    got = sorted((r.a, r.b, r.intersection, round(r.a_share, 9), round(r.b_share, 9)) for r in G.iou_pairs(spark.createDataFrame(rows, BOXES), "id", 10.0).collect())
    rows = rows[:150]
    want = sorted((a[0], b[0], overlap(a, b), round(overlap(a, b) / area(a), 9), round(overlap(a, b) / area(b), 9)) for a in rows for b in rows if a[0] < b[0] and overlap(a, b))
    assert got == want and max(n for _, n in writes) <= 14


def test_copies_of_footprints_need_no_rounds(spark, writes):
    for seed in range(3):
        rows = some_boxes(seed, 14, 200) + [(500, 1, 5.0, 5.0, 5.0, 9.0), (501, 1, 5.0, 5.0, 5.0, 9.0)]
        new, want = [], {}
        for r in in_order(rows):
            hits = [(overlap(r, k) / (area(r) + area(k) - overlap(r, k)), -k[0]) for k in new if overlap(r, k)]
            hits = [h for h in hits if h[0] >= 0.25]
            want[r[0]] = ("duplicate", -max(hits)[1]) if hits else ("new", None)
            new += [] if hits else [r]
        writes.clear()
        got = {r.id: (r.status, r.keeper) for r in G.dedup_footprints(spark.createDataFrame(rows, BOXES), "id", "priority", 10.0, 0.25).collect()}
        assert got == want
        assert sum(n == "footprints" for n, _ in writes) <= 14 and all(n <= 14 for name, n in writes if name == "footprints")


def test_cover_takes_distinct_boxes(spark):
    one = [(0, 1, 0.0, 10.0, 0.0, 10.0)]
    boxes = spark.range(3000).select("id", F.lit(2).alias("priority"), *(F.lit(v).alias(c) for c, v in zip(G.BOX, (0.0, 10.0, 0.0, 10.0))))
    ref = spark.createDataFrame([(1, 1, 5.0, 20.0, 0.0, 10.0), (2, 1, 5.0, 20.0, 0.0, 10.0), (3, 1, 4.0, 6.0, 0.0, 10.0)], BOXES)
    got = G.non_covered(boxes.unionByName(spark.createDataFrame(one, BOXES)), ref, "id", 4.0, 2.0)
    assert {r.covered_share for r in got.collect()} == {0.6} and got.count() == 3001
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan and "Aggregate [x_min" in plan.split("collect_set")[1]  # distinct boxes below the pieces


def of_sides():
    corners = (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))
    return F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners))


def test_equal_shapes_are_compared_once(spark, monkeypatch):
    from aerolattice.operators import rings as RG

    seen, plain = [], RG.stored
    monkeypatch.setattr(RG, "stored", lambda df, name: seen.append((name, (out := plain(df, name)).count())) or out)
    rows = some_boxes(5, 8, 90)
    df = spark.createDataFrame(rows, BOXES).withColumn("ring", of_sides())
    got = sorted((r.a, r.b, round(r.intersection, 6)) for r in RG.ring_iou_pairs(df, "id", 10.0).collect())
    assert got == sorted((a[0], b[0], overlap(a, b)) for a in rows for b in rows if a[0] < b[0] and overlap(a, b))
    assert dict(seen)["shape-classes"] <= 8 and dict(seen)["shape-pairs"] <= 36
    share = {r.id: r.share for r in RG.covered_share(df, df.filter("id % 2 = 0"), "id", 10.0).collect()}
    assert set(share) == set(range(90)) and share[0] == pytest.approx(1.0) and [n for name, n in seen if name == "shape-classes"] == [8, 8]


def test_far_points_find_their_nearest_shape(spark):
    from aerolattice.operators import rings as RG

    rng = random.Random(6)
    rows = some_boxes(7, 30, 60)
    df = spark.createDataFrame(rows, BOXES).withColumn("ring", of_sides())
    points = [(i, *(rng.uniform(-50, 80) if i % 2 else rng.uniform(-1e5, 1e5) for _ in "xy")) for i in range(60)]
    got = {r.p: (r.distance, r.id) for r in RG.nearest_polygon_anywhere(spark.createDataFrame(points, "p long, px double, py double"), df, "p", "id", 5.0).collect()}
    gap = lambda v, low, high: max(low - v, v - high, 0.0)
    for p, x, y in points:
        d = {r[0]: (gap(x, r[2], r[3]) ** 2 + gap(y, r[4], r[5]) ** 2) ** 0.5 for r in rows}
        assert got[p][0] == pytest.approx(min(d.values())) and d[got[p][1]] == pytest.approx(min(d.values()))


def test_copies_of_footprints_are_resolved_by_class(spark, writes):
    d = G.DUPLICATE
    for seed in range(3):
        rows = some_boxes(10 + seed, 14, 160) + [(500, 1, 5.0, 5.0, 5.0, 9.0), (501, 1, 5.0, 5.0, 5.0, 9.0)]
        new, want = [], {}
        for r in in_order(rows):
            best = None
            for k in new:
                if i := overlap(r, k):
                    iou, own, other = i / (area(r) + area(k) - i), i / area(r), i / area(k)
                    apart = ((r[2] + r[3] - k[2] - k[3]) ** 2 + (r[4] + r[5] - k[4] - k[5]) ** 2) ** 0.5 / 2
                    same = iou >= d["iou"] or (own >= d["own"] and other >= d["other"]) or (apart <= d["distance"] and d["ratio"][0] <= area(k) / area(r) <= d["ratio"][1])
                    verdict = "merged_duplicate" if same else "accepted_new" if own < d["new_below"] else "conflict_review"
                    merit = (iou, own, other, -apart, -k[1], area(k), -k[0])
                    best = max(best, (merit, verdict, k[0])) if best else (merit, verdict, k[0])
            status = best[1] if best else "accepted_new"
            want[r[0]] = (status, None if status == "accepted_new" else best[2])
            new += [r] if status == "accepted_new" else []
        writes.clear()
        got = {r.id: (r.status, r.match) for r in G.resolve_footprints(spark.createDataFrame(rows, BOXES), "id", "priority", 10.0).collect()}
        assert got == want
        assert sum(n == "footprints" for n, _ in writes) <= 3 * 14


def resolved(rows):
    """Status and match of boxes, one after another."""
    d, new, want = G.DUPLICATE, [], {}
    for r in in_order(rows):
        best = None
        for k in new:
            if i := overlap(r, k):
                iou, own, other = i / (area(r) + area(k) - i), i / area(r), i / area(k)
                apart = ((r[2] + r[3] - k[2] - k[3]) ** 2 + (r[4] + r[5] - k[4] - k[5]) ** 2) ** 0.5 / 2
                same = iou >= d["iou"] or (own >= d["own"] and other >= d["other"]) or (apart <= d["distance"] and d["ratio"][0] <= area(k) / area(r) <= d["ratio"][1])
                verdict = "merged_duplicate" if same else "accepted_new" if own < d["new_below"] else "conflict_review"
                merit = (iou, own, other, -apart, -k[1], area(k), -k[0])
                best = max(best, (merit, verdict, k[0])) if best else (merit, verdict, k[0])
        status = best[1] if best else "accepted_new"
        want[r[0]] = (status, None if status == "accepted_new" else best[2])
        new += [r] if status == "accepted_new" else []
    return want


def test_chains_of_footprints_need_no_rounds(spark, writes):
    rows = [(i, 1, 9.0 * i, 9.0 * i + 10.0, 0.0, 10.0) for i in range(40)] + [(100 + i, 2, 9.0 * i + 3.0, 9.0 * i + 13.0, 2.0, 12.0) for i in range(40)]
    got = {r.id: (r.status, r.match) for r in G.resolve_footprints(spark.createDataFrame(rows, BOXES), "id", "priority", 10.0).collect()}
    assert got == resolved(rows) and len({s for s, _ in got.values()}) == 2
    assert sum(name == "footprints" for name, _ in writes) == 1  # not one for each of the 40 that wait for the one before


def test_tiles_of_footprints_agree_with_one_after_another(spark, writes, monkeypatch):
    rng, rounds = random.Random(5), []
    monkeypatch.setattr(G, "TILE", 40)
    for heads in (1, 3):
        monkeypatch.setattr(G, "HEADS", heads)
        places = [(x, x + rng.choice((4, 9, 10, 16, 30)), y, y + rng.choice((4, 9, 10, 16))) for x, y in ((rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(110))]
        rows = [(i, rng.randint(1, 3), *(float(v) for v in rng.choice(places))) for i in range(260)]
        writes.clear()
        got = {r.id: (r.status, r.match) for r in G.resolve_footprints(spark.createDataFrame(rows, BOXES), "id", "priority", 10.0).collect()}
        assert got == resolved(rows) and {s for s, _ in got.values()} == {"accepted_new", "merged_duplicate", "conflict_review"}
        rounds.append(sum(name == "footprints" for name, _ in writes))
    assert min(rounds) > 1  # several tiles, and what they left open
