"""Operators on tiny frames with results worked out by hand or by brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolattice.functions import scalars as S
from aerolattice.functions import thermal as T
from aerolattice.operators import aggregates as A
from aerolattice.operators import calibration as C
from aerolattice.operators import geo as G
from aerolattice.operators import metrics as M
from aerolattice.operators import pairing as J
from aerolattice.operators import ranking as R
from aerolattice.operators import tables as TB
from aerolattice.operators import windows as W


def one(spark, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first()


def test_missing_values_have_no_class(spark):
    r = one(spark, a=T.wbgt_class(F.lit(None).cast("double")), b=T.wbgt_class(F.lit(float("nan"))), c=T.wbgt_class(F.lit(31.0)), d=T.utci_class(F.lit(46.0)))
    assert (r.a, r.b, r.c, r.d) == (None, None, "moderate", "extreme heat stress")


def test_microclimate_invariants(spark):
    def cell(gvi, svf, wind, density=0.4):
        args = (30.0, wind, 800.0, gvi, 200.0, density, 0.2, svf, 0.3)
        parts = T.local_microclimate(*map(F.lit, args))
        return one(spark, **parts)

    assert cell(60.0, 0.5, 2.0).gvi_norm == 1.0 and cell(30.0, 0.5, 2.0).gvi_norm == 0.5
    assert cell(10.0, 0.98, 0.2, 0.0).wind_local_ms <= 0.2  # capped at the background
    assert cell(10.0, 0.3, 2.0).wall_gain_c > 0


def test_scalars(spark):
    r = one(spark, num=S.safe_double(F.lit("1,234.5 m")), none=S.safe_double(F.lit("EVA")), path=S.station_from_path(F.lit("x/S104_a/S128.csv")), sid=S.norm_station_id(F.lit(" nan ")), hour=S.hour_from_name(F.lit("tmrt_1300D.tif")), bad=S.hour_from_name(F.lit("a_h31")), knots=S.unit_to_ms(F.lit(10.0), F.lit("knots")), zero=S.coalesce_non_empty(F.lit(""), F.lit("0")))
    assert (r.num, r.none, r.path, r.sid, r.hour, r.bad, r.zero) == (1234.5, None, "S128", None, 13, None, "0")
    assert r.knots == pytest.approx(5.14444)
    assert one(spark, a=S.round_half_even(F.lit(450), 900), b=S.round_half_even(F.lit(1350), 900)).asDict() == {"a": 0, "b": 1800}


def test_local_time(spark):
    r = one(spark, z=S.to_local_epoch(F.lit("2026-05-07T05:00:00Z")), naive=S.to_local_epoch(F.lit("2026-05-07T13:00:00")), plus=S.to_local_epoch(F.lit("2026-05-07T13:00:00+08:00")), bad=S.to_local_epoch(F.lit("soon")))
    assert r.z == r.naive == r.plus and r.bad is None


def test_rings(spark):
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))))
    r = one(spark, area=S.ring_area(square), inside=S.in_ring(F.lit(1.0), F.lit(1.0), square), outside=S.in_ring(F.lit(9.0), F.lit(1.0), square), near=S.segment_distance(F.lit(7.0), F.lit(7.0), square), zero=S.segment_distance(F.lit(1.0), F.lit(1.0), square))
    assert (r.area, r.inside, r.outside, r.near, r.zero) == (12.0, True, False, 5.0, 0.0)


def test_pct_rank_matches_pandas(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.p for r in W.pct_rank(df, "v", "p").orderBy("i").collect()]
    assert got == pytest.approx(pd.Series(values).rank(pct=True, method="average").fillna(0).tolist())


def test_row_rank_over_ranges(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(500)]
    got = {r.i: r.rank for r in W.row_rank(spark.createDataFrame(rows, "i int, v int"), [F.desc("v"), F.asc("i")]).collect()}
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_cumsum_and_rolling_match_pandas(spark):
    v = [1.0, None, 3.0, 4.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "s string, t int, v double")
    s = pd.Series(v)
    out = W.rolling_mean(W.day_cumsum(df, "v", ["s"], "t"), ["v"], 3, ["s"], "t").orderBy("t").toPandas()
    assert out.v_cumsum.tolist() == pytest.approx(s.cumsum().tolist(), nan_ok=True)
    assert out.v_mean3.tolist() == pytest.approx(s.rolling(3, min_periods=1).mean().tolist())


def test_asof_tie_takes_the_earlier(spark):
    left = spark.createDataFrame([("a", 100), ("a", 5000), ("b", 7)], "s string, t long")
    right = spark.createDataFrame([("a", 90, 1.0), ("a", 110, 2.0)], "s string, t long, v double")
    got = {(r.s, r.t): (r.match_time, r.v) for r in J.asof_nearest(left, right, "s", "t", ["v"], 60).collect()}
    assert got == {("a", 100): (90, 1.0), ("a", 5000): (None, None), ("b", 7): (None, None)}


def test_pairs_prefer_used_then_own_place(spark):
    obs = spark.createDataFrame([("S1", 7200, 30.0)], "station string, t long, y double")
    snaps = spark.createDataFrame([("S1", 7200, 7200 - 400 * 3600, 1.0), ("AOI", 7200, 0, 2.0)], "location string, valid long, issue long, temp double")
    r = J.pick_best_pair(J.match_mode(J.pair_candidates(obs, snaps))).first()
    assert (r.source, r.temp, r.mode) == ("area", 2.0, "operational_forecast")


def test_linear_fixture(spark):
    df = spark.createDataFrame([(29.5 + k, 30.0 + k) for k in range(5)], "p double, y double")
    r = C.fit_linear(df, "p", "y").first()
    assert r.slope == pytest.approx(1) and r.intercept == pytest.approx(0.5) and r.rmse_after == pytest.approx(0, abs=1e-9)
    assert C.fit_linear(df.limit(2), "p", "y").first().slope is None


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(3)
    n = 60
    frame = pd.DataFrame({"i": range(n), "fold": [f"f{k % 3}" for k in range(n)], "a": rng.normal(size=n), "b": rng.normal(size=n)})
    frame["y"] = 2 * frame.a - frame.b + rng.normal(size=n)
    frame.loc[::7, "b"] = np.nan
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame.itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, "i long, fold string, a double, b double, y double").withColumn("void", F.lit(None).cast("double"))
    got = {r.i: (r.ridge, r.ridge_features) for r in C.oof_ridge(df, ["a", "b", "void"], "y").collect()}
    for fold in ("f0", "f1", "f2"):
        train, test = frame[frame.fold != fold], frame[frame.fold == fold]
        med = train[["a", "b"]].median()
        x, z = train[["a", "b"]].fillna(med), test[["a", "b"]].fillna(med)
        mu, sd = x.mean(), x.std(ddof=0)
        xs = ((x - mu) / sd).to_numpy()
        w = np.linalg.solve(xs.T @ xs + np.eye(2), xs.T @ (train.y - train.y.mean()))
        want = train.y.mean() + ((z - mu) / sd).to_numpy() @ w
        for i, p in zip(test.i, want):
            assert got[i][0] == pytest.approx(p) and got[i][1] == "a,b"


def test_bootstrap_bounds(spark):
    r = C.bootstrap_ci(spark.createDataFrame([(float(v),) for v in (-2, -1, -3, -1)], "v double"), "v", 500).first()
    assert r.low >= -3 and r.high <= -1 and r.mean == -1.75 and r.p == 0.0 and r.n == 4


def test_fisher_matches_enumeration(spark):
    table = [(True, True)] * 9 + [(True, False)] * 3 + [(False, True)] * 1 + [(False, False)] * 7
    r = R.fisher_exact(spark.createDataFrame(table, "a boolean, b boolean"), F.col("a"), F.col("b")).first()
    n, row, col = 20, 12, 10
    p = {k: math.comb(col, k) * math.comb(n - col, row - k) / math.comb(n, row) for k in range(2, 11)}
    assert r.p_value == pytest.approx(sum(v for v in p.values() if v <= p[9] + 1e-12)) and r.odds_ratio == pytest.approx(21.0)


def test_importance_deals_one_feature_anew(spark):
    rows = [(i, float(i % 17), float(i % 5), 2.0 * (i % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, a double, b double, y double")
    got = {r.feature: r.rise for r in C.permutation_importance(df, F.col("a") * 2, ["a", "b"], "y", 3).collect()}
    spread = 2 * np.std([r[1] for r in rows])
    assert got["b"] == pytest.approx(0, abs=1e-9) and got["a"] == pytest.approx(math.sqrt(2) * spread, rel=0.15)
    model = C.forest_pipeline(["a"], "y", ["k"], 10).fit(df.withColumn("k", (F.col("i") % 2).cast("string")))
    fitted = {r.feature: r.rise for r in C.permutation_importance(df.withColumn("k", (F.col("i") % 2).cast("string")), model.transform, ["a", "k"], "y", 1).collect()}
    assert fitted["a"] > 5 * abs(fitted["k"])


def test_forest_beats_the_mean_on_held_out_folds(spark):
    rng = random.Random(2)
    rows = [(f"f{i % 3}", x := rng.uniform(0, 10), k := rng.choice("uvw"), (x if k != "w" else 5.0) + rng.gauss(0, 0.3)) for i in range(300)]
    out = C.random_forest_cv(spark.createDataFrame(rows, "fold string, a double, kind string, y double"), ["a"], "y", 20, categorical=["kind"]).collect()
    assert len(out) == 3 and all(r.r2 > 0.8 and r.n == 100 for r in out)


def test_forest_rows_of_one_file_are_dealt(spark, monkeypatch):
    from aerolattice import session

    stored, plain = [], session.stored
    monkeypatch.setattr(session, "stored", lambda df, name: stored.append((name, plain(df, name))) or stored[-1][1])
    rows = [(f"f{i % 2}", float(i % 10), "u", float(i % 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "fold string, a double, kind string, y double").coalesce(1)
    assert {r.n for r in C.random_forest_cv(df, ["a"], "y", 3, categorical=["kind"]).collect()} == {100}
    files = dict(stored)["forest-rows"].inputFiles()
    assert len(files) > 1 and dict(stored)["forest-rows"].count() == 200


def test_scan_without_rows_at_a_threshold(spark):
    df = spark.createDataFrame([(30.0, 28.0), (32.0, 33.0)], "y double, p double")
    rows = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in M.threshold_scan(df, "y", "p", 31, 2700, 3400, 100).collect()}
    assert rows[2700] == (1, 1, 0, 0) and rows[2900] == (1, 0, 0, 1) and rows[3400] == (0, 0, 1, 1)


def test_dedup_footprints_is_sequential(spark):
    rng = random.Random(5)
    boxes = [(i, rng.randint(1, 3), (x := rng.uniform(0, 150)), x + rng.uniform(10, 30), (y := rng.uniform(0, 150)), y + rng.uniform(10, 30)) for i in range(60)]
    df = spark.createDataFrame(boxes, "id long, priority int, x_min double, x_max double, y_min double, y_max double")
    got = {r.id: r.status for r in G.dedup_footprints(df, "id", "priority", 50.0, 0.2).collect()}
    area = lambda b: (b[3] - b[2]) * (b[5] - b[4])

    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[4], b[4])
        return w * h / (area(a) + area(b) - w * h) if w > 0 and h > 0 else 0

    kept, want = [], {}
    for b in sorted(boxes, key=lambda b: (b[1], -area(b), b[0])):
        want[b[0]] = "duplicate" if any(iou(b, k) >= 0.2 for k in kept) else "new"
        kept += [b] if want[b[0]] == "new" else []
    assert got == want and "duplicate" in want.values()


def test_footprints_by_all_rules_are_sequential(spark):
    rng = random.Random(6)
    boxes = [(i, rng.randint(1, 3), (x := rng.uniform(0, 160)), x + rng.uniform(4, 40), (y := rng.uniform(0, 160)), y + rng.uniform(4, 40), rng.choice([None, 5.0 + i])) for i in range(120)]
    df = spark.createDataFrame(boxes, "id long, priority int, x_min double, x_max double, y_min double, y_max double, height double").withColumn("src", F.concat(F.lit("s"), F.col("priority").cast("string")))
    state = G.resolve_footprints(df, "id", "priority", 50.0, F.when(F.col("priority") == 3, 60.0).otherwise(30.0))
    got = {r.id: (r.status, r.match) for r in state.collect()}
    area = lambda b: (b[3] - b[2]) * (b[5] - b[4])
    kept, want, merged = [], {}, {}
    for b in sorted(boxes, key=lambda b: (b[1], -area(b), b[0])):
        if area(b) < (60 if b[1] == 3 else 30):
            want[b[0]] = ("rejected_tiny", None)
            continue
        best, merit = None, (0.0, 0.0, 0.0, -math.inf)
        for k in kept:
            w, h = min(b[3], k[3]) - max(b[2], k[2]), min(b[5], k[5]) - max(b[4], k[4])
            if w > 0 and h > 0:
                i = w * h
                m = (i / (area(b) + area(k) - i), i / area(b), i / area(k), -math.hypot((b[2] + b[3] - k[2] - k[3]) / 2, (b[4] + b[5] - k[4] - k[5]) / 2))
                best, merit = (k, m) if m > merit else (best, merit)
        ratio = area(b) / area(best) if best else 0
        same = best and (merit[0] >= 0.35 or (merit[1] >= 0.6 and merit[2] >= 0.3) or (-merit[3] <= 8 and 0.5 <= ratio <= 2))
        want[b[0]] = ("merged_duplicate", best[0]) if same else ("accepted_new", None) if not best or merit[1] < 0.2 else ("conflict_review", best[0])
        if want[b[0]][0] == "accepted_new":
            kept.append(b)
            merged[b[0]] = [b]
        elif same:
            merged[best[0]].append(b)
    assert got == want and {s for s, _ in want.values()} == {"rejected_tiny", "merged_duplicate", "accepted_new", "conflict_review"}
    rows = {r.id: (r.candidates, r.sources, r.height) for r in G.merge_provenance(df, state, "id", "priority", "src", ["height"]).collect()}
    order = lambda g: [g[0], *sorted(g[1:], key=lambda b: (b[1], b[0]))]
    assert rows == {i: (len(g), ";".join(f"s{b[1]}" for b in order(g)), next((b[6] for b in order(g) if b[6] is not None), None)) for i, g in merged.items()}


def test_dbscan_brute_force(spark):
    rng = random.Random(9)
    pts = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(150)]
    got = {r.id: (r.cluster, r.core) for r in G.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), "id", 8.0, 5).collect()}
    near = {a[0]: [b[0] for b in pts if math.hypot(a[1] - b[1], a[2] - b[2]) <= 8.0] for a in pts}
    core = {i for i, n in near.items() if len(n) >= 5}
    label = {i: i for i in core}
    for _ in pts:
        label = {i: min([label[j] for j in near[i] if j in core]) for i in core}
    want = {i: (label[i], True) if i in core else (min([label[j] for j in near[i] if j in core], default=None), False) for i, _, _ in pts}
    assert got == want


def test_demographics_carries_parents(spark):
    rows = spark.createDataFrame([("k", 1, "North - Total", 100.0, 10.0, 20.0), ("k", 2, "Lorong", 40.0, 4.0, 10.0)], "g string, n int, label string, total double, y double, o double")
    got = A.demographics(rows, "label", "n", ["g"], "total", ["y"], ["o"]).orderBy("n").collect()
    assert [(r.parent, r.is_parent, r.young_share, r.old_share) for r in got] == [("North", True, 0.1, 0.2), ("North", False, 0.1, 0.25)]


def test_tables(spark):
    df = spark.createDataFrame([(1, 2.0)], "Station_ID int, svf double")
    assert TB.first_present(df, ["id", "station id"]) == "Station_ID" and TB.first_present(df, ["nope"]) is None
    assert TB.ensure_columns(df, {"zone": F.lit("unknown"), "svf": F.lit(0.0)}).columns == ["zone", "svf", "Station_ID"]
    assert "SVF2" in TB.alias_columns(df, {"svf": "SVF2"}).columns
    assert TB.dedupe_column_names(df.select("svf", "svf")).columns == ["svf", "svf__dup1"]
    buildings = spark.createDataFrame([("a", 5.0), ("b", 6.0), ("c", 7.0)], "id string, height_m double")
    changes = spark.createDataFrame([("a", "height_adjust", 9.0), ("b", "remove", None), ("x", "remove", None), ("c", "paint", None)], "target_id string, decision string, height double")
    out, log = TB.apply_corrections(buildings, changes, "id")
    assert {r.id: r.height_m for r in out.collect()} == {"a": 9.0, "c": 7.0}
    assert {r.target_id: r.status for r in log.collect()} == {"a": "applied", "b": "applied", "x": "not_found", "c": "unsupported"}


def test_grid_and_tiles(spark):
    grid = G.make_grid(spark, (0, 0, 250, 150), 100.0, origin=(1.33, 103.85))
    assert [r.cell for r in grid.orderBy("cell").collect()] == ["C000001", "C000002", "C000003", "C000004", "C000005", "C000006"]
    assert grid.filter("lat <= 1.33 or lon <= 103.85").count() == 0


def test_greedy_respects_distance(spark):
    rows = [(i, "k", float(i % 10) * 10, float(i // 10) * 10, float(-i)) for i in range(40)]
    got = R.greedy_diverse_topk(spark.createDataFrame(rows, "cell long, kind string, x double, y double, s double"), "kind", "s", "cell", 4, 25.0).collect()
    assert len(got) == 4 and all(math.hypot(a.x - b.x, a.y - b.y) >= 25 for a in got for b in got if a.cell != b.cell) and min(r.cell for r in got) == 0


def test_greedy_looks_beyond_a_cluster(spark):
    rows = [(i, "k", float(i % 20), float(i // 20), 1000.0 - i, 0.0) for i in range(300)] + [(1000 + i, "k", 1000.0 * (i + 1), 0.0, -float(i), 0.01 * i) for i in range(4)]
    rows += [(2000, "l", 5.0, 5.0, 9.0, 0.0), (2001, "l", 0.0, 900.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "cell long, kind string, x double, y double, s double, o double")
    pick = lambda *a, **b: [r.cell for r in R.greedy_diverse_topk(df, "kind", "s", "cell", *a, **b).collect()]
    assert pick(4, 500.0) == [0, 1000, 1001, 1002, 2001]
    assert pick(4, 0.0, side=100.0) == [0, *pick(4, 0.0, side=100.0)[1:]] and len(pick(4, 0.0, side=100.0)) > 4
    assert pick(4, 500.0, limits={"o": 0.005}) == [0, 1000, 1001, 1002, 2001, 2000]  # 1001 and 1002 in relaxed rounds, 2000 in the last


def test_ring_overlap_of_concave_rings():
    from aerolattice.operators.rings import clipped, overlap, signed_area

    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    square = [(0.5, 0.5), (3, 0.5), (3, 3), (0.5, 3)]
    want = 2.5 * 0.5 + 0.5 * 2.0  # the foot and the leg inside the square
    assert overlap(ell, square) == pytest.approx(want) == overlap(square[::-1], ell)
    assert abs(signed_area(clipped(ell, square))) == pytest.approx(want)
    assert overlap(ell, [(9, 9), (10, 9), (10, 10)]) == 0.0


def test_nearest_polygon_and_first_containing(spark):
    from aerolattice.operators import rings as RG

    ring = F.array(*(F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y")) for dx, dy in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))))
    rings = spark.createDataFrame([("a", 0.0, 0.0), ("b", 5.0, 5.0)], "name string, x0 double, y0 double").withColumn("ring", ring)
    points = spark.createDataFrame([(1, 7.0, 7.0), (2, 18.0, 9.0), (3, 500.0, 0.0)], "p long, px double, py double")
    assert {r.p: (r.distance, r.name) for r in RG.nearest_polygon(points, rings, "p", "name", 20.0).collect()} == {1: (0.0, "a"), 2: (3.0, "b"), 3: (9999.0, None)}
    assert {r.p: r.name for r in RG.first_containing(points, rings, "p", "name", 20.0).collect()} == {1: "a", 2: None, 3: None}


def test_dbscan_of_a_dense_square(spark):
    """100,000 points in two squares that touch, near pairs of which no list could hold, and some points around."""
    rows = spark.range(100_000).select("id", (F.rand(1) * 0.5).alias("x"), F.when(F.col("id") % 2 == 0, F.rand(2) * 0.4).otherwise(0.8 + F.rand(3) * 0.4).alias("y"))
    more = spark.createDataFrame([(200_000, 0.25, 2.1), (200_001, 9.0, 9.0), (200_002, 9.1, 9.0), (200_003, 9.2, 9.0), (200_004, 9.9, 9.0), (200_005, 20.0, 0.0), (200_006, None, 0.0)], "id long, x double, y double")
    got = {r.id: (r.cluster, r.core) for r in G.dbscan(rows.unionByName(more), "id", 1.0, 4).filter("id < 4 or id >= 200000").collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (0, True), 200_000: (0, True), 200_001: (200_001, True), 200_002: (200_001, True), 200_003: (200_001, True), 200_004: (200_001, True), 200_005: (None, False), 200_006: (None, False)}


@pytest.mark.parametrize("seed", range(4))
def test_dbscan_of_clumps(spark, seed):
    rng = random.Random(seed)
    pts = [(i, round(rng.choice([0, 0, 3, 7, 7.5]) + rng.gauss(0, 0.6), 2), round(rng.choice([0, 4]) + rng.gauss(0, 0.6), 2)) for i in range(160)]
    eps, least = (0.3, 0.5, 0.8, 1.1)[seed], (3, 4, 5, 9)[seed]
    near = {i: [j for j, u, v in pts if math.hypot(x - u, y - v) <= eps] for i, x, y in pts}
    core = {i for i in near if len(near[i]) >= least}
    label = {i: i for i in core}
    for _ in pts:
        label = {i: min(label[j] for j in near[i] if j in core) for i in core}
    want = {i: (label[i], True) if i in core else (min((label[j] for j in near[i] if j in core), default=None), False) for i, *_ in pts}
    df = spark.createDataFrame(pts, "id long, x double, y double")
    assert {r.id: (r.cluster, r.core) for r in G.dbscan(df, "id", eps, least).collect()} == want


def test_range_quantiles(spark):
    from aerolattice.operators import windows as W

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 9)), rng.gauss(0, 3)])) for _ in range(400)] + [("empty", None)]
    got = {r.g: r._q for r in W.range_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.5, 0.0, 0.95, 1.0]).collect()}
    for g in ("a", "b", None):
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx(np.quantile(own, [0.5, 0.0, 0.95, 1.0]).tolist())
    assert "empty" not in got


def test_left_out_medians(spark):
    from aerolattice.operators import calibration as C

    rng = random.Random(8)
    rows = [(rng.choice("aaabcd"), rng.choice([None, float(rng.randint(0, 5))]), rng.gauss(0, 1), 1.0 if k == 3 else None) for k in range(203)] + [("only", 7.0, None, None)]
    rows[3] = ("a", *rows[3][1:])
    df = spark.createDataFrame(rows, "fold string, u double, v double, w double")
    got = {r.fold: (r._med_u, r._med_v, r._med_w) for r in C.left_out_medians(df, "fold", ["u", "v", "w"]).collect()}
    for fold in {r[0] for r in rows}:
        for k in range(3):
            rest = [r[1 + k] for r in rows if r[0] != fold and r[1 + k] is not None]
            assert got[fold][k] == (pytest.approx(np.median(rest)) if rest else None)


def test_lab_green_of_known_colours(spark):
    """a* of CIE Lab under D65: pure green -86, pure red 80, grey 0."""
    rows = spark.createDataFrame([(0, 255, 0), (255, 0, 0), (128, 128, 128), (0, 0, 0), (34, 139, 34)], "r int, g int, b int")
    assert [r.v for r in rows.select(S.lab_green(F.col("r"), F.col("g"), F.col("b")).alias("v")).collect()] == [86, -80, 0, 0, 50]


def test_masks_follow_their_table(spark):
    table = {"low": {"all": {"x": (0, 5)}}, "high": {"any": [{"x": (8, math.inf)}, {"y": (1, 1), "x": (6, 9)}]}, "rest": {"out": ["low", "high"]}, "both": {"in": ["low"], "all": {"y": (1, 2)}}}
    rows = spark.createDataFrame([(x, y) for x in range(10) for y in (0, 1)], "x int, y int")
    got = rows.select("x", "y", *(m.alias(n) for n, m in S.bounded_masks({"x": F.col("x"), "y": F.col("y")}, table).items())).collect()
    for r in got:
        low, high = r.x <= 5, r.x >= 8 or (r.y == 1 and 6 <= r.x <= 9)
        assert (r.low, r.high, r.rest, r.both) == (low, high, not low and not high, low and r.y == 1)
