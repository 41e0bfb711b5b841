"""Grids, squares, footprints, clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .neighbours import nearest

METRES_PER_DEGREE = 111_320.0
BOX = ("x_min", "x_max", "y_min", "y_max")


def make_grid(spark: SparkSession, box: tuple[float, float, float, float], size: float, prefix: str = "C", origin: tuple[float, float] | None = None) -> DataFrame:
    """Aligned squares whose centres lie in the box, numbered row by row from the south-west. With ``origin`` (lat, lon of
    x = y = 0) centres get an equirectangular lat and lon, good to 0.1 % within 50 km."""
    x0, y0, x1, y1 = box
    fit = lambda low, high: max(0, int((high - low - size / 2) // size) + 1)
    nx, ny = max(1, fit(x0, x1)), fit(y0, y1) * (fit(x0, x1) > 0)
    grid = spark.range(nx * ny).withColumn("col", F.pmod("id", F.lit(nx))).withColumn("row", F.floor(F.col("id") / nx))
    grid = grid.withColumn("x", x0 + F.col("col") * size).withColumn("y", y0 + F.col("row") * size)
    grid = grid.withColumn("cell", F.concat(F.lit(prefix), F.lpad((F.col("id") + 1).cast("string"), 6, "0")))
    if origin:
        lat0, lon0 = origin
        grid = grid.withColumn("lat", lat0 + (F.col("y") + size / 2) / METRES_PER_DEGREE)
        grid = grid.withColumn("lon", lon0 + (F.col("x") + size / 2) / (METRES_PER_DEGREE * F.cos(F.radians(F.lit(lat0)))))
    return grid.drop("id")


def tile_around(points: DataFrame, size: float, buffer: float = 0.0) -> DataFrame:
    half = size / 2 + buffer
    return points.withColumns({"x_min": F.col("x") - half, "x_max": F.col("x") + half, "y_min": F.col("y") - half, "y_max": F.col("y") + half})


def spatial_blocks(df: DataFrame, x: str, y: str, size: float, out: str = "block") -> DataFrame:
    """Blocks counted from the least coordinates (one broadcast row)."""
    low = df.agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"))
    name = F.concat_ws("_", F.floor((F.col(y) - F.col("_y0")) / size).cast("string"), F.floor((F.col(x) - F.col("_x0")) / size).cast("string"))
    return df.crossJoin(F.broadcast(low)).withColumn(out, name).drop("_x0", "_y0")


def _near(boxes: DataFrame, size: float) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / size)
    return boxes.withColumn("kx", F.explode(F.sequence(at("x_min"), at("x_max")))).withColumn("ky", F.explode(F.sequence(at("y_min"), at("y_max"))))


def curve_key(x: Column, y: Column, box: tuple[float, float, float, float], bits: int = 16) -> Column:
    """The place of a point along a curve that fills the box (x0, y0, x1, y1): the bits of its scaled x and y in turn, so that
    points near each other mostly have near keys. Points outside count as on the border."""
    x0, y0, x1, y1 = box
    top = (1 << bits) - 1
    scaled = lambda v, low, high: F.greatest(F.least(F.floor((v - low) / ((high - low) or 1.0) * (1 << bits)), F.lit(top)), F.lit(0)).cast("long")

    def apart(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return apart(scaled(x, x0, x1)).bitwiseOR(F.shiftleft(apart(scaled(y, y0, y1)), 1))


def write_clustered(boxes: DataFrame, path: str, files: int, rows: int = 20_000) -> None:
    """Writes boxes (``x_min..y_max``) as files of neighbours: ranges of the curve key of their middles, in its order, and row
    groups small enough that the least and largest values of each tell a reader of a window which to skip."""
    ends = boxes.agg(*(f(c) for c, f in (("x_min", F.min), ("y_min", F.min), ("x_max", F.max), ("y_max", F.max)))).first()  # four numbers
    key = curve_key((F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2, tuple(float(v or 0) for v in ends))
    keyed = boxes.withColumn("_curve", key).repartitionByRange(files, "_curve").sortWithinPartitions("_curve").drop("_curve")
    keyed.write.option("parquet.block.row.count.limit", rows).option("maxRecordsPerFile", rows).parquet(path)


def _box_classes(boxes: DataFrame, by: Sequence[str] = BOX) -> DataFrame:
    """The distinct boxes, numbered (``_class``): rows with equal sides are compared with others once."""
    from ..session import stored

    return stored(boxes.select(*by).distinct().withColumn("_class", F.monotonically_increasing_id()), "box-classes")


def _pairs_between(ones: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """Pairs of classes, one of each side (a, b), that overlap, with intersection, union, IoU, each one's share and area and
    the distance of centres. Boxes meet in the squares that both touch; a pair is kept in its first common square only."""
    cols = ["_class", *BOX]
    a = _near(ones.select(*cols), size).select("kx", "ky", *(F.col(c).alias(f"a_{c}") for c in cols))
    b = _near(others.select(*cols), size).select("kx", "ky", *(F.col(c).alias(f"b_{c}") for c in cols))
    left, low = F.greatest("a_x_min", "b_x_min"), F.greatest("a_y_min", "b_y_min")
    w, h = F.least("a_x_max", "b_x_max") - left, F.least("a_y_max", "b_y_max") - low
    joined = a.join(b, ["kx", "ky"]).filter((w > 0) & (h > 0) & (F.floor(left / size) == F.col("kx")) & (F.floor(low / size) == F.col("ky")))
    area = lambda s: (F.col(f"{s}_x_max") - F.col(f"{s}_x_min")) * (F.col(f"{s}_y_max") - F.col(f"{s}_y_min"))
    mid = lambda s, c: (F.col(f"{s}_{c}_min") + F.col(f"{s}_{c}_max")) / 2
    inter = w * h
    union = area("a") + area("b") - inter
    return joined.select(
        F.col("a__class").alias("a"), F.col("b__class").alias("b"), inter.alias("intersection"), union.alias("union_area"), (inter / union).alias("iou"),
        (inter / area("a")).alias("a_share"), (inter / area("b")).alias("b_share"), (F.least(area("a"), area("b")) / F.greatest(area("a"), area("b"))).alias("area_ratio"),
        F.sqrt(F.pow(mid("a", "x") - mid("b", "x"), 2) + F.pow(mid("a", "y") - mid("b", "y"), 2)).alias("distance"), area("a").alias("area_a"), area("b").alias("area_b"),
    )


def _class_pairs(classes: DataFrame, size: float) -> DataFrame:
    """``_pairs_between`` for classes among themselves (a not after b), a class with itself too."""
    return _pairs_between(classes, classes, size).filter("a <= b").drop("area_a", "area_b")


def pairs_of_members(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Pairs of rows (a before b) for pairs of classes (a not after b): each row of one with each of the other, or the pairs
    within a class. ``members`` has ``key, _class``. Columns of the pair stay, ``a_share`` and ``b_share`` with their rows.
    The rows made aren't shuffled again, and all tasks make some."""
    mine, theirs = members.select(F.col("_class").alias("a"), F.col(key).alias("_ka")), members.select(F.col("_class").alias("b"), F.col(key).alias("_kb"))
    parts = 4 * max(2, pairs.sparkSession.sparkContext.defaultParallelism)
    j = pairs.join(mine, "a").repartition(parts, "b").join(theirs, "b").filter((F.col("_ka") < F.col("_kb")) | ((F.col("a") < F.col("b")) & (F.col("_ka") > F.col("_kb"))))
    first = F.col("_ka") < F.col("_kb")
    swapped = {"a_share": "b_share", "b_share": "a_share"}
    rest = [F.when(first, F.col(c)).otherwise(F.col(swapped[c])).alias(c) if c in swapped else F.col(c) for c in pairs.columns if c not in ("a", "b")]
    return j.select(F.least("_ka", "_kb").alias("a"), F.greatest("_ka", "_kb").alias("b"), *rest)


def iou_pairs(boxes: DataFrame, key: str, size: float) -> DataFrame:
    """Pairs of boxes (a before b) that overlap, with intersection, union, IoU, each one's share and the distance of
    centres. Distinct boxes are compared once; only the result holds each pair of rows."""
    classes = _box_classes(boxes)
    return pairs_of_members(_class_pairs(classes, size), boxes.select(key, *BOX).join(classes, list(BOX)).select(key, "_class"), key)


def dedup_footprints(boxes: DataFrame, key: str, priority: str, size: float, iou: float = 0.35, min_area: float = 0.0) -> DataFrame:
    """``status`` new or duplicate of each footprint, and ``keeper``: the best one it repeats. Order is source priority,
    then larger area, then id. A footprint repeats an accepted one before it whose IoU reaches ``iou``.

    Of footprints with equal sides only the first can be new: what it repeats the others repeat, and else they repeat it. So
    the distinct boxes are decided by their first ones, in rounds that take all whose better neighbours are decided; each
    round's state is written to the shared folder. The others then find their keeper among the new ones near them."""
    from ..session import stored

    area = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    rows = boxes.filter(area >= min_area).select(key, *BOX, F.struct(F.col(priority).alias("p"), (-area).alias("a"), F.col(key).alias("k")).alias("o"))
    # Boxes without an inside overlap nothing, not even their like; nor does anything repeat its like beyond an IoU of 1.
    alike = (F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min")) & F.lit(iou <= 1)
    classes = _box_classes(rows.filter(alike))
    members = stored(rows.filter(alike).join(classes, list(BOX)).select(key, "_class", "o"), "footprint-members")
    firsts = stored(members.groupBy("_class").agg(F.min("o").alias("o")), "first-footprints")
    pairs = _class_pairs(classes, size).filter((F.col("iou") >= iou) & (F.col("a") < F.col("b"))).select("a", "b", "iou")
    both = pairs.join(firsts.select(F.col("_class").alias("a"), F.col("o").alias("oa")), "a").join(firsts.select(F.col("_class").alias("b"), F.col("o").alias("ob")), "b")
    first = F.col("oa") < F.col("ob")
    edges = stored(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse"), "iou"), "edges")
    state = firsts.select("_class", F.lit(None).cast("string").alias("status"))
    while True:
        of = state.select(F.col("_class").alias("better"), F.col("status").alias("s"))
        seen = edges.join(of, "better").groupBy(F.col("worse").alias("_class")).agg(F.count_if(F.col("s").isNull()).alias("open"), F.count_if(F.col("s") == "new").alias("hits"))
        decided = F.when(F.col("status").isNotNull(), F.col("status")).when(F.coalesce("hits", F.lit(0)) > 0, "duplicate").when(F.coalesce("open", F.lit(0)) > 0, None).otherwise("new")
        state = stored(state.join(seen, "_class", "left").select("_class", decided.alias("status")), "footprints")
        if not state.filter("status is null").limit(1).count():
            break
    none = F.lit(None).cast(dict(boxes.dtypes)[key])
    known = members.join(state, "_class").join(firsts.select("_class", F.col("o").alias("first")), "_class")
    new = F.col("o") == F.col("first")
    kept = known.filter("status = 'new'").select(key, F.when(new, "new").otherwise("duplicate").alias("status"), F.when(~new, F.col("first.k")).alias("keeper"))
    ends = edges.select("better", "worse", "iou").union(edges.select("worse", "better", "iou")).toDF("keeps", "_class", "iou")
    near = ends.join(state.filter("status = 'new'").join(firsts, "_class").select(F.col("_class").alias("keeps"), F.col("o").alias("k")), "keeps").select("_class", "iou", "k")
    found = known.filter("status = 'duplicate'").select(key, "_class", "o").join(near, "_class").filter(F.col("k") < F.col("o"))
    found = found.groupBy(key).agg(F.max_by("k.k", F.struct("iou", -F.col("k.k"))).alias("keeper")).select(key, F.lit("duplicate").alias("status"), "keeper")
    alone = rows.filter(~F.coalesce(alike, F.lit(False))).select(key, F.lit("new").alias("status"), none.alias("keeper"))
    return kept.unionByName(found).unionByName(alone)


# When a footprint repeats the best accepted one that it meets (IoU; or its own and the other's overlap; or
# the distance of centres with an area ratio), and the own overlap below which it is new all the same.
DUPLICATE = {"iou": 0.35, "own": 0.60, "other": 0.30, "distance": 8.0, "ratio": (0.5, 2.0), "new_below": 0.20}


#: Rows of footprints that a tile holds at most, where a square alone doesn't hold more; and how many footprints of a class
#: and priority are told apart in a round.
TILE, HEADS = 1_500_000, 8


def _tile_width(marks: DataFrame, size: float) -> float:
    """The width of the largest tiles, ``size`` times a power of two, of which none holds too many rows; infinite where one
    tile may hold all."""
    cells = marks.groupBy(*(F.floor(F.col(f"{v}_min") / size).alias(f"k{v}") for v in "xy")).agg(F.count("*").alias("n")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(24))))
    tiles = cells.groupBy("j", *(F.floor(F.col(f"k{v}") / F.pow(F.lit(2.0), F.col("j"))).alias(f"t{v}") for v in "xy")).agg(F.sum("n").alias("n"))
    found = tiles.groupBy("j").agg(F.max("n"), F.sum("n")).collect()  # 25 rows
    if found[0][2] <= TILE:
        return float("inf")
    return size * 2.0 ** max([j for j, n, _ in found if n <= TILE], default=0)


def _tiled(marks: DataFrame, accepted: DataFrame | None, width: float, shift: tuple[int, int]) -> DataFrame:
    """Rows of ``footprints.decide`` with their tile (``tx, ty``): the ``marks`` of a class in the tile that holds the corner
    of its box, and in each tile the first open footprint of classes of other tiles, and the accepted ones, that overlap the
    box around its own. Grids may be shifted by half a tile."""
    from .footprints import ACCEPTED, ELSEWHERE, FIRST

    whole = width == float("inf")
    at = lambda c, k: F.lit(0).cast("long") if whole else F.floor(c / width + shift[k] / 2)
    kind = lambda k: F.lit(k).cast("int")
    own = marks.select(at(F.col("x_min"), 0).alias("tx"), at(F.col("y_min"), 1).alias("ty"), "_class", *BOX, "kind", "o")
    known = None if accepted is None else accepted.select("_class", *BOX, kind(ACCEPTED).alias("kind"), "o")
    if whole:
        return own if known is None else own.unionByName(known.withColumns({"tx": at(F.lit(0), 0), "ty": at(F.lit(0), 1)}))
    fronts = marks.filter(F.col("kind") == FIRST).groupBy("_class", *BOX).agg(F.min("o").alias("o")).select("_class", *BOX, kind(ELSEWHERE).alias("kind"), "o")
    spread = lambda rows: rows.withColumn("kx", F.explode(F.sequence(at(F.col("x_min"), 0), at(F.col("x_max"), 0)))).withColumn("ky", F.explode(F.sequence(at(F.col("y_min"), 1), at(F.col("y_max"), 1))))
    around = own.groupBy("tx", "ty").agg(F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))
    around = spread(around).select("kx", "ky", "tx", "ty", *(F.col(c).alias(f"t_{c}") for c in BOX))
    met = spread(fronts if known is None else fronts.unionByName(known)).join(around, ["kx", "ky"])
    left, low = F.greatest("x_min", "t_x_min"), F.greatest("y_min", "t_y_min")
    met = met.filter((F.least("x_max", "t_x_max") > left) & (F.least("y_max", "t_y_max") > low) & (at(left, 0) == F.col("kx")) & (at(low, 1) == F.col("ky")))
    own_front = (F.col("kind") == ELSEWHERE) & (at(F.col("x_min"), 0) == F.col("tx")) & (at(F.col("y_min"), 1) == F.col("ty"))
    return own.unionByName(met.filter(~own_front).select("tx", "ty", "_class", *BOX, "kind", "o"))


def resolve_footprints(boxes: DataFrame, key: str, priority: str, size: float, min_area: Column | None = None, rules: Mapping[str, object] = DUPLICATE) -> DataFrame:
    """``status`` of each footprint in order of source priority, larger area, id: ``rejected_tiny`` below its ``min_area``,
    else by the best accepted footprint before it (largest IoU, own overlap, other's overlap, least distance; the earlier
    of ties): ``merged_duplicate`` by one of the three rules, ``accepted_new`` if it overlaps none or hardly, else
    ``conflict_review``. ``match`` is that best one.

    Footprints with equal sides form a class, of which at most one is accepted: those behind it have it as their best. First
    the accepted ones are found, from the first few and the last of each class and priority: a round cuts the map into tiles
    of bounded size, each of which is decided in order as far as it doesn't depend on open footprints of others. The next
    round's tiles are shifted and, as less is open, larger, so chains of footprints cost rounds only where they cross
    borders. Then all footprints are compared with the accepted ones that their class overlaps."""
    from ..session import ship_package, stored
    from .footprints import FIRST, LAST, decide_tiles

    spark = boxes.sparkSession
    ship_package(spark)
    area = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    tiny = F.lit(False) if min_area is None else area < min_area
    low, high = rules["ratio"]
    alike = 1 >= rules["iou"] or (1 >= rules["own"] and 1 >= rules["other"]) or (0 <= rules["distance"] and low <= 1 <= high)
    copies = "merged_duplicate" if alike else "accepted_new" if 1 < rules["new_below"] else "conflict_review"
    # Rules by which a copy is new leave each footprint a class of its own.
    by = [*BOX, key] if copies == "accepted_new" else list(BOX)
    inside = (F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min"))
    large = boxes.filter(~tiny).select(key, *BOX, F.struct(F.col(priority).alias("p"), (-area).alias("a"), F.col(key).alias("k")).alias("o"))
    classes = _box_classes(large.filter(inside), by)
    members = stored(large.filter(inside).join(classes, by).select(key, "_class", *BOX, "o"), "footprint-members")
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    made = ", ".join(f"{c} {kinds[c]}" for c in ("_class", *BOX, "o")) + ", open boolean"
    accepted = bounds = None
    for turn in count():
        left = members if bounds is None else members.join(bounds, "_class").filter(F.col("o") >= F.col("bound"))
        place = F.row_number().over(Window.partitionBy("_class", "o.p").orderBy("o"))
        heads = left.withColumn("n", place).filter(F.col("n") <= HEADS).select("_class", *BOX, F.lit(FIRST).alias("kind"), "o")
        lasts = left.groupBy("_class", *BOX, "o.p").agg(F.max("o").alias("o"), F.count("*").alias("n")).filter(F.col("n") > HEADS)
        marks = stored(heads.unionByName(lasts.select("_class", *BOX, F.lit(LAST).alias("kind"), "o")), "footprint-marks")
        if not marks.limit(1).count():
            break
        rows = _tiled(marks, accepted, _tile_width(marks, size), ((0, 0), (1, 1), (1, 0), (0, 1))[turn % 4])
        rows = rows.repartition(4 * max(2, spark.sparkContext.defaultParallelism), "tx", "ty").sortWithinPartitions("tx", "ty", "o")
        found = stored(rows.mapInArrow(lambda batches: decide_tiles(batches, rules), made), "footprints")
        fresh = found.filter("not open").drop("open")
        accepted = fresh if accepted is None else accepted.unionByName(fresh)
        bounds = found.filter("open").select("_class", F.col("o").alias("bound"))
        if not bounds.limit(1).count():
            break
    none = F.lit(None).cast(dict(boxes.dtypes)[key])
    out = boxes.filter(tiny).select(key, F.lit("rejected_tiny").alias("status"), none.alias("match"))
    out = out.unionByName(large.filter(~F.coalesce(inside, F.lit(False))).select(key, F.lit("accepted_new").alias("status"), none.alias("match")))
    if accepted is None:
        return out
    first = accepted.select("_class", F.col("o").alias("at"))
    members = members.join(first, "_class", "left").select(key, "_class", "o", "at")
    # Of a class that has an accepted one, the footprints behind it are its copies.
    behind, new = F.col("o") > F.col("at"), F.col("o") == F.col("at")
    copied = members.filter("o >= at").select(key, F.when(behind, copies).otherwise("accepted_new").alias("status"), F.when(behind, F.col("at.k")).alias("match"))
    pairs = _pairs_between(classes, accepted, size).filter("a != b").withColumnsRenamed({"a": "_class", "a_share": "own", "b_share": "other"}).withColumn("ratio", F.col("area_b") / F.col("area_a"))
    same = (F.col("iou") >= rules["iou"]) | ((F.col("own") >= rules["own"]) & (F.col("other") >= rules["other"])) | ((F.col("distance") <= rules["distance"]) & F.col("ratio").between(low, high))
    verdict = F.when(same, "merged_duplicate").when(F.col("own") < rules["new_below"], "accepted_new").otherwise("conflict_review")
    near = pairs.join(first.select(F.col("_class").alias("b"), F.col("at").alias("by")), "b").select("_class", "by", "iou", "own", "other", (-F.col("distance")).alias("d"), verdict.alias("verdict"))
    merit = F.struct("iou", "own", "other", "d", (-F.col("by.p")).alias("p"), (-F.col("by.a")).alias("a"), (-F.col("by.k")).alias("k"))
    rest = members.filter("at is null or o < at").join(near, "_class").filter(F.col("by") < F.col("o")).groupBy(key).agg(F.max_by(F.struct("verdict", F.col("by.k").alias("k")), merit).alias("best"))
    rest = rest.select(key, F.col("best.verdict").alias("status"), F.when(F.col("best.verdict") != "accepted_new", F.col("best.k")).alias("match"))
    return stored(out.unionByName(copied).unionByName(rest), "footprint-states")


def merge_provenance(boxes: DataFrame, state: DataFrame, key: str, priority: str, source: str, promoted: Sequence[str], accepted: str = "accepted_new", merged: str = "merged_duplicate", match: str = "match") -> DataFrame:
    """The accepted footprints with ``candidates`` (how many footprints each stands for), ``sources`` (in order of priority
    and id), and the ``promoted`` columns filled, where they are null, from the first merged one that knows them."""
    rows = boxes.join(state.select(key, "status", F.col(match).alias("_match")), key).filter(F.col("status").isin(accepted, merged))
    order = F.struct(F.col("status") != accepted, priority, key)
    target = F.when(F.col("status") == accepted, F.col(key)).otherwise(F.col("_match"))
    sources = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(source).alias("s")))), lambda x: x["s"]), ";")
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in promoted]
    sums = rows.withColumn("_to", target).groupBy("_to").agg(F.count("*").alias("candidates"), sources.alias("sources"), *filled)
    return sums.withColumnRenamed("_to", key)


def union_area(boxes: Column) -> Column:
    """Area of the union of an array of boxes (``x0, x1, y0, y1``): between two neighbouring x of their sides, the heights of
    the boxes there are merged from below."""
    sides = F.array_sort(F.array_distinct(F.concat(F.transform(boxes, lambda b: b["x0"]), F.transform(boxes, lambda b: b["x1"]))))
    n = F.greatest(F.size(sides) - 1, F.lit(0))

    def height(a: Column, b: Column) -> Column:
        spans = F.array_sort(F.transform(F.filter(boxes, lambda p: (p["x0"] <= a) & (p["x1"] >= b)), lambda p: F.struct(p["y0"].alias("lo"), p["y1"].alias("hi"))))
        start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("sum"))
        step = lambda s, p: F.struct(F.greatest(s["top"], p["hi"]).alias("top"), (s["sum"] + F.greatest(p["hi"] - F.greatest(s["top"], p["lo"]), F.lit(0.0))).alias("sum"))
        return F.aggregate(spans, start, step, lambda s: s["sum"])

    strips = F.zip_with(F.slice(sides, 1, n), F.slice(sides, 2, n), lambda a, b: (b - a) * height(a, b))
    return F.aggregate(strips, F.lit(0.0), lambda s, x: s + x)


def non_covered(boxes: DataFrame, ref: DataFrame, key: str, size: float, share: float = 0.35) -> DataFrame:
    """Boxes whose own area is covered by the reference by less than ``share``, with ``covered_share``; what several
    reference boxes cover counts once. A box's pieces are united for each square cell of width ``size``; boxes with equal
    sides, and references with equal sides, take part once."""
    own = boxes.select(*BOX).distinct()
    a, b = _near(own, size), _near(ref.select(*BOX).distinct().withColumns({f"r_{c}": F.col(c) for c in BOX}), size).drop(*BOX)
    j = a.join(b, ["kx", "ky"])
    left, low = F.greatest("x_min", "r_x_min"), F.greatest("y_min", "r_y_min")
    w, h = F.least("x_max", "r_x_max") - left, F.least("y_max", "r_y_max") - low
    # Each piece, cut to the cell, so that the cells' unions add up.
    cut = lambda c, k: F.greatest(F.least(c, (F.col(k) + 1) * size), F.col(k) * size)
    piece = F.struct(cut(left, "kx").alias("x0"), cut(left + w, "kx").alias("x1"), cut(low, "ky").alias("y0"), cut(low + h, "ky").alias("y1"))
    pieces = j.filter((w > 0) & (h > 0)).groupBy(*BOX, "kx", "ky").agg(F.collect_set(piece).alias("_pieces"))
    covered = pieces.groupBy(*BOX).agg(F.sum(union_area(F.col("_pieces"))).alias("_c"))
    area = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    return boxes.join(covered, list(BOX), "left").select(*boxes.columns, F.coalesce("_c", F.lit(0.0)).alias("_c")).withColumn("covered_share", F.col("_c") / area).filter(F.col("covered_share") < share).drop("_c")


def rasterise(polygons: DataFrame, res: float, value: str) -> DataFrame:
    """Pixels (row, col) whose centre lies in a ring or shape, with the tallest value.

    By scan lines: each edge tells where it crosses the rows of centres that it spans. A row's crossings in ascending order
    are the ends of its runs of pixels, by the even-odd rule, so holes and parts need nothing more. Work grows with the
    rows that edges span and with the pixels covered, not with the box around a shape."""
    rings = F.col("shape") if "shape" in polygons.columns else F.array("ring")
    first = lambda v: F.ceil(v / res - 0.5).cast("long")  # noqa: E731  the first centre at or behind a place

    def crossings(ring: Column) -> Column:
        n = F.size(ring)
        ends = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
        return F.flatten(F.transform(ends, of_edge))

    def of_edge(e: Column) -> Column:
        low, high = first(F.least(e["ay"], e["by"])), first(F.greatest(e["ay"], e["by"])) - 1
        at = lambda r: e["ax"] + (e["bx"] - e["ax"]) * F.coalesce(F.try_divide((r + 0.5) * res - e["ay"], e["by"] - e["ay"]), F.lit(0.0))
        none = F.array().cast("array<struct<row:bigint,x:double>>")
        return F.when(high >= low, F.transform(F.sequence(low, F.greatest(low, high)), lambda r: F.struct(r.alias("row"), at(r).alias("x")))).otherwise(none)

    cut = polygons.select(F.col(value), F.array_sort(F.flatten(F.transform(rings, crossings))).alias("cut"))
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("cut"), F.lit(1))), lambda i: (i % 2 == 1) & (i < F.size("cut"))), lambda i: F.struct(F.element_at("cut", i).alias("a"), F.element_at("cut", i + 1).alias("b")))
    runs = cut.select(value, F.explode(pairs).alias("p")).select(value, F.col("p.a.row").alias("row"), first(F.col("p.a.x")).alias("from"), (first(F.col("p.b.x")) - 1).alias("to")).filter("to >= from")
    return runs.select("row", F.explode(F.sequence("from", "to")).alias("col"), value).groupBy("row", "col").agg(F.max(value).alias(value))


def combine_layers(buildings: DataFrame, vegetation: DataFrame, least: float) -> DataFrame:
    """Vegetation counts from a height of ``least`` on, and never on buildings; one row for each pixel of either."""
    b, v = buildings.select("row", "col", F.col("height").alias("building")), vegetation.select("row", "col", F.col("height").alias("veg"))
    j = b.join(v, ["row", "col"], "full").na.fill(0.0, ["building", "veg"])
    return j.withColumn("veg", F.when((F.col("veg") >= least) & (F.col("building") <= 0), F.col("veg")).otherwise(F.lit(0.0))).withColumn("surface", F.greatest("building", "veg"))


def _pairs_within(points: DataFrame, key: str, radius: float) -> DataFrame:
    """Ordered pairs of different points at most ``radius`` apart, by buckets of that size."""
    here = points.select(key, "x", "y").withColumn("bx", F.floor(F.col("x") / radius)).withColumn("by", F.floor(F.col("y") / radius))
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    there = points.select(F.col(key).alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(moves).alias("m"))
    there = there.withColumn("bx", F.floor(F.col("ox") / radius) + F.col("m.i")).withColumn("by", F.floor(F.col("oy") / radius) + F.col("m.j")).drop("m")
    d = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    return here.join(there, ["bx", "by"]).withColumn("d", d).filter((F.col("d") <= radius) & (F.col(key) != F.col("other"))).select(key, "other", "d")


def knn_distance(points: DataFrame, key: str, k: int) -> DataFrame:
    """Distance to the k-th nearest other point, however far; null where there are fewer."""
    near = nearest(points, points.select(F.col(key).alias("other"), "x", "y"), key, "other", k, apart=True).filter(F.col("rank") == k)
    return points.select(key).join(near.select(key, F.col("d").alias("kth_distance")), key, "left")


def _square_links(core: DataFrame, eps: float, side: float) -> DataFrame:
    """``a, b``: pairs of squares (``square``) that hold core points at most ``eps`` apart. Two squares are compared by parts:
    boxes farther apart than ``eps`` are dropped, two points of theirs near enough make a link, and only parts that neither
    tells anything about are cut into four. A pair that is linked goes no further, so dense squares aren't paired off."""
    from ..session import stored

    core = stored(core.select("square", "sx", "sy", "x", "y"), "core-points")
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min(F.struct("x", "y")).alias("p")]

    def parts(level: int) -> DataFrame:
        at = lambda c: F.floor(F.col(c) * (2.0**level / side)).cast("long")
        return core.groupBy("square", at("x").alias("px"), at("y").alias("py")).agg(*box)

    def named(frame: DataFrame, s: str) -> DataFrame:
        return frame.select(*(F.col(c).alias(f"{s}_{c}") for c in ("square", "px", "py", "x0", "x1", "y0", "y1", "p")))

    own = core.select("square", "sx", "sy").distinct()
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)))
    reach = own.select(F.col("square").alias("a_square"), F.explode(moves).alias("m"), "sx", "sy").select("a_square", (F.col("sx") + F.col("m.i")).alias("sx"), (F.col("sy") + F.col("m.j")).alias("sy"))
    pairs = reach.join(own, ["sx", "sy"]).select("a_square", F.col("square").alias("b_square"))
    whole = parts(0)
    pairs = pairs.join(named(whole, "a"), "a_square").join(named(whole, "b"), "b_square")
    links, level = None, 0
    while True:
        gap = lambda c: F.greatest(F.col(f"b_{c}0") - F.col(f"a_{c}1"), F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.lit(0.0))
        near = F.sqrt(F.pow(F.col("a_p.x") - F.col("b_p.x"), 2) + F.pow(F.col("a_p.y") - F.col("b_p.y"), 2)) <= eps
        tried = stored(pairs.filter(F.sqrt(F.pow(gap("x"), 2) + F.pow(gap("y"), 2)) <= eps).withColumn("near", near), "square-parts")
        hit = tried.filter("near").select("a_square", "b_square").distinct()
        links = hit if links is None else links.union(hit)
        single = (F.col("a_x0") == F.col("a_x1")) & (F.col("a_y0") == F.col("a_y1")) & (F.col("b_x0") == F.col("b_x1")) & (F.col("b_y0") == F.col("b_y1"))
        left = tried.filter(~F.col("near") & ~single).join(hit, ["a_square", "b_square"], "left_anti")
        if not left.limit(1).count():
            return links.select(F.col("a_square").alias("a"), F.col("b_square").alias("b"))
        level += 1
        finer = parts(level)
        up = lambda s: [F.shiftright(f"{s}_px", 1).alias(f"{s}_ux"), F.shiftright(f"{s}_py", 1).alias(f"{s}_uy")]
        a, b = (named(finer, s).select("*", *up(s)) for s in ("a", "b"))
        of = lambda s: [f"{s}_square", f"{s}_ux", f"{s}_uy"]
        pairs = left.select("a_square", F.col("a_px").alias("a_ux"), F.col("a_py").alias("a_uy"), "b_square", F.col("b_px").alias("b_ux"), F.col("b_py").alias("b_uy"))
        pairs = pairs.join(a, of("a")).join(b, of("b"))


def dbscan(points: DataFrame, key: str, eps: float, least: int) -> DataFrame:
    """``cluster`` (least core id of the cluster; null for noise) and ``core``. Core points have ``least`` points within
    ``eps``, themselves included; clusters are components of core points, border points join their least cluster. Points
    without coordinates are noise.

    Points lie in squares with a diagonal of ``eps``. All points of a square are near each other: with ``least`` of them
    all are core, and a square's core points are of one cluster in any case. So only points of squares with fewer look for
    neighbours, in the squares around, and clusters are components of squares, not of points: no list of near pairs is
    made, and a square with any number of points is one node."""
    from ..session import stored

    side = eps / 2**0.5
    rows = points.filter("x is not null and y is not null").select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = rows.withColumns({"sx": F.floor(F.col("x") / side), "sy": F.floor(F.col("y") / side)}).withColumn("square", F.struct("sx", "sy"))
    # Rounding may put two points of one square a hair more than eps apart; their distance counts as eps.
    full = rows.groupBy("sx", "sy").agg(F.count("*").alias("n"))
    rows = stored(rows.join(full, ["sx", "sy"]).withColumn("dense", F.col("n") >= least), "clustered-points")
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4))
    # Fewer than ``least`` points of each square ask, so a square's points are met by some tens of others at most.
    asking = rows.filter("not dense").select(F.col(key).alias("asker"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(moves).alias("m"), "sx", "sy")
    asking = asking.select("asker", "ax", "ay", (F.col("sx") + F.col("m.i")).alias("sx"), (F.col("sy") + F.col("m.j")).alias("sy"), ((F.col("m.i") == 0) & (F.col("m.j") == 0)).alias("own"))
    near = F.col("own") | (F.sqrt(F.pow(F.col("x") - F.col("ax"), 2) + F.pow(F.col("y") - F.col("ay"), 2)) <= eps)
    degree = asking.join(rows.select("sx", "sy", "x", "y"), ["sx", "sy"]).filter(near).groupBy("asker").agg(F.count("*").alias("degree"))
    core = rows.join(degree.withColumnRenamed("asker", key), key, "left").withColumn("core", F.col("dense") | F.coalesce(F.col("degree") >= least, F.lit(False))).drop("degree")
    core = stored(core, "core-marks")
    inner = core.filter("core")
    squares = stored(inner.groupBy("square").agg(F.min(key).alias("cluster")), "core-squares")
    links = _square_links(inner, eps, side)
    links = stored(links.union(links.select("b", "a")), "square-links")
    labels = squares
    while True:
        best = links.join(labels.select(F.col("square").alias("b"), F.col("cluster").alias("c")), "b").groupBy(F.col("a").alias("square")).agg(F.min("c").alias("c"))
        step = labels.join(best, "square", "left").select("square", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("c", "cluster")).alias("cluster"))
        # A cluster's name is the least id of one of its squares: what that square is named by now is a shorter way.
        jump = step.groupBy("old").agg(F.min("cluster").alias("up"))
        fresh = stored(step.join(jump, "old").select("square", "old", F.least("cluster", "up").alias("cluster")), "clusters")
        labels = fresh.select("square", "cluster")
        if not fresh.filter("old <> cluster").limit(1).count():
            break
    inner = inner.join(labels, "square").select(key, "x", "y", "sx", "sy", "cluster")
    outer = core.filter("not core").select(F.col(key).alias("asker")).join(asking, "asker")
    border = outer.join(inner.select("sx", "sy", "x", "y", "cluster"), ["sx", "sy"]).filter(near).groupBy("asker").agg(F.min("cluster").alias("b_cluster"))
    out = points.select(key).join(inner.select(key, "cluster"), key, "left").join(border.withColumnRenamed("asker", key), key, "left")
    return out.select(key, F.coalesce("cluster", "b_cluster").alias("cluster"), F.col("cluster").isNotNull().alias("core"))


def gwr(points: DataFrame, key: str, x_col: str, y_col: str, bandwidth: float) -> DataFrame:
    """Local regression with one predictor: intercept, slope and R² from neighbours within the bandwidth, weighted by
    (1 - (d/b)²)². Points at one place have the same neighbours and the same weight for others, so the places are joined,
    with sums of their points; only points without coordinates stand alone."""
    from ..session import stored

    u, v = F.col(x_col), F.col(y_col)
    sums = {"n": F.count("*"), "u": F.sum(u), "v": F.sum(v), "uu": F.sum(u * u), "uv": F.sum(u * v), "vv": F.sum(v * v)}
    located = points.filter("x is not null and y is not null")
    places = stored(located.groupBy("x", "y").agg(*(e.alias(k) for k, e in sums.items())).withColumn("place", F.monotonically_increasing_id()), "places")
    near = _pairs_within(places, "place", bandwidth).unionByName(places.select("place", F.col("place").alias("other"), F.lit(0.0).alias("d")))
    j = near.join(places.select(F.col("place").alias("other"), *sums), "other").withColumn("w", F.pow(1 - F.pow(F.col("d") / bandwidth, 2), 2))
    totals = [F.sum("n").alias("n"), F.sum(F.col("w") * F.col("n")).alias("sw"), *(F.sum(F.col("w") * F.col(k)).alias(f"s{k}") for k in ("u", "v", "uu", "uv", "vv"))]
    s = located.select(key, "x", "y").join(j.groupBy("place").agg(*totals).join(places.select("place", "x", "y"), "place"), ["x", "y"]).drop("x", "y", "place")
    s = s.unionByName(points.filter("x is null or y is null").select(key, F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("sw"), u.alias("su"), v.alias("sv"), (u * u).alias("suu"), (u * v).alias("suv"), (v * v).alias("svv")))
    cu, cv, cc = (F.col("suu") / F.col("sw") - F.pow(F.col("su") / F.col("sw"), 2)), (F.col("svv") / F.col("sw") - F.pow(F.col("sv") / F.col("sw"), 2)), (F.col("suv") / F.col("sw") - F.col("su") * F.col("sv") / F.pow("sw", F.lit(2)))
    tiny = lambda c: F.when(c > 1e-9, c)
    slope = cc / tiny(cu)
    return s.select(key, "n", slope.alias("slope"), (F.col("sv") / F.col("sw") - slope * F.col("su") / F.col("sw")).alias("intercept"), (cc * cc / (tiny(cu) * tiny(cv))).alias("local_r2"))


def green_view(pixels: DataFrame, masks: Mapping[str, object], low: float = 5.0, high: float = 40.0) -> DataFrame:
    """Green-view index of each image: 100 x masked pixels / pixels, for each mask, and a class of the first."""
    names: Sequence[str] = list(masks)
    out = pixels.withColumns(dict(masks)).groupBy("image_id").agg(F.count("*").alias("pixels"), *((100.0 * F.sum(m) / F.count("*")).alias(f"gvi_{m}") for m in names))
    v = F.col(f"gvi_{names[0]}")
    return out.withColumn("gvi_class", F.when(v < low, "low").when(v < high, "medium").otherwise("high"))


