"""Queries on shapes with holes and on unions of references that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import geo as G
from ..operators import rings as RG
from ..sources import payloads as P
from .adapters import adapter, duck
from .calibration import R6


def _square(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))


def _courtyards(spark: SparkSession, d: str) -> DataFrame:
    """Each box as a building around a courtyard: walls of 2 in the south and west, of 3 in the north and east."""
    x0, x1, y0, y1 = (F.col(c) for c in ("x_min", "x_max", "y_min", "y_max"))
    return adapter(spark, d, "boxes").withColumn("shape", F.array(_square(x0, x1, y0, y1), _square(x0 + 2, x1 - 3, y0 + 2, y1 - 3)))


#: The four walls of each building, which don't overlap; and, for pieces ``p`` (box, part, x0..y1), the area of each union.
WALLS = """w as (select box, priority, 1 as part, x_min as x0, x_min + 2 as x1, y_min as y0, y_max as y1 from boxes union all select box, priority, 2, x_max - 3, x_max, y_min, y_max from boxes
  union all select box, priority, 3, x_min + 2, x_max - 3, y_min, y_min + 2 from boxes union all select box, priority, 4, x_min + 2, x_max - 3, y_max - 3, y_max from boxes)"""
UNIONS = """c as (select box, part, x0 as x from p union select box, part, x1 from p), s as (select box, part, x as a, lead(x) over (partition by box, part order by x) as b from c),
 l as (select s.box, a, b, y0, y1, max(y1) over (partition by s.box, s.part, a order by y0, y1 rows between unbounded preceding and 1 preceding) as top from s join p on p.box = s.box and p.part = s.part and x0 <= a and x1 >= b),
 u as (select box, sum((b - a) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))) as covered from l group by box)"""
PIECES = "greatest(a.x0, b.x0) as x0, least(a.x1, b.x1) as x1, greatest(a.y0, b.y0) as y0, least(a.y1, b.y1) as y1"
MEET = "a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1"


def union_cover(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the second source with the share of each that the first source's boxes, which overlap each other, cover."""
    b = adapter(spark, d, "boxes")
    return R6(G.non_covered(b.filter("priority = 2"), b.filter("priority = 1"), "box", 100.0, 2.0).select("box", "covered_share"))


UNION_COVER = f"""{duck('boxes')}, w as (select box, 1 as part, priority, x_min as x0, x_max as x1, y_min as y0, y_max as y1 from boxes), p as (select a.box, a.part, {PIECES} from w a join w b on a.priority = 2 and b.priority = 1 and {MEET}), {UNIONS}
 select w.box, round(coalesce(covered, 0) / ((x1 - x0) * (y1 - y0)), 6) as covered_share from w left join u on u.box = w.box where priority = 2"""


def courtyard_cover(spark: SparkSession, d: str) -> DataFrame:
    """Buildings with courtyards of the second source, and how much of each the first source's buildings cover together."""
    b = _courtyards(spark, d)
    return R6(RG.covered_share(b.filter("priority = 2"), b.filter("priority = 1"), "box", 100.0))


COURTYARD_COVER = f"""{duck('boxes')}, {WALLS}, p as (select a.box, a.part, {PIECES} from w a join w b on a.priority = 2 and b.priority = 1 and {MEET}), {UNIONS}, t as (select box, sum((x1 - x0) * (y1 - y0)) as area from w where priority = 2 group by box)
 select t.box, round(area, 6) as area, round(coalesce(covered, 0), 6) as covered, round(coalesce(covered, 0) / area, 6) as share from t left join u on u.box = t.box"""


def courtyard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of overlapping buildings; one may stand in the other's courtyard."""
    out = RG.ring_iou_pairs(_courtyards(spark, d), "box", 100.0)
    return out.select("a", "b", F.round("intersection", 3).alias("intersection"), F.round("iou", 6).alias("iou"))


COURTYARD_PAIRS = f"""{duck('boxes')}, {WALLS}, t as (select box, sum((x1 - x0) * (y1 - y0)) as area from w group by box), i as (select a.box as a, b.box as b, sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) as i from w a join w b on a.box < b.box and {MEET} group by 1, 2)
 select a, b, round(i, 3) as intersection, round(i / (s.area + t.area - i), 6) as iou from i join t s on s.box = a join t on t.box = b"""


def courtyard_points(spark: SparkSession, d: str) -> DataFrame:
    """A point of each cell: the first building that holds it, and the nearest one; a courtyard is outside."""
    p = adapter(spark, d, "cells").select("cell", (F.col("x") + 7.3).alias("px"), (F.col("y") + 9.4).alias("py"))
    b = _courtyards(spark, d).withColumnRenamed("box", "near")
    held = RG.first_containing(p, b.withColumnRenamed("near", "inside"), "cell", "inside", 100.0)
    return held.join(RG.nearest_polygon(p, b, "cell", "near", 100.0), "cell").withColumn("distance", F.round("distance", 6))


COURTYARD_POINTS = f"""{duck('cells', 'boxes')}, j as (select cell, box, px, py, x_min, x_max, y_min, y_max, px > x_min and px < x_max and py > y_min and py < y_max as of_box, px > x_min + 2 and px < x_max - 3 and py > y_min + 2 and py < y_max - 3 as of_yard
  from (select cell, x + 7.3 as px, y + 9.4 as py from cells) join boxes on px between x_min - 100 and x_max + 100 and py between y_min - 100 and y_max + 100),
 k as (select *, case when of_yard then least(px - x_min - 2, x_max - 3 - px, py - y_min - 2, y_max - 3 - py) when of_box then 0 else sqrt(power(greatest(x_min - px, 0, px - x_max), 2) + power(greatest(y_min - py, 0, py - y_max), 2)) end as d from j),
 n as (select *, row_number() over (partition by cell order by d, box) as k from k where d <= 100), h as (select cell, min(box) as box from k where of_box and not of_yard group by cell)
 select c.cell, h.box as inside, round(coalesce(d, 9999), 6) as distance, n.box as near from cells c left join h on h.cell = c.cell left join n on n.cell = c.cell and n.k = 1"""


def feature_holes(spark: SparkSession, d: str) -> DataFrame:
    """Features read from documents: polygons with and without a courtyard, and multipolygons of one of each."""
    b = adapter(spark, d, "boxes")
    x0, x1, y0, y1 = (F.col(c) for c in ("x_min", "x_max", "y_min", "y_max"))
    ring = lambda a, b, c, e: F.array(*(F.array(x, y) for x, y in ((a, c), (b, c), (b, e), (a, e), (a, c))))
    whole, hole = ring(x0, x1, y0, y1), ring(x0 + 2, x1 - 3, y0 + 2, y1 - 3)
    plain, yard = F.to_json(F.array(whole)), F.to_json(F.array(whole, hole))
    kind = F.pmod("box", F.lit(3))
    coordinates = F.when(kind == 0, yard).when(kind == 1, plain).otherwise(F.concat(F.lit("["), yard, F.lit(","), plain, F.lit("]")))
    geometry = F.concat(F.lit('{"type":"'), F.when(kind == 2, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), coordinates, F.lit("}"))
    doc = F.concat(F.lit('{"features":[{"properties":{"box":'), F.col("box").cast("string"), F.lit('},"geometry":'), geometry, F.lit("}]}"))
    rows = P.read_features(b.select(doc.alias("payload"), F.lit("made").alias("source_file")), "box:long")
    return rows.select("box", "part", (F.size("shape") - 1).alias("holes"), F.round(S.shape_area(F.col("shape")), 6).alias("area"))


FEATURE_HOLES = f"""{duck('boxes')} select box, p::int as part, (box % 3 = 0 or (box % 3 = 2 and p = 0))::int as holes, power(10 + size, 2)::double - case when box % 3 = 0 or (box % 3 = 2 and p = 0) then power(5 + size, 2) else 0 end as area
 from boxes, range(0, 2) r(p) where p = 0 or box % 3 = 2"""


QUERIES = {
    "union_cover": (union_cover, UNION_COVER), "courtyard_cover": (courtyard_cover, COURTYARD_COVER), "courtyard_pairs": (courtyard_pairs, COURTYARD_PAIRS), "courtyard_points": (courtyard_points, COURTYARD_POINTS),
    "feature_holes": (feature_holes, FEATURE_HOLES),
}
