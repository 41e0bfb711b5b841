"""Grid, overlay, footprint and cluster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import geo as G
from ..operators import pairing as J
from ..operators import ranking as R
from .adapters import adapter, duck
from .calibration import R6


def decay_access(spark: SparkSession, d: str) -> DataFrame:
    return R6(J.decay_access(adapter(spark, d, "cells"), adapter(spark, d, "nodes"), 300.0, 800.0))


DECAY = f"""{duck('cells', 'nodes')}, k as (select cell, type, weight, sqrt(power(x - nx, 2) + power(y - ny, 2)) as d from cells join nodes on nx between x - 800 and x + 800 and ny between y - 800 and y + 800)
 select cell, type, round(sum(weight * exp(-d / 300.0)), 6) as access, count(*) as nodes from k where d <= 800 group by cell, type"""


def overlay_fraction(spark: SparkSession, d: str) -> DataFrame:
    return R6(J.overlay_area(adapter(spark, d, "cells"), adapter(spark, d, "boxes"), 100.0))


OVERLAY = f"""{duck('cells', 'boxes')}, a as (select cell, sum((least(x_max, x + 100) - greatest(x_min, x)) * (least(y_max, y + 100) - greatest(y_min, y))) as a from cells join boxes on x_max > x and x_min < x + 100 and y_max > y and y_min < y + 100 group by cell)
 select cells.cell, round(least(1, coalesce(a, 0) / 10000.0), 6) as covered from cells left join a on a.cell = cells.cell"""


def points_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    p = adapter(spark, d, "cells").select("cell", (F.col("x") + 7).alias("px"), (F.col("y") + 9).alias("py"))
    return J.points_in_boxes(p, adapter(spark, d, "boxes"), 100.0, "cell", "box")


IN_BOX = f"{duck('cells', 'boxes')} select cell, min(box) as box from cells left join boxes on x + 7 between x_min and x_max and y + 9 between y_min and y_max group by cell"


def point_density(spark: SparkSession, d: str) -> DataFrame:
    n = adapter(spark, d, "nodes").select(F.col("nx").alias("px"), F.col("ny").alias("py"))
    return R6(A.point_density(n, adapter(spark, d, "cells"), 100.0))


DENSITY = f"{duck('cells', 'nodes')} select cell, count(node) as points, round(count(node) / 0.01, 6) as per_km2 from cells left join nodes on floor(nx / 100) = floor(x / 100) and floor(ny / 100) = floor(y / 100) group by cell"


def zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.zonal_stats(adapter(spark, d, "pixels"), 100.0, "height", "svf"))


ZONAL = f"""{duck('pixels')} select floor(x / 100)::bigint as cx, floor(y / 100)::bigint as cy, count(*) as pixels, count(*) filter (height <= 0.5) as open_pixels, round(count(*) filter (height <= 0.5) / count(*), 6) as open_fraction,
 round(avg(svf) filter (height <= 0.5), 6) as mean, min(svf) filter (height <= 0.5) as min, max(svf) filter (height <= 0.5) as max, round(quantile_cont(svf, 0.1) filter (height <= 0.5), 6) as p10, round(quantile_cont(svf, 0.5) filter (height <= 0.5), 6) as p50,
 round(quantile_cont(svf, 0.9) filter (height <= 0.5), 6) as p90, round(avg(height) filter (height > 0.5), 6) as mean_height from pixels group by cx, cy"""


def shade_hours(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.shade_hours(adapter(spark, d, "pixels"), 100.0, [11, 12, 13]))


SHADE = f"""{duck('pixels')}, e as (select floor(x / 100)::bigint as cx, floor(y / 100)::bigint as cy, hour, avg(shaded) as s from pixels group by 1, 2, 3) select cx, cy, round(max(s) filter (hour = 11), 6) as h11, round(max(s) filter (hour = 12), 6) as h12, round(max(s) filter (hour = 13), 6) as h13,
 round(avg(s) filter (hour in (11, 12, 13)), 6) as mean_share, round(max(s), 6) as max_share from e group by cx, cy"""


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return adapter(spark, d, "boxes").select(F.floor(F.col("x_min") / 200).cast("long").alias("zone"), "box", "type", (F.pow(10 + F.col("size"), 2)).alias("area"), F.when(F.col("box") % 4 != 0, F.col("size") / 1e1).alias("gpr"))


P = f"{duck('boxes')}, p as (select floor(x_min / 200)::bigint as zone, box, type, power(10 + size, 2) as area, case when box % 4 <> 0 then size / 1e1 end as gpr from boxes)"


def area_weighted(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.area_weighted_mean(_pieces(spark, d), "zone", "gpr", "area", "type").drop("shares"))


WEIGHTED = f"""{P}, t as (select zone, type, sum(area) as a, sum(area) filter (gpr is not null) as k, sum(area * gpr) as w from p group by zone, type)
 select zone, round(sum(w) / sum(k), 6) as mean, arg_max(type, (a, type)) as dominant, sum(a) as area, round(max(a) / sum(a), 6) as dominant_fraction from t group by zone"""


def type_breakdown(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["Manufacturer#1", "Manufacturer#2"]
    return R6(A.type_breakdown(_pieces(spark, d), "zone", "type", "area", "box", {"Manufacturer#1": 0.8, "Manufacturer#3": 0.5}, kinds))


TYPES = f"""{P} select zone, coalesce(sum(area) filter (type = 'Manufacturer#1'), 0) as area_0, coalesce(sum(area) filter (type = 'Manufacturer#2'), 0) as area_1, sum(area) as area, count(distinct box) as features,
 round(sum(area * case type when 'Manufacturer#1' then 0.8 when 'Manufacturer#3' then 0.5 else 0 end), 6) as weighted_area from p group by zone"""


def completeness(spark: SparkSession, d: str) -> DataFrame:
    z = _pieces(spark, d).groupBy("zone").agg(F.sum(F.when(F.col("box") % 3 == 0, F.col("area"))).alias("old"), F.sum(F.when(F.col("box") % 3 != 1, F.col("area"))).alias("new"), F.sum("area").alias("ref"))
    return R6(A.completeness(z, "old", "new", "ref"))


COMPLETE = f"""{P}, z as (select zone, sum(area) filter (box % 3 = 0) as old, sum(area) filter (box % 3 <> 1) as new, sum(area) as ref from p group by zone) select *, round(old / ref, 6) as old_ratio, round(new / ref, 6) as new_ratio, round(new / ref - old / ref, 6) as gain from z"""


def source_summary(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.source_summary(_pieces(spark, d), "type", "area", "gpr"))


SOURCES = f"{P} select type, count(*) as n, sum(area) as area_sum, round(avg(area), 6) as area_mean, count(gpr) as heights from p group by type"


def median_by_group(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.median_by_group(_pieces(spark, d), ["type"], ["area", "gpr"]))


MEDIANS = f"{P} select type, round(quantile_cont(area, 0.5), 6) as median_area, round(quantile_cont(gpr, 0.5), 6) as median_gpr from p group by type"


def opacity_sweep(spark: SparkSession, d: str) -> DataFrame:
    areas = adapter(spark, d, "boxes").select((F.pmod("box", F.lit(500)) + 1).alias("cell"), "type", F.pow(10 + F.col("size"), 2).alias("area"))
    rows = [(s, f"Manufacturer#{k}", o * k / 5) for s, o in (("low", 0.4), ("default", 0.6), ("high", 0.9)) for k in range(1, 6)]
    scenarios = spark.createDataFrame(rows, "scenario string, type string, opacity double")
    return R6(R.scenario_sweep(areas, adapter(spark, d, "cells").select("cell", "shade"), scenarios, 100.0))


SWEEP = f"""{duck('cells', 'boxes')}, s as (select s as scenario, 'Manufacturer#' || k as type, o * k / 5 as opacity from (values ('low', 0.4::double), ('default', 0.6), ('high', 0.9)) v(s, o), range(1, 6) t(k)),
 p as (select box % 500 + 1 as cell, scenario, sum(power(10 + size, 2) * opacity) / 10000.0 as proxy from boxes b join s on s.type = b.type group by 1, 2), n as (select distinct scenario from s),
 e as (select n.scenario, 1 - (1 - shade) * (1 - least(1, coalesce(proxy, 0))) - shade as d from cells c cross join n left join p on p.cell = c.cell and p.scenario = n.scenario)
 select scenario, round(avg(d), 6) as mean, round(stddev_samp(d), 6) as std, round(max(d), 6) as max, round(quantile_cont(d, 0.95), 6) as p95, count(*) filter (d > 0.05) as over_005 from e group by scenario"""


def spatial_blocks(spark: SparkSession, d: str) -> DataFrame:
    return G.spatial_blocks(adapter(spark, d, "cells"), "x", "y", 700.0).groupBy("block").agg(F.count("*").alias("cells"))


BLOCKS = f"{duck('cells')}, m as (select min(x) as a, min(y) as b from cells) select floor((y - b) / 700)::bigint || '_' || floor((x - a) / 700)::bigint as block, count(*) as cells from cells cross join m group by 1"


def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R6(G.iou_pairs(adapter(spark, d, "boxes"), "box", 100.0))


IOU = f"""{duck('boxes')}, j as (select a.box as a, b.box as b, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min) as w, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min) as h, (a.x_max - a.x_min) * (a.y_max - a.y_min) as aa, (b.x_max - b.x_min) * (b.y_max - b.y_min) as ba,
  sqrt(power((a.x_min + a.x_max - b.x_min - b.x_max) / 2, 2) + power((a.y_min + a.y_max - b.y_min - b.y_max) / 2, 2)) as dist from boxes a join boxes b on a.box < b.box and a.x_min < b.x_max and b.x_min < a.x_max and a.y_min < b.y_max and b.y_min < a.y_max)
 select a, b, w * h as intersection, aa + ba - w * h as union_area, round(w * h / (aa + ba - w * h), 6) as iou, round(w * h / aa, 6) as a_share, round(w * h / ba, 6) as b_share, round(least(aa, ba) / greatest(aa, ba), 6) as area_ratio, round(dist, 6) as distance from j"""


def non_covered(spark: SparkSession, d: str) -> DataFrame:
    b = adapter(spark, d, "boxes")
    ref = b.filter("priority = 1 and box % 7 = 0")
    return R6(G.non_covered(b.filter("priority = 2"), ref, "box", 100.0).select("box", "covered_share"))


NON_COVERED = f"""{duck('boxes')}, r as (select * from boxes where priority = 1 and box % 7 = 0), b as (select * from boxes where priority = 2), c as (select b.box, sum((least(b.x_max, r.x_max) - greatest(b.x_min, r.x_min)) * (least(b.y_max, r.y_max) - greatest(b.y_min, r.y_min))) as c
  from b join r on b.x_min < r.x_max and r.x_min < b.x_max and b.y_min < r.y_max and r.y_min < b.y_max group by b.box), s as (select b.box, coalesce(c, 0) / ((x_max - x_min) * (y_max - y_min)) as covered_share from b left join c on c.box = b.box) select box, round(covered_share, 6) as covered_share from s where covered_share < 0.35"""


def dedup_footprints(spark: SparkSession, d: str) -> DataFrame:
    return G.dedup_footprints(adapter(spark, d, "boxes"), "box", "priority", 100.0, 0.25)


def _pairs(where: str) -> str:
    """Pairs of overlapping boxes, the better one first: its order is source, larger area, id."""
    return f"""q as (select box, priority, type, size, x_min, x_max, y_min, y_max, (x_max - x_min) * (y_max - y_min) as area, row_number() over (order by priority, -(x_max - x_min) * (y_max - y_min), box) as o from boxes where {where}),
 j as (select a.box as better, b.box as worse, a.o as bo, a.area as ba, b.area as wa, (least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * (least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)) as i,
  sqrt(power((a.x_min + a.x_max - b.x_min - b.x_max) / 2, 2) + power((a.y_min + a.y_max - b.y_min - b.y_max) / 2, 2)) as dist from q a join q b on a.o < b.o and a.x_min < b.x_max and b.x_min < a.x_max and a.y_min < b.y_max and b.y_min < a.y_max)"""


def _repeats(where: str, iou: float) -> str:
    """``s``: the status and keeper of each box. Each step of the recursion holds all boxes, and decides those whose better
    neighbours are decided."""
    return f"""{duck('boxes').replace('with ', 'with recursive ', 1)}, {_pairs(where)}, e as (select better, worse, i / (ba + wa - i) as iou from j where i / (ba + wa - i) >= {iou}),
 r as (select 0 as step, box, cast(null as varchar) as status from q union all select step + 1, box, case when status is not null then status when undecided > 0 then null when news > 0 then 'duplicate' else 'new' end
  from (select r.step, r.box, r.status, count(*) filter (e.better is not null and b.status is null) as undecided, count(*) filter (b.status = 'new') as news from r left join e on e.worse = r.box left join r b on b.box = e.better group by 1, 2, 3) t where exists (select 1 from r where status is null)),
 l as (select box, status from r where step = (select max(step) from r)), k as (select worse, better, row_number() over (partition by worse order by iou desc, better) as n from e join l on l.box = better and l.status = 'new'),
 s as (select l.box, l.status, case when l.status = 'duplicate' then better end as keeper from l left join k on k.worse = l.box and n = 1)"""


DEDUP = f"{_repeats('true', 0.25)} select box, status, keeper from s"


def knn_distance(spark: SparkSession, d: str) -> DataFrame:
    p = adapter(spark, d, "nodes").select("node", F.col("nx").alias("x"), F.col("ny").alias("y"))
    return R6(G.knn_distance(p, "node", 5))


KNN = f"""{duck('nodes')}, j as (select a.node, sqrt(power(a.nx - b.nx, 2) + power(a.ny - b.ny, 2)) as d, b.node as o from nodes a join nodes b on a.node <> b.node),
 r as (select *, row_number() over (partition by node order by d, o) as k from j) select n.node, round(d, 6) as kth_distance from nodes n left join r on r.node = n.node and k = 5"""


def dbscan(spark: SparkSession, d: str) -> DataFrame:
    p = adapter(spark, d, "nodes").select("node", F.col("nx").alias("x"), F.col("ny").alias("y"))
    return G.dbscan(p, "node", 75.0, 3)


DBSCAN = f"""{duck('nodes').replace('with ', 'with recursive ', 1)}, n as (select a.node, b.node as other from nodes a join nodes b on b.nx between a.nx - 75 and a.nx + 75 and b.ny between a.ny - 75 and a.ny + 75 and sqrt(power(a.nx - b.nx, 2) + power(a.ny - b.ny, 2)) <= 75),
 k as (select node from n group by node having count(*) >= 3), l as (select n.node, other from n join k using (node) join k o on o.node = other),
 r as (select node, node as root from k union select l.other, r.root from r join l on l.node = r.node), c as (select node, min(root) as cluster from r group by node),
 e as (select n.node, min(cluster) as cluster from n join c on c.node = other group by n.node)
 select nodes.node, coalesce(c.cluster, e.cluster) as cluster, c.cluster is not null as core from nodes left join c using (node) left join e on e.node = nodes.node"""


def gwr(spark: SparkSession, d: str) -> DataFrame:
    p = adapter(spark, d, "nodes").select("node", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("weight").alias("u"), (F.col("weight") * 2 + F.col("nx") / 1e3 + F.pmod("node", F.lit(7))).alias("v"))
    return G.gwr(p, "node", "u", "v", 300.0).withColumns({c: F.round(c, 4) for c in ("slope", "intercept", "local_r2")})


GWR = f"""{duck('nodes')}, p as (select node, nx as x, ny as y, weight as u, weight * 2 + nx / 1e3 + node % 7 as v from nodes), j as (select a.node, b.u, b.v, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) as d from p a join p b on b.x between a.x - 300 and a.x + 300 and b.y between a.y - 300 and a.y + 300),
 w as (select *, power(1 - power(d / 300.0, 2), 2) as w from j where d <= 300), s as (select node, count(*) as n, sum(w) as sw, sum(w * u) as su, sum(w * v) as sv, sum(w * u * u) as suu, sum(w * u * v) as suv, sum(w * v * v) as svv from w group by node),
 c as (select *, suu / sw - power(su / sw, 2) as cu, svv / sw - power(sv / sw, 2) as cv, suv / sw - su * sv / power(sw, 2) as cc from s)
 select node, n, round(case when cu > 1e-9 then cc / cu end, 4) as slope, round(case when cu > 1e-9 then sv / sw - cc / cu * su / sw end, 4) as intercept, round(case when cu > 1e-9 and cv > 1e-9 then cc * cc / (cu * cv) end, 4) as local_r2 from c"""


def combine_layers(spark: SparkSession, d: str) -> DataFrame:
    px = adapter(spark, d, "pixels").select(F.floor(F.col("y") / 2).cast("long").alias("row"), F.floor(F.col("x") / 2).cast("long").alias("col"), "height", "svf")
    b = px.groupBy("row", "col").agg(F.max("height").alias("height")).filter("height > 0")
    v = px.groupBy("row", "col").agg(F.max("svf").alias("height"))
    return G.combine_layers(b, v, 0.5)


COMBINE = f"""{duck('pixels')}, p as (select floor(y / 2)::bigint as "row", floor(x / 2)::bigint as col, max(height) as b, max(svf) as v from pixels group by 1, 2) select "row", col, b as building, case when v >= 0.5 and b <= 0 then v else 0 end as veg, greatest(b, case when v >= 0.5 and b <= 0 then v else 0 end) as surface from p"""


def rasterised(spark: SparkSession, d: str) -> DataFrame:
    b = adapter(spark, d, "boxes")
    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))))
    rows = b.withColumn("ring", ring).withColumn("height", F.col("size").cast("double"))
    return G.rasterise(rows.filter(S.ring_area(F.col("ring")) > 900), 10.0, "height").groupBy("row").agg(F.count("*").alias("pixels"), F.sum("height").alias("height"))


RASTER = f"""{duck('boxes')}, p as (select r as "row", c as col, max(size)::double as h from boxes, range(0, 500) a(r), range(0, 500) b(c) where power(10 + size, 2) > 900 and c >= floor(x_min / 10) and c <= floor(x_max / 10) and r >= floor(y_min / 10) and r <= floor(y_max / 10)
  and (c + 0.5) * 10 >= x_min and (c + 0.5) * 10 < x_max and (r + 0.5) * 10 >= y_min and (r + 0.5) * 10 < y_max group by 1, 2) select "row", count(*) as pixels, sum(h) as height from p group by 1"""


def green_view(spark: SparkSession, d: str) -> DataFrame:
    p = adapter(spark, d, "pixels").select(F.concat(F.lit("img"), F.pmod(F.floor(F.col("x") / 50), F.lit(12)).cast("string")).alias("image_id"), F.pmod(F.col("x") * 7, F.lit(256)).alias("r"), F.pmod(F.col("y") * 5, F.lit(256)).alias("g"), F.pmod(F.col("x") + F.col("y"), F.lit(256)).alias("b"))
    return R6(G.green_view(p, S.green_masks(F.col("r"), F.col("g"), F.col("b"))))


GREEN = f"""{duck('pixels')}, p as (select 'img' || (floor(x / 50)::bigint % 12) as image_id, x * 7 % 256 as r, y * 5 % 256 as g, (x + y) % 256 as b from pixels), m as (select image_id, count(*) as pixels, round(100.0 * sum((2 * g - r - b > 20)::int) / count(*), 6) as gvi_excess_green,
 round(100.0 * sum((g > r and g > b)::int) / count(*), 6) as gvi_dominant_green, round(100.0 * sum((g > r and g > b and 2 * g - r - b > 40 and not (r > 180 and g > 180 and b < 120))::int) / count(*), 6) as gvi_strong_green from p group by image_id)
 select *, case when gvi_excess_green < 5 then 'low' when gvi_excess_green < 40 then 'medium' else 'high' end as gvi_class from m"""


def clipped(spark: SparkSession, d: str) -> DataFrame:
    tiles = G.tile_around(adapter(spark, d, "cells").select("cell", "x", "y"), 100.0, 20.0)
    return J.clip_to_box(tiles, (500.0, 500.0, 1500.0, 1200.0), 50.0).select("cell", "x_min", "x_max", "y_min", "y_max")


CLIPPED = f"{duck('cells')} select cell, x - 70 as x_min, x + 70 as x_max, y - 70 as y_min, y + 70 as y_max from cells where x + 70 >= 450 and x - 70 <= 1550 and y + 70 >= 450 and y - 70 <= 1250"

def footprints_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Buildings by all rules; those of the last source must be larger."""
    b = adapter(spark, d, "boxes").withColumn("height", F.when(F.col("box") % 3 == 0, F.col("size").cast("double")))
    state = G.resolve_footprints(b, "box", "priority", 100.0, F.when(F.col("priority") == 3, 400.0).otherwise(150.0))
    merged = G.merge_provenance(b, state, "box", "priority", "type", ["height"])
    return state.join(merged, "box", "left")


RESOLVED = f"""{duck('boxes').replace('with ', 'with recursive ', 1)}, {_pairs('(x_max - x_min) * (y_max - y_min) >= case when priority = 3 then 400 else 150 end')},
 f as (select *, i / (ba + wa - i) as iou, i / wa as own, i / ba as other, ba / wa as ratio from j), e as (select *, case when iou >= 0.35 or (own >= 0.6 and other >= 0.3) or (dist <= 8 and ratio between 0.5 and 2) then 'merged_duplicate' when own < 0.2 then 'accepted_new' else 'conflict_review' end as verdict,
  row_number() over (partition by worse order by iou desc, own desc, other desc, dist, bo) as merit from f),
 r as (select 0 as step, box, cast(null as varchar) as status, cast(null as bigint) as match from q union all select step + 1, box, case when status is not null then status when undecided = 0 then coalesce(best.verdict, 'accepted_new') end,
  case when status is not null then match when undecided = 0 and best.verdict <> 'accepted_new' then best.better end
  from (select r.step, r.box, r.status, r.match, count(*) filter (e.better is not null and b.status is null) as undecided, arg_min({{'verdict': e.verdict, 'better': e.better}}, e.merit) filter (b.status = 'accepted_new') as best
   from r left join e on e.worse = r.box left join r b on b.box = e.better group by 1, 2, 3, 4) t where exists (select 1 from r where status is null)),
 l as (select box, status, match from r where step = (select max(step) from r) union all select box, 'rejected_tiny', null from boxes where (x_max - x_min) * (y_max - y_min) < case when priority = 3 then 400 else 150 end),
 m as (select case when status = 'accepted_new' then box else match end as kept, status <> 'accepted_new' as later, priority, box, type, case when box % 3 = 0 then size::double end as height from l join boxes using (box) where status in ('accepted_new', 'merged_duplicate')),
 g as (select kept, count(*) as candidates, string_agg(type, ';' order by later, priority, box) as sources, arg_min(height, {{'a': later, 'b': priority, 'c': box}}) filter (height is not null) as height from m group by kept)
 select l.box, status, match, candidates, sources, height from l left join g on g.kept = l.box"""


def overhead_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Overhead structures: IoU of one half, with the number of candidates that each kept one stands for."""
    b = adapter(spark, d, "boxes").filter("priority <> 2")
    state = G.dedup_footprints(b, "box", "priority", 100.0, 0.5)
    return G.merge_provenance(b, state, "box", "priority", "type", [], "new", "duplicate", "keeper")


OVERHEAD = f"""{_repeats('priority <> 2', 0.5)}, m as (select case when status = 'new' then s.box else keeper end as kept, status <> 'new' as later, q.priority, s.box, q.type from s join q on q.box = s.box)
 select kept as box, count(*) as candidates, string_agg(type, ';' order by later, priority, box) as sources from m group by kept"""


QUERIES = {
    "decay_access": (decay_access, DECAY), "overlay_fraction": (overlay_fraction, OVERLAY), "points_in_boxes": (points_in_boxes, IN_BOX), "point_density": (point_density, DENSITY), "zonal_stats": (zonal_stats, ZONAL), "shade_hours": (shade_hours, SHADE),
    "area_weighted": (area_weighted, WEIGHTED), "type_breakdown": (type_breakdown, TYPES), "completeness": (completeness, COMPLETE), "source_summary": (source_summary, SOURCES), "median_by_group": (median_by_group, MEDIANS), "opacity_sweep": (opacity_sweep, SWEEP),
    "spatial_blocks": (spatial_blocks, BLOCKS), "iou_pairs": (iou_pairs, IOU), "non_covered": (non_covered, NON_COVERED), "dedup_footprints": (dedup_footprints, DEDUP), "footprints_resolved": (footprints_resolved, RESOLVED), "overhead_dedup": (overhead_dedup, OVERHEAD), "knn_distance": (knn_distance, KNN), "dbscan": (dbscan, DBSCAN), "gwr": (gwr, GWR),
    "combine_layers": (combine_layers, COMBINE), "rasterised": (rasterised, RASTER), "green_view": (green_view, GREEN), "clipped": (clipped, CLIPPED),
}
