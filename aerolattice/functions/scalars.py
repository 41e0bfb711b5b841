"""Small Column expressions: parsing, names, time, distance, scores, land use and heights."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .thermal import clip

EARTH_M = 6_371_000.0


def safe_double(c: Column) -> Column:
    """The first number in a text such as ``1,234.5 m``; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(c.cast("string"), ",", ""), r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def norm_station_id(c: Column) -> Column:
    x = F.upper(F.trim(c))
    return F.when(~x.isin("", "NAN", "NONE"), x)


def station_from_path(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?:^|[^A-Za-z0-9_])(S\d{2,})(?:[^A-Za-z0-9_]|$)", 1)
    return F.when(found != "", found)


def norm_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


def coalesce_non_empty(*columns: Column) -> Column:
    """The first value that is neither null nor an empty text; zero counts as a value."""
    return F.coalesce(*(F.when(c.cast("string") != "", c) for c in columns))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def to_local_epoch(c: Column, offset_hours: int = 8) -> Column:
    """Seconds since 1970 in local time of a time text: texts with a zone are converted, others are local already; null
    if the text isn't a time."""
    zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    local = F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", "")
    base = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.try_to_timestamp(F.replace(local, F.lit("T"), F.lit(" "))).cast("timestamp_ntz"))
    sign = F.when(F.regexp_extract(c, r"([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
    part = lambda k: F.coalesce(F.regexp_extract(c, r"[+-](\d{2}):?(\d{2})$", k).try_cast("int"), F.lit(0))
    return F.when(zoned, base - sign * (part(1) * 3600 + part(2) * 60) + offset_hours * 3600).otherwise(base)


def round_half_even(epoch: Column, step: int) -> Column:
    """To the nearest multiple of ``step`` seconds, exact halves to the even multiple."""
    low = F.floor(epoch / step)
    rest = epoch - low * step
    up = (rest * 2 > step) | ((rest * 2 == step) & (F.pmod(low, F.lit(2)) == 1))
    return ((low + up.cast("long")) * step).cast("long")


def day(epoch: Column) -> Column:
    return F.floor(epoch / 86400).cast("long")


def hour(epoch: Column) -> Column:
    return F.floor(F.pmod(epoch, F.lit(86400)) / 3600).cast("int")


def hour_fraction(epoch: Column) -> Column:
    """Hour and minute as a number; seconds don't count."""
    return hour(epoch) + F.floor(F.pmod(epoch, F.lit(3600)) / 60) / 60.0


# The two tables of periods, as (from, to, label), with the label of the other hours.
PERIODS = (((7, 12, "morning"), (12, 16, "peak"), (16, 19, "shoulder")), "night")
DAY_NIGHT = (((11, 16, "peak"), (7, 19, "daytime")), "nighttime")


def period(hour_col: Column, bands: tuple = PERIODS) -> Column:
    rows, other = bands
    out = F.when(hour_col.isNull(), F.lit(None).cast("string"))
    for low, high, label in rows:
        out = out.when((hour_col >= low) & (hour_col < high), F.lit(label))
    return out.otherwise(F.lit(other))


def time_features(epoch: Column) -> dict[str, Column]:
    h = hour_fraction(epoch)
    turn = 2 * math.pi / 24
    return {
        "hour_num": h,
        "hour_sin": F.sin(h * turn),
        "hour_cos": F.cos(h * turn),
        "is_daytime": ((h >= 7) & (h < 19)).cast("int"),
        "is_peak": ((h >= 12) & (h < 16)).cast("int"),
        "is_night": ((h < 7) | (h >= 19)).cast("int"),
        "period": period(h),
    }


def unit_to_ms(value: Column, unit: Column) -> Column:
    """Wind to metres a second from knots, km/h or m/s; null for an unknown unit."""
    u = F.lower(F.trim(unit))
    return F.when(u.isin("knots", "kn", "kt"), value * 0.514444).when(u.isin("km/h", "kmh"), value / 3.6).when(u.isin("m/s", "ms"), value)


def fill_source(value: Column, source: Column, label: str = "missing") -> Column:
    """Where a value came from: its source label, or ``label`` for a missing one."""
    return F.when(value.isNull(), F.lit(label)).otherwise(source)


def score_clip(x: Column, low: float, high: float) -> Column:
    return F.lit(0.0) if high <= low else F.coalesce(clip((x - low) / (high - low), 0, 1), F.lit(0.0))


def weighted_score(weights: Mapping[str, float], present: Sequence[str]) -> Column:
    """The weighted sum of the columns that are present, clipped to [0, 1]; an error if none is."""
    terms = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items() if c in present]
    if not terms:
        raise ValueError(f"none of {sorted(weights)} is present")
    return clip(reduce(lambda a, b: a + b, terms), 0, 1)


def conditioned_score(h: Column, v: Column, e: Column, candidate: Column, weights: tuple[float, float, float], penalty: float = 0.5) -> Column:
    wh, wv, we = weights
    return F.when(candidate, wh * h + wv * (h * v) + we * (h * e)).otherwise(penalty * h)


def overhead_shade(shade: Column, proxy: Column, open_fraction: Column) -> Column:
    """Shade of open pixels once overhead structures, known for whole cells, are added."""
    base = clip(F.coalesce(shade, F.lit(0.0)), 0, 1)
    over = clip(clip(F.coalesce(proxy, F.lit(0.0)), 0, 1) / clip(F.coalesce(open_fraction, F.lit(1.0)), 0.01, 1), 0, 1)
    return clip(1.0 - (1.0 - base) * (1.0 - over), 0, 1)


# Land-use classes by ordered keywords.
LAND_USE = [
    ("residential", ["RESIDENTIAL", "HOUSING"]),
    ("commercial", ["COMMERCIAL", "BUSINESS", "WHITE"]),
    ("park_open_space", ["PARK", "OPEN SPACE", "BEACH", "NATURE"]),
    ("transport", ["ROAD", "TRANSPORT", "MRT", "RAIL", "RAPID TRANSIT", "BUS"]),
    ("water", ["WATER", "RESERVOIR", "DRAINAGE"]),
    ("civic_institutional", ["CIVIC", "COMMUNITY", "EDUCATIONAL", "HEALTH", "SPORT", "PLACE OF WORSHIP", "UTILITY"]),
]
# Heights in metres and their source labels, by ordered keywords of land use and type.
HEIGHTS = [
    ("HOSPITAL", 24.0, "HOSPITAL"),
    ("HEALTH", 18.0, "HEALTH"),
    ("HOTEL", 30.0, "HOTEL"),
    ("BUSINESS PARK", 24.0, "BUSINESS PARK"),
    ("COMMERCIAL", 20.0, "COMMERCIAL"),
    ("MASS RAPID TRANSIT", 12.0, "TRANSPORT"),
    ("TRANSPORT", 8.0, "TRANSPORT"),
    ("ROAD", 8.0, "TRANSPORT"),
    ("EDUCATIONAL", 12.0, "EDUCATIONAL"),
    ("CIVIC", 12.0, "CIVIC"),
    ("COMMUNITY", 12.0, "CIVIC"),
    ("PLACE OF WORSHIP", 10.0, "PLACE OF WORSHIP"),
    ("INDUSTRIAL", 10.0, "INDUSTRIAL"),
    ("UTILITY", 8.0, "UTILITY"),
    ("PARK", 6.0, "PARK"),
    ("SPORT", 9.0, "SPORTS"),
    ("RESIDENTIAL", 15.0, "RESIDENTIAL"),
]
SHELTER = ["SHELTER", "ROOF", "COVERED", "CANOPY"]
# Overhead types by ordered keywords over all tags.
OVERHEAD = [
    ("covered_walkway", ["covered walkway", "linkway", "covered_walkway", "shelter", "walkway"]),
    ("pedestrian_bridge", ["pedestrian bridge", "footbridge", "overhead bridge"]),
    ("station_canopy", ["station canopy", "canopy", "platform roof", "station roof"]),
    ("elevated_rail", ["rail", "mrt", "lrt", "viaduct rail", "elevated rail"]),
    ("viaduct", ["viaduct", "flyover"]),
    ("elevated_road", ["motorway", "expressway", "elevated road", "road bridge", "bridge", "highway", "road"]),
]


def by_keyword(text: Column, table: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    out = None
    for label, words in table:
        hit = reduce(lambda a, b: a | b, (text.contains(w) for w in words))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(other))


def simplify_land_use(text: Column) -> Column:
    return by_keyword(F.upper(F.coalesce(text, F.lit(""))), LAND_USE, "other")


def overhead_type(*fields: Column, explicit: Column | None = None) -> Column:
    """A type that is given explicitly and valid, else the first rule whose keywords occur in the tags."""
    found = by_keyword(F.lower(F.concat_ws(" ", *fields)), OVERHEAD, "unknown_overhead")
    if explicit is None:
        return found
    given = F.replace(F.lower(F.trim(explicit)), F.lit(" "), F.lit("_"))
    return F.when(given.isin([label for label, _ in OVERHEAD] + ["unknown_overhead"]), given).otherwise(found)


def assigned_height(explicit: Column, levels: Column, land_use: Column, kind: Column, area_m2: Column) -> dict[str, Column]:
    """Height in metres with its source and confidence: an explicit height, levels times 3 m, shelters, land-use and type
    keywords, then the area; clipped to 3..180 m."""
    text = F.upper(F.concat_ws(" ", F.coalesce(land_use, F.lit("UNKNOWN")), F.coalesce(kind, F.lit(""))))
    shelter = reduce(lambda a, b: a | b, (text.contains(w) for w in SHELTER))
    rules: list[tuple[Column, Column, str, str]] = [
        (explicit.between(2, 180), explicit, "explicit", "medium_high"),
        (levels.between(1, 60), levels * 3.0, "levels_x_3m", "medium_high"),
        (shelter, F.lit(4.0), "type_default_shelter", "medium_low"),
        *((text.contains(word), F.lit(h), f"lu_default:{name}", "medium") for word, h, name in HEIGHTS),
        (area_m2 < 50, F.lit(5.0), "area_default:unknown_small", "low"),
        (area_m2 > 1000, F.lit(12.0), "area_default:unknown_large", "low"),
    ]
    chain = lambda pick, other: reduce(lambda out, r: out.when(r[0], pick(r)), rules[1:], F.when(rules[0][0], pick(rules[0]))).otherwise(other)
    return {
        "height_m": clip(chain(lambda r: r[1].cast("double"), F.lit(10.0)), 3, 180),
        "height_source": chain(lambda r: F.lit(r[2]), F.lit("area_default:unknown_normal")),
        "height_confidence": chain(lambda r: F.lit(r[3]), F.lit("low")),
    }


def hour_from_name(name: Column) -> Column:
    """The hour in a file's name: ``_h13``, or ``_1300D.tif``; null unless 0 to 23."""
    a, b = F.regexp_extract(name, r"_h(\d{1,2})(?:\D|$)", 1), F.regexp_extract(name, r"_(\d{2})\d{2}[DN]\.tif$", 1)
    value = F.coalesce(a.try_cast("int"), b.try_cast("int"))
    return F.when(value.between(0, 23), value)


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring, an array of structs with x and y; closed or open."""
    n = F.size(ring)
    shifted = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, shifted, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)) / 2


def ring_box(ring: Column) -> dict[str, Column]:
    get = lambda k, f: f(F.transform(ring, lambda p: p[k]))
    return {"x_min": get("x", F.array_min), "x_max": get("x", F.array_max), "y_min": get("y", F.array_min), "y_max": get("y", F.array_max)}


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: whether a point lies in a ring."""
    n = F.size(ring)
    shifted = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, shifted, lambda a, b: (((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.coalesce(F.try_divide(y - a["y"], b["y"] - a["y"]), F.lit(0.0)) + a["x"])).cast("int"))
    return F.pmod(F.aggregate(crosses, F.lit(0), lambda s, c: s + c), F.lit(2)) == 1


def shape_area(shape: Column) -> Column:
    """Area of a polygon given as its rings, the first one the outline and the others holes; 0 without rings."""
    areas = F.transform(shape, ring_area)
    return F.coalesce(F.try_element_at(areas, F.lit(1)), F.lit(0.0)) - F.aggregate(F.slice(areas, 2, F.greatest(F.size(areas) - 1, F.lit(0))), F.lit(0.0), lambda s, a: s + a)


def in_shape(x: Column, y: Column, shape: Column) -> Column:
    """Whether a point lies in a shape, which is any number of rings under the even-odd rule: parts and holes alike."""
    return F.aggregate(F.transform(shape, lambda ring: in_ring(x, y, ring)), F.lit(False), lambda s, inside: s != inside)


def shape_distance(x: Column, y: Column, shape: Column) -> Column:
    """Distance of a point to a shape: 0 inside, to the nearest outline elsewhere, a hole's outline for points in it."""
    return F.when(in_shape(x, y, shape), 0.0).otherwise(F.array_min(F.transform(shape, lambda ring: outline_distance(x, y, ring))))


def segment_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point to a ring's outline, 0 inside."""
    return F.when(in_ring(x, y, ring), 0.0).otherwise(outline_distance(x, y, ring))


def outline_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point to a ring's outline."""
    n = F.size(ring)
    shifted = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1))

    def one(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = clip(F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0)), 0, 1)
        return F.sqrt(F.pow(x - a["x"] - t * dx, 2) + F.pow(y - a["y"] - t * dy, 2))

    return F.array_min(F.zip_with(ring, shifted, one))


def green_masks(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Per-pixel vegetation masks: excess green, dominant green, and strong green without high-visibility yellow."""
    excess = 2 * g - r - b
    dominant = (g > r) & (g > b)
    bright_yellow = (r > 180) & (g > 180) & (b < 120)
    return {"excess_green": (excess > 20).cast("int"), "dominant_green": dominant.cast("int"), "strong_green": (dominant & (excess > 40) & ~bright_yellow).cast("int")}


# The coefficients of the screening proxies below.


def height_proxy(density: Column, land_use: Column) -> Column:
    """Mean building height where none is known, from density and land-use class."""
    base = 4 + 42 * F.coalesce(density, F.lit(0.0)) + F.when(land_use == "commercial", 8).when(land_use == "residential", 4).otherwise(0)
    return clip(F.when(land_use.isin("park_open_space", "water"), 2.0).otherwise(base), 2, 55)


def canopy_proxy(park_m: Column, land_use: Column) -> Column:
    """Tree canopy fraction from the distance to a park and the land-use class."""
    extra = F.when(land_use == "park_open_space", 0.25).when(land_use == "residential", 0.05).otherwise(0.0)
    return clip(0.05 + 0.35 * F.exp(-F.coalesce(park_m, F.lit(9999.0)) / 300.0) + extra, 0.02, 0.75)


def greenery_fraction(tree: Column, grass: Column, ndvi: Column) -> Column:
    """Greenery from tree and grass cover and a vegetation index; the green-view percentage is 60 times this, 70 at most."""
    unit = lambda c: clip(F.coalesce(c, F.lit(0.0)), 0, 1)
    return clip(F.greatest(unit(tree), 0.55 * unit(grass), 0.45 * unit((ndvi - 0.12) / 0.60)), 0, 1)


def morphology_proxy(density: Column, height: Column, road: Column, tree: Column, size: float = 100.0) -> dict[str, Column]:
    """Screening values of sky view and shade from density, height, roads and trees."""
    zero = lambda c, top=1.0: clip(F.coalesce(c, F.lit(0.0)), 0, top)
    d, h, r, t = zero(density), clip(F.coalesce(height, F.lit(10.0)), 0, 80), zero(road), zero(tree)
    sky = 1.0 / (1.0 + 0.55 * h / size + 1.8 * d) + 0.10 * r
    shade = 0.08 + 0.55 * d + 0.28 * clip(h / 40.0, 0, 1) + 0.25 * t - 0.15 * r
    return {"svf": clip(sky, 0.18, 0.98), "shade_fraction": clip(shade, 0.04, 0.90)}


def impervious_fraction(density: Column, road: Column, built: Column, green: Column, water: Column, weights: tuple[float, float, float, float] = (0.5, 0.5, 0.35, 0.75)) -> Column:
    """Sealed ground: vector and satellite built-up shares less greenery and water."""
    unit = lambda c: clip(F.coalesce(c, F.lit(0.0)), 0, 1)
    wv, wb, wg, ww = weights
    return clip(wv * clip(unit(density) + unit(road), 0, 1) + wb * unit(built) - wg * unit(green) - ww * unit(water), 0, 1)


def height_warning(explicit: Column, levels: Column, land_use: Column, kind: Column, area_m2: Column) -> Column:
    """What to look at where ``assigned_height`` had to guess: shelters, and large footprints of unknown use; else empty."""
    text = F.upper(F.concat_ws(" ", F.coalesce(land_use, F.lit("UNKNOWN")), F.coalesce(kind, F.lit(""))))
    has = lambda words: reduce(lambda a, b: a | b, (text.contains(w) for w in words))
    known = F.coalesce(explicit.between(2, 180), F.lit(False)) | F.coalesce(levels.between(1, 60), F.lit(False))
    return F.when(known, "").when(has(SHELTER), "possible_shelter_not_ground_up_building").when(has([w for w, _, _ in HEIGHTS]), "").when(area_m2 > 1000, "manual_review_large_unknown_height").otherwise("")


def reviewed_height(assigned: Mapping[str, Column], manual: Column) -> dict[str, Column]:
    """``assigned_height`` with a reviewer's height, where it is positive, before all else."""
    given = manual > 0
    return {"height_m": F.when(given, clip(manual, 3, 180)).otherwise(assigned["height_m"]), "height_source": F.when(given, "manual").otherwise(assigned["height_source"]), "height_confidence": F.when(given, "high").otherwise(assigned["height_confidence"])}


def ring_centroid(ring: Column) -> dict[str, Column]:
    """The centroid of a ring's area, worked out from its first point; the mean of the points where the area is zero."""
    n, first = F.size(ring), F.element_at(ring, 1)
    shifted = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def part(p: Column, q: Column) -> Column:
        px, py, qx, qy = p["x"] - first["x"], p["y"] - first["y"], q["x"] - first["x"], q["y"] - first["y"]
        cross = px * qy - qx * py
        return F.struct(cross.alias("a"), ((px + qx) * cross).alias("x"), ((py + qy) * cross).alias("y"))

    sums = F.aggregate(F.zip_with(ring, shifted, part), zero, lambda s, v: F.struct((s["a"] + v["a"]).alias("a"), (s["x"] + v["x"]).alias("x"), (s["y"] + v["y"]).alias("y")))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / n
    return {k: F.coalesce(first[k] + F.try_divide(sums[k], 3 * sums["a"]), mean(k)) for k in ("x", "y")}


def line_area(line: Column, width: Column) -> Column:
    """The area of a line drawn with a width and flat ends; overlaps at its bends count twice."""
    n = F.size(line)
    steps = F.zip_with(F.slice(line, 1, n - 1), F.slice(line, F.lit(2), n - 1), lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) * width


# The bounds of each mask, ends included, over the features of ``colour_features``. A pixel belongs to a mask if
# it is in all of ``in``, in none of ``out``, within all of ``all``, and within all bounds of at least one of ``any``.
MASKS: dict[str, dict] = {
    "hls_green": {"all": {"hue": (46, 109), "sat": (10, math.inf), "light": (0, 95)}},
    "high_vis": {"all": {"hue": (45, 105), "sat": (42, math.inf), "light": (45, math.inf)}, "any": [{"excess": (0.075, math.inf)}, {"sat": (68, math.inf), "light": (55, math.inf)}, {"sat": (75, math.inf), "value": (70, math.inf)}]},
    "hls_strong": {"in": ["hls_green"], "out": ["high_vis"], "any": [{"excess": (0.026, math.inf)}, {"lab_green": (3, math.inf)}, {"lead": (0, math.inf)}]},
}
#: Ends of ``mask_confidence``: per cent recovered and removed from which it is low, and medium.
CONFIDENCE = (("low", 38, 26), ("medium", 22, 14))
#: CIE 1976, D65: rows of linear red, green and blue for X (over its white) and Y.
TO_X, TO_Y, WHITE_X = (0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), 0.950456
#: How much green must lead red and blue by.
LEAD = 1.03


def hls(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue in degrees, lightness and saturation in percent, and the value, of 8-bit colours."""
    top, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    chroma, total = top - low, top + low
    turn = F.when(top == r, F.try_divide(g - b, chroma)).when(top == g, 2 + F.try_divide(b - r, chroma)).otherwise(4 + F.try_divide(r - g, chroma))
    sat = F.when(total <= 255, F.try_divide(chroma, total)).otherwise(F.try_divide(chroma, 510 - total))
    return {"hue": F.coalesce(F.pmod(60 * turn, F.lit(360.0)), F.lit(0.0)), "light": total / 5.1, "sat": 100 * F.coalesce(sat, F.lit(0.0)), "value": top / 2.55}


def lab_green(r: Column, g: Column, b: Column) -> Column:
    """How green a colour is along the a axis of CIE Lab, in whole steps as in 8-bit images: positive for green."""
    linear = [F.when(v / 255 <= 0.04045, v / 255 / 12.92).otherwise(F.pow((v / 255 + 0.055) / 1.055, 2.4)) for v in (r, g, b)]
    sum_of = lambda row: sum((F.lit(w) * v for w, v in zip(row, linear)), F.lit(0.0))
    root = lambda t: F.when(t > 0.008856, F.pow(t, 1 / 3)).otherwise(7.787 * t + 16 / 116)
    return -F.round(500 * (root(sum_of(TO_X) / WHITE_X) - root(sum_of(TO_Y))))


def colour_features(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """``hls``, excess green over the sum, green of Lab, and by how much green leads both others."""
    lead = F.least(g - LEAD * r, g - LEAD * b)
    return hls(r, g, b) | {"excess": (2.0 * g - r - b) / (r + g + b + 1.0), "lab_green": lab_green(r, g, b), "lead": lead}


def bounded_masks(features: Mapping[str, Column], table: Mapping[str, dict]) -> dict[str, Column]:
    """The masks of a table like ``MASKS`` as 0 and 1; a mask may name earlier ones."""
    within = lambda bounds: reduce(lambda x, y: x & y, (features[f].between(*ends) for f, ends in bounds.items()), F.lit(True))
    found: dict[str, Column] = {}
    for name, rule in table.items():
        parts = [within(rule.get("all", {})), *(found[m] for m in rule.get("in", ())), *(~found[m] for m in rule.get("out", ()))]
        if "any" in rule:
            parts.append(reduce(lambda x, y: x | y, map(within, rule["any"])))
        found[name] = reduce(lambda x, y: x & y, parts)
    return {name: mask.cast("int") for name, mask in found.items()}


def hls_masks(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Vegetation by hue, lightness and saturation; high-visibility colours; and strong green without them."""
    return bounded_masks(colour_features(r, g, b), MASKS)


def mask_confidence(recovered_pct: Column, removed_pct: Column) -> Column:
    """How far a green-view index rests on recovered or removed pixels."""
    return reduce(lambda out, c: F.when((recovered_pct > c[1]) | (removed_pct > c[2]), c[0]).otherwise(out), reversed(CONFIDENCE), F.lit("high"))
