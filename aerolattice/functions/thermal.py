"""Thermal indices as Column expressions. Missing inputs give null, and null classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stull (2011) coefficients, and the cut points of the public WBGT and UTCI classes.
WBGT_CUTS, WBGT_LABELS = (31.0, 33.0), ("low", "moderate", "high")
UTCI_CUTS = (26.0, 32.0, 38.0, 46.0)
UTCI_LABELS = ("no heat stress", "moderate heat stress", "strong heat stress", "very strong heat stress", "extreme heat stress")


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that keep null (``greatest`` and ``least`` would drop it)."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def stull_wet_bulb(t: Column, rh: Column, low: float | None = 1.0, high: float | None = 100.0) -> Column:
    """Wet-bulb temperature; humidity is clipped to the bounds given (None: not at all)."""
    rh = clip(rh, low, high)
    return t * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(t + rh) - F.atan(rh - 1.676331) + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh) - 4.686035


def vapour_pressure(t: Column, rh: Column) -> Column:
    return rh / 100.0 * 6.105 * F.exp(17.27 * t / (237.7 + t))


def utci_proxy(tair: Column, tmrt: Column, wind: Column, rh: Column) -> Column:
    return tair + 0.46 * (tmrt - tair) + 0.055 * (rh - 50) - 1.15 * F.log1p(wind)


def wbgt_screening(tair: Column, tmrt: Column, wind: Column, rh: Column) -> Column:
    globe = tair + 0.32 * (tmrt - tair) - 0.55 * F.log1p(wind)
    return 0.7 * stull_wet_bulb(tair, rh, None, None) + 0.2 * globe + 0.1 * tair


def wbgt_weather_only(t: Column, rh: Column, wind: Column, shortwave: Column, k: float = 0.0045, offset: float = 0.25) -> Column:
    globe = t + k * clip(F.coalesce(shortwave, F.lit(0.0)), 0) / F.sqrt(clip(wind, 0.1) + offset)
    return 0.7 * stull_wet_bulb(t, rh) + 0.2 * globe + 0.1 * t


def wbgt_shaded(t: Column, rh: Column) -> Column:
    return 0.567 * t + 0.393 * vapour_pressure(t, rh) + 3.94


def wbgt_radiative(t: Column, rh: Column, shortwave: Column, wind: Column) -> Column:
    return 0.7 * stull_wet_bulb(t, rh) + 0.3 * t + 0.002 * shortwave - 0.10 * wind


def local_microclimate(t: Column, wind: Column, shortwave: Column, gvi: Column, park_m: Column, density: Column, road: Column, svf: Column, shade: Column) -> dict[str, Column]:
    """Local air temperature, wind and mean radiant temperature of a cell, with the parts they were made of."""
    green = clip(gvi / 60.0, 0, 1)
    park = clip(F.exp(-clip(F.coalesce(park_m, F.lit(9999.0)), 0) / 250.0), 0, 1)
    sun = clip(shortwave / 900.0, 0, 1)
    tair = t + 1.15 * density + 0.85 * road - 0.75 * green - 0.35 * park
    background = clip(wind, 0)
    slowed = clip(background * (0.35 + 0.75 * svf) * (1.0 - 0.35 * density), 0.15)
    floor = clip(background, 0.15)
    sky = 22.0 * sun * (1 - shade) * (0.45 + 0.75 * svf)
    wall = 0.4 * (1 - svf) * clip(tair - 26.0, 0)
    return {
        "tair_local_c": tair,
        "wind_local_ms": F.when(slowed > floor, floor).otherwise(slowed),
        "tmrt_proxy_c": tair + sky + wall - 1.2 * green,
        "gvi_norm": green,
        "park_cooling": park,
        "sky_gain_c": sky,
        "wall_gain_c": wall,
    }


def classify(x: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the first cut above ``x``, else the last; null for null."""
    out = F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        out = out.when(x < cut, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def wbgt_class(x: Column) -> Column:
    return classify(x, WBGT_CUTS, WBGT_LABELS)


def utci_class(x: Column) -> Column:
    return classify(x, UTCI_CUTS, UTCI_LABELS)


def wbgt_alert(cells_high: Column, cells_moderate: Column, top: Column, cells: Column, share: float = 0.10) -> Column:
    """At the default cuts a single flagged cell implies the maximum, so the share matters only with other cuts."""
    enough = F.greatest(F.lit(1), F.ceil(share * cells))
    return F.when((cells_high > 0) | (top >= 33), "high").when((cells_moderate >= enough) | (top >= 31), "moderate").otherwise("low")


def utci_alert(extreme: Column, very_strong: Column, strong: Column, moderate: Column, top: Column, cells: Column, share: float = 0.25) -> Column:
    enough = F.greatest(F.lit(1), F.ceil(share * cells))
    return (
        F.when((extreme > 0) | (top >= 46), "extreme")
        .when((very_strong > 0) | (top >= 38), "very_strong")
        .when((strong >= enough) | (top >= 32), "strong")
        .when((moderate > 0) | (top >= 26), "moderate")
        .otherwise("low")
    )


def combined_alert(wbgt: Column, utci: Column) -> Column:
    return F.when((wbgt == "high") | utci.isin("very_strong", "extreme"), "high").when((wbgt == "moderate") | (utci == "strong"), "elevated").when(utci == "moderate", "watch").otherwise("low")


def radiation_fraction(part: Column, shortwave: Column) -> Column:
    sw = F.coalesce(shortwave, F.lit(0.0))
    return F.when(sw > 1, clip(F.coalesce(part, F.lit(0.0)) / sw, 0, 1)).otherwise(F.lit(0.0))
