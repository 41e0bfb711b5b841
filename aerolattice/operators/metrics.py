"""Skill, event and threshold metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import period
from .windows import reverse_cumulative


def skill(df: DataFrame, pred: str, obs: str, by: Sequence[str] = ()) -> DataFrame:
    """n, bias (pred - obs), MAE, RMSE, 90th percentile of the absolute error, R² and correlation (null for n <= 2)."""
    rows = df.filter(F.col(pred).isNotNull() & F.col(obs).isNotNull())
    e, y = F.col(pred) - F.col(obs), F.col(obs)
    spread = F.var_pop(y) * F.count(y)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(e).alias("bias"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.percentile(F.abs(e), F.lit(0.9)).alias("p90_abs"),
        (1 - F.try_divide(F.sum(e * e), F.when(spread > 0, spread))).alias("r2"),
        F.when(F.count("*") > 2, F.corr(pred, obs)).alias("corr"),
    )


def skill_by_overlapping_periods(df: DataFrame, pred: str, obs: str, hour: str, by: Sequence[str] = ()) -> DataFrame:
    """``skill`` for overall, daytime, peak and night; a row counts in each period that holds it."""
    h = F.col(hour)
    names = F.array_compact(F.array(F.lit("overall"), F.when((h >= 7) & (h < 19), "daytime").otherwise("night"), F.when((h >= 12) & (h < 16), "peak")))
    return skill(df.withColumn("period", F.explode(names)), pred, obs, [*by, "period"])


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return df.withColumns({"precision": precision, "recall": recall, "specificity": specificity}).withColumns(
        {"f1": F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "balanced": (F.col("recall") + F.col("specificity")) / 2}
    )


def confusion(df: DataFrame, obs: str, score: str, obs_thr: float, score_thr: float, by: Sequence[str] = ()) -> DataFrame:
    rows = df.filter(F.col(obs).isNotNull() & F.col(score).isNotNull())
    o, s = F.col(obs) >= obs_thr, F.col(score) >= score_thr
    return _rates(rows.groupBy(*by).agg(F.count_if(o & s).alias("tp"), F.count_if(~o & s).alias("fp"), F.count_if(o & ~s).alias("fn"), F.count_if(~o & ~s).alias("tn")))


def threshold_scan(df: DataFrame, obs: str, score: str, event: float, low: int, high: int, step: int, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts for each threshold, given in hundredths. One pass: a score's bucket is the largest threshold that
    it reaches, and counts from a bucket upwards are those of its threshold."""
    rows = df.filter(F.col(obs).isNotNull() & F.col(score).isNotNull())
    reached = F.floor((F.floor(F.round(F.col(score) * 100, 6)) - low) / step) * step + low
    bucket = F.greatest(F.lit(low - step), F.least(F.lit(high), reached)).cast("long")
    counts = rows.groupBy(*by, bucket.alias("threshold")).agg(F.count_if(F.col(obs) >= event).alias("tp"), F.count_if(F.col(obs) < event).alias("fp"))
    keys = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    grid = keys.select("*", F.explode(F.sequence(*(F.lit(v).cast("long") for v in (low - step, high, step)))).alias("threshold"))
    full = grid.join(counts, [*by, "threshold"], "left").na.fill(0, ["tp", "fp"])
    up = reverse_cumulative(full, "threshold", ["tp", "fp"], by)
    totals = counts.groupBy(*by).agg(F.sum("tp").alias("_p"), F.sum("fp").alias("_n"))
    joined = up.join(totals, list(by)) if by else up.crossJoin(F.broadcast(totals))
    out = joined.filter(F.col("threshold") >= low).select(*by, "threshold", F.col("tp_ge").alias("tp"), F.col("fp_ge").alias("fp"), (F.col("_p") - F.col("tp_ge")).alias("fn"), (F.col("_n") - F.col("fp_ge")).alias("tn"))
    return _rates(out)


def operating_points(scan: DataFrame, event: int, by: Sequence[str] = ()) -> DataFrame:
    """For each group four thresholds: fixed at the event, best F1, recall of 0.90 with most precision, precision of 0.70
    with most recall; the lowest of equals; ``available`` is false where no threshold qualifies."""
    fields = F.struct("threshold", "precision", "recall", "f1", "tp", "fp", "fn")

    def best(ok: Column, score: Column) -> Column:
        return F.max_by(F.when(ok, fields), F.when(ok, F.struct(score, -F.col("threshold"))))

    p, r, f = F.col("precision"), F.col("recall"), F.col("f1")
    points = {
        "fixed": best(F.lit(True), -F.abs(F.col("threshold") - event)),
        "best_f1": best(f.isNotNull(), f),
        "recall_90": best((r >= 0.9) & p.isNotNull(), p),
        "precision_70": best((p >= 0.7) & r.isNotNull(), r),
    }
    wide = scan.groupBy(*by).agg(*(v.alias(k) for k, v in points.items()))
    long = wide.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("point"), F.col(k).alias("v")) for k in points))).alias("x"))
    return long.select(*by, "x.point", F.col("x.v").isNotNull().alias("available"), *(F.col(f"x.v.{c}").alias(c) for c in ("threshold", "precision", "recall", "f1", "tp", "fp", "fn")))


def residual_by_hour(df: DataFrame, pred: str, obs: str, hour: str) -> DataFrame:
    e = F.col(obs) - F.col(pred)
    return df.groupBy(hour).agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.percentile(e, F.lit(0.5)).alias("median"), F.percentile(F.abs(e), F.lit(0.9)).alias("p90_abs"))


def grouped_bias(df: DataFrame, variants: Sequence[str], obs: str, by: Sequence[str]) -> DataFrame:
    """Bias and MAE of several predictions at once, one row for each group and variant."""
    long = df.select(*by, obs, F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("p")) for v in variants))).alias("x"))
    e = F.col("x.p") - F.col(obs)
    return long.groupBy(*by, F.col("x.variant").alias("variant")).agg(F.count(e).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"))


def period_skill(df: DataFrame, pred: str, obs: str, hour: str) -> DataFrame:
    return skill(df.withColumn("period", period(F.col(hour))), pred, obs, ["period"])


def ladder_metrics(long: DataFrame, pred: str, obs: str, events: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``skill`` of each group with the events' confusion at fixed thresholds beside it: ``ge_<event>_tp`` and so on."""
    out = skill(long, pred, obs, by)
    for event in events:
        part = confusion(long, obs, pred, event, event, by)
        out = out.join(part.select(*by, *(F.col(c).alias(f"ge_{event:g}_{c}") for c in ("tp", "fp", "fn", "precision", "recall", "f1"))), list(by))
    return out


def event_flips(wide: DataFrame, ref: str, variants: Sequence[str], obs: str, thresholds: Sequence[float]) -> DataFrame:
    """For each variant and threshold: rows where it reaches the threshold and the reference doesn't, the reverse, and the
    rows of equal verdict. Rows where one of the three values is missing don't count."""
    cells = F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("p"), F.lit(float(t)).alias("threshold")) for v in variants for t in thresholds))
    rows = wide.select(obs, F.col(ref).alias("_r"), F.explode(cells).alias("x")).filter(F.col(obs).isNotNull() & F.col("_r").isNotNull() & F.col("x.p").isNotNull())
    a, b = F.col("x.p") >= F.col("x.threshold"), F.col("_r") >= F.col("x.threshold")
    return rows.groupBy(F.col("x.variant").alias("variant"), F.col("x.threshold").alias("threshold")).agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("up"), F.count_if(~a & b).alias("down"), F.count_if(a == b).alias("same"))


def bias_corrected_confusion(long: DataFrame, model: str, pred: str, obs: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion at fixed thresholds after each model's bias is taken off its predictions."""
    known = long.filter(F.col(pred).isNotNull() & F.col(obs).isNotNull())
    bias = known.groupBy(F.col(model).alias("_model")).agg(F.avg(F.col(pred) - F.col(obs)).alias("bias"))
    rows = known.join(F.broadcast(bias), F.col(model) == F.col("_model")).withColumn("_p", F.col(pred) - F.col("bias"))  # a row for each model
    rows = rows.select(model, "bias", F.col(obs).alias("_o"), "_p", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    o, s = F.col("_o") >= F.col("threshold"), F.col("_p") >= F.col("threshold")
    return _rates(rows.groupBy(model, "bias", "threshold").agg(F.count_if(o & s).alias("tp"), F.count_if(~o & s).alias("fp"), F.count_if(o & ~s).alias("fn"), F.count_if(~o & ~s).alias("tn")))
