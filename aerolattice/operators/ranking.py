"""Rank audits: overlap, transitions, tests, scenario scores."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import score_clip
from ..functions.thermal import clip
from ..session import stored
from .windows import column_quantiles, pct_ranks, rank_desc, row_rank, running_totals

# Weights of the hazard score's parts and of the risk score.
HAZARD = {"wbgt_relative": 0.30, "utci_relative": 0.25, "utci_intensity": 0.15, "wbgt_intensity": 0.10, "utci_duration": 0.10, "wbgt_moderate_duration": 0.06, "wbgt_high_duration": 0.04}
RISK = {"hazard_score": 0.62, "vulnerability_score": 0.23, "exposure_score": 0.15}


def hazard_scores(cells: DataFrame, vulnerability: str, exposure: str) -> DataFrame:
    """Hazard and risk scores of ``hotspot_agg`` rows, and their ranks by risk, hazard, peak UTCI and cell."""
    cells = stored(cells, "cells")  # one row for each cell; six ranks read it
    out = pct_ranks(cells, {c: f"_r_{c}" for c in ("max_utci_c", "p90_utci_c", "mean_utci_c", "max_wbgt_c", vulnerability, exposure)})
    r = lambda c: F.col(f"_r_{c}")
    zero = lambda x: F.coalesce(clip(x, 0, 1), F.lit(0.0))
    parts = {
        "wbgt_relative": r("max_wbgt_c"),
        "utci_relative": clip(0.50 * r("max_utci_c") + 0.30 * r("p90_utci_c") + 0.20 * r("mean_utci_c"), 0, 1),
        "utci_intensity": score_clip(F.col("max_utci_c"), 26, 46),
        "wbgt_intensity": score_clip(F.col("max_wbgt_c"), 27, 35),
        "utci_duration": zero(F.try_divide(F.col("strong_utci_hours").cast("double"), F.col("forecast_hours"))),
        "wbgt_moderate_duration": zero(F.col("moderate_wbgt_hours") / 18.0),
        "wbgt_high_duration": zero(F.col("high_wbgt_hours") / 6.0),
    }
    hazard = sum((w * parts[k] for k, w in HAZARD.items()), F.lit(0.0))
    out = out.withColumns({"hazard_score": clip(hazard, 0, 1), "vulnerability_score": r(vulnerability), "exposure_score": r(exposure)})
    risk = sum((F.col(k) * w for k, w in RISK.items()), F.lit(0.0))
    out = out.withColumn("risk_priority_score", clip(risk, 0, 1)).drop(*(c for c in out.columns if c.startswith("_r_")))
    return row_rank(out, [F.desc(F.round("risk_priority_score", 9)), F.desc(F.round("hazard_score", 9)), F.desc("max_utci_c"), F.col("cell")])


def top_n(df: DataFrame, rank: str, n: int, *ties: str) -> DataFrame:
    return df.filter(F.col(rank).isNotNull()).orderBy(rank, *ties).limit(n)


def stacked_top_n(scenarios: Mapping[str, DataFrame], rank: str, n: int, tie: str) -> DataFrame:
    out = None
    for name, df in scenarios.items():
        part = top_n(df, rank, n, tie).withColumn("scenario", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def topn_overlap(df: DataFrame, key: str, ranks: Sequence[str], n: int) -> DataFrame:
    """For each pair of rankings of one table: how many are in both tops, and the keys of each top alone."""
    pairs = [(a, b) for k, a in enumerate(ranks) for b in ranks[k + 1 :]]
    top = lambda c: F.coalesce(F.col(c) <= n, F.lit(False))
    lists = []
    for a, b in pairs:
        only = lambda x, y: F.array_join(F.array_sort(F.collect_list(F.when(top(x) & ~top(y), F.lpad(F.col(key).cast("string"), 8, "0")))), ",")
        lists.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(top(a) & top(b)).alias("both"), only(a, b).alias("a_only"), only(b, a).alias("b_only")))
    some = df.filter(" or ".join(f"{c} <= {n}" for c in ranks))
    return some.agg(*(x.alias(f"_{k}") for k, x in enumerate(lists))).select(F.explode(F.array(*(F.col(f"_{k}") for k in range(len(lists))))).alias("x")).select("x.*")


def entering_leaving(a: DataFrame, b: DataFrame, key: str, rank: str, n: int) -> DataFrame:
    """Members of either top with ``status`` stayed, entered or left."""
    old, new = (d.filter(F.col(rank) <= n).select(key, F.lit(True).alias(m)) for d, m in ((a, "_old"), (b, "_new")))
    status = F.when(F.col("_old") & F.col("_new"), "stayed").when(F.col("_new"), "entered").otherwise("left")
    return old.join(new, key, "full").select(key, status.alias("status"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average-tie ranks over rows where both are known."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = pct_ranks(rows, {x: "_rx", y: "_ry"})
    return both.agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("spearman"))


def rank_comparison(df: DataFrame, key: str, old: str, new: str, n: int) -> DataFrame:
    """Ranks of two scores, the change, and membership of the tops."""
    out = rank_desc(rank_desc(df, old, "old_rank"), new, "new_rank")
    status = F.when((F.col("old_rank") <= n) & (F.col("new_rank") <= n), "stayed").when(F.col("new_rank") <= n, "entered").when(F.col("old_rank") <= n, "left").otherwise("outside")
    return out.select(key, "old_rank", "new_rank", (F.col("old_rank") - F.col("new_rank")).alias("rank_change"), status.alias("status"))


def mann_whitney(df: DataFrame, x: str, group: str, first: str) -> DataFrame:
    """U of the first group, and a z with the correction for ties and continuity. Ranks come from counts of values."""
    rows = df.filter(F.col(x).isNotNull())
    counts = rows.groupBy(x).agg(F.count("*").alias("t"), F.count_if(F.col(group) == first).alias("a"))
    s = running_totals(counts, x, "t").withColumn("mid", F.col("_below") + (F.col("t") + 1) / 2).agg(F.sum("t").cast("double").alias("n"), F.sum("a").cast("double").alias("n1"), F.sum(F.col("a") * F.col("mid")).alias("r1"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n, n1 = F.col("n"), F.col("n1")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    d = u - n1 * n2 / 2
    return s.select(n.cast("long").alias("n"), n1.cast("long").alias("n1"), u.alias("u"), F.try_divide(d - F.signum(d) * 0.5, sd).alias("z"))


def fisher_exact(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """2x2 counts of two conditions, odds ratio and the two-sided exact p: tables no likelier than the observed one."""
    t = df.agg(F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"))
    n11, n10, n01, n00 = (F.col(c) for c in ("n11", "n10", "n01", "n00"))
    row, col, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
    # log k! by Stirling's series, exact to 1e-12 from 10 on, and by a sum below.
    series = lambda k: k * F.log(k) - k + 0.5 * F.log(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * F.pow(k, F.lit(3))) + 1 / (1260 * F.pow(k, F.lit(5)))
    small = lambda k: F.element_at(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(16))), F.least(k, F.lit(15)).cast("int") + 1)
    lf = lambda k: F.when(k < 16, small(k)).otherwise(series(F.greatest(k, F.lit(1)).cast("double")))
    logp = lambda k: lf(row) + lf(n - row) + lf(col) + lf(n - col) - lf(n) - lf(k) - lf(row - k) - lf(col - k) - lf(n - row - col + k)
    low, high = F.greatest(F.lit(0), row + col - n), F.least(row, col)
    each = t.withColumn("k", F.explode(F.sequence(low, high))).withColumn("p", F.exp(logp(F.col("k")))).withColumn("p0", F.exp(logp(n11)))
    p = F.least(F.lit(1.0), F.sum(F.when(F.col("p") <= F.col("p0") * (1 + 1e-7) + 1e-12, F.col("p"))))
    return each.groupBy("n11", "n10", "n01", "n00").agg(p.alias("p_value")).withColumn("odds_ratio", F.try_divide(n11 * n00, (n10 * n01).cast("double")))


def transition_class(old_top: Column, new_top: Column, candidate: Column) -> Column:
    """Eight labels of the way between two tops, for candidates and others."""
    mark = F.when(candidate, "fp").otherwise("nonfp")
    return (
        F.when(old_top & new_top, F.concat(F.lit("old_top_"), mark, F.lit("_retained_top")))
        .when(old_top, F.concat(F.lit("old_top_"), mark, F.lit("_left_top")))
        .when(new_top, F.when(candidate, "entering_top_fp_candidate").otherwise("entering_top_nonfp"))
        .when(candidate, "fp_candidate_outside_top_transition")
        .otherwise("other")
    )


def audit_flags(df: DataFrame, rank: str, completeness: str, gain: str, density: str, density_gain: str, low: float = 0.2, high_gain: float = 0.5, least_density: float = 0.05, top: int = 50) -> DataFrame:
    """Labels of cells whose old hazard may come from missing buildings, joined by semicolons, and the candidate flag."""
    no = lambda c: F.coalesce(c, F.lit(False))
    is_low, is_zero, gained = no(F.col(completeness) <= low), no(F.col(completeness) == 0), no(F.col(gain) >= high_gain)
    candidate = no(F.col(rank) <= top) & is_low & gained & no(F.col(density) >= least_density)
    names = [
        F.when(no(F.col(rank) <= 20), "old_top20_hazard").when(no(F.col(rank) <= 50), "old_top50_hazard"),
        F.when(is_zero, "zero_old_completeness").when(is_low, "low_old_completeness"),
        F.when(gained, "high_coverage_gain"),
        F.when(no(F.col(density_gain) >= 0.10), "large_building_density_gain"),
        F.when(candidate, "possible_false_positive"),
    ]
    return df.withColumns({"candidate": candidate, "audit_flags": F.array_join(F.array_compact(F.array(*names)), ";")})


def density_sanity(df: DataFrame, value: str, thresholds: Sequence[float], metrics: Sequence[str]) -> DataFrame:
    """Rows at or over each threshold, with mean and median of other metrics; a row counts for each threshold it reaches."""
    rows = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col(value) >= F.col("threshold"))
    means = rows.groupBy("threshold").agg(F.count("*").alias("n"), *(F.avg(m).alias(f"mean_{m}") for m in metrics))
    medians = column_quantiles(rows, {f"median_{m}": (m, 0.5) for m in metrics}, ["threshold"])
    return means.join(medians, "threshold", "left").select("threshold", "n", *(x for m in metrics for x in (f"mean_{m}", f"median_{m}")))


def scenario_sweep(areas: DataFrame, cells: DataFrame, scenarios: DataFrame, size: float) -> DataFrame:
    """Areas by type x opacity by scenario, to a shade delta for each cell and its statistics for each scenario."""
    proxy = areas.join(F.broadcast(scenarios), "type").groupBy("cell", "scenario").agg((F.sum(F.col("area") * F.col("opacity")) / (size * size)).alias("proxy"))
    names = scenarios.select("scenario").distinct()
    every = cells.crossJoin(F.broadcast(names)).join(proxy, ["cell", "scenario"], "left")
    shade = 1 - (1 - F.col("shade")) * (1 - clip(F.coalesce("proxy", F.lit(0.0)), 0, 1))
    every = every.select("scenario", (shade - F.col("shade")).alias("d"))
    sums = every.groupBy("scenario").agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), F.max("d").alias("max"), F.count_if(F.col("d") > 0.05).alias("over_005"))
    return sums.join(column_quantiles(every, {"p95": ("d", 0.95)}, ["scenario"]), "scenario", "left").select("scenario", "mean", "std", "max", "p95", "over_005")


def candidate_policy(df: DataFrame, h: str, v: str, e: str, weights: tuple[float, float, float], penalty: float = 0.5, q: float = 0.75) -> DataFrame:
    """Candidates have a hazard at or over a quantile; among them hazard is scaled by its extremes. Others keep a penalised
    hazard. One row of bounds is broadcast."""
    cut = column_quantiles(df, {"_cut": (h, q)})
    marked = df.crossJoin(F.broadcast(cut)).withColumn("candidate", F.coalesce(F.col(h) >= F.col("_cut"), F.lit(False)))
    ends = marked.filter("candidate").agg(F.min(h).alias("_lo"), F.max(h).alias("_hi"))
    scaled = F.coalesce(clip(F.try_divide(F.col(h) - F.col("_lo"), F.col("_hi") - F.col("_lo")), 0, 1), F.lit(0.0))
    wh, wv, we = weights
    score = F.when(F.col("candidate"), wh * scaled + wv * F.col(v) + we * F.col(e)).otherwise(penalty * F.col(h))
    return marked.crossJoin(F.broadcast(ends)).select(*df.columns, "candidate", score.alias("policy_score"))


def interpretation_class(df: DataFrame, rules: Sequence[tuple[str, str]], other: str, out: str = "interpretation") -> DataFrame:
    """Ordered overrides (condition, label): the last one that holds wins."""
    label = F.lit(other)
    for condition, name in rules:
        label = F.when(F.coalesce(F.expr(condition), F.lit(False)), F.lit(name)).otherwise(label)
    return df.withColumn(out, label)


#: Factors on the limits by round; the last round also waives distance and overlap.
RELAX = (1.0, 2.5, 5.0, 999.0)


def greedy_diverse_topk(cands: DataFrame, kind: str, score: str, key: str, k: int, min_dist: float, limits: Mapping[str, float] | None = None, side: float | None = None, max_iou: float = 0.20) -> DataFrame:
    """Up to k candidates of each kind by descending score, kind by kind in order. None is nearer than ``min_dist`` to one
    chosen before, of any kind, nor do their squares of ``side`` overlap by more than ``max_iou``. With ``limits`` (column,
    largest value) the rounds of ``RELAX`` follow each other while fewer than k are found.

    Each choice is the best of all candidates left, in one job; only the chosen rows, k for each kind, reach the driver."""
    chosen: list = []
    for (name,) in sorted(cands.select(kind).distinct().collect(), key=lambda r: (r[0] is not None, r[0])):
        own, taken = cands.filter(F.col(kind).eqNullSafe(F.lit(name))), 0
        for level, relax in enumerate(RELAX if limits else RELAX[:1]):
            fits = own.filter(F.col(key).isNotNull())
            for column, most in (limits or {}).items():
                fits = fits.filter(F.col(column) <= most * relax)
            while taken < k:
                ok = F.lit(True)
                for t in chosen:
                    dx, dy = F.abs(F.col("x") - t["x"]), F.abs(F.col("y") - t["y"])
                    ok = ok & (F.col(key) != t[key])
                    if level < len(RELAX) - 1:
                        ok = ok & (F.hypot(dx, dy) >= min_dist)
                        if side:
                            both = F.greatest(side - dx, F.lit(0.0)) * F.greatest(side - dy, F.lit(0.0))
                            ok = ok & (both / (2 * side * side - both) <= max_iou)
                best = fits.filter(ok).orderBy(F.desc(score), key).limit(1).collect()
                if not best:
                    break
                chosen += best
                taken += 1
    return cands.sparkSession.createDataFrame(chosen, cands.schema)
