"""Calibration of a proxy under left-out folds. Models are sums; a left-out fit is the total less the fold's own sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, stored
from .windows import running_totals


def fit_linear(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Ordinary least squares with errors before and after; ``intercept`` and ``slope`` are null for fewer than 3 rows."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    enough = F.count("*") >= 3
    fit = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.when(enough, F.regr_slope(y, x)).alias("slope"),
        F.when(enough, F.regr_intercept(y, x)).alias("intercept"),
        F.sqrt(F.avg(F.pow(F.col(y) - F.col(x), 2))).alias("rmse_before"),
        F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_vx"),
    )
    after = F.sqrt(F.greatest(F.col("_vy") - F.try_divide(F.col("_c") * F.col("_c"), F.col("_vx")), F.lit(0.0)))
    return fit.withColumn("rmse_after", F.when(F.col("n") >= 3, after)).drop("_vy", "_c", "_vx")


def apply_linear(df: DataFrame, model: DataFrame, x: str, out: str = "prediction") -> DataFrame:
    """``model`` is one row with intercept and slope."""
    return df.crossJoin(F.broadcast(model.select("intercept", "slope"))).withColumn(out, F.col("intercept") + F.col("slope") * F.col(x)).drop("intercept", "slope")


def folds_loso(df: DataFrame, station: str) -> DataFrame:
    return df.withColumn("fold", F.col(station))


def folds_time_block(df: DataFrame, day: str, k: int) -> DataFrame:
    from .windows import time_blocks

    return time_blocks(df, day, k, "block").withColumn("fold", F.concat(F.lit("block_"), F.col("block").cast("string"))).drop("block")


def folds_group_k(df: DataFrame, group: str, k: int) -> DataFrame:
    """Groups dealt to k folds by descending size, back and forth, which keeps the folds' rows near each other."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.orderBy(F.desc("_n"), group)) - 1
    turn, spot = F.floor(place / k), F.pmod(place, F.lit(k))
    dealt = sizes.select(group, F.when(turn % 2 == 0, spot).otherwise(k - 1 - spot).cast("int").alias("fold"))
    return df.join(dealt, group)


def _left_out(df: DataFrame, terms: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Sums of ``terms`` over all rows (of a group) outside each fold. Groups and folds are few; rows aren't windowed."""
    sums = df.groupBy(*by, "fold").agg(*(F.sum(v).alias(k) for k, v in terms.items()))
    w = Window.partitionBy(*by)
    return sums.select(*by, "fold", *((F.sum(k).over(w) - F.col(k)).alias(k) for k in terms))


def oof_bias(df: DataFrame, proxy: str, obs: str, period: str) -> DataFrame:
    """Adds ``m0`` (proxy), ``m1`` (plus the mean residual outside the fold) and ``m1b`` (that of the row's period; the
    global one where the period has no row outside)."""
    r = F.col(obs) - F.col(proxy)
    terms = {"s": r, "c": r.isNotNull().cast("long")}
    whole = _left_out(df, terms).select("fold", F.try_divide("s", "c").alias("_m1"))
    part = _left_out(df, terms, [period]).select(period, "fold", F.try_divide("s", "c").alias("_m1b"))
    joined = df.join(whole, "fold").join(part, [period, "fold"], "left")
    return joined.select(*df.columns, F.col(proxy).alias("m0"), (F.col(proxy) + F.col("_m1")).alias("m1"), (F.col(proxy) + F.coalesce("_m1b", "_m1")).alias("m1b"))


def oof_linear(df: DataFrame, proxy: str, obs: str) -> DataFrame:
    """Adds ``m2``: the least-squares line outside the fold."""
    x, y = F.col(proxy), F.col(obs)
    ok = x.isNotNull() & y.isNotNull()
    only = lambda c: F.when(ok, c)
    s = _left_out(df, {"n": ok.cast("long"), "sx": only(x), "sy": only(y), "sxx": only(x * x), "sxy": only(x * y)})
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    s = s.select("fold", slope.alias("_b"), F.try_divide(F.col("sy") - slope * F.col("sx"), F.col("n")).alias("_a"))
    return df.join(s, "fold").select(*df.columns, (F.col("_a") + F.col("_b") * x).alias("m2"))


def left_out_medians(df: DataFrame, fold: str, cols: Sequence[str]) -> DataFrame:
    """``fold`` and ``_med_<col>``: the median of each column over the rows of all other folds; null where these have no
    value. No row is copied for other folds.

    In ascending order, with a fold's own copies of a value before the others', the r-th value outside the fold lies at the
    place r plus the number of own values before it. An own value comes before it if at most r values outside are less than
    it, which the counts of all values below it and of own values below it tell. Places are then looked up by blocks."""
    block = 4096
    long = df.select(fold, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols))).alias("x")).select(fold, "x.column", "x.v").filter("v is not null")
    own = long.groupBy("column", fold, "v").agg(F.count("*").alias("n"))
    own = stored(running_totals(own, "v", "n", ["column", fold]).withColumnsRenamed({"_below": "own_below", "_total": "own_total"}), "fold-values")
    every = own.groupBy("column", "v").agg(F.sum("n").alias("n"))
    every = stored(running_totals(every, "v", "n", ["column"]), "all-values")
    folds = df.select(fold).distinct().withColumn("column", F.explode(F.array(*map(F.lit, cols))))
    sizes = own.groupBy("column", fold).agg(F.max("own_total").alias("own_total"))
    sizes = folds.join(sizes, ["column", fold], "left").join(every.groupBy("column").agg(F.max("_total").alias("total")), "column")
    sizes = sizes.select("column", fold, (F.col("total") - F.coalesce("own_total", F.lit(0))).alias("rest")).filter("rest > 0")
    ranks = sizes.select("column", fold, F.explode(F.array(F.floor((F.col("rest") - 1) / 2), F.floor(F.col("rest") / 2))).alias("r"))
    less = own.join(every.select("column", "v", "_below"), ["column", "v"]).select("column", fold, "n", (F.col("_below") - F.col("own_below")).alias("outside"))
    before = ranks.distinct().join(less, ["column", fold]).filter("outside <= r").groupBy("column", fold, "r").agg(F.sum("n").alias("before"))
    places = ranks.join(before, ["column", fold, "r"], "left").select("column", fold, (F.col("r") + F.coalesce("before", F.lit(0))).alias("place")).withColumn("block", F.floor(F.col("place") / block))
    blocks = every.withColumn("block", F.explode(F.sequence(F.floor(F.col("_below") / block), F.floor((F.col("_below") + F.col("n") - 1) / block))))
    found = places.join(blocks, ["column", "block"]).filter("_below <= place and place < _below + n")
    medians = found.groupBy(fold, "column").agg(F.avg("v").alias("med"))
    return medians.groupBy(fold).agg(*(F.max(F.when(F.col("column") == c, F.col("med"))).alias(f"_med_{c}") for c in cols))


def oof_ridge(df: DataFrame, features: Sequence[str], obs: str, alpha: float = 1.0, out: str = "ridge") -> DataFrame:
    """Adds a ridge prediction from the other folds: features filled by their medians there, dropped where they are
    missing throughout, standardised (population deviation), intercept unpenalised; ``<out>_features`` names those used.

    Nothing is expanded by folds. A fold's sums are taken of the known values, of marks of the missing ones and of products
    of these; the sums outside it are all less its own, and the medians fill in afterwards, as products with the marks. What
    is solved is one Gram matrix of the features for each fold.
    """
    ship_package(df.sparkSession)
    names = list(features)
    rows = df.filter(F.col(obs).isNotNull())
    medians = left_out_medians(rows, "fold", names)
    z = {"one": F.lit(1.0), "_y": F.col(obs).cast("double")} | {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in names} | {f"no_{f}": F.col(f).isNull().cast("double") for f in names}
    pairs = [(a, b) for i, a in enumerate(z) for b in list(z)[i:]]
    gram = _left_out(rows, {f"g{k}": z[a] * z[b] for k, (a, b) in enumerate(pairs)})
    z_names = list(z)
    gram = gram.filter("g0 > 0").join(medians, "fold", "left")

    def solve(frames):
        import pandas as pd

        d, at = len(names), {a: i for i, a in enumerate(z_names)}
        places = [(at[a], at[b]) for a, b in pairs]
        for frame in frames:
            out_rows = []
            for r in frame.to_dict("records"):
                m = np.zeros((2 * d + 2, 2 * d + 2))
                for k, (i, j) in enumerate(places):
                    m[i, j] = m[j, i] = r[f"g{k}"]
                med = [0.0 if r[f"_med_{f}"] is None or r[f"_med_{f}"] != r[f"_med_{f}"] else r[f"_med_{f}"] for f in names]
                # From one, y, values and marks to one, filled values and y.
                fill = np.zeros((d + 2, 2 * d + 2))
                fill[0, 0] = fill[d + 1, 1] = 1
                for k in range(d):
                    fill[1 + k, 2 + k], fill[1 + k, 2 + d + k] = 1, med[k]
                m = fill @ m @ fill.T
                n = m[0, 0]
                mean = m[0, 1:] / n
                g = m[1:, 1:] / n - np.outer(mean, mean)
                use = [k for k in range(d) if r[f"_med_{names[k]}"] == r[f"_med_{names[k]}"] and r[f"_med_{names[k]}"] is not None]
                scale = np.sqrt(np.maximum(np.diag(g)[:d], 0))
                scale[scale == 0] = 1.0
                a = g[np.ix_(use, use)] / np.outer(scale[use], scale[use]) * n + alpha * np.eye(len(use))
                w = np.zeros(d)
                if use:
                    w[use] = np.linalg.solve(a, g[use, d] / scale[use] * n) / scale[use]
                out_rows.append((r["fold"], float(mean[d] - w @ mean[:d]), w.tolist(), med, [names[k] for k in use]))
            yield pd.DataFrame(out_rows, columns=["fold", "b0", "w", "med", "used"])

    kind = dict(df.dtypes)["fold"]
    models = gram.mapInPandas(solve, f"fold {kind}, b0 double, w array<double>, med array<double>, used array<string>")
    score = F.col("b0")
    for k, f in enumerate(names):
        score = score + F.col("w")[k] * F.coalesce(F.col(f), F.col("med")[k])
    return df.join(models, "fold", "left").select(*df.columns, score.alias(out), F.array_join("used", ",").alias(f"{out}_features"))


def model_ladder(df: DataFrame, models: Sequence[str], obs: str) -> DataFrame:
    """Out-of-fold predictions in long form: a row for each row and model."""
    keep = [c for c in df.columns if c not in models]
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in models))).alias("x")).select(*keep, "x.model", "x.prediction", (F.col(obs) - F.col("x.prediction")).alias("residual_obs_minus_pred"))


def slope_diagnostics(model: DataFrame) -> DataFrame:
    s = F.col("slope")
    return model.withColumn("slope_flag", F.when(s > 2, "unstable").when(s > 1.5, "steep").when(s.isNull(), "missing").otherwise("ok"))


def fold_delta(long: DataFrame, a: str, b: str, obs: str) -> DataFrame:
    """MAE of two models for each fold, their difference (b - a), and the rows."""
    e = F.abs(F.col(obs) - F.col("prediction"))
    wide = long.groupBy("fold").agg(F.count_if((F.col("model") == a) & e.isNotNull()).alias("n"), F.avg(F.when(F.col("model") == a, e)).alias("mae_a"), F.avg(F.when(F.col("model") == b, e)).alias("mae_b"))
    return wide.withColumn("delta", F.col("mae_b") - F.col("mae_a"))


def bootstrap_ci(values: DataFrame, value: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """Resamples a column's rows with replacement: mean, 2.5 and 97.5 percentiles, two-sided p (at most 1). Picks are
    md5 digests of seed, iteration and draw, so results repeat in any engine. The values are a fold table, some tens of rows; what is
    sampled is a join of picks with it, and iterations aggregate independently."""
    place = F.row_number().over(Window.orderBy(value)) - 1
    rows = values.filter(F.col(value).isNotNull()).withColumn("k", place.cast("long")).select("k", F.col(value).cast("double").alias("v"))
    size = rows.agg(F.count("*").alias("m"), F.avg("v").alias("mean"))
    draws = values.sparkSession.range(n).withColumnRenamed("id", "iter").crossJoin(F.broadcast(size)).filter("m > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("m"))))
    picks = draws.withColumn("k", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("iter").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long"), F.col("m")))
    means = picks.join(F.broadcast(rows), "k").groupBy("iter").agg(F.avg("v").alias("mu"))
    q = means.agg(F.percentile("mu", F.lit(0.025)).alias("low"), F.percentile("mu", F.lit(0.975)).alias("high"), F.avg((F.col("mu") <= 0).cast("double")).alias("_le"), F.avg((F.col("mu") >= 0).cast("double")).alias("_ge"))
    return size.crossJoin(q).select(F.col("m").alias("n"), "mean", "low", "high", F.least(F.lit(1.0), 2 * F.least("_le", "_ge")).alias("p"), F.when(F.col("m") < 2, "too few values").alias("note"))


# The five row filters of calibration.
FILTER_MODES = {"all": "true", "retrospective_calibration": "retrospective", "collector_pair_used": "used", "fresh_only": "not migrated", "migrated_only": "migrated"}


def pairing_flags(df: DataFrame, core: Sequence[str], run_id: str, fresh: str) -> DataFrame:
    """``retrospective`` (a match whose core columns are all known) and ``migrated`` (the run isn't named like ``fresh``)."""
    known = F.col("has_match")
    for c in core:
        known = known & F.col(c).isNotNull()
    return df.withColumns({"retrospective": F.coalesce(known, F.lit(False)), "migrated": ~F.coalesce(F.col(run_id).like(fresh), F.lit(False))})


def filter_mode(df: DataFrame, mode: str, excluded: Sequence[str] = (), station: str = "station") -> DataFrame:
    out = df.filter(F.expr(FILTER_MODES[mode]))
    return out.filter(~F.col(station).isin(list(excluded))) if excluded else out


def ablation(df: DataFrame, modes: Sequence[str], pred: Sequence[str], obs: str) -> DataFrame:
    """MAE of each model under each row filter: one pass, a row counts in every mode that keeps it."""
    names = F.array_compact(F.array(*(F.when(F.expr(FILTER_MODES[m]), F.lit(m)) for m in modes)))
    rows = df.withColumn("mode", F.explode(names))
    return rows.groupBy("mode").agg(F.count("*").alias("n"), *(F.avg(F.abs(F.col(obs) - F.col(p))).alias(f"mae_{p}") for p in pred))


def proxy_diagnostic(df: DataFrame, proxies: Sequence[str], obs: str, least: int = 10) -> DataFrame:
    """Bias, MAE and RMSE of each proxy with at least ``least`` rows."""
    long = model_ladder(df, proxies, obs).filter(F.col("residual_obs_minus_pred").isNotNull())
    e = -F.col("residual_obs_minus_pred")
    return long.groupBy(F.col("model").alias("proxy")).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).filter(F.col("n") >= least)


def forest_pipeline(features: Sequence[str], label: str, categorical: Sequence[str] = (), trees: int = 120, seed: int = 0):
    """An unfitted random forest: median imputation, one-hot categories (unknown ones get no one), square-root features,
    leaves of 2. Its predictions are ``pred``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    numbers, kinds = list(features), list(categorical)
    inputs = [f"_{f}" for f in numbers] + [f"_hot_{c}" for c in kinds]
    steps: list = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"_{f}" for f in numbers])] if numbers else []
    if kinds:
        steps += [StringIndexer(inputCols=kinds, outputCols=[f"_index_{c}" for c in kinds], handleInvalid="keep"), OneHotEncoder(inputCols=[f"_index_{c}" for c in kinds], outputCols=[f"_hot_{c}" for c in kinds], dropLast=True)]
    forest = RandomForestRegressor(featuresCol="_x", labelCol=label, predictionCol="pred", numTrees=trees, featureSubsetStrategy="sqrt", minInstancesPerNode=2, seed=seed)
    return Pipeline(stages=[*steps, VectorAssembler(inputCols=inputs, outputCol="_x"), forest])


def forest_rows(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores and stored, for a forest: each step of a fit reads its rows again, and a few files would
    leave the trees to a few tasks."""
    from ..session import stored

    return stored(df.repartition(max(2, 4 * df.sparkSession.sparkContext.defaultParallelism)), "forest-rows")


def random_forest_cv(df: DataFrame, features: Sequence[str], label: str, trees: int = 120, seed: int = 0, categorical: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R² of ``forest_pipeline`` on each held-out fold."""
    from .metrics import skill

    df, out = forest_rows(df), None
    for (fold,) in df.select("fold").distinct().orderBy("fold").collect():  # folds, not rows
        model = forest_pipeline(features, label, categorical, trees, seed).fit(df.filter(F.col("fold") != fold))
        part = model.transform(df.filter(F.col("fold") == fold)).select("fold", label, "pred")
        out = part if out is None else out.unionByName(part)
    return skill(out, "pred", label, ["fold"])


def permutation_importance(df: DataFrame, predict: Column | Callable[[DataFrame], DataFrame], features: Sequence[str], obs: str, repeats: int = 3, seed: int = 0, key: str | None = None) -> DataFrame:
    """Rise of the RMSE when one feature's values are dealt anew over all rows. ``predict`` is a Column over the features,
    or a fitted model's ``transform``, which adds ``pred``. A shuffle joins the rows, by their place in one order, with the
    feature's values by their place in an order of md5 digests; both orders are made in ranges. With a ``key`` of the rows
    the order is that of the seed, the repeat, the feature and the key, whatever the partitions are."""
    from ..session import stored
    from .windows import row_rank

    predicted = predict if callable(predict) and not isinstance(predict, Column) else lambda d: d.withColumn("pred", predict)
    error = F.sqrt(F.avg(F.pow(F.col(obs) - F.col("pred"), 2)))
    rows = stored(df.withColumn("_id", F.col(key) if key else F.monotonically_increasing_id()), "importance-rows")
    base, placed = predicted(df).agg(error.alias("base")), row_rank(rows, [F.col("_id")], "_place")
    out = None
    for f in features:
        for k in range(repeats):
            dealt = row_rank(rows.select("_id", f, F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.lit(f), F.col("_id").cast("string"))).alias("_key")), [F.col("_key"), F.col("_id")], "_place")
            one = predicted(placed.drop(f).join(dealt.select("_place", f), "_place").select(*df.columns)).agg(error.alias("rmse")).select(F.lit(f).alias("feature"), "rmse")
            out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(base)).groupBy("feature").agg(F.avg(F.col("rmse") - F.col("base")).alias("rise"))
