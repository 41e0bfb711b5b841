"""Column and table utilities: tolerant schemas, unions, upserts, corrections."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def first_present(df: DataFrame, candidates: Sequence[str], override: str | None = None) -> str | None:
    """The first candidate that is a column, whatever its case and punctuation; None if there is none."""
    have = {_plain(c): c for c in reversed(df.columns)}
    return next((have[_plain(c)] for c in ([override] if override else []) + list(candidates) if _plain(c) in have), None)


def ensure_columns(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Adds missing columns, and puts the named ones first in their order."""
    out = df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})
    return out.select(*defaults, *(c for c in df.columns if c not in defaults))


def alias_columns(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Copies a column under its other name, in either direction, where one is missing."""
    new = {}
    for a, b in pairs.items():
        if a in df.columns and b not in df.columns:
            new[b] = F.col(a)
        elif b in df.columns and a not in df.columns:
            new[a] = F.col(b)
    return df.withColumns(new) if new else df


def dedupe_column_names(df: DataFrame) -> DataFrame:
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"{c}__dup{seen[c] - 1}")
    return df.toDF(*names)


def preserve_and_replace(df: DataFrame, col: str, new: str, backup: str) -> DataFrame:
    """Keeps the old value as ``backup``, takes the new one where it is known, and says which, and by how much."""
    return df.withColumns({backup: F.col(col), f"{col}_source": F.when(F.col(new).isNotNull(), "new").otherwise("old"), f"{col}_delta": F.col(new) - F.col(col)}).withColumn(col, F.coalesce(new, backup))


def wbgt_only(df: DataFrame, value: str = "official_wbgt_c") -> DataFrame:
    """WBGT rows with coordinates, from a long table (``variable``, ``value``) or a wide one."""
    if {"variable", "value"} <= set(df.columns) and value not in df.columns:
        df = df.filter(F.col("variable") == value).withColumnRenamed("value", value)
    return df.na.drop(subset=[c for c in (value, "station_lat", "station_lon") if c in df.columns])


def union_evolving(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def upsert_keep_last(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of both, the last of each key by ``order``; at equal order the new one."""
    both = union_evolving([old.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1))])
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_new")


def rows_added(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.select(*keys).distinct().join(old.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("rows_added"))


def migrate_legacy(dfs: Sequence[DataFrame], candidates: Sequence[str], order: str) -> DataFrame:
    """Union of legacy and current tables; the key is those of the candidates that all tables have."""
    keys = [c for c in candidates if all(c in d.columns for d in dfs)]
    both = union_evolving([d.withColumn("_at", F.lit(k)) for k, d in enumerate(dfs)])
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_at"))
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_at")


def pivot_wide(long: DataFrame, keys: Sequence[str], variable: str, value: str, order: str, names: Sequence[str]) -> DataFrame:
    """Long to wide: the last value of each variable. Rows without a key are dropped."""
    rows = long.na.drop(subset=list(keys))
    return rows.groupBy(*keys).agg(*(F.max_by(F.when(F.col(variable) == n, F.col(value)), F.when((F.col(variable) == n) & F.col(value).isNotNull(), F.struct(order, value))).alias(n) for n in names))


def apply_corrections(df: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Buildings after a change table (``target_id, decision, height``), and a log of what became of each change:
    height_adjust, remove and move_to_overhead are applied; other decisions are unsupported (``merge_reviewed`` takes
    merge_conflict, split_complex and add_missing)."""
    known = ["height_adjust", "remove", "move_to_overhead"]
    last = decisions.groupBy("target_id").agg(F.max_by(F.struct("decision", "height"), F.struct("decision", "height")).alias("d"))
    joined = df.join(last.select(F.col("target_id").alias(key), F.col("d.decision").alias("_d"), F.col("d.height").alias("_h")), key, "left")
    kept = joined.filter(F.coalesce(~F.col("_d").isin("remove", "move_to_overhead"), F.lit(True)))
    out = kept.withColumn("height_m", F.when(F.col("_d") == "height_adjust", F.coalesce("_h", "height_m")).otherwise(F.col("height_m"))).select(*df.columns)
    ids = df.select(F.col(key).alias("target_id"), F.lit(True).alias("_found")).distinct()
    status = F.when(~F.col("decision").isin(known), "unsupported").when(F.col("_found"), "applied").otherwise("not_found")
    return out, decisions.join(ids, "target_id", "left").select(*decisions.columns, status.alias("status"))


def merge_reviewed(df: DataFrame, decisions: DataFrame, key: str, conflicts: DataFrame, pieces: DataFrame, missing: DataFrame, default: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Buildings (``key``, ``height_m`` and others) after the decisions that bring in footprints, and their log:

    - merge_conflict: the conflicting footprint of that id, kept apart until now, is accepted;
    - split_complex: the building gives way to the pieces drawn for it (``parent_id``); without pieces it stays;
    - add_missing: all drawn footprints that have no id yet in the table (no decision row is needed).

    Heights come from the decision, then from the footprint, then ``default``; ``height_m`` is positive."""
    of = lambda name: decisions.filter(F.col("decision") == name).groupBy("target_id").agg(F.max("height").alias("_h"))
    tall = lambda *c: F.coalesce(*(F.when(F.col(x) > 0, F.col(x)) for x in c), F.lit(default))
    source = lambda frame, name: frame.withColumn("change", F.lit(name))
    merged = conflicts.join(of("merge_conflict").withColumnRenamed("target_id", key), key).withColumn("height_m", tall("_h", "height_m")).drop("_h")
    wanted = of("split_complex").join(df.select(F.col(key).alias("target_id")), "target_id", "left_semi")
    drawn = pieces.join(wanted.withColumnRenamed("target_id", "parent_id"), "parent_id").withColumn("height_m", tall("height_m", "_h")).drop("_h")
    split = drawn.select(F.col("parent_id").alias(key)).distinct()
    added = missing.join(df.select(key), key, "left_anti").withColumn("height_m", tall("height_m"))
    kept = df.join(split, key, "left_anti")
    out = union_evolving([source(kept, "kept"), source(merged, "merge_conflict"), source(drawn.drop("parent_id"), "split_complex"), source(added, "add_missing")])
    done = union_evolving([merged.select(F.lit("merge_conflict").alias("decision"), F.col(key).alias("target_id")), split.select(F.lit("split_complex").alias("decision"), F.col(key).alias("target_id"))])
    log = decisions.filter(F.col("decision").isin("merge_conflict", "split_complex")).join(done.withColumn("_done", F.lit(True)), ["decision", "target_id"], "left")
    return out, log.select(*decisions.columns, F.when(F.col("_done"), "applied").otherwise("not_found").alias("status"))


def qa_priority(df: DataFrame, category: str, area: str, rank: str, key: str, weights: Sequence[tuple[str, float]], cap: int) -> DataFrame:
    """An additive score from category patterns, area and rank; the ``cap`` best, ties by key."""
    score = sum((F.when(F.col(category).rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in weights), F.lit(0.0))
    score = score + F.least(F.col(area) / 1000.0, F.lit(3.0)) + F.when(F.col(rank) <= 20, F.lit(2.0)).otherwise(F.lit(0.0))
    return df.withColumn("priority", score).orderBy(F.desc("priority"), key).limit(cap)


def qa_targets(parts: Mapping[str, DataFrame], key: str, score: Column, caps: Mapping[str, int]) -> DataFrame:
    """Targets of review: each part is the rows that one category's rule selects. An id that several rules select is one
    target with all its categories, in order, joined by ``;``. Each target type (column ``target_type``) gives its best
    ``caps`` rows by ``score``, ties by id. The caps are the report's size, as its users ask for."""
    rows = union_evolving([df.withColumn("category", F.lit(name)) for name, df in parts.items()])
    rest = [c for c in rows.columns if c not in (key, "target_type", "category")]
    one = rows.groupBy("target_type", key).agg(F.array_join(F.array_sort(F.collect_set("category")), ";").alias("category"), *(F.first(c, ignorenulls=True).alias(c) for c in rest))
    best = one.withColumn("priority", score).withColumn("_k", F.row_number().over(Window.partitionBy("target_type").orderBy(F.desc("priority"), key)))
    cap = F.create_map(*(F.lit(x) for pair in caps.items() for x in pair))
    return best.filter(F.col("_k") <= F.coalesce(cap[F.col("target_type")], F.lit(0))).drop("_k")


def standardise_sources(sources: Mapping[str, tuple[DataFrame, Mapping[str, Column], int]]) -> DataFrame:
    """Buildings of several sources in one schema: each source gives a frame, its columns, and its priority; raw
    properties are kept as JSON."""
    parts = []
    for name, (df, columns, priority) in sources.items():
        raw = F.to_json(F.struct(*(F.col(c) for c in df.columns)))
        parts.append(df.select(*(v.alias(k) for k, v in columns.items()), F.lit(name).alias("source_name"), F.lit(priority).alias("source_priority"), raw.alias("raw")))
    return union_evolving(parts)
