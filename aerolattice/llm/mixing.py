"""Mixing sources to target weights by hierarchical budgeting.

The budget of a tree (domain, language, source) flows from the root to the leaves. At each node the children share their
parent's budget by weight; a child that holds fewer tokens than its share (times ``max_epochs``) gives the rest to its
siblings, again by weight, and only what a whole subtree can't take reaches the siblings of its ancestors. A leaf
repeats its documents for the whole epochs its budget allows and takes a token-prefix of the next epoch's seeded order.

The prefix of a leaf isn't found by sorting the leaf. Seeded keys are uniform, so a key range ("bin") holds about
``BIN_ROWS`` rows; sums of bins find the bin where the budget ends, and only the rows of that bin are ordered. The cut
key then decides each row by itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_row, row_columns, stored, text_or_empty

LEVELS = ("domain", "language", "source")
BIN_ROWS = 2000
#: Production parameters: tokens to select as a share of all, and the most epochs of one leaf.
SHARE, MAX_EPOCHS, SEED = 0.6, 2, "mix-1"
# Target weights. Nodes that aren't named get 1, beside their siblings.
WEIGHTS = {"domain": {"web": 0.7, "reference": 0.3}, "language": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "source": {}}


def default_tree() -> dict[str, Column]:
    """Domain by the number in the source's name: below 10 web, else reference; null languages and sources are (none)."""
    number = F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as int)")
    return {
        "domain": F.when(F.coalesce(number, F.lit(0)) < 10, F.lit("web")).otherwise(F.lit("reference")),
        "language": F.coalesce(F.col("lang"), F.lit("(none)")),
        "source": F.coalesce(F.col("source"), F.lit("(none)")),
    }


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def seeded_key(seed: str, epoch: Column) -> Column:
    """A uniform key of 15 hexadecimal digits, of the seed, the epoch and the id."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))), 1, 15)


def _label(level: str) -> Column:
    """A tree label without its struct. Inside, labels are structs of one field, which are equal where both labels are
    null, so that nulls are leaves of their own in joins as in groups."""
    return F.col(level)["label"]


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    named = weights.get(level, {})
    value = F.lit(1.0)
    for name, w in named.items():
        value = F.when(_label(level) == name, F.lit(float(w))).otherwise(value)
    return value


def budgets(leaves: DataFrame, share: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``leaves`` (domain, language, source, tokens) with ``budget``: water-filling at each level, from the root down. A
    null label is a child like others.

    Within a parent the children are ordered by capacity over weight. The first ones that can't take their share of what
    is left are filled to capacity; the others share the rest by weight.
    """
    caps = leaves.withColumns({k: F.struct(F.col(k).alias("label")) for k in LEVELS}).withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    root = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).select(F.floor(F.col("all") * F.lit(share)).cast("double").alias("budget"))
    up: list[str] = []
    level = root
    for name in LEVELS:
        child = caps.groupBy(*up, name).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(name, weights))
        child = child.join(level, up) if up else child.crossJoin(F.broadcast(level))  # the root is one row
        order = Window.partitionBy(*up).orderBy(F.col("cap") / F.col("w"), name) if up else Window.orderBy(F.col("cap") / F.col("w"), name)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
        child = child.withColumn("rate", left / F.sum("w").over(after))
        child = child.withColumn("full", F.col("cap") <= F.col("w") * F.col("rate"))
        every = Window.partitionBy(*up) if up else Window.partitionBy(F.lit(1))
        child = child.withColumn("open_rate", F.max(F.when(~F.col("full"), F.struct(-(F.col("cap") / F.col("w")), F.col("rate").alias("r")))).over(every)["r"])
        share_of = F.when(F.col("full") | F.col("open_rate").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("open_rate")))
        up = [*up, name]
        level = child.select(*up, share_of.alias("budget"))
    return caps.join(level, up).select(*(_label(k).alias(k) for k in up), "tokens", F.floor(F.round("budget", 3)).cast("long").alias("budget"))


def plan_mix(docs: DataFrame, tree: Mapping[str, Column] | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """``(rows, cuts)``: ``rows`` has ``doc_id``, the tree's levels and ``n_tokens``; ``cuts`` has a row for each leaf:
    ``tokens, budget, epochs`` (whole ones) and ``cut``, the last key that the next epoch's prefix takes ('' for none).
    The levels are structs of one field ``label`` here; labels may be null.

    Rows whose seeded keys are equal (repeated ids) are taken or left together. A prefix ends with the last row that
    fits whole, so a leaf takes its budget less one document's tokens at most. Rows without tokens fit anywhere before
    the cut.
    """
    tree = tree or default_tree()
    rows = stored(docs.select("doc_id", *(F.struct(tree[k].alias("label")).alias(k) for k in LEVELS), n_tokens(text_or_empty()).alias("n_tokens")), "mix-rows")
    levels = list(LEVELS)
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    plan = budgets(leaves.select(*(_label(k).alias(k) for k in levels), "tokens"), share, max_epochs, weights)
    plan = plan.withColumns({k: F.struct(F.col(k).alias("label")) for k in levels}).join(leaves.select(*levels, "rows"), levels)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long"))
    plan = stored(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).withColumn("bins", F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(BIN_ROWS)))), "mix-plan")

    key = seeded_key(seed, F.col("epochs"))
    bin_of = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("bins") / F.lit(2**32)).cast("long")
    keyed = rows.join(plan.select(*levels, "epochs", "rest", "bins"), levels).withColumn("key", key).withColumn("bin", bin_of)
    bins = keyed.groupBy(*levels, "bin").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*levels).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("tokens").over(run), F.lit(0)))
    # Whole bins that fit end at their last possible key; the first that doesn't is ordered row by row.
    whole = bins.filter(F.col("before") + F.col("tokens") <= F.col("rest"))
    last = whole.groupBy(*levels).agg(F.max("bin").alias("bin"))
    edge = bins.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest"))).select(*levels, "bin", "before")
    inside = keyed.join(edge, [*levels, "bin"])
    ordered = Window.partitionBy(*levels, "bin").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(ordered)).filter("upto <= rest")
    in_bin = inside.groupBy(*levels).agg(F.max("key").alias("cut"))
    of_whole = keyed.join(last, [*levels, "bin"]).groupBy(*levels).agg(F.max("key").alias("cut"))
    cut = in_bin.unionByName(of_whole).groupBy(*levels).agg(F.max("cut").alias("cut"))
    cuts = plan.join(cut, levels, "left").select(*levels, "tokens", "budget", "epochs", F.coalesce("cut", F.lit("")).alias("cut"))
    return rows, stored(cuts, "mix-cuts")


def copies(seed: str = SEED) -> Column:
    """How often a row is taken: its leaf's whole epochs, and once more before the cut."""
    return F.col("epochs") + (seeded_key(seed, F.col("epochs")) <= F.col("cut")).cast("long")


def mix_report(docs: DataFrame, seed: str = SEED, **plan) -> DataFrame:
    """One row for each input row: ``doc_id, domain, language, source, n_tokens, copies`` (0: not taken).

    Null text counts as empty (no tokens), null language and source as ``(none)``. Empty tables give no rows.
    """
    rows, cuts = plan_mix(docs, seed=seed, **plan)
    return rows.join(cuts, list(LEVELS)).select("doc_id", *(_label(k).alias(k) for k in LEVELS), "n_tokens", copies(seed).alias("copies"))


def mix(docs: DataFrame, tree: Mapping[str, Column] | None = None, seed: str = SEED, **plan) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them; columns unchanged. Texts aren't
    shuffled: a row's leaf and key decide."""
    tree = tree or default_tree()
    _, cuts = plan_mix(docs, tree, seed=seed, **plan)
    rows = docs.select(as_row(docs), "doc_id", *(F.struct(tree[k].alias("label")).alias(k) for k in LEVELS))
    taken = rows.join(cuts.select(*LEVELS, "epochs", "cut"), list(LEVELS)).select("row", copies(seed).alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*row_columns(docs))


def oracle(share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, seed: str = SEED) -> str:
    def weight(level: str) -> str:
        named = weights.get(level, {})
        return f"case {level} {' '.join(f"when '{k}' then {float(v)}" for k, v in named.items())} else 1.0 end::double" if named else "1.0::double"

    parts, up, level = [], [], "root"
    for name in LEVELS:
        keys, by = ", ".join([*up, name]), f"partition by {', '.join(up)}" if up else ""
        ratio = f"cap / w, {name}"
        join = f"join {level} using ({', '.join(up)})" if up else f"cross join {level}"
        parts.append(f"""
{name}_0 as (select *, {weight(name)} as w from (select {keys}, sum(cap)::double as cap from caps group by {keys}) c {join}),
{name}_1 as (select *, (budget - coalesce(sum(cap) over ({by} order by {ratio} rows between unbounded preceding and 1 preceding), 0.0))
    / sum(w) over ({by} order by {ratio} rows between current row and unbounded following) as rate from {name}_0),
{name}_2 as (select *, cap <= w * rate as isfull from {name}_1),
{name}_3 as (select *, first_value(rate) over ({by} order by isfull, {ratio} rows between unbounded preceding and unbounded following) as open_rate from {name}_2),
{name}_b as (select {keys}, case when isfull then cap else least(cap, w * open_rate) end as budget from {name}_3)""")
        up, level = [*up, name], f"{name}_b"
    leaf = ", ".join(LEVELS)
    key = "substr(md5('%s:' || epochs::varchar || ':' || coalesce(doc_id::varchar, '-')), 1, 15)" % seed
    return rf"""
with d as (select doc_id, case when coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as int), 0) < 10 then 'web' else 'reference' end as domain,
    coalesce(lang, '(none)') as language, coalesce(source, '(none)') as source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents),
leaves as (select {leaf}, sum(n_tokens)::bigint as tokens from d group by {leaf}),
caps as (select *, (tokens * {max_epochs})::double as cap from leaves),
root as (select floor(sum(tokens) * {share})::double as budget from leaves),{",".join(parts)},
p as (select {leaf}, tokens, floor(round(budget, 3))::bigint as budget from caps c join (select {leaf}, budget from source_b) b using ({leaf})),
q as (select *, case when tokens > 0 then budget // tokens else 0 end as epochs from p),
k as (select d.doc_id, {leaf}, d.n_tokens, epochs, budget - epochs * tokens as rest, {key} as key from d join q using ({leaf})),
r as (select *, sum(n_tokens) over (partition by {leaf} order by key range between unbounded preceding and current row) as upto from k)
select doc_id, {leaf}, n_tokens, (epochs + (upto <= rest)::bigint)::bigint as copies from r
"""
