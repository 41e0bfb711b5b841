"""Exact de-duplication by salted combining of content digests.

Texts are equal when they agree after all white space is deleted. Work is split so that one group of copies may hold
any share of the rows:

1. a first pass leaves a slim row (digest, id, length) for each document; digests that occur once are final. A bitmap of
   the ids of the others, of bounded size, keeps the texts of single documents out of all shuffles;
2. the texts of repeated digests are combined locally, by full content, in the tasks that read them (Spark's partial
   aggregation: a task sends on one text for each content), and merged in salted groups ``(digest, salt, content)``. The
   number of salts grows with a digest's rows;
3. the salt winners are combined globally, again by full content.

Digests only route rows. Two texts are called equal because their contents are equal, at each stage: where one digest
had two contents, its rows are matched with their contents by the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_row, hot_keys, marked_by, row_columns, salted, stored, text_or_empty


def digest(body: Column) -> Column:
    return F.sha2(body, 256)


def squeezed(text: Column) -> Column:
    """The text without blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.translate(text, " \t\n\x0b\f\r", "")


def _place(n: str, doc: str, kind: str) -> Column:
    """What is least for the longest text and, among these, for the smallest id; a null id comes last. One number for ids
    that are whole numbers, so that rows are combined by hash."""
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct((-F.col(n)).alias("n"), F.col(doc).isNull().alias("none"), F.col(doc).alias("id"))
    own = F.coalesce(F.col(doc).cast("decimal(20,0)"), F.expr("9223372036854775808BD"))
    return (own - F.col(n).cast("decimal(10,0)") * F.expr("36893488147419103232BD")).cast("decimal(38,0)")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 1) -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty; empty texts are equal to each other. Of equal texts the one with the most code points
    stays, then the smallest id (null last); ids may have any type that has an order. Rows repeated with one id count in ``group_size``, and one of them is kept.
    ``salts`` is the number of salts of digests that aren't hot. Other columns of the input are ignored, whatever their
    names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    rows = rows.select("doc_id", F.length("t").cast("long").alias("n"), squeezed(F.col("t")).alias("body"))
    slim = stored(rows.select("doc_id", digest(F.col("body")).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")
    many = stored(slim.groupBy("text_sha256").agg(F.count("*").alias("rows")).filter("rows > 1"), "repeated-digests")
    hot = stored(hot_keys(many, "text_sha256", slim.count()), "hot-digests")

    # Rows of hot digests are repeated ones; the others look their digest up.
    named = slim.join(F.broadcast(hot), "text_sha256", "left")
    cold = named.filter("_salts is null").join(many, "text_sha256", "left").withColumn("repeated", F.col("rows").isNotNull()).drop("rows")
    named = stored(cold.unionByName(named.filter("_salts is not null").withColumn("repeated", F.lit(True))), "named-digests")
    repeated = named.filter("repeated")

    copies = marked_by(rows, "doc_id", repeated.select("doc_id")).filter("_maybe")
    copies = salted(copies.select("doc_id", "body", digest(F.col("body")).alias("text_sha256"), _place("n", "doc_id", dict(rows.dtypes)["doc_id"]).alias("place")), "text_sha256", "doc_id", hot, salts)
    local = copies.groupBy("text_sha256", "_salt", "body").agg(F.count("*").alias("rows"), F.min("place").alias("place"), F.min_by("doc_id", "place").alias("keep_id"))
    whole = local.groupBy("text_sha256", "body").agg(F.sum("rows").alias("group_size"), F.min_by("keep_id", "place").alias("keep_id"))
    verdict = stored(whole.groupBy("text_sha256").agg(F.count("*").alias("contents"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")), "verdicts")

    single = verdict.filter("contents = 1").drop("contents")
    of_hot = single.join(F.broadcast(hot), "text_sha256", "left_semi")  # no more than there are hot digests
    found = repeated.filter("_salts is null").join(single, "text_sha256").unionByName(repeated.filter("_salts is not null").join(F.broadcast(of_hot), "text_sha256"))
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("text_sha256").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("kept"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = found.join(first, "row", "left").withColumn("kept", F.coalesce("kept", F.lit(False))).select(columns)
    alone = named.filter("not repeated").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    out = alone.unionByName(found)
    clashing = verdict.filter("contents > 1").select("text_sha256")
    if clashing.limit(1).count():
        texts = copies.join(clashing, "text_sha256", "left_semi").select("doc_id", "body", "text_sha256").join(whole, ["text_sha256", "body"])
        twin = F.row_number().over(Window.partitionBy("text_sha256", "body", "doc_id").orderBy("group_size"))
        out = out.unionByName(texts.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (twin == 1)).select(columns))
    return out


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text equals that of a row that stays; columns unchanged. Ids are taken as keys:
    rows repeated with one id and one text leave one of them. Only rows whose id may be that of a dropped row are
    shuffled; the others stay where they are."""
    groups = stored(exact_groups(docs).select("doc_id", "text_sha256", "kept"), "exact-groups")
    gone = stored(groups.filter("not kept").select("doc_id").distinct(), "dropped-ids")
    key = lambda sha: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), sha)
    stay = groups.filter("kept").select("doc_id", key(F.col("text_sha256")).alias("row_key"))
    stay = marked_by(stay, "doc_id", gone).filter("_maybe").select("row_key")
    marked = marked_by(docs.select(as_row(docs), "doc_id", text_or_empty().alias("text")), "doc_id", gone)
    maybe = marked.filter("_maybe").select("row", key(digest(squeezed(F.col("text")))).alias("row_key"))
    maybe = maybe.join(stay, "row_key").dropDuplicates(["row_key"])
    return marked.filter("not _maybe").select("row").union(maybe.select("row")).select(*row_columns(docs))


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents)
select doc_id,
       first_value(doc_id) over (partition by body order by length(t) desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
       count(*) over (partition by body) as group_size,
       row_number() over (partition by body order by length(t) desc, doc_id) = 1 as kept,
       sha256(body) as text_sha256
from t
"""
