"""Secret scan in DataFrame functions: three fixed patterns, and a battery of randomness tests for all other tokens.

A candidate is a run of 20 or more characters of ``[A-Za-z0-9+/_-]``. Its encoding is inferred from its characters. The
battery holds a token against ordinary writing in that encoding:

- chi-squared uniformity over the alphabet, as the number of equal pairs of letters: ordinary writing repeats letters;
- runs of character classes (lower, upper, digits, others): ordinary writing stays within a class;
- lag-1 serial correlation of the places in the alphabet: sequences and repeated patterns are correlated by ``CORRELATION``
  and more; Fisher's transform of a coefficient is normal around that of the true one, with a deviation of 1 / sqrt(n - 3).

The first two p-values are joined by Fisher's method, and the largest of that and the third is the token's one p-value: a
secret must look random in every respect. Parts of the battery aren't quite independent, so that value is multiplied by
``MARGIN``: on ordinary tokens made of words, paths, dates and counters, values as small are then no more frequent than they
say (a test measures that). These p-values, of all tokens tested, go through Benjamini-Hochberg control over
the whole corpus, within strata of length, because short tokens carry little evidence and must not share the error budget
of long ones. Counts of p-value bins carry the control, so nothing is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty

# The kinds in their order, their patterns, the group whose length counts, and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]{14,}", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16)]
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Runs that an access, hex or random span must lie in; one pass over a text finds them, and the rest looks at them.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Rates of equal pairs in ordinary writing, by the size of the alphabet; of changes of class; false-discovery rate; upper
#: ends of the strata.
COINCIDENCE, CHANGE, RATE, STRATA = {16: 0.12, 32: 0.08, 64: 0.065}, 0.25, 0.01, (28, 40, 64)
CORRELATION, MARGIN = 0.8, 2.5
CLASS_RUN = "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"
LEAST = 20
#: Bins of -log10(p): ten for each power of ten, up to 10^-30.
BINS = 300
SPAN = "array<struct<kind:int,start:int,end:int>>"


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches. Spark gives matches without places; the texts between them
    (``split`` walks the same matches) give these."""
    found, value, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    parts = F.arrays_zip(F.transform(F.slice(between, 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("len"), F.transform(value, F.length).alias("own"))
    empty = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<kind:int,start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        here = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["len"]).alias("end")))
        return F.struct((start + x["len"]).alias("at"), F.when(x["own"] >= least, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, empty, step, lambda acc: acc["out"])


def _where(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.lit([]).cast(SPAN))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9]+$"), F.lit(None).cast("string"))
        .when(token.rlike("^[0-9a-f]+$"), "hex")
        .when(token.rlike("^[0-9A-F]+$"), "upper_hex")
        .when(token.rlike("^[A-Z2-7]+$") & token.rlike("[2-7]"), "base32")
        .when(token.rlike("^[A-Za-z0-9+/]+$"), "base64")
        .when(token.rlike("^[A-Za-z0-9_-]+$"), "base64url")
    )


def battery(token: Column, alphabet: Column) -> Column:
    """-log10 of the token's p-value. Tails of normal and binomial deviates are bounded from above (``exp(-z * z / 2) / 2``
    and Chernoff's bound), so the p-values err on the safe side."""
    n = F.length(token).cast("double")
    size = F.length(alphabet)
    kappa = F.element_at(F.create_map(*(F.lit(x) for pair in COINCIDENCE.items() for x in pair)), size)
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    squares = _sum(F.transform(F.array_distinct(letters), lambda c: F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), 2)))
    pairs = n * (n - 1) / 2
    z = ((squares - n) / 2 - pairs * kappa) / F.sqrt(pairs * kappa * (1 - kappa))
    ln_chi = F.when(z < 0, -z * z / 2 - math.log(2)).otherwise(F.lit(0.0))
    share = (F.regexp_count(token, F.lit(CLASS_RUN)) - 1) / (n - 1)
    part = lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(F.lit(0.0))
    ln_runs = F.when(share > CHANGE, -(n - 1) * (part(share, F.lit(CHANGE)) + part(1 - share, F.lit(1 - CHANGE)))).otherwise(F.lit(0.0))
    ln_both = ln_chi + ln_runs
    ln_fisher = ln_both + F.ln(1 - ln_both)
    values = F.transform(letters, lambda c: F.instr(alphabet, c).cast("double"))

    def serial(v: Column) -> Column:
        mean = _sum(v) / n
        spread = _sum(F.transform(v, lambda x: (x - mean) * (x - mean)))
        along = _sum(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: (a - mean) * (b - mean)))
        r = F.least(F.abs(F.coalesce(F.try_divide(along, spread), F.lit(1.0))), F.lit(0.999999))
        z = (math.atanh(CORRELATION) - F.atanh(r)) * F.sqrt(n - 3)
        return F.when(z > 0, -z * z / 2 - math.log(2)).otherwise(F.lit(0.0))

    ln_serial = F.aggregate(F.array(values), F.lit(0.0), lambda _, v: serial(v))
    return F.greatest(-(F.greatest(ln_fisher, ln_serial) + math.log(MARGIN)) / math.log(10), F.lit(0.0))


def tested(token: Column) -> Column:
    """``struct(stratum, bin)`` of a token; null where no encoding is inferred."""
    alphabets = F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair))
    name = encoding(token)
    score = F.least(F.floor(battery(token, F.element_at(alphabets, name)) * 10), F.lit(BINS)).cast("int")
    return F.when(name.isNotNull(), F.struct(_stratum(F.length(token)).alias("stratum"), score.alias("bin")))


def base_spans(text: Column, runs: Column) -> Column:
    """The spans of the fixed kinds. Each pattern runs only over texts that hold what it needs."""
    needs = [
        (text.contains("=") | text.contains(":")) & text.rlike(ASSIGN),
        F.exists(runs, lambda t: t.rlike(KINDS[1][1])),
        F.exists(runs, lambda t: t.rlike(KINDS[2][1])),
    ]
    return F.concat(*(_where(need, _spans(text, k, pattern, group, least)) for k, (need, (_, pattern, group, least)) in enumerate(zip(needs, KINDS))))


def _stratum(n: Column) -> Column:
    out = F.lit(len(STRATA))
    for k in reversed(range(len(STRATA))):
        out = F.when(n < STRATA[k], k).otherwise(out)
    return out


def discoveries(tests: DataFrame, rate: float) -> DataFrame:
    """Benjamini-Hochberg for each stratum from counts of evidence bins: ``tests`` (stratum, bin) to (stratum, cut), the
    least bin that is discovered. A bin's p-value is that of its weakest member. At most strata x bins rows."""
    counts = tests.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    counts = counts.withColumn("rank", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    return counts.filter(F.pow(F.lit(10.0), -F.col("bin") / 10) <= rate * F.col("rank") / F.col("all")).groupBy("stratum").agg(F.min("bin").alias("cut"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row for each input row: ``doc_id, spans, n_random``; ``spans`` is an array of (kind, start, end), ordered by
    start and kind: 0 assign, 1 access, 2 hex, 3 random. Places are code points, ends exclusive.

    Null text counts as empty. All tokens with an inferred encoding are tested and counted by the control, repeated rows
    as often as they occur; discovered tokens that overlap a span of the fixed kinds are left out. An empty table gives no
    rows; other columns are ignored.
    """
    text, runs = F.col("_text"), F.col("_runs")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    rows = rows.withColumn("_runs", F.regexp_extract_all("_text", F.lit(RUN), F.lit(0)))
    rows = rows.select("doc_id", "_text", base_spans(text, runs).alias("base"), F.transform(F.filter(runs, lambda t: F.length(t) >= LEAST), tested).alias("tests"))
    # No p-value above the rate is ever discovered, so places are worked out only where one is at most the rate.
    weakest = math.floor(-10 * math.log10(rate))
    likely = lambda t: F.coalesce(t["bin"] >= weakest, F.lit(False))
    placed = F.arrays_zip(_where(F.exists("tests", likely), _spans(text, 3, RANDOM, 0, LEAST)).alias("span"), F.col("tests").alias("test"))
    free = F.filter(placed, lambda t: likely(t["test"]) & t["span"].isNotNull() & ~F.exists("base", lambda b: (b["start"] < t["span"]["end"]) & (t["span"]["start"] < b["end"])))
    rows = stored(rows.select("doc_id", "base", F.filter("tests", lambda t: t.isNotNull()).alias("tests"), free.alias("tokens")), "secrets")
    cuts = discoveries(rows.select(F.explode("tests").alias("t")).select("t.stratum", "t.bin"), rate)
    # One row: a cut for each of the few strata.
    cuts = cuts.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "cut"))).alias("cuts"))
    kept = F.transform(F.filter("tokens", lambda t: t["test"]["bin"] >= F.coalesce(F.try_element_at("cuts", t["test"]["stratum"]), F.lit(BINS + 1))), lambda t: t["span"])
    rows = rows.crossJoin(F.broadcast(cuts)).withColumn("random", kept)
    spans = F.array_sort(F.transform(F.concat("base", "random"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return rows.select("doc_id", F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])).cast(SPAN).alias("spans"), F.size("random").cast("long").alias("n_random"))


def span_line(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, *_ in KINDS), F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from ``scan_secrets``."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scan_secrets(docs).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_line(base), 256).alias("base_sha256"), span_line(F.col("spans")).alias("spans"), "n_random")
