"""Toxicity by a chain of linear classifiers over words.

The categories are predicted in order. Each model sees the document's words and the probabilities that the earlier
models gave. Those probabilities are out of fold while a later model is trained (each fold is scored by a model that
didn't see it), so that it learns how far an earlier model can be trusted.

Features are words and the stems of longer words, so that inflected forms not seen in training count too. They are
chosen by their association with a category over a bounded sample of labelled rows: one must occur more often in the
category than chance allows, at a level that is divided by the number tried. Long documents hold many rare words; without
this choice their weights would drown the few that matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bound of the fit, in labelled rows.
SAMPLE_ROWS = 20_000
FOLDS, RIDGE, LEVEL, THRESHOLD = 5, 0.1, 0.001, 0.5
#: Texts of a slice in scoring, and of one whose features are listed.
SLICE_BYTES, LIST_BYTES = 1_000_000, 250_000
TOKEN = r"[\p{L}\p{M}\p{N}_']+"


#: Lengths of the stems that stand for a longer word's inflected forms, beside the word itself.
STEMS = (4, 5)


class Finder:
    """The features of a whole text: its lower-case words, and the stems of longer words, marked by ``*``. Training and
    scoring both read texts by it. With ``words`` it finds the places of these alone."""

    def __init__(self, words: Sequence[str] = ()):
        import regex

        self.tokens = regex.compile(TOKEN).findall
        self.whole = {w: k for k, w in enumerate(words) if not w.endswith("*")}
        self.stems = {n: {w[:-1]: k for k, w in enumerate(words) if w.endswith("*") and len(w) == n + 1} for n in STEMS}

    def features(self, text: str) -> set[str]:
        words = set(self.tokens(text.lower()))
        return words.union(w[:n] + "*" for n in STEMS for w in words if len(w) > n)

    def places(self, text: str) -> list[int]:
        words = set(self.tokens(text.lower()))
        out = [self.whole[w] for w in self.whole.keys() & words]
        for n, stems in self.stems.items():
            if stems:
                out += [stems[s] for s in stems.keys() & {w[:n] for w in words if len(w) > n}]
        return out


@dataclass
class Hits:
    """Rows by words, of which a row has few: the places of the ones, and further columns (a bias first, the earlier
    probabilities last) in full. A weight vector holds the bias, the words, and the others."""

    row: np.ndarray
    word: np.ndarray
    words: int
    rest: np.ndarray

    @classmethod
    def of(cls, places: Sequence[Sequence[int]], words: int) -> Hits:
        sizes = [len(p) for p in places]
        return cls(np.repeat(np.arange(len(places)), sizes), np.array([k for p in places for k in p], np.int64), words, np.ones((len(places), 1)))

    def beside(self, earlier: np.ndarray) -> Hits:
        return Hits(self.row, self.word, self.words, np.column_stack([np.ones(len(self.rest)), earlier]))

    def times(self, w: np.ndarray) -> np.ndarray:
        rest = np.concatenate([w[:1], w[1 + self.words :]])
        return self.rest @ rest + np.bincount(self.row, w[1 + self.word], len(self.rest))

    def turned(self, values: np.ndarray) -> np.ndarray:
        rest = self.rest.T @ values
        return np.concatenate([rest[:1], np.bincount(self.word, values[self.row], self.words), rest[1:]])


@dataclass
class Chain:
    """Categories in order; ``weights[k]`` holds the bias, a weight for each word, and one for each earlier category."""

    categories: list[str]
    words: list[str]
    weights: list[np.ndarray]

    def predict(self, hits: Hits) -> np.ndarray:
        """Probabilities (rows x categories)."""
        out = np.zeros((len(hits.rest), 0))
        for w in self.weights:
            out = np.column_stack([out, _probability(hits.beside(out), w)])
        return out


def _probability(x: Hits, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.times(w), -35, 35)))


def logistic(x: Hits, y: np.ndarray, used: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression on the rows ``used``, by Newton's method with conjugate gradients; the bias isn't
    penalised. The cost of a step grows with the words that the rows have, not with rows times words."""
    size = x.words + x.rest.shape[1]
    w, y = np.zeros(size), np.where(used, y, 0.0)
    penalty = np.full(size, ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = _probability(x, w)
        curve = used * np.maximum(p * (1 - p), 1e-6)
        gradient = x.turned(used * (p - y)) + penalty * w
        step = _solve(lambda v: x.turned(curve * x.times(v)) + penalty * v, gradient)  # noqa: B023
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _solve(apply, target: np.ndarray) -> np.ndarray:
    """Conjugate gradients for a positive definite system."""
    x, r = np.zeros_like(target), target.copy()
    d, size = r.copy(), float(target @ target)
    for _ in range(4 * len(target)):
        if size <= 1e-24 * max(1.0, float(target @ target)):
            break
        ad = apply(d)
        a = size / float(d @ ad)
        x += a * d
        r -= a * ad
        size, last = float(r @ r), size
        d = r + (size / last) * d
    return x


def fit_chain(x: Hits, y: np.ndarray, words: list[str], categories: Sequence[str], folds: np.ndarray) -> Chain:
    """``y`` has a column for each category, NaN where the label is missing; such rows are left out of that model."""
    weights, earlier = [], np.zeros((len(y), 0))
    for k in range(len(categories)):
        design, known = x.beside(earlier), ~np.isnan(y[:, k])
        weights.append(logistic(design, y[:, k], known))
        held = np.zeros(len(y))
        for fold in range(FOLDS):
            inside, out = known & (folds != fold), folds == fold
            if out.any():
                held[out] = _probability(design, logistic(design, y[:, k], inside) if inside.any() else weights[k])[out]
        earlier = np.column_stack([earlier, held])
    return Chain(list(categories), words, weights)


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` labelled documents, chosen by a hash of the id: ``doc_id, fold, words``, and the categories. Where an
    id, or one text, is labelled several times, a category holds if any of its labels says so."""
    marks = labels.select("doc_id", *(c.cast("double").alias(k) for k, c in categories.items())).filter(F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(*(F.max(k).alias(k) for k in categories))
    total = marks.agg(F.count("*").alias("n"))  # one row
    place = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1_000_000))
    marks = marks.crossJoin(F.broadcast(total)).filter(place < F.lit(1_000_000.0 * rows) / F.col("n")).drop("n")
    marks = marks.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    # The marks are about `rows` rows, whatever the corpus holds: that bound allows a broadcast, and texts stay in place.
    chosen = texts.join(F.broadcast(marks), "doc_id")
    # Copies of a text are one example, or the words of a much copied text would seem to go with its label.
    chosen = chosen.groupBy("text").agg(F.min(F.struct("doc_id", "fold")).alias("first"), *(F.max(c).alias(c) for c in categories))
    chosen = chosen.select("first.doc_id", "first.fold", *categories, "text")

    def run(batches):
        find = Finder()
        for part in slices(batches, "text", LIST_BYTES):
            words = pa.array([sorted(find.features(t)) for t in part.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], words], names=[*part.schema.names[:-1], "words"])

    kind = dict(docs.dtypes)["doc_id"]
    return chosen.mapInArrow(run, ", ".join([f"doc_id {kind}", "fold int", *(f"`{c}` double" for c in categories), "words array<string>"]))


def choose_words(sample: DataFrame, categories: Sequence[str]) -> list[str]:
    """The words of the sample that go with a category more often than chance allows, by counts over the sample."""
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).alias(f"in_{c}") for c in categories]
    totals = sample.agg(F.count("*").alias("n"), *sums).first()
    counts = sample.withColumn("word", F.explode("words")).groupBy("word").agg(F.count("*").alias("rows"), *sums)
    tried = max(1, counts.count())
    # One-sided normal deviate of a count against its expectation; the bound is that of the level over the words tried.
    bound = float(np.sqrt(2 * np.log(max(tried, 2) / LEVEL)))
    chosen: set[str] = set()
    for c in categories:
        share = (totals[f"in_{c}"] or 0) / max(totals["n"], 1)
        if not 0 < share < 1:
            continue
        z = (F.col(f"in_{c}") - F.col("rows") * share) / F.sqrt(F.greatest(F.col("rows") * share * (1 - share), F.lit(0.5)))
        top = counts.select("word", z.alias("z")).filter((F.col("z") > bound) & (F.col("rows") >= 3))
        chosen |= {r.word for r in top.collect()}  # of a sample of bounded size
    return sorted(chosen)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = SAMPLE_ROWS) -> Chain:
    """The chain, fitted on the sample. What reaches the driver is one row for each sampled document, with its chosen
    words. Without labelled rows, no word is chosen and nothing is toxic."""
    from .common import stored

    sample = stored(labelled_sample(docs, labels, categories, rows), "toxicity-sample")
    names = list(categories)
    words = choose_words(sample, names)
    place = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})

    def run(batches):
        for batch in batches:
            hits = [sorted(place.value[w] for w in place.value.keys() & set(own)) for own in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "hits"])

    found = sample.select("doc_id", "fold", *names, "words").mapInArrow(run, ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", "fold int", *(f"`{c}` double" for c in names), "hits array<int>"]))
    got = sorted(found.collect(), key=lambda r: r.doc_id)
    if not got:
        return Chain(names, [], [np.array([-35.0, *[0.0] * k]) for k in range(len(names))])
    y = np.array([[np.nan if r[c] is None else r[c] for c in names] for r in got], dtype=float)
    return fit_chain(Hits.of([r.hits for r in got], len(words)), y, words, names, np.array([r.fold for r in got]))


def _rows(batches, chain: Chain):
    """Slices of the input, each with its probabilities (rows x categories)."""
    find = Finder(chain.words)
    for part in slices(batches, "text", SLICE_BYTES):
        hits = Hits.of([find.places(text) if text else () for text in part.column("text").to_pylist()], len(chain.words))
        yield part, chain.predict(hits)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: ``doc_id, p_<category>..., toxic`` (the last category's probability is over the
    threshold). Null and empty texts have no words. Row-local over whole texts; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        for part, p in _rows(batches, sent.value):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] > threshold)], names=["doc_id", *names, "toxic"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} double" for n in names), "toxic boolean"]))


def table_categories() -> dict[str, Column]:
    """The labels table holds two judgements; the chain goes from low quality to toxicity."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit the chain on the labelled rows and score all rows."""
    return score(docs, fit(docs, labels, table_categories()))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text is toxic; columns unchanged. The chain decides row by row, in one pass that
    carries the columns along, so nothing is shuffled and repeated or null ids don't matter."""
    chain = fit(docs, labels, table_categories())
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for part, p in _rows(batches, sent.value):
            yield part.filter(pa.array(p[:, -1] <= threshold))

    # Columns go through by number, so that they may have any name.
    rows = docs.toDF(*("text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)))
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
