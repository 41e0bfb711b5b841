"""Runs of repeating words, found by string synchronising sets.

A run is a stretch of words with smallest period q, four periods long at least, that can't be extended. Scales are
tau = 1, 2, 4, ...; at scale tau a word position is *synchronising* if, among the tau-word windows that start at it and at
the tau positions after it, the least hash is at one of the two ends. That depends on the next 2 tau words only, so equal
contexts have equal answers wherever they stand. Windows with a period of tau/4 or less take no part: there the least
hash would be everywhere. They lie in runs of small period, which lower scales have found already.

A run with tau <= q < 2 tau holds a synchronising position in its first tau words (else these would have a small period),
and its context comes back q words later, first then, as it is longer than q. So positions are paired with the next one of
equal context; pairs less than 2 tau apart propose their distance as a period, and each proposal is extended over the
words themselves to the maximal run. Contexts are compared by 64-bit hashes, made for 2 tau from those for tau; words are
compared as such. Texts of a slice lie end to end, with a word of its own between two, so all go through a scale at once.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

SLICE_BYTES = 2_000_000
#: A run has this many words and this many periods at least.
WORDS, PERIODS = 6, 4
NONE = np.iinfo(np.uint64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, from prefixes and suffixes of blocks of that width."""
    size = len(values) - width + 1
    if size <= 0:
        return values[:0]
    blocks = np.full(-(-len(values) // width) * width, NONE, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:size], ahead[width - 1 : width - 1 + size])


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of two arrays agree, in steps that double."""
    done, step, most = 0, 16, min(len(a), len(b))
    while done < most:
        to = min(done + step, most)
        differ = a[done:to] != b[done:to]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = to, 2 * step
    return most


def periodic_stretches(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, end, period`` of all maximal stretches with ``PERIODS`` periods at least. ``words`` are the numbers of the
    words of texts that lie end to end, each text followed by a word of its own; ``sizes`` count these words too."""
    found: list[tuple[int, int, int]] = []
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(words))
    hashes, tau = _mixed(words.astype(np.uint64) + np.uint64(1)), 1
    longest = int(sizes.max()) - 1 if len(sizes) else 0
    while PERIODS * tau <= longest:
        # Texts that can hold a run of this scale; a short one never comes back.
        long_enough = sizes > PERIODS * tau
        if not long_enough.all():
            keep = np.repeat(long_enough, sizes)
            words, hashes, ends, place, sizes = words[keep[: len(words)]], hashes[keep[: len(hashes)]], ends[keep], place[keep], sizes[long_enough]
        size = len(words)
        # hashes[i] is that of words i to i + tau - 1, over borders of texts too.
        order = hashes.copy()
        periodic = [(s, e) for s, e, q in found if PERIODS * q <= tau and e - s >= tau]
        if periodic:
            start, end = np.array(periodic, np.int64).T
            at = np.searchsorted(place, start)
            here = place[np.minimum(at, size - 1)] == start  # not of a text that is out
            at, windows = at[here], (end - start - tau + 1)[here]
            edge = np.zeros(len(order) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, np.minimum(at + windows, len(order)), -1)
            order[np.cumsum(edge[:-1]) > 0] = NONE
        least = _least(order, tau + 1)
        sync = (least == order[: len(least)]) | (least == order[tau : tau + len(least)])
        sync &= least < NONE
        context = _mixed(hashes[: max(size - 2 * tau + 1, 0)] * np.uint64(0x9E3779B97F4A7C15) + hashes[tau : tau + max(size - 2 * tau + 1, 0)])
        at = np.flatnonzero(sync[: len(context)])
        at = at[place[at] + 2 * tau <= ends[at] - 1]
        by = np.argsort(context[at], kind="stable")
        at = at[by]
        gap = np.diff(at)
        pairs = np.flatnonzero((context[at[1:]] == context[at[:-1]]) & (gap >= tau) & (gap < 2 * tau))
        proposals = np.stack([gap[pairs], at[pairs]], axis=1)
        last = (0, -1, -1)  # period, start, end of the run found last
        for q, i in proposals[np.lexsort((proposals[:, 1], proposals[:, 0]))].tolist():
            if last[0] == q and i >= last[1] and i + q < last[2]:
                continue
            left = _agreeing(words[:i][::-1], words[: i + q][::-1])
            right = _agreeing(words[i:], words[i + q :])
            last = (q, i - left, i + q + right)
            if last[2] - last[1] >= PERIODS * q:
                found.append((int(place[last[1]]), int(place[last[1]]) + last[2] - last[1], q))
        hashes, tau = context, 2 * tau
    return np.array(sorted(found), np.int64).reshape(-1, 3)


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def repeated_tail(words: list, doc_id: int | None) -> list:
    """The contract's change: in a tenth of the documents the words from a place on repeat the first of them."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _slice_runs(ids: list, texts: list[str], planted: bool):
    """For each text its words, and its runs as ``start, length, period`` by start, then period."""
    number = Numbers()
    # bytes.split() splits at exactly blank, tab, line feed, vertical tab, form feed and carriage return.
    each = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    if planted:
        each = [repeated_tail(w, i) for i, w in zip(ids, each)]
    sizes = np.array([len(w) + 1 for w in each], np.int64)
    words = np.empty(int(sizes.sum()), np.int64)
    at = 0
    for k, w in enumerate(each):
        words[at : at + len(w)] = [number[x] for x in w]
        at += len(w) + 1
        words[at - 1] = -2 - k
    runs = periodic_stretches(words, sizes)
    runs = runs[runs[:, 1] - runs[:, 0] >= WORDS]
    begins = np.cumsum(sizes) - sizes
    of = np.searchsorted(begins, runs[:, 0], side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(each) + 1))
    for k, w in enumerate(each):
        own = runs[cuts[k] : cuts[k + 1]]
        yield w, np.stack([own[:, 0] - begins[k], own[:, 1] - own[:, 0], own[:, 2]], axis=1)


def _digest(words: list[bytes], runs: np.ndarray) -> tuple:
    spans = runs.tolist()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in spans)
    if spans:
        kept = np.ones(len(words), bool)
        for s, n, q in spans:
            kept[s + q : s + n] = False
        words = [words[k] for k in np.flatnonzero(kept).tolist()]
        start, length, period = min(spans, key=lambda r: (-r[1], r[0], r[2]))
        top = (start, length, period, 1000 * length // period)
    else:
        top = (None,) * 4
    return len(spans), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = True) -> DataFrame:
    """One row for each input row: ``doc_id, n_runs``, the longest run (four nulls without one) and the digests of all runs
    and of the text without its repetitions. ``planted`` first makes the contract's repeated tails.

    Null and empty texts have no words and no runs. Null ids get no repeated tail. Rows repeated with one id are judged
    each by its own text. Row-local over whole texts, no shuffle; memory follows a slice, or the longest text. An empty
    table gives no rows; other columns are ignored.
    """
    names = [c.split(" ")[0] for c in DIGEST.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            ids = part.column("doc_id").to_pylist()
            rows = [_digest(w, r) for w, r in _slice_runs(ids, part.column("text").to_pylist(), planted)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {DIGEST}")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, period, text``: a row for each run of the texts as they are, with its words joined by one
    blank. Odd rows as in ``run_digest``; documents without runs have no row."""
    schema = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("text", pa.string())])

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            ids = part.column("doc_id").to_pylist()
            rows = [(i, s, n, q, b" ".join(w[s : s + n]).decode("utf-8", "replace")) for i, (w, r) in zip(ids, _slice_runs(ids, part.column("text").to_pylist(), False)) for s, n, q in r.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, [pa.int64(), *schema.types])], names=["doc_id", *schema.names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, period long, text string")


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: each text with every run cut to its first period, where it has a run; else the text unchanged."""

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            out = []
            for t, (w, r) in zip(texts, _slice_runs(ids, texts, False)):
                kept = np.ones(len(w), bool)
                for s, n, q in r.tolist():
                    kept[s + q : s + n] = False
                out.append(b" ".join([w[k] for k in np.flatnonzero(kept).tolist()]).decode("utf-8", "replace") if len(r) else t)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string")
