"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text from a given place: at step t it writes the character it stands on and, by a coin that
depends on t and that character only, stays or moves on. Two texts that differ by few edits fall back into step soon after
each edit, so edit distance becomes Hamming distance between the walks.

One walk over a whole text loses its step for long after a few edits. So a walk of ``STEPS`` steps starts at each border;
borders are where a hash of the ``WINDOW`` code points before says so, about every ``SPACING``, so edits elsewhere leave
them alone. A fingerprint has ``SLOTS`` slots. Each slot takes the segment whose border ranks first in the slot's own order,
which is the same one in two texts as often as they share borders, and samples its walk at fixed steps: bits of these
symbols, and of the border's hash, are the slot. Likeness is the share of sampled symbols that agree, over slots of one
border, as a Dice coefficient.

Bands are slots with more bits of the same sample. Texts that share a band and are not in one class yet are compared by
likeness, and then by an edit distance along the passages that both hold once. Where many texts share a band, as a common
passage makes, those that share the bands next to it too meet first; the rest of that band's pairs are listed where it has
few texts, and else meet in blocks of such bands together.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import setsketch
from .common import hot_keys, marked_by, salted, salted_join, slices, stored, text_or_empty

SLOTS, BANDS = 64, 24
#: Borders: hashes of so many code points, one of so many a border.
WINDOW, SPACING = 8, 16
#: Steps of a walk, how many of them a slot samples, and how many different samples there are.
STEPS, SAMPLE, SAMPLES = 24, 6, 8
SLICE_BYTES = 2_000_000
#: A link needs this likeness, and at most 1 - LEAST of the longer text's length in edits.
LIKE, LEAST = 0.25, 0.88
#: Of more texts than this that share a band, those that share its next bands too (up to 2^(LEVELS - 1) of them) meet first.
FULL, LEVELS = 64, 4
#: Members of a crowded band that a block holds at most, in rows and, for the texts of a cell, in code points; pairs of
#: fingerprints that are compared at once.
BLOCK_ROWS, CELL_CHARS, PAIRS = 4096, 4_000_000, 100_000
#: Likely pairs in a cell before it is split, a task's in cells and of listed ones, and tasks at most; rows of a hub's salt.
CELL_PAIRS, TASK_PAIRS, LISTED_PAIRS, MOST_TASKS, SALT_ROWS = 30_000, 2000, 500, 10_000, 1000
#: Lengths of stretches whose counts bound edits, the first for all pairs and each other for those that are left; pairs of texts
#: that are bounded at once, and bins of counts that one step of that reads.
GRAMS, TOGETHER, BOUND_CELLS = (4, 2, 1), 512, 1 << 19
#: All pairs of groups of so many texts at most are listed; larger groups meet in cells.
SMALL = 6
EMPTY = 0xFFFF
MIX = np.uint64(0x9E3779B97F4A7C15)
NONE = np.iinfo(np.uint64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Walker:
    """The shared walk and the samples of it, drawn from one seed."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.coins = rng.integers(0, 2, size=(STEPS, 256), dtype=np.uint8)
        self.coins[:, 0] = 0  # class 0 is the end of a text: a walk that has reached it stays there
        self.names = _mixed(rng.integers(1, 2**62, size=256).astype(np.uint64))
        self.samples = np.array([np.sort(rng.choice(STEPS, SAMPLE, replace=False)) for _ in range(SAMPLES)])
        self.odd = rng.integers(1, 2**62, SLOTS).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def fingerprints(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``SLOTS`` numbers of 16 bits for each text, all ``EMPTY`` for an empty one; and its bands, of 32 bits."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        full = np.flatnonzero(sizes)
        out = np.full((len(texts), SLOTS), EMPTY, np.uint16), np.zeros((len(texts), BANDS), np.uint32)
        if not len(full):
            return out
        codes, sizes = np.concatenate(codes), sizes[full]
        begin, key = _borders(codes, sizes)
        owner = np.searchsorted(np.cumsum(sizes), begin, side="right")
        # Each text is followed by the end's class, long enough for a walk that starts behind its last sign.
        flat = np.zeros(len(codes) + len(sizes), np.uint8)
        flat[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = (codes ^ (codes >> 8) * 167) % 255 + 1
        at = begin + owner
        symbols = np.empty((STEPS, len(at)), np.uint8)
        for t in range(STEPS):
            symbols[t] = c = flat[at]
            at += self.coins[t, c]
        rank, first = key, np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        low, border = [], (rank >> np.uint64(20) & np.uint64(15)) << np.uint64(2 * SAMPLE)
        for steps in self.samples:
            bits, whole = np.zeros(len(rank), np.uint64), rank
            for k, t in enumerate(steps.tolist()):
                name = self.names[symbols[t]]
                bits |= (name >> np.uint64(40) & np.uint64(3)) << np.uint64(2 * k)
                whole = (whole + name) * MIX
            low.append((_mixed(whole) >> np.uint64(48) << np.uint64(16)) | border | bits)
        high = np.uint64(0xFFFFFFFF00000000)
        for k in range(BANDS):
            order = (rank ^ self.odd[SLOTS - 1 - k]) * self.odd[k]
            order &= high
            order |= low[k % SAMPLES]
            least = np.minimum.reduceat(order, first)
            out[0][full, k] = (least & np.uint64(0xFFFF)).astype(np.uint16)
            out[1][full, k] = (least & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        # The other slots need no more than their 16 bits: orders of 16 bits before these.
        rank, low, odd = (rank >> np.uint64(32)).astype(np.uint32), [(x & np.uint64(0xFFFF)).astype(np.uint32) for x in low], (self.odd >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
        for k in range(BANDS, SLOTS):
            order = (rank ^ odd[SLOTS - 1 - k]) * odd[k]
            order &= np.uint32(0xFFFF0000)
            order |= low[k % SAMPLES]
            out[0][full, k] = (np.minimum.reduceat(order, first) & np.uint32(0xFFFF)).astype(np.uint16)
        return out


def _borders(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where walks start in texts that lie end to end in ``codes``, and a hash of the signs before: behind each window
    whose hash says so, and at the first sign of a text without one. Every text has a start."""
    rolling, width, factor = codes + np.uint32(1), 1, MIX
    while width < WINDOW:  # hashes of twice the width from pairs of neighbours, by a factor of each width's own
        rolling, tail = rolling[:-width] * np.uint32(factor >> np.uint64(32) | np.uint64(1)), rolling[width:]
        rolling += tail
        width, factor = 2 * width, _mixed(np.array([factor]))[0]
    ends = np.cumsum(sizes)
    hit = np.flatnonzero(rolling * np.uint32(0x9E3779B1) < np.uint32((1 << 32) // SPACING))
    of = np.searchsorted(ends, hit, side="right")
    inside = hit + WINDOW <= ends[of]
    hit, of = hit[inside], of[inside]
    bare = np.setdiff1d(np.arange(len(sizes)), of)
    begin, key = np.concatenate([hit + WINDOW, (ends - sizes)[bare]]), np.concatenate([_mixed(rolling[hit].astype(np.uint64) * MIX), np.full(len(bare), MIX)])
    owner = np.concatenate([of, bare])
    by = np.lexsort((begin, owner))
    # A border behind the last sign would lie in the next text; its walk has that last sign alone.
    return np.minimum(begin, ends[owner] - 1)[by], key[by]


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


_AGREE = np.array([sum((x >> 2 * k) & 3 == 0 for k in range(SAMPLE)) for x in range(1 << 2 * SAMPLE)], np.float64) / SAMPLE


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of sampled symbols that agree, over slots with one border, as a Dice coefficient; 1 for two empty texts and
    0 for an empty and another one."""
    differ = a ^ b
    agree = np.where(differ >> 2 * SAMPLE == 0, _AGREE[differ & ((1 << 2 * SAMPLE) - 1)], 0.0).mean(axis=-1)
    none = (a == EMPTY).all(axis=-1) != (b == EMPTY).all(axis=-1)
    return np.where(none, 0.0, 2 * agree / (1 + agree))


def edited(text: str, following: str) -> str:
    """The contract's edit: the last half replaced by as much of the next text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


EDGE = "part string, edge_text string, is_head boolean, is_tail boolean, bands binary"
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text_sha256"]
RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text_sha256 string"
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.binary()]


def _judge(walker: Walker, parts: list[str], ids: list, texts: list[str], head: bool, tail: bool) -> list[tuple]:
    """The rows of neighbouring texts of one part. ``head``: the first is the part's first. ``tail``: the last text has no
    successor here; else it only lends its beginning and its fingerprint to the row before."""
    changed = [edited(t, f) for t, f in zip(texts, texts[1:])]
    prints, bands = walker.fingerprints(texts + changed)
    own, others = prints[: len(texts)], prints[len(texts) :]
    near, near_next = likeness(own[:-1], others), likeness(own[:-1], own[1:])
    rows = []
    for k in range(len(texts) - (not tail)):
        first, last = head and k == 0, k == len(texts) - 1
        known = [None] * 4 if last else [_sha(changed[k]), text_of(others[k]), float(near[k]), float(near_next[k])]
        edge = texts[k] if first or last else None
        rows.append((ids[k], len(texts[k]), known[0], text_of(own[k]), *known[1:], _sha(texts[k]), parts[k], edge, first, last, bands[k].astype(">u4").tobytes() if texts[k] else None))
    return rows


def _walk_parts(batches):
    """Rows come in order of id within each part; each is judged with its successor. A part's first and last rows carry
    their texts out, for the last of the part before and for the part's own last row."""
    walker, held, head = Walker(), None, True  # held: part, id and text of the row whose successor may follow
    for batch in slices(batches, "text", SLICE_BYTES):
        parts, ids, texts = (batch.column(c).to_pylist() for c in ("part", "doc_id", "text"))
        if held is not None:
            parts, ids, texts = [held[0], *parts], [held[1], *ids], [held[2], *texts]
        cuts = [0, *(k for k in range(1, len(parts)) if parts[k] != parts[k - 1]), len(parts)]
        rows: list[tuple] = []
        for i, j in zip(cuts, cuts[1:]):
            done = j < len(parts)  # the part ends within this slice
            if done or j - i > 1:
                rows += _judge(walker, parts[i:j], ids[i:j], texts[i:j], head or i > 0, done)
                head = done
        held = parts[-1], ids[-1], texts[-1]
        if rows:
            yield _batch(rows)
    if held is not None:
        yield _batch(_judge(walker, [held[0]], [held[1]], [held[2]], head, True))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=[*COLUMNS, "part", "edge_text", "is_head", "is_tail", "bands"])


def _close_parts(batches):
    """The last row of each part, with the first text of the next one beside it."""
    walker = Walker()
    for batch in batches:
        for k in range(batch.num_rows):
            i, part, text, following, bands = (batch.column(c)[k].as_py() for c in ("doc_id", "part", "edge_text", "next_text", "bands"))
            changed = edited(text, following)
            own, other, after = walker.fingerprints([text, changed, following])[0]
            yield _batch([(i, len(text), _sha(changed), text_of(own), text_of(other), float(likeness(own, other)), float(likeness(own, after)), _sha(text), part, None, None, None, bands)]).select([*COLUMNS, "bands"])


def _spans(batches):
    """``part, first, last, ascending`` of each stretch of rows of one part."""
    part = None
    for batch in batches:
        for own, i in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist()):
            if own != part:
                if part is not None:
                    yield _span(part, first, last, rising)
                part, first, last, rising = own, i, i, i is not None
            else:
                rising = rising and i is not None and i > last
                last = i
    if part is not None:
        yield _span(part, first, last, rising)


def _span(part, first, last, rising) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([rising])], names=["part", "first", "last", "ascending"])


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, part``: rows of a part come one after the other in ascending order of id, and parts hold ranges of
    ids. Where the files' splits are such parts already, which their ids alone tell, the texts stay where they are; else
    they are shuffled once, into ranges."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    split = F.concat_ws(":", F.input_file_name(), F.input_file_block_start().cast("string"))
    found = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), split.alias("part")).mapInArrow(_spans, "part string, first long, last long, ascending boolean"), "parts")
    before = F.max("last").over(Window.orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    wrong = found.withColumn("before", before).filter("not ascending or before >= first").limit(1).count()
    if wrong or found.count() != found.select("part").distinct().count():
        ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        return ranged.withColumn("part", F.spark_partition_id().cast("string"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), split.alias("part"))


def _printed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    walked = stored(_in_order(docs, id_col, text_col).mapInArrow(_walk_parts, f"doc_id long, {RESULT}, {EDGE}"), "fingerprints")
    heads = walked.filter("is_head").select("part", "doc_id", "edge_text")
    # Which part follows, the first one after the last: a row without text for each part.
    order = Window.orderBy("doc_id", "part")
    around = F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = heads.select("part", F.coalesce(F.lead("part").over(order), around).alias("next_part"))
    tails = walked.filter("is_tail").select("part", "doc_id", "edge_text", "bands").join(following, "part")
    closed = tails.join(heads.select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text")), "next_part")
    closed = closed.select("doc_id", "part", "edge_text", "next_text", "bands").mapInArrow(_close_parts, f"doc_id long, {RESULT}, bands binary")
    return walked.filter("not is_tail").select(*COLUMNS, "bands").unionByName(stored(closed, "part-ends"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the contract's columns and ``text_sha256``.

    The next document is the next by ascending id (null first; rows repeated with one id in order of their texts), after
    the last the first; a single document is its own next. Null text counts as empty; two empty texts have likeness 1.
    Texts are shuffled at most once, and not at all where files hold ascending ranges of ids. Only the end rows of the
    parts meet again: two texts for each part. Ids are whole numbers.
    """
    return _printed(docs, id_col, text_col).select(*COLUMNS)


def _print_array(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u2").reshape(len(column), -1)


def _likeness_udf(a, b):
    import pandas as pd

    return pd.Series(likeness(_print_array(a), _print_array(b)), dtype="float64")


def distance_within(a: str, b: str, most: int) -> int:
    """The edit distance of two texts in code points if it is at most ``most``, else ``most`` + 1: bit-parallel, a column
    of the table in one integer, on what is left without the common beginning and end."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    for cut in (lambda x, n: x[:n], lambda x, n: x[len(x) - n :]):
        lo, hi = 0, min(len(a), len(b))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if cut(a, mid) == cut(b, mid) else (lo, mid - 1)
        a, b = (x[lo:] if cut("ab", 1) == "a" else x[: len(x) - lo] for x in (a, b))
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return min(len(b), most + 1)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for k, c in enumerate(b):
        eq = where.get(c, 0)
        vertical, flat = eq | down, (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(flat | up)) & full, up & flat
        score += bool(more & top) - bool(less & top)
        if score - (len(b) - k - 1) > most:
            return most + 1
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(vertical | more)) & full, more & vertical & full
    return min(score, most + 1)


#: Passages that both texts hold once: so many code points, one of so many by hash. Gaps between two of them of more than
#: ``WIDE`` code points on both sides count as replaced.
PASSAGE, ONE_OF, WIDE = 12, 4, 4096
#: Code points of the stretches that a bound counts.
GRAM = 4
#: So many small gaps are worked out together.
MANY = 32


def _marks(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the passages of a text that are one of ``ONE_OF``, in their order, and their places."""
    if len(code) < PASSAGE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolling = np.zeros(len(code) - PASSAGE + 1, np.uint64)
    for k in range(PASSAGE):
        rolling = (rolling + code[k : k + len(rolling)] + np.uint64(1)) * MIX
    rolling = _mixed(rolling)
    at = np.flatnonzero(rolling % np.uint64(ONE_OF) == 0)
    at = at[np.argsort(rolling[at], kind="stable")]
    return rolling[at], at


def _passages(marks: tuple[np.ndarray, np.ndarray], begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's marks, those that its stretch from ``begin`` to ``end`` holds once: hashes, ascending, and places there."""
    found, at = marks
    inside = (at >= begin) & (at <= end - PASSAGE)
    found, at = found[inside], at[inside]
    differ = np.ones(len(found) + 1, bool)
    differ[1:-1] = found[1:] != found[:-1]
    once = differ[1:] & differ[:-1]
    return found[once], at[once] - begin


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence."""
    tops, top_at, before = [], [], []
    for k, v in enumerate(values):
        j = bisect_left(tops, v)
        before.append(top_at[j - 1] if j else -1)
        if j == len(tops):
            tops.append(v)
            top_at.append(k)
        else:
            tops[j], top_at[j] = v, k
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _short_distances(a: np.ndarray, b: np.ndarray, gaps: np.ndarray) -> int:
    """The summed edit distances of gaps (``a0, a1, b0, b1``) whose shorter side has 1 to 64 code points: a column of each
    table in one number, all gaps step by step together."""
    if not len(gaps):
        return 0
    flip = gaps[:, 1] - gaps[:, 0] > gaps[:, 3] - gaps[:, 2]
    p0, p1 = np.where(flip, gaps[:, 2], gaps[:, 0]), np.where(flip, gaps[:, 3], gaps[:, 1])
    t0, t1 = np.where(flip, gaps[:, 0] + len(b), gaps[:, 2]), np.where(flip, gaps[:, 1] + len(b), gaps[:, 3])
    text = np.concatenate([b, a])
    by = np.argsort(t0 - t1, kind="stable")  # longest first
    p0, p1, t0, flip = p0[by], p1[by], t0[by], flip[by]
    steps, m = (t1[by] - t0), p1 - p0
    place = p0[:, None] + np.arange(64)
    inside = np.arange(64) < m[:, None]
    pattern = np.where(inside, np.where(flip[:, None], b[np.minimum(place, len(b) - 1)] if len(b) else 0, a[np.minimum(place, len(a) - 1)] if len(a) else 0), np.uint32(0xFFFFFFFF))
    one = np.uint64(1)
    up, down, score = np.full(len(m), NONE, np.uint64), np.zeros(len(m), np.uint64), m.copy()
    top = one << (m - 1).astype(np.uint64)
    for k in range(int(steps[0])):
        live = int(np.searchsorted(-steps, -k, side="left"))  # gaps with more than k steps
        u, d = up[:live], down[:live]
        eq = np.packbits(pattern[:live] == text[t0[:live] + k][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        vertical, flat = eq | d, (((eq & u) + u) ^ u) | eq
        more, less = d | ~(flat | u), u & flat
        score[:live] += ((more & top[:live]) != 0).astype(np.int64) - ((less & top[:live]) != 0).astype(np.int64)
        more, less = more << one | one, less << one
        up[:live], down[:live] = less | ~(vertical | more), more & vertical
    return int(score.sum())


def _least_edits(a: np.ndarray, b: np.ndarray) -> int:
    """A bound below the edit distance: an edit changes ``GRAM`` stretches of so many code points at most, so it takes one for
    each ``GRAM`` stretches that the longer text has and the other hasn't, each as often as it has them."""
    longer, other = (a, b) if len(a) >= len(b) else (b, a)
    n = len(longer) - GRAM + 1
    if n <= 0:
        return len(longer) - len(other)

    def grams(code: np.ndarray) -> np.ndarray:
        out = np.zeros(max(len(code) - GRAM + 1, 0), np.uint64)
        for k in range(GRAM):
            out = (out + code[k : k + len(out)] + np.uint64(1)) * MIX
        return np.sort(_mixed(out))

    x, y = grams(longer), grams(other)
    # The k-th copy of a stretch in one text meets the k-th copy in the other.
    copy = lambda s: np.arange(len(s)) - np.searchsorted(s, s)
    shared = np.intersect1d(x + copy(x).astype(np.uint64) * MIX, y + copy(y).astype(np.uint64) * MIX).size
    return max(len(longer) - len(other), -(-(n - shared) // GRAM))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def aligned_distance(a: str, b: str, most: int, known: Callable | None = None) -> int:
    """Edits in code points along the passages that both texts hold once, in the longest common order, if there are at most
    ``most``, else more than ``most``. Never less than the edit distance, and equal to it where an alignment of least cost
    goes through these passages. Gaps between passages are worked out exactly, but wide ones count as replaced; the cost is
    that of the gaps, so it grows with the texts' lengths and not with their product. ``known`` gives a text's code points
    and marks, where they are kept and the texts have met bounds below the distance before."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if max(len(a), len(b)) <= 64:
        return distance_within(a, b, most)
    (ca, ma), (cb, mb) = ((c, _marks(c)) for c in map(_codes, (a, b))) if known is None else (known(a), known(b))
    n = min(len(ca), len(cb))
    head = _agreeing(ca[:n], cb[:n])
    tail = _agreeing(ca[::-1][: n - head], cb[::-1][: n - head])
    (ha, pa_), (hb, pb) = _passages(ma, head, len(ca) - tail), _passages(mb, head, len(cb) - tail)
    ca, cb = ca[head : len(ca) - tail], cb[head : len(cb) - tail]
    if len(ha) and len(hb):
        ib = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
        both = hb[ib] == ha
        xa, xb = pa_[both], pb[ib[both]]
    else:
        xa = xb = np.zeros(0, np.int64)
    by = np.argsort(xa)
    xa, xb = xa[by], xb[by]
    if (xb[1:] < xb[:-1]).any():
        kept = np.array(_rising(xb.tolist()), np.int64)
        xa, xb = xa[kept], xb[kept]
    # A passage aligns its first sign; what lies between two of them is a gap, which may hold the passages' own rest.
    a0, a1 = np.concatenate([[0], xa]), np.concatenate([xa, [len(ca)]])
    b0, b1 = np.concatenate([[0], xb]), np.concatenate([xb, [len(cb)]])
    gaps = np.stack([a0, a1, b0, b1], axis=1)
    # Each gap takes as many edits as its sides differ in length, at least.
    if int(np.abs((a1 - a0) - (b1 - b0)).sum()) > most:
        return most + 1
    # Runs of equal gaps on one diagonal cost nothing.
    same = a1 - a0 == b1 - b0
    equal = np.zeros(len(gaps), bool)
    if same.any():
        run = _diagonal_differences(ca, cb, a0[same], b0[same], (a1 - a0)[same])
        equal[np.flatnonzero(same)[run == 0]] = True
    gaps = gaps[~equal]
    short = np.minimum(gaps[:, 1] - gaps[:, 0], gaps[:, 3] - gaps[:, 2])
    wide = np.maximum(gaps[:, 1] - gaps[:, 0], gaps[:, 3] - gaps[:, 2])
    total = int(wide[(short == 0) | (short > WIDE)].sum())
    # Where much lies between passages far apart, the texts may well have little in common.
    if total > most or (known is None and wide[short > 64].sum() > most and _least_edits(ca, cb) > most):
        return most + 1
    # Many small gaps go step by step together; for a few, or long ones, the steps would cost more than the gaps.
    small = (short > 0) & (short <= 64) & (wide <= 4 * 64)
    if small.sum() < MANY:
        small[:] = False
    total += _short_distances(ca, cb, gaps[small])
    for i, j, k, l in gaps[(short > 0) & (short <= WIDE) & ~small].tolist():  # noqa: E741
        if total > most:
            break
        x, y = ca[i:j].tobytes().decode("utf-32-le", "surrogatepass"), cb[k:l].tobytes().decode("utf-32-le", "surrogatepass")
        total += distance_within(x, y, most - total)
    return total


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    differ = np.flatnonzero(a != b)
    return int(differ[0]) if len(differ) else len(a)


def _diagonal_differences(a: np.ndarray, b: np.ndarray, a0: np.ndarray, b0: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many code points differ in stretches of one length in both texts."""
    ends = np.cumsum(size)
    inside = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
    differ = np.concatenate([[0], np.cumsum(a[np.repeat(a0, size) + inside] != b[np.repeat(b0, size) + inside])])
    return differ[ends] - differ[ends - size]


def _most(n, least: float):
    """Edits allowed for a longer text of ``n`` code points."""
    return np.floor(n * (1 - least) + 1e-9).astype(np.int64)


def _band_key(k: int, level: int) -> Column:
    """A hash of 2^level bands from the k-th on, around the end."""
    return F.xxhash64(F.lit(k), F.substring(F.concat("bands", "bands"), 4 * k + 1, 4 << level))


def shared_bands(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """``grp, node, n, low, band, fine, hub, rows``: a group is the texts of one band whose lengths lie in one class or, with
    ``low`` false, in the next one, so any two texts that share a band and whose lengths allow a link meet in a group that
    one of them is low in. ``hub`` is a group's least node, ``fine`` a hash of the band with the seven next to it. All
    groups of more than one text with a low one are there, whatever their sizes."""
    # A little wider than 1 / least, so that rounding doesn't put a pair two classes apart.
    size = F.floor(F.log("n") / F.lit(1.001 * math.log(1 / least))).cast("int")
    bands = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), _band_key(k, 0).alias("key"), _band_key(k, LEVELS - 1).alias("fine")) for k in range(BANDS)))).alias("b")
    rows = nodes.select(F.col("doc_id").alias("node"), "n", bands).select("node", "n", "b.band", "b.key", "b.fine")
    counts = stored(rows.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key"), "bands")
    near = marked_by(rows, "key", counts).filter("_maybe").select("node", "n", "band", "key", "fine", F.explode(F.array(F.lit(0), F.lit(1))).alias("below"))
    near = stored(near.select(F.xxhash64("key", size - F.col("below")).alias("grp"), "node", "n", (F.col("below") == 0).alias("low"), "band", "fine"), "band-members")
    groups = near.groupBy("grp").agg(F.min("node").alias("hub"), F.count("*").alias("rows"), F.count_if("low").alias("lows")).filter("rows > 1 and lows > 0")
    groups = stored(groups.select("grp", "hub", "rows"), "band-groups")
    hot = stored(hot_keys(groups, "grp", near.count()), "hot-groups")
    near = marked_by(near, "grp", groups.select("grp")).filter("_maybe").select("grp", "node", "n", "low", "band", "fine")
    return stored(salted_join(near, groups, "grp", "node", hot), "group-members")


def _first_hubs(members: DataFrame) -> DataFrame:
    """``hub, node``: one text for each to meet first, the least node of a group. In a group of more than ``FULL`` texts
    that is the least of those that share the bands next to this one too; if there is none, the text waits."""
    crowded = members.filter(F.col("rows") > FULL).select(F.xxhash64("grp", "fine").alias("key"), "node")
    fine = stored(crowded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("rows")).filter("rows > 1"), "fine-groups")
    near = salted_join(crowded, fine.select("key", "hub"), "key", "node", hot_keys(fine, "key", fine.agg(F.sum("rows")).first()[0] or 0))
    pairs = members.filter(F.col("rows") <= FULL).select("hub", "node").union(near.select("hub", "node"))
    return stored(pairs.filter("node <> hub").groupBy("node").agg(F.min("hub").alias("hub")), "first-hubs")


def _small_pairs(named: DataFrame, least: float) -> DataFrame:
    """``hub, node``: all pairs of different components in groups of ``SMALL`` texts at most whose lengths allow a link, the
    lesser id first. Texts mostly share several such groups, and a pair is kept once."""
    one = F.struct("node", "n", "low", "comp")
    groups = named.filter(F.col("rows") <= SMALL).groupBy("grp").agg(F.sort_array(F.collect_list(one)).alias("all"), F.min("comp").alias("least_comp"), F.max("comp").alias("most_comp"))
    pairs = groups.filter("least_comp <> most_comp").select("all", F.posexplode("all").alias("k", "x"))
    pairs = pairs.select("x", F.explode(F.slice("all", F.col("k") + 2, SMALL)).alias("y"))
    near = F.abs(F.col("x.n") - F.col("y.n")) <= F.floor(F.greatest("x.n", "y.n") * F.lit(1 - least) + 1e-9)
    pairs = pairs.filter((F.col("x.comp") != F.col("y.comp")) & (F.col("x.low") | F.col("y.low")) & near)
    return stored(pairs.select(F.col("x.node").alias("hub"), F.col("y.node").alias("node")).distinct(), "small-pairs")


def _open_cells(named: DataFrame) -> DataFrame:
    """``hub, node, comp, shared, rows, chars``: groups of more than ``SMALL`` texts whose members lie in several components.
    Groups with one least node ``hub``, as a common passage makes in several bands, are taken as one cell, which has each of
    its nodes once; bit k of ``shared`` says that the node is in one of them by its band k. ``rows`` and ``chars`` are the
    cell's."""
    named = named.filter(F.col("rows") > SMALL)
    groups = named.groupBy("grp").agg(F.min("comp").alias("least_comp"), F.max("comp").alias("most_comp"), F.min("node").alias("hub"), F.count("*").alias("rows"))
    groups = stored(groups.filter("least_comp <> most_comp").select("grp", "hub", "rows"), "open-groups")
    hot = hot_keys(groups, "grp", groups.agg(F.sum("rows")).first()[0] or 0)
    named = marked_by(named, "grp", groups.select("grp")).filter("_maybe").select("grp", "node", "n", "comp", F.expr("shiftleft(1L, band)").alias("bit"))
    named = salted_join(named, groups.select("grp", "hub"), "grp", "node", hot)
    met = stored(named.groupBy("hub", "node").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.bit_or("bit").alias("shared")), "open-members")
    cells = stored(met.groupBy("hub").agg(F.count("*").alias("rows"), F.sum("n").alias("chars")), "open-cells")
    return salted_join(met.drop("n"), cells, "hub", "node", hot_keys(cells, "hub", met.count()))


def _with_comps(rows: DataFrame, key: str, comps: DataFrame) -> DataFrame:
    """``rows`` with the component of their node ``key``. Most nodes are their own component and need no join."""
    other = comps.filter("node <> comp")
    rows = marked_by(rows, key, other.select("node"))
    found = rows.filter("_maybe").join(other.select(F.col("node").alias(key), "comp"), key, "left").withColumn("comp", F.coalesce("comp", key))
    return found.drop("_maybe").unionByName(rows.filter("not _maybe").drop("_maybe").withColumn("comp", F.col(key)))


def _of_nodes(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """The rows of ``nodes`` whose ``doc_id`` may be in ``used``: the others need not be shuffled for a join."""
    return marked_by(nodes, "doc_id", used).filter("_maybe").drop("_maybe")


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (hub, node) whose likeness and lengths allow a link, for ``_links``: a cell is a hub, or a part of its
    pairs where there are many or long ones."""
    hot, like = setsketch.hot_hubs(pairs), F.pandas_udf(_likeness_udf, "double")
    nodes = nodes.select("doc_id", "registers", "n")
    hubs, nodes = _of_nodes(nodes, pairs.select("hub")), _of_nodes(nodes, pairs.select("node"))
    pairs = pairs.join(nodes.withColumnRenamed("doc_id", "node"), "node")
    pairs = salted_join(pairs, hubs.select(F.col("doc_id").alias("hub"), F.col("registers").alias("h_registers"), F.col("n").alias("h_n")), "hub", "node", hot)
    fit = F.abs(F.col("n") - F.col("h_n")) <= F.floor(F.greatest("n", "h_n") * F.lit(1 - least) + 1e-9)
    likely = pairs.filter(fit).withColumn("likeness", like("registers", "h_registers")).filter(F.col("likeness") >= LIKE)
    cell = F.xxhash64("hub", "_salt", F.pmod(F.xxhash64("node"), F.lit(1) + F.floor(F.col("n") * SALT_ROWS / CELL_CHARS)))
    return stored(salted(likely, "hub", "node", hot).select(cell.alias("cell"), F.col("hub").alias("a"), F.col("node").alias("b"), "likeness"), "likely-pairs")


class _Judge:
    """Which pairs of a cell's texts link, each unless the cell's links join it already. ``nodes`` and ``comps`` are the
    texts' ids and components; pairs are places among them. The lesser id comes first, as the passages' order may tell in
    a distance.

    Most pairs are not near, which bounds below the edit distance tell: as in ``_least_edits``, with stretches of several
    lengths (long ones tell of scattered edits, short ones of replaced passages) counted in bins by their hashes
    (collisions only lower a bound), for many pairs at once."""

    def __init__(self, least: float, nodes: np.ndarray, comps: np.ndarray, texts: list[str]):
        self.least, self.nodes, self.comps, self.texts = least, nodes.tolist(), comps.tolist(), texts
        self.n = np.array([len(t) for t in texts], np.int64)
        self.above, self.kept = {}, {}
        # Texts of a cell have lengths much alike, so one number of bins suits all: about twice the longest text's stretches.
        bins = 1 << min(16, max(8, int(2 * self.n.max(initial=1) - 1).bit_length()))
        self.counts = {q: np.zeros((len(texts), bins if q > 1 else 256), np.uint16) for q in GRAMS}
        self.filled = {q: np.zeros(len(texts), bool) for q in GRAMS}

    def root(self, c: int) -> int:
        while (up := self.above.get(c, c)) != c:
            self.above[c] = c = self.above.get(up, up)
        return c

    def known(self, text: str) -> tuple:
        if text not in self.kept:
            self.kept[text] = (code := _codes(text)), _marks(code)
        return self.kept[text]

    def fill(self, places: np.ndarray, q: int) -> None:
        counts, filled = self.counts[q], self.filled[q]
        for k in places[~filled[places]].tolist():
            code = _codes(self.texts[k])
            out = np.zeros(max(len(code) - q + 1, 0), np.uint32)
            for t in range(q):
                out = (out + code[t : t + len(out)] + np.uint32(1)) * np.uint32(0x9E3779B1)
            out = ((out ^ out >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(16)) & np.uint32(counts.shape[1] - 1)
            # A count that is cut would raise the bound: with such a text it says nothing.
            found = np.bincount(out, minlength=counts.shape[1])
            counts[k] = found if found.max(initial=0) < 1 << 16 else (1 << 16) - 1
            filled[k] = True

    def may_link(self, a: np.ndarray, b: np.ndarray, q: int) -> np.ndarray:
        self.fill(np.unique(np.concatenate([a, b])), q)
        counts = self.counts[q]
        shared, step = np.empty(len(a), np.int64), max(1, BOUND_CELLS // counts.shape[1])
        for at in range(0, len(a), step):
            x, y = a[at : at + step], b[at : at + step]
            shared[at : at + step] = np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.uint32)
        longer = np.maximum(self.n[a], self.n[b])
        return -(-(longer - q + 1 - shared) // q) <= _most(longer, self.least)

    def links(self, a: np.ndarray, b: np.ndarray, like: np.ndarray):
        """Those of the pairs that link, most alike first."""
        ids = np.array(self.nodes)
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        by = np.argsort(-like, kind="stable")
        for at in range(0, len(by), TOGETHER):
            part = by[at : at + TOGETHER]
            roots = np.array([[self.root(self.comps[k]) for k in side[part].tolist()] for side in (a, b)])
            part = part[roots[0] != roots[1]]
            for q in GRAMS:
                part = part[self.may_link(a[part], b[part], q)] if len(part) else part
            for i, j in zip(a[part].tolist(), b[part].tolist()):
                ra, rb = self.root(self.comps[i]), self.root(self.comps[j])
                x, y = self.texts[i], self.texts[j]
                most = int(_most(max(len(x), len(y)), self.least))
                if ra != rb and aligned_distance(y, x, most, self.known) <= most:
                    self.above[ra] = rb
                    yield self.nodes[i], self.nodes[j]


def _found(links) -> list[pa.RecordBatch]:
    links = list(links)
    return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])] if links else []


def _cell_links(batches, least: float):
    """Links of the pairs of each cell. Rows come sorted by cell: its texts, then its pairs."""

    def judged(texts: dict, pairs: list):
        nodes = np.array(list(texts), np.int64)
        place = {k: i for i, k in enumerate(texts)}
        a, b = (np.array([place[p[c]] for p in pairs], np.int64) for c in (0, 1))
        return _found(_Judge(least, nodes, nodes, list(texts.values())).links(a, b, np.array([p[2] for p in pairs])))

    cell, texts, pairs = None, {}, []
    for batch in batches:
        for own, a, b, like, text in zip(*(batch.column(c).to_pylist() for c in ("cell", "a", "b", "likeness", "text"))):
            if own != cell:
                yield from judged(texts, pairs)
                cell, texts, pairs = own, {}, []
            if text is not None:
                texts[a] = text
            else:
                pairs.append((a, b, like))
    yield from judged(texts, pairs)


def _links(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Links among the pairs (cell, a, b, likeness) whose texts are near enough: as many of a cell's as join what all of
    them do. A cell's texts go to it once."""
    need = pairs.select("cell", F.col("a").alias("node")).union(pairs.select("cell", F.col("b").alias("node"))).distinct()
    used = stored(need.select(F.col("node").alias("doc_id")).distinct(), "used")
    texts = _texts_of(docs, used).dropDuplicates(["doc_id"])
    rows = need.join(texts, need["node"] == texts["doc_id"]).select("cell", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(2.0).alias("likeness"), "text")
    rows = rows.unionByName(pairs.withColumn("text", F.lit(None).cast("string")))
    # The work is in the pairs and not in the bytes: tasks by their number.
    tasks = min(MOST_TASKS, 1 + pairs.count() // LISTED_PAIRS)
    rows = rows.repartition(tasks, "cell").sortWithinPartitions("cell", F.desc("likeness"), "a", "b")
    return stored(rows.mapInArrow(partial(_cell_links, least=least), "a long, b long"), "links")


def _texts_of(docs: DataFrame, used: DataFrame) -> DataFrame:
    """``doc_id, text`` of the ids in ``used``. A bitmap of hashed ids, bounded in size, goes to all tasks first, so that
    only these texts (and a few others that the exact join drops) are shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = marked_by(rows, "doc_id", used).filter("_maybe").select("doc_id", "text")
    return rows.join(used.hint("merge"), "doc_id")


def _crossed(rows: dict, least: float):
    """Places and likeness of pairs of one cell that may link: a left and a right row of different components, lengths and
    likeness within bounds. Texts that share several bands are paired by the first of these only."""
    n, comp, shared, prints, bands = (rows[c] for c in ("n", "comp", "shared", "registers", "bands"))
    left, right = np.flatnonzero(rows["side"] != 1), np.flatnonzero(rows["side"] != 0)
    inner = (rows["side"] == 2).all()
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left) if len(right) else 0, step):
        l, r = left[at : at + step, None], right[None]  # noqa: E741
        fit = (comp[l] != comp[r]) & (shared[l] & shared[r] != 0) & (np.abs(n[l] - n[r]) <= _most(np.maximum(n[l], n[r]), least))
        if inner:
            fit &= l < r
        i, j = np.nonzero(fit)
        x, y = l[i, 0], right[j]
        # Likeness is at most what slots of one border allow, which is quicker to count.
        may = np.flatnonzero(((prints[x] ^ prints[y]) < 1 << 2 * SAMPLE).sum(axis=1) >= SLOTS * LIKE / (2 - LIKE))
        x, y = x[may], y[may]
        same = bands[x] == bands[y]
        met = same.any(axis=1) & (shared[x] & shared[y] & np.int64(1) << same.argmax(axis=1) != 0)
        x, y = x[met], y[met]
        like = likeness(prints[x], prints[y])
        found = like >= LIKE
        if found.any():
            yield x[found], y[found], like[found]


def _cells(batches, texts: bool):
    """The rows of each cell as arrays; they come sorted by cell."""
    names = ["node", "n", "comp", "shared", "side"]

    def whole(parts):
        return {c: np.concatenate([p[c] for p in parts]) for c in [*names, "registers", "bands"]} | {"cell": parts[0]["cell"], "text": [t for p in parts for t in p["text"]]}

    parts: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column("cell").to_numpy()
        cuts = (np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist()
        for k, e in zip([0, *cuts], [*cuts, len(cells)]):
            if parts and parts[0]["cell"] != cells[k]:
                yield whole(parts)
                parts = []
            piece = batch.slice(k, e - k)
            part = {c: piece.column(c).to_numpy(zero_copy_only=False) for c in names}
            prints, tops = (_print_array(piece.column(c).to_pylist()) for c in ("registers", "tops"))
            # A band's lower half is its slot.
            part |= {"registers": prints.astype(np.uint16), "bands": tops.astype(np.uint32) << np.uint32(16) | prints[:, :BANDS]}
            parts.append(part | {"cell": cells[k], "text": piece.column("text").to_pylist() if texts else []})
    if parts:
        yield whole(parts)


def _paired(batches, least: float):
    """The rows of each cell that are in some likely pair of it, and in how many."""
    for rows in _cells(batches, False):
        times = np.zeros(len(rows["n"]), np.int64)
        for x, y, _ in _crossed(rows, least):
            times += np.bincount(x, minlength=len(times)) + np.bincount(y, minlength=len(times))
        at = np.flatnonzero(times)
        if len(at):
            columns = [pa.array(rows["node"][at]), pa.array(np.full(len(at), rows["cell"])), pa.array(rows["comp"][at]), pa.array(rows["shared"][at]), pa.array(rows["side"][at], pa.int32()), pa.array(times[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "cell", "comp", "shared", "side", "times"])


def _cross_linked(batches, least: float):
    """Links of the likely pairs of each cell; those that links of the cell join already are not compared."""
    for rows in _cells(batches, True):
        judge = _Judge(least, rows["node"], rows["comp"], rows["text"])
        for x, y, like in _crossed(rows, least):
            yield from _found(judge.links(x, y, like))


def _crowd_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Links among all pairs of different components that share a band within the cells of ``_open_cells``. A cell's members
    are dealt into blocks of bounded size by a hash, and each block meets each: first with fingerprints, then those of a
    likely pair with their texts. Nothing is left out: the pairs compared grow with the square of a cell, and what a task
    holds or sends doesn't."""
    blocks = F.greatest(F.ceil(F.col("rows") / F.lit(BLOCK_ROWS)), F.ceil(F.col("chars") / F.lit(CELL_CHARS))).cast("int")
    own, upto = F.col("own"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("with")
    side = F.when(own == F.col("with"), 2).when(own < F.col("with"), 0).otherwise(1)
    lesser, greater = F.least(own, "with"), F.greatest(own, "with")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.select("hub", "node", "comp", "shared", "own", upto("blocks"))
    dealt = dealt.select(F.xxhash64("hub", lesser, greater).alias("cell"), side.alias("side"), "node", "comp", "shared")
    tops = F.concat(*(F.substring("bands", 4 * k + 1, 2) for k in range(BANDS))).alias("tops")
    prints = lambda used: _of_nodes(nodes.select("doc_id", "n", "registers", tops), used).withColumnRenamed("doc_id", "node")
    met = dealt.join(prints(members.select("node")), "node").repartition("cell").sortWithinPartitions("cell")
    met = stored(met.mapInArrow(partial(_paired, least=least), "node long, cell long, comp long, shared long, side int, times long"), "paired-members")
    used = stored(met.select(F.col("node").alias("doc_id")).distinct(), "used")
    # Cells of many pairs are dealt anew, by their rows' hashes of another kind.
    sums = met.groupBy("cell").agg(F.sum("times").alias("times"))
    parts = stored(sums.select("cell", F.ceil(F.sqrt(F.col("times") / F.lit(2 * CELL_PAIRS))).cast("int").alias("parts"), "times"), "cell-parts")
    tasks = min(MOST_TASKS, 1 + (parts.agg(F.sum("times")).first()[0] or 0) // TASK_PAIRS)
    again = met.join(parts.select("cell", "parts"), "cell").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int"))
    again = again.select("cell", F.col("side").alias("was"), "node", "comp", "shared", "own", upto("parts"))
    i, j = (F.when(F.col("was") == 2, x).when(F.col("was") == 0, y).otherwise(z) for x, y, z in ((lesser, own, F.col("with")), (greater, F.col("with"), own)))
    again = again.select(F.xxhash64("cell", i, j).alias("cell"), F.when(F.col("was") == 2, side).otherwise(F.col("was")).alias("side"), "node", "comp", "shared")
    texts = _texts_of(docs, used).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "text")
    again = again.join(texts.join(prints(used), "node"), "node").repartition(tasks, "cell").sortWithinPartitions("cell", "node")
    return stored(again.mapInArrow(partial(_cross_linked, least=least), "a long, b long"), "cross-links")


def near_classes(prints: DataFrame, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``text_sha256, text_id, class_id, rows`` for each distinct text that is not empty: the least id that has it, the
    least id reachable over links, and how many rows have it.

    A link is a pair that shares a band, whatever number of texts share it, with a likeness of ``LIKE`` or more, and at
    most 1 - ``least`` of the longer text's length in ``aligned_distance``. Texts meet one of their bands' first texts;
    then, where members of a band still lie in several components, all its pairs of different components meet: listed where
    few texts share the band, else in blocks. Texts only move for pairs whose fingerprints allow a link. Rows repeated with one id are compared by one of
    their texts."""
    nodes = prints.filter("doc_id is not null and n_chars > 0").groupBy("text_sha256")
    nodes = nodes.agg(F.min("doc_id").alias("doc_id"), F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands"), F.first("n_chars").alias("n"), F.count("*").alias("rows"))
    nodes = stored(nodes.select("text_sha256", "doc_id", F.unhex("fingerprint").alias("registers"), "bands", "n", "rows"), "distinct-texts")
    members = shared_bands(nodes, least)
    comps = stored(nodes.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("comp")), "components")
    comps = setsketch.joined_components(comps, _links(_likely_pairs(_first_hubs(members), nodes, least), docs, least))
    named = stored(_with_comps(members.select("grp", "node", "n", "low", "band", "rows"), "node", comps), "named-members")
    links = _links(_likely_pairs(_small_pairs(named, least), nodes, least), docs, least)
    comps = setsketch.joined_components(comps, links.union(_crowd_links(_open_cells(named), nodes, docs, least)))
    return _with_comps(nodes.select("text_sha256", "doc_id", "rows"), "doc_id", comps).select("text_sha256", F.col("doc_id").alias("text_id"), F.col("comp").alias("class_id"), "rows")


def fingerprint_classes(docs: DataFrame) -> DataFrame:
    """The rows of ``fingerprint`` with ``text_id``, the least id with the same text, and ``class_id``, the least id
    reachable over verified links; both null for null ids and empty texts."""
    prints = _printed(docs, "doc_id", "text")
    named = stored(near_classes(prints, docs), "classes")
    total = named.agg(F.sum("rows")).first()[0] or 0
    hot = stored(hot_keys(named.select("text_sha256", "rows"), "text_sha256", total), "hot-texts")
    has = F.col("doc_id").isNotNull() & (F.col("n_chars") > 0)
    known = salted_join(prints.filter(has).select(*COLUMNS), named.select("text_sha256", "text_id", "class_id"), "text_sha256", "doc_id", hot)
    none = F.lit(None).cast("long")
    return known.select(*COLUMNS, "text_id", "class_id").unionByName(prints.filter(~has).select(*COLUMNS, none.alias("text_id"), none.alias("class_id")))
