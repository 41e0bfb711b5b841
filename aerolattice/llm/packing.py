"""Sequences of tokens, packed by sums of squares.

Each document is encoded and ended by one more id. Longer ones than a sequence are cut into full pieces, each a sequence by
itself, and one shorter piece at the front. These short pieces are the items to pack.

An item goes where the sum of the squared counts of open bins per residual gap becomes least: into an open bin of the gap
g that makes that so, or into a new bin. Many different gaps stay open that way, so that most items find an exact fit.
What it leaves open at the end is little, but not nothing. So:

1. items are dealt by a hash into groups of about ``GROUP``; within a group they come in seeded order, but for the smallest
   ``HELD`` of them, which come last, from large to small. Full bins stay as they are; the others are dissolved;
2. the items of dissolved bins, a sixth to a quarter of all, meet in groups of the same size and are packed in the same
   way. The bins that stay open there are dissolved once more and filled by best fit, from large to small; where best fit
   needs fewer bins for the whole group, it takes the whole group.

A task holds one group of numbers; no step sees all items.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import coder_of
from .common import slices, stored, text_or_empty

CAPACITY, END = 1024, 2
GROUP, HELD = 8192, 0.15
SLICE_BYTES = 1_000_000
FAR = np.iinfo(np.int64).max


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, in the order given, and the gap that each bin is left with."""
    count, open_bins = np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)]
    bins, gaps = np.empty(len(sizes), np.int64), []
    for k, size in enumerate(sizes.tolist()):
        best = FAR
        if size < capacity:
            # A bin of gap g turns into one of gap g - size: what that adds to the sum; a gap of 0 isn't counted.
            change = 1 - 2 * count[size:capacity]
            change[1:] += 1 + 2 * count[1 : capacity - size]
            change[count[size:capacity] == 0] = FAR
            at = int(change.argmin())
            best = int(change[at])
        if best < FAR and best <= 1 + 2 * count[capacity - size]:
            gap = size + at
            count[gap] -= 1
            number = open_bins[gap].pop()
        else:
            gap, number = capacity, len(gaps)
            gaps.append(0)
        left = gap - size
        gaps[number], bins[k] = left, number
        if left:
            count[left] += 1
            open_bins[left].append(number)
    return bins, np.array(gaps, np.int64)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item: from large to small, each into the open bin with the least gap that takes it."""
    bins, gaps, made = np.empty(len(sizes), np.int64), [], 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, number = gaps.pop(at)
        else:
            gap, number, made = capacity, made, made + 1
        if gap > size:
            insort(gaps, (gap - size, number))
        bins[k] = number
    return bins


def offsets(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each item's place in its bin: the sizes of the earlier items there."""
    by = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[by])
    first = np.concatenate([[True], bins[by][1:] != bins[by][:-1]]) if len(by) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, ends - sizes[by], 0))
    out = np.empty(len(by), np.int64)
    out[by] = ends - sizes[by] - base
    return out


def pack_group(sizes: np.ndarray, last: bool, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and offset of each item of a group, given in seeded order. In a group that isn't the ``last`` for its items,
    those of bins with a gap have bin -1."""
    small = np.argsort(sizes, kind="stable")[: int(HELD * len(sizes))]
    front = np.ones(len(sizes), bool)
    front[small] = False
    order = np.concatenate([np.flatnonzero(front), small[::-1]]).astype(np.int64)
    placed, gaps = sum_of_squares(sizes[order], capacity)
    bins = np.empty(len(sizes), np.int64)
    bins[order] = placed
    loose = gaps[bins] > 0
    if last and loose.any():
        again = best_fit(sizes[loose], capacity)
        if again.max() < (gaps > 0).sum():  # never more bins than the first way made
            bins[loose] = len(gaps) + again
        # A group of what bins with gaps left holds few small pieces, so best fit may do better with all of it.
        alone = best_fit(sizes, capacity)
        if alone.max() + 1 < len(np.unique(bins)):
            bins = alone
    elif not last:
        bins[loose] = -1
    return bins, offsets(bins, sizes)


def _pack_groups(items: DataFrame, last: bool, capacity: int) -> DataFrame:
    """``row, size, sequence_id, offset`` of ``items`` (row, size); without a sequence for items of dissolved bins."""
    import pandas as pd

    groups = max(1, -(-items.count() // GROUP))
    dealt = items.withColumn("key", F.xxhash64(F.lit("pack"), F.lit(last), "row")).withColumn("group", F.pmod("key", F.lit(groups)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "row"])
        bins, at = pack_group(rows["size"].to_numpy(np.int64), last, capacity)
        # Negative numbers; full pieces have the others. A group has far fewer than 2^24 bins.
        number = -1 - 2 * ((rows["group"].to_numpy(np.int64) << 24) + bins) - int(last)
        held = pd.Series(number, index=rows.index, dtype="Int64").mask(bins < 0)
        return pd.DataFrame({"row": rows["row"], "size": rows["size"], "sequence_id": held, "offset": at})

    return dealt.groupBy("group").applyInPandas(run, "row long, size long, sequence_id long, offset long")


def encoded_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """A row for each document: ``doc_id, row`` (a number of its own) ``, n`` (ids with the end) ``, first_full`` (the
    sequence number of its first full piece) ``, crcs`` (of each piece), with ``ids`` also the ids."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        coder, task = coder_of(spec.value), TaskContext.get().partitionId() << 36
        row = full = task
        for part in slices(batches, "text", SLICE_BYTES):
            flat, counts = coder.tokens(part.column("text").to_pylist())
            at = np.cumsum(counts) - counts
            firsts, crcs, every = [], [], []
            for a, n in zip(at.tolist(), counts.tolist()):
                own = np.append(flat[a : a + n], end).astype("<u4")
                head = len(own) % capacity
                cuts = [*([0] if head else []), *range(head, len(own) + 1, capacity)]
                crcs.append([zlib.crc32(own[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])])
                firsts.append(full)
                full += len(own) // capacity
                if ids:
                    every.append(own.astype(np.int32))
            rows = np.arange(row, row + len(counts))
            row += len(counts)
            columns = [part.column("doc_id"), pa.array(rows), pa.array(counts + 1), pa.array(firsts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            names = ["doc_id", "row", "n", "first_full", "crcs"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(every, pa.list_(pa.int32()))] if ids else [])], names=names + ["ids"] * ids)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row long, n long, first_full long, crcs array<long>" + ", ids array<int>" * ids)


def _placed(rows: DataFrame, capacity: int) -> DataFrame:
    """``rows`` of ``encoded_pieces`` (stored) with a row for each piece: ``piece, start, length, sequence_id, offset``."""
    items = rows.select("row", (F.col("n") % capacity).alias("size")).filter("size > 0")
    first = stored(_pack_groups(items, False, capacity), "packed")
    rest = stored(first.filter("sequence_id is null").select("row", "size"), "loose-items")
    found = first.filter("sequence_id is not null").unionByName(_pack_groups(rest, True, capacity)).select("row", "sequence_id", "offset")
    head = F.col("n") % capacity
    short = F.when(head > 0, F.array(F.struct(F.lit(0).cast("long").alias("start"), head.alias("length"), F.lit(-1).cast("long").alias("full")))).otherwise(F.array())
    every = F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / capacity) - 1)
    full = F.when(F.col("n") >= capacity, F.transform(every, lambda k: F.struct((head + k * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), k.alias("full")))).otherwise(F.array())
    pieces = rows.join(found, "row", "left").select(*rows.columns, "sequence_id", "offset", F.posexplode(F.concat(short, full)).alias("piece", "p"))
    own = F.col("p.full") >= 0
    sequence: Column = F.when(own, F.col("first_full") + F.col("p.full")).otherwise(F.col("sequence_id"))
    return pieces.select(
        *rows.columns, "piece", F.col("p.start").alias("start"), F.col("p.length").alias("length"),
        sequence.alias("sequence_id"), F.when(own, F.lit(0).cast("long")).otherwise(F.col("offset")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null text counts as empty: one piece of one id. Rows repeated with one id are packed each, null ids too. An empty table
    gives no rows; other columns are ignored. Texts stay where they are; numbers of 8 bytes a document are shuffled.
    """
    rows = stored(encoded_pieces(docs, tokenizer, capacity, end), "encoded-pieces")
    return _placed(rows, capacity).select("doc_id", "piece", "start", "length", F.element_at("crcs", F.col("piece") + 1).alias("ids_crc32"), "sequence_id", "offset")


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``sequence_id, ids, pieces``: a row for each packed sequence, with its ids and the documents and lengths of its pieces
    in order. Odd rows as in ``pack``. A sequence holds ``capacity`` ids at most."""
    rows = stored(encoded_pieces(docs, tokenizer, capacity, end, ids=True), "encoded-pieces")
    parts = _placed(rows, capacity).select("sequence_id", F.struct("offset", "doc_id", "length", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")).alias("part"))
    whole = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["length"].alias("length"))).alias("pieces"))
