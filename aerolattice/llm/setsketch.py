"""Near-duplicates by SetSketch registers.

A document's set of five-word shingles is sketched by ``REGISTERS`` registers: register i holds the exponentially spaced
level of the least of exponential variates that the shingles draw, truncated to 16 bits. Registers of a union are the
larger of two, so sketches merge; and they are locality-sensitive, so bands of registers find candidates. A pair's
Jaccard similarity is then estimated jointly, by the likelihood of how many registers are larger, smaller and equal
given the sets' sizes; pairs that the estimate can't rule out are verified on full sets.

Links are found without listing the pairs of a bucket. Documents with one set are one node. Each bucket's members meet
its first member ("hub"); verified links give components. Only hubs whose members then lie in several components go
on: members outside the hub's own component meet all others of that hub, in blocks of bounded size, and only verified
links leave a block. Pairs within one component are never compared, as their links can't change the result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, hot_keys, marked_by, row_columns, salted_join, slices, stored, text_or_empty

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union, unless the caller gives another percentage.
PERCENT = 85
#: 32 bands of 4 registers miss a pair at 0.85 with probability (1 - 0.85^4)^32 = 5e-11, at 0.80 with 5e-8.
REGISTERS, BANDS = 128, 32
BASE, RATE, LEVELS = 1.001, 20.0, 65534
#: A pair goes on to verification unless the likelihood at the threshold is below the largest one by more than this
#: (natural log): about six standard deviations.
SLACK = 18.0
SLICE_BYTES, BLOCK_ROWS = 1_000_000, 256

_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(1, 2**63, REGISTERS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(1, 2**63, REGISTERS).astype(np.uint64)
_BYTE = _RNG.integers(1, 2**63, 256).astype(np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = None
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a lower-cased text, all at once: sums of byte values times powers of a constant."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    inside = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else None
    if inside is None:
        b, gap, ends, starts = b[starts[0] :], gap[starts[0] :], ends - starts[0], starts - starts[0]
        inside = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    value = np.where(gap, np.uint64(0), _mixed(_BYTE[b] + inside.astype(np.uint64) * _P))
    return _mixed(np.add.reduceat(value, starts) + length.astype(np.uint64))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles; of all its words, if it has fewer; empty without words."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = _mixed(out * _P + words[k : k + n])
    return np.unique(out + np.uint64(min(len(words), SHINGLE)))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Register levels (sets x ``REGISTERS``) of non-empty sets."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for i in range(REGISTERS):
        least = np.minimum.reduceat(((flat ^ _FLIP[i]) * _ODD[i]) >> np.uint64(24), starts)
        draw = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**40) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(draw) / np.log(BASE)), 0, LEVELS + 1)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def _log_likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of similarity ``j``, where ``u`` and ``v`` are the sets' shares of their summed sizes."""
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))


def plausible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the joint estimate leaves room for the threshold: the sizes allow it, and the likelihood there, or at a
    larger similarity, is close to the largest."""
    na, nb = np.asarray(na, float), np.asarray(nb, float)
    top, least = np.minimum(na, nb) / np.maximum(na, nb), percent / 100
    more, less = (ra > rb).sum(axis=-1), (ra < rb).sum(axis=-1)
    same = ra.shape[-1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0, 1, 41)[:, None]
    all_j = _log_likelihood(grid * top * 0.9999, u, v, more, less, same).max(axis=0)
    near_j = _log_likelihood(least + grid[::8] * np.maximum(top * 0.9999 - least, 0), u, v, more, less, same).max(axis=0)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (all_j - near_j <= SLACK)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on full sets, in integers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _sketch_rows(batches):
    import xxhash

    for part in slices(batches, "text", SLICE_BYTES):
        sets = [shingles(t) for t in part.column("text").to_pylist()]
        full = [s for s in sets if len(s)]
        made = iter(registers(full)) if full else iter(())
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        regs = [next(made).tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())],
            names=["doc_id", "text_key", "n_shingles", "set_key", "registers"],
        )


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key`` (a hash that tells texts with one id apart) ``, n_shingles, set_key`` (a 128-bit digest of the
    set) ``, registers`` of whole texts; the last two are null for empty sets."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(_sketch_rows, "doc_id long, text_key long, n_shingles long, set_key binary, registers binary")


def _sets(batches):
    for part in slices(batches, "text", SLICE_BYTES):
        sets = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _unpack(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _verify_pairs(batches, percent: int = PERCENT):
    """Pairs with both sides' sizes, registers and sets in; verified links out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ra, rb = (np.stack(_unpack(batch.column(c), np.uint16)) for c in ("ra", "rb"))
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        maybe = np.flatnonzero(plausible(ra, rb, na, nb, percent))
        sa, sb = batch.column("sa"), batch.column("sb")
        keep = [k for k in maybe if linked(np.frombuffer(sa[int(k)].as_py(), np.uint64), np.frombuffer(sb[int(k)].as_py(), np.uint64), percent)]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])


def _unpack_set(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _compare_blocks(batches, percent: int = PERCENT, likely=plausible, same=linked, unpack=_unpack_set, joins: bool = True):
    """Rows sorted by block pair, left side first. A pair of blocks is compared when its rows are complete. ``likely``
    judges registers and sizes, ``same`` what ``unpack`` makes of the last column. Components that a link joins within
    a block are not compared again there, unless pairs found are no links yet (``joins`` false)."""
    key, rows = None, []

    def done():
        left, right = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
        inner = not right  # one block against itself
        right = left if inner else right
        found: list[tuple[int, int]] = []
        if not left or not right:
            return found
        n, comp = np.array([r[4] for r in right]), np.array([r[3] for r in right])
        own_comp = comp if inner else np.array([r[3] for r in left])
        regs = np.stack([np.frombuffer(r[5], np.uint16) for r in right])
        sets = [unpack(r[6]) for r in right]
        for k, r in enumerate(left):
            own, mine = np.frombuffer(r[5], np.uint16), unpack(r[6])
            # In one group and out of it: the same component has nothing to add.
            others = np.flatnonzero(comp != own_comp[k])
            others = others[others > k] if inner else others
            if not len(others):
                continue
            maybe = others[likely(np.broadcast_to(own, regs[others].shape), regs[others], np.full(len(others), r[4]), n[others], percent)]
            for m in maybe:
                if comp[m] != own_comp[k] and same(mine, sets[m], percent):
                    found.append((r[2], right[m][2]))
                    if not joins:
                        continue
                    old = comp[m]
                    comp[comp == old] = own_comp[k]
                    own_comp[own_comp == old] = own_comp[k]
        return found

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        found: list[tuple[int, int]] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "side", "node", "comp", "n", "registers", "shingles"))):
            if row[0] != key:
                found += done()
                key, rows = row[0], []
            rows.append(row)
        if found:
            yield batch_of(found)
    if rows and (found := done()):
        yield batch_of(found)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, comp``: the least node reachable over ``links`` (a, b). Labels take the least of their neighbours' and
    then jump to their label's label, so the rounds grow with the logarithm of a component's width. Each round's labels
    are written to the shared folder; only the nodes that have links take part."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("other", "comp")).alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        fresh = stored(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("above", "comp")).alias("comp")), "labels")
        labels = fresh.select("node", "comp")
        if not fresh.filter("old <> comp").limit(1).count():
            break
    return nodes.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def near_links(docs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(nodes, comps)``: nodes are the distinct sets (``node, doc_id, text_key, rows, n, set_key, registers``; the id is
    the least that has the set), comps their components (``node, comp``)."""
    nodes = sketches.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key")
    nodes = nodes.agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    # Numbered once, as the table is written; all later steps read these numbers.
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "first.doc_id", "first.text_key", "rows", "n", "set_key", "registers"), "nodes")
    width = 2 * REGISTERS // BANDS
    bands = F.array(*(F.xxhash64(F.lit(k), F.substring("registers", k * width + 1, width)) for k in range(BANDS)))
    keyed = nodes.select("node", F.explode(bands).alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("rows")).filter("rows > 1").select("band", "hub")
    pairs = stored(keyed.join(hubs, "band").filter("node <> hub").select("hub", "node").distinct(), "pairs")
    hot = hot_hubs(pairs)

    # Full sets of the documents that share a bucket with another, from their whole texts. The ids grow with the corpus:
    # they are never broadcast, but for a bitmap of bounded size that keeps the other texts where they are.
    used = pairs.select(F.col("hub").alias("node")).union(pairs.select("node")).distinct()
    used = stored(nodes.join(used.hint("merge"), "node").select("node", "doc_id", "text_key"), "used")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = marked_by(texts, "doc_id", used.select("doc_id")).filter("_maybe").withColumn("text_key", F.xxhash64("text"))
    sets = texts.join(used.hint("merge"), ["doc_id", "text_key"]).select("node", "text").mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"])
    full = stored(nodes.join(sets, "node").select("node", "n", "registers", "shingles"), "sets")

    side = lambda s, name: full.select(F.col("node").alias(name), F.col("n").alias(f"n{s}"), F.col("registers").alias(f"r{s}"), F.col("shingles").alias(f"s{s}"))
    tried = pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).join(side("b", "b"), "b")
    tried = salted_join(tried, side("a", "a"), "a", "b", hot.withColumnRenamed("hub", "a"))
    links = stored(tried.select("a", "b", "na", "nb", "ra", "rb", "sa", "sb").mapInArrow(partial(_verify_pairs, percent=percent), "a long, b long"), "star-links")
    comps = stored(components(nodes.select("node"), links), "components")

    more = stored(_cross_links(pairs, full, comps, partial(_compare_blocks, percent=percent), hot), "cross-links")
    return nodes, joined_components(comps, more)


def hot_hubs(pairs: DataFrame) -> DataFrame:
    """Hubs with many of the stored pairs, for ``salted_join``."""
    return stored(hot_keys(pairs.groupBy("hub").agg(F.count("*").alias("rows")), "hub", pairs.count()), "hot-hubs")


def joined_components(comps: DataFrame, more: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after the links ``more`` (a, b) between their nodes."""
    if more.limit(1).count():
        # Links between components: the components are the nodes now.
        of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
        joined = more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        upper = components(comps.select(F.col("comp").alias("node")).distinct(), joined).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        comps = stored(comps.join(upper, "comp").select("node", F.col("top").alias("comp")), "components")
    return comps


def _cross_links(pairs: DataFrame, full: DataFrame, comps: DataFrame, compare, hot: DataFrame) -> DataFrame:
    """Links between members of one hub that lie in different components.

    The members in the hub's own component are its major side. Both sides are dealt into blocks of about ``BLOCK_ROWS``
    by a hash; each minor block meets every minor block from itself on, and every major block.
    """
    hubs = pairs.select("hub").distinct()
    members = pairs.select("hub", "node").union(hubs.select("hub", F.col("hub").alias("node"))).join(comps, "node")
    hub_comps = hubs.join(comps.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "hub")
    members = salted_join(members, hub_comps, "hub", "node", hot).withColumn("minor", F.col("comp") != F.col("hub_comp"))
    members = stored(members.select("hub", "node", "comp", "minor"), "members")
    sizes = members.groupBy("hub").agg(F.count_if("minor").alias("minors"), F.count_if(~F.col("minor")).alias("majors")).filter("minors > 1 or (minors > 0 and majors > 1)")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(BLOCK_ROWS))).cast("int")
    sizes = sizes.select("hub", blocks("minors").alias("bi"), blocks("majors").alias("bj"))
    dealt = salted_join(members, sizes, "hub", "node", hot).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("bi")).otherwise(F.col("bj"))).cast("int"))
    meet = lambda i, j, kind, side: F.struct(F.concat_ws(":", F.col("hub").cast("string"), F.lit(kind), i.cast("string"), j.cast("string")).alias("block"), F.lit(side).alias("side"))
    own, upto = F.col("own"), lambda n: F.sequence(F.lit(0), n - 1)
    minor = F.concat(
        F.transform(upto(F.col("bj")), lambda j: meet(own, j, "x", 0)),
        F.transform(F.sequence(F.lit(0), own), lambda i: F.when(i == own, meet(own, own, "i", 0)).otherwise(meet(i, own, "i", 1))),
        F.transform(F.filter(upto(F.col("bi")), lambda j: j > own), lambda j: meet(own, j, "i", 0)),
    )
    major = F.transform(upto(F.col("bi")), lambda i: meet(i, own, "x", 1))
    rows = dealt.select("node", "comp", F.explode(F.when(F.col("minor"), minor).otherwise(major)).alias("m")).select("node", "comp", "m.block", "m.side")
    rows = rows.join(full, "node").select("block", "side", "node", "comp", "n", "registers", "shingles")
    return rows.repartition("block").sortWithinPartitions("block", "side", "node").mapInArrow(compare, "a long, b long").distinct()


def verdicts(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``near_duplicates`` with ``text_key``."""
    sketches = stored(sketch(docs), "sketches")
    nodes, comps = near_links(docs, sketches, percent)
    # A component's id is the least id of its sets' rows.
    members = stored(nodes.select("node", "set_key", "doc_id", "rows").join(comps, "node"), "members")
    heads = stored(members.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")), "heads")
    classes = salted_join(members.select("comp", "set_key"), heads.select("comp", "component_id"), "comp", "set_key", hot_keys(heads, "comp", nodes.count()))
    known = sketches.filter("set_key is not null and doc_id is not null").select("doc_id", "text_key", "n_shingles", "set_key")
    found = salted_join(known, classes.select("set_key", "component_id"), "set_key", "doc_id", hot_keys(nodes, "set_key", sketches.count()))
    alone = sketches.filter("set_key is null or doc_id is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    out = found.select("doc_id", "text_key", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each input row: ``doc_id, n_shingles, component_id, kept``.

    Documents link when 100 * shared shingles >= ``percent`` * all shingles of both; links are exact on the pairs that
    share a band (at the threshold, all but 5e-11 of them for 85 and 5e-8 for 80). Sets are compared as 64-bit hashes of
    their shingles, and sets with one 128-bit digest are taken as equal. ``component_id`` is the least id reachable.
    Documents without words or text are linked with nothing; null ids get no component and are kept. An id doesn't link
    rows: rows with one id and several texts are judged each by its own text, rows with one id and text alike. An empty
    table gives no rows; other columns are ignored. Ids are whole numbers, or texts of such.
    """
    return verdicts(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component; columns unchanged. Only rows whose id may be that of a dropped row
    are shuffled."""
    gone = stored(verdicts(docs, percent).filter("not kept").select("doc_id", "text_key").distinct(), "near-copies")
    marked = marked_by(docs.select(as_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_key")), "doc_id", gone.select("doc_id"))
    maybe = marked.filter("_maybe").select("row", "doc_id", "text_key").join(gone.withColumn("gone", F.lit(True)), ["doc_id", "text_key"], "left").filter("gone is null")
    return marked.filter("not _maybe").select("row").union(maybe.select("row")).select(*row_columns(docs))
