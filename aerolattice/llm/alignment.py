"""Alignment of two tokenizers over a corpus, with an identity map for tokens of equal bytes.

A text is encoded by a byte-level vocabulary (A) and by a piece model (B). The byte offsets where tokens of either end cut
it into intervals; each interval lies in one A token and one B token, and these link. Offsets where both end close a group.

A pair's count is the number of documents that hold it linked, over the whole corpus. Most links join an A token with the B
token of the same bytes. For them an array gives each A id its B id, so documents are counted in vectors as long as the
vocabulary, one for each task. Only the pairs of irregular groups are shuffled, each once for a slice of documents with
the number of documents that hold it:

1. each slice is encoded and aligned; a row of it keeps the documents' numbers and, as arrays, their identity tokens and
   the places of their irregular pairs in the slice's list of pairs;
2. the lists are summed by pair. The vector of identity counts and each A id's highest count, both as long as the
   vocabulary, go to all tasks; the counts of irregular pairs go back to the slices that hold them;
3. each slice adds up its documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE, Bpe, Coder, Numbers, spread
from .common import hot_keys, slices, stored, text_or_empty

SLICE_BYTES = 2_000_000
#: A pair is one number: the A id above these bits, the B id below.
B_BITS = 20
_KEPT: dict[int, "Aligner"] = {}


class Pieces:
    """A piece model; remembers the ids of a bounded number of chunks. A chunk is a run of blanks and what follows up to the
    next blank. Where no piece holds a blank behind another sign and the model keeps texts as they are, merges don't cross
    chunks; for other models a text is one chunk."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [self._bytes(i, name) for i, name in enumerate(names)]
        self.byte_sizes = np.array(list(map(len, self.bytes)), np.int64)
        probe = "ﬁ Ａ  b  \t c "
        plain = b"".join(self.bytes[i] for i in self.model.encode(probe)) == (" " + probe).encode()
        self.cut = re.compile(" +[^ ]*").findall if plain and not any(re.search("[^▁]▁", name) for name in names) else lambda text: [text]
        self.last_blank = self.model.encode("a ")[len(self.model.encode("a")) :]
        self.forget()

    def _bytes(self, i: int, name: str) -> bytes:
        return bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()

    def forget(self) -> None:
        self.number, self.ids, self.sizes, self.exact = Numbers({}), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, new: list[str]) -> None:
        ids = [x if len(c) > 1 else self.last_blank for c, x in zip(new, self.model.encode([c[1:] for c in new], num_threads=1))]
        exact = [b"".join([self.bytes[i] for i in x]) == c.encode("utf-8", "surrogatepass") for c, x in zip(new, ids)]
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32)])
        self.sizes, self.exact = np.concatenate([self.sizes, np.array(list(map(len, ids)), np.int64)]), np.concatenate([self.exact, np.array(exact, bool)])

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that begin with a blank: all ids in one array, their number in each text, and whether the bytes of a
        text's tokens are the text."""
        if len(self.number) > CACHE:
            self.forget()
        cut = [self.cut(text) for text in texts]
        counts = np.array([len(x) for x in cut], np.int64)
        found = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int32, int(counts.sum()))
        if new := self.number.take_new():
            self.learn(new)
        at = np.concatenate([[0], np.cumsum(counts)])
        sizes = self.sizes[found]
        wrong = np.concatenate([[0], np.cumsum(~self.exact[found])])[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[at]
        return self.ids[spread((np.cumsum(self.sizes) - self.sizes)[found], sizes)], np.diff(ends), np.diff(wrong) == 0


class Aligner:
    """Both tokenizers, and the B id of each A id's bytes (-1 without one; a piece goes before a single byte's id)."""

    def __init__(self, spec: str, model: bytes):
        self.a = Coder(Bpe(json.dumps(json.loads(spec) | {"added_tokens": []})))  # special strings are plain text here
        self.b = Pieces(model)
        by_bytes = {x: i for i, x in sorted(enumerate(self.b.bytes), key=lambda p: not self.b.model.is_byte(p[0]))}
        self.same = np.array([by_bytes.get(self.a.bpe.token_bytes.get(i, b""), -1) for i in range(len(self.a.byte_sizes))], np.int32)
        names = [b"%d," % i for i in range(len(self.b.bytes))]
        self.digits, self.digit_sizes = np.frombuffer(b"".join(names), np.uint8), np.array(list(map(len, names)))
        self.digit_starts = np.cumsum(self.digit_sizes) - self.digit_sizes

    @staticmethod
    def of(spec: str, model: bytes) -> "Aligner":
        """The tokenizers that this process has read before, else read now."""
        key = hash((spec, model))
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Aligner(spec, model)
        return _KEPT[key]

    def align(self, texts: list[str]) -> "Aligned":
        known = [k for k, t in enumerate(texts) if t]
        if known:
            flat_b, n_b, exact = self.b.tokens([" " + texts[k] for k in known])
            if not exact.all():  # the others' tokens stay where they are
                flat_b, n_b, known = flat_b[np.repeat(exact, n_b)], n_b[exact], [k for k, e in zip(known, exact) if e]
        if not known:
            none = np.zeros(0, np.int64)
            return Aligned(len(texts), known, *[none] * 4)
        flat_a, n_a = self.a.tokens([" " + texts[k] for k in known])
        return Aligned(len(texts), known, flat_a, n_a, flat_b, n_b, self.a.byte_sizes, self.b.byte_sizes)


class Aligned:
    """The tokens of some texts and their links. Numbers are for the texts ``known``; the others have no tokens."""

    def __init__(self, size, known, flat_a, n_a, flat_b, n_b, sizes_a=None, sizes_b=None):
        self.size, self.known, self.a, self.b, self.n_a, self.n_b = size, known, flat_a, flat_b, n_a, n_b
        if not len(known):
            self.link_a = self.link_b = self.link_doc = self.n_groups = self.n_links = np.zeros(0, np.int64)
            return
        ends_a, ends_b = np.cumsum(sizes_a[flat_a]), np.cumsum(sizes_b[flat_b])
        mark = np.zeros((2, int(ends_a[-1]) + 1), bool)
        mark[0, ends_a] = True
        mark[1, ends_b] = True
        ends = np.flatnonzero(mark[0] | mark[1])
        in_a, in_b = mark[0, ends], mark[1, ends]
        self.link_a, self.link_b = flat_a[np.cumsum(in_a) - in_a], flat_b[np.cumsum(in_b) - in_b]
        both = in_a & in_b
        text_ends = ends_a[np.cumsum(n_a) - 1]
        upto = np.searchsorted(ends, text_ends, side="right")
        self.n_links = np.diff(np.concatenate([[0], upto]))
        self.n_groups = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(both)])[upto]]))
        self.link_doc = np.repeat(np.arange(len(known)), self.n_links)
        self.close_a, self.close_b = mark[1, ends_a], mark[0, ends_b]

    def lines(self, aligner: Aligner) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each known text."""
        if not self.known:
            return []
        group_a, group_b = np.cumsum(self.close_a) - self.close_a, np.cumsum(self.close_b) - self.close_b
        count_a, count_b = np.bincount(group_a), np.bincount(group_b)
        # Each group's A tokens, then its B tokens.
        place_a = np.arange(len(self.a)) + (np.cumsum(count_b) - count_b)[group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(count_a)[group_b]
        coder = aligner.a
        sizes, starts = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.int64)
        sizes[place_a], sizes[place_b] = coder.digit_sizes[self.a], aligner.digit_sizes[self.b]
        starts[place_a], starts[place_b] = coder.digit_starts[self.a], len(coder.digits) + aligner.digit_starts[self.b]
        out = np.concatenate([coder.digits, aligner.digits])[spread(starts, sizes)]
        ends = np.cumsum(sizes)
        out[ends[place_a[self.close_a]] - 1] = ord("|")
        out[ends[place_b[self.close_b]] - 1] = ord(";")
        cuts = np.concatenate([[0], ends[np.cumsum(self.n_a + self.n_b) - 1]]).tolist()
        whole = out.tobytes()
        return [whole[i : j - 1] for i, j in zip(cuts, cuts[1:])]

    def spread_over_all(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        out[self.known] = values
        return out


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and how often each comes."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


ARRAYS = ("identity_ends", "identity", "identity_times", "irregular_ends", "irregular", "irregular_times")
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _slice_arrays(found: Aligned, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The slice's irregular pairs, how many documents hold each, how many documents hold each A id's identity pair, and
    for the documents the arrays that ``ARRAYS`` names."""
    docs = len(found.known)
    alike = same[found.link_a] == found.link_b if docs else np.zeros(0, bool)
    keys, times = _counted(found.link_doc[alike] * len(same) + found.link_a[alike])
    doc, a = np.divmod(keys, len(same))
    arrays = [np.cumsum(np.bincount(doc, minlength=docs)), a, times]
    pairs, place = np.unique((found.link_a[~alike].astype(np.int64) << B_BITS) | found.link_b[~alike], return_inverse=True)
    keys, times = _counted(found.link_doc[~alike] * max(len(pairs), 1) + place)
    doc, place = np.divmod(keys, max(len(pairs), 1))
    arrays += [np.cumsum(np.bincount(doc, minlength=docs)), place, times]
    return pairs, np.bincount(place, minlength=len(pairs)), np.bincount(a, minlength=len(same)), [x.astype(np.uint32) for x in arrays]


def _read_files(docs: DataFrame, byte_tokenizer: str, piece_model: str):
    with open(byte_tokenizer, encoding="utf-8") as f:
        spec = f.read()
    with open(piece_model, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((spec, f.read()))


def _aligned_slices(docs: DataFrame, files, id_col: str, text_col: str) -> DataFrame:
    """A row for each slice; and at the end of each task one with ``slice`` null, whose ``pairs`` are A ids and whose
    ``holders`` are the numbers of documents that hold their identity pairs."""
    kind = dict(docs.dtypes)[id_col]
    kinds = {"slice": pa.int64(), "pairs": pa.list_(pa.int64()), "holders": pa.list_(pa.int64()), "known": pa.binary()} | dict.fromkeys(ARRAYS, pa.binary())
    kinds |= dict.fromkeys(NUMBERS, pa.list_(pa.int64())) | {"groups_sha256": pa.list_(pa.string())}

    def row(values: dict, ids: pa.ListArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values.get(k)], t) for k, t in kinds.items()] + [ids], names=[*kinds, "doc_ids"])

    def run(batches):
        aligner, task = Aligner.of(*files.value), TaskContext.get().partitionId() << 32
        vector, k, ids = np.zeros(len(aligner.same), np.int64), 0, None
        for part in slices(batches, "text", SLICE_BYTES):
            found = aligner.align(part.column("text").to_pylist())
            pairs, holders, own, arrays = _slice_arrays(found, aligner.same)
            vector += own
            shas = np.full(found.size, "", object)
            shas[found.known] = [hashlib.sha256(x).hexdigest() for x in found.lines(aligner)]
            values = {"slice": task + k, "pairs": pairs, "holders": holders, "known": np.array(found.known, np.uint32).tobytes(), "groups_sha256": shas}
            values |= {name: x.tobytes() for name, x in zip(ARRAYS, arrays)}
            values |= {name: found.spread_over_all(getattr(found, name)) for name in NUMBERS}
            ids = part.column("doc_id")
            yield row(values, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
            k += 1
        if k:
            held = np.flatnonzero(vector)
            yield row({"pairs": held, "holders": vector[held]}, pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), ids.slice(0, 0)))

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = ["slice long", "pairs array<long>", "holders array<long>", "known binary", *(f"{x} binary" for x in ARRAYS), *(f"{x} array<long>" for x in NUMBERS), "groups_sha256 array<string>", f"doc_ids array<{kind}>"]
    return rows.mapInArrow(run, ", ".join(schema))


def _identity_counts(aligned: DataFrame) -> DataFrame:
    """``a, n_docs`` of identity pairs, from the tasks' vectors."""
    return aligned.filter("slice is null").select(F.explode(F.arrays_zip(F.col("pairs").alias("a"), F.col("holders").alias("n"))).alias("p")).groupBy("p.a").agg(F.sum("p.n").alias("n_docs"))


def _irregular_rows(aligned: DataFrame) -> DataFrame:
    return aligned.filter("slice is not null").select("slice", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "p")).select("slice", "place", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))


def _irregular_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n_docs, rows`` (slices that hold it)."""
    return _irregular_rows(aligned).groupBy("pair").agg(F.sum("holders").alias("n_docs"), F.count("*").alias("rows"))


def align(docs: DataFrame, byte_tokenizer: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Null and empty texts, and texts whose tokens' bytes aren't the text behind a blank, have zeros and the empty string.
    Rows repeated with one id are documents of their own, null ids too. An empty table gives no rows; other columns are
    ignored. Counts cover all rows. A pair that many slices hold finds its count by a broadcast of such pairs, of bounded
    number. What reaches the driver is two vectors as long as the vocabulary.
    """
    files = _read_files(docs, byte_tokenizer, piece_model)
    aligned = stored(_aligned_slices(docs, files, id_col, text_col), "aligned-slices")
    counts = stored(_irregular_counts(aligned), "pair-counts")
    identity = {r.a: r.n_docs for r in _identity_counts(aligned).collect()}
    best = {r.a: r.best for r in counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n_docs").alias("best")).collect()}
    size = 1 + max(identity.keys() | best.keys(), default=0)
    vectors = np.zeros((2, size), np.int64)
    for k, found in enumerate((identity, best)):
        vectors[k, list(found.keys())] = list(found.values())
    vectors[1] = vectors.max(axis=0)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = stored(hot_keys(counts, "pair", total).select("pair").join(counts.select("pair", "n_docs"), "pair"), "hot-pairs")
    rows = _irregular_rows(aligned).select("slice", "place", "pair").join(F.broadcast(hot.withColumnRenamed("n_docs", "hot")), "pair", "left")
    cold = rows.filter("hot is null").join(counts.select("pair", "n_docs").hint("merge"), "pair").select("slice", "place", "n_docs")
    rows = cold.unionByName(rows.filter("hot is not null").select("slice", "place", F.col("hot").alias("n_docs")))
    looked_up = rows.groupBy("slice").agg(F.collect_list(F.struct("place", "n_docs")).alias("found"))
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        count, best = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                lists = {name: part.column(name).flatten() for name in (*NUMBERS, "groups_sha256", "doc_ids", "pairs", "found")}
                known = np.frombuffer(part.column("known")[0].as_py(), np.uint32)
                ends_1, a, times_1, ends_2, place, times_2 = (np.frombuffer(part.column(name)[0].as_py(), np.uint32).astype(np.int64) for name in ARRAYS)
                of_pair = np.zeros(len(lists["pairs"]), np.int64)
                if len(lists["found"]):
                    of_pair[lists["found"].field("place").to_numpy()] = lists["found"].field("n_docs").to_numpy()
                is_best = of_pair == best[lists["pairs"].to_numpy() >> B_BITS]
                n_best, count_sum = np.zeros((2, len(lists["doc_ids"])), np.int64)
                for ends, times, values, tops in ((ends_1, times_1, count[a], count[a] == best[a]), (ends_2, times_2, of_pair[place], is_best[place])):
                    upto = lambda x: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]]))  # noqa: B023, E731
                    n_best[known] += upto(times * tops)
                    count_sum[known] += upto(times * values)
                yield pa.RecordBatch.from_arrays([lists["doc_ids"], *(lists[n] for n in NUMBERS), pa.array(n_best), pa.array(count_sum), lists["groups_sha256"]], names=["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"])

    whole = aligned.filter("slice is not null").drop("holders").join(looked_up.hint("merge"), "slice", "left")
    return whole.select("doc_ids", *NUMBERS, "groups_sha256", "known", *ARRAYS, "pairs", "found").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{x} long' for x in NUMBERS)}, n_best long, count_sum long, groups_sha256 string")


def pair_counts(docs: DataFrame, byte_tokenizer: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a_id, b_id, n_docs``: all linked pairs of the corpus with the number of documents that hold them. Odd rows as in
    ``align``."""
    files = _read_files(docs, byte_tokenizer, piece_model)
    aligned = stored(_aligned_slices(docs, files, id_col, text_col), "aligned-slices")
    same = docs.sparkSession.createDataFrame([(a, int(b)) for a, b in enumerate(Aligner.of(*files.value).same) if b >= 0], "a long, b_id long")
    plain = _identity_counts(aligned).join(same, "a").select(F.col("a").alias("a_id"), "b_id", "n_docs")
    return plain.unionByName(_irregular_counts(aligned).select(F.shiftright("pair", B_BITS).alias("a_id"), F.expr(f"pair & {(1 << B_BITS) - 1}").alias("b_id"), "n_docs"))


def aligned_groups(docs: DataFrame, byte_tokenizer: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, groups``: each text's groups as ``a1,a2|b1;a3|b2,b3``; empty for texts without tokens."""
    files = _read_files(docs, byte_tokenizer, piece_model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        aligner = Aligner.of(*files.value)
        for part in slices(batches, "text", SLICE_BYTES):
            found = aligner.align(part.column("text").to_pylist())
            lines = np.full(found.size, "", object)
            lines[found.known] = [x.decode() for x in found.lines(aligner)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lines, pa.string())], names=["doc_id", "groups"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, groups string")
