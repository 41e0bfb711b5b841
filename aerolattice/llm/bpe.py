"""Byte-level BPE encoding and decoding with a pair occurrence index.

The pieces of a slice of a partition are laid out in one array of symbols, each distinct piece once. An index maps the
adjacent pairs that can merge to all their places, kept by blocks of ranks. Blocks are taken in ascending order; within
one, each piece's lowest active rank is applied to all its places, and every merge adds the two pairs that it makes to
the index. A merge can only make pairs of higher rank (its product did not exist before), so one ascending sweep gives
the encoding; pieces don't touch each other, so all pieces advance together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Texts of one slice, and pieces that a task remembers.
SLICE_BYTES, CACHE = 1_000_000, 250_000
#: Kinds of code points for the splitter.
LETTER, NUMBER, WHITE, OTHER = range(4)
# Fixed value: contractions that the pre-tokeniser of this family keeps as pieces, in its order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def ascending(places: np.ndarray) -> np.ndarray:
    """Distinct places in ascending order, by sorting (``np.unique`` hashes them, which is slower)."""
    places = np.sort(places)
    return places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next code point from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Splitter:
    """The byte-level pre-tokeniser: runs of letters, of numbers, of other signs, each with the one blank before it;
    other white space by itself, where the last sign before a run stands alone; and contractions after an apostrophe.
    Kinds follow the ``regex`` module's Unicode tables."""

    def __init__(self):
        import regex

        every = np.delete(np.arange(0x110000, dtype=np.uint32), np.s_[0xD800:0xE000]).tobytes().decode("utf-32-le")
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for run in regex.finditer(pattern, every):
                self.kind[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind

    def __call__(self, text: str) -> list[str]:
        if not text:
            return []
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kind[code]
        cut = np.empty(len(code), bool)
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        runs = np.flatnonzero(cut)
        last = runs[1:][kind[runs[:-1]] == WHITE] - 1  # the last white sign before another run
        cut[last] = True
        cut[last[code[last] == ord(" ")] + 1] = False
        for at in np.flatnonzero((code[:-1] == ord("'")) & cut[:-1] & (kind[1:] == LETTER)).tolist():
            size = next((len(c) for c in CONTRACTIONS if text.startswith(c, at + 1)), 0)
            if size:
                cut[at + 1] = False
                cut[at + 1 + size : at + 2 + size] = True
        ends = np.flatnonzero(cut).tolist()
        ends.append(len(text))
        return [text[i:j] for i, j in zip(ends, ends[1:])]


class Bpe:
    """A vocabulary read from a tokenizer file's JSON text, with its merges by pair.

    Raises ValueError where the file isn't plain byte-level BPE (another pre-tokeniser, decoder, normaliser, prefix
    blanks, word affixes): its texts would be split or spelled otherwise."""

    def __init__(self, spec: str):
        import regex

        spec = json.loads(spec)
        check_byte_level(spec)
        vocab = spec["model"]["vocab"]
        stand_in = byte_symbols()
        back = {c: b for b, c in enumerate(stand_in)}
        self.byte_ids = np.array([vocab[c] for c in stand_in], np.int32)
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pair_keys, first = np.unique([(vocab[a] << 20) | vocab[b] for a, b in merges], return_index=True)
        self.pair_ranks = first.astype(np.int32)
        self.none = len(merges)  # the rank of a pair that doesn't merge
        low, high = np.divmod(np.arange(65536), 256)
        self.byte_ranks = self.ranks(self.byte_ids[low], self.byte_ids[high])
        #: Blocks of ranks, each twice as long as the one before, at most 4,096; and the block of each rank.
        sizes = [min(64 << k, 4096) for k in range(self.none // 4096 + 9)]
        self.block_of = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[: self.none]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.pieces = Splitter()
        names = sorted(self.special, key=len, reverse=True)
        cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.split = lambda text: cut(text) if any(name in text for name in names) else [text]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols, ``none`` where a pair doesn't merge."""
        keys = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(self.none))

    def merge(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and the number of ids of each, by one sweep over their pair
        occurrence index."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        size, ends = len(data), np.cumsum(sizes)
        if not size:
            return np.zeros(0, np.int32), sizes
        symbols, owner = self.byte_ids[data], np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        after[ends - 1], before[ends - sizes] = -1, -1
        rank = np.full(size, self.none, np.int32)  # of the pair that starts at a place
        rank[:-1] = self.byte_ranks[data[:-1].astype(np.int32) << 8 | data[1:]]
        rank[ends - 1] = self.none
        index: list[list[np.ndarray]] = [[] for _ in range(int(self.block_of[-1]) + 1 if self.none else 0)]

        def note(at: np.ndarray) -> None:
            """Enters the pairs that start at these places."""
            block = self.block_of[rank[at]]
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for part in np.split(at[order], cuts) if len(at) else ():
                index[int(self.block_of[rank[part[0]]])].append(part)

        note(np.flatnonzero(rank < self.none).astype(np.int32))
        for block, lists in enumerate(index):
            live = ascending(np.concatenate(lists)) if lists else np.zeros(0, np.int32)
            index[block] = []
            while True:
                live = live[rank[live] < self.none]
                live = live[self.block_of[rank[live]] == block]  # places whose pair has changed since are noted elsewhere
                if not len(live):
                    break
                ranks, piece = rank[live], owner[live]
                first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
                lowest = np.repeat(np.minimum.reduceat(ranks, first), np.diff(np.append(first, len(live))))
                at = live[ranks == lowest]
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if chained.any():  # of overlapping places, every other one from the left
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
                gone = after[at]
                beyond = after[gone]
                symbols[at], symbols[gone], after[at], rank[gone] = self.made[rank[at]], -1, beyond, self.none
                onward = beyond >= 0
                before[beyond[onward]] = at[onward]
                left = before[at]
                changed = ascending(np.concatenate([left[left >= 0], at]))
                right = after[changed]
                rank[changed] = np.where(right >= 0, self.ranks(symbols[changed], symbols[right]), np.int32(self.none))
                changed = changed[rank[changed] < self.none]
                here = self.block_of[rank[changed]] == block
                note(changed[~here])
                live = ascending(np.concatenate([live, changed[here]]))
        kept = symbols >= 0
        return symbols[kept], np.add.reduceat(kept, ends - sizes, dtype=np.int64)


def check_byte_level(spec: dict) -> None:
    model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    plain = [
        model.get("type", "BPE") == "BPE",
        before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True),
        after.get("type") == "ByteLevel",
        spec.get("normalizer") is None,
        not any(t.get(x) for t in spec.get("added_tokens", []) for x in ("lstrip", "rstrip", "single_word", "normalized")),
        not any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges")),
    ]
    if not all(plain):
        raise ValueError("the tokenizer file isn't plain byte-level BPE")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges that follow each other: each range's ``starts`` and on, ``sizes`` places of it."""
    ends = np.cumsum(sizes)
    out = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Numbers(dict):
    """Numbers of pieces in the order of their first look-up."""

    def __init__(self, known: dict):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        number = self[piece] = len(self)
        return number

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Coder:
    """Encodes slices of texts; remembers the ids of a bounded number of pieces."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        size = max(bpe.token_bytes) + 1
        names = [b"%d," % i for i in range(size)]
        #: The decimal text of each id, and its bytes, in one array each.
        self.digits, self.digit_sizes = np.frombuffer(b"".join(names), np.uint8), np.array(list(map(len, names)))
        tokens = [bpe.token_bytes.get(i, b"") for i in range(size)]
        self.bytes, self.byte_sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array(list(map(len, tokens)))
        self.digit_starts, self.byte_starts = (np.cumsum(x) - x for x in (self.digit_sizes, self.byte_sizes))
        self.forget()

    def forget(self) -> None:
        """Keeps the special tokens alone; their keys are tuples, so that no piece equals them."""
        self.number = Numbers({(name,): k for k, name in enumerate(self.bpe.special)})
        self.ids = np.array([*self.bpe.special.values()], np.int32)
        self.sizes = np.ones(len(self.ids), np.int64)

    def learn(self, new: list[str]) -> None:
        ids, sizes = self.bpe.merge(new)
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def cut(self, text: str) -> list[str | tuple[str]]:
        parts = self.bpe.split(text)
        if len(parts) == 1:
            return self.bpe.pieces(text)
        return [piece for k, x in enumerate(parts) for piece in (self.bpe.pieces(x) if k % 2 == 0 else [(x,)])]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        if len(self.number) > CACHE:
            self.forget()
        cut = [self.cut(text) for text in texts]
        counts = np.array([len(x) for x in cut], np.int64)
        found = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int32, int(counts.sum()))
        del cut
        self.learn(self.number.take_new())
        sizes = self.sizes[found]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[spread((np.cumsum(self.sizes) - self.sizes)[found], sizes)], np.diff(ends)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text the decimal ids joined by commas and the decoded bytes."""
        ids, counts = self.tokens(texts)
        at = np.concatenate([[0], np.cumsum(counts)])

        def written(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[bytes, list[int]]:
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])[at].tolist()
            return flat[spread(starts[ids], sizes[ids])].tobytes(), ends

        lines, line_ends = written(self.digits, self.digit_starts, self.digit_sizes)
        out, out_ends = written(self.bytes, self.byte_starts, self.byte_sizes)
        for a, b, c, d in zip(line_ends, line_ends[1:], out_ends, out_ends[1:]):
            yield lines[a : max(a, b - 1)].decode(), out[c:d]


_KEPT: dict[str, Coder] = {}


def coder_of(spec: str) -> Coder:
    """The coder of a tokenizer file's text, kept for the worker process's next tasks; one at a time."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Coder(Bpe(spec))
    return _KEPT[key]


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row for each input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; with ``texts`` the real outputs
    ``ids`` (array of int) and ``decoded`` follow.

    ``tokenizer`` is the path of a tokenizer file on the driver; its text, of fixed size, is sent to the executors.
    Null text counts as empty: no tokens, and the digest of the empty text. No shuffle; a task holds one slice of texts.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * texts)

    def run(batches):
        coder = coder_of(spec.value)
        for part in slices(batches, "text", SLICE_BYTES):
            rows = list(coder.encode(part.column("text").to_pylist()))
            decoded = [b.decode("utf-8", "replace") for _, b in rows]
            columns = [
                [line.count(",") + 1 if line else 0 for line, _ in rows],
                [hashlib.sha256(line.encode()).hexdigest() for line, _ in rows],
                [hashlib.sha256(text.encode()).hexdigest() for text in decoded],
            ]
            if texts:
                columns += [[[int(x) for x in line.split(",")] if line else [] for line, _ in rows], decoded]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t.type) for c, t in zip(columns, schema))], names=["doc_id", *schema.names])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}" + ", ids array<int>, decoded string" * texts)


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows with an array of ids. Null ids give a null text, unknown ids nothing; bytes that aren't
    UTF-8 become replacement characters."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        table = coder_of(spec.value).bpe.token_bytes
        for batch in batches:
            texts = [None if ids is None else b"".join(table.get(i, b"") for i in ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {dict(rows.dtypes)[id_col]}, text string")
