"""Packing: exact covers of the library's ids, full use of sequences, and the rule of each placement."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from aerolattice.llm import packing
from aerolattice.llm.queries import op12_best_fit_packing, tokenizer_path

from .conftest import messy

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def covers(rows, texts, tokenizer, capacity):
    """All ids of all documents lie in sequences without gaps, each piece as the contract cuts it; the numbers of ids in
    each sequence."""
    pieces, used = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for i, own in pieces.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r.piece)
        head = len(ids) % capacity
        starts = ([0] if head else []) + list(range(head, len(ids), capacity))
        assert [(r.piece, r.start, r.length) for r in own] == [(k, a, b - a) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
    for parts in used.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
    sums = [sum(n for _, n in parts) for parts in used.values()]
    assert max(sums) <= capacity
    return sums


def test_each_item_goes_where_squares_are_least():
    rng = random.Random(2)
    for capacity in (1, 7, 20):
        sizes = [rng.randint(1, capacity) for _ in range(400)]
        bins, gaps = packing.sum_of_squares(np.array(sizes), capacity)
        left: dict[int, int] = {}
        squares = lambda state: sum(n * n for n in np.bincount([g for g in state.values() if g], minlength=1).tolist())
        for size, b in zip(sizes, bins.tolist()):
            ways = [squares(left | {k: left[k] - size}) for k in {g: k for k, g in left.items() if g >= size}.values()]
            ways.append(squares(left | {len(left): capacity - size}))
            left = left | {b: left.get(b, capacity) - size}
            assert squares(left) == min(ways) and left[b] >= 0
        assert [left[k] for k in range(len(left))] == gaps.tolist()


def test_groups_are_packed_tightly():
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 1025, 3000), rng.integers(20, 300, 5000)])
    rng.shuffle(sizes)
    bins, at = packing.pack_group(sizes, True)
    least = -(-sizes.sum() // 1024)
    assert len(set(bins.tolist())) <= max(1.004 * least, len(set(packing.best_fit(sizes).tolist())) * 1.002)
    sums = np.zeros(bins.max() + 1, int)
    for b, o, s in sorted(zip(bins.tolist(), at.tolist(), sizes.tolist())):
        assert o == sums[b]
        sums[b] += s
    assert sums.max() <= 1024
    bins, _ = packing.pack_group(sizes, False)
    full = np.bincount(bins[bins >= 0], sizes[bins >= 0])
    assert set(full[full > 0]) == {1024} and (bins < 0).mean() < 0.3
    assert len(packing.pack_group(np.zeros(0, np.int64), True)[0]) == 0


@pytest.mark.parametrize("capacity", [1, 5, 64])
def test_pack_covers_odd_rows(spark, odd, empty, tokenizer, monkeypatch, capacity):
    monkeypatch.setattr(packing, "GROUP", 50)
    rng = random.Random(4)
    texts = [None, "", "<|endoftext|>", "x " * 3000, *(" ".join(rng.choices(["tie", "of", "é", "\n"], k=rng.randint(0, 90))) for _ in range(150))]
    sums = covers(packing.pack(messy(spark, texts), tokenizer_path(), capacity).collect(), dict(enumerate(texts)), tokenizer, capacity)
    assert len(sums) <= 1.1 * sum(sums) / capacity + 3
    rows = packing.pack(odd, tokenizer_path(), capacity).collect()
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_sequences_hold_the_ids(spark, tokenizer):
    texts = ["one two three", "four " * 40, None, "five"] * 5
    rows = packing.packed_sequences(messy(spark, texts), tokenizer_path(), 32).collect()
    ids = sorted(x for r in rows for x in r.ids)
    assert ids == sorted(x for t in texts for x in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    assert all(len(r.ids) == sum(p.length for p in r.pieces) <= 32 for r in rows) and len({r.sequence_id for r in rows}) == len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_query_covers_the_table(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    sums = covers(op12_best_fit_packing(spark, SF).collect(), texts, tokenizer, 1024)
    assert len(sums) <= 1.02 * sum(sums) / 1024 + 1
