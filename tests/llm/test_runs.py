"""Periodic runs against brute force."""

import hashlib
import os
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aerolattice.llm import periodic_runs
from aerolattice.llm.queries import op11_periodic_runs

from .conftest import messy

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            own = w[i : j + q]
            if j - i + q >= max(6, 4 * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((i, len(own), q))
            i = j + 1
    return sorted(out)


def found(texts):
    return [[tuple(x) for x in r.tolist()] for _, r in periodic_runs._slice_runs(range(len(texts)), texts, False)]


def periodic_text(rng, letters):
    w = rng.choices(letters, k=rng.randint(0, 100))
    for _ in range(rng.randint(0, 3)):
        period = rng.choices(letters, k=rng.randint(1, 14))
        w += (period * rng.randint(2, 9))[: rng.randint(1, 90)] + rng.choices(letters, k=rng.randint(0, 4))
    return " ".join(w)


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for trial in range(400):
        texts = [periodic_text(rng, "ab" if trial % 2 else "abcdefgh") for _ in range(rng.randint(1, 6))]
        assert found(texts) == [brute_runs(t.split()) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=120), max_size=4))
def test_runs_of_any_small_text(texts):
    assert found(texts) == [brute_runs(t.split()) for t in texts]


def test_nested_periods():
    inner = ["a"] * 5 + ["b"]
    text = " ".join((inner * 5 + ["c"]) * 6)  # periods 6 within 31
    assert found([text]) == [brute_runs(text.split())]
    assert {q for _, _, q in found([text])[0]} == {6, 31}
    one = "x " * 50_000
    assert found([one, "", "y"]) == [[(0, 50_000, 1)], [], []]


def contract(i, text):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    h = zlib.crc32(str(i).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs, dropped = brute_runs(w), set()
    for s, size, q in runs:
        dropped.update(range(s + q, s + size))
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (i, len(runs), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in dropped)))


def test_digest_equals_brute_force(spark, odd, empty):
    rng = random.Random(7)
    texts = [periodic_text(rng, "abcdef") for _ in range(150)] + [None, "", " \t", "a\x1cb\x85c d", "é é é é é é é"]
    rows = periodic_runs.run_digest(messy(spark, texts)).collect()
    assert [tuple(r) for r in sorted(rows, key=lambda r: r.doc_id)] == [contract(i, t) for i, t in enumerate(texts)]
    assert any(r.n_runs and zlib.crc32(b"%d" % r.doc_id) % 10 == 0 for r in rows)
    got = periodic_runs.run_digest(odd).collect()
    assert len(got) == odd.count() and {r.period for r in got if r.doc_id == 5} == {1}
    assert periodic_runs.run_digest(empty).count() == 0


def test_runs_and_collapsed_texts(spark, odd, empty):
    docs = messy(spark, ["start " + "a b " * 5 + "end", "none here", None])
    assert [tuple(r) for r in periodic_runs.periodic_runs(docs).collect()] == [(0, 1, 10, 2, "a b a b a b a b a b")]
    assert {r.doc_id: r.text for r in periodic_runs.collapsed(docs).collect()} == {0: "start a b end", 1: "none here", 2: ""}
    assert periodic_runs.periodic_runs(empty).count() == 0 and periodic_runs.collapsed(odd).count() == odd.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len((r.text or "").split()) <= 1500}
    rows = op11_periodic_runs(spark, SF).collect()
    assert len(rows) == len(docs) and len(short) > 150
    assert [tuple(r) for r in sorted(rows, key=lambda r: r.doc_id) if r.doc_id in short] == [contract(i, t) for i, t in sorted(short.items())]
