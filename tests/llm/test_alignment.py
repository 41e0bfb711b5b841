"""Cross-tokenizer alignment against the two libraries and counts by brute force."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

from aerolattice.llm import alignment, common
from aerolattice.llm.bpe import byte_symbols
from aerolattice.llm.queries import op13_cross_tokenizer_alignment, piece_model_path, tokenizer_path

from .conftest import messy

SF = "/root/testdata/sf0.001"
PATHS = tokenizer_path(), piece_model_path()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(texts, libraries):
    """Rows of the contract, groups, and counts of pairs, by the libraries and plain loops."""
    a_lib, b_lib = libraries
    back = {c: b for b, c in enumerate(byte_symbols())}
    bytes_a = lambda i: bytes(back[c] for c in a_lib.id_to_token(i))
    bytes_b = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    found, counts = {}, Counter()
    for key, t in texts.items():
        want = (" " + (t or "")).encode()
        a, b = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        if not t or b"".join(map(bytes_a, a)) != want or b"".join(map(bytes_b, b)) != want:
            found[key] = ([], [], [], [])
            continue
        ranges = []
        for ids, size in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(size(i))))
                at = out[-1][1]
            ranges.append(out)
        links, j = [], 0
        for x, (s, e) in zip(a, ranges[0]):
            k = j
            while k < len(b) and ranges[1][k][0] < e:
                links.append((x, b[k]))
                k += 1
            j = k - (k > 0 and ranges[1][k - 1][1] > e)
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, low = [], 0
        for c in cuts:
            part = [",".join(str(x) for x, (s, e) in zip(ids, r) if low <= s and e <= c) for ids, r in zip((a, b), ranges)] if len(t) < 4000 else None
            groups.append("|".join(part) if part else None)
            low = c
        found[key] = (a, b, groups, links)
        counts.update(set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    rows = {}
    for key, (a, b, groups, links) in found.items():
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and groups[0] else "" if not groups else None
        rows[key] = (len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), sha)
    return rows, found, counts


def check(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        own = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == own[:6]
        assert own[6] is None or r.groups_sha256 == own[6]


def sample_texts():
    rng = random.Random(13)
    parts = ["the", "aligning", "Zürich", "漢字", "\U0001f600", "\n", "  ", "\t", "<|endoftext|>", "<s>", "<0x41>", "don't", "123", "ﬁ", "aa", "aaa", "\x00"]
    texts = [rng.choice(["", " "]).join(rng.choices(parts, k=rng.randint(0, 40))) + rng.choice(["", " ", "  "]) for _ in range(150)]
    return [*texts, None, "", " ", "a", "a ", " a", "has ▁ in it", "▁", "é" * 300, "x " * 1500, *["twin text"] * 4]


def test_align_equals_brute_force(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 700)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    texts = dict(enumerate(sample_texts()))
    want, found, counts = brute(texts, libraries)
    docs = messy(spark, list(texts.values()))
    check(alignment.align(docs, *PATHS).collect(), want)
    assert {(r.a_id, r.b_id): r.n_docs for r in alignment.pair_counts(docs, *PATHS).collect()} == dict(counts)
    groups = {r.doc_id: r.groups for r in alignment.aligned_groups(docs, *PATHS).collect()}
    assert groups == {k: ";".join(g) for k, (_, _, g, _) in found.items()}
    assert any(a and not g for a, g in zip(texts.values(), groups.values()))  # a text whose bytes don't come back


def test_align_takes_odd_and_empty_tables(spark, odd, empty):
    rows = alignment.align(odd, *PATHS).collect()
    assert len(rows) == odd.count() and all((r.n_a == 0) == (r.groups_sha256 == "") for r in rows)
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (7, 8)}) == 1
    assert alignment.align(empty, *PATHS).count() == 0 and alignment.pair_counts(empty, *PATHS).count() == 0


def test_models_that_change_texts_take_them_whole(libraries):
    with open(PATHS[1], "rb") as f:
        pieces = alignment.Pieces(f.read())
    texts = [" " + t for t in sample_texts() if t]
    parts, (whole, n, _) = pieces.tokens(texts), (None, None, None)
    pieces.forget()
    pieces.cut = lambda text: [text]
    whole, n, exact = pieces.tokens(texts)
    assert (parts[0] == whole).all() and (parts[1] == n).all() and (parts[2] == exact).all() and not exact.all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_query_equals_brute_force(spark, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    check(op13_cross_tokenizer_alignment(spark, SF).collect(), brute(texts, libraries)[0])
