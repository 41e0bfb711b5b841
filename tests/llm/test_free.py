"""Operators with Python in their tasks, against brute force, round trips and held-out accuracy."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerolattice.llm import bpe, edit_fingerprint, language_id, setsketch, toxicity, url_filter
from aerolattice.llm.queries import tokenizer_path

from .conftest import messy


SF = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def coder():
    with open(tokenizer_path()) as f:
        return bpe.Coder(bpe.Bpe(f.read()))


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(max_size=80) | st.text(alphabet="ab <|endoftext|>'s\n\t é漢", max_size=60))
def test_bpe_equals_the_library(tokenizer, coder, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    ((line, decoded),) = coder.encode([text])
    assert line == ",".join(map(str, ids))
    assert decoded.decode("utf-8", "replace") == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_rows_and_round_trip(spark, odd, empty, tokenizer):
    rows = bpe.encode(odd, tokenizer_path(), texts=True)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows.collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, texts[r.doc_id])
        assert (r.ids_sha256, r.decoded_sha256) == (sha(",".join(map(str, ids))), sha(texts[r.doc_id]))
    back = {r.doc_id: r.text for r in bpe.decode(rows, tokenizer_path()).collect()}
    assert back == texts
    assert bpe.encode(empty, tokenizer_path()).count() == 0


def test_bpe_refuses_other_tokenizers():
    import json

    with open(tokenizer_path()) as f:
        spec = json.load(f)
    for key, value in (("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", spec["pre_tokenizer"] | {"add_prefix_space": True}), ("decoder", None), ("normalizer", {"type": "NFC"})):
        with pytest.raises(ValueError):
            bpe.Bpe(json.dumps(spec | {key: value}))


def test_bpe_remembers_a_bounded_number_of_pieces(tokenizer, coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 40)
    rng = random.Random(3)
    for _ in range(8):
        texts = [" ".join("".join(rng.choice("abcdé'<|") for _ in range(rng.randint(1, 9))) for _ in range(30)) + "<|endoftext|>" for _ in range(4)]
        got = [line for line, _ in coder.encode(texts)]
        assert got == [",".join(map(str, tokenizer.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net/fr/", "http://sub.example.com/de/1", "http://x.org/fr/", "http://x.org/en/", "http://net/", "http://foonet/", "http://a.net", "no scheme", None, "http:///x", "ftp://u@net:80/p", "a://b://net/"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}

    def judge(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0]) + len(r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else url_filter.DEFAULT

    assert got == {k: judge(u) for k, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_urls_take_odd_rows(spark):
    long = "http://x.org/fr/" + "a" * 200_000
    rows = [(1, long, "h", "p"), (1, long, "h", "p"), (None, "http://net/", "h", "p"), (2, "", "h", "p"), (3, "://", "h", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = sorted(((r.page_id or 0, r.host, len(r.path), r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()))
    assert got == [(0, "net", 1, "net/", "block"), (1, "x.org", 200_004, "org/fr/", "allow"), (1, "x.org", 200_004, "org/fr/", "allow"), (2, "", 0, None, "allow"), (3, "", 0, None, "allow")]


def test_url_index_of_many_keys(tmp_path):
    rng = random.Random(9)
    rules = [(f"h{k}.org", "/" + "p" * rng.randint(0, 3), "block" if k % 3 else "allow") for k in range(100_000)]
    paths = [str(tmp_path / f"{part}.npy") for part in url_filter.Index.PARTS]
    url_filter.Index.write(rules, paths)
    index = url_filter.Index(paths)
    some = [rules[rng.randrange(len(rules))] for _ in range(400)]
    assert index.judge(["a.b." + r[0] for r in some], [r[1] + "tail/" * 2000 for r in some]) == [(r[0] + r[1], r[2]) for r in some]
    assert index.judge([f"h{k}.net" for k in range(200)], ["/"] * 200) == [(None, None)] * 200


def test_url_index_survives_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.Index, "digests", staticmethod(lambda keys: np.array([len(k) % 2 for k in keys], np.uint64)))
    rules = [(f"h{k}.org", "/", "block" if k % 2 else "allow") for k in range(50)]
    paths = [str(tmp_path / f"{part}.npy") for part in url_filter.Index.PARTS]
    url_filter.Index.write(rules, paths)
    assert url_filter.Index(paths).judge([r[0] for r in rules] + ["h99.org"], ["/"] * 51) == [(r[0] + "/", r[2]) for r in rules] + [(None, None)]


def language_docs(spark, n=240):
    rng = random.Random(4)
    parts = {"en": "the and tion ing er of wh th".split(), "de": "der die sch ein ung ver zu ich".split()}
    rows = [(k, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(30)), lang) for k in range(n) for lang in [("en", "de")[k % 2]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out_accuracy(spark):
    docs = language_docs(spark)
    net = language_id.fit(docs, docs_each=60, steps=120)
    out = language_id.identify(docs.union(spark.createDataFrame([(1000, None, "en"), (1001, "123 !", "en"), (None, "the thing", None), (1002, "the " * 40_000, "en")], docs.schema)), net)
    got = {r.doc_id: r for r in out.collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in want if got[i].held_out]
    assert len(held) > 20 and np.mean([got[i].lang_pred == want[i] for i in held]) >= 0.95
    assert (got[1000].lang_pred, got[1000].score, got[1001].lang_pred) == ("und", 0.0, "und")
    assert got[1002].lang_pred == "en" and not got[None].held_out and all(0 <= r.score <= 1 for r in got.values())


def test_language_gradient():
    rng = np.random.default_rng(0)
    side = language_id.Direction(rng.standard_normal((257, 9)).astype(np.float64), rng.standard_normal((3, 9)))
    x = language_id.pack([b"abc", b"a"])

    def loss():
        states, _ = side.run(x)
        return float((states.astype(np.float64) ** 2).sum())

    states, tape = side.run(x, keep=True)
    table, back = side.gradient(x, tape, 2 * states.astype(np.float64))
    for array, grad, spot in ((side.back, back, (1, 4)), (side.back, back, (2, 8)), (side.table, table, (97, 2)), (side.table, table, (97, 7))):
        keep, h = array[spot], 1e-3
        array[spot] = keep + h
        up = loss()
        array[spot] = keep - h
        down = loss()
        array[spot] = keep
        assert grad[spot] == pytest.approx((up - down) / (2 * h), rel=2e-2, abs=1e-3)


def test_language_pools_equal_a_scalar_network():
    rng = np.random.default_rng(2)
    units, languages = 3, ["a", "b", "c"]
    side = lambda: language_id.Direction(rng.standard_normal((257, 3 * units)).astype(np.float32), (0.4 * rng.standard_normal((units, 3 * units))).astype(np.float32))
    net = language_id.Network(side(), side(), rng.standard_normal((2 * units + 1, 3)).astype(np.float32), languages)
    texts = ["short", "", "1 2 3", "é ß", "word " * 30 + "12 " + "mot " * 170, "x" * 449, "ab " * 400]
    soft = lambda v: v / (1 + abs(v))

    def states(raw, d):
        h, out = [0.0] * units, []
        for byte in raw:
            x, past = d.table[byte].tolist(), [sum(h[i] * float(d.back[i, j]) for i in range(units)) for j in range(3 * units)]
            r, z = ([soft(x[k * units + j] + past[k * units + j]) for j in range(units)] for k in (0, 1))
            c = [soft(x[2 * units + j] + past[2 * units + j] * (1 + r[j])) for j in range(units)]
            h = [(1 + z[j]) / 2 * h[j] + (1 - z[j]) / 2 * c[j] for j in range(units)]
            out.append(h)
        return out

    def judged(text):
        raw, sums, letters = text.encode(), [0.0] * 3, 0
        for start in range(0, len(raw), language_id.WINDOW):
            low = max(0, start - language_id.MARGIN)
            part = raw[low : start + language_id.WINDOW + language_id.MARGIN]
            ahead, back = states(part, net.forward), states(part[::-1], net.backward)[::-1]
            for k in range(start, min(start + language_id.WINDOW, len(raw))):
                if raw[k] >= 128 or chr(raw[k]).isalpha():
                    f = [*ahead[k - low], *back[k - low], 1.0]
                    logits = [sum(v * float(net.out[i, j]) for i, v in enumerate(f)) for j in range(3)]
                    norm = np.log(np.exp(logits).sum())
                    sums, letters = [s + v - norm for s, v in zip(sums, logits)], letters + 1
        if not letters or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = np.exp(np.array(sums) / letters)
        return languages[int(p.argmax())], p.max() / p.sum()

    names, scores = language_id.judge(net, texts)
    want = [judged(t) for t in texts]
    assert names == [w[0] for w in want] and scores == pytest.approx([w[1] for w in want], abs=1e-4)
    alone = [language_id.judge(net, [t])[1][0] for t in texts]
    assert scores == pytest.approx(alone, abs=2e-6)  # what a text is batched with doesn't matter


def test_language_takes_odd_rows(spark, odd):
    net = language_id.train(["the thing", "das ding"], ["en", "de"], steps=3)
    rows = language_id.identify(odd, net).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (7, 8)}) == 1


def test_language_without_labels(spark, empty):
    assert language_id.identify_languages(empty).count() == 0
    none = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert language_id.identify_languages(none).first().lang_pred == "und"


def toxic_tables(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        mild, severe = k % 6 == 0, k % 18 == 0
        text = rng.choices(words, k=40) + ["dolt"] * mild + ["menace"] * severe
        rng.shuffle(text)
        rows.append((k, " ".join(text).title(), "en"))
        labels.append((k, int(mild), int(severe), 1 if k % 50 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, words string"), spark.createDataFrame(labels, "doc_id long, mild int, severe int, gap int")


def test_chain_finds_each_category(spark):
    docs, labels = toxic_tables(spark)
    chain = toxicity.fit(docs, labels, {"mild": F.col("mild"), "severe": F.col("severe"), "gap": F.col("gap")})
    assert {"dolt", "menace"} <= set(chain.words) and [len(w) for w in chain.weights] == [1 + len(chain.words) + k for k in range(3)]
    chain = toxicity.fit(docs, labels, {"mild": F.col("mild"), "severe": F.col("severe")})
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert all((got[k].p_mild > 0.5) == (k % 6 == 0) and got[k].toxic == (k % 18 == 0) for k in range(600))


def test_toxic_rows_go_and_clean_ones_stay(spark, odd, empty):
    docs, labels = toxic_tables(spark)
    labels = labels.select("doc_id", F.lit(1).alias("quality"), F.col("mild").alias("toxic"))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in range(600) if k % 6}
    assert toxicity.drop_toxic(odd, labels).count() == odd.count()
    assert toxicity.detect(empty, labels).count() == 0
    assert toxicity.detect(docs, labels.limit(0)).filter("toxic").count() == 0


def test_chain_equals_brute_force():
    rng = np.random.default_rng(5)
    x = (rng.random((300, 6)) < 0.2).astype(float)
    first = (x[:, 0] + x[:, 1] + rng.normal(0, 0.5, 300) > 0.8).astype(float)
    second = np.where(rng.random(300) < 0.1, np.nan, (first + x[:, 2] + rng.normal(0, 0.5, 300) > 1).astype(float))
    y, folds = np.column_stack([first, second]), rng.integers(0, toxicity.FOLDS, 300)

    def newton(a, b):
        w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [toxicity.RIDGE] * (a.shape[1] - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ w))
            w = w - np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - b) + ridge @ w)
        return w

    want, earlier = [], np.zeros((300, 0))
    for k in range(2):
        a, known = np.column_stack([np.ones(300), x, earlier]), ~np.isnan(y[:, k])
        want.append(newton(a[known], y[known, k]))
        held = np.zeros(300)
        for f in range(toxicity.FOLDS):
            inside = known & (folds != f)
            held[folds == f] = 1 / (1 + np.exp(-a[folds == f] @ newton(a[inside], y[inside, k])))
        earlier = np.column_stack([earlier, held])
    hits = toxicity.Hits.of([np.flatnonzero(r).tolist() for r in x], 6)
    chain = toxicity.fit_chain(hits, y, list("abcdef"), ["first", "second"], folds)
    for got, w in zip(chain.weights, want):
        assert got == pytest.approx(w, abs=1e-5)
    p0 = 1 / (1 + np.exp(-np.column_stack([np.ones(300), x]) @ want[0]))
    p1 = 1 / (1 + np.exp(-np.column_stack([np.ones(300), x, p0]) @ want[1]))
    assert chain.predict(hits) == pytest.approx(np.column_stack([p0, p1]), abs=1e-5)


def test_repeated_labels_have_a_rule(spark):
    docs, labels = toxic_tables(spark)
    several = labels.unionByName(labels.filter("doc_id % 2 = 0").withColumn("mild", F.lit(0))).repartition(7)
    rows = lambda marks: sorted((r.doc_id, r.mild) for r in toxicity.labelled_sample(docs, marks, {"mild": F.col("mild")}).collect())
    assert rows(several) == rows(several.coalesce(1)) == rows(labels)


def fingerprint_docs(spark, texts, ids=None):
    return {r.doc_id: r for r in edit_fingerprint.fingerprint(messy(spark, texts, ids)).collect()}


def test_fingerprints(spark, odd, empty):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 3000))) for _ in range(60)] + [None, "", "é\U0001f600", "twin", "twin", "x" * 60_000]
    got = fingerprint_docs(spark, texts)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        nxt = plain[(i + 1) % len(plain)]
        half = len(t) // 2
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(t[: len(t) - half] + nxt[:half]))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[63].fingerprint == got[64].fingerprint and got[63].near_next == 1.0
    long = [i for i in range(60) if len(plain[i]) > 500 and len(plain[(i + 1) % len(plain)]) > 500]
    assert np.mean([got[i].near_edited > got[i].near_next + 0.2 for i in long]) > 0.95
    assert len(edit_fingerprint.fingerprint(odd).collect()) == odd.count() and edit_fingerprint.fingerprint(empty).count() == 0
    assert fingerprint_docs(spark, ["alone"])[0].near_next == 1.0


def test_few_edits_keep_the_fingerprint_near():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    walker = edit_fingerprint.Walker()
    other = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    (a, b, c, d), bands = walker.fingerprints([text, text[:500] + "Q" + text[500:], text[3:], other])
    assert edit_fingerprint.likeness(a, b) > 0.9 and edit_fingerprint.likeness(a, c) > 0.9 and edit_fingerprint.likeness(a, d) < 0.15
    assert (bands[0] == bands[1]).mean() > 0.8 and (bands[0] == bands[3]).sum() == 0
    empty, one = walker.fingerprints(["", "x"])[0]
    assert edit_fingerprint.likeness(empty, empty) == edit_fingerprint.likeness(one, one) == 1 and edit_fingerprint.likeness(one, empty) == 0


def test_insertions_into_long_texts_keep_the_rest_near():
    rng = random.Random(12)
    walker, letters = edit_fingerprint.Walker(), "abcdefghijklmnopqrstuvwxyz .,"
    text = "".join(rng.choice(letters) for _ in range(60_000))
    for size in (50, 200, 500):
        new = "".join(rng.choice(letters) for _ in range(size))
        own, begun, cut = walker.fingerprints([text, text[:300] + new + text[300:], text[:300] + text[300 + size :]])[0]
        assert edit_fingerprint.likeness(own, begun) > 0.85 and edit_fingerprint.likeness(own, cut) > 0.85
    some = [text[k : k + 40 * k] for k in range(60)]
    for whole, alone in zip(walker.fingerprints(some), zip(*(walker.fingerprints([t]) for t in some))):
        assert (whole == np.vstack(alone)).all()


def scattered(rng, text, share):
    """``share`` of the code points replaced, inserted or left out, wherever it may be."""
    out = list(text)
    for _ in range(max(1, round(len(out) * share))):
        k, c = rng.randrange(len(out)), rng.choice("abcdefghijklmnopqrstuvwxyz ")
        out[k : k + 1] = rng.choice(([c], [c, out[k]], []))
    return "".join(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("share", [0.01, 0.05, 0.1])
def test_recall_on_the_drivers_documents(spark, share):
    """Of 150 documents and their edited copies, 0.9 and more end in one class; documents that aren't near don't."""
    rng = random.Random(int(share * 100))
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 200 and 6000").select("text").distinct().orderBy("text").collect()
    base = rng.sample([r.text for r in rows], min(150, len(rows)))
    copies = [scattered(rng, t, share) for t in base]
    docs = messy(spark, base + copies)
    got = {r.doc_id: r.class_id for r in edit_fingerprint.fingerprint_classes(docs).collect()}
    assert np.mean([got[k] == got[k + len(base)] for k in range(len(base))]) >= 0.9
    # Of classes with several documents: near in fact, by the plain edit distance, to another of the class.
    for k in range(0, len(base), 10):
        mates = [j for j in got if j != k and got[j] == got[k]]
        texts = base + copies
        assert not mates or any(edit_fingerprint.distance_within(texts[k], texts[j], m := int(0.12 * max(len(texts[k]), len(texts[j])) + 1e-9)) <= m for j in mates)


def test_aligned_distance():
    rng = random.Random(15)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrs 😀") for _ in range(n))
    over = []
    for _ in range(150):
        a = word(rng.randint(0, 400))
        b = scattered(rng, a, rng.choice((0.01, 0.05, 0.1))) if a and rng.random() < 0.8 else word(rng.randint(0, 200))
        k, true, got = rng.randint(0, 9), plain_distance(a, b), edit_fingerprint.aligned_distance(a, b, 10_000)
        assert got >= true
        over.append(got - true if true < 0.2 * len(a) else 0)
        assert edit_fingerprint.aligned_distance(a, b, k) == got or (got > k and edit_fingerprint.aligned_distance(a, b, k) > k)
        assert edit_fingerprint.aligned_distance(a, a, 0) == 0
    assert np.mean(np.array(over) == 0) > 0.9
    assert edit_fingerprint.aligned_distance("ab " * 9000, "ab " * 4000 + "c" + "ab " * 5000, 9) == 1
    assert edit_fingerprint.aligned_distance("x" * 50_000, "y" * 50_000, 20) > 20


def test_least_edits_is_a_bound_below():
    rng = random.Random(16)
    for _ in range(200):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        b = scattered(rng, a, rng.choice((0.05, 0.3))) if a and rng.random() < 0.7 else "".join(rng.choice("abd ") for _ in range(rng.randint(0, 60)))
        x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
        assert edit_fingerprint._least_edits(x, y) <= plain_distance(a, b)
    assert edit_fingerprint._least_edits(x[:0], x[:0]) == 0


def test_aligned_distance_of_very_long_texts():
    import time

    rng = np.random.default_rng(4)
    code = rng.integers(97, 123, 1_000_000).astype(np.uint32)
    other = code.copy()
    other[rng.integers(0, len(code), 50_000)] = 33
    a, b = (x.tobytes().decode("utf-32-le") for x in (code, other))
    began = time.process_time()
    found = edit_fingerprint.aligned_distance(a, b, 200_000)
    assert 0.9 * (code != other).sum() <= found <= (code != other).sum() and time.process_time() - began < 3


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_within():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 90))) for _ in range(2))
        b = b if rng.random() < 0.5 else a[: rng.randint(0, 90)] + b[:3] + a[rng.randint(0, 90) :]
        most, want = rng.randint(0, 60), plain_distance(a, b)
        assert edit_fingerprint.distance_within(a, b, most) == min(want, most + 1)


def plain_classes(plain, full):
    """The classes by loops over all pairs: bands with their levels, likeness and distance."""
    prints, bands = edit_fingerprint.Walker().fingerprints(plain)
    first = {}
    nodes = [i for i, t in enumerate(plain) if t and first.setdefault(t, i) == i]
    together, left = set(), [(i, k) for i in nodes for k in range(edit_fingerprint.BANDS)]
    for level in range(edit_fingerprint.LEVELS):
        buckets = {}
        for i, k in left:
            buckets.setdefault((k, *(int(x) for x in np.resize(np.roll(bands[i], -k), 1 << level))), []).append(i)
        done = {key: m for key, m in buckets.items() if len(m) <= full or level + 1 == edit_fingerprint.LEVELS}
        together |= {(a, b) for m in done.values() for a in m for b in m if a < b}
        left = [(i, key[0]) for key, m in buckets.items() if key not in done for i in m]
    comp = list(range(len(plain)))
    for a, b in sorted(together):
        most = int(max(len(plain[a]), len(plain[b])) * 0.12 + 1e-9)
        if edit_fingerprint.likeness(prints[a], prints[b]) >= edit_fingerprint.LIKE and edit_fingerprint.aligned_distance(plain[a], plain[b], most) <= most:
            x, y = sorted((comp[a], comp[b]))
            comp = [x if c == y else c for c in comp]
    return {i: comp[first[t]] if t else None for i, t in enumerate(plain)}, {i: first[t] if t else None for i, t in enumerate(plain)}


@pytest.mark.parametrize("full", [64, 3])
def test_query_classes_equal_brute_force(spark, monkeypatch, odd, empty, full):
    from aerolattice.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(edit_fingerprint, "FULL", full)
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 4)
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    texts = [None, "", "é\U0001f600"]
    for size in (400, 900, 2500):
        # A first text, and copies that share half of it with it but are near to each other.
        root, tail = word(size), word(size * 2 // 5)
        other = root[: size * 3 // 5] + tail
        texts += [root, other] + [t[:k] + word(3) + t[k + 3 :] for t in (root, other) for k in (size // 3, size // 2, size - 9)]
    texts += [texts[5]] * 5 + [texts[8]]
    got = {r.doc_id: r for r in edit_fingerprint.fingerprint_classes(messy(spark, texts)).collect()}
    classes, first = plain_classes([t or "" for t in texts], full)
    assert {i: r.class_id for i, r in got.items()} == classes and {i: r.text_id for i, r in got.items()} == first
    assert len(set(classes.values())) == 8 and len(got) == len(texts)
    assert edit_fingerprint.fingerprint_classes(odd).count() == odd.count() and edit_fingerprint.fingerprint_classes(empty).count() == 0


def test_links_within_crowded_bands(spark, monkeypatch):
    """Pairs all of whose common bands are crowded link too, in blocks and cells of any size."""
    from aerolattice.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(edit_fingerprint, "FULL", 2)
    rng = random.Random(33)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, texts = word(300), []
    for size in (250, 330, 700):
        # Unlike texts around one passage, each with a few copies of many edits.
        for _ in range(5):
            root = word(size // 2) + passage + word(size // 2)
            texts += [root, *(scattered(rng, root, share) for share in (0.04, 0.06, 0.07))]
    rng.shuffle(texts)
    want = plain_classes(texts, len(texts))[0]
    assert len(set(want.values())) < len(set(plain_classes(texts, 2)[0].values()))  # the longer bands alone lose links
    for block, pairs in ((4, 3), (4096, 30_000)):
        monkeypatch.setattr(edit_fingerprint, "BLOCK_ROWS", block, raising=False)
        monkeypatch.setattr(edit_fingerprint, "CELL_PAIRS", pairs, raising=False)
        assert {r.doc_id: r.class_id for r in edit_fingerprint.fingerprint_classes(messy(spark, texts)).collect()} == want


def test_alike_texts_are_told_apart_by_bounds(monkeypatch):
    """Texts with one long passage and nothing else in common: counts of stretches show that they aren't near, so few pairs
    are aligned, and the links are those of all pairs."""
    rng, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz .,"
    made = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage = made(300)
    texts = [passage + made(200) for _ in range(40)]
    texts += [t[:450] + made(9) + t[450:] for t in texts[:5]]
    calls, aligned = [], edit_fingerprint.aligned_distance
    want = {(i, j) for i in range(45) for j in range(i) if aligned(texts[i], texts[j], 10_000) <= int(0.12 * max(len(texts[i]), len(texts[j])))}
    monkeypatch.setattr(edit_fingerprint, "aligned_distance", lambda *a: calls.append(a) or aligned(*a))
    ids = np.arange(45)
    a, b = np.triu_indices(45, 1)
    found = list(edit_fingerprint._Judge(edit_fingerprint.LEAST, ids, ids, texts).links(a, b, np.full(len(a), 0.7)))
    assert {(max(p), min(p)) for p in found} == want == {(40 + k, k) for k in range(5)} and len(calls) < 20


def test_bands_of_one_passage_make_one_cell(spark):
    rows = [(grp, node, 500, True, grp, 9, node) for grp in range(4) for node in range(9)] + [(7, node, 500, False, 5, 2, node) for node in (0, 20)]
    named = spark.createDataFrame(rows, "grp long, node long, n long, low boolean, band int, rows long, comp long")
    cells = sorted(map(tuple, edit_fingerprint._open_cells(named).select("hub", "node", "comp", "shared", "rows", "chars").collect()))
    assert cells == [(0, node, node, 15, 9, 4500) for node in range(9)]
    assert sorted(map(tuple, edit_fingerprint._small_pairs(named, edit_fingerprint.LEAST).collect())) == []
    named = named.filter("grp = 7").withColumn("low", F.col("node") == 0)
    assert [tuple(r) for r in edit_fingerprint._small_pairs(named, edit_fingerprint.LEAST).collect()] == [(0, 20)]


def test_files_in_any_order(spark, tmp_path):
    """Files that hold ranges of ids, and files that don't, give the same rows."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "é"], k=rng.randint(0, 30))) for _ in range(90)]
    docs = messy(spark, texts)
    want = sorted(map(tuple, edit_fingerprint.fingerprint(docs).collect()))
    for name, parts in (("ranges", docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id")), ("dealt", docs.repartition(5, "t", "n_chars", "text"))):
        parts.write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        plan = edit_fingerprint._in_order(back, "doc_id", "text")._jdf.queryExecution().toString()
        assert ("Exchange rangepartitioning" in plan) == (name == "dealt")
        assert sorted(map(tuple, edit_fingerprint.fingerprint(back).collect())) == want


def brute_components(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    comp = {i: i for i in texts}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_texts(groups=12, copies=25, seed=7):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        root = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 220))]
        for _ in range(copies):
            copy = list(root)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_near_duplicates_equal_brute_force(spark, odd, empty):
    texts = near_texts() + ["a b", "A  b", "a b c d e", "", None, "\t\n"]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(messy(spark, texts)).collect()}
    want = brute_components(dict(enumerate(texts)))
    assert got == want and len({c for _, c, _ in want.values()}) < len(texts)
    kept = setsketch.drop_near_copies(messy(spark, texts))
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[2]}
    rows = setsketch.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and all(r.kept for r in rows if r.doc_id is None)
    assert setsketch.near_duplicates(empty).count() == 0


def test_rows_with_one_id_are_judged_by_their_own_texts(spark):
    words = [f"w{k}" for k in range(60)]
    near = [*words[:-1], "other"]  # 55 of 57 shingles
    far = [f"v{k}" for k in range(60)]
    rows = [(9, words), (9, far), (4, near), (7, far), (9, words)]
    docs = messy(spark, [" ".join(w) for _, w in rows], [i for i, _ in rows])
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(docs).collect())
    assert got == sorted([(9, 56, 4, False), (9, 56, 7, False), (4, 56, 4, True), (7, 56, 7, True), (9, 56, 4, False)])
    kept = setsketch.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 7]


def test_hot_hubs_are_dealt_over_salts(spark, monkeypatch):
    from aerolattice.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    texts = near_texts(groups=2, copies=80, seed=5) + ["one two three four five six"] * 40
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(messy(spark, texts)).collect()}
    assert got == {i: c for i, (_, c, _) in brute_components(dict(enumerate(texts))).items()}


def test_blocks_find_links_between_components(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 8)
    texts = near_texts(groups=2, copies=80, seed=11)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(messy(spark, texts)).collect()}
    assert got == {i: c for i, (_, c, _) in brute_components(dict(enumerate(texts))).items()}


def test_sketches_merge_and_estimate():
    a, b = np.unique(setsketch.shingles(" ".join(f"a{k}" for k in range(900)))), setsketch.shingles(" ".join(f"a{k}" for k in range(60, 960)))
    ra, rb, both = setsketch.registers([a, b, np.union1d(a, b)])
    assert (setsketch.merge(ra, rb) == both).all()
    assert setsketch.plausible(ra[None], rb[None], [len(a)], [len(b)])[0]
    far = setsketch.shingles(" ".join(f"a{k}" for k in range(450, 1350)))
    assert not setsketch.plausible(ra[None], setsketch.registers([far]), [len(a)], [len(far)])[0]
