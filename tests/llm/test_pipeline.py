"""The pipeline's stages against brute force, each on its own input."""

import math
import os
import random
from collections import Counter

import duckdb
import pytest
import regex

import corpus_pipeline
from aerolattice.llm import mixing, setsketch, toxicity

from .conftest import messy
from .test_free import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.collect())
        if name != "bpe":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    chain = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), toxicity.table_categories())
    words = lambda t: {*(w := set(regex.findall(toxicity.TOKEN, (t or "").lower()))), *(x[:n] + "*" for n in toxicity.STEMS for x in w if len(x) > n)}

    def rejected(t):
        earlier = []
        for w in chain.weights:
            z = w[0] + sum(w[1 + k] for k, x in enumerate(chain.words) if x in words(t)) + sum(a * b for a, b in zip(w[1 + len(chain.words) :], earlier))
            earlier.append(1 / (1 + math.exp(-z)))
        return earlier[-1] > toxicity.THRESHOLD

    assert {r.doc_id for r in after} == {i for i, t in before.items() if not rejected(t)} and len(after) < len(before)
    before, after = seen["exact_dedup"]
    squeeze = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")
    best = {}
    for i, t in before.items():
        key = squeeze(t)
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(t or ""), i))
    assert {r.doc_id for r in after} == {i for _, i in best.values()}
    before, after = seen["minhash_near_dedup"]
    assert {r.doc_id for r in after} == {i for i, (_, _, kept) in brute_components(before, 80).items() if kept}
    before, after = seen["source_mixing"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/minhash_near_dedup/*.parquet'")
    copies = con.execute(mixing.oracle()).df()
    want = {i: n for i, n in zip(copies["doc_id"], copies["copies"]) if n}
    assert Counter(r.doc_id for r in after) == want and all(before[r.doc_id] == r.text for r in after)
    before, after = seen["bpe"]
    assert len(after) == len(seen["source_mixing"][1]) and all(r.n_tokens > 0 for r in after if before[r.doc_id])
    assert {n for n, _ in corpus_pipeline.STAGES} == set(seen)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect())) and rows.count() > 0


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        out = stage(spark, odd, SF)
        if name != "bpe":
            assert out.columns == odd.columns
        held = Counter(r.doc_id for r in odd.select("doc_id").collect())
        assert all(n <= mixing.MAX_EPOCHS * held[i] for i, n in Counter(r.doc_id for r in out.select("doc_id").collect()).items())


def test_near_copies_at_80_percent(spark):
    rng = random.Random(80)
    texts = []
    for copies in (2, 3, 4, 5, 4, 6):  # words replaced: the last ones stay below 80 %
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        other = list(words)
        for k in range(copies):
            other[20 + 30 * k] = "new"
        texts += [" ".join(words), " ".join(other)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(200)} for t in texts]
    ratio = lambda a, b: len(a & b) / len(a | b)
    want = {k for k in range(len(texts)) if k % 2 == 0 or ratio(sets[k - 1], sets[k]) < 0.8}
    assert any(0.8 <= ratio(sets[k - 1], sets[k]) < 0.85 for k in range(1, len(texts), 2)) and len(want) > len(texts) // 2
    assert {r.doc_id for r in setsketch.drop_near_copies(messy(spark, texts), 80).collect()} == want
    assert {r.doc_id for r in setsketch.drop_near_copies(messy(spark, texts)).collect()} > want


#: Names that the stages use inside, in this version or an earlier one, and names that need quoting.
NAMES = [
    "_h", "_p", "_bucket", "_bits", "_maybe", "_gone", "_text_key", "_row_key", "_mix_cut", "_mix_copies", "_mix_epochs", "_salt", "_salts", "_long_id", "row", "rows", "Place", "KEY", "label", "domain", "language", "cut", "copies",
    "epochs", "gone", "text_key", "row_key", "group", "fold", "words", "hits", "n_tokens", "kept", "keep_id", "body", "t", "n", "node", "comp", "hub", "a", "b", "a.b", "a`b", "`x`", "two words", "Ünïcode", "",
]


def test_stages_carry_columns_of_any_name(spark):
    rng = random.Random(31)
    base = [" ".join(rng.choices([f"w{k}" for k in range(500)], k=40)) for _ in range(30)]
    texts = [*base, *base[:10], *(t + " more" for t in base[5:15]), None, ""]
    source = spark.read.parquet(f"{SF}/documents.parquet").schema
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source), *(f"`{n.replace('`', '``')}` string" for n in NAMES)])
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), *(f"{n}:{i}" for n in NAMES)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    want = {r[0]: tuple(r) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and all(r == want[r[0]] for r in got), name
        plain = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), SF)
        assert Counter(r[0] for r in got) == Counter(r.doc_id for r in plain.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_mix_keeps_rows_of_null_labels(spark):
    from pyspark.sql import functions as F

    rows = [(i, "one two three", ("web", None)[i % 2], ("en", None, "de")[i % 3], (None, "s")[i % 4 == 1]) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dom string, lang string, source string")
    tree = {"domain": F.col("dom"), "language": F.col("lang"), "source": F.col("source")}
    report = mixing.mix_report(docs, tree=tree).collect()
    assert {(r.doc_id, r.domain, r.language, r.source) for r in report} == {(i, d, lang, s) for i, _, d, lang, s in rows}
    copies = {r.doc_id: r.copies for r in report}
    assert Counter(r.doc_id for r in mixing.mix(docs, tree=tree).collect()) == {i: n for i, n in copies.items() if n}
    leaves = Counter()
    for r in report:
        leaves[r.domain] += r.n_tokens * r.copies
    assert 0 < leaves[None] and 0.55 * 720 < sum(leaves.values()) <= 0.6 * 720  # a null domain weighs 1, web 0.7
    assert leaves[None] > leaves["web"]


def test_exact_groups_take_text_ids(spark):
    from aerolattice.llm import exact_dedup

    docs = spark.createDataFrame([("b", "x y"), ("a", "x  y"), ("c", "xy"), (None, "x  y"), ("d", "z")], "doc_id string, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {("b", "a", 4, False), ("a", "a", 4, True), ("c", "a", 4, False), (None, "a", 4, False), ("d", "d", 1, True)}
    assert {r.doc_id for r in exact_dedup.drop_exact_copies(docs).collect()} == {"a", "d"}
