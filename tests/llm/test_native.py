"""Secret scan, licence scan, mixing and exact de-duplication."""

import hashlib
import math
import random
import re
import string
import textwrap

import duckdb

from aerolattice.llm import exact_dedup, licenses, mixing, secrets

from .conftest import messy

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def line(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{s}:{e}" for s, k, e in spans)


def secret_texts():
    rng = random.Random(1)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    fixed = ["token=password: abcdefghijkl", "é PASSWORD = 'abcdefghijkl' api_key:short token=secret=abcdefghijklmnop", "AKIAAKIA" + "A" * 14, "AKIA" + "B" * 13, "0" * 16 + "g" + "f" * 15, "apikey=" + "a" * 12 + " secret : \"" + "b" * 13 + '"']
    return fixed + [f"ünder {key(40)} tail" for _ in range(30)] + ["antionerthereonandtheoftionerthandere plain", "ggggggggggggggggggggggggggggggZ"]


def test_secret_spans(spark, odd, empty):
    texts = secret_texts()
    got = {r.doc_id: r for r in secrets.secret_digest(messy(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(line(want).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert set(filter(None, line(want).split(","))) <= set(got[i].spans.split(","))
    found = [got[i].spans for i in range(6, 36)]
    assert sum(x == "random:6:46" for x in found) >= 25  # random keys
    assert not got[36].spans and not got[37].spans  # ordinary and constant runs
    rows = secrets.secret_digest(odd).collect()
    assert len(rows) == odd.count() and {r.spans for r in rows} == {""}
    assert secrets.secret_digest(empty).count() == 0


def plain_bin(token):
    """The battery's bin of a token, in plain Python; None without an encoding."""
    n = len(token)
    kinds = [("^[0-9]+$", None), ("^[0-9a-f]+$", "hex"), ("^[0-9A-F]+$", "upper_hex"), ("^(?=.*[2-7])[A-Z2-7]+$", "base32"), ("^[A-Za-z0-9+/]+$", "base64"), ("^[A-Za-z0-9_-]+$", "base64url")]
    name = next((k for p, k in kinds if re.match(p, token)), None)
    if not name:
        return None
    alphabet = secrets.ALPHABETS[name]
    kappa, pairs = secrets.COINCIDENCE[len(alphabet)], n * (n - 1) / 2
    equal = sum(a == b for i, a in enumerate(token) for b in token[:i])
    z = (equal - pairs * kappa) / math.sqrt(pairs * kappa * (1 - kappa))
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in token]
    a, rho = sum(x != y for x, y in zip(kind, kind[1:])) / (n - 1), secrets.CHANGE
    bound = (n - 1) * (a * math.log(a / rho) + ((1 - a) * math.log((1 - a) / (1 - rho)) if a < 1 else 0)) if a > rho else 0
    both = (-z * z / 2 - math.log(2) if z < 0 else 0) - bound
    v = [alphabet.index(c) for c in token]
    m = sum(v) / n
    spread = sum((x - m) ** 2 for x in v)
    r = min(0.999999, abs(sum((x - m) * (y - m) for x, y in zip(v, v[1:])) / spread)) if spread else 0.999999
    z = (math.atanh(secrets.CORRELATION) - math.atanh(r)) * math.sqrt(n - 3)
    p = max(both + math.log(1 - both), -z * z / 2 - math.log(2) if z > 0 else 0) + math.log(secrets.MARGIN)
    return min(math.floor(max(-p / math.log(10), 0) * 10), secrets.BINS)


def plain_cuts(tests, rate):
    """Benjamini-Hochberg on bins, stratum by stratum."""
    cuts = {}
    for stratum in {s for s, _ in tests}:
        bins = sorted((b for s, b in tests if s == stratum), reverse=True)
        good = [b for b in set(bins) if 10 ** (-b / 10) <= rate * sum(x >= b for x in bins) / len(bins)]
        if good:
            cuts[stratum] = min(good)
    return cuts


WRITING = "the request handler module config parser user session token manager build output stream reader buffer index page table column value field name type error message service client server domain path file folder image video music player game level score unit mock data model view controller".split()
HEX_WORDS = "dead beef cafe face added decade facade bead fade deed feed bad cab dad ace bee 2024 1999 2000 100 00 12 31 0001 42".split()


def ordinary(rng):
    """A token of 20 and more characters as people and programs write them."""
    while True:
        own = rng.choices(WRITING, k=rng.randint(3, 10))
        date = f"{rng.randint(1990, 2026)}/{rng.randint(1, 12):02d}"
        kinds = ["".join(map(str.capitalize, own)), "_".join(own), "-".join(own), "/".join(own), f"{'-'.join(own)}-{rng.randint(1, 99999)}", "_".join(own).upper(), "/".join([date, *own]), own[0] + "".join(map(str.capitalize, own[1:])) + str(rng.randint(0, 99)),
                 f"v{rng.randint(0, 9)}_{rng.randint(0, 99)}-{'-'.join(own)}", "".join(rng.choices(HEX_WORDS, k=rng.randint(6, 14))), "".join(rng.choices(HEX_WORDS, k=rng.randint(6, 14))).upper()]
        token = rng.choice(kinds)
        if len(token) >= 20 and plain_bin(token) is not None:
            return token


def test_p_values_of_ordinary_tokens():
    """Of 10,000 ordinary tokens no more are at a p-value than it says, but for chance, and none is discovered."""
    rng = random.Random(17)
    tokens = [ordinary(rng) for _ in range(10_000)]
    bins = [plain_bin(t) for t in tokens]
    for power in (1, 2, 3, 4):
        expected = 10_000 * 10**-power
        assert sum(b >= 10 * power for b in bins) <= expected + 3 * math.sqrt(expected)
    tests = [(sum(len(t) >= end for end in secrets.STRATA), b) for t, b in zip(tokens, bins)]
    cuts = plain_cuts(tests, secrets.RATE)
    assert sum(b >= cuts.get(s, secrets.BINS + 1) for s, b in tests) <= secrets.RATE * len(tests)


def test_power_by_length_and_encoding():
    """The share of keys with a p-value that is found among 10,000 ordinary tokens for each key."""
    rng = random.Random(23)
    found = {}
    for name, n in (("base64", 32), ("base64", 40), ("base64url", 43), ("upper_hex", 40), ("upper_hex", 48), ("upper_hex", 64), ("base32", 52)):
        keys = ["".join(rng.choice(secrets.ALPHABETS[name]) for _ in range(n)) for _ in range(300)]
        found[name, n] = sum((plain_bin(k) or 0) >= 60 for k in keys) / 300
    assert found["base64", 32] > 0.25 and found["base64", 40] > 0.75 and found["base64url", 43] > 0.85 and found["base32", 52] > 0.8
    assert found["upper_hex", 40] > 0.4 and found["upper_hex", 48] > 0.8 and found["upper_hex", 64] > 0.97


def test_one_key_among_ten_thousand_tokens(spark):
    rng = random.Random(29)
    tokens = [ordinary(rng) for _ in range(10_000)]
    key = "".join(rng.choice(secrets.ALPHABETS["base64"]) for _ in range(44))
    tokens[4321] = key
    texts = [" ".join(tokens[k : k + 100]) for k in range(0, 10_000, 100)]
    rows = {r.doc_id: r for r in secrets.scan_secrets(messy(spark, texts)).collect()}
    hits = [texts[i][s.start : s.end] for i, r in rows.items() for s in r.spans if s.kind == 3]
    assert key in hits and len(hits) <= 1 + secrets.RATE * len(tokens) / 10


def test_secret_method_equals_brute_force(spark):
    rng = random.Random(12)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    words = lambda n: "".join(rng.choice(["tion", "ing", "er", "the", "and", "stead", "Over", "load"]) for _ in range(n))
    texts = []
    for _ in range(60):
        texts.append(f"{draw(string.ascii_letters + string.digits, rng.randint(20, 70))} é {words(rng.randint(5, 12))} {draw('ABCDEF0123456789', rng.randint(20, 40))}")
        texts.append(f"a/b {words(8)}-{words(3)} {draw(secrets.ALPHABETS['base32'], rng.randint(20, 50))} {draw(secrets.ALPHABETS['base64url'], rng.randint(20, 90))} {string.ascii_lowercase} {'xY7' * rng.randint(7, 12)} {draw('0123456789abcdef', 24)}")
    tests, found = [], []
    for i, t in enumerate(texts):
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", t):
            b = plain_bin(m[0])
            if b is not None:
                stratum = sum(len(m[0]) >= end for end in secrets.STRATA)
                tests.append((stratum, b))
                found.append((i, m.start(), m.end(), stratum, b))
    cuts = plain_cuts(tests, secrets.RATE)
    want = {i: base_spans(t) for i, t in enumerate(texts)}
    for i, start, end, stratum, b in found:
        if b >= cuts.get(stratum, secrets.BINS + 1) and not any(s < end and start < e for s, k, e in want[i] if k < 3):
            want[i].append((start, 3, end))
    got = {r.doc_id: (r.spans, r.n_random) for r in secrets.secret_digest(messy(spark, texts)).collect()}
    assert got == {i: (line(sorted(w)), sum(k == 3 for _, k, _ in w)) for i, w in want.items()}
    keys = [f for f in found if f[0] % 2 == 0 and f[1] == 0]
    hits = sum((s, 3, e) in want[i] for i, s, e, *_ in keys)
    assert hits >= 0.9 * len(keys) and not any(string.ascii_lowercase in texts[i][s:e] or "xY7xY7" in texts[i][s:e] for i, w in want.items() for s, k, e in w if k == 3)


def test_licenses(spark, odd, empty):
    texts = ["Intro. Released under the MIT License.\nMore.", "Licensed under the Apache License, Version 2.0.\nUnknown line.\nYou may not use this file except in compliance with the License. You may obtain a copy of the License at:", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "no licence", "All rights reserved! Licensed under CC BY-NC 4.0."]
    got = licenses.scan_licenses(messy(spark, texts)).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["MIT", "Apache-2.0", None, None, "CC-BY-NC-4.0"]
    assert [r.sentence_ids for r in got] == ["m01", "a01,a02,a03", "m02", "", "r01,c01"]
    assert licenses.scan_licenses(odd).filter("n_sentences = 0 and license is null").count() == odd.count()
    assert licenses.scan_licenses(empty).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES."""


def test_licence_table():
    from itertools import chain

    ids = set(chain.from_iterable(seq for _, seq in licenses.ALL_RULES))
    assert ids <= set(licenses.PHRASES.values()) and all(len(i) == 3 for i in licenses.PHRASES.values())
    assert all(re.search(licenses.KEYS, p) and re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", p) for p in licenses.PHRASES)
    assert len(licenses.PHRASES) > 100 and len({name for name, _ in licenses.ALL_RULES}) > 40


def test_official_licence_texts(spark):
    wrapped = lambda t, mark: "\n".join(mark + x for p in t.split("\n\n") for x in [*textwrap.wrap(p.strip(), 72), ""])
    texts = [f(t) for t in (MIT, APACHE, GPL, BSD) for f in (lambda t: t, lambda t: wrapped(t, ""), lambda t: wrapped(t, "# ").replace("\n", "\r\n"))]
    more = {
        "Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/": "Apache-2.0",
        "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007": "GPL-3.0",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License": "CC-BY-NC-4.0",
        "A creative\ncommons attribution\n4.0 international text": "CC-BY-4.0",
        "Copyright 2020 X.\nAll rights\nreserved.": "proprietary",
        GPL.replace("version 3", "version 2"): "GPL-2.0",
        GPL.replace("GNU General", "GNU Affero General"): "AGPL-3.0",
        GPL.replace("GNU General", "GNU Lesser General"): "LGPL-3.0",
        GPL.replace("version 3", "version 4"): None,
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed": "MPL-2.0",
        "// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;": "LGPL-2.1",
        "Available under the MIT license? Licensed under the MIT License, see LICENSE.": "MIT",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        ISC: "ISC",
        ISC.replace(" provided that the above copyright notice and this permission notice appear in all copies", ""): "0BSD",
        "Unlicensed under the MIT License.": None,
    }
    got = {r.doc_id: r.license for r in licenses.scan_licenses(messy(spark, texts + list(more))).collect()}
    assert [got[k] for k in range(len(texts))] == [x for x in ("MIT", "Apache-2.0", "GPL-3.0", "BSD") for _ in range(3)]
    assert [got[k + len(texts)] for k in range(len(more))] == list(more.values())


def against_sql(docs, got, sql):
    con = duckdb.connect()
    con.register("frame", docs.select("doc_id", "text", "lang", "source").toPandas())
    con.execute("create view documents as select doc_id::bigint as doc_id, text, lang, source from frame")
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    key = lambda r: str(r)
    return sorted((tuple(r[n] for n in names) for r in got.collect()), key=key), sorted(relation.fetchall(), key=key)


def test_mixing_equals_sql_and_keeps_its_budget(spark, empty):
    rng = random.Random(2)
    docs = messy(spark, [" ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, ""])
    got = mixing.mix_report(docs)
    a, b = against_sql(docs, got, mixing.oracle())
    assert a == b
    rows = got.collect()
    total, taken = sum(r.n_tokens for r in rows), sum(r.n_tokens * r.copies for r in rows)
    assert taken <= mixing.SHARE * total and max(r.copies for r in rows) <= mixing.MAX_EPOCHS
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.copies for r in rows)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_redistributes_among_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "src1", 10), ("web", "en", "src2", 1000), ("reference", "en", "src11", 1000)], "domain string, language string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, 0.5, 1, {"domain": {"web": 0.5, "reference": 0.5}}).collect()}
    assert got == {"src1": 10, "src2": 492, "src11": 502}  # the shortage of src1 stays in its domain


def test_mixing_takes_odd_rows(spark, odd):
    report = mixing.mix_report(odd).collect()
    assert len(report) == odd.count() and all(0 <= r.copies <= mixing.MAX_EPOCHS for r in report)
    assert len({r.copies for r in report if r.doc_id == 7 and r.source == "src7"}) <= 1  # repeated rows go together
    taken = mixing.mix(odd)
    assert taken.columns == odd.columns and taken.count() == sum(r.copies for r in report)
    one = odd.filter("doc_id = 5")  # a very long text alone: no prefix holds it
    assert [r.copies for r in mixing.mix_report(one).collect()] == [0]


def test_exact_groups(spark, odd, empty):
    a, b = [{tuple(r) for r in x} for x in against_sql(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), exact_dedup.exact_groups(odd.filter("doc_id is not null").dropDuplicates(["doc_id"])).select("doc_id", "keep_id", "group_size", "kept", "text_sha256"), exact_dedup.ORACLE)]
    assert a == b
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    tie = [r for r in rows if r.doc_id in (7, 8, 9)]
    assert {r.keep_id for r in tie} == {9} and {r.group_size for r in tie} == {4} and sum(r.kept for r in tie) == 1  # the longest original stays
    out = exact_dedup.drop_exact_copies(odd)
    best = {}
    for r in odd.collect():
        t = r.text or ""
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), r.doc_id is None, r.doc_id))
    assert out.columns == odd.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(str(min(g)[2]) for g in best.values())
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_clashing_digests_are_told_apart_by_content(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest", lambda body: F.substring(F.sha2(body, 256), 1, 1))
    rng = random.Random(3)
    texts = [" ".join(f"t{rng.randrange(25)}") + " " * rng.randrange(3) for _ in range(120)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(messy(spark, texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t.replace(" ", ""), []).append((-len(t), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == want


def test_a_hot_text_is_dealt_over_salts(spark):
    docs = messy(spark, ["same text"] * 500 + [f"own {k}" for k in range(100)])
    got = exact_dedup.exact_groups(docs, salts=8).filter("group_size > 1").collect()
    assert len(got) == 500 and {r.keep_id for r in got} == {0} and sum(r.kept for r in got) == 1
