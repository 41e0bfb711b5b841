"""Licence scan by sentence rules, in DataFrame functions only.

Wrapped lines are joined, a text's sentences are normalised, and the known licence phrases in them become identifiers, in
order; a sentence without any drops out of the sequence but leaves a gap. A licence is recognised where its ordered
rule, a sequence of identifiers, occurs with at most ``max_gap`` unknown sentences between neighbours.

The SQL knows only notices of one line that are whole sentences. The operator gives the same rows for those and also
finds the official texts, wrapped or not.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Sentences that grant, name or disclaim a licence, normalised (lower case, runs of anything but letters
# and digits become one blank), and their identifiers of three characters.
SENTENCES = {
    "released under the mit license": "m01",
    "licensed under the mit license": "m01",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "m02",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "m03",
    "the software is provided as is without warranty of any kind": "m04",
    "licensed under the apache license version 2 0": "a01",
    "you may not use this file except in compliance with the license": "a02",
    "you may obtain a copy of the license at": "a03",
    "this work is licensed under the gnu general public license version 3": "g01",
    "this program is free software you can redistribute it and or modify it": "g02",
    "this program is distributed in the hope that it will be useful but without any warranty": "g03",
    "licensed under cc by nc 4 0": "c01",
    "licensed under cc by 4 0": "c02",
    "redistribution and use in source and binary forms with or without modification are permitted": "b01",
    "all rights reserved": "r01",
}
# Licences and the ordered identifiers that prove them; the first rule that fits names the licence.
RULES = [
    ("MIT", ["m02", "m03", "m04"]),
    ("MIT", ["m01"]),
    ("Apache-2.0", ["a01", "a02", "a03"]),
    ("Apache-2.0", ["a01"]),
    ("GPL-3.0", ["g02", "g03"]),
    ("GPL-3.0", ["g01"]),
    ("CC-BY-NC-4.0", ["c01"]),
    ("CC-BY-4.0", ["c02"]),
    ("BSD", ["b01", "m04"]),
    ("proprietary", ["r01"]),
]
# Phrases of the official texts beside the notices above. Several phrases may share an identifier.
OFFICIAL = {
    "licenses this file to you under the apache license version 2 0": "a01",
    "apache license version 2 0 january 2004": "a04",
    "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license": "g05",
    "gnu general public license version 3 29 june 2007": "g04",
    "creative commons attribution noncommercial 4 0 international": "c03",
    "creative commons attribution 4 0 international": "c04",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "b02",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "b03",
}
# Licences that the notices above don't name, each with the ordered phrases of its official text, and the
# identifiers of those phrases.
FURTHER = [
    ("GPL-2.0", [("g02", "this program is free software you can redistribute it and or modify it"), ("g06", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license")]),
    ("GPL-2.0", [("g07", "gnu general public license version 2 june 1991")]),
    ("LGPL-3.0", [("l01", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license")]),
    ("LGPL-3.0", [("l02", "gnu lesser general public license version 3 29 june 2007")]),
    ("LGPL-2.1", [("l03", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license")]),
    ("LGPL-2.1", [("l04", "gnu lesser general public license version 2 1 february 1999")]),
    ("AGPL-3.0", [("f01", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license")]),
    ("AGPL-3.0", [("f02", "gnu affero general public license version 3 19 november 2007")]),
    ("MPL-2.0", [("p01", "this source code form is subject to the terms of the mozilla public license v")]),
    ("MPL-2.0", [("p02", "mozilla public license version 2 0")]),
    ("MPL-1.1", [("p03", "the contents of this file are subject to the mozilla public license version 1 1")]),
    ("EPL-2.0", [("e01", "made available under the terms of the eclipse public license 2 0")]),
    ("EPL-2.0", [("e02", "eclipse public license v 2 0")]),
    ("EPL-1.0", [("e03", "made available under the terms of the eclipse public license v1 0")]),
    ("BSD-3-Clause", [("b02", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"), ("b03", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"), ("b04", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission")]),
    ("BSD-4-Clause", [("b05", "all advertising materials mentioning features or use of this software must display the following acknowledgement")]),
    ("ISC", [("i01", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"), ("i02", "the software is provided as is and the author disclaims all warranties with regard to this software")]),
    ("0BSD", [("i03", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"), ("i02", "the software is provided as is and the author disclaims all warranties with regard to this software")]),
    ("Unlicense", [("u01", "this is free and unencumbered software released into the public domain")]),
    ("public-domain", [("u02", "this work is in the public domain")]),
    ("CC0-1.0", [("z01", "has waived all copyright and related or neighboring rights")]),
    ("CC0-1.0", [("z02", "cc0 1 0 universal")]),
    ("CC-BY-SA-4.0", [("c05", "creative commons attribution sharealike 4 0 international")]),
    ("CC-BY-SA-4.0", [("c06", "licensed under cc by sa 4 0")]),
    ("CC-BY-ND-4.0", [("c07", "creative commons attribution noderivatives 4 0 international")]),
    ("CC-BY-NC-SA-4.0", [("c08", "creative commons attribution noncommercial sharealike 4 0 international")]),
    ("CC-BY-NC-ND-4.0", [("c09", "creative commons attribution noncommercial noderivatives 4 0 international")]),
    ("BSL-1.0", [("o01", "boost software license version 1 0")]),
    ("Zlib", [("y01", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"), ("y02", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software")]),
    ("WTFPL", [("w01", "do what the fuck you want to public license")]),
    ("Artistic-2.0", [("t01", "the artistic license 2 0")]),
    ("PostgreSQL", [("q01", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted")]),
    ("HPND", [("x01", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee")]),
    ("OFL-1.1", [("h01", "sil open font license version 1 1")]),
    ("PSF-2.0", [("n01", "python software foundation license version 2")]),
    ("CDDL-1.0", [("d01", "common development and distribution license cddl version 1 0")]),
    ("MS-PL", [("k01", "microsoft public license ms pl")]),
    ("BUSL-1.1", [("s01", "business source license 1 1")]),
    ("SSPL-1.0", [("s02", "server side public license version 1 october 16 2018")]),
    ("EUPL-1.2", [("v01", "european union public licence v 1 2")]),
    ("MIT-0", [("m05", "mit no attribution")]),
]
#: Identifier lines (``SPDX-License-Identifier: MIT``), a phrase for each licence and its usual variants, built by a rule.
_NAMES = [name for name in dict.fromkeys([n for n, _ in RULES] + [n for n, _ in FURTHER]) if name not in ("proprietary", "BSD", "public-domain")]
_VARIANTS = {name: [name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name] for name in _NAMES} | {"BSD-2-Clause": ["BSD-2-Clause"]}
DECLARED = {f"spdx license identifier {v.lower().replace('-', ' ').replace('.', ' ')}": (f"{k:03d}", name) for k, (name, vs) in enumerate(_VARIANTS.items()) for v in vs}
PHRASES = SENTENCES | OFFICIAL | {phrase: i for _, seq in FURTHER for i, phrase in seq} | {phrase: i for phrase, (i, _) in DECLARED.items()}
# GPL's own notice names its version: the sentences of g02 and g03 alone are also those of version 2.
ALL_RULES = [
    *(r for r in RULES if r[1] != ["g02", "g03"]),
    ("Apache-2.0", ["a04"]),
    ("GPL-3.0", ["g02", "g05"]),
    ("GPL-3.0", ["g04"]),
    ("CC-BY-NC-4.0", ["c03"]),
    ("CC-BY-4.0", ["c04"]),
    ("BSD", ["b01", "b02", "b03"]),
    *((name, [i for i, _ in seq]) for name, seq in FURTHER),
    *((name, [i]) for i, name in dict.fromkeys(DECLARED.values())),
]
_ORDER = list(dict.fromkeys(name for name, _ in RULES + ALL_RULES))
ALL_RULES.sort(key=lambda r: _ORDER.index(r[0]))  # by licence, as in RULES, then FURTHER


def _keys(phrases: list[str]) -> list[str]:
    """Words of which every phrase has one: the longest that it has among those taken, else its own longest."""
    taken: list[str] = []
    for phrase in sorted(phrases, key=lambda p: max(map(len, p.split()))):
        words = phrase.split()
        if not any(w in taken for w in words):
            taken.append(max(words, key=len))
    return taken


#: Every known phrase holds one of these words whole; texts without them need no splitting.
KEYS = "|".join(sorted(_keys(list(PHRASES))))
#: A sentence ends at an empty line, or at . ! or ? before white space or the end of the text. Other line ends wrap it.
STOPS = r"(?:\r\n|\r(?!\n)|\n)[\x20\t]*[\r\n]\s*|[.!?]+(?=[\x20\x09-\x0D]|$)"
#: The longest phrases first, so that none hides a longer one that starts with it.
PHRASE = f"(?<![a-z0-9])(?:{'|'.join(sorted(PHRASES, key=len, reverse=True))})(?![a-z0-9])"
#: The SQL's sentence ends: a line end, or . ! ? ; or : before white space or the end of the text.
ENDS = r"[\n\r]+|[.!?;:]+(?=[\x20\x09-\x0D]|$)"
MAX_GAP = 2
UNKNOWN = "---"


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's phrases in order, ``---`` for a sentence without any; empty sentences are left out."""
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in PHRASES.items()))
    clean = F.transform(F.split(text, STOPS), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    phrases = F.transform(F.filter(clean, lambda s: s != ""), lambda s: F.regexp_extract_all(s, F.lit(PHRASE), F.lit(0)))
    return F.flatten(F.transform(phrases, lambda p: F.when(F.size(p) == 0, F.array(F.lit(UNKNOWN))).otherwise(F.transform(p, lambda x: F.element_at(known, x)))))


def rule_pattern(ids: list[str], max_gap: int) -> str:
    return rf"( {UNKNOWN}){{0,{max_gap}}} ".join(ids)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_gap: int = MAX_GAP) -> DataFrame:
    """One row for each input row: ``doc_id, n_sentences`` (known phrases), ``sentence_ids`` (in order, comma-joined),
    ``licenses`` (names in rule order, comma-joined), ``license`` (the first, else null).

    Null and empty texts have no sentence. A phrase counts as often as it occurs. Row-local: no shuffle.
    """
    text = text_or_empty(text_col)
    ids = F.when(F.lower(text).rlike(KEYS), sentence_ids(text)).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col(id_col).alias("doc_id"), ids.alias("ids"))
    line = F.array_join("ids", " ")
    fits = [F.when(line.rlike(rule_pattern(seq, max_gap)), F.lit(name)) for name, seq in ALL_RULES]
    out = out.withColumn("found", F.array_distinct(F.array_compact(F.array(*fits))))
    seen = F.filter("ids", lambda x: x != UNKNOWN)
    return out.select(
        "doc_id",
        F.size(seen).cast("long").alias("n_sentences"),
        F.array_join(seen, ",").alias("sentence_ids"),
        F.array_join("found", ",").alias("licenses"),
        F.when(F.size("found") > 0, F.element_at("found", 1)).alias("license"),
    )


def oracle(max_gap: int = MAX_GAP) -> str:
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items())
    ends = ENDS.replace("(?=[\\x20\\x09-\\x0D]|$)", "([\\x20\\x09-\\x0D]|$)")  # RE2 has no look-ahead; white space at an end is trimmed anyway
    fits = ", ".join(f"case when regexp_matches(line, '{rule_pattern(seq, max_gap)}') then '{name}' end" for name, seq in RULES)
    return rf"""
with s as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{ends}'),
             lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') as clean from documents),
i as (select doc_id, list_transform(clean, lambda x: coalesce(map {{{pairs}}}[x], '{UNKNOWN}')) as ids from s),
f as (select doc_id, list_filter(ids, lambda x: x <> '{UNKNOWN}') as seen, list_aggregate(ids, 'string_agg', ' ') as line from i),
r as (select doc_id, seen, list_filter([{fits}], lambda x: x is not null) as found from f),
u as (select doc_id, seen, list_filter(found, lambda x, k: list_position(found, x) = k) as found from r)
select doc_id, len(seen)::bigint as n_sentences, coalesce(list_aggregate(seen, 'string_agg', ','), '') as sentence_ids,
       coalesce(list_aggregate(found, 'string_agg', ','), '') as licenses, found[1] as license from u
"""
