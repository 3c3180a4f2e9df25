"""Licence scan, language identification and toxicity."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signaloom.llm import language, license, toxicity
from signaloom.llm.shingles import buffers

MIT = """The MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def scanned(spark, rows):
    return [(r.doc_id, r.licenses, r.n_sentences) for r in license.license_scan(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, licenses string")).collect()]


def test_license_scan(spark):
    rows = [(1, MIT), (2, "x y\nLicensed under the Apache License, Version 2.0."), (3, None), (4, ""), (5, " \n"), (6, "the licence of poets"), (7, "Released under the MIT License. Licensed under CC BY-NC 4.0.\nAll rights reserved."), (None, "w " * 100_000 + ".\nReleased under the MIT License."), (7, "no")]
    rows.append((8, "You may not use this file except in compliance with the License. Licensed under the Apache License, Version 2.0"))
    want = [(1, "MIT", 1), (2, "Apache-2.0", 1), (3, "", 0), (4, "", 0), (5, "", 0), (6, "", 0), (7, "CC-BY-NC-4.0+MIT+all-rights-reserved", 3), (None, "MIT", 1), (7, "", 0), (8, "Apache-2.0", 2)]
    assert scanned(spark, rows) == want
    assert license.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


BSD = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES_3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
KNOWN = [
    ("MIT", MIT + "\n" + WARRANTY),
    ("MIT", WARRANTY),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "This code is licensed under the MIT license."),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nimport os"),
    ("BSD-2-Clause", BSD + AS_IS),
    ("BSD-3-Clause", BSD + NAMES_3 + AS_IS),
    ("GPL-3.0-or-later", GPL3),
    ("GPL-2.0-or-later", GPL3.replace("Foundation, either version 3", "Foundation; either version 2")),
    ("GPL-3.0-or-later", "License: GPL-3.0-or-later"),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n"),
    ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999"),
    ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nA foreign sentence.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
]


def test_public_wordings(spark):
    got = scanned(spark, [(k, text) for k, (_, text) in enumerate(KNOWN)])
    assert [x[1] for x in got] == [name for name, _ in KNOWN]


def test_rules_do_not_reach_across_matches_or_long_gaps(spark):
    later = "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    rows = [(1, f"This program is free software. Licensed under the Apache License, Version 2.0. {later}"), (2, f"This program is free software. {later}"), (3, f"This program is free software. One. Two. {later}"), (4, f"This program is free software. One. Two. Three. {later}"), (5, f"{later} This program is free software.")]
    assert [x[1] for x in scanned(spark, rows)] == ["Apache-2.0", "GPL-3.0-or-later", "GPL-3.0-or-later", "", ""]


def test_every_rule_has_a_sentence_with_an_anchor():
    of = {}
    for sentence, key in license.SENTENCES.items():
        of.setdefault(key, []).append(sentence)
    for name, need in license.RULES:
        assert any(all(re.search(license.ANCHOR, s) for s in of[key]) for key in need) or (name == "CC0-1.0" or need[0].endswith(":ref") or need[0] == "tag"), need


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 40):
        code = language.codewords(n)
        apart = (code[:, None] != code[None, :]).sum(2) + 99 * np.eye(n, dtype=int)
        assert apart.min() >= (1 if n == 2 else 2 if n == 3 else 4 if n == 4 else 8)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1_000 and len(held) > 250 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.keep_identified(docs).columns == docs.columns and language.keep_identified(docs).count() >= 980


def test_language_edges(spark):
    learn = [(i, "the of and that with this" if i % 2 else "der die und nicht ein das", "en" if i % 2 else "de") for i in range(60)]
    more = [(None, "the of and", None), (101, None, "en"), (102, "", None), (103, "12 34 !", "de"), (104, "der die und nicht " * 50_000, None), (104, "das", None), (105, "x", None)]
    df = spark.createDataFrame([(*r, 0.5, True) for r in learn + more], "doc_id long, text string, lang string, score double, held_out boolean")
    got = language.language_id(df).filter("doc_id is null or doc_id > 100").collect()
    by = [(r.doc_id, r.lang_pred) for r in got if r.doc_id != 105]
    assert sorted(by, key=repr) == sorted([(None, "en"), (101, "und"), (102, "und"), (103, "und"), (104, "de"), (104, "de")], key=repr)
    assert language.language_id(df.limit(0)).collect() == []
    assert {r.lang_pred for r in language.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in language.language_id(df.withColumn("lang", F.lit("en"))).collect()} == {"und", "en"}


def test_margins_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    tables = [rng.normal(size=(1 << language.BITS, 3)).astype(np.float32) for _ in language.ORDERS]
    data, offsets = buffers(pa.array(["abc déf ghi" * 9, None, "", "x", "xy", "long text here " * 40, "end"]))
    want = language.margins(data, offsets, tables)
    for chunk in (7, 64):
        monkeypatch.setattr(language, "CHUNK", chunk)
        assert np.allclose(language.margins(data, offsets, tables), want, atol=1e-5)


def toxic_corpus(n=500):
    rng = np.random.default_rng(1)
    clean = ["ba", "ko", "mi", "ru", "te", "lo", "sa", "ni"]
    word = lambda: "".join(rng.choice(clean, rng.integers(1, 5)))
    rows, labels = [], []
    for i in range(n):
        words, bad = [word() for _ in range(int(rng.integers(3, 80)))], i % 5 == 0
        if bad:
            words[int(rng.integers(0, len(words)))] = str(rng.choice(["grumpfing", "zwickex", "grumpfed"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    extra = [(1000, "ba ko grumpfingz mi"), (1001, None), (1002, ""), (1003, "  "), (1004, "ba ko mi " * 60_000), (1005, "ba ko " * 60_000 + "zwickex"), (None, "Grumpfing!")]
    df = spark.createDataFrame([(*r, 2.0) for r in rows + extra], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (1004, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 1004, 1005, None)] == [1, 0, 0, 0, 0, 1, 1]
    assert toxicity.toxicity(df.limit(0), lab).collect() == []
    assert {r.predicted for r in toxicity.toxicity(df, lab.limit(0)).collect()} == {0}


def grams_of(word):
    """The n-gram buckets of a word, from the definition."""
    out = []
    whole = [32, *(toxicity._FOLD[b] for b in word.encode()), 32]
    for order in toxicity.ORDERS:
        for i in range(len(whole) - order + 1):
            part = [int(x) for x in whole[i : i + order]]
            if 32 in part[1:-1]:
                continue
            h = 0
            for x in part:
                h = (h + x + 1) * 0x01000193 % 2**32
            out.append((h * 0x9E3779B1 % 2**32) >> (32 - toxicity.BITS))
    return out


def brute_scores(text, number):
    words = [[np.mean([own[g] for g in grams_of(w)]) for w in (text or "").split()] for own in number]
    return [max((sum(x[k : k + span]) for k in range(len(x))), default=toxicity.FLOOR) for x, span in zip(words, toxicity.SPANS)]


def test_text_scores_equal_brute_force_at_any_chunk(monkeypatch):
    rng = np.random.default_rng(2)
    number = rng.normal(size=(len(toxicity.SPANS), 1 << toxicity.BITS))
    texts = ["ab cde", "", "f", None, "ghij kl m " * 30, " k ", "lmnopqrstuvw" * 5, "ab", "cde", "ä b\tc\nd e f g"]
    data, offsets = buffers(pa.array(texts))
    want = np.array([brute_scores(t, number) for t in texts])
    for chunk in (5, 33, 1 << 20):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert np.allclose(toxicity.text_scores(data, offsets, number), want)


def test_a_phrase_of_ordinary_words_is_caught():
    rng = np.random.default_rng(4)
    vocabulary = [a + b + c for a in "ba ko mi ru te lo".split() for b in "sa ni du pe".split() for c in ("", "n", "ral", "st")]

    def text(toxic):
        words = list(rng.choice(vocabulary, rng.integers(30, 120)))
        if toxic:
            k = rng.integers(0, len(words) - 4)
            words[k : k + 3] = ["kosa", "minin", "rudu"]
        return " ".join(words)

    toxic = rng.random(1_600) < 0.25
    texts = [text(t) for t in toxic]
    model = toxicity.Model(texts[:1_200], toxic[:1_200].astype(int), prior=0.25)
    hit = model.probability(*buffers(pa.array(texts[1_200:]))) >= toxicity.THRESHOLD
    assert hit[toxic[1_200:]].mean() > 0.9 and toxic[1_200:][hit].mean() > 0.8


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in toxicity.toxicity(docs, labels).join(labels, "doc_id").collect() if r.held_out and r.toxic is not None]
    hit = [r for r in rows if r.predicted]
    assert len(rows) > 900 and sum(r.toxic for r in hit) / len(hit) >= 0.85 and sum(r.toxic for r in hit) / sum(r.toxic for r in rows) >= 0.9


def test_margins_and_decoding_equal_brute_force():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdefgh "), 60)) if k % 2 else "".join(rng.choice(list("stuvwxyz "), 60)) for k in range(40)] + ["".join(rng.choice(list("klmnop "), 60)) for _ in range(20)]
    model = language.Model(texts, ["x" if k % 2 else "y" for k in range(40)] + ["z"] * 20)
    tests = ["abc hgf", "zyx wvu", "klm", "a", "", "ab", "été abcd 12 zz"]

    def hashed(part, order):
        h = part[0]
        for x in part[1:]:
            h = (h * (257 if order == 2 else 0x01000193) + x) % 2**32
        return (h if order == 2 else (h * 0x9E3779B1 % 2**32) >> (32 - language.BITS)) % (1 << language.BITS)

    want = []
    for t in tests:
        data, total, n = [int(language._FOLD[b]) for b in t.encode()], np.zeros(model.code.shape[1]), 0
        for order, table in zip(language.ORDERS, model.tables):
            for i in range(len(data) - order + 1):
                total, n = total + table[hashed(data[i : i + order], order)], n + 1
        want.append(total / max(n, 1))
    got = language.margins(*buffers(pa.array(tests)), model.tables)
    assert np.allclose(got, want, atol=1e-5)
    best, score, close = model.decode(got)
    for m, b, s, c in zip(want, best, score, close):
        loss = [sum(w * np.log1p(np.exp(-f * bit)) for w, f, bit in zip(model.weight[k], m * model.slope, model.code[k])) for k in range(3)]
        p = np.exp(-np.array(loss) * model.code.shape[1])
        p = np.sort(p / p.sum())
        assert loss[b] == pytest.approx(min(loss)) and s == pytest.approx(p[-1], abs=1e-5) and c == (p[-1] - p[-2] < language.CLOSE)
    assert [model.languages[k] for k in best[:3]] == ["x", "y", "z"]


def test_licences_without_an_anchor_word_are_found(spark):
    assert scanned(spark, [(1, "This project is released under CC0."), (2, "Available under the terms of the GPLv3.\nMore text."), (3, "Plain prose."), (4, None)]) == [(1, "CC0-1.0", 1), (2, "GPL-3.0-only", 1), (3, "", 0), (4, "", 0)]
