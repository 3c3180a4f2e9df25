"""Licence scan by sentences and rules: sentences of a text are normalised and mapped to the identifiers of known licence sentences; ordered rules name the licences of an identifier sequence.

Normal form: lower case, every run of characters other than a-z and 0-9 as one space; the openings of references ("this code is licensed under the terms of the ...") as `under`. Sentences end at . ! ? ; : before
white space, and at line ends; as licences are often wrapped, the text is also cut without regard to single line ends. Identifiers in the order of their sentences form a sequence for each of the
two cuts, unknown sentences count as gaps. Rules are tried in order, the more specific first; a rule matches where its identifiers follow each other with at most GAP unknown sentences between two; it takes
them out and leaves a mark, which nothing matches across. A text's licences are those found in either sequence.

Plan. One projection over the scan: no shuffle, no Python, nothing broadcast. Every text is cut and tried against every rule. Sentence identifiers are given of texts that hold a word of ANCHOR or a licence. (The DuckDB text cuts
only texts with a word of ANCHOR, and so misses references that have none, such as "released under CC0".)

Defined results. Null, empty or blank text: no sentence, no licence. Null or repeated ids and repeated rows: a row each. Empty table: no rows. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licences with the names that references give them, in normal form.
NAMES = {
    "MIT": ["mit license", "mit licence", "mit"],
    "Apache-2.0": ["apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache 2 0 license", "apache license v2 0"],
    "ISC": ["isc license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3", "gpl version 3", "gplv3"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2", "gpl version 2", "gplv2"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgplv3"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0"],
    "EPL-2.0": ["eclipse public license v 2 0", "eclipse public license version 2 0", "eclipse public license 2 0"],
    "BSL-1.0": ["boost software license version 1 0"],
    "Zlib": ["zlib license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC0-1.0": ["cc0", "cc0 1 0 universal"],
    "Unlicense": ["unlicense"],
}
# Sentences of well-known licences, as their texts have them, with our identifiers.
WORDING = {
    "tag": ["SPDX-License-Identifier", "License", "Licence"],
    "mit_title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit_grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'
    ],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit_asis": ['The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement'],
    "mit_liable": [
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"
    ],
    "isc_grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "isc_asis": [
        'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness',
        'The software is provided "as is" and ISC disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness',
    ],
    "apache2_title": ["Apache License"],
    "apache2_version": ["Version 2.0, January 2004"],
    "apache2_head": ["Apache License Version 2.0, January 2004"],
    "apache2_terms": ["Terms and conditions for use, reproduction, and distribution"],
    "apache2_use": ["you may not use this file except in compliance with the License"],
    "license_copy_at": ["You may obtain a copy of the License at"],
    "apache2_asis": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'
    ],
    "apache2_see": ["See the License for the specific language governing permissions and limitations under the License"],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd_source": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "bsd_binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ],
    "bsd_names": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd_asis": [
        'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed'
    ],
    "gpl_title": ["GNU GENERAL PUBLIC LICENSE"],
    "lgpl_title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "agpl_title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "gpl3_version": ["Version 3, 29 June 2007"],
    "gpl2_version": ["Version 2, June 1991"],
    "lgpl21_version": ["Version 2.1, February 1999"],
    "agpl3_version": ["Version 3, 19 November 2007"],
    "gpl3_head": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2_head": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl_copyleft": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "gpl_free": ["This program is free software", "This library is free software", "This file is free software"],
    "gpl3_later": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "gpl2_later": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "gpl_published": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gpl2_option": ["either version 2 of the License, or (at your option) any later version"],
    "gpl3_option": ["either version 3 of the License, or (at your option) any later version"],
    "gpl2_strict": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "lgpl3_later": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "lgpl21_later": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"
    ],
    "agpl3_later": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "mpl2_title": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "mpl2_form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "epl2_title": ["Eclipse Public License - v 2.0"],
    "bsl1_title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "zlib_asis": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib_held": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "ccby4_title": ["Creative Commons Attribution 4.0 International Public License"],
    "ccbysa4_title": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "ccbync4_title": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "cc0_title": ["CC0 1.0 Universal"],
    "cc0_waive": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "all_rights": ["All rights reserved"],
}
# Rules in order. A name and the identifiers that must follow each other.
RULES = [
    ("Apache-2.0", ("Apache-2.0:ref", "apache2_use", "license_copy_at", "apache2_asis", "apache2_see")),
    ("Apache-2.0", ("Apache-2.0:ref", "apache2_use")),
    ("Apache-2.0", ("apache2_use", "license_copy_at", "apache2_asis")),
    ("Apache-2.0", ("apache2_title", "apache2_version")),
    ("Apache-2.0", ("apache2_head",)),
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "mit_asis", "mit_liable")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis", "mit_liable")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_asis",)),
    ("MIT", ("mit_title",)),
    ("ISC", ("isc_grant", "isc_asis")),
    ("ISC", ("isc_grant",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_asis")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_asis")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_later", "gpl_hope")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_later")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_published", "gpl3_option")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_later", "gpl_hope")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_later")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl_published", "gpl2_option")),
    ("GPL-2.0-only", ("gpl_free", "gpl2_strict")),
    ("LGPL-3.0-or-later", ("gpl_free", "lgpl3_later")),
    ("LGPL-2.1-or-later", ("gpl_free", "lgpl21_later")),
    ("AGPL-3.0-or-later", ("gpl_free", "agpl3_later")),
    ("LGPL-2.1-only", ("lgpl_title", "lgpl21_version")),
    ("LGPL-3.0-only", ("lgpl_title", "gpl3_version")),
    ("AGPL-3.0-only", ("agpl_title", "agpl3_version")),
    ("GPL-3.0-only", ("gpl_title", "gpl3_version")),
    ("GPL-2.0-only", ("gpl_title", "gpl2_version")),
    ("GPL-3.0-only", ("gpl3_head",)),
    ("GPL-2.0-only", ("gpl2_head",)),
    ("MPL-2.0", ("mpl2_form",)),
    ("MPL-2.0", ("mpl2_title",)),
    ("EPL-2.0", ("epl2_title",)),
    ("BSL-1.0", ("bsl1_title",)),
    ("Zlib", ("zlib_asis", "zlib_held")),
    ("CC-BY-NC-4.0", ("ccbync4_title",)),
    ("CC-BY-SA-4.0", ("ccbysa4_title",)),
    ("CC-BY-4.0", ("ccby4_title",)),
    ("CC0-1.0", ("cc0_title",)),
    ("CC0-1.0", ("cc0_waive",)),
    ("Unlicense", ("unlicense",)),
    ("all-rights-reserved", ("all_rights",)),
]
#: Words of the rules' sentences, but not of all references: a text without one is searched like others, but its lone sentences, such as "MIT", are not worth a row's identifiers.
ANCHOR = "licen[cs]e|permission|redistribut|software|copyright|reserved|warranty|universal"
#: Unknown sentences that may lie between two of a rule.
GAP = 2
# In a normal sentence, what opens a reference to a licence.
OPENING = r"^((this|the) [a-z]+ (is|are) )?(licensed|released|distributed|available|provided|published) under (the )?(terms of (the )?)?"


def normal(sentence: str) -> str:
    return re.sub(OPENING, "under ", re.sub("[^a-z0-9]+", " ", sentence.lower()).strip())


# Sentences in normal form -> identifiers. References and tags are built from the names: a reference is a rule by itself, a tag needs the word that introduces it.
SENTENCES = {normal(text): key for key, texts in WORDING.items() for text in texts}
SENTENCES |= {f"under {spoken}": f"{name}:ref" for name, spokens in NAMES.items() for spoken in spokens}
TAGS = {normal(name): f"{name}:tag" for name in (*NAMES, "GPL-3.0-or-later", "GPL-2.0-or-later", "LGPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later")}
SENTENCES = TAGS | SENTENCES
RULES += [(name, (f"{name}:ref",)) for name in NAMES] + [(key.removesuffix(":tag"), ("tag", key)) for key in TAGS.values()]
BLANK = r"[ \t\n\x0B\f\r]"


def _pattern(need) -> str:
    return f"_{{0,{GAP}}}".join(f"<{re.escape(i)}>" for i in need)


def _ids(text, cut_lines: bool):
    """Identifiers of the sentences of a lower-case text, in order; null for unknown ones."""
    text = F.regexp_replace(text, rf"[.!?;:]+({BLANK}+|$)", "\u0001")
    text = F.regexp_replace(text, "\n+" if cut_lines else rf"\n{BLANK}*\n", "\u0001")
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    found = F.transform(F.split(text, "\u0001"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    found = F.transform(F.filter(found, lambda s: s != ""), lambda s: F.when(F.contains(s, F.lit(" under ")), F.regexp_replace(s, OPENING, "under ")).otherwise(s))
    return F.transform(found, lambda s: F.element_at(known, s))


def _known(ids):
    return F.filter(ids, lambda i: i.isNotNull())


def _licences(ids):
    """Names of the rules that match a sequence, written <a><b>_<c>: _ for an unknown sentence, # for what a rule took."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f"<{need[0]}>").alias("head"), F.lit(_pattern(need)).alias("need")) for name, need in RULES])
    written = F.array_join(F.transform(ids, lambda i: F.coalesce(F.concat(F.lit("<"), i, F.lit(">")), F.lit("_"))), "")
    start = F.struct(F.when(F.contains(written, F.lit("<")), written).otherwise(F.lit("")).alias("left"), F.array().cast("array<string>").alias("found"))

    def step(now, rule):
        taken = F.struct(F.regexp_replace(now["left"], rule["need"], F.lit("#")).alias("left"), F.concat(now["found"], F.array(rule["name"])).alias("found"))
        return F.when(F.contains(now["left"], rule["head"]) & F.rlike(now["left"], rule["need"]), taken).otherwise(now)

    return F.aggregate(rules, start, step, lambda now: now["found"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licenses (names joined by +), sentence_ids (joined by |, of the cut at line ends), n_sentences."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = rows.select("doc_id", F.col("text").rlike(ANCHOR).alias("hit"), _ids(F.col("text"), True).alias("by_line"), _ids(F.col("text"), False).alias("wrapped"))
    names = F.array_sort(F.array_distinct(F.concat(_licences(F.col("by_line")), _licences(F.col("wrapped")))))
    rows = rows.select("doc_id", "hit", "by_line", F.array_join(names, "+").alias("licenses"))
    shown = F.col("hit") | (F.col("licenses") != "")
    return rows.select("doc_id", "licenses", F.when(shown, F.array_join("by_line", "|")).otherwise("").alias("sentence_ids"), F.when(shown, F.size(_known(F.col("by_line")))).otherwise(0).cast("long").alias("n_sentences"))


def oracle_sql() -> str:
    """The same in DuckDB: one nested query per rule."""
    space = r"[ \t\n\x0B\f\r]"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in SENTENCES.items()) + "}"

    def ids(cut):
        marked = f"regexp_replace(regexp_replace(text, '[.!?;:]+({space}+|$)', chr(1), 'g'), '{cut}', chr(1), 'g')"
        plain = f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '')"
        return f"list_transform({plain}, lambda s: {known}[regexp_replace(s, '{OPENING}', 'under ')])"

    def named(source):
        q = f"select doc_id, '' as found, array_to_string(list_transform({source}, lambda i: coalesce('<' || i || '>', '_')), '') as seq from cut"
        for name, need in RULES:
            need = quote(_pattern(need))
            q = f"select doc_id, case when regexp_matches(seq, {need}) then found || ',{name}' else found end as found, regexp_replace(seq, {need}, '#', 'g') as seq from ({q})"
        return q

    return f"""
with t as (select doc_id, lower(coalesce(text, '')) as text from documents),
cut as materialized (select doc_id, case when regexp_matches(text, '{ANCHOR}') then {ids(chr(92) + "n+")} else [] end as by_line,
  case when regexp_matches(text, '{ANCHOR}') then {ids(chr(92) + "n" + space + "*" + chr(92) + "n")} else [] end as wrapped from t),
a as ({named("by_line")}), b as ({named("wrapped")})
select cut.doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(a.found || ',' || b.found, ','), lambda x: x <> ''))), '+') as licenses,
  array_to_string(list_filter(by_line, lambda i: i is not null), '|') as sentence_ids, len(list_filter(by_line, lambda i: i is not null)) as n_sentences
from cut join a on a.doc_id = cut.doc_id join b on b.doc_id = cut.doc_id
"""
