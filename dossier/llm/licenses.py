r"""Licence scan by sentence rules, with DataFrame functions alone.

Texts are cut into sentences: a sentence ends at `.`, `!`, `?` or `:` (with closing quotes and brackets) before white space
or the text's end, and at a line without letters and digits, but not at other line ends, so wrapped, indented and commented
notices are read as they are meant. Sentences are normalised (A-Z lower-cased, every run of other characters than letters
and digits one space) and those known as licence sentences become their identifiers; of a sentence that isn't known, each
line is looked up by itself, so a notice on a line of its own is found without a full stop before it. In the sequence of a
document's identifiers, in order of position, each licence rule (an ordered list of identifiers, some of them optional)
matches wherever its list occurs without another identifier between.

Defined results: null, empty and licence-free texts have an empty identifier sequence and no licence; repeated rows are
scanned one by one; an empty table gives no rows; further columns stay in `scan` and are ignored by `digest`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

#: Sentences of published licences and notices, in their own wording.
PUBLISHED = {
    "apache2-short": "Licensed under the Apache License, Version 2.0",
    "apache2-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache2-may-not-use": "you may not use this file except in compliance with the License",
    "apache2-copy-at": "You may obtain a copy of the License at",
    "apache2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "MIT License",
    "mit-the-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit-grant-whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-liable": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "all-rights-reserved": "All rights reserved.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software:",
    "gpl-library-free": "This library is free software:",
    "gpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "agpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "gpl-useful": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "cc-by4-short": "Licensed under CC BY 4.0",
    "cc-by-nc4-short": "Licensed under CC BY-NC 4.0",
    "cc-by4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
}
#: Ordered rules; a licence may have several, and `?` marks what may be missing.
RULES = [
    ("Apache-2.0", ["apache2-short"]),
    ("Apache-2.0", ["apache2-short", "apache2-may-not-use", "apache2-copy-at"]),
    ("Apache-2.0", ["apache2-header", "apache2-copy-at?", "apache2-as-is?", "apache2-see?"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-title?", "mit-the-title?", "all-rights-reserved?", "mit-grant-whole", "mit-notice", "mit-as-is?", "mit-liable?"]),
    ("MIT-0", ["mit-grant-whole", "mit-as-is"]),
    ("ISC", ["isc-grant", "isc-as-is?", "isc-liable?"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("BSD", ["bsd-redistribute"]),
    ("BSD-with-rights", ["all-rights-reserved", "bsd-redistribute"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is?"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-3.0-or-later", ["gpl3-redistribute"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-later"]),
    ("GPL-3.0-only", ["gpl-free", "gpl3-only"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-useful?"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-later"]),
    ("LGPL-3.0-or-later", ["gpl-free?", "gpl-library-free?", "lgpl3-later"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy-https"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("BSL-1.0", ["bsl-distributed"]),
    ("BSL-1.0", ["bsl-title", "bsl-grant"]),
    ("CC-BY-4.0", ["cc-by4-short"]),
    ("CC-BY-4.0", ["cc-by4-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-work"]),
    ("CC0-1.0", ["cc0-dedicated"]),
    ("EPL-2.0", ["epl2-terms"]),
]
#: What ends a sentence, as patterns that Java and RE2 read alike; other line ends only end a line.
SENTENCE_END = r"""[.!?:]+["')\]]*(?:[ \t\r\n]+|\z)|\n[ \t\r*#/;%>|-]*\n"""
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: A sign between sentences; nothing is lost if a text holds it, which then ends a sentence too.
SENTENCE = "\x01"
SENTENCES = {k: re.sub(r"[^a-z0-9]+", " ", s.lower()).strip() for k, s in PUBLISHED.items()}


def rule_pattern(rule: list[str]) -> str:
    """A rule as a pattern over identifiers that each have a comma before and after them."""
    return "".join(f"(?:,{k[:-1]},)?" if k.endswith("?") else f",{k}," for k in rule)


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    known = F.create_map(*(F.lit(x) for k, s in SENTENCES.items() for x in (s, k)))

    def look(s):
        return F.try_element_at(known, F.trim(F.regexp_replace(s, OTHER, " ")))

    def ids(s):
        own = look(s)
        lines = F.filter(F.transform(F.split(s, "\n"), look), lambda k: k.isNotNull())
        return F.when(own.isNotNull(), F.array(own)).when(s.contains("\n"), lines).otherwise(F.array().cast("array<string>"))

    marked = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SENTENCE_END, SENTENCE)
    return F.flatten(F.transform(F.split(marked, SENTENCE), ids))


def scan(docs: DataFrame) -> DataFrame:
    """docs with license_sentences (identifiers in order) and licenses (sorted, distinct)."""
    ids, found = fresh("license_sentences", docs.columns), fresh("licenses", docs.columns)
    joined = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    matches = F.array(*(F.when(joined.rlike(rule_pattern(rule)), F.lit(name)) for name, rule in RULES))
    # Hardly any text speaks of a licence: a plain search spares the others the sentence cutting.
    likely = F.coalesce(ascii_lower(F.col("text")), F.lit("")).rlike(LIKELY)
    empty = F.array().cast("array<string>")
    return docs.withColumn(ids, F.when(likely, sentence_ids(F.col("text"))).otherwise(empty)).withColumn(
        found,
        F.when(F.size(ids) == 0, empty).otherwise(F.array_sort(F.array_distinct(F.filter(matches, lambda x: x.isNotNull())))),
    )


#: Some part of every known sentence.
LIKELY = "licen|permi|distribut|rights|software|warrant"


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("license_sentences").cast("long").alias("n_sentences"),
        F.array_join("license_sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"),
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NORMAL = r"trim(regexp_replace({}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'))"
ORACLE = rf"""
WITH known AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(s)})" for k, s in SENTENCES.items())}) t(id, s)),
parts AS (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 {_quoted(SENTENCE_END)}, chr(1), 'g'), chr(1)) AS p FROM documents),
cut AS (SELECT doc_id, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS n FROM parts),
whole AS (SELECT c.doc_id, c.s, c.n, k.id FROM cut c LEFT JOIN known k ON k.s = {_NORMAL.format("c.s")}),
lines AS (SELECT doc_id, n, unnest(string_split(s, chr(10))) AS s, unnest(range(1, len(string_split(s, chr(10))) + 1)) AS m
 FROM whole WHERE id IS NULL AND contains(s, chr(10))),
hit AS (SELECT doc_id, n, 0 AS m, id FROM whole WHERE id IS NOT NULL
 UNION ALL SELECT l.doc_id, l.n, l.m, k.id FROM lines l JOIN known k ON k.s = {_NORMAL.format("l.s")}),
seq AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY n, m) AS ids, ',' || string_agg(id, ',,' ORDER BY n, m) || ',' AS run FROM hit GROUP BY doc_id),
rules AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(rule_pattern(r))})" for n, r in RULES)}) t(name, pattern)),
lic AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT s.doc_id, r.name FROM seq s JOIN rules r ON regexp_matches(s.run, r.pattern)) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_sentences, coalesce(s.ids, '') AS sentences, coalesce(l.names, '') AS licenses
FROM documents d LEFT JOIN seq s ON d.doc_id = s.doc_id LEFT JOIN lic l ON d.doc_id = l.doc_id
"""
