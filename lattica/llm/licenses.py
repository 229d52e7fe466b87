"""Licence scans by sentence-rule recognition, in Spark expressions only.

A text is cut into sentences, each sentence is normalised and looked up among the known licence sentences, and the
sequence of identifiers of a document is matched against ordered licence rules (the longest and most specific first).
The plan is one projection over the scan: no shuffle, no Python, no state that grows with the data.

Two views of a text are read, because licences come both as single lines and as wrapped paragraphs: in the line view
every newline ends a sentence, in the paragraph view only a blank line does. Results of both are united.

Defined results: a null or empty text has no identifiers and no licences; repeated rows give repeated results; columns
besides the id and the text are ignored, so extra ones with any name are harmless.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sentences of well-known licence texts, by identifier.
SENTENCES = {
    "MIT_GRANT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "MIT_NOTICE": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MIT_WARRANTY": 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement',
    "MIT_LIABILITY": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    "ISC_GRANT": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "ISC_WARRANTY": 'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness',
    "BSD_GRANT": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD_SOURCE": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BSD_BINARY": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BSD_ENDORSE": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD_WARRANTY": 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed',
    "APACHE_GRANT": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "APACHE_COPY": "You may obtain a copy of the License at",
    "APACHE_WARRANTY": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "APACHE_SEE": "See the License for the specific language governing permissions and limitations under the License",
    "GPL_FREE": "This program is free software",
    "GPL2_LATER": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL3_LATER": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL2_NOTICE": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL3_NOTICE": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    "GPL_WARRANTY": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "GPL_SEE": "See the GNU General Public License for more details",
    "MPL2_GRANT": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "UNLICENSE_GRANT": "This is free and unencumbered software released into the public domain",
    "ALL_RIGHTS": "All rights reserved",
}
# Names under which short statements cite a licence, by SPDX identifier.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPLv3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0", "Creative Commons Zero"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "ISC": ["ISC License", "ISC"],
} | {f"{x}-{which}": [f"{x}-{which}"] for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for which in ("only", "or-later")}
# How short statements begin.
OPENINGS = ["released under", "licensed under", "distributed under", "available under", "published under", "this work is licensed under", "this file is licensed under", "this project is licensed under", "this software is licensed under", "this software is released under", "this code is released under", "this text is licensed under"]
# Licence rules, first match wins; each is a sequence of sentence identifiers.
RULES = [
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY", "MIT_LIABILITY"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("Apache-2.0", ["APACHE_GRANT", "APACHE_COPY", "APACHE_WARRANTY", "APACHE_SEE"]),
    ("Apache-2.0", ["APACHE_GRANT"]),
    ("GPL-3.0-or-later", ["GPL_FREE", "GPL3_LATER"]),
    ("GPL-2.0-or-later", ["GPL_FREE", "GPL2_LATER"]),
    ("GPL-3.0-or-later", ["GPL3_NOTICE"]),
    ("GPL-2.0-or-later", ["GPL2_NOTICE"]),
    ("ISC", ["ISC_GRANT", "ISC_WARRANTY"]),
    ("ISC", ["ISC_GRANT"]),
    ("MPL-2.0", ["MPL2_GRANT"]),
    ("Unlicense", ["UNLICENSE_GRANT"]),
    ("all-rights-reserved", ["ALL_RIGHTS"]),
    ("MIT-incomplete", ["MIT_GRANT"]),
    ("BSD-incomplete", ["BSD_GRANT"]),
]
# Each known sentence holds one of these; a text without any needs no cutting into sentences.
ANCHORS = ["licen", "permi", "copyright", "warrant", "redistribut", "under", "right", "free", "gnu"]

#: The end of a sentence, and what a sentence's words are separated by. Both are read alike by Java's and RE2's engines.
END, GAP = r"[.!?:]+([ \t\r\n]|\z)", r"[^a-z0-9\n]+"
BLANK_LINE = r"\n[ \t\r]*\n"


def normal(sentence: str) -> str:
    """The form in which sentences are compared: lower-case words of a-z and 0-9, one space between them."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def pieces(sentence: str) -> list[str]:
    """The normalised sentences that END makes of one; those without an anchor ("2.0" after "v.") tell nothing alone."""
    cut = map(normal, re.sub(END.replace(r"\z", r"\Z"), "\n", sentence).split("\n"))
    return [x for x in cut if any(a in x for a in ANCHORS)]


def sentence_ids() -> dict[str, str]:
    """Normalised sentence -> identifier; statements such as "released under the MIT License" get SAYS_<licence>."""
    found = {x: name for name, s in SENTENCES.items() for x in pieces(s)}
    for spdx, names in NAMES.items():
        for name in names:
            for opening in OPENINGS:
                for article in ("", "the ", "the terms of the "):
                    found.setdefault(normal(f"{opening} {article}{name}"), f"SAYS_{spdx}")
            found.setdefault(normal(f"SPDX-License-Identifier: {name}").split("identifier ")[1] + " spdx", f"SAYS_{spdx}")
    return found


def rules() -> list[tuple[str, str]]:
    """(sequence of identifiers, licence), in the order in which they are tried."""
    return [("".join(f"<{x}>" for x in ids), spdx) for spdx, ids in RULES] + [(f"<SAYS_{spdx}>", spdx) for spdx in NAMES]


def rule_pattern() -> str:
    return "|".join(re.sub(r"[.-]", lambda m: "\\" + m[0], seq) for seq, _ in rules())


def _literal_map(pairs) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def _identifiers(lowered: Column) -> Column:
    """Identifiers of the known sentences of a text, in the order of the text."""
    tagged = F.regexp_replace(lowered, r"spdx-license-identifier:[ \t]*([a-z0-9.-]+)", "\n$1 spdx\n")
    words = F.regexp_replace(F.regexp_replace(tagged, END, "\n"), GAP, " ")
    known = _literal_map(sentence_ids().items())
    return F.filter(F.transform(F.split(words, r" ?\n[ \n]*"), lambda s: F.element_at(known, F.trim(s))), lambda x: x.isNotNull())


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, line_ids and paragraph_ids (identifiers as <A><B>...), n_known long (of the line
    view), licenses (sorted, comma-joined) and n_licenses long."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    t = docs.select(F.col(id_col), lowered.alias("_t"))
    maybe = F.col("_t").contains(ANCHORS[0])
    for word in ANCHORS[1:]:
        maybe = maybe | F.col("_t").contains(word)
    none = F.array().cast("array<string>")
    paragraphs = F.translate(F.regexp_replace("_t", BLANK_LINE, ". "), "\n", " ")
    t = t.select(id_col, F.when(maybe, _identifiers(F.col("_t"))).otherwise(none).alias("_a"), F.when(maybe, _identifiers(paragraphs)).otherwise(none).alias("_b"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    t = t.select(id_col, F.size("_a").cast("long").alias("n_known"), joined("_a").alias("line_ids"), joined("_b").alias("paragraph_ids"))
    licence = _literal_map(rules())
    matched = lambda c: F.transform(F.regexp_extract_all(c, F.lit(rule_pattern()), F.lit(0)), lambda x: F.element_at(licence, x))
    t = t.withColumn("_l", F.array_sort(F.array_union(matched("line_ids"), matched("paragraph_ids"))))
    return t.select(id_col, "line_ids", "paragraph_ids", "n_known", F.array_join("_l", ",").alias("licenses"), F.size("_l").cast("long").alias("n_licenses"))


def duckdb_sql() -> str:
    """The same over documents, in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    as_map = lambda pairs: "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in pairs) + "}"
    ids = lambda t: f"""list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace({t}, 'spdx-license-identifier:[ \\t]*([a-z0-9.-]+)', chr(10) || '\\1 spdx' || chr(10), 'g'), {q(END)}, chr(10), 'g'), {q(GAP)}, ' ', 'g'), ' ?\\n[ \\n]*'), lambda s: k.m[trim(s)]), lambda x: x IS NOT NULL)"""
    joined = lambda c: f"coalesce(list_aggregate(list_transform({c}, lambda x: '<' || x || '>'), 'string_agg', ''), '')"
    matched = lambda c: f"list_transform(regexp_extract_all({c}, {q(rule_pattern())}, 0), lambda x: r.m[x])"
    return f"""
WITH k AS (SELECT {as_map(sentence_ids().items())} AS m), r AS (SELECT {as_map(rules())} AS m),
t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
i AS (SELECT doc_id, {ids("t.t")} AS a, {ids(f"translate(regexp_replace(t.t, {q(BLANK_LINE)}, '. ', 'g'), chr(10), ' ')")} AS b FROM t, k),
s AS (SELECT doc_id, len(a)::BIGINT AS n_known, {joined("a")} AS line_ids, {joined("b")} AS paragraph_ids FROM i),
l AS (SELECT s.*, list_sort(list_distinct(list_concat({matched("line_ids")}, {matched("paragraph_ids")}))) AS l FROM s, r)
SELECT doc_id, line_ids, paragraph_ids, n_known, coalesce(list_aggregate(l, 'string_agg', ','), '') AS licenses, len(l)::BIGINT AS n_licenses FROM l"""
