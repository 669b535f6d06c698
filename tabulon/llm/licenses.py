"""License scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form (lower case, copyright lines out, equivalent spellings and punctuation levelled) and its
SHA-256 is hash-joined to the digests of known licence texts and notices. What is looked up is always an entire text: the
document's, and each of its lines and paragraphs as a text of its own, so that a notice within a document is found too.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import load, lookup

#: Known texts up to which their digests are broadcast; beyond, the join is left to the optimiser.
BROADCAST_ENTRIES = 20_000
#: Known notices up to which lines are looked up in a map that is part of the plan; beyond, by a join.
MAP_ENTRIES = 1_000

#: Spellings that licences treat as equivalent.
EQUIVALENT = [
    ("licence", "license"), ("licensor's", "licensors"), ("organisation", "organization"), ("authoris", "authoriz"), ("recognis", "recogniz"),
    ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("wilful", "willful"), ("non-commercial", "noncommercial"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("sub-license", "sublicense"), ("https://", "http://"), ("&", " and "),
]

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_WARRANTY}"""
_BSD3 = f"{_BSD_HEAD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_TAIL}"

#: Fixed values: (identifier, licence text).
TEXTS = [
    ("MIT", _MIT), ("MIT", f"MIT License\n\n{_MIT}"), ("MIT", f"The MIT License (MIT)\n\n{_MIT}"), ("MIT", f"The MIT License\n\n{_MIT}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_TAIL}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}{_BSD_TAIL}"), ("BSD-3-Clause", _BSD3), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD3}"),
]
#: Longer licences in full, a file each, named by identifier.
TEXTS += [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]

#: Fixed values: (identifier, names) under which licences are referred to.
NAMES = [
    ("MIT", ["MIT License", "MIT licence (MIT)", "Expat License"]), ("ISC", ["ISC License"]), ("0BSD", ["BSD Zero Clause License"]), ("Unlicense", ["Unlicense"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"]), ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License", "Modified BSD License"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", 'Apache License, Version 2.0 (the "License")']),
    ("MPL-2.0", ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"]), ("MPL-1.1", ["Mozilla Public License Version 1.1"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"]), ("GPL-3.0", ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"]),
    ("LGPL-2.1", ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"]), ("LGPL-3.0", ["GNU Lesser General Public License, version 3", "LGPLv3"]),
    ("AGPL-3.0", ["GNU Affero General Public License, version 3", "AGPLv3"]), ("GFDL-1.3", ["GNU Free Documentation License, Version 1.3"]),
    ("EPL-2.0", ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"]), ("BSL-1.0", ["Boost Software License, Version 1.0"]), ("Zlib", ["zlib License"]),
    ("CC0-1.0", ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"]),
    *((f"CC-{a}-{v}", [f"CC {a} {v}", f"CC-{a}-{v}", f"Creative Commons {n} {v} International License", f"Creative Commons {n} {v} License"]) for a, n in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike")) for v in ("3.0", "4.0")),
]
#: How a notice says that a work has a licence, in canonical form; both go before a notice is looked up.
GRANT = (
    r"^(?:(?:(?:this|the) (?:work|project|software|file|program|library|code|source code|package|document|text|page|content|material)|(?:the )?contents of this file) (?:is|are) )?"
    r"(?:(?:licensed|released|published|distributed|(?:made )?available) under (?:the terms of )?|covered by |subject to (?:the terms of )?)?(?:the )?"
)
REFERENCE = r" see (?:the )?(?:accompanying )?license (?:file |txt |md )?for (?:more |full )?(?:details|information)$"
#: Notices of several lines.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((f"GPL-{v}.0", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.") for v in (2, 3)),
    *((f"GPL-{v}.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.") for v in (2, 3)),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
]
#: What the rules above make of names: (identifier, notice).
NOTICES = [(i, name) for i, names in NAMES for name in names]
NOTICES += [(i, f"SPDX-License-Identifier: {i}{option}") for i, _ in NAMES for option in (("", "-only", "-or-later") if "GPL" in i or "GFDL" in i else ("",))]
NOTICES += HEADERS

_NOTICE_LINES = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
_PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The form in which texts are compared; '' for null."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NOTICE_LINES, "\n")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, _PUNCTUATION, " "))


def notice(text: Column) -> Column:
    """The canonical form of a line or paragraph, less what says that something has a licence."""
    return F.regexp_replace(F.regexp_replace(canonical(text), GRANT, ""), REFERENCE, "")


def known_digests(spark: SparkSession, known: list[tuple[str, str]], form: Callable[[Column], Column]) -> DataFrame:
    """(known_digest, license_id), one row a digest; texts of an empty form are left out."""
    t = form(F.col("t"))
    rows = spark.createDataFrame(known, "id string, t string").where(t != "")
    return rows.groupBy(F.sha2(t, 256).alias("known_digest")).agg(F.min("id").alias("license_id"))


def _paragraphs(text: Column) -> Column:
    """Lines, and runs of several lines without an empty one."""
    runs = F.filter(F.split(text, r"\n[ \t\r]*\n\s*"), lambda p: F.instr(F.trim(p), "\n") > 0)
    return F.concat(F.split(text, "\n"), runs)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None, map_entries: int = MAP_ENTRIES) -> DataFrame:
    """One row per row of ``docs``: id_col, text_digest, license_id (of the whole text, or null), notices, n_notices.

    notices: the distinct licences of lines and of paragraphs of several lines, sorted, comma-joined ('' for none); n_notices:
    how many match. ``known``: (identifier, text) pairs instead of the texts and notices above. Null counts as empty text,
    which matches nothing; repeated rows stay apart; a copyright line matches nothing by itself; an empty table gives no
    rows. Texts of any length are digested whole. Other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    of_texts = known_digests(spark, TEXTS if known is None else known, canonical)
    of_notices = known_digests(spark, NOTICES if known is None else known, notice)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("whole"))
    units = F.transform(_paragraphs(F.col("whole")), lambda t: F.sha2(notice(t), 256))
    if len(NOTICES if known is None else known) <= map_entries:
        table = {r.known_digest: r.license_id for r in of_notices.collect()}
        names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair)) if table else F.lit(None).cast("map<string,string>")
        rows = rows.select("id", F.sha2(canonical(F.col("whole")), 256).alias("text_digest"), F.filter(F.transform(units, lambda d: F.element_at(names, d)), lambda i: i.isNotNull()).alias("found"))
    else:
        rows = rows.withColumn("h", F.xxhash64("whole"))
        found = rows.dropDuplicates(["h"]).select("h", F.explode(units).alias("known_digest")).join(of_notices, "known_digest").groupBy("h").agg(F.collect_list("license_id").alias("found"))
        found = found.join(rows.groupBy("h").agg(F.count(F.lit(1)).alias("times")), "h")
        rows = rows.select("id", "h", F.sha2(canonical(F.col("whole")), 256).alias("text_digest"))
        rows = lookup(rows, found, ["h"], rows.count(), "times", F.col("id"))
    of_texts = F.broadcast(of_texts) if len(TEXTS if known is None else known) <= BROADCAST_ENTRIES else of_texts
    out = rows.join(of_texts, F.col("text_digest") == F.col("known_digest"), "left")
    some = F.coalesce("found", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "text_digest", "license_id", F.array_join(F.array_sort(F.array_distinct(some)), ",").alias("notices"), F.size(some).cast("long").alias("n_notices"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents are or state."""
    return license_scan(load(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    quoted = lambda s: s.replace("'", "''")
    out = f"regexp_replace(lower(coalesce({x}, '')), '{quoted(_NOTICE_LINES)}', chr(10), 'g')"
    for a, b in EQUIVALENT:
        out = f"replace({out}, '{quoted(a)}', '{quoted(b)}')"
    return f"trim(regexp_replace({out}, '{_PUNCTUATION}', ' ', 'g'))"


def oracle() -> str:
    quoted = lambda s: s.replace("'", "''")
    values = lambda known: ", ".join(f"('{i}', '{quoted(t)}')" for i, t in known)
    notice = f"regexp_replace(regexp_replace({_sql_canonical('t')}, '{GRANT}', ''), '{REFERENCE}', '')"
    return f"""
WITH texts AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(id) AS license_id FROM (VALUES {values(TEXTS)}) v(id, t) GROUP BY 1),
known AS (SELECT sha256({notice}) AS digest, min(id) AS license_id FROM (VALUES {values(NOTICES)}) v(id, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, sha256({_sql_canonical("t")}) AS text_digest FROM d),
p AS (SELECT r, unnest(string_split_regex(t, '\\n[ \\t\\r]*\\n\\s*')) AS t FROM d),
u AS (SELECT r, unnest(string_split(t, chr(10))) AS t FROM d UNION ALL SELECT r, t FROM p WHERE contains(trim(t, ' '), chr(10))),
h AS (SELECT u.r, known.license_id FROM u JOIN known ON sha256({notice}) = known.digest),
n AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices FROM h GROUP BY r)
SELECT w.doc_id, w.text_digest, texts.license_id, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM w LEFT JOIN texts ON w.text_digest = texts.digest LEFT JOIN n ON w.r = n.r
"""
