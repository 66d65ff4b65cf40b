"""Licence scans: canonical digests of whole texts, joined with known licence digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same.
SPELLINGS = [
    ("licenc", "licens"), ("sub licens", "sublicens"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"),
    ("authoris", "authoriz"), ("behaviour", "behavior"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("https", "http"), ("judgement", "judgment"),
    ("labour", "labor"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("organis", "organiz"), ("per cent", "percent"),
    ("practise", "practice"), ("programme", "program"), ("recognis", "recogniz"), ("while", "whilst"), ("copyright owner", "copyright holder"),
]
#: A whole line that states a copyright: the word with a sign, a year or "by" after it, a sign with a year, or the
#: reservation alone. A line of a licence's prose that begins with "copyright" isn't one, however it is wrapped.
COPYRIGHT_LINE = (
    r"^[ \t#*/;!%-]*((copyright|copr)[ \t.:]*(\(c\)|©|[0-9]{4}|by )[^\n]*|(\(c\)|©)[ \t]*(copyright[ \t]*)?[0-9]{4}[^\n]*|all rights reserved[ \t\r.!*/#;-]*)$"
)
MOST_BROADCAST = 32 << 20
NOT_WORD = r"[^\p{L}\p{N}\n]+"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
    "in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public licence texts and one-line notices.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. " + _WARRANTY,
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _WARRANTY),
    (
        "MIT-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TWO + _BSD_WARRANTY),
    (
        "BSD-3-Clause",
        _BSD_HEAD + _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission. " + _BSD_WARRANTY,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We "
        "intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining "
        'a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
        "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
        "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
        'processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING "
        "THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]


def _plain_lines(text: Column) -> Column:
    """Lower case without copyright lines, with one spelling and single spaces for punctuation; lines stay apart."""
    # (?d): only \n ends a line, as in SQL.
    out = F.regexp_replace(F.regexp_replace(F.lower(text), f"(?md){COPYRIGHT_LINE}", ""), NOT_WORD, " ")
    for other, own in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(own))
    return out


def _joined(lines: Column) -> Column:
    """Plain lines as one; spellings of two words may have been parted by a line's end."""
    out = F.regexp_replace(lines, "[ \n]+", " ")
    for other, own in SPELLINGS:
        if " " in other:
            out = F.replace(out, F.lit(other), F.lit(own))
    return F.trim(out)


def canonical(text: Column) -> Column:
    """Lower case without copyright lines, with one spelling and single spaces for punctuation and line ends."""
    return _joined(_plain_lines(text))


def known_licences(spark: SparkSession, files: str | None = None) -> DataFrame:
    """Known texts (licence, licence_text): those of this module and, if a folder of text files is given, each file's whole text under its name."""
    own = spark.createDataFrame(KNOWN, "licence string, licence_text string")
    if files is None:
        return own
    read = spark.read.text(files, wholetext=True)
    return own.unionByName(read.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("licence"), F.col("value").alias("licence_text")))


def licences(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Which known licence a document is, and which ones single lines of it are.

    known: licence and licence_text. Returns for each distinct (doc_id, text): doc_id, canonical_sha256 (of
    the whole text's canonical form), text_licence (null if the whole text is none; the last in order
    if several known ones have that form), notice_lines (how many of its lines are a known text, counted once for each
    licence with that text) and notice_licences (their distinct names in order, joined by commas; null if none).

    Each text is made canonical once. Digests are looked up before anything is shuffled: known digests up to
    MOST_BROADCAST bytes are broadcast (more are joined by a shuffle of digests), and what leaves a task is
    one row a document and one for each line that is known.

    Rows equal in doc_id and text give one row; a doc_id with several texts, or null, has a row for each.
    A null text is empty; an empty canonical form matches nothing. Columns other than doc_id and text
    aren't read. Empty tables give empty results (no known texts: no matches).
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), _plain_lines(F.col("text")).alias("plain"))
    unit = lambda place, text: F.struct(place.alias("place"), text.alias("unit"))
    lines = F.transform(F.split("plain", "\n"), lambda x, i: unit(i, F.trim(x)))
    units = plain.select("doc_id", "k1", "k2", F.explode(F.concat(F.array(unit(F.lit(-1), _joined(F.col("plain")))), lines)).alias("u"))
    units = units.select("doc_id", "k1", "k2", "u.place", F.sha2("u.unit", 256).alias("digest"))
    of = known.select("licence", canonical(F.col("licence_text")).alias("c")).where("c <> ''").select(F.sha2("c", 256).alias("digest"), "licence").distinct()
    size = of.agg(F.sum(F.length("licence") + 64)).first()[0] or 0
    found = units.join(F.broadcast(of) if size <= MOST_BROADCAST else of, "digest", "left").where("place = -1 or licence is not null")
    whole, line = F.col("place") == -1, F.when(F.col("place") >= 0, F.struct("place", "licence"))
    per = found.groupBy("doc_id", "k1", "k2").agg(
        F.max(F.when(whole, F.col("digest"))).alias("canonical_sha256"),
        F.max(F.when(whole, F.col("licence"))).alias("text_licence"),
        F.collect_set(line).alias("lines"),
    )
    names = F.array_join(F.array_sort(F.array_distinct(F.col("lines.licence"))), ",")
    return per.select("doc_id", "canonical_sha256", "text_licence", F.size("lines").cast("long").alias("notice_lines"), F.nullif(names, F.lit("")).alias("notice_licences"))


def oracle() -> str:
    """The same in SQL; each line is made canonical by itself."""

    def form(text: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({text}), '(?m){COPYRIGHT_LINE}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
        for other, own in SPELLINGS:
            out = f"replace({out}, '{other}', '{own}')"
        return f"trim({out})"

    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH k AS (SELECT DISTINCT licence, sha256({form("licence_text")}) AS digest FROM (VALUES {values}) v(licence, licence_text)),
d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, text, true AS whole, text AS unit FROM d UNION ALL SELECT doc_id, text, false, unnest(string_split(text, chr(10))) FROM d),
h AS (SELECT doc_id, text, whole, sha256({form("unit")}) AS digest FROM u)
SELECT doc_id, max(CASE WHEN whole THEN h.digest END) AS canonical_sha256, max(CASE WHEN whole THEN licence END) AS text_licence,
  count(CASE WHEN NOT whole THEN licence END) AS notice_lines, string_agg(DISTINCT CASE WHEN NOT whole THEN licence END, ',' ORDER BY CASE WHEN NOT whole THEN licence END) AS notice_licences
FROM h LEFT JOIN k ON h.digest = k.digest GROUP BY doc_id, text"""
