"""Licence scan by canonical digests.

Texts are brought to a canonical form (lower case, without copyright lines and punctuation, one
spelling of words that have several) and hash-joined, entire, to the digests of known licences.
Each line of a text is looked up the same way, which finds one-line notices. The known texts are
a fixed table, so their side of the join is always small. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common

# Fixed values: (spelling, the one used here).
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("https", "http"),
    ("isation", "ization"),
    ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authoris", "authoriz"),
    ("behaviour", "behavior"),
    ("catalogue", "catalog"),
    ("categoris", "categoriz"),
    ("centre", "center"),
    ("favour", "favor"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("offence", "offense"),
    ("optimis", "optimiz"),
    ("organis", "organiz"),
    ("programme", "program"),
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
]

# Public licence texts and the usual one-line notices, by SPDX identifier.
_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted"""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so"""
_MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software."""
KNOWN = [
    ("MIT", f"MIT License\n{_MIT_GRANT}, subject to the following conditions:\n{_MIT_NOTICE}\n{_DISCLAIMER}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\n{_MIT_NOTICE}\n{_DISCLAIMER}"),
    ("MIT-0", f"MIT No Attribution\n{_MIT_GRANT}.\n{_DISCLAIMER}"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n{_BSD_DISCLAIMER}"),
    (
        "BSD-3-Clause",
        f"""{_BSD_GRANT}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
{_BSD_DISCLAIMER}""",
    ),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_DISCLAIMER}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_DISCLAIMER}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
]

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright *(?:\(c\)|©|<|\[|[0-9])|c\) *[0-9]|© *[0-9]|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"
OTHER = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Canonical text that still has its lines."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, OTHER, " ")
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return out


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def known_licences(spark, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(licence, digest) of the known texts; equal canonical texts count for the first."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(known)], "at int, licence string, text string")
    rows = rows.withColumn("digest", F.sha2(whole(canonical_lines(F.col("text"))), 256))
    return rows.groupBy("digest").agg(F.min_by("licence", "at").alias("licence"))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, text_digest, licence, notices, n_notices.

    ``licence`` is that of the entire text (null if unknown); ``notices`` names, in order and
    joined by commas, the licences of lines that are a known text, ``n_notices`` counts these
    lines, repeated ones too. A null text is empty. Case, punctuation, copyright lines and the
    spellings of SPELLINGS make no difference.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    source = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.col("text")).alias("lines"))
    table = common.written(known_licences(docs.sparkSession, known), "licences")
    longest = docs.sparkSession.createDataFrame(known, "licence string, text string").agg(F.max(F.length(whole(canonical_lines(F.col("text")))))).first()[0]
    trimmed = F.transform(F.split("lines", "\n", -1), lambda x: F.trim(x))
    # Longer lines than the longest known text are none; the rest are looked up by digest.
    short = F.filter(trimmed, lambda x: (F.length(x) > 0) & (F.length(x) <= longest))
    slim = source.select("row", "doc_id", F.sha2(whole(F.col("lines")), 256).alias("text_digest"), F.transform(short, lambda x: F.unhex(F.sha2(x, 256))).alias("line_digests"))
    slim = common.written(slim, "licence-digests")
    lookup = F.broadcast(table)
    found = slim.select("row", F.explode("line_digests").alias("line")).join(lookup.select(F.unhex("digest").alias("line"), F.col("licence").alias("notice")), "line")
    notices = found.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"), F.count("*").alias("n_notices"))
    out = slim.drop("line_digests").join(lookup.select(F.col("digest").alias("text_digest"), "licence"), "text_digest", "left")
    out = out.join(common.beside(notices, "licence-notices"), "row", "left")
    return out.select("row", "doc_id", "text_digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql(known: list[tuple[str, str]] = KNOWN) -> str:
    """The scan of ``documents`` in DuckDB's SQL."""
    canonical = f"regexp_replace(regexp_replace(lower(coalesce(text, '')), {_quoted(COPYRIGHT_LINE)}, '', 'g'), {_quoted(OTHER)}, ' ', 'g')"
    for other, one in SPELLINGS:
        canonical = f"replace({canonical}, {_quoted(other)}, {_quoted(one)})"
    values = ", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(known))
    one_line = "trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))"
    return f"""
WITH k AS (SELECT place, licence, {canonical} AS lines FROM (VALUES {values}) v(place, licence, text)),
known AS (SELECT sha256({one_line}) AS digest, arg_min(licence, place) AS licence FROM k GROUP BY 1),
d AS (SELECT doc_id, {canonical} AS lines FROM documents),
l AS (SELECT doc_id, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM d),
n AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notices
  FROM l JOIN known USING (digest) GROUP BY doc_id),
w AS (SELECT doc_id, sha256({one_line}) AS text_digest FROM d)
SELECT w.doc_id, text_digest, licence, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM w LEFT JOIN known ON known.digest = text_digest LEFT JOIN n ON n.doc_id = w.doc_id
"""
