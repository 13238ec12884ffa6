"""License scans by canonical digest: whole texts, and whole lines, against the digests of known license texts.

A text is made canonical (case, punctuation, white space, copyright lines and equivalent spellings), hashed, and looked up
by a hash join. Everything is a column expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.tables import broadcast_if_small, whole_row

# Words that license matching treats as equal, after punctuation is gone.
EQUAL = [("licenc", "licens"), ("sub licens", "sublicens"), ("non commercial", "noncommercial"),
         ("copyright owner", "copyright holder"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
         ("per cent", "percent"), ("https", "http"), ("organisation", "organization"), ("wilful", "willful"),
         ("merchantibility", "merchantability")]

_COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright (?:\(c\)|©|[0-9<\[])|\(c\) |© ?|all rights reserved)[^\n]*$"
_NO_WORD = r"[^\p{L}\p{N}\n]+"

# The texts of short public licenses, and the usual one-line notices.
_PERMIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
           "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above "
           "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
           "Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
           "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
           "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
           "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
           "OTHER DEALINGS IN THE SOFTWARE.")
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
            "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
            "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
            "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
            "USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this "
             "list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above "
             "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
             "materials provided with the distribution.\n\n")
_BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission.\n\n")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
            "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
            "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ZLIB = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
         "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
         "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
         "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the "
         "original software. If you use this software in a product, an acknowledgment in the product documentation would be "
         "appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be "
         "misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source "
         "distribution.")
KNOWN = [
    ("MIT", "MIT License\n\n" + _PERMIT), ("MIT", _PERMIT),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all "
     "copies.\n\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END), ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_END), ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."), ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
]


def canonical_lines(text: Column) -> Column:
    """The canonical text with its line ends: A-Z lower-cased, copyright lines empty, `&` as `and`, runs of anything but
    letters and digits one space, equivalent spellings replaced."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.regexp_replace(F.replace(F.regexp_replace(lower, _COPYRIGHT_LINE, ""), F.lit("&"), F.lit(" and ")), _NO_WORD, " ")
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), EQUAL, plain)


def digest_of(lines: Column) -> Column:
    """SHA-256 of canonical lines as one line; null where no word is left."""
    return F.sha2(F.nullif(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")), F.lit("")), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license_id) of known texts; of two licenses with one canonical text the smaller name stands."""
    texts = spark.createDataFrame(known, "license_id string, body string")
    return texts.select(digest_of(canonical_lines(F.col("body"))).alias("digest"), "license_id").where(
        "digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """The rows of `df` with `text_digest`, `license_id`, `notice_lines` and `notice_ids`.

    license_id: the license whose canonical text is the row's whole text. notice_lines: (line, license_id) of each line
    that is a known text by itself, from line 0; notice_ids: their licenses in order, each once. Null and wordless texts
    have a null digest, no license and no notices. Rows repeat as they do in `df`; columns of the same names are replaced.

    `known` (digest, license_id) is joined on the digest, broadcast while its size allows; its digests of single lines
    also serve as a lookup inside the row, so documents are never exploded or shuffled and a text that a third of all rows
    share costs no more than others. An empty table gives no rows.
    """
    # One entry per known license: the table is a parameter, bounded by the list of licenses, not by the documents.
    lookup = known.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license_id"))).alias("lookup"))
    rows = whole_row(df, canonical_lines(F.col(text).cast("string")).alias("lines")).crossJoin(F.broadcast(lookup))
    found = F.filter(F.transform(F.split("lines", "\n"), lambda line, i: F.struct(
        i.alias("line"), F.col("lookup")[digest_of(line)].alias("license_id"))), lambda x: x.license_id.isNotNull())
    looked = rows.select("row", digest_of(F.col("lines")).alias("digest"),
                         F.coalesce(found, F.array().cast("array<struct<line:int,license_id:string>>")).alias("notices"))
    own = ["text_digest", "license_id", "notice_lines", "notice_ids"]
    return looked.join(broadcast_if_small(known), "digest", "left").select(
        *(F.col("row")[c].alias(c) for c in df.columns if c not in own), F.col("digest").alias("text_digest"), "license_id",
        F.col("notices").alias("notice_lines"), F.array_sort(F.array_distinct("notices.license_id")).alias("notice_ids"))


def document_licenses(documents: DataFrame) -> DataFrame:
    """Digest, license and notices of every document."""
    found = scan(documents.select("doc_id", "text"), "text", known_digests(documents.sparkSession))
    return found.select("doc_id", "text_digest", "license_id", F.size("notice_lines").alias("n_notice_lines"),
                        F.array_join("notice_ids", ",").alias("notice_ids"))


def _sql_lines(column: str) -> str:
    """The canonical form in SQL, for the comparison."""
    out = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"replace(regexp_replace({out}, '{_COPYRIGHT_LINE}', '', 'g'), '&', ' and ')"
    out = f"regexp_replace({out}, '{_NO_WORD}', ' ', 'g')"
    for a, b in EQUAL:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _sql_digest(column: str) -> str:
    return f"sha256(nullif(trim(regexp_replace({column}, '[ \\n]+', ' ', 'g')), ''))"


DOCUMENT_LICENSES_SQL = """
WITH k AS (SELECT min(license_id) AS license_id, %s AS digest
           FROM (SELECT license_id, %s AS lines FROM (VALUES %s) v(license_id, body)) GROUP BY 2),
d AS (SELECT doc_id, row_number() OVER () AS n, %s AS lines FROM documents),
l AS (SELECT n, unnest(string_split(lines, chr(10))) AS line FROM d),
f AS (SELECT n, count(*) AS c, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
      FROM (SELECT n, %s AS digest FROM l) JOIN k USING (digest) GROUP BY n),
t AS (SELECT doc_id, n, %s AS text_digest FROM d)
SELECT doc_id, text_digest, k.license_id, coalesce(c, 0)::INT AS n_notice_lines, coalesce(ids, '') AS notice_ids
FROM t LEFT JOIN k ON k.digest = text_digest LEFT JOIN f USING (n)
""" % (_sql_digest("lines"), _sql_lines("body"), ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN),
       _sql_lines("text"), _sql_digest("line"), _sql_digest("lines"))
