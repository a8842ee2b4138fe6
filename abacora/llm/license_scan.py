"""License scans by canonical digest: whole texts against known licence texts.

A text is brought to a canonical form: lower case; copyright notices dropped; equivalent spellings
made one; every run of other than letters and digits one blank. Its SHA-256 is joined with the
digests of the known texts, canonicalised by the same expression. The result has a row per
document: its digest, the number of canonical characters, and the licence or null.

DataFrame functions only; the known texts are a short constant list, so their digests are broadcast.

Edge cases: null counts as the empty text; an empty canonical text matches nothing; repeated rows
each give a row; ids may be null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_digests import DIGESTS

#: Known texts (whole short licences and notices), by SPDX identifier.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
_BSD3 = KNOWN[4][1].replace(" THIS SOFTWARE IS", " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS", 1)
_BARE = lambda body: body.replace(": 1. ", ": ").replace(" 2. ", " ").replace(" 3. ", " ")
#: The standard titles of the short licences.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"),
}
#: Whole short licences, with and without numbers before their clauses.
BODIES = (*KNOWN[:5], ("BSD-2-Clause", _BARE(KNOWN[4][1])), ("BSD-3-Clause", _BSD3), ("BSD-3-Clause", _BARE(_BSD3)))
#: What scan() knows by text: KNOWN, the other bodies, and all bodies under their titles.
TEXTS = (*KNOWN, *BODIES[5:], *((i, f"{title}\n{body}") for i, body in BODIES for title in TITLES[i]))
#: Equivalent spellings, (pattern, what stands for it), in this order.
SPELLINGS = (("licen[cs]e", "license"), ("sub[ -]license", "sublicense"), ("acknowledgement", "acknowledgment"), ("non-?infringement", "noninfringement"), ("per cent", "percent"), ("owners?'?s? of the copyright|copyright owner", "copyright holder"), ("merchantibility", "merchantability"))
#: Copyright notices at the start of a line, possibly after comment signs: a mark or a year has to follow. They end with the line, or before a licence or a longer sentence on the same line.
_OPENING = "|".join(x.replace(" ", r"\s+") for x in ("permission is", "permission to use", "redistribution and use", "this software is", "licensed under", "released under", "this work is", "everyone is permitted"))
NOTICE = rf"(?im)^[^\p{{L}}\p{{N}}\n©]*(?:©|copyright\s*(?:\(c\)|©|&copy;)|(?:copyright\b|\(c\))[^\n]{{0,80}}?\b(?:19|20)[0-9]{{2}}\b)(?:[^\n]*?(?={_OPENING})|[^\n]*?\.(?= \p{{Lu}}[^\n]{{80}})|[^\n]*$)|^[^\p{{L}}\p{{N}}\n]*all rights reserved\b"
#: The SQL's rule, which takes whole lines.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    out = F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), NOTICE, " "))
    for pattern, one in SPELLINGS:
        out = F.regexp_replace(out, pattern, one)
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, canonical_chars, canonical_sha256."""
    spark = docs.sparkSession
    table = spark.createDataFrame(list(known), "license_id string, body string").select("license_id", F.sha2(canonical(F.col("body")), 256).alias("known_sha256"))
    if known is TEXTS:
        table = table.unionByName(spark.createDataFrame(list(DIGESTS), "license_id string, known_sha256 string"))
    table = table.groupBy("known_sha256").agg(F.min("license_id").alias("license_id"))
    seen = docs.select(docs[id_col].cast("long").alias("doc_id"), canonical(docs[text_col]).alias("c")).select("doc_id", F.length("c").cast("long").alias("canonical_chars"), F.sha2("c", 256).alias("canonical_sha256"))
    return seen.join(F.broadcast(table), (F.col("canonical_sha256") == F.col("known_sha256")) & (F.col("canonical_chars") > 0), "left").select("doc_id", "license_id", "canonical_chars", "canonical_sha256")


def _sql(x: str) -> str:
    for pattern, one in SPELLINGS:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{one}', 'g')"
    return f"trim(regexp_replace({x}, '{NOT_WORD}', ' ', 'g'))"


_BODY = lambda c: _sql(f"regexp_replace(lower(coalesce({c}, '')), '{COPYRIGHT_LINE}', ' ', 'g')")
ORACLE = f"""
WITH known(license_id, body) AS (VALUES {", ".join("('%s', '%s')" % (i, b.replace("'", "''")) for i, b in KNOWN)}),
k AS (SELECT sha256({_BODY("body")}) AS h, min(license_id) AS license_id FROM known GROUP BY 1),
d AS (SELECT doc_id, {_BODY("text")} AS c FROM documents)
SELECT d.doc_id, k.license_id, CAST(length(d.c) AS BIGINT) AS canonical_chars, sha256(d.c) AS canonical_sha256
FROM d LEFT JOIN k ON sha256(d.c) = k.h AND length(d.c) > 0
"""
