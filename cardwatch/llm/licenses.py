"""Licence scans: canonical digests of whole texts, and of single lines, looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.llm.shared import numbered

#: Licence table rows that are broadcast at most; a larger table is joined by a shuffle.
BROADCAST_ROWS = 50_000

#: Spellings that licence guidelines treat as the same; fixed values.
EQUIVALENT = {
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "sub license": "sublicense",
    "non commercial": "noncommercial",
    "per cent": "percent",
    "copyright owner": "copyright holder",
    "organisation": "organization",
    "favour": "favor",
    "judgement": "judgment",
    "merchantibility": "merchantability",
    "whilst": "while",
    "https": "http",
    "v 3": "version 3",
    "v 2": "version 2",
}

_GRANT = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO"
    " THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO"
    " EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL"
    " DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER"
    " IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
    " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_ITEMS = (
    "Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials"
    " provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to"
    " endorse or promote products derived from this software without specific prior written"
    " permission.",
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY"
    " EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF"
    " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL"
    " THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT"
    " OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR"
    " TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _bsd(clauses: int) -> tuple[str, str]:
    """The text with numbered items, and with bullets, which are no words."""
    first = (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:"
    )
    items = _BSD_ITEMS[:clauses]
    numbers = [f"{k}. {item}" for k, item in enumerate(items, 1)]
    return (
        " ".join((first, *numbers, _BSD_DISCLAIMER)),
        " ".join((first, *items, _BSD_DISCLAIMER)),
    )


#: Title lines, in canonical form, that a licence file may have above its text; fixed values.
TITLES = (
    "mit license",
    "the mit license",
    "mit license mit",
    "the mit license mit",
    "isc license",
    "the isc license",
    "bsd zero clause license",
    "zero clause bsd",
    "bsd 2 clause license",
    "the 2 clause bsd license",
    "bsd 3 clause license",
    "the 3 clause bsd license",
    "zlib license",
    "the zlib license",
)

#: Public licence texts and notices; fixed values.
KNOWN = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the"
        " Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,"
        " and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions: The above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the Software. THE SOFTWARE IS"
        " PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT"
        " NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
        " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE"
        " FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR"
        " OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with"
        " or without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies. " + _GRANT,
        "SPDX-License-Identifier: ISC",
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with"
        " or without fee is hereby granted. " + _GRANT,
        "SPDX-License-Identifier: 0BSD",
    ),
    "BSD-2-Clause": (
        *_bsd(2),
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        *_bsd(3),
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no"
        " event will the authors be held liable for any damages arising from the use of this"
        " software. Permission is granted to anyone to use this software for any purpose,"
        " including commercial applications, and to alter it and redistribute it freely,"
        " subject to the following restrictions: 1. The origin of this software must not be"
        " misrepresented; you must not claim that you wrote the original software. If you use"
        " this software in a product, an acknowledgment in the product documentation would be"
        " appreciated but is not required. 2. Altered source versions must be plainly marked as"
        " such, and must not be misrepresented as being the original software. 3. This notice"
        " may not be removed or altered from any source distribution.",
        "SPDX-License-Identifier: Zlib",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
        " If a copy of the MPL was not distributed with this file, You can obtain one at"
        " https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
        " file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed"
        " to in writing, software distributed under the License is distributed on an \"AS IS\""
        " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See"
        " the License for the specific language governing permissions and limitations under the"
        " License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
}


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text): the built-in table."""
    rows = [(name, text) for name, texts in KNOWN.items() for text in texts]
    return spark.createDataFrame(rows, "license_id string, text string")


def canonical_line(line: Column) -> Column:
    """Lower case, words only, equivalent spellings as one; empty for a copyright line."""
    low = F.lower(line)
    # A copyright mark needs no year; the bare word does, as licence texts begin lines with it.
    marked = low.rlike("^[^\\p{L}\\p{N}©]*(copyright[\\s:,]*(\\(c\\)|©)|©)")
    notice = low.rlike("^[^\\p{L}\\p{N}©]*(copyright|\\(c\\)|©)[\\s:,©(]*(c\\)|©)?\\s*[0-9]")
    rights = low.rlike("^[^\\p{L}\\p{N}]*all rights reserved[^\\p{L}\\p{N}]*$")
    plain = F.concat(F.lit(" "), F.regexp_replace(low, "[^\\p{L}\\p{N}]+", " "), F.lit(" "))
    for other, one in EQUIVALENT.items():
        plain = F.replace(plain, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.when(marked | notice | rights, "").otherwise(F.trim(plain))


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text that have any word left. Null: none."""
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")
    return F.filter(F.transform(lines, canonical_line), lambda x: x != "")


def digest(lines: Column) -> Column:
    """Digest of a whole text; title lines above a licence make no other licence of it."""
    words = F.filter(lines, lambda x: ~x.isin(*TITLES))
    return F.sha2(F.array_join(words, " "), 256)


def scan_licenses(
    docs: DataFrame,
    licenses: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id_col, digest (of the canonical text), license_id (of the
    licence that the whole text is, or null), notices (sorted ids of licences whose text
    or notice a single line is).

    Canonical: lower case, punctuation and white space as one space, copyright lines and
    "all rights reserved" lines left out, equivalent spellings made the same. A copyright
    line has a mark, as in `(c)`, or a year. Lines that are nothing but a licence's title
    (TITLES) are left out of the whole text, not of the single lines. A notice that is wrapped
    over several lines is found only where it is the whole text. licenses:
    (license_id, text); the built-in table if none. Of licences with the same canonical
    text the smallest id counts. A text without words matches nothing.

    DataFrame functions only. A document's lines leave as digests, are looked up by a hash
    join, and come together again in partial sums. Null text: as empty. Rows that repeat
    an id are documents of their own. Very long texts are scanned whole. Empty tables: no
    rows, or no matches. Other columns aren't read.
    """
    spark = docs.sparkSession
    licenses = known_licenses(spark) if licenses is None else licenses
    known = (
        licenses.select("license_id", canonical_lines(F.col("text")).alias("lines"))
        .filter("size(lines) > 0")
        .groupBy(digest(F.col("lines")).alias("sha"))
        .agg(F.min("license_id").alias("license"))
    )
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows, key = numbered(docs.select(id_col, text_col), id_col, text_col)
    rows = rows.select(key, id_col, canonical_lines(F.col(text_col)).alias("lines"))
    whole = F.array(F.struct(digest(F.col("lines")).alias("sha"), F.lit(True).alias("whole")))
    single = F.transform(
        "lines", lambda x: F.struct(F.sha2(x, 256).alias("sha"), F.lit(False).alias("whole"))
    )
    looked = (
        rows.select(key, id_col, F.explode(F.concat(whole, single)).alias("d"))
        .select(key, id_col, "d.*")
        .join(known, "sha", "left")
    )
    return (
        looked.groupBy(key, id_col)
        .agg(
            F.max(F.when(F.col("whole"), F.col("sha"))).alias("digest"),
            F.min(F.when(F.col("whole"), F.col("license"))).alias("license_id"),
            F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("notices"),
        )
        .drop(key)
    )
