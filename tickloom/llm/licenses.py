"""Licence scan: whole texts are brought to a canonical form and looked up by digest.

The canonical form lower-cases A-Z, drops copyright lines and "all rights reserved" lines, turns punctuation and white space
into single blanks, and replaces words by their equivalent spelling. Known texts go through the same form. All of it is columns
and one join with the small table of known digests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import small_side

# Lines of the original that carry no terms, and what is taken as a blank
# (lines such as "copyright notice ..." and "copyright holder ..." are terms)
_MARKS = r"[ \t*#/;-]*"
_TERMS = (
    r"(?:notices?|holders?|owners?|licen[sc]es?|licensors?|laws?|acts?|statements?|interests?|rights?|protection|ownership|"
    r"treat(?:y|ies)|infringements?|material|terms?|conditions?|disclaimers?|claims?|and|or|in|of|is|to|that|which)(?![\p{L}\p{N}])"
)
_HEAD = rf"(^|\n){_MARKS}(portions )?(copyright(?![\p{{L}}\p{{N}}])(?![ \t\r\n*#/;-]*{_TERMS})(?!, ?(?:patent|trademark))|\x{{a9}}|\(c\)"
COPYRIGHT_LINE = _HEAD + r")[^\n]*"
# In a text with an item (b), (c) can be an item too.
ITEMS = rf"(^|\n){_MARKS}\(b\)"
COPYRIGHT_OR_ITEM = _HEAD + r"[ \t]*[0-9<\[{y])[^\n]*"
# The form that the SQL has
SQL_COPYRIGHT_LINE = (
    r"(^|\n)[ \t*#/;-]*(portions )?(copyright[ \t]*(\(c\)|©|:)?[ \t]*[0-9<\[y]|\(c\)[ \t]*[0-9<\[y]|©)[^\n]*"
)
RIGHTS_LINE = r"(^|\n)[ \t*#/;-]*all rights reserved[.]?[ \t\r]*(\n|\z)"
BLANK = r"[^\p{L}\p{N}]+"

# Equivalent spellings in licences, the first is replaced by the second
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "copyright owner": "copyright holder", "copyright owners": "copyright holders", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "per cent": "percent",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sub license": "sublicense", "sublicence": "sublicense", "utilisation": "utilization",
    "while": "whilst", "wilful": "willful",
}

# Texts of public licences, by SPDX identifier
_NO_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
LICENSES = {
    "MIT": """MIT License
Copyright (c) <year> <copyright holders>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License
Copyright (c) <year> <owner>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": "Copyright (c) <year> <owner>\n" + _BSD + _NO_WARRANTY_BSD,
    "BSD-3-Clause": "Copyright (c) <year> <owner>\n" + _BSD + """3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _NO_WARRANTY_BSD,
    "Zlib": """Copyright (c) <year> <copyright holders>
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
}
# Notices that the SQL does not have
NOTICES = {
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}


def canonical(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = F.when(lower.rlike(ITEMS), F.regexp_replace(lower, COPYRIGHT_OR_ITEM, "\n")).otherwise(F.regexp_replace(lower, COPYRIGHT_LINE, "\n"))
    terms = F.regexp_replace(kept, RIGHTS_LINE, "\n")
    # Each word gets blanks of its own, so that neighbours can both be replaced.
    padded = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(terms, BLANK, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    spelled = reduce(lambda c, pair: F.replace(c, F.lit(_wide(pair[0])), F.lit(_wide(pair[1]))), SPELLINGS.items(), padded)
    return F.trim(F.replace(spelled, F.lit("  "), F.lit(" ")))


def _wide(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def known(spark, licenses: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(list(licenses.items()), "id string, known string")
    return rows.select(F.sha2(canonical(F.col("known")), 256).alias("digest"), "id").groupBy("digest").agg(F.min("id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, digest, license_id`` of every row; ``licenses`` has ``digest, license_id``, one row per digest.

    The digest is SHA-256 of the canonical form in lower-case hex, ``n_words`` counts its words. A null text has neither; an
    empty one has the digest of nothing and no words. ``license_id`` is null where no licence has the digest. Repeated rows are
    looked up one by one; an empty table gives an empty one; other columns are not read. The table of digests is broadcast only
    if it is small.
    """
    form = canonical(F.col(text).cast("string"))
    rows = docs.select(F.col(key).alias(key), form.alias("_form"))
    rows = rows.select(
        key, F.when(F.col("_form") == "", 0).otherwise(F.length("_form") - F.length(F.replace("_form", F.lit(" "))) + 1).cast("long").alias("n_words"),
        F.sha2("_form", 256).alias("digest"),
    )
    side, _ = small_side(licenses.select("digest", "license_id"))
    return rows.join(side, "digest", "left").select(key, "n_words", "digest", "license_id")


def sql(licenses: dict[str, str]) -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        for pattern in (SQL_COPYRIGHT_LINE, RIGHTS_LINE):
            out = f"regexp_replace({out}, {quoted(pattern)}, chr(10), 'g')"
        out = f"' ' || replace(trim(regexp_replace({out}, {quoted(BLANK)}, ' ', 'g')), ' ', '  ') || ' '"
        for pair in SPELLINGS.items():
            out = f"replace({out}, {quoted(_wide(pair[0]))}, {quoted(_wide(pair[1]))})"
        return f"trim(replace({out}, '  ', ' '))"

    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licenses.items())
    return f"""
with known as (
  select sha256({form("known")}) digest, min(id) license_id from (values {values}) t(id, known) group by 1
), forms as (
  select doc_id, {form("text")} form from documents
)
select doc_id, case when form = '' then 0 else len(form) - len(replace(form, ' ', '')) + 1 end::bigint n_words,
  sha256(form) digest, license_id
from forms left join known on sha256(form) = known.digest
"""
