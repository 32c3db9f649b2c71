"""Licence scans by canonical digest: normalise, digest, hash-join with known digests.

A unit of text is put in canonical form: lower case, copyright lines left
out, equivalent spellings made one, everything but letters and digits a
single space.  Its SHA-256 is looked up among the digests of known licence
texts and notices.  Units are whole texts, also without a licence's title in
front, each of their lines, and up to three paragraphs in a row, so a file that
is a licence, a licence inside a document and a notice line are all found, and
only entire texts match.  ``n_notices`` counts lines.  Built-in functions only;
the SQL follows the same rules.

Defined results: a NULL or empty text has the digest of the empty form and no
licence; rows that repeat both ``doc_id`` and text (NULL: empty) give one row,
rows of one ``doc_id`` with different texts one row each; an empty table gives
no rows; very long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Equivalent spellings (pattern, replacement), applied in order to lower-case text.
SPELLINGS = (
    (r"[ \t\r\f]+", " "), ("licence", "license"), ("sub-license", "sublicense"), ("copyright owner", "copyright holder"), ("organisation", "organization"),
    ("favour", "favor"), ("fulfil\\b", "fulfill"), ("per cent", "percent"), ("whilst", "while"), ("&", " and "), ("\\bhttps:", "http:"),
    ("non-commercial", "noncommercial"), ("\\bv(ersion|er\\.?|\\.)? ?([0-9])", "version $2"), ("(version [0-9]+)\\.0\\b", "$1"),
)
# How a line begins that only states a copyright, and how wrapped prose goes on instead ("copyright notice", "(c)" counting a list).
STATEMENTS = (
    (r"^\W*copyright\b", r"^\W*copyright\b\W*(notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|and|or|in|to|is|are|may|shall)\b"),
    (r"^\W*\(c\)", r"^\W*\(c\)\W*(you|your|the|an?|any|all|each|if|in|to|for|use|this|that|must|no|not|it|as|or|and|when|where|with)\b"),
    (r"^\W*(©|all rights reserved\W*$)", None),
)
# Published notices and licence texts, by SPDX identifier.
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
          "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
          "OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software. " + _AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", _ISC[0].format(", provided that the above copyright notice and this permission notice appear in all copies") + " " + _ISC[1]),
    ("0BSD", _ISC[0].format("") + " " + _ISC[1]),
)
# Canonical titles that stand in front of licence texts.
TITLES = ("license", "mit", "mit license", "the mit license", "mit license mit", "the mit license mit", "isc", "isc license", "the isc license", "isc license isc",
          "the isc license isc", "0bsd", "0bsd license", "bsd zero clause license", "bsd zero clause license 0bsd", "zero clause bsd", "zero clause bsd license", "zero clause bsd license 0bsd")
#: A known text has at most so many paragraphs.
PARAGRAPHS = 3


def canonical_line(line: Column) -> Column:
    """The canonical form of one line; empty for a copyright line."""
    x = F.lower(line)
    kept = x
    for pattern, instead in SPELLINGS:
        kept = F.regexp_replace(kept, pattern, instead)
    kept = F.trim(F.regexp_replace(kept, r"[^\p{L}\p{N}]+", " "))
    states = F.lit(False)
    for begins, prose in STATEMENTS:
        one = F.rlike(x, F.lit(begins))
        states = states | (one & ~F.rlike(x, F.lit(prose)) if prose else one)
    return F.when(states, F.lit("")).otherwise(kept)


def _digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def every_line(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), canonical_line)


def canonical_lines(text: Column) -> Column:
    """The non-empty canonical lines of a text; joined by spaces they are its canonical form."""
    return F.filter(every_line(text), lambda x: x != "")


def paragraphs(every: Column) -> Column:
    """The canonical forms of the paragraphs; lines with an empty form part them."""
    parts = F.filter(F.split(F.array_join(every, "\n"), "\n\n+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.trim(F.translate(x, "\n", " ")))


def runs(parts: Column) -> Column:
    """The canonical forms of one to ``PARAGRAPHS`` paragraphs in a row."""
    out = [parts]
    for i in range(2, PARAGRAPHS + 1):
        out.append(F.zip_with(out[-1], F.slice(parts, i, F.size(parts)), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(*out)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """``digest, licence, size`` (of the canonical form) of the known texts: a fixed table."""
    texts = spark.createDataFrame([(name, text) for name, text in known], "licence string, text string")
    texts = texts.select(F.concat_ws(" ", canonical_lines(F.col("text"))).alias("form"), "licence")
    return texts.groupBy(_digest(F.col("form")).alias("digest")).agg(F.min("licence").alias("licence"), F.max(F.length("form")).alias("size"))


def scan(df: DataFrame, known=KNOWN) -> DataFrame:
    """``doc_id, text_digest, text_licence, n_notices, licences`` of every document."""
    # The known table is fixed: some thirty rows.
    table = known_digests(df.sparkSession, known)
    sizes = sorted({r.size for r in table.select("size").collect()})
    text = F.coalesce("text", F.lit(""))
    d = documents(df).select("doc_id", _digest(text).alias("raw"), every_line(text).alias("every"))
    d = d.select("doc_id", "raw", F.filter("every", lambda x: x != "").alias("lines"), paragraphs(F.col("every")).alias("parts"))
    d = d.select("doc_id", "raw", "lines", F.filter(runs(F.col("parts")), lambda x: F.length(x).isin(sizes)).alias("runs"), _digest(F.concat_ws(" ", "lines")).alias("text_digest"))

    def unit(x: Column, kind: str) -> Column:
        return F.struct(x.alias("digest"), F.lit(kind).alias("kind"))

    rest = F.when(F.get("lines", F.lit(0)).isin(*TITLES), F.concat_ws(" ", F.slice("lines", 2, F.size("lines"))))
    units = F.concat(F.array(unit(F.col("text_digest"), "text")),
                     F.transform(F.filter(F.array(rest), lambda x: x.isNotNull()), lambda x: unit(_digest(x), "untitled")),
                     F.transform("runs", lambda x: unit(_digest(x), "run")),
                     F.transform("lines", lambda x: unit(_digest(x), "line")))
    d = d.select("doc_id", "raw", "text_digest", F.explode(units).alias("unit")).select("doc_id", "raw", "text_digest", "unit.*")
    d = d.join(F.broadcast(table.select("digest", "licence")), "digest", "left")
    # Every row has one unit "text": their number is how often the row repeats.
    copies = F.count(F.when(F.col("kind") == "text", 1))
    found = d.groupBy("doc_id", "raw", "text_digest").agg(
        F.max(F.when(F.col("kind").isin("text", "untitled"), F.col("licence"))).alias("text_licence"),
        (F.count(F.when(F.col("kind") == "line", F.col("licence"))) / copies).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"))
    return found.select("doc_id", "text_digest", "text_licence", "n_notices", "licences")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: one row per document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def every(x: str) -> str:
        out = "x"
        for pattern, instead in SPELLINGS:
            out = f"regexp_replace({out}, '{pattern}', '{instead.replace('$', chr(92))}', 'g')"
        form = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        states = " or ".join(f"(regexp_matches(x, {quoted(b)})" + (f" and not regexp_matches(x, {quoted(p)}))" if p else ")") for b, p in STATEMENTS)
        lines = f"list_transform(string_split({x}, chr(10)), lambda l: lower(l))"
        return f"list_transform({lines}, lambda x: case when {states} then '' else {form} end)"

    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    lines = "list_filter(every, lambda x: x <> '')"
    more = "".join(f", list_transform(range(1, len(parts) - {i - 2}), lambda i: {" || ' ' || ".join(f'parts[i + {k}]' for k in range(i))})" for i in range(2, PARAGRAPHS + 1))
    return f"""
with known_forms as (
  select licence, coalesce(array_to_string({lines}, ' '), '') as form
  from (select licence, {every('text')} as every from (values {rows}) as k(licence, text))),
known as (select sha256(form) as digest, min(licence) as licence, max(length(form)) as size from known_forms group by 1),
d as (
  select distinct on (doc_id, raw) doc_id, raw, {lines} as l,
         list_filter(list_transform(string_split_regex(array_to_string(every, chr(10)), '\\n\\n+'),
                                    lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> '') as parts
  from (select doc_id, sha256(coalesce(text, '')) as raw, {every("coalesce(text, '')")} as every from documents)),
t as (select *, sha256(coalesce(array_to_string(l, ' '), '')) as text_digest from d),
u as (
  select doc_id, raw, text_digest, 'text' as kind, text_digest as digest from t
  union all
  select doc_id, raw, text_digest, 'untitled', sha256(coalesce(array_to_string(l[2:], ' '), '')) from t
  where l[1] in ({", ".join(map(quoted, TITLES))})
  union all
  select doc_id, raw, text_digest, 'line', sha256(x) from (select *, unnest(l) as x from t)
  union all
  select doc_id, raw, text_digest, 'run', sha256(x)
  from (select doc_id, raw, text_digest, unnest(flatten([parts{more}])) as x from t) where length(x) in (select size from known)),
j as (select u.*, licence from u left join known on u.digest = known.digest)
select doc_id, text_digest, max(licence) filter (kind in ('text', 'untitled')) as text_licence,
       count(licence) filter (kind = 'line') as n_notices,
       coalesce(array_to_string(list_sort(list(distinct licence) filter (licence is not null)), ','), '') as licences
from j group by doc_id, raw, text_digest"""
