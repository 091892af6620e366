"""Licence scans by canonical digests.

A text's canonical form has A-Z lower-cased, copyright lines removed, everything but letters and digits turned
into single spaces, and equivalent spellings replaced.  Its SHA-256 is joined to the digests of known licence
texts.  Units that are looked up: each entire text, each paragraph of two lines or more, and each line.  A unit whose
first word begins no known text, and could not be replaced, is passed over before it is normalised.

DataFrame functions only.  A null or empty text, and a unit whose canonical form is empty, match nothing.
Repeated rows and repeated units are reported each.  Extra columns are ignored.  An empty table gives no rows; texts of any length are read
whole; of known texts with one canonical form the least name is reported.
"""

from __future__ import annotations

from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.registry import query, table

#: Known digests that every task may hold (about 100 bytes each); more are joined by shuffle.
HELD_DIGESTS = 200_000

# Lines that state an owner, spellings that licence matching counts as equal, and known texts.
COPYRIGHT = r"(^|\n)[\t #*/;-]*(copyright[ :]*(\(c\)|©|[0-9<\[]|by )|\(c\)|©|all rights reserved)[^\n]*"
PARAGRAPH = r"\n[ \t\r]*\n"
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"), ("organisation", "organization"), ("favour", "favor"), ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"), ("acknowledgement", "acknowledgment"),
    ("v2 0", "version 2 0"), ("v3", "version 3"), ("https", "http"),
]
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n" + ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("Unlicense", "SPDX-License-Identifier: Unlicense"),
]
#: Whole texts, a file named by the licence each.
KNOWN += sorted((file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")) for file in resources.files(__package__).joinpath("licenses").iterdir())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_lines(text: Column) -> Column:
    """Lower-cased text without copyright lines and punctuation; line breaks stay."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    owned = F.regexp_replace(F.replace(lowered, F.lit("\r"), F.lit("")), COPYRIGHT, "$1")
    return F.regexp_replace(owned, r"[^\p{L}\p{N}\n]+", " ")


def canonical(plain: Column) -> Column:
    """The canonical form of a unit of :func:`plain_lines`: words between single spaces, spellings replaced."""
    spaced = F.concat(F.lit(" "), F.replace(F.regexp_replace(plain, r"[ \n]+", " "), F.lit(" "), F.lit("  ")), F.lit(" "))
    spelled = reduce(lambda form, pair: F.replace(form, F.lit(_spaced(pair[0])), F.lit(_spaced(pair[1]))), SPELLINGS, spaced)
    return F.trim(F.regexp_replace(spelled, " +", " "))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``license`` and ``digest`` of known texts; of texts with one canonical form the least name stands."""
    texts = spark.createDataFrame(KNOWN if known is None else known, "license string, text string")
    forms = texts.select("license", canonical(plain_lines(F.col("text"))).alias("form")).filter("form <> ''")
    return forms.select("license", F.sha2("form", 256).alias("digest"), F.substring_index("form", " ", 1).alias("first")).groupBy("digest", "first").agg(
        F.min("license").alias("license"))


def first_word(unit: Column) -> Column:
    return F.translate(F.regexp_extract(unit, r"[\p{L}\p{N}]+", 0), UPPER, LOWER)


#: First words that normalising may replace or drop: those of spellings, and of copyright lines.
MOVING = sorted({old.split()[0] for old, _ in SPELLINGS} | {"copyright", "c", "all"})


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", held_digests: int = HELD_DIGESTS) -> DataFrame:
    """``key``, scope (text, paragraph or line), place (its number from 0), license and digest of every unit that is known."""
    texts = docs.select(F.col(key).alias("__key"), F.coalesce("text", F.lit("")).alias("__text"))

    def units(scope: str, found: Column) -> Column:
        return F.transform(found, lambda unit, place: F.struct(F.lit(scope).alias("scope"), place.alias("place"), unit.alias("unit")))

    paragraphs = F.filter(units("paragraph", F.split("__text", PARAGRAPH)), lambda x: F.trim(x["unit"]).contains("\n"))
    listed = F.concat(units("text", F.array("__text")), paragraphs, units("line", F.split("__text", "\n")))
    found = texts.select("__key", F.explode(listed).alias("x")).select("__key", "x.*").withColumn("__first", first_word(F.col("unit")))
    held = known.count() <= held_digests
    firsts = known.select(F.col("first").alias("__first")).distinct().withColumn("__begins", F.lit(True))
    moved = F.col("__first").isin(MOVING) | F.regexp_extract("unit", r"^[^\p{L}\p{N}]*", 0).contains("©")
    begun = found.join(F.broadcast(firsts) if held else firsts, "__first", "left").filter(F.col("__begins") | moved)
    # never null, and stated so: else the join's null test would be pushed down and digest every unit
    digest = F.coalesce(F.sha2(canonical(plain_lines(F.col("unit"))), 256), F.lit(""))
    digested = begun.select(F.col("__key").alias(key), "scope", "place", digest.alias("digest"))
    known = known.select("digest", "license")
    return digested.join(F.broadcast(known) if held else known, "digest").select(key, "scope", "place", "license", "digest")


def _sql_canonical(plain: str) -> str:
    form = f"' ' || replace(regexp_replace({plain}, '[ \\n]+', ' ', 'g'), ' ', '  ') || ' '"
    for old, new in SPELLINGS:
        form = f"replace({form}, '{_spaced(old)}', '{_spaced(new)}')"
    return f"trim(regexp_replace({form}, ' +', ' ', 'g'))"


def _sql_plain(text: str) -> str:
    lowered = f"replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), chr(13), '')"
    return rf"regexp_replace(regexp_replace({lowered}, '{COPYRIGHT}', '\1', 'g'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(*(part.replace("'", "''") for part in pair)) for pair in KNOWN)
_SQL = rf"""
WITH known AS (SELECT sha256({_sql_canonical(_sql_plain("text"))}) AS digest, min(license) AS license
    FROM (VALUES {_KNOWN_SQL}) AS k(license, text) GROUP BY 1),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT doc_id, 'text' AS scope, 0 AS place, text AS unit FROM texts
    UNION ALL SELECT doc_id, 'line', unnest(range(len(l))), unnest(l) FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM texts)
    UNION ALL SELECT doc_id, 'paragraph', unnest(range(len(l))), unnest(l) FROM (SELECT doc_id, string_split_regex(text, '{PARAGRAPH}') AS l FROM texts)),
fit AS (SELECT * FROM listed WHERE scope <> 'paragraph' OR contains(trim(unit), chr(10))),
digested AS (SELECT doc_id, scope, place, sha256({_sql_canonical(_sql_plain("unit"))}) AS digest FROM fit)
SELECT doc_id, scope, CAST(place AS INTEGER) AS place, license, digest FROM digested JOIN known USING (digest)
"""


@query("op9_license_scan", sql=_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))
