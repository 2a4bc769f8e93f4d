"""License scans: sparse TF-IDF cosine of headers and license files to license templates, and inheritance by
directory.

A text is compared in units: the text as a whole (a license file), its runs of one to ``RUN_PARAGRAPHS``
paragraphs (headers), and its runs of one to ``RUN_LINES`` lines (wrapped statements).  Lines without a letter or
digit end a paragraph; comment marks are no words.  A unit is looked at if it holds a cue, one of the words that every license notice has (``CUE``).
A unit is a bag of lower-case words; a word weighs its count times ``1 + ln((1 + N) / (1 + df))``, with N
and df counted over all documents, for every word of the unit and of the templates.

A unit declares a template if the cosine is ``threshold`` or more, and if it holds, for each similar template
of another license, a word that tells the two apart: "the GNU General Public License" without a version is
neither GPL-2.0 nor GPL-3.0.  A document declares the license of its best unit; "all rights reserved" counts only where
no other license is declared, as license texts begin with it.

A directory declares the license of its best-scoring file.  A document without one of its own takes
that of the nearest directory above it that declares any: directories, not documents, are joined with
their ancestors, and documents then with their directory.

Size: equal units of all documents are one row before anything is joined, so a line that a third of all
documents share is weighed once.  Words of the templates, of which common units consist, get their
frequencies as literals, and their postings are broadcast; both are bounded by the template list.  All other
words of the units are joined with the document frequencies by a shuffle.  Adaptive execution splits a directory with
very many documents or subdirectories.  Only DataFrame functions run on the executors.

Defined results: a null or empty text declares nothing; a null path has no directory and inherits
nothing; ties go to the license that sorts first; repeated rows are rows of their own; an empty table
gives an empty result.  Columns of ``docs`` other than doc_id, text and path are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gondola.llm.common import Scratch

THRESHOLD = 0.7
#: Templates of two licenses that are this alike need a word that tells them apart.
SIMILAR = 0.3
RUN_LINES = 4
RUN_PARAGRAPHS = 5
TERM = r"[a-z0-9]+"
CUE = r"(?i)(?:licen[sc]|copyright|rights reserved|redistribut|public domain|permission|warrant|spdx)"
#: Counts only where nothing else is declared.
LAST = "Proprietary"

#: Identifiers, and the sentences, headers and license texts that declare each license.
STATEMENTS = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms are permitted under the "
                     "BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the "
                     "BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_GNU = ("you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        "Software Foundation; either version {version} of the License, or (at your option) any later version.")
_GNU_FILE = ("GNU {name} Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is "
             "permitted to copy and distribute verbatim copies of this license document, but changing it is not "
             "allowed.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. {third}THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
        "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
          "promote products derived from this software without specific prior written permission. ")
_MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
              "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
              "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
              "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
              "subject to the following conditions:")
_MIT_REST = ("The above copyright notice and this permission notice shall be included in all copies or substantial "
             "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
             "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
             "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
             "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
             "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")
_ISC_REST = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
             "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
             "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
             "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
             "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
           "compliance with the License. You may obtain a copy of the License at "
           "http://www.apache.org/licenses/LICENSE-2.0")
_APACHE_REST = ("Unless required by applicable law or agreed to in writing, software distributed under the License is "
                "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                "implied. See the License for the specific language governing permissions and limitations under the "
                "License.")
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
HEADERS = (
    ("AGPL-3.0", "This program is free software: " + _GNU.format(name=_AGPL, version="3")),
    ("GPL-2.0", "This program is free software; " + _GNU.format(name=_GPL, version="2")),
    ("GPL-3.0", "This program is free software: " + _GNU.format(name=_GPL, version="3")),
    ("LGPL-2.1", "This library is free software; " + _GNU.format(name=_LGPL, version="2.1")),
    ("LGPL-3.0", "This library is free software: " + _GNU.format(name=_LGPL, version="3")),
    ("AGPL-3.0", _GNU_FILE.format(name=_AGPL, version="3", date="19 November 2007", year="2007")),
    ("GPL-2.0", _GNU_FILE.format(name=_GPL, version="2", date="June 1991", year="1989, 1991")),
    ("GPL-3.0", _GNU_FILE.format(name=_GPL, version="3", date="29 June 2007", year="2007")),
    ("LGPL-2.1", _GNU_FILE.format(name=_LGPL, version="2.1", date="February 1999", year="1991, 1999")),
    ("LGPL-3.0", _GNU_FILE.format(name=_LGPL, version="3", date="29 June 2007", year="2007")),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + " " + _APACHE_REST),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ "
                   "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", _BSD.format(third="")),
    ("BSD-3-Clause", _BSD.format(third=_THIRD)),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + " " + _MIT_REST),
    ("ISC", _ISC),
    ("ISC", _ISC + " " + _ISC_REST),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                  "modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
                  "a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
TEMPLATES = STATEMENTS + HEADERS + tuple(
    (name, f"SPDX-License-Identifier: {name}") for name, _ in STATEMENTS if name != LAST)


def terms(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): documents with each word."""
    found = docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: int, df: float) -> float:
    return 1 + math.log((1 + n) / (1 + df))


def tells(n: int, df: dict[str, int], templates=TEMPLATES, similar: float = SIMILAR) -> list[dict[str, list[int]]]:
    """For each template its words, each with the numbers of the similar templates that it is told apart from."""
    bags = [terms(text) for _, text in templates]
    weights = [{w: c * idf(n, df.get(w, 0)) for w, c in bag.items()} for bag in bags]
    norms = [math.sqrt(sum(v * v for v in ws.values())) for ws in weights]
    out = []
    for a, (name, _) in enumerate(templates):
        near = [b for b, (other, _) in enumerate(templates) if other != name and sum(
            v * weights[b].get(w, 0) for w, v in weights[a].items()) >= similar * norms[a] * norms[b]]
        out.append({w: [b for b in near if w not in bags[b]] for w in bags[a]})
    return out


def _runs(parts: Column, most: int) -> list[Column]:
    """Runs of one to ``most`` neighbouring parts that hold a cue."""
    def of(n: int) -> Column:
        joined = F.transform(parts, lambda _, k: F.array_join(F.slice(parts, k + 1, n), "\n"))
        return F.filter(joined, lambda s: s.rlike(CUE))

    return [of(n) for n in range(1, most + 1)]


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as one literal of the plan."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def units(docs: DataFrame) -> DataFrame:
    """(row, unit) of the rows (row, text): the words of each unit that holds a cue, in order, joined by spaces."""
    held = docs.where(F.col("text").rlike(CUE)).select(
        "row", "text", F.filter(F.split("text", "\n", -1), lambda s: s.rlike("[A-Za-z0-9]")).alias("lines"),
        F.split("text", r"\n(?:[^A-Za-z0-9\n]*\n)+", -1).alias("paragraphs"))
    found = held.select("row", F.explode(F.array_distinct(F.concat(
        F.array("text"), *_runs(F.col("paragraphs"), RUN_PARAGRAPHS), *_runs(F.col("lines"), RUN_LINES)))).alias("unit"))
    return found.select("row", F.array_join(_words(F.col("unit")), " ").alias("unit")).where("unit <> ''")


def declared(scratch: Scratch, docs: DataFrame, threshold: float = THRESHOLD,
             templates=TEMPLATES) -> DataFrame:
    """(row, license, score) of the rows (row, text) that declare a license."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, text in templates for w in terms(text)})
    n = docs.count()
    df = scratch.write("frequencies", frequencies(docs))
    known = {r["term"]: r["df"] for r in df.where(F.col("term").isin(vocabulary)).collect()}
    told = tells(n, known, templates)
    weights = {w: idf(n, known.get(w, 0)) for w in vocabulary}

    found = units(docs).select("row", "unit", F.sha2("unit", 256).alias("print"))
    found = scratch.write("units", found)
    bags = found.groupBy("print").agg(F.first("unit").alias("unit"))
    bags = bags.select("print", F.explode(F.split("unit", " ")).alias("term"))
    bags = scratch.write("bags", bags.groupBy("print", "term").agg(F.count(F.lit(1)).cast("double").alias("tf")))
    inside = F.col("term").isin(vocabulary)
    own = _table(spark, sorted(weights.items()), "of string, weight double")
    ours = bags.join(F.broadcast(own), F.col("term") == F.col("of")).drop("of")
    weight = 1 + F.log((1 + F.lit(float(n))) / (1 + F.col("df")))
    others = bags.where(~inside).join(df.where(~inside), "term").withColumn("weight", weight)
    squares = ours.select("print", "tf", "weight").unionByName(others.select("print", "tf", "weight"))
    norms = squares.groupBy("print").agg(F.sum((F.col("tf") * F.col("weight")) ** 2).alias("squared"))

    postings, totals = [], []
    for number, (name, text) in enumerate(templates):
        bag = terms(text)
        total = math.sqrt(sum((c * weights[w]) ** 2 for w, c in bag.items()))
        postings += [(w, number, c * weights[w] / total, told[number][w]) for w, c in sorted(bag.items())]
        totals.append((number, name, len({b for against in told[number].values() for b in against})))
    postings = _table(spark, postings, "of string, template int, share double, against array<int>")
    met = ours.join(F.broadcast(postings), F.col("term") == F.col("of")).groupBy("print", "template").agg(
        F.sum(F.col("tf") * F.col("weight") * F.col("share")).alias("dot"),
        F.size(F.array_distinct(F.flatten(F.collect_list("against")))).alias("apart"))
    totals = _table(spark, totals, "template int, license string, needed int")
    met = met.join(F.broadcast(totals), "template").where("apart >= needed").join(norms, "print")
    score = F.round(F.least(F.lit(1.0), F.col("dot") / F.sqrt("squared")), 9)
    order = sorted({name for name, _ in templates})
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("license")).cast("int")
    ranked = F.struct((F.col("license") != LAST).alias("open"), "score", F.negative(place).alias("place"))
    top = met.withColumn("score", score).where(F.col("score") >= threshold).groupBy("print").agg(
        F.max(ranked).alias("best"))
    top = scratch.write("top", top)
    best = found.select("row", "print").join(top, "print").groupBy("row").agg(F.max("best").alias("best"))
    return best.select("row", F.element_at(F.array(*[F.lit(x) for x in order]), -F.col("best.place")).alias(
        "license"), F.col("best.score").alias("score"))


def _folder(path: Column) -> Column:
    """Directory of a path; null without one."""
    return F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit(""))


def scan(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, path): (doc_id, path, own_license, own_score,
    license, inherited_from)."""
    scratch = Scratch(spark, "licenses")
    numbered = docs.select("doc_id", "text", "path").withColumn("row", F.struct(
        F.col("doc_id").alias("id"), F.col("path").alias("at"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")))
    own = scratch.write("own", declared(scratch, numbered.select("row", "text"), threshold))
    rows = scratch.write("rows", numbered.select("doc_id", "path", "row", _folder(F.col("path")).alias("folder")))

    files = own.select(_folder(F.col("row.at")).alias("folder"), "score", "license").where("folder IS NOT NULL")
    best = files.groupBy("folder").agg(F.max("score").alias("score"))
    named = files.join(best, ["folder", "score"]).groupBy("folder").agg(F.min("license").alias("license"))
    named = scratch.write("folders", named.select(F.col("folder").alias("from"), "license"))

    folders = rows.select("folder").where("folder IS NOT NULL").distinct()
    parts = F.split("folder", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = folders.select("folder", F.explode(above).alias("from")).withColumn("depth", F.length("from"))
    near = above.join(named, "from").groupBy("folder").agg(
        F.max("depth").alias("depth"))
    near = near.withColumn("from", F.expr("left(folder, depth)")).join(named, "from").select(
        F.col("folder").alias("of"), F.col("from").alias("inherited_from"), F.col("license").alias("given"))
    near = scratch.write("near", near)

    own = own.select(F.col("row").alias("own_row"), F.col("license").alias("own_license"),
                     F.col("score").alias("own_score"))
    joined = rows.join(own, F.col("row").eqNullSafe(F.col("own_row")), "left").join(
        near, F.col("folder") == F.col("of"), "left")
    return joined.select(
        "doc_id", "path", "own_license", "own_score",
        F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("inherited_from")).alias("inherited_from"))


def document_path(doc_id: Column, source: Column) -> Column:
    """A path for documents that come without one: the source, a directory per leading digit of the
    doc_id but its last two, and the doc_id as file name."""
    digits = F.regexp_replace(F.floor(doc_id / 100).cast("string"), "(.)", "$1/")
    return F.concat(F.coalesce(source, F.lit("unknown")), F.lit("/"), digits, doc_id.cast("string"))
