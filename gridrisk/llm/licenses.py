"""Licence scans by the Dice coefficient over word bigrams, in Spark SQL expressions only.

The units compared are a text's lines, its paragraphs (blank lines part them) and the whole text.
A unit is normalised to words (letters in lower case, digits and non-ASCII characters) and becomes
the set of its word bigrams.  With a threshold t and a template of b bigrams, only units of
t/(2-t) * b to (2-t)/t * b bigrams can reach t, so each template is listed under the sizes it admits
and units meet templates by an equi-join on their size; the others are never compared.  The list is
built from the templates alone, so its size doesn't follow the data and it is broadcast.

With ``runs``, a licence that no such unit matches is also looked for in runs of neighbouring lines
(lines without words left out) of as many words as its template admits: texts of several paragraphs
inside longer ones, above code or in comments.  Of runs that start or end alike the best stays, and one
inside a better run goes.

Any part of a text can reach t only if the text has t/(2-t) * b of the template's bigrams, so texts are
first tried by their bigrams as a whole and most are never taken apart; runs are tried the same way by
the stretch behind each line.

Defined results: null and empty texts, and units of fewer than two words, match nothing.  A unit that
occurs several times in a text counts once and matches the template it is most like; equals all stay.
A text has one row for each licence it matches, with its best Dice; rows that share an id are judged
as one text's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

THRESHOLD = 0.85

_WORDS = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"

#: Notices, openings of licence texts, and as ``-text`` the whole texts as published, without title and
#: copyright line (fixed values).
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "GPL-3.0-header-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "all-rights-reserved": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORDS), F.lit(1))


def bigrams(words: Column) -> Column:
    """The distinct word bigrams, as 64-bit hashes; empty for fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(pairs)


def _tried(docs: DataFrame, listed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text`` and ``ts``, the templates that any part of the text can reach: others are dropped."""
    # the templates as one row: texts are tried by the bigrams they share with any of them
    every = listed.filter("size(template) > 0").agg(
        F.array_distinct(F.flatten(F.collect_list("template"))).alias("all"),
        F.collect_list(F.struct("license", "template", "low", "most")).alias("templates"))
    tried = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    tried = tried.select("id", "text", words(F.col("text")).alias("words"))
    tried = tried.select("id", "text", bigrams(F.col("words")).alias("pairs")).crossJoin(F.broadcast(every))
    # explode keeps each step's arrays made once, outside of the lambdas that read them
    tried = tried.select("id", "text", "templates", F.explode(F.array(F.array_intersect("pairs", "all"))).alias("pairs"))
    hold = F.filter("templates", lambda t: F.size(F.array_intersect("pairs", t["template"])) >= t["low"])
    return tried.select("id", "text", hold.alias("ts")).filter("size(ts) > 0")


def _runs(tried: DataFrame, threshold: float) -> DataFrame:
    """``id``, ``license`` and ``dice`` of the runs of neighbouring lines that match a template."""
    split = F.filter(F.transform(F.split("text", "\n"), words), lambda x: F.size(x) > 0)
    tried = tried.filter("instr(text, '\n') > 0")
    lined = tried.select("id", F.xxhash64("text").alias("key"), "ts", F.explode(F.array(split)).alias("lines"))
    flat = F.flatten("lines")
    n = F.greatest(F.size(flat) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(flat, F.lit(1), n), F.slice(flat, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    line = F.flatten(F.transform("lines", lambda x, i: F.transform(x, lambda _: i)))
    lined = lined.select("id", "key", "ts", F.explode(F.array(F.struct(pairs.alias("pairs"), line.alias("line")))).alias("x"))
    first = F.filter(F.sequence(F.lit(1), F.size("x.line")),
                     lambda k: (k == 1) | (F.get(F.col("x.line"), k - 2) != F.get(F.col("x.line"), k - 1)))
    starts = lined.select("id", "key", "x", F.explode("ts").alias("t"), first.alias("firsts"))
    starts = starts.select("id", "key", "x", "t", F.explode("firsts").alias("start"))
    most = F.col("t.most")
    starts = starts.select("id", "key", "t", "start", F.slice("x.pairs", F.col("start"), most).alias("pairs"),
                           F.slice("x.line", F.col("start"), most + 2).alias("line"))
    starts = starts.filter(F.size(F.array_intersect("pairs", F.col("t.template"))) >= F.col("t.low"))
    ends = F.filter(F.sequence(F.lit(1), F.size("pairs")),
                    lambda k: (k >= F.col("t.low")) & ~F.get(F.col("line"), k).eqNullSafe(F.get(F.col("line"), k + 1)))
    met = starts.select("id", "key", "t", "start", "pairs", F.explode(ends).alias("n"))
    met = met.select("id", "key", "t", "start", (F.col("start") + F.col("n")).alias("end"),
                     F.explode(F.array(F.array_distinct(F.slice("pairs", F.lit(1), F.col("n"))))).alias("unit"))
    common = F.size(F.array_intersect("unit", F.col("t.template")))
    met = met.select("id", "key", "start", "end", F.col("t.license").alias("license"),
                     (2.0 * common / (F.size("unit") + F.size("t.template"))).alias("dice")).filter(F.col("dice") >= threshold)

    def best(*by):
        return F.max("dice").over(Window.partitionBy("id", "key", *by))

    def longer(by, order):
        return F.max("dice").over(Window.partitionBy("id", "key", by).orderBy(order).rangeBetween(1, Window.unboundedFollowing))

    met = met.select("*", best("start", "end").alias("b0"), best("license", "start").alias("b1"), best("license", "end").alias("b2"),
                     longer("start", F.col("end")).alias("b3"), longer("end", -F.col("start")).alias("b4"))
    return met.filter("dice >= greatest(b0, b1, b2, b3, b4)").select("id", "license", "dice")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
         threshold: float = THRESHOLD, runs: bool = False) -> DataFrame:
    """``id``, ``license``, ``dice`` (the best of the text's units) and ``n_units`` (distinct units that match;
    runs where none but runs match)."""
    listed = docs.sparkSession.range(1).select(F.explode(F.create_map(
        *[F.lit(x) for pair in sorted((templates or TEMPLATES).items()) for x in pair])).alias("license", "template"))
    listed = listed.select("license", words(F.col("template")).alias("words"))
    listed = listed.select("license", "words", bigrams(F.col("words")).alias("template"))
    b = F.size("template")
    low = F.ceil(threshold * b / (2 - threshold) - 1e-9).cast("int")
    high = F.floor((2 - threshold) * b / threshold + 1e-9).cast("int")
    # a run may repeat as many bigrams as the template does
    listed = listed.select("license", "template", low.alias("low"), high.alias("high"),
                           (high + F.size("words") - 1 - b).alias("most"))
    by_size = listed.filter("size(template) > 0").select("license", "template", F.explode(F.sequence("low", "high")).alias("size"))

    tried = _tried(docs, listed, id_col, text_col)
    if runs:  # read twice
        tried = cut_lineage(tried)
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n[ \t\r]*\n\s*"), F.array("text")))
    # rows that share an id are told apart by their texts
    rows = tried.select("id", F.xxhash64("text").alias("of"), F.posexplode(units).alias("at", "unit"))
    # each step on its own, so that no text is taken apart twice
    rows = rows.select("id", "of", "at", words(F.col("unit")).alias("words"))
    rows = rows.select("id", "of", "at", bigrams(F.col("words")).alias("unit"))
    met = rows.withColumn("size", F.coalesce(F.size("unit"), F.lit(0))).join(F.broadcast(by_size), "size")
    common = F.size(F.array_intersect("unit", "template"))
    met = met.select("id", "of", "at", "license", (2.0 * common / (F.col("size") + F.size("template"))).alias("dice"))
    best = F.max("dice").over(Window.partitionBy("id", "of", "at"))  # a unit is what it is most like
    met = met.filter(F.col("dice") >= threshold).withColumn("best", best).filter("dice = best")
    if not runs:
        return met.groupBy("id", "license").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_units"))
    met = met.select("id", "license", "dice", F.lit(False).alias("run")).unionByName(
        _runs(tried, threshold).withColumn("run", F.lit(True)))
    kinds = met.groupBy("id", "license").agg(*[f(F.when(F.col("run") == run, F.col("dice"))).alias(f"{name}{run}")
                                               for run in (False, True) for name, f in (("dice", F.max), ("n", F.count))])
    return kinds.select("id", "license", F.coalesce("diceFalse", "diceTrue").alias("dice"),
                        F.when(F.col("nFalse") > 0, F.col("nFalse")).otherwise(F.col("nTrue")).alias("n_units"))
