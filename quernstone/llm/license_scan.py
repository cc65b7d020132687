"""Licence scan by diagonal voting, in DataFrame functions only.

Every word k-gram of every text is hashed and joined to the k-grams of licence
templates: base phrases, licence references and whole licence texts of any length (a table of ``BROADCAST_GRAMS`` rows at most is
broadcast; a larger one is joined by a shuffle). A hit votes for the
diagonal ``word position - template position``. Votes are kept by diagonal and by block of ``BLOCK`` template words, a bit for each
word, so that a diagonal is a row for a block whatever its votes and templates can be long. Base phrases count
where all their k-grams vote on one diagonal. For the others neighbouring diagonals
(a word more or fewer between) merge, and the merged span is verified: the template words
covered, over the template's length, must reach ``MIN_COVER`` and hold its distinctive word, where it has one. The joins compare the
words themselves beside the hashes, so a collision adds nothing.

Each row is followed by its own number, so rows that repeat a doc_id stay apart, and
each text leaves one row of its own in the exploded stream, so nothing is joined back.

Cases: a null or empty text has no words and no labels, with null places and score 0.
An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Template words whose votes one number holds; rows of k-grams that are broadcast.
BLOCK, BROADCAST_GRAMS = 60, 200_000

#: The base phrases of the query's contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    """A text that stands for a label, and the word that a span must cover wherever the text has it."""

    label: str
    text: str
    key: str | None = None

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(SEPARATORS, self.text.lower()) if w]


#: Wordings of licence references and licence texts in common use.
TEMPLATES = (
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", "nc"),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", "sa"),
    Template("cc-by-nd", "licensed under CC BY-ND 4.0", "nd"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache"),
    Template("mit", "released under the MIT License", "mit"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    Template("gpl-3.0", "licensed under the GNU General Public License version 3", "gnu"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", "lesser"),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    Template(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template(
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    Template(
        "bsd-3-clause-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "neither",
    ),
    Template(
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    Template(
        "gpl-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see",
        "3",
    ),
    Template(
        "zlib-text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution.",
    ),
)


def read_templates(table: DataFrame) -> DataFrame:
    """The k-grams of a table of templates (label, text, key) of any size."""
    words = F.array_remove(F.split(_lowered(F.col("text")), SEPARATORS), "")
    rows = table.select("label", _lowered(F.col("key")).alias("key"), words.alias("w")).where(F.size("w") >= 3).withColumn("t", F.xxhash64("label", F.array_join("w", " ")))
    rows = rows.select("t", "label", "w", F.size("w").alias("words"), F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda k: F.get("w", k) == F.col("key")).alias("keys"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("words") - 3)))
    blocks = F.explode(F.array_distinct(F.array(F.floor(F.col("i") / BLOCK).cast("int"), F.floor((F.col("i") + 2) / BLOCK).cast("int"))))
    rows = rows.withColumn("block", blocks)
    bits = lambda places: F.aggregate(places, F.lit(0).cast("long"), lambda acc, k: F.when(F.floor(k / BLOCK) == F.col("block"), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(BLOCK))))).otherwise(acc))
    return rows.select(
        "t", F.lit(False).alias("base"), F.col("i").alias("place"), F.get("w", F.col("i")).alias("a"), F.get("w", F.col("i") + 1).alias("b"), F.get("w", F.col("i") + 2).alias("c"), "words", (F.col("words") - 2).alias("grams"), "block",
        bits(F.sequence(F.col("i"), F.col("i") + 2)).alias("cover"), bits(F.coalesce("keys", F.array().cast("array<int>"))).alias("must"), F.coalesce(F.size("keys"), F.lit(0)).alias("musts"), "label",
    )


MIN_COVER = 0.8
NEAR = 2


def gram_rows(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple]:
    """Rows of ``GRAMS``: word pairs for base phrases, triples for templates.

    cover: the bits in its block of the words that a gram covers (of a base phrase, its place); must: the bits of the distinctive word in the block; musts: how many there are in all.
    """
    rows = []
    for t, (phrase, label) in enumerate(BASE):
        w = phrase.split()
        rows += [(t, True, i, w[i], w[i + 1], None, len(w), len(w) - 1, 0, 1 << i, 0, 0, label) for i in range(len(w) - 1)]
    for t, template in enumerate(templates, len(BASE)):
        w = template.words
        keys = [i for i, x in enumerate(w) if x == template.key]
        for i in range(len(w) - 2):
            for block in sorted({i // BLOCK, (i + 2) // BLOCK}):
                bits = lambda places, block=block: sum(1 << k % BLOCK for k in places if k // BLOCK == block)
                rows.append((t, False, i, w[i], w[i + 1], w[i + 2], len(w), len(w) - 2, block, bits(range(i, i + 3)), bits(keys), len(keys), template.label))
    return rows


GRAMS = "t long, base boolean, place int, a string, b string, c string, words int, grams int, block int, cover long, must long, musts int, label string"


def _lowered(c: Column) -> Column:
    """A-Z alone: other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cover: float = MIN_COVER, templates: tuple[Template, ...] | DataFrame = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    spark = docs.sparkSession
    own = isinstance(templates, DataFrame)
    grams = spark.createDataFrame(gram_rows(() if own else templates), GRAMS)
    if own:
        grams = grams.unionByName(read_templates(templates))
    grams = grams.withColumn("h", F.xxhash64("a", "b"))
    if not own or grams.count() <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    words = F.array_remove(F.split(_lowered(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS), "")
    rows = docs.select(F.col(id_col).alias("i"), F.monotonically_increasing_id().alias("row"), words.alias("w"))
    # the empty word at the end stands for the text itself
    ended = F.concat("w", F.array(F.lit("")))
    rows = rows.select("i", "row", F.size("w").cast("long").alias("n"), ended.alias("w"))
    shift = lambda k: F.slice("w", k, F.size("w"))
    rows = rows.select("i", "row", "n", F.posexplode(F.arrays_zip(F.col("w").alias("w1"), shift(2).alias("w2"), shift(3).alias("w3"))).alias("pos", "g"))
    rows = rows.select("i", "row", "n", "pos", F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2"), F.col("g.w3").alias("w3"))
    meets = (F.xxhash64("w1", "w2") == F.col("h")) & (F.col("w1") == F.col("a")) & (F.col("w2") == F.col("b")) & (F.col("c").isNull() | (F.col("w3") == F.col("c")))
    hits = rows.join(grams, meets, "left").where((F.col("w1") == "") | F.col("t").isNotNull())
    kept = ["i", "row", "n", "t", "base", "words", "grams", "musts", "label"]
    votes = hits.groupBy(*kept, "block", "must", (F.col("pos") - F.col("place")).cast("long").alias("diag")).agg(F.bit_or("cover").alias("cover"))
    order = W.partitionBy("row", "t").orderBy("diag", "block")
    before = F.lag("diag").over(order)
    fresh = F.when(F.col("base"), F.col("diag") > before).otherwise(F.col("diag") - before > NEAR)
    votes = votes.withColumn("run", F.sum(F.coalesce(fresh.cast("int"), F.lit(1))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = votes.groupBy(*kept, "run", "block", "must").agg(F.min("diag").alias("first"), F.bit_or("cover").alias("cover"))
    spans = spans.groupBy(*kept, "run").agg(F.min("first").alias("first"), F.sum(F.bit_count("cover")).alias("covered"), F.sum(F.bit_count(F.col("cover").bitwiseAND(F.col("must")))).alias("had"))
    spans = spans.withColumn("cover", F.col("covered") / F.col("words"))
    spans = spans.withColumn("is_base", F.coalesce(F.col("base") & (F.col("covered") == F.col("grams")), F.lit(False))).withColumn("is_own", F.coalesce(~F.col("base") & (F.col("had") == F.col("musts")) & (F.col("cover") >= min_cover), F.lit(False)))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy("i", "row", "n").agg(
        F.sum(F.col("is_base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("first"))).alias("last_word"),
        joined(F.col("is_base")).alias("base_labels"),
        joined(F.col("is_base") | F.col("is_own")).alias("labels"),
        F.round(F.coalesce(F.max(F.when(F.col("is_base"), F.lit(1.0)).when(F.col("is_own"), F.col("cover"))), F.lit(0.0)), 6).alias("score"),
    )
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(min_cover: float = MIN_COVER) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in gram_rows())
    return f"""
WITH grams(t, base, place, a, b, c, words, grams, block, cover, must, musts, label) AS (VALUES {values}),
w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w
  FROM documents),
p AS (SELECT r, w, unnest(range(len(w))) AS pos FROM w),
hits AS (
  SELECT p.r, g.*, pos - place AS diag
  FROM p JOIN grams g ON w[pos + 1] = a AND w[pos + 2] = b AND (c IS NULL OR w[pos + 3] = c)),
votes AS (
  SELECT r, t, base, words, grams, musts, label, block, must, diag, bit_or(CAST(cover AS BIGINT)) AS cover
  FROM hits GROUP BY ALL),
marked AS (
  SELECT *, diag - lag(diag) OVER (PARTITION BY r, t ORDER BY diag, block) AS gap
  FROM votes),
runs AS (SELECT *, sum(CASE WHEN gap IS NULL OR base AND gap > 0 OR NOT base AND gap > {NEAR} THEN 1 ELSE 0 END) OVER (PARTITION BY r, t ORDER BY diag, block ROWS UNBOUNDED PRECEDING) AS run FROM marked),
merged AS (
  SELECT r, t, base, words, grams, musts, label, run, block, must, min(diag) AS first, bit_or(cover) AS cover
  FROM runs GROUP BY ALL),
spans AS (
  SELECT r, t, base, words, grams, musts, label, run, min(first) AS first, sum(bit_count(cover)) AS covered, sum(bit_count(cover & CAST(must AS BIGINT))) AS had
  FROM merged GROUP BY ALL),
found AS (SELECT *, covered / words AS cover, base AND covered = grams AS is_base, NOT base AND had = musts AND covered / words >= {min_cover} AS is_own FROM spans)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(count(*) FILTER (is_base) AS BIGINT) AS n_base,
       CAST(min(first) FILTER (is_base) AS BIGINT) AS first_word, CAST(max(first) FILTER (is_base) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (is_base OR is_own)), ','), '') AS labels,
       round(CAST(coalesce(max(CASE WHEN is_base THEN 1.0 WHEN is_own THEN cover END), 0) AS DOUBLE), 6) AS score
FROM w LEFT JOIN found f ON f.r = w.r
GROUP BY w.r, w.doc_id, w.w"""


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE = {"op10_license_scan": oracle()}
