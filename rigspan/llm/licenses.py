"""License scans by diagonal voting.

All rolling word k-grams of a document join the k-grams of the license
templates by hash. A hit votes for its diagonal, the offset of document
position over template position: a template that stands whole fills one
diagonal; inserted or missing words spread it over neighbouring ones, which are
merged. Hits are verified by the words themselves before they vote. Short
phrases are read by pairs of words, whole license texts by four words. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize
from .urls import LOWER, UPPER

# fixed values: the phrases that count wherever their words stand consecutively
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# fixed values: wording of common licenses, phrases first and then whole texts
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl-2", "under the gnu general public license version 2"),
    ("gpl-3", "under the gnu general public license version 3"),
    ("lgpl", "under the gnu lesser general public license"),
    ("mpl-2", "under the mozilla public license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE."""),
    ("bsd", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
        ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
        TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE."""),
    ("isc", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. This notice may not be removed or altered from any
        source distribution."""),
    ("apache-2", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License."""),
    ("unlicense", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means."""),
    ("mpl-2", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLACK = 2
LEAST = 0.7
#: Words per gram of phrases and of texts from WHOLE words on.
PHRASE_K, TEXT_K, WHOLE = 2, 4, 24
#: Template grams that are broadcast to the documents; of more, the documents' grams are shuffled with their own words.
BROADCAST_GRAMS = 100_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words; all characters beyond ASCII are letters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """The default table of license texts: label, text."""
    return spark.createDataFrame(templates, "label string, text string")


def _rolling(hashes: str, k: int) -> Column:
    """Of an array of word hashes: struct(at, k, hash) of every k words."""
    last = F.size(hashes) - k
    each = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("at"), F.lit(k).alias("k"), F.xxhash64(*[F.get(F.col(hashes), i + F.lit(j)) for j in range(k)]).alias("hash")),
    )
    return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<at:int,k:int,hash:bigint>>"))


def template_grams(phrases: list[tuple[str, str]], templates: DataFrame) -> DataFrame:
    """One row per k-gram of each template: template, label, base, k, grams, t_at, t_words, hash."""
    spark = templates.sparkSession
    base = spark.createDataFrame(phrases, "label string, text string").withColumn("base", F.lit(True))
    rows = base.unionByName(templates.select("label", "text", F.lit(False).alias("base"))).select("label", "base", words(F.col("text")).alias("w"))
    rows = rows.withColumns({
        "template": F.xxhash64("label", "base", "w"),
        "k": F.when(~F.col("base") & (F.size("w") >= WHOLE), TEXT_K).otherwise(F.least(F.size("w"), F.lit(PHRASE_K))),
        "h": F.transform("w", lambda x: F.xxhash64(x)),
    }).where("size(w) > 0")
    grams = F.when(F.col("k") == 1, _rolling("h", 1)).when(F.col("k") == PHRASE_K, _rolling("h", PHRASE_K)).otherwise(_rolling("h", TEXT_K))
    rows = rows.select("template", "label", "base", "w", F.size(grams).alias("grams"), F.explode(grams).alias("g"))
    return rows.select(
        "template", "label", "base", "grams", "g.k", F.col("g.at").alias("t_at"), "g.hash",
        F.slice("w", F.col("g.at") + 1, F.col("g.k")).alias("t_words"),
    )


def scan(
    docs: DataFrame,
    phrases: list[tuple[str, str]] = PHRASES,
    templates: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every document.

    n_base: places where a phrase stands whole. labels: those of the phrases
    and of ``templates(label, text)`` found to ``LEAST`` or more of their
    k-grams within a span of neighbouring diagonals; of short ones the closing
    gram must be among them, which tells versions apart. Every diagonal opens a
    span of 1.5 lengths of its template at most, so no stray hit in front of a
    match cuts it; matching spans that overlap are one.
    score: the largest share. spans: (label, first, last word). Null text: no
    words. Nothing found: empty labels, score 0, null places. Repeated rows and
    null ids stay, rows of one id with other texts are scanned apart. No
    templates: phrases alone count. Other columns are left out.
    """
    spark = docs.sparkSession
    templates = template_table(spark) if templates is None else templates
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("text", F.struct("id", F.xxhash64("text").alias("h")).alias("key"))
    known = materialize(template_grams(phrases, templates))  # as many rows as the licenses have words
    ks = sorted(r.k for r in known.select("k").distinct().collect())
    # the words stay beside their grams, so that a hit is verified where it is found and no text is shuffled
    spelled = rows.select("key", words(F.col("text")).alias("w")).select("key", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    rolled = spelled.select("key", "w", F.concat(*[_rolling("h", k) for k in ks]).alias("all_grams"))
    # outer: no filter on the array's size is inferred, which would spell it once more below; the join drops the empty ones
    grams = rolled.select("key", "w", F.explode_outer("all_grams").alias("g")).select("key", "w", F.col("g.at").alias("at"), F.col("g.k").alias("g_k"), F.col("g.hash").alias("hash"))
    if known.count() <= BROADCAST_GRAMS:
        met = grams.join(F.broadcast(known), "hash").where((F.col("k") == F.col("g_k")) & (F.slice("w", F.col("at") + 1, F.col("k")) == F.col("t_words")))
    else:
        met = grams.select("key", "at", "hash", F.slice("w", F.col("at") + 1, F.col("g_k")).alias("t_words")).join(known, ["hash", "t_words"])
    # rows that repeat count once
    hits = materialize(
        met.select("key", "template", "label", "base", "grams", "k", "at", "t_at", (F.col("at") - F.col("t_at")).alias("diagonal")).distinct()
    )

    of = ["key", "template", "label", "base", "grams", "k"]
    votes = hits.groupBy(*of, "diagonal").agg(F.count("*").alias("votes"))
    whole = votes.where("base and votes = grams").groupBy("key").agg(
        F.count("*").alias("n_base"),
        F.min("diagonal").alias("first_word"),
        F.max("diagonal").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("base_labels"),
        F.collect_set("label").alias("base_set"),
    )
    along = Window.partitionBy("key", "template").orderBy("diagonal", "at")
    merged = hits.withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(10**9)).over(along) > SLACK).cast("int"))
    merged = merged.withColumn("band", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    along_band = Window.partitionBy("key", "template", "band").orderBy("scaled")
    # every diagonal opens a span of half a length; scaled by it, one frame serves all templates of up to 2 * 65536 words
    reach = F.greatest(F.lit(SLACK + 1), F.floor(F.col("grams") / 2)).cast("long")
    diagonals = merged.groupBy(*of, "band", "diagonal").agg(
        F.collect_set("t_at").alias("t_at"), F.min("at").alias("at"), F.max(F.col("at") + F.col("k") - 1).alias("end_at")
    ).withColumn("scaled", F.col("diagonal").cast("long") * F.ceil(F.lit(1 << 32) / reach))
    opened = along_band.rangeBetween(Window.currentRow, (1 << 32) - 1)
    spans = diagonals.select(
        *of, "band", "scaled",
        F.array_distinct(F.flatten(F.collect_list("t_at").over(opened))).alias("seen"),
        F.min("at").over(opened).alias("first"), F.max("end_at").over(opened).alias("last"),
    ).withColumn("share", F.size("seen") / F.col("grams"))
    good = (F.col("share") >= LEAST) & ((F.col("k") == TEXT_K) | (F.array_max("seen") == F.col("grams") - 1))
    spans = spans.select("key", "template", "label", "band", "scaled", "share", "first", "last", good.alias("good"))
    # good spans of a band that overlap are one
    before = Window.partitionBy("key", "template", "band", "good").orderBy("first", "scaled")
    apart = F.col("first") > F.coalesce(F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    joined = spans.withColumn("apart", apart.cast("int")).withColumn(
        "island", F.sum("apart").over(before.rowsBetween(Window.unboundedPreceding, 0))
    ).groupBy("key", "template", "label", "band", "good", "island").agg(
        F.max("share").alias("share"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    found = joined.groupBy("key").agg(
        F.collect_set(F.when(F.col("good"), F.col("label"))).alias("found_set"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("label", "first", "last")))).alias("spans"),
    )
    results = materialize(found.join(whole, "key", "left"))
    drop_table(known, hits)
    out = rows.select("key", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(results, "key", "left")
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce("base_set", none), F.coalesce("found_set", none)))
    return out.select(
        F.col("key.id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        "spans",
    )
