"""License scan by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import text_key, texts

#: Words of a text whose letters A to Z are in lower case; CASED takes the same words where they aren't.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 3
# The phrases and labels of the contract.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Whole license texts, notices that licenses ask for, and sentences of those; a third item is what a span must hold.
NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", 'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND'),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor
        the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""", "terms of the GNU General"),
    ("gpl", "licensed under the GNU General Public License", "the GNU General"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "the GNU General"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "GNU Lesser General"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "GNU Affero General"),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
        be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
        the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
        not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
        by any means."""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "Attribution 4 0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "Attribution NonCommercial 4"),
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def grams_of(text: str) -> list[str]:
    w = words_of(text)
    return [" ".join(w[i : i + K]) for i in range(len(w) - K + 1)]


def template_grams(spark, base=BASE, notices=NOTICES) -> DataFrame:
    """A row for each k-gram of each template: bounded by the lists above. `must`: positions that a span has to hold."""
    rows = []
    for t, (label, text, *must) in enumerate([*base, *notices]):
        grams = grams_of(text)
        held = grams_of(must[0]) if must else []
        at = sorted(grams.index(g) for g in held)
        rows += [(t, label, t < len(base), len(grams), at, i, g) for i, g in enumerate(grams)]
    grams = spark.createDataFrame(rows, "template int, label string, is_base boolean, n_grams int, must array<int>, at int, gram string")
    return grams.withColumn("gram_hash", F.xxhash64(*[F.split("gram", " ")[i] for i in range(K)]))


#: Of the hits (pos, at) of a span, those in order: each as far on in the template as in the text, or nearly.
IN_ORDER = """aggregate(hits, struct(-1 as at, -1 as pos, array() as kept), (acc, h) ->
    if(acc.at < 0 or (h.at > acc.at and h.pos > acc.pos and abs((h.pos - h.at) - (acc.pos - acc.at)) <= drift),
       struct(h.at as at, h.pos as pos, concat(acc.kept, array(h.at)) as kept), acc), acc -> acc.kept)"""


def license_scan(docs: DataFrame, base=BASE, notices=NOTICES, near: int = 3, cover: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses that every whole text names, by diagonal voting.

    All rolling word k-gram hashes of the texts join the templates' k-gram positions. Each hit, checked word by word, votes
    for the diagonal (position in the text less position in the template). A base phrase is found where its diagonal has
    all votes. Of the notices, diagonals up to `near` words apart are merged, so that inserted or lost words don't end a
    span. A span is verified around its strongest diagonal: hits within an eighth of the template's length of it (`near` at
    least), so that a span is about as long as its template, and of those the ones that follow each other in template and
    text alike, have to cover the share `cover` of the template's k-grams, and all k-grams that the template says it must have.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest cover of any template).
    Null or empty text: no words, no labels, score 0. Repeated rows get equal results; a row of one id with another text
    gets its own. An empty table: no rows.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    tokens = rows.select("doc_id", text_key().alias("text_key"), words.alias("w"))
    # Hashes of w[i], w[i + 1], w[i + 2]; past the end get() is null, which no template has.
    grams = F.expr("transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))")
    rolling = tokens.select("doc_id", "text_key", "w", F.posexplode(grams).alias("pos", "gram_hash"))
    template = ["template", "label", "is_base", "n_grams", "must"]
    hits = (
        rolling.join(F.broadcast(template_grams(spark, base, notices)), "gram_hash")
        .filter(F.expr("concat_ws(' ', get(w, pos), get(w, pos + 1), get(w, pos + 2)) = gram"))
        .select("doc_id", "text_key", *template, "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    )
    key = ["doc_id", "text_key"]
    diagonals = hits.groupBy(*key, *template, "diagonal").agg(F.collect_set("at").alias("at"))
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    chains = (
        diagonals.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("is_base"), 0).otherwise(near)).cast("int"), F.lit(1)))
        .withColumn("span", F.sum("new").over(order))
        .groupBy(*key, *template, "span")
        .agg(F.array_sort(F.collect_list(F.struct((-F.size("at")).alias("lack"), "diagonal", "at"))).alias("lines"))
    )
    spans = (
        chains.withColumn("drift", F.when(F.col("is_base"), 0).otherwise(F.greatest(F.lit(near), F.expr("n_grams div 8"))))
        .withColumn("start", F.col("lines")[0]["diagonal"])
        .withColumn("hits", F.expr("array_sort(flatten(transform(filter(lines, l -> abs(l.diagonal - start) <= drift), l -> transform(l.at, a -> struct(l.diagonal + a as pos, a as at)))))"))
        .withColumn("kept", F.expr(IN_ORDER.replace("array() as kept", "cast(array() as array<int>) as kept")))
        .withColumn("votes", F.size("kept"))
        .withColumn("share", F.col("votes") / F.col("n_grams"))
    )
    found_base = F.col("is_base") & (F.col("votes") == F.col("n_grams"))
    found = found_base | (~F.col("is_base") & (F.col("share") >= cover) & (F.size(F.array_except("must", "kept")) == 0))
    by_doc = spans.groupBy(*key).agg(
        F.count(F.when(found_base, 1)).alias("n_base"),
        F.min(F.when(found_base, F.col("start"))).alias("first_word"),
        F.max(F.when(found_base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(found_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    n_words = F.regexp_count("text", F.lit(CASED)).cast("long")
    counted = rows.select("doc_id", text_key().alias("text_key"), n_words.alias("n_words"))
    same = counted["doc_id"].eqNullSafe(by_doc["doc_id"]) & (counted["text_key"] == by_doc["text_key"])
    return counted.join(by_doc, same, "left").select(
        counted["doc_id"],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
