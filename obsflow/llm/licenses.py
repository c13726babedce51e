"""Licence families of paragraphs (native: DataFrame functions and Spark's own logistic regression).

A paragraph is a line with words of licences, or neighbouring such lines up to one that ends a sentence, as a notice may
be wrapped. Its features are word n-grams of one to three words. A multinomial logistic regression with a sparse penalty
is fitted on licence texts and on names in common phrases, whole, cut short and between other words; on phrases with
names of no family (the unknown class); and on a bounded sample of the corpus's own lines (no licence). Its temperature
is set on variants held out of training, so its probabilities are calibrated. A paragraph more likely than not to be of
a licence is reported; its family counts if it is likely enough and if enough n-grams of one of the family's texts or
names are there, and is unknown otherwise.

Lines meet the model in a join on hashed n-grams; the model has a bounded number of rows. N-grams that are common
in the sample are no features, so ordinary prose leaves the join early.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsflow.llm.common import only

NONE, UNKNOWN = "none", "unknown"
#: The classifier's examples of text without a licence: lines of so many documents, of at most so many characters.
SAMPLE_DOCUMENTS, SAMPLE_LINE = 300, 1000
#: Share of sampled lines from which on an n-gram is too common to be a feature.
COMMON = 0.004
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.6, 0.4

# fixed values: texts of public licences by family, names by which they are called, phrases that hold names, names of no family
TEXTS = {
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "agpl": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."],
    "boost": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
              "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
             "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License", "Apache 2.0 license", "Apache-2.0"],
    "mit": ["MIT License", "MIT licence", "terms of the MIT license", "Expat license"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL", "GPL, version 2 or later", "GPLv2", "GPLv3", "GPL-3.0-or-later", "GPL-2.0-only"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU LGPL", "LGPL, version 3", "LGPLv2.1", "LGPLv3", "LGPL-2.1-only"],
    "agpl": ["GNU Affero General Public License, version 3", "Affero General Public License", "GNU AGPL", "AGPL, version 3", "AGPLv3", "AGPL-3.0-only"],
    "bsd": ["BSD License", "BSD licence", "3-Clause BSD License", "2-Clause BSD license", "New BSD license", "BSD-3-Clause", "BSD-2-Clause"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License", "Mozilla licence", "MPL 2.0", "MPL-2.0"],
    "isc": ["ISC License", "ISC licence", "terms of the ISC license"],
    "boost": ["Boost Software License, Version 1.0", "Boost Software License", "Boost license", "BSL-1.0"],
    "epl": ["Eclipse Public License, version 2.0", "Eclipse Public License", "Eclipse licence", "EPL 2.0", "EPL-2.0"],
    "artistic": ["Artistic License 2.0", "Artistic License", "Perl Artistic licence", "Artistic-2.0"],
    "zlib": ["zlib License", "zlib/libpng license", "zlib licence"],
    "unlicense": ["Unlicense", "terms of the Unlicense"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license", "CC-BY-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution ShareAlike license", "CC-BY-SA-4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution NonCommercial license", "CC-BY-NC-4.0"],
    "cc0": ["CC0 1.0 Universal", "public domain under CC0 1.0", "Creative Commons Zero", "CC0-1.0"],
}
PHRASES = [
    "Licensed under {}.", "Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is licensed under the terms of the {}.",
    "Distributed under the {}.", "available under the {}", "SPDX-License-Identifier: {}", "License: {}", "subject to the terms of the {}", "{} applies to this file.", "It may be used under the {}, see the file for details.", "Dedicated to the {}.",
]
OTHERS = [
    "{} License", "{} {} License", "{} Public License, version 2", "{} Public Licence", "{} license", "{} Community License, version 1.1", "terms of a license agreement", "terms of the license", "publisher's agreement",
    "own license", "custom license", "license terms", "terms below", "terms of use", "Python Software Foundation License", "SIL Open Font License", "European Union Public Licence",
]
GENERAL = [
    "This software is made available under the terms of a license agreement.", "See the license file for details.", "Use of this content is subject to the license terms.", "A license is required to use this product.",
    "License information can be found in the documentation.", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.", "Copyright notice of the author.",
]
PLAIN = [
    "The meeting is at noon and the minutes are in the file.", "It was released in the spring.", "This work is of the first order.", "Version two of the plan was read to the public in general.",
    "You need a licence to drive a car in this country.", "The council granted permission for the building.", "Under the terms of the treaty both sides withdrew.", "He took creative licence with the story.",
    "The apache helicopter landed near the village.", "A mozilla engineer gave a talk about the project.", "Use the source and binary forms of the number.", "Copies were sold to any person who asked.", "The eclipse was seen by the public.",
]
CLASSES = [NONE, UNKNOWN, *NAMES, "proprietary"]


def grams(text: Column) -> Column:
    """The different word n-grams of one to three words, as text; words are runs of a-z and 0-9 in lower case."""
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")

    def joined(w: Column) -> Column:
        two = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
        three = F.zip_with(two, F.slice(w, 3, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.filter(F.concat(w, two, three), lambda g: g.isNotNull()))

    return F.element_at(F.transform(F.array(tokens), joined), 1)


def gram_hashes(text: Column) -> Column:
    """Hashes of the same n-grams, made from the words' hashes."""
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")

    def joined(h: Column) -> Column:
        two = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
        three = F.zip_with(two, F.slice(h, 3, F.size(h)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
        return F.array_distinct(F.concat(h, two, three))

    return F.element_at(F.transform(F.array(F.transform(tokens, lambda w: F.xxhash64(w))), joined), 1)


def hash_of(gram: Column) -> Column:
    """The hash that gram_hashes gives to an n-gram."""
    hashes = F.transform(F.split(gram, " "), lambda w: F.xxhash64(w))
    return F.aggregate(F.slice(hashes, 2, 2), F.element_at(hashes, 1), lambda acc, h: F.xxhash64(acc, h))


def examples(lines: list[str], seed: int = 9) -> list[tuple[str, float, bool]]:
    """(text, class, held out of training): the notices in variants, and texts without a licence."""
    draw, out = random.Random(seed), []
    filler = [w for line in (lines or PLAIN) for w in line.split()] or ["a"]
    some = lambda n: " ".join(draw.choice(filler) for _ in range(n))

    def variants(text: str, label: int) -> None:
        tokens = text.split()
        for k in range(14 if len(tokens) < 25 else 36):
            part = list(tokens)
            if k % 3 == 1 and len(part) > 4:
                cut = draw.randint(0, max(1, len(part) * 2 // 3))
                part = part[cut:] if draw.random() < 0.5 else part[: len(part) - cut]
            if k % 3 == 2 and len(part) > 4:
                part.pop(draw.randrange(len(part)))
            around = 0 if k < 6 else draw.randint(1, 12)
            out.append((f"{some(around)} {' '.join(part)} {some(draw.randint(0, around))}", float(label), k % 4 == 3))

    invent = lambda: "".join(draw.choice("aeioubcdfglmnprst") for _ in range(draw.randint(3, 9))).capitalize()

    def phrase(name: str, label: int) -> None:
        for k, form in enumerate(PHRASES):
            around = 0 if draw.random() < 0.5 else draw.randint(1, 12)
            out.append((f"{some(around)} {form.format(name)} {some(draw.randint(0, around))}", float(label), k % 4 == 3))

    for family, texts in TEXTS.items():
        for text in texts:
            variants(text, CLASSES.index(family))
    for family, names in NAMES.items():
        for name in names:
            phrase(name, CLASSES.index(family))
    for text in GENERAL:
        variants(text, CLASSES.index(UNKNOWN))
    for name in OTHERS:
        for _ in range(3 if "{" in name else 1):
            phrase(name.format(invent(), invent()), CLASSES.index(UNKNOWN))
    for k, line in enumerate([*PLAIN, *lines]):
        out.append((line, 0.0, k % 4 == 3))
    return out


@dataclass
class Model:
    """features: (hash, weights of all classes), bounded; intercepts and temperature; notices: (family, grams)."""

    features: DataFrame
    notices: DataFrame
    intercepts: list[float]
    temperature: float


def sample_lines(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> list[str]:
    """Lines without a word of licences from the documents whose ids have the smallest hashes."""
    texts = only(docs, doc_id="long", text="string").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(documents)
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where((F.col("line") != "") & (F.length("line") <= SAMPLE_LINE)).where(~F.lower("line").rlike("licen|copyright|rights reserved|gnu|spdx"))
    return sorted(r.line for r in lines.collect())


def train(spark: SparkSession, lines: list[str]) -> Model:
    rows = spark.createDataFrame(examples(lines), "text string, label double, held_out boolean").select("label", "held_out", grams(F.col("text")).alias("grams")).cache()
    plain = rows.where("label = 0")
    common = plain.select(F.explode("grams").alias("g")).groupBy("g").count().where(F.col("count") > max(1, COMMON * plain.count())).select("g")
    known = [(family, text) for texts in (TEXTS, NAMES) for family in texts for text in texts[family]]
    with_grams = spark.createDataFrame(known, "family string, text string").select("family", "text", grams(F.col("text")).alias("grams"))
    phrases = spark.createDataFrame([(UNKNOWN, t) for t in (*GENERAL, *(p.format("") for p in PHRASES), *(n.format("", "") for n in OTHERS))], "family string, text string")
    of_phrases = phrases.select("family", "text", grams(F.col("text")).alias("grams"))
    terms = sorted(r.g for r in with_grams.unionByName(of_phrases).select(F.explode("grams").alias("g")).distinct().join(common, "g", "left_anti").collect())
    vectors = CountVectorizerModel.from_vocabulary(terms, inputCol="grams", outputCol="features", binary=True).transform(rows)
    fitted = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.3, maxIter=80).fit(vectors.where("not held_out"))
    held = [(r.rawPrediction.toArray().tolist(), int(r.label)) for r in fitted.transform(vectors.where("held_out")).select("rawPrediction", "label").collect()]
    rows.unpersist()

    def loss(t: float) -> float:
        total = 0.0
        for raw, label in held:
            most = max(raw) / t
            total += most + math.log(sum(math.exp(x / t - most) for x in raw)) - raw[label] / t
        return total

    temperature = min((0.25 * 1.15**k for k in range(30)), key=loss)
    matrix = fitted.coefficientMatrix.toArray()
    table = spark.createDataFrame([(g, [float(matrix[c][k]) for c in range(len(matrix))]) for k, g in enumerate(terms)], "gram string, weights array<double>")
    kept = set(terms)
    of_notice = with_grams.select("family", F.filter("grams", lambda g: g.isin(list(kept))).alias("grams")).where(F.size("grams") > 0)
    return Model(
        table.select(hash_of(F.col("gram")).alias("h"), "weights"), of_notice.select("family", F.transform("grams", hash_of).alias("of_notice")), [float(x) for x in fitted.interceptVector.toArray()], temperature
    )


def licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, text) for each paragraph that names a licence.

    family is unknown for a paragraph that is like a licence but not of a family that its text confirms; paragraph is the
    number of its first line, from 0. Null and empty texts have none, very long texts are read whole; repeated rows are
    reported each; of equally likely classes the first of CLASSES counts; an empty table gives no rows; a null doc_id
    stays null; other columns are not read.
    """
    spark = docs.sparkSession
    model = model or train(spark, sample_lines(docs))
    plain = only(docs, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id())
    lines = plain.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_number", "line"))
    found = lines.select("row", "doc_id", "line_number", "line", F.explode(gram_hashes(F.col("line"))).alias("h"))
    # as many rows as there are n-grams in the texts and names above
    features = F.broadcast(model.features)
    with_terms = found.join(F.broadcast(model.features.select("h")), "h").groupBy("row", "line_number").agg(
        F.first("doc_id").alias("doc_id"), F.first("line").alias("line"), F.collect_set("h").alias("found")
    )
    in_row = Window.partitionBy("row").orderBy("line_number")
    goes_on = (F.lag("line_number").over(in_row) == F.col("line_number") - 1) & ~F.lag("line").over(in_row).rlike(r"[.!?][)\"'\s]*$")
    fresh = F.when(goes_on, 0).otherwise(1)
    in_runs = with_terms.withColumn("run", F.sum(fresh).over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
    paragraphs = in_runs.groupBy("row", "run").agg(
        F.min("line_number").alias("paragraph"), F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("line_number", "line"))).alias("lines"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")
    )
    scores = [F.sum(F.col("weights")[k]).alias(f"s{k}") for k in range(len(CLASSES))]
    weighed = paragraphs.select("row", "run", F.explode("found").alias("h")).join(features, "h").groupBy("row", "run").agg(*scores)
    logits = F.array(*((F.col(f"s{k}") + F.lit(model.intercepts[k])) / F.lit(model.temperature) for k in range(len(CLASSES))))
    best = paragraphs.join(weighed, ["row", "run"]).withColumn("logits", logits).withColumn("top", F.array_max("logits"))
    total = F.aggregate(F.transform("logits", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    licence = F.slice("logits", 2, len(CLASSES) - 1)  # all classes but none
    named = F.element_at(F.array(*(F.lit(c) for c in CLASSES[1:])), F.array_position(licence, F.array_max(licence)).cast("int"))
    own = (F.exp(F.array_max(licence) - F.col("top")) / total).alias("probability")
    is_licence = F.exp(F.col("logits")[0] - F.col("top")) / total < 0.5
    guessed = best.where(is_licence).select("row", "paragraph", "doc_id", "lines", "found", named.alias("guess"), own)
    # of the smaller side, as a long text may be cut short, but of eight n-grams at least where the text has as many
    smaller = F.least(F.size("of_notice"), F.greatest(F.size("found"), F.lit(8)))
    similar = F.size(F.array_intersect("found", "of_notice")) / smaller
    compared = guessed.join(F.broadcast(model.notices), guessed["guess"] == model.notices["family"], "left").withColumn("similarity", similar)
    top = compared.groupBy("row", "paragraph").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "lines", "guess", "probability")), F.coalesce(F.max("similarity"), F.lit(0.0)).alias("similarity")
    )
    sure = (F.col("guess") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY) & (F.col("similarity") >= LEAST_SIMILARITY)
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return top.select("doc_id", "paragraph", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "similarity", text.alias("text"))
