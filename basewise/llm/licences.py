"""Licence scan by a trained classifier of passages, on DataFrame functions and pyspark.ml alone.

A passage is a sentence of a paragraph: lines are joined up to a blank one, so a licence
text that is wrapped over lines is read whole; lines are also judged alone, and long
sentences in overlapping windows of words. Sparse word n-grams go into a multinomial
logistic regression with one class per licence family and one for everything else. Each
family's margin over the latter becomes a probability by a second, one-dimensional
regression on held-out passages (Platt), so a passage may name several families. Below
the bar it is unknown. What passes is compared with the family's templates: they confirm
it where nearly all their word triples are in the passage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.llm.common import text_of
from basewise.session import materialize

#: Buckets of n-grams; bounds of the sample a model is fitted on: passages without a licence, documents they come from.
BUCKETS, OTHERS, SOURCES = 1 << 14, 4000, 500
#: Probability from which on a family is found, share of a template's word triples that confirms it, share of a template's
#: n-grams that keeps a passage out of the others. They hold at any size of table.
BAR, CONFIRM, ALIKE = 0.5, 0.8, 0.5
#: Words of a window, and from one window to the next.
WIDTH, STEP = 64, 32

# Public names of licence families.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "BSD": ["the BSD 3-Clause License", "the BSD 2-Clause License", "the BSD License", "BSD-3-Clause"],
    "ISC": ["the ISC License", "ISC"],
    "GPL": ["the GNU General Public License, version 3", "the GNU General Public License, version 2", "the GNU GPL v3", "GPL-3.0-or-later"],
    "LGPL": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License, version 3", "LGPL-2.1-or-later"],
    "AGPL": ["the GNU Affero General Public License, version 3", "AGPL-3.0-only"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License", "MPL-2.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "EPL-2.0"],
    "CC-BY": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC-BY-ND": ["CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"],
    "CC0": ["CC0 1.0", "the Creative Commons Zero v1.0 Universal dedication", "CC0-1.0"],
    "Unlicense": ["the Unlicense", "Unlicense"],
}
# Sentences in which licences are named.
FRAMES = [
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}.",
    "This program is free software distributed under {}.", "Available under {}.", "License: {}", "SPDX-License-Identifier: {}",
    "This file is subject to the terms of {}.", "See the LICENSE file for {}.",
]
# Sentences of the licence texts themselves.
SENTENCES = {
    "Apache-2.0": [
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,",
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": ["You should have received a copy of the GNU Lesser General Public License along with this library."],
    "AGPL": ["You should have received a copy of the GNU Affero General Public License along with this program."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
# Sentences of no licence, so that there is a class for them on any table.
NEUTRAL = [
    "The meeting starts at nine and ends before lunch.", "See the next chapter for an example of this method.", "All of the rooms in the house were painted white.",
    "The results of the second run are shown in the table.", "You may also send your answer by letter.", "This work took the group more than three years.",
    "The new version of the program starts faster.", "It is free for children under the age of six.",
]
FAMILIES = sorted(NAMES)
OTHER = float(len(FAMILIES))


@dataclass
class Model:
    """``slope`` and ``shift`` turn a margin into a probability; ``templates`` is a stored table of a few hundred fixed rows."""

    weights: LogisticRegressionModel
    slope: float
    shift: float
    templates: DataFrame


def words(column: Column) -> Column:
    return F.filter(F.split(F.lower(column), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _featured(df: DataFrame) -> DataFrame:
    """``features`` of ``words``: hashed words and word pairs."""
    before = F.slice("words", F.lit(1), F.greatest(F.lit(0), F.size("words") - 1))
    pairs = F.zip_with(before, F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(df.withColumn("grams", F.concat("words", pairs)))


def _grams(column: Column, n: int) -> Column:
    """Distinct runs of ``n`` words, or of all where there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(column) - (n - 1))), lambda i: F.array_join(F.slice(column, i, F.lit(n)), " "))
    return F.array_distinct(runs)


def templates(spark: SparkSession) -> DataFrame:
    """``family, words, grams, triples``: a few hundred fixed rows. A name of one word stands in a frame, others confirm alone."""
    rows = [(f, frame.format(n), len(n.split()) == 1) for f in FAMILIES for n in NAMES[f] for frame in FRAMES]
    rows += [(f, n, len(n.split()) > 1 or not n.isalpha()) for f in FAMILIES for n in NAMES[f]]
    rows += [(f, s, True) for f, own in SENTENCES.items() for s in own]
    # Literals, so that no Python takes part: a table made from Python objects would be read by Python on executors.
    made = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("sentence"), F.lit(c).alias("confirms")) for f, s, c in rows])
    one = spark.range(1, numPartitions=1).select(F.explode(made).alias("t")).select("t.family", words(F.col("t.sentence")).alias("words"), "t.confirms")
    pairs = NGram(n=2, inputCol="words", outputCol="word_pairs").transform(one)
    triples = F.when(F.col("confirms"), _grams(F.col("words"), 3))
    return pairs.select("family", "words", F.array_distinct(F.concat("words", "word_pairs")).alias("grams"), triples.alias("triples"))


def passages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id, paragraph, words`` of each passage; null counts as empty.

    Paragraphs are counted from 0 in the text, blank lines end them. Passages are the
    sentences of each line, and those of the paragraph that go over several lines; one of
    more than ``WIDTH`` words is cut into windows that overlap.
    """
    blocks = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
        F.posexplode(F.split(F.regexp_replace(text_of(text_col), "\r\n?", "\n"), "\n[ \t]*(?:\n[ \t]*)+")).alias("paragraph", "block"),
    )
    ends = "(?<=[.!?])\\s+"
    wrapped = F.filter(F.split("block", ends), lambda s: F.contains(s, F.lit("\n")))
    alone = F.flatten(F.transform(F.split("block", "\n"), lambda line: F.split(line, ends)))
    cut = blocks.select("row", "id", "paragraph", F.explode(F.concat(alone, wrapped)).alias("passage"))
    whole = cut.select("row", "id", "paragraph", words(F.col("passage")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("words") - WIDTH) / STEP)).cast("int"))
    windows = F.transform(starts, lambda i: F.slice("words", i * STEP + 1, F.lit(WIDTH)))
    return whole.select("row", "id", "paragraph", F.explode(F.when(F.size("words") <= WIDTH, F.array("words")).otherwise(windows)).alias("words")).filter(F.size("words") > 0)


def _margins(weights: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """``df`` with ``margins``: of each family over everything else.

    The scores are the variable of an outer lambda: a filter on the margins is pushed down
    with their whole expression, and a column named inside a lambda would then be hashed
    and scored once more for every family.
    """
    of = lambda raw: F.transform(F.slice(raw, 1, len(FAMILIES)), lambda r: r - raw[int(OTHER)])
    return weights.transform(df).withColumn("margins", F.transform(F.array(vector_to_array("rawPrediction")), of)[0])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the templates against up to OTHERS passages of SOURCES documents of ``df``, chosen by hash.

    Passages that resemble a template are left out of the others. A quarter of the
    others and of the templates is not fitted on and sets the probabilities. An empty
    table gives a model of the fixed sentences.
    """
    spark = df.sparkSession
    known = materialize(templates(spark), "templates")
    sources = df.select(F.col(f"`{id_col}`").alias("key")).distinct().orderBy(F.xxhash64("key"), "key").limit(SOURCES)
    # At most SOURCES keys are broadcast.
    some = df.join(F.broadcast(sources), F.col(f"`{id_col}`") == F.col("key"), "left_semi")
    others = passages(some, id_col, text_col).select("words").distinct().orderBy(F.xxhash64("words"), "words").limit(OTHERS)
    neutral = spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, NEUTRAL))).alias("s")).select(words(F.col("s")).alias("words"))
    others = materialize(_featured(others.union(neutral)).select("words", F.array_distinct("grams").alias("grams"), "features"), "others")
    template = known.select(F.monotonically_increasing_id().alias("t"), F.size("grams").alias("nt"), F.explode("grams").alias("gram"))
    shared = others.select("words", F.size("grams").alias("no"), F.explode("grams").alias("gram")).join(F.broadcast(template), "gram")
    alike = shared.groupBy("words", "no", "t", "nt").agg(F.count("*").alias("both")).filter(F.col("both") >= ALIKE * F.least(F.col("no"), F.col("nt")))
    others = materialize(others.join(alike, "words", "left_anti").select("words", "features"), "clean-others")
    number = F.create_map(*[x for i, f in enumerate(FAMILIES) for x in (F.lit(f), F.lit(float(i)))])
    rows = _featured(known.select("family", "words")).select("words", "features", number[F.col("family")].alias("label"), F.lit(1.0).alias("weight"))
    rows = rows.union(others.select("words", "features", F.lit(OTHER).alias("label"), F.lit(0.3).alias("weight")))
    rows = materialize(rows.withColumn("held", F.pmod(F.xxhash64("words", F.lit(1)), F.lit(4)) == 0).coalesce(2), "licence-rows")
    learner = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, weightCol="weight", standardization=False)
    judge = learner.fit(rows.filter(~F.col("held")))
    own = F.when(F.col("label") < OTHER, F.element_at("margins", F.least(F.col("label") + 1, F.lit(OTHER)).cast("int"))).otherwise(F.array_max("margins"))
    held = _margins(judge, rows.filter("held")).select(F.array(own).alias("margin"), (F.col("label") < OTHER).cast("double").alias("label"))
    held = materialize(held.select(array_to_vector("margin").alias("features"), "label"), "held-margins")
    scale = LogisticRegression(regParam=1e-3, standardization=False).fit(held)
    return Model(learner.fit(rows), float(scale.coefficients[0]), float(scale.intercept), known)


def scan(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, paragraph, family, probability, similarity, confirmed, passages`` for each paragraph and family found.

    A paragraph ends at a blank line; paragraphs are counted from 0. A family is found in
    a passage if its probability reaches the bar and it is the likeliest one there or a
    template confirms it, so one sentence may name several. ``probability`` and
    ``similarity`` (the share of a template's word triples that the passage holds) are the
    highest of its passages, ``passages`` their number. Null and empty texts, and texts
    without a licence, give no rows; repeated rows are rows of their own (``row`` tells
    them apart); other columns are never read.
    """
    scored = _margins(model.weights, _featured(passages(df, id_col, text_col)))
    chance = lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-(m * F.lit(model.slope) + F.lit(model.shift))))
    found = F.filter(
        F.transform("margins", lambda m, i: F.struct(i.alias("at"), chance(m).alias("probability"))), lambda c: c["probability"] >= F.lit(BAR)
    )
    hits = (
        scored.select("row", "id", "paragraph", "words", F.array_max("margins").alias("most"), "margins", found.alias("found")).filter(F.size("found") > 0)
        .select("row", "id", "paragraph", "words", "most", "margins", F.explode("found").alias("hit"))
        .select(
            "row", "id", "paragraph", "words", (F.element_at("margins", F.col("hit.at") + 1) == F.col("most")).alias("likeliest"),
            F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("hit.at") + 1).alias("family"), "hit.probability",
        )
    )
    # One row of templates a family: fixed and small.
    own = model.templates.filter("triples is not null").groupBy("family").agg(F.collect_set("triples").alias("templates"))
    sets = hits.withColumn("own", F.array_distinct(F.concat(_grams(F.col("words"), 3), _grams(F.col("words"), 2))))
    compared = sets.join(F.broadcast(own), "family").withColumn(
        "similarity", F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("own"))) / F.size(t)))
    )
    return (
        compared.withColumn("confirmed", F.col("similarity") >= CONFIRM).filter(F.col("likeliest") | F.col("confirmed"))
        .groupBy("row", "id", "paragraph", "family")
        .agg(
            F.max("probability").alias("probability"), F.max("similarity").alias("similarity"), F.count("*").alias("passages"),
            F.bool_or("confirmed").alias("confirmed"),
        )
    )
