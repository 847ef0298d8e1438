"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs are the lines of a text, and the blocks of lines that look wrapped:
neighbours of at most 132 characters, between blank or longer lines, with their
line breaks folded. The word one- and two-grams of the templates are
the features of a multinomial logistic regression. Its training rows are runs of
words from the templates of each family, and all different lines of the documents
that share no three words in a row with any template, which are the class of
everything else. Lines with the same features are one row with their number as
weight. By a hash, one half of the lines is trained on; a prediction
stands if its chance passes a cut that is set on the other half,
so that almost none of those pass; below the cut a paragraph is unknown. A
template of the predicted family then confirms it: the share of the template's
three-word runs that the paragraph holds. A block is reported if it is confirmed
and holds more of a template than any of its lines.

Null and empty texts have no paragraphs. Repeated rows stay repeated. Only
DataFrame functions and Spark ML are used.
"""

from __future__ import annotations

import math
import re

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise, spread

# Notices of each licence family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
}
OTHER = "none"
UNKNOWN = "unknown"
PASSING = 0.001
CONFIRMING = 0.5
WRAPPED = 132


def words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later steps read. Filters cannot pass a generator, so
    they do not work the value out again wherever they name it."""
    return df.withColumn(name, F.explode(F.array(value)))


def runs(w: Column, n: int) -> Column:
    """Distinct runs of ``n`` words; a shorter line is one run."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, n)))
    return F.when(F.size(w) > 0, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = docs.select(F.col(key).alias("doc_id"), F.posexplode(_lines(text)).alias("paragraph", "line"))
    return once(found, "words", words(F.col("line"))).filter(F.size("words") > 0)


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Wrapped lines put together: (doc_id, paragraph, line, words, parts), with
    the number of the first line and the lines themselves."""
    short = lambda x: (F.length(x) <= WRAPPED) & x.rlike(r"\S")
    lines = F.split(F.translate(F.col(text).cast("string"), "\x01\x02", "  "), r"\r?\n", -1)
    marked = F.transform(lines, lambda x, i: F.when(short(x), F.concat(i.cast("string"), F.lit("\x02"), x)).otherwise(F.lit("\x01")))
    found = docs.select(F.col(key).alias("doc_id"), F.explode(F.split(F.array_join(marked, "\n"), r"\n?\x01\n?")).alias("block")).filter(F.col("block").contains("\n"))
    cut = found.select("doc_id", F.substring_index("block", "\x02", 1).cast("int").alias("paragraph"),
                       F.transform(F.split("block", "\n"), lambda x: F.substring_index(x, "\x02", -1)).alias("parts"))
    folded = once(cut, "line", F.array_join("parts", " "))
    return once(folded, "words", words(F.col("line"))).filter(F.size("words") > 0).select("doc_id", "paragraph", "line", "words", "parts")


def similarity(own: Column, guess: Column) -> Column:
    """The largest share of the runs of a template of the family that are own."""
    shares = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            wanted = runs(words(F.lit(t)), 3)
            shares.append(F.when(guess == family, F.size(F.array_intersect(own, wanted)) / F.size(wanted)))
    return F.coalesce(F.greatest(*shares), F.lit(0.0))


def _lines(text: str) -> Column:
    return F.split(F.col(text).cast("string"), r"\r?\n", -1)


def _template_runs(n: int) -> list[str]:
    out = set()
    for texts in TEMPLATES.values():
        for t in texts:
            w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
            out |= {" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}
    return sorted(out)


# The fewest different pairs of words in a template's run of three.
_PAIRS_HELD = min(len({r.rsplit(" ", 1)[0], r.split(" ", 1)[-1]}) for r in _template_runs(3))


def shapers() -> list:
    """Stages from words to features: which one- and two-grams of the templates a
    paragraph holds. The number of features is that of the templates' grams."""
    known = lambda n, column, name: CountVectorizerModel.from_vocabulary(_template_runs(n), column, name, binary=True)
    return [NGram(n=2, inputCol="words", outputCol="pairs"), known(1, "words", "f1"), known(2, "pairs", "f2"),
            VectorAssembler(inputCols=["f1", "f2"], outputCol="features")]


def other_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(half, features, n): all different lines that hold no run of three words of
    a template, folded by their features."""
    lines = docs.select(F.explode(_lines(text)).alias("line")).filter(F.col("line").rlike(r"[\p{L}\p{N}]"))
    found = once(lines.select("line", F.xxhash64(F.lit(7), "line").alias("place")), "words", words(F.col("line"))).filter(F.size("words") > 0)
    shaped = PipelineModel(stages=shapers()).transform(found.select("place", "words"))
    # A run of three words holds two of the templates' pairs, so most lines go by that.
    held = F.size(F.array_remove(vector_to_array("f2"), 0.0))
    own = F.arrays_overlap(runs(F.col("words"), 3), F.array(*map(F.lit, _template_runs(3))))
    shaped = shaped.filter(F.when(held >= _PAIRS_HELD, ~own).otherwise(F.lit(True)))
    # Lines are told apart by their hashes, so that texts are not shuffled.
    different = shaped.select("place", "features").distinct()
    return different.groupBy(F.pmod("place", F.lit(2)).cast("int").alias("half"), "features").agg(F.count(F.lit(1)).alias("n"))


def passing_cut(scored: DataFrame) -> float:
    """The chance that the share ``PASSING`` of the lines (p, n) reaches."""
    total = scored.agg(F.sum("n")).first()[0] or 0
    if not total:
        return 0.5
    # At most that share of the lines lies above the cut, so the rest is left out.
    above = math.ceil(PASSING * total)
    top = scored.orderBy(F.desc("p")).limit(above)
    upto = F.sum("n").over(Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0))
    return float(top.withColumn("upto", upto).filter(F.col("upto") >= above).agg(F.max("p")).first()[0])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[PipelineModel, list[str], float]:
    """(model, classes, cut). Every line of the corpus is trained on or sets the
    cut; both halves weigh as many lines as they hold, and all families together
    as much as the other lines."""
    spark = docs.sparkSession
    classes = [OTHER, *sorted(TEMPLATES)]
    known = spark.createDataFrame([(f, t) for f in TEMPLATES for t in TEMPLATES[f]], "family string, line string").withColumn("words", words(F.col("line")))
    # Runs of at least three quarters of a template's words.
    n = F.size("words")
    shortest = F.ceil(n * F.lit(0.75)).cast("int")
    pieces = known.withColumn("long", F.explode(F.sequence(shortest, n))).withColumn("at", F.explode(F.sequence(F.lit(1), n - F.col("long") + 1))) \
        .select("family", F.slice("words", F.col("at"), F.col("long")).alias("words"))
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    positive = pieces.select(label.cast("double").alias("label"), "words")
    others = materialise(other_lines(docs, text), "licence-other")
    own, rest = (others.filter(F.col("half") == half) for half in (0, 1))
    weight = positive.groupBy("label").agg(F.count("*").alias("rows"))
    total = float(own.agg(F.sum("n")).first()[0] or 1)
    positive = positive.join(F.broadcast(weight), "label").select("label", "words", (F.lit(total / len(TEMPLATES)) / F.col("rows")).alias("weight"))
    stages = shapers()
    known = PipelineModel(stages=stages).transform(positive).select("label", "features", "weight")
    rows = known.unionByName(own.select(F.lit(0.0).alias("label"), "features", F.col("n").cast("double").alias("weight")))
    rows = spread(materialise(rows, "licence-training")).cache()
    learner = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", standardization=False,
                                 regParam=1e-4, maxIter=40, probabilityCol="chances", rawPredictionCol="raw", predictionCol="class")
    fitted = learner.fit(rows)
    rows.unpersist()
    cut = passing_cut(fitted.transform(rest).select((1 - F.get(vector_to_array("chances"), F.lit(0))).alias("p"), "n"))
    return PipelineModel(stages=[*stages, fitted]), classes, max(0.5, cut)


def scan(docs: DataFrame, model: PipelineModel, classes: list[str], cut: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph that is no ordinary line: (doc_id, paragraph, line,
    family, chance, similarity, confirmed). Predictions below the cut, and those
    that no template confirms, are of family ``unknown``; ``guess`` has the
    classifier's own answer."""
    single = paragraphs(docs, key, text).withColumn("parts", F.lit(None).cast("array<string>"))
    scored = model.transform(single.unionByName(blocks(docs, key, text)))
    at = F.col("class").cast("int")
    best = F.struct(at.alias("at"), F.get(vector_to_array("chances"), at).alias("chance"))
    scored = once(scored.select("doc_id", "paragraph", "line", "words", "parts", "class", "chances"), "best", best)
    licence = scored.filter("best.at > 0").select(
        "doc_id", "paragraph", "line", "words", "parts", F.get(F.array(*map(F.lit, classes)), F.col("best.at")).alias("guess"), F.col("best.chance").alias("chance"))
    licence = once(licence, "own", runs(F.col("words"), 3))
    out = once(licence, "similarity", similarity(F.col("own"), F.col("guess")))
    sure = (F.col("chance") >= cut) & (F.col("similarity") >= CONFIRMING)
    alone = F.array_max(F.transform("parts", lambda p: similarity(runs(words(p), 3), F.col("guess"))))
    out = out.filter(F.col("parts").isNull() | (sure & (alone < F.col("similarity"))))
    return out.filter((F.col("chance") >= cut) | (F.col("similarity") >= CONFIRMING)).select(
        "doc_id", "paragraph", "line", "guess", F.when(sure, F.col("guess")).otherwise(F.lit(UNKNOWN)).alias("family"), "chance", "similarity", sure.alias("confirmed"))
