"""License scans: a trained paragraph classifier in DataFrame and ``pyspark.ml`` operations.

* Paragraphs are lines, and runs of neighbouring lines, so that wrapped notices count: a run
  ends at a line without words, or where its inner lines hold as many words as the longest
  notice. Comment marks are no words. Their lower-cased words become 1- and 2-grams, hashed to sparse
  vectors; multinomial logistic regression over the licence families and ``unknown`` is
  trained on the notices below (with words left out, so that partial notices count) and
  on bounded samples of the corpus's other lines, with and without marking words.
* The unknown class is calibrated: half of the samples is held back, and the logits are
  divided by the temperature that fits it best; below ``MIN_PROBABILITY`` a paragraph is
  unknown.
* A predicted family is confirmed against its notices: at least ``MIN_SHARED`` of a
  notice's distinct word pairs stand in the paragraph. Of each notice, more than the rest of
  its pairs hold a marking word; so a paragraph without one can't be confirmed, and is not
  scored. Where that does not hold (a lower ``min_shared``) all paragraphs are scored.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES = 1 << 12
#: Documented bound of the corpus lines in the training table: as many with marking words, and as many without.
SAMPLE = 2000
MIN_PROBABILITY, MIN_SHARED = 0.5, 0.75
UNKNOWN = "unknown"
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)

# Short notices with which texts name a licence.
NOTICES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
                   "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
                "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2.",
                "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
                "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Licensed under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "SPDX-License-Identifier: ISC"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Licensed under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Marking words of the notices (MARKS inside words too, WHOLE only as words). Pairs without
# one are less than MIN_SHARED of each notice's (``unmarked``), so no paragraph without one is confirmed.
MARKS = ("license", "licensed", "licence", "spdx", "permission", "redistribution", "modification", "copyright", "unencumbered", "compliance",
         "granted", "gnu", "waived")
WHOLE = ("mit", "hereby", "obtaining", "modify", "foundation", "binary", "mozilla", "cc", "cc0", "extent", "domain")
MARKED = "|".join(MARKS) + r"|(?<![\p{L}\p{N}])(?:" + "|".join(WHOLE) + r")(?![\p{L}\p{N}])"
#: No notice has more words (tested).
LONGEST = 22


class Scanner(NamedTuple):
    pipeline: PipelineModel
    families: list[str]
    temperature: float


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits, dots inside numbers and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), 0)


def pairs_of(words: Column) -> Column:
    """Distinct neighbouring word pairs."""
    return F.array_distinct(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                                       lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))))


def _split(line: str) -> list[str]:
    """``words_of`` a notice, on the driver."""
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", line.lower())


def unmarked(words: list[str]) -> float:
    """Share of a notice's distinct word pairs that hold no marking word."""
    pairs = set(zip(words[:-1], words[1:], strict=True))
    return sum(not any(m in w for w in p for m in MARKS) and not set(p) & set(WHOLE) for p in pairs) / len(pairs)


def marked(c: Column) -> Column:
    return F.lower(c).rlike(MARKED)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """(id, row, paragraph, until, words): the lines and runs of lines that hold a marking word, or all.

    ``paragraph`` and ``until`` are the first and last line, counted from 0; ``row`` tells the rows of ``docs`` apart."""
    has = (lambda c: F.lit(True)) if every else marked
    rows = docs.where(has(F.col(text_col))).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                                                   F.split(F.col(text_col), "\n").alias("lines"))
    # each line is cut into words once: the generated row keeps the expression out of the windows below
    rows = rows.select("id", "row", F.explode(F.array(F.struct(F.transform("lines", has).alias("has"), F.transform("lines", words_of).alias("lines")))).alias("d"))
    rows = rows.select("id", "row", "d.has", "d.lines")
    # a start: a line such that it or one of the LONGEST after it has a mark
    starts = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.exists(F.slice("has", i, LONGEST + 1), lambda x: x))
    windows = rows.select("id", "row", F.explode(F.transform(starts, lambda i: F.struct(
        (i - 1).alias("paragraph"), F.slice("lines", i, LONGEST + 1).alias("lines"), F.slice("has", i, LONGEST + 1).alias("has")))).alias("w"))
    words = windows.select("id", "row", "w.paragraph", "w.has", "w.lines")
    inner = lambda k: F.aggregate(F.slice("lines", F.lit(2), F.greatest(k - 2, F.lit(0))), F.lit(0), lambda a, x: a + F.size(x))
    whole = lambda k: F.forall(F.slice("lines", F.lit(1), k), lambda x: F.size(x) > 0)
    found = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda k: F.exists(F.slice("has", F.lit(1), k), lambda x: x)
                     & ((k == 1) | (whole(k) & (inner(k) < LONGEST - 1))))
    runs = words.select("id", "row", "paragraph", F.explode(F.transform(found, lambda k: F.struct(
        k.alias("k"), F.flatten(F.slice("lines", F.lit(1), k)).alias("words")))).alias("r"))
    return runs.select("id", "row", F.col("paragraph"), (F.col("paragraph") + F.col("r.k") - 1).alias("until"), F.col("r.words").alias("words"))


def _notices(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """(family, distinct word pairs) of each notice."""
    notices = spark.createDataFrame([(f, n) for f, ns in NOTICES.items() for n in ns], "family string, line string")
    return [(r.family, r.pairs) for r in notices.select(
        "family", F.filter(pairs_of(words_of(F.col("line"))), lambda x: x.isNotNull()).alias("pairs")).collect()]


def _share(pairs: str, notices: list[list[str]]) -> Column:
    """The largest share of a notice's pairs that stand in ``pairs``."""
    return F.greatest(F.lit(0.0), *[F.size(F.array_intersect(pairs, F.array(*map(F.lit, x)))) / F.lit(float(len(x))) for x in notices])


def _without(words: str, every: int, at: int) -> Column:
    return F.filter(words, lambda _, i: i % every != at)


def training_table(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(family, words, held): whole and shortened notices, and ordinary paragraphs of the corpus.

    The corpus samples are the first lines without a mark of the documents with the smallest
    text hashes, and the lines with a mark, but less than half of any notice's word pairs,
    with the smallest hashes; ``sample`` of each at most."""
    spark = docs.sparkSession
    notices = spark.createDataFrame([(f, n) for f, ns in NOTICES.items() for n in ns], "family string, line string")
    whole = notices.select("family", words_of(F.col("line")).alias("words"))
    # copies that leave out every k-th word, or the first or last words
    copies = whole.select("family", F.explode(F.array(
        F.col("words"),
        *[_without("words", 7, k) for k in range(7)],
        F.slice("words", 2, 1000), F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(1))))).alias("words"))
    texts = docs.where(F.col(text_col).isNotNull())
    n = texts.count()
    # a hash this small is expected for twice the sample, so that tasks don't send as many rows each
    small = lambda h, rows: (h / F.lit(2.0**64) + 0.5) * rows < 2 * sample + 100
    ordinary = (texts.select(F.xxhash64(text_col).alias("h"), F.substring_index(F.col(text_col), "\n", 1).alias("line"))
                .where(small(F.col("h"), n) & ~marked(F.col("line"))).select("h", F.slice(words_of(F.col("line")), 1, 60).alias("words"))
                .orderBy("h", "words").limit(sample))
    lines = (docs.where(marked(F.col(text_col))).select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).where(marked(F.col("line")))
             .select(F.slice(words_of(F.col("line")), 1, 60).alias("words")).distinct().withColumn("pairs", pairs_of(F.col("words"))))
    near = (lines.where(_share("pairs", [p for _, p in _notices(spark)]) < 0.5).select(F.xxhash64("words").alias("h"), "words")
            .orderBy("h", "words").limit(sample))
    return (copies.select("family", "words", F.lit(False).alias("held"))
            .union(ordinary.union(near).select(F.lit(UNKNOWN), "words", F.col("h") % 2 == 0))
            .union(whole.select("family", _without("words", 5, 3), F.lit(True)))
            .union(spark.createDataFrame([(UNKNOWN, w.split(), h) for w in ("", "license", "the license", "permission", "all rights reserved copyright",
                                                                            "licensed", "granted", "a license plate", "gnu") for h in (False, True)],
                                         "family string, words array<string>, held boolean")))


def _featurised(df: DataFrame) -> PipelineModel:
    from pyspark.ml import Pipeline

    return Pipeline(stages=[NGram(n=2, inputCol="words", outputCol="_two"),
                            HashingTF(numFeatures=FEATURES, binary=True, inputCol="words", outputCol="_f1"),
                            HashingTF(numFeatures=FEATURES, binary=True, inputCol="_two", outputCol="_f2"),
                            VectorAssembler(inputCols=["_f1", "_f2"], outputCol="features")]).fit(df)


def _probabilities(logits: Column, temperature: Column | float) -> Column:
    scaled = F.transform(logits, lambda x: x / temperature)
    top = F.array_max(scaled)
    weights = F.transform(scaled, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Scanner:
    """Fit on the training table's first half, calibrate on the other. Works on an empty corpus."""
    families = [*NOTICES, UNKNOWN]
    number = F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, float(i))])
    table = training_table(docs, text_col, sample).withColumn("label", number[F.col("family")])
    # few rows: one written copy serves the fit and the calibration
    from rarebird.session import materialize

    table = materialize(table, "licences").coalesce(1)
    features = _featurised(table)
    rows = features.transform(table)
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=30).fit(rows.where("not held"))
    # the temperature with the least log loss on the held-back half
    scored = model.transform(rows.where("held")).select("label", vector_to_array("rawPrediction").alias("z"))
    loss = [F.avg(-F.log(F.element_at(_probabilities(F.col("z"), t), F.col("label").cast("int") + 1) + F.lit(1e-12))).alias(str(i))
            for i, t in enumerate(TEMPERATURES)]
    losses = scored.agg(*loss).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: losses[i] if losses[i] is not None else float("inf"))
    return Scanner(PipelineModel([*features.stages, model]), families, TEMPERATURES[best])


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text",
         min_probability: float = MIN_PROBABILITY, min_shared: float = MIN_SHARED) -> DataFrame:
    """(id, paragraph, family, probability, shared): the paragraphs that name a licence.

    ``paragraph`` is a notice's first line; a run of lines counts where no shorter one inside
    it names the same licence. Null and empty texts have none; null or repeated ids keep their
    rows; a line of any length is one paragraph; equally probable families go by their order. An empty table
    gives an empty result. Other columns are not read.
    """
    templates = _notices(docs.sparkSession)
    every = any(unmarked(_split(n)) >= min_shared for ns in NOTICES.values() for n in ns)
    runs = paragraphs(docs, id_col, text_col, every).select("id", "row", "paragraph", "until", "words", F.explode(F.array(pairs_of(F.col("words")))).alias("pairs"))
    # what can't share enough pairs with any notice of any family is not scored: first by pairs that some notice has
    known = F.array(*[F.lit(x) for x in sorted({x for _, p in templates for x in p})])
    fewest = min(math.ceil(min_shared * len(p) - 1e-9) for _, p in templates)
    runs = runs.where(F.size(F.array_intersect("pairs", known)) >= fewest).where(_share("pairs", [p for _, p in templates]) >= min_shared)
    scored = scanner.pipeline.transform(runs.drop("pairs"))
    p = _probabilities(vector_to_array("rawPrediction"), scanner.temperature)
    place = ["id", "row", "paragraph", "until"]
    guessed = scored.select(*place, "words", p.alias("p")).select(
        *place, F.array_max("p").alias("probability"),
        F.element_at(F.array(*[F.lit(f) for f in scanner.families]), F.array_position("p", F.array_max("p")).cast("int")).alias("family"),
        pairs_of(F.col("words")).alias("pairs"))
    share = F.lit(0.0)
    for family in NOTICES:
        share = F.when(F.col("family") == family, _share("pairs", [p for f, p in templates if f == family])).otherwise(share)
    kept = guessed.where((F.col("family") != UNKNOWN) & (F.col("probability") >= min_probability)).withColumn("shared", share)
    kept = kept.where(F.col("shared") >= min_shared)
    # of a document's runs: the shortest from each line, and none that holds a later one
    same = Window.partitionBy("row", "family")
    later = same.orderBy(F.col("paragraph").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = (kept.withColumn("r", F.row_number().over(Window.partitionBy("row", "family", "paragraph").orderBy("until"))).where("r = 1")
            .withColumn("inside", F.min("until").over(later)).where("inside is null or inside > until"))
    return kept.select(F.col("id").alias(id_col), "paragraph", "family", F.round("probability", 6).alias("probability"), "shared")
