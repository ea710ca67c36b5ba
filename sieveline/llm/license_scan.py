"""License scans: a trained paragraph classifier, confirmed by template comparison; DataFrame and ML functions only."""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UNKNOWN = "unknown"
#: Fixed: common notices and names of well-known licence families.
TEMPLATES = {
    "agpl-3.0": ("This program is licensed under the GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPL-3.0", "AGPL v3", "AGPLv3"),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License", "Apache License",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Released under the BSD License", "BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD 3-Clause License", "BSD 2-Clause License",
    ),
    "boost": ("Distributed under the Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "Licensed under CC BY 4.0", "CC BY 4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0", "Licensed under CC BY-NC 4.0", "CC BY-NC 4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "Licensed under CC BY-SA 4.0", "CC BY-SA 4.0"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "CC0 1.0 Universal", "CC0-1.0", "CC0 1.0"),
    "epl-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License", "EPL-2.0"),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2", "GNU General Public License version 2", "either version 2 of the License, or any later version", "GPL-2.0", "GPL v2", "GPL version 2", "GPLv2"),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "GNU General Public License version 3", "GPL-3.0", "GPL v3", "GPL version 3", "GPLv3",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "ISC License"),
    "lgpl": ("Licensed under the GNU Lesser General Public License", "GNU Lesser General Public License", "GNU LGPL", "LGPL-2.1", "LGPL-3.0", "LGPL v2.1", "LGPL v3"),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability",
        "Released under the MIT License", "MIT License", "MIT Licence", "MIT licensed", "License: MIT", "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License", "MPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "The Unlicense"),
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "zlib License"),
    "proprietary": ("All rights reserved", "Confidential and proprietary", "Unauthorized copying is prohibited", "proprietary and confidential"),
}
#: A denial, within a sentence, that something is licensed.
DENIED = r"(?i)(?:\bnot|\bnever|\bno longer|n't)\b(?:\W+\w+){0,3}?\W+(?:licen[cs]ed|released|distributed|published|available|covered|under)\b"
#: Words that say little; see _telling.
_COMMON = frozenset("a all and any as by from in is it of or out the this to under with without you may not use work can be".split())
#: Most lines that a notice is looked for in.
_JOINED = 8
#: What stands around notices in the training rows, and sentences that are none.
_AROUND = ("{}", "{}.", "This file is {}", "Note: {}", "# {}", "The text is {} as published", "distributed under the terms of the {} as published", "{} or later", "see {} for details", "Copyright 2020 Example. {}", "Project number one is under {} and comes as is", "{} applies to the code of this repository")
_OTHER = (
    "The committee granted permission for the meeting.", "Human rights were discussed at length.", "The warranty covers two years.", "She has a driving licence.", "They may redistribute the seats.",
    "A copyright dispute ended today.", "No parking is permitted here.", "The license plate was missing.", "The apache helicopter landed at noon.", "General practice is open to the public.",
    "All rights of passage were reserved for kings.", "The source of the river is in the hills.", "A creative person and a work of art.", "The commons debated the attribution of the funds.", "The software was free of charge for any person.",
    "Version 2.0 of the engine is faster.", "Files are copied under the following conditions.", "The foundation published the terms of its grant.", "A confidential letter arrived.", "Copying from neighbours is prohibited at school.",
    "The old mill stood by the river and all the people of the town came to use it.", "It is not known when they will be met with or without the others.",
)
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def words_of(text: Column) -> Column:
    """Lower-case words of letters, digits and inner dots."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _grams(words: Column) -> Column:
    """Distinct runs of one and two words."""
    n = F.size(words)
    pairs = F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def _with_grams(rows: DataFrame) -> DataFrame:
    """Rows with the grams of their paragraph; explode keeps the optimizer from computing words again for each use."""
    d = rows.withColumn("_words", F.explode(F.array(words_of(F.col("paragraph")))))
    return d.withColumn("grams", F.explode(F.array(_grams(F.col("_words"))))).drop("_words")


def _split(template: str) -> list[str]:
    return re.findall(_WORD, template.lower())


def _ordered(template: str) -> list[str]:
    """The pairs of neighbouring words that confirm a template; a single word confirms itself."""
    w = _split(template)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}) or w


@dataclass
class LicenseModel:
    """A sparse multinomial logistic regression over word n-grams, with the least probability of a known family, and the templates
    that confirm each family."""

    vectors: CountVectorizerModel
    regression: LogisticRegressionModel
    families: list[str]
    templates: dict[str, tuple[str, ...]]
    least: float
    confirm: float

    @property
    def holds(self) -> str:
        """A pattern of the words of which a text must hold one for any template to be confirmed.

        These are as many of each template's words, rare ones first, as no text may lack: each missing word costs a pair.
        """
        out = set()
        for t in (t for ts in self.templates.values() for t in ts):
            bag = sorted(set(_split(t)), key=lambda w: (w in _COMMON, -len(w), w))
            out.update(bag[: math.floor(len(bag) * (1 - self.confirm) + 1e-9) + 1])
        return "(?i)(?<![a-z0-9])(?:" + "|".join(w.replace(".", "[.]") for w in sorted(out)) + ")(?![a-z0-9])"


def examples(templates: dict[str, tuple[str, ...]], seed: int = 0) -> list[tuple[str, str]]:
    """(family, paragraph) to train and calibrate on: templates in sentences, whole or with words lost, against sentences about
    other things, fragments of templates and templates with their words in another order."""
    rng, out = random.Random(seed), []
    orders = [set(_ordered(t)) for ts in templates.values() for t in ts]

    def other(text: str) -> None:
        mine = set(_ordered(text)) | set(_split(text))
        if all(len(o & mine) < 0.6 * len(o) for o in orders):  # a part of one template can be another
            out.append((UNKNOWN, text))

    for name in sorted(templates):
        for t in templates[name]:
            words = t.split()
            out += [(name, a.format(t)) for a in _AROUND]
            if len(words) > 8:
                out += [(name, " ".join(w for k, w in enumerate(words) if k % 9 != i)) for i in range(9)]
                out += [(name, f"{o} {t} {o}") for o in _OTHER[::4]]
            for _ in range(3):
                lost = words[:]
                rng.shuffle(lost)
                other(" ".join(lost))
            for i in range(0, len(words) if len(words) > 3 else 0, 4):
                other(" ".join(words[i : i + max(1, len(words) // 3)]))
    for o in _OTHER:
        out += [(UNKNOWN, o)] * 8 + [(UNKNOWN, f"{o} {rng.choice(_OTHER)}") for _ in range(8)]
    return out


def train(spark: SparkSession, templates: dict[str, tuple[str, ...]] = TEMPLATES, confirm: float = 0.6, false_rate: float = 0.01, loss_rate: float = 0.01) -> LicenseModel:
    """Fit on examples of the templates; every fifth is held out.

    The held-out ones calibrate the least probability of a known family: the least from 0.5 on at which at most `false_rate` of
    the unknown would pass for a family (template comparison comes on top), or else where `loss_rate` of the known are lost. No corpus text takes part, so a corpus whose
    notices have a wording of their own doesn't teach the model to refuse them.
    """
    families = [*sorted(templates), UNKNOWN]
    rows = [(float(families.index(name)), k % 5 == 4, text) for k, (name, text) in enumerate(examples(templates))]
    data = _with_grams(spark.createDataFrame(rows, "label double, held boolean, paragraph string").coalesce(1)).cache()
    vocabulary = sorted({g for ts in templates.values() for t in ts for g in (*_split(t), *(f"{a} {b}" for a, b in zip(_split(t), _split(t)[1:], strict=False)))})
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setMinTF(1)
    fit = LogisticRegression(regParam=2e-4, elasticNetParam=0.2, maxIter=60, family="multinomial", standardization=False)
    regression = fit.fit(vectors.transform(data.where("not held")))
    guess = regression.transform(vectors.transform(data.where("held"))).select("label", "prediction", F.array_max(vector_to_array("probability")).alias("p")).collect()
    data.unpersist()
    last = len(families) - 1
    false = sorted((r["p"] if r["prediction"] != last else 0.0 for r in guess if r["label"] == last), reverse=True)
    right = sorted(r["p"] for r in guess if r["label"] == r["prediction"] != last)
    least = max(0.5, min(false[math.floor(false_rate * len(false))], right[math.floor(loss_rate * len(right))]) if false and right else 0.5)
    return LicenseModel(vectors, regression, families, {k: tuple(v) for k, v in templates.items()}, least, confirm)


def paragraphs(docs: DataFrame, holds: str) -> DataFrame:
    """Rows at, last and paragraph: each line of `text` that has one of the words, and the run of up to 8 lines, ended by a blank
    one, that begins with it, for notices wrapped over several. Other columns stay."""
    others = [c for c in docs.columns if c != "text"]
    lines = docs.where(F.regexp_like("text", F.lit(holds))).select(*others, F.split("text", r"\r\n|\n|\r").alias("_lines"))
    # Elements are taken one by one, since a slice inside a lambda copies the whole array.
    runs = F.transform(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.when(F.regexp_like(F.get("_lines", i), F.lit(holds)), F.array(*[F.get("_lines", i + k) for k in range(_JOINED)])))
    runs = lines.select(*others, F.posexplode(runs).alias("at", "_w")).where("_w is not null")
    blank = F.array_position(F.transform("_w", lambda x: F.coalesce(~F.regexp_like(x, F.lit("[A-Za-z0-9]")), F.lit(True))), F.lit(True)).cast("int")
    runs = runs.withColumn("_n", F.when(blank > 0, blank - 1).otherwise(_JOINED))
    unit = lambda n, text: F.struct((F.col("at") + n - 1).alias("last"), text.alias("paragraph"))
    both = F.array(unit(F.lit(1), F.get("_w", F.lit(0))), F.when(F.col("_n") > 1, unit(F.col("_n"), F.concat_ws(" ", F.slice("_w", F.lit(1), F.col("_n"))))))
    return runs.select(*others, "at", F.explode(both).alias("_u")).where("_u is not null").select(*others, "at", "_u.last", "_u.paragraph")


def classify(rows: DataFrame, model: LicenseModel) -> DataFrame:
    """Add family, probability and match to rows with a paragraph.

    A family is unknown unless its probability reaches the calibrated least and one of its templates is confirmed: match, the
    greatest share of a template's pairs of neighbouring words that the paragraph has, is at least the model's `confirm`. A paragraph
    that denies to be licensed (see DENIED) is unknown.
    """
    d = model.regression.transform(model.vectors.transform(_with_grams(rows)))
    probability, names = vector_to_array(F.col("probability")), F.array(*map(F.lit, model.families))
    pairs = [[F.array(*map(F.lit, _ordered(t))) for t in model.templates.get(f, ())] for f in model.families]
    k = F.col("prediction").cast("int")
    mine = F.get(F.array(*[F.array(*p) if p else F.array().cast("array<array<string>>") for p in pairs]), k)
    match = F.coalesce(F.array_max(F.transform(mine, lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t))), F.lit(0.0))
    d = d.select(*rows.columns, F.get(names, k).alias("guess"), F.get(probability, k).alias("probability"), match.alias("match"))
    sure = (F.col("guess") != UNKNOWN) & (F.col("probability") >= model.least) & (F.col("match") >= model.confirm) & ~F.regexp_like("paragraph", F.lit(DENIED))
    return d.select(*rows.columns, F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "match")


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, licenses (the families found, sorted), n_paragraphs, n_unknown.

    Every line that may hold enough of a template is scored, and so is the run of lines that begins with it, for notices wrapped
    over several. A run counts if no line of it is known by itself, and no overlapping run matches another family better.
    n_paragraphs counts the lines scored; n_unknown those that are neither known nor part of a run that is. Null and empty
    texts have none. A model of TEMPLATES is trained if none is given. Rows that repeat an id, or whose id is null, share what is
    found in any of them. Other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = model or train(docs.sparkSession)
    found = classify(paragraphs(d.withColumn("row", F.xxhash64("text")), model.holds), model)
    line = lambda x: x["at"] == x["last"]
    calls = found.where((F.col("at") == F.col("last")) | (F.col("family") != UNKNOWN)).groupBy("doc_id").agg(F.collect_list(F.struct("row", "at", "last", "family", "match")).alias("calls"))
    meets = lambda x, y: (x["row"] == y["row"]) & (x["at"] <= y["last"]) & (y["at"] <= x["last"])
    calls = calls.withColumn("known", F.filter("calls", lambda x: line(x) & (x["family"] != UNKNOWN)))
    calls = calls.withColumn("runs", F.filter("calls", lambda x: ~line(x) & ~F.exists("known", lambda y: meets(x, y))))
    calls = calls.withColumn("runs", F.filter("runs", lambda x: ~F.exists("runs", lambda y: meets(x, y) & (y["family"] != x["family"]) & (y["match"] > x["match"]))))
    sums = calls.select(
        F.col("doc_id").alias("_id"),
        F.array_sort(F.array_distinct(F.transform(F.concat("known", "runs"), lambda x: x["family"]))).alias("licenses"),
        F.size(F.filter("calls", line)).cast("long").alias("n_paragraphs"),
        F.size(F.filter("calls", lambda x: line(x) & (x["family"] == UNKNOWN) & ~F.exists("runs", lambda y: meets(x, y)))).cast("long").alias("n_unknown"),
    )
    out = d.select("doc_id").join(sums, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))
