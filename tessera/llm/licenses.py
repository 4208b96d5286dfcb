"""Licence scan: a trained paragraph classifier, confirmed against templates; DataFrame operations only on the data.

A paragraph is a line of a text, with the lines after it for as long as lines are wrapped: at WRAPPED characters or more and not at the end of a
sentence. The model is asked about every paragraph of every text. It knows nothing but word n-grams of one to three words of its notices, so a paragraph counts by
the set of those that it has (none: the bias alone), and each distinct set is scored once, by a join to the model's weights (a table of
bounded size: one row per n-gram). All words of an n-gram of the model are n-grams of the model themselves, so n-grams are only
made of runs of such words; this loses none. The softmax has a class for text that is no licence; its temperature is fitted on held-out paragraphs, and a
family is only reported from a probability of MIN_PROBABILITY on; paragraphs under it are reported as unknown. A prediction is confirmed if
enough of the paragraph's or the template's word pairs agree with a template of that family.

The model is fitted in numpy on the driver, from the templates below and variants of them: no rows of the input are used.

Defined results: a null text counts as empty, and an empty text or line is a paragraph without words, which is unknown; very long texts are read whole; repeated rows each get their findings; of families that
tie in probability and similarity the last by name is a row's family; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Notices by which each family is usually declared.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: What the families are called, and how notices name them.
NAMES = {
    "apache-2.0": ("Apache License 2.0", "Apache-2.0", "Apache 2.0 license"),
    "mit": ("MIT License", "MIT"),
    "gpl": ("GNU General Public License", "GNU GPL", "GPLv3"),
    "lgpl": ("GNU Lesser General Public License", "LGPL"),
    "agpl": ("GNU Affero General Public License", "AGPL"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD-2-Clause"),
    "mpl-2.0": ("Mozilla Public License", "MPL 2.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial license", "CC BY-NC", "CC-BY-NC-4.0"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike license", "CC BY-SA", "CC-BY-SA-4.0"),
    "cc-by": ("Creative Commons Attribution license", "CC BY", "CC-BY-4.0"),
    "unlicense": ("Unlicense",),
}
FRAMES = ("Licensed under the {}.", "Released under {}.", "License: {}", "This project is {} licensed.", "See the {} for details.", "Distributed under the terms of the {}.", "The code is available under the {}.")
#: Paragraphs with licence words that declare none of the families.
OTHERS = (
    "All rights reserved. No part of this publication may be reproduced without permission of the publisher.",
    "He lost his driving licence in March and applied for a new one.",
    "Permission to enter the building was granted by the office.",
    "The committee discussed which license to choose, but did not decide.",
    "Copyright 2019 by the authors.",
    "The warranty covers parts and labour for two years.",
    "Please read the license agreement before you install the product.",
    "The Apache helicopter flew over the MIT campus.",
    "The library is open to the general public, version two of the plan said.",
    "A fishing license costs twenty dollars in this state.",
    "You may not copy, modify or distribute this content without a commercial license.",
    "Your license key has been sent by mail.",
    "The software is provided as is.",
    "Terms of use and privacy policy apply.",
    "The report was published under the direction of the general secretary.",
    "This version of the program is available to the public free of charge at the library.",
    "Members are permitted to use the source of the river for their work.",
    "The works of the foundation are common to all, and the conditions are met by the project.",
    "International attribution of the painting is open, the school of commons and creative arts said.",
    "Version 2.0 of the product supports 3 lines and 4.0 inches.",
    "The public domain of the king had no software and no warranties of any kind.",
    "You may obtain a copy of the file at the office in compliance with the agreement.",
    "Distributed in the hope that it will be useful, the leaflet lists the terms of the lease.",
    "Under the license of the mayor the market may be held twice a year.",
    "See the manual for details.",
    "MIT researchers presented a study of the brain.",
    "The BSD society and the GNU herd were seen at the lake.",
    "He met the CC chairman and a Mozilla employee.",
    "The data are available under the link below.",
    "Distributed under the terms of the treaty.",
    "License: none needed for this work.",
    "Er kam mit dem Zug nach Hause.",
    "Sie sprach mit der Nachbarin.",
    "Mit Milch und Zucker.",
    "Ein Haus mit Garten, mit einer Mauer und mit zwei Toren.",
    "Das Kind spielt mit.",
    "Mit freundlichen Grüßen",
)
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
#: A line of so many characters that does not end a sentence goes on in the next.
WRAPPED = 40
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.5
#: Possessive, so that no word is too long for Java's stack.
_TOKEN = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"
NGRAM = 3
#: Paragraphs whose places are counted up at once.
BLOCK = 1024


def _tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def _grams(tokens: list[str]) -> list[str]:
    return [" ".join(tokens[i : i + n]) for n in range(1, NGRAM + 1) for i in range(len(tokens) - n + 1)]


def _wordings(family: str) -> tuple[str, ...]:
    """The notices of a family, or of none."""
    return (*TEMPLATES.get(family, OTHERS), *(f.format(n) for n in NAMES.get(family, ()) for f in FRAMES))


def _examples(seed: int) -> list[tuple[list[str], int]]:
    """Templates and others, whole, cut, with words lost, and inside other words."""
    rng = np.random.default_rng(seed)
    filler = "the of and in to document report page value table section note first part was is are with this that data system".split()
    out = []
    for label, family in enumerate(FAMILIES):
        for text in _wordings(family):
            t = _tokens(text)
            out.append((t, label))
            whole = text in TEMPLATES.get(family, OTHERS)
            for _ in range(12 if whole else 3):
                kept = [w for w in t if not whole or rng.random() > 0.08]
                around = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 30))]
                at = int(rng.integers(0, len(around) + 1))
                out.append((around[:at] + kept + around[at:], label))
    for _ in range(200):
        out.append(([filler[i] for i in rng.integers(0, len(filler), rng.integers(1, 60))] + ["license"] * int(rng.integers(0, 2)), len(FAMILIES) - 1))
    return out


@lru_cache(maxsize=1)
def fit() -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """(weights per n-gram, bias, temperature): multinomial logistic regression on whether an n-gram occurs, with an L2 penalty."""
    train, held = _examples(1), _examples(2)
    vocabulary = {g: i for i, g in enumerate(sorted({g for f in FAMILIES for t in _wordings(f) for g in _grams(_tokens(t))}))}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary)))
        for r, (tokens, _) in enumerate(rows):
            for g in set(_grams(tokens)):
                if g in vocabulary:
                    x[r, vocabulary[g]] = 1.0
        return x, np.array([y for _, y in rows])

    x, y = matrix(train)
    w, b = np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES))
    target = np.eye(len(FAMILIES))[y]
    rate = 4.0 / np.mean((x**2).sum(axis=1))
    for _ in range(400):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) / len(y)
        w -= rate * (x.T @ error + 1e-4 * w)
        b -= rate * error.sum(axis=0)
    hx, hy = matrix(held)
    z = hx @ w + b

    def loss(t: float) -> float:
        s = z / t
        return float(np.mean(np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(hy)), hy]))

    temperature = min(np.linspace(0.2, 3.0, 57), key=loss)
    return {g: w[i] for g, i in vocabulary.items()}, b, float(temperature)


def held_out_accuracy() -> float:
    """Share of held-out variants that get their family."""
    weights, bias, _ = fit()
    rows = _examples(3)
    right = sum(int(np.argmax(bias + sum((weights[g] for g in set(_grams(t)) if g in weights), np.zeros(len(FAMILIES))))) == y for t, y in rows)
    return right / len(rows)


def _model_table(spark: SparkSession) -> DataFrame:
    weights, _, _ = fit()
    return spark.createDataFrame([(g, [float(x) for x in w]) for g, w in weights.items()], "gram string, weights array<double>")


def _template_table(spark: SparkSession) -> DataFrame:
    rows = []
    for family in TEMPLATES:
        for k, text in enumerate(_wordings(family)):
            t = _tokens(text)
            pairs = sorted({" ".join(t[i : i + 2]) for i in range(max(1, len(t) - 1))})
            rows += [(p, family, k, len(pairs)) for p in pairs]
    return spark.createDataFrame(rows, "gram string, family string, template int, size int")


def _starts(lengths: Column, at: Column) -> Column:
    """For each length the sum of those before it, from ``at`` on."""
    nothing = F.struct(at.alias("at"), F.expr("cast(array() AS array<int>)").alias("out"))
    return F.aggregate(lengths, nothing, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def _listed(words: set[str]) -> str:
    """Words or n-grams as a list of SQL; they have no quotes."""
    return ", ".join(f"'{w}'" for w in sorted(words))


def _ngrams(kept: str, n: int) -> Column:
    """Runs of n words with one blank between them, overlapping ones too."""
    return F.regexp_extract_all(kept, F.lit(rf"(?<![^ ])(?=({' '.join(['[^ ]++'] * n)}))"), F.lit(1))


def judge_paragraphs(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph of every text: row_tag, doc_id, line (its number in the text), start, end (code points), evidence (how many n-grams of the model it has), family (or unknown), probability, similarity, confirmed."""
    spark = docs.sparkSession
    weights, bias, temperature = fit()
    vocabulary = set(weights)
    words = {g for g in vocabulary if " " not in g}
    tagged = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row_tag"))
    # Cut at line feeds but those of wrapped lines; each cut takes one character, so lengths add up to places, in blocks: a fold over all would copy its result for each.
    # The line feed is looked for first: it is rarer than what may stand before it.
    cut = tagged.select("doc_id", "row_tag", F.split("text", rf"\n(?<![^\n]{{{WRAPPED - 1}}}[^\n.!?:;]\n)", -1).alias("bodies"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("bodies") - 1) / BLOCK).cast("int")), lambda b: F.transform(F.slice("bodies", b * BLOCK + 1, BLOCK), lambda x: F.length(x) + 1))
    cut = cut.withColumn("blocks", blocks)
    totals = F.transform("blocks", lambda ns: F.aggregate(ns, F.lit(0), lambda a, n: a + n))
    starts = F.flatten(F.zip_with("blocks", _starts(totals, F.lit(0)), _starts))
    lines = cut.select("doc_id", "row_tag", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("bodies").alias("body"))).alias("line", "p")).select("doc_id", "row_tag", "line", "p.*")
    # Words that the model does not know become gaps of two blanks or more between runs of those it knows.
    tokens = F.regexp_extract_all(F.lower("body"), F.lit(_TOKEN), F.lit(0))
    lines = lines.select("doc_id", "row_tag", "line", "start", (F.col("start") + F.length("body")).alias("end"), tokens.alias("tokens"))
    kept = F.expr(f"array_join(transform(tokens, t -> if(t IN ({_listed(words)}), t, '')), ' ')")
    lines = lines.select("doc_id", "row_tag", "line", "start", "end", F.size("tokens").alias("n"), kept.alias("kept"))
    lines = lines.withColumn("grams", F.array_distinct(F.concat(*(_ngrams("kept", n) for n in range(1, NGRAM + 1)))))
    lines = lines.withColumn("grams", F.sort_array(F.expr(f"filter(grams, g -> g IN ({_listed(vocabulary)}))")))
    # The number of words only matters to the share of word pairs.
    own = F.when(F.exists("grams", lambda g: g.contains(" ")), F.col("n") - 1).otherwise(0)
    lines = lines.select("doc_id", "row_tag", "line", "start", "end", F.size("grams").alias("evidence"), own.alias("own"), F.array_join("grams", "|").alias("grams"))
    found = ws.stage(lines.withColumn("content", F.unhex(F.sha2(F.concat_ws(":", "own", "grams"), 256))), "paragraphs")
    # Each distinct set of n-grams once.
    bodies = ws.stage(found.select("content", "own", "grams").distinct().select("content", "own", F.expr("filter(split(grams, '[|]'), g -> g != '')").alias("grams")), "bodies")
    n = len(FAMILIES)
    hits = bodies.select("content", F.explode("grams").alias("gram")).join(F.broadcast(_model_table(spark)), "gram")  # the model: its size does not depend on the input
    sums = hits.groupBy("content").agg(*(F.sum(F.col("weights")[i]).alias(f"z{i}") for i in range(n)))
    scores = bodies.select("content").join(sums, "content", "left")
    logits = F.array(*((F.coalesce(f"z{i}", F.lit(0.0)) + float(bias[i])) / temperature for i in range(n)))
    top = F.array_max("z")
    shares = F.transform("z", lambda v: F.exp(v - top))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    best = F.array_max(F.transform(F.array(*(F.struct(F.col("e")[i].alias("p"), F.lit(f).alias("f")) for i, f in enumerate(FAMILIES))), lambda s: s))
    judged = scores.select("content", logits.alias("z")).withColumn("e", shares).select("content", (best["p"] / total).alias("probability"), best["f"].alias("family"))
    judged = ws.stage(judged.withColumn("family", F.when(F.col("probability") >= MIN_PROBABILITY, F.col("family")).otherwise(UNKNOWN)), "judged")
    # Word pairs shared with the templates of the predicted family, as a share of the smaller side. The unknown class has no templates.
    pairs = bodies.join(judged.where(F.col("family") != UNKNOWN), "content").select("content", "family", F.explode(F.filter("grams", lambda g: g.rlike("^[^ ]+ [^ ]+$"))).alias("gram"), "own")
    alike = pairs.join(F.broadcast(_template_table(spark)), ["family", "gram"]).groupBy("content", "template", "size", "own").agg(F.count(F.lit(1)).alias("both"))
    nearest = alike.groupBy("content").agg(F.max(F.col("both") / F.least("size", F.greatest("own", F.lit(1)))).alias("similarity"))
    verdicts = ws.stage(
        judged.join(nearest, "content", "left").select("content", "family", F.round("probability", 6).alias("probability"), F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity")), "verdicts"
    )
    # One set (none, or that of one licence line) may be that of a third of all paragraphs: verdicts travel to (content, salt) parts.
    salted = found.drop("own", "grams").withColumn("salt", F.pmod(F.xxhash64("row_tag"), F.lit(1024)).cast("int"))
    parts = ws.stage(salted.select("content", "salt").distinct().join(verdicts, "content"), "parts")
    return salted.join(parts, ["content", "salt"]).select(
        "row_tag", "doc_id", "line", "start", "end", "evidence", "family", "probability", "similarity", ((F.col("family") != UNKNOWN) & (F.col("similarity") >= MIN_SIMILARITY)).alias("confirmed")
    )


def find_licenses(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``judge_paragraphs`` with evidence; without any the model has nothing but its bias, which says unknown."""
    return judge_paragraphs(docs, ws, id_col, text_col).where(F.col("evidence") > 0)


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the confirmed family of highest probability (else unknown), how many of its paragraphs are found, confirmed and unknown, and all licence findings."""
    ws = Workspace(docs.sparkSession, "licenses")
    found = judge_paragraphs(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ws)
    known = F.col("family") != UNKNOWN
    best = F.max(F.when(F.col("confirmed"), F.struct("probability", "similarity", "family")))
    spans = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(known, F.struct("start", "end", "family")))), lambda s: F.concat_ws(":", s["family"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.groupBy("row_tag", "doc_id").agg(F.count_if(known).alias("n_found"), F.count_if("confirmed").alias("n_confirmed"), F.count_if(~known).alias("n_unknown"), best.alias("best"), spans.alias("spans")).select(
        "doc_id", F.coalesce("best.family", F.lit(UNKNOWN)).alias("family"), F.col("best.probability").alias("probability"), F.col("best.similarity").alias("similarity"), "n_found", "n_confirmed", "n_unknown", "spans"
    )
