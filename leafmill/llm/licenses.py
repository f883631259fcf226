"""License scans (6): a trained paragraph classifier and a comparison with templates, with SQL functions only.

A paragraph is a line of a text, a sentence of it, or a run of lines that each have a word of some
notice (a notice that is wrapped). Its word n-grams (one to three words, with at least one word that is
not a stop word) weigh for each licence family in a multinomial logistic regression with a class for
everything else. A predicted family is confirmed when the paragraph is alike enough to one of the
family's templates: by the Dice coefficient of their word pairs, or, for a template of ``LEAST_PAIRS``
pairs or more, by the share of its pairs that the paragraph has.

The regression is fitted on the templates below, varied by leaving words out and by words of the corpus
around them, and on a bounded sample of the corpus's lines as the class ``unknown`` (``SAMPLE_LINES``
lines of at most ``SAMPLE_BYTES`` bytes, those with the smallest hash; a bound on the hash, from the
number of lines, leaves a few times as many before they are compared). Its probabilities are calibrated
by a temperature: a first fit leaves out one whole template of each family and a part of the other
rows, and the temperature makes these likeliest. A family is predicted from ``LEAST_PROBABILITY`` on.
Every n-gram with a weight has a word of the templates that is not a stop word, so a line without such a
word is ``unknown`` without looking further. Scoring is a projection: no join and no shuffle.

Defined cases: a null, empty or blank text has no findings and the family ``none``; a line counts once,
by the best of its sentences and itself; a run of lines counts only where none of its lines is confirmed
alone; a document with several families has that of its most probable confirmed finding (ties: the
earliest); texts of any length are read whole; repeated rows and null ids each give a row; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Public licence notices by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is distributed under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
    ],
}
#: The names by which short forms state a licence.
NAMES = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache License 2.0"],
    "GPL": ["GPL-3.0", "GPL-2.0", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPLv3", "GPLv2"],
    "LGPL": ["LGPL-3.0", "LGPL-2.1", "LGPL-3.0-or-later", "LGPLv3"],
    "AGPL": ["AGPL-3.0", "AGPL-3.0-or-later", "AGPL-3.0-only", "AGPLv3"],
    "BSD": ["BSD-3-Clause", "BSD-2-Clause", "BSD"],
    "MPL-2.0": ["MPL-2.0", "MPL 2.0"],
    "ISC": ["ISC"],
    "CC-BY": ["CC-BY-4.0", "CC BY 4.0", "CC-BY-3.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0", "CC BY-SA 4.0", "CC-BY-SA-3.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0", "CC BY-NC 4.0", "CC-BY-NC-3.0"],
    "CC0": ["CC0-1.0", "CC0"],
    "Proprietary": ["Proprietary"],
}
#: Sentences with licence words that grant nothing.
OTHER = [
    "The driver must show a valid license to the officer.",
    "He asked for permission to leave the software meeting.",
    "A new version of the public library opened in general use.",
    "The source of the river is free of charge to any person.",
    "The license plate was under the car, version two of it.",
    "They released the prisoners under the terms of the agreement.",
    "The foundation published a copy of the work for the public.",
    "All children have rights and the court reserved its judgment.",
    "The common creative person works in the public domain of art.",
    "This program will be distributed to the audience without a fee.",
]
#: Words that alone tell nothing.
STOP = set("a an and any are as at be by for from in is it its no not of on one or that the this to under was were will with without you your he they at may can all two use used 0 1 2 3 4 v http www org see part form person law following the other work works file if".split())

UNKNOWN = "unknown"
SAMPLE_LINES = 2000
SAMPLE_BYTES = 1 << 16
LEAST_PROBABILITY = 0.5
LEAST_LIKENESS = 0.7
LEAST_PAIRS = 4
SLOTS = 1 << 13

_SPLIT = "[^a-z0-9]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def grams(ws: list[str]) -> list[str]:
    return [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1) if any(w not in STOP for w in ws[i : i + n])]


def _slot(gram: str) -> int:
    """Spark's xxhash64 of the n-gram, modulo the slots."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(gram.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % SLOTS


def templates() -> dict[str, list[str]]:
    """The notices of each family, and its short forms."""
    return {f: [*texts, *[form for n in NAMES[f] for form in (f"SPDX-License-Identifier: {n}", f"License: {n}")]] for f, texts in TEMPLATES.items()}


class Classifier:
    """Families, the n-grams with weights, and the weights by family and slot."""

    def __init__(self, families: list[str], vocabulary: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.families, self.vocabulary, self.weights, self.bias, self.temperature = families, vocabulary, weights, bias, temperature


def _variants(rng, text: str, around: list[list[str]]) -> list[str]:
    """A template as it is, with words left out, and amid other words."""
    ws, out = words(text), [text]
    for share in (0.1, 0.1, 0.2):
        out.append(" ".join(w for w in ws if rng.random() > share))
    for _ in range(4):
        x = around[rng.integers(len(around))] if around else []
        cut = rng.integers(len(x) + 1)
        out.append(" ".join([*x[: min(cut, 12)], *ws, *x[cut : cut + 12]]))
    return out


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _regression(x: np.ndarray, y: np.ndarray, times: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by gradient descent with momentum, of rows that stand for so many; rare classes count more."""
    of_class = times @ y
    balance = (times * np.minimum((1 / np.maximum(of_class, 1)) @ y.T * times.sum() / y.shape[1], 20))[:, None]
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = balance * (_soft(x @ w + b) - y) / times.sum()
        vw, vb = 0.9 * vw - 0.5 * (x.T @ g + 2e-4 * w), 0.9 * vb - 0.5 * g.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


def sample(docs: DataFrame, sample_lines: int = SAMPLE_LINES) -> list[str]:
    """At most ``sample_lines`` distinct lines, those with the smallest hashes.

    Only lines under a bound of the hash are compared at all, so what leaves the tasks does not grow.
    """
    lines = F.split("text", "\n", -1)
    n = docs.agg(F.sum(F.size(F.when(F.col("text").isNotNull(), lines)).cast("long"))).first()[0] or 0
    least = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 8 * sample_lines // max(n, 1))
    found = docs.where("text is not null").select(F.explode(lines).alias("line")).select(F.xxhash64("line").alias("h"), "line")
    found = found.where((F.col("h") <= F.lit(least)) & F.octet_length("line").between(1, SAMPLE_BYTES))
    return [r.line for r in found.groupBy("h").agg(F.min("line").alias("line")).orderBy("h").limit(sample_lines).collect()]


def train(docs: DataFrame, sample_lines: int = SAMPLE_LINES) -> Classifier:
    """Fit on the templates and a bounded sample of the corpus's lines."""
    picked = sample(docs, sample_lines)
    rng = np.random.default_rng(42)
    notices = templates()
    marks = {w for texts in notices.values() for t in texts for w in words(t) if w not in STOP}
    plain = [x for x in picked if len(marks.intersection(words(x))) < 2]
    around = [words(x) for x in plain[:200]]
    families = [*notices, UNKNOWN]
    samples = [(k, v, i == 1) for k, f in enumerate(notices) for i, t in enumerate(notices[f]) for v in _variants(rng, t, around)]
    samples += [(len(families) - 1, v, i % 5 == 4) for i, t in enumerate(OTHER) for v in _variants(rng, t, around)] + [(len(families) - 1, x, i % 5 == 4) for i, x in enumerate(plain)]
    vocabulary = sorted({g for texts in notices.values() for t in texts for g in grams(words(t))} | {g for t in OTHER for g in grams(words(t)) if marks.intersection(g.split())})
    known = set(vocabulary)
    alike = Counter((k, tuple(sorted(_slot(g) for g in grams(words(x)) if g in known)), held) for k, x, held in samples)  # most lines have none
    rows, times = [np.array(r, dtype=np.int64) for _, r, _ in alike], np.array(list(alike.values()), dtype=float)
    used = np.unique(np.concatenate(rows))
    x = np.zeros((len(rows), len(used)))
    for i, r in enumerate(rows):
        np.add.at(x[i], np.searchsorted(used, r), 1.0)
    y, away = np.eye(len(families))[[k for k, _, _ in alike]], np.array([held for _, _, held in alike])
    w, b = _regression(x[~away], y[~away], times[~away])
    share = 1 / np.maximum(times[away] @ y[away], 1)  # families count alike
    loss = lambda t: -(times[away, None] * y[away] * share * np.log(_soft((x[away] @ w + b) / t) + 1e-12)).sum()
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    w, b = _regression(x, y, times)
    weights = np.zeros((len(families), SLOTS))
    weights[:, used] = w.T
    return Classifier(families, vocabulary, weights, b, temperature)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda in it refers to it."""
    return F.transform(F.array(value), body)[0]


def _numbers(values) -> Column:
    """A constant array of doubles."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in np.ravel(values))), ",").cast("array<double>")


def _grams(ws: Column, n: int) -> Column:
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def word_pairs(text: str) -> list[str]:
    ws = words(text)
    return sorted({" ".join(x) for x in zip(ws, ws[1:])} or set(ws))


def findings(text: Column, model: Classifier) -> Column:
    """Paragraphs that a family is predicted for: number of the (first) line, family, probability, likeness to its nearest template."""
    anchors = sorted({w for g in model.vocabulary for w in g.split() if w not in STOP})
    size = len(model.families)
    weights, bias = _numbers(model.weights), _numbers(model.bias)
    names = F.array(*[F.lit(f) for f in model.families])
    notices = templates()
    pairs = F.array(*[F.array(*[F.array(*[F.lit(p) for p in word_pairs(t)]) for t in notices[f]]) for f in model.families[:-1]])
    cut = lambda line: F.filter(F.split(F.lower(line), _SPLIT), lambda w: w != "")
    anchored = lambda ws: F.exists(ws, lambda w: w.isin(anchors))

    def score(ws: Column) -> Column:
        found = F.filter(F.concat(*[_grams(ws, n) for n in (1, 2, 3)]), lambda g: g.isin(model.vocabulary))
        slots = F.transform(found, lambda g: F.pmod(F.xxhash64(g), F.lit(SLOTS)).cast("int"))

        def chosen(at: Column) -> Column:
            logits = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.aggregate(at, bias[c], lambda z, s: z + weights[c * SLOTS + s]) / model.temperature)
            return let(logits, lambda z: let(F.array_max(z), lambda top: F.struct(
                (F.array_position(z, top) - 1).cast("int").alias("family"),
                (1 / F.aggregate(z, F.lit(0.0), lambda t, v: t + F.exp(v - top))).alias("probability"),
            )))

        return let(slots, chosen)

    def alike(mine: Column, template: Column) -> Column:
        both = F.size(F.array_intersect(mine, template))
        return F.greatest(2 * both / (F.size(mine) + F.size(template)), F.when(F.size(template) >= LEAST_PAIRS, both / F.size(template)))

    def judged(ws: Column, number: Column) -> Column:
        """A paragraph's words as a finding."""

        def confirm(s: Column, mine: Column) -> Column:
            likeness = F.when(s["family"] < size - 1, F.array_max(F.transform(pairs[s["family"]], lambda t: alike(mine, t)))).otherwise(F.lit(0.0))
            return F.struct((likeness >= LEAST_LIKENESS).alias("sure"), s["probability"].alias("probability"), names[s["family"]].alias("family"), likeness.alias("likeness"), number.alias("number"))

        own = F.when(F.size(ws) > 1, F.array_distinct(_grams(ws, 2))).otherwise(ws)
        return let(score(ws), lambda s: let(own, lambda mine: confirm(s, mine)))

    predicted = lambda f: (f["family"] != UNKNOWN) & (f["probability"] >= LEAST_PROBABILITY)

    def of_line(c: Column) -> Column:
        """The best finding of a line and its sentences; null without any."""
        parts = F.filter(F.transform(F.split(c["line"], r"[.;!?]\s+"), cut), anchored)
        units = F.when(F.size(parts) > 0, F.array_distinct(F.concat(F.array(c["words"]), parts))).otherwise(F.array(c["words"]))
        return F.array_max(F.filter(F.transform(units, lambda ws: judged(ws, c["number"])), predicted))

    def with_runs(cs: Column, alone: Column) -> Column:
        """The findings of lines, and of runs of lines where none is confirmed alone."""
        starts = F.filter(F.transform(cs, lambda c, i: F.when((i == 0) | (c["number"] - F.get(cs, i - 1)["number"] > 1), i)), lambda i: i.isNotNull())
        runs = lambda at: F.transform(at, lambda i, k: F.slice(cs, i + 1, F.coalesce(F.get(at, k + 1), F.size(cs)) - i))
        sure = F.transform(F.filter(alone, lambda f: f["sure"]), lambda f: f["number"])
        apart = lambda rs: F.filter(rs, lambda r: (F.size(r) > 1) & ~F.arrays_overlap(F.transform(r, lambda c: c["number"]), sure))
        wrapped = let(starts, lambda at: F.transform(apart(runs(at)), lambda r: judged(F.flatten(F.transform(r, lambda c: c["words"])), r[0]["number"])))
        return F.concat(alone, F.filter(wrapped, lambda f: f["sure"] & predicted(f)))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line, i: F.struct(i.alias("number"), line.alias("line"), cut(line).alias("words")))
    found = let(F.filter(lines, lambda c: anchored(c["words"])), lambda cs: let(F.filter(F.transform(cs, of_line), lambda f: f.isNotNull()), lambda alone: with_runs(cs, alone)))
    return F.transform(found, lambda f: F.struct(f["number"].alias("number"), f["family"].alias("family"), f["probability"].alias("probability"), f["likeness"].alias("likeness")))


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """A row for each document: doc_id, its family (none without a confirmed finding), its probability, and all findings."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), findings(F.col("text"), model).alias("findings"))
    sure = F.filter("findings", lambda f: f["likeness"] >= LEAST_LIKENESS)
    best = F.array_max(F.transform(sure, lambda f: F.struct(f["probability"].alias("probability"), (-f["number"]).alias("order"), f["family"].alias("family"))))
    return found.withColumn("best", best).select(
        "doc_id", F.coalesce("best.family", F.lit("none")).alias("family"), F.coalesce("best.probability", F.lit(0.0)).alias("probability"),
        F.size(sure).cast("long").alias("n_confirmed"), "findings",
    )


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scan(docs, train(docs))
