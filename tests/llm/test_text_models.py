"""Language ID, toxicity and licenses: exact sums, held-out accuracy, planted cases and awkward rows."""

import numpy as np
from documents import SCHEMA, awkward, empty, prose, rows

from leafmill.llm import language_id, licenses, toxicity

DOCS = "/root/testdata/sf0.001"


def segmentations(segmenter, word, weight):
    """The probability of a word, over each segmentation in turn."""
    if not word:
        return 1.0
    total = 0.0
    for i, j, ids in segmenter.edges(word):
        if i == 0:
            total += float(np.prod(weight[list(ids)])) * segmentations(segmenter, word[j:], weight)
    return total


def test_forward_sums_all_segmentations():
    pieces = language_id.load_pieces(language_id.vocabulary_path())
    rng = np.random.default_rng(1)
    weight = rng.random((len(pieces), 2)) / len(pieces)
    model = language_id.Model(["a", "b"], pieces, weight, np.log([0.5, 0.5]))
    scorer = language_id.Scorer(model)
    words = ["the", "house", "über", "水x", "ab" * 20]
    got = scorer._scores(words)
    for k, w in enumerate(words[:4]):
        for lang in range(2):
            want = segmentations(scorer.segmenter, language_id.MARK + w, model.weight[:, lang].astype(float))
            assert abs(got[k, lang] - np.log(want)) < 1e-6
    text = "The house, über 水x the"
    logs, n = scorer.texts([text, None, "123"])
    assert n.tolist() == [5, 0, 0]
    assert np.allclose(logs[0], 2 * got[0] + got[1] + got[2] + got[3])


def test_expected_counts():
    segmenter = language_id.Segmenter(["<unk>", "▁", "a", "b", "ab", "▁a", *[f"<0x{i:02X}>" for i in range(256)]])
    weight = np.full((segmenter.size, 1), 0.1)
    got = np.zeros(weight.shape)
    language_id.add_expected(got, segmenter, ["▁ab"], np.array([0]), np.array([3.0]), weight)
    # ▁+a+b (0.001), ▁+ab (0.01), ▁a+b (0.01)
    total = 0.021
    assert np.allclose(got[1:6, 0], np.array([0.011, 0.001, 0.011, 0.01, 0.01]) / total * 3)


def brute_expected(segmenter, word, weight, times):
    """Expected pieces of a word, over each segmentation in turn."""
    ways = [([], 0, 1.0)]
    got, total = np.zeros(len(weight)), 0.0
    while ways:
        held, at, p = ways.pop()
        if at == len(word):
            total += p
            np.add.at(got, np.array(held), p)
        ways += [(held + list(ids), j, p * float(np.prod(weight[list(ids)]))) for i, j, ids in segmenter.edges(word) if i == at]
    return got / total * times


def test_expected_counts_over_each_segmentation():
    pieces = language_id.load_pieces(language_id.vocabulary_path())
    segmenter = language_id.Segmenter(pieces)
    weight = np.random.default_rng(2).random((len(pieces), 2)) / len(pieces)
    words = [language_id.MARK + w for w in ("house", "über", "\U00010900x\U00010900", "the")]
    got = np.zeros(weight.shape)
    language_id.add_expected(got, segmenter, words, np.array([0, 1, 0, 0]), np.array([3.0, 1.0, 2.0, 5.0]), weight)
    want = np.zeros(weight.shape)
    for w, lang, n in zip(words, (0, 1, 0, 0), (3.0, 1.0, 2.0, 5.0)):
        want[:, lang] += brute_expected(segmenter, w, weight[:, lang], n)
    assert np.allclose(got, want)


def test_long_runs_outside_the_vocabulary():
    """Sums stay in range: a run of n such letters holds the mark and n times its bytes, whatever n is."""
    pieces = language_id.load_pieces(language_id.vocabulary_path())
    segmenter = language_id.Segmenter(pieces)
    weight = np.full((len(pieces), 1), 1 / len(pieces))
    for n in (1, 23, 24, 500):
        got = np.zeros(weight.shape)
        language_id.add_expected(got, segmenter, [language_id.MARK + "\U00010900" * n], np.array([0]), np.array([2.0]), weight)
        assert np.isclose(got.sum(), 2 * (1 + 4 * n))
    model = language_id.Model(["a", "b"], pieces, np.hstack([weight, weight]), np.log([0.5, 0.5]))
    one, many = language_id.Scorer(model)._scores(["\U00010900", "\U00010900" * 500])
    assert np.allclose(many - one, 499 * 4 * np.log(1 / len(pieces)), rtol=1e-4)


def test_a_strange_run_does_not_spoil_the_model(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    pieces = language_id.load_pieces(language_id.vocabulary_path())
    for n in (23, 24, 500):
        odd = spark.createDataFrame([(9_000_000, "\U00010900" * n, "en", "s", n)], "doc_id long, text string, lang string, source string, n_chars long")
        model = language_id.train(language_id.training_rows(docs).unionByName(odd), pieces)
        assert np.isfinite(model.weight).all()
    found = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() == found.count()


def test_letters():
    import regex

    for text in ("A b1c² ½Ⅷ", "Straße — ‘élan’…", "x’y 水の a", "É\u0301a", "ªº µ ÷×", ""):
        assert language_id.letters(text) == regex.findall(r"\p{L}+", text.lower())
    every = " ".join(chr(i) + "a" for i in range(0x2FF))
    assert language_id.letters(every) == regex.findall(r"\p{L}+", every.lower())


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    model = language_id.train(language_id.training_rows(docs), language_id.load_pieces(language_id.vocabulary_path()))
    found = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()
    odd = {r.doc_id: r for r in language_id.predict(awkward(spark), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1, 2, 3))
    assert language_id.predict(awkward(spark), model).count() == awkward(spark).count()
    assert language_id.keep_identified(awkward(spark), model).columns == awkward(spark).columns
    nothing = language_id.train(empty(spark), language_id.load_pieces(language_id.vocabulary_path()))
    assert {r.lang_pred for r in language_id.predict(awkward(spark), nothing).collect()} == {"und"}


def test_machine_learns_a_pair():
    """Term 0 or 1 alone is harmless, both together are not: no additive weights can say so."""
    rows_ = [np.array(x, dtype=np.int64) for x in ([0], [1], [0, 1], []) for _ in range(300)]
    labels = np.array([0.0] * 600 + [1.0] * 300 + [0.0] * 300)
    m = toxicity.Machine.fit(np.array([5, 6]), rows_, labels, epochs=80)
    assert m.score(np.array([0, 1])) > 0.7 > 0.3 > max(m.score(np.array([0])), m.score(np.array([1])), m.score(np.zeros(0, dtype=np.int64)))


def test_pairs_that_tell_nothing_alone_are_learned(spark):
    """Toxic is a text with exactly one of two words, each of which is as often in toxic texts as in others."""
    data = []
    for i in range(1600):
        a, b = i % 2, i // 2 % 2
        other = " ".join("abcdefghijklmnopqrst"[(i * k + k * k) % 20] * 3 for k in range(3, 7))
        data.append((i, f"{'zork ' * a}{'blick ' * b}{other}", int(a != b)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    docs = docs.unionByName(docs.where("doc_id < 3"))  # repeated ids
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    right = [(found[i] >= 0.5) == bool(y) for i, _, y in data]
    assert sum(right) > 0.95 * len(right)


def test_scores_against_a_double_loop(spark):
    rng = np.random.default_rng(3)
    terms = np.array(sorted({t for w in ("alpha", "beta", "one") for t in toxicity.terms_of_word(w)}), dtype=np.int64)
    machine = toxicity.Machine(terms, -0.5, rng.normal(0, 1, len(terms)), rng.normal(0, 1, (len(terms), 3)))
    texts = [(1, "Alpha one!"), (2, "beta BETA alpha one more"), (3, ""), (4, None), (5, "nothing known")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows(texts), SCHEMA), machine).collect()}
    number = {int(t): i for i, t in enumerate(terms)}
    for i, text in texts:
        import re

        held = sorted({number[t] for w in re.findall("[a-z]+", (text or "").lower()) for t in toxicity.terms_of_word(w) if t in number})
        z = machine.bias + sum(machine.weight[a] for a in held) + sum(float(machine.vectors[a] @ machine.vectors[b]) for a in held for b in held if a < b)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    assert toxicity.score(empty(spark), machine).collect() == []


def test_toxicity_of_held_out_documents(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    held = toxicity.score(docs, machine).join(labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), "doc_id")
    r = held.agg(F.avg(F.when(F.col("toxic") == 0, (F.col("score") < 0.3).cast("int"))).alias("clean"), F.avg(F.when(F.col("toxic") == 1, (F.col("score") >= 0.3).cast("int"))).alias("caught")).first()
    assert r.clean > 0.97 and r.caught > 0.6
    assert toxicity.score(awkward(spark), machine).count() == awkward(spark).count()
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert {x.score for x in toxicity.score(awkward(spark), None).collect()} == {0.0}


def test_licenses(spark):
    texts = [(1, "Some prose here.\nReleased under the MIT License.\nmore"), (2, "licensed under the apache license version 2.0"), (3, "The driver must show a license to the officer at the gate."), (4, prose(50, 1)), (5, "x\n\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (6, None), (6, None), (7, "")]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    model = licenses.train(spark.read.parquet(f"{DOCS}/documents.parquet"))
    got = [(r.doc_id, r.family, r.n_confirmed) for r in licenses.scan(docs, model).orderBy("doc_id").collect()]
    assert [x[:2] for x in got if x[0] not in (5,)] == [(1, "MIT"), (2, "Apache-2.0"), (3, "none"), (4, "none"), (6, "none"), (6, "none"), (7, "none")]
    assert next(x for x in got if x[0] == 5)[2] == 2
    assert licenses.scan(awkward(spark), model).count() == awkward(spark).count()
    assert licenses.scan(empty(spark), licenses.train(empty(spark))).collect() == []


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.",
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License);\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
}


def test_licenses_of_every_form(spark):
    """Each family by each of its notices, by short forms and by wrapped notices; sentences that grant nothing are none."""
    cases = [(t, f) for f, ts in licenses.templates().items() for t in ts]
    cases += [(f"{prose(8, 1)}\n{t}\n{prose(9, 2)}", f) for f, ts in licenses.TEMPLATES.items() for t in ts]
    cases += [(f"{prose(8, 1)}\n\n{t}\n\n{prose(9, 2)}", f) for f, t in WRAPPED.items()]
    cases += [("Copyright 2020 Foo. All rights reserved.", "Proprietary"), (f"{prose(9, 3)}. Released under the MIT License. {prose(9, 4)}.", "MIT")]
    none = ["He said all rights reserved tables were taken.", "rights reserved", "license", "The driver must show a valid license to the officer.", "free software", "MIT", "gnu", prose(400, 5), "this is a copy of the work\nthe rights of the person"]
    cases += [(t, "none") for t in none]
    docs = spark.createDataFrame(rows([(i, t) for i, (t, _) in enumerate(cases)]), SCHEMA)
    model = licenses.train(spark.read.parquet(f"{DOCS}/documents.parquet"))
    got = {r.doc_id: r.family for r in licenses.scan(docs, model).collect()}
    wrong = [(t, f, got[i]) for i, (t, f) in enumerate(cases) if got[i] != f]
    assert not wrong, wrong


def test_license_scores_against_a_loop(spark):
    """Probability and likeness of single lines, n-gram by n-gram."""
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    model = licenses.train(docs)
    lines = ["Released under the MIT License.", "licensed under the apache license version 2.0 for all", "gnu license terms apply here", "a copy of the software and the work"]
    known, notices = set(model.vocabulary), licenses.templates()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.findings for r in licenses.scan(df, model).collect()}
    for i, line in enumerate(lines):
        ws = licenses.words(line)
        z = [model.bias[k] for k in range(len(model.families))]
        for g in licenses.grams(ws):
            if g in known:
                for k in range(len(z)):
                    z[k] += float(f"{model.weights[k, licenses._slot(g)]:.6g}")
        e = np.exp((np.array(z) - max(z)) / model.temperature)
        best = int(e.argmax())
        if model.families[best] == licenses.UNKNOWN or e.max() / e.sum() < licenses.LEAST_PROBABILITY:
            assert not got[i]
            continue
        mine, top = {" ".join(x) for x in zip(ws, ws[1:])}, 0.0
        for t in notices[model.families[best]]:
            p = set(licenses.word_pairs(t))
            top = max(top, 2 * len(p & mine) / (len(p) + len(mine)), len(p & mine) / len(p) if len(p) >= licenses.LEAST_PAIRS else 0)
        (f,) = got[i]
        assert f.family == model.families[best] and abs(f.probability - e.max() / e.sum()) < 1e-4 and abs(f.likeness - top) < 1e-9


def test_license_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('line ', id, '\\nthe same line') as text")
    picked = licenses.sample(docs, 50)
    assert 0 < len(picked) <= 50 and len(set(picked)) == len(picked)
    assert licenses.sample(empty(spark), 50) == []
