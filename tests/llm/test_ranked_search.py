"""Ranked search against scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
from documents import SCHEMA, awkward, empty, prose, rows

from leafmill.llm import ranked_search as rs


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    docs = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for doc_id, tf, length in docs:
            m, score = 25 + 75 * length * n // total, 0
            for t, times in Counter(terms(text)).items():
                if t in tf:
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(str(item), rank, None if none else doc_id, -s) for rank, (s, none, doc_id) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, prose(30, 5)), (2, "One."), (2, "theta12 IOTA3 theta12"), (3, None), (None, "Null id here"), (4, ".."), (5, prose(30, 5)), (6, "été 你好 zeta1"), (7, "never-seen"), (8, "x" * 5000)]
ITEM_SCHEMA = "item_id long, text string, query long, rank int, score string"


def answers(found):
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


def test_against_all_documents(spark, monkeypatch):
    texts = [(100 + i, prose(5 + i % 40, i % 90)) for i in range(400)] + [(77, prose(40, 200)), (77, prose(40, 201)), (None, prose(30, 5))]
    docs = awkward(spark).unionByName(spark.createDataFrame(rows(texts), SCHEMA)).repartition(5)
    items = [(*x, 0, 0, "s") for x in [*ITEMS, *[(50 + i, prose(12, i)) for i in range(20)]]]
    queries = spark.createDataFrame(items, ITEM_SCHEMA)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in queries.collect()], 10)
    assert answers(rs.ranked_search(docs, queries)) == want
    monkeypatch.setattr(rs, "SLICE", 1 << 11)  # several slices of queries
    monkeypatch.setattr(rs, "PIECE", 50)  # texts in pieces
    assert answers(rs.ranked_search(docs, queries)) == want
    assert answers(rs.ranked_search(docs, queries, k=3)) == [x for x in want if x[1] <= 3]


def test_nothing(spark):
    queries = spark.createDataFrame([(1, "alpha1", 0, 0, "s")], ITEM_SCHEMA)
    assert rs.ranked_search(empty(spark), queries).collect() == []
    assert rs.ranked_search(awkward(spark), queries.limit(0)).collect() == []


def test_reading_stops_early():
    """Of lists that fall, only their heads are met, and the answer is that of all documents."""
    rng = np.random.default_rng(1)
    n, m = 20_000, 6
    impact = rng.pareto(1.5, (n, m)) * 1000 + 1
    held = np.full(n, m)
    lists = rs.ImpactLists(np.arange(n), np.zeros(n, dtype=bool), held, np.tile(np.arange(m), n), impact.astype(np.int64).ravel(), m)
    factor = np.arange(1, m + 1)
    best, met = lists.search(np.arange(m), factor, factor.copy(), [], 10)
    scores = impact.astype(np.int64) @ factor
    want = sorted((-int(s), i) for i, s in enumerate(scores))[:10]
    assert [(s, i) for s, _, i in best] == want
    assert met < n // 10
