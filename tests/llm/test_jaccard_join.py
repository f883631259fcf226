"""The n-gram Jaccard join against all pairs."""

import numpy as np
from documents import SCHEMA, awkward, empty, prose, rows

from leafmill.llm import jaccard_join as jj


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(table):
    """(doc_id, n_shingles, component_id) by comparing all rows."""
    sets, left, out = [(i, shingles(t)) for i, t in table], set(range(len(table))), []
    near = lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b)
    while left:
        group, todo = [], [left.pop()]
        while todo:
            x = todo.pop()
            group.append(x)
            found = {y for y in left if near(sets[x][1], sets[y][1])}
            left -= found
            todo += found
        ids = [sets[x][0] for x in group if sets[x][0] is not None]
        out += [(sets[x][0], len(sets[x][1]), min(ids, default=None)) for x in group]
    return sorted(out, key=str)


def found(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_join(docs).collect()), key=str)


def varied(n, salt, changes):
    words = prose(n, salt).split()
    for c in changes:
        words[c % n] = f"changed{c}"
    return " ".join(words)


def test_against_all_pairs(spark):
    texts = [(200 + i, varied(150, 9, range(3, 3 + 40 * (i % 9), 40))) for i in range(60)]  # around the limit
    texts += [(300 + i, prose(60, 60) + " " + prose(30, 100 + i)) for i in range(30)]  # one long passage in all of them
    texts += [(400 + i, varied(300, 11, [7 * i, 7 * i + 90])) for i in range(40)] + [(500, "a b c"), (501, "A  B\nC"), (502, "a b c d"), (503, "a b")]
    texts += [(600 + i, " ".join(prose(200, 12).split()[2 * i : 2 * i + 120])) for i in range(40)]  # a chain
    docs = awkward(spark).unionByName(spark.createDataFrame(rows(texts), SCHEMA)).repartition(7)
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_frequent_shingles_and_small_blocks(spark, monkeypatch):
    """Lists of several blocks, and an order with frequent shingles last, give the same components."""
    monkeypatch.setattr(jj, "BLOCK", 500)
    monkeypatch.setattr(jj, "LONG", 6)
    monkeypatch.setattr(jj, "PAIRS", 10)
    monkeypatch.setattr(jj, "CENTERS", 2)
    texts = [(i, varied(80 + i % 3, 21, [5 * (i % 11), 9 * (i % 7)])) for i in range(120)] + [(1000 + i, prose(40, 70 + i % 5) + " " + prose(20, i)) for i in range(60)]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(6)
    assert found(docs) == brute(texts)


def test_nothing(spark):
    assert jj.jaccard_join(empty(spark)).collect() == []
    assert found(spark.createDataFrame(rows([(1, None), (2, ""), (None, " ")]), SCHEMA)) == sorted([(1, 0, 1), (2, 0, 2), (None, 0, None)], key=str)


def test_answers_are_derived():
    """Overlaps derived from the set before are those counted afresh."""
    rng = np.random.default_rng(3)
    block = [np.unique(rng.integers(0, 400, 150)).astype(np.uint64) for _ in range(50)]
    answers, grams = jj.Answers(block), block[0]
    for _ in range(30):
        grams = np.unique(np.concatenate([grams[rng.random(len(grams)) > 0.05], rng.integers(0, 400, 5).astype(np.uint64)]))
        assert answers.of(grams).tolist() == [len(np.intersect1d(grams, b)) for b in block]


def test_summary_keeps_what_is_frequent():
    summary = jj.Summary(100)
    rng = np.random.default_rng(4)
    for _ in range(20):
        summary.add(np.concatenate([rng.integers(1000, 1 << 60, 5000).astype(np.uint64), np.repeat(np.arange(50, dtype=np.uint64), 20)]))
    items, counts = summary.top()
    assert set(range(50)) <= set(items.tolist()) and len(items) <= 100 and counts.min() > 1


def test_sketches_bound_what_is_shared():
    rng = np.random.default_rng(5)
    for n, m in [(1, 1), (3, 200), (700, 650), (20_000, 17_500), (400_000, 4)]:
        pool = rng.integers(0, 1 << 63, n + m).astype(np.uint64)
        x, y = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        both = len(np.intersect1d(x, y))
        for least in (both, both + 1, min(len(x), len(y)) + 1):
            said = jj._Sketches([jj.sketch(x), None, jj.sketch(y)]).share(np.array([0, 0, 1]), np.array([2, 1, 2]), np.full(3, least))
            assert said.tolist() == [jj.sketch(x) is None or jj.sketch(y) is None or jj.most_shared(jj.sketch(x), jj.sketch(y), len(x), len(y)) >= least, True, True]
        assert both <= jj.most_shared(jj.sketch(x), jj.sketch(y), len(x), len(y)) <= min(len(x), len(y))
