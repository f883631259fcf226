from documents import SCHEMA, awkward, empty, prose, rows
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leafmill.llm import simhash
from leafmill.llm.components import connected_components


def brute(text):
    words = (text or "").encode().lower().split()
    n = min(3, len(words))
    hashes = [xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(pairs):
    """Components of (id, fingerprint) by comparing all."""
    left, out = list(pairs), {}
    while left:
        group, todo = [], [left.pop()]
        while todo:
            x = todo.pop()
            group.append(x)
            near = [y for y in left if bin(x[1] ^ y[1]).count("1") <= 3]
            left = [y for y in left if y not in near] if near else left
            todo += near
        ids = [i for i, _ in group if i is not None]
        for x in group:
            out[x] = min(ids, default=None)
    return out


def test_against_all_pairs(spark):
    texts = [(200 + i, prose(60, 9) + " " + prose(1 + i % 7, i)) for i in range(60)] + [(300 + i, prose(30, 50 + i)) for i in range(30)]
    docs = awkward(spark).unionByName(spark.createDataFrame(rows(texts), SCHEMA))
    want = brute_groups({(r.doc_id, brute(r.text)) for r in docs.collect()})
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in got} == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {x[0] for x, c in want.items() if c == x[0] or x[0] is None}


def test_one_row_of_each_group(spark):
    """Rows are dropped as rows: neither a shared doc_id nor a null one takes a unique text along or saves a copy."""
    a, b, c, d = prose(60, 1), prose(60, 2), prose(60, 3), prose(60, 4)
    texts = [(10, a), (11, a), (11, b), (None, a), (None, c), (None, c), (12, d), (12, d), (12, d), (9, b + ""), (13, None), (13, "")]
    kept = simhash.deduplicate(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("10", a), ("9", b), ("None", c), ("12", d), ("13", "")])
    unique = simhash.deduplicate(spark.createDataFrame(rows([(1, a), (2, a), (2, b)]), SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in unique) == sorted([(1, a), (2, b)])
    assert simhash.deduplicate(empty(spark)).collect() == []


def test_columns_of_any_name_stay(spark):
    docs, names = awkward(spark), ("__n", "n", "digest", "kept_id", "__digest", "__id", "row", "fp", "a.b")
    for c in names:
        docs = docs.withColumn(c, F.lit(c))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {tuple(r)[-len(names) :] for r in kept.collect()} == {names}


def test_nothing(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 100 + i) for i in range(40)] + [(300, 301), (301, 302), (302, 300), (7000, 7000), (300, 301)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)} | {1000: 100} | {300: 300, 301: 300, 302: 300}
    assert got == want
