"""Merkle manifests against trees built one by one."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from documents import SCHEMA, awkward, empty, prose, rows
from pyspark.sql import functions as F

from leafmill.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fan):
    """The root and each leaf's path of (before, after)."""
    paths, owners, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        new, new_owners = [], []
        for a in range(0, len(level), fan):
            run = level[a : a + fan]
            for j, who in enumerate(owners[a : a + fan]):
                for i in who:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            new.append(sha("".join(run)))
            new_owners.append([i for who in owners[a : a + fan] for i in who])
        level, owners = new, new_owners
    return level[0], paths


def brute(table, fan):
    groups = defaultdict(list)
    for r in table:
        groups[r.lang].append((r.doc_id, leaf([r.doc_id, r.source, r.lang, r.n_chars, r.text])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = {g: tree([h for _, h in groups[g]], fan) for g in names}
    root, above = tree([built[g][0] for g in names], fan)
    return sorted((str(i), h, built[g][0], root, tuple(built[g][1][k] + above[at])) for at, g in enumerate(names) for k, (i, h) in enumerate(groups[g]))


@pytest.mark.parametrize("fan,span", [(2, 4), (2, 1024), (3, 9), (5, 7)])
def test_against_one_by_one(spark, monkeypatch, fan, span):
    monkeypatch.setattr(merkle, "SPAN", span)  # small blocks: several rounds
    texts = [(i, prose(3, i)) for i in range(70)] + [(7, "again"), (7, "again"), (None, "x"), (None, None)]
    docs = awkward(spark).unionByName(spark.createDataFrame(rows(texts), SCHEMA))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 1, None).when(F.col("doc_id") % 5 == 2, "").when(F.col("doc_id") == 63, "é").when(F.col("doc_id") < 50, "en").otherwise("a"))
    found = merkle.manifest(docs, fan=fan).collect()
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, tuple((x.before, x.after) for x in r.path)) for r in found)
    assert got == brute(docs.collect(), fan)


def test_tampering_shows(spark, tmp_path):
    texts = [(i, prose(3, i)) for i in range(60)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op12_merkle(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found if not r.verified} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert all((r.folded_root == r.root) == r.verified for r in found)
    assert len({r.root for r in found}) == 1


def test_small_tables(spark):
    assert merkle.manifest(empty(spark)).collect() == []
    one = spark.createDataFrame(rows([(1, "a")]), SCHEMA)
    (row,) = merkle.manifest(one).collect()
    assert row.path == [] and row.leaf == row.subroot == row.root == leaf([1, "s", "en", 1, "a"])
    same = merkle.manifest(spark.createDataFrame(rows([(1, "a")] * 5), SCHEMA)).collect()
    assert len(same) == 5 and len({r.root for r in same}) == 1
