"""SimHash near-dedup (8): 64-bit fingerprints compared through pivot distance tables.

A fingerprint's bit is 1 if it is set in over half the XXH64 hashes (seed 42) of the text's word
shingles. Fingerprints at 3 or fewer differing bits link; components of links are the groups.

Equal fingerprints are one node from the start. For each node the Hamming distances to 16 reference
fingerprints (pivots) are computed once. By the triangle inequality two linked nodes differ by at
most 3 in every coordinate, so a candidate pair is discarded by its largest coordinate difference, and
survivors are verified bit by bit. Candidates share three of six blocks of the 64 bits (3 differing
bits leave three blocks alone at least), which loses no link; within a bucket, the smallest node is
compared with all, and only members that are left outside the bucket's largest component are compared
further (see ``components``), so groups of thousands of variants cost no pairs among themselves.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; repeated
rows each give a row; a null doc_id is never a group's id unless all its ids are null; extra columns
are ignored by ``fingerprints`` and kept by ``deduplicate``, which keeps one row of each group, whatever
ids its rows repeat or lack.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import all_components, stars, with_component

SHINGLE = 3
RADIUS = 3
SEED = 42
PIVOTS = 16
#: Widths of the blocks of bits; any 3 differing bits leave 3 of the 6 blocks as they are.
BLOCKS = (11, 11, 11, 11, 10, 10)

#: Members outside a bucket's largest component that its first round compares with all.
CENTERS = 16

_STEP = 1 << 16  # shingles at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingle = min(shingle, len(words))
    total, n, join = np.zeros(64, dtype=np.int64), len(words) - shingle + 1, b" ".join
    for a in range(0, n, _STEP):
        part = words[a : min(a + _STEP, n) + shingle - 1]
        hashes = [xxh64_intdigest(join(x), SEED) for x in zip(*(part[j:] for j in range(shingle)))]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed long of the same 64 bits."""
    return _prints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, fp long")


def _prints(docs: DataFrame, schema: str) -> DataFrame:
    """``docs`` with fp in place of text, the last column."""

    def compute(batches):
        for pdf in batches:
            prints = np.array([fingerprint(t) for t in pdf.text], dtype=np.uint64).view(np.int64)
            yield pdf.drop(columns="text").assign(doc_id=pdf.doc_id.astype("Int64"), fp=prints)

    return docs.mapInPandas(compute, schema)


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, as signed longs: XXH64 of 0, 1, 2, ..."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)], dtype=np.uint64).view(np.int64).tolist()


def distance_table(fp: Column) -> list[Column]:
    """Distances to the pivots, packed eight to a long, seven bits each."""
    far = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in pivots()]
    pack = lambda some: reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(d, 7 * i) for i, d in enumerate(some)])
    return [pack(far[i : i + 8]).alias(f"far{i // 8}") for i in range(0, len(far), 8)]


def near(x: str, y: str, radius: int = RADIUS) -> Column:
    """Whether no pivot distance of the rows x and y differs by more than the radius, and then whether their bits do."""
    coordinate = lambda side, i: F.shiftright(f"{side}.far{i // 8}", 7 * (i % 8)).bitwiseAND(F.lit(127))
    close = reduce(lambda p, q: p & q, [F.abs(coordinate(x, i) - coordinate(y, i)) <= radius for i in range(PIVOTS)])
    return close & (F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= radius)


def block_keys(fp: Column) -> Column:
    """Bucket keys: a hash of each choice of three of the six blocks with its bits."""
    masks, at = [], 0
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << at)
        at += width
    kept = [sum(m) for m in combinations(masks, len(BLOCKS) - RADIUS)]
    signed = [m - (1 << 64) if m >> 63 else m for m in kept]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])


def groups(prints: DataFrame) -> DataFrame:
    """(fp, component_id, component): the smallest doc_id that a fingerprint reaches by links, and their smallest fingerprint."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", "least", *distance_table(F.col("fp"))), "pivot-table")
    keyed = nodes.select(F.col("fp").alias("node"), F.explode(block_keys(F.col("fp"))).alias("key"))
    star = written(stars(keyed), "simhash-stars")
    about = nodes.withColumnRenamed("fp", "node").withColumn("fp", F.col("node")).drop("least")
    side = lambda c: about.select(F.col("node").alias(c), F.struct(*about.columns).alias(f"of_{c}"))

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), "a").join(side("b"), "b").where(near("of_a", "of_b")).select("a", "b")

    held = about.select("node", F.struct(*about.columns).alias("about"))

    def meet(members: DataFrame, centers: int) -> DataFrame:
        known = members.join(held, "node")
        some = known.where("chosen").select("key", F.col("node").alias("x"), F.col("component").alias("of_x"), F.col("about").alias("about_x"))
        met = some.join(known.withColumnRenamed("key", "at"), (F.col("key") == F.col("at")) & (F.col("of_x") != F.col("component")) & near("about_x", "about"))
        return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()

    labels = all_components(star, verify, meet, CENTERS)
    named = with_component(nodes.select(F.col("fp").alias("node"), "least"), labels)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select(F.col("node").alias("fp"), "component_id", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, fp and component_id."""
    prints = written(fingerprints(docs), "fingerprints")
    return prints.join(groups(prints), "fp").select("doc_id", "fp", "component_id")


def _digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, one row of each group: that with the smallest (doc_id, digest of the text), null ids last.

    Of rows that are equal in both, one stays. Rows go along as structs, so that no name of theirs can clash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    prints = written(_prints(rows.select("doc_id", "digest", F.col("row.text").alias("text")), "doc_id long, digest string, fp long"), "fingerprints")
    repeats = prints.groupBy("fp", "doc_id", "digest").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "n")
    keepers = repeats.join(groups(prints), "fp").groupBy("component").agg(F.min(rank).alias("k"))
    keepers = keepers.select(F.col("k.doc_id").alias("kept_id"), F.col("k.digest").alias("kept_digest"), F.col("k.n").alias("n"))
    kept = rows.join(keepers, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    once, more = kept.where("n = 1"), kept.where("n > 1").dropDuplicates(["kept_id", "kept_digest"])
    return once.unionByName(more).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
