"""Merkle dataset manifest (12): hash trees over the rows of each group, and one over the groups' roots.

A row's leaf is the SHA-256 (lower-case hex) of its columns, each ``-`` if null and else its UTF-8 byte count, ``:`` and
value. In each group the leaves stand by the order column; every ``fan`` consecutive nodes become the hash of
their digests until one is left, the group's subroot; subroots, by group (null first, bytewise), likewise give the root.

Positions come from a range partitioning, so that no group is one task: rows are dealt by (group, order, leaf),
numbered in their partitions and moved up by the number of the group's rows in those before. The tree grows in
blocks of ``fan ** m`` (about a thousand) leaves, which are the windows' partitions. In each level, lag and lead
columns of fixed offsets, masked by a node's slot and the length of its run, supply its siblings, and the
run's first row hashes the run. A leaf reads the siblings of its path off the rows before it. The blocks' roots are the leaves of the
next round, until each group has one block; then the upper parts of the paths go down again by one join for each round.

Defined cases: equal order values stand by leaf, null ones first; repeated rows are leaves each; a null group
is a group, other than the empty string; texts of any length, also empty, are hashed whole; extra columns are ignored, and
``carry`` may name columns that go along; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

FAN = 2
#: Leaves of a block, at most.
SPAN = 1024
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in their ``key`` by ``order``, and ``n``, the number of rows of the key.

    Rows that are equal in all of that are told apart by where they were read, so that they are dealt among tasks too.
    """
    rows = written(rows.withColumn("read_at", F.monotonically_increasing_id()), "leaves")
    by = ["key", *order, "read_at"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("read_at")
    placed = written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "placed-leaves")
    runs = placed.groupBy("part", "key").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    key = Window.partitionBy("key")  # a key has one run a partition
    before = F.sum("held").over(key.orderBy("part")) - F.col("held")
    runs = runs.select("part", "key", (before - F.col("first")).alias("shift"), F.sum("held").over(key).alias("n"))
    return placed.join(runs, ["part", "key"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _depth(fan: int) -> int:
    """Levels of a block."""
    m = 1
    while fan ** (m + 1) <= SPAN:
        m += 1
    return m


def _blocks(nodes: DataFrame, fan: int) -> DataFrame:
    """``nodes`` (key, pos, n, digest, ...) with ``block``, ``top`` (the block's root, on its first row) and ``up`` (the siblings of the path in the block).

    On a row whose position is a multiple of ``fan ** level``, ``h`` is the digest of the node of that level that begins there.
    """
    m = _depth(fan)
    out = nodes.withColumn("block", F.expr(f"pos div {fan**m}")).withColumn("h", F.col("digest"))
    w = Window.partitionBy("key", "block").orderBy("pos")
    for level in range(m):
        step = fan**level
        nth = F.expr(f"pos div {step}")
        count = F.expr(f"(n + {step - 1}) div {step}")
        slot = F.pmod(nth, F.lit(fan))
        run = F.least(F.lit(fan), count - nth + slot)
        here, grows = F.pmod("pos", F.lit(step)) == 0, count > 1
        offsets = {f"lag{j}": F.lag("h", j * step).over(w) for j in range(1, fan)} | {f"lead{j}": F.lead("h", j * step).over(w) for j in range(1, fan)}
        out = out.withColumns(offsets)
        before = F.concat(*[F.when(slot >= j, F.col(f"lag{j}")).otherwise("") for j in range(fan - 1, 0, -1)])
        after = F.concat(*[F.when(slot + j < run, F.col(f"lead{j}")).otherwise("") for j in range(1, fan)])
        out = out.withColumns({
            f"sides{level}": F.when(here & grows, F.struct(before.alias("before"), after.alias("after"))),
            "h": F.when(here & (slot == 0), F.when(grows, F.sha2(F.concat("h", after), 256)).otherwise(F.col("h"))),
        }).drop(*offsets)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.array(*[F.last(f"sides{level}", ignorenulls=True).over(so_far) for level in range(m)])
    out = out.withColumns({"up": path, "top": F.col("h")})
    return out.withColumn("up", F.filter("up", lambda x: x.isNotNull())).drop("h", *[f"sides{level}" for level in range(m)])


def _roots(nodes: DataFrame, fan: int) -> DataFrame:
    """The blocks' roots as nodes."""
    span = fan ** _depth(fan)
    tops = _blocks(nodes.select("key", "pos", "n", "digest"), fan).where(F.pmod("pos", F.lit(span)) == 0)
    return tops.select("key", F.col("block").alias("pos"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("top").alias("digest"))


def _rounds(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """Nodes, their blocks' roots, the roots of those, and so on until each key has one."""
    out = [nodes]
    while True:
        out.append(written(_roots(out[-1], fan), "block-roots"))
        if (out[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return out


def _down(rounds: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """The first nodes with ``path``, their siblings up to the root.

    ``above`` has (key, path, more columns): what goes on from the key's own root.
    """
    more = [c for c in above.columns if c not in ("key", "path")]
    upper = rounds[-1].select("key", F.col("pos").alias("block")).join(above, "key")
    for i in range(len(rounds) - 2, -1, -1):
        joined = _blocks(rounds[i], fan).join(upper, ["key", "block"])  # the windows' partitioning serves the join
        joined = joined.withColumn("path", F.concat("up", "path")).drop("up", "top", "block")
        if i:
            upper = written(joined.select("key", F.col("pos").alias("block"), "path", *more), "upper-paths")
    return joined


def manifest(docs: DataFrame, columns=COLUMNS, group: str = "lang", order: str = "doc_id", fan: int = FAN, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each document: the order column, the carried ones, leaf, subroot, root and path.

    ``path`` lists, level by level up to the root, the digests that stand before and after the node in its run.
    """
    carry = carry or {}
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    own = docs.select(named.alias("key"), F.col(order).alias("by"), leaf([F.col(c) for c in columns]).alias("digest"), *[c.alias(f"with_{name}") for name, c in carry.items()])
    rounds = _rounds(positions(own, ["by", "digest"]), fan)
    subroots = rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
    above = _rounds(positions(subroots, ["name"]), fan)
    root = above[-1].select("key", F.lit(None).cast("array<struct<before:string,after:string>>").alias("path"), F.col("digest").alias("root"))
    root = root.withColumn("path", F.coalesce("path", F.array().cast("array<struct<before:string,after:string>>")))
    groups = written(_down(above, root, fan).select(F.col("name").alias("key"), "path", F.col("digest").alias("subroot"), "root"), "group-paths")
    rows = _down(rounds, groups, fan)
    return rows.select(F.col("by").alias(order), *[F.col(f"with_{name}").alias(name) for name in carry], F.col("digest").alias("leaf"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """The SHA-256 of all digests of a path, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x.before, x.after)), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x.before, h, x.after), 256))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    found = manifest(docs, carry={"other": F.when(tampered, leaf(changed))})
    found = found.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: DuckDB has no crc32: its bits step by step.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::ubigint)), lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda x, y: xor(x // 2, 3988292384::ubigint * (x % 2)))))"
_FIELD = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || cast({0} as varchar) end"


def _leaf_sql(bump: str = "") -> str:
    return "sha256(" + " || ".join(_FIELD.format(f"(n_chars{bump})" if c == "n_chars" else c) for c in COLUMNS) + ")"


ORACLE = f"""
with recursive own as materialized (
    select doc_id, coalesce('=' || lang, '') as k, {_leaf_sql()} as leaf, case when {_CRC} % 7 = 0 then {_leaf_sql(' + 1')} end as other from documents
), leaves as materialized (
    select row_number() over () as r, k, doc_id, leaf, coalesce(other, leaf) as start, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as i from own
), nodes(level, k, i, n, h) as (
    select 0, k, i, count(*) over (partition by k), leaf from leaves
    union all
    select level + 1, k, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by level, k, i // 2, n
), tops as materialized (select k, h, row_number() over (order by k) - 1 as i from nodes where n = 1
), above(level, i, n, h) as (
    select 0, i, count(*) over (), h from tops
    union all
    select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from above where n > 1 group by level, i // 2, n
), steps as materialized (
    select l.r, v.level as s, coalesce(b.h, '') as h, (l.i >> v.level) % 2 = 1 as before
    from leaves l join (select distinct level, k from nodes where n > 1) v on v.k = l.k
    left join nodes b on b.k = l.k and b.level = v.level and b.i = xor(l.i >> v.level, 1)
    union all
    select l.r, 1000 + v.level, coalesce(b.h, ''), (t.i >> v.level) % 2 = 1
    from leaves l join tops t on t.k = l.k cross join (select distinct level from above where n > 1) v
    left join above b on b.level = v.level and b.i = xor(t.i >> v.level, 1)
), numbered as materialized (select r, h, before, row_number() over (partition by r order by s) as s from steps
), fold(r, s, h) as (
    select r, 0, start from leaves
    union all
    select f.r, f.s + 1, sha256(case when p.before then p.h || f.h else f.h || p.h end) from fold f join numbered p on p.r = f.r and p.s = f.s + 1
), ends as (select r, arg_max(h, s) as folded_root from fold group by r
), proofs as (select r, sha256(string_agg(h, '' order by s)) as proof_sha256 from numbered group by r)
select l.doc_id, l.leaf, t.h as subroot, a.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = a.h as verified
from leaves l join tops t on t.k = l.k join ends e on e.r = l.r left join proofs p on p.r = l.r cross join (select h from above where n = 1) a
"""
