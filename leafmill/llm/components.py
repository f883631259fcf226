"""Connected components and candidate links, as joins and aggregates over tables of edges.

Nothing here collects links or components: each round contracts the graph in the shared folder, and
the driver sees only whether edges are left. Edges and buckets may repeat; a null node takes no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: By how much the number of members that a round compares with all others of their bucket grows.
GROWTH = 8
#: Steps of the hash that picks those members.
PARTS = 1 << 30


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is its smallest node.

    Each round, every node points at its smallest neighbour's smallest neighbour (or itself, where that
    is smaller), and the edges are redrawn between what their ends point at. That keeps connected what
    is connected, and the smallest node of a component points at itself.
    """
    left = written(edges.select(*_ordered("a", "b")).where("a < b").distinct(), "edges")
    rounds = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("to"))
        onward = points.select(F.col("a").alias("to"), F.col("to").alias("root"))
        points = written(points.join(onward, "to").select("a", F.col("root").alias("to")), "pointers")
        rounds.append(points)
        a, b = (points.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        ends = left.join(a, "a").join(b, "b")
        last, left = left, written(ends.select(*_ordered("a_to", "b_to")).where("a < b").distinct(), "edges")
        discard(last)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds[0].select(F.col("a").alias("node"), F.col("to").alias("component"))
    for points in rounds[1:]:  # each later round moves what the one before pointed at
        moved = points.select(F.col("a").alias("component"), F.col("to"))
        labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    if len(rounds) > 1:
        labels = written(labels, "labels")
        discard(*rounds)
    return labels


def stars(keyed: DataFrame, key: str = "key", node: str = "node") -> DataFrame:
    """Rows (key, node, center) of the buckets that have two nodes or more; center is the smallest node.

    The smallest and largest node of a bucket come from an aggregate that combines before its shuffle,
    and join back to the members, so that a bucket of any size is split among tasks.
    """
    ends = keyed.groupBy(key).agg(F.min(node).alias("center"), F.max(node).alias("top")).where("center <> top").drop("top")
    return keyed.join(ends, key).select(key, node, "center").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links; a node that has no label yet is its own component."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = connected_components(named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    onward = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = labels.join(onward, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(known.unionByName(moved.join(labels, "node", "left_anti").select("node", "component")), "labels")


def _open_members(active: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """The members, with component, of the buckets that hold several components and ``least`` members or more.

    ``largest`` is the component with the most members, ``waiting`` the number of members outside it,
    ``members`` that of all.
    """
    named = active.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), (F.sum("n") - F.max("n")).alias("waiting"), F.sum("n").alias("members"))
    return named.join(mixed.where((F.col("waiting") > 0) & (F.col("members") >= least)), "key")


def all_components(star: DataFrame, verify, meet, centers: int, first: DataFrame | None = None) -> DataFrame:
    """(node, component) by all pairs of a bucket that are links.

    ``star`` has (key, node, center) and what else ``meet`` needs: the buckets, and the member that a node is
    compared with first. ``first`` are the pairs (a, b), a < b, of members with their centers that can be links
    (unless given, all). ``verify`` maps pairs (a, b) to those that are links. ``meet`` maps members (key, node, center,
    component, waiting, members, chosen) and the number of chosen ones to expect of a bucket to links
    (a, b) of the chosen ones with other components of their bucket; of several links with a component one is enough.

    After the stars, the largest component of a bucket needs no comparison within itself. Of the members
    outside it about ``centers`` (by a hash) are compared with all members of other components and then
    leave the bucket, the components are drawn again, and so on until every bucket is one component. The
    number chosen grows with each round, so the rounds are few; where members are alike, most are in the
    largest component after the first one. No pair of a bucket stays unchecked whose ends are not connected.
    """
    if first is None:
        first = star.where("node <> center").select(*_ordered("center", "node")).distinct()
    labels = connected_components(verify(first))
    active, least, past = star, 3, []  # the two of a pair have met
    while True:
        chosen = (F.col("component") != F.col("largest")) & (F.pmod(F.xxhash64("node", F.lit(centers)), F.lit(PARTS)) * F.col("waiting") < F.lit(PARTS * centers))
        members = written(_open_members(active, labels, least).withColumn("chosen", chosen), "open-members")
        discard(*past)
        if members.isEmpty():
            return labels
        links = written(meet(members, centers), "links")
        if not links.isEmpty():
            labels = _merged(labels, links)
        discard(links)
        past = [members]
        active, least, centers = members.where("not chosen").select(star.columns), 2, centers * GROWTH


def with_component(nodes: DataFrame, labels: DataFrame, node: str = "node") -> DataFrame:
    """``nodes`` with their component; a node without links is its own."""
    named = labels.select(F.col("node").alias(node), "component")
    return nodes.join(named, node, "left").withColumn("component", F.coalesce("component", node))
