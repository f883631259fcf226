"""N-gram Jaccard join (13): sets of word n-grams linked by similarity, with skipping between related sets.

A text's words are maximal runs without white space (A-Z lower-cased); its set has the distinct runs of
four words, or the whole sequence where there are fewer. Shingles are told apart by 64-bit hashes and
equal sets are one node from the start. Two nodes link when ``100 * both >= percent * either``.

Every set has its shingles in one global order: first those that are not frequent, by hash, then the
frequent ones by how often they occur. Two linked sets share a shingle among the first
``n - ceil(percent * n / 100) + 1`` of each (their prefixes), so each shingle of a prefix has a list of
the sets that hold it, with the set's size and the shingle's position. Which shingles are frequent is
told by a summary of fixed size: each task reports the shingles that it meets most, over all texts.

- In each list one set (the center) is compared with all; afterwards only sets outside the list's largest component
  are compared further (see ``components``), so that thousands of variants cost few pairs. No pair that
  could still join two components stays unchecked.
- Pairs of a short list that their sizes and positions do not rule out are told once, however many lists they share,
  and judged by their sketches and then by their texts. Long lists of one center meet as one, and their pairs stay in their tasks:
- Long lists are kept in blocks of near sizes and positions. Two sets that meet at positions i and j share at
  most the smaller of n - i and m - j shingles; where the largest sizes and smallest positions of two blocks
  rule a link out, the pair of blocks is skipped as a whole.
- Where blocks meet, sketches (how many shingles fall into each class of hashes) come first; only the texts of sets
  that may then still have a link with the other block move.
- In a pair of blocks the sets are taken in order of their components, and the overlaps of one with all
  sets of the other block are derived from those of the one before it: only the shingles in which
  the two differ are looked up, their number permitting.

Defined cases: a null, empty or blank text has an empty set and links with nothing; repeated rows each
give a row; a null doc_id is never a component's id unless all its ids are null; extra columns, whatever
their names, are ignored; a very long text is shingled whole; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import megabytes_of, table, written
from .components import all_components, with_component
from .line_dedup import BITMAP_BITS, _bitmap

GRAM = 4
PERCENT = 85
#: Shingles that a task's summary reports at most, and frequent shingles that are told to all tasks.
REPORTED = 1 << 14
FREQUENT = 1 << 17
#: Members outside a list's largest component that its first round compares with all.
CENTERS = 16
#: Sets of a list from which on it is cut into blocks, and meets as one with the other such lists of its center; shingles of a block.
LONG = 64
BLOCK = 1 << 18
#: Pairs of sketches that are compared at once.
PAIRS = 1 << 17
#: Shingles for each class of a sketch, and classes at most.
CLASS, CLASSES = 8, 1 << 10

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    return x ^ (x >> np.uint64(33))


def gram_set(text: str | None, gram: int = GRAM) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    gram = min(gram, len(words))
    rolled = np.full(len(words) - gram + 1, gram, dtype=np.uint64)
    for j in range(gram):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashed[j : j + len(rolled)])
    return np.unique(rolled)


def node_of(grams: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(grams.tobytes())).view(np.int64))


def sketch(grams: np.ndarray) -> bytes | None:
    """How many shingles fall into each class of hashes, a power of two of them; None where a count takes more than a byte."""
    classes = min(CLASSES, 1 << max(0, int(len(grams)) // CLASS).bit_length())
    counts = np.bincount((grams & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return counts.astype(np.uint8).tobytes() if len(grams) and counts.max() < 256 else None


def most_shared(x: bytes | None, y: bytes | None, n: int, m: int) -> int:
    """No fewer than the shingles that sets of n and m share, by their sketches."""
    if x is None or y is None:
        return min(n, m)
    a, b = (np.frombuffer(s, dtype=np.uint8).astype(np.int32) for s in (x, y))
    k = min(len(a), len(b))  # a class of fewer ones holds several of more
    return int(np.minimum(a.reshape(-1, k).sum(axis=0), b.reshape(-1, k).sum(axis=0)).sum())


def needed(n, m, percent: int = PERCENT):
    """The least overlap of linked sets of n and m shingles."""
    return -((-percent * (n + m)) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n) // 100 + 1


class Summary:
    """Counts of the items seen most, in bounded memory: what is cut off lowers all other counts alike."""

    def __init__(self, most: int):
        self.most, self.items, self.counts = most, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, items: np.ndarray) -> None:
        new, n = np.unique(items, return_counts=True)
        all_, inverse = np.unique(np.concatenate([self.items, new]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([self.counts, n]), len(all_)).astype(np.int64)
        if len(all_) > 16 * self.most:
            counts -= np.partition(counts, -self.most - 1)[-self.most - 1]
        self.items, self.counts = all_[counts > 0], counts[counts > 0]

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        kept = np.argsort(-self.counts, kind="stable")[: self.most]
        kept = kept[self.counts[kept] > 1]
        return self.items[kept], self.counts[kept]


def measured(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, n, node, sketch) of every document, and (token, times) rows of the tasks' summaries."""

    def measure(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()), ("token", pa.int64()), ("times", pa.int64())])
        summary, seen, waiting, size = Summary(REPORTED), set(), [], 0
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in megabytes_of(texts):
                sets = [gram_set(t, gram) for t in texts[a:b]]
                nodes = [node_of(s) if len(s) else None for s in sets]
                for s, node in zip(sets, nodes):
                    if node is not None and node not in seen:
                        seen.add(node)
                        waiting.append(s)
                        size += len(s)
                if size > 1 << 20:
                    summary.add(np.concatenate(waiting))
                    waiting, size = [], 0
                if len(seen) > 500_000:
                    seen.clear()
                own = batch.slice(a, b - a)
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), none, none], schema=schema)
        if waiting:
            summary.add(np.concatenate(waiting))
        items, counts = summary.top()
        none = pa.nulls(len(items), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(items), pa.binary()), pa.array(items.view(np.int64)), pa.array(counts)], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return own.mapInArrow(measure, "doc_id long, text_key long, n long, node long, sketch binary, token long, times long")


def frequent_shingles(reported: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT shingles, sorted, and their counts: all those of a count's order of magnitude, or none of them."""
    counts = reported.groupBy("token").agg(F.sum("times").alias("times")).where("times >= 8").withColumn("size", F.floor(F.log2("times")))
    counts = written(counts, "frequent-shingles")
    least, total = None, 0
    for size, n in sorted(counts.groupBy("size").count().collect(), reverse=True):  # at most 63 rows
        total += n
        if total > FREQUENT:
            break
        least = size
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    kept = counts.where(F.col("size") >= least).select("token", "times").toArrow()
    tokens, times = kept.column(0).to_numpy().view(np.uint64), kept.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], times[order]


def prefix(grams: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set in the global order."""
    tokens, times = frequent
    length = prefix_length(len(grams), percent)
    if not len(tokens):
        return grams[:length]
    at = np.minimum(np.searchsorted(tokens, grams), len(tokens) - 1)
    often = tokens[at] == grams
    rare = grams[~often]
    if len(rare) >= length:
        return rare[:length]
    rest, counts = grams[often], times[at[often]]
    return np.concatenate([rare, rest[np.argsort(counts, kind="stable")]])[:length]


def index_lists(docs: DataFrame, frequent, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(key, node, n, pos) of every shingle in a set's prefix; a task gives each set once."""
    told = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT shingles

    def lists(batches):
        import pyarrow as pa

        seen: set = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in megabytes_of(texts):
                keys, rows = [], []
                for text in texts[a:b]:
                    grams = gram_set(text, gram)
                    if len(grams) and (node := node_of(grams)) not in seen:
                        seen.add(node)
                        keys.append(prefix(grams, told.value, percent))
                        rows.append((node, len(grams)))
                if len(seen) > 500_000:
                    seen.clear()
                if keys:
                    held = [len(k) for k in keys]
                    node, n = (np.repeat(np.array(x, dtype=np.int64), held) for x in zip(*rows))
                    pos = np.concatenate([np.arange(h, dtype=np.int64) for h in held])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node), pa.array(n), pa.array(pos)], ["key", "node", "n", "pos"])

    return docs.where("text is not null").select("text").mapInArrow(lists, "key long, node long, n long, pos long")


def _possible(x: str, y: str, percent: int) -> F.Column:
    """Whether sets of sizes n that meet at positions pos can link; with ``low`` and ``high``, whether any of two blocks can."""
    n = lambda side, end: F.col(f"{side}.{end}n")
    low, high = ("", "") if not x.endswith("block") else ("low_", "high_")
    need = F.ceil(F.lit(percent) * (n(x, low) + n(y, low)) / F.lit(100 + percent))
    return F.least(n(x, high) - F.col(f"{x}.{low}pos"), n(y, high) - F.col(f"{y}.{low}pos")) >= need


class Answers:
    """Overlaps of sets with all sets of a block, each derived from the one before where the two are alike."""

    def __init__(self, sets: list[np.ndarray]):
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner, self.n = tokens[order], owner[order], len(sets)
        self.last, self.known = None, None

    def _counted(self, tokens: np.ndarray) -> np.ndarray:
        first, stop = np.searchsorted(self.tokens, tokens), np.searchsorted(self.tokens, tokens, side="right")
        held = stop - first
        at = np.repeat(first - (np.cumsum(held) - held), held) + np.arange(held.sum())
        return np.bincount(self.owner[at], minlength=self.n)

    def of(self, grams: np.ndarray) -> np.ndarray:
        found = None
        if self.last is not None:
            new, gone = np.setdiff1d(grams, self.last, assume_unique=True), np.setdiff1d(self.last, grams, assume_unique=True)
            if len(new) + len(gone) < len(grams):
                found = self.known + self._counted(new) - self._counted(gone)
        self.last, self.known = grams, self._counted(grams) if found is None else found
        return self.known


class _Sets:
    """The distinct sets that have candidates: their sketches, and their texts when they are asked for."""

    def __init__(self, docs: DataFrame, sets: DataFrame, nodes: DataFrame, gram: int, percent: int):
        self.docs, self.gram, self.percent = docs, gram, percent
        own = sets.join(nodes, "node", "left_semi").groupBy("node")
        self.known = written(own.agg(F.min("text_key").alias("text_key"), F.min("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) whose sketches do not rule a link out, written."""
        side = lambda c: self.known.select(F.col("node").alias(c), F.struct("n", "sketch").alias(f"of_{c}"))
        percent, kept = self.percent, pairs.columns

        def judge(batches):
            import pyarrow as pa

            for batch in batches:
                rows = zip(*(batch.column(batch.schema.get_field_index(f"of_{c}")).to_pylist() for c in "ab"))
                good = [most_shared(x["sketch"], y["sketch"], x["n"], y["n"]) >= needed(x["n"], y["n"], percent) for x, y in rows]
                yield batch.filter(pa.array(good, pa.bool_())).select(kept)

        schema = ", ".join(f"{c} long" for c in kept)
        return written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(judge, schema), "possible-pairs")

    def texts(self, pairs: DataFrame) -> DataFrame:
        """(node, text) of the sets in the pairs, each once.

        The scan is told by a bitmap of fixed size which texts may be asked for; the join decides.
        """
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = written(self.known.join(nodes, "node", "left_semi").select("text_key", F.col("node").alias("of")), "asked-texts")
        at = F.pmod("text_key", F.lit(BITMAP_BITS))
        found = self.docs.where("text is not null").select(F.xxhash64("text").alias("text_key"), "text")
        found = found.join(F.broadcast(_bitmap(asked.select(F.col("text_key").alias("node")))), F.floor(at / 64) == F.col("word"))
        found = found.where(F.expr(f"shiftrightunsigned(bits, cast(pmod(text_key, {BITMAP_BITS}L) % 64 as int)) & 1 = 1"))
        one_each = found.groupBy("text_key").agg(F.first("text").alias("text"))
        return written(one_each.join(asked, "text_key").select(F.col("of").alias("node"), "text"), "candidate-texts")


def _linked(pairs: DataFrame, sets: _Sets) -> DataFrame:
    """The pairs (a, b) that are links, each judged by its texts."""
    possible = sets.possible(pairs)
    texts, gram, percent = sets.texts(possible), sets.gram, sets.percent
    side = lambda c, text: texts.select(F.col("node").alias(c), F.col("text").alias(text))
    sides = possible.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y")

    def judge(batches):
        import pyarrow as pa

        at, grams = None, None
        for batch in batches:
            good = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != at:  # a center's pairs come together
                    at, grams = a, gram_set(x.as_py(), gram)
                other = gram_set(y.as_py(), gram)
                good.append(len(np.intersect1d(grams, other, assume_unique=True)) >= needed(len(grams), len(other), percent))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return sides.mapInArrow(judge, "a long, b long")


def _pairs_of_lists(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): chosen members and members of other components of the same list that may link by their places in it."""
    side = lambda name: F.struct("node", "component", "n", "pos").alias(name)
    met = members.where("chosen").select("key", side("x")).join(members.select("key", side("y")), "key")
    met = met.where((F.col("x.component") != F.col("y.component")) & _possible("x", "y", percent))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _meetings(members: DataFrame, centers: int, percent: int) -> DataFrame:
    """(meeting, side, component, node, n, pos): chosen members (side 0) and all members of a list (1), where two of their blocks may hold a link."""
    width = math.log(100 / percent)
    placed = members.withColumns({"size": F.floor(F.log("n") / F.lit(width)), "band": F.floor(64 * F.col("pos") / F.col("n"))})

    def blocks(rows: DataFrame, many, salt: int, name: str) -> DataFrame:
        seats = F.ceil(many * F.exp((F.col("size") + 1) * F.lit(width)) / F.lit(BLOCK)).cast("long")
        seat = F.pmod(F.xxhash64("node", F.lit(salt)), F.greatest(F.lit(1), F.least(seats, many)))
        held = rows.groupBy("key", "size", "band", seat.alias("seat")).agg(F.min("n").alias("low_n"), F.max("n").alias("high_n"), F.min("pos").alias("low_pos"), F.collect_list(F.struct("component", "node", "n", "pos")).alias("held"))
        return held.select("key", F.struct(F.struct("size", "band", "seat").alias("at"), "low_n", "high_n", "low_pos", "held").alias(name))

    asking = blocks(placed.where("chosen"), F.least("waiting", F.lit(centers)), 1, "x_block")
    met = asking.join(blocks(placed, F.col("members"), 2, "y_block"), "key").where(_possible("x_block", "y_block", percent))
    sided = lambda side, held: F.transform(held, lambda e: F.struct(F.lit(side).alias("side"), e.component.alias("component"), e.node.alias("node"), e.n.alias("n"), e.pos.alias("pos")))
    both = F.concat(sided(0, "x_block.held"), sided(1, "y_block.held"))
    return met.select(F.xxhash64("key", "x_block.at", "y_block.at").alias("meeting"), F.explode(both).alias("e")).select("meeting", "e.*")


def _by_meeting(rows: DataFrame, judge, schema: str) -> DataFrame:
    """``judge`` applied to whole meetings, many at once, as pandas in order of (meeting, side, component)."""
    dealt = rows.repartition("meeting").sortWithinPartitions("meeting", "side", "component", "node")

    def each(batches):
        import pandas as pd

        carried = None
        for batch in batches:
            pdf = batch if carried is None else pd.concat([carried, batch])
            last = (pdf.meeting == pdf.meeting.iloc[-1]).to_numpy()  # may go on in the next batch
            carried = pdf[last]
            if not last.all():
                yield judge(pdf[~last].reset_index(drop=True))
        if carried is not None:
            yield judge(carried.reset_index(drop=True))

    return dealt.mapInPandas(each, schema)


def _ranges(pdf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, rows of side 0, rows of side 1) of each meeting."""
    meeting, side = pdf.meeting.to_numpy(), pdf.side.to_numpy()
    first = np.flatnonzero(np.concatenate(([True], meeting[1:] != meeting[:-1])))
    asked = np.add.reduceat(side, first)
    return first, np.diff(first, append=len(pdf)) - asked, asked


def _pairs(first: np.ndarray, nx: np.ndarray, ny: np.ndarray):
    """Places (i, j) of each side's rows in all meetings, PAIRS of them or one meeting's at a time."""
    counts = nx * ny
    at, ends = 0, np.cumsum(counts)
    while at < len(counts):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        c, part = counts[at:stop], slice(at, stop)
        t = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        width = np.repeat(ny[part], c)
        yield np.repeat(first[part], c) + t // np.maximum(width, 1), np.repeat(first[part] + nx[part], c) + t % np.maximum(width, 1)
        at = stop


class _Sketches:
    """Sketches of rows, compared many pairs at once: first folded to a few classes, then as they are."""

    FEW = 16

    def __init__(self, sketches: list):
        self.length = np.array([0 if s is None else len(s) for s in sketches])
        self.place, self.by_length = np.zeros(len(sketches), dtype=np.int64), {}
        for k in np.unique(self.length[self.length > 0]):
            own = np.flatnonzero(self.length == k)
            self.place[own] = np.arange(len(own))
            self.by_length[int(k)] = np.frombuffer(b"".join(sketches[i] for i in own), dtype=np.uint8).reshape(-1, k)
        self._folded: dict = {}

    def _matrix(self, length: int, classes: int) -> np.ndarray:
        if (length, classes) not in self._folded:
            self._folded[length, classes] = self.by_length[length].reshape(-1, length // classes, classes).sum(axis=1, dtype=np.int32)
        return self._folded[length, classes]

    def share(self, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether the sketches of rows i and j do not rule out that they share ``least``; without a sketch nothing is ruled out."""
        out = np.ones(len(i), dtype=bool)
        for few in (True, False):
            for a in self.by_length:
                for b in self.by_length:
                    k = min(a, b)
                    if few and k <= self.FEW:
                        continue
                    k = self.FEW if few else k
                    at = np.flatnonzero(out & (self.length[i] == a) & (self.length[j] == b))
                    x, y = self._matrix(a, k), self._matrix(b, k)
                    step = max(1, (1 << 20) // k)
                    for s in range(0, len(at), step):
                        part = at[s : s + step]
                        most = np.minimum(x[self.place[i[part]]], y[self.place[j[part]]]).sum(axis=1)
                        out[part] = most >= least[part]
        return out


def _meet(members: DataFrame, centers: int, sets: _Sets) -> DataFrame:
    """Links (a, b) of the chosen members with other components of their list.

    Pairs of short lists are told once, however many lists they share, and judged like those of the centers.
    """
    short = _linked(_pairs_of_lists(members.where(F.col("members") <= LONG), sets.percent), sets)
    long = members.where(F.col("members") > LONG)
    return short if long.isEmpty() else short.unionByName(_meet_in_blocks(long, centers, sets)).distinct()


def _meet_in_blocks(members: DataFrame, centers: int, sets: _Sets) -> DataFrame:
    """Links (a, b) of the chosen members of long lists; pairs stay in their tasks.

    Sketches meet first, and of those the sets that may have a link with a set of the other block; only their texts move.
    """
    gram, percent = sets.gram, sets.percent
    rows = _meetings(members, centers, percent).join(sets.known.select("node", "sketch"), "node").select("meeting", "side", "component", "node", "n", "pos", "sketch")

    def possible(pdf):
        component, n, pos = pdf.component.to_numpy(), pdf.n.to_numpy(), pdf.pos.to_numpy()
        kept, sketches = np.zeros(len(pdf), dtype=bool), _Sketches(pdf.sketch.tolist())
        for i, j in _pairs(*_ranges(pdf)):
            apart = component[i] != component[j]
            i, j = i[apart], j[apart]
            least = needed(n[i], n[j], percent)
            near = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least
            i, j, least = i[near], j[near], least[near]
            good = sketches.share(i, j, least)
            kept[i[good]] = kept[j[good]] = True
        return pdf.loc[kept, ["meeting", "side", "component", "node"]]

    left = written(_by_meeting(rows, possible, "meeting long, side int, component long, node long"), "possible-meetings")
    texts = sets.texts(left.select(F.col("node").alias("a"), F.col("node").alias("b")))

    def links(pdf):
        import pandas as pd

        out, component, node, texts_ = [], pdf.component.to_numpy(), pdf.node.to_numpy(), pdf.text.to_numpy()
        for at, nx, ny in zip(*_ranges(pdf)):
            if not nx or not ny:
                continue
            held = [gram_set(t, gram) for t in texts_[at : at + nx + ny]]
            n, c, y = np.array([len(g) for g in held]), component[at : at + nx + ny], np.arange(nx, nx + ny)
            answers = Answers(held[nx:])
            for i in range(nx):
                both = answers.of(held[i])
                good = y[(both >= needed(n[i], n[y], percent)) & (c[y] != c[i])]
                _, one = np.unique(c[good], return_index=True)  # of several links with a component one is enough
                out += [(min(node[at + i], node[at + j]), max(node[at + i], node[at + j])) for j in good[one]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return _by_meeting(left.join(texts, "node").select("meeting", "side", "component", "node", "text"), links, "a long, b long").distinct()


def candidate_lists(docs: DataFrame, reported: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the lists' centers with members that they may link with, and (key, node, center, n, pos) of the lists with three sets or more.

    The center of a list is its smallest set. Long lists with one center are one, which has each set once.
    """
    lists = written(index_lists(docs, frequent_shingles(reported), gram, percent), "index-lists")
    ends = lists.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("top"), F.count("*").alias("held")).where("center <> top").drop("top")
    held = written(lists.join(ends, "key"), "candidate-lists")
    centers = held.where("node = center").select("key", F.struct("n", "pos").alias("y")).distinct()
    star = held.where("node <> center").join(centers, "key").withColumn("x", F.struct("n", "pos"))
    first = star.where(_possible("x", "y", percent)).select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    # A list of two sets has no other pair. A task gives a set once, so that copies may count as sets here; they are one later.
    key = F.when(F.col("held") > LONG, F.xxhash64(F.lit("center"), "center")).otherwise(F.col("key")).alias("key")
    merged = held.where("held > 2").groupBy(key, "center", "node").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    return first, merged.select("key", "node", "center", "n", "pos")


def components(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every document, and (node, component) of the nodes that have links."""
    found = written(measured(docs, gram), "shingle-sets")
    sets = found.where("n is not null").drop("token", "times")
    first, star = (written(df, "list-stars") for df in candidate_lists(docs, found.where("token is not null"), gram, percent))
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(star.select("node")).distinct()
    held = _Sets(docs, sets, nodes, gram, percent)
    labels = all_components(star, lambda pairs: _linked(pairs, held), lambda members, centers: _meet(members, centers, held), CENTERS, first)
    return sets, labels


def jaccard_join(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, n_shingles, node (null: empty) and component_id."""
    sets, labels = components(docs, gram, percent)
    nodes = with_component(sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")), labels)
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "component").select("node", "component_id")
    joined = sets.join(named, "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "node", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive words as materialized (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') as w from documents
), sets as materialized (
    select r, doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as s
    from words
), tokens as materialized (select r, unnest(s) as t from sets
), sizes as materialized (select r, len(s) as n from sets
), pairs as materialized (select x.r as a, y.r as b, count(*) as shared from tokens x join tokens y on x.t = y.t where x.r < y.r group by x.r, y.r
), linked as materialized (select a, b from pairs join sizes p on p.r = a join sizes q on q.r = b where 100 * shared >= 85 * (p.n + q.n - shared)
), links as materialized (select a, b from linked union all select b, a from linked
), reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a)
select s.doc_id, cast(any_value(n.n) as bigint) as n_shingles, least(s.doc_id, min(o.doc_id)) as component_id
from words s join sizes n on n.r = s.r left join reach on reach.a = s.r left join words o on o.r = reach.b
group by s.r, s.doc_id
"""
