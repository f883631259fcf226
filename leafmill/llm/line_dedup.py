"""Line dedup (3): fuzzy lines by MinHash, one line kept per component.

Equal lines are one node from the start. A node is its line's 64-bit XXH64; a second, independent
64-bit hash goes along, and lines whose first hashes agree but second hashes differ are left alone.
Each distinct line has the set of its 7-character shingles (a shorter line is one shingle), 56 minimum
hashes and 14 bands of 4; two lines of similarity 0.8 share a band with a probability of 0.9994, of
0.9 with 0.999996. In each band's buckets the smallest node is compared with all, and then only what
is outside the bucket's largest component (see ``components``), in blocks of some hundred lines whose
maps of shingles rule most pairs out. Candidates count as links when their exact Jaccard similarity is
0.8 or more. Of each component the first line stays: that with the smallest doc_id, then the earliest
in its text.

Texts are read where they lie: only hashes, ids and the lines that are in candidate pairs move in
shuffles. Which lines those are is told to the scan by a bitmap of fixed size (2 MiB), which may let
through others but never drops one; the join decides. Beyond some ten million candidate lines the
bitmap lets most lines through, and each distinct line moves once.

Defined cases: blank lines are never removed; a null text has no lines; lines of a null doc_id come
first; rows that repeat both doc_id and text are one document and come out alike; a document that
loses all its non-blank lines goes; extra columns, whatever their names, are kept by
``deduplicate_lines``; a very long line is shingled whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .components import all_components

SHINGLE = 7
SIMILARITY = 0.8
BANDS = 14
ROWS = 4
#: Bits of the bitmap that tells the scan which lines are in candidate pairs.
BITMAP_BITS = 1 << 24
#: Bits in a line's map of its shingles.
MAP_BITS = 1 << 13
#: Lines of a bucket in a block that one task compares with another block.
MEET = 512
#: Pairs of lines that a task holds at once, but for those of one pair of blocks.
MOST_PAIRS = 50_000
#: Characters that are signed at once, and lines (whose numbers fit above a hash's bits).
BLOCK = 1 << 16
MOST_LINES = 1 << 12
#: Lines whose bands go on together, the smallest of each bucket naming it.
SIGNED = 20_000
_HASH_BITS = np.uint64(52)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _blocks(lines: list[str], most: int):
    """(start, stop) of slices of at most ``most`` characters and MOST_LINES lines, or one line."""
    start = 0
    while start < len(lines):
        stop, size = start, 0
        while stop < min(len(lines), start + MOST_LINES) and (stop == start or size + len(lines[stop]) <= most):
            size += len(lines[stop])
            stop += 1
        yield start, stop
        start = stop


def _shingle_hashes(lines: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lines' shingles one after another, and the number of each line's."""
    powers = [np.uint64(pow(0x100000001B3, j, 1 << 64)) for j in range(shingle)]
    block = [x if len(x) >= shingle else x + "\x00" * (shingle - len(x)) for x in lines]
    lengths = np.fromiter(map(len, block), dtype=np.int64, count=len(block))
    chars = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    most = len(chars) - shingle + 1
    rolled = chars[:most] * powers[0]
    for j in range(1, shingle):
        rolled += chars[j : most + j] * powers[j]
    inside = np.ones(most, dtype=bool)
    ends = np.cumsum(lengths)
    for j in range(1, shingle):  # shingles that would cross into the next line
        cross = ends[:-1] - j
        inside[cross[cross < most]] = False
    return _mixed(rolled[inside]), lengths - shingle + 1


def _tagged(of: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Distinct hashes, in order, with the number of their line in the upper bits."""
    keys = np.sort((of.astype(np.uint64) << _HASH_BITS) | (hashed >> (np.uint64(64) - _HASH_BITS)))
    return keys[np.flatnonzero(np.diff(keys, prepend=~keys[:1]))]


def signatures(lines: list[str], shingle: int = SHINGLE, n: int = BANDS * ROWS) -> np.ndarray:
    """Minimum hashes of the lines' shingles, (lines x n): the minima of x + p * y for two hashes of each shingle."""
    out = np.zeros((len(lines), n), dtype=np.uint32)
    for start, stop in _blocks(lines, BLOCK):
        hashed, counts = _shingle_hashes(lines[start:stop], shingle)
        v, step = (hashed >> np.uint64(32)).astype(np.uint32), hashed.astype(np.uint32) | np.uint32(1)
        first = np.cumsum(counts) - counts
        for p in range(n):
            out[start:stop, p] = np.minimum.reduceat(v, first)
            v += step
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """40-bit bucket keys, (lines x bands)."""
    keys = np.zeros((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, dtype=np.uint64)
        for r in range(rows):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        keys[:, b] = h >> np.uint64(24)
    return keys.view(np.int64)


def shingles(line: str, shingle: int = SHINGLE) -> set[str]:
    return {line[i : i + shingle] for i in range(max(1, len(line) - shingle + 1))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def similar(xs: list[str], ys: list[str], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether the Jaccard similarity of the shingles of each pair of lines is ``similarity`` or more.

    Shingles are counted by their hashes; a pair within 4 shingles of the limit is judged by the
    shingles themselves.
    """
    out = np.zeros(len(xs), dtype=bool)
    for start, stop in _blocks([x if len(x) > len(y) else y for x, y in zip(xs, ys)], BLOCK * 4):
        pairs, keys = stop - start, []
        for side in (xs, ys):
            hashed, held = _shingle_hashes(side[start:stop])
            keys.append(_tagged(np.repeat(np.arange(pairs), held), hashed))
        n, m, both = (np.bincount(k >> _HASH_BITS, minlength=pairs) for k in (*keys, np.intersect1d(*keys, assume_unique=True)))
        over = both * (1 + similarity) - similarity * (n + m)
        out[start:stop] = over >= 0
        for i in np.flatnonzero(np.abs(over) <= 4 * (1 + similarity)):
            out[start + i] = jaccard(shingles(xs[start + i]), shingles(ys[start + i])) >= similarity
    return out


def first_links(xs: np.ndarray, ys: np.ndarray, groups: np.ndarray, bounds: np.ndarray, lines: list[str], similarity: float) -> np.ndarray:
    """Of pairs (places in ``lines``) those found to be links: one for each group that has any, the likeliest pairs first.

    Pairs of a group are judged 1, 2, 4, ... at a time until one is a link or none is left.
    """
    order = np.lexsort((-bounds, groups))
    nth = np.arange(len(order)) - np.searchsorted(groups[order], groups[order])
    found, start, size = [], 0, 1
    left = order
    while len(left):
        now = left[(nth >= start) & (nth < start + size)]
        if len(now):
            good = now[similar([lines[i] for i in xs[now]], [lines[i] for i in ys[now]], similarity)]
            _, one = np.unique(groups[good], return_index=True)
            found.append(good[one])
            open_ = ~np.isin(groups[left], groups[good]) & (nth >= start + size)
        else:
            open_ = nth >= start + size
        left, nth = left[open_], nth[open_]
        start, size = start + size, 2 * size
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def possible_pairs(lines: list[str], x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the lines at ``x`` with those at ``y`` that maps of their shingles do not rule out, with a bound of their similarity.

    A bit that one line's map has and the other's lacks is a shingle that the other line lacks.
    """
    if len(x) * len(y) <= 32:
        return np.repeat(x, len(y)), np.tile(y, len(x)), np.ones(len(x) * len(y))
    counts, maps = np.zeros(len(lines)), np.zeros((len(lines), MAP_BITS), dtype=np.float32)
    for start, stop in _blocks(lines, BLOCK * 4):
        hashed, held = _shingle_hashes(lines[start:stop])
        of = np.repeat(np.arange(stop - start), held)
        counts[start:stop] = np.bincount(_tagged(of, hashed) >> _HASH_BITS, minlength=stop - start)
        maps[start + of, hashed % np.uint64(MAP_BITS)] = 1
    bits, both = maps.sum(axis=1), maps[x] @ maps[y].T
    most = np.minimum(counts[x, None] - bits[x, None] + both, counts[None, y] - bits[None, y] + both)  # at most so many shingles in common
    bound = most / (counts[x, None] + counts[None, y] - most)
    i, j = np.nonzero(bound >= similarity - 1e-6)
    return x[i], y[j], bound[i, j]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def solid(line: Column) -> Column:
    """Whether a line has a character that is not white space."""
    return line.rlike(r"(?U)[^\s\x1c-\x1f]")


def node_of(line: Column) -> Column:
    return F.xxhash64(line)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, node and check of every line that is not blank."""
    lines = _keyed(docs).select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(solid(F.col("line")))
    return lines.select("doc_id", "text_key", "line_no", node_of(F.col("line")).alias("node"), F.xxhash64(F.lit(1), "line").alias("check"))


def _distinct_lines(texts: list[str], seen: set) -> tuple[list[str], np.ndarray]:
    """The lines of a batch that this task has not had yet, and their nodes."""
    from xxhash import xxh64_intdigest

    lines = list(dict.fromkeys(x for t in texts for x in t.split("\n") if x and not x.isspace()))
    node = np.array([xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in lines], dtype=np.uint64).view(np.int64)
    new = [i for i, h in enumerate(node.tolist()) if h not in seen]
    if len(seen) > 300_000:
        seen.clear()
    seen.update(node[new].tolist())
    return [lines[i] for i in new], node[new]


def _met_here(keys: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, smallest node of the key in this batch), and whether the key has several."""
    key, node = keys.ravel(), np.repeat(node, keys.shape[1])
    order = np.argsort(key)
    key, node = key[order], node[order]
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    held = np.diff(first, append=len(key))
    return key, node, np.repeat(np.minimum.reduceat(node, first), held), np.repeat(held > 1, held)


def banded(docs: DataFrame) -> DataFrame:
    """(key, node, met) of every distinct line and band; a task gives each line once.

    Of SIGNED lines those in one bucket all name the smallest as ``met``; a line alone there names none.
    """

    def sign(batches):
        import pyarrow as pa

        seen: set = set()
        for texts in (batch.column(0).slice(k, 2000) for batch in batches for k in range(0, batch.num_rows, 2000)):
            lines, node = _distinct_lines(texts.to_pylist(), seen)
            for a in range(0, len(lines), SIGNED):
                key, own, met, several = _met_here(band_keys(signatures(lines[a : a + SIGNED])), node[a : a + SIGNED])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(met, mask=~several)], ["key", "node", "met"])

    return docs.where("text is not null").select("text").mapInArrow(sign, "key long, node long, met long")


def line_stars(docs: DataFrame) -> DataFrame:
    """(key, node, center) of the buckets with two lines or more.

    The smallest of SIGNED lines in a bucket meets those of the others; the rest have met it
    already and do not move with their bucket, so that a bucket of any size is spread over the tasks.
    """
    apart = F.when(F.col("met").isNull() | (F.col("met") == F.col("node")), 0).otherwise(1 + F.pmod("node", F.lit(4096)))
    w = Window.partitionBy("key", "apart")
    ends = banded(docs).withColumn("apart", apart).withColumns({"least": F.min("node").over(w), "most": F.max("node").over(w)})
    return ends.where("met is not null or least <> most").select("key", "node", F.when(F.col("apart") == 0, F.col("least")).otherwise(F.col("met")).alias("center")).distinct()


def _bitmap(nodes: DataFrame) -> DataFrame:
    """(word, bits): a bitmap of the nodes' hashes of at most BITMAP_BITS / 64 rows."""
    at = F.pmod("node", F.lit(BITMAP_BITS))
    return nodes.select(F.floor(at / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(node, {BITMAP_BITS}L) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line) of the given nodes, with their numbers of shingles and the maps of them; a hash of two lines has none."""
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("node", node_of(F.col("line")))
    lines = lines.join(F.broadcast(_bitmap(nodes)), F.floor(F.pmod("node", F.lit(BITMAP_BITS)) / 64) == F.col("word"))
    lines = lines.where(F.expr(f"shiftrightunsigned(bits, cast(pmod(node, {BITMAP_BITS}L) % 64 as int)) & 1 = 1"))
    check = F.xxhash64(F.lit(1), "line")
    lines = lines.groupBy("node").agg(F.first("line").alias("line"), F.min(check).alias("a"), F.max(check).alias("b")).where("a = b")
    return lines.select("node", "line").join(nodes, "node", "left_semi")


def _meet(members: DataFrame, centers: int, texts: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) of the chosen members with other components of their bucket.

    Chosen ones (about ``centers``) and members of a bucket are dealt into blocks of about ``block`` lines,
    and each pair of blocks is compared in one task; only links leave it.
    """
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    nx, ny = blocks(F.least("waiting", F.lit(centers))), blocks(F.col("members"))
    seat = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    place = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    asks = F.when(F.col("chosen"), F.transform(upto(ny), lambda y: place(0, seat(1, nx), y))).otherwise(F.array().cast("array<struct<side:int,x:int,y:int>>"))
    is_asked = F.transform(upto(nx), lambda x: place(1, x, seat(2, ny)))
    rows = members.join(texts, "node").select("key", "node", "component", "line", F.explode(F.concat(asks, is_asked)).alias("at")).select("key", "at.x", "at.y", "at.side", "node", "component", "line")
    dealt = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def compare(batches):
        carried = None

        def links(pdf):
            pdf = pdf.reset_index(drop=True)
            lines, side, component, node = list(pdf.line), pdf.side.to_numpy(), pdf.component.to_numpy(), pdf.node.to_numpy()
            pairs: list[tuple] = []

            def found():
                x, y, bound = map(np.concatenate, zip(*pairs))
                pairs.clear()
                order = np.lexsort((component[y], node[x]))
                new = (np.diff(node[x[order]], prepend=0) != 0) | (np.diff(component[y[order]], prepend=0) != 0)
                groups = np.empty(len(x), dtype=np.int64)
                groups[order] = np.cumsum(new)
                good = first_links(x, y, groups, bound, lines, similarity)
                p, q = node[x[good]], node[y[good]]
                return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)})

            for at in pdf.groupby(["key", "x", "y"], sort=False).indices.values():
                asking, asked = at[side[at] == 0], at[side[at] == 1]
                if len(asking) and len(asked):
                    x, y, bound = possible_pairs([lines[i] for i in at], np.searchsorted(at, asking), np.searchsorted(at, asked), similarity)
                    x, y = at[x], at[y]
                    apart = component[x] != component[y]
                    pairs.append((x[apart], y[apart], bound[apart]))
                    if sum(len(p[0]) for p in pairs) > MOST_PAIRS:
                        yield found()
            if pairs:
                yield found()

        for pdf in batches:
            pdf = pdf if carried is None else pd.concat([carried, pdf])
            last = (pdf[["key", "x", "y"]] == pdf[["key", "x", "y"]].iloc[-1]).all(axis=1)  # may go on in the next batch
            carried = pdf[last]
            if not last.all():
                yield from links(pdf[~last])
        if carried is not None:
            yield from links(carried)

    return dealt.mapInPandas(compare, "a long, b long").distinct()


def line_components(docs: DataFrame, similarity: float = SIMILARITY, block: int = MEET) -> tuple[DataFrame, DataFrame]:
    """The occurrences of lines, and (node, component) of the lines that have links."""
    lines = written(occurrences(docs), "lines")
    star = written(line_stars(docs), "line-stars")
    texts = written(texts_of(docs, written(star.select("node").distinct(), "candidates")), "candidate-lines")

    side = lambda c, line: texts.select(F.col("node").alias(c), F.col("line").alias(line))

    def verify(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")

        def exact(batches):
            import pyarrow as pa

            for batch in batches:
                yield batch.select([0, 1]).filter(pa.array(similar(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity)))

        return sides.mapInArrow(exact, "a long, b long")

    return lines, all_components(star, verify, lambda members, centers: _meet(members, centers, texts, similarity, block), block)


def _drops(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, text_key, dropped) of the documents that lose lines: the numbers of those, in order."""
    lines, labels = line_components(docs, similarity)
    place = F.struct("doc_id", "text_key", "line_no")
    nodes = lines.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n"), (F.min("check") != F.max("check")).alias("clash"))
    nodes = nodes.join(labels, "node", "left").where("(n > 1 or component is not null) and not clash").withColumn("component", F.coalesce("component", "node"))
    keeper = nodes.groupBy("component").agg(F.min("first").alias("kept"))
    nodes = nodes.join(keeper, "component").select("node", "kept")
    gone = lines.join(nodes, "node").where(~place.eqNullSafe(F.col("kept")))
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def n_lines(text: Column) -> Column:
    """The number of lines that are not blank."""
    return F.coalesce(F.size(F.filter(F.split(text, "\n", -1), solid)), F.lit(0))


def _with_drops(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_key and more) with ``dropped``, empty where nothing is."""
    found = drops.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), F.col("dropped").alias("found"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left")
    return joined.withColumn("dropped", F.coalesce("found", F.array().cast("array<int>"))).drop("found_id", "found_key", "found")


def dropped_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document that has lines: doc_id, text_key, n_lines and the numbers of those dropped."""
    own = _keyed(docs).select("doc_id", "text_key", n_lines(F.col("text")).alias("n_lines")).where("n_lines > 0").distinct()
    return _with_drops(own, _drops(docs, similarity))


def deduplicate_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without dropped lines; ``n_chars``, if there, is the new length."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged, text = _with_drops(rows, _drops(docs, similarity)), F.col("row.text")
    judged = judged.where((F.size("dropped") == 0) | (F.size("dropped") < n_lines(text)))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    new = F.when(F.size("dropped") > 0, kept).otherwise(text)
    out = {"text": new}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.size("dropped") > 0, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return judged.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document: doc_id, n_lines (not blank), n_dropped and the dropped lines' numbers from 0."""
    docs = table(spark, folder, "documents")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), n_lines(F.col("text")).alias("n_lines"))
    found = _with_drops(own, _drops(docs, SIMILARITY))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")
