"""Packing (4): fill windows by non-negative least squares over shallow length combinations.

Each document's ids (its tokens and one end id) are cut into whole windows, which are sequences of
their own, and a remainder shorter than the window. The histogram of remainder lengths (fewer bins
than the window has tokens) goes to the driver. There the combinations of two or three lengths that
fill a window exactly are enumerated, the repeat counts x >= 0 that minimise |Ax - h|^2 are found by
accelerated projected gradient, rounded down and kept feasible. Remainders then take the places of
the combinations by their rank within their length. What is left is packed greedily: hash buckets of
a bounded number of tokens, each laid end to end and cut at window ends.

Ranks come from counts per input partition, so no length, however common, meets in one task. Ids are
written once to the shared folder; only remainders move in a shuffle.

Defined cases: a null or empty text is its end id alone; every input row gives pieces, repeated rows
and null ids included; no documents give no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .encoding import encoder, packed

WINDOW = 1024
#: Tokens in a bucket of leftovers; each bucket ends in at most one padded sequence.
BUCKET_TOKENS = 64 * WINDOW
#: Three-part combinations have at least one part that is a multiple of this.
GRID = 128
STEPS = 400

_TOKENS = (
    "part int, row long, doc_id long, doc_tokens long, full_crcs array<long>, full_before long, "
    "rem_len int, rem_rank long, rem_crc long, rem_ids binary, full_ids array<binary>"
)
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenized(docs: DataFrame, path: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    """A row for each document: its windows' checksums (and ids, if asked for) and its remainder, numbered within the input partition."""

    def encode(batches):
        coder, end = encoder(path), packed([end_id])
        part, row, full = TaskContext.get().partitionId(), 0, 0
        ranks: Counter = Counter()
        for pdf in batches:
            out = []
            for doc_id, ids in zip(pdf.doc_id, coder.encode(list(pdf.text))):
                ids += end
                n, rest = len(ids) // 4, len(ids) // 4 % window
                cuts = [ids[i * 4 * window : (i + 1) * 4 * window] for i in range(n // window)]
                crcs = [zlib.crc32(x) for x in cuts]
                tail = ids[len(ids) - 4 * rest :]
                out.append((part, row, doc_id, n, crcs, full, rest, ranks[rest], zlib.crc32(tail), tail, cuts if with_ids else None))
                ranks[rest] += 1
                row, full = row + 1, full + len(crcs)
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in _TOKENS.split(", ")])
            yield frame.assign(doc_id=frame.doc_id.astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(encode, _TOKENS)


def combinations(window: int, grid: int = GRID) -> np.ndarray:
    """Length combinations that fill the window: rows (a, b, c), c = 0 for pairs."""
    pairs = [(a, window - a, 0) for a in range(1, window // 2 + 1)]
    triples = {tuple(sorted((a, g, window - a - g))) for g in range(grid, window, grid) for a in range(1, window - g)}
    return np.array(pairs + sorted(triples), dtype=np.int64).reshape(-1, 3)


def least_squares(parts: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises |Ax - h|^2; column p of A counts the lengths in combination p."""
    size = len(histogram)

    def apply(x):
        y = sum(np.bincount(parts[:, j], weights=x, minlength=size) for j in range(3))
        y[0] = 0
        return y

    def transpose(r):
        return r[parts].sum(axis=1)

    v = np.ones(len(parts))
    for _ in range(30):
        v = transpose(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, x, y, t = 1 / (1.05 * norm), np.zeros(len(parts)), np.zeros(len(parts)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * transpose(apply(y) - histogram))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


class Plan:
    """Which combination each ranked remainder takes: for each length, runs of ranks."""

    def __init__(self, histogram: np.ndarray, window: int):
        left = histogram.astype(np.int64).copy()
        parts = combinations(window)
        x = least_squares(parts, histogram.astype(float)) if histogram.sum() else np.zeros(len(parts))
        runs = defaultdict(list)  # length -> (first rank, combination's first sequence, copies in it, offset of the first)
        self.sequences = 0

        def place(combination, repeats):
            sizes = Counter(int(a) for a in combination if a)
            at = 0
            for length, copies in sorted(sizes.items(), reverse=True):
                used = int(histogram[length] - left[length])
                runs[length].append((used, self.sequences, copies, at))
                left[length] -= copies * repeats
                at += length * copies
            self.sequences += int(repeats)

        def possible(combination):
            return min(int(left[a]) // c for a, c in Counter(int(a) for a in combination if a).items())

        for p in np.argsort(-x, kind="stable"):
            if x[p] < 1:
                break
            if (repeats := min(int(x[p]), possible(parts[p]))) > 0:
                place(parts[p], repeats)
        for p in range(window // 2):  # pairs that rounding left over
            if (repeats := possible(parts[p])) > 0:
                place(parts[p], repeats)
        self.runs = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in runs.items()}
        self.placed = {k: int(histogram[k] - left[k]) for k in runs}
        self.left_tokens = int((left * np.arange(len(left))).sum())

    def seat(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the remainders of a length, by rank."""
        first, sequence, copies, at = self.runs[length]
        k = np.searchsorted(first, ranks, side="right") - 1
        q = ranks - first[k]
        return sequence[k] + q // copies[k], at[k] + q % copies[k] * length


def _prefix(df: DataFrame, value: str, order: str, alias: str, by: list[str] | None = None) -> DataFrame:
    """Sums of ``value`` over the rows before, over a table of a row for each input partition or bucket."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(alias, F.coalesce(F.sum(value).over(w), F.lit(0)))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW, bucket_tokens: int = BUCKET_TOKENS, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids.

    ``ids`` are little-endian unsigned 32-bit integers (null unless ``with_ids``); ``sequences`` lays the
    pieces into padded windows. Sequences are numbered without gaps: whole windows first, then
    combinations, then leftovers.
    """
    tokens = written(tokenized(docs, tokenizer_path, end_id, window, with_ids), "tokens")
    counts = tokens.groupBy("part", "rem_len").agg(F.count("*").alias("n"), F.sum(F.size("full_crcs")).alias("full"))
    counts = written(counts, "remainder-counts")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in counts.where("rem_len > 0").groupBy("rem_len").agg(F.sum("n").alias("n")).collect():  # below window rows
        histogram[r.rem_len] = r.n
    plan = Plan(histogram, window)
    n_full = counts.agg(F.sum("full")).first()[0] or 0

    by_part = _prefix(counts.groupBy("part").agg(F.sum("full").alias("full")), "full", "part", "full_base").select("part", "full_base")
    ranks = _prefix(counts, "n", "part", "rank_base", ["rem_len"]).select("part", "rem_len", "rank_base")
    placed = F.create_map(*[F.lit(x) for k, v in plan.placed.items() for x in (k, v)]) if plan.placed else F.create_map(F.lit(-1), F.lit(0))
    ranked = (
        tokens.join(ranks.join(by_part, "part"), ["part", "rem_len"])
        .withColumn("rank", F.col("rank_base") + F.col("rem_rank"))
        .withColumn("left", (F.col("rem_len") > 0) & (F.col("rank") >= F.coalesce(F.try_element_at(placed, F.col("rem_len")), F.lit(0))))
    )

    def seated(batches):
        for pdf in batches:
            full = pdf.full_crcs.map(len).to_numpy(dtype=np.int64)
            k = np.repeat(np.arange(len(pdf)), full)
            i = np.arange(len(k)) - np.repeat(np.cumsum(full) - full, full)
            crcs = np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf.full_crcs]) if len(k) else i
            doc = pdf.doc_id.astype("Int64")
            yield pd.DataFrame({
                "doc_id": doc.iloc[k].array, "start": i * window, "length": window, "ids_crc32": crcs, "doc_tokens": pdf.doc_tokens.to_numpy()[k],
                "sequence_id": (pdf.full_base + pdf.full_before).to_numpy()[k] + i, "offset": 0, "ids": [x for xs in pdf.full_ids if xs is not None for x in xs] if with_ids else None,
            })
            rest = pdf[(pdf.rem_len > 0) & ~pdf.left]
            for length, rows in rest.groupby("rem_len"):
                sequence, at = plan.seat(int(length), rows["rank"].to_numpy())
                yield pd.DataFrame({
                    "doc_id": rows.doc_id.astype("Int64").array, "start": rows.doc_tokens.to_numpy() - length, "length": length, "ids_crc32": rows.rem_crc.to_numpy(),
                    "doc_tokens": rows.doc_tokens.to_numpy(), "sequence_id": n_full + sequence, "offset": at, "ids": rows.rem_ids.array if with_ids else None,
                })

    narrow = ["doc_id", "doc_tokens", "full_crcs", "full_before", "full_base", "rem_len", "rem_crc", "rank", "left"]
    pieces = ranked.select(*narrow, *(["full_ids", "rem_ids"] if with_ids else [])).mapInPandas(seated, _PIECES)

    buckets = max(1, -(-plan.left_tokens // bucket_tokens))
    left = ranked.where("left").withColumn("bucket", F.pmod(F.xxhash64("part", "row"), F.lit(buckets)))
    order = Window.partitionBy("bucket").orderBy("part", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = left.withColumn("begin", F.sum("rem_len").over(order) - F.col("rem_len"))
    bases = ranked.where("left").groupBy(F.pmod(F.xxhash64("part", "row"), F.lit(buckets)).alias("bucket")).agg(F.ceil(F.sum("rem_len") / window).alias("used"))
    bases = _prefix(bases, "used", "bucket", "base").select("bucket", (F.col("base") + n_full + plan.sequences).alias("base"))

    def cut(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                done = 0
                while done < r.rem_len:
                    at = (r.begin + done) % window
                    n = min(r.rem_len - done, window - at)
                    ids = r.rem_ids[4 * done : 4 * (done + n)]
                    out.append((r.doc_id, r.doc_tokens - r.rem_len + done, n, zlib.crc32(ids), r.doc_tokens, r.base + (r.begin + done) // window, at, ids if with_ids else None))
                    done += n
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in _PIECES.split(", ")])
            yield frame.assign(doc_id=frame.doc_id.astype("Int64"))

    rest = left.join(bases, "bucket").select("doc_id", "doc_tokens", "rem_len", "rem_ids", "begin", "base").mapInPandas(cut, _PIECES)
    return pieces.unionByName(rest)


def sequences(pieces: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """(sequence_id, ids binary): the pieces of each sequence laid end to end, padded to a power of two or the window.

    A sequence has at most ``window`` pieces, so a group is bounded.
    """

    def lay(batches):
        for pdf in batches:
            out = []
            for parts in pdf.parts:
                ids = b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["offset"]))
                n = len(ids) // 4
                out.append(ids + packed([pad_id]) * ((n if n & (n - 1) == 0 else window) - n))
            yield pd.DataFrame({"sequence_id": pdf.sequence_id, "ids": out})

    grouped = pieces.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("parts"))
    return grouped.mapInPandas(lay, "sequence_id long, ids binary")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), byte_bpe_path(), with_ids=False).drop("ids")
