"""Document fingerprints (9): winnowing, with DataFrame functions only.

A text is read as its code points without white space. The 12 code points from each one on have a
Karp-Rabin hash, a polynomial of the code points modulo 2^31 - 1. It rolls by doubling: the hashes of 2,
4, 8 and 12 code points come from those of their two halves, one pass over the text each, so overlapping
grams share all their parts. Of every window of 16 consecutive hashes the smallest is kept, of equal ones
the rightmost. Two texts that share 27 consecutive code points share a kept hash, wherever the passage
starts in either and however the text around it is spaced, and its position (the number of its first code
point) is kept to find the match. A text shorter than a window keeps the smallest of what it has, one
shorter than 12 the hash of all its code points.

A hash and its position are one long: the upper 31 bits are the hash's, the lower 32 the complement of
the position, so that the smallest long is the smallest hash at its rightmost position.

The likeness of two fingerprints is the Dice coefficient of their sets of hashes; of two empty ones 1.

Defined cases: a null text is empty, an empty or blank one has an empty fingerprint; documents that
repeat an id follow one another by text; null ids come first; a single document follows itself; extra
columns are ignored; texts of any length that a row holds are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Code points in a hash (the sum of GRAM_PARTS) and hashes in a window, a power of two.
GRAM_POINTS = 12
WINDOW_POINTS = 16
#: The modulus and base of the polynomial.
PRIME = (1 << 31) - 1
BASE = 1_000_003
POSITION_BITS = 32

_POSITION = (1 << POSITION_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda in it refers to it."""
    return F.transform(F.array(value), body)[0]


def key(hashed: Column, at: Column) -> Column:
    return F.shiftleft(hashed, POSITION_BITS).bitwiseOR(F.lit(_POSITION) - at.cast("long"))


def _beside(values: Column, n: int, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of each value and the one ``n`` places on, as far as there is one."""
    pairs = lambda v: F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - n, F.lit(0))), F.slice(v, F.lit(n + 1), F.greatest(F.size(v) - n, F.lit(0))), body)
    return let(values, pairs)


def gram_hashes(codes: Column) -> Column:
    """The hashes of the 12 code points from each one on; ``codes`` has 12 or more."""
    rolled = lambda points: lambda x, y: (x * F.lit(pow(BASE, points, PRIME)) + y) % F.lit(PRIME)
    two = _beside(codes, 1, rolled(1))
    four = _beside(two, 2, rolled(2))

    def twelve(four: Column) -> Column:
        eight = _beside(four, 4, rolled(4))
        return let(eight, lambda e: F.zip_with(F.slice(e, F.lit(1), F.size(e) - 4), F.slice(four, F.lit(9), F.size(e) - 4), rolled(4)))

    return let(four, twelve)


def solid(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\p{Z}]+", "")


def point_keys(points: Column) -> Column:
    """Hash and position, as one long, of the code points (without white space) from each one on."""

    def of(codes: Column) -> Column:
        whole = F.aggregate(codes, F.lit(1).cast("long"), lambda h, c: (h * F.lit(BASE) + c) % F.lit(PRIME))
        long_enough = F.size(codes) >= GRAM_POINTS
        return F.when(long_enough, F.transform(gram_hashes(codes), key)).otherwise(F.array(key(whole, F.lit(0))))

    codes = lambda t: F.transform(F.split(t, ""), lambda c: F.ascii(c).cast("long"))
    return let(points, lambda t: F.when(t == "", F.array().cast("array<long>")).otherwise(let(codes(t), of)))


def _winnow(points: Column) -> Column:
    def of(keys: Column) -> Column:
        minima, width = keys, 1
        while width < WINDOW_POINTS:
            minima, width = _beside(minima, width, lambda x, y: F.least(x, y)), 2 * width
        return F.when(F.size(keys) > WINDOW_POINTS, F.array_distinct(minima)).when(F.size(keys) > 0, F.array(F.array_min(keys))).otherwise(keys)

    return let(point_keys(points), of)


def winnow_points(text: Column) -> Column:
    """The kept hashes of code points with their positions, in order of position."""
    return _winnow(solid(text))


def winnow_joined(head: Column, rest: Column, kept: Column, rest_kept: Column) -> Column:
    """``winnow_points`` of head and rest joined, both without white space.

    ``kept`` is that of a text that begins with head, ``rest_kept`` of one that begins with rest. Whether a
    hash is kept depends on the 15 hashes on either side alone: away from the seam and the end it is as in
    those texts, and only some tens of code points there are hashed again.
    """
    reach = WINDOW_POINTS - 1
    near, wide = GRAM_POINTS + reach, GRAM_POINTS + 2 * reach

    def joined(points: Column, a: Column, b: Column) -> Column:
        n = a + b
        between = lambda ks, first, last: F.filter(ks, lambda k: (position(k) >= first) & (position(k) <= last))
        moved = lambda ks, by: F.transform(ks, lambda k: k - by)

        def again(low: Column, high: Column, first: Column, last: Column) -> Column:
            return let(F.greatest(low, F.lit(0)), lambda lo: between(moved(_winnow(F.substring(points, lo + 1, high - lo)), lo), first, last))

        before, after = between(kept, F.lit(0), a - near), moved(between(rest_kept, F.lit(reach), b - near), a)
        seam, end = again(a - wide, a + wide, a - near + 1, a + reach - 1), again(n - wide, n, n - near + 1, n)
        short_rest = F.concat(before, again(a - wide, n, a - near + 1, n))
        return F.when(n < 2 * wide, _winnow(points)).when(b <= 2 * wide, short_rest).otherwise(F.concat(before, seam, after, end))

    # The lengths are counted once, not for each element that is compared with them.
    return let(F.length(head), lambda a: let(F.length(rest), lambda b: let(F.concat(head, rest), lambda points: joined(points, a, b))))


def position(key: Column) -> Column:
    return F.lit(_POSITION) - key.bitwiseAND(F.lit(_POSITION))


def hashes(keys: Column) -> Column:
    return F.array_distinct(F.transform(keys, lambda k: F.shiftright(k, POSITION_BITS)))


def as_text(keys: Column) -> Column:
    """``position:hash`` of each kept hash, joined by spaces."""
    return F.array_join(F.transform(keys, lambda k: F.concat(position(k).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftright(k, POSITION_BITS))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct hashes."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def _place(value: Column, marks: list[int]) -> Column:
    """How many of the sorted marks are at most the value (none for null): first among every so many, then between two of those."""
    step = max(1, int(len(marks) ** 0.5))
    some = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<long>")
    count = lambda xs: F.size(F.filter(xs, lambda m: F.coalesce(m <= value, F.lit(False))))
    coarse, fine = some(marks[step - 1 :: step]), F.array(*[some(marks[i : i + step]) for i in range(0, len(marks) + 1, step)])
    return let(count(coarse), lambda n: n * step + count(F.coalesce(F.get(fine, n), some([]))))


def with_next(docs: DataFrame, ranges: int | None = None, **made: Column) -> DataFrame:
    """``docs`` (doc_id and text) with the columns ``made`` and, as ``next`` and ``next_<name>``, the text and those columns of the next document.

    The order is ascending doc_id; after the last comes the first. Ranges of doc_id (twice as many as
    shuffle partitions, which follow the size of the input) are put in order on their own; the first row
    of each also stands at the end of the range before. The columns are made once, after the shuffle. The
    driver sees a few numbers of each range.
    """
    spark = docs.sparkSession
    n = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("b")).first().b or []
    ranged = docs.withColumn("range", _place(F.col("doc_id"), sorted(set(bounds))))
    firsts = sorted((r.range, r.first.doc_id) for r in ranged.groupBy("range").agg(F.min(F.struct("doc_id")).alias("first")).collect())  # a row for each range
    before = [(firsts[i - 1][0], doc_id) for i, (_, doc_id) in enumerate(firsts)]  # the first range's stands after the last
    guests = spark.createDataFrame(before, "guest_range int, guest_id long")
    rows = ranged.withColumn("late", F.lit(0)).unionByName(
        docs.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("guest_id"))).select(*docs.columns, F.col("guest_range").alias("range"), F.lit(1).alias("late"))
    )
    w = Window.partitionBy("range").orderBy("late", "doc_id", "text")
    rows = rows.repartition("range").withColumns(made) if made else rows
    return rows.withColumns({"next": F.lead("text").over(w), **{f"next_{c}": F.lead(c).over(w) for c in made}}).where("late = 0").drop("late", "range")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, as arrays of hash and position, and how alike they are.

    The edited text is the text with the last half of its characters replaced by as many of the next one's first.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    pairs = with_next(texts, kept=winnow_points(F.col("text"))).withColumns({"head": F.left("text", F.length("text") - half), "rest": F.left("next", half)})
    joined = winnow_joined(F.col("head_points"), F.col("rest_points"), F.col("kept"), F.col("next_kept"))
    both = pairs.withColumns({"head_points": solid(F.col("head")), "rest_points": solid(F.col("rest"))}).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.concat("head", "rest"), 256).alias("edited_sha256"), "kept", joined.alias("edited_kept"), "next_kept")
    sets = both.withColumns({"h": hashes(F.col("kept")), "eh": hashes(F.col("edited_kept")), "nh": hashes(F.col("next_kept"))})
    return sets.select("doc_id", "n_chars", "edited_sha256", "kept", "edited_kept", likeness(F.col("h"), F.col("eh")).alias("near_edited"), likeness(F.col("h"), F.col("nh")).alias("near_next"))


def op9_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprint_edits(table(spark, folder, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("kept")).alias("fingerprint"), as_text(F.col("edited_kept")).alias("edited_fingerprint"), "near_edited", "near_next")
