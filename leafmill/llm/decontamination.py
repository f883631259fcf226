"""Benchmark decontamination (2): a broadcast hash set of benchmark n-grams, scanned over all texts.

Words are runs of ASCII digits, ASCII letters (lower-cased) and any non-ASCII characters. A
benchmark item gives one window for each 10 consecutive words; a shorter item, if it has a word, is
one window as a whole. A document's word is hit if it lies in an occurrence of a window.

The index (distinct words, window rows and their 64-bit hashes) goes to the executors only when the
benchmark's text is at most ``max_broadcast_bytes``. A larger benchmark is joined by window text
instead, in a shuffle that AQE splits where one window is hot. Hash hits are compared word by word
before they count.

Defined cases: a null or wordless text has no words and no hits; items with a null id or no words
are ignored; items repeated under one id count once; repeated documents each give their row, and rows that
share a doc_id, or have none, are judged each by its own text, whatever the benchmark's size; extra
columns are ignored by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import table

WINDOW = 10
MAX_BROADCAST_BYTES = 4 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_REPORT = (
    "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:int,last:int>>"
)


def words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WindowIndex:
    """Benchmark windows, by length: sorted hashes, the word ids behind them and the items that hold them."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.word_id: dict[bytes, int] = {}
        holders: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            ids = tuple(self.word_id.setdefault(w, len(self.word_id) + 1) for w in words(text))
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                holders[n][ids[i : i + n]].add(item_id)
        self.by_length = {n: self._sorted(n, found) for n, found in holders.items()}

    @staticmethod
    def _powers(n: int, attempt: int) -> np.ndarray:
        base = (0x9E3779B97F4A7C15 + 2 * attempt * 0xD1342543DE82EF95) | 1
        return np.array([pow(base, j + 1, 1 << 64) for j in range(n)], dtype=np.uint64)

    def _sorted(self, n: int, found: dict):
        rows = np.array(list(found), dtype=np.int32).reshape(len(found), n)
        for attempt in range(64):  # until no two windows share a hash
            powers = self._powers(n, attempt)
            hashes = (rows.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            if len(np.unique(hashes)) == len(rows):
                break
        holders = [sorted(x) for x in found.values()]
        return powers, hashes[order], rows[order], [holders[i] for i in order]

    def scan(self, ws: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None: none) and the items whose windows occur."""
        total = len(ws)
        if not total or not self.by_length:
            return None, set()
        ids = np.fromiter(map(self.word_id.get, ws, repeat(0)), dtype=np.int32, count=total)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        edges, items = None, set()
        for n, (powers, hashes, rows, holders) in self.by_length.items():
            if total < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            grams = ids[at[:, None] + np.arange(n)]
            h = (grams.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
            where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = (hashes[where] == h) & (rows[where] == grams).all(axis=1)
            at, where = at[same], where[same]
            if len(at):
                edges = np.zeros(total + 1, dtype=np.int32) if edges is None else edges
                np.add.at(edges, at, 1)
                np.add.at(edges, at + n, -1)
                for k in np.unique(where):
                    items.update(holders[k])
        return (None if edges is None else np.cumsum(edges[:-1]) > 0), items


def _spans(hit: np.ndarray | None) -> list[tuple[int, int]]:
    """Runs of hit words as (first, last) word numbers from 0."""
    if hit is None:
        return []
    turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(turns[::2], turns[1::2])]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(
        "item_id is not null and text is not null"
    )


def _broadcast_index(benchmark: DataFrame, max_broadcast_bytes: int):
    """The index as a broadcast variable, or None when the benchmark is over the bound."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_broadcast_bytes:
        return None
    rows = [(r.item_id, r.text) for r in items.collect()]  # at most max_broadcast_bytes of text
    return benchmark.sparkSession.sparkContext.broadcast(WindowIndex(rows))


def contamination(
    docs: DataFrame, benchmark: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, items (sorted) and the spans of hit words."""
    index = _broadcast_index(benchmark, max_broadcast_bytes)
    if index is None:
        return _contamination_by_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark).drop("digest")

    def scan(batches):
        for pdf in batches:
            out = []
            for text in pdf.text:
                ws = words(text)
                hit, items = index.value.scan(ws)
                out.append((len(ws), 0 if hit is None else int(hit.sum()), sorted(items), _spans(hit)))
            n, hits, items, spans = zip(*out) if out else ((), (), (), ())
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_words": n, "n_hit": hits, "items": items, "spans": [[{"first": a, "last": b} for a, b in x] for x in spans]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(scan, _REPORT)


def _digest():
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _word_column(text):
    """The same words as an array, in the JVM."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)


def _grams(ws, n):
    """Windows of n words, as joined texts, by their first word's number."""
    return F.transform(
        F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice(ws, i + 1, n), " ").alias("gram")),
    )


def _contamination_by_join(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For benchmarks too large to broadcast: windows of both sides meet in an equi-join on their text.

    The rows of ``contamination`` and the sha2 digest of each text.
    """
    ws = F.col("ws")
    items = _items(benchmark).select("item_id", _word_column(F.col("text")).alias("ws")).where("size(ws) > 0")
    held = (
        items.select("item_id", F.explode(_grams(ws, F.least(F.lit(WINDOW), F.size(ws)))).alias("g"))
        .select("g.gram", "g.n", "item_id")
        .distinct()
    )
    lengths = [r.n for r in held.select("n").distinct().collect()]  # at most WINDOW values
    keyed = docs.select("doc_id", _digest().alias("digest"), _word_column(F.col("text")).alias("ws"))
    hits = (
        keyed.dropDuplicates(["doc_id", "digest"])
        .select("doc_id", "digest", F.explode(F.flatten(F.array(*[_grams(ws, F.lit(n)) for n in lengths]))).alias("g"))
        .select("doc_id", "digest", "g.at", "g.n", "g.gram")
        if lengths
        else keyed.select("doc_id", "digest", F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("gram")).limit(0)
    ).join(held, ["gram", "n"])
    per_doc = hits.groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.collect_set(F.struct("at", "n")).alias("runs")
    )
    joined = keyed.alias("d").join(
        per_doc.alias("h"),
        F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.digest") == F.col("h.digest")),
        "left",
    )
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r.at, r.at + r.n - 1)))))
    covered = F.coalesce(covered, F.array().cast("array<int>"))
    beside = lambda i, step: F.coalesce(F.get("covered", i + step) == F.get("covered", i) + step, F.lit(False))
    firsts = F.filter("covered", lambda x, i: ~beside(i, -1))
    lasts = F.filter("covered", lambda x, i: ~beside(i, 1))
    spans = F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return (
        joined.withColumn("covered", covered)
        .select(
            F.col("d.doc_id").alias("doc_id"),
            F.col("d.digest").alias("digest"),
            F.size("ws").cast("long").alias("n_words"),
            F.size("covered").cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            spans.alias("spans"),
        )
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without each run of hit words (first, last), from its first word to its last."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    out, done = [], 0
    for first, last in spans:
        out.append(raw[done : at[first][0]])
        done = at[last][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """The documents without contaminated ones (``remove="documents"``) or without the hit words (``"spans"``).

    Columns and clean rows stay as they are. No shuffle unless the benchmark is over the bound.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    index = _broadcast_index(benchmark, max_broadcast_bytes)
    if index is None:
        return _decontaminate_by_join(docs, benchmark, remove)

    at = docs.columns.index("text")

    def clean(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).to_pylist()
            hits = [index.value.scan(words(t))[0] for t in texts]
            if remove == "documents":
                yield batch.filter(pa.array([h is None for h in hits], pa.bool_()))
            else:
                left = [t if h is None else without_spans(t, _spans(h)) for t, h in zip(texts, hits)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(left, batch.schema.field(at).type))

    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots are no names for mapInArrow
    return numbered.mapInArrow(clean, numbered.schema).toDF(*docs.columns)


def _decontaminate_by_join(docs: DataFrame, benchmark: DataFrame, remove: str) -> DataFrame:
    """The same rows as by the broadcast index: a row is judged by its own text, whatever rows share its doc_id.

    Rows go along as structs, so that no name of theirs can clash.
    """
    found = _contamination_by_join(docs.select("doc_id", "text"), benchmark).where("n_hit > 0").dropDuplicates(["doc_id", "digest"])
    found = found.select(F.col("doc_id").alias("found_id"), F.col("digest").alias("found_digest"), "spans")
    rows = docs.select("doc_id", _digest().alias("digest"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("digest") == F.col("found_digest"))
    column = lambda c: F.col(f"row.`{c}`").alias(c)
    if remove == "documents":
        return rows.join(found, same, "left_anti").select(*map(column, docs.columns))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            left = [t if spans is None else without_spans(t, [(x["first"], x["last"]) for x in spans]) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], ["row", "left"])

    judged = rows.join(found, same, "left").select("row", "text", "spans")
    schema = StructType([judged.schema["row"], StructField("left", StringType())])
    return judged.mapInArrow(cut, schema).select(*[F.col("left").alias(c) if c == "text" else column(c) for c in docs.columns])


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
), b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark where text is not null and item_id is not null
), bw as (
  select item_id, least(10, len(ws)) as n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) as i, ws from b where len(ws) > 0
), bg as (select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as gram from bw
), dw as (
  select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from w, (select distinct n from bg) where len(ws) >= n
), hits as (
  select doc_id, i, n, item_id from (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as gram from dw) join bg using (gram, n)
), hit_words as (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as k from hits
), counts as (select doc_id, count(*) as n_hit from hit_words group by doc_id
), held as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from hits group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join counts using (doc_id) left join held using (doc_id)
"""
