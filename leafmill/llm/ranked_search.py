"""Ranked lexical search (11): the best documents for each of a table of queries, by the Best Position Algorithm.

Terms are maximal runs of ASCII letters (A-Z lower-cased), digits and any non-ASCII characters. A document's
score is the sum, over a query's terms with repeats, of weight times impact in 64-bit integers (see ``impacts``
and ``weights``).

One scan counts terms and keeps, for each document, those that a query has; document frequencies come from
an aggregate over all of them. Then each task turns blocks of documents into impact lists: for each term the
documents by falling impact. All lists of a query are read downwards together; a document that is met is
looked up in all its lists at once (direct access), which marks its positions there as seen. The best position
of a list is the end of its unbroken run of seen positions, usually far below what was read. No document that
is not yet met can score more than the impacts just below the best positions add up to; when that sum is
strictly below the k-th best score so far, reading stops. The k best of a task carry over from block to block, and
the k best of the tasks are ranked by a window. Postings never move: only k rows a query and task do.

Queries go to the tasks in slices of at most ``SLICE`` bytes of distinct text, so their number is free.

Defined cases: a null text or one without a term is no document and no query; documents that repeat an id
are ranked each, equal scores by ascending doc_id, null ids last; queries that repeat an id or a text, or
have none, are answered each; texts of any length are read in pieces; extra columns are ignored; no documents
or no queries give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import megabytes_of, table, written

BEST = 10
#: Bytes of distinct query text that go to the tasks at once.
SLICE = 4 << 20
#: Postings in a block, and positions that are read from each list at first.
BLOCK = 1 << 20
FIRST = 16
PIECE = 4 << 20

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def terms_of(text: str | None):
    """The terms of a text, some megabytes at a time."""
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
    start = 0
    while start < len(raw):
        gap = _GAP.search(raw, start + PIECE) if start + PIECE < len(raw) else None
        stop = gap.start() if gap else len(raw)
        yield _TERM.findall(raw, start, stop)
        start = stop


def weights(df: dict, documents: int) -> dict:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """1e9 tf div (1000 tf + 8 m), with m = 25 + 75 n N div L."""
    m = 25 + 75 * length * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that have a term: its number of terms, and those of the vocabulary."""
    told = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in megabytes_of(texts):
                ns, ids, tfs = [], [], []
                for text in texts[a:b]:
                    n, found = 0, np.zeros(len(told.value) + 1, dtype=np.int64) if text and len(text) > PIECE else None
                    own: list = []
                    for some in terms_of(text):
                        n += len(some)
                        own.append(np.fromiter(map(told.value.get, some, repeat(-1)), dtype=np.int64, count=len(some)))
                        if found is not None:  # a long text is counted piece by piece
                            found += np.bincount(own.pop() + 1, minlength=len(found))
                    if found is not None:
                        k = np.flatnonzero(found[1:])
                        tf = found[k + 1]
                    else:
                        k, tf = np.unique(own[0] if own else np.zeros(0, dtype=np.int64), return_counts=True)
                        k, tf = k[k >= 0], tf[k >= 0]
                    ns.append(n)
                    ids.append(k.astype(np.int32))
                    tfs.append(tf)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ns, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0")


class ImpactLists:
    """The impact lists of a block of documents, with every document's postings for direct access."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, held: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.none = ids, none
        self.first = np.concatenate(([0], np.cumsum(held)))
        self.terms, self.impact = terms, impact
        order = np.lexsort((-impact, terms))
        self.list_doc = np.repeat(np.arange(len(held)), held)[order]
        self.list_impact = impact[order]
        self.place = np.empty(len(order), dtype=np.int64)  # of a posting in the lists
        self.place[order] = np.arange(len(order))
        self.start = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def look_up(self, docs: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents, and the places of their postings that count."""
        held = self.first[docs + 1] - self.first[docs]
        at = np.repeat(self.first[docs] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        w = weight[self.terms[at]]
        kept = np.flatnonzero(w)
        at = at[kept]
        scores = np.zeros(len(docs), dtype=np.int64)
        np.add.at(scores, np.repeat(np.arange(len(docs)), held)[kept], w[kept] * self.impact[at])
        return scores, self.place[at]

    def search(self, terms: np.ndarray, factor: np.ndarray, weight: np.ndarray, best: list, k: int) -> tuple[list, int]:
        """The k best (-score, no id, doc_id) among ``best`` and this block, and how many documents were met.

        ``weight`` holds ``factor`` at ``terms`` and 0 elsewhere.
        """
        start, stop = self.start[terms], self.start[terms + 1]
        some = stop > start
        start, stop, factor = start[some], stop[some], factor[some]
        read, position = start.copy(), start.copy()  # position: the first place of each list that is not seen
        seen, met = np.zeros(len(self.list_doc), dtype=bool), np.zeros(len(self.ids), dtype=bool)
        step, n_met = FIRST, 0
        while True:
            last = stop - 1
            bound = int((factor * np.where(position < stop, self.list_impact[np.minimum(position, last)], 0)).sum()) if len(start) else 0
            kth = -best[k - 1][0] if len(best) >= k else 1
            if bound < kth:
                return best, n_met
            until = np.minimum(read + step, stop)
            held = np.maximum(until - read, 0)
            at = np.repeat(read - (np.cumsum(held) - held), held) + np.arange(held.sum())
            new = np.unique(self.list_doc[at])
            new = new[~met[new]]
            met[new] = True
            n_met += len(new)
            if len(new):
                scores, places = self.look_up(new, weight)
                seen[places] = True
                good = np.flatnonzero(scores >= max(1, kth))
                if len(good):
                    rows = zip((-scores[good]).tolist(), self.none[new[good]].tolist(), self.ids[new[good]].tolist())
                    best = sorted([*best, *rows])[:k]
            for i in range(len(start)):
                rest = seen[position[i] : stop[i]]
                gap = int(np.argmin(rest)) if len(rest) else 0
                position[i] = stop[i] if len(rest) and rest[gap] else position[i] + gap
            read, step = until, 2 * step


def _search(held: DataFrame, queries: list, n_terms: int, documents: int, total: int, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of every task for each query (query, terms, factors)."""
    told = held.sparkSession.sparkContext.broadcast(queries)

    def find(batches):
        import pyarrow as pa

        best: list[list] = [[] for _ in told.value]
        weight = np.zeros(n_terms, dtype=np.int64)

        def block(rows):
            ids, n, terms, tfs = (pa.chunked_array([r.column(c) for r in rows]).combine_chunks() for c in range(4))
            held = np.diff(terms.offsets.to_numpy())
            flat = impacts(tfs.flatten().to_numpy(), np.repeat(n.to_numpy(), held), documents, total)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            lists = ImpactLists(ids.fill_null(0).to_numpy(), none, held, terms.flatten().to_numpy().astype(np.int64), flat, n_terms)
            for i, (_, t, factor) in enumerate(told.value):
                weight[t] = factor
                best[i], _ = lists.search(t, factor, weight, best[i], k)
                weight[t] = 0

        rows, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(c).slice(a, 4096)]) for c in range(4)], ["doc_id", "n", "terms", "tfs"])
                rows.append(part)
                size += len(part.column(2).flatten())
                if size >= BLOCK:
                    block(rows)
                    rows, size = [], 0
        if rows:
            block(rows)
        out = [(q, None if none else doc, -score) for (q, _, _), found in zip(told.value, best) for score, none, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["query", "doc_id", "score"])

    return held.mapInArrow(find, "query long, doc_id long, score long")


def _slice(docs: DataFrame, texts: list[tuple[int, str]], k: int) -> DataFrame:
    counted = [(key, Counter(t for some in terms_of(text) for t in some)) for key, text in texts]
    vocabulary = sorted(set().union(*(c for _, c in counted)))
    number = {t: i for i, t in enumerate(vocabulary)}
    held = written(postings(docs, vocabulary), "postings")
    documents, total = held.agg(F.count("*"), F.sum("n")).first()
    df = {i: n for i, n in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # at most one row for each query term
    weight = weights(df, documents)
    queries = []
    for key, counts in counted:
        found = sorted((i, c * weight[i]) for t, c in counts.items() if (i := number[t]) in df)
        found = [x for x in found if x[1]]
        queries.append((key, np.array([i for i, _ in found], dtype=np.int64), np.array([w for _, w in found], dtype=np.int64)))
    return _search(held, queries, len(vocabulary), documents, total or 1, k)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = BEST, id_column: str = "item_id") -> DataFrame:
    """(item, rank, doc_id, score) of the k best documents of each query, the id under the name of ``id_column``."""
    own = queries.where("text is not null").select(F.col(id_column).alias("item"), F.xxhash64("text").alias("query"), "text")
    texts = written(own.groupBy("query").agg(F.first("text").alias("text")), "query-texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-size // SLICE)
    found = None
    for i in range(slices):  # one, unless the queries outgrow what goes to the tasks at once
        part = _slice(docs, [tuple(r) for r in texts.where(F.pmod("query", F.lit(slices)) == i).collect()], k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
    return own.select("item", "query").join(ranked, "query").select(F.col("item").alias(id_column), "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE = r"""
with t as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null
), d as (select r, doc_id, w, cast(len(w) as bigint) as n from t where len(w) > 0
), c as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as total from d
), p as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by r, term
), f as (select term, count(*) as df from p group by term
), q as (
    select item_id, term, count(*) as times from (
        select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
    ) group by item_id, term
), s as (
    select q.item_id, d.r, d.doc_id,
        cast(sum(q.times * cast(floor(1000 * ln((2 * c.n_docs + 2) / cast(2 * f.df + 1 as double))) as bigint)
            * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * d.n * c.n_docs) // c.total)))) as bigint) as score
    from q join f using (term) join p using (term) join d using (r), c group by q.item_id, d.r, d.doc_id
), k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id, r) as integer) as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= 10
"""
