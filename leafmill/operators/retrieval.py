"""Retrieval: exact cosine search of a table of questions, tag scopes, thresholds and summaries.

A small table of questions (its number is checked) goes to the tasks that scan the chunks. A larger one
is dealt into blocks of questions, the chunks into blocks of chunks, and each pair of blocks is one
group of a cogrouped job. Either way a task keeps only the best few chunks of each question, and a
window picks among those.

A null, empty or zero vector, of a question or of a chunk, is like nothing and gives no hit. Rows that
repeat an id are questions or chunks of their own; their hits stand under the same id.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.tables import shared_folder

#: Questions that one task compares with its chunks, and chunks of a block where there are more questions.
BLOCK = 4096
CHUNK_BLOCK = 16_384
#: Chunks that are multiplied with the questions at once.
STEP = 2048
RELEVANCE = 0.45
LOW_RELEVANCE = 0.50

_HITS = "row long, query_id long, chunk_id long, document_id long, chunk_index long, similarity double"


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class _Best:
    """The best k chunks (or documents, by their best chunk) of each question among the chunks seen."""

    def __init__(self, questions: pd.DataFrame, k: int, scope: str | None, per_document: bool, exclude_self: bool):
        self.k, self.per_document, self.exclude_self = k, per_document, exclude_self
        self.ids, self.rows = questions.query_id.to_numpy(dtype=np.int64), questions.row.to_numpy(dtype=np.int64)
        self.vectors = _unit(questions.embedding)
        self.wanted = [None if w is None else frozenset(w) for w in questions.wanted]
        self.scope, self.kept, self.waiting = scope, None, []

    def _allowed(self, tags: list[frozenset]) -> np.ndarray | None:
        """(questions x chunks), or null where all are."""
        if self.scope is None or (self.scope == "tag" and all(w is None for w in self.wanted)):
            return None
        names = {t: i for i, t in enumerate({t for w in self.wanted if w for t in w})}
        asked, held = np.zeros((len(self.wanted), len(names) + 1), dtype=np.float32), np.zeros((len(tags), len(names) + 1), dtype=np.float32)
        for i, w in enumerate(self.wanted):
            asked[i, [names[t] for t in w or ()]] = 1
        for i, ts in enumerate(tags):
            held[i, [names[t] for t in ts if t in names]] = 1
        allowed = asked @ held.T > 0
        if self.scope == "tag":
            allowed |= np.array([not ts for ts in tags])[None, :]
            allowed[[w is None for w in self.wanted]] = True
        return allowed

    def add(self, chunks: pd.DataFrame) -> None:
        for a in range(0, len(chunks), STEP):
            part = chunks.iloc[a : a + STEP].sort_values(["document_id", "chunk_index", "chunk_id"] if self.per_document else ["chunk_id"], kind="stable")
            sims = self.vectors @ _unit(part.embedding).T
            chunk, document, index = (part[c].to_numpy() for c in ("chunk_id", "document_id", "chunk_index"))
            if (allowed := self._allowed([frozenset() if t is None else frozenset(t) for t in part.tags])) is not None:
                sims[~allowed] = -np.inf
            if self.exclude_self:
                sims[self.ids[:, None] == chunk[None, :]] = -np.inf
            at = None
            if self.per_document:  # each document's best chunk, the first of equal ones
                starts = np.flatnonzero(np.r_[True, document[1:] != document[:-1]])
                ends = np.r_[starts[1:], len(document)]
                at = np.stack([s + sims[:, s:e].argmax(axis=1) for s, e in zip(starts, ends)], axis=1)
                sims = np.take_along_axis(sims, at, axis=1)
            k = min(self.k, sims.shape[1])
            least = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
            for i, row in enumerate(sims):
                best = np.flatnonzero((row >= least[i]) & (row > -np.inf))
                best = best[np.argsort(-row[best], kind="stable")][:k]
                if len(best):
                    c = best if at is None else at[i, best]
                    self.waiting.append((np.full(len(best), i), chunk[c], document[c], index[c], row[best]))
            if sum(len(x[0]) for x in self.waiting) > 4 * self.k * len(self.ids):
                self._reduce()

    def _reduce(self) -> None:
        if self.waiting:
            new = pd.DataFrame(dict(zip(("q", "chunk_id", "document_id", "chunk_index", "similarity"), map(np.concatenate, zip(*self.waiting)))))
            both = new if self.kept is None else pd.concat([self.kept, new])
            if self.per_document:
                both = both.sort_values(["q", "document_id", "similarity", "chunk_index", "chunk_id"], ascending=[True, True, False, True, True]).drop_duplicates(["q", "document_id"])
            both = both.sort_values(["q", "similarity", "document_id" if self.per_document else "chunk_id"], ascending=[True, False, True])
            self.kept, self.waiting = both.groupby("q").head(self.k), []

    def hits(self) -> pd.DataFrame:
        self._reduce()
        if self.kept is None:
            return pd.DataFrame({c: [] for c in ("row", "query_id", "chunk_id", "document_id", "chunk_index", "similarity")})
        return self.kept.assign(row=self.rows[self.kept.q], query_id=self.ids[self.kept.q]).drop(columns="q")


def _candidates(queries: DataFrame, chunks: DataFrame, k: int, scope: str | None, per_document: bool, exclude_self: bool, block: int) -> DataFrame:
    """Hits that contain each question's best k. queries: query_id, embedding, wanted (array of tags or null); chunks may have tags."""
    spark = queries.sparkSession
    solid = lambda df: df.where(F.exists("embedding", lambda x: x != 0))
    wanted = F.col("wanted") if "wanted" in queries.columns else F.lit(None).cast("array<string>")
    asked = solid(queries.select(F.monotonically_increasing_id().alias("row"), F.col("query_id").cast("long").alias("query_id"), "embedding", wanted.alias("wanted")))
    tags = F.col("tags") if "tags" in chunks.columns else F.lit(None).cast("array<string>")
    held = solid(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"), F.col("chunk_index").cast("long").alias("chunk_index"), "embedding", tags.alias("tags")))
    few = asked.limit(block + 1).toPandas()  # a bounded look: is this one block?
    if not len(few):
        return spark.createDataFrame([], _HITS)
    if len(few) <= block:
        shared = spark.sparkContext.broadcast(few)

        def scan(batches):
            best = _Best(shared.value, k, scope, per_document, exclude_self)
            for pdf in batches:
                best.add(pdf)
            yield best.hits()

        return held.mapInPandas(scan, _HITS)

    # Numbered questions are written, and chunks dealt by their own values: a stage that is run again deals them alike.
    path = f"{shared_folder(spark)}/questions-{uuid.uuid4().hex}"
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    rows, columns = -(-asked.count() // block), max(1, -(-held.count() // CHUNK_BLOCK))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = asked.withColumn("r", F.pmod(F.xxhash64("row"), F.lit(rows))).withColumn("c", upto(columns)).groupBy("r", "c")
    c = held.withColumn("c", F.pmod(F.xxhash64("chunk_id", "document_id", "chunk_index", "embedding"), F.lit(columns))).withColumn("r", upto(rows)).groupBy("r", "c")

    def compare(questions: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(questions):
            return _Best(pd.DataFrame({"query_id": [0], "row": [0], "embedding": [[1.0]], "wanted": [None]}), k, scope, per_document, exclude_self).hits()
        best = _Best(questions, k, scope, per_document, exclude_self)
        best.add(some)
        return best.hits()

    return q.cogroup(c).applyInPandas(compare, _HITS)


def search(queries: DataFrame, chunks: DataFrame, k: int = 5, scope: str | None = "tag", exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """The k most similar chunks of each question, with rank; ties go to the smaller chunk_id.

    scope "tag": chunks with a wanted tag or without tags, and all chunks for a question that wants
    none; "tagged": only chunks with a wanted tag; None: all chunks. No threshold; an empty corpus gives no rows.
    """
    hits = _candidates(queries, chunks, k, scope, False, exclude_self, block)
    w = Window.partitionBy("row").orderBy(F.col("similarity").desc(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("row")


def best_chunk_per_document(queries: DataFrame, chunks: DataFrame, k: int = 5, scope: str | None = "tagged", block: int = BLOCK) -> DataFrame:
    """The k best documents of each question by their most similar chunk (ties: the smaller index), with rank."""
    hits = _candidates(queries, chunks, k, scope, True, False, block)
    one = Window.partitionBy("row", "document_id").orderBy(F.col("similarity").desc(), "chunk_index", "chunk_id")
    w = Window.partitionBy("row").orderBy(F.col("similarity").desc(), "document_id")
    best = hits.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("row")


def with_tags(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """Chunks with the sorted tags of their document; null for a document without tags."""
    held = tags.groupBy("document_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return chunks.join(held, "document_id", "left")


def relevance_gate(hits: DataFrame, threshold: float = RELEVANCE, relaxed: str | None = None) -> DataFrame:
    """Hits of at least the threshold; the boolean column ``relaxed`` lifts the gate."""
    keep = F.col("similarity") >= threshold
    return hits.where(keep | F.col(relaxed) if relaxed else keep)


def flag_low_relevance(hits: DataFrame, threshold: float = LOW_RELEVANCE) -> DataFrame:
    """Hits with is_low, percent (rounded half up, clamped to 0..100) and all_low of their question."""
    low = F.col("similarity") < threshold
    percent = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))) * 100 + 0.5).cast("long")
    return hits.withColumns({"is_low": low, "percent": percent, "all_low": F.min(low).over(Window.partitionBy("query_id"))})


def retrieval_quality(hits: DataFrame, relevant: str = "relevant") -> DataFrame:
    """One row: the shares of questions whose first hit, and any hit, is relevant."""
    per = hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col(relevant).cast("int")).otherwise(0)).alias("one"), F.max(F.col(relevant).cast("int")).alias("any"))
    return per.agg(F.count("*").alias("questions"), F.round(F.avg("one"), 6).alias("hit_at_1"), F.round(F.avg("any"), 6).alias("hit_at_k"))


def with_pdf_flag(documents: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Documents with has_pdf."""
    have = pdfs.select("document_id").distinct().withColumn("has", F.lit(True))
    return documents.join(have, "document_id", "left").withColumn("has_pdf", F.col("has").isNotNull()).drop("has")


def document_summary(documents: DataFrame, tags: DataFrame, chunks: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Documents with their sorted tags (empty, not null), number of chunks and has_pdf."""
    held = tags.groupBy("document_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    out = with_pdf_flag(documents, pdfs).join(held, "document_id", "left").join(counts, "document_id", "left")
    return out.withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "chunk_count": F.coalesce("chunk_count", F.lit(0))})


def tags_by_document(tags: DataFrame, evidence: DataFrame) -> DataFrame:
    """The ordered tags of the documents that are evidence."""
    return tags.join(evidence.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def distinct_tags(tags: DataFrame) -> DataFrame:
    return tags.select("tag").distinct()


def evidence(queries: DataFrame, chunks: DataFrame, k: int = 5, threshold: float = RELEVANCE) -> DataFrame:
    """Hits with their branch: gated search; where it finds nothing, documents of the tags written in the
    question (``mentioned``), best chunk each; where that finds nothing, one row without a chunk.

    queries: query_id, embedding, wanted, mentioned, relaxed.
    """
    gate = queries.select("query_id", "relaxed")
    first = relevance_gate(search(queries, chunks, k).join(gate, "query_id"), threshold, "relaxed").drop("relaxed").withColumn("branch", F.lit("search"))
    rest = queries.join(first, "query_id", "left_anti")
    second = best_chunk_per_document(rest.drop("wanted").withColumnRenamed("mentioned", "wanted"), chunks, k).withColumn("branch", F.lit("tagged"))
    none = rest.join(second, "query_id", "left_anti").select("query_id")
    for c, t in first.dtypes:
        if c not in ("query_id", "branch"):
            none = none.withColumn(c, F.lit(None).cast(t))
    return first.unionByName(second).unionByName(none.withColumn("branch", F.lit("none")).select(first.columns))


def tag_match(questions: DataFrame, hits: DataFrame, tags: DataFrame) -> DataFrame:
    """Of each question (query_id, mentioned) the mentioned tags that its evidence carries, in the question's order; null if none."""
    carried = hits.select("query_id", "document_id").distinct().join(tags, "document_id").groupBy("query_id").agg(F.collect_set("tag").alias("carried"))
    both = F.array_intersect("mentioned", "carried")
    return questions.join(carried, "query_id", "left").select("query_id", F.when(F.size(both) > 0, both).alias("matched"))


def build_context(hits: DataFrame, threshold: float = RELEVANCE) -> DataFrame:
    """(query_id, context): the numbered excerpts under their header and notices.

    hits: query_id, rank, title, content, similarity, tags (of the document, null or empty if not shown),
    matched (tags of the question that the evidence carries, null if none).
    """
    tag_label = F.when(F.size("tags") > 0, F.concat(F.lit("（タグ: "), F.array_join("tags", "、"), F.lit("）"))).otherwise("")
    tag_label = F.when(F.col("matched").isNotNull(), tag_label).otherwise("")
    lines = F.concat(F.col("rank").cast("string"), F.lit(". 『"), "title", F.lit("』"), tag_label, F.lit("（類似度 "), F.format_string("%.2f", "similarity"), F.lit("）\n   "), "content")
    per = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", lines.alias("line")))).alias("rows"), F.max("similarity").alias("best"), F.first("matched", ignorenulls=True).alias("matched")
    )
    #: The header and notices of a context.
    header = F.concat(F.lit("【関連資料の抜粋（類似度上位"), F.size("rows").cast("string"), F.lit("件）】"))
    names = F.array_join(F.transform("matched", lambda t: F.concat(F.lit("「"), t, F.lit("」"))), "、")
    best = F.format_string("%.2f", "best")
    tagged = F.concat(F.lit("※質問に書かれたタグ名"), names, F.lit("は、以下の資料に付けられています（『文書名』の後ろに、その文書のタグ名を示します）。"))
    tagged_low = F.concat(F.lit("ただし、質問との類似度は最高でも"), best, F.lit("で、質問の内容に直接該当する記載があるとは限りません。"))
    low = F.concat(F.lit("※以下の抜粋はいずれも関連度が低く（最高でも類似度"), best, F.lit("）、質問に直接該当する記載は見つかりませんでした。参考程度に留め、回答の冒頭で「資料には本件に直接該当する記載がない」旨を明記してください。"))
    is_low, has = F.col("best") < threshold, F.col("matched").isNotNull()
    return per.select("query_id", F.concat_ws("\n", header, F.when(has, tagged), F.when(has & is_low, tagged_low), F.when(~has & is_low, low), F.array_join(F.col("rows.line"), "\n")).alias("context"))
