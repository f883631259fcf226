"""Putting documents in: upserts, embeddings, model rows, JSON columns, answer events."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from leafmill.operators import publication


def upsert_documents(current: DataFrame, incoming: DataFrame, key: str = "source_file_name", version: str = "version") -> DataFrame:
    """Whole documents replaced by key, the last incoming version winning; the old pdf is kept where the new one has none."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    new = incoming.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    pdfs = current.select(key, F.col("pdf").alias("old_pdf"))
    replaced = new.join(pdfs, key, "left").withColumn("pdf", F.coalesce("pdf", "old_pdf")).select(current.columns)
    return current.join(new, key, "left_anti").select(current.columns).unionByName(replaced)


def upsert_pdf(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows by document_id, incoming ones first, then the newest."""
    both = current.withColumn("priority", F.lit(1)).unionByName(incoming.withColumn("priority", F.lit(0)))
    w = Window.partitionBy("document_id").orderBy("priority", F.col("created_at").desc())
    return both.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "priority")


def publish(df: DataFrame, folder: str) -> publication.Snapshot:
    """A new version of a table beside the old ones; of writers at once each gets a number of its own (see ``publication``)."""
    return publication.update(df.sparkSession, folder, lambda base: {"replaced": {"table": df}})


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a published table."""
    return publication.snapshot(spark, folder).table(spark, "table")


def existing_registration(incoming: DataFrame, registered: DataFrame, key: str = "source_file_name") -> DataFrame:
    """Incoming rows with ``registered``: whether their name is there already."""
    known = registered.select(key).distinct().withColumn("_there", F.lit(True))
    return incoming.join(known, key, "left").withColumn("registered", F.col("_there").isNotNull()).drop("_there")


def replace_registrations(current: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables documents, tags, chunks and pdfs after registrations, and (document_id, reason) of those refused.

    A document that is registered again is replaced whole: its row, tags and chunks. A pdf replaces the
    stored one only with both a file name and content; else the stored one stays. A document without a
    chunk is refused, and what was registered under its id stays as it was. Rows of one document repeat
    only as their tables allow; of repeated document rows the last ``created_at`` counts.
    """
    w = Window.partitionBy("document_id").orderBy(F.col("created_at").desc())
    documents = incoming["documents"].withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    chunked = incoming["chunks"].select("document_id").distinct()
    good = documents.join(chunked, "document_id", "left_semi")
    ids = good.select("document_id")
    refused = documents.join(chunked, "document_id", "left_anti").select("document_id", F.lit("no-chunks").alias("reason"))
    whole = lambda t, new: current[t].join(ids, "document_id", "left_anti").unionByName(new.select(current[t].columns))
    mine = lambda t: incoming[t].join(ids, "document_id", "left_semi")
    pdfs = mine("pdfs").where("file_name is not null and trim(file_name) <> '' and content is not null and length(content) > 0")
    kept = current["pdfs"].join(pdfs.select("document_id").distinct(), "document_id", "left_anti")
    out = {"documents": whole("documents", good), "tags": whole("tags", mine("tags").distinct()), "chunks": whole("chunks", mine("chunks")), "pdfs": kept.unionByName(pdfs.select(kept.columns))}
    return out, refused


@lru_cache(1 << 16)
def _place(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def feature_hash(texts: list[str], dim: int) -> np.ndarray:
    """Deterministic unit vectors of word counts, for tests."""
    places = [[_place(w) for w in (t or "").split()] for t in texts]
    hashes = np.array([h for hs in places for h in hs], dtype=np.uint64)
    rows = np.repeat(np.arange(len(texts)), [len(hs) for hs in places])
    signs = 1.0 - 2.0 * (hashes >> np.uint64(63)).astype(float)
    out = np.bincount(rows * dim + (hashes % np.uint64(dim)).astype(np.int64), weights=signs, minlength=len(texts) * dim).reshape(len(texts), dim)
    norms = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norms > 0, norms, 1)[:, None]


def embed_column(df: DataFrame, column: str, fn: Callable = feature_hash, dim: int = 64, batch: int = 256) -> DataFrame:
    """Adds ``embedding``, one vector per row by ``fn(texts, dim)``; a vector of another dimension is an error. The other columns pass as Arrow has them."""
    schema = StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                rows = whole.slice(a, batch)
                v = np.asarray(fn(rows.column(column).to_pylist(), dim), dtype=np.float32)
                if v.ndim != 2 or v.shape[1] != dim:
                    raise ValueError(f"embeddings must have {dim} dimensions")
                vectors = pa.ListArray.from_arrays(pa.array(range(0, v.size + 1, dim), pa.int32()), pa.array(v.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, vectors], [*rows.schema.names, "embedding"])

    return df.mapInArrow(run, schema)


def model_rows(df: DataFrame, fn: Callable, key: str = "doc_id") -> DataFrame:
    """(key, body, error) of a model called once per Arrow batch; a failure is its row's error, not the job's or the batch's."""

    def one(pdf):
        try:
            return list(fn(pdf))[0], None
        except Exception as e:
            return None, str(e)[:300]

    def run(batches):
        for pdf in batches:
            try:
                body, error = list(fn(pdf)), [None] * len(pdf)
            except Exception:  # some row's failure becomes data: each is asked for alone
                body, error = zip(*[one(pdf.iloc[i : i + 1]) for i in range(len(pdf))])
            yield pd.DataFrame({key: pdf[key], "body": body, "error": error})

    return df.mapInPandas(run, f"{key} long, body string, error string")


def to_json(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_json(column))


def from_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn(column, F.from_json(column, schema))


#: The fields of answer events with their JSON types (as Spark names those of a variant), and of a reference.
EVENT_FIELDS = {"delta": {"text": "STRING"}, "done": {"message_id": "STRING", "created_at": "STRING"}, "error": {"detail": "STRING"}, "manual_references": {}}
REFERENCE = "document_title string, document_id string, similarity double, content string, has_pdf boolean"
REFERENCE_TYPES = {"document_title": "STRING", "document_id": "STRING", "similarity": "number", "content": "STRING", "has_pdf": "BOOLEAN"}
PREVIEW = 60


def _kind(value: Column, field: str) -> Column:
    """The JSON type of a field: STRING, BOOLEAN, VOID (null), number, OBJECT or ARRAY and what is in them; null where it is absent."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").otherwise(kind)


def parse_answer_events(lines: DataFrame, column: str = "line") -> DataFrame:
    """Events of non-blank JSON lines, with error and a preview of what is wrong; nothing is dropped.

    The error is bad-json (also for anything after the value), not-an-event (no object), unknown-type,
    or missing-field (one that its type asks for is not there or is of another JSON type).
    """
    text = F.trim(F.regexp_replace(column, r"^[\s]+|[\s]+$", ""))
    # A value in an array of its own: what follows it would be outside that array, or break it.
    read = lines.where(F.trim(column) != "").withColumn("_all", F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    one = F.size(F.try_variant_get("_all", "$", "array<variant>")) == 1
    read = read.withColumn("_v", F.when(one & F.try_parse_json(text).isNotNull(), F.try_variant_get("_all", "$[0]", "variant")))
    shape = F.schema_of_variant("_v")
    kind = F.when(_kind(F.col("_v"), "type") == "STRING", F.try_variant_get("_v", "$.type", "string"))
    wrong = F.lit(False)
    for name, fields in EVENT_FIELDS.items():
        for field, wanted in fields.items():
            wrong = wrong | ((kind == name) & ~F.coalesce(_kind(F.col("_v"), field) == wanted, F.lit(False)))
    listed = F.try_variant_get("_v", "$.manual_references", "array<variant>")
    whole = F.forall(listed, lambda r: F.coalesce(reduce(lambda a, b: a & b, [_kind(r, f) == t for f, t in REFERENCE_TYPES.items()]), F.lit(False)))
    none = F.coalesce(_kind(F.col("_v"), "manual_references") == "VOID", F.lit(False))
    wrong = wrong | ((kind == "manual_references") & ~none & ~F.coalesce(whole, F.lit(False)))
    error = F.when(F.col("_v").isNull(), "bad-json").when(~shape.startswith("OBJECT"), "not-an-event").when(kind.isNull() | ~kind.isin(*EVENT_FIELDS), "unknown-type").when(wrong, "missing-field")
    get = lambda f: F.try_variant_get("_v", f"$.{f}", "string").alias(f)
    refs = F.from_json(F.to_json(F.try_variant_get("_v", "$.manual_references", "variant")), f"array<struct<{', '.join(c.strip().replace(' ', ':') for c in REFERENCE.split(','))}>>")
    event = F.struct(kind.alias("type"), get("text"), get("message_id"), get("created_at"), get("detail"), refs.alias("manual_references"))
    preview = F.when(F.length(column) > PREVIEW, F.concat(F.left(column, F.lit(PREVIEW)), F.lit("…"))).otherwise(F.col(column))
    parsed = read.withColumns({"event": event, "error": error})
    return parsed.withColumn("preview", F.when(F.col("error").isNotNull(), preview)).drop("_all", "_v")
