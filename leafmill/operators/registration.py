"""Registrations of whole documents: rows, tags, chunks and pdfs replaced together, in one job or batch by batch.

The tables are documents (document_id, title, source_file_name, created_at), tags (document_id, tag), chunks (document_id,
chunk_index, content, embedding) and pdfs (document_id, file_name, content). A document is known by its ``source_file_name``; registering
it again gives it a new id, its old row, tags and chunks vanish, and its old pdf is carried over only where the new registration has none. A
registration without a chunk, without a name, or with a pdf's name or bytes alone is refused and leaves what was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import publication
from leafmill.tables import blank

TABLES = ("documents", "tags", "chunks", "pdfs")
KEY = "source_file_name"


def _last(df: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def checked(incoming: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The registrations that can be stored, each name's last one, and (source_file_name, document_id, reason) of the others.

    The reason is no-name, half-pdf, no-chunks, or superseded for those that a later one of the same name replaces.
    """
    chunked = incoming["chunks"].select("document_id").distinct().withColumn("_chunked", F.lit(True))
    has_name, has_bytes = ~blank(F.col("file_name")), F.coalesce(F.length("content") > 0, F.lit(False))
    halves = incoming["pdfs"].groupBy("document_id").agg(F.max(has_name != has_bytes).alias("_half"))
    documents = incoming["documents"].join(chunked, "document_id", "left").join(halves, "document_id", "left")
    reason = F.when(blank(F.col(KEY)), "no-name").when(F.col("_half"), "half-pdf").when(F.col("_chunked").isNull(), "no-chunks")
    w = Window.partitionBy(KEY, F.col("_reason").isNull()).orderBy(F.desc("created_at"), F.desc("document_id"))
    judged = documents.withColumn("_reason", reason).withColumn("_nth", F.row_number().over(w))
    judged = judged.withColumn("_reason", F.when(F.col("_reason").isNull() & (F.col("_nth") > 1), "superseded").otherwise(F.col("_reason")))
    refused = judged.where("_reason is not null").select(KEY, "document_id", F.col("_reason").alias("reason"))
    good = judged.where("_reason is null").select(incoming["documents"].columns)
    mine = lambda t: incoming[t].join(good.select("document_id"), "document_id", "left_semi").select(incoming[t].columns)
    pdfs = _last(mine("pdfs").where(has_name & has_bytes), ["document_id"], ["file_name"])
    return {"documents": good, "tags": mine("tags").distinct(), "chunks": mine("chunks"), "pdfs": pdfs}, refused


def upsert_registrations(current: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All four tables after the registrations, and those refused (see ``checked``)."""
    new, refused = checked(incoming)
    named = new["documents"].select(KEY, F.col("document_id").alias("_new_id"))
    replaced = current["documents"].select("document_id", KEY).join(named, KEY).select("document_id", "_new_id")
    left = lambda t: current[t].join(replaced.select("document_id"), "document_id", "left_anti")
    carried = current["pdfs"].join(replaced, "document_id").join(new["pdfs"].select(F.col("document_id").alias("_new_id")), "_new_id", "left_anti")
    carried = carried.select(*[F.col("_new_id").alias(c) if c == "document_id" else F.col(c) for c in current["pdfs"].columns])
    out = {t: left(t).unionByName(new[t].select(current[t].columns)) for t in TABLES}
    out["pdfs"] = out["pdfs"].unionByName(carried)
    return out, refused


def append_registrations(spark: SparkSession, folder: str, incoming: dict[str, DataFrame], writer: str = "", batch: int | None = None, rejected: DataFrame | None = None) -> publication.Snapshot:
    """Publish registrations as further parts of the published tables; what they replace is left out when the tables are read.

    So a batch costs what it holds, however much is registered. Of one writer's numbered batches each counts once: the commit that
    brings a batch also says so, and a batch that is run again finds itself there. The pdfs part also takes pdfs of documents that
    are registered already, by name (a null document_id). Refusals go to a table of their own, as do ``rejected`` files (path, reason).
    """

    def change(base: publication.Snapshot) -> dict | None:
        if batch is not None and base.note.get("batches", {}).get(writer, -1) >= batch:
            return None
        alone = incoming["pdfs"].where("document_id is null")
        new, refused = checked({**incoming, "pdfs": incoming["pdfs"].where("document_id is not null")})
        named = new["pdfs"].drop(KEY).join(new["documents"].select("document_id", KEY), "document_id")
        new["pdfs"] = named.unionByName(alone.select(named.columns))
        version = F.lit(base.number + 1).cast("long").alias("version")
        note = {"batches": {**base.note.get("batches", {}), **({} if batch is None else {writer: batch})}}
        others = {"refused": refused} | ({} if rejected is None else {"rejected": rejected})
        return {"appended": {t: df.select("*", version) for t, df in {**new, **others}.items()}, "note": note}

    return publication.update(spark, folder, change)


def registered(spark: SparkSession, at: publication.Snapshot) -> dict[str, DataFrame]:
    """The four tables as they stand in a snapshot: each name's last registration with its tags and chunks, and its last pdf."""
    documents = _last(at.table(spark, "documents"), [KEY], [F.desc("version"), F.desc("created_at"), F.desc("document_id")])
    live = documents.select("document_id", KEY)
    mine = lambda t: at.table(spark, t).join(live.select("document_id"), "document_id", "left_semi").drop("version")
    pdfs = _last(at.table(spark, "pdfs"), [KEY], [F.desc("version"), F.asc_nulls_first("document_id"), "file_name"]).drop("document_id", "version")
    return {"documents": documents.drop("version"), "tags": mine("tags"), "chunks": mine("chunks"), "pdfs": pdfs.join(live, KEY).drop(KEY)}


def compact(spark: SparkSession, folder: str) -> publication.Snapshot:
    """Publish the tables as they stand, each as one part without what was replaced."""

    def change(base: publication.Snapshot) -> dict:
        tables = registered(spark, base)
        names = tables["documents"].select("document_id", KEY)
        tables["pdfs"] = tables["pdfs"].join(names, "document_id")
        number = F.lit(base.number + 1).cast("long").alias("version")
        return {"replaced": {t: df.select(*[F.col(c) for c in at_columns(base, t) if c != "version"], number) for t, df in tables.items()}}

    def at_columns(base: publication.Snapshot, name: str) -> list[str]:
        return [f["name"] for f in base.schemas[name]["fields"]]

    return publication.update(spark, folder, change)


def document_id(*parts: Column) -> Column:
    """An id that the same registration gets again when its batch is run again."""
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 32)
