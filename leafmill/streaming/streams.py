"""Structured Streaming: draft lifecycles, answers, debounced edits and ingestion, each beside its batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from leafmill import folders
from leafmill.operators import chunking, ingest, lifecycle, publication, registration
from leafmill.sources import files
from leafmill.tables import shared_folder


#: What an interrupted draft is told.
INTERRUPTED = "interrupted"
_OPEN = ("QUEUED", "RUNNING")


class _Lifecycle(StatefulProcessor):
    """The state of one draft; pairs that no rule has change nothing. With a timeout, a timer fails a draft that stays queued or running."""

    def __init__(self, timeout_ms: int | None = None, event_clock: bool = False, message: str = INTERRUPTED):
        self.timeout_ms, self.event_clock, self.message = timeout_ms, event_clock, message

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", StructType([StructField("status", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        status = self.status.get()[0] if self.status.exists() else lifecycle.NEW
        heard = None
        for event, ts in zip(events.event, events.ts):
            after = "QUEUED" if status == lifecycle.NEW and event == "queue" else lifecycle.TRANSITIONS.get((status, event), status)
            if after != status or (status, event) in lifecycle.TRANSITIONS:
                heard = ts
            status = after
        self.status.update((status,))
        if self.timeout_ms is not None and heard is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if status in _OPEN:
                now = pd.Timestamp(heard).value // 1_000_000 if self.event_clock else timerValues.getCurrentProcessingTimeInMs()
                self.handle.registerTimer(int(now) + self.timeout_ms)
        if status != lifecycle.NEW:
            yield pd.DataFrame({"draft_id": [key[0]], "status": [status], "error_message": [None]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.status.exists() and self.status.get()[0] in _OPEN:
            self.status.update(("FAILED",))
            yield pd.DataFrame({"draft_id": [key[0]], "status": ["FAILED"], "error_message": [self.message]})

    def close(self) -> None:
        pass


def draft_lifecycle(events: DataFrame, timeout_ms: int | None = None, clock: str = "processing") -> DataFrame:
    """(draft_id, status, error_message) after each micro-batch that has events of the draft. events: draft_id, ts, event_id, event.

    With a timeout, every event that takes effect sets the draft's timer anew and its end removes it; a draft still
    queued or running when it goes off turns FAILED by itself, and late events find it so. The clock is the machine's (``processing``) or
    the events' (``event``: ts is a timestamp with a watermark, and the watermark is the time).
    """
    if clock not in ("processing", "event"):
        raise ValueError(f"clock must be processing or event, not {clock!r}")
    mode = "None" if timeout_ms is None else "EventTime" if clock == "event" else "ProcessingTime"
    kind = events.schema["draft_id"].dataType.simpleString()
    return events.groupBy("draft_id").transformWithStateInPandas(statefulProcessor=_Lifecycle(timeout_ms, clock == "event"), outputStructType=f"draft_id {kind}, status string, error_message string", outputMode="Update", timeMode=mode)


class _Answer(StatefulProcessor):
    """The references and deltas of one message until it is done; the end clears them, and a blank or failed answer gives nothing.

    Events of a number that was seen are dropped, and with a time to live so is all that follows the end. What is kept of a message without
    an end goes when nothing has been added to it for that time.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.deltas = handle.getListState("deltas", StructType([StructField("part", StringType())]), self.ttl_ms)
        self.references = handle.getValueState("references", StructType([StructField("json", StringType())]), self.ttl_ms)
        self.seen = handle.getValueState("seen", "seq long, ended boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq").drop_duplicates("seq")
        if self.seen.exists():
            seq, ended = self.seen.get()
            events = events[(events.seq > seq) & (not ended)]
        if events.empty:
            return
        stop = events.kind.isin(["done", "error"])
        if stop.any():  # nothing counts after the first end
            events = events[events.seq <= events.seq[stop].iloc[0]]
        for told in events.loc[events.kind == "references", "text"]:
            if not self.references.exists():  # once for a message; the first ones count
                self.references.update((told,))
        new = [(t,) for t in events.loc[events.kind == "delta", "text"]]
        if new:
            kept = list(self.deltas.get()) if self.ttl_ms is not None and self.deltas.exists() else []
            self.deltas.put(kept + new) if kept else self.deltas.appendList(new)  # with a time to live, all parts live as long as the last
        self.seen.update((int(events.seq.iloc[-1]), bool(stop.any())))
        if stop.any():
            text = "".join(p[0] or "" for p in self.deltas.get()) if self.deltas.exists() else ""
            references = self.references.get()[0] if self.references.exists() else None
            self.deltas.clear()
            self.references.clear()
            if self.ttl_ms is None:
                self.seen.clear()
            if "error" not in set(events.kind) and text.strip():
                yield pd.DataFrame({"message_id": [key[0]], "answer": [text], "manual_references": [references]})

    def close(self) -> None:
        pass


def answer_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(message_id, answer, manual_references) once a message is done. events: message_id, seq, kind (references, delta, done or error), text.

    ``ttl_ms`` is how long a message without an end is kept, and how long the end is remembered, so that a
    batch that is delivered again gives no second answer; without it nothing is remembered of ended messages.
    """
    kind = events.schema["message_id"].dataType.simpleString()
    return events.groupBy("message_id").transformWithStateInPandas(statefulProcessor=_Answer(ttl_ms), outputStructType=f"message_id {kind}, answer string, manual_references string", outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime")


def debounce_latest(edits: DataFrame, quiet: str = "1.5 seconds", late: str = "10 seconds") -> DataFrame:
    """(draft_id, saved_at, text): the last edit of each burst, once the watermark has passed its end. edits: draft_id, ts, event_id, text."""
    timed = edits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    last = timed.groupBy("draft_id", F.session_window("ts", quiet)).agg(F.max_by(F.struct("ts", "text"), F.struct("ts", "event_id")).alias("e"))
    return last.select("draft_id", F.col("e.ts").alias("saved_at"), "e.text").where("text is not null")


def ingest_stream(documents: DataFrame, folder: str, checkpoint: str, dim: int = 64):
    """Start a query that chunks and embeds each micro-batch of documents (doc_id, text) into ``folder``, a folder for each batch.

    A batch that is run again replaces its own folder, so each document's chunks are there once in a
    batch; ``read_ingested`` gives those of the last batch that has any of the document, so a document
    that is registered again is replaced, and one without a chunk leaves what was there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        chunks = ingest.embed_column(chunking.chunk_documents(batch), "content", dim=dim)
        chunks.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return documents.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def read_ingested(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of each document's last registration."""
    chunks = spark.read.parquet(folder)
    last = chunks.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return chunks.join(last, ["doc_id", "batch"], "left_semi").drop("batch")


def register_batch(batch: DataFrame, folder: str, writer: str = "", number: int | None = None, dim: int = 64) -> None:
    """Register the files (path, modificationTime, length, content) of one batch in the published tables of ``folder``."""
    batch = batch.persist(StorageLevel.DISK_ONLY)  # each file is opened once, whatever reads it
    batch.count()  # and its size is known: by that of their names alone, joins would broadcast the files
    incoming, rejected = files.registrations(batch, dim)
    kept = [batch, *(incoming[t].persist() for t in ("documents", "chunks"))]  # chunked and embedded once, read by several writes
    try:
        registration.append_registrations(batch.sparkSession, folder, incoming, writer, number, rejected)
    finally:
        for df in kept:
            df.unpersist()


#: Files that a part of the listing names, on average at most.
PART_FILES = 20_000


def list_new(spark: SparkSession, path: str, kept: str, files_per_batch: int) -> None:
    """Add the files under ``path`` that the listing ``kept`` lacks, in parts of about ``files_per_batch`` or ``PART_FILES``, whichever is less.

    What belongs to one document stands in one part. Where there are more than ``files_per_batch``, the parts of the
    older documents are written first.
    """
    store, at = publication.hadoop_path(spark, kept)
    store.mkdirs(at)
    name = F.element_at(F.split("path", "/", -1), -1)
    beside = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin("tags", "pdf")
    known = spark.read.schema(folders.LISTED).parquet(kept).select("path")
    new = folders.listed(spark, path).join(known, "path", "left_anti").withColumn("document", F.when(beside, F.regexp_replace("path", r"\.[^.]*$", "")).otherwise(F.col("path"))).persist(StorageLevel.DISK_ONLY)
    try:
        if not (count := new.count()):
            return
        runs, most = [(new, count)], min(PART_FILES, files_per_batch)
        if (batches := -(-count // files_per_batch)) > 1:
            own = Window.partitionBy("document")
            time = F.coalesce(F.max(F.when(F.col("document") == F.col("path"), F.col("modificationTime"))).over(own), F.min("modificationTime").over(own))
            written = f"{shared_folder(spark)}/dealt-{uuid.uuid4().hex}"  # once: dealt again, rows could change their batch
            new.withColumn("time", time).repartitionByRange(batches, "time", "document").withColumn("batch", F.spark_partition_id()).write.parquet(written)
            dealt = spark.read.parquet(written)
            runs = [(dealt.where(F.col("batch") == b), n) for b, n in sorted(dealt.groupBy("batch").count().collect())]
        for run, n in runs:
            run.repartition(max(1, round(n / most)), "document").select("path", "modificationTime", "length").write.mode("append").parquet(kept)
    finally:
        new.unpersist()


def registration_stream(spark: SparkSession, path: str, folder: str, checkpoint: str, dim: int = 64, files_per_batch: int = 1000):
    """Start a query that registers the files that come into ``path``: Markdown with what lies beside it, see ``files.registrations``.

    Each micro-batch is one published version of all tables. Its number goes with it under the query's id, so a batch that is run again
    after a failure, at whatever point that came, counts once. The tables are read by ``registration.registered``.

    Tasks list the folder, and the stream is that of the listing in the checkpoint, of about ``files_per_batch`` files a batch: the driver holds the
    names of its parts alone. A store that tasks cannot list is left to Spark's own source, which holds all names.
    """
    full = folders.known(spark, path)
    if full is None:
        schema = "path string, modificationTime timestamp, length long, content binary"
        found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
        whole = folders.in_few_tasks
    else:
        list_new(spark, path, f"{checkpoint}/listed", files_per_batch)
        found = spark.readStream.schema(folders.LISTED).option("maxFilesPerTrigger", -(-files_per_batch // PART_FILES)).parquet(f"{checkpoint}/listed")
        whole = lambda batch: folders.contents(batch, full)

    def write(batch: DataFrame, number: int) -> None:
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        register_batch(whole(batch), folder, writer, number, dim)

    return found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
