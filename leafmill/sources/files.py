"""Reading Markdown files, PDF blobs, bundles and answer events, with what is rejected and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import folders
from leafmill.operators import bundles, chunking, ingest, registration, validation
from leafmill.tables import blank

PDF_BYTES = 100 << 20


def _judged(files: DataFrame) -> DataFrame:
    """Files (path, content, any others) with title, text and reason, in place of their content."""
    name = F.element_at(F.split("path", "/", -1), -1)
    known = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin("md", "markdown", "txt")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.when(valid, F.col("content").cast("string")), "^﻿", "")
    reason = F.when(~known, "extension").when(~valid, "encoding").when(blank(text), "blank")
    return files.withColumns({"title": F.regexp_replace(name, r"\.[^.]*$", ""), "text": F.when(reason.isNull(), text), "reason": reason}).drop("content")


def classify_markdown(files: DataFrame) -> DataFrame:
    """Files (path, content) with title, text and reason (extension, encoding or blank; null if accepted)."""
    return _judged(files).select("path", "title", "text", "reason")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text, reason): accepted and rejected files in one pass, see ``classify_markdown``."""
    return classify_markdown(folders.stored(spark, path).select("path", "content"))


def read_markdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted documents (path, title, text) and rejected files (path, reason)."""
    found = markdown_files(spark, path)
    return found.where("reason is null").drop("reason"), found.where("reason is not null").select("path", "reason")


def classify_pdfs(files: DataFrame, most: int = PDF_BYTES) -> DataFrame:
    """Files (path, length, content) with reason: empty, too-large or not-pdf; null if accepted."""
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > most, "too-large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not-pdf")
    return files.withColumn("reason", reason)


def pdf_files(spark: SparkSession, path: str, most: int = PDF_BYTES) -> DataFrame:
    """(path, length, content, reason): accepted and rejected files in one pass; what is too large is rejected by its length, unread.

    Spark's file source passes over files of no bytes; ``classify_pdfs`` names them in tables of blobs.
    """
    large = folders.listed(spark, path).where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("too-large").alias("reason"))
    return classify_pdfs(folders.stored(spark, path, f"length <= {most}").select("path", "length", "content"), most).unionByName(large)


def read_pdf_blobs(spark: SparkSession, path: str, most: int = PDF_BYTES) -> tuple[DataFrame, DataFrame]:
    """Accepted blobs (path, length, content) and rejected files (path, reason), see ``pdf_files``."""
    found = pdf_files(spark, path, most)
    return found.where("reason is null").drop("reason"), found.where("reason is not null").select("path", "reason")


def registrations(files: DataFrame, dim: int = 64) -> tuple[dict[str, DataFrame], DataFrame]:
    """The registrations that files (path, modificationTime, length, content) ask for, and (path, reason) of those rejected.

    A Markdown file registers a document under its name; ``<name>.tags`` beside it holds its tags, ``<name>.pdf`` its original.
    A pdf without its Markdown in the same batch belongs to the document that is registered under the name (document_id is null). Ids
    come from a file's path, time and content, so that the same files give the same ids again.
    """
    path = F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    named = files.withColumn("path", path).withColumn("name", F.element_at(F.split("path", "/", -1), -1)).withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    beside = named.withColumn("at", F.regexp_replace("path", r"\.[^.]*$", ""))  # the Markdown file's path
    judged = _judged(named.where("ext not in ('pdf', 'tags')").withColumn("digest", F.sha2("content", 256)))
    own_id = registration.document_id(F.col("path"), F.col("modificationTime").cast("string"), F.col("digest"))
    good = judged.where("reason is null").withColumn("document_id", own_id)
    documents = good.select("document_id", "title", F.col("name").alias(registration.KEY), F.col("modificationTime").alias("created_at"))
    chunks = chunking.chunk_documents(good.select(F.col("document_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "document_id")
    listed = validation.normalize_tags(beside.where("ext = 'tags'").select("path", "at", F.col("content").cast("string").alias("raw")))
    tags = listed.join(good.select(F.col("path").alias("at"), "document_id"), "at").select("document_id", F.explode("tags").alias("tag"))
    blobs = classify_pdfs(beside.where("ext = 'pdf'"))
    name = F.element_at(F.split("at", "/", -1), -1)
    pdfs = blobs.where("reason is null").join(good.select(F.col("path").alias("at"), "document_id"), "at", "left")
    pdfs = pdfs.select("document_id", F.col("name").alias("file_name"), "content", name.alias(registration.KEY))
    rejected = judged.select("path", "reason").unionByName(blobs.select("path", "reason")).unionByName(listed.select("path", F.when(F.col("error").isNotNull(), "tags").alias("reason")))
    return {"documents": documents, "tags": tags, "chunks": ingest.embed_column(chunks, "content", dim=dim), "pdfs": pdfs}, rejected.where("reason is not null")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(bundle_id, path, length, content, kind): each folder under ``path`` is a bundle; its own name, hidden and module folders are left out."""
    files = folders.stored(spark, path).select("path", "length", "content")
    root = path.rstrip("/").split("://")[-1].rstrip("/") + "/"
    inside = files.withColumn("path", F.substring("path", F.position(F.lit(root), F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))) + len(root), F.length("path")))
    inside = inside.withColumn("bundle_id", F.split("path", "/", -1)[0])
    kept = bundles.bundle_paths(inside)
    too_many = bundles.size_guard(kept).where("too_many").select("bundle_id")
    first = too_many.head()
    if first:
        raise ValueError(f"bundle {first.bundle_id} has more than {bundles.MOST_FILES} files")
    return kept


def answer_messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (message_id, seq, line) of answers as events (message_id, seq, kind, text) for ``answer_stream``, and as errors with a preview."""
    parsed = ingest.parse_answer_events(lines)
    kind = F.when(F.col("event.type") == "manual_references", "references").otherwise(F.col("event.type"))
    text = F.coalesce("event.text", "event.detail", F.to_json("event.manual_references"))
    good = parsed.where("error is null").select("message_id", "seq", kind.alias("kind"), text.alias("text"))
    return good, parsed.where("error is not null").select("message_id", "seq", "error", "preview")


def read_answers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A stream of answers, each a file of JSON lines, as ``answer_messages``; the message's id is its file's path."""
    whole = spark.readStream.text(path, wholetext=True)
    return answer_messages(whole.select(F.col("_metadata.file_path").alias("message_id"), F.posexplode(F.split("value", "\n", -1)).alias("seq", "line")))


def read_answer_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A stream of JSON lines as good events and as errors with a preview."""
    parsed = ingest.parse_answer_events(spark.readStream.text(path).withColumnRenamed("value", "line"))
    return parsed.where("error is null").select("event.*"), parsed.where("error is not null").select("error", "preview")
