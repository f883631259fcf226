"""Queries over files that Spark writes from the given tables, and over streams of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import exports, ingest, publication, registration
from leafmill.sources import files
from leafmill.streaming import streams
from leafmill.tables import shared_folder, table

from .registry import query


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _written(spark: SparkSession, outputs: DataFrame) -> str:
    """A new folder with the files (path, content)."""
    folder = _folder(spark)
    exports.write_exports(outputs.withColumn("export_id", F.lit("all")), folder)
    return folder


#: Texts as files: three of four are Markdown by name, some with a byte order mark, some no UTF-8, some blank.
FILES_SQL = """f as (select doc_id, doc_id % 11 = 4 as broken, doc_id % 13 = 5 as bare, coalesce(text, '') as text,
  'd' || cast(doc_id // 100 as varchar) || '/n ' || cast(doc_id as varchar) || '.' || ['md', 'MARKDOWN', 'txt', 'html'][doc_id % 4 + 1] as path from documents)"""


def _markdown_files(spark, folder):
    docs = table(spark, folder, "documents").selectExpr("doc_id", "concat('d', doc_id div 100, '/n ', doc_id, '.', element_at(array('md', 'MARKDOWN', 'txt', 'html'), cast(doc_id % 4 as int) + 1)) as path", "coalesce(text, '') as text")
    body = F.when(F.expr("doc_id % 11 = 4"), F.concat(F.col("text").cast("binary"), F.lit(b"\xff"))).when(F.expr("doc_id % 13 = 5"), F.lit(" \n\t").cast("binary"))
    return docs.select("path", F.coalesce(body, F.when(F.expr("doc_id % 3 = 0"), F.concat(F.lit("﻿"), "text")).otherwise(F.col("text")).cast("binary")).alias("content"))


@query("write_exports", """with o as (select doc_id // 20 as export_id, case when doc_id % 300 = 7 then 'x/../' || cast(doc_id as varchar) else 'out/' || cast(doc_id % 20 as varchar) || '-' || cast(doc_id as varchar) || '.md' end as path, coalesce(text, '') as text from documents),
d as (select *, bool_or(path like 'x/..%') over (partition by export_id) as bad from o)
select export_id, path, case when bad then 'reject' else 'write' end as decision, not bad as written, case when bad then 0 else strlen(text) end as bytes from d""")
def write_exports(spark, folder):
    """The documents written as files; exports with an unusable name are refused whole."""
    outputs = table(spark, folder, "documents").selectExpr("doc_id div 20 as export_id", "if(doc_id % 300 = 7, concat('x/../', doc_id), concat('out/', doc_id % 20, '-', doc_id, '.md')) as path", "cast(coalesce(text, '') as binary) as content")
    return exports.write_exports(outputs, _folder(spark)).select("export_id", "path", "decision", "written", "bytes")


@query("read_markdown", f"""with {FILES_SQL} select regexp_extract(path, '[^/]*$') as name, case when doc_id % 4 = 3 then 'extension' when broken then 'encoding' when bare or not regexp_matches(text, '\\S') then 'blank' end as reason,
  case when doc_id % 4 <> 3 and not broken and not bare and regexp_matches(text, '\\S') then text end as text from f where bare or text <> '' or doc_id % 3 = 0 or broken""")
def read_markdown(spark, folder):
    """Files of the documents read back: those accepted with their text, the others with the reason."""
    found = files.markdown_files(spark, _written(spark, _markdown_files(spark, folder)))
    return found.select(F.try_url_decode(F.element_at(F.split("path", "/", -1), -1)).alias("name"), "reason", "text")


@query("read_pdf_blobs", """with b as (select page_id, case when page_id % 3 = 0 then '' else '%PDF-' end || coalesce(html, '') as c from pages)
select 'p' || cast(page_id as varchar) || '.pdf' as name, case when strlen(c) > 3000 then 'too-large' when not starts_with(c, '%PDF-') then 'not-pdf' end as reason, case when strlen(c) <= 3000 and starts_with(c, '%PDF-') then strlen(c) end as length from b where c <> ''""")
def read_pdf_blobs(spark, folder):
    """Pages as PDF files, accepted by their mark and length."""
    blobs = table(spark, folder, "pages").selectExpr("concat('p', page_id, '.pdf') as path", "cast(concat(if(page_id % 3 = 0, '', '%PDF-'), coalesce(html, '')) as binary) as content")
    found = files.pdf_files(spark, _written(spark, blobs), 3000)
    return found.select(F.element_at(F.split("path", "/", -1), -1).alias("name"), "reason", F.when(F.col("reason").isNull(), F.col("length")).alias("length"))


#: Two registrations of names that two documents share: the odd ones come later. Some have no chunk, half a pdf, or no pdf.
REGISTER_SQL = """o as (select doc_id, doc_id // 2 as k, doc_id % 10 = 4 as dumb from documents where doc_id % 2 = 0), n as (select doc_id, doc_id // 2 as k, doc_id % 7 = 3 as dumb, doc_id % 9 = 5 as half from documents where doc_id % 2 = 1),
old as (select * from o where not dumb), new as (select * from n where not dumb and not half), live as (select 'new' as gen, doc_id, k from new union all select 'old', doc_id, k from old where k not in (select k from new)),
pdf as (select l.*, case when gen = 'new' and l.doc_id % 3 = 0 then 'new.pdf' when gen = 'old' and l.doc_id % 4 = 0 then 'old.pdf' when gen = 'new' and o.doc_id % 4 = 0 then 'old.pdf' end as file_name from live l left join old o on o.k = l.k)"""


@query("upsert_registrations", f"""with {REGISTER_SQL} select gen || cast(doc_id as varchar) as document_id, 'f' || cast(k as varchar) as source_file_name, 1 as chunks, gen as tag, file_name, null as reason from pdf
union all select 'new' || cast(doc_id as varchar), 'f' || cast(k as varchar), 0, null, null, case when half then 'half-pdf' else 'no-chunks' end from n where dumb or half""")
def upsert_registrations(spark, folder):
    """Documents registered, and their names registered again: the tables as one row for each document, and what was refused."""
    docs = table(spark, folder, "documents")

    def tables(rows, gen, dumb, pdf, half):
        own = rows.selectExpr("*", f"concat('{gen}', doc_id) as document_id")
        return {
            "documents": own.selectExpr("document_id", "'t' as title", "concat('f', doc_id div 2) as source_file_name", "doc_id as created_at"), "tags": own.selectExpr("document_id", f"'{gen}' as tag"),
            "chunks": own.where(f"not ({dumb})").selectExpr("document_id", "0 as chunk_index", "text as content"),
            "pdfs": own.where(f"({pdf}) or ({half})").selectExpr("document_id", f"'{gen}.pdf' as file_name", f"if({half}, null, cast('%PDF-' as binary)) as content"),
        }

    first = tables(docs.where("doc_id % 2 = 0"), "old", "doc_id % 10 = 4", "doc_id % 4 = 0", "false")
    empty = {t: df.limit(0) for t, df in first.items()}
    current, _ = registration.upsert_registrations(empty, first)
    out, refused = registration.upsert_registrations(current, tables(docs.where("doc_id % 2 = 1"), "new", "doc_id % 7 = 3", "doc_id % 3 = 0", "doc_id % 9 = 5"))
    chunks = out["chunks"].groupBy("document_id").agg(F.count("*").cast("int").alias("chunks"))
    found = out["documents"].join(chunks, "document_id").join(out["tags"], "document_id").join(out["pdfs"].select("document_id", "file_name"), "document_id", "left")
    none = F.lit(None).cast("string")
    return found.select("document_id", "source_file_name", "chunks", "tag", "file_name", none.alias("reason")).unionByName(
        refused.select("document_id", "source_file_name", F.lit(0).alias("chunks"), none.alias("tag"), none.alias("file_name"), "reason")
    )


@query("registration_stream", f"""with {FILES_SQL} select 'n ' || cast(doc_id as varchar) as title, case when doc_id % 5 = 0 then 'T' || cast(doc_id % 3 as varchar) end as tag, doc_id % 7 = 0 as has_pdf, starts_with(text, '#') as heads from f
where doc_id % 4 <> 3 and not broken and not bare and regexp_matches(text, '\\S')""")
def registration_stream(spark, folder):
    """Files of the documents, with tags and pdfs beside them, registered by the stream: what is then published."""
    texts = _markdown_files(spark, folder)
    number = F.regexp_extract("path", r"n (\d+)\.", 1).cast("long")
    tags = texts.where(number % 5 == 0).select(F.concat("path", F.lit(".tags")).alias("path"), F.concat(F.lit(" T"), (number % 3).cast("string"), F.lit(", ")).cast("binary").alias("content"))
    pdfs = texts.where(number % 7 == 0).select(F.concat("path", F.lit(".pdf")).alias("path"), F.lit(b"%PDF-1").alias("content"))
    inbox, out = _written(spark, texts.unionByName(tags).unionByName(pdfs)), _folder(spark)
    streams.registration_stream(spark, inbox, f"{out}/set", f"{out}/checkpoint", dim=8, files_per_batch=1_000_000).awaitTermination()
    found = registration.registered(spark, publication.snapshot(spark, f"{out}/set"))
    pdf = found["pdfs"].select("document_id", F.lit(True).alias("pdf"))
    first = found["chunks"].groupBy("document_id").agg(F.min_by("content", "chunk_index").alias("content"))
    rows = found["documents"].join(first, "document_id").join(found["tags"], "document_id", "left").join(pdf, "document_id", "left")
    return rows.select("title", "tag", F.coalesce("pdf", F.lit(False)).alias("has_pdf"), F.startswith("content", F.lit("【")).alias("heads"))


@query("answer_stream", """select conv_id * 1000 + turn as message_id, text as answer, case when turn % 3 = 0 then '[' || cast(turn as varchar) || ']' end as manual_references from conversations where role = 'assistant' and conv_id % 5 <> 0 and turn % 7 <> 5 and regexp_matches(text, '\\S')""")
def answer_stream(spark, folder):
    """Answers put together by the stream from pieces of the assistant's turns; some never end, some fail."""
    said = table(spark, folder, "conversations").where("role = 'assistant' and text is not null").selectExpr("conv_id * 1000 + turn as message_id", "conv_id", "turn", "text")
    piece = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int")), lambda i: F.struct(F.lit("delta").alias("kind"), F.substring("text", i * 40 + 1, F.lit(40)).alias("text")))
    event = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text")))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    refs = F.when(F.expr("turn % 3 = 0"), event("references", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]")))).otherwise(none)
    end = F.when(F.expr("turn % 7 = 5"), event("error", F.lit("failed"))).when(F.expr("conv_id % 5 <> 0"), event("done", F.lit(None))).otherwise(none)
    events = said.select("message_id", F.posexplode(F.concat(refs, piece, end)).alias("seq", "e")).selectExpr("message_id", "cast(seq as bigint) as seq", "e.kind", "e.text")
    out = _folder(spark)
    events.write.parquet(f"{out}/events")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    answers = streams.answer_stream(spark.readStream.schema(events.schema).parquet(f"{out}/events"))
    answers.writeStream.format("parquet").option("path", f"{out}/answers").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(answers.schema).parquet(f"{out}/answers")


def _measure(pdf):
    """A model that fails on some rows: the number of words of each text."""
    if (pdf.doc_id % 17 == 3).any():
        raise ValueError(f"no words for {pdf.doc_id[pdf.doc_id % 17 == 3].iloc[0]}")
    return [str(len(t.split())) for t in pdf.text.fillna("")]


@query("model_rows", r"""select doc_id, case when doc_id % 17 <> 3 then cast(len(regexp_extract_all(coalesce(text, ''), '\S+')) as varchar) end as body, case when doc_id % 17 = 3 then 'no words for ' || cast(doc_id as varchar) end as error from documents""")
def model_rows(spark, folder):
    """A model over all documents whose failures are their own rows' errors."""
    return ingest.model_rows(table(spark, folder, "documents").select("doc_id", "text"), _measure)
