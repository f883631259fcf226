"""Queries over draft events derived from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import ingest, lifecycle as op
from leafmill.tables import table

from . import fixtures as fx
from .registry import query

RUN_SQL = "with recursive " + fx.LIFE_SQL.strip() + """, seq as (select *, row_number() over (partition by draft_id order by ts, event_id) as i from life),
run as (
  select draft_id, i, case when event = 'queue' then 'QUEUED' else '' end as status, (event = 'queue')::bigint as applied from seq where i = 1
  union all
  select s.draft_id, s.i, n.st, r.applied + (case when (r.status = '' and s.event = 'queue') or n.st <> r.status or (r.status = 'RUNNING' and s.event = 'progress') or (r.status = 'DRAFT' and s.event = 'edit') then 1 else 0 end)
  from run r join seq s on s.draft_id = r.draft_id and s.i = r.i + 1,
  lateral (select case when r.status = '' and s.event = 'queue' then 'QUEUED' when r.status = 'QUEUED' and s.event = 'start' then 'RUNNING' when r.status = 'RUNNING' and s.event = 'complete' then 'DRAFT'
    when r.status in ('QUEUED', 'RUNNING') and s.event = 'fail' then 'FAILED' when r.status not in ('', 'DISCARDED') and s.event = 'discard' then 'DISCARDED' else r.status end as st) n
), final as (select draft_id, arg_max(status, i) as status, arg_max(applied, i) as applied from run group by draft_id)"""  # fmt: skip


@query("draft_lifecycle", RUN_SQL + " select draft_id, status, applied from final where status <> ''")
def draft_lifecycle(spark, folder):
    return op.draft_lifecycle(fx.life(spark, folder))


@query("draft_progress_latest", RUN_SQL + ", told as (select s.draft_id, s.i, s.pages_done from seq s join run r on r.draft_id = s.draft_id and r.i = s.i - 1 where s.event = 'progress' and r.status = 'RUNNING') select draft_id, arg_max(pages_done, i) as pages_done from told group by draft_id")
def draft_progress_latest(spark, folder):
    return op.draft_progress_latest(fx.life(spark, folder))


@query("expire_interrupted", RUN_SQL + " select draft_id, case when status in ('QUEUED', 'RUNNING') then 'FAILED' else status end as status, case when status in ('QUEUED', 'RUNNING') then 'interrupted' end as error_message from final where status <> ''")
def expire_interrupted(spark, folder):
    return op.expire_interrupted(op.draft_lifecycle(fx.life(spark, folder))).select("draft_id", "status", "error_message")


#: The same without the discards of every other draft.
KEPT_SQL = RUN_SQL.replace("as i from life)", "as i from life where event <> 'discard' or draft_id % 2 = 1)")


@query("latest_drafts", KEPT_SQL + ", t as (select draft_id, max(event_id) as created_at from life group by draft_id) select draft_id, status, created_at from final join t using (draft_id) where status not in ('', 'DISCARDED') order by created_at desc, draft_id limit 50")
def latest_drafts(spark, folder):
    events = fx.life(spark, folder)
    created = events.groupBy("draft_id").agg(F.max("event_id").alias("created_at"))
    return op.latest_drafts(op.draft_lifecycle(events.where("event <> 'discard' or draft_id % 2 = 1")).join(created, "draft_id")).select("draft_id", "status", "created_at")


@query("settled_drafts", RUN_SQL + " select draft_id, status, case when status <> 'DISCARDED' then 'pdf' || cast(draft_id as varchar) end as pdf from final where status <> ''")
def settled_drafts(spark, folder):
    """Drafts after their events; a discarded one has no pdf any more."""
    states = op.draft_lifecycle(fx.life(spark, folder))
    drafts = states.selectExpr("draft_id", "cast(concat('pdf', draft_id) as binary) as pdf_content")
    return op.settled(drafts, states).select("draft_id", "status", F.col("pdf_content").cast("string").alias("pdf"))


@query("guarded_transition", """with e as (select event_id, case event_id % 6 when 0 then 'QUEUED' when 1 then 'RUNNING' when 2 then 'DRAFT' when 3 then 'FAILED' when 4 then 'DISCARDED' else 'QUEUED' end as state,
  case event_type when 'signup' then 'start' when 'view' then 'progress' when 'click' then 'complete' when 'purchase' then 'fail' else 'discard' end as event from events)
select event_id, case when state = 'QUEUED' and event = 'start' then 'RUNNING' when state = 'RUNNING' and event = 'complete' then 'DRAFT' when state in ('QUEUED', 'RUNNING') and event = 'fail' then 'FAILED' when event = 'discard' then 'DISCARDED' else state end as next,
  (state = 'QUEUED' and event in ('start', 'fail', 'discard')) or (state = 'RUNNING' and event in ('progress', 'complete', 'fail', 'discard')) or (state in ('DRAFT', 'FAILED') and event = 'discard') as accepted from e""")
def guarded_transition(spark, folder):
    pairs = table(spark, folder, "events").selectExpr("event_id", "element_at(array('QUEUED', 'RUNNING', 'DRAFT', 'FAILED', 'DISCARDED', 'QUEUED'), cast(event_id % 6 as int) + 1) as state", "case event_type when 'signup' then 'start' when 'view' then 'progress' when 'click' then 'complete' when 'purchase' then 'fail' else 'discard' end as event")
    return op.guarded_transition(pairs).select("event_id", "next", "accepted")


@query("draft_progress", """with d as (select event_id, case when event_id % 4 = 0 then 'QUEUED' else 'RUNNING' end as status, event_id % 7 as page_count, event_id % 11 as pages_done from events)
select event_id, page_count > 0 and status <> 'QUEUED' as known, case when page_count > 0 and status <> 'QUEUED' then least(page_count, pages_done) end as done,
  case when page_count > 0 and status <> 'QUEUED' then cast(floor(least(page_count, pages_done) * 100 / page_count + 0.5) as bigint) end as percent from d""")
def draft_progress(spark, folder):
    drafts = table(spark, folder, "events").selectExpr("event_id", "if(event_id % 4 = 0, 'QUEUED', 'RUNNING') as status", "event_id % 7 as page_count", "event_id % 11 as pages_done")
    return op.draft_progress(drafts).select("event_id", "known", "done", "percent")


@query("debounce_latest", """with e as (select user_id as draft_id, ts, event_id, case when event_type <> 'error' then event_type end as text from events),
g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) >= 3600000000 or lag(ts) over w is null then 1 else 0 end as o from e window w as (partition by draft_id order by ts, event_id)),
b as (select *, sum(o) over (partition by draft_id order by ts, event_id) as burst from g), l as (select *, row_number() over (partition by draft_id, burst order by ts desc, event_id desc) as r from b)
select draft_id, epoch_us(ts) as saved_at, text from l where r = 1 and text is not null""")
def debounce_latest(spark, folder):
    edits = table(spark, folder, "events").selectExpr("user_id as draft_id", "ts", "event_id", "if(event_type <> 'error', event_type, null) as text")
    return op.debounce_latest(edits, 3600).select("draft_id", F.unix_micros(F.col("saved_at").cast("timestamp")).alias("saved_at"), "text")


@query("upsert_documents", """select 'f' || cast(doc_id // 2 as varchar) as source_file_name, 'new' || cast(doc_id as varchar) as document_id, text, case when doc_id % 6 = 1 then 'pdf-new' when (doc_id - 1) % 4 = 0 then 'pdf-old' end as pdf from documents where doc_id % 2 = 1
union all select 'f' || cast(doc_id // 2 as varchar), 'old' || cast(doc_id as varchar), text, case when doc_id % 4 = 0 then 'pdf-old' end from documents where doc_id % 2 = 0 and doc_id + 1 not in (select doc_id from documents)""")
def upsert_documents(spark, folder):
    docs = table(spark, folder, "documents")
    cols = lambda kind, pdf: ("concat('f', doc_id div 2) as source_file_name", f"concat('{kind}', doc_id) as document_id", "text", f"{pdf} as pdf", "doc_id as version")
    old = docs.where("doc_id % 2 = 0").selectExpr(*cols("old", "if(doc_id % 4 = 0, 'pdf-old', null)"))
    new = docs.where("doc_id % 2 = 1").selectExpr(*cols("new", "if(doc_id % 6 = 1, 'pdf-new', null)"))
    return ingest.upsert_documents(old, new).select("source_file_name", "document_id", "text", "pdf")


@query("upsert_pdf", "select c_custkey as document_id, case when c_custkey % 3 = 0 then 'new' else 'old' end as content from customer")
def upsert_pdf(spark, folder):
    customers = table(spark, folder, "customer")
    old = customers.selectExpr("c_custkey as document_id", "'old' as content", "0 as created_at")
    return ingest.upsert_pdf(old, customers.where("c_custkey % 3 = 0").selectExpr("c_custkey as document_id", "'new' as content", "1 as created_at")).select("document_id", "content")


@query("answer_events", """select event_id, case when event_type = 'error' then 'bad-json' when event_type = 'signup' then 'unknown-type' when event_type = 'view' then 'missing-field' end as error from events""")
def answer_events(spark, folder):
    lines = table(spark, folder, "events").selectExpr("event_id", """case event_type when 'error' then '{"type":' when 'signup' then '{"type":"x"}' when 'view' then '{"type":"delta"}' when 'click' then '{"type":"done","message_id":"m","created_at":"now"}' else concat('{"type":"delta","text":"t', event_id, '"}') end as line""")
    return ingest.parse_answer_events(lines).select("event_id", "error")


@query("answer_event_types", """select event_id, case event_id % 12 when 0 then null when 1 then 'missing-field' when 2 then 'missing-field' when 3 then 'bad-json' when 4 then 'missing-field' when 5 then 'missing-field'
  when 6 then null when 7 then 'missing-field' when 8 then 'not-an-event' when 9 then 'unknown-type' when 10 then null when 11 then 'missing-field' end as error,
  case when event_id % 12 in (0, 10) then 'x' || cast(event_id as varchar) end as text from events""")
def answer_event_types(spark, folder):
    """Fields of other JSON types than their event's, and what follows the value."""
    lines = table(spark, folder, "events").selectExpr("event_id", r"""element_at(array(
      concat('{"type":"delta","text":"x', event_id, '"}'), '{"type":"delta","text":5}', '{"type":"error","detail":true}', '{"type":"delta","text":"x"} trailing', '{"type":"done","message_id":"m"}', '{"type":"done","message_id":1,"created_at":"t"}',
      '{"type":"manual_references","manual_references":[{"document_title":"t","document_id":"d","similarity":1,"content":"c","has_pdf":false}]}', '{"type":"manual_references","manual_references":[{"document_title":"t","document_id":"d","similarity":"1","content":"c","has_pdf":false}]}',
      '[1]', '{"type":7}', concat('  {"type":"delta","text":"x', event_id, '"}  '), '{"type":"manual_references"}'), cast(event_id % 12 as int) + 1) as line""")
    return ingest.parse_answer_events(lines).select("event_id", "error", F.col("event.text").alias("text")).withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
