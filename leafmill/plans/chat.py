"""Queries over conversations and what they mention."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import chat as op
from leafmill.operators import mentions
from leafmill.tables import table

from .registry import query


def conversations(spark, folder):
    return table(spark, folder, "conversations")


#: Of the given texts NFKC and case folding change ß alone beyond lower case; tests/test_whole_tables.py has other characters.
#: Tags: the first word of each conversation's first turn, and its first three letters with a hyphen.
WORDS_SQL = """words as (
  select distinct lower(regexp_extract(text, '([A-Za-z]+)', 1)) as tag from conversations where turn = 0 and regexp_matches(text, '[A-Za-z]')
), asked as (select conv_id * 1000 + turn as question_id, replace(lower(nfc_normalize(text)), 'ß', 'ss') as q, case when conv_id % 2 = 0 then 'session' end as session_tag from conversations where role = 'user')"""


def _tags(spark, folder):
    return conversations(spark, folder).where(r"turn = 0 and text rlike '[A-Za-z]'").selectExpr("lower(regexp_extract(text, '([A-Za-z]+)', 1)) as tag").distinct()


def _questions(spark, folder):
    return conversations(spark, folder).where("role = 'user'").selectExpr("conv_id * 1000 + turn as question_id", "text", "if(conv_id % 2 = 0, 'session', null) as session_tag")


MENTIONS_SQL = f"""with {WORDS_SQL}, spots as (select question_id, q, tag, unnest(generate_series(1, length(q) - length(tag) + 1)) as p from asked, words where contains(q, tag)),
found as (select question_id, tag, p - 1 as s, p - 1 + length(tag) as e from spots
  where substring(q, p, length(tag)) = tag and not (p > 1 and regexp_matches(substring(q, p - 1, 1), '^[a-z0-9]$')) and not regexp_matches(substring(q, p + length(tag), 1), '^[a-z0-9]$')),
free as (select distinct question_id, tag from found f where not exists (select 1 from found o where o.question_id = f.question_id and o.tag <> f.tag and o.s <= f.s and f.e <= o.e and not (o.s = f.s and o.e = f.e)))"""


@query("tag_mentions", MENTIONS_SQL + ' select question_id, tag, s as start, e as "end" from found join free using (question_id, tag)')
def tag_mentions(spark, folder):
    return mentions.mention_join(_questions(spark, folder), _tags(spark, folder))


PREFIX_SQL = """, tokens as (select distinct question_id, unnest(regexp_extract_all(q, '[A-Za-z0-9][A-Za-z0-9-]*')) as token from asked),
prefixed as (select distinct question_id, tag from tokens join words on starts_with(tag, token) where length(token) >= 3)"""


@query("prefix_mentions", f"with {WORDS_SQL} {PREFIX_SQL} select question_id, tag from prefixed")
def prefix_mentions(spark, folder):
    return mentions.prefix_mentions(_questions(spark, folder), _tags(spark, folder))


@query("resolve_tag", MENTIONS_SQL + PREFIX_SQL + """, named as (select question_id, tag from free union all select question_id, tag from prefixed where question_id not in (select question_id from free)),
per as (select question_id, count(*) as n, min(tag) as one from named group by question_id)
select question_id, coalesce(case when n = 1 then one end, session_tag) as tag from asked left join per using (question_id)""")
def resolve_tag(spark, folder):
    return mentions.resolve_tag(_questions(spark, folder), _tags(spark, folder))


#: The same under the names by which the tests know them.
@query("tag_mentions_all")
def tag_mentions_all(spark, folder):
    return mentions.mention_join(_questions(spark, folder), _tags(spark, folder))


@query("prefix_mentions_all")
def prefix_mentions_all(spark, folder):
    return mentions.prefix_mentions(_questions(spark, folder), _tags(spark, folder))


@query("resolve_tag_all")
def resolve_tag_all(spark, folder):
    return mentions.resolve_tag(_questions(spark, folder), _tags(spark, folder))


@query("manual_request", "select conv_id, turn, contains(t, 'マニュアル') or contains(t, '取説') or contains(t, '説明書') as manual_request from (select *, text || (case turn % 4 when 0 then '取説は？' when 1 then '取扱説明書' else '' end) as t from conversations)")
def manual_request(spark, folder):
    asked = conversations(spark, folder).selectExpr("conv_id", "turn", "concat(text, case turn % 4 when 0 then '取説は？' when 1 then '取扱説明書' else '' end) as text")
    return mentions.flag_manual_request(asked).select("conv_id", "turn", "manual_request")


@query("trim_history", """select conv_id, turn, role, length(text) as chars from (select *, sum(length(text)) over w as cum, row_number() over w as nth from conversations window w as (partition by conv_id order by turn desc)) where cum <= 3000 or nth = 1""")
def trim_history(spark, folder):
    return op.trim_history(conversations(spark, folder)).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("session_titles", "select conv_id, arg_min(left(text, 255), turn) as title from conversations where role = 'user' group by conv_id")
def session_titles(spark, folder):
    return op.session_titles(conversations(spark, folder))


@query("order_messages", "select conv_id, turn, role, row_number() over (partition by conv_id order by turn // 2, role desc, turn) as position from conversations where role <> 'system'")
def order_messages(spark, folder):
    """Two turns share a moment; a second turn of the same role in it comes after the first."""
    told = conversations(spark, folder).where("role <> 'system'").withColumn("moment", F.expr("turn div 2"))
    return op.order_messages(told, "moment").select("conv_id", "turn", "role", "position")


@query("latest_sessions", "select conv_id as session_id, max(turn) as created_at from conversations group by conv_id")
def latest_sessions(spark, folder):
    sessions = conversations(spark, folder).groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("created_at"))
    return op.latest_sessions(sessions)


#: Answers cut into deltas of 40 characters; every fifth conversation's lack their end.
@query("answer_assembly", """with a as (select conv_id * 1000 + turn as message_id, case when turn % 7 = 3 then '  ' else text end as text, conv_id % 5 <> 0 as done from conversations where role = 'assistant')
select message_id, case when done and trim(text) <> '' then text end as answer, case when not done then 'interrupted' when trim(text) = '' then 'empty' else 'saved' end as status from a""")
def answer_assembly(spark, folder):
    a = conversations(spark, folder).where("role = 'assistant'").selectExpr("conv_id * 1000 + turn as message_id", "if(turn % 7 = 3, '  ', text) as text", "conv_id % 5 <> 0 as done")
    deltas = a.selectExpr("message_id", "explode(sequence(0, (length(text) - 1) div 40)) as seq", "'delta' as kind", "text as whole").selectExpr("message_id", "seq", "kind", "substring(whole, seq * 40 + 1, 40) as text")
    ends = a.where("done").selectExpr("message_id", "1000000 as seq", "'done' as kind", "cast(null as string) as text")
    return op.assemble_answers(deltas.unionByName(ends))


@query("build_messages", """with kept as (select * from (select *, sum(length(text)) over w as cum, row_number() over w as nth from conversations window w as (partition by conv_id order by turn desc)) where cum <= 3000 or nth = 1),
h as (select conv_id, count(*) as n, string_agg(role || ':' || text, chr(10) order by turn) as past from kept group by conv_id)
select conv_id, n + 2 as n_messages, 'system:base' || (case when conv_id % 3 = 0 then ' +manual' else '' end) || (case when conv_id % 2 = 0 then ' +tags' else '' end) || chr(10) || chr(10) || 'context ' || cast(conv_id as varchar) || chr(10) || past || chr(10) || 'user:question' as flat from h""")
def build_messages(spark, folder):
    asked = conversations(spark, folder).select("conv_id").distinct().selectExpr("conv_id", "'question' as question", "concat('context ', conv_id) as context", "conv_id % 3 = 0 as manual_request", "if(conv_id % 2 = 0, array('t'), null) as matched")
    out = op.build_messages(asked, conversations(spark, folder))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return out.select("conv_id", F.size("messages").cast("long").alias("n_messages"), flat.alias("flat"))


@query("delete_cascade", """with s as (select distinct conv_id from conversations), ids as (select distinct conv_id * 3 as conv_id from s)
select 'session' as what, conv_id, cast(null as bigint) as turn from s where conv_id not in (select conv_id from ids)
union all select 'message', conv_id, turn from conversations where conv_id not in (select conv_id from ids) union all select 'unknown', conv_id, null from ids where conv_id not in (select conv_id from s)""")
def delete_cascade(spark, folder):
    messages = conversations(spark, folder)
    sessions = messages.select("conv_id").distinct()
    s, m, u = op.delete_cascade(sessions, messages, sessions.selectExpr("conv_id * 3 as conv_id"))
    tail = lambda df, what: df.selectExpr(f"'{what}' as what", "conv_id", "turn" if "turn" in df.columns else "cast(null as bigint) as turn")
    return tail(s, "session").unionByName(tail(m, "message")).unionByName(tail(u, "unknown"))


@query("excerpts", "select conv_id, turn, case when length(text) > 100 then left(text, 100) || '…' else text end as excerpt, length(text) > 100 as truncated from conversations")
def excerpts(spark, folder):
    return op.excerpt(conversations(spark, folder), "text").select("conv_id", "turn", "excerpt", "truncated")
