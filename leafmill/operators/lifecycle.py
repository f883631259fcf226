"""Draft lifecycles and edits, as batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which events a state takes, and where they lead. Every other pair changes nothing.
TRANSITIONS = {
    ("QUEUED", "start"): "RUNNING", ("RUNNING", "progress"): "RUNNING", ("RUNNING", "complete"): "DRAFT", ("QUEUED", "fail"): "FAILED", ("RUNNING", "fail"): "FAILED",
    ("DRAFT", "edit"): "DRAFT", ("QUEUED", "discard"): "DISCARDED", ("RUNNING", "discard"): "DISCARDED", ("DRAFT", "discard"): "DISCARDED", ("FAILED", "discard"): "DISCARDED",
}
NEW = ""
QUIET_SECONDS = 1.5


def next_state(state: Column, event: Column) -> Column:
    """The state after an event; a queue event makes a draft that is not there yet."""
    out = F.when((state == NEW) & (event == "queue"), "QUEUED")
    for (a, e), b in TRANSITIONS.items():
        out = out.when((state == a) & (event == e), b)
    return out.otherwise(state)


def guarded_transition(pairs: DataFrame) -> DataFrame:
    """Rows (state, event) with the state after it and whether it was accepted."""
    accepted = F.concat_ws(">", "state", "event").isin(*[f"{a}>{e}" for a, e in TRANSITIONS])
    return pairs.withColumns({"next": next_state(F.col("state"), F.col("event")), "accepted": accepted})


#: The states that a draft can be in before an event.
STATES = (NEW, "QUEUED", "RUNNING", "DRAFT", "FAILED", "DISCARDED")


#: Events that are folded at once.
RANGE = 10_000


def folded_events(events: DataFrame) -> DataFrame:
    """(draft_id, status, applied, pages_done): each draft after its events in order of (ts, event_id), how many took effect, and the pages of the last progress that did.

    A range partitioning by (draft, time) splits the events of a draft of any size; in each partition at
    most RANGE events in a row become a map from each state to what they lead to. Maps compose: those of a partition
    and then those of a draft, so that no row grows with a draft's events but by one map for each partition.
    """
    kind = "struct<status:string,applied:bigint,pages:int>"
    pages = F.col("pages_done").cast("int") if "pages_done" in events.columns else F.lit(None).cast("int")
    own = events.select("draft_id", "ts", "event_id", "event", pages.alias("pages"))
    place = ["draft_id", "ts", "event_id", "event"]
    numbered = own.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("at", F.monotonically_increasing_id())
    ranges = numbered.groupBy("draft_id", F.expr(f"at div {RANGE}").alias("range")).agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "event", "pages"))).alias("es"))

    def step(s, e):
        takes = ((s["status"] == NEW) & (e["event"] == "queue")) | F.concat_ws(">", s["status"], e["event"]).isin(*[f"{a}>{x}" for a, x in TRANSITIONS])
        done = F.when((s["status"] == "RUNNING") & (e["event"] == "progress"), F.coalesce(e["pages"], s["pages"])).otherwise(s["pages"])
        return F.struct(next_state(s["status"], e["event"]).alias("status"), (s["applied"] + takes.cast("bigint")).alias("applied"), done.alias("pages")).cast(kind)

    start = lambda state: F.struct(F.lit(state).alias("status"), F.lit(0).cast("bigint").alias("applied"), F.lit(None).cast("int").alias("pages")).cast(kind)
    states = F.array(*[F.lit(s) for s in STATES])
    from_all = lambda column, fold: F.transform(F.array(*[start(s) for s in STATES]), lambda s: F.aggregate(column, s, fold)).alias("after")

    def compose(s, m):
        reached = F.get(m["after"], F.array_position(states, s["status"]).cast("int") - 1)
        return F.struct(reached["status"].alias("status"), (s["applied"] + reached["applied"]).alias("applied"), F.coalesce(reached["pages"], s["pages"]).alias("pages")).cast(kind)

    in_order = F.sort_array(F.collect_list(F.struct("at", "after"))).alias("maps")
    maps = ranges.select("draft_id", "at", from_all("es", step))
    parts = maps.groupBy("draft_id", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("at"), in_order)
    whole = parts.select("draft_id", "at", from_all("maps", compose)).groupBy("draft_id").agg(in_order)
    return whole.select("draft_id", F.aggregate("maps", start(NEW), compose).alias("s")).select("draft_id", "s.status", "s.applied", F.col("s.pages").alias("pages_done"))


def draft_lifecycle(events: DataFrame) -> DataFrame:
    """(draft_id, status, applied): the state of each draft after its events in order of (ts, event_id), and how many took effect."""
    return folded_events(events).where(F.col("status") != NEW).drop("pages_done")


def settled(drafts: DataFrame, states: DataFrame) -> DataFrame:
    """Drafts (draft_id, pdf_content and more) with the status that their events lead to; a discarded one loses its pdf."""
    out = drafts.drop("status").join(states.select("draft_id", "status"), "draft_id", "left")
    return out.withColumn("pdf_content", F.when(~F.coalesce(F.col("status") == "DISCARDED", F.lit(False)), F.col("pdf_content")))


def draft_progress_latest(events: DataFrame) -> DataFrame:
    """(draft_id, pages_done) of each draft's last progress while it was running; other progress changes nothing."""
    return folded_events(events).where("pages_done is not null").select("draft_id", "pages_done")


def expire_interrupted(drafts: DataFrame, message: str = "interrupted") -> DataFrame:
    """Drafts that a restart found queued or running are failed; others stay."""
    cut = F.col("status").isin("QUEUED", "RUNNING")
    return drafts.withColumns({"status": F.when(cut, "FAILED").otherwise(F.col("status")), "error_message": F.when(cut, F.lit(message))})


def latest_drafts(drafts: DataFrame, n: int = 50) -> DataFrame:
    """The newest drafts that are not discarded."""
    return drafts.where("status <> 'DISCARDED'").orderBy(F.col("created_at").desc(), "draft_id").limit(n)


def draft_progress(drafts: DataFrame) -> DataFrame:
    """Drafts with known, done (clamped) and percent; known only with pages and past the queue."""
    known = (F.col("page_count") > 0) & (F.col("status") != "QUEUED")
    done = F.greatest(F.lit(0), F.least("page_count", "pages_done"))
    return drafts.withColumns({"known": known, "done": F.when(known, done), "percent": F.when(known, F.floor(done * 100 / F.col("page_count") + 0.5))})


def debounce_latest(edits: DataFrame, quiet: float = QUIET_SECONDS) -> DataFrame:
    """(draft_id, saved_at, text): the last edit of each burst that ``quiet`` seconds without edits end; a null edit saves nothing.

    edits: draft_id, ts, event_id, text.
    """
    w = Window.partitionBy("draft_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    bursts = edits.withColumn("opens", F.coalesce((gap >= int(quiet * 1e6)).cast("int"), F.lit(1))).withColumn("burst", F.sum("opens").over(w))
    last = bursts.groupBy("draft_id", "burst").agg(F.max_by(F.struct("ts", "text"), F.struct("ts", "event_id")).alias("e"))
    return last.select("draft_id", F.col("e.ts").alias("saved_at"), "e.text").where("text is not null")
