"""Publication, registrations, exports and the streams that feed them."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from leafmill import folders
from leafmill.operators import exports, publication, registration
from leafmill.sources import files
from leafmill.streaming import streams


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def held(spark, folder, name="t"):
    return sorted(r.v for r in publication.snapshot(spark, folder).table(spark, name).collect())


def test_writers_at_once_lose_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/set"
    with pytest.raises(FileNotFoundError):
        publication.snapshot(spark, folder).table(spark, "t")

    def add(k):
        def change(base):
            old = base.table(spark, "t") if base.number else rows(spark)
            return {"replaced": {"t": old.unionByName(rows(spark, f"w{k}"))}}

        publication.update(spark, folder, change)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert held(spark, folder) == ["w0", "w1", "w2", "w3"] and publication.snapshot(spark, folder).number == 4


def test_the_loser_publishes_nothing(spark, tmp_path):
    folder = str(tmp_path / "set")
    base = publication.snapshot(spark, folder)
    publication.commit(spark, base, {"t": rows(spark, "first")})
    with pytest.raises(publication.Conflict):
        publication.commit(spark, base, {"t": rows(spark, "second")})
    assert held(spark, folder) == ["first"]


def test_readers_keep_one_version(spark, tmp_path):
    folder = str(tmp_path / "set")
    for k in range(3):
        publication.update(spark, folder, lambda base: {"replaced": {"t": rows(spark, f"t{k}")}, "appended": {"log": rows(spark, f"l{k}")}})
    old, new = publication.snapshot(spark, folder, 2), publication.snapshot(spark, folder)
    read = lambda s, t: sorted(r.v for r in s.table(spark, t).collect())
    assert (read(old, "t"), read(old, "log"), read(new, "t"), read(new, "log")) == (["t1"], ["l0", "l1"], ["t2"], ["l0", "l1", "l2"])
    assert publication.update(spark, folder, lambda base: None).number == 3
    rows(spark, "lost").write.parquet(f"{folder}/data/t-unnamed")
    assert not any("unnamed" in p for p in publication.vacuum(spark, folder, keep=1))  # it may belong to a writer at work
    gone = publication.vacuum(spark, folder, keep=1, older_than=-1)
    assert any("unnamed" in p for p in gone) and (held(spark, folder), held(spark, folder, "log")) == (["t2"], ["l0", "l1", "l2"])


SCHEMAS = {
    "documents": "document_id string, title string, source_file_name string, created_at long", "tags": "document_id string, tag string",
    "chunks": "document_id string, chunk_index int, content string", "pdfs": "document_id string, file_name string, content binary",
}


def tables(spark, documents, tags=(), chunks=(), pdfs=()):
    return {t: spark.createDataFrame(list(v), SCHEMAS[t]) for t, v in zip(SCHEMAS, (documents, tags, chunks, pdfs))}


def listed(found):
    return {t: sorted(map(str, (tuple(r) for r in df.select(SCHEMAS[t].replace(",", "").split()[::2]).collect()))) for t, df in found.items()}


def whole(i, name, at, pdf=None, chunk=True):
    """The rows of one registration."""
    return [(i, name, name, at)], [(i, f"T{i}")], [(i, 0, f"c{i}")] * chunk, [(i, *pdf)] if pdf else []


def joined(spark, *registrations):
    return tables(spark, *[[x for r in registrations for x in r[k]] for k in range(4)])


STEPS = [
    [whole("a1", "a", 1, ("a.pdf", b"old")), whole("b1", "b", 1), whole("c1", "c", 1, ("c.pdf", b"c"))],
    [whole("a2", "a", 2), whole("b2", "b", 2, ("b.pdf", b"new")), whole("c2", "c", 2, chunk=False), whole("d1", "d", 2, ("d.pdf", None)), whole("e1", "e", 2, (None, b"x"))],
    [whole("a3", "a", 3), whole("a4", "a", 4), whole("c3", "c", 3, ("c2.pdf", b"c2")), whole("n1", " ", 3)],
]


def test_registrations_replace_whole_documents(spark, tmp_path):
    """One operator over whole tables, and the same batch by batch with replays and a compaction between."""
    current, folder, refused = tables(spark, []), str(tmp_path / "set"), []
    for k, step in enumerate(STEPS):
        current, no = registration.upsert_registrations(current, joined(spark, *step))
        refused += [tuple(r) for r in no.collect()]
        incoming = joined(spark, *step)
        incoming["pdfs"] = incoming["pdfs"].withColumn("source_file_name", F.lit(None).cast("string"))
        for _ in range(2):
            registration.append_registrations(spark, folder, incoming, "w", k)
        if k == 1:
            registration.compact(spark, folder)
    assert sorted(refused, key=str) == [(" ", "n1", "no-name"), ("a", "a3", "superseded"), ("c", "c2", "no-chunks"), ("d", "d1", "half-pdf"), ("e", "e1", "half-pdf")]
    want = listed(current)
    assert want["documents"] == ["('a4', 'a', 'a', 4)", "('b2', 'b', 'b', 2)", "('c3', 'c', 'c', 3)"]
    assert [x.split("'")[1] for x in want["pdfs"]] == ["a4", "b2", "c3"] and "a.pdf" in want["pdfs"][0] and "c2.pdf" in want["pdfs"][2]
    assert listed(registration.registered(spark, publication.snapshot(spark, folder))) == want
    assert publication.snapshot(spark, folder).number == 4


def put(path, name, content):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "wb") as f:
        f.write(content)


def test_files_become_registrations(spark, tmp_path, monkeypatch):
    """Files as a stream: the same one again, a changed one, one without chunks, and a batch that is run again after a failure."""
    inbox, folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "set"), str(tmp_path / "cp")

    def run():
        streams.registration_stream(spark, inbox, folder, checkpoint, dim=8).awaitTermination(300)

    def state():
        found = registration.registered(spark, publication.snapshot(spark, folder))
        docs = {r.source_file_name: r.document_id for r in found["documents"].collect()}
        of = {v: k for k, v in docs.items()}
        return docs, {(of[r.document_id], r.content) for r in found["chunks"].collect()}, {(of[r.document_id], r.tag) for r in found["tags"].collect()}, {(of[r.document_id], bytes(r.content)) for r in found["pdfs"].collect()}

    put(f"{inbox}/1", "a.md", b"# T\n\nfirst"), put(f"{inbox}/1", "a.md.tags", "x，y, x".encode()), put(f"{inbox}/1", "a.md.pdf", b"%PDF-1"), put(f"{inbox}/1", "b b.txt", "﻿plain".encode())
    put(f"{inbox}/1", "bad.md", b"\xff"), put(f"{inbox}/1", "c.html", b"<p>"), put(f"{inbox}/1", "d.md", b" \n"), put(f"{inbox}/1", "b b.txt.pdf", b"no pdf")
    run()
    docs1, chunks, tags, pdfs = state()
    assert set(docs1) == {"a.md", "b b.txt"} and chunks == {("a.md", "【T】\nfirst"), ("b b.txt", "plain")} and tags == {("a.md", "x"), ("a.md", "y")} and pdfs == {("a.md", b"%PDF-1")}
    rejected = publication.snapshot(spark, folder).table(spark, "rejected").collect()
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in rejected} == {("bad.md", "encoding"), ("c.html", "extension"), ("d.md", "blank"), ("b b.txt.pdf", "not-pdf")}

    put(f"{inbox}/2", "a.md", b"# T\n\nfirst"), put(f"{inbox}/2", "b b.txt", b"changed"), put(f"{inbox}/2", "e.md", b"# only a heading")
    real, failed = publication._create, []

    def fails_after(session, path, content):  # the batch's version is there, but the query does not hear of it
        real(session, path, content)
        if not failed:
            failed.append(path)
            raise RuntimeError("killed")

    monkeypatch.setattr(publication, "_create", fails_after)
    with pytest.raises(Exception):
        run()
    number = publication.snapshot(spark, folder).number
    run()
    assert failed and publication.snapshot(spark, folder).number == number == 2
    docs2, chunks, tags, pdfs = state()
    assert docs2["a.md"] != docs1["a.md"] and chunks == {("a.md", "【T】\nfirst"), ("b b.txt", "changed")} and tags == set() and pdfs == {("a.md", b"%PDF-1")}
    assert {r.reason for r in publication.snapshot(spark, folder).table(spark, "refused").collect()} == {"no-chunks"}

    put(f"{inbox}/3", "b b.txt.pdf", b"%PDF-2")  # a pdf for a document that is there
    run()
    assert state()[3] == {("a.md", b"%PDF-1"), ("b b.txt", b"%PDF-2")}
    batch = files.registrations(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{inbox}/1"), 8)[0]
    out, _ = registration.upsert_registrations({t: df.limit(0) for t, df in batch.items()}, batch)
    assert {r.document_id for r in out["documents"].collect()} == set(docs1.values())


def test_tasks_list_a_folder_as_spark_does(spark, tmp_path):
    """Before, the driver listed and planned every file; the rows are the same."""
    for folder, names in {"in": ("a b.md", "p+q.txt", "100%.md", "x#y?z.md", "ünï　.md", ".hidden", "_hidden", "_k=v", "z._COPYING_"), "in/sub/deep": ("a.md", "n.md.pdf"), "in/.sub": ("no",), "in/_sub": ("no",), "in/k=1": ("yes",)}.items():
        for n in names:
            put(tmp_path / folder, n, f"{folder} {n}".encode())
    put(tmp_path / "in", "empty.md", b"")
    path = str(tmp_path / "in")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    want = sorted(map(str, whole.collect()))
    assert len(want) == 9 and sorted(map(str, folders.stored(spark, path).collect())) == want
    assert folders.stored(spark, path).schema == whole.schema and folders.listed(spark, path).count() == 9
    assert [r.path.rsplit("/", 1)[1] for r in folders.stored(spark, path, "length > 16").collect()] == ["n.md.pdf"]
    assert "MapInArrow" in folders.stored(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "none").mkdir()
    assert folders.stored(spark, str(tmp_path / "none")).count() == 0
    for left in (f"{path}/*.md", f"{path}/a b.md"):  # Spark's own source reads patterns and single files
        assert folders.known(spark, left) is None and folders.stored(spark, left).count() > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        folders.stored(spark, str(tmp_path / "gone")).count()


def test_a_stream_keeps_documents_whole_and_in_order(spark, tmp_path):
    """Before, a document's tags could come in another batch than its text, and were lost."""
    inbox, folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "set"), str(tmp_path / "cp")
    for i in range(12):  # the older half of each name first, tags and pdfs long after all texts
        for k, (name, content) in enumerate(((f"{i % 6}.md", f"text {i}"), (f"{i % 6}.md.tags", f"tag {i}"), (f"{i % 6}.md.pdf", f"%PDF-{i}"))):
            put(f"{inbox}/{i}", name, content.encode())
            os.utime(f"{inbox}/{i}/{name}", (1000 + i + 500 * k, 1000 + i + 500 * k))

    def run():
        query = streams.registration_stream(spark, inbox, folder, checkpoint, dim=8, files_per_batch=9)
        query.awaitTermination(300)
        return query

    progress = [p for p in run().recentProgress if p["numInputRows"]]
    assert len(progress) > 1 and all("listed" in p["sources"][0]["description"] for p in progress)
    found = registration.registered(spark, publication.snapshot(spark, folder))
    names = {r.document_id: r.source_file_name for r in found["documents"].collect()}
    said = lambda t, c: {(names[r.document_id], bytes(r[c]).decode() if c == "content" and t == "pdfs" else r[c]) for r in found[t].collect()}
    assert said("chunks", "content") == {(f"{i - 6}.md", f"text {i}") for i in range(6, 12)}
    assert said("tags", "tag") == {(f"{i - 6}.md", f"tag {i}") for i in range(6, 12)}
    assert said("pdfs", "content") == {(f"{i - 6}.md", f"%PDF-{i}") for i in range(6, 12)}
    number = publication.snapshot(spark, folder).number
    run()
    assert publication.snapshot(spark, folder).number == number == len(progress)  # nothing new, nothing published
    rows = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    assert "Join" not in files.registrations(rows, 8)[0]["documents"]._jdf.queryExecution().analyzed().toString()  # texts meet themselves no more


def test_exports(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    made = spark.createDataFrame(
        [(1, "a/x y+1.txt", b"one"), (1, "b.bin", b""), (2, "../up", b"no"), (2, "fine.txt", b"no"), (3, "twice", b"1"), (3, "twice", b"2"), (4, "null.txt", None), (4, "good.txt", b"good")],
        "export_id long, path string, content binary",
    )
    report = {(r.export_id, r.path): (r.decision, r.written, r.bytes) for r in exports.write_exports(made, folder).collect()}
    assert report == {
        (1, "a/x y+1.txt"): ("write", True, 3), (1, "b.bin"): ("write", True, 0), (2, "../up"): ("reject", False, 0), (2, "fine.txt"): ("reject", False, 0),
        (3, "twice"): ("reject", False, 0), (4, "null.txt"): ("write", False, 0), (4, "good.txt"): ("write", True, 4),
    }
    there = lambda: sorted(os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, fs in os.walk(tmp_path / "out") for f in fs if not f.endswith(".crc"))
    assert there() == ["a/x y+1.txt", "b.bin", "good.txt"] and open(tmp_path / "out/a/x y+1.txt", "rb").read() == b"one"
    again = spark.createDataFrame([(1, "good.txt", b"other"), (1, "new.txt", b"n"), (2, "free.txt", b"f"), (5, "a", b"a folder is there")], made.schema)
    report = {r.path: (r.decision, r.written, r.error is None) for r in exports.write_exports(again, folder).collect()}
    assert report == {"good.txt": ("ask", False, True), "new.txt": ("ask", False, True), "free.txt": ("write", True, True), "a": ("write", False, False)}
    assert there() == ["a/x y+1.txt", "b.bin", "free.txt", "good.txt"] and open(tmp_path / "out/good.txt", "rb").read() == b"good"
    exports.write_exports(again.where("export_id = 1"), folder, overwrite=True)
    assert open(tmp_path / "out/good.txt", "rb").read() == b"other"


def events(spark, path, batches, schema):
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):  # one file a batch, in order
            if f.startswith("part-"):
                os.rename(f"{path}/{f}", f"{path}/{k:03d}.parquet")
                os.utime(f"{path}/{k:03d}.parquet", (k + 1, k + 1))


def drained(stream, name, mode):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(300)


def watched(stream, name, mode, until, seconds=90):
    """The sink's rows once ``until`` holds of them: a query with a machine's clock does not end by itself."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(seconds):
            rows = stream.sparkSession.table(name).collect()
            if until(rows, query):
                return rows
            query.awaitTermination(1)
    finally:
        query.stop()
    return rows


def read_batches(n):
    """Whether the query has read files in n batches, and begun one after them."""
    return lambda rows, query: sum(p["numInputRows"] > 0 for p in query.recentProgress) >= n and query.lastProgress["numInputRows"] == 0


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_interrupted_drafts_fail_by_themselves(spark, tmp_path):
    """By the events' clock: a draft that stays running is failed once the watermark has passed its time, another one is not."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [
        [(1, at(0), 1, "queue"), (1, at(1), 2, "start"), (2, at(0), 3, "queue"), (2, at(2), 4, "start"), (3, at(3), 5, "queue"), (3, at(4), 6, "discard")],
        [(2, at(50), 7, "progress"), (9, at(55), 8, "queue")], [(9, at(100), 9, "start")], [(9, at(101), 10, "complete")], [(1, at(102), 11, "complete"), (2, at(102), 12, "complete")],
    ]
    events(spark, str(tmp_path / "in"), [[(d, t, i, e) for d, t, i, e in b] for b in batches], "draft_id long, at string, event_id long, event string")
    source = spark.readStream.schema("draft_id long, at string, event_id long, event string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    timed = source.select("draft_id", F.to_timestamp("at").alias("ts"), "event_id", "event").withWatermark("ts", "0 seconds")
    drained(streams.draft_lifecycle(timed, timeout_ms=60_000, clock="event"), "expiring", "update")
    got = [(r.draft_id, r.status, r.error_message) for r in spark.table("expiring").collect()]
    assert (1, "FAILED", streams.INTERRUPTED) in got and (1, "DRAFT", None) not in got
    assert (2, "DRAFT", None) in got and (2, "FAILED", streams.INTERRUPTED) not in got and (9, "DRAFT", None) in got
    assert not any(d == 3 and s == "FAILED" for d, s, _ in got)
    with pytest.raises(ValueError):
        streams.draft_lifecycle(timed, 1, "sun")


def test_the_machines_clock(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "draft_id long, ts long, event_id long, event string"
    events(spark, str(tmp_path / "in"), [[(1, 1, 1, "queue"), (1, 2, 2, "start"), (2, 1, 3, "queue"), (2, 2, 4, "fail")]], schema)
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    failed = lambda rows, query: any(r.error_message for r in rows)
    got = {(r.draft_id, r.status, r.error_message) for r in watched(streams.draft_lifecycle(source, timeout_ms=500), "machine", "update", failed)}
    assert got == {(1, "RUNNING", None), (1, "FAILED", streams.INTERRUPTED), (2, "FAILED", None)}


def test_answers_once(spark, tmp_path):
    """Answers from files of JSON lines; what is delivered again, or after the end, gives no second answer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    first = b'{"type":"manual_references","manual_references":[]}\n{"type":"delta","text":"he"}\n{"type":"delta","text":"llo"}\nbroken\n\n{"type":"done","message_id":"m","created_at":"t"}\n'
    put(f"{tmp_path}/in", "1.ndjson", first), put(f"{tmp_path}/in", "2.ndjson", b'{"type":"delta","text":"never ends"}')
    good, errors = files.read_answers(spark, f"{tmp_path}/in")
    said = watched(streams.answer_stream(good, ttl_ms=3_600_000), "said", "append", read_batches(1))
    drained(errors, "wrong", "append")
    assert [(r.message_id.rsplit("/", 1)[1], r.answer, r.manual_references) for r in said] == [("1.ndjson", "hello", "[]")]
    assert [(r.seq, r.error) for r in spark.table("wrong").collect()] == [(3, "bad-json")]
    schema = "message_id long, seq long, kind string, text string"
    told = [[(1, 0, "delta", "a"), (1, 1, "delta", "b")], [(1, 1, "delta", "b"), (1, 0, "delta", "a"), (1, 2, "delta", "c")], [(1, 3, "done", None)], [(1, 0, "delta", "a"), (1, 1, "delta", "b"), (1, 3, "done", None)], [(1, 4, "delta", "late"), (1, 5, "done", None)]]
    events(spark, str(tmp_path / "events"), told, schema)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    again = watched(streams.answer_stream(source, ttl_ms=3_600_000), "again", "append", read_batches(len(told)))
    assert [(r.message_id, r.answer) for r in again] == [(1, "abc")]
    events(spark, str(tmp_path / "cut"), [[(1, 0, "delta", "gone")]], schema)
    late = spark.readStream.schema(schema).parquet(str(tmp_path / "cut"))
    query = streams.answer_stream(late, ttl_ms=1000).writeStream.format("memory").queryName("cut").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(90):
            query.awaitTermination(1)
            if query.lastProgress and query.lastProgress["batchId"] > 0:
                break
        query.awaitTermination(2)
        spark.createDataFrame([(1, 1, "delta", "new"), (1, 2, "done", None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "cut"))
        for _ in range(90):
            query.awaitTermination(1)
            if spark.table("cut").count():
                break
    finally:
        query.stop()
    assert [r.answer for r in spark.table("cut").collect()] == ["new"]  # what was left of the interrupted answer had gone
