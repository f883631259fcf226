"""Literal cases and invariants of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from leafmill.functions import kernels
from leafmill.operators import bundles, chat, chunking, ingest, lifecycle, markdown, mentions, reconcile, retrieval, validation
from leafmill.sources import files


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_similarity_and_tag_scope(spark):
    vec = lambda c: [c, math.sqrt(1 - c * c), 0.0]
    chunks = spark.createDataFrame([(1, 10, 0, vec(0.9), ["ESP-1"]), (2, 11, 0, vec(1.0), None), (3, 12, 0, vec(-1.0), ["ESP-2"])], "chunk_id long, document_id long, chunk_index long, embedding array<double>, tags array<string>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0], ["ESP-1"]), (2, [1.0, 0.0, 0.0], None)], "query_id long, embedding array<double>, wanted array<string>")
    got = [(r.query_id, r.chunk_id, round(r.similarity, 9)) for r in retrieval.search(queries, chunks, block=1).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 1.0), (1, 1, 0.9), (2, 2, 1.0), (2, 1, 0.9), (2, 3, -1.0)]
    assert [r.chunk_id for r in retrieval.search(queries, chunks, scope="tagged").collect()] == [1]
    assert retrieval.search(queries.limit(0), chunks).collect() == [] and retrieval.search(queries, chunks.limit(0)).collect() == []
    cos = spark.range(1).select(retrieval.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.6), F.lit(0.8)))).first()[0]
    assert abs(cos - 0.6) < 1e-12


def test_chunks_of_headings_and_tables(spark):
    rows = "\n".join(["| code | cause |", "| --- | --- |", "| 05 | a |", "| 〃 | b |", "| 〃 | c |", "| 06 | d |"])
    got = [r.content for r in chunking.chunk_documents(docs(spark, f"pre\n\n## A\nx\n\n## Empty\n\n## B\n{rows}"), 40, 5).orderBy("chunk_index").collect()]
    head = "【B】\n| code | cause |\n| --- | --- |\n"
    assert got == ["pre", "【A】\nx", head + "| 05 | a |\n| 〃 | b |\n| 〃 | c |", head + "| 06 | d |"]


def test_windows_overlap(spark):
    got = [r.chunk for r in chunking.fixed_windows(docs(spark, "0123456789" * 5), 20, 5).orderBy("part").collect()]
    assert all(len(c) <= 20 for c in got) and got[0][-5:] == got[1][:5] and len(got) == 4
    with pytest.raises(ValueError):
        chunking.chunk_documents(docs(spark, "x"), 10, 10)


def test_prose_packs_paragraphs(spark):
    text = "\n\n".join(["a" * 300, "b" * 300, "c" * 300, "d" * 900, "e" * 100])
    got = [r.content for r in chunking.chunk_documents(docs(spark, text)).orderBy("chunk_index").collect()]
    assert got == ["a" * 300 + "\n\n" + "b" * 300, "c" * 300, "d" * 800, "d" * 200, "e" * 100]


def test_fences_close_by_their_own_mark(spark):
    text = "```\n~~~\n| a |\n```\n| b | c |"
    state = [r.in_fence for r in markdown.fence_state(markdown.line_table(docs(spark, text))).orderBy("n").collect()]
    assert state == [True, True, True, True, False]
    assert [(r.line, r.excerpt) for r in markdown.broken_tables(docs(spark, text)).collect()] == [(5, "| b | c |")]


def repaired(spark, text):
    return markdown.repair_tables(docs(spark, text)).first().text


@pytest.mark.parametrize(
    "text, want",
    [
        ("| a | b |\n| --- | --- |\n| 1 | \\| |", "| a | b |\n| --- | --- |\n| 1 | \\| |"),
        ("| a | b | | :-- |\n| --- | --- |\n| 1 | 2 |", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        ("| a | b | c |\n| --- | --- |\n| 1 | 2 |", "| a | b | c |\n| --- | --- | --- |\n| 1 | 2 |"),
        ("| a |\n| --- | --- |", "| a |\n| --- | --- |"),
        ("| a | b |\nnote |\n| --- | --- |\n| 1 | 2 |\ntext", "| a | b |\n| --- | --- |\n| 1 | 2 |\n\nnote\n\ntext"),
        ("```\n| a | b | c |\n| --- |\n```", "```\n| a | b | c |\n| --- |\n```"),
    ],
)
def test_table_repair(spark, text, want):
    assert repaired(spark, text) == want
    assert repaired(spark, want) == want


def test_lint(spark):
    found = {(r.doc_id, r.code): r.lines for r in markdown.lint_markdown(docs(spark, "---\ntitle: T\n---\n\ntext", "---\nopen", "a <br> b `<i>`\n```\n<b>\n```", '<div style="page-break-after: always"></div>', "<https://e.example>")).collect()}
    assert found == {(0, "front-matter"): [1], (2, "raw-html"): [1]}


def test_inline_code_mask(spark):
    rows = docs(spark, "a `b` c", "``a ` b`` c", r"\`a `b` c", "no `open")
    assert [r.m for r in rows.select("doc_id", markdown.mask_inline_code(F.col("text")).alias("m")).orderBy("doc_id").collect()] == ["a   c", "  c", "\\`a   c", "no `open"]


def test_tag_mentions(spark):
    asked = spark.createDataFrame([(1, "AI and ESP-10?", None), (2, "about ＥＳＰ－１ please", None), (3, "esp-1.1 broke", None), (4, "AHUの調子は？", None), (5, "a or esp-1", "S"), (6, "nothing", "S")], "question_id long, text string, session_tag string")
    tags = spark.createDataFrame([("A",), ("ESP-1",), ("ESP-1.1",), ("AHU-1",)], "tag string")
    assert {(r.question_id, r.tag) for r in mentions.mention_join(asked, tags).collect()} == {(2, "ESP-1"), (3, "ESP-1.1"), (5, "A"), (5, "ESP-1")}
    assert {r.question_id: r.tag for r in mentions.resolve_tag(asked, tags).collect()} == {1: None, 2: "ESP-1", 3: "ESP-1.1", 4: "AHU-1", 5: "S", 6: "S"}


def test_differences_rebuild_the_page(spark):
    texts = [("code 05 broken wire", "code 05 broker wire"), ("| R-1 | 25.0 |\n", "R-1 25.0"), ("same  text\n", "same text"), ("", "x"), ("日本 語", "日本 話")]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, alternate string")
    got = reconcile.page_diff(rows).orderBy("doc_id", "pos").collect()
    assert [(r.primary_text.strip(), r.alternate_text.strip()) for r in got if r.doc_id == 0 and not r.is_match] == [("broken", "broker")]
    assert all(r.is_match for r in got if r.doc_id in (1, 2))
    for i, (text, _) in enumerate(texts):
        assert "".join(r.primary_text for r in got if r.doc_id == i) == text


def test_cancel_needs_both_orders(spark):
    seg = spark.createDataFrame([(i, 0, "s", "old text", "new words", "auto_corrected", False) for i in range(4)], "doc_id long, pos int, segment_id string, primary_text string, final_text string, status string, is_match boolean")
    judged = spark.createDataFrame([(0, "s", "straight", "1"), (0, "s", "swapped", "2"), (1, "s", "straight", "1"), (1, "s", "swapped", "1"), (2, "s", "straight", "1")], "doc_id long, segment_id string, run string, better string")
    layer = spark.createDataFrame([(3, "a page that holds the old text, and more than twenty characters")], "doc_id long, page_text string")
    got = {r.doc_id: (r.basis, r.status, r.final_text) for r in reconcile.recheck_corrections(seg, layer, judged).collect()}
    assert got == {0: ("language-cancel", "needs_review", "old text"), 1: ("keep", "auto_corrected", "new words"), 2: ("keep", "auto_corrected", "new words"), 3: ("layer-cancel", "match", "old text")}


def test_similarity_prefilters_agree_with_the_kernel(spark):
    rows = spark.createDataFrame([("abc", "a b c"), ("abcd", "abce"), ("a", "zzzzzz"), ("１２", "12")], "a string, b string")
    got = [round(r[0], 6) for r in rows.select(kernels.similarity(F.col("a"), F.col("b"), 0.6)).collect()]
    assert got == [1.0, 0.75, 0.0, 1.0]


def test_lifecycle_ignores_late_events(spark):
    events = [(1, 1, "queue"), (1, 2, "discard"), (1, 3, "start"), (1, 4, "complete"), (2, 1, "queue"), (2, 2, "start"), (2, 3, "complete"), (2, 4, "edit"), (3, 1, "start")]
    df = spark.createDataFrame([(d, t, t, e) for d, t, e in events], "draft_id long, ts long, event_id long, event string")
    assert {r.draft_id: (r.status, r.applied) for r in lifecycle.draft_lifecycle(df).collect()} == {1: ("DISCARDED", 2), 2: ("DRAFT", 4)}


def test_references(spark):
    cases = {"": ("inline", None), "#x": ("inline", None), "data:image/png;base64,": ("inline", None), "https://e": ("external", None), "//e/x": ("external", None), "../a.png?v=1": ("local", "a.png"), "../../a": ("local", None), "a%20b+c": ("local", "d/a b+c"), "%ZZ": ("local", "d/%ZZ"), "/r/./x": ("local", "r/x"), "b\\c": ("local", "d/b/c")}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").withColumn("c", bundles.classify_reference(F.col("r"), F.lit("d")))
    assert {r.r: (r.c.kind, r.c.path) for r in rows.collect()} == cases


def test_files(spark, tmp_path):
    (tmp_path / "a.MD").write_bytes(b"\xef\xbb\xbf# A")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.md").write_bytes(b" \n")
    (tmp_path / "d.doc").write_bytes(b"x")
    good, bad = files.read_markdown(spark, str(tmp_path))
    assert [(r.title, r.text) for r in good.collect()] == [("a", "# A")]
    assert sorted(r.reason for r in bad.collect()) == ["blank", "encoding", "extension"]
    (tmp_path / "p").mkdir()
    for name, data in (("x.pdf", b"%PDF-1.7"), ("y.pdf", b""), ("z.pdf", b"hello"), ("w.pdf", b"%PDF-" + b"0" * 100)):
        (tmp_path / "p" / name).write_bytes(data)
    good, bad = files.read_pdf_blobs(spark, str(tmp_path / "p"), 50)
    assert [r.path.rsplit("/", 1)[1] for r in good.collect()] == ["x.pdf"]
    assert sorted(r.reason for r in bad.collect()) == ["not-pdf", "too-large"]
    blobs = spark.createDataFrame([("e", 0, b""), ("p", 5, b"%PDF-")], "path string, length long, content binary")
    assert [r.reason for r in files.classify_pdfs(blobs).orderBy("path").collect()] == ["empty", None]


def test_embeddings_have_their_dimension(spark):
    out = ingest.embed_column(docs(spark, "a b", "c"), "text", dim=8)
    assert all(len(r.embedding) == 8 for r in out.collect())
    with pytest.raises(Exception, match="dimensions"):
        ingest.embed_column(docs(spark, "a"), "text", fn=lambda texts, dim: [[0.0]] * len(texts), dim=8).collect()
    failed = ingest.model_rows(docs(spark, "a"), lambda pdf: 1 / 0).first()
    assert failed.body is None and "division" in failed.error


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from leafmill.streaming import streams

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.createDataFrame([(d, t, t, e) for d, t, e in [(1, 1, "queue"), (1, 2, "start"), (1, 3, "complete"), (2, 1, "queue"), (2, 2, "fail")]], "draft_id long, ts long, event_id long, event string")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = streams.draft_lifecycle(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("life").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.draft_id, r.status) for r in spark.table("life").collect()} == {(r.draft_id, r.status) for r in lifecycle.draft_lifecycle(events).collect()}
    answers = spark.createDataFrame([(1, 0, "delta", "a"), (1, 1, "delta", "b"), (1, 2, "done", None), (2, 0, "delta", "x"), (3, 0, "delta", " "), (3, 1, "done", None)], "message_id long, seq long, kind string, text string")
    answers.repartition(1).write.parquet(str(tmp_path / "answers"))
    q = streams.answer_stream(spark.readStream.schema(answers.schema).parquet(str(tmp_path / "answers"))).writeStream.format("memory").queryName("answers").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.message_id, r.answer) for r in chat.assemble_answers(answers).collect() if r.status == "saved"}
    assert {(r.message_id, r.answer) for r in spark.table("answers").collect()} == want == {(1, "ab")}
    source = docs(spark, "## A\nx")
    source.write.parquet(str(tmp_path / "docs"))
    for _ in range(2):
        streams.ingest_stream(spark.readStream.schema(source.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["【A】\nx"]
    docs(spark, "## A\ny", "new").write.mode("append").parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(7, " ")], source.schema).write.mode("append").parquet(str(tmp_path / "docs"))
    streams.ingest_stream(spark.readStream.schema(source.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.doc_id, r.content) for r in streams.read_ingested(spark, str(tmp_path / "out")).collect()) == [(0, "【A】\ny"), (1, "new")]


def test_answers_carry_their_references(spark, tmp_path):
    from leafmill.streaming import streams

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.createDataFrame([(1, 0, "references", "[1]"), (1, 1, "references", "[2]"), (1, 2, "delta", "a"), (1, 3, "done", None), (2, 0, "delta", "b"), (2, 1, "done", None), (3, 0, "references", "[3]")], "message_id long, seq long, kind string, text string")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    q = streams.answer_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("refs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("refs").collect()} == {(1, "a", "[1]"), (2, "b", None)}


def test_published_versions(spark, tmp_path):
    folder = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        ingest.read_published(spark, folder)
    for text in ("first", "second"):
        ingest.publish(docs(spark, text), folder)
        assert [r.text for r in ingest.read_published(spark, folder).collect()] == [text]


def test_answer_events_of_wrong_types(spark):
    cases = {'{"type":"delta","text":5}': "missing-field", '{"type":"error","detail":true}': "missing-field", '{"type":"delta","text":"x"} trailing': "bad-json", '{"type":"delta","text":"x"},{}': "bad-json", '{"type":"delta","text":""}': None, "7": "not-an-event", '{"type":"manual_references","manual_references":null}': None, '{"type":"manual_references","manual_references":[1]}': "missing-field", '{"type":"done","message_id":"m","created_at":"c"}': None}
    got = {r.line: r.error for r in ingest.parse_answer_events(spark.createDataFrame([(c,) for c in [*cases, "  "]], "line string")).collect()}
    assert got == cases


def test_search_keeps_repeated_questions_and_passes_over_odd_vectors(spark):
    chunks = spark.createDataFrame([(i, i % 7, i, [math.cos(i / 9), math.sin(i / 9)], None) for i in range(40)] + [(100, 1, 0, None, None), (101, 1, 0, [0.0, 0.0], None), (3, 9, 3, [math.cos(3 / 9), math.sin(3 / 9)], ["t"])], "chunk_id long, document_id long, chunk_index long, embedding array<double>, tags array<string>")
    asked = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5]), (None, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [])]
    queries = spark.createDataFrame([(q, v, None) for q, v in asked], "query_id long, embedding array<double>, wanted array<string>")
    rows = lambda df: sorted((str(r.query_id), r["rank"], r.chunk_id, r.document_id, round(r.similarity, 9)) for r in df.collect())
    whole = rows(retrieval.search(queries, chunks, 3))
    assert len(whole) == 12 and rows(retrieval.search(queries, chunks, 3, block=1)) == whole
    best = rows(retrieval.best_chunk_per_document(queries, chunks, 3, None))
    assert len(best) == 12 and rows(retrieval.best_chunk_per_document(queries, chunks, 3, None, block=2)) == best


def test_one_failing_row_is_its_own_error(spark):
    def model(pdf):
        if (pdf.text == "bad").any():
            raise ValueError("bad row")
        return list(pdf.text)

    got = {r.doc_id: (r.body, r.error) for r in ingest.model_rows(docs(spark, "a", "bad", "c").coalesce(1), model).collect()}
    assert got == {0: ("a", None), 1: (None, "bad row"), 2: ("c", None)}


def test_diagrams_with_the_other_mark_inside(spark):
    text = "```\n~~~\n```\n```mermaid show=both\ngraph\n~~~\n```\n~~~mermaid\nopen"
    assert {(r.source, r.view) for r in markdown.diagram_blocks(docs(spark, text)).collect()} == {("graph\n~~~", "both"), ("open", "diagram")}


def test_bundle_ids_of_odd_folders(spark, tmp_path):
    (tmp_path / "a+b" / "one").mkdir(parents=True)
    (tmp_path / "a+b" / "one" / "x.md").write_text("x")
    assert [(r.bundle_id, r.path) for r in files.read_bundles(spark, str(tmp_path / "a+b")).collect()] == [("one", "x.md")]


def test_escaped_backticks(spark):
    cases = {r"\`a `b` c": r"\`a   c", r"a `\` b": "a   b", r"\`` x `` y`": "\\` ", r"\\`a`": r"\\ ", r"``a\`b`` \`": r"  \`", "\\": "\\"}
    got = {r.text: r.m for r in docs(spark, *cases).select("text", markdown.mask_inline_code(F.col("text")).alias("m")).collect()}
    assert got == cases


def test_names(spark):
    rows = spark.createDataFrame([("con.md",), ("a/b?.md",), ("é" * 300,), ("..",)], "raw string")
    assert [r.base for r in validation.safe_base_names(rows).collect()] == ["document", "a_b_", "é" * 100, "document"]
