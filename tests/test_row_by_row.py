"""Markdown operators, comparisons and lifecycles against plain Python, on repeated and missing ids too."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest

from leafmill.functions import kernels
from leafmill.operators import lifecycle, markdown, reconcile


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def pieces(line):
    """(code, text) of a line, character by character."""
    out, plain, i = [], "", 0
    while i < len(line):
        before = len(line[:i]) - len(line[:i].rstrip("\\"))
        if line[i] != "`" or before % 2:
            plain, i = plain + line[i], i + 1
            continue
        run = len(line[i:]) - len(line[i:].lstrip("`"))
        close = next((m.start() for m in re.finditer("`+", line[i + run :]) if len(m.group()) == run), None)
        if close is None:
            plain, i = plain + line[i : i + run], i + run
            continue
        end = i + run + close + run
        out += [(False, plain)] if plain else []
        out.append((True, line[i:end]))
        plain, i = "", end
    return out + ([(False, plain)] if plain else [])


def escaped(text, undo):
    rule = (lambda m: m[1] + ("<" if len(m[1]) % 2 == 0 else "\\<")) if undo else (lambda m: m[1] + ("\\<" if len(m[1]) % 2 == 0 else "<"))
    return re.sub(r"(\\*)\\<" if undo else r"(\\*)<", rule, text)


def brute_escape(text, undo):
    out, open_ = [], None
    for line in text.split("\n"):
        mark = re.match(r"\s{0,3}(```|~~~)", line)
        if mark:
            open_ = mark[1] if open_ is None else None if open_ == mark[1] else open_
            out.append(line)
        else:
            out.append(line if open_ else "".join(t if code else escaped(t, undo) for code, t in pieces(line)))
    return "\n".join(out)


def random_line(rng):
    return "".join(rng.choice(["`", "``", "\\", "<", "a", " ", "<b>", "\\<"]) for _ in range(rng.randrange(14)))


@pytest.mark.parametrize("undo", [False, True])
def test_escapes_between_code(spark, undo):
    rng = random.Random(7)
    texts = ["a <b> `x` <c>", "`` <a> ` <b> `` <c>", r"\`<a>` <b>`", "```\n<a>\n```\n<b>", ""] + ["\n".join(random_line(rng) for _ in range(4)) for _ in range(400)]
    got = {r.doc_id: r.text for r in markdown.escape_angles(docs(spark, *texts), undo).collect()}
    assert got == {i: brute_escape(t, undo) for i, t in enumerate(texts)}


def test_code_segments(spark):
    rng = random.Random(8)
    lines = [random_line(rng) for _ in range(400)]
    rows = docs(spark, *lines).select("doc_id", markdown.code_segments(markdown.F.col("text")).alias("s")).collect()
    assert {r.doc_id: [tuple(x) for x in r.s] for r in rows} == {i: pieces(t) for i, t in enumerate(lines)}


def test_references(spark):
    text = "\n".join([
        "[i]: <a b.png>", "   [j]: c.png title", "    [k]: no.png", "`[l]: x` not", "[m]: `code`", "![a](x_(1).png)", "![a]( <d e.png> 't')", "`![no](n.png)` ![yes](y.png)", "![e]()",
        "<img alt='q' src=\"t.png\" width=3>", "<IMG SRC=u.png/>", "<img data-src='v.png'>", "<img src=' '>", "```", "![f](f.png)", "```",
    ])
    got = {r.ref for r in markdown.collect_references(docs(spark, text)).collect()}
    assert got == {"a b.png", "c.png", "`code`", "x_(1", "d e.png", "y.png", "t.png", "u.png"} or got == {"a b.png", "c.png", "`code`", "x_(1", "d e.png", "y.png", "t.png", "u.png/"}


def test_rows_that_share_an_id_stay_apart(spark):
    tables = ["| a | b | c |\n| --- | --- |\n| 1 | 2 |\n\n\n\nend", "```\ntext <b>\n```\n# T\n<i>\n| x | y |", "---\nt: 1\n---\n# Second\n![p](http://e/x.png)"]
    shared = spark.createDataFrame([(k, t) for k in (1, None) for t in tables * 2], "doc_id long, text string").repartition(3)
    alone = docs(spark, *tables)
    for op in (markdown.repair_tables, markdown.blank_runs, markdown.escape_angles, markdown.document_titles, markdown.lint_markdown, markdown.broken_tables):
        one = [tuple(r)[1:] for r in op(alone).collect()]
        many = [tuple(r)[1:] for r in op(shared).collect()]
        assert sorted(map(str, many)) == sorted(map(str, one * 4)), op.__name__
    fixed = {r.text for r in markdown.repair_tables(shared).collect()}
    assert tables[0].replace("| --- | --- |", "| --- | --- | --- |") in fixed


def test_displayable_images(spark):
    texts = ["![a](x.png) ![b](y.png)", "![a](x.png)", "![a](data:image/png;base64,AA)"]
    shown = spark.createDataFrame([(0, "x.png"), (1, "x.png")], "doc_id long, ref string")
    assert [(r.doc_id, r.code) for r in markdown.lint_markdown(docs(spark, *texts), shown).collect()] == [(0, "unsupported-image")]


def test_blocks_equal_difflib():
    rng, whole = random.Random(3), kernels._SMALL
    for kernels._SMALL in (0, 25, whole):
        for _ in range(400):
            n = rng.choice([2, 4, 50])
            a = [rng.randrange(n) for _ in range(rng.randrange(70))]
            b = a[rng.randrange(5) :] + [rng.randrange(n) for _ in range(rng.randrange(9))] if rng.random() < 0.6 else [rng.randrange(n) for _ in range(rng.randrange(70))]
            for _ in range(rng.randrange(6)):
                if b:
                    b[rng.randrange(len(b))] = rng.randrange(n)
            want = [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x[2]]
            assert kernels.matching_blocks(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) == want
    x, y = "αβγ δε" * 40, "βγ δεζ" * 41
    assert kernels.ratio(x, y) == SequenceMatcher(None, x, y, autojunk=False).ratio() and kernels.ratio("", "") == 1.0


def test_every_reading_is_rebuilt(spark):
    texts = [("# ", "# "), ("", ""), (None, None), ("| |", "words here"), ("words here", "---"), ("a b c", "a x c"), (" \n", ""), ("## \n", "|")]
    rows = spark.createDataFrame([(1, *t) for t in texts[:2]] + [(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, alternate string")
    got = reconcile.page_diff(rows).orderBy("doc_id", "pos").collect()
    for i, (text, _) in enumerate(texts):
        if i != 1:
            assert "".join(r.primary_text for r in got if r.doc_id == i) == (text or "")
    assert [r.is_match for r in got if r.doc_id in (3, 4, 7)] == [False, False, True]
    assert sum(r.doc_id == 1 for r in got) == 3


def test_repeats_without_blocks(spark):
    got = {r.doc_id: r.text for r in reconcile.cut_repeats(docs(spark, "", "```\n```", "a\n```\nb\n```\na\n```\nc", None)).collect()}
    assert got == {0: "", 1: "", 2: "a\n\nb", 3: ""}


def test_a_draft_of_any_length_is_folded_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "RANGE", 7)
    rng, kinds = random.Random(5), ["start", "progress", "progress", "progress", "complete", "edit", "fail"]
    rows = []
    for draft in (1, 2, 3, None):
        events = ["queue", "progress", "start"] + [rng.choice(kinds[1:4] if draft == 1 else kinds) for _ in range(500 if draft == 1 else 30)] + ["discard"] * (draft == 2) + ["progress"]
        rows += [(draft, i // 3, i, e, i) for i, e in enumerate(events)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "draft_id long, ts long, event_id long, event string, pages_done int").repartition(5)
    want, pages = {}, {}
    for draft, _, _, event, done in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        status, applied = want.get(draft, ("", 0))
        if status == "RUNNING" and event == "progress":
            pages[draft] = done
        if (status == "" and event == "queue") or (status, event) in lifecycle.TRANSITIONS:
            want[draft] = ("QUEUED" if status == "" else lifecycle.TRANSITIONS[status, event], applied + 1)
    assert {r.draft_id: (r.status, r.applied) for r in lifecycle.draft_lifecycle(table).collect()} == want
    assert {r.draft_id: r.pages_done for r in lifecycle.draft_progress_latest(table).collect()} == pages


def test_pages_go_on_to_another_reading(spark):
    said = " ".join(f"w{i} k{i}" for i in range(8))
    wrong = lambda n: " ".join(f"{'x' if i < n else 'w'}{i} k{i}" for i in range(8))
    pages = {
        1: {"primary": said, "alternate": wrong(2)}, 2: {"primary": said, "alternate": wrong(5), "second": wrong(6), "verify": said}, 3: {"primary": said, "alternate": wrong(5), "second": " ", "verify": wrong(1)},
        4: {"primary": said, "verify": said}, 5: {"primary": None, "alternate": "only this"}, 6: {"primary": said, "second": said}, 7: {"primary": "", "verify": "x"},
    }
    rows = [(9, p, s, t, False) for p, by in pages.items() for s, t in by.items()]
    readings = spark.createDataFrame(rows, "doc_id long, page int, source string, text string, ok boolean")
    fixes = spark.createDataFrame([(9, 2, "alternate", f"seg-{k}", "w0 ", False, "r", 1.0) for k in (0, 2)] + [(9, 2, "second", "seg-0", "w0 ", False, "r", 1.0)], "doc_id long, page int, source string, segment_id string, corrected_text string, still_uncertain boolean, reason string, near double")
    segments, routes = reconcile.route_readings(readings, fixes, similarity="near")
    assert {r.page: (r.source, r.review) for r in routes.collect()} == {1: ("alternate", False), 2: ("alternate", False), 3: ("verify", False), 4: ("none", True), 5: ("lost", True), 6: ("second", False), 7: ("lost", True)}
    got = segments.orderBy("page", "pos").collect()
    for p, by in pages.items():
        assert "".join(r.primary_text for r in got if r.page == p) == ((by["primary"] or "").strip() and by["primary"] or by.get("alternate", ""))
    assert sum(r.status == "needs_review" for r in got if r.page == 2) == 3
    strict, _ = reconcile.route_readings(readings, fixes, most=1, similarity="near")
    assert {r.page: r.source for r in strict.select("page", "source").distinct().collect()} == {1: "none", 2: "second", 3: "verify", 4: "none", 5: "lost", 6: "second", 7: "lost"}


def test_mentions_by_automaton_and_by_join(spark):
    """The automaton, its twin and all spans compared with each other give the same mentions."""
    from leafmill.operators import mentions

    rng = random.Random(11)
    alphabet = ["a", "b", "ab", "-", "1", " ", "é", "Ａ", "ß", "."]
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, n)))
    tags = sorted({word(4) for _ in range(60)} | {"A", "a", "SS", "ss", " "})
    texts = [word(14) for _ in range(300)] + [None, ""]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "question_id long, text string")
    known = spark.createDataFrame([(t,) for t in tags] + [(None,)], "tag string")
    want = []
    for i, text in enumerate(texts):
        q, found = mentions._plain(text or ""), []
        for tag in tags:
            name = mentions._plain(tag)
            for at in range(len(q)) if name.strip(" ") else ():
                end = at + len(name)
                edge = lambda inner, outer: not (re.match("[a-zA-Z0-9]", inner) and re.match("[a-zA-Z0-9]", outer))
                if q[at:end] == name and edge(name[0], q[at - 1 : at] if at else "") and edge(name[-1], q[end : end + 1]):
                    found.append((tag, at, end))
        inside = lambda m: any((a, b) != m[1:] and a <= m[1] and m[2] <= b for _, a, b in found)
        free = {m[0] for m in found if not inside(m)}
        want += [(i, *m) for m in found if m[0] in free]
    for bound in (1 << 20, 0):
        got = [tuple(r) for r in mentions.mention_join(asked, known, bound).select("question_id", "tag", "start", "end").collect()]
        assert sorted(got) == sorted(want), bound
    assert mentions.mention_join(asked, known.limit(0)).collect() == []


def test_chunks_of_rows_that_share_an_id(spark):
    from leafmill.operators import chunking

    texts = ["# A\nx\n\n| h |\n| - |\n| 1 |", "plain\n# B\n" + "word " * 300, None, " \n"]
    alone = {r.content for r in chunking.chunk_documents(docs(spark, *texts)).collect()}
    shared = chunking.chunk_documents(spark.createDataFrame([(k, t) for k in (1, None) for t in texts], "doc_id long, text string").repartition(3)).collect()
    assert {r.content for r in shared} == alone and len(shared) == 2 * len(chunking.chunk_documents(docs(spark, *texts)).collect())
    assert {r.chunk_index for r in shared} == {0, 1, 2, 3} or max(r.chunk_index for r in shared) >= 2
