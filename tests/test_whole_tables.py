"""Queries over all rows, other characters than ASCII included, against brute force."""

import re
import unicodedata

import pytest

from leafmill import plans
from leafmill.operators import bundles, reconcile

DOCS = [
    (0, "Ｆｕｌｌ　ｗｉｄｔｈ heading of the page\nzweite Zeile übrig\nthird line"), (1, "ascii text only, of twenty characters or more\nsecond"), (2, "ﬁne ligatures on the page\nÄ Ö Ü ß\nmore of the same"),
    (4, "naïve première ligne\nune autre ligne"), (5, "表の見出し……目次と本文がここに続きます。もう少し長く\n二行目"), (6, "alpha\nĳssel water and more\nсредняя строка\nlast ① line\nend of it"), (16, "début de la page\n12 ½ lines\nthe third ﬂoor\nfour\nfünf Wörter stehen hier"),
    (24, "été\nsecond\nthird\nfourth\nfifth\nσίγμα τέλος\nseventh"), (28, "Zeile mit ＡＢＣ\nb\nlong enough third line\nd\ne\nf\nßtraße hier"), (60, "Größe der Seite im Maß\nx"),
]
TURNS = [
    (1, 0, "user", "Delta is first"), (1, 2, "user", "what of ＤＥＬＴＡ here, and Straße?"), (2, 0, "user", "Strasse, of old"), (2, 2, "user", "die STRASSE, die Straße und ｄｅｌｔａ"), (3, 0, "user", "gamma rays"),
    (3, 2, "user", "é ｇａｍｍa"), (4, 0, "user", "del é"), (4, 1, "assistant", "deltà"), (5, 2, "user", "ｇａｍ é nothing"), (6, 2, "user", "xdeltaé delta"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def squash(text):
    return re.sub(r"\s+", "", re.sub(r"\.{2,}", "", re.sub(r"[|*_`#>~]", "", unicodedata.normalize("NFKC", text))))


def holds(page, needle):
    return needle in page if page is not None and len(needle) >= 3 and len(page) >= 20 else None


def test_text_layer_evidence(spark, folder):
    needle = lambda i, t: {0: "ab", 1: "nowhere-to-be-found"}.get(i % 4, t[:12])
    got = {r.doc_id: r.found for r in plans.QUERIES["text_layer_evidence_all"](spark, folder).collect()}
    assert got == {i: holds(squash(t), squash(needle(i, t))) for i, t in DOCS}


def test_recheck(spark, folder):
    want = []
    for i, text in DOCS:
        page = {0: text, 1: text.replace("\n", " y")}.get(i % 3)
        page = None if page is None else squash(page)
        for pos, line in enumerate(text.split("\n")):
            fixed = {0: line + " y", 1: "  ", 2: line + " x"}.get(i % 4)
            status = "match" if (i + pos) % 5 else "needs_review" if not (fixed or "").strip() or pos % 3 == 1 or pos % 2 else "auto_corrected"
            final, basis = fixed if status == "auto_corrected" else line, "none"
            if status == "auto_corrected":
                c, p = holds(page, squash(final)), holds(page, squash(line))
                basis = "layer-keep" if c and not p else "layer-cancel" if p and not c else "language-cancel" if pos % 4 == 0 else "keep"
            status = {"layer-cancel": "match", "language-cancel": "needs_review"}.get(basis, status)
            want.append((i, pos, basis, status, line if basis.endswith("cancel") else final))
    got = [tuple(r) for r in plans.QUERIES["recheck_all"](spark, folder).collect()]
    assert sorted(got) == sorted(want)
    assert len({x[2] for x in want}) > 2


def norm(text):
    return unicodedata.normalize("NFKC", text).casefold()


def test_tags(spark, folder):
    tags = {re.search("[A-Za-z]+", t).group().lower() for _, turn, _, t in TURNS if turn == 0}
    asked = {c * 1000 + turn: (norm(t), "session" if c % 2 == 0 else None) for c, turn, role, t in TURNS if role == "user"}
    mentions, prefixes, resolved = set(), set(), {}
    for k, (q, session) in asked.items():
        found = {(t, m.start(), m.start() + len(t)) for t in tags for m in re.finditer(f"(?<![a-z0-9])(?={re.escape(t)}(?![a-z0-9]))", q)}
        free = {t for t, s, e in found if not any(o != t and a <= s and e <= b and (a, b) != (s, e) for o, a, b in found)}
        mentions |= {(k, *x) for x in found if x[0] in free}
        begun = {t for w in re.findall("[A-Za-z0-9][A-Za-z0-9-]*", q) if len(w) >= 3 for t in tags if t.startswith(w)}
        prefixes |= {(k, t) for t in begun}
        named = free or begun
        resolved[k] = next(iter(named)) if len(named) == 1 else session
    run = lambda name: [tuple(r) for r in plans.QUERIES[name](spark, folder).collect()]
    assert sorted(run("tag_mentions_all")) == sorted(mentions)
    assert sorted(run("prefix_mentions_all")) == sorted(prefixes)
    assert dict(run("resolve_tag_all")) == resolved


def test_drafts_equal_their_sql(spark, tmp_path):
    """Before, blank and null texts that the SQL takes as they are became the sentence for pages without text."""
    import duckdb

    texts = {0: "zero", 1: "one\ntwo", 2: "", 3: " \n\t", 4: None, 5: "　", 7: "", 8: "eight", 50: None, 51: "", 52: "x", 101: None, 102: None, None: "no id"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {tuple(r) for r in con.execute(plans.ORACLES["assemble_draft"]).fetchall()}
    assert {tuple(r) for r in plans.QUERIES["assemble_draft"](spark, str(tmp_path)).collect()} == want
    assert (2, None) in want and len(want) == 4
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, " "), (1, 3, None)], "draft_id int, page int, text string")
    blanks = [f"## PDF {n}ページ目\n\n{reconcile.NO_TEXT if t is None else t}\n" for n, t in ((1, None), (2, "b"), (3, None))]
    assert reconcile.assemble_draft(pages).first().markdown == "\n".join(blanks)  # by itself the operator marks the blank ones


def test_files_are_written_and_read_once(spark, tmp_path):
    """Before, all files of an export went through one window, and each file was opened twice when read back."""
    texts = [(i, None if i == 9 else "" if i == 8 else " \n" if i == 12 else f"text {i}\nmore") for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["read_markdown"](spark, str(tmp_path))
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {
        (f"n {i}.{['md', 'MARKDOWN', 'txt', 'html'][i % 4]}", reason := "extension" if i % 4 == 3 else "encoding" if i % 11 == 4 else "blank" if i % 13 == 5 or i in (8, 9, 12) else None, None if reason else t)
        for i, t in texts if t or i % 3 == 0 or i % 11 == 4 or i % 13 == 5
    }
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    outputs = spark.createDataFrame([(1, "a"), (1, "../b"), (2, "c"), (2, "d"), (3, "e"), (None, "f"), (None, "d")], "export_id long, path string")
    planned = bundles.plan_exports(outputs, spark.createDataFrame([("d",)], "path string"))
    assert "Window" not in planned._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((str(r.export_id), r.path, r.bad, r.exists, r.decision) for r in planned.collect()) == [
        ("1", "../b", True, False, "reject"), ("1", "a", False, False, "reject"), ("2", "c", False, False, "ask"), ("2", "d", False, True, "ask"),
        ("3", "e", False, False, "write"), ("None", "d", False, True, "ask"), ("None", "f", False, False, "ask"),
    ]
