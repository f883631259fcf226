"""Steps whose cost must grow with the input alone, against plain Python."""

import hashlib
import random
import re
import time
import unicodedata
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from leafmill import tables
from leafmill.functions import kernels
from leafmill.operators import chunking, ingest, markdown, mentions, reconcile, validation
from leafmill.plans import fixtures
from leafmill.sources import files
from leafmill.tables import line_table


def base_name(raw):
    base = re.sub(rf"(?i)\.(?:{validation.EXTENSIONS})$", "", raw)
    base = re.sub(r"\.+$", "", re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", base).strip())
    while len(base.encode()) > validation.NAME_BYTES:
        base = base[:-1]
    base = re.sub(r"\.+$", "", base.strip())
    return "document" if not base or base.split(".")[0].upper() in validation.RESERVED else base


def test_base_names_are_cut_by_bytes_in_one_pass(spark):
    """Before, every length of a name was tried with all the patterns again."""
    rng = random.Random(3)
    names = ["".join(rng.choices("aé漢😀. ", k=rng.randint(1, 260))) for _ in range(300)] + ["é" * 20_000 + ".md"] * 8 + [None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, raw string").repartition(1)
    began = time.time()
    found = {r.id: r.base for r in validation.safe_base_names(rows).collect()}
    assert time.time() - began < 20
    assert found == {i: None if n is None else base_name(n) for i, n in enumerate(names)}


def test_fences_are_found_once_for_a_text(spark):
    """Before, the fences of a text were found again for each of its lines."""
    n = 6000
    text = "\n".join(["~~~", "# inside", "~~~"] + ["", "line ![p](a.png)"] * n + ["# Title #", "<b>x</b>"])
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string").repartition(4)
    began = time.time()
    assert {r.title for r in markdown.document_titles(docs).collect()} == {"Title"}
    assert {r.text for r in markdown.blank_runs(docs).collect()} == {text}
    assert {(r.code, len(r.lines)) for r in markdown.lint_markdown(docs).collect()} == {("unsupported-image", n), ("raw-html", 1)}
    assert {r.ref for r in markdown.collect_references(docs).collect()} == {"a.png"}
    assert time.time() - began < 30


def test_circled_numbers_in_one_pass(spark):
    texts = [r"$\textcircled{1}$\textcircled{02}$ \textcircled{20}$$\textcircled{7} \textcircled{21} \textcircled{0}", "none", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    found = [r.t for r in rows.select("id", reconcile.clean_markup(rows.text).alias("t")).orderBy("id").collect()]
    assert found == [r"①② ⑳⑦ \textcircled{21} \textcircled{0}", "none", None]


def test_a_table_that_fits_is_one_chunk(spark):
    rows = ["| a | b |", "| --- | --- |", *[f"| {k % 3} | {k} |" for k in range(40)]]
    for size in (len("\n".join(rows)), len("\n".join(rows)) - 1):
        table = spark.createDataFrame([(rows,)], "rows array<string>")
        chunks = table.select(chunking.pack_table(table.rows, size).alias("c")).first().c
        assert chunks == ["\n".join(rows)] if size >= len("\n".join(rows)) else len(chunks) == 2


def test_words_are_rewritten_together_as_each_by_itself(spark):
    """Pieces and words are computed once for a text; before, word by word, and all batches became Python's texts."""
    words = ["#", "|", "**a**", "a|b", "|x", "--", "> q", "ｆｕｌｌ", "\u00a8", "e\u0301", "-_-a-_", "c||", "ß", "漢", "~"]
    rng = random.Random(5)
    texts = ["\n".join(rng.choices([w.replace(" ", "") for w in words], k=rng.randint(1, 12))) for _ in range(100)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    listed = kernels.nfkc(kernels.listed_words(rows.t))
    each = F.transform(F.split(listed, "\n", -1), kernels.comparable)
    assert rows.select(kernels.compared_words(listed).alias("a"), each.alias("b")).where("a <> b").count() == 0


def test_inert_characters_are_their_own_nfkc():
    listed = re.findall(r"(.)-(.)|(.)", kernels.INERT, re.S)
    chars = [chr(k) for a, b, c in listed for k in (range(ord(a), ord(b) + 1) if a else [ord(c)])]
    assert "ß" in chars and not any(unicodedata.combining(c) for c in chars)
    assert all(unicodedata.normalize("NFKC", c) == c for c in chars) and unicodedata.normalize("NFKC", "".join(chars)) == "".join(chars)


def test_fence_state_moves_no_lines_again(spark):
    """Lines that are partitioned by document meet the openings without a shuffle; before, a join dealt all of them anew."""
    texts = ["a\n```\nb\n~~~\nc\n```\nd\n~~~\ne", "~~~", "plain\ntext"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")
    found = markdown.fence_state(line_table(docs))
    assert [(r.n, r.is_fence, r.in_fence, r.opens) for r in found.where("doc_id = 0").orderBy("n").collect()] == [
        (1, False, False, False), (2, True, True, True), (3, False, True, False), (4, True, True, False), (5, False, True, False),
        (6, True, True, False), (7, False, False, False), (8, True, True, True), (9, False, True, False),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_hashed_vectors_are_counts_of_words():
    texts = ["a b a", "", None, "x " * 50 + "y"]
    for v, t in zip(ingest.feature_hash(texts, 16), texts):
        plain = np.zeros(16)
        for w in (t or "").split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            plain[h % 16] += 1 - 2 * (h >> 63)
        assert (v == plain / (np.linalg.norm(plain) or 1)).all()


def test_small_files_are_read_in_few_tasks(spark, tmp_path):
    """Before, a task for every few files in each scan of them."""
    for i in range(300):
        (tmp_path / f"{i}.md").write_text(f"text {i}")
    good, bad = files.read_markdown(spark, str(tmp_path))
    assert good.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {r.text for r in good.collect()} == {f"text {i}" for i in range(300)} and bad.count() == 0


def test_corrections_are_squashed_once(spark):
    """Before, both readings of every line passed the patterns, again for each place that named them, and whole matches went to the kernel."""
    rng = random.Random(11)
    words = ["#", "|", "a|b", "..", ". .", "..|..", "> q", "ｆｕｌｌ", "é", "ß", "漢", "　", " ", "x-y", " ", "\n"]
    texts = ["".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(300)] + [None, "", " 　", "long " * 900, "long " * 900 + "y"]
    rows = spark.createDataFrame([(i, t, rng.choice(texts), rng.choice(texts)) for i, t in enumerate(texts)], "i long, a string, b string, c string")
    old = F.regexp_replace(F.regexp_replace(kernels.norm_diff(rows.a), r"\.{2,}", ""), r"(?U)\s+", "")
    assert rows.where(~kernels.squash_diff(rows.a).eqNullSafe(old)).count() == 0
    assert rows.where(tables.blank(rows.a) != F.coalesce(tables.strip(rows.a) == "", F.lit(True))).count() == 0
    told = rows.select("i", *[kernels.squash_diff(rows[x]).alias(x) for x in "abc"], kernels.nearest(rows.a, [rows.b, rows.c], 0.6).alias("near")).collect()
    for r in told:
        ratios = [SequenceMatcher(None, r.a, y, autojunk=False).ratio() for y in (r.b, r.c) if r.a is not None and y is not None]
        assert (r.near is None) == (not ratios) and (not ratios or (r.near >= 0.6) == (max(ratios) >= 0.6)) and (not r.near or r.near in ratios)
    segments = rows.selectExpr("i as doc_id", "'s' as segment_id", "b as primary_text", "c as alternate_text", "i % 2 = 0 as is_match")
    corrections = rows.selectExpr("i as doc_id", "'s' as segment_id", "a as corrected_text", "i % 3 = 0 as still_uncertain", "'r' as reason")
    judged = reconcile.apply_corrections(segments, corrections)
    assert judged.columns[-2:] == ["status", "final_text"] and "_near" not in judged.columns
    near, a = {r.i: r.near for r in told}, dict(enumerate(texts))
    for r in judged.collect():
        sure = (a[r.doc_id] or "").strip() and r.doc_id % 3
        assert r.status == ("match" if r.doc_id % 2 == 0 else "auto_corrected" if sure and (near[r.doc_id] or 0) >= 0.6 else "needs_review")
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 20


def test_pairs_of_prefixes_are_not_gathered(spark):
    """Before, the pairs of all questions and tags, which grow faster than either, went through an aggregate that held them in memory."""
    rng = random.Random(13)
    parts = ["con", "cone", "cont", "contra", "the", "them", "theme-a", "Ä", "co", "x1", "x1-", "-", " ", "straße"]
    named = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(60)] + ["CONTRA", "contra", "", None, "the me"]
    asked = [(rng.choice([1, 2, 3, 4, None]) if k < 12 else k, " ".join(rng.choices(parts + named[:20], k=rng.randint(0, 6)))) for k in range(60)] + [(99, None)]
    tags = spark.createDataFrame([(t,) for t in named], "tag string")
    questions = spark.createDataFrame(asked, "question_id long, text string").repartition(5)
    fold = lambda t: unicodedata.normalize("NFKC", t).casefold()
    tokens = {(i, w) for i, t in asked if t for w in re.findall("[A-Za-z0-9][A-Za-z0-9-]*", fold(t)) if len(w) >= 3}
    want = sorted({(str(i), t) for i, w in tokens for t in named if t and fold(t).startswith(w)})
    for most in (mentions.MAX_STARTS, 0):
        found = mentions.prefix_mentions(questions, tags, most)
        assert sorted((str(r.question_id), r.tag) for r in found.collect()) == want and len(want) > 100
        above = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
        assert "Aggregate" not in above


def test_sections_and_their_input_sort_no_growing_parts(spark, tmp_path):
    """Before, windows sorted all lines of a task, and a task had its share of the order lines however many they were."""
    rng = random.Random(17)
    kinds = ["# One", "## Two ## ", "#", "#x", "####### seven", "", " ", "text", "| a |", "#\tTab　", "~~~", "### "]
    texts = [(i % 30, "\n".join(rng.choices(kinds, k=rng.randint(0, 9)))) for i in range(80)] + [(7, None), (None, "# A\nb"), (8, ""), (9, "a\n")]
    want = []
    for i, t in texts:
        section, heading = 0, ""
        for n, line in enumerate([] if t is None else t.split("\n"), 1):
            if m := re.match(chunking.HEADING, line):
                section, heading = section + 1, m[2].strip()
            else:
                want.append((i, n, line, section, heading))
    found = chunking.section_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert found.dtypes == [("doc_id", "bigint"), ("n", "int"), ("line", "string"), ("section", "bigint"), ("heading", "string")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.range(1000).selectExpr("id % 100 as k", "id")
    assert tables.dealt(rows, "k", 100).rdd.getNumPartitions() == 10 and tables.dealt(rows, "k", 100).count() == 1000
    assert tables.dealt(rows, "k", 250).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    lines = [(1, 7, 1, 2, 3.0, 1.5), (1, 2, 2, 2, 4.0, 2.5), (1, 6, 3, 2, 5.0, 0.125), (2, 5, 1, 1, 1.0, 9.99), (3, 1, 1, 1, 1.0, 1.0), (2, None, 2, 1, 1.0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "O"), (2, "F"), (4, "P")], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    head = "# Order {0}\n\nStatus {1}.\n\n## Lines\n\n| part | qty | cents |\n{2}\n{3}"
    assert {r.doc_id: r.text for r in fixtures.markdown(spark, str(tmp_path)).collect()} == {
        1: head.format(1, "O", "| --- | --- |", "| 1 | 5 | 13 |\n| 2 | 3 | 150 |\n| 〃 | 4 | 250 |"), 2: head.format(2, "F", "| --- | --- | --- |", "| 0 | 1 | 999 |"),
    }
