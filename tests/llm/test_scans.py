"""Decontamination, winnowing and WARC against brute force, and the pipeline's stages."""

import hashlib
import re

import pytest
from documents import SCHEMA, awkward, empty, prose, rows
from pyspark.sql import functions as F

from leafmill.llm import decontamination, warc, winnowing
from leafmill.llm.common import new_path


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    ws, hit, found = split(text), set(), set()
    for item_id, t in items:
        iw = split(t)
        n = min(10, len(iw))
        if item_id is None or not n:
            continue
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(ws), len(hit), sorted(found)


ITEMS = [(1, prose(30, 900)), (2, "Tiny Item"), (2, prose(12, 901)), (3, None), (None, "Null id here"), (4, ".."), (5, prose(30, 900))]


def contaminated(spark):
    texts = [(50, f"{prose(20, 1)} {prose(30, 900)} {prose(20, 2)}"), (51, f"{prose(5, 3)} tiny, ITEM! {prose(5, 4)}"), (52, " ".join(prose(30, 900).split()[3:13])), (53, " ".join(prose(30, 900).split()[3:12])), (54, " ".join([prose(12, 901)] * 3))]
    return awkward(spark).unionByName(spark.createDataFrame(rows(texts), SCHEMA))


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_contamination(spark, bound):
    docs, bench = contaminated(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"]), sum(s.last - s.first + 1 for s in r.spans)) for r in decontamination.contamination(docs, bench, bound).collect())
    want = sorted((str(r.doc_id), n, h, tuple(f), h) for r in docs.collect() for n, h, f in [brute_hits(r.text, ITEMS)])
    assert got == want
    kept = decontamination.decontaminate(docs, bench, max_broadcast_bytes=bound)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(x[0] for x in want if not x[2])


@pytest.mark.parametrize("bound", [1 << 20, 0])
@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_columns_of_any_name_stay(spark, bound, remove):
    docs = contaminated(spark)
    for c in ("digest", "found_id", "__digest", "__spans", "spans", "row", "left", "a.b"):
        docs = docs.withColumn(c, F.lit(c))
    kept = decontamination.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), remove, bound)
    assert kept.columns == docs.columns
    assert {tuple(r)[-8:] for r in kept.collect()} == {("digest", "found_id", "__digest", "__spans", "spans", "row", "left", "a.b")}


def test_removed_spans(spark):
    docs, bench = contaminated(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontamination.decontaminate(docs, bench, "spans")
    assert left.count() == docs.count()
    assert {r.n_hit for r in decontamination.contamination(left, bench).collect()} == {0}
    assert decontamination.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(empty(spark), bench).collect() == []


def test_both_sizes_remove_the_same(spark):
    """Contaminated rows with a null or repeated id take no clean row along, and spans go beyond the bound too."""
    bad = f"{prose(8, 1)} {prose(30, 900)} {prose(8, 2)}"
    texts = [(None, bad), (None, prose(40, 77)), (70, bad), (70, prose(40, 78)), (70, bad), (71, f"{bad}! Ä {bad}?"), (72, None)]
    docs, bench = spark.createDataFrame(rows(texts), SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs.unionByName(contaminated(spark))
    got = {}
    for remove in ("documents", "spans"):
        for bound in (1 << 20, 0):
            left = decontamination.decontaminate(docs, bench, remove, bound)
            assert left.columns == docs.columns
            got[remove, bound] = sorted(map(repr, left.collect()))
        assert got[remove, 0] == got[remove, 1 << 20]
    kept = decontamination.decontaminate(docs, bench, max_broadcast_bytes=0).where("doc_id is null or doc_id = 70").collect()
    assert sorted(r.text for r in kept) == sorted([prose(40, 77), prose(40, 78), "Null id here."])
    assert len(got["spans", 0]) == docs.count()


def brute_points(text):
    """(position, hash) kept of a text, by each gram and window in turn."""
    solid, n, p = "".join((text or "").split()), winnowing.GRAM_POINTS, winnowing.PRIME
    value = lambda g, h: h if not g else value(g[1:], (h * winnowing.BASE + ord(g[0])) % p)
    if len(solid) < n:
        return [(0, value(solid, 1))] if solid else []
    hs = [value(solid[i : i + n], 0) for i in range(len(solid) - n + 1)]
    w, want = min(winnowing.WINDOW_POINTS, len(hs)), []
    for i in range(len(hs) - w + 1):
        at = max(j for j in range(i, i + w) if hs[j] == min(hs[i : i + w]))
        if not want or want[-1][0] != at:
            want.append((at, hs[at]))
    return want


def brute_likeness(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def unpacked(keys):
    return [((1 << 32) - 1 - (k & ((1 << 32) - 1)), k >> 32) for k in keys]


def test_points_against_brute_force(spark):
    texts = ["", " \n\u3000", "short one", "x" * 300, "été naïve 你好 𝔘𝔫𝔦 " * 9, prose(90, 6), "abcdefghijkl", "a" * 11 + "bcdefghijklmnop" + "q", prose(9000, 8)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("k", winnowing.winnow_points(winnowing.F.col("text"))).collect()
    for r in got:
        assert unpacked(r.k) == brute_points(r.text)


def test_all_columns_against_brute_force(spark):
    docs = awkward(spark)
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    texts = [r.text or "" for r in order]
    want = []
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        a, b, c = map(brute_points, (t, edit, after))
        want.append((str(order[i].doc_id), len(t), hashlib.sha256(edit.encode()).hexdigest(), tuple(a), tuple(b), round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, tuple(unpacked(r.kept)), tuple(unpacked(r.edited_kept)), round(r.near_edited, 9), round(r.near_next, 9)) for r in winnowing.fingerprint_edits(docs).collect()]
    assert sorted(got) == sorted(want)


def test_edited_texts_of_all_lengths(spark):
    """The fingerprint of an edited text, made from those of its two texts, is that of the edited text itself."""
    lengths = [0, 1, 5, 11, 12, 13, 26, 27, 28, 29, 40, 53, 54, 55, 56, 83, 84, 85, 86, 110, 166, 168, 170, 171, 250, 340, 600]
    texts, x = [], 7
    for i, n in enumerate(lengths * 3):
        chars = []
        while len(chars) < n * (1 + i % 2):
            x = (x * 1103515245 + 12345) % (1 << 31)
            chars.append("ab cdé \n你𝔘efg"[(x >> 9) % 13] if i % 3 else "ab "[(x >> 9) % 3])
        texts.append((hash((i, n)) % 100_003, "".join(chars)))
    docs = spark.createDataFrame(rows(list(dict(texts).items())), SCHEMA)
    order = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in winnowing.fingerprint_edits(docs).collect()}
    for i, (doc_id, t) in enumerate(order):
        half = len(t) // 2
        edit = t[: len(t) - half] + order[(i + 1) % len(order)][1][:half]
        assert got[doc_id].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert unpacked(got[doc_id].edited_kept) == brute_points(edit), (doc_id, len(t), half)


def test_a_character_inserted_in_text_without_spaces(spark):
    """One code point more before a shared passage changes little, and a shared passage of 27 is found at any offset."""
    chinese = "".join(chr(0x4E00 + (i * i * 37 + i * 11) % 5000) for i in range(400))
    coded = hashlib.sha512(b"x").hexdigest() * 3
    for text in (chinese, coded):
        docs = spark.createDataFrame(rows([(1, text), (2, "字" + text)]), SCHEMA)
        assert min(r.near_next for r in winnowing.fingerprint_edits(docs).collect()) > 0.9
    passage = chinese[50:77]
    pairs = [("a" * i + passage + "b", "ключ" * i + "c" + passage) for i in range(1, 6)]
    kept = spark.createDataFrame(pairs, "a string, b string").select(*[winnowing.hashes(winnowing.winnow_points(winnowing.F.col(c))).alias(c) for c in "ab"])
    assert all(set(r.a) & set(r.b) for r in kept.collect())


@pytest.mark.parametrize("ranges", [1, 3, 16, 150])
def test_edits_follow_the_order_of_ids(spark, ranges):
    docs = awkward(spark).select("doc_id", winnowing.F.coalesce("text", winnowing.F.lit("")).alias("text"))
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
    want = sorted((str(r.doc_id), r.text, order[(i + 1) % len(order)].text) for i, r in enumerate(order))
    got = winnowing.with_next(docs, ranges)
    assert sorted((str(r.doc_id), r.text, r.next) for r in got.collect()) == want


def test_edited_texts(spark):
    texts = [(1, "abcdefgh"), (2, "xy"), (3, "é𝔘ü")]
    got = {r.doc_id: r for r in winnowing.fingerprint_edits(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    want = {1: "abcdxy", 2: "xé", 3: "é𝔘a"}
    for i, t in want.items():
        assert got[i].edited_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert got[i].n_chars == len(dict(texts)[i])
    same = winnowing.fingerprint_edits(spark.createDataFrame(rows([(1, prose(200, 1)), (2, prose(200, 1))]), SCHEMA)).collect()
    assert all(r.near_next == 1.0 and r.near_edited < 1 for r in same) and same[0].kept == same[1].kept
    assert winnowing.fingerprint_edits(empty(spark)).collect() == []


def test_archives(spark):
    big, mid = "page " * 60_000, "m" * 1000
    pages = [(1, "http://a/b c", big), (2, None, big), (3, "http://ü/\r\nx", mid), (9, "u", mid), (4, "u", "s"), (5, "u", "s"), (6, "u", None), (None, "u", "no id"), (7, "u", "dé" * 900), (7, "u", "dé" * 900)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, size int").repartition(3)
    chunks = warc.read_chunks(warc.write_archives(warc.with_record_types(df), new_path(spark, "warc"), 1000), 4096)
    rows_ = chunks.where("is_last").collect()
    got = sorted((str(r.page_id), r.bytes_so_far, r.sha1_so_far, r.record_type, r.refers_to) for r in rows_)
    data = lambda h: (h or "").encode()
    want = []
    for page_id, _, html in pages:
        b = data(html)
        top = max((p for p, _, h in pages if data(h) == b and p is not None), default=None)
        revisit = len(b) >= 1000 and page_id != top
        want.append((str(page_id), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want)
    body = b"".join(bytes(r.chunk) for r in chunks.where("page_id = 2").orderBy("chunk_no").collect())
    assert body == big.encode()
    assert max(len(r.chunk) for r in chunks.where("chunk is not null").collect()) <= 4096
    assert warc.read_chunks(warc.write_archives(warc.with_record_types(df.limit(0)), new_path(spark, "warc"))).collect() == []
