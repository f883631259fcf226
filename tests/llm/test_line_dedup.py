"""Line dedup against all pairs of lines, awkward rows included."""

from documents import SCHEMA, awkward, empty, prose, rows

from leafmill.llm import line_dedup
from leafmill.llm.components import all_components


def brute(docs):
    """Dropped line numbers by (doc_id, text): components over all pairs of distinct lines, the first line kept."""
    lines = {}
    texts = sorted({(r.doc_id is not None, r.doc_id or 0, r.text) for r in docs if r.text is not None}, key=lambda x: x[:2])
    for has, doc_id, text in texts:
        for i, line in enumerate(text.split("\n")):
            if line and not line.isspace():
                lines.setdefault(line, []).append((has, doc_id, i, text))
    distinct = list(lines)
    sets = [line_dedup.shingles(x) for x in distinct]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            if line_dedup.jaccard(sets[a], sets[b]) >= line_dedup.SIMILARITY:
                root[find(a)] = find(b)
    first = {}
    for k, line in enumerate(distinct):
        first[find(k)] = min([*lines[line], *([first[find(k)]] if find(k) in first else [])], key=lambda x: x[:3])
    drops = {}
    for k, line in enumerate(distinct):
        for place in lines[line]:
            drops.setdefault((place[1] if place[0] else None, place[3]), [])
            if place != first[find(k)]:
                drops[place[1] if place[0] else None, place[3]].append(place[2])
    return {k: sorted(v) for k, v in drops.items()}


def corpus(spark):
    base = [prose(25, s) for s in range(12)]
    texts = []
    for i in range(40):
        a, b = base[i % 12], base[(i * 5) % 12]
        edit = a.split()
        edit[i % 25] = f"changed{i}"
        texts.append((100 + i, "\n".join([" ".join(edit), b, "", f"own line {prose(12, 500 + i)}"])))
    return awkward(spark).unionByName(spark.createDataFrame(rows(texts), SCHEMA))


def test_against_all_pairs(spark):
    docs = corpus(spark)
    got = {}
    by_key = {}
    for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as k").collect():
        by_key[r.doc_id, r.k] = r.text
    for r in line_dedup.dropped_lines(docs).collect():
        got[r.doc_id, by_key[r.doc_id, r.text_key]] = list(r.dropped)
    assert got == brute(docs.collect())


def edited(i):
    """A line of 80 words, each of a few variants of one template; far edits are alone, near ones chains."""
    words = prose(80, 77).split()
    for j in range(i % 14):
        words[(i * 7 + j * 11) % 80] = f"w{(i * 13 + j) % 97}"
    return " ".join(words)


def test_hot_bucket_of_many_components(spark):
    """All lines share one bucket, whose blocks are far smaller than it: the components are those of all pairs."""
    lines = list(dict.fromkeys(edited(i) for i in range(160)))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    texts = docs.select(line_dedup.node_of(docs.text).alias("node"), docs.text.alias("line"))
    nodes = {r.line: r.node for r in texts.collect()}
    least = min(nodes.values())
    star = spark.createDataFrame([(1, n, least) for n in nodes.values()], "key long, node long, center long")

    def verify(pairs):
        by = {n: x for x, n in nodes.items()}
        kept = [(r.a, r.b) for r in pairs.collect() if line_dedup.similar([by[r.a]], [by[r.b]])[0]]
        return spark.createDataFrame(kept, "a long, b long")

    got = {r.node: r.component for r in all_components(star, verify, lambda m, c: line_dedup._meet(m, c, texts, 0.8, 8), 4).collect()}
    sets = {nodes[x]: line_dedup.shingles(x) for x in lines}
    want = {n: n for n in sets}
    for a in sets:
        for b in sets:
            if a < b and line_dedup.jaccard(sets[a], sets[b]) >= 0.8 and want[a] != want[b]:
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = {n: new if c == old else c for n, c in want.items()}
    assert {n: got.get(n, n) for n in sets} == want
    assert 3 < len(set(want.values())) < len(lines) - 3


def test_similarity_by_hashes_is_exact():
    lines = [edited(i) for i in range(60)] + ["", "a", "abcdefg", "abcdefgh", "a" * 50, "ab" * 40]
    xs, ys = zip(*[(x, y) for x in lines for y in lines])
    want = [line_dedup.jaccard(line_dedup.shingles(x), line_dedup.shingles(y)) >= 0.8 for x, y in zip(xs, ys)]
    assert line_dedup.similar(list(xs), list(ys)).tolist() == want


def test_recall_of_bands():
    """Pairs of lines of the given documents at 0.8 or more share a band."""
    import duckdb

    rows_ = duckdb.sql("select distinct unnest(string_split(text, chr(10))) from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    lines = [x for (x,) in rows_ if x.strip()]
    lines += [x[: len(x) - len(x) // 9] for x in lines]  # cut copies: similarities of about 0.89
    sets = [line_dedup.shingles(x) for x in lines]
    held = {}
    for k, s in enumerate(sets):
        for g in s:
            held.setdefault(g, []).append(k)
    near = {(a, b) for ks in held.values() if len(ks) < 200 for a in ks for b in ks if a < b}
    near = [(a, b) for a, b in near if line_dedup.jaccard(sets[a], sets[b]) >= 0.8]
    keys = line_dedup.band_keys(line_dedup.signatures(lines))
    met = [bool((keys[a] == keys[b]).any()) for a, b in near]
    assert len(met) > 500 and sum(met) >= 0.998 * len(met)


def test_clashing_column_names(spark):
    docs = spark.createDataFrame([(1, "one line here\none line here", 1, 2, 3, 4)], "doc_id long, text string, found_dropped int, found_id int, dropped int, text_key int")
    kept = line_dedup.deduplicate_lines(docs)
    assert kept.columns == docs.columns
    assert kept.collect() == [(1, "one line here", 1, 2, 3, 4)]


def test_cleaned_documents(spark):
    docs = corpus(spark)
    kept = line_dedup.deduplicate_lines(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    want = brute(docs.collect())
    out = {(r.doc_id, r.text) for r in kept.collect()}
    for (doc_id, text), drops in want.items():
        lines = text.split("\n")
        solid = [i for i, x in enumerate(lines) if x and not x.isspace()]
        if len(drops) < len(solid):
            assert (doc_id, "\n".join(x for i, x in enumerate(lines) if i not in drops)) in out
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)
    assert (1, None) in out and (2, "") in out


def test_nothing(spark):
    assert line_dedup.dropped_lines(empty(spark)).collect() == []
    assert line_dedup.deduplicate_lines(empty(spark)).collect() == []


def test_signatures_follow_similarity():
    a, b = prose(200, 1), prose(200, 1) + " tail of a few words"
    j = line_dedup.jaccard(line_dedup.shingles(a), line_dedup.shingles(b))
    s = line_dedup.signatures([a, b, "x"], n=512)
    assert abs((s[0] == s[1]).mean() - j) < 0.06
    assert (line_dedup.signatures(["x", a], n=8)[1] == line_dedup.signatures([a], n=8)[0]).all()
