"""Chunks of documents against a plain chunker that goes through the lines one by one."""

import random
import re

from leafmill.operators import chunking

HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*$")


def windows(text, size, overlap):
    return [c for i in range(0, len(text.strip()), size - overlap) if (c := text.strip()[i : i + size].strip())]


def greedy(parts, size, start, joint):
    """Lists of texts, filled up to a size; parts are (text, cost)."""
    out, cur, used = [], [], start
    for text, cost in parts:
        more = cost + (joint if cur else 0)
        if cur and used + more > size:
            out.append(cur)
            cur, used, more = [], start, cost
        cur.append(text)
        used += more
    return out + ([cur] if cur else [])


def table(rows, size):
    header, groups, last = "\n".join(rows[:2]), [], None
    for row in rows[2:]:
        cell = re.sub(r"^\|+|\|+$", "", row.strip()).split("|")[0].strip()
        if groups and (cell in ("", "〃") or cell == last):
            groups[-1].append(row)
        else:
            groups.append([row])
        last = last if cell in ("", "〃") else cell
    parts = [("\n".join(g), sum(len(r) + 1 for r in g)) for g in groups]
    return [header + "\n" + "\n".join(c) for c in greedy(parts, size, len(header), 0)] or [header]


def prose(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, waiting = [], []

    def flush():
        out.extend("\n\n".join(c) for c in greedy([(p, len(p)) for p in waiting], size, 0, 2))
        waiting.clear()

    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if len(p) > size:
            flush()
            out.extend(windows(p, size, overlap))
        elif p:
            waiting.append(p)
    flush()
    return out


def chunks(text, size, overlap):
    sections, out = [("", [])], []
    for line in (text or "").strip().split("\n"):
        if m := HEADING.match(line):
            sections.append((m[2].strip(), []))
        else:
            sections[-1][1].append(line)
    for heading, lines in sections:
        body, runs = "\n".join(lines).strip(), []
        for line in body.split("\n") if body else []:
            is_table = line.strip().startswith("|")
            if not runs or runs[-1][0] != is_table:
                runs.append((is_table, []))
            runs[-1][1].append(line)
        for is_table, rows in runs:
            whole = "\n".join(rows).strip()
            if whole:
                made = table(rows, size) if is_table and len(rows) >= 2 else prose(whole, size, overlap)
                out += [f"【{heading}】\n{c}" if heading else c for c in made if c.strip()]
    return out


def test_random_documents(spark):
    rng = random.Random(21)

    def line():
        kind = rng.randrange(9)
        if kind == 0:
            return "#" * rng.randrange(1, 8) + rng.choice([" ", "", "\t"]) + rng.choice(["Title", "two words ", ""])
        if kind < 3:
            return ""
        if kind < 6:
            return rng.choice(["", " "]) + "| " + rng.choice(["a", "a", "b", "〃", ""]) + " | " + "x" * rng.randrange(12) + rng.choice([" |", ""])
        return "word " * rng.randrange(1, 30)

    texts = ["\n".join(line() for _ in range(rng.randrange(1, 25))) for _ in range(250)] + ["", " ", "x" * 500, "a\n\n" + "y" * 300 + "\n\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunking.chunk_documents(docs, 80, 10).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.content))
    want = {i: list(enumerate(c)) for i, t in enumerate(texts) if (c := chunks(t, 80, 10))}
    assert got == want
