"""Checks and repairs of Markdown: fences, tables, references, blank lines, page breaks, escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import kernels
from leafmill.tables import blank, line_table, strip

#: Patterns of a fence's mark, raw HTML, a page break's line, an image link and a link definition; the codes of warnings.
FENCE = r"^\s{0,3}(```|~~~)"
RAW_HTML = r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--"
PAGE_BREAK = r"(?i)^\s*<div\s+style\s*=\s*(?:\"\s*(?:page-break-after|break-after)\s*:\s*(?:always|page)\s*;?\s*\"|'\s*(?:page-break-after|break-after)\s*:\s*(?:always|page)\s*;?\s*')\s*>\s*</div\s*>\s*$"
CODES = ("front-matter", "broken-table", "unsupported-image", "raw-html")
IMAGE_LINK = r"!\[[^\]]*\]\(\s*(?:<([^>]*)>|([^)\s]*))"
DEFINITION = r"(?U)^\s{0,3}\[[^\]]+\]:\s*(?:<([^>]*)>|(\S+))"


def lines_of(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def fence_spans(lines: Column) -> Column:
    """The spans of fences in an array of lines, numbered from 0: struct(a, b) of the mark that opens one and the one that closes it.

    Only the mark that opened a fence closes it; an open one goes on to the end.
    """
    marks = F.filter(F.transform(lines, lambda l, i: F.struct(i.alias("n"), F.regexp_extract(l, FENCE, 1).alias("mark"))), lambda m: m["mark"] != "")
    kind = "struct<open:string,at:int,spans:array<struct<a:int,b:int>>>"
    state = lambda open_, at, spans: F.struct(open_.alias("open"), at.alias("at"), spans.alias("spans")).cast(kind)
    none = F.lit(None).cast("string")
    span = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))
    start = state(none, F.lit(0), F.array().cast("array<struct<a:int,b:int>>"))

    def step(s, m):
        return F.when(s["open"].isNull(), state(m["mark"], m["n"], s["spans"])).when(s["open"] == m["mark"], state(none, F.lit(0), F.concat(s["spans"], span(s["at"], m["n"])))).otherwise(s)

    return F.aggregate(marks, start, step, lambda s: F.when(s["open"].isNotNull(), F.concat(s["spans"], span(s["at"], F.size(lines)))).otherwise(s["spans"]))


def fenced(spans: Column, i: Column) -> Column:
    """Whether line i is a fence's mark or inside one."""
    return F.exists(spans, lambda s: (s["a"] <= i) & (i <= s["b"]))


def with_lines(body, text: str = "text") -> Column:
    """``body(lines, spans of fences among them)`` of a text, both computed once: each row by itself, whatever ids repeat or lack.

    As columns of their own, Spark would put them into each lambda of ``body`` again, once for every line.
    """
    marked = F.contains(F.col(text), F.lit("```")) | F.contains(F.col(text), F.lit("~~~"))
    spans = lambda lines: F.when(marked, fence_spans(lines)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    return kernels.let(lines_of(text), lambda lines: kernels.let(spans(lines), lambda spans: body(lines, spans)))


def outside_fences(lines: Column, spans: Column, like: str, body) -> Column:
    """``body(line, number from 0)`` of each line outside fences that is ``like`` a pattern, in order."""
    numbered = F.transform(lines, lambda l, i: F.struct(l.alias("line"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda x: x["line"].rlike(like) & ~fenced(spans, x["i"])), lambda x: body(x["line"], x["i"]))


def code_segments(line: Column) -> Column:
    """The line as an array of struct(code, text): code spans with their backticks, and the text between them."""
    kind = "array<struct<code:boolean,text:string>>"
    lexemes = F.regexp_extract_all(line, F.lit(_LEXEMES), 0)

    def step(found, x):
        code = x.rlike(r"(?s)^`.*[^`]")
        last = F.element_at(found, -1)
        joins = (F.size(found) > 0) & ~code & ~F.coalesce(last["code"], F.lit(True))
        one = lambda text: F.array(F.struct(code.alias("code"), text.alias("text")))
        return F.when(joins, F.concat(F.slice(found, F.lit(1), F.size(found) - 1), one(F.concat(last["text"], x)))).otherwise(F.concat(found, one(x))).cast(kind)

    return F.aggregate(lexemes, F.array().cast(kind), step)


def map_outside_code(line: Column, rewrite) -> Column:
    """The line with ``rewrite`` applied to each stretch between code spans."""
    parts = F.transform(code_segments(line), lambda s: F.when(s["code"], s["text"]).otherwise(rewrite(s["text"])))
    return F.when(F.contains(line, F.lit("`")), F.array_join(parts, "")).otherwise(rewrite(line))


def prose_of(line: Column) -> Column:
    """What a line has outside code spans, joined by spaces."""
    texts = F.transform(F.filter(code_segments(line), lambda s: ~s["code"]), lambda s: s["text"])
    return F.when(F.contains(line, F.lit("`")), F.array_join(texts, " ")).otherwise(line)


def fence_state(lines: DataFrame) -> DataFrame:
    """Lines with is_fence (a fence mark's own line) and in_fence (such a line, or inside), and of a fence opens and fence_end.

    A fence closes only by the mark that opened it. ``opens`` marks the line that opens one, ``fence_end``
    is the line that closes the last one opened. The fold is over a document's fence lines alone.
    """
    mark = F.regexp_extract("line", FENCE, 1)
    fences = lines.withColumn("mark", mark).where("mark <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "mark"))).alias("marks"))
    kind = "struct<open:string,from:int,spans:array<struct<a:int,b:int>>>"
    start = F.struct(F.lit(None).cast("string").alias("open"), F.lit(0).alias("from"), F.array().cast("array<struct<a:int,b:int>>").alias("spans")).cast(kind)

    def step(s, m):
        opens, closes = s["open"].isNull(), s["open"] == m["mark"]
        closed = F.concat(s["spans"], F.array(F.struct(s["from"].alias("a"), m["n"].alias("b"))))
        return F.when(opens, F.struct(m["mark"].alias("open"), m["n"].alias("from"), s["spans"].alias("spans")).cast(kind)).when(
            closes, F.struct(F.lit(None).cast("string").alias("open"), F.lit(0).alias("from"), closed.alias("spans")).cast(kind)
        ).otherwise(s)

    end = F.lit(2147483647)
    spans = fences.select("doc_id", F.aggregate("marks", start, step, lambda s: F.when(s["open"].isNotNull(), F.concat(s["spans"], F.array(F.struct(s["from"].alias("a"), end.alias("b"))))).otherwise(s["spans"])).alias("spans"))
    # Back onto lines: the last opening at or before a line tells its span. Openings stand among the lines, so that lines meet them without a join.
    opened = spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.a").alias("n"), F.col("s.b").alias("b"))
    both = lines.withColumn("b", F.lit(None).cast("int")).unionByName(opened, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("n", F.col("b").isNull())
    last = lambda c: F.last(F.when(F.col("b").isNotNull(), F.col(c)), ignorenulls=True).over(w)
    joined = both.withColumns({"fence_end": last("b"), "opened_at": last("n")}).where("b is null")
    inside = F.coalesce(F.col("n") <= F.col("fence_end"), F.lit(False))
    return joined.withColumns({"is_fence": mark != "", "in_fence": (mark != "") | inside, "opens": F.coalesce(F.col("n") == F.col("opened_at"), F.lit(False))}).drop("b", "opened_at")


def split_cells(line: Column) -> Column:
    """The cells of a table row; an escaped pipe does not split."""
    body = F.regexp_replace(strip(line), r"^\|", "")
    body = F.regexp_replace(body, r"(?<!\\)\|$", "")
    return F.transform(F.split(body, r"(?<!\\)\|", -1), strip)


def _starts_table(line: Column) -> Column:
    return line.rlike(r"\A(?U)\s*\|")


def is_delimiter(line: Column) -> Column:
    # Cells are looked at only where a line has no other characters than theirs.
    return line.rlike(r"\A(?U)\s*\|[\s|:-]*\z") & F.forall(split_cells(line), lambda c: c.rlike("^:?-+:?$"))


def _is_table(first: Column, second: Column) -> Column:
    """Whether the second line is a delimiter row of as many cells as the first has."""
    return F.coalesce(is_delimiter(second) & (F.size(split_cells(first)) == F.size(split_cells(second))), F.lit(False))


def _has_odd_run(text: Column) -> Column:
    """Whether a text has a run of lines that start with a pipe but are no table, inside fences or not."""
    runs = F.regexp_extract_all(text, F.lit(r"(?m)(?:^[^\S\n]*\|[^\n]*(?:\n|\z))+"), 0)
    return F.coalesce(F.exists(F.transform(runs, lambda r: F.split(r, "\n", -1)), lambda ls: ~_is_table(ls[0], F.get(ls, F.lit(1)))), F.lit(False))


def _broken(lines: Column, spans: Column) -> Column:
    """struct(n, line) of each run of table lines outside fences that is no table, n from 1."""
    rows = F.transform(lines, lambda l, i: _starts_table(l) & ~fenced(spans, i))

    def check(rows):
        at = lambda i: F.coalesce(F.get(rows, i), F.lit(False))
        first = F.filter(F.transform(lines, lambda l, i: F.struct((i + 1).alias("n"), l.alias("line"), F.when(at(i + 1), F.get(lines, i + 1)).alias("second"), (at(i) & ~at(i - 1)).alias("opens"))), lambda x: x["opens"])
        looks = lambda x: x["second"].isNotNull() | (F.size(split_cells(x["line"])) >= 2)
        return F.transform(F.filter(first, lambda x: looks(x) & ~_is_table(x["line"], x["second"])), lambda x: F.struct(x["n"].alias("n"), x["line"].alias("line")))

    return kernels.let(rows, check)


def broken_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, line, excerpt) of runs of table lines that are no table: the second must be a delimiter row of as many cells.

    Each row is checked by itself. Only texts with such a run are looked at line by line.
    """
    rows = docs.where(_has_odd_run(F.col("text"))).select("doc_id", F.explode(with_lines(_broken)).alias("x"))
    trimmed = strip(F.col("x.line"))
    return rows.select("doc_id", F.col("x.n").alias("line"), F.when(F.length(trimmed) > 40, F.concat(F.left(trimmed, F.lit(40)), F.lit("…"))).otherwise(trimmed).alias("excerpt"))


def front_matter_lines(lines: Column) -> Column:
    """The number of lines of a front matter that opens the text and is closed, else 0."""
    trimmed = lambda l: F.regexp_replace(l, r"(?U)\s+$", "")
    ends = F.filter(F.transform(lines, lambda l, i: F.when(trimmed(l).isin("---", "...") & (i > 0), i + 1)), lambda n: n.isNotNull())
    return F.when(trimmed(lines[0]) == "---", F.coalesce(F.get(ends, F.lit(0)), F.lit(0))).otherwise(0)


#: What a line with escaped backticks consists of: an escaped character, a code span, other backticks, the rest.
_LEXEMES = r"(?s)\\.|(`++).*?(?<!`)\1(?!`)|`++|[^\\`]++|\\"


def mask_inline_code(line: Column) -> Column:
    """The line with each code span as one space; an escaped backtick opens none."""
    spans = F.regexp_replace(line, r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", " ")
    lexed = F.transform(F.regexp_extract_all(line, F.lit(_LEXEMES), 0), lambda x: F.when(x.rlike(r"(?s)^`.*[^`]"), F.lit(" ")).otherwise(x))
    return F.when(F.contains(line, F.lit("\\`")), F.array_join(lexed, "")).otherwise(spans)


_IMAGE_TAG = r"(?i)<img\b[^<>]*>"
_ATTRIBUTE = r"[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?"


def _source(tag: Column) -> Column:
    """The trimmed src of an image tag; empty without one."""
    attributes = F.regexp_extract_all(F.regexp_replace(tag, r"(?i)^<img|/?>$", ""), F.lit(_ATTRIBUTE), 0)
    own = F.get(F.filter(attributes, lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == "src"), F.lit(0))
    value = F.regexp_replace(own, r"^[^\s=]+(?:\s*=\s*)?", "")
    return F.coalesce(strip(F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2")), F.lit(""))


def image_references(prose: Column) -> Column:
    """References of image links and of image tags in what a line has outside code."""
    links = F.transform(F.regexp_extract_all(prose, F.lit(IMAGE_LINK), 0), lambda m: F.regexp_replace(F.regexp_replace(m, r"^!\[[^\]]*\]\(\s*", ""), r"^<([^>]*)>$", "$1"))
    tags = F.transform(F.regexp_extract_all(prose, F.lit(_IMAGE_TAG), 0), _source)
    return F.filter(F.concat(links, tags), lambda r: r != "")


def collect_references(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, ref) of images outside inline code and of link definitions, outside fences."""
    defined = lambda line: F.filter(F.array(F.concat(F.regexp_extract(line, DEFINITION, 1), F.regexp_extract(line, DEFINITION, 2))), lambda r: r != "")
    telling = r"(?i)!\[|<img|\]:"  # other texts, and other lines, hold neither
    refs = with_lines(lambda lines, spans: F.flatten(outside_fences(lines, spans, telling, lambda l, i: F.concat(image_references(prose_of(l)), defined(l)))))
    return docs.where(F.col("text").rlike(telling)).select("doc_id", F.explode(refs).alias("ref")).distinct()


def group_warnings(found: DataFrame) -> DataFrame:
    """(doc_id, code, lines) of rows (doc_id, code, line): sorted distinct lines."""
    return found.groupBy("doc_id", "code").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def lint_markdown(docs: DataFrame, displayable: DataFrame | None = None) -> DataFrame:
    """Warnings (doc_id, code, lines) of four codes. displayable: (doc_id, ref) of images that can be shown.

    Each row is checked by itself, in one pass over the lines of those texts that hold what a code looks for;
    only ``displayable`` asks for a join.
    """
    some = docs.where(F.col("text").rlike(r"<[A-Za-z/!]|!\[|\A---") | _has_odd_run(F.col("text")))
    if displayable is not None:
        shown = displayable.groupBy(F.col("doc_id").alias("shown_id")).agg(F.collect_set("ref").alias("shown"))
        some = some.join(shown, F.col("doc_id").eqNullSafe(F.col("shown_id")), "left")
    unshown = lambda r: ~r.rlike(r"(?i)^\s*data:image/") & (F.lit(True) if displayable is None else ~F.coalesce(F.array_contains("shown", r), F.lit(False)))

    def judge(prose, i):
        bare = F.regexp_replace(prose, r"(?i)<img\b(?=[^<>]*?\ssrc\s*=\s*[^\s>])[^<>]*>", " ")
        return F.struct((i + 1).alias("n"), F.exists(image_references(prose), unshown).alias("image"), bare.rlike(RAW_HTML).alias("html"))

    def listed(lines, spans):
        front = F.when(lines[0].startswith("---"), front_matter_lines(lines)).otherwise(0)
        marked = lambda front: F.filter(outside_fences(lines, spans, r"<|!\[", lambda l, i: F.when((i >= front) & ~l.rlike(PAGE_BREAK), kernels.let(prose_of(l), lambda prose: judge(prose, i)))), lambda x: x.isNotNull())
        found = lambda checked, flag: F.transform(F.filter(checked, lambda x: x[flag]), lambda x: x["n"])
        none = F.array().cast("array<int>")

        def by_code(front, checked):
            lines_of_code = [F.when(front > 0, F.array(F.lit(1))).otherwise(none), _broken(lines, spans)["n"], found(checked, "image"), found(checked, "html")]
            return F.array(*[F.struct(F.lit(c).alias("code"), l.cast("array<int>").alias("lines")) for c, l in zip(CODES, lines_of_code)])

        return kernels.let(front, lambda front: kernels.let(marked(front), lambda checked: by_code(front, checked)))

    return some.select("doc_id", F.explode(with_lines(listed)).alias("w")).select("doc_id", "w.code", "w.lines").where(F.size("lines") > 0)


def _joined(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def repair_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with headers and delimiter rows of tables in agreement, and notes between them moved below.

    A header longer than its delimiter row loses cells without content, or the delimiter row grows; valid
    tables stay as they are. Each row is repaired by itself, without a shuffle; texts without a longer header
    or a line that may be such a note pass as they are. A null text has no row.
    """
    pairs = F.regexp_extract_all("text", F.lit(r"(?m)^[^\S\n]*\|[^\n]*\n[^\S\n]*\|(?:[^\S\n]|[|:\\-])*$"), 0)
    longer = F.exists(F.transform(pairs, lambda p: F.split(p, "\n", -1)), lambda ls: F.size(split_cells(ls[0])) > F.size(split_cells(ls[1])))
    odd = longer | F.col("text").rlike(r"(?m)^[^\S\n]*[^|\s][^\n]*\|[^\S\n]*$")
    return docs.where("text is not null").select("doc_id", F.when(odd, _repaired(lines_of())).otherwise(F.col("text")).alias("text"))


def _rebuilt(lines: Column, edits: Column, block) -> Column:
    """The text whose lines from ``edit.h`` up to before ``edit.stop`` (from 0) become ``block(edit)``; edits stand in order and apart."""

    def piece(e, k):
        done = F.coalesce(F.get(edits, k - 1)["stop"], F.lit(0))
        return F.concat(F.slice(lines, done + 1, e["h"] - done), block(e))

    done = F.coalesce(F.element_at(edits, -1)["stop"], F.lit(0))
    whole = F.concat(F.flatten(F.transform(edits, piece)), F.slice(lines, done + 1, F.size(lines) - done))
    return F.when(F.size(edits) == 0, F.array_join(lines, "\n")).otherwise(F.array_join(whole, "\n"))


def _repaired(lines: Column) -> Column:
    def kinds(lines, spans):
        def kind(l, i):
            row = _starts_table(l)
            wedged = ~row & F.endswith(strip(l), F.lit("|")) & ~l.rlike(FENCE)
            return F.struct(row.alias("row"), is_delimiter(l).alias("delim"), wedged.alias("wedged"), fenced(spans, i).alias("fenced"))

        return F.transform(lines, kind)

    def edit(lines, h, d, stop):
        head, delim = F.get(lines, h), F.get(lines, d)

        def agreed(hc, dc):
            width = F.size(dc)
            junk = F.size(hc) - F.coalesce(F.array_max(F.transform(hc, lambda c, i: F.when(~c.rlike("^:?-*:?$"), i + 1).otherwise(0))), F.lit(0))
            keep = F.greatest(width, F.size(hc) - junk)
            as_is = F.size(hc) <= width
            new_h = F.when(as_is, head).otherwise(_joined(F.slice(hc, F.lit(1), keep)))
            new_d = F.when(as_is | (keep == width), delim).otherwise(_joined(F.concat(dc, F.array_repeat(F.lit("---"), keep - width))))
            return F.array(new_h, new_d)

        note = lambda l: F.regexp_replace(F.regexp_replace(strip(l), r"\|+$", ""), r"(?U)\s+$", "")
        notes = F.transform(F.slice(lines, h + 2, d - h - 1), note)
        first_two = kernels.let(split_cells(head), lambda hc: kernels.let(split_cells(delim), lambda dc: agreed(hc, dc)))
        return F.struct(h.alias("h"), stop.alias("stop"), first_two.alias("two"), F.slice(lines, d + 2, stop - d - 1).alias("body"), notes.alias("notes"))

    def edits(lines, kinds):
        of = lambda i, flag: F.coalesce(F.get(kinds, i)[flag], F.lit(False))
        places = lambda keep: F.filter(F.transform(kinds, lambda k, i: F.when(keep(k), i)), lambda i: i.isNotNull())

        def found(plain, other):
            heads = F.filter(F.transform(kinds, lambda k, i: F.when(k["row"] & ~k["fenced"] & ~k["delim"] & ~of(i - 1, "row"), i)), lambda i: i.isNotNull())
            after = lambda places, i: F.get(F.filter(places, lambda p: p > i), F.lit(0))
            paired = F.filter(F.transform(heads, lambda h: F.struct(h.alias("h"), after(plain, h).alias("d"))), lambda x: of(x["d"], "delim"))
            return F.transform(paired, lambda x: edit(lines, x["h"], x["d"], F.coalesce(after(other, x["d"]), F.size(lines))))

        return kernels.let(places(lambda k: ~k["wedged"]), lambda plain: kernels.let(places(lambda k: ~k["row"]), lambda other: found(plain, other)))

    def block(lines):
        gap = F.array(F.lit(""))
        none = F.array().cast("array<string>")
        below = lambda e: F.when(F.coalesce(~blank(F.get(lines, e["stop"])) & (e["stop"] < F.size(lines)), F.lit(False)), gap).otherwise(none)
        return lambda e: F.concat(e["two"], e["body"], F.when(F.size(e["notes"]) > 0, F.concat(gap, e["notes"], below(e))).otherwise(none))

    return kernels.let(lines, lambda ls: kernels.let(fence_spans(ls), lambda spans: kernels.let(kinds(ls, spans), lambda ks: kernels.let(edits(ls, ks), lambda es: _rebuilt(ls, es, block(ls))))))


def blank_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with blank paragraphs written out: inside a text floor((n - 1) / 2) for a run of n blank lines, at its start floor(n / 2), at its end none."""

    def runs(blanks):
        at = lambda i: F.coalesce(F.get(blanks, i), F.lit(False))
        edge = lambda step: F.filter(F.transform(blanks, lambda b, i: F.when(b & ~at(i + step), i)), lambda i: i.isNotNull())
        return F.transform(F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last")), lambda r: F.struct(r["first"].alias("h"), (r["last"] + 1).alias("stop")))

    def block(lines):
        def written(r):
            n, head, tail = r["stop"] - r["h"], r["h"] == 0, r["stop"] == F.size(lines)
            count = F.when(head, F.floor(n / 2)).otherwise(F.greatest(F.lit(0), F.floor((n - 1) / 2)))
            at = lambda i: i - F.when(head, 0).otherwise(1)
            marks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((at(i) >= 0) & (at(i) < 2 * count) & (at(i) % 2 == 0), F.lit("&nbsp;")).otherwise(F.lit("")))
            return F.when(tail, F.slice(lines, r["h"] + 1, n)).otherwise(marks)

        return written

    def filled(lines, spans):
        blanks = F.transform(lines, lambda l, i: blank(l) & ~fenced(spans, i))
        return kernels.let(kernels.let(blanks, runs), lambda es: _rebuilt(lines, es, block(lines)))

    return docs.where("text is not null").select("doc_id", with_lines(filled).alias("text"))


def document_titles(docs: DataFrame, missing: str = "無題") -> DataFrame:
    """(doc_id, title): the first level-1 heading outside fences."""
    title = lambda l: strip(F.regexp_replace(l, r"^ {0,3}#[ \t]+|[ \t]+#*[ \t]*$", ""))
    first = with_lines(lambda lines, spans: F.get(outside_fences(lines, spans, r"^ {0,3}#[ \t]+", lambda l, i: title(l)), F.lit(0)))
    return docs.select("doc_id", F.coalesce(F.nullif(first, F.lit("")), F.lit(missing)).alias("title"))


def diagram_blocks(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, source, view) of mermaid fences; view is diagram, code or both, and code alone is left out.

    A mark of the other kind inside a fence is part of its source.
    """

    def block(lines, s):
        info = F.regexp_replace(F.get(lines, s["a"]), FENCE, "")
        view = F.coalesce(F.nullif(F.regexp_extract(info, r"show=(\w+)", 1), F.lit("")), F.lit("diagram"))
        source = F.array_join(F.slice(lines, s["a"] + 2, s["b"] - s["a"] - 1), "\n")
        return F.struct(info.rlike(r"^\s*mermaid\b").alias("own"), source.alias("source"), view.alias("view"), (s["b"] > s["a"] + 1).alias("solid"))

    blocks = with_lines(lambda lines, spans: F.transform(spans, lambda s: block(lines, s)))
    found = docs.where(F.contains("text", F.lit("mermaid"))).select("doc_id", F.explode(blocks).alias("s"))
    return found.where("s.own and s.solid and s.view <> 'code'").select("doc_id", "s.source", "s.view").distinct()


def page_parts(docs: DataFrame) -> DataFrame:
    """Lines with the number of their part; a page break line opens the next and belongs to none."""
    rows = docs.withColumn("lines", lines_of())
    rows = rows.withColumn("breaks", F.filter(F.transform("lines", lambda l, i: F.when(l.rlike(PAGE_BREAK), i)), lambda i: i.isNotNull()))
    lines = rows.select("doc_id", "breaks", F.posexplode("lines").alias("at", "line")).where("not array_contains(breaks, at)")
    return lines.select("doc_id", (F.col("at") + 1).alias("n"), "line", F.size(F.filter("breaks", lambda b: b < F.col("at"))).cast("long").alias("part"))


def neutralize_links(df: DataFrame, column: str = "text") -> DataFrame:
    """Links of other schemes than http, https, mailto, tel or none become their text and address."""
    bad = r"(?<!!)\[([^\]]*)\]\(((?!(?i:https?|mailto|tel):)[A-Za-z][A-Za-z0-9+.-]*:[^()\s]*)\)"
    image = r"!\[([^\]]*)\]\(((?!(?i:data:image/))[A-Za-z][A-Za-z0-9+.-]*:[^()\s]*)\)"
    return df.withColumn(column, F.regexp_replace(F.regexp_replace(column, bad, "$1 ($2)"), image, "[画像: $1]($2)"))


def strip_data_images(docs: DataFrame, placeholder: str = "data:,") -> tuple[DataFrame, DataFrame]:
    """Documents with inline image data replaced by a placeholder and its fingerprint, and (fingerprint, image) once each."""
    uri = r"data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=]+"
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(uri), 0)).alias("image")).select(F.xxhash64("image").alias("fingerprint"), "image").dropDuplicates(["image"])
    pieces = F.regexp_extract_all("text", F.lit(uri), 0)
    replaced = F.aggregate(F.array_distinct(pieces), F.col("text"), lambda t, m: F.replace(t, m, F.concat(F.lit(placeholder), F.hex(F.xxhash64(m)))))
    return docs.withColumn("text", replaced), found


def escape_angles(docs: DataFrame, undo: bool = False) -> DataFrame:
    """(doc_id, text) with ``<`` escaped (or unescaped) outside fences and inline code; escaped ones stay. A null text stays null."""
    change = lambda t: F.regexp_replace(t, r"(?<!\\)((?:\\\\)*)\\<", "$1<") if undo else F.regexp_replace(t, r"(?<!\\)((?:\\\\)*)<", r"$1\\<")
    escaped = lambda lines, spans: F.transform(lines, lambda l, i: F.when(~F.contains(l, F.lit("<")) | fenced(spans, i), l).otherwise(map_outside_code(l, change)))
    return docs.select("doc_id", F.when(F.contains("text", F.lit("<")), F.array_join(with_lines(escaped), "\n")).otherwise(F.col("text")).alias("text"))


def nth_visible_char(pieces: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, nth, piece, at) of the nth character that is no white space, over ordered pieces (doc_id, piece, text); at is from 0."""
    w = Window.partitionBy("doc_id").orderBy("piece")
    seen = F.length(F.regexp_replace("text", r"(?U)\s+", ""))
    counted = pieces.withColumn("upto", F.sum(seen).over(w)).withColumn("from", F.col("upto") - seen)
    hit = targets.join(counted, "doc_id").where("nth > from and nth <= upto")
    places = F.filter(F.sequence(F.lit(1), F.length("text")), lambda i: ~F.substring("text", i, F.lit(1)).rlike(r"(?U)\s"))
    return hit.select("doc_id", "nth", "piece", (F.element_at(places, (F.col("nth") - F.col("from")).cast("int")) - 1).alias("at"))
