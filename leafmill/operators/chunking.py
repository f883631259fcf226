"""Splitting Markdown into chunks: sections by headings, runs of table and prose lines, greedy packing.

Runs and groups are also there as windows over a table of lines. Sections and chunking go row by row:
the lines of a document are an array that functions cut into sections, runs and chunks, and packing, which depends
on what was packed before, folds over one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.kernels import let
from leafmill.tables import blank, strip

CHUNK_SIZE = 800
OVERLAP = 100
HEADING = r"^(#{1,6})[ \t]+(.+?)[ \t]*$"
DITTO = ("", "〃")


def section_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n, line, section, heading) of every line that is not a heading; section 0 is the preamble.

    Code fences do not count here: a heading line inside one opens a section too. Each row is cut by itself.
    """

    def cut(lines):
        heads = F.filter(F.transform(lines, lambda l, i: F.when(l.rlike(HEADING), i)), lambda i: i.isNotNull())
        name = lambda h: F.coalesce(F.when(h >= 0, strip(F.regexp_extract(F.get(lines, h), HEADING, 2))), F.lit(""))
        body = lambda at, h, k: F.slice(lines, h + 2, F.coalesce(F.get(at, k + 1), F.size(lines)) - h - 1)
        section = lambda at, h, k: F.struct(k.cast("bigint").alias("section"), name(h).alias("heading"), (h + 2).alias("first"), body(at, h, k).alias("lines"))
        return let(F.concat(F.array(F.lit(-1)), heads), lambda at: F.transform(at, lambda h, k: section(at, h, k)))

    sections = docs.select("doc_id", F.explode(let(F.split(F.col("text"), "\n", -1), cut)).alias("s"))
    lines = sections.select("doc_id", "s.section", "s.heading", "s.first", F.posexplode("s.lines").alias("at", "line"))
    return lines.select("doc_id", (F.col("first") + F.col("at")).alias("n"), "line", "section", "heading")


def _is_table(line):
    return line.rlike(r"\A(?U)\s*\|")


def table_runs(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lines with is_table and the number of their run of table or other lines, from 1 within ``by``."""
    w = Window.partitionBy(*(by or ["doc_id"])).orderBy("n")
    marked = lines.withColumn("is_table", _is_table(F.col("line")))
    change = F.coalesce((F.lag("is_table").over(w) != F.col("is_table")).cast("int"), F.lit(1))
    return marked.withColumn("change", change).withColumn("run", F.sum("change").over(w)).drop("change")


def first_cell(line):
    """The first cell of a table row."""
    return strip(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|", -1)[0])


def ditto_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Data rows of tables with their group: a row joins the one before if its first cell is blank, a ditto mark, or the last real one."""
    w = Window.partitionBy(*by).orderBy("n")
    cell = rows.withColumn("cell", first_cell(F.col("line")))
    real = F.when(~F.col("cell").isin(*DITTO), F.col("cell"))
    before = F.last(real, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cell = cell.withColumns({"before": before, "nth": F.row_number().over(w)})
    opens = (F.col("nth") == 1) | ~(F.col("cell").isin(*DITTO) | F.col("cell").eqNullSafe(F.col("before")))
    return cell.withColumn("opens", opens.cast("int")).withColumn("grp", F.sum("opens").over(w)).drop("opens", "before", "nth")


def _greedy(parts, size, start, joint):
    """Chunks (arrays of texts) by filling up to a size. parts: array<struct<text, cost>>; ``joint`` is added from the second part on."""
    chunk = "struct<done:array<array<string>>,cur:array<string>,used:bigint>"
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(start).cast("bigint").alias("used") if isinstance(start, int) else start.cast("bigint").alias("used")).cast(chunk)
    base = F.lit(start) if isinstance(start, int) else start

    def step(s, p):
        cost = p["cost"] + F.when(F.size(s["cur"]) > 0, joint).otherwise(0)
        full = (F.size(s["cur"]) > 0) & (s["used"] + cost > size)
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), F.array(p["text"]).alias("cur"), (base + p["cost"]).cast("bigint").alias("used"))).otherwise(
            F.struct(s["done"].alias("done"), F.concat(s["cur"], F.array(p["text"])).alias("cur"), (s["used"] + cost).cast("bigint").alias("used"))
        ).cast(chunk)

    return F.aggregate(parts, empty, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))


def table_groups(rows):
    """The data rows (from the third on) of a table's lines as its ditto groups, struct(text, cost); the cost is the length of the rows and their line ends."""

    def grouped(data):
        cells = F.transform(data, first_cell)

        def cut(cells):
            real = F.filter(F.transform(cells, lambda c, i: F.when(~c.isin(*DITTO), i)), lambda i: i.isNotNull())
            opening = lambda at: F.filter(F.transform(at, lambda i, k: F.when((k == 0) | (F.get(cells, i) != F.get(cells, F.get(at, k - 1))), i)), lambda i: i.isNotNull())
            starts = let(real, lambda at: F.array_sort(F.array_union(F.array(F.lit(0)), opening(at))))
            text = lambda g: F.struct(F.array_join(g, "\n").alias("text"), F.aggregate(g, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x) + 1).alias("cost"))
            return let(starts, lambda at: F.transform(F.transform(at, lambda i, k: F.slice(data, i + 1, F.coalesce(F.get(at, k + 1), F.size(data)) - i)), text))

        return F.when(F.size(data) > 0, let(cells, cut)).otherwise(F.array().cast("array<struct<text:string,cost:bigint>>"))

    return let(F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0))), grouped)


def pack_table(rows, size: int = CHUNK_SIZE):
    """The chunks of a table's lines (at least two): whole groups of rows under a repeated header. A table that fits is one chunk, whatever its groups."""

    def under(header):
        filled = lambda groups: F.transform(_greedy(groups, size, F.length(header), 0), lambda c: F.concat(header, F.lit("\n"), F.array_join(c, "\n")))
        return let(table_groups(rows), lambda groups: F.when(F.size(groups) > 0, filled(groups)).otherwise(F.array(header)))

    groups = let(F.array_join(F.slice(rows, 1, 2), "\n"), under)
    return let(F.array_join(rows, "\n"), lambda whole: F.when(F.length(whole) <= size, F.array(whole)).otherwise(groups))


def windows_of(text, size: int = CHUNK_SIZE, overlap: int = OVERLAP):
    """Overlapping windows of a text, each stripped, blank ones left out; a last window within the overlap stays."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the windows")
    body = strip(text)
    starts = F.when(F.length(body) > 0, F.sequence(F.lit(0), F.length(body) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda s: strip(F.substring(body, s + 1, F.lit(size)))), lambda c: c != "")


def fixed_windows(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, part, chunk) of every text."""
    return docs.select("doc_id", F.posexplode(windows_of(F.col("text"), size, overlap)).alias("part", "chunk"))


def pack_prose(text, size: int = CHUNK_SIZE, overlap: int = OVERLAP):
    """The chunks of a text: paragraphs filled up to the size, longer ones as windows."""
    paragraphs = F.filter(F.transform(F.split(strip(text), r"\n(?U)\s*\n", -1), strip), lambda p: p != "")

    def of(ps):
        too_long = lambda i: F.coalesce(F.length(F.get(ps, i)) > size, F.lit(False))
        starts = F.filter(F.transform(ps, lambda p, i: F.when((i == 0) | too_long(i) | too_long(i - 1), i)), lambda i: i.isNotNull())
        short = lambda part: F.transform(_greedy(F.transform(part, lambda x: F.struct(x.alias("text"), F.length(x).cast("bigint").alias("cost"))), size, 0, 2), lambda c: F.array_join(c, "\n\n"))
        chunks = lambda part: F.when(F.length(part[0]) > size, windows_of(part[0], size, overlap)).otherwise(short(part))
        return let(starts, lambda at: F.flatten(F.transform(F.transform(at, lambda i, k: F.slice(ps, i + 1, F.coalesce(F.get(at, k + 1), F.size(ps)) - i)), chunks)))

    return let(paragraphs, of)


def sections_of(text):
    """The sections of a text as struct(heading, body): what follows each heading line, and before them the preamble; stripped, blank ones left out."""

    def cut(lines):
        heads = F.filter(F.transform(lines, lambda l, i: F.when(l.rlike(HEADING), i)), lambda i: i.isNotNull())
        name = lambda h: F.coalesce(F.when(h >= 0, strip(F.regexp_extract(F.get(lines, h), HEADING, 2))), F.lit(""))
        body = lambda at, h, k: strip(F.array_join(F.slice(lines, h + 2, F.coalesce(F.get(at, k + 1), F.size(lines)) - h - 1), "\n"))
        starts = F.concat(F.array(F.lit(-1)), heads)
        return let(starts, lambda at: F.filter(F.transform(at, lambda h, k: F.struct(name(h).alias("heading"), body(at, h, k).alias("body"))), lambda s: s["body"] != ""))

    return let(F.split(strip(text), "\n", -1), cut)


def runs_of(body):
    """The runs of table and other lines of a section as struct(is_table, rows)."""

    def cut(lines):
        flags = F.transform(lines, _is_table)
        starts = lambda flags: F.filter(F.transform(flags, lambda t, i: F.when((i == 0) | (t != F.get(flags, i - 1)), i)), lambda i: i.isNotNull())
        piece = lambda at, i, k: F.slice(lines, i + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - i)
        return let(let(flags, starts), lambda at: F.transform(at, lambda i, k: F.struct(_is_table(F.get(lines, i)).alias("is_table"), piece(at, i, k).alias("rows"))))

    return let(F.split(body, "\n", -1), cut)


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, content): tables keep their rows and header together, prose its paragraphs; the heading goes before each chunk.

    Each row is cut by itself, without a shuffle, whatever ids repeat or lack; a null or blank text gives no chunk.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunks")

    def of_run(run):
        text = strip(F.array_join(run["rows"], "\n"))
        none = F.array().cast("array<string>")
        prose = lambda t: F.when(F.length(t) <= size, F.array(t)).otherwise(pack_prose(t, size, overlap))
        table = run["is_table"] & (F.size(run["rows"]) >= 2)
        return let(text, lambda t: F.when(t == "", none).when(table, pack_table(run["rows"], size)).otherwise(prose(t)))

    def of_section(s):
        headed = lambda c: F.when(s["heading"] != "", F.concat(F.lit("【"), s["heading"], F.lit("】\n"), c)).otherwise(c)
        chunks = F.filter(F.flatten(F.transform(runs_of(s["body"]), of_run)), lambda c: ~blank(c))
        return F.transform(chunks, headed)

    chunks = F.flatten(F.transform(sections_of(F.col("text")), of_section))
    return docs.where("text is not null").select("doc_id", F.posexplode(chunks).alias("chunk_index", "content"))
