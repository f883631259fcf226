"""Two readings of a page: differences, corrections, rechecks, and the reviewed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import kernels
from leafmill.operators import markdown
from leafmill.tables import blank, strip

MOST_UNRESOLVED = 3
LEAST_SIMILARITY = 0.6
CONTEXT_CHARS = 40
LAYER_CHARS = 20
NEEDLE_CHARS = 3
#: The heading of a page in a draft, the sentence for a page without text, circled numbers.
PAGE_HEADING = ("## PDF ", "ページ目")
NO_TEXT = "（このページはテキストを検出できませんでした）"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
CIRCLED_MARK = r"\$?\\textcircled\{0?(20|1[0-9]|[1-9])\}\$?"
MARKER = "page-review-marker"


def split_text_layer(documents: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): pages between form feeds; the empty one after the last is left out."""
    pages = F.split("text", "\f", -1)
    pages = F.when(F.element_at(pages, -1) == "", F.slice(pages, F.lit(1), F.size(pages) - 1)).otherwise(pages)
    return documents.select("doc_id", F.posexplode(pages).alias("page_no", "page")).select("doc_id", (F.col("page_no") + 1).alias("page_no"), F.col("page").alias("text"))


def clean_markup(text: Column) -> Column:
    """Line-break tags and hard spaces as spaces, circled numbers as characters."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?i)\s*<br\s*/?>\s*", " "), r"(?i)(?:&nbsp;)+", " ")
    def circled(text):
        for n, c in enumerate(CIRCLED, 1):
            text = F.replace(text, F.lit(f"\\textcircled{{{n}}}"), F.lit(c))
        return text

    return kernels.let(out, lambda out: F.when(F.contains(out, F.lit("\\textcircled")), circled(F.regexp_replace(out, CIRCLED_MARK, r"\\textcircled{$1}"))).otherwise(out))


def clean_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with markup cleaned and then tables repaired."""
    return markdown.repair_tables(docs.select("doc_id", clean_markup(F.col("text")).alias("text")))


def page_diff(readings: DataFrame) -> DataFrame:
    """Segments (doc_id, pos, segment_id, primary_text, alternate_text, is_match) of (doc_id, text, alternate).

    Readings that differ in white space alone are one matching segment. Of the others the words are cut
    and compared by SQL functions; only the arrays of compared words go to the difference kernel, and its ranges
    are cut from the readings again by SQL functions, all in one pass over the readings. The primary texts in order are the primary reading:
    one without a word is a single segment, which matches if the other has none either. A null reading is empty.
    Each row is compared by itself, whatever ids repeat.
    """
    spaced = lambda c: strip(F.regexp_replace(F.col(c), r"(?U)\s+", " "))
    texts = readings.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("alternate", F.lit("")).alias("alternate"))
    marked = texts.withColumn("same", spaced("text") == spaced("alternate"))
    of_others = lambda value: F.when(~F.col("same"), value)

    # NFKC runs once over all words of a text.
    listed = marked.withColumns({f"{c}_listed": of_others(kernels.nfkc(kernels.listed_words(F.col(c)))) for c in ("text", "alternate")})
    side = lambda c: of_others(kernels.spans_and_words(kernels.word_pieces(F.col(c)), kernels.compared_words(F.col(f"{c}_listed"))))
    words = listed.select("doc_id", "text", "alternate", "same", side("text").alias("x"), side("alternate").alias("y"))
    ranges = words.withColumn("ranges", kernels.difference_ranges(F.col("x.words"), F.col("y.words")))

    piece = lambda spans, r, x: F.array_join(F.slice(spans, r[x] + 1, r[f"{x}_end"] - r[x]), "")
    of_range = lambda a, b: lambda r: F.struct(piece(a, r, "a").alias("primary_text"), piece(b, r, "b").alias("alternate_text"), r["alike"].alias("is_match"))
    segments = kernels.let(F.col("x.spans"), lambda a: kernels.let(F.col("y.spans"), lambda b: F.transform("ranges", of_range(a, b))))
    whole = lambda alike: F.array(F.struct(F.col("text").alias("primary_text"), F.col("alternate").alias("alternate_text"), alike.alias("is_match")))
    segments = F.when(F.col("same"), whole(F.lit(True))).when(F.size("x.words") == 0, whole(F.size("y.words") == 0)).otherwise(segments)
    cut = ranges.select("doc_id", F.posexplode(segments).alias("pos", "s"))
    return cut.select("doc_id", "pos", F.concat(F.lit("seg-"), F.col("pos").cast("string")).alias("segment_id"), "s.*")


def apply_corrections(segments: DataFrame, corrections: DataFrame, similarity: str | None = None) -> DataFrame:
    """Segments with status, final_text and reason.

    corrections: doc_id, segment_id, corrected_text, still_uncertain, reason, and the column named by
    ``similarity`` if it is known; else it is computed against both readings.
    """
    out = segments.join(corrections, ["doc_id", "segment_id"], "left")
    sure = F.col("corrected_text").isNotNull() & ~F.coalesce("still_uncertain", F.lit(False)) & ~blank(F.col("corrected_text"))
    if similarity is None:  # the text is a column of its own, so that its conditions are not repeated wherever it is read
        judged = out.withColumn("_judged", F.when(~F.col("is_match") & sure, F.col("corrected_text")))
        out = judged.withColumn("_near", kernels.nearest(F.col("_judged"), [F.col("primary_text"), F.col("alternate_text")], LEAST_SIMILARITY))
    near = F.col(similarity or "_near")
    status = F.when(F.col("is_match"), "match").when(~sure, "needs_review").when(F.coalesce(near, F.lit(0.0)) < LEAST_SIMILARITY, "needs_review").otherwise("auto_corrected")
    out = out.withColumn("status", status).drop("_judged", "_near")
    return out.withColumn("final_text", F.when(F.col("status") == "auto_corrected", F.col("corrected_text")).otherwise(F.col("primary_text")))


def text_layer_evidence(df: DataFrame, needle: str, page: str) -> Column:
    """Whether the squashed page holds the squashed needle; null for a short needle, or a page without a layer."""
    n, p = F.col(needle), F.col(page)
    return F.when((F.length(n) >= NEEDLE_CHARS) & (F.length(p) >= LAYER_CHARS), F.contains(p, n))


def page_texts(pages: DataFrame, layer: DataFrame) -> DataFrame:
    """pages (doc_id, page) with ``page_text``: the text layer's page of that number; null without one, or one of fewer than LAYER_CHARS characters besides white space.

    layer: doc_id, page_no, text, as split_text_layer gives it.
    """
    solid = F.length(F.regexp_replace("text", r"(?U)\s+", "")) >= LAYER_CHARS
    return pages.join(layer.where(solid).select("doc_id", F.col("page_no").alias("page"), F.col("text").alias("page_text")), ["doc_id", "page"], "left")


def recheck_corrections(segments: DataFrame, layer: DataFrame, judgments: DataFrame) -> DataFrame:
    """Corrected segments that are real rewrites, checked again: status, final_text and basis.

    layer: doc_id, page_text; judgments: doc_id, segment_id, run (straight or swapped), better (1, 2 or equal).
    The page's text decides when it holds exactly one wording; else a correction goes only if both runs prefer the primary.
    """
    run = lambda name: judgments.where(F.col("run") == name).select("doc_id", "segment_id", F.col("better").alias(name))
    out = segments.join(run("straight"), ["doc_id", "segment_id"], "left").join(run("swapped"), ["doc_id", "segment_id"], "left")
    out = out.withColumns({"c": kernels.squash(F.col("final_text")), "p": kernels.squash(F.col("primary_text")), "same": kernels.squash_diff(F.col("final_text")) == kernels.squash_diff(F.col("primary_text"))})
    # A page goes once to the wordings that are looked for in it, and not to each of its segments.
    asked = out.where("status = 'auto_corrected' and not same").groupBy("doc_id").agg(F.collect_set("c").alias("cs"), F.collect_set("p").alias("ps"))
    pages = layer.where("page_text is not null").select("doc_id", kernels.squash(F.col("page_text")).alias("page")).join(asked, "doc_id")
    there = lambda name: F.transform(F.array_distinct(F.concat("cs", "ps")), lambda n: F.struct(n.alias(name), F.when((F.length(n) >= NEEDLE_CHARS) & (F.length("page") >= LAYER_CHARS), F.contains(F.col("page"), n)).alias(f"in_{name}")))
    for name in ("c", "p"):
        out = out.join(pages.select("doc_id", F.explode(there(name)).alias("w")).select("doc_id", "w.*"), ["doc_id", name], "left")
    real = (F.col("status") == "auto_corrected") & ~F.col("same") & ~blank(F.col("final_text")) & ~blank(F.col("primary_text"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    both = F.coalesce((F.col("straight") == "1") & (F.col("swapped") == "2"), F.lit(False))
    verdict = F.when(~real, "none").when(yes("in_c") & ~yes("in_p"), "layer-keep").when(yes("in_p") & ~yes("in_c"), "layer-cancel").when(both, "language-cancel").otherwise("keep")
    out = out.withColumn("basis", verdict)
    return out.withColumns({
        "status": F.when(F.col("basis") == "layer-cancel", "match").when(F.col("basis") == "language-cancel", "needs_review").otherwise(F.col("status")),
        "final_text": F.when(F.col("basis").endswith("cancel"), F.col("primary_text")).otherwise(F.col("final_text")),
    }).drop("c", "p", "same", "in_c", "in_p", "straight", "swapped")


def page_review_load(segments: DataFrame, most: int = MOST_UNRESOLVED) -> DataFrame:
    """(doc_id, needs_review, unusable): more than ``most`` open segments make the comparison unusable."""
    return segments.groupBy("doc_id").agg(F.count_if(F.col("status") == "needs_review").alias("needs_review")).withColumn("unusable", F.col("needs_review") > most)


def assemble_page(segments: DataFrame) -> DataFrame:
    """(doc_id, text): final texts in order, a space where neither side of a seam has white space."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "final_text"))), lambda s: s["final_text"])

    def join(a, p):
        bare = (a != "") & (p != "") & ~a.rlike(r"(?U)\s\z") & ~p.rlike(r"\A(?U)\s")
        return F.concat(a, F.when(bare, F.lit(" ")).otherwise(F.lit("")), p)

    return segments.groupBy("doc_id").agg(parts.alias("parts")).select("doc_id", F.aggregate("parts", F.lit(""), join).alias("text"))


def assemble_draft(pages: DataFrame, no_text: Column | None = None) -> DataFrame:
    """(draft_id, markdown): pages in order under their headings. pages: draft_id, page, text.

    Pages that ``no_text`` marks, by default the blank ones, hold a fixed sentence. One that it does not mark is left out
    where its text is null, and stands as it is where that is blank; a draft without a page left is null.
    """
    body = F.when(blank(F.col("text")) if no_text is None else no_text, F.lit(NO_TEXT)).otherwise(F.col("text"))
    block = F.concat(F.lit(PAGE_HEADING[0]), F.col("page").cast("string"), F.lit(PAGE_HEADING[1] + "\n\n"), body, F.lit("\n"))
    blocks = F.sort_array(F.collect_list(F.when(block.isNotNull(), F.struct("page", block.alias("b")))))
    drafts = pages.groupBy("draft_id").agg(blocks.alias("blocks"))
    return drafts.select("draft_id", F.when(F.size("blocks") > 0, F.array_join(F.transform("blocks", lambda x: x["b"]), "\n")).alias("markdown"))


def assemble_segments(segments: DataFrame, reviews: DataFrame) -> DataFrame:
    """(doc_id, segments): each page's segments in order, before them a marker where the whole page needs review. reviews: doc_id, reason."""
    own = segments.select("doc_id", F.struct("pos", "segment_id", "status", "final_text").alias("s"))
    marks = reviews.select("doc_id", F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit(MARKER).alias("segment_id"), F.lit("needs_review").alias("status"), F.col("reason").alias("final_text")).alias("s"))
    return own.unionByName(marks).groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("segments"))


def locate_segments(segments: DataFrame, drafts: DataFrame) -> DataFrame:
    """Segments with the start and end (from 0) of their text in the draft, from their page's heading on; null if it is not there.

    segments: draft_id, page, segment_id, final_text, primary_text; drafts: draft_id, markdown.
    """
    asked = segments.select("draft_id", "page", "segment_id", strip(F.col("final_text")).alias("f"), strip(F.col("primary_text")).alias("p"))
    grouped = asked.groupBy("draft_id").agg(F.collect_list(F.struct("page", "segment_id", "f", "p")).alias("asked"))  # a draft's text goes to no segment
    draft = F.col("markdown")

    def place(s: Column) -> Column:
        head = F.position(F.concat(F.lit(PAGE_HEADING[0]), s["page"].cast("string"), F.lit(PAGE_HEADING[1])), draft)
        at = lambda needle: F.when((needle != "") & (head > 0), F.nullif(F.position(needle, draft, head), F.lit(0))) - 1
        found = lambda f, p: F.struct(s["page"].alias("page"), s["segment_id"].alias("segment_id"), F.coalesce(f, p).alias("start"), F.coalesce(f + F.length(s["f"]), p + F.length(s["p"])).alias("end"))
        return kernels.let(at(s["f"]), lambda f: kernels.let(at(s["p"]), lambda p: found(f, p)))

    return grouped.join(drafts, "draft_id").select("draft_id", F.explode(F.transform("asked", place)).alias("s")).select("draft_id", "s.*")


def cut_repeats(texts: DataFrame) -> DataFrame:
    """(doc_id, text): blocks between code fence marks up to the first that came before, joined by blank lines; empty where there is no block."""

    def kept(blocks):
        repeated = F.filter(F.transform(blocks, lambda b, i: F.when(F.array_position(blocks, b) <= i, i)), lambda i: i.isNotNull())
        return F.array_join(F.slice(blocks, F.lit(1), F.coalesce(F.get(repeated, F.lit(0)), F.size(blocks))), "\n\n")

    blocks = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"```\w*", -1), strip), lambda b: b != "")
    return texts.select("doc_id", kernels.let(blocks, kept).alias("text"))


def segment_context(segments: DataFrame, chars: int = CONTEXT_CHARS) -> DataFrame:
    """Segments with the characters of the primary reading before and after them."""
    own = Window.partitionBy("doc_id").orderBy("pos")
    # Segments of one or more characters: so many neighbours on either side are enough.
    solid = segments.where("primary_text <> ''").select("doc_id", "pos", "primary_text")
    near = lambda a, b: F.array_join(F.collect_list("edge").over(own.rowsBetween(a, b)), "")
    before = solid.withColumn("edge", F.right("primary_text", F.lit(chars))).select("doc_id", "pos", F.right(near(-chars, -1), F.lit(chars)).alias("before"), F.right(near(-chars, 0), F.lit(chars)).alias("upto"))
    after = solid.withColumn("edge", F.left("primary_text", F.lit(chars))).select("doc_id", "pos", F.left(near(1, chars), F.lit(chars)).alias("after"), F.left(near(0, chars), F.lit(chars)).alias("from_here"))
    out = segments.join(before, ["doc_id", "pos"], "left").join(after, ["doc_id", "pos"], "left")
    # An empty segment has what its nearest neighbours that are not empty end and begin with.
    gap = lambda c, near: F.coalesce(c, near, F.lit(""))
    last = F.last("upto", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first("from_here", ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))
    return out.withColumns({"before": gap(F.col("before"), last), "after": gap(F.col("after"), following)}).drop("upto", "from_here")


def choose_reading(readings: DataFrame) -> DataFrame:
    """(doc_id, page, primary_text, alternate_text, review): which readings are compared, and whether the whole page needs review.

    readings: doc_id, page, source (primary, alternate, second, verify), text, ok.
    """
    of = lambda s: F.max(F.when(F.col("source") == s, F.col("text")))
    per = readings.groupBy("doc_id", "page").agg(of("primary").alias("p"), of("alternate").alias("a"), of("second").alias("s"), of("verify").alias("v"), F.max(F.when(F.col("source") == "verify", F.col("ok"))).alias("ok"))
    no_p, no_a, no_s = blank(F.col("p")), blank(F.col("a")), blank(F.col("s"))
    good = F.coalesce(F.col("ok"), F.lit(False)) | F.coalesce(F.col("v") != F.col("p"), F.lit(False))
    primary = F.when(no_p, F.coalesce("a", F.lit(""))).otherwise(F.col("p"))
    alternate = F.when(no_p, F.coalesce("a", F.lit(""))).when(~no_a, F.col("a")).when(~no_s, F.col("s")).when(good, F.coalesce("v", "p")).otherwise(F.col("p"))
    review = no_p | (no_a & no_s & ~good)
    return per.select("doc_id", "page", primary.alias("primary_text"), alternate.alias("alternate_text"), review.alias("review"))


#: The readings that a primary one is compared with, in the order in which they are asked for.
SOURCES = ("alternate", "second", "verify")


def route_readings(readings: DataFrame, corrections: DataFrame, most: int = MOST_UNRESOLVED, similarity: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages compared with the first reading that serves: their segments, and (doc_id, page, source, review).

    readings: doc_id, page, source (primary, alternate, second or verify), text, ok; corrections as
    ``apply_corrections`` has them, with page and source. A page goes through stages, each of which takes only the pages that the
    ones before left over: its alternate reading serves unless more than ``most`` segments stay open after
    corrections (the comparison itself is then in doubt); then a second reading; then the verified one, if it
    holds or differs from the primary. A page that none serves is compared with itself and needs review as a whole, as
    does one without a primary reading, whose alternate stands in. Segments keep the first primary text in every stage.
    """
    of = lambda s, c="text": F.max(F.when(F.col("source") == s, F.col(c)))
    per = readings.groupBy("doc_id", "page").agg(*[of(s).alias(s) for s in ("primary", *SOURCES)], of("verify", "ok").alias("ok"))
    page = F.struct("doc_id", "page", "source").alias("doc_id")
    told = corrections.select(page, *[c for c in corrections.columns if c not in ("doc_id", "page", "source")])

    def compared(pages: DataFrame) -> DataFrame:
        """Segments of pages (doc_id, page, source, primary, other)."""
        return apply_corrections(page_diff(pages.select(page, F.col("primary").alias("text"), F.col("other").alias("alternate"))), told, similarity)

    apart = lambda df: df.select("doc_id.doc_id", "doc_id.page", "doc_id.source", *[c for c in df.columns if c != "doc_id"])
    key = ["doc_id", "page"]
    read = per.where(~blank(F.col("primary")))
    first = read.where(~blank(F.col("alternate"))).select(*key, F.lit("alternate").alias("source"), "primary", F.col("alternate").alias("other"))
    # The first comparison is cached, for both its outcomes read it.
    tried = compared(first).cache()
    usable = apart(page_review_load(tried, most).where("not unusable").select("doc_id")).drop("source")
    # All that it leaves over is compared at once, each page with the reading that is its turn.
    left = read.join(usable, key, "left_anti")
    holds = F.coalesce(F.col("ok"), F.lit(False)) | F.coalesce(F.col("verify") != F.col("primary"), F.lit(False))
    turn = F.when(~blank(F.col("second")), "second").when(holds, "verify").otherwise("none")
    other = F.when(F.col("source") == "second", F.col("second")).when(F.col("source") == "verify", F.coalesce("verify", "primary")).otherwise(F.col("primary"))
    left = left.withColumn("source", turn).select(*key, "source", "primary", other.alias("other"))
    instead = F.coalesce("alternate", F.lit(""))
    lost = per.where(blank(F.col("primary"))).select(*key, F.lit("lost").alias("source"), instead.alias("primary"), instead.alias("other"))
    rest = left.unionByName(lost)
    segments = apart(tried).join(usable, key, "left_semi").unionByName(apart(compared(rest)))
    routes = usable.select(*key, F.lit("alternate").alias("source")).unionByName(rest.select(*key, "source"))
    return segments, routes.withColumn("review", F.col("source").isin("none", "lost"))


def first_valid_response(responses: DataFrame, schema: str, valid: Column, key: list[str], most: int = 2) -> DataFrame:
    """Of model responses (key, attempt, body) the first attempt whose JSON is valid; none of ``most`` makes the row uncertain.

    ``valid`` is a condition on the parsed column ``r``.
    """
    parsed = responses.where(F.col("attempt") <= most).withColumn("r", F.from_json("body", schema)).withColumn("valid", F.coalesce(valid, F.lit(False)))
    per = parsed.groupBy(*key).agg(F.min_by(F.when(F.col("valid"), F.col("r")), F.when(F.col("valid"), F.col("attempt"))).alias("r"))
    return per.withColumn("uncertain", F.col("r").isNull())
