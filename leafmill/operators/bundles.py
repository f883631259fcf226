"""File bundles: classified references, their resolution, candidates to import, images, exports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.tables import shared_folder, strip

MOST_FILES = 5000
IMAGE_BYTES = 10 << 20
#: Image types that can be embedded, by extension.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}


def file_kind(path: Column) -> Column:
    """html, markdown, css, image or other, by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("html", "htm", "xhtml"), "html").when(ext.isin("md", "markdown", "mdown"), "markdown").when(ext == "css", "css").when(ext.isin(*IMAGE_TYPES), "image").otherwise("other")


def bundle_paths(files: DataFrame) -> DataFrame:
    """Files of a chosen folder: its own name removed from the path, hidden ones and node_modules left out, with kind."""
    parts = F.split("path", "/", -1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | (p == "node_modules"))
    kept = files.where(~hidden).withColumn("path", F.array_join(rest, "/")).where("path <> ''")
    return kept.withColumn("kind", file_kind(F.col("path")))


def size_guard(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(bundle_id, files, too_many)."""
    return files.groupBy("bundle_id").agg(F.count("*").alias("files")).withColumn("too_many", F.col("files") > most)


def classify_reference(ref: Column, base: Column) -> Column:
    """struct(kind, path): inline, external, or local with its normalised path, null above the root."""
    r = strip(ref)
    inline = (r == "") | r.startswith("#") | r.rlike("(?i)^data:")
    external = r.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | r.startswith("//") | r.startswith("\\\\")
    bare = F.regexp_replace(r, "(?s)[?#].*$", "")
    path = F.replace(F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare), F.lit("\\"), F.lit("/"))
    full = F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))
    state = "struct<ok:boolean,segs:array<string>>"
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("segs")).cast(state)

    def step(s, seg):
        up = F.when(F.size(s["segs"]) == 0, F.struct(F.lit(False).alias("ok"), s["segs"].alias("segs")).cast(state)).otherwise(
            F.struct(s["ok"].alias("ok"), F.slice(s["segs"], F.lit(1), F.size(s["segs"]) - 1).alias("segs")).cast(state)
        )
        return F.when(~s["ok"] | (seg == "") | (seg == "."), s).when(seg == "..", up).otherwise(F.struct(s["ok"].alias("ok"), F.concat(s["segs"], F.array(seg)).alias("segs")).cast(state))

    local = F.aggregate(F.split(full, "/", -1), start, step, lambda s: F.when(s["ok"], F.array_join(s["segs"], "/")))
    kind = F.when(inline, "inline").when(external, "external").otherwise("local")
    return F.struct(kind.alias("kind"), F.when(kind == "local", local).alias("path"))


def resolve_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (bundle_id, path, structured) with ``resolved``: the exact path, else the only one that differs in case, else
    (loose bundles) the only file of that name, whatever its case. Anything ambiguous stays unresolved."""
    name = lambda c: F.element_at(F.split(c, "/", -1), -1)
    exact = files.select("bundle_id", "path").distinct().select("bundle_id", "path", F.col("path").alias("r1"))
    one = lambda key, alias: files.select("bundle_id", key.alias(f"k_{alias}"), "path").distinct().groupBy("bundle_id", f"k_{alias}").agg(F.count("*").alias("c"), F.min("path").alias(alias)).where("c = 1").drop("c")
    out = refs.join(exact, ["bundle_id", "path"], "left").withColumns({"k_r2": F.lower("path"), "k_r3": F.lower(name(F.col("path")))})
    out = out.join(one(F.lower("path"), "r2"), ["bundle_id", "k_r2"], "left").join(one(F.lower(name(F.col("path"))), "r3"), ["bundle_id", "k_r3"], "left")
    return out.withColumn("resolved", F.coalesce("r1", "r2", F.when(~F.col("structured"), F.col("r3")))).drop("r1", "r2", "r3", "k_r2", "k_r3")


def link_stylesheets(links: DataFrame, css: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stylesheets in use (all of a loose bundle, the linked of a structured one), those that nothing links, and names that differ in case only.

    links: bundle_id, path; css: bundle_id, path, structured.
    """
    linked = css.join(links.select("bundle_id", "path").distinct(), ["bundle_id", "path"], "left_semi")
    used = css.where("not structured").unionByName(linked.where("structured"))
    clash = css.groupBy("bundle_id", F.lower("path").alias("name")).agg(F.count_distinct("path").alias("n")).where("n > 1").drop("n")
    return used, css.join(links.select("bundle_id", "path").distinct(), ["bundle_id", "path"], "left_anti"), clash


def rank_import_candidates(files: DataFrame) -> DataFrame:
    """(bundle_id, candidates, outcome): one candidate is taken, none is an error, several are a choice in a structured bundle and an error in a loose one.

    files: bundle_id, kind, structured.
    """
    candidate = F.when(F.col("structured"), F.col("kind").isin("html", "markdown")).otherwise(~F.col("kind").isin("css", "image"))
    per = files.groupBy("bundle_id", "structured").agg(F.count_if(candidate).alias("candidates"))
    outcome = F.when(F.col("candidates") == 1, "take").when(F.col("candidates") == 0, "error-none").when(F.col("structured"), "choose").otherwise("error-many")
    return per.withColumn("outcome", outcome)


def default_candidate_order(files: DataFrame) -> DataFrame:
    """Files with their position: the less deep first, then by path."""
    w = Window.partitionBy("bundle_id").orderBy(F.size(F.split("path", "/", -1)), "path")
    return files.withColumn("position", F.row_number().over(w))


def embeddable_images(files: DataFrame, most: int = IMAGE_BYTES) -> DataFrame:
    """Images that can be embedded: mime (declared, or by extension if none is), alt text from the name, and, of files with content, ``uri``.

    files: path, length, mime, and content (binary) if the data URI is wanted.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    by_ext = F.try_element_at(F.create_map(*[F.lit(x) for kv in IMAGE_TYPES.items() for x in kv]), ext)
    mime = F.when(F.coalesce(strip(F.col("mime")), F.lit("")) != "", F.lower(strip(F.col("mime")))).otherwise(by_ext)
    alt = F.regexp_replace(F.element_at(F.split("path", "/", -1), -1), r"\.[^.]*$", "")
    kept = files.withColumns({"mime": mime, "alt": alt}).where(F.col("mime").isin(*sorted(set(IMAGE_TYPES.values()))) & (F.col("length") <= most))
    if "content" in files.columns:
        kept = kept.withColumn("uri", F.concat(F.lit("data:"), "mime", F.lit(";base64,"), F.base64("content")))
    return kept


def plan_exports(outputs: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """outputs (export_id, path) with bad (an unusable segment), exists, and the decision for the whole export: reject, ask or write."""
    bad = F.exists(F.split("path", "/", -1), lambda s: (s == "") | (s == ".") | (s == "..") | s.rlike(r'[\\:*?"<>|\x00-\x1f]'))
    there = existing.select("path").distinct().withColumn("there", F.lit(True))
    marked = outputs.join(there, "path", "left").withColumns({"bad": bad, "exists": F.col("there").isNotNull()}).drop("there")
    # An export may hold any number of files: an aggregate, and no window that takes it whole.
    decision = F.when(F.max("bad"), "reject").when(F.max("exists") & F.lit(not overwrite), "ask").otherwise("write")
    decided = marked.groupBy(F.col("export_id").alias("_id")).agg(decision.alias("decision"))
    return marked.join(decided, F.col("export_id").eqNullSafe(F.col("_id"))).drop("_id")


def css_urls(css: Column) -> Column:
    """Addresses of url(...) in its three quoting forms."""
    found = F.regexp_extract_all(css, F.lit(r"(?i)url\(\s*(?:\"[^\"]*\"|'[^']*'|[^)\"']*)\s*\)"), 0)
    return F.transform(found, lambda u: strip(F.regexp_replace(F.regexp_replace(u, r"(?i)^url\(\s*[\"']?", ""), r"[\"']?\s*\)$", "")))


def srcset_urls(srcset: Column) -> Column:
    """The first word of each part of a srcset."""
    return F.filter(F.transform(F.split(srcset, ",", -1), lambda p: F.split(strip(p), r"\s+")[0]), lambda u: u != "")


def sanitize_html(pages: DataFrame, policy: str = "default-src 'none'; img-src data:; style-src 'unsafe-inline'") -> DataFrame:
    """Pages without meta refresh and with a content security policy first in their head."""
    meta = f'<meta http-equiv="Content-Security-Policy" content="{policy}">'
    clean = F.regexp_replace("html", r"(?i)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh[\"']?[^>]*>", "")
    first = F.regexp_replace(clean, r"(?is)\A(.*?<head\b[^>]*>)", "$1" + meta)
    return pages.withColumn("html", F.when(clean.rlike("(?i)<head[\\s>]"), first).otherwise(F.concat(F.lit(meta), clean)))


#: What a page consists of: comments, scripts and styles with their content, tags, text.
_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|</?[a-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<"
#: Attributes that name a file, of elements that can show an image and of others.
IMAGE_ATTRIBUTES = {"img": ("src", "srcset"), "source": ("src", "srcset"), "video": ("poster",), "input": ("src",)}
OTHER_ATTRIBUTES = {"video": ("src",), "audio": ("src",), "iframe": ("src",), "embed": ("src",), "object": ("data",)}
#: The codes of problems of a page and its stylesheets.
PROBLEMS = {"external": "external-resource", "missing": "missing-resource", "unsupported": "unsupported-resource", "import": "css-import"}


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute; empty without a value, null where the tag lacks it."""
    at = rf"(?is)^<[^\s>]+(?:[^\"'>]|\"[^\"]*\"|'[^']*')*?\s{name}(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)|(?=[\s/>]))"
    return F.when(tag.rlike(at), F.regexp_replace(F.regexp_extract(tag, at, 1), r"^[\"']|[\"']$", ""))


def page_elements(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with (line, name, tag, content) of the elements' opening tags; content is a script's or a style's.

    Tags follow patterns and not a DOM: nothing inside a comment, script or style is a tag.
    """
    pieces = pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(F.regexp_extract_all("html", F.lit(_MARKUP), 0)).alias("n", "piece"))
    w = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("piece") - F.length(F.replace("piece", F.lit("\n")))
    name = F.lower(F.regexp_extract("piece", r"^<([A-Za-z][A-Za-z0-9-]*)", 1))
    opening = r"(?s)^<(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>"
    tag = F.regexp_extract("piece", opening, 0)
    out = pieces.withColumn("line", (1 + F.coalesce(F.sum(breaks).over(w), F.lit(0))).cast("int")).withColumns({"name": name, "tag": tag})
    content = F.when(F.col("name").isin("script", "style"), F.regexp_replace(F.substring("piece", F.length("tag") + 1, F.length("piece")), r"(?is)</(?:script|style)\s*>$", ""))
    return out.where("name <> ''").withColumn("content", content).drop("piece", "n")


_FACT = "array<struct<what:string,line:int,ref:string,images:boolean>>"


def _fact(what: str, line: Column, ref: Column | None = None, images: bool = False) -> Column:
    said = F.lit(None).cast("string") if ref is None else ref
    return F.struct(F.lit(what).alias("what"), line.cast("int").alias("line"), said.alias("ref"), F.lit(images).alias("images"))


def css_facts(css: Column, first: Column) -> Column:
    """Facts of a stylesheet that begins on line ``first``: what it refers to, and its first import."""
    rows = F.split(css, "\n", -1)
    refs = F.flatten(F.transform(rows, lambda row, i: F.transform(css_urls(row), lambda u: _fact("ref", first + i, u, True))))
    imports = F.filter(F.transform(rows, lambda row, i: F.when(row.rlike(r"(?i)@import\b"), _fact("import", first + i))), lambda f: f.isNotNull())
    return F.concat(refs, F.slice(imports, F.lit(1), F.lit(1))).cast(_FACT)


def page_facts(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with (what, line, ref, images): scripts, noscripts, links of stylesheets, references and imports, from one pass over the elements."""
    elements = page_elements(pages)
    tag, name, line = F.col("tag"), F.col("name"), F.col("line")
    none = F.array().cast(_FACT)
    only = lambda condition, fact: F.when(condition, F.array(fact)).otherwise(none)
    handler = tag.rlike(r"(?is)^<[^\s>]+(?:[^\"'>]|\"[^\"]*\"|'[^']*')*?\son[a-z]+\s*=")
    rel = F.split(F.lower(F.coalesce(attribute(tag, "rel"), F.lit(""))), r"\s+")
    facts = [only((name == "script") | handler, _fact("script", line)), only(name == "noscript", _fact("noscript", line))]
    facts.append(F.when(name == "link", only(F.array_contains(rel, "stylesheet"), _fact("link", line, F.coalesce(attribute(tag, "href"), F.lit(""))))).otherwise(none))
    for images, attributes in ((True, IMAGE_ATTRIBUTES), (False, OTHER_ATTRIBUTES)):
        for element, names in attributes.items():
            for a in names:
                value = attribute(tag, a)
                refs = srcset_urls(value) if a == "srcset" else F.array(value)
                facts.append(F.when(name == element, F.coalesce(_as_refs(F.filter(refs, lambda r: r.isNotNull()), line, images), none)).otherwise(none))
    begins = line + F.length("tag") - F.length(F.replace("tag", F.lit("\n")))
    facts.append(F.when((name == "style") & (F.col("content") != ""), css_facts(F.col("content"), begins)).otherwise(none))
    style = attribute(tag, "style")
    inline = F.transform(css_urls(style), lambda u: _fact("ref", line, u, True))
    facts.append(F.when(F.contains(F.lower(tag), F.lit("style")), F.coalesce(F.concat(inline, only(style.rlike(r"(?i)@import\b"), _fact("import", line))), none)).otherwise(none))
    kept = [c for c in pages.columns if c != "html"]
    return elements.select(*kept, F.explode(F.concat(*[f.cast(_FACT) for f in facts])).alias("f")).select(*kept, "f.*")


def _as_refs(refs: Column, line: Column, images: bool) -> Column:
    return F.transform(refs, lambda r: _fact("ref", line, r, images))


def reference_problems(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (bundle_id, structured, base, ref, images) with ``problem``: external, missing or unsupported; shown ones are left out."""
    known = refs.withColumn("c", classify_reference(F.col("ref"), F.col("base"))).where("c.kind <> 'inline'").withColumns({"path": F.col("c.path"), "kind": F.col("c.kind")}).drop("c")
    found = resolve_references(known, files)
    shown = F.col("images") & (file_kind(F.col("resolved")) == "image")
    problem = F.when(F.col("kind") == "external", "external").when(F.col("resolved").isNull(), "missing").when(~shown, "unsupported")
    return found.withColumn("problem", problem).where("problem is not null")


def lint_pages(pages: DataFrame, files: DataFrame, css: DataFrame) -> DataFrame:
    """(page_id, code, lines) of what a page shows otherwise than its author expects.

    pages: page_id, bundle_id, structured, base (its folder), html; files: bundle_id, path; css: bundle_id,
    path, text. Codes: script (and handlers), noscript, stylesheet-missing, external-, missing- and
    unsupported-resource, css-import; of a stylesheet of the page's bundle its problem with its path behind
    a colon, and unreferenced-stylesheet:<path>, without lines, where no link of the page names it.
    """
    spark, columns = pages.sparkSession, ("page_id", "bundle_id", "structured", "base")
    own = pages.select(*columns)
    # The pages are read once; what was found in them is a small table that all codes read.
    path = f"{shared_folder(spark)}/page-facts-{uuid.uuid4().hex}"
    facts = page_facts(pages.select(*columns, "html"))
    facts.write.parquet(path)
    facts = spark.read.schema(facts.schema).parquet(path)
    hrefs = facts.where("what = 'link'").withColumn("path", classify_reference(F.col("ref"), F.col("base"))["path"])
    linked = resolve_references(hrefs, css.select("bundle_id", "path"))
    problems = reference_problems(facts.where("what = 'ref'").drop("what"), files)

    sheets = own.join(css.select("bundle_id", F.col("path").alias("sheet")), "bundle_id")
    folder = F.regexp_replace("sheet", "/?[^/]*$", "")
    sheet_facts = css.select("bundle_id", F.col("path").alias("sheet"), F.explode(css_facts(F.col("text"), F.lit(1))).alias("f")).select("bundle_id", "sheet", "f.*")
    of_bundle = sheet_facts.join(own.select("bundle_id", "structured").distinct(), "bundle_id").withColumn("base", folder)
    of_sheets = reference_problems(of_bundle.where("what = 'ref'").drop("what"), files).select("bundle_id", "structured", "sheet", "line", "problem")
    of_sheets = of_sheets.unionByName(of_bundle.where("what = 'import'").select("bundle_id", "structured", "sheet", "line", F.lit("import").alias("problem")))
    # Lines of a stylesheet are gathered once for its bundle, and only then go to the bundle's pages.
    of_sheets = of_sheets.groupBy("bundle_id", "structured", F.concat("problem", F.lit(":"), "sheet").alias("code")).agg(F.sort_array(F.collect_set("line")).alias("lines"))
    of_sheets = of_sheets.join(own.select("page_id", "bundle_id", "structured").distinct(), ["bundle_id", "structured"]).select("page_id", "code", "lines")

    row = lambda df, code, line="line": df.select("page_id", code.alias("code"), F.col(line).cast("int").alias("line"))
    named = F.create_map(*[F.lit(x) for kv in PROBLEMS.items() for x in kv])
    plain = facts.where("what in ('script', 'noscript', 'import')")
    found = [
        row(plain, F.when(F.col("what") == "import", "css-import").otherwise(F.col("what"))), row(linked.where("resolved is null"), F.lit("stylesheet-missing")),
        row(problems, F.try_element_at(named, F.col("problem"))),
    ]
    lines = reduce(DataFrame.unionByName, found).groupBy("page_id", "code").agg(F.sort_array(F.collect_set("line")).alias("lines")).unionByName(of_sheets)
    used = linked.where("resolved is not null").select("page_id", F.col("resolved").alias("sheet")).distinct()
    unused = sheets.select("page_id", "sheet").distinct().join(used, ["page_id", "sheet"], "left_anti")
    return lines.unionByName(unused.select("page_id", F.concat(F.lit("unreferenced-stylesheet:"), "sheet").alias("code"), F.array().cast("array<int>").alias("lines")))


def count_markup(pages: DataFrame) -> DataFrame:
    """(page_id, code, count) by patterns over tags and attributes (not a DOM): scripts and handlers, noscript, stylesheets elsewhere, imports."""
    html = F.col("html")
    counts = {
        "script": F.regexp_count(html, F.lit(r"(?i)<script[\s>]")) + F.regexp_count(html, F.lit(r"(?i)<[a-z][^<>]*\son[a-z]+\s*=")),
        "noscript": F.regexp_count(html, F.lit(r"(?i)<noscript[\s>]")),
        "external-css": F.regexp_count(html, F.lit(r"(?i)<link\b[^>]*href\s*=\s*[\"']?(?:https?:)?//")),
        "import": F.regexp_count(html, F.lit(r"(?i)@import\b")),
    }
    rows = F.array(*[F.struct(F.lit(c).alias("code"), n.cast("long").alias("count")) for c, n in counts.items()])
    return pages.select("page_id", F.explode(F.filter(rows, lambda r: r["count"] > 0)).alias("r")).select("page_id", "r.code", "r.count")
