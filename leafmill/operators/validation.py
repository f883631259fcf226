"""Checks of requests: queries, tags, file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import kernels
from leafmill.tables import strip

QUERY_CHARS = 2000
TAG_CHARS = 255
NAME_CHARS = 255
NAME_BYTES = 200
#: Names that a file system keeps for devices, and known extensions.
RESERVED = "CON PRN AUX NUL COM1 COM2 COM3 COM4 COM5 COM6 COM7 COM8 COM9 LPT1 LPT2 LPT3 LPT4 LPT5 LPT6 LPT7 LPT8 LPT9".split()
EXTENSIONS = "md|markdown|mdown|html|htm|xhtml|txt|pdf"


def validate_queries(requests: DataFrame) -> DataFrame:
    """Requests (query, top_k, tag) with query stripped, top_k 5 by default, a blank tag null, and error."""
    q, k = strip(F.coalesce("query", F.lit(""))), F.coalesce("top_k", F.lit(5))
    error = F.when(q == "", "blank").when(F.length(q) > QUERY_CHARS, "long").when(~k.between(1, 20), "top_k")
    tag = strip(F.col("tag"))
    return requests.withColumns({"error": error, "query": q, "top_k": k, "tag": F.when(tag != "", tag)})


def normalize_tags(rows: DataFrame) -> DataFrame:
    """Rows (raw) with tags in order, each once; a tag that is too long makes the row an error without tags."""
    tags = F.array_distinct(F.filter(F.transform(F.split("raw", "[,，、]", -1), strip), lambda t: t != ""))
    long = F.exists(tags, lambda t: F.length(t) > TAG_CHARS)
    return rows.withColumns({"tags": F.when(~long, tags), "error": F.when(long, "long")})


def normalize_file_names(rows: DataFrame) -> DataFrame:
    """Rows (raw) with the last segment as name, .md added where no extension is, or an error."""
    name = strip(F.element_at(F.split(F.replace("raw", F.lit("\\"), F.lit("/")), "/", -1), -1))
    full = F.when(name.rlike(r"\.[^.]+$"), name).otherwise(F.concat(name, F.lit(".md")))
    stem = strip(F.regexp_replace(full, r"\.[^.]*$", ""))
    error = F.when((name == "") | (stem == ""), "blank").when(F.length(full) > NAME_CHARS, "long")
    return rows.withColumns({"name": F.when(error.isNull(), full), "error": error})


def safe_base_names(rows: DataFrame) -> DataFrame:
    """Rows (raw) with a base name that any file system takes, of at most 200 UTF-8 bytes, else ``document``."""
    base = F.regexp_replace("raw", rf"(?i)\.(?:{EXTENSIONS})$", "")
    base = F.regexp_replace(strip(F.regexp_replace(base, r'[\\/:*?"<>|\x00-\x1f]', "_")), r"\.+$", "")

    def fitting(base):
        # Of the characters that begin within one byte more than fit, all but the last fit whole.
        begun = F.length(F.substring(base.cast("binary"), 1, NAME_BYTES + 1).cast("string"))
        return F.when(F.octet_length(base) <= NAME_BYTES, base).otherwise(F.left(base, begun - 1))

    cut = F.regexp_replace(strip(kernels.let(base, fitting)), r"\.+$", "")
    named = lambda cut: F.when((cut == "") | F.upper(F.regexp_extract(cut, r"^([^.]*)", 1)).isin(*RESERVED), "document").otherwise(cut)
    return rows.withColumn("base", kernels.let(cut, named))
