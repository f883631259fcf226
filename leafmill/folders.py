"""Folders of many small files: listed and read by tasks, so that the driver holds none of their names.

Spark's file sources list on the driver and plan every file there; of files by the million that is most of the time and of the
driver's memory. Stores that only Spark can open, patterns and single files are still left to them.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.tables import shared_folder

LISTED = "path string, modificationTime timestamp, length long"
_FOUND = "path string, folder boolean, modified long, length long"
#: Bytes of files that a task hands on at once, and names of a folder.
BATCH_BYTES, BATCH_NAMES = 16 << 20, 10_000


def opened(uri: str):
    """The file system and path of a URI, for tasks and driver alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _at(full: str):
    """As ``opened``, of an address as Spark writes it, without escapes."""
    return opened(quote(full, safe="/:@!$&'()*+,;=~"))


def _hidden(name: str) -> bool:
    """Whether Spark's file sources pass over a name."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name and not re.match("_(common_)?metadata", name)


def _tasks(df: DataFrame) -> DataFrame:
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def known(spark: SparkSession, path: str) -> str | None:
    """A folder's full address as Spark writes it, if tasks can list it; none for a pattern, a file or a store that they cannot open."""
    if re.search(r"[{}\[\]*?\\]", path):
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    try:
        files, root = _at(full)
        return full if files.get_file_info(root).type.name == "Directory" else None
    except (OSError, ValueError, KeyError, NotImplementedError):
        return None


def in_few_tasks(files: DataFrame) -> DataFrame:
    """Files in four tasks a core at most: Spark counts each file as 4 MB, so small ones by the thousand would be thousands of tasks in every scan."""
    return files.coalesce(4 * files.sparkSession.sparkContext.defaultParallelism)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Spark's own source of whole files."""
    return in_few_tasks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length): the files under a folder at any depth, without those that Spark's sources pass over, hidden or empty."""
    full = known(spark, path)
    if full is None:
        return binary_files(spark, path).select("path", "modificationTime", "length")

    def walk(batches):
        import pandas as pd
        from pyarrow import fs

        files, root = _at(full)
        for pdf in batches:
            for folder in pdf.path:
                found = [f for f in files.get_file_info(fs.FileSelector(root + folder[len(full) :], allow_not_found=True)) if not _hidden(f.base_name)]
                rows = [(f"{folder.rstrip('/')}/{f.base_name}", f.type.name == "Directory", (f.mtime_ns or 0) // 1_000_000, f.size or 0) for f in found]
                for i in range(0, len(rows), BATCH_NAMES):
                    yield pd.DataFrame(rows[i : i + BATCH_NAMES], columns=["path", "folder", "modified", "length"])

    kept, parts = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}", []
    level = spark.createDataFrame([(full,)], "path string").coalesce(1)
    while not parts or not level.isEmpty():  # one level of folders after the other
        parts.append(f"{kept}/{len(parts)}")
        level.mapInPandas(walk, _FOUND).write.parquet(parts[-1])
        level = _tasks(spark.read.schema(_FOUND).parquet(parts[-1]).where("folder").select("path"))
    found = spark.read.schema(_FOUND).parquet(*parts).where("not folder and length > 0")
    return found.select("path", F.timestamp_millis("modified").alias("modificationTime"), "length")


def contents(listing: DataFrame, full: str) -> DataFrame:
    """A listing (path, modificationTime, length) of a folder, by its full address, with content."""

    def read(batches):
        import pyarrow as pa

        files, root = _at(full)

        def content(path):
            with files.open_input_file(root + path[len(full) :]) as f:
                return f.read()

        for batch in batches:
            paths, lengths, start, size = batch.column("path").to_pylist(), batch.column("length").to_pylist(), 0, 0
            for i, length in enumerate(lengths, 1):
                size += length
                if size >= BATCH_BYTES or i == len(lengths):
                    read_now = pa.array([content(p) for p in paths[start:i]], pa.binary())
                    part = batch.slice(start, i - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, read_now], names=[*part.schema.names, "content"])
                    start, size = i, 0

    return _tasks(listing.select("path", "modificationTime", "length")).mapInArrow(read, f"{LISTED}, content binary")


def stored(spark: SparkSession, path: str, where: str = "true") -> DataFrame:
    """(path, modificationTime, length, content): the files under a folder of which a condition on the first three holds; no other is opened."""
    full = known(spark, path)
    return binary_files(spark, path).where(where) if full is None else contents(listed(spark, path).where(where), full)
