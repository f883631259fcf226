"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; without it this is an error there. Only in local
    mode (tests, one machine) a temporary folder is made where it is unset, and set for checkpoints too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Intermediate tables of this driver that are still there.
_TABLES: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Lineage ends here, and a lost executor costs no more than the tasks that it was running. The table
    goes by ``discard``, by ``remove_tables``, or when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if not _TABLES:
        atexit.unregister(remove_tables)
        atexit.register(remove_tables)
    _TABLES.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove intermediate tables that nothing reads any more."""
    _remove([t.written_to for t in tables])


def remove_tables() -> None:
    """Remove all intermediate tables; results that were not saved by then can no longer be read."""
    _remove(list(_TABLES))


def _remove(paths: list[str]) -> None:
    _TABLES.difference_update(paths)
    spark = SparkSession.getActiveSession()
    if not paths or spark is None or spark.sparkContext._jsc is None:
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text has the remainder that marks evaluation rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def megabytes_of(batch, most: int = 1 << 20):
    """Cut a sequence of texts into slices of about ``most`` characters: (start, stop)."""
    start, size = 0, 0
    for i, text in enumerate(batch):
        size += len(text or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(batch):
        yield start, len(batch)
