"""Reading the given tables, and the expressions that several operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that a task takes at most, on average, of a table that is dealt by a key.
PART_ROWS = 1 << 18


def dealt(df: DataFrame, key: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows partitioned by a key, in parts of about ``part_rows``; as they are where the session's own number of partitions gives smaller ones."""
    parts = -(-df.count() // part_rows)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def strip(c: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, line): the lines of each text, numbered from 1."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which a cluster names in ``spark.checkpoint.dir``; in local mode one is made where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")
