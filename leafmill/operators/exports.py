"""Writing files from tables: planned as whole exports, staged under names that count only once Spark has committed them, reported file by file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill import folders
from leafmill.folders import opened as _opened
from leafmill.operators import bundles
from leafmill.tables import shared_folder

REPORT = "export_id string, path string, staged string, bytes long, error string"


def existing_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path): the files under a folder, by their path in it."""
    files, root = _opened(folder)
    if files.get_file_info(root).type.name == "NotFound":
        return spark.createDataFrame([], "path string")
    found = folders.listed(spark, folder).select("path")
    plain = F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    inside = root.rstrip("/") + "/"
    return found.select(F.substring(plain, F.position(F.lit(inside), plain) + len(inside), F.length(plain)).alias("path"))


def _staged(planned: DataFrame, staging: str) -> DataFrame:
    """Write each file under a name of its own and say which; a failure is its row's error."""

    def write(batches):
        import pandas as pd

        files, root = _opened(staging)
        for pdf in batches:
            rows = []
            for export_id, path, content in zip(pdf.export_id, pdf.path, pdf.content):
                name = f"{root}/{uuid.uuid4().hex}"
                try:
                    with files.open_output_stream(name) as out:
                        out.write(bytes(content))
                    rows.append((export_id, path, name, len(content), None))
                except (OSError, TypeError) as e:  # null content, a full or closed disk: this file's failure, not the export's
                    rows.append((export_id, path, None, 0, str(e)[:300]))
            yield pd.DataFrame(rows, columns=["export_id", "path", "staged", "bytes", "error"])

    return planned.select(F.col("export_id").cast("string").alias("export_id"), "path", "content").mapInPandas(write, REPORT)


def _placed(manifest: DataFrame, folder: str) -> DataFrame:
    """Move the files that the manifest names to their paths; one that was moved by an attempt before stays where it is."""

    def place(batches):
        import pandas as pd

        files, root = _opened(folder)
        for pdf in batches:
            rows, made = [], set()
            for export_id, path, staged, size, error in pdf.itertuples(index=False):
                if error is None:
                    target = f"{root}/{path}"
                    try:
                        if files.get_file_info(staged).type.name == "NotFound":
                            if files.get_file_info(target).size != size:
                                raise OSError(f"{staged} is gone")
                        else:
                            if (parent := target.rsplit("/", 1)[0]) not in made:
                                files.create_dir(parent, recursive=True)
                                made.add(parent)
                            files.move(staged, target)
                    except OSError as e:
                        error = str(e)[:300]
                rows.append((export_id, path, staged, size, error))
            yield pd.DataFrame(rows, columns=["export_id", "path", "staged", "bytes", "error"])

    return manifest.mapInPandas(place, REPORT)


def write_exports(outputs: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Write outputs (export_id, path, content) under a folder and return (export_id, path, decision, written, bytes, error), a row for each.

    An export is written whole or not begun: one with an unusable name, or with a file that is there already unless ``overwrite``, is
    refused before its first byte, as is a path that comes twice. Every file is first written under a name that no other attempt
    uses; a table that Spark commits names those that count; then they are moved into place, so nobody sees half a file. A
    file that fails is a row with its error, and the others are written.
    """
    spark = outputs.sparkSession
    run = uuid.uuid4().hex
    files, root = _opened(folder)
    staging = f"{root}/.staged-{run}"
    files.create_dir(staging, recursive=True)
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    planned = bundles.plan_exports(outputs, existing_files(spark, folder), overwrite)
    kept = f"{shared_folder(spark)}/exports-{run}"
    planned.withColumn("twice", F.count("*").over(Window.partitionBy("path")) > 1).drop("content").write.parquet(f"{kept}/plan")
    plan = spark.read.parquet(f"{kept}/plan")
    twice = plan.where("twice").select(F.col("export_id").alias("_id")).distinct().withColumn("_twice", F.lit(True))
    decision = F.when((F.col("decision") == "write") & F.col("_twice"), "reject").otherwise(F.col("decision"))
    plan = plan.join(twice, F.col("export_id").eqNullSafe(F.col("_id")), "left").withColumn("decision", decision).drop("_id", "_twice", "twice")
    plan.where("decision <> 'write'").select("export_id").distinct().write.parquet(f"{kept}/refused")
    refused = spark.read.schema(plan.select("export_id").schema).parquet(f"{kept}/refused")
    chosen = outputs.where("export_id is not null and path is not null").join(refused, "export_id", "left_anti")
    chosen = chosen.repartition(4 * spark.sparkContext.defaultParallelism, "path")
    _staged(chosen, scheme + staging).write.parquet(f"{kept}/manifest")
    _placed(spark.read.parquet(f"{kept}/manifest"), folder).write.parquet(f"{kept}/report")
    files.delete_dir(staging)
    done = spark.read.parquet(f"{kept}/report").select(F.col("export_id").alias("_id"), F.col("path").alias("_path"), "bytes", "error")
    joined = plan.join(done, (F.col("export_id").cast("string") == F.col("_id")) & (F.col("path") == F.col("_path")), "left")
    written = (F.col("decision") == "write") & F.col("_path").isNotNull() & F.col("error").isNull()
    return joined.select("export_id", "path", "decision", written.alias("written"), F.when(written, F.col("bytes")).otherwise(0).alias("bytes"), "error")
