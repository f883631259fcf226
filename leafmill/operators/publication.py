"""Versions of sets of tables: commits that only one writer can win, and snapshots that readers hold on to.

A folder of published tables holds ``data``, where each table's parts lie under names that nobody else uses,
and ``commits``, a small JSON file for each version: the parts of every table of the set, and notes. A writer puts its
parts in place first and then creates the file of the next number, which fails if that is there already (a hard link on local
disks, a rename that does not overwrite on others; the store must offer one of them). The loser's change is computed again from the winner's version,
so that no change is lost. Readers take one commit, and with it one version of all tables. Parts that no commit names are never read.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has taken the next number."""


@dataclass(frozen=True)
class Snapshot:
    """One version of a set of tables; number 0 is the empty set."""

    folder: str
    number: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    note: dict = field(default_factory=dict)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.schemas:
            raise FileNotFoundError(f"no table {name} in version {self.number} of {self.folder}")
        schema = StructType.fromJson(self.schemas[name])
        return spark.read.schema(schema).parquet(*self.parts[name]) if self.parts[name] else spark.createDataFrame([], schema)


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _local(path: str) -> str | None:
    url = urlparse(path)
    return unquote(url.path) if url.scheme in ("", "file") else None


def _listed(spark: SparkSession, folder: str) -> list:
    files, at = hadoop_path(spark, folder)
    return list(files.listStatus(at)) if files.exists(at) else []


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    names = [f.getPath().getName() for f in _listed(spark, f"{folder}/commits")]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def snapshot(spark: SparkSession, folder: str, number: int | None = None) -> Snapshot:
    """The newest version, or that of a number; what is read from it stays the same whatever is published meanwhile."""
    if number is None:
        number = max(_numbers(spark, folder), default=0)
    if number == 0:
        return Snapshot(folder)
    files, at = hadoop_path(spark, f"{folder}/commits/{number:012d}.json")
    stream = files.open(at)
    try:
        said = json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()
    return Snapshot(folder, number, said["parts"], said["schemas"], said["note"])


def _create(spark: SparkSession, path: str, content: bytes) -> None:
    """Create a file with all its content, or raise Conflict if it is there."""
    folder, name = path.rsplit("/", 1)
    waiting = f"{folder}/.{name}-{uuid.uuid4().hex}"
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(_local(waiting), "wb") as f:
            f.write(content)
            os.fsync(f.fileno())
        try:
            os.link(_local(waiting), local)
        except FileExistsError:
            raise Conflict(path) from None
        finally:
            os.unlink(_local(waiting))
        return
    files, at = hadoop_path(spark, waiting)
    out = files.create(at, False)
    out.write(content)
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(at, hadoop.Path(path), none)
    except Exception as e:
        files.delete(at, False)
        if files.exists(hadoop.Path(path)):
            raise Conflict(path) from e
        raise


def commit(spark: SparkSession, base: Snapshot, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, note: dict | None = None) -> Snapshot:
    """Publish the version after ``base``: some tables replaced whole, some with a further part, all others as they were.

    Raises Conflict if the number is taken; nothing of this change is then visible.
    """
    parts, schemas = {t: list(p) for t, p in base.parts.items()}, dict(base.schemas)
    for whole, tables in ((True, replaced or {}), (False, appended or {})):
        for name, df in tables.items():
            path = f"{base.folder}/data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            parts[name] = [path] if whole else [*parts.get(name, []), path]
            schemas[name] = schemas[name] if not whole and name in schemas else df.schema.jsonValue()
    new = Snapshot(base.folder, base.number + 1, parts, schemas, {**base.note, **(note or {})})
    said = {"parts": new.parts, "schemas": new.schemas, "note": new.note}
    _create(spark, f"{base.folder}/commits/{new.number:012d}.json", json.dumps(said).encode())
    return new


def update(spark: SparkSession, folder: str, change: Callable[[Snapshot], dict | None], retries: int = 20) -> Snapshot:
    """Publish ``change`` of the newest version: the arguments of ``commit``, or None where there is nothing to do.

    When another writer comes first, the change is computed again from that writer's version.
    """
    for _ in range(retries + 1):
        base = snapshot(spark, folder)
        if (what := change(base)) is None:
            return base
        try:
            return commit(spark, base, **what)
        except Conflict as e:
            lost = e
    raise lost


def vacuum(spark: SparkSession, folder: str, keep: int = 2, older_than: float = 24.0) -> list[str]:
    """Remove versions before the last ``keep``, and data that no version left names and that is ``older_than`` hours old; what was removed."""
    numbers = _numbers(spark, folder)
    kept = [snapshot(spark, folder, n) for n in numbers[-keep:]]
    named = {p.rsplit("/", 1)[1] for s in kept for paths in s.parts.values() for p in paths}
    gone = [f"{folder}/commits/{n:012d}.json" for n in numbers[:-keep]]
    before = (time.time() - older_than * 3600) * 1000
    gone += [f"{folder}/data/{f.getPath().getName()}" for f in _listed(spark, f"{folder}/data") if f.getPath().getName() not in named and f.getModificationTime() <= before]
    for path in gone:
        files, at = hadoop_path(spark, path)
        files.delete(at, True)
    return gone
