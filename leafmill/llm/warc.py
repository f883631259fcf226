"""WARC (5): archives written and read as a chunked record table.

Writing: payloads leave the JVM as rows (record, chunk number, chunk of at most ``chunk_bytes``), so
that no Python task holds a whole record. Of records with equal payloads of at least
``revisit_bytes`` bytes (equal SHA-1, SHA-256 and length) that with the largest page_id is a
``response``; the others are ``revisit`` records that refer to it and carry no payload. The largest
ids come from an aggregate that combines before its shuffle; a payload that a third of all pages
share is a join that AQE splits.

Each record is a gzip member of its own. Archives are written under names that no other attempt
uses; the table of archives, which Spark commits, names those that count.

Reading: ``read_chunks`` streams the archives as rows (record, chunk number, chunk, and the length
and SHA-1 of the payload so far); a record's last row has its whole digest, checked against its header.

Defined cases: null html is an empty payload; a null url is written without a target; a null page_id
is written as an empty record name and read back as null; rows that repeat page_id and payload are
written each, and are responses if that page_id is the largest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table, written
from .token_files import opened

CHUNK_BYTES = 64 << 10
REVISIT_BYTES = 1000
#: A fixed capture date, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CHUNKS = (
    "page_id long, record_id string, record_type string, refers_to long, declared_bytes long, declared_digest string, "
    "chunk_no int, chunk binary, bytes_so_far long, sha1_so_far string, is_last boolean"
)
_NAME = "urn:page:"


def with_record_types(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary), its length and digest, record_type and refers_to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256)}
    )
    keys = ["sha1", "sha256", "payload_bytes"]
    shared = (
        rows.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy(*keys)
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("keeper"))
        .where("copies > 1 and keeper is not null")
        .drop("copies")
    )
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.join(shared, keys, "left").select(
        "page_id", "url", "payload", "payload_bytes", "sha1",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def _head(r) -> bytes:
    """The WARC header and the HTTP header of a record; the payload follows in responses."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    revisit = r.record_type == "revisit"
    fields = [
        ("WARC-Type", r.record_type),
        ("WARC-Record-ID", f"<{_NAME}{'' if pd.isna(r.page_id) else int(r.page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if r.url is None else quote(r.url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{r.sha1}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{_NAME}{int(r.refers_to)}>" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else r.payload_bytes))),
    ]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"", b""]) + http


def write_archives(records: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write typed records as .warc.gz archives, one for each partition that has rows; returns the table of archives."""
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    last = F.when(F.col("record_type") == "revisit", 0).otherwise(F.greatest(F.lit(0), F.ceil(F.col("payload_bytes") / chunk_bytes).cast("int") - 1))
    chunk = F.when(F.col("record_type") == "response", F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    rows = (
        records.withColumn("last", last)
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("page_id", "url", "payload_bytes", "sha1", "record_type", "refers_to", "chunk_no", "last", chunk.alias("chunk"))
    )

    def write(batches):
        fs, root = opened(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, press, n = None, None, 0
        for pdf in batches:
            if out is None and len(pdf):
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            for r in pdf.itertuples(index=False):
                if r.chunk_no == 0:
                    press, n = zlib.compressobj(1, zlib.DEFLATED, 31), n + 1
                    out.write(press.compress(_head(r)))
                if r.chunk is not None:
                    out.write(press.compress(r.chunk))
                if r.chunk_no == r.last:
                    out.write(press.compress(b"\r\n\r\n") + press.flush())
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n]})

    return written(rows.mapInPandas(write, "path string, records long"), "archives")


class _Members:
    """The bytes of a file of gzip members, streamed."""

    def __init__(self, raw, step: int = 1 << 16):
        self.raw, self.step, self.buffer, self.press, self.rest = raw, step, bytearray(), None, b""

    def _more(self) -> bool:
        data = self.rest or self.raw.read(self.step)
        self.rest = b""
        if not data:
            return False
        self.press = self.press or zlib.decompressobj(31)
        self.buffer += self.press.decompress(data, self.step)
        if self.press.eof:
            self.rest, self.press = self.press.unused_data, None
        else:
            self.rest = self.press.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes to a mark and with it; b"" at the end of the file."""
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends within a header")
                return b""
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _page(name: str | None) -> int | None:
    tail = (name or "").strip("<>").removeprefix(_NAME)
    return int(tail) if tail else None


def records_of(raw, chunk_bytes: int):
    """Rows of the chunked record table for one archive; at most a chunk of a record is held."""
    data = _Members(raw)
    while head := data.until(b"\r\n\r\n"):
        f = _fields(head)
        http = data.until(b"\r\n\r\n")
        left = int(f["content-length"]) - len(http)
        declared, digest = int(_fields(http)["content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
        same = (_page(f["warc-record-id"]), f["warc-record-id"], f["warc-type"], _page(f.get("warc-refers-to")), declared, digest)
        if f["warc-type"] == "revisit":
            yield (*same, 0, None, declared, digest, True)
        else:
            sha, done, k = hashlib.sha1(), 0, 0
            while True:
                chunk = data.take(min(chunk_bytes, left - done))
                sha.update(chunk)
                done += len(chunk)
                if done == left and sha.hexdigest() != digest:
                    raise ValueError(f"{f['warc-record-id']}: the payload's digest is not that of its header")
                yield (*same, k, chunk, done, sha.hexdigest(), done == left)
                if done == left:
                    break
                k += 1
        if data.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read_chunks(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives."""
    columns = [x.split()[0] for x in _CHUNKS.split(", ")]

    def read(batches):
        for pdf in batches:
            for uri in pdf.path:
                fs, path = opened(uri)
                with fs.open_input_stream(path, compression=None) as raw:
                    rows, size = [], 0
                    for row in records_of(raw, chunk_bytes):
                        rows.append(row)
                        size += len(row[7] or b"") + 200
                        if size > 4 << 20:
                            yield _frame(rows, columns)
                            rows, size = [], 0
                    if rows:
                        yield _frame(rows, columns)

    n = max(1, archives.count())
    return archives.select("path").repartition(n, "path").mapInPandas(read, _CHUNKS)


def _frame(rows, columns) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=columns)
    return pdf.assign(page_id=pdf.page_id.astype("Int64"), refers_to=pdf.refers_to.astype("Int64"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = write_archives(with_record_types(table(spark, folder, "pages")), new_path(spark, "warc"))
    return read_chunks(archives).where("is_last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to"
    )


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
k as (select html, max(page_id) as keeper from p where n >= 1000 group by html having count(*) > 1)
select page_id, cast(n as bigint) as payload_bytes, sha1(p.html) as payload_digest,
  case when keeper is not null and keeper <> page_id then 'revisit' else 'response' end as record_type,
  case when keeper is not null and keeper <> page_id then keeper end as refers_to
from p left join k on p.html = k.html
"""
