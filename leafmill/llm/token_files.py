"""Token-ID output (10): files of separately compressed id arrays under one trained zstandard dictionary.

A dataset folder holds ``dictionary-<sha256>.zdict`` and shard files. A shard is

    8 bytes  magic ``LMTOK001``
    32 bytes SHA-256 of the dictionary
    frames   one zstandard frame for each document: its ids, little-endian unsigned 32 bit
    index    for each document 40 bytes, little-endian: doc_id (q), null marker (q), frame's offset (Q),
             ids of the shard's documents before it (Q), number of ids (Q)
    16 bytes index offset (Q), number of documents (Q)

so that one short document is read by the index and one frame. Documents stand in ascending doc_id
order (null first; equal ids by their content) within and across shards.

The dictionary is fitted on a bounded sample (``sample_docs`` documents of at most
``sample_bytes`` each, those with the smallest hash of their id); every document is encoded and
written. Shards are written under names that no other attempt uses, and the table of shards, which
Spark commits, names those that count: a task that is run again leaves an unnamed file, not a wrong row.

Defined cases: a null or empty text is its end id alone; repeated rows and null ids are written
each; no documents give no shards; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table, written
from .encoding import encoder, packed

MAGIC = b"LMTOK001"
_ENTRY = "<qqQQQ"
_TAIL = "<QQ"
_SHARDS = "part int, path string, dictionary string, documents long, ids long, bytes long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def opened(uri: str):
    """The file system and path of a URI, for tasks and driver alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; where the samples are too few to train one, their own bytes serve."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def sample_ids(docs: DataFrame, path: str, sample_docs: int, sample_bytes: int) -> list[bytes]:
    """Id arrays of a bounded sample for the dictionary."""
    short = docs.where(F.octet_length("text").between(1, sample_bytes)).select("doc_id", "text")
    picked = short.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def encode(batches):
        for pdf in batches:
            yield pd.DataFrame({"ids": encoder(path).encode(list(pdf.text))})

    one = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of texts that repeat an id, one
    rows = one.select("text").mapInPandas(encode, "ids binary").collect()  # at most sample_docs rows
    return sorted(bytes(r.ids) for r in rows)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int | None = None,
    dictionary_bytes: int = 64 << 10, sample_docs: int = 500, sample_bytes: int = 32 << 10, level: int = 3,
) -> DataFrame:
    """Write the dataset and return the table of its shards, a row for each, in ascending order of ``part``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(sample_ids(docs, tokenizer_path, sample_docs, sample_bytes), dictionary_bytes)
    sha = hashlib.sha256(dictionary).hexdigest()
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary-{sha}.zdict") as f:
        f.write(dictionary)

    def encode(batches):
        import zstandard

        coder, end = encoder(tokenizer_path), packed([end_id])
        press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_dict_id=False)
        for pdf in batches:
            ids = [x + end for x in coder.encode(list(pdf.text))]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "n": [len(x) // 4 for x in ids], "frame": [press.compress(x) for x in ids]})

    # Written first, so that finding the ranges reads ids alone and encodes nothing twice.
    frames = written(docs.mapInPandas(encode, "doc_id long, n long, frame binary"), "token-frames")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = frames.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "n", "frame")

    def write(batches):
        fs, root = opened(folder)
        part = TaskContext.get().partitionId()
        name, out, index, at, before = f"shard-{part:06d}-{uuid.uuid4().hex}.tok", None, [], 40, 0
        for pdf in batches:
            if out is None and len(pdf):
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(MAGIC + bytes.fromhex(sha))
            for doc_id, n, frame in zip(pdf.doc_id.astype("Int64"), pdf.n, pdf.frame):
                out.write(frame)
                null = doc_id is pd.NA
                index.append(struct.pack(_ENTRY, 0 if null else doc_id, null, at, before, n))
                at, before = at + len(frame), before + n
        if out is not None:
            for entry in index:
                out.write(entry)
            out.write(struct.pack(_TAIL, at, len(index)))
            out.close()
            size = at + len(index) * struct.calcsize(_ENTRY) + struct.calcsize(_TAIL)
            yield pd.DataFrame([(part, f"{folder}/{name}", sha, len(index), before, size)], columns=[x.split()[0] for x in _SHARDS.split(", ")])

    return written(ordered.mapInPandas(write, _SHARDS), "token-shards")


class Shard:
    """One shard file: its index, and documents by their place in it."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read_at(40, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        with fs.open_input_file(f"{path.rpartition('/')[0]}/dictionary-{head[8:].hex()}.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != head[8:]:
            raise ValueError(f"the dictionary of {uri} has been changed")
        self.press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        size = self.file.size()
        self.index_at, n = struct.unpack(_TAIL, self.file.read_at(16, size - 16))
        raw = self.file.read_at(n * struct.calcsize(_ENTRY), self.index_at)
        self.index = np.frombuffer(raw, dtype="<i8").reshape(n, 5)

    def _begin(self, k: int) -> int:
        return int(self.index[k, 2]) if k < len(self.index) else self.index_at

    def ids(self, k: int) -> bytes:
        return next(self.run(k, k + 1))

    def run(self, a: int, b: int):
        """The ids of the documents a .. b - 1, by one read of their frames."""
        start = self._begin(a)
        raw = memoryview(self.file.read_at(self._begin(b) - start, start))
        for k in range(a, b):
            frame = raw[self._begin(k) - start : self._begin(k + 1) - start]
            yield self.press.decompress(frame, max_output_size=4 * int(self.index[k, 4]))

    def runs(self, most: int = 1 << 22):
        """(a, b) of consecutive documents whose frames have about ``most`` bytes, or of one document."""
        a = 0
        while a < len(self.index):
            b = a + 1
            while b < min(len(self.index), a + 1000) and self._begin(b + 1) - self._begin(a) <= most:
                b += 1
            yield a, b
            a = b

    def close(self):
        self.file.close()


def read_token_files(shards: DataFrame) -> DataFrame:
    """A row for each document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    based = shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def read(batches):
        for pdf in batches:
            for uri, base in zip(pdf.path, pdf.base):
                shard = Shard(uri)
                for a, b in shard.runs():
                    index = shard.index[a:b]
                    ids = list(shard.run(a, b))
                    yield pd.DataFrame({
                        "doc_id": pd.array(index[:, 0], dtype="Int64").copy() if not index[:, 1].any() else pd.array([None if z else d for d, z in index[:, :2].tolist()], dtype="Int64"),
                        "start": index[:, 3] + base, "n_tokens": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids],
                    })
                shard.close()

    n = max(1, shards.count())
    return based.select("path", "base").repartition(n, "path").mapInPandas(read, _READ)


def read_documents(shards: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The ids of chosen documents (doc_id, ids array<long>), by each shard's index: other frames are not read.

    ``doc_ids`` must fit one task's memory; it is a request, not a corpus.
    """
    wanted = sorted(r[0] for r in doc_ids.select(F.col(doc_ids.columns[0]).cast("long")).distinct().collect() if r[0] is not None)

    def read(batches):
        for pdf in batches:
            for uri in pdf.path:
                shard = Shard(uri)
                at = np.flatnonzero((shard.index[:, 1] == 0) & np.isin(shard.index[:, 0], wanted))
                if len(at):
                    yield pd.DataFrame({"doc_id": shard.index[at, 0].copy(), "ids": [np.frombuffer(shard.ids(k), dtype="<u4").tolist() for k in at]})
                shard.close()

    return shards.select("path").mapInPandas(read, "doc_id long, ids array<long>")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return read_token_files(write_token_files(docs, new_path(spark, "token-files"), word_bpe_path(), end_id=2))
