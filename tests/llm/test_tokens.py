"""Packing (4) and token files (10) against the tokenizers library, document by document."""

import functools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from documents import awkward, empty, prose, rows, SCHEMA
from tokenizers import Tokenizer

from leafmill.llm import packing, token_files
from leafmill.llm.common import new_path
from leafmill.llm.encoding import Encoder


@functools.cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def ids_of(path, text, end):
    ids = tokenizer(path).encode(text or "", add_special_tokens=False).ids + [end]
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("path", [packing.byte_bpe_path(), token_files.word_bpe_path()])
def test_units_give_the_librarys_ids(path):
    texts = ["", "a  b", " a\n\nb ", "x\t y", "\r\n", "it's 5's x", "a  b", "é É", "ΟΔΟΣ ΟΔΟΣ.", "two  <|endoftext|>  x", "tab\tend\t", "\x1c a", "𝔘nicode ½ ²", "w" * 300, "Ünï Ŀ ŉ İ ſ x² 3½ — “q” it’S I'LL don't'T 'save", "a,b.c;d  e\n\n\nf 12ab34 \x00\x01 ª µ × ÷ €5", "é ê", "  lead", "end  ", " \n x", "A" * 70 + " bb", "a \n　b"]
    whole = [ids_of(path, t, 0)[:-4] for t in texts]
    coder = Encoder(path)
    assert coder.encode(texts) == whole
    assert coder.encode(texts) == whole  # now from the cache


def check_pieces(docs, pieces, end, window=1024):
    path = packing.byte_bpe_path()
    want = defaultdict(int)
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id, ids_of(path, r.text, end)] += 1
    by_id = defaultdict(list)
    seats = defaultdict(list)
    for p in pieces:
        by_id[p.doc_id].append(p)
        seats[p.sequence_id].append((p.offset, p.length))
    for seat in seats.values():
        at = 0
        for offset, length in sorted(seat):
            assert offset == at
            at += length
        assert at <= window
    for p in pieces:
        assert p.ids is None or (len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32)
    for (doc_id, ids), copies in want.items():
        mine = [p for p in by_id[doc_id] if p.doc_tokens == len(ids) // 4]
        covered = sorted((p.start, p.length) for p in mine)
        assert sum(n for _, n in covered) >= copies * len(ids) // 4
        assert sum(zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in mine) >= copies
    total = sum(len(i) // 4 * c for (_, i), c in want.items())
    assert sum(p.length for p in pieces) == total
    assert sorted(seats) == list(range(len(seats)))
    return total, len(seats)


def test_packing_covers_every_id_once(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame(rows([(100 + i, prose(5 + 37 * i % 900, i)) for i in range(120)]), SCHEMA)).repartition(3)
    table = packing.pack(docs, packing.byte_bpe_path())
    pieces = table.collect()
    total, sequences = check_pieces(docs, pieces, 0)
    assert sequences <= total / 1024 + 3 and all(p.ids for p in pieces)
    laid = {r.sequence_id: np.frombuffer(r.ids, dtype="<u4") for r in packing.sequences(table, 7).collect()}
    assert len(laid) == sequences
    for p in pieces:
        assert laid[p.sequence_id][p.offset : p.offset + p.length].tobytes() == p.ids
    for k, ids in laid.items():
        held = sum(p.length for p in pieces if p.sequence_id == k)
        assert len(ids) == (held if held & (held - 1) == 0 else 1024) and (ids[held:] == 7).all()
    bare = packing.pack(docs, packing.byte_bpe_path(), with_ids=False)
    check_pieces(docs, bare.collect(), 0)
    assert bare.where("ids is not null").count() == 0


def test_packing_when_all_lengths_are_equal(spark):
    docs = spark.createDataFrame(rows([(i, "same text here") for i in range(700)]), SCHEMA)
    pieces = packing.pack(docs, packing.byte_bpe_path(), bucket_tokens=1024).collect()
    check_pieces(docs, pieces, 0)


def test_packing_of_nothing(spark):
    assert packing.pack(empty(spark), packing.byte_bpe_path()).collect() == []


def test_least_squares_fills_a_known_histogram():
    parts = packing.combinations(16, 4)
    h = np.zeros(17)
    h[[10, 6]] = 100
    x = packing.least_squares(parts, h)
    assert (x >= 0).all()
    used = sum(np.bincount(parts[:, j], weights=x, minlength=17) for j in range(3))
    assert abs(used[10] - 100) < 1 and abs(used[6] - 100) < 1


def test_token_files_round_trip(spark):
    docs = awkward(spark).repartition(3)
    path = token_files.word_bpe_path()
    shards = token_files.write_token_files(docs, new_path(spark, "tok"), path, 2, shards=3)
    got = token_files.read_token_files(shards).orderBy("start").collect()
    ids = sorted(((r.doc_id is not None, r.doc_id or 0, ids_of(path, r.text, 2)) for r in docs.collect()), key=lambda x: (x[0], x[1], len(x[2])))
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(d if k else None, len(i) // 4, zlib.crc32(i)) for k, d, i in ids]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    one = token_files.read_documents(shards, spark.createDataFrame([(7,)], "doc_id long")).collect()
    want = next(i for k, d, i in ids if k and d == 7)
    assert [r.doc_id for r in one] == [7] and np.array(one[0].ids, dtype="<u4").tobytes() == want


def test_dictionary_sample_of_a_repeated_id(spark):
    docs = spark.range(300).selectExpr("7L as doc_id", "concat('text ', id) as text")
    assert len(token_files.sample_ids(docs, token_files.word_bpe_path(), 50, 1000)) == 1


@pytest.mark.parametrize("path", [packing.byte_bpe_path(), token_files.word_bpe_path()])
def test_ids_of_given_documents_and_of_all_characters(path):
    """The library's ids of every text of a table, and of each character of the first planes beside letters, digits and spaces."""
    import duckdb

    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3000, 0x20000, 97) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"{x}a{x} {x}{x}1 {x}" for x in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    assert Encoder(path).encode(texts) == [ids_of(path, t, 0)[:-4] for t in texts]


def test_token_files_of_nothing(spark):
    shards = token_files.write_token_files(empty(spark), new_path(spark, "tok"), token_files.word_bpe_path(), 2)
    assert token_files.read_token_files(shards).collect() == []
