"""Language ID (1): unigram pieces with all segmentations summed.

For each language a probability for every piece of a fixed public vocabulary; the probability of a
word is the sum over all its segmentations into pieces (a forward pass), that of a text the product
over its words. Words are runs of letters in lower case with the vocabulary's word mark in front; the
pieces never cross them, so a text's score is exactly the sum over its words, and a word that was seen
before is looked up.

Learning is expectation maximisation over word counts. The counts cover all training documents; they
are combined within each task before the shuffle and written to the shared folder. The expected piece
counts of one pass go to the driver as (language, piece) rows, at most languages x vocabulary (32,000
pieces; 128 kB a language), which also bounds the model that the executors get: it grows with the
number of languages, not with the documents.

Characters outside the vocabulary take the vocabulary's byte pieces, so every word has a probability.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the language
that sorts first; words of any length are summed whole, in scaled sums; with no training rows all texts are ``und``; repeated rows and null ids each give
a row; extra columns are ignored by ``predict`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, written

MARK = "▁"
UNKNOWN = "und"
ITERATIONS = 2
#: Words whose segmentations are summed at once when learning.
BLOCK = 10_000
#: Weight of the pooled piece distribution in each language's.
POOLED = 2000.0
#: Distinct words that a task counts before it hands the counts on, and that a task keeps the scores of.
MOST_COUNTED = 150_000
MOST_WORDS = 300_000
#: Documents that the pipeline keeps have at least this score.
MIN_SCORE = 0.5


#: The first 256 characters, with spaces for those that are no letters.
_SPACED = bytes(i if chr(i).isalpha() else 32 for i in range(256))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


class Segmenter:
    """Edges of a word's segmentations: which pieces lie between which positions."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if len(p) == 6 and p.startswith("<0x")}
        special = set(self.bytes.values()) | {i for i, p in enumerate(pieces) if p.startswith("<") and p.endswith(">")}
        self.piece = {p: i for i, p in enumerate(pieces) if i not in special}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, i in self.piece.items():
            self.automaton.add_word(p, i << 8 | len(p))
        self.automaton.make_automaton()

    def edges(self, word: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(from, to, piece ids): one id, or a character's byte pieces where the vocabulary lacks it."""
        get, out = self.piece.get, []
        for i in range(len(word)):
            if (one := get(word[i])) is None:
                out.append((i, i + 1, tuple(self.bytes[b] for b in word[i].encode("utf-8", "surrogatepass"))))
            else:
                out.append((i, i + 1, (one,)))
            for j in range(i + 2, len(word) + 1):
                if (k := get(word[i:j])) is not None:
                    out.append((i, j, (k,)))
        return out


def letters(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case.

    Where all letters are among the first 256 characters, the others become spaces bytewise.
    """
    if not text:
        return []
    text = text.lower()
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        if any(c > "\xff" and c.isalpha() for c in set(text)):
            import regex

            return regex.findall(r"\p{L}+", text)
        raw = text.encode("latin-1", "replace")
    return raw.translate(_SPACED).decode("latin-1").split()


class Lattice:
    """All segmentations of marked words: edges (a piece from one position to another), by the step at which they end.

    Positions of all words are numbered on; a word of n characters has n + 1. ``pieces`` number the
    edges' weights: those of the vocabulary, then ``spelled``, one for each character outside it.
    Sums are kept in range by a logarithmic scale for each position.
    """

    def __init__(self, segmenter: Segmenter, words: list[str]):
        text = "\n".join(words) + "\n"
        found = np.fromiter(chain.from_iterable(segmenter.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        last, pieces, size = found[:, 0], found[:, 1] >> 8, found[:, 1] & 255
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.end = np.cumsum(lengths + 1) - 1  # where a word's separator stands
        self.base = self.end - lengths
        covered = np.zeros(len(text), dtype=bool)
        covered[last[size == 1]] = True
        covered[self.end] = True
        bare = np.flatnonzero(~covered)
        ids = {c: k for k, c in enumerate(dict.fromkeys(text[i] for i in bare))}
        self.spelled = [[segmenter.bytes[b] for b in c.encode("utf-8", "surrogatepass")] for c in ids]
        if len(bare):
            last = np.concatenate([last, bare])
            pieces = np.concatenate([pieces, np.array([segmenter.size + ids[text[i]] for i in bare])])
            size = np.concatenate([size, np.ones(len(bare), dtype=np.int64)])
        start, stop = last + 1 - size, last + 1
        word = np.searchsorted(self.end, start)
        order = np.lexsort((stop, stop - self.base[word]))
        self.start, self.stop, self.pieces, self.word = start[order], stop[order], pieces[order], word[order]
        self.step = self.stop - self.base[self.word]
        self.positions = len(text)

    def weights(self, weight: np.ndarray) -> np.ndarray:
        """The weights of the vocabulary, and of the characters outside it as products over their bytes' pieces."""
        return np.vstack([weight, *[weight[x].prod(axis=0, keepdims=True) for x in self.spelled]]) if self.spelled else weight

    def sums(self, p: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all ways to each position from its word's start (backward: to its end), and their scales.

        ``p`` has a row for each edge; the columns of the sums are its columns.
        """
        here, there, step, origin = (self.stop, self.start, self.step, self.base)
        if backward:
            ahead = self.end[self.word] - self.start
            order = np.lexsort((self.start, ahead))
            here, there, step, p, origin = self.start[order], self.stop[order], ahead[order], p[order], self.end
        total, scale = np.zeros((self.positions, p.shape[1])), np.zeros((self.positions, p.shape[1]))
        total[origin] = 1.0
        scaled = np.zeros((len(self.base), p.shape[1]))
        of = np.searchsorted(self.end, here if not backward else there - 1)
        bounds = np.flatnonzero(np.diff(step, prepend=0, append=np.iinfo(np.int64).max))
        any_scaled = False
        for a, b in zip(bounds[:-1], bounds[1:]):
            h, t = here[a:b], there[a:b]
            first = np.flatnonzero(np.diff(h, prepend=-1))
            value = total[t] * p[a:b]
            if any_scaled:
                value *= np.exp(scale[t] - scaled[of[a:b]])
            value, h, w = np.add.reduceat(value, first, axis=0), h[first], of[a:b][first]
            if (low := (value < 1e-150) & (value > 0)).any():
                any_scaled = True
                factor = np.where(low, value, 1.0)
                value, scaled[w] = value / factor, scaled[w] + np.log(factor)
            total[h], scale[h] = value, scaled[w]
        return total, scale


def add_expected(got: np.ndarray, segmenter: Segmenter, words: list[str], lang: np.ndarray, n: np.ndarray, weight: np.ndarray) -> None:
    """Add to ``got`` (pieces x languages) what pieces the words (with their mark) hold on average over all segmentations."""
    size, languages = got.shape
    for a in range(0, len(words), BLOCK):
        lattice, lg, times = Lattice(segmenter, words[a : a + BLOCK]), lang[a : a + BLOCK], n[a : a + BLOCK]
        of = lg[lattice.word]
        p = lattice.weights(weight)[lattice.pieces, of].astype(np.float64)[:, None]
        forward, forward_scale = lattice.sums(p)
        back, back_scale = lattice.sums(p, backward=True)
        whole = np.log(forward[lattice.end]) + forward_scale[lattice.end]
        apart = (forward_scale[lattice.start] + back_scale[lattice.stop] - whole[lattice.word])[:, 0]
        e = (forward[lattice.start] * p * back[lattice.stop])[:, 0] * np.exp(apart) * times[lattice.word]
        summed = np.bincount(lattice.pieces * languages + of, weights=e, minlength=(size + len(lattice.spelled)) * languages).reshape(-1, languages)
        got += summed[:size]
        for k, ids in enumerate(lattice.spelled):
            np.add.at(got, ids, summed[size + k])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts; each task combines its counts before the shuffle."""

    def count(batches):
        held: dict[str, Counter] = defaultdict(Counter)
        size = 0

        def rows():
            return pd.DataFrame([(k, w, n) for k, c in held.items() for w, n in c.items()], columns=["lang", "word", "n"])

        for pdf in batches:
            for lang, text in zip(pdf.lang, pdf.text):
                counts, before = held[lang], len(held[lang])
                counts.update(letters(text))
                size += len(counts) - before
                if size > MOST_COUNTED:
                    yield rows()
                    held.clear()
                    size = 0
        if held:
            yield rows()

    return docs.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages and their piece probabilities."""

    def __init__(self, languages: list[str], pieces: list[str], weight: np.ndarray, prior: np.ndarray):
        self.languages, self.pieces, self.weight, self.prior = languages, pieces, weight.astype(np.float32), prior


class Scorer:
    """Log-probabilities of words in each language, kept for words that come again."""

    def __init__(self, model: Model):
        self.segmenter = Segmenter(model.pieces)
        self.weight = model.weight.astype(np.float64)
        self.block = max(256, 100_000 // max(1, self.weight.shape[1]) // 8)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1 << 12, self.weight.shape[1]))

    def _scores(self, words: list[str]) -> np.ndarray:
        """Forward sums of many words at once, as logarithms."""
        out = np.zeros((len(words), self.weight.shape[1]))
        for a in range(0, len(words), self.block):
            lattice = Lattice(self.segmenter, [MARK + w for w in words[a : a + self.block]])
            total, scale = lattice.sums(lattice.weights(self.weight)[lattice.pieces])
            out[a : a + self.block] = np.log(total[lattice.end]) + scale[lattice.end]
        return out

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (texts x languages) and the number of words of each text."""
        counted = [Counter(letters(t)) for t in texts]
        seen = set().union(*counted) if counted else set()
        new = [w for w in seen if w not in self.at]
        if len(self.at) + len(new) > MOST_WORDS:
            self.forget()
            new = list(seen)
        if new:
            first = len(self.at)
            while first + len(new) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = self._scores(new)
            self.at.update(zip(new, range(first, first + len(new))))
        out = np.zeros((len(texts), self.table.shape[1]))
        for k, c in enumerate(counted):
            if c:
                at = np.fromiter(map(self.at.__getitem__, c), dtype=np.int64, count=len(c))
                out[k] = np.fromiter(c.values(), dtype=np.float64, count=len(c)) @ self.table[at]
        return out, np.array([sum(c.values()) for c in counted], dtype=np.int64)


def train(docs: DataFrame, pieces: list[str], iterations: int = ITERATIONS) -> Model:
    """Fit on the rows with a language and a text."""
    spark = docs.sparkSession
    counts = written(word_counts(docs.where("lang is not null and text is not null")), "word-counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    size = len(pieces)
    weight = np.full((size, len(languages)), 1.0 / size)
    for _ in range(iterations if languages else 0):
        shared = spark.sparkContext.broadcast((languages, weight.astype(np.float32)))

        def expect(batches):
            names, w = shared.value
            column = {name: k for k, name in enumerate(names)}
            segmenter = Segmenter(pieces)
            got = np.zeros(w.shape)
            for pdf in batches:
                add_expected(got, segmenter, [MARK + x for x in pdf.word], pdf.lang.map(column).to_numpy(), pdf.n.to_numpy(dtype=float), w)
            piece, lang = np.nonzero(got)
            if len(piece):
                yield pd.DataFrame({"lang": lang.astype(np.int32), "piece": piece.astype(np.int32), "n": got[piece, lang]})

        summed = counts.mapInPandas(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        got = np.zeros(weight.shape)
        got[summed["piece"].to_numpy(), summed["lang"].to_numpy()] = summed["n"].to_numpy()
        shared.destroy()
        pooled = got.sum(axis=1) + 0.1
        pooled /= pooled.sum()
        weight = (got + POOLED * pooled[:, None]) / (got.sum(axis=0) + POOLED)
    n = np.array([totals[x] for x in languages], dtype=float)
    return Model(languages, pieces, weight, np.log(np.maximum(n, 1) / max(n.sum(), 1)) if languages else n)


def _predictions(scorer: Scorer, model: Model, texts: list) -> tuple[list[str], np.ndarray]:
    logs, words = scorer.texts(texts)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    logs = logs + model.prior
    best = logs.argmax(axis=1)
    score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    names = np.where(words > 0, np.array(model.languages, dtype=object)[best], UNKNOWN)
    return list(names), np.where(words > 0, score, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the predicted language's posterior probability) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for pdf in batches:
            for a in range(0, len(pdf), 200):
                part = pdf.iloc[a : a + 200]
                names, score = _predictions(scorer, shared.value, list(part.text))
                yield pd.DataFrame({"doc_id": part.doc_id.astype("Int64").array, "lang_pred": names, "score": score})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is identified, unchanged: not ``und``, and of at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                names, score = _predictions(scorer, shared.value, part.column("text").to_pylist())
                yield part.filter(pa.array((np.array(names, dtype=object) != UNKNOWN) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"), 3, 1))


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(training_rows(docs), load_pieces(vocabulary_path()))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
