"""Toxicity (7): a factorization machine over hashed terms.

A document's terms are its distinct words (runs of letters, lower case) and their first three, four
and five letters (which stand for stems), hashed. The machine scores a set of terms by a bias, a weight for each term and, for each pair, the
inner product of two latent vectors, so that it can learn that two terms together (an insult and a
mention of a group) mean more than either.

Fitting uses a bounded sample of the labelled rows: the ``SAMPLE_ROWS`` whose ids have the smallest
hashes, which is also why their labels can be broadcast to the scan of the documents; of texts that
repeat an id one counts. On the sample, Spark counts each term's documents by label. The machine's terms
are those that tell something alone (the ``TERMS`` with the largest chi-square, if it is significant)
and those that tell something in a pair: of the ``PAIR_TERMS`` most frequent terms, the two of each pair
whose documents have one label more often than chance allows, whatever each term does alone. The sample
as term numbers goes to the driver, where the machine is fitted by AdaGrad. These bounds hold for the
fit alone.
Scoring runs over all rows and whole texts in the tasks.

Defined cases: a null or empty text has no terms and gets the bias's score; conflicting labels of one
id count as toxic; with no training rows, or none of either label, every score is 0; repeated rows
and null ids each give a row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, written
from .language_id import letters

SAMPLE_ROWS = 30_000
SPACE = 1 << 22
TERMS = 8192
LEAST_DOCUMENTS = 4
#: Terms below this chi-square (0.001 at one degree of freedom) are left out.
LEAST_CHI = 10.83
#: Frequent terms whose pairs are looked at, and deviations from the share of a label from which a pair counts.
PAIR_TERMS = 1024
LEAST_DEVIATIONS = 6.0
PREFIXES = (3, 4, 5)
FACTORS = 8
EPOCHS = 12
THRESHOLD = 0.3
#: Words whose terms a task keeps.
MOST_WORDS = 400_000


def terms_of_word(word: str) -> tuple[int, ...]:
    from xxhash import xxh64_intdigest

    texts = [word, *(f"{word[:n]}^" for n in PREFIXES if len(word) >= n)]
    return tuple(xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 7) % SPACE for t in texts)


def words_of(text: str | None) -> set[str]:
    return set(letters(text))


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, n: int, least: float = LEAST_DEVIATIONS) -> np.ndarray:
    """The terms (of 0 .. n - 1) that stand in a pair whose rows' labels deviate from the rows' share by ``least`` standard deviations.

    What either term does alone is counted on another scale: a pair counts only if it deviates from both
    its terms' own rows as well, so that it is the pair that tells.
    """
    both, hits = np.zeros((n, n), dtype=np.float32), np.zeros((n, n), dtype=np.float32)
    for a in range(0, len(rows), 2048):
        part = rows[a : a + 2048]
        x = np.zeros((len(part), n), dtype=np.float32)
        x[np.repeat(np.arange(len(part)), [len(r) for r in part]), np.concatenate(part) if part else []] = 1
        both += x.T @ x
        toxic = x[labels[a : a + 2048] > 0]
        hits += toxic.T @ toxic
    share = np.clip(np.diag(hits) / np.maximum(np.diag(both), 1), 0.001, 0.999)
    base = min(0.999, max(0.001, labels.mean()))
    off = lambda p: np.abs(hits - both * p) / np.sqrt(np.maximum(both, 1) * p * (1 - p))
    tells = (both >= LEAST_DOCUMENTS) & (np.minimum(off(base), np.minimum(off(share[:, None]), off(share[None, :]))) >= least)
    np.fill_diagonal(tells, False)
    return np.flatnonzero(tells.any(axis=1))


class Machine:
    """Term numbers by hash, and the fitted weights; numbers that no term has stand for nothing."""

    def __init__(self, terms: np.ndarray, bias: float, weight: np.ndarray, vectors: np.ndarray):
        self.terms, self.bias, self.weight, self.vectors = terms, bias, weight, vectors

    @staticmethod
    def fit(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, factors: int = FACTORS, rate: float = 0.3, vector_rate: float = 0.03) -> Machine:
        """AdaGrad on the logistic loss, over batches of rows of term numbers."""
        rng = np.random.default_rng(42)
        n = len(terms)
        weight, vectors = np.zeros(n), rng.normal(0, 0.02, (n, factors))
        share = labels.mean()
        bias = float(np.log(share / (1 - share)))
        sums_w, sums_v, sum_b = np.full(n, 1e-4), np.full((n, factors), 1e-2), 1e-4
        lengths = np.array([len(r) for r in rows])
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), 128):
                batch = order[a : a + 128]
                own = np.repeat(np.arange(len(batch)), lengths[batch])
                at = np.concatenate([rows[k] for k in batch]) if len(own) else np.zeros(0, dtype=np.int64)
                v = vectors[at]
                total = np.zeros((len(batch), factors))
                np.add.at(total, own, v)
                square = np.bincount(own, weights=(v * v).sum(axis=1), minlength=len(batch))
                z = bias + np.bincount(own, weights=weight[at], minlength=len(batch)) + 0.5 * ((total * total).sum(axis=1) - square)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
                gw = np.bincount(at, weights=g[own], minlength=n)
                gv = np.zeros_like(vectors)
                np.add.at(gv, at, g[own, None] * (total[own] - v))
                touched = np.unique(at)
                gw[touched] += 1e-5 * weight[touched]
                gv[touched] += 1e-4 * vectors[touched]
                sums_w[touched] += gw[touched] ** 2
                sums_v[touched] += gv[touched] ** 2
                weight[touched] -= rate * gw[touched] / np.sqrt(sums_w[touched])
                vectors[touched] -= vector_rate * gv[touched] / np.sqrt(sums_v[touched])
                sum_b += g.sum() ** 2
                bias -= 0.05 * g.sum() / sum_b**0.5
        return Machine(terms, bias, weight, vectors)

    def score(self, at: np.ndarray) -> float:
        v = self.vectors[at]
        z = self.bias + self.weight[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, terms: int = TERMS) -> Machine | None:
    """Fit on a bounded sample of the rows of ``labels`` (doc_id, toxic); None if they lack either label."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    one = written(one.withColumn("place", F.xxhash64("doc_id")), "labels")
    # Only labels under a bound of the hash are ordered at all, twice as many as asked for, so what one task takes does not grow.
    least = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 2 * sample_rows // max(one.count(), 1))
    sample = written(one.where(F.col("place") <= F.lit(least)).orderBy("place", "doc_id").limit(sample_rows).drop("place"), "labels-sample")

    def hashed(batches):
        known: dict[str, tuple[int, ...]] = {}
        for pdf in batches:
            out = []
            for text in pdf.text:
                found: set[int] = set()
                for w in words_of(text):
                    if (t := known.get(w)) is None:
                        if len(known) > MOST_WORDS:
                            known.clear()
                        t = known[w] = terms_of_word(w)
                    found.update(t)
                out.append(list(found))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "text_key": pdf.text_key, "toxic": pdf.toxic, "terms": out})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").join(F.broadcast(sample), "doc_id")  # sample_rows labels
    every = texts.mapInPandas(hashed, "doc_id long, text_key long, toxic int, terms array<int>")
    rows = written(every.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "terms"), "text_key").alias("r")).select("r.*"), "labelled-terms")
    n, n_toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not n_toxic or n_toxic == n:
        return None
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("hit")).where(F.col("df") >= LEAST_DOCUMENTS)
    expected = F.col("df") * (n_toxic / n)
    chi = (F.col("hit") - expected) ** 2 / (expected * (1 - F.col("df") / (n + 1)))
    alone = {r.term for r in counts.where(chi >= LEAST_CHI).orderBy(chi.desc(), "term").limit(terms).select("term").collect()}  # at most ``terms`` rows
    frequent = np.sort(np.array([r.term for r in counts.orderBy(F.col("df").desc(), "term").limit(PAIR_TERMS).select("term").collect()], dtype=np.int64))

    def held(known: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The sample as numbers of the known terms, in an order of its own."""

        def numbered(batches):
            for pdf in batches:
                out = []
                for found in pdf.terms:
                    found = np.asarray(found, dtype=np.int64)
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    out.append(np.sort(at[known[at] == found]).tolist())
                yield pd.DataFrame({"toxic": pdf.toxic, "at": out})

        got = rows.mapInPandas(numbered, "toxic int, at array<int>").toArrow()  # sample_rows rows of known terms
        pairs = sorted(zip(got["toxic"].to_pylist(), map(tuple, got["at"].to_pylist())))
        return [np.array(x, dtype=np.int64) for _, x in pairs], np.array([t for t, _ in pairs], dtype=float)

    if len(frequent):
        alone |= set(frequent[telling_pairs(*held(frequent), len(frequent))].tolist())
    if not alone:
        return None
    known = np.array(sorted(alone), dtype=np.int64)
    return Machine.fit(known, *held(known))


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and the score of every whole text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if machine is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        machine = shared.value
        number = {int(t): i for i, t in enumerate(machine.terms)}
        known: dict[str, tuple[int, ...]] = {}
        for pdf in batches:
            out = []
            for text in pdf.text:
                found: set[int] = set()
                for w in words_of(text):
                    if (t := known.get(w)) is None:
                        if len(known) > MOST_WORDS:
                            known.clear()
                        t = known[w] = tuple(number[x] for x in terms_of_word(w) if x in number)
                    if t:
                        found.update(t)
                out.append(machine.score(np.array(sorted(found), dtype=np.int64)))
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "score": out})

    return docs.mapInPandas(run, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    away = held_out(F.col("doc_id"), 4, 2)
    machine = train(docs, labels.where(~away))
    return score(docs, machine).select("doc_id", away.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
