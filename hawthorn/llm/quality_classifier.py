"""Quality classifier: hashed word and character n-gram vectors, averaged, softmax, numpy SGD.

A word's vector is the mean of the vectors of its features (the word and its 3- to 5-character
n-grams with bounds, hashed into 2**17 buckets). Each pair of neighbouring words adds the vector of its word bigram, which
is hashed by the difference of the words' hashes (so that a word said twice has one bucket, whatever the word). A
document's vector is the mean over words and bigrams (as if it had a few neutral words more, so that short texts stay near
the bias); two outputs and softmax. Steps of SGD on a document's vectors are divided by the squared length of their weights,
so that a long text moves its mean as far as a short one. Since all that is linear up to the softmax, a trained model is
one number for each bucket, vector . (u1 - u0); texts are scored by arrays over all their code points, without a Python step
for each word.

Training takes at most `per_class` documents of each label, the least by a hash of their id, from
rows of labels with crc32(id) mod 4 other than 2; their buckets and weights alone reach the driver, made of whole texts on the
executors. Scoring is one pass over whole texts.
Inputs of a score: the text only.

Cases: null or empty text: the bias alone; labels null, other than 0 and 1, repeated or without a document:
not trained on (repeated: once, the least label); a doc_id of several texts: trained on the least of them; no labels, or of one class only: the share
of label 1, smoothed; repeated rows: each scored; null doc_id: scored, not held out; very long texts: whole; empty
table: no rows; extra columns: ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 17, 12, 8, 0.3, 5
#: Bound on the labelled documents of each class that training takes.
PER_CLASS = 1500
#: Characters of text that are scored at a time.
CHARS = 500_000
#: Neutral words in each text's mean.
NEUTRAL = 6
THRESHOLD = 0.7


_SIZES = (3, 4, 5)
_rng = np.random.Generator(np.random.PCG64(99))
_ODD = _rng.integers(1, 2**63, (len(_SIZES), 5), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _buckets(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(47)).astype(np.int32)


class Text:
    """The words of several texts and the buckets of their features, as arrays over all code points at once."""

    def __init__(self, texts: list[str]):
        # white space stands for the bounds of words, so n-grams at a bound hold one space as 0
        joined = " " + "\n".join(texts) + " "
        x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends_at = np.cumsum([len(t) + 1 for t in texts]) + 1
        self.inside = ~((x == 32) | ((x >= 9) & (x <= 13)))
        starts = np.flatnonzero(self.inside[1:] & ~self.inside[:-1]) + 1
        ends = np.flatnonzero(self.inside[:-1] & ~self.inside[1:]) + 1
        self.x = np.where(self.inside, x, 0).astype(np.uint64)
        self.word_of = np.zeros(len(x), np.int32)
        self.word_of[starts] = 1
        self.word_of = np.cumsum(self.word_of, dtype=np.int32) - 1
        self.n_words = len(starts)
        sizes = ends - starts
        self.count = 1 + sum(np.maximum(0, sizes + 3 - n) for n in _SIZES)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(kernels.mix(self.x) * kernels.powers(kernels._BASE, len(x)), out=total[1:])
        self.hashes = (total[ends] - total[starts]) * kernels.powers(kernels._INV, len(x))[starts]
        self.first = np.searchsorted(starts, np.concatenate([[0], ends_at[:-1]]))
        self.first = np.append(self.first, self.n_words)
        #: Whether a word ends a bigram: all but the first of each text.
        self.follows = np.ones(self.n_words, bool)
        self.follows[self.first[:-1][self.first[:-1] < self.n_words]] = False

    def grams(self):
        """(buckets, word of each) for each size of n-gram; then the words themselves."""
        for k, n in enumerate(_SIZES):
            m = len(self.x) - n + 1
            if m <= 0:
                continue
            whole = self.inside[1 : m + 1].copy()
            for j in range(2, n - 1):
                whole &= self.inside[j : m + j]
            at = np.flatnonzero(whole)
            h = self.x[at] * _ODD[k, 0]
            for j in range(1, n):
                h += self.x[at + j] * _ODD[k, j]
            yield _buckets(h), self.word_of[at + 1]
        yield _buckets(self.hashes), np.arange(self.n_words, dtype=np.int32)

    def bigrams(self):
        """Buckets of the bigrams, and the words that end them."""
        ends = np.flatnonzero(self.follows)
        return _buckets(self.hashes[ends] - self.hashes[ends - 1]), ends


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their weights; the weights of a text sum to less than 1."""
    t = Text([text])
    if not t.n_words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    n = 2 * t.n_words - 1 + NEUTRAL
    pairs = t.bigrams()[0]
    ids, weights = [pairs], [np.full(len(pairs), 1.0 / n)]
    for buckets, word in t.grams():
        ids.append(buckets)
        weights.append(1.0 / (t.count[word] * n))
    found, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate(weights)).astype(np.float32)


class Model:
    """bias and one number for each bucket: what scoring needs of the trained vectors and outputs."""

    def __init__(self, bias: float, table: np.ndarray):
        self.bias, self.table = bias, table

    def scores(self, texts: list[str]) -> np.ndarray:
        t = Text(texts)
        words = np.zeros(t.n_words)
        for buckets, word in t.grams():
            words += np.bincount(word, self.table[buckets], minlength=t.n_words)
        words /= t.count
        pairs, ends = t.bigrams()
        words[ends] += self.table[pairs]
        total = np.concatenate([[0.0], np.cumsum(words)])
        n = np.diff(t.first)
        sums = total[t.first[1:]] - total[t.first[:-1]]
        logit = self.bias + np.where(n > 0, sums / (2 * n - 1 + NEUTRAL), 0.0)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """bags: distinct buckets and weights of each document."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n, ones = len(bags), sum(labels)
    if not 0 < ones < n:
        return Model(float(np.log((ones + 1) / (n - ones + 1))), np.zeros(BUCKETS, np.float32))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    outputs, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    step, total = 0, epochs * n
    for _ in range(epochs):
        for i in rng.permutation(n):
            ids, weights = bags[i]
            lr = rate * (1 - step / total)
            step += 1
            hidden = weights @ vectors[ids]
            logits = outputs @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ outputs
            outputs -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            if len(ids):
                vectors[ids] -= np.outer(lr / float(weights @ weights) * weights, back)
    return Model(float(bias[1] - bias[0]), (vectors @ (outputs[1] - outputs[0])).astype(np.float32))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, text, quality of at most per_class labelled documents of each class, none held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = usable.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    pick = lambda q: usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1)).select(F.col("doc_id").alias("_id"), "quality")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "quality")


def _bag_rows(batches):
    """(doc_id, text, quality) -> doc_id, quality, ids, weights."""
    for batch in batches:
        bags = [_bag(text.as_py() or "") for text in batch.column(1)]
        cols = [batch.column(0), batch.column(2), pa.array([a.astype(np.int32) for a, _ in bags], pa.list_(pa.int32())), pa.array([w for _, w in bags], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "quality", "ids", "weights"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    chosen = sample(docs, labels, per_class).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").cast("int").alias("quality"))
    made = chosen.select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(_bag_rows, "doc_id bigint, quality int, ids array<int>, weights array<float>")
    rows = made.orderBy("doc_id").toArrow()
    bags = [(ids.values.to_numpy(), weights.values.to_numpy()) for ids, weights in zip(rows.column("ids"), rows.column("weights"))]
    return train(bags, rows.column("quality").to_pylist())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""

    def run(batches):
        for batch in batches:
            texts, parts, held, size = batch.column(2).to_pylist(), [], [], 0
            for i, text in enumerate(texts):
                held.append(text or "")
                size += len(held[-1])
                if size > CHARS or i == len(texts) - 1:
                    parts.append(model.scores(held))
                    held, size = [], 0
            x = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x), pa.array((x >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op6_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
SQL: dict[str, str] = {}
