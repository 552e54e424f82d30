"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word's vector is the mean of the vectors of its hashed character n-grams, a
text's vector the mean over its words; a linear softmax on top and the n-gram
vectors are trained jointly in numpy, so an unseen misspelling shares most of
its n-grams with the word it comes from. Because everything above the n-grams
is linear, scoring needs one number per word, which each task remembers.

The model is fitted on at most ``max_train`` labelled rows and ``max_bytes`` of
their bags (a bounded sample, the smallest hashes of doc_id); every row of ``documents`` is scored on its
whole text. Rows whose crc32(doc_id as text) mod 4 is 2 are held out.

Edge cases: null text counts as empty and scores as the bias alone; labels that
are null are ignored, of several labels of one doc_id the largest counts;
without labels of both kinds every score is the share of toxic labels (0 if
there are none); of rows that repeat a labelled doc_id, that with the smallest
digest of its text is learnt from; a null doc_id is not held out; repeated rows
stay; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready, text_digest

MAX_TRAIN = 8000
#: Bytes of bags that the fitting task holds at most; a bag has 6 a bucket, about 20 KB for a usual text.
MAX_TRAIN_BYTES = 256 << 20
BUCKETS = 1 << 15
DIM = 16
SIZES = (3, 4, 5)
THRESHOLD = 0.3
NEUTRAL = 8
DECAY = 0.1
STEPS = 750
CACHE_WORDS = 500_000
_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}@$!*']*")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words(text: str | None) -> tuple[dict[str, float], float]:
    """Word -> weight, and what the weights are divided by.

    A word said often counts by its logarithm, and a text of few words by less,
    as if it had ``NEUTRAL`` words more.
    """
    found = {w: 1 + log(n) for w, n in Counter(_WORD.findall((text or "").lower())).items()}
    return found, sum(found.values()) + NEUTRAL


def grams(word: str) -> np.ndarray:
    """Bucket numbers of a word's character n-grams and of the word itself."""
    data = f"<{word}>"
    parts = [data] + [data[i : i + n] for n in SIZES for i in range(len(data) - n + 1)]
    return np.array([zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts], dtype=np.int64)


def bag(text: str | None, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The text's buckets and their weights."""
    found, total = words(text)
    weights = np.zeros(BUCKETS)
    for word, n in found.items():
        if word not in known:
            known[word] = grams(word)
        np.add.at(weights, known[word], n / (total * len(known[word])))
    at = np.flatnonzero(weights)
    return at.astype(np.uint16), weights[at].astype(np.float32)


class SubwordSoftmax:
    """value[g] is what one n-gram adds to the log-odds of a toxic text."""

    def __init__(self, value: np.ndarray, bias: float) -> None:
        self.value, self.bias = value, bias

    @classmethod
    def fit(cls, texts: list[str | None], labels: list[int], steps: int = STEPS) -> SubwordSoftmax:
        known: dict[str, np.ndarray] = {}
        return cls.fit_bags([bag(t, known) for t in texts], labels, steps)

    @classmethod
    def fit_bags(cls, bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = STEPS, batch: int = 128, rate: float = 0.02, seed: int = 7) -> SubwordSoftmax:
        y = np.asarray(labels, dtype=np.int64)
        share = float(y.mean()) if len(y) else 0.0
        if share in (0.0, 1.0):
            return cls(np.zeros(BUCKETS, np.float32), 40.0 if share else -40.0)
        rng = np.random.default_rng(seed)
        params = [rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.log(np.array([1 - share, share], np.float32))]
        means, squares, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(max(1, round(steps * batch / len(y)))):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                x = np.zeros((len(rows), BUCKETS), np.float32)
                for i, r in enumerate(rows):
                    x[i, bags[r][0]] = bags[r][1] * 10
                hidden = x @ params[0]
                logits = hidden @ params[1] + params[2]
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                slopes = [x.T @ (p @ params[1].T), hidden.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, m, s in zip(params, slopes, means, squares):  # Adam
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    q *= 1 - rate * DECAY
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        toward = params[1][:, 1] - params[1][:, 0]
        return cls((params[0] @ toward * 10).astype(np.float32), float(params[2][1] - params[2][0]))

    def scores(self, texts: list[str | None], cache: dict[str, float]) -> list[float]:
        out = []
        for text in texts:
            found, total = words(text)
            logit = 0.0
            for word, n in found.items():
                one = cache.get(word)
                if one is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    one = float(self.value[grams(word)].mean())
                    if len(word) <= 64:
                        cache[word] = one
                logit += n * one
            z = self.bias + logit / total
            out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return out


_BAGS = "labelled long, place long, digest binary, y int, at binary, weight binary"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts in, their buckets and weights out."""
    known: dict[str, np.ndarray] = {}
    for batch in batches:
        made = []
        for text in batch.column(4).to_pylist():
            if len(known) > CACHE_WORDS:
                known.clear()
            at, weight = bag(text, known)
            made.append((at.astype("<u2").tobytes(), weight.astype("<f4").tobytes()))
        columns = [pa.array([m[k] for m in made], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], ["labelled", "place", "digest", "y", "at", "weight"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, steps: int = STEPS, max_bytes: int = MAX_TRAIN_BYTES) -> SubwordSoftmax:
    """Fit on at most ``max_train`` labelled rows that aren't held out, and ``max_bytes`` of their bags."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    sample = known.withColumn("place", F.xxhash64("labelled")).orderBy("place", "labelled").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
    python_ready(docs.sparkSession)
    # Texts become bags where they lie; of rows that repeat a doc_id one counts.
    bags = rows.select("labelled", "place", text_digest().alias("digest"), "y", "text").mapInArrow(_bags, _BAGS)
    bags = bags.groupBy("labelled").agg(F.min(F.struct("place", "digest", "y", "at", "weight")).alias("one")).select("labelled", "one.*")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, labels, size = [], [], 0
        for batch in batches:
            for y, at, weight in zip(*(c.to_pylist() for c in batch.columns)):
                size += len(at) + len(weight)
                if size <= max_bytes:
                    made.append((np.frombuffer(at, "<u2"), np.frombuffer(weight, "<f4")))
                    labels.append(y)
        model = SubwordSoftmax.fit_bags(made, labels, steps)
        yield pa.RecordBatch.from_arrays([pa.array([model.value.astype("<f4").tobytes()]), pa.array([model.bias])], ["value", "bias"])

    # One task fits the bounded sample, in a fixed order; the driver gets the weights alone.
    ordered = bags.repartition(1).sortWithinPartitions("labelled").select("y", "at", "weight")
    made = ordered.mapInArrow(fitted, "value binary, bias double").first()
    return SubwordSoftmax(np.frombuffer(made["value"], "<f4"), made["bias"]) if made else SubwordSoftmax.fit([], [])


def score(docs: DataFrame, model: SubwordSoftmax, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    python_ready(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            made = model.scores(batch.column(1).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, steps: int = STEPS) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, each judged by its own text."""
    model, columns = train(docs, labels, steps=steps), docs.columns
    python_ready(docs.sparkSession)
    text = len(columns)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            made = model.scores(batch.column(text).to_pylist(), cache)
            own = pa.RecordBatch.from_arrays(batch.columns[:text], columns)
            yield own.filter(pa.array([s < threshold for s in made], pa.bool_()))

    # Rows go through whole, so none is looked up again by an id that may be null or repeated.
    return docs.select("*", F.col("text").cast("string").alias(f"text-{uuid.uuid4().hex}")).mapInArrow(kept, docs.schema)
