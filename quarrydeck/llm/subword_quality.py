"""Quality classifier: supervised subword embeddings.

Learned vectors of hashed words, byte n-grams and word bigrams are averaged per document; a softmax over the average
gives the score. Training is plain stochastic gradient descent in numpy on a bounded sample of labelled rows; scoring is a map
over whole texts. As the model is linear behind the average, each distinct word of a batch is looked up once.

Cases: a null or empty text has no feature and gets the learned bias alone; without labelled rows, or with one class
only, every score is the share of label 1 (0.5 without any); repeated rows stay rows with equal scores, so ties are
possible and stay ties; very long texts count as a whole; an empty table gives an empty one; other columns pass through
untouched, but one that is called like the score is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import PRIME, arrow_map, framed_bytes, hash_below, sampled_words, slices, subword_buckets, tokens_of, word_blocks

ORDERS = (3, 4, 5)
BIGRAM_BITS = 16


def bigrams_of(words: pa.Array, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word bigrams of all texts, text by text, and where each text's begin (one more at the end).

    A bigram's bucket is the exclusive or of its words' hashes: no order counts, and all words that stand beside
    themselves share one bucket, so that repetition is learned from any vocabulary.
    """
    own = np.zeros(0, np.uint64)
    for block in word_blocks(words):
        buf, starts = framed_bytes(block)
        place = np.arange(len(buf)) - np.repeat(starts[:-1], np.diff(starts))
        powers = np.cumprod(np.full(int(np.diff(starts).max(initial=1)), PRIME | np.uint64(1), np.uint64))
        own = np.concatenate([own, np.add.reduceat(buf.astype(np.uint64) * powers[place], starts[:-1])])
    own = (own ^ (own >> np.uint64(29))) * PRIME >> np.uint64(64 - BIGRAM_BITS)
    inner = np.ones(max(len(ids) - 1, 0), bool)
    edge = at[1:-1] - 1
    inner[edge[(edge >= 0) & (edge < len(inner))]] = False
    found = (own[ids[:-1]] ^ own[ids[1:]]).astype(np.int64)[inner] if len(ids) > 1 else np.zeros(0, np.int64)
    counts = np.maximum(np.diff(at) - 1, 0)
    return found, np.concatenate([[0], np.cumsum(counts)])


def features_of(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, word by word, and where each word's begin (one more at the end)."""
    buckets, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for block in word_blocks(words):
        bucket, owner = subword_buckets(block, ORDERS, bits)
        buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(block)))
    return np.concatenate(buckets), np.cumsum(np.concatenate(counts))


@dataclass
class QualityModel:
    weight: np.ndarray  # logit difference per bucket of words and n-grams, then of word bigrams
    bias: float
    bits: int

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, ids, at = tokens_of(texts)
        total, count = np.zeros(len(words)), np.zeros(len(words), np.int64)
        at_word = 0
        for block in word_blocks(words):
            bucket, owner = subword_buckets(block, ORDERS, self.bits)
            total[at_word : at_word + len(block)] = np.bincount(owner, self.weight[bucket], len(block))
            count[at_word : at_word + len(block)] = np.bincount(owner, minlength=len(block))
            at_word += len(block)
        sums = np.concatenate([[0.0], np.cumsum(total[ids])])
        counts = np.concatenate([[0], np.cumsum(count[ids])])
        pair, first = bigrams_of(words, ids, at)
        pairs = np.concatenate([[0.0], np.cumsum(self.weight[(1 << self.bits) + pair])])
        mean = (np.diff(sums[at]) + np.diff(pairs[first])) / np.maximum(np.diff(counts[at]) + np.diff(first), 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, sample_words: int) -> pa.Table:
    """(text, label) of at most ``sample_rows`` rows of ``docs`` with a label, by the hash of id and text.

    Whole texts are read where they lie; of one with more than ``sample_words`` words so many come, in runs from all over it. An
    id with several labels gives a row each; an id with several rows takes part with each.
    """
    ids = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label"))
    many = ids.count()
    ids = ids.where(hash_below(min(1.0, 2.0 * sample_rows / max(many, 1)), "id")).distinct()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(f"`{text_col}`", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), "id")  # about twice sample_rows ids at most, by the share above

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sampled_words(batch.column(2), sample_words), pa.string())], names=["label", "draw", "text"])

    rows = rows.select("label", F.xxhash64("id", "text").alias("draw"), "text").mapInArrow(made, "label int, draw long, text string")
    return rows.orderBy("draw", "label", "text").limit(sample_rows).select("text", "label").toArrow()


def text_features(texts: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The different buckets of each text and their shares of all its features."""
    words, ids, at = tokens_of(texts)
    bucket, starts = features_of(words, bits)
    pair, first = bigrams_of(words, ids, at)
    rows = []
    for i in range(len(texts)):
        own, times = np.unique(ids[at[i] : at[i + 1]], return_counts=True)
        sizes = starts[own + 1] - starts[own]
        flat = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(own) else np.zeros(0, np.int64)
        near = pair[first[i] : first[i + 1]]
        found, back = np.unique(np.concatenate([bucket[flat], (1 << bits) + near]), return_inverse=True)
        weight = np.bincount(back, np.concatenate([np.repeat(times, sizes), np.ones(len(near))]), len(found))
        rows.append((found.astype(np.int32), (weight / max(weight.sum(), 1)).astype(np.float32)))
    return rows


def train(texts: pa.Array, labels: np.ndarray, bits: int = 18, dim: int = 16, epochs: int = 6, least_steps: int = 12_000, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Fit vectors and softmax by stochastic gradient descent, one document a step, with a linearly falling rate; few rows are
    gone through more often, so that there are at least ``least_steps`` steps."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    size = (1 << bits) + (1 << BIGRAM_BITS)
    if len(labels) == 0 or share in (0.0, 1.0):
        edge = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(size), float(np.log(edge / (1 - edge))), bits)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    vectors[1 << bits :] = 0  # a bigram that was never seen says nothing
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    rows = text_features(texts, bits)
    epochs = max(epochs, -(-least_steps // len(rows)))
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            now, (found, weight) = rate * (1 - step / steps), rows[i]
            step += 1
            own = vectors[found]
            hidden = weight @ own
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            grad = out @ p
            out -= now * np.outer(hidden, p)
            bias -= now * p
            vectors[found] = own - now * weight[:, None] * grad * len(found) ** 0.5
    return QualityModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]), bits)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 2000, sample_words: int = 4096, **training) -> QualityModel:
    """Fit on a bounded sample: ``sample_rows`` rows, and of a text with more than ``sample_words`` words so many from all over it."""
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows, sample_words)
    model = train(rows["text"].combine_chunks() if len(rows) else pa.array([], pa.string()), rows["label"].to_numpy(), **training)
    pa.default_memory_pool().release_unused()
    return model


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col`` (0 to 1, higher: label 1 likelier) to every row; the whole text counts."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one number a bucket
    kept = [c for c in docs.columns if c != score_col]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = held.value.scores(batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(scores, pa.float64())], names=[*kept, score_col])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias("__text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn(score_col, F.lit(0.0)).schema
    for field in schema:
        field.nullable = True
    return arrow_map(rows, scored, schema)
