"""Language identification: a linear-chain conditional random field over the words of a text.

Each word has features (the word itself against the learned lexicon, byte n-grams, prefixes and suffixes, all hashed);
a learned matrix gives the transition between the languages of neighbouring words. Forward-backward gives every word
its distribution over languages, so that code-switched text is labelled word by word; a document gets the language
with the highest mean.

Cases: a text that is null or has no letter is ``und`` with score 0; without labelled rows every text is ``und``;
words beyond the alphabet seen in training fall back on the transitions and the bias of the classes; languages with equal
means: the first in the order of their names; very long texts count as a whole, a word at a time in memory of its batch;
repeated rows stay rows with equal results; an empty table gives an empty one; other columns pass through, but one that is
called like a made column (``lang_pred``, ``score``) is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_map, cut, hash_below, sampled_words, slices, subword_buckets, tokens_of, word_blocks

ORDERS, AFFIXES = (2, 3, 4), (2, 3, 4, 5)
BREAK = r"[^\p{L}]+"
BITS = 18
CHUNK_WORDS = 1 << 18


@dataclass
class LanguageModel:
    labels: list[str]
    weight: np.ndarray  # bucket x label
    trans: np.ndarray  # from x to, log scale

    def emissions(self, words: pa.Array) -> np.ndarray:
        out = [np.zeros((0, len(self.labels)), np.float32)]
        for block in word_blocks(words):
            bucket, owner = subword_buckets(block, ORDERS, BITS, AFFIXES)
            count = np.maximum(np.bincount(owner, minlength=len(block)), 1)
            out.append(np.stack([np.bincount(owner, self.weight[bucket, k], len(block)) / count for k in range(len(self.labels))], 1).astype(np.float32))
        return np.concatenate(out)

    def marginals(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For groups of texts: their places, where each one's words start, and the words' distributions."""
        words, ids, at = tokens_of(pc.utf8_lower(pc.fill_null(texts, "")), BREAK)
        if not self.labels or not len(words):
            return
        emit = self.emissions(words)
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        total = np.cumsum(sizes[order])
        group = total // CHUNK_WORDS
        for g in np.unique(group):
            own = order[group == g]
            starts = np.concatenate([[0], np.cumsum(sizes[own])])
            flat = np.repeat(at[own] - starts[:-1], sizes[own]) + np.arange(starts[-1])
            yield own, starts, forward_backward(emit[ids[flat]], starts, self.trans)[0]


def forward_backward(emit: np.ndarray, starts: np.ndarray, trans: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each place, and (to learn) expected transitions; sequences lie one behind another, longest first.

    All sequences that reach place t are handled together, in probability space with a scale at each place.
    """
    e = np.exp(emit - emit.max(1, keepdims=True))
    move = np.exp(trans - trans.max()).astype(np.float32)
    sizes = np.diff(starts)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    ahead, back = np.empty_like(e), np.ones_like(e)
    pairs = np.zeros_like(move, dtype=np.float64)
    for t in range(longest):
        spot = starts[: active[t]] + t
        a = e[spot] if t == 0 else (ahead[spot - 1] @ move) * e[spot]
        ahead[spot] = a / np.maximum(a.sum(1, keepdims=True), 1e-30)
    for t in range(longest - 2, -1, -1):
        spot = starts[: active[t + 1]] + t
        b = back[spot + 1] * e[spot + 1]
        b /= np.maximum(b.sum(1, keepdims=True), 1e-30)
        back[spot] = b @ move.T
    post = ahead * back
    post /= np.maximum(post.sum(1, keepdims=True), 1e-30)
    if learn and longest > 1:
        inner = np.ones(len(e), bool)
        inner[starts[:-1]] = False
        to = np.flatnonzero(inner)
        joint = ahead[to - 1][:, :, None] * move[None] * (e[to] * back[to])[:, None, :]
        joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-30)
        pairs = joint.sum(0, dtype=np.float64)
    return post, pairs


def train(texts: list[str], langs: list[str], steps: int = 320, batch: int = 64, length: int = 32, rate: float = 0.3, seed: int = 11) -> LanguageModel:
    """Maximise the likelihood of spliced sequences (stretches of texts in several languages) by adaptive gradient steps."""
    labels = sorted(set(langs))
    words, ids, at = tokens_of(pc.utf8_lower(pa.array(texts, pa.string())), BREAK)
    usable = np.flatnonzero(np.diff(at) > 0)
    k = len(labels)
    if k == 0 or len(usable) == 0:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0), np.float32))
    rng = np.random.default_rng(seed)
    gold = np.searchsorted(labels, langs)
    by_label = [usable[gold[usable] == y] for y in range(k)]
    known = [y for y in range(k) if len(by_label[y])]
    buckets, counts = [], []
    for block in word_blocks(words):
        found, owner = subword_buckets(block, ORDERS, BITS, AFFIXES)
        buckets.append(found[np.argsort(owner, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(block)))
    bucket, counts = np.concatenate(buckets), np.concatenate(counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    weight, square = np.zeros((1 << BITS, k), np.float32), np.full((1 << BITS, k), 1e-3, np.float32)
    trans, trans_square = np.zeros((k, k), np.float32), np.full((k, k), 1e-3, np.float32)
    starts = np.arange(batch + 1) * length
    for _ in range(steps):
        seq, tag = np.empty((batch, length), np.int64), np.empty((batch, length), np.int64)
        for b in range(batch):  # stretches of 4 to `length` words, each from a text of a drawn language
            filled = 0
            while filled < length:
                y = known[rng.integers(len(known))]
                doc = by_label[y][rng.integers(len(by_label[y]))]
                have = at[doc + 1] - at[doc]
                take = int(min(have, rng.integers(4, length + 1), length - filled))
                start = at[doc] + rng.integers(have - take + 1)
                seq[b, filled : filled + take], tag[b, filled : filled + take] = ids[start : start + take], y
                filled += take
        seq, tag = seq.ravel(), tag.ravel()
        sizes = counts[seq]
        flat = np.repeat(first[seq] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        place, found = np.repeat(np.arange(len(seq)), sizes), bucket[flat]
        emit = np.stack([np.bincount(place, weight[found, y], len(seq)) for y in range(k)], 1) / sizes[:, None]
        post, pairs = forward_backward(emit.astype(np.float32), starts, trans, learn=True)
        post[np.arange(len(seq)), tag] -= 1
        seen, back = np.unique(found, return_inverse=True)
        share = (post / sizes[:, None])[place]
        grad = np.stack([np.bincount(back, share[:, y], len(seen)) for y in range(k)], 1).astype(np.float32)
        square[seen] += grad**2
        weight[seen] -= rate * grad / np.sqrt(square[seen])
        inner = np.arange(len(seq)) % length > 0
        to = np.flatnonzero(inner)
        grad = (pairs - np.bincount(tag[to - 1] * k + tag[to], minlength=k * k).reshape(k, k)).astype(np.float32) / len(seq)
        trans_square += grad**2
        trans -= rate * grad / np.sqrt(trans_square)
    return LanguageModel(labels, weight, trans)


def fit_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 1500, sample_words: int = 4096) -> LanguageModel:
    """Fit on about ``sample_rows`` rows, at most as many from each language, so that a rare one is learned as well.

    Rows are drawn by the hash of id and text. A whole text is read; of one with more than ``sample_words`` words so
    many are learned from, in runs of words drawn by a seed from all of it.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang is not null and text is not null")
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))  # one row a language
    quota = -(-sample_rows // max(sizes.count(), 1))
    rows = rows.join(F.broadcast(sizes) if quota > 1 else sizes, "lang").where(hash_below(F.least(F.lit(1.0), 2.0 * quota / F.col("n")), "id", "text"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sampled_words(pc.utf8_lower(batch.column(2)), sample_words, BREAK), pa.string())], names=["lang", "draw", "text"])

    rows = rows.select(F.col("lang").cast("string"), F.xxhash64("id", "text").alias("draw"), "text").mapInArrow(runs, "lang string, draw long, text string")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))  # about twice the quota a language
    got = rows.withColumn("place", place).where(F.col("place") <= quota).orderBy("place", "lang").limit(sample_rows).select("draw", "text", "lang").toPandas()
    got = got.sort_values(["lang", "draw", "text"], ignore_index=True)
    return train(got["text"].tolist(), got["lang"].tolist())


def identify_language(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the predicted language and its mean marginal (0 to 1) to every row; the whole text counts."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**BITS rows of one number a language
    kept = [c for c in docs.columns if c not in (lang_col, score_col)]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.labels, "und"], object)
        for batch in slices(batches):
            best, score = np.full(batch.num_rows, len(model.labels)), np.zeros(batch.num_rows)
            for own, starts, post in model.marginals(batch.column(len(kept))):
                mean = np.add.reduceat(post, starts[:-1], axis=0, dtype=np.float64) / np.diff(starts)[:, None]
                best[own] = mean.argmax(1)
                score[own] = np.clip(mean.max(1), 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(names[best], pa.string()), pa.array(score)], names=[*kept, lang_col, score_col])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias("__text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn(lang_col, F.lit("")).withColumn(score_col, F.lit(0.0)).schema
    for field in schema:
        field.nullable = True
    return arrow_map(rows, labelled, schema)


def label_words(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of every text: id, place, the most likely language and its marginal (code-switched text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(held.value.labels, object)
        for batch in slices(batches):
            for own, starts, post in held.value.marginals(batch.column(1)):
                sizes = np.diff(starts)
                place = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
                ids = batch.column(0).take(pa.array(np.repeat(own, sizes)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(place, pa.int64()), pa.array(names[post.argmax(1)], pa.string()), pa.array(post.max(1).astype(np.float64))], names=["id", "place", "lang", "marginal"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(words, f"id {kind}, place long, lang string, marginal double").withColumnRenamed("id", id_col)
