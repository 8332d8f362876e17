"""Benchmark decontamination by winnowing.

Words of an item and of a text are hashed in grams of ``gram`` words; of every ``window - gram + 1`` grams in a row, those of
one window, the least hash is kept (the last of equal ones). A window of ``window`` words that an item and a text share has the
same least gram in both, so every shared span of a window or more shares a fingerprint. An item of fewer words is one gram
of its own length, and texts keep all grams of the lengths that such items have.

Fingerprints of texts and items are joined by their hash, each with the words around it (a window's reach on both sides).
The words are compared, so a hash that falls together by chance is no hit, and a hit is extended to both sides; it counts if
it is as long as a window. Texts are joined once each, however many rows hold them, and a passage that many texts or items
share is joined once for each different surrounding, not once for each pair. Up to ``FILTER`` different hashes of the items
are sent to the tasks, so that other fingerprints don't leave them; beyond it all fingerprints go to the join.

Cases: a null or empty text has no words and no hits; items without words have no windows; rows that share an id are rows of
their own; an item id that repeats is listed once, with the windows of all its rows; the windows of an item without an id
hit, but it isn't listed; empty tables give no rows, or rows without hits; long texts are read whole; only the id and the
text of both tables are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, join_one, slices, tokens_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FILTER, ROWS_A_TASK, GATE_BITS = 1 << 21, 1 << 16, 20
MARKS = pa.struct([("size", pa.int32()), ("margin", pa.int32()), ("hash", pa.int64()), ("pos", pa.int32()), ("words", pa.string())])
ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(word_hash: np.ndarray, ids: np.ndarray, size: int, kind: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on."""
    n = max(0, len(ids) - size + 1)
    h = np.full(n, kind, np.uint64)
    own = word_hash[ids]
    for j in range(size):
        h = h * ODD + own[j : j + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def winnowed(h: np.ndarray, left: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Places of the kept grams. ``left``: words from each place to the end of its text."""
    starts = np.flatnonzero(left >= window)
    best = starts.copy()
    for j in range(1, window - gram + 1):
        best = np.where(h[starts + j] <= h[best], starts + j, best)
    return np.unique(best)


def surroundings(words: pa.Array, ids: np.ndarray, first: np.ndarray, end: np.ndarray, pos: np.ndarray, size: int, margin: int) -> pa.Array:
    """The gram's words and ``margin`` more on both sides, with blanks between; where the text has ended, nothing."""
    at = pos[:, None] + np.arange(-margin, size + margin)[None]
    out = (at < first[:, None]) | (at >= end[:, None])
    own = pc.fill_null(words.take(pa.array(ids[np.clip(at, 0, len(ids) - 1)].ravel(), mask=out.ravel())), "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1) * at.shape[1], pa.int32()), own), " ")


class Marker:
    """Fingerprints of a batch of texts."""

    def __init__(self, window: int, gram: int, short: list[int], known: np.ndarray | None, whole_short: bool) -> None:
        self.window, self.gram, self.short, self.known, self.whole_short = window, gram, short, known, whole_short
        self.gate = None
        if known is not None:
            self.gate = np.zeros(1 << GATE_BITS, bool)
            self.gate[self._door(known)] = True

    @staticmethod
    def _door(h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - GATE_BITS)).astype(np.int64)

    def _wanted(self, h: np.ndarray, pos: np.ndarray) -> np.ndarray:
        if self.known is None:
            return pos
        pos = pos[self.gate[self._door(h[pos])]]
        if not len(self.known) or not len(pos):
            return pos[:0]
        at = np.minimum(np.searchsorted(self.known, h[pos]), len(self.known) - 1)
        return pos[self.known[at] == h[pos]]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """The number of words of each text, and its fingerprints."""
        words, ids, bounds = tokens_of(pc.ascii_lower(texts), SEPARATORS)
        lengths = np.diff(bounds)
        left = np.repeat(bounds[1:], lengths) - np.arange(len(ids))
        word_hash = np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)
        classes = [(self.gram, self.window - self.gram), *((n, 0) for n in self.short)]
        parts, places = [], []
        for size, margin in classes if len(ids) else ():
            h = gram_hashes(word_hash, ids, size, size * 64 + (margin > 0))
            if margin:
                pos = winnowed(h, left, self.window, self.gram)
            elif self.whole_short:  # an item's one gram
                pos = bounds[:-1][lengths == size]
            else:
                pos = np.flatnonzero(left[: len(h)] >= size)
            pos = self._wanted(h, pos)
            text = np.searchsorted(bounds, pos, "right") - 1
            around = surroundings(words, ids, bounds[text], bounds[text + 1], pos, size, margin)
            fixed = [pa.array(np.full(len(pos), x), pa.int32()) for x in (size, margin)]
            parts.append(pa.StructArray.from_arrays([*fixed, pa.array(h[pos]), pa.array((pos - bounds[text]).astype(np.int32)), around], fields=list(MARKS)))
            places.append(text)
        if not parts:
            return lengths, pa.array([[]] * len(lengths), pa.list_(MARKS))
        text = np.concatenate(places)
        order = np.argsort(text, kind="stable")
        offsets = np.searchsorted(text[order], np.arange(len(lengths) + 1))
        return lengths, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(parts).take(pa.array(order)))


def _split(c: str) -> Column:
    return F.split(F.col(c), " ", -1)


def _run(ours: Column, theirs: Column, places: list[Column]) -> Column:
    """How many of the places in a row hold one word in both."""
    same = [F.coalesce((F.get(ours, p) == F.get(theirs, p)) & (F.get(ours, p) != ""), F.lit(False)) for p in places]
    rows = [reduce(lambda a, b: a & b, same[: i + 1]).cast("int") for i in range(len(same))]
    return reduce(lambda a, b: a + b, rows, F.lit(0))


def salted_join(rows: DataFrame, facts: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """Inner join of ``rows`` (with a column ``row`` that tells them apart) with any number of ``facts`` a key; ``counts``: the
    key's number n of rows. A key of many rows is dealt over several tasks, each with a copy of its facts."""
    counts = counts.select(key, "n", F.ceil(F.col("n") / ROWS_A_TASK).cast("int").alias("salts"))
    rows = join_one(rows, counts, key, total).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).drop("salts")
    facts = facts.join(counts.select(key, "salts"), key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return rows.join(facts, [key, "salt"]).drop("salt")


def contaminated_spans(docs: DataFrame, items: DataFrame, *, window: int = 10, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, spans, item_ids) for every row of ``docs``: the words from start up to end that lie in some
    item's window, and the ids of those items as sorted strings."""
    spark, margin = docs.sparkSession, window - gram
    at_items = Marker(window, gram, list(range(1, window)), None, True)

    def item_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            _, marks = at_items(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), marks], names=["item", "marks"])

    mark = "marks array<struct<size: int, margin: int, hash: bigint, pos: int, words: string>>"
    marks = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text")).mapInArrow(item_marks, f"item string, {mark}")
    marks = cut(marks.select("item", F.inline("marks")).select("item", "size", "margin", "hash", "words").distinct())
    short = sorted(r.size for r in marks.where("margin = 0").select("size").distinct().collect())  # fewer than ``window`` numbers
    hashes = marks.select("hash").distinct()
    known = np.sort(hashes.toPandas()["hash"].to_numpy(np.int64)) if hashes.limit(FILTER + 1).count() <= FILTER else None
    held = spark.sparkContext.broadcast(known)

    def text_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(window, gram, short, held.value, False)
        for batch in slices(batches, 1024):
            lengths, found = marker(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), found], names=["id", "key", "n_words", "marks"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(text, 256).alias("key"), text.alias("text"))
    found = cut(found.mapInArrow(text_marks, f"id {kind}, key string, n_words long, {mark}")).withColumn("row", F.monotonically_increasing_id())
    marked = found.where("size(marks) > 0")
    texts = marked.groupBy("key").agg(F.first("marks").alias("marks"), F.count("*").alias("n"))  # equal texts have equal marks
    spots = cut(texts.select("key", "n", F.inline("marks")).withColumn("seen", F.concat_ws("/", F.col("size") * 64 + F.col("margin"), "words")))

    # Each surrounding of a text's gram against each of an item's.
    around = spots.groupBy("seen", "size", "margin", "hash", "words").agg(F.count("*").alias("n"))
    theirs = marks.select("size", "margin", "hash", F.col("words").alias("item_words")).distinct()
    ours_w, theirs_w = _split("words"), _split("item_words")
    middle = [F.slice(w, F.col("margin") + 1, F.col("size")) for w in (ours_w, theirs_w)]
    left = F.when(F.col("margin") > 0, _run(ours_w, theirs_w, [F.lit(margin - 1 - j) for j in range(margin)])).otherwise(0)
    right = F.when(F.col("margin") > 0, _run(ours_w, theirs_w, [F.lit(margin + gram + j) for j in range(margin)])).otherwise(0)
    pairs = around.join(theirs, ["size", "margin", "hash"]).where(middle[0] == middle[1]).withColumns({"left": left, "right": right})
    pairs = cut(pairs.where((F.col("margin") == 0) | (F.col("left") + F.col("size") + F.col("right") >= window)).select("seen", "size", "margin", "n", "left", "right", "item_words"))
    reach = pairs.groupBy("seen").agg(F.max("left").alias("left"), F.max("right").alias("right"), F.max("n").alias("n"))
    listed = pairs.select("seen", "size", "margin", F.col("item_words").alias("words")).join(marks.where("item is not null").select("size", "margin", "words", "item"), ["size", "margin", "words"]).select("seen", "item").distinct()

    # Back to the texts: their spans, and their items.
    total = spots.count()
    hits = cut(join_one(spots.select("key", "seen", "size", "pos"), reach, "seen", total).select("key", "seen", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("size") + F.col("right")).alias("end")))
    before = F.max("end").over(Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.select("key", "start", "end").distinct().withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = islands.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    own = hits.select("key", "seen").distinct().withColumn("row", F.xxhash64("key"))
    found_items = salted_join(own, listed, "seen", own.groupBy("seen").agg(F.count("*").alias("n")), total).select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    keys = spots.select("key", "n").distinct()
    result = cut(keys.join(spans, "key", "left").join(found_items, "key", "left")).drop("n")

    kept = ["id", "n_words", "n_hit", "spans", "item_ids"]
    hit = salted_join(marked.select("id", "key", "n_words", "row"), result, "key", keys, marked.count()).select(*kept)
    spans_type, items_type = "array<struct<start: int, end: int>>", "array<string>"
    clean = found.where("size(marks) = 0").select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast(spans_type).alias("spans"), F.array().cast(items_type).alias("item_ids"))
    hit = hit.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "spans": F.coalesce("spans", F.array().cast(spans_type)), "item_ids": F.coalesce("item_ids", F.array().cast(items_type))})
    return hit.unionByName(clean).withColumnRenamed("id", id_col)
