"""Hard negatives by exact integer scores, several candidates a multiplication (Kronecker packing).

Components become whole numbers. In a cell of candidates and anchors both sides are biased to numbers from 0 up, so that a
score of biased vectors needs at most w bits; 64 // w candidates share one 64-bit integer a component, each in a field of
w bits. One multiplication by the anchor's component then serves all of them, sums never run into the next field, and the
fields give exact scores once the bias is taken off. Where fewer than two fields fit, the integers are Python's, of any width.

Two passes, as the range of an anchor's negatives is known only from its positives. Positives: rows and anchors of one
label meet, in blocks, so a hot label is dealt over many cells. Negatives: every block of rows meets every block of anchors,
and a cell returns for each positive its few best rows within the range. Rows equal in id, label and vector are one row with
a count before they are dealt out, so repeated rows never gather in a task.

Cases: rows without an id or label, and vectors that are null or hold null or non-finite components, take no part; an
anchor leaves out itself alone, so a row that repeats it or shares its id is a positive; each row of a repeated anchor has its
own results; vectors compare with vectors of the same length only; equal scores go by the smaller id; an anchor without
positives, or a positive without negatives in range (always so below zero), gives no rows; components are held at 2^62 on
either side and scores at the ends of a long; empty tables give no rows; only the three named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, join_one

ROW_BLOCK, ANCHOR_BLOCK, CHUNK = 4096, 16384, 128
LONG, MOST = (1 << 63) - 1, float(1 << 62)
WIDE_FIELDS = 16


def whole_components(column: pa.ChunkedArray, dim: int, scale: int) -> np.ndarray:
    """Components times ``scale``, rounded down, one row a vector."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * scale), -MOST, MOST).astype(np.int64).reshape(len(column), dim)


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all anchors and rows, exact, held at the ends of a long; one product serves all fields of an integer."""
    n, dim = rows.shape
    if not n or not len(anchors) or not dim:
        return np.zeros((len(anchors), n), np.int64)
    low_a, low_r, span_a, span_r = int(anchors.min()), int(rows.min()), int(anchors.max()), int(rows.max())
    width = max(1, (dim * (span_a - low_a) * (span_r - low_r)).bit_length())
    plain = dim * max(-low_a, span_a, 1) * max(-low_r, span_r, 1) < 1 << 61
    kind, fields = (np.uint64, 64 // width) if plain and 2 * width <= 64 else (object, WIDE_FIELDS)
    signed = np.int64 if kind is np.uint64 else object
    a = (anchors.astype(signed) - low_a).astype(kind)
    r = np.zeros((-(-n // fields) * fields, dim), kind)
    r[:n] = (rows.astype(signed) - low_r).astype(kind)
    shifts = [kind(width * f) if kind is np.uint64 else width * f for f in range(fields)]
    wide = sum(r[f::fields] << shifts[f] for f in range(fields))
    product = a @ wide.T
    mask = kind((1 << width) - 1) if kind is np.uint64 else (1 << width) - 1
    biased = np.stack([(product >> shift) & mask for shift in shifts], axis=2).reshape(len(a), -1)[:, :n].astype(signed)
    score = biased + low_a * r[:n].astype(signed).sum(1)[None] + low_r * a.astype(signed).sum(1)[:, None] + dim * low_a * low_r
    return score if signed is np.int64 else np.clip(score, -LONG - 1, LONG).astype(np.int64)


def _first(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first rows, higher scores first, then smaller ids."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.lexsort((ids[at], ~score[at]))[:k]]
    return np.lexsort((ids, ~score))[:k]


def best_positives(ids: np.ndarray, x: np.ndarray, anchors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's place, row's place, score) of the k first rows for each anchor."""
    found = []
    for start in range(0, len(anchors), CHUNK):
        for i, score in enumerate(packed_scores(anchors[start : start + CHUNK], x)):
            at = _first(ids, score, k)
            found.append((np.full(len(at), start + i), at, score[at]))
    return tuple(np.concatenate(x) for x in zip(*found))


def in_range(ids: np.ndarray, x: np.ndarray, labels: np.ndarray, anchors: np.ndarray, own: np.ndarray, tops: list[list[int]], k: int, least: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """(anchor's place, positive's place, row's place, score): the k first rows of another label with least * top <= score <= top."""
    found = [(np.zeros(0, np.int64),) * 4]
    for start in range(0, len(anchors), CHUNK):
        for i, score in enumerate(packed_scores(anchors[start : start + CHUNK], x), start):
            ranges = [(p, -(-least[0] * top // least[1]), top) for p, top in enumerate(tops[i]) if top >= 0]
            if not ranges:
                continue
            at = np.flatnonzero((labels != own[i]) & (score >= min(low for _, low, _ in ranges)) & (score <= max(top for *_, top in ranges)))
            for p, low, top in ranges if len(at) else ():
                fit = at[(score[at] >= low) & (score[at] <= top)]
                fit = fit[_first(ids[fit], score[fit], k)]
                found.append((np.full(len(fit), i), np.full(len(fit), p), fit, score[fit]))
    return tuple(np.concatenate(x) for x in zip(*found))


def mine_negatives(rows: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by
    ``every``, and each of its first ``positives`` other rows of the same label, the first ``negatives`` rows of other labels
    whose score is at least the share ``least`` of the positive's and at most the positive's."""
    kind = "float" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # the narrow form is dealt out
    x = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast(f"array<{kind}>").alias("x"))
    x = x.where("id is not null and label is not null and x is not null").where(~F.exists("x", lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))))
    x = cut(x.groupBy("id", "label", "x").agg(F.count("*").alias("copies")).withColumn("dim", F.size("x")))
    anchors = x.where(F.col("id") % every == 0).toDF(*(f"a_{c}" for c in x.columns)).toDF(*x.columns)  # columns of their own, for the joins with x
    anchors = anchors.withColumn("a_key", F.md5(F.concat_ws(",", "id", "label", F.concat_ws(",", F.transform("x", lambda c: c.cast("string"))))))
    spread = F.xxhash64("id", "x")

    def dealt(n, block: int):
        return F.ceil(n / block).cast("int")

    def blocks(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    def to_block(n):
        return F.pmod(spread, n.cast("long")).cast("int")

    # Positives: rows and anchors of one label.
    total = x.count()
    mine = F.struct("dim", "label")
    facts = x.groupBy(mine.alias("own")).agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("a")).where("a > 0")
    facts = facts.select("own", "n", dealt(F.col("n"), ROW_BLOCK).alias("rbs"), dealt(F.col("a"), ANCHOR_BLOCK).alias("qbs"))
    left = join_one(x.withColumn("own", mine), facts, "own", total).select("id", "x", "copies", "dim", "label", to_block(F.col("rbs")).alias("rb"), blocks(F.col("qbs")).alias("qb"))
    right = join_one(anchors.withColumn("own", mine), facts, "own", total).select("a_key", "id", "x", "copies", "dim", "label", to_block(F.col("qbs")).alias("qb"), blocks(F.col("rbs")).alias("rb"))
    names = ("dim", "label", "rb", "qb")
    schema = pa.schema([("a_key", pa.string()), ("a_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("copies", pa.int64()), ("self", pa.int64())])

    def positive_cell(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not len(rows) or not len(own):
            return schema.empty_table()
        dim = own["dim"][0].as_py()
        ids, v, a = rows["id"].to_numpy(), whole_components(rows["x"], dim, scale), whole_components(own["x"], dim, scale)
        itself = np.array([int(packed_scores(r[None], r[None])[0, 0]) for r in a], np.int64)
        who, at, score = best_positives(ids, v, a, positives + 1)
        side = own.select(["a_key", "id"]).take(pa.array(who))
        return pa.table([*side.columns, pa.array(ids[at]), pa.array(score), rows["copies"].take(pa.array(at)), pa.array(itself[who])], schema=schema)

    found = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(positive_cell, "a_key string, a_id long, id long, score long, copies long, self long")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(positives + 1)).cast("int"))))
    best = F.row_number().over(Window.partitionBy("a_key").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", best).where(F.col("rank") <= positives + 1)  # with the anchor itself, if it is among its best
    found = found.groupBy("a_key", "a_id", "self").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("top"))
    itself = F.array_position(F.transform("top", lambda r: (r["id"] == F.col("a_id")) & (r["score"] == F.col("self"))), True)
    found = found.withColumn("at", itself).select("a_key", F.slice(F.filter("top", lambda r, i: i + 1 != F.col("at")), 1, positives).alias("top"))
    own = anchors.join(found, "a_key")
    own = cut(own)

    # Negatives: each block of rows and each block of anchors.
    rbs, qbs = max(1, -(-total // ROW_BLOCK)), max(1, -(-own.count() // ANCHOR_BLOCK))
    left = x.select("id", "label", "x", "copies", "dim", to_block(F.lit(rbs)).alias("rb"), blocks(F.lit(qbs)).alias("qb"))
    right = own.select("a_key", "id", "label", "x", "copies", "dim", "top", to_block(F.lit(qbs)).alias("qb"), blocks(F.lit(rbs)).alias("rb"))
    names = ("dim", "rb", "qb")
    out = pa.schema([("a_key", pa.string()), ("anchor_id", pa.int64()), ("repeats", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("copies", pa.int64())])

    def negative_cell(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not len(rows) or not len(own):
            return out.empty_table()
        dim = own["dim"][0].as_py()
        codes = pc.dictionary_encode(pa.chunked_array([*rows["label"].chunks, *own["label"].chunks])).combine_chunks()
        codes = (codes if isinstance(codes, pa.DictionaryArray) else codes.chunk(0)).indices.to_numpy()
        ids, v, a = rows["id"].to_numpy(), whole_components(rows["x"], dim, scale), whole_components(own["x"], dim, scale)
        tops = own["top"].to_pylist()
        who, place, at, score = in_range(ids, v, codes[: len(rows)], a, codes[len(rows) :], [[t["score"] for t in top] for top in tops], negatives, least)
        chosen = [tops[i][p] for i, p in zip(who, place)]
        side = own.select(["a_key", "id", "copies"]).take(pa.array(who))
        return pa.table([side["a_key"], side["id"], side["copies"], pa.array(place.astype(np.int32)), pa.array([t["id"] for t in chosen], pa.int64()), pa.array([t["score"] for t in chosen], pa.int64()), pa.array(ids[at]), pa.array(score), rows["copies"].take(pa.array(at))], schema=out)

    found = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(negative_cell, "a_key string, anchor_id long, repeats long, place int, positive_id long, positive_score long, id long, score long, copies long")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(negatives)).cast("int"))))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("a_key", "place").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= negatives)
    found = found.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
