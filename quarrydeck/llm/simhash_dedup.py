"""Near-duplicates by 64-bit SimHash and a binary trie self-join.

Fingerprints: lower-cased A-Z, words of non-white-space, shingles of ``words`` words (repeats count), XXH64 with seed 42;
a bit is set if it is set in more than half of the hashes. Two texts link at ``budget`` differing bits or fewer.

Join: of 64 bits in budget + 1 blocks, two linked fingerprints share a block, so each distinct fingerprint goes to the
group of each of its block values. In a group, the sorted fingerprints are a binary trie; the join walks pairs of its
nodes together from the root, adds up the bits in which they differ and drops a pair beyond the budget. A group above
``group_rows`` is dealt into parts, and each pair of parts is a cell of its own; nothing is dropped. Each cell returns
a forest over its links, so that thousands of near copies cost a row each and not a row a pair. Equal fingerprints are
joined before, equal texts therefore too.

Cases: null and empty texts have fingerprint 0 and link like any other; a row with a null id gets the component of its
component (null if that has no id at all); repeated rows stay rows; other columns, also ones that are called like a made
one, are not read; an empty table gives an empty one; long texts are hashed in slices, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, join_one, slices
from .components import connected_components

SEED, SLICE, LEAF, FRONT = 42, 1 << 15, 16, 1 << 16
#: A fingerprint with more than one row in so many of all counts as hot: fewer than so many can be.
HOT_SHARE = 4096


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text."""
    found = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    grams = zip(*(found[i:] for i in range(words))) if len(found) > words else ([found] if found else [])
    grams, counts, total = iter(grams), np.zeros(64, np.int64), 0
    while some := [xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in islice(grams, SLICE)]:
        bits = np.unpackbits(np.array(some, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int32)
        total += len(some)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, others: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp long, others) of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], names=["id", "fp", *others])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"id {kinds[id_col]}", "fp long", *(f"`{c}` {kinds[c]}" for c in others)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *others).mapInArrow(made, schema)


def trie_pairs(fp: np.ndarray, node_pairs: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of linked fingerprints under the given pairs of trie nodes.

    A node is a range of ``fp`` that is sorted and shares its leading bits; columns of ``node_pairs``: first and end of
    the one node, first and end of the other, differing bits so far. A node paired with itself stands for its inner pairs.
    """
    stack = [(63, node_pairs)]
    while stack:
        bit, front = stack.pop()
        if len(front) > FRONT:
            stack += [(bit, front[i : i + FRONT]) for i in range(0, len(front), FRONT)]
            continue
        a, b = front[:, 1] - front[:, 0], front[:, 3] - front[:, 2]
        leaf = (a * b <= LEAF) if bit >= 0 else np.ones(len(front), bool)
        if leaf.any():
            own, size = front[leaf], (a * b)[leaf]
            at = np.repeat(np.arange(len(own)), size)
            k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            width = b[leaf][at]
            i, j = own[at, 0] + k // width, own[at, 2] + k % width
            near = (np.bitwise_count(fp[i] ^ fp[j]) <= budget) & ((own[at, 0] != own[at, 2]) | (i < j))
            if near.any():
                yield i[near], j[near]
            front = front[~leaf]
        if not len(front):
            continue
        mask = np.uint64(1) << np.uint64(bit)

        def middle(lo: np.ndarray, hi: np.ndarray, mask: np.uint64 = mask) -> np.ndarray:
            """Where the ones of this bit begin: a binary search inside all nodes at once."""
            lo, hi = lo.copy(), hi.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                one = (fp[np.minimum(mid, len(fp) - 1)] & mask) > 0
                hi = np.where(open_ & one, mid, hi)
                lo = np.where(open_ & ~one, mid + 1, lo)
            return lo

        (a0, a1, b0, b1, err), same = front.T, front[:, 0] == front[:, 2]
        am = middle(a0, a1)
        bm = np.where(same, am, middle(b0, b1))
        nodes = [np.stack(x, 1) for x in ((a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am, a1, b0, bm, err + 1))]
        nodes[3] = nodes[3][~same]
        nodes = np.concatenate(nodes)
        nodes = nodes[(nodes[:, 4] <= budget) & (nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2])]
        nodes = nodes[(nodes[:, 0] != nodes[:, 2]) | (nodes[:, 1] - nodes[:, 0] > 1)]
        if len(nodes):
            stack.append((bit - 1, nodes))


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the sets of i and j; each set is named by its smallest place."""
    while True:
        while (parent != (up := parent[parent])).any():
            parent = up
        x, y = parent[i], parent[j]
        if not (apart := x != y).any():
            return parent
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def _forest(cells: pa.Table, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of whole cells, sorted by cell, side and fingerprint."""
    cell, side = cells["cell"].to_numpy(), cells["side"].to_numpy()
    fp = cells["fp"].to_numpy().view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    ends = np.append(starts[1:], len(cell))
    split = starts + np.add.reduceat(side == 0, starts)
    inner = cells["inner"].to_numpy()[starts]
    pairs = np.stack([starts, np.where(inner, ends, split), np.where(inner, starts, split), ends, np.zeros(len(starts), np.int64)], 1)
    pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (~inner | (ends - starts > 1))]
    parent = np.arange(len(fp))
    for i, j in trie_pairs(fp, pairs, budget):
        parent = _join(parent, i, j)
    own = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[own].view(np.int64), fp[parent[own]].view(np.int64)


def _bits(fp: Column, lo: int, hi: int) -> Column:
    """Bits lo to hi of a fingerprint, counted from its most significant one."""
    return F.shiftrightunsigned(fp, 64 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def block_keys(fp: Column, budget: int, levels: int) -> Column:
    """Array of struct(block, value) such that two fingerprints within the budget share at least one.

    One level: the values of budget + 1 blocks. Two levels: each of them together with those of budget + 1 blocks of the
    bits that are left, which are within the budget as well.
    """
    blocks = budget + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for lo, hi in zip(cuts, cuts[1:]):
        if levels == 1:
            keys.append(_bits(fp, lo, hi))
            continue
        rest = 64 - (hi - lo)
        left = F.shiftleft(_bits(fp, 0, lo), 64 - hi) if lo else F.lit(0).cast("long")
        left = left.bitwiseOR(_bits(fp, hi, 64)) if hi < 64 else left
        steps = [rest * i // blocks for i in range(blocks + 1)]
        for at, to in zip(steps, steps[1:]):
            own = F.shiftrightunsigned(left, rest - to).bitwiseAND(F.lit((1 << (to - at)) - 1))
            keys.append(F.shiftleft(_bits(fp, lo, hi), to - at).bitwiseOR(own))
    return F.array(*(F.struct(F.lit(i).alias("block"), key.cast("long").alias("value")) for i, key in enumerate(keys)))


def hamming_forest(fps: DataFrame, *, fp_col: str = "fp", budget: int = 3, group_rows: int = 2048, levels: int | None = None) -> DataFrame:
    """(a, b) such that two fingerprints are connected by these rows exactly if a chain of links connects them.

    With one level a fingerprint goes to budget + 1 groups, of which each grows with the input; once the even share of a
    group passes ``group_rows`` times (budget + 1), the copies for its cells would cost more than a second level's
    (budget + 1) ** 2 keys, and two levels are taken. The links are the same.
    """
    found = fps.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct()
    if levels is None:
        levels = 2 if budget and found.count() >> (64 // (budget + 1)) > group_rows * (budget + 1) else 1
    rows = found.select("fp", F.explode(block_keys(F.col("fp"), budget, levels)).alias("key")).select("fp", "key.block", "key.value")
    large = rows.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
    large = large.select("block", "value", F.ceil(F.col("n") / group_rows).cast("int").alias("parts"))
    # At most (budget + 1) * 2 ** 16 groups exist on one level at the default budget, whatever the input: a proven bound.
    rows = rows.join(F.broadcast(large) if budget >= 3 and levels == 1 else large, ["block", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    rows = rows.select("fp", F.xxhash64("block", "value", lo, hi).alias("cell"), "block", "value", lo.alias("lo"), hi.alias("hi"), (F.col("part") != lo).cast("int").alias("side"), (lo == hi).alias("inner"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _and_end(batches):
            if batch is not None:
                held.append(batch)
                if sum(len(x) for x in held) < 8 * group_rows:
                    continue
            if not held:
                continue
            cells = pa.Table.from_batches(held).combine_chunks()
            whole = len(cells)
            if batch is not None:  # the last cell may go on in the next batch
                cell = cells["cell"].to_numpy()
                whole = int(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[-1])
            held = cells.slice(whole).to_batches()
            if whole:
                a, b = _forest(cells.slice(0, whole), budget)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "block", "value", "lo", "hi", "side", F.shiftrightunsigned("fp", 1), "fp")
    return dealt.select("cell", "side", "inner", "fp").mapInArrow(joined, "a long, b long").distinct()


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3, group_rows: int = 2048, hot_share: int = HOT_SHARE) -> DataFrame:
    """(id, fp, component_id) of every row; the component is named by the smallest id that a chain of links reaches."""
    fps = fingerprints(docs, id_col=id_col, text_col=text_col, words=words)
    return linked_rows(fps, budget=budget, group_rows=group_rows, hot_share=hot_share).select(F.col("id").alias(id_col), "fp", "component_id")


def linked_rows(fps: DataFrame, *, budget: int = 3, group_rows: int = 2048, hot_share: int = HOT_SHARE) -> DataFrame:
    """Add component_id (smallest id) and root (smallest fingerprint) to rows of (id, fp, ...)."""
    fps = cut(fps)
    total = fps.count()
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    linked = connected_components(hamming_forest(nodes.select("fp"), budget=budget, group_rows=group_rows))
    nodes = cut(nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = cut(join_one(nodes.select("root", "fp", F.col("n").alias("rows")), roots, "root", total, hot_share).withColumnRenamed("rows", "n"))
    return join_one(fps, named, "fp", total, hot_share, F.monotonically_increasing_id())  # as often as rows repeat; fps is a checkpoint


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """One row of each component, with all columns of ``docs``: the smallest id (rows without one last), then the smallest
    digest of the whole row. Rows that are equal in every column count as one; rows that share an id only do not."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), whole.alias("row")).withColumn("digest", F.md5(F.to_json("row", {"ignoreNullFields": "false"})))
    fps = fingerprints(keyed, id_col="id", text_col="text", words=words, others=("digest",))
    rows = linked_rows(fps, budget=budget)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("best"))
    keep = best.select(F.col("best.digest").alias("digest"))
    return keyed.join(keep, "digest", "left_semi").dropDuplicates(["digest"]).select("row.*")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
