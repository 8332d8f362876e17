"""Exact top-k search by inner product with a pivot table.

Vectors get one more coordinate, so that all rows have the same norm M and the inner product falls as the distance
grows: d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Every row holds its distances to a fixed number of pivots; the largest difference
between a query's and a row's distance to one pivot is a lower bound of their distance, so an upper bound of the score.

Rows lie in clusters by their nearest pivot. A cluster's least and largest distance to each pivot bound all its rows at
once: a query goes only to the clusters whose bound reaches its floor, the k-th best score among a fixed sample of rows.
Clusters and queries are dealt into blocks of bounded size; a cell pairs a block of each. In a cell the rows lie in tiles,
sorted by their distance to the cluster's pivot, each with its least and largest distances; a query takes the tiles in the
order of their bounds until its k-th best score beats every bound that is left. The cells' best are ranked again.

Cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; a query leaves out
itself alone, so a row that repeats it, or shares its id, is a candidate, and each row of a repeated query has its own
results; vectors compare with vectors of the same length only; with fewer than k candidates all are returned; ties go to the
smaller id; scores beyond a long are held at its ends; empty tables give no rows; of the input only the id and the vector are
read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

PIVOTS, SAMPLE, ROW_BLOCK, QUERY_BLOCK, TILE = 32, 1024, 8192, 8192, 512
LONG = (1 << 63) - 1


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v) with v the components times ``scale``, rounded down, of rows that take part."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    df = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("x")).where("id is not null and x is not null")
    df = df.where(~F.exists("x", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))))
    return df.select("id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(x: np.ndarray, height: np.ndarray, pivots: np.ndarray, pivot_height: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1) + height**2
    other = (pivots**2).sum(1) + pivot_height**2
    return np.sqrt(np.maximum(square[:, None] + other[None] - 2 * (x @ pivots.T + height[:, None] * pivot_height[None]), 0))


def choose_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Places of ``count`` rows far from each other: each next one is farthest from those taken."""
    taken, gap = [0], ((x - x[0]) ** 2).sum(1)
    while len(taken) < min(count, len(x)):
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[taken[-1]]) ** 2).sum(1))
    return np.array(taken)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and x, exact, held at the ends of a long."""
    if q.size == 0 or x.size == 0 or np.abs(q.astype(np.float64)).max() * np.abs(x.astype(np.float64)).max() * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, -LONG - 1, LONG).astype(np.int64)


def _squares(v: np.ndarray) -> np.ndarray:
    """Each row's product with itself, exact, held at the end of a long."""
    if v.size == 0 or np.abs(v.astype(np.float64)).max() ** 2 * v.shape[1] < 2.0**53:
        return (v.astype(np.float64) ** 2).sum(1).astype(np.int64)
    return np.array([min(int((r.astype(object) ** 2).sum()), LONG) for r in v], np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def most_score(square: np.ndarray, limit: float, q_table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bound of the score of each query with all rows whose distances to the pivots lie between low and high."""
    bound = np.zeros((len(q_table), len(low)))
    for p in range(low.shape[1]):
        np.maximum(bound, np.maximum(low[None, :, p] - q_table[:, p, None], q_table[:, p, None] - high[None, :, p]), out=bound)
    bound = np.maximum(bound - 1e-3 - 1e-6 * limit**0.5, 0)  # more than the rounding of the distances
    most = (square[:, None] + limit - bound**2) / 2
    return most + (square[:, None] + limit) * 1e-9 + 1


def search_cell(ids: np.ndarray, x: np.ndarray, table: np.ndarray, q: np.ndarray, q_table: np.ndarray, limit: float, floor: np.ndarray, k: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of one block for each query: (query place, id, score). ``floor``: a score that k rows reach anyhow."""
    order = np.lexsort((table.min(1), table.argmin(1))) if table.shape[1] else np.arange(len(x))
    ids, x, table = ids[order], x[order], table[order]
    starts = np.arange(0, len(x), tile)
    low, high = np.minimum.reduceat(table, starts, axis=0), np.maximum.reduceat(table, starts, axis=0)
    most = most_score((q.astype(np.float64) ** 2).sum(1), limit, q_table, low, high)
    turn = np.argsort(-most, axis=1, kind="stable")
    need = floor.copy()
    at, found, score = (np.zeros(0, np.int64) for _ in range(3))
    live = np.arange(len(q))
    for step in range(len(starts)):
        live = live[most[live, turn[live, step]] >= need[live]]
        if not len(live):
            break
        fresh = []
        for t in np.unique(turn[live, step]):  # queries whose next tile is the same are scored together
            own = live[turn[live, step] == t]
            rows = slice(starts[t], starts[t] + tile)
            got = _scores(q[own], x[rows])
            i, j = np.nonzero(got >= need[own, None])
            fresh.append((own[i], ids[rows][j], got[i, j]))
        at, found, score = (np.concatenate([a, *b]) for a, b in zip((at, found, score), zip(*fresh)))
        rank = np.lexsort((found, -1 - score, at))  # -1 - score, as the least long has no negative
        at, found, score = at[rank], found[rank], score[rank]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < k
        last = place[kept] == k - 1
        at, found, score = at[kept], found[kept], score[kept]
        need[at[last]] = np.maximum(need[at[last]], score[last])
    return at, found, score


def top_k(rows: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, id, score): for each query row, which is a row of ``rows``, its k best others by inner product."""
    spark = rows.sparkSession
    x = whole_vectors(rows, id_col, vector_col, scale).withColumn("dim", F.size("v"))
    q = whole_vectors(queries, id_col, vector_col, scale).withColumn("dim", F.size("v"))
    q = q.groupBy("id", "v", "dim").agg(F.count("*").alias("copies")).withColumn("q_key", F.md5(F.concat_ws(",", F.transform("v", lambda c: c.cast("string")))))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    limit = x.agg(F.max(square)).first()[0]
    limit = (limit or 0.0) * (1 + 1e-12)
    sample = x.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toPandas()  # a fixed number of rows: pivots, and the floors
    pivots = {}
    for dim, part in sample.groupby("dim"):
        vectors = np.array(part["v"].tolist(), np.float64).reshape(len(part), dim)
        chosen = choose_pivots(vectors, PIVOTS)
        heights = np.sqrt(np.maximum(limit - (vectors**2).sum(1), 0))
        pivots[int(dim)] = (vectors[chosen], heights[chosen], vectors)
    held = spark.sparkContext.broadcast(pivots)
    none = (np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))

    def placed(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """The rows of each length, their distances to its pivots and their clusters."""
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            v = _matrix(part.column(1)).astype(np.float64).reshape(len(part), dim)
            p, h, _ = held.value.get(int(dim), none)
            far = _distances(v, np.sqrt(np.maximum(limit - (v**2).sum(1), 0)), p.reshape(-1, dim), h).astype(np.float32)
            yield part, far, far.argmin(1).astype(np.int32) if far.shape[1] else np.zeros(len(v), np.int32)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch's clusters with their rows and their least and largest distances."""
        for batch in batches:
            for part, far, cluster in placed(batch):
                for c in np.unique(cluster):
                    own = far[cluster == c]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part.column(2)[0].as_py(), int(c), len(own))] + [pa.array([x.tolist()], pa.list_(pa.float32())) for x in (own.min(0), own.max(0))], names=["dim", "cluster", "n", "low", "high"])

    def with_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, far, cluster in placed(batch):
                again = pd.Series(part.column(0).to_numpy()).groupby(part.column(0).to_numpy()).cumcount().to_numpy()  # deals out rows that repeat
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(far), pa.array(cluster), pa.array(again, pa.int64())], names=["id", "v", "dim", "far", "cluster", "again"])

    edges = x.mapInArrow(spans, "dim long, cluster long, n long, low array<float>, high array<float>")
    table: dict[int, list] = {}
    found = edges.groupBy("dim", "cluster").agg(F.sum("n").alias("n"), *(f(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(PIVOTS) for c, f in (("low", F.min), ("high", F.max))))
    for r in found.collect():  # at most PIVOTS rows a length of vectors
        count = len(pivots[r.dim][0]) if r.dim in pivots else 0
        table.setdefault(r.dim, []).append((r.cluster, -(-r.n // ROW_BLOCK), np.array([r[f"low{i}"] for i in range(count)], np.float64), np.array([r[f"high{i}"] for i in range(count)], np.float64)))
    cells = spark.sparkContext.broadcast(table)
    x = x.mapInArrow(with_table, "id long, v array<bigint>, dim int, far array<float>, cluster int, again long")
    query_blocks = max(1, -(-q.count() // QUERY_BLOCK))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its distances and its floor, once for each block of each cluster that may hold one of its best."""
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                known = cells.value.get(int(dim))
                if not known:
                    continue
                v = _matrix(part.column(1)).astype(np.float64).reshape(len(part), dim)
                p, h, some = held.value.get(int(dim), none)
                far = _distances(v, np.zeros(len(v)), p.reshape(-1, dim), h)
                floor = np.full(len(v), -np.inf)
                if len(some) > k:
                    floor = np.partition(v @ some.T, -(k + 1), axis=1)[:, -(k + 1)]
                    floor -= np.abs(floor) * 1e-9 + 1
                low, high = np.stack([c[2] for c in known]), np.stack([c[3] for c in known])
                live = most_score((v**2).sum(1), limit, far, low, high) >= floor[:, None]
                blocks = np.array([c[1] for c in known])
                i, c = np.nonzero(live)
                at, cluster = np.repeat(i, blocks[c]), np.repeat(np.array([c[0] for c in known])[c], blocks[c])
                block = np.arange(len(at)) - np.repeat(np.cumsum(blocks[c]) - blocks[c], blocks[c])
                own = pa.RecordBatch.from_arrays([*part.columns, _lists(far.astype(np.float32)), pa.array(floor), pa.array(_squares(_matrix(part.column(1)).reshape(len(part), dim)))], names=[*part.schema.names, "far", "floor", "self"])
                for start in range(0, len(at), 4096):
                    some_at = slice(start, start + 4096)
                    rows = own.take(pa.array(at[some_at]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cluster[some_at], pa.int32()), pa.array(block[some_at], pa.int32())], names=[*rows.schema.names, "cluster", "rb"])

    q_schema = "id long, v array<bigint>, dim int, copies long, q_key string, far array<float>, floor double, self long, cluster int, rb int"
    q = q.select("id", "v", "dim", "copies", "q_key").mapInArrow(to_cells, q_schema).withColumn("qb", F.pmod(F.xxhash64("q_key"), F.lit(query_blocks)).cast("int"))
    blocks = F.broadcast(spark.createDataFrame([(d, c[0], c[1]) for d, known in table.items() for c in known], "dim int, cluster int, blocks int"))  # PIVOTS rows a length
    x = x.join(blocks, ["dim", "cluster"]).withColumn("rb", F.pmod(F.xxhash64("id", "v", "again"), F.col("blocks")).cast("int"))
    q = cut(q)
    live = q.groupBy("dim", "cluster").agg(F.collect_set("qb").alias("qbs"))  # PIVOTS rows a length; a row goes where a query of the block came
    x = x.join(F.broadcast(live), ["dim", "cluster"]).withColumn("qb", F.explode("qbs")).select("id", "v", "dim", "far", "cluster", "rb", "qb")
    names = ("dim", "cluster", "rb", "qb")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "q_key": pa.array([], pa.string()), "copies": pa.array([], pa.int64()), "self": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        dim = left["dim"][0].as_py()
        ids, v, far = left["id"].to_numpy(), _matrix(left["v"]).reshape(len(left), dim), _matrix(left["far"]).reshape(len(left), -1)
        qv, q_far = _matrix(right["v"]).reshape(len(right), dim), _matrix(right["far"]).reshape(len(right), -1)
        at, found, score = search_cell(ids, v, far, qv, q_far, limit, right["floor"].to_numpy().copy(), k + 1)
        own = right.select(["id", "q_key", "copies", "self"]).take(pa.array(at))
        return pa.table({"query_id": own["id"], "q_key": own["q_key"], "copies": own["copies"], "self": own["self"], "id": found, "score": score})

    found = x.groupBy(*names).cogroup(q.groupBy(*names)).applyInArrow(cell, "query_id long, q_key string, copies long, self long, id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "id"))
    top = found.withColumn("rank", best).where(F.col("rank") <= k + 1)  # with the query itself, if it is among its best
    top = top.groupBy("query_id", "q_key", "copies", "self").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("top"))
    own = F.array_position(F.transform("top", lambda r: (r["id"] == F.col("query_id")) & (r["score"] == F.col("self"))), True)
    others = F.slice(F.filter("top", lambda r, i: i + 1 != own), 1, k)
    top = top.select("query_id", F.explode(F.array_repeat(others, F.col("copies").cast("int"))).alias("top")).select("query_id", F.posexplode("top").alias("rank", "r"))
    return top.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("r.id").alias(id_col), "r.score")
