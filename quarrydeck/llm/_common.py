"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, which survives the loss of executors.

    The folder is the session's ``spark.checkpoint.dir``, see ``shared_folder``.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session may go without: it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def join_one(rows: DataFrame, facts: DataFrame, key: str, total: int, share: int = 4096, spread: Column | None = None) -> DataFrame:
    """Inner join of ``rows`` with at most one row of ``facts`` a key; ``facts`` has n, the key's count of rows.

    A key with more than one of ``share`` of all ``total`` rows is dealt over n * share / total tasks and its fact goes to each
    of them; such keys are fewer than ``share``, whatever the input, so their list is broadcast. The rows meet in one join.
    ``spread`` deals out a key's rows: by default the hash of the row, else a number that stays the same if a task runs again.
    """
    many = F.col("n") > total / share
    lanes = F.ceil(F.col("n") * share / max(total, 1)).cast("int")
    hot = F.broadcast(facts.where(many).select(F.col(key).alias("__hot"), lanes.alias("__lanes")))
    lane = F.coalesce(F.pmod(F.xxhash64(*rows.columns) if spread is None else spread, F.col("__lanes")).cast("int"), F.lit(0))
    dealt = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__lane", lane).drop("__hot", "__lanes")
    copies = facts.withColumn("__lane", F.explode(F.sequence(F.lit(0), F.when(many, lanes - 1).otherwise(0)))).drop("n")
    return dealt.join(copies, [key, "__lane"]).drop("__lane")


def hash_below(share, *parts):
    """True for about ``share`` (0 to 1) of the rows, by the hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) < share * (1 << 30)


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo ``n`` (null for null)."""
    return F.crc32(F.col(column).cast("string")) % n


def arrow_map(rows: DataFrame, made, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` for tables with any column names, also repeated ones: inside, columns are known by their place."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    inner = StructType([StructField(f"_{i}", f.dataType, True) for i, f in enumerate(schema)])
    names = inner.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in made(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    return rows.toDF(*(f"_{i}" for i in range(len(rows.columns)))).mapInArrow(run, inner).toDF(*schema.names)


def free_name(name: str, *taken: DataFrame) -> str:
    """``name``, with as many underscores behind it as it takes to be none of the tables' columns."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker's arrays stay small; freed Arrow memory goes back each time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            pa.default_memory_pool().release_unused()


def word_blocks(words: pa.Array, rows: int = 1 << 15) -> Iterator[pa.Array]:
    for at in range(0, len(words), rows):
        yield words.slice(at, rows)


def tokens_of(texts: pa.Array, pattern: str | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens of a batch, the token number at each place, and where each text starts (one more offset at the end).

    Tokens are runs without ASCII white space, or the parts between matches of ``pattern``; empty parts are left out.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(texts) if pattern is None else pc.split_pattern_regex(texts, pattern)
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    full = np.concatenate([[0], np.cumsum(ids != pc.index(words, "").as_py())]) if len(ids) else np.zeros(1, np.int64)
    bounds = full[np.concatenate([[0], np.cumsum(lengths)])]
    return words, ids[np.diff(full) > 0], bounds


def sampled_words(texts: pa.Array, most: int, pattern: str | None = None, run: int = 64) -> list[str]:
    """Each text's words with blanks between; of more than ``most``, runs of words from all over it, drawn by a seed."""
    words, ids, at = tokens_of(texts, pattern)
    known, out = words.to_pylist(), []
    for a, b in zip(at, at[1:]):
        own = ids[a:b]
        if len(own) > most:
            chosen = np.sort(np.random.default_rng(len(own)).permutation(len(own) // run)[: max(most // run, 1)])
            own = own[(chosen[:, None] * run + np.arange(run)).ravel()]
        out.append(" ".join([known[i] for i in own]))
    return out


def framed_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' UTF-8 bytes between a start and an end mark, in one array, and each word's offset in it."""
    framed = pc.binary_join_element_wise("\x02", words, "\x03", "")
    if len(framed) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    framed = pa.concat_arrays([framed])
    offsets = np.frombuffer(framed.buffers()[1], np.int32)[framed.offset : framed.offset + len(framed) + 1].astype(np.int64)
    return np.frombuffer(framed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


PRIME = np.uint64(0x9E3779B97F4A7C15)


def subword_buckets(words: pa.Array, orders: tuple[int, ...], bits: int, affixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word as (bucket, word number): the word itself, its byte n-grams and its affixes.

    Grams are taken over the framed bytes, so that a gram at an edge differs from the same gram inside.
    """
    buf, at = framed_bytes(words)
    n = len(at) - 1
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    left = at[1:][owner] - np.arange(len(buf))  # bytes from here to the end of the word
    wide = buf.astype(np.uint64)
    shift = np.uint64(64 - bits)

    def bucket(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h ^ np.uint64(kind * 0x632BE5AB)) * PRIME
        return ((h ^ (h >> np.uint64(29))) * PRIME >> shift).astype(np.int64)

    place = np.arange(len(buf)) - at[:-1][owner]
    powers = np.cumprod(np.full(int(size.max()), PRIME | np.uint64(1), np.uint64))
    found = [(bucket(np.add.reduceat(wide * powers[place], at[:-1]), 1), np.arange(n))]
    h = np.zeros(len(buf), np.uint64)
    for order in range(1, max(orders + affixes, default=0) + 1):
        h[: len(buf) - order + 1] = h[: len(buf) - order + 1] * np.uint64(257) + wide[order - 1 :] + np.uint64(1)
        if order in orders:
            whole = left >= order
            found.append((bucket(h[whole], 2 + order), owner[whole]))
        if order in affixes:
            for kind, spot in ((40, at[:-1]), (60, at[1:] - order)):
                fits = size >= order
                found.append((bucket(h[spot[fits]], kind + order), np.flatnonzero(fits)))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
