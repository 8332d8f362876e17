"""Audit of how far the sources of a language part from each other, by a recount over minimal perfect hashes.

First pass: the exact number of documents of each (language, term); terms of enough documents are kept. The kept terms of a
language are dealt into shards by their hash, and each shard becomes a minimal perfect hash (hash and displace: buckets of
two keys or more try displacements until all their keys fall into free slots, keys alone in a bucket take what is left), with
its terms in slot order beside it. Second pass: the hashes go to the tasks, at most ``MOST_KEYS`` terms at a time (more are
taken in several passes); a word's slot counts if the term stored there is the word, in a dense array for each (language,
source) and shard. A task that holds more than ``MOST_CELLS`` slots passes them on and starts anew. Arrays of one group and
shard are added up in a tree of ``FAN`` at most.

Shares are whole numbers, 1 + floor(unit * (count + smooth) / (N + smooth * V)); all arithmetic is exact. Pairs of sources are
weighed in cells of a shard and two blocks of sources.

Cases: null text, language and source count as empty ones, and the empty ones are groups like any other; groups without
terms, and languages of which no term is kept, are groups (their pairs have value 0 if V is 0); equal values go by the item's
bytes; repeated rows count each; texts are read whole; of the input only the three named columns are read, so other columns
can't clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, slices, tokens_of

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_KEYS, MOST_KEYS, MOST_CELLS, FAN, SOURCE_BLOCK = 8192, 1 << 20, 1 << 22, 256, 64
BUCKET, TRIES = 3, 1 << 16
EVEN = np.uint64(0x9E3779B97F4A7C15)


def hash_terms(terms: list[str], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t, seed) for t in terms], np.uint64)


def slots_of(h: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Slots of hashed terms; ``shift``: the displacements of their buckets. Before the remainder by the number of keys."""
    x = (h ^ (shift.astype(np.uint64) * EVEN)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def build_hash(terms: list[str]) -> tuple[int, np.ndarray, list[str]]:
    """(seed, shifts, terms in slot order). A shift below zero is the slot itself, negated less one: of a key alone in its bucket."""
    n, buckets = len(terms), max(1, -(-len(terms) // BUCKET))
    for seed in range(64):
        h = hash_terms(terms, seed)
        bucket = bucket_of(h, buckets)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        size = np.diff(starts)
        shift, free, owner = np.zeros(buckets, np.int64), np.ones(n, bool), np.full(n, -1, np.int64)
        for b in np.argsort(-size, kind="stable")[: (size > 1).sum()]:
            keys = order[starts[b] : starts[b + 1]]
            for first in range(0, TRIES, 64):
                tried = np.arange(first, first + 64)
                slots = (slots_of(h[keys][None], tried[:, None]) % np.uint64(n)).astype(np.int64)
                ordered = np.sort(slots, axis=1)
                fits = np.flatnonzero(free[slots].all(axis=1) & (np.diff(ordered, axis=1) > 0).all(axis=1))
                if len(fits):
                    shift[b], at = tried[fits[0]], slots[fits[0]]
                    free[at], owner[at] = False, keys
                    break
            else:
                break
        else:
            alone, rest = np.flatnonzero(size == 1), np.flatnonzero(free)
            shift[alone], owner[rest] = -1 - rest, order[starts[alone]]
            return seed, shift, [terms[i] for i in owner]
    raise ValueError("no displacement found")  # keys that repeat


def _terms(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Distinct words and languages of a batch (language, source, text), and at each token its word and its document."""
    words, ids, bounds = tokens_of(pc.ascii_lower(batch.column(2)), SEPARATORS)
    return words, batch.column(0).dictionary_encode(), ids, np.repeat(np.arange(batch.num_rows), np.diff(bounds))


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n_docs), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            words, langs, ids, doc = _terms(batch)
            lang = langs.indices.to_numpy()
            pairs = np.unique(doc.astype(np.int64) * (len(words) + 1) + ids)
            found, n = np.unique(lang[pairs // (len(words) + 1)].astype(np.int64) * (len(words) + 1) + pairs % (len(words) + 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(found // (len(words) + 1))), words.take(pa.array(found % (len(words) + 1))), pa.array(n, pa.int64())], names=["lang", "term", "n"])

    return docs.mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n_docs"))


def hash_shards(kept: DataFrame, shards: int) -> DataFrame:
    """(lang, shard, seed, shifts, terms): a minimal perfect hash for each shard of each language's terms."""

    def build(part: pa.Table) -> pa.Table:
        seed, shift, terms = build_hash(part["term"].to_pylist())
        return pa.table({"lang": part["lang"][:1], "shard": part["shard"][:1], "seed": pa.array([seed], pa.int32()), "shifts": pa.array([shift.tolist()], pa.list_(pa.int64())), "terms": pa.array([terms], pa.list_(pa.string()))})

    dealt = kept.select("lang", "term", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shard int, seed int, shifts array<long>, terms array<string>")


class Recount:
    """Counts of a bounded number of shards; built once a task from what was sent to it."""

    def __init__(self, parts: list[tuple[str, int, int, np.ndarray, pa.Array]]) -> None:
        self.of: dict[str, list] = {}
        for lang, shard, seed, shift, terms in parts:
            self.of.setdefault(lang, []).append((shard, seed, shift, terms))

    def __call__(self, batch: pa.RecordBatch, dense: dict) -> None:
        """Add the batch's counts to the arrays of ``dense``, by (lang, source, shard)."""
        words, langs, ids, doc = _terms(batch)
        texts, sources = words.to_pylist(), batch.column(1).dictionary_encode()
        lang_of, source_of = langs.indices.to_numpy(), sources.indices.to_numpy()
        lang_names, source_names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
        seeds: dict[int, np.ndarray] = {}
        token_lang, token_source = lang_of[doc], source_of[doc].astype(np.int64)
        for code, lang in enumerate(lang_names):
            mine = token_lang == code if len(lang_names) > 1 else slice(None)
            own_ids, own_source = ids[mine], token_source[mine]
            for shard, seed, shift, terms in self.of.get(lang, ()):
                if seed not in seeds:
                    seeds[seed] = hash_terms(texts, seed)
                h, n = seeds[seed], len(terms)
                d = shift[bucket_of(h, len(shift))]
                slot = np.where(d < 0, -1 - d, (slots_of(h, d) % np.uint64(n)).astype(np.int64))
                is_term = pc.equal(terms.take(pa.array(slot)), words).to_numpy(zero_copy_only=False).astype(bool)
                slot = np.where(is_term, slot, -1)[own_ids]
                hit = slot >= 0
                cells, counts = np.unique(own_source[hit] * n + slot[hit], return_counts=True)
                at = np.searchsorted(cells, np.arange(len(source_names) + 1) * n)
                for s in np.flatnonzero(np.diff(at)):
                    key = (lang, source_names[s], shard)
                    if key not in dense:
                        dense[key] = np.zeros(n, np.int64)
                    dense[key][cells[at[s] : at[s + 1]] - s * n] += counts[at[s] : at[s + 1]]


COUNTED = "lang string, source string, shard int, counts array<long>"


def _dense(found: dict) -> pa.RecordBatch:
    keys, arrays = list(found), list(found.values())
    ends = np.cumsum([0, *map(len, arrays)])
    counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays)))
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), counts], names=["lang", "source", "shard", "counts"])


def recount(docs: DataFrame, shards: DataFrame, total: int) -> DataFrame:
    """(lang, source, shard, counts) of each task's documents; every pass holds ``MOST_KEYS`` terms, give or take a shard."""
    spark, passes = docs.sparkSession, max(1, -(-total // MOST_KEYS))
    found = None
    for turn in range(passes):
        own = shards.where(F.pmod(F.xxhash64("lang", "shard"), F.lit(passes)) == turn) if passes > 1 else shards
        held = spark.sparkContext.broadcast([(r.lang, r.shard, r.seed, np.array(r.shifts, np.int64), r.terms) for r in own.toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            count, dense = Recount([(*x[:4], pa.array(x[4], pa.string())) for x in held.value]), {}
            for batch in slices(batches, 2048):
                count(batch, dense)
                if sum(map(len, dense.values())) > MOST_CELLS:
                    yield _dense(dense)
                    dense = {}
            if dense:
                yield _dense(dense)

        part = docs.mapInArrow(run, COUNTED)
        found = part if found is None else found.unionByName(part)
    return found


def add_up(counted: DataFrame, *keys: str) -> DataFrame:
    """One array for each key, the sum of its arrays; of a key with more than ``FAN`` arrays about ``FAN`` are added first, again and again."""

    def add(part: pa.Table) -> pa.Table:
        ends, flat = np.concatenate([[0], np.cumsum(pc.list_value_length(part["counts"]).to_numpy())]), part["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out = np.zeros(int(np.diff(ends).max()), np.int64)
        for a, b in zip(ends, ends[1:]):
            out[: b - a] += flat[a:b]
        return pa.table([part[k][:1] for k in keys] + [pa.array([out.tolist()], pa.list_(pa.int64()))], names=[*keys, "counts"])

    schema = ", ".join(x for x in COUNTED.split(", ") if x.split()[0] in (*keys, "counts"))
    most = counted.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while most > FAN:
        lanes = -(-most // FAN)  # fewer each time
        lane = F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).alias("lane")
        counted = cut(counted.select(*keys, "counts", lane).groupBy(*keys, "lane").applyInArrow(add, schema))
        most = counted.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return counted.select(*keys, "counts").groupBy(*keys).applyInArrow(add, schema)


def divergence(docs: DataFrame, *, least_docs: int = 30, smooth: int = 5, unit: int = 1_000_000_000, ranks: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group, ``pair`` rows with the sum of its shares' differences from each
    other source of the language, and ``term`` rows with the terms whose share is most above the language's."""
    docs = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = cut(document_counts(docs).where(F.col("n_docs") >= least_docs).select("lang", "term"))
    vocab = kept.groupBy("lang").agg(F.count("*").alias("V"))
    size = vocab.agg(F.max("V"), F.sum("V")).first()
    n_shards = max(1, -(-(size[0] or 0) // SHARD_KEYS))
    shards = cut(hash_shards(kept, n_shards))
    groups = docs.groupBy("lang", "source").count().select("lang", "source")
    none = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    sizes = shards.select("lang", "shard", F.size("terms").alias("n"))
    none = none.join(sizes, ["lang", "shard"], "left").select("lang", "source", "shard", F.array_repeat(F.lit(0).cast("long"), F.coalesce("n", F.lit(0))).alias("counts"))
    counted = cut(add_up(cut(recount(docs, shards, size[1] or 0).unionByName(none)), "lang", "source", "shard"))

    def shares(df: DataFrame, *keys: str) -> DataFrame:
        """Arrays of shares; the products are decimals, so that no count is too large."""
        n = df.groupBy(*keys).agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("N"))
        n = n.join(vocab, "lang", "left").select(*keys, (F.col("N") + smooth * F.coalesce("V", F.lit(0))).cast("decimal(20,0)").alias("base"))
        share = F.transform("counts", lambda c: F.lit(1).cast("long") + F.call_function("div", (c + smooth).cast("decimal(18,0)") * F.lit(unit).cast("decimal(12,0)"), F.col("base")))
        return df.join(n, list(keys)).withColumn("shares", share)

    ours = cut(shares(counted, "lang", "source"))
    theirs = shares(add_up(counted, "lang", "shard"), "lang").select("lang", "shard", F.col("shares").alias("all_shares"))

    # Terms: a group's against its language's.
    one = ours.join(theirs, ["lang", "shard"]).join(shards.select("lang", "shard", "terms"), ["lang", "shard"])
    one = one.select("lang", "source", F.inline(F.arrays_zip("terms", "counts", "shares", "all_shares"))).where("counts > 0 and shares > all_shares")
    one = one.select("lang", "source", F.lit("term").alias("part"), F.col("terms").alias("item"), (F.col("shares") - F.col("all_shares")).alias("value"))

    # Pairs: two blocks of a shard's sources meet in a cell.
    blocks = max(1, -(-(groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) // SOURCE_BLOCK))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    sides = ours.select("lang", "shard", "source", "shares", block.alias("b")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sides = sides.select("lang", "shard", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "source", "shares")

    def cell(part: pa.Table) -> pa.Table:
        names, b = part["source"].to_pylist(), part["b"].to_numpy()
        x = part["shares"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)
        i, j = part["i"][0].as_py(), part["j"][0].as_py()
        own, rest = np.flatnonzero(b == i), np.flatnonzero(b == j)
        out: list[tuple[str, str, int]] = []
        for a in own:
            far = np.abs(x[rest] - x[a]).sum(1)
            for c, v in zip(rest, far):
                if c != a:
                    out.append((names[a], names[c], int(v)))
                    if i != j:
                        out.append((names[c], names[a], int(v)))
        return pa.table({"lang": pa.array([part["lang"][0].as_py()] * len(out), pa.string()), "source": pa.array([o[0] for o in out], pa.string()), "item": pa.array([o[1] for o in out], pa.string()), "value": pa.array([o[2] for o in out], pa.int64())})

    two = sides.groupBy("lang", "shard", "i", "j").applyInArrow(cell, "lang string, source string, item string, value long")
    two = two.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return two.withColumn("rank", rank).unionByName(one.withColumn("rank", rank).where(F.col("rank") <= ranks))
