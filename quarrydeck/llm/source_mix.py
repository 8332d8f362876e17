"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Each source gets its weight's share of the words of the mix; no source may give more than ``max_epochs`` times its own
words, and what that cuts off goes to the others in proportion to their weights, until none is above. A source that is
asked for r epochs gives each row floor(r) times, and the rest f of r by one systematic sample over all its rows, smaller
ones first: every 1/f-th row once more. A row's place is its place among the rows of its size plus the number of smaller rows,
which comes from a table of sizes, so no task puts a source in order. As sizes rise along the places, the words taken
miss the target by less than the largest row; of ``PHASES`` seeded starts the one that misses it least is taken.

All of it is DataFrame functions. Cases: a null text has size 0; a null source is a source of its own; a source without
words has target 0; rows with equal ids, texts or sizes are rows of their own, and rows equal in all of these may be taken
unequally often; an empty table gives an empty table; texts of any length are counted whole. A source without a row in
``weights`` weighs 1, one with a weight of 0 or less gives nothing. Other columns pass through, but one that is called like
a made column (``size``, ``source_size``, ``target``, ``repeats``, ``taken``) is replaced by it; ``sample_mix`` keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Rows of a source and size that one task puts in order, and the phases tried for a source.
STRATUM_ROWS, PHASES = 1 << 16, 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 out of the seed and the parts, the same in any SQL engine with MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def fill_targets(sources: DataFrame, *, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Add ``target`` to (source, source_size, weight), one row a source.

    Each round gives all sources their weight's share of what the capped ones leave, and caps those that reach their end,
    until no round caps another one. The rounds are aggregations; the driver sees three numbers of each.
    """
    cap = F.col("source_size") * float(max_epochs)
    live = F.coalesce(F.col("weight") > 0, F.lit(False))
    total, left, heavy, count = *sources.where(live).agg(F.sum("source_size") * float(share), F.sum("source_size") * float(share), F.sum("weight")).first(), -1
    while heavy:
        full = F.lit(left) * F.col("weight") >= cap * F.lit(heavy)
        taken, rest, capped = sources.where(live).agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if capped == count or not rest:
            break
        left, heavy, count = total - (taken or 0.0), rest, capped
    if not heavy:
        return sources.withColumn("target", F.lit(0.0))
    own = F.when(F.lit(left) * F.col("weight") >= cap * F.lit(heavy), cap).otherwise(F.col("weight") * F.lit(left / heavy))
    return sources.withColumn("target", F.when(live, own).otherwise(0.0))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add the place (from 0) in the order of ``key``, nulls last, by a range partitioning: no task gets all rows."""
    parts = cut(df.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(key).asc_nulls_last()))
    return parts.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + inner - 1).drop("__part", "__before")


def _mixed(docs: DataFrame, weights: DataFrame | None, id_col: str, text_col: str, source_col: str, share: float, max_epochs: float, seed: int) -> DataFrame:
    """(row, size, source_size, target, repeats): each row of ``docs`` as one column, and what the mix makes of it."""
    at = lambda c: F.col(f"`{c}`")
    key = F.coalesce(F.concat(F.lit("s"), at(source_col).cast("string")), F.lit("none"))
    sized = docs.select(F.struct(*(at(c) for c in docs.columns)).alias("row"), key.alias("key"), at(source_col).alias("source"), at(id_col).alias("id"), word_count(f"`{text_col}`").alias("size"), seeded(seed, at(id_col)).alias("draw"))
    light = docs.select(key.alias("key"), at(source_col).alias("source"), word_count(f"`{text_col}`").alias("size"), seeded(seed, at(id_col)).alias("draw"))
    sizes = cut(light.groupBy("key", "size").agg(F.first("source").alias("source"), F.count("*").alias("n")))  # a row for each different size of a source
    sources = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    if weights is None:
        sources = numbered(sources, "source", "place")
        sources = sources.withColumn("weight", F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), (F.pmod("place", F.lit(3)) + 1).cast("int")))
    else:
        own = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(own, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    sources = cut(sources)  # one row a source
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = fill_targets(sources, share=share, max_epochs=max_epochs).withColumn("epochs", epochs).withColumn("part", F.col("epochs") - F.floor("epochs"))
    total = sources.agg(F.count("*"), F.sum("n")).first()

    # Sizes that more than ``STRATUM_ROWS`` rows and one in 4,096 have, fewer than so many, are dealt by their draw.
    many = sizes.where((F.col("n") > STRATUM_ROWS) & (F.col("n") > F.lit(total[1] or 0) / 4096)).select("key", "size", F.ceil(F.col("n") / STRATUM_ROWS).alias("buckets"))

    def dealt(df: DataFrame) -> DataFrame:
        bucket = F.floor(F.col("draw") * F.coalesce("buckets", F.lit(1)) / F.lit(4294967296.0)).cast("int")
        return df.join(F.broadcast(many), ["key", "size"], "left").withColumn("bucket", bucket).drop("buckets")

    apart = dealt(light.join(F.broadcast(many.select("key", "size")), ["key", "size"], "left_semi")).groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    strata = sizes.join(F.broadcast(many), ["key", "size"], "left_anti").select("key", "size", F.lit(0).alias("bucket"), "n").unionByName(apart)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("size", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strata = strata.withColumn("before", before)

    def extra(last, n, phase):
        return F.floor(last * F.col("part") + phase) - F.floor((last - n) * F.col("part") + phase)

    # Of the phases that a source can start with, the one that takes most nearly its target.
    first = seeded(seed, F.col("source")) / F.lit(4294967296.0)
    phases = [(F.lit(float(k)) + first) / F.lit(float(PHASES)) for k in range(PHASES)]
    tried = strata.join(filled.select("key", "source", "part"), "key")
    sums = tried.groupBy("key").agg(*(F.sum(F.col("size") * extra(F.col("before") + F.col("n"), F.col("n"), p)).alias(f"p{k}") for k, p in enumerate(phases)))
    off = F.array(*(F.struct(F.abs(F.col(f"p{k}") - F.col("part") * F.col("source_size")).alias("off"), F.lit(k).alias("k"), p.alias("phase")) for k, p in enumerate(phases)))
    filled = cut(filled.join(sums, "key").withColumn("phase", F.array_min(off)["phase"]).select("key", "n", "source_size", "target", "epochs", "part", "phase"))

    strata = strata.drop("n").join(filled.drop("n"), "key")
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("draw", "id"))
    df = dealt(sized).withColumn("place", place).join(strata, ["key", "size", "bucket"])
    repeats = F.floor("epochs") + extra(F.col("before") + F.col("place"), F.lit(1), F.col("phase"))
    return df.select("row", "size", "source_size", "target", repeats.cast("int").alias("repeats"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Add size, source_size, target (of the source), repeats and taken (words, repeats counted) to every row.

    ``weights``: (source, weight). Without it the sources weigh 3, 1, 2 and so on in the order of their code points.
    """
    df = _mixed(docs, weights, id_col, text_col, source_col, share, max_epochs, seed)
    made = {c: F.col(c) for c in ("size", "source_size", "target", "repeats")}
    made["taken"] = (F.col("size") * F.col("repeats")).cast("long")
    return df.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made), *(x.alias(c) for c, x in made.items()))


def sample_mix(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns as they are, each as often as it is taken."""
    df = _mixed(docs, weights, id_col, text_col, source_col, share, max_epochs, seed).where("repeats > 0")
    return df.withColumn("k", F.explode(F.array_repeat(F.lit(0), F.col("repeats")))).select("row.*")


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM per),
filled AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
  sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM weighed),
capped AS (SELECT *, (total - before_) * weight >= cap * heavy AS full_ FROM filled),
target AS (SELECT source, source_size, n, CASE WHEN full_ THEN cap ELSE weight * ((total - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT full_ THEN weight END) OVER ()) END AS target FROM capped),
rows_ AS (SELECT d.doc_id, d.size, t.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS epochs, epochs - floor(epochs) AS part,
  row_number() OVER (PARTITION BY t.source ORDER BY d.size, ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '~')), 1, 8))::BIGINT, d.doc_id) AS place,
  ('0x' || substr(md5('17:' || coalesce(t.source, '~')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS first_ FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
tried AS (SELECT *, k, (k::DOUBLE + first_) / 16.0::DOUBLE AS phase, size * (floor(place * part + phase) - floor((place - 1) * part + phase)) AS more FROM rows_, (SELECT unnest(range(16)) AS k)),
off AS (SELECT source, k, abs(sum(more)::BIGINT - any_value(part) * any_value(source_size)) AS off FROM tried GROUP BY source, k),
best AS (SELECT source, min_by(k, (off, k)) AS k FROM off GROUP BY source)
SELECT doc_id, size, source_size, target, (size * floor(epochs) + more)::BIGINT AS taken FROM tried JOIN best ON tried.k = best.k AND tried.source IS NOT DISTINCT FROM best.source
"""
