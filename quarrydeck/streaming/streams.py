"""Structured Streaming forms of the polling loops; each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.inventory import upsert_by_key


def read_events(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """A file-source stream whose ``ts`` is a timestamp (Parquet's zoneless times are cast)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def current_rows(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The rows of a table of bucket versions: each bucket's newest version, or the newest before a batch."""
    df = spark.read.parquet(target)
    if before is not None:
        df = df.where(F.col("version") < before)
    newest = df.groupBy("bucket").agg(F.max("version").alias("version"))  # one row a bucket, from the folders' names
    return df.join(F.broadcast(newest), ["bucket", "version"])


def _drop_old_versions(spark: SparkSession, target: str, touched: list[int], batch_id: int) -> None:
    """Of the buckets that a batch has written, keep its version and the one before, from which it can run again."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in touched:
        found = [f.getPath() for f in files.listStatus(path(f"{target}/bucket={bucket}"))]
        versions = sorted((int(p.getName().partition("=")[2]), p) for p in found if p.getName().startswith("version="))
        for _, old in [v for v in versions if v[0] < batch_id][:-1]:
            files.delete(old, True)


def stream_ingest(stream: DataFrame, target: str, keys: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64, newest: Sequence[str] = ()):
    """Upsert each micro-batch into a Parquet table of ``buckets`` by the keys' hash; ``current_rows`` reads it.

    Of a key's rows in a batch the one with the greatest ``newest`` columns stays, then the greatest other values, so a batch
    that runs again takes the same rows. A batch rewrites only the buckets that its keys fall into, as version ``batch_id``, and
    then removes their versions before the last one, so the table holds at most twice its live rows. A batch that runs again
    after a failure reads the versions before its own and writes the same ones again. A reader that started before a batch
    may lose the files it reads if it takes longer than the next two batches of a bucket.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = transform(batch) if transform else batch
        names, rest = fresh.columns, [*newest, *(c for c in fresh.columns if c not in keys and c not in newest)]
        if rest:
            fresh = fresh.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__x")).select(*keys, "__x.*").select(*names)
        else:
            fresh = fresh.dropDuplicates(keys)
        fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        rows = fresh
        if batch_id > 0:
            known = current_rows(spark, target, batch_id).where(F.col("bucket").isin(touched)).drop("version")
            rows = upsert_by_key(known, fresh, keys)
        rows = rows.withColumn("version", F.lit(batch_id)).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(target)
        fresh.unpersist()
        _drop_old_versions(spark, target, touched, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(stream: DataFrame, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(events: DataFrame, size: str = "72 hours", by: tuple[str, ...] = ("event_type",), lateness: str = "1 hour") -> DataFrame:
    return _marked(events, lateness).groupBy(F.window("ts", size), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding_counts(events: DataFrame, size: str = "168 hours", step: str = "24 hours", by: tuple[str, ...] = ("event_type",), lateness: str = "1 hour") -> DataFrame:
    return _marked(events, lateness).groupBy(F.window("ts", size, step), *by).agg(F.count("*").alias("n"))


def session_windows(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    return _marked(events, lateness).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def _marked(events: DataFrame, lateness: str) -> DataFrame:
    return events.withWatermark("ts", lateness) if events.isStreaming else events


def stage_progress_stream(events: DataFrame, stage: str = "stage", status: str = "status") -> DataFrame:
    """Counts by stage and status, for update or complete mode."""
    return events.groupBy(stage, status).agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def stream_stream_join(done: DataFrame, embedded: DataFrame, key: str, within: str = "2 hours", lateness: str = "1 hour") -> DataFrame:
    """Extraction ends joined to embedding ends of the same key at most ``within`` later."""
    a = _marked(done, lateness).select(F.col(key).alias("a_key"), F.col("ts").alias("a_ts"))
    b = _marked(embedded, lateness).select(F.col(key).alias("b_key"), F.col("ts").alias("b_ts"))
    return a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {within}")))


def split_late(batch: DataFrame, watermark: pd.Timestamp) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch, for a side table of what the watermark would drop."""
    late = F.col("ts") < F.lit(watermark)
    return batch.where(~late), batch.where(late)


class StaleJobs(StatefulProcessor):
    """Per file: the last status; an event-time timer turns a silent running job into a stale one."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("status", T.StringType()), T.StructField("ts", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, ts = self.last.get() if self.last.exists() else (None, -1)
        for part in rows:
            part = part.sort_values("ts")
            at = int(part["ts"].iloc[-1].value // 1_000_000)
            if at >= ts:
                status, ts = part["status"].iloc[-1], at
        self.last.update((status, ts))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "running":
            self.handle.registerTimer(ts + self.timeout_ms)
        yield pd.DataFrame({"file_id": [key[0]], "status": [status], "stale": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"file_id": [key[0]], "status": ["failed"], "stale": [True]})

    def close(self) -> None:
        pass


def stale_detector(stream: DataFrame, timeout_ms: int, lateness: str = "1 minute") -> DataFrame:
    """(file_id, status, stale) from a stream of (file_id, status, ts); needs the RocksDB state store."""
    kind = dict(stream.dtypes)["file_id"]
    return stream.withWatermark("ts", lateness).groupBy("file_id").transformWithStateInPandas(StaleJobs(timeout_ms), f"file_id {kind}, status string, stale boolean", "Append", "EventTime")
