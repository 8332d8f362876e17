"""Registered queries: progress reports and the batch twins of the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import documents as D
from ..operators import reports as R
from ..streaming import streams as X
from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {views.strip()} " if views else "") + sql
        return f

    return add


BAD = "('failed', 'conversion_failed', 'enhanced_parser_not_ready')"
STAGES = ("probe", "parse", "extract", "vector")
LAST = V.JOBS + """,
lj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, stage ORDER BY started DESC, job_id DESC) AS k FROM jobs) WHERE k = 1),
w AS (SELECT file_id, max(source) AS source, """ + ", ".join(f"max(CASE WHEN stage = '{s}' THEN status END) AS {s}" for s in STAGES) + ", max(started) AS last_start FROM lj GROUP BY file_id)"  # fmt: skip


@query("SELECT source, count(*) AS files, count(*) FILTER (WHERE status = 'success') AS n_success, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE dup) AS duplicates, sum(size)::BIGINT AS bytes FROM (SELECT *, doc_id <> min(doc_id) OVER (PARTITION BY file_hash) AS dup FROM docs) GROUP BY source", V.DOCS)
def source_cards(spark, d):
    df = D.exact_duplicates(V.docs(spark, d)).withColumn("modified", F.lit(None).cast("timestamp"))
    return R.overview(df, ["source"]).select("source", "files", "n_success", "n_failed", "duplicates", "bytes")


@query("SELECT count(*) AS files, count(*) FILTER (WHERE status = 'success') AS n_success, count(*) FILTER (WHERE dup) AS duplicates FROM (SELECT *, doc_id <> min(doc_id) OVER (PARTITION BY file_hash) AS dup FROM docs)", V.DOCS)
def overview(spark, d):
    df = D.exact_duplicates(V.docs(spark, d)).withColumn("modified", F.lit(None).cast("timestamp"))
    return R.overview(df).select("files", "n_success", "duplicates")


def _eff(i: int) -> str:
    before = " OR ".join(f"coalesce({s} IN {BAD}, false)" for s in STAGES[:i]) or "false"
    return f"CASE WHEN {STAGES[i]} IS NOT NULL THEN {STAGES[i]} WHEN {before} THEN 'skipped' ELSE 'pending' END AS eff_{STAGES[i]}"


@query("SELECT file_id, " + ", ".join(_eff(i) for i in range(4)) + " FROM w", LAST)
def effective_stage_status(spark, d):
    return R.effective_status(R.wide_status(V.jobs(spark, d))).select("file_id", *(f"eff_{s}" for s in STAGES))


@query(f"SELECT source, stage, pending, processing, success, failed, round(100 * success / greatest(pending + processing + success + failed, 1), 2)::DOUBLE AS percent FROM (SELECT source, stage, count(*) FILTER (WHERE status IN ('pending', 'queued')) AS pending, count(*) FILTER (WHERE status IN ('processing', 'running')) AS processing, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status IN {BAD}) AS failed FROM lj GROUP BY ALL)", LAST)
def stage_progress(spark, d):
    return R.stage_progress(V.jobs(spark, d))


@query("SELECT file_id, " + "CASE " + " ".join(f"WHEN coalesce({s}, 'pending') <> 'success' THEN CASE WHEN {s} IN {BAD} THEN 'failed' WHEN {s} IN ('processing', 'running') THEN 'running' ELSE 'pending' END" for s in STAGES) + " ELSE 'success' END AS file_status, CASE " + " ".join(f"WHEN coalesce({s}, 'pending') <> 'success' THEN '{s}'" for s in STAGES) + " ELSE 'vector' END AS current_stage FROM w", LAST)
def file_state(spark, d):
    return R.file_state(R.wide_status(V.jobs(spark, d))).select("file_id", "file_status", "current_stage")


@query("SELECT file_id, 25.0 * (CASE WHEN p = 'success' THEN 1 + CASE WHEN q = 'success' THEN 1 + CASE WHEN r = 'success' THEN 1 + CASE WHEN s = 'success' THEN 1 WHEN s IN ('running', 'processing') THEN 0.5 ELSE 0 END WHEN r IN ('running', 'processing') THEN 0.5 ELSE 0 END WHEN q IN ('running', 'processing') THEN 0.5 ELSE 0 END WHEN p IN ('running', 'processing') THEN 0.5 ELSE 0 END)::DOUBLE AS percent FROM (SELECT file_id, coalesce(probe, 'pending') AS p, coalesce(parse, 'pending') AS q, coalesce(extract, 'pending') AS r, coalesce(vector, 'pending') AS s FROM w)", LAST)
def progress_percent(spark, d):
    return R.progress_percent(R.wide_status(V.jobs(spark, d))).select("file_id", "percent")


@query(f"SELECT batch_id, jobs, CASE WHEN running > 0 THEN 'running' WHEN queued > 0 THEN 'queued' WHEN failed > 0 AND success > 0 THEN 'partial_failed' WHEN failed > 0 THEN 'failed' ELSE 'success' END AS batch_status FROM (SELECT batch_id, count(*) AS jobs, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status IN {BAD}) AS failed, count(*) FILTER (WHERE status = 'success') AS success FROM jobs GROUP BY batch_id)", V.JOBS)
def batch_state(spark, d):
    return R.batch_state(V.jobs(spark, d)).select("batch_id", "jobs", "batch_status")


@query("SELECT file_id, CASE WHEN coalesce(probe = 'success' AND parse = 'success' AND extract = 'success' AND vector = 'success', false) THEN 'complete' WHEN " + " OR ".join(f"coalesce({s} IN {BAD}, false)" for s in STAGES) + " THEN 'failed' WHEN coalesce(parse = 'success', false) THEN 'searchable' WHEN coalesce(probe, parse, extract, vector) IS NOT NULL THEN 'in_progress' ELSE 'discovered' END AS lifecycle, coalesce(parse = 'success', false) AS first_round FROM w", LAST)
def lifecycle(spark, d):
    return R.lifecycle(R.wide_status(V.jobs(spark, d))).select("file_id", "lifecycle", "first_round")


@query(f"SELECT stage, CASE WHEN contains(lower(error), 'timed out') THEN 'timeout' WHEN contains(lower(error), 'model') THEN 'model' ELSE 'other' END AS reason, count(*) AS n, count(DISTINCT file_id) AS files FROM jobs WHERE status IN {BAD} GROUP BY ALL", V.JOBS)
def error_summary(spark, d):
    return R.error_summary(V.jobs(spark, d))


@query("SELECT source, count(*) AS documents, sum(coalesce(c, 0))::BIGINT AS chunks, sum(coalesce(u, 0))::BIGINT AS units FROM docs LEFT JOIN (SELECT doc_id, count(*) AS c FROM chunks GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS u FROM units GROUP BY 1) USING (doc_id) GROUP BY source", V.UNITS)
def task_stats(spark, d):
    u = V.units(spark, d)
    return R.task_stats(V.chunks(spark, d), u, u.where("false"), V.docs(spark, d)).select("source", "documents", "chunks", "units")


@query("SELECT kind, job_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END, started DESC, job_id) AS rank FROM (SELECT CASE WHEN stage IN ('probe', 'parse') THEN 'ingest' ELSE 'enhance' END AS kind, * FROM jobs)) WHERE rank <= 30", V.JOBS)
def jobs_feed(spark, d):
    j = V.jobs(spark, d)
    return R.jobs_feed({"ingest": j.where("stage in ('probe', 'parse')"), "enhance": j.where("stage in ('extract', 'vector')")}, 30).select("kind", "job_id", "rank")


@query(f"SELECT job_id, error FROM jobs WHERE status IN {BAD} AND contains(lower(error), 'timed')", V.JOBS)
def failures(spark, d):
    return R.failures(V.jobs(spark, d), "timed").select("job_id", "error")


@query("SELECT source, file_id, stage, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE stage WHEN 'extract' THEN 3 ELSE 4 END, file_id) AS rank FROM (SELECT source, file_id, 'extract' AS stage FROM w2 WHERE extract IS NULL UNION ALL SELECT source, file_id, 'vector' FROM w2 WHERE vector IS NULL)) WHERE rank <= 5", LAST.replace("events)", "events WHERE event_type <> 'view' AND (event_id % 4 < 2 OR event_id % 3 = 0))") + ",\nw2 AS (SELECT * FROM w WHERE parse = 'success')")
def enhancement_backlog(spark, d):
    j = V.jobs(spark, d).where("status != 'queued' and (job_id % 4 < 2 or job_id % 3 = 0)")
    return R.enhancement_backlog(R.wide_status(j), 5).select("source", "file_id", "stage", "rank")


@query("SELECT job_id, CASE WHEN status = 'success' AND job_id % 3 <> 0 THEN 'failed' ELSE status END AS status FROM jobs", V.JOBS)
def repair_jobs(spark, d):
    j = V.jobs(spark, d)
    return R.repair_jobs(j, j.where("job_id % 3 = 0")).select("job_id", "status")


@query("SELECT c_custkey AS domain_id FROM customer WHERE c_custkey % 60 = 30 AND c_custkey % 24 = 6 AND c_custkey % 7 <> 0")
def due_refreshes(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("domain_id"), (F.col("c_custkey") % 60).cast("int").alias("minute"), (F.col("c_custkey") % 24).cast("int").alias("hour"), F.lit(None).cast("int").alias("dow"))
    return R.due_refreshes(c, c.where("domain_id % 7 = 0"), "2024-01-01 06:30:00").select("domain_id")


@query("SELECT job_id, status IN ('running', 'processing') AND started < TIMESTAMP '2024-01-20' - INTERVAL 30 MINUTE AS stale FROM jobs", V.JOBS)
def stale_detector(spark, d):
    return R.stale_jobs(V.jobs(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("job_id", "stale")


@query(f"SELECT file_id, stage, CASE WHEN coalesce(max(CASE WHEN status IN {BAD} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'skip' WHEN row_number() OVER (PARTITION BY file_id ORDER BY no) = 1 THEN 'run' WHEN lag(status) OVER (PARTITION BY file_id ORDER BY no) = 'success' THEN 'run' ELSE 'wait' END AS gate FROM (SELECT *, CASE stage WHEN 'probe' THEN 1 WHEN 'parse' THEN 2 WHEN 'extract' THEN 3 ELSE 4 END AS no FROM lj)", LAST)
def stage_gate(spark, d):
    return R.stage_gate(V.jobs(spark, d)).select("file_id", "stage", "gate")


def _sums(size: str) -> str:
    return f"sum({size})::BIGINT AS total, " + ", ".join(f"coalesce(sum(CASE WHEN state = '{x}' THEN {size} END), 0)::BIGINT AS {x}" for x in ("pending", "processing", "success", "failed"))


@query(f"SELECT source, {_sums('1')} FROM (SELECT *, CASE WHEN coalesce(probe IN {BAD}, false) OR coalesce(parse IN {BAD}, false) THEN 'failed' WHEN parse = 'success' THEN 'success' WHEN coalesce(probe IN ('processing', 'running'), false) OR coalesce(parse IN ('processing', 'running'), false) THEN 'processing' ELSE 'pending' END AS state FROM w) GROUP BY source", LAST)
def doc_progress(spark, d):
    return R.doc_progress(R.wide_status(V.jobs(spark, d)))


@query(f"SELECT source, {_sums('size')} FROM (SELECT w.source, size, CASE WHEN extract = 'success' THEN 'success' WHEN extract IN {BAD} THEN 'failed' WHEN extract IN ('processing', 'running') THEN 'processing' ELSE 'pending' END AS state FROM w JOIN (SELECT doc_id, least(count(*), 60) AS size FROM chunks GROUP BY doc_id) ON doc_id = file_id) GROUP BY source", LAST + "," + V.CHUNKS)
def unit_progress(spark, d):
    return R.unit_progress(R.wide_status(V.jobs(spark, d)), V.chunks(spark, d))


@query("SELECT file_id, source, stage, status FROM lj WHERE status IN ('queued', 'processing', 'running')", LAST)
def active_files(spark, d):
    return R.active_files(V.jobs(spark, d))


@query(f"SELECT count(*) AS eligible, count(*) FILTER (WHERE b = 'success') AS built, count(*) FILTER (WHERE b IN ('queued', 'processing', 'running')) AS active, count(*) FILTER (WHERE b IN {BAD}) AS failed, count(*) FILTER (WHERE b IS NULL) AS missing, round(count(*) FILTER (WHERE b = 'success') / greatest(count(*), 1), 6)::DOUBLE AS coverage FROM docs d LEFT JOIN (SELECT file_id, status AS b FROM lj WHERE stage = 'extract') ON file_id = doc_id WHERE d.status = 'success'", LAST + "," + V.DOCS)
def build_overview(spark, d):
    builds = R.latest_jobs(V.jobs(spark, d)).where("stage = 'extract'").select(F.col("file_id").alias("doc_id"), "status")
    return R.build_overview(V.docs(spark, d), builds)


# Streams: each query drains a stream over the whole table; the SQL is the batch twin ------------------------------------


def _events(spark, d):
    schema = V.table(spark, d, "events").schema
    # A glob, as the table may be one file or a folder of parts, and a file source takes a bare path for a folder.
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, df, mode: str, name: str):
    """Run a stream over what is there now and return its rows."""
    base = shared_folder(spark)
    name = f"{name}_{uuid.uuid4().hex[:8]}"
    out = f"{base}/{name}"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == last)
    return rows.drop("batch")



@query("SELECT (floor(epoch(ts) / 259200) * 259200)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    df = _drained(spark, X.tumbling_counts(_events(spark, d)), "complete", "tumbling")
    return df.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, (unnest(range(0, 7)) * -86400 + floor(epoch(ts) / 86400) * 86400)::BIGINT AS s FROM events) GROUP BY ALL")
def sliding_counts(spark, d):
    df = _drained(spark, X.sliding_counts(_events(spark, d)), "complete", "sliding")
    return df.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


@query("SELECT user_id, epoch_us(min(ts))::BIGINT AS start, (epoch_us(max(ts)) + 1800000000)::BIGINT AS end, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))) GROUP BY user_id, session")
def session_windows(spark, d):
    df = _drained(spark, X.session_windows(_events(spark, d)), "complete", "sessions")
    return df.select("user_id", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "n")


@query("SELECT event_type AS stage, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS status, count(*) AS n FROM events GROUP BY ALL")
def stage_progress_stream(spark, d):
    e = _events(spark, d).withColumn("stage", F.col("event_type")).withColumn("status", F.when(F.col("value") < 50, "low").otherwise("high"))
    return _drained(spark, X.stage_progress_stream(e), "complete", "progress").select("stage", "status", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    df = X.stream_dedup(_events(spark, d), ["user_id", "event_type"], "3650 days")
    return _drained(spark, df, "append", "dedup").select("user_id", "event_type")


@query("SELECT a.user_id, epoch_us(a.ts)::BIGINT AS clicked, epoch_us(b.ts)::BIGINT AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR")
def stream_stream_join(spark, d):
    e = _events(spark, d)
    df = X.stream_stream_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id")
    return _drained(spark, df, "append", "join").select(F.col("a_key").alias("user_id"), F.unix_micros("a_ts").alias("clicked"), F.unix_micros("b_ts").alias("bought"))


@query("SELECT source, path, file_hash FROM docs", V.DOCS)
def stream_ingest_twin(spark, d):
    """A stream of the documents' files into a table of buckets, and what that holds then."""
    base = f"{shared_folder(spark)}/ingest_{uuid.uuid4().hex[:8]}"
    schema = V.table(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/document[s].parquet")
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.when(F.col("doc_id") % 7 == 0, ".xlsx").when(F.col("doc_id") % 11 == 0, ".sql").otherwise(".txt"))
    files = stream.select("source", F.concat("source", F.lit("/"), name).alias("path"), F.sha2("text", 256).alias("file_hash"))
    X.stream_ingest(files, f"{base}/table", ["source", "path"], f"{base}/state", buckets=8).awaitTermination()
    return X.current_rows(spark, f"{base}/table").select("source", "path", "file_hash")
