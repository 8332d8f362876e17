"""Progress and quality reports over files, stage jobs and batches.

Jobs: (job_id, file_id, source, stage, status, started, finished, error, batch_id). Stages run in the order of STAGES.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.inventory import STAGES

FAILED = ("failed", "conversion_failed", "enhanced_parser_not_ready")
STATUS_ORDER = ("running", "queued", "failed", "success")
#: Reasons by message, in this order.
ERROR_CUES = (("timeout", ("timeout", "timed out")), ("empty", ("empty", "no content")), ("format", ("unsupported", "format", "signature")), ("model", ("model", "api", "token")), ("io", ("not found", "permission", "denied")))


def stage_no(stage: str = "stage") -> Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), F.col(stage)).cast("int")


def status_rank(status: str = "status") -> Column:
    out = F.lit(len(STATUS_ORDER))
    for i, s in enumerate(STATUS_ORDER):
        out = F.when(F.col(status) == s, i).otherwise(out)
    return out


def overview(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals by status with duplicates, bytes and the last change; by source for cards."""
    g = files.groupBy(*by) if by else files
    return g.agg(F.count("*").alias("files"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pending", "processing", "success")), F.count_if(F.col("status").isin(*FAILED)).alias("n_failed"), F.count_if("is_duplicate").alias("duplicates"), F.sum("size").alias("bytes"), F.max("modified").alias("last_change"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The last job of each file and stage."""
    best = jobs.groupBy("file_id", "stage").agg(F.max_by(F.struct("job_id", "source", "status", "started", "finished", "error"), F.struct("started", "job_id")).alias("x"))
    return best.select("file_id", "stage", "x.*")


def wide_status(jobs: DataFrame) -> DataFrame:
    """One row a file with the status of every stage (null: no job yet)."""
    last = latest_jobs(jobs)
    return last.groupBy("file_id").agg(F.max("source").alias("source"), *(F.max(F.when(F.col("stage") == s, F.col("status"))).alias(s) for s in STAGES), F.max("started").alias("last_start"))


def effective_status(wide: DataFrame) -> DataFrame:
    """A stage without a job inherits the failure of an earlier one, is skipped behind one, and else pends."""
    df, broken = wide, F.lit(False)
    for s in STAGES:
        own = F.col(s)
        df = df.withColumn(f"eff_{s}", F.when(own.isNotNull(), own).when(broken, "skipped").otherwise("pending"))
        broken = broken | F.coalesce(own.isin(*FAILED), F.lit(False))
    return df


def stage_progress(jobs: DataFrame) -> DataFrame:
    """(source, stage, pending, processing, success, failed, percent) from the files' last jobs."""
    df = latest_jobs(jobs).groupBy("source", "stage").agg(F.count_if(F.col("status").isin("pending", "queued")).alias("pending"), F.count_if(F.col("status").isin("processing", "running")).alias("processing"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status").isin(*FAILED)).alias("failed"))
    done = F.col("pending") + F.col("processing") + F.col("success") + F.col("failed")
    return df.withColumn("percent", F.round(100 * F.col("success") / F.greatest(done, F.lit(1)), 2))


def file_state(wide: DataFrame) -> DataFrame:
    """File status and current stage: the first stage that isn't a success decides."""
    status, stage = F.lit("success"), F.lit(STAGES[-1])
    for s in reversed(STAGES):
        own = F.coalesce(F.col(s), F.lit("pending"))
        status = F.when(own == "success", status).otherwise(F.when(own.isin(*FAILED), "failed").when(own.isin("processing", "running"), "running").otherwise("pending"))
        stage = F.when(own == "success", stage).otherwise(F.lit(s))
    return wide.withColumn("file_status", status).withColumn("current_stage", stage)


def progress_percent(wide: DataFrame) -> DataFrame:
    """Completed stages, half a stage for one that runs, up to the first open one."""
    states = F.array(*(F.coalesce(F.col(s), F.lit("pending")) for s in STAGES))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(True).alias("on"))
    add = lambda acc, s: F.struct((acc["sum"] + F.when(acc["on"], F.when(s == "success", 1.0).when(s.isin("running", "processing"), 0.5).otherwise(0.0)).otherwise(0.0)).alias("sum"), (acc["on"] & (s == "success")).alias("on"))
    return wide.withColumn("percent", F.round(F.aggregate(states, zero, add, lambda acc: acc["sum"]) * 100 / len(STAGES), 2))


def batch_state(jobs: DataFrame) -> DataFrame:
    """Per batch: jobs by status and the batch's own status."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    df = jobs.groupBy("batch_id").agg(F.count("*").alias("jobs"), n("running", "processing").alias("running"), n("queued", "pending").alias("queued"), n("needs_approval").alias("needs_approval"), n("cancelled").alias("cancelled"), n(*FAILED).alias("failed"), n("success").alias("success"))
    status = F.when(F.col("running") > 0, "running").when(F.col("queued") > 0, "queued").when(F.col("needs_approval") > 0, "needs_approval").when(F.col("cancelled") == F.col("jobs"), "cancelled").when((F.col("failed") > 0) & (F.col("success") > 0), "partial_failed").when(F.col("failed") > 0, "failed").otherwise("success")
    return df.withColumn("batch_status", status)


def lifecycle(wide: DataFrame) -> DataFrame:
    """lifecycle (discovered, in_progress, failed, searchable, complete), first_round (parse done) and background (later
    stages open behind a parsed file)."""
    ok = lambda s: F.coalesce(F.col(s) == "success", F.lit(False))
    bad = F.lit(False)
    for s in STAGES:
        bad = bad | F.coalesce(F.col(s).isin(*FAILED), F.lit(False))
    started = F.coalesce(*(F.col(s) for s in STAGES)).isNotNull()
    every = ok(STAGES[0]) & ok(STAGES[1]) & ok(STAGES[2]) & ok(STAGES[3])
    state = F.when(every, "complete").when(bad, "failed").when(ok("parse"), "searchable").when(started, "in_progress").otherwise("discovered")
    return wide.withColumn("lifecycle", state).withColumn("first_round", ok("parse")).withColumn("background", ok("parse") & ~(ok("extract") & ok("vector")))


def error_summary(jobs: DataFrame) -> DataFrame:
    """(stage, reason, n) of failed jobs; the reason by words of the message."""
    reason = T.first_cue(F.lower(T.text("error")), ERROR_CUES, "other")
    return jobs.where(F.col("status").isin(*FAILED)).groupBy("stage", reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


def task_stats(chunks: DataFrame, units: DataFrame, vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks, units and vectors of each source."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    df = docs.select("doc_id", "source")
    for part in (count(chunks, "chunks"), count(units, "units"), count(vectors, "vectors")):
        df = df.join(part, "doc_id", "left")
    return df.fillna(0).groupBy("source").agg(F.count("*").alias("documents"), *(F.sum(c).alias(c) for c in ("chunks", "units", "vectors")))


def jobs_feed(feeds: dict[str, DataFrame], k: int) -> DataFrame:
    """Several kinds of jobs in one feed: running first, then queued, failed and success, newest first; k of each kind."""
    rows = None
    for kind, df in feeds.items():
        part = df.select(F.lit(kind).alias("kind"), "job_id", "status", "started", "error")
        rows = part if rows is None else rows.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(status_rank(), F.desc_nulls_last("started"), "job_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def failures(jobs: DataFrame, words: str | None = None) -> DataFrame:
    df = jobs.where(F.col("status").isin(*FAILED))
    return df.where(F.lower(T.text("error")).contains(words.lower())) if words else df


def enhancement_backlog(wide: DataFrame, slots: int, by: str = "source") -> DataFrame:
    """Parsed files whose extraction or vectors are missing, one row a missing stage, up to the free slots of a source."""
    missing = F.filter(F.array(*(F.when(F.coalesce(F.col(s), F.lit("pending")).isin("pending"), F.lit(s)) for s in ("extract", "vector"))), lambda x: x.isNotNull())
    rows = wide.where("parse = 'success'").select(by, "file_id", F.explode(missing).alias("stage"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(stage_no(), "file_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= slots)


def repair_jobs(jobs: DataFrame, packs: DataFrame) -> DataFrame:
    """Successful jobs without a pack are failed."""
    have = packs.select("job_id").distinct().withColumn("__has", F.lit(True))
    bad = (F.col("status") == "success") & F.col("__has").isNull()
    df = jobs.join(have, "job_id", "left")
    return df.withColumn("error", F.when(bad, "no pack").otherwise(F.col("error"))).withColumn("status", F.when(bad, "failed").otherwise(F.col("status"))).drop("__has")


def due_refreshes(schedules: DataFrame, active: DataFrame, now) -> DataFrame:
    """schedules(domain_id, minute, hour, dow; null: any) that match this minute and have no active job."""
    t = F.lit(now).cast("timestamp")
    fits = lambda c, v: F.col(c).isNull() | (F.col(c) == v)
    return schedules.where(fits("minute", F.minute(t)) & fits("hour", F.hour(t)) & fits("dow", F.dayofweek(t))).join(active.select("domain_id"), "domain_id", "left_anti")


def stale_jobs(jobs: DataFrame, now: Column, timeout: str = "30 minutes") -> DataFrame:
    """Running jobs whose last sign of life is older than the timeout become failed (batch twin of the stream)."""
    old = (F.col("status").isin("running", "processing")) & (F.col("started") < now - F.expr(f"INTERVAL {timeout}"))
    return jobs.withColumn("stale", old).withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


def stage_gate(jobs: DataFrame) -> DataFrame:
    """Whether each stage of a file may run: the stage before must be a success; behind a failure it is skipped."""
    w = Window.partitionBy("file_id").orderBy(stage_no())
    before = F.lag("status").over(w)
    broken = F.max(F.col("status").isin(*FAILED).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gate = F.when(F.coalesce(broken, F.lit(0)) == 1, "skip").when(F.row_number().over(w) == 1, "run").when(before == "success", "run").otherwise("wait")
    return latest_jobs(jobs).withColumn("gate", gate)


def _share_out(df: DataFrame, size: Column) -> DataFrame:
    """(source, total, pending, processing, success, failed) of ``size`` by the column ``state``."""
    parts = [F.coalesce(F.sum(F.when(F.col("state") == s, size)), F.lit(0)).cast("long").alias(s) for s in ("pending", "processing", "success", "failed")]
    return df.groupBy("source").agg(F.sum(size).cast("long").alias("total"), *parts)


def doc_progress(wide: DataFrame) -> DataFrame:
    """Files by the state of their document: failed if probe or parse failed, success once parsed, processing while one runs."""
    any_of = lambda *states: F.coalesce(F.col("probe").isin(*states), F.lit(False)) | F.coalesce(F.col("parse").isin(*states), F.lit(False))
    state = F.when(any_of(*FAILED), "failed").when(F.col("parse") == "success", "success").when(any_of("processing", "running"), "processing").otherwise("pending")
    return _share_out(wide.withColumn("state", state), F.lit(1))


def unit_progress(wide: DataFrame, chunks: DataFrame, stage: str = "extract", limit: int = 60) -> DataFrame:
    """The same weighted by chunks, at most ``limit`` a file; files without chunks have no weight."""
    n = chunks.groupBy(F.col("doc_id").alias("file_id")).agg(F.least(F.count("*"), F.lit(limit)).alias("size"))
    state = F.when(F.col(stage) == "success", "success").when(F.col(stage).isin(*FAILED), "failed").when(F.col(stage).isin("processing", "running"), "processing").otherwise("pending")
    return _share_out(wide.join(n, "file_id").withColumn("state", state), F.col("size"))


def active_files(jobs: DataFrame) -> DataFrame:
    """Stages of files whose last job waits or runs."""
    return latest_jobs(jobs).where("status in ('queued', 'processing', 'running')").select("file_id", "source", "stage", "status")


def build_overview(files: DataFrame, builds: DataFrame) -> DataFrame:
    """One row: parsed files, and how many have a successful, active, failed or no build. builds has one row a doc_id."""
    own = files.where("status = 'success'").select("doc_id").join(builds.select("doc_id", F.col("status").alias("build")), "doc_id", "left")
    counts = own.agg(F.count("*").alias("eligible"), F.count_if(F.col("build") == "success").alias("built"), F.count_if(F.col("build").isin("queued", "processing", "running")).alias("active"), F.count_if(F.col("build").isin(*FAILED)).alias("failed"), F.count_if(F.isnull("build")).alias("missing"))
    return counts.withColumn("coverage", F.round(F.col("built") / F.greatest("eligible", F.lit(1)), 6))
