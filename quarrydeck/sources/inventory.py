"""File inventories: scan, probe, compare, select, replace and write."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("probe", "parse", "extract", "vector")
EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "xlsm", "ppt", "pptx", "txt", "md", "csv", "html", "htm", "json", "xml")
#: First bytes of container formats.
MAGIC = {"pdf": "255044462D", "docx": "504B0304", "xlsx": "504B0304", "xlsm": "504B0304", "pptx": "504B0304", "doc": "D0CF11E0A1B11AE1", "xls": "D0CF11E0A1B11AE1", "ppt": "D0CF11E0A1B11AE1"}


def _like(glob: str) -> str:
    return "(?i)^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def scan_inventory(spark: SparkSession, path: str, include: Sequence[str] = ("*",), exclude: Sequence[str] = (), recursive: bool = True, keep_content: bool = False) -> DataFrame:
    """Files under a path: path, name, ext, size, modified; names by globs, office lock files (``~$``) are left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    df = df.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~F.col("name").startswith("~$"))
    wanted = F.lit(False)
    for glob in include:
        wanted = wanted | F.col("name").rlike(_like(glob))
    for glob in exclude:
        wanted = wanted & ~F.col("name").rlike(_like(glob))
    df = df.where(wanted).withColumn("ext", extension("name")).withColumnsRenamed({"length": "size", "modificationTime": "modified"})
    return df if keep_content else df.drop("content")


def extension(name: str) -> Column:
    return F.lower(F.regexp_extract(F.col(name), r"\.([^./]+)$", 1))


def content_hash(content: str = "content") -> Column:
    return F.sha2(F.col(content), 256)


def inventory_diff(prev: DataFrame, curr: DataFrame, keys: Sequence[str] = ("source", "path"), force: bool = False) -> DataFrame:
    """change_type of every file in one of the two snapshots (keys, size, modified, file_hash): new, changed, unchanged or missing."""
    old = prev.select(*keys, F.col("file_hash").alias("old_hash"), F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.lit(True).alias("was"))
    new = curr.select(*keys, "file_hash", "size", "modified", F.lit(True).alias("now"))
    differs = (~F.col("size").eqNullSafe(F.col("old_size")) | ~F.col("modified").eqNullSafe(F.col("old_modified"))) & ~F.col("file_hash").eqNullSafe(F.col("old_hash"))
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.lit(force) | differs, "changed").otherwise("unchanged")
    return new.join(old, list(keys), "full_outer").select(*keys, "old_hash", "file_hash", kind.alias("change_type"))


def scan_summary(diff: DataFrame, by: str = "source") -> DataFrame:
    return diff.groupBy(by).agg(*(F.count_if(F.col("change_type") == k).alias(f"n_{k}") for k in ("new", "changed", "unchanged", "missing")))


def probe_files(df: DataFrame, name: str = "name", size: str = "size", header: str | None = "header") -> DataFrame:
    """Add probe_status, reason and the stage statuses; ``header``: a column with the first 8 bytes in hex."""
    ext = extension(name)
    wrong = F.lit(False)
    if header:
        for kind, magic in MAGIC.items():
            wrong = wrong | ((ext == kind) & ~F.coalesce(F.col(header), F.lit("")).startswith(magic))
    reason = F.when(F.col(name).startswith("~$"), "TEMP_FILE").when(~ext.isin(*EXTENSIONS), "UNSUPPORTED_EXTENSION").when(F.col(size) <= 0, "EMPTY_FILE").when(wrong, "BAD_SIGNATURE")
    status = F.when(reason == "TEMP_FILE", "ignored").when(reason.isNotNull(), "failed").otherwise("success")
    df = df.withColumn("reason", reason).withColumn("probe_status", status)
    later = F.when(F.col("probe_status") == "success", "pending").otherwise("skipped")
    return df.withColumns({f"{s}_status": later for s in STAGES[1:]})


def cleanup_temp_failures(df: DataFrame, name: str = "name") -> DataFrame:
    """Failed office lock files become ignored, their later stages skipped."""
    temp = F.col(name).startswith("~$") & (F.col("status") == "failed")
    return df.withColumn("status", F.when(temp, "ignored").otherwise(F.col("status"))).withColumn("error", F.when(~temp, F.col("error")))


def select_for_ingest(df: DataFrame, mode: str = "incremental", reprocess_failed: bool = False) -> DataFrame:
    """Files to work on: full, retry_failed, resume (not done) or incremental (new or changed); their statuses are reset."""
    failed, open_ = F.col("status") == "failed", ~F.col("status").isin("success", "ignored")
    wanted = {"full": F.lit(True), "retry_failed": failed, "resume": open_ & ~failed, "incremental": F.col("change_type").isin("new", "changed")}[mode]
    if reprocess_failed:
        wanted = wanted | failed
    return df.where(wanted & (F.col("status") != "ignored")).withColumn("status", F.lit("pending")).withColumn("from_stage", F.lit("probe" if mode == "full" else "parse"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Text of web pages: script, style and tags go, entities of the usual kind come back as characters."""
    t = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), "&nbsp;", " ")
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(mark), F.lit(char))
    return pages.withColumn("text", F.trim(F.regexp_replace(t, r"\s+", " ")))


def parse_documents(df: DataFrame, parser: Callable[[str, bytes], Sequence[tuple[str | None, str]]], *, id_col: str, name_col: str, content_col: str) -> DataFrame:
    """Chunk rows (id, chunk_no, title, content, error) made by a parser plug-in; a failure becomes one row with its reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, name, content in zip(batch["id"], batch["name"], batch["content"]):
                try:
                    found = list(parser(name, content))
                    rows += [(key, i, t, c, None) for i, (t, c) in enumerate(found)]
                except Exception as e:  # noqa: BLE001  one file must not stop the others
                    rows.append((key, 0, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["id", "chunk_no", "title", "content", "error"])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.col(content_col).cast("binary").alias("content"))
    return rows.mapInPandas(run, f"id {kind}, chunk_no int, title string, content string, error string").withColumnRenamed("id", id_col)


def upsert_by_key(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the target whose keys aren't updated, and the updates."""
    return target.join(updates.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(updates.select(*target.columns))


def replace_children(children: DataFrame, fresh: DataFrame, parent: str = "doc_id") -> DataFrame:
    """All children of a parent that has fresh ones go; the fresh ones come."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(fresh.select(*children.columns))


def reset_index(files: DataFrame, children: dict[str, DataFrame], source: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Files of a source back to pending, its children out, and how many rows each child table loses."""
    own = files.where(F.col("source") == source).select("doc_id")
    reset = files.withColumn("status", F.when(F.col("source") == source, "pending").otherwise(F.col("status")))
    kept = {name: df.join(own, "doc_id", "left_anti") for name, df in children.items()}
    gone = None
    for name, df in children.items():
        part = df.join(own, "doc_id", "left_semi").agg(F.count("*").alias("removed")).select(F.lit(name).alias("child"), "removed")
        gone = part if gone is None else gone.unionByName(part)
    return reset, kept, gone


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: dict[str, Sequence[str]] | None = None, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        df.write.mode(mode).partitionBy(*(partition_by or {}).get(name, ())).parquet(f"{path}/{name}.parquet")
