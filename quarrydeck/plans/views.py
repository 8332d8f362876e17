"""The engine's own model as views over the given tables, for Spark and as DuckDB SQL.

``source_files``, ``docs``, ``chunks`` and ``units`` come from documents; ``jobs`` from events; ``facts`` and ``entities``
from the trade tables; ``queries_in`` from benchmark and documents. Every view covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, d) -> DataFrame:
    df = table(spark, d, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.when(F.col("doc_id") % 7 == 0, ".xlsx").when(F.col("doc_id") % 11 == 0, ".sql").otherwise(".txt"))
    df = df.select("doc_id", "source", "lang", "text", F.substring(F.split("text", "\n")[0], 1, 80).alias("title"), name.alias("filename"), F.concat("source", F.lit("/"), name).alias("path"), F.sha2("text", 256).alias("file_hash"), F.length("text").cast("long").alias("size"))
    return df.withColumn("ext", F.regexp_extract("filename", r"\.(\w+)$", 1)).withColumn("stem", F.regexp_replace("filename", r"\.\w+$", "")).withColumn("preview", F.substring("text", 1, 2000)).withColumn("status", F.when(F.col("size") < 100, "failed").otherwise("success")).withColumn("doc_type", F.element_at(F.array(*map(F.lit, ("rule", "report", "speech", "excel", "unknown"))), (F.col("doc_id") % 5 + 1).cast("int")))


DOCS = """
docs0 AS (SELECT doc_id, source, lang, text, substr(string_split(text, chr(10))[1], 1, 80) AS title, 'doc_' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.xlsx' WHEN doc_id % 11 = 0 THEN '.sql' ELSE '.txt' END AS filename, sha256(text) AS file_hash, length(text)::BIGINT AS size FROM documents),
docs AS (SELECT *, source || '/' || filename AS path, regexp_extract(filename, '\\.(\\w+)$', 1) AS ext, regexp_replace(filename, '\\.\\w+$', '') AS stem, substr(text, 1, 2000) AS preview, CASE WHEN size < 100 THEN 'failed' ELSE 'success' END AS status, ['rule', 'report', 'speech', 'excel', 'unknown'][(doc_id % 5 + 1)::INT] AS doc_type FROM docs0)"""


def chunks(spark, d) -> DataFrame:
    df = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "content")).where(F.trim("content") != "")
    words = F.split("content", " ")
    kind = F.when(F.col("content").contains(" | "), "table_row").when(F.col("content").startswith("-"), "list").otherwise("paragraph")
    return df.select("doc_id", "chunk_no", "content", kind.alias("chunk_type"), F.when(F.size(words) >= 3, F.array_join(F.slice(words, 1, 2), " ")).otherwise("").alias("title"))


CHUNKS = (
    DOCS
    + """,
lines AS (SELECT doc_id, unnest(range(len(s)))::INT AS chunk_no, unnest(s) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM docs)),
chunks AS (SELECT doc_id, chunk_no, content, CASE WHEN contains(content, ' | ') THEN 'table_row' WHEN starts_with(content, '-') THEN 'list' ELSE 'paragraph' END AS chunk_type, CASE WHEN len(string_split(content, ' ')) >= 3 THEN array_to_string(string_split(content, ' ')[1:2], ' ') ELSE '' END AS title FROM lines WHERE trim(content, ' ') <> '')"""
)


def units(spark, d) -> DataFrame:
    c = chunks(spark, d).where(F.length("content") >= 40)
    return c.select("doc_id", "chunk_no", F.col("chunk_no").alias("unit_no"), F.col("title").alias("subject"), F.col("title"), F.when(F.col("content").contains("%"), "percent").when(F.col("content").rlike("[0-9]"), "number").otherwise("").alias("indicator"), F.substring(T.collapse_space("content"), 1, 300).alias("normalized"), "content")


UNITS = (
    CHUNKS
    + """,
units AS (SELECT doc_id, chunk_no, chunk_no AS unit_no, title AS subject, title, CASE WHEN contains(content, '%') THEN 'percent' WHEN regexp_matches(content, '[0-9]') THEN 'number' ELSE '' END AS indicator, substr(trim(regexp_replace(content, '\\s+', ' ', 'g'), ' '), 1, 300) AS normalized, content FROM chunks WHERE length(content) >= 40)"""
)


def jobs(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    stage = F.element_at(F.array(*map(F.lit, ("probe", "parse", "extract", "vector"))), (F.col("event_id") % 4 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "view", "queued").otherwise("success")
    error = F.when(F.col("event_type") == "error", F.when(F.col("value") < 50, "read timed out").otherwise("model api said no"))
    return e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("file_id"), F.concat(F.lit("src"), F.col("user_id") % 5).alias("source"), stage.alias("stage"), status.alias("status"), F.col("ts").cast("timestamp").alias("started"), F.col("ts").cast("timestamp").alias("finished"), error.alias("error"), F.floor(F.col("event_id") / 50).alias("batch_id"))


JOBS = """
jobs AS (SELECT event_id AS job_id, user_id AS file_id, 'src' || (user_id % 5) AS source, ['probe', 'parse', 'extract', 'vector'][(event_id % 4 + 1)::INT] AS stage, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'success' END AS status, ts AS started, ts AS finished, CASE WHEN event_type = 'error' THEN CASE WHEN value < 50 THEN 'read timed out' ELSE 'model api said no' END END AS error, event_id // 50 AS batch_id FROM events)"""


def facts(spark, d) -> DataFrame:
    """(customer) ordered (part), (supplier) supplies (part), (supplier) located_in (nation), and brand and size of parts."""
    c, o, li, p, s, n = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "part", "supplier", "nation"))
    year = F.date_format("o_orderdate", "yyyy")
    ordered = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    ordered = ordered.select(F.concat_ws("-", F.lit("o"), "l_orderkey", "l_linenumber").alias("fact_id"), F.col("c_name").alias("subject"), F.lit("customer").alias("subject_type"), F.lit("ordered").alias("predicate"), F.col("p_name").alias("object"), F.lit("product").alias("object_type"), F.lit("relation").alias("fact_kind"), F.col("l_orderkey").alias("doc_id"), F.round(1 - F.col("l_discount") * 5, 4).alias("confidence"), year.alias("valid_from"), F.lit("").alias("valid_to"))
    supplies = li.select("l_suppkey", "l_partkey").distinct().join(s, F.col("l_suppkey") == s["s_suppkey"]).join(p, F.col("l_partkey") == p["p_partkey"])
    supplies = supplies.select(F.concat_ws("-", F.lit("s"), "l_suppkey", "l_partkey").alias("fact_id"), F.col("s_name").alias("subject"), F.lit("organization").alias("subject_type"), F.lit("supplies").alias("predicate"), F.col("p_name").alias("object"), F.lit("product").alias("object_type"), F.lit("relation").alias("fact_kind"), F.col("l_suppkey").alias("doc_id"), F.lit(0.9).alias("confidence"), F.lit("").alias("valid_from"), F.lit("").alias("valid_to"))
    placed = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("n-"), F.col("s_suppkey")).alias("fact_id"), F.col("s_name").alias("subject"), F.lit("organization").alias("subject_type"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"), F.lit("place").alias("object_type"), F.lit("relation").alias("fact_kind"), F.col("s_suppkey").alias("doc_id"), F.lit(0.95).alias("confidence"), F.lit("").alias("valid_from"), F.lit("").alias("valid_to"))
    own = p.select("p_partkey", "p_name", F.explode(F.array(F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v")), F.struct(F.lit("size").alias("k"), F.col("p_size").cast("string").alias("v")))).alias("a"))
    own = own.select(F.concat_ws("-", F.lit("a"), "p_partkey", "a.k").alias("fact_id"), F.col("p_name").alias("subject"), F.lit("product").alias("subject_type"), F.col("a.k").alias("predicate"), F.col("a.v").alias("object"), F.lit(None).cast("string").alias("object_type"), F.lit("attribute").alias("fact_kind"), F.col("p_partkey").alias("doc_id"), F.lit(0.8).alias("confidence"), F.lit("").alias("valid_from"), F.lit("").alias("valid_to"))
    return ordered.unionByName(supplies).unionByName(placed).unionByName(own)


FACTS = """
facts AS (
SELECT 'o-' || l_orderkey || '-' || l_linenumber AS fact_id, c_name AS subject, 'customer' AS subject_type, 'ordered' AS predicate, p_name AS object, 'product' AS object_type, 'relation' AS fact_kind, l_orderkey AS doc_id, round(1 - l_discount * 5, 4) AS confidence, strftime(o_orderdate, '%Y') AS valid_from, '' AS valid_to FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 's-' || l_suppkey || '-' || l_partkey, s_name, 'organization', 'supplies', p_name, 'product', 'relation', l_suppkey, 0.9, '', '' FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'n-' || s_suppkey, s_name, 'organization', 'located_in', n_name, 'place', 'relation', s_suppkey, 0.95, '', '' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'a-' || p_partkey || '-' || k, p_name, 'product', k, v, NULL, 'attribute', p_partkey, 0.8, '', '' FROM (SELECT p_partkey, p_name, unnest(['brand', 'size']) AS k, unnest([p_brand, p_size::VARCHAR]) AS v FROM part))"""


def entities(spark, d) -> DataFrame:
    """Customers, parts, suppliers and nations; every 29th name has lost its last character."""
    rows = None
    for t, key, name, kind in (("customer", "c_custkey", "c_name", "customer"), ("part", "p_partkey", "p_name", "product"), ("supplier", "s_suppkey", "s_name", "organization"), ("nation", "n_nationkey", "n_name", "place")):
        df = table(spark, d, t).select(F.concat(F.lit(f"{kind}-"), F.col(key)).alias("entity_id"), F.when(F.col(key) % 29 == 0, F.expr(f"substring({name}, 1, length({name}) - 1)")).otherwise(F.col(name)).alias("name"), F.lit(kind).alias("entity_type"), F.col(key).cast("long").alias("doc_id"))
        rows = df if rows is None else rows.unionByName(df)
    return rows


ENTITIES = """
entities AS (""" + " UNION ALL ".join(f"SELECT '{kind}-' || {key} AS entity_id, CASE WHEN {key} % 29 = 0 THEN substr({name}, 1, length({name}) - 1) ELSE {name} END AS name, '{kind}' AS entity_type, {key}::BIGINT AS doc_id FROM {t}" for t, key, name, kind in (("customer", "c_custkey", "c_name", "customer"), ("part", "p_partkey", "p_name", "product"), ("supplier", "s_suppkey", "s_name", "organization"), ("nation", "n_nationkey", "n_name", "place"))) + ")"  # fmt: skip


def queries_in(spark, d) -> DataFrame:
    """Words 2 to 4 of every benchmark item, and of every 100th document."""
    cutout = lambda c: F.array_join(F.slice(F.split(c, " "), 2, 3), " ")
    b = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), cutout("text").alias("query"))
    x = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.concat(F.lit("d"), F.col("doc_id")).alias("query_id"), cutout("text").alias("query"))
    return b.unionByName(x).where("query != ''")


QUERIES_IN = """
queries_in AS (SELECT * FROM (SELECT 'b' || item_id AS query_id, array_to_string(string_split(text, ' ')[2:4], ' ') AS query FROM benchmark UNION ALL SELECT 'd' || doc_id, array_to_string(string_split(text, ' ')[2:4], ' ') FROM documents WHERE doc_id % 100 = 0) WHERE query <> '')"""
