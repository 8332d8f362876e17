"""Knowledge units by rules: one per chunk, with fields by document type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

#: Patterns of the default rules.
CODE = "(?i)" + L.CODE_HINT
NUMBER, TIME, REGION, CONDITION, CONSTRAINT, EXCEPTION = L.NUMBER, L.TIME, L.REGION, L.CONDITION, L.CONSTRAINT, L.EXCEPTION
APPROVAL = ("批准", "审批", "同意")
DUTY = ("不得", "不超过", "必须", "应当")
UNIT_TYPES = {"rule": ("rule", "comply"), "speech": ("statement", "state"), "report": ("fact", "report"), "notice": ("fact", "report"), "minutes": ("fact", "report"), "excel": ("table_record", "record")}


def is_code_like(content) -> Column:
    return T.text(content).rlike(CODE)


def normalized(content, n: int = 300) -> Column:
    return F.nullif(F.substring(T.collapse_space(content), 1, n), F.lit(""))


def parse_numeric(content, doc_type) -> Column:
    """struct(value decimal, unit) of the first number; null for other types of documents and for code."""
    t = T.text(content)
    value = F.regexp_extract(t, NUMBER, 1)
    use = F.col(doc_type).isin("rule", "report", "excel", "notice", "minutes") & ~is_code_like(content) & (value != "")
    return F.when(use, F.struct(value.try_cast("decimal(20,6)").alias("value"), F.nullif(F.regexp_extract(t, NUMBER, 2), F.lit("")).alias("unit")))


def _all(t: Column, pattern: str, cut: int = 120) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(pattern)), lambda x: F.substring(F.trim(x), 1, cut)))


def rule_fields(content, conditions: str = CONDITION, constraints: str = CONSTRAINT, exceptions: str = EXCEPTION, approval=APPROVAL) -> Column:
    t = T.text(content)
    return F.struct(_all(t, conditions).alias("conditions"), _all(t, constraints).alias("constraints"), _all(t, exceptions).alias("exceptions"), T.any_of(t, approval).alias("approval_required"))


def report_fields(content, time: str = TIME, region: str = REGION, yoy: str = L.YEAR_ON_YEAR, mom: str = L.MONTH_ON_MONTH) -> Column:
    """Time, region, and the percentages against the year and the month before, as texts; null where there is none."""
    t = T.text(content)
    one = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return F.struct(one(time).alias("time"), one(region).alias("region"), one(yoy).alias("yoy"), one(mom).alias("mom"))


def table_fields(content, sep: str = r"\s*\|\s*", most: int = 6) -> Column:
    """Headers of the first line; the second line's cells with digits are metrics, the others dimensions."""
    lines = F.filter(F.split(T.text(content), "\n"), lambda x: F.trim(x) != "")
    cells = lambda i: F.slice(F.filter(F.split(F.trim(F.coalesce(F.get(lines, F.lit(i)), F.lit(""))), sep), lambda x: x != ""), 1, most)
    heads, row = cells(0), cells(1)
    pairs = F.filter(F.arrays_zip(heads.alias("h"), row.alias("v")), lambda p: p["h"].isNotNull() & p["v"].isNotNull())
    pick = lambda yes: F.map_from_entries(F.array_distinct(F.filter(pairs, lambda p: p["v"].rlike(r"\d") == yes)))
    return F.struct(heads.alias("headers"), pick(F.lit(True)).alias("metrics"), pick(F.lit(False)).alias("dimensions"))


def default_fields(doc_type, content, duty=DUTY) -> Column:
    """What a type's fields hold if nothing was found: the duty sentence of a rule, the stance of a speech, a trend mark."""
    n = normalized(content, 160)
    return F.struct(
        F.when((F.col(doc_type) == "rule") & T.any_of(T.text(content), duty), F.array(n)).alias("constraints"),
        F.when(F.col(doc_type) == "speech", normalized(content)).alias("stance"),
        F.when(F.col(doc_type).isin("report", "notice", "minutes") & T.text(content).contains("%"), "contains_percentage").alias("trend"),
    )


def extract_units(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One unit a chunk: type and action by document type, subject, text, number, confidence and span."""
    df = chunks.join(docs.select("doc_id", "doc_type"), "doc_id")
    code = is_code_like("content")
    kind, action = F.lit("summary"), F.lit("describe")
    for name, (unit, verb) in UNIT_TYPES.items():
        kind, action = F.when(F.col("doc_type") == name, unit).otherwise(kind), F.when(F.col("doc_type") == name, verb).otherwise(action)
    number = parse_numeric("content", "doc_type")
    return df.select(
        "doc_id", "chunk_no", F.when(code, "summary").otherwise(kind).alias("unit_type"), F.when(code, "describe").otherwise(action).alias("action"), F.col("title").alias("subject"),
        normalized("content").alias("normalized"), "content", number["value"].alias("value_num"), number["unit"].alias("unit_name"), F.lit(0.6).cast("decimal(4,3)").alias("confidence"), F.concat(F.lit("chunk:"), F.col("chunk_no")).alias("source_span"),
    )


def heuristic_units(chunks: DataFrame, docs: DataFrame, cues=(("同比", "同比"), ("增长", "增长率"), ("金额", "金额"), ("数量", "数量"))) -> DataFrame:
    """Units without a model: table rows are records; an indicator by cue; confidence by whether one was found."""
    df = chunks.join(docs.select("doc_id", "ext", "stem"), "doc_id")
    indicator = F.lit(None).cast("string")
    for word, name in reversed(list(cues)):
        indicator = F.when(T.text("content").contains(word), name).otherwise(indicator)
    table = F.col("ext").isin("xls", "xlsx") | (F.col("chunk_type") == "table_row")
    return df.select("doc_id", "chunk_no", F.when(table, "table_record").otherwise("statement").alias("unit_type"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), "stem").alias("subject"), indicator.alias("indicator"), F.when(indicator.isNotNull(), 0.72).otherwise(0.45).alias("confidence"), F.concat(F.lit("0-"), F.length(T.text("content"))).alias("source_span"), "content")


def structural_topics(docs: DataFrame, chunks: DataFrame, units: DataFrame, k: int = 12, stop=("目录", "附件", "前言")) -> DataFrame:
    """Topic strings of a document from its title, chunk titles and unit fields, in that order; distinct, 2 to 24 characters."""
    rows = docs.select("doc_id", F.lit(0).alias("p"), F.lit(0).alias("pos"), F.col("title").alias("topic"))
    rows = rows.unionByName(chunks.where("chunk_no < 20").select("doc_id", F.lit(1).alias("p"), F.col("chunk_no").alias("pos"), F.col("title").alias("topic")))
    for i, field in enumerate(("subject", "indicator")):
        rows = rows.unionByName(units.where("chunk_no < 30").select("doc_id", F.lit(2 + i).alias("p"), F.col("chunk_no").alias("pos"), F.col(field).alias("topic")))
    rows = rows.withColumn("topic", T.collapse_space("topic")).where(F.length("topic").between(2, 24) & ~F.col("topic").isin(*stop))
    first = rows.groupBy("doc_id", "topic").agg(F.min(F.struct("p", "pos")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("at.p", "at.pos", "topic"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "rank", "topic")


def structure_signals(chunks: DataFrame, units: DataFrame, most: int = 32) -> DataFrame:
    """Distinct signals of each chunk: its title, the parts of its heading path, its units' subjects and indicators, then
    its keywords while there are fewer than eight."""
    own = units.groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_set("subject")).alias("subjects"), F.array_sort(F.collect_set("indicator")).alias("indicators"))
    df = chunks.join(own, ["doc_id", "chunk_no"], "left")
    none = F.array().cast("array<string>")
    got = F.concat(F.array(T.text("title")), F.coalesce(F.split("heading_path", " / "), none) if "heading_path" in chunks.columns else none, F.coalesce("subjects", none), F.coalesce("indicators", none))
    got = F.array_distinct(F.filter(F.transform(got, lambda x: F.trim(x)), lambda x: x != ""))
    words = F.slice(T.search_terms("content"), 1, 8)
    return df.select("doc_id", "chunk_no", F.slice(F.when(F.size(got) < 8, F.array_union(got, words)).otherwise(got), 1, most).alias("signals"))
