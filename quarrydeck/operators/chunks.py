"""Chunking, chunk scores and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def chunk_blocks(docs: DataFrame, max_chars: int = 1800, sep: str = r"\n\s*\n", joiner: str = "\n\n", *, text: str = "text") -> DataFrame:
    """(doc_id, chunk_no, content): blocks between separators, packed greedily up to max_chars; longer blocks are cut.

    A fold over the blocks of a text in one expression; what is left of a cut block is a chunk of its own.
    """
    clean = F.regexp_replace(F.regexp_replace(T.text(text), "\r\n?", "\n"), "\u0000", "")
    blocks = F.filter(F.transform(F.split(clean, sep), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    pieces = F.flatten(F.transform(blocks, lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.length(b) - 1) / max_chars)), lambda i: F.struct(F.substring(b, i.cast("int") * max_chars + 1, F.lit(max_chars)).alias("t"), (F.length(b) > max_chars).alias("cut")))))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, piece: Column) -> Column:
        joined = F.when(acc["now"] == "", piece["t"]).otherwise(F.concat(acc["now"], F.lit(joiner), piece["t"]))
        fits = (F.length(joined) <= max_chars) & ~piece["cut"]
        kept = F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.struct(F.when(fits, acc["done"]).when(piece["cut"], F.concat(kept, F.array(piece["t"]))).otherwise(kept).alias("done"), F.when(fits, joined).when(piece["cut"], F.lit("")).otherwise(piece["t"]).alias("now"))

    packed = F.aggregate(pieces, zero, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))
    return docs.select("doc_id", F.posexplode(packed).alias("chunk_no", "content"))


def chunk_paragraphs(docs: DataFrame, limit: int | None = 40, sep: str = r"\n\s*\n", *, text: str = "text", heading: str = "stem") -> DataFrame:
    """Paragraphs with white space collapsed, the first ``limit`` of each text, under the file stem as heading."""
    parts = F.filter(F.transform(F.split(T.text(text), sep), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return docs.select("doc_id", F.col(heading).alias("title"), F.posexplode(F.slice(parts, 1, limit) if limit else parts).alias("chunk_no", "content"))


def markdown_type(content) -> Column:
    """figure (image link), table (a pipe in the first five lines) or text."""
    head = F.array_join(F.slice(F.split(T.text(content), "\n"), 1, 5), "\n")
    return F.when(T.text(content).rlike(r"!\[[^\]]*\]\("), "figure").when(head.contains("|"), "table").otherwise("text")


def markdown_title(content) -> Column:
    return F.nullif(F.trim(F.regexp_extract(T.text(content), r"(?m)^#{1,6}\s+(.+)$", 1)), F.lit(""))


def heading_path(blocks: DataFrame, *, levels: int = 6, order: str = "chunk_no") -> DataFrame:
    """Add heading_path: for each block, the last heading of every level that no later heading of a lower level has closed."""
    w = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = blocks.withColumn("level", T.heading_level("content"))
    last = {}
    for n in range(1, levels + 1):
        df = df.withColumn(f"h{n}", F.last(F.when(F.col("level") == n, F.struct(F.col(order).alias("at"), F.trim("content").alias("t"))), ignorenulls=True).over(w))
        closed = F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(F.col(f"h{m}.at"), F.lit(-1)) for m in range(1, n)))
        last[n] = F.when(F.col(f"h{n}.at") > closed, F.col(f"h{n}.t"))
    return df.withColumn("heading_path", F.concat_ws(" / ", *last.values())).drop(*(f"h{n}" for n in last))


def table_row_chunks(cells: DataFrame, rows: int = 200, columns: int = 24, chunks: int = 120) -> DataFrame:
    """Cells (doc_id, sheet, row, col, value) to one chunk a row, joined by bars; the row number is the page."""
    df = cells.where((F.col("row") <= rows) & (F.col("col") <= columns) & (F.trim("value") != ""))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.trim("value").alias("value")))), lambda x: x["value"]), " | ")
    df = df.groupBy("doc_id", "sheet", "row").agg(line.alias("content"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet", "row"))
    return df.withColumn("chunk_no", number - 1).where(F.col("chunk_no") < chunks).select("doc_id", "chunk_no", F.lit("table_row").alias("chunk_type"), F.col("sheet").alias("title"), F.col("row").alias("page_no"), "content")


def estimate_tokens(content) -> Column:
    t = T.text(content)
    return F.when(F.trim(t) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(t) / 4))).cast("int")


def target_limit(n: Column, ratio: float, least: int, cap: Column | int) -> Column:
    """Quota of a document with n items: a share, at least some, at most a cap and never more than there are."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    return F.least(n, cap, F.greatest(F.lit(least), F.ceil(n * ratio))).cast("int")


def sample_positions(n: Column, limit: Column, head: float, tail: float) -> Column:
    """Distinct positions from 0: a head, a tail, and the rest spread evenly over what lies between."""
    h = F.least(limit, F.ceil(limit * head)).cast("int")
    t = F.least(limit - h, F.floor(limit * tail)).cast("int")
    between, rest = n - h - t, limit - h - t
    seq = lambda k: F.when(k > 0, F.sequence(F.lit(0), k.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    spread = F.transform(seq(rest), lambda i: (h + F.floor((i + 1) * (between + 1) / (rest + 1) + 0.5) - 1).cast("int"))
    some = F.concat(seq(h), F.transform(seq(t), lambda i: (n - t + i).cast("int")), spread)
    return F.when(n <= limit, seq(n)).otherwise(F.array_distinct(some))


def sample_chunks(chunks: DataFrame, limit: int, head: float = 0.4, tail: float = 0.2) -> DataFrame:
    """Up to ``limit`` chunks of each document: head, tail and evenly from the middle, in order."""
    w = Window.partitionBy("doc_id")
    df = chunks.withColumn("pos", F.row_number().over(w.orderBy("chunk_no")) - 1).withColumn("n", F.count("*").over(w))
    return df.where(F.array_contains(sample_positions(F.col("n"), F.lit(limit), head, tail), F.col("pos").cast("int"))).drop("n")


def sample_overview(chunks: DataFrame, cap: int = 40, ratio: float = 0.10, least: int = 8) -> DataFrame:
    """A head, a tail, an even spread over the rest, then the best-scored chunks up to the quota."""
    w = Window.partitionBy("doc_id")
    df = chunks.withColumn("pos", F.row_number().over(w.orderBy("chunk_no")) - 1).withColumn("n", F.count("*").over(w))
    df = df.withColumn("quota", target_limit(F.col("n"), ratio, least, cap))
    even = F.floor(F.col("quota") * 0.75).cast("int")
    df = df.withColumn("fixed", F.array_contains(sample_positions(F.col("n"), F.greatest(F.lit(1), even), 0.25 / 0.75, 0.15 / 0.75), F.col("pos").cast("int")))
    rank = F.row_number().over(w.orderBy(F.desc("fixed"), F.desc(score_chunk()), "pos"))
    return df.withColumn("rank", rank).where(F.col("rank") <= F.col("quota")).drop("n", "fixed", "rank")


def score_chunk(title: str = "title", kind: str = "chunk_type", content: str = "content") -> Column:
    n = F.length(F.trim(T.text(content)))
    shape = F.when(F.col(kind) == "table_row", 1.1).when(F.col(kind) == "list", 0.8).otherwise(0.4)
    return F.round(F.when(F.trim(T.text(title)) != "", 1.2).otherwise(0.0) + shape + F.when(n.between(60, 700), 1.0).when(n > 700, 0.3).otherwise(0.0), 6)


#: Extra weight of cue words by document type.
TYPE_CUES = {"rule": (("应当", "不得", "必须", "标准"), 1.5), "report": (("同比", "增长", "下降", "%"), 1.2), "speech": (("强调", "指出", "要求"), 1.2)}


def score_chunk_by_type(cues=TYPE_CUES, *, position: str = "chunk_no", title: str = "title", kind: str = "chunk_type", content: str = "content", doc_type: str = "doc_type") -> Column:
    t, n = T.text(content), F.length(F.trim(T.text(content)))
    total = F.when(F.col(position) < 2, 2.5).otherwise(0.0) + F.when(F.trim(T.text(title)) != "", 1.5).otherwise(0.0) + F.when(F.col(kind).isin("sheet", "table_row"), 2.0).otherwise(0.0)
    total = total + F.when(n.between(80, 1200), 1.0).otherwise(0.0) + F.when(t.rlike(r"\d"), 0.8).otherwise(0.0) + F.when(t.contains("##"), 0.5).otherwise(0.0) + F.when(t.contains("|"), 0.5).otherwise(0.0)
    for name, (words, weight) in cues.items():
        total = total + F.when(F.col(doc_type) == name, T.count_of(t, words) * weight).otherwise(0.0)
    return F.round(total, 6)


def score_vector_target(title: str = "title", content: str = "content", kind: str = "kind") -> Column:
    n = F.length(F.trim(T.text(content)))
    return F.round(F.when(F.trim(T.text(title)) != "", 1.0).otherwise(0.0) + F.when(n.between(80, 900), 1.2).when(n > 900, 0.4).when(n >= 30, 0.6).otherwise(0.0) + F.when(F.col(kind) == "unit", 0.5).otherwise(0.0), 6)


def select_targets(items: DataFrame, score: Column, k: Column | int, by=("doc_id",), position: str = "chunk_no") -> DataFrame:
    """The k best-scored items of each group, ties by position (extraction and vector targets)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), position))
    return items.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k)


def select_graph_chunks(chunks: DataFrame, units: DataFrame, *, most: int = 60, scope: Column | None = None) -> DataFrame:
    """Chunks for graph extraction: an integer score of title, shape, units, variety and length; near copies (equal first
    500 characters) but the first are left out; the best ``most``, back in order."""
    u = units.groupBy("doc_id", "chunk_no").agg(F.sum(6 + 2 * (F.trim(T.text("subject")) != "").cast("int") + 2 * (F.trim(T.text("indicator")) != "").cast("int")).alias("unit_score"))
    t, n = T.text("content"), F.length(F.trim(T.text("content")))
    kind = F.when(F.col("chunk_type").contains("table"), 5).when(F.col("chunk_type").contains("list"), 3).when(F.col("chunk_type").contains("heading"), 4).otherwise(0)
    variety = F.least(F.lit(5), F.floor(F.size(T.search_terms("content")) / 8))
    score = F.when(F.trim(T.text("title")) != "", 4).otherwise(0) + kind + F.coalesce("unit_score", F.lit(0)) + variety + F.when(n >= 120, 2).otherwise(0) + F.when(n >= 450, 1).otherwise(0) + F.when(t.rlike(r"\d") | t.contains("|"), 2).otherwise(0) - F.when(n < 20, 1).otherwise(0)
    if scope is not None:
        score = score + F.when(scope, 120).otherwise(0)
    df = chunks.join(u, ["doc_id", "chunk_no"], "left").withColumn("score", score.cast("int")).withColumn("head", F.sha2(F.substring(T.collapse_space("content"), 1, 500), 256))
    first = F.row_number().over(Window.partitionBy("doc_id", "head").orderBy("chunk_no"))
    df = df.withColumn("copy", first).where("copy = 1")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_no"))
    return df.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "chunk_no", "score", "rank")
