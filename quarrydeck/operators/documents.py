"""Document classification, profiles, overviews and duplicates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.lineage import cut


def classify_doc_type(df: DataFrame, *, ext: str = "ext", stem: str = "stem", preview: str = "preview", stem_cues=L.STEM_CUES, preview_cues=L.PREVIEW_CUES) -> DataFrame:
    """Add doc_type by extension, then cues in the file stem, then in the first 4,000 characters."""
    by_preview = T.first_cue(F.substring(T.text(preview), 1, 4000), preview_cues, "unknown")
    by_stem = T.first_cue(T.text(stem), stem_cues, "")
    return df.withColumn("doc_type", F.when(F.col(ext).isin(*L.EXCEL_EXTENSIONS), "excel").when(by_stem != "", by_stem).otherwise(by_preview))


def detect_dev_domain(df: DataFrame, *, ext: str = "ext", name: str = "filename", preview: str = "preview", title_cues=L.DEV_TITLE_CUES, text_cues=L.DEV_TEXT_CUES) -> DataFrame:
    """Add is_dev and domain: code files, one cue in the name or two in the first 4,000 characters."""
    dev = F.coalesce(F.col(ext).isin(*L.CODE_EXTENSIONS), F.lit(False)) | (T.count_of(F.lower(T.text(name)), title_cues) >= 1) | (T.count_of(F.lower(F.substring(T.text(preview), 1, 4000)), text_cues) >= 2)
    return df.withColumn("is_dev", dev).withColumn("domain", F.when(dev, "development").otherwise("business"))


def document_profile(docs: DataFrame, chunks: DataFrame, units: DataFrame, *, terms: Mapping[str, Sequence[str]] = L.PROFILE_TERMS, strategies: Mapping[str, str] = L.STRATEGIES, sample_chunks: int = 240, sample_units: int = 160) -> DataFrame:
    """One profile a document, from its first chunks and units.

    docs(doc_id, title, filename, doc_type), chunks(doc_id, chunk_no, chunk_type, title, content), units(doc_id, unit_no,
    subject, indicator, content). Type scores count the terms found; the best type, ratios and counts give structure,
    density, suitability, strategy and confidence.
    """
    w = Window.partitionBy("doc_id")
    c = chunks.withColumn("k", F.row_number().over(w.orderBy("chunk_no"))).withColumn("chunk_count", F.count("*").over(w)).where(F.col("k") <= sample_chunks)
    kind, content = F.lower(T.text("chunk_type")), T.text("content")
    c = c.groupBy("doc_id").agg(
        F.max("chunk_count").alias("chunk_count"), F.count("*").alias("sampled"),
        F.count_if(kind.contains("table")).alias("tables"), F.count_if(kind.contains("list") & ~kind.contains("table")).alias("lists"),
        F.countDistinct(F.when(F.trim("title") != "", F.trim("title"))).alias("headings"),
        F.sum(F.length(content)).alias("chars"), F.sum(F.length(F.regexp_replace(content, "[^0-9]", ""))).alias("digits"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "title", F.substring(content, 1, 800)).alias("t")))), lambda x: x["t"]), " ").alias("chunk_text"),
    )
    u = units.withColumn("k", F.row_number().over(w.orderBy("unit_no"))).withColumn("unit_count", F.count("*").over(w)).where(F.col("k") <= sample_units)
    u = u.groupBy("doc_id").agg(F.max("unit_count").alias("unit_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "subject", "indicator", "content").alias("t")))), lambda x: x["t"]), " ").alias("unit_text"))
    df = docs.select("doc_id", "title", "filename", "doc_type").join(c, "doc_id", "left").join(u, "doc_id", "left")
    df = df.fillna(0, ["chunk_count", "sampled", "tables", "lists", "headings", "chars", "digits", "unit_count"])
    least = F.greatest(F.lit(1), F.col("sampled"))
    df = df.withColumns({"table_ratio": F.round(F.col("tables") / least, 4), "heading_ratio": F.round(F.col("headings") / least, 4), "digit_density": F.when(F.col("chars") > 0, F.round(F.col("digits") / F.col("chars"), 4)).otherwise(0.0), "mean_chars": F.floor(F.col("chars") / least)})
    hay = T.compact(F.lower(F.concat_ws(" ", "title", "filename", "chunk_text", "unit_text")))
    df = df.withColumn("hay", hay)
    excel = (F.lower(T.text("doc_type")) == "excel") | F.lower(T.text("filename")).rlike(r"\.xlsx?$")
    plus = {
        "table": F.when(excel, 5).otherwise(0) + F.when(F.col("table_ratio") >= 0.35, 4).when(F.col("table_ratio") >= 0.18, 2).otherwise(0) + F.when(F.col("digit_density") >= 0.18, 2).when(F.col("digit_density") >= 0.08, 1).otherwise(0),
        "report": F.when((F.col("chunk_count") >= 20) & (F.col("heading_ratio") >= 0.18), 1).otherwise(0),
    }
    df = df.withColumns({f"s_{k}": T.count_of(F.col("hay"), words) + plus.get(k, F.lit(0)) for k, words in terms.items()}).drop("hay", "chunk_text", "unit_text")
    order = {k: i for i, k in enumerate(terms)}
    ranked = F.array_sort(F.array(*(F.struct((-F.col(f"s_{k}")).alias("neg"), F.lit(i).alias("i"), F.lit(k).alias("kind")) for k, i in order.items())))
    df = df.withColumn("ranked", ranked).withColumn("top", -F.col("ranked")[0]["neg"]).withColumn("second", -F.col("ranked")[1]["neg"])
    df = df.withColumn("profile_type", F.when(F.col("top") < 2, "unknown").otherwise(F.col("ranked")[0]["kind"])).drop("ranked")
    df = df.withColumn("structure_type", F.when((F.col("profile_type") == "table") | (F.col("table_ratio") >= 0.35), "table_heavy").when((F.col("heading_ratio") >= 0.18) | (F.col("lists") >= 4), "sectioned").when((F.col("mean_chars") >= 180) & (F.col("sampled") - F.col("tables") - F.col("lists") >= F.col("lists")), "narrative").otherwise("mixed"))
    dense = (F.col("chunk_count") >= 30) | (F.col("unit_count") >= 12) | (F.col("top") >= 8) | ((F.col("table_ratio") >= 0.25) & (F.col("digit_density") >= 0.08))
    df = df.withColumn("knowledge_density", F.when(dense, "high").when((F.col("chunk_count") >= 8) | (F.col("unit_count") >= 4) | (F.col("top") >= 4), "medium").otherwise("low"))
    low = F.col("knowledge_density") == "low"
    strong = F.col("profile_type").isin("project_plan", "regulation", "paper", "technical_spec") & ~low
    df = df.withColumn("graph_suitability", F.when(low & ((F.col("profile_type") == "unknown") | (F.col("structure_type") == "narrative")), "evidence_only").when(F.col("profile_type") == "speech", "weak").when(strong, "strong").when(F.col("profile_type").isin("table", "report") | (F.col("top") >= 4), "moderate").otherwise("weak"))
    named = F.create_map(*(F.lit(x) for kv in strategies.items() for x in kv))
    df = df.withColumn("strategy", F.when(F.col("graph_suitability") == "evidence_only", "evidence_only").otherwise(F.coalesce(F.element_at(named, F.col("profile_type")), F.lit("default_extraction"))))
    sure = 0.42 + F.least(F.lit(0.28), F.col("top") / 24) + F.least(F.lit(0.16), F.greatest(F.lit(0), F.col("top") - F.col("second")) / 16)
    for more in (F.col("chunk_count") >= 8, F.col("unit_count") >= 4, (F.col("table_ratio") >= 0.35) | (F.col("heading_ratio") >= 0.18)):
        sure = sure + F.when(more, 0.04).otherwise(0.0)
    df = df.withColumn("confidence", F.round(F.least(F.lit(0.94), F.greatest(F.lit(0.30), sure)), 4))
    df = df.withColumn("review_required", (F.col("confidence") < 0.62) & (F.col("strategy") != "evidence_only"))
    notes = F.array(F.concat(F.lit("docType="), "profile_type"), F.concat(F.lit("structureType="), "structure_type"), F.concat(F.lit("graphSuitability="), "graph_suitability"), F.concat(F.lit("recommendedStrategy="), "strategy"))
    return df.withColumn("notes", notes)


def extraction_profile(docs: DataFrame, families: Sequence[tuple[str, Sequence[str]]], *, strategy: str = "strategy", text: Sequence[str] = ("title", "filename")) -> DataFrame:
    """Route by the stored strategy, else by families of keywords."""
    by_word = T.first_cue(F.lower(F.concat_ws(" ", *text)), families, "default")
    return docs.withColumn("route", F.when(F.col(strategy).isNotNull() & (F.col(strategy) != "default_extraction"), F.regexp_replace(strategy, "_extraction$|_summary$|_attribute_first$", "")).otherwise(by_word))


def missing_profiles(docs: DataFrame, chunks: DataFrame, profiles: DataFrame, limit: int | None = None) -> DataFrame:
    """Parsed documents with chunks and without a profile, oldest first."""
    df = docs.where("status = 'success'").join(profiles.select("doc_id"), "doc_id", "left_anti").join(chunks.select("doc_id"), "doc_id", "left_semi").select("doc_id")
    return df.orderBy("doc_id").limit(limit) if limit else df


def profile_stats(docs: DataFrame, chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    has_chunk, has_profile = chunks.select("doc_id").distinct().withColumn("c", F.lit(True)), profiles.select("doc_id").distinct().withColumn("p", F.lit(True))
    df = docs.join(has_chunk, "doc_id", "left").join(has_profile, "doc_id", "left")
    ready = F.col("c").isNotNull() & (F.col("status") == "success")
    return df.agg(F.count_if(ready).alias("eligible"), F.count_if(ready & F.col("p").isNotNull()).alias("profiled"), F.count_if(ready & F.col("p").isNull()).alias("missing"))


def preview_text(chunks: DataFrame, n: int = 2000, joiner: str = "\n\n") -> DataFrame:
    """The chunks' text in order, joined by blank lines, cut to n characters; only chunks that start (or whose joiner starts) before are collected."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_no", "content")))
    before = F.sum(F.length("content") + len(joiner)).over(Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < n + len(joiner)).select("doc_id", "chunk_no", F.substring("content", 1, n).alias("content"))
    return chunks.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(rows, lambda x: x["content"]), joiner), 1, n).alias("preview"))


def top_keywords(docs: DataFrame, k: int = 12, shortest: int = 2, longest: int = 14, *, text: str = "text", split: str = r"[\s\p{P}\p{S}]+") -> DataFrame:
    """The k most frequent tokens of each document, ties by first appearance: (doc_id, rank, keyword, n)."""
    tokens = docs.select("doc_id", F.posexplode(F.split(T.text(text), split)).alias("pos", "keyword")).where(F.length("keyword").between(shortest, longest))
    counts = tokens.groupBy("doc_id", "keyword").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "rank", "keyword", "n")


def first_matches(c: Column, pattern: str, k: int) -> Column:
    """The first k distinct matches of a pattern's first group (detect_entities)."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern))), 1, k)


def time_range(c: Column) -> Column:
    """Smallest and largest year 19xx or 20xx as ``a-b``, one year alone, or null."""
    years = F.regexp_extract_all(c, F.lit(r"((?:19|20)\d{2})"))
    low, high = F.array_min(years), F.array_max(years)
    return F.when(low == high, low).when(low.isNotNull(), F.concat_ws("-", low, high))


def detect_conclusions(chunks: DataFrame, cues: Sequence[str], k: int = 6, cut: int = 120) -> DataFrame:
    """The first k distinct chunk texts of each document that hold a cue."""
    hits = chunks.where(T.any_of(T.text("content"), cues)).select("doc_id", "chunk_no", F.substring(T.collapse_space("content"), 1, cut).alias("conclusion"))
    hits = hits.groupBy("doc_id", "conclusion").agg(F.min("chunk_no").alias("chunk_no"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no", "conclusion"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "rank", "conclusion")


def mapreduce_summary(chunks: DataFrame, group: int = 8, groups: int = 4, cuts: tuple[int, int, int] = (120, 220, 360)) -> DataFrame:
    """Cut chunks, join them by groups, join the first groups: a summary without a model."""
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no")) - 1
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    rows = chunks.withColumn("pos", pos).withColumn("g", F.floor(F.col("pos") / group)).where(F.col("g") < groups).withColumn("part", F.substring(T.collapse_space("content"), 1, cuts[0]))
    rows = rows.groupBy("doc_id", "g").agg(F.substring(F.array_join(ordered("pos", "part"), " "), 1, cuts[1]).alias("part"))
    return rows.groupBy("doc_id").agg(F.substring(F.array_join(ordered("g", "part"), " "), 1, cuts[2]).alias("summary"))


def document_overview(docs: DataFrame, chunks: DataFrame, conclusion_cues: Sequence[str], entity_pattern: str) -> DataFrame:
    """summary, sections, keywords, entities, time range and conclusions of each document as one struct column."""
    sections = chunks.where(F.trim("title") != "").groupBy("doc_id", F.trim("title").alias("s")).agg(F.min("chunk_no").alias("k"))
    listed = lambda df, key, value, name, n: df.groupBy("doc_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), 1, n).alias(name))
    df = docs.select("doc_id", first_matches(T.text("text"), entity_pattern, 10).alias("entities"), time_range(T.text("text")).alias("time_range"))
    for part in (mapreduce_summary(chunks), listed(sections, "k", "s", "sections", 16), listed(top_keywords(docs), "rank", "keyword", "keywords", 12), listed(detect_conclusions(chunks, conclusion_cues), "rank", "conclusion", "conclusions", 6)):
        df = df.join(part, "doc_id", "left")
    return df.select("doc_id", F.struct("summary", "sections", F.slice("keywords", 1, 8).alias("key_topics"), "keywords", "entities", "time_range", "conclusions").alias("overview"))


def exact_duplicates(docs: DataFrame, *, key: str = "file_hash", order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add canonical_id (the first with the hash), duplicates (rows with it) and is_duplicate, by one aggregation and a join."""
    best = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("duplicates"))
    df = docs.join(best.select(key, F.col("first.doc_id").alias("canonical_id"), "duplicates"), key, "left")
    return df.withColumn("canonical_id", F.coalesce("canonical_id", "doc_id")).withColumn("is_duplicate", F.col("canonical_id") != F.col("doc_id"))


def _seeded(seed: int):
    return lambda v: F.xxhash64(v, F.lit(seed))


def shingle_sets(docs: DataFrame, *, text: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, key, s): the word shingles of each text as a sorted set, and the set's hash; texts without a word have no row.

    Texts with fewer words than a shingle are one shingle.
    """
    tokens = F.filter(F.split(F.lower(T.text(text)), r"\s+"), lambda x: x != "")
    sh = F.when(F.size("w") > words, F.transform(F.sequence(F.lit(0), F.size("w") - words), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, words), " ")))).otherwise(F.array(F.xxhash64(F.array_join("w", " "))))
    sets = docs.select("doc_id", tokens.alias("w")).where(F.size("w") > 0).select("doc_id", F.array_sort(F.array_distinct(sh)).alias("s"))
    return sets.select("doc_id", F.xxhash64("s").alias("key"), "s")


def shingle_members(docs: DataFrame, *, text: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, representative): the smallest id whose text has the same shingles; the pairs of shingle_links are between these."""
    keys = cut(shingle_sets(docs, text=text, words=words).select("doc_id", "key"))
    return keys.join(keys.groupBy("key").agg(F.min("doc_id").alias("representative")), "key").select("doc_id", "representative")


def shingle_links(docs: DataFrame, *, text: str = "text", words: int = 5, hashes: int = 20, rows: int = 2, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, jaccard) of word-shingle sets at the threshold or more; candidates share a band of their min-hashes.

    Sets of equal shingles meet once, through their smallest id, so copies make no pairs among themselves; the pairs are
    between representatives, whose members shingle_members returns.
    """
    sets = shingle_sets(docs, text=text, words=words)
    sets = sets.groupBy("key").agg(F.min(F.struct("doc_id", "s")).alias("x")).select("x.doc_id", "x.s")
    signature = F.array(*(F.array_min(F.transform("s", _seeded(i))) for i in range(hashes)))
    bands = sets.select("doc_id", signature.alias("sig")).select("doc_id", F.explode(F.array(*(F.xxhash64(F.lit(b), *(F.col("sig")[b * rows + r] for r in range(rows))) for b in range(hashes // rows)))).alias("band"))
    a, b = bands.alias("a"), bands.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b", F.round(both / (F.size("sa") + F.size("sb") - both), 6).alias("jaccard")).where(F.col("jaccard") >= threshold)


def set_links(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, jaccard) of sets (doc_id, s) at the threshold or more, all of them, by prefix filters.

    The members of a set are put in the order of how few sets hold them. Two sets of sizes m and n at the threshold t share
    one of the first m - ceil(t * m) + 1 and n - ceil(t * n) + 1, so only these meet; a pair is dropped unseen if its sizes are
    too far apart, or if too little is left of either behind the first that they share (position filter). ``sets`` are distinct.
    """
    members = sets.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("m"))
    held = members.groupBy("m").agg(F.count("*").alias("sets"))
    order = members.join(held, "m").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "m"))).alias("o"))
    first = F.slice("o", 1, F.col("n") - F.ceil(threshold * F.col("n") - 1e-9).cast("int") + 1)
    heads = cut(order.select("doc_id", "n", F.posexplode(first).alias("at", "x")).where("x.sets > 1").select("doc_id", "n", "at", F.col("x.m").alias("m")))
    side = lambda p: heads.select("m", *(F.col(c).alias(f"{c}_{p}") for c in ("doc_id", "n", "at")))
    least = F.ceil(threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    near = (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= least - F.least("at_a", "at_b"))
    pairs = side("a").join(side("b"), "m").where((F.col("doc_id_a") < F.col("doc_id_b")) & near).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both / (F.size("sa") + F.size("sb") - both)
    return pairs.select("a", "b", alike.alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-9)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks, as the standard library's sequence matcher gives it, 0 for an empty side (pandas UDF)."""
    return F.pandas_udf(_ratio, "double")(a, b)


def possible_duplicates(docs: DataFrame, threshold: float = 0.82, **candidates) -> DataFrame:
    """Best near-duplicate (doc_id, other_id, score) of each document among its candidates, ties by the smaller id.

    score = .45 title ratio + .45 ratio of the first 1,200 characters + .1 same type + .1 sizes within a tenth.

    Candidates share title and first characters, whatever the rest of the text, or shingles of the whole text (sets at
    ``jaccard`` or more), or pairs of words of the first 1,200 characters (sets at ``head`` or more). Documents of equal title, first characters, type and size have the
    same scores and count as one copy group: groups are weighed against each other and against themselves, and every document
    takes its group's best, so copies make no pairs. A document without a word has no row.
    """
    own = {k: candidates[k] for k in ("text", "words") if k in candidates}
    jaccard, head = candidates.pop("jaccard", 0.8), candidates.pop("head", 0.6)
    named = docs.select("doc_id", T.text("title").alias("title"), F.substring(T.text(own.get("text", "text")), 1, 1200).alias("preview"), "doc_type", F.col("size").cast("long").alias("size"))
    whole = shingle_members(docs, **own).withColumnRenamed("representative", "of_text")
    heads = shingle_members(named, text="preview", words=2).withColumnRenamed("representative", "of_preview")
    # A document's group is a hash of the parts as JSON: null and empty differ, and no part runs into the next.
    rows = named.join(whole, "doc_id").join(heads, "doc_id", "left").withColumn("face", F.md5(F.to_json(F.struct("title", "preview"))))
    rows = cut(rows.withColumn("grp", F.md5(F.to_json(F.struct("face", "doc_type", "size")))).distinct())
    members = rows.select("doc_id", "grp").distinct()
    groups = cut(rows.groupBy("grp").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("face", "title", "preview", "doc_type", "size"))))
    second = members.join(groups.select("grp", "first"), "grp").where(F.col("doc_id") > F.col("first")).groupBy("grp").agg(F.min("doc_id").alias("second"))

    faces = groups.groupBy("face", "title", "preview").agg(F.min("first").alias("at"))
    side = lambda df, p: df.select(*(F.col(c).alias(f"{c}_{p}") for c in df.columns))
    pairs = None
    pairs_of_words = cut(shingle_sets(named, text="preview", words=2).groupBy("key").agg(F.min(F.struct("doc_id", "s")).alias("x")).select("x.doc_id", "x.s"))
    for by, found in (("of_text", shingle_links(docs, threshold=jaccard, **candidates)), ("of_preview", set_links(pairs_of_words, head))):
        links = cut(found.select("a", "b"))
        kin = rows.where(F.col(by).isNotNull()).groupBy("face", F.col(by).alias("set")).agg(F.min("doc_id").alias("at"))
        a, b = side(kin, "a"), side(kin, "b")
        within = a.join(b, (F.col("set_a") == F.col("set_b")) & (F.col("face_a") != F.col("face_b"))).select("face_a", "face_b")
        across = a.join(links, F.col("set_a") == F.col("a")).join(b, F.col("set_b") == F.col("b")).where("face_a != face_b").select("face_a", "face_b")
        part = within.unionByName(across)
        pairs = part if pairs is None else pairs.unionByName(part)
    pairs = pairs.select(F.least("face_a", "face_b").alias("face_a"), F.greatest("face_a", "face_b").alias("face_b")).distinct()
    both = pairs.join(side(faces, "a"), "face_a").join(side(faces, "b"), "face_b")
    turned = F.col("at_a") > F.col("at_b")  # the ratio depends on the order: the smaller document comes first
    pick = lambda c: (F.when(turned, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")), F.when(turned, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")))
    ratio = 0.45 * sequence_ratio(*pick("title")) + 0.45 * sequence_ratio(*pick("preview"))
    weighed = both.select("face_a", "face_b", ratio.alias("alike")).where(F.col("alike") + 0.2 >= threshold - 1e-6)
    itself = 0.45 * (F.col("title") != "").cast("int") + 0.45 * (F.col("preview") != "").cast("int")
    weighed = cut(weighed.union(weighed.select("face_b", "face_a", "alike"))).union(faces.select("face", F.col("face").alias("other"), itself))

    traits = groups.join(second, "grp", "left").select("grp", "face", "first", "second", "doc_type", "size")
    a, b = side(traits, "a"), side(traits.drop("second"), "b")
    df = a.join(weighed, "face_a").join(b, "face_b").where("grp_a != grp_b or second_a is not null")
    near = F.least("size_a", "size_b") / F.greatest("size_a", "size_b", F.lit(1)) >= 0.9
    score = F.round(F.col("alike") + 0.1 * F.col("doc_type_a").eqNullSafe(F.col("doc_type_b")).cast("int") + 0.1 * F.coalesce(near, F.lit(False)).cast("int"), 6)
    df = df.withColumn("score", score).where(F.col("score") >= threshold)
    # The first of a group has the second as its best copy, all others have the first.
    best = lambda other: F.min(F.struct((-F.col("score")).alias("n"), other.alias("other_id")))
    other = F.when(F.col("grp_a") == F.col("grp_b"), F.col("second_a")).otherwise(F.col("first_b"))
    df = df.groupBy(F.col("grp_a").alias("grp")).agg(F.min("first_a").alias("first"), best(other).alias("of_first"), best(F.col("first_b")).alias("of_rest"))
    df = members.join(df, "grp").withColumn("x", F.when(F.col("doc_id") == F.col("first"), F.col("of_first")).otherwise(F.col("of_rest")))
    return df.select("doc_id", F.col("x.other_id").alias("other_id"), (-F.col("x.n")).alias("score"))


def related_documents(docs: DataFrame, vectors: DataFrame, k: int = 5, least: float = 0.2, *, queries: DataFrame | None = None, blocks: int | None = None, block_rows: int = 20_000) -> DataFrame:
    """(doc_id, other_id, score, rank, relation) of the documents of ``queries`` (doc_id), a stated set, against all others.

    Equal hashes score 1, others .25 title + .15 preview trigrams + .6 vector cosine. The k best from ``least`` on are
    related, and the best one is shown in any case. Exact: all documents lie in blocks of bounded size, each query goes to
    each block once, and a block keeps the k best of each query. All other documents get the k first copies of their content
    by the hash alone. Without ``queries`` every document is one, which costs all pairs.
    """
    from .retrieval import cosine

    hashed = lambda c: F.transform(T.trigrams(c), lambda x: F.xxhash64(x))
    base = cut(docs.select("doc_id", "file_hash", hashed("title").alias("tt"), hashed("preview").alias("tp")).join(vectors.select("doc_id", "vector"), "doc_id", "left"))
    blocks = blocks or max(16, -(-base.count() // block_rows))
    stated = (docs if queries is None else queries).select(F.col("doc_id").alias("a")).distinct()
    side = lambda p: base.select(F.col("doc_id").alias(p), *(F.col(c).alias(f"{c}_{p}") for c in ("tt", "tp", "file_hash", "vector")))
    both = lambda x: F.size(F.array_intersect(f"{x}_a", f"{x}_b")).alias(f"{x}_both")
    alike = lambda x: F.col(f"{x}_both") / F.greatest(F.size(f"{x}_a") + F.size(f"{x}_b") - F.col(f"{x}_both"), F.lit(1))
    score = F.when(F.col("file_hash_a") == F.col("file_hash_b"), 1.0).otherwise(0.25 * alike("tt") + 0.15 * alike("tp") + 0.6 * cosine("vector_a", "vector_b"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other_id"))

    q = side("a").join(stated, "a", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    df = side("b").withColumn("block", F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int")).join(q, "block").where("a != b")
    df = df.select("a", "b", "block", *(F.col(f"{c}_{p}") for c in ("tt", "tp", "file_hash", "vector") for p in "ab"), both("tt"), both("tp"))
    df = df.select(F.col("a").alias("doc_id"), F.col("b").alias("other_id"), "block", F.round(score + 1e-9, 6).alias("score"))
    df = df.withColumn("rank", rank("doc_id", "block")).where(F.col("rank") <= k).select("doc_id", "other_id", "score")
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("other_id"))
    copies = docs.where("file_hash is not null").select("file_hash", F.col("doc_id").alias("other_id")).withColumn("first", first).where(F.col("first") <= k + 1).drop("first")
    rest = docs.select("file_hash", F.col("doc_id").alias("a")).join(stated, "a", "left_anti").join(copies, "file_hash").where("a != other_id")
    df = df.unionByName(rest.select(F.col("a").alias("doc_id"), "other_id", F.lit(1.0).alias("score"))).withColumn("rank", rank("doc_id"))
    df = df.where(((F.col("score") >= least) & (F.col("rank") <= k)) | (F.col("rank") == 1))
    return df.select("doc_id", "other_id", "score", "rank", F.when(F.col("score") == 1, "exact").when(F.col("score") >= least, "possible").otherwise("nearest").alias("relation"))


def document_detail(docs: DataFrame, chunks: DataFrame, units: DataFrame) -> DataFrame:
    """Documents with their numbers of chunks and units and of files with the same content."""
    n_chunks, n_units = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks")), units.groupBy("doc_id").agg(F.count("*").alias("n_units"))
    copies = docs.groupBy("file_hash").agg((F.count("*") - 1).alias("n_copies"))
    df = docs.select("doc_id", "title", "filename", "file_hash", "source").join(n_chunks, "doc_id", "left").join(n_units, "doc_id", "left").join(copies, "file_hash", "left")
    return df.fillna(0, ["n_chunks", "n_units"]).drop("file_hash")


def children_page(children: DataFrame, fields: Sequence[str], keyword: str, order: Sequence[str], size: int, number: int = 1) -> DataFrame:
    """A page of each document's children that hold the keyword in a field, with the total (document_chunks, document_units)."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(T.text(f)).contains(keyword.lower())
    w = Window.partitionBy("doc_id")
    df = children.where(hit).withColumn("total", F.count("*").over(w)).withColumn("row_no", F.row_number().over(w.orderBy(*order)))
    return df.where(F.col("row_no").between((number - 1) * size + 1, number * size))
