"""Batches of queries against documents, units and chunks: lexical, vector and graph legs, merged and ranked.

Queries are a table (query_id, query). Lexical legs send blocks of queries to the texts and find what these hold, as LIKE
does; the corpus isn't shuffled, and each task keeps the best of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .contain import nearest, score_items
from .relational import sum_of_best

BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint behind a check of the size: nothing above ``rows`` rows, or ``size`` characters as JSON, is broadcast."""
    head = df.limit(rows + 1).select(F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).alias("n"))
    n, total = head.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def prepared(queries: DataFrame, most_tokens: int = 6) -> DataFrame:
    """(query_id, query, raw, tight, tokens): lower-case forms and up to six tokens of two characters or more."""
    tokens = F.slice(F.filter(F.transform(T.query_tokens("query"), lambda x: F.lower(x)), lambda x: F.length(x) >= 2), 1, most_tokens)
    return queries.select("query_id", "query", F.lower(F.trim(T.text("query"))).alias("raw"), T.tight("query").alias("tight"), tokens.alias("tokens"))


def keyword_leg(queries: DataFrame, items: DataFrame, kind: str, id_cols: Sequence[str], fields, top: int | None = None, floors: Mapping | None = None) -> DataFrame:
    """(query_id, kind, doc_id, item_id, score, match_type) of items that hold the query, its tight form or a token of it.

    Containment finds the items (see ``contain``), so a hit inside a word or an unspaced run counts. A blank query finds
    nothing. With ``top`` each query has its best so many items; ``floors``, scores by query_id below which none is wanted.
    """
    texts = []
    for name, _, _, loose in fields:
        texts += [F.lower(T.text(name)), T.tight(name)] if loose else [F.lower(T.text(name))]
    return score_items(prepared(queries).select("query_id", "raw", "tight", "tokens"), items, F.concat_ws(":", F.lit(kind), *id_cols), kind, fields, texts, top, floors)


#: From so many queries on, keyword_search first looks at every so many-th document.
MANY_QUERIES, LOOK = 512, 16


def keyword_search(queries: DataFrame, docs: DataFrame, units: DataFrame, chunks: DataFrame, top: int = 80) -> DataFrame:
    """Documents, units and chunks for each query, the best ``top`` of them.

    For many queries a first look at a share of the documents gives for each query a score that ``top`` items have: no item
    below it can be among the best of all. All items are searched, but only those that can reach it are weighed and shuffled.
    """
    def legs(look: bool, floors: Mapping | None = None) -> DataFrame:
        found = None
        for items, *leg in ((docs, "document", ["doc_id"], L.DOCUMENT_FIELDS), (units, "unit", ["doc_id", "chunk_no"], L.UNIT_FIELDS), (chunks, "chunk", ["doc_id", "chunk_no"], L.CHUNK_FIELDS)):
            part = keyword_leg(queries, items.where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOK)) == 0) if look else items, *leg, top, floors)
            found = part if found is None else found.unionByName(part)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
        return found.withColumn("rank", rank)

    floors = None
    if queries.limit(MANY_QUERIES).count() == MANY_QUERIES:
        floors = {r.query_id: r.score for r in legs(True).where(F.col("rank") == top).select("query_id", "score").collect()}
    return legs(False, floors).where(F.col("rank") <= top)


def candidate_documents(legs: DataFrame, n: int) -> DataFrame:
    """The n documents of each query with the best hit of any kind."""
    best = legs.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= n)


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b) -> Column:
    """Cosine of two arrays; 0 if one is empty or the lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    parts = F.struct(_dot(a, b).alias("dot"), (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))).alias("norm"))
    return F.when(fits, T.let(parts, lambda p: F.when(p["norm"] > 0, p["dot"] / p["norm"]).otherwise(0.0))).otherwise(0.0)


def normalized(v) -> Column:
    """The vector at unit length; null for a zero vector."""
    own = F.transform(v, lambda x: x.cast("double"))
    return T.let(F.struct(own.alias("v"), F.sqrt(_dot(own, own)).alias("n")), lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda x: x / p["n"])))


def _embedded(texts: pa.Array, dims: int, most: int, empty: float) -> pa.Array:
    sums = np.zeros((len(texts), dims))
    for i, text in enumerate(texts.to_pylist()):
        if not text:
            sums[i, 0] = empty
            continue
        code = np.frombuffer(text[:most].encode("utf-32-le"), np.uint32) % 97 / 97.0
        sums[i] = np.bincount(np.arange(len(code)) % dims, code, dims)  # in the order of the characters, as a plain sum has it
    square = np.zeros(len(sums))
    for d in range(dims):
        square = square + sums[:, d] * sums[:, d]
    norm = np.sqrt(square)[:, None]
    sums = np.divide(sums, norm, out=sums, where=norm > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * dims, pa.int32()), pa.array(sums.ravel()))


def hash_embedding(text, dims: int = 32, most: int = 2048, empty: float = 0.0) -> Column:
    """Sums of (code point % 97) / 97 by position modulo ``dims``, with unit length; the text's first 2,048 characters. An empty
    text counts as one character worth ``empty``, so that it is a zero vector unless told otherwise."""
    return F.arrow_udf(lambda texts: _embedded(texts, dims, most, empty), "array<double>")(T.text(text))


def vector_topk(queries: DataFrame, items: DataFrame, k: int, *, least: float = 0.05, weight: float = 3.0, q_vector: str = "vector", vector: str = "vector") -> DataFrame:
    """(query_id, item_id, cosine, score, rank): exact.

    Blocks of a stated set of queries meet all items where these lie; each task keeps the k best of each query, and those are
    ranked again. Vectors of other lengths don't compare.
    """
    i = items.select("item_id", normalized(F.col(vector)).alias("v")).where("v is not null")
    q = queries.select("query_id", normalized(F.col(q_vector)).alias("q")).where("q is not null")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id"))
    df = nearest(q, i, k, least).withColumn("rank", best).where(F.col("rank") <= k)
    return df.select("query_id", "item_id", "cosine", F.round(F.col("cosine") * weight, 6).alias("score"), "rank")


def semantic_leg(queries: DataFrame, items: DataFrame, k: int, embed=None) -> DataFrame:
    """(query_id, item_id, cosine, score, rank): the k items whose texts are nearest to each query by their embeddings.

    queries(query_id, query), items(item_id, text). All items are scanned, so no pass over candidate documents is needed first.
    """
    embed = embed or hash_embedding
    return vector_topk(queries.select("query_id", embed(F.lower(F.trim(T.text("query")))).alias("vector")), items.select("item_id", embed(T.text("text")).alias("vector")), k)


def vector_audit(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows per dimension, and rows without a vector (dimension null)."""
    return items.select("item_id").join(vectors, "item_id", "left").groupBy(F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dimensions")).agg(F.count("*").alias("n"))


def hybrid_merge(keyword: DataFrame, semantic: DataFrame, w_keyword: float = 1.12, w_semantic: float = 0.22) -> DataFrame:
    """Best score of each leg and key; hits of both legs count 1.12 * keyword + .22 * semantic and are called hybrid."""
    best = lambda df, name: df.groupBy("query_id", "item_id").agg(F.max("score").alias(name))
    df = best(keyword, "k").join(best(semantic, "s"), ["query_id", "item_id"], "full_outer")
    both = F.col("k").isNotNull() & F.col("s").isNotNull()
    score = F.when(both, w_keyword * F.col("k") + w_semantic * F.col("s")).otherwise(F.coalesce("k", "s"))
    return df.select("query_id", "item_id", F.round(score + 1e-9, 6).alias("score"), F.when(both, "hybrid").when(F.col("k").isNotNull(), "keyword").otherwise("semantic").alias("leg"))


def phrase_hit(field, raw: str = "raw") -> Column:
    """3 if a text holds the query, 2 without white space, 1 without punctuation, else 0."""
    low = F.lower(T.text(field))
    squeezed, bare = T.compact(raw), T.tight(raw)
    return F.when(F.trim(low) == "", 0).when((F.col(raw) != "") & low.contains(F.col(raw)), 3).when((squeezed != "") & T.compact(low).contains(squeezed), 2).when((bare != "") & T.tight(low).contains(bare), 1).otherwise(0)


def exact_phrase_priority(weights=(("title", 3), ("content", 4), ("filename", 2), ("path", 1))) -> Column:
    return sum((phrase_hit(f) * w for f, w in weights), F.lit(0))


def lexical_priority(weights=(("title", 4), ("content", 4), ("filename", 2), ("path", 1))) -> Column:
    total = sum((F.when(phrase_hit(f) > 0, w).otherwise(0) for f, w in weights), F.lit(0))
    return total + F.when(F.col("leg").isin("keyword", "hybrid"), 3).otherwise(0) + F.when(F.col("match_type").isin("fulltext", "title", "filename"), 2).otherwise(0)


def doc_hits(hits: DataFrame, k: int = 3) -> DataFrame:
    """Documents by the sum of their three best hits: (query_id, doc_id, score, hits)."""
    return sum_of_best(hits, ["query_id", "doc_id"], "score", "item_id", k)


def two_hop(hits: DataFrame, documents: int, evidence: int) -> DataFrame:
    """Evidence of the best documents only: the first hop ranks documents, the second their best items."""
    d = doc_hits(hits)
    d = d.withColumn("doc_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("doc_rank") <= documents)
    df = hits.join(d.select("query_id", "doc_id", "doc_rank"), ["query_id", "doc_id"])
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "item_id"))).where(F.col("rank") <= evidence)


def search_filters(hits: DataFrame, docs: DataFrame, *, sources: Sequence[str] = (), doc_types: Sequence[str] = (), since=None, until=None) -> DataFrame:
    """Hits of documents that pass the filters; a date is the publishing date, else the effective date."""
    allowed = docs
    if sources:
        allowed = allowed.where(F.col("source").isin(*sources))
    if doc_types:
        allowed = allowed.where(F.col("doc_type").isin(*doc_types))
    if since is not None or until is not None:
        day = F.coalesce("publish_date", "effective_date")
        allowed = allowed.where((day >= F.lit(since)) if until is None else (day <= F.lit(until)) if since is None else day.between(F.lit(since), F.lit(until)))
    return hits.join(allowed.select("doc_id"), "doc_id", "left_semi")


#: Weights of term classes.
CLASS_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def weighted_terms(fields: Sequence[tuple[str, str]]) -> Column:
    """Array of (term, weight, pos): the terms of fields in order, each with its field's class."""
    def part(words: Column, kind: str, at: Column) -> Column:
        return F.transform(words, lambda w, i: F.struct(w.alias("term"), F.lit(CLASS_WEIGHTS[kind]).alias("weight"), (at + i).alias("pos")))

    parts, at = [], F.lit(0)
    for name, kind in fields:
        words = F.filter(F.split(F.lower(T.text(name)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        parts.append(part(words, kind, at))
        at = at + F.size(words)
    return F.concat(*parts)


def weighted_postings(items: DataFrame, id_col: str, fields: Sequence[tuple[str, str]], terms: DataFrame) -> DataFrame:
    """(id, term, weight, pos) of the words that are among ``terms`` (term); places count on from field to field."""
    words = [F.regexp_extract_all(F.lower(T.text(name)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)) for name, _ in fields]
    wanted, found, at = small(terms.select("term").distinct()), None, F.lit(0)
    for own, (_, kind) in zip(words, fields):
        part = items.select(F.col(id_col), at.alias("at"), F.posexplode(own).alias("pos", "term")).join(wanted, "term", "left_semi")
        part = part.select(id_col, "term", F.lit(CLASS_WEIGHTS[kind]).alias("weight"), (F.col("at") + F.col("pos")).alias("pos"))
        found, at = part if found is None else found.unionByName(part), at + F.size(own)
    return found


def fts_rank(postings: DataFrame, query_terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, covers, rank) of items that hold all terms of a query: the sum over covers of their weight by their density.

    A cover is a stretch from one place of a term to another that holds all terms while no shorter stretch inside does. It
    counts the harmonic mean of the weights of its matched places, divided by 1 plus the number of other words in it.

    A sweep over the places of an item and query in order: at each place the last place of every term so far is known, and a
    cover ends where the earliest of them has moved on. postings(id, term, weight, pos), query_terms(query_id, term).
    """
    by_query = Window.partitionBy("query_id")
    terms = query_terms.select("query_id", "term").distinct()
    terms = terms.withColumn("no", F.row_number().over(by_query.orderBy("term")) - 1).withColumn("k", F.count("*").over(by_query))
    most = terms.agg(F.max("k")).first()[0] or 1
    along = Window.partitionBy("query_id", id_col).orderBy("pos")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    df = postings.join(small(terms), "term").withColumn("n", F.row_number().over(along)).withColumn("sum", F.sum(1 / F.col("weight")).over(so_far))
    here = F.struct("pos", "n", (F.col("sum") - 1 / F.col("weight")).alias("before"))
    last = F.array_compact(F.array(*(F.max(F.when(F.col("no") == i, here)).over(so_far) for i in range(most))))
    df = df.withColumn("last", last).where(F.size("last") == F.col("k")).withColumn("begin", F.array_min("last"))
    df = df.withColumn("passed", F.lag("begin.pos").over(along)).where(F.col("passed").isNull() | (F.col("begin.pos") > F.col("passed")))
    n = F.col("n") - F.col("begin.n") + 1
    noise = F.col("pos") - F.col("begin.pos") - n + 1
    df = df.select("query_id", id_col, (n / (F.col("sum") - F.col("begin.before")) / (1 + noise)).alias("cover"))
    return df.groupBy("query_id", id_col).agg(F.count("*").alias("covers"), F.round(F.sum("cover"), 6).alias("rank"))


def noise_penalty(title: str = "title", filename: str = "filename", content: str = "content", doc_type: str = "doc_type", *, title_cues=L.DEV_TITLE_CUES, text_cues=L.DEV_TEXT_CUES, w=L.NOISE, bonus=L.DOC_TYPE_BONUS) -> Column:
    t, n, c = F.lower(T.text(title)), F.lower(T.text(filename)), F.lower(F.substring(T.text(content), 1, 1200))
    count = lambda mark: F.size(F.split(c, mark)) - 1
    total = F.when(T.any_of(t, title_cues), w["dev_title"]).otherwise(0.0) + F.when(T.any_of(n, title_cues), w["dev_title"]).otherwise(0.0)
    total = total + F.least(F.lit(w["dev_text_max"]), T.count_of(c, text_cues) * w["dev_text"])
    total = total + F.when(count("```") >= 2, w["code"]).otherwise(0.0) + F.when(count(r"\|") >= 8, w["table"]).otherwise(0.0) + F.when(c.rlike("https?://|http "), w["link"]).otherwise(0.0)
    for name, value in bonus.items():
        total = total - F.when(F.col(doc_type) == name, value).otherwise(0.0)
    return F.round(F.least(F.lit(w["most"]), F.greatest(F.lit(w["least"]), total)), 6)


def overlap_adjustment(query: str = "query", title: str = "title", filename: str = "filename", content: str = "content", w=L.BOOST) -> Column:
    hay = F.concat_ws(" ", F.lower(T.text(title)), F.lower(T.text(filename)), F.lower(F.substring(T.text(content), 1, 1200)))
    terms = T.query_terms(query)
    hits = F.size(F.filter(terms, lambda x: hay.contains(x)))
    miss = F.when(F.exists(terms, lambda x: x.rlike("[a-z]")), -w["ascii_miss"]).otherwise(-w["other_miss"])
    return F.round(F.when(F.size(terms) == 0, 0.0).when(hits == 0, miss).otherwise(F.least(hits * w["hit"], F.lit(w["hit_max"]))), 6)


def phrase_adjustment(query: str = "query", title: str = "title", filename: str = "filename", preview: str = "preview", content: str = "content", w=L.BOOST) -> Column:
    q = F.lower(F.trim(T.text(query)))
    t, c, f, p = F.lower(T.text(title)), F.lower(F.substring(T.text(content), 1, 4000)), F.lower(T.text(filename)), F.lower(T.text(preview))
    add = lambda yes, value: F.when(yes, value).otherwise(0.0)
    total = add(c.contains(q), w["phrase"]) + add(t.contains(q), w["title"]) + add(f.contains(q), w["filename"]) + add(p.contains(q), w["summary"])
    total = total + add(T.any_of(t, L.SUMMARY_CUES) & (t.contains(q) | c.contains(q)), w["summary"]) + add(T.any_of(t, L.CAPTION_CUES) & t.contains(q), w["caption"])
    return F.round(F.when(q == "", 0.0).otherwise(total), 6)


def exact_boost(query: str = "query", content: str = "content", boost: float = L.BOOST["phrase"]) -> Column:
    q, c = F.lower(F.trim(T.text(query))), F.lower(T.text(content))
    return F.when((q == "") | (c == ""), 0.0).when(q == F.trim(c), boost * 1.5).when(c.contains(q), boost * 0.8).otherwise(0.0)


def match_type(query: str = "query", title: str = "title", filename: str = "filename", preview: str = "preview", content: str = "content") -> Column:
    q = F.lower(F.trim(T.text(query)))
    t, f, p, c = F.lower(T.text(title)), F.lower(T.text(filename)), F.lower(T.text(preview)), F.lower(F.substring(T.text(content), 1, 4000))
    return F.when(q == "", "content").when(t.contains(q) & T.any_of(t, L.CAPTION_CUES), "caption").when(t.contains(q), "title").when(f.contains(q), "filename").when(p.contains(q), "summary").when(c.contains(q), "content").otherwise("semantic")


def weighted_hybrid(keyword: DataFrame, vector: DataFrame, adjustment: Column | None = None, *, w_keyword: float, w_vector: float, boost: float, compat: bool = False) -> DataFrame:
    """Units (.7, .8, .4) or chunks (.65, .85, .45): weights of both legs, a boost if both hit, the adjustment once (twice
    with ``compat`` when both legs hit)."""
    adjustment = F.lit(0.0) if adjustment is None else adjustment
    best = lambda df, name: df.groupBy("query_id", "item_id").agg(F.max("score").alias(name))
    df = best(keyword, "k").join(best(vector, "v"), ["query_id", "item_id"], "full_outer")
    both = F.col("k").isNotNull() & F.col("v").isNotNull()
    score = F.coalesce("k", F.lit(0.0)) * w_keyword + F.coalesce("v", F.lit(0.0)) * w_vector + F.when(both, boost).otherwise(0.0) + adjustment
    return df.select("query_id", "item_id", F.round((score + F.when(both, adjustment).otherwise(0.0) if compat else score) + 1e-9, 6).alias("score"), both.alias("both"))


def unified_search(queries: DataFrame, units: DataFrame, chunks: DataFrame, size: int, number: int = 1) -> DataFrame:
    """A page of units and chunks for each query: (query_id, kind, doc_id, chunk_no, score, place).

    queries(query_id, query); both: (query_id, doc_id, chunk_no, score, match_type, title, span). A chunk of which a unit is
    found stays out, unless the query is an exact one. Of hits of one document, match type, title and span the best counts
    (of equal ones the unit, then the first), where the span says nothing of matches by title, filename, summary or caption.
    Equal scores: units first, chunks first for exact queries. Each document gives three hits, two for exact queries, before
    what it has more of.
    """
    from .relational import diversify

    exact = queries.select("query_id", T.is_exactish("query").alias("exact"))
    place = ["query_id", "doc_id", "chunk_no"]
    named = lambda df, kind: df.select(*place, "score", "match_type", "title", "span", F.lit(kind).alias("kind")).join(exact, "query_id")
    kept = named(chunks, "chunk").join(units.select(*place).distinct().withColumn("unit", F.lit(True)), place, "left").where("exact or unit is null").drop("unit")
    hits = named(units, "unit").unionByName(kept)
    clean = lambda c: F.lower(F.trim(T.text(c)))
    by_name = F.col("match_type").isin("title", "filename", "summary", "caption")
    key = ["query_id", "doc_id", F.coalesce("match_type", F.lit("content")), clean("title"), F.when(by_name, "").otherwise(clean("span"))]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("kind"), "chunk_no"))
    hits = hits.withColumn("first", first).where("first = 1")
    ahead = F.when((F.col("kind") == "chunk") == F.col("exact"), 0).otherwise(1)
    hits = hits.withColumn("tie", F.struct(ahead.alias("ahead"), "doc_id", "chunk_no"))
    hits = diversify(hits.where("exact"), 2, tie="tie").unionByName(diversify(hits.where("not exact"), 3, tie="tie"))
    return hits.where(F.col("place").between((number - 1) * size + 1, number * size)).select(*place, "kind", "score", "place")


def search_for_qa(units: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best units and chunks of a question, without chunks that one of its units stands for.

    Both: (query_id, doc_id, chunk_no, score); ties: units first, then by place.
    """
    alone = chunks.join(units.select("query_id", "doc_id", "chunk_no"), ["query_id", "doc_id", "chunk_no"], "left_anti")
    hits = units.withColumn("kind", F.lit("unit")).unionByName(alone.withColumn("kind", F.lit("chunk"))).groupBy("query_id", "kind", "doc_id", "chunk_no").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("kind"), "doc_id", "chunk_no"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def citations(hits: DataFrame, k: int = 3) -> DataFrame:
    """The first k hits of each query as an array of (rank, item_id, score)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("citations"))


def answer_rows(queries: DataFrame, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Extractive answers: the best hit's text, three points, confidence .2 without hits, else .45 + .12 a hit up to .95.

    hits(query_id, item_id, score), texts(item_id, content). Every query has a row.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    top = hits.withColumn("rank", rank).withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).where("rank <= 3").join(texts, "item_id", "left")
    rows = F.array_sort(F.collect_list(F.struct("rank", F.substring(T.collapse_space("content"), 1, 160).alias("t"))))
    got = top.groupBy("query_id").agg(F.max("n").alias("n"), F.transform(rows, lambda x: x["t"]).alias("points"))
    df = queries.select("query_id", T.query_type("query").alias("query_type")).join(got, "query_id", "left")
    sure = F.when(F.coalesce("n", F.lit(0)) == 0, 0.2).otherwise(F.least(F.lit(0.95), 0.45 + 0.12 * F.col("n")))
    return df.select("query_id", "query_type", F.coalesce("n", F.lit(0)).alias("hits"), F.get("points", F.lit(0)).alias("answer"), "points", F.round(sure, 6).alias("confidence"))
