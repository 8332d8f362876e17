"""The registered queries of this subpackage, with production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf_langid, hard_negatives, license_scan, piece_codec, pivot_search, simhash_dedup, source_divergence, source_mix, subword_quality, tiff_media, token_counts, url_filter, winnow_decontam
from ._common import crc_mod, table

TOKENIZERS = "/opt/tokenizers"
#: Split pattern of the byte-level vocabulary (public).
BYTE_BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
QUALITY_CUT = 0.3


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(license_scan.document_files(table(spark, sf_dir, "documents")))


def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return pivot_search.top_k(rows, rows.where("vec_id % 100 = 0"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules=url_filter.RULES).drop("url")


def op4_piece_codec(spark: SparkSession, sf_dir: str, model: str = os.path.join(TOKENIZERS, "piece_bpe_32k.model")) -> DataFrame:
    pieces = piece_codec.load_model(model)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = piece_codec.round_trip(docs, pieces)
    back = F.coalesce("decoded", F.lit("")) == F.coalesce("text", F.lit(""))
    return done.select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", F.sha2("decoded", 256).alias("decoded_sha256"), back.alias("round_trip"))


def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff_media.texts_as_tiff(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stored = stored.withColumns({"media_bytes": F.length("content").cast("long"), "media_sha256": F.sha2("content", 256)})
    pages = tiff_media.page_features(tiff_media.tiff_pages(stored))
    tail = F.crc32(F.expr("substring(pixels, -64, 64)"))
    return pages.select("doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op6_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf_langid.fit_language(docs.where(crc_mod("doc_id", 4) != 2))
    found = crf_langid.identify_language(docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str, ranks: str = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")) -> DataFrame:
    with open(ranks, "rb") as file:
        return token_counts.count_tokens(table(spark, sf_dir, "documents"), file.read(), BYTE_BPE_PATTERN)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op9_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = subword_quality.fit_quality(docs, labels.where(crc_mod("doc_id", 5) != 0))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    found = subword_quality.score_quality(docs.select("doc_id", "text", held.alias("held_out")), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op13_winnow_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow_decontam.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_pivot_search, op3_url_filter, op4_piece_codec, op5_tiff_media, op6_crf_langid, op7_token_counts, op8_source_mix, op9_subword_quality, op10_simhash_dedup, op11_hard_negatives, op12_source_divergence, op13_winnow_decontam, pipeline)}

OP2_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.row <> q.row AND len(x.v) = len(q.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row, a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v x ON a.vec_id % 100 = 0 AND x.row <> a.row AND len(x.v) = len(a.v)),
p AS (SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.row, p.place ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON p.row = s.row AND NOT s.same AND p.place <= 5 AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*) AS V FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, V FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * V) AS p FROM f),
a AS (SELECT lang, term, sum(n)::HUGEINT AS n, any_value(V) AS V FROM f GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 5 * V) AS q FROM a),
two AS (SELECT x.lang, x.source, y.source AS item, coalesce(sum(abs(px.p - py.p)), 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN p px ON px.lang = x.lang AND px.source = x.source LEFT JOIN p py ON py.lang = y.lang AND py.source = y.source AND py.term = px.term GROUP BY x.lang, x.source, y.source),
one AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM two
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM one)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""

OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, list_slice(w, pos, pos + size - 1) AS words
  FROM (SELECT *, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM i WHERE len(w) > 0)),
dw AS (SELECT row, pos, size, list_slice(w, pos, pos + size - 1) AS words
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
h AS (SELECT row, pos, size, item_id FROM dw JOIN iw USING (size, words)),
n AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(pos, pos + size)) AS place FROM h) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN t USING (row)
"""

SQL = {
    "op1_license_scan": license_scan.oracle(),
    "op2_pivot_search": OP2_SQL,
    "op3_url_filter": url_filter.oracle(),
    "op8_source_mix": source_mix.ORACLE,
    "op11_hard_negatives": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_winnow_decontam": OP13_SQL,
}
