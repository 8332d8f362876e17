"""Registered queries: inventory, documents, chunks, units and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import chunks as C
from ..operators import documents as D
from ..operators import relational as R
from ..operators import units as U
from ..sources import inventory as I
from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Register a function under its name; ``sql`` follows the views it names."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {views.strip()} " if views else "") + sql
        return f

    return add


#: Cue words that occur in the given tables, whose texts hold none of the default lists' words.
STEM_CUES = (("rule", ("doc_1", "doc_4")), ("speech", ("doc_2",)), ("report", ("doc_3",)))
PREVIEW_CUES = (("rule", ("then", "pour")), ("speech", ("with", "que ")), ("report", ("ing", "und")))
DEV_TEXT = ("the ", "le ", "que", "ing ")
TERMS = {"paper": ("then", "with", "pour"), "regulation": ("ing", "und"), "project_plan": ("the", "que"), "speech": ("and", "les"), "report": ("of", "des"), "technical_spec": ("ion", "ment"), "table": ("|", "0", "1")}
CONCLUSION_CUES = ("then", "pour", "der")


def _hits(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _count(c: str, words) -> str:
    return "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"


def _first(c: str, cues, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_hits(c, w)} THEN '{n}'" for n, w in cues) + f" ELSE '{default}' END"


TIGHT = "regexp_replace(lower({}), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g')"
TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SPACE = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')"

# Inventory -----------------------------------------------------------------------------------------------------------


def _files(spark, d):
    return V.docs(spark, d).select("doc_id", "source", "path", "file_hash", "size", F.lit(None).cast("timestamp").alias("modified"))


def _next_files(spark, d):
    f = _files(spark, d)
    kept = f.where("doc_id % 17 != 0").withColumn("size", F.when(F.col("doc_id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("file_hash", F.when(F.col("doc_id") % 13 == 0, F.sha2("file_hash", 256)).otherwise(F.col("file_hash")))
    return kept.unionByName(f.where("doc_id % 19 = 0").withColumn("path", F.concat("path", F.lit(".new"))))


NEXT = V.DOCS + """,
nxt AS (SELECT source, path, CASE WHEN doc_id % 13 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 13 = 0 THEN sha256(file_hash) ELSE file_hash END AS file_hash FROM docs WHERE doc_id % 17 <> 0 UNION ALL SELECT source, path || '.new', size, file_hash FROM docs WHERE doc_id % 19 = 0),
diff AS (SELECT coalesce(n.source, o.source) AS source, coalesce(n.path, o.path) AS path, o.file_hash AS old_hash, n.file_hash, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'missing' WHEN o.size <> n.size AND o.file_hash <> n.file_hash THEN 'changed' ELSE 'unchanged' END AS change_type FROM nxt n FULL JOIN docs o ON n.source = o.source AND n.path = o.path)"""  # fmt: skip


@query("SELECT doc_id, file_hash FROM docs", V.DOCS)
def content_hash(spark, d):
    return V.table(spark, d, "documents").select("doc_id", I.content_hash("text").alias("file_hash"))


@query("SELECT * FROM diff", NEXT)
def inventory_diff(spark, d):
    return I.inventory_diff(_files(spark, d), _next_files(spark, d))


@query("SELECT source, " + ", ".join(f"count(*) FILTER (WHERE change_type = '{k}') AS n_{k}" for k in ("new", "changed", "unchanged", "missing")) + " FROM diff GROUP BY source", NEXT)
def scan_summary(spark, d):
    return I.scan_summary(I.inventory_diff(_files(spark, d), _next_files(spark, d)))


@query("""SELECT doc_id, reason, probe_status, CASE WHEN probe_status = 'success' THEN 'pending' ELSE 'skipped' END AS parse_status FROM (SELECT *, CASE WHEN reason = 'TEMP_FILE' THEN 'ignored' WHEN reason IS NOT NULL THEN 'failed' ELSE 'success' END AS probe_status FROM (SELECT doc_id, CASE WHEN starts_with(name, '~$') THEN 'TEMP_FILE' WHEN ext NOT IN ('xlsx', 'txt') THEN 'UNSUPPORTED_EXTENSION' WHEN size <= 0 THEN 'EMPTY_FILE' WHEN ext = 'xlsx' AND NOT starts_with(header, '504B0304') THEN 'BAD_SIGNATURE' END AS reason FROM (SELECT *, CASE WHEN doc_id % 23 = 0 THEN '~$' || filename ELSE filename END AS name, CASE WHEN doc_id % 14 = 0 THEN '504B030414000600' ELSE upper(hex(encode(substr(text, 1, 4)))) END AS header FROM docs)))""", V.DOCS)
def probe_files(spark, d):
    df = V.docs(spark, d).withColumn("name", F.when(F.col("doc_id") % 23 == 0, F.concat(F.lit("~$"), F.col("filename"))).otherwise(F.col("filename")))
    df = df.withColumn("header", F.when(F.col("doc_id") % 14 == 0, "504B030414000600").otherwise(F.hex(F.substring("text", 1, 4))))
    return I.probe_files(df.withColumn("ext0", I.extension("name"))).select("doc_id", "reason", "probe_status", "parse_status")


@query("SELECT doc_id, CASE WHEN doc_id % 23 = 0 AND status = 'failed' THEN 'ignored' ELSE status END AS status FROM docs", V.DOCS)
def cleanup_temp_failures(spark, d):
    df = V.docs(spark, d).select("doc_id", "status", F.lit("x").alias("error"), F.when(F.col("doc_id") % 23 == 0, "~$a.docx").otherwise("a.docx").alias("name"))
    return I.cleanup_temp_failures(df).select("doc_id", "status")


@query("SELECT source, path, 'pending' AS status, 'parse' AS from_stage FROM diff WHERE change_type IN ('new', 'changed')", NEXT)
def select_for_ingest(spark, d):
    diff = I.inventory_diff(_files(spark, d), _next_files(spark, d)).withColumn("status", F.lit("success"))
    return I.select_for_ingest(diff, "incremental").select("source", "path", "status", "from_stage")


PAGE_TEXT = "html"
for _p, _r in ((r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), (r"(?s)<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"\s+", " ")):
    PAGE_TEXT = f"regexp_replace({PAGE_TEXT}, '{_p}', '{_r}', 'g')"


@query(f"SELECT page_id, trim({PAGE_TEXT}, ' ') AS text FROM pages")
def read_pages(spark, d):
    return I.read_pages(V.table(spark, d, "pages").select("page_id", "html")).select("page_id", "text")


@query("SELECT doc_id, file_hash FROM docs WHERE doc_id % 13 <> 0 UNION ALL SELECT doc_id, 'fresh' FROM docs WHERE doc_id % 13 = 0", V.DOCS)
def upsert_by_key(spark, d):
    df = V.docs(spark, d).select("doc_id", "file_hash")
    return I.upsert_by_key(df, df.where("doc_id % 13 = 0").withColumn("file_hash", F.lit("fresh")), ["doc_id"])


@query("SELECT doc_id, chunk_no, content FROM chunks WHERE doc_id % 13 <> 0 UNION ALL SELECT doc_id, 0, title FROM docs WHERE doc_id % 13 = 0", V.CHUNKS)
def replace_children(spark, d):
    fresh = V.docs(spark, d).where("doc_id % 13 = 0").select("doc_id", F.lit(0).alias("chunk_no"), F.col("title").alias("content"))
    return I.replace_children(V.chunks(spark, d).select("doc_id", "chunk_no", "content"), fresh)


@query("SELECT 'chunks' AS child, count(*) AS removed FROM chunks JOIN docs USING (doc_id) WHERE source = 'src0' UNION ALL SELECT 'units', count(*) FROM units JOIN docs USING (doc_id) WHERE source = 'src0'", V.UNITS)
def reset_index(spark, d):
    return I.reset_index(V.docs(spark, d), {"chunks": V.chunks(spark, d), "units": V.units(spark, d)}, "src0")[2]


# Documents -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CASE WHEN ext = 'xlsx' THEN 'excel' ELSE coalesce(nullif({_first('stem', STEM_CUES, '')}, ''), {_first('substr(text, 1, 4000)', PREVIEW_CUES, 'unknown')}) END AS doc_type FROM docs", V.DOCS)
def classify_doc_type(spark, d):
    return D.classify_doc_type(V.docs(spark, d).withColumn("preview", F.substring("text", 1, 4000)), stem_cues=STEM_CUES, preview_cues=PREVIEW_CUES).select("doc_id", "doc_type")


@query(f"SELECT doc_id, is_dev, CASE WHEN is_dev THEN 'development' ELSE 'business' END AS domain FROM (SELECT doc_id, ext = 'sql' OR {_count('lower(filename)', L.DEV_TITLE_CUES)} >= 1 OR {_count('lower(substr(text, 1, 4000))', DEV_TEXT)} >= 2 AS is_dev FROM docs)", V.DOCS)
def detect_dev_domain(spark, d):
    return D.detect_dev_domain(V.docs(spark, d).withColumn("preview", F.substring("text", 1, 4000)), text_cues=DEV_TEXT).select("doc_id", "is_dev", "domain")


_PROFILE = V.UNITS + f""",
c0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks),
c1 AS (SELECT doc_id, max(n) AS chunk_count, count(*) AS sampled, count(*) FILTER (WHERE contains(chunk_type, 'table')) AS tables, count(*) FILTER (WHERE contains(chunk_type, 'list')) AS lists, count(DISTINCT CASE WHEN trim(title, ' ') <> '' THEN trim(title, ' ') END) AS headings, sum(length(content)) AS chars, sum(length(regexp_replace(content, '[^0-9]', '', 'g'))) AS digits, string_agg(title || ' ' || substr(content, 1, 800), ' ' ORDER BY chunk_no) AS ct FROM c0 WHERE k <= 240 GROUP BY doc_id),
u0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM units),
u1 AS (SELECT doc_id, max(n) AS unit_count, string_agg(subject || ' ' || indicator || ' ' || content, ' ' ORDER BY unit_no) AS ut FROM u0 WHERE k <= 160 GROUP BY doc_id),
p0 AS (SELECT d.doc_id, d.filename, d.doc_type, coalesce(chunk_count, 0) AS chunk_count, coalesce(sampled, 0) AS sampled, coalesce(lists, 0) AS lists, coalesce(tables, 0) AS tables, coalesce(unit_count, 0) AS unit_count, round(coalesce(tables, 0) / greatest(1, coalesce(sampled, 0)), 4) AS table_ratio, round(coalesce(headings, 0) / greatest(1, coalesce(sampled, 0)), 4) AS heading_ratio, CASE WHEN chars > 0 THEN round(digits / chars, 4) ELSE 0 END AS digit_density, floor(coalesce(chars, 0) / greatest(1, coalesce(sampled, 0))) AS mean_chars, regexp_replace(lower(concat_ws(' ', d.title, d.filename, ct, ut)), '\\s+', '', 'g') AS hay FROM docs d LEFT JOIN c1 USING (doc_id) LEFT JOIN u1 USING (doc_id)),
p1 AS (SELECT *, {", ".join(f"{_count('hay', w)}" + (" + CASE WHEN doc_type = 'excel' OR regexp_matches(lower(filename), '\\.xlsx?$') THEN 5 ELSE 0 END + CASE WHEN table_ratio >= 0.35 THEN 4 WHEN table_ratio >= 0.18 THEN 2 ELSE 0 END + CASE WHEN digit_density >= 0.18 THEN 2 WHEN digit_density >= 0.08 THEN 1 ELSE 0 END" if k == "table" else " + CASE WHEN chunk_count >= 20 AND heading_ratio >= 0.18 THEN 1 ELSE 0 END" if k == "report" else "") + f" AS s_{k}" for k, w in TERMS.items())} FROM p0),
p2 AS (SELECT *, list_reverse_sort([{", ".join(f"s_{k} * 10 + {9 - i}" for i, k in enumerate(TERMS))}]) AS r FROM p1),
p3 AS (SELECT *, r[1] // 10 AS top, r[2] // 10 AS second, [{", ".join(f"'{k}'" for k in TERMS)}][10 - r[1] % 10] AS best FROM p2),
p4 AS (SELECT *, CASE WHEN top < 2 THEN 'unknown' ELSE best END AS profile_type FROM p3),
p5 AS (SELECT *, CASE WHEN profile_type = 'table' OR table_ratio >= 0.35 THEN 'table_heavy' WHEN heading_ratio >= 0.18 OR lists >= 4 THEN 'sectioned' WHEN mean_chars >= 180 AND sampled - tables - lists >= lists THEN 'narrative' ELSE 'mixed' END AS structure_type, CASE WHEN chunk_count >= 30 OR unit_count >= 12 OR top >= 8 OR (table_ratio >= 0.25 AND digit_density >= 0.08) THEN 'high' WHEN chunk_count >= 8 OR unit_count >= 4 OR top >= 4 THEN 'medium' ELSE 'low' END AS knowledge_density FROM p4),
p6 AS (SELECT *, CASE WHEN knowledge_density = 'low' AND (profile_type = 'unknown' OR structure_type = 'narrative') THEN 'evidence_only' WHEN profile_type = 'speech' THEN 'weak' WHEN profile_type IN ('project_plan', 'regulation', 'paper', 'technical_spec') AND knowledge_density <> 'low' THEN 'strong' WHEN profile_type IN ('table', 'report') OR top >= 4 THEN 'moderate' ELSE 'weak' END AS graph_suitability FROM p5)"""  # fmt: skip


def _profile(spark, d):
    return D.document_profile(V.docs(spark, d), V.chunks(spark, d), V.units(spark, d), terms=TERMS)


@query(f"SELECT doc_id, {', '.join(f's_{k}' for k in TERMS)} FROM p1", _PROFILE)
def doc_type_scores(spark, d):
    return _profile(spark, d).select("doc_id", *(f"s_{k}" for k in TERMS))


@query("SELECT doc_id, profile_type, structure_type, knowledge_density, graph_suitability, CASE WHEN graph_suitability = 'evidence_only' THEN 'evidence_only' ELSE CASE profile_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.STRATEGIES.items()) + " ELSE 'default_extraction' END END AS strategy, round(least(0.94, greatest(0.30, 0.42 + least(0.28, top / 24) + least(0.16, greatest(0, top - second) / 16) + CASE WHEN chunk_count >= 8 THEN 0.04 ELSE 0 END + CASE WHEN unit_count >= 4 THEN 0.04 ELSE 0 END + CASE WHEN table_ratio >= 0.35 OR heading_ratio >= 0.18 THEN 0.04 ELSE 0 END)), 3)::DOUBLE AS confidence FROM p6", _PROFILE)
def document_profile(spark, d):
    return _profile(spark, d).select("doc_id", "profile_type", "structure_type", "knowledge_density", "graph_suitability", "strategy", F.round("confidence", 3).alias("confidence"))


FAMILIES = (("policy", ("the ", "le ")), ("speech", ("and ", "les ")), ("report", ("of ", "der ")), ("project", ("in ", "un ")))


@query(f"SELECT doc_id, CASE WHEN doc_type = 'rule' THEN 'regulation' WHEN doc_type = 'report' THEN 'report' ELSE {_first('lower(title || chr(32) || filename)', FAMILIES, 'default')} END AS route FROM docs", V.DOCS)
def extraction_profile(spark, d):
    df = V.docs(spark, d).withColumn("strategy", F.when(F.col("doc_type") == "rule", "regulation_extraction").when(F.col("doc_type") == "report", "report_extraction").when(F.col("doc_type") == "excel", "default_extraction"))
    return D.extraction_profile(df, FAMILIES).select("doc_id", "route")


@query("SELECT DISTINCT doc_id FROM docs WHERE status = 'success' AND doc_id % 3 <> 0 AND doc_id IN (SELECT doc_id FROM chunks)", V.CHUNKS)
def missing_profiles(spark, d):
    df = V.docs(spark, d)
    return D.missing_profiles(df, V.chunks(spark, d), df.where("doc_id % 3 = 0"))


@query("SELECT count(*) AS eligible, count(*) FILTER (WHERE doc_id % 3 = 0) AS profiled, count(*) FILTER (WHERE doc_id % 3 <> 0) AS missing FROM docs WHERE status = 'success' AND doc_id IN (SELECT doc_id FROM chunks)", V.CHUNKS)
def profile_stats(spark, d):
    df = V.docs(spark, d)
    return D.profile_stats(df, V.chunks(spark, d), df.where("doc_id % 3 = 0"))


@query("SELECT doc_id, substr(string_agg(content, chr(10) || chr(10) ORDER BY chunk_no), 1, 2000) AS preview FROM chunks GROUP BY doc_id", V.CHUNKS)
def preview_text(spark, d):
    return D.preview_text(V.chunks(spark, d))


@query("""SELECT doc_id, rank::INT AS rank, keyword, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM (SELECT doc_id, keyword, count(*) AS n, min(pos) AS first FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS keyword FROM (SELECT doc_id, regexp_split_to_array(text, '[\\s\\p{P}\\p{S}]+') AS w FROM docs)) WHERE length(keyword) BETWEEN 2 AND 14 GROUP BY ALL)) WHERE rank <= 12""", V.DOCS)
def top_keywords(spark, d):
    return D.top_keywords(V.docs(spark, d))


@query("SELECT doc_id, len(list_distinct(e)) AS n FROM (SELECT doc_id, regexp_extract_all(text, '([A-Z][a-z]+tion)[ ,.]', 1) AS e FROM docs)", V.DOCS)
def detect_entities(spark, d):
    return V.docs(spark, d).select("doc_id", F.size(D.first_matches(F.col("text"), r"([A-Z][a-z]+tion)[ ,.]", 10_000)).cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN list_min(y) = list_max(y) THEN list_min(y) ELSE list_min(y) || '-' || list_max(y) END AS time_range FROM (SELECT doc_id, regexp_extract_all(text, '((?:19|20)\\d{2})', 1) AS y FROM docs)", V.DOCS)
def detect_time_range(spark, d):
    return V.docs(spark, d).select("doc_id", D.time_range(F.col("text")).alias("time_range"))


@query(f"SELECT doc_id, rank::INT AS rank, conclusion FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no, conclusion) AS rank FROM (SELECT doc_id, substr({SPACE.format('content')}, 1, 120) AS conclusion, min(chunk_no) AS chunk_no FROM chunks WHERE {_hits('content', CONCLUSION_CUES)} GROUP BY ALL)) WHERE rank <= 6", V.CHUNKS)
def detect_conclusions(spark, d):
    return D.detect_conclusions(V.chunks(spark, d), CONCLUSION_CUES)


@query(f"SELECT doc_id, substr(string_agg(part, ' ' ORDER BY g), 1, 360) AS summary FROM (SELECT doc_id, g, substr(string_agg(part, ' ' ORDER BY pos), 1, 220) AS part FROM (SELECT doc_id, pos, pos // 8 AS g, part FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS pos, substr({SPACE.format('content')}, 1, 120) AS part FROM chunks)) WHERE g < 4 GROUP BY ALL) GROUP BY doc_id", V.CHUNKS)
def mapreduce_summary(spark, d):
    return D.mapreduce_summary(V.chunks(spark, d))


@query(f"""SELECT d.doc_id, coalesce(summary, '') AS summary, coalesce(sections, '') AS sections, coalesce(keywords, '') AS keywords, entities, time_range, coalesce(conclusions, '') AS conclusions FROM documents d LEFT JOIN ({SQL['mapreduce_summary']}) USING (doc_id) LEFT JOIN ({SQL['detect_time_range']}) USING (doc_id)
  LEFT JOIN (SELECT doc_id, array_to_string(list(keyword ORDER BY rank), '|') AS keywords FROM ({SQL['top_keywords']}) GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, array_to_string(list(conclusion ORDER BY rank), '|') AS conclusions FROM ({SQL['detect_conclusions']}) GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, array_to_string(list(s ORDER BY k, s)[1:16], '|') AS sections FROM (SELECT doc_id, trim(title, ' ') AS s, min(chunk_no) AS k FROM (WITH {V.CHUNKS.strip()} SELECT * FROM chunks) WHERE trim(title, ' ') <> '' GROUP BY ALL) GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(e) + 1), lambda i: NOT list_contains(e[1:i - 1], e[i])), lambda i: e[i])[1:10], '|') AS entities FROM (SELECT doc_id, regexp_extract_all(text, '([A-Z][a-z]+tion)[ ,.]', 1) AS e FROM documents)) USING (doc_id)""")
def doc_overview(spark, d):
    df = D.document_overview(V.docs(spark, d), V.chunks(spark, d), CONCLUSION_CUES, r"([A-Z][a-z]+tion)[ ,.]")
    listed = [F.coalesce(F.array_join(F.col("overview")[c], "|"), F.lit("")).alias(c) for c in ("sections", "keywords", "entities", "conclusions")]
    return df.select("doc_id", F.coalesce("overview.summary", F.lit("")).alias("summary"), *listed, "overview.time_range")


@query("SELECT doc_id, min(doc_id) OVER w AS canonical_id, count(*) OVER w AS duplicates, doc_id <> min(doc_id) OVER w AS is_duplicate FROM docs WINDOW w AS (PARTITION BY file_hash)", V.DOCS)
def exact_duplicates(spark, d):
    return D.exact_duplicates(V.docs(spark, d)).select("doc_id", "canonical_id", "duplicates", "is_duplicate")


@query()
def possible_duplicates(spark, d):
    return D.possible_duplicates(V.docs(spark, d))


RELATED = V.DOCS + f""",
rb AS MATERIALIZED (SELECT doc_id, file_hash, {TRI.format('title')} AS tt, {TRI.format('preview')} AS tp, list_transform(range(0, 32), lambda d: coalesce(list_sum(list_transform(range(d + 1, len(t) + 1, 32), lambda i: (unicode(t[i]) % 97) / 97.0::DOUBLE)), 0)) AS v FROM (SELECT *, string_split(text, '') AS t FROM docs)),
rs AS (SELECT a.doc_id, b.doc_id AS other_id, round(CASE WHEN a.file_hash = b.file_hash THEN 1.0 ELSE 0.25 * len(list_intersect(a.tt, b.tt)) / greatest(1, len(a.tt) + len(b.tt) - len(list_intersect(a.tt, b.tt))) + 0.15 * len(list_intersect(a.tp, b.tp)) / greatest(1, len(a.tp) + len(b.tp) - len(list_intersect(a.tp, b.tp))) + 0.6 * list_cosine_similarity(a.v, b.v) END + 1e-9, 6)::DOUBLE AS score FROM rb a JOIN rb b ON a.doc_id <> b.doc_id AND (a.doc_id % 100 = 0 OR a.file_hash = b.file_hash))"""


@query("SELECT doc_id, other_id, score, rank::INT AS rank, CASE WHEN score = 1 THEN 'exact' WHEN score >= 0.2 THEN 'possible' ELSE 'nearest' END AS relation FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other_id) AS rank FROM rs) WHERE (score >= 0.2 AND rank <= 5) OR rank = 1", RELATED)
def related_documents(spark, d):
    from ..operators import retrieval as S

    df = V.docs(spark, d)
    return D.related_documents(df, df.select("doc_id", S.hash_embedding("text", most=2**31 - 1).alias("vector")), queries=df.where("doc_id % 100 = 0"))


@query("SELECT d.doc_id, title, filename, source, coalesce(nc, 0) AS n_chunks, coalesce(nu, 0) AS n_units, count(*) OVER (PARTITION BY file_hash) - 1 AS n_copies FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS nc FROM chunks GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS nu FROM units GROUP BY 1) USING (doc_id)", V.UNITS)
def document_detail(spark, d):
    return D.document_detail(V.docs(spark, d), V.chunks(spark, d), V.units(spark, d))


@query("SELECT doc_id, chunk_no, total, row_no::INT AS row_no FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) AS row_no FROM chunks WHERE contains(lower(title), 'the') OR contains(lower(content), 'the')) WHERE row_no BETWEEN 6 AND 10", V.CHUNKS)
def document_chunks(spark, d):
    return D.children_page(V.chunks(spark, d), ["title", "content"], "the", ["chunk_no"], 5, 2).select("doc_id", "chunk_no", "total", "row_no")


@query("SELECT doc_id, chunk_no, total, row_no::INT AS row_no FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) AS row_no FROM units WHERE contains(lower(subject), 'on') OR contains(lower(indicator), 'on') OR contains(lower(normalized), 'on')) WHERE row_no <= 5", V.UNITS)
def document_units(spark, d):
    return D.children_page(V.units(spark, d), ["subject", "indicator", "normalized"], "on", ["chunk_no"], 5).select("doc_id", "chunk_no", "total", "row_no")


# Chunks --------------------------------------------------------------------------------------------------------------


@query()
def chunk_blocks(spark, d):
    return C.chunk_blocks(V.docs(spark, d), sep="\n", joiner="\n")


@query(f"SELECT doc_id, stem AS title, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_no, p AS content FROM (SELECT doc_id, stem, i, {SPACE.format('p')} AS p FROM (SELECT doc_id, stem, unnest(range(len(s))) AS i, unnest(s) AS p FROM (SELECT doc_id, stem, string_split(text, chr(10)) AS s FROM docs))) WHERE p <> '' QUALIFY chunk_no < 40", V.DOCS)
def chunk_paragraphs(spark, d):
    return C.chunk_paragraphs(V.docs(spark, d), 40, sep="\n")


@query("SELECT doc_id, chunk_no, CASE WHEN regexp_matches(content, '!\\[[^\\]]*\\]\\(') THEN 'figure' WHEN contains(array_to_string(string_split(content, chr(10))[1:5], chr(10)), '|') THEN 'table' ELSE 'text' END AS kind FROM chunks", V.CHUNKS)
def chunk_markdown_type(spark, d):
    return V.chunks(spark, d).select("doc_id", "chunk_no", C.markdown_type("content").alias("kind"))


@query("""SELECT doc_id, chunk_no, concat_ws(' / ', t1, CASE WHEN a2 > coalesce(a1, -1) THEN t2 END) AS heading_path FROM (SELECT doc_id, chunk_no, max(CASE WHEN level = 1 THEN chunk_no END) OVER w AS a1, max(CASE WHEN level = 2 THEN chunk_no END) OVER w AS a2, last_value(CASE WHEN level = 1 THEN t END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 2 THEN t END IGNORE NULLS) OVER w AS t2 FROM (SELECT doc_id, chunk_no, CASE WHEN chunk_no % 9 = 0 THEN '# H' || chunk_no WHEN chunk_no % 4 = 0 THEN '## H' || chunk_no END AS t, CASE WHEN chunk_no % 9 = 0 THEN 1 WHEN chunk_no % 4 = 0 THEN 2 ELSE 0 END AS level FROM chunks) WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no ROWS UNBOUNDED PRECEDING))""", V.CHUNKS)
def heading_path(spark, d):
    mark = F.when(F.col("chunk_no") % 9 == 0, "# H").when(F.col("chunk_no") % 4 == 0, "## H").otherwise("plain ")
    rows = V.chunks(spark, d).select("doc_id", "chunk_no", F.concat(mark, F.col("chunk_no")).alias("content"))
    return C.heading_path(rows, levels=2).select("doc_id", "chunk_no", "heading_path")


@query("SELECT doc_id, chunk_no, CASE WHEN regexp_matches(trim(content, ' '), '^\\d+(\\.\\d+){0,5}[\\s、.．]') THEN len(string_split(regexp_extract(trim(content, ' '), '^(\\d+(?:\\.\\d+){0,5})[\\s、.．]', 1), '.')) ELSE 0 END::INT AS level, regexp_matches(trim(content, ' '), '^([-*•·]|\\(?\\d+[\\).、]|[（(][一二三四五六七八九十]+[)）])\\s*\\S') AS is_list FROM chunks", V.CHUNKS)
def heading_level(spark, d):
    return V.chunks(spark, d).select("doc_id", "chunk_no", T.heading_level("content").cast("int").alias("level"), T.is_list_item("content").alias("is_list"))


@query("""SELECT doc_id, chunk_no::INT AS chunk_no, 'table_row' AS chunk_type, 'sheet' AS title, page_no::INT AS page_no, content FROM (SELECT doc_id, row_no AS page_no, content, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) - 1 AS chunk_no FROM (SELECT doc_id, row_no, string_agg(v, ' | ' ORDER BY col_no) AS content FROM (SELECT doc_id, row_no, unnest(range(1, len(s) + 1)) AS col_no, trim(unnest(s), ' ') AS v FROM (SELECT doc_id, chunk_no + 1 AS row_no, string_split(content, ' | ') AS s FROM chunks)) WHERE row_no <= 200 AND col_no <= 24 AND v <> '' GROUP BY ALL)) WHERE chunk_no < 120""", V.CHUNKS)
def table_row_chunks(spark, d):
    cells = V.chunks(spark, d).select("doc_id", F.lit("sheet").alias("sheet"), (F.col("chunk_no") + 1).alias("row"), F.posexplode(F.split("content", r" \| ")).alias("col", "value")).withColumn("col", F.col("col") + 1)
    return C.table_row_chunks(cells)


@query("SELECT doc_id, chunk_no, CASE WHEN trim(content, ' ') = '' THEN 0 ELSE greatest(1, length(content) // 4) END::INT AS tokens FROM chunks", V.CHUNKS)
def estimate_tokens(spark, d):
    return V.chunks(spark, d).select("doc_id", "chunk_no", C.estimate_tokens("content").alias("tokens"))


def _positions(limit: str, head: str, tail: str) -> str:
    """SQL for whether ``pos`` (of ``n``) is sampled."""
    h, t = f"least({limit}, ceil({limit} * {head}))::INT", f"least({limit} - least({limit}, ceil({limit} * {head}))::INT, floor({limit} * {tail}))::INT"
    return f"(n <= {limit} OR pos < {h} OR pos >= n - {t} OR list_contains(list_transform(range(0, {limit} - {h} - {t}), lambda i: ({h} + floor((i + 1) * (n - {h} - {t} + 1) / ({limit} - {h} - {t} + 1) + 0.5) - 1)::INT), pos))"


@query(f"SELECT doc_id, chunk_no FROM (SELECT doc_id, chunk_no, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1)::INT AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks) WHERE {_positions('10', '0.4', '0.2')}", V.CHUNKS)
def sample_chunks(spark, d):
    return C.sample_chunks(V.chunks(spark, d), 10).select("doc_id", "chunk_no")


SCORE = "round(CASE WHEN trim(title, ' ') <> '' THEN 1.2 ELSE 0 END + CASE chunk_type WHEN 'table_row' THEN 1.1 WHEN 'list' THEN 0.8 ELSE 0.4 END + CASE WHEN length(trim(content, ' ')) BETWEEN 60 AND 700 THEN 1.0 WHEN length(trim(content, ' ')) > 700 THEN 0.3 ELSE 0 END, 6)::DOUBLE"


_EVEN = "greatest(1, floor(quota * 0.75)::INT)"


@query(f"SELECT doc_id, chunk_no, quota FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fixed DESC, score DESC, pos) AS rank FROM (SELECT *, {_positions(_EVEN, '(0.25 / 0.75)', '(0.15 / 0.75)')} AS fixed FROM (SELECT doc_id, chunk_no, {SCORE} AS score, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1)::INT AS pos, count(*) OVER (PARTITION BY doc_id) AS n, least(count(*) OVER (PARTITION BY doc_id), 40, greatest(8, ceil(count(*) OVER (PARTITION BY doc_id) * 0.1)))::INT AS quota FROM chunks))) WHERE rank <= quota", V.CHUNKS)
def sample_overview(spark, d):
    return C.sample_overview(V.chunks(spark, d)).select("doc_id", "chunk_no", "quota")


@query("SELECT doc_id, least(n, 60, greatest(8, ceil(n * 0.1)))::INT AS quota FROM (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1)", V.CHUNKS)
def target_limit(spark, d):
    return V.chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", C.target_limit(F.col("n"), 0.1, 8, 60).alias("quota"))


@query(f"SELECT doc_id, chunk_no, {SCORE} AS score FROM chunks", V.CHUNKS)
def score_chunks(spark, d):
    return V.chunks(spark, d).select("doc_id", "chunk_no", C.score_chunk().alias("score"))


TYPE_CUES = {"rule": (("then", "the "), 1.5), "report": (("ing", "und"), 1.2), "speech": (("with", "que"), 1.2)}


@query("SELECT doc_id, chunk_no, round(CASE WHEN chunk_no < 2 THEN 2.5 ELSE 0 END + CASE WHEN trim(c.title, ' ') <> '' THEN 1.5 ELSE 0 END + CASE WHEN chunk_type = 'table_row' THEN 2 ELSE 0 END + CASE WHEN length(trim(content, ' ')) BETWEEN 80 AND 1200 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(content, '\\d') THEN 0.8 ELSE 0 END + CASE WHEN contains(content, '##') THEN 0.5 ELSE 0 END + CASE WHEN contains(content, '|') THEN 0.5 ELSE 0 END" + "".join(f" + CASE WHEN doc_type = '{k}' THEN {_count('content', w)} * {x} ELSE 0 END" for k, (w, x) in TYPE_CUES.items()) + ", 6)::DOUBLE AS score FROM chunks c JOIN docs USING (doc_id)", V.CHUNKS)
def score_chunks_by_type(spark, d):
    return V.chunks(spark, d).join(V.docs(spark, d).select("doc_id", "doc_type"), "doc_id").select("doc_id", "chunk_no", C.score_chunk_by_type(TYPE_CUES).alias("score"))


@query(f"SELECT doc_id, chunk_no, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_no) AS rank FROM (SELECT doc_id, chunk_no, {SCORE} AS score FROM chunks)) WHERE rank <= 8", V.CHUNKS)
def select_extraction_targets(spark, d):
    return C.select_targets(V.chunks(spark, d), C.score_chunk(), 8).select("doc_id", "chunk_no", "score", "rank")


_VT = "round(CASE WHEN trim(title, ' ') <> '' THEN 1.0 ELSE 0 END + CASE WHEN length(trim(content, ' ')) BETWEEN 80 AND 900 THEN 1.2 WHEN length(trim(content, ' ')) > 900 THEN 0.4 WHEN length(trim(content, ' ')) >= 30 THEN 0.6 ELSE 0 END + {}, 6)::DOUBLE"


@query(f"SELECT doc_id, kind, chunk_no, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY score DESC, chunk_no) AS rank FROM (SELECT doc_id, 'chunk' AS kind, chunk_no, {_VT.format('0')} AS score FROM chunks UNION ALL SELECT doc_id, 'unit', chunk_no, {_VT.format('0.5')} FROM units)) WHERE rank <= 6", V.UNITS)
def select_vector_targets(spark, d):
    rows = V.chunks(spark, d).select("doc_id", "chunk_no", "title", "content", F.lit("chunk").alias("kind")).unionByName(V.units(spark, d).select("doc_id", "chunk_no", "title", "content", F.lit("unit").alias("kind")))
    return C.select_targets(rows, C.score_vector_target(), 6, by=("doc_id", "kind")).select("doc_id", "kind", "chunk_no", "score", "rank")


@query(f"""SELECT doc_id, chunk_no, score::INT AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_no) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, substr({SPACE.format('content')}, 1, 500) ORDER BY chunk_no) AS copy FROM (SELECT c.doc_id, c.chunk_no, c.content, CASE WHEN trim(c.title, ' ') <> '' THEN 4 ELSE 0 END + CASE WHEN chunk_type = 'table_row' THEN 5 WHEN chunk_type = 'list' THEN 3 ELSE 0 END + coalesce(us, 0) + least(5, len(list_distinct(list_filter(regexp_split_to_array(lower(c.content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) // 8) + CASE WHEN length(trim(c.content, ' ')) >= 120 THEN 2 ELSE 0 END + CASE WHEN length(trim(c.content, ' ')) >= 450 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(c.content, '\\d') OR contains(c.content, '|') THEN 2 ELSE 0 END - CASE WHEN length(trim(c.content, ' ')) < 20 THEN 1 ELSE 0 END AS score FROM chunks c LEFT JOIN (SELECT doc_id, chunk_no, sum(6 + CASE WHEN trim(subject, ' ') <> '' THEN 2 ELSE 0 END + CASE WHEN indicator <> '' THEN 2 ELSE 0 END) AS us FROM units GROUP BY ALL) USING (doc_id, chunk_no))) WHERE copy = 1) WHERE rank <= 60""", V.UNITS)
def select_graph_chunks(spark, d):
    return C.select_graph_chunks(V.chunks(spark, d), V.units(spark, d))


# Units ---------------------------------------------------------------------------------------------------------------

NUMERIC = "CASE WHEN doc_type IN ('rule', 'report', 'excel') AND NOT regexp_matches(content, '(?i)(```|class\\s+\\w+|def\\s+\\w+|from\\s+\\w+\\s+import|post\\s+/api/|get\\s+/api/)') THEN nullif(regexp_extract(content, '(\\d+(?:\\.\\d+)?)\\s*(元/晚|元|亿元|万元|%|人|家)?', {}), '') END"


@query(f"SELECT doc_id, chunk_no, CASE doc_type WHEN 'rule' THEN 'rule' WHEN 'speech' THEN 'statement' WHEN 'report' THEN 'fact' WHEN 'excel' THEN 'table_record' ELSE 'summary' END AS unit_type, nullif(substr({SPACE.format('content')}, 1, 300), '') AS normalized, 'chunk:' || chunk_no AS source_span FROM chunks JOIN docs USING (doc_id) WHERE NOT regexp_matches(content, '(?i)(```|class\\s+\\w+|def\\s+\\w+|from\\s+\\w+\\s+import|post\\s+/api/|get\\s+/api/)')", V.CHUNKS)
def extract_units(spark, d):
    df = U.extract_units(V.chunks(spark, d), V.docs(spark, d))
    return df.where(~U.is_code_like("content")).select("doc_id", "chunk_no", "unit_type", "normalized", "source_span")


@query("SELECT doc_id, chunk_no, CASE WHEN ext = 'xlsx' OR chunk_type = 'table_row' THEN 'table_record' ELSE 'statement' END AS unit_type, coalesce(nullif(trim(c.title, ' '), ''), stem) AS subject, CASE WHEN contains(content, 'then') THEN 'sequence' WHEN contains(content, 'with') THEN 'company' END AS indicator, (CASE WHEN contains(content, 'then') OR contains(content, 'with') THEN 0.72 ELSE 0.45 END)::DOUBLE AS confidence, '0-' || length(content) AS source_span FROM chunks c JOIN docs USING (doc_id)", V.CHUNKS)
def heuristic_units(spark, d):
    return U.heuristic_units(V.chunks(spark, d), V.docs(spark, d), (("then", "sequence"), ("with", "company"))).drop("content")


@query(f"SELECT doc_id, chunk_no, try_cast({NUMERIC.format(1)} AS DOUBLE) AS value, CASE WHEN {NUMERIC.format(1)} IS NOT NULL THEN {NUMERIC.format(2)} END AS unit FROM chunks JOIN docs USING (doc_id)", V.CHUNKS)
def parse_numeric(spark, d):
    df = V.chunks(spark, d).join(V.docs(spark, d).select("doc_id", "doc_type"), "doc_id").withColumn("n", U.parse_numeric("content", "doc_type"))
    return df.select("doc_id", "chunk_no", F.regexp_extract("content", U.NUMBER, 1).try_cast("double").alias("v"), "n").select("doc_id", "chunk_no", F.when(F.col("n").isNotNull(), F.col("v")).alias("value"), F.col("n.unit").alias("unit"))


RULES = {"conditions": r"(with [^,.]{2,60})", "constraints": r"((?:then|pour) [^,.]{2,80})", "exceptions": r"(und [^,.]{0,60})"}


@query("SELECT doc_id, chunk_no, " + ", ".join(f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(content, '{p}', 1), lambda x: substr(trim(x, ' '), 1, 120)))), ';') AS {k}" for k, p in RULES.items()) + ", contains(content, 'that') AS approval_required FROM chunks", V.CHUNKS)
def rule_fields(spark, d):
    f = U.rule_fields("content", RULES["conditions"], RULES["constraints"], RULES["exceptions"], ("that",))
    return V.chunks(spark, d).withColumn("f", f).select("doc_id", "chunk_no", *(F.array_join(F.array_sort(F.col("f")[k]), ";").alias(k) for k in RULES), "f.approval_required")


_MARKED = "content || CASE chunk_no % 4 WHEN 0 THEN ' 同比增长' || doc_id || '.5%' WHEN 1 THEN ' 环比下降' || doc_id || '%' WHEN 2 THEN ' 同比' || chunk_no ELSE '' END"


@query(f"SELECT doc_id, chunk_no, nullif(regexp_extract(t, '(\\d{{4}}年(?:\\d{{1,2}}月)?|\\d{{4}}-\\d{{2}}(?:-\\d{{2}})?)', 1), '') AS time, nullif(regexp_extract(t, '([A-Z][a-z]{{2,12}}tion)', 1), '') AS region, nullif(regexp_extract(t, '同比(?:增长|下降)?\\s*(\\d+(?:\\.\\d+)?)\\s*%', 1), '') AS yoy, nullif(regexp_extract(t, '环比(?:增长|下降)?\\s*(\\d+(?:\\.\\d+)?)\\s*%', 1), '') AS mom FROM (SELECT *, {_MARKED} AS t FROM chunks)", V.CHUNKS)
def report_fields(spark, d):
    m = F.col("chunk_no") % 4
    tail = F.when(m == 0, F.concat(F.lit(" 同比增长"), "doc_id", F.lit(".5%"))).when(m == 1, F.concat(F.lit(" 环比下降"), "doc_id", F.lit("%"))).when(m == 2, F.concat(F.lit(" 同比"), "chunk_no")).otherwise("")
    df = V.chunks(spark, d).withColumn("t", F.concat("content", tail))
    return df.withColumn("f", U.report_fields("t", region="([A-Z][a-z]{2,12}tion)")).select("doc_id", "chunk_no", "f.time", "f.region", "f.yoy", "f.mom")


@query("SELECT doc_id, chunk_no, array_to_string(h, ',') AS headers, h[1] || '=' || doc_id || CASE WHEN len(h) >= 3 THEN ';' || h[3] || '=' || chunk_no ELSE '' END AS metrics, CASE WHEN len(h) >= 2 THEN h[2] || '=' || chunk_type ELSE '' END AS dimensions FROM (SELECT *, list_filter(list_transform(string_split(content, ' ')[1:8], lambda x: replace(x, '|', '')), lambda x: x <> '')[1:6] AS w, list_transform(range(1, len(w) + 1), lambda i: i || w[i]) AS h FROM chunks) WHERE len(h) > 0", V.CHUNKS)
def table_fields(spark, d):
    w = F.slice(F.filter(F.transform(F.slice(F.split("content", " "), 1, 8), lambda x: F.replace(x, F.lit("|"), F.lit(""))), lambda x: x != ""), 1, 6)
    heads = F.transform(w, lambda x, i: F.concat((i + 1).cast("string"), x))
    df = V.chunks(spark, d).withColumn("h", heads).where(F.size("h") > 0).withColumn("t", F.concat(F.array_join("h", " | "), F.lit("\n"), F.concat_ws(" | ", F.col("doc_id").cast("string"), "chunk_type", F.col("chunk_no").cast("string"))))
    f = df.withColumn("f", U.table_fields("t"))
    pairs = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return f.select("doc_id", "chunk_no", F.array_join("f.headers", ",").alias("headers"), pairs("f.metrics").alias("metrics"), pairs("f.dimensions").alias("dimensions"))


@query(f"SELECT doc_id, chunk_no, CASE WHEN doc_type = 'rule' AND {_hits('content', ('then', 'pour'))} THEN substr({SPACE.format('content')}, 1, 160) END AS duty, CASE WHEN doc_type = 'speech' THEN substr({SPACE.format('content')}, 1, 300) END AS stance, CASE WHEN doc_type = 'report' AND contains(content, '%') THEN 'contains_percentage' END AS trend FROM chunks JOIN docs USING (doc_id)", V.CHUNKS)
def default_fields(spark, d):
    df = V.chunks(spark, d).join(V.docs(spark, d).select("doc_id", "doc_type"), "doc_id").withColumn("f", U.default_fields("doc_type", "content", ("then", "pour")))
    return df.select("doc_id", "chunk_no", F.get("f.constraints", F.lit(0)).alias("duty"), "f.stance", "f.trend")


_TOPICS = "SELECT doc_id, 0 AS p, 0 AS pos, title AS topic FROM docs UNION ALL SELECT doc_id, 1, chunk_no, title FROM chunks WHERE chunk_no < 20 UNION ALL SELECT doc_id, 2, chunk_no, subject FROM units WHERE chunk_no < 30 UNION ALL SELECT doc_id, 3, chunk_no, indicator FROM units WHERE chunk_no < 30"


@query(f"SELECT doc_id, rank::INT AS rank, topic FROM (SELECT doc_id, topic, row_number() OVER (PARTITION BY doc_id ORDER BY first_at, topic) AS rank FROM (SELECT doc_id, topic, min(p * 1000000 + pos) AS first_at FROM (SELECT doc_id, p, pos, {SPACE.format('topic')} AS topic FROM ({_TOPICS})) WHERE length(topic) BETWEEN 2 AND 24 GROUP BY ALL)) WHERE rank <= 12", V.UNITS)
def structural_topics(spark, d):
    return U.structural_topics(V.docs(spark, d), V.chunks(spark, d), V.units(spark, d))


_WORDS8 = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, chunk_no, array_to_string(list_sort(CASE WHEN len(g) < 8 THEN list_distinct(list_concat(g, list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(w[1:i - 1], w[i])), lambda i: w[i])[1:8])) ELSE g END), '|') AS signals FROM (SELECT c.doc_id, c.chunk_no, list_distinct(list_filter(list_concat([trim(c.title, ' ')], coalesce(list_transform(s, lambda x: trim(x, ' ')), [])), lambda x: x <> '')) AS g, {_WORDS8} AS w FROM chunks c LEFT JOIN (SELECT doc_id, chunk_no, list(DISTINCT s) AS s FROM (SELECT doc_id, chunk_no, subject AS s FROM units UNION ALL SELECT doc_id, chunk_no, indicator FROM units) GROUP BY ALL) USING (doc_id, chunk_no))", V.UNITS)
def structure_signals(spark, d):
    return U.structure_signals(V.chunks(spark, d), V.units(spark, d)).select("doc_id", "chunk_no", F.array_join(F.array_sort("signals"), "|").alias("signals"))


# Text functions ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, chunk_no, regexp_replace(content, '\\s+', '', 'g') AS compact, {TIGHT.format('content')} AS tight, {SPACE.format('content')} AS spaced, CASE WHEN length(content) > 40 THEN substr(content, 1, 40) || '...' ELSE content END AS short FROM chunks", V.CHUNKS)
def text_squeeze(spark, d):
    return V.chunks(spark, d).select("doc_id", "chunk_no", T.compact("content").alias("compact"), T.tight("content").alias("tight"), T.collapse_space("content").alias("spaced"), T.ellipsis("content", 40).alias("short"))


@query("""SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN hit_at > 0 THEN CASE WHEN greatest(1, hit_at - 90) > 1 THEN '...' ELSE '' END || substr(t, greatest(1, hit_at - 90), least(length(t), hit_at + 3 + 90) - greatest(1, hit_at - 90) + 1) || CASE WHEN least(length(t), hit_at + 3 + 90) < length(t) THEN '...' ELSE '' END WHEN length(t) > 180 THEN substr(t, 1, 180) || '...' ELSE t END AS snippet FROM (SELECT doc_id, trim(text, ' ') AS t, instr(lower(trim(text, ' ')), 'tion') AS hit_at FROM docs)""", V.DOCS)
def snippet(spark, d):
    return V.docs(spark, d).select("doc_id", T.snippet("text", F.lit("tion")).alias("snippet"))


@query("SELECT query_id, array_to_string(list_sort(list_distinct(list_concat([q], list_filter(list_transform(regexp_split_to_array(q, '[；;。！？!?,，、/\\\\|]+'), lambda x: trim(x, ' ')), lambda x: length(x) >= 4)))), '#') AS clauses FROM (SELECT query_id, trim(regexp_replace(query, '[“”\"]', ' ', 'g'), ' ') AS q FROM queries_in)", V.QUERIES_IN)
def split_clauses(spark, d):
    q = V.queries_in(spark, d)
    return q.select("query_id", F.array_join(F.array_sort(T.split_clauses("query")), "#").alias("clauses"))


@query("SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(trim(query, ' '), '[\\p{P}\\p{S}\\s]+'), lambda x: x <> ''))), '#') AS tokens, contains(query, '\"') OR length(trim(query, ' ')) >= 8 OR contains(query, chr(39)) AS exactish FROM queries_in", V.QUERIES_IN)
def query_tokens(spark, d):
    return V.queries_in(spark, d).select("query_id", F.array_join(F.array_sort(T.query_tokens("query")), "#").alias("tokens"), T.is_exactish("query").alias("exactish"))


@query("SELECT query_id, array_to_string(CASE WHEN len(w) > 0 THEN w WHEN length(q) >= 2 THEN [q] ELSE [] END, '#') AS terms FROM (SELECT query_id, lower(trim(query, ' ')) AS q, regexp_extract_all(lower(trim(query, ' ')), '([a-z][a-z0-9_-]+)', 1) AS w FROM queries_in)", V.QUERIES_IN)
def query_terms(spark, d):
    return V.queries_in(spark, d).select("query_id", F.array_join(T.query_terms("query"), "#").alias("terms"))


QCUES = (("rule_qa", ("the ",)), ("speech_summary", ("and ", "les ")), ("data_qa", ("of ", "der ")), ("comparative_analysis", ("in ",)))


@query(f"SELECT query_id, {_first('query', QCUES, 'document_lookup')} AS query_type FROM queries_in", V.QUERIES_IN)
def query_type(spark, d):
    return V.queries_in(spark, d).select("query_id", T.query_type("query", QCUES).alias("query_type"))




@query(f"SELECT doc_id, CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) ELSE 0 END::DOUBLE AS similarity FROM (SELECT doc_id, {TRI.format('title')} AS a, {TRI.format('filename')} AS b FROM docs)".replace("'filename'", "filename"), V.DOCS)
def trigram_similarity(spark, d):
    return V.docs(spark, d).select("doc_id", F.round(T.trigram_similarity("title", "filename"), 6).alias("similarity"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 4")
def levenshtein_pairs(spark, d):
    p = V.table(spark, d, "part")
    a, b = p.alias("a"), p.alias("b")
    df = a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_size") == F.col("b.p_size")) & (F.col("a.p_partkey") < F.col("b.p_partkey")))
    return df.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.levenshtein("a.p_name", "b.p_name", 4).cast("long").alias("distance")).where("distance between 0 and 4")


@query("SELECT doc_id, len(list_filter(range(0, least(length(title), length(filename)) + 1), lambda i: substr(title, 1, i) = substr(filename, 1, i))) - 1 AS prefix FROM docs", V.DOCS)
def common_affixes(spark, d):
    return V.docs(spark, d).select("doc_id", T.common_prefix("title", "filename").cast("long").alias("prefix"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, json_exists(props, '$.k') AS has_k FROM events")
def json_get(spark, d):
    k = F.get_json_object("props", "$.k")
    return V.table(spark, d, "events").select("event_id", k.cast("long").alias("k"), k.isNotNull().alias("has_k"))


_VALUE = "CASE WHEN v = '' THEN 'empty' WHEN regexp_matches(v, '[0-9]+(\\.[0-9]+)?(元|万元|亿元)') THEN 'money' WHEN regexp_matches(v, '^[0-9.]+(%|％)$') THEN 'percent' WHEN length(v) <= 24 AND (regexp_matches(v, '^(19|20)[0-9]{2}$') OR regexp_matches(v, '^(19|20)[0-9]{2}[年./．-][0-9]{1,2}([月./．-][0-9]{1,2})?日?$')) THEN 'date' WHEN regexp_matches(v, '^[0-9.]+([个项名所次篇位人万亿年月日小时分钟秒]+)?$') THEN 'scalar' WHEN length(v) <= 32 THEN 'short_text' ELSE 'long_text' END"


@query(f"SELECT o_orderkey, part, {_VALUE} AS shape FROM (SELECT o_orderkey, unnest(['a', 'b', 'c', 'd']) AS part, regexp_replace(lower(unnest([o_orderpriority, o_totalprice::BIGINT || '元', strftime(o_orderdate, '%Y-%m-%d'), o_custkey || '%'])), '\\s+', '', 'g') AS v FROM orders)")
def value_shape(spark, d):
    o = V.table(spark, d, "orders")
    parts = F.array(*(F.struct(F.lit(k).alias("part"), v.alias("v")) for k, v in (("a", F.col("o_orderpriority")), ("b", F.concat(F.round("o_totalprice", 0).cast("long").cast("string"), F.lit("元"))), ("c", F.date_format("o_orderdate", "yyyy-MM-dd")), ("d", F.concat(F.col("o_custkey").cast("string"), F.lit("%"))))))
    return o.select("o_orderkey", F.explode(parts).alias("p")).select("o_orderkey", "p.part", T.value_shape("p.v").alias("shape"))


@query("SELECT doc_id, chunk_no, CASE WHEN contains(v, ':') THEN 'key_value' ELSE 'free_text' END AS pattern, CASE WHEN contains(content, ':') AND contains(lower(regexp_extract(content, '(?s)^([^：:]*)[：:](.*)$', 1)), 'th') AND trim(regexp_extract(content, '(?s)^([^：:]*)[：:](.*)$', 2), ' ') <> '' THEN trim(regexp_extract(content, '(?s)^([^：:]*)[：:](.*)$', 2), ' ') ELSE 'none' END AS governed FROM (SELECT *, lower(content) AS v FROM chunks)", V.CHUNKS)
def statement_pattern(spark, d):
    return V.chunks(spark, d).select("doc_id", "chunk_no", T.statement_pattern("content").alias("pattern"), T.governed_value(F.lit("th"), "content", F.lit("none")).alias("governed"))


# Relational patterns -------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type, ts::VARCHAR AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1".replace("ts::VARCHAR AS ts", "value"))
def latest_per_key(spark, d):
    return R.latest_per_key(V.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT o_orderkey, coalesce(l_linenumber, 0) AS first_l_linenumber, coalesce(l_quantity, 0) AS first_l_quantity FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS k FROM lineitem) ON l_orderkey = o_orderkey AND k = 1")
def first_child(spark, d):
    li = V.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return R.first_per_parent(V.table(spark, d, "orders").select("o_orderkey"), li.withColumn("n", F.col("l_linenumber")), "o_orderkey", ["n"], ["l_linenumber", "l_quantity"]).fillna(0)


@query("SELECT c_nationkey, c_custkey, c_acctbal, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5")
def top_k_per_group(spark, d):
    return R.top_k_per_group(V.table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 5).select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("SELECT user_id, event_id, total, row_no::INT AS row_no FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS row_no FROM events) WHERE row_no BETWEEN 6 AND 10")
def page(spark, d):
    return R.page(V.table(spark, d, "events"), ["user_id"], [F.desc("value"), "event_id"], 2, 5).select("user_id", "event_id", "total", "row_no")


@query("SELECT c.doc_id, a.chunk_no AS anchor, c.chunk_no, c.chunk_no - a.chunk_no AS distance FROM (SELECT doc_id, chunk_no FROM chunks WHERE contains(content, 'then')) a JOIN chunks c ON c.doc_id = a.doc_id AND c.chunk_no BETWEEN a.chunk_no - 1 AND a.chunk_no + 1", V.CHUNKS)
def context_window(spark, d):
    c = V.chunks(spark, d)
    return R.context_window(c.where(F.col("content").contains("then")), c, 1).select("doc_id", "anchor", "chunk_no", "distance")


@query("SELECT doc_id, p_name AS term FROM docs JOIN (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS p_name FROM part UNION SELECT 'then' UNION SELECT 'pour' UNION SELECT 'with') ON contains(lower(text), p_name)", V.DOCS)
def containment_join(spark, d):
    terms = V.table(spark, d, "part").select(F.lower(F.split("p_name", " ")[0]).alias("term")).union(spark.createDataFrame([("then",), ("pour",), ("with",)], "term string"))
    return R.containment_join(V.docs(spark, d), terms, text=F.lower("text"), id_col="doc_id", term_col="term")


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.s, 0) AS left_score, coalesce(b.s, 0) AS right_score FROM (SELECT user_id, round(sum(value), 4) AS s FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, round(sum(value), 4) AS s FROM events WHERE event_type = 'view' GROUP BY 1) b ON a.user_id = b.user_id")
def full_outer_merge(spark, d):
    e = V.table(spark, d, "events")
    one = lambda k: e.where(F.col("event_type") == k).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("score"))
    return R.full_merge(one("click"), one("view"), ["user_id"])


@query("SELECT user_id AS id, round(sum(w), 6) AS score, max_by(event_type, [rank::VARCHAR, event_type]) AS payload FROM (SELECT user_id, event_type, value * CASE event_type WHEN 'click' THEN 3.0 WHEN 'view' THEN 2.4 ELSE 1.2 END AS w, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS rank FROM events) GROUP BY user_id")
def accumulate(spark, d):
    e = V.table(spark, d, "events")
    weight = F.when(F.col("event_type") == "click", 3.0).when(F.col("event_type") == "view", 2.4).otherwise(1.2)
    rank = F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    return R.accumulate(e.select(F.col("user_id").alias("id"), (F.col("value") * weight).alias("weight"), F.col("event_type").alias("payload"), rank.alias("payload_rank")))
