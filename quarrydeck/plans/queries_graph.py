"""Registered queries: knowledge graph and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plugins as P
from ..functions import text as T
from ..functions.lineage import cut
from ..operators import graph as G
from ..operators import structure as X
from ..operators import topics as O
from ..operators.retrieval import small
from . import views as V
from .queries_docs import TIGHT
from .queries_search import PREP, WORDS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {views.strip()} " if views else "") + sql
        return f

    return add


NORM = "regexp_replace(lower(trim({}, ' ')), '\\s+', '', 'g')"
KEY = f"{NORM.format('{0}')} || ':' || {NORM.format('{1}')}"
MARKS = "[()（）\\[\\]【】《》<>“”\"'、，,。.;；:：\\-_/\\\\|]".replace("'", "''")
FUSION = f"regexp_replace({NORM.format('{}')}, '{MARKS}', '', 'g')"
GROUP = "CASE {0} WHEN 'organization' THEN 'organization' WHEN 'product' THEN 'solution' ELSE {0} END"
STATE = "CASE WHEN valid_from = '' AND valid_to = '' THEN {0} || ':state:default' ELSE {0} || ':state:' || valid_from || ':' || valid_to END"


@query(f"SELECT entity_id, {KEY.format('entity_type', 'name')} AS key, {FUSION.format('name')} AS fusion_key, {KEY.format('entity_type', 'name')} || ':state:default' AS state_key, {GROUP.format('entity_type')} AS grp FROM entities", V.ENTITIES)
def entity_keys(spark, d):
    key = G.canonical_key("entity_type", "name")
    return V.entities(spark, d).select("entity_id", key.alias("key"), G.fusion_key("entity_type", "name").alias("fusion_key"), G.state_key(key, F.lit(""), F.lit("")).alias("state_key"), G.fusion_type_group("entity_type").alias("grp"))


FACT_KEY = f"""f1 AS (SELECT *, {KEY.format('subject_type', 'subject')} AS sk, CASE WHEN object_type IS NOT NULL THEN {KEY.format('object_type', 'object')} END AS ok FROM facts),
f2 AS (SELECT *, {STATE.format('sk')} AS ss, CASE WHEN ok IS NOT NULL THEN {STATE.format('ok')} END AS os FROM f1),
f3 AS (SELECT *, ss || ':fact:' || CASE fact_kind WHEN 'attribute' THEN 'attribute_fact' ELSE 'relation_fact' END || ':' || predicate || ':' || {NORM.format('coalesce(os, object)')} || ':' || valid_from || ':' || valid_to AS fact_key FROM f2)"""
GRAPH = V.FACTS + "," + V.ENTITIES + ",\n" + FACT_KEY + f""",
e1 AS (SELECT *, {KEY.format('entity_type', 'name')} AS key FROM entities),
entity AS (SELECT key, max_by(name, doc_id) AS name, max_by(entity_type, doc_id) AS entity_type, count(DISTINCT doc_id) AS documents FROM e1 GROUP BY key),
fact AS (SELECT fact_key, any_value(ss) AS subject_state, any_value(os) AS object_state, count(*) AS evidence FROM f3 GROUP BY fact_key),
state AS (SELECT DISTINCT key, state_key, ends_with(state_key, ':state:default') AS is_default FROM (SELECT key, key || ':state:default' AS state_key FROM entity UNION ALL SELECT sk, ss FROM f3 UNION ALL SELECT ok, os FROM f3 WHERE ok IS NOT NULL))"""  # fmt: skip


@query("SELECT fact_id, fact_key FROM f3", V.FACTS + ",\n" + FACT_KEY)
def fact_key(spark, d):
    f = V.facts(spark, d).withColumn("sk", G.canonical_key("subject_type", "subject")).withColumn("ok", F.when(F.col("object_type").isNotNull(), G.canonical_key("object_type", "object")))
    state = F.when(F.col("ok").isNotNull(), G.state_key(F.col("ok"), "valid_from", "valid_to"))
    return f.select("fact_id", G.fact_key(G.state_key(F.col("sk"), "valid_from", "valid_to"), G.normalize_fact_kind("fact_kind"), "predicate", F.coalesce(state, "object"), "valid_from", "valid_to").alias("fact_key"))


@query("SELECT fact_id, CASE fact_kind WHEN 'attribute' THEN 'attribute_fact' ELSE 'relation_fact' END AS kind, predicate = 'supplies' AS evolves FROM facts", V.FACTS)
def normalize_fact_kind(spark, d):
    return V.facts(spark, d).select("fact_id", G.normalize_fact_kind("fact_kind").alias("kind"), G.is_evolution("predicate", "object", signals=("suppli",)).alias("evolves"))


@query("SELECT entity_id, CASE entity_type WHEN 'customer' THEN 'party' WHEN 'organization' THEN 'party' WHEN 'product' THEN 'item' ELSE entity_type END AS entity_type FROM entities", V.ENTITIES)
def normalize_entity_types(spark, d):
    t = spark.createDataFrame([("party", "Party", ["Customer", "Organization"]), ("item", "Product", ["goods"]), ("zone", "Product", None)], "code string, label string, aliases array<string>")
    return G.normalize_entity_types(V.entities(spark, d), t).select("entity_id", "entity_type")


def _graph(spark, d):
    return G.build_graph(V.entities(spark, d), V.facts(spark, d))


@query("SELECT key, entity_type, documents FROM entity", GRAPH)
def build_graph_entities(spark, d):
    return _graph(spark, d)["entity"].select("key", "entity_type", "documents")


@query("SELECT key, state_key, is_default FROM state", GRAPH)
def build_graph_states(spark, d):
    return _graph(spark, d)["state"]


@query("SELECT fact_key, max_by(ss, [doc_id::VARCHAR, fact_id]) AS subject_state, max_by(os, [doc_id::VARCHAR, fact_id]) AS object_state, any_value(predicate) AS predicate, any_value(fact_kind) AS fact_kind, count(*) AS evidence FROM f3 GROUP BY fact_key", GRAPH)
def build_graph_facts(spark, d):
    return _graph(spark, d)["fact"].select("fact_key", "subject_state", "object_state", "predicate", "fact_kind", "evidence")


@query("SELECT 'entity' AS part, count(*) AS n FROM entity UNION ALL SELECT 'state', count(*) FROM state UNION ALL SELECT 'fact', count(*) FROM fact UNION ALL SELECT 'mention', count(*) FROM (SELECT DISTINCT key, doc_id FROM e1) UNION ALL SELECT 'evidence', count(*) FROM (SELECT DISTINCT fact_key, doc_id FROM f3) UNION ALL SELECT 'default_state', count(*) FROM state WHERE is_default", GRAPH)
def graph_stats(spark, d):
    return G.graph_stats(_graph(spark, d))


@query("""SELECT 'entity' AS part, (SELECT count(*) FROM ent) AS n UNION ALL SELECT 'fact', (SELECT count(*) FROM kept) UNION ALL SELECT 'mention', (SELECT count(*) FROM men) UNION ALL SELECT 'evidence', (SELECT count(*) FROM ev) UNION ALL SELECT 'state', (SELECT count(*) FROM state WHERE key IN (SELECT key FROM ent) AND (is_default OR state_key IN (SELECT s FROM used))) UNION ALL SELECT 'default_state', (SELECT count(*) FROM state WHERE is_default AND key IN (SELECT key FROM ent))""", GRAPH + """,
gone AS (SELECT * FROM range(0, 100000000, 5) t(doc_id) WHERE doc_id IN (SELECT doc_id FROM facts)),
ev AS (SELECT DISTINCT fact_key, doc_id FROM f3 WHERE doc_id NOT IN (SELECT doc_id FROM gone)),
men AS (SELECT DISTINCT key, doc_id FROM e1 WHERE doc_id NOT IN (SELECT doc_id FROM gone)),
kept AS (SELECT * FROM fact WHERE fact_key IN (SELECT fact_key FROM ev)), ent AS (SELECT * FROM entity WHERE key IN (SELECT key FROM men)),
used AS (SELECT subject_state AS s FROM kept UNION SELECT object_state FROM kept WHERE object_state IS NOT NULL)""".replace("SELECT * FROM range(0, 100000000, 5) t(doc_id) WHERE doc_id IN (SELECT doc_id FROM facts)", "SELECT DISTINCT doc_id FROM facts WHERE doc_id % 5 = 0"))
def replace_document_graph(spark, d):
    gone = V.facts(spark, d).where("doc_id % 5 = 0").select("doc_id").distinct()
    return G.graph_stats(G.replace_document_graph(_graph(spark, d), gone))


@query("SELECT event_id, run_id < max(run_id) OVER (PARTITION BY doc_id) AS superseded FROM (SELECT event_id, user_id AS doc_id, event_id // 100 AS run_id FROM events)")
def supersede_mentions(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.col("user_id").alias("doc_id"), F.floor(F.col("event_id") / 100).alias("run_id"))
    return G.supersede_mentions(e).select("event_id", "superseded")


FEATURES = GRAPH + """,
ft AS (SELECT b.key, b.name, b.entity_type, mentions, coalesce(r.n, 0) AS relations, coalesce(a.n, 0) AS attributes FROM (SELECT key, min(name) AS name, min(entity_type) AS entity_type, count(DISTINCT doc_id) AS mentions FROM e1 GROUP BY key) b LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT sk AS k FROM f1 WHERE ok IS NOT NULL UNION ALL SELECT ok FROM f1 WHERE ok IS NOT NULL) GROUP BY k) r ON r.k = b.key LEFT JOIN (SELECT sk, count(*) AS n FROM f1 WHERE ok IS NULL GROUP BY sk) a ON a.sk = b.key)"""


@query("SELECT key, mentions, relations, attributes FROM ft", FEATURES)
def fusion_features(spark, d):
    return G.fusion_features(V.entities(spark, d), V.facts(spark, d)).select("key", "mentions", "relations", "attributes")


@query(f"""SELECT key, canonical, CASE WHEN key = canonical THEN 'canonical' ELSE 'member' END AS role, size FROM (SELECT key, first_value(key) OVER (PARTITION BY grp, fk ORDER BY coalesce(relations, 0) DESC, mentions DESC, length(name) DESC, key) AS canonical, count(*) OVER (PARTITION BY grp, fk) AS size FROM (SELECT *, {FUSION.format('name')} AS fk, {GROUP.format('entity_type')} AS grp FROM (SELECT key, min(name) AS name, min(entity_type) AS entity_type, count(DISTINCT doc_id) AS mentions FROM (SELECT *, {KEY.format('entity_type', 'name')} AS key FROM (SELECT entity_id, entity_type, doc_id, regexp_replace(name, '#0*([0-9]{{1,6}})$', '# \\1') AS name FROM (SELECT entity_id, entity_type, doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(name) || ' ' || chr(45) ELSE name END AS name FROM entities))) GROUP BY key) LEFT JOIN (SELECT key, count(*) AS relations FROM (SELECT {KEY.format('subject_type', 'subject')} AS key FROM facts WHERE object_type IS NOT NULL UNION ALL SELECT {KEY.format('object_type', 'object')} FROM facts WHERE object_type IS NOT NULL) GROUP BY 1) USING (key)) WHERE length(fk) >= 2) WHERE size BETWEEN 2 AND 50""", V.ENTITIES + "," + V.FACTS)
def fuse_exact(spark, d):
    e = V.entities(spark, d).withColumn("name", F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("name"), F.lit(" -"))).otherwise(F.col("name")))
    e = e.withColumn("name", F.regexp_replace("name", "#0*([0-9]{1,6})$", "# $1"))
    return G.fuse_exact(G.fusion_features(e, V.facts(spark, d))).select("key", "canonical", "role", "size")


NEAR = V.ENTITIES + f""",
nm AS (SELECT {GROUP.format('entity_type')} AS grp, {FUSION.format('name')} AS n, min({KEY.format('entity_type', 'name')}) AS key FROM entities WHERE length({FUSION.format('name')}) >= 5 GROUP BY 1, 2),
np AS (SELECT a.key AS a, b.key AS b, levenshtein(a.n, b.n) AS distance FROM nm a JOIN nm b ON a.grp = b.grp AND a.key < b.key AND abs(length(a.n) - length(b.n)) <= 2 WHERE levenshtein(a.n, b.n) = 1 OR (levenshtein(a.n, b.n) = 2 AND least(length(a.n), length(b.n)) >= 8 AND substr(a.n, 1, 3) = substr(b.n, 1, 3) AND right(a.n, 2) = right(b.n, 2)))"""  # fmt: skip


def _keyed(spark, d):
    return V.entities(spark, d).withColumn("key", G.canonical_key("entity_type", "name"))


@query("SELECT a, b, distance::INT AS distance FROM np", NEAR)
def fuse_near(spark, d):
    return G.near_name_pairs(_keyed(spark, d))


@query()
def near_groups(spark, d):
    return G.near_groups(G.near_name_pairs(_keyed(spark, d)))


@query("SELECT fact_id, subject, signal, label, confidence FROM (SELECT fact_id, subject, 'time' AS signal, valid_from || '-' || valid_to AS label, 0.78::DOUBLE AS confidence FROM df UNION ALL SELECT fact_id, subject, 'phase', nullif(regexp_extract(lower(predicate || ' ' || object), '(一期|二期|三期|四期|phase\\s*[1-4])', 1), ''), 0.82 FROM df UNION ALL SELECT fact_id, subject, 'version', nullif(regexp_extract(lower(predicate || ' ' || object), '(?i)\\b(v\\d+(?:\\.\\d+)*)', 1), ''), 0.76 FROM df UNION ALL SELECT fact_id, subject, 'status', CASE WHEN contains(object, 'planned') THEN 'planned' WHEN contains(object, 'running') THEN 'running' WHEN contains(object, 'done') THEN 'done' WHEN contains(object, 'closed') THEN 'closed' END, 0.70 FROM df) WHERE label <> ''", V.FACTS + ",\ndf AS (SELECT fact_id, subject, predicate, CASE WHEN fact_kind = 'attribute' THEN object || CASE (doc_id % 4) WHEN 0 THEN ' Phase 2 done' WHEN 1 THEN ' v1.' || doc_id WHEN 2 THEN ' running' ELSE '' END ELSE object END AS object, valid_from, valid_to FROM facts)")
def derive_states(spark, d):
    m = F.col("doc_id") % 4
    tail = F.when(m == 0, " Phase 2 done").when(m == 1, F.concat(F.lit(" v1."), "doc_id")).when(m == 2, " running").otherwise("")
    f = V.facts(spark, d).withColumn("object", F.when(F.col("fact_kind") == "attribute", F.concat("object", tail)).otherwise(F.col("object")))
    return G.derive_states(f).select("fact_id", "subject", "signal", "label", "confidence")


STATES = V.JOBS + ",\nst AS (SELECT file_id AS entity_key, stage AS signal, status AS label, status || repeat('x', (job_id % 7)::INT) AS definition, started AS since FROM jobs)"


def _states(spark, d):
    return V.jobs(spark, d).select(F.col("file_id").alias("entity_key"), F.col("stage").alias("signal"), F.col("status").alias("label"), F.concat("status", F.repeat(F.lit("x"), (F.col("job_id") % 7).cast("int"))).alias("definition"), F.col("started").alias("since"))


@query("SELECT entity_key, signal, label, max_by(definition, length(definition)) AS definition, count(*) AS states FROM st GROUP BY ALL", STATES)
def fuse_states(spark, d):
    return G.fuse_states(_states(spark, d))


@query("SELECT entity_key, signal, label AS from_label, to_label, 0.72::DOUBLE AS confidence FROM (SELECT *, lead(label) OVER (PARTITION BY entity_key, signal ORDER BY since, label) AS to_label FROM (SELECT entity_key, signal, label, min(since) AS since FROM st GROUP BY ALL)) WHERE to_label IS NOT NULL", STATES)
def inferred_transitions(spark, d):
    return G.inferred_transitions(_states(spark, d))


@query("SELECT fact_id, subject, object FROM facts WHERE fact_kind = 'relation' AND predicate = 'located_in'", V.FACTS)
def explicit_transitions(spark, d):
    f = V.facts(spark, d).withColumn("fact_kind", F.when(F.col("predicate") == "located_in", "evolution").otherwise(F.col("fact_kind")))
    return G.explicit_transitions(f).select("fact_id", "subject", "object")


ATTRS = V.FACTS + ",\natts AS (SELECT *, CASE WHEN regexp_matches(object, '^[0-9.]+$') THEN CASE WHEN regexp_matches(object, '^(19|20)[0-9]{2}$') THEN 'date' ELSE 'scalar' END WHEN length(object) <= 32 THEN 'short_text' ELSE 'long_text' END AS shape FROM facts WHERE fact_kind = 'attribute')"


@query("SELECT subject_type, predicate, shape, facts, entities, documents, samples[1] AS first FROM (SELECT subject_type, predicate, shape, count(*) AS facts, count(DISTINCT subject) AS entities, count(DISTINCT doc_id) AS documents, list_sort(list(DISTINCT object)) AS samples FROM atts GROUP BY ALL)", ATTRS)
def attribute_clusters(spark, d):
    c = G.attribute_clusters(V.facts(spark, d).where("fact_kind = 'attribute'"))
    return c.select("subject_type", "predicate", "shape", "facts", "entities", "documents", F.get("samples", F.lit(0)).alias("first"))


@query("SELECT predicate, CASE WHEN predicate = 'brand' THEN 'keep' WHEN shape IN ('scalar', 'date') THEN 'attribute' ELSE 'keep' END AS recommendation, round(CASE WHEN predicate <> 'brand' AND shape = 'date' THEN 0.9 WHEN predicate <> 'brand' AND shape = 'scalar' THEN 0.8 ELSE 0.6 END + least(0.10, log10(facts) / 20), 5)::DOUBLE AS confidence FROM (SELECT predicate, shape, count(*) AS facts FROM atts GROUP BY ALL)", ATTRS)
def recommend_cluster(spark, d):
    c = G.attribute_clusters(V.facts(spark, d).where("fact_kind = 'attribute'"))
    return G.recommend_cluster(c, ["brand"]).select("predicate", "recommendation", F.round("confidence", 5).alias("confidence"))


@query("SELECT predicate, facts >= 3 AND facts < 1000000000 AS needs_review FROM (SELECT predicate, shape, count(*) AS facts FROM atts GROUP BY ALL)", ATTRS)
def review_clusters(spark, d):
    c = G.recommend_cluster(G.attribute_clusters(V.facts(spark, d).where("fact_kind = 'attribute'")), ["brand"])
    return G.review_clusters(c, 1.0).select("predicate", "needs_review")


@query("SELECT fact_id, CASE WHEN fact_kind <> 'attribute' THEN 'relation_fact' WHEN predicate = 'size' THEN 'rejected' ELSE 'attribute_fact' END AS fact_kind FROM facts", V.FACTS)
def apply_cluster_decisions(spark, d):
    x = spark.createDataFrame([("product", "size", "discard", 0.9), ("product", "brand", "discard", 0.5)], "subject_type string, predicate string, recommendation string, confidence double")
    return G.apply_cluster_decisions(V.facts(spark, d), x, 0.8).select("fact_id", "fact_kind")


@query("SELECT fact_id, CASE WHEN shape = 'long_text' THEN 'demote_long' WHEN predicate = 'brand' THEN 'template' WHEN shape = 'date' THEN 'generic_key' WHEN shape = 'scalar' THEN 'scalar' ELSE 'attribute_candidate' END AS reason FROM atts", ATTRS)
def govern_attributes(spark, d):
    hints = spark.createDataFrame([("product", "Brand")], "entity_type string, attribute string")
    return G.govern_attributes(V.facts(spark, d).where("fact_kind = 'attribute'"), hints).select("fact_id", "reason")


@query("SELECT fact_id, NOT contains(subject, object) AND NOT contains(object, subject) AS mismatch FROM facts", V.FACTS)
def name_value_mismatch(spark, d):
    return V.facts(spark, d).select("fact_id", G.name_value_mismatch(F.array("subject"), F.array("object")).alias("mismatch"))


BOUND = V.FACTS + "," + V.ENTITIES + f""",
nn AS (SELECT {NORM.format('name')} AS n, min(entity_id) AS id FROM entities GROUP BY 1),
b1 AS (SELECT f.*, CASE WHEN fact_kind = 'attribute' THEN 'attribute_fact' ELSE 'relation_fact' END AS kind, {NORM.format('subject')} AS sn, CASE WHEN fact_kind <> 'attribute' THEN {NORM.format('object')} END AS obn FROM facts f),
b2 AS (SELECT b1.*, coalesce(s.id, 'made:' || sn) AS subject_id, coalesce(o.id, CASE WHEN obn <> '' THEN 'made:' || obn END) AS object_id FROM b1 LEFT JOIN nn s ON s.n = sn LEFT JOIN nn o ON o.n = obn),
b3 AS (SELECT *, CASE WHEN subject_id = object_id THEN 'self_loop' WHEN row_number() OVER (PARTITION BY subject_id, kind, predicate, {NORM.format('object')} ORDER BY fact_id) > 1 THEN 'repeat' ELSE 'kept' END AS reason FROM b2)"""  # fmt: skip


@query("SELECT subject_id, kind AS fact_kind, predicate, object, object_id, count(*) AS n FROM b3 WHERE reason = 'kept' GROUP BY ALL UNION ALL SELECT reason, NULL, NULL, NULL, NULL, count(*) FROM b3 GROUP BY reason", BOUND)
def bind_facts(spark, d):
    kept, _, reasons = G.bind_facts(V.facts(spark, d), V.entities(spark, d))
    rows = kept.groupBy("subject_id", "fact_kind", "predicate", "object", "object_id").agg(F.count("*").alias("n"))
    none = [F.lit(None).cast("string").alias(c) for c in ("fact_kind", "predicate", "object", "object_id")]
    return rows.unionByName(reasons.select(F.col("reason").alias("subject_id"), *none, "n"))


@query("SELECT e.entity_id, CASE WHEN x.id IS NOT NULL THEN 'fact_endpoint' ELSE 'context_mention' END AS role FROM entities e LEFT JOIN (SELECT subject_id AS id FROM b3 WHERE reason = 'kept' UNION SELECT object_id FROM b3 WHERE reason = 'kept' AND object_id IS NOT NULL) x ON x.id = e.entity_id", BOUND)
def mark_entity_roles(spark, d):
    facts, _, _ = G.bind_facts(V.facts(spark, d), V.entities(spark, d))
    return G.mark_entity_roles(V.entities(spark, d), facts).select("entity_id", "role")


@query("SELECT subject, predicate, object, min(fact_id) AS fact_id FROM facts GROUP BY ALL", V.FACTS)
def dedupe_facts(spark, d):
    return G.dedupe_facts(V.facts(spark, d), ["subject", "predicate", "object"], ["fact_id"]).select("subject", "predicate", "object", "fact_id")


STRUCTURE_FIELDS = ("then", "pour")
QUALITY = GRAPH + "," + V.CHUNKS.strip() + f""",
kinds AS (SELECT fact_key, any_value(predicate) AS predicate, any_value(fact_kind) AS kind FROM f3 GROUP BY fact_key),
men AS (SELECT DISTINCT key FROM e1 WHERE doc_id % 7 <> 0),
ends AS (SELECT subject_state AS s FROM fact UNION SELECT object_state FROM fact WHERE object_state IS NOT NULL),
alone AS (SELECT e.key, name, entity_type, e.key IN (SELECT key FROM men) AS mentioned FROM entity e WHERE key || ':state:default' NOT IN (SELECT s FROM ends)),
names AS (SELECT key, {FUSION.format('min(name)')} AS fk, {GROUP.format('min(entity_type)')} AS grp FROM e1 GROUP BY key),
struc AS (SELECT content AS statement, (doc_id % 10) / 10.0 AS confidence FROM chunks),
q AS (SELECT (SELECT count(*) FROM entity) AS entities, 0::BIGINT AS suspicious_names, (SELECT count(*) FROM names WHERE length(fk) >= 2) AS fusion_eligible, (SELECT count(*) FROM fact) AS facts, (SELECT count(*) FROM kinds WHERE kind = 'relation') AS relation_facts, (SELECT count(*) FROM kinds WHERE kind = 'attribute') AS attribute_facts, 0::BIGINT AS attribute_candidates,
  (SELECT count(*) FROM (SELECT 1 FROM names WHERE length(fk) >= 2 GROUP BY grp, fk HAVING count(*) BETWEEN 2 AND 50)) AS entity_clusters, (SELECT count(*) FROM state WHERE NOT is_default) AS real_states, (SELECT count(*) FROM facts WHERE predicate = 'located_in') AS transition_edges, (SELECT count(*) FROM alone) AS unlinked_entities, (SELECT count(*) FROM alone WHERE NOT mentioned) AS isolated_entities,
  (SELECT count(*) FROM struc) AS structure_facts, (SELECT count(*) FROM struc WHERE regexp_matches(statement, '[0-9]+')) AS numeric_structure_facts, (SELECT count(*) FROM struc WHERE contains(statement, 'then') OR contains(statement, 'pour')) AS field_structure_facts),
q2 AS (SELECT *, CASE WHEN entities = 0 THEN 0 ELSE round(relation_facts / entities, 2) END::DOUBLE AS relation_per_entity FROM q)"""  # fmt: skip


def _seen_graph(spark, d):
    """The graph with the mentions of some documents lost, and the statements of its chunks as structure facts."""
    g = _graph(spark, d)
    structure = V.chunks(spark, d).select(F.col("content").alias("statement"), (F.col("doc_id") % 10 / 10).alias("confidence"))
    return g | {"mention": g["mention"].where("doc_id % 7 != 0")}, structure


def _quality(spark, d):
    g, structure = _seen_graph(spark, d)
    f = V.facts(spark, d)
    features = G.fusion_features(V.entities(spark, d), f)
    named = features.withColumn("fusion_key", G.fusion_key("entity_type", "name"))
    clusters = G.fuse_exact(features).where("role = 'canonical'")
    return G.graph_quality(g, eligible=named.where(G.fusion_eligible()), clusters=clusters, transitions=f.where("predicate = 'located_in'"), structure=structure, numbers="[0-9]+", fields=STRUCTURE_FIELDS)


@query("SELECT * FROM q2", QUALITY)
def graph_quality(spark, d):
    return _quality(spark, d)


@query("SELECT * FROM (SELECT 'structure_noise' AS risk, 'structure_enhancement' AS stage, numeric_structure_facts + field_structure_facts AS n FROM q2 UNION ALL SELECT 'isolated_entities', 'entity_extraction', isolated_entities FROM q2 UNION ALL SELECT 'unlinked_entities', 'relation_enrichment', unlinked_entities FROM q2 UNION ALL SELECT 'sparse_relations', 'relation_enrichment', CASE WHEN relation_per_entity < 0.5 THEN round(relation_per_entity * 100)::BIGINT ELSE 0 END FROM q2) WHERE n > 0", QUALITY)
def quality_risks(spark, d):
    return G.quality_risks(_quality(spark, d))


@query("SELECT 'unlinked' AS sample, name AS item, entity_type AS detail FROM (SELECT * FROM alone ORDER BY name, key LIMIT 30) UNION ALL SELECT 'structure', statement, floor(confidence * 10)::INT::VARCHAR FROM (SELECT * FROM struc WHERE regexp_matches(statement, '[0-9]+') OR contains(statement, 'then') OR contains(statement, 'pour') ORDER BY confidence, statement LIMIT 30) UNION ALL SELECT 'relations', predicate, count(*)::VARCHAR FROM kinds WHERE kind = 'relation' GROUP BY predicate", QUALITY)
def quality_samples(spark, d):
    g, structure = _seen_graph(spark, d)
    s = G.quality_samples(g, structure, numbers="[0-9]+", fields=STRUCTURE_FIELDS)
    return s.withColumn("detail", F.when(F.col("sample") == "structure", F.floor(F.col("detail").cast("double") * 10).cast("string")).otherwise(F.col("detail")))


PHASED = V.JOBS + ",\nps AS (SELECT job_id, file_id AS entity_key, 'file ' || file_id AS entity_name, CASE job_id % 5 WHEN 0 THEN 'release v1 ' WHEN 1 THEN 'release 2.0 ' WHEN 2 THEN 'file ' || file_id WHEN 3 THEN 'state ' || status ELSE '' END AS state_name, CASE WHEN job_id % 5 = 2 THEN '' ELSE stage END AS definition, CASE WHEN job_id % 5 = 4 THEN '2024' ELSE '' END AS valid_from FROM jobs)"


@query("SELECT entity_key, signature, max_by(definition, [length(definition)::VARCHAR, definition]) AS definition, count(*) AS states FROM (SELECT *, CASE WHEN contains(t, 'v1') OR contains(t, '1.0') THEN 'phase:1' WHEN contains(t, 'v2') OR contains(t, '2.0') THEN 'phase:2' WHEN contains(t, 'v3') OR contains(t, '3.0') THEN 'phase:3' WHEN valid_from <> '' THEN 'time:' || valid_from || '|' WHEN trim(replace(t, entity_name, ''), ' ') = '' THEN 'default' ELSE 'text:' || substr(trim(replace(t, entity_name, ''), ' '), 1, 48) END AS signature FROM (SELECT *, lower(state_name || ' ' || definition) AS t FROM ps)) GROUP BY entity_key, signature", PHASED)
def fuse_states_by_text(spark, d):
    j, m = V.jobs(spark, d), F.col("job_id") % 5
    name = F.concat(F.lit("file "), "file_id")
    rows = j.select(F.col("file_id").alias("entity_key"), name.alias("entity_name"), F.when(m == 0, "release v1 ").when(m == 1, "release 2.0 ").when(m == 2, name).when(m == 3, F.concat(F.lit("state "), "status")).otherwise("").alias("state_name"), F.when(m == 2, "").otherwise(F.col("stage")).alias("definition"), F.when(m == 4, "2024").otherwise("").alias("valid_from"), F.lit("").alias("valid_to"))
    return G.fuse_states_by_text(rows)


@query("SELECT DISTINCT 'st-' || (l_partkey % 50) AS state_key, fact_id FROM (SELECT fact_id, doc_id AS l_partkey FROM facts WHERE predicate IN ('located_in', 'brand')) WHERE (l_partkey % 50) % 4 <> 3 AND NOT starts_with(fact_id, 'a-')", V.FACTS)
def phase_relations(spark, d):
    f = V.facts(spark, d)
    t = f.where("predicate in ('located_in', 'brand')").select("fact_id", F.concat(F.lit("st-"), F.col("doc_id") % 50).alias("to_state"))
    states = spark.createDataFrame([(f"st-{i}", ("phase", "version", "status", "time")[i % 4]) for i in range(50)], "state_key string, signal string")
    return G.phase_relations(t, states, f)


@query("SELECT predicate, CASE fact_kind WHEN 'attribute' THEN 'attribute_fact' ELSE 'relation_fact' END AS fact_kind, count(*) AS n, count(DISTINCT subject) AS subjects FROM facts GROUP BY ALL", V.FACTS)
def relation_counts(spark, d):
    return G.relation_counts(V.facts(spark, d))


CONNECTED = V.FACTS + """,
tc AS (SELECT coalesce(o.e, i.e) AS entity, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM (SELECT subject AS e, count(*) AS n FROM facts WHERE object_type IS NOT NULL GROUP BY 1) o FULL JOIN (SELECT object AS e, count(*) AS n FROM facts WHERE object_type IS NOT NULL GROUP BY 1) i ON o.e = i.e ORDER BY degree DESC, entity LIMIT 50)"""


@query("SELECT * FROM tc", CONNECTED)
def top_connected(spark, d):
    return G.top_connected(V.facts(spark, d), 50)


@query("SELECT subject, object, predicate, count(*) AS weight FROM facts WHERE object_type IS NOT NULL AND subject IN (SELECT entity FROM tc) AND object IN (SELECT entity FROM tc) GROUP BY ALL", CONNECTED)
def induced_edges(spark, d):
    f = V.facts(spark, d)
    return G.induced_edges(f, G.top_connected(f, 50))


@query("SELECT fact_id FROM facts WHERE object_type IS NOT NULL AND subject IN (SELECT e FROM n) AND object IN (SELECT e FROM n)", V.FACTS + ",\nn AS (SELECT e FROM (SELECT subject AS e, fact_id FROM facts WHERE object_type IS NOT NULL UNION ALL SELECT object, fact_id FROM facts WHERE object_type IS NOT NULL) GROUP BY e ORDER BY max(fact_id) DESC, e LIMIT 40)")
def graph_view(spark, d):
    return G.graph_view(V.facts(spark, d), 40).select("fact_id")


@query("SELECT i.entity, coalesce(o.n, 0) AS n_out, coalesce(o.t, 0) AS n_targets, coalesce(x.n, 0) AS n_in, coalesce(a.t, '') AS attributes FROM (SELECT DISTINCT p_name AS entity FROM part) i LEFT JOIN (SELECT subject, count(*) AS n, count(DISTINCT object) AS t FROM facts WHERE object_type IS NOT NULL GROUP BY 1) o ON o.subject = i.entity LEFT JOIN (SELECT object, count(*) AS n FROM facts WHERE object_type IS NOT NULL GROUP BY 1) x ON x.object = i.entity LEFT JOIN (SELECT subject, array_to_string(list_sort(list(DISTINCT predicate || '=' || object)), ',') AS t FROM facts WHERE object_type IS NULL GROUP BY 1) a ON a.subject = i.entity", V.FACTS)
def entity_detail(spark, d):
    ids = V.table(spark, d, "part").select(F.col("p_name").alias("entity")).distinct()
    return G.entity_detail(ids, V.facts(spark, d)).select("entity", "n_out", "n_targets", "n_in", F.coalesce(F.array_join("attributes", ","), F.lit("")).alias("attributes"))


@query("SELECT c.subject AS start, s.object AS end, sum(c.n * s.n)::BIGINT AS paths, count(*) AS middles FROM (SELECT object AS subject, subject AS m, count(*) AS n FROM facts WHERE predicate = 'supplies' GROUP BY ALL) c JOIN (SELECT subject AS m, object, count(*) AS n FROM facts WHERE predicate = 'located_in' GROUP BY ALL) s USING (m) GROUP BY ALL", V.FACTS)
def multi_hop(spark, d):
    f = V.facts(spark, d)
    turned = f.where("predicate = 'supplies'").select(*(F.col({"subject": "object", "object": "subject"}.get(c, c)).alias(c) for c in f.columns))
    return G.multi_hop(turned.unionByName(f.where("predicate = 'located_in'")), F.col("predicate") == "supplies", F.col("predicate") == "located_in")


PATHS = "RECURSIVE " + V.FACTS.strip() + f""",
sf AS (SELECT *, {KEY.format('subject_type', 'subject')} AS s, {KEY.format('object_type', 'object')} AS o FROM facts WHERE object_type IS NOT NULL),
st AS (SELECT *, {STATE.format('s')} AS s_state, {STATE.format('o')} AS o_state FROM sf),
e AS (SELECT s AS src, s_state AS src_state, fact_id, predicate, confidence, o_state AS dst_state, o AS dst FROM st UNION ALL SELECT o, o_state, fact_id, predicate, confidence, s_state, s FROM st),
p AS (SELECT key AS start, key AS at_, [key] AS seen, []::VARCHAR[] AS path, []::VARCHAR[] AS states, 1.0::DOUBLE AS sure, 0 AS n FROM (SELECT DISTINCT {KEY.format("'customer'", 'c_name')} AS key FROM customer WHERE c_custkey % 1000 = 0)
  UNION ALL SELECT start, dst, list_append(seen, dst), list_append(path, fact_id), list_concat(states, [src_state, dst_state]), sure * confidence, n + 1 FROM p JOIN e ON src = at_ AND predicate = ['ordered', 'supplies', 'located_in', 'located_in'][n + 1] AND NOT list_contains(seen, dst) WHERE n < 4)"""


@query("SELECT start, at_ AS end, n::INT AS n_facts, array_to_string(path, '>') AS path, array_to_string(states, '>') AS states, round(sure, 6)::DOUBLE AS confidence FROM p WHERE n >= 2", PATHS)
def entity_paths(spark, d):
    """From every 1,000th customer over ordered products and their suppliers to places, and on to other suppliers there."""
    starts = V.table(spark, d, "customer").where("c_custkey % 1000 = 0").select(G.canonical_key(F.lit("customer"), "c_name").alias("key"))
    found = G.entity_paths(G.state_edges(V.facts(spark, d)), starts, [["ordered"], ["supplies"], ["located_in"], ["located_in"]])
    return found.withColumns({"path": F.array_join("path", ">"), "states": F.array_join("states", ">")})


FS = V.FACTS + f""",
gq AS (SELECT p_partkey AS query_id, unnest(list_distinct(list_filter(list_concat(regexp_split_to_array(lower(trim(p_name, ' ')), '[\\p{{P}}\\p{{S}}\\s]+'), [{TIGHT.format('p_name')}]), lambda x: length(x) BETWEEN 2 AND 48))) AS term FROM part WHERE p_partkey % 100 = 0),
ft AS MATERIALIZED (SELECT fact_id, doc_id, confidence, lower(concat_ws(' ', subject, predicate, object)) AS hay FROM facts),
fi AS (SELECT fact_id, min(doc_id) AS doc_id, max(confidence) AS confidence FROM ft GROUP BY fact_id),
fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY token_score DESC, fact_id DESC)::INT AS rank FROM (SELECT query_id, fact_id, count(DISTINCT term) AS token_score FROM ft JOIN gq ON contains(hay, term) GROUP BY ALL)) JOIN fi USING (fact_id) WHERE rank <= 20)"""  # fmt: skip


def _fact_hits(spark, d):
    q = V.table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    f = V.facts(spark, d)
    return cut(G.fact_search(q, f, 20)), f


@query("SELECT query_id, fact_id, token_score, rank FROM fs", FS)
def fact_search(spark, d):
    return _fact_hits(spark, d)[0]


@query("SELECT query_id, 'fact:' || fact_id AS item_id, doc_id, round(4.2 + 0.35 * least(3, token_score) + greatest(0, confidence), 6)::DOUBLE AS score FROM fs", FS)
def graph_hits(spark, d):
    return G.graph_hits(*_fact_hits(spark, d))


BATCHES = V.CHUNKS + ",\nba AS (SELECT doc_id, batch, sha256(doc_id || ':' || batch) AS batch_key, sha256(string_agg(content, chr(10) ORDER BY chunk_no)) AS input_hash, count(*) AS n FROM (SELECT doc_id, chunk_no, content, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1) // 6 AS batch FROM chunks) GROUP BY ALL)"


@query("SELECT doc_id, batch, batch_key, input_hash, n FROM ba", BATCHES)
def batch_chunks(spark, d):
    return G.batch_chunks(V.chunks(spark, d), 6).select("doc_id", "batch", "batch_key", "input_hash", F.size("items").cast("long").alias("n"))


@query("SELECT doc_id, batch FROM ba WHERE NOT (batch = 0 AND doc_id % 2 = 0)", BATCHES)
def resume_batches(spark, d):
    b = G.batch_chunks(V.chunks(spark, d), 6)
    ledger = b.where("batch = 0").select("batch_key", F.when(F.col("doc_id") % 3 == 0, F.col("input_hash")).otherwise(F.col("input_hash")).alias("input_hash"), F.when(F.col("doc_id") % 2 == 0, "success").otherwise("failed").alias("status"))
    return G.resume_batches(b, ledger)[0].select("doc_id", "batch")


@query("SELECT doc_id FROM docs WHERE status = 'success' AND doc_id % 4 NOT IN (0, 1)", V.DOCS)
def missing_builds(spark, d):
    df = V.docs(spark, d)
    builds = df.where("doc_id % 4 < 2").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "success").otherwise("queued").alias("status")).unionByName(df.where("doc_id % 4 = 2").select("doc_id", F.lit("failed").alias("status")))
    return G.missing_builds(df, builds).select("doc_id")


@query("SELECT event_id FROM events WHERE NOT (user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150))")
def clear_ledger(spark, d):
    e = V.table(spark, d, "events").withColumn("depth", F.lit(1)).withColumn("scope", F.lit("all")).withColumnRenamed("user_id", "doc_id")
    return G.clear_ledger(e, e.where("event_type = 'error' and value > 150")).select("event_id")


def _scope_leg(table: str, base: float, fields) -> str:
    held = lambda name: f"contains(lower(coalesce({name}, '')), raw)"
    names = ", ".join(f"{name}" for name, _ in fields)
    return f"""SELECT scope_id, doc_id, {base} + {" + ".join(f"CASE WHEN {held(n)} THEN {w} ELSE 0 END" for n, w in fields)} AS s
  FROM (SELECT *, {WORDS.format(f"concat_ws(' ', {names})")} AS have FROM {table}) JOIN sc ON {" OR ".join(held(n) for n, _ in fields)} OR (len(terms) > 0 AND list_has_all(have, terms))"""


SCOPES = PREP + f""",
sc AS (SELECT query_id AS scope_id, raw, terms FROM prep WHERE raw <> ''),
sl AS ({_scope_leg('docs', *G.SCOPE_DOCUMENT)} UNION ALL {_scope_leg('chunks', *G.SCOPE_CHUNK)} UNION ALL {_scope_leg('units', *G.SCOPE_UNIT)}),
sr AS (SELECT scope_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT scope_id, doc_id, max(s)::DOUBLE AS score FROM sl GROUP BY ALL)) WHERE rank <= 20)"""  # fmt: skip


def _recall(spark, d):
    scopes = V.queries_in(spark, d).select(F.col("query_id").alias("scope_id"), F.col("query").alias("scope"))
    return G.scope_recall(scopes, V.docs(spark, d), V.chunks(spark, d), V.units(spark, d), 20)


@query("SELECT * FROM sr", SCOPES)
def scope_recall(spark, d):
    return _recall(spark, d)


@query("SELECT doc_id, scopes, score, place FROM (SELECT *, row_number() OVER (ORDER BY scopes DESC, score DESC, doc_id)::INT AS place FROM (SELECT doc_id, count(DISTINCT scope_id) AS scopes, sum(score)::DOUBLE AS score FROM sr WHERE doc_id % 5 <> 0 GROUP BY doc_id)) WHERE place <= 40", SCOPES)
def enrichment_queue(spark, d):
    return G.enrichment_queue(_recall(spark, d), V.docs(spark, d).where("doc_id % 5 = 0"), 40)


KINDS = {8: "system", 9: "requirement", 10: "process", 11: "concept"}
STRUCTURE = V.CHUNKS + f""",
sc AS (SELECT doc_id, chunk_no, d.title AS doc_title, c.title, list_filter({WORDS.format('content')}, lambda w: length(w) >= 9 AND regexp_matches(w, '[aeo]$')) AS words, {WORDS.format('content')} AS every FROM chunks c JOIN docs d USING (doc_id)),
sm AS (SELECT doc_id, chunk_no, name, CASE length(name) {" ".join(f"WHEN {n} THEN '{kind}'" for n, kind in KINDS.items())} ELSE 'policy' END AS kind, doc_title, title, words FROM (SELECT *, unnest(list_filter(every, lambda w: length(w) BETWEEN 8 AND 30)) AS name FROM sc)),
se AS (SELECT *, kind || ':' || name AS key, contains(lower(title), name) AS in_title, len(list_filter(words, lambda w: contains(w, name) OR contains(name, w))) > 0 AS in_words FROM sm),
an AS (SELECT DISTINCT name, key FROM se WHERE kind IN ('system', 'policy')),
cand AS (SELECT doc_id, chunk_no, 2 AS rank, name, key FROM sc JOIN an ON contains(lower(doc_title), name) UNION ALL SELECT doc_id, chunk_no, 1, name, key FROM sc JOIN an ON contains(lower(title), name) UNION ALL SELECT doc_id, chunk_no, 0, name, key FROM se WHERE kind IN ('system', 'policy') AND in_words),
anchor AS (SELECT doc_id, chunk_no, key AS anchor, name AS anchor_name FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY rank DESC, length(name) DESC, key) = 1),
own AS (SELECT * FROM se JOIN anchor USING (doc_id, chunk_no) WHERE key <> anchor AND (in_title OR in_words) AND NOT regexp_full_match(title, '[0-9]+(\\.[0-9]+)?')),
target AS (SELECT * FROM own WHERE NOT regexp_full_match(name, '[0-9]+') QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY in_title DESC, in_words DESC, length(name) DESC, key) <= 6),
pair AS (SELECT t.*, p.key AS parent, p.name AS parent_name FROM target t LEFT JOIN own p ON p.doc_id = t.doc_id AND p.chunk_no = t.chunk_no AND p.key <> t.key AND (p.kind <> 'concept' OR p.in_title)
  QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.chunk_no, t.key ORDER BY p.in_title DESC, length(p.name) DESC, p.key) = 1),
ev AS (SELECT doc_id, chunk_no, anchor, coalesce(parent, anchor) AS subject, coalesce(parent_name, anchor_name) AS subject_name, key AS target, CASE WHEN parent IS NULL THEN 'anchor_child' ELSE 'local_parent_child' END AS role, CASE WHEN in_title THEN 0.72 ELSE 0.68 END::DOUBLE AS confidence FROM pair WHERE parent IS NOT NULL OR in_title),
sf AS (SELECT subject, target, max(role) AS role, max(confidence) AS confidence, count(*) AS evidence, length(min(subject_name)) AS n FROM ev GROUP BY ALL),
stay AS (SELECT a.* FROM sf a LEFT JOIN sf b ON a.subject = b.target AND a.target = b.subject AND a.role = 'local_parent_child' AND b.role = 'local_parent_child' WHERE b.subject IS NULL OR a.n < b.n OR (a.n = b.n AND a.subject < b.subject)),
above AS (SELECT anchor, subject, count(*) AS evidence FROM (SELECT DISTINCT anchor, subject, doc_id, chunk_no FROM ev SEMI JOIN stay USING (subject, target) WHERE role = 'local_parent_child' AND anchor <> subject) GROUP BY ALL)"""


@query("SELECT subject, target AS object, role, confidence, evidence FROM stay UNION ALL SELECT anchor, subject, 'anchor_parent', 0.74::DOUBLE, evidence FROM above", STRUCTURE)
def enhance_structure(spark, d):
    """Every word of eight letters or more is an entity of its chunk, of a type by its length; words from nine letters on that end in
    a vowel are keywords."""
    words = T.search_terms("content")
    c = V.chunks(spark, d).join(V.docs(spark, d).select("doc_id", F.col("title").alias("doc_title")), "doc_id")
    c = c.select("doc_id", "chunk_no", "doc_title", "title", F.filter(words, lambda w: (F.length(w) >= 9) & w.rlike("[aeo]$")).alias("keywords"), words.alias("words"))
    kind = F.lit("policy")
    for n, name in KINDS.items():
        kind = F.when(F.length("name") == n, name).otherwise(kind)
    m = c.select("doc_id", "chunk_no", F.explode("words").alias("name")).where(F.length("name").between(8, 30)).withColumn("entity_type", kind)
    return X.enhance_structure(c, m.withColumn("key", F.concat_ws(":", "entity_type", "name")))


@query("SELECT DISTINCT doc_id, title AS section, left(content, 5) AS entity_id FROM chunks WHERE trim(title, ' ') <> ''", V.CHUNKS)
def link_sections(spark, d):
    m = V.chunks(spark, d).select("doc_id", "chunk_no", F.substring("content", 1, 5).alias("entity_id"))
    return G.link_sections(m, V.chunks(spark, d)).select("doc_id", "section", "entity_id")


# Topics --------------------------------------------------------------------------------------------------------------

TS = "TIMESTAMP '2024-01-01' + to_hours(({} % 720)::INT)"


def _timed(df, key: str = "doc_id"):
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + (F.col(key) % 720) * 3600))


@query("SELECT facet, value, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM (SELECT facet, value, count(*) AS n FROM (SELECT 'subject' AS facet, lower(trim(subject, ' ')) AS value FROM units UNION ALL SELECT 'indicator', lower(trim(indicator, ' ')) FROM units) WHERE value <> '' GROUP BY ALL HAVING count(*) >= 2)) WHERE rank <= 20", V.UNITS)
def facet_seeds(spark, d):
    return O.facet_seeds(V.units(spark, d).select("subject", "indicator"), ["subject", "indicator"], 20)


SEEDS = V.CHUNKS + """,
seeds AS (SELECT topic, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, lower(substr(list_filter(list_transform(regexp_split_to_array(content, '[，。；：、,.;:!?！？\\n|]+'), lambda x: trim(x, ' ')), lambda x: length(x) >= 4)[1], 1, 18)) AS topic FROM chunks) WHERE topic IS NOT NULL GROUP BY topic ORDER BY n DESC, topic LIMIT 40)"""


@query("SELECT * FROM seeds", SEEDS)
def chunk_topic_seeds(spark, d):
    return O.chunk_topic_seeds(V.chunks(spark, d), 40)


@query(f"SELECT topic FROM (SELECT topic, {TIGHT.format('topic')} AS n, row_number() OVER (PARTITION BY {TIGHT.format('topic')} ORDER BY topic) AS k FROM seeds) WHERE k = 1 AND n <> '' AND NOT contains(n, 'with') AND NOT contains('with', n)", SEEDS)
def dedupe_seeds(spark, d):
    return O.dedupe_seeds(O.chunk_topic_seeds(V.chunks(spark, d), 40), ["with"]).select("topic")


CANDIDATES = SEEDS + """,
dh AS (SELECT topic, doc_id, chunk_no, title FROM seeds JOIN chunks ON contains(lower(content), lower(topic))),
dt AS (SELECT topic, count(*) AS signals, count(DISTINCT doc_id) AS documents FROM dh GROUP BY topic HAVING count(*) >= 6),
de AS (SELECT topic, array_to_string(list_sort(list(e)), ',') AS evidence FROM (SELECT topic, 'chunk:' || doc_id || ':' || chunk_no AS e, row_number() OVER (PARTITION BY topic ORDER BY doc_id, chunk_no) AS k FROM dh) WHERE k <= 5 GROUP BY topic),
dk AS (SELECT topic, array_to_string(list(word ORDER BY k), ',') AS keywords FROM (SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) AS k FROM (SELECT topic, word, count(*) AS n FROM (SELECT topic, unnest(""" + WORDS.format("title") + """) AS word FROM dh) WHERE length(word) >= 2 GROUP BY ALL)) WHERE k <= 5 GROUP BY topic)"""


@query("SELECT topic, signals, documents, evidence, keywords FROM dt JOIN de USING (topic) LEFT JOIN dk USING (topic)", CANDIDATES)
def discover_candidates(spark, d):
    c = V.chunks(spark, d)
    df = O.discover_candidates(O.chunk_topic_seeds(c, 40), c)
    return df.select("topic", "signals", "documents", F.array_join("evidence", ",").alias("evidence"), F.array_join("keywords", ",").alias("keywords"))


@query(f"SELECT kind, id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, kind, id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, id) AS k FROM (SELECT 'document' AS kind, doc_id::VARCHAR AS id, {TS.format('doc_id')} AS ts FROM docs UNION ALL SELECT 'unit', doc_id || ':' || chunk_no, {TS.format('doc_id')} FROM units UNION ALL SELECT 'chunk', doc_id || ':' || chunk_no, {TS.format('doc_id')} FROM chunks) WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') WHERE k <= 50) WHERE r <= 50", V.UNITS)
def recent_signals(spark, d):
    import datetime

    return O.recent_signals(_timed(V.docs(spark, d)), _timed(V.units(spark, d)), _timed(V.chunks(spark, d)), datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20), 50).select("kind", "id")


_PASS = "SELECT domain_id, {} AS pass_no, '{}' AS pass, {} AS weight, unnest(range(len(t))) AS pos, unnest(t) AS term FROM (SELECT domain_id, list_transform(list_filter(range(1, len(t0) + 1), lambda i: NOT list_contains(t0[1:i - 1], t0[i])), lambda i: t0[i])[1:8] AS t FROM (SELECT domain_id, {} AS t0 FROM dom))"
PLAN = PREP + """,
dom AS (SELECT query_id AS domain_id, query AS name, list_filter(string_split(query, ' '), lambda x: length(x) >= 3)[1:2] AS dimensions, list_filter(list_transform(regexp_split_to_array(query, '[^\\p{L}]+'), lambda x: x || ' '), lambda x: length(x) >= 5) AS keywords FROM queries_in),
pl AS (SELECT domain_id, pass, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, term ORDER BY pass_no, pos) AS k FROM (""" + " UNION ALL ".join(_PASS.format(i, *x) for i, x in enumerate((
    ("core", 3.0, "[lower(trim(name, ' '))]"),
    ("dimension", 2.4, "list_transform(dimensions, lambda x: lower(trim(x, ' ')))"),
    ("expanded", 2.0, "list_transform(keywords, lambda x: lower(trim(x, ' ')))"),
    ("recall", 1.2, "list_filter(list_transform(regexp_split_to_array(lower(name), '和|与|及|的|、|,|，|/|\\s+'), lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 2 AND 64)"),
))) + ") WHERE term <> '') WHERE k = 1)"


def _domains(spark, d):
    """A domain a query: its first two words of three letters are dimensions, its words of four letters keywords."""
    q = V.queries_in(spark, d).select(F.col("query_id").alias("domain_id"), F.col("query").alias("name"))
    q = q.withColumn("dimensions", F.slice(F.filter(F.split("name", " "), lambda x: F.length(x) >= 3), 1, 2))
    return q.withColumn("keywords", F.filter(F.transform(F.split("name", r"[^\p{L}]+"), lambda x: F.concat(x, F.lit(" "))), lambda x: F.length(x) >= 5))


@query("SELECT domain_id, pass, term, weight::DOUBLE AS weight FROM pl", PLAN)
def retrieval_plan(spark, d):
    return O.retrieval_plan(_domains(spark, d))


RECALL = PLAN + """,
it AS MATERIALIZED (SELECT doc_id, doc_id || ':' || chunk_no AS item_id, title, content, lower(title) AS lt, lower(content) AS lc FROM chunks),
ri AS (SELECT domain_id, item_id, round(sum(s), 6)::DOUBLE AS score, count(*) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, term ORDER BY s DESC, item_id) AS k FROM (SELECT domain_id, term, item_id, weight * (CASE WHEN contains(lt, term) THEN 2.0 ELSE 0 END + CASE WHEN contains(lc, term) THEN 1.0 ELSE 0 END) AS s FROM it JOIN pl ON contains(lc, term) OR contains(lt, term))) WHERE k <= 6 GROUP BY ALL)"""  # fmt: skip


def _items(spark, d):
    return V.chunks(spark, d).withColumn("item_id", F.concat_ws(":", "doc_id", "chunk_no"))


def _recalled(spark, d):
    return O.recall_items(O.retrieval_plan(_domains(spark, d)), _items(spark, d), (("title", 2.0), ("content", 1.0)), 6)


def _evidence(spark, d, *columns):
    """The recalled rows with columns of their items: few rows, read several times, so they are found once."""
    return cut(small(cut(_recalled(spark, d))).join(_items(spark, d).select("item_id", *columns), "item_id"))


@query("SELECT * FROM ri", RECALL)
def recall_chunks(spark, d):
    return _recalled(spark, d)


@query("SELECT domain_id, item_id, least(4.0, greatest(0.35, score))::DOUBLE AS score FROM ri", RECALL)
def clamp_score(spark, d):
    return _recalled(spark, d).select("domain_id", "item_id", O.clamp_score(F.col("score")).alias("score"))


@query("SELECT domain_id, 'document:' || split_part(item_id, ':', 1) AS item_id, round(max(score) * 0.95, 5)::DOUBLE AS score FROM ri GROUP BY ALL", RECALL)
def documents_from_evidence(spark, d):
    return O.documents_from_evidence(cut(_recalled(spark, d)), _items(spark, d)).withColumn("score", F.round("score", 5))


@query("SELECT domain_id, item_id, score, 'recall' AS origin FROM ri WHERE NOT ends_with(item_id, '0') UNION ALL SELECT domain_id, item_id, round(score * 0.85 + 1e-9, 6), 'backfill' FROM (SELECT r.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY r.domain_id ORDER BY score DESC, item_id) AS k FROM ri r LEFT JOIN (SELECT domain_id, count(*) AS n FROM ri WHERE NOT ends_with(item_id, '0') GROUP BY 1) h ON h.domain_id = r.domain_id WHERE ends_with(item_id, '0')) WHERE n + k <= 12", RECALL)
def coverage_backfill(spark, d):
    r = cut(_recalled(spark, d))
    zero = F.col("item_id").endswith("0")
    return O.coverage_backfill(r.where(~zero), r.where(zero), 12)


@query()
def select_evidence_mmr(spark, d):
    return O.select_evidence_mmr(_evidence(spark, d, "doc_id", F.col("content").alias("text")), 20, 3, 6)


@query("SELECT domain_id, item_id, score FROM ri JOIN it USING (item_id) WHERE NOT (contains(lc, 'then') OR contains(lc, 'our the'))", RECALL)
def filter_excluded(spark, d):
    items = _evidence(spark, d, "content")
    ex = _domains(spark, d).select("domain_id", F.explode(F.array(F.lit("Then "), F.lit("our the"))).alias("phrase"))
    return O.filter_excluded(items, ex, ["content"]).select("domain_id", "item_id", "score")


@query("SELECT domain_id, item_id, dimension, points::INT AS points FROM (SELECT domain_id, item_id, dimension, p AS points, row_number() OVER (PARTITION BY domain_id, item_id ORDER BY p DESC, dimension) AS k FROM (SELECT domain_id, item_id, unnest(['then', 'with', 'und']) AS dimension, contains(lc, unnest(['then', 'with', 'und']))::INT * 4 + contains(lc, unnest(['the', 'of', 'der']))::INT * 2 AS p FROM ri JOIN it USING (item_id)) WHERE p > 0) WHERE k = 1", RECALL)
def group_evidence(spark, d):
    items = _evidence(spark, d, F.col("content").alias("text"))
    dims = _domains(spark, d).select("domain_id", F.explode(F.array(*(F.struct(F.lit(a).alias("dimension"), F.array(F.lit(b)).alias("keywords")) for a, b in (("then", "the"), ("with", "of"), ("und", "der"))))).alias("x")).select("domain_id", "x.*")
    return O.group_evidence(items, dims, 10_000).select("domain_id", "item_id", "dimension", F.col("points").cast("int").alias("points"))


@query("SELECT domain_id, count(*) AS items, '# ' || domain_id || chr(10) || chr(10) || '## then' || chr(10) || chr(10) || '- ' || array_to_string(list_sort(list(item_id)), chr(10) || '- ') AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY p DESC, item_id) AS k FROM (SELECT domain_id, item_id, contains(lc, 'then')::INT * 4 + contains(lc, 'the')::INT * 2 + contains(lc, 'of')::INT * 2 AS p FROM ri JOIN it USING (item_id)) WHERE p > 0) WHERE k <= 20 GROUP BY domain_id", RECALL)
def evidence_pack(spark, d):
    items = _evidence(spark, d, F.col("content").alias("text"))
    dims = _domains(spark, d).select("domain_id", F.lit("then").alias("dimension"), F.array(F.lit("the"), F.lit("of")).alias("keywords"))
    return O.evidence_pack(O.group_evidence(items, dims)).select("domain_id", "items", "markdown")


@query("SELECT 'chunk:' || doc_id || ':' || chunk_no AS ref, doc_id, content AS text FROM chunks WHERE chunk_no = 0 UNION ALL SELECT 'document:' || doc_id, doc_id, title FROM docs", V.CHUNKS)
def resolve_refs(spark, d):
    refs = V.docs(spark, d).select(F.concat(F.lit("document:"), "doc_id").alias("ref")).union(V.docs(spark, d).select(F.concat(F.lit("chunk:"), "doc_id", F.lit(":0"))))
    return O.resolve_refs(refs, V.docs(spark, d), V.chunks(spark, d)).select("ref", "doc_id", "text")


@query(f"SELECT topic_id, fact_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY hits DESC, fact_id, subject, object, predicate)::INT AS rank FROM (SELECT p_partkey AS topic_id, fact_id, subject, object, predicate, count(DISTINCT term) AS hits FROM (SELECT fact_id, subject, object, predicate, lower(concat_ws(' ', subject, object)) AS hay FROM facts) JOIN (SELECT p_partkey, unnest(list_filter({WORDS.format('p_name')}, lambda x: length(x) >= 2)) AS term FROM part WHERE p_partkey % 100 = 0) ON contains(hay, term) GROUP BY ALL)) WHERE rank <= 80", V.FACTS)
def topic_subgraph(spark, d):
    t = V.table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("topic"))
    return O.topic_subgraph(V.facts(spark, d), t).select("topic_id", "fact_id", "rank")


def _cards(spark, d):
    o = V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(F.col("l_partkey").cast("string"))).alias("refs"))
    return o.groupBy(F.col("l_orderkey").alias("card_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("claim_id"), "refs"))).alias("claims"))


@query("SELECT l_partkey::VARCHAR AS ref, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS cards, count(*) AS claims FROM lineitem GROUP BY 1")
def evidence_bindings(spark, d):
    return O.evidence_bindings(_cards(spark, d)).select("ref", F.array_join("cards", ",").alias("cards"), "claims")


@query("SELECT l_orderkey AS card_id, array_to_string(list_sort(list(c)), ';') AS claims FROM (SELECT l_orderkey, l_returnflag || ':' || array_to_string(list_sort(list(l_partkey::VARCHAR))[1:20], ',') AS c FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY l_orderkey, l_returnflag) GROUP BY 1")
def prune_structured_content(spark, d):
    valid = V.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("ref"))
    text = F.transform("claims", lambda c: F.concat(c["claim_id"], F.lit(":"), F.array_join(c["refs"], ",")))
    return O.prune_cards(_cards(spark, d), valid).select("card_id", F.array_join(F.array_sort(text), ";").alias("claims"))


PACKS = "pk AS (SELECT o_orderkey AS pack_id, o_custkey AS domain_id, count(l_orderkey) AS items, count(l_orderkey) AS claims, count(*) FILTER (WHERE l_discount < 0.08) AS bound, count(*) FILTER (WHERE l_tax > 0.07) AS warnings, max(l_linenumber) AS depth, count(DISTINCT l_suppkey) AS roots, any_value(o_orderdate) AS created, any_value(o_orderstatus) AS st FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


def _packs(spark, d):
    o, li = V.table(spark, d, "orders"), V.table(spark, d, "lineitem")
    df = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy(F.col("o_orderkey").alias("pack_id"), F.col("o_custkey").alias("domain_id"))
    return df.agg(F.count("*").alias("items"), F.count("*").alias("claims"), F.count_if(F.col("l_discount") < 0.08).alias("bound"), F.count_if(F.col("l_tax") > 0.07).alias("warnings"), F.max("l_linenumber").alias("depth"), F.countDistinct("l_suppkey").alias("roots"), F.max("o_orderdate").alias("created"), F.max("o_orderstatus").alias("st"))


@query("SELECT pack_id, round(bound / claims, 6)::DOUBLE AS bound_ratio, CASE WHEN bound / claims < 0.6 THEN 'failed' WHEN warnings = 0 AND bound / claims >= 0.9 AND depth <= 3 AND roots <= 10 THEN 'ready' ELSE 'review' END AS pack_status FROM pk", PACKS)
def validate_pack(spark, d):
    return O.validate_pack(_packs(spark, d)).select("pack_id", "bound_ratio", "pack_status")


@query("SELECT domain_id, pack_id FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created DESC, pack_id) AS k FROM (SELECT *, min(r) OVER (PARTITION BY domain_id) AS least_ FROM (SELECT *, CASE st WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS r FROM pk) WHERE r IS NOT NULL) WHERE r = least_) WHERE k <= 2", PACKS)
def packs_for_agent(spark, d):
    status = F.when(F.col("st") == "F", "accepted").when(F.col("st") == "O", "ready").when(F.col("st") == "P", "reference")
    return O.packs_for_agent(_packs(spark, d).withColumn("status", status), 2).select("domain_id", "pack_id")


# Plug-ins ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, answered FROM (SELECT doc_id, true AS answered FROM docs)", V.DOCS)
def model_batch(spark, d):
    df = P.prompts(V.docs(spark, d).select("doc_id", "title", "preview"), (("title", "title", 80), ("text", "preview", 400)), "Summarise")
    return P.parse_model_json(P.model_batch(df, "prompt")).select("doc_id", (F.col("json_status") == "ok").alias("answered"))


@query(f"SELECT entity_id, {NORM.format('name')} AS name FROM entities", V.ENTITIES)
def normalize_nfkc(spark, d):
    return V.entities(spark, d).select("entity_id", P.nfkc("name").alias("name"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def parse_model_json(spark, d):
    broken = F.concat(F.lit("Answer: "), F.regexp_replace("props", r"\}\s*$", ""))
    df = P.parse_model_json(V.table(spark, d, "events").select("event_id", broken.alias("answer")))
    return df.select("event_id", F.get_json_object("json", "$.k").cast("int").alias("k"))


@query("SELECT event_id AS id, CASE WHEN value >= 50 THEN 'm' WHEN user_id % 2 = 0 THEN 'h' END AS value, CASE WHEN value >= 50 THEN 'model' WHEN user_id % 2 = 0 THEN 'fallback' ELSE 'needs_approval' END AS status FROM events")
def fallback_when_failed(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.when(F.col("value") >= 50, "m").alias("value"))
    approvals = e.select("source").distinct().withColumn("approved", F.col("source") % 2 == 0)
    return P.fallback_when_failed(e, e.select("id", F.lit("h").alias("value")), approvals, ["id"]).select("id", "value", "status")


@query("SELECT e.name, e.entity_type, documents, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM (SELECT name, entity_type, count(DISTINCT doc_id) AS documents FROM entities WHERE contains(lower(name), 'supplier') GROUP BY ALL) e LEFT JOIN (SELECT subject, subject_type, count(*) AS n FROM facts GROUP BY ALL) o ON o.subject = e.name AND o.subject_type = e.entity_type LEFT JOIN (SELECT object, object_type, count(*) AS n FROM facts GROUP BY ALL) i ON i.object = e.name AND i.object_type = e.entity_type", V.FACTS + "," + V.ENTITIES)
def entity_list(spark, d):
    return G.entity_list(V.entities(spark, d), V.facts(spark, d), "supplier")


@query("SELECT 'chunk:' || a.doc_id || ':' || a.chunk_no AS ref, b.doc_id, b.chunk_no, b.chunk_no - a.chunk_no AS offset_, b.content AS text FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND b.chunk_no BETWEEN a.chunk_no - 1 AND a.chunk_no + 1", V.CHUNKS)
def ref_context(spark, d):
    c = V.chunks(spark, d)
    return O.ref_context(c.select(F.concat_ws(":", F.lit("chunk"), "doc_id", "chunk_no").alias("ref")), c).withColumnRenamed("offset", "offset_")


FILL_LEAST = 30


@query(f"SELECT domain_id, item_id, 0.25::DOUBLE AS score FROM (SELECT s.domain_id, w.item_id, n, row_number() OVER (PARTITION BY s.domain_id ORDER BY place) AS k FROM (SELECT domain_id, count(*) AS n FROM ri GROUP BY domain_id HAVING count(*) < {FILL_LEAST}) s, (SELECT item_id, row_number() OVER (ORDER BY split_part(item_id, ':', 1)::BIGINT DESC, item_id) AS place FROM it) w WHERE place <= {2 * FILL_LEAST} AND NOT EXISTS (FROM ri WHERE ri.domain_id = s.domain_id AND ri.item_id = w.item_id)) WHERE n + k <= {FILL_LEAST}", RECALL)
def recent_fill(spark, d):
    have = cut(_recalled(spark, d))
    items = _items(spark, d).select("item_id", F.lit("chunk").alias("kind"), F.col("doc_id").alias("ts"))
    return O.recent_fill(have, have, items, FILL_LEAST)
