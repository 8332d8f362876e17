"""Knowledge graph: keys, binding, building, fusion, states, transitions, governance and views.

Node and edge types are tables. Facts: (fact_id, subject, subject_type, predicate, object, object_type, fact_kind, doc_id,
confidence, valid_from, valid_to). Entities: (entity_id, name, entity_type, doc_id).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.lineage import cut
from .contain import held_terms, term_sets
from .retrieval import small


def norm(c) -> Column:
    """Trimmed, lower case, without white space. NFKC folding is ``functions.plugins.nfkc``, for text that needs it."""
    return F.regexp_replace(F.lower(F.trim(T.text(c))), r"\s+", "")


def canonical_key(entity_type, name) -> Column:
    return F.concat(norm(entity_type), F.lit(":"), norm(name))


def fusion_key(entity_type, name, suffixes: Sequence[str] = L.COMPANY_SUFFIXES) -> Column:
    """The name without punctuation, and for organisations without company suffixes."""
    bare, kind = norm(name), norm(entity_type)
    company = bare
    for s in suffixes:
        company = F.replace(company, F.lit(s), F.lit(""))
    return F.regexp_replace(F.when(kind.contains("org") | kind.contains("机构"), company).otherwise(bare), T.PREDICATE_MARKS, "")


def state_key(key, valid_from, valid_to) -> Column:
    a, b = norm(valid_from), norm(valid_to)
    return F.when((a == "") & (b == ""), F.concat(key, F.lit(":state:default"))).otherwise(F.concat(key, F.lit(":state:"), a, F.lit(":"), b))


def description_key(key, doc_id, mention_id, definition) -> Column:
    """Prefix and a digest of the definition; empty without one."""
    d = norm(definition)
    return F.when(d == "", "").otherwise(F.concat(key, F.lit(":description:"), norm(doc_id), F.lit(":"), norm(mention_id), F.lit(":"), F.substring(F.sha2(d, 256), 1, 12)))


def normalize_fact_kind(kind, table: Mapping[str, Sequence[str]] = L.FACT_KINDS) -> Column:
    k = F.replace(norm(kind), F.lit("-"), F.lit("_"))
    out = F.lit("relation_fact")
    for name, aliases in table.items():
        out = F.when(k.isin(*aliases), name).otherwise(out)
    return out


def fact_key(subject_state, fact_kind, predicate, obj, valid_from, valid_to) -> Column:
    return F.concat_ws(":", subject_state, F.lit("fact"), fact_kind, norm(predicate), norm(obj), norm(valid_from), norm(valid_to))


def is_evolution(relation, statement, blocked=L.EVOLUTION_BLOCKED, signals=L.EVOLUTION_SIGNALS) -> Column:
    r, t = norm(relation), norm(F.concat_ws(" ", T.text(relation), T.text(statement)))
    generic = r.isin("", "relatedto", "关系")
    return ~r.isin(*blocked) & (t != "") & (T.any_of(r, signals) | (generic & T.any_of(t, signals)))


def fusion_type_group(entity_type, groups=L.FUSION_GROUPS) -> Column:
    k = norm(entity_type)
    return F.coalesce(F.nullif(T.first_cue(k, groups, ""), F.lit("")), F.nullif(k, F.lit("")), F.lit("other"))


def normalize_entity_types(entities: DataFrame, templates: DataFrame) -> DataFrame:
    """Replace entity types by template codes: templates(code, label, aliases) are looked up by code, label or alias; the
    first template (by code) wins; unknown types stay."""
    names = templates.select("code", F.explode(F.concat(F.array(F.col("code"), F.col("label")), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    names = names.groupBy(norm("n").alias("__n")).agg(F.min("code").alias("__code"))
    return entities.join(names, norm("entity_type") == F.col("__n"), "left").withColumn("entity_type", F.coalesce("__code", "entity_type")).drop("__n", "__code")


def triples_to_facts(answers: DataFrame) -> DataFrame:
    """answers(chunk_id, triples, attributes): arrays of (subject, predicate, object) and (entity, key, value) in one shape."""
    a = answers.select("chunk_id", F.explode("triples").alias("t")).select("chunk_id", "t.subject", "t.predicate", "t.object", F.lit("relation").alias("fact_kind"))
    b = answers.select("chunk_id", F.explode("attributes").alias("t")).select("chunk_id", F.col("t.entity").alias("subject"), F.col("t.key").alias("predicate"), F.col("t.value").alias("object"), F.lit("attribute").alias("fact_kind"))
    return a.unionByName(b)


def bind_facts(facts: DataFrame, entities: DataFrame, attribute_words: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts with subject_id and object_id, entities with the missing ones, counts of dropped facts by reason).

    Ends are found by normalised name, the smallest id first; an unknown subject, and an unknown object of a relation,
    become entities of their own (confidence .45). A relation to a value-like object or with an attribute word is an
    attribute. Self loops and repeats are dropped.
    """
    names = entities.groupBy(norm("name").alias("n")).agg(F.min("entity_id").alias("id"))
    kind = normalize_fact_kind("fact_kind")
    attribute = (kind == "attribute_fact") | ((kind == "relation_fact") & (T.is_value_like("object") | T.any_of(T.predicate_norm("predicate"), attribute_words)))
    f = facts.withColumn("kind", F.when(attribute, "attribute_fact").otherwise(kind)).withColumn("sn", norm("subject")).withColumn("on", F.when(attribute, None).otherwise(norm("object")))
    f = f.join(names.select(F.col("n").alias("sn"), F.col("id").alias("sid")), "sn", "left").join(names.select(F.col("n").alias("on"), F.col("id").alias("oid")), "on", "left")
    made = lambda n: F.concat(F.lit("made:"), n)
    f = f.withColumn("subject_id", F.coalesce("sid", made(F.col("sn")))).withColumn("object_id", F.coalesce("oid", F.when(F.col("on") != "", made(F.col("on")))))
    reason = F.when(F.col("sn") == "", "no_subject").when((F.col("kind") != "attribute_fact") & F.col("object_id").isNull(), "no_object").when(F.col("subject_id") == F.col("object_id"), "self_loop")
    repeat = F.row_number().over(Window.partitionBy("subject_id", "kind", norm("predicate"), norm("object")).orderBy("fact_id"))
    f = f.withColumn("reason", reason).withColumn("reason", F.when(F.col("reason").isNull() & (repeat > 1), "repeat").otherwise(F.col("reason")))
    kept = f.where("reason is null").select("fact_id", "subject_id", "predicate", "object", "object_id", F.col("kind").alias("fact_kind"), *(c for c in ("doc_id", "confidence") if c in facts.columns))
    ends = kept.select(F.col("subject_id").alias("entity_id"), F.lit(None).cast("string").alias("name")).union(kept.where("object_id is not null").select("object_id", F.lit(None).cast("string")))
    new = ends.where(F.col("entity_id").startswith("made:")).select("entity_id").distinct().withColumn("name", F.expr("substring(entity_id, 6)"))
    new = new.select("entity_id", "name", F.lit("other").alias("entity_type"))
    grown = entities.select(F.col("entity_id").cast("string").alias("entity_id"), "name", "entity_type").unionByName(new)
    return kept, grown, f.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def mark_entity_roles(entities: DataFrame, facts: DataFrame) -> DataFrame:
    ends = facts.select(F.col("subject_id").alias("entity_id")).union(facts.where("object_id is not null").select("object_id")).distinct().withColumn("__end", F.lit(True))
    return entities.join(ends, "entity_id", "left").withColumn("role", F.when(F.col("__end"), "fact_endpoint").otherwise("context_mention")).drop("__end")


def dedupe_facts(facts: DataFrame, key: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    return facts.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def build_graph(entities: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """Node and edge tables; equal keys merge, the last write (by doc_id) wins."""
    e = entities.withColumn("key", canonical_key("entity_type", "name"))
    entity = e.groupBy("key").agg(F.max_by("name", "doc_id").alias("name"), F.max_by("entity_type", "doc_id").alias("entity_type"), F.max(fusion_key("entity_type", "name")).alias("fusion_key"), F.countDistinct("doc_id").alias("documents"))
    mention = e.select("key", "doc_id").distinct()
    f = facts.withColumn("subject_key", canonical_key("subject_type", "subject")).withColumn("object_key", F.when(F.col("object_type").isNotNull(), canonical_key("object_type", "object")))
    f = f.withColumn("subject_state", state_key(F.col("subject_key"), "valid_from", "valid_to")).withColumn("object_state", F.when(F.col("object_key").isNotNull(), state_key(F.col("object_key"), "valid_from", "valid_to")))
    f = f.withColumn("fact_key", fact_key(F.col("subject_state"), normalize_fact_kind("fact_kind"), "predicate", F.coalesce("object_state", "object"), "valid_from", "valid_to"))
    fact = f.groupBy("fact_key").agg(F.max_by(F.struct("subject_state", "object_state", "predicate", "object", "fact_kind", "confidence"), F.struct("doc_id", "fact_id")).alias("x"), F.count("*").alias("evidence")).select("fact_key", "x.*", "evidence")
    default = entity.select("key", state_key(F.col("key"), F.lit(""), F.lit("")).alias("state_key"))
    seen = f.select(F.col("subject_key").alias("key"), F.col("subject_state").alias("state_key")).union(f.where("object_key is not null").select("object_key", "object_state"))
    state = default.union(seen).distinct().withColumn("is_default", F.col("state_key").endswith(":state:default"))
    return {"entity": entity, "state": state, "fact": fact, "mention": mention, "evidence": f.select("fact_key", "doc_id").distinct()}


def replace_document_graph(graph: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The graph without some documents: evidence and mentions first, then facts without evidence, states without use and
    entities without mention."""
    evidence, mention = (graph[n].join(gone.select("doc_id").distinct(), "doc_id", "left_anti") for n in ("evidence", "mention"))
    fact = graph["fact"].join(evidence.select("fact_key"), "fact_key", "left_semi")
    entity = graph["entity"].join(mention.select("key"), "key", "left_semi")
    used = fact.select(F.col("subject_state").alias("state_key")).union(fact.where("object_state is not null").select("object_state")).distinct()
    state = graph["state"].join(used.withColumn("u", F.lit(True)), "state_key", "left").where("is_default or u").drop("u").join(entity.select("key"), "key", "left_semi")
    return {"entity": entity, "state": state, "fact": fact, "mention": mention, "evidence": evidence}


def supersede_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions of earlier build runs of a document are marked."""
    last = mentions.groupBy("doc_id").agg(F.max("run_id").alias("last_run"))
    return mentions.join(last, "doc_id").withColumn("superseded", F.col("run_id") < F.col("last_run")).drop("last_run")


def fusion_features(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Relations (both ends), mentions (documents) and attributes of each canonical entity."""
    e = entities.withColumn("key", canonical_key("entity_type", "name"))
    base = e.groupBy("key").agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type"), F.countDistinct("doc_id").alias("mentions"))
    f = facts.withColumn("s", canonical_key("subject_type", "subject")).withColumn("o", F.when(F.col("object_type").isNotNull(), canonical_key("object_type", "object")))
    ends = f.where("o is not null").select(F.col("s").alias("key")).union(f.where("o is not null").select("o"))
    relations = ends.groupBy("key").agg(F.count("*").alias("relations"))
    attributes = f.where("o is null").groupBy(F.col("s").alias("key")).agg(F.count("*").alias("attributes"))
    return base.join(relations, "key", "left").join(attributes, "key", "left").fillna(0, ["relations", "attributes"])


def fusion_eligible(key: str = "fusion_key", entity_type: str = "entity_type") -> Column:
    """Names that may merge: at least two characters, no numbers or dates, no technical types, and enough evidence."""
    k, t = norm(key), norm(entity_type)
    weak = t.isin("other", "concept", "resource") & (F.col("relations") == 0)
    shape = (F.length(k) >= 2) & ~k.rlike("^[0-9]+$") & ~k.rlike("^[0-9]+[年月日时分秒]+$") & ~t.isin("time", "metricvalue", "document", "entitystate") & ~T.is_value_like(key)
    return shape & ~(weak & (F.col("attributes") > 0)) & ~((t == "resource") & (F.col("relations") == 0) & (F.col("mentions") <= 1)) & ~(weak & (F.col("mentions") <= 1) & (F.length(k) <= 8))


def fuse_exact(features: DataFrame, most: int = 50) -> DataFrame:
    """Clusters of entities of one type group with the same fusion key, 2 to ``most`` members: (key, canonical, role, size)."""
    df = features.withColumn("fusion_key", fusion_key("entity_type", "name")).where(fusion_eligible()).withColumn("grp", fusion_type_group("entity_type"))
    best = df.groupBy("grp", "fusion_key").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("relations")).alias("r"), (-F.col("mentions")).alias("m"), (-F.length("name")).alias("l"), "key")).alias("x")).where(F.col("size").between(2, most))
    return df.join(best, ["grp", "fusion_key"]).select("key", F.col("x.key").alias("canonical"), F.when(F.col("x.key") == F.col("key"), "canonical").otherwise("member").alias("role"), "size", F.lit(0.85).alias("confidence"))


def deletions(c: Column, most: int = 2) -> Column:
    """The text and all texts with up to ``most`` (1 or 2) characters left out: equal for texts within that edit distance."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    first = F.array_union(F.array(c), one(c))
    return first if most == 1 else F.array_distinct(F.flatten(F.transform(first, lambda x: F.array_union(F.array(x), one(x)))))


def near_name_pairs(features: DataFrame) -> DataFrame:
    """features(key, name, entity_type) to (a, b, distance) of names in one type group: distance 1 from 5 characters on, or 2 from 8 on with three equal first
    and two equal last characters. Candidates share a deletion of their names; every such pair is found.

    Only the first three and last two characters of long names must agree, so these pairs are blocked by them too; equal
    names meet once, through their smallest key.
    """
    df = features.withColumn("n", fusion_key("entity_type", "name")).where(F.length("n") >= 5).withColumn("grp", fusion_type_group("entity_type"))
    df = df.groupBy("grp", "n").agg(F.min("key").alias("key"))
    one = df.select("grp", "n", "key", F.explode(deletions(F.col("n"), 1)).alias("d"))
    two = df.where(F.length("n") >= 8).withColumn("core", F.expr("substring(n, 4, length(n) - 5)")).select("grp", "n", "key", F.explode(deletions(F.col("core"), 2)).alias("c"))
    two = two.select("grp", "n", "key", F.concat_ws("\u0001", F.substring("n", 1, 3), "c", F.expr("substring(n, length(n) - 1, 2)")).alias("d"))
    rows = one.unionByName(two)
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.d") == F.col("b.d")) & (F.col("a.key") < F.col("b.key"))).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), F.col("a.n").alias("x"), F.col("b.n").alias("y")).distinct()
    d = F.levenshtein("x", "y", 2)
    long_ = (F.least(F.length("x"), F.length("y")) >= 8) & (F.substring("x", 1, 3) == F.substring("y", 1, 3)) & (F.expr("right(x, 2)") == F.expr("right(y, 2)"))
    return pairs.withColumn("distance", d).where((F.col("distance") == 1) | ((F.col("distance") == 2) & long_)).select("a", "b", "distance")


def near_groups(pairs: DataFrame) -> DataFrame:
    """Greedy groups over pairs: in a seeded order of the keys, a free key is a seed and takes its free neighbours: (key, seed,
    role, confidence).

    The order is that of the keys' hashes, so that rounds of joins settle it in about log(n) steps (in key order, chains of
    numbered names would need one round a link); a key belongs to its first seed in that order.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("k"))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("key", "other").distinct().withColumn("before", order("other") < order("key"))
    before = cut(both.where("before").select("key", "other"))
    keys = both.select("key").distinct().withColumn("state", F.lit("open"))
    while keys.where("state = 'open'").limit(1).count():
        s = before.join(keys.withColumnsRenamed({"key": "other", "state": "s"}), "other")
        seen = s.groupBy("key").agg(F.bool_or(F.col("s") == "seed").alias("taken"), F.bool_or(F.col("s") == "open").alias("waits"))
        now = F.when(F.col("state") != "open", F.col("state")).when(F.coalesce("taken", F.lit(False)), "member").when(F.coalesce("waits", F.lit(False)), "open").otherwise("seed")
        keys = cut(keys.join(seen, "key", "left").select("key", now.alias("state")))
    seeds = keys.where("state = 'seed'").select(F.col("key").alias("other"))
    own = before.join(seeds, "other").groupBy("key").agg(F.min(order("other")).alias("x")).select("key", F.col("x.k").alias("seed"))
    seed = F.when(F.col("state") == "seed", F.col("key")).otherwise(F.col("seed"))
    return keys.join(own, "key", "left").select("key", seed.alias("seed"), F.when(F.col("state") == "seed", "canonical").otherwise("member").alias("role"), F.lit(0.78).alias("confidence"))


PHASE = r"(一期|二期|三期|四期|phase\s*[1-4])"
VERSION = r"(?i)\b(v\d+(?:\.\d+)*)"
STATUS = (("planned", ("计划", "拟", "planned")), ("running", ("在建", "运行", "running")), ("done", ("完成", "验收", "done")), ("closed", ("废止", "停用", "closed")))


def derive_states(facts: DataFrame) -> DataFrame:
    """State signals in the text of facts: phase .82, time range .78, version .76, status .70: (fact_id, subject, signal, label, confidence)."""
    t = F.lower(F.concat_ws(" ", "predicate", "object"))
    year = F.concat_ws("-", F.col("valid_from"), F.col("valid_to"))
    found = F.array(
        F.struct(F.lit("phase").alias("signal"), F.regexp_extract(t, PHASE, 1).alias("label"), F.lit(0.82).alias("confidence")),
        F.struct(F.lit("time").alias("signal"), year.alias("label"), F.lit(0.78).alias("confidence")),
        F.struct(F.lit("version").alias("signal"), F.regexp_extract(t, VERSION, 1).alias("label"), F.lit(0.76).alias("confidence")),
        F.struct(F.lit("status").alias("signal"), T.first_cue(t, STATUS, "").alias("label"), F.lit(0.70).alias("confidence")),
    )
    return facts.select("fact_id", "subject", "subject_type", F.explode(found).alias("s")).where("s.label != ''").select("fact_id", "subject", "subject_type", "s.*")


def fuse_states(states: DataFrame) -> DataFrame:
    """States of an entity with one signature (signal and label) fuse; the longest definition represents them."""
    return states.groupBy("entity_key", "signal", "label").agg(F.max_by("definition", F.struct(F.length("definition"), "definition")).alias("definition"), F.count("*").alias("states"))


def state_signature(entity_name, state_text, valid_from, valid_to, phases=L.STATE_PHASES, fillers=L.STATE_FILLERS, empty=L.STATE_EMPTY) -> Column:
    """What makes two states of an entity the same: a phase, else the time range, else default for texts that say nothing,
    else the head of the text without the entity's name and filler words."""
    low = F.lower(T.text(state_text))
    bare = F.replace(low, F.lower(T.text(entity_name)), F.lit(""))
    for word in fillers:
        bare = F.replace(bare, F.lit(word), F.lit(""))
    bare, a, b = F.trim(bare), T.text(valid_from), T.text(valid_to)
    rest = F.when((a != "") | (b != ""), F.concat(F.lit("time:"), a, F.lit("|"), b)).when((bare == "") | bare.isin(*empty), "default").otherwise(F.concat(F.lit("text:"), F.substring(bare, 1, 48)))
    found = T.first_cue(low, phases, "")
    return F.when(found != "", found).otherwise(rest)


def fuse_states_by_text(states: DataFrame) -> DataFrame:
    """(entity_key, signature, definition, states): states of an entity with one signature; the longest definition stands for them.

    states(entity_key, entity_name, state_name, definition, valid_from, valid_to).
    """
    text = F.concat_ws(" ", T.text("state_name"), T.text("definition"))
    df = states.withColumn("signature", state_signature("entity_name", text, "valid_from", "valid_to"))
    return df.groupBy("entity_key", "signature").agg(F.max_by("definition", F.struct(F.length("definition"), "definition")).alias("definition"), F.count("*").alias("states"))


def phase_relations(transitions: DataFrame, states: DataFrame, facts: DataFrame) -> DataFrame:
    """(state_key, fact_id): states of a phase, version or status that a transition leads to become subjects of its fact.

    transitions(fact_id, to_state), states(state_key, signal), facts(fact_id, fact_kind).
    """
    kind = normalize_fact_kind("fact_kind")
    anchors = states.where(F.col("signal").isin("phase", "version", "status")).select(F.col("state_key").alias("to_state"))
    told = facts.where(kind.isin("relation_fact", "transition_fact")).select("fact_id")
    return transitions.join(anchors, "to_state", "left_semi").join(told, "fact_id", "left_semi").select(F.col("to_state").alias("state_key"), "fact_id").distinct()


def inferred_transitions(states: DataFrame) -> DataFrame:
    """(entity_key, signal, from_label, to_label, confidence): consecutive distinct states of an entity in the order of their dates."""
    w = Window.partitionBy("entity_key", "signal").orderBy("since", "label")
    df = states.groupBy("entity_key", "signal", "label").agg(F.min("since").alias("since")).withColumn("to_label", F.lead("label").over(w)).where("to_label is not null")
    return df.select("entity_key", "signal", F.col("label").alias("from_label"), "to_label", F.lit(0.72).alias("confidence"))


def explicit_transitions(facts: DataFrame) -> DataFrame:
    kind = normalize_fact_kind("fact_kind")
    return facts.where((kind == "transition_fact") | is_evolution("predicate", "object")).select("fact_id", "subject", "predicate", "object", F.greatest(F.lit(0.8), F.col("confidence")).alias("confidence"))


def attribute_key(predicate, value, rules=L.ATTRIBUTE_KEYS) -> Column:
    """struct(key, confidence) by value shape and predicate words; null if no rule fits."""
    kind = "struct<key:string,confidence:double>"

    def choose(x: Column) -> Column:
        shape, p = x["shape"], x["p"]
        out = F.lit(None).cast(kind)
        for shapes, words, key, sure in reversed(rules):
            hit = shape.isin(*shapes.split()) & (T.any_of(p, words) if words else F.lit(True))
            out = F.when(hit, F.struct(F.lit(key).alias("key"), F.lit(sure).alias("confidence"))).otherwise(out)
        blocked = (p == "") | (shape.isin("money", "date") & (x["role"] == "generic_action"))
        return F.when(~blocked, out)

    # Shape, predicate and role are computed once a row; spelled out in every rule they would outgrow generated code.
    return T.let(F.struct(T.value_shape(value).alias("shape"), T.predicate_norm(predicate).alias("p"), T.predicate_role(predicate).alias("role")), choose)


def attribute_clusters(facts: DataFrame, samples: int = 5) -> DataFrame:
    """Attribute facts by subject type, predicate, value shape and statement pattern, with counts and sorted samples."""
    f = facts.withColumn("p", T.predicate_norm("predicate")).withColumn("shape", T.value_shape("object")).withColumn("pattern", T.statement_pattern("object"))
    some = lambda c, n: F.slice(F.array_sort(F.collect_set(c)), 1, n)
    # A set of samples is bounded by taking the smallest few per partial group first.
    first = f.groupBy("subject_type", "p", "shape", "pattern", "object").agg(F.count("*").alias("n"), F.min("subject").alias("s"))
    rank = F.row_number().over(Window.partitionBy("subject_type", "p", "shape", "pattern").orderBy("object"))
    top = first.withColumn("k", rank).where(F.col("k") <= samples).groupBy("subject_type", "p", "shape", "pattern").agg(some("object", samples).alias("samples"))
    size = f.groupBy("subject_type", "p", "shape", "pattern").agg(F.count("*").alias("facts"), F.countDistinct("subject").alias("entities"), F.countDistinct("doc_id").alias("documents"))
    return size.join(top, ["subject_type", "p", "shape", "pattern"]).withColumnRenamed("p", "predicate")


def recommend_cluster(clusters: DataFrame, known_attributes: Sequence[str] = ()) -> DataFrame:
    """keep (known attribute), attribute (scalar shapes or a generic key), relation (action words), discard (empty or long
    text); confidence grows with the logarithm of the size by up to .10."""
    clusters = clusters.withColumn("__key", attribute_key("predicate", F.get("samples", F.lit(0))))
    key = F.col("__key")
    action = T.predicate_role("predicate") == "generic_action"
    choice = F.when(F.col("predicate").isin(*known_attributes), "keep").when(F.col("shape").isin("empty", "long_text"), "discard").when(key.isNotNull() | F.col("shape").isin("money", "percent", "date", "scalar"), "attribute").when(action, "relation").otherwise("keep")
    base = F.when(choice == "attribute", F.coalesce(key["confidence"], F.lit(0.8))).when(choice == "relation", 0.72).when(choice == "discard", 0.7).otherwise(0.6)
    return clusters.withColumn("recommendation", choice).withColumn("attribute_key", key["key"]).withColumn("confidence", F.round(F.least(F.lit(0.99), base + F.least(F.lit(0.10), F.log10(F.col("facts")) / 20)), 6)).drop("__key")


def name_value_mismatch(names: Column, values: Column) -> Column:
    """Whether in every pair of samples neither text holds the other."""
    return F.forall(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: ~p["n"].contains(p["v"]) & ~p["v"].contains(p["n"]))


def review_clusters(clusters: DataFrame, least: float = 0.8, size: int = 3) -> DataFrame:
    return clusters.withColumn("needs_review", (F.col("confidence") < least) & (F.col("facts") >= size))


def apply_cluster_decisions(facts: DataFrame, decisions: DataFrame, min_conf: float, dry_run: bool = False) -> DataFrame:
    """decisions(subject_type, predicate, recommendation, confidence) promote or reject facts; a dry run returns the changes."""
    d = decisions.where(F.col("confidence") >= min_conf).select("subject_type", F.col("predicate").alias("__p"), "recommendation")
    df = facts.withColumn("__p", T.predicate_norm("predicate")).join(d, ["subject_type", "__p"], "left").drop("__p")
    kind = F.when(F.col("recommendation") == "attribute", "attribute_fact").when(F.col("recommendation") == "relation", "relation_fact").when(F.col("recommendation") == "discard", "rejected").otherwise(normalize_fact_kind("fact_kind"))
    df = df.withColumn("new_kind", kind)
    return df.where(F.col("new_kind") != normalize_fact_kind("fact_kind")) if dry_run else df.withColumn("fact_kind", F.col("new_kind")).drop("new_kind", "recommendation")


def govern_attributes(facts: DataFrame, hints: DataFrame) -> DataFrame:
    """Ordered rules on attribute facts, the first that fits decides: empty values are demoted, long texts are demoted, hints
    (entity_type, attribute) match by predicate, scalar shapes match, action words become relation candidates, the rest are
    candidates. Adds reason and governed_key."""
    h = hints.select(norm("entity_type").alias("__t"), T.predicate_norm("attribute").alias("__a"), F.col("attribute")).groupBy("__t", "__a").agg(F.min("attribute").alias("__hint"))
    df = facts.withColumn("__t", norm("subject_type")).withColumn("__a", T.predicate_norm("predicate")).join(h, ["__t", "__a"], "left")
    df = df.withColumn("__shape", T.value_shape("object")).withColumn("__key", attribute_key("predicate", "object"))
    shape, key = F.col("__shape"), F.col("__key")
    reason = F.when(shape == "empty", "demote_empty").when(shape == "long_text", "demote_long").when(F.col("__hint").isNotNull(), "template").when(key.isNotNull(), "generic_key").when(shape.isin("money", "percent", "date", "scalar"), "scalar").when(T.predicate_role("predicate") == "generic_action", "relation_candidate").otherwise("attribute_candidate")
    return df.withColumn("reason", reason).withColumn("governed_key", F.when(F.col("reason").isin("template", "generic_key", "scalar"), F.coalesce("__hint", key["key"], F.col("__a")))).drop("__t", "__a", "__hint", "__shape", "__key")


def link_sections(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    return mentions.join(chunks.where(F.trim("title") != "").select("doc_id", "chunk_no", F.col("title").alias("section")), ["doc_id", "chunk_no"]).select("entity_id", "doc_id", "section").distinct()


def graph_stats(graph: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in graph.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out.unionByName(graph["state"].where("is_default").agg(F.count("*").alias("n")).select(F.lit("default_state").alias("part"), "n"))


def unlinked_entities(graph: Mapping[str, DataFrame]) -> DataFrame:
    """(key, name, entity_type, mentioned): entities whose default state is in no fact."""
    fact = graph["fact"]
    ends = fact.select(F.col("subject_state").alias("state_key")).union(fact.where("object_state is not null").select("object_state")).distinct()
    alone = graph["state"].where("is_default").join(ends, "state_key", "left_anti").select("key").distinct()
    seen = graph["mention"].select("key").distinct().withColumn("mentioned", F.lit(True))
    return graph["entity"].select("key", "name", "entity_type").join(alone, "key", "left_semi").join(seen, "key", "left").fillna(False, ["mentioned"])


def is_suspicious_name(name: str = "name") -> Column:
    return (F.length(T.text(name)) <= 1) | T.is_value_like(name)


def graph_quality(graph: Mapping[str, DataFrame], *, eligible: DataFrame, clusters: DataFrame, transitions: DataFrame, structure: DataFrame, numbers: str = L.STRUCTURE_NUMBERS, fields: Sequence[str] = L.STRUCTURE_FIELDS) -> DataFrame:
    """One row of fifteen counts and the relations per entity.

    eligible(key), clusters (a row each), transitions (a row each), structure(statement): facts of structure enhancement.
    """
    count = lambda df, **cols: df.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in cols.items()))
    every, kind = F.count("*"), normalize_fact_kind("fact_kind")
    parts = [
        count(graph["entity"], entities=every, suspicious_names=F.count_if(is_suspicious_name())),
        count(eligible, fusion_eligible=every),
        count(graph["fact"], facts=every, relation_facts=F.count_if(kind == "relation_fact"), attribute_facts=F.count_if(kind == "attribute_fact"), attribute_candidates=F.count_if(norm("fact_kind") == "attribute_candidate")),
        count(clusters, entity_clusters=every),
        count(graph["state"], real_states=F.count_if(~F.col("is_default"))),
        count(transitions, transition_edges=every),
        count(unlinked_entities(graph), unlinked_entities=every, isolated_entities=F.count_if(~F.col("mentioned"))),
        count(structure, structure_facts=every, numeric_structure_facts=F.count_if(F.col("statement").rlike(numbers)), field_structure_facts=F.count_if(T.any_of(T.text("statement"), fields))),
    ]
    df = parts[0]
    for part in parts[1:]:
        df = df.crossJoin(part)  # one row each
    return df.withColumn("relation_per_entity", F.when(F.col("entities") == 0, 0.0).otherwise(F.round(F.col("relation_facts") / F.col("entities"), 2)))


def quality_risks(quality: DataFrame) -> DataFrame:
    """(risk, stage, n): the risks that a quality row shows, or ``none``."""
    c = F.col
    found = F.array(
        *(F.when(yes, F.struct(F.lit(risk).alias("risk"), F.lit(stage).alias("stage"), n.cast("long").alias("n"))) for risk, stage, n, yes in (
            ("attribute_backlog", "attribute_governance", c("attribute_candidates"), c("attribute_candidates") > 0),
            ("structure_noise", "structure_enhancement", c("numeric_structure_facts") + c("field_structure_facts"), c("numeric_structure_facts") + c("field_structure_facts") > 0),
            ("suspicious_names", "entity_extraction", c("suspicious_names"), c("suspicious_names") > 0),
            ("isolated_entities", "entity_extraction", c("isolated_entities"), c("isolated_entities") > 0),
            ("unlinked_entities", "relation_enrichment", c("unlinked_entities"), c("unlinked_entities") > 0),
            ("sparse_relations", "relation_enrichment", F.round(c("relation_per_entity") * 100), (c("relation_per_entity") < 0.5) & (c("entities") > 0)),
        ))
    )
    found = F.filter(found, lambda x: x.isNotNull())
    none = F.array(F.struct(F.lit("none").alias("risk"), F.lit("ok").alias("stage"), F.lit(0).cast("long").alias("n")))
    return quality.select(F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("x")).select("x.*")


def quality_samples(graph: Mapping[str, DataFrame], structure: DataFrame, *, most: int = 30, most_types: int = 20, numbers: str = L.STRUCTURE_NUMBERS, fields: Sequence[str] = L.STRUCTURE_FIELDS) -> DataFrame:
    """(sample, item, detail): the first ``most`` unlinked entities, suspicious names and noisy structure facts, and the most
    frequent kinds of relations. structure(statement, confidence)."""
    kind = normalize_fact_kind("fact_kind")
    rows = lambda df, sample, item, detail, n, *order: df.orderBy(*order).limit(n).select(F.lit(sample).alias("sample"), item.cast("string").alias("item"), detail.cast("string").alias("detail"))
    noisy = structure.where(F.col("statement").rlike(numbers) | T.any_of(T.text("statement"), fields))
    relations = graph["fact"].where(kind == "relation_fact").groupBy("predicate").agg(F.count("*").alias("n"))
    out = rows(unlinked_entities(graph), "unlinked", F.col("name"), F.col("entity_type"), most, "name", "key")
    out = out.unionByName(rows(graph["entity"].where(is_suspicious_name()), "suspicious", F.col("name"), F.col("entity_type"), most, "name", "key"))
    out = out.unionByName(rows(noisy, "structure", F.col("statement"), F.col("confidence"), most, "confidence", "statement"))
    return out.unionByName(rows(relations, "relations", F.col("predicate"), F.col("n"), most_types, F.desc("n"), "predicate"))


def relation_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("predicate", normalize_fact_kind("fact_kind").alias("fact_kind")).agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


def graph_view(facts: DataFrame, n: int) -> DataFrame:
    """Newest relation facts until n entities are used: entities in the order in which facts show them, then the facts among them."""
    f = facts.where("object_type is not null")
    ends = f.select("fact_id", F.col("subject").alias("e")).union(f.select("fact_id", "object"))
    newest = ends.groupBy("e").agg(F.max("fact_id").alias("at")).orderBy(F.desc("at"), "e").limit(n).select("e")
    return f.join(newest.withColumnRenamed("e", "subject"), "subject", "left_semi").join(newest.withColumnRenamed("e", "object"), "object", "left_semi")


def top_connected(facts: DataFrame, n: int) -> DataFrame:
    """The n entities with most relations, with in- and out-degree."""
    f = facts.where("object_type is not null")
    out, in_ = f.groupBy(F.col("subject").alias("entity")).agg(F.count("*").alias("out_degree")), f.groupBy(F.col("object").alias("entity")).agg(F.count("*").alias("in_degree"))
    df = out.join(in_, "entity", "full_outer").fillna(0, ["out_degree", "in_degree"]).withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    return df.orderBy(F.desc("degree"), "entity").limit(n)


def induced_edges(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    f = facts.where("object_type is not null").groupBy("subject", "object", "predicate").agg(F.count("*").alias("weight"))
    return f.join(nodes.select(F.col("entity").alias("subject")), "subject", "left_semi").join(nodes.select(F.col("entity").alias("object")), "object", "left_semi")


def entity_list(entities: DataFrame, facts: DataFrame, search: str | None = None) -> DataFrame:
    """Entities whose name holds a text, with their documents and the facts out of and into them."""
    df = entities.where(F.lower("name").contains(search.lower())) if search else entities
    df = df.groupBy("name", "entity_type").agg(F.countDistinct("doc_id").alias("documents"))
    for end, n in (("subject", "n_out"), ("object", "n_in")):
        df = df.join(facts.groupBy(F.col(end).alias("name"), F.col(f"{end}_type").alias("entity_type")).agg(F.count("*").alias(n)), ["name", "entity_type"], "left")
    return df.fillna(0, ["n_out", "n_in"])


def entity_detail(ids: DataFrame, facts: DataFrame, sources: int = 8, attributes: int = 200) -> DataFrame:
    """For a batch of entities: the first ``attributes`` formal attributes, connections out and in with their counts, and the
    first ``sources`` documents."""
    a = facts.join(ids, facts["subject"] == ids["entity"]).where("object_type is null").select("entity", F.concat_ws("=", "predicate", "object").alias("a")).distinct()
    a = a.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy("a"))).where(F.col("k") <= attributes).groupBy("entity").agg(F.array_sort(F.collect_list("a")).alias("attributes"))
    out = facts.join(ids, facts["subject"] == ids["entity"]).where("object_type is not null").groupBy("entity").agg(F.count("*").alias("n_out"), F.countDistinct("object").alias("n_targets"))
    in_ = facts.join(ids, facts["object"] == ids["entity"]).where("object_type is not null").groupBy("entity").agg(F.count("*").alias("n_in"))
    ranked = facts.join(ids, facts["subject"] == ids["entity"]).select("entity", "doc_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy("doc_id"))).where(F.col("k") <= sources)
    src = ranked.groupBy("entity").agg(F.array_sort(F.collect_list("doc_id")).alias("sources"))
    df = ids
    for part in (a, out, in_, src):
        df = df.join(part, "entity", "left")
    return df.fillna(0, ["n_out", "n_targets", "n_in"])


def multi_hop(facts: DataFrame, first: Column, second: Column) -> DataFrame:
    """(start, middle, end, paths): facts that meet in a middle entity; the sides are filtered, then counted before they join."""
    a = facts.where(first).groupBy(F.col("subject").alias("start"), F.col("object").alias("middle")).agg(F.count("*").alias("n1"))
    b = facts.where(second).groupBy(F.col("subject").alias("middle"), F.col("object").alias("end")).agg(F.count("*").alias("n2"))
    return a.join(b, "middle").groupBy("start", "end").agg(F.sum(F.col("n1") * F.col("n2")).alias("paths"), F.count("*").alias("middles"))


HUB_ROWS = 1 << 16


def state_edges(facts: DataFrame) -> DataFrame:
    """(src, src_state, fact_id, predicate, confidence, dst_state, dst): each fact between two entities, from both ends, as a step
    from an entity over one of its states and the fact to a state of the other entity."""
    f = facts.where("object_type is not null").select(canonical_key("subject_type", "subject").alias("s"), canonical_key("object_type", "object").alias("o"), "fact_id", "predicate", "confidence", "valid_from", "valid_to")
    f = f.select("s", state_key(F.col("s"), "valid_from", "valid_to").alias("s_state"), "fact_id", "predicate", "confidence", state_key(F.col("o"), "valid_from", "valid_to").alias("o_state"), "o")
    names = ["src", "src_state", "fact_id", "predicate", "confidence", "dst_state", "dst"]
    return f.toDF(*names).unionByName(f.select("o", "o_state", "fact_id", "predicate", "confidence", "s_state", "s").toDF(*names))


def entity_paths(edges: DataFrame, starts: DataFrame, steps: Sequence[Sequence[str] | None], *, least: int = 2, same_state: bool = False) -> DataFrame:
    """(start, end, n_facts, path, states, confidence) of all paths of ``least`` to len(steps) facts from starts(key).

    Each step takes the facts of the given predicates (all for None). An entity comes once in a path. With ``same_state`` a
    step leaves by the state that the last one reached, else by any state of the entity. path: the fact ids; states: those
    passed. The frontier grows by a join a step; an entity with many facts is dealt over lanes, and only the frontier's rows at
    such a hub are copied to its lanes.
    """
    wanted = None if any(s is None for s in steps) else sorted({p for s in steps for p in s})
    used = edges if wanted is None else edges.where(F.col("predicate").isin(wanted))
    degree = used.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > HUB_ROWS)
    hubs = small(cut(degree.select("src", F.ceil(F.col("n") / HUB_ROWS).cast("int").alias("lanes"))))
    dealt = lambda df, key: df.join(hubs.withColumnRenamed("src", key), key, "left").withColumn("lanes", F.coalesce("lanes", F.lit(1)))
    rows = cut(dealt(used, "src").withColumn("lane", F.pmod(F.xxhash64("fact_id", "dst"), F.col("lanes")).cast("int")).drop("lanes"))
    none = F.array().cast("array<string>")
    front = starts.select(F.col("key").alias("start"), F.col("key").alias("at"), F.lit(None).cast("string").alias("state"), F.array("key").alias("seen"), none.alias("path"), none.alias("states"), F.lit(1.0).alias("sure")).distinct()
    found = None
    for n, step in enumerate(steps, 1):
        now = dealt(front, "at").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("lanes")
        own = rows if step is None else rows.where(F.col("predicate").isin(list(step)))
        df = now.join(own, (F.col("at") == F.col("src")) & (now["lane"] == own["lane"])).where(~F.array_contains("seen", F.col("dst")))
        if same_state:
            df = df.where(F.col("state").isNull() | (F.col("state") == F.col("src_state")))
        grown = lambda c, *more: F.concat(c, F.array(*more)).alias(c)
        front = df.select("start", F.col("dst").alias("at"), F.col("dst_state").alias("state"), grown("seen", "dst"), grown("path", "fact_id"), grown("states", "src_state", "dst_state"), (F.col("sure") * F.col("confidence")).alias("sure"))
        if n < len(steps):  # the last paths, the most by far, are only put out
            front = cut(front)
        if n >= least:
            part = front.select("start", F.col("at").alias("end"), F.lit(n).alias("n_facts"), "path", "states", F.round("sure", 6).alias("confidence"))
            found = part if found is None else found.unionByName(part)
    return found


def fact_search(queries: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """(query_id, fact_id, token_score, rank): facts whose texts hold tokens of the query; most tokens, then newest, first.

    Facts that hold the same tokens score alike for any query, so only the newest k of them are weighed; queries with the same
    tokens are ranked once.
    """
    q = queries.select("query_id", F.explode(T.graph_tokens("query")).alias("term"))
    asked = cut(q.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("asked")))
    newest = F.row_number().over(Window.partitionBy("terms").orderBy(F.desc("fact_id")))
    held = term_sets(facts, ["fact_id"], F.lower(F.concat_ws(" ", "subject", "predicate", "object")), q, whole=True).withColumn("k", newest).where(F.col("k") <= k)
    sets = asked.select("asked").distinct().withColumn("term", F.explode("asked"))
    df = held.select("fact_id", F.explode("terms").alias("term")).join(small(sets), "term").groupBy("asked", "fact_id").agg(F.count("*").alias("token_score"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("token_score"), F.desc("fact_id")))
    best = df.withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.join(best, "asked").select("query_id", "fact_id", "token_score", "rank")


def graph_hits(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts as search rows: 4.2 + .35 * min(3, tokens) + max(0, confidence); rows that share a fact's id count as one."""
    one = facts.join(small(found.select("fact_id").distinct()), "fact_id", "left_semi").groupBy("fact_id").agg(F.min("doc_id").alias("doc_id"), F.max("confidence").alias("confidence"))
    df = found.join(one, "fact_id")
    return df.select("query_id", F.concat(F.lit("fact:"), "fact_id").alias("item_id"), "doc_id", F.round(4.2 + 0.35 * F.least(F.lit(3), "token_score") + F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0))), 6).alias("score"))


SCOPE_DOCUMENT = (140.0, (("title", 80.0), ("filename", 60.0)))
SCOPE_CHUNK = (70.0, (("title", 55.0), ("content", 28.0)))
SCOPE_UNIT = (90.0, (("subject", 70.0), ("indicator", 60.0), ("title", 45.0), ("normalized", 35.0)))


def scope_recall(scopes: DataFrame, docs: DataFrame, chunks: DataFrame, units: DataFrame, most: int) -> DataFrame:
    """(scope_id, doc_id, score, rank): the ``most`` best files of each scope; known documents are left to an anti join.

    A document, chunk or unit hits if a field holds the scope, or if its words include all words of the scope; it scores its
    base and the weight of each field that holds the scope. A file has the best score of its hits. (The share of a full-text
    rank isn't added.)
    """
    words = F.filter(T.search_terms("scope"), lambda w: w != "")
    s = scopes.select("scope_id", F.lower(F.trim("scope")).alias("phrase"), F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))).alias("words")).where("phrase != ''")
    phrases = s.select("scope_id", F.col("phrase").alias("term"))
    anchors = s.where(F.size("words") > 0).select("scope_id", "words", F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("term"))
    terms = phrases.select("term").unionByName(s.select(F.explode("words").alias("term")))

    def leg(df: DataFrame, base: float, fields: Sequence[tuple[str, float]]) -> DataFrame:
        weight = F.create_map(*(x for name, w in fields for x in (F.lit(name), F.lit(w))))
        every = F.regexp_replace(F.concat(F.lit(" "), F.lower(F.concat_ws(" ", *(name for name, _ in fields))), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")
        held = held_terms(df, ["doc_id", "item"], {name: F.lower(T.text(name)) for name, _ in fields} | {"__words": every}, terms)
        one = held.select("doc_id", "item", "field", "terms", F.explode("terms").alias("term"))
        whole = one.where("field != '__words'").join(small(phrases), "term").select("scope_id", "doc_id", "item", weight[F.col("field")].alias("w"))
        all_ = one.where("field = '__words'").join(small(anchors), "term").where(F.forall("words", lambda w: F.array_contains("terms", w))).select("scope_id", "doc_id", "item", F.lit(0.0).alias("w"))
        return whole.unionByName(all_).groupBy("scope_id", "doc_id", "item").agg((F.lit(base) + F.sum("w")).alias("s")).select("scope_id", "doc_id", "s")

    d = leg(docs.withColumn("item", F.lit(0)), *SCOPE_DOCUMENT)
    c, u = (leg(df.withColumn("item", F.col("chunk_no")), *x) for df, x in ((chunks, SCOPE_CHUNK), (units, SCOPE_UNIT)))
    df = d.unionByName(c).unionByName(u).groupBy("scope_id", "doc_id").agg(F.max("s").alias("score"))
    rank = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("score"), "doc_id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= most)


def enrichment_queue(recall: DataFrame, active: DataFrame, most: int) -> DataFrame:
    """The first ``most`` files by the number of scopes that want them, then the summed score, then the id: (doc_id, scopes,
    score, place); files in work are skipped."""
    df = recall.groupBy("doc_id").agg(F.countDistinct("scope_id").alias("scopes"), F.sum("score").alias("score")).join(active.select("doc_id"), "doc_id", "left_anti")
    order = (F.desc("scopes"), F.desc("score"), "doc_id")
    return df.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # ``most`` rows


def missing_builds(files: DataFrame, builds: DataFrame) -> DataFrame:
    """Indexed files without a successful build and without an active one."""
    return files.where("status = 'success'").join(builds.where("status in ('success', 'running', 'queued')").select("doc_id"), "doc_id", "left_anti")


def batch_chunks(chunks: DataFrame, n: int) -> DataFrame:
    """Consecutive groups of n chunks a document with a key and a hash of the input (ledger_keys)."""
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no")) - 1
    df = chunks.withColumn("pos", pos).groupBy("doc_id", F.floor(F.col("pos") / n).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))).alias("items"))
    return df.withColumn("batch_key", F.sha2(F.concat_ws(":", "doc_id", "batch"), 256)).withColumn("input_hash", F.sha2(F.array_join(F.transform("items", lambda x: x["content"]), "\n"), 256))


def resume_batches(batches: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to run, reused): batches whose key and input hash were successful before are reused."""
    done = ledger.where("status = 'success'").select("batch_key", "input_hash").distinct()
    return batches.join(done, ["batch_key", "input_hash"], "left_anti"), batches.join(done, ["batch_key", "input_hash"], "left_semi")


def clear_ledger(ledger: DataFrame, gone: DataFrame, keys: Sequence[str] = ("doc_id", "depth", "scope")) -> DataFrame:
    return ledger.join(gone.select(*keys).distinct(), list(keys), "left_anti")
