"""Structure facts: what a section's anchor, its local parents and the entities it mentions have to do with each other.

chunks(doc_id, chunk_no, doc_title, title, keywords array), mentions(doc_id, chunk_no, key, name, entity_type), with one name a
key. A chunk has one anchor, of the entities of anchor types whose name its document's title (first) or its own title holds,
or that it mentions under a keyword (last); longer names first, then smaller keys. Its targets are the first six mentions
that its title or a keyword names. A target's parent is the best other mention of a parent type that the title or a keyword
names; without one the anchor is, if the title names the target.

A title that is a number has no facts. Equal facts merge. Of two local facts that say the reverse of each other the one with
the shorter subject stays. Names are found in titles by an automaton; everything else stays inside a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.lineage import cut
from .contain import holding
from .retrieval import small

PLACE = ["doc_id", "chunk_no"]


def usable(name: str, least: int) -> Column:
    """Names that can stand in a structure fact."""
    c = T.text(name)
    ok = F.length(c).between(least, L.STRUCTURE_LONGEST) & ~c.isin(*L.STRUCTURE_EXCLUDED_NAMES, *L.STRUCTURE_EXCLUDED_FIELDS) & ~T.any_of(c, L.STRUCTURE_BREAKS)
    return ok & ~T.any_of(c, L.STRUCTURE_EXCLUDED_PARTS)


def _named_by(keywords: str, name: str) -> Column:
    low = F.lower(F.col(name))
    return F.coalesce(F.exists(F.col(keywords), lambda k: F.lower(k).contains(low) | low.contains(F.lower(k))), F.lit(False))


def anchors(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, anchor, anchor_name): one a chunk."""
    named = mentions.where(F.lower("entity_type").isin(*L.STRUCTURE_ANCHORS) & usable("name", 3))
    names = cut(named.select("key", "name", F.lower("name").alias("term")).distinct())
    titles = {c: F.lower(T.text(c)) for c in ("doc_title", "title")}
    held = holding(chunks, PLACE, titles, names.select("term")).join(small(names), "term")
    held = held.select(*PLACE, F.when(F.col("field") == "doc_title", 2).otherwise(1).alias("rank"), "key", "name")
    own = named.join(chunks.select(*PLACE, "keywords"), PLACE).where(_named_by("keywords", "name")).select(*PLACE, F.lit(0).alias("rank"), "key", "name")
    first = F.min(F.struct((-F.col("rank")).alias("r"), (-F.length("name")).alias("n"), "key", "name")).alias("x")
    return held.unionByName(own).groupBy(*PLACE).agg(first).select(*PLACE, F.col("x.key").alias("anchor"), F.col("x.name").alias("anchor_name"))


def structure_evidence(chunks: DataFrame, mentions: DataFrame, held_back: DataFrame | None = None, most: int = 6) -> DataFrame:
    """(doc_id, chunk_no, title, anchor, subject, subject_name, target, role, confidence): a row for each target of a chunk.

    held_back(key): entities that are candidates for attributes and stay out of the structure.
    """
    rows = mentions.select(*PLACE, "key", "name", F.lower("entity_type").alias("kind")).distinct()
    own = rows if held_back is None else rows.join(held_back.select("key"), "key", "left_anti")
    usual = chunks.where(~T.text("title").rlike(r"^[0-9]+(\.[0-9]+)?$")).select(*PLACE, "title", "keywords")
    own = own.where(usable("name", 2)).join(usual, PLACE).join(anchors(chunks, mentions), PLACE).where("key != anchor and name != anchor_name")
    own = own.withColumns({"in_title": F.lower(T.text("title")).contains(F.lower("name")), "in_words": _named_by("keywords", "name")}).where("in_title or in_words")
    own = cut(own)
    by = [F.desc("in_title"), F.desc("in_words"), F.desc(F.length("name")), "key"]
    targets = own.where(F.col("kind").isin(*L.STRUCTURE_TARGETS) & ~F.col("name").rlike(r"^[0-9]+(\.[0-9]+)?$"))
    targets = targets.withColumn("place", F.row_number().over(Window.partitionBy(*PLACE).orderBy(*by))).where(F.col("place") <= most)
    fit = F.col("kind").isin(*L.STRUCTURE_PARENTS) & ((F.col("kind") != "concept") | F.col("in_title") | T.any_of(F.col("name"), L.STRUCTURE_PARENT_PARTS))
    by = [F.desc("in_title"), F.desc(F.length("name")), "key"]
    once = F.row_number().over(Window.partitionBy(*PLACE, "name").orderBy(*by))
    place = F.row_number().over(Window.partitionBy(*PLACE).orderBy(*by))
    parents = own.where(fit).withColumn("once", once).where("once = 1").withColumn("place", place).where("place <= 2")  # one of two names isn't the target's
    parents = parents.groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("place", "key", "name"))).alias("parents"))
    df = targets.join(parents, PLACE, "left").withColumn("parent", F.get(F.filter("parents", lambda p: (p["name"] != F.col("name")) & (p["key"] != F.col("key"))), F.lit(0)))
    df = df.where(F.col("parent").isNotNull() | F.col("in_title"))
    local = F.col("parent").isNotNull()
    confidence = F.when(F.col("in_title"), L.STRUCTURE_SURE["title"]).otherwise(L.STRUCTURE_SURE["keyword"])
    return df.select(*PLACE, "title", "anchor", F.coalesce("parent.key", "anchor").alias("subject"), F.coalesce("parent.name", "anchor_name").alias("subject_name"), F.col("key").alias("target"), F.when(local, "local_parent_child").otherwise("anchor_child").alias("role"), confidence.alias("confidence"))


def enhance_structure(chunks: DataFrame, mentions: DataFrame, held_back: DataFrame | None = None) -> DataFrame:
    """(subject, object, role, confidence, evidence): facts of a parent or an anchor with its targets, and of an anchor with
    the parents of the facts that stay."""
    rows = cut(structure_evidence(chunks, mentions, held_back))
    facts = rows.groupBy("subject", F.col("target").alias("object")).agg(F.max("role").alias("role"), F.max("confidence").alias("confidence"), F.count("*").alias("evidence"), F.min("subject_name").alias("subject_name"))
    facts = cut(facts)  # "local_parent_child" comes after "anchor_child": a fact with both is local
    local = facts.where("role = 'local_parent_child'").select("subject", "object", F.struct(F.length("subject_name").alias("n"), "subject", "object").alias("own"))
    turned = local.select(F.col("subject").alias("object"), F.col("object").alias("subject"), F.col("own").alias("other"))
    losers = local.join(turned, ["subject", "object"]).where("other < own").select("subject", "object")
    stay = facts.join(losers, ["subject", "object"], "left_anti")
    kept = rows.where("role = 'local_parent_child' and anchor != subject").join(stay.select("subject", F.col("object").alias("target")), ["subject", "target"], "left_semi")
    above = kept.select("anchor", "subject", *PLACE).distinct().groupBy(F.col("anchor").alias("subject"), F.col("subject").alias("object")).agg(F.count("*").alias("evidence"))
    above = above.select("subject", "object", F.lit("anchor_parent").alias("role"), F.lit(L.STRUCTURE_SURE["parent"]).alias("confidence"), "evidence")
    return stay.select("subject", "object", "role", "confidence", "evidence").unionByName(above)
