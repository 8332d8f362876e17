"""Names that are no entities or topics: format noise, imported files, a document's own name, generic words, article titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

FILE = r"(?i)\.(docx?|pdf|xlsx?|pptx?|txt|md)$"


def _bare(c) -> Column:
    return F.regexp_replace(F.lower(F.trim(T.text(c))), r"\s+", "")


def is_format_noise(name, stop: Sequence[str] = L.STOP_NAMES) -> Column:
    """Words that come from links, references and page marks."""
    return _bare(name).isin(*stop)


def looks_imported(name, prefixes: Sequence[str] = ()) -> Column:
    """File names, names with an import number behind an underscore, and names with a given prefix."""
    n = F.trim(T.text(name))
    found = n.rlike(FILE) | n.rlike(r"_[0-9]{3,}$")
    for p in prefixes:
        found = found | F.lower(n).startswith(p)
    return found


def is_hidden_entity(name, entity_type, prefixes: Sequence[str] = ()) -> Column:
    """Blank names, documents and states themselves, format noise and imported files."""
    return (_bare(name) == "") | _bare(entity_type).isin("document", "entitystate") | is_format_noise(name) | looks_imported(name, prefixes)


def artifact_name(c) -> Column:
    """A name as files have it: lower case, without white space, extension and punctuation."""
    return F.regexp_replace(F.regexp_replace(_bare(c), FILE, ""), T.PREDICATE_MARKS, "")


def source_artifacts(docs: DataFrame, fields: Sequence[str] = ("title", "filename", "path")) -> DataFrame:
    """(doc_id, artifact): the names of each document itself, whole and without folders and extension."""
    names = F.array(*(x for f in fields for x in (artifact_name(f), artifact_name(F.regexp_replace(T.text(f), r"^.*[/\\]", "")))))
    return docs.select("doc_id", F.explode(F.array_distinct(names)).alias("artifact")).where("artifact != ''")


def mark_source_artifacts(entities: DataFrame, docs: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """Add source_artifact: hidden names, and names that are the entity's document's own. entities(doc_id, name, entity_type)."""
    own = source_artifacts(docs).withColumn("__own", F.lit(True))
    df = entities.withColumn("artifact", artifact_name("name")).join(own, ["doc_id", "artifact"], "left")
    return df.withColumn("source_artifact", is_hidden_entity("name", "entity_type", prefixes) | F.coalesce("__own", F.lit(False))).drop("artifact", "__own")


def is_article_title(c, heads: Sequence[str] = L.TITLE_HEADS, tails: Sequence[str] = L.TITLE_TAILS, inner: Sequence[str] = L.TITLE_INNER) -> Column:
    """Titles of more than 8 characters that open and close as papers and notices do."""
    t = F.regexp_replace(T.text(c), r"\s+", "")
    head, tail = (F.lit(False), T.any_of(t, inner))
    for x in heads:
        head = head | t.startswith(x)
    for x in tails:
        tail = tail | t.endswith(x)
    return (F.length(t) > 8) & head & tail


def is_generic_term(c, words: Sequence[str] = L.GENERIC_TERMS) -> Column:
    return F.regexp_replace(F.lower(F.trim(T.text(c))), r"[\s_\-·、，。,.()/（）【】\[\]]+", "").isin(*words)


def _chinese(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^一-鿿]", "")) >= F.greatest(F.lit(2), F.floor(F.length(c) / 3))


def edge_slices(c: Column, least: int, most: int) -> Column:
    """First, last and middle slices of every second size between two lengths; distinct."""
    n, out = F.length(c), []
    for size in range(max(2, least), max(least, most) + 1, 2):
        s = F.lit(size)
        middle = F.greatest(F.lit(0), F.floor(n / 2) - size // 2).cast("int")
        ends = F.array(F.substring(c, F.lit(1), s), F.substring(c, n - size + 1, s))
        out.append(F.when(n > 2 * size, F.array_append(ends, F.substring(c, middle + 1, s))).when(n >= size, ends).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.array(*out)))


def clean_fragment(c: Column) -> Column:
    """Without question words before and behind."""
    t = F.regexp_replace(F.regexp_replace(c, L.QUESTION_HEAD, ""), L.QUESTION_TAIL, "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def fragments(c, generic: Sequence[str] = L.GENERIC_FRAGMENTS) -> Column:
    """The parts of a text between stops and connecting words, 2 to 64 characters, without generic ones; long Chinese parts
    also give their edge slices of 6 to 20 characters."""
    lines = F.filter(F.transform(F.split(F.translate(T.text(c), "：:；;。，,、？?（）()", "\n\n\n\n\n\n\n\n\n\n    "), r"[\r\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 2)
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, L.CONNECTORS)))
    keep = lambda x: ~F.lower(x).isin(*generic)
    parts = F.filter(F.transform(parts, clean_fragment), lambda x: F.length(x).between(2, 64) & keep(x))
    wide = F.transform(parts, lambda x: F.concat(F.array(x), F.when((F.length(x) > 20) & _chinese(x), F.filter(edge_slices(x, 6, 20), keep)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.flatten(wide))


def negative_texts(c, cues: str = L.NEGATIVE_CUES) -> Column:
    """What stands behind an excluding cue in each clause."""
    clauses = F.filter(F.transform(F.split(T.text(c), r"[；;。，,\r\n]+"), lambda x: F.trim(x)), lambda x: x.rlike(cues))
    return F.transform(clauses, lambda x: T.let(F.trim(F.regexp_replace(F.regexp_replace(x, rf"^.*?{cues}", ""), "^[：:，,。；;]+", "")), lambda y: F.when(y == "", x).otherwise(y)))


def excluded_terms(domains: DataFrame, *, rules: str = "rules", texts: str = "texts", most: int = 24, cues: str = L.NEGATIVE_CUES) -> DataFrame:
    """(domain_id, place, phrase): the first ``most`` excluded phrases of a domain: its rules and their fragments, then the
    fragments behind excluding cues in its texts. domains(domain_id, rules array, texts array)."""
    given = F.flatten(F.transform(rules, lambda x: F.concat(F.array(F.trim(x)), fragments(x))))
    found = F.flatten(F.transform(F.flatten(F.transform(texts, lambda x: negative_texts(x, cues))), lambda x: fragments(x)))
    phrases = F.slice(F.filter(F.array_distinct(F.concat(F.coalesce(given, F.array().cast("array<string>")), F.coalesce(found, F.array().cast("array<string>")))), lambda x: F.trim(x) != ""), 1, most)
    return domains.select("domain_id", F.posexplode(phrases).alias("place", "phrase"))
