"""Text functions as column expressions; null texts count as empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

PUNCT = r"[\p{P}\p{S}\s]+"
CJK = r"[\p{IsHan}]"


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where ``use`` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def compact(c) -> Column:
    """Without white space."""
    return F.regexp_replace(text(c), r"\s+", "")


def tight(c) -> Column:
    """Lower case, without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(text(c)), PUNCT, "")


def collapse_space(c) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def ellipsis(c, n: int) -> Column:
    c = text(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def any_of(c: Column, words: Sequence[str]) -> Column:
    """Whether the text holds one of the words."""
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def count_of(c: Column, words: Sequence[str]) -> Column:
    """How many of the words the text holds."""
    return sum((c.contains(w).cast("int") for w in words), F.lit(0))


def first_cue(c: Column, cues, default: str) -> Column:
    """The name of the first list of cues that hits."""
    out = F.lit(default)
    for name, words in reversed(list(cues)):
        out = F.when(any_of(c, words), name).otherwise(out)
    return out


def snippet(content, query, radius: int = 90) -> Column:
    """The surroundings of the first hit, else the head of the text; null for an empty text."""
    t, q = F.trim(text(content)), F.lower(F.trim(text(query)))
    return _around(t, q, radius)


def _around(t: Column, q: Column, radius: int) -> Column:
    at = F.instr(F.lower(t), q)
    start = F.greatest(F.lit(1), at - radius)
    end = F.least(F.length(t), at + F.length(q) - 1 + radius)
    cutout = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(t, start, end - start + 1), F.when(end < F.length(t), "...").otherwise(""))
    return F.when(t == "", None).when((q != "") & (at > 0), cutout).otherwise(ellipsis(t, 2 * radius))


def split_clauses(query) -> Column:
    """The query and its clauses of at least 4 characters, at most 6 in all."""
    q = F.trim(F.regexp_replace(text(query), "[“”\"]", " "))
    parts = F.filter(F.transform(F.split(q, r"[；;。！？!?,，、/\\|]+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 4)
    return F.slice(F.array_distinct(F.concat(F.array(q), parts)), 1, 6)


def windows(c: Column, width: int) -> Column:
    """All slices of a width."""
    return F.when(F.length(c) >= width, F.transform(F.sequence(F.lit(1), F.length(c) - width + 1), lambda i: F.substring(c, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def query_tokens(query, most: int = 12) -> Column:
    """Tokens between punctuation, each followed by its CJK windows of 4 and 2 characters; distinct."""
    tokens = F.filter(F.split(F.trim(text(query)), PUNCT), lambda x: x != "")

    def widened(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(f"({CJK}{{2,}})"))
        return F.concat(F.array(t), F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 4, F.concat(windows(r, 4), windows(r, 2))).otherwise(windows(r, 2)))))

    return F.slice(F.array_distinct(F.flatten(F.transform(tokens, widened))), 1, most)


def query_terms(query) -> Column:
    """ASCII words in lower case, else the whole query from 2 characters on."""
    q = F.lower(F.trim(text(query)))
    words = F.regexp_extract_all(q, F.lit(r"([a-z][a-z0-9_-]+)"))
    return F.when(F.size(words) > 0, words).when(F.length(q) >= 2, F.array(q)).otherwise(F.array().cast("array<string>"))


def graph_tokens(query, most: int = 16) -> Column:
    whole = tight(query)
    tokens = F.filter(F.split(F.lower(F.trim(text(query))), PUNCT), lambda x: F.length(x).between(2, 48))
    return F.slice(F.array_distinct(F.concat(tokens, F.filter(F.array(whole), lambda x: F.length(x).between(2, 48)))), 1, most)


def is_exactish(query) -> Column:
    q = F.trim(text(query))
    return (q != "") & (q.rlike("[\"'“”《》]") | (F.length(q) >= 8))


def query_type(query, cues=L.QUERY_CUES) -> Column:
    return first_cue(text(query), cues, "document_lookup")


def trigrams(c) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: windows(F.concat(F.lit("  "), w, F.lit(" ")), 3))))


def trigram_similarity(a, b) -> Column:
    x, y = trigrams(a), trigrams(b)
    total = F.size(F.array_union(x, y))
    return F.when(total > 0, F.size(F.array_intersect(x, y)) / total).otherwise(0.0)


def search_terms(c) -> Column:
    """Distinct lower-case terms of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text(c)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def fts_any(tokens: Column, terms: Column) -> Column:
    return F.arrays_overlap(tokens, terms)


def fts_all(tokens: Column, terms: Column) -> Column:
    return (F.size(terms) > 0) & (F.size(F.array_except(terms, tokens)) == 0)


def value_shape(value) -> Column:
    v = F.regexp_replace(F.lower(F.trim(text(value))), r"\s+", "")
    money, scalar = v.rlike(L.SHAPE_MONEY), v.rlike(L.SHAPE_SCALAR)
    temporal = v.rlike(L.SHAPE_YEAR) | v.rlike(L.SHAPE_DATE) | v.rlike(L.SHAPE_STAGE)
    return F.when(v == "", "empty").when(money, "money").when(v.rlike(L.SHAPE_PERCENT), "percent").when((F.length(v) <= 24) & temporal, "date").when(scalar, "scalar").when(F.length(v) <= 32, "short_text").otherwise("long_text")


def statement_pattern(statement) -> Column:
    v = F.regexp_replace(F.lower(F.trim(text(statement))), r"\s+", "")
    fields = v.contains("每条记录") | v.contains("字段") | (v.contains("列表") & v.contains("包含"))
    return F.when(v.contains("章节") & v.contains("涉及"), "structure_reference").when(fields, "field_list").when(v.contains("：") | v.contains(":"), "key_value").when(v.contains("为") | v.contains("是"), "copula").otherwise("free_text")


PREDICATE_MARKS = r"[()（）\[\]【】《》<>“”\"'、，,。.;；:：\-_/\\|]"


def predicate_norm(predicate) -> Column:
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text(predicate))), r"\s+", ""), PREDICATE_MARKS, "")
    return F.regexp_replace(v, "(?<=.)(要求为|为|是)$", "")


def predicate_role(predicate, words: Sequence[str] = L.ACTION_WORDS) -> Column:
    return F.when(any_of(predicate_norm(predicate), words), "generic_action").otherwise("unknown")


def governed_value(key, statement, value) -> Column:
    """What stands behind the first colon if the key stands before it, else the value."""
    s = text(statement)
    left, right = F.regexp_extract(s, r"(?s)^([^：:]*)[：:](.*)$", 1), F.trim(F.regexp_extract(s, r"(?s)^([^：:]*)[：:](.*)$", 2))
    return F.when(F.lower(left).contains(F.lower(F.trim(text(key)))) & (right != ""), right).otherwise(text(value))


def common_prefix(a, b) -> Column:
    a, b = text(a), text(b)
    n = F.least(F.length(a), F.length(b))
    hits = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(hits)


def common_suffix(a, b) -> Column:
    return common_prefix(F.reverse(text(a)), F.reverse(text(b)))


def is_value_like(name) -> Column:
    """Numbers, amounts and dates rather than names."""
    return value_shape(name).isin("money", "percent", "date", "scalar")


def heading_level(c) -> Column:
    """0: no heading; chapter marks are 1, sections 2, dotted numbers their depth up to 6, hash marks their number."""
    t = F.trim(text(c))
    dotted = F.regexp_extract(t, r"^(\d+(?:\.\d+){0,5})[\s、.．]", 1)
    hashes = F.length(F.regexp_extract(t, r"^(#{1,6})\s", 1))
    return F.when(t.rlike("^第[一二三四五六七八九十百0-9]+章"), 1).when(t.rlike("^第[一二三四五六七八九十百0-9]+节"), 2).when(hashes > 0, hashes).when(dotted != "", F.size(F.split(dotted, r"\."))).otherwise(0)


def is_list_item(c) -> Column:
    return F.trim(text(c)).rlike(r"^([-*•·]|\(?\d+[\).、]|[（(][一二三四五六七八九十]+[)）])\s*\S")
