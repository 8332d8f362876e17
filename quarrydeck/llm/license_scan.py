"""License scans: sparse TF-IDF cosine of passages to licence templates, then inheritance along the directory tree.

Passages of a whole text are its sentences with a licence cue, each also together with its two neighbours (a notice that is
wrapped over lines), and the whole text of a file that is named like a licence file. Equal passages are scored once.
Templates are names, headers and whole texts; each is a unit vector. Version numbers are terms of their own ("v. 2.0",
"version 2" and "2.0" are the same one). A passage is of a template's licence if the cosine reaches ``threshold``, if it
holds all words that the template needs, and if some version number agrees where both have any; the best score counts,
then the smaller licence name. Document frequencies are those among the licences; a word of no template counts as rarest.

A file with no licence of its own takes that of the nearest directory, its own or one above, that has a licence file;
among several licence files of a directory the best score counts, then the smaller licence name, then the smaller path.

Only DataFrame functions run; a directory or passage with a large share of all rows stays spread out. Cases: null or empty
texts have no passage; a null path has no directory and inherits nothing; rows that share id and path but not the text are
files of their own; equal rows stay rows with equal results; long texts are read whole; an empty table gives an empty one; of
the input only the named columns are read, so that others can't clash.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, join_one
from .license_texts import TEMPLATES

CUES = ("licenc", "licens", "copyright", "spdx", "warrant", "redistribut", "permission", "creative commons", "public domain", "gpl")
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)[^/]*$"
SENTENCE = r"([.!?;])\s+([A-Z(])"
VERSION = r"^[0-9]{1,2}(_[0-9]{1,2})*$"

Template = tuple[str, str, str]


def has_cue(text: Column) -> Column:
    """Whether the text holds a cue word in any case; the lambda has the lower-cased text made once."""
    return F.transform(F.array(F.lower(text)), lambda low: reduce(operator.or_, (low.contains(word) for word in CUES)))[0]


def _terms(text: Column) -> Column:
    """Words and version numbers: letters and digits apart, 2.0 as 2, 2.1 as 2_1, without "v" and "version"."""
    apart = F.regexp_replace(F.regexp_replace(F.lower(text), "([a-z])v?([0-9])", "$1 $2"), r"([0-9])\.([0-9])", "$1_$2")
    words = F.transform(F.split(apart, "[^a-z0-9_]+"), lambda x: F.regexp_replace(x, "(_0)+$", ""))
    return F.filter(words, lambda x: ~x.isin("", "v", "version"))


def template_weights(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """(part, licence, needed, term, idf, weight, need, version): one row a template and term, of unit length a template.

    ``needed``: how many words the template needs; ``need``: whether the term is one; ``version``: whether it is a version.
    """
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "part int, licence string, needs string, body string")
    rows = rows.withColumn("needs", F.array_distinct(F.filter(F.split("needs", " "), lambda x: x != "")))
    terms = rows.select("part", "licence", "needs", F.explode(_terms(F.col("body"))).alias("term"))
    n = len({t[0] for t in templates})
    idf = terms.groupBy("term").agg((F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.countDistinct("licence"))) + 1).alias("idf"))
    tf = terms.groupBy("part", "licence", "needs", "term").agg(F.count("*").alias("tf")).join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = tf.groupBy("part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.max(F.col("term").rlike(VERSION)).alias("versions"))
    need = F.array_contains("needs", F.col("term")).cast("int")
    return tf.join(norm, "part").select("part", "licence", F.size("needs").alias("needed"), "versions", "term", "idf", (F.col("w") / F.col("norm")).alias("weight"), need.alias("need"), F.col("term").rlike(VERSION).cast("int").alias("version"))


def passage_licenses(passages: DataFrame, templates: Sequence[Template], threshold: float) -> DataFrame:
    """(key, n, best): of each distinct passage the best licence as struct(neg score, licence); ``n`` counts its places."""
    weights = F.broadcast(template_weights(passages.sparkSession, templates))  # as long as the given templates
    rarest = F.log(F.lit(1.0 + len({t[0] for t in templates}))) + 1
    keys = passages.groupBy("key").agg(F.first("passage").alias("passage"), F.count("*").alias("n"))
    counts = keys.select("key", "n", F.explode(_terms(F.col("passage"))).alias("term")).groupBy("key", "n", "term").agg(F.count("*").alias("tf"))
    vector = counts.join(F.broadcast(weights.select("term", "idf").distinct()), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", rarest)).drop("idf")
    norm = vector.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.max(F.col("term").rlike(VERSION)).alias("dated"))
    dots = vector.join(weights, "term").groupBy("key", "n", "part", "licence", "needed", "versions").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.sum("need").alias("have"), F.max("version").alias("agrees"))
    fits = (F.col("have") == F.col("needed")) & ((F.col("agrees") == 1) | ~F.col("versions") | ~F.col("dated"))
    scores = dots.where("have = needed").join(norm, "key").where(fits).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    return scores.groupBy("key", "n").agg(F.min(F.struct((-F.col("score")).alias("neg"), "licence")).alias("best"))


def scan_licenses(files: DataFrame, *, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """(id, path, own, own_score, licence, via, from_dir): ``via`` is own, inherited or null."""
    files = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    file_keys = ["id", "path", F.xxhash64("text").alias("h")]
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    cued = files.where(has_cue(F.col("text"))).select(*file_keys, named.alias("named"), "text", F.split(F.regexp_replace("text", SENTENCE, "$1\n$2"), "[\r\n]+").alias("parts"))
    around = F.transform("parts", lambda x, i: F.struct(x.alias("one"), F.concat_ws(" ", F.get("parts", i - 1), x, F.get("parts", i + 1)).alias("wide")))
    lines = cued.select("id", "path", "h", F.explode(around).alias("s")).where(has_cue(F.col("s.one"))).select("id", "path", "h", F.explode(F.array("s.one", "s.wide")).alias("passage"))
    whole = cued.where("named").select("id", "path", "h", F.col("text").alias("passage"))
    passages = cut(lines.unionByName(whole).withColumn("key", F.md5("passage")))
    best = passage_licenses(passages, templates, threshold)
    own = join_one(passages.select("id", "path", "h", "key"), best, "key", passages.count()).groupBy("id", "path", "h").agg(F.min("best").alias("best"))
    own = cut(own.select("id", "path", "h", F.col("best.licence").alias("own"), (-F.col("best.neg")).alias("own_score")))
    rows = cut(files.select(*file_keys, F.coalesce(directory(F.col("path")), F.lit("\0")).alias("home")))  # no text from here on
    near = nearest_license(rows, own)
    rows = rows.join(own.select(F.col("id").alias("__i"), F.col("path").alias("__p"), F.col("h").alias("__h"), "own", "own_score"), F.col("id").eqNullSafe(F.col("__i")) & F.col("path").eqNullSafe(F.col("__p")) & F.col("h").eqNullSafe(F.col("__h")), "left")
    rows = join_one(rows, near, "home", rows.count())
    via = F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited")
    return rows.select(F.col("id").alias(id_col), "path", "own", "own_score", F.coalesce("own", "given").alias("licence"), via.alias("via"), F.when(via == "inherited", F.col("from_dir")).alias("from_dir"))


def nearest_license(rows: DataFrame, own: DataFrame) -> DataFrame:
    """(home, n, from_dir, given) of every directory: its rows, and the nearest licence at it or above, if there is any."""
    held = own.where(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE)).withColumn("dir", directory(F.col("path")))
    held = held.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("neg"), "own", "path")).alias("at")).select("dir", F.col("at.own").alias("given"))
    homes = cut(rows.groupBy("home").agg(F.count("*").alias("n")))
    parts = F.split("home", "/")
    up = homes.where("home != '\0'").select("home", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    counted = held.join(up.groupBy("dir").agg(F.count("*").alias("n")), "dir")
    near = join_one(up, counted, "dir", up.count()).groupBy("home").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "given")).alias("near"))
    return homes.join(near, "home", "left").select("home", "n", F.col("near.dir").alias("from_dir"), F.col("near.given").alias("given"))


def directory(path: Column) -> Column:
    """Everything before the last slash; empty for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source / thousands / hundreds / id.txt; texts of under 1,000 characters lie one level
    up, and a document that opens with a licence cue, or a short one that ends with one, is its directory's LICENSE file."""
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 10000)))
    home = F.when(F.length("text") < 1000, top).otherwise(F.concat_ws("/", top, F.concat(F.lit("e"), F.floor(F.col("doc_id") / 100))))
    cue = has_cue(F.substring_index("text", "\n", 1)) | (has_cue(F.substring_index("text", "\n", -1)) & (F.length("text") < 1000))
    name = F.when(cue, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", home, name).alias("path"), "text")


def oracle(templates: Sequence[Template] = TEMPLATES, threshold: float = 0.6) -> str:
    """The whole scan of ``document_files`` in DuckDB SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(a)}, {quoted(b)}, {quoted(c)})" for i, (a, b, c) in enumerate(templates))
    n = float(len({t[0] for t in templates}))
    lic = LICENSE_FILE
    cued = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{word}')" for word in CUES) + ")"

    def terms(text: str) -> str:
        apart = f"regexp_replace(regexp_replace(lower({text}), '([a-z])v?([0-9])', '\\1 \\2', 'g'), '([0-9])\\.([0-9])', '\\1_\\2', 'g')"
        return f"list_filter(list_transform(regexp_split_to_array({apart}, '[^a-z0-9_]+'), lambda x: regexp_replace(x, '(_0)+$', '')), lambda x: x NOT IN ('', 'v', 'version'))"

    return f"""
WITH tpl(part, licence, needs, body) AS (VALUES {values}),
files AS (SELECT doc_id AS id, text, CASE WHEN length(text) < 1000 THEN top ELSE top || '/e' || (doc_id // 100) END || '/' || CASE WHEN {cued('string_split(text, chr(10))[1]')} OR (length(text) < 1000 AND {cued('string_split(text, chr(10))[-1]')}) THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS path
  FROM (SELECT *, coalesce(source, 'none') || '/d' || (doc_id // 10000) AS top FROM documents)),
tt AS (SELECT part, licence, list_distinct(list_filter(string_split(needs, ' '), lambda x: x <> '')) AS needs, unnest({terms('body')}) AS term FROM tpl),
idf AS (SELECT term, ln((1.0 + {n}) / (1.0 + count(DISTINCT licence))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT part, licence, needs, term, regexp_matches(term, '{VERSION}') AS version, count(*) * any_value(idf) AS w FROM tt JOIN idf USING (term) GROUP BY ALL),
tn AS (SELECT part, licence, needs, term, version, w / sqrt(sum(w * w) OVER (PARTITION BY part)) AS weight, bool_or(version) OVER (PARTITION BY part) AS versions FROM tw),
cued AS (SELECT id, path, text, regexp_split_to_array(regexp_replace(text, '{SENTENCE}', '\\1' || chr(10) || '\\2', 'g'), '[\\r\\n]+') AS parts FROM files WHERE {cued('text')}),
around AS (SELECT id, path, unnest(list_transform(range(1, len(parts) + 1), lambda i: {{'one': parts[i], 'wide': concat_ws(' ', CASE WHEN i > 1 THEN parts[i - 1] END, parts[i], CASE WHEN i < len(parts) THEN parts[i + 1] END)}})) AS s FROM cued),
pas AS (SELECT DISTINCT * FROM (SELECT id, path, unnest([s.one, s.wide]) AS p FROM around WHERE {cued('s.one')} UNION ALL SELECT id, path, text FROM cued WHERE regexp_matches(string_split(path, '/')[-1], '{lic}'))),
pt AS (SELECT p, term, count(*) AS tf FROM (SELECT p, unnest({terms('p')}) AS term FROM (SELECT DISTINCT p FROM pas)) GROUP BY ALL),
pv AS (SELECT p, term, tf * coalesce(idf, ln(1.0 + {n}) + 1) AS w FROM pt LEFT JOIN idf USING (term)),
pn AS (SELECT p, sqrt(sum(w * w)) AS norm, bool_or(regexp_matches(term, '{VERSION}')) AS dated FROM pv GROUP BY p),
sc AS (SELECT p, licence, round(sum(w * weight) / any_value(norm), 6) AS score FROM pv JOIN tn USING (term) JOIN pn USING (p) GROUP BY p, licence, part
  HAVING count(*) FILTER (WHERE list_contains(needs, term)) = any_value(len(needs)) AND (bool_or(version) OR NOT any_value(versions) OR NOT any_value(dated))),
own AS (SELECT id, path, licence AS own, score AS own_score FROM (SELECT *, row_number() OVER (PARTITION BY id, path ORDER BY score DESC, licence) AS k FROM pas JOIN sc USING (p) WHERE score >= {threshold}) WHERE k = 1),
held AS (SELECT dir, own AS given FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY own_score DESC, own, path) AS k FROM own WHERE regexp_matches(string_split(path, '/')[-1], '{lic}')) WHERE k = 1),
near AS (SELECT id, path, dir, given FROM (SELECT f.id, f.path, h.dir, h.given, row_number() OVER (PARTITION BY f.id, f.path ORDER BY length(h.dir) DESC) AS k FROM files f JOIN held h ON starts_with(f.path, h.dir || '/')) WHERE k = 1)
SELECT f.id AS doc_id, f.path, own, own_score, coalesce(own, given) AS licence, CASE WHEN own IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' END AS via, CASE WHEN own IS NULL AND given IS NOT NULL THEN dir END AS from_dir
FROM files f LEFT JOIN own USING (id, path) LEFT JOIN near n ON n.id = f.id AND n.path = f.path
"""
