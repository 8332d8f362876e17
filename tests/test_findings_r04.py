"""Findings of round 4: work that must not grow with queries times rows, and texts on which a query differed from its SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrydeck.functions import text as T
from quarrydeck.operators import contain, graph, recall, retrieval, topics
from quarrydeck.plans import registry

def plain(df):
    return sorted((tuple(None if x is None or x != x else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)

def most_rows(df):
    """The most rows that a step of the executed plan put out (without the readers and generators of a single table)."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined() and ("Join" in name or "Aggregate" in name or "Python" in name or "Arrow" in name):
            most = max(most, rows.get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most

def test_f25_hash_embedding_of_empty_texts(spark, tmp_path):
    texts = ["", " ", "b", "bc", "x" * 70, "\U0001f600b", "é\0"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert plain(registry.QUERIES["hash_embedding"](spark, str(tmp_path)).toPandas()) == plain(con.execute(registry.SQL["hash_embedding"]).fetchdf())


def test_f8_recall_finds_the_best_items_of_a_term_once(spark, monkeypatch):
    items = [(f"{i % 7}:{i}", "the title" if i % 50 == 3 else "other", f"the text {i}") for i in range(600)] + [("9:9", None, None)]
    plan = [(f"d{i}", term, weight) for i in range(60) for term, weight in (("the", 3.0 - i % 2), ("text", 1.2), (f"text {i}", 2.4), ("", 1.0), ("absent", 1.0))]
    best = {}
    for _, term, _ in plan:
        held = sorted((-(2.0 * (term in title) + (term in text)), i) for i, title, text in items[:-1] if term and (term in title or term in text))
        best[term] = [(-f, i) for f, i in held[:6]]
    want = {}
    for domain, term, weight in plan:
        for f, i in best[term]:
            score, n = want.get((domain, i), (0, 0))
            want[domain, i] = (score + weight * f, n + 1)
    df = lambda: topics.recall_items(spark.createDataFrame(plan, "domain_id string, term string, weight double"), spark.createDataFrame(items, "item_id string, title string, content string").repartition(3), (("title", 2.0), ("content", 1.0)), 6)
    assert {(r.domain_id, r.item_id): (r.score, r.terms) for r in df().collect()} == {k: (round(s, 6), n) for k, (s, n) in want.items()}
    assert most_rows(df()) < 60 * 600 / 10  # a row for each domain and item that share a term was 36,000
    monkeypatch.setattr(contain.best_holding, "__kwdefaults__", {**contain.best_holding.__kwdefaults__, "most_terms": 7})
    assert {(r.domain_id, r.item_id): (r.score, r.terms) for r in df().collect()} == {k: (round(s, 6), n) for k, (s, n) in want.items()}


@pytest.mark.parametrize("name", ["coverage_backfill", "documents_from_evidence", "filter_excluded", "recent_fill", "select_evidence_mmr", "evidence_pack", "group_evidence"])
def test_recalled_rows_are_found_once(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 1  # what is recalled is a table by now, and one scan of it may follow


def test_f34_floors_leave_the_best_items_as_they_are(spark, monkeypatch):
    rng = random.Random(7)
    words = ["data", "Data", "plan", "of", "x", "mid-term", "a"]
    rows = [(i % 40, i, " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=5))) for i in range(800)]
    c = spark.createDataFrame(rows, "doc_id long, chunk_no int, title string, content string")
    u = c.select("*", F.col("title").alias("subject"), F.lit("").alias("indicator"), F.col("content").alias("normalized"))
    d = c.groupBy("doc_id").agg(F.min("title").alias("title")).select("doc_id", "title", F.lit("f.txt").alias("filename"), F.lit("p/f.txt").alias("path"))
    q = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=3))) for i in range(30)] + [("e", " "), ("n", None), ("z", "absent")], "query_id string, query string")
    rows_of = lambda: sorted(tuple(r) for r in retrieval.keyword_search(q, d, u, c, 6).collect())
    plain_rows = rows_of()
    weighed = []
    monkeypatch.setattr(retrieval, "keyword_leg", lambda *a, leg=retrieval.keyword_leg: weighed.append(a[6]) or leg(*a))
    monkeypatch.setattr(retrieval, "MANY_QUERIES", 3)
    monkeypatch.setattr(retrieval, "LOOK", 3)
    assert rows_of() == plain_rows and weighed[:3] == [None] * 3 and len(weighed[3]) >= 29


@pytest.mark.parametrize("floored", [False, True])
def test_f34_scorer_weighs_only_what_can_reach_a_floor(floored):
    """With a floor, the cells put out hold every score from the floor on, and few others."""
    rng = random.Random(3)
    words = [f"w{i:03}" for i in range(400)]
    texts = [[rng.choice(words) for _ in range(12)] for _ in range(400)]
    fields = (("title", 3.0, 1.6, True), ("content", 2.4, 1.4, False))
    queries = [(" ".join(t), "".join(t), t) for t in ([rng.choice(words) for _ in range(3)] for _ in range(200))]
    titles, contents = [" ".join(t[:2]) for t in texts], [" ".join(t) for t in texts]
    scorer = contain.Scorer(queries, fields)
    hits = scorer.read([titles, [t.replace(" ", "") for t in titles], contents])
    want = {}
    for i, (title, content) in enumerate(zip(titles, contents)):
        for j, (raw, tight, tokens) in enumerate(queries):
            s = 3.0 * (raw in title) + 1.5 * (tight in title.replace(" ", "")) + 2.4 * (raw in content) + sum(1.6 * (t in title) + 1.4 * (t in content) for t in tokens)
            if s > 0:
                want[i, j] = round(s, 6)
    floor = 4.3 if floored else 0.0
    scorer.drop(np.full(scorer.size, floor))
    got = {(i, j): s for row, query, score, _ in scorer.score(hits, len(texts), sparse=True) for i, j, s in zip(row.tolist(), query.tolist(), score.tolist()) if s > 0}
    assert all(want[k] == s for k, s in got.items()) and {k for k, s in want.items() if s >= floor} <= set(got)
    assert not floored or len(got) < len(want) / 20


def test_f15_facts_that_hold_the_same_terms_are_weighed_once(spark):
    rng = random.Random(5)
    names = [f"{a} {b}" for a in ("large", "hot", "red") for b in ("ring", "bolt")]
    facts = [(f"f{rng.randrange(700)}", rng.choice(["Ann", "Bob"]), rng.choice(["has", "hot"]), rng.choice([*names, "none"]), float(i % 9)) for i in range(900)]
    f = spark.createDataFrame(facts, "fact_id string, subject string, predicate string, object string, confidence double").repartition(3)
    asked = [(i, names[i % 6]) for i in range(90)] + [(90, "ring ring large"), (91, "absent"), (92, "")]
    q = spark.createDataFrame(asked, "query_id int, query string")
    found = lambda: graph.fact_search(q, f, 4)
    tokens = {r.query_id: set(r.t) for r in q.select("query_id", T.graph_tokens("query").alias("t")).collect()}
    want = []
    for i, _ in asked:
        held: dict = {}
        for fact_id, s, p, o, _ in facts:
            held.setdefault(fact_id, set()).update(t for t in tokens[i] if t in f"{s} {p} {o}".lower())
        want += [(i, x, n, k + 1) for k, (n, x) in enumerate(sorted(((len(h), x) for x, h in held.items() if h), reverse=True)[:4])]
    assert sorted(tuple(r) for r in found().collect()) == sorted(want)
    assert most_rows(found()) < 90 * 900 / 20  # a row for each query and fact that share a token was 30,000
    topics_ = q.select(F.col("query_id").alias("topic_id"), F.col("query").alias("topic"))
    edges = lambda: topics.topic_subgraph(f, topics_, 4)
    want = []
    for i, name in asked:
        rows = {(x, s, o, p): len({t for t in name.split() if t in f"{s} {o}".lower()}) for x, s, p, o, _ in facts}
        want += [(i, *x, n, k + 1) for k, (n, x) in enumerate(sorted(((n, x) for x, n in rows.items() if n), key=lambda r: (-r[0], r[1]))[:4])]
    assert sorted(tuple(r) for r in edges().collect()) == sorted(want)
    assert most_rows(edges()) < 90 * 900 / 20


def test_f17_dimensions_share_the_best_items_of_a_term(spark):
    items = spark.createDataFrame([(f"{kind}:{i}:0", i, kind, "the head" if i % 9 == 4 else "", f"the text {i}") for i in range(400) for kind in ("unit", "chunk")], "item_id string, doc_id long, kind string, title string, content string")
    dims = spark.createDataFrame([(f"d{i}", "x", ["the", f"text {i}"]) for i in range(40)], "domain_id string, dimension string, terms array<string>")
    docs = items.where("doc_id % 3 = 0").select("doc_id").distinct()
    each = docs.crossJoin(dims.select("domain_id").distinct())
    shared = recall.recall_dimensions(dims, items, docs, 12)
    rows = sorted(tuple(r) for r in shared.collect())
    assert len(rows) > 400 and rows == sorted(tuple(r) for r in recall.recall_dimensions(dims, items, each, 12).collect())
    assert most_rows(shared) < 40 * 800 / 8  # a row for each dimension and item that share a term was 32,000


def test_f12_the_last_step_of_paths_is_not_written(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "a:s", f"f{i}", "p", 0.5, f"b{i}:s", f"b{i}") for i in range(9)] + [(f"b{i}", f"b{i}:s", f"g{i}-{j}", "q", 0.5, f"c{j}:s", f"c{j}") for i in range(9) for j in range(50)], "src string, src_state string, fact_id string, predicate string, confidence double, dst_state string, dst string")
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: written.append((out := cut(df)).columns) or out)
    assert graph.entity_paths(edges, spark.createDataFrame([("a",)], "key string"), [["p"], ["q"]]).count() == 450
    assert sum("path" in columns for columns in written) == 1
