"""Operators on small frames: default lexicons, folds, plug-ins and state."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrydeck.functions import plugins as P
from quarrydeck.functions import text as T
from quarrydeck.operators import chunks as C
from quarrydeck.operators import documents as D
from quarrydeck.operators import graph as G
from quarrydeck.operators import retrieval as S
from quarrydeck.operators import topics as O
from quarrydeck.operators import units as U
from quarrydeck.plans import registry
from quarrydeck.sources import inventory as I
from quarrydeck.streaming import streams as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def profile(spark, title, filename, doc_type, chunks, units=()):
    docs = spark.createDataFrame([(1, title, filename, doc_type)], "doc_id long, title string, filename string, doc_type string")
    c = spark.createDataFrame([(1, i, *x) for i, x in enumerate(chunks)], "doc_id long, chunk_no int, chunk_type string, title string, content string")
    u = spark.createDataFrame([(1, i, *x) for i, x in enumerate(units)], "doc_id long, unit_no int, subject string, indicator string, content string")
    return D.document_profile(docs, c, u).first()


def test_profiles(spark):
    plan = profile(spark, "项目建设方案", "平台.docx", "word", [("paragraph", "建设目标", "系统 平台 模块 接口 性能 验收 一期 升级")] * 8)
    assert (plan.profile_type, plan.strategy, plan.graph_suitability) == ("project_plan", "project_extraction", "strong")
    table = profile(spark, "清单", "a.xlsx", "excel", [("table_row", "", "数量 12 | 金额 300"), ("table_row", "", "单价 5 | 合计 9")])
    assert (table.profile_type, table.structure_type, table.strategy) == ("table", "table_heavy", "table_attribute_first")
    speech = profile(spark, "讲话", "讲话.docx", "word", [("paragraph", "", "同志们 会议 强调 指出 部署 贯彻 落实 精神")] * 8)
    assert (speech.profile_type, speech.strategy, speech.graph_suitability) == ("speech", "speech_summary", "weak")


def test_classify(spark):
    df = spark.createDataFrame([("xlsx", "a", ""), ("txt", "管理办法", ""), ("txt", "x", "会议强调"), ("txt", "x", "同比增长"), ("txt", None, None)], "ext string, stem string, preview string")
    assert [r.doc_type for r in D.classify_doc_type(df).collect()] == ["excel", "rule", "speech", "report", "unknown"]


def pack(text, n):
    """Greedy packing, as a plain loop."""
    out, now = [], ""
    for block in (b.strip() for b in text.split("\n\n")):
        if not block:
            continue
        if len(block) > n:
            out += [now] if now else []
            now = ""
            out += [block[i : i + n] for i in range(0, len(block), n)]
        elif len(now) + (2 if now else 0) + len(block) <= n:
            now = f"{now}\n\n{block}" if now else block
        else:
            out.append(now)
            now = block
    return out + ([now] if now else [])


@pytest.mark.parametrize("text", ["", "a", "a\n\nb\n\nc", "x" * 25, "ab\n\n" + "y" * 23 + "\n\ncd\n\nef", "\n\n\n\n", "abcde\n\nfghij\n\nklmno\n\np"])
def test_chunk_blocks(spark, text):
    got = C.chunk_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 10).orderBy("chunk_no").collect()
    assert [r.content for r in got] == pack(text, 10)


def test_heading_levels(spark):
    df = spark.createDataFrame([("第一章 总则",), ("第二节 范围",), ("1.2.3 细节",), ("## Two",), ("plain",), (None,)], "c string")
    assert [r[0] for r in df.select(T.heading_level("c")).collect()] == [1, 2, 3, 2, 0, 0]


def test_text_functions(spark):
    assert one(spark, T.value_shape(F.lit("120万元"))) == "money" and one(spark, T.value_shape(F.lit("2023年5月6日"))) == "date" and one(spark, T.value_shape(F.lit(""))) == "empty"
    assert one(spark, T.predicate_norm(F.lit("要求为："))) == "要求为"[:2] or one(spark, T.predicate_norm(F.lit("名称为"))) == "名称"
    assert one(spark, T.query_type(F.lit("有哪些规定"))) == "rule_qa" and one(spark, T.query_type(F.lit("x"))) == "document_lookup"
    assert one(spark, T.query_tokens(F.lit("数据治理平台 api"))) == ["数据治理平台", "数据治理", "据治理平", "治理平台", "数据", "据治", "治理", "理平", "平台", "api"]
    assert one(spark, T.governed_value(F.lit("名称"), F.lit("系统名称：甲"), F.lit("v"))) == "甲"
    assert one(spark, P.nfkc(F.lit(" Ａｂ　１ "))) == "ab1"
    assert one(spark, O.is_candidate_term(F.lit("《数据治理平台》.docx"))) and not one(spark, O.is_candidate_term(F.lit("第一章")))


def test_rule_fields(spark):
    f = one(spark, U.rule_fields(F.lit("经主管部门批准，住宿费不得超过规定标准。特殊情况另行申请。")))
    assert f.conditions == ["经主管部门批准"] and f.constraints and f.exceptions and f.approval_required


def test_graph_keys(spark):
    assert one(spark, G.fusion_key(F.lit("Organization"), F.lit("甲（北京）科技有限公司"))) == "甲北京科技"
    assert one(spark, G.state_key(F.lit("k"), F.lit(""), F.lit(None))) == "k:state:default" and one(spark, G.state_key(F.lit("k"), F.lit("2020"), F.lit(""))) == "k:state:2020:"
    assert one(spark, G.attribute_key(F.lit("项目预算"), F.lit("30万元"))).key == "经费" and one(spark, G.attribute_key(F.lit("建设"), F.lit("30万元"))) is None
    assert one(spark, G.is_evolution(F.lit("升级为"), F.lit(""))) and not one(spark, G.is_evolution(F.lit("建设"), F.lit("升级")))


def test_bind_facts(spark):
    facts = spark.createDataFrame([("1", "甲", "使用", "乙", "relation"), ("2", "甲", "版本", "3", "relation"), ("3", "甲", "等于", "甲", "relation"), ("4", "甲", "使用", "乙", "relation"), ("5", "丙", "使用", "甲", "relation"), ("6", "", "使用", "甲", "relation")], "fact_id string, subject string, predicate string, object string, fact_kind string")
    entities = spark.createDataFrame([("a", "甲", "org"), ("b", "乙", "org")], "entity_id string, name string, entity_type string")
    kept, grown, dropped = G.bind_facts(facts, entities)
    assert {(r.fact_id, r.fact_kind, r.object_id) for r in kept.collect()} == {("1", "relation_fact", "b"), ("2", "attribute_fact", None), ("5", "relation_fact", "a")}
    assert {r.reason: r.n for r in dropped.collect()} == {"kept": 3, "self_loop": 1, "repeat": 1, "no_subject": 1}
    assert {r.name for r in grown.collect()} == {"甲", "乙", "丙"}


@pytest.mark.parametrize(("raw", "status"), [('{"a": 1}', "ok"), ('text {"a": [1, 2', "repaired"), ('{"a": 3", "b": "x"}', "repaired"), ('{"a": "line\nbreak"}', "repaired"), ("nothing", "failed"), (None, "failed")])
def test_json_repair(raw, status):
    assert P.repair_json(raw)[0] == status


def test_model_failures_stay_rows(spark):
    def provider(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return "{}"

    got = P.model_batch(spark.createDataFrame([("bad",), ("good",), (None,)], "prompt string"), "prompt", provider).collect()
    assert [(r.answer, r.model_error) for r in got] == [(None, "ValueError: no"), ("{}", None), ("{}", None)]


def test_parse_documents(spark):
    def parser(name, content):
        if name == "b":
            raise ValueError("broken")
        return [(None, x) for x in content.decode().split(" ")]

    df = spark.createDataFrame([(1, "a", bytearray(b"x y")), (2, "b", bytearray(b"z"))], "id long, name string, content binary")
    got = I.parse_documents(df, parser, id_col="id", name_col="name", content_col="content").collect()
    assert [(r.id, r.chunk_no, r.content, r.error) for r in got] == [(1, 0, "x", None), (1, 1, "y", None), (2, 0, None, "ValueError: broken")]


def test_scan_inventory(spark, tmp_path):
    for n in ("a.txt", "b.md", "~$c.txt", "d/e.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(n)
    assert {r.name for r in I.scan_inventory(spark, str(tmp_path), ["*.txt"], ["a*"]).collect()} == {"e.txt"}


def test_near_groups(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    got = {r.key: r.seed for r in G.near_groups(pairs).collect()}
    linked = {("a", "b"), ("b", "c"), ("x", "y")}
    assert set(got) == set("abcxy") and all(k == s or (min(k, s), max(k, s)) in linked for k, s in got.items())
    seeds = {k for k, s in got.items() if k == s}
    assert not any(a in seeds and b in seeds for a, b in linked)


def test_mmr_caps(spark):
    rows = [(1, f"i{i:03d}", i % 3, 1.0 - i / 100, f"text number {i} of its own words {i * 7}") for i in range(40)]
    got = O.select_evidence_mmr(spark.createDataFrame(rows, "domain_id int, item_id string, doc_id int, score double, text string"), 12, 4, 4).toPandas()
    assert len(got) == 12 and got["doc_id"].value_counts().max() == 4 and got["place"].tolist() == list(range(1, 13))


def test_vector_topk_ties_and_lengths(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(99, [1.0, 0.0, 0.0]), (98, [0.0, 0.0])], "item_id long, vector array<double>")
    got = S.vector_topk(spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, vector array<double>"), v, 5).orderBy("rank").collect()
    assert [r.item_id for r in got] == [0, 1, 2, 3, 4]


def test_stream_ingest(spark, tmp_path):
    src, target = tmp_path / "in", tmp_path / "out"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    df.write.parquet(str(src))
    stream = lambda: spark.readStream.schema("k long, v string").parquet(str(src))
    X.stream_ingest(stream(), str(target), ["k"], str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string").write.mode("append").parquet(str(src))
    X.stream_ingest(stream(), str(target), ["k"], str(tmp_path / "cp")).awaitTermination()
    rows = lambda **kw: sorted(map(tuple, X.current_rows(spark, str(target), **kw).select("k", "v").collect()))
    assert rows() == [(1, "a"), (2, "c"), (3, "d")] and rows(before=1) == [(1, "a"), (2, "b")]
    new = {str(f.relative_to(target)).split("/")[0] for f in target.rglob("version=1")}
    assert new and len(new) <= 2  # only the buckets of the second batch's keys were written again


def test_stream_ingest_keeps_two_versions(spark, tmp_path):
    """Twelve batches: the newest row of each key, whatever the order in a batch, and never more than two versions a bucket."""
    src, target = tmp_path / "in", tmp_path / "out"
    want = {}
    for batch in range(12):
        rows = [(k % 7, batch * 10 + k, f"v{batch}-{k}") for k in range(batch % 5 + 3)] + [(1, batch * 10 - 5, "older")]
        for k, at, v in sorted(rows, key=lambda r: (r[1], r[2])):
            want[k] = (at, v)
        spark.createDataFrame(rows, "k long, at long, v string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("k long, at long, v string").parquet(str(src))
        X.stream_ingest(stream, str(target), ["k"], str(tmp_path / "cp"), buckets=4, newest=["at"]).awaitTermination()
        assert {r.k: (r.at, r.v) for r in X.current_rows(spark, str(target)).collect()} == want
        assert all(len(list(b.glob("version=*"))) <= 2 for b in target.glob("bucket=*"))


def test_stale_detector_stream(spark, tmp_path):
    """A running job that stays silent becomes stale by a timer; one that ends does not."""
    src = tmp_path / "in"
    for i, rows in enumerate([[(1, "running", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:00:00")], [(2, "success", "2024-01-01 00:10:00")], [(3, "running", "2024-01-01 03:00:00")], [(4, "queued", "2024-01-01 03:05:00")]]):
        spark.createDataFrame(rows, "file_id long, status string, at string").select("file_id", "status", F.to_timestamp("at").alias("ts")).coalesce(1).write.parquet(str(src / f"{i}"))
    out = str(tmp_path / "out")
    live = tmp_path / "live"
    live.mkdir()
    for i in range(4):  # one file a run, so that the watermark moves between them
        for f in (src / f"{i}").glob("*.parquet"):
            f.rename(live / f"{i}-{f.name}")
        stream = spark.readStream.schema("file_id long, status string, ts timestamp").parquet(str(live))
        q = X.stale_detector(stream, 60 * 60 * 1000).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [(r.file_id, r.status, r.stale) for r in spark.read.parquet(out).collect()]
    assert (1, "failed", True) in got and not any(x[0] == 2 and x[2] for x in got) and (2, "success", False) in got


def test_split_late(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-03",)], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    fine, late = X.split_late(df, pd.Timestamp("2024-01-02"))
    assert fine.count() == late.count() == 1


def test_embed_texts_retries(spark):
    def provider(texts):
        if any(len(t) > 1000 for t in texts):
            raise ValueError("too long")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "short", None), (2, "x" * 3000, "y")], "k int, title string, content string")
    got = {r.k: (r.vector, r.embed_error) for r in P.embed_texts(df, ["title", "content"], provider).collect()}
    assert got == {1: ([5.0], None), 2: ([1000.0], None)}


def test_possible_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, "A title", base, "rule", 10), (2, "A title", base + " more", "rule", 10), (3, "Other", "nothing like it at all in here", "rule", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string, doc_type string, size long")
    got = {r.doc_id: r.other_id for r in D.possible_duplicates(docs).collect()}
    assert got == {1: 2, 2: 1}


def test_possible_duplicates_of_copies(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(i, "A title", base, "rule", len(base)) for i in (5, 7, 9)]
    rows += [(2, "A title", base + " more", "rule", len(base) + 5), (3, "A title", base.replace("word150 ", "word150  "), "rule", len(base) + 1), (4, "A title", base, "report", len(base))]
    rows += [(20, "B", "all alone with its own words", None, None), (21, "C", "short text", "rule", 10), (22, "C", "short text", "report", 10), (23, "D", "", "rule", 0), (24, "D", "", "rule", 0)]
    got = {r.doc_id: r for r in D.possible_duplicates(spark.createDataFrame(rows, "doc_id long, title string, text string, doc_type string, size long")).collect()}
    texts = {r[0]: r for r in rows[:6]}

    def score(x, y):
        (_, t, p, k, n), (_, u, q, m, o) = texts[min(x, y)], texts[max(x, y)]
        return round(0.45 * SequenceMatcher(None, t, u).ratio() + 0.45 * SequenceMatcher(None, p[:1200], q[:1200]).ratio() + 0.1 * (k == m) + 0.1 * (min(n, o) >= 0.9 * max(n, o)), 6)

    want = {x: min((-score(x, y), y) for y in texts if y != x) for x in texts}
    assert max(want.values())[0] <= -0.82 and {x: (-got[x].score, got[x].other_id) for x in texts} == want
    assert {x: (got[x].other_id, got[x].score) for x in got if x not in texts} == {21: (22, 1.0), 22: (21, 1.0)}
    assert {r.doc_id: r.representative for r in D.shingle_members(spark.createDataFrame([r[:3] for r in rows], "doc_id long, title string, text string")).collect()} == {2: 2, 3: 3, 4: 3, 5: 3, 7: 3, 9: 3, 20: 20, 21: 21, 22: 21}


def test_related_documents_reads_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    head, body = prose("ab", 300), prose("acegikmoqsuwy ", 6000)
    texts = [f"one title\n{head}{body}", f"one title\n{head}{body[::-1]}", f"one title\n{prose('yz', 300)}{body}"]
    rows = [(100 * i, t, "en", "s", len(t)) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    score = {(r.doc_id // 100, r.other_id // 100): r.score for r in registry.QUERIES["related_documents"](spark, str(tmp_path)).collect()}
    assert score[1, 2] < 0.99
    whole = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", S.hash_embedding("text", most=2**31 - 1).alias("v"))
    v = {r.doc_id // 100: np.array(r.v) for r in whole.collect()}
    want = {i: [0.0] * 32 for i in v}
    for i, t in enumerate(texts, 1):
        for at, c in enumerate(t):
            want[i][at % 32] += ord(c) % 97 / 97
    assert all(np.allclose(v[i], np.array(want[i]) / np.linalg.norm(want[i])) for i in v)
    grams = lambda t: {w[j : j + 3] for x in re.findall(r"[a-z0-9]+", t) for w in [f"  {x} "] for j in range(len(w) - 2)}
    for a, b in ((1, 2), (1, 3), (2, 3)):
        x, y = grams(texts[a - 1][:2000]), grams(texts[b - 1][:2000])
        assert score[a, b] == pytest.approx(0.25 + 0.15 * len(x & y) / len(x | y) + 0.6 * v[a] @ v[b], abs=2e-6)


def test_related_documents_exact_for_stated_queries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"common title t{i}", f"p{i} preview", f"h{i}", [float(x) for x in rng.normal(size=8)]) for i in range(1, 130)]
    rows += [(i, "copies", "same", "same", [1.0] * 8) for i in range(200, 210)]
    rows[9] = (10, "common title", "other words", "h10", rows[99][4])
    docs = spark.createDataFrame(rows, "doc_id long, title string, preview string, file_hash string, vector array<double>")
    got = D.related_documents(docs, docs.select("doc_id", "vector"), queries=docs.where("doc_id % 100 = 0"), blocks=7).collect()
    grams = lambda t: {w[j : j + 3] for x in t.split() for w in [f"  {x} "] for j in range(len(w) - 2)}
    alike = lambda x, y: len(grams(x) & grams(y)) / len(grams(x) | grams(y))
    cos = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    for q in (100, 200):
        _, t, p, h, v = next(r for r in rows if r[0] == q)
        best = sorted((-(1.0 if r[3] == h else round(0.25 * alike(t, r[1]) + 0.15 * alike(p, r[2]) + 0.6 * cos(v, r[4]), 6)), r[0]) for r in rows if r[0] != q)[:5]
        mine = sorted((r for r in got if r.doc_id == q), key=lambda r: r["rank"])
        assert [r.other_id for r in mine] == [i for _, i in best] and [r.score for r in mine] == pytest.approx([-s for s, _ in best], abs=2e-6)
    assert 10 in {r.other_id for r in got if r.doc_id == 100}
    assert {r.other_id for r in got if r.doc_id == 203} == {200, 201, 202, 204, 205}
    alone = D.related_documents(docs, docs.select("doc_id", "vector")).collect()
    assert {r.other_id for r in alone if r.doc_id == 200} == {201, 202, 203, 204, 205}
