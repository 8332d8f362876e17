"""Containment search, recall legs and evidence choice against plain versions."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarrydeck.functions import lexicons as L
from quarrydeck.operators import contain, documents, fuzzy, graph, names, recall, relational, retrieval, structure, topics



def test_holding_is_plain_containment(spark, monkeypatch):
    texts = ["本项目建设数据治理平台", "governance of data", "a%b_c", "", None, "DATA", "x" * 200_000 + "needle"]
    terms = ["数据治理", "govern", "data", "%", "_", "needle", "a", "", None, "absent"]
    items = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    want = {(i, x) for i, text in enumerate(texts) for x in terms if text and x and x in text}
    for most in (contain.MOST_TERMS, 3):  # several passes give the same rows
        got = contain.holding(items, ["id"], {"text": F.col("text")}, t, most_terms=most).collect()
        assert {(r.id, r.term) for r in got} == want and len(got) == len(want)
    assert contain.holding(items, ["id"], {"text": F.col("text")}, t.where("false")).count() == 0
    assert relational.containment_join(items, t, text=F.col("text"), id_col="id", term_col="term").count() == len(want)


def plain_leg(queries, chunks):
    out = set()
    for qid, query in queries:
        raw = (query or "").strip().lower()
        if not raw:
            continue
        tight = "".join(c for c in raw if c.isalnum())
        tokens = [x for x in raw.split() if len(x) >= 2]
        for i, title, content in chunks:
            title, content = title.lower(), content.lower()
            bare = "".join(c for c in title if c.isalnum())
            score = 2.4 * (raw in title) + 2.0 * (raw in content) + 1.2 * bool(tight and tight in bare) + sum(1.4 * (t in title) + 1.2 * (t in content) for t in tokens)
            if score > 0:
                out.add((qid, f"chunk:{i}:0", round(score, 6), "title" if raw in title else "content" if raw in content else "fulltext"))
    return out


@pytest.mark.parametrize("most", [4096, 2])
def test_keyword_leg_finds_what_like_finds(spark, monkeypatch, most):
    monkeypatch.setattr(contain, "MOST_QUERIES", most)
    monkeypatch.setattr(contain, "CELLS", 7)
    rng = random.Random(1)
    words = ["govern", "governance", "data", "Data", "plan", "of", "x", "planning", "mid-term"]
    chunks = [(i, " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(60)]
    queries = [("q1", "govern"), ("q2", "data plan"), ("q3", "of"), ("q4", " "), ("q5", None), ("q6", "absent word"), ("q7", "midterm")]
    c = spark.createDataFrame([(i, 0, t, x) for i, t, x in chunks], "doc_id long, chunk_no int, title string, content string")
    q = spark.createDataFrame(queries, "query_id string, query string")
    leg = lambda top=None: retrieval.keyword_leg(q, c, "chunk", ["doc_id", "chunk_no"], L.CHUNK_FIELDS, top).collect()
    want = plain_leg(queries, chunks)
    assert {(r.query_id, r.item_id, r.score, r.match_type) for r in leg()} == want
    ranked = {}
    for row in sorted(want, key=lambda r: (r[0], -r[2], r[1])):
        ranked.setdefault(row[0], []).append(row)
    best = {}
    for r in leg(5):  # each task keeps its own best; the query's best are among them
        best.setdefault(r.query_id, []).append((r.query_id, r.item_id, r.score, r.match_type))
    assert all(set(v[:5]) <= set(best[k]) for k, v in ranked.items())


def test_chinese_and_inner_words(spark):
    c = spark.createDataFrame([(1, 0, "", "本项目建设数据治理平台"), (2, 0, "", "misgovernment"), (3, 0, "", "nothing")], "doc_id long, chunk_no int, title string, content string")
    q = spark.createDataFrame([("a", "数据治理"), ("b", "govern")], "query_id string, query string")
    got = {(r.query_id, r.doc_id) for r in retrieval.keyword_leg(q, c, "chunk", ["doc_id", "chunk_no"], L.CHUNK_FIELDS).collect()}
    assert got == {("a", 1), ("b", 2)}
    items = spark.createDataFrame([(1, "i1", "含数据治理一节"), (1, "i2", "别的"), (2, "i1", "含数据治理一节")], "domain_id int, item_id string, content string")
    ex = spark.createDataFrame([(1, "数据治理")], "domain_id int, phrase string")
    assert {(r.domain_id, r.item_id) for r in topics.filter_excluded(items, ex, ["content"]).collect()} == {(1, "i2"), (2, "i1")}


def test_nearest_keeps_the_best_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(contain, "MOST_QUERIES", 2)
    rng = random.Random(5)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    items, queries = [(f"i{n:03d}", vec()) for n in range(200)], [(n, vec()) for n in range(7)]
    got = retrieval.vector_topk(spark.createDataFrame(queries, "query_id long, vector array<double>"), spark.createDataFrame(items, "item_id string, vector array<double>"), 6).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.dist(a, [0] * 4) / math.dist(b, [0] * 4)
    want = {(q, r + 1, i) for q, v in queries for r, (_, i) in enumerate(sorted((-round(cos(v, w), 6), i) for i, w in items if round(cos(v, w), 6) > 0.05)[:6])}
    assert {(r.query_id, r["rank"], r.item_id) for r in got} == want


def plain_choice(rows, n, soft, hard):
    """The greedy choice as it is defined, without any short cut."""

    def overlap(a, b):
        sample = min(len(a), len(b), 180)
        if not a or not b:
            return 0.0
        if sample < 12:
            return float(a == b)
        pieces = [a[i : i + 4] for i in range(0, sample - 3, 4)]
        pieces = [p for p in pieces if p.strip()]
        return sum(p in b for p in pieces) / len(pieces)

    strength = {}
    for _, doc, score, _ in rows:
        strength[doc] = max(strength.get(doc, -math.inf), score)
    top = max(strength.values()) if max(strength.values()) > 0 else 1.0
    cap = {d: max(soft, min(hard, math.ceil(soft + (hard - soft) * max(0, min(1, s / top)) * 0.6))) for d, s in strength.items()}
    chosen, used = [], {}
    while len(chosen) < n:
        best, value = None, -math.inf
        for r in rows:
            if r in chosen or used.get(r[1], 0) >= cap[r[1]]:
                continue
            near = max((0.28 * (r[1] == c[1]) + 0.72 * overlap(r[3], c[3]) for c in chosen), default=0)
            own = r[2] if not chosen else 0.78 * r[2] - 1.25 * near - 0.35 * used.get(r[1], 0)
            if own > value:
                best, value = r, own
        if best is None:
            break
        chosen.append(best)
        used[best[1]] = used.get(best[1], 0) + 1
    for r in rows:
        if len(chosen) < n and r not in chosen and used.get(r[1], 0) < hard:
            chosen.append(r)
            used[r[1]] = used.get(r[1], 0) + 1
    return [r[0] for r in chosen]


@pytest.mark.parametrize("seed", range(6))
def test_evidence_choice(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]
    rows = [(f"i{n:03d}", rng.randrange(4), round(rng.random() * rng.choice([1, 9]), 3), "".join(rng.choices(words, k=rng.randint(0, 9)))) for n in range(70)]
    rows.sort(key=lambda r: (-r[2], r[0]))
    n, soft, hard = rng.choice([(5, 2, 4), (20, 1, 3), (30, 3, 12), (100, 2, 9)])
    df = spark.createDataFrame([(1, *r) for r in rows], "domain_id int, item_id string, doc_id int, score double, text string")
    got = topics.select_evidence_mmr(df, n, soft, hard).orderBy("place").collect()
    assert [r.item_id for r in got] == plain_choice(rows, n, soft, hard)


def test_evidence_choice_of_many_documents(spark):
    """More documents than choices, so that rows far below the n-th document's best are cut; and a large domain in short time."""
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]
    rows = [(f"i{n:04d}", rng.randrange(60), round(rng.uniform(0.35, 4), 3), " ".join(rng.choices(words, k=rng.randint(3, 12)))) for n in range(400)]
    rows.sort(key=lambda r: (-r[2], r[0]))
    plain = plain_choice([(i, d, s, t.replace(" ", "")) for i, d, s, t in rows], 20, 2, 5)
    df = spark.createDataFrame([(1, *r) for r in rows], "domain_id int, item_id string, doc_id int, score double, text string")
    assert [r.item_id for r in topics.select_evidence_mmr(df, 20, 2, 5).orderBy("place").collect()] == plain
    many = [(f"i{n}", n % 900, round(rng.uniform(0.35, 4), 3), " ".join(rng.choices(words, k=20))) for n in range(20_000)]
    many.sort(key=lambda r: (-r[2], r[0]))
    start = time.perf_counter()
    assert len(topics.choose_evidence(many, 160, 12, 48)) == 160
    assert time.perf_counter() - start < 5


def plain_grams(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


@pytest.mark.parametrize("most", [4096, 3])
def test_fuzzy_leg_against_all_pairs(spark, most):
    rng = random.Random(4)
    words = ["governance", "data", "platform", "Ünïcode", "数据治理", "a", "x9", "naïve", "report"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(80)] + [None, "", "--", "governance " * 3000, "word" * 5000]
    items = [(f"k{i}", t, rng.choice(texts)) for i, t in enumerate(texts)] + [("k1", texts[1], None)]
    asked = [(f"q{i}", t) for i, t in enumerate(["govrnance", "dat platfrom", "数据治", "naive", "", None, "?!", "report 2020 x9", "governance data", "zzz"])]
    least = 0.05
    want = []
    for q, query in asked:
        for k, *own in items:
            score = max(len(g & plain_grams(query)) / max(len(g | plain_grams(query)), 1) for g in map(plain_grams, own))
            if score > least:
                want.append((q, k, score))
    queries = spark.createDataFrame(asked, "query_id string, query string")
    df = spark.createDataFrame([(*i, "clash") for i in items], "key string, a string, b string, score string").repartition(5)
    got = [tuple(r) for r in fuzzy.fuzzy_leg(queries, df, "key", ["a", "b"], most=most).collect()]
    assert sorted(got) == sorted(want) and {q for q, *_ in got} >= {"q0", "q1", "q2", "q3"}
    best = []
    for q, _ in asked:
        best += sorted((x for x in want if x[0] == q), key=lambda x: (-x[2], x[1]))[:7]
    assert sorted(map(tuple, fuzzy.fuzzy_leg(queries, df, "key", ["a", "b"], top=7, most=most).collect())) == sorted(best)
    assert fuzzy.fuzzy_leg(queries.where("false"), df, "key", ["a"]).count() == fuzzy.fuzzy_leg(queries, df.where("false"), "key", ["a"], top=3).count() == 0


def test_fts_rank_is_cover_density(spark):
    """Covers by their definition: stretches with all terms of which no shorter stretch inside has all."""
    rng = random.Random(6)
    weights = {"A": 1.0, "B": 0.4}
    docs = [(i, " ".join(rng.choices("abcdef", k=rng.randint(0, 4))), " ".join(rng.choices("abcdefghij", k=rng.randint(0, 40)))) for i in range(60)]
    asked = {"q1": ["a"], "q2": ["a", "b"], "q3": ["c", "d", "e"], "q4": ["j", "zz"], "q5": list("abcde")}
    want = {}
    for i, title, text in docs:
        words = [(w, weights["A"]) for w in title.split()] + [(w, weights["B"]) for w in text.split()]
        for q, terms in asked.items():
            at = [p for p, (w, _) in enumerate(words) if w in terms]
            whole = [(b, e) for b in at for e in at if b <= e and set(terms) <= {w for w, _ in words[b : e + 1]}]
            covers = [c for c in whole if not any(o != c and o[0] >= c[0] and o[1] <= c[1] for o in whole)]
            if covers:
                rank = 0.0
                for b, e in covers:
                    own = [w for t, w in words[b : e + 1] if t in terms]
                    rank += len(own) / sum(1 / w for w in own) / (1 + (e - b + 1 - len(own)))
                want[q, i] = (len(covers), rank)
    df = spark.createDataFrame(docs + [(99, None, None)], "doc_id int, title string, text string")
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts + ts[:1]], "query_id string, term string")
    got = {(r.query_id, r.doc_id): (r.covers, r["rank"]) for r in retrieval.fts_rank(retrieval.weighted_postings(df, "doc_id", [("title", "A"), ("text", "B")], terms), terms).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)
    assert retrieval.fts_rank(retrieval.weighted_postings(df, "doc_id", [("title", "A")], terms), terms.where("false")).count() == 0


def test_possible_duplicates_against_all_pairs(spark):
    """Every link of shingle sets at .8 or more is found, copies included; scores and partners are those of all pairs."""
    from difflib import SequenceMatcher

    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(12)]
    docs = []
    for i, text in enumerate(base):
        words = text.split()
        docs += [text, text, " ".join(words[:60] + ["other"] + words[61:]), " ".join(words[:100] + ["tail"] * 3), " ".join(rng.sample(words, len(words)))]
    rows = [(i, f"title {i // 5}", t, "a" if i % 2 else "b", len(t)) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, title string, text string, doc_type string, size long")
    got = {r.doc_id: (r.other_id, r.score) for r in documents.possible_duplicates(df).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in docs]
    want, links = {}, 0
    for i, a in enumerate(rows):
        found = []
        for j, b in enumerate(rows):
            if i == j or len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]):
                continue
            links += 1
            x, y = (a, b) if i < j else (b, a)
            ratio = lambda c, d: SequenceMatcher(None, c, d).ratio()
            score = 0.45 * ratio(x[1], y[1]) + 0.45 * ratio(x[2][:1200], y[2][:1200]) + 0.1 * (a[3] == b[3]) + 0.1 * (min(a[4], b[4]) / max(a[4], b[4]) >= 0.9)
            if round(score, 6) >= 0.82:
                found.append((-round(score, 6), j))
        if found:
            want[i] = min(found)
    assert links > 40 and set(got) == set(want)
    assert all(got[i][1] == pytest.approx(-want[i][0], abs=2e-2) for i in want)


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 1.0])
def test_set_links_are_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 10))
    sets = [frozenset(rng.choices(range(30), k=rng.randint(1, 14))) for _ in range(50)]
    sets += [frozenset(list(x)[1:] + [rng.randrange(60)]) for x in sets[:30] if len(x) > 1] + [frozenset(range(100, 100 + n)) for n in (1, 2, 40, 41, 45)]
    sets = list(dict.fromkeys(sets))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= threshold * len(a | b) - 1e-9}
    got = documents.set_links(spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "doc_id long, s array<long>"), threshold).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and (want or threshold == 1.0)


def test_possible_duplicates_with_other_tails(spark):
    """Against all pairs of the rule itself: equal or nearly equal titles and heads with tails of their own, copies, and others."""
    from difflib import SequenceMatcher

    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH", k=rng.randint(3, 9))) for _ in range(n))
    rows = []
    for i in range(8):
        title, head = f"Report {prose(3)}", prose(240)
        for k in range(4):
            words = head.split()
            if k == 2:
                words[40] = "changed"
            rows.append((len(rows), title if k < 3 else title.replace("Report", "Reports"), " ".join(words) + " " + prose(300), "a", 4000))
    rows += [(len(rows) + i, *rows[i][1:]) for i in range(3)] + [(90, "", "", "a", 0), (91, "", "", "a", 0), (92, None, rows[0][2], "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, title string, text string, doc_type string, size long")
    got = {r.doc_id: r.score for r in documents.possible_duplicates(df).collect()}
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    want = {}
    for i, t, x, kind, size in rows:
        for j, u, y, other, n in rows:
            if i != j and x and y:
                (c, d), (e, f) = ((t, u), (x[:1200], y[:1200])) if i < j else ((u, t), (y[:1200], x[:1200]))
                score = 0.45 * ratio(c, d) + 0.45 * ratio(e, f) + 0.1 * (kind == other) + 0.1 * bool(size and n and min(size, n) / max(size, n) >= 0.9)
                if round(score, 6) >= 0.82:
                    want[i] = max(want.get(i, 0), round(score, 6))
    assert len(want) >= 25 and set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=2e-2) for i in want)


def test_chunk_blocks_packs_greedily(spark):
    rng = random.Random(2)
    texts = ["\n\n".join("x" * rng.choice([0, 1, 5, 30, 95, 250]) for _ in range(rng.randint(0, 12))) for _ in range(40)] + [None, "", "\r\n\r\n a \r\n\r\n b"]

    def plain(text, most=100):
        out, now = [], ""
        blocks = [b.strip() for b in __import__("re").split(r"\n\s*\n", (text or "").replace("\r\n", "\n").replace("\r", "\n"))]
        for b in filter(None, blocks):
            if len(b) > most:
                out += [now] if now else []
                out += [b[i : i + most] for i in range(0, len(b), most)]
                now = ""
            elif now and len(now) + 2 + len(b) > most:
                out.append(now)
                now = b
            else:
                now = f"{now}\n\n{b}" if now else b
        return out + ([now] if now else [])

    from quarrydeck.operators import chunks as C

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in C.chunk_blocks(df, 100).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {i: plain(t) for i, t in enumerate(texts) if plain(t)}


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(names.is_article_title(F.lit("关于数据治理平台的建设方案"))) and not one(names.is_article_title(F.lit("关于治理方案"))) and not one(names.is_article_title(F.lit("数据治理平台建设研究")))
    assert one(names.is_generic_term(F.lit(" 知识_库 "))) and not one(names.is_generic_term(F.lit("数据治理")))
    hidden = lambda n, t="project": one(names.is_hidden_entity(F.lit(n), F.lit(t), ("scan_",)))
    assert hidden("HYPERLINK") and hidden("plan.DOCX") and hidden("plan_2024") and hidden(" ") and hidden("x", "Document") and hidden("Scan_a") and not hidden("Data platform") and not hidden("plan_20")
    docs = spark.createDataFrame([(1, "Data Plan", "data-plan.docx", "in/2024/data-plan.docx")], "doc_id long, title string, filename string, path string")
    e = spark.createDataFrame([(1, "data plan", "project"), (1, "《Data-Plan》", "project"), (1, "in/2024/data-plan", "project"), (1, "Plan", "project"), (2, "data plan", "project")], "doc_id long, name string, entity_type string")
    assert [r.source_artifact for r in names.mark_source_artifacts(e, docs).orderBy("doc_id", "name").collect()] == [False, True, True, True, False]


def test_scope_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(names.fragments(F.lit("请问数据治理和平台建设：怎么管理（试行）吗？a"))) == ["数据治理", "平台建设", "管理 试行"]
    long = "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸子丑"
    got = one(names.fragments(F.lit(long)))
    assert got[0] == long and long[:6] in got and long[-6:] in got and long[8:14] in got and all(len(x) == 22 or 6 <= len(x) <= 20 for x in got)
    df = spark.createDataFrame([(1, ["旧系统"], ["建设平台，不包括财务系统与人事；其他", None]), (2, None, None)], "domain_id int, rules array<string>, texts array<string>")
    assert [(r.domain_id, r.phrase) for r in names.excluded_terms(df).orderBy("domain_id", "place").collect()] == [(1, "旧系统"), (1, "财务系统"), (1, "人事")]


def test_dimension_backfill(spark):
    items = spark.createDataFrame([("u1", 1, "unit", "audit", "x"), ("c1", 1, "chunk", "", "audit"), ("c2", 2, "chunk", "", "audit rules"), ("c3", 2, "chunk", "", "other")], "item_id string, doc_id int, kind string, title string, content string")
    dims = spark.createDataFrame([(1, "a", ["Audit "]), (1, "b", ["absent"])], "domain_id int, dimension string, terms array<string>")
    got = {(r.item_id, r["pass"]): r.score for r in recall.recall_dimensions(dims, items, spark.createDataFrame([(1, 1)], "domain_id int, doc_id int"), 3).collect()}
    assert got == {("u1", "recall"): 2.7 * 1.25 * 2, ("c1", "recall"): 2.7, ("c2", "backfill"): 0.88}
    enough = recall.recall_dimensions(dims, items, spark.createDataFrame([(1, 1)], "domain_id int, doc_id int"), 2).collect()
    assert {r["pass"] for r in enough} == {"recall"}


def test_state_signatures(spark):
    rows = [("平台", "平台一期", "", ""), ("平台", "平台 v2", "", ""), ("平台", "平台升级", "2024", ""), ("平台", "平台在用", "2024", "2025"), ("平台", "平台核心系统。", "", ""), ("平台", "平台指在用状态", "", "")]
    df = spark.createDataFrame(rows, "n string, t string, a string, b string").select(graph.state_signature("n", "t", "a", "b").alias("s"))
    assert [r.s for r in df.collect()] == ["phase:1", "phase:2", "phase:upgrade", "time:2024|2025", "default", "text:在用状态"]


def test_shared_folder():
    from types import SimpleNamespace

    from quarrydeck.functions.lineage import shared_folder

    session = lambda master, folder=None: SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("spark://x", "hdfs://y")) == "hdfs://y" and shared_folder(session("local[2]"))
    with pytest.raises(ValueError):
        shared_folder(session("yarn"))


def test_structure_facts(spark):
    """Anchor by the document's title, parents by title and keyword, reverse facts, and names that stay out."""
    chunks = [
        (1, 0, "数据治理平台建设方案", "数据质量标准 校验规则", ["校验"]),
        (1, 1, "数据治理平台建设方案", "校验规则 数据质量标准", ["校验"]),
        (1, 2, "数据治理平台建设方案", "3.2", ["校验"]),
        (2, 0, "other", "a part of it", ["校验规则", "采集"]),
        (3, 0, None, None, None),
        (4, 0, "数据治理平台建设方案", "日志接口", []),
    ]
    names = {"数据治理平台": "system", "平台": "system", "数据质量标准": "standard", "校验规则": "requirement", "采集": "process", "日志接口": "concept", "三月": "time", "备注": "concept", "总体政策、附则": "policy"}
    every = [(d, n, f"{k}:{x}", x, k) for d, n, *_ in chunks[:3] for x, k in names.items() if x not in ("采集", "日志接口")]
    every += [(2, 0, "requirement:校验规则", "校验规则", "requirement"), (2, 0, "process:采集", "采集", "process"), (2, 0, "standard:采集标准", "采集标准", "standard"), (4, 0, "concept:日志接口", "日志接口", "concept"), (3, 0, "system:数据治理平台", "数据治理平台", "system")]
    c = spark.createDataFrame(chunks, "doc_id int, chunk_no int, doc_title string, title string, keywords array<string>")
    m = spark.createDataFrame(every + every[:3], "doc_id int, chunk_no int, key string, name string, entity_type string")
    found = {(r.doc_id, r.chunk_no): r.anchor for r in structure.anchors(c, m).collect()}
    assert found[1, 0] == found[4, 0] == "system:数据治理平台" and found[2, 0] == "standard:采集标准" and (3, 0) not in found
    got = {(r.subject.split(":")[1], r.object.split(":")[1]): (r.role, r.confidence, r.evidence) for r in structure.enhance_structure(c, m).collect()}
    assert got[("校验规则", "数据质量标准")] == ("local_parent_child", 0.72, 2) and ("数据质量标准", "校验规则") not in got
    assert got[("数据治理平台", "校验规则")][:2] == ("anchor_parent", 0.74) and got[("数据治理平台", "日志接口")] == ("anchor_child", 0.72, 1)
    assert got[("采集", "校验规则")] == ("local_parent_child", 0.68, 1) and ("校验规则", "采集") not in got  # the shorter subject stays
    assert not {x for pair in got for x in pair} & {"平台", "三月", "备注", "总体政策、附则"}
    none = structure.enhance_structure(c, m, spark.createDataFrame([("concept:日志接口",)], "key string"))
    assert ("数据治理平台", "日志接口") not in {(r.subject.split(":")[1], r.object.split(":")[1]) for r in none.collect()}
    assert structure.enhance_structure(c.where("false"), m).count() == structure.enhance_structure(c, m.where("false")).count() == 0


@pytest.mark.parametrize("seed,same,hub", [(1, False, 1 << 16), (2, True, 1 << 16), (3, False, 3)])
def test_entity_paths_against_a_walk(spark, seed, same, hub, monkeypatch):
    """All simple paths of 2 to 4 facts, over any predicate or given ones; hubs are dealt over lanes."""
    monkeypatch.setattr(graph, "HUB_ROWS", hub)
    rng = random.Random(seed)
    facts = [(f"f{i}", f"n{rng.choice([0, 0, rng.randrange(9)])}", f"n{rng.randrange(9)}", rng.choice("pqr"), rng.choice(["", "2020"]), 0.5) for i in range(26)]
    df = spark.createDataFrame([(i, s, "t", o, "t", p, v, "", c) for i, s, o, p, v, c in facts] + [("x", "n0", "t", "value", None, "p", "", "", 1.0)], "fact_id string, subject string, subject_type string, object string, object_type string, predicate string, valid_from string, valid_to string, confidence double")
    state = lambda n, v: f"t:{n}:state:" + (f"{v}:" if v else "default")
    edges = [(a, state(a, v), i, p, state(b, v), b) for i, s, o, p, v, _ in facts for a, b in ((s, o), (o, s))]
    for steps in ([None] * 4, [["p"], ["q", "r"], ["p", "q"]]):
        want = []

        def walk(at, now, seen, path, states, steps=steps, want=want):
            if len(path) >= 2:
                want.append((f"t:{seen[0]}", f"t:{at}", path, states))
            if len(path) < len(steps):
                allowed = steps[len(path)]
                for src, left, i, p, reached, dst in edges:
                    if src == at and dst not in seen and (allowed is None or p in allowed) and (not same or now in (None, left)):
                        walk(dst, reached, seen + [dst], path + [i], states + [left, reached])

        for start in ("n0", "n1", "gone"):
            walk(start, None, [start], [], [])
        starts = spark.createDataFrame([("t:n0",), ("t:n1",), ("t:n1",), ("t:gone",)], "key string")
        got = graph.entity_paths(graph.state_edges(df), starts, steps, same_state=same).collect()
        assert want and sorted((r.start, r.end, r.path, r.states) for r in got) == sorted(want)
        assert all(r.n_facts == len(r.path) and r.confidence == pytest.approx(0.5**r.n_facts) for r in got)


def test_unified_search_modes(spark):
    """Exact queries keep chunks beside their units and put them first; others hide them; equal titles of a document count once."""
    queries = spark.createDataFrame([("q", "data"), ("x", '"data"')], "query_id string, query string")
    unit = [(1, 0, 5.0, "title", "T", "a"), (1, 1, 4.0, "title", " t ", "b"), (1, 2, 3.0, "content", "T", "c"), (1, 3, 2.9, "content", "T", "C "), (2, 0, 1.0, None, "", None)]
    chunk = [(1, 0, 5.0, "content", "U", "u"), (1, 9, 2.0, "content", "V", "v"), (1, 8, 1.5, "content", "W", "w"), (3, 0, 1.0, "content", "Z", "z")]
    side = lambda rows: spark.createDataFrame([(q, *r) for q in "qx" for r in rows], "query_id string, doc_id int, chunk_no int, score double, match_type string, title string, span string")
    got = retrieval.unified_search(queries, side(unit), side(chunk), 20).orderBy("query_id", "place").collect()
    rows = {q: [(r.kind, r.doc_id, r.chunk_no) for r in got if r.query_id == q] for q in "qx"}
    assert rows["q"] == [("unit", 1, 0), ("unit", 1, 2), ("chunk", 1, 9), ("unit", 2, 0), ("chunk", 3, 0), ("chunk", 1, 8)]
    assert rows["x"] == [("chunk", 1, 0), ("unit", 1, 0), ("chunk", 3, 0), ("unit", 2, 0), ("unit", 1, 2), ("chunk", 1, 9), ("chunk", 1, 8)]
    assert [r.place for r in retrieval.unified_search(queries, side(unit), side(chunk), 2, 2).where("query_id = 'q'").orderBy("place").collect()] == [3, 4]
