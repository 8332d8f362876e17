"""Hard negatives, source divergence and decontamination against brute-force versions, and their odd cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrydeck.llm import hard_negatives, source_divergence, winnow_decontam

# op11 ----------------------------------------------------------------------------------------------------------------


def brute_negatives(rows):
    ints = [(i, label, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v, label in rows]
    out = []
    for at, (a, own, x) in enumerate(ints):
        if a % 100:
            continue
        scored = [(-int(x @ y), i, label) for n, (i, label, y) in enumerate(ints) if n != at and len(y) == len(x)]
        for top, positive, _ in sorted(s for s in scored if s[2] == own)[:5]:
            fit = sorted(s for s in scored if s[2] != own and 80 * -top <= 100 * -s[0] <= 100 * -top)[:5]
            out += [(a, positive, r + 1, i, -top, -s) for r, (s, i, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("seed,blocks", [(1, (4096, 16384)), (2, (64, 2))])
def test_hard_negatives(spark, seed, blocks, monkeypatch):
    """A hot vector, a hot label, rows that repeat or share an id, over one block and over many."""
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", blocks[1])
    rng = np.random.default_rng(seed)
    hub = rng.normal(size=6)
    rows = [(int(i), [float(x) for x in (hub if i % 3 == 0 else np.round(rng.normal(size=6), 2))], int(rng.integers(4)) if i % 2 else 0) for i in range(501)]
    rows += [(100, rows[100][1], rows[100][2]), (200, rows[7][1], rows[200][2]), (200, rows[200][1], rows[200][2]), (200, rows[200][1], 3), (-100, rows[9][1], 1)]
    rows += [(5, rows[5][1], rows[5][2])] * 7 + [(1400, [1.0, -2.0], 0), (1401, [1.0, -1.5], 0), (1402, [0.9, -1.6], 1), (1500, [], 0), (1501, [], 0), (1502, [], 1)]
    odd = [(None, [1.0] * 6, 1), (900, None, 1), (1000, [1.0, None] + [0.0] * 4, 1), (1100, [float("nan")] * 6, 1), (1200, [float("-inf")] * 6, 1), (1300, [1.0] * 6, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<double>, label int, copies string").withColumn("a_key", F.lit(1))
    assert sorted(map(tuple, hard_negatives.mine_negatives(df).collect())) == brute_negatives(rows)
    assert hard_negatives.mine_negatives(df.where("false")).count() == 0
    assert hard_negatives.mine_negatives(df.where("vec_id = 100 and label = 0").limit(1)).count() == 0


@pytest.mark.parametrize("top", [1, 3, 500, 1 << 20, 1 << 40, 1 << 62])
def test_packed_scores(top):
    rng = np.random.default_rng(top % 97)
    a, r = rng.integers(-top, top + 1, (5, 7)), rng.integers(-top, top + 1, (23, 7))
    exact = np.clip(a.astype(object) @ r.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)
    assert (hard_negatives.packed_scores(a, r) == exact).all()
    far = r + (1 << 41)  # small fields far from zero
    assert (hard_negatives.packed_scores(a, far) == np.clip(a.astype(object) @ far.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)).all()
    assert hard_negatives.packed_scores(a[:0], r).shape == (0, 23) and hard_negatives.packed_scores(a, r[:0]).shape == (5, 0)


# op12 ----------------------------------------------------------------------------------------------------------------


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_divergence(rows, least, ranks=50):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))) for text, lang, source in rows]
    seen, counts = Counter(), defaultdict(Counter)
    for lang, source, words in terms:
        seen.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
    kept = defaultdict(list)
    for (lang, w), n in seen.items():
        if n >= least:
            kept[lang].append(w)

    def shares(lang, count):
        base = sum(count[w] for w in kept[lang]) + 5 * len(kept[lang])
        return {w: 1 + 1_000_000_000 * (count[w] + 5) // base for w in kept[lang]}

    out = []
    for lang, source in counts:
        own, every = shares(lang, counts[lang, source]), shares(lang, sum((c for (other, _), c in counts.items() if other == lang), Counter()))
        two = [(s, sum(abs(own[w] - p) for w, p in shares(lang, c).items())) for (other, s), c in counts.items() if other == lang and s != source]
        one = [(w, p - every[w]) for w, p in own.items() if counts[lang, source][w] and p > every[w]]
        for part, found, most in (("pair", two, None), ("term", one, ranks)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, r + 1) for r, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"SHARD_KEYS": 5, "MOST_KEYS": 20, "FAN": 2, "SOURCE_BLOCK": 2}])
def test_divergence(spark, bounds, monkeypatch):
    """A hot group, empty texts, nulls, groups and languages without kept terms; with one shard and pass, and with many."""
    for name, value in bounds.items():
        monkeypatch.setattr(source_divergence, name, value)
    rng = np.random.default_rng(3)
    words = ["Ab", "ab", "ñu", "É", "zz", "a-b", "x9y", "Q" * 300, *(f"w{chr(97 + i)}" for i in range(26)), "İ", "日本"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12), p=None)), "en" if i % 3 else rng.choice(["de", "x\x00y", ""]), "s0" if i % 2 else f"s{rng.integers(5)}") for i in range(240)]
    rows += [(None, None, None), ("", "en", "silent"), ("1 2 3", "fr", "a"), ("once", "fr", "b"), (None, "fr", None), ("ab " * 20000, "en", "s0")] + [("ab zz zz", "en", "copies")] * 40
    rows = [(t if t is None else str(t), lang if lang is None else str(lang), s if s is None else str(s)) for t, lang, s in rows]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, counts int").repartition(7)
    got = sorted(map(tuple, source_divergence.divergence(df, least_docs=10).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute_divergence(rows, 10)
    assert source_divergence.divergence(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 50, 4000])
def test_minimal_perfect_hash(n):
    terms = [f"t{i}é" for i in range(n)]
    seed, shift, stored = source_divergence.build_hash(terms)
    h = source_divergence.hash_terms(terms, seed)
    d = shift[source_divergence.bucket_of(h, len(shift))]
    slot = np.where(d < 0, -1 - d, (source_divergence.slots_of(h, d) % np.uint64(n)).astype(np.int64))
    assert sorted(slot) == list(range(n)) and [stored[s] for s in slot] == terms
    assert source_divergence.hash_terms(terms[:2] * 2, 0).tolist()[:1] == [int(h[0])]


# op13 ----------------------------------------------------------------------------------------------------------------


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_hits(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        size = min(len(w), window)
        for at in range(len(w) - size + 1) if w else ():
            windows[tuple(w[at : at + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[at : at + size]))) is not None:
                    hit |= set(range(at, at + size))
                    found |= own
        out.append((str(doc), len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"FILTER": 3, "ROWS_A_TASK": 4}])
def test_decontamination(spark, bounds, monkeypatch):
    """Random words of a small vocabulary, so that grams repeat and fall together; planted spans of 9, 10 and more words."""
    for name, value in bounds.items():
        monkeypatch.setattr(winnow_decontam, name, value)
    rng = np.random.default_rng(5)

    def prose(n, k=9):
        return " ".join(f"Wo{rng.integers(k)}" for _ in range(n))

    items = [(i, prose(int(n), 40)) for i, n in enumerate(rng.integers(1, 60, 25))] + [(50, prose(40, 2)), (51, "same " * 30), (None, "no id here"), (52, None), (53, "?!"), (7, "the id seven again with more than ten words in it, as said")]
    items += [(60 + i, items[3][1]) for i in range(5)] + [(70, "a b c d e f g h"), (71, "Ünï cöde")]
    docs = [(i, prose(int(n), int(k))) for i, (n, k) in enumerate(zip(rng.integers(0, 80, 60), rng.integers(2, 60, 60)))]
    for i, (_, text) in enumerate(items):
        w = (text or "").split()
        for n in (9, 10, 11, 25):
            docs.append((1000 + i, f"{prose(5, 90)}, {'; '.join(w[max(0, len(w) - n):])} {prose(7, 90)}!"))
    docs += [(5, None), (5, ""), (None, items[3][1]), (6, "...")] + [(9, items[4][1])] * 30 + [(10, "ünï CÖDE ÜNÏ cöde the end"), (11, "same " * 40_000), (12, "x" * 300_000 + " a b c d e f g h")]
    ddf = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, key string, marks int")
    idf = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, item string")
    got = winnow_decontam.contaminated_spans(ddf, idf).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in got) == brute_hits(docs, items)
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in got)
    assert {r.n_hit for r in winnow_decontam.contaminated_spans(ddf, idf.where("false")).collect()} == {0}
    assert winnow_decontam.contaminated_spans(ddf.where("false"), idf).count() == 0


def test_winnowing_guarantee():
    """Any window of ten words keeps the same gram wherever it stands."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        shared = " ".join(f"w{x}" for x in rng.integers(0, 4, 10))
        kept = []
        for _ in range(2):
            before, after = (" ".join(f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 6))) for _ in range(2))
            _, marks = winnow_decontam.Marker(10, 8, [], None, False)(pa.array([f"{before} {shared} {after}"]))
            first = len(before.split())
            kept.append({(m["pos"] - first, m["hash"]) for m in marks[0].as_py() if first <= m["pos"] <= first + 2})
        assert kept[0] & kept[1]
