"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its odd cases."""

import hashlib
import os
import random
import re
import struct
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrydeck.llm import components, crf_langid, license_scan, piece_codec, pivot_search, queries, simhash_dedup, source_mix, subword_quality, tiff_media, token_counts, url_filter
from quarrydeck.llm._common import sampled_words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = [" " * 1_000_000, "\t" * 1_000_000, "\n" * 300_000, "x" * 1_000_000, "ab " * 400_000, "a" + " " * 1_000_000 + "b", "-" * 1_000_000]
ODD = [None, "", " ", "\n\t ", "word", "é", "123 !!", "a b", "x" * 3000, "The same text twice here.", "The same text twice here.", "long text " * 5000]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else "s", "clash") for i, t in enumerate(ODD)] + [(None, "no id", "en", "s", "clash"), (3, None, None, None, None), (3, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


# op1 -----------------------------------------------------------------------------------------------------------------


def test_license_inheritance(spark):
    mit = "Released under the MIT License."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/x.py", "code"), (3, "a/b/c/y.py", "Licensed under CC BY-NC 4.0.\nbody"), (4, "z/x.py", "code"), (5, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (6, None, None), (7, "top.txt", ""), (8, "ab/x.py", "code")]
    got = {r.doc_id: (r.licence, r.via, r.from_dir) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("CC-BY-NC-4.0", "own", None), 4: (None, None, None), 5: ("Apache-2.0", "own", None), 6: (None, None, None), 7: (None, None, None), 8: (None, None, None)}


def licences(spark, texts, name="a.py"):
    rows = [(i, f"d{i}/{name}", t) for i, t in enumerate(texts)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    return [r.own for r in sorted(got, key=lambda r: r.doc_id)]


def test_license_names_and_versions(spark):
    want = {
        "Artistic License 2.0": "Artistic-2.0", "License: 2.0": None, "Foo Public License 2.0": None, "Mozilla Public License 1.1": None, "the BSD license": None,
        "GNU General Public License, version 2": "GPL-2.0", "Licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1", "This is under the GNU Affero General Public License, version 3": "AGPL-3.0",
        "licensed under GPLv3": "GPL-3.0", "Released under the GPL v2": "GPL-2.0", "Licensed under the Apache License, Version 1.1": None, "Licensed under the Apache License v2.0": "Apache-2.0",
        "SPDX-License-Identifier: MIT": "MIT", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "SPDX-License-Identifier: Foo-1.0": None, "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
        "The quick brown fox jumps over the lazy dog today. Released under the MIT License.": "MIT", "Copyright (c) 2020 Me. All rights reserved.": None, "Creative Commons Attribution-ShareAlike 4.0 International": "CC-BY-SA-4.0",
        "Use it under the terms of the\nGNU General Public License as published by\nthe Free Software Foundation, version 2 of the license": "GPL-2.0",
    }
    assert dict(zip(want, licences(spark, list(want)))) == want


def test_whole_license_files(spark):
    from quarrydeck.llm import license_texts as T

    files = {"MIT": f"MIT License\n\nCopyright (c) 2021 Someone\n\n{T.MIT_BODY}", "BSD-2-Clause": f"Copyright 2020, X\n{T.BSD_GRANT}\n{T.BSD_END}", "BSD-3-Clause": f"Copyright 2020, X\n{T.BSD_GRANT}\n{T.BSD_THIRD}\n{T.BSD_END}", "ISC": T.ISC_BODY, "Zlib": T.ZLIB_BODY, "BSL-1.0": T.BOOST_BODY, "Unlicense": T.UNLICENSE_BODY}
    wrapped = [textwrap.fill(x, 70) for x in files.values()]
    assert licences(spark, list(files.values()), "LICENSE") == licences(spark, wrapped, "LICENSE.txt") == list(files)
    header = textwrap.fill(T.APACHE_HEADER, 60, initial_indent=" * ", subsequent_indent=" * ")
    assert licences(spark, [header + "\ncode(x)\n" * 200]) == ["Apache-2.0"]


def test_license_ties_and_repeats(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "d/LICENSE-b", mit), (2, "d/LICENSE-a", apache), (3, "d/x", "code"), (4, "d/y", "code"), (4, "d/y", mit), (4, "d/y", "code"), (None, None, apache), (None, None, None)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert len(got) == len(rows)
    assert sorted((r.own or "", r.licence) for r in got if r.doc_id == 4) == [("", "Apache-2.0"), ("", "Apache-2.0"), ("MIT", "MIT")]  # of equal scores the smaller name
    assert next(r.licence for r in got if r.doc_id == 3) == "Apache-2.0" and sorted(r.own or "" for r in got if r.doc_id is None) == ["", "Apache-2.0"]
    best = [(1, "d/LICENSE-b", "License: MIT"), (2, "d/LICENSE-a", "This code comes under the ISC license."), (3, "d/x", "code")]
    scores = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(best, "doc_id long, path string, text string")).collect()}
    assert scores[1].own_score > scores[2].own_score > 0 and scores[3].licence == "MIT"  # else the higher score


def test_license_odd(odd):
    assert license_scan.scan_licenses(license_scan.document_files(odd)).count() == odd.count()
    assert license_scan.scan_licenses(license_scan.document_files(odd.where("false"))).count() == 0


# op2 -----------------------------------------------------------------------------------------------------------------


def brute_top(rows, k=10):
    ints = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows]
    out = []
    for at, (q, x) in enumerate(ints):
        if q % 100 == 0:
            found = sorted((-int(x @ y), i) for n, (i, y) in enumerate(ints) if n != at and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_pivot_search(spark, seed):
    rng = np.random.default_rng(seed)
    hub = rng.normal(size=8)
    rows = [(int(i), [float(x) for x in (hub if i % 3 == 0 else np.round(rng.normal(size=8), 2))]) for i in range(401)]
    rows += [(100, rows[100][1]), (200, rows[7][1]), (200, rows[200][1]), (200, rows[200][1])]  # rows that repeat, or share an id
    odd = [(900, None), (1000, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1200, [float("inf")] * 8), (1300, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, pivot_search.top_k(df, df.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top(rows)
    assert pivot_search.top_k(df.where("false"), df.where("false")).count() == 0


def test_pivot_search_prunes_clusters(spark):
    """Far clusters get no query, tiles are left out, and the result is still whole."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 9
    x = np.floor(1024 * (centres[np.arange(3000) % 12] + rng.normal(size=(3000, 16)) * 0.1)).astype(np.int64)
    pivots = x[:12].astype(np.float64)
    limit = float((x.astype(np.float64) ** 2).sum(1).max())
    far = pivot_search._distances(x.astype(np.float64), np.sqrt(limit - (x.astype(np.float64) ** 2).sum(1)), pivots, np.sqrt(limit - (pivots**2).sum(1)))
    q_far = pivot_search._distances(x[::100].astype(np.float64), np.zeros(30), pivots, np.sqrt(limit - (pivots**2).sum(1)))
    scored, plain = [], pivot_search._scores
    pivot_search._scores = lambda a, b: scored.append(len(a) * len(b)) or plain(a, b)
    try:
        at, found, score = pivot_search.search_cell(np.arange(3000), x, far, x[::100], q_far, limit, np.full(30, -np.inf), 11, tile=64)
    finally:
        pivot_search._scores = plain
    assert sum(scored) < 0.5 * 30 * 3000
    for i in range(30):
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[100 * i]))[:11]
        assert [(-int(s), int(j)) for s, j in zip(score[at == i], found[at == i])] == want
    df = spark.createDataFrame([(i, (v / 1024).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, pivot_search.top_k(df, df.where("vec_id % 100 = 0")).collect()))
    assert got == brute_top([(i, (v / 1024).tolist()) for i, v in enumerate(x)])


def test_pivot_search_large_components(spark):
    rows = [(i, [1e15 * (i + 1), -1e15]) for i in range(0, 300, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert pivot_search.top_k(df, df.where("vec_id = 0")).select("score").distinct().first()[0] == (1 << 63) - 1


# op3 -----------------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = [None, "", "nothing", "https://A.Example.COM/en/7x?page=2", "http://b.net/de/8", "http://x.example.net/de/81", "http://org/es/", "http://casinox.io/", "http://a-casino.io/", "http://cheap-pills.io/", "http://q.io/?bets=2&bets=3", "http://notcom/en/", "HTTP://U.ORG/ES/"]
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules=url_filter.RULES).collect()}
    assert got[None] == ("", "", None, "allow") and got["nothing"] == ("", "", None, "allow")
    assert got["https://A.Example.COM/en/7x?page=2"] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got["http://b.net/de/8"][2:] == ("net/de/", "allow") and got["http://x.example.net/de/81"][2:] == ("example.net/de/8", "block")
    assert got["http://org/es/"][2:] == ("org/es/", "block") and got["http://notcom/en/"][2:] == (None, "allow") and got["HTTP://U.ORG/ES/"][:2] == ("u.org", "/ES/")
    assert got["http://casinox.io/"][3] == "allow" and got["http://a-casino.io/"][3] == "block"
    assert got["http://cheap-pills.io/"][3] == "block" and got["http://q.io/?bets=2&bets=3"][3] == "allow"  # distinct soft terms count
    one = lambda url, **kw: url_filter.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), **kw).first()
    assert one("http://farm.org/free").verdict == "allow" and one("http://spam-farm.org/").verdict == "block"  # weights decide
    assert one("http://q.io/c%61sino").verdict == "block" and one("http://q.io/%C3%A9casino%").verdict == "block" and one("http://q.io/%ZZcasinos1").verdict == "allow"
    table = spark.createDataFrame([("BETS", "soft", 5.0), ("bets", "soft", None), ("bad", "strict", None), ("bad", "soft", 1.0), ("x", "soft", None), (None, "strict", None), ("", "strict", None)], "term string, kind string, weight double")
    assert one("http://q.io/bets", vocabulary=table).verdict == "allow"  # one soft term alone never blocks
    assert one("http://q.io/bets/x", vocabulary=table).verdict == "block" and one("http://q.io/bad", vocabulary=table).strict_hits == 1
    assert one("http://casino.io/", vocabulary=table.where("false")).verdict == "allow"
    with pytest.raises(ValueError):
        one("http://q.io", vocabulary=table, most_terms=2)
    assert one("http://q.io/" + "a-" * 500_000 + "casino").verdict == "block"
    built = url_filter.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules=url_filter.RULES, vocabulary=url_filter.vocabulary_table(spark))
    assert {r.url: r.verdict for r in built.collect()} == {u: v[3] for u, v in got.items()}


# op4 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def unigram():
    """The library on the same file, declared as a unigram model without a prefix: its Viterbi is the reference, word by word
    (over a whole text its 32-bit sums lose the small scores behind the file's scores of -1e9)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto.FromString(open(MODEL, "rb").read())
    spec.trainer_spec.model_type = 1
    spec.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())


def brute_best(model, word):
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            found = model.scored.get(word[start:end])
            score = found[0] if found else model.unknown_score if end - start == 1 else -np.inf
            best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_pieces_have_the_best_score(docs):
    model = piece_codec.load_model(MODEL)
    words = sorted({w for r in docs.limit(20).collect() for w in piece_codec.WORD.findall(r.text.replace(" ", piece_codec.MARK))})[:1500]
    for word, ids in zip(words, model.encode_sorted(words)):
        found = np.frombuffer(ids, np.int32)
        assert sum(model.scores[i] if model.kinds[i] == "normal" else 0 for i in found) + sum(model.unknown_score for ch in word if ch not in model.scored) == pytest.approx(brute_best(model, word))
        assert "".join(model.pieces[i] for i in found if model.kinds[i] == "normal") == word or any(ch not in model.scored for ch in word)


def test_pieces_match_the_library(docs, unigram):
    model = piece_codec.load_model(MODEL)
    texts = [r.text for r in docs.limit(40).collect()] + [t for t in ODD if t] + ["  two  blanks\n\ttab ", "漢字 \U0001f600 mixed", "nul \0 inside", "日本語"]
    words = sorted({w for t in texts for w in piece_codec.WORD.findall(t.replace(" ", piece_codec.MARK))})
    own = [np.frombuffer(x, np.int32).tolist() for x in model.encode_sorted(words)]
    exact = [(w, x) for w, x in zip(words, own) if all(model.scores[i] > -1e8 for i in x)]
    score = lambda ids: sum(model.scores[i] for i in ids)
    assert len(exact) > 0.95 * len(words) and all(score(x) >= score(unigram.encode(w)) for w, x in exact)
    assert sum(x == unigram.encode(w) for w, x in exact) >= 0.98 * len(exact)


def test_pieces_decode(docs):
    import sentencepiece

    model, library = piece_codec.load_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text for r in docs.limit(40).collect()] + [t for t in ODD if t] + ["  two  blanks\n\ttab ", "漢字 \U0001f600 mixed", "nul \0 inside", "日本語"]
    got = model.encode(pa.array(texts), {}).to_pylist()
    assert model.decode(pa.array(got, pa.list_(pa.int32()))).to_pylist() == [library.decode(g) for g in got] == texts


def test_pieces_odd(odd):
    got = queries.piece_codec.round_trip(odd, MODEL).collect()
    assert len(got) == odd.count() and all((r.decoded or "") == (r.text or "") and (r.text or not r.piece_ids) for r in got)


def plain_walk(model, word):
    """Word by word and character by character; of equal sums the one whose last piece starts first."""
    best, last = [0.0], [None]
    for end in range(1, len(word) + 1):
        found = [(start, *model.scored[word[start:end]]) for start in range(max(0, end - model.longest), end) if word[start:end] in model.scored]
        found += [(end - 1, model.unknown_score, -1)] * (word[end - 1] not in model.scored)
        start, score, piece = max(found, key=lambda x: (best[x[0]] + x[1], -x[0]))
        best.append(best[start] + score)
        last.append((start, piece))
    ids, end = [], len(word)
    while end:
        start, piece = last[end]
        ids = ([piece] if piece >= 0 else [model.bytes_[b] for b in word[start:end].encode()] if model.bytes_ else [model.unknown]) + ids
        end = start
    return ids


@pytest.mark.parametrize("few", [1, 4, 64, 1 << 30])
@pytest.mark.parametrize("bytes_", [True, False])
def test_pieces_by_level_and_by_node(docs, monkeypatch, few, bytes_):
    monkeypatch.setattr(piece_codec, "FEW", few)
    monkeypatch.setattr(piece_codec, "BLOCK_CHARS", 5000)
    model, seeded = piece_codec.load_model(MODEL), random.Random(few)
    model.bytes_ = model.bytes_ if bytes_ else None
    words = {"".join(seeded.choice("▁ab-é漢\U0001f600\n") for _ in range(seeded.choice([1, 3, 9, 90]))) for _ in range(400)} | {"x" * 700, "x" * 699 + "y", "-" * 600, "▁" * 50}
    words = sorted(words | {w for r in docs.limit(5).collect() for w in piece_codec.WORD.findall(r.text.replace(" ", piece_codec.MARK))})
    assert [np.frombuffer(x, np.int32).tolist() for x in model.encode_sorted(words)] == [plain_walk(model, w) for w in words]
    texts = [None, "", " ", "a▁▁ b", "▁", "nul \0 in", *("".join(seeded.choice(" ▁ab\0é") for _ in range(20)) for _ in range(100))]
    want = [[i for w in piece_codec.WORD.findall(piece_codec.MARK + t.replace(" ", piece_codec.MARK)) for i in plain_walk(model, w)] if t else [] for t in texts]
    assert model.encode(pa.array(texts)).to_pylist() == want and model.encode(pa.array(texts).slice(3, 40)).to_pylist() == want[3:43]


def test_pieces_take_no_lookup_a_character():
    """Words that are all different cost less than half of what looking up their substrings one by one does."""
    import time

    model, seeded = piece_codec.load_model(MODEL), random.Random(3)
    words = sorted({"".join(seeded.choices("etaoinshrdlucmfwypvbgkqjxz", k=12)) for _ in range(30_000)})
    start = time.process_time()
    model.encode_sorted(words)
    middle = time.process_time()
    for word in words:
        for end in range(1, len(word) + 1):
            for at in range(end):
                model.scored.get(word[at:end])
    assert 2 * (middle - start) < time.process_time() - middle


# op5 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff_media.NONE, tiff_media.LZW, tiff_media.DEFLATE, tiff_media.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, tile, order):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 256, (37, 50), np.uint8), np.zeros((5, 64, 3), np.uint8), (np.arange(90 * 70).reshape(90, 70) // 7 % 256).astype(np.uint8), rng.integers(0, 3, (120, 90), np.uint8)]
    for predictor in (1, 2):
        found = list(tiff_media.read_pages(tiff_media.write_tiff(pages, compression=compression, predictor=predictor, strip_rows=8, tile=tile, order=order)))
        assert [p["error"] for p in found] == [None] * 4 and [p["pixels"] for p in found] == [p.tobytes() for p in pages]


def test_tiff_broken(spark):
    good = tiff_media.write_tiff([np.zeros((4, 4), np.uint8)] * 2)
    ring = bytearray(good)
    at = int.from_bytes(good[4:8], "little")
    count = int.from_bytes(good[at : at + 2], "little")
    ring[at + 2 + 12 * count : at + 6 + 12 * count] = good[4:8]
    rows = [(1, good), (2, b""), (3, None), (4, good[:30]), (5, bytes(ring)), (6, b"MM\0\x2a")]
    got = [(r.k, r.page, r.error is None) for r in tiff_media.tiff_pages(spark.createDataFrame([(k, bytearray(x) if x is not None else None) for k, x in rows], "k int, content binary")).collect()]
    assert got[:2] == [(1, 0, True), (1, 1, True)] and {k for k, _, _ in got} == {1, 2, 3, 4, 5, 6} and (5, None, False) in got


def retagged(data, change):
    """The file with entries of its first directory changed: tag to (count, value), or to None to break the tag's number."""
    out, at = bytearray(data), int.from_bytes(data[4:8], "little")
    for i in range(int.from_bytes(data[at : at + 2], "little")):
        entry = at + 2 + 12 * i
        tag = int.from_bytes(data[entry : entry + 2], "little")
        if tag in change:
            if change[tag] is None:
                out[entry : entry + 2] = struct.pack("<H", 65000)
            else:
                out[entry + 4 : entry + 12] = struct.pack("<II", *change[tag])
    return bytes(out)


def test_tiff_malformed_pages(spark):
    good = tiff_media.write_tiff([np.arange(16, dtype=np.uint8).reshape(4, 4)])
    tiles = tiff_media.write_tiff([np.zeros((20, 20), np.uint8)], tile=(16, 16))
    changes = [{256: None}, {257: None}, {256: (1, 0)}, {257: (1, 0)}, {257: (1, 1_000_000)}, {257: (1, 4_000_000_000)}, {273: None}, {279: None}, {273: (1, 4_000_000_000)}, {273: (4_000_000_000, 8)}, {277: (1, 0)}, {279: (1, 3)}, {259: (1, 5)}, {256: (1, 3_000_000_000), 257: (1, 3_000_000_000)}]
    files = [retagged(good, c) for c in changes] + [retagged(tiles, {c: (1, 0)}) for c in (322, 323)] + [retagged(tiles, {324: (1, 8)}), good[:-3], good[:9], b"II*\0\xff\xff\xff\xff"]
    rng = random.Random(6)
    for _ in range(300):  # any single damage gives a row, and no damage ends the job
        broken = bytearray(good)
        broken[rng.randrange(len(broken))] = rng.randrange(256)
        files.append(bytes(broken))
    got = tiff_media.tiff_pages(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(files)], "k int, content binary")).collect()
    assert {r.k for r in got} == set(range(len(files)))
    bad = len(files) - 300
    assert all(r.error and r.pixels is None for r in got if r.k < bad) and all((r.pixels is None) == (r.error is not None) for r in got)
    small = tiff_media.tiff_pages(spark.createDataFrame([(1, bytearray(good))], "k int, content binary"), most_bytes=15).first()
    assert "more than 15 bytes" in small.error


def test_tiff_clashing_names(spark):
    df = spark.createDataFrame([(1, "abc", "old", 7, "w", "d")], "doc_id long, text string, content string, n_bytes int, width string, `a.b` string")
    stored = tiff_media.texts_as_tiff(df)
    page = tiff_media.page_features(tiff_media.tiff_pages(stored)).first()
    assert page["a.b"] == "d" and page.n_bytes == 3 and page.width == 64 and page.doc_id == 1 and page.pixels[:3] == b"abc"


def test_tiff_query(spark, tmp_path, odd):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_tiff_media(spark, str(tmp_path)).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len((r.text or "").encode()), len(p)) for r in odd.collect() for p in [tiff_media.payload(r.text)])
    assert sorted((str(r.doc_id), r.payload_sha256, r.tail_crc32, r.n_bytes, r.payload_bytes) for r in got) == want
    assert all(r.media_bytes > 0 and len(r.feature) == 16 for r in got) and len({r.media_sha256 for r in got}) == len({r.payload_sha256 for r in got})


# op6, op9 ------------------------------------------------------------------------------------------------------------


def test_language(spark, sf, docs, odd):
    model = crf_langid.fit_language(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = crf_langid.identify_language(docs, model).where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    found = {r.text: r for r in crf_langid.identify_language(odd.withColumnRenamed("score", "other"), model).collect()}
    assert all(found[t].lang_pred == "und" and found[t].score == 0 for t in (None, "", " ", "123 !!")) and found["é"].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in found.values())
    none = crf_langid.fit_language(docs.where("false"))
    assert {r.lang_pred for r in crf_langid.identify_language(docs, none).collect()} == {"und"}


def test_language_of_long_texts_only(spark, docs):
    """Long labelled texts are learned from as well, and a rare language gets its share of the sample."""
    rows = [(i, (r.text + " ") * (9000 // len(r.text) + 2), r.lang) for i, r in enumerate(docs.where("n_chars > 400").limit(60).collect())]
    model = crf_langid.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.labels) == {r[2] for r in rows}
    got = crf_langid.identify_language(docs, model).where(F.col("lang").isin(model.labels)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    rare = docs.select("doc_id", "text", F.when(F.col("doc_id") % 20 == 0, "rare").otherwise("often").alias("lang"))
    assert set(crf_langid.fit_language(rare, sample_rows=8).labels) == {"rare", "often"}


def test_language_query(spark, sf, docs):
    """The query's rows against marginals computed by enumeration-free recursion, word by word, in plain Python."""
    model = crf_langid.fit_language(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = {r.doc_id: r for r in queries.op6_crf_langid(spark, sf).collect()}
    assert len(got) == docs.count()
    for r in docs.orderBy("n_chars").limit(12).collect():
        words = [w for w in re.split(crf_langid.BREAK.replace(r"\p{L}", r"\W\d_").replace("[^", "["), r.text.lower()) if w]
        emit = model.emissions(pa.array(words)).astype(np.float64)
        n, k = emit.shape
        ahead, back = np.zeros((n, k)), np.zeros((n, k))
        for t in range(n):
            for y in range(k):
                ahead[t, y] = emit[t, y] + (np.logaddexp.reduce(ahead[t - 1] + model.trans[:, y]) if t else 0)
        for t in range(n - 2, -1, -1):
            for y in range(k):
                back[t, y] = np.logaddexp.reduce(model.trans[y] + emit[t + 1] + back[t + 1])
        post = ahead + back
        post = np.exp(post - np.logaddexp.reduce(post, axis=1)[:, None]).mean(0)
        assert got[r.doc_id].lang_pred == model.labels[post.argmax()] and got[r.doc_id].score == pytest.approx(post.max(), abs=1e-4)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_code_switched_words(spark, docs):
    model = crf_langid.fit_language(docs)
    pick = {lang: " ".join(docs.where(F.col("lang") == lang).orderBy(F.desc("n_chars")).first().text.split()[:25]) for lang in ("en", "fr")}
    got = crf_langid.label_words(spark.createDataFrame([(1, pick["en"] + " " + pick["fr"])], "doc_id long, text string"), model).orderBy("place").collect()
    half = len(crf_langid.tokens_of(pa.array([pick["en"].lower()]), crf_langid.BREAK)[1])
    assert sum(r.lang == "en" for r in got[:half]) >= 0.8 * half and sum(r.lang == "fr" for r in got[half:]) >= 0.8 * (len(got) - half)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    emit, trans = rng.normal(size=(5, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    post, _ = crf_langid.forward_backward(emit, np.array([0, 3, 5]), trans)
    for lo, hi in ((0, 3), (3, 5)):
        want = np.zeros((hi - lo, 3))
        for path in np.ndindex(*[3] * (hi - lo)):
            p = np.exp(sum(emit[lo + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(post[lo:hi], want / want.sum(1, keepdims=True), atol=1e-5)


def plain_quality(model, text):
    """The score by the definition, feature by feature."""
    words = (text or "").encode().split()
    hashed = lambda h, kind: _bucket(h, kind, model.bits)
    total, count, own = 0.0, 0, []
    for w in words:
        framed = b"\x02" + w + b"\x03"
        h, power = 0, 1
        for c in framed:
            power = power * (PRIME | 1) % 2**64
            h = (h + c * power) % 2**64
        buckets = [hashed(h, 1)]
        own.append((((h ^ (h >> 29)) * PRIME) % 2**64) >> (64 - subword_quality.BIGRAM_BITS))
        for order in subword_quality.ORDERS:
            for i in range(len(framed) - order + 1):
                g = 0
                for c in framed[i : i + order]:
                    g = (g * 257 + c + 1) % 2**64
                buckets.append(hashed(g, 2 + order))
        total += sum(model.weight[b] for b in buckets)
        count += len(buckets)
    pairs = [a ^ b for a, b in zip(own, own[1:])]
    total += sum(model.weight[(1 << model.bits) + p] for p in pairs)
    return 1 / (1 + np.exp(-(total / max(count + len(pairs), 1) + model.bias)))


PRIME = 0x9E3779B97F4A7C15


def _bucket(h, kind, bits):
    h = ((h ^ (kind * 0x632BE5AB)) * PRIME) % 2**64
    return (((h ^ (h >> 29)) * PRIME) % 2**64) >> (64 - bits)


def test_quality_query_is_held_out(spark):
    """Learned from four fifths of the labels, judged on the fifth; scores against a plain version."""
    sf = "/root/testdata/sf0.01"  # enough labelled rows for a kind of junk to be in both parts
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in queries.op9_subword_quality(spark, sf).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert held and sum(r.predicted == q for r, q in held) >= 0.95 * len(held)
    model = subword_quality.fit_quality(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    for r in docs.orderBy("n_chars").limit(40).collect():
        assert got[r.doc_id].score == pytest.approx(plain_quality(model, r.text), abs=1e-9)


def test_quality_learns_repetition_in_new_words(spark, docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality")).limit(100)
    junk = spark.createDataFrame([(10**6 + i, f"w{i}x " * 60) for i in range(60)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(junk)
    model = subword_quality.fit_quality(rows, labels.unionByName(junk.select("doc_id", F.lit(0).alias("quality"))))
    fresh = ["zzyq " * 80, "Blom Blom Blom Blom Blom Blom Blom Blom Blom Blom Blom", docs.orderBy(F.desc("doc_id")).first().text]
    scores = model.scores(pa.array(fresh))
    assert scores[0] < 0.3 and scores[1] < 0.3 < scores[2]


def test_quality(spark, sf, docs, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = subword_quality.fit_quality(docs, labels)
    assert all(0 <= r.score <= 1 for r in subword_quality.score_quality(odd, model).collect())
    assert model.scores(pa.array(ODD)) == pytest.approx([plain_quality(model, t) for t in ODD], abs=1e-9)
    one = subword_quality.fit_quality(docs, labels.where("quality = 1"))
    assert min(r.score for r in subword_quality.score_quality(docs, one).collect()) > 0.99
    assert {r.score for r in subword_quality.score_quality(docs, subword_quality.fit_quality(docs, labels.where("false"))).collect()} == {0.5}


def test_quality_of_long_and_repeated_rows(spark, docs):
    """Long texts are learned from as a whole; the bounds hold for rows, whatever their ids, and for features."""
    rows = spark.createDataFrame([(i, ("good prose here " if i % 2 else "bad*** junk### ") * 2000) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = subword_quality.fit_quality(rows, labels)
    got = subword_quality.score_quality(rows, model).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 2 == 1) for r in got)
    hot = rows.withColumn("doc_id", F.lit(1)).unionByName(rows)
    assert len(subword_quality.labelled_sample(hot, labels, "doc_id", "text", "quality", 7, 100)) == 7
    sample = subword_quality.labelled_sample(rows, labels, "doc_id", "text", "quality", 100, 128).to_pylist()
    assert len(sample) == 40 and all(len(r["text"].split()) == 128 and set(r["text"].split()) <= {"good", "prose", "here", "bad***", "junk###"} for r in sample)
    late = spark.createDataFrame([(i, "the same words " * 1000 + ("fine end" if i % 2 else "grim close")) for i in range(2)], "doc_id long, text string")
    assert {r["text"].split()[-1] for r in subword_quality.labelled_sample(late, labels, "doc_id", "text", "quality", 9, 4096).to_pylist()} == {"end", "close"}


def test_language_sample_covers_the_whole_text():
    text = " ".join(f"w{'abcdefghij'[i // 1000]}" for i in range(10_000))
    got = sampled_words(pa.array([text, "a  b", ""]), 4096, crf_langid.BREAK)
    assert len(got[0].split()) == 4096 and len(set(got[0].split())) == 10 and got[1:] == ["a b", ""]


INTERNAL = ("__url", "__in", "__text", "__score", "__lang", "__digest", "__mix_size", "__mix_key", "__back", "__x", "row", "key", "size", "draw", "bucket", "digest", "_0", "_1", "id", "k", "lang_pred", "decoded")


def test_own_columns_of_any_name(spark):
    """Names that the operators use inside are names like others in the tables: their values come back."""
    from corpus_pipeline import STAGES

    docs = spark.createDataFrame([(i, f"some plain words of text number {i} " * 4, "en", f"s{i % 2}") for i in range(6)], "doc_id long, text string, lang string, source string")
    wide = docs.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in INTERNAL))
    kept = {r.doc_id: r.asDict() for r in wide.collect()}

    def same(df, without=()):
        rows = df.collect()
        assert rows
        for r in rows:
            assert all(r[c] == kept[r.doc_id][c] for c in INTERNAL if c not in without)

    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    quality, language = subword_quality.fit_quality(docs, labels), crf_langid.fit_language(docs)
    same(subword_quality.score_quality(wide, quality))
    same(crf_langid.identify_language(wide, language), ("lang_pred",))
    same(piece_codec.round_trip(wide, MODEL), ("decoded",))
    same(tiff_media.texts_as_tiff(wide))
    same(tiff_media.tiff_pages(tiff_media.texts_as_tiff(wide)))
    same(url_filter.judge_urls(wide.withColumn("url", F.lit("http://a.b/c"))))
    same(source_mix.mix_sources(wide), ("size",))
    same(source_mix.sample_mix(wide))
    same(simhash_dedup.one_of_each(wide))
    for name, stage in STAGES:
        if name not in ("quality", "language"):  # these learn from tables; their scorers are above
            same(stage(spark, wide, None))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mix_meets_its_targets(spark, sf):
    rows = queries.op8_source_mix(spark, f"/root/testdata/{sf}")
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "source")
    for r in rows.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"), F.count("*").alias("n")).collect():
        assert abs(r.taken - r.target) <= r.largest and (r.n < 30 or abs(r.taken - r.target) <= 0.04 * r.target), r


# op7 -----------------------------------------------------------------------------------------------------------------


def brute_counts(text_sections, coder):
    text = "".join(text_sections)
    owner = [i for i, s in enumerate(text_sections) for _ in s.encode()]
    counts, at = [0] * len(text_sections), 0
    for token in coder.encode_ordinary(text):
        n = len(coder.decode_single_token_bytes(token))
        own = owner[at : at + n]
        counts[max(sorted(set(own)), key=lambda k: (own.count(k), -k))] += 1
        at += n
    return counts


def test_token_counts(spark, docs, odd):
    ranks = open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read()
    coder, _ = token_counts.encoding(ranks, queries.BYTE_BPE_PATTERN)
    df = docs.limit(30).select("doc_id", "source", "text").unionByName(odd.where("doc_id < 12").select((F.col("doc_id") + 10**6).alias("doc_id"), "source", "text").dropDuplicates(["doc_id"]))
    got = {}
    for r in token_counts.count_tokens(df, ranks, queries.BYTE_BPE_PATTERN).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r.tokens)
    for r in df.collect():
        lines = (r.text or "").split("\n")
        sections = [(r.source or "") + "\n", *(x + "\n" for x in lines[:-1]), lines[-1]]
        assert got[r.doc_id] == brute_counts(sections, coder)
        assert sum(got[r.doc_id]) == len(coder.encode_ordinary("".join(sections)))


def test_long_runs_of_white_space(spark):
    ranks = open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read()
    coder, _ = token_counts.encoding(ranks, queries.BYTE_BPE_PATTERN)
    for run in (" " * 1000, "\t" * 1001, "\n" * 3000, " \n" * 2000, "\u3000" * 1500, "\x1c" * 1500):
        for text in (run, "a" + run, run + "b", "a" + run + "b", "a " + run + " 1", run + "x" + run + "\n", "é" + run + "'s"):
            assert token_counts.encode(coder, text) == coder.encode_ordinary(text)
    rows = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").withColumn("source", F.lit("s"))
    got = token_counts.count_tokens(rows, ranks, queries.BYTE_BPE_PATTERN).groupBy("doc_id").agg(F.sum("chars").alias("n"), F.sum("tokens").alias("t")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(x) + 2 for i, x in enumerate(LONG)} and all(r.t > 0 for r in got)


@pytest.mark.parametrize(("rule", "want"), [("first", [2, 0]), ("last", [1, 1]), ("longest", [1, 1])])
def test_crossing_tokens(rule, want):
    assert token_counts.attribute(np.array([0, 2]), np.array([2, 7]), np.array([0, 4, 7]), rule).tolist() == want


# op8 -----------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights, share=1.5, cap=2.0):
    total, full = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(cap * sizes[i] for i in full)
        target = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if target[i] > cap * sizes[i]}
        if not over:
            return [cap * sizes[i] if i in full else target[i] for i in range(len(sizes))]
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 5, 100, 1000, 40_000]) for _ in range(9)]
    weights = [[3.0, 1.0, 2.0][i % 3] for i in range(9)]
    df = spark.createDataFrame([(f"s{i}", n, w) for i, (n, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight double")
    got = {r.source: r.target for r in source_mix.fill_targets(df).collect()}
    assert [got[f"s{i}"] for i in range(9)] == pytest.approx(brute_targets(sizes, weights))


def test_mix(spark, docs, odd):
    mixed = source_mix.mix_sources(docs).cache()
    per = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.g) <= 2 * r.m for r in per)
    assert mixed.where("taken > 2 * size or taken < 0").count() == 0
    assert sorted(mixed.select("doc_id", "taken").collect()) == sorted(source_mix.mix_sources(docs.repartition(3)).select("doc_id", "taken").collect())
    assert source_mix.mix_sources(odd).count() == odd.count() and source_mix.mix_sources(odd.where("false")).count() == 0
    assert source_mix.sample_mix(docs).count() == mixed.agg(F.sum("repeats")).first()[0]


def test_mix_clashing_names(docs):
    df = docs.select("doc_id", "text", "source", *(F.lit("own").alias(c) for c in ("target", "source_size", "source_rows", "size", "n", "weight", "place", "a.b")))
    got = source_mix.mix_sources(df)
    assert got.select("doc_id", "taken", "target").exceptAll(source_mix.mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "taken", "target")).count() == 0
    assert got.where("source_rows = 'own' and weight = 'own'").count() == docs.count()
    rows = source_mix.sample_mix(df)
    assert rows.columns == df.columns and rows.where("target != 'own' or size != 'own'").count() == 0


def test_mix_of_many_sources(spark, docs, monkeypatch):
    want = sorted(map(tuple, source_mix.mix_sources(docs).select("doc_id", "taken", "target").collect()))
    monkeypatch.setattr(source_mix, "STRATUM_ROWS", 3)
    assert sorted(map(tuple, source_mix.mix_sources(docs).select("doc_id", "taken", "target").collect())) == want
    places = {r.source: r.place for r in source_mix.numbered(docs.select("source").distinct().union(docs.select(F.lit(None).cast("string")).limit(1)), "source", "place").collect()}
    assert [places[x] for x in (*sorted(x for x in places if x is not None), None)] == list(range(len(places)))


# op10 ----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    """By the contract, bit by bit."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(ids, fps, budget=3):
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None]) <= budget
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprint(docs):
    assert all(simhash_dedup.fingerprint(t) == plain_fingerprint(t) for t in [r.text for r in docs.limit(30).collect()] + ODD[:11])


def test_simhash_components(docs):
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs).collect()}
    assert [got[r.doc_id] for r in rows] == plain_components([r.doc_id for r in rows], [plain_fingerprint(r.text) for r in rows])


@pytest.mark.parametrize(("group_rows", "levels"), [(16, 1), (4096, 1), (16, 2), (4096, 2), (1, None)])
def test_trie_join_on_clusters(spark, group_rows, levels):
    rng = random.Random(9)
    fps = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(80):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted({*fps, 0, (1 << 64) - 1, 1 << 63, 7})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash_dedup.hamming_forest(spark.createDataFrame([(x,) for x in signed], "fp long"), group_rows=group_rows, levels=levels).collect()
    up = {x: x for x in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        assert bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 64
        up[root(a)] = root(b)
    groups = {}
    for x, label in zip(signed, plain_components(list(range(len(fps))), fps)):
        groups.setdefault(label, set()).add(x)
    mine = {}
    for x in signed:
        mine.setdefault(root(x), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))
    assert len(edges) <= 4 ** (levels or 1) * len(fps) * (1 + len(fps) // group_rows)


def test_two_linked_fingerprints_share_a_key(spark):
    rng, rows = random.Random(3), []
    for _ in range(300):
        x = y = rng.getrandbits(64)
        for bit in rng.sample(range(64), 3):
            y ^= 1 << bit
        rows.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    df = spark.createDataFrame(rows, "x long, y long")
    for levels, most in ((1, 1 << 16), (2, 1 << 28)):
        keys = [simhash_dedup.block_keys(F.col(c), 3, levels) for c in "xy"]
        assert df.where(~F.arrays_overlap(*keys)).count() == 0
        top = df.select(F.explode(keys[0]).alias("k")).agg(F.min("k.value"), F.max("k.value")).first()
        assert top[0] >= 0 and most // 64 < top[1] < most


def test_components_with_hubs(spark, monkeypatch):
    """Hubs are split from the rest alike, whether rows are few or many."""
    rng = random.Random(7)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    up = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            up[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {x: root(x) for x in got} and set(got) == {x for a, b in edges if a is not None and a != b for x in (a, b)}


def test_simhash_odd(odd):
    got = simhash_dedup.near_duplicates(odd).collect()
    assert sorted(got, key=repr) == sorted(simhash_dedup.near_duplicates(odd, hot_share=3).collect(), key=repr)
    assert len(got) == odd.count()
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {0}
    assert simhash_dedup.near_duplicates(odd.where("false")).count() == 0


def test_one_of_each(spark):
    """Rows that share an id are rows of their own; rows without an id stand for a group only if no other does."""
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"thing{i * 7}" for i in range(60))
    rows = [(1, text, "x"), (3, text, "y"), (3, other, "z"), (None, other + " more", "n"), (None, "alone here now", "n"), (None, "alone here now", "n"), (5, "a b c", "k"), (5, "a b c", "l"), (6, None, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.root` string")
    want = {(1, text, "x"), (3, other, "z"), (None, "alone here now", "n"), (6, None, "m")}
    for order in (df, df.orderBy(F.desc("doc_id")).coalesce(1), df.repartition(5)):
        got = [tuple(r) for r in simhash_dedup.one_of_each(order).collect()]
        five = [r for r in got if r[0] == 5]
        assert set(got) - set(five) == want and len(got) == 5 and len(five) == 1
    assert simhash_dedup.one_of_each(df.where("false")).count() == 0


def test_long_texts(spark, sf, tmp_path):
    """Texts of a million characters pass every query over documents, whole."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).select("doc_id", "text", "lang", "source", "n_chars")
    long = spark.createDataFrame([(10**6 + i, x, "en", "s", len(x)) for i, x in enumerate(LONG)], docs.schema)
    docs.unionByName(long).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    n = docs.count() + len(LONG)
    for name, f in queries.QUERIES.items():
        if name in ("op2_pivot_search", "op3_url_filter"):
            continue
        got = f(spark, str(tmp_path))
        assert got.select("doc_id").distinct().count() == n if name != "pipeline" else got.count() > 0, name


def test_only_a_local_session_goes_without_a_shared_folder(spark):
    from types import SimpleNamespace

    from quarrydeck.llm._common import shared_folder

    session = lambda master, folder=None: SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("spark://x", "hdfs://y")) == "hdfs://y" and shared_folder(session("local[2]"))
    with pytest.raises(ValueError):
        shared_folder(session("yarn"))


# All ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want, got = con.execute(queries.SQL[name]).fetchdf(), queries.QUERIES[name](spark, sf).toPandas()
    plain = lambda df: sorted((tuple(None if x is None or x != x else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert plain(want) == plain(got)


def test_empty_tables(spark, tmp_path, sf):
    for t in ("documents", "embeddings", "pages", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, f in queries.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_contract_columns(spark, sf):
    want = {"op2_pivot_search": "query_id rank vec_id score", "op3_url_filter": "page_id host path rule verdict", "op5_tiff_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op6_crf_langid": "doc_id held_out lang_pred score", "op8_source_mix": "doc_id size source_size target taken", "op9_subword_quality": "doc_id held_out score predicted", "op10_simhash_dedup": "doc_id fingerprint component_id"}
    for name, columns in want.items():
        assert set(columns.split()) <= set(queries.QUERIES[name](spark, sf).columns), name


def test_model_file_is_not_in_the_repository():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not any(f.endswith((".model", ".tiktoken")) for _, _, files in os.walk(top) for f in files)
