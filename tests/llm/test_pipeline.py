"""The pipeline's stages against brute-force versions on their own inputs."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarrydeck.llm import crf_langid, piece_codec, subword_quality
from quarrydeck.llm._common import crc_mod
from tests.llm.test_operators import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's input and output, written and read again as in a run."""
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, f) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, sf).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((name, docs, result))
        docs = result
    return {name: (a, b) for name, a, b in out}


def test_columns(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_duplicates", "mix", "pieces"]
    assert all(b.columns == columns for n, (_, b) in stages.items() if n != "pieces")


def test_quality_stage(stages, spark, sf):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = subword_quality.fit_quality(before, labels.where(crc_mod("doc_id", 5) != 0))
    want = {r.doc_id for r in subword_quality.score_quality(before, model).collect() if r.score >= 0.3}
    assert {r.doc_id for r in after.collect()} == want
    clean = labels.where("quality = 1").join(before, "doc_id", "left_semi")
    assert clean.join(after, "doc_id", "left_anti").count() <= 0.02 * clean.count()


def test_language_stage(stages):
    before, after = stages["language"]
    model = crf_langid.fit_language(before.where(crc_mod("doc_id", 4) != 2))
    want = {r.doc_id for r in crf_langid.identify_language(before, model).collect() if r.lang_pred != "und" and r.score >= P.LANGUAGE_CUT}
    assert {r.doc_id for r in after.collect()} == want and len(want) >= 0.99 * before.count()


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    rows = before.select("doc_id", "text").collect()
    ids = [r.doc_id for r in rows]
    assert {r.doc_id for r in after.collect()} == set(plain_components(ids, [plain_fingerprint(r.text) for r in rows])) and after.count() == len({r.doc_id for r in after.collect()})


def test_mix_stage(stages):
    before, after = stages["mix"]
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    total = lambda df: df.select(F.sum(words)).first()[0]
    assert abs(total(after) / total(before) - 1.5) < 0.2
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_pieces_stage(stages):
    before, after = stages["pieces"]
    model = piece_codec.load_model("/opt/tokenizers/piece_bpe_32k.model")
    assert after.count() == before.count() and after.where("not round_trip").count() == 0
    r = after.first()
    assert model.decode(pa.array([r.piece_ids], pa.list_(pa.int32()))).to_pylist() == [r.text]


def test_run(spark, sf, stages):
    assert P.run(spark, sf).count() == stages["pieces"][1].count()


def test_stages_with_odd_rows(spark, sf, tmp_path):
    """Nulls, repeated ids and rows, long texts and clashing columns pass every stage; its decisions hold."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    good = [r.text for r in docs.where("lang = 'en' and n_chars > 300").limit(3).collect()]
    rows = [(1, good[0], "en", "s", 1), (3, good[0], "en", "s", 1), (3, good[1], "en", "s", 1), (None, good[2], None, None, None), (None, good[0], "en", None, 2), (7, None, "en", "s", 0), (8, "", "en", "s", 0), (9, " \n\t " * 50_000, "en", "s", 0), (10, good[1] * 200, "en", "s", 0)]
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id > 20").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    clash = ("target", "size", "score", "component_id", "fp", "__x", "n", "a.b")
    for c in clash:
        odd = odd.withColumn(c, F.lit("own"))
    before = odd
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, before, sf).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if name == "pieces":
            assert after.where("not round_trip").count() == 0 and after.count() == before.count()
            continue
        assert after.columns == odd.columns and all(after.where(F.col(f"`{c}`") != "own").count() == 0 for c in clash)
        if name == "language":
            assert after.where("trim(coalesce(text, '')) = ''").count() == 0
        if name == "near_duplicates":
            texts = [(r.doc_id, r.text) for r in after.collect()]
            assert sum(t == good[0] for _, t in texts) == 1 and (1, good[0]) in texts  # the smallest id stands for the copies
            assert (3, good[1]) in texts or (10, good[1] * 200) in texts and (None, good[2]) in texts
        before = after


def test_stages_on_empty_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
