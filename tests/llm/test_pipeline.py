import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalog.llm import decontam, ngram_join, pieces, quality, secrets

from .test_decontam import brute as all_passages
from .test_ngram_join import brute as all_pairs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(pieces.MODEL)), reason="test tables are not here")


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert sorted(after.columns) == sorted(columns), name
        kept, had = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert kept <= had and after.count() == len(kept)
        if k == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert {i for i in had if labels.get(i) == 1} <= kept and not {i for i in kept if labels.get(i) == 0}
        elif k == 1:
            groups = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(before, n=5, percent=80).collect()}
            assert kept == set(groups.values())
            want = all_pairs([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert kept == {c for _, c in want.values()}
        elif k == 2:
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            leaks = {r.doc_id for r in decontam.find_leaks(before, bench).where(F.size("leaks") > 0).collect()}
            assert kept == had - leaks and leaks
            rows = before.collect()
            items = [(r.item_id, r.text) for r in bench.collect()]
            assert leaks == {r.doc_id for r, found in zip(rows, all_passages(items, [r.text for r in rows]), strict=True) if found}
        elif k == 3:
            assert kept == had
            again = secrets.find_secrets(after, secrets.infer_grammar(before)).where(F.size("secrets") > 0).count()
            assert again == 0
            assert after.where("n_chars <> char_length(text)").count() == 0
        else:
            assert kept == had and after.where("n_tokens > 0").count() == len(had)
        before = after


def test_odd_documents_pass(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "A good line of plain words without an id.", "en", "s", 41), (3, "A good line of plain words to keep here.", None, None, None), (3, "A good line of plain words to keep here.", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.drop_near_copies(spark, docs, SF).count() == 4
    assert quality.THRESHOLD == 0.3


def test_columns_of_any_name_pass(spark):
    rows = [(i, f"A good line of plain words to keep here, number {i} of them all.", "en", "s", 60, "a", "b", "c", "d") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaks string, secrets string, score string, row string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {(r.leaks, r.secrets, r.score, r.row) for r in out.collect()} <= {("a", "b", "c", "d")}, name


def test_repeated_and_null_ids_lose_only_linked_texts(spark):
    def text(word):
        return " ".join(f"{word}{i}" for i in range(60))

    a, b, c, d, e = map(text, "abcde")
    rows = [(1, a), (1, b), (2, b + " more"), (None, c), (None, c + " more"), (None, d), (5, e), (None, e), (7, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == 5 and {(1, a), (1, b), (None, d), (5, e)} < set(kept)
    assert sum(i is None and t.startswith(c) for i, t in kept) == 1
