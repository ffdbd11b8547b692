import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import quality

SF = "/root/testdata/sf0.1"


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    owner = np.array([0, 0, 0, 0, 1, 2, 2])
    score, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    bad, pairs = quality.marginals(score, owner, trans, pairs=True)
    want_pairs = np.zeros((2, 2))
    for o in range(3):
        i = np.flatnonzero(owner == o)
        weight, mass, edges = 0.0, np.zeros(len(i)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(i)):
            w = np.exp(sum(score[k] * v for k, v in zip(i, y, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
            weight += w
            mass += w * np.array(y)
            for a, b in itertools.pairwise(y):
                edges[a, b] += w
        assert np.allclose(bad[i], mass / weight)
        want_pairs += edges / weight
    assert np.allclose(pairs, want_pairs)


def test_long_chains_fold_alike(monkeypatch):
    rng = np.random.default_rng(1)
    owner, score, trans = np.repeat([0, 1], [50, 3]), rng.normal(size=53), rng.normal(size=(2, 2))
    whole = quality.marginals(score, owner, trans)[0]
    monkeypatch.setattr(quality, "LONG", 5)
    assert np.allclose(quality.marginals(score, owner, trans)[0], whole)


def test_features_do_not_depend_on_neighbouring_documents():
    texts = ["One line here.\nTwo  LINES! here", "", "   \n", "x", "a | b | c\n\na | b | c"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    x, owner, size = quality.line_features(np.frombuffer(b"".join(raw), np.uint8), at)
    for i, r in enumerate(raw):
        alone = quality.line_features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.allclose(alone[0], x[owner == i]) and alone[2].tolist() == size[owner == i].tolist()


def test_scores_against_all_labellings(spark):
    """The whole score of short documents, from the line features on, by summing over every labelling of their lines."""
    rng = np.random.default_rng(5)
    d = len(quality.FEATURES)
    field = quality.LineField(rng.normal(size=3 * d + 3).astype(np.float32) / 9, np.ones(3 * d + 3, np.float32), rng.normal(size=3 * d + 3).astype(np.float32) / 3, rng.normal(size=(2, 2)), np.array([-0.7, 0.4, 0.2]))
    lines = ["A plain sentence of some words.", "BUY NOW!!! $$$ | | |", "x", "12 34 56", "a | b | c | d", "", "   ", "é ß words in others' letters, too."]
    texts = ["\n".join(rng.choice(lines, rng.integers(0, 8))) for _ in range(40)] + ["x"] * 2
    out = quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3), field).collect()
    for r in out:
        raw = r.text.encode()
        x, _, size = quality.line_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        n = len(x)
        zero = np.zeros(d)
        wide = np.array([np.concatenate([x[i], x[i - 1] if i else zero, x[i + 1] if i + 1 < n else zero, [i > 0, i + 1 < n, 1]]) for i in range(n)]).reshape(n, 3 * d + 3)
        e = (wide - field.mean) @ field.weights
        weight, mass = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[k] * v for k, v in enumerate(y)) + sum(field.trans[a, b] for a, b in itertools.pairwise(y)))
            weight += w
            mass += w * np.array(y)
        share = float((size * mass / weight).sum() / size.sum()) if n else 1.0
        s = min(max(share, 1e-4), 1 - 1e-4)
        want = 1 / (1 + np.exp(-(np.array([np.log(s / (1 - s)), s, 1]) @ field.final)))
        assert abs(r.score - want) < 1e-4, r.text


def test_odd_documents(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (5, 1, 0), (8, 0, 0), (8, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    field = quality.train(odd_docs, labels)
    out = quality.score_quality(odd_docs, field).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.score_quality(odd_docs.limit(0), field).count() == 0
    none = quality.train(odd_docs, labels.limit(0))
    assert all(r.score > 0.99 for r in quality.score_quality(odd_docs, none).where("text is not null").collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score_quality(docs, quality.train(docs, labels)).join(labels, "doc_id").where(quality.held_out("doc_id"))
    right = scored.agg(F.avg((F.col("quality") == (F.col("score") >= quality.THRESHOLD).cast("int")).cast("int"))).first()[0]
    assert right > 0.97


def test_line_bound_takes_lines_of_long_documents_too(spark, monkeypatch):
    fitted = {}
    monkeypatch.setattr(quality, "SAMPLE_LINES", 500)
    monkeypatch.setattr(quality, "fit_field", lambda x, owner, size, good: fitted.update(x=x, owner=owner, size=size, good=good))
    texts = [(i, f"A short one, number {i}.") for i in range(40)] + [(i, "\n".join(f"Line {k} of document {i}." for k in range(600))) for i in range(40, 80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int"))
    lines = np.bincount(fitted["owner"])
    assert lines.max() > 1 and 500 <= lines.sum() < 500 + quality.BLOCK
    assert len(fitted["x"]) == len(fitted["size"]) == lines.sum() and len(fitted["good"]) == len(lines)
