import random
from collections import Counter

import numpy as np
import pytest

from stratalog.llm import suffixes


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), spans, np.frombuffer(r, np.uint8)[~gone].tobytes()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abé ", k=rng.choice([5, 50, 300]))) for _ in range(6)]
    texts = [None, "", "short", "a" * 200, "ab" * 90, "a" * 200 + "b"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(base)
            a = rng.randrange(len(p))
            parts.append(p[a : a + rng.choice([20, 45, 60, 200])] if rng.random() < 0.7 else "".join(rng.choices("abcdefgh", k=rng.randrange(60))))
        texts.append("".join(parts))
    return [*texts, texts[10], texts[11]]


@pytest.mark.parametrize("seed,length,gram,pairwise", [(0, 40, 10, 12), (1, 40, 10, 0), (2, 41, 20, 12), (3, 16, 4, 2)])
def test_removal_against_brute_force(spark, monkeypatch, seed, length, gram, pairwise):
    monkeypatch.setattr(suffixes, "PAIRWISE", pairwise)
    texts = corpus(seed)
    rows = [(i if i % 9 else None, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    got = sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, length=length, gram=gram).collect())))
    assert got == sorted(str((r[0], *w)) for r, w in zip(rows, brute(texts, length), strict=True))


@pytest.mark.parametrize("seed", [0, 4])
def test_contexts_of_crowded_anchor_strings_are_counted_by_window(spark, monkeypatch, seed):
    monkeypatch.setattr(suffixes, "HOT", 1)
    texts = [*corpus(seed), *(f"{i:03d}" * (i % 5) + "a passage that stands in many surroundings, 50 letters." + f"{i:04d}" for i in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, length=40, gram=10).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_strings_on_which_polynomial_hashes_agree_are_told_apart(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word[:1500], word[:1500].translate(str.maketrans("ab", "ba")), "c" * 100 + word[:1024]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()}
    assert [got[i] for i in range(3)] == brute(texts, 400)


def test_a_very_long_text(spark):
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefgh ", k=700))
    long = "".join(rng.choices("abcdefghij ", k=3_000_000))
    texts = [long[:1_000_000] + passage + long[1_000_000:], "x" + passage, "é" * 300]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (3_000_700, 700, 1), 1: (701, 700, 1), 2: (600, 600, 1)}


def test_passages_of_over_50_words_are_cut_from_400_bytes_on(spark):
    short, enough, own = (" ".join(f"{c}{i:04d}" for i in range(67))[:n] for c, n in (("u", 399), ("v", 400), ("w", 400)))
    assert all(len(p.split()) > 50 for p in (short, enough, own))
    texts = [f"a{short}b", f"c{short}d", f"e{enough}f", f"g{enough}h", f"i{own}j{own}k"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(5)] == [(401, 0, 0, texts[0].encode()), (401, 0, 0, texts[1].encode()), (402, 400, 1, b"ef"), (402, 400, 1, b"gh"), (803, 800, 2, b"ijk")]


def test_the_same_row_twice_repeats_itself(spark):
    df = spark.createDataFrame([(1, "x" * 10 + "abcdefghij" * 3), (1, "x" * 10 + "abcdefghij" * 3)], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in suffixes.remove_repeats(df, length=30, gram=8).collect()] == [(40, 1)] * 2


def test_front_coding_and_loser_tree():
    rng = random.Random(0)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        for r in runs:
            assert [s for s, _ in suffixes.front_decode(suffixes.front_code(r))] == r
        tree = suffixes.LoserTree([((s, n, i) for s, n in suffixes.front_decode(suffixes.front_code(r))) for i, r in enumerate(runs)])
        got = list(tree)
        assert [s for s, _, _ in got] == sorted(s for r in runs for s in r)
        for (a, _, _), (b, n, _) in zip(got[:-1], got[1:], strict=True):
            assert n == suffixes.common_prefix(a, b)


def test_sliding_minima():
    x = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 2, 3, 7, 8, 50):
        assert suffixes.sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(len(x) - w + 1)]


def test_no_documents(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
