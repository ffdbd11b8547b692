import random
import re

import numpy as np
import pytest

from stratalog.llm import ngram_join
from stratalog.llm.graph import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    common = "this line is in very many documents and says nothing new at all to anyone"
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(100, None), (101, ""), (102, " \n\t"), (103, "One two"), (104, "one TWO"), (105, "É é"), (106, "é É")]
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 12, 40, 150]))
        for j in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((1000 + 10 * i + j, " ".join(copy) + ("\n" + common if rng.random() < 0.4 else "")))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,percent", [(0, 4, 85), (1, 5, 80), (2, 2, 60), (3, 1, 90)])
def test_components_against_all_pairs(spark, seed, n, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in [*rows, rows[0], (None, "null id text here now")]], "doc_id long, text string, component_id int").repartition(3)
    out = ngram_join.jaccard_components(df, n=n, percent=percent).collect()
    assert len(out) == len(rows) + 2
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got.pop(None) == (len(shingles("null id text here now", n)), None)
    assert got == brute(rows, n, percent)


def test_repeated_and_null_ids(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (1, "quite another text that is longer " * 3), (2, words + " tail"), (3, words), (None, words), (None, "nothing else is like this here"), (None, None), (4, "quite another text that is longer " * 3), (5, None)]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got = sorted(((r.doc_id or 0, r.n_shingles, r.class_id, r.component_id) for r in out), key=str)
    assert got == sorted([(1, 37, 1, 1), (1, 6, 1, 1), (2, 38, 2, 1), (3, 37, 1, 1), (0, 37, 1, 1), (0, 3, None, None), (0, 0, None, None), (4, 6, 1, 1), (5, 0, 5, 5)], key=str)


def test_very_long_texts_and_ties_at_the_threshold(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = long[:30_000] + ["x"] * 3 + long[30_000:]
    # 20 single words, 17 of them shared: 17 / 20 is the threshold itself.
    tie = [" ".join(f"t{i}" for i in range(20)), " ".join(f"t{i}" for i in range(17))]
    below = " ".join([*(f"t{i}" for i in range(16)), "other"])
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(reversed(long)))]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    rows = [(1, tie[0]), (2, tie[1]), (3, below)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=1).collect()}
    assert got == {r: c for r, (_, c) in brute(rows, 1, 85).items()} and got[2] == 1


@pytest.mark.parametrize("chunk", [300, 60])
def test_chunks_lose_no_link(spark, monkeypatch, chunk):
    rows = corpus(5) + [(5000 + i, " ".join(f"c{j}" for j in range(60) if j != i % 30) + f" x{i % 7}") for i in range(40)]
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == brute(rows, 4, 85)


def test_crowded_and_frequent_ngrams(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRED", 2)
    monkeypatch.setattr(ngram_join, "SHARED", 10)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == brute(rows, 4, 85)


@pytest.mark.parametrize("seed", range(6))
def test_prefix_tree_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.append(s[1:], 99).astype(np.uint64)) for s in sets[:20]]
    for percent in (50, 70, 85):
        got = ngram_join.join_sets(sets, percent)
        root = list(range(len(sets)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
        same = {(find(a) == find(b)) == (got[a] == got[b]) for a in range(len(sets)) for b in range(len(sets))}
        assert same == {True}


def test_words_on_which_polynomial_hashes_agree_are_told_apart(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word.upper()), (4, "x" * 32 + "y" * 32), (5, "y" * 32 + "x" * 32), (6, "x" * 64), (7, "x" * 32)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_no_documents(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
