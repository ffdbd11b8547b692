import math
import random
from collections import Counter

import numpy as np
import pytest

from stratalog.llm import decontam

rng = random.Random(8)
VOCABULARY = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 7))) for _ in range(400)]


def sentence(r, k):
    return " ".join(r.choices(VOCABULARY, k=k)).capitalize() + "."


ITEMS = [(i, sentence(rng, rng.randrange(6, 30)) + (" " + sentence(rng, rng.randrange(3, 12)) if i % 2 else "")) for i in range(60)]


def impacts(items):
    """Per item the impact of every word, straight from the formula."""
    bags = [Counter(decontam.words(t)) for _, t in items]
    frequency = Counter(w for b in bags for w in b)
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    out = []
    for bag in bags:
        n = sum(bag.values())
        one = {w: math.log(1 + (len(bags) - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) for w, tf in bag.items()}
        out.append({w: x / sum(one.values()) for w, x in one.items()})
    return out


def brute(items, texts, threshold=0.5, overlap=0.5):
    """Leaks of every text: all passages against all items, each item with passages of its own length class."""
    impact, out = impacts(items), []
    for text in texts:
        tokens, found = decontam.words(text or ""), {}
        for (item, body), weights in zip(items, impact, strict=True):
            stride = 32
            while stride < len(decontam.words(body)):
                stride *= 2
            parts = [decontam.ngrams(x) for x in decontam.question_and_answer(body)]
            hits = []
            for begin in range(0, max(1, -(-len(tokens) // stride) - 1) * stride, stride):
                passage = tokens[begin : begin + 2 * stride]
                score, seen = sum(weights.get(w, 0) for w in set(passage)), decontam.ngrams(passage)
                shares = [len(x & seen) / len(x) if x else 1.0 for x in parts]
                if score >= threshold - 1e-9 and min(shares) >= overlap:
                    hits.append((-round(score, 9), begin, *shares))
            if hits:
                found[item] = (round(-min(hits)[0], 6), len(hits), min(h[1] for h in hits))
        out.append(found)
    return out


def indexes(items):
    bags = [Counter(decontam.words(t)) for _, t in items]
    frequency = Counter(w for b in bags for w in b)
    return decontam.Index.build(items, frequency, len(items), sum(sum(b.values()) for b in bags) / len(items))


@pytest.mark.parametrize("block,cells", [(8, 1 << 20), (1, 1), (3, 200)])
def test_pruning_finds_every_pair_above_the_threshold(monkeypatch, block, cells):
    monkeypatch.setattr(decontam, "BLOCK", block)
    monkeypatch.setattr(decontam, "CELLS", cells)
    index = indexes(ITEMS)
    known = sorted({w for _, t in ITEMS for w in decontam.words(t)})
    number = dict(zip(known, np.searchsorted(index.vocabulary, decontam.hashes(known)[0]).tolist(), strict=True))
    r = np.random.default_rng(2)
    passages = [np.unique(r.integers(0, len(index.vocabulary), r.integers(0, 60))) for _ in range(150)]
    passages += [np.array(sorted(number[w] for w in set(decontam.words(t)))) for _, t in ITEMS]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in passages])[:-1]])
    terms = np.concatenate(passages).astype(np.int64)
    weights = {i: {number[w]: x for w, x in one.items()} for (i, _), one in zip(ITEMS, impacts(ITEMS), strict=True)}
    for threshold in (0.1, 0.3, 0.9):
        for lane in index.lanes:
            got = {(p, lane.items[i]): s for p, i, s in lane.retrieve(starts, terms, threshold)}
            want = {(p, i): s for p, t in enumerate(passages) for i in lane.items if (s := sum(weights[i].get(x, 0) for x in t.tolist())) >= threshold}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_leaks_against_all_passages_and_items_however_items_are_dealt(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "INDEX_WORDS", most)
    r = random.Random(5)
    items = [*ITEMS, (60, sentence(r, 400)), (61, sentence(r, 33)), (62, sentence(r, 64)), (63, "one two")]
    texts = [None, "", "one two"]
    for _ in range(80):
        body = [sentence(r, r.randrange(1, 60)) for _ in range(r.randrange(0, 10))]
        for _ in range(r.randrange(0, 3)):
            w = r.choice(items)[1].split()
            k = r.randrange(len(w))
            if r.random() < 0.5:  # a paraphrase: words replaced, or a part left out
                w = [r.choice(VOCABULARY) if r.random() < 0.25 else x for x in w] if r.random() < 0.5 else w[: max(1, k)]
            body.insert(r.randrange(len(body) + 1), " ".join(w))
        texts.append(" ".join(body))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, *items[:5], (None, "no id")], "item_id long, text string")
    got = {x.doc_id: {k.item_id: (round(k.score, 6), k.n_passages, k.first_word) for k in x.leaks} for x in decontam.find_leaks(docs, bench).collect()}
    want = brute(items, texts)
    assert [got[i] for i in range(len(texts))] == want and sum(map(len, want)) > 40


def test_an_item_of_several_texts_is_listed_once(spark):
    bench = spark.createDataFrame([(1, ITEMS[0][1]), (1, ITEMS[1][1]), (2, ITEMS[2][1]), (2, ITEMS[2][1])], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(ITEMS[k][1] for k in (0, 1, 2)))], "doc_id long, text string")
    assert [x.item_id for x in decontam.find_leaks(docs, bench).first().leaks] == [1, 2]


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_planted_leaks_are_found_and_clean_texts_are_not(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "INDEX_WORDS", most)
    r = random.Random(3)
    rows, want = [], {}
    for i in range(120):
        body = [sentence(r, r.randrange(5, 40)) for _ in range(r.randrange(0, 12))]
        planted = sorted(r.sample(range(60), r.choice([0, 0, 1, 2])))
        for p in planted:
            text = ITEMS[p][1]
            body.insert(r.randrange(len(body) + 1), text.upper() if r.random() < 0.3 else text.replace(" ", "  \n"))
        rows.append((i, " ".join(body), "x"))
        want[i] = planted
    rows += [(900, None, "x"), (901, "", "x"), (902, "word " * 60_000 + ITEMS[5][1], "x"), (902, "word " * 60_000 + ITEMS[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([*ITEMS, (70, None), (71, ""), (72, "...")], "item_id long, text string")
    out = decontam.find_leaks(docs, bench).collect()
    assert len(out) == len(rows)
    for row in out:
        found = [x.item_id for x in row.leaks]
        assert found == (want.get(row.doc_id) if row.doc_id < 900 else [5] if row.doc_id == 902 else []), row.doc_id


def test_ties_at_the_bounds_are_leaks(spark):
    words = ITEMS[0][1].split()
    docs = spark.createDataFrame([(1, " ".join(words[: len(words) * 3 // 4]))], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    (leak,) = decontam.find_leaks(docs, bench, threshold=0.2, overlap=0.0).first().leaks
    share = min(leak.question_overlap, leak.answer_overlap)
    assert 0 < leak.score < 1 and 0 <= share < 1
    for threshold, overlap, found in ((leak.score, share, 1), (leak.score + 1e-6, share, 0), (leak.score, share + 1e-6, 0)):
        assert len(decontam.find_leaks(docs, bench, threshold=threshold, overlap=overlap).first().leaks) == found


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, none).first().leaks == []
    assert decontam.find_leaks(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_questions_and_answers():
    assert decontam.question_and_answer("What is it now? It is a cat.") == ([b"what", b"is", b"it", b"now"], [b"it", b"is", b"a", b"cat"])
    q, a = decontam.question_and_answer("one two three four five six seven eight nine")
    assert (len(q), len(a)) == (6, 3)
    assert decontam.question_and_answer("") == ([], []) and decontam.question_and_answer("one two")[0] == [b"one", b"two"]
