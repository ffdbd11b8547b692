import os

import numpy as np
import pytest

from stratalog.llm import tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="the public vocabulary is not here")
TEXTS = [None, "", "\n", "one line", "two\nlines here\n", "é ß\n\n\n  indented\tñ 😀", "x\n" * 500, "word " * 20_000]


def brute(field_texts, by_line, rule):
    encoding, lengths = tokens.encoder()
    joined = "\n".join(t or "" for t in field_texts)
    raw = joined.encode()
    sections, at = [], 0
    for f, t in enumerate(field_texts):
        data = (t or "").encode() + (b"\n" if f < len(field_texts) - 1 else b"")
        own = (t or "").encode()
        cuts = [0] + ([i + 1 for i, c in enumerate(own) if c == 10 and i + 1 < len(own)] if by_line else [])
        for k, c in enumerate(cuts):
            end = cuts[k + 1] if k + 1 < len(cuts) else len(data)
            sections.append([f, k, at + c, at + end, 0, 0])
        at += len(data)
    place = 0
    for t in encoding.encode_ordinary(joined):
        size = int(lengths[t])
        over = [s for s in sections if s[2] < place + size and s[3] > place]
        if rule == "first":
            to = over[0]
        elif rule == "last":
            to = over[-1]
        else:
            to = max(over, key=lambda s: min(s[3], place + size) - max(s[2], place))
        to[4] += 1
        to[5] += len(over) > 1
        place += size
    return [(f, k, len(raw[:a].decode()), len(raw[:b].decode()), n, x) for f, k, a, b, n, x in sections]


@needs_vocabulary
@pytest.mark.parametrize("rule", tokens.RULES)
@pytest.mark.parametrize("by_line", [True, False])
def test_counts_against_brute_force(spark, rule, by_line):
    rows = [(i, t, "src é" if i % 3 else None, 0) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, source string, n_tokens int").repartition(2)
    got = {}
    for r in tokens.count_tokens(df, fields=("source", "text"), by_line=by_line, rule=rule).collect():
        got.setdefault(r.doc_id, []).append((("source", "text").index(r.field), r.section, r.start, r.end, r.n_tokens, r.n_crossing))
    for i, t, source, _ in rows:
        assert sorted(got[i]) == sorted(brute([source, t], by_line, rule) * (2 if i == 4 else 1)), i


@needs_vocabulary
def test_totals_are_those_of_the_whole_text(spark):
    encoding, _ = tokens.encoder()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    total = {r.doc_id: r.n for r in tokens.count_tokens(df).groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert total == {i: len(encoding.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}
    assert tokens.count_tokens(df.limit(0)).count() == 0


def test_allocation_rules():
    ends, cut = np.array([2, 5, 9, 10]), np.array([0, 4, 6])
    assert tokens.allocate(ends, cut, "first")[0].tolist() == [0, 0, 1, 2]
    assert tokens.allocate(ends, cut, "last")[0].tolist() == [0, 1, 2, 2]
    assert tokens.allocate(ends, cut, "most")[0].tolist() == [0, 0, 2, 2]
    assert tokens.allocate(ends, cut, "most")[1].tolist() == [False, True, True, False]
    with pytest.raises(ValueError):
        tokens.count_tokens(None, rule="other")
