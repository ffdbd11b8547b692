import os
import random

import pytest

from stratalog.llm import pieces

MODEL = pieces.MODEL
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="the public vocabulary is not here")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "Hello world", "  Hello   world\n foo\tbar ﬁ Ａ ñ​", "\n", "\n\nx\n", "line one\nline two \n  three", "12 345,6", "▁x ▁", "\x01 \x01a b\x01c",
    "日本語 テキスト 😀😀 é", "x" * 500 + " y", "in" * 4000, " " * 100 + "z", "a" + " " * 17 + "b" + " " * 40 + "c", "don't won't", "\r\n a\r\n", "\x00", "ab\x01 cd",
    "word. word, word) . , word.) é. Ｘ. ., word.. a.b.\nend.\n.", "q" * 80 + ". z",
]


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id long, text string, ids string")


@needs_model
def test_ids_are_the_librarys(spark):
    import sentencepiece

    rng = random.Random(4)
    letters = ["in", "the", "er", "on", " ", "  ", "a", "t", "▁", "\n", "é", "9", ".", ",", "th", "ing", "q", "ß"]
    rows = TEXTS + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(300)]
    model = pieces.PieceModel.load(MODEL)
    out = {r.doc_id: r for r in pieces.decode(pieces.encode(texts(spark, rows), model), model).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in enumerate(rows):
        want = library.encode(t or "")
        assert list(out[i].ids) == want, repr(t)
        assert out[i].decoded == (t or "").replace("▁", " ")
        assert library.decode(want) == out[i].decoded or "\x00" in (t or "") or "▁" in (t or "") or t is not None and t.startswith(" ")


@needs_model
def test_texts_are_decoded_where_they_are_encoded(spark):
    """One Python worker a task does both, and gives what two one after the other give."""
    model = pieces.PieceModel.load(MODEL)
    docs = texts(spark, TEXTS * 12).withColumnRenamed("ids", "decoded")
    out = pieces.encode(docs, model, decoded="decoded")
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = pieces.decode(pieces.encode(docs, model), model).select("doc_id", "ids", "decoded")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


@needs_model
def test_keys_of_many_texts_are_those_of_each():
    import pyarrow as pa

    pattern = pieces.PieceModel.load(MODEL).word_pattern()
    rng = random.Random(9)
    rows = TEXTS + ["".join(rng.choices("ab  \n▁\x01é.", k=rng.randrange(12))) for _ in range(400)]
    keys, counts = pieces.keys_of(pa.array(rows, pa.string()), pattern)
    want = [pieces.word_keys(t, pattern) for t in rows]
    assert counts.tolist() == list(map(len, want)) and keys.to_pylist() == [w for one in want for w in one]
    assert pieces.keys_of(pa.array([], pa.string()), pattern)[0].to_pylist() == []


@needs_model
def test_long_words_merge_alike():
    import sentencepiece

    model = pieces.PieceModel.load(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    for _ in range(200):
        word = "".join(rng.choices(["in", "th", "e", "r", "on", "q", "st", "ation"], k=rng.randrange(1, 60)))
        assert model.encode_word(pieces.MARK + word) == library.encode(word)


@needs_model
def test_the_fold_of_words_of_every_length(spark):
    """Words up to the longest that is folded, on both sides of where the state changes, against the heap's merges."""
    model = pieces.PieceModel.load(MODEL)
    rng = random.Random(3)
    lengths = [1, 2, 58, 59, 60, 61, 62, 63, 64, 65, 66, 500, 999, 1000] * 3
    words = sorted({pieces.MARK + "".join(rng.choices("inthetaostr", k=k - 1)) for k in lengths} | {pieces.MARK + "a" * 499, pieces.MARK + "in" * 250, pieces.MARK + "=" * 900} | {pieces.MARK * k for k in (2, 3, 9, 15, 31, 58, 60, 61, 70, 400)} | {pieces.MARK * k + "the" for k in (4, 17, 33)})
    df = spark.createDataFrame([(w[1:], w) for w in words], "key string, word string")
    got = {r.key: list(r.codes) for r in pieces.encode_words(df, model).collect()}
    for w in words:
        codes = [model.ids.get(chr(-c - 1), -1) if c < 0 else c for c in got[w[1:]]]
        assert codes == model.encode_word(w), len(w)


@needs_model
def test_a_very_long_text(spark):
    import sentencepiece

    rng = random.Random(6)
    text = " ".join("".join(rng.choices("intheraos", k=rng.choice([2, 5, 9, 300]))) for _ in range(60_000)) + " " + "b" * 200_000
    out = pieces.encode(texts(spark, [text, text]), pieces.PieceModel.load(MODEL)).collect()
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)
    assert list(out[0].ids) == want and out[1].ids == out[0].ids


def unigram():
    letters = {"a": -2.0, "b": -2.5, "c": -3.0, "▁": -4.0, "ab": -3.2, "bc": -3.1, "abc": -5.5, "▁a": -3.5, "▁ab": -4.1, "ca": -4.0, "cab": -4.4}
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), *letters]
    scores = [0.0] * 257 + list(letters.values())
    kinds = [2] + [6] * 256 + [1] * len(letters)
    return pieces.PieceModel.of(names, scores, kinds, pieces.UNIGRAM), letters


def test_viterbi_against_all_segmentations(spark):
    model, letters = unigram()
    rng = random.Random(2)
    rows = ["".join(rng.choices("abc xé", k=rng.randrange(12))) for _ in range(60)] + ["abcabcab" * 12]
    out = {r.doc_id: r.ids for r in pieces.encode(texts(spark, rows), model).collect()}
    low = min(model.scores) - 10.0

    def best(word):
        table = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(end):
                part = word[start:end]
                if part in letters or end - start == 1:
                    options.append((table[start][0] + letters.get(part, low), [*table[start][1], part]))
            table.append(max(options, key=lambda o: o[0]))
        return table[-1]

    score = {model.ids[p]: s for p, s in letters.items()}
    for i, t in enumerate(rows):
        want, got, at = 0.0, 0.0, 0
        for word in model.word_pattern().findall(pieces.MARK + t.replace(" ", pieces.MARK)) if t else []:
            want += best(word)[0]
        while at < len(out[i]):
            if out[i][at] in score:
                got, at = got + score[out[i][at]], at + 1
            else:  # é takes two bytes, x one
                got, at = got + low, at + (2 if model.pieces[out[i][at]] == "<0xC3>" else 1)
        assert abs(want - got) < 1e-6, repr(t)
        assert b"".join(model.pieces[k].replace("▁", " ").encode() if model.kinds[k] == 1 else bytes([k - 1]) for k in out[i]).decode() == (" " + t if t else "")


@needs_model
def test_viterbi_over_the_public_scores(spark):
    model = pieces.PieceModel.load(MODEL).by_scores()
    rng = random.Random(7)
    rows = [t for t in TEXTS if t is None or len(t) < 2000] + [" ".join("".join(rng.choices(["in", "th", "e", "r", "on", "q", "st", "ation", "."], k=rng.randrange(1, 7))) for _ in range(30)) for _ in range(40)]
    out = {r.doc_id: list(r.ids) for r in pieces.encode(texts(spark, rows), model).collect()}
    pattern = model.word_pattern()
    for i, t in enumerate(rows):
        assert out[i] == [k for w in pieces.word_keys(t or "", pattern) for k in model.encode_word(pieces.word_of(w))], repr(t)


def test_models_that_cannot_be_used():
    with pytest.raises(ValueError):
        pieces.PieceModel.of(["<unk>", "a▁b"], [0, -1], [2, 1], pieces.BPE)


@needs_model
def test_no_documents(spark):
    model = pieces.PieceModel.load(MODEL)
    assert pieces.decode(pieces.encode(texts(spark, []), model), model).count() == 0
