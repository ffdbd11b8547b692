import random

from stratalog.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window int"


def conversations(seed):
    rng = random.Random(seed)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "<^|", "<<|", "<", "|", "^", "\n", "hello world ", "é ß ", "<|nl|>", "<|im_end|>\n", "\\", ""]
    rows = []
    for c in [-1, 0, 1, 2, None]:
        n = rng.choice([1, 2, 5, 60])
        for t in range(n):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "tool\nx", None])
            rows.append((c, t if rng.random() < 0.9 else None, role, rng.choice([None, "".join(rng.choices(bits, k=rng.randrange(12)))]), 7))
    return rows


def key(x):
    return (x is not None, x if x is not None else 0)


def test_windows_read_back(spark):
    for seed in range(3):
        rows = conversations(seed)
        for budget, history in ((8, 4), (512, 128)):
            windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=budget, history=history)
            got = {r.conv_id: r for r in chat.read_windows(windows).collect()}
            for c in {r[0] for r in rows}:
                turns = sorted(((t, r or "", x or "") for k, t, r, x, _ in rows if k == c), key=lambda v: (key(v[0]), v[1], v[2]))
                assert [(t.role, t.text) for t in got[c].turns] == [v[1:] for v in turns]
                assert got[c].targets == [v[2] for v in turns if v[1] == "assistant"]


def test_spans_history_and_system(spark):
    rows = [(1, 0, "system", "be kind", 0)] + [(1, i, "user" if i % 2 else "assistant", "w " * 4, 0) for i in range(1, 13)]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=10, history=5).orderBy("window").collect()
    assert [w.n_turns for w in windows] == [3, 2, 2, 2, 2, 2] and [w.n_repeated for w in windows] == [0, 2, 2, 2, 2, 2]
    for w in windows[1:]:
        assert w.formatted.startswith("<|im_start|>system\nbe kind<|im_end|>\n")
        masked = "".join(w.formatted[s.start : s.end] for s in w.loss)
        assert masked == "w " * 4 and all(w.formatted.rfind("<|im_start|>assistant\n", 0, s.start) + len("<|im_start|>assistant\n") == s.start for s in w.loss)


def test_sections_and_turns_without_words(spark, monkeypatch):
    """Spans are chosen section by section, and a turn without words counts as one token, so windows stay bounded."""
    monkeypatch.setattr(chat, "SECTION", 2)
    rows = [(c, i, "system" if i == 0 and c else "assistant" if i % 2 else "user", None if i % 3 == 0 else f"{'w ' * (i % 5)}{i}", 0) for c in range(2) for i in range(400)]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA).repartition(3), budget=12, history=6)
    assert max(w.n_turns + w.n_repeated for w in windows.collect()) <= 12 + 6 + 1
    assert sorted((w.conv_id, w.window) for w in windows.collect()) == [(c, k) for c in range(2) for k in range(windows.where(f"conv_id = {c}").count())]
    got = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    for c in range(2):
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x or "") for k, _, r, x, _ in rows if k == c]
        assert got[c].targets == [x or "" for k, _, r, x, _ in rows if k == c and r == "assistant"]


def test_a_long_turn_is_a_window_of_its_own(spark):
    rows = [(1, 0, "user", "x " * 100, 0), (1, 1, "assistant", "y", 0), (1, 2, "user", "z " * 100, 0)]
    assert [w.n_turns for w in chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=50).orderBy("window").collect()] == [1, 1, 1]


def test_long_conversations_and_no_python(spark):
    rows = [(1, i, "assistant", f"turn {i}", 0) for i in range(3000)]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=64, history=16)
    read = chat.read_windows(windows)
    got = read.first()
    assert len(got.turns) == 3000 and got.targets == [f"turn {i}" for i in range(3000)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_very_long_conversation_and_a_very_long_turn(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}", 0) for i in range(20_000)] + [(2, 0, "assistant", "<|im_end|> é " * 100_000, 0)]
    got = {r.conv_id: r for r in chat.read_windows(chat.format_windows(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [t.text for t in got[1].turns] == [f"turn {i}" for i in range(20_000)] and len(got[1].targets) == 10_000
    assert got[2].targets == [rows[-1][3]]


def test_no_turns(spark):
    assert chat.read_windows(chat.format_windows(spark.createDataFrame([], SCHEMA))).count() == 0
