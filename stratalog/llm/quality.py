"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

Line features come from the line and its two neighbours. Forward-backward marginals, weighted by line length, are
averaged over the document, and a logistic function of that average, fitted on the same labelled rows, is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from .common import mix64, random_words, slices, utf8

#: Defaults of ``train``: labelled documents that the model is fitted on, those with the smallest hashes, and lines beyond
#: which a sample of their blocks of contiguous lines is used, those with the smallest hashes.
SAMPLE_DOCS = 4000
SAMPLE_LINES = 120_000
BLOCK = 256
#: Scores from here on count as good.
THRESHOLD = 0.3
ROUNDS = 250
RATE = 0.1
RIDGE = 1e-3
#: Chains longer than this are folded one by one.
LONG = 3000

_T = random_words(256, 11)
_PLACE = random_words(64, 12)


def _classes() -> np.ndarray:
    """Per byte, one bit a class: 1 upper, 2 letter, 4 digit, 8 symbol, 16 bar, 32 sentence end, 64 space, 128 shout."""
    out = np.zeros(256, np.uint8)
    for c in range(256):
        x = chr(c)
        out[c] |= 1 * (c < 128 and x.isupper()) | 2 * (c >= 128 or x.isalpha()) | 4 * (c < 128 and x.isdigit())
        out[c] |= 8 * (x in "#$%&*@^~_=<>{}[]\\/+`!|") | 16 * (x == "|") | 32 * (x in ".!?:;\"')") | 64 * (c <= 32) | 128 * (x in "!")
    return out


_CLASS = _classes()
FEATURES = ("length", "words", "upper", "digit", "symbol", "bar", "shout", "ended", "word_length", "same_as_last", "repeated", "marked", "line_repeated", "long_word", "short_line")


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features a line, document of the line, bytes of the line) of the lines that are not blank, in order."""
    n = len(data)
    d = len(FEATURES)
    if not n:
        return np.zeros((0, d), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.unique(np.concatenate([at[:-1][at[:-1] < n], np.flatnonzero(data[:-1] == 10) + 1]))
    size = np.diff(np.append(first, n))
    kind = _CLASS[data]
    space = (kind & 64) > 0
    # Words never cross lines, since line feeds are spaces and documents are cut explicitly.
    start = ~space
    start[1:] &= space[:-1]
    start[first] = ~space[first]
    w = np.flatnonzero(start)
    if not len(w):
        return np.zeros((0, d), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = ~space
    stop[:-1] &= space[1:]
    last = first[1:] - 1
    stop[last] = ~space[last]
    w_end = np.flatnonzero(stop) + 1
    length = w_end - w
    inside = np.repeat(w, np.diff(np.append(w, n)))
    place = np.arange(w[0], n) - inside
    hashed = _T[data[w[0] :]] * _PLACE[place & 63]
    hashed[space[w[0] :]] = 0
    h = np.add.reduceat(hashed, w - w[0])
    of = np.searchsorted(first, w, side="right") - 1
    lines = len(first)
    words = np.bincount(of, minlength=lines)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag, first, dtype=np.int64).astype(np.float32)

    total = np.maximum(np.bincount(of, weights=length, minlength=lines), 1)
    per_word = np.maximum(words, 1)
    same = np.zeros(len(w), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    keyed = mix64(h ^ mix64(of.astype(np.uint64)))
    order = np.argsort(keyed)
    again = np.zeros(len(w), bool)
    again[order[1:]] = keyed[order[1:]] == keyed[order[:-1]]
    marked = (kind[w_end - 1] & 8) > 0
    owner = np.searchsorted(at, first, side="right") - 1
    line_hash = np.zeros(lines, np.uint64)
    np.add.at(line_hash, of, h * _PLACE[(np.arange(len(w)) - np.searchsorted(of, of)) & 63])
    line_key = mix64(line_hash ^ mix64(owner.astype(np.uint64) + np.uint64(77)))
    _, inverse, times = np.unique(line_key, return_inverse=True, return_counts=True)
    # The last place of a line that is not a space.
    last_word = np.searchsorted(of, np.arange(lines), side="right") - 1
    ended = (kind[w_end[np.maximum(last_word, 0)] - 1] & 32) > 0
    x = np.stack(
        [
            np.log1p(size) / 8, np.log1p(words) / 6, share((kind & 1) > 0) / np.maximum(share((kind & 2) > 0), 1), share((kind & 4) > 0) / total,
            share((kind & 8) > 0) / total, share((kind & 16) > 0) / per_word, share((kind & 128) > 0) / per_word, ended, total / per_word / 10,
            np.bincount(of, weights=same, minlength=lines) / per_word, np.bincount(of, weights=again, minlength=lines) / per_word,
            np.bincount(of, weights=marked, minlength=lines) / per_word, times[inverse] > 1, np.bincount(of, weights=length > 24, minlength=lines) / per_word, words < 4,
        ],
        axis=1,
    ).astype(np.float32)
    keep = words > 0
    return x[keep], owner[keep], size[keep]


def with_neighbours(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after in its document (zero at the ends), and a constant."""
    n, d = x.shape
    out = np.zeros((n, 3 * d + 3), np.float32)
    out[:, :d], out[:, -1] = x, 1
    if n > 1:
        near = (owner[1:] == owner[:-1])[:, None]
        out[1:, d : 2 * d], out[:-1, 2 * d : 3 * d] = x[:-1] * near, x[1:] * near
        out[1:, -3], out[:-1, -2] = near[:, 0], near[:, 0]
    return out


def marginals(score: np.ndarray, owner: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(bad) of every line by forward-backward, and, if asked, the expected counts of the four transitions.

    ``score`` is the log-potential of bad against good; ``trans`` the 2 x 2 log-potentials of neighbours. Chains are
    advanced side by side, the longest first; the rest of a chain beyond ``LONG`` lines is folded alone.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2)) if pairs else None
    e = np.exp(np.clip(score, -30, 30).astype(np.float64))
    a = np.exp(trans - trans.max())
    _, head, size = np.unique(owner, return_index=True, return_counts=True)
    by = np.argsort(-size, kind="stable")
    head, size = head[by], size[by]
    fore, back = np.empty(n), np.empty(n)
    fore[head] = e[head] / (1 + e[head])
    back[head + size - 1] = 0.5
    negative = -size
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(negative, -t, side="left"))
        if t > LONG and live == 1:
            _fold(fore, back, e, a, int(head[0]), int(size[0]), t)
            break
        i = head[:live] + t
        p = fore[i - 1]
        one, zero = ((1 - p) * a[0, 1] + p * a[1, 1]) * e[i], (1 - p) * a[0, 0] + p * a[1, 0]
        fore[i] = one / (one + zero)
        j = head[:live] + size[:live] - 1 - t
        q, f = back[j + 1], e[j + 1]
        zero, one = a[0, 0] * (1 - q) + a[0, 1] * f * q, a[1, 0] * (1 - q) + a[1, 1] * f * q
        back[j] = one / (one + zero)
    bad = fore * back
    bad = bad / (bad + (1 - fore) * (1 - back))
    if not pairs:
        return bad, None
    i = np.flatnonzero(owner[1:] == owner[:-1])
    left, right = np.stack([1 - fore[i], fore[i]], 1), np.stack([1 - back[i + 1], e[i + 1] * back[i + 1]], 1)
    joint = left[:, :, None] * a[None] * right[:, None, :]
    return bad, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _fold(fore: np.ndarray, back: np.ndarray, e: np.ndarray, a: np.ndarray, head: int, size: int, t: int) -> None:
    a00, a01, a10, a11 = map(float, a.ravel())
    p = float(fore[head + t - 1])
    for i in range(head + t, head + size):
        one, zero = ((1 - p) * a01 + p * a11) * e[i], (1 - p) * a00 + p * a10
        fore[i] = p = one / (one + zero)
    q = float(back[head + size - t])
    for j in range(head + size - 1 - t, head - 1, -1):
        f = e[j + 1]
        zero, one = a00 * (1 - q) + a01 * f * q, a10 * (1 - q) + a11 * f * q
        back[j] = q = one / (one + zero)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Newton's method for a logistic model."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class LineField:
    """The fitted field: emission weights, transitions, and the document's logistic function."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    final: np.ndarray

    def document(self, bad: np.ndarray, owner: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        """Length-weighted shares of bad lines, and the score from them; documents without lines have a share of 1."""
        whole = np.bincount(owner, weights=size, minlength=n)
        share = np.where(whole > 0, np.bincount(owner, weights=size * bad, minlength=n) / np.maximum(whole, 1), 1.0)
        z = _shape(share)
        return 1 / (1 + np.exp(-np.clip(z @ self.final, -30, 30)))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        x, owner, size = line_features(data, at)
        bad, _ = marginals(((with_neighbours(x, owner) - self.mean) / self.scale) @ self.weights, owner, self.trans)
        return self.document(bad, owner, size, len(at) - 1)


def _shape(share: np.ndarray) -> np.ndarray:
    s = np.clip(share, 1e-4, 1 - 1e-4)
    return np.stack([np.log(s / (1 - s)), s, np.ones_like(s)], 1)


def fit_field(x: np.ndarray, owner: np.ndarray, size: np.ndarray, good: np.ndarray) -> LineField:
    """Fit on lines of documents with a label each (``good`` by owner).

    Lines of good documents are good. Lines of bad documents are bad where a logistic model of lines says so, at least
    the worst one of each; this is repeated twice, and the field is then fitted to these labels by its likelihood.
    """
    raw = with_neighbours(x, owner).astype(np.float64)
    mean, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    x = (raw - mean) / scale
    bad_doc = ~good[owner].astype(bool)
    y = bad_doc.astype(np.float64)
    for _ in range(2):
        w = _logistic(x, y, np.ones(len(y)), 1.0)
        p = x @ w
        limit = np.quantile(p[~bad_doc], 0.98) if (~bad_doc).any() else 0
        worst = np.full(len(good), -np.inf)
        np.maximum.at(worst, owner, p)
        y = (bad_doc & ((p > limit) | (p >= worst[owner]))).astype(np.float64)
    w = _logistic(x, y, np.ones(len(y)), 1.0)
    trans = np.zeros((2, 2))
    edge = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][edge].astype(int), y[1:][edge].astype(int)), 1)
    m1, m2, v1, v2 = [np.zeros(len(w) + 4) for _ in range(4)][:2] + [np.zeros(len(w) + 4) for _ in range(2)]
    n = len(y)
    for t in range(1, ROUNDS + 1):
        p, pair = marginals(x @ w, owner, trans, pairs=True)
        g = np.concatenate([x.T @ (p - y) / n + RIDGE * w, (pair - seen).ravel() / n + RIDGE * trans.ravel()])
        m1, v1 = 0.9 * m1 + 0.1 * g, 0.999 * v1 + 0.001 * g * g
        step = RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(v1 / (1 - 0.999**t)) + 1e-8) / (1 + t / 100)
        w, trans = w - step[:-4], trans - step[-4:].reshape(2, 2)
    field = LineField(mean.astype(np.float32), scale.astype(np.float32), w.astype(np.float32), trans, np.zeros(3))
    bad, _ = marginals(x @ w, owner, trans)
    whole = np.maximum(np.bincount(owner, weights=size, minlength=len(good)), 1)
    field.final = _logistic(_shape(np.bincount(owner, weights=size * bad, minlength=len(good)) / whole), good.astype(float), np.ones(len(good)), 0.1)
    return field


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE_DOCS, most_lines: int | None = None) -> LineField:
    """Fit on at most ``most`` labelled documents outside the held-out fold, those with the smallest hashes of their ids.

    Only they reach the driver, as line features. Documents of more than ``most_lines`` lines (``SAMPLE_LINES`` unless given) in all are thinned out
    before: blocks of ``BLOCK`` lines are taken in the order of their hashes, whatever their documents' lengths, up to the
    one that reaches the bound; a document's blocks are put together in order. Rows without a label are ignored; of
    repeated labels the largest counts. Without labels of both classes, every document gets the score of the share
    of good labels (1 without labels).
    """
    most_lines = SAMPLE_LINES if most_lines is None else most_lines
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.max(F.col(f"`{label}`")).cast("int").alias("good"))
    chosen = known.where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "id").withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, owner, size = line_features(*utf8(batch.column("text")))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            ends = [(i, k, a, min(a + BLOCK, cut[i + 1])) for i in range(batch.num_rows) for k, a in enumerate(range(cut[i], cut[i + 1], BLOCK))]
            of = batch.select(["id", "good", "row"]).take(pa.array([e[0] for e in ends], pa.int64()))
            block, lines = pa.array([e[1] for e in ends], pa.int32()), pa.array([int(b - a) for _, _, a, b in ends], pa.int32())
            parts = [pa.array([v[a:b].tobytes() for _, _, a, b in ends], pa.binary()) for v in (x, size.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*of.columns, block, lines, *parts], ["id", "good", "row", "block", "lines", "x", "size"])

    blocks = texts.select("id", "good", "row", "text").mapInArrow(run, "id long, good int, row long, block int, lines int, x binary, size binary")
    blocks = materialize(blocks.withColumn("hash", F.xxhash64("id", "block", "x")), "quality-lines")
    # A block has a line at least, so no more blocks than lines are needed.
    lines = 0
    for r in blocks.select("hash", "row", "lines").orderBy("hash", "row").limit(most_lines).toLocalIterator():
        lines += r.lines
        if lines >= most_lines:
            blocks = blocks.where((F.col("hash") < r.hash) | ((F.col("hash") == r.hash) & (F.col("row") <= r.row)))
            break
    held: dict[int, list] = {}
    for r in blocks.toLocalIterator():
        held.setdefault(r.row, []).append(r)
    xs, owners, sizes, good = [], [], [], []
    for rows in sorted(held.values(), key=lambda v: (sum(r.lines for r in v), v[0].id, v[0].row)):
        for r in sorted(rows, key=lambda r: r.block):
            xs.append(np.frombuffer(r.x, np.float32).reshape(r.lines, -1))
            owners.append(np.full(r.lines, len(good)))
            sizes.append(np.frombuffer(r.size, np.int64))
        good.append(rows[0].good > 0)
    d = 3 * len(FEATURES) + 3
    if len(set(good)) < 2:
        share = sum(good) / len(good) if good else 1.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return LineField(np.zeros(d, np.float32), np.ones(d, np.float32), np.zeros(d, np.float32), np.zeros((2, 2)), np.array([0, 0, np.log(share / (1 - share))]))
    return fit_field(np.concatenate(xs), np.concatenate(owners), np.concatenate(sizes), np.array(good))


def score_quality(docs: DataFrame, field: LineField, text: str = "text", score: str = "score") -> DataFrame:
    """Add ``score`` (0 to 1, higher is better) from the whole text of every row.

    Null, empty and blank texts get the score of a wholly bad text. Other columns pass through; one named like the
    score is replaced.
    """
    keep = [c for c in docs.columns if c != score]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias(score)).schema
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            p = held.value.score(*utf8(batch.column(text).cast(pa.string())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p.astype(np.float64))], [*keep, score])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
