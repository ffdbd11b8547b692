"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage with block-max WAND.

Impacts are divided by the score of an item for its own text, so a passage's score for an item is the share of the
item that it covers, from 0 to 1. Items are indexed by length class, and a class has passages of its own length: what
is found of an item depends neither on the other items' lengths nor on how items are dealt over indexes.

Passages are pruned in batches first: per range of ``RANGE`` neighbouring items, the sum of the largest impacts of the
passage's terms there, over the terms' own ranges alone. The passages that some range admits are then evaluated one by
one with block-max WAND: cursors over the terms' postings in order of items, a pivot where the cursors' upper bounds
reach the threshold, the bound of the blocks around the pivot, and skips past blocks that cannot reach it. Everything
at the threshold or above is verified on word trigrams of the item's question and answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .ngram_join import word_hashes

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of the trigrams of its question and of its answer.
SCORE = 0.5
OVERLAP = 0.5
#: Postings of a block, and items of a range.
BLOCK, RANGE = 8, 4
#: Words of the items of an index that is broadcast, which bounds its size (about 20 bytes a word); more items make more
#: indexes, each queried by all passages in a pass of its own.
INDEX_WORDS = 1 << 20
#: The length classes of items end at this many words and its doubles. Passages of a class start so many words apart and
#: are twice as long, so that an item lies wholly in one.
STRIDE = 32
NGRAM = 3
#: Bounds that are held at once.
CELLS = 1 << 20

#: ASCII that separates words becomes a space; everything else, lower-cased before, stays.
_SPLIT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def flat(text: str) -> bytes:
    return text.lower().encode(errors="surrogatepass").translate(_SPLIT)


def words(text: str) -> list[bytes]:
    return flat(text).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words before the last sentence and those of the last sentence; of a single sentence, the first two thirds and the rest."""
    sentences = [w for x in re.split(r"(?<=[.!?])\s+", text.strip()) if (w := words(x))]
    if len(sentences) > 1 and len(sentences[-1]) >= NGRAM and sum(map(len, sentences[:-1])) >= NGRAM:
        return [w for x in sentences[:-1] for w in x], sentences[-1]
    flat = [w for x in sentences for w in x]
    cut = len(flat) - max(min(NGRAM, len(flat)), len(flat) // 3) if len(flat) >= 2 * NGRAM else len(flat)
    return flat[:cut], flat[cut:]


def ngrams(tokens: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(NGRAM, len(tokens))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of flat texts, and the offsets of texts among them."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return word_hashes(np.frombuffer(b"".join(texts), np.uint8), at)


def stride_of(n_words: int) -> int:
    """The length class of an item."""
    return STRIDE << max(0, -(-n_words // STRIDE) - 1).bit_length()


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of these sizes, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


@dataclass
class Lane:
    """The inverted index of one length class: per term of the vocabulary its postings by item, and its largest impact in each range of items."""

    stride: int
    items: list[int]
    parts: list[tuple[set, set]] = field(repr=False)
    post_at: np.ndarray
    post_item: np.ndarray
    post_impact: np.ndarray
    range_at: np.ndarray
    range_no: np.ndarray
    range_max: np.ndarray
    _cursors: dict[int, tuple] = field(repr=False, default_factory=dict)

    @classmethod
    def build(cls, stride: int, rows: list[tuple[int, str]], vocabulary: dict[bytes, int], frequency: Counter, n_items: int, mean_length: float) -> Lane:
        bags = [Counter(words(text)) for _, text in rows]
        # Items that share rare terms come together, so that the maxima of ranges and blocks are close to their items' impacts.
        order = sorted(range(len(rows)), key=lambda i: (min((frequency[w], w) for w in bags[i]), rows[i]))
        rows, bags = [rows[i] for i in order], [bags[i] for i in order]
        postings: list[tuple[int, int, float]] = []
        for i, bag in enumerate(bags):
            length = sum(bag.values())
            impact = {w: math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length)) for w, tf in bag.items()}
            whole = math.fsum(impact.values())
            postings += [(vocabulary[w], i, x / whole) for w, x in impact.items()]
        postings.sort()
        term, item, impact = (np.array(x, t) for x, t in zip(zip(*postings, strict=True), (np.int64, np.int32, np.float64), strict=True))
        edges = np.arange(len(vocabulary) + 1)
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (item[1:] // RANGE != item[:-1] // RANGE)))
        parts = [tuple(map(ngrams, question_and_answer(text))) for _, text in rows]
        return cls(stride, [i for i, _ in rows], parts, np.searchsorted(term, edges), item, impact, np.searchsorted(term[new], edges), item[new] // RANGE, np.maximum.reduceat(impact, new))

    def cursor(self, term: int) -> tuple[list[int], list[float], list[int], list[float], float]:
        """(items, impacts, last item of each block, largest impact of each block, largest impact) of a term's postings."""
        if term not in self._cursors:
            a, b = self.post_at[term], self.post_at[term + 1]
            items, impacts = self.post_item[a:b].tolist(), self.post_impact[a:b].tolist()
            cut = range(0, len(items), BLOCK)
            self._cursors[term] = (items, impacts, [items[k : k + BLOCK][-1] for k in cut], [max(impacts[k : k + BLOCK]) for k in cut], max(impacts, default=0.0))
        return self._cursors[term]

    def wand(self, terms: list[int], threshold: float) -> Iterator[tuple[int, float]]:
        """(item, score) of all items at ``threshold`` or above, by block-max WAND over the postings of distinct terms."""
        slack = threshold - 1e-9
        # A cursor: [item, place, postings].
        cursors = [[x[0][0], 0, x] for x in map(self.cursor, terms) if x[0]]

        def advance(until: int, to: int) -> None:
            for c in cursors[:until]:
                if c[0] < to:
                    c[1] = bisect_left(c[2][0], to, c[1])
                    c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else -1
            cursors[:] = [c for c in cursors if c[0] >= 0]

        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, k = 0.0, 0
            while k < len(cursors) and bound < slack:
                bound += cursors[k][2][4]
                k += 1
            if bound < slack:
                return
            pivot = cursors[k - 1][0]
            while k < len(cursors) and cursors[k][0] == pivot:
                k += 1
            bound, after = 0.0, cursors[k][0] if k < len(cursors) else pivot + (1 << 31)
            for c in cursors[:k]:
                block = bisect_left(c[2][2], pivot)
                if block < len(c[2][2]):
                    bound += c[2][3][block]
                    after = min(after, c[2][2][block] + 1)
            if bound < slack:
                advance(k, after)  # no item before can reach it with these blocks
            elif cursors[0][0] == pivot:
                score = math.fsum(c[2][1][c[1]] for c in cursors[:k])
                if score >= slack:
                    yield pivot, score
                advance(k, pivot + 1)
            else:
                advance(k, pivot)

    def retrieve(self, starts: np.ndarray, terms: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) of all pairs at ``threshold`` or above; ``terms`` holds the distinct terms of each passage from its start on."""
        if not len(self.items) or not len(terms):
            return
        ranges = -(-len(self.items) // RANGE)
        ends = np.append(starts[1:], len(terms))
        most = max(1, CELLS // ranges)
        for p in range(0, len(starts), most):
            q = min(p + most, len(starts))
            some = terms[starts[p] : ends[q - 1]]
            size = self.range_at[some + 1] - self.range_at[some]
            at = spread(self.range_at[some], size)
            cell = np.repeat(np.repeat(np.arange(q - p), ends[p:q] - starts[p:q]), size) * ranges + self.range_no[at]
            bound = np.bincount(cell, self.range_max[at], (q - p) * ranges)
            for i in np.unique(np.flatnonzero(bound >= threshold - 1e-9) // ranges).tolist():
                for item, score in self.wand(terms[starts[p + i] : ends[p + i]].tolist(), threshold):
                    yield p + i, item, score


@dataclass
class Index:
    """The items of one pass: their words' hashes in order, and a lane for every length class."""

    vocabulary: np.ndarray
    lanes: list[Lane]

    @classmethod
    def build(cls, rows: list[tuple[int, str]], frequency: Counter, n_items: int, mean_length: float) -> Index:
        lengths = [len(words(text)) for _, text in rows]
        known = sorted({w for _, text in rows for w in words(text)})
        h, _ = hashes(known)
        order = np.argsort(h)
        number = {known[k]: i for i, k in enumerate(order.tolist())}
        classes = sorted(set(map(stride_of, lengths)))
        return cls(h[order], [Lane.build(s, [r for r, n in zip(rows, lengths, strict=True) if stride_of(n) == s], number, frequency, n_items, mean_length) for s in classes])


def build_indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes of all items, each with at most ``INDEX_WORDS`` words (or one longer item).

    Items stream to the driver in two passes, one index's items at a time; document frequencies are over all of them.
    Repeated rows count once. Items without an id, null and wordless ones are left out.
    """
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t")
    frequency, n, total = Counter(), 0, 0
    for r in rows.toLocalIterator():
        w = words(r.t)
        frequency.update(set(w))
        n, total = n + bool(w), total + len(w)
    part, held = [], 0
    for r in rows.toLocalIterator():
        size = len(words(r.t))
        if size:
            if part and held + size > INDEX_WORDS:
                yield Index.build(part, frequency, n, total / n)
                part, held = [], 0
            part.append((r.i, r.t))
            held += size
    if part:
        yield Index.build(part, frequency, n, total / n)


LEAK = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,n_passages:int,first_word:int>>"


def passages_of(stride: int, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, first: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, terms): the distinct terms of each passage. Passage p of a text covers words p * stride up to (p + 2) * stride; its last one may be shorter."""
    chunk = place // stride
    one, two = chunk < (first[1:] - first[:-1])[doc], chunk >= 1
    key = np.unique(np.concatenate([(first[doc] + chunk)[one] * n_terms + ids[one], (first[doc] + chunk - 1)[two] * n_terms + ids[two]]))
    return np.searchsorted(key, np.arange(first[-1]) * n_terms), key % n_terms


def document_leaks(index: Index, texts: list[str], threshold: float, overlap: float) -> list[list[dict]]:
    """The verified leaks of each text."""
    bodies = [flat(x) for x in texts]
    h, base = hashes(bodies)
    n_terms = len(index.vocabulary)
    spot = np.minimum(np.searchsorted(index.vocabulary, h), n_terms - 1)
    known = np.flatnonzero(index.vocabulary[spot] == h)
    length = np.diff(base)
    doc = np.searchsorted(base, known, side="right") - 1
    place, ids = known - base[doc], spot[known]
    out: list[dict[int, dict]] = [{} for _ in texts]
    tokens: dict[int, list[bytes]] = {}
    for lane in index.lanes:
        stride = lane.stride
        first = np.concatenate([[0], np.cumsum(np.maximum(-(-length // stride) - 1, 1))])
        found: dict[tuple[int, int], dict] = defaultdict(dict)
        for p, item, score in lane.retrieve(*passages_of(stride, doc, place, ids, first, n_terms), threshold):
            d = int(np.searchsorted(first, p, side="right") - 1)
            begin = (p - int(first[d])) * stride
            if d not in tokens:
                tokens[d] = bodies[d].split()
            seen = ngrams(tokens[d][begin : begin + 2 * stride])
            question, answer = (len(x & seen) / len(x) if x else 1.0 for x in lane.parts[item])
            if question >= overlap and answer >= overlap:
                old = found[d, item]
                best = max(old, {"score": score, "question_overlap": question, "answer_overlap": answer}, key=lambda x: x.get("score", -1))
                found[d, item] = best | {"n_passages": old.get("n_passages", 0) + 1, "first_word": min(old.get("first_word", begin), begin)}
        for (d, item), x in found.items():
            _better(out[d], {"item_id": lane.items[item]} | x)
    return [sorted(x.values(), key=lambda x: x["item_id"]) for x in out]


def _better(leaks: dict[int, dict], leak: dict) -> None:
    """Of several texts of one item, the one with the largest score counts, on a tie the one that comes first."""
    old = leaks.get(leak["item_id"])
    if old is None or (-leak["score"], leak["first_word"]) < (-old["score"], old["first_word"]):
        leaks[leak["item_id"]] = leak


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = SCORE, overlap: float = OVERLAP, leaks: str = "leaks") -> DataFrame:
    """Add ``leaks``: the benchmark items that the whole text of each row contains, by item_id.

    An item is contained if a passage of the text reaches ``threshold`` of the item's BM25 score and ``overlap`` of the
    trigrams of both its question and its answer, each bound included. Null and empty texts, and an empty benchmark,
    give no leaks. An item is listed once: with repeated rows it counts once, with several texts the one with the largest
    score counts. Repeated rows of ``docs`` each get their leaks. Extra columns pass through; one named like the leaks is
    replaced. Each index is broadcast by itself, and its size is bounded.
    """
    keep = [c for c in docs.columns if c != leaks]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.array().cast(LEAK).alias(leaks))
    schema = out.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("n_passages", pa.int32()), ("first_word", pa.int32())]))
    for index in build_indexes(benchmark, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                texts = [x or "" for x in batch.column(text).cast(pa.string()).to_pylist()]
                found = document_leaks(held.value, texts, threshold, overlap)
                old = batch.column(leaks).to_pylist()
                both = []
                for lists in zip(old, found, strict=True):
                    one: dict[int, dict] = {}
                    for leak in (x for some in lists for x in some or ()):
                        _better(one, leak)
                    both.append([one[i] for i in sorted(one)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(both, kind)], [*keep, leaks])

        out = out.mapInArrow(run, schema)
    return out
