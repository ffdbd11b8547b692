"""SentencePiece encoding and decoding by a relational lattice.

The normalised text (a space mark in front, spaces as marks) falls into words that no piece crosses. Distinct words are
taken from all texts; their substrings of up to the longest piece's length are exploded and equi-joined to the piece
table; the edges are grouped by word and folded with Spark's higher-order ``aggregate``. The fold is Viterbi for unigram
models. For merge (BPE) models Viterbi picks other pieces than the model's own rule, so there the fold goes through the
edges in order of score and joins two neighbouring segments where an edge spans just these; where that makes an edge
possible that was met before, it is joined next (``PieceModel.out_of_turn``). The boundaries between segments are the bits of a long for words of up to ``SHORT`` characters, and the characters of a string for longer ones.
The fold's work grows with the square of a word's length, so words beyond ``LONGEST`` characters are merged with a heap
in the Python worker, by the same rule.

Every split of an input file gets the part of the dictionary that its own texts need, as a table in the shared folder,
and the second pass over the split looks its words up there. So texts are never shuffled, and a task holds the words of
a split, whose size Spark's ``maxPartitionBytes`` bounds.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path, materialize
from .common import Prefixes, random_words, release, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of words whose boundaries fit a long, and of words that are folded at all.
SHORT, LONGEST = 60, 1000
#: Characters at a substring's start that say how long pieces with such a start are.
HEAD = 4
#: Distinct words that a task holds before it passes them on, and words whose edges an aggregation keeps before it sorts.
HELD_WORDS = 600_000
HELD_GROUPS = 150_000
#: Words that a task packs at once, and words that are hashed at once.
PACKED = 300_000
HASHED = 30_000
#: Texts that are decoded at once.
DECODED = 128
_VALUES, _BASE = random_words(256, 31), int(random_words(1, 32)[0])
UNIGRAM, BPE = 1, 2
#: Flags of an edge of a merge model, above the id of its piece.
ID_BITS = 18
LATE, TRIGGER = 1 << ID_BITS, 2 << ID_BITS


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """Pieces, scores and kinds (1 normal, 2 unknown, 3 control, 4 user defined, 6 byte) of a model without text normalisation."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    algorithm: int
    ids: dict[str, int] = field(repr=False, default_factory=dict)

    @classmethod
    def load(cls, path: str = MODEL) -> PieceModel:
        """Read a model file on the driver. Models that normalise texts, drop spaces, or have no byte pieces are refused."""
        pieces, scores, kinds, algorithm = [], [], [], UNIGRAM
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                kinds.append(x.get(3, 1))
            elif number == 2:
                algorithm = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or not spec.get(5, 1):
                    raise ValueError("only models that keep texts as they are can be used")
        return cls.of(pieces, scores, kinds, algorithm)

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], kinds: list[int], algorithm: int) -> PieceModel:
        model = cls(pieces, scores, kinds, algorithm)
        model.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
        if kinds.count(6) != 256 or algorithm not in (UNIGRAM, BPE) or 4 in kinds or len(pieces) > 1 << ID_BITS:
            raise ValueError(f"only unigram and merge models with byte pieces, without user-defined ones and of {1 << ID_BITS} pieces at most can be used")
        if any(MARK in p.lstrip(MARK) for p in model.ids):
            raise ValueError("a piece crosses words")
        return model

    def by_scores(self) -> PieceModel:
        """The same pieces as a unigram model: the best sum of scores, whatever the model's own rule."""
        return PieceModel.of(self.pieces, self.scores, self.kinds, UNIGRAM)

    @property
    def first_byte(self) -> int:
        return self.kinds.index(6)

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))

    def word_pattern(self) -> re.Pattern:
        """Words: marks and what follows them; characters that only stand alone in pieces are words of their own."""
        joint = sorted({c for p in self.ids if len(p) > 1 for c in p} - {MARK})
        chars = "[" + re.escape("".join(joint)) + "]"
        return re.compile(f"{MARK}+{chars}*|{chars}+|.", re.DOTALL)

    def tails(self) -> str:
        """Marks of punctuation that no piece has right after a letter, so that they can be cut off words."""
        return "".join(c for c in ".,;:!?" if not any(x.isalpha() and y == c for p in self.ids for x, y in itertools.pairwise(p)))

    def prefixes(self, spark: SparkSession) -> DataFrame:
        """(prefix, lengths): for every start of pieces of ``HEAD`` characters, the lengths of those pieces; no more rows than pieces."""
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) >= HEAD:
                lengths.setdefault(p[:HEAD], set()).add(len(p))
        return spark.createDataFrame([(p, sorted(n)) for p, n in lengths.items()] or [("", [0])], "prefix string, lengths array<int>")

    def table(self, spark: SparkSession) -> DataFrame:
        """The piece table: as many rows as the vocabulary, which bounds its broadcast."""
        rank = {x: k for k, x in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        late, trigger = self.out_of_turn() if self.algorithm == BPE else (set(), set())
        rows = [(p, i | LATE * (p in late) | TRIGGER * (p in trigger), float(self.scores[i]), rank[self.scores[i]]) for p, i in self.ids.items()]
        return spark.createDataFrame(rows, "piece string, id int, score double, rank long")

    def out_of_turn(self) -> tuple[set[str], set[str]]:
        """Pieces of a merge model that may become possible after their turn, and the pieces that may make them so.

        A fold in order of score meets a piece before a part of it whose score is no better: the part then makes the
        piece possible, and the piece comes before everything that follows.
        """
        late, trigger = set(), set()
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                parts = p[:k], p[k:]
                if all(len(x) == 1 or x in self.ids for x in parts):
                    # Of equal scores the leftmost comes first, so a first part of the same score makes nothing late.
                    after = [x for x, tie in zip(parts, (False, True), strict=True) if len(x) > 1 and (self.score(x) < self.scores[i] or tie and self.score(x) == self.scores[i])]
                    if after:
                        late.add(p)
                        trigger.update(after)
        return late, trigger

    def resolve(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for codes: those of characters' pieces, or of their bytes where they have none; and the new lengths of the lists."""
        alone = codes < 0
        kinds, inverse = np.unique(codes[alone], return_inverse=True)
        lists = [[self.ids[c]] if (c := chr(-int(k) - 1)) in self.ids else self.fallback(c) for k in kinds]
        size = np.ones(len(codes), np.int64)
        size[alone] = np.array([len(x) for x in lists], np.int64)[inverse] if len(kinds) else 0
        out = np.repeat(codes, size)
        stop = np.cumsum(size)
        spots = np.flatnonzero(alone)
        if len(kinds):
            first = np.array([x[0] for x in lists])[inverse]
            out[stop[spots] - size[spots]] = first
            for at, k in zip(spots[size[spots] > 1].tolist(), inverse[size[spots] > 1].tolist(), strict=True):
                out[stop[at] - size[at] : stop[at]] = lists[k]
        total = np.concatenate([[0], stop])
        edge = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return out, np.diff(total[edge])

    def score(self, piece: str) -> float:
        return self.scores[self.ids[piece]]

    def fallback(self, text: str) -> list[int]:
        return [self.first_byte + b for b in text.encode()]

    def encode_word(self, word: str) -> list[int]:
        """One word in the process itself, for words beyond ``LONGEST``."""
        return self._merge(word) if self.algorithm == BPE else self._viterbi(word)

    def _viterbi(self, word: str) -> list[int]:
        n, most = len(word), self.longest
        low = min(self.scores) - 10.0
        best: list[tuple[float, int, int | None]] = [(0.0, 0, None)] + [(-np.inf, 0, None)] * n
        for i in range(n):
            for k in range(1, min(most, n - i) + 1):
                piece = self.ids.get(word[i : i + k])
                score = self.scores[piece] if piece is not None else low if k == 1 else None
                if score is not None and best[i][0] + score > best[i + k][0]:
                    best[i + k] = (best[i][0] + score, i, piece)
        out, at = [], n
        while at:
            _, start, piece = best[at]
            out.append([piece] if piece is not None else self.fallback(word[start:at]))
            at = start
        return [i for part in reversed(out) for i in part]

    def _merge(self, word: str) -> list[int]:
        n = len(word)
        end, alive = list(range(1, n + 1)), [True] * n
        before = list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n:
                j = end[i]
                piece = self.ids.get(word[i : end[j]])
                if piece is not None:
                    heapq.heappush(heap, (-self.scores[piece], i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if alive[i] and alive[j] and end[i] == j and end[j] == stop:
                alive[j] = False
                end[i] = stop
                if stop < n:
                    before[stop] = i
                offer(i)
                offer(before[i])
        out, at = [], 0
        while at < n:
            piece = self.ids.get(word[at : end[at]])
            out += [piece] if piece is not None else self.fallback(word[at : end[at]])
            at = end[at]
        return out


#: In front of a key that is a word as it is; other keys lack their first mark, except that a line feed starts a word.
LITERAL = "\x01"


def word_keys(text: str, pattern: re.Pattern) -> list[str]:
    """The words of a text in order, as keys (see ``word_of``); no piece crosses them."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text or LITERAL in text:
        found = pattern.findall(MARK + text.replace(" ", MARK))
        return [w[1:] if w[0] == MARK and w[1:2] not in ("\n", LITERAL) else w if w[0] == "\n" else LITERAL + w for w in found]
    # Single spaces: words are what stands between them, cut before line feeds.
    return text.replace("\n", " \n").split(" ")


def keys_of(texts: pa.Array, pattern: re.Pattern) -> tuple[pa.Array, np.ndarray]:
    """The ``word_keys`` of all texts, one after the other, and how many each text has."""
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.equal(texts, ""), pc.starts_with(texts, " "))
    for x in ("  ", MARK, LITERAL):
        odd = pc.or_(odd, pc.match_substring(texts, x))
    odd = np.asarray(odd)
    lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
    if odd.any():
        rest = pa.array([word_keys(t, pattern) for t in texts.filter(pa.array(odd)).to_pylist()], lists.type)
        order = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
        lists = pa.concat_arrays([lists, rest]).take(pa.array(order))
    return lists.flatten(), np.asarray(pc.list_value_length(lists))


def stems(keys: pa.Array, tails: str) -> tuple[pa.Array, np.ndarray]:
    """Keys without the mark of punctuation that ends them after a letter, and the code of that mark (0 for none)."""
    codes = np.zeros(len(keys), np.int32)
    if not tails or not len(keys):
        return keys, codes
    cut = pc.match_substring_regex(keys, rf"\p{{L}}[{re.escape(tails)}]$")
    for c in tails:
        codes[np.asarray(pc.and_(cut, pc.ends_with(keys, c)))] = -ord(c) - 1
    return pc.if_else(cut, pc.utf8_slice_codeunits(keys, 0, -1), keys), codes


def word_of(key: str) -> str:
    return key if key[:1] == "\n" else key[1:] if key[:1] == LITERAL else MARK + key


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """(key, word, edges): the pieces of two characters and more that occur in each word.

    For merge models an edge is a long that sorts by score, start and size: rank << 38 | start << 26 | size << 20 | flags | id.
    For unigram models it is (start, size, score, id), and has single characters too, with a null id where there is no
    piece. ``words`` has distinct keys, and words of up to ``LONGEST`` characters. It comes dealt by key, and the joins
    to the piece table are broadcasts, so the grouping needs no further exchange.
    """
    low = 2 if model.algorithm == BPE else 1
    table = F.broadcast(model.table(words.sparkSession))
    starts = words.withColumn("size", F.char_length("word")).select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - low, F.lit(0)))).alias("at"))
    # From ``HEAD`` characters on, a substring has the length of a piece that starts as it does.
    starts = starts.withColumn("prefix", F.substring("word", F.col("at") + 1, HEAD)).join(F.broadcast(model.prefixes(words.sparkSession)), "prefix", "left")
    short = F.array(*[F.lit(n) for n in range(low, HEAD)])
    lengths = F.when(F.col("lengths").isNull(), short).otherwise(F.concat(short, "lengths"))
    fitting = F.col("size") - F.col("at")
    parts = starts.select("key", "word", "at", fitting.alias("most"), F.explode(lengths).alias("n")).where((F.col("n") <= F.col("most")) | (F.col("n") == low))
    parts = parts.withColumn("piece", F.substring("word", F.col("at") + 1, F.col("n")))
    if model.algorithm == BPE:
        # The first substring stays without a piece, so that every word has a row; its null is no edge.
        place = _shift(F.col("at").cast("long"), 26).bitwiseOR(_shift(F.col("n").cast("long"), 20))
        found = parts.join(table, "piece", "left").where("id is not null or (at = 0 and n = 2)")
        edge = _shift(F.col("rank"), 38).bitwiseOR(place).bitwiseOR(F.col("id").cast("long"))
    else:
        found = parts.join(table, "piece", "left").where("id is not null or n = 1")
        edge = F.struct("at", "n", "score", "id")
    return found.select("key", "word", edge.alias("edge")).groupBy("key").agg(F.first("word").alias("word"), F.collect_list("edge").alias("edges"))


def _shift(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", x, F.lit(by) if isinstance(by, int) else by)


def _unpack(e: Column) -> tuple[Column, Column, Column]:
    """(start, size, id) of an edge of a merge model."""

    def bits(by: int, mask: int) -> Column:
        return F.shiftright(e, by).bitwiseAND(F.lit(mask).cast("long")).cast("int")

    return bits(26, (1 << 12) - 1), bits(20, 63), bits(0, (1 << ID_BITS) - 1)


def _span(at: Column, n: Column) -> Column:
    """The bits of the boundaries strictly inside [at, at + n)."""
    return _shift(_shift(F.lit(1).cast("long"), n - 1) - 1, at + 1)


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _merge_all(edges: Column, size: Column, zero: Column, fits: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """``finish`` of the state after the merges of a merge model: ``fits`` says whether an edge spans two segments, ``join`` makes them one."""

    def step(state: Column, e: Column) -> Column:
        def best_of(now: Column) -> Column:
            return F.array_min(F.filter(edges, lambda x: (x < e) & (x.bitwiseAND(F.lit(LATE).cast("long")) != 0) & fits(now, x)))

        def settled(now: Column) -> Column:
            again = F.aggregate(F.sequence(F.lit(1), size), now, lambda s, _: _let(best_of(s), lambda b: F.when(b.isNull(), s).otherwise(join(s, b))))
            return F.when(best_of(now).isNull(), now).otherwise(again)

        joined = F.when(e.bitwiseAND(F.lit(TRIGGER).cast("long")) != 0, _let(join(state, e), settled)).otherwise(join(state, e))
        return F.when(fits(state, e), joined).otherwise(state)

    return F.aggregate(F.sort_array(edges), zero, step, finish)


def merge_fold(edges: Column, size: Column, finish: Callable[[Column], Column]) -> Column:
    """``finish`` of the segmentation of a merge model: a long with a bit for every boundary between characters."""

    def fits(state: Column, e: Column) -> Column:
        at, n, _ = _unpack(e)
        one = F.lit(1).cast("long")
        ends = _shift(one, at).bitwiseOR(_shift(one, at + n))
        return (state.bitwiseAND(ends) == ends) & (F.bit_count(state.bitwiseAND(_span(at, n))) == 1)

    def join(state: Column, e: Column) -> Column:
        return state.bitwiseAND(F.bitwise_not(_span(*_unpack(e)[:2])))

    return _merge_all(edges, size, F.lit((1 << 62) - 1).cast("long"), fits, join, finish)


def long_merge_fold(edges: Column, size: Column, finish: Callable[[Column], Column]) -> Column:
    """As ``merge_fold`` for words of any size: the state is a string with a 1 for every boundary between characters, else 0."""

    def fits(state: Column, e: Column) -> Column:
        at, n, _ = _unpack(e)
        ends = F.concat(F.substr(state, at + 1, F.lit(1)), F.substr(state, at + n + 1, F.lit(1)))
        return (ends == "11") & (F.char_length(F.replace(F.substr(state, at + 2, n - 1), F.lit("0"), F.lit(""))) == 1)

    def join(state: Column, e: Column) -> Column:
        at, n, _ = _unpack(e)
        return F.overlay(state, F.repeat(F.lit("0"), n - 1), at + 2)

    return _merge_all(edges, size, F.repeat(F.lit("1"), size + 1), fits, join, finish)


def viterbi_fold(edges: Column, size: Column, low: float, finish: Callable[[Column], Column]) -> Column:
    """``finish`` of the segmentation of a unigram model, as a string of boundaries: the path of the largest sum of scores, the longer last piece on a tie."""
    # best: for every position so far the sum and the boundaries up to it.
    kind = "array<struct<total:double,cut:string>>"
    zero = F.array(F.struct(F.lit(0.0).alias("total"), F.lit("1").alias("cut"))).cast(kind)

    def step(best: Column, end: Column) -> Column:
        def path(e: Column) -> Column:
            before = F.element_at(best, e["at"] + 1)
            total = before["total"] + F.coalesce(e["score"], F.lit(low))
            return F.struct(total.alias("total"), e["n"].alias("n"), F.concat(before["cut"], F.repeat(F.lit("0"), e["n"] - 1), F.lit("1")).alias("cut"))

        found = F.array_max(F.transform(F.filter(edges, lambda e: e["at"] + e["n"] == end), path))
        return F.concat(best, F.array(F.struct(found["total"].alias("total"), found["cut"].alias("cut"))).cast(kind))

    return F.aggregate(F.sequence(F.lit(1), size), zero, step, lambda best: finish(F.element_at(best, -1)["cut"]))


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """(key, codes) of distinct keys, for words of up to ``LONGEST`` characters.

    A code is a piece's id, or for a character that stands alone the negative of its code point less one
    (see ``PieceModel.resolve``).
    """
    found = lattice(words, model)
    edges, size = F.col("edges"), F.char_length("word")

    # The segmentation is a variable of the fold's last step. As a column of its own, the optimizer could put the fold
    # in its place, once for every edge.
    def codes(used: Callable[[Column, Column], Column], alone: Callable[[Column], Column]) -> Column:
        """The codes in order: of the edges that are used, and of the characters that stand alone."""
        if model.algorithm == BPE:
            long = F.transform(F.filter(edges, lambda e: used(*_unpack(e)[:2])), lambda e: _pair(*_unpack(e)[::2]))
        else:
            long = F.transform(F.filter(edges, lambda e: (e["n"] > 1) & used(e["at"], e["n"])), lambda e: _pair(e["at"], e["id"]))
        single = F.transform(F.filter(F.sequence(F.lit(0), size - 1), alone), lambda i: _pair(i, -F.ascii(F.substring("word", i + 1, F.lit(1))) - 1))
        return F.transform(F.sort_array(F.concat(long, single)), lambda x: (x.bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int"))

    def of_bits(cut: Column) -> Column:
        one, two = F.lit(1).cast("long"), F.lit(3).cast("long")

        def used(at: Column, n: Column) -> Column:
            ends = _shift(one, at).bitwiseOR(_shift(one, at + n))
            return cut.bitwiseAND(_span(at, n).bitwiseOR(ends)) == ends

        return codes(used, lambda i: cut.bitwiseAND(_shift(two, i)) == _shift(two, i))

    def of_text(cut: Column) -> Column:
        return codes(lambda at, n: F.substr(cut, at + 1, n + 1) == F.concat(F.lit("1"), F.repeat(F.lit("0"), n - 1), F.lit("1")), lambda i: F.substr(cut, i + 1, F.lit(2)) == "11")

    if model.algorithm == BPE:
        out = F.when(size <= SHORT, merge_fold(edges, size, of_bits)).otherwise(long_merge_fold(edges, size, of_text))
    else:
        out = viterbi_fold(edges, size, min(model.scores) - 10.0, of_text)
    return found.select("key", out.alias("codes"))


def _pair(at: Column, code: Column) -> Column:
    """A long that sorts by the place and holds the code."""
    return _shift(at.cast("long"), 32).bitwiseOR(code.cast("long") + (1 << 31))


def file_words(docs: DataFrame, model: PieceModel) -> DataFrame:
    """(key, file) of the keys of words up to ``LONGEST`` characters of each split, distinct within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        pattern, tails = model.word_pattern(), model.tails()
        held: dict[int, list[pa.Array]] = {}

        def rows(file: int) -> pa.RecordBatch:
            keys, _ = stems(pc.unique(pa.chunked_array(held.pop(file))), tails)
            keys = keys.unique()
            keys = keys.filter(pc.less(pc.utf8_length(keys), LONGEST))
            keys = keys.take(pc.sort_indices(keys))  # sorted keys take less room in the exchange
            return pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(keys), file, np.int32))], ["key", "file"])

        for batch in slices(batches, "text"):
            files = batch.column("file").to_pylist()
            for a, b in _runs(files):
                parts = held.setdefault(files[a], [])
                parts.append(keys_of(batch.column("text").slice(a, b - a), pattern)[0].unique())
                if sum(map(len, parts[1:])) > HELD_WORDS // 2:
                    parts[:] = [pc.unique(pa.chunked_array(parts))]
                    if len(parts[0]) > HELD_WORDS:
                        yield rows(files[a])
        for file in list(held):
            yield rows(file)
        release()

    return docs.select("file", "text").mapInArrow(run, "key string, file int")


def file_dictionary(docs: DataFrame, model: PieceModel) -> str:
    """Write the words of each split and their codes into a folder of its own, in packed blocks; returns where."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(HELD_GROUPS))
    # One exchange by key serves the distinct words, their lattices and the join back to the files: as both sides of the
    # join read the same columns of it (hence ``some``), Spark runs it once.
    pairs = file_words(docs, model).repartition("key")
    first = F.substring("key", 1, 1)
    word = F.when(first == "\n", F.col("key")).when(first == LITERAL, F.substring("key", 2, LONGEST + 1)).otherwise(F.concat(F.lit(MARK), "key"))
    words = pairs.groupBy("key").agg(F.max("file").alias("some")).where("some is not null").withColumn("word", word)
    rows = pairs.join(encode_words(words, model).hint("merge"), "key").select("key", "codes", "file")
    where = fresh_path(spark, "pieces")
    rows.mapInArrow(_pack, "file int, words binary").hint("rebalance", "file").write.partitionBy("file").parquet(where)
    return where


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, codes, file) as compressed blocks of a file's keys and codes, which take a fraction of the rows' space."""
    pa.set_memory_pool(pa.system_memory_pool())
    held: dict[int, list[pa.RecordBatch]] = {}
    count = 0

    def flush() -> pa.RecordBatch:
        blocks = [_block(pa.Table.from_batches(parts).sort_by("key")) for parts in held.values()]
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(blocks, pa.binary())], ["file", "words"])
        held.clear()
        return out

    for batch in batches:
        files = np.asarray(batch.column("file"))
        order = np.argsort(files, kind="stable")
        dealt, files = batch.select(["key", "codes"]).take(pa.array(order)), files[order].tolist()
        for a, b in _runs(files):
            held.setdefault(files[a], []).append(dealt.slice(a, b - a))
        count += batch.num_rows
        if count >= PACKED:
            yield flush()
            count = 0
    if held:
        yield flush()
    release()


def _block(rows: pa.Table) -> bytes:
    """Byte lengths of keys, counts of codes, keys, codes. Both numbers fit 16 bits, since words have ``LONGEST`` characters at most."""
    data, at = utf8(_whole(rows["key"]))
    codes = _whole(rows["codes"])
    counts = np.asarray(pc.list_value_length(codes)).astype("<u2")
    body = np.diff(at).astype("<u2").tobytes() + counts.tobytes() + data.tobytes() + np.asarray(codes.flatten()).astype("<i4").tobytes()
    return struct.pack("<II", len(counts), len(data)) + zstandard.compress(body, 6)


def _unblock(blocks: list[bytes]) -> tuple[pa.Array, pa.Array]:
    sizes, counts, keys, codes = [], [], [], []
    for block in blocks:
        n, size = struct.unpack_from("<II", block)
        body = np.frombuffer(zstandard.decompress(block[8:]), np.uint8)
        sizes.append(body[: 2 * n].view("<u2"))
        counts.append(body[2 * n : 4 * n].view("<u2"))
        keys.append(body[4 * n : 4 * n + size])
        codes.append(body[4 * n + size :].view("<i4") if size % 4 == 0 else np.frombuffer(body[4 * n + size :].tobytes(), "<i4"))
    at, edge = (np.concatenate([[0], np.cumsum(np.concatenate(x), dtype=np.int32)]).astype(np.int32) for x in (sizes, counts))
    words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.concatenate(keys)))
    return words, pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(codes)))


def encode(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids``: the piece ids of the whole text, as the model's own rule gives them.

    With ``decoded`` the text goes: a column of that name has what ``decode`` gives for the ids, in the same worker, so
    that no second one stands beside it and texts are not sent back.

    Null and empty texts have no ids; repeated rows get the same ids each. Words of more than ``LONGEST`` characters are
    encoded in the worker, as are words that a split lacks because the second pass is split otherwise. Extra columns pass
    through; one named like the ids is replaced. ``docs`` that are more than a scan of files are written first.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != ids]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    if not _is_scan(rows):
        rows = materialize(rows, "piece-texts")
    where = F.hash(F.input_file_name(), F.input_file_block_start())
    rows = rows.withColumn("__file", where)
    folder = file_dictionary(rows.select(F.col("__file").alias("file"), F.col(f"`{text}`").cast("string").alias("text")), model)
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    passed = keep if decoded is None else [c for c in keep if c not in (text, decoded)]
    back = [] if decoded is None else [F.lit("").cast("string").alias(decoded)]
    schema = docs.select(*[F.col(f"`{c}`") for c in passed], F.array().cast("array<int>").alias(ids), *back).schema
    decoder = None if decoded is None else _Decoder(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        store, path = fs.FileSystem.from_uri(uri)
        pattern, tails = model.word_pattern(), model.tails()
        file, dictionary = None, None
        for batch in slices(batches, text):
            files = batch.column("__file").to_pylist()
            for a, b in _runs(files):
                if files[a] != file:
                    file, dictionary = files[a], None
                    if store.get_file_info(f"{path}/file={file}").type == fs.FileType.Directory:
                        table = pq.read_table(f"{path}/file={file}", filesystem=store, columns=["words"], partitioning=None, use_threads=False)
                        dictionary = _Dictionary(*_unblock(table["words"].to_pylist()))
                    else:
                        dictionary = _Dictionary(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())))
                part = batch.slice(a, b - a)
                keys, counts = keys_of(part.column(text).cast(pa.string()), pattern)
                coded = keys.dictionary_encode()
                lists = dictionary.find(coded.dictionary, model, tails)
                values, size = model.resolve(np.asarray(lists.flatten()).astype(np.int64), np.diff(np.asarray(lists.offsets)))
                at = np.concatenate([[0], np.cumsum(size)])
                lists = _gather(values, at, np.asarray(coded.indices), counts)
                back = [] if decoder is None else [pa.array([t for k in range(0, len(lists), DECODED) for t in decoder.texts(lists.slice(k, DECODED))], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), lists, *back], schema.names)
        release()

    return rows.mapInArrow(run, schema)


def _is_scan(rows: DataFrame) -> bool:
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan") == 1 and "Exchange" not in plan


class _Dictionary:
    """The words of a split, found by 64-bit hashes and then compared."""

    def __init__(self, words: pa.Array, codes: pa.ListArray):
        h = self._hashes(words)
        order = np.argsort(h).astype(np.int32)
        self.hashes, self.order, self.words, self.codes = h[order], order, words, codes

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        parts = [np.zeros(0, np.uint64)]
        for start in range(0, len(words), HASHED):
            data, at = utf8(words.slice(start, HASHED))
            parts.append(Prefixes(_VALUES[data], _BASE).of(at[:-1], at[1:]))
        return np.concatenate(parts)

    def find(self, keys: pa.Array, model: PieceModel, tails: str) -> pa.ListArray:
        """The codes of each key; words that are not here are encoded."""
        stem, last = stems(keys, tails)
        if len(self.words):
            spot = pa.array(self.order[np.minimum(np.searchsorted(self.hashes, self._hashes(stem)), len(self.hashes) - 1)])
            lists, missing = self.codes.take(spot), np.flatnonzero(~np.asarray(pc.equal(self.words.take(spot), stem)))
        else:
            lists, missing = pa.array([[]] * len(keys), pa.list_(pa.int32())), np.arange(len(keys))
        if len(missing):
            values = lists.to_pylist()
            for i in missing.tolist():
                values[i] = model.encode_word(word_of(stem[i].as_py()))
            lists = pa.array(values, pa.list_(pa.int32()))
        # The mark that was cut off follows its word's codes.
        size = np.asarray(pc.list_value_length(lists)) + (last != 0)
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        values, ends = np.empty(int(at[-1]), np.int32), np.zeros(int(at[-1]), bool)
        ends[at[1:][last != 0] - 1] = True
        values[ends], values[~ends] = last[last != 0], np.asarray(lists.flatten())
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    one = column.combine_chunks()
    return one.chunk(0) if isinstance(one, pa.ChunkedArray) else one


def _runs(values: list) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield start, i
            start = i


def _gather(values: np.ndarray, at: np.ndarray, index: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """The concatenated lists at ``index`` (list i is values[at[i]:at[i + 1]]), in groups of ``counts``."""
    size = np.diff(at)[index]
    stop = np.cumsum(size)
    pick = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(at[:-1][index] - (stop - size), size)
    edge = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values[pick].astype(np.int32)))


class _Decoder:
    """The bytes of all pieces, and the texts of lists of ids."""

    def __init__(self, model: PieceModel):
        raw = [bytes([i - model.first_byte]) if k == 6 else p.replace(MARK, " ").encode() if k == 1 else b"" for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True))]
        self.blob, self.size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def texts(self, part: pa.ListArray) -> list[str | None]:
        codes = np.asarray(part.flatten())
        n = self.size[codes]
        stop = np.concatenate([[0], np.cumsum(n)])
        data = self.blob[np.arange(int(stop[-1])) + np.repeat(self.begin[codes] - stop[:-1], n)].tobytes()
        count = np.asarray(pc.fill_null(pc.list_value_length(part), 0))
        edge = stop[np.concatenate([[0], np.cumsum(count)])].tolist()
        whole = [data[a:b].decode(errors="replace") for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return [None if null else t[1:] if t[:1] == " " else t for t, null in zip(whole, np.asarray(part.is_null()).tolist(), strict=True)]


def decode(df: DataFrame, model: PieceModel, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the text of the piece ids: a space for every mark, without the first one. Null ids give null, no ids an empty text.

    Unknown and control pieces are left out. Bytes that are not UTF-8 become the replacement character. Decoding an
    encoded text gives it back, except that a mark in the text itself comes back as a space.
    """
    keep = [c for c in df.columns if c != text]
    schema = df.select(*[F.col(f"`{c}`") for c in keep], F.lit("").cast("string").alias(text)).schema
    decoder = _Decoder(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        for big in batches:
            for at in range(0, big.num_rows, DECODED):
                batch = big.slice(at, DECODED)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(decoder.texts(batch.column(ids)), pa.string())], [*keep, text])
        release()

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
