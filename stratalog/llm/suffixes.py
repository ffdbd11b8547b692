"""Removal of repeated byte strings with a distributed, common-prefix-aware merge sort of suffixes.

Every window of ``length`` bytes has an anchor: the place of the smallest hash of the short strings in it, so equal
windows have equal anchors. Only suffixes at anchors are looked at. An anchor's context is the bytes that its windows
can cover. Equal contexts are aggregated before the sort: one stands for all, and what occurs twice is repeated as a
whole. A context that occurs once can still share windows with other contexts of the same anchor string. Those are
sorted as suffixes: every task writes front-coded runs in suffix order (the length of the prefix shared with the last
suffix, then the rest), runs are dealt so that suffixes which share their first ``_core`` bytes meet, and a loser tree
merges them without comparing known prefixes again. The common prefixes of the merged order, and those of the bytes to
the left read backwards, give the windows that are shared. Where more than ``HOT`` contexts share an anchor string,
their windows are counted by hash instead, so that no task holds such a group.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from .common import Prefixes, grams, mix64, random_words, slices, utf8

LENGTH = 400
#: Bytes of an anchor string; it is the least that contexts which are compared share.
GRAM = 100
#: Suffixes of a front-coded run.
RUN = 4096
#: Groups up to this many contexts are compared pair by pair, larger ones by classes of common prefixes.
PAIRWISE = 12
#: Distinct contexts of one anchor string up to which they are merged; beyond, their windows are counted one by one.
HOT = 100_000
#: Tasks over which the distinct contexts of one anchor string, or the occurrences of one window, are dealt.
SALTS = 16
#: Low bits of an ordering key that hold the place in its slice.
_PLACE_BITS = 31

_KEYS = [int(x) for x in random_words(2, 21)]
_BASE = [int(random_words(1, 23)[0]), int(random_words(1, 24)[0])]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` places, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors of all windows of each row: row, place, the range of windows before it (low, high), hashes of anchor string and context."""
    none = np.zeros(0, np.int64)
    out = dict.fromkeys(("row", "at", "low", "high", "left", "right", "g", "c1", "c2"), none)
    size = np.diff(at)
    rows = np.flatnonzero(size >= length)
    if not len(rows):
        return out
    # A string's hash is that of its grams of up to 8 bytes, of which it has so many fewer than bytes.
    less = min(8, gram) - 1
    values = grams(data, less + 1, _KEYS[0])
    first = Prefixes(values, _BASE[0])
    key = first.all_of(gram - less)
    key &= np.uint64((1 << 64) - (1 << _PLACE_BITS))
    key |= np.arange(len(key), dtype=np.uint64)
    best = (sliding_min(key, length - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    del key
    # Windows that lie in a row.
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, at[rows], 1)
    np.add.at(inside, at[rows + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(best)], dtype=np.int8))
    place = best[starts]
    opens = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)))
    closes = np.append(opens[1:], len(starts)) - 1
    a, s1, s2 = place[opens], starts[opens], starts[closes]
    row = np.searchsorted(at, s1, side="right") - 1
    left, right = np.minimum(length - gram, a - at[row]), np.minimum(length, at[row + 1] - a)
    second = Prefixes(mix64(values ^ np.uint64(_KEYS[1])), _BASE[1])
    edges = (left * (length + 1) + right).astype(np.uint64)
    low, high = a - left, a + right
    return {
        "row": row, "at": a - at[row], "low": a - s2, "high": a - s1, "left": left, "right": right, "g": first.of(a, a + gram - less),
        "c1": mix64(first.of(low, high - less) + edges), "c2": mix64(second.of(low, high - less) ^ mix64(edges + np.uint64(5))),
    }


def front_code(sorted_suffixes: list[bytes]) -> bytes:
    """(shared, rest) of each suffix against the one before it."""
    out, last = [], b""
    for s in sorted_suffixes:
        shared = common_prefix(last, s)
        out += [struct.pack("<HH", shared, len(s) - shared), s[shared:]]
        last = s
    return b"".join(out)


def front_decode(run: bytes) -> Iterator[tuple[bytes, int]]:
    """Suffixes of a run, each with the length it shares with the one before."""
    at, last = 0, b""
    while at < len(run):
        shared, rest = struct.unpack_from("<HH", run, at)
        last = last[:shared] + run[at + 4 : at + 4 + rest]
        at += 4 + rest
        yield last, shared


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (suffix, length shared with the run's last one, payload).

    Every run's head carries the length it shares with the last suffix that was given out. Of two heads, the one that
    shares more is smaller; only if both share the same are bytes compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int, object]]]):
        self.runs = runs
        self.width = 1
        while self.width < len(runs):
            self.width *= 2
        self.heads: list[tuple[bytes, object] | None] = [None] * self.width
        self.shared = [0] * self.width
        for i in range(len(runs)):
            self._advance(i)
        self.losers = [0] * self.width
        self.winner = self._build(1)

    def _advance(self, i: int) -> None:
        got = next(self.runs[i], None)
        self.heads[i], self.shared[i] = (None, -1) if got is None else ((got[0], got[2]), got[1])

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return (i, j) if b is None else (j, i)
        x, y = self.shared[i], self.shared[j]
        if x != y:
            return (i, j) if x > y else (j, i)
        k = x + common_prefix(a[0][x:], b[0][x:])
        if a[0][k : k + 1] <= b[0][k : k + 1]:
            self.shared[j] = k
            return i, j
        self.shared[i] = k
        return j, i

    def _build(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        win, lose = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        while self.heads[self.winner] is not None:
            i = self.winner
            suffix, payload = self.heads[i]
            yield suffix, self.shared[i], payload
            self._advance(i)
            node = (i + self.width) // 2
            while node:
                win, lose = self._play(i, self.losers[node])
                self.losers[node], i = lose, win
                node //= 2
            self.winner = i


def shared_windows(prefix: list[int], lefts: list[bytes], ranges: list[tuple[int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For contexts in suffix order, the ranges of d for which the window from d bytes before the anchor occurs in another context.

    ``prefix`` holds the length each suffix shares with the one before it, ``lefts`` the bytes before the anchor,
    ``ranges`` the d that are asked for.
    """
    m = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    back = [x[::-1] for x in lefts]
    if m <= PAIRWISE:
        for i in range(m):
            right = length
            for j in range(i + 1, m):
                right = min(right, prefix[j])
                low, high = length - right, common_prefix(back[i], back[j])
                if low <= high:
                    for k in (i, j):
                        a, b = max(low, ranges[k][0]), min(high, ranges[k][1])
                        if a <= b:
                            out[k].append((a, b))
        return out
    order = sorted(range(m), key=back.__getitem__)
    shared_left = np.zeros(m, np.int64)
    shared_left[1:] = [common_prefix(back[a], back[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
    order, shared_right = np.array(order), np.array(prefix)
    low, high = (np.array(x) for x in zip(*ranges, strict=True))
    left_class = np.empty(m, np.int64)
    for d in range(int(low.min()), int(high.max()) + 1):
        right_class = np.cumsum(np.append(False, shared_right[1:] < length - d))
        left_class[order] = np.cumsum(np.append(False, shared_left[1:] < d))
        _, inverse, times = np.unique(right_class * m + left_class, return_inverse=True, return_counts=True)
        # Contexts shorter than the window are alone in their classes.
        for i in np.flatnonzero((times[inverse] > 1) & (low <= d) & (d <= high)).tolist():
            if out[i] and out[i][-1][1] == d - 1:
                out[i][-1] = (out[i][-1][0], d)
            else:
                out[i].append((d, d))
    return out


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All anchors: doc_id, h (hash of the text), place, windows, and hashes of anchor string and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = anchors(*utf8(batch.column("text")), length, gram)
            row = pa.array(x["row"])
            small = [pa.array(x[k].astype(np.int16)) for k in ("low", "high", "left", "right")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("h").take(row), pa.array(x["at"].astype(np.int32)), *small, *(pa.array(x[k].astype(np.uint64).view(np.int64)) for k in ("g", "c1", "c2"))],
                ["doc_id", "h", "at", "low", "high", "left", "right", "g", "c1", "c2"],
            )

    return docs.mapInArrow(run, "doc_id long, h long, at int, low short, high short, left short, right short, g long, c1 long, c2 long")


def _core(length: int, gram: int) -> int:
    """Bytes that suffixes of one group share: equal windows lie in one group, whichever kind of suffix finds them."""
    near = (length - gram) // 2
    return min(length - near, near + gram)


def _runs_of(found: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """(part, suffixes, payload): sorted front-coded runs of the suffixes in ``found`` (doc_id, h, once, text, spots).

    A context gives a suffix at its anchor (for windows that start at most ``near`` before it), and one that starts
    ``near`` before it (for the others). Runs are in order of kind and suffix. Equal windows have equal ``_core`` bytes
    there, by whose hash suffixes are dealt, so that a group is adjacent in one part's order.
    """
    near, core = (length - gram) // 2, _core(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count = 0

        def flush(part: int) -> pa.RecordBatch:
            rows = sorted(held.pop(part), key=lambda r: r[0])
            payload = [struct.pack("<?qqiHHH", *r[1:7], len(r[7])) + r[7] for r in rows]
            cut = range(0, len(rows), RUN)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(cut), pa.int32()), pa.array([front_code([r[0] for r in rows[a : a + RUN]]) for a in cut], pa.binary()), pa.array([b"".join(payload[a : a + RUN]) for a in cut], pa.binary())],
                ["part", "suffixes", "payload"],
            )

        for batch in slices(batches, "text"):
            for doc_id, h, text, spots in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text", "spots")), strict=True):
                data = text.encode()
                for s in spots:
                    if s["hot"]:
                        continue
                    a, low, high = s["at"], s["low"], s["high"]
                    begin, end = a - s["left"], a + s["right"]
                    sides = []
                    if low <= near and end - a >= length - near:
                        sides.append((b"R", a, data[a:end], data[max(begin, a - near) : a], low, min(high, near)))
                    if high > near and a - begin > near:
                        p = a - near
                        sides.append((b"L", p, data[p : min(end, p + length - 1)], data[begin:p], max(low, near + 1) - near, high - near))
                    for kind, p, suffix, before, d1, d2 in sides:
                        part = int.from_bytes(hashlib.blake2b(suffix[:core], digest_size=8).digest(), "big") % parts
                        held.setdefault(part, []).append((kind + suffix, s["once"], doc_id, h, p, d1, d2, before))
                        count += 1
            if count > 40_000:
                for part in list(held):
                    yield flush(part)
                count = 0
        for part in list(held):
            yield flush(part)

    return found.mapInArrow(run, "part int, suffixes binary, payload binary")


def _payloads(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        *fields, size = struct.unpack_from("<?qqiHHH", data, at)
        at += _PAYLOAD + size
        yield (*fields, data[at - size : at])


_PAYLOAD = struct.calcsize("<?qqiHHH")


def _merge(runs: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(doc_id, h, start, end): what the contexts that occur once share with others, by merging the runs of each part.

    A task holds the runs of one part, and one group of at most ``HOT`` suffixes; the parts' number follows the runs'
    total size.
    """
    least = 1 + _core(length, gram)

    def solve(found: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        tree = LoserTree([((s, shared, p) for (s, shared), p in zip(front_decode(a), _payloads(b), strict=True)) for a, b in found])
        out: list[tuple[int, int, int, int]] = []
        prefix, group = [], []

        def close() -> None:
            if len(group) > 1 and any(x[0] for x in group):
                got = shared_windows(prefix, [x[6] for x in group], [(x[4], x[5]) for x in group], length)
                for (once, doc_id, h, a, *_), ranges in zip(group, got, strict=True):
                    if once:
                        out.extend((doc_id, h, a - d2, a - d1 + length) for d1, d2 in ranges)

        for _, shared, payload in tree:
            if shared < least:
                close()
                prefix, group = [], []
            prefix.append(shared - 1)
            group.append(payload)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "h", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = None, []
        for batch in batches:
            for p, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    if found:
                        yield from solve(found)
                    part, found = p, []
                found.append((a, b))
        if found:
            yield from solve(found)

    return runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "doc_id long, h long, start int, end int")


def _windows(found: DataFrame, length: int) -> DataFrame:
    """(doc_id, h, start, end): windows of the hot contexts that occur once, where another hot context has them too.

    A window's 128-bit hash is counted over all contexts of its anchor string, so that no task holds them together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for doc_id, h, text, spots in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text", "spots")), strict=True):
                data = text.encode()
                for s in spots:
                    if s["hot"]:
                        starts = range(s["at"] - s["high"], s["at"] - s["low"] + 1)
                        k = len(starts)
                        marks = [hashlib.blake2b(data[a : a + length], digest_size=16).digest() for a in starts]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(marks, pa.binary()), pa.array([doc_id] * k, pa.int64()), pa.array([h] * k, pa.int64()), pa.array(starts, pa.int32()), pa.array([s["once"]] * k)], ["window", "doc_id", "h", "start", "once"]
                        )

    rows = materialize(found.mapInArrow(run, "window binary, doc_id long, h long, start int, once boolean"), "suffix-windows")
    shared = rows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.where("once").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    return salted.join(shared.hint("merge"), ["window", "salt"]).select("doc_id", "h", "start", (F.col("start") + length).alias("end"))


#: Bytes of contexts that a part holds.
PART_BYTES = 12 << 20


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, start, end) of bytes that repeated strings of ``length`` bytes cover; spans may overlap.

    ``keyed`` has doc_id, h (a hash of the text) and text; rows that agree in both are told apart only by their number.
    """
    scan = materialize(_scan(keyed, length, gram), "suffix-anchors")
    kinds = scan.groupBy("g", "c1", "c2").agg(F.count("*").alias("m"))
    # Anchor strings with several contexts of which one occurs once; partial aggregates come first, and the contexts of
    # one anchor string are dealt by a salt too, since a third of all contexts may have the same.
    groups = kinds.groupBy("g").agg(F.count("*").alias("k"), F.min("m").alias("least")).where("k > 1 and least = 1")
    groups = groups.select("g", "k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    kinds = kinds.withColumn("salt", F.pmod("c1", F.lit(SALTS)).cast("int")).join(groups.hint("merge"), ["g", "salt"], "left").where("m > 1 or k is not null")
    kinds = kinds.select("c1", "c2", (F.col("m") == 1).alias("once"), F.col("k").isNotNull().alias("open"), (F.coalesce("k", F.lit(0)) > HOT).alias("hot"))
    hits = materialize(scan.select("doc_id", "h", "at", "low", "high", "left", "right", "c1", "c2").join(kinds.hint("merge"), ["c1", "c2"]), "suffix-hits")
    whole = hits.where("not once").select("doc_id", "h", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))
    contexts = hits.where("open").dropDuplicates(["c1", "c2"])
    total, hot = hits.where("open").agg(F.sum(F.when(~F.col("hot"), F.col("left") + F.col("right") + 200)), F.max("hot")).first()
    parts = max(1, -(-int(total or 0) * 2 // PART_BYTES))
    spots = contexts.groupBy("doc_id", "h").agg(F.collect_list(F.struct("at", "low", "high", "left", "right", "once", "hot")).alias("spots"))
    found = keyed.join(spots.hint("merge"), ["doc_id", "h"]).select("doc_id", "h", "text", "spots")
    spans = whole.union(_merge(_runs_of(found, length, gram, parts), parts, length, gram))
    return spans.union(_windows(found, length)) if hot else spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes of each text without those that a repeated string covers.

    A string of ``length`` bytes is repeated if it starts anywhere else, in the same text or another; strings never
    cross texts, may overlap, and are judged on the input. ``kept`` is binary, since cuts may fall inside a character;
    n_spans counts the runs that were removed. Null texts are empty; texts shorter than ``length`` stay as they are.
    Every row gives one row, repeated rows too (which then repeat each other). Null ids are allowed. Other columns are
    ignored. Texts of any length: a task holds one whole text and slices of short ones.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select(F.coalesce("id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("h"), "id", "text")
    spans = repeated_spans(keyed.select("doc_id", "h", "text"), length, gram)
    cuts = spans.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = keyed.join(cuts.hint("merge"), ["doc_id", "h"], "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, removed, counts, kept = [], [], [], []
            for body, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = body.encode()
                parts, done, cut, n = [], 0, 0, 0
                for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                    if start > done or not n:
                        parts.append(data[done:start])
                        n += 1
                        cut += end - start
                        done = end
                    elif end > done:
                        cut += end - done
                        done = end
                parts.append(data[done:])
                sizes.append(len(data))
                removed.append(cut)
                counts.append(n)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
