"""Secret scans: fixed patterns, and automata inferred from labelled credentials.

The credentials that the fixed patterns find are the labelled examples. Their prefix tree is folded into a probabilistic
automaton by merging states whose outgoing frequencies are statistically compatible; every other token from
``CANDIDATE`` characters on, with or without digits, is then scored by how much likelier the automata make it than the
automata of ordinary tokens. These are two, since ordinary tokens with digits are rare among words.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from .common import slices, utf8

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
DIGIT = re.compile(rb"[0-9]")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Tokens from this length on are candidates of the automata, as are the shortest values of assignments.
CANDIDATE = 12
#: Examples of each label that an automaton is inferred from: those with the smallest hashes, a sample over all rows.
EXAMPLES = 400
#: Confidence of the compatibility test, and the symbol count from which the start of a token is abstracted.
ALPHA = 0.05
LITERAL = 4
#: Nats a symbol by which a credential automaton must beat the automata of ordinary tokens.
MARGIN = 0.7
#: Labels of ordinary tokens: without and with digits.
ORDINARY = ("other", "other_digits")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True


def runs(member: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True with ``least`` or more places; runs never cross the offsets ``at``."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = member.copy()
    begin[1:] &= ~member[:-1]
    firsts = at[:-1][at[:-1] < len(member)]
    begin[firsts] = member[firsts]
    start = np.flatnonzero(begin)
    stop = member.copy()
    stop[:-1] &= ~member[1:]
    lasts = at[1:] - 1
    lasts = lasts[lasts >= 0]
    stop[lasts] = member[lasts]
    end = np.flatnonzero(stop) + 1
    keep = end - start >= least
    return start[keep], end[keep]


def assignments(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, start of the value) of assignments whose value is long enough."""
    low = text.lower()
    if not any(w in low for w in WORDS):
        return []
    return [(m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]


def accesses(text: bytes) -> list[tuple[int, int]]:
    if b"AKIA" not in text:
        return []
    return [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]


def scan_bytes(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes, list[tuple[str, int, int, int]], list[tuple[int, int]]]]:
    """Per row: its number, bytes, base matches (kind, start, end, start of the credential) and candidates, in bytes."""
    hex_start, hex_end = runs(_HEX[data], at, LEAST["hex"])
    start, end = runs(_TOKEN[data], at, CANDIDATE)
    hex_at, at_run = np.searchsorted(hex_start, at), np.searchsorted(start, at)
    raw = data.tobytes()
    for i in range(len(at) - 1):
        base, text = int(at[i]), raw[at[i] : at[i + 1]]
        found = [("assign", *m) for m in assignments(text)]
        found += [("access", a, b, a) for a, b in accesses(text)]
        found += [("hex", int(a) - base, int(b) - base, int(a) - base) for a, b in zip(hex_start[hex_at[i] : hex_at[i + 1]], hex_end[hex_at[i] : hex_at[i + 1]], strict=True)]
        yield i, text, found, [(int(a) - base, int(b) - base) for a, b in zip(start[at_run[i] : at_run[i + 1]], end[at_run[i] : at_run[i + 1]], strict=True)]


def united(found: list[tuple[str, int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that base matches cover, in order; matches that meet are one."""
    start, end = [], []
    for _, a, b, _ in sorted(found, key=lambda x: x[1]):
        if end and a <= end[-1]:
            end[-1] = max(end[-1], b)
        else:
            start.append(a)
            end.append(b)
    return start, end


def uncovered(candidates: list[tuple[int, int]], found: list[tuple[str, int, int, int]]) -> list[tuple[int, int]]:
    """Candidates that overlap no base match; an assignment's candidate may start at its key word."""
    if not found:
        return candidates
    start, end = united(found)
    after = [bisect.bisect_right(end, a) for a, _ in candidates]
    return [(a, b) for (a, b), k in zip(candidates, after, strict=True) if k == len(end) or start[k] >= b]


def unsettled(candidates: list[tuple[int, int]], found: list[tuple[str, int, int, int]]) -> list[tuple[int, int]]:
    """Candidates that base matches do not cover wholly."""
    if not found:
        return candidates
    start, end = united(found)
    after = [bisect.bisect_right(end, a) for a, _ in candidates]
    return [(a, b) for (a, b), k in zip(candidates, after, strict=True) if k == len(end) or start[k] > a or end[k] < b]


def ordinary(token: bytes) -> str:
    """The label of a token that no base match overlaps."""
    return ORDINARY[DIGIT.search(token) is not None]


def symbols(token: bytes) -> list[str]:
    """The first places as they are, then classes: digit, a-f, other lower case, upper case, and other characters as they are."""
    out = []
    for i, c in enumerate(token.decode("latin-1")):
        if i < LITERAL and not c.isdigit():
            out.append(c)
        elif c.isdigit():
            out.append("0")
        elif "a" <= c <= "f":
            out.append("h")
        elif c.islower():
            out.append("l")
        elif c.isupper():
            out.append("U")
        else:
            out.append(c)
    return out


class Automaton:
    """A probabilistic automaton inferred by merging compatible states of the prefix tree (breadth first, red and blue states)."""

    #: Smoothing: symbols that a state may still emit, with so much weight.
    ALPHABET, WEIGHT = 70, 0.5

    def __init__(self, samples: list[list[str]], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.end, self.total = [0], [0]
        self.gap = math.sqrt(0.5 * math.log(2 / alpha))
        for s in samples:
            state = 0
            for c in s:
                self.total[state] += 1
                self.count[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                    self.end.append(0)
                    self.total.append(0)
                state = self.next[state][c]
            self.total[state] += 1
            self.end[state] += 1
        self._infer()

    def _differs(self, x: int, n: int, y: int, m: int) -> bool:
        return bool(n and m) and abs(x / n - y / m) > self.gap * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if self._differs(self.end[a], n, self.end[b], m):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differs(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.end[a] += self.end[b]
            for c, n in self.count[b].items():
                self.count[a][c] += n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _infer(self) -> None:
        red = [0]
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            state = self.next[parent][c]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            known = set(red)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in known]
        self._freeze(red)

    def _freeze(self, red: list[int]) -> None:
        number = {s: i for i, s in enumerate(red)}
        self.step: list[dict[str, tuple[float, int]]] = []
        self.other, self.stop = [], []
        for s in red:
            whole = self.total[s] + self.WEIGHT * self.ALPHABET
            self.step.append({c: (math.log((n + self.WEIGHT) / whole), number[self.next[s][c]]) for c, n in self.count[s].items()})
            self.other.append(math.log(self.WEIGHT / whole))
            self.stop.append(math.log((self.end[s] + self.WEIGHT) / whole))
        del self.next, self.count, self.end, self.total

    @property
    def states(self) -> int:
        return len(self.step)

    def log_likelihood(self, s: list[str]) -> float:
        """A symbol that a state has never seen costs the smoothed rest and leads back to the start."""
        state, total = 0, 0.0
        for c in s:
            p, to = self.step[state].get(c, (self.other[state], 0))
            total += p
            state = to
        return total + self.stop[state]


class Grammar:
    """Automata of credentials by label, and those of ordinary tokens."""

    def __init__(self, examples: dict[str, list[bytes]]):
        self.kinds = {k: Automaton([symbols(x) for x in sorted(v)]) for k, v in sorted(examples.items()) if k not in ORDINARY and v}
        self.others = [Automaton([symbols(x) for x in sorted(examples[k])]) for k in ORDINARY if examples.get(k)] or [Automaton([])]

    def score(self, token: bytes) -> float:
        """Nats a symbol by which the best credential automaton beats the best ordinary one; minus infinity without any."""
        s = symbols(token)
        return (max((a.log_likelihood(s) for a in self.kinds.values()), default=-math.inf) - max(a.log_likelihood(s) for a in self.others)) / (len(s) + 1)


def labelled_examples(docs: DataFrame, text: str = "text", most: int = EXAMPLES) -> DataFrame:
    """(label, token, rank): the ``most`` distinct tokens of each label with the smallest SHA-1, over all texts.

    Labels are the kinds of the fixed patterns, and ``ORDINARY`` ones for candidates that none of them matches. Each task
    keeps its smallest ones; Spark keeps the smallest of those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[bytes, bytes]] = defaultdict(dict)
        for batch in slices(batches, "text"):
            for _, body, found, candidates in scan_bytes(*utf8(batch.column("text"))):
                tokens = [(k, body[c:b]) for k, _, b, c in found] + [(ordinary(body[a:b]), body[a:b]) for a, b in uncovered(candidates, found)]
                for label, token in tokens:
                    kept[label][hashlib.sha1(token).digest()] = token
            for label, x in kept.items():
                if len(x) > 4 * most:
                    kept[label] = {h: x[h] for h in heapq.nsmallest(most, x)}
        rows = [(label, h.hex(), x[h]) for label, x in kept.items() for h in heapq.nsmallest(most, x)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["label", "rank", "token"])

    found = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "label string, rank string, token binary")
    return materialize(found.dropDuplicates(["label", "rank"]), "secret-examples")


def infer_grammar(docs: DataFrame, text: str = "text", most: int = EXAMPLES) -> Grammar:
    """Infer the automata from at most ``most`` examples a label (five labels), which is all that reaches the driver."""
    sample = labelled_examples(docs, text, most)
    examples = {label: [bytes(r.token) for r in sample.where(F.col("label") == label).orderBy("rank").limit(most).collect()] for label in ("assign", "access", "hex", *ORDINARY)}
    return Grammar(examples)


def find_secrets(docs: DataFrame, grammar: Grammar, text: str = "text", margin: float = MARGIN, secrets: str = "secrets") -> DataFrame:
    """Add ``secrets``: array of (kind, start, end) in code points, ordered by start and kind.

    Null and empty texts have none. Fixed patterns match leftmost and without overlaps within a kind; ``grammar`` spans
    are whole tokens that those do not cover wholly and whose score reaches ``margin``; they may overlap those. Work grows
    with a text's length, and repeated rows give repeated results. Extra columns pass through; one named like the secrets is
    replaced.
    """
    keep = [c for c in docs.columns if c != secrets]
    spans = "array<struct<kind:string,start:int,end:int>>"
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast(spans).alias(secrets)).schema
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, order = held.value, {k: i for i, k in enumerate(KINDS)}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, text):
            out = []
            for _, body, found, candidates in scan_bytes(*utf8(batch.column(text).cast(pa.string()))):
                all_found = [x[:3] for x in found] + [("grammar", a, b) for a, b in unsettled(candidates, found) if model.score(body[a:b]) >= margin]
                if all_found and not body.isascii():
                    # A byte's place is the code points that begin before it.
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)])
                    all_found = [(k, int(points[a]), int(points[b])) for k, a, b in all_found]
                out.append(sorted(({"kind": k, "start": a, "end": b} for k, a, b in all_found), key=lambda s: (s["start"], order[s["kind"]])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, kind)], [*keep, secrets])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", secrets: str = "secrets") -> DataFrame:
    """Replace the spans of ``secrets`` in ``text`` by ``mark``, overlapping spans as one, and drop ``secrets``. Documents stay."""
    keep = [c for c in docs.columns if c != secrets]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = []
            for body, spans in zip(batch.column(text).to_pylist(), batch.column(secrets).to_pylist(), strict=True):
                if body and spans:
                    parts, done = [], 0
                    for s in spans:
                        if s["end"] > done:
                            if s["start"] >= done:
                                parts += [body[done : s["start"]], mark]
                            done = s["end"]
                    body = "".join([*parts, body[done:]])
                out.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else batch.column(c) for c in keep], keep)

    return docs.mapInArrow(run, schema)
