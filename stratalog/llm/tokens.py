"""Token counts of fields and sections: each document is encoded once and its tokens' spans are joined to intervals."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of this public byte-level vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most")
_loaded: dict[str, tuple] = {}


def encoder(path: str = VOCABULARY):
    """The encoder of a vocabulary of ranks, and the byte length of each token; loaded once in a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[path]


def allocate(token_end: np.ndarray, cut: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The interval of each token and whether it crosses a boundary; tokens and intervals tile the same bytes.

    ``first`` gives a token to the interval of its first byte, ``last`` to that of its last byte, ``most`` to the one
    with most of its bytes, the earlier one on a tie. ``cut`` holds the starts of the non-empty intervals.
    """
    start = np.concatenate([[0], token_end[:-1]])
    a, b = np.searchsorted(cut, start, side="right") - 1, np.searchsorted(cut, token_end - 1, side="right") - 1
    crossing = a != b
    if rule == "first":
        return a, crossing
    if rule == "last":
        return b, crossing
    best = a.copy()
    edge = np.append(cut, token_end[-1] if len(token_end) else 0)
    for i in np.flatnonzero(crossing):
        held = [min(edge[k + 1], token_end[i]) - max(edge[k], start[i]) for k in range(a[i], b[i] + 1)]
        best[i] = a[i] + int(np.argmax(held))
    return best, crossing


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", fields: Sequence[str] = ("text",), by_line: bool = True, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, field, section, start, end, n_tokens, n_crossing) that share out each document's tokens.

    The fields, joined by line feeds, are encoded as one text. Every field is a section, or with ``by_line`` every line
    of it; a line feed belongs to the line that it ends. ``start`` and ``end`` are code points of the joined text; each
    token counts once, in the section that ``rule`` gives it to (see ``allocate``); ``n_crossing`` counts tokens of the
    section that reach over a boundary. Null fields are empty; an empty field has one empty section. Repeated rows are
    counted as often. Other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)
    joined = F.concat_ws("\n", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names])
    sizes = F.array(*[F.octet_length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in names])
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), joined.alias("text"), sizes.alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = encoder(vocabulary)
        for batch in slices(batches, "text"):
            data, at = utf8(batch.column("text"))
            n = len(data)
            sized = np.array(batch.column("sizes").to_pylist(), np.int64).reshape(-1, len(names))
            # Starts of sections: fields (each after the line feed that joins it), then lines inside them.
            field_start = at[:-1, None] + np.concatenate([np.zeros((len(sized), 1), np.int64), np.cumsum(sized[:, :-1] + 1, axis=1)], axis=1)
            starts = field_start.ravel()
            which = np.tile(np.arange(len(names)), len(sized))
            owner = np.repeat(np.arange(len(sized)), len(names))
            if by_line and n:
                lines = np.flatnonzero(data == 10) + 1
                of = np.searchsorted(starts, lines, side="right") - 1
                # Not at the start of a field, and not past the end of the document.
                inner = (lines > starts[of]) & (lines < starts[of] + sized.ravel()[of])
                lines, of = lines[inner], of[inner]
                starts = np.concatenate([starts, lines])
                which, owner = np.concatenate([which, which[of]]), np.concatenate([owner, owner[of]])
                order = np.lexsort((which, starts, owner))
                starts, which, owner = starts[order], which[order], owner[order]
            ends = np.append(starts[1:], n)
            ends = np.minimum(ends, at[owner + 1])
            tokens = [encoding.encode_to_numpy(x, disallowed_special=()) if x else np.zeros(0, np.uint32) for x in batch.column("text").to_pylist()]
            token_end = np.cumsum(lengths[np.concatenate(tokens)]) if tokens else np.zeros(0, np.int64)
            counts, crossing = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            full = np.flatnonzero(ends > starts)
            if len(token_end):
                got, crosses = allocate(token_end, starts[full], rule)
                counts[full] = np.bincount(got, minlength=len(full))
                crossing[full] = np.bincount(got[crosses], minlength=len(full))
            chars = np.zeros(n + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (which[1:] != which[:-1])))
            section = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
            base = chars[at[owner]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner)), pa.array(names).take(pa.array(which)), pa.array(section.astype(np.int32)),
                    pa.array(chars[starts] - base), pa.array(chars[ends] - base), pa.array(counts), pa.array(crossing),
                ],
                ["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing"],
            )

    return rows.mapInArrow(run, "doc_id long, field string, section int, start long, end long, n_tokens long, n_crossing long")
