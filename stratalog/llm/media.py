"""Media columns: 8-bit WAV samples, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a block; payloads are padded to a positive multiple of it, and it is the window of the transform.
BLOCK = 576
HOP = BLOCK // 2
RATE = 8000
PAD = 255
#: Half-open ranges of frequency bins, each of which may give one peak a frame.
BANDS = ((2, 12), (12, 36), (36, 96), (96, 289))
#: Later peaks that a peak is paired with, and how many frames away they may lie.
FAN_OUT = 3
REACH = 63
#: Frames that are transformed at once.
FRAMES = 4096


def pad_payload(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % BLOCK if data else BLOCK)


def wav_bytes(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes | None:
    """The samples of a mono 8-bit WAV file; None for anything else, an empty or a broken file among them."""
    try:
        with wave.open(io.BytesIO(media), "rb") as w:
            return w.readframes(w.getnframes()) if (w.getnchannels(), w.getsampwidth()) == (1, 1) else None
    except (wave.Error, EOFError):
        return None


def encode_wav(df: DataFrame, text: str, wav: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Replace ``text`` by its UTF-8 bytes stored as mono 8-bit WAV.

    Bytes of value 255 are appended up to a positive multiple of 576, so null and empty texts become one block of
    padding. Equal texts give equal files. All other columns are kept; a column that already has one of the two
    new names is replaced. Rows stay as they are, so repeated rows are repeated.
    """
    keep = [c for c in df.columns if c not in {text, wav, n_bytes}]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = df.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias(n_bytes), F.lit(b"").alias(wav)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                texts = [(x or "").encode() for x in batch.column("__text").to_pylist()]
                media = [wav_bytes(pad_payload(x)) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())],
                    [*keep, n_bytes, wav],
                )

    return source.mapInArrow(run, schema)


_WINDOW = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(BLOCK) / BLOCK)).astype(np.float32)


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per frame and band, the bin of the largest power and that power; frames overlap by half."""
    n = (len(samples) - BLOCK) // HOP + 1
    bins, power = np.empty((n, len(BANDS)), np.int32), np.empty((n, len(BANDS)), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, BLOCK)[::HOP]
    for at in range(0, n, FRAMES):
        block = (frames[at : at + FRAMES].astype(np.float32) - np.float32(128)) * _WINDOW
        spectrum = np.fft.rfft(block, axis=1)
        energy = spectrum.real**2 + spectrum.imag**2
        for k, (low, high) in enumerate(BANDS):
            best = energy[:, low:high].argmax(axis=1)
            bins[at : at + FRAMES, k] = best + low
            power[at : at + FRAMES, k] = energy[np.arange(len(best)), best + low]
    return bins, power


def pair_codes(bins: np.ndarray, power: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of pairs of peaks and the owner of each: frame << 32 | first bin << 22 | second bin << 12 | distance.

    A peak is a band's power that exceeds the frame before and is no less than the frame after (of the same owner).
    Each is paired with its next ``FAN_OUT`` peaks in order of frame and band that lie 1 to ``REACH`` frames later; one
    without any such peak is stored alone, with 0 for the second bin and the distance.
    """
    n = len(owner)
    first = np.searchsorted(owner, owner, side="left") if n else owner
    start, end = np.ones(n, bool), np.ones(n, bool)
    start[1:] = end[:-1] = owner[1:] != owner[:-1]
    before, after = np.zeros_like(power), np.zeros_like(power)
    before[1:], after[:-1] = power[:-1], power[1:]
    before[start], after[end] = 0, 0
    t, band = np.nonzero((power > before) & (power >= after))
    f, who, when = bins[t, band].astype(np.int64), owner[t], (t - first[t]).astype(np.int64)
    codes, owners, order = [], [], []
    # A frame holds at most one peak a band, so the first FAN_OUT later frames' peaks lie within this many places.
    seen = np.zeros(len(t), np.int64)
    for step in range(1, FAN_OUT + len(BANDS)):
        i = np.arange(len(t) - step)
        apart = when[step:] - when[:-step]
        ok = (who[step:] == who[:-step]) & (apart >= 1) & (apart <= REACH) & (seen[:-step] < FAN_OUT)
        i = i[ok]
        seen[i] += 1
        codes.append(when[i] << 32 | f[i] << 22 | f[i + step] << 12 | apart[ok])
        owners.append(who[i])
        order.append(i * 16 + step)
    lone = np.flatnonzero(seen == 0)
    codes.append(when[lone] << 32 | f[lone] << 22)
    owners.append(who[lone])
    order.append(lone * 16)
    by = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(codes)[by], np.concatenate(owners)[by]


def fingerprint_wav(df: DataFrame, wav: str = "media") -> DataFrame:
    """Read WAV files from ``wav`` and replace them by digests and a fingerprint.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the last 32 samples), media_bytes, media_sha256, n_frames,
    ``fingerprint`` (array of time-coded peak pairs, see ``pair_codes``) and ``feature``, a string of the frame and
    pair counts and the SHA-1 of the codes. A null file gives nulls; one that is no mono 8-bit WAV (an empty or broken
    one too) has only media_bytes and media_sha256. A file of fewer samples than a frame, or none, has no frames and no
    pairs. Long files are transformed in blocks of frames; repeated rows give repeated results. Columns that already
    have one of these names are replaced.
    """
    added = {
        "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
        "media_sha256": pa.string(), "n_frames": pa.int64(), "fingerprint": pa.list_(pa.int64()), "feature": pa.string(),
    }
    kinds = {"payload_bytes": "long", "tail_crc32": "long", "media_bytes": "long", "n_frames": "long", "fingerprint": "array<long>"}
    keep = [c for c in df.columns if c not in added and c != wav]
    schema = df.select(*[F.col(f"`{c}`") for c in keep], *[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in added]).schema
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{wav}`").alias("__wav"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = batch.column("__wav").to_pylist()
        payloads = [None if m is None else wav_samples(m) for m in media]
        bins, power, owner = [], [], []
        counts = np.zeros(len(media), np.int64)
        for i, p in enumerate(payloads):
            if p is not None and len(p) >= BLOCK:
                b, e = band_peaks(np.frombuffer(p, np.uint8))
                counts[i] = len(b)
                bins.append(b)
                power.append(e)
                owner.append(np.full(len(b), i))
        if bins:
            codes, who = pair_codes(np.concatenate(bins), np.concatenate(power), np.concatenate(owner))
        else:
            codes, who = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(who, np.arange(len(media) + 1))
        prints = [None if p is None else codes[a:b] for p, a, b in zip(payloads, at[:-1], at[1:], strict=True)]
        out = {
            "payload_bytes": [None if p is None else len(p) for p in payloads],
            "payload_sha256": [None if p is None else hashlib.sha256(p).hexdigest() for p in payloads],
            "tail_crc32": [None if p is None else zlib.crc32(p[-32:]) for p in payloads],
            "media_bytes": [None if m is None else len(m) for m in media],
            "media_sha256": [None if m is None else hashlib.sha256(m).hexdigest() for m in media],
            "n_frames": [None if p is None else int(n) for p, n in zip(payloads, counts, strict=True)],
            "fingerprint": prints,
            "feature": [None if x is None else f"{n}:{len(x)}:{hashlib.sha1(x.tobytes()).hexdigest()}" for n, x in zip(counts, prints, strict=True)],
        }
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(out[c], kind) for c, kind in added.items())], [*keep, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                yield rows(big.slice(at, 256))

    return source.mapInArrow(run, schema)
