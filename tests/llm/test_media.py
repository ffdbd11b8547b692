import hashlib
import zlib

import numpy as np

from stratalog.llm import media


def test_samples_round_trip_and_digests(spark, odd_docs):
    out = media.fingerprint_wav(media.encode_wav(odd_docs, "text"), "media").collect()
    assert len(out) == odd_docs.count() and {r.score for r in out} == {"x"}
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in out:
        data = texts[r.doc_id].encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload)) and len(payload) % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes == len(media.wav_bytes(payload)) and r.media_sha256 == hashlib.sha256(media.wav_bytes(payload)).hexdigest()
        assert r.n_frames == (len(payload) - 576) // 288 + 1
    same = [r.feature for r in out if texts[r.doc_id].startswith("same")]
    assert len(set(same)) == 1 and len({r.feature for r in out if r.doc_id in (4, 5, 50)}) == 3


def test_a_tone_peaks_at_its_bin():
    t = np.arange(576 * 8)
    samples = np.round(128 + 100 * np.sin(2 * np.pi * 50 * t / 576)).astype(np.uint8)
    bins, _ = media.band_peaks(samples)
    assert (bins[:, 2] == 50).all()


def brute_pairs(bins, power):
    peaks = [(t, int(bins[t, b])) for t in range(len(bins)) for b in range(bins.shape[1]) if power[t, b] > (power[t - 1, b] if t else 0) and power[t, b] >= (power[t + 1, b] if t + 1 < len(bins) else 0)]
    out = []
    for i, (t, f) in enumerate(peaks):
        later = [(u, g) for u, g in peaks[i + 1 :] if 1 <= u - t <= media.REACH][: media.FAN_OUT]
        # The next peaks in order; ones of the same frame are passed over.
        out += [t << 32 | f << 22 | g << 12 | (u - t) for u, g in later] or [t << 32 | f << 22]
    return out


def test_pairs_against_brute_force():
    rng = np.random.default_rng(1)
    bins, power, owner, want = [], [], [], []
    for k, n in enumerate((1, 40, 7)):
        b = np.stack([rng.integers(lo, hi, n) for lo, hi in media.BANDS], 1).astype(np.int32)
        p = rng.random((n, len(media.BANDS))).astype(np.float32)
        bins.append(b), power.append(p), owner.append(np.full(n, k))
        want.append(brute_pairs(b, p))
    codes, who = media.pair_codes(np.concatenate(bins), np.concatenate(power), np.concatenate(owner))
    for k, w in enumerate(want):
        assert codes[who == k].tolist() == w


def test_files_without_samples_and_files_that_are_none(spark):
    stereo = bytearray(media.wav_bytes(b"\x80" * 600))
    stereo[22:24] = (2).to_bytes(2, "little")
    files = [media.wav_bytes(b""), media.wav_bytes(b"\x80" * 10), b"", b"RIFF", media.wav_bytes(b"\x01" * 600)[:20], bytes(stereo), None]
    df = spark.createDataFrame([(i, None if f is None else bytearray(f), "x", "y") for i, f in enumerate(files)], "doc_id int, media binary, feature string, n_frames string")
    got = {r.doc_id: r for r in media.fingerprint_wav(df, "media").collect()}
    assert [(got[i].payload_bytes, got[i].n_frames, got[i].fingerprint) for i in (0, 1)] == [(0, 0, []), (10, 0, [])]
    assert got[0].payload_sha256 == hashlib.sha256(b"").hexdigest() and got[0].tail_crc32 == 0
    for i in (2, 3, 4, 5):
        assert got[i].payload_bytes is None and got[i].feature is None and got[i].media_bytes == len(files[i]) and got[i].media_sha256 == hashlib.sha256(files[i]).hexdigest()
    assert got[6].media_bytes is None and got[6].media_sha256 is None


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "some text", b"old", 7)] * 2, "doc_id int, text string, media binary, n_bytes int")
    out = media.fingerprint_wav(media.encode_wav(df, "text"), "media").collect()
    assert [(r.n_bytes, r.payload_bytes) for r in out] == [(9, 576)] * 2 and out[0] == out[1]


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert media.fingerprint_wav(media.encode_wav(df, "text"), "media").count() == 0
