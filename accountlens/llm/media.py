"""Media columns: 8-bit WAV, short-time Fourier transforms, spectral-peak pairs.

A payload becomes the samples of a mono WAV file, written and read back by the wave
module. Frames of ``FRAME`` samples, every ``HOP``, are transformed at all their
``BINS`` frequencies; in each band the strongest bin is a peak if it stands out, and peaks
of a frame pair with those of the next ``REACH`` frames. A fingerprint is two
arrays: the frame of each pair's first peak, and the pair (bin, bin, distance).

The transform uses a windowed sine table of small integers, so that all sums are
whole numbers that a float holds exactly: equal payloads have equal fingerprints
on any machine and in any batch.

Defined cases: null and empty texts are one unit of padding, which has one frame
and no pair; texts of any length are kept whole, and transformed in blocks of
frames; equal texts have equal values; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts

UNIT, FILL, RATE = 576, 255, 8000
FRAME, HOP, BINS, REACH = 576, 288, 288, 2
BANDS = [(0, 32), (32, 96), (96, 288)]
FRAMES_AT_ONCE = 1024


def padded(text: bytes | None) -> bytes:
    """The text with FILL up to a positive multiple of UNIT."""
    text = text or b""
    return text + bytes([FILL]) * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """(FRAME, 2 * BINS): Hann-windowed cosines and sines, rounded to whole numbers of at most 127."""
    t = np.arange(FRAME)
    angle = 2 * np.pi * t[:, None] * np.arange(1, BINS + 1)[None, :] / FRAME
    window = 63.5 * (1 - np.cos(2 * np.pi * t / FRAME))[:, None]
    return np.round(np.concatenate([window * np.cos(angle), window * np.sin(angle)], axis=1)).astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin of each band in each frame, and whether it holds over half as much again as twice the band's mean."""
    n = len(samples) // HOP - 1
    signal = samples.astype(np.float32) - 128
    frames = np.lib.stride_tricks.as_strided(signal, (n, FRAME), (HOP * signal.itemsize, signal.itemsize))
    bins, strong = np.zeros((n, len(BANDS)), np.int32), np.zeros((n, len(BANDS)), bool)
    for a in range(0, n, FRAMES_AT_ONCE):
        spectrum = (np.ascontiguousarray(frames[a : a + FRAMES_AT_ONCE]) @ _table()).astype(np.float64)
        power = spectrum[:, :BINS] ** 2 + spectrum[:, BINS:] ** 2
        for k, (low, high) in enumerate(BANDS):
            band = power[:, low:high]
            best = band.argmax(axis=1)
            bins[a : a + len(band), k] = best + low
            strong[a : a + len(band), k] = band[np.arange(len(band)), best] * (high - low) > 3 * band.sum(axis=1)
    return bins, strong


def fingerprints(payloads: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(times, pairs) of each payload."""
    group: list[bytes] = []
    size = 0
    for p in payloads:
        group.append(p)
        size += len(p)
        if size >= 1 << 21:
            yield from _fingerprints(group)
            group, size = [], 0
    if group:
        yield from _fingerprints(group)


def _fingerprints(payloads: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    bins, strong = peaks(np.frombuffer(b"".join(payloads), np.uint8))
    counts = np.array([len(p) // HOP - 1 for p in payloads])  # frames inside each payload; one more lies across two
    starts = np.concatenate([[0], np.cumsum(counts[:-1] + 1)])
    n = len(bins)
    left = np.zeros(n, np.int64)  # frames that follow in the same payload
    for s, c in zip(starts.tolist(), counts.tolist(), strict=True):
        left[s : s + c] = np.arange(c - 1, -1, -1)
        strong[s + c : s + c + 1] = False
    codes, valid = [], []
    for d in range(1, REACH + 1):
        follow = np.minimum(np.arange(n) + d, n - 1)
        for i in range(len(BANDS)):
            for j in range(len(BANDS)):
                codes.append((bins[:, i] << 11) | (bins[follow, j] << 2) | d)
                valid.append(strong[:, i] & strong[follow, j] & (left >= d))
    code, ok = np.stack(codes, axis=1), np.stack(valid, axis=1)
    for s, c in zip(starts.tolist(), counts.tolist(), strict=True):
        here = ok[s : s + c]
        yield np.nonzero(here)[0].astype(np.int32), code[s : s + c][here].astype(np.int32)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary, times array<int>, pairs array<int>)."""

    def run(texts: list) -> list:
        media = [to_wav(padded(t)) for t in texts]
        found = list(fingerprints([from_wav(m) for m in media]))
        return [media, [t.tolist() for t, _ in found], [p.tolist() for _, p in found]]

    return map_texts(docs, id_col, text_col, run, "media binary, times array<int>, pairs array<int>")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of lengths and checksums of what media_columns holds; feature is frames:pairs:hash of both arrays."""

    def run(texts: list) -> list:
        media = [to_wav(padded(t)) for t in texts]
        back = [from_wav(m) for m in media]
        feature = [f"{len(p) // HOP - 1}:{len(t)}:{xxhash.xxh64_hexdigest(t.astype('<i4').tobytes() + c.astype('<i4').tobytes())}" for p, (t, c) in zip(back, fingerprints(back), strict=True)]
        sha = lambda items: [hashlib.sha256(x).hexdigest() for x in items]
        return [[len(t or b"") for t in texts], [len(p) for p in back], sha(back), [zlib.crc32(p[-32:]) for p in back], [len(m) for m in media], sha(media), feature]

    return map_texts(docs, id_col, text_col, run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def decoded(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", n_bytes_col: str = "n_bytes") -> DataFrame:
    """(id, text) of stored WAV columns and the length without padding. The header of a plain PCM file has 44 bytes."""
    return df.select(id_col, F.decode(F.substring(F.col(media_col), F.lit(45), F.col(n_bytes_col).cast("int")), "UTF-8").alias("text"))
