"""Media columns: payloads as WAV, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_text

RATE, FRAME, HOP = 8000, 256, 128
#: A peak is the largest power within so many frames and bins; an anchor pairs with so many peaks that follow within REACH frames.
NEAR_FRAMES, NEAR_BINS, FAN, REACH = 3, 4, 4, 63
#: Frames that are transformed at once; bounds memory for long recordings.
FRAMES_AT_ONCE = 2048
UNIT = 64

_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono WAV with one unsigned 8-bit sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("mono 8-bit samples expected")
        return w.readframes(w.getnframes())


def padded(text: str | bytes) -> bytes:
    """UTF-8 with bytes 0 up to a positive multiple of 64."""
    data = text.encode() if isinstance(text, str) else text
    return data + bytes(-len(data) % UNIT if data else UNIT)


def power(samples: np.ndarray) -> np.ndarray:
    """Spectral power, one row for each frame."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    spectrum = np.fft.rfft(frames * _WINDOW, axis=1)
    return np.square(spectrum.real) + np.square(spectrum.imag)


def _largest(p: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """The maximum within `reach` steps on either side along an axis, by doubling windows."""
    wide = [(reach, reach) if a == axis else (0, 0) for a in range(2)]
    padding = np.pad(p, wide, constant_values=-1)
    step, have = 1, 1
    need = 2 * reach + 1
    cut = lambda x, a, b: x[a:b] if axis == 0 else x[:, a:b]
    while have < need:
        step = min(have, need - have)
        n = padding.shape[axis]
        padding = np.maximum(cut(padding, 0, n - step), cut(padding, step, n))
        have += step
    return padding


def peaks(payload: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of frames, and frame and bin of every spectral peak, by frame and then bin.

    Silence (samples of 128) surrounds the payload; the last frame is filled with it. Bin 0 is no peak.
    """
    n = max(1, -(-(len(payload) - FRAME) // HOP) + 1)
    x = np.zeros((n - 1) * HOP + FRAME, np.float32)
    x[: len(payload)] = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    at, bins = [], []
    for begin in range(0, n, FRAMES_AT_ONCE):
        end = min(n, begin + FRAMES_AT_ONCE)
        a, b = max(0, begin - NEAR_FRAMES), min(n, end + NEAR_FRAMES)
        p = power(x[a * HOP : (b - 1) * HOP + FRAME])
        top = _largest(_largest(p, NEAR_BINS, 1), NEAR_FRAMES, 0)
        t, f = np.nonzero((p == top) & (p > 1e-3))
        keep = (t + a >= begin) & (t + a < end) & (f > 0)
        at.append(t[keep] + a)
        bins.append(f[keep])
    return n, np.concatenate(at), np.concatenate(bins)


def fingerprint(payload: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of frames, and the time code (anchor's frame) and hash (two bins and their distance in frames) of each pair."""
    n, t, f = peaks(payload)
    times, hashes = [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = (gap > 0) & (gap <= REACH)
        times.append(t[:-k][near])
        hashes.append((f[:-k][near] << 14) | (f[k:][near] << 6) | gap[near])
    times, hashes = np.concatenate(times).astype(np.int32), np.concatenate(hashes).astype(np.int32)
    order = np.lexsort((hashes, times))
    return n, times[order], hashes[order]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: the text's UTF-8, padded, as a WAV file. Null is the empty text; rows map one to one."""

    def make():
        return lambda texts: [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), [to_wav(padded(t or "")) for t in texts.to_pylist()]]

    return map_text(docs, text, [key], "n_bytes long, media binary", make)


def analyse(media: DataFrame, keep: list[str], column: str = "media") -> DataFrame:
    """Reads stored WAV files back. Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, times, hashes, feature.

    times and hashes are the fingerprint as time-coded arrays; feature sums them up as frames:pairs:SHA-256. Equal files
    give equal values; a null file raises, as nothing was stored. Long recordings are transformed in blocks of frames.
    """

    def make():
        def one(m: bytes) -> tuple:
            p = from_wav(m)
            n, times, hashes = fingerprint(p)
            mark = hashlib.sha256(times.astype("<i4").tobytes() + hashes.astype("<i4").tobytes()).hexdigest()
            return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), times, hashes, f"{n}:{len(times)}:{mark}"

        return lambda files: list(zip(*map(one, files.to_pylist()), strict=True))

    return map_text(media, column, keep, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, hashes array<int>, feature string", make)
