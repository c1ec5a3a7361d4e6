"""Words of UTF-8 text as numpy arrays of 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: `[^\x20\x09-\x0D]+`
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_STEP = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_STEP, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers = {_STEP: np.ones(1, U), _INVERSE: np.ones(1, U)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        p = np.full(max(n, 1 << 19), base, U)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=U)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3: spreads every bit of h over the result."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h = h * U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def raw(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset at which each begins (one more at the end). Null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words in bytes, and the index of each text's first word (one more at the end).

    `chars` says which lower-cased bytes belong to words. No word reaches over the end of its text.
    """
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = chars[data]
    first = inside[1:] & ~inside[:-1]
    last = inside[1:].copy()
    last[:-1] &= ~inside[2:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts + 1]
    last[cuts - 1] = inside[cuts]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begins, ends, np.searchsorted(begins, offs)


def words(texts: pa.StringArray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, A-Z lower-cased, and the index of each text's first word."""
    data, offs = raw(texts)
    low = LOWER[data]
    begins, ends, index = spans(low, offs, chars)
    total = np.zeros(len(low) + 1, U)
    np.cumsum(_BYTES[low] * _power(_STEP, len(low)), dtype=U, out=total[1:])
    h = (total[ends] - total[begins]) * _power(_INVERSE, len(low) + 1)[begins]
    return mix(h ^ (ends - begins).astype(U) * U(0xD6E8FEB86659FD93)), index
