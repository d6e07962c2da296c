"""Words of many texts as numpy arrays: hashes of words and of runs of words, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in pieces of about this many bytes; a longer text is a piece of its own.
PIECE_BYTES = 2_000_000
_U = np.uint64
_rng = np.random.default_rng(20_011)
_VALUE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Lower-cased byte inside a word, 0 between words; bytes of non-ASCII characters belong to words.
_FOLD = np.array([b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        with np.errstate(over="ignore"):
            got = np.concatenate([[_U(1)], np.multiply.accumulate(np.full(max(n, PIECE_BYTES) - 1, base, _U))])
        if n <= 4 * PIECE_BYTES:
            _powers[name] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) of a string column, cut into pieces; null is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each row's first word and the total); with prefixes, one column more for each length in bytes."""
    if not len(data):
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, _U), np.zeros(len(offsets), np.int64)
    low = _FOLD[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    joints = offsets[1:-1]
    joints = joints[joints < len(data)]
    first[joints] = inside[joints]  # a word ends with its text
    starts = np.flatnonzero(first)
    summed = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(np.where(inside, _VALUE[low], _U(0)) * _power("ahead", _STEP, len(data)), out=summed[1:])
        ends = np.append(starts[1:], len(data))
        back = _power("back", _BACK, len(data))[starts]
        # Separators add nothing, so the sum up to the next word is the sum of this one.
        hashes = mix((summed[ends] - summed[starts]) * back + _U(0x51))
        if prefixes:
            hashes = np.stack([hashes] + [mix((summed[np.minimum(starts + k, ends)] - summed[starts]) * back + _U(0x51 + 2 * k)) for k in prefixes], axis=1)
    return hashes, np.searchsorted(starts, offsets)


def runs(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words, each row's first run and the total); a row with 1 to k - 1 words has one run."""
    counts = np.diff(bounds)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(made)])
    total = int(to[-1])
    if not total:
        return np.zeros(0, _U), to
    at = np.arange(total) - np.repeat(to[:-1] - bounds[:-1], made)
    length = np.repeat(np.minimum(counts, k), made)
    out = np.zeros(total, _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            nxt = words[np.minimum(at + j, len(words) - 1)]
            out = out * _STEP + np.where(j < length, nxt, _U(0))
        return mix(out + length.astype(_U)), to
