"""Word and character shingles of whole texts as 64-bit hashes, in numpy.

Words are runs of bytes other than space and the controls 9 to 13, with A-Z read
as a-z. A word's hash comes from running sums of random byte values times powers
of an odd constant, so a text costs a few passes over its bytes whatever its
words. Hashes are the same on every machine and in every run.
"""

from __future__ import annotations

import numpy as np

from vitagrain.llm.common import mix

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE[65:91] = _BYTE[97:123]
_PLACE = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((_FACTOR, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _block(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one block; first marks where a text begins."""
    word = ~SPACE[data]
    head = word.copy()
    head[1:] &= ~word[:-1] | first[1:]
    tail = word.copy()
    tail[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + mix((ends - starts).astype(np.uint64))), starts


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and where each text's words begin in them."""
    found, places, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    while low < len(data):
        high = min(len(data), low + BLOCK)
        if high < len(data):  # cut behind white space or between texts; a longer word stays whole
            fit = np.flatnonzero(SPACE[data[low:high]] | begins[low + 1: high + 1])
            if len(fit):
                high = low + int(fit[-1]) + 1
            else:
                more = np.flatnonzero(SPACE[data[high:]] | begins[high + 1:])
                high = high + int(more[0]) + 1 if len(more) else len(data)
        hashes, starts = _block(data[low:high], begins[low:high])
        found.append(hashes)
        places.append(starts + low)
        low = high
    return np.concatenate(found), np.searchsorted(np.concatenate(places), offsets)


def word_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer words is one shingle of all its words; one without words has none.
    """
    hashes, at = words(data, offsets)
    rows = max(0, len(hashes) - size + 1)
    runs = np.zeros(rows, np.uint64)
    for k in range(size):
        runs += hashes[k: k + rows] * _PLACE[k]
    runs = mix(runs)
    out = []
    for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
        n = high - low
        if n >= size:
            out.append(np.unique(runs[low: high - size + 1]))
        elif n:
            whole = (hashes[low:high] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def character_codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def character_shingles(codes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts laid end to end (not distinct, in order) and their offsets.

    A text of fewer characters is one shingle, made of its characters and zeros.
    """
    lengths = np.diff(offsets)
    padded = np.zeros(len(codes) + size, np.uint64)
    padded[: len(codes)] = mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    rows = len(codes)
    runs = np.zeros(rows, np.uint64)
    for k in range(size):
        runs += padded[k: k + rows] * _PLACE[k]
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(rows) - offsets[:-1][text]
    keep = inside <= np.maximum(lengths[text] - size, 0)
    for i in np.flatnonzero((lengths > 0) & (lengths < size)):  # the window must not reach into the next text
        low = offsets[i]
        runs[low] = (padded[low: low + lengths[i]] * _PLACE[: lengths[i]]).sum(dtype=np.uint64)
    counts = np.minimum(lengths, np.maximum(lengths - size + 1, 1))
    return mix(runs[keep]), np.concatenate([[0], np.cumsum(counts)])


def set_hash(items: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes, as two signed longs."""
    if not len(items):
        return 0, 0
    one = mix(items + np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    two = mix(items ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    pair = np.array([one, two], np.uint64).view(np.int64)
    return int(pair[0]), int(pair[1])
