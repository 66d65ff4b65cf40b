"""Words `[^\\x20\\x09-\\x0D]+` of whole texts as 64-bit hashes, for a column of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the input changes half of the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _STEP + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, b, _U))]) for b in (_BASE, inverse)]
    return _powers


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each text starts (one more entry for the end); null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words each text has; parts: the bytes that part words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~parts[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first & inside)
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, first[1:] | ~inside[1:]
    ends = np.flatnonzero(last & inside) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A polynomial hash of each word's bytes (A-Z lower-cased), finished with its length."""
    out, i = np.empty(len(starts), _U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _STEP, "right")))
        at = starts[i]
        part = data[at : ends[j - 1]]
        part = _LOWER[part] if lower else part
        up, down = _power(len(part))
        total = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * up[: len(part)], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and each text's number of words."""
    data, offsets = buffer_of(texts)
    starts, ends, counts = spans(data, offsets)
    return hashes(data, starts, ends), counts


def groups(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that a part holds at most so many bytes of text, or one text."""
    _, offsets = buffer_of(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of `size` words; with fewer, of all its words."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    weights = mix(np.arange(1, size + 1).astype(_U)) | _U(1)
    rolled = np.zeros(max(0, len(words) - size + 1), _U)
    for k in range(size if len(rolled) else 0):
        rolled += words[k : k + len(rolled)] * weights[k]
    rolled = mix(rolled)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(rolled[end - n : end - size + 1]))
        elif n:
            out.append(mix((words[end - n : end] * weights[:n]).sum(keepdims=True) + _U(n)))
        else:
            out.append(np.zeros(0, _U))
    return out
