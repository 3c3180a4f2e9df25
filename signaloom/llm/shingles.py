"""Word shingles of whole texts as 64-bit hashes, computed on the bytes of Arrow buffers with numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_VALUE[[9, 10, 11, 12, 13, 32]] = 0
for _c in range(65, 91):
    _VALUE[_c] = _VALUE[_c + 32]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = 4096
_BASE = 0x9E3779B97F4A7C15
_LOW = np.array([pow(_BASE, i, 1 << 64) for i in range(_STEP)], dtype=np.uint64)
_HIGH = pow(_BASE, _STEP, 1 << 64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
REGION = 1 << 19


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the finaliser of splitmix64)."""
    h = h + U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls are empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; cuts: where a text begins, so that no word spans two."""
    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    begins[cuts] = ~blank[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    first = starts[0]
    place = np.arange(first, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = _VALUE[data[first:]] * _LOW[place & (_STEP - 1)]
    if place.max() >= _STEP:  # rare: a word of over 4096 bytes, or a long run of blanks after one
        far = np.flatnonzero((place >= _STEP) & (value != 0))
        value[far] *= np.array([pow(_HIGH, int(p), 1 << 64) for p in place[far] // _STEP], dtype=np.uint64)
    return starts, mix(np.add.reduceat(value, starts - first))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z as a-z) and the number of words up to each offset. Works on regions of about half a MB, cut where a text begins or after a blank."""
    hashes, starts, at, n = [], [], 0, len(data)
    begins = offsets[:-1][np.diff(offsets) > 0]
    while at < n:
        end = min(n, at + REGION)
        if end < n:
            k = np.searchsorted(begins, end, "right") - 1
            if begins[k] > at:
                end = int(begins[k])
            else:  # inside one long text: cut after a blank
                after = np.flatnonzero(_BLANK[data[at:end]])
                while not len(after) and end < n:
                    end = min(n, end + REGION)
                    after = np.flatnonzero(_BLANK[data[at:end]])
                limit = int(begins[k + 1]) if k + 1 < len(begins) else n
                end = min(at + int(after[-1]) + 1 if len(after) else end, limit)
        cuts = begins[np.searchsorted(begins, at) : np.searchsorted(begins, end)] - at
        s, h = _words(data[at:end], cuts)
        starts.append(s + at)
        hashes.append(h)
        at = end
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles as hashes; fewer words: the whole sequence as one; no word: empty."""
    data, offsets = buffers(column)
    words, upto = word_hashes(data, offsets)
    full = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        full += words[j : j + len(full)] * _PLACE[j]
    full = mix(full, k)
    sets = []
    for a, b in zip(upto[:-1], upto[1:]):
        if b - a >= k:
            s = np.sort(full[a : b - k + 1])
            sets.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            sets.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)[None], 1000 + int(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
