"""Token ids of whole texts with a public byte-level BPE vocabulary, as its `tokenizers` file gives them."""

from __future__ import annotations

import json
import re
import sys

import numpy as np

#: Slots of a worker's table of pieces; ids that it keeps before it begins anew; bytes that it cuts into pieces at a time.
SLOTS, CACHED, SLICE = 1 << 21, 1 << 22, 1 << 21
_GAP = re.compile(r"\s \s")
# Bytes that may end or begin white space in UTF-8; texts with a space between two such are looked at more closely.
_MAY_END, _MAY_BEGIN = np.zeros(256, bool), np.zeros(256, bool)
_MAY_END[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_MAY_BEGIN[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_VALUE = np.random.default_rng(20250117).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _BASE_BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOW, _BACK = (np.array([pow(b, k, 1 << 64) for k in range(4096)], np.uint64) for b in (_BASE, _BASE_BACK))
_BACK_FAR = np.array([pow(_BASE_BACK, 4096 * k, 1 << 64) for k in range(SLICE // 4096 + 2)], np.uint64)
_powers: list[np.ndarray] = []


def _power(n: int) -> np.ndarray:
    """Powers of the hash's base, in order."""
    if not _powers or len(_powers[0]) < n:
        far = np.array([pow(_BASE, 4096 * k, 1 << 64) for k in range(n // 4096 + 1)], np.uint64)
        _powers[:] = [(far[:, None] * _LOW[None, :]).reshape(-1)]
    return _powers[0][:n]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the other bytes in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks of ordinary tokens by their bytes, and ids of the added tokens, of a `tokenizers` file."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    added = {t["content"]: int(t["id"]) for t in held.get("added_tokens", ())}
    symbol = byte_symbols()
    return {bytes(symbol[c] for c in token): int(k) for token, k in held["model"]["vocab"].items() if token not in added}, added


class Encoder:
    """Texts -> ids of 16 bits.

    A single space between two other characters always begins a token, so texts are cut there into pieces, each with the space before it. Pieces are told apart by 64-bit hashes, computed for all
    pieces of a slice at once; the ids of a piece are encoded once and then gathered from a table, whose slot a later piece may take. Pieces that are not in the table are encoded together and told apart by the
    tokens that begin with a space. Only where white space follows white space around a space would the cut matter; such texts, and those with the string of an added token, are encoded by themselves.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks, self.added = vocabulary(path)
        if max([*ranks.values(), *self.added.values()]) >= 1 << 16:
            raise ValueError("the vocabulary does not fit 16 bits")
        self.plain = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.opens = np.zeros(1 << 16, bool)
        self.opens[[k for token, k in ranks.items() if token[:1] == b" "]] = True
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.count, self.flat = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32), np.zeros(0, np.uint16)

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text by itself."""
        if self.special is None:
            return np.array(self.plain(text), np.uint16)
        parts = [[self.added[t]] if t in self.added else self.plain(t) for t in self.special.split(text)]
        return np.array([k for p in parts for k in p], np.uint16)

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the ids of pieces, which have their space with them, to `flat`: where each piece's ids begin there, and how many they are."""
        easy = end - start > 1  # a space and then no white space at either end: its first token, and no other, begins with a space
        at = np.flatnonzero(easy)
        easy[at] = data[start[at]] == 32
        at = at[easy[at]]
        for k in at[_MAY_BEGIN[data[start[at] + 1]] | _MAY_END[data[end[at] - 1]]].tolist():
            text = data[start[k] : end[k]].tobytes().decode()
            easy[k] = not text[1].isspace() and not text[-1].isspace()
        size = (end - start)[easy]
        ends = np.cumsum(size)
        joined = data[np.arange(int(size.sum())) + np.repeat(start[easy] - ends + size, size)]
        ids = np.array(self.plain(joined.tobytes().decode()), np.uint16)
        first = np.flatnonzero(self.opens[ids])
        if len(first) != len(size) or len(first) and first[0]:
            easy, ids, first = np.zeros(len(start), bool), ids[:0], first[:0]
        rest = [np.array(self.plain(data[a:b].tobytes().decode()), np.uint16) for a, b in zip(start[~easy].tolist(), end[~easy].tolist())]
        size = np.array([len(r) for r in rest], np.int64)
        begin, count, at = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32), len(self.flat)
        begin[easy], count[easy] = at + first, np.diff(np.append(first, len(ids)))
        begin[~easy], count[~easy] = at + len(ids) + np.cumsum(size) - size, size
        self.flat = np.concatenate([self.flat, ids, *rest])
        return begin, count

    def _slice(self, data, start, end, inner) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive pieces, and how many each has."""
        low = int(start[0])
        total = np.cumsum(_VALUE[data[low : int(end[-1])]] * _power(int(end[-1]) - low))
        total = np.append(np.uint64(0), total)
        key = (total[end - low] - total[start - low]) * _BACK[(start - low) & 4095] * _BACK_FAR[(start - low) >> 12]
        key = key + (2 * (end - start) + inner).astype(np.uint64)
        key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        key = np.maximum(key ^ key >> np.uint64(32), np.uint64(1))  # 0 is a free slot
        slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
        if len(self.flat) > CACHED:
            self.forget()
        first, count = self.start[slot], self.count[slot]
        new = np.flatnonzero(self.keys[slot] != key)
        if len(new):
            known, at, back = np.unique(key[new], return_index=True, return_inverse=True)
            at = new[at]
            begin, size = self.learn(data, (start - inner)[at], end[at])
            first[new], count[new] = begin[back], size[back]
            at = slot[at]
            self.keys[at], self.start[at], self.count[at] = known, begin, size
        ends = np.cumsum(count)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + count, count)], count

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """Ids of each text of an Arrow buffer of UTF-8, one after another; texts are taken together up to about SLICE bytes."""
        at = 0
        while at < len(offsets) - 1:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            yield from self._together(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end

    def _together(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(offsets) - 1
        space = np.flatnonzero(data == 32)
        start = np.concatenate([space + 1, offsets[:-1]])
        inner = np.append(np.ones(len(space), np.int64), np.zeros(n, np.int64))
        order = np.argsort(start, kind="stable")  # where a text ends with a space, its last piece comes before the next text
        start, inner = start[order], inner[order]
        end = np.append(start[1:] - inner[1:], len(data))
        ids, counts, at = [], [], 0
        while at < len(start):
            stop = max(at + 1, int(np.searchsorted(start, start[at] + SLICE, "left")))
            found, count = self._slice(data, start[at:stop], end[at:stop], inner[at:stop])
            ids.append(found)
            counts.append(count)
            at = stop
        upto = np.append(0, np.cumsum(np.concatenate(counts)) if counts else [])
        cuts = np.append(upto[np.flatnonzero(inner == 0)], upto[-1]).astype(np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
        out = [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        before, after = data[np.maximum(space - 1, 0)], data[np.minimum(space + 1, max(0, len(data) - 1))]
        odd = np.searchsorted(offsets, space[_MAY_END[before] & _MAY_BEGIN[after]], "right") - 1
        odd = {*odd.tolist(), *self._with_added(data, offsets)}
        for k in odd:
            text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
            if _GAP.search(text) or self.special and self.special.search(text):
                out[k] = self.whole(text)
        return out

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts that may hold the string of an added token."""
        found = []
        for token in self.added:
            token = np.frombuffer(token.encode(), np.uint8)
            head = np.flatnonzero((data[: len(data) - 1] == token[0]) & (data[1:] == token[1])) if len(token) > 1 and len(data) > 1 else np.flatnonzero(data == token[0])
            found += (np.unique(np.searchsorted(offsets, head, "right")) - 1).tolist()
        return found


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary. It is kept for the life of the Python worker."""
    kept = sys.__dict__.setdefault("_signaloom_encoders", {})  # functions travel by value: their own globals do not outlive a task
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
