"""Byte-level BPE of many texts at once: splits are found by array operations, and looked up by their bytes.

The splitting pattern of byte-level BPE tells four classes of characters apart: letters, numbers, white space and all others. Where two
neighbours are in different classes a split begins, but for a single space, which goes with what follows it, the last character of a run of
white space, and the seven English contractions. All of that is decided for a whole buffer of texts by comparing it with itself moved by one
byte.

Only characters whose class no version of Unicode disputes are treated so. Stretches between two safe places (a space between two such
characters) that hold any other character, or the first two bytes of a special token, are handed back to be encoded whole.

A split of at most 16 bytes is two 64-bit numbers, by which an open-addressed table finds its token ids: the numbers are the split itself, so
that nothing depends on hashes. Longer ones are handed back as well.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

#: Bytes of a split that the table takes.
MOST_BYTES = 16

_LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN, _NONE = range(6)
#: Code points from here on are unknown; all before are written in one or two bytes.
_SETTLED = 0x240


def _classes() -> np.ndarray:
    """The class of a character's first byte, by that byte and the next: 256 * first + next."""
    def of(code: int) -> int:
        kind = unicodedata.category(chr(code))
        return {"L": _LETTER, "N": _NUMBER, "C": _UNKNOWN, "Z": _UNKNOWN}.get(kind[0], _OTHER)

    out = np.full((256, 256), _UNKNOWN, np.uint8)
    for code in range(0x80):
        out[code] = of(code)
    out[[0x20, *range(9, 14)]] = _SPACE
    for code in range(0xA1, _SETTLED):
        first, second = chr(code).encode()
        out[first, second] = of(code)
    return out.ravel()


_CLASS = _classes()
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Table:
    """Rows of token ids by splits of at most MOST_BYTES bytes, none of them zero."""

    def __init__(self, most: int):
        self.most, self.n = most, 0
        self._empty(1 << 12)
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _empty(self, slots: int) -> None:
        self.low, self.high, self.row = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(len(self.row) - 1)).astype(np.int64)

    def _place(self, low: np.ndarray, high: np.ndarray, row: np.ndarray) -> None:
        """Puts different splits into free slots: of those that meet in one, one stays and the others go on to the next."""
        slot = self._slots(low, high)
        while len(row):
            free = np.flatnonzero(self.row[slot] < 0)
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.low[at], self.high[at], self.row[at] = low[won], high[won], row[won]
            stays = np.ones(len(row), bool)
            stays[won] = False
            low, high, row, slot = low[stays], high[stays], row[stays], (slot[stays] + 1) & (len(self.row) - 1)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The row of each split, -1 where there is none."""
        slot = self._slots(low, high)
        row = self.row[slot]
        open_ = np.flatnonzero((row >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.row) - 1)
            at = slot[open_]
            row[open_] = self.row[at]
            open_ = open_[(row[open_] >= 0) & ((self.low[at] != low[open_]) | (self.high[at] != high[open_]))]
        return row

    def add(self, low: np.ndarray, high: np.ndarray, ids: list[list[int]]) -> int:
        """Takes new, different splits, as far as there is room; how many it took."""
        k = min(len(low), self.most - self.n)
        if k <= 0:
            return 0
        if 2 * (self.n + k) >= len(self.row):
            kept = self.row >= 0
            old = self.low[kept], self.high[kept], self.row[kept]
            self._empty(1 << (3 * (self.n + k)).bit_length())
            self._place(*old)
        ends = self.starts[-1] + np.cumsum([len(x) for x in ids[:k]], dtype=np.int64)
        self.ids = np.concatenate([self.ids, np.array([i for x in ids[:k] for i in x], np.uint32)])
        self.starts = np.concatenate([self.starts, ends])
        self._place(low[:k], high[:k], np.arange(self.n, self.n + k, dtype=np.int32))
        self.n += k
        return k


def boundaries(data: np.ndarray, offsets: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where splits begin in texts that lie end to end, and which of them are stretches to be encoded whole. ``marks`` are special tokens."""
    n = len(data)
    kind = _CLASS[(data.astype(np.uint16) << np.uint16(8)) | np.append(data[1:], np.uint8(0))]
    tail = np.flatnonzero((data & 0xC0) == 0x80)
    lead = data[tail - 1]
    kind[tail] = np.where((lead >= 0xC2) & (lead < 0xE0), kind[tail - 1], _UNKNOWN)
    for mark in marks:
        at = np.flatnonzero(data[: n - len(mark[:2]) + 1] == mark[0])
        if len(mark) > 1:
            at = at[data[at + 1] == mark[1]]
        kind[at] = _UNKNOWN
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[first[:n]] = _NONE
    begins = np.append(kind != before, True)
    # a run that follows white space takes a single space before it; the last character of white space is a split, or goes with that run
    after_space = np.flatnonzero(begins[:n] & (before == _SPACE))
    begins[after_space - 1] = True
    begins[after_space[data[after_space - 1] == 0x20]] = False
    _contractions(data, kind, before, first, begins)
    begins[offsets] = True
    unknown = np.flatnonzero(kind == _UNKNOWN)
    whole = np.zeros(0, np.int64)
    if len(unknown):
        space = np.flatnonzero(data == 0x20)
        space = space[(space > 0) & (space < n - 1)]
        safe = space[(before[space] <= _OTHER) & (kind[space + 1] <= _OTHER) & ~first[space + 1]]
        safe = np.union1d(safe, offsets)
        right = np.unique(np.searchsorted(safe, unknown, "right"))
        whole = safe[right - 1]
        inside = np.zeros(n + 1, np.int8)
        inside[whole] += 1
        inside[safe[right]] -= 1
        covered = np.cumsum(inside, dtype=np.int8) > 0
        begins &= ~covered
        begins[whole] = True
        begins[safe[right]] = True
    return np.flatnonzero(begins[:n]), whole


def _contractions(data: np.ndarray, kind: np.ndarray, before: np.ndarray, first: np.ndarray, begins: np.ndarray) -> None:
    """The splits 's 't 're 've 'm 'll 'd, where an apostrophe begins a split."""
    n = len(data)
    at = np.flatnonzero(data == 0x27)
    at = at[(at + 1 < n) & (before[at] != _OTHER)]
    previous = np.where(before[at] == _NONE, 0, data[at - 1])
    at = at[(previous != 0x20) & ~first[at + 1]]
    one = data[at + 1]
    short = at[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
    begins[short + 1] = False
    begins[short + 2] = True
    at, one = at[at + 2 < n], one[at + 2 < n]
    two = data[at + 2]
    pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    long = at[pair & ~first[at + 2]]
    begins[long + 1] = False
    begins[long + 3] = True


def encode(
    data: np.ndarray, starts: np.ndarray, whole: np.ndarray, table: Table, split_ids: Callable[[bytes], list[int]],
    stretch_ids: Callable[[list[bytes]], list[list[int]]],
) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all splits in one array, and the position in it at which each split begins, with one more for the end.

    starts, whole: as boundaries() gives them; split_ids: the ids of one split; stretch_ids: those of stretches that have to be encoded whole.
    """
    sizes = np.diff(np.append(starts, len(data)))
    padded = np.concatenate([data, np.zeros(MOST_BYTES, np.uint8)])
    words = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
    low = words[starts] & _MASKS[np.minimum(sizes, 8)]
    high = words[starts + np.minimum(sizes, 8)] & _MASKS[np.clip(sizes - 8, 0, 8)]
    rows = table.find(low, high).astype(np.int64)
    apart = sizes > MOST_BYTES
    apart[np.searchsorted(starts, whole)] = True
    rows[apart] = -1
    extra: list[list[int]] = []
    base = table.n
    new = np.flatnonzero((rows < 0) & ~apart)
    if len(new):
        # equal splits share one number
        pairs, inverse = np.unique(np.stack([low[new], high[new]], axis=1), axis=0, return_inverse=True)
        ids_of = [split_ids((a.to_bytes(8, "little") + b.to_bytes(8, "little")).rstrip(b"\0")) for a, b in pairs.tolist()]
        taken = table.add(pairs[:, 0], pairs[:, 1], ids_of)
        extra += ids_of[taken:]
        rows[new] = base + inverse.ravel()  # those that the table did not take stand right behind its rows
        base = table.n
    others = np.flatnonzero(apart)
    if len(others):
        raw, stretch = data.tobytes(), np.isin(starts[others], whole)
        parts = [raw[s : s + z] for s, z in zip(starts[others].tolist(), sizes[others].tolist())]
        together = iter(stretch_ids([p for p, w in zip(parts, stretch) if w]))
        rows[others] = base + len(extra) + np.arange(len(others))
        extra += [next(together) if w else split_ids(p) for p, w in zip(parts, stretch)]
    ids, at = table.ids, table.starts
    if extra:
        ids = np.concatenate([ids, np.array([i for x in extra for i in x], np.uint32)])
        at = np.concatenate([at, at[-1] + np.cumsum([len(x) for x in extra], dtype=np.int64)])
    lengths = at[rows + 1] - at[rows]
    where = np.concatenate([[0], np.cumsum(lengths)])
    flat = ids[np.arange(where[-1]) + np.repeat(at[rows] - where[:-1], lengths)]
    return flat, where
