"""A table of short byte strings in numpy arrays, looked up for many strings at once, exactly.

A string of up to ``WIDTH`` bytes is three 64-bit lanes, padded with zeros, and a tag: its length, its kind and a mark that the
slot is taken. Slots are found by open addressing, side by side for all strings.
"""

from __future__ import annotations

import numpy as np

from .words import mix64

WIDTH = 24
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lanes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Three rows of lanes for the strings at start; raw ends with WIDTH bytes to spare. Bytes from WIDTH on are left out."""
    whole = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    return np.stack([whole[start + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)] for k in range(3)])


class WordTable:
    """Rows from 0 by string; each string has its own."""

    def __init__(self, most: int):
        slots = 1 << max(4, int(2 * most - 1).bit_length())
        self.most, self.mask, self.n = most, np.uint64(slots - 1), 0
        self.lane = np.zeros((3, slots), np.uint64)
        self.tag, self.row = np.zeros(slots, np.uint8), np.full(slots, -1, np.int32)

    def _slots(self, lane: np.ndarray, tag: np.ndarray) -> np.ndarray:
        h = lane[0] * np.uint64(0x9E3779B97F4A7C15) + lane[1] * np.uint64(0xC2B2AE3D27D4EB4F) + lane[2] * np.uint64(0xD6E8FEB86659FD93)
        return mix64(h + tag) & self.mask

    def rows(self, lane: np.ndarray, tag: np.ndarray, add: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The row of each string, -1 where it isn't there; and, if strings are added, a string's index for each new row. No more
        than ``most`` may be added."""
        out, first = np.full(len(tag), -1, np.int32), []
        slot, at = self._slots(lane, tag), np.arange(len(tag))
        while len(at):
            s, t = slot[at], tag[at]
            seen = self.tag[s]
            if add:
                free = np.flatnonzero(seen == 0)
                if len(free):
                    where = s[free]
                    self.row[where] = at[free]  # of those that want a slot, the last to be written has it
                    won = at[free][self.row[where] == at[free]]
                    where = slot[won]
                    self.lane[:, where], self.tag[where] = lane[:, won], tag[won]
                    self.row[where] = np.arange(self.n, self.n + len(won))
                    self.n += len(won)
                    first.append(won)
                    seen = self.tag[s]
            same = seen == t
            for k in range(3):
                same &= self.lane[k][s] == lane[k][at]
            out[at[same]] = self.row[s[same]]
            at = at[~same & (seen != 0)]
            slot[at] = (slot[at] + np.uint64(1)) & self.mask
        return out, np.concatenate(first) if first else np.zeros(0, np.int64)
