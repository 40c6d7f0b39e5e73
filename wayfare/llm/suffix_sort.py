"""Two-stage suffix sorting of a block of byte strings, to a fixed depth, in numpy.

Suffixes smaller than their successor are sorted directly. All others are induced: buckets (by first byte) are scanned from the
smallest, and each scanned suffix puts the one before it, if that is larger, at the next free place of its bucket. Adjacent common prefixes
of the sorted suffixes then tell which strings of the depth's length occur more than once.
"""

from __future__ import annotations

import numpy as np


class Block:
    """Byte strings laid end to end, each byte raised by one so that zero can end a string.

    Valid UTF-8 has no byte above 0xF4, so raised bytes fit; other bytes raise an error.
    """

    def __init__(self, strings: list[bytes], depth: int):
        self.depth = depth
        raw = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        lengths = np.array([len(s) for s in strings])
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.text = raw + np.uint8(1)  # 0xff wraps to zero
        if int((self.text == 0).sum()) != len(strings):
            raise ValueError("texts must be valid UTF-8")
        padded = np.concatenate([self.text, np.zeros(depth + 8, np.uint8)])
        words = np.zeros(len(padded) - 7, np.uint64)
        for k in range(8):
            words = words << np.uint64(8) | padded[k : k + len(words)].astype(np.uint64)
        self.words = words

    def smaller_than_next(self) -> np.ndarray:
        """Flags of the suffixes that are smaller than their successors."""
        t = self.text
        rising = np.r_[t[:-1] < t[1:], False]
        differs = np.r_[t[:-1] != t[1:], True]
        at = np.where(differs, np.arange(len(t)), len(t))
        following = np.minimum.accumulate(at[::-1])[::-1]  # where a run of equal bytes ends
        return rising[following]

    def _key(self, at: np.ndarray, offset: int) -> np.ndarray:
        """Eight bytes of each suffix from ``offset`` on, the last word cut at the depth."""
        key = self.words[at + offset]
        over = offset + 8 - self.depth
        return key >> np.uint64(8 * over) if over > 0 else key

    def direct(self, at: np.ndarray) -> np.ndarray:
        """Suffixes in order of their first ``depth`` bytes: word by word, and only where still tied."""
        at = at[np.argsort(self._key(at, 0), kind="stable")]
        key = self._key(at, 0)
        fresh = np.r_[True, key[1:] != key[:-1]]
        for offset in range(8, self.depth, 8):
            group = np.cumsum(fresh)
            tied = ~(fresh & np.r_[fresh[1:], True])
            if not tied.any():
                break
            where = np.flatnonzero(tied)
            part, ids = at[where], group[where]
            key = self._key(part, offset)
            order = np.lexsort((key, ids))
            at[where] = part[order]
            key = key[order]
            fresh[where] |= np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]
        return at

    def sorted_suffixes(self) -> np.ndarray:
        """All suffixes in order of their first ``depth`` bytes."""
        t, small = self.text, self.smaller_than_next()
        direct = self.direct(np.flatnonzero(small))
        heads = t[direct]
        waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
        last = np.array([len(t) - 1])  # the last string's end has no successor; it comes first
        out = []
        for c in range(int(t.max()) + 1):
            larger = [np.concatenate(waiting[c])] if waiting[c] else []
            if c == 0:
                larger = [last]
            rounds = list(larger)
            while rounds and len(rounds[-1]):  # runs of the same byte: the longer the larger
                before = rounds[-1] - 1
                before = before[before >= 0]
                rounds.append(before[(t[before] == c) & ~small[before]])
            bucket = np.concatenate([*rounds, direct[np.searchsorted(heads, c) : np.searchsorted(heads, c, side="right")]])
            waiting[c] = []
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[t[before] > c]
            if len(before):
                chars = t[before]
                order = np.argsort(chars, kind="stable")
                before, chars = before[order], chars[order]
                cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
                for part, char in zip(np.split(before, cuts), chars[np.r_[0, cuts]]):
                    waiting[char].append(part)
        return np.concatenate(out)

    def repeated(self) -> np.ndarray:
        """Flags of the positions whose next ``depth`` bytes, within their string, also start elsewhere in the block."""
        order = self.sorted_suffixes()
        room = np.repeat(self.ends, np.diff(np.r_[-1, self.ends])) - np.arange(len(self.text)) >= self.depth
        order = order[room[order]]
        flags = np.zeros(len(self.text), bool)
        if len(order) < 2:
            return flags
        a, b = order[:-1], order[1:]
        for offset in range(0, self.depth, 8):
            same = self._key(a, offset) == self._key(b, offset)
            a, b = a[same], b[same]
        flags[a] = flags[b] = True
        return flags
