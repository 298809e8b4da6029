"""Suffix sorting inside a task: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

#: Bytes that the quicksort looks at, in characters of eight; the tries order what still agrees.
SHALLOW = 16


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number that orders like them; ``data`` has eight spare bytes at its end."""
    view = np.ndarray((len(data) - 7,), ">u8", data.data, 0, (1,))
    return view[at].astype(np.uint64)


def multikey(data: np.ndarray, at: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first ``depth`` bytes, and the first of each group that agrees in them.

    All groups that agree so far are sorted by their next character at once; those of one suffix are left alone.
    """
    order = np.argsort(_word(data, at), kind="quicksort")
    word = _word(data, at[order])
    new = np.ones(len(at), bool)
    new[1:] = word[1:] != word[:-1]
    for d in range(8, depth, 8):
        group = np.cumsum(new) - 1
        inner = ~new
        inner[:-1] |= ~new[1:]  # in a group of two or more
        where = np.flatnonzero(inner)
        if not len(where):
            break
        own, word = order[where], _word(data, at[order[where]] + d)
        by = np.lexsort((word, group[where]))
        order[where], word, same = own[by], word[by], group[where][by]
        changed = np.ones(len(where), bool)
        changed[1:] = (word[1:] != word[:-1]) | (same[1:] != same[:-1])
        new[where] = changed
    return order, np.flatnonzero(new)


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of 64-bit numbers that aren't zero."""
    high = (x >> np.uint64(32)).astype(np.uint32)
    half = np.where(high > 0, high, (x & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    return np.where(high > 0, 32, 64) - np.frexp(half.astype(np.float64))[1]


class BlindTries:
    """A blind trie for each group of suffixes, all grown together: round j inserts the j-th suffix of every group.

    An inner node holds only the first bit in which its two sides differ, so the way down compares single bits; the leaf it
    ends in is then compared in full, and the new node is hung in where its bit belongs. Suffixes that agree up to the last
    byte share a leaf.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray):
        """``words``: a row per suffix, its bytes as big-endian numbers; ``first``: where each group begins (one more)."""
        self.words, self.leaf = words, np.arange(len(words))
        self.bit = np.zeros(len(words), np.int64)  # of inner node i, made for suffix i
        self.child = np.zeros((2, len(words)), np.int64)  # inner nodes as they are, leaf i as ~i
        sizes = np.diff(first)
        self.root = ~first[:-1]
        by_size = np.argsort(-sizes, kind="stable")
        for j in range(1, int(sizes.max(initial=0))):
            live = by_size[: np.searchsorted(-sizes[by_size], -j)]
            self._insert(live, first[live] + j)

    def _bits(self, suffix: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return ((self.words[suffix, bit >> 6] >> (63 - (bit & 63)).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    def _insert(self, group: np.ndarray, suffix: np.ndarray) -> None:
        at = self.root[group].copy()
        down = np.flatnonzero(at >= 0)
        while len(down):
            node = at[down]
            at[down] = self.child[self._bits(suffix[down], self.bit[node]), node]
            down = down[at[down] >= 0]
        other = ~at
        apart = self.words[suffix] ^ self.words[other]
        differ = apart != 0
        new = differ.any(1)
        self.leaf[suffix[~new]] = other[~new]
        if not new.any():
            return
        group, suffix, apart, differ = group[new], suffix[new], apart[new], differ[new]
        word = differ.argmax(1)
        bit = 64 * word + _leading(apart[np.arange(len(word)), word])
        at, above, side = self.root[group].copy(), np.full(len(group), -1), np.zeros(len(group), np.int64)
        down = np.flatnonzero(at >= 0)
        down = down[self.bit[at[down]] < bit[down]]
        while len(down):
            node = at[down]
            above[down], side[down] = node, self._bits(suffix[down], self.bit[node])
            at[down] = self.child[side[down], node]
            down = down[at[down] >= 0]
            down = down[self.bit[at[down]] < bit[down]]
        mine = self._bits(suffix, bit)
        self.bit[suffix] = bit
        self.child[mine, suffix] = ~suffix
        self.child[1 - mine, suffix] = at
        top = above < 0
        self.root[group[top]] = suffix[top]
        self.child[side[~top], above[~top]] = suffix[~top]

    def ordered(self, group: int) -> list[int]:
        """The leaves of a group from left to right."""
        found, stack = [], [int(self.root[group])]
        while stack:
            at = stack.pop()
            if at < 0:
                found.append(~at)
            else:
                stack += [int(self.child[1, at]), int(self.child[0, at])]
        return found


def classes(data: np.ndarray, at: np.ndarray, length: int, depth: int = SHALLOW) -> np.ndarray:
    """A number for each suffix in ``at``, the same for those that agree in their first ``length`` bytes.

    ``data`` has at least ``length`` bytes behind each place and eight more at its end. Bytes from ``length`` on are not
    compared.
    """
    found = np.arange(len(at))
    if len(at) < 2:
        return found
    depth = min(depth, length - length % 8)
    order, first = multikey(data, at, depth)
    sizes = np.diff(np.append(first, len(at)))
    many = sizes > 1
    member = np.repeat(many, sizes)
    deep = order[member]
    if not len(deep):
        return found
    starts = np.concatenate([[0], np.cumsum(sizes[many])])
    rest = range(depth, length, 8)
    if not len(rest):
        found[deep] = np.repeat(deep[starts[:-1]], np.diff(starts))
        return found
    words = np.column_stack([_word(data, at[deep] + d) for d in rest])
    spare = 8 * (rest[-1] + 8 - length)
    words[:, -1] = words[:, -1] >> np.uint64(spare) << np.uint64(spare)
    found[deep] = deep[BlindTries(words, starts).leaf]
    return found
