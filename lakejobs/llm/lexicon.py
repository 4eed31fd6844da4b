"""A minimal acyclic automaton over words whose n-th word has the n-th id sequence.

States with equal futures are shared, so common suffixes are stored once. The place of a word among
all words is the sum of what its arcs skip, and addresses its ids. The automaton is one block of bytes
that can be memory-mapped: a table of arcs sorted by (state, byte), then the ids.
"""

from __future__ import annotations

import mmap
import tempfile
from bisect import bisect_left

import numpy as np

_FINAL = 256  # label of the arc that ends a word; it sorts last


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton of ``entries`` (word -> ids) as bytes; the empty word is not allowed."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # per state: ((label, target), ...)
    path: list[list[list]] = [[]]  # unfinished states along the last word; arcs are [label, target]
    previous = b""

    def close(depth: int) -> None:
        """Finish the states below ``depth``: find an equal one or keep it."""
        while len(path) > depth + 1:
            state = tuple((label, target) for label, target in path.pop())
            number = register.get(state)
            if number is None:
                number = register[state] = len(arcs)
                arcs.append(state)
            path[-1][-1][1] = number

    end = -1
    for word in words:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        close(shared)
        for byte in word[shared:]:
            path[-1].append([byte, None])
            path.append([])
        path[-1].append([_FINAL, end])
        previous = word
        # A word that continues this one adds arcs after the final one; order within a state is by label.
    close(0)
    arcs.append(tuple((label, target) for label, target in path[0]))
    root = len(arcs) - 1

    arcs = [tuple(sorted(state)) for state in arcs]
    below: list[int] = []  # words reachable from each state; targets come before their sources
    keys, targets, skips = [], [], []
    for number, state in enumerate(arcs):
        count = 0
        for label, target in state:
            keys.append(number << 9 | label)
            targets.append(max(target, 0))
            skips.append(count)
            count += 1 if label == _FINAL else below[target]
        below.append(count)

    # Place of each word, to lay out its ids.
    first = np.searchsorted(np.array(keys, np.int64), np.arange(len(arcs) + 1, dtype=np.int64) << 9).tolist()
    ordered: list = [None] * len(words)
    for word in words:
        state, place = root, 0
        for label in (*word, _FINAL):
            i = bisect_left(keys, state << 9 | label, first[state], first[state + 1])
            place += skips[i]
            state = targets[i]
        ordered[place] = entries[word]
    offsets = np.cumsum([0, *map(len, ordered)], dtype=np.uint32)
    flat = np.array([i for ids in ordered for i in ids], np.uint32)
    parts = [
        np.array([len(arcs), len(keys), len(words), len(flat), root], np.uint64).view(np.uint8),
        np.array(keys, np.uint64).view(np.uint8), np.array(first, np.uint32).view(np.uint8),
        np.array(targets, np.uint32).view(np.uint8), np.array(skips, np.uint32).view(np.uint8),
        offsets.view(np.uint8), flat.view(np.uint8),
    ]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Look-up in a block of :func:`compile_lexicon`, which may be a memory map."""

    def __init__(self, block):
        view = memoryview(block)
        states, arcs, words, ids, root = (int(x) for x in np.frombuffer(view[:40], np.uint64))
        at = 40

        def take(count: int, size: int, kind: str) -> memoryview:
            nonlocal at
            part = view[at : at + count * size].cast(kind)
            at += count * size
            return part

        self.root, self.words, self.states = root, words, states
        self.keys = take(arcs, 8, "Q")
        self.first = take(states + 1, 4, "I")
        self.targets = take(arcs, 4, "I")
        self.skips = take(arcs, 4, "I")
        self.offsets = take(words + 1, 4, "I")
        self.ids = view[at : at + 4 * ids]

    @classmethod
    def mapped(cls, block: bytes) -> "Lexicon":
        """Memory-map ``block`` from an unnamed file of this process, shared by the page cache."""
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> bytes | None:
        """The ids of ``word`` as little-endian 32-bit integers, or None."""
        keys, first, targets, skips = self.keys, self.first, self.targets, self.skips
        state, place = self.root, 0
        for label in word:
            key = state << 9 | label
            stop = first[state + 1]
            i = bisect_left(keys, key, first[state], stop)
            if i == stop or keys[i] != key:
                return None
            place += skips[i]
            state = targets[i]
        key = state << 9 | _FINAL
        stop = first[state + 1]
        i = bisect_left(keys, key, first[state], stop)
        if i == stop or keys[i] != key:
            return None
        place += skips[i]
        return bytes(self.ids[4 * self.offsets[place] : 4 * self.offsets[place + 1]])

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """:meth:`get` of many words, whose letters are followed side by side."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.keys):
            return out
        keys, targets, skips = np.frombuffer(self.keys, np.uint64).view(np.int64), np.frombuffer(self.targets, np.uint32), np.frombuffer(self.skips, np.uint32)
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words) or b"\0", np.uint8).astype(np.int64)
        starts, row, letter = np.cumsum(sizes) - sizes, np.arange(len(words)), 0
        state, place = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        while len(row):
            going = sizes > letter
            label = np.where(going, data[np.minimum(starts + letter, len(data) - 1)], _FINAL)
            wanted = state << 9 | label
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            known = keys[at] == wanted
            place = place + skips[at]
            for i, n in zip(row[known & ~going].tolist(), place[known & ~going].tolist()):
                out[i] = bytes(self.ids[4 * self.offsets[n] : 4 * self.offsets[n + 1]])
            on = known & going
            sizes, starts, row, place, state = sizes[on], starts[on], row[on], place[on], targets[at[on]].astype(np.int64)
            letter += 1
        return out
