"""A minimal acyclic transducer from words to rows of token ids, in flat arrays that are memory-mapped.

States with the same future are one state (shared suffixes).  Every transition
carries an integer; the sum along a word's path is the word's rank among the sorted
words, and the rank leads to the word's ids.  ``lookup`` follows all asked words
at once, one byte position after the other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def compile_lexicon(words: dict[bytes, Sequence[int]]) -> bytes:
    """The transducer of ``words`` as bytes.  An empty mapping gives an empty lexicon."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, words below, ((byte, state), ...))

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append((node[0], node[0] + sum(states[s][1] for _, s in node[1]), key[1]))
        return register[key]

    order = sorted(words)
    path: list[list] = [[0, []]]
    before = b""
    for w in order:
        same = 0
        while same < min(len(w), len(before)) and w[same] == before[same]:
            same += 1
        for at in range(len(before), same, -1):
            path[at - 1][1].append((before[at - 1], freeze(path.pop())))
        path += [[0, []] for _ in w[same:]]
        path[-1][0] = 1
        before = w
    for at in range(len(before), 0, -1):
        path[at - 1][1].append((before[at - 1], freeze(path.pop())))
    root = freeze(path[0])
    keys, to, plus = [], [], []
    for s, (final, _, edges) in enumerate(states):
        skipped = final
        for byte, target in edges:
            keys.append(s << 8 | byte)
            to.append(target)
            plus.append(skipped)
            skipped += states[target][1]
    ids = [words[w] for w in order]
    starts = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    parts = [
        np.asarray(keys, np.int64),
        np.asarray(to, np.int32),
        np.asarray(plus, np.int32),
        np.asarray([s[0] for s in states], np.int8),
        starts,
        np.asarray([i for x in ids for i in x], np.int32),
    ]
    head = np.asarray([root, max(map(len, order), default=0), *map(len, parts)], np.int64)
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Reads a compiled lexicon from a file without loading it."""

    def __init__(self, path: str):
        head = np.fromfile(path, np.int64, 8)
        self.root, self.longest = int(head[0]), int(head[1])
        at, parts = 64, []
        for kind, n in zip((np.int64, np.int32, np.int32, np.int8, np.int32, np.int32), head[2:].tolist()):
            parts.append(np.memmap(path, kind, "r", at, (n,)) if n else np.empty(0, kind))
            at += n * np.dtype(kind).itemsize
        self.keys, self.to, self.plus, self.final, self.starts, self.ids = parts

    def lookup(self, words: Sequence[bytes]) -> list[bytes | None]:
        """The ids of each word as int32 bytes; None for a word that is not in the lexicon."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.keys) or not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((sizes > 0) & (sizes <= self.longest))
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        state = np.full(len(live), self.root, np.int64)
        rank = np.zeros(len(live), np.int64)
        for at in range(self.longest):
            go = state << 8 | text[begin[live] + at]
            where = np.minimum(np.searchsorted(self.keys, go), len(self.keys) - 1)
            ok = self.keys[where] == go
            live, where = live[ok], where[ok]
            state, rank = self.to[where].astype(np.int64), rank[ok] + self.plus[where]
            done = sizes[live] == at + 1
            for i, r in zip(live[done & (self.final[state] == 1)].tolist(), rank[done & (self.final[state] == 1)].tolist()):
                out[i] = self.ids[self.starts[r] : self.starts[r + 1]].tobytes()
            live, state, rank = live[~done], state[~done], rank[~done]
            if not len(live):
                break
        return out
