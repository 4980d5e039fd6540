"""Distances between words, and words kept in a trie that an automaton walks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator


def edits(a: str, b: str, most: int) -> int:
    """Edits between two words (insert, delete, replace, swap neighbours), or ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if last and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, last[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
    return row[-1]


class Trie:
    """Words in a trie; the key ``""`` of a node is the word that ends there."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w

    def near(self, word: str, most: int) -> Iterator[str]:
        """All words within ``most`` insertions, deletions and replacements, by a bit-parallel Levenshtein automaton."""
        at: dict[str, int] = defaultdict(int)
        for i, ch in enumerate(word):
            at[ch] |= 1 << i
        end = 1 << len(word)
        full = (end << 1) - 1
        start, r = [], 1
        for _ in range(most + 1):
            start.append(r & full)
            r |= r << 1
        stack = [(self.root, start)]
        while stack:
            node, rows = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if any(r & end for r in rows):
                        yield child
                    continue
                hit = at[ch] if ch in at else 0
                new = [(rows[0] & hit) << 1]
                for j in range(1, most + 1):
                    new.append(((rows[j] & hit) << 1 | rows[j - 1] | rows[j - 1] << 1 | new[j - 1] << 1) & full)
                if new[most]:
                    stack.append((child, new))

    def begun(self, word: str, most: int) -> Iterator[tuple[str, int]]:
        """``(w, n)`` of all words that are, or begin with, a string ``n <= most`` edits (swaps included) from ``word``, ``n`` being the least.

        The rows of the distance table go down the trie; a branch ends where its whole
        row is over ``most``, except below a beginning already found.
        """
        n = len(word)
        stack = [(self.root, list(range(n + 1)), None, "", most + 1)]
        while stack:
            node, row, last, before, best = stack.pop()
            best = min(best, row[n])
            for ch, child in node.items():
                if ch == "":
                    if best <= most:
                        yield child, best
                    continue
                new = [row[0] + 1]
                for j, y in enumerate(word, 1):
                    v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (ch != y))
                    if last and j > 1 and before == y and ch == word[j - 2]:
                        v = min(v, last[j - 2] + 1)
                    new.append(v)
                if best <= most or min(new) <= most:
                    stack.append((child, new, row, ch, best))
