"""Levenshtein automata intersected with a trie of lexicon terms.

The automaton of a written word accepts the terms within ``k`` edits of it, where
an edit puts in, leaves out or changes a letter, or swaps two neighbours.  Its
states are sparse rows of (position, half, edits); ``half`` marks a swap of which
the first letter has been read.  Walking the trie and the automaton together
visits only prefixes that can still lead to a term.  A position of the word accepts
more than its own letter where the writer hid one: a mask (``*``) accepts any
letter, a digit or sign the letters it imitates, both without cost.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

#: Letters that a digit or sign imitates.
IMITATIONS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "ah", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "$": "s", "@": "a", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
}
#: Signs that stand for any one letter.
MASKS = "*#_-%•?"

State = tuple[tuple[int, int, int], ...]


class Trie:
    """Letters -> node; a node that ends a term holds the term under ``""``."""

    def __init__(self, terms: Iterable[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term


class LevenshteinAutomaton:
    """Accepts the words within ``k`` edits of ``word``; states are tuples of (position, half, edits)."""

    def __init__(self, word: str, k: int):
        self.n, self.k = len(word), k
        self.accepts = [None if c in MASKS else frozenset(IMITATIONS.get(c, "") + c) for c in word]

    def start(self) -> State:
        return tuple((i, 0, i) for i in range(min(self.n, self.k) + 1))

    def _fits(self, i: int, letter: str) -> bool:
        return self.accepts[i] is None or letter in self.accepts[i]

    def step(self, state: State, letter: str) -> State:
        best: dict[tuple[int, int], int] = {}
        n, k = self.n, self.k

        def offer(i: int, half: int, e: int) -> None:
            if e <= k and e < best.get((i, half), k + 1):
                best[i, half] = e

        for i, half, e in state:
            if half:  # position i + 1 was read first; now comes position i
                if self._fits(i, letter):
                    offer(i + 2, 0, e)
                continue
            if i < n and self._fits(i, letter):
                offer(i + 1, 0, e)
            if e < k:
                offer(i, 0, e + 1)
                if i < n:
                    offer(i + 1, 0, e + 1)
                if i + 1 < n and self._fits(i + 1, letter):
                    offer(i, 1, e + 1)
        for i, half in sorted(best):
            if half:
                continue
            e = best[i, 0]
            while i < n and e < k and e + 1 < best.get((i + 1, 0), k + 1):
                i, e = i + 1, e + 1
                best[i, 0] = e
        return tuple(sorted((i, h, e) for (i, h), e in best.items()))

    def edits(self, state: State) -> int | None:
        """Edits of a full match in this state, or None."""
        ends = [e + self.n - i for i, half, e in state if not half and e + self.n - i <= self.k]
        return min(ends) if ends else None


def terms_within(trie: Trie, word: str, k: int) -> list[tuple[int, str]]:
    """(edits, term) of all terms within ``k`` edits of ``word``, the nearest first."""
    automaton = LevenshteinAutomaton(word, k)
    found = []
    todo = [(trie.root, automaton.start())]
    while todo:
        node, state = todo.pop()
        for letter, child in node.items():
            if letter == "":
                e = automaton.edits(state)
                if e is not None:
                    found.append((e, child))
            elif after := automaton.step(state, letter):
                todo.append((child, after))
    return sorted(found)


def shortened(word: str, k: int) -> set[str]:
    """The word and everything that is left of it without one to ``k`` letters."""
    out = {word}
    for j in range(1, min(k, len(word)) + 1):
        for gone in combinations(range(len(word)), j):
            out.add("".join(c for i, c in enumerate(word) if i not in gone))
    return out


class Neighbourhood:
    """Says quickly that a word has no term within ``k`` edits, so that most words never meet the automaton.

    Two words within ``k`` edits (swaps included) share a form from which at most ``k`` letters are gone.
    """

    def __init__(self, terms: Iterable[str], k: int):
        self.k = k
        self.forms = {f for t in terms for f in shortened(t, k)}

    def may_hold(self, word: str) -> bool:
        return not self.forms.isdisjoint(shortened(word, self.k))
