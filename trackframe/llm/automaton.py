"""Levenshtein automata intersected with a lexicon trie, compiled to one table.

A state of the intersection is a set of (trie node, edits so far). Sets are made
deterministic once; running words through the table then needs one lookup a letter, for
many words at a time. Entries are of three kinds: `fuzzy` terms may be one edit off (insertion,
deletion or substitution), `exact` terms must match, `stem` entries match every word that
starts with them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

DEAD = 0
#: what a word turned out to be
NONE, EXACT, NEAR, STEM = 0, 1, 2, 3


@dataclass
class Automaton:
    table: np.ndarray  # state x letter -> state
    accept: np.ndarray  # state -> kind
    letters: dict[str, int]
    start: int

    def letter_codes(self) -> np.ndarray:
        """Code point to letter number; 0 for letters that no entry holds."""
        out = np.zeros(0x110000, np.int32)
        for ch, i in self.letters.items():
            out[ord(ch)] = i
        return out

    def kinds(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kind of each word, all words one letter further in each round until all are dead or done."""
        out = np.zeros(len(starts), np.int8)
        alive = np.arange(len(starts))
        state = np.full(len(starts), self.start, np.int32)
        step = 0
        while len(alive):
            done = starts[alive] + step >= ends[alive]
            out[alive[done]] = self.accept[state[done]]
            alive, state = alive[~done], state[~done]
            state = self.table[state, codes[starts[alive] + step]]
            stem = self.accept[state] == STEM
            out[alive[stem]] = STEM
            go = (state != DEAD) & ~stem
            alive, state = alive[go], state[go]
            step += 1
        return out


def build(fuzzy: Iterable[str], exact: Iterable[str] = (), stems: Iterable[str] = ()) -> Automaton:
    children: list[dict[str, int]] = [{}, {}]  # node 0: root of fuzzy terms, node 1: root of the others
    final: dict[int, int] = {}

    def add(word: str, node: int, kind: int) -> None:
        for ch in word:
            if ch not in children[node]:
                children.append({})
                children[node][ch] = len(children) - 1
            node = children[node][ch]
        final[node] = max(final.get(node, 0), kind)

    for w in fuzzy:
        add(w, 0, EXACT)
    for w in exact:
        add(w, 1, EXACT)
    for w in stems:
        add(w, 1, STEM)

    def closed(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With letters of an entry that a word leaves out; a node with fewer edits covers the one with more."""
        least: dict[int, int] = {}
        for n, e in items:
            least[n] = min(e, least.get(n, 2))
        for n, e in list(least.items()):
            if e == 0:
                for c in children[n].values():
                    least[c] = min(1, least.get(c, 2))
        return frozenset(least.items())

    def kind(state: frozenset[tuple[int, int]]) -> int:
        best = NONE
        for n, e in state:
            if n in final:
                k = final[n]
                if k == STEM:
                    return STEM
                own = EXACT if e == 0 or n in plain else NEAR
                best = own if best == NONE or own == EXACT else best
        return best

    plain: set[int] = set()  # nodes below the exact root
    stack = [1]
    while stack:
        n = stack.pop()
        plain.add(n)
        stack.extend(children[n].values())

    first = closed({(0, 0), (1, 1)})
    letters = {ch: i + 1 for i, ch in enumerate(sorted({ch for c in children for ch in c}))}
    number, todo = {frozenset(): DEAD, first: 1}, [first]
    rows: dict[int, np.ndarray] = {DEAD: np.zeros(len(letters) + 1, np.int32)}
    accept = {DEAD: NONE, 1: kind(first)}
    for state in todo:
        default: set[tuple[int, int]] = set()
        named: set[str] = set()
        for n, e in state:
            named.update(children[n])
            if e == 0:
                default.add((n, 1))
                default.update((c, 1) for c in children[n].values())

        def enter(items: set[tuple[int, int]]) -> int:
            s = closed(items)
            if s not in number:
                number[s] = len(number)
                accept[number[s]] = kind(s)
                todo.append(s)
            return number[s]

        row = np.full(len(letters) + 1, enter(default), np.int32)
        for ch in named:
            row[letters[ch]] = enter(default | {(children[n][ch], e) for n, e in state if ch in children[n]})
        rows[number[state]] = row
    return Automaton(np.stack([rows[i] for i in range(len(number))]), np.array([accept[i] for i in range(len(number))], np.int8), letters, 1)
