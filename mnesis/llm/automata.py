"""Grammar inference: probabilistic automata from example strings, by merging compatible states of their prefix tree."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np


class Automaton:
    """A deterministic probabilistic automaton. A string's probability is that of its symbols and of its end; what no example showed has a small one."""

    def __init__(self, moves: list[dict[str, tuple[int, int]]], ends: list[int], symbols: int):
        self.symbols = symbols
        self.moves = [{x: (to, self._log(n, sum(c for _, c in m.values()) + e)) for x, (to, n) in m.items()} for m, e in zip(moves, ends, strict=True)]
        self.ends = [self._log(e, sum(c for _, c in m.values()) + e) for m, e in zip(moves, ends, strict=True)]
        self.rare = [self._log(0, sum(c for _, c in m.values()) + e) for m, e in zip(moves, ends, strict=True)]

    def _log(self, n: int, total: int) -> float:
        return math.log((n + 0.1) / (total + 0.1 * (self.symbols + 1)))

    def score(self, text: str) -> float:
        """Log likelihood for each symbol, the end counting as one."""
        at, total = 0, 0.0
        for x in text:
            to, p = self.moves[at].get(x, (0, self.rare[at]))
            at, total = to, total + p
        return (total + self.ends[at]) / (len(text) + 1)


class Scorer:
    """An automaton as tables over numbered symbols, for many strings at once."""

    def __init__(self, automaton: Automaton, alphabet: str):
        self.automaton, self.alphabet = automaton, alphabet
        n, number = len(automaton.moves), {x: k for k, x in enumerate(alphabet)}
        self.to = np.zeros((n, len(alphabet)), np.int32)
        self.log = np.repeat(np.array(automaton.rare)[:, None], len(alphabet), 1)
        self.ends = np.array(automaton.ends)
        for q, moves in enumerate(automaton.moves):
            for x, (to, p) in moves.items():
                self.to[q, number[x]], self.log[q, number[x]] = to, p

    def scores(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 256) -> np.ndarray:
        """Automaton.score() of each string symbols[start:end]: all strings one symbol further in each step; those of over `most` symbols one by one."""
        size = end - start
        out = np.empty(len(start))
        for i in np.flatnonzero(size > most).tolist():
            out[i] = self.automaton.score("".join(map(self.alphabet.__getitem__, symbols[start[i] : end[i]].tolist())))
        order = np.flatnonzero(size <= most)
        order = order[np.argsort(-size[order], kind="stable")]
        begin, length = start[order], size[order]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order))
        for t in range(int(length[0]) if len(order) else 0):
            n = int(np.searchsorted(-length, -t, "left"))  # strings of over t symbols come first
            x = symbols[begin[:n] + t]
            total[:n] += self.log[state[:n], x]
            state[:n] = self.to[state[:n], x]
        out[order] = (total + self.ends[state]) / (length + 1)
        return out


def learn(examples: Iterable[str], symbols: int, alpha: float = 0.05) -> Automaton:
    """Merge the states of the examples' prefix tree that Hoeffding's bound can't tell apart (confidence alpha), from the root on, breadth first."""
    moves: list[dict[str, int]] = [{}]
    passed: list[Counter] = [Counter()]
    ends = [0]
    for text, n in sorted(Counter(examples).items()):
        at = 0
        for x in text:
            passed[at][x] += n
            if x not in moves[at]:
                moves[at][x] = len(moves)
                moves.append({})
                passed.append(Counter())
                ends.append(0)
            at = moves[at][x]
        ends[at] += n
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    size = lambda q: passed[q].total() + ends[q]

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = size(p), size(q)
            if not n or not m:
                continue
            if differ(ends[p], n, ends[q], m) or any(differ(passed[p][x], n, passed[q][x], m) for x in passed[p].keys() | passed[q].keys()):
                return False
            stack += [(moves[p][x], moves[q][x]) for x in moves[p].keys() & moves[q].keys()]
        return True

    def fold(p: int, q: int) -> None:
        """Add the tree at q to state p."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            ends[p] += ends[q]
            passed[p].update(passed[q])
            for x, to in moves[q].items():
                if x in moves[p]:
                    stack.append((moves[p][x], to))
                else:
                    moves[p][x] = to

    red = [0]
    while True:
        blue = sorted({(to, p, x) for p in red for x, to in moves[p].items() if to not in red})
        if not blue:
            break
        q, p, x = blue[0]
        for r in red:
            if compatible(r, q):
                moves[p][x] = r
                fold(r, q)
                break
        else:
            red.append(q)
    number = {q: k for k, q in enumerate(red)}
    return Automaton([{x: (number[to], passed[q][x]) for x, to in moves[q].items()} for q in red], [ends[q] for q in red], symbols)
