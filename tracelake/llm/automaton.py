"""Suffix automata over any sequence of hashable symbols, one or several sequences to an automaton."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """States have transitions, a suffix link and a longest length; ``weight`` counts what ends in them."""

    def __init__(self) -> None:
        self.following: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]

    def _clone(self, state: int, length: int) -> int:
        self.following.append(self.following[state].copy())
        self.link.append(self.link[state])
        self.length.append(length)
        self.weight.append(0)
        return len(self.link) - 1

    def _redirect(self, state: int, symbol: Hashable, old: int, new: int) -> None:
        following, link = self.following, self.link
        while state != -1 and following[state].get(symbol) == old:
            following[state][symbol] = new
            state = link[state]

    def _extend(self, last: int, symbol: Hashable) -> int:
        following, link, length = self.following, self.link, self.length
        if (to := following[last].get(symbol)) is not None:  # another sequence has been here
            if length[to] == length[last] + 1:
                return to
            clone = self._clone(to, length[last] + 1)
            link[to] = clone
            self._redirect(last, symbol, to, clone)
            return clone
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.weight.append(0)
        state, at = len(link) - 1, last
        while at != -1 and symbol not in following[at]:
            following[at][symbol] = state
            at = link[at]
        if at != -1:
            to = following[at][symbol]
            if length[to] == length[at] + 1:
                link[state] = to
            else:
                clone = self._clone(to, length[at] + 1)
                link[to] = link[state] = clone
                self._redirect(at, symbol, to, clone)
        return state

    def add(self, sequence: Sequence[Hashable], weight: int = 0, ends_from: int = 0) -> None:
        """weight is added where the sequence's prefixes of at least ends_from symbols end."""
        last, extend, weights = 0, self._extend, self.weight
        for i, symbol in enumerate(sequence, 1):
            last = extend(last, symbol)
            if i >= ends_from:
                weights[last] += weight

    def counted(self) -> list[int]:
        """For each state, the weight of all places where its strings end."""
        total, link = self.weight[:], self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            total[link[state]] += total[state]
        return total

    def states(self, sequence: Sequence[Hashable], least: int):
        """Matching statistics: after each symbol, the longest match's length and, if it is at least ``least``, the
        state that holds the match's last ``least`` symbols, else -1."""
        following, link, length = self.following, self.link, self.length
        state = matched = 0
        for symbol in sequence:
            while state and symbol not in following[state]:
                state = link[state]
                matched = length[state]
            if (to := following[state].get(symbol)) is not None:
                state, matched = to, matched + 1
            at = state
            if matched >= least:
                while length[link[at]] >= least:
                    at = link[at]
                yield matched, at
            else:
                yield matched, -1
