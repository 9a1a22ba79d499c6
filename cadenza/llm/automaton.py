"""Minimal acyclic automata with perfect-hash word numbers, and search in them with one error."""

from __future__ import annotations

from collections.abc import Iterator


class Automaton:
    """The minimal automaton of words that come sorted, without repeats. A word's number is its place among them, from 0.

    Built by adding words in order and merging equal states behind them (Daciuk, Mihov, Watson and Watson, "Incremental Construction of Minimal
    Acyclic Finite-State Automata", 2000). An arc carries how many words come before those that go on over it, so that the sum along a path
    is the word's number (Lucchesi and Kowaltowski, 1993).
    """

    def __init__(self, words: list[str]):
        known: dict[tuple, int] = {}  # a finished state by what it accepts
        self.arcs: list[dict[str, tuple[int, int]]] = []  # of each state: character -> (state, words before)
        self.final: list[bool] = []
        size: list[int] = []  # words that each state accepts

        def finish(final: bool, arcs: list[tuple[str, int]]) -> int:
            key = (final, *arcs)
            state = known.get(key)
            if state is None:
                state, before, numbered = len(self.arcs), int(final), {}
                for character, target in arcs:
                    numbered[character] = (target, before)
                    before += size[target]
                known[key] = state
                self.arcs.append(numbered)
                self.final.append(final)
                size.append(before)
            return state

        path: list[list] = [[False, [], ""]]  # of each open state: accepts, finished arcs, character that leads to it
        last = ""
        for word in words:
            common = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                common += 1
            while len(path) > common + 1:
                final, arcs, character = path.pop()
                path[-1][1].append((character, finish(final, arcs)))
            path += [[False, [], c] for c in word[common:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            final, arcs, character = path.pop()
            path[-1][1].append((character, finish(final, arcs)))
        self.start = finish(path[0][0], path[0][1])

    def walk(self, text: str, state: int | None = None, number: int = 0) -> tuple[int, int] | None:
        """(state, number so far) after a text, or None."""
        state = self.start if state is None else state
        for character in text:
            arc = self.arcs[state].get(character)
            if arc is None:
                return None
            state, number = arc[0], number + arc[1]
        return state, number

    def _rest(self, state: int, number: int, text: str, begin: int) -> int:
        """The number of the word that goes on with text[begin:] and ends there, or -1."""
        arcs = self.arcs
        for k in range(begin, len(text)):
            arc = arcs[state].get(text[k])
            if arc is None:
                return -1
            state, number = arc[0], number + arc[1]
        return number if self.final[state] else -1

    def one_error(self, word: str, exact: int) -> Iterator[int]:
        """Numbers of the words that begin with the first ``exact`` characters of ``word`` and differ from it by one inserted, deleted or replaced
        character after those. A number may come more than once.
        """
        at = self.walk(word[:exact])
        for k in range(exact, len(word) + 1):
            if at is None:
                return
            state, number = at
            following = word[k] if k < len(word) else None
            for character, (target, before) in self.arcs[state].items():
                found = self._rest(target, number + before, word, k)  # the character is inserted
                if found >= 0:
                    yield found
                if following is not None and character != following:
                    found = self._rest(target, number + before, word, k + 1)  # it stands in place of the word's
                    if found >= 0:
                        yield found
            if following is None:
                return
            found = self._rest(state, number, word, k + 1)  # the word's character is deleted
            if found >= 0:
                yield found
            at = self.walk(following, state, number)
