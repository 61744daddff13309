"""Suffix automaton over words of several passages, with matching statistics.

The automaton of a shard of reference passages accepts every run of words that
occurs in one of them. Each state also holds the smallest owner of the passages
in which its runs end, so a match says whether a reference of a smaller owner
has it. Time and memory are linear in the words of the shard.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, follow: dict, link: int, length: int, owner) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.length) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A state for the runs of ``q`` that ``p`` and ``word`` lead to, when ``q`` also has longer ones."""
        follow, link, length = self.next, self.link, self.length
        copy = self._state(dict(follow[q]), link[q], length[p] + 1, self.owner[q])
        link[q] = copy
        while p >= 0 and follow[p].get(word) == q:
            follow[p][word] = copy
            p = link[p]
        return copy

    def add(self, words: Sequence, owner: int) -> None:
        """Add a passage. Owners are compared; ``settle`` must follow the last passage."""
        follow, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for word in words:
            q = follow[last].get(word)
            if q is not None:  # the run is known from an earlier passage
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                p, last = last, self._state({}, 0, length[last] + 1, None)
                while p >= 0 and word not in follow[p]:
                    follow[p][word] = last
                    p = link[p]
                if p >= 0:
                    q = follow[p][word]
                    link[last] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            if owners[last] is None or owner < owners[last]:
                owners[last] = owner

    def settle(self) -> None:
        """Carry the smallest owner of each state to the shorter runs that end there too."""
        length, link, owners = self.length, self.link, self.owner
        for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            p = link[v]
            if p > 0 and owners[v] is not None and (owners[p] is None or owners[v] < owners[p]):
                owners[p] = owners[v]

    def matches(self, words: Iterable, longest: int) -> Iterable[tuple[int, int]]:
        """The matching statistics: behind each word, the length (``longest`` at
        most) of the longest run ending there that the passages have, and its
        state, the one that holds exactly the runs of that length."""
        follow, link, length = self.next, self.link, self.length
        v = n = 0
        for word in words:
            while v and word not in follow[v]:
                v = link[v]
                n = length[v]
            if word in follow[v]:
                v = follow[v][word]
                n += 1
                if n > longest:
                    n = longest
                while length[link[v]] >= n and v:
                    v = link[v]
            yield n, v

    def owners_of_windows(self, words: Sequence, window: int) -> list:
        """For each run of ``window`` words, the smallest owner that has it (None: no passage has it)."""
        return [self.owner[v] if n >= window else None
                for k, (n, v) in enumerate(self.matches(words, window), 1) if k >= window]
