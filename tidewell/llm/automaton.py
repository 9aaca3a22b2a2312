"""A generalized suffix automaton over sequences, and matching statistics against it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """States carry the label of the sequence that first held their strings, if sequences come in the order of their labels."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def add(self, seq: Sequence, label: int = 0) -> None:
        """Add all substrings of seq."""
        for _ in self.stream(seq, label, len(seq) + 1):
            pass

    def stream(self, seq: Sequence, label: int, least: int) -> Iterator[int]:
        """Stream seq and add it where it leaves known text. Gives, for each run of least items, the label that held it first, or seq's own."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for i, x in enumerate(seq, 1):
            q = nxt[last].get(x)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, x)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                first.append(label)
                p = last
                while p >= 0 and x not in nxt[p]:
                    nxt[p][x] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][x]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, x)
                last = cur
            if i >= least:
                v = last
                while length[link[v]] >= least:
                    v = link[v]
                yield first[v]

    def _split(self, p: int, q: int, x) -> int:
        """The state of p's longest string extended by x, apart from q, which also holds longer ones."""
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(x) == q:
            nxt[p][x] = copy
            p = link[p]
        return copy

    def matching_statistics(self, seq: Sequence[int]) -> Iterator[int]:
        """For each position of seq, the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for x in seq:
            while v and x not in nxt[v]:
                v = link[v]
                n = length[v]
            if x in nxt[v]:
                v = nxt[v][x]
                n += 1
            yield n

    def long_spans(self, seq: Sequence[int], least: int) -> list[tuple[int, int]]:
        """Maximal spans [a, b) of seq covered by matches of at least this length."""
        out: list[tuple[int, int]] = []
        for i, n in enumerate(self.matching_statistics(seq)):
            if n >= least:
                if out and i + 1 - n <= out[-1][1]:
                    out[-1] = (min(out[-1][0], i + 1 - n), i + 1)
                else:
                    out.append((i + 1 - n, i + 1))
        return out
