"""Packer signatures made ready for scanning: a trie with wildcard edges for known places, an automaton of fixed bytes for whole files."""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick

#: Bytes of a signature that the trie holds; the rest is compared. Bytes of a fixed run that the automaton looks for.
DEPTH, ANCHOR = 8, 32
#: Bytes of a file that are decoded at a time.
PIECE = 1 << 20
ANY, ENDS = -1, -2
PATTERN = re.compile(r"(?:[0-9A-Fa-f]{2}|\?\?)+")


def fixed_runs(pattern: str) -> list[tuple[int, bytes]]:
    """(offset, bytes) of the runs of fixed bytes of a pattern in hex, ?? for any byte."""
    return [(m.start() // 2, bytes.fromhex(m.group())) for m in re.finditer(r"(?:[0-9A-Fa-f]{2})+", pattern)]


class Signatures:
    """Patterns by their number, for places that are known (`starting`) or over whole files (`anywhere`).

    Patterns that are no sequence of whole bytes, or that fix none, match nothing.
    """

    def __init__(self, patterns: Iterable[str]) -> None:
        self.runs: list[list[tuple[int, bytes]]] = []
        self.sizes: list[int] = []
        for p in patterns:
            good = PATTERN.fullmatch(p or "") is not None
            self.runs.append(fixed_runs(p) if good else [])
            self.sizes.append(len(p) // 2 if good else 0)
        self._trie: dict | None = None
        self._automaton: ahocorasick.Automaton | None = None
        self._longest = 0

    def fits(self, i: int, data: bytes, at: int) -> bool:
        return at >= 0 and at + self.sizes[i] <= len(data) and all(data.startswith(run, at + off) for off, run in self.runs[i])

    def trie(self) -> dict:
        """Nodes by byte; ANY leads on whatever the byte is, ENDS names the patterns to compare in full."""
        if self._trie is None:
            self._trie = {}
            for i, runs in enumerate(self.runs):
                if not runs:
                    continue
                node = self._trie
                known = {off + k: b for off, run in runs if off < DEPTH for k, b in enumerate(run[:DEPTH])}
                for k in range(min(DEPTH, self.sizes[i])):
                    node = node.setdefault(known.get(k, ANY), {})
                node.setdefault(ENDS, []).append(i)
        return self._trie

    def starting(self, data: bytes, at: int) -> list[int]:
        """Patterns that match at this place."""
        found, nodes, k = [], [self.trie()], at
        while nodes:
            found += [i for n in nodes for i in n.get(ENDS, ()) if self.fits(i, data, at)]
            if k >= len(data):
                break
            nodes = [m for n in nodes for m in (n.get(data[k]), n.get(ANY)) if m is not None]
            k += 1
        return found

    def automaton(self) -> ahocorasick.Automaton:
        """Of the most varied run of each pattern; a hit names the patterns and how far before its end each would start."""
        if self._automaton is None:
            words: dict[str, list[tuple[int, int]]] = {}
            for i, runs in enumerate(self.runs):
                if runs:
                    off, run = max(((o, r[:ANCHOR]) for o, r in runs), key=lambda x: (len(set(x[1])), len(x[1])))
                    words.setdefault(run.decode("latin-1"), []).append((i, off + len(run) - 1))
            self._longest = max(map(len, words), default=0)
            self._automaton = ahocorasick.Automaton()
            for word, hits in words.items():
                self._automaton.add_word(word, hits)
            self._automaton.make_automaton()
        return self._automaton

    def anywhere(self, data: bytes) -> dict[int, int]:
        """Patterns that match somewhere, each with its first place. The file is read piece by piece, pieces overlap by the longest run."""
        found: dict[int, int] = {}
        automaton = self.automaton()
        if not len(automaton):
            return found
        for start in range(0, len(data), PIECE):
            text = data[start : start + PIECE + self._longest - 1].decode("latin-1")
            for end, hits in automaton.iter(text):
                for i, back in hits:
                    if i not in found and self.fits(i, data, start + end - back):
                        found[i] = start + end - back
        return found
