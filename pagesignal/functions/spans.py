"""Places in a text: lines by bisection, sentences with their offsets, phrases by an Aho-Corasick automaton."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick

_END = re.compile(r"[.!?]")


class Lines:
    """Where the lines of a text begin, found once and searched by bisection."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def place(self, at: int) -> tuple[int, int]:
        """The line of an offset, from 1, and the offset in it, from 0; offsets below 0 count as 0."""
        at = max(at, 0)
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1]

    def span(self, start: int, end: int) -> tuple[int, int, int]:
        """Line, start and end of a span; both offsets are those from the start of the first line."""
        line, begin = self.place(start)
        return line, begin, begin + max(0, end - max(start, 0))


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each run up to and with ``.``, ``!`` or ``?``; end marks alone, and what follows the last, are none."""
    begin = 0
    for m in _END.finditer(text):
        if m.start() > begin:
            yield begin, m.end()
        begin = m.end()


def near_any(flags: list[bool], window: int) -> list[bool]:
    """Whether a flag within ``window`` places of each place is set."""
    sums = [0, *accumulate(flags)]
    n = len(flags)
    return [sums[min(n, i + window + 1)] > sums[max(0, i - window)] for i in range(n)]


def automaton(phrases: Iterable[str]) -> ahocorasick.Automaton:
    """Finds all phrases without regard to case; a hit's value is the phrase's length and the numbers of the phrases. Empty ones are left out."""
    numbers: dict[str, list[int]] = {}
    for i, phrase in enumerate(phrases):
        if phrase:
            numbers.setdefault(phrase.lower(), []).append(i)
    found = ahocorasick.Automaton()
    for phrase, own in numbers.items():
        found.add_word(phrase, (len(phrase), own))
    if numbers:
        found.make_automaton()
    return found


def hits(found: ahocorasick.Automaton, low: str) -> Iterator[tuple[int, int, int]]:
    """Begin, end and phrase number of every hit in a lower-cased text, overlapping ones too."""
    if len(found):
        for last, (size, numbers) in found.iter(low):
            for i in numbers:
                yield last + 1 - size, last + 1, i
