"""Quality rules, line first.

Counts over the whole text: words, characters in words, symbols, lines that repeat an
earlier one, words in eight-word windows that occur more than once.

Line rules, by kind:
- navigation: parts set off by bars; short parts set off by wide gaps; one of many short lines in a row that end
  no sentence, hold no digit or list mark and follow no colon; a short line that ends in an arrow;
- punctuation: thick with punctuation, words thick with symbols, shouting (words that end in several marks);
- boilerplate: a line that stands in the text over and over; a short notice of rights (a sign or word and a year); a
  line of nothing but addresses; a short line with a known opening (English, German, French, Spanish);
- repetition: one word over and over, a copy of an earlier line.
A long line loses just the short sentences of boilerplate that it opens with. Lines that pass make the cleaned
text. A document is kept unless the count rules reject it or more than half of its words stood on failed
lines. One pass over a text gives its counts, verdict and cleaned text, all with the same words.

Nulls and edges: a null text has no words, so it is not kept; nor is one of fewer than 20. The empty line never fails.
Repeated rows are judged alike, nothing depends on ties or order; an empty table gives an empty result. ``judge`` reads
``doc_id`` and ``text`` alone; ``clean`` keeps all columns, whatever their names. Time is linear in the text but for sorting
its windows; a text of tens of millions of characters is held as its list of words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, small, texts_of, with_columns

_SYMBOL = re.compile(r"[#*$%&|<>]")
_WINDOW = 8
# Openings of lines that many pages share and that are no prose.
_OPENINGS = (
    r"share (?:this|on)\b|click here\b|read more\b|sign (?:in|up)\b|log in\b|subscribe (?:to|now)\b|all rights reserved\b|copyright ©|© ?\d{4}|terms of (?:use|service)\b|privacy policy\b|cookie (?:policy|settings)\b|we use cookies\b|skip to (?:main )?content\b|back to top\b|home\s*[>»|/]"
    r"|alle rechte vorbehalten\b|weiterlesen\b|mehr lesen\b|hier klicken\b|jetzt (?:anmelden|abonnieren)\b|datenschutz(?:erklärung|hinweise?)\b|impressum\b|nach oben\b|zum inhalt springen\b|wir verwenden cookies\b"
    r"|tous droits réservés\b|lire la suite\b|cliquez ici\b|partager (?:cet|sur)\b|mentions légales\b|politique de confidentialité\b|haut de page\b|aller au contenu\b|nous utilisons des cookies\b"
    r"|todos los derechos reservados\b|leer más\b|haga? clic aquí\b|compartir (?:esto|en)\b|aviso legal\b|política de (?:privacidad|cookies)\b|volver arriba\b|ir al contenido\b|utilizamos cookies\b"
)
_OPENING = re.compile(rf"\s*(?:{_OPENINGS})", re.I)
_RIGHTS = re.compile(r"(?:©|\(c\)|\bcopyright\b).{0,40}\b(?:19|20)[0-9]{2}\b|\b(?:19|20)[0-9]{2}\b.{0,40}(?:©|\(c\)|\bcopyright\b)", re.I)
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[^\s@]+@[^\s@]+\.[a-z]{2,}[.,;]?", re.I)
_PARTS = re.compile(r"\t+| {2,}|\u3000+")
_SENTENCE = re.compile(r"[.!?。！？]+(?:\s+|$)")
# Marks of lists, and of text that goes on or ends.
_LISTED = re.compile(r"\s*[-*+•–—>|#\"'“„«(\[]|.*[0-9]|.*[.!?:;,…。！？：；，、][\"'”»)]*\s*$")
_SHOUT = re.compile(r"!{2,}$|\?{2,}$")
_BAR = re.compile(r"[|»›•·/>]")
_BARS = frozenset("|»›•·/>")
_ARROW = re.compile(r"(?:[»›→▸►]|>>)\s*$")
_PUNCTUATION = re.compile(r"[^\w\s]")
#: White space to Python, but part of a word here.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_find_words = re.compile(WORD).findall


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules; shares are in hundredths."""

    least_words: int = 20
    most_repeated: int = 30
    most_lost: int = 50
    bars: int = 20
    symbols: int = 30
    shouts: int = 30
    punctuation: int = 35
    same_word: int = 50
    same_lines: int = 3
    short_words: int = 3
    short_chars: int = 30
    short_lines: int = 5
    short_parts: int = 4
    arrow_words: int = 6
    boilerplate_words: int = 20


@dataclass(frozen=True)
class Verdict:
    """What one pass over a text finds; ``text`` is what is left of it, empty if it isn't kept."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    text: str


def words_of(text: str) -> list[str]:
    """Runs of characters other than space and tab to carriage return."""
    return _find_words(text) if _ODD.search(text) else text.split()


def repeated_words(words: list[str], width: int = _WINDOW) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more."""
    if len(words) <= width:
        return 0
    number = dict(zip(dict.fromkeys(words), count()))
    if len(number) == len(words):
        return 0
    # Windows are ranked exactly by doubling: two halves of equal rank make equal windows.
    rank, span = np.fromiter(map(number.__getitem__, words), np.int64, len(words)), 1
    while span < width:
        pair = rank[:-span] * (len(words) + 1) + rank[span:]
        different, rank = np.unique(pair, return_inverse=True)
        span *= 2
        if len(different) == len(pair):
            return 0
    twice = np.bincount(rank)[rank] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def short_part(part: str, limits: Limits) -> bool:
    """Whether a line or a part of one could be an item of a menu."""
    return 0 < len(part) <= limits.short_chars and 0 < len(part.split()) <= limits.short_words and not _LISTED.match(part)


def menu_lines(lines: list[str], limits: Limits) -> set[int]:
    """The lines in runs of short ones; blank lines don't part a run. Repeats count: a run has at least two different lines."""
    found, run, led = set(), [], False
    for i, line in enumerate([*lines, "."]):
        if not line.strip():
            continue
        if len(line) <= 2 * limits.short_chars and short_part(line.strip(), limits):
            run.append(i)
            continue
        if len(run) >= limits.short_lines and not led and len({lines[k] for k in run}) > 1:
            found.update(run)
        run, led = [], line.rstrip().endswith((":", "："))
    return found


def without_opening(line: str, limits: Limits) -> str:
    """A long line without the short sentences of boilerplate that it opens with."""
    at = 0
    while (m := _OPENING.match(line, at)) and (end := _SENTENCE.search(line, m.end())) and len(line[at : end.end()].split()) <= limits.boilerplate_words:
        at = end.end()
    return line[at:]


def failed_line(line: str, words: list[str], limits: Limits) -> str | None:
    """The rule that a line fails, if any. What a rule looks for is sought in the line before it is counted by word."""
    n = len(words)
    if not n:
        return None
    if _BAR.search(line) and 100 * sum(w in _BARS for w in words) > limits.bars * n:
        return "navigation"
    parts = _PARTS.split(line.strip()) if "  " in line or "\t" in line or "\u3000" in line else ()
    if len(parts) >= limits.short_parts and all(short_part(p, limits) for p in parts):
        return "navigation"
    if n <= limits.arrow_words and _ARROW.search(line):
        return "navigation"
    if 50 * len(_SYMBOL.findall(line)) > limits.symbols * n and 100 * sum(len(_SYMBOL.findall(w)) >= 2 for w in words) > limits.symbols * n:
        return "symbols"
    if n >= 4:
        if ("!!" in line or "??" in line) and 100 * sum(bool(_SHOUT.search(w)) for w in words) > limits.shouts * n:
            return "shouting"
        if 100 * len(_PUNCTUATION.findall(line)) > limits.punctuation * (len(line) - n + 1):
            return "punctuation"
        if n >= 8 and 100 * sum(map(eq, words, words[1:])) > limits.same_word * n:
            return "same word"
    if n <= limits.boilerplate_words and (_OPENING.match(line) or _RIGHTS.search(line) or all(map(_ADDRESS.fullmatch, words))):
        return "boilerplate"
    return None


def cleaned_lines(lines: list[str], words: list[list[str]], limits: Limits) -> tuple[list[str], int]:
    """The lines that pass, and how many words stand on them."""
    kept, passed, seen = [], 0, set()
    menu = menu_lines(lines, limits) if len(lines) >= limits.short_lines else ()
    times = Counter(lines) if len(lines) > limits.same_lines else {}
    for i, (line, own) in enumerate(zip(lines, words)):
        n = len(own)
        if i in menu or n and times.get(line, 0) > limits.same_lines:
            continue
        if n > limits.boilerplate_words and _OPENING.match(line):
            line = without_opening(line, limits)
            own = words_of(line)
            n = len(own)
        if failed_line(line, own, limits) or (n > 2 and line in seen):
            continue
        seen.add(line)
        kept.append(line)
        passed += n
    return kept, passed


def clean_lines(text: str | None, limits: Limits = Limits()) -> tuple[str, int, int]:
    """The lines that pass, joined; words on them; words on all lines."""
    lines = (text or "").split("\n")
    words = [words_of(line) for line in lines]
    kept, passed = cleaned_lines(lines, words, limits)
    return "\n".join(kept), passed, sum(map(len, words))


def examine(text: str | None, limits: Limits = Limits()) -> Verdict:
    text = text or ""
    lines = text.split("\n")
    split = _find_words if _ODD.search(text) else str.split
    by_line = [split(line) for line in lines]
    words = by_line[0] if len(lines) == 1 else list(chain.from_iterable(by_line))
    n, seen, duplicate = len(words), set(), 0
    for line, own in zip(lines, by_line):
        if line in seen:
            duplicate += bool(own)
        seen.add(line)
    repeated = repeated_words(words)
    failed = n < limits.least_words or 100 * repeated > limits.most_repeated * n
    left, kept = "", False
    if not failed:
        lines, passed = cleaned_lines(lines, by_line, limits)
        kept = 100 * (n - passed) <= limits.most_lost * n
        left = "\n".join(lines) if kept else ""
    return Verdict(n, sum(map(len, words)), len(_SYMBOL.findall(text)), duplicate, repeated, failed, kept, left)


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The counts and the verdict for every row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            got = [examine(t, limits) for t in texts_of(batch)]
            yield with_columns(batch, ["doc_id"], **{k: pa.array([getattr(v, k) for v in got], pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k in names})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The kept rows of ``docs`` with failed lines taken out of ``text``; ``n_chars``, if there, is counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            got = [examine(t, limits) for t in texts_of(batch)]
            stay = [i for i, v in enumerate(got) if v.kept]
            batch = batch.take(pa.array(stay, pa.int64()))
            cleaned = [got[i].text for i in stay]
            for name, values in (("text", cleaned), ("n_chars", [len(t) for t in cleaned])):
                if (i := batch.schema.get_field_index(name)) >= 0:
                    batch = batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
