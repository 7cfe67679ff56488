"""Personal data by offset-preserving deobfuscation.

Plain pass: e-mail, IPv4, card and phone patterns over the text as it is, leftmost and not
overlapping within a kind; a match that fails its check is dropped and not retried.

Deobfuscating pass: transducers rewrite the text and keep, for each character they write, the
place it came from: look-alike letters, the compatibility forms and digits of all scripts that Unicode knows
(full-width, mathematical, circled) and invisible characters; runs of
spelled digits, with ``plus`` before and ``dot`` between; ``(at)``, ``[dot]`` and `` at ... dot ...``
disguises, guarded against prose by the words around them. The plain patterns then run
over the rewritten text, and what they find is mapped back to a span of the source. A
found span is added if it overlaps no plain span of its kind. A text that no transducer
changes is not searched twice.

Nulls and edges: null and empty texts have no spans. Offsets are code points, ends
exclusive. Every pattern takes time in proportion to the text; a text of tens of millions of characters is read whole, and
only its edits are kept beside it. Where spans of two kinds overlap both are given; ties of place go by kind as
listed. Repeated rows are treated alike; an empty table gives an empty result. Detection reads ``doc_id`` and ``text``
alone; masking keeps all columns, whatever their names, and leaves a null text null.

Not found: numbers spelled as words over nine, disguises in other languages than English but for their dots,
accented letters standing for plain ones.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small, texts_of, with_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# A run is taken whole, with its tail if it has one, so no character is read again and again.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def plain_spans(text: str) -> dict[str, list[Span]]:
    """The spans of each kind in the text as it is."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = [m.span() for m in _EMAIL.finditer(text) if m[1]]
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


# Letters of other scripts drawn like Latin ones.
_ALIKE = dict(zip("АВЕЅІЈКМНОРСТХУаеорсухіјѕԁһԛԝӏѵкΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρυχɑɡıℓᴄᴏᴜᴠᴡᴢօ", "ABESIJKMHOPCTXYaeopcyxijsdhqwlvkABEZHIKMNOPTYXoavikpuxagilcouvwzo"))
#: Characters that show nothing.
_HIDDEN = "­​‌‍⁠﻿"


def _plain_of(c: str) -> str | None:
    """The ASCII character that a character stands for by Unicode's compatibility forms or digit values; raised and lowered ones stand for themselves."""
    if unicodedata.decomposition(c).startswith(("<super>", "<sub>", "<fraction>")):
        return None
    digit = unicodedata.decimal(c, None)
    plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() and plain != c else None


@lru_cache(maxsize=1)
def _folds() -> dict[str, str]:
    """Characters to fold to one ASCII character each."""
    table = {chr(c): p for c in range(0x80, 0x1FC00) if not 0x3400 <= c < 0xA000 and not 0xAC00 <= c < 0xF900 and (p := _plain_of(chr(c)))}
    return table | _ALIKE | dict.fromkeys("‐‑‒–−", "-") | {"\u3002": "."}


_OTHERS = re.compile(r"[^\x00-\x7f]")
_HIDDEN_ONES = re.compile(f"[{_HIDDEN}]+")

# Spelled digits.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_ONE = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SPELLED_RUN = re.compile(rf"\b{_ONE}(?:(?: dot |[ ,.-]{{1,2}}){_ONE}){{2,}}\b", re.I)
_SPELLED_ONE = re.compile(_ONE, re.I)
_HAS_SPELLED = re.compile(rf"\b{_ONE}[ ,.-]", re.I)
_PLUS_BEFORE = re.compile(r"\bplus[ -]\Z", re.I)
# "plus" before a number as long as a phone's, and not between two numbers.
_PLUS_DIGITS = re.compile(r"(?<![0-9] )(?<![0-9])\bplus (?=[0-9][0-9 ().-]{7})", re.I)
_PART = rf"(?:[0-9]{{1,3}}|{_ONE}(?:[ -]{_ONE}){{0,2}})"
_DOT_QUAD = re.compile(rf"(?<![0-9A-Za-z.]){_PART}(?:(?: dot |\.){_PART}){{3}}(?![0-9A-Za-z])", re.I)

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKET_AT = re.compile(rf"[ ]{{0,3}}{_OPEN} ?(?:at|@) ?{_CLOSE}[ ]{{0,3}}", re.I)
_BRACKET_DOT = re.compile(rf"[ ]{{0,3}}{_OPEN} ?(?:dot|punkt|punto|point|\.) ?{_CLOSE}[ ]{{0,3}}", re.I)
_LABEL = r"[A-Za-z0-9-]{1,63}"
_SPOKEN = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]{{1,64}}(?: dot [A-Za-z0-9._%+-]{{1,64}}){{0,3}})(?P<at> at |@)(?P<host>{_LABEL}(?:(?:\.| dot ){_LABEL}){{0,6}}(?:\.| dot )[A-Za-z]{{2,24}})(?![A-Za-z0-9-])", re.I)
_HAS_HOST = re.compile(rf"(?: [aA][tT] |@){_LABEL}(?:\.{_LABEL}){{0,6}}(?: [dD][oO][tT] |\.[A-Za-z])")
# With these top-level names a spoken address needs no guard.
_TOP = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|nl|ch|ca|au|jp|br|pl|se"
_SURE = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]{{1,64}}(?: dot [A-Za-z0-9._%+-]{{1,64}}){{0,3}})(?P<at> at |@)(?P<host>[A-Za-z0-9-]{{1,63}}(?: dot [A-Za-z0-9-]{{1,63}}){{0,3}} dot (?:{_TOP}))(?![A-Za-z0-9-])", re.I)
# Words of prose before "at", at the head of a noun ("at the dot ...") and after its "dot".
_BEFORE_AT = frozenset("a all also am and are arrive arrives as ask aim be been begin both buy call can check come do down each end ends even find for found free get glance go had happen has have he held her here him his home i in is it its join just kept left listen live look looks made me meet meets met more now of off on online only open or order out over people point points read register sat see seen set she shop shown sit sits so sold start starts stay stays stop stops store stand stands stood that them there they this time today up us view visit was watch we were what which who with work works you".split())
_DETERMINERS = frozenset("a all an another any both each either every few first her his its last many my neither no one our same second several some that the their these this those three two what which your".split())
_AFTER_DOT = frozenset("a an and appeared appears are at-the because but by for from had has he if marked of on or she than that the then there they this was we were when where which while who will with you".split())
_ENDINGS = ("ed", "ing", "able", "ible")
_CUE = re.compile(r"(?:\be-?mails?|\bmail|\bcontact|\bwrite(?: to)?|\breach|\baddress(?: is)?|\bmailto)[ :]{1,2}\Z|:[ ]\Z", re.I)
_SHAPED = re.compile(r"[0-9._%+-]| dot ", re.I)
_SPOKEN_DOT = re.compile(" dot ", re.I)


def spoken_address(m: re.Match) -> bool:
    """Whether the words in and before a match of ``_SPOKEN`` make it an address rather than prose."""
    local, host = m["local"].lower(), m["host"].lower()
    labels = re.split(r" dot |\.", host)
    if m["at"] == "@":
        return " dot " in host and labels[-1] not in _AFTER_DOT
    if labels[0] in _DETERMINERS or labels[-1] in _AFTER_DOT:
        return False
    before = m.string[max(0, m.start() - 16) : m.start()]
    if _SHAPED.search(local) and local[-1] not in ".-" or _CUE.search(before):
        return True
    if local in _BEFORE_AT or local.endswith(_ENDINGS):
        return False
    # A host as it is written is common in prose ("tickets at example.com"): there the local part opens a line.
    return " dot " in host or not before.strip(" ") or before.rstrip(" ")[-1] in "\n(<,;"


def spoken_addresses(text: str) -> Iterator[re.Match]:
    at = 0
    while m := _SPOKEN.search(text, at):
        own = m if spoken_address(m) else _SURE.match(text, m.start())
        if own:
            yield own
        # A word that is no local part may stand before one.
        at = own.end() if own else m.end("local")


class Rewrite:
    """A text and the edits that made it; a place in it is looked up among them, so what is kept grows with the edits, not the text."""

    def __init__(self, text: str) -> None:
        self.text, self.layers, self.changed = text, [], False

    def fold(self, table: dict[int, str]) -> None:
        """Replace characters one for one, which moves nothing."""
        self.text, self.changed = self.text.translate(table), True

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text, in order and apart from each other."""
        if not edits:
            return
        text, at, moved = [], 0, 0
        starts, ends, olds, old_ends = (array("q") for _ in range(4))
        for a, b, by in edits:
            text += [self.text[at:a], by]
            starts.append(a + moved)
            ends.append(a + moved + len(by))
            olds.append(a)
            old_ends.append(b)
            moved += len(by) - (b - a)
            at = b
        text.append(self.text[at:])
        self.layers.append((starts, ends, olds, old_ends))
        self.text, self.changed = "".join(text), True

    def source(self, start: int, end: int) -> Span:
        for starts, ends, olds, old_ends in reversed(self.layers):
            i, j = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
            start = start if i < 0 else olds[i] if start < ends[i] else start - ends[i] + old_ends[i]
            end = end if j < 0 else old_ends[j] if end - 1 < ends[j] else end - ends[j] + old_ends[j]
        return start, end


def digits_of(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Edits that write the spelled digits of a span as digits; gaps between them close up."""
    words = list(_SPELLED_ONE.finditer(text, start, end))
    return [(w.start(), after.start() if after and after.start() == w.end() + 1 and text[w.end()] != "." else w.end(), _SPELLED[w[0].lower()]) for w, after in zip(words, [*words[1:], None])]


def deobfuscate(text: str) -> Rewrite:
    out = Rewrite(text)
    if not text.isascii():
        # Few different characters of a text aren't ASCII, and of those few are folded.
        table = _folds()
        found = {ord(c): table[c] for c in set(_OTHERS.findall(text)) if c in table}
        if found:
            out.fold(found)
        out.replace([(*m.span(), "") for m in _HIDDEN_ONES.finditer(out.text)])
    if _HAS_SPELLED.search(out.text):
        edits = []
        for run in _SPELLED_RUN.finditer(out.text):
            words = list(_SPELLED_ONE.finditer(out.text, *run.span()))
            for word, after in zip(words, [*words[1:], None]):
                # A dot between digits may part an address; other gaps close up.
                gap = out.text[word.end() : after.start()] if after else ""
                digit = _SPELLED[word[0].lower()] + ("." if "." in gap or "dot" in gap.lower() else "")
                plus = _PLUS_BEFORE.search(out.text, max(0, word.start() - 6), word.start()) if word is words[0] else None
                edits.append((plus.start() if plus else word.start(), after.start() if after else word.end(), "+" + digit if plus else digit))
        out.replace(edits)
    if "plus " in out.text.lower():
        out.replace([(m.start(), m.end(), "+") for m in _PLUS_DIGITS.finditer(out.text)])
    low = out.text
    if any(c in low for c in "[({<"):
        marks = [(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(out.text)]
        if marks:
            out.replace(marks)
            out.replace([(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(out.text)])
        elif out.changed or "@" in low or _DIGIT.search(low):
            out.replace([(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(out.text)])
    if " dot " in out.text.lower():
        edits = []
        for m in _DOT_QUAD.finditer(out.text):
            if _SPOKEN_DOT.search(m[0]):
                edits += sorted([*((d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(out.text, *m.span())), *digits_of(out.text, *m.span())])
        out.replace(edits)
    if _HAS_HOST.search(out.text):
        edits = []
        for m in spoken_addresses(out.text):
            dots = [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(out.text, *m.span())]
            edits += sorted([*dots, (*m.span("at"), "@")])
        out.replace(edits)
    return out


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows, apart from the plain ones of their kind."""
    out = deobfuscate(text)
    more: dict[str, list[Span]] = {k: [] for k in KINDS}
    if out.changed:
        for kind, spans in plain_spans(out.text).items():
            own = base[kind]
            at = 0
            for span in (out.source(*s) for s in spans):
                while at < len(own) and own[at][1] <= span[0]:
                    at += 1
                if at == len(own) or own[at][0] >= span[1]:
                    more[kind].append(span)
    return more


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans and all spans, each by kind in order."""
    base = plain_spans(text or "")
    more = added_spans(text or "", base)
    return base, {k: sorted(base[k] + more[k]) for k in KINDS}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def mask(text: str | None, names: dict[str, str] | None = None) -> str | None:
    """The text with each span replaced by a mark of its kind; where spans overlap, by one mark of the first."""
    if not text:
        return text
    spans = sorted((a, b, k) for k, own in find(text)[1].items() for a, b in own)
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], (names or {}).get(kind, f"<{kind.upper()}>")]
        at = max(at, b)
    return "".join([*out, text[at:]])


@lru_cache(maxsize=1)
def _nothing() -> str:
    return hashlib.sha256(b"").hexdigest()


def detect(docs: DataFrame) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: how many plain spans of each kind (``n_email`` and so on), the SHA-256 of
    their list, all spans as text, ``n_added``, how many of those the deobfuscating pass found, and ``n_found``, how many there are."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts, digests, spans, added, total = {k: [] for k in KINDS}, [], [], [], []
            for text in texts_of(batch):
                base, full = find(text)
                for k in KINDS:
                    counts[k].append(len(base[k]))
                plain, all_of = joined(base), joined(full)
                digests.append(hashlib.sha256(plain.encode()).hexdigest() if plain else _nothing())
                spans.append(all_of)
                total.append(sum(map(len, full.values())))
                added.append(total[-1] - sum(map(len, base.values())))
            yield with_columns(batch, ["doc_id"], **{f"n_{k}": pa.array(counts[k], pa.int64()) for k in KINDS}, base_sha256=pa.array(digests), spans=pa.array(spans, pa.string()), n_added=pa.array(added, pa.int64()), n_found=pa.array(total, pa.int64()))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_found long")


def mask_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` masked; ``n_chars``, if there, is counted anew where a text changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            old = texts_of(batch)
            new = [mask(t) for t in old]
            i, n = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            batch = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
            if n >= 0:
                counts = [c if a == b else len(b) for a, b, c in zip(old, new, batch.column(n).to_pylist())]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(counts, batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
