"""Text expressions: tokens, sentences, readability, snippets. All are built-in columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_CHARS = 220


def tokenize(s: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def sentences(s: Column) -> Column:
    """Runs up to and with ``.``, ``!`` or ``?``; what follows the last of these is dropped."""
    # The end mark is optional in the pattern, so a long text without one is read once, not from each of its places.
    runs = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit("([^.!?]++[.!?]?)"), F.lit(1))
    return F.filter(runs, lambda x: F.right(x, F.lit(1)).isin(".", "!", "?"))


def split_sentences(s: Column) -> Column:
    """Non-blank parts between ``.``, ``!`` and ``?``, trimmed; the last need not end with one."""
    parts = F.split(F.coalesce(s, F.lit("")), "[.!?]+")
    return F.filter(F.transform(parts, strip), lambda x: F.length(x) > 0)


def strip(s: Column) -> Column:
    return F.trim(s, F.lit(" \t\n\x0b\f\r"))


def word_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"\S+"))


def alphabetic_words(s: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit("([A-Za-z]+(?:'[A-Za-z]+)?)"), F.lit(1))


def syllables(word: Column) -> Column:
    """Groups of vowels, less a final e, at least one; 0 for a word without letters."""
    w = F.lower(F.regexp_replace(word, "[^A-Za-z]", ""))
    groups = F.size(F.regexp_extract_all(w, F.lit("([aeiouy]+)"), F.lit(1)))
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), groups - ((groups > 1) & w.endswith("e")).cast("int")))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, also where ``then`` uses it inside a lambda for each element."""
    return F.transform(F.array(value), then)[0]


def total_syllables(words: Column) -> Column:
    """Syllables of all words of an array, counted by three patterns over the joined words rather than word by word."""
    joined = F.lower(F.replace(F.array_join(words, " "), F.lit("'"), F.lit("")))
    consonant = "[b-df-hj-np-tv-xz]"
    groups = F.regexp_count(joined, F.lit("[aeiouy]+"))
    silent = F.regexp_count(joined, F.lit(f"[aeiouy][a-z]*{consonant}[aeiouy]*e(?= |$)"))
    without = F.regexp_count(joined, F.lit(f"(?:^|(?<= )){consonant}+(?= |$)"))
    return groups - silent + without


def grade_of(words: Column, n_sentences: Column) -> Column:
    """Flesch-Kincaid grade, unrounded; 0 without words."""
    n, total = F.size(words), total_syllables(words)
    per_sentence = n / F.greatest(F.lit(1), n_sentences)
    return F.when(n == 0, F.lit(0.0)).otherwise(0.39 * per_sentence + 11.8 * (total / n) - 15.59)


def grade(s: Column) -> Column:
    return grade_of(alphabetic_words(s), F.size(split_sentences(s)))


def highlight(s: Column, terms: Column) -> Column:
    """``<em>`` around each term, longest first, any case, inside words too."""
    unique = F.array_distinct(terms)
    by_length = F.array_sort(F.transform(unique, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    pattern = F.concat(F.lit("(?i)("), F.array_join(F.transform(by_length, lambda x: x["t"]), "|"), F.lit(")"))
    return F.when(F.size(unique) == 0, s).otherwise(F.regexp_replace(s, pattern, F.lit("<em>$1</em>")))


def snippet(text: Column, q: Column, size: int = SNIPPET_CHARS) -> Column:
    """The text around the first hit of the whole query, or else of its earliest token, highlighted; without a hit its start."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    whole = F.call_function("locate", F.lower(q), low)
    tokens = tokenize(q)
    places = F.filter(F.transform(tokens, lambda t: F.call_function("locate", t, low)), lambda p: p > 0)
    hit = F.when(whole > 0, whole).otherwise(F.array_min(places)) - 1
    n = F.length(text)
    start, end = F.greatest(F.lit(0), hit - size // 3), F.least(n, hit + 2 * size // 3)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < n, "…").otherwise(""))
    head = F.concat(F.substring(text, F.lit(1), F.lit(size)), F.when(n > size, "…").otherwise(""))
    return F.when(text == "", "").when(hit.isNull(), head).otherwise(highlight(cut, tokens))


def hash_bucket(term: Column, width: int) -> Column:
    """SHA-1 of the term as a number, modulo ``width``."""
    digest = F.sha1(term.cast("binary"))
    if 4096 % width == 0:
        return (F.conv(F.right(digest, F.lit(3)), 16, 10).cast("int") % width).cast("int")
    # 40 hex digits folded five at a time, so that the running value stays small.
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: (a * (1 << 20) + p) % width).cast("int")
