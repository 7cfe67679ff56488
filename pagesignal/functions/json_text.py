"""JSON text in one spelling: keys in order at every level, no blanks."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a variant writes otherwise than the stable form: fractions and exponents, numbers too long for it, control
#: characters, constants that JSON lacks, and characters that sort otherwise in UTF-16.
_HARD = r"[0-9][.eE]|[0-9]{19}|-0|\\u|NaN|Infinity|[\x{D800}-\x{DFFF}\x{10000}-\x{10FFFF}]"

# The stable texts of what counts as empty.
EMPTY = ("", "{}", "[]", '""', "0", "0.0", "-0.0", "null", "false")


def _each(write: Callable[[object], str]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def written(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else write(json.loads(text))
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return written


_exact = _each(lambda value: json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))

#: JSON text with an indent of two, keys as they come; null for what can't be read.
json_pretty = _each(lambda value: json.dumps(value, ensure_ascii=False, indent=2))


def json_stable(text: Column) -> Column:
    """JSON text with keys sorted at every level and no blanks; of repeated keys the last counts. Null for what can't be read.

    A variant keeps its keys in order, so most texts are parsed and written again in the JVM; only those that it can't take, or
    whose numbers it would spell otherwise, go through Python.
    """
    # The parser overlooks what follows a value, so the text must be one value both in brackets and in braces.
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = F.try_variant_get(listed, "$[1]", "variant").isNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    plain = F.when(~text.rlike(_HARD) & single, F.to_json(F.try_variant_get(listed, "$[0]", "variant")))
    return F.coalesce(plain, _exact(F.when(plain.isNull(), text)))


def or_text(text: Column) -> Column:
    """The stable form, or the text itself where it is no JSON."""
    return F.coalesce(json_stable(text), text)


def is_empty_json(text: Column) -> Column:
    """Null, an empty text, or JSON for an empty object, list or text, zero, null or false."""
    return F.coalesce(F.trim(or_text(text)).isin(*EMPTY), F.lit(True))
