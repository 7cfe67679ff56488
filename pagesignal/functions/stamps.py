"""Times, versions and block ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_text import json_stable


def parse_utc(s: Column) -> Column:
    """ISO date or timestamp as UTC; null if it can't be read."""
    return F.try_to_timestamp(s)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def floor_time(ts: Column, unit: str) -> Column:
    """Floor to the day, minute or second; any other unit counts as second."""
    return F.date_trunc(unit if unit in ("day", "minute") else "second", ts)


def content_version(path: Column, content: Column, jsonld: Column | None = None) -> Column:
    """Seven hex digits of the SHA-256 of path, content and JSON-LD in its stable form, so the order of keys and blanks make no difference.

    JSON ``null`` counts as none; what is no JSON counts as it stands.
    """
    parts = [path, content, *([] if jsonld is None else [F.nullif(F.coalesce(json_stable(jsonld), jsonld), F.lit("null"))])]
    return F.left(F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256), F.lit(7))


def block_id(xpath: Column, payload: Column, order: Column) -> Column:
    digest = F.sha1(F.concat(xpath, F.lit("|"), payload).cast("binary"))
    return F.format_string("b-%04d-%s", order, F.left(digest, F.lit(4)))
