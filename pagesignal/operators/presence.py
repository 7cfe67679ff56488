"""Presence events and KPI points: validation, keyed upserts, series.

An upsert is one aggregation by key: the order column says which row came first and last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stamps import floor_time, iso_utc, parse_utc
from .runs import running

# Spellings of the answer surfaces.
SURFACES = {
    "ai overview": "ai_overview", "aio": "ai_overview", "ai_overview": "ai_overview",
    "copilot": "copilot_answer", "copilot answer": "copilot_answer", "copilot_answer": "copilot_answer",
    "perplexity": "perplexity_card", "perplexity card": "perplexity_card", "perplexity_card": "perplexity_card",
    "web": "web_answer", "web answer": "web_answer", "web_answer": "web_answer",
}


def norm_surface(s: Column) -> Column:
    """The surface of a spelling; an unknown one in lower case, not trimmed."""
    known = F.create_map(*[F.lit(x) for pair in SURFACES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.trim(s))), F.lower(s))


def validate_presence(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows with ``citations`` and ``position`` as whole numbers of 64 bits, and the rejected rows with a reason. Only absent keys are missing: empty ones are keys."""

    def whole(c: str) -> Column:
        # A sign, digits and blanks around them; a fraction is no whole number.
        return F.when(F.col(c).cast("string").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(F.col(c).cast("string"), F.lit(" \t\n\x0b\f\r")).try_cast("long"))

    def bad(c: str) -> Column:
        return F.col(c).isNotNull() & whole(c).isNull()

    reason = F.when(F.col("query").isNull(), "query missing").when(F.col("engine").isNull(), "engine missing").when(bad("citations"), "citations not an integer").when(bad("position"), "position not an integer")
    marked = events.withColumn("reason", reason)
    good = marked.where("reason IS NULL").drop("reason").withColumns({c: whole(c) for c in ("citations", "position")})
    return good, marked.where("reason IS NOT NULL")


def normalize_presence(events: DataFrame, granularity: str = "second") -> DataFrame:
    """Normal spellings, and the time floored and written as ISO text; an unreadable time is now."""
    ts = F.coalesce(parse_utc(F.col("ts")), F.current_timestamp())
    return events.withColumns({"engine": F.lower("engine"), "serp_surface": norm_surface(F.col("serp_surface")), "engine_flavor": F.lower("engine_flavor"), "seen": F.coalesce(F.col("seen"), F.lit(False)).cast("int"), "ts": iso_utc(floor_time(ts, granularity))})


def _keys(names: list[str], order: str, null_geo: str) -> list[Column]:
    """Key columns; a row without geo is a key of its own unless null geos are to merge."""
    own = [F.when(F.col("geo").isNull(), F.col(order)).alias("__own")] if null_geo == "distinct" else []
    return [*map(F.col, names), *own]


FIRST, LAST = ("serp_surface", "engine_flavor"), ("citations", "details", "position", "definition_version")


def presence_state(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Rows with, for each value, the place in the order that it has: ``seq_<column>``, null where a last non-null value is null."""
    places = {f"seq_{c}": F.col(order) for c in (*FIRST, "seen")} | {f"seq_{c}": F.when(F.col(c).isNotNull(), F.col(order)) for c in LAST}
    return rows.withColumns(places)


def merge_presence(state: DataFrame, order: str = "seq", null_geo: str = "distinct") -> DataFrame:
    """One row for each key of ``presence_state`` rows, in the same form. As each value has its own place, any split into merges gives the same."""
    first = [F.min_by(c, f"seq_{c}").alias(c) for c in FIRST] + [F.min(f"seq_{c}").alias(f"seq_{c}") for c in FIRST]
    last = [F.max_by(c, f"seq_{c}").alias(c) for c in ("seen", *LAST)] + [F.max(f"seq_{c}").alias(f"seq_{c}") for c in ("seen", *LAST)]
    return state.groupBy(*_keys(["query", "engine", "geo", "ts"], order, null_geo)).agg(*first, *last, F.max(order).alias(order)).drop("__own")


def presence_upsert(rows: DataFrame, order: str = "seq", null_geo: str = "distinct") -> DataFrame:
    """One row for each (query, engine, geo, ts): first surface and flavor, last seen, last non-null of the rest."""
    merged = merge_presence(presence_state(rows, order), order, null_geo)
    return merged.select("query", "engine", "geo", "ts", *FIRST, "seen", *LAST, order)


def presence_query(rows: DataFrame, *, queries: list[str] | None = None, engine: str | None = None, geo: str | None = None, surface: str | None = None, flavor: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows that meet all given conditions, by time. Time bounds are inclusive and compare as text."""
    conditions = [
        F.col("query").isin(*queries) if queries else None,
        F.col("engine") == engine.lower() if engine else None,
        F.col("geo") == geo if geo else None,
        F.col("serp_surface") == norm_surface(F.lit(surface)) if surface else None,
        F.col("engine_flavor") == flavor.lower() if flavor else None,
        F.col("ts") >= since if since else None,
        F.col("ts") <= until if until else None,
    ]
    for condition in conditions:
        rows = rows if condition is None else rows.where(condition)
    ordered = rows.orderBy("ts", *[c for c in ("query", "engine", "geo") if c in rows.columns])
    return ordered.limit(limit) if limit and limit > 0 else ordered


def validate_kpi(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows with ``v`` as a number and ``src`` filled, and the rejected rows with a reason. Only absent keys are missing: empty ones are keys."""
    reason = F.when(F.col("metric").isNull(), "metric missing").when(F.col("t").isNull(), "t missing").when(F.col("v").try_cast("double").isNull(), "v not a number")
    marked = points.withColumn("reason", reason)
    good = marked.where("reason IS NULL").drop("reason").withColumn("v", F.col("v").try_cast("double")).withColumn("src", F.coalesce(F.nullif(F.col("src"), F.lit("")), F.lit("csv")))
    return good, marked.where("reason IS NOT NULL")


def kpi_upsert(points: DataFrame, order: str = "seq", null_geo: str = "distinct") -> DataFrame:
    """One value for each (metric, t, geo, src); the last wins."""
    return points.groupBy(*_keys(["metric", "t", "geo", "src"], order, null_geo)).agg(F.max_by("v", order).alias("v"), F.max(order).alias(order)).drop("__own")


def kpi_points_of(metrics: DataFrame, points: DataFrame, since: str | None = None, until: str | None = None, geo: str | None = None, src: str | list[str] | None = None) -> DataFrame:
    """Long form ``metric, t, v, src``; a metric without points has one row of nulls. Conditions that aren't given don't count.

    The form for any number of points: nothing is gathered.
    """
    given = [(since, F.col("t") >= since), (until, F.col("t") <= until), (geo, F.col("geo") == geo), (src, F.col("src").isin([src] if isinstance(src, str) else list(src or [])))]
    for value, test in given:
        points = points.where(test) if value else points
    return metrics.select("metric").distinct().join(points.select("metric", "t", "v", "src"), "metric", "left")


def kpi_series_chunks(metrics: DataFrame, points: DataFrame, since: str | None = None, until: str | None = None, geo: str | None = None, src: str | list[str] | None = None, chunk: int = 10_000) -> DataFrame:
    """``metric, chunk, points``: each metric's points by time in runs of ``chunk`` points, numbered from 0; one end to end they are its series.

    Points are numbered over ranges of (metric, time), so a metric with very many is spread over many tasks, and no task holds more than a run. A
    metric without points has one empty run.
    """
    rows = kpi_points_of(metrics, points, since, until, geo, src)
    order = [F.col("t").asc_nulls_first(), F.col("v").asc_nulls_first(), F.col("src").asc_nulls_first()]
    laid = running(rows, "metric", order, F.lit(0)).withColumn("chunk", F.floor(F.col("__at") / chunk).cast("long"))
    held = F.when(F.col("t").isNotNull(), F.struct("__at", F.struct("t", "v", "src").alias("p")))
    return laid.groupBy("metric", "chunk").agg(F.transform(F.array_sort(F.collect_list(held)), lambda x: x["p"]).alias("points"))


def kpi_series(metrics: DataFrame, points: DataFrame, since: str | None = None, until: str | None = None, geo: str | None = None, src: str | list[str] | None = None, include_src: bool = False) -> DataFrame:
    """``metric, points``: each metric's points by time in one array, with their source if asked, from its runs end to end.

    One row holds a whole series, so this is for series of bounded length; see ``kpi_series_chunks`` and ``kpi_points_of`` for others.
    """
    runs = kpi_series_chunks(metrics, points, since, until, geo, src).groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("chunk", "points"))).alias("runs"))
    whole = F.flatten(F.transform("runs", lambda r: r["points"]))
    return runs.select("metric", (whole if include_src else F.transform(whole, lambda p: F.struct(p["t"].alias("t"), p["v"].alias("v")))).alias("points"))
