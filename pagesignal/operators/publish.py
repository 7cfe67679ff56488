"""Page batches merged into a versioned content table, with sitemap and submission tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import line_diff as diffs
from ..functions.json_text import is_empty_json, json_pretty, or_text
from ..functions.stamps import content_version
from ..functions.urls import parse_host, path_is_safe, preview_path
from .sizes import broadcast_if_small


def validate_publish(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a safe path and exactly one of Markdown and HTML, and the rest with a reason."""
    reason = F.when(F.trim(F.coalesce("path", F.lit(""))) == "", "path missing").when(F.col("markdown").isNotNull() == F.col("html").isNotNull(), "exactly one of markdown and html").when(~path_is_safe(F.col("path")), "path leaves the root")
    marked = batch.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def embed_jsonld(html: Column, jsonld: Column) -> Column:
    """The script, in stable JSON, before every ``</head>``, else before every ``</body>``, else at the end. Empty JSON, as ``{}``, isn't embedded."""
    script = F.concat(F.lit('<script type="application/ld+json">'), or_text(jsonld), F.lit("</script>"))
    line = F.concat(script, F.lit("\n"))
    at_end = F.concat(html, F.when(html.endswith("\n"), "").otherwise("\n"), line)
    placed = (
        F.when(html.contains("</head>"), F.replace(html, F.lit("</head>"), F.concat(line, F.lit("</head>"))))
        .when(html.contains("</body>"), F.replace(html, F.lit("</body>"), F.concat(line, F.lit("</body>"))))
        .otherwise(at_end)
    )
    return F.when(is_empty_json(jsonld), html).otherwise(placed)


def render_ok(html: Column) -> Column:
    return F.coalesce(html.contains("<"), F.lit(False))


def prepared_rows(batch: DataFrame, preview_folder: str = "preview", order: str = "seq") -> DataFrame:
    """``path, content, jsonld, version`` and the order of every row, previews under their folder."""
    path = F.when(F.coalesce("preview", F.lit(False)), preview_path(F.lit(preview_folder), F.col("path"))).otherwise(F.col("path"))
    content = F.coalesce("markdown", F.when(F.coalesce("embed_jsonld", F.lit(False)), embed_jsonld(F.col("html"), F.col("jsonld"))).otherwise(F.col("html")))
    return batch.select(path.alias("path"), content.alias("content"), "jsonld", order).withColumn("version", content_version(F.col("path"), F.col("content"), F.col("jsonld")))


def prepare_batch(batch: DataFrame, preview_folder: str = "preview", order: str = "seq") -> DataFrame:
    """``path, content, jsonld, version`` of the last row for each path."""
    rows = prepared_rows(batch, preview_folder, order)
    return rows.groupBy("path").agg(F.max_by(F.struct("content", "jsonld", "version"), order).alias("r")).select("path", "r.content", "r.jsonld", "r.version")


def content_digest(content: Column) -> Column:
    """Stands for a content in comparisons; none counts as an empty one, as a file that isn't there does."""
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def _status(is_new: Column, before: Column, after: Column) -> Column:
    return F.when(F.coalesce(before, content_digest(F.lit(""))) == after, "not_modified").when(is_new, "inserted").otherwise("changed")


def content_state(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The newest of the prepared rows of each path, what it did to the path, and the content before it.

    ``status`` goes by content alone: not_modified if it is that of the row before, or empty with no row before it; else inserted
    or changed. Only the two newest rows of a path count, so states merge in any order; older ones stay where they lie.
    """
    digest = F.coalesce("digest", content_digest(F.col("content"))) if "digest" in rows.columns else content_digest(F.col("content"))
    newest = Window.partitionBy("path").orderBy(F.col(order).desc())
    two = rows.withColumn("digest", digest).withColumn("__n", F.dense_rank().over(newest)).where("__n <= 2")
    last, before = F.when(F.col("__n") == 1, F.struct(order, "version", "content", "jsonld", "digest")), F.when(F.col("__n") == 2, F.struct(order, "digest"))
    held = two.groupBy("path").agg(F.max(last).alias("a"), F.max(before).alias("b"))
    status = _status(F.col("b").isNull(), F.col("b.digest"), F.col("a.digest"))
    return held.select("path", f"a.{order}", "a.version", "a.content", "a.jsonld", status.alias("status"), F.col(f"b.{order}").alias("before"), F.col("b.digest").alias("digest_before"))


def state_rows(state: DataFrame, order: str = "seq") -> DataFrame:
    """The rows that a content state stands for."""
    none = F.lit(None).cast("string")
    old = state.where(F.col("before").isNotNull()).select("path", F.col("before").alias(order), none.alias("version"), none.alias("content"), none.alias("jsonld"), F.col("digest_before").alias("digest"))
    return state.select("path", order, "version", "content", "jsonld", none.alias("digest")).unionByName(old)


def content_merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``path, status, version``: inserted, changed, not_modified, or kept where nothing came in. The version is that of what came in.

    A page has changed if its content has; new JSON-LD alone changes the version, not the page. Digests stand for
    contents, so the texts of neither side are shuffled.
    """
    old = existing.select("path", F.col("version").alias("old"), content_digest(F.col("content")).alias("had"), F.lit(True).alias("held"))
    new = incoming.select("path", F.col("version").alias("new"), content_digest(F.col("content")).alias("has"))
    status = F.when(F.col("has").isNull(), "kept").otherwise(_status(F.col("held").isNull(), F.col("had"), F.col("has")))
    return old.join(new, "path", "full").select("path", status.alias("status"), F.when(F.col("has").isNull(), F.col("old")).otherwise(F.col("new")).alias("version"))


def merged_content(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The content table after the batch: pages whose content came in unchanged stay as they were, with the JSON-LD that they had."""
    names = ["path", "content", "jsonld", "version"]
    written = content_merge(existing, incoming).where("status IN ('inserted', 'changed')").select("path")
    return existing.join(written, "path", "left_anti").select(*names).unionByName(incoming.join(written, "path", "left_semi").select(*names))


def history_append(incoming: DataFrame, status: DataFrame, committed_at: Column, dry_run: bool = False) -> DataFrame:
    """``path, version, content, committed_at`` rows for what was inserted or changed; none in a dry run."""
    touched = status.where(F.col("status").isin("inserted", "changed") & F.lit(not dry_run)).select("path")
    return incoming.join(touched, "path", "left_semi").select("path", "version", "content", committed_at.alias("committed_at"))


def rollback_version(history: DataFrame, wanted: DataFrame, depth: int = 200) -> DataFrame:
    """The newest of a path's last ``depth`` history rows that has the wanted version, for ``wanted(path, version)``."""
    newest = Window.partitionBy("path").orderBy(F.col("committed_at").desc(), F.col("version"))
    recent = history.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= depth)
    found = recent.join(wanted, ["path", "version"])
    return found.groupBy("path", "version").agg(F.min("age").alias("age"), F.max_by("committed_at", -F.col("age")).alias("committed_at"))


def sitemap_touch(sitemap: DataFrame, changed: DataFrame, now: Column) -> DataFrame:
    """``loc, lastmod``: now where a changed page's ``url`` is the trimmed loc; unknown urls are not added."""
    touched = changed.select(F.col("url").alias("__url")).distinct().withColumn("__hit", F.lit(True))
    return sitemap.join(touched, F.trim("loc") == F.col("__url"), "left").select("loc", F.when(F.col("__hit"), now).otherwise(F.col("lastmod")).alias("lastmod"))


def indexnow_payload(urls: DataFrame, most: int = 10_000) -> DataFrame:
    """``host, part, url_list``: changed urls of each host, each once and in order, in lists of about ``most``, the protocol's own bound.

    Hosts of more urls than that have several parts, dealt by a hash of the url, so no host is gathered into one row.
    """
    each = urls.select(parse_host(F.col("url")).alias("host"), "url").distinct()
    parts = each.groupBy("host").agg(F.ceil(F.count("*") / (0.9 * most)).cast("int").alias("n"))
    # Hosts of one part need no more than their urls; few have more.
    many = each.join(broadcast_if_small(parts.where("n > 1")), "host", "left").withColumn("part", F.pmod(F.xxhash64("url"), F.coalesce("n", F.lit(1))).cast("int"))
    return many.groupBy("host", "part").agg(F.array_sort(F.collect_list("url")).alias("url_list"))


def jsonld_sidecars(batch: DataFrame) -> DataFrame:
    """``path, jsonld`` of the files next to pages whose JSON-LD is not empty and not embedded, written with an indent."""
    apart = batch.where(~is_empty_json(F.col("jsonld")) & ~F.coalesce("embed_jsonld", F.lit(False)))
    return apart.select(F.concat("path", F.lit(".jsonld")).alias("path"), F.coalesce(json_pretty(F.col("jsonld")), "jsonld").alias("jsonld"))


@F.pandas_udf(T.StringType())
def line_diff(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Unified diff of two texts under a path, empty if they are equal. Meant for changed rows. Nulls are empty texts."""
    for path, before, after in batches:
        yield pd.Series([diffs.unified(b or "", a or "", p if (p or "").startswith("/") else f"/{p or ''}") for p, b, a in zip(path, before, after)], dtype=object)


@F.pandas_udf(T.StringType())
def apply_diff(before: pd.Series, diff: pd.Series) -> pd.Series:
    """The text that a ``line_diff`` of ``before`` led to."""
    return pd.Series([diffs.apply(b or "", d or "") for b, d in zip(before, diff)], dtype=object)


def write_sitemap(sitemap: DataFrame, path: str) -> None:
    sitemap.select("loc", "lastmod").write.mode("overwrite").format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
