"""Expressions on URLs and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_host(url: Column) -> Column:
    """Host without user and port, as written; empty without a scheme."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z]+://([^/]+)", 1)
    return F.split(F.element_at(F.split(authority, "@"), -1), ":")[0]


def host_matches_site(host: Column, site: Column) -> Column:
    """The host is the site or below it; stars and dots in front of the site are ignored, an empty site matches."""
    bare = F.lower(F.regexp_replace(F.coalesce(site, F.lit("")), r"^[*.]+", ""))
    host = F.lower(F.coalesce(host, F.lit("")))
    return (F.coalesce(site, F.lit("")) == "") | (host == bare) | F.endswith(host, F.concat(F.lit("."), bare))


def map_url(base: Column, path: Column) -> Column:
    """Public URL of a content path: index pages and Markdown files become directories."""
    base, path = F.rtrim(base, F.lit("/")), F.ltrim(path, F.lit("/"))
    relative = F.when(path == "index.md", "").when(path.endswith("/index.md"), F.regexp_replace(path, r"index\.md$", "")).when(path.endswith(".md"), F.regexp_replace(path, r"\.md$", "/")).otherwise(path)
    return F.concat(base, F.lit("/"), relative)


def path_is_safe(path: Column) -> Column:
    """Whether a path never climbs above its root."""
    steps = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    lowest = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda a, p: F.struct(
            (a["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"),
            F.least(a["low"], a["depth"] + F.when(p == "..", -1).otherwise(1)).alias("low"),
        ),
    )
    return F.coalesce((F.trim(path) != "") & (lowest["low"] >= 0), F.lit(False))


def preview_path(folder: Column, path: Column) -> Column:
    return F.concat_ws("/", F.rtrim(folder, F.lit("/")), F.ltrim(path, F.lit("/")))


def rich_results_url(page_url: Column) -> Column:
    """Address of the public rich-results test for a page, in quote-plus encoding."""
    quoted = F.replace(F.replace(F.url_encode(page_url), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit("https://search.google.com/test/rich-results?url="), quoted)


# Accented letters and what they become in a slug.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def slug(s: Column) -> Column:
    """Lower-case words joined by hyphens; Latin accents are dropped."""
    plain = F.replace(F.translate(F.lower(s), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def service_city_slug(service: Column, city: Column) -> Column:
    return F.concat_ws("/", slug(service), slug(city))


def detect_mime(content_type: Column) -> Column:
    bare = F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))
    return F.when(bare == "", "application/octet-stream").otherwise(bare)


def detect_mode(mode: Column, mime: Column) -> Column:
    return F.when(mode.isin("html", "pdf"), mode).when(mime == "application/pdf", "pdf").otherwise("html")
