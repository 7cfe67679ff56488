"""Raw pages into blocks, metadata and JSON-LD; robots rules, fetch classes and recrawl state."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import html_blocks
from ..functions.urls import parse_host, rich_results_url
from ..sources.shared import cut
from .per_row import per_row
from .sizes import broadcast_if_small, is_small

MOST_BYTES = 8 * 1024 * 1024
BACKOFF_CAP = 60.0
_BLOCK = pa.struct([("order", pa.int32()), ("id", pa.string()), ("type", pa.string()), ("text", pa.string()), ("items", pa.list_(pa.string())), ("cells", pa.list_(pa.list_(pa.string()))), ("xpath", pa.string())])


def block_arrays(pages: DataFrame, keep_toc: bool = True) -> DataFrame:
    """``page_id, blocks``: the blocks of each page of ``pages(page_id, html)`` in one array, as long as the page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [html_blocks.blocks(h, keep_toc) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_BLOCK))], names=["page_id", "blocks"])

    block = "struct<order:int,id:string,type:string,text:string,items:array<string>,cells:array<array<string>>,xpath:string>"
    return pages.select("page_id", "html").mapInArrow(read, f"page_id {kind}, blocks array<{block}>")


def extract_blocks(pages: DataFrame, keep_toc: bool = True) -> DataFrame:
    """``page_id, order, id, type, text, items, cells, xpath``: one row for each block of ``pages(page_id, html)``."""
    return block_arrays(pages, keep_toc).select("page_id", F.inline("blocks"))


def table_cells(blocks: DataFrame) -> DataFrame:
    """``page_id, order, row, col, value`` of table blocks."""
    rows = blocks.where("type = 'table'").select("page_id", "order", F.posexplode("cells").alias("row", "cells"))
    return rows.select("page_id", "order", "row", F.posexplode("cells").alias("col", "value"))


def page_text(pages: DataFrame) -> DataFrame:
    """``page_id, text``: block texts of each page with blocks in order, one a line. All in the row."""
    texts = F.filter(F.transform("blocks", lambda b: b["text"]), lambda t: t.isNotNull())
    return block_arrays(pages).select("page_id", texts.alias("texts")).where(F.size("texts") > 0).select("page_id", F.array_join("texts", "\n").alias("text"))


def _read_pages(pages: DataFrame, columns: list[str], schema: str, read: Callable[[html_blocks.Node, dict], dict]) -> DataFrame:
    """``page_id`` and what ``read`` makes of each page's tree and row."""
    kind = pages.schema["page_id"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(html_blocks.tree(row["html"]), row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[c] for f in found]).cast(t) for c, t in zip(names, types))], names=["page_id", *names])

    types = [to_arrow_type(f.dataType) for f in T._parse_datatype_string(schema)]
    return pages.select("page_id", *columns).mapInArrow(run, f"page_id {kind}, {schema}")


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """``page_id, n, i, jsonld``: each JSON-LD object of a page as JSON text; a list gives one row each, what can't be parsed none."""
    listed = _read_pages(pages, ["html"], "objects array<struct<n:int,i:int,jsonld:string>>", lambda root, row: {"objects": [{"n": n, "i": i, "jsonld": x} for n, i, x in html_blocks.jsonld_objects(root)]})
    return listed.select("page_id", F.inline("objects"))


def extract_page_meta(pages: DataFrame) -> DataFrame:
    """``page_id, canonical, noindex, nofollow, lang, telephone, address_text, has_map``: the first match of each, null if there is none.

    Read off the page's elements, so quoting, comments and character references are those of HTML.
    """
    return _read_pages(pages, ["html"], "canonical string, noindex boolean, nofollow boolean, lang string, telephone string, address_text string, has_map string", lambda root, row: html_blocks.page_meta(root))


def precheck(pages: DataFrame) -> DataFrame:
    """``page_id, schema_ok, render_ok, google_warnings, rich_results_test_url`` for ``pages(page_id, html)``, with ``jsonld`` and ``url`` if there.

    The schema is right if every embedded script, and the given JSON-LD, can be read and all their objects carry @context and
    @type; each that isn't gives a warning. The page renders if it holds a tag.
    """
    has = [c for c in ("jsonld", "url") if c in pages.columns]

    def read(root: html_blocks.Node, row: dict) -> dict:
        return {"embedded": all(map(html_blocks.jsonld_ok, html_blocks.scripts(root))), "given": row.get("jsonld") is None or html_blocks.jsonld_ok(row["jsonld"]), "renders": "<" in (row["html"] or ""), "at": row.get("url")}

    found = _read_pages(pages, ["html", *has], "embedded boolean, given boolean, renders boolean, at string", read)
    warnings = F.array_compact(F.array(F.when(~F.col("embedded"), "embedded JSON-LD lacks @context or @type or can't be read"), F.when(~F.col("given"), "given JSON-LD lacks @context or @type or can't be read")))
    return found.select("page_id", (F.col("embedded") & F.col("given")).alias("schema_ok"), F.col("renders").alias("render_ok"), warnings.alias("google_warnings"), rich_results_url(F.col("at")).alias("rich_results_test_url"))


def classify_fetch(log: DataFrame) -> DataFrame:
    """Adds ``outcome``: not_modified, then too large, then by status."""
    s = F.col("status")
    outcome = F.when(s == 304, "not_modified").when(F.col("n_bytes") > MOST_BYTES, "content_too_large").when(s.isin(429, 500, 502, 503, 504), "retryable").when(s >= 400, "fetch_failed").otherwise("ok")
    return log.withColumn("outcome", outcome)


_AGENT, _RULE = re.compile(r"(?i)user-agent\s*:\s*(.+)"), re.compile(r"(?i)(dis)?allow\s*:\s*(.+)")


def robots_rules(body: str | None, agent: str) -> list[str]:
    """The disallowed prefixes that a file has for an agent, or for ``*`` where it doesn't name the agent, each once.

    A line belongs to the last agent line above it; agents and keys go without regard to case and may have blanks before the colon. A line
    without a value says nothing, so an empty agent line ends no block. One pass over the lines.
    """
    blocks: dict[str, dict[str, None]] = defaultdict(dict)
    current = None
    for line in (body or "").splitlines():
        line = line.strip()
        if m := _AGENT.match(line):
            current = m[1].strip().lower()
            blocks[current]  # an agent that is named has a block, with or without rules
        elif current is not None and (m := _RULE.match(line)) and m[1]:
            blocks[current][m[2].strip()] = None
    return list(blocks.get(agent.lower(), blocks.get("*", {})))


def parse_robots(files: DataFrame, agent: str) -> DataFrame:
    """``host, rule``: disallowed prefixes for the agent, or for ``*`` where the file doesn't name it, for ``files(host, body)``."""
    return per_row(files, "host", ["body"], "rule string", lambda body: [(r,) for r in robots_rules(body, agent)]).distinct()


def robots_filter(urls: DataFrame, rules: DataFrame, most_rules: int = 500_000) -> DataFrame:
    """Urls whose path starts with no rule of their host. Any number of rules a host: a path is cut to the lengths that its host's rules have.

    Up to ``most_rules`` rules are broadcast as one set for each host, and a url looks up a cut for each length. More are joined: the cuts
    of the different urls meet the rules by host and cut, hashed, and what is blocked is taken out by url.
    """
    path = F.regexp_extract("url", r"(?i)^[a-z]+://[^/?#]+([^?#]*)", 1)
    host, whole = F.lower(parse_host(F.col("url"))), F.when(path == "", "/").otherwise(path)
    rules = rules.select(F.col("host").alias("__host"), F.col("rule").alias("__rule")).where("__host IS NOT NULL AND __rule IS NOT NULL")
    if is_small(rules, most_rules):
        return _filter_by_sets(urls, host, whole, rules)
    # Lengths are few for each host; the rows of a hot host are spread by url, then by cut.
    lengths = rules.groupBy("__host").agg(F.collect_set(F.length("__rule")).alias("__lengths"))
    asked = urls.select("url", host.alias("__host"), whole.alias("__path")).distinct()
    cuts = F.filter("__lengths", lambda n: n <= F.length("__path"))
    blocked = asked.join(lengths, "__host").select("url", "__host", F.explode(F.transform(cuts, lambda n: F.substring(F.col("__path"), F.lit(1), n))).alias("__rule"))
    return urls.join(blocked.join(rules.distinct(), ["__host", "__rule"], "left_semi").select("url").distinct(), "url", "left_anti").select(*urls.columns)


def _filter_by_sets(urls: DataFrame, host: Column, path: Column, rules: DataFrame) -> DataFrame:
    held: dict[str, set[str]] = defaultdict(set)
    for own, rule in zip(*(c.to_pylist() for c in rules.toArrow().columns)):
        held[own].add(rule)
    shared = urls.sparkSession.sparkContext.broadcast({h: (sorted({len(r) for r in own}), own) for h, own in held.items()})
    names = urls.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not any(path[:n] in own for n in lengths if n <= len(path)) for lengths, own, path in ((*shared.value.get(h, ((), ())), p or "") for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))]
            yield pa.RecordBatch.from_arrays(batch.columns[2:], names=names).filter(pa.array(keep, pa.bool_()))

    return urls.select(host.alias("__host"), path.alias("__path"), *names).mapInArrow(run, urls.schema)


def validators(rows: DataFrame) -> dict[str, Column]:
    """What each fetch says of the page's ``etag`` and ``last_modified``; null if nothing.

    An answer that came whole, or was too large, gives its own. A failed one says nothing of the page: there the request's count, from
    ``sent_etag`` and ``sent_last_modified`` where the log has them. Empty texts count as none.
    """
    answered = F.col("outcome").isin("ok", "not_modified", "content_too_large")
    sent = lambda c: F.col(f"sent_{c}") if f"sent_{c}" in rows.columns else F.lit(None).cast("string")
    return {c: F.nullif(F.when(answered, F.col(c)).otherwise(sent(c)), F.lit("")) for c in ("etag", "last_modified")}


def recrawl_state(log: DataFrame) -> DataFrame:
    """State of each url after its fetches: validators, attempts since the last success, backoff.

    The log is read once. Rows meet by url and word, a word being 64 places of ``seq``: its failures are the bits of a long, all else
    in it is the newest row that says so, so partial sums do, and a url with many fetches is many tasks' work. What is left of a url is a row
    for each word. Fetches that come twice count once; of several with one ``seq`` a success ends the failures. A row without a ``seq`` has
    no place: it counts for nothing but that its url is there.
    """
    rows = classify_fetch(log)
    seq = F.col("seq").cast("long")
    rows = rows.withColumns({**validators(rows), "ok": F.col("outcome").isin("ok", "not_modified"), "seq": seq, "__place": seq.bitwiseAND(63).cast("int")})
    newest = lambda c, on: F.max(F.when(on & F.col("seq").isNotNull(), F.struct("seq", F.col(c).alias("value"))))
    always = F.lit(True)
    figures = {
        "__good": newest("fetched_at", F.col("ok")),
        "__last": newest("fetched_at", always),
        "__status": newest("status", always),
        "__etag": newest("etag", F.col("etag").isNotNull()),
        "__modified": newest("last_modified", F.col("last_modified").isNotNull()),
    }
    failed = F.bit_or(F.when(~F.col("ok"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__place"))))
    words = rows.groupBy("url", F.shiftright("seq", 6).alias("__word")).agg(*(f.alias(k) for k, f in figures.items()), failed.alias("__failed"))

    # Only the bits above the last success count, and none below a word that has one.
    place = F.coalesce(F.col("__good.seq").bitwiseAND(63).cast("int"), F.lit(-1))
    above = F.when(place < 0, F.col("__failed")).otherwise(F.shiftrightunsigned(F.call_function("shiftrightunsigned", F.col("__failed"), place), 1))
    later = Window.partitionBy("url").orderBy(F.col("__word").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counted = words.withColumn("__later", F.max("__good.seq").over(later)).withColumn("__n", F.when(F.col("__later").isNull(), F.bit_count(above)))
    state = counted.groupBy("url").agg(*(F.max(k).alias(k) for k in figures), F.coalesce(F.sum("__n"), F.lit(0)).cast("int").alias("attempts"))
    wait = F.least(F.lit(BACKOFF_CAP), F.pow(F.lit(2.0), F.col("attempts")))
    until = F.when(F.col("attempts") > 0, F.timestamp_micros(F.unix_micros(F.col("__last.value").cast("timestamp")) + (wait * 1_000_000).cast("long")))
    return state.select("url", F.col("__etag.value").alias("etag"), F.col("__modified.value").alias("last_modified"), F.col("__status.value").alias("last_status"), "attempts", until.alias("backoff_until"), F.col("__good.value").alias("last_success_at"))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``attempts``, validators carried on and ``__run``, the successes so far, all within ``key``."""
    upto = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    in_run = Window.partitionBy(key, "__run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = {c: F.last(c, ignorenulls=True).over(upto) for c in ("etag", "last_modified")}
    return rows.withColumn("__run", F.count_if("ok").over(upto)).withColumn("attempts", F.count_if(~F.col("ok")).over(in_run).cast("int")).withColumns(carried)


def recrawl_attempts(log: DataFrame, hot_rows: int = 1 << 20) -> DataFrame:
    """Each fetch with the failures in a row up to it: the history behind ``recrawl_state``.

    Urls of ``hot_rows`` fetches or more are many tasks' work: their rows are numbered within chunks of 1,024 places of ``seq``, and what a
    chunk takes over from those before it comes from a table with a row for each chunk. Others are numbered whole. Rows without a ``seq`` come
    first; null urls are one url; rows that come twice count twice.
    """
    rows = classify_fetch(log)
    rows = rows.withColumns({**validators(rows), "ok": F.col("outcome").isin("ok", "not_modified")})
    names = [*rows.columns, "attempts"]
    hot = cut(rows.groupBy(F.col("url").alias("__hot")).agg(F.count("*").alias("__rows")).where(F.col("__rows") >= hot_rows))
    if hot.isEmpty():
        return _numbered(rows, "url").select(names)
    hot, same = broadcast_if_small(hot), F.col("url").eqNullSafe(F.col("__hot"))
    cold = _numbered(rows.join(hot, same, "left_anti"), "url").select(names)

    # A struct is never null, so that urls or places that are null meet, too.
    key = F.struct("url", F.shiftright(F.col("seq").cast("long"), 10).alias("chunk"))
    own = _numbered(rows.join(hot, same, "left_semi").withColumn("__key", key), "__key")
    carried = ("etag", "last_modified")
    ends = own.groupBy("__key").agg(F.max(F.struct("__run", "attempts")).alias("tail"), *(F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(c) for c in carried))
    by_chunk = lambda *part: Window.partitionBy(F.col("__key.url"), *part).orderBy(F.col("__key.chunk").asc_nulls_first())
    past = by_chunk().rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("since", F.count_if(F.col("tail.__run") > 0).over(by_chunk())).withColumn("open", F.sum("tail.attempts").over(by_chunk("since")))
    taken = ends.select("__key", F.lag("open", 1, 0).over(by_chunk()).alias("__open"), *(F.last(f"{c}.{c}", ignorenulls=True).over(past).alias(f"__{c}") for c in carried))
    attempts = F.col("attempts") + F.when(F.col("__run") == 0, F.col("__open")).otherwise(0)
    full = own.join(taken, "__key").withColumns({"attempts": attempts.cast("int"), **{c: F.coalesce(c, f"__{c}") for c in carried}})
    return cold.unionByName(full.select(names))


def plan_recrawl(frontier: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """``url, if_modified_since, etag`` of urls not backing off; a validator given with the url counts before stored ones, as a pair."""
    own = F.col("f.if_modified_since").isNotNull() | F.col("f.etag").isNotNull()
    joined = frontier.alias("f").join(state.alias("s"), "url", "left").where(F.coalesce(F.col("s.backoff_until") <= now, F.lit(True)))
    return joined.select("url", F.when(own, F.col("f.if_modified_since")).otherwise(F.col("s.last_modified")).alias("if_modified_since"), F.when(own, F.col("f.etag")).otherwise(F.col("s.etag")).alias("etag"))
