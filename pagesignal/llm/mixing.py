"""Mixing sources to target weights along a time-varying curriculum.

DataFrame functions only.

Targets: sources weigh in proportion to their weights and share all words; a source's target
stops at ``most_repeats`` times its size and what it can't take is shared anew by weight. That
fixed point is min(cap, level * weight) with one level, found from prefix sums over the sources
ordered by cap / weight.

Taking: a document is taken whole, once for every time its source is gone through in full, and
once more if it lies in the part of a last pass that the target still asks for. Documents of a
source are passed in the order of a hash. The running sums come in two steps: within
hash ranges of about ``range_rows`` documents, and over the ranges' totals; so a source that holds a third
of all rows is many small windows.

Positions: source s has the weight schedule 1 + ramp * (2t - 1) over training time t in [0, 1].
Its integral is the source's cumulative word demand; the time at which that reaches the
middle of a taken copy is the copy's position. Rows are range-sorted by position.

Nulls and edges: a null text has size 0; null sources are one source, the last. Sources of
no words have target 0. Rows of one source and doc_id follow each other by size; identical rows
are alike. Rows without a doc_id are ordered by text. Rows that share a doc_id lie in one range, whose size they may
raise. An empty table gives an empty result. Other columns pass through; helper columns begin with ``__mix``, and
columns named like the results are replaced. Words are counted in place, so a text of tens of millions of characters
costs no more than its bytes. Sources are few against documents: their prefix sums are one window each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_split


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weight: Column, most_repeats: int) -> DataFrame:
    """One row for each source of ``sized(source, size)``, with ``__mix_`` columns: number, rows, size, target.

    ``weight`` may use ``__mix_source``: the source's number by code point from 0, null last. There are
    few sources against documents, and one small window over them suffices.
    """
    named = sized.groupBy("source").agg(F.sum("size").alias("__mix_size"), F.count("*").alias("__mix_rows"))
    numbered = named.withColumn("__mix_source", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cap, w = F.col("__mix_size") * float(most_repeats), F.col("__mix_w")
    by_cap = Window.orderBy("__mix_ratio", "__mix_source")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum("__mix_size").over(whole) - F.coalesce(F.sum("__mix_cap").over(before), F.lit(0.0))) / F.sum("__mix_w").over(after)
    leveled = numbered.withColumn("__mix_w", weight.cast("double")).withColumn("__mix_cap", cap).withColumn("__mix_ratio", F.col("__mix_cap") / w).withColumn("__mix_level", level)
    # The first source, by cap / weight, that its share doesn't fill sets the level.
    open_level = F.min_by("__mix_level", F.when(F.col("__mix_level") <= F.col("__mix_ratio"), F.struct("__mix_ratio", "__mix_source"))).over(whole)
    return leveled.select("source", "__mix_source", "__mix_rows", "__mix_size", F.least("__mix_cap", F.coalesce(open_level, F.lit(0.0)) * w).alias("__mix_target"))


def mix(docs: DataFrame, *, weight: Column | None = None, ramp: Column | None = None, most_repeats: int = 3, range_rows: int = 8192, narrow: bool = False) -> DataFrame:
    """Every row of ``docs(doc_id, source, text, ...)`` with what the mix takes of it.

    Adds ``size, source_size, target, taken`` and ``positions``, the training positions of its copies in
    order (empty if it isn't taken). Columns of ``docs`` with those names are replaced. ``weight`` and
    ``ramp`` (from -1 to 1) may use ``__mix_source``; the defaults weigh sources 1, 2, 3 in turn and
    ramp them up, level and down in turn. ``narrow`` drops the text as soon as it is counted.
    """
    number = F.col("__mix_source")
    weight = number % 3 + 1 if weight is None else weight
    ramp = (number % 3 - 1) * F.lit(-0.5) if ramp is None else ramp
    # Rows without an id are ordered by their text, so that they don't all share one place in the order.
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    sized = docs.drop("size", "source_size", "target", "taken", "positions").withColumn("size", word_count(F.col("text"))).withColumn("__mix_order", order)
    if narrow:
        sized = cut(sized.drop("text"))
    sources = cut(source_targets(sized.select("source", "size"), weight, most_repeats).withColumn("__mix_ramp", ramp.cast("double")))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    right = sources.withColumn("__mix_name", key).withColumn("n", F.col("__mix_rows")).drop("source")
    # Rows are joined to their source's few figures; the side is broadcast while it is known to be small, and else for hot sources alone.
    named = sized.withColumn("__mix_name", key)
    if sources.count() <= 20_000:
        full = named.join(F.broadcast(right.drop("n")), "__mix_name")
    else:
        full = join_split(named, right, "__mix_name", sources.agg(F.sum("__mix_rows")).first()[0])
    full = full.drop("__mix_name")

    ranges = F.ceil(F.col("__mix_rows") / float(range_rows))
    placed = full.withColumn("__mix_range", F.floor(F.conv(F.substring("__mix_order", 1, 8), 16, 10).cast("double") / float(1 << 32) * ranges))
    narrow_sums = placed.groupBy("__mix_source", "__mix_range").agg(F.sum("size").alias("__mix_sum"))
    ahead = Window.partitionBy("__mix_source").orderBy("__mix_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = narrow_sums.select("__mix_source", "__mix_range", F.coalesce(F.sum("__mix_sum").over(ahead), F.lit(0)).alias("__mix_ahead"))
    within = Window.partitionBy("__mix_source", "__mix_range").orderBy("__mix_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("__mix_within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["__mix_source", "__mix_range"])
    start = F.col("__mix_ahead") + F.col("__mix_within")

    passes = F.when(F.col("__mix_size") > 0, F.floor(F.col("__mix_target") / F.col("__mix_size"))).otherwise(0)
    last = F.col("__mix_target") - passes * F.col("__mix_size")
    more = (start + F.col("size") / 2.0 < last).cast("long")
    middle = start + F.col("size") / 2.0
    copies = F.when(F.col("size") > 0, passes + more).otherwise(0)

    def when_of(k: Column) -> Column:
        y = F.least(F.lit(1.0), (k * F.col("__mix_size") + middle) / F.col("__mix_target"))
        b = F.col("__mix_ramp")
        return F.when(b == 0, y).otherwise((b - 1 + F.sqrt((1 - b) * (1 - b) + 4 * b * y)) / (2 * b))

    taken = summed.withColumn("__mix_copies", copies).withColumn("positions", F.when(F.col("__mix_copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("__mix_copies") - 1), when_of)).otherwise(F.array().cast("array<double>")))
    own = [c for c in sized.columns if c not in ("size", "__mix_order")]
    return taken.select(*own, "size", F.col("__mix_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_copies") * F.col("size")).alias("taken"), "positions")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The taken copies of ``docs`` in training order, with the columns of ``docs``; a document taken k times comes k times."""
    copies = mix(docs, **options).select(*docs.columns, F.explode("positions").alias("__mix_at"))
    return copies.orderBy("__mix_at", "doc_id").drop("__mix_at")
