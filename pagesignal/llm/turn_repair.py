"""Repair of conversation structure by the cheapest edits that make the roles follow a grammar.

Grammar of role initials: nothing, or ``s?(ua)+``. Edits: Keep (0), Rerole to user or assistant (3), Delete (4; the only one for a
blank or duplicate row), Insert an empty user or assistant row anywhere (3); a truncated row that stays adds 3. The audit is the
edits' initials in order; of equally cheap ones the least in ASCII order counts.

Method: rows are numbered within their conversation and cut into segments of 512 turns, which are dealt out by a hash. A task
takes its segments in batches of whole segments; a recursive DuckDB query over a batch advances all segments by one
turn at each step and keeps, for each state in which a segment can begin and each state of the grammar, the least cost and its audit. A second
such query joins the segments of a conversation end to end. An audit of the same rows and the same cost is never the beginning of
another, so the least audit of each state is all that must be kept.

The texts go through once more: each conversation's audit leads its rows, and a task hashes the repaired rows as they pass. Faults
are found on narrow rows with two 64-bit hashes of role and text.

Scale: a conversation of any number of turns is spread over tasks by its segments, its row numbers come from range-sorted runs, and duplicates from
partial aggregates. Only its audit (a letter a turn, part of the result) and the hash of its repaired text, which is sequential by its
nature, are one task's work, in bounded memory but for the audit.

Nulls and edges: null role and text are one space, so such a text is blank. Null conv_id is a conversation, written as one space for the damage; null
turns come first. Rows of one turn are ordered by role, then by hash of role and text; repeated rows are duplicates of the first. A
conversation whose rows are all dropped, and one without a repair but the empty one, gives zeros or its deletions, and the hash of the empty text. An
empty table gives none. Other columns are not read, whatever their names. Roles but s..., u... and a... can't be kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small
from ..operators.runs import by_group, group_starts, running

SEGMENT, BATCH_ROWS = 512, 20_000
BLANKS = " \t\n\x0b\x0c\r"

#: What can be inserted on the way from one state of the grammar to another: E nothing yet, S system, U user, A assistant last.
_INSERTS = {("E", "E"): 0, ("S", "S"): 0, ("U", "U"): 0, ("A", "A"): 0, ("E", "U"): 1, ("S", "U"): 1, ("A", "U"): 1, ("U", "A"): 1, ("E", "A"): 2, ("S", "A"): 2}


def moves() -> list[tuple[str, str, str, int, str]]:
    """``src, kind, dst, cost, letters`` for a row of each kind: its initial and, if truncated, t; x if it must go."""
    found = []
    for (src, mid), n in _INSERTS.items():
        for initial in "sua-x":
            for cut in "t", "":
                kind, extra = initial if initial == "x" else initial + cut, 3 * bool(cut)
                steps = [("D", mid, 4)]
                if initial != "x":
                    after = "A" if mid == "U" else "U"
                    steps.append(("R", after, 3 + extra))
                    if initial == after.lower():
                        steps.append(("K", after, extra))
                    if initial == "s" and mid == "E":
                        steps.append(("K", "S", extra))
                found += [(src, kind, dst, 3 * n + cost, "I" * n + letter) for letter, dst, cost in steps]
    return sorted(set(found))


_MOVES = pa.table(dict(zip(("src", "kind", "dst", "cost", "letters"), map(list, zip(*moves())))))

#: One step of the recursion takes every group of the batch on by one turn.
_WALK = """
WITH RECURSIVE walk AS (
  SELECT g, entry, 0::BIGINT AS i, entry AS state, 0::BIGINT AS cost, '' AS audit FROM begins
  UNION ALL
  SELECT g, entry, i, state, cost, audit FROM (
    SELECT w.g, w.entry, w.i + 1 AS i, m.dst AS state, w.cost + m.cost AS cost, w.audit || m.letters AS audit,
      row_number() OVER (PARTITION BY w.g, w.entry, m.dst ORDER BY w.cost + m.cost, w.audit || m.letters) AS place
    FROM walk w JOIN turns t ON t.g = w.g AND t.i = w.i JOIN moves m ON m.src = w.state AND m.kind = t.kind
  ) WHERE place = 1
)
SELECT g, entry, state, cost, audit FROM walk JOIN sizes USING (g) WHERE i = n ORDER BY g, entry, state
"""

#: The same over segments, each of which is one step.
_JOIN = """
WITH RECURSIVE walk AS (
  SELECT g, 0::BIGINT AS i, 'E' AS state, 0::BIGINT AS cost, '' AS audit FROM sizes
  UNION ALL
  SELECT g, i, state, cost, audit FROM (
    SELECT w.g, w.i + 1 AS i, s.state, w.cost + s.cost AS cost, w.audit || s.audit AS audit,
      row_number() OVER (PARTITION BY w.g, s.state ORDER BY w.cost + s.cost, w.audit || s.audit) AS place
    FROM walk w JOIN spans s ON s.g = w.g AND s.i = w.i AND s.entry = w.state
  ) WHERE place = 1
), ended AS (
  SELECT g, cost + 3 * length(tail) AS cost, audit || tail AS audit FROM walk JOIN sizes USING (g)
    JOIN (VALUES ('E', ''), ('A', ''), ('U', 'I'), ('S', 'II')) AS ends(state, tail) USING (state) WHERE i = n
)
SELECT g, arg_min(struct_pack(c := cost, a := audit), struct_pack(c := cost, a := audit)) AS best FROM ended GROUP BY g ORDER BY g
"""


def _asked(query: str, **tables: pa.Table) -> pa.Table:
    with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as db:
        for name, rows in tables.items():
            db.register(f"{name}_given", rows)
            db.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_given")
        return db.execute(query).to_arrow_table()


def _as_text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that the hash of each row's place calls for."""
    mark = F.crc32(F.concat(_as_text("conv_id"), F.lit(":"), _as_text("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn",
        F.when(mark == 4, "user").otherwise(role).alias("role"),
        F.when(mark == 1, "").when(mark == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(mark == 0, 0).when(mark == 3, 2).otherwise(1).alias("times"),
    ).where("times > 0")
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def with_hashes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(7), "text", "role"))


ORDER = ("turn", "role", "h1", "h2")


def faulty_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, at, turn, initial, fault`` of ``rows(conv_id, turn, role, text)``: row numbers from 0, the first fault or null."""
    initial = F.left("role", F.lit(1))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    narrow = with_hashes(rows).select("conv_id", *ORDER, F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    turns = running(narrow, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")], F.lit(0))
    # Joined by row number, which is unique, so a row that is repeated very often is no hot key.
    firsts = turns.where("NOT blank").groupBy("conv_id", "h1", "h2").agg(F.min("__at").alias("__first")).select(F.col("conv_id").alias("__conv"), "__first")
    marked = turns.join(firsts, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__at") == F.col("__first")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("__first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return marked.select("conv_id", F.col("__at").alias("at"), "turn", "initial", fault.alias("fault"))


_FIGURES = ("blank", "duplicate", "truncated", "illegal", "turns")


def _in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with where these begin; many small groups come together."""
    waiting: list[pa.Table] = []
    rows = 0
    for table in by_group(batches, keys):
        waiting.append(table)
        rows += table.num_rows
        if rows >= BATCH_ROWS:
            whole = pa.concat_tables(waiting).combine_chunks()
            yield whole, group_starts(whole, keys)
            waiting, rows = [], 0
    if waiting:
        whole = pa.concat_tables(waiting).combine_chunks()
        yield whole, group_starts(whole, keys)


def segment_paths(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The cheapest audit of each segment from each state it can begin in to each it can end in, with the segment's figures."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.select("conv_id", F.floor(F.col("at") / segment).cast("long").alias("segment"), "at", F.col("turn").cast("long").alias("turn"), "initial", "fault")
    dealt = dealt.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _in_groups(batches, 2):
            ends = np.append(begins[1:], rows.num_rows)
            g = np.repeat(np.arange(len(begins)), ends - begins)
            initial, fault, turn = (rows.column(c).to_pylist() for c in ("initial", "fault", "turn"))
            kinds = ["x" if f in ("blank", "duplicate") else i + "t" * (f == "truncated") for i, f in zip(initial, fault)]
            number = rows.column("segment").to_numpy()[begins]
            entries = [(k, e) for k, s in enumerate(number.tolist()) for e in ("E" if s == 0 else "ESUA")]
            found = _asked(
                _WALK, moves=_MOVES, sizes=pa.table({"g": np.arange(len(begins)), "n": ends - begins}), begins=pa.table({"g": [k for k, _ in entries], "entry": [e for _, e in entries]}),
                turns=pa.table({"g": g, "i": np.arange(len(g)) - begins[g], "kind": kinds}),
            )
            figures = {c: [] for c in (*_FIGURES, "first_turn", "last_turn", "first_initial", "last_initial")}
            for a, b in zip(begins.tolist(), ends.tolist()):
                own = [t for t in turn[a:b] if t is not None]
                figures["turns"].append(len(set(own)))
                figures["first_turn"].append(own[0] if own else None)
                figures["last_turn"].append(own[-1] if own else None)
                figures["first_initial"].append(initial[a])
                figures["last_initial"].append(initial[b - 1])
                figures["illegal"].append(illegal(initial[a:b]))
                for name in ("blank", "duplicate", "truncated"):
                    figures[name].append(fault[a:b].count(name))
            of = found.column("g").combine_chunks()
            first = pa.array(begins).take(of)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c).combine_chunks().take(first) for c in ("conv_id", "segment")), *(found.column(c).combine_chunks() for c in ("entry", "state", "cost", "audit")), *(pa.array(v, pa.string() if "initial" in c else pa.int64()).take(of) for c, v in figures.items())],
                names=["conv_id", "segment", "entry", "state", "cost", "audit", *figures],
            )

    return dealt.mapInArrow(run, f"conv_id {kind}, segment long, entry string, state string, cost long, audit string, " + ", ".join(f"{c} long" for c in (*_FIGURES, "first_turn", "last_turn")) + ", first_initial string, last_initial string")


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def conversation_audits(paths: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` from the segments of each conversation, joined end to end."""
    kind = paths.schema["conv_id"].dataType.simpleString()
    dealt = paths.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "entry", "state")
    most = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _in_groups(batches, 1):
            ends = np.append(begins[1:], rows.num_rows)
            g = np.repeat(np.arange(len(begins)), ends - begins)
            leads = group_starts(rows.select(["conv_id", "segment"]), 2)  # the first row of each segment
            size = np.bincount(g[leads], minlength=len(begins))
            spans = pa.table({"g": g, "i": rows.column("segment"), **{c: rows.column(c) for c in ("entry", "state", "cost", "audit")}})
            best = _asked(_JOIN, spans=spans, sizes=pa.table({"g": np.arange(len(begins)), "n": size})).column("best").to_pylist()
            held = rows.take(pa.array(leads)).to_pylist()
            out: dict[str, list] = {c: [] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}
            at = 0
            for k, n in enumerate(size.tolist()):
                own, at = held[at : at + n], at + n
                for c in ("blank", "duplicate", "truncated"):
                    out[c].append(sum(x[c] for x in own))
                out["illegal"].append(sum(x["illegal"] for x in own) + sum(illegal([a["last_initial"], b["first_initial"]]) for a, b in zip(own, own[1:])))
                timed = [x for x in own if x["turns"]]
                turns = sum(x["turns"] for x in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
                out["gaps"].append(min(most, timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns) if timed else 0)
                out["cost"].append(best[k]["c"])
                out["audit"].append(best[k]["a"])
            yield pa.RecordBatch.from_arrays([rows.column("conv_id").combine_chunks().take(pa.array(begins)), *(pa.array(v, pa.string() if c == "audit" else pa.int64()) for c, v in out.items())], names=["conv_id", *out])

    return dealt.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class Rewriter:
    """The repaired rows of a conversation, from its rows in order and its audit."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.turns = audit, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._next(), ""

    def _next(self) -> str:
        self.turns += 1
        return "user" if self.turns % 2 else "assistant"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "R":
            yield self._next(), text
        elif letter == "K":
            if role[:1] != "s":
                self._next()
            yield role, text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def repaired(rows: DataFrame, audits: DataFrame, everyone: DataFrame) -> DataFrame:
    """The audits with ``repaired_sha256``, a row for each conv_id of ``everyone``; conversations without rows have zeros.

    Audits and rows come to a task in order of conversation, the audit first, so a conversation's texts only pass by.
    """
    kind = everyone.schema["conv_id"].dataType.simpleString()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = lambda names, t: [F.lit(None).cast(t).alias(c) for c in names]
    own = [*(f"{c} long" for c in numbers), "audit string"]
    lead = audits.select("conv_id", F.lit(1).alias("__step"), *none(["turn"], "long"), *none(["role"], "string"), *none(["text"], "string"), *none(["h1", "h2"], "long"), *numbers, "audit")
    name = everyone.select("conv_id").distinct().select("conv_id", F.lit(0).alias("__step"), *none(["turn"], "long"), *none(["role", "text"], "string"), *none(["h1", "h2"], "long"), *none(numbers, "long"), *none(["audit"], "string"))
    told = with_hashes(rows).select("conv_id", F.lit(2).alias("__step"), F.col("turn").cast("long").alias("turn"), "role", "text", "h1", "h2", *none(numbers, "long"), *none(["audit"], "string"))
    stream = name.unionByName(lead).unionByName(told).repartition("conv_id").sortWithinPartitions("conv_id", "__step", F.col("turn").asc_nulls_first(), "role", "h1", "h2").select("conv_id", "__step", "role", "text", *numbers, "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rewriter, digest, any_row = None, None, None, False

        def add(found: Iterator[tuple[str, str]]) -> None:
            nonlocal any_row
            for role, text in found:
                digest.update(("\n" * any_row + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                any_row = True

        def ended() -> dict:
            add(rewriter.rest())
            return {**held, "repaired_sha256": digest.hexdigest()}

        for batch in small(batches):
            done = []
            for row in batch.to_pylist():
                step, role, text = row.pop("__step"), row.pop("role"), row.pop("text")
                if step == 0:
                    if held is not None:
                        done.append(ended())
                    held, rewriter, digest, any_row = {**row, **dict.fromkeys(numbers, 0), "audit": ""}, Rewriter(""), hashlib.sha256(), False
                elif step == 1:
                    held, rewriter = row, Rewriter(row["audit"])
                else:
                    add(rewriter.row(role, text))
            if done:
                yield _as_batch(done, batch)
        if held is not None:
            yield _as_batch([ended()], batch)

    def _as_batch(rows: list[dict], like: pa.RecordBatch) -> pa.RecordBatch:
        names = ["conv_id", *numbers, "audit", "repaired_sha256"]
        types = {"conv_id": like.schema.field("conv_id").type, "audit": pa.string(), "repaired_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.int64())) for c in names], names=names)

    return stream.mapInArrow(run, f"conv_id {kind}, {', '.join(own)}, repaired_sha256 string")


def repair(rows: DataFrame, everyone: DataFrame, *, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of ``rows(conv_id, turn, role, text)``."""
    audits = conversation_audits(segment_paths(faulty_turns(rows), segment))
    return repaired(rows, audits, everyone)
