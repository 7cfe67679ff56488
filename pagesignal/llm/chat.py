r"""Chat formatting in budgeted windows.

Template: each turn is ``### Role: text``, a line feed, ``</turn>`` and a line feed. Inside texts the control strings ``###`` and ``</turn>``
get a backslash, and backslashes directly before them are doubled, so what was escaped can be told from what wasn't and reading
back gives each text exactly. Roles but the three usual ones are written as JSON strings.

Windows: the tokens of each formatted turn are summed in order; from a window's first turn the running sums give, by bisection, the last turn
that the budget allows. A window begins with the conversation's system turn, if it has one, then the turns before its
first one that fit ``history_tokens`` and ``history_turns``, then its own turns. The loss mask covers the texts of the assistant turns among
its own, so a turn that is repeated as history is never a target twice. A turn over the budget has a window of its own, without history.

Scale: conversations of up to ``segment_bytes`` are dealt out by a hash and written window by window. Longer ones are cut into segments by
running sums over range-sorted rows; a segment gets the system turn and the last turns before it along, so its windows are written like those
of a whole conversation. A task holds one segment at a time. Windows end where segments end.

Nulls and edges: a null text or role is an empty one. Null conv_ids are one conversation. Null turns come first; rows of one turn are ordered by
role, then by a hash of role and text; repeated rows are turns of their own. Only a first row with the role system counts as the system turn. An
empty table gives none. Other columns are not read, whatever their names. A very long text is held whole, a few times its size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small
from ..operators.runs import by_group, group_starts, running
from .tokens import encoder

END = "\n</turn>\n"
_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_ESCAPED = re.compile(r"(\\+)(###|</turn>)")
_USUAL = {"system": "System", "user": "User", "assistant": "Assistant"}


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def heading(role: str) -> str:
    return f"### {_USUAL.get(role) or json.dumps(role).replace('#', chr(92) + 'u0023').replace('</', '<' + chr(92) + '/')}: "


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns ``(role, text)`` of a window's text."""
    turns, at = [], 0
    while at < len(formatted):
        begins = at + 4
        if formatted[begins] == '"':
            role, ends = json.JSONDecoder().raw_decode(formatted, begins)
        else:
            ends = formatted.index(":", begins)
            role = formatted[begins:ends].lower()
        # An escaped end mark has a backslash before it, so the next plain one ends the turn.
        until = formatted.index(END, ends + 2)
        turns.append((role, unescape(formatted[ends + 2 : until])))
        at = until + len(END)
    return turns


def choose_windows(cost: np.ndarray, first: int, system: int, budget: int, history_tokens: int, history_turns: int) -> list[tuple[int, int, int]]:
    """``(history begins, own begins, own ends)`` of each window over turns of these costs, of which those before ``first`` are only history.

    ``system``: tokens of the system turn that every window begins with.
    """
    sums, windows, at = np.concatenate([[0], np.cumsum(cost)]), [], first
    while at < len(cost):
        low = max(at - history_turns, int(np.searchsorted(sums, sums[at] - history_tokens, "left")), 0)
        end = int(np.searchsorted(sums, sums[low] + budget - system, "right")) - 1
        if end <= at:  # the history leaves no room for the next turn
            low = at
            end = max(at + 1, int(np.searchsorted(sums, sums[at] + budget - system, "right")) - 1)
        windows.append((low, at, end))
        at = end
    return windows


def write_window(context: list[tuple[str, str]], own: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a window and the spans of its targets, in code points."""
    parts, spans, at = [], [], 0
    for k, (role, text) in enumerate([*context, *own]):
        head, body = heading(role), escape(text)
        if k >= len(context) and role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def _segments(rows: DataFrame, segment_bytes: int, history_bytes: int) -> DataFrame:
    """``rows`` with their segment and step: 2 for its own turns, 1 for turns before it, 0 for the system turn of an earlier one."""
    size = (F.octet_length("text") + F.octet_length("role") + 64).cast("long")
    totals = rows.groupBy("conv_id").agg(F.sum(size).alias("__total")).where(F.col("__total") > segment_bytes).withColumnRenamed("conv_id", "__conv")
    whole = rows.withColumns({"segment": F.lit(0).cast("long"), "step": F.lit(2)})
    n_long = totals.limit(100_001).count()
    if not n_long:
        return whole
    if n_long <= 100_000:
        totals = F.broadcast(totals)
    same = F.col("conv_id").eqNullSafe(F.col("__conv"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    laid = running(rows.join(totals, same).drop("__conv"), "conv_id", order, size)
    begin, end = F.col("__before"), F.col("__before") + size
    of = lambda at: F.floor(at / segment_bytes).cast("long")
    system = (F.col("__at") == 0) & (F.col("role") == "system")
    last = of(F.col("__total") - 1)
    place = lambda s, step: F.struct(s.alias("segment"), F.lit(step).alias("step"))
    later = F.filter(F.array_distinct(F.array(of(end), of(end + history_bytes))), lambda s: (s > of(begin)) & (s <= last))
    copies = F.when(system & (last > of(begin)), F.transform(F.sequence(of(begin) + 1, last), lambda s: place(s, 0))).when(system, F.array().cast("array<struct<segment:bigint,step:int>>")).otherwise(F.transform(later, lambda s: place(s, 1)))
    spread = laid.withColumn("__place", F.explode(F.concat(F.array(place(of(begin), 2)), copies)))
    cut = spread.select(*rows.columns, F.col("__place.segment").alias("segment"), F.col("__place.step").alias("step"))
    return whole.join(totals, same, "left_anti").unionByName(cut)


def windows(conversations: DataFrame, path: str, *, budget: int = 1024, history_tokens: int = 256, history_turns: int = 4, segment_bytes: int = 8 << 20, history_bytes: int = 1 << 16) -> DataFrame:
    """``conv_id, segment, window, text, spans, context, n_tokens``: the windows of ``conversations(conv_id, turn, role, text)``.

    ``spans``: the loss mask, from and to code points of ``text``; ``context``: how many of its turns are repeated from earlier windows.
    ``path``: a byte-level BPE file of the tokenizers library.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    dealt = _segments(rows, segment_bytes, history_bytes).repartition("conv_id", "segment")
    dealt = dealt.sortWithinPartitions("conv_id", "segment", "step", F.col("turn").asc_nulls_first(), "role", "tie").select("conv_id", "segment", "step", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for table in by_group(small(batches), 2):
            begins = group_starts(table, 2)
            steps, roles, texts = (table.column(c).to_pylist() for c in ("step", "role", "text"))
            cost = np.array([len(encode(heading(r) + escape(t) + END)) for r, t in zip(roles, texts)], np.int64)
            found: list[tuple] = []
            segments = table.column("segment").to_pylist()
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(steps)]):
                found += [(a, *w) for w in _of_segment(segments[a], steps[a:b], list(zip(roles[a:b], texts[a:b])), cost[a:b])]
            if found:
                of, number, text, spans, context, n = map(list, zip(*found))
                lead = pa.array(of, pa.int64())
                keys = (table.column(c).combine_chunks().take(lead) for c in ("conv_id", "segment"))
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(number, pa.int32()), pa.array(text, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(context, pa.int32()), pa.array(n, pa.int64())],
                    names=["conv_id", "segment", "window", "text", "spans", "context", "n_tokens"],
                )

    def _of_segment(segment: int, steps: list[int], turns: list[tuple[str, str]], cost: np.ndarray) -> Iterator[tuple]:
        leads, own_system = steps[0] == 0, segment == 0 and turns[0][0] == "system"
        skip = int(leads or own_system)
        first = skip + sum(s == 1 for s in steps)
        chosen = choose_windows(cost[skip:], first - skip, int(cost[0]) if skip else 0, budget, history_tokens, history_turns) or ([(0, 0, 0)] if own_system else [])
        for k, (low, at, end) in enumerate(chosen):
            with_system = turns[:1] if skip else []
            history, own = turns[skip + low : skip + at], turns[skip + at : skip + end]
            if own_system and k == 0:
                text, spans = write_window([], with_system + own)
                context = 0
            else:
                text, spans = write_window(with_system + history, own)
                context = len(with_system) + len(history)
            yield k, text, [list(s) for s in spans], context, int(cost[:skip].sum() + cost[skip + low : skip + end].sum())

    return dealt.mapInArrow(run, f"conv_id {kind}, segment long, window int, text string, spans array<array<long>>, context int, n_tokens long")


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from windows.

    A conversation's windows pass by in order; what is held is the state of the two hashes.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.select("conv_id", "segment", "window", "text", "spans", "context").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns, loss = None, None, None
        for batch in small(batches):
            done = []
            for row in batch.to_pylist():
                if held is None or held["conv_id"] != row["conv_id"]:
                    if held is not None:
                        done.append({**held, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()})
                    held, turns, loss = {"conv_id": row["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}, hashlib.sha256(), hashlib.sha256()
                own = read_back(row["text"])[row["context"] :]
                held["n_turns"] += len(own)
                held["formatted_chars"] += len(row["text"])
                for role, text in own:
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for begin, end in row["spans"]:
                    target = unescape(row["text"][begin:end])
                    held["loss_chars"] += len(target)
                    loss.update(target.encode("utf-8", "surrogatepass"))
            if done:
                yield _as_batch(done, batch)
        if held is not None:
            yield _as_batch([{**held, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}], batch)

    def _as_batch(rows: list[dict], like: pa.RecordBatch) -> pa.RecordBatch:
        types = {"conv_id": like.schema.field("conv_id").type, "turns_sha256": pa.string(), "loss_sha256": pa.string()}
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.int64())) for c in names], names=names)

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose two texts hold the template's own control strings."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
