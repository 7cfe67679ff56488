"""Conversation repair and chat formatting against brute force and round trips."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pagesignal.llm import chat, queries, turn_repair
from pagesignal.operators import runs

CONVERSATIONS = "conv_id long, turn long, role string, text string"
CLASHING = ("at", "segment", "h1", "cost", "audit", "step", "window", "tie", "__at", "times")


def framed(spark, rows):
    return spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit(1) for c in CLASHING})


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))


# --- running sums ----------------------------------------------------------------------------


def test_running_sums_over_hot_null_and_repeated_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.randrange(50)) for _ in range(4000)] + [(1, 7)] * 3000
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = runs.running(df, "k", [F.col("v")], F.col("v") + 1).collect()
    for key in {k for k, _ in rows}:
        own = sorted((r["__at"], r["v"], r["__before"]) for r in got if r["k"] == key)
        assert [v for _, v, _ in own] == sorted(v for k, v in rows if k == key)
        assert [a for a, _, _ in own] == list(range(len(own)))
        assert [b for _, _, b in own] == [0, *itertools.accumulate(v + 1 for _, v, _ in own)][:-1]


# --- 12: repair ------------------------------------------------------------------------------


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        out += [(conv, turn, "user" if mark == 4 else role, text)] * {0: 0, 3: 2}.get(mark, 1)
    return out


def faults_of(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        found.append(fault)
    return found


LEGAL = re.compile("(s?(ua)+)?")


def exhaustive(rows, faults):
    """All edits with at most two insertions in a gap: cost, audit, and repaired rows of the cheapest."""
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = []
    for (_, _, role, text), fault in zip(rows, faults):
        own = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            extra = 3 * (fault == "truncated")
            own += [("K", extra, (role, text)), ("R", 3 + extra, ("user", text)), ("R", 3 + extra, ("assistant", text))]
        choices.append(own)
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(*choices):
            kept, audit, cost = [(r, "") for r in gaps[0]], "I" * len(gaps[0]), 3 * len(gaps[0])
            for (letter, price, row), gap in zip(edits, gaps[1:]):
                kept += [row] * (row is not None) + [(r, "") for r in gap]
                audit, cost = audit + letter + "I" * len(gap), cost + price + 3 * len(gap)
            if (best is None or (cost, audit) < best[:2]) and LEGAL.fullmatch("".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for r, _ in kept)):
                best = (cost, audit, kept)
    return best


def relaxed(rows, faults):
    """The same by shortest paths over (rows done, output so far as it matters), for longer conversations."""
    held = {"E": (0, "", ())}
    into = {"u": "ESA", "a": "U", "s": "E"}
    name = {"u": "user", "a": "assistant"}

    def put(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, kept) in list(table.items()):
                for initial in "ua":
                    if state in into[initial]:
                        put(table, initial.upper(), (cost + 3, audit + "I", (*kept, (name[initial], ""))))
        return table

    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, kept) in inserted(dict(held)).items():
            put(after, state, (cost + 4, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            for initial in "ua":
                if state in into[initial]:
                    put(after, initial.upper(), (cost + 3 + extra, audit + "R", (*kept, (name[initial], text))))
            if state in into.get(role[:1], ""):
                put(after, role[:1].upper(), (cost + extra, audit + "K", (*kept, (role, text))))
        held = after
    return min(v for s, v in inserted(held).items() if s in "EA")


def brute_repair(rows, everyone, solve=relaxed):
    out = []
    for conv in {r[0] for r in everyone}:
        own = in_order([r for r in rows if r[0] == conv])
        faults = faults_of(own)
        cost, audit, kept = solve(own, faults) if own else (0, "", ())
        turns = [t for _, t, _, _ in own if t is not None]
        initials = [r[:1] for _, _, r, _ in own]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def random_rows(rng, convs, longest):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, longest + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "ultra", "", None])
            text = rng.choice([f"Text {turn}.", f"text {turn}", "same.", "", "  \n", "Why?  ", None, "no end", "é!\n"])
            rows.append((conv, turn * rng.choice([1, 1, 1, 3]) + 100 * (turn > 2), role, text))
    return rows


def test_moves_follow_the_grammar():
    assert LEGAL.fullmatch("") and not LEGAL.fullmatch("s")
    assert all(dst in "ESUA" and len(letters) <= 3 for _, _, dst, _, letters in turn_repair.moves())


def test_short_conversations_match_every_edit(spark):
    rng = random.Random(5)
    rows = [r for r in random_rows(rng, 60, 3)]
    by_conv = {c: in_order([r for r in rows if r[0] == c]) for c, *_ in rows}
    # Ties of turn would leave the order open.
    rows = [r for c, own in by_conv.items() if len({t for _, t, _, _ in own}) == len(own) for r in own]
    got = sorted(map(tuple, turn_repair.repair(framed(spark, rows).select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")), framed(spark, rows)).collect()), key=str)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == brute_repair(plain, rows, exhaustive) == brute_repair(plain, rows)


@pytest.mark.parametrize("segment", [3, 512])
def test_damage_and_repair_match_brute_force(spark, segment, monkeypatch):
    monkeypatch.setattr(turn_repair, "BATCH_ROWS", 40)
    rng = random.Random(segment)
    rows = []
    for conv in [*range(40), None]:
        turns = rng.sample(range(60), rng.choice([1, 2, 5, 30]))
        rows += [(conv, t, rng.choice(["user", "assistant", "system", None, "x"]), rng.choice([f"a{t}.", f"b{t}", "same!", "", None])) for t in turns]
    rows += [(500, None, "user", "Hi."), (501, 3, None, None), *[(502, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(700)]]
    rows += [(c, t, "user", "Dropped.") for c in range(600, 603) for t in range(200) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    frame = framed(spark, rows)
    got = sorted(map(tuple, turn_repair.repair(turn_repair.damaged(frame), frame, segment=segment).collect()), key=str)
    assert got == brute_repair(brute_damage(rows), rows)
    assert (600, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_repeated_rows_extreme_turns_and_no_rows(spark):
    big = (1 << 63) - 1
    rows = [(1, 5, "user", "Same?")] * 30 + [(2, -big, "user", "A."), (2, big, "assistant", "B.")]
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    one, two = sorted(turn_repair.repair(frame, frame, segment=4).collect())
    assert (one["duplicate"], one["cost"], one["illegal"]) == (29, 29 * 4 + 3, 29) and one["audit"] == "K" + "D" * 29 + "I"
    assert (two["gaps"], two["cost"], two["audit"]) == (big, 0, "KK")
    assert turn_repair.repair(frame.limit(0), frame.limit(0)).collect() == []


# --- 13: chat --------------------------------------------------------------------------------

HARD = ["", "###", "####", "\\###", "\\\\###", "</turn>", "\\</turn>\n", "\n</turn>\n", "### Assistant: hi\n</turn>\n### User: ", "ends with \\", "\\", "a\r\nb", r"\### Assistant: </turn> ok", "##", "</turn", "é😀" * 50]


def test_escaping_is_reversible():
    rng = random.Random(2)
    made = ["".join(rng.choices(["\\", "#", "###", "</turn>", "<", "/turn>", "\n", "x", " "], k=rng.randrange(12))) for _ in range(3000)]
    for text in HARD + made:
        assert chat.unescape(chat.escape(text)) == text and chat.END not in chat.escape(text)
    for role in ["user", "assistant", "system", "", "tool", 'a"b: c', "</turn>", "### x", "\n</turn>\n", "User", "é\\"]:
        turns = [(role, t) for t in HARD + made[:40]]
        assert chat.read_back(chat.write_window([], turns)[0]) == turns


def test_windows_keep_to_the_budget():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(300):
        cost, system = rng.integers(1, 60, rng.integers(0, 40)), int(rng.integers(0, 30))
        first = int(rng.integers(0, len(cost) + 1))
        got = chat.choose_windows(cost, first, system, 100, 25, 2)
        assert [i for _, a, b in got for i in range(a, b)] == list(range(first, len(cost)))
        for low, a, b in got:
            assert a - low <= 2 and cost[low:a].sum() <= 25
            assert system + cost[low:b].sum() <= 100 or (low == a and b == a + 1)
            # No more turns would fit, and no more history.
            assert b == len(cost) or low == a or system + cost[low : b + 1].sum() > 100


def read_all(rows):
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 straight from the rows."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [(r or "", t or "") for _, _, r, t in in_order([r for r in rows if r[0] == conv])]
        loss = "".join(t for r, t in own if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for r, t in own)
        out.append((conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def chat_rows(rng):
    rows = [(1, 0, "system", "Be brief.")] + [(1, t, "user" if t % 2 else "assistant", f"Turn {t} " + rng.choice(HARD) * 3) for t in range(1, 300)]
    rows += [(None, t, rng.choice(["user", "assistant", "tool", None]), rng.choice([*HARD, None])) for t in range(60)]
    rows += [(2, 0, "system", "only"), (3, 0, None, None), (4, None, "assistant", "null turn"), (4, 1, "user", "x"), (5, 0, "system", "s" * 3000), (5, 1, "assistant", "word " * 3000), (5, 2, "user", "u"), (5, 3, "system", "late")]
    return rows


@pytest.mark.parametrize("segment_bytes", [600, 3000, 8 << 20])
def test_chat_reads_back_what_it_wrote(spark, segment_bytes):
    rows = chat_rows(random.Random(4))
    wins = chat.windows(framed(spark, rows), queries.tokenizer_path(), budget=200, history_tokens=60, history_turns=3, segment_bytes=segment_bytes, history_bytes=200)
    got = sorted((tuple(r)[:5] for r in chat.digests(wins).collect()), key=str)
    assert got == read_all(rows)
    held = wins.collect()
    seen = {}
    for w in sorted(held, key=lambda w: (str(w["conv_id"]), w["segment"], w["window"])):
        turns = chat.read_back(w["text"])
        fresh, last = (w["segment"], w["window"]) == (0, 0), seen.setdefault(w["conv_id"], [])
        if w["conv_id"] in (1, 5) and not fresh:
            assert turns[0][0] == "system" and w["context"] >= 1
        repeated = [t for t in turns[: w["context"]] if t[0] != "system"]
        assert repeated == last[len(last) - len(repeated) :]
        beside_system = sum(t[0] != "system" or i >= 1 for i, t in enumerate(turns)) - len(repeated)
        assert w["n_tokens"] <= 200 or beside_system <= 1 and not repeated
        assert len(w["spans"]) == sum(r == "assistant" for r, _ in turns[w["context"] :])
        last += turns[w["context"] :]
    assert any(w["context"] > 1 for w in held)


def test_repeated_turns_and_no_rows(spark):
    rows = [(1, 1, "assistant", "same")] * 20
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    wins = chat.windows(frame, queries.tokenizer_path(), budget=40, segment_bytes=300, history_bytes=10)
    assert [tuple(r)[:5] for r in chat.digests(wins).collect()] == read_all(rows)
    assert chat.digests(chat.windows(frame.limit(0), queries.tokenizer_path())).collect() == []


def test_probe_comes_back(spark):
    got = chat.digests(chat.windows(chat.probe(spark), queries.tokenizer_path())).collect()
    text = r"\### Assistant: </turn> ok"
    assert [tuple(r)[:5] for r in got] == read_all([(-7, 0, "user", text), (-7, 1, "assistant", text)])
