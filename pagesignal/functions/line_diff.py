"""Line diffs: the shortest edit script in linear space, written and applied as a unified diff.

Equal lines are numbers from one table, so a comparison of lines is one of whole numbers, and runs of equal lines are skipped by comparing slices. The
script is found by searching from both ends for the middle of a shortest path and halving there, which takes time (lines) x (edits) at worst and
no more memory than the lines. Past ``MOST_EDITS`` edits a region is cut at the lines that each side has once, in a longest
common order, and where there are none it is replaced whole: still a right script, but not always the shortest.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

MOST_EDITS, CONTEXT = 600, 3


def _run(a: list[int], b: list[int], x: int, y: int, most: int) -> int:
    """How many lines from ``a[x]`` and ``b[y]`` on are equal, at most ``most``."""
    n, step = 0, 1
    while n < most and a[x + n] == b[y + n]:
        n += 1
        while step <= most - n and a[x + n : x + n + step] == b[y + n : y + n + step]:
            n, step = n + step, min(2 * step, 4096)
        step = max(1, step // 8)
    return n


def _run_back(a: list[int], b: list[int], x: int, y: int, most: int) -> int:
    """The same towards the front from ``a[x - 1]`` and ``b[y - 1]``."""
    n, step = 0, 1
    while n < most and a[x - n - 1] == b[y - n - 1]:
        n += 1
        while step <= most - n and a[x - n - step : x - n] == b[y - n - step : y - n]:
            n, step = n + step, min(2 * step, 4096)
        step = max(1, step // 8)
    return n


def _middle(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int] | None:
    """A point on a shortest path between the corners, other than these; None past ``MOST_EDITS``."""
    n, m = a1 - a0, b1 - b0
    odd = (n - m) % 2
    front, back = {1: 0}, {1: 0}
    for d in range((min(n + m, MOST_EDITS) + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = front[k + 1] if k == -d or k != d and front.get(k - 1, -1) < front.get(k + 1, -1) else front[k - 1] + 1
            y = x - k
            if x > n or y > m or y < 0:
                front[k] = min(x, n + 1)
                continue
            x += _run(a, b, a0 + x, b0 + y, min(n - x, m - y))
            front[k] = x
            other = n - m - k
            if odd and -(d - 1) <= other <= d - 1 and other in back and x + back[other] >= n and 0 <= x - k <= m:
                return a0 + x, b0 + x - k
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or k != d and back.get(k - 1, -1) < back.get(k + 1, -1) else back[k - 1] + 1
            y = x - k
            if x > n or y > m or y < 0:
                back[k] = min(x, n + 1)
                continue
            x += _run_back(a, b, a1 - x, b1 - y, min(n - x, m - y))
            back[k] = x
            other = n - m - k
            if not odd and -d <= other <= d and other in front and x + front[other] >= n and 0 <= x - k <= m:
                return a1 - x, b1 - (x - k)
    return None


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of lines that each side has once, in a longest common order."""
    once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {v: j for j, v in enumerate(b[b0:b1], b0) if once_b[v] == 1}
    pairs = [(i, at[v]) for i, v in enumerate(a[a0:a1], a0) if once_a[v] == 1 and v in at]
    tails: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for p, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
        last[k : k + 1] = [p]
        before.append(last[k - 1] if k else -1)
    chain, p = [], last[-1] if last else -1
    while p >= 0:
        chain.append(pairs[p])
        p = before[p]
    return chain[::-1]


def matches(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Runs ``(place in a, place in b, length)`` of equal lines that the script keeps, in order."""
    found: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        same = _run(a, b, a0, b0, min(a1 - a0, b1 - b0))
        if same:
            found.append((a0, b0, same))
            a0, b0 = a0 + same, b0 + same
        same = _run_back(a, b, a1, b1, min(a1 - a0, b1 - b0))
        if same:
            found.append((a1 - same, b1 - same, same))
            a1, b1 = a1 - same, b1 - same
        if a0 == a1 or b0 == b1:
            continue
        middle = _middle(a, b, a0, a1, b0, b1)
        if middle and middle not in ((a0, b0), (a1, b1)):
            x, y = middle
            todo += [(a0, x, b0, y), (x, a1, y, b1)]
        elif not middle and (chain := _anchors(a, b, a0, a1, b0, b1)):
            found += [(i, j, 1) for i, j in chain]
            corners = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            todo += [(i + 1, x, j + 1, y) for (i, j), (x, y) in zip(corners, corners[1:])]
    return sorted(found)


def edits(before: list[str], after: list[str]) -> list[tuple[int, int, int, int]]:
    """``(a0, a1, b0, b1)``: the ranges of lines of ``before`` that ranges of ``after`` replace, in order."""
    number: dict[str, int] = {}
    a = [number.setdefault(x, len(number)) for x in before]
    b = [number.setdefault(x, len(number)) for x in after]
    out, i, j = [], 0, 0
    for x, y, n in [*matches(a, b), (len(a), len(b), 0)]:
        if x > i or y > j:
            out.append((i, x, j, y))
        i, j = x + n, y + n
    return out


def _hunks(changes: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
    """Changes whose surroundings touch come together."""
    group: list[tuple[int, int, int, int]] = []
    for change in changes:
        if group and change[0] - group[-1][1] > 2 * CONTEXT:
            yield group
            group = []
        group.append(change)
    if group:
        yield group


def _range(begin: int, n: int) -> str:
    return f"{begin + (n > 0)},{n}" if n != 1 else f"{begin + 1}"


def unified(before: str, after: str, path: str) -> str:
    """The unified diff of two texts; empty if they are equal. A last line without a line feed is followed by a note, as patch tools write it."""
    a, b = before.splitlines(True), after.splitlines(True)
    out: list[str] = []

    def put(mark: str, lines: list[str]) -> None:
        for line in lines:
            out.append(mark + line if line.endswith("\n") else f"{mark}{line}\n\\ No newline at end of line\n")

    for group in _hunks(edits(a, b)):
        lead = min(CONTEXT, group[0][0])
        tail = min(CONTEXT, len(a) - group[-1][1])
        a0, a1, b0, b1 = group[0][0] - lead, group[-1][1] + tail, group[0][2] - lead, group[-1][3] + tail
        out += [f"--- a{path}\n", f"+++ b{path}\n"] if not out else []
        out.append(f"@@ -{_range(a0, a1 - a0)} +{_range(b0, b1 - b0)} @@\n")
        at = a0
        for i, x, j, y in group:
            put(" ", a[at:i])
            put("-", a[i:x])
            put("+", b[j:y])
            at = x
        put(" ", a[at:a1])
    return "".join(out)


_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@\n")


def apply(before: str, diff: str) -> str:
    """The text that ``unified`` led to."""
    a, out, at = before.splitlines(True), [], 0
    lines = re.findall(r"[^\n]*\n", diff)[2:]
    # Lines may end in other than a line feed, so a line of the diff is read on until its note or mark.
    body, i = "".join(lines), 0
    while m := _HUNK.match(body, i):
        i, n_a, n_b = m.end(), int(m[2] or 1), int(m[4] or 1)
        begin = int(m[1]) - (n_a > 0)
        out += a[at:begin]
        at = begin
        while n_a or n_b:
            mark = body[i]
            if mark == "+":
                n_b -= 1
                line, i = _line_of(body, i + 1)
                out.append(line)
            else:
                line, i = _line_of(body, i + 1)
                n_a -= 1
                if mark == " ":
                    n_b -= 1
                    out.append(line)
                at += 1
    return "".join(out + a[at:])


_NOTE = "\\ No newline at end of line\n"


def _line_of(body: str, i: int) -> tuple[str, int]:
    end = body.index("\n", i) + 1
    if body.startswith(_NOTE, end):
        return body[i : end - 1], end + len(_NOTE)
    return body[i:end], end
