"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks: runs of text with no block-level tag inside, each with the
tags, classes, ids and roles above it. A block's features are those ancestors, simple
facts of its text, and how much prose stands around it: near it, before and after it, and in the
container that holds most of the page's. The field scores each block as article or not and each pair of neighbours;
Viterbi picks the best labelling of the page, and the article blocks are its text.

Training: ``labelled_pages`` writes a bounded set of pages of many layouts with known labels, and
``fit`` maximises the regularised conditional likelihood by gradient steps, with sums by the
forward-backward recursion over all pages at once. The model is one small table of weights.

Prose is measured in words and end marks of whatever script: letters of scripts without spaces count as half a word each. What stands
side by side in columns counts for what holds the columns. Pages of a single block are pages like others.

Nulls and edges: null and empty pages have no blocks and give empty text. Scripts, styles,
templates, text areas, comments, and the head never make blocks. Broken markup (unclosed, stray, misnested
tags, a file cut off in a tag) is read leniently and never fails; attributes are read as HTML reads
them, so a quote inside an unquoted value opens nothing. Character references are decoded within
each run of text. Formulas (``math``) are text. Repeated rows are treated alike; an empty table gives an empty
result; other columns than ``page_id``, ``url`` and ``html`` are not read. Ties in Viterbi go to the article. Time is
linear in the page's length, also for pages of tens of millions of characters.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small, texts_of, with_columns

# Element names by kind.
BLOCK = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li link main menu meta nav noframes noscript object ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title noscript template svg iframe noframes textarea".split())
#: Tags that end an open paragraph, and what an opening tag closes of its own kind.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

# A tag's attributes: a value after "=" is quoted, or runs to the next blank or ">" whatever quotes it holds.
_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_MARKUP = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>=]++|{_VALUE})*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/=>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_WORDS = re.compile(r"[a-z]+")
#: A slash that closes the tag itself, and isn't the end of an unquoted value.
_CLOSED = re.compile(r"""(?:\A|[\s"'])/\Z""")
#: Marks of what is no running text of the page.
ASIDE = frozenset("nav footer aside form hidden button select option textarea".split())


#: Letters of scripts that put no spaces between words: Thai to Khmer, kana, Han, Hangul.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
# End marks of other scripts and what they stand for.
_ENDS = str.maketrans("。．！？：；，、。…।؟", "..!?:;,,....")


@dataclass
class Leaf:
    """A block's text, the characters of it inside links, the marks above it (tags, classes), and the numbers of its nearest containers."""

    text: str
    linked: int
    marks: frozenset[str]
    tag: str
    up: tuple[int, ...] = ()

    @cached_property
    def unspaced(self) -> int:
        """Letters that stand for more than one of a spaced script."""
        return 0 if self.text.isascii() else len(_UNSPACED.findall(self.text))

    @property
    def size(self) -> int:
        """Characters, with those of unspaced scripts counted twice, as they say about as much as two others."""
        return len(self.text) + self.unspaced

    @property
    def words(self) -> int:
        """Words, two letters of an unspaced script to one."""
        return self.text.count(" ") + 1 + self.unspaced // 2


def leaves(page: str | None) -> list[Leaf]:
    """The leaf blocks of a page in order."""
    page = page or ""
    stack: list[tuple[str, frozenset[str], int]] = [("", frozenset(), 0)]
    opened = 0
    where: dict[str, list[int]] = {}  # the stack positions of each open name
    blocks: list[int] = []  # and of the open blocks
    out: list[Leaf] = []
    parts: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag = stack[blocks[-1]][0] if blocks else ""
                out.append(Leaf(text, linked, stack[-1][1], tag, tuple(stack[i][2] for i in blocks[-4:])))
            parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal anchors
        for name, *_ in stack[i:]:
            anchors -= name == "a"
            where[name].pop()
        del stack[i:]
        while blocks and blocks[-1] >= i:
            blocks.pop()

    def nearest(*names: str) -> int:
        return max((where[t][-1] for t in names if where.get(t)), default=0)

    at, n = 0, len(page)
    lower = None
    while at < n:
        upto = page.find("<", at)
        upto = n if upto < 0 else upto
        if upto > at:
            run = page[at:upto]
            parts.append(_html.unescape(run) if "&" in run else run)
            if anchors:
                linked += upto - at
        if upto == n:
            break
        m = _MARKUP.match(page, upto)
        if not m:  # a bare "<"
            parts.append("<")
            at = upto + 1
            continue
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            i = nearest(name)
            if name in BLOCK and (i or name == "p"):
                flush()
            if i and (name in BLOCK or not blocks or blocks[-1] < i):  # an inline end tag doesn't close blocks
                pop_to(i)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in SILENT:
            if name == "textarea":
                flush()
            if not _CLOSED.search(m["rest"]) or name == "textarea":
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{name}", at)
                if len(lower) != n:  # lower-casing changed the length somewhere: look without it
                    found = re.compile(f"</{name}", re.I).search(page, at)
                    end = found.start() if found else -1
                at = n if end < 0 else (page.find(">", end) + 1 or n)
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
                pop_to(blocks[-1])
            if name in SIBLINGS:
                while (i := nearest(*SIBLINGS[name])) > nearest(*SCOPE.get(name, ())):
                    pop_to(i)
                    if name not in ("tr", "tbody", "tfoot", "thead"):
                        break
        if name in VOID:
            continue
        own = {name} if name in BLOCK or name in ("a", "label", "time") else set()
        for key, *value in _ATTRIBUTE.findall(m["rest"]) if _TELLING.search(m["rest"]) else ():
            key, value = key.lower(), next((v for v in value if v), "").lower()
            if key in ("class", "id", "role"):
                own |= {f"is={w}" for w in _WORDS.findall(value)}
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                own.add("hidden")
        if name not in BLOCK and _CLOSED.search(m["rest"]):
            continue
        anchors += name == "a"
        where.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        opened += 1
        stack.append((name, stack[-1][1] | own if own else stack[-1][1], opened))
    flush()
    return out


BITS = 13


@lru_cache(maxsize=1 << 14)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) & (1 << BITS) - 1


@lru_cache(maxsize=1 << 12)
def _above(marks: frozenset[str]) -> list[int]:
    inside = ["in-main"] if "article" in marks or "main" in marks else []
    return [_bucket(x) for x in [*(f"up:{m}" for m in sorted(marks)), *inside]]


def features(leaf: Leaf) -> list[int]:
    """Hashed features of a block by itself."""
    text, n, words = leaf.text, leaf.size, leaf.words
    link, last = leaf.linked / max(1, len(text)), text[-1].translate(_ENDS)
    names = [
        "bias", f"tag:{leaf.tag}", f"len:{min(7, n.bit_length() // 2)}", f"words:{min(6, words.bit_length())}", f"link:{min(3, int(link * 4))}",
        f"ends:{last if last in '.!?:;,' else 'x'}", f"first:{'U' if text[0].isupper() else 'l' if text[0].islower() else 'd' if text[0].isdigit() else 'o'}",
    ]
    if "©" in text[:20]:
        names.append("sign")
    return [*_above(leaf.marks), *map(_bucket, names)]


def prose_of(leaf: Leaf) -> int:
    """Characters of running text: a block of several words, in whatever script, that is not mostly links and not marked as something else."""
    return leaf.size - leaf.linked if leaf.words > 5 and 3 * leaf.linked < len(leaf.text) and not leaf.marks & ASIDE else 0


def page_features(blocks: list[Leaf]) -> list[list[int]]:
    """Hashed features of each block of a page, with those of where it stands among the others."""
    prose = [prose_of(b) for b in blocks]
    sums = [0]
    for x in prose:
        sums.append(sums[-1] + x)
    held: dict[int, int] = {}
    around: dict[int, int] = {}  # what holds columns and other parts side by side
    for b, x in zip(blocks, prose):
        # A block's text counts for what holds the block, and half for what holds that.
        for k, at in enumerate(reversed(b.up[:-1])):
            if x and k < 2:
                held[at] = held.get(at, 0) + (x >> k)
            if x and k:
                around[at] = around.get(at, 0) + x
    best = max(held, key=lambda at: (held[at], -at), default=-1)
    wide = max(around, key=lambda at: (around[at], at), default=-1)
    filled = [i for i, x in enumerate(prose) if x >= 60]
    first, last = (filled[0], filled[-1]) if filled else (len(blocks), -1)
    out = []
    for i, b in enumerate(blocks):
        near = sums[min(len(blocks), i + 4)] - sums[max(0, i - 3)] - prose[i]
        sides = [f"{name}:{blocks[j].tag}:{min(2, len(blocks[j].text) // 50)}:{2 * blocks[j].linked > len(blocks[j].text)}" if 0 <= j < len(blocks) else name for name, j in (("prev", i - 1), ("next", i + 1))]
        level = b.up[::-1].index(best) if best in b.up else 9
        place = "before" if i < first else "after" if i > last else "within"
        names = [f"near:{min(6, near.bit_length() // 2)}", f"best:{level}", f"place:{place}", f"place:{place}:best:{level < 9}", f"own:{min(4, prose[i].bit_length() // 2)}:best:{level < 9}", f"own:{min(4, prose[i].bit_length() // 2)}:wide:{wide in b.up}:{place}", f"few:{min(4, len(blocks))}:{b.tag}:{prose[i] > 0}", *sides]
        if prose[i] and ("article" in b.marks or "main" in b.marks):
            names.append(f"prose-in-main:{level < 9}")
        out.append([*features(b), *map(_bucket, names)])
    return out


@dataclass(frozen=True)
class Field:
    """Weights of a block's features for the article label, and of each pair of neighbouring labels."""

    weights: np.ndarray
    pairs: np.ndarray
    ends: np.ndarray

    @cached_property
    def _list(self) -> list[float]:
        return self.weights.tolist()

    def label(self, blocks: list[Leaf]) -> list[bool]:
        """The best labelling of a page's blocks (Viterbi); ties go to the label article."""
        if not blocks:
            return []
        w = self._list
        emit = [sum([w[i] for i in f]) for f in page_features(blocks)]
        p = self.pairs.tolist()
        best, back = [self.ends[0], self.ends[1] + emit[0]], []
        for e in emit[1:]:
            step = [max(((best[i] + p[i][j], i) for i in (0, 1))) for j in (0, 1)]
            back.append([step[0][1], step[1][1]])
            best = [step[0][0], step[1][0] + e]
        at = int(best[1] >= best[0])
        out = [at]
        for b in reversed(back):
            at = b[at]
            out.append(at)
        return [bool(x) for x in reversed(out)]


def fit(pages: list[tuple[list[Leaf], list[bool]]], *, rounds: int = 120, rate: float = 0.3, penalty: float = 1e-3) -> Field:
    """Maximise the conditional likelihood of labelled pages by Adam steps."""
    # Longest first, so that the pages that reach a place are the first ones.
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    most, size = max(len(b) for b, _ in pages), 1 << BITS
    feats = [f for blocks, _ in pages for f in page_features(blocks)]
    row = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    col = np.concatenate([np.asarray(f) for f in feats])
    place = np.concatenate([k * most + np.arange(len(b)) for k, (b, _) in enumerate(pages)])
    gold = np.array([y for _, labels in pages for y in labels], np.int64)
    length = np.array([len(b) for b, _ in pages])
    on = np.arange(most)[None, :] < length[:, None]
    reach, rows = on.sum(0), np.arange(len(pages))
    y = np.zeros(len(pages) * most, np.int64)
    y[place] = gold
    y = y.reshape(len(pages), most)
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (y[:, :-1][on[:, 1:]], y[:, 1:][on[:, 1:]]), 1)
    theta = np.zeros(size + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, pairs, ends = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        emit = np.zeros(len(pages) * most)
        emit[place] = np.bincount(row, w[col], len(feats))
        emit = np.stack([np.zeros((len(pages), most)), emit.reshape(len(pages), most)], -1)
        a = np.zeros((len(pages), most, 2))
        b = np.zeros_like(a)
        a[:, 0] = ends + emit[:, 0]
        for t in range(1, most):
            k = reach[t]
            a[:k, t] = np.logaddexp(a[:k, t - 1, :1] + pairs[0], a[:k, t - 1, 1:] + pairs[1]) + emit[:k, t]
        for t in range(most - 2, -1, -1):
            k = reach[t + 1]
            z = b[:k, t + 1] + emit[:k, t + 1]
            b[:k, t] = np.logaddexp(pairs[:, 0] + z[:, :1], pairs[:, 1] + z[:, 1:])
        log_z = np.logaddexp(*a[rows, length - 1].T)
        one = np.exp(a[:, :, 1] + b[:, :, 1] - log_z[:, None])
        grad = np.zeros_like(theta)
        grad[:size] = np.bincount(col, (gold - one.reshape(-1)[place])[row], size)
        both = np.exp(a[:, :-1, :, None] + pairs + (emit + b)[:, 1:, None, :] - log_z[:, None, None, None]) * on[:, 1:, None, None]
        grad[size : size + 4] = (gold_pairs - both.sum((0, 1))).ravel()
        first = np.bincount(y[:, 0], minlength=2) - np.array([(1 - one[:, 0]).sum(), one[:, 0].sum()])
        grad[size + 4 :] = first
        grad = grad / len(pages) - penalty * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :])


def labelled_pages(n: int = 540, seed: int = 3) -> list[tuple[list[Leaf], list[bool]]]:
    """``n`` written pages of varied layout, read into blocks, each with whether it is of the article.

    Article text carries a mark character that is taken out again once the blocks are read.
    """
    r = random.Random(seed)
    mark = "\ue000"

    def pick(*options):
        return r.choice(options)

    vocabulary = ["".join(r.choices(("a", "e", "i", "o", "u", "an", "er", "on", "st", "th", "re", "le", "ch", "ung", "ción", "té"), k=r.randrange(1, 5))) for _ in range(3000)]
    scripts = [[chr(c) for c in range(a, b)] for a, b in ((0x3041, 0x3094), (0x4E00, 0x5E00), (0x0E01, 0x0E2F), (0xAC00, 0xB000))]
    letters: list[str] = []  # of the page's script, where that has no spaces

    def word() -> str:
        return "".join(r.choices(letters, k=r.randrange(1, 4))) if letters else r.choice(vocabulary)

    def say(k: int) -> str:
        if letters:
            return "".join(r.choices(letters, k=r.randrange(k, 3 * k + 1))) + pick("。", "。", "。", "", "！", "？")
        return (" ".join(r.choices(vocabulary, k=k)).capitalize() + pick(".", ".", ".", "", "!", "?")).strip()

    def prose(most: int = 6) -> str:
        return " ".join(say(r.randrange(1, 25)) for _ in range(r.randrange(1, most)))

    def own(text: str) -> str:
        return mark + text

    def attrs(*names: str) -> str:
        return pick("", f' class="{pick(*names)}"', f' id="{pick(*names)}"', f" class='{pick(*names)} x{r.randrange(99)}'")

    def menu() -> str:
        items = "".join(f'<li><a href="/{word()}">{say(r.randrange(1, 3))}</a></li>' for _ in range(r.randrange(2, 9)))
        if r.random() < 0.1:
            return "<nav>" + "".join(f'<a href="/">{say(1)}</a> ' for _ in range(r.randrange(1, 5))) + "</nav>"
        return pick(f"<nav{attrs('menu', 'navbar')}><ul>{items}</ul></nav>", f'<div class="{pick("menu", "nav", "navbar", "navigation", "breadcrumb", "topbar")}"><ul>{items}</ul></div>', f'<ul class="{pick("nav", "menu", "breadcrumbs")}">{items}</ul>', f'<div role="navigation">{items}</div>')

    def notice() -> str:
        return pick(f'<div class="{pick("cookie", "notice", "banner", "consent", "gdpr", "alert", "popup", "newsletter", "modal")}"><p>{prose(3)}</p><button>{say(1)}</button></div>', f'<div id="{pick("cookie-bar", "notice", "consent-banner")}">{prose(3)}</div>', f'<div role="{pick("alert", "dialog", "banner")}">{prose(2)}</div>')

    def advert() -> str:
        return pick(f'<div class="{pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad")}">{prose(3)}</div>', f'<aside class="{pick("ad", "promo")}"><p>{prose(2)}</p></aside>', f'<div id="{pick("ad-top", "ad-slot", "sponsor")}"><a href="x">{say(4)}</a></div>')

    def form() -> str:
        return f"<form{attrs('search', 'login', 'subscribe')}><label>{say(2)}</label><input name=q><button>{say(1)}</button>{pick('', '<p>' + say(6) + '</p>')}</form>"

    def side() -> str:
        inner = f"<h3>{say(3)}</h3>" + "".join(pick(f"<p>{prose(3)}</p>", f'<li><a href="#">{say(5)}</a></li>') for _ in range(r.randrange(1, 5)))
        return pick(f"<aside{attrs('sidebar', 'related')}>{inner}</aside>", f'<div class="{pick("sidebar", "related", "widget", "recommended", "share", "social", "tags")}">{inner}</div>', f'<section class="{pick("related", "more", "sidebar")}">{inner}</section>')

    def replies() -> str:
        one = "".join(pick(f'<div class="comment"><p>{prose(4)}</p></div>', f'<li class="comment"><b>{say(1)}</b><p>{prose(4)}</p></li>', f'<article class="comment"><p>{prose(3)}</p></article>') for _ in range(r.randrange(1, 5)))
        return pick(f'<section class="{pick("comments", "comment-list", "discussion")}"><h3>{say(2)}</h3>{one}</section>', f'<div id="{pick("comments", "disqus", "responses")}">{one}</div>', f'<ol class="{pick("commentlist", "comments", "replies")}">{one}</ol>')

    def header() -> str:
        return pick(f"<header{attrs('site-header', 'masthead')}><a href='/'>{say(2)}</a><p>{say(5)}</p></header>", f'<div class="{pick("header", "masthead", "site-header", "logo")}">{say(3)}</div>')

    def footer() -> str:
        text = pick("&copy; ", "© ", "Copyright ", "") + f"{word()}.example {pick('&middot; ', '| ', '')}{prose(3)}"
        return pick(f"<footer{attrs('site-footer')}>{text}", f"<footer><p>{text}</p></footer>", f'<div class="{pick("footer", "site-footer", "copyright", "legal")}">{text}</div>')

    def para() -> str:
        kind = r.randrange(12)
        if kind < 7:
            return f"<p>{own(prose(9))}" + pick("</p>", "</p>", "")
        if kind == 7:
            return f"<p><b>{own(prose(3))}<br><p>{own(prose(5))}</p>"
        if kind == 8:
            return f"<{(h := pick('h2', 'h3', 'h4'))}>{own(say(4))}</{h}>"
        if kind == 9:
            items = "".join(f"<li>{own(say(r.randrange(1, 12)))}</li>" for _ in range(r.randrange(1, 5)))
            return f"<{(k := pick('ul', 'ol'))}>{items}</{k}>"
        if kind == 10:
            return f"<blockquote>{own(prose(3))}</blockquote>"
        return pick(f"<pre>{own(say(6))}</pre>", f"<table><tr><td>{own(say(2))}</td><td>{own(say(3))}</td></tr></table>", f"<figure><figcaption>{own(say(6))}</figcaption></figure>", f"<p>{own(say(2))} <a href='/'>{say(3)}</a> {say(4)}</p>", f"<p>{own(say(1))}</p>", f"<div>{own(prose(3))}</div>")

    def plain(inner: str) -> str:
        """A container whose name tells nothing."""
        name = pick("col-md-8", "row", "container", "wrapper", "inner", "block", "box", "left", "right", "grid", f"css-{word()}", f"x{r.randrange(99)}", "")
        return pick(f'<div class="{name}">{inner}</div>', f"<div>{inner}</div>", f'<section id="{name}">{inner}</section>', f'<div class="{name}"><div class="inner">{inner}</div></div>')

    def links() -> str:
        k = r.randrange(2, 9)
        return pick("<ul>" + "".join(f'<li><a href="/{word()}">{say(r.randrange(1, 5))}</a></li>' for _ in range(k)) + "</ul>", "".join(f'<a href="/{word()}">{say(r.randrange(1, 3))}</a> ' for _ in range(k)), "".join(f'<div><a href="/{word()}">{say(r.randrange(1, 4))}</a></div>' for _ in range(k)))

    def small_print() -> str:
        return pick(f"{pick('&copy;', '©')} {r.randrange(1990, 2030)} {word()} {say(r.randrange(1, 6))}", f"© {word()}.example &middot; {prose(3)}", say(r.randrange(1, 5)))

    def columns(parts: list[str]) -> str:
        """The parts side by side."""
        name = pick("col", "column", "col-md-6", "half", f"x{r.randrange(99)}", "")
        each = "".join(f'<div class="{name}">{x}</div>' if name else f"<div>{x}</div>" for x in parts)
        return pick(f'<div class="{pick("row", "columns", "grid", "flex")}">{each}</div>', f"<div>{each}</div>", f"<section>{each}</section>")

    def short() -> str:
        """An article of a paragraph or two, alone or with little around it."""
        body = "".join(f"<p>{own(pick(say(r.randrange(8, 20)) + ' ' + say(r.randrange(4, 12)), prose(9) + ' ' + prose(9)))}</p>" for _ in range(r.choice((1, 1, 1, 2))))
        core = pick(f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f'<div class="{pick("content", "post", "story")}">{body}</div>', f"<div>{body}</div>", body)
        if r.random() < 0.3:
            return core
        return pick(menu(), menu(), header(), "") + core + pick(footer(), footer(), f"<div>{small_print()}</div>", "")

    def unnamed() -> str:
        """A page whose classes tell nothing: only its text does."""
        title = pick(f"<h1>{own(say(6))}</h1>", f"<h1>{own(say(6))}</h1>", f"<h2>{own(say(5))}</h2>", "")
        parts = [para() if r.random() < 0.6 else f"<p>{own(prose(9) + ' ' + prose(9))}</p>" for _ in range(r.randrange(2, 10))]
        body = title + (columns([f"<p>{own(prose(9) + ' ' + prose(9))}</p>" + x for x in parts[:3]]) if r.random() < 0.2 else "".join(parts))
        head = "".join(x() for x in (lambda: plain(say(2)), lambda: plain(links()), lambda: plain(say(4)), form) if r.random() < 0.6)
        tail = "".join(x() for x in (lambda: plain(links()), lambda: plain(f"<h3>{say(2)}</h3>{links()}"), replies, side) if r.random() < 0.4)
        end = pick(f"<div>{small_print()}</div>", f"<p>{small_print()}</p>", plain(small_print()), f"<footer>{small_print()}</footer>", "")
        if r.random() < 0.2:
            return f"<table><tr><td>{links()}</td><td>{body}</td></tr></table>{end}"
        return head + pick(plain(body), plain(body), body) + tail + end

    out = []
    for number in range(n):
        letters[:] = r.choice(scripts) if number % 6 == 5 else []
        body = "".join(para() for _ in range(r.randrange(1, 12)))
        if r.random() < 0.1:
            body = columns(["".join(para() for _ in range(r.randrange(1, 4))) for _ in range(r.choice((2, 2, 3)))])
        if r.random() < 0.25:
            body = "".join(f"<p>{own(say(r.choice((2, 4, 9, 14))))}</p>" for _ in range(r.randrange(1, 4)))
        title = pick(f"<h1>{own(say(6))}</h1>", f"<h1>{own(say(6))}</h1>", f"<header><h1>{own(say(5))}</h1></header>", "")
        within = pick("", "", "", advert(), side(), replies(), notice())
        core = title + body + within
        kind = r.randrange(6)
        if kind < 3:
            core = f"<article{attrs('post', 'entry', 'story')}>{core}</article>"
        elif kind == 3:
            core = f"<main{attrs('content')}>{core}</main>"
        elif kind == 4:
            core = f'<div class="{pick("content", "post-content", "entry-content", "article-body", "story", "main-content", "post")}">{core}</div>'
        else:
            core = f'<main><article class="{pick("post", "entry")}"><div class="{pick("body", "content", "text")}">{core}</div></article></main>'
        before = "".join(x() for x in (menu, header, notice, advert, form, side) if r.random() < 0.45)
        after = "".join(x() for x in (side, replies, advert, form, menu, notice) if r.random() < 0.35)
        inside = f"{before}{core}{after}{pick(footer(), footer(), '')}" if number % 3 else unnamed()
        if number % 4 == 3:
            inside = short()
        blocks = leaves(f"<!DOCTYPE html><html><head><title>{say(5)}</title></head><body>{inside}" + pick("</body></html>", ""))
        labels = [mark in b.text for b in blocks]
        out.append(([Leaf(b.text.replace(mark, "") or "x", b.linked, b.marks, b.tag, b.up) for b in blocks], labels))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit(labelled_pages())


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``: article blocks joined by newlines."""
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    shared = pages.sparkSession.sparkContext.broadcast(model or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = []
            for page in texts_of(batch, "html"):
                blocks = leaves(page)
                texts.append("\n".join(b.text for b, y in zip(blocks, shared.value.label(blocks)) if y))
            yield with_columns(batch, ["page_id", "url"], text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")
