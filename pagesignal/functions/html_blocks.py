"""Page helper: HTML into content blocks. Used inside tasks, one page at a time.

The reader is the standard library's; a small tree with implied end tags stands on top of it, as
pages leave paragraphs, list items and cells open.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from html.parser import HTMLParser

# Elements without content, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
DROPPED = frozenset(("script", "style", "noscript"))
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
WANTED = HEADINGS | {"p", "ul", "ol", "table"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "same", "gone")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children, self.same, self.gone = tag, attrs, parent, [], 1, False
        if parent is not None:
            parent.children.append(self)

    def walk(self):
        """Elements below that aren't gone, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node) and not c.gone]
        while todo:
            at = todo.pop()
            yield at
            todo.extend(c for c in reversed(at.children) if isinstance(c, Node) and not c.gone)

    def strings(self):
        todo = list(reversed(self.children))
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                yield at
            elif not at.gone:
                todo.extend(reversed(at.children))

    def text(self) -> str:
        return " ".join(s for s in map(str.strip, self.strings()) if s)

    def xpath(self) -> str:
        steps, at = [], self
        while at is not None:
            steps.append(f"{at.tag}[{at.same}]")
            at = at.parent
        return "/" + "/".join(reversed(steps))


class _Builder(HTMLParser):
    """Builds the tree. Open elements are known by name, so the nearest one is found at any depth at once."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None)
        self.stack, self.where, self.has_html = [self.root], {}, False

    def _pop_to(self, i: int) -> None:
        for node in self.stack[i:]:
            self.where[node.tag].pop()
        del self.stack[i:]

    def _close(self, tags: set[str] | frozenset[str], until: set[str]) -> None:
        """Close the outermost of ``tags`` inside the nearest of ``until``."""
        limit = max((self.where[t][-1] for t in until if self.where.get(t)), default=0)
        open_ = [own[k] for t in tags if (own := self.where.get(t)) and (k := bisect_right(own, limit)) < len(own)]
        if open_:
            self._pop_to(min(open_))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            if self.has_html:
                return
            self.has_html = True
        if tag in ENDS_P:
            self._close({"p"}, {"td", "th", "li", "div", "section", "article", "body", "button"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.stack[-1])
        if tag not in VOID:
            self.where.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if own := self.where.get(tag):
            self._pop_to(own[-1])

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def _is_toc(node: Node) -> bool:
    return node.tag == "nav" or node.attrs.get("role") == "navigation" or "toc" in node.attrs.get("id", "") or "toc" in node.attrs.get("class", "")


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def table_cells(table: Node) -> list[list[str]]:
    """Rows of the first head, then all rows; empty ones and those equal to the row before are left out."""
    def cells(row: Node) -> list[str]:
        return [c.text() for c in row.walk() if c.tag in ("td", "th")]

    head = next((n for n in table.walk() if n.tag == "thead"), None)
    rows = [c for n in (head.walk() if head else ()) if n.tag == "tr" and any(c := cells(n))]
    for n in table.walk():
        if n.tag == "tr" and any(c := cells(n)) and (not rows or rows[-1] != c):
            rows.append(c)
    return rows


def blocks(html: str | None, keep_toc: bool = True) -> list[dict]:
    """Headings, paragraphs, lists and tables in document order, empty ones left out."""
    root = tree(html)
    for n in list(root.walk()):
        if n.tag in DROPPED or not keep_toc and _is_toc(n):
            n.gone = True
    out = []
    for n in [root, *root.walk()]:
        # Siblings are numbered by name among those that are left.
        seen: dict[str, int] = {}
        for c in n.children:
            if isinstance(c, Node) and not c.gone:
                c.same = seen[c.tag] = seen.get(c.tag, 0) + 1
    for n in root.walk():
        if n.tag not in WANTED:
            continue
        items = cells = None
        if n.tag in ("ul", "ol"):
            kind, items = "list", [t for c in n.children if isinstance(c, Node) and c.tag == "li" and (t := c.text())]
            payload = text = "\n".join(items)
        elif n.tag == "table":
            kind, cells, text = "table", table_cells(n), None
            payload = json.dumps(cells, ensure_ascii=False) if cells else ""
        else:
            kind = "para" if n.tag == "p" else "heading"
            payload = text = n.text()
        if payload:
            xpath, order = n.xpath(), len(out) + 1
            mark = hashlib.sha1(f"{xpath}|{payload}".encode()).hexdigest()[:4]
            out.append({"order": order, "id": f"b-{order:04d}-{mark}", "type": kind, "text": text, "items": items, "cells": cells, "xpath": xpath})
    return out


def _complete(item: object) -> bool:
    return isinstance(item, dict) and "@context" in item and "@type" in item


def jsonld_ok(text: str | None) -> bool:
    """Whether a JSON text is an object, or a list of objects, with @context and @type."""
    try:
        held = json.loads(text or "")
    except (ValueError, RecursionError):
        return False
    return all(map(_complete, held)) if isinstance(held, list) else _complete(held)


def scripts(root: Node) -> list[str]:
    """Texts of the JSON-LD scripts, however their type is quoted."""
    return ["".join(n.strings()) for n in root.walk() if n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json"]


def jsonld_objects(root: Node) -> list[tuple[int, int, str]]:
    """``(script, place, JSON text)`` of each object: a list gives one for each item, what can't be read none. Keys are sorted."""
    out = []
    for n, text in enumerate(scripts(root)):
        try:
            held = json.loads(text)
            out += [(n, i, json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for i, x in enumerate(held if isinstance(held, list) else [held])]
        except (ValueError, RecursionError):
            continue
    return out


def page_meta(root: Node) -> dict:
    """Metadata by the first element of each kind; what is absent or empty is None."""
    first: dict[str, Node] = {}
    for n in root.walk():
        a = n.attrs
        href = a.get("href", "")
        for kind, hit in (
            ("canonical", n.tag == "link" and "canonical" in a.get("rel", "").split()), ("robots", n.tag == "meta" and "robots" in a.get("name", "").lower()), ("html", n.tag == "html"),
            ("tel", n.tag == "a" and href.startswith("tel:")), ("postal", "postaladdress" in a.get("itemtype", "").lower()), ("address", n.tag == "address"),
            ("map", n.tag == "a" and ("goo.gl/maps" in href or "google.com/maps" in href)),
        ):
            if hit:
                first.setdefault(kind, n)

    def of(kind: str, name: str) -> str | None:
        return first[kind].attrs.get(name) or None if kind in first else None

    robots, place = (of("robots", "content") or "").lower(), first.get("postal") or first.get("address")
    return {
        "canonical": of("canonical", "href"), "noindex": "noindex" in robots if robots else None, "nofollow": "nofollow" in robots if robots else None, "lang": of("html", "lang"),
        "telephone": first["tel"].attrs["href"].replace("tel:", "") if "tel" in first else None, "address_text": place.text() if place else None, "has_map": of("map", "href"),
    }
