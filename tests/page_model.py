"""Model of the page reading (V2 plain text + V3 counters) with the standard library's HTML parser,
against which the tests hold the regular expressions of ``functions.links``: first matching button, first
action-text span decides, else the first all-digit span, text of nested elements included.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from rollcall.functions import links as LK

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], parent

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def iter(self, tag):
        for c in self.children:
            if isinstance(c, _Node):
                if c.tag == tag:
                    yield c
                yield from c.iter(tag)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", [], None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, attrs, self.cur)
        self.cur.children.append(node)
        if tag not in _VOID:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(_Node(tag, attrs, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def _counter(root: _Node, label: str) -> int:
    pat = re.compile(re.escape(label), re.I)
    button = next((b for b in root.iter("button") if pat.search(b.attrs.get("aria-label") or "")), None)
    if button is None:
        return 0
    action = next((s for s in button.iter("span") if LK.ACTION_CLASS in (s.attrs.get("class") or "")), None)
    if action is not None:
        t = action.text().strip()
        return int(t) if t.isdigit() and t.isascii() else 0
    for s in button.iter("span"):
        t = s.text().strip()
        if t.isdigit() and t.isascii():
            return int(t)
    return 0


def read_page(html: str | None, status: int | None = None) -> tuple[bool, int, int]:
    """(missing, likes, comments) of one fetched page, plain-fetch rules."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    head = tree.root.text()[:LK.PLAIN_TEXT_WINDOW].lower()
    missing = status == 404 or "404" in head or "not found" in head
    return missing, _counter(tree.root, LK.LIKE_LABEL), _counter(tree.root, LK.COMMENT_LABEL)
