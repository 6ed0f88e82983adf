"""A page as a tree of elements, and selectors over it.

A selector is a path of steps parted by a space (any descendant) or `>` (a child). A step is a tag, `*`, or `..` (the
parent), with `#id`, `.class`, `[attribute]`, `[attribute=value]` or `^=`, `$=`, `*=` for its begin, end or a part.
`@name` at the end takes an attribute in place of the text. `meta:name` is the content of a meta element, `ld:key` a
value in a page's JSON-LD, and `after:selector` what follows an element that says Abstract, up to the next heading.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Set
from contextlib import contextmanager
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style", "noscript", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LABELS = HEADINGS | {"strong", "b"}
STOPS = HEADINGS | {"ul", "ol", "table", "footer", "font"}


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element | str]:
        """Elements and texts below, in the order of the page; no recursion, as broken pages nest deeply."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Element):
                todo.extend(reversed(x.children))

    def elements(self) -> Iterator[Element]:
        return (x for x in self.walk() if isinstance(x, Element))

    def raw(self, without: Set[int] = frozenset()) -> str:
        """Its texts, parted by spaces, without those of scripts and of the elements whose id() is given."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in SKIPPED and id(x) not in without:
                todo.extend(reversed(x.children))
        return " ".join(out)

    def text(self) -> str:
        return " ".join(self.raw().split())


class Page(HTMLParser):
    """The tree of a page; an end tag closes what stands open inside its element, and is ignored where none is open."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.open: dict[str, int] = {}
        try:
            self.feed(page)
            self.close()
        except (AssertionError, ValueError):  # a broken declaration: what was read so far counts
            pass

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        node = Element(tag, own, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            while True:
                last, self.at = self.at.tag, self.at.parent
                self.open[last] -= 1
                if last == tag:
                    return

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


@contextmanager
def tree(page: str) -> Iterator[Element]:
    """The root of a page's tree, which is taken apart in the end: elements know their parents, so whole trees would stay
    in memory until a collection of cycles."""
    root = Page(page).root
    try:
        yield root
    finally:
        for x in [root, *root.elements()]:
            x.children, x.parent = [], None


STEP = re.compile(r"\s*(>)?\s*(\.\.|\*|[a-zA-Z][\w-]*)?((?:[#.][\w-]+|\[[^\]]*\])*)")
PART = re.compile(r"([#.])([\w-]+)|\[\s*([\w:-]+)\s*(?:([\^$*]?)=\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")


def steps(selector: str) -> list[tuple[bool, str, list[tuple[str, str, str]]]]:
    """(child only, tag or '', conditions (attribute, how, value)) of every step."""
    out, at, selector = [], 0, selector.strip()
    while at < len(selector):
        m = STEP.match(selector, at)
        if m.end() == at or not (m[2] or m[3]):
            raise ValueError(f"no selector: {selector!r}")
        conditions = []
        for kind, name, attr, how, value in PART.findall(m[3]):
            if kind:
                conditions.append(("id", "", name) if kind == "#" else ("class", "~", name))
            else:
                conditions.append((attr.lower(), how, value))
        out.append((bool(m[1]), (m[2] or "").lower(), conditions))
        at = m.end()
    return out


def fits(x: Element, tag: str, conditions: list[tuple[str, str, str]]) -> bool:
    if tag not in ("", "*", x.tag):
        return False
    for attr, how, value in conditions:
        has = x.attrs.get(attr)
        if has is None:
            return False
        if how == "~":
            good = value in has.split()
        elif how == "^":
            good = has.startswith(value)
        elif how == "$":
            good = has.endswith(value)
        elif how == "*":
            good = value in has
        else:
            good = not value or has == value
        if not good:
            return False
    return True


def select(node: Element, selector: str) -> list[Element]:
    """The elements that a path of steps finds below node, in the order of the page, each once."""
    found = [node]
    for child, tag, conditions in steps(selector):
        if tag == "..":
            found = list(dict.fromkeys(x.parent for x in found if x.parent is not None))
            continue
        seen: dict[Element, None] = {}
        for x in found:
            below = (y for y in x.children if isinstance(y, Element)) if child else x.elements()
            seen.update(dict.fromkeys(y for y in below if fits(y, tag, conditions)))
        found = list(seen)
    return found


def labels(node: Element, every: bool) -> set[int]:
    """id() of the first element below node that is a label (every: of all): a heading that begins with the word
    Abstract, or bold text that says no more than it."""
    out: set[int] = set()
    for x in node.elements():
        if x.tag in LABELS and (out == set() or every):
            if re.match(r"abstract\b" if x.tag in HEADINGS else r"abstract\W*$", x.text(), re.I):
                out.add(id(x))
    return out


def prose(node: Element, every: bool = False) -> str:
    """The text of an element without a leading label, whether that is an element or plain text before a sign or line."""
    raw = node.raw(labels(node, every)).strip()
    raw = re.sub(r"^abstract(?:\s*[:.—–-]+(?=\s|$)|\s*[:—–]|[^\S\n]*\n)\s*", "", raw, count=1, flags=re.I)
    return " ".join(raw.split())


def following(root: Element, selector: str) -> list[str]:
    """What stands between an element of the selector that begins with the word Abstract and the next heading or list."""
    out: list[str] = []
    for head in (x for x in select(root, selector) if re.match(r"abstract\b", x.text(), re.I)):
        parts, todo, begun = [], [root], False
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts += [x] if begun else []
            elif x is head:
                begun = True
            elif begun and x.tag in STOPS:
                break
            elif x.tag not in SKIPPED:
                todo.extend(reversed(x.children))
        out.append(" ".join(" ".join(parts).split()))
    return out


def json_values(root: Element, key: str) -> list[str]:
    """Values of a key anywhere in the page's JSON-LD, in its order; what isn't JSON is passed over."""
    out = []
    for script in select(root, "script[type=application/ld+json]"):
        try:
            todo = [json.loads("".join(x for x in script.children if isinstance(x, str)))]
        except ValueError:
            continue
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                if isinstance(x.get(key), str):
                    out.append(" ".join(x[key].split()))
                todo.extend(reversed([v for v in x.values() if isinstance(v, dict | list)]))
            elif isinstance(x, list):
                todo.extend(reversed(x))
    return out


def values(node: Element, selector: str) -> list[str]:
    """Texts (or with @name attributes) of the elements of a selector below node."""
    path, _, name = selector.partition("@")
    found = select(node, path) if path.strip() else [node]
    return [x.attrs[name.strip().lower()] for x in found if name.strip().lower() in x.attrs] if name else [x.text() for x in found]


def passages(root: Element, selector: str, every: bool = False) -> list[str]:
    """What a selector of any kind gives for the whole page: texts without labels, contents, or JSON values."""
    kind, _, rest = selector.partition(":")
    if kind == "meta":
        named = [x.attrs.get("content", "") for x in select(root, "meta") if rest.lower() in (x.attrs.get("name", "").lower(), x.attrs.get("property", "").lower())]
        named = [" ".join(x.split()) for x in named[:1]]
        cut = rest.lower().endswith("description")  # many sites cut a description off
        return [x for x in named if x and not (cut and x.endswith(("...", "…")))]
    if kind == "ld":
        return json_values(root, rest)
    if kind == "after":
        return following(root, rest)
    if "@" in selector:
        return [" ".join(x.split()) for x in values(root, selector)]
    return [prose(x, every) for x in select(root, selector)]
