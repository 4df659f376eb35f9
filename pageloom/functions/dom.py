"""A small document tree: nodes, selectors, and serialisation. Pure Python, for use inside workers."""

from __future__ import annotations

import functools
import re
from html import escape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes", "plaintext"))

class Node:
    """An element, or text, comment or doctype (``tag`` starts with ``#`` then, and ``data`` is its content)."""

    __slots__ = ("tag", "attrs", "children", "parent", "data")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag, self.attrs, self.data = tag, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def elements(self):
        """All elements below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if node.tag[0] != "#":
                yield node
                stack.extend(reversed(node.children))

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if node.tag == "#text":
                out.append(node.data)
            stack.extend(reversed(node.children))
        return "".join(out)

    def set_text(self, text: str) -> None:
        self.children = []
        self.append(Node("#text", data=text))

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def remove(self) -> None:
        if self.parent:
            self.parent.children.remove(self)
            self.parent = None

    def replace(self, other: Node) -> None:
        if self.parent:
            self.parent.children[self.parent.children.index(self)] = other
            other.parent, self.parent = self.parent, None

    def select(self, selector: str) -> list[Node]:
        by_tag, by_attribute = indexed(selector)
        anywhere = by_tag.get("*", [])
        names = by_attribute.keys()
        out = []
        for node in self.elements():
            chains = anywhere + by_tag[node.tag] if node.tag in by_tag else anywhere
            if node.attrs and not names.isdisjoint(node.attrs):
                chains = chains + [c for name in node.attrs if name in names for c in by_attribute[name]]
            if chains and any(matches(node, c) for c in chains):
                out.append(node)
        return out

    def first(self, selector: str) -> Node | None:
        return next(iter(self.select(selector)), None)

    def html(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag == "#text":
                raw = node.parent is not None and node.parent.tag in RAW
                out.append(node.data if raw else escape(node.data, quote=False).replace("\xa0", "&nbsp;"))
            elif node.tag == "#comment":
                out.append(f"<!--{node.data}-->")
            elif node.tag == "#doctype":
                out.append(f"<!{node.data}>")
            else:
                if node.tag != "#root":
                    attrs = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in node.attrs.items())
                    out.append(f"<{node.tag}{attrs}>")
                    if node.tag in VOID:
                        continue
                    todo.append(f"</{node.tag}>")
                todo.extend(reversed(node.children))
        return "".join(out)


class Index:
    """A document as it stands: its elements by tag and by attribute, so that a selector looks at few of them. For documents
    that are asked many times and don't change any more."""

    def __init__(self, document: Node):
        self.all = list(document.elements())
        self.by_tag: dict[str, list[int]] = {}
        self.by_attribute: dict[str, list[int]] = {}
        for place, node in enumerate(self.all):
            self.by_tag.setdefault(node.tag, []).append(place)
            for name in node.attrs:
                self.by_attribute.setdefault(name, []).append(place)

    def elements(self) -> list[Node]:
        return self.all

    def select(self, selector: str) -> list[Node]:
        """As ``Node.select`` of the document."""
        by_tag, by_attribute = indexed(selector)
        found = set()
        for tag, chains in by_tag.items():
            found.update(p for p in (range(len(self.all)) if tag == "*" else self.by_tag.get(tag, ())) if any(matches(self.all[p], c) for c in chains))
        for name, chains in by_attribute.items():
            found.update(p for p in self.by_attribute.get(name, ()) if any(matches(self.all[p], c) for c in chains))
        return [self.all[p] for p in sorted(found)]

    def first(self, selector: str) -> Node | None:
        return next(iter(self.select(selector)), None)


def parse(html: str) -> Node:
    """The document of ``html`` as a browser builds it, with html, head and body. Never fails."""
    from .markup import build  # it needs this module's nodes

    return build(html)


_PART = re.compile(
    r"""(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:\\-]+)(?:(?P<op>[~*^$|]?=)(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]*))\s*(?P<flag>i)?)?\]"""
)


@functools.lru_cache(maxsize=512)
def compiled(selector: str):
    """Alternatives of descendant chains of compound selectors: tags, ids, classes, attributes (=, ~=, *=, ^=, $=; i)."""
    out = []
    for one in re.findall(r"(?:\[[^\]]*\]|[^,])+", selector):
        chain = []
        for compound in re.findall(r"(?:\[[^\]]*\]|\S)+", one.strip()):
            tests, at = [], 0
            while at < len(compound):
                m = _PART.match(compound, at)
                if not m:
                    raise ValueError(f"selector {selector}")
                at = m.end()
                if m["tag"]:
                    tests.append(("tag", m["tag"].lower(), None, False))
                elif m["id"]:
                    tests.append(("=", "id", m["id"], False))
                elif m["cls"]:
                    tests.append(("~=", "class", m["cls"], False))
                else:
                    value = next((m[k] for k in ("v1", "v2", "v3") if m[k] is not None), None)
                    tests.append((m["op"] or "has", m["attr"].replace("\\", "").lower(), value, bool(m["flag"])))
            chain.append(tests)
        out.append(chain)
    return out


@functools.lru_cache(maxsize=512)
def indexed(selector: str):
    """The chains of ``selector`` by the tag or by an attribute that their element must have (``*``: neither), so that a long
    list of selectors costs an element what its own attributes name only."""
    by_tag: dict[str, list] = {}
    by_attribute: dict[str, list] = {}
    for chain in compiled(selector):
        attribute = next((name for op, name, _, _ in chain[-1] if op != "tag"), None)
        if attribute is None:
            by_tag.setdefault(chain[-1][0][1], []).append(chain)
        else:
            by_attribute.setdefault(attribute, []).append(chain)
    return by_tag, by_attribute


#: Tests of an attribute's value; an empty value is part of nothing.
_TESTS = {
    "=": lambda own, value: own == value,
    "~=": lambda own, value: bool(value) and value in own.split(),
    "*=": lambda own, value: bool(value) and value in own,
    "^=": lambda own, value: bool(value) and own.startswith(value),
    "$=": lambda own, value: bool(value) and own.endswith(value),
    "|=": lambda own, value: own == value or own.startswith(value + "-"),
}


def _fits(node: Node, tests) -> bool:
    for op, name, value, fold in tests:
        if op == "tag":
            if name not in ("*", node.tag):
                return False
            continue
        own = node.attrs.get(name)
        if own is None:
            return False
        if op != "has" and not _TESTS[op](*((own.lower(), value.lower()) if fold else (own, value))):
            return False
    return True


def matches(node: Node, chain) -> bool:
    if not _fits(node, chain[-1]):
        return False
    up = node.parent
    for tests in reversed(chain[:-1]):
        while up is not None and not (up.tag[0] != "#" and _fits(up, tests)):
            up = up.parent
        if up is None:
            return False
        up = up.parent
    return True
