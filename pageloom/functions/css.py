"""A small CSS reader: rules, declarations and at-rules of a sheet, and the ``url()`` parts of values. Pure Python."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field


class BrokenCss(ValueError):
    """The sheet can't be read: a block, string or comment doesn't end, or a brace closes nothing."""


@dataclass
class Block:
    """A rule (``selector``) or an at-rule (``name``, ``params``); ``items`` are declarations and blocks in order.

    A declaration is ``(property, value, start, end)``: where its value stands in the sheet.
    """

    selector: str | None = None
    name: str | None = None
    params: str = ""
    params_at: tuple[int, int] = (0, 0)
    items: list = field(default_factory=list)

    def blocks(self):
        """All blocks below, outer before inner, with the blocks around each."""
        stack = [(b, ()) for b in reversed([i for i in self.items if isinstance(i, Block)])]
        while stack:
            block, around = stack.pop()
            yield block, around
            stack.extend((b, (*around, block)) for b in reversed([i for i in block.items if isinstance(i, Block)]))

    def declarations(self):
        """Those of the block itself and of all blocks below."""
        for i in self.items:
            if isinstance(i, Block):
                yield from i.declarations()
            else:
                yield i


_SKIP = re.compile(r"/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\((?:[^()\"']|\"[^\"]*\"|'[^']*'|\([^()]*\))*\)|[{};]", re.S)
_DECLARATION = re.compile(r"\s*(?P<prop>[-_*$A-Za-z][\w$-]*)\s*:(?P<value>.*)", re.S)


def _bare(text: str) -> str:
    return re.sub(r"/\*.*?\*/", "", text, flags=re.S)


def parse(css: str) -> Block:
    """The sheet as a block of top-level items. Short sheets' blocks are shared: don't change them."""
    return _short(css) if len(css) <= SHORT else _parse(css)


def _parse(css: str) -> Block:
    sheet = Block()
    stack, start = [sheet], 0

    def statement(end: int) -> None:
        text = css[start:end]
        bare = _bare(text).strip()
        if not bare:
            return
        if bare.startswith("@"):
            m = re.match(r"\s*(?:/\*.*?\*/\s*)*@([\w-]+)\s*", text, re.S)
            if m:
                stop = start + len(text.rstrip())
                stack[-1].items.append(Block(name=m[1], params=css[start + m.end() : stop], params_at=(start + m.end(), stop)))
            return
        lead = len(text) - len(re.sub(r"^(\s|/\*.*?\*/)+", "", text, flags=re.S))
        m = _DECLARATION.fullmatch(text, lead)
        if not m:
            if len(stack) == 1 or ":" not in bare:
                raise BrokenCss(bare[:80])
            return
        value = m["value"]
        a = start + m.start("value") + len(value) - len(value.lstrip())
        shown = re.sub(r"\s*!\s*important\s*$", "", value.strip(), flags=re.I)
        b = a + len(shown)
        stack[-1].items.append((m["prop"], _bare(shown).strip(), a, b))

    at = 0
    while True:
        m = _SKIP.search(css, at)
        if not m:
            break
        at = m.end()
        if m[0] == ";":
            statement(m.start())
            start = at
        elif m[0] == "{":
            head = _bare(css[start : m.start()]).strip()
            name = re.match(r"@([\w-]+)\s*(.*)", head, re.S)
            block = Block(name=name[1], params=name[2].strip()) if name else Block(selector=head)
            stack[-1].items.append(block)
            stack.append(block)
            start = at
        elif m[0] == "}":
            if len(stack) == 1:
                raise BrokenCss("a brace closes nothing")
            statement(m.start())
            stack.pop()
            start = at
    if len(stack) > 1 or re.search(r"/\*(?!.*\*/)", css[start:], re.S):
        raise BrokenCss("a block or comment doesn't end")
    if _bare(css[start:]).strip():
        statement(len(css))
    return sheet


#: Sheets of at most so many characters are remembered, as the pages of a site share theirs.
SHORT, REMEMBERED = 8192, 512
_short = functools.lru_cache(maxsize=REMEMBERED)(_parse)

#: The parts of a value: comments, strings, functions with what they hold.
_TOP = re.compile(r"/\*.*?\*/|(?P<string>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<name>[\w-]*)\(", re.S)


def _closing(text: str, at: int) -> int:
    """Place after the parenthesis that closes the one before ``at`` (the end if none does)."""
    depth = 1
    for m in re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[()]", re.S).finditer(text, at):
        depth += (m[0] == "(") - (m[0] == ")")
        if not depth:
            return m.end()
    return len(text)


def top_references(value: str, strings: bool = False):
    """``(start, end, reference, is_string)`` of top-level ``url()`` (and strings) of a value."""
    at = 0
    while m := _TOP.search(value, at):
        at = m.end()
        if m["string"] is not None:
            if strings:
                yield m.start() + 1, m.end() - 1, m["string"][1:-1], True
        elif m["name"] is not None:
            at = _closing(value, m.end())
            if m["name"] == "url":
                inner = value[m.end() : at - 1 if value[at - 1 : at] == ")" else at].strip()
                yield m.end(), at - 1, re.sub(r"^['\"]|['\"]$", "", inner), False


def replace_references(value: str, new, strings: bool = False) -> str:
    """``value`` with each top-level reference replaced by ``new(reference)`` (None: left alone); ``url()`` loses its quotes."""
    out, at = [], 0
    for start, end, ref, _ in top_references(value, strings):
        to = new(ref)
        if to is not None:
            out += [value[at:start], to]
            at = end
    return "".join([*out, value[at:]])


FALLBACK_URL = re.compile(r"url\(\s*(['\"]?)([^'\")]+)\1\s*\)", re.I)
FALLBACK_IMPORT_URL = re.compile(r"@import\s+url\(\s*(['\"]?)([^'\")]+)\1\s*\)", re.I)
FALLBACK_IMPORT = re.compile(r"@import\s+(['\"])([^'\"]+)\1", re.I)


def references(css: str) -> tuple[list[str], list[str]]:
    """Assets and imports that a sheet names, each once, in order; by patterns if the sheet can't be read."""
    assets, imports = _short_references(css) if len(css) <= SHORT else _references(css)
    return list(assets), list(imports)


def _references(css: str) -> tuple[list[str], list[str]]:
    try:
        sheet = parse(css)
    except BrokenCss:
        assets = [m[2] for m in FALLBACK_URL.finditer(css)]
        imports = [m[2] for p in (FALLBACK_IMPORT_URL, FALLBACK_IMPORT) for m in p.finditer(css)]
        return list(dict.fromkeys(assets)), list(dict.fromkeys(imports))
    assets = [ref for _, value, _, _ in sheet.declarations() for _, _, ref, _ in top_references(value)]
    imports = []
    for block, _ in sheet.blocks():
        if block.name == "import":
            imports += [ref for _, _, ref, _ in list(top_references(block.params, strings=True))[:1]]
    return list(dict.fromkeys(assets)), list(dict.fromkeys(imports))


_short_references = functools.lru_cache(maxsize=REMEMBERED)(_references)


def media_context(around: tuple[Block, ...]) -> str:
    parts = [f"@media {b.params.strip() or 'unknown'}" for b in around if b.name and b.name.lower() == "media"]
    return " && ".join(parts) or "base"


def rows(css: str):
    """All rows of a sheet: ``(kind, rule_seq, decl_seq, selector, media, property, value)``.

    kind ``rule`` for each rule, ``decl`` for each declaration inside a rule (nested ones count for both), ``media`` for
    each @media with its query as value. An unreadable sheet has no rows.
    """
    return _short_rows(css) if len(css) <= SHORT else _rows(css)


@functools.lru_cache(maxsize=REMEMBERED)
def _short_rows(css: str) -> tuple:
    return tuple(_rows(css))


def _rows(css: str):
    try:
        sheet = parse(css)
    except BrokenCss:
        return
    rule = 0
    for block, around in sheet.blocks():
        if block.name and block.name.lower() == "media":
            yield "media", None, None, None, None, None, block.params.strip() or "unknown"
        if block.selector is None:
            continue
        media = media_context(around)
        yield "rule", rule, None, block.selector, media, None, None
        for k, (prop, value, _, _) in enumerate(block.declarations()):
            yield "decl", rule, k, block.selector, media, prop, value
        rule += 1
