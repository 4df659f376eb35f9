"""Scope predicates (FLT1 to FLT6) as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..functions.options import Options
from ..functions.urls import Url, is_http_url, origin, url_parts


def _alternatives(body: str, opening: str, closing: str) -> tuple[list[str], int]:
    """Parts of a bracketed list that starts at 0, split at commas or bars of its own level, and its length."""
    depth, parts, at = 0, [""], 0
    for at, c in enumerate(body):
        depth += (c == opening) - (c == closing)
        if depth == 0:
            return parts, at + 1
        if at and depth == 1 and c in ",|":
            parts.append("")
        elif at:
            parts[-1] += c
    raise ValueError("unbalanced")


_RANGE = re.compile(r"\{([^{},/]*\.\.[^{},/]*)\}")


def _range(ends: list[str]) -> str:
    """``{a..c}``: one character of a class from the least end on, whatever its length, as globs read it; if that is no
    class, the ends as written."""
    made = f"[{'-'.join(sorted(ends))}]"
    try:
        re.compile(made)
        return made
    except re.error:
        return r"\.\.".join(re.escape(e) for e in sorted(ends))


def glob_to_regex(glob: str) -> str:
    """FLT4: ``*`` and ``?`` stay inside a segment, ``**`` crosses them as a segment of its own; braces, ranges, classes
    and extended groups work; segments that start with a dot need one in the pattern."""

    def convert(g: str, start: bool) -> str:
        out, i = "", 0
        while i < len(g):
            c = g[i]
            begins = start and i == 0 or i > 0 and g[i - 1] == "/"
            no_dot = r"(?!\.)" if begins else ""
            if c in "@+?!*" and g[i + 1 : i + 2] == "(":
                try:
                    parts, n = _alternatives(g[i + 1 :], "(", ")")
                except ValueError:
                    parts, n = None, 0
                if parts is not None:
                    inner = "|".join(convert(p, False) for p in parts)
                    out += {"@": f"(?:{inner})", "+": f"(?:{inner})+", "?": f"(?:{inner})?", "*": f"(?:{inner})*", "!": f"(?:(?!(?:{inner})$)[^/]*?)"}[c]
                    i += 1 + n
                    continue
            if g.startswith("**", i):
                stop = i
                while g[stop : stop + 1] == "*":
                    stop += 1
                if begins and g[stop : stop + 1] in ("/", ""):
                    segment = r"(?!\.)[^/]+"
                    if g[stop : stop + 1] == "/":
                        out += f"(?:{segment}/|/)*" if not (start and i == 0) else f"(?:(?:{segment})?/)*"
                        stop += 1
                    else:
                        out += rf"(?:(?:(?!\.)[^/]*)(?:/(?!\.)[^/]*)*)"
                else:
                    out += no_dot + "[^/]*"
                i = stop
            elif c == "*":
                out += no_dot + ("[^/]*" if not begins or g[i + 1 : i + 2] not in ("", "/") else "[^/]+")
                i += 1
            elif c == "?":
                out += no_dot + "[^/]"
                i += 1
            elif c == "{" and (dots := _RANGE.match(g, i)):
                out += _range(dots[1].split(".."))
                i = dots.end()
            elif c == "{" and "," in g[i:]:
                try:
                    parts, n = _alternatives(g[i:], "{", "}")
                    out += "(?:" + "|".join(convert(p, False) for p in parts) + ")"
                    i += n
                except ValueError:
                    out += re.escape(c)
                    i += 1
            elif c == "[" and "]" in g[i + 2 :]:
                end = g.index("]", i + 2)
                body = g[i + 1 : end].replace("\\", r"\\").replace("[", r"\[")
                out += "[" + ("^/" + body[1:] if body[0] in "!^" else body) + "]"
                i = end + 1
            elif c == "\\" and i + 1 < len(g):
                out += re.escape(g[i + 1])
                i += 2
            else:
                out += re.sub(r"([.^$|()\[\]{}+*?\\])", r"\\\1", c)
                i += 1
        return out

    return "^" + convert(glob, True) + "$"


def matches_any(value: Column, globs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | value.rlike(glob_to_regex(g))
    return out


def in_scope(url: Column, options: Options) -> Column:
    """FLT1 to FLT3 and FLT5: whether a normalised URL belongs to the crawl; never null."""
    base = Url(options.url)
    if options.scope == "subdomains":
        inside = bound(url_parts(url).host, lambda h: (h == base.host) | h.endswith("." + base.host))
    elif options.scope == "custom":
        inside = (matches_any(url, options.include) if options.include else F.lit(True)) & ~matches_any(url, options.exclude)
    else:
        inside = origin(url) == base.origin
    return F.coalesce(is_http_url(url) & inside, F.lit(False))
