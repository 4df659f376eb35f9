"""URL functions as Column expressions (http and https), and the same rules for one value in Python.

URL handling follows the WHATWG rules for http(s): scheme and host in lower case, default ports dropped, dot segments
resolved, back slashes as slashes, other characters percent-encoded. A normalised URL has no fragment and loses one
closing slash of its path. Nothing of this uses ``parse_url``, which follows other rules.
"""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound

#: Schemes that are never resolved.
SKIPPED_SCHEMES = ("mailto:", "tel:", "javascript:", "data:")
#: Characters of a path or query that are percent-encoded.
PATH_ENCODED = r"""[^\x21-\x7E]|["<>`{}^]"""
QUERY_ENCODED = r"""[^\x21-\x7E]|["<>']"""
_ABSOLUTE = r"(?i)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def is_http_url(value: Column) -> Column:
    """URL1: starts with ``http://`` or ``https://`` (case-sensitive)."""
    return value.startswith("http://") | value.startswith("https://")


def _encoded(value: Column, pattern: str) -> Column:
    def each(v: Column) -> Column:
        chars = F.transform(F.split(v, ""), lambda c: F.when(c.rlike(pattern), F.regexp_replace(F.hex(c), "(..)", "%$1")).otherwise(c))
        return F.when(v.rlike(pattern), F.array_join(chars, "")).otherwise(v)

    return bound(value, each)


_DOT, _DOTS = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, with its dot segments resolved."""
    none = F.array().cast("array<string>")

    def resolved_parts(parts: Column) -> Column:
        kept = F.aggregate(
            F.slice(parts, F.lit(2), F.size(parts)),
            none,
            lambda done, s: F.when(s.rlike(_DOTS), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s.rlike(_DOT), done).otherwise(F.array_append(done, s)),
        )
        last = F.element_at(parts, -1)
        end = F.when(last.rlike(_DOT) | last.rlike(_DOTS), F.array(F.lit(""))).otherwise(none)
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))

    return bound(path, lambda p: F.when(p.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), bound(F.split(p, "/"), resolved_parts)).otherwise(p))


def _cleaned(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def url_parts(url: Column) -> Column:
    """Struct of an absolute http(s) URL: ``scheme, site, host, port, path, search, fragment``; null if it is none.

    site is scheme, user, host and port; port is '' for the scheme's default; path starts with a slash; search has its
    question mark (alone if the query is empty), fragment its hash.
    """

    def pieces(u: Column) -> Column:
        def group(i: int) -> Column:
            return F.coalesce(F.regexp_extract(u, _ABSOLUTE, i), F.lit(""))

        path = F.regexp_replace(group(3), r"\\", "/")
        parts = F.struct(F.lower(group(1)).alias("scheme"), group(2).alias("authority"), path.alias("path"), group(4).alias("search"), group(5).alias("fragment"))
        return F.when(u.rlike(_ABSOLUTE), bound(parts, place))

    def place(g: Column) -> Column:
        user = F.regexp_extract(g.authority, "^(.*@)?", 0)
        rest = F.regexp_replace(g.authority, "^.*@", "")
        found = F.struct(g.alias("g"), user.alias("user"), F.lower(F.regexp_extract(rest, r"^(\[[^\]]*\]|[^:]*)", 1)).alias("host"), F.regexp_extract(rest, r":(\d+)$", 1).alias("port"))
        return bound(found, whole)

    def whole(f: Column) -> Column:
        default = ((f.g.scheme == "http") & (f.port == "80")) | ((f.g.scheme == "https") & (f.port == "443"))
        port = F.when(default, F.lit("")).otherwise(f.port)
        site = F.concat(f.g.scheme, F.lit("://"), f.user, f.host, F.when(default | (f.port == ""), F.lit("")).otherwise(F.concat(F.lit(":"), f.port)))
        path = _encoded(_without_dots(F.when(f.g.path == "", F.lit("/")).otherwise(f.g.path)), PATH_ENCODED)
        parts = F.struct(
            f.g.scheme.alias("scheme"), site.alias("site"), f.host.alias("host"), port.alias("port"), path.alias("path"),
            _encoded(f.g.search, QUERY_ENCODED).alias("search"), f.g.fragment.alias("fragment"),
        )
        return F.when((f.host != "") & ~f.host.rlike(r"[\x00-\x20#%<>^|]"), parts)

    return bound(_cleaned(url), pieces)


def _query(p: Column) -> Column:
    return F.when(p.search == "?", F.lit("")).otherwise(p.search)


def origin(url: Column) -> Column:
    return bound(url_parts(url), lambda p: F.concat(p.scheme, F.lit("://"), p.host, F.when(p.port != "", F.concat(F.lit(":"), p.port)).otherwise("")))


def _stripped(path: Column) -> Column:
    return F.regexp_replace(path, "(?s)^(.+)/$", "$1")


def href(url: Column) -> Column:
    """The URL as parsed: not yet normalised, fragment kept."""
    return bound(url_parts(url), lambda p: F.concat(p.site, p.path, p.search, p.fragment))


def normalize_url(url: Column) -> Column:
    """URL2: without fragment and one closing slash; null where there is no valid http(s) URL."""
    return bound(url_parts(url), lambda p: F.concat(p.site, _stripped(p.path), _query(p)))


def display_url(url: Column) -> Column:
    """URL3."""
    return F.coalesce(normalize_url(url), url)


def is_skipped(value: Column) -> Column:
    out = F.lit(False)
    for scheme in SKIPPED_SCHEMES:
        out = out | value.startswith(scheme)
    return out


def absolute_url(value: Column, base: Column) -> Column:
    """``value`` resolved against an http(s) URL, fragment kept, not normalised; null if it can't be."""

    def joined(both: Column) -> Column:
        v, p = both.v, both.p
        folder = F.regexp_replace(p.path, "[^/]*$", "")
        return (
            F.when(v.rlike(r"(?i)^https?:[/\\]"), v)
            .when(v.rlike(r"^[/\\]{2}"), F.concat(p.scheme, F.lit(":"), v))
            .when(v.rlike(r"^[/\\]"), F.concat(p.site, v))
            .when(v.startswith("?"), F.concat(p.site, p.path, v))
            .when((v == "") | v.startswith("#"), F.concat(p.site, p.path, _query(p), v))
            .when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
            .otherwise(F.concat(p.site, folder, v))
        )

    return href(bound(F.struct(_cleaned(value).alias("v"), url_parts(base).alias("p")), joined))


def resolve_url(value: Column, base: Column, skip_fragments: bool = True) -> Column:
    """URL4 (or URL5 without ``skip_fragments``): the normalised target of a reference, null for what is skipped."""

    def target(v: Column) -> Column:
        skip = (v == "") | is_skipped(v)
        return F.when(~(skip | v.startswith("#") if skip_fragments else skip), normalize_url(absolute_url(v, base)))

    return bound(value, target)


def url_and_fragment(value: Column) -> Column:
    """URL6: struct of what stands before the first hash, and the rest."""
    at = F.instr(value, "#")
    return F.struct(F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value).alias("url"), F.when(at > 0, F.substring(value, at, F.length(value))).otherwise("").alias("fragment"))


def url_for_file(value: Column) -> Column:
    """URL7: struct of the part before hash and query, and the (first) fragment."""
    hashed = F.get(F.split(value, "#"), F.lit(1))
    return F.struct(F.regexp_extract(value, "^[^#?]*", 0).alias("file"), F.when(F.coalesce(hashed, F.lit("")) != "", F.concat(F.lit("#"), hashed)).otherwise("").alias("fragment"))


def is_local_relative(value: Column) -> Column:
    """URL8."""
    return (value != "") & ~is_skipped(value) & ~value.startswith("#") & ~value.contains("://") & ~value.startswith("/")


def without_suffix(value: Column) -> Column:
    """URL9: cut at the first of hash and question mark."""
    return F.regexp_extract(value, "^[^#?]*", 0)


def sanitize_segment(value: Column) -> Column:
    """URL11."""
    return F.regexp_replace(value, "[^a-zA-Z0-9._-]", "_")


def hash_value(value: Column) -> Column:
    """URL12."""
    return F.substring(F.sha1(value), 1, 10)


def page_path(url: Column, primary_host: Column | str, root: str = "pages") -> Column:
    """URL10: the page's file, by host (unless it is the primary one), path and query; null for an invalid URL."""
    primary = F.lit(primary_host) if isinstance(primary_host, str) else primary_host
    none = F.array().cast("array<string>")

    def file(p: Column) -> Column:
        host = F.when(p.host != F.lower(primary), F.array(sanitize_segment(p.host))).otherwise(none)
        segments = F.transform(F.filter(F.split(p.path, "/"), lambda s: s != ""), sanitize_segment)
        query = F.when(_query(p) != "", F.array(F.concat(F.lit("__q_"), hash_value(p.search)))).otherwise(none)
        return F.when(p.isNotNull(), F.array_join(F.concat(F.array(F.lit(root)), host, segments, query, F.array(F.lit("index.html"))), "/"))

    return bound(url_parts(url), file)


def relative_path(from_file: Column, to_file: Column, empty: str = "./") -> Column:
    """URL13: POSIX path from a file's folder to another file; ``empty`` if that is nothing."""
    a = F.filter(F.split(F.regexp_replace(from_file, "[^/]*$", ""), "/"), lambda s: s != "")
    b = F.filter(F.split(to_file, "/"), lambda s: s != "")

    def path(both: Column) -> Column:
        steps = F.sequence(F.lit(0), F.greatest(F.size(both.a), F.size(both.b)))
        differ = F.filter(steps, lambda i: ~F.coalesce(F.get(both.a, i) == F.get(both.b, i), F.lit(False)))
        up = lambda n: F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(both.a) - n), F.slice(both.b, n + 1, F.size(both.b))), "/")
        return bound(F.get(differ, F.lit(0)), up)

    found = bound(F.struct(a.alias("a"), b.alias("b")), path)
    return F.coalesce(F.nullif(found, F.lit("")), F.when(found.isNotNull(), F.lit(empty)))


def derive_name(url: Column) -> Column:
    """URL14."""
    return F.coalesce(F.nullif(F.regexp_replace(url_parts(url).host, r"^www\.", ""), F.lit("")), url)


def normalize_remote_path(value: Column) -> Column:
    """URL15."""
    return F.when(value.startswith("/"), value).otherwise(F.concat(F.lit("/"), F.coalesce(value, F.lit(""))))


def safe_join(root: str, url_path: Column) -> Column:
    """URL16: a file below ``root`` for a request path; null for bad encoding or a path that leaves the root."""
    decoded = F.try_url_decode(F.regexp_replace(url_path, r"\+", "%2B"))
    parts = F.filter(F.split(decoded, "/"), lambda s: (s != "") & (s != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, s: F.struct((a.d + F.when(s == "..", -1).otherwise(1)).alias("d"), F.least(a.low, a.d + F.when(s == "..", -1).otherwise(1)).alias("low")))
    inside = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return F.when(decoded.isNotNull() & (depth.low >= 0) & ~decoded.contains("\x00"), F.regexp_replace(F.concat(F.lit(root.rstrip("/")), _without_dots(inside)), "/$", ""))


def truncate_url(url: Column, limit: int = 72) -> Column:
    """URL17."""
    return F.when(F.length(url) > limit, F.concat(F.substring(url, 1, limit - 3), F.lit("..."))).otherwise(url)


def inline_source_url(page_url: Column, index: Column, css_hash: Column) -> Column:
    """URL18: the made-up address of an extracted style block."""
    return F.concat(F.lit("https://inline.scrape.local/"), F.substring(F.sha1(normalize_url(page_url)), 1, 12), F.lit("/inline-"), index.cast("string"), F.lit("-"), css_hash, F.lit(".css"))


class Url:
    """One parsed http(s) URL, by the rules of ``url_parts``."""

    __slots__ = ("scheme", "userinfo", "host", "port", "path", "search", "fragment")
    _pattern = re.compile(_ABSOLUTE)

    def __init__(self, text: str):
        m = self._pattern.match(re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33))))))
        if not m:
            raise ValueError(text)
        self.scheme = m[1].lower()
        self.userinfo = m[2][: m[2].rfind("@") + 1]
        place = m[2][len(self.userinfo) :]
        self.host = re.match(r"(\[[^\]]*\]|[^:]*)", place)[1].lower()
        if not self.host or re.search(r"[\x00-\x20#%<>^|]", self.host):
            raise ValueError(text)
        port = re.search(r":(\d+)$", place)
        self.port = "" if not port or (self.scheme, port[1]) in (("http", "80"), ("https", "443")) else port[1]
        path = m[3].replace("\\", "/") or "/"
        if re.search(r"(?i)/(\.|%2e){1,2}(/|$)", path):
            done: list[str] = []
            parts = path.split("/")[1:]
            for s in (x.lower().replace("%2e", ".") if re.fullmatch(r"(?i)(\.|%2e){1,2}", x) else x for x in parts):
                if s == "..":
                    del done[-1:]
                elif s != ".":
                    done.append(s)
            if re.fullmatch(r"(?i)(\.|%2e){1,2}", parts[-1]):
                done.append("")
            path = "/" + "/".join(done)
        encode = lambda s, p: re.sub(p, lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), s)
        self.path, self.search = encode(path, PATH_ENCODED), encode(m[4] or "", QUERY_ENCODED)
        self.fragment = m[5] or ""

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port else "")

    @property
    def site(self) -> str:
        return f"{self.scheme}://{self.userinfo}{self.host}" + (f":{self.port}" if self.port else "")

    def __str__(self) -> str:
        return f"{self.site}{self.path}{self.search}{self.fragment}"

    def normalized(self) -> str:
        path = self.path[:-1] if len(self.path) > 1 and self.path.endswith("/") else self.path
        return f"{self.site}{path}{'' if self.search == '?' else self.search}"

    def join(self, value: str) -> Url:
        v = re.sub(r"[\t\n\r]", "", value.strip("".join(map(chr, range(33)))))
        path = self.path[: self.path.rfind("/") + 1]
        search = "" if self.search == "?" else self.search
        if re.match(r"(?i)https?:[/\\]", v):
            return Url(v)
        if re.match(r"[/\\]{2}", v):
            return Url(f"{self.scheme}:{v}")
        if re.match(r"[/\\]", v):
            return Url(self.site + v)
        if v.startswith("?"):
            return Url(self.site + self.path + v)
        if not v or v.startswith("#"):
            return Url(self.site + self.path + search + v)
        if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", v):
            raise ValueError(value)
        return Url(self.site + path + v)


def normalized(url: str) -> str | None:
    try:
        return Url(url).normalized()
    except ValueError:
        return None


def resolved(value: str | None, base: str, skip_fragments: bool = True) -> str | None:
    """``resolve_url`` for one value."""
    if not value or value.startswith(SKIPPED_SCHEMES) or (skip_fragments and value.startswith("#")):
        return None
    try:
        return Url(base).join(value).normalized()
    except ValueError:
        return None


def relative(from_file: str, to_file: str, empty: str = "./") -> str:
    path = posixpath.relpath(to_file, posixpath.dirname(from_file) or ".")
    return empty if path == "." else path
