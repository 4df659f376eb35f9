"""Content types, hashes and text functions as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MIME type by extension.
MIME_BY_EXTENSION = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "mjs": "text/javascript",
    "cjs": "application/node", "json": "application/json", "map": "application/json", "xml": "text/xml", "txt": "text/plain",
    "csv": "text/csv", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "webp": "image/webp", "avif": "image/avif", "ico": "image/vnd.microsoft.icon", "bmp": "image/bmp", "woff": "font/woff",
    "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf", "eot": "application/vnd.ms-fontobject", "pdf": "application/pdf",
    "mp4": "video/mp4", "webm": "video/webm", "mp3": "audio/mpeg", "wav": "audio/wav", "zip": "application/zip", "wasm": "application/wasm",
}
#: Extension by MIME type.
EXTENSION_BY_MIME = {
    "text/html": "html", "text/css": "css", "text/javascript": "js", "application/javascript": "js", "application/json": "json",
    "text/xml": "xml", "application/xml": "xml", "text/plain": "txt", "text/csv": "csv", "image/svg+xml": "svg", "image/png": "png",
    "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/avif": "avif", "image/x-icon": "ico",
    "image/vnd.microsoft.icon": "ico", "image/bmp": "bmp", "font/woff": "woff", "font/woff2": "woff2", "font/ttf": "ttf",
    "font/otf": "otf", "application/vnd.ms-fontobject": "eot", "application/pdf": "pdf", "video/mp4": "mp4", "video/webm": "webm",
    "audio/mpeg": "mp3", "application/zip": "zip", "application/wasm": "wasm",
}
DEFAULT_MIME = "application/octet-stream"
_IMAGE, _FONT, _SCRIPT = r"\.(png|jpe?g|gif|webp|svg|avif|ico)$", r"\.(woff2?|ttf|otf|eot)$", r"\.(m?js|cjs)$"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def looks_like_html(content_type: Column, url: Column) -> Column:
    """FN1."""
    path = F.lower(F.regexp_extract(url, "^[^#?]*", 0))
    return F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False)) | path.endswith(".html") | path.endswith(".htm")


def mime_type(content_type: Column, url: Column) -> Column:
    """FN2: the header's type, else by extension, else a default."""
    header = F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), "^[^;]*", 0))
    by_name = _lookup(MIME_BY_EXTENSION, F.lower(F.regexp_extract(F.regexp_extract(url, "^[^#?]*", 0), r"\.([A-Za-z0-9]+)$", 1)))
    return F.when(header != "", header).otherwise(F.coalesce(by_name, F.lit(DEFAULT_MIME)))


def data_url(body: Column, mime: Column) -> Column:
    """FN3."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(body), r"[\r\n]", ""))


def asset_kind(url: Column, content_type: Column) -> Column:
    """FN4: ``img``, ``css`` or ``other`` by header, then by extension; null for what is not kept."""
    header = F.coalesce(content_type, F.lit(""))
    path = F.lower(F.regexp_extract(url, r"^[^?]*", 0))
    return (
        F.when(header.startswith("image/"), F.lit("img"))
        .when(header.contains("text/css"), F.lit("css"))
        .when(header.contains("javascript") | header.contains("ecmascript") | header.contains("font"), F.lit("other"))
        .when(path.endswith(".css"), F.lit("css"))
        .when(path.rlike(_SCRIPT), F.lit("other"))
        .when(path.rlike(_IMAGE), F.lit("img"))
        .when(path.rlike(_FONT), F.lit("other"))
    )


def file_extension(content_type: Column, url: Column) -> Column:
    """FN5: with its dot, by MIME type, else the path's own, else ''."""
    header = F.lower(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), "^[^;]*", 0)))
    own = F.regexp_extract(F.regexp_extract(url, "^[^#?]*", 0), r"/[^/]+(\.[^./]*)$", 1)
    return F.coalesce(F.concat(F.lit("."), _lookup(EXTENSION_BY_MIME, header)), own)


def content_hash(body: Column) -> Column:
    """FN6."""
    return F.substring(F.sha2(body.cast("binary"), 256), 1, 16)


def css_hash(css: Column) -> Column:
    """FN7."""
    return F.substring(F.sha1(css), 1, 12)


def normalize_text(value: Column) -> Column:
    """FN8: white space, Unicode's too, collapsed and trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)[\s﻿]+", " "))


def byte_length(value: Column) -> Column:
    """FN9."""
    return F.octet_length(value).cast("long")


def escape_html(value: Column) -> Column:
    """FN10."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def yaml_string(value: Column) -> Column:
    """FN11: bare where YAML reads it as a string, quoted otherwise."""
    bare = value.rlike(r"^[A-Za-z0-9._/-]+$") & ~value.rlike(r"(?i)^(true|false|null|yes|no)$")
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(bare, value).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))


def clean_font_family(value: Column) -> Column:
    """FN12."""
    return F.regexp_replace(value, "^['\"]+|['\"]+$", "")


def run_stamp(at: Column) -> Column:
    """FN13."""
    return F.date_format(at, "yyyy-MM-dd_HH-mm-ss")


def is_placeholder_src(value: Column) -> Column:
    """FN14: an image source that stands for one still to be loaded."""
    v = F.trim(F.coalesce(value, F.lit("")))
    small = v.startswith("data:image/") & (F.length(v) < 2048)
    return v.isin("", "#", "about:blank") | v.startswith("data:image/gif") | v.startswith("data:image/svg+xml") | small | v.startswith("data:,")
