"""Resource map and look-ups: addresses to local files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import asset_kind, content_hash, file_extension
from ..functions.urls import normalize_remote_path, normalize_url, page_path, url_parts


def basename(path):
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def page_mappings(pages: DataFrame, primary_host: str) -> DataFrame:
    """MAP1, J11: ``norm_url, path, kind, seq`` of all queued addresses (``url, seq``); the first registration holds."""
    rows = pages.select(normalize_url(F.col("url")).alias("norm_url"), page_path(F.col("url"), primary_host).alias("path"), "seq").where("norm_url is not null")
    return rows.groupBy("norm_url").agg(F.min_by("path", F.struct("seq", "path")).alias("path"), F.min("seq").alias("seq")).select("norm_url", "path", F.lit("page").alias("kind"), "seq")


def asset_paths(responses: DataFrame) -> DataFrame:
    """SNK2, FN4 to FN6: assets of responses (``page_dir, seq, url, content_type, body``) with kind, hash, size and path;
    what has no kind is dropped (FLT8)."""
    kind, digest = asset_kind(F.col("url"), F.col("content_type")), content_hash(F.col("body"))
    folder = F.when(F.col("kind") == "other", F.lit("assets")).otherwise(F.concat(F.lit("assets/"), F.col("kind")))
    rows = responses.withColumn("kind", kind).where("kind is not null").withColumn("hash", digest)
    name = F.concat("hash", file_extension(F.col("content_type"), F.col("url")))
    return rows.withColumn("path", F.concat_ws("/", F.col("page_dir"), folder, name)).withColumn("size", F.octet_length("body").cast("long"))


def physical_files(assets: DataFrame) -> DataFrame:
    """SNK2: each file once, though manifests name it for every response."""
    return assets.dropDuplicates(["path"])


def asset_mappings(assets: DataFrame) -> DataFrame:
    """MAP2: ``norm_url, path, kind, seq``: the last registration holds."""
    rows = assets.select(normalize_url(F.col("url")).alias("norm_url"), "path", "seq").where("norm_url is not null")
    return rows.groupBy("norm_url").agg(F.max_by("path", F.struct("seq", "path")).alias("path"), F.max("seq").alias("seq")).select("norm_url", "path", F.lit("asset").alias("kind"), "seq")


def basename_mappings(assets: DataFrame) -> DataFrame:
    """MAP2: ``basename, path``: the first registration holds."""
    rows = assets.select(basename(F.col("path")).alias("basename"), "path", "seq").where("basename <> ''")
    return rows.groupBy("basename").agg(F.min_by("path", F.struct("seq", "path")).alias("path"))


def resource_map(page_map: DataFrame, asset_map: DataFrame) -> DataFrame:
    """WIN5: ``norm_url, path, kind``: an asset's mapping overrides a page's."""
    both = page_map.unionByName(asset_map)
    return both.groupBy("norm_url").agg(F.min_by(F.struct("path", "kind"), F.when(F.col("kind") == "asset", 0).otherwise(1)).alias("m")).select("norm_url", "m.path", "m.kind")


def no_name() -> Column:
    """A join key that no file name equals, another for each ``norm_url``, so that rows without a name are spread."""
    return F.concat(F.lit("/"), F.xxhash64("norm_url").cast("string"))


def resolve_local(refs: DataFrame, resources: DataFrame, basenames: DataFrame | None = None) -> DataFrame:
    """J3, J4, MAP3: ``refs`` (with ``norm_url``) and their ``local_path``: by address, else by the name of its file; null if neither."""
    found = refs.join(resources.select("norm_url", F.col("path").alias("_direct")), "norm_url", "left")
    if basenames is None:
        return found.withColumnRenamed("_direct", "local_path")
    named = F.coalesce(F.when(F.col("_direct").isNull(), F.nullif(basename(url_parts(F.col("norm_url")).path), F.lit(""))), no_name())
    found = found.withColumn("_name", named).join(basenames.select(F.col("basename").alias("_name"), F.col("path").alias("_named")), "_name", "left")
    return found.withColumn("local_path", F.coalesce("_direct", "_named")).drop("_direct", "_name", "_named")


def asset_bodies(refs: DataFrame, responses: DataFrame, files: DataFrame, resources: DataFrame) -> DataFrame:
    """J5: ``refs`` (``norm_url``) with ``content_type`` and ``body``: the response, else the stored file of the mapping."""
    last = responses.select(normalize_url(F.col("url")).alias("norm_url"), "content_type", "body", "seq").groupBy("norm_url").agg(F.max_by(F.struct("content_type", "body"), "seq").alias("_r"))
    stored = resources.join(files.select("path", F.col("body").alias("_file")), "path").select("norm_url", "_file")
    both = refs.join(last, "norm_url", "left").join(stored, "norm_url", "left")
    return both.withColumn("content_type", F.col("_r.content_type")).withColumn("body", F.coalesce("_r.body", "_file")).drop("_r", "_file")


def routes(entries: DataFrame) -> DataFrame:
    """MAP4: ``remote_path, with_query, path, rank`` of manifest entries (``url, path, kind, ordinal``): assets, then pages."""
    p = url_parts(F.col("url"))
    rows = entries.withColumn("remote_path", normalize_remote_path(p.path)).withColumn("with_query", F.concat("remote_path", p.search)).where("remote_path is not null and path is not null")
    return rows.select("remote_path", "with_query", "path", F.struct((F.col("kind") == "page").cast("int").alias("late"), "ordinal").alias("rank"))


def manifest_lookup(requests: DataFrame, table: DataFrame) -> DataFrame:
    """J7: ``requests`` (``pathname, search``) with ``local_path``: by path and query, by path, by the longest path that
    ends in the request's; the first entry wins.

    The suffix step is an equi-join as well: a route is listed under each of its suffixes that start with a slash -
    a request path always does - so no pair of a request and an unrelated route is met.
    """
    asked = requests.withColumn("_path", normalize_remote_path(F.col("pathname"))).withColumn("_key", F.concat("_path", F.coalesce("search", F.lit(""))))

    def first(key: str, out: str) -> DataFrame:
        return table.groupBy(F.col(key).alias(f"_{out}_key")).agg(F.min_by("path", "rank").alias(out))

    parts = F.split("remote_path", "/")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    longest = F.struct(-F.length("remote_path"), F.col("rank"))
    by_suffix = table.withColumn("_suffix_key", F.explode(F.array_distinct(suffixes))).groupBy("_suffix_key").agg(F.min_by("path", longest).alias("_suffix"))
    out = asked.join(first("with_query", "_exact"), F.col("_key") == F.col("__exact_key"), "left")
    out = out.join(first("remote_path", "_plain"), F.col("_path") == F.col("__plain_key"), "left")
    out = out.join(by_suffix, F.col("_path") == F.col("_suffix_key"), "left")
    return out.select(*requests.columns, F.coalesce("_exact", "_plain", "_suffix").alias("local_path"))


def default_page(pages: DataFrame, root: str = "") -> DataFrame:
    """AGG13, MAP5: one row ``path``: the shallowest page (``path, depth, ordinal``) inside ``root``, the first of several;
    else the usual index files, if pages has them."""
    inside = pages.where(F.col("path").startswith(root))
    index = [F.max(F.when(F.col("path") == root + name, F.col("path"))) for name in ("pages/index.html", "index.html")]
    return inside.agg(F.coalesce(F.min_by("path", F.struct("depth", "ordinal")), *index).alias("path"))


def path_collisions(pages: DataFrame, primary_host: str) -> DataFrame:
    """D11: ``path, n_urls`` of files that several normalised addresses share."""
    rows = pages.select(normalize_url(F.col("url")).alias("norm_url"), page_path(F.col("url"), primary_host).alias("path")).where("path is not null").distinct()
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_urls")).where("n_urls > 1")


def uncaptured(assets: DataFrame, captured: DataFrame) -> DataFrame:
    """J8: discovered addresses (``norm_url``) that no response brought; sheets stay, so that they are read again."""
    path = F.lower(F.regexp_extract("norm_url", "^[^?]*", 0))
    rest = assets.where(~path.endswith(".css")).join(captured.select("norm_url").distinct(), "norm_url", "left_anti")
    return assets.where(path.endswith(".css")).unionByName(rest)


def numbered(df: DataFrame, partition: list[str], order: list[str], name: str = "seq") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)
