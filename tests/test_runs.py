"""Stored runs as a data source: round trips, filters, runs that are broken off, rewriting in place."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pageloom.functions.options import Options
from pageloom.plans import run
from pageloom.sources import runs

from .test_run import captured


def made_up(spark, n, parts=6):
    k = F.col("id")
    return spark.range(n).select(
        F.when(k % 3 == 0, "page").otherwise("asset").alias("role"), k.alias("ordinal"), F.concat(F.lit("https://a.example/"), k.cast("string")).alias("url"),
        F.concat(F.when(k % 3 == 0, "pages/").otherwise("pages/assets/"), k.cast("string"), F.lit(".x")).alias("path"),
        (k % 4).cast("int").alias("depth"), F.concat(F.lit("body "), F.repeat(k.cast("string"), 5)).cast("binary").alias("body"),
    ).repartition(parts)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("role", "ordinal", "url", "path", "depth", F.col("body").cast("string")).collect())


def test_round_trip(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/run", made_up(spark, 3000)
    runs.save_run(rows, folder)
    back = runs.load_run(spark, folder)
    assert rows_of(back) == rows_of(rows)
    assert back.rdd.getNumPartitions() == 6
    first = back.where("ordinal = 4").first()
    body = b"body 44444"
    assert (first.size, first.hash, first.stored) == (len(body), hashlib.sha256(body).hexdigest()[:16], "pages/assets/4.x")
    assert (tmp_path / "run/pages/assets/4.x").read_bytes() == body


def test_choices_and_columns_reach_the_reader(spark, tmp_path):
    folder, rows = f"{tmp_path}/run", made_up(spark, 60)
    runs.save_run(rows, folder)
    for f in (tmp_path / "run/pages/assets").iterdir():
        f.unlink()  # a reader that opened these would fail
    assert runs.load_run(spark, folder, bodies=False).count() == 60
    pages = runs.load_run(spark, folder, role="page", prefix="pages/1").where(F.col("depth") > 0)
    assert {r.ordinal for r in pages.collect()} == {15, 18}
    listed = runs.load_run(spark, folder, bodies=False)
    assert listed.where("role = 'page'").unionByName(listed.where("role = 'asset'")).count() == 60


def test_append_and_overwrite(spark, tmp_path):
    folder = f"{tmp_path}/run"
    assert runs.load_run(spark, folder).count() == 0
    runs.save_run(made_up(spark, 9), folder, "append")
    more = made_up(spark, 12).where("ordinal >= 9")
    runs.save_run(more, folder, "append")
    assert rows_of(runs.load_run(spark, folder)) == rows_of(made_up(spark, 12))
    other = made_up(spark, 3).withColumn("body", F.lit("new").cast("binary"))
    runs.save_run(other, folder)
    assert rows_of(runs.load_run(spark, folder)) == rows_of(other)
    assert (tmp_path / "run/pages/0.x").read_bytes() == b"body 00000"  # what was there stays as it was
    runs.save_run(made_up(spark, 3).limit(0), folder)
    assert runs.load_run(spark, folder).count() == 0


def test_a_broken_run_changes_nothing(spark, tmp_path):
    folder, rows = f"{tmp_path}/run", made_up(spark, 30)
    runs.save_run(rows, folder)
    broken = rows.withColumn("body", F.when(F.col("ordinal") == 17, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit("x").cast("binary")))
    with pytest.raises(Exception, match="lost"):
        runs.save_run(broken, folder)
    assert rows_of(runs.load_run(spark, folder)) == rows_of(rows)
    with pytest.raises(Exception, match="isn't a file of the run"):
        runs.save_run(rows.withColumn("path", F.lit("../outside")), folder)
    assert not (tmp_path / "outside").exists()


def test_postprocessing_in_place(spark, tmp_path):
    pages, responses, robots = captured(spark)
    made = run.process(pages, Options("https://example.com/"), responses, robots)
    folder = f"{tmp_path}/run"
    runs.save_run(run.stored_rows(made, "f"), folder)
    before = {r.path: r for r in runs.load_run(spark, folder).collect()}
    assert {r.role for r in before.values()} == {"page", "asset"} and b"data:image" not in before["pages/index.html"].body
    run.postprocess_stored(spark, folder)
    once = {r.path: r for r in runs.load_run(spark, folder).collect()}
    assert b"data:image/png;base64," in once["pages/index.html"].body and set(once) == set(before)
    assert all(once[p] == r for p, r in before.items() if r.role == "asset")
    assert once["pages/index.html"].stored.startswith(".versions/") and once["pages/index.html"].url == "https://example.com/"
    run.postprocess_stored(spark, folder)
    twice = {r.path: r for r in runs.load_run(spark, folder).collect()}
    assert {p: r.body for p, r in twice.items()} == {p: r.body for p, r in once.items()}
