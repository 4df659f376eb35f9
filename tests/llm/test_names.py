"""Extra columns whose names the operators use themselves, and rows that repeat, in every operator and stage."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import exact_dedup, fingerprints, mixing, near_dedup, packing, periodic, quality, rans, secrets, sharding, token_counts, toxicity

HERE = Path(near_dedup.__file__).parent
#: Every name that a column gets somewhere in the operators' code.
NAMES = sorted({n for p in HERE.glob("*.py") for n in re.findall(r"""(?:alias|withColumn|withColumnRenamed)\((?:"\w+", )?"(\w+)\"""", p.read_text())} | {"shard", "slot", "row", "gone", "label", "fold", "_doc_id", "_to"})
ROWS = [(1, "one two three four five six seven", "a"), (1, "another text with some words in it", "b"), (2, "one two three four five six seven", "a"), (None, None, None), (None, "no id here", "a"), (3, "", "b"), (1, "one two three four five six seven", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string")
    extra = [n for n in NAMES if n not in ("doc_id", "text", "source", "edit_start", "edit_end", "edit_text", "edits")]
    assert len(extra) > 60
    return rows.select("doc_id", *[F.lit(f"own {n}").alias(n) for n in extra], "text", "source")


def test_operators(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, quality int")
    assert quality.classify(odd, labels).count() == exact_dedup.exact_dedup(odd).count() == len(ROWS)
    assert mixing.mixing_plan(odd).count() == near_dedup.near_components(odd, 2).count() == len(ROWS)
    assert fingerprints.edited_report(odd).count() == rans.round_trip(odd).count() == secrets.secret_report(odd).count() == len(ROWS)
    assert token_counts.count_tokens(token_counts.with_middle_edit(odd)).count() == packing.pack(odd).count() == len(ROWS)
    assert periodic.runs_report(odd).count() == toxicity.classify(odd, labels.withColumnRenamed("quality", "toxic")).count() == len(ROWS)
    for key in ("doc_id", "shard", "slot"):
        placed = sharding.place(odd, ["x", "y"], key=key, size=101)
        assert placed.count() == len(ROWS) and {r.shard for r in placed.select("shard").collect()} <= {"x", "y"}


def test_stages(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == odd.columns
        for row in out.collect():
            assert all(row[c] == f"own {c}" for c in odd.columns if c not in ("doc_id", "text", "source"))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = Counter(r.doc_id for r in docs.collect())
    whole = {2: ROWS[0][1], 1: ROWS[1][1], None: "no id here"}
    assert set(left) == set(whole) and max(left.values()) <= 2 and all(whole[r.doc_id].startswith(r.text) for r in docs.collect())
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() == sum(left.values())


def test_empty_pipeline(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
