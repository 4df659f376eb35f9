"""Toxicity: n-grams against a plain version, the fit against a plain optimum, held-out labels, odd input."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def plain_grams(text):
    words = set(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()))
    return {w[i : i + n] for w in (b" " + w + b" " for w in words) for n in T.SIZES for i in range(len(w) - n + 1)}


def test_ngrams_equal_plain():
    texts = ["", " \n", "a", "An apple, an APPLE", "été d'été", "x" * 40, "one two one", "\x00 b"]
    of, place, grams = T.text_features(pa.array(texts))
    mine = [{int(grams[p]) for p in place[of == i]} for i in range(len(texts))]
    wanted = [plain_grams(t) for t in texts]
    assert [len(m) for m in mine] == [len(w) for w in wanted]
    spelled = {}
    for a, b in zip(mine, wanted, strict=True):  # one hash a spelling: texts that share an n-gram share its hash
        for c, d in zip(mine, wanted, strict=True):
            assert len(a & c) == len(b & d)
        spelled |= dict.fromkeys(a)
    assert len(spelled) == len(set().union(*wanted)) == len(grams)
    known = np.sort(grams[::3])
    of2, place2, _ = T.text_features(pa.array(texts), known)
    assert [{int(known[p]) for p in place2[of2 == i]} for i in range(len(texts))] == [m & set(known.tolist()) for m in mine]
    assert len(T.text_features(pa.array(texts), known[:0])[0]) == 0


def test_fit_equals_plain_optimum():
    rng = np.random.default_rng(3)
    x = rng.random((60, 9)) < 0.3
    y = (x[:, 0] | (rng.random(60) < 0.2)).astype(float)
    ratios = T.log_count_ratio(x.T @ y, x.T @ (1 - y), y.sum(), (1 - y).sum())
    of, gram = np.nonzero(x)
    w, b = T.logistic_fit(of, gram, ratios, y, steps=3000)
    z, v = np.column_stack([x * ratios, np.ones(60)]), np.zeros(10)
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-z @ v))
        penalty = np.append(np.full(9, T.RIDGE), 0)
        v -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * v)
    assert np.allclose(np.append(w, b), v, atol=1e-5)


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    return docs, labels, T.classify(docs, labels).toPandas()


def test_whole_table(scored):
    docs, _, rows = scored
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()


def test_held_out_labels(scored):
    """English abuse is a few words that the fit knows; of other languages' it has seen a few texts only."""
    docs, labels, rows = scored
    known = rows[rows.held_out].merge(labels.toPandas(), on="doc_id").merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    english = known[known.lang == "en"]
    assert ((english.predicted == english.toxic).mean() > 0.98) and ((known.predicted == known.toxic).mean() > 0.96)
    assert known[known.toxic == 0].predicted.mean() < 0.01


def test_held_out_rows_teach_nothing(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "vile " * (i % 2) + f"plain text {i}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    turned = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2) for i in range(400)], "doc_id bigint, toxic int")
    a, b = ({r.doc_id: r.score for r in T.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b and all((a[i] >= 0.5) == (i % 2 == 1) for i in held)


def test_odd_input(spark):
    schema = "doc_id bigint, text string"
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id bigint, toxic int")
    rows = [(None, None), (1, ""), (1, "word " * 300_000), (2, " \t"), (2, " \t"), (3, "fine")]
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], schema + ", toxic int, grams string")
    for known in (labels, labels.limit(0)):
        found = T.classify(table, known).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
        assert T.classify(table.limit(0), known).count() == 0
    assert {r.score for r in T.classify(table, labels.limit(0)).collect()} == {0.0}
