"""Quality scores against a plain refit, and every stage of the pipeline against a plain version of it."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np

from pageloom.llm import quality, tokens
from pageloom.llm.queries import ORACLE_SQL

from . import plain
from .test_text_operators import LONG, docs, made_quality

ODD_TEXTS = [None, "", " \n ", "ONE", "Ünïcode WÖRDER ÉTÉ été x", LONG, "a a a a", "x#y $$ %%\n\n!!?"]


def test_statistics_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = [t or "" for t in ODD_TEXTS] + ["b a b a", "a b", "a"]
    together = quality.statistics(pa.array(texts))
    assert np.allclose(together, [plain.statistics(t) for t in texts], atol=1e-12)
    assert (together == np.vstack([quality.statistics(pa.array([t])) for t in texts])).all()


def test_quality_against_a_plain_refit(spark):
    rng = random.Random(2)
    rows, labels = made_quality(260, seed=3)
    labels = [(i, 1 - q if q is not None and rng.random() < 0.1 else q) for i, q in labels] + [(1, 1), (None, 0), (99_999, 0)]
    rows = [(i, t) for i, t, _ in rows] + [(5000 + k, t) for k, t in enumerate(ODD_TEXTS)]
    got = quality.classify(docs(spark, [(i, t, "s") for i, t in rows]).repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    got = {r.doc_id: r.score for r in got.collect()}
    want = plain.quality_scores(spark, rows, labels)
    assert np.allclose([got[i] for i, _ in rows], want, atol=1e-6) and 0.1 < np.mean(want) < 0.95


def test_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    rows, labels = made_quality(160, seed=5)
    rows = [(i, t, "abc"[i % 3] if i % 11 else None) for i, t, _ in rows]
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    rows += [(1000 + i, rows[i][1], "b") for i in range(0, 60, 3)]  # exact copies
    rows += [(2000 + i, rows[i][1] + " " + word(), "c") for i in range(1, 60, 2)]  # near copies
    rows += [(3000 + i, rows[i][1] + " " + word() + " " + word(), "c") for i in range(1, 60, 6)]
    rows += [(4000, None, None), (4001, "", "a"), (4003, "few words here", "a")]
    long = [i for i in range(4100, 4120) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows += [(i, " ".join(word() for _ in range(10_000)), "a") for i in long]
    labels += [(i, 1) for i in long]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema).repartition(5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, read):
        stages[name](spark, read, str(tmp_path)).write.parquet(f"{tmp_path}/{name.split()[0]}-{name.split()[-1]}")
        out = spark.read.parquet(f"{tmp_path}/{name.split()[0]}-{name.split()[-1]}")
        return out, [(r.doc_id, r.text, r.source) for r in out.collect()]

    scores = plain.quality_scores(spark, [(i, t) for i, t, _ in rows], labels)
    assert not np.any(np.abs(scores - quality.THRESHOLD) < 1e-5)
    want = [r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]
    read, got = stage("quality classifier", spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sorted(got, key=str) == sorted(want, key=str) and set(long) <= {i for i, *_ in got} and len(got) < len(rows)

    last = {}
    for i, t, s in want:
        last[t or ""] = max(last.get(t or "", (i, t, s)), (i, t, s), key=lambda r: r[0])
    read, got = stage("exact dedup", read)
    assert sorted(got, key=str) == sorted(last.values(), key=str) and len(got) < len(want)

    least = plain.near_components([(i, t) for i, t, _ in got])
    want = [r for r in got if least[r[0]] == r[0]]
    near, got = stage("near dedup", read)
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) < len(last)

    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/near-dedup/*.parquet'")
    taken = {r[0]: r[1] for r in sql.sql(f"SELECT doc_id, taken FROM ({ORACLE_SQL['op2_source_mixing']})").fetchall() if r[1]}
    texts = {i: plain.words_of(t) for i, t, _ in got}
    read, got = stage("source mixing", near)
    count = Counter()
    for i, t, _ in got:
        w = plain.words_of(t)
        assert w == texts[i][: len(w)]
        count[i] += len(w)
    assert count == taken and len(got) > len(texts) / 2

    read, _ = read, got
    pieces = sorted(stages["packing"](spark, read, str(tmp_path)).collect(), key=lambda r: (r.sequence_id, r.offset))
    encode = tokens.tokenizer(tokens.vocabulary("word_bpe_49k.json"))
    expected = [(i, np.array([*encode.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t, _ in got]
    at, left = 0, 0
    for p in pieces:  # pieces in order are the documents of the mix in order
        doc, ids = expected[at]
        assert (p.doc_id, p.start, p.doc_tokens) == (doc, left, len(ids)) and zlib.crc32(ids[left : left + p.length].tobytes()) == p.ids_crc32
        left += p.length
        if left == len(ids):
            at, left = at + 1, 0
    assert at == len(expected)
    filled = Counter()
    for p in pieces:
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 2048 and sorted(filled) == list(range(len(filled)))

    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = lambda rows: sorted(Counter({k: sum(r.length for r in rows if r.doc_id == k) for k in {r.doc_id for r in rows}}).items())
    assert total(ran) == total(pieces)
