import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.llm import exact_dedup, fingerprints, near_dedup
from pageloom.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, kept string, rep string, score double"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 1.0) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (4, "one"), (5, "one"), (None, "one"), (None, None), (7, "ONE"), (8, "a b c d e f " * 3000), (9, "a b c d e f " * 3000 + "g")]


def test_exact_dedup(spark):
    rows = exact_dedup.exact_dedup(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by_text = defaultdict(list)
    for r in rows:
        by_text[bytes(r.digest)].append(r)
    for group in by_text.values():
        assert {r.group_size for r in group} == {len(group)} and sum(r.kept for r in group) == 1
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {max(ids, default=None)}
    assert by_text[hashlib.sha256(b"one").digest()][0].group_size == 4
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, path)
    assert first.dedup(docs(spark, [(1, "a"), (2, "b")])).where("kept").count() == 2
    again = exact_dedup.DigestIndex(spark, path, first.buckets)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in again.dedup(docs(spark, [(5, "a"), (6, "c"), (7, "c")])).collect()}
    assert got == {5: (1, 2, False), 6: (7, 2, False), 7: (7, 2, True)}
    assert again.rows().count() == 3


def test_index_keeps_its_buckets(spark, tmp_path):
    """The number of buckets belongs to the index, not to the session that opens it."""
    path, rows = f"file://{tmp_path}/index", docs(spark, [(i, f"text {i}") for i in range(300)])
    assert exact_dedup.DigestIndex(spark, path, 8).dedup(rows).where("kept").count() == 300
    assert exact_dedup.exact_dedup(rows, path).where("kept").count() == 0
    assert exact_dedup.DigestIndex(spark, path).rows().count() == 300
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 4)
    for name in ("_buckets", "._buckets.crc"):  # an index of before the number was stored
        (tmp_path / "index" / name).unlink()
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path)
    assert exact_dedup.DigestIndex(spark, path, 8).dedup(rows).where("kept").count() == 0


def test_survivors(spark):
    kept = exact_dedup.DigestIndex(spark).survivors(docs(spark, ODD))
    assert kept.columns == ["doc_id", "text", "kept", "rep", "score"]
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in ODD})


def test_hot_digest(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(rows)
    assert got.where("group_size = 1000 and keep_id = 2997").count() == 1000 and got.where("kept").count() == 2001


@pytest.mark.parametrize("one_task", [0, 100, 1000])
def test_connected_components(spark, one_task):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    parent = list(range(2000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), one_task=one_task).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def brute(rows, shingle, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def made_texts(seed, n_groups=12):
    """Groups of near copies with growing numbers of edits, short texts, a shared passage, odd cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(n_groups):
        base = [word() for _ in range(rng.choice([3, 5, 7, 12, 30, 90, 180, 400, 900]))]
        for c in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[word()], [], [word(), w[k]]]) or ([word()] if len(w) == 1 else [])
            if c % 4 == 3:
                w = w + passage
            rows.append(" ".join(w) if c % 3 else " \n".join(w).upper())
    return [(i, t) for i, t in enumerate([*rows, "", None, " ", "the the", "THE the", "solo"], 100)]


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_components_match_brute_force(spark, shingle):
    rows = made_texts(shingle)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(docs(spark, rows), shingle).collect()}
    assert got == brute(rows, shingle)


def test_near_components_of_a_large_group(spark, monkeypatch):
    """A group over several blocks, with texts that are linked to a few others only."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(60)], []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows = list(enumerate(rows, 1))
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(docs(spark, rows), 2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()}


def test_near_copies_of_short_texts_with_a_template(spark):
    """Thousands of texts share most of their words; each is linked with its own copy alone."""
    rng = random.Random(11)
    rows, want = [], {}
    for template, own, added, first in ((6, 3, 2, 0), (5, 3, 2, 10_000)):
        ids = list(range(first, first + 4000))
        rng.shuffle(ids)
        for k in range(2000):
            w = [f"t{first}x{i}" for i in range(template)] + [f"o{first}x{k}x{i}" for i in range(own)]
            a, b = ids[2 * k : 2 * k + 2]
            rows += [(a, " ".join(w)), (b, " ".join([*w, *(f"a{first}x{k}x{i}" for i in range(added))]))]
            want |= {a: min(a, b), b: min(a, b)}
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(docs(spark, rows), 1).collect()}
    assert sum(got[i] != c for i, c in want.items()) == 0


def test_near_dedup_odd_cases(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(docs(spark, ODD), 2).collect()), key=str)
    assert len(got) == len(ODD)
    by = {r[0]: r for r in got}
    assert by[1] == (1, 0, 1, True) and by[3] == (3, 0, 3, True) and by[5][2] == 4 and by[7][2] == 4 and not by[7][3] and by[9][2] == 8
    assert by[None][2] is None and by[None][3]
    assert near_dedup.near_components(docs(spark, []), 2).count() == 0
    kept = near_dedup.keep_one(docs(spark, ODD), 2)
    assert kept.columns == ["doc_id", "text", "kept", "rep", "score"] and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 8, None}


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "a b c"), (2, "d e f"), (3, "a b c"), (3, "d e f"), (4, "x y z"), (4, "x y z"), (4, "q r s"), (5, "q r s")]
    got = [(r.doc_id, r.component_id) for r in near_dedup.near_components(docs(spark, rows), 2).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (4, 4), (4, 4), (5, 4)]


def test_blocks_join_labels():
    sets = [np.arange(10), np.arange(1, 11), np.arange(100, 110), np.arange(2, 11)]
    ids, sizes, values = np.array([1, 2, 3, 4]), np.array([10, 10, 10, 9]), np.concatenate(sets)
    good = lambda i, there, shared: 100 * shared >= 80 * (sizes[there] + sizes[i] - shared)
    assert near_dedup.Block(ids, ids, sizes, values, 0).joined(good) == [(1, 2), (2, 4)]
    assert near_dedup.Block(ids, np.array([1, 1, 3, 1]), sizes, values, 0).joined(good) == []
    assert near_dedup.Block(ids, ids, sizes, values, 1).joined(good) == [(1, 2)]
    assert near_dedup.Block(ids, ids, sizes, values, 3).joined(good) == [(2, 4)]


@pytest.mark.parametrize("block", [3, 20, 400])
def test_all_pairs_of_other_labels_meet_in_a_task(spark, block):
    rng = random.Random(block)
    rows = [(g, i, rng.choice([0, 0, 0, rng.randrange(1, 60)])) for g in range(3) for i in range((90, 41, 2)[g])]
    dealt = near_dedup.in_blocks(spark.createDataFrame(rows, "key int, doc_id int, label int"), "key", block).collect()
    met, tasks = set(), defaultdict(list)
    for r in dealt:
        tasks[r.task, r.low, r.high].append(r)
    for (_, low, high), own in tasks.items():
        assert len({r.key for r in own}) == 1
        met |= {(x.key, x.doc_id, y.doc_id) for x in own for y in own if x.doc_id < y.doc_id and (low == high or x.block != y.block)}
    assert {(g, i, j) for g, i, x in rows for h, j, y in rows if g == h and i < j and x != y} <= met
    assert max(map(len, tasks.values())) <= 3 * max(block, 6)


def test_estimate():
    values, ends = near_dedup.shingle_sets(pa.array(["a b c d e", "a b c d f", ""]), 2)
    assert ends.tolist() == [4, 8, 8] and len(set(values.tolist())) == 5
    sketch = lambda v: (np.sort(v) >> np.uint64(32)).astype("<u4").tobytes()
    a, b = (near_dedup.padded(pa.array([sketch(v), b""], pa.binary())) for v in (values[:4], values[4:]))
    assert near_dedup.estimate(*a, *b).tolist() == [pytest.approx(3 / 5), 0]


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def test_fingerprints(spark):
    rows = [(i, t) for i, t in made_texts(3)] + [(None, "tail a b c d e f"), (500, "x " * 5000), (500, "x y " * 3000)]
    got = fingerprints.edited_report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    order = sorted([r for r in rows if r[0] is not None], key=lambda r: (r[0], r[1] or ""), reverse=True) + [r for r in rows if r[0] is None]
    expect = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        sets = [shingles(x) for x in (t, edited, after)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        expect.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), like))
    found = {(str(r.doc_id), r.n_chars, r.edited_sha256): r for r in got}
    for i, n, digest, like in expect:
        r = found[(i, n, digest)]
        assert abs(r.near_edited - like[0]) < 0.2 and abs(r.near_next - like[1]) < 0.2
        assert len(r.fingerprint) in (0, 256)
    prints = defaultdict(set)
    for (i, t), r in [((i, t), next(x for x in got if str(x.doc_id) == str(i) and x.n_chars == len(t or ""))) for i, t in rows]:
        prints[t or ""].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    plan = fingerprints.edited_report(docs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert fingerprints.edited_report(docs(spark, [])).count() == 0
    one = fingerprints.edited_report(docs(spark, [(1, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


def test_a_batch_may_be_run_again(spark, tmp_path):
    """A run that died before its result was stored is repeated under its batch's name."""
    path, rows = f"file://{tmp_path}/index", docs(spark, [(i, f"text {i // 2}") for i in range(100)])
    tables = len(spark.catalog.listTables())
    first = sorted(exact_dedup.exact_dedup(rows, path, "monday").collect(), key=lambda r: r.doc_id)
    assert sorted(exact_dedup.exact_dedup(rows, path, "monday").collect(), key=lambda r: r.doc_id) == first and sum(r.kept for r in first) == 50
    assert exact_dedup.exact_dedup(rows, path, "tuesday").where("kept").count() == 0
    more = rows.unionByName(docs(spark, [(200, "text 1")]))
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(more, path, "monday")
    index = exact_dedup.DigestIndex(spark, path)
    assert index.rows().count() == 50 and index.rows().where("batch = 'monday'").count() == 50
    index.close()
    assert len(spark.catalog.listTables()) == tables


def test_shared_runs_are_a_lower_bound():
    """Of two linked sets, however their values lie in hash order, so many runs are shared."""
    rng = random.Random(7)
    for u in [*range(1, 60), 100, 150, 199]:
        for _ in range(40):
            b = u // 5
            at = set(rng.sample(range(u), b)) if rng.random() < 0.5 else set(range(b and u // (b + 1), u, max(1, -(-u // (b + 1))))[:b])
            sides = [rng.random() < 0.5 for _ in range(u)]
            sets = [[i for i in range(u) if i not in at or sides[i] == k] for k in (False, True)]
            for run, least, most in near_dedup.RUNS[1:4]:
                if all(least <= len(s) <= most for s in sets):
                    part, less = near_dedup.SHARED[run]
                    shared = set.intersection(*({tuple(s[k : k + run]) for k in range(len(s) - run + 1)} for s in sets))
                    assert len(shared) >= max(-(-len(s) * round(10 * part) // 10) - less for s in sets)
