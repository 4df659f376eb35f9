"""Conversation repair against an exhaustive search and a plain version; long conversations cut into pieces."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from pageloom.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def harmed(rows):
    """Rows after damage, one at a time."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def cheapest(kinds):
    """Cost, audit and roles of the cheapest edits by best-first search over (row, roles so far); ``kinds``: (role, fault)."""
    legal = re.compile(r"(s?(ua)+)?")
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if seen.get((i, last), (cost, audit)) < (cost, audit):
            continue
        seen[i, last] = (cost, audit)
        if i == len(kinds) and last in ("", "a"):
            assert legal.fullmatch("".join(m[0][:1] for m in made))
            return cost, audit, made
        nexts = [r for r in step[last] if r != "s"]
        for r in nexts:
            heapq.heappush(heap, (cost + 3, audit + "I", i, r, (*made, ("user" if r == "u" else "assistant", None))))
        if i < len(kinds):
            role, fault = kinds[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, made))
            if fault not in ("blank", "duplicate"):
                cut = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in step[last]:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[:1], (*made, (role, i))))
                for r in nexts:
                    heapq.heappush(heap, (cost + 3 + cut, audit + "R", i + 1, r, (*made, ("user" if r == "u" else "assistant", i))))


def plain(rows):
    """The whole report, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in harmed([r for r in rows if r[0] == conv])), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            marks = WORD.findall(text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, made = cheapest([(r, f) for (_, r, _), f in zip(own, faults, strict=True)])
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        lines = "\n".join(f"{role}:{'' if i is None else own[i][2]}" for role, i in made)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(lines.encode()).hexdigest(),
        )
    return out


def made_up(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", "One. Two", "Ends. \t", "été.", "x"]
    rows = []
    for conv in range(n):
        for k in range(rng.randint(1, most)):
            turn = rng.choice([k, k, k, k + 1, None, rng.randint(-3, 30)])
            rows.append((rng.choice([conv, conv, conv, None]) if conv % 9 == 0 else conv, turn, rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None, "admin"]), rng.choice([*texts, f"Text {k}.", f"cut {k}", None])))
    return rows


def report(table, **options):
    return C.repair_report(C.damaged(table), **options)


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_search(spark, seed):
    rows = made_up(seed, 250, 9)
    assert got(report(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_pieces_equal_whole(spark, monkeypatch):
    rows = made_up(3, 12, 60) + [(0, 5, "user", "Again and again.")] * 40
    monkeypatch.setattr(C, "PIECE", 7)
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(report(table, long=1)) == got(report(table)) == plain(rows)
    turns = {}
    for r in sorted(C.repair(C.damaged(table), long=1).collect(), key=lambda r: r.part):
        turns[r.conv_id] = turns.get(r.conv_id, []) + [tuple(t) for t in r.turns]
    assert turns == {r.conv_id: [tuple(t) for t in r.turns] for r in C.repair(C.damaged(table)).collect()}
    assert {c: hashlib.sha256("\n".join(f"{a}:{b}" for a, b in t).encode()).hexdigest() for c, t in turns.items()} == {c: r[-1] for c, r in plain(rows).items()}


def test_rows_come_in_any_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "ROWS", 3)
    rows = made_up(4, 40, 6)
    assert got(report(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_buckets_hold_everyone_once():
    import numpy as np

    sizes = np.random.default_rng(5).integers(0, 3000, 700)
    found = list(C.by_length(sizes))
    assert sorted(i for b in found for i in b) == list(range(700))
    assert all(sizes[b].max() <= max(1, sizes[b].min()) * 1.25 and len(b) * max(1, sizes[b].max()) <= C.CELLS for b in found)


def test_odd_input(spark):
    assert report(spark.createDataFrame([], SCHEMA)).count() == 0
    whole = "word. " * 200_000
    rows = [(7, 1, "user", whole), (7, 2, "assistant", whole), (None, None, None, None), (8, None, "user", "Hi."), (8, None, "user", "Hi.")]
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", gone string, same int")
    assert got(report(extra)) == plain(rows)
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    table = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert got(report(table)) == got(report(table, long=0)) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
