"""Conversation repair: the cheapest edits that give a legal sequence of roles.

Rows of a conversation stand by turn (nulls first), then role, then text. Faults are blank texts, rows that repeat an
earlier one, and texts that end amid a sentence. Legal are an optional system row and then user and assistant in turn,
ending with the assistant. Edits: keep, give another role, delete, insert an empty row.

Conversations of about one length make a tensor turn x conversation x state. The costs of all its states are updated a
turn at a time from the last to the first and stored; the edits are then traced from the first turn to the last, each
step for all conversations at once. A conversation of more rows than one task should hold is cut into pieces by turn:
each gives the costs between its states, these are chained, and each piece is then traced from its own entry state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Costs of edits, their initials in ASCII order, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
D, I, K, R = b"DIKR"
#: Roles that edits give, and the initials of roles that may be kept.
USER, ASSISTANT = "user", "assistant"
INITIALS = "sua"

#: States: nothing yet, after system, after user, after assistant. By state: what an inserted row leads to.
_INSERTED = np.array([2, 2, 3, 2])
#: By state and kind of row (system, user, assistant, other): where keeping it leads (-1: not legal there).
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_FAR = np.int64(1) << 40
#: Costs of ending in each state, insertions counted.
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)

#: Codes of rows: kind, and these bits. Padding is a row that nothing is done with.
TRUNCATED_BIT, DELETE_BIT, PAD = 4, 8, 16
#: Cells (turns x conversations) of a tensor, and rows that a task takes at a time.
CELLS, ROWS = 1 << 20, 1 << 17
#: A conversation of more rows is cut into pieces; at most so many are.
LONG, MAX_LONG = 50_000, 10_000
#: Rows of a piece, unless that makes more than so many pieces.
PIECE, PIECES = 20_000, 20_000

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TURNS = "array<struct<role:string,text:string>>"
REPAIRED = f"conv_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, turns {TURNS}"
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


# --- costs and edits of many conversations ---------------------------------------------------------------------------


def state_costs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs [turn, conversation, state] from before each row on; ``codes`` [turn, conversation], ``ends`` [conversation, state]."""
    turns, n = codes.shape
    costs = np.empty((turns + 1, n, 4), np.int64)
    costs[turns] = ends
    for t in range(turns - 1, -1, -1):
        after, code = costs[t + 1], codes[t].astype(np.int64)
        cut = np.where(code & TRUNCATED_BIT, TRUNCATED, 0)
        stays = (code & DELETE_BIT) == 0
        now = after + DELETE
        for s in range(4):
            to = _KEPT[s, code & 3]
            now[:, s] = np.minimum(now[:, s], np.where(stays & (to >= 0), after[np.arange(n), np.maximum(to, 0)] + cut, _FAR))
            now[:, s] = np.minimum(now[:, s], np.where(stays, after[:, _INSERTED[s]] + REROLE + cut, _FAR))
        pad = code >= PAD
        now[pad] = after[pad]
        costs[t] = with_inserts(now, ~pad)
    return costs


def with_inserts(costs: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """Costs [conversation, state] where rows may be inserted first (from each state at most three lead anywhere new)."""
    best = costs.copy()
    for _ in range(3):
        best = np.minimum(best, best[:, _INSERTED] + INSERT)
    return best if where is None else np.where(where[:, None], best, costs)


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, closes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits [turn, slot, conversation] (three slots for insertions before a row, then its own; 0: none), the state before
    each slot, and the state at the end. ``closes``: insertions after the last row, up to a legal end, are edits too.

    Of equally cheap edits the least initial is taken at each step, so the whole audit is the least in ASCII order.
    """
    turns, n = codes.shape
    edits, states = np.zeros((turns + 1, 4, n), np.uint8), np.zeros((turns + 1, 4, n), np.int8)
    each, state = np.arange(n), state.astype(np.int64).copy()
    for t in range(turns + (1 if closes else 0)):
        after, code = (costs[t + 1], codes[t].astype(np.int64)) if t < turns else (costs[t], np.full(n, PAD))
        pad = code >= PAD
        for slot in range(3):
            states[t, slot] = state
            here = costs[t, each, state]
            if t < turns:
                inserts = ~pad & (after[each, state] + DELETE != here) & (costs[t, each, _INSERTED[state]] + INSERT == here)
            else:
                inserts = (here > 0) & (costs[t, each, _INSERTED[state]] + INSERT == here)
            edits[t, slot] = np.where(inserts, I, 0)
            state = np.where(inserts, _INSERTED[state], state)
        if t == turns:
            break
        states[t, 3] = state
        here, cut = costs[t, each, state], np.where(code & TRUNCATED_BIT, TRUNCATED, 0)
        deleted = ~pad & (after[each, state] + DELETE == here)
        to = _KEPT[state, code & 3]
        kept = ~pad & ~deleted & ((code & DELETE_BIT) == 0) & (to >= 0) & (after[each, np.maximum(to, 0)] + cut == here)
        edits[t, 3] = np.where(pad, 0, np.where(deleted, D, np.where(kept, K, R)))
        state = np.where(pad | deleted, state, np.where(kept, to, _INSERTED[state]))
    return edits, states, state


def by_length(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Conversations (places in ``sizes``) in buckets of about one length: at most CELLS cells, at most a quarter padding."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        least = max(1, int(sizes[order[at]]))
        end = int(np.searchsorted(sizes[order], least + least // 4, side="right"))
        longest = max(1, int(sizes[order[end - 1]]))
        end = min(end, at + max(1, CELLS // longest))
        yield order[at:end]
        at = end


def repaired(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of conversations: places, costs, edits and states, for conversations that begin at ``starts`` of ``codes``."""
    for bucket in by_length(sizes):
        turns = int(sizes[bucket].max())
        rows = np.arange(turns)[:, None] + starts[bucket][None, :]
        inside = np.arange(turns)[:, None] < sizes[bucket][None, :]
        tensor = np.where(inside, codes[np.minimum(rows, max(len(codes) - 1, 0))] if len(codes) else 0, PAD)
        costs = state_costs(tensor, np.broadcast_to(_END, (len(bucket), 4)))
        edits, states, _ = trace(tensor, costs, np.zeros(len(bucket), np.int64), True)
        yield bucket, costs[0, :, 0], edits, states


# --- rows and their faults -------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: the rows after damage; a dropped row stays as a mark without a text.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it,
    4 makes its role user. A null role or text is one space, and so is a null conv_id or turn in the hash.
    """
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")), F.lit(":"))][:3])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("harm"),
    )
    text = F.when(F.col("harm") <= 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, USER).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("harm") == 0).alias("gone"), times.alias("_time"))
    return rows.drop("_time")


def kinds_of(role: pa.Array) -> np.ndarray:
    """0 to 2 by the initial of each role in ``INITIALS``, 3 for any other."""
    coded = role.dictionary_encode()
    kinds = np.array([INITIALS.find(r[:1]) if r else -1 for r in coded.dictionary.to_pylist()] or [-1])
    return np.where(kinds < 0, 3, kinds)[coded.indices.to_numpy()] if len(role) else np.zeros(0, int)


def blank_and_cut(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts of white space only; others whose last character besides white space isn't one of ``.!?``."""
    blank = ~pc.match_substring_regex(text, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    return blank, ~blank & ~pc.match_substring_regex(text, r"[.!?][\x20\x09-\x0D]*\z").to_numpy(zero_copy_only=False)


def illegal_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether neighbouring kinds are none of system-user, user-assistant, assistant-user."""
    return ~(((first == 0) | (first == 2)) & (second == 1) | (first == 1) & (second == 2))


def turns_of(edits: np.ndarray, states: np.ndarray, role: list[str], text: list[str]) -> list[dict]:
    """The turns that edits [turn, slot] of a conversation leave, in order."""
    out = []
    for t, slot in zip(*np.nonzero(edits), strict=True):
        edit = edits[t, slot]
        if edit == K:
            out.append({"role": role[t], "text": text[t]})
        elif edit != D:
            given = ASSISTANT if _INSERTED[states[t, slot]] == 3 else USER
            out.append({"role": given, "text": text[t] if edit == R else ""})
    return out


def repair_whole(rows: pa.Table) -> pa.RecordBatch:
    """``REPAIRED`` of whole conversations, whose rows stand together and in order."""
    conv, gone = rows["conv_id"].combine_chunks(), rows["gone"].combine_chunks().to_numpy(zero_copy_only=False)
    known = conv.is_valid().to_numpy(zero_copy_only=False)
    ids = conv.fill_null(0).to_numpy()
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
    names, n = conv.filter(pa.array(new)), int(new.sum())
    own = (np.cumsum(new) - 1)[~gone]  # each row's conversation
    rows = rows.filter(pa.array(~gone))
    role, text = rows["role"].combine_chunks(), rows["text"].combine_chunks()
    sizes = np.bincount(own, minlength=n)
    starts = np.cumsum(sizes) - sizes

    blank, cut = blank_and_cut(text)
    roles, texts = role.dictionary_encode(), text.dictionary_encode()
    same = pd.DataFrame({"conv": own, "row": roles.indices.to_numpy().astype(np.int64) * max(1, len(texts.dictionary)) + texts.indices.to_numpy()})
    again = same.duplicated().to_numpy() & ~blank
    cut &= ~again
    kinds = kinds_of(role)
    illegal = illegal_pairs(kinds[:-1], kinds[1:]) & (own[1:] == own[:-1]) if len(own) else np.zeros(0, bool)

    def counted(rows: np.ndarray, of: np.ndarray = own) -> np.ndarray:
        return np.bincount(of[rows], minlength=n).astype(np.int64)

    turn = rows["turn"].combine_chunks()
    has = turn.is_valid().to_numpy(zero_copy_only=False)
    number, of = turn.drop_null().to_numpy(), own[has]
    gaps = np.zeros(n, np.int64)
    if len(of):
        first, last = np.unique(of, return_index=True)[1], np.concatenate([np.flatnonzero(of[1:] != of[:-1]), [len(of) - 1]])
        step = np.ones(len(of), bool)
        step[1:] = (of[1:] != of[:-1]) | (number[1:] != number[:-1])
        gaps[of[first]] = number[last] - number[first] + 1 - counted(step, of)[of[first]]

    cost, audit, turns = np.zeros(n, np.int64), [""] * n, [[]] * n
    codes = kinds + np.where(cut, TRUNCATED_BIT, 0) + np.where(blank | again, DELETE_BIT, 0)
    for bucket, spent, edits, states in repaired(codes, starts, sizes):
        cost[bucket] = spent
        for j, c in enumerate(bucket):
            made, at = edits[:, :, j], slice(starts[c], starts[c] + sizes[c])
            audit[c] = made[made > 0].tobytes().decode()
            turns[c] = turns_of(made, states[:, :, j], role[at].to_pylist(), text[at].to_pylist())
    cells = [names, gaps, counted(blank), counted(again), counted(cut), counted(illegal, own[1:]), cost, audit, pa.array(turns, pa.list_(_TURN))]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cells], ["conv_id", *COUNTS, "audit", "turns"])


#: Nulls come first.
_ORDER = ["conv_id", "turn", "role", "text"]


def repair_short(rows: DataFrame) -> DataFrame:
    """``REPAIRED`` of conversations that one task can hold: one shuffle and sort by conversation, rows taken as a stream."""

    def repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count < ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = table["conv_id"][len(table) - 1]
            ids = table["conv_id"].combine_chunks()
            mine = pc.equal(ids, last).fill_null(False) if last.is_valid else ids.is_null()
            whole = int(np.argmax(mine.to_numpy(zero_copy_only=False)))  # rows of one conversation stand together
            if whole:
                yield repair_whole(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            count = len(table) - whole
        if count:
            yield repair_whole(pa.Table.from_batches(held))

    return rows.repartition("conv_id").sortWithinPartitions(*_ORDER).mapInArrow(repairs, REPAIRED)


# --- conversations beyond one task -----------------------------------------------------------------------------------


def same_keys(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    return F.expr(" and ".join(f"{a} <=> {b}" for a, b in ((f"l.{k}", f"r.{k}") for k in keys)))


def repair_long(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Conversations of any length: rows in ranges by turn, one vector of state costs between neighbouring pieces.

    Returns counts by conversation (``conv_id`` and ``COUNTS``), and pieces: ``conv_id, part, audit, turns``, in order of
    ``part``. Equal rows are counted first, so that a row repeated without end is one row. The driver gets, for each
    piece, the costs between its states; there are at most about PIECES of them besides two for each conversation.
    """
    keys = ["conv_id", "turn", "role", "text"]
    each = rows.where("not gone").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("same", F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text").cast("binary"), 256))
    size = max(PIECE, total // PIECES)
    each = written(each, "turns")
    parts = max(1, -(-each.count() // size))
    first = each.groupBy("conv_id", "same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    met = each.alias("l").join(first.alias("r"), same_keys(each, first, "conv_id", "same")).select("l.*", (~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("again"))
    ranged = written(met.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "ranges")

    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    coded = ranged.select("*", kind.alias("kind"), blank.alias("blank"), (~blank & F.col("again")).alias("dup"), (~blank & ~F.col("again") & ~ended).alias("cut"))
    coded = coded.withColumn("code", F.col("kind") + F.when(F.col("cut"), TRUNCATED_BIT).otherwise(0) + F.when(F.col("blank") | F.col("dup"), DELETE_BIT).otherwise(0))

    def of_piece(piece: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        piece = piece.sort_values("place", ignore_index=True)
        return piece, piece.code.to_numpy()[:, None]

    def key_columns(piece: pd.DataFrame) -> dict:
        return {"conv_id": pd.array(piece.conv_id.head(1), "Int64"), "part": piece.part.head(1).to_numpy()}

    def between(piece: pd.DataFrame) -> pd.DataFrame:
        """Costs from each state before a piece to each behind it, and the kinds at its ends."""
        piece, codes = of_piece(piece)
        ends = np.where(np.eye(4, dtype=bool), 0, _FAR)
        costs = state_costs(np.repeat(codes, 4, axis=1), ends)[0].T  # [entry, exit]
        kinds = piece.kind.to_numpy()
        pairs = int(illegal_pairs(kinds[:-1], kinds[1:]).sum()) + int((piece.n.to_numpy()[illegal_pairs(kinds, kinds)] - 1).sum())
        return pd.DataFrame(key_columns(piece) | {"costs": [costs.ravel()], "kinds": [[int(kinds[0]), int(kinds[-1])]], "illegal": pairs})

    narrow = coded.select("conv_id", "part", "place", "code", "kind", "n")
    met = narrow.groupBy("conv_id", "part").applyInPandas(between, "conv_id bigint, part int, costs array<bigint>, kinds array<int>, illegal bigint")
    pieces: dict[int | None, list] = {}
    for row in sorted(met.collect(), key=lambda r: r.part):
        pieces.setdefault(row.conv_id, []).append(row)
    cost, illegal, behind = {}, {}, {}
    for conv, own in pieces.items():
        ahead = _END
        illegal[conv] = sum(r.illegal for r in own) + sum(int(illegal_pairs(np.array(a.kinds[1]), np.array(b.kinds[0]))) for a, b in zip(own, own[1:], strict=False))
        for r in reversed(own):
            behind[conv, r.part] = ahead
            ahead = np.minimum((np.array(r.costs).reshape(4, 4) + ahead).min(axis=1), _FAR)
        cost[conv] = int(ahead[0])

    def exits(piece: pd.DataFrame) -> pd.DataFrame:
        """Where each entry state leads."""
        piece, codes = of_piece(piece)
        costs = state_costs(codes, np.array(piece.behind.iloc[0], np.int64)[None, :])
        _, _, out = trace(np.repeat(codes, 4, axis=1), np.repeat(costs, 4, axis=1), np.arange(4), False)
        return pd.DataFrame(key_columns(piece) | {"exits": [out]})

    spark = rows.sparkSession
    known = spark.createDataFrame([(c, p, [int(x) for x in v]) for (c, p), v in behind.items()], "conv_id bigint, part int, behind array<bigint>")
    joined = narrow.alias("l").join(F.broadcast(known).alias("r"), same_keys(narrow, known, "conv_id", "part")).select("l.*", "behind")
    out = {(r.conv_id, r.part): r.exits for r in joined.groupBy("conv_id", "part").applyInPandas(exits, "conv_id bigint, part int, exits array<int>").collect()}
    plan = []
    for conv, own in pieces.items():
        state = 0
        for r in own:
            plan.append((conv, r.part, [int(x) for x in behind[conv, r.part]], state, r is own[-1]))
            state = out[conv, r.part][state]

    def edited(piece: pd.DataFrame) -> pd.DataFrame:
        """A piece's part of the audit, and its turns."""
        piece, codes = of_piece(piece)
        costs = state_costs(codes, np.array(piece.behind.iloc[0], np.int64)[None, :])
        edits, states, _ = trace(codes, costs, piece.entry.to_numpy()[:1], bool(piece.closes.iloc[0]))
        more = [*(piece.n.to_numpy() - 1), 0]  # equal rows after the first are deleted
        audit = "".join(edits[t, :, 0][edits[t, :, 0] > 0].tobytes().decode() + "D" * int(more[t]) for t in range(len(edits)))
        return pd.DataFrame(key_columns(piece) | {"audit": audit, "turns": [turns_of(edits[:, :, 0], states[:, :, 0], list(piece.role), list(piece.text))]})

    plans = spark.createDataFrame(plan, "conv_id bigint, part int, behind array<bigint>, entry int, closes boolean")
    full = coded.select("conv_id", "part", "place", "code", "n", "role", "text")
    joined = full.alias("l").join(F.broadcast(plans).alias("r"), same_keys(full, plans, "conv_id", "part")).select("l.*", "behind", "entry", "closes")
    done = written(joined.groupBy("conv_id", "part").applyInPandas(edited, f"conv_id bigint, part int, audit string, turns {TURNS}"), "pieces")
    # equal rows after the first: blank ones are blank, others are duplicates; each costs its deletion
    sums = coded.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.when(F.col("dup"), 0).otherwise(1))).alias("duplicate"),
        F.count_if("cut").alias("truncated"), F.sum(DELETE * (F.col("n") - 1)).alias("more"),
    )
    turns = coded.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    chained = spark.createDataFrame([(c, illegal[c], cost[c]) for c in pieces], "conv_id bigint, illegal bigint, chain bigint")
    made = rows.select("conv_id").distinct()
    for part in (sums, turns, chained):
        made = made.alias("l").join(part.alias("r"), same_keys(made, part, "conv_id"), "left").select("l.*", *[F.col(f"r.{c}") for c in part.columns if c != "conv_id"])
    made = made.withColumn("cost", F.col("chain") + F.col("more"))
    return made.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]), done


def with_long(rows: DataFrame, long: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of conversations of at most ``long`` rows (or, if more, a part of 1 / MAX_LONG of all rows), the others, and the
    number of all rows."""
    total = rows.select(F.count(F.lit(1))).first()[0]
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.where(F.col("n") > max(long, total // MAX_LONG)).select("conv_id").collect()  # at most MAX_LONG
    if not found:
        return rows, None, total
    keys = rows.sparkSession.createDataFrame(found, "conv_id bigint")

    def those(how: str) -> DataFrame:
        return rows.alias("l").join(F.broadcast(keys).alias("r"), F.expr("l.conv_id <=> r.conv_id"), how)

    return those("left_anti"), those("left_semi"), total


def repair(rows: DataFrame, long: int = LONG) -> DataFrame:
    """``conv_id, part, turns``: the repaired turns of every conversation of ``rows`` (``conv_id, turn, role, text, gone``),
    in order; only conversations of more than ``long`` rows have several parts. See ``repair_report``."""
    short, others, total = with_long(rows, long)
    out = repair_short(short).select("conv_id", F.lit(0).alias("part"), "turns")
    return out if others is None else out.unionByName(repair_long(others, total)[1].select("conv_id", "part", "turns"))


def lines(turns: str) -> Column:
    """``role:text`` of turns, newline-joined."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def hashed_in_order(pieces: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of all lines of a conversation's pieces.

    SHA-256 has to see the lines in order: one task streams a conversation's, a piece at a time, and keeps no text.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()
        sha, begun = hashlib.sha256(), False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            for conv, text in zip(batch["conv_id"].to_pylist(), batch["lines"], strict=True):
                if now and now[0] != conv:
                    yield row()
                    sha, begun = hashlib.sha256(), False
                now = (conv,)
                if text.is_valid:
                    sha.update(b"\n" if begun else b"")
                    sha.update(text.as_buffer())
                    begun = True
        if now:
            yield row()

    spelled = pieces.select("conv_id", "part", F.when(F.size("turns") > 0, lines("turns")).alias("lines"))
    return spelled.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(hashed, "conv_id bigint, repaired_sha256 string")


def repair_report(rows: DataFrame, long: int = LONG) -> DataFrame:
    """One row for every conv_id of ``rows`` (``conv_id, turn, role, text, gone``), a null one too: ``conv_id``, ``COUNTS``,
    ``audit`` and ``repaired_sha256``.

    Rows that agree in turn stand by role, then text; rows that agree in all are repeated rows: all but the first are
    duplicates. A role that begins with no initial of a legal one (an empty one too) can't be kept. An empty table gives
    no rows; a conversation whose rows are all gone has zeros, an empty audit and the hash of nothing. Texts are read
    whole. Conversations of more than ``long`` rows are cut into pieces (``repair_long``).
    """
    short, others, total = with_long(rows, long)
    out = repair_short(short).select("conv_id", *COUNTS, "audit", F.sha2(lines("turns").cast("binary"), 256).alias("repaired_sha256"))
    if others is None:
        return out
    counts, pieces = repair_long(others, total)
    audits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "")  # a string a piece
    for part in (pieces.groupBy("conv_id").agg(audits.alias("audit")), hashed_in_order(pieces)):
        counts = counts.alias("l").join(part.alias("r"), same_keys(counts, part, "conv_id"), "left").select("l.*", *[F.col(f"r.{c}") for c in part.columns if c != "conv_id"])
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    counts = counts.select("conv_id", *COUNTS, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
    return out.unionByName(counts)
