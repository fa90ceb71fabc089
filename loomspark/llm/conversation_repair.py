"""Repairs the structure of conversations by the cheapest edits.

A conversation should read as an optional system turn followed by user and assistant turns in
pairs, or be empty. Keeping a turn costs nothing, giving it another role 3, deleting it 4,
inserting an empty turn 3; truncated turns that stay cost 3 more; blank and repeated turns must
go. Four states (start, after system, after user, after assistant) make this a dynamic program
over four costs a turn.

Turns are sorted by range over all conversations and cut into blocks of BLOCK turns, so a long
conversation is many tasks' work; a block is one string of turn codes. A block's min-plus matrix
gives the costs at its start from those at its end, and the costs at block ends are the
checkpoints. Inside a block, costs are kept at every square root of its length only: the walk
forward recomputes one stretch at a time and takes the ASCII-least edit that keeps to the cheapest
cost. It walks from all four states, as the state at a block's start is known only once the blocks
before are composed. Only matrices, codes and edits (a few bytes a turn) of one conversation meet;
its texts never do, but for the digest, which reads them as a stream.

Null roles and texts are one space; turns sort nulls first, equal turns by role and text. Rows
equal throughout stay apart as repeated turns. A null conv_id is a conversation of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import join_counted, materialize

#: Turns of a block, a power of two.
BLOCK_BITS = 10
#: Costs, and what a turn and its end look like.
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK = r"^[\x20\x09-\x0D]*$"
CLOSED = r"[.!?][\x20\x09-\x0D]*$"

#: A turn's code: its role's initial (x: any other) and its fault, in rows of sound, truncated,
#: blank and repeated turns.
CODES = "suax" "SUAX" "1234" "5678"
_INITIAL = {c: "suax"[i % 4] for i, c in enumerate(CODES)}
_FAULT = {c: i // 4 for i, c in enumerate(CODES)}
#: States: 0 start, 1 after system, 2 after user, 3 after assistant. The role that may come next
#: by insertion or retyping, and where it leads.
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEVER = 1 << 50
#: Costs behind the last turn, and the insertions that they stand for.
END, TAIL = (0, 6, 3, 0), ("", "UA", "A", "")
ROLES = {"u": "user", "a": "assistant"}


# --- the program over one block -----------------------------------------------------------

def _moves(after: tuple[int, ...], code: str, state: int) -> list[tuple[int, str, int]]:
    """Cost, edit and next state of what may be done with a turn, edits in ASCII order."""
    out = [(DELETE + after[state], "d", state)]
    if _FAULT[code] < 2:
        more = TRUNCATED * _FAULT[code]
        if (to := KEEP.get((state, _INITIAL[code]))) is not None:
            out.append((more + after[to], "k", to))
        role, to = NEXT[state]
        out.append((RETYPE + more + after[to], role, to))
    return out


@cache
def _before(after: tuple[int, ...], code: str) -> tuple[tuple[int, ...], int]:
    """Costs before a turn from those after it, less their least, which is given too. There are
    few different ones, so each is computed once."""
    b = [min(m[0] for m in _moves(after, code, s)) for s in range(4)]
    b[2], b[3] = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
    b[0], b[1] = min(b[0], INSERT + b[2]), min(b[1], INSERT + b[2])
    least = min(b)
    return tuple(min(x - least, NEVER) for x in b), least


@cache
def _step(after: tuple[int, ...], code: str, state: int) -> tuple[str, int]:
    """Insertions and edit at a turn on the ASCII-least cheapest way, and the next state. In the
    plan, k d u a are turns kept, deleted and retyped, U A insertions."""
    costs, least = _before(after, code)
    plan = ""
    while True:
        tight = {edit: to for cost, edit, to in _moves(after, code, state) if cost == costs[state] + least}
        if "d" in tight:
            return plan + "d", tight["d"]
        role, to = NEXT[state]
        if INSERT + costs[to] == costs[state]:
            plan, state = plan + role.upper(), to
            continue
        edit = "k" if "k" in tight else role
        return plan + edit, tight[edit]


def _back(codes: str, costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    total = 0
    for code in reversed(codes):
        costs, least = _before(costs, code)
        total += least
    return costs, total


def matrix(codes: str) -> list[int]:
    """Cost of going from each state before the block to each after it, by rows."""
    out = [0] * 16
    for t in range(4):
        costs, total = _back(codes, tuple(0 if s == t else NEVER for s in range(4)))
        out[t::4] = [min(x + total, NEVER) for x in costs]
    return out


def block_ends(matrices: list[list[int]]) -> tuple[list[list[int]], int]:
    """Costs behind each block, less their least, and the cost of the whole conversation."""
    costs, total, out = list(END), 0, []
    for m in reversed(matrices):
        out.append(costs)
        costs = [min(m[4 * s + t] + costs[t] for t in range(4)) for s in range(4)]
        total, costs = total + min(costs), [min(x - min(costs), NEVER) for x in costs]
    return out[::-1], total + costs[0]


def walks(codes: str, end: list[int]) -> tuple[list[int], list[str]]:
    """From each state before the block: the state behind it, and the plan of its edits."""
    stride = isqrt(len(codes)) or 1
    costs, kept = tuple(end), []
    for lo in reversed(range(0, len(codes), stride)):
        kept.append((lo, costs))
        costs, _ = _back(codes[lo : lo + stride], costs)
    states, plans = list(range(4)), [[] for _ in range(4)]
    for lo, costs in reversed(kept):
        stretch = codes[lo : lo + stride]
        after = [costs]
        for code in reversed(stretch[1:]):
            after.append(_before(after[-1], code)[0])
        after.reverse()
        ways = {}
        for start in set(states):
            state, plan = start, []
            for code, costs_after in zip(stretch, after, strict=True):
                piece, state = _step(costs_after, code, state)
                plan.append(piece)
            ways[start] = state, "".join(plan)
        for i, state in enumerate(states):
            states[i], piece = ways[state]
            plans[i].append(piece)
    return states, ["".join(p) for p in plans]


def composed(exits: list[list[int]], plans: list[list[str]]) -> list[str]:
    """The plan of each block on the way from the start, closing insertions at the last."""
    state, out = 0, []
    for exit_, plan in zip(exits, plans, strict=True):
        out.append(plan[state])
        state = exit_[state]
    out[-1] += TAIL[state]
    return out


# --- over all conversations ---------------------------------------------------------------

_LONGS = T.ArrayType(T.LongType())
_STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


@F.pandas_udf(_LONGS)
def _matrix(codes: pd.Series) -> pd.Series:
    return codes.map(matrix)


@F.pandas_udf(_struct(ends=T.ArrayType(_LONGS), cost=T.LongType(), illegal=T.LongType()))
def _ends(codes: pd.Series, matrices: pd.Series) -> pd.DataFrame:
    out = [block_ends([list(m) for m in ms]) for ms in matrices]
    roles = ["".join(_INITIAL[c] for c in cs) for cs in codes]
    illegal = [sum(r[i : i + 2] not in ("su", "ua", "au") for i in range(len(r) - 1)) for r in roles]
    return pd.DataFrame({"ends": [o[0] for o in out], "cost": [o[1] for o in out], "illegal": illegal})


@F.pandas_udf(_struct(exits=_LONGS, plans=_STRINGS))
def _walks(codes: pd.Series, end: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([walks(c, [int(x) for x in e]) for c, e in zip(codes, end, strict=True)], columns=["exits", "plans"])


@F.pandas_udf(_STRINGS)
def _composed(exits: pd.Series, plans: pd.Series) -> pd.Series:
    return pd.Series([composed(list(e), list(p)) for e, p in zip(exits, plans, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(_struct(edit=T.StringType(), at=T.IntegerType(), role=T.StringType())))
def _edits(plan: pd.Series) -> pd.Series:
    """A plan as edits; at is the turn's place in the block, role the new one, if any."""

    def one(p: str) -> list[dict]:
        at, out = 0, []
        for c in p:
            out.append({"edit": {"k": "K", "d": "D"}.get(c, "I" if c.isupper() else "R"), "at": None if c.isupper() else at, "role": ROLES.get(c.lower())})
            at += c.islower()
        return out

    return plan.map(one)


def _key(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults of a test: by crc32(`conv_id:turn`) % 20 a row
    is dropped (0), emptied (1), loses its [.!?] (2), is repeated (3) or becomes the user's (4)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.filter("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def _placed(rows: DataFrame) -> DataFrame:
    """key, pos, block, turn, role, text, written: pos counts turns in order. Where it is
    monotonic across tasks, equal rows may lie in any order."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(_key().alias("key"), F.col("turn").cast("long").alias("turn"), part("role"), part("text")).withColumn("tie", F.monotonically_increasing_id())
    # sort keys of bounded size: long texts of one turn are told apart first by their beginnings
    order = ["key", "turn", "role", F.substring("text", 1, 64), "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions("key", "turn", "role", "text", "tie")
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    return materialize(rows.select("key", "pos", F.shiftright("pos", BLOCK_BITS).alias("block"), "turn", "role", "text"), "turns")


def _coded(turns: DataFrame) -> DataFrame:
    """key, pos, block, code."""
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    # two 64-bit hashes stand for a role and text
    rows = turns.select("key", "pos", "block", place.alias("place"), F.col("text").rlike(BLANK).alias("blank"), (~F.col("text").rlike(CLOSED)).alias("cut"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))
    again = rows.groupBy("key", "h1", "h2").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = join_counted(rows, materialize(again, "repeats"), ["key", "h1", "h2"], "n", F.col("pos"), "left")
    fault = F.when(F.col("blank"), 8).when(F.col("first") < F.col("pos"), 12).when(F.col("cut"), 4).otherwise(0)
    return rows.select("key", "pos", "block", F.substring(F.lit(CODES), fault + F.col("place"), F.lit(1)).alias("code"))


def _sorted(*cols: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*cols)))


def plan_repairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns as _placed gives them. Of every conversation with turns key, codes, cost, illegal and
    audit; and of every block key, block, plan. Both written."""
    blocks = _coded(turns).groupBy("key", "block").agg(_sorted("pos", "code").alias("rows"))
    blocks = blocks.select("key", "block", F.array_join("rows.code", "").alias("codes")).withColumn("matrix", _matrix("codes"))
    whole = blocks.groupBy("key").agg(_sorted("block", "codes", "matrix").alias("b")).withColumn("codes", F.array_join("b.codes", ""))
    whole = materialize(whole.withColumn("e", _ends("codes", "b.matrix")), "ends")
    zipped = F.inline(F.arrays_zip(F.col("b.block").alias("block"), F.col("b.codes").alias("codes"), F.col("e.ends").alias("end")))
    ways = whole.select("key", zipped).withColumn("w", _walks("codes", "end"))
    chosen = ways.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "w.exits", "w.plans"))).alias("w"))
    chosen = materialize(chosen.select("key", "w.block", _composed("w.exits", "w.plans").alias("plan")), "plans")
    audit = chosen.select("key", F.translate(F.array_join("plan", ""), "kuadUA", "KRRDII").alias("audit"))
    summary = whole.select("key", "codes", "e.cost", "e.illegal").join(audit, "key")
    return summary, chosen.select("key", F.inline(F.arrays_zip("block", "plan")))


def _repaired_blocks(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """key, block, turns: the repaired turns (edit, role, text) of every block, deleted ones left out."""
    rows = turns.groupBy("key", "block").agg(_sorted("pos", "role", "text").alias("rows")).join(plans, ["key", "block"])
    stay = F.filter("edits", lambda e: e["edit"] != "D")
    row = lambda e: F.get("rows", e["at"])
    made = F.transform(stay, lambda e: F.struct(e["edit"].alias("edit"), F.coalesce(e["role"], row(e)["role"]).alias("role"), F.coalesce(row(e)["text"], F.lit("")).alias("text")))
    return rows.withColumn("edits", _edits("plan")).select("key", "block", made.alias("turns"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), role, text: the turns of the repaired conversations;
    place grows along a conversation."""
    turns = _placed(rows)
    _, plans = plan_repairs(turns)
    ids = rows.select("conv_id", _key().alias("key")).distinct()
    out = _repaired_blocks(turns, plans).select("key", "block", F.posexplode("turns").alias("i", "t"))
    # a block holds BLOCK turns and at most three insertions before each and behind the last
    place = F.col("block") * (4 << BLOCK_BITS) + F.col("i")
    return out.join(ids, "key").select("conv_id", place.alias("place"), "t.edit", "t.role", "t.text")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the newline-joined pieces of every key; rows come sorted by key and block."""
    names, key, h = ["key", "repaired_sha256"], None, None
    for batch in batches:
        out = []
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if k != key:
                if h is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(piece.encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=names)
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=names)


def repair_report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. every: all conv_id to report. conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256 of the newline-joined
    `role:text`; conversations without rows have zeros, an empty audit and the empty digest."""
    turns = _placed(rows)
    summary, plans = plan_repairs(turns)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    pieces = _repaired_blocks(turns, plans).filter(F.size("turns") > 0).select("key", "block", F.array_join(lines, "\n").alias("piece"))
    digests = pieces.repartition("key").sortWithinPartitions("key", "block").select("key", "piece").mapInArrow(_digest, "key string, repaired_sha256 string")
    gaps = turns.filter("turn is not null").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    count = lambda these: F.length(F.regexp_replace(F.coalesce("codes", F.lit("")), f"[^{these}]", "")).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = every.select("conv_id", _key().alias("key")).distinct().join(summary, "key", "left").join(gaps, "key", "left").join(digests, "key", "left")
    return out.select(
        "conv_id", zero("gaps"), count("1234").alias("blank"), count("5678").alias("duplicate"), count("SUAX").alias("truncated"), zero("illegal"), zero("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
