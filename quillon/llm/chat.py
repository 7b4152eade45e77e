"""Chat formatting with minimum-cost role repair.

The legal turns are: system at the start only, then user and assistant by turns, beginning with user, ending with
assistant. Dynamic programming over that automaton chooses for each turn a role to keep or change, to merge with the turn
before, and empty turns to insert, at the least total cost; the choices of equal cost are taken in a fixed order.

A conversation is cut into segments of SEGMENT turn numbers. A segment is a matrix of least costs from each entry state to
each exit state; these combine by (min, +) products, so a conversation of any length, up to a third of all turns, is
spread over tasks: costs of segments first, then the states between segments, then each segment alone with its entry and
exit states known. Conversations of one segment need no states. Those of more are dealt by range, so that a long one spreads
over several parts, and their states come from a tree of two levels: products of parts; least costs before each part;
back through each part, from every exit to its entry; back through the parts; then each part with its exit known. A level
above holds a row for each part, a conversation has at most as many as there are partitions, and the states are those of
one pass over all segments, wherever parts are cut. Nothing gathers a conversation's text: the result has a row for each turn.

Defined results: turns are in the order of turn (nulls last); those of one number in the order of a hash of role and text;
rows that are equal in all of these are turns of their own; a role that is none of the three counts as unknown and costs as much as any other change to relabel; null
text is empty; a null conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import stage

ROLES = ("system", "user", "assistant")
#: states: nothing yet, or the role of the last turn
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, INSERT, SEGMENT = 1, 2, 3, 256
FAR = 1 << 40
UNKNOWN = 3
_NEXT = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _steps() -> np.ndarray:
    """Cost (original role, state before, state after) of one turn: change of role, and merge or inserted empty turn."""
    out = np.full((4, 4, 4), FAR, np.int64)
    for old in range(4):
        for before in range(4):
            for after in (SYSTEM, USER, ASSISTANT):
                change = 0 if old == after - 1 else RELABEL
                if (before, after) in _NEXT:
                    out[old, before, after] = change
                elif before == after:
                    out[old, before, after] = change + MERGE
                elif after == ASSISTANT:  # START or SYSTEM before: an empty user turn between
                    out[old, before, after] = change + INSERT
    return out


STEPS = _steps()
#: what the end costs: an empty assistant turn after user; user and assistant after system
ENDS = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def costs(roles: np.ndarray) -> np.ndarray:
    """Least cost from each entry state to each exit state of a run of turns."""
    total = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(total, 0)
    for r in roles.tolist():
        total = np.minimum((total[:, :, None] + STEPS[r][None]).min(1), FAR)
    return total


def forward(steps: list[np.ndarray], total: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least costs after all steps, and for each step the state before that leads to each state (ties: the lower number)."""
    ways = []
    for m in steps:
        both = total[:, None] + m
        ways.append(both.argmin(0))
        total = np.minimum(both.min(0), FAR)
    return total, ways


def back(ways: list[np.ndarray], state: int) -> list[int]:
    """States after each step of the way that ends in `state`."""
    out = []
    for way in reversed(ways):
        out.append(state)
        state = int(way[state])
    return out[::-1]


def entry_costs(entry: int) -> np.ndarray:
    total = np.full(4, FAR, np.int64)
    total[entry] = 0
    return total


def best_path(steps: list[np.ndarray], entry: int, ends: np.ndarray) -> list[int]:
    """States after each step of the cheapest way; ties go to the state of the lower number, from the end backwards."""
    total, ways = forward(steps, entry_costs(entry))
    return back(ways, int((total + ends).argmin()))


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def _keyed(rows: DataFrame) -> DataFrame:
    role = F.lower(F.trim(F.coalesce(F.col("role").cast("string"), F.lit(""))))
    number = F.coalesce(*(F.when(role == name, F.lit(k)) for k, name in enumerate(ROLES)), F.lit(UNKNOWN))
    turn = F.col("turn").cast("long")
    keyed = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), number.alias("old"),
    )
    # equal turn numbers in bulk would make one segment: beyond the number, a hash of the turn splits it in order
    spread = F.pmod(F.xxhash64("role", "text"), F.lit(1 << 30))
    return keyed.withColumn("late", F.col("turn").isNull()).withColumn("spread", spread)


def _segments(rows: DataFrame) -> DataFrame:
    """The segment of each row: `seg` orders the segments of a conversation, `spread` splits crowded turn numbers."""
    coarse = F.floor(F.coalesce(F.col("turn"), F.lit(0)) / SEGMENT).cast("long")
    rows = rows.withColumn("coarse", coarse)
    crowd = rows.groupBy("conv_id", "late", "coarse").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * SEGMENT)
    crowd = crowd.withColumnsRenamed({"conv_id": "c", "late": "l", "coarse": "k"})
    rows = rows.join(crowd, rows["conv_id"].eqNullSafe(crowd["c"]) & (rows["late"] == crowd["l"]) & (rows["coarse"] == crowd["k"]), "left")
    # rows equal in number, role and text may stand in any order among themselves, so that chance can split them
    same = rows.groupBy("conv_id", "late", "turn", "spread").agg(F.count("*").alias("m")).filter(F.col("m") > 4 * SEGMENT)
    same = same.withColumnsRenamed({"conv_id": "sc", "late": "sl", "turn": "st", "spread": "ss"})
    rows = rows.join(same, rows["conv_id"].eqNullSafe(same["sc"]) & (rows["late"] == same["sl"]) & rows["turn"].eqNullSafe(same["st"]) & (rows["spread"] == same["ss"]), "left")
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("m") / SEGMENT))
    sub = F.when(F.col("m").isNull(), F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("no"))).otherwise(F.struct((F.col("spread") + 1).alias("at"), chance.alias("no")))
    parts = F.ceil(F.col("n") / SEGMENT)
    crowded = F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), F.floor(F.col("spread") * parts / (1 << 30)).cast("long").alias("part"), sub.alias("sub"))
    plain = F.struct((F.col("coarse") * SEGMENT).alias("turn"), F.lit(0).cast("long").alias("part"), sub.alias("sub"))
    return rows.withColumn("seg", F.struct("late", F.when(F.col("n").isNull(), plain).otherwise(crowded).alias("place"))).drop("c", "l", "k", "n", "coarse", "sc", "sl", "st", "ss", "m")


_ORDER = ["late", "turn", "spread", "role", "text"]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Parts of the sorted batches with equal first `keys` columns."""
    held: list[pa.RecordBatch] = []
    name = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_pylist() for k in range(keys)]
        lo = 0
        for k in range(b.num_rows):
            now = tuple(str(c[k]) for c in columns)
            if now != name:
                if k > lo:
                    held.append(b.slice(lo, k - lo))
                if held:
                    yield name, held
                held, name, lo = [], now, k
        held.append(b.slice(lo))
    if held:
        yield name, held


_PLACE = "late boolean, place struct<turn: long, part: long, sub: struct<at: long, no: long>>"
_KNOWN = "c long, k string, entry int, exit int, closes boolean"


def _by_part(rows: DataFrame, keys: int, make, schema: str) -> DataFrame:
    """make(batches of one group, columns as lists) over rows that are equal in the first `keys` columns, in the order given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _runs(batches, keys):
            columns = {n: [x for p in parts for x in p.column(k).to_pylist()] for k, n in enumerate(parts[0].schema.names)}
            made = make(columns)
            kinds = [pa.from_numpy_dtype(np.int64) if t == "long" else {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}[t] for t in (x.split()[1] for x in schema.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def _matrices(lists: list) -> list[np.ndarray]:
    return [np.array(m, np.int64).reshape(4, 4) for m in lists]


def _states(segments: DataFrame) -> DataFrame:
    """(c, k, entry, exit, closes) of the segments (conv_id, key, matrix) of conversations that have more than one."""
    many = segments.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"))
    some = segments.join(many, segments["conv_id"].eqNullSafe(many["c"])).drop("c").withColumn("seg", F.from_json("key", _PLACE))
    parts = stage(some.repartitionByRange("conv_id", "seg").withColumn("part", F.spark_partition_id()), "parts")
    inside = lambda rows: rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seg")
    along = lambda rows, order: rows.repartition("conv_id").sortWithinPartitions("conv_id", order)

    def product(t):
        total = _matrices(t["matrix"][:1])[0]
        for m in _matrices(t["matrix"][1:]):
            total = np.minimum((total[:, :, None] + m[None]).min(1), FAR)
        return [t["conv_id"][:1], t["part"][:1], [total.ravel().tolist()]]

    def before(t):
        total, out = entry_costs(START), []
        for m in _matrices(t["matrix"]):
            out.append(total.tolist())
            total = forward([m], total)[0]
        last = int((total + ENDS).argmin())
        return [t["conv_id"], t["part"], out, [last] * len(out), [k == len(out) - 1 for k in range(len(out))]]

    def through(t):
        _, ways = forward(_matrices(t["matrix"]), np.array(t["before"][0], np.int64))
        state = np.arange(4)
        for way in reversed(ways):
            state = way[state]
        return [t["conv_id"][:1], t["part"][:1], [state.tolist()], t["final"][:1]]

    def exits(t):
        state, out = t["final"][0], []
        for way in t["way"]:  # from the last part to the first
            out.append(state)
            state = way[state]
        return [t["conv_id"], t["part"], out]

    def inner(t):
        _, ways = forward(_matrices(t["matrix"]), np.array(t["before"][0], np.int64))
        after = back(ways, t["leave"][0])
        first = int(ways[0][after[0]])
        n = len(after)
        return [t["conv_id"], t["key"], [first, *after[:-1]], after, [t["closes"][0] and k == n - 1 for k in range(n)]]

    tops = _by_part(inside(parts.select("conv_id", "part", "seg", "matrix")).drop("seg"), 2, product, "conv_id long, part int, matrix array<long>")
    entries = stage(_by_part(along(tops, "part").select("conv_id", "part", "matrix"), 1, before, "conv_id long, part int, before array<long>, final int, closes boolean"), "entries")
    name = lambda rows: rows.withColumnsRenamed({"conv_id": "ec", "part": "ep"})
    same = lambda rows, found: rows.join(name(found), rows["conv_id"].eqNullSafe(F.col("ec")) & (rows["part"] == F.col("ep"))).drop("ec", "ep")
    ways = _by_part(inside(same(parts, entries)).select("conv_id", "part", "matrix", "before", "final"), 2, through, "conv_id long, part int, way array<int>, final int")
    leaves = _by_part(along(ways, F.desc("part")).select("conv_id", "part", "way", "final"), 1, exits, "conv_id long, part int, leave int")
    both = same(same(parts, entries), leaves)
    return _by_part(inside(both).select("conv_id", "part", "key", "matrix", "before", "closes", "leave"), 2, inner, _KNOWN)


def repair(turns: DataFrame) -> DataFrame:
    """One row for each turn of (conv_id, turn, role, text), with what became of it.

    new_role; action (keep, relabel); merged: joins the turn before; inserted: roles of empty turns before it; appended:
    those after it, at the end of the conversation; rendered: the turn's piece of the formatted conversation, empty turns
    included, so that pieces in order are the whole; cost; seq: place among the rows of its segment, seg: that segment.
    """
    rows = stage(_segments(_keyed(turns)), "turns")
    # 1: the matrix of every segment
    ordered = rows.select("conv_id", F.to_json("seg").alias("key"), "seg", "old", *_ORDER)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _runs(batches, 2):
            old = np.concatenate([p.column(2).to_numpy() for p in parts])
            yield pa.RecordBatch.from_arrays([parts[0].column(0)[:1], parts[0].column(1)[:1], pa.array([costs(old).ravel().tolist()])], ["conv_id", "key", "matrix"])

    sorted_ = ordered.repartition("conv_id", "key").sortWithinPartitions("conv_id", "key", *_ORDER)
    got = stage(sorted_.select("conv_id", "key", "old").mapInArrow(matrices, "conv_id long, key string, matrix array<long>"), "segments")
    # 2: entry and exit states of the segments of conversations that have several
    known = _states(got)
    # 3: each segment alone
    keyed = rows.withColumn("key", F.to_json("seg"))
    # matrices compress well, so files say little of their size: never broadcast what is made of them
    keyed = keyed.join(known.hint("merge"), keyed["conv_id"].eqNullSafe(known["c"]) & (keyed["key"] == known["k"]), "left")
    # a segment without states is its conversation's only one
    keyed = keyed.withColumns({"entry": F.coalesce("entry", F.lit(START)), "exit": F.coalesce("exit", F.lit(-1)), "closes": F.coalesce("closes", F.lit(True))})
    keyed = keyed.repartition("conv_id", "key").sortWithinPartitions("conv_id", "key", *_ORDER)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _runs(batches, 2):
            t = pa.Table.from_batches(parts).to_pydict()
            entry, leave = t["entry"][0], t["exit"][0]
            ends = ENDS if leave < 0 else entry_costs(leave)
            path = best_path([STEPS[r] for r in t["old"]], entry, ends)
            out: dict[str, list] = {n: [] for n in ("new_role", "action", "merged", "inserted", "appended", "rendered", "cost")}
            state = entry
            for k, after in enumerate(path):
                role = ROLES[after - 1]
                merged = state == after
                empty = ["user"] if (state, after) not in _NEXT and not merged else []
                closing = {SYSTEM: ["user", "assistant"], USER: ["assistant"]}.get(after, []) if t["closes"][0] and k == len(path) - 1 else []
                # a turn's closing mark stands before what follows it, so that a merged turn continues the open one
                open_ = "" if state == START else "" if merged else "\n<|end|>\n"
                piece = open_ + "".join(render(e, "") for e in empty) + ("\n" if merged else f"<|{role}|>\n") + t["text"][k]
                if t["closes"][0] and k == len(path) - 1:
                    piece += "\n<|end|>\n" + "".join(render(e, "") for e in closing)
                out["new_role"].append(role)
                out["action"].append("keep" if t["old"][k] == after - 1 else "relabel")
                out["merged"].append(merged)
                out["inserted"].append(empty)
                out["appended"].append(closing)
                out["rendered"].append(piece)
                out["cost"].append(int(STEPS[t["old"][k], state, after]) + INSERT * len(closing))
                state = after
            kinds = {"new_role": pa.string(), "action": pa.string(), "merged": pa.bool_(), "inserted": pa.list_(pa.string()), "appended": pa.list_(pa.string()), "rendered": pa.string(), "cost": pa.int64()}
            n = len(path)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t["conv_id"], pa.int64()), pa.array(t["key"], pa.string()), pa.array(range(n), pa.int64()), pa.array(t["turn"], pa.int64()), pa.array(t["role"], pa.string()), *(pa.array(out[c], kinds[c]) for c in kinds)],
                ["conv_id", "key", "seq", "turn", "role", *kinds],
            )

    names = ["conv_id", "key", "turn", "role", "text", "old", "entry", "exit", "closes"]
    done = keyed.select(*names).mapInArrow(final, "conv_id long, key string, seq long, turn long, role string, new_role string, action string, merged boolean, inserted array<string>, appended array<string>, rendered string, cost long")
    return done.withColumn("seg", F.from_json("key", _PLACE)).drop("key")


def conversations(pieces: DataFrame) -> DataFrame:
    """conv_id and the whole formatted text, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("seg", "seq", "rendered")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("formatted"), F.sum("cost").alias("cost"))


def query(turns: DataFrame) -> DataFrame:
    got = repair(turns)
    return got.select("conv_id", "turn", "role", "new_role", "action", "merged", F.array_join("inserted", ",").alias("inserted"), F.array_join("appended", ",").alias("appended"), "rendered", "cost")
