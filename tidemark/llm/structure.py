"""Repair the structure of conversations at least cost, by depth-first branch-and-bound."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import freeze

# rows of a conversation that are searched together, and searched parts that are put together
CHUNK = 128
FAN = 16

_SPACES = " \t\n\x0b\f\r"
_INITIALS = ("s", "u", "a")
START, SYSTEM, USER, ASSISTANT, END = range(5)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the turn that may be made up after a state
_OTHER, _BLANK, _CUT = 3, 4, 8  # row codes: the initial's place or 3, and flags


@dataclass(frozen=True)
class Costs:
    """What edits cost; a truncated row that is not deleted adds ``truncated``."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


Edge = tuple[int, int, int, str]  # the layer and state it leads to, its cost, its letters
Ways = list[list[list[Edge]]]  # the edges of each layer and state
Found = tuple[int, str] | None


def suffix_bounds(ways: Ways, goal: tuple[int, int]) -> list[list[float]]:
    """By layer and state, what the rest of the way to the goal costs at least.  Costs alone are looked at, not audits."""
    least = [[math.inf] * 5 for _ in range(goal[0] + 1)]
    least[goal[0]][goal[1]] = 0
    for layer in range(min(goal[0], len(ways) - 1), -1, -1):
        changed = True
        while changed:  # edges may stay in their layer
            changed = False
            for state, edges in enumerate(ways[layer]):
                found = min((more + least[after][to] for after, to, more, _ in edges if after <= goal[0]), default=math.inf)
                if found < least[layer][state]:
                    least[layer][state], changed = found, True
    return least


def search(ways: Ways, bounds: list[list[float]], start: int, goal: tuple[int, int]) -> Found:
    """The least ``(cost, audit)`` of the ways from ``start`` in layer 0 to the goal's layer and state.

    Depth first with an explicit stack, the most promising edge first.  A node is
    a layer and a state; its dominance table holds the best prefix that came by,
    and a prefix that is not better goes no further.  A prefix whose cost and suffix bound
    exceed the cost of the incumbent, the goal's own entry, is cut.  Once the stack
    is empty, the incumbent is proved best.

    Two prefixes of one node and cost never begin one another, as a longer one would
    have paid for another edge; so the better of them is better with every suffix.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    stack = [(0, start, 0, "")]
    while stack:
        layer, state, cost, audit = stack.pop()
        if (layer, state) == goal or best[layer, state] != (cost, audit):
            continue
        limit = best.get(goal, (math.inf,))[0]
        children = []
        for after, to, more, letters in ways[layer][state]:
            total = cost + more
            hope = total + bounds[after][to]
            if hope > limit or hope == math.inf:
                continue
            known = best.get((after, to))
            if known is not None and (known[0] < total or known[0] == total and known[1] <= audit + letters):
                continue
            best[after, to] = (total, audit + letters)
            children.append((hope, letters, after, to, total))
        for _, letters, after, to, total in sorted(children, reverse=True):
            stack.append((after, to, total, audit + letters))
    return best.get(goal)


def row_ways(rows: list[tuple[int, bool, bool]], costs: Costs) -> Ways:
    """The edits of rows given as (place of the initial, must go, is truncated); layers are rows, and the end after the last."""
    ways = []
    for layer, (initial, must, cut) in enumerate(rows):
        more, states = costs.truncated if cut else 0, []
        for state in (START, SYSTEM, USER, ASSISTANT):
            out = [(layer, _NEXT[state], costs.insert, "I"), (layer + 1, state, costs.delete, "D")]
            to = initial + 1
            if not must and initial < _OTHER and (to == _NEXT[state] or to == SYSTEM and state == START):
                out.append((layer + 1, to, costs.keep + more, "K"))
            if not must and to != _NEXT[state]:
                out.append((layer + 1, _NEXT[state], costs.rerole + more, "R"))
            states.append(out)
        ways.append(states)
    n = len(rows)
    done = (n + 1, END, 0, "")
    ways.append([[done], [(n, USER, costs.insert, "I")], [(n, ASSISTANT, costs.insert, "I")], [done]])
    return ways


def repair_rows(rows: list[tuple[int, bool, bool]], costs: Costs) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    ways, goal = row_ways(rows, costs), (len(rows) + 1, END)
    return search(ways, suffix_bounds(ways, goal), START, goal)


Table = dict[tuple[int, int], tuple[int, str]]  # (state before, state after): least cost and audit


def _between(ways: Ways, first: bool) -> Table:
    """The best ways through all layers between any two states; what begins a conversation begins at START."""
    table = {}
    for to in (START, SYSTEM, USER, ASSISTANT):
        goal = (len(ways), to)
        bounds = suffix_bounds(ways, goal)
        for start in (START,) if first else (START, SYSTEM, USER, ASSISTANT):
            found = search(ways, bounds, start, goal)
            if found is not None:
                table[start, to] = found
    return table


def repair_part(rows: list[tuple[int, bool, bool]], costs: Costs, first: bool) -> Table:
    """The table of some rows of a conversation; nothing is inserted after the last of them."""
    return _between(row_ways(rows, costs)[:-1], first)


def join_parts(parts: list[Table], first: bool) -> Table:
    """The table of consecutive parts, searched like rows; layers are parts."""
    return _between([[[(i + 1, to, *found) for (at, to), found in part.items() if at == s] for s in range(4)] for i, part in enumerate(parts)], first)


def closed(table: Table, costs: Costs) -> tuple[int, str]:
    """The best whole conversation of a table, with the turns that its end lacks."""
    lacking = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    return min((cost + costs.insert * lacking[to], audit + "I" * lacking[to]) for (_, to), (cost, audit) in table.items())


def _numbered(turns: DataFrame) -> DataFrame:
    """The rows in order, each with its number ``n`` in its conversation."""
    # rows alike in all of this are interchangeable; the last column lets many of them spread over tasks
    order = ["conv_id", "turn", "role", "hash", "tie"]
    marked = turns.withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, none = pc.fill_null(batch["conv_id"], 0).to_numpy(), pc.is_null(batch["conv_id"]).to_numpy(zero_copy_only=False)
            change = np.ones(len(ids), bool)
            change[1:] = (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
            change[0] = last != (ids[0], none[0])
            at = np.arange(len(ids))
            begin = np.maximum.accumulate(np.where(change, at, -seen))
            k = at - begin
            head = np.zeros(len(ids), bool)
            head[0] = last is None
            seen, last = int(k[-1]) + 1, (ids[-1], none[-1])
            extra = [pa.array(np.full(len(ids), part, np.int32)), pa.array(k.astype(np.int64)), pa.array(head)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "k", "head"])

    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("hash", "tie")
    rows = freeze(ordered.mapInArrow(count, "conv_id long, turn long, role string, text string, part int, k long, head boolean"), "turns", compression="zstd")
    # only the first conversation of a partition can have begun in another: one row per partition at most
    begun = F.broadcast(rows.where("head").select(F.col("conv_id").alias("c")).distinct())
    split = rows.join(begun, F.expr("conv_id <=> c")).groupBy("c", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.expr("sum(rows) over (partition by c order by part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    offsets = freeze(split.select("c", F.col("part").alias("p"), before.alias("before")).where("before > 0"), "turn-offsets")
    placed = rows.join(F.broadcast(offsets), F.expr("conv_id <=> c and part = p"), "left")
    return placed.select("conv_id", "turn", "role", "text", (F.col("k") + F.coalesce("before", F.lit(0))).alias("n"))


def _code(role: Column, text: Column) -> Column:
    bare = F.rtrim(text, F.lit(_SPACES))
    initial = F.left(role, F.lit(1))
    place = F.lit(_OTHER)
    for i, letter in enumerate(_INITIALS):
        place = F.when(initial == letter, i).otherwise(place)
    fault = F.when(bare == "", _BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(_CUT)
    return place + fault


_TABLE = "ways array<struct<before:int,after:int,cost:long,audit:string>>"
_COUNTS = "rows long, blank long, duplicate long, truncated long, illegal long"


def _solved_chunks(rows: DataFrame, costs: Costs) -> DataFrame:
    """One row per chunk of a conversation: its table and counts.  Only codes, numbers and hashes are shuffled."""
    same = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    light = rows.select("conv_id", "n", _code(F.col("role"), F.col("text")).alias("code"), same.alias("same"))
    firsts = light.groupBy("conv_id", "same").agg(F.min("n").alias("n")).select("conv_id", "n", F.expr(f"n div {CHUNK}").alias("chunk"), F.lit(-1).alias("code"))
    # the last row of a chunk is also shown to the next one
    homes = F.when((F.col("n") + 1) % CHUNK == 0, F.array(F.expr(f"n div {CHUNK}"), F.expr(f"n div {CHUNK} + 1"))).otherwise(F.array(F.expr(f"n div {CHUNK}")))
    shown = light.select("conv_id", "n", F.explode(homes).alias("chunk"), "code").unionByName(firsts)
    chunks = shown.groupBy("conv_id", "chunk").agg(
        F.collect_list(F.when(F.col("code") >= 0, F.struct("n", "code"))).alias("rows"), F.collect_list(F.when(F.col("code") < 0, F.col("n"))).alias("firsts")
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, chunk, rows, firsts in zip(*(batch[c].to_pylist() for c in ("conv_id", "chunk", "rows", "firsts")), strict=True):
                ordered, new = sorted((r["n"], r["code"]) for r in rows), set(firsts)
                before = ordered.pop(0)[1] % 4 if ordered[0][0] < chunk * CHUNK else None
                if not ordered:
                    continue  # the conversation ended with the chunk before
                blank = [bool(code & _BLANK) for _, code in ordered]
                again = [n not in new and not b for (n, _), b in zip(ordered, blank, strict=True)]
                cut = [bool(code & _CUT) and not a for (_, code), a in zip(ordered, again, strict=True)]
                initials = [code % 4 for _, code in ordered]
                pairs = list(zip(([] if before is None else [before]) + initials, initials if before is not None else initials[1:], strict=False))
                illegal = sum(p not in ((0, 1), (1, 2), (2, 1)) for p in pairs)
                tasks = [(i, b or a, c) for i, b, a, c in zip(initials, blank, again, cut, strict=True)]
                whole = chunk == 0 and len(tasks) < CHUNK
                table = {(START, END): repair_rows(tasks, costs)} if whole else repair_part(tasks, costs, chunk == 0)
                out.append((conv, chunk, whole, _listed(table), len(tasks), sum(blank), sum(again), sum(cut), illegal))
            yield _batch(out, schema)

    schema = f"conv_id long, chunk long, whole boolean, {_TABLE}, {_COUNTS}"
    return chunks.mapInArrow(solve, schema)


def _listed(table: Table) -> list[dict]:
    return [{"before": a, "after": b, "cost": cost, "audit": audit} for (a, b), (cost, audit) in table.items()]


def _table(ways: list[dict]) -> Table:
    return {(w["before"], w["after"]): (w["cost"], w["audit"]) for w in ways}


_KINDS = {
    "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(),
    _TABLE.split(" ")[1]: pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _best_audits(chunks: DataFrame, costs: Costs) -> DataFrame:
    """``conv_id, cost, audit``; long conversations are put together ``FAN`` parts at a time."""
    parts = chunks.where("not whole").select("conv_id", "chunk", "ways")
    schema = f"conv_id long, chunk long, {_TABLE}"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, chunk, held in zip(*(batch[c].to_pylist() for c in ("conv_id", "chunk", "parts")), strict=True):
                tables = [_table(p["ways"]) for p in sorted(held, key=lambda p: p["chunk"])]
                yield _batch([(conv, chunk, _listed(join_parts(tables, chunk == 0)))], schema)

    while parts.where("chunk > 0").limit(1).count():
        grouped = parts.groupBy("conv_id", F.expr(f"chunk div {FAN}").alias("up")).agg(F.collect_list(F.struct("chunk", "ways")).alias("parts"))
        parts = freeze(grouped.withColumnRenamed("up", "chunk").mapInArrow(join, schema), "conversation-parts")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv, *closed(_table(ways), costs)) for conv, ways in zip(batch["conv_id"].to_pylist(), batch["ways"].to_pylist(), strict=True)]
            yield _batch(rows, "conv_id long, cost long, audit string")

    short = chunks.where("whole").select("conv_id", F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit"))
    return short.unionByName(parts.mapInArrow(close, "conv_id long, cost long, audit string"))


def _spelled(audits: DataFrame) -> DataFrame:
    """One row per edit: ``conv_id, at, edit, n, new_role``; ``n`` is null for inserted turns."""
    schema = "conv_id long, at long, edit string, n long, new_role string"

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, audit in zip(batch["conv_id"].to_pylist(), batch["audit"].to_pylist(), strict=True):
                turn = -((len(audit) - audit.count("D")) % 2)  # an odd number of turns begins with a system turn
                n = 0
                for at, edit in enumerate(audit):
                    role = None if edit in "DK" else "user" if turn % 2 == 0 else "assistant"
                    out.append((conv, at, edit, None if edit == "I" else n, role))
                    turn += edit != "D"
                    n += edit != "I"
                    if len(out) >= 10_000:
                        yield _batch(out, schema)
                        out = []
            yield _batch(out, schema)

    return audits.mapInArrow(spell, schema)


@dataclass(frozen=True)
class Repaired:
    """``conversations``: one row each with its counts, ``cost`` and ``audit``; ``edits``: one row per edit, with texts."""

    conversations: DataFrame
    edits: DataFrame


def repair_structure(
    turns: DataFrame,
    *,
    costs: Costs | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> Repaired:
    """The cheapest edits after which the initials of a conversation's roles read ``(s?(ua)+)?``.

    A row's first fault counts: *blank* (only ASCII white space), *duplicate* (the
    same role and text seen earlier in the conversation), *truncated* (not ended by
    one of ``.!?``).  Rows are kept, given the role user or assistant, or deleted (which blank and
    duplicate rows must be); empty user and assistant turns may be inserted anywhere.  Of
    equally cheap repairs the one whose edits' initials, in order, are least in ASCII is taken.

    ``conversations`` has ``conv_id, rows, gaps, blank, duplicate, truncated,
    illegal, cost, audit``; ``gaps`` are numbers missing between the smallest and largest turn
    number, ``illegal`` neighbours whose initials may not follow each other (an empty role has none that may).  ``edits`` has
    ``conv_id, at, edit, n, turn, role, new_role, text``: what the ``at``-th letter of the audit does to the
    ``n``-th row; kept rows keep their role, inserted ones have no ``n``.

    Rows are sorted by range and numbered across ranges, so a long conversation
    spreads over many tasks.  A conversation of fewer than 128 rows is searched whole;
    longer ones in chunks, each between any two states, whose tables are searched in turn.
    Duplicates are told by numbers that are first of their hash, combined before the
    shuffle.  What one task sees of a conversation is its audit, a letter per row.

    Defined cases: null turns come first; rows of one turn are ordered by role and a
    hash of the text; a null role or text is one space (so the text is blank); rows
    with a null conversation are one conversation; repeated rows are duplicates;
    an empty table gives empty results; other columns are ignored.
    """
    costs = costs or Costs()
    kept = turns.select(
        turns[conv_col].cast("bigint").alias("conv_id"), turns[turn_col].cast("bigint").alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit(" ")).alias("role"), F.coalesce(turns[text_col].cast("string"), F.lit(" ")).alias("text"),
    )
    rows = _numbered(kept)
    chunks = freeze(_solved_chunks(rows, costs), "conversation-chunks")
    audits = freeze(_best_audits(chunks, costs), "audits")
    names = ["rows", "blank", "duplicate", "truncated", "illegal"]
    counts = chunks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in names])
    # turn numbers are made distinct first, so that a conversation's are added up in many tasks
    numbers = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    gaps = numbers.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    found = counts.join(gaps.withColumnRenamed("conv_id", "c"), F.expr("conv_id <=> c"), "left").drop("c")
    found = found.join(audits.withColumnRenamed("conv_id", "c"), F.expr("conv_id <=> c")).drop("c")
    conversations = found.select("conv_id", "rows", F.coalesce("gaps", F.lit(0)).alias("gaps"), *names[1:], "cost", "audit")

    steps = freeze(_spelled(audits), "edits")
    of_rows = steps.where("n is not null").withColumnsRenamed({"conv_id": "c", "n": "m"})
    edited = rows.join(of_rows, F.expr("conv_id <=> c and n = m")).select(
        "conv_id", "at", "edit", "n", "turn", "role", F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("new_role")).alias("new_role"), "text"
    )
    made = steps.where("n is null").select("conv_id", "at", "edit", "n", F.expr("cast(null as bigint) as turn"), F.expr("cast(null as string) as role"), "new_role", F.lit("").alias("text"))
    return Repaired(conversations, edited.unionByName(made))


def repaired_digests(edits: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the repaired turns ``role:text``, joined by line breaks, where any are left.

    A digest is made in order by its nature, so a conversation's lines go through one
    task; they are sorted by Spark and fed to the digest one by one, never held.
    """
    lines = edits.where("edit <> 'D'").select("conv_id", "at", F.encode(F.concat("new_role", F.lit(":"), "text"), "utf-8").alias("line"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, ready = None, None, []
        for batch in batches:
            for own, line in zip(batch["conv_id"].to_pylist(), batch["line"], strict=True):
                if state is None or own != conv:
                    if state is not None:
                        ready.append((conv, state.hexdigest()))
                    conv, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_buffer())
            yield _batch(ready, "conv_id long, sha256 string")
            ready = []
        if state is not None:
            yield _batch([(conv, state.hexdigest())], "conv_id long, sha256 string")

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(digest, "conv_id long, sha256 string")
