"""Repair the roles of conversations at least cost, and render them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import small_enough
from tidemark.sources.scratch import freeze

CHUNK = 512


@dataclass(frozen=True)
class Format:
    """Which role may follow which, what repairs cost, and how turns are written.

    ``legal`` is an automaton whose states are the role of the last turn, or
    ``start``.  A conversation must end in one of ``final``.
    """

    legal: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("start", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)),
    )
    final: tuple[str, ...] = ("assistant",)
    merge: int = 1
    relabel: int = 2
    name: int = 1  # for a turn whose role is missing or unknown
    insert: int = 3
    before: str = "<|{role}|>\n"
    after: str = "\n<|end|>\n"
    between: str = "\n"

    @cached_property
    def states(self) -> list[str]:
        return [s for s, _ in self.legal]

    @cached_property
    def follow(self) -> list[list[int]]:
        return [[self.states.index(r) for r in after] for _, after in self.legal]

    @cached_property
    def paths(self) -> dict[tuple[int, int], list[int]]:
        """The shortest list of turns to insert between two states so that the second may follow."""
        found = {}
        for state in range(len(self.states)):
            level = [(nxt, []) for nxt in self.follow[state]]
            while level:
                later = []
                for nxt, between in level:
                    if (state, nxt) not in found:
                        found[state, nxt] = between
                        later += [(far, [*between, nxt]) for far in self.follow[nxt]]
                level = later
        return found

    @cached_property
    def steps(self) -> np.ndarray:
        """Cost of reading a role in a state and ending in another: ``[role, from, to]``; the last role is an unknown one."""
        n = len(self.states)
        cost = np.full((n + 1, n, n), np.inf)
        for role in range(n + 1):
            for (state, to), between in self.paths.items():
                change = self.name if role in (0, n) else 0 if role == to else self.relabel
                way = self.insert * len(between)
                cost[role, state, to] = change + (min(way, self.merge) if state == to else way)
            for to in range(1, n):
                change = self.name if role in (0, n) else 0 if role == to else self.relabel
                cost[role, to, to] = min(cost[role, to, to], change + self.merge)
        return cost

    def merges(self, state: int, to: int) -> bool:
        return state == to and self.merge <= self.insert * len(self.paths.get((state, to), [0] * 99))

    @cached_property
    def closing(self) -> list[list[int]]:
        """The turns to insert at the end, by state."""
        out = []
        for state in range(len(self.states)):
            ways = [[*between, to] for (s, to), between in self.paths.items() if s == state and self.states[to] in self.final]
            out.append([] if self.states[state] in self.final else min(ways, key=lambda w: (len(w), w)))
        return out

    def code(self, role: str | None) -> int:
        role = (role or "").strip().lower()
        return self.states.index(role) if role in self.states[1:] else len(self.states)


def _product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None]).min(axis=1)
    return out


def _cheapest(matrices: list[np.ndarray], entry: int, exit_costs: np.ndarray) -> list[int]:
    """The states after each step on a cheapest way; ties go to the first state."""
    value, back = np.full(len(exit_costs), np.inf), []
    value[entry] = 0
    for m in matrices:
        total = value[:, None] + m
        back.append(total.argmin(axis=0))
        value = total.min(axis=0)
    state = int((value + exit_costs).argmin())
    way = []
    for choice in reversed(back):
        way.append(state)
        state = int(choice[state])
    return way[::-1]


_ROWS = "conv_id long, turn long, role string, text string, part int, chunk long, pos int, was int, now int, ends boolean, roles binary"
_SPAN = "conv_id long, part int, chunk long, entry int, exit int, first boolean, last boolean, before long"


def repair_roles(
    turns: DataFrame,
    *,
    rules: Format | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn: ``conv_id, position, turn, role, new_role, action, inserted, cost, rendered``.

    Each conversation becomes legal at least cost by merging a turn into the one
    before it, giving it another role, or inserting empty turns.  ``inserted``
    counts the empty turns put before this one (and, at the last turn, after it).
    The ``rendered`` parts of a conversation, joined in order of ``position``
    (see ``render``), are its repaired text.

    The dynamic program is a product of small (min, +) matrices, which is
    associative.  Turns are sorted by range, so a long conversation spreads over
    many tasks.  A conversation inside one range and one chunk of 512 turns is
    solved where it lies.  Of the others (the first and last of each range, and long ones) each
    chunk yields one matrix; products per range, then per conversation, choose the
    states at the borders, and each chunk is solved by itself.  No long
    conversation is ever in one task, and texts are shuffled once.

    Defined cases: turns with equal numbers are ordered by a hash of role and text;
    null turns come first; rows with a null conversation are one conversation; a
    null or unknown role is named at its own cost; a null text is empty; repeated
    rows are turns of their own; an empty table gives an empty result; other
    columns are ignored.
    """
    rules = rules or Format()
    kept = turns.select(
        turns[conv_col].cast("bigint").alias("conv_id"), turns[turn_col].cast("bigint").alias("turn"),
        turns[role_col].cast("string").alias("role"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", F.xxhash64("role", "text")]
    ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the chunks and solves conversations that lie inside this range and fit one chunk.

        Of all others, a chunk's first row carries the roles of all its rows.
        """
        part, chunk, held, conv = TaskContext.get().partitionId(), -1, [], None
        first = begins = True  # the range's first conversation may have begun in another

        names = ["conv_id", "turn", "role", "text", "part", "chunk", "pos", "was", "now", "ends", "roles"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        ready: list[tuple] = []

        def close(alone: bool) -> None:
            roles = [rules.code(h["role"]) for h in held]
            way = _cheapest([rules.steps[r] for r in roles], 0, exits) if alone else []
            for pos, h in enumerate(held):
                solved = (way[pos - 1] if pos else 0, way[pos], pos == len(held) - 1) if alone else (None, None, None)
                ready.append((h["conv_id"], h["turn"], h["role"], h["text"], part, chunk, pos, *solved, None if alone or pos else bytes(roles)))

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                changes = row["conv_id"] != conv
                if held and (changes or len(held) == CHUNK):
                    close(changes and begins and not first)
                    held, begins = [], changes
                    first = first and not changes
                if not held:
                    conv, chunk = row["conv_id"], chunk + 1
                held.append(row)
                if len(ready) >= 2048:
                    yield flush()
                    ready.clear()
        if held:
            close(False)
        if ready:
            yield flush()

    n = len(rules.states)
    exits = np.array([float(rules.insert * len(c)) for c in rules.closing])
    rows = freeze(ordered.mapInArrow(chunked, _ROWS), "turns", compression="zstd")
    chunks = rows.where("roles is not null").select("conv_id", "part", "chunk", "roles")
    one_exit = lambda state: np.where(np.arange(n) == state, 0.0, np.inf)
    matrix = lambda roles: _product([rules.steps[r] for r in roles])

    def by_part(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        product = _product([matrix(r) for r in frame["roles"]])
        size = int(frame["roles"].str.len().sum())
        return pd.DataFrame({"conv_id": frame["conv_id"].iloc[:1], "part": frame["part"].iloc[:1], "n": size, "m": [product.tobytes()]})

    def borders(frame: pd.DataFrame) -> pd.DataFrame:
        """Entry and exit state of each part of one conversation."""
        frame = frame.sort_values("part").reset_index(drop=True)
        steps = [np.frombuffer(m).reshape(n, n) for m in frame["m"]]
        way = _cheapest(steps, 0, exits)
        return pd.DataFrame({
            "conv_id": frame["conv_id"], "part": frame["part"], "entry": [0, *way[:-1]], "exit": way,
            "first": [True] + [False] * (len(way) - 1), "last": [False] * (len(way) - 1) + [True],
            "before": np.concatenate([[0], np.cumsum(frame["n"])[:-1]]),
        })

    def within(key, frame: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        """Entry and exit state of each chunk of one part of a conversation."""
        frame, end = frame.sort_values("chunk").reset_index(drop=True), ends.iloc[0]
        way = _cheapest([matrix(r) for r in frame["roles"]], int(end["entry"]), one_exit(int(end["exit"])))
        k = len(way)
        return pd.DataFrame({
            "conv_id": frame["conv_id"], "part": frame["part"], "chunk": frame["chunk"], "entry": [int(end["entry"]), *way[:-1]], "exit": way,
            "first": [bool(end["first"])] + [False] * (k - 1), "last": [False] * (k - 1) + [bool(end["last"])],
            "before": int(end["before"]) + np.concatenate([[0], np.cumsum(frame["roles"].str.len())[:-1]]),
        })

    parts = chunks.groupBy("conv_id", "part").applyInPandas(by_part, "conv_id long, part int, n long, m binary")
    ends = parts.groupBy("conv_id").applyInPandas(borders, "conv_id long, part int, entry int, exit int, first boolean, last boolean, before long")
    # a null conversation must meet itself, so it is keyed by a flag and a number
    key = [F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("number"), "part"]
    spans = chunks.groupBy(*key).cogroup(ends.groupBy(*key)).applyInPandas(within, _SPAN)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state after each turn of a chunk."""
        for batch in batches:
            ways = []
            for roles, entry, leave in zip(batch["roles"].to_pylist(), batch["entry"].to_pylist(), batch["exit"].to_pylist(), strict=True):
                ways.append(_cheapest([rules.steps[r] for r in roles], entry, one_exit(leave)))
            names = ["part", "chunk", "entry", "last", "before", "way"]
            columns = [batch[c] for c in names[:-1]] + [pa.array(ways, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    solved = chunks.drop("conv_id").join(spans.drop("conv_id"), ["part", "chunk"])
    solved = freeze(solved.mapInArrow(solve, "part int, chunk long, entry int, last boolean, before long, way array<int>"), "chat-ways")
    if small_enough(solved, 50_000):
        solved = F.broadcast(solved)
    state = F.get("way", F.col("pos"))
    from_state = F.when(F.col("pos") == 0, F.col("entry")).otherwise(F.get("way", F.col("pos") - 1))
    parted = rows.where("now is null").drop("was", "now", "ends").join(solved, ["part", "chunk"]).select(
        "conv_id", (F.col("before") + F.col("pos")).alias("position"), "turn", "role", "text", from_state.alias("was"), state.alias("now"),
        (F.col("last") & (F.col("pos") == F.size("way") - 1)).alias("ends"),
    )
    inside = rows.where("now is not null").select("conv_id", F.col("pos").cast("bigint").alias("position"), "turn", "role", "text", "was", "now", "ends")
    placed = inside.unionByName(parted)
    return _written(placed, rules)


def _written(placed: DataFrame, rules: Format) -> DataFrame:
    """What happens to a turn, from the states before and after it, with built-in functions."""
    states, n = rules.states, len(rules.states)
    empty = lambda turns: "".join(rules.before.format(role=states[t]) + rules.after for t in turns)
    moves = []
    for was in range(n):
        for now in range(1, n):
            merged = rules.merges(was, now)
            between = [] if merged else rules.paths.get((was, now))
            if between is None:
                continue
            close = rules.after if was else ""
            head = rules.between if merged else close + empty(between) + rules.before.format(role=states[now])
            moves.append((was, now, merged, len(between), head))
    table = F.map_from_arrays(
        F.array(*[F.lit(m[0] * n + m[1]) for m in moves]),
        F.array(*[F.struct(F.lit(m[2]).alias("merged"), F.lit(m[3]).alias("between"), F.lit(m[4]).alias("head")) for m in moves]),
    )
    tails = F.array(*[F.struct(F.lit(len(c)).alias("more"), F.lit(rules.after + empty(c)).alias("tail")) for c in rules.closing])
    move = F.element_at(table, F.col("was") * n + F.col("now"))
    tail = F.get(tails, F.col("now"))
    given = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    new_role = F.get(F.array(*map(F.lit, states)), F.col("now"))
    known = given.isin(*states[1:])
    more = F.when(F.col("ends"), F.col("t.more")).otherwise(0)
    out = placed.withColumns({"m": move, "t": tail, "new_role": new_role})
    relabelled = ~known | (given != F.col("new_role"))
    action = F.when(F.col("m.merged") & relabelled, "relabel+merge").when(F.col("m.merged"), "merge").when(relabelled, "relabel").otherwise("keep")
    cost = (
        F.when(~known, rules.name).when(relabelled, rules.relabel).otherwise(0)
        + F.when(F.col("m.merged"), rules.merge).otherwise(0) + (F.col("m.between") + more) * rules.insert
    )
    return out.select(
        "conv_id", "position", "turn", "role", "new_role", action.alias("action"), (F.col("m.between") + more).alias("inserted"), cost.alias("cost"),
        F.concat("m.head", "text", F.when(F.col("ends"), F.col("t.tail")).otherwise("")).alias("rendered"),
    )


def render(repaired: DataFrame) -> DataFrame:
    """``conv_id, cost, text``: whole conversations, for tables whose conversations fit a cell.

    ``repair_roles`` itself gives the parts, which has no such bound.
    """
    parts = F.transform(F.sort_array(F.collect_list(F.struct("position", "rendered"))), lambda p: p["rendered"])
    return repaired.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(parts, "").alias("text"))
