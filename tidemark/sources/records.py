"""CSV records of files that many tasks read, with line breaks inside quoted cells.

A file is read as physical lines, in as many ranges as Spark likes.  Whether a line
begins a record depends on the quotes before it, so each range is first run
through a quote automaton from both states it can be entered in.  The outcomes of the
ranges, a few numbers each, are composed in file order; then every range knows
the state it begins in and the number of its first record, and cuts its records.
What lies across ranges is put together by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import freeze

# A record longer than this many bytes is taken for a quote that is never closed.
LONGEST = 1 << 28


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line, given whether one is at its start.

    A cell is quoted if its first character is a quote; two quotes in it are one.
    After a closing quote all up to the next comma belongs to the cell as it is.
    """
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            if line[quote + 1 : quote + 2] == '"':
                at = quote + 2
                continue
            at = quote + 1
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        inside, at = False, comma + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """The batches cut where another range begins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch["file"].dictionary_encode(), batch["start"].to_numpy()
        codes = files.indices.to_numpy()
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(codes)], strict=True):
            yield files.dictionary[int(codes[a])].as_py(), int(starts[a]), batch["value"].slice(a, b - a)


def _quotes(values: pa.Array, breaks: bool) -> list[int]:
    return np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist() if breaks else []


def _blank(values: pa.Array) -> np.ndarray:
    return pc.is_in(values, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)


@dataclass
class _Range:
    """What a range does to the two states it can be entered in, and its first record."""

    state: list[bool] = field(default_factory=lambda: [False, True])
    count: list[int] = field(default_factory=lambda: [0, 0])
    head: list[str] = field(default_factory=list)
    head_open: bool = True

    def read(self, values: pa.Array, breaks: bool) -> None:
        quotes, before = _quotes(values, breaks), np.concatenate([[0], np.cumsum(~_blank(values))])
        for entry in (0, 1):
            state, count, last = self.state[entry], 0, 0
            for at in quotes:
                if not state:
                    count += int(before[at] - before[last]) + 1
                state, last = ends_inside(values[at].as_py(), state), at + 1
            if not state:
                count += int(before[-1] - before[last])
            self.state[entry] = state
            self.count[entry] += count
        for value in values if self.head_open else ():
            line = value.as_py()
            if self.head or line not in ("", "\r"):
                self.head.append(line)
                if not (breaks and ends_inside("\n".join(self.head), False)):
                    self.head_open = False
                    break


def _scan(lines: DataFrame, breaks: bool) -> list[dict]:
    """One row per range: what it does to each state, how many records begin in it, and a file's first record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], _Range] = {}
        for file, start, values in ranges(batches):
            found.setdefault((file, start), _Range(head_open=start == 0)).read(values, breaks)
        rows = [(f, s, *r.state, *r.count, "\n".join(r.head) if s == 0 and not r.head_open else None) for (f, s), r in found.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["file", "start", "from_out", "from_in", "n_out", "n_in", "head"]
    # the driver gets one short row per range, as many as it schedules to read
    return [r.asDict() for r in lines.mapInArrow(run, "file string, start long, from_out boolean, from_in boolean, n_out long, n_in long, head string").collect()]


@dataclass(frozen=True)
class Records:
    """``rows``: ``file, id, record``, numbered from 0 in file order; ``headers``: the first record of every file."""

    rows: DataFrame
    headers: dict[str, str]


def read_records(spark: SparkSession, path: str, breaks: bool = True) -> Records:
    """Records of CSV files without their headers; blank lines are none.  Without ``breaks`` every line is one."""
    lines = _lines(spark, path)
    scanned = sorted(_scan(lines, breaks), key=lambda r: (r["file"], r["start"]))
    inside, first, headers, total, file, state, torn = set(), {}, {}, 0, None, False, False
    for r in scanned:
        if r["file"] != file:
            torn = torn or state  # a file that ends inside quotes
            file, state = r["file"], False
            if r["head"] is None and r["n_out"]:
                raise ValueError(f"The header of {file} is too long")
            if r["head"] is not None:
                headers[file] = r["head"].removeprefix("﻿").removesuffix("\r")
                total -= 1  # the header has the number before the file's first record
        if state:
            inside.add((file, r["start"]))
        first[file, r["start"]] = total
        total += r["n_in"] if state else r["n_out"]
        state = r["from_in"] if state else r["from_out"]
    schema = "file string, start long, id long, piece int, record string"
    rows = lines.mapInArrow(_cutter(breaks, first, inside, False), schema).select("file", "id", "record")
    if inside or torn or state:
        pieces = freeze(lines.mapInArrow(_cutter(breaks, first, inside, True), schema), "record-pieces")
        # only records across ranges are here: at most two pieces for every range
        own = F.expr("last(id, true) over (partition by file order by start, piece rows between unbounded preceding and current row)")
        joined = pieces.withColumn("own", own).groupBy("file", "own").agg(
            F.sum(F.octet_length("record")).alias("bytes"), F.sort_array(F.collect_list(F.struct("start", "piece", "record"))).alias("parts")
        )
        whole = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
        whole = F.when(F.col("bytes") > LONGEST, F.raise_error(F.lit("A quote is never closed"))).otherwise(F.regexp_replace(whole, "\\r\\z", ""))
        rows = rows.unionByName(joined.select("file", F.col("own").alias("id"), whole.alias("record")))
    return Records(rows, headers)


def _cutter(breaks: bool, first: dict, inside: set, across: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts ranges into their whole records, or into the pieces (0: an end, 1: a beginning) of those across ranges."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, state, held, piece = None, 0, False, [], None

        def row(text: str, own: int | None, which: int | None) -> Iterator[pa.RecordBatch]:
            if (which is not None) == across and own not in heads:
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, own, which, text), kinds, strict=True)], names=names)

        def run_of(values: pa.Array) -> Iterator[pa.RecordBatch]:
            """Lines that are records by themselves."""
            nonlocal number
            values = values.filter(pa.array(~_blank(values)))
            ids = number + np.arange(len(values))
            number += len(values)
            if across or not len(values):
                return
            keep = pa.array(~np.isin(ids, list(heads)))
            values, ids = pc.replace_substring_regex(values, r"\r\z", "").filter(keep), pa.array(ids).filter(keep)
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, kinds[0]), pa.array([key[1]] * n, kinds[1]), ids, pa.nulls(n, kinds[3]), values], names=names)

        def close() -> Iterator[pa.RecordBatch]:
            """A record still open where its range ends."""
            if held:
                yield from row("\n".join(held), None if piece == 0 else number, 0 if piece == 0 else 1)

        names, heads = ["file", "start", "id", "piece", "record"], set()
        for file, start, values in ranges(batches):
            if (file, start) != key:
                if key is not None:
                    yield from close()
                key, number, state = (file, start), first[file, start], (file, start) in inside
                held, piece, heads = [], 0 if state else None, {number} if start == 0 else set()
            last = 0
            for at in [*_quotes(values, breaks), len(values)]:
                if state:
                    held += values.slice(last, at - last).to_pylist()
                else:
                    yield from run_of(values.slice(last, at - last))
                if at < len(values):
                    line = values[at].as_py()
                    held.append(line)
                    state = ends_inside(line, state)
                    if not state:
                        if piece == 0:
                            yield from row("\n".join(held), None, 0)
                        else:
                            yield from row("\n".join(held).removesuffix("\r"), number, None)
                            number += 1
                        held, piece = [], None
                last = at + 1
        if key is not None:
            yield from close()

    return run
