"""Records of JSON arrays that many tasks read, however their lines are broken.

A file is read in pieces that end with a closing brace, so that Spark splits it
like lines.  Where a piece stands depends on what is before it: whether a string is
open, and how many brackets are.  Each range of pieces is first run from both states
of strings, and adds up brackets from zero; the outcomes of the ranges, a short row
each, are composed in file order.  Then every range knows where it begins and the
number of its first record, and cuts its records.  A record across ranges is put together by itself.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import LONGEST, ranges
from .scratch import freeze, scratch_path

_ESCAPE = re.compile(r"\\.", re.DOTALL)
# What may stand before a record, the first of its file or a later one, and behind the last one.
_OPENING = re.compile(r"﻿?[ \t\r\n]*\[[ \t\r\n]*(?=\{)")
_BETWEEN = re.compile(r"[ \t\r\n]*,[ \t\r\n]*(?=\{)")
_CLOSING = re.compile(r"[ \t\r\n]*\][ \t\r\n]*")
_NOTHING = re.compile(r"﻿?[ \t\r\n]*(\[[ \t\r\n]*\])?[ \t\r\n]*")


def _opened(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("]")


def moves(piece: str) -> tuple[bool, int, int]:
    """What a piece does: whether it changes between inside and outside of strings, and how
    many brackets it opens if it is entered outside, and inside.  Its closing brace is not in it."""
    if '"' not in piece:
        return False, _opened(piece), 0
    parts = _ESCAPE.sub("", piece).split('"') if "\\" in piece else piece.split('"')
    return len(parts) % 2 == 0, _opened("".join(parts[::2])), _opened("".join(parts[1::2]))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    pieces = spark.read.option("lineSep", "}").text(path)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


class _Range:
    """The outcome of a range for both states: the state behind it, its brackets, and at which depths its braces close."""

    def __init__(self) -> None:
        self.inside, self.depth, self.closed = [False, True], [0, 0], [Counter(), Counter()]

    def read(self, values: pa.Array) -> None:
        for piece in values.to_pylist():
            change, outside, within = moves(piece)
            for entry in (0, 1):
                self.depth[entry] += within if self.inside[entry] else outside
                self.inside[entry] ^= change
                if not self.inside[entry]:
                    self.depth[entry] -= 1
                    self.closed[entry][self.depth[entry]] += 1


_OUTCOME = "file string, start long, inside array<boolean>, depth array<long>, closed array<string>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], _Range] = {}
    for file, start, values in ranges(batches):
        found.setdefault((file, start), _Range()).read(values)
    rows = [(f, s, r.inside, r.depth, [json.dumps(c) for c in r.closed]) for (f, s), r in found.items()]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.string())]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "inside", "depth", "closed"])


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``id, record``: the objects of arrays, numbered from 0 in file order; anything else is an error."""
    pieces = _pieces(spark, path)
    # the driver gets one short row per range, as many as it schedules to read
    outcomes = sorted(pieces.mapInArrow(_scan, _OUTCOME).collect(), key=lambda r: (r["file"], r["start"]))
    entered, file, inside, depth, total = {}, None, False, 0, 0
    for i, r in enumerate(outcomes):
        if r["file"] != file:
            file, inside, depth = r["file"], False, 0
        entered[file, r["start"]] = (inside, depth, total)
        # a brace that leaves one bracket open, the array's, ends a record
        total += json.loads(r["closed"][inside]).get(str(1 - depth), 0)
        depth, inside = depth + r["depth"][inside], r["inside"][inside]
        last = i + 1 == len(outcomes) or outcomes[i + 1]["file"] != file
        # nothing closes the last piece, for which a brace was reckoned
        if last and (inside or depth != -1):
            raise ValueError(f"{file} does not end with its array")
    rows = pieces.mapInArrow(_cutter(entered, False), _PIECE).select("id", "record")
    if any(inside or depth > 1 for inside, depth, _ in entered.values()):
        # only records across ranges are here: at most two pieces for every range
        torn = freeze(pieces.mapInArrow(_cutter(entered, True), _PIECE), "record-pieces")
        joined = torn.groupBy("id").agg(
            F.sum(F.octet_length("record")).alias("bytes"), F.sort_array(F.collect_list(F.struct("file", "start", "record"))).alias("parts")
        )
        whole = F.array_join(F.transform("parts", lambda p: p["record"]), "")
        too_long = F.raise_error(F.lit("A record is longer than 256 MB"))
        rows = rows.unionByName(joined.select("id", F.when(F.col("bytes") > LONGEST, too_long).otherwise(whole).alias("record")))
    return rows


_PIECE = "file string, start long, id long, record string"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string()]


def _cutter(entered: dict, across: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts ranges into their whole records, or into the pieces of those across ranges."""

    def start_of(piece: str, first: bool, file: str) -> str:
        """A piece between records without what is before the next one; empty if none follows."""
        begins = (_OPENING if first else _BETWEEN).match(piece)
        if begins:
            return piece[begins.end() :]
        if (_NOTHING if first else _CLOSING).fullmatch(piece):
            return ""
        raise ValueError(f"{file} holds something other than records at {piece[:40]!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, number, held, torn, fresh = None, False, 0, 0, [], False, False

        def rows(found: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
            if found:
                columns = [[key[0]] * len(found), [key[1]] * len(found), *zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=["file", "start", "id", "record"])

        for file, start, values in ranges(batches):
            if (file, start) != key:
                yield from rows([(number, "".join(held))] if across and held else [])
                key = (file, start)
                inside, depth, number = entered[key]
                held, torn, fresh = [], inside or depth > 1, start == 0
            found = []
            for piece in values.to_pylist():
                if not held and not torn and not inside and depth <= 1:
                    begun = start_of(piece, fresh and depth == 0, file)
                    change, outside, within = moves(piece)
                    if not begun:  # the end of the array
                        depth += outside
                        continue
                    held.append(begun + "}")
                else:
                    change, outside, within = moves(piece)
                    held.append(piece + "}")
                depth += within if inside else outside
                inside ^= change
                if not inside:
                    depth -= 1
                    if depth == 1:
                        if torn == across:
                            found.append((number, "".join(held)))
                        number += 1
                        held, torn = [], False
            yield from rows(found)
        yield from rows([(number, "".join(held))] if across and held else [])

    return run


def array_lines(spark: SparkSession, path: str) -> str:
    """A folder of JSON lines ``{"id": ..., "row": ...}`` made of the arrays, which Spark's reader splits and infers types from."""
    # line breaks are white space: strings cannot hold them unescaped
    row = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"row":'), F.translate("record", "\r\n", "  "), F.lit("}"))
    target = scratch_path(spark, "array-lines")
    read_arrays(spark, path).select(row.alias("value")).write.text(target)
    return target
