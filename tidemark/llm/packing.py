"""Pack token ids into windows of a fixed size by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.encoding import portions, shared_encoder
from tidemark.llm.tables import texts
from tidemark.sources.scratch import freeze, spread

_PIECES = "doc_id long, start long, length int, doc_tokens long, ids binary, part int, nth long"
PLAN = "length int, first long, last long, window_first long, per_window int, offset int"


class OpenWindows:
    """A segment tree over remaining capacity: which capacities have open windows."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, room: int, value: int) -> None:
        at = self.leaves + room
        self.any[at] = value
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def add(self, room: int, first: int, count: int) -> None:
        """``count`` windows numbered from ``first``, each with ``room`` ids left."""
        if room and count:
            self.runs.setdefault(room, []).append((first, count))
            if len(self.runs[room]) == 1:
                self._mark(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, 0)
        return run

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that a window has."""
        at = self.leaves + length
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where best-fit decreasing puts ``counts[length]`` pieces of each length.

    Pieces of one length are interchangeable, and so are windows with the same
    room, so whole runs are placed at once: the work depends on the window size,
    not on the number of pieces.  A row ``(length, first, last, window_first,
    per_window, offset)`` says: pieces ``first..last`` of this length fill the
    windows from ``window_first`` on, ``per_window`` in each, from ``offset``.
    """
    free, plan, opened = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        done, count = 0, counts[length]
        while done < count:
            room = free.tightest(length)
            if room is None:
                room, first, n = window, opened, -(-(count - done) // (window // length))
                opened += n
            else:
                first, n = free.take(room)
            per = room // length
            full, rest = divmod(min(count - done, n * per), per)
            used = full + bool(rest)
            placed = full * per + rest
            plan.append((length, done, done + placed - 1, first, per, window - room))
            free.add(room - per * length, first, full)
            if rest:
                free.add(room - rest * length, first + full, 1)
            free.add(room, first + used, n - used)
            done += placed
    return plan


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    window: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``.

    A document's ids, closed by ``end_id``, are cut into full windows and one
    rest.  Best-fit decreasing over all pieces of the table then puts each piece
    at ``offset`` of sequence ``sequence_id``; sequences are filled without gaps
    from 0.  ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.

    One pass encodes and writes the pieces.  Their lengths are counted per task
    of that pass; the driver sees one count per length (at most ``window``) and
    returns the plan, whose size also depends on the window alone.  Numbering
    the pieces of one length works from the counts, so a length that a third of
    the table shares is no hot group, and ids are never shuffled while the
    counts per task stay broadcastable.

    Defined cases: null and empty texts are one piece, the end id; an empty table
    gives an empty result; null or repeated document ids are carried through,
    each row packed by itself; other columns are ignored.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(window + 1, np.int64)
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "nth"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            texts_of = zip(batch["doc_id"].to_pylist(), (t.as_py() for t in batch["text"]), strict=True)
            for doc_ids, some in portions(texts_of):
                for doc_id, packed in zip(doc_ids, encoder.encode(some), strict=True):
                    ids = packed + end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        length = len(piece) // 4
                        rows.append((doc_id, start, length, total, piece, part, int(seen[length])))
                        seen[length] += 1
                        held += len(piece)
                if held > 8_000_000:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    pieces = spread(texts(docs, id_col, text_col)).mapInArrow(encode, _PIECES)
    pieces = freeze(pieces, "pieces", compression="zstd")
    return _place(spark, pieces, window)


def _place(spark, pieces: DataFrame, window: int) -> DataFrame:
    counts = freeze(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_decreasing(totals, window), PLAN)
    # how many pieces of this length the earlier tasks have
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # up to a million rows of three numbers; beyond that both sides are shuffled by part and length
    if counts.limit(1_000_001).count() <= 1_000_000:
        base = F.broadcast(base)
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    found = ranked.join(F.broadcast(plan), "length").where(F.col("rank").between(F.col("first"), F.col("last")))
    return found.select(
        "doc_id",
        "start",
        F.col("length").cast("bigint").alias("length"),
        "doc_tokens",
        "ids",
        F.expr("window_first + (rank - first) div per_window").alias("sequence_id"),
        F.expr("offset + (rank - first) % per_window * length").cast("bigint").alias("offset"),
    )
