"""Pairs of short texts a few edits apart, by what is left of them when characters are deleted.

Two texts that differ by ``d`` deletions and ``i`` insertions have a common
subsequence: the longer one without some ``d`` characters is the shorter one
without some ``i``.  So an equi-join on the hashes of all such remainders finds
every pair, and hardly any other: rows grow with the texts and the pairs found,
also where all texts are of one form and share their chunks.  Which lengths are
joined this way is a matter of cost (``Deletions.of``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import spread

# Longest texts looked at, and the most remainders of one text.
LONGEST = 256
MOST_WAYS = 4_000

# Remainders after several deletions are many and mostly of no other text: they pass a
# filter of at most so many bits, which the driver and every task hold.
FILTER_BITS = 27
_CELLS = 1 << 20  # remainders made together
SAMPLED = 16  # one key in so many is counted for the load

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_ALL = (1 << 64) - 1

# characters deleted from the longer and from the shorter text
Edits = tuple[int, int]


@lru_cache(maxsize=256)
def _choices(length: int, deleted: int) -> np.ndarray:
    return np.array(list(combinations(range(length), deleted)), np.int32).reshape(math.comb(length, deleted), deleted).T


def _remainders(points: np.ndarray, deleted: int) -> np.ndarray:
    """Per row the polynomial hashes of its characters without any ``deleted`` of them."""
    rows, length = points.shape
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, _BASE, np.uint64)]))[:length]
    value = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    upto = np.zeros((rows, length + 1), np.uint64)
    np.cumsum(value * power, axis=1, out=upto[:, 1:])
    back = [np.uint64(pow(_BACK, m, 1 << 64)) for m in range(deleted + 1)]
    out = np.repeat(back[deleted] * upto[:, -1:], math.comb(length, deleted), axis=1)
    for m, places in enumerate(_choices(length, deleted)):
        # what deleting a character at each place takes away and moves
        out += (back[m] * upto[:, :-1] - back[m + 1] * upto[:, 1:])[:, places]
    return out


def _keys(hashes: np.ndarray, edits: Edits) -> np.ndarray:
    """Join keys; the last bit says whether both texts have one length."""
    key = hashes + np.uint64((edits[0] * 257 + edits[1]) * 0xD6E8FEB86659FD93 & _ALL)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    return (key & np.uint64(_ALL - 1)) | np.uint64(edits[0] == edits[1])


@dataclass(frozen=True)
class Deletions:
    """The edits that pairs can have, by the length of the longer and of the shorter text."""

    longer: dict[int, list[Edits]]
    shorter: dict[int, list[Edits]]

    @classmethod
    def of(cls, indexed: DataFrame, probing: DataFrame, scheme, always: bool = False) -> Deletions:
        """The lengths of longer texts (``indexed``) whose pairs are cheaper found this way; with ``always``, found at all."""

        def lengths(texts: DataFrame) -> dict[int, int]:
            sized = texts.select(F.length("text").alias("len")).where(F.col("len") <= LONGEST)
            return {r["len"]: r["n"] for r in sized.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}

        own, others = lengths(indexed), lengths(probing)
        longer: dict[int, list[Edits]] = {}
        shorter: dict[int, list[Edits]] = {}
        for a in sorted(own):
            edits = {b: scheme.edits_of(a, b) for b in others if 1 <= b <= a}
            edits = {b: ((k + a - b) // 2, (k - a + b) // 2) for b, k in edits.items() if k >= max(a - b, 1)}
            ways = sum(math.comb(a, d) for d in {d for d, _ in edits.values()})
            rows = sum(math.comb(b, i) + (a if d == 1 else 0) for b, (d, i) in edits.items())
            # a remainder costs about a twentieth of comparing two texts, a row of the join three times as much;
            # the other ways go by length classes, not by which lengths can really make a pair
            near = sum(n for b, n in others.items() if a / scheme.stretch - 1 <= b <= a)
            if ways + rows > MOST_WAYS or not always and edits and ways / 20 + 3 * rows >= near:
                continue
            longer[a] = list(edits.values())
            for b, e in edits.items():
                shorter.setdefault(b, []).append(e)
        return cls(longer, shorter)

    def covers(self, length: Column) -> Column:
        """Whether the pairs whose longer text has that length are found here."""
        return length.isin(list(self.longer)) if self.longer else F.lit(False)

    def others(self, texts: DataFrame) -> DataFrame:
        return texts.where(~self.covers(F.length("text")))

    def _filter(self, probing: DataFrame) -> np.ndarray | None:
        """A bit for every hash that a longer text may find after several deletions."""
        several = {b: [e for e in edits if e[0] > 1] for b, edits in self.shorter.items()}
        if not any(several.values()):
            return None
        at = F.shiftrightunsigned("key", 64 - FILTER_BITS)
        bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
        rows = _rows(probing, several, 1).select(at.alias("at")).select((F.col("at") / 64).cast("int").alias("word"), bit.alias("bit"))
        found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return out

    def _sides(self, indexed: DataFrame, probing: DataFrame, sampled: int = 1) -> tuple[DataFrame, DataFrame]:
        probing = spread(probing, "id")
        left = _rows(spread(indexed, "id"), self.longer, 0, self._filter(probing), sampled)
        return left.withColumnRenamed("id", "x"), _rows(probing, self.shorter, 1, None, sampled).withColumnRenamed("id", "y")

    def pairs(self, indexed: DataFrame, probing: DataFrame) -> DataFrame:
        """Distinct ``x, y`` ids that share a remainder, ``x`` from the indexed (longer) side."""
        left, right = self._sides(indexed, probing)
        # of texts of one length either may be the longer one
        return left.join(right.hint("merge"), "key").where("x < y or key & 1 = 0").select("x", "y").distinct()

    def load(self, texts: DataFrame) -> float:
        """About how many rows the join of ``texts`` with themselves makes."""
        if not any(self.longer.values()):
            return 0
        left, right = (s.groupBy("key").agg(F.count(F.lit(1)).alias(n)) for s, n in zip(self._sides(texts, texts, SAMPLED), ("nx", "ny"), strict=True))
        row = left.join(right.hint("merge"), "key").agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("load")).first()
        return (row["load"] or 0.0) * SAMPLED


def _rows(texts: DataFrame, wanted: dict[int, list[Edits]], side: int, seen: np.ndarray | None = None, sampled: int = 1) -> DataFrame:
    """``key, id`` of every remainder that texts of the ``wanted`` lengths have as the longer (0) or shorter (1) one."""
    wanted = {length: edits for length, edits in wanted.items() if edits}

    def parts(ids: np.ndarray, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        length = points.shape[1]
        for deleted in sorted({e[side] for e in wanted[length]}):
            ways = math.comb(length, deleted)
            step = max(1, _CELLS // ways)
            for start in range(0, len(ids), step):
                some, own = points[start : start + step], ids[start : start + step]
                hashes = _remainders(some, deleted)
                fresh = np.ones(hashes.shape, bool)
                if deleted == 1:
                    # any character of a run leaves the same
                    fresh[:, :-1] = some[:, 1:] != some[:, :-1]
                for edits in wanted[length]:
                    if edits[side] == deleted:
                        keys, good = _keys(hashes, edits), fresh
                        if sampled > 1:
                            good = good & ((keys >> np.uint64(1)) % np.uint64(sampled) == 0)
                        if seen is not None and edits[0] > 1:
                            at = keys >> np.uint64(64 - FILTER_BITS)
                            good = good & (seen[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                        yield keys[good].view(np.int64), np.repeat(own, good.sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch["id"].to_numpy(), batch["text"].to_pylist()
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            for length in np.unique(lengths).tolist():
                here = np.flatnonzero(lengths == length)
                joined = "".join([words[i] for i in here]).encode("utf-32-le", "surrogatepass")
                for keys, own in parts(ids[here], np.frombuffer(joined, np.uint32).reshape(len(here), length)):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own)], names=["key", "id"])

    some = texts.select("id", "text").where(F.length("text").isin(list(wanted)) if wanted else F.lit(False))
    return some.mapInArrow(run, "key bigint, id bigint")
