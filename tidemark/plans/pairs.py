"""Lossless candidate pairs for similarity at a threshold.

Take two different texts ``x`` (length ``a``) and ``y`` (length ``b <= a``) whose
score reaches ``t = threshold / 100``.  Turning one into the other then needs at
most ``k = (1 - t)(a + b)`` insertions and deletions, with the parity of
``a + b``.  Cut ``x`` into disjoint chunks of ``q`` characters.  One edit can
spoil at most one chunk, so of any ``k + 1`` chunks one is found unchanged in
``y``, shifted by no more than the edits allow.  With ``q = 1`` an insertion
spoils nothing, so one more chunk than deletions is enough, which holds for any
threshold above zero.

The longer text of a pair is therefore indexed by its ``k + 1`` *rarest* chunks
and the shorter one probes with its character q-grams; an equi-join on (length
class, gram) brings every qualifying pair together.  Which chunks are chosen
only affects cost, so rarity comes from a bounded table of hashed counts.

Where a length class has so many texts in common form that even rare chunks meet
more often than there are pairs of texts, as at low thresholds, that class is
compared tile by tile instead (``blocked_classes``): a tile of longer texts meets a tile of
shorter ones in one task, which folds the common lengths of all their pairs at once.

Short texts a few edits apart need neither: ``deletions`` joins what is left of
them without a few characters, so that texts of one form cost no more than others.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import common_length, common_lengths, ratio_from_common
from ..sources.scratch import spread
from .blocks import banded_pairs, block_pairs
from .deletions import Deletions

# Size of the hashed gram-count table; the driver and every task hold this many bytes.
BUCKETS = 1 << 16

# A gram counted this often, and this many times the average, is spread over
# several join keys, one more doubling per doubling of its count.
HOT_GRAMS = 2_000
HOT_RATIO = 32
_MAX_SALT_BITS = 10

# Texts up to this length travel with their grams, so that most candidates are
# rejected where they meet; longer ones are looked up for distinct candidates.
CARRIED = 128

# Texts of a class that is compared in full meet in tiles of about this many on either side.
TILE = 512
# Texts that the choice between the two ways is judged by; it never changes the result.
JUDGED = 4_000
# So many pairs of texts are compared sooner than the choice is made.
AT_ONCE = 4_000_000
_TILES_PER_TASK = 8
_MOST_TASKS = 20_000
_CELLS = 1 << 18  # 64-bit words folded together

_EPS = 1e-9


@dataclass(frozen=True)
class Scheme:
    """Length classes and chunk sizes for one threshold (a number above 0)."""

    threshold: float

    def __post_init__(self) -> None:
        if not 0 < self.threshold <= 100:
            raise ValueError("Pairs need a threshold above 0 and up to 100: at 0 every row matches every other")

    @property
    def loss(self) -> float:
        return 1 - self.threshold / 100

    @property
    def stretch(self) -> float:
        """Largest length ratio of a qualifying pair."""
        return (1 + self.loss) / (1 - self.loss)

    def length_class(self, length: Column) -> Column:
        return F.floor(F.log(length.cast("double")) / F.lit(math.log(self.stretch))).cast("int")

    def chunk(self, length_class: Column) -> Column:
        """Characters per chunk, so that every text of the class has enough chunks.

        A quarter more chunks than needed leaves room to avoid frequent ones.
        """
        shortest = F.pow(F.lit(self.stretch), length_class)
        edits = F.lit(2 * self.loss) * shortest
        return F.greatest(F.lit(1), F.floor(shortest / ((edits + 1) * 1.25 + 0.5))).cast("int")

    def edits(self, a: Column, b: Column) -> Column:
        """Most edits a qualifying pair of these lengths can have."""
        total = a + b
        most = F.floor(F.lit(self.loss) * total + _EPS).cast("int")
        return most - F.pmod(most + total, F.lit(2))

    def edits_of(self, a: int, b: int) -> int:
        """The same for two numbers."""
        most = math.floor(self.loss * (a + b) + _EPS)
        return most - (most + a + b) % 2

    def most_edits(self, a: Column) -> Column:
        return F.floor(F.lit(2 * self.loss) * a + _EPS).cast("int")

    def most_deletions(self, a: Column) -> Column:
        """``a`` minus the shortest partner, which is when deletions peak."""
        return F.floor(a * (1 - 1 / self.stretch) + _EPS).cast("int")


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass
class GramCounts:
    """Hashed chunk counts on a log scale, one byte per bucket."""

    levels: bytes
    hot: int

    @classmethod
    def of(cls, texts: DataFrame, scheme: Scheme) -> GramCounts:
        chunks = _with_class(texts, scheme).select(F.explode(_chunk_grams()).alias("gram"))
        # at most BUCKETS rows come back, whatever the data
        counted = chunks.groupBy(_bucket(F.col("gram")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        levels = bytearray(BUCKETS)
        for row in counted:
            levels[row["b"]] = min(255, math.ceil(8 * math.log2(row["n"] + 1)))
        mean = sum(row["n"] for row in counted) / max(1, len(counted))
        return cls(bytes(levels), math.ceil(8 * math.log2(max(HOT_GRAMS, HOT_RATIO * mean))))

    def level(self, gram: Column) -> Column:
        return F.substring(F.lit(self.levels), _bucket(gram) + 1, F.lit(1))

    def salts(self, gram: Column) -> Column | None:
        """Number of join keys a gram is spread over; None when no gram needs it."""
        top = max(self.levels)
        if top < self.hot:
            return None
        level = self.level(gram)
        out = F.lit(1)
        for bits in range(1, min(_MAX_SALT_BITS, (top - self.hot) // 8 + 2) + 1):
            floor = min(255, self.hot + 8 * (bits - 1))
            out = F.when(level >= F.lit(bytes([floor])), F.lit(1 << bits)).otherwise(out)
        return out


def _with_class(texts: DataFrame, scheme: Scheme) -> DataFrame:
    """Texts that can have a different partner, with their class and chunk size."""
    sized = texts.select("id", "text", F.length("text").alias("len")).where(
        scheme.most_edits(F.col("len")) >= 1
    )
    classed = sized.withColumn("cls", scheme.length_class(F.col("len")))
    return classed.withColumn("q", scheme.chunk(F.col("cls")))


def _carried(length: Column) -> Column:
    return F.when(length <= CARRIED, F.col("text"))


def _chunk_grams() -> Column:
    starts = F.sequence(F.lit(0), F.floor(F.col("len") / F.col("q")).cast("int") - 1)
    return F.transform(starts, lambda i: F.substring(F.col("text"), i * F.col("q") + 1, F.col("q")))


def _index(texts: DataFrame, scheme: Scheme, counts: GramCounts) -> DataFrame:
    """Rarest chunks of every text as ``rank``-ordered join rows."""
    classed = _with_class(texts, scheme).withColumn(
        "need",
        1 + F.when(F.col("q") == 1, scheme.most_deletions(F.col("len"))).otherwise(scheme.most_edits(F.col("len"))),
    )
    ranked = F.sort_array(
        F.transform(
            _chunk_grams(),
            lambda gram, i: F.struct(counts.level(gram).alias("level"), i.alias("i"), gram.alias("gram")),
        )
    )
    short = _carried(F.col("len")).alias("x_text")
    rows = classed.select("id", "len", "cls", "q", short, F.posexplode(F.slice(ranked, F.lit(1), F.col("need"))).alias("rank", "c"))
    rows = rows.select(
        F.col("id").alias("x"), F.col("len").alias("a"), "x_text", "cls", "q", "rank",
        (F.col("c.i") * F.col("q")).alias("at"), F.col("c.gram").alias("gram"),
    )
    salts = counts.salts(F.col("gram"))
    # few index rows carry a frequent gram, so these are the ones to repeat
    return rows.withColumn("salt", F.lit(0) if salts is None else F.explode(F.sequence(F.lit(0), salts - 1)))


def _partners(texts: DataFrame, scheme: Scheme) -> DataFrame:
    """Texts once per length class of their longer partners."""
    sized = texts.select("id", "text", F.length("text").alias("b")).where(F.col("b") >= 1)
    longest = F.greatest(F.col("b").cast("double"), F.floor(F.col("b") * F.lit(scheme.stretch) + 1e-6))
    # a pair of different texts needs at least one edit
    sized = sized.where(F.floor(F.lit(scheme.loss) * (F.col("b") + longest) + _EPS) >= 1)
    classes = F.sequence(scheme.length_class(F.col("b")), scheme.length_class(longest))
    return sized.select("id", "text", "b", F.explode(classes).alias("cls")).withColumn("q", scheme.chunk(F.col("cls")))


def _probe(texts: DataFrame, scheme: Scheme, counts: GramCounts) -> DataFrame:
    """All q-grams of every text, once per length class of its longer partners."""
    classed = _partners(texts, scheme).where(F.col("b") >= F.col("q"))
    starts = F.sequence(F.lit(1), F.col("b") - F.col("q") + 1)
    rows = classed.select("id", "text", "b", "cls", "q", F.explode(starts).alias("s")).select(
        F.col("id").alias("y"), "b", "cls", (F.col("s") - 1).alias("found"),
        F.substring("text", F.col("s"), F.col("q")).alias("gram"), _carried(F.col("b")).alias("y_text"),
    )
    salts = counts.salts(F.col("gram"))
    salt = F.lit(0) if salts is None else F.pmod(F.xxhash64("y", "found"), salts).cast("int")
    return rows.withColumn("salt", salt)


def candidate_load(texts: DataFrame, scheme: Scheme) -> float:
    """Rows the joins for candidates would visit, from per-key counts alone."""
    near = Deletions.of(texts, texts, scheme)
    others = near.others(texts)
    if not class_sizes(others, texts, scheme):
        return near.load(texts)
    counts = GramCounts.of(others, scheme)
    keys = ["cls", "gram", "salt"]
    left = _index(others, scheme, counts).groupBy(*keys).agg(F.count(F.lit(1)).alias("nx"))
    right = _probe(texts, scheme, counts).groupBy(*keys).agg(F.count(F.lit(1)).alias("ny"))
    row = left.join(right, keys).agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("load")).first()
    return near.load(texts) + (row["load"] or 0)


@dataclass(frozen=True)
class ClassCost:
    """Rows that either way visits for the texts of one length class and their shorter partners."""

    cls: int
    longer: int
    shorter: int
    by_grams: float
    length: float

    @property
    def by_tiles(self) -> int:
        return self.longer * self.shorter

    @property
    def tile_work(self) -> float:
        """A pair in a tile costs about a row of the other way, as long as its texts have up to 64 characters."""
        return self.by_tiles * max(1.0, self.length / 64) ** 2


def class_sizes(indexed: DataFrame, probing: DataFrame, scheme: Scheme) -> list[ClassCost]:
    """The texts of every length class; there are as many classes as lengths differ by factors of ``stretch``."""
    longer = _with_class(indexed, scheme).groupBy("cls").agg(F.count(F.lit(1)).alias("nx"))
    shorter = _partners(probing, scheme).groupBy("cls").agg(F.count(F.lit(1)).alias("ny"))
    found = longer.join(shorter, "cls").collect()
    return sorted((ClassCost(r["cls"], r["nx"], r["ny"], math.inf, scheme.stretch ** (r["cls"] + 1)) for r in found), key=lambda c: c.cls)


def class_costs(sizes: list[ClassCost], indexed: DataFrame, probing: DataFrame, scheme: Scheme, counts: GramCounts) -> list[ClassCost]:
    """The classes with the rows that grams would visit, counted among a sample of the texts."""
    most = max((max(c.longer, c.shorter) for c in sizes), default=0)
    rate = max(1, most // JUDGED)
    some = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(rate)) == 0
    keys = ["cls", "gram"]
    left = _index(indexed.where(some), scheme, counts).groupBy(*keys).agg(F.count_if(F.col("salt") == 0).alias("nx"))
    right = _probe(probing.where(some), scheme, counts).groupBy(*keys).agg(F.count(F.lit(1)).alias("ny"))
    meetings = left.join(right, keys).groupBy("cls").agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("load"))
    loads = {r["cls"]: r["load"] * rate * rate for r in meetings.collect()}
    return [replace(c, by_grams=loads.get(c.cls, 0.0)) for c in sizes]


def blocked_classes(costs: list[ClassCost]) -> list[ClassCost]:
    """The classes that are cheaper to compare in full."""
    return [c for c in costs if c.tile_work < c.by_grams]


def _tile_pairs(indexed: DataFrame, probing: DataFrame, scheme: Scheme, blocked: list[ClassCost]) -> DataFrame:
    """``x, y, a, b, common`` of the blocked classes' pairs that reach the threshold, each pair once."""
    loss = scheme.loss

    def tiles(count: str) -> Column:
        out = F.lit(1)
        for c in blocked:
            out = F.when(F.col("cls") == c.cls, -(-getattr(c, count) // TILE)).otherwise(out)
        return out

    def dealt(rows: DataFrame, own: str, others: str, at: str, every: str, side: str) -> DataFrame:
        """Every text at its tile's place, once for each tile it meets."""
        placed = rows.where(F.col("cls").isin([c.cls for c in blocked])).withColumn(at, F.pmod(F.xxhash64("id"), tiles(own)).cast("int"))
        return placed.withColumn(every, F.explode(F.sequence(F.lit(0), tiles(others) - 1))).select(F.col("id").alias(side), F.col("text").alias(f"{side}_text"), "cls", "i", "j")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["x", "y", "a", "b", "common"]
        parts = [np.zeros((5, 0), np.int64)]
        if left.num_rows and right.num_rows:
            xs, ys = left["x"].to_numpy(), right["y"].to_numpy()
            x_texts, y_texts = left["x_text"].to_pylist(), right["y_text"].to_pylist()
            b = np.fromiter(map(len, y_texts), np.int64, len(ys))
            step = max(1, _CELLS // (len(ys) * -(-max(map(len, x_texts)) // 64)))
            for at in range(0, len(xs), step):
                ids, a = xs[at : at + step, None], np.fromiter(map(len, x_texts[at : at + step]), np.int64)[:, None]
                common = common_lengths(x_texts[at : at + step], y_texts)
                edits = a + b - 2 * common
                good = (edits <= loss * (a + b) + 1e-6) & ((a > b) | (a == b) & (ids < ys))
                rows, columns = np.nonzero(good)
                parts.append(np.stack([ids[rows, 0], ys[columns], a[rows, 0], b[columns], common[good]]))
        return pa.Table.from_arrays([pa.array(c) for c in np.concatenate(parts, axis=1)], names=names)

    keys = ["cls", "i", "j"]
    left = dealt(_with_class(spread(indexed, "id"), scheme), "longer", "shorter", "i", "j", "x")
    right = dealt(_partners(spread(probing, "id"), scheme), "shorter", "longer", "j", "i", "y")
    # few bytes, much work: as many tasks as the tiles are worth, which sizes alone would not tell
    meetings = sum(-(-c.longer // TILE) * -(-c.shorter // TILE) for c in blocked)
    tasks = min(_MOST_TASKS, -(-meetings // _TILES_PER_TASK))
    both = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys))
    return both.applyInArrow(meet, "x long, y long, a long, b long, common long")


def candidate_ids(indexed: DataFrame, probing: DataFrame, scheme: Scheme, counts: GramCounts, blocked: list[ClassCost] | None = None) -> DataFrame:
    """Distinct ``x, y`` ids outside the blocked classes, ``x`` from the indexed (longer) side."""
    a, b = F.col("a"), F.col("b")
    edits = scheme.edits(a, b)
    deletions = (edits + a - b) / 2
    insertions = (edits - a + b) / 2
    spoiled = F.when(F.col("q") == 1, deletions).otherwise(edits)
    # probing is the costly side: a small table of texts must not sit in one task
    index, probes = _index(indexed, scheme, counts), _probe(spread(probing, "id"), scheme, counts)
    if blocked:
        rest = ~F.col("cls").isin([c.cls for c in blocked])
        index, probes = index.where(rest), probes.where(rest)
    joined = index.join(probes, ["cls", "gram", "salt"])
    fits = (
        (F.col("x") != F.col("y"))
        & ((a > b) | ((a == b) & (F.col("x") < F.col("y"))))
        & (edits >= F.greatest(a - b, F.lit(1)))
        & (F.col("rank") <= spoiled)
        & (F.col("found") >= F.col("at") - deletions)
        & (F.col("found") <= F.col("at") + insertions)
    )
    rejected = F.call_function("levenshtein", F.col("x_text"), F.col("y_text"), edits) < 0
    return joined.where(fits & ~F.coalesce(rejected, F.lit(False))).select("x", "y").distinct()


@dataclass(frozen=True)
class Matcher:
    """What counts as similar: a threshold, on the built-in score or on your own.

    A scorer of your own (two text columns, earlier row first, to a score from
    0 to 100) judges the pairs whose built-in score reaches ``candidates_at``, or else
    those that share a key: ``block_key`` makes a text's key, or an array of keys, of a text column.

    ``approximate`` finds pairs by MinHash bands instead of all of them: nothing
    is reported below the threshold, but a few pairs above it may be missing.
    """

    threshold: float
    similarity: Callable[[Column, Column], Column] | None = None
    candidates_at: float | None = None
    block_key: Callable[[Column], Column] | None = None
    approximate: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 100:
            raise ValueError("A threshold of similarity lies between 0 and 100")
        ways = (self.candidates_at is not None) + (self.block_key is not None)
        if ways != (self.similarity is not None):
            raise ValueError("A similarity of your own needs candidates_at or block_key, and only then")
        if self.approximate and (self.similarity is not None or self.threshold == 0):
            raise ValueError("Approximate pairs need the built-in score and a threshold above 0")

    @property
    def scheme(self) -> Scheme:
        if self.block_key is not None:
            return Scheme(100)  # keys alone make the pairs
        return Scheme(self.threshold if self.candidates_at is None else self.candidates_at)

    def _shared(self, texts: DataFrame, split: str | None = None) -> DataFrame:
        """Distinct ``x, y`` ids that share a key or a band."""
        if self.approximate:
            return banded_pairs(texts, self.scheme, split)
        key = texts.withColumn("key", self.block_key(F.col("text")))
        several = isinstance(key.schema["key"].dataType, T.ArrayType)
        return block_pairs(key, F.col("key") if several else F.array("key"), split)

    def pairs(self, texts: DataFrame) -> DataFrame:
        """All pairs ``a < b`` of distinct texts (frozen ``id, text``) with their score."""
        scheme = self.scheme
        if self.block_key is not None:
            return self._own_score(self._shared(texts).toDF("a", "b"), texts)
        if scheme.loss == 0:
            return _no_pairs(texts)
        if self.approximate:
            return self.verified(self._shared(texts), texts)
        sizes = class_sizes(texts, texts, scheme)
        if sum(c.tile_work for c in sizes) <= AT_ONCE:
            return self.tiled(texts, texts, sizes) if sizes else _no_pairs(texts)
        near = Deletions.of(texts, texts, scheme)
        others = near.others(texts)
        candidates, blocked = [near.pairs(texts, texts)] if near.shorter else [], []
        if sizes := class_sizes(others, texts, scheme) if near.longer else sizes:
            counts = GramCounts.of(others, scheme)
            blocked = sizes if 0 < sum(c.tile_work for c in sizes) <= AT_ONCE else blocked_classes(class_costs(sizes, others, texts, scheme, counts))
            if len(blocked) < len(sizes):
                candidates.append(candidate_ids(others, texts, scheme, counts, blocked))
        found = [self.verified(reduce(DataFrame.unionByName, candidates), texts)] if candidates else []
        if blocked:
            found.append(self.tiled(others, texts, blocked))
        return reduce(DataFrame.unionByName, found) if found else _no_pairs(texts)

    def between(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs with one text from each of two disjoint sets of frozen texts."""
        scheme, both = self.scheme, left.select("id", "text").unionByName(right.select("id", "text"))
        if self.block_key is not None or self.approximate and scheme.loss > 0:
            sides = left.select("id", "text", F.lit(True).alias("early")).unionByName(right.select("id", "text", F.lit(False).alias("early")))
            shared = self._shared(sides, "early")
            return self._own_score(shared.toDF("a", "b"), both) if self.block_key is not None else self.verified(shared, both)
        if scheme.loss == 0:
            return _no_pairs(left)
        candidates, counts = [], None
        for longer, shorter in ((left, right), (right, left)):
            near = Deletions.of(longer, shorter, scheme)
            others = near.others(longer)
            if near.shorter:
                candidates.append(near.pairs(longer, shorter))
            if class_sizes(others, shorter, scheme):
                counts = counts or GramCounts.of(right, scheme)
                candidates.append(candidate_ids(others, shorter, scheme, counts))
        return self.verified(reduce(DataFrame.union, candidates), both) if candidates else _no_pairs(left)

    def verified(self, candidates: DataFrame, texts: DataFrame) -> DataFrame:
        """Candidates that reach the threshold, as ``a < b, score``.

        A banded Levenshtein test, which never exceeds the number of insertions
        and deletions, rejects most candidates inside the JVM; the rest get the
        exact common length.
        """
        scheme = self.scheme
        ordered = candidates.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        both = _with_texts(ordered, texts)
        left, right = F.col("left"), F.col("right")
        edits = scheme.edits(F.length(left), F.length(right))
        close = both.where(F.call_function("levenshtein", left, right, edits) >= 0)
        counted = close.withColumn("common", common_length(right, left))
        scored = counted.withColumn("score", ratio_from_common(F.col("common"), F.length(left), F.length(right)))
        return self._judged(scored).select("a", "b", "score")

    def tiled(self, longer: DataFrame, texts: DataFrame, blocked: list[ClassCost]) -> DataFrame:
        """The same for the blocked classes of ``longer`` texts, whose common lengths are known where texts meet."""
        met = _tile_pairs(longer, texts, self.scheme, blocked)
        scored = met.withColumn("score", ratio_from_common(F.col("common"), F.col("a"), F.col("b")))
        scored = scored.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")
        return self._judged(scored if self.similarity is None else _with_texts(scored, texts)).select("a", "b", "score")

    def _own_score(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        own = self.similarity(F.col("left"), F.col("right")).cast("double")
        return _with_texts(pairs, texts).select("a", "b", own.alias("score")).where(F.col("score") >= F.lit(float(self.threshold)))

    def _judged(self, scored: DataFrame) -> DataFrame:
        scored = scored.where(F.col("score") >= F.lit(float(self.scheme.threshold)))
        if self.similarity is None:
            return scored
        own = self.similarity(F.col("left"), F.col("right")).cast("double")
        return scored.withColumn("score", own).where(F.col("score") >= F.lit(float(self.threshold)))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with their texts, ``left`` and ``right``."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("left")), texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b")


def _no_pairs(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], "a bigint, b bigint, score double")
