"""Candidate pairs that share a key: a blocking key of your own, or bands of MinHash signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import freeze
from .deletions import Deletions
from .skew import attach_groups

# Texts of one block meet in tiles of about this many.
TILE = 1_000
_PAIRS_PER_TASK = 4_000_000
_MOST_TASKS = 20_000

# Members of larger blocks are narrowed first where their texts allow it.
CROWDED = 32

# Bins of a signature, and the characters of a gram.
BINS = 32
GRAM = 3
# The share of pairs at the threshold that the bands are to find.
FOUND = 0.93


def block_pairs(texts: DataFrame, keys: Column, split: str | None = None) -> DataFrame:
    """Distinct ``x < y`` ids of frozen ``texts`` (``id, text``) that share one of ``keys``, an array.

    A block of many texts is cut into tiles, and every two of its tiles meet in
    their own place, so its pairs spread over as many tasks as they are worth.  With
    ``split``, a boolean column, only pairs of a true and a false one count.  Null keys join nothing.
    """
    side = F.col(split) if split else F.lit(True)
    keyed = texts.select("id", side.alias("side"), F.explode(F.array_distinct(keys)).alias("key")).where("key is not null")
    keyed = freeze(keyed, "block-keys")
    sizes = freeze(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "block-sizes")
    worth = sizes.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n") / 2), F.lit(0.0))).first()[0]
    tasks = int(min(_MOST_TASKS, max(worth // _PAIRS_PER_TASK, keyed.rdd.getNumPartitions())))
    placed = attach_groups(keyed, sizes, "key", "n").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    left = placed.select(F.col("id").alias("l"), F.col("side").alias("ls"), "key", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"))
    right = placed.select(F.col("id").alias("r"), F.col("side").alias("rs"), "key", F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"))
    met = left.repartition(tasks, "key", "i", "j").join(right.repartition(tasks, "key", "i", "j"), ["key", "i", "j"])
    met = met.where("(i < j or l < r)" + (" and ls <> rs" if split else ""))
    return met.select(F.least("l", "r").alias("x"), F.greatest("l", "r").alias("y")).distinct()


def banded_pairs(texts: DataFrame, scheme, split: str | None = None) -> DataFrame:
    """Distinct ``x < y`` ids of frozen ``texts`` that share a MinHash band; not all those too far apart for ``scheme``.

    Texts of one form share most of their grams, and so their bands.  A crowded
    band is therefore not expanded: of short texts, those that may reach the
    threshold share what is left when a few characters are deleted (``deletions``),
    and of such pairs those with a common band are taken.  Longer texts meet all members.
    """
    side = F.col(split) if split else F.lit(True)
    banded = freeze(minhash_bands(texts, scheme.loss).join(texts.select("id", side.alias("side"), F.length("text").alias("len")), "id"), "bands")
    keyed = banded.select("id", "side", "len", F.explode(F.array_distinct("bands")).alias("key"))
    sizes = freeze(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band-sizes")
    small, crowded = sizes.where(F.col("n") <= CROWDED), sizes.where(F.col("n") > CROWDED)
    placed = keyed.join(small.select("key"), "key")
    members = placed.select(F.col("id").alias("l"), F.col("side").alias("ls"), "key").join(placed.select(F.col("id").alias("r"), F.col("side").alias("rs"), "key"), "key")
    members = members.where("l < r" + (" and ls <> rs" if split else ""))
    found = members.select(F.col("l").alias("x"), F.col("r").alias("y"))
    if crowded.isEmpty():
        return found.distinct()
    near = Deletions.of(texts, texts, scheme, always=True)
    if near.shorter:
        one = banded.select(F.col("id").alias("x"), F.col("side").alias("ls"), F.col("bands").alias("lb"))
        other = banded.select(F.col("id").alias("y"), F.col("side").alias("rs"), F.col("bands").alias("rb"))
        close = near.pairs(texts, texts).join(one, "x").join(other, "y").where(F.arrays_overlap("lb", "rb"))
        close = close.where("ls <> rs") if split else close
        found = found.unionByName(close.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    long = freeze(keyed.where(~near.covers(F.col("len"))), "long-bands")
    if not long.isEmpty():
        found = found.unionByName(_long_pairs(long, keyed, freeze(crowded, "crowded-bands"), near, split))
    return found.distinct()


def _long_pairs(long: DataFrame, keyed: DataFrame, crowded: DataFrame, near: Deletions, split: str | None) -> DataFrame:
    """``x < y`` of the crowded bands' pairs with at least one of their ``long`` members, tile by tile."""
    sizes = freeze(long.groupBy("key").agg(F.count(F.lit(1)).alias("n_long")).join(crowded, "key"), "long-sizes")
    worth = sizes.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n_long")), F.lit(0.0))).first()[0]
    tasks = int(min(_MOST_TASKS, max(worth // _PAIRS_PER_TASK, keyed.rdd.getNumPartitions())))
    tiles = sizes.select("key", "n", "n_long", F.ceil(F.col("n_long") / TILE).cast("int").alias("is"), F.ceil(F.col("n") / TILE).cast("int").alias("js"))

    def dealt(rows: DataFrame, size: str, own: str, others: str, at: str, every: str, names: list[str]) -> DataFrame:
        rows = attach_groups(rows, tiles, "key", size).withColumn(at, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        rows = rows.withColumn(every, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return rows.select(F.col("id").alias(names[0]), F.col("side").alias(names[1]), F.col("len").alias(names[2]), "key", "i", "j").repartition(tasks, "key", "i", "j")

    left = dealt(long, "n_long", "is", "js", "i", "j", ["l", "ls", "ll"])
    right = dealt(keyed, "n", "js", "is", "j", "i", ["r", "rs", "rl"])
    met = left.join(right, ["key", "i", "j"]).where("l <> r" + (" and ls <> rs" if split else ""))
    # two long ones meet from either side
    met = met.where(near.covers(F.col("rl")) | (F.col("l") < F.col("r")))
    return met.select(F.least("l", "r").alias("x"), F.greatest("l", "r").alias("y"))


def band_rows(loss: float) -> int:
    """How many bins make a band: as many as still find enough pairs with that share of edits.

    Reckoned with edits that are replaced characters far apart, each of which changes ``GRAM`` grams.
    """
    alike = max(0.0, (1 - GRAM * loss) / (1 + GRAM * loss))
    return next((rows for rows in (16, 8, 4, 2) if 1 - (1 - alike**rows) ** (BINS // rows) >= FOUND), 1)


def minhash_bands(texts: DataFrame, loss: float) -> DataFrame:
    """``id, bands``: keys of the one-permutation MinHash signatures of texts, on their character 3-grams.

    One hash deals the grams into bins, whose minima are the signature.  An empty
    bin takes the value of the next one that is not, mixed with the distance.
    """
    rows = band_rows(loss)
    starts = F.sequence(F.lit(1), F.greatest(F.length("text") - GRAM + 1, F.lit(1)))
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    grams = texts.select("id", F.transform(starts, lambda i: F.xxhash64(F.substring(F.col("text"), i, F.lit(GRAM)))).alias("hs"))
    least = F.transform(bins, lambda i: F.struct(i.alias("i"), F.array_min(F.filter("hs", lambda h: F.pmod(h, F.lit(BINS)) == i)).alias("v")))
    filled = grams.select("id", F.filter(least, lambda b: b["v"].isNotNull()).alias("filled"))

    def of_bin(i: Column) -> Column:
        after = F.coalesce(F.get(F.filter("filled", lambda b: b["i"] >= i), F.lit(0)), F.get("filled", F.lit(0)))
        return F.xxhash64(F.pmod(after["i"] - i, F.lit(BINS)), after["v"])

    dense = filled.select("id", F.transform(bins, of_bin).alias("dense"))
    keys = [F.xxhash64(F.lit(k), *[F.get("dense", F.lit(k * rows + j)) for j in range(rows)]) for k in range(BINS // rows)]
    return dense.select("id", F.array(*keys).alias("bands"))
