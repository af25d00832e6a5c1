"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.tables import small_enough, texts
from tidemark.sources.scratch import discard, freeze, freeze_alone, spread

ROWS = 5
UNIVERSE = 1 << 20
# blocks of candidate sets that are compared with each other: nodes, shingles, and columns at a time
_BLOCK_NODES = 200
_BLOCK_SHINGLES = 500_000
_BLOCK_COLUMNS = 8192
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def bands_for(threshold: float, rows: int = ROWS, miss: float = 1e-7) -> int:
    """How many bands leave a pair at the threshold undiscovered with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


class Shingles:
    """Sets of word shingles as sorted arrays of 64-bit hashes.

    A-Z is lowered; words are what ASCII white space separates.  A text with
    fewer words than a shingle has its whole sequence as the one shingle.
    """

    def __init__(self, size: int, remember: int = 300_000):
        self.size, self.remember = size, remember
        self.known: dict[bytes, int] = {}
        self.factors = [np.uint64(_MIX[i % len(_MIX)] + 2 * (i // len(_MIX))) for i in range(size)]

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        hashed = np.array([known[w] for w in words], np.uint64)
        n = min(self.size, len(words))
        last = len(words) - n + 1
        mixed = np.full(last, np.uint64(n), np.uint64)
        for i in range(n):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * self.factors[i] + hashed[i : i + last]
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed * np.uint64(_MIX[1]))


class CirculantMinHash:
    """All coordinates of a signature from two permutations of one universe.

    The first scatters the shingles, the second ranks them; coordinate ``k`` is
    the smallest rank after the second was shifted circularly by ``k``.
    """

    def __init__(self, coordinates: int, universe: int = UNIVERSE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.universe = np.uint64(universe)
        self.scatter = rng.permutation(universe).astype(np.int32)
        rank = rng.permutation(universe).astype(np.int32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[:coordinates]]), coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = self.scatter[(shingles % self.universe).astype(np.int64)]
        parts = [self.shifted[places[i : i + 4096]].min(axis=0) for i in range(0, len(places), 4096)]
        return parts[0] if len(parts) == 1 else np.min(parts, axis=0)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band, different for equal values in different bands."""
    blocks = signature.reshape(-1, rows).astype(np.uint64)
    keys = np.arange(1, len(blocks) + 1, dtype=np.uint64) * np.uint64(_MIX[0])
    for i in range(rows):
        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(_MIX[2]) + blocks[:, i]
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(_MIX[4])
    return keys.view(np.int64)


def _features(docs: DataFrame, size: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minhash = Shingles(size), None
        for batch in batches:
            minhash = minhash or CirculantMinHash(bands * ROWS)
            n, keys, buckets = [], [], []
            for text in batch["text"]:
                own = shingles.of(text.as_py())
                n.append(len(own))
                keys.append(hashlib.md5(own.tobytes()).digest() if len(own) else None)
                buckets.append(band_keys(minhash.signature(own), ROWS) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["doc_id", "n", "set_key", "buckets"],
            )

    return spread(docs).mapInArrow(run, "doc_id long, n long, set_key binary, buckets array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            found = [shingles.of(text.as_py()).view(np.int64) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    return docs.mapInArrow(run, "node long, shingles array<long>")


def _reach(a: str, b: str, percent: int):
    """Whether two sets could still reach the threshold, given the shingles no other candidate has."""
    shared = F.least(F.col(f"{a}.shared"), F.col(f"{b}.shared"))
    return shared * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have the Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("both", both)
        .where(F.col("both") * (100 + percent) >= (F.size("x") + F.size("y")) * percent)
        .select("a", "b")
    )


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(common), _BLOCK_COLUMNS):
        some = common[at : at + _BLOCK_COLUMNS]
        sides = []
        for block in (left, right):
            has = np.zeros((len(block), len(some)), np.float32)
            for i, own in enumerate(block):
                place = np.minimum(np.searchsorted(some, own), len(some) - 1)
                has[i, place[some[place] == own]] = 1
            sides.append(has)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Links between nodes around one component (``main``) that are not connected yet.

    Nodes outside the component are compared with all others around it, block by
    block: a row is a pair of blocks of bounded size, and only links come out.
    """
    entry = F.struct("node", "component", "shingles")
    block = members.groupBy("main", "lot").agg(F.collect_list(entry).alias("theirs"))
    apart = members.where("component <> main").groupBy("main", "lot").agg(F.collect_list(entry).alias("ours"))
    pairs = apart.select("main", "ours").join(block.select("main", "theirs"), "main").select("ours", "theirs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for name in ("ours", "theirs"):
                    rows = batch[name].slice(i, 1).flatten()
                    nodes, labels, lists = (rows.field(k) for k in range(3))
                    at = lists.offsets.to_numpy()
                    values = lists.values.to_numpy()
                    sets = [np.sort(values[x:y]) for x, y in zip(at, at[1:], strict=False)]
                    sides.append((nodes.to_numpy(), labels.to_numpy(), sets, np.diff(at).astype(np.int64)))
                (n1, c1, s1, k1), (n2, c2, s2, k2) = sides
                both = _overlaps(s1, s2) * (100 + percent) >= (k1[:, None] + k2) * percent
                a, b = np.nonzero(both & (c1[:, None] != c2))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(n1[a], n2[b])), pa.array(np.maximum(n1[a], n2[b]))], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def near_copies(
    docs: DataFrame,
    *,
    shingle: int = 5,
    percent: int = 80,
    bands: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents whose shingle sets have a Jaccard similarity of at least
    ``percent`` hundredths are linked; ``component_id`` is the smallest id of
    the connected group, and the document with that id is kept.

    Equal sets are one node from the start, however many copies there are.  Nodes
    that share a band are candidates.  A node too many of whose shingles occur
    in no other candidate cannot reach the threshold and leaves.  Then, in every
    bucket, all members are compared with one member (the one closest to what the
    others share).  Members that it does not connect are compared with everything
    around its component, in pairs of blocks of bounded size.  So no bucket is
    expanded into its pairs, yet each candidate pair is either compared on the
    full sets or already connected.  A pair at the threshold shares no band with
    probability 1e-7 (independent coordinates assumed); higher similarities less.

    Defined cases: null, empty or blank texts have an empty set and are linked with
    nothing; rows with equal ids count as one document; a null id is linked with
    nothing and kept; an empty table gives an empty result; other columns are ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent lies in 1..100")
    bands = bands or bands_for(min(percent, 99) / 100)
    rows = texts(docs, id_col, text_col)
    features = freeze(_features(rows, shingle, bands), "minhash")
    nodes = freeze(
        features.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node")), "equal-sets"
    )
    firsts = nodes.select("set_key", F.col("node").alias("doc_id"))
    buckets = features.join(firsts, ["set_key", "doc_id"], "left_semi").select(F.explode("buckets").alias("bucket"), F.col("doc_id").alias("node"))
    buckets = freeze(buckets, "buckets")
    placed = freeze(features.select("doc_id", "n", "set_key").join(nodes, "set_key", "left").drop("set_key"), "placed")
    discard(features, nodes)
    crowded = freeze(
        buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("bucket"),
        "crowded",
    )
    hint = F.broadcast if small_enough(crowded) else (lambda df: df)
    met = freeze(buckets.join(hint(crowded), "bucket", "left_semi").distinct(), "members")
    discard(buckets, crowded)

    candidates = freeze(met.select(F.col("node").alias("doc_id")).distinct(), "candidates")
    hint = F.broadcast if small_enough(candidates) else (lambda df: df)
    sets = freeze(_sets(rows.join(hint(candidates), "doc_id", "left_semi"), shingle).distinct(), "candidate-sets")
    alone = (
        sets.select("node", F.explode("shingles").alias("s")).groupBy("s")
        .agg(F.min("node").alias("node"), F.max("node").alias("other"))
        .where("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    )
    sizes = sets.groupBy("node").agg(F.min(F.size("shingles")).alias("least"), F.max(F.size("shingles")).alias("n"), F.count(F.lit(1)).alias("sets"))
    # a document given by several rows keeps the loosest bound of them
    known = sizes.join(alone, "node", "left").select(
        "node", F.col("least").cast("bigint").alias("n"),
        (F.col("n") - F.when(F.col("sets") == 1, F.coalesce("alone", F.lit(0))).otherwise(0)).alias("shared"),
    )
    known = known.where(F.col("shared") * 100 >= F.col("n") * percent)
    members = freeze(met.join(known, "node"), "possible-members")
    discard(met, candidates)

    core = members.groupBy("bucket").agg(F.max_by(F.struct("node", "n", "shared"), F.struct(F.col("shared") / F.col("n"), -F.col("node"))).alias("c"))
    core = core.select("bucket", "c.node", "c.n", "c.shared")
    near = members.alias("m").join(core.alias("c"), F.expr("m.bucket = c.bucket and m.node <> c.node") & _reach("m", "c", percent))
    first = near.select(F.least("m.node", "c.node").alias("a"), F.greatest("m.node", "c.node").alias("b")).distinct()
    links = freeze(_verified(first, sets, percent), "first-links")
    labels = freeze_alone(lambda: components(links), "first-components")

    marked = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    main = core.join(labels, "node", "left").select("bucket", F.coalesce("component", "node").alias("main"))
    marked = freeze(marked.join(main, "bucket").select("main", "node", "component", "n").distinct(), "around-components")
    sizes = marked.groupBy("main").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"), F.count_if(F.expr("component <> main")).alias("apart")
    ).where("apart > 0")
    lots = F.ceil(F.greatest(F.col("nodes") / _BLOCK_NODES, F.col("shingles") / _BLOCK_SHINGLES)).cast("int")
    marked = marked.join(sizes.select("main", lots.alias("lots")), "main").withColumn("lot", F.pmod(F.xxhash64("node"), "lots"))
    more = _across(marked.join(sets, "node"), percent)
    given_twice = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    labels = components(links.unionByName(more).unionByName(given_twice))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return placed.join(labels, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
