"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.tables import small_enough, texts
from tidemark.plans.skew import HEAVY_FLOOR, HEAVY_SHARE, attach_groups
from tidemark.sources.scratch import discard, freeze, spread

# A bucket with more fingerprints than this is not compared within itself; its members are joined by midpoints.
CROWD = 512
_VOTES = 65_536
_CELLS = 4_000_000
_POINTS = 1_000_000


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included, as a signed number.

    A-Z is lowered; words are what ASCII white space separates.  With fewer words
    than a shingle the whole sequence is the one shingle; without words all bits are 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    spans = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _VOTES):
        bits = np.unpackbits(hashes[at : at + _VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64())], names=["doc_id", "fp"])

    encoded = rows.select("doc_id", F.col("text").cast("binary").alias("text"))
    return encoded.mapInArrow(run, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def segments(distance: int) -> list[tuple[int, int]]:
    """The fewest segments of 64 bits of which one differs in at most one bit wherever ``distance`` bits differ."""
    count = distance // 2 + 1
    edges = [-(-64 * i // count) for i in range(count + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _variants(distance: int) -> Column:
    """One key per segment and wildcard bit: the segment without that bit, and which it is."""
    keys = []
    for low, high in segments(distance):
        whole = (1 << high) - (1 << low)
        for bit in range(low, high):
            kept = F.col("fp").bitwiseAND(F.lit(_signed(whole & ~(1 << bit))))
            keys.append(F.xxhash64(F.lit(bit), kept))
    return F.array(*keys)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _within_buckets(buckets: DataFrame, distance: int) -> DataFrame:
    """Links that span the connected groups inside each bucket: every member and its group's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["fps"]
            at = lists.offsets.to_numpy()
            sizes = np.diff(at)
            values = lists.values.to_numpy()
            for n in np.unique(sizes):
                starts = at[:-1][sizes == n]
                step = max(1, _CELLS // int(n * n))
                for i in range(0, len(starts), step):
                    fps = values[starts[i : i + step, None] + np.arange(n)]
                    differ = (fps[:, :, None] ^ fps[:, None, :]).view(np.uint64)  # signed numbers would lose their sign
                    near = np.bitwise_count(differ) <= distance
                    label = np.broadcast_to(np.arange(n), fps.shape)
                    while True:
                        lower = np.where(near, label[:, None, :], n).min(axis=2)
                        if (lower == label).all():
                            break
                        label = lower
                    root = np.take_along_axis(fps, label, axis=1)
                    moved = label != np.arange(n)
                    if moved.any():
                        a, b = root[moved], fps[moved]
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def _by_midpoints(fps: DataFrame, distance: int) -> DataFrame:
    """All links among ``fps`` without comparing any two of them.

    Two fingerprints differ in at most ``distance`` bits if and only if some
    point lies within half the distance (rounded down) of one and the other half
    of the other.  Every fingerprint names the points around it; those at one
    point are linked with the smallest that is within the lower half.  ``fps`` is
    distinct, so no more of them name a point than the points one of them names.
    """
    inner, outer = distance // 2, distance - distance // 2
    masks = [_signed(sum(1 << b for b in bits)) for r in range(outer + 1) for bits in combinations(range(64), r)]
    flips = F.from_json(F.lit(str(masks)), "array<bigint>")
    # the planner takes the points for as few as the fingerprints: it must neither broadcast them in a join nor make them in one task
    tasks = fps.count() * len(masks) // _POINTS + 1
    points = fps.repartition(tasks, "fp").select("fp", F.explode(flips).alias("flip"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    center = F.min(F.when(_apart("fp", "point") <= inner, F.col("fp"))).over(Window.partitionBy("point"))
    return points.select(center.alias("a"), F.col("fp").alias("b")).where("a <> b").distinct()


def _links(fps: DataFrame, distance: int, crowd: int) -> DataFrame:
    """Links ``a, b`` whose connected groups are those of all pairs within the distance."""
    variants = fps.select("fp", F.explode(_variants(distance)).alias("key"))
    counts = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    counts = freeze(counts.where("n > 1"), "variant-counts")
    pairs = counts.where("n = 2").where(_apart("a", "b") <= distance).select("a", "b")

    # keys so frequent that one would be a task's whole work are too few to be more than a small broadcast
    cut = max(crowd, HEAVY_FLOOR, fps.count() * 64 // HEAVY_SHARE)
    heavy = F.broadcast(counts.where(F.col("n") > cut).select("key"))
    light = variants.join(heavy, "key", "left_anti")
    few = freeze(counts.where(F.col("n").between(3, crowd)).select("key"), "bucket-keys")
    hint = F.broadcast if small_enough(few) else (lambda df: df)
    buckets = light.join(hint(few), "key", "left_semi")
    buckets = buckets.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    links = pairs.unionByName(_within_buckets(buckets, distance))

    full = freeze(counts.where(F.col("n") > crowd).select("key"), "crowded-variants")
    if not full.isEmpty():
        hint = F.broadcast if small_enough(full) else (lambda df: df)
        crowded = freeze(variants.join(hint(full), "key", "left_semi").select("fp").distinct(), "crowded-fingerprints")
        links = links.unionByName(_by_midpoints(crowded, distance))
    links = freeze(links.distinct(), "fingerprint-links")
    discard(counts)
    return links


def near_fingerprints(
    docs: DataFrame,
    *,
    shingle: int = 4,
    distance: int = 4,
    crowd: int = CROWD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id, kept``.

    Documents whose fingerprints (``fp``, see ``fingerprint``) differ in at most
    ``distance`` bits (1 to 4) are linked; ``component_id`` is the smallest id of the
    connected group, and ``kept`` marks the document with that id.

    Equal fingerprints are one node first.  The 64 bits are cut into so few segments
    that one of them differs in at most one bit; each segment is indexed
    once per bit with that bit left out, and two segments at most one bit apart share a
    key.  So every fingerprint has 64 keys at every size of the table, and each link is found by
    an equality join and verified on all bits.  A bucket of up to ``crowd``
    members is compared by itself and yields at most one link per member.
    Members of larger buckets are never compared with one another: they are
    linked through shared points halfway between them (``_by_midpoints``), whose number
    grows with the fingerprints and not with their square.  Both ways are exact.

    Defined cases: null, empty and blank texts have fingerprint 0, linked like any
    other; rows with equal ids are linked as rows of their own; a null id never names a
    component unless all its ids are null, and is kept only then; an empty table gives
    an empty result; other columns are ignored.
    """
    if not 1 <= distance <= 4:
        raise ValueError("distance lies in 1..4")
    found = freeze(_fingerprints(spread(texts(docs, id_col, text_col)), shingle), "fingerprints")
    nodes = freeze(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprint-nodes")
    labels = components(_links(nodes.select("fp"), distance, crowd))
    placed = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    placed = freeze(placed, "fingerprint-groups")
    # one row per group of more than one node, so that no large group's nodes meet in one task
    heads = freeze(placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "group-heads")
    alone = heads.where("nodes = 1").select("component", "component_id")
    several = attach_groups(placed, heads.where("nodes > 1"), "component", "nodes").select("fp", "n", "component_id")
    single = placed.join(alone, "component").select("fp", "n", "component_id")
    classes = freeze(several.unionByName(single), "fingerprint-classes")
    whole = attach_groups(found, classes, "fp", "n")
    return whole.select("doc_id", "fp", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
