"""First-come-first-kept removal over similar texts, exact and in parallel.

The rule is sequential: going through the texts in row order, a text still
present is kept and removes every later text similar to it.  Two facts make it
parallel without changing the outcome:

* Texts are settled in batches of growing size, in row order.  What a batch
  keeps first removes its matches from everything that follows, so a large
  cluster of near copies is absorbed by its first text in one linear pass and
  its internal pairs are never formed.
* Inside a batch a text is kept once no earlier undecided neighbour is left and
  removed once an earlier neighbour is kept.  Each round lets every task settle
  a contiguous stretch of the order as far as its inputs are known, so a chain
  costs one round per task it crosses, not one per link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio_sorted
from ..sources.scratch import freeze
from .pairs import Matcher, Scheme, candidate_load

# Texts per batch: the first, and the least a crowded one is cut down to, so that
# a cluster of near copies meets its leaders early.
FIRST_BATCH = 16_384
LEAST_BATCH = 2_048
GROWTH = 8
SHRINK = 4
EDGES_PER_TASK = 1_000_000

_ASSIGNED = "id bigint, leader bigint, score double"


def settle_stretch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sequential rule over edges sorted by ``b, a``, leaving unknowns open."""
    fate: dict[int, bool | None] = {}
    first = current = None
    hit = unsure = False
    for batch in batches:
        for a, b, undecided in zip(batch["a"], batch["b"], batch["a_open"]):
            if b != current:
                if current is not None:
                    fate[current] = False if hit else (None if unsure else True)
                first = b if first is None else first
                current, hit, unsure = b, False, False
            if not undecided:
                hit = True
            elif a >= first:
                hit, unsure = hit or fate[a] is True, unsure or fate[a] is None
            else:
                unsure = True
    if current is not None:
        fate[current] = False if hit else (None if unsure else True)
    settled = [(node, kept) for node, kept in fate.items() if kept is not None]
    yield pd.DataFrame(settled, columns=["id", "kept"]).astype({"id": "int64", "kept": "bool"})


def settle(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """Ids removed by the sequential rule over frozen ``a < b`` edges."""
    open_edges, removed = edges.select("a", "b"), []
    while (n := open_edges.count()) > 0:
        waiting = open_edges.select(F.col("b").alias("a")).distinct().withColumn("a_open", F.lit(True))
        flagged = open_edges.join(waiting, "a", "left").select(
            "a", "b", F.coalesce("a_open", F.lit(False)).alias("a_open")
        )
        stretches = flagged.repartitionByRange(math.ceil(n / edges_per_task), "b").sortWithinPartitions("b", "a")
        fate = freeze(stretches.mapInPandas(settle_stretch, "id bigint, kept boolean"), "fate")
        gone = fate.where("not kept").select("id")
        removed.append(gone)
        still = open_edges.join(fate.select(F.col("id").alias("b")), "b", "left_anti").join(
            gone.select(F.col("id").alias("a")), "a", "left_anti"
        )
        open_edges = freeze(still.select("a", "b"), "open-edges")
    if not removed:
        return edges.select(F.col("a").alias("id")).where(F.lit(False))
    return reduce(DataFrame.unionByName, removed)


def _earliest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("b").alias("id")).agg(
        F.min("a").alias("leader"), F.min_by("score", "a").alias("score")
    )


def _next_batch(remaining: DataFrame, n: int, size: int, scheme: Scheme) -> tuple[DataFrame, DataFrame | None, int]:
    """The earliest texts, about ``size`` of them and fewer if they are crowded.

    Crowded means more candidates per text than unrelated texts would make.
    """
    while True:
        if n <= size * 2:
            batch, rest, size = remaining, None, n
        else:
            cut = remaining.agg(F.percentile_approx("id", size / n, 100_000).alias("cut")).first()["cut"]
            batch, rest = remaining.where(F.col("id") <= cut), remaining.where(F.col("id") > cut)
        if size <= LEAST_BATCH * 2 or scheme.loss == 0:
            return batch, rest, size
        if candidate_load(batch, scheme) <= (2_000 + size // 10_000) * size:
            return batch, rest, size
        size = max(LEAST_BATCH, size // SHRINK)


def greedy_leaders(texts: DataFrame, matcher: Matcher, first_batch: int = FIRST_BATCH) -> DataFrame:
    """``id, leader, score`` for every removed text of frozen ``id, text``.

    ``leader`` is the earliest kept text it is similar to.
    """
    if matcher.threshold == 0 and matcher.similarity is None:  # everything matches the first text
        head = texts.orderBy("id").first()
        if head is None:
            return texts.sparkSession.createDataFrame([], _ASSIGNED)
        score = ratio_sorted(F.lit(head["text"]), F.col("text"))
        return texts.where(F.col("id") != head["id"]).select("id", F.lit(head["id"]).alias("leader"), score.alias("score"))

    scheme, size, assigned = matcher.scheme, first_batch, []
    remaining: DataFrame | None = texts.select("id", "text")
    while remaining is not None and (n := remaining.count()) > 0:
        batch, rest, size = _next_batch(remaining, n, size, scheme)
        edges = freeze(matcher.pairs(batch), "edges")
        gone = settle(edges)
        from_kept = edges.join(gone.select(F.col("id").alias("a")), "a", "left_anti")
        assigned.append(_earliest(from_kept))
        remaining = None
        if rest is not None:
            leaders = freeze(batch.join(gone, "id", "left_anti"), "kept")
            absorbed = freeze(_earliest(matcher.between(leaders, rest)), "absorbed")
            assigned.append(absorbed)
            remaining = freeze(rest.join(absorbed.select("id"), "id", "left_anti"), "remaining")
        size *= GROWTH
    if not assigned:
        return texts.sparkSession.createDataFrame([], _ASSIGNED)
    return freeze(reduce(DataFrame.unionByName, assigned), "leaders")
