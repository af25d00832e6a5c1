"""Benchmark items inside documents: size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import small_enough
from tidemark.sources.scratch import freeze, spread


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _at(k: int, i: Column) -> list[Column]:
    return [F.get("w", i + j) for j in range(k)]


def _positions(k: int) -> Column:
    return F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k))


def _probes(k: int, shingle: int, ceiling: int) -> Column:
    """The hashes of runs of ``k`` words up to the ceiling, with ``k``.

    Nulls stand for words up to the shingle length, as in the items' hashes.
    """
    nothing = [F.lit(None).cast("string")] * (shingle - k)
    hashes = F.transform(_positions(k), lambda i: F.xxhash64(*_at(k, i), *nothing))
    low = F.filter(hashes, lambda h: h <= ceiling)
    kept = F.transform(low, lambda h: F.struct(F.lit(k).alias("k"), h.alias("h")))
    return F.coalesce(kept, F.array().cast("array<struct<k:int,h:bigint>>"))


def shingle_texts(k: int) -> Column:
    """The distinct runs of ``k`` words of column ``w`` as text."""
    return F.array_distinct(F.transform(_positions(k), lambda i: F.concat_ws(" ", *_at(k, i))))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    shingle: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per leaked item and document: ``doc_id, item_id, n_shingles, n_found``.

    An item leaks where at least ``percent`` hundredths of its distinct word
    shingles occur in the document.  An item with fewer words than a shingle is
    one shingle of its own length.

    The sketch of an item is the smallest of its shingle hashes.  A document with
    enough of the item's shingles can lack only some of them, so items are
    partitioned by size, and each size class takes as many minima as its largest
    possible item needs for one of them to be in every such document: the search
    misses nothing, in documents of any length.  No minimum of a class is above
    the class's ceiling, so a document's hashes above the highest ceiling are
    dropped before they leave the array.  Documents with a hit are then compared
    with the items on the shingles themselves.

    Sketches are broadcast when they are few, else joined by hash.  Only candidate
    documents are read a second time, and no group of copies is ever collected.

    Defined cases: items without words match nothing; items with equal ids and equal
    words are one, those with equal ids and other words are items of their own, with a
    row each; null texts have no words; a null document id or item id gives no row; documents with
    equal ids count as one; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[doc_text].cast("string").alias("text")).where("doc_id is not null")
    asked = items.select(items[item_id].cast("bigint").alias("item_id"), words(items[item_text].cast("string")).alias("w"))
    asked = asked.where("item_id is not null and size(w) > 0").withColumn("k", F.least(F.lit(shingle), F.size("w"))).distinct()
    # an item is an id with a text: texts of one id are looked for each by itself
    asked = freeze(asked.withColumn("item", F.monotonically_increasing_id()), "asked-items")
    per_length = F.coalesce(*[F.when(F.col("k") == k, shingle_texts(k)) for k in range(1, shingle + 1)])
    wanted = freeze(
        asked.select("item", "k", F.explode(per_length).alias("s")).distinct(), "item-shingles"
    )
    sizes = wanted.groupBy("item").agg(F.count(F.lit(1)).alias("n_shingles"))

    # sketches: how many minima a size class [2^c, 2^(c+1)) needs
    largest = F.expr("shiftleft(2L, cast(floor(log2(n_shingles)) as int)) - 1")
    needed = F.least("n_shingles", largest - F.ceil(largest * percent / 100) + 1)
    hashed = wanted.withColumn("h", F.expr("xxhash64(" + ", ".join(f"try_element_at(split(s, ' '), {j + 1})" for j in range(shingle)) + ")"))
    by_item = hashed.groupBy("item", "k").agg(F.sort_array(F.collect_list("h")).alias("hs")).join(sizes, "item")
    minima = by_item.select("item", "k", F.explode(F.slice("hs", 1, needed.cast("int"))).alias("h"))
    minima = freeze(minima, "item-minima")
    ceilings = {r["k"]: r["top"] for r in minima.groupBy("k").agg(F.max("h").alias("top")).collect()}
    if not ceilings:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_found long")

    probes = [_probes(k, shingle, top) for k, top in sorted(ceilings.items())]
    cut = spread(rows).select("doc_id", words(F.col("text")).alias("w"))
    seen = cut.select("doc_id", F.explode(F.concat(*probes)).alias("p")).select("doc_id", "p.k", "p.h")
    hint = F.broadcast if small_enough(minima) else (lambda df: df)
    found = freeze(seen.join(hint(minima), ["k", "h"]).select("doc_id", "item").distinct(), "leak-candidates")

    # exact containment on the shingles of candidate documents
    suspects = freeze(found.select("doc_id").distinct(), "leak-suspects")
    hint = F.broadcast if small_enough(suspects) else (lambda df: df)
    again = rows.join(hint(suspects), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    runs = [shingle_texts(k) for k in sorted(ceilings)]
    runs = [F.coalesce(r, F.array().cast("array<string>")) for r in runs]
    hint = F.broadcast if small_enough(wanted) else (lambda df: df)
    own = again.select("doc_id", F.explode(F.array_distinct(F.concat(*runs))).alias("s"))
    hits = own.join(hint(wanted), "s").select("doc_id", "item", "s").distinct()
    counted = hits.groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("n_found"))
    full = counted.join(found, ["doc_id", "item"], "left_semi").join(sizes, "item")
    leaked = full.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent).join(asked.select("item", "item_id"), "item")
    return leaked.select("doc_id", "item_id", "n_shingles", "n_found")
