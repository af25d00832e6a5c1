"""Exact deduplication by content hash, with the bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import BROADCAST_ROWS, small_enough, texts
from tidemark.plans.skew import attach_groups
from tidemark.sources.scratch import freeze


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest: Callable[[Column], Column] = content_hash,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows whose texts are equal byte for byte form a group; the row with the
    smallest (``keep="min"``) or largest (``keep="max"``) id stays.

    Only ids and 16-byte hashes are grouped at first.  Texts travel only where a
    hash occurs twice: they are grouped by hash *and* bytes, combined before the
    shuffle, so a text that fills a third of the table leaves each task as one row.
    A hash shared by different texts is split by its bytes, whatever ``digest`` is.

    Defined cases: a null text counts as empty; an empty table gives an empty
    result; rows with a null id take part, and only a group of null ids alone
    has a null ``keep_id`` (its rows are kept); rows repeated with the same id are
    each returned, and all rows with the keeper's id are kept; other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    best = F.min if keep == "min" else F.max
    rows = texts(docs, id_col, text_col).withColumn("h", digest(F.col("text")))
    marked = rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))

    repeated = freeze(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated-hashes")
    few = small_enough(repeated, broadcast_rows)
    suspects = rows.join(F.broadcast(repeated), "h", "left_semi") if few else rows
    # here the bytes are compared: equal hash, different text gives two groups
    groups = suspects.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = freeze(
        groups.groupBy("h").agg(
            F.count(F.lit(1)).alias("texts"), best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        ),
        "hash-groups",
    )
    clean = by_hash.where("texts = 1").drop("texts")
    if few:
        found = marked.join(F.broadcast(clean), "h", "left")
    else:
        marked = freeze(marked, "hashed-ids")
        clashing = by_hash.where("texts > 1").select("h", F.lit(None).cast("bigint").alias("keep_id"), "group_size")
        found = attach_groups(marked, clean.unionByName(clashing), "h", "group_size")
    clash = by_hash.where("texts > 1").select("h")
    if not clash.isEmpty():
        apart = rows.join(clash, "h", "left_semi")
        own = apart.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        split = apart.withColumn("text_sha256", F.sha2("text", 256)).join(own, ["h", "text"]).drop("text")
        found = found.join(clash, "h", "left_anti").unionByName(split)
    keep_id = F.coalesce("keep_id", "doc_id")
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that ``exact_copies`` keeps, with all their columns."""
    decided = exact_copies(docs, id_col=id_col, **options).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(decided, docs[id_col].eqNullSafe(decided["_kept_id"]), "left_semi")
