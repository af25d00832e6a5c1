"""The same steps on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import key_digest
from ..operators.base import LEDGERS, RowSegment, RowStep, col, column_types, user_columns
from ..operators.missing import MissingValues
from ..plans.cleaning import Cleaner
from ..sources.rowid import with_row_id


def clean_stream(stream: DataFrame, cleaner: Cleaner, path: str, key: str) -> DataStreamWriter:
    """Clean every micro-batch; rows go to ``data``, audit rows to their ledgers.

    Only steps that look at one row at a time are allowed, and ``key`` names the
    unique integer column that identifies a row.  Outputs carry the batch id and
    a replayed batch overwrites its own folder, so a retry leaves no copies.
    """
    for step in cleaner.steps:
        row_wise = isinstance(step, RowStep)
        if isinstance(step, MissingValues):
            row_wise = step.policy in ("keep", "fill", "drop_rows")
        if not row_wise:
            raise ValueError(f"{step.name} needs the whole table and cannot run on a stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # several outputs, one read of the source
        try:
            run = cleaner.run(batch, key=key)
            run.data.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
            for kind in LEDGERS:
                if run.ledgers.get(kind):
                    run.ledger(kind).write.mode("overwrite").parquet(f"{path}/{kind}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write)


def dedup_stream(stream: DataFrame, columns, time_column: str, delay: str) -> DataFrame:
    """First row per normalized key; state is dropped once the watermark passes it."""
    types = column_types(stream, columns or user_columns(stream))
    digest = key_digest([(col(c), t) for c, t in types.items()])
    keyed = stream.withColumn("_key", digest).withWatermark(time_column, delay)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def issue_rates(table: DataFrame, rules: list[RowStep], time_column: str, key: str, width: str = "1 hour",
                slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Issues per rule and time window, on a batch table or a stream.

    On a stream a window is final, and its state dropped, once events ``delay``
    past its end were seen; rows that come later than that are left out.
    """
    if table.isStreaming:
        table = table.withWatermark(time_column, delay)
    numbered = with_row_id(table, key)
    segment = RowSegment(list(enumerate(rules)))
    layered, _ = segment.layer(numbered)
    hits = F.array_compact(F.array(*[F.when(col(c.message).isNotNull(), F.lit(c.rule)) for c in segment.cells if c.message]))
    return (
        layered.select(F.col(time_column), F.explode(hits).alias("rule"))
        .groupBy(F.window(time_column, width, slide).alias("w"), "rule")
        .agg(F.count(F.lit(1)).alias("issues"))
        .select(F.col("w.start").alias("window_start"), "rule", "issues")
    )
