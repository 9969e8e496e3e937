"""Upserts from a stream of batches: each micro-batch goes through the batch operator, into the parts that it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.parted import PartedTable


def upsert_stream(batches: DataFrame, table: PartedTable, update: Sequence[str], order: Sequence[str], checkpoint: str, told: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Starts a query that upserts every micro-batch into ``table``, which is made at the first batch if it isn't there.

    A batch reads and writes only parts that it has keys of. A repeated batch changes nothing. ``told`` gets the number and the
    tally of each batch.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()  # read for the parts it touches and for the upsert
        try:
            if not table.exists(batch.sparkSession):
                table.create(batch.select(*(c for c in batch.columns if c not in order)).limit(0))
            tally = table.upsert(batch, update, order)
        finally:
            batch.unpersist()
        if told:
            told(number, tally)

    return batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
