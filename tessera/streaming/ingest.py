"""Streaming ingestion: the batch operators inside foreachBatch. A batch's number is its commit key, so a batch that Spark
repeats after a failure is stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store, add_lines


def add_stream(lines: DataFrame, store: Store, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True) -> StreamingQuery:
    """S01 as a stream: raw JSON lines (value) -> the store. Order within a batch is that of the field arrival if the lines
    have one, else of the text; there is no watermark, as late messages are simply appended."""

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        arrival = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$.arrival", "long"), F.lit(0))
        _, bad = add_lines(store, batch.select("value", arrival.alias("arrival")), number + 1, embed)
        bad.drop("arrival").write.mode("overwrite").parquet(f"{store.path}/errors/batch={number + 1}")

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def event_stream(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Any micro-batch function over a stream, run until its input is used up."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backfill_all(store: Store, embed: Callable[[DataFrame], DataFrame], first_batch: int, limit: int | None = None) -> int:
    """Rounds of Store.backfill until one stores nothing; the number of vectors stored. The first batch must be higher than
    those of the vectors stored so far."""
    total = 0
    while True:
        n = store.backfill(embed, first_batch, limit)
        if not n:
            return total
        total += n
        first_batch += 1
