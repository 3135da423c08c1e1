"""Structured Streaming into a keyed table: every micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keyloom.plans.engine import Engine


def apply_batch(engine: Engine, table: str, batch: DataFrame, batch_id: int, order: str | None = None, deleted: str | None = None) -> None:
    """Commit the upserts and deletes of one micro-batch at once; a batch that was committed
    before a restart is left out. With ``order`` the change with the highest order decides,
    also against changes of other batches; a null order loses against every number."""
    engine.apply_changes(table, batch, batch_id, order=order, deleted=deleted)


def start_ingest(engine: Engine, table: str, stream: DataFrame, checkpoint: str, *, order: str | None = None, deleted: str | None = None, once: bool = False) -> StreamingQuery:
    """Start writing ``stream`` into ``table``. ``order`` decides between changes of one key,
    whatever batch they come in; ``deleted`` marks tombstones."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: apply_batch(engine, table, df, i, order, deleted))
    return (writer.trigger(availableNow=True) if once else writer).start()
