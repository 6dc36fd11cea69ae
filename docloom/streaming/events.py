"""Event mapping over a stream of documents: stateless, as a document is one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from docloom.operators import events


def map_stream(documents: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, key: str = "doc_id", text: str = "text", frames: DataFrame | None = None, **trigger):
    """Every micro-batch of ``documents`` through ``events.map_text`` into ``write(events, batch_id)``.

    The carry-forward of codes is a window within a document, so batches need no state between them.
    ``checkpoint`` lies in the shared folder; ``trigger`` as in ``DataStreamWriter.trigger``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        write(events.map_text(rows, key, text, frames), number)

    stream = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()
