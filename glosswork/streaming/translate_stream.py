"""Translation of streams: each micro-batch is one batch translation against the current lookup."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from glosswork.operators.lookup import Lookup
from glosswork.operators.shared import scratch
from glosswork.operators.translator import Translator


def translate_stream(stream: DataFrame, table: Callable[[], DataFrame | Lookup], keys: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, translator: Translator | None = None):
    """Start a query that translates ``stream`` (keys, text, source_lang, target_lang) and hands results to ``sink``.

    ``table`` is called for every batch, so a changed phrase table is picked up; a store's lookup (``store.lookup``) is read as it
    lies, and a table's own ranking goes when its batch ends.  ``translator`` counts each batch as one lookup.
    """
    def batch(df: DataFrame, number: int) -> None:
        own = translator or Translator(None)
        own.table = table()
        with scratch(df.sparkSession), own.batch(f"batch-{number}-{time.time_ns()}") as seen:
            sink(own.translate(df, keys, seen), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
