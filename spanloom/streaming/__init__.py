"""New documents as they come: the batch build run on each micro-batch.

The build works document by document and keeps no state between documents, so a stream needs no watermark and no
window: each micro-batch of complete documents is built and appended by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import external
from ..plans.build import Build, build
from ..plans.config import Config


def build_stream(docs: DataFrame, sink: Callable[[Build, int], None], config: Config = Config(), provider: external.Provider | None = None) -> DataStreamWriter:
    """A writer for a stream of docs (doc_id, text, words); sink gets each batch's Build and number, and must be safe to repeat."""

    def each(batch: DataFrame, number: int) -> None:
        made = build(batch.select("doc_id", "text"), batch.select("doc_id", "words"), config, provider)
        try:
            sink(made, number)
        finally:
            made.spans.unpersist()
            made.details.unpersist()

    return docs.writeStream.foreachBatch(each)
