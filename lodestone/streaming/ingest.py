"""A stream of segments into a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.functions.ports import EmbeddingProvider, EntityExtractor
from lodestone.operators.store import NodeStore
from lodestone.plans.engine import file_nodes


def stream_into(segments: DataFrame, store: NodeStore, kb: str, checkpoint: str, extractor: EntityExtractor, embedder: EmbeddingProvider | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch overwrites by id, so a batch that is replayed changes nothing.

    Neighbours are found within a batch: a batch must hold whole files, as a file source gives them.
    """

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(kb, file_nodes(batch, extractor, embedder))

    return segments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
