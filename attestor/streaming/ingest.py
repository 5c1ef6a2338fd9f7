"""Streams of new documents and of new records. An extension: batches go through the same plans as tables do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from attestor.operators import chunking
from attestor.plans import audit
from attestor.sources.store import ChunkStore


def ingest(pages: DataFrame, store: ChunkStore, checkpoint: str, corpus_id: str, embed=chunking.embed, model: tuple[str, str] = ("hash", "1")) -> StreamingQuery:
    """Chunks, embeds and upserts each batch of pages; a batch that is run again changes nothing."""
    from pyspark.sql import functions as F

    def batch(df: DataFrame, _: int) -> None:
        rows = embed(chunking.chunks(df, corpus_id)).withColumns({"model_name": F.lit(model[0]), "model_revision": F.lit(model[1]), "created_at": F.current_timestamp()})
        store.upsert(rows)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_stream(records: DataFrame, pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Audits each batch of records against a static table of pages."""

    def batch(df: DataFrame, epoch: int) -> None:
        audit.audit(df, pages).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
