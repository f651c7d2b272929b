"""Documents that arrive as a stream (beyond batch indexing): as segments of postings, one for each micro-batch, or into an
index, which keeps the documents too and merges its segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.analysis import Analyzer, standard
from quillspark.operators.handle import Index, Settings
from quillspark.operators.index import postings


def ingest(stream: DataFrame, path: str, checkpoint: str, analyzer: Analyzer = standard, **trigger) -> StreamingQuery:
    """Append the postings of every micro-batch as its own segment; a batch that is run again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = postings(batch.filter("doc_id IS NOT NULL"), analyzer)
        rows.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/segment_id={batch_id}")

    return stream.select("doc_id", F.col("text")).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_index(stream: DataFrame, path: str, checkpoint: str, settings: Settings = Settings(), **trigger) -> StreamingQuery:
    """Add every micro-batch of ``stream(doc_id, text)`` to the index at ``path``, which is made if it is not there; the manifest
    names the last batch, so one that is run again is not added twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        opened = Index.open(spark, path) if Index.exists(spark, path) else Index.create(spark, path, settings)
        opened.add_batch(batch.select("doc_id", "text"), batch_id)

    return stream.select("doc_id", F.col("text")).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
