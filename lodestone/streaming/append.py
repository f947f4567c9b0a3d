"""Incremental indexing: every micro-batch of passages becomes a segment of the index.

A segment is written under its batch number and replaces an earlier try of the same batch, so a restarted stream leaves no
duplicates. Document counts and average length are taken over all segments when a query comes, hence scores are those of one
index over all passages. Numbers of passages must be unique over the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import index
from lodestone.plans.search import SearchEngine


def append_batch(passages: DataFrame, path: str, batch: int) -> None:
    """Write the postings and document table of ``passages`` as segment ``batch``; the batch is read once and kept meanwhile."""
    kept = passages.persist()
    try:
        index.write_sorted(index.postings(kept), f"{path}/postings/segment={batch}")
        index.doc_table(kept).write.mode("overwrite").parquet(f"{path}/doc_table/segment={batch}")
    finally:
        kept.unpersist()


def start(passages: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Index a stream ``(doc_id, passage_id, text)``; with ``once``, what is there now, then stop."""
    writer = passages.writeStream.foreachBatch(lambda df, n: append_batch(df, path, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def open_segments(spark: SparkSession, path: str, **kw) -> SearchEngine:
    """A search engine over all segments."""
    return SearchEngine(spark.read.parquet(f"{path}/postings").drop("segment"), spark.read.parquet(f"{path}/doc_table").drop("segment"), **kw)
