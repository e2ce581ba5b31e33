"""A stream of queries: files of query lines in, hits out, through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .index import Index

LINES = "query_id string, text string"


def search_stream(index: Index, lines: str, out: str, checkpoint: str, top_k: int = 5, profile: str = "hybrid", files_per_batch: int = 1, available_now: bool = True) -> StreamingQuery:
    """Answers the JSON lines (query_id, text) of every file that comes into a folder; files come whole, by a move.

    A batch of files is one plan over the snapshot that is active when the batch starts: a build that is activated meanwhile
    serves from the next batch on. Hits lie below out in a folder for each batch, with the generation that gave them. A batch
    that is run again, after a failure, replaces its folder, so each query is answered once. Lines that are no JSON, or have
    no text, give no hits.
    """

    def answer(batch: DataFrame, number: int) -> None:
        asked = batch.filter("text is not null and query_id is not null").dropDuplicates(["query_id"])
        generation = index.store.current().name
        hits = index.search_many(asked, top_k, profile).withColumn("generation", F.lit(generation))
        hits.write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = index.spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_batch).json(lines)
    writer = source.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
