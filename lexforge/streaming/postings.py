"""Postings from a stream of record files.

The corpus grows by shards; each micro-batch is indexed on its own and written to a
folder of its number, so a batch that is run again replaces its own output and nothing
is counted twice. A record that comes again in a later batch replaces its earlier load
when the index is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexforge.operators.index import postings


def index_stream(records: DataFrame, key: str, fields: tuple[str, ...], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the postings of every record of ``records``, a streaming frame, under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        found = postings(batch, key, fields)
        # A record without tokens leaves a mark, so that it replaces its earlier load too.
        bare = batch.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")
        found.unionByName(bare, allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_index(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The postings of each record's last batch; an older load of it is left out.

    Which batch is a record's last is one aggregate over keys and batches, combined
    map-side; a record whose last load has no tokens left has no postings.
    """
    every = spark.read.parquet(path)
    last = every.groupBy(key).agg(F.max("batch").alias("batch"))
    return every.join(last, [key, "batch"], "left_semi").where("token is not null")
