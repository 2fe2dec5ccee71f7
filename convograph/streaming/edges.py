"""Co-occurrence edges kept up to date from a stream of documents.

Weights and context sets merge by addition and union, so each micro-batch appends its partial edges under its
own batch number (a repeated batch overwrites itself) and readers add the parts up. No state, no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convograph.operators.cooccur import cooccurrence_edges


def accumulate(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Starts a query that appends the partial edges of each micro-batch of ``key, text`` to ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        cooccurrence_edges(batch, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The edges of everything accumulated so far."""
    parts = spark.read.parquet(path)
    return parts.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts"))
