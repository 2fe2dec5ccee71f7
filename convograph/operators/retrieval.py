"""Inverted index, chunk stores and graph-augmented retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convograph import config
from convograph.operators.cooccur import expand, first_neighbors
from convograph.operators.runs import numbered


def postings(chunks: DataFrame) -> DataFrame:
    """``entity, id``: one row per chunk and distinct link, the distributed form of the inverted index."""
    return chunks.where(F.col("id").isNotNull()).select("id", F.explode("links").alias("entity")).where(F.col("entity").isNotNull()).distinct().select("entity", "id")


def inverted_index(chunks: DataFrame) -> DataFrame:
    """``entity, n_chunks, first_id, last_id`` per entity; :func:`entity_index` gives the lists themselves."""
    return postings(chunks).groupBy("entity").agg(F.count("*").alias("n_chunks"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def entity_index(chunks: DataFrame) -> DataFrame:
    """``entity, ord, id``: each entity's chunks in the order of their ids, numbered from 1.

    The list of an entity that a third of all chunks hold stays in rows and spreads over partitions.
    """
    return numbered(postings(chunks), ["entity"], ["id"])


def get(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; an error where there are none."""
    found = rows.where(F.col(key) == F.lit(value))
    if found.isEmpty():
        raise KeyError(value)
    return found


def result_lines(found: DataFrame, text: str = "text", width: int = 80) -> DataFrame:
    """``query, rank, id, line``: a report line per retrieved chunk: rank (``+`` for related ones), id and how its text begins."""
    begin = F.substring(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "), 1, width)
    return found.select("query", "rank", "id", F.concat_ws(" ", F.coalesce(F.concat(F.col("rank").cast("string"), F.lit(".")), F.lit("+")), "id", begin).alias("line"))


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the one with the highest ``order`` values."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lookup(index: DataFrame, entities: DataFrame) -> DataFrame:
    """``…, id`` of the chunks that hold any of the entities (``…, node``), distinct."""
    keep = [c for c in entities.columns if c != "node"]
    return index.join(entities.withColumnRenamed("node", "entity"), "entity").select(*keep, "id").distinct()


def merge_hits(hits: DataFrame, related: DataFrame) -> DataFrame:
    """``query, id, rank``: hits with their rank, then the other related chunks with NULL rank; each chunk once."""
    both = hits.select("query", "id", "rank").unionByName(related.select("query", "id", F.lit(None).cast("int").alias("rank")))
    return both.groupBy("query", "id").agg(F.min("rank").alias("rank"))


def retrieve(hits: DataFrame, chunks: DataFrame, graph: DataFrame, most: int = config.MAX_NEIGHBORS) -> DataFrame:
    """``query, id, rank``: vector hits, and all chunks that share a link with them or with a neighbour of one.

    ``hits``: ``query, id, rank`` (ids that no chunk has are dropped); ``chunks``: ``id, links`` with one row per
    id; ``graph``: ``source, target, weight``, or adjacency ``node, neighbor, ord`` as stored. Links are matched
    as written, nodes are lower case.
    """
    known = chunks.select("id", "links")
    found = hits.join(known, "id")
    seeds = found.select("query", F.explode("links").alias("node")).distinct()
    near = graph.where(F.col("ord") <= most) if "ord" in graph.columns else first_neighbors(graph, most)
    reached = expand(seeds, near)
    return merge_hits(found, lookup(postings(known), reached))
