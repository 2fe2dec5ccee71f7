"""Units of text, node pairs, the weighted co-occurrence graph and its adjacency lists.

Everything is a narrow projection up to the pair rows; the one shuffle of the graph is the aggregation by
pair, with partial sums on the map side, so hub nodes don't skew it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convograph import config
from convograph.functions.links import edge_links
from convograph.functions.text import paragraphs, sentences


def text_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, context, unit, text``: paragraphs and sentences of each document, in one pass over the text."""
    tagged = lambda pieces, name: F.transform(pieces, lambda x, i: F.struct(F.lit(name).alias("context"), i.alias("unit"), x.alias("text")))
    both = F.concat(tagged(paragraphs(F.col(text)), "paragraph"), tagged(sentences(F.col(text)), "sentence"))
    return docs.select(key, F.inline(both))


def pairs_of(nodes: Column) -> Column:
    """All pairs of an array, each once, smaller name first."""
    ordered = F.array_sort(nodes)
    return F.flatten(F.transform(ordered, lambda a, i: F.transform(F.slice(ordered, i + 2, F.greatest(F.size(ordered), F.lit(1))), lambda b: F.struct(a.alias("source"), b.alias("target")))))


def context_weight(context: Column) -> Column:
    out = F
    for name, weight in config.CONTEXT_WEIGHTS.items():
        out = out.when(context == name, weight)
    return out.otherwise(config.OTHER_WEIGHT)


def weighted_pairs(units: DataFrame) -> DataFrame:
    """``…, source, target, context, weight`` of every pair of distinct nodes inside a unit."""
    linked = units.where(F.col("text").contains("[[")).withColumn("nodes", edge_links(F.col("text"))).where(F.size("nodes") >= 2)
    keep = [c for c in units.columns if c != "text"]
    return linked.select(*keep, F.inline(pairs_of(F.col("nodes")))).withColumn("weight", context_weight(F.col("context")).cast("long"))


def edges(pairs: DataFrame, passes: int = 1) -> DataFrame:
    """``source, target, weight, contexts`` (sorted). ``passes=2`` gives the weights of a corpus accumulated twice."""
    return pairs.groupBy("source", "target").agg((F.sum("weight") * passes).alias("weight"), F.array_sort(F.collect_set("context")).alias("contexts"))


def cooccurrence_edges(docs: DataFrame, key: str = "doc_id", passes: int = 1) -> DataFrame:
    return edges(weighted_pairs(text_units(docs, key)), passes)


def both_directions(graph: DataFrame) -> DataFrame:
    """``node, neighbor, weight``: each undirected edge seen from either end."""
    ends = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("neighbor")), F.struct(F.col("target").alias("node"), F.col("source").alias("neighbor")))
    return graph.select(F.inline(ends), "weight")


def adjacency(graph: DataFrame, order: str = "weight") -> DataFrame:
    """``node, neighbor, ord, weight``: neighbours numbered from 1, heaviest first (ties by name) or by name."""
    by = [F.col("weight").desc(), F.col("neighbor")] if order == "weight" else [F.col("neighbor")]
    return both_directions(graph).withColumn("ord", F.row_number().over(Window.partitionBy("node").orderBy(*by))).select("node", "neighbor", "ord", "weight")


def first_neighbors(graph: DataFrame, most: int = config.MAX_NEIGHBORS, order: str = "weight") -> DataFrame:
    """The first ``most`` neighbours of each node; the filter becomes a group limit before the shuffle."""
    return adjacency(graph, order).where(F.col("ord") <= most)


def expand(seeds: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Seeds (``…, node``) united with their neighbours, distinct."""
    keep = [c for c in seeds.columns if c != "node"]
    near = seeds.join(neighbors.select("node", "neighbor"), "node").select(*keep, F.col("neighbor").alias("node"))
    return seeds.unionByName(near).distinct()
