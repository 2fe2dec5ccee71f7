"""Relations stated between linked nodes of one sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convograph import config
from convograph.functions.links import relation_links
from convograph.functions.text import py_strip, sentences


def relation_matches(docs: DataFrame, key: str = "doc_id", triggers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``key, sentence, source, relation, target``: one row per sentence, relation and pair of nodes.

    The direction is the order of first appearance in the sentence. A trigger counts anywhere in the lower-cased
    sentence, inside other words too. Empty nodes and pairs of one node are left out.
    """
    table = triggers or config.RELATION_TRIGGERS
    said = docs.where(F.col("text").contains("[[")).select(key, F.posexplode(sentences(F.col("text"))).alias("sentence", "s"))
    low = F.lower("s")
    stated = F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, phrases)), lambda t: F.contains(low, t)), F.lit(name)) for name, phrases in table.items()]))
    rich = said.where(F.col("s").contains("[[")).withColumn("nodes", F.transform(relation_links(F.col("s")), py_strip)).where(F.size("nodes") >= 2)
    rich = rich.withColumn("stated", stated).where(F.size("stated") > 0)
    nodes = F.col("nodes")
    ends = F.flatten(F.transform(nodes, lambda a, i: F.transform(F.slice(nodes, i + 2, F.greatest(F.size(nodes), F.lit(1))), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    pairs = rich.select(key, "sentence", "stated", F.inline(ends)).where((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
    return pairs.select(key, "sentence", "source", F.explode("stated").alias("relation"), "target")


def relations(docs: DataFrame, key: str = "doc_id", triggers: dict[str, tuple[str, ...]] | None = None, context: str = "conversation", passes: int = 1) -> DataFrame:
    """``source, relation, target, weight, contexts``: the number of matches, counted ``passes`` times."""
    found = relation_matches(docs, key, triggers)
    return found.groupBy("source", "relation", "target").agg((F.count("*") * passes).alias("weight")).withColumn("contexts", F.array(F.lit(context)))
