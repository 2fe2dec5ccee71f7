"""How often each pair of items occurs together, and how far that exceeds chance.

Method: heavy–light decomposition. An item is *heavy* if it makes up at least ``1 / HEAVY`` of all
incidences, so there are at most ``HEAVY`` heavy items whatever the data. Heavy pairs are counted by popcounts
of the ANDed rows of a bit matrix (items × baskets) and leave a task as one number per pair. Pairs of a light and
a heavy item are counted by probing: each light item's list of baskets sums the baskets' rows of heavy bits. Light
pairs are hash-counted with map-side combination, large baskets in blocks. The three parts are united and scored by
lift.

Items that can be in no result are dropped before pairs are made, without loss: one in fewer baskets than
``least_together``, and (since c <= min(a, b)) one in more than ``n / min_lift`` of the n baskets.

Defined results: each basket counts an item once; null, blank and empty names are left out; baskets without
items still count in n; baskets without an id are left out; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convograph.functions.text import node_name
from convograph.session import cut, parallelism
from convograph.sources.exports import newest, table

HEAVY = 1024


def _heavy_counter(n_heavy: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((n_heavy, n_heavy), np.int64)
        for pdf in batches:
            members = [np.asarray(x, np.int64) for x in pdf.heavy]
            rows = np.repeat(np.arange(len(members)), [len(m) for m in members])
            bits = np.zeros((n_heavy, -(-len(members) // 64) * 64), bool)
            if len(rows):
                bits[np.concatenate(members), rows] = True
            packed = np.packbits(bits, axis=1).view(np.uint64)
            for i in range(n_heavy - 1):
                counts[i, i + 1 :] += np.bitwise_count(packed[i] & packed[i + 1 :]).sum(axis=1, dtype=np.int64)
        i, j = np.nonzero(counts)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "c": counts[i, j]})

    return run


def _list_prober(n_heavy: int):
    """Counts of light items with heavy ones: each light item's list of baskets probes the baskets' rows of the bit matrix."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for light, heavy in batches:
            rows = np.zeros((len(heavy), n_heavy), bool)
            for row, members in zip(rows, heavy):
                row[np.asarray(members, np.int64)] = True
            basket = np.repeat(np.arange(len(light)), [len(x) for x in light])
            codes, items = pd.factorize(np.concatenate([np.asarray(x, object) for x in light])) if len(basket) else (np.empty(0, int), np.empty(0, object))
            order = np.argsort(codes, kind="stable")
            ends = np.searchsorted(codes[order], np.arange(len(items) + 1))
            out = []
            for k, item in enumerate(items):
                counts = rows[basket[order[ends[k] : ends[k + 1]]]].sum(axis=0)
                out += [(item, int(j), int(counts[j])) for j in np.flatnonzero(counts)]
            yield pd.DataFrame(out, columns=["x", "j", "c"])

    return run


#: light items of a basket that are paired in one row; larger baskets are cut into blocks of this size
BLOCK = 128


def light_pairs(lists: DataFrame, block: int = BLOCK) -> DataFrame:
    """``x, y`` (x < y) of each pair inside the sorted lists ``lv``.

    A basket larger than a block becomes a row per pair of its blocks, and those rows are spread over all tasks.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("lv") - 1) / block).cast("int")), lambda k: F.slice("lv", k * block + 1, F.lit(block)))
    one = lists.where((F.size("lv") >= 2) & (F.size("lv") <= block)).select(F.col("lv").alias("left"), F.col("lv").alias("right"), F.lit(True).alias("same"))
    large = lists.where(F.size("lv") > block).select(blocks.alias("bs")).select(F.posexplode("bs").alias("i", "left"), "bs")
    large = large.select("left", "i", F.posexplode("bs").alias("j", "right")).where("j >= i").select("left", "right", (F.col("i") == F.col("j")).alias("same"))
    both = one.unionByName(large.repartition(parallelism(lists.sparkSession)))
    first = both.select(F.posexplode("left").alias("p", "x"), "right", "same")
    return first.select("x", F.explode(F.when(F.col("same"), F.slice("right", F.col("p") + 2, F.lit(block))).otherwise(F.col("right"))).alias("y"))


def pair_counts(baskets: DataFrame, least_together: int = 3, min_lift: float = 4.0, heavy_share: int = HEAVY) -> DataFrame:
    """``node_a, node_b, c, a, b, n, lift`` of the pairs with c >= ``least_together`` and lift >= ``min_lift``.

    ``baskets``: ``id, items`` with one row per basket.
    """
    spark = baskets.sparkSession
    known = baskets.where(F.col("id").isNotNull()).select("id", F.array_distinct(F.filter(F.coalesce("items", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))).alias("items"))
    known = cut(known)
    counts = cut(known.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("k")))
    n = known.count()
    total = counts.agg(F.sum("k")).first()[0] or 0
    able = counts.where((F.col("k") >= least_together) & (F.col("k") * F.lit(min_lift) <= F.lit(n)))
    heavy_names = sorted(r[0] for r in able.where(F.col("k") * heavy_share >= total).select("item").limit(heavy_share).collect())  # at most heavy_share of them exist
    heavy = spark.createDataFrame([(i, x) for i, x in enumerate(heavy_names)], "ix int, item string")
    names = F.array(*[F.lit(x) for x in heavy_names]) if heavy_names else F.array().cast("array<string>")
    with_heavy = known.select("id", "items", F.array_intersect("items", names).alias("hv"))

    position = {x: i for i, x in enumerate(heavy_names)}

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"heavy": [[position[x] for x in v] for v in pdf.hv]})

    counter = _heavy_counter(len(heavy_names))
    both_heavy = (
        with_heavy.where(F.size("hv") >= 2).select("hv")
        .mapInPandas(lambda it: counter(numbered(it)), "i int, j int, c long")
        .groupBy("i", "j").agg(F.sum("c").alias("c"))
        .join(F.broadcast(heavy.select(F.col("ix").alias("i"), F.col("item").alias("x"))), "i")
        .join(F.broadcast(heavy.select(F.col("ix").alias("j"), F.col("item").alias("y"))), "j")
        .select("x", "y", "c")
    )
    light_items = able.join(F.broadcast(heavy.select("item")), "item", "left_anti").select("item")
    light = with_heavy.select("id", F.explode(F.array_except("items", "hv")).alias("item")).join(light_items, "item")
    lists = light.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("lv"))
    joined = lists.join(with_heavy.select("id", "hv"), "id")
    probe = _list_prober(len(heavy_names))
    mixed = (
        joined.where(F.size("hv") > 0).select("lv", "hv")
        .mapInPandas(lambda it: probe((pdf.lv, next(numbered(iter([pdf]))).heavy) for pdf in it), "x string, j int, c long")
        .groupBy("x", "j").agg(F.sum("c").alias("c"))
        .join(F.broadcast(heavy.select(F.col("ix").alias("j"), F.col("item").alias("y"))), "j")
        .select("x", "y", "c")
    )
    rare = light_pairs(lists).groupBy("x", "y").agg(F.count("*").alias("c"))
    pairs = both_heavy.unionByName(mixed).unionByName(rare).where(F.col("c") >= least_together)
    pairs = pairs.select(F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b"), "c")
    one, two = counts.select(F.col("item").alias("node_a"), F.col("k").alias("a")), counts.select(F.col("item").alias("node_b"), F.col("k").alias("b"))
    scored = pairs.join(one, "node_a").join(two, "node_b").withColumn("n", F.lit(n).cast("long"))
    scored = scored.withColumn("lift", F.col("c") * F.col("n") / (F.col("a") * F.col("b")))
    return scored.where(F.col("c") * F.col("n") >= F.lit(min_lift) * F.col("a") * F.col("b")).select("node_a", "node_b", "c", "a", "b", "n", "lift")


def chunk_baskets(chunks: DataFrame) -> DataFrame:
    """``id, items``: the normalised links of each chunk id's last row (highest batch, then row)."""
    rows = chunks.where(F.col("id").isNotNull()).select("id", F.coalesce("batch_id", F.lit(-1)).alias("batch_id"), F.coalesce("row_id", F.lit(-1)).alias("row_id"), "links")
    last = newest(rows, ["id"], ["batch_id", "row_id"])
    return last.select("id", F.transform("links", lambda x: node_name(x)).alias("items"))


def link_pairs(spark: SparkSession, where: str) -> DataFrame:
    return pair_counts(chunk_baskets(table(spark, where, "chunks")))


def accumulated_graph(edges: DataFrame) -> DataFrame:
    """``node_a, node_b, weight, n_docs, contexts`` of the undirected graph over all documents.

    Ends are normalised and ordered; self-edges and empty names are left out; repeated rows of a document
    count once; null weights add nothing; contexts are the sorted distinct ones, joined by a comma.
    """
    ends = edges.select("doc_path", node_name(F.col("source")).alias("x"), node_name(F.col("target")).alias("y"), "weight", F.array_join(F.array_sort(F.array_distinct("contexts")), ",").alias("ctx"))
    ends = ends.where((F.col("x") != "") & (F.col("y") != "") & (F.col("x") != F.col("y")))
    rows = ends.select("doc_path", F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b"), "weight", "ctx").distinct()
    return rows.groupBy("node_a", "node_b").agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"),
        F.count_distinct("doc_path").alias("n_docs"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("ctx", ","))))), ",").alias("contexts"),
    )
