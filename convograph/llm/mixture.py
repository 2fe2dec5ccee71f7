"""A mixture of sources in which each has its target share of the tokens.

Method. Every document gets a hash-random key. Documents are range-sorted by (source, key), so that a large
source spreads over many partitions; prefix sums of token counts come from the sums of the runs before plus
the sum inside the run. Each source is cut at its exact budget: whole epochs first, then the prefix of the
random order that ends nearest to what is left.

The size of the mixture is the largest at which every source with documents can reach its share within its
``max_repeats``; a smaller size can be asked for. Sources of ``targets`` without documents can't be reached;
their share is spread over the others in proportion and the report says so.

Defined results: source names are compared trimmed and in lower case; documents of other sources or without
tokens (null or empty texts) are never taken; no document is taken more often than ``max_repeats``; repeated
target rows of a source count once (the largest share); empty tables give an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convograph.functions.text import py_strip
from convograph.llm.encode import token_counts
from convograph.session import cut, parallelism
from convograph.sources.exports import table


def _plain(x):
    return F.lower(py_strip(x))


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: ``source, target_share, max_repeats, have, share, budget`` (tokens)."""
    goal = (
        targets.groupBy(_plain(F.col("source")).alias("source"))
        .agg(F.max("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
        .where((F.col("target_share") > 0) & F.col("source").isNotNull() & (F.col("max_repeats") >= 1))
    )
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("have"))
    goal = goal.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    every = Window.partitionBy()  # one row per target source
    goal = goal.withColumn("share", F.when(F.col("have") > 0, F.col("target_share") / F.sum(F.when(F.col("have") > 0, F.col("target_share"))).over(every)))
    most = F.min(F.when(F.col("have") > 0, F.col("have") * F.col("max_repeats") / F.col("share"))).over(every)
    size = F.least(most, F.lit(float(total_tokens))) if total_tokens is not None else most
    return goal.withColumn("budget", F.coalesce(F.floor(F.col("share") * size + 1e-6), F.lit(0)))


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, source, n_tokens, times`` of the taken documents, report per target source)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", _plain(F.col("source")).alias("source"))
    named = targets.select(_plain(F.col("source")).alias("source")).distinct()
    wanted = rows.join(named, "source", "left_semi").where(F.col("text") != "")
    sized = token_counts(wanted.select("doc_id", "source", "text"), tokenizer).where(F.col("n_tokens") > 0)
    sized = cut(sized.drop("text").withColumn("key", F.xxhash64(F.lit(seed), "doc_id")))  # before the range sampler, which would tokenise twice
    order = ["key", "doc_id"]
    spread = cut(sized.repartitionByRange(parallelism(docs.sparkSession), "source", *order).withColumn("run", F.spark_partition_id()))
    budget = plan(spread, targets, total_tokens)
    run = Window.partitionBy("source", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("source", "run").agg(F.sum("n_tokens").alias("s")).withColumn("offset", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    placed = spread.withColumn("inside", F.sum("n_tokens").over(run)).join(offsets, ["source", "run"])
    placed = placed.withColumn("end", F.col("offset") + F.col("inside")).join(budget.where("budget > 0"), "source")
    epochs = F.floor(F.col("budget") / F.col("have"))
    rest = F.col("budget") - epochs * F.col("have")
    middle = F.col("end") - F.col("n_tokens") / 2  # nearest to the cut: taken if more than half of it lies inside
    times = F.least(epochs + F.when(middle < rest, 1).otherwise(0), F.col("max_repeats"))
    taken = placed.withColumn("times", times.cast("long")).where(F.col("times") > 0).select("doc_id", "source", "n_tokens", "times")
    taken = cut(taken)
    got = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count("*").alias("docs"), F.max("times").alias("most_repeats"))
    report = budget.join(got, "source", "left").select(
        "source", "target_share", F.col("have").alias("tokens_available"), "budget", F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
        F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), F.lit(0.0)).alias("actual_share"),
        (F.col("have") == 0).alias("no_documents"),
    )
    return taken, report


def document_mixture(spark: SparkSession, where: str) -> DataFrame:
    return mixture(table(spark, where, "documents"), table(spark, where, "mix_targets"))[0]


def mixture_report(spark: SparkSession, where: str) -> DataFrame:
    return mixture(table(spark, where, "documents"), table(spark, where, "mix_targets"))[1]
