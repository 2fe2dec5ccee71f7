"""Conversations rebuilt from message rows and validated by a finite-state automaton.

Method. Messages are range-partitioned and sorted by (table, conversation, instant, message id): a secondary
sort in which even one huge conversation spreads over several partitions. A *run* is the part of a
conversation inside one partition. Each run is summarised by the automaton's behaviour on it, runs are
composed in order (a handful per conversation), and the verdict goes back to the rows of each run.

Automaton over speakers, start state ``S``::

    S --user--> Q      Q --assistant--> A      A --user--> Q      every other step --> dead

A conversation is kept if it ends in ``A`` and every message has an instant. Because the only accepted words
alternate, a run acts on the state as: dead if it breaks inside, else determined by its first and last
speaker, which is what the summary holds.

Defined results: rows without a conversation id, with a null message, of other speakers or content types, or
without a letter or digit count nowhere; a conversation with no counting message is absent; equal instants
are ordered by message id; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convograph.functions.text import has_word
from convograph.operators.runs import in_runs
from convograph.sources.exports import newest

USER, ASSISTANT = "user", "assistant"


def counting(rows: DataFrame) -> DataFrame:
    """The counting row of each message that can belong to a conversation: by user or assistant, of type text, not empty.

    ``rows``: message rows of any delivery. Only slim columns are moved; ``row_id`` leads back to the text.
    """
    slim = ["tab", "conv_id", "rec_id", "export_id", "row_id", "speaker", "account_id", "t_num", "t_text"]
    told = rows.where(F.col("rec_id").isNotNull()).select(*slim, (F.col("is_text") & has_word(F.col("text"))).alias("says"))
    messages = newest(told, ["tab", "rec_id"], ["export_id", "row_id"])
    return messages.where(F.col("conv_id").isNotNull() & F.col("speaker").isin(USER, ASSISTANT) & F.col("says"))


def kept_conversations(timed: DataFrame) -> DataFrame:
    """``tab, conv_id, msg_ord, msg_id, speaker`` of the kept conversations, with ``row_id`` where ``timed`` has it.

    ``timed``: ``tab, conv_id, rec_id, speaker, utc_us`` of the counting messages; NULL ``utc_us`` has no instant.
    """
    row = [c for c in timed.columns if c == "row_id"]
    runs = in_runs(timed.select("tab", "conv_id", "utc_us", "rec_id", "speaker", *row), ["tab", "conv_id"], ["utc_us", "rec_id"])
    key = ["tab", "conv_id"]
    clash = F.coalesce(F.col("before.speaker") == F.col("speaker"), F.lit(False)) | F.col("utc_us").isNull()
    summary = runs.groupBy(*key, "run").agg(
        F.count("*").alias("n"),
        F.max(clash).alias("dead"),
        F.min_by("speaker", "pos").alias("first"),
        F.max_by("speaker", "pos").alias("last"),
    )
    w = Window.partitionBy(*key).orderBy("run")
    whole = Window.partitionBy(*key)
    composed = (
        summary.withColumn("offset", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("state", F.coalesce(F.lag("last").over(w), F.lit(ASSISTANT)))  # S and A allow the same next step
        .withColumn("dead", F.max(F.col("dead") | (F.col("state") == F.col("first"))).over(whole))
        .withColumn("end", F.max_by("last", "run").over(whole))
        .where(~F.col("dead") & (F.col("end") == ASSISTANT))
        .select(*key, "run", "offset")
    )
    return (
        runs.join(composed, [*key, "run"])
        .select("tab", "conv_id", (F.col("offset") + F.col("pos")).cast("long").alias("msg_ord"), F.col("rec_id").alias("msg_id"), "speaker", *row)
    )


def rebuild_text(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """Kept messages with their text, from the row that counts; one row per message, so no conversation is ever held in one task.

    Where a row holds a message id twice, the larger text stays.
    """
    text = rows.select("tab", F.col("rec_id").alias("msg_id"), "row_id", "text")
    key = ["tab", "conv_id", "msg_ord", "msg_id", "speaker"]
    return kept.join(text, ["tab", "msg_id", "row_id"]).groupBy(*key).agg(F.max("text").alias("text"))
