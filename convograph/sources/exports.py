"""Chat exports as flat rows: one row per message, item or line, whatever the platform.

Columns of a *message row*: ``tab, conv_id, rec_id, export_id, row_id, account_id, speaker, is_text, text,
t_num`` (Unix time as a double) and ``t_text`` (textual time). Conversions stay in the JVM.

Defined results: a null mapping, message list, node, message or block contributes nothing; a blank text is
``''``; lines that aren't valid JSON give no row; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convograph.functions.instants import text_instant, unix_instant
from convograph.functions.text import py_strip

CHATGPT, CLAUDE, GEMINI, SESSIONS = "chatgpt_export", "claude_export", "gemini_activity", "session_lines"


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{where}/{name}.parquet")


def _joined(parts: Column) -> Column:
    """Non-blank pieces joined by an empty line, stripped."""
    kept = F.filter(parts, lambda p: p.isNotNull() & p.rlike(r"(?U)\S"))
    return F.coalesce(py_strip(F.array_join(kept, "\n\n")), F.lit(""))


def chatgpt_messages(raw: DataFrame) -> DataFrame:
    """Nodes of ``mapping`` that hold a message; ``is_text`` for content type text."""
    node = raw.select("conv_id", "export_id", "row_id", "account_id", F.explode("mapping").alias("rec_id", "node"))
    m = F.col("node.message")
    return node.where(m.isNotNull()).select(
        F.lit(CHATGPT).alias("tab"), "conv_id", "rec_id", "export_id", "row_id", "account_id",
        m["author"]["role"].alias("speaker"), (F.coalesce(m["content"]["content_type"], F.lit("")) == "text").alias("is_text"),
        _joined(m["content"]["parts"]).alias("text"), m["create_time"].cast("double").alias("t_num"), F.lit(None).cast("string").alias("t_text"),
    )


def claude_messages(raw: DataFrame) -> DataFrame:
    """Entries of ``chat_messages``; the text is their blocks of type text; ``human`` → user, others → assistant."""
    msg = raw.select("conv_id", "export_id", "row_id", "account_id", F.explode("chat_messages").alias("m"))
    blocks = F.filter(F.col("m.content"), lambda b: b["type"] == "text")
    return msg.where(F.col("m").isNotNull()).select(
        F.lit(CLAUDE).alias("tab"), "conv_id", F.col("m.msg_id").alias("rec_id"), "export_id", "row_id", "account_id",
        F.when(F.col("m.sender") == "human", "user").otherwise("assistant").alias("speaker"), F.lit(True).alias("is_text"),
        _joined(F.transform(blocks, lambda b: b["text"])).alias("text"), F.lit(None).cast("double").alias("t_num"), F.col("m.created_at").alias("t_text"),
    )


def session_rows(raw: DataFrame) -> DataFrame:
    """Valid JSON lines: ``line_id, account_id, path, line_no, kind, t_text, text``; every path and type."""
    v = raw.select("line_id", "account_id", "path", "line_no", F.try_parse_json("line").alias("v")).where(F.col("v").isNotNull())
    get = lambda c, path, kind: F.try_variant_get(c, path, kind)
    content = get(F.col("v"), "$.message.content", "variant")
    blocks = F.filter(get(F.col("v"), "$.message.content", "array<variant>"), lambda b: get(b, "$.type", "string") == "text")
    text = F.when(F.schema_of_variant(content) == "STRING", py_strip(get(F.col("v"), "$.message.content", "string"))).otherwise(
        _joined(F.transform(blocks, lambda b: get(b, "$.text", "string")))
    )
    return v.select(
        "line_id", "account_id", "path", "line_no", get(F.col("v"), "$.type", "string").alias("kind"),
        get(F.col("v"), "$.timestamp", "string").alias("t_text"), F.coalesce(text, F.lit("")).alias("text"),
    )


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the highest ``order`` values, as one hash-partitioned aggregation.

    The order columns must separate rows of different content; a tie between equal rows is harmless.
    """
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*key, *[F.col("_b")[c].alias(c) for c in rest])


def chat_rows(spark: SparkSession, where: str) -> DataFrame:
    """Message rows of both chat tables, of all deliveries."""
    return chatgpt_messages(table(spark, where, CHATGPT)).unionByName(claude_messages(table(spark, where, CLAUDE)))


def chat_messages(spark: SparkSession, where: str) -> DataFrame:
    """The counting row (highest ``export_id``, then ``row_id``) of each message id of both chat tables."""
    return newest(chat_rows(spark, where).where(F.col("rec_id").isNotNull()), ["tab", "rec_id"], ["export_id", "row_id"])


def account_zones(spark: SparkSession, where: str) -> DataFrame:
    """One row per account: its zone and date order (a fixed table of a few hundred rows)."""
    return table(spark, where, "account_zones").groupBy("account_id").agg(F.min("zone").alias("zone"), F.min("date_order").alias("date_order"))


def with_instants(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds ``utc_us``: the instant of ``t_num`` or ``t_text`` (read in the account's zone where it names none)."""
    at = rows.join(zones.withColumnRenamed("account_id", "_acct"), F.col("account_id").eqNullSafe(F.col("_acct")), "left")
    return at.withColumn(
        "utc_us", F.coalesce(unix_instant(F.col("t_num")), text_instant(F.col("t_text"), F.col("zone"), F.col("date_order")))
    ).drop("_acct", "zone", "date_order")


def instants(spark: SparkSession, where: str) -> DataFrame:
    """``tab, rec_id, utc_us`` of every record of the four exports with a determinable instant.

    Records are conversations and messages of the chat tables, activity items and session lines. Where a
    conversation or message has several rows, the one with the highest ``export_id`` counts.
    """
    no_num, no_text = F.lit(None).cast("double").alias("t_num"), F.lit(None).cast("string").alias("t_text")
    convs = (
        table(spark, where, CHATGPT)
        .select(F.lit(CHATGPT).alias("tab"), F.col("conv_id").alias("rec_id"), "export_id", "row_id", "account_id", F.col("create_time").alias("t_num"), no_text)
        .unionByName(
            table(spark, where, CLAUDE).select(
                F.lit(CLAUDE).alias("tab"), F.col("conv_id").alias("rec_id"), "export_id", "row_id", "account_id", no_num, F.col("created_at").alias("t_text")
            )
        )
    )
    slim = ["tab", "rec_id", "export_id", "row_id", "account_id", "t_num", "t_text"]
    msgs = chatgpt_messages(table(spark, where, CHATGPT)).select(slim).unionByName(claude_messages(table(spark, where, CLAUDE)).select(slim))
    both = convs.withColumn("what", F.lit("conv")).unionByName(msgs.withColumn("what", F.lit("msg")))
    chats = newest(both.where(F.col("rec_id").isNotNull()), ["tab", "what", "rec_id"], ["export_id", "row_id"])
    items = table(spark, where, GEMINI).select(F.lit(GEMINI).alias("tab"), F.col("item_id").cast("string").alias("rec_id"), "account_id", no_num, F.col("time").alias("t_text"))
    lines = session_rows(table(spark, where, SESSIONS)).select(
        F.lit(SESSIONS).alias("tab"), F.col("line_id").cast("string").alias("rec_id"), "account_id", no_num, "t_text"
    )
    cols = ["tab", "rec_id", "account_id", "t_num", "t_text"]
    single = items.unionByName(lines).where(F.col("rec_id").isNotNull()).dropDuplicates()
    found = with_instants(chats.select(cols).unionByName(single), account_zones(spark, where))
    return found.where(F.col("utc_us").isNotNull()).select("tab", "rec_id", "utc_us").distinct()
