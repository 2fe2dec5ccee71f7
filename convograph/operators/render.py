"""Raw exports → Markdown documents: one per account and day for chats, one per session part for coding sessions.

Rows carry ready pieces of text and an order; the one aggregation per document sorts and joins them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convograph import config
from convograph.functions.html import html_to_markdown
from convograph.functions.text import py_strip, short_hash
from convograph.operators.chunking import part_numbers

UNKNOWN_DATE = "unknown-date"
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
_PIECE = "struct<o1:string,o2:double,o3:bigint,o4:string,o5:double,o6:bigint,text:string,body:string>"


def iso_date(x: Column) -> Column:
    """Date of an ISO time as written (its own offset), else ``unknown-date``."""
    day = F.substring(x, 1, 10)
    return F.when(x.rlike(_ISO) & F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull(), day).otherwise(UNKNOWN_DATE)


def epoch_date(x: Column) -> Column:
    """UTC date of Unix seconds; NULL, zero and times past the year 9999 → ``unknown-date``."""
    ok = x.isNotNull() & (x != 0) & (x > -62135596800.0) & (x < 253402300800.0)
    return F.when(ok, F.date_format(F.timestamp_seconds(F.when(ok, x)), "yyyy-MM-dd")).otherwise(UNKNOWN_DATE)


def epoch_iso(x: Column) -> Column:
    """UTC ISO time of Unix seconds to the microsecond, without the fraction where it is 0; ``''`` where there is none."""
    ok = x.isNotNull() & (x > -62135596800.0) & (x < 253402300800.0)
    at = F.timestamp_seconds(F.when(ok, x))
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    return F.when(~ok | x.isNull(), "").when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def message_block(role: Column, text: Column, stamp: Column) -> Column:
    """The lines of one message."""
    head = F.when(role == "user", "\n## Prompt\n").otherwise("\n## Response\n")
    return F.concat_ws("\n", head, text, F.lit("\n### Timestamp\n"), F.coalesce(stamp, F.lit("")))


def conversation_head(title: Column) -> Column:
    return F.concat_ws("\n", F.lit("\n---\n"), F.concat(F.lit("# "), title, F.lit("\n")))


def _pieces(rows: DataFrame) -> DataFrame:
    return rows.select("account_id", "date", F.struct("o1", "o2", "o3", "o4", "o5", "o6", "text", "body").cast(_PIECE).alias("p"))


def chatgpt_pieces(raw: DataFrame) -> DataFrame:
    """Pieces of ChatGPT conversations: a head per row, then its user and assistant messages in time order."""
    base = raw.select("account_id", epoch_date(F.col("create_time")).alias("date"), F.lit("").alias("o1"), F.coalesce("create_time", F.lit(0.0)).alias("o2"), F.col("row_id").cast("long").alias("o3"), "title", "mapping")
    none = F.lit(None).cast("string")
    heads = base.select("account_id", "date", "o1", "o2", "o3", F.lit("0").alias("o4"), F.lit(0.0).alias("o5"), F.lit(-1).cast("long").alias("o6"), conversation_head(F.coalesce("title", F.lit("untitled"))).alias("text"), none.alias("body"))
    node = base.select("account_id", "date", "o1", "o2", "o3", F.posexplode(F.map_values("mapping")).alias("o6", "node"))
    m = F.col("node.message")
    kept = F.filter(m["content"]["parts"], lambda p: p.isNotNull() & p.rlike(r"(?U)\S"))
    body = F.when(m["content"]["content_type"] == "text", py_strip(F.array_join(kept, "\n\n")))
    msgs = node.where(m["create_time"].isNotNull() & m["author"]["role"].isin("user", "assistant")).withColumn("body", body).where(F.col("body") != "")
    msgs = msgs.select("account_id", "date", "o1", "o2", "o3", F.lit("1").alias("o4"), m["create_time"].alias("o5"), F.col("o6").cast("long").alias("o6"), message_block(m["author"]["role"], F.col("body"), epoch_iso(m["create_time"])).alias("text"), "body")
    return _pieces(heads.unionByName(msgs))


def claude_text(content: Column) -> Column:
    """Text blocks as they are, thinking blocks as a quoted callout, others dropped, joined by an empty line, stripped."""
    shown = F.transform(content, lambda c: F.when((c["type"] == "text") & c["text"].rlike(r"(?U)\S"), c["text"]).when((c["type"] == "thinking") & c["thinking"].rlike(r"(?U)\S"), F.concat(F.lit("\n> Claude Thinking\n>\n> "), c["thinking"], F.lit("\n"))))
    return F.coalesce(py_strip(F.array_join(F.array_compact(shown), "\n\n")), F.lit(""))


def claude_pieces(raw: DataFrame) -> DataFrame:
    """Pieces of Claude conversations: ordered by their ``created_at`` text, messages likewise."""
    created = F.coalesce("created_at", F.lit(""))
    base = raw.select("account_id", iso_date(F.col("created_at")).alias("date"), created.alias("o1"), F.lit(0.0).alias("o2"), F.col("row_id").cast("long").alias("o3"), "name", "chat_messages")
    title = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("untitled"))
    heads = base.select("account_id", "date", "o1", "o2", "o3", F.lit("").alias("o4"), F.lit(0.0).alias("o5"), F.lit(-1).cast("long").alias("o6"), conversation_head(title).alias("text"), F.lit(None).cast("string").alias("body"))
    one = base.select("account_id", "date", "o1", "o2", "o3", F.posexplode("chat_messages").alias("o6", "m")).where(F.col("m").isNotNull()).withColumn("body", claude_text(F.col("m.content"))).where(F.col("body") != "")
    stamp = F.coalesce(F.col("m.created_at"), F.lit(""))
    role = F.when(F.col("m.sender") == "human", "user").otherwise("assistant")
    msgs = one.select("account_id", "date", "o1", "o2", "o3", stamp.alias("o4"), F.lit(1.0).alias("o5"), F.col("o6").cast("long").alias("o6"), message_block(role, F.col("body"), stamp).alias("text"), "body")
    return _pieces(heads.unionByName(msgs))


def gemini_pieces(raw: DataFrame) -> DataFrame:
    """Pieces of activity items: prompt, time, answer as Markdown."""
    item = raw.select("account_id", "item_id", "time", "title", F.posexplode_outer("safe_html_item").alias("i", "h"))
    shown = item.withColumn("md", html_to_markdown(F.coalesce(F.col("h.html"), F.lit(""))))
    whole = shown.groupBy("account_id", "item_id", "time", "title").agg(F.transform(F.array_sort(F.collect_set(F.when(F.col("i").isNotNull(), F.struct("i", "md")))), lambda x: x["md"]).alias("mds"))
    answer, title = F.array_join("mds", "\n\n"), F.coalesce("title", F.lit("untitled"))
    time = F.coalesce("time", F.lit(""))
    text = F.concat_ws("\n", F.lit("\n---\n"), F.lit("## Prompt\n"), F.concat(title, F.lit("\n")), F.lit("\n### Timestamp\n"), F.concat(time, F.lit("\n")), F.lit("\n## Response\n"), answer)
    return _pieces(whole.select("account_id", iso_date(F.col("time")).alias("date"), time.alias("o1"), F.lit(0.0).alias("o2"), F.col("item_id").cast("long").alias("o3"), F.lit("").alias("o4"), F.lit(0.0).alias("o5"), F.lit(0).cast("long").alias("o6"), text.alias("text"), F.concat(title, answer).alias("body")))


def day_documents(pieces: DataFrame, platform: str, label: str) -> DataFrame:
    """``account_id, date, hash, path, text``: the day's pieces under front matter and heading, named by their hash."""
    packed = pieces.groupBy("account_id", "date").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    body = F.array_join(F.transform("ps", lambda p: p["body"]), "")  # NULL bodies (heads) are skipped
    named = packed.select("account_id", "date", short_hash(body).alias("hash"), "ps")
    head = F.concat_ws("\n", F.lit("---"), F.lit(f"platform: {platform}"), F.concat(F.lit("date: "), "date"), F.concat(F.lit("hash: "), "hash"), F.lit("---\n"), F.concat(F.lit(f"# {label} Export - "), "date", F.lit("\n")))
    text = F.concat_ws("\n", head, F.array_join(F.transform("ps", lambda p: p["text"]), "\n"))
    path = F.concat(F.lit(f"conversations/{platform}/{platform}_"), "date", F.lit("_"), "hash", F.lit(".md"))
    return named.select("account_id", "date", "hash", path.alias("path"), text.alias("text"))


def outside_subagents(path: Column) -> Column:
    return ~F.array_contains(F.split(path, "/"), "subagents")


def session_messages(lines: DataFrame) -> DataFrame:
    """``path, line_no, role, text, stamp`` of user and assistant lines with text, outside ``subagents`` folders; repeated lines once."""
    some = lines.where(F.col("kind").isin("user", "assistant") & (F.col("text") != "") & outside_subagents(F.col("path")))
    return some.select("path", "line_no", F.col("kind").alias("role"), "text", F.coalesce("t_text", F.lit("")).alias("stamp")).distinct()


def session_parts(messages: DataFrame, most: int = config.MAX_FILE_CHARS) -> DataFrame:
    """``messages`` with ``part`` and ``parts``: lines of a session packed greedily to at most ``most`` characters."""
    lens = messages.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", F.length("text").alias("n"), F.xxhash64("role", "text", "stamp").alias("h")))).alias("l"))
    numbered = lens.select("path", "l", part_numbers(F.transform("l", lambda x: x["n"].cast("long")), most).alias("ps"))
    flat = numbered.select("path", F.inline(F.transform("l", lambda x, i: F.struct(x["line_no"].alias("line_no"), x["h"].alias("h"), F.element_at("ps", i + 1).alias("part"), F.element_at("ps", -1).alias("parts")))))
    return messages.withColumn("h", F.xxhash64("role", "text", "stamp")).join(flat, ["path", "line_no", "h"]).drop("h")


def session_documents(messages: DataFrame, most: int = config.MAX_FILE_CHARS) -> DataFrame:
    """``path, part, parts, date, project, session, name, text`` of each session part."""
    first = messages.groupBy("path").agg(F.min_by("stamp", "line_no").alias("stamp"))
    parts = session_parts(messages, most).withColumn("block", message_block(F.col("role"), F.col("text"), F.col("stamp")))
    packed = parts.groupBy("path", "part", "parts").agg(F.array_sort(F.collect_list(F.struct("line_no", "block"))).alias("bs"))
    steps = F.split("path", "/")
    meta = packed.join(first, "path").select("path", "part", "parts", iso_date(F.col("stamp")).alias("date"), F.element_at(steps, -2).alias("project"), F.regexp_replace(F.element_at(steps, -1), r"\.[^.]*$", "").alias("session"), "bs")
    many = F.col("parts") > 1
    head = F.concat_ws(
        "\n", F.lit("---"), F.lit("platform: claude-code"), F.concat(F.lit("date: "), "date"), F.concat(F.lit("project: "), "project"), F.concat(F.lit("session: "), "session"),
        F.when(many, F.concat(F.lit("part: "), "part", F.lit("/"), "parts")), F.lit("---\n"),
        F.concat(F.lit("# "), "project", F.lit(" ("), "session", F.lit(")"), F.when(many, F.concat(F.lit(" — part "), "part")).otherwise(""), F.lit("\n")),
    )
    name = F.concat(F.lit("claudecode_"), "date", F.lit("_"), F.split_part("session", F.lit("-"), F.lit(1)), F.when(many, F.concat(F.lit("_"), "part")).otherwise(""), F.lit(".md"))
    return meta.select("path", "part", "parts", "date", "project", "session", name.alias("name"), F.concat_ws("\n", head, F.array_join(F.transform("bs", lambda b: b["block"]), "\n")).alias("text"))
