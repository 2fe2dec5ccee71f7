from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from convograph.llm.conversations import counting, kept_conversations, rebuild_text
from convograph.sources.exports import chatgpt_messages, claude_messages

SCHEMA = "tab string, conv_id string, rec_id string, speaker string, utc_us long"


def brute(rows):
    by = defaultdict(list)
    for tab, conv, rec, who, at in rows:
        by[tab, conv].append((at, rec, who))
    out = set()
    for (tab, conv), ms in by.items():
        if any(m[0] is None for m in ms):
            continue
        ms.sort()
        if all(m[2] == ("user", "assistant")[i % 2] for i, m in enumerate(ms)) and len(ms) % 2 == 0:
            out |= {(tab, conv, i, m[1], m[2]) for i, m in enumerate(ms, 1)}
    return out


def test_against_brute_force(spark):
    rows = []
    for c in range(40):
        for k in range(c % 7 + 1):
            who = ("user", "assistant")[k % 2] if (c + k) % 11 else "user"
            rows.append(("t", f"c{c}", f"m{c}-{k}", who, None if c == 8 and k == 1 else 1000 * (k + 1) + c))
    # one conversation holds most rows, so it spans partitions; equal instants are ordered by id
    rows += [("t", "hot", f"h{k:04}", ("user", "assistant")[k % 2], k // 2) for k in range(400)]
    rows += [("u", "hot", f"x{k:04}", ("user", "assistant")[k % 2], k) for k in range(301)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("pos", F.lit("clash"))
    got = {tuple(r) for r in kept_conversations(df).collect()}
    assert got == brute(rows) and any(r[1] == "hot" for r in got)


def test_empty(spark):
    assert kept_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dirty_rows(spark):
    node = "struct<message:struct<create_time:double,author:struct<role:string>,content:struct<content_type:string,parts:array<string>>>>"
    gpt = spark.createDataFrame(
        [
            (1, 0, "c", 5, {"a": {"message": {"create_time": 1.0, "author": {"role": "user"}, "content": {"content_type": "text", "parts": ["old"]}}}}, "x"),
            (2, 1, "c", 5, {"a": {"message": {"create_time": 1.0, "author": {"role": "user"}, "content": {"content_type": "text", "parts": ["new", None, " ", "b"]}}}}, "x"),
            (3, 1, None, None, {"b": None, "d": {"message": None}}, "x"),
            (4, 1, "c", 5, None, "x"),
            (5, 1, "c", 5, {"e": {"message": {"create_time": None, "author": None, "content": None}}}, "x"),
        ],
        f"row_id long, export_id int, conv_id string, account_id long, mapping map<string,{node}>, text string",
    )
    rows = chatgpt_messages(gpt)
    one = counting(rows)
    assert [(r.rec_id, r.row_id) for r in one.collect()] == [("a", 2)]
    kept = one.select("tab", "conv_id", F.lit(1).alias("msg_ord"), F.col("rec_id").alias("msg_id"), "speaker", "row_id")
    assert [(r.msg_id, r.text) for r in rebuild_text(kept, rows).collect()] == [("a", "new\n\nb")]
    claude = spark.createDataFrame([(1, 0, "k", 5, [{"msg_id": "m", "sender": "bot", "created_at": "", "content": [{"type": "thinking", "text": None, "thinking": "t"}]}, None]), (2, 0, "k", 5, None), (3, 0, "k", 5, [])],
        "row_id long, export_id int, conv_id string, account_id long, chat_messages array<struct<msg_id:string,sender:string,created_at:string,content:array<struct<type:string,text:string,thinking:string>>>>")
    assert [(r.speaker, r.text) for r in claude_messages(claude).collect()] == [("assistant", "")]
