"""The whole way from export files to an answer."""

from __future__ import annotations

import json

from convograph.plans import pipeline


def test_build_and_answer(spark, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    text = "The robot arm uses the torque sensor. " + "Here are the robot arm, the torque sensor. " * 9
    gpt = [{"create_time": 1700000000.5, "title": "T", "mapping": {"a": {"message": {"create_time": 1700000001.0, "author": {"role": "user"}, "content": {"content_type": "text", "parts": [text]}}}}}]
    claude = [{"created_at": "2024-01-01T23:30:00-05:00", "name": "", "chat_messages": [{"sender": "human", "created_at": "2024-01-01T23:31:00Z", "content": [{"type": "text", "text": text, "thinking": None}]}]}]
    gemini = [{"time": "bad", "title": "Hi", "safeHtmlItem": [{"html": "<p>Good <em>day</em></p>"}]}]
    for place, body in (("chatgpt/conversations.json", gpt), ("claude/conversations.json", claude), (pipeline.PLACES["gemini"], gemini)):
        (data / place).parent.mkdir(parents=True)
        (data / place).write_text(json.dumps(body))
    session = data / "claude-code/projects/proj/ab-cd.jsonl"
    session.parent.mkdir(parents=True)
    session.write_text(json.dumps({"type": "user", "timestamp": "2024-05-05T00:00:00Z", "message": {"content": text}}) + "\n\nbroken")
    pipeline.build(spark, str(data), str(out), markdown=True)
    assert len(list((out / "vault").rglob("conversations/**/*.md"))) == 4 and (out / "vault/entities").exists() | (out / "vault/topics").exists()
    paths = {r.path for r in spark.read.parquet(f"{out}/documents").collect()}
    assert {p.split("/")[1] for p in paths} == {"chatgpt", "claude", "gemini", "claude-code"}
    assert any(p.startswith("conversations/claude/claude_2024-01-01_") for p in paths) and any("gemini_unknown-date_" in p for p in paths)
    edges = {(r.source, r.target) for r in spark.read.parquet(f"{out}/edges").collect()}
    assert ("robot_arm", "torque_sensor") in edges
    assert spark.read.parquet(f"{out}/relations").where("relation = 'USES'").count() > 0
    assert spark.read.parquet(f"{out}/mentions").count() >= 6
    got = pipeline.answer(spark, str(out), "torque sensor of the robot arm", 1).collect()
    assert sum(r.rank is not None for r in got) == 1 and len(got) >= 3


def test_models_plug_in(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    made = lambda cols, rows: lambda d, *a: spark.createDataFrame(rows, cols)
    find = pipeline.model_terms(
        made("doc_id long, pos long, surface string", [(1, 0, "robot arm")]),
        made("doc_id long, pos long, surface string, root_pos string", [(1, i, "robot arm", "NOUN") for i in range(6)] + [(1, i, "run fast", "VERB") for i in range(20)]),
        made("doc_id long, pos long, surface string, label string", [(1, 3, "Ada", "person"), (1, 4, "Tuesday", "date")]),
    )
    assert [(r.kind, r.display, r.node) for r in find(docs).orderBy(F.col("ord")).collect()] == [("topic", "Robot Arm", "robot_arm"), ("entity", "Ada", "ada")]
