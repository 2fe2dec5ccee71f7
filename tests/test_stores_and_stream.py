"""File readers, stores, idempotent appends, vectors, and the incremental edge count."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from convograph.operators import cooccur, pages, retrieval, terms, vectors
from convograph.sources import stores
from convograph.streaming import edges as stream


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"create_time": 1.5, "title": "t", "mapping": {"a": {"message": None}}}, {"title": None}]))
    rows = stores.read_export(spark, str(tmp_path / "c.json"), stores.CHATGPT_SCHEMA).collect()
    assert [(r.pos, r.title, r.create_time) for r in rows] == [(0, "t", 1.5), (1, None, None)]
    assert stores.read_export(spark, str(tmp_path / "no.json"), stores.GEMINI_SCHEMA).count() == 0
    for folder in ("p", "p/subagents"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.jsonl").write_text('{"a":1}\n\nbroken')
    got = stores.read_sessions(spark, str(tmp_path)).collect()
    assert [(r.line_no, r.line) for r in sorted(got, key=lambda r: r.line_no)] == [(1, '{"a":1}'), (2, ""), (3, "broken")]
    (tmp_path / "p" / "d.md").write_text("# x")
    assert [r.text for r in stores.read_markdown(spark, str(tmp_path)).collect()] == ["# x"]
    assert stores.read_markdown(spark, str(tmp_path / "none")).count() == 0


def test_roundtrip_and_errors(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x"]), ("b", None)], "id string, links array<string>")
    stores.save(df, str(tmp_path / "s"))
    assert sorted(stores.load(spark, str(tmp_path / "s")).collect()) == sorted(df.collect())
    with pytest.raises(ValueError, match="no chunks"):
        stores.require_rows(df.where("id = 'z'"), "chunks")


def test_retrieval_golden(spark):
    chunks = spark.createDataFrame([("c1", ["a"]), ("c2", ["b"]), ("c3", ["z"])], "id string, links array<string>")
    graph = spark.createDataFrame([("a", "b", 1)], "source string, target string, weight long")
    hits = spark.createDataFrame([(1, "c1", 1), (1, "gone", 2)], "query long, id string, rank int")
    assert {(r.id, r.rank) for r in retrieval.retrieve(hits, chunks, graph).collect()} == {("c1", 1), ("c2", None)}


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(60, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, v array<float>")
    got = {(x.query, x["rank"]): x.id for x in vectors.top_k(rows, rows.where("id % 20 = 0"), 5, block=7).collect()}
    s = np.round(v.astype(float) @ v.T.astype(float), 6)
    for q in (0, 20, 40):
        assert [got[q, k] for k in range(1, 6)] == sorted(range(60), key=lambda i: (-s[q, i], i))[:5]
    assert [x.id for x in vectors.search(rows, v[0].tolist(), 5).collect()] == sorted(range(60), key=lambda i: (-s[0, i], i))[:5]
    assert vectors.top_k(rows.where("false"), rows).count() == 0


def test_appends_are_idempotent(spark):
    found = spark.createDataFrame([(1, "entity", 1, "A", "a", "c/x/d1.md"), (2, "topic", 1, "A", "a", "c/x/d2.md")], "doc_id long, kind string, ord int, display string, node string, path string")
    there = pages.new_pages(found)
    assert pages.new_pages(found, there).count() == 0
    lines = pages.mentions(found, there)
    assert {(r.page_kind, r.line) for r in lines.collect()} == {("entity", "- [[conversations/x/d1]]"), ("entity", "- [[conversations/x/d2]]")}
    assert pages.mentions(found, there, lines).count() == 0


def test_terms(spark):
    docs = spark.createDataFrame([(1, "We use GPT-4 and GPT-4 daily. See numpy.linalg and `x.y`."), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.display, r.score) for r in terms.entity_scores(terms.regex_entities(docs).where("false"), terms.regex_entities(docs)).collect()}
    assert got == {(1, "GPT-4", 2)}
    v = docs.select(terms.hashed_embedding(F.col("text")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-5 and v[1].v is None and not any(v[2].v)


def test_stream_adds_up(spark, tmp_path):
    docs = [(1, "[[a]] and [[b]]."), (2, "[[a]] and [[c]]."), (3, "[[b]] [[a]].")]
    source, out = tmp_path / "in", tmp_path / "out"
    for i, d in enumerate(docs):
        spark.createDataFrame([d], "doc_id long, text string").coalesce(1).write.parquet(str(source / str(i)))
    query = stream.accumulate(spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source)), str(out), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    whole = cooccur.cooccurrence_edges(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(stream.current(spark, str(out)).collect()) == sorted(whole.collect())


def test_session_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f"line {i}\n" for i in range(5_000)))
    (tmp_path / "b.jsonl").write_text("one\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [(r.line_no, r.line) for r in stores.read_sessions(spark, str(tmp_path)).collect() if r.path.endswith("a.jsonl")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(got) == [(i + 1, f"line {i}") for i in range(5_000)]


def test_markdown_files(spark, tmp_path):
    docs = spark.createDataFrame([("c/a.md", "# é", 1), ("c/d/b.md", "x", 2), ("c/x.md", None, 3), (None, "t", 4)], "path string, text string, n_chars int")
    assert sorted(map(tuple, stores.save_markdown(docs, f"file://{tmp_path}/v").collect())) == [("c/a.md", 3), ("c/d/b.md", 1)]
    read = stores.read_markdown(spark, f"{tmp_path}/v").collect()
    assert [r.path.split("/v/")[1] for r in read] == ["c/a.md", "c/d/b.md"] and read[0].text == "# é"


def test_adjacency_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "a", 1)], "node string, neighbor string, ord int")
    stores.save_adjacency(rows, str(tmp_path / "adj"))
    assert sorted(map(tuple, stores.read_adjacency(spark, str(tmp_path / "adj")).collect())) == [("a", "b", 2), ("a", "c", 1), ("b", "a", 1)]
    (tmp_path / "one.json").write_text('{"a": ["c", "b"], "b": ["a"], "z": []}')
    assert sorted(map(tuple, stores.read_adjacency(spark, str(tmp_path / "one.json")).collect())) == [("a", "b", 2), ("a", "c", 1), ("b", "a", 1)]


def test_color_file(tmp_path):
    file = tmp_path / "graph.json"
    assert stores.upsert_color_file(f"file://{file}") is False and not file.exists()
    file.write_text('{"zoom": 2, "colorGroups": [{"query": "q", "extra": 1, "color": {"a": 0, "rgb": 5}}]}')
    assert stores.upsert_color_file(f"file://{file}", [("q", "000010"), ("n", "4C8DFF")])
    assert json.loads(file.read_text()) == {"zoom": 2, "colorGroups": [{"query": "q", "extra": 1, "color": {"a": 1, "rgb": 16}}, {"query": "n", "color": {"a": 1, "rgb": 5017087}}]}


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.yaml").write_text("labels:\n  - x\nwords:\n  - the\n  - yes\n  - 'no'\n  - deep learning  # two\n")
    assert stores.read_words(spark, str(tmp_path / "w.yaml"), "words") == ["the", "no", "deep learning"]
    assert stores.read_words(spark, str(tmp_path / "w.yaml"), "labels") == ["x"]


def test_point_lookup_and_report(spark):
    rows = spark.createDataFrame([("a", 1, "some\n text"), ("b", 1, None)], "id string, query int, text string").withColumn("rank", F.when(F.col("id") == "a", 1))
    assert retrieval.get(rows, "id", "a").first().query == 1
    with pytest.raises(KeyError):
        retrieval.get(rows, "id", "z")
    assert {r.line for r in retrieval.result_lines(rows).collect()} == {"1. a some text", "+ b "}


def test_entity_index_of_a_hot_entity(spark):
    chunks = spark.createDataFrame([(f"c{i:04}", ["hot"] + ["rare"] * (i == 7)) for i in range(900)], "id string, links array<string>")
    got = {(r.entity, r.ord): r.id for r in retrieval.entity_index(chunks).collect()}
    assert got == {("hot", i + 1): f"c{i:04}" for i in range(900)} | {("rare", 1): "c0007"}
    assert retrieval.entity_index(chunks.where("false")).count() == 0
