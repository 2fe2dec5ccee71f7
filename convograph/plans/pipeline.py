"""From export files to a stored knowledge base, and from a question to its chunks.

``build`` composes the operators over the usual places of the exports; a missing export gives no documents.
Linked documents are written before what is derived from them, so the model providers run once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convograph import config
from convograph.functions.links import inject_links
from convograph.operators import chunking, cooccur, pages, relations, render, retrieval, terms, vectors
from convograph.sources import stores
from convograph.sources.exports import session_rows

PLACES = {
    "gemini": "gemini/Takeout/My Activity/Gemini Apps/MyActivity.json",
    "claude": "claude/conversations.json",
    "chatgpt": "chatgpt/conversations.json",
    "claude-code": "claude-code/projects",
}


def documents(spark: SparkSession, data: str) -> DataFrame:
    """``doc_id, path, text`` of the rendered documents of all exports under a folder."""
    place = {k: f"{data.rstrip('/')}/{v}" for k, v in PLACES.items()}
    owned = lambda df: df.withColumn("account_id", F.lit(0).cast("long")).withColumn("row_id", F.col("pos").cast("long"))
    gpt = render.day_documents(render.chatgpt_pieces(owned(stores.read_export(spark, place["chatgpt"], stores.CHATGPT_SCHEMA))), "chatgpt", "ChatGPT")
    claude = render.day_documents(render.claude_pieces(owned(stores.read_export(spark, place["claude"], stores.CLAUDE_SCHEMA))), "claude", "Claude")
    items = owned(stores.read_export(spark, place["gemini"], stores.GEMINI_SCHEMA)).withColumnRenamed("safeHtmlItem", "safe_html_item").withColumnRenamed("row_id", "item_id")
    gemini = render.day_documents(render.gemini_pieces(items), "gemini", "Gemini")
    lines = stores.read_sessions(spark, place["claude-code"]).select(F.lit(0).cast("long").alias("line_id"), F.lit(0).cast("long").alias("account_id"), "path", "line_no", "line")
    sessions = render.session_documents(render.session_messages(session_rows(lines))).select(F.concat(F.lit("conversations/claude-code/"), "name").alias("path"), "text")
    every = gpt.select("path", "text").unionByName(gemini.select("path", "text")).unionByName(claude.select("path", "text")).unionByName(sessions)
    return every.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def own_terms(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, ord, display, node``: topics and entities of each document by the offline providers."""
    return terms.union_terms(terms.own_topics(docs).drop("score"), terms.own_entities(docs).drop("score"))


def model_terms(
    keywords: Callable[[DataFrame], DataFrame], noun_chunks: Callable[[DataFrame], DataFrame], entities: Callable[[DataFrame, tuple[str, ...]], DataFrame],
    labels: tuple[str, ...] = config.ENTITY_LABELS,
) -> Callable[[DataFrame], DataFrame]:
    """A term provider from three models over documents (``doc_id, text``), for :func:`build`.

    ``keywords`` gives ``doc_id, pos, surface``; ``noun_chunks`` the same with ``root_pos``, of which nouns and proper
    nouns count; ``entities`` is given the labels to look for and gives ``doc_id, pos, surface`` with ``label``.
    """

    def run(docs: DataFrame) -> DataFrame:
        chunks = noun_chunks(docs).where(F.col("root_pos").isin("NOUN", "PROPN")).select("doc_id", "pos", "surface")
        found = entities(docs, labels).where(F.col("label").isin(*labels)).select("doc_id", "pos", "surface")
        topics = terms.topic_scores(keywords(docs).select("doc_id", "pos", "surface"), chunks)
        return terms.union_terms(topics.drop("score"), terms.entity_scores(found, terms.regex_entities(docs)).drop("score"))

    return run


def build(
    spark: SparkSession, data: str, out: str, passes: int = 1, embed: Callable[[Column], Column] = terms.hashed_embedding,
    find_terms: Callable[[DataFrame], DataFrame] = own_terms, markdown: bool = False,
) -> None:
    """Writes documents, terms, linked documents, edges, adjacency, relations, pages, chunks, vectors and the index under ``out``.

    ``markdown`` adds the linked documents and the node pages as one Markdown file each, under ``out/vault``.
    """
    keep = lambda df, name: (stores.save(df, f"{out}/{name}"), stores.load(spark, f"{out}/{name}"))[1]
    docs = keep(documents(spark, data), "documents")
    found = keep(find_terms(docs), "terms")
    linked = docs.join(terms.term_arrays(found), "doc_id", "left").select("doc_id", "path", inject_links(F.col("text"), F.col("terms")).alias("text"))
    linked = keep(linked, "linked")
    edges = keep(cooccur.cooccurrence_edges(linked, passes=passes), "edges")
    neighbors = keep(cooccur.adjacency(edges), "adjacency")
    stated = keep(relations.relations(linked, passes=passes), "relations")
    stores.save_adjacency(neighbors, f"{out}/json/adjacency")
    stores.save_json(stated, f"{out}/json/relations")
    placed = found.join(docs.select("doc_id", "path"), "doc_id")
    made = keep(pages.new_pages(placed), "pages")
    said = keep(pages.mentions(placed, made), "mentions")
    lines = keep(pages.relation_lines(stated, made), "relation_lines")
    if markdown:
        vault = out if "://" in out else f"file://{out}"
        stores.save_markdown(linked, f"{vault}/vault")
        bodies = pages.rendered_pages(made, said, lines)
        folder = F.when(F.col("kind") == "entity", "entities/").otherwise("topics/")
        stores.save_markdown(bodies.where("node <> ''").select(F.concat(folder, "node", F.lit(".md")).alias("path"), F.col("body").alias("text")), f"{vault}/vault")
    chunks = keep(chunking.chunks(linked), "chunks")
    stores.require_rows(chunks, "chunks")
    keep(chunks.select("id", embed(F.col("text")).alias("v")), "vectors")
    keep(retrieval.entity_index(chunks), "postings")


def answer(spark: SparkSession, out: str, question: str, k: int = config.TOP_K, embed: Callable[[Column], Column] = terms.hashed_embedding) -> DataFrame:
    """``rank, id, text, source`` of the chunks for a question: the hits in order, then the related ones (NULL rank)."""
    vector = spark.createDataFrame([(question,)], "q string").select(embed(F.col("q")).alias("v")).first().v
    hits = vectors.search(stores.load(spark, f"{out}/vectors"), list(vector), k)
    ranked = spark.createDataFrame([(0, r.id, i) for i, r in enumerate(hits.collect(), 1)], "query long, id string, rank int")  # k rows
    chunks = stores.load(spark, f"{out}/chunks")
    found = retrieval.retrieve(ranked, chunks, stores.read_adjacency(spark, f"{out}/json/adjacency"))
    return found.join(chunks.select("id", "text", F.col("path").alias("source")), "id").select("query", "rank", "id", "text", "source")
