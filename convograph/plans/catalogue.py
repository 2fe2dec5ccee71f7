"""The core's registered queries: each operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convograph.functions import links as L
from convograph.functions import text as X
from convograph.functions.html import html_to_markdown
from convograph.functions.instants import text_instant, unix_instant
from convograph.operators import chunking, cooccur, pages, relations, render, retrieval, terms, vectors
from convograph.plans.oracle import SQL
from convograph.session import cut, work_dir
from convograph.sources import stores
from convograph.sources.exports import CHATGPT, CLAUDE, GEMINI, SESSIONS, chatgpt_messages, claude_messages, instants, newest, session_rows, table
from convograph.config import COLOR_GROUPS

SEP = " ¦ "


def _docs(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "documents").where("text IS NOT NULL").select("doc_id", "path", "text")


def _texts(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "chunks").where("text IS NOT NULL").select("row_id", "text")


def _tokens(spark: SparkSession, where: str) -> DataFrame:
    return _docs(spark, where).select(F.explode(F.split("text", r"(?U)\s+")).alias("token")).where("token <> ''").distinct()


def _graph(spark: SparkSession, where: str) -> DataFrame:
    return cooccur.cooccurrence_edges(_texts(spark, where), "row_id")


def _flat(edges: DataFrame) -> DataFrame:
    return edges.withColumn("contexts", F.array_join("contexts", ","))


# ---------------------------------------------------------------- sources
def p3_found(spark: SparkSession, where: str) -> DataFrame:
    """Every record of the four exports with a determinable instant."""
    return instants(spark, where)


def chatgpt_text(spark: SparkSession, where: str) -> DataFrame:
    return chatgpt_messages(table(spark, where, CHATGPT)).select("row_id", "rec_id", "speaker", "is_text", "text")


def claude_text(spark: SparkSession, where: str) -> DataFrame:
    return claude_messages(table(spark, where, CLAUDE)).select("row_id", "rec_id", "speaker", "text")


def claude_markdown_text(spark: SparkSession, where: str) -> DataFrame:
    """Message texts with thinking blocks as callouts."""
    raw = table(spark, where, CLAUDE).select("row_id", F.explode("chat_messages").alias("m"))
    return raw.select("row_id", F.col("m.msg_id").alias("rec_id"), render.claude_text(F.col("m.content")).alias("text"))


def session_text(spark: SparkSession, where: str) -> DataFrame:
    return session_rows(table(spark, where, SESSIONS)).select("line_id", "path", "line_no", "kind", "text").distinct()


def session_files_pruned(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, SESSIONS).where(render.outside_subagents(F.col("path"))).select("path").distinct()


def iso_dates(spark: SparkSession, where: str) -> DataFrame:
    chats = table(spark, where, CLAUDE).select(F.lit(CLAUDE).alias("tab"), F.col("row_id").alias("id"), F.col("created_at").alias("t"))
    items = table(spark, where, GEMINI).select(F.lit(GEMINI).alias("tab"), F.col("item_id").alias("id"), F.col("time").alias("t"))
    return chats.unionByName(items).select("tab", "id", render.iso_date(F.coalesce("t", F.lit(""))).alias("day"))


def epoch_dates(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, CHATGPT).select("row_id", render.epoch_date(F.col("create_time")).alias("day"))


def sorted_raw(spark: SparkSession, where: str) -> DataFrame:
    """Items of each account in the order of their time text, missing times first, ties by place."""
    w = Window.partitionBy("account_id").orderBy(F.coalesce("time", F.lit("")), "item_id", F.coalesce("title", F.lit("")))
    return table(spark, where, GEMINI).select("account_id", "item_id", "time", "title").distinct().select("account_id", "item_id", F.row_number().over(w).alias("ord"))


# ---------------------------------------------------------------- rendering
def render_chatgpt_days(spark: SparkSession, where: str) -> DataFrame:
    return render.day_documents(render.chatgpt_pieces(table(spark, where, CHATGPT)), "chatgpt", "ChatGPT")


def render_claude_days(spark: SparkSession, where: str) -> DataFrame:
    return render.day_documents(render.claude_pieces(table(spark, where, CLAUDE)), "claude", "Claude")


def render_gemini_days(spark: SparkSession, where: str) -> DataFrame:
    return render.day_documents(render.gemini_pieces(table(spark, where, GEMINI)), "gemini", "Gemini")


def _session_messages(spark: SparkSession, where: str) -> DataFrame:
    return render.session_messages(session_rows(table(spark, where, SESSIONS)))


def render_sessions(spark: SparkSession, where: str) -> DataFrame:
    return render.session_documents(_session_messages(spark, where))


def pack_messages(spark: SparkSession, where: str) -> DataFrame:
    """Parts of sessions under a small limit, so that packing shows."""
    return render.session_parts(_session_messages(spark, where), 2_000).select("path", "line_no", "part", "parts")


def session_meta(spark: SparkSession, where: str) -> DataFrame:
    return render.session_documents(_session_messages(spark, where)).select("path", "date", "project", "session", "name")


def html_markdown(spark: SparkSession, where: str) -> DataFrame:
    item = table(spark, where, GEMINI).select("item_id", F.posexplode("safe_html_item").alias("ord", "h"))
    return item.select("item_id", "ord", html_to_markdown(F.col("h.html")).alias("markdown"))


def file_union(spark: SparkSession, where: str) -> DataFrame:
    """Documents of all platforms, one absent one included: who owns them, their date and number."""
    none = spark.createDataFrame([], "platform string, owner string, date string")
    for name, days in (("chatgpt", render_chatgpt_days), ("claude", render_claude_days), ("gemini", render_gemini_days)):
        none = none.unionByName(days(spark, where).select(F.lit(name).alias("platform"), F.col("account_id").cast("string").alias("owner"), "date"))
    sessions = render_sessions(spark, where).select(F.lit("claude-code").alias("platform"), F.col("path").alias("owner"), "date")
    return none.unionByName(sessions).groupBy("platform", "owner", "date").agg(F.count("*").alias("n"))


def _file(rows: DataFrame) -> str:
    at = work_dir(rows.sparkSession)
    stores.save_json(rows, at)
    return at


def gemini_file(spark: SparkSession, where: str) -> DataFrame:
    """Activity items written as an export of JSON lines and read again."""
    at = _file(table(spark, where, GEMINI).select("time", "title", F.col("safe_html_item").alias("safeHtmlItem")))
    return stores.read_export(spark, at, stores.GEMINI_SCHEMA, lines=True).select("time", "title", F.array_join(F.transform("safeHtmlItem", lambda x: x["html"]), SEP).alias("html"))


def claude_file(spark: SparkSession, where: str) -> DataFrame:
    """Conversations written as an export of JSON lines, read again as message texts."""
    read = stores.read_export(spark, _file(table(spark, where, CLAUDE).select("created_at", "name", "chat_messages")), stores.CLAUDE_SCHEMA, lines=True)
    msg = read.select("created_at", "name", F.explode("chat_messages").alias("m"))
    return msg.select("created_at", "name", F.col("m.sender").alias("sender"), F.col("m.created_at").alias("at"), render.claude_text(F.col("m.content")).alias("text"))


def chatgpt_file(spark: SparkSession, where: str) -> DataFrame:
    """Conversations written as an export of JSON lines, read again as nodes."""
    read = stores.read_export(spark, _file(table(spark, where, CHATGPT).select("create_time", "title", "mapping")), stores.CHATGPT_SCHEMA, lines=True)
    node = read.select("create_time", "title", F.explode("mapping").alias("node", "v"))
    m = F.col("v.message")
    return node.select("create_time", "title", "node", m["create_time"].alias("at"), m["author"]["role"].alias("role"), F.array_join(m["content"]["parts"], SEP).alias("parts"))


def markdown_files(spark: SparkSession, where: str) -> DataFrame:
    """Day documents written as one Markdown file each and read again."""
    at = work_dir(spark)
    days = render_claude_days(spark, where)
    written = stores.save_markdown(days.select(F.concat_ws("/", F.col("account_id").cast("string"), "path").alias("path"), "text"), at)
    again = stores.read_markdown(spark, at).select(F.regexp_extract("path", "work-[^/]+/[^/]+/(.*)$", 1).alias("path"), F.sha2("text", 256).alias("hash"))
    return again.join(written, "path").select("path", "n_chars", "hash")


def unix_instants(spark: SparkSession, where: str) -> DataFrame:
    """Instants of the Unix times of conversations, in whatever unit they are."""
    return table(spark, where, CHATGPT).select("row_id", unix_instant(F.col("create_time")).alias("utc_us")).where("utc_us IS NOT NULL")


def iso_instants(spark: SparkSession, where: str) -> DataFrame:
    """Instants of the ISO times that name their offset."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
    times = table(spark, where, CLAUDE).select("row_id", F.explode("chat_messages").alias("m")).select("row_id", F.col("m.msg_id").alias("rec_id"), F.col("m.created_at").alias("t"))
    none = F.lit(None).cast("string")
    return times.where(F.col("t").rlike(shape)).select("row_id", "rec_id", text_instant(F.col("t"), none, none).alias("utc_us")).where("utc_us IS NOT NULL")


# ---------------------------------------------------------------- scalars
def node_names(spark: SparkSession, where: str) -> DataFrame:
    names = table(spark, where, "chunks").select(F.explode("links").alias("name")).where("name IS NOT NULL").distinct()
    return names.select("name", X.node_name(F.col("name")).alias("node"))


def token_names(spark: SparkSession, where: str) -> DataFrame:
    t = F.col("token")
    return _tokens(spark, where).select("token", X.file_name(t).alias("file_name"), X.one_spaced(t).alias("surface"))


def title_cased(spark: SparkSession, where: str) -> DataFrame:
    return _tokens(spark, where).select("token", X.title_case(F.col("token")).alias("title"))


def valid_terms(spark: SparkSession, where: str) -> DataFrame:
    t = F.col("token")
    return _tokens(spark, where).select("token", terms.valid_entity(t).alias("entity_ok"), terms.valid_topic(t).alias("topic_ok"))


def clean_entity_text(spark: SparkSession, where: str) -> DataFrame:
    return _docs(spark, where).select("doc_id", terms.clean_entity_text(F.col("text")).alias("cleaned"))


def clean_topic_text(spark: SparkSession, where: str) -> DataFrame:
    return _docs(spark, where).select("doc_id", terms.clean_topic_text(F.col("text")).alias("cleaned"))


def text_units(spark: SparkSession, where: str) -> DataFrame:
    return cooccur.text_units(_docs(spark, where))


def extracted_links(spark: SparkSession, where: str) -> DataFrame:
    t = F.col("text")
    cols = (("edge_links", L.edge_links(t)), ("relation_links", L.relation_links(t)), ("chunk_links", L.chunk_links(t)))
    return _docs(spark, where).select("doc_id", *[F.array_join(F.array_sort(c), SEP).alias(n) for n, c in cols])


# ---------------------------------------------------------------- terms
def _link_candidates(spark: SparkSession, where: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"\[\[([^\]|]+)"), 1)
    return _docs(spark, where).select("doc_id", F.posexplode(found).alias("pos", "surface"))


def term_scores(spark: SparkSession, where: str) -> DataFrame:
    """The scoring of topics and entities on link occurrences, a point each."""
    return terms.scored(_link_candidates(spark, where).withColumn("points", F.lit(1)), 1, 5)


def term_union(spark: SparkSession, where: str) -> DataFrame:
    found = _link_candidates(spark, where)
    topics = terms.scored(found.withColumn("points", F.lit(1)), 2, 25).drop("score")
    entities = terms.scored(found.withColumn("points", F.lit(2)), 2, 50).drop("score")
    return terms.union_terms(topics, entities)


def regex_entities(spark: SparkSession, where: str) -> DataFrame:
    return terms.regex_entities(_texts(spark, where), "row_id")


def entity_scores(spark: SparkSession, where: str) -> DataFrame:
    return terms.own_entities(_docs(spark, where))


def topic_scores(spark: SparkSession, where: str) -> DataFrame:
    return terms.own_topics(_docs(spark, where))


def keyword_scores(spark: SparkSession, where: str) -> DataFrame:
    return terms.keywords(_docs(spark, where))


def model_windows(spark: SparkSession, where: str) -> DataFrame:
    return _docs(spark, where).select("doc_id", F.posexplode(chunking.model_windows(terms.clean_entity_text(F.col("text")))).alias("win", "text"))


def hashed_embeddings(spark: SparkSession, where: str) -> DataFrame:
    return _texts(spark, where).select("row_id", terms.hashed_embedding(F.col("text")).alias("v")).select("row_id", F.array_join(F.transform("v", lambda x: F.round(x, 5).cast("string")), ",").alias("v"))


def injected_links(spark: SparkSession, where: str) -> DataFrame:
    """Documents linked with their own scored topics and entities."""
    docs = _docs(spark, where)
    found = cut(terms.union_terms(terms.own_topics(docs).drop("score"), terms.own_entities(docs).drop("score")))
    own = terms.term_arrays(found)
    return docs.join(own, "doc_id", "left").select("doc_id", L.inject_links(F.col("text"), F.col("terms")).alias("text"))


# ---------------------------------------------------------------- graph
def context_weighted_pairs(spark: SparkSession, where: str) -> DataFrame:
    return cooccur.weighted_pairs(cooccur.text_units(_texts(spark, where), "row_id"))


def cooccurrence_edges(spark: SparkSession, where: str) -> DataFrame:
    return _flat(_graph(spark, where))


def edges_double_pass(spark: SparkSession, where: str) -> DataFrame:
    return _flat(cooccur.cooccurrence_edges(_texts(spark, where), "row_id", passes=2))


def adjacency(spark: SparkSession, where: str) -> DataFrame:
    return cooccur.adjacency(_graph(spark, where))


def adjacency_capped(spark: SparkSession, where: str) -> DataFrame:
    return cooccur.first_neighbors(_graph(spark, where))


def adjacency_file(spark: SparkSession, where: str) -> DataFrame:
    """Adjacency written as JSON objects and read again."""
    at = work_dir(spark)
    stores.save_adjacency(adjacency(spark, where), at)
    return stores.read_adjacency(spark, at)


def adjacency_from_edge_list(spark: SparkSession, where: str) -> DataFrame:
    return stores.edge_list(table(spark, where, "edges")).distinct()


def graph_expand(spark: SparkSession, where: str) -> DataFrame:
    """Links of each chunk and their first neighbours."""
    seeds = _texts(spark, where).select("row_id", F.explode(L.edge_links(F.col("text"))).alias("node"))
    return cooccur.expand(seeds, cooccur.first_neighbors(_graph(spark, where)))


def relation_matches(spark: SparkSession, where: str) -> DataFrame:
    return relations.relation_matches(_texts(spark, where), "row_id")


def relation_graph(spark: SparkSession, where: str) -> DataFrame:
    return _flat(relations.relations(_texts(spark, where), "row_id"))


# ---------------------------------------------------------------- chunks and retrieval
def section_bounds(spark: SparkSession, where: str) -> DataFrame:
    return _docs(spark, where).select("doc_id", F.posexplode(chunking.sections(F.col("text"))).alias("ord", "s")).select("doc_id", "ord", F.length("s").alias("n_chars"), F.sha2("s", 256).alias("hash"))


def document_chunks(spark: SparkSession, where: str) -> DataFrame:
    made = chunking.chunks(_docs(spark, where).withColumn("key", F.concat_ws("#", "path", "doc_id")), "key")
    return made.select("path", "ord", "id", "text", F.array_join("links", SEP).alias("links"), "hash")


def paragraph_chunks(spark: SparkSession, where: str) -> DataFrame:
    """Chunks under a small limit, so that packing shows."""
    made = chunking.chunks(_docs(spark, where).withColumn("key", F.concat_ws("#", "path", "doc_id")), "key", 600)
    return made.select("path", "ord", F.length("text").alias("n_chars"), "hash")


def _last_chunks(spark: SparkSession, where: str) -> DataFrame:
    return newest(table(spark, where, "chunks").where("id IS NOT NULL").select("id", "batch_id", "row_id", "text", "links", "hash"), ["id"], ["batch_id", "row_id"])


def dedup_last_wins(spark: SparkSession, where: str) -> DataFrame:
    return retrieval.last_wins(table(spark, where, "chunks").where("id IS NOT NULL").select("id", "batch_id", "row_id", "hash"), "id", "batch_id", "row_id")


def postings(spark: SparkSession, where: str) -> DataFrame:
    return retrieval.postings(_last_chunks(spark, where))


def inverted_index(spark: SparkSession, where: str) -> DataFrame:
    return retrieval.inverted_index(_last_chunks(spark, where))


def entity_index(spark: SparkSession, where: str) -> DataFrame:
    """The chunks of each entity, in order."""
    return retrieval.entity_index(_last_chunks(spark, where))


def index_lookup(spark: SparkSession, where: str) -> DataFrame:
    """Chunks that hold any node of the document graph."""
    nodes = table(spark, where, "edges").select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return retrieval.lookup(retrieval.postings(_last_chunks(spark, where)), nodes)


def index_counts(spark: SparkSession, where: str) -> DataFrame:
    rows = stores.require_rows(_last_chunks(spark, where), "chunks")
    total = rows.agg(F.count("*").alias("chunks"), F.sum(F.size("links")).alias("n"))
    names = retrieval.postings(rows).agg(F.count("*").alias("postings"), F.count_distinct("entity").alias("entities"))
    return total.select(F.lit("chunks").alias("what"), F.col("chunks").alias("n")).unionByName(names.select(F.lit("postings").alias("what"), F.col("postings").alias("n"))).unionByName(names.select(F.lit("entities").alias("what"), F.col("entities").alias("n")))


def chunk_point_lookup(spark: SparkSession, where: str) -> DataFrame:
    """The chunk of one id (the smallest)."""
    first = table(spark, where, "chunks").agg(F.min("id").alias("id"))
    return _last_chunks(spark, where).join(F.broadcast(first), "id").select("id", "row_id", "hash")  # one row


def store_roundtrip(spark: SparkSession, where: str) -> DataFrame:
    """Chunks written as Parquet and read again."""
    at = work_dir(spark)
    stores.save(_last_chunks(spark, where), at)
    return stores.load(spark, at).select("id", "text", F.array_join("links", SEP).alias("links"), "hash")


def _vectors(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))


def vector_topk(spark: SparkSession, where: str) -> DataFrame:
    """Ten nearest vectors of the vector with the smallest id."""
    q = _vectors(spark, where).orderBy("id").first()
    return vectors.search(_vectors(spark, where), list(q.v))


def vector_topk_batch(spark: SparkSession, where: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 20, against all."""
    return vectors.top_k(_vectors(spark, where), _vectors(spark, where).where("id % 20 = 0"))


def _hits(spark: SparkSession, where: str) -> DataFrame:
    rows = table(spark, where, "chunks").select(F.col("row_id").cast("long").alias("vec"), F.col("id").alias("chunk"))
    return vector_topk_batch(spark, where).join(rows, F.col("id") == F.col("vec")).groupBy("query", F.col("chunk").alias("id")).agg(F.min("rank").alias("rank"))


def hits_join_chunks(spark: SparkSession, where: str) -> DataFrame:
    return _hits(spark, where).join(_last_chunks(spark, where).select("id", "hash"), "id").select("query", "rank", "id", "hash")


def retrieve(spark: SparkSession, where: str) -> DataFrame:
    """Graph-augmented retrieval: a chunk row has the vector of its number; rank 0 is a related chunk, no hit."""
    return retrieval.retrieve(_hits(spark, where), _last_chunks(spark, where), _graph(spark, where)).withColumn("rank", F.coalesce("rank", F.lit(0)))


# ---------------------------------------------------------------- pages
def _page_terms(spark: SparkSession, where: str) -> DataFrame:
    both = term_union(spark, where)
    return both.join(_docs(spark, where).select("doc_id", "path"), "doc_id")


def node_pages(spark: SparkSession, where: str) -> DataFrame:
    return pages.new_pages(_page_terms(spark, where))


def mentions(spark: SparkSession, where: str) -> DataFrame:
    found = _page_terms(spark, where)
    return pages.mentions(found, pages.new_pages(found))


def relation_lines(spark: SparkSession, where: str) -> DataFrame:
    return pages.relation_lines(relations.relations(_texts(spark, where), "row_id"), node_pages(spark, where))


def append_if_missing(spark: SparkSession, where: str) -> DataFrame:
    """Mention lines of all documents that those of even ids haven't brought already."""
    found = _page_terms(spark, where)
    there = pages.new_pages(found)
    return pages.mentions(found, there, pages.mentions(found.where("doc_id % 2 = 0"), there))


def rendered_pages(spark: SparkSession, where: str) -> DataFrame:
    return pages.rendered_pages(node_pages(spark, where), mentions(spark, where), relation_lines(spark, where))


def color_group_upsert(spark: SparkSession, where: str) -> DataFrame:
    old = spark.createDataFrame([(1, "tag:#x", 255, 1), (2, "path:topics", 7, 0)], "ord int, query string, rgb int, a int")
    new = spark.createDataFrame([(i, q, h) for i, (q, h) in enumerate(COLOR_GROUPS, 1)], "ord int, query string, hex string")
    return pages.upsert_groups(old, new)


def color_group_file(spark: SparkSession, where: str) -> DataFrame:
    """Colour groups of a graph-style file after its upsert; what else it holds stays."""
    at = work_dir(spark)
    spark.createDataFrame([('{"collapse": true, "colorGroups": [{"query": "tag:#x", "color": {"a": 1, "rgb": 255}}, {"query": "path:topics", "color": {"a": 0, "rgb": 7}}]}',)], "value string").coalesce(1).write.text(at)
    file = spark.read.text(at).select("_metadata.file_path").first()[0]
    stores.upsert_color_file(file)
    style = spark.read.schema("collapse boolean, colorGroups array<struct<query:string,color:struct<a:int,rgb:int>>>").json(file, multiLine=True)
    groups = style.select("collapse", F.posexplode("colorGroups").alias("i", "g"))
    return groups.select("collapse", (F.col("i") + 1).alias("ord"), "g.query", "g.color.rgb", "g.color.a")


def result_report(spark: SparkSession, where: str) -> DataFrame:
    """A line per hit: rank, chunk and where it comes from."""
    hits = _hits(spark, where).join(_last_chunks(spark, where).select("id", "hash"), "id")
    return retrieval.result_lines(hits, "hash", 12)


def index_build(spark: SparkSession, where: str) -> DataFrame:
    """Chunks of all documents with their vectors and index, written; how many rows each store has."""
    at = work_dir(spark)
    made = chunking.chunks(_docs(spark, where).withColumn("key", F.concat_ws("#", "path", "doc_id")), "key")
    stores.save(made, f"{at}/chunks")
    chunks = stores.require_rows(stores.load(spark, f"{at}/chunks"), "chunks")
    stores.save(chunks.select("id", terms.hashed_embedding(F.col("text")).alias("v")), f"{at}/vectors")
    stores.save(retrieval.entity_index(chunks), f"{at}/postings")
    out = None
    for name in ("chunks", "vectors", "postings"):
        rows = stores.load(spark, f"{at}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def flagship(spark: SparkSession, where: str) -> DataFrame:
    return cooccurrence_edges(spark, where)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p3_found, cooccurrence_edges, edges_double_pass, context_weighted_pairs, adjacency, adjacency_capped, adjacency_from_edge_list, graph_expand,
        relation_matches, relation_graph, text_units, extracted_links, section_bounds, document_chunks, paragraph_chunks, dedup_last_wins, postings,
        inverted_index, index_lookup, index_counts, chunk_point_lookup, store_roundtrip, vector_topk, vector_topk_batch, hits_join_chunks, retrieve,
        chatgpt_text, claude_text, claude_markdown_text, session_text, session_files_pruned, session_meta, iso_dates, epoch_dates, sorted_raw,
        render_chatgpt_days, render_claude_days, render_gemini_days, render_sessions, pack_messages, html_markdown, file_union, node_names, token_names,
        title_cased, valid_terms, clean_entity_text, clean_topic_text, term_scores, term_union, regex_entities, entity_scores, topic_scores,
        keyword_scores, model_windows, hashed_embeddings, injected_links, node_pages, mentions, relation_lines, append_if_missing, rendered_pages,
        color_group_upsert, color_group_file, gemini_file, claude_file, chatgpt_file, markdown_files, unix_instants, iso_instants, entity_index,
        adjacency_file, result_report, index_build,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
