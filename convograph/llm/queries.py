"""Registered queries of this subpackage and the SQL some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convograph.llm import conversations, cooccurrence, encode, incremental_dedup, mixture, pairs, personal, reading_level, split
from convograph.sources.exports import account_zones, chat_rows, table, with_instants


def _kept(spark: SparkSession, where: str) -> DataFrame:
    rows = conversations.counting(chat_rows(spark, where))
    return conversations.kept_conversations(with_instants(rows, account_zones(spark, where)))


def p1_found(spark: SparkSession, where: str) -> DataFrame:
    return _kept(spark, where).drop("row_id")


def p1_conversations(spark: SparkSession, where: str) -> DataFrame:
    """Kept messages with their text."""
    return conversations.rebuild_text(_kept(spark, where), chat_rows(spark, where))


def p2_found(spark: SparkSession, where: str) -> DataFrame:
    spans = personal.found_spans(personal.personal_texts(spark, where), personal.fitted(spark, where))
    return spans.select("tab", "rec_id", "kind", "val").distinct()


def p2_redacted(spark: SparkSession, where: str) -> DataFrame:
    """Every text with its personal data replaced by placeholders."""
    return personal.redacted(personal.personal_texts(spark, where), personal.fitted(spark, where))


def p4_found(spark: SparkSession, where: str) -> DataFrame:
    return split.oversized_pieces(spark, where).select("tab", "rec_id").distinct()


def p4_pieces(spark: SparkSession, where: str) -> DataFrame:
    return split.oversized_pieces(spark, where)


def p5_found(spark: SparkSession, where: str) -> DataFrame:
    return cooccurrence.link_pairs(spark, where).select("node_a", "node_b")


def p5_lift(spark: SparkSession, where: str) -> DataFrame:
    """The same pairs with their counts and lift."""
    return cooccurrence.link_pairs(spark, where).withColumn("lift", F.round("lift", 6))


def p5_graph(spark: SparkSession, where: str) -> DataFrame:
    return cooccurrence.accumulated_graph(table(spark, where, "edges"))


def p6_found(spark: SparkSession, where: str) -> DataFrame:
    return pairs.defects(pairs.prompt_answer_pairs(spark, where))


def p6_evidence(spark: SparkSession, where: str) -> DataFrame:
    """What shows each truncated answer to be so, and how often."""
    return pairs.judged_pairs(pairs.prompt_answer_pairs(spark, where)).groupBy("defect", "evidence").agg(F.count("*").alias("n"))


def p7_found(spark: SparkSession, where: str) -> DataFrame:
    return incremental_dedup.chunk_repeats(spark, where)


def p8_ids(spark: SparkSession, where: str) -> DataFrame:
    return encode.document_ids(spark, where)


def p9_mixture(spark: SparkSession, where: str) -> DataFrame:
    """Documents taken, and how often."""
    return mixture.document_mixture(spark, where)


def p9_report(spark: SparkSession, where: str) -> DataFrame:
    return mixture.mixture_report(spark, where)


def p10_found(spark: SparkSession, where: str) -> DataFrame:
    return reading_level.document_levels(spark, where).select("doc_id", "reading_level").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p1_found, p1_conversations, p2_found, p2_redacted, p4_found, p4_pieces, p5_found, p5_lift, p5_graph, p6_found, p6_evidence, p7_found, p8_ids,
        p9_mixture, p9_report, p10_found,
    )
    return {f.__name__: f for f in named}


_NODE = r"lower(regexp_replace(regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), '[^a-zA-Z0-9_]', '', 'g'))"

_BASKETS = f"""
WITH last AS (
  SELECT id, links, row_number() OVER (PARTITION BY id ORDER BY batch_id DESC, row_id DESC) AS rn
  FROM chunks WHERE id IS NOT NULL),
items AS (
  SELECT DISTINCT id, item FROM (
    SELECT id, {_NODE.format(x="link")} AS item FROM (SELECT id, unnest(links) AS link FROM last WHERE rn = 1) u)
  WHERE item IS NOT NULL AND item <> ''),
k AS (SELECT item, count(*) AS k FROM items GROUP BY item),
n AS (SELECT count(*) AS n FROM last WHERE rn = 1),
c AS (
  SELECT x.item AS node_a, y.item AS node_b, count(*) AS c
  FROM items x JOIN items y ON x.id = y.id AND x.item < y.item GROUP BY 1, 2)
"""


def oracle_sql() -> dict[str, str]:
    scored = _BASKETS + """SELECT node_a, node_b{more} FROM c JOIN k ka ON ka.item = node_a JOIN k kb ON kb.item = node_b, n
WHERE c >= 3 AND c * n >= 4 * ka.k * kb.k"""
    return {
        "p4_found": """
SELECT DISTINCT tab, rec_id FROM (
  SELECT 'chunks' AS tab, id AS rec_id, length(text) AS n FROM chunks
  UNION ALL
  SELECT 'session_lines', CAST(line_id AS VARCHAR), length(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) FROM (
    SELECT line_id, CASE json_type(line, '$.message.content')
      WHEN 'VARCHAR' THEN json_extract_string(line, '$.message.content')
      ELSE array_to_string(list_transform(list_filter(CAST(json_extract(line, '$.message.content') AS JSON[]),
        lambda b: json_extract_string(b, '$.type') = 'text' AND regexp_matches(json_extract_string(b, '$.text'), '\\S')),
        lambda b: json_extract_string(b, '$.text')), chr(10) || chr(10)) END AS body
    FROM session_lines WHERE json_valid(line)) s) t
JOIN size_limits ON table_name = tab WHERE n > max_chars""",
        "p5_found": scored.format(more=""),
        "p5_lift": scored.format(more=", c, ka.k AS a, kb.k AS b, n, round(c * n / (ka.k * kb.k), 6) AS lift"),
        "p5_graph": f"""
WITH e AS (
  SELECT doc_path, {_NODE.format(x="source")} AS x, {_NODE.format(x="target")} AS y, weight,
    array_to_string(list_sort(list_distinct(contexts)), ',') AS ctx FROM edges),
r AS (
  SELECT DISTINCT doc_path, least(x, y) AS node_a, greatest(x, y) AS node_b, weight, ctx FROM e
  WHERE x <> '' AND y <> '' AND x <> y)
SELECT node_a, node_b, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight, count(DISTINCT doc_path) AS n_docs,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split(ctx, ',')) FILTER (WHERE ctx IS NOT NULL)))), ','), '') AS contexts
FROM r GROUP BY 1, 2""",
    }
