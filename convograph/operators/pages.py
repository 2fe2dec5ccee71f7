"""Node pages, mentions, relation lines, and other append-if-missing writers, as set operations on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convograph.functions.text import file_name, py_strip


def page_name(node: Column) -> Column:
    return py_strip(file_name(node))


def new_pages(terms: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``kind, node, display``: a page per kind and node that isn't there yet; the first term (by ``doc_id, ord``) names it."""
    first = terms.groupBy("kind", page_name(F.col("node")).alias("node")).agg(F.min_by("display", F.struct("doc_id", "ord")).alias("display"))
    return first if existing is None else first.join(existing.select("kind", "node"), ["kind", "node"], "left_anti")


def page_kind(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """``nodes`` (with ``node``) that have a page, with ``page_kind``: the entity page where there is one, else the topic page."""
    best = pages.groupBy("node").agg(F.min("kind").alias("page_kind"))  # "entity" < "topic"
    return nodes.join(best, "node")


def mention_line(path: Column) -> Column:
    """``- [[conversations/<folder>/<file stem>]]`` of a document path."""
    parts = F.split(path, "/")
    return F.concat(F.lit("- [[conversations/"), F.element_at(parts, -2), F.lit("/"), F.regexp_replace(F.element_at(parts, -1), r"\.md$", ""), F.lit("]]"))


def mentions(terms: DataFrame, pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``page_kind, node, line``: distinct mention lines of terms (``node, path``) that have a page and no such line yet."""
    lines = page_kind(terms.select("node", mention_line(F.col("path")).alias("line")).distinct(), pages).select("page_kind", "node", "line")
    return lines if existing is None else lines.join(existing.select("page_kind", "node", "line"), ["page_kind", "node", "line"], "left_anti")


def relation_line(relation: Column, target: Column) -> Column:
    return F.concat(F.lit("- "), relation, F.lit(" → [["), target, F.lit("]]"))


def relation_lines(relations: DataFrame, pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``page_kind, node, line`` for the source side of each relation, if its node has a page."""
    lines = page_kind(relations.select(F.col("source").alias("node"), relation_line(F.col("relation"), F.col("target")).alias("line")).distinct(), pages).select("page_kind", "node", "line")
    return lines if existing is None else lines.join(existing.select("page_kind", "node", "line"), ["page_kind", "node", "line"], "left_anti")


def rendered_pages(pages: DataFrame, mention_rows: DataFrame, relation_rows: DataFrame) -> DataFrame:
    """``kind, node, body``: title, then the ``Mentioned In`` and ``Relations`` sections with sorted lines.

    A node's lines are as many as its documents, so bodies are for export; keep the line rows for processing.
    """
    body = lambda rows, name: rows.groupBy(F.col("page_kind").alias("kind"), "node").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias(name))
    joined = pages.join(body(mention_rows, "m"), ["kind", "node"], "left").join(body(relation_rows, "r"), ["kind", "node"], "left")
    text = F.concat(
        F.lit("# "), "display", F.lit("\n"), F.coalesce(F.concat(F.lit("\n\n## Mentioned In\n"), "m", F.lit("\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("\n## Relations\n\n"), "r"), F.lit("")),
    )
    return joined.select("kind", "node", text.alias("body"))


def hex_to_int(color: Column) -> Column:
    return F.conv(F.ltrim(color, F.lit("#")), 16, 10).cast("int")


def upsert_groups(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``ord, query, rgb, a``: colour groups after an upsert by ``query``; old ones keep their place, new ones follow."""
    fresh = new.select(F.col("ord").alias("new_ord"), "query", hex_to_int(F.col("hex")).alias("new_rgb"))
    both = existing.select("ord", "query", "rgb", "a").join(fresh, "query", "full_outer")
    w = Window.orderBy(F.col("ord").asc_nulls_last(), "new_ord")  # a handful of groups
    return both.select(F.row_number().over(w).alias("ord"), "query", F.coalesce("new_rgb", "rgb").alias("rgb"), F.when(F.col("new_rgb").isNotNull(), 1).otherwise(F.col("a")).alias("a"))
