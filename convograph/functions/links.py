"""Wiki links: the three readers and the injector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convograph import config
from convograph.functions.text import py_strip


def edge_links(text: Column) -> Column:
    """Distinct link targets for edges: stripped, lower case; a missing ``]]`` doesn't matter. First-seen order."""
    found = F.regexp_extract_all(text, F.lit(config.EDGE_LINK), 1)
    return F.array_distinct(F.transform(found, lambda x: F.lower(py_strip(x))))


def relation_links(text: Column) -> Column:
    """Distinct link targets for relations: stripped, lower case, white space → ``_``. First-seen order."""
    found = F.regexp_extract_all(text, F.lit("(?d)" + config.RELATION_LINK), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(py_strip(x)), r"(?U)\s+", "_")))


def chunk_links(text: Column) -> Column:
    """Distinct link targets for chunks, as written, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(config.CHUNK_LINK), 1)))


def inject_links(text: Column, terms: Column) -> Column:
    """Turns each whole-word occurrence of each term into ``[[node|as written]]``, term after term.

    ``terms``: array of ``struct<display, node>`` in rank order. Case doesn't matter; a place directly after
    ``[[`` or before ``]]`` is left alone. NULL terms change nothing.
    """
    none = F.array().cast("array<struct<display:string,node:string>>")

    def one(done: Column, term: Column) -> Column:
        quoted = F.concat(F.lit(r"(?iU)(?<!\[\[)\b\Q"), F.replace(term["display"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b(?!\]\])"))
        link = F.concat(F.lit("[["), F.regexp_replace(term["node"], r"[\\$]", ""), F.lit("|$0]]"))
        return F.when(F.length(term["display"]) > 0, F.regexp_replace(done, quoted, link)).otherwise(done)

    return F.aggregate(F.coalesce(terms, none), text, one)
