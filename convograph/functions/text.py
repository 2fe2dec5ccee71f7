"""String columns with Python semantics, built from JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_GAP = r"(?U)(?<=[.!?])\s+"
PARAGRAPH_GAP = "\n\n"


def py_strip(x: Column) -> Column:
    """Python ``str.strip``: Unicode white space off both ends (Spark's ``trim`` knows only the space)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def sentences(x: Column) -> Column:
    """Pieces of the whole text between ``.``/``!``/``?`` and the white space after it."""
    return F.split(x, SENTENCE_GAP)


def paragraphs(x: Column) -> Column:
    """Pieces between empty lines; empty pieces are kept."""
    return F.split(x, PARAGRAPH_GAP)


def node_name(x: Column) -> Column:
    """Node name: stripped, white space runs → ``_``, only ASCII letters, digits and ``_`` kept, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(py_strip(x), r"(?U)\s+", "_"), "[^a-zA-Z0-9_]", ""))


def file_name(x: Column) -> Column:
    """Characters that file systems forbid are removed."""
    return F.regexp_replace(x, r'[<>:"/\\|?*]', "")


def one_spaced(x: Column) -> Column:
    """Stripped, white-space runs → one space."""
    return F.regexp_replace(py_strip(x), r"(?U)\s+", " ")


def title_case(x: Column) -> Column:
    """Python ``str.title``: every run of letters starts upper case and continues lower case."""
    runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    first = lambda r: F.upper(F.substring(r, 1, 1))  # noqa: E731  (may be two letters, as for ligatures)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.substring(first(r), 1, 1), F.lower(F.substring(first(r), 2, 9)), F.lower(F.substring(r, 2, 2**31 - 1)))), "")


def short_hash(x: Column, digits: int = 6) -> Column:
    """First hex digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, digits)


def path_id(path: Column) -> Column:
    """Document id: first 12 hex digits of SHA-1 of the path."""
    return F.substring(F.sha1(path), 1, 12)


def has_word(x: Column) -> Column:
    """At least one letter or digit."""
    return F.coalesce(x.rlike(r"[\p{L}\p{N}]"), F.lit(False))
