"""Oversized texts cut into pieces within a limit, at natural boundaries, with a fixed overlap.

Method: lexical cohesion. Candidate cuts are the ends of paragraphs, list items and sentences. At each the
words of the block before and the block after are compared (cosine); a valley's depth is how far the
similarity lies below the peaks on either side. Going forward, each cut is the deepest valley of the whole
window that the limit allows; of equally deep ones a paragraph end comes first, then the last. Where a window holds no
such boundary, the last line end, clause end or white space is taken, and failing that the limit itself
(never inside a surrogate, combining or joined sequence).

A piece is the text from ``overlap`` characters before the previous cut to its own cut. Pieces are at most
``max_chars`` long, every piece but the first starts with exactly the last ``overlap`` characters of the one
before (its limit permitting), and the pieces without their overlaps concatenate to the text.

Defined results: lengths are code points; null texts and texts within the limit have no pieces here; an
overlap of at least half the limit is lowered to that; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convograph.sources.exports import SESSIONS, session_rows, table

BLOCK = 4  # sentences on either side of a candidate cut
_BOUNDARY = re.compile(r"\n[ \t]*\n\s*|\r?\n(?=[-*•#|>]|\d+[.)] |```)|(?<=[.!?…。！？])[\"'”’)\]]*(?:\s+|(?=[぀-鿿]))|\r?\n")
_WORD = re.compile(r"[^\W_]+")
_FALLBACKS = (re.compile(r"\n"), re.compile(r"(?<=[;:,、，])\s*"), re.compile(r"\s+"))


def boundaries(text: str) -> list[tuple[int, bool]]:
    """(position after the boundary, whether it ends a paragraph), ascending, without the text's ends."""
    out = []
    for m in _BOUNDARY.finditer(text):
        if 0 < m.end() < len(text):
            out.append((m.end(), m.group().count("\n") >= 2))
    return out


def depths(text: str, cuts: list[tuple[int, bool]]) -> list[float]:
    """Depth of the similarity valley at each cut."""
    edges = [0, *(p for p, _ in cuts), len(text)]
    bags = [Counter(w.lower() for w in _WORD.findall(text[a:b]) if len(w) > 3) for a, b in zip(edges, edges[1:])]
    left, right = Counter(), Counter()
    for b in bags[1 : 1 + BLOCK]:
        right.update(b)
    left.update(bags[0])
    similar = []
    for i in range(len(cuts)):
        dot = sum(v * right[k] for k, v in left.items() if k in right)
        norm = sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        similar.append(dot / norm if norm else 0.0)
        left.update(bags[i + 1])
        right.subtract(bags[i + 1])
        if i + 1 + BLOCK < len(bags):
            right.update(bags[i + 1 + BLOCK])
        if i - BLOCK + 1 >= 0:
            left.subtract(bags[i - BLOCK + 1])
        left, right = +left, +right
    # The peak on a side is that of the neighbour as long as the way there doesn't fall.
    left_peak, right_peak = similar[:], similar[:]
    for i in range(1, len(similar)):
        if similar[i - 1] >= similar[i]:
            left_peak[i] = left_peak[i - 1]
    for i in range(len(similar) - 2, -1, -1):
        if similar[i + 1] >= similar[i]:
            right_peak[i] = right_peak[i + 1]
    return [a + b - 2 * s for a, b, s in zip(left_peak, right_peak, similar)]


def _hard_cut(text: str, at: int, low: int) -> int:
    """The position itself, or a little before it where it would part a combined character."""
    while at > low + 1 and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️\n" and text[at - 1] in "\r‍" or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def pieces(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; one piece if the text is within the limit."""
    if len(text) <= max_chars:
        return [(0, len(text))]
    overlap = max(0, min(overlap, max_chars // 2))
    cuts = boundaries(text)
    deep = depths(text, cuts)
    out, start, cut, i = [], 0, 0, 0
    while len(text) - start > max_chars:
        limit = start + max_chars
        while i < len(cuts) and cuts[i][0] <= cut:
            i += 1
        best, j = None, i
        while j < len(cuts) and cuts[j][0] <= limit:
            p, paragraph = cuts[j]
            score = (round(deep[j], 9), paragraph, p)
            best = max(best, score) if best else score
            j += 1
        at = best[2] if best else None
        if at is None:
            for pattern in _FALLBACKS:
                ends = [m.end() for m in pattern.finditer(text, cut, limit) if m.end() > cut]
                if ends:
                    at = ends[-1]
                    break
        at = at or _hard_cut(text, limit, cut)
        out.append((start, at))
        cut, start = at, max(0, at - overlap)
        if start + max_chars <= cut:
            start = cut
    out.append((start, len(text)))
    return out


_PIECES = "tab string, rec_id string, row_key long, piece int, start int, end int, text string"


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [
            (tab, rec, key, k, a, b, text[a:b])
            for tab, rec, key, text, most, over in zip(pdf.tab, pdf.rec_id, pdf.row_key, pdf.text, pdf.max_chars, pdf.overlap_chars)
            for k, (a, b) in enumerate(pieces(text, int(most), int(over)), 1)
        ]
        yield pd.DataFrame(out, columns=["tab", "rec_id", "row_key", "piece", "start", "end", "text"])


def split_oversized(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the texts (``tab, rec_id, row_key, text``) above their table's limit (``table_name, max_chars, overlap_chars``)."""
    bound = limits.groupBy(F.col("table_name").alias("tab")).agg(F.min("max_chars").alias("max_chars"), F.max(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars"))
    large = texts.join(bound, "tab").where(F.length("text") > F.col("max_chars"))
    return large.select("tab", "rec_id", "row_key", "text", "max_chars", "overlap_chars").mapInPandas(_split, _PIECES)


def oversized_pieces(spark: SparkSession, where: str) -> DataFrame:
    """Pieces of ``chunks.text`` and of session messages; every row counts, repeated ids too."""
    chunks = table(spark, where, "chunks").select(F.lit("chunks").alias("tab"), F.col("id").alias("rec_id"), F.col("row_id").cast("long").alias("row_key"), "text")
    lines = session_rows(table(spark, where, SESSIONS)).select(F.lit(SESSIONS).alias("tab"), F.col("line_id").cast("string").alias("rec_id"), F.col("line_no").cast("long").alias("row_key"), "text")
    return split_oversized(chunks.unionByName(lines), table(spark, where, "size_limits"))
