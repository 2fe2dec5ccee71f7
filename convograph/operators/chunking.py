"""Documents → sections → chunks, and the greedy packers. Folds are ``aggregate`` expressions, so no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convograph import config
from convograph.functions.links import chunk_links
from convograph.functions.text import path_id, py_strip, sentences

_STATE = "struct<out:array<string>,cur:string>"


def sections(text: Column) -> Column:
    """Parts that start with a level-2 heading, stripped; what stands before the first is dropped; without any, the whole text."""
    parts = F.split(text, r"(?dUm)(?=^##\s+)")
    headed = F.filter(parts, lambda p: p.rlike(r"(?U)^##\s+"))
    kept = F.when(F.size(headed) > 0, headed).otherwise(F.array(text))
    return F.filter(F.transform(kept, py_strip), lambda s: s != "")


def pack(pieces: Column, most: int, glue: str, charge: int) -> Column:
    """Greedy packing: a piece joins the current pack while ``len(pack) + len(piece) + charge <= most``.

    The charge applies to the first piece of a pack as well; a single larger piece stays whole; empty packs
    are left out.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur")).cast(_STATE)

    def step(s: Column, p: Column) -> Column:
        grown = F.struct(s["out"].alias("out"), F.concat(s["cur"], F.when(s["cur"] != "", F.lit(glue)).otherwise(F.lit("")), p).alias("cur"))
        flushed = F.struct(F.when(s["cur"] != "", F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"), p.alias("cur"))
        return F.when(F.length(s["cur"]) + F.length(p) + charge <= most, grown).otherwise(flushed).cast(_STATE)

    return F.aggregate(pieces, start, step, lambda s: F.when(s["cur"] != "", F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))


def section_pieces(section: Column, most: int = config.MAX_CHUNK_CHARS) -> Column:
    """A section within the limit as it is, else its paragraphs packed."""
    return F.when(F.length(section) <= most, F.array(section)).otherwise(pack(F.split(section, "\n\n"), most, "\n\n", 2))


def chunks(docs: DataFrame, path: str = "path", most: int = config.MAX_CHUNK_CHARS) -> DataFrame:
    """``path, ord, id, text, links, hash`` of each document's chunks; no shuffle."""
    pieces = F.flatten(F.transform(sections(F.col("text")), lambda s: section_pieces(s, most)))
    rows = docs.where(F.col("text").isNotNull()).select(F.col(path).alias("path"), F.posexplode(pieces).alias("ord", "text"))
    return rows.select("path", "ord", F.concat(path_id(F.col("path")), F.lit(":"), F.col("ord")).alias("id"), "text", chunk_links(F.col("text")).alias("links"), F.sha2("text", 256).alias("hash"))


def model_windows(text: Column, most: int = config.MAX_MODEL_CHARS) -> Column:
    """Sentences packed for a model: a sentence joins while ``len(window) + len(sentence) < most``; else the window is kept stripped, even if empty."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur")).cast(_STATE)

    def step(s: Column, p: Column) -> Column:
        grown = F.struct(s["out"].alias("out"), F.concat(s["cur"], F.lit(" "), p).alias("cur"))
        flushed = F.struct(F.concat(s["out"], F.array(py_strip(s["cur"]))).alias("out"), p.alias("cur"))
        return F.when(F.length(s["cur"]) + F.length(p) < most, grown).otherwise(flushed).cast(_STATE)

    return F.aggregate(sentences(text), start, step, lambda s: F.when(s["cur"] != "", F.concat(s["out"], F.array(py_strip(s["cur"])))).otherwise(s["out"]))


def part_numbers(sizes: Column, most: int = config.MAX_FILE_CHARS) -> Column:
    """Part (from 1) of each of a sequence of sizes: a new part starts where the current one, if not empty, would exceed ``most``."""
    state = "struct<parts:array<int>,part:int,total:bigint>"
    start = F.struct(F.array().cast("array<int>").alias("parts"), F.lit(1).alias("part"), F.lit(0).cast("long").alias("total")).cast(state)

    def step(s: Column, n: Column) -> Column:
        full = (F.size(s["parts"]) > 0) & (s["total"] + n > most)
        part = s["part"] + F.when(full, 1).otherwise(0)
        return F.struct(F.concat(s["parts"], F.array(part)).alias("parts"), part.alias("part"), F.when(full, n).otherwise(s["total"] + n).alias("total")).cast(state)

    return F.aggregate(sizes, start, step, lambda s: s["parts"])
