"""Files in and out: raw JSON exports, session files, Markdown corpora, and the stored artefacts as Parquet."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convograph.config import COLOR_GROUPS
from convograph.session import cut

GEMINI_SCHEMA = "time string, title string, safeHtmlItem array<struct<html:string>>"
CLAUDE_SCHEMA = "created_at string, name string, chat_messages array<struct<sender:string,created_at:string,content:array<struct<type:string,text:string,thinking:string>>>>"
CHATGPT_SCHEMA = (
    "create_time double, title string, mapping map<string,struct<message:struct<create_time:double,author:struct<role:string>,content:struct<content_type:string,parts:array<string>>>>>"
)
CHUNK_SCHEMA = "id string, text string, source string, links array<string>, hash string"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_export(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Items of a JSON export with ``pos``, their order in it; a missing file gives no rows.

    The export is one JSON array, parsed as a stream, or (``lines``) one item per line, which is split over
    tasks. Items that aren't objects of the schema are left out.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], f"pos long, {schema}")
    items = spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)
    return items.select(F.monotonically_increasing_id().alias("pos"), "*")


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """``path, line_no, line`` of every ``*.jsonl`` under a folder, without ``subagents`` folders.

    Files are read line by line and in splits; a line's number is its place in the split plus the lines of the
    splits before, of which there is one row each.
    """
    if not _exists(spark, root):
        return spark.createDataFrame([], "path string, line_no long, line string")
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    rows = rows.where(~F.array_contains(F.split("path", "/"), "subagents"))
    splits = rows.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.join(splits, ["path", "start"]).select("path", (F.col("offset") + F.col("id") - F.col("first") + 1).alias("line_no"), "line")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of every ``*.md`` under a folder, sorted by path; a missing folder or empty file gives no rows.

    A document is one row, as everywhere.
    """
    if not _exists(spark, root):
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).orderBy("path")


def save_markdown(docs: DataFrame, root: str) -> DataFrame:
    """Writes each document (``path, text``) to its own file under a folder, replacing one of that name; ``path, n_chars``.

    Tasks write their rows' files straight to the shared file system. Rows with a NULL path or text are left out;
    of rows with the same path the last one written stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for pdf in batches:
            for path, text in zip(pdf.path, pdf.text):
                at = f"{base.rstrip('/')}/{path}"
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(at) as out:
                    out.write(text.encode())
            yield pd.DataFrame({"path": pdf.path, "n_chars": pdf.text.str.len().astype("int64")})

    some = docs.where(F.col("path").isNotNull() & F.col("text").isNotNull()).select("path", "text")
    return cut(some.mapInPandas(run, "path string, n_chars long"))


def save_adjacency(neighbors: DataFrame, path: str) -> None:
    """Writes ``node, neighbor, ord`` as JSON objects ``{node: [neighbors in order]}``, one per node and line."""
    lists = neighbors.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "neighbor"))), lambda x: x["neighbor"]).alias("ns"))
    lists.select(F.to_json(F.create_map("node", "ns")).alias("value")).write.mode("overwrite").text(path)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``node, neighbor, ord`` of adjacency JSON: objects ``{node: [neighbors]}``, one per line, with any number of nodes each."""
    maps = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("node", "ns"))
    return maps.select("node", F.posexplode("ns").alias("i", "neighbor")).select("node", "neighbor", (F.col("i") + 1).alias("ord"))


def upsert_color_file(path: str, groups: Iterable[tuple[str, str]] = COLOR_GROUPS) -> bool:
    """Upserts colour groups (query, hex colour) into a small graph-style JSON file; False where there is no such file.

    A group whose query is there gets the colour in its place, others follow in order; all else in the file stays.
    """
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type != fs.FileType.File:
        return False
    with system.open_input_stream(at) as f:
        style = json.loads(f.read())
    held = {g.get("query"): g for g in style.setdefault("colorGroups", [])}
    for query, color in groups:
        if query not in held:
            held[query] = {"query": query}
            style["colorGroups"].append(held[query])
        held[query]["color"] = {"a": 1, "rgb": int(color.lstrip("#"), 16)}
    with system.open_output_stream(at) as f:
        f.write(json.dumps(style, indent=2).encode())
    folder, name = at.rsplit("/", 1)
    if system.get_file_info(f"{folder}/.{name}.crc").type == fs.FileType.File:
        system.delete_file(f"{folder}/.{name}.crc")  # the checksum that Spark keeps beside local files it wrote
    return True


def read_words(spark: SparkSession, path: str, key: str) -> list[str]:
    """The strings of one list of a small YAML file (``key:`` and ``- item`` lines); a bare yes, no, true or false is no string there."""
    lines = [r.value for r in spark.read.text(path).collect()]
    out, inside = [], False
    for line in lines:
        if m := re.match(r"\s*-\s+(.*?)\s*(?:\s#.*)?$", line):
            word = m[1]
            if inside and not re.fullmatch(r"(?i)yes|no|true|false|on|off|~|null|[-+]?[\d.]+", word):
                out.append(word.strip("\"'"))
        elif m := re.match(r"(\w+)\s*:", line):
            inside = m[1] == key
    return out


def save(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrites a stored artefact (chunks, vectors, index, graph, relations, documents, pages)."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def edge_list(rows: DataFrame) -> DataFrame:
    """``node, neighbor`` of an edge list (``source, target``), both directions."""
    return rows.select("source", "target").select(F.inline(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("neighbor")), F.struct(F.col("target").alias("node"), F.col("source").alias("neighbor")))))


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """The rows themselves; an error where there are none."""
    if rows.isEmpty():
        raise ValueError(f"no {what}")
    return rows
