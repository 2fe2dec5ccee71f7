"""Topics and entities of documents: cleaning, validity, scoring around pluggable model providers.

The models themselves aren't available offline. Providers give ``doc_id, surface`` candidates; the built-in
ones (stop-word-delimited phrases, capitalised phrases, hashed embeddings) are deterministic fall-backs in
plain SQL expressions.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convograph import config
from convograph.functions.text import node_name, one_spaced, py_strip, title_case
from convograph.operators.chunking import model_windows
from convograph.session import parallelism


def _without(x: Column, *patterns: str) -> Column:
    for p in patterns:
        x = F.regexp_replace(x, p, "")
    return x


def clean_entity_text(x: Column) -> Column:
    """Links, code and URLs removed, white space collapsed."""
    return one_spaced(_without(x, r"(?d)\[\[.*?\]\]", r"(?s)```.*?```", r"(?d)`.*?`", r"(?U)https?://\S+"))


def clean_topic_text(x: Column) -> Column:
    """As for entities; import lines and Markdown marks go too."""
    body = _without(x, r"(?d)\[\[.*?\]\]", r"(?s)```.*?```", r"(?d)`.*?`", r"(?d)import .*", r"(?d)from .* import .*", r"(?U)https?://\S+")
    return one_spaced(F.regexp_replace(body, r"[#>*_`-]", " "))


def _words(x: Column) -> Column:
    return F.size(F.split(py_strip(x), r"(?U)\s+"))


def valid_entity(x: Column) -> Column:
    """3 characters or more, at most 4 words, a letter, no stop term, no plain verb."""
    e = py_strip(x)
    return (F.length(e) >= 3) & (_words(e) <= 4) & ~F.lower(e).isin(*config.STOP_TERMS, *config.VERBS) & e.rlike(r"\p{L}")


def valid_topic(x: Column) -> Column:
    """4 characters or more, at most 3 words, a letter, no digit, no special character, no stop term or opening."""
    t = F.lower(py_strip(x))
    special = "[" + "".join("\\" + c for c in config.TOPIC_FORBIDDEN) + "]"
    opening = t.startswith(config.TOPIC_OPENINGS[0]) | t.startswith(config.TOPIC_OPENINGS[1]) | t.startswith(config.TOPIC_OPENINGS[2])
    return ~t.isin(*config.STOP_TERMS) & (F.length(t) >= 4) & (_words(t) <= 3) & t.rlike(r"\p{L}") & ~t.rlike(r"\p{Nd}") & ~t.rlike(special) & ~opening


def _regex_hits(window: Column) -> Column:
    return F.concat(F.regexp_extract_all(window, F.lit("(" + config.MODEL_NAME + ")"), 1), F.regexp_extract_all(window, F.lit("(" + config.DOTTED_NAME + ")"), 1))


def _regex_pos(window: Column, i: Column) -> Column:
    return window * 100_000 + i


def regex_entities(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, pos, surface``: model names and dotted names inside each model window, in window order."""
    window = docs.select(key, F.posexplode(model_windows(clean_entity_text(F.col("text")))).alias("win", "w"))
    return window.select(key, "win", F.posexplode(_regex_hits(F.col("w"))).alias("i", "s")).select(key, _regex_pos(F.col("win"), F.col("i")).cast("long").alias("pos"), one_spaced(F.col("s")).alias("surface"))


def scored(candidates: DataFrame, least: int, most: int, key: str = "doc_id") -> DataFrame:
    """``key, ord, display, node, score`` of the best surfaces per document.

    ``candidates``: ``key, pos, surface, points``. Surfaces below ``least`` points are dropped; order is by
    score, ties by first position, then surface; at most ``most`` per document.
    """
    sums = candidates.groupBy(key, "surface").agg(F.sum("points").alias("score"), F.min("pos").alias("first"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "first", "surface")
    top = sums.where(F.col("score") >= least).withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most)
    return top.select(key, "ord", F.col("surface").alias("display"), node_name(F.col("surface")).alias("node"), "score")


def entity_scores(model: DataFrame, regex: DataFrame, key: str = "doc_id", least: int = config.ENTITY_LEAST, most: int = config.ENTITIES_PER_DOC) -> DataFrame:
    """Entities from model hits (2 points each) and regex hits (1 point each)."""
    both = model.withColumn("points", F.lit(2)).unionByName(regex.withColumn("points", F.lit(1)))
    return scored(both.withColumn("surface", one_spaced(F.col("surface"))).where(valid_entity(F.col("surface"))), least, most, key)


def topic_scores(keywords: DataFrame, phrases: DataFrame, key: str = "doc_id", least: int = config.TOPIC_LEAST, most: int = config.TOPICS_PER_DOC) -> DataFrame:
    """Topics from keywords (2 points each) and noun phrases (1 point each), scored by title-cased surface."""
    both = keywords.withColumn("points", F.lit(2)).unionByName(phrases.withColumn("points", F.lit(1)))
    low = both.groupBy(key, one_spaced(F.lower("surface")).alias("low")).agg(F.sum("points").alias("points"), F.min("pos").alias("pos"), F.min(one_spaced(F.lower("surface"))).alias("shown"))
    # ``shown`` keeps the many regular expressions of the filter above the aggregation: once per distinct surface.
    valid = low.where(valid_topic(F.col("shown"))).select(key, "pos", title_case(F.col("shown")).alias("surface"), "points")
    return scored(valid, least, most, key)


# ---------------------------------------------------------------- offline providers
PHRASE_STOPS = (
    "a", "an", "and", "are", "as", "at", "be", "because", "by", "can", "could", "each", "for", "from", "has", "have", "if", "in", "is", "it", "its",
    "may", "might", "must", "my", "no", "not", "of", "on", "one", "or", "our", "should", "since", "so", "that", "the", "their", "then", "there", "these",
    "they", "this", "to", "was", "we", "were", "when", "whenever", "which", "while", "will", "with", "within", "would", "you", "your", "although", "however",
)


_MARK = "\u0001"
_IN_WORD = r"\p{L}\p{M}\p{N}_"


def _phrase_arrays(text: Column, longest: int) -> Column:
    """Runs of up to ``longest`` words between stop words and punctuation."""
    spaced = F.regexp_replace(F.lower(clean_topic_text(text)), f"[^{_IN_WORD}' -]+", f" {_MARK} ")
    words = F.transform(F.filter(F.split(spaced, " "), lambda w: w != ""), lambda w: F.when(w.isin(*PHRASE_STOPS), _MARK).otherwise(w))
    runs = F.transform(F.split(F.array_join(words, " "), _MARK), lambda r: F.trim(r))
    return F.filter(runs, lambda r: (r != "") & (F.size(F.split(r, " ")) <= longest))


def noun_phrases(docs: DataFrame, key: str = "doc_id", longest: int = 3) -> DataFrame:
    """``key, pos, surface``: runs of up to ``longest`` words between stop words and punctuation."""
    return docs.select(key, F.posexplode(_phrase_arrays(F.col("text"), longest)).alias("pos", "surface")).select(key, F.col("pos").cast("long").alias("pos"), "surface")


def _ranked_phrases(docs: DataFrame, key: str, longest: int = 3) -> DataFrame:
    """``key, surface, n, pos, r``: how often each phrase stands in a document, and its rank among them (longer and earlier first).

    Documents move once, to the partitions of their key; all that follows stays there.
    """
    counts = noun_phrases(docs.repartition(parallelism(docs.sparkSession), key), key, longest).groupBy(key, "surface").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    w = Window.partitionBy(key).orderBy((F.col("n") * F.size(F.split("surface", " "))).desc(), "pos", "surface")
    return counts.withColumn("r", F.row_number().over(w))


def keywords(docs: DataFrame, key: str = "doc_id", most: int = 5) -> DataFrame:
    """``key, pos, surface``: the ``most`` phrases of each document that recur most, longer and earlier first."""
    return _ranked_phrases(docs, key).where(F.col("r") <= most).select(key, "pos", "surface")


def own_topics(docs: DataFrame, key: str = "doc_id", least: int = config.TOPIC_LEAST, most: int = config.TOPICS_PER_DOC, keywords_per_doc: int = 5) -> DataFrame:
    """:func:`topic_scores` of :func:`keywords` and :func:`noun_phrases`, from one pass over the texts."""
    points = F.col("n") + F.when(F.col("r") <= keywords_per_doc, 2).otherwise(0)
    valid = _ranked_phrases(docs, key).where(valid_topic(F.col("surface")))
    return scored(valid.select(key, "pos", title_case(F.col("surface")).alias("surface"), points.alias("points")), least, most, key)


_CAPITALISED = rf"[\p{{Ll}},;:] (\p{{Lu}}[{_IN_WORD}-]+(?: \p{{Lu}}[{_IN_WORD}-]+){{0,3}})"


def capitalised_phrases(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, pos, surface``: runs of up to four capitalised words that don't start a sentence."""
    found = F.regexp_extract_all(clean_entity_text(F.col("text")), F.lit(_CAPITALISED), 1)
    return docs.select(key, F.posexplode(found).alias("pos", "surface")).select(key, F.col("pos").cast("long").alias("pos"), "surface")


def own_entities(docs: DataFrame, key: str = "doc_id", least: int = config.ENTITY_LEAST, most: int = config.ENTITIES_PER_DOC) -> DataFrame:
    """:func:`entity_scores` of :func:`capitalised_phrases` and :func:`regex_entities`, from one pass over the texts."""
    cleaned = docs.repartition(parallelism(docs.sparkSession), key).select(key, clean_entity_text(F.col("text")).alias("c"))
    hit = lambda pos, s, points: F.struct(pos.cast("long").alias("pos"), s.alias("surface"), F.lit(points).alias("points"))
    model = F.transform(F.regexp_extract_all("c", F.lit(_CAPITALISED), 1), lambda s, i: hit(i, s, 2))
    regex = F.flatten(F.transform(model_windows(F.col("c")), lambda w, k: F.transform(_regex_hits(w), lambda s, i: hit(_regex_pos(k, i), s, 1))))
    rows = cleaned.select(key, F.inline(F.concat(model, regex))).withColumn("surface", one_spaced(F.col("surface")))
    sums = rows.groupBy(key, "surface").agg(F.sum("points").alias("points"), F.min("pos").alias("pos"))
    return scored(sums.where(valid_entity(F.col("surface"))), least, most, key)


EMBEDDING_SIZE = 64
_EMBED_WORD = re.compile(r"[^\W_]+")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashed_embedding(texts: pd.Series) -> pd.Series:
    """Unit-length vector of signed hashed word counts; all zeros for texts without words, NULL for NULL."""
    out = np.zeros((len(texts), EMBEDDING_SIZE), np.float64)
    for row, text in zip(out, texts):
        for w in _EMBED_WORD.findall((text or "").lower()):
            h = zlib.crc32(w.encode())
            row[h % EMBEDDING_SIZE] += 1.0 if h & 0x10000 else -1.0
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)
    return pd.Series([None if t is None else v for t, v in zip(texts, out.astype(np.float32))])


def union_terms(topics: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, kind, ord, display, node``: topics first, then entities, numbered through."""
    both = topics.withColumn("kind", F.lit("topic")).withColumn("k", F.lit(0)).unionByName(entities.withColumn("kind", F.lit("entity")).withColumn("k", F.lit(1)))
    w = Window.partitionBy(key).orderBy("k", "ord")
    return both.select(key, "kind", F.row_number().over(w).alias("ord"), "display", "node")


def term_arrays(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, terms``: each document's terms in order, ready for link injection (75 at most by the limits above)."""
    packed = terms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "display", "node"))).alias("t"))
    return packed.select(key, F.transform("t", lambda x: F.struct(x["display"].alias("display"), x["node"].alias("node"))).alias("terms"))
