"""Encoding of texts with a public byte-level BPE tokenizer, and decoding.

Method. Encoding is a monoid: the code of a text is the join of the codes of its halves. Texts above ``LEAF``
characters are halved recursively; leaves are encoded directly. A join re-encodes a window around the seam
that grows on either side until it meets a *firm* place: a white-space character after another character.
Pre-tokenisation is a left-to-right scan in which white space can only stand at the front of a piece, and no
piece looks behind its start, so every scan starts a piece at a firm place whatever lies around it. The tokens
outside the window are therefore final. Decoding concatenates bytes up the same tree.

Defined results: null and empty texts have the empty list of ids; special-token strings inside a text are
ordinary text. The tokenizer's file path is a parameter; vocabulary files are never copied.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convograph.sources.exports import table

LEAF = 16_384
_FIRM = re.compile(r"(?<=\S)\s")


def default_path() -> str:
    """Ranks of ``byte_bpe_50k`` in the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Encoder and decoder over one file of byte-pair ranks."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.direct, self.leaf = self.bpe.encode_ordinary, leaf

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.direct(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """Code of ``left + right`` from the codes of both."""
        p, q = self._firm_before_end(left), self._firm_after_start(right)
        drop_a, drop_b = len(self.direct(left[p:])), len(self.direct(right[:q]))
        return a[: len(a) - drop_a] + self.direct(left[p:] + right[:q]) + b[drop_b:]

    @staticmethod
    def _firm_before_end(text: str) -> int:
        """Last firm place of a text, 0 if it has none; the window doubles until it holds one."""
        width = 64
        while True:
            start = max(0, len(text) - width)
            places = [m.start() for m in _FIRM.finditer(text, start)]
            if places or start == 0:
                return places[-1] if places else 0
            width *= 2

    @staticmethod
    def _firm_after_start(text: str) -> int:
        """First firm place of a text, its end if it has none."""
        m = _FIRM.search(text)
        return m.start() if m else len(text)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self._bytes(ids)).decode("utf-8", "replace")

    def _bytes(self, ids: list[int]) -> list[bytes]:
        if len(ids) <= self.leaf:
            return [self.bpe.decode_bytes(ids)]
        half = len(ids) // 2
        return self._bytes(ids[:half]) + self._bytes(ids[half:])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of each row of ``doc_id, text``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            ids = [encode(t) if t else [] for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of each row of ``doc_id, ids``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``docs`` (with a column ``text``) with ``n_tokens`` in place of the text."""
    path = path or default_path()
    keep = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(sizes, pa.int64())], names=[*(f.name for f in keep), "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField("n_tokens", T.LongType())]))


def document_ids(spark: SparkSession, where: str) -> DataFrame:
    return encoded(table(spark, where, "documents"))
