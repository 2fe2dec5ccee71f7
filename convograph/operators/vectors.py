"""Exact inner-product search, one query or many.

A query set is met with all vectors in blocks: both sides are cut into blocks of bounded size by a hash of
their ids, each pair of blocks is one matrix product in one task, and only the best ``k`` of each block leave
it. Nothing is broadcast, since the query set grows with the data; each vector is copied once per block of
queries, so the copies grow with the query set, not with the number of tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convograph import config

BLOCK = 20_000


def _scores(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64", "score": "float64"})
        vectors = vectors.sort_values("id")
        v, ids = np.array(vectors["v"].tolist(), np.float64), vectors["id"].to_numpy()
        out = []
        for at in range(0, len(queries), 512):
            part = queries.iloc[at : at + 512]
            s = np.round(np.array(part["v"].tolist(), np.float64) @ v.T, 6)
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ties go to the smaller id
            out.append(pd.DataFrame({"query": np.repeat(part["id"].to_numpy(), best.shape[1]), "id": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(out)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = config.TOP_K, block: int = BLOCK) -> DataFrame:
    """``query, rank, id, score`` of the ``k`` best vectors of each query; score to 6 places, ties by id.

    Both sides: ``id bigint, v array<float>``; NULL ids and vectors are left out.
    """
    rows = vectors.where("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.where("id IS NOT NULL AND v IS NOT NULL")
    n_v, n_q = (max(1, -(-df.count() // block)) for df in (vectors, queries))  # unfiltered: a stored table answers from its footers
    bucket = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.select("id", "v", bucket(n_q).alias("bq")).withColumn("bv", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
    right = rows.select("id", "v", bucket(n_v).alias("bv")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    local = left.groupBy("bq", "bv").cogroup(right.groupBy("bq", "bv")).applyInPandas(_scores(k), "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def search(vectors: DataFrame, query: list[float], k: int = config.TOP_K) -> DataFrame:
    """``id, score`` of the ``k`` best vectors of one query: a projection and a top-k, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.aggregate(F.zip_with("v", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return vectors.where("v IS NOT NULL").select("id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)
