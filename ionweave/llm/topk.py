"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are cut into blocks of bounded size and so are queries; every query block meets every candidate block in
one group. A group sorts each dimension of its candidates once. A query reads its lists from their favourable ends
in growing strides, scores every candidate it meets, and stops when the sum of the last values read, which no unseen
candidate can exceed, is below its k-th score (or nothing is unseen). Each group returns k rows per query; Spark
ranks these.

Vectors that are null, empty or hold null or non-finite components take no part; vectors of different length do not
meet. Components become floor(256 * x) as long integers, sums beyond that range wrap as long arithmetic does. Fewer
candidates than k give fewer rows. Ties go to the smaller vec_id.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionweave.llm.base import by_group, clean_vectors, query, table, written


@dataclass(frozen=True)
class TopKParams:
    k: int = 5
    candidates: int = 4096
    queries: int = 2048
    stride: int = 16


class SortedLists:
    """Candidates of one length with each dimension's order, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")

    def top(self, own: int, q: np.ndarray, k: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates other than ``own``."""
        n = len(self.ids)
        up, down = np.flatnonzero(q < 0), np.flatnonzero(q > 0)      # read ascending where the weight is negative
        if not len(up) + len(down):
            best = np.flatnonzero(self.ids != own)[:k]
            return self.ids[best], np.zeros(len(best), np.int64)
        unseen = self.ids != own
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        a = 0
        while a < n and unseen.any():
            b = min(n, a + stride)
            met = np.zeros(n, bool)
            met[self.order[a:b, up]] = True
            met[self.order[n - b:n - a, down]] = True
            new = np.flatnonzero(met & unseen)
            unseen[new] = False
            best, score = np.concatenate([best, new]), np.concatenate([score, self.vectors[new] @ q])
            first = np.lexsort((best, -score))[:k]                   # places are in order of vec_id
            best, score = best[first], score[first]
            bound = (q[up] * self.vectors[self.order[b - 1, up], up]).sum() + (q[down] * self.vectors[self.order[n - b, down], down]).sum()
            if len(best) == k and bound < score[-1]:
                break
            a, stride = b, 2 * stride
        return self.ids[best], score


def top_k(candidates: DataFrame, queries: DataFrame, params: TopKParams = TopKParams()) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and v (long components)."""
    cand, quer = written(candidates.select("vec_id", "v"), "candidates"), written(queries.select("vec_id", "v"), "queries")
    blocks, chunks = 1 + cand.count() // params.candidates, 1 + quer.count() // params.queries
    hashed = F.xxhash64("vec_id")
    rows = (cand.withColumn("block", F.pmod(hashed, F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
            .withColumn("asks", F.lit(False))
            .unionByName(quer.withColumn("chunk", F.pmod(hashed, F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
                         .withColumn("asks", F.lit(True))))

    def work(_, t: pa.Table) -> pa.RecordBatch:
        out = [[], [], []]
        ids, asks = t["vec_id"].to_numpy(), t["asks"].to_numpy()
        v = t["v"].combine_chunks()
        starts, values = v.offsets.to_numpy(), v.values.to_numpy()
        sizes = np.diff(starts)
        for d in np.unique(sizes):
            same = np.flatnonzero(sizes == d)
            data = values[starts[same][:, None] + np.arange(d)]
            if asks[same].all() or not asks[same].any():
                continue
            lists = SortedLists(ids[same][~asks[same]], data[~asks[same]])
            for own, q in zip(ids[same][asks[same]].tolist(), data[asks[same]], strict=True):
                found, score = lists.top(own, q, params.k, params.stride)
                out[0] += [own] * len(found)
                out[1] += found.tolist()
                out[2] += score.tolist()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    found = by_group(rows, ["block", "chunk"], work, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op3_exact_topk", SQL)
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clean_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", F.expr("transform(embedding, x -> floor(256 * cast(x as double)))").alias("v"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))
