"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected on a few random directions, shifted, and put on a Hilbert curve; several projections and
shifts give several orderings. An ordering is cut into key ranges of about equal size, by quantiles of a bounded
sample; all vectors are indexed. A query's window is its own range and the ranges beside it. Range partitions hold the
candidates of a range and the queries whose window covers it; each group scores exactly on the original vectors, and
Spark merges the best of all windows.

Near vectors are near on some curve only with a probability. The width of the window is a share of the index, so the
recall does not fall as the index grows; with ``curves`` and ``share`` as set, about nineteen of twenty neighbours of
isotropic vectors of 64 dimensions are found. Ranges larger than ``candidates`` are searched in parts, none is capped.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different length
have indexes of their own and do not meet. Ties go to the smaller vec_id. Fewer candidates than k give fewer rows.
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
class CurveParams:
    """``sample``: vectors that projections and ranges are fitted on at most; below ``ranges`` x 8 vectors the whole
    index is one range."""
    k: int = 20
    curves: int = 8
    dims: int = 4
    bits: int = 8
    ranges: int = 16
    share: float = 0.18
    sample: int = 20_000
    candidates: int = 8192
    queries: int = 2048
    seed: int = 11

    @property
    def reach(self) -> int:
        """Ranges on either side of a query's own."""
        return max(1, round((self.share * self.ranges - 1) / 2))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n x dims, values below 2^bits), all points at once: the coordinates are turned
    into the transposed index by exchanging and inverting low bits, and their bits are interleaved."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass(frozen=True)
class Curves:
    """Fitted orderings of vectors of one length: per curve a projection, the place and size of a cell, and the keys
    that part its ranges."""
    projection: np.ndarray
    origin: np.ndarray
    cell: np.ndarray
    bounds: np.ndarray
    bits: int

    @classmethod
    def fit(cls, sample: np.ndarray, p: CurveParams) -> Curves:
        rng = np.random.default_rng(p.seed)
        d, dims = sample.shape[1], min(p.dims, sample.shape[1])
        projection = np.stack([np.linalg.qr(rng.normal(size=(d, dims)))[0] for _ in range(p.curves)])
        y = np.einsum("nd,cdk->cnk", sample, projection)
        spread = y.std(1) + 1e-12
        cell = 6 * spread / (1 << p.bits)
        origin = y.mean(1) - 3 * spread + rng.uniform(-0.5, 0.5, (p.curves, dims)) * spread
        ranges = p.ranges if len(sample) >= 8 * p.ranges else 1
        keys = cls(projection, origin, cell, np.zeros((p.curves, 0)), p.bits).keys(sample)
        bounds = np.quantile(keys, np.arange(1, ranges) / ranges, axis=0).T if ranges > 1 else np.zeros((p.curves, 0))
        return cls(projection, origin, cell, bounds, p.bits)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """n x curves Hilbert keys."""
        out = []
        for proj, origin, cell in zip(self.projection, self.origin, self.cell, strict=True):
            z = np.clip((vectors @ proj - origin) / cell, 0, (1 << self.bits) - 1).astype(np.int64)
            out.append(hilbert_keys(z, self.bits))
        return np.stack(out, 1)

    def ranges(self, vectors: np.ndarray) -> np.ndarray:
        """n x curves numbers of key ranges."""
        return np.stack([np.searchsorted(b, k, side="right") for b, k in zip(self.bounds, self.keys(vectors).T, strict=True)], 1)


def _matrix(column: pa.Array, dtype=np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, sizes, values) of a list column."""
    starts = column.offsets.to_numpy()
    return starts, np.diff(starts), column.values.to_numpy().astype(dtype)


def neighbours(vectors: DataFrame, asks: str, params: CurveParams = CurveParams()) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, embedding) for which ``asks`` holds."""
    p = params
    clean = written(clean_vectors(vectors).filter(F.exists("embedding", lambda x: x != 0)).withColumn("d", F.size("embedding")).withColumn("asks", F.expr(asks)), "vectors")
    n, nq = clean.count(), clean.filter("asks").count()
    lengths = [r["d"] for r in clean.select("d").distinct().collect()]
    fitted = {}
    for d in lengths:
        rows = clean.filter(F.col("d") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).select("embedding").toArrow()["embedding"].combine_chunks()
        fitted[d] = Curves.fit(_matrix(rows)[2].reshape(-1, d), p)
    shared = clean.sparkSession.sparkContext.broadcast(fitted)          # curves x (ranges + dims x length) numbers
    parts, chunks = 1 + n // (p.ranges * p.candidates), 1 + nq // p.queries

    def place(batches):
        for b in batches:
            starts, sizes, values = _matrix(b["embedding"])
            out = np.zeros((b.num_rows, p.curves), np.int32)
            for d in np.unique(sizes):
                same = np.flatnonzero(sizes == d)
                out[same] = shared.value[int(d)].ranges(values[starts[same][:, None] + np.arange(d)])
            ranges = pa.ListArray.from_arrays(np.arange(0, out.size + 1, p.curves, dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["embedding"], b["d"], b["asks"], ranges], ["vec_id", "embedding", "d", "asks", "ranges"])

    placed = clean.select("vec_id", "embedding", "d", "asks").mapInArrow(place, "vec_id long, embedding array<float>, d int, asks boolean, ranges array<int>")
    on = placed.select("vec_id", "embedding", "d", "asks", F.posexplode("ranges").alias("curve", "range"))
    hashed = F.xxhash64("vec_id")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cand = on.withColumn("asks", F.lit(False)).withColumn("part", F.pmod(hashed, F.lit(parts)).cast("int")).withColumn("chunk", every(chunks))
    window = F.explode(F.sequence(F.greatest(F.lit(0), F.col("range") - p.reach), F.least(F.lit(p.ranges - 1), F.col("range") + p.reach)))
    ask = on.filter("asks").withColumn("range", window).withColumn("chunk", F.pmod(hashed, F.lit(chunks)).cast("int")).withColumn("part", every(parts))
    rows = cand.unionByName(ask)

    def work(_, t: pa.Table) -> pa.RecordBatch:
        out = [[], [], []]
        ids, asking, d = t["vec_id"].to_numpy(), t["asks"].to_numpy(), t["d"][0].as_py()
        data = _matrix(t["embedding"].combine_chunks())[2].reshape(-1, d)
        c_ids, c, q_ids, q = ids[~asking], data[~asking], ids[asking], data[asking]
        order = np.argsort(c_ids, kind="stable")
        c_ids, c = c_ids[order], c[order]
        if len(c) and len(q):
            scores = q @ c.T
            scores[q_ids[:, None] == c_ids[None, :]] = -np.inf
            spare = min(p.k + 4, len(c))                                # room for the last digit of the product
            some = np.argpartition(-scores, spare - 1, axis=1)[:, :spare]
            for i, own in enumerate(q_ids.tolist()):
                j = some[i]
                edge = scores[i, j].min()
                j = np.flatnonzero(scores[i] >= edge) if np.isfinite(edge) else j[np.isfinite(scores[i, j])]   # all ties at the edge
                exact = (c[j] * q[i]).sum(1)
                best = np.lexsort((c_ids[j], -exact))[:p.k]
                out[0] += [own] * len(best)
                out[1] += c_ids[j][best].tolist()
                out[2] += exact[best].tolist()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = by_group(rows, ["d", "curve", "range", "part", "chunk"], work, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= p.k).dropDuplicates(["query_id", "vec_id"])
            .select("query_id", "rank", "vec_id", "score"))


@query("op10_neighbours")
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
