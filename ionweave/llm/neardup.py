"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

1. A document's set is its distinct word shingles, hashed to 64 bits. Sketching throws the set into the coordinates
   in rounds: in an ordinary round every shingle goes to the coordinate its hash picks, in the last rounds all go to
   one coordinate each, so every coordinate is filled. A coordinate keeps the least value of the first round that
   reached it; equal coordinates of two sketches estimate the Jaccard similarity with concentration bounds.
2. Documents with the same set form a class, represented by its smallest doc_id.
3. Bands of coordinates are hashed. Band width follows from the threshold so that a pair at the threshold is missed
   with a probability of at most ``miss``. Classes that share no band with another are settled.
4. The rest is verified on full sets, without listing pairs of a group: shingles are ordered by rarity, so that two
   linked sets share a shingle within their prefixes. Such buckets are cut by set size, and all members are compared with one pivot;
   buckets whose other members are still in several components are compared in blocks of bounded size.
5. Links give components by alternating large-star and small-star steps.

Texts that are null, empty or without words have empty sets and are linked with nothing. Rows without doc_id are
linked with nothing; their component is null and they are kept. Equal rows give equal rows, each kept if its id is
the component's smallest. An empty table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.base import columns_only, query, table, written

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at once.
_CHUNK = 1_000_000


@dataclass(frozen=True)
class NearDupParams:
    """``percent``: least Jaccard similarity in hundredths."""
    words: int = 5
    percent: int = 80
    coordinates: int = 128
    miss: float = 1e-6
    block: int = 256
    #: More candidates than this are found by a shuffle of the documents and not by a broadcast of their ids.
    broadcast_ids: int = 500_000

    @property
    def width(self) -> int:
        """The widest band that keeps the chance to miss a pair at the threshold below ``miss``; 1 if none does."""
        s = self.percent / 100
        return next((r for r in range(self.coordinates, 0, -1) if (1 - s ** r) ** (self.coordinates // r) <= self.miss), 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    batch: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        batch.append((t or "").encode("utf-8", "replace").lower())      # bytes.lower touches A-Z only
        size += len(batch[-1])
        if size >= _CHUNK or k + 1 == len(texts):
            yield from _shingle_sets(batch, words)
            batch, size = [], 0


def _shingle_sets(raws: list[bytes], words: int) -> Iterator[np.ndarray]:
    buf = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    first_byte = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    gap = _SEPARATOR[buf]
    edge = np.flatnonzero(np.diff(gap, prepend=True))                   # starts and ends of words in turn
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        for _ in raws:
            yield np.zeros(0, np.uint64)
        return
    length = ends - starts
    power = np.cumprod(np.full(int(length.max()) + 1, _ODD, np.uint64), dtype=np.uint64)
    inside = ~gap
    at = np.arange(len(buf))[inside]
    h = mixed(np.add.reduceat((buf[inside].astype(np.uint64) + np.uint64(1)) * power[at - np.repeat(starts, length)],
                              np.concatenate([[0], np.cumsum(length)[:-1]]), dtype=np.uint64))
    run = h.copy()
    for k in range(1, words):                                           # run[i]: hash of words i to i + words - 1
        run = mixed(run[:-1] * _ODD + h[k:]) if len(run) > 1 else run[:0]
    first_word = np.searchsorted(starts, first_byte)
    for a, b in zip(first_word[:-1], first_word[1:], strict=True):
        if b - a >= words:
            yield np.unique(run[a:b - words + 1])
        elif b > a:
            one = h[a:a + 1]
            for k in range(a + 1, b):
                one = mixed(one * _ODD + h[k:k + 1])
            yield mixed(one + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def sketch(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: 2 x coordinates rounds at most, earlier rounds take precedence."""
    out = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    t = np.uint64(coordinates)
    done, step = 0, max(1, -(-coordinates // len(shingles)))
    while done < 2 * coordinates:
        rounds = np.arange(done, min(done + step, 2 * coordinates), dtype=np.uint64)[:, None]
        v = mixed(shingles[None, :] + mixed(rounds + np.uint64(1)))
        where = np.where(rounds < t, v % t, rounds % t)
        np.minimum.at(out, where.ravel().astype(np.int64), ((rounds << np.uint64(54)) | (v >> np.uint64(10))).ravel())
        done += step
        if (out != np.iinfo(np.uint64).max).all():
            break
    return out


def band_keys(sketches: np.ndarray, width: int) -> np.ndarray:
    """A key per band of ``width`` coordinates; the band's number is part of the key."""
    bands = sketches.shape[1] // width
    keys = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * _ODD), (len(sketches), bands)).copy()
    for k in range(width):
        keys = mixed(keys * _ODD + sketches[:, k:bands * width:width])
    return keys.view(np.int64)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    m = mixed(shingles)
    return int(m.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(m + _ODD), initial=np.uint64(0)).view(np.int64))


def sketches(docs: DataFrame, params: NearDupParams) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (fingerprint of the set), bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, f1, f2, rows, full = [], [], [], [], []
            for k, s in enumerate(shingle_sets(b["text"].to_pylist(), params.words)):
                sizes.append(len(s))
                a, c = fingerprint(s)
                f1.append(a)
                f2.append(c)
                if len(s):
                    rows.append(sketch(s, params.coordinates))
                    full.append(k)
            keys: list = [None] * len(sizes)
            if rows:
                for k, row in zip(full, band_keys(np.array(rows), params.width), strict=True):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "f1", "f2", "bands"])

    return columns_only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, f1 long, f2 long, bands array<long>")


def full_sets(docs: DataFrame, candidates: DataFrame, params: NearDupParams) -> DataFrame:
    """rep and shingles of the candidate classes, made anew from the whole texts of their representatives."""
    few = candidates.count() <= params.broadcast_ids
    wanted = candidates.select(F.col("rep").alias("doc_id"), F.col("f1").alias("_f1"))
    texts = columns_only(docs, "doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b["text"].to_pylist(), params.words))
            same = [fingerprint(s)[0] == f for s, f in zip(sets, b["_f1"].to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([b["doc_id"], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["rep", "shingles"])
            yield out.filter(pa.array(same, pa.bool_()))

    return texts.select("doc_id", "text", "_f1").mapInArrow(run, "rep long, shingles array<long>").dropDuplicates(["rep"])


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, rep, n) of the shingles that a linked partner must share: the rarest first, as many as the threshold
    leaves out, plus one. Shingles of one document only cannot link; they just fill the prefix."""
    each = sets.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    rows = each.join(shared, "shingle").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    # a set of n needs an overlap of ceil(n * percent / 100); n - overlap + 1 rarest shingles are the prefix
    long = F.expr(f"n - cast(ceil(n * {percent} / 100) as int) + 1 - (n - size(s))")
    return rows.withColumn("_long", long).filter("_long > 0").select(
        F.explode(F.expr("transform(slice(s, 1, _long), x -> x.shingle)")).alias("shingle"), "rep", "n")


def by_size(members: DataFrame, percent: int) -> DataFrame:
    """Buckets cut by set size: linked sets differ in size by the threshold's ratio at most, so they are in the same
    class of that ratio or in neighbouring ones. Each member goes to the two windows of two classes that hold it."""
    ratio = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    size = F.floor(F.ln("n") / ratio).cast("long")
    return members.withColumn("shingle", F.explode(F.array(F.xxhash64("shingle", size - 1), F.xxhash64("shingle", size))))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    a, b = (sets.select(F.col("rep").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(a, "a").join(b, "b").withColumn("_both", both)
            .filter(100 * F.col("_both") >= percent * (F.size("sa") + F.size("sb") - F.col("_both"))).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node. Rounds go on to the fixed point."""
    def counted(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
        return out, (seen.get["n"], seen.get["h"])

    edges, state = counted(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, now = counted(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now


def _unresolved(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members other than the pivot, of the buckets in which these are still in several components; of buckets with
    the same members only one."""
    named = members.filter("rep <> pivot").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mark = F.xxhash64("rep").cast("decimal(38,0)")
    open_ = (named.groupBy("shingle").agg(F.count("*").alias("m"), F.sum(mark).alias("mark"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
             .filter("_lo < _hi").groupBy("m", "mark").agg(F.min("shingle").alias("shingle")).select("shingle", "m"))
    return named.join(open_, "shingle").select("shingle", "m", "rep", "component")


def _gathered(members: DataFrame, params: NearDupParams) -> DataFrame:
    """Buckets that share members, put together where that makes a group of a few blocks: a family of near copies has
    many buckets in common, and its pairs are then compared once. Larger families stay with their single buckets."""
    first = members.groupBy("shingle").agg(F.min("rep").alias("_first"))
    family = components(members.join(first, "shingle").select(F.col("rep").alias("a"), F.col("_first").alias("b"))).withColumnRenamed("component", "_family")
    named = members.join(family.withColumnRenamed("node", "rep"), "rep")
    size = family.groupBy("_family").agg(F.count("*").alias("_m"))
    named = named.join(size, "_family")
    small = F.col("_m") <= 4 * params.block
    return named.select(F.when(small, F.col("_family")).otherwise(F.col("shingle")).alias("shingle"), F.when(small, F.col("_m")).otherwise(F.col("m")).alias("m"),
                        small.alias("_whole"), "rep", "component").distinct()


def _blockwise(members: DataFrame, sets: DataFrame, params: NearDupParams) -> DataFrame:
    """Links between members of a bucket in different components. A bucket is cut into blocks of about ``block``
    members, and every two blocks meet in one group of bounded size, which returns a spanning forest of its links."""
    parts = F.expr(f"cast(ceil(m / {params.block}) as int)")
    own = F.pmod(F.xxhash64("rep"), parts)
    rows = (members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .select("_whole", "shingle", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), "rep", "component")
            .join(sets, "rep").repartition("_whole", "shingle", "lo", "hi").sortWithinPartitions("_whole", "shingle", "lo", "hi"))

    def links(group: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        reps, comps, shingles = zip(*group, strict=True)
        sizes = np.array([len(s) for s in shingles])
        values, column = np.unique(np.concatenate(shingles), return_inverse=True)
        row = np.repeat(np.arange(len(reps)), sizes)
        order = np.argsort(column, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(column))])
        holders = row[order]
        parent = {c: c for c in comps}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        at = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(len(reps)):
            cols = column[at[i]:at[i + 1]]
            both = np.bincount(np.concatenate([holders[cut[c]:cut[c + 1]] for c in cols]), minlength=len(reps))
            for j in np.flatnonzero(100 * both >= params.percent * (sizes[i] + sizes - both)):
                a, b = root(comps[i]), root(comps[j])
                if a != b:
                    parent[a] = b
                    yield reps[i], reps[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group):
            pairs = list(links(group)) if len({c for _, c, _ in group}) > 1 else []
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

        key, group = None, []
        for b in batches:
            sets_ = b["shingles"]
            values, offsets = sets_.values.to_numpy(), sets_.offsets.to_numpy()
            for k, row in enumerate(zip(*(b[c].to_pylist() for c in ("_whole", "shingle", "lo", "hi", "rep", "component")), strict=True)):
                if row[:4] != key:
                    if group:
                        yield out(group)
                    key, group = row[:4], []
                group.append((row[4], row[5], values[offsets[k]:offsets[k + 1]]))
        if group:
            yield out(group)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    sk = written(sketches(docs, params), "sketches")
    classes = written(sk.filter("n > 0 and doc_id is not null").groupBy("n", "f1", "f2")
                      .agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "classes")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    candidates = written(keys.join(shared, "key", "left_semi").select("rep").distinct().join(classes, "rep").select("rep", "f1"), "candidates")
    sets = written(full_sets(docs, candidates, params), "sets")
    members = by_size(prefixes(sets, params.percent), params.percent)
    pivots = members.groupBy("shingle").agg(F.min("rep").alias("pivot"), F.count("*").alias("_n")).filter("_n > 1").select("shingle", "pivot")
    members = written(members.join(pivots, "shingle").select("shingle", "rep", "n", "pivot"), "members")
    sizes = sets.select(F.col("rep").alias("b"), F.size("shingles").alias("nb"))
    pairs = (members.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"), "n").distinct().join(sizes, "b")
             .filter(f"100 * least(n, nb) >= {params.percent} * greatest(n, nb)").select("a", "b"))
    links = written(verified(pairs, sets, params.percent), "links")
    found = components(links)
    open_ = written(_unresolved(members, found), "unresolved")
    more = written(_blockwise(_gathered(open_, params), sets, params), "links")
    found = components(links.unionAll(more))
    named = (classes.select("n", "f1", "f2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
             .select("n", "f1", "f2", F.coalesce("component", "rep").alias("_component")))
    return (sk.drop("bands").join(named, ["n", "f1", "f2"], "left")
            .withColumn("component_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("_component")).otherwise(F.col("doc_id")))
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


@query("op4_near_duplicates")
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDupParams(words=3, percent=85))
