"""Token ids in binary files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A file is a table of frames; a frame holds consecutive documents of one task. Its ids are cut into blocks. Every
block starts from an empty model, so blocks are coded side by side, one numpy lane each. Per id the model has

* order 2: the id last seen after the two ids before, with a confidence;
* order 1: the id last seen after the id before, with a confidence;
* order 0: the histogram of the frame, stored with it, and how often the block's predictions came true at all.

The two confidences pick adaptive hit rates; these are mixed with the rates of order 0 by a weight that moves
towards whichever did better. The mixed rates drive a carryless 64-bit range coder: one step says which prediction
held, and if none, a second codes the id from the histogram. All arithmetic is in integers, so any machine decodes
what another wrote. The checksum of each block is compared on reading.

Ids must be below 2^28. Null and empty texts have the end id alone. Null doc_ids come first; rows with the same
doc_id are all kept, ordered by their texts. An empty table gives no frames.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.base import columns_only, new_folder, query, table
from ionweave.llm.tokens import default_tokenizer, word_ids

MAGIC = b"IDF1"
ORDER0_BITS, FLAG_BITS = 20, 12
_U = np.uint64


@dataclass(frozen=True)
class CoderParams:
    end_id: int = 2
    block: int = 1024
    frame: int = 4_000_000


class Model:
    """Predictions of every lane; ``lanes`` shrinks when the last, shorter block ends."""
    SLOTS1, SLOTS2 = 512, 512

    def __init__(self, lanes: int):
        self.table1 = np.zeros(lanes * self.SLOTS1, np.uint32)          # id, and above bit 28 the confidence
        self.table2 = np.zeros(lanes * self.SLOTS2, np.uint32)
        self.base1 = np.arange(lanes, dtype=np.int64) * self.SLOTS1
        self.base2 = np.arange(lanes, dtype=np.int64) * self.SLOTS2
        self.rate2 = np.full(lanes * 32, 1024, np.int32)                # hit rates by context, of 4096
        self.rate1 = np.full(lanes * 32, 1024, np.int32)
        self.all2 = np.full(lanes, 512, np.int32)                       # hit rates of order 0
        self.all1 = np.full(lanes, 512, np.int32)
        self.weight = np.full(lanes, 2048, np.int32)
        self.base32 = np.arange(lanes, dtype=np.int64) * 32
        self.prev1 = np.zeros(lanes, np.int64)
        self.prev2 = np.zeros(lanes, np.int64)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The predicted ids of order 2 and 1, and the shares of 4096 their coming true gets; 0 where there is none."""
        p1, p2 = self.prev1[:n], self.prev2[:n]
        self.slot1 = self.base1[:n] + (((p1 * 40503) >> 4) & (self.SLOTS1 - 1))
        self.slot2 = self.base2[:n] + (((p1 * 40503 + p2 * 60493) >> 5) & (self.SLOTS2 - 1))
        e1, e2 = self.table1[self.slot1], self.table2[self.slot2]
        c1, c2 = e1 >> 28, e2 >> 28
        id1, id2 = e1 & 0xFFFFFFF, e2 & 0xFFFFFFF
        has2 = c2 > 0
        has1 = (c1 > 0) & ~(has2 & (id1 == id2))
        self.context = self.base32[:n] + ((c2 << 2) + c1 + (has1 << 4))
        self.r2, self.r1 = self.rate2[self.context], self.rate1[self.context]
        w, a2, a1 = self.weight[:n], self.all2[:n], self.all1[:n]
        s2 = a2 + ((w * (self.r2 - a2)) >> 12)
        s1 = a1 + ((w * (self.r1 - a1)) >> 12)
        f2 = np.minimum(np.maximum(s2, 8), 3600) * has2
        f1 = (((4096 - f2) * np.minimum(np.maximum(s1, 8), 3600)) >> 12) * has1
        self.e1, self.e2, self.id1, self.id2, self.has1, self.has2 = e1, e2, id1, id2, has1, has2
        return id2, id1, f2, f1

    def update(self, n: int, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """``x``: the ids; ``hit2``, ``hit1``: whether they were coded by a prediction."""
        y2, y1 = hit2.astype(np.int32) << 12, hit1.astype(np.int32) << 12
        a2, a1 = self.all2[:n], self.all1[:n]
        better = np.abs(y2 - a2) - np.abs(y2 - self.r2)                 # how much nearer the context's rate was
        w = self.weight[:n]
        self.weight[:n] = np.minimum(np.maximum(w + (better >> 5), 256), 3840)
        self.rate2[self.context] = self.r2 + ((y2 - self.r2) >> 4)
        asked = ~hit2
        self.rate1[self.context] = self.r1 + ((y1 - self.r1) >> 4) * asked
        self.all2[:n] = a2 + ((y2 - a2) >> 6)
        self.all1[:n] = a1 + ((y1 - a1) >> 6) * asked
        x32 = x.astype(np.uint32)
        self.table1[self.slot1] = self._entry(self.e1, self.id1, x32)
        self.table2[self.slot2] = self._entry(self.e2, self.id2, x32)
        self.prev2[:n] = self.prev1[:n]
        self.prev1[:n] = x

    @staticmethod
    def _entry(entry: np.ndarray, predicted: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A right prediction gains confidence up to 3; a wrong one is replaced when its confidence is spent."""
        conf = entry >> 28
        right = predicted == x
        gain = np.minimum(conf + 1, 3)
        keep = ~right & (conf > 1)
        return np.where(keep, predicted, x) | (np.where(right, gain, np.where(keep, conf - 1, 1)).astype(np.uint32) << np.uint32(28))


def order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their shares of 2^20, at least 1 each."""
    values, counts = np.unique(ids, return_counts=True)
    room = (1 << ORDER0_BITS) - len(values)
    share = 1 + counts * room // max(1, counts.sum())
    if len(share):
        share[np.argmax(counts)] += (1 << ORDER0_BITS) - share.sum()
    return values.astype(np.uint32), share.astype(np.uint32)


def _settle(low: np.ndarray, span: np.ndarray) -> Iterator[np.ndarray]:
    """Yields the lanes whose next 16 bits are certain, until every range is wide enough again; shifts them out."""
    every = None
    while True:
        a, r = (low, span) if every is None else (low[every], span[every])
        same = ((a ^ (a + r)) >> _U(48)) == 0
        thin = ~same & (r < _U(1 << 32))
        go = np.flatnonzero(same | thin)
        if not len(go):
            return
        lanes = go if every is None else every[go]
        cut = thin[go]
        if cut.any():
            t = lanes[cut]
            span[t] = (~low[t] + _U(1)) & _U(0xFFFFFFFF)
        yield lanes
        low[lanes] <<= _U(16)
        span[lanes] <<= _U(16)
        every = lanes


def encode_blocks(ids: np.ndarray, block: int, values: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """The 16-bit words of each block of ``ids``."""
    count = -(-len(ids) // block)
    if not count:
        return []
    grid = np.zeros(count * block, np.int64)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(count, block).T)
    last = len(ids) - (count - 1) * block
    below = np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.uint64)
    table = np.zeros((int(values[-1]) + 1, 2), np.uint32)
    table[values, 0], table[values, 1] = share, below
    wide, start0 = table[grid, 0], table[grid, 1]
    model = Model(count)
    low, span = np.zeros(count, np.uint64), np.full(count, 0xFFFFFFFFFFFFFFFF, np.uint64)
    words = np.zeros((count, 3 * block + 8), np.uint16)
    at = np.zeros(count, np.int64)
    for t in range(block):
        n = count if t < last else count - 1
        if not n:
            break
        x = grid[t, :n]
        id2, id1, f2, f1 = model.predict(n)
        hit2 = (id2 == x) & (f2 > 0)
        hit1 = (id1 == x) & (f1 > 0) & ~hit2
        miss = ~(hit2 | hit1)
        start = np.where(hit2, 0, np.where(hit1, f2, f2 + f1)).astype(np.uint64)
        width = np.where(hit2, f2, np.where(hit1, f1, 4096 - f2 - f1)).astype(np.uint64)
        lo, sp = low[:n], span[:n]
        r = sp >> _U(FLAG_BITS)
        lo += r * start
        r *= width
        r0 = r >> _U(ORDER0_BITS)
        lo += r0 * start0[t, :n] * miss
        sp[:] = np.where(miss, r0 * wide[t, :n], r)
        model.update(n, x, hit2, hit1)
        for lanes in _settle(lo, sp):
            words[lanes, at[lanes]] = lo[lanes] >> _U(48)
            at[lanes] += 1
    for k in range(4):
        words[np.arange(count), at] = (low >> _U(48 - 16 * k)) & _U(0xFFFF)
        at += 1
    return [w[:k].copy() for w, k in zip(words, at, strict=True)]


def decode_blocks(blocks: list[np.ndarray], total: int, block: int, values: np.ndarray, share: np.ndarray) -> np.ndarray:
    count = len(blocks)
    if not count:
        return np.zeros(0, np.int64)
    last = total - (count - 1) * block
    size = np.array([len(w) for w in blocks])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    words = np.concatenate([*blocks, np.zeros(8, np.uint16)]).astype(np.uint64)
    below = np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.uint64)
    lookup = np.repeat(np.arange(len(values)), share)
    share = share.astype(np.uint64)
    model = Model(count)
    low, span = np.zeros(count, np.uint64), np.full(count, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = np.zeros(count, np.uint64)
    at = first.copy()
    for _ in range(4):
        code = (code << _U(16)) | words[at]
        at += 1
    grid = np.zeros((block, count), np.int64)
    for t in range(block):
        n = count if t < last else count - 1
        if not n:
            break
        id2, id1, f2, f1 = model.predict(n)
        lo, sp = low[:n], span[:n]
        r = sp >> _U(FLAG_BITS)
        v = np.minimum((code[:n] - lo) // r, _U(4095)).astype(np.int32)
        f21 = f2 + f1
        hit2 = v < f2
        hit1 = ~hit2 & (v < f21)
        miss = v >= f21
        start = np.where(hit2, 0, np.where(hit1, f2, f21)).astype(np.uint64)
        width = np.where(hit2, f2, np.where(hit1, f1, 4096 - f21)).astype(np.uint64)
        lo += r * start
        r *= width
        r0 = r >> _U(ORDER0_BITS)
        k = lookup[np.minimum((code[:n] - lo) // r0, _U((1 << ORDER0_BITS) - 1)).astype(np.int64)]
        lo += r0 * below[k] * miss
        sp[:] = np.where(miss, r0 * share[k], r)
        x = np.where(hit2, id2, np.where(hit1, id1, values[k])).astype(np.int64)
        grid[t, :n] = x
        model.update(n, x, hit2, hit1)
        for lanes in _settle(lo, sp):
            code[lanes] = (code[lanes] << _U(16)) | words[at[lanes]]
            at[lanes] += 1
    return np.ascontiguousarray(grid.T).reshape(-1)[:total]


def encode_frame(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, params: CoderParams) -> bytes:
    """Header, documents, histogram, block directory (words, checksum), words. All numbers little-endian."""
    if len(ids) and int(ids.max()) >= 1 << 28:
        raise ValueError("ids must be below 2^28")
    values, share = order0(ids)
    blocks = encode_blocks(ids, params.block, values, share)
    sums = [zlib.crc32(ids[i:i + params.block].astype("<u4").tobytes()) for i in range(0, len(ids), params.block)]
    head = struct.pack("<4sIQIII", MAGIC, len(doc_ids), len(ids), params.block, len(blocks), len(values))
    parts = [head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
             np.array(lengths, "<u4").tobytes(), values.astype("<u4").tobytes(), share.astype("<u4").tobytes(),
             np.array([len(b) for b in blocks], "<u4").tobytes(), np.array(sums, "<u4").tobytes(), *[b.astype("<u2").tobytes() for b in blocks]]
    return b"".join(parts)


def decode_frame(frame: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document; raises ValueError if a block's checksum differs."""
    magic, docs, total, block, count, kinds = struct.unpack_from("<4sIQIII", frame)
    if magic != MAGIC:
        raise ValueError("not a frame of token ids")
    at = struct.calcsize("<4sIQIII")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(frame, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, null, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    values, share, size, sums = take("<u4", kinds), take("<u4", kinds), take("<u4", count), take("<u4", count)
    ids = decode_blocks([take("<u2", int(n)) for n in size], total, block, values, share)
    for k, s in enumerate(sums.tolist()):
        if zlib.crc32(ids[k * block:(k + 1) * block].astype("<u4").tobytes()) != s:
            raise ValueError(f"block {k} is damaged")
    first = 0
    for d, missing, n in zip(doc_ids.tolist(), null.tolist(), lengths.tolist(), strict=True):
        yield None if missing else d, ids[first:first + n]
        first += n


def write_ids(docs: DataFrame, path: str, params: CoderParams = CoderParams(), tokenizer: str | None = None) -> None:
    """Encodes every text, ascending by doc_id, into frames below ``path``. Spark's writer commits the files, so a
    task that is run again after a loss leaves no second copy."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(tokenizer), params.end_id.to_bytes(4, "little")
        part, before = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal before, held, size
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            frame = encode_frame([d for d, _ in held], [len(x) // 4 for _, x in held], ids, params)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()),
                                              "n_ids": pa.array([len(ids)], pa.int64()), "frame": pa.array([frame], pa.binary())})
            before += len(ids)
            held, size = [], 0
            return out

        for b in batches:
            for d, ids in zip(b["doc_id"].to_pylist(), encoder.of(b["text"].to_pylist()), strict=True):
                held.append((d, ids + end))
                size += len(ids) // 4 + 1
                if size >= params.frame:
                    yield flush()
        if held:
            yield flush()

    own = columns_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    ordered = own.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, "part int, before long, n_ids long, frame binary").write.option("compression", "none").parquet(path)


def _read(spark: SparkSession, path: str, fields: str, row: Callable[[np.ndarray], tuple]) -> DataFrame:
    frames = spark.read.parquet(path)
    totals = sorted((r["part"], r["n"]) for r in frames.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())   # one number per task that wrote
    base, first = {}, 0
    for part, n in totals:
        base[part] = first
        first += n
    schema = f"doc_id long, start long, {fields}"
    kinds = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for b in batches:
            for k in range(b.num_rows):
                at, rows = base[b["part"][k].as_py()] + b["before"][k].as_py(), []
                for d, ids in decode_frame(b["frame"][k].as_py()):
                    rows.append((d, at, *row(ids)))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return frames.select("part", "before", "frame").mapInArrow(run, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids."""
    return _read(spark, path, "ids array<int>", lambda ids: (ids.astype(np.int32),))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, computed where the ids are decoded."""
    return _read(spark, path, "n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())))


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)
