"""Documents packed into as few token sequences as possible by bin completion.

Lengths lie between 1 and the capacity, so the whole corpus is described by a histogram of at most ``capacity``
rows. Bin completion works on that histogram: around the largest remaining length it enumerates the undominated
fillings of the rest, takes the one that wastes least, and applies it as often as the counts allow, so the number
of steps is bounded by the capacity and not by the corpus. Branch and bound then looks for fewer sequences, at every
size: it tries one other choice at each level of this plan with a completion after it, and then goes back along the
best plan and tries, level by level, other fillings and fewer repeats, a filling with its repeats being one level. It
prunes by a lower bound that counts lengths above half the capacity one by one, and ends when the plan meets that bound
or each of the two has taken ``search_nodes`` nodes; a plan above the bound is logged with its gap, as it may
not be the fewest. Spark ranks the pieces of each length and reads a piece's sequence and place off the plan.

A null or empty text is a document of the end id alone. Only documents longer than the capacity are cut. Repeated
rows are packed one by one. No documents give no rows.
"""
from __future__ import annotations

import logging
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionweave.llm.base import columns_only, query, table, written
from ionweave.llm.tokens import default_tokenizer, word_ids


@dataclass(frozen=True)
class PackParams:
    capacity: int = 4096
    end_id: int = 1
    search_nodes: int = 2000
    #: Pieces that one task ranks, about.
    rank_rows: int = 200_000


def fillings(sizes: list[int], counts: dict[int, int], gap: int, most: int, steps: int = 4000) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, sizes) of up to ``most`` undominated fillings of ``gap``, least waste first.

    ``sizes``: the lengths that remain, ascending. Sets are met with large lengths first. A set is dominated if a
    length that remains can take the place of one or two of its members in the room it leaves.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    left = dict(counts)
    budget, best = steps, gap + 1

    def dominated(chosen: list[int], waste: int) -> bool:
        if not waste:
            return False
        sums = set(chosen) | {a + b for i, a in enumerate(chosen) for b in chosen[i + 1:]}
        for s in sums | {0}:
            i = bisect_right(sizes, s + waste) - 1
            while i >= 0 and sizes[i] > s:
                if left[sizes[i]] > 0:
                    return True
                i -= 1
        return False

    def search(room: int, top: int, chosen: list[int]) -> None:
        nonlocal budget, best
        i = bisect_right(sizes, min(room, top)) - 1
        extended = False
        while i >= 0 and budget > 0 and not (best == 0 and len(found) >= most):
            s = sizes[i]
            if left[s] > 0:
                budget -= 1
                extended = True
                left[s] -= 1
                chosen.append(s)
                search(room - s, s, chosen)
                chosen.pop()
                left[s] += 1
            i -= 1
        if not extended or room == 0:
            if not dominated(chosen, room):
                found.append((room, tuple(chosen)))
                best = min(best, room)

    search(gap, gap, [])
    if not found:                                     # the budget ran out within one descent: best fit, largest first
        chosen, room = [], gap
        for s in reversed(sizes):
            n = min(left[s], room // s)
            chosen += [s] * n
            room -= n * s
        found = [(room, tuple(chosen))]
    return sorted(set(found), key=lambda f: (f[0], len(f[1]), [-s for s in f[1]]))[:most]


def completion(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit bin completion of a whole histogram: (sizes of a sequence, how often)."""
    left = {s: n for s, n in counts.items() if n > 0}
    sizes, plan = sorted(left), []
    while sizes:
        top = sizes[-1]
        left[top] -= 1
        waste, rest = fillings(sizes, left, capacity - top, 1)[0]
        left[top] += 1
        pattern = (top, *rest)
        use = {s: pattern.count(s) for s in set(pattern)}
        times = min(left[s] // n for s, n in use.items())
        plan.append((pattern, times))
        for s, n in use.items():
            left[s] -= n * times
        sizes = [s for s in sizes if left[s] > 0]
    return plan


def lower_bound(hist: np.ndarray) -> int:
    """Sequences that the lengths need at least; ``hist``: how often each length from 0 to the capacity occurs.

    For every k up to half the capacity: lengths above capacity - k stand without any of k or more; those above one half
    each need a sequence, and lengths from k to one half fill their room first.
    """
    capacity, half = len(hist) - 1, (len(hist) - 1) // 2
    lengths = np.arange(capacity + 1)
    sums = np.concatenate([[0], np.cumsum(hist * lengths)])
    large = int(hist[half + 1:].sum())
    k = np.arange(half + 1)
    number = np.concatenate([[0], np.cumsum(hist)])
    room = capacity * (number[capacity - k + 1] - number[half + 1]) - (sums[capacity - k + 1] - sums[half + 1])
    over = sums[half + 1] - sums[k] - room
    return large + max(0, int(-(-over.max() // capacity)))


def pack(counts: dict[int, int], capacity: int, search_nodes: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with the fewest sequences found; optimal when it meets the lower bound."""
    plan = completion(counts, capacity)
    best, used = sum(t for _, t in plan), 0
    nodes = search_nodes
    hist = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        hist[s] = n
    least = lower_bound(hist)
    left = dict(counts)

    def apply(pattern: tuple[int, ...], times: int) -> None:
        nonlocal used
        used += times
        for s in pattern:
            left[s] -= times
            hist[s] -= times

    def choices(skip: tuple[tuple[int, ...], int] | None, banned: frozenset, last: tuple[int, ...], most: int) -> Iterator[tuple[tuple[int, ...], int, frozenset]]:
        """Fillings around the largest length with their repeats, and the fillings not to take up again after them: those
        before them, so that an order of fillings is met once. ``last`` may follow itself with ``most`` repeats."""
        sizes = [s for s in sorted(left) if left[s] > 0]
        top = sizes[-1]
        left[top] -= 1
        options = fillings(sizes, left, capacity - top, 50, 500)
        left[top] += 1
        for _, rest in options:
            pattern = (top, *rest)
            if pattern in banned:
                continue
            times = min(left[s] // pattern.count(s) for s in pattern)
            times = min(times, most) if pattern == last else times
            while times > 0:
                if (pattern, times) != skip:
                    yield pattern, times, banned
                times //= 2
            banned |= {pattern}

    at = used = 0
    while at < len(plan) and best > least and nodes > 0:         # one other choice at each level, then completion again
        nodes -= 1
        tries = list(choices(plan[at], frozenset(), (), 0)) if used + lower_bound(hist) < best else []
        for pattern, times, _ in tries:
            if nodes <= 0:
                break
            apply(pattern, times)
            if used + lower_bound(hist) < best:
                rest = completion(left, capacity)
                nodes -= len(rest)
                if used + sum(t for _, t in rest) < best:
                    best, plan = used + sum(t for _, t in rest), [*plan[:at], (pattern, times), *rest]
                    apply(pattern, -times)
                    at = -1
                    break
            apply(pattern, -times)
        if at < 0:                                               # a better plan: from the top
            used = 0
            left.update(counts)
            for s, n in counts.items():
                hist[s] = n
            at = 0
            continue
        apply(*plan[at])
        at += 1
    used, nodes = 0, search_nodes
    left.update(counts)
    for s, n in counts.items():
        hist[s] = n

    path: list[list] = [[None, *step] for step in plan]         # choices left, filling, repeats; the plan is the first descent
    for step in plan if best > least else ():
        apply(*step)
    used = best
    while path and best > least:
        options, pattern, times = path[-1]
        if pattern:
            apply(pattern, -times)
        if used + lower_bound(hist) >= best:
            path.pop()
            continue
        if options is None:
            if nodes <= 0:
                break
            nodes -= 1
            options = path[-1][0] = choices((pattern, times), frozenset(), (), 0)
        for pattern, times, banned in options:
            apply(pattern, times)
            path[-1][1:] = pattern, times
            if used + lower_bound(hist) >= best:
                apply(pattern, -times)
                continue
            if not hist.any():
                best, plan = used, [(p, t) for _, p, t in path]
                apply(pattern, -times)
                continue
            if nodes <= 0:
                path.clear()
                break
            nodes -= 1
            same = left[pattern[0]] > 0
            path.append([choices(None, banned if same else frozenset(), pattern if same else (), times), (), 0])
            break
        else:
            path.pop()
    if best > least:
        logging.getLogger(__name__).warning("%d sequences, lower bound %d: the plan may not be the fewest", best, least)
    return plan


@dataclass(frozen=True)
class Slots:
    """Ranks of a length, cut where the plan goes on to another place: sorted keys (length, first rank)."""
    key: np.ndarray
    times: np.ndarray
    base: np.ndarray
    offset: np.ndarray

    RANKS = 1 << 44

    @classmethod
    def of(cls, plan: list[tuple[tuple[int, ...], int]]) -> Slots:
        rows, next_rank, base = [], {}, 0
        for pattern, times in plan:
            at = 0
            for s in pattern:
                r = next_rank.get(s, 0)
                rows.append((s * cls.RANKS + r, times, base, at, r))
                next_rank[s] = r + times
                at += s
            base += times
        rows.sort()
        a = np.array(rows, np.int64).reshape(-1, 5)
        return cls(a[:, 0], a[:, 1], a[:, 2] - a[:, 4], a[:, 3])

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the piece with this rank among those of its length."""
        i = np.searchsorted(self.key, length * self.RANKS + rank, side="right") - 1
        return self.base[i] + rank, self.offset[i]


def pieces(docs: DataFrame, params: PackParams, tokenizer: str, order: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document, with the ``order`` columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step = word_ids(tokenizer), 4 * params.capacity
        end = params.end_id.to_bytes(4, "little")
        for b in batches:
            rows = []
            places = zip(*(b[c].to_pylist() for c in order), strict=True) if order else [()] * b.num_rows
            for doc_id, ids, place in zip(b["doc_id"].to_pylist(), encoder.of(b["text"].to_pylist()), places, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *place))
            if rows:
                types = (b["doc_id"].type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), *(b[c].type for c in order))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", *order])

    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in order)
    return columns_only(docs, "doc_id", "text", *order).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long{more}")


def pack_documents(docs: DataFrame, params: PackParams = PackParams(), tokenizer: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    With ``order``, columns of ``docs`` of which the first cuts it into stretches (files), the pieces of a length take their places
    in that order, and the rows come out by the first piece of their sequence: the sequences follow the order of the documents.
    """
    spark = docs.sparkSession
    all_pieces = written(pieces(docs, params, tokenizer or default_tokenizer(), order), "pieces")
    counts = {r["length"]: r["n"] for r in all_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}   # at most `capacity` rows
    slots = spark.sparkContext.broadcast(Slots.of(pack(counts, params.capacity, params.search_nodes)))
    parts = 1 + max(counts.values(), default=0) // params.rank_rows
    salted = all_pieces.withColumn("_salt", F.col(order[0]) if order else F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    by = ["length", "_salt"]
    before = (salted.groupBy(*by).agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)))
              .select(*by, F.coalesce("_before", F.lit(0)).alias("_before")))
    ranked = (salted.withColumn("_in", F.row_number().over(W.partitionBy(*by).orderBy(*order, "doc_id", "piece", "ids_crc32")) - 1)
              .join(before, by).withColumn("_rank", (F.col("_before") + F.col("_in")).cast("long")).drop("_salt", "_in", "_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = slots.value.place(b["length"].to_numpy(), b["_rank"].to_numpy())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *order]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*columns, *order).schema)
    placed = ranked.select(*columns, *order, "_rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")
    if order:
        first = F.min(F.struct(*order, "piece")).over(W.partitionBy("sequence_id"))      # as many pieces as the capacity at most
        placed = placed.withColumn("_first", first).repartitionByRange("_first", "sequence_id").sortWithinPartitions("_first", "sequence_id", "offset")
    return placed.select(*columns, "sequence_id", "offset")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
