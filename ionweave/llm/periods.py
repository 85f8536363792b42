"""Periodic runs of words by string synchronising sets.

At scale t = 1, 2, 4 ... a position is selected when the least hash among the t-word contexts of the positions i to i + t
stands at i or i + t. The choice depends on the 2t words from i alone, so it is the same wherever these words stand again.
Contexts with a period of at most t / 3 are left out of the choice: they lie in highly periodic stretches, which smaller scales
have found. For a run of period q, with 3t <= q < 6t, one of these holds:

- one of its selected positions i has its whole context in the run once more, so i + q is selected too and has equal
  context. Equal contexts of selected positions are more than t / 3 apart, so the next 18 occurrences hold it;
- no position is selected, so the first q words and the next q words lie in two highly periodic stretches of one period, and
  these touch or overlap. Every length from 3t that fits into both is proposed, at the end of the first stretch.

Periods 1 and 2 are read off directly. Every proposal is extended both ways as far as words q apart agree, by names of contexts
of 1, 2, 4 ... words (equal names, equal words: nothing rests on a hash), and stands if it reaches twice its period; of equal
stretches the smallest period stays, which the smaller scale has found. Several texts are searched as one sequence whose
words are named per text and whose ends are unique, so that no context goes over an end.

Rows: a null text has no words; a null doc_id leaves its words unchanged; rows that share a doc_id each give a row; further columns
are not read; an empty table gives no rows. No row needs another one, so there is no shuffle. A task holds texts of about ``SLICE``
bytes at once, or a longer text alone, at 8 bytes a word and scale.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ionweave.llm.base import columns_only, query, table

#: Bytes of text searched as one sequence.
SLICE = 2_000_000
#: Equal contexts of selected positions that can follow within six scales.
FOLLOWERS = 18
#: A run is reported from this many words.
LEAST_LENGTH = 12

_NEVER = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 64-bit integers."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` positions lie in one of the intervals [start, end)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


class Contexts:
    """Names of the contexts of 1, 2, 4 ... words from each position. Contexts that stand once have names of their own."""

    def __init__(self, words: np.ndarray):
        self.size = n = len(words)
        self.names: list[np.ndarray] = []
        self.again: list[np.ndarray] = []
        at, key = np.arange(n), words
        while True:
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            more = counts[inverse] > 1
            at, inverse = at[more], inverse[more]
            if not len(at):
                return
            names = np.arange(n, 2 * n + 1)
            names[at] = inverse
            self.names.append(names)
            self.again.append(at)
            width = 1 << (len(self.names) - 1)
            both = at[at + width < n]
            both = both[(names[both + width] < n)]
            at, key = both, names[both] * np.int64(n) + names[both + width]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i equal those from j."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            same = self.names[k][i] == self.names[k][j]
            i[same] += 1 << k
            j[same] += 1 << k
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j; i < j."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            same = (a >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])
            i[same] -= 1 << k
            j[same] -= 1 << k
        return start - i


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i:i + width + 1] for each i with a whole window; ``width`` is a power of two."""
    out, k = values, 1
    while k < width:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[:-1], values[width:])


def selected(contexts: Contexts, level: int, dense: np.ndarray) -> np.ndarray:
    """Synchronising positions of scale 2**level whose context of twice the scale stands again; ``dense`` marks the positions
    with a highly periodic context of the scale."""
    t, at = 1 << level, contexts.again[level + 1]
    order = mixed(contexts.names[level])
    order[:-1][dense] = _NEVER
    least = least_of(order, t)[at]
    return at[(least != _NEVER) & ((order[at] == least) | (order[at + t] == least))]


def equal_pairs(contexts: Contexts, level: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions of equal context, three to six scales apart."""
    t, names = 1 << level, contexts.names[level + 1][chosen]
    order = np.argsort(names, kind="stable")
    at, names, first, second = chosen[order], names[order], [], []
    for lag in range(1, min(FOLLOWERS, len(at) - 1) + 1):
        near = (names[lag:] == names[:-lag]) & (at[lag:] - at[:-lag] < 6 * t)
        if not near.any():
            break
        near &= at[lag:] - at[:-lag] >= 3 * t
        first.append(at[:-lag][near])
        second.append(at[lag:][near])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def stretch_pairs(runs: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals from highly periodic stretches of one period that touch or overlap: the end of the first, and a period before."""
    long = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= 3 * t)]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    a, b = long[:-1], long[1:]
    meet = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1])
    a, b = a[meet], b[meet]
    most = np.minimum(np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]), 6 * t - 1)
    many = most - 3 * t + 1
    second = np.repeat(a[:, 1], many)
    period = 3 * t + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return second - period, second


def runs_of(words: np.ndarray) -> np.ndarray:
    """Every run of ``words`` (numbers, any repeated ones): rows start, end, smallest period; length at least twice the period."""
    contexts = Contexts(words)
    runs = np.zeros((0, 3), np.int64)
    if not contexts.names:
        return runs

    def add(runs: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
        fresh = np.stack([start, end, period], axis=1)[end - start >= 2 * period]
        both = np.concatenate([runs, fresh])
        both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
        first = np.ones(len(both), bool)
        first[1:] = (both[1:, :2] != both[:-1, :2]).any(axis=1)
        return both[first]

    for q in (1, 2):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], contexts.names[0][:-1 - q] == contexts.names[0][q:-1], [False]]).astype(np.int8)))
        runs = add(runs, edges[::2], edges[1::2] + q, np.full(len(edges) // 2, q))
    for level in range(len(contexts.names) - 1):
        t = 1 << level
        small = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
        dense = covered(contexts.size, small[:, 0], small[:, 1] - t + 1)
        first, second = equal_pairs(contexts, level, selected(contexts, level, dense))
        one, two = stretch_pairs(runs, t)
        fits = contexts.names[0][one] == contexts.names[0][two]
        first, second = np.concatenate([first, one[fits]]), np.concatenate([second, two[fits]])
        if len(first):
            runs = add(runs, first - contexts.behind(first, second), second + contexts.ahead(first, second), second - first)
    return runs


def repeated(n: int, doc_id: int | None) -> np.ndarray:
    """The original word at each place of a text: one text in ten repeats a stretch to its end."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together, or a single row."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def report(doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The query's rows of a slice of texts."""
    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    flat, offsets = parts.values, parts.offsets.to_numpy()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[offsets])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    first = np.cumsum(counts) - counts
    source = np.concatenate([np.zeros(0, np.int64), *[f + repeated(n, d) for f, n, d in zip(first.tolist(), counts.tolist(), doc_ids.to_pylist(), strict=True)]])
    doc = np.repeat(np.arange(len(counts)), counts)
    # one sequence: the words of a text, then its end
    place = np.arange(len(source)) + doc
    words = np.zeros(len(source) + len(counts), np.int64)
    words[first + counts + np.arange(len(counts))] = -1 - np.arange(len(counts))
    codes = coded.indices.to_numpy()[source].astype(np.int64)
    words[place] = doc * np.int64(len(coded.dictionary) + 1) + codes
    runs = runs_of(words)
    runs = runs[runs[:, 1] - runs[:, 0] >= LEAST_LENGTH]
    kept = ~covered(len(words), runs[:, 0] + runs[:, 2], runs[:, 1])[place]
    bounds = first + np.arange(len(counts))
    owner = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    rows: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    for d, s, e, q in zip(owner.tolist(), (runs[:, 0] - bounds[owner]).tolist(), (runs[:, 1] - bounds[owner]).tolist(), runs[:, 2].tolist(), strict=True):
        rows[d].append((s, e - s, q))
    ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(counts)])]
    left = coded.dictionary.take(pa.array(codes[kept]))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), left), " ").to_pylist()
    best = [min(r, key=lambda x: (-x[1], x[0], x[2])) if r else None for r in rows]
    listed = ["".join(f"{s},{n},{q}\n" for s, n, q in sorted(r, key=lambda x: (x[0], x[2]))) for r in rows]
    longs = [pa.array([len(r) for r in rows], pa.int64()), *[pa.array([b and b[k] for b in best], pa.int64()) for k in range(3)],
             pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64())]
    sums = [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in x], pa.string()) for x in (listed, joined)]
    return pa.RecordBatch.from_arrays([doc_ids, *longs, *sums], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period, exponent_milli, and digests of all runs and of the words left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False)
            for a, z in slices(sizes, SLICE):
                yield report(b["doc_id"].slice(a, z - a), b["text"].slice(a, z - a))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return columns_only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
                                                                 "runs_sha256 string, collapsed_sha256 string")


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
