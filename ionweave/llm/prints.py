"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, before each code point, the sum of (code point + 1) * B**place modulo the prime 2**61 - 1. The
difference of two entries, carried to one power of B, is the hash of the span between them, so equality of any two spans is one
comparison and the longest common extension of two places is found by binary search.

A fingerprint is the number of code points, the hash of the whole text and a sketch: of the distinct spans of ``WINDOW`` code
points that end at each place (from the start of the text where it is nearer), the ``SKETCH`` least hashes, all of them in short
texts. It depends on the text alone. The likeness of two fingerprints is 1 where texts are equal, else the estimated share
2 J / (1 + J) of common spans, J from the least hashes of both together; it is exact where both texts have at most
``SKETCH`` distinct spans.

Edited texts need the next document by descending doc_id. Ranges of doc_id are cut at quantiles of the ids; each range also
receives the first document of the next one, and the last range the first of all, so one exchange of the texts serves everything.
A task streams its range: it holds a document, its follower, and a slice of about ``SLICE`` code points with their arrays, or a longer text.

Rows: a null text is empty; rows with a null doc_id come after all others; rows that share a doc_id follow one another by text;
the only row is followed by itself; further columns are not read; an empty table gives no rows.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ionweave.llm.base import columns_only, query, table

#: Code points in a span, spans in a sketch, bytes of a span's hash in it.
WINDOW, SKETCH, WIDTH = 12, 128, 6
#: Code points hashed at once.
SLICE = 500_000
#: Values the quantiles of ids are accurate to, in ranks: one part of this many.
ACCURACY = 20_000

PRIME = 2**61 - 1
BASE = 1_444_865_926_134_079_451
INVERSE = pow(BASE, -1, PRIME)
_P, _LOW, _THIRTY = np.uint64(PRIME), np.uint64(2**31 - 1), np.uint64(31)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**64."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both below it."""
    ah, al, bh, bl = a >> _THIRTY, a & _LOW, b >> _THIRTY, b & _LOW
    mid = ah * bl + al * bh
    # a * b = ah * bh * 2**62 + mid * 2**31 + al * bl, and 2**61 is 1
    return reduced(((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64(2**30 - 1)) << _THIRTY) + reduced(al * bl))


class Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = np.array([1], np.uint64)
        self.down = np.array([1], np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) <= n:
            k = len(self.up)
            self.up = np.concatenate([self.up, times(self.up, np.uint64(pow(BASE, k, PRIME)))])
            self.down = np.concatenate([self.down, times(self.down, np.uint64(pow(INVERSE, k, PRIME)))])


POWERS = Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def prefixes(points: np.ndarray) -> np.ndarray:
    """The prefix array, one longer than the text."""
    POWERS.reach(len(points))
    terms = times(points.astype(np.uint64) + np.uint64(1), POWERS.up[:len(points)])
    high = np.cumsum(terms >> _THIRTY, dtype=np.uint64)
    low = np.cumsum(terms & _LOW, dtype=np.uint64)
    out = np.zeros(len(points) + 1, np.uint64)
    out[1:] = reduced(times(reduced(high), np.uint64(2**31)) + reduced(low))
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), comparable at any place and between texts."""
    POWERS.reach(len(prefix))
    return times(reduced(prefix[end] + _P - prefix[start]), POWERS.down[start])


def common_extension(prefix: np.ndarray, i: int, j: int, most: int) -> int:
    """How many code points from place i equal those from place j, ``most`` at most, by binary search. Places of two texts are
    compared in the prefix array of their concatenation."""
    up, there = pow(INVERSE, i, PRIME), pow(INVERSE, j, PRIME)
    low, high, a, b = 0, most, int(prefix[i]), int(prefix[j])
    while low < high:
        mid = (low + high + 1) // 2
        if (int(prefix[i + mid]) - a) * up % PRIME == (int(prefix[j + mid]) - b) * there % PRIME:
            low = mid
        else:
            high = mid - 1
    return low


def scrambled(x: np.ndarray) -> np.ndarray:
    """Hashes of spans spread over all bits, of which the first ``WIDTH`` bytes count."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - 8 * WIDTH)


def sketch_of(values: np.ndarray) -> np.ndarray:
    """The least distinct values."""
    if len(values) > 4 * SKETCH:
        # the least values without repeats: look among more of them until enough differ
        many = 2 * SKETCH
        while many < len(values):
            least = np.unique(np.partition(values, many)[:many])
            if len(least) > SKETCH:
                return least[:SKETCH]
            many *= 4
    return np.unique(values)[:SKETCH]


def prints(texts: list[str]) -> tuple[list[str], list[np.ndarray], np.ndarray, list[int]]:
    """Fingerprint and sketch of each text, the prefix array of their concatenation, and where each starts in it."""
    points = [code_points(t) for t in texts]
    sizes = np.array([len(t) for t in points], np.int64)
    starts = np.cumsum(sizes) - sizes
    whole = prefixes(np.concatenate([np.zeros(0, np.uint32), *points]))
    place = np.arange(1, len(whole))
    hashes = scrambled(spans(whole, np.maximum(place - WINDOW, np.repeat(starts, sizes)), place))
    names, sketches = [], []
    for s, n, total in zip(starts.tolist(), sizes.tolist(), spans(whole, starts, starts + sizes).tolist(), strict=True):
        least = sketch_of(hashes[s:s + n])
        raw = least.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH:].tobytes()
        names.append(f"{n}.{total:x}.{base64.urlsafe_b64encode(raw).decode()}")
        sketches.append(least)
    return names, sketches, whole, starts.tolist()


def sketch_in(fingerprint: str) -> np.ndarray:
    """The sketch that a fingerprint holds."""
    raw = np.frombuffer(base64.urlsafe_b64decode(fingerprint.rsplit(".", 1)[1]), np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - WIDTH:] = raw
    return out.view(">u8").reshape(-1).astype(np.uint64)


def alike(name: str, sketch: np.ndarray, other_name: str, other: np.ndarray) -> float:
    """Likeness of two fingerprints, from what they hold."""
    if name == other_name:
        return 1.0
    both = np.concatenate([sketch, other])
    both.sort()
    fresh = np.ones(len(both), bool)
    fresh[1:] = both[1:] != both[:-1]
    count = int(fresh.sum())
    if len(sketch) == SKETCH or len(other) == SKETCH:
        count = min(count, SKETCH)
    if not count:
        return 0.0
    common = int((~fresh & (np.cumsum(fresh) <= count)).sum())
    share = common / count
    return 2 * share / (1 + share)


def likeness(one: str, other: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    return alike(one, sketch_in(one), other, sketch_in(other))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text, or all of them."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def compared(ids: list[int | None], texts: list[str]) -> dict:
    """The query's columns for each text but the last, which only follows."""
    changed = [edited(t, f) for t, f in zip(texts, texts[1:], strict=False)]
    names, sketches, whole, starts = prints(texts + changed)

    def near(k: int, m: int) -> float:
        return alike(names[k], sketches[k], names[m], sketches[m])

    def common(k: int, m: int, other: str) -> int:
        return common_extension(whole, starts[k], starts[m], min(len(texts[k]), len(other)))

    n, rows = len(texts), range(len(changed))
    return {"doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": names[:n - 1], "edited_fingerprint": names[n:], "near_edited": [near(k, n + k) for k in rows], "near_next": [near(k, k + 1) for k in rows],
            "common_edited": [common(k, n + k, changed[k]) for k in rows], "common_next": [common(k, k + 1, texts[k + 1]) for k in rows]}


SCHEMA = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
          "common_edited long, common_next long")


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, _range, _extra: ranges by descending doc_id, numbered from 0, and for each range the first row of the next
    one (of range 0 for the last) as an extra row."""
    spark = docs.sparkSession
    steps = ",".join(repr(k / ranges) for k in range(1, ranges)) or "0.5"
    found = docs.selectExpr("max(doc_id) AS top", f"percentile_approx(doc_id, array({steps}), {ACCURACY}) AS cuts", "count_if(doc_id IS NULL) AS empty").first()
    # tops of the ranges, descending; rows without an id are a range of their own
    tops = sorted({found.top, *(found.cuts or [])} - {None}, reverse=True)
    bounds = np.array(tops[::-1], np.int64)

    @arrow_udf("int")
    def number(ids: pa.Array) -> pa.Array:
        at = len(bounds) - 1 - np.searchsorted(bounds, ids.fill_null(0).to_numpy())
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds), at), pa.int32())

    own = docs.withColumn("_range", number("doc_id")).withColumn("_extra", F.lit(False))
    heads = docs.filter(F.col("doc_id").isNull() | F.col("doc_id").isin(tops)).groupBy("doc_id").agg(F.min("text").alias("text"))
    order = [*tops, *([None] if found.empty else [])]
    before = spark.createDataFrame([(t, (k - 1) % len(order)) for k, t in enumerate(order)], "_top long, _range int")
    # a row per range on both sides
    extra = heads.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("_top"))).select("doc_id", "text", "_range", F.lit(True).alias("_extra"))
    return own.unionByName(extra).repartitionById(max(1, len(order)), "_range")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the longest common prefixes
    common_edited, common_next. ``ranges``: the session's shuffle partitions unless given."""
    own = columns_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, part = [], [], 0, None
        for b in batches:
            for doc_id, text, at in zip(b["doc_id"].to_pylist(), b["text"], b["_range"].to_pylist(), strict=True):
                text = text.as_py()
                if at != part or size >= SLICE and len(ids) > 1:
                    if len(ids) > 1:
                        yield pa.RecordBatch.from_pydict(compared(ids, texts), schema=form)
                    ids, texts = (ids[-1:], texts[-1:]) if at == part else ([], [])
                    size, part = sum(map(len, texts)), at
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if len(ids) > 1:
            yield pa.RecordBatch.from_pydict(compared(ids, texts), schema=form)

    form = pa.schema([("doc_id", pa.int64()), *[(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in (c.split() for c in SCHEMA.split(", "))]])
    return (in_ranges(own, ranges).sortWithinPartitions("_range", "_extra", F.desc_nulls_last("doc_id"), "text").select("doc_id", "text", "_range")
            .mapInArrow(run, f"doc_id long, {SCHEMA}"))


@query("op13_fingerprints")
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
