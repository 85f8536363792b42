"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5, with boundary marks) and itself, hashed into buckets. A bucket
has an embedding; a word is the mean of its buckets, a document the mean of its words, and a softmax layer reads
the document vector. Embeddings and layer are trained together in numpy on a bounded sample of labelled rows, so
a misspelling that was never seen shares the vectors of its n-grams. As every step up to the softmax is linear,
scoring needs one number per bucket; tasks keep the numbers of words they have met.

Null and empty texts, and texts without words, are scored by the bias alone. Repeated rows are scored alike.
A document labelled more than once counts as toxic if one label says so; null labels are left out. With no
usable label of one of the classes, every score is the share of toxic labels (0 without labels).
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.base import columns_only, query, table, written

WORD = re.compile(r"[^\W_]+")
SIZES = (3, 4, 5)


@dataclass(frozen=True)
class ToxicityParams:
    """``sample``: labelled rows of each class that the model is trained on at most. Buckets that do not tell the
    classes apart stay at zero: those whose document frequencies differ by less than ``contrast`` (phi coefficient)
    or four standard errors; the ``features`` that differ most are trained."""
    sample: int = 1500
    buckets: int = 1 << 17
    contrast: float = 0.146
    features: int = 4096
    dim: int = 4
    steps: int = 200
    rate: float = 0.05
    decay: float = 1e-3
    seed: int = 7


def word_buckets(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of every n-gram of every word, the whole word included."""
    marked = "".join(f"<{w}>\0" for w in words)
    chars = np.frombuffer(marked.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    ends = np.flatnonzero(chars == 0)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    own = np.repeat(np.arange(len(ends)), ends - starts + 1)
    left = np.repeat(ends, ends - starts + 1) - np.arange(len(chars))   # characters up to the mark that ends the word
    step = np.uint64(0x9E3779B97F4A7C15)
    found, h = [], np.zeros(len(chars), np.uint64)
    for n in range(1, max(SIZES) + 1):
        h[:len(chars) - n + 1] = h[:len(chars) - n + 1] * step + chars[n - 1:] + np.uint64(1)
        if n in SIZES:
            keep = left >= n
            found.append((own[keep], h[keep] ^ np.uint64(n)))
    whole = np.zeros(len(ends), np.uint64)
    power = np.cumprod(np.full(int((ends - starts).max(initial=0)) + 1, np.uint64(0xD6E8FEB86659FD93), np.uint64), dtype=np.uint64)
    if len(ends):
        whole = np.add.reduceat(chars * power[np.arange(len(chars)) - np.repeat(starts, ends - starts + 1)], starts, dtype=np.uint64)
    found.append((np.arange(len(ends)), whole))
    own, h = (np.concatenate(x) for x in zip(*found, strict=True))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return own, ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def document_buckets(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and their weights, which add up to one."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct, times = np.unique(np.array(words, dtype=object), return_counts=True)
    own, bucket = word_buckets(list(distinct), buckets)
    share = times / times.sum() / np.bincount(own, minlength=len(distinct))
    total = np.bincount(bucket, weights=share[own], minlength=buckets)
    kept = np.flatnonzero(total)
    return kept, total[kept]


@dataclass
class ToxicityModel:
    """``value``: the toxic logit minus the other, by bucket; ``bias`` likewise."""
    value: np.ndarray
    bias: float


def tell_apart(counts: np.ndarray, n: np.ndarray, params: ToxicityParams) -> np.ndarray:
    """The buckets to train, ascending; ``counts``: documents of each class that hold a bucket, ``n``: documents of each class."""
    frequency = [counts[c] / n[c] for c in (0, 1)]
    mean = (frequency[0] + frequency[1]) / 2
    z = np.abs(frequency[1] - frequency[0]) / np.sqrt(mean * (1 - mean) * (1 / n[0] + 1 / n[1]) + 1e-9)
    least = min(max(4.0, params.contrast * n.sum() ** 0.5), 8.0)
    chosen = np.argsort(-z, kind="stable")[:params.features]
    return np.sort(chosen[z[chosen] >= least])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, params: ToxicityParams) -> ToxicityModel:
    """The model of whole bags."""
    n = np.bincount(labels, minlength=2)
    counts = np.zeros((2, params.buckets), np.int64)
    for (b, _), k in zip(bags, labels, strict=True):
        counts[k, b] += 1
    chosen = tell_apart(counts, n, params) if n.all() else np.zeros(0, np.int64)
    return train_chosen([narrow(b, w, chosen) for b, w in bags], labels, chosen, prior, params)


def narrow(b: np.ndarray, w: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a bag holds of the ``chosen`` buckets, by their places there."""
    at = np.searchsorted(chosen, b)
    kept = np.flatnonzero(at < len(chosen))
    kept = kept[chosen[at[kept]] == b[kept]]
    return at[kept], w[kept]


def train_chosen(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, chosen: np.ndarray, prior: float, params: ToxicityParams) -> ToxicityModel:
    """Adam on the mean cross-entropy over all narrowed bags. Classes are weighted alike; the bias then moves to ``prior``."""
    share = min(max(prior, 1e-6), 1 - 1e-6)
    shift = float(np.log(share / (1 - share)))
    n = np.bincount(labels, minlength=2)
    if not n.all():
        return ToxicityModel(np.zeros(params.buckets, np.float32), shift)
    x = np.zeros((len(bags), len(chosen)), np.float32)
    for row, (b, w) in zip(x, bags, strict=True):
        row[b] = w
    scale = np.sqrt(np.einsum("ij,ij->j", x, x) / np.float32(len(x))) + np.float32(1e-9)
    x /= scale
    rng = np.random.default_rng(params.seed)
    emb = rng.normal(0, 0.1, (len(chosen), params.dim)).astype(np.float32)
    layer = rng.normal(0, 0.5, (params.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    want = np.eye(2, dtype=np.float32)[labels]
    each = (0.5 / n)[labels].astype(np.float32)[:, None]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, layer, bias)]
    for t in range(1, params.steps + 1):
        vec = x @ emb
        logits = vec @ layer + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - want) * each
        grads = [x.T @ (g @ layer.T) + params.decay * emb, vec.T @ g, g.sum(0)]
        for param, grad, (m, v) in zip((emb, layer, bias), grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            param -= params.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    value = np.zeros(params.buckets, np.float32)
    value[chosen] = emb @ (layer[:, 1] - layer[:, 0]) / scale
    return ToxicityModel(value, float(bias[1] - bias[0]) + shift)


class WordValues(dict):
    """Word -> mean value of its buckets; at most ``most`` words are kept."""
    #: New words whose n-grams are held at once.
    CHUNK = 8192

    def __init__(self, model: ToxicityModel, most: int = 200_000):
        super().__init__()
        self.model, self.most = model, most

    def learn(self, words: set[str]) -> None:
        if len(self) > self.most:
            self.clear()
        missing = [w for w in words if w not in self]
        for i in range(0, len(missing), self.CHUNK):
            new = missing[i:i + self.CHUNK]
            own, bucket = word_buckets(new, len(self.model.value))
            n = np.bincount(own, minlength=len(new))
            self.update(zip(new, (np.bincount(own, weights=self.model.value[bucket], minlength=len(new)) / n).tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        lists = [WORD.findall((t or "").lower()) for t in texts]
        self.learn(set().union(*lists))
        get = self.__getitem__
        z = np.array([sum(map(get, x)) / len(x) if x else 0.0 for x in lists]) + self.model.bias
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()


def fit(sampled: DataFrame, prior: float, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Trains on (text, toxic) rows, a bounded sample: tasks turn them into bags and count their buckets; the driver gets the counts,
    chooses the buckets, and trains on what the bags hold of these."""
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [document_buckets(t, params.buckets) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": b["toxic"].cast(pa.int32()), "b": pa.array([x.astype(np.int32) for x, _ in pairs], pa.list_(pa.int32())),
                                              "w": pa.array([x.astype(np.float32) for _, x in pairs], pa.list_(pa.float32()))})

    rows = written(sampled.select("text", "toxic").mapInArrow(bags, "toxic int, b array<int>, w array<float>"), "bags")
    n = np.zeros(2, np.int64)
    for k, times in rows.groupBy("toxic").count().collect():
        n[k] = times
    counts = np.zeros((2, params.buckets), np.int64)
    if n.all():
        held = rows.select("toxic", F.explode("b").alias("b")).groupBy("toxic", "b").count().toArrow()     # twice the buckets at most
        counts[held["toxic"].to_numpy(), held["b"].to_numpy()] = held["count"].to_numpy()
        chosen = tell_apart(counts, n, params)
    else:
        chosen = np.zeros(0, np.int64)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [(np.asarray(b.values), np.asarray(w.values)) for b, w in zip(batch["b"], batch["w"], strict=True)]
            pairs = [narrow(b, w, chosen) for b, w in whole]
            yield pa.RecordBatch.from_pydict({
                "toxic": batch["toxic"], "n": pa.array([len(b) for b, _ in whole], pa.int32()), "head": pa.array([b[:16].tobytes() for b, _ in whole], pa.binary()),
                "b": pa.array([b.astype("<i4").tobytes() for b, _ in pairs], pa.binary()), "w": pa.array([w.astype("<f4").tobytes() for _, w in pairs], pa.binary())})

    got = rows.mapInArrow(narrowed, "toxic int, n int, head binary, b binary, w binary").toArrow()
    out = sorted(zip(*(got[c].to_pylist() for c in got.column_names), strict=True))        # the same order whichever task was first
    return train_chosen([(np.frombuffer(b, "<i4"), np.frombuffer(w, "<f4")) for *_, b, w in out], np.array([k for k, *_ in out], np.int64), chosen, prior, params)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score (0 to 1) as ``name``; only ``text`` is looked at, and nothing else goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # one number per bucket: its size is a parameter

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        values = WordValues(shared.value)
        for texts in batches:
            out = []
            for i in range(0, len(texts), 250):
                out += values.scores(texts.slice(i, 250).to_pylist())
            yield pa.array(out, pa.float64())

    return docs.select(*[F.col(f"`{n}`") for n in keep], scores("text").alias(name))


def fold(doc_id: Column) -> Column:
    """Remainder by five of the checksum of the id's text; 0 marks the held-out rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def fit_on_labels(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Trains on labelled documents outside the held-out fold: of each class those ``params.sample`` whose ids have the
    smallest hash, read from the documents by a join with these few ids."""
    marks = (columns_only(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != 0)
             .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    prior = marks.agg(F.avg("toxic")).first()[0]
    ids = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample) for k in (0, 1)]
    sampled = columns_only(documents, "doc_id", "text").join(F.broadcast(ids[0].unionAll(ids[1])), "doc_id")
    return fit(sampled, float(prior or 0.0), params)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
