"""k-mer to taxon tables, tag support, taxonomy roll-up, enrichment and species calls."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from ionweave.functions import stats
from ionweave.operators.core import bh_qvalues, keyed_join
from ionweave.operators.dbmatch import kmers, wanted_only
from ionweave.session import materialize, rewritten

OBSERVED_FLOOR = 5


def build_kmer_taxa(proteins: DataFrame, k: int = 7, taxon: str = "taxon") -> DataFrame:
    """(kmer, taxon) once per taxon per distinct k-mer, reduced map-side before the shuffle."""
    if k > 8:
        return kmers(proteins, k, [taxon]).select("kmer", F.col(taxon).alias("taxon")).distinct()
    p = proteins.select(F.coalesce("sequence", F.lit("")).alias("sequence"), F.col(taxon).alias("taxon"))
    kind = p.schema["taxon"].dataType.simpleString()
    return p.mapInArrow(lambda batches: _distinct_kmers(batches, k), f"kmer string, taxon {kind}").distinct()


#: Letters whose k-mers are reduced at a time.
KMER_LETTERS = 1 << 21


def _distinct_kmers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k-mers (up to 8 letters, a byte each in a number) of each taxon's sequences, equal ones of a stretch once."""
    for batch in batches:
        seqs, taxa = batch.column(0), batch.column(1).dictionary_encode()
        codes = taxa.indices.to_numpy(zero_copy_only=False)
        codes = np.where(np.isnan(codes), -1, codes).astype(np.int64)
        for code in np.unique(codes).tolist():
            own = seqs.take(pa.array(np.flatnonzero(codes == code)))
            value = taxa.dictionary.take(pa.array([code if code >= 0 else None], pa.int64()))
            # between sequences stands a mark that no k-mer holds
            text = "#".join(own.to_pylist())
            for at in range(0, len(text), KMER_LETTERS):
                found = _kmers_of(text[at:at + KMER_LETTERS + k - 1], k)
                if len(found):
                    yield pa.RecordBatch.from_arrays([found, value.take(pa.array(np.zeros(len(found), np.int64)))], ["kmer", "taxon"])


def _kmers_of(text: str, k: int) -> pa.Array:
    if not text.isascii():
        return pa.array({text[i:i + k] for i in range(len(text) - k + 1) if not set("#\n\r\x85\u2028\u2029") & set(text[i:i + k])}, pa.string())
    raw = np.frombuffer(text.encode("ascii"), np.uint8)
    n = len(raw) - k + 1
    if n < 1:
        return pa.array([], pa.string())
    bad = np.concatenate([[0], np.cumsum((raw == 35) | (raw == 10) | (raw == 13))])
    word = np.zeros(n, np.uint64)
    for i in range(k):
        word = (word << np.uint64(8)) | raw[i:i + n]
    word = np.unique(word[bad[k:] == bad[:n]])
    letters = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - k:]
    offsets = np.arange(0, k * len(word) + 1, k, dtype=np.int32)
    return pa.StringArray.from_buffers(len(word), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))


def write_kmer_taxa(kmer_taxa: DataFrame, table: str, buckets: int = 256, path: str | None = None) -> None:
    """Saves the index bucketed and sorted by k-mer (under ``path`` if given), so look-ups of many tag sets need no exchange of it."""
    out = kmer_taxa.write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer")
    (out.option("path", path) if path else out).saveAsTable(table)


def postings(kmer_taxa: DataFrame) -> DataFrame:
    """(taxon, kmers): k-mers per taxon."""
    return kmer_taxa.groupBy("taxon").agg(F.count(F.lit(1)).alias("kmers"))


def pairwise_overlap(kmer_taxa: DataFrame) -> DataFrame:
    """(a, b, shared): k-mers shared per taxon pair, a <= b.

    k-mers are grouped by their taxon set first: equal sets are counted once and pairs are formed per
    distinct set, weighted by its count.
    """
    sets = kmer_taxa.groupBy("kmer").agg(F.array_sort(F.collect_set("taxon")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    a = sets.select("s", "n", F.explode("s").alias("a"))
    return a.select("a", "n", F.explode("s").alias("b")).filter("a <= b").groupBy("a", "b").agg(F.sum("n").alias("shared"))


def group_overlap(kmer_taxa: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, shared): distinct k-mers per pair of groups (taxon, genus)."""
    g = kmer_taxa.join(groups, "taxon").select("kmer", F.col("genus").alias("taxon")).distinct()
    return pairwise_overlap(g)


def tag_support(tags: DataFrame, kmer_taxa: DataFrame, k: int = 7, share_cap: int | None = None, margin: float = 0.0) -> DataFrame:
    """(seq, taxon): taxa carrying every evaluated k-mer of a tag.

    A k-mer in no taxon ends the tag. With ``share_cap``, k-mers of more taxa are not evaluated; without, all are.
    Each distinct sequence is looked up once. ``kmer_taxa`` may be a table written by ``write_kmer_taxa``.
    """
    seqs = tags.select("seq").distinct().filter(F.length("seq") >= k)
    km = seqs.select("seq", F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?=(.{{{k}}}))"), F.lit(1))).alias("i", "kmer"))
    wanted = materialize(wanted_only(kmer_taxa, km))   # read twice below, and small beside the index
    n = wanted.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n"))
    ev = km.join(n, "kmer", "left")
    wide = F.col("_n") > share_cap if share_cap is not None else F.lit(False)
    ok = ev.groupBy("seq").agg(F.min(F.coalesce("_n", F.lit(0))).alias("_least"), F.count_if(F.col("_n").isNotNull() & ~wide).alias("n_eval")).filter("_least > 0 AND n_eval > 0")
    hits = ev.filter(F.col("_n").isNotNull() & ~wide).select("seq", "i", "kmer").join(wanted, "kmer").groupBy("seq", "taxon").agg(F.count(F.lit(1)).alias("c"))
    j = hits.join(ok.select("seq", "n_eval"), "seq")
    runner = j.groupBy("seq").agg(F.max(F.when(F.col("c") < F.col("n_eval"), F.col("c"))).alias("runner"))
    full = j.filter("c = n_eval").join(runner, "seq")
    return full.filter((F.col("n_eval") - F.coalesce("runner", F.lit(0))) / F.col("n_eval") >= margin).select("seq", "taxon")


def oriented_support(tags: DataFrame, kmer_taxa: DataFrame, k: int = 7, share_cap: int | None = None, margin: float = 0.0, both: bool = True) -> DataFrame:
    """(seq, taxon, orientation): forward, reverse, intersection or palindrome; disjoint readings give nothing."""
    s = tags.select("seq").distinct()
    if not both:
        return tag_support(s, kmer_taxa, k, share_cap, margin).withColumn("orientation", F.lit("forward"))
    all_ = s.unionByName(s.select(F.reverse("seq").alias("seq"))).distinct()
    sup = tag_support(all_, kmer_taxa, k, share_cap, margin).groupBy("seq").agg(F.collect_set("taxon").alias("t"))
    j = s.join(sup.withColumnRenamed("t", "f"), "seq", "left").withColumn("_r", F.reverse("seq")).join(
        sup.select(F.col("seq").alias("_r"), F.col("t").alias("r")), "_r", "left")
    both_ = F.array_intersect("f", "r")
    pick = (F.when(F.col("seq") == F.col("_r"), F.struct(F.col("f").alias("t"), F.lit("palindrome").alias("o")))
            .when(F.col("f").isNotNull() & F.col("r").isNotNull(), F.struct(both_.alias("t"), F.when(F.size(both_) == 0, "ambiguous").otherwise("intersection").alias("o")))
            .when(F.col("f").isNotNull(), F.struct(F.col("f").alias("t"), F.lit("forward").alias("o")))
            .otherwise(F.struct(F.col("r").alias("t"), F.lit("reverse").alias("o"))))
    return j.select("seq", pick.alias("p")).select("seq", F.explode("p.t").alias("taxon"), F.col("p.o").alias("orientation"))


def spectrum_taxa(tags: DataFrame, support: DataFrame, mode: str = "best") -> DataFrame:
    """(run_id, idx, taxon): taxa of the supported tag with the best E-value (ties united), or of all."""
    j = tags.filter(~F.isnan("evalue")).join(support.select("seq", "taxon"), "seq")
    if mode == "best":
        top = j.groupBy("run_id", "idx").agg(F.min("evalue").alias("_e"))
        j = j.join(top, ["run_id", "idx"]).filter(F.col("evalue") == F.col("_e"))
    return j.select("run_id", "idx", "taxon").distinct()


def decoy_tags(tags: DataFrame, n_decoys: int = 1) -> DataFrame:
    """Adds ``decoy`` 1..n and its sequence: letters in hashed order, never the tag or its reverse."""
    d = tags.withColumn("decoy", F.explode(F.sequence(F.lit(1), F.lit(n_decoys))))
    letters = F.split("seq", "(?!^)(?=.)")
    mix = F.array_join(F.transform(F.array_sort(F.transform(letters, lambda c, i: F.struct(
        F.xxhash64("seq", "decoy", i).alias("h"), c.alias("c")))), lambda x: x.c), "")
    d = d.withColumn("_m", mix)
    cands = F.expr("transform(sequence(0, greatest(length(_m) - 1, 0)), k -> concat(substring(_m, k + 1), substring(_m, 1, k)))")
    ok = F.get(F.filter(cands, lambda s: (s != F.col("seq")) & (s != F.reverse("seq"))), F.lit(0))
    return d.withColumn("decoy_seq", ok).drop("_m").filter("decoy_seq IS NOT NULL")


def kmer_decoys(tags: DataFrame, kmer_taxa: DataFrame, k: int = 7, n_decoys: int = 1, share_cap: int | None = None, margin: float = 0.0) -> DataFrame:
    """(seq, decoy, decoy_seq, taxa): the decoys of each distinct tag of exactly ``k`` letters, and the taxa that carry them.

    The permutation belongs to the k-mer, so a k-mer has the same decoys in every run. Longer tags have none: independent decoys of
    their k-mers would lose the overlaps, and a shuffle of the whole tag would not be keyed by k-mer. A tag whose letters allow no decoy
    has decoy NULL.
    """
    own = tags.select(F.translate("seq", "I", "L").alias("seq")).filter(F.length("seq") == k).distinct()
    d = materialize(decoy_tags(own, n_decoys).select("seq", "decoy", "decoy_seq"))
    found = tag_support(d.select(F.col("decoy_seq").alias("seq")), kmer_taxa, k, share_cap, margin)
    found = found.groupBy(F.col("seq").alias("decoy_seq")).agg(F.array_sort(F.collect_set("taxon")).alias("taxa"))
    met = own.join(d, "seq", "left").join(found, "decoy_seq", "left")
    return met.select("seq", "decoy", "decoy_seq", F.coalesce("taxa", F.array().cast(found.schema["taxa"].dataType)).alias("taxa"))


def decoy_rates(tags: DataFrame, decoys: DataFrame, k: int = 7) -> DataFrame:
    """(run_id, tags, no_decoy, decoys, supported, rate): tags of a run, those without a decoy (another length, or none possible), the
    decoys looked up for the others and how many found a taxon; a tag counts as often as it occurs."""
    per = decoys.groupBy("seq").agg(F.count("decoy").alias("n"), F.count_if(F.col("decoy").isNotNull() & (F.size("taxa") > 0)).alias("hit"))
    t = tags.select("run_id", F.translate("seq", "I", "L").alias("seq")).groupBy("run_id", "seq").agg(F.count(F.lit(1)).alias("c"))
    j = t.join(per, "seq", "left").select("run_id", "c", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hit", F.lit(0)).alias("hit"))
    g = j.groupBy("run_id").agg(F.sum("c").alias("tags"), F.sum(F.when(F.col("n") == 0, F.col("c")).otherwise(0)).alias("no_decoy"),
                                F.sum(F.col("c") * F.col("n")).alias("decoys"), F.sum(F.col("c") * F.col("hit")).alias("supported"))
    return g.withColumn("rate", F.when(F.col("decoys") > 0, F.col("supported") / F.col("decoys")))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(taxid, anc, dist): every node with itself and all its ancestors, by pointer doubling.

    Paths double in length each round, so a tree of depth d takes log2(d) joins. Parents that form a cycle raise
    ValueError.
    """
    jump = materialize(nodes.filter("taxid <> parent").select("taxid", F.col("parent").alias("anc"), F.lit(1).alias("dist")))
    known = jump
    step, size = 1, nodes.count()
    while True:
        if step > 2 * size:
            raise ValueError("the parents form a cycle")
        hop = known.filter(F.col("dist") == step).select(
            F.col("taxid").alias("t2"), F.col("anc").alias("mid"), F.col("dist").alias("d1"))
        far = known.filter(F.col("dist") <= step).join(hop, F.col("taxid") == F.col("mid")).select(
            F.col("t2").alias("taxid"), "anc", (F.col("dist") + F.col("d1")).alias("dist"))
        nxt = materialize(known.unionByName(far))
        grew = far.limit(1).count() > 0
        known = nxt
        step *= 2
        if not grew:
            break
    return nodes.select("taxid", F.col("taxid").alias("anc"), F.lit(0).alias("dist")).unionByName(known)


def roll_up(hits: DataFrame, anc: DataFrame) -> DataFrame:
    """(run_id, taxid, direct, subtree): spectra on a node and in its subtree, each spectrum once per node."""
    direct = hits.groupBy("run_id", "taxid").agg(F.countDistinct("idx").alias("direct"))
    up = hits.join(anc.select("taxid", "anc"), "taxid").select("run_id", "idx", "anc").distinct().groupBy("run_id", "anc").agg(F.count(F.lit(1)).alias("subtree"))
    return up.withColumnRenamed("anc", "taxid").join(direct, ["run_id", "taxid"], "left").select("run_id", "taxid", F.coalesce("direct", F.lit(0)).alias("direct"), "subtree")


def enrichment(rolled: DataFrame, background: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds expected, pvalue and qvalue for nodes with at least five spectra.

    ``background``: taxid, p. ``totals``: run_id, n_total.
    """
    t = rolled.filter(F.col("subtree") >= OBSERVED_FLOOR).join(background.filter("p >= 0 AND p <= 1"), "taxid").join(totals, "run_id")
    t = t.withColumn("expected", F.col("n_total") * F.col("p")).withColumn("pvalue", stats.binomial_upper("n_total", "subtree", "p"))
    return bh_qvalues(t, ["run_id"], "pvalue")


def nnls(p: np.ndarray, o: np.ndarray) -> np.ndarray:
    """The non-negative n with the least |p n - o|: columns enter by their gradient and leave at the bound until no
    gradient is positive beyond rounding."""
    n, free = np.zeros(p.shape[1]), np.zeros(p.shape[1], bool)
    tol = 1e-12 * max(1.0, float(np.abs(p.T @ o).max(initial=0.0)))
    best = np.inf
    while not free.all():
        g = p.T @ (o - p @ n)
        g[free] = -np.inf
        j = int(np.argmax(g))
        if g[j] <= tol:
            break
        free[j] = True
        while True:
            z = np.zeros_like(n)
            z[free] = np.linalg.lstsq(p[:, free], o, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                break
            step = (n[low] / np.maximum(n[low] - z[low], 1e-300)).min()
            n = n + step * (z - n)
            free &= n > tol
            n[~free] = 0.0
            if not free.any():
                z = np.zeros_like(n)
                break
        n = z
        left = float(((p @ n - o) ** 2).sum())
        if left >= best:                       # the same set again: equal columns
            break
        best = left
    return n


def deconvolve(overlap: DataFrame, sizes: DataFrame, observed: DataFrame) -> DataFrame:
    """(run_id, taxon, n_hat): non-negative counts whose expected sharing explains the observed ones best.

    ``overlap``: a, b, shared (a <= b, diagonal included). A run is solved by itself to the optimum: a group is the
    sharing P_ij = shared(i, j) / size(j) among the taxa it observed, which the taxonomy bounds.
    """
    sym = overlap.select("a", "b", "shared").unionByName(overlap.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    P = sym.join(sizes.select(F.col("taxon").alias("b"), "kmers"), "b").select(F.col("a").alias("i"), F.col("b").alias("j"), (F.col("shared") / F.col("kmers")).alias("p"))
    obs = materialize(observed.select("run_id", "taxon", F.col("observed").cast("double").alias("o")))
    cells = obs.select("run_id", F.col("taxon").alias("j"), "o").join(P, "j").join(obs.select("run_id", F.col("taxon").alias("i")), ["run_id", "i"])
    rows = cells.select("run_id", "i", "j", "p", F.lit(None).cast("double").alias("o")).unionByName(
        obs.select("run_id", F.col("taxon").alias("i"), F.col("taxon").alias("j"), F.lit(None).cast("double").alias("p"), "o"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = pdf[pdf["o"].notna()].sort_values("i")
        at = {t: k for k, t in enumerate(seen["i"])}
        p = np.zeros((len(at), len(at)))
        part = pdf[pdf["p"].notna()]
        p[part["i"].map(at), part["j"].map(at)] = part["p"]
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "taxon": seen["i"], "n_hat": nnls(p, seen["o"].to_numpy(float))})

    kinds = obs.schema
    return rows.groupBy("run_id").applyInPandas(solve, f"run_id {kinds['run_id'].dataType.simpleString()}, taxon {kinds['taxon'].dataType.simpleString()}, n_hat double")


def species_null(genera: DataFrame, decoys: int, trials: DataFrame) -> DataFrame:
    """Adds ``random_expected`` = (decoy spectra + 0.5) / decoys. ``trials``: run_id, n_trials."""
    return genera.join(trials, "run_id").withColumn("random_expected", (F.col("decoy_spectra") + 0.5) / F.lit(float(max(1, decoys))))


#: Grid of Storey's estimate and the degrees of freedom of its smoothing spline.
PI0_GRID, PI0_FREEDOM = np.arange(1, 20) * 0.05, 3.0


def pi0_weights() -> list[float]:
    """Weights of the grid's values in the smoothing spline at the last grid point. A smoothing spline of fixed degrees of freedom
    on a fixed grid is linear in the values, so the estimate is one weighted sum of counts."""
    h, n = PI0_GRID[1] - PI0_GRID[0], len(PI0_GRID)
    second = np.zeros((n, n - 2))
    band = np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        second[j:j + 3, j] = np.array([1.0, -2.0, 1.0]) / h
        band[j, j] = 2 * h / 3
        if j:
            band[j, j - 1] = band[j - 1, j] = h / 6
    bends, vectors = np.linalg.eigh(second @ np.linalg.solve(band, second.T))
    bends = np.maximum(bends, 0.0)
    low, high = -30.0, 30.0                # exponent of the penalty
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(mid) * bends)).sum() > PI0_FREEDOM else (low, mid)
    return ((vectors / (1 + np.exp(low) * bends)) @ vectors.T)[-1].tolist()


def _with_q(e: DataFrame, p: str, q: str, pi0: float) -> DataFrame:
    """Adds ``q`` over the tested genera of each run (1 for the others) and ``pi0`` (given, or estimated where 0 is given)."""
    run = W.partitionBy("run_id")   # genera of one run: bounded by the taxonomy
    w = run.orderBy("_p")
    tested = F.col("observed") >= OBSERVED_FLOOR
    m = F.sum(tested.cast("int")).over(run)
    e = e.drop("pi0", q).withColumn("_p", F.when(tested, F.col(p)))
    if pi0 > 0:
        e = e.withColumn("pi0", F.lit(min(1.0, pi0)))
    else:
        parts = [F.sum((F.col("_p") >= F.lit(float(x))).cast("int")).over(run) * F.lit(c / (1.0 - float(x))) for x, c in zip(PI0_GRID, pi0_weights(), strict=True)]
        found = sum(parts[1:], parts[0]) / m
        e = e.withColumn("pi0", F.when((m < 2) | ~(found > 0), 1.0).otherwise(F.coalesce(F.least(found, F.lit(1.0)), F.lit(1.0))))
    pos = F.sum(tested.cast("int")).over(w.rangeBetween(W.unboundedPreceding, 0))
    e = e.withColumn("_raw", F.when(tested, F.col("_p") * m / pos * F.col("pi0")))
    least = F.min("_raw").over(w.rangeBetween(0, W.unboundedFollowing))
    return e.withColumn(q, F.when(tested, F.least(least, F.lit(1.0))).otherwise(1.0)).drop("_p", "_raw")


def _spill(g: DataFrame, C: DataFrame) -> DataFrame:
    """(run_id, taxid, spill): what the genera above a genus (more spectra, ties to the smaller id) whose ``present`` is set spill on it."""
    nh = F.coalesce("n_hat", F.col("observed").cast("double"))
    if g.filter("present").limit(1).count() == 0:      # the first round, and runs without calls: nothing to meet
        return g.select("run_id", "taxid", F.lit(0.0).alias("spill")).limit(0)
    if "unit" in C.columns:
        # members of a unit that holds a present genus, in order: the genera above a member are the running sum before it
        state = g.select("run_id", F.col("taxid").alias("h"), "observed", F.when(F.col("present"), nh).otherwise(0.0).alias("nh"))
        held = keyed_join(C, state.filter("nh <> 0"), ["h"]).select("run_id", "unit").distinct()
        own = keyed_join(keyed_join(C, state, ["h"]), held, ["run_id", "unit"])
        above = W.partitionBy("run_id", "unit").orderBy(F.desc("observed"), "h").rowsBetween(W.unboundedPreceding, -1)
        own = own.withColumn("_s", F.sum(F.col("c") * F.col("nh")).over(above))
        return own.groupBy("run_id", F.col("h").alias("taxid")).agg(F.sum("_s").alias("spill"))
    src = g.filter("present").select("run_id", F.col("taxid").alias("h"), F.col("observed").alias("obs_h"), nh.alias("nh"))
    sp = keyed_join(keyed_join(C, src, ["h"]), g.select("run_id", F.col("taxid").alias("g"), F.col("observed").alias("obs_g")), ["run_id", "g"])
    above = (F.col("obs_h") > F.col("obs_g")) | ((F.col("obs_h") == F.col("obs_g")) & (F.col("h") < F.col("g")))
    return sp.filter(above).groupBy("run_id", F.col("g").alias("taxid")).agg(F.sum(F.col("c") * F.col("nh")).alias("spill"))


def _evaluate(g: DataFrame, C: DataFrame, alpha: float, tau: float, n_min: int, pi0: float) -> DataFrame:
    """Spill, p, q and qualification with spill from the rows whose ``present`` is set."""
    sp = _spill(g, C)
    e = g.drop("spill", "pvalue", "qvalue", "qualifies").join(sp, ["run_id", "taxid"], "left").withColumn("spill", F.coalesce("spill", F.lit(0.0)))
    e = _with_q(e.withColumn("pvalue", stats.poisson_upper("observed", F.col("spill") + F.col("random_expected"))), "pvalue", "qvalue", pi0)
    tested = F.col("observed") >= OBSERVED_FLOOR
    return e.withColumn("qualifies", tested & (F.col("qvalue") <= alpha) & (F.col("share") >= tau) & (F.col("observed") >= n_min))


@arrow_udf(LongType())
def smallest_count(lam: pa.Array, limit: pa.Array) -> pa.Array:
    """The least o with P(X >= o) <= limit for a Poisson mean, 0 for limits of 1 and more. The tail is summed from its far end."""
    out = []
    for mean, most in zip(lam.to_pylist(), limit.to_pylist(), strict=True):
        if mean is None or most is None or most >= 1:
            out.append(None if mean is None or most is None else 0)
            continue
        reach = 60 + 12 * math.sqrt(mean)
        k = np.arange(max(0, math.floor(mean - reach)), math.ceil(mean + reach) + 1)
        logs = -mean + k * math.log(mean) - np.cumsum(np.concatenate([[math.lgamma(k[0] + 1)], np.log(k[1:])])) if mean > 0 else np.where(k == 0, 0.0, -np.inf)
        tail = np.cumsum(np.exp(logs)[::-1])[::-1]
        below = np.flatnonzero(tail <= most)
        out.append(int(k[below[0]]) if len(below) else int(k[-1]) + 1)
    return pa.array(out, pa.int64())


def call_species(genera: DataFrame, C: DataFrame, alpha: float = 0.01, tau: float = 0.005, n_min: int = 10, min_units: int = 50, pi0: float = 1.0) -> DataFrame:
    """present, no_call or not_detected per run and genus, from a self-consistent present set.

    ``genera``: run_id, taxid, observed, share, random_expected, n_hat, n_units, and optionally low_resolution (of the run).
    ``C``: g, h, c (share of genus h's spectra that also fit g); or unit, h, c, a row per member of each unit, for c(g, h) as the sum of
    c over the units that hold both. Members take sums along their order, so a unit costs its members and not its pairs. ``pi0``: share of genera that are not there in the q-values; 1 is
    Benjamini-Hochberg, 0 estimates it. ``lod`` of a genus that is not detected: the smallest count that would have been called
    with its expectation, as a share of the run's units; above 1 the run could not have shown it. The set map is iterated from the empty set until a set of the run repeats;
    of the sets on that cycle, however long, the common members are kept and shrunk until every member qualifies.
    """
    C = rewritten(C.filter("c > 0"))
    st = materialize(genera.withColumn("present", F.lit(False)).withColumn("before", F.array().cast("array<boolean>")).withColumn("settled", F.lit(False)))
    r = 0
    while True:
        e = materialize(_evaluate(st, C, alpha, tau, n_min, pi0).withColumn("before", F.when(F.col("settled"), F.col("before")).otherwise(F.concat("before", F.array("present")))))
        # sets 0 .. r have been seen; the next is that of the qualifying genera
        same = e.filter("NOT settled").groupBy("run_id").agg(*[F.every(F.col("before")[k] == F.col("qualifies")).alias(f"_{k}") for k in range(r + 1)])
        start = same.select("run_id", F.coalesce(*[F.when(F.col(f"_{k}"), F.lit(k)) for k in range(r + 1)]).alias("_from"))
        j = e.join(start, "run_id", "left")
        common = F.forall(F.slice("before", F.col("_from") + 1, F.size("before")), lambda x: x)
        st = materialize(j.withColumn("present", F.when(F.col("settled"), F.col("present")).when(F.col("_from").isNotNull(), common).otherwise(F.col("qualifies")))
                         .withColumn("settled", F.col("settled") | F.col("_from").isNotNull()).drop("_from"))
        r += 1
        if st.filter("NOT settled").limit(1).count() == 0:
            break
    st = st.drop("before", "settled")
    while True:
        e = materialize(_evaluate(st, C, alpha, tau, n_min, pi0))
        if e.filter("present AND NOT qualifies").limit(1).count() == 0:
            break
        st = e.withColumn("present", F.col("present") & F.col("qualifies"))
    rand = _with_q(e.withColumn("p_random", stats.poisson_upper("observed", "random_expected")), "p_random", "qvalue_random", pi0).select("run_id", "taxid", "qvalue_random")
    out = e.join(rand, ["run_id", "taxid"])
    tested, over = F.col("observed") >= OBSERVED_FLOOR, F.col("qvalue") > alpha
    answer = lambda call, reason: F.struct(F.lit(call).alias("call"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    coarse = F.coalesce(F.col("low_resolution"), F.lit(False)) if "low_resolution" in out.columns else F.lit(False)
    missed = F.when(~tested | over, "not_significant").when(~(F.col("share") >= tau), "low_share").otherwise("few_genus_spectra")
    call = (F.when(coarse, answer("no_call", "low_resolution")).when(F.col("n_units") < min_units, answer("no_call", "few_spectra"))
            .when(F.col("present"), answer("present", "pass")).when(F.col("qualifies"), answer("no_call", "unstable"))
            .when(tested & (F.col("spill") > 0) & (F.col("qvalue_random") <= alpha) & over, answer("no_call", "near_neighbour")).otherwise(answer("not_detected", missed)))
    run = W.partitionBy("run_id")
    found = F.sum((tested & ~over).cast("int")).over(run) - (tested & ~over).cast("int")
    places = F.sum(tested.cast("int")).over(run) + F.when(tested, 0).otherwise(1)
    out = out.withColumn("_c", call).withColumn("expected", F.col("spill") + F.col("random_expected")).withColumn("_limit", alpha * (found + 1) / (places * F.col("pi0")))
    count = smallest_count("expected", F.when(F.col("_c.call") == "not_detected", F.col("_limit")))
    least = F.greatest(count, F.lit(n_min).cast("long"), F.lit(OBSERVED_FLOOR).cast("long"), F.ceil(tau * F.col("n_units") - 1e-9))
    lod = F.when((F.col("_c.call") == "not_detected") & (F.col("n_units") > 0), least / F.col("n_units"))
    return out.withColumn("lod", lod).select("run_id", "taxid", "observed", "spill", "random_expected", "pvalue", "qvalue", "qvalue_random", "pi0", "lod", "_c.call", "_c.reason")


def species_report(rolled: DataFrame, names: DataFrame, rank: str, value: str = "subtree") -> DataFrame:
    """Rows at a taxonomic rank with their place per run by count, then taxid."""
    r = rolled.join(names.filter(F.col("rank") == rank), "taxid")
    return r.withColumn("place", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc(value), "taxid")))


def subsample_stability(hits: DataFrame, draws: int, share: float, seed: int = 1) -> DataFrame:
    """(run_id, taxon, mean, low, high): counts over seeded subsamples of the spectra.

    Each spectrum draws membership in every subsample by hash, so the draws need no shuffle of their own.
    """
    from ionweave.operators.core import even_hash
    b = hits.withColumn("draw", F.explode(F.filter(F.sequence(F.lit(1), F.lit(draws)), lambda d: even_hash("run_id", "idx", d, seed=seed) < share)))
    n = b.groupBy("run_id", "taxon", "draw").agg(F.countDistinct("idx").alias("n"))
    return n.groupBy("run_id", "taxon").agg((F.sum("n") / draws).alias("mean"), F.when(F.count(F.lit(1)) < draws, 0).otherwise(F.min("n")).alias("low"), F.max("n").alias("high"))


def compare_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per run: rows only in one report, rows in both, equal counts, and whether the first place agrees."""
    j = a.select("run_id", "taxid", F.col("place").alias("pa"), F.col("subtree").alias("na")).join(
        b.select("run_id", "taxid", F.col("place").alias("pb"), F.col("subtree").alias("nb")), ["run_id", "taxid"], "full_outer")
    return j.groupBy("run_id").agg(
        F.count_if(F.col("pb").isNull()).alias("only_a"), F.count_if(F.col("pa").isNull()).alias("only_b"),
        F.count_if(F.col("pa").isNotNull() & F.col("pb").isNotNull()).alias("both"), F.count_if(F.col("na") == F.col("nb")).alias("same_count"),
        F.coalesce(F.max((F.col("pa") == 1) & (F.col("pb") == 1)), F.lit(False)).alias("same_top"))


def prune_taxonomy(nodes: DataFrame, names: DataFrame, taxids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and names on a path from a wanted taxon to the root."""
    keep = ancestors(nodes).join(taxids.select("taxid").distinct(), "taxid", "left_semi").select(F.col("anc").alias("taxid")).distinct()
    return nodes.join(keep, "taxid", "left_semi"), names.join(keep, "taxid", "left_semi")


def index_stats(kmer_taxa: DataFrame, groups: DataFrame) -> DataFrame:
    """(genus, taxon, kmers, unique): k-mers and k-mers found nowhere else; taxon NULL is the genus row."""
    n = kmer_taxa.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n"))
    t = kmer_taxa.join(n, "kmer").join(groups, "taxon")
    per = t.groupBy("genus", "taxon").agg(F.count(F.lit(1)).alias("kmers"), F.count_if(F.col("_n") == 1).alias("unique"))
    gk = t.select("genus", "kmer").distinct()
    gn = gk.groupBy("kmer").agg(F.count(F.lit(1)).alias("_g"))
    gen = gk.join(gn, "kmer").groupBy("genus").agg(F.count(F.lit(1)).alias("kmers"), F.count_if(F.col("_g") == 1).alias("unique"))
    return per.unionByName(gen.select("genus", F.lit(None).cast("string").alias("taxon"), "kmers", "unique"))
