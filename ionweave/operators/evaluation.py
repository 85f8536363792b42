"""Scoring against known truth: tag correctness, precision and recall, controls, intervals, agreement."""
from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionweave.functions import constants as K, scalar as S, stats
from ionweave.operators.core import Scan, connected_components, dealt, even_hash, keyed_join, ordered_scan, range_join, value_ranks
from ionweave.operators.precursor import preceding_ms1

FLANK_TOL = 0.5
REVERSED_OFFSET = {"by": K.WATER, "cz": K.ION_PAIRS["cz"]["off_c"] - K.ION_PAIRS["cz"]["off_n"]}

# Cleavage agent and label words of sample annotations.
ENZYME_WORDS = {"trypsin": "Trypsin", "trypsin/p": "Trypsin", "lys-c": "Lys-C", "lysc": "Lys-C", "lys-c/p": "Lys-C", "arg-c": "Arg-C", "glu-c": "Glu-C",
                "asp-n": "Asp-N", "chymotrypsin": "Chymotrypsin", "lys-n": "Lys-N", "unspecific cleavage": "unspecific", "no cleavage": "unspecific",
                "unspecific": "unspecific", "none": "unspecific"}


def tag_is_correct(tag: str, nterm: str, cterm: str, peptide: str, tol: float = FLANK_TOL, offset: float = K.WATER, prefix: str | None = None,
                   folded: str | None = None) -> Column:
    """The tag or its reverse occurs in the folded peptide and one flank mass agrees at that place.

    ``prefix``: a column with the peptide's prefix masses, which are made for every tag and place without it; ``folded``: one with
    the normalized tag, which is made at every mention without it.
    """
    t, p = F.col(folded) if folded else S.normalize_tag(tag), F.col(peptide)
    pre = F.col(prefix) if prefix else S.prefix_masses(p)
    n, c = F.col(nterm), F.col(cterm)
    L = F.length(t)
    total = F.element_at(pre, -1)
    at = lambda i: F.get(pre, i)

    def occurs(word, fits):
        """``fits`` holds at a place of ``word``. Most words have one place at most, which needs no walk along the peptide."""
        first = F.call_function("locate", word, p, F.lit(1))
        second = F.call_function("locate", word, p, first + 1)
        spots = F.filter(F.sequence(F.lit(0), F.length(p) - L), lambda i: F.substring(p, i + 1, L) == word)
        return F.when(first == 0, False).when(second == 0, fits(first - 1)).otherwise(F.exists(spots, fits))

    fwd = occurs(t, lambda i: (F.abs(n - at(i)) <= tol) | (F.abs(c - (total - at(i + L))) <= tol))
    rev = occurs(F.reverse(t), lambda i: (F.abs(c - (at(i) - offset)) <= tol) | (F.abs(n - (total - at(i + L) + offset)) <= tol))
    return F.coalesce((L > 0) & (fwd | rev), F.lit(False))


def mark_correct(tags: DataFrame, psms: DataFrame, tol: float = FLANK_TOL) -> DataFrame:
    """Tags of spectra with a known peptide, with ``correct_seq`` and ``correct`` (the flank rule)."""
    gt = dealt(psms.select("key", "peptide"), "key").groupBy("key").agg(F.min("peptide").alias("peptide")).withColumn("_p", S.normalize_peptide("peptide"))
    m = keyed_join(tags, gt.withColumn("_pre", S.prefix_masses("_p")), ["key"])
    m = m.withColumn("_t", S.normalize_tag("tag"))
    m = m.withColumn("correct_seq", F.contains("_p", "_t") | F.contains("_p", F.reverse("_t")))
    ok = {s: tag_is_correct("tag", "nterm_mass", "cterm_mass", "_p", tol, o, "_pre", "_t") for s, o in REVERSED_OFFSET.items()}
    series = F.coalesce("ion_series", F.lit("by")) if "ion_series" in tags.columns else F.lit("by")
    return m.withColumn("correct", F.when(~F.col("correct_seq"), False).when(series == "cz", ok["cz"]).otherwise(ok["by"])).drop("_t", "_p", "_pre")


def score_tags(marked: DataFrame, psms: DataFrame, ks: list[int] = [1, 5, 10, 50]) -> DataFrame:
    """One row: spectra, tags, rank-1 precision and recall, top-k any-correct and all-tag precision."""
    c = F.col("correct").cast("int")
    per = marked.groupBy("key").agg(F.count(F.lit(1)).alias("tags"), F.sum(c).alias("ok"), F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("r1"),
                                    F.sum(F.when(F.col("rank") == 1, c).otherwise(0)).alias("ok1"), *[F.max(F.when(F.col("rank") <= k, c)).alias(f"h{k}") for k in ks])
    a = per.agg(F.count(F.lit(1)).alias("tagged"), F.sum("tags").alias("tags"), F.sum("ok").alias("correct"), F.sum("r1").alias("r1"), F.sum("ok1").alias("top1_correct"),
                *[F.sum(F.coalesce(f"h{k}", F.lit(0))).alias(f"top{k}_any_correct") for k in ks])
    n = psms.agg(F.countDistinct("key").alias("psm_spectra"))
    j = a.join(F.broadcast(n))   # two one-row totals
    return j.select("psm_spectra", "tagged", "tags", "correct", "top1_correct", (F.col("top1_correct") / F.col("r1")).alias("top1_precision"),
                    (F.col("top1_correct") / F.col("psm_spectra")).alias("top1_recall"), (F.col("correct") / F.col("tags")).alias("all_tags_precision"),
                    *[f"top{k}_any_correct" for k in ks], *[(F.col(f"top{k}_any_correct") / F.col("tagged")).alias(f"top{k}_any_rate") for k in ks])


def precision_by(marked: DataFrame, column: str, bins: list[float] | None = None) -> DataFrame:
    """Tags, correct ones and precision per value, or per right-closed bin, of a column."""
    g = F.col(column)
    if bins:
        g = F.lit(None).cast("string")
        for lo, hi in reversed(list(zip(bins, bins[1:]))):
            g = F.when((F.col(column) > lo) & (F.col(column) <= hi), F.lit(f"({lo}, {hi}]")).otherwise(g)
    out = marked.groupBy(g.cast("string").alias(column)).agg(F.count(F.lit(1)).alias("tags"), F.sum(F.col("correct").cast("int")).alias("correct"))
    return out.filter(F.col(column).isNotNull()).withColumn("precision", F.col("correct") / F.col("tags"))


def rank_curve(marked: DataFrame, psms: DataFrame, max_k: int = 50) -> DataFrame:
    """(k, spectra, rate, recall): spectra with a correct tag within the top k."""
    first = marked.groupBy("key").agg(F.min(F.when(F.col("correct"), F.col("rank"))).alias("first"))
    n = first.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    tagged = n.agg(F.sum("n").alias("tagged"))
    ks = marked.sparkSession.range(1, max_k + 1).select(F.col("id").cast("int").alias("k"))
    hit = n.filter(F.col("first") <= max_k).withColumn("k", F.explode(F.sequence("first", F.lit(max_k).cast(n.schema["first"].dataType)))).groupBy("k").agg(F.sum("n").alias("spectra"))
    tot = psms.agg(F.countDistinct("key").alias("n_psm"))
    j = ks.join(F.broadcast(hit.withColumn("k", F.col("k").cast("int"))), "k", "left").join(F.broadcast(tagged)).join(F.broadcast(tot))
    s = F.coalesce("spectra", F.lit(0))
    return j.select("k", s.alias("spectra"), (s / F.col("tagged")).alias("rate"), (s / F.col("n_psm")).alias("recall"))


def chance_control(psms: DataFrame, seed: int = 0, identities: bool = True) -> DataFrame:
    """(key, peptide): every spectrum with another one's peptide, by one cycle in hashed order.

    With ``identities`` the cycle runs over distinct folded peptides, so none can keep its own. The
    cycle's neighbour is found inside hash tiles and, at a tile's end, from the next tile's first row.
    """
    gt = psms.groupBy("key").agg(F.min("peptide").alias("peptide"))
    u = gt.select(S.normalize_peptide("peptide").alias("u"), "peptide", "key") if identities else gt.select(F.col("key").cast("string").alias("u"), "peptide", "key")
    rep = u.groupBy("u").agg(F.min_by("peptide", "key").alias("rep"))
    h = rep.withColumn("_h", F.xxhash64("u", F.lit(seed))).withColumn("_tile", F.floor(F.pmod(F.shiftright("_h", 40), F.lit(1 << 20)) / 4096))
    w = W.partitionBy("_tile").orderBy("_h", "u")
    first = h.groupBy("_tile").agg(F.min_by("rep", F.struct("_h", "u")).alias("_f"))
    ring = W.orderBy("_tile")   # at most 256 tiles
    first = first.withColumn("_g", F.first("_f").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).withColumn("_nf", F.coalesce(F.lead("_f").over(ring), "_g"))
    nxt = h.join(F.broadcast(first), "_tile").withColumn("new", F.coalesce(F.lead("rep").over(w), F.col("_nf"))).select("u", "new")
    return u.join(nxt, "u").select("key", F.col("new").alias("peptide"))


def candidates_by_mass(spectra: DataFrame, peptides: DataFrame, ppm: float = 10.0, charges: list[int] = [2, 3, 4], isotopes: list[int] = [0, 1]) -> DataFrame:
    """(key, cls, peptide): peptides whose mass fits the precursor at its charge (or every tried one).

    ``peptides``: peptide, cls, mass. A band join on mass cells.
    """
    z = F.when(F.col("charge") > 0, F.array(F.col("charge").cast("int"))).otherwise(F.array(*[F.lit(c) for c in charges]))
    s = spectra.withColumn("z", F.explode(z)).withColumn("k", F.explode(F.array(*[F.lit(i) for i in isotopes])))
    s = s.withColumn("m", F.col("z") * (F.col("precursor_mz") - K.PROTON) - F.col("k") * K.ISOTOPE_STEP)
    tol = F.col("m") * (ppm * 1e-6)
    return range_join(s, peptides, [], F.col("m") - tol, F.col("m") + tol, "mass", 0.5).select("key", "cls", "peptide").distinct()


def score_candidate_sets(tags: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per spectrum: candidates, size label, tagged, rank-1 and top-10 correct for any candidate.

    ``candidates``: key, peptide. ``truth``: key and label columns.
    """
    c = candidates.withColumn("_p", S.normalize_peptide("peptide")).select("key", "_p").distinct()
    n = c.groupBy("key").agg(F.count(F.lit(1)).alias("n_candidates"))
    m = keyed_join(tags, c.withColumn("_pre", S.prefix_masses("_p")), ["key"])
    ok = m.withColumn("_ok", tag_is_correct("tag", "nterm_mass", "cterm_mass", "_p", prefix="_pre")).groupBy("key", "rank").agg(F.max("_ok").alias("ok"))
    per = keyed_join(tags.select("key", "rank"), ok, ["key", "rank"], "left").groupBy("key").agg(
        F.count(F.lit(1)).alias("n_tags"), F.count_if(F.col("ok")).alias("n_correct"), F.max(F.when(F.col("rank") == 1, F.col("ok").cast("int"))).alias("top1"),
        F.max(F.when(F.col("rank") <= 10, F.col("ok").cast("int"))).alias("top10"))
    z = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    j = keyed_join(keyed_join(truth, n, ["key"], "left"), per, ["key"], "left")
    return j.select(*truth.columns, z("n_candidates"), F.when(F.coalesce("n_candidates", F.lit(0)) == 0, "no_pool_candidate").when(F.col("n_candidates") == 1, "single").otherwise("multiple").alias("size_label"),
                    (F.coalesce("n_tags", F.lit(0)) > 0).cast("int").alias("tagged"), z("n_tags"), z("n_correct"), z("top1"), z("top10"))


def summarize(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per cell and over all cells (grouping sets): spectra, scored, tagged, rank-1 accuracy, tag precision."""
    s = F.col("size_label") != "no_pool_candidate"
    t = s & (F.col("tagged") == 1)
    return scored.groupingSets([[F.col(b) for b in by], []], *[F.col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("spectra"), F.count_if(s).alias("scored"), F.count_if(t).alias("n_tagged"),
        (F.sum(F.when(t, F.col("top1"))) / F.count_if(t)).alias("rank1_accuracy"), (F.sum(F.when(s, F.col("n_correct"))) / F.sum(F.when(s, F.col("n_tags")))).alias("tag_precision"))


def byproducts(peptides: DataFrame, min_len: int = 5) -> DataFrame:
    """(peptide, variant, kind): truncations by one or two and single deletions, first kind wins."""
    p = peptides.withColumn("L", F.length("peptide"))
    sub = lambda a, n: F.substring("peptide", a, n)
    head = F.array(F.struct(sub(F.lit(2), F.col("L") - 1).alias("variant"), F.lit("nterm-1").alias("kind")), F.struct(sub(F.lit(3), F.col("L") - 2).alias("variant"), F.lit("nterm-2").alias("kind")),
                   F.struct(sub(F.lit(1), F.col("L") - 1).alias("variant"), F.lit("cterm-1").alias("kind")), F.struct(sub(F.lit(1), F.col("L") - 2).alias("variant"), F.lit("cterm-2").alias("kind")))
    dels = F.transform(F.sequence(F.lit(1), F.col("L")), lambda i: F.struct(F.concat(F.substring("peptide", F.lit(1), i - 1), F.substring("peptide", i + 1, F.col("L"))).alias("variant"),
                                                                          F.concat(F.lit("del"), i.cast("string")).alias("kind")))
    x = p.select("peptide", F.posexplode(F.concat(head, dels)).alias("o", "x")).select("peptide", "o", "x.*")
    return x.filter((F.length("variant") >= min_len) & (F.col("variant") != F.col("peptide"))).groupBy("peptide", "variant").agg(F.min_by("kind", "o").alias("kind"))


def decoy_pool(peptides: DataFrame, seed: int = 1) -> DataFrame:
    """(peptide, decoy): residues in hashed order with the last one kept, never a target's identity.

    Five orders are tried, then every rotation of the first; a peptide for which none will do keeps its row with a
    NULL decoy.
    """
    letters = F.split(F.expr("substring(peptide, 1, length(peptide) - 1)"), "(?!^)(?=.)")
    tries = F.explode(F.sequence(F.lit(1), F.lit(5) + F.length("peptide")))
    order = F.array_join(F.transform(F.array_sort(F.transform(
        letters, lambda c, i: F.struct(F.xxhash64("peptide", F.when(F.col("t") > 5, F.lit(1)).otherwise(F.col("t")), i, F.lit(seed)).alias("h"), c.alias("c")))), lambda x: x.c), "")
    d = peptides.select("peptide").distinct().withColumn("t", tries).withColumn("_o", order)
    turned = F.expr("concat(substring(_o, greatest(t - 5, 0) + 1), substring(_o, 1, greatest(t - 5, 0)), right(peptide, 1))")
    d = d.withColumn("decoy", turned).drop("_o")
    d = d.withColumn("_n", S.normalize_peptide("decoy")).join(peptides.select(S.normalize_peptide("peptide").alias("_n")).distinct(), "_n", "left_anti")
    found = d.groupBy("peptide").agg(F.min_by("decoy", "t").alias("decoy"))
    return peptides.select("peptide").distinct().join(found, "peptide", "left")


def pool_swap(pools: DataFrame, seed: int = 1) -> DataFrame:
    """(pool, partner): the pool of another batch with the closest size, ties by hash.

    Pools are matched with the nearest sizes below and above in each other batch, not with all pools.
    """
    b = pools.select("batch").distinct()
    x = pools.select("pool", F.col("batch").alias("own"), "size").join(F.broadcast(b), F.col("own") != F.col("batch"))
    # one row per batch and size: the last name of a size stands for it from above, the first one from below
    sizes = x.select("batch", "size", F.lit(None).cast("string").alias("cand")).unionByName(pools.select("batch", "size", F.col("pool").alias("cand")))
    sizes = sizes.groupBy("batch", "size").agg(F.max("cand").alias("_hi"), F.min("cand").alias("_lo")).select(
        "batch", "size", *[F.when(F.col(c).isNotNull(), F.struct("size", F.col(c).alias("cand"))).alias(c) for c in ("_hi", "_lo")])
    near = ordered_scan(sizes, ["batch"], "size", [Scan("d", "max", "_hi"), Scan("u", "min", "_lo", reverse=True, exclusive=True)])
    n = keyed_join(x, near.select("batch", "size", "d", "u"), ["batch", "size"])
    c = n.select("pool", "size", F.explode(F.array_compact(F.array("d", "u"))).alias("c"))
    return c.groupBy("pool").agg(F.min_by("c.cand", F.struct(F.abs(F.col("c.size") - F.col("size")), F.xxhash64("c.cand", F.lit(seed)))).alias("partner"))


def carryover_pools(pools: DataFrame) -> DataFrame:
    """(pool, neighbour): pools of the same set and batch with the next lower or higher number."""
    n = pools.select("set", "batch", F.col("num").alias("num2"), F.col("pool").alias("neighbour"))
    p = pools.withColumn("num2", F.explode(F.array(F.col("num") - 1, F.col("num") + 1)))
    return p.join(n, ["set", "batch", "num2"]).select("pool", "neighbour")


def grouped_split(members: DataFrame, shares: dict[str, float], seed: int = 1) -> DataFrame:
    """(pool, group, split): pools connected by shared identities go to one split.

    ``members``: pool, identity. Pools and identities form a two-sided graph of linear size, never all
    pairs of pools. A component goes to a split by the hash of its label.
    """
    e = members.select(F.concat(F.lit("p:"), "pool").alias("a"), F.concat(F.lit("i:"), F.col("identity").cast("string")).alias("b"))
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    c = connected_components(e, nodes).filter(F.startswith("node", F.lit("p:"))).select(F.expr("substring(node, 3)").alias("pool"), F.col("component").alias("group"))
    h = even_hash("group", seed=seed)
    split, edge = F.lit(list(shares)[-1]), 0.0
    for name, s in reversed(list(shares.items())[:-1]):
        edge = sum(v for k, v in list(shares.items())[: list(shares).index(name) + 1])
        split = F.when(h < edge, name).otherwise(split)
    return c.withColumn("split", split)


def chimera_truth(psms: DataFrame, fdr: float = 0.01) -> DataFrame:
    """chimeric, nested or single per spectrum with an accepted rank-1 target.

    ``psms``: key, rank, peptide, q, is_decoy, score. Rank 2 must also pass a target-decoy q of its own.
    """
    r2 = psms.filter("rank = 2").groupBy("score").agg(F.count_if(F.col("is_decoy")).alias("d"), F.count_if(~F.col("is_decoy")).alias("t"))
    r2 = ordered_scan(r2.withColumn("g", F.lit(0)), ["g"], "score", [Scan("dd", "sum", "d", reverse=True), Scan("tt", "sum", "t", reverse=True)])
    r2 = r2.withColumn("fdr", F.when(F.col("tt") > 0, F.col("dd") / F.col("tt")).otherwise(1.0))
    r2 = ordered_scan(r2.select("g", "score", "fdr"), ["g"], "score", [Scan("q2_rank", "min", "fdr")]).select("score", "q2_rank")
    p1 = psms.filter((F.col("rank") == 1) & ~F.col("is_decoy") & (F.col("q") <= fdr)).select("key", S.normalize_peptide("peptide").alias("pep1"))
    p2 = psms.filter((F.col("rank") == 2) & ~F.col("is_decoy") & (F.col("q") <= fdr)).join(r2, "score").filter(F.col("q2_rank") <= fdr).select("key", S.normalize_peptide("peptide").alias("pep2"), "q2_rank")
    nested = F.contains("pep1", F.col("pep2")) | F.contains("pep2", F.col("pep1"))
    return p1.join(p2, "key", "left").withColumn("category", F.when(F.col("pep2").isNull(), "single").when(nested, "nested").otherwise("chimeric"))


def precursor_purity(scans: DataFrame, peaks: DataFrame, ppm: float = 10.0, isotopes: int = 4) -> DataFrame:
    """Share of the isolation window's intensity in the precursor's isotope envelope, in the preceding MS1.

    ``scans``: run_id, idx, ms_level, precursor_mz, charge, iso_lower, iso_upper.
    """
    s = preceding_ms1(scans).filter("ms_level = 2 AND ms1_idx IS NOT NULL AND precursor_mz > 0")
    t = peaks.select("run_id", F.col("idx").alias("ms1_idx"), F.col("mz").alias("mz_1"), F.col("intensity").alias("y"))
    h = range_join(s, t, ["run_id", "ms1_idx"], F.col("precursor_mz") - F.col("iso_lower"), F.col("precursor_mz") + F.col("iso_upper"), "mz_1", 5.0)
    z = F.when(F.col("charge") > 0, F.col("charge")).otherwise(2)
    env = F.exists(F.sequence(F.lit(-1), F.lit(isotopes)), lambda k: F.abs(F.col("mz_1") - (F.col("precursor_mz") + k * K.ISOTOPE_STEP / z)) <= F.col("mz_1") * (ppm * 1e-6))
    g = h.groupBy("run_id", "idx").agg(F.sum("y").alias("total"), F.sum(F.when(env, F.col("y")).otherwise(0.0)).alias("own"))
    return keyed_join(s.select("run_id", "idx"), g, ["run_id", "idx"], "left").select("run_id", "idx", F.when(F.col("total") > 0, F.col("own") / F.col("total")).alias("purity"))


def assign_axes(spectra: DataFrame, s0: DataFrame, pool: DataFrame, chimeras: DataFrame | None = None) -> DataFrame:
    """(key, identification, chimericity, parent1, parent2): S0, S3-PT or S5; chimeras take parent1's label."""
    a = spectra.select("key").join(s0.select("key", F.lit(1).alias("_s")).distinct(), "key", "left").join(pool.select("key", F.lit(1).alias("_p")).distinct(), "key", "left")
    b = a.select("key", F.when(F.col("_s") == 1, "S0").when(F.col("_p") == 1, "S3-PT").otherwise("S5").alias("identification"), F.lit("none").alias("chimericity"),
                 F.lit(None).cast(spectra.schema["key"].dataType).alias("parent1"), F.lit(None).cast(spectra.schema["key"].dataType).alias("parent2"))
    if chimeras is None:
        return b
    lab = b.select(F.col("key").alias("parent1"), "identification")
    return b.unionByName(chimeras.join(lab, "parent1").select("key", "identification", F.lit("synthetic").alias("chimericity"), "parent1", "parent2"))


def triage_eval(census: DataFrame, second: DataFrame) -> DataFrame:
    """Per run: spectra and second-search hits among triage candidates and the rest, rate ratio, recall."""
    j = census.join(second.select("run_id", "spectrum", F.lit(1).alias("_h")).distinct(), ["run_id", "spectrum"], "left").filter(~F.col("identified"))
    c = F.col("triage") == 1
    h = F.col("_h") == 1
    g = j.groupBy("run_id").agg(F.count_if(c).alias("cand"), F.count_if(c & h).alias("cand_hits"), F.count_if(~c).alias("rest"), F.count_if(~c & h).alias("rest_hits"))
    rc, rr = F.col("cand_hits") / F.nullif("cand", F.lit(0)), F.col("rest_hits") / F.nullif("rest", F.lit(0))
    return g.withColumn("cand_rate", rc).withColumn("rest_rate", rr).withColumn("ratio", rc / F.nullif(rr, F.lit(0.0))).withColumn(
        "recall", F.col("cand_hits") / F.nullif(F.col("cand_hits") + F.col("rest_hits"), F.lit(0)))


def auroc(df: DataFrame, group: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """Mann-Whitney area per group; ties count half. Scores are counted before they are ordered."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    c = df.groupBy(*group, score).agg(F.sum(F.when(F.col(label), w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label), 0.0).otherwise(w)).alias("n"))
    r = ordered_scan(c, group, score, [Scan("below", "sum", "n", exclusive=True)])
    g = r.groupBy(*group).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("P"), F.sum("n").alias("N"))
    return g.select(*group, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))).alias("auroc"))


def top_precision(df: DataFrame, group: list[str], score: str, label: str, frac: float) -> DataFrame:
    """Precision and recovery among the best ``frac`` of each group by score; score ties share their rate."""
    r = value_ranks(df, group, score)
    lab = df.groupBy(*group, score).agg(F.count_if(F.col(label)).alias("pos"))
    tot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_N"), F.count_if(F.col(label)).alias("_P"))
    j = r.join(lab, [*group, score]).join(tot, group)
    k = F.greatest(F.lit(1), F.round(F.col("_N") * frac)).cast("long")
    take = F.greatest(F.lit(0), F.least(F.col("n"), k - F.col("above")))
    g = j.withColumn("_k", k).withColumn("_t", take).groupBy(*group).agg(F.first("_k").alias("k"), F.first("_P").alias("_P"), F.sum(F.col("pos") * F.col("_t") / F.col("n")).alias("hits"))
    return g.select(*group, "k", (F.col("hits") / F.col("k")).alias("precision"), (F.col("hits") / F.nullif(F.col("_P"), F.lit(0))).alias("recovery"))


#: Distribution function of a Poisson variable of mean one, up to the last that differs from one.
POISSON_ONE = [x for x in itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(25)) if x < 1.0]


def cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, value: str, B: int = 200, seed: int = 1) -> DataFrame:
    """Percentile interval of a mean by resampling clusters.

    Values are summed per cluster first; a cluster's multiplicity in each resample is a Poisson(1) draw
    from a hash, so no resample needs a shuffle of its own.
    """
    c = df.groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    u = even_hash(cluster, "b", seed=seed)
    mult = sum(((u >= x).cast("int") for x in POISSON_ONE), F.lit(0))
    d = c.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(B)))).withColumn("m", mult).filter("m > 0")
    per = d.groupBy(*by, "b").agg((F.sum(F.col("s") * F.col("m")) / F.sum(F.col("n") * F.col("m"))).alias("mean"))
    est = c.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("estimate"), F.count(F.lit(1)).alias("clusters"))
    q = per.groupBy(*by).agg(F.percentile("mean", [0.025, 0.975]).alias("q"))
    return est.join(q, by).select(*by, "clusters", "estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def paired_stats(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Per comparison: shares with Wilson intervals, discordant counts, exact McNemar p and Holm p.

    Comparisons are few (one per setting and run), so Holm's order is a plain window.
    """
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a)).alias("ka"), F.count_if(F.col(b)).alias("kb"),
                               F.count_if(F.col(a) & ~F.col(b)).alias("b01"), F.count_if(~F.col(a) & F.col(b)).alias("b10"))
    lo, hi = stats.wilson("ka", "n")
    m, k = F.col("b01") + F.col("b10"), F.least("b01", "b10")
    lower = stats.binomial_upper(m, m - k, F.lit(0.5))   # the lower tail, by symmetry
    p = F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(m > k, lower).otherwise(1.0)))
    g = g.withColumn("low", lo).withColumn("high", hi).withColumn("p", p)
    w = W.orderBy("p", *by)
    g = g.withColumn("_r", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(W.partitionBy()))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col("p"))
    return g.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_r", "_m", "_s")


def confusion(table: DataFrame, by: list[str], call: str, truth: str) -> DataFrame:
    """tp, fn, fp, tn with sensitivity and specificity per group."""
    c, t = F.col(call), F.col(truth)
    g = table.groupBy(*by).agg(F.count_if(t & c).alias("tp"), F.count_if(t & ~c).alias("fn"), F.count_if(~t & c).alias("fp"), F.count_if(~t & ~c).alias("tn"))
    return rates(g)


def rates(g: DataFrame) -> DataFrame:
    return g.withColumn("sensitivity", F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).withColumn(
        "specificity", F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), F.lit(0)))


def cohen_kappa(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    g = df.groupBy(*by).agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias("po"), F.avg(F.col(a).cast("int")).alias("pa"), F.avg(F.col(b).cast("int")).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return g.select(*by, F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).alias("kappa"))


def threshold_sweep(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Rates of ``score >= threshold`` for every threshold, in one pass over the table."""
    c = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(truth) & (F.col(score) >= t)).alias("tp"), F.count_if(F.col(truth) & (F.col(score) < t)).alias("fn"),
                  F.count_if(~F.col(truth) & (F.col(score) >= t)).alias("fp"), F.count_if(~F.col(truth) & (F.col(score) < t)).alias("tn")) for t in thresholds]
    return rates(df.agg(F.array(*c).alias("x")).select(F.explode("x").alias("x")).select("x.*"))


def genus_table(universe: DataFrame, truth: DataFrame, arms: DataFrame) -> DataFrame:
    """One row per genus of the universe or of any arm: truth, status and the arms' evidence side by side.

    ``arms``: arm (default, deconv, gapped), genus, value, place.
    """
    p = arms.groupBy("genus").pivot("arm", ["default", "deconv", "gapped"]).agg(F.max("value").alias("value"), F.min("place").alias("place"))
    j = universe.select("genus", F.lit(True).alias("in_index")).join(truth.select("genus", "fraction", F.lit(True).alias("truth")), "genus", "full_outer").join(p, "genus", "full_outer")
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.withColumn("in_index", b("in_index")).withColumn("truth", b("truth")).withColumn(
        "status", F.when(F.col("truth"), F.when(F.col("in_index"), "positive").otherwise("out_of_index")).otherwise("negative"))


def peptide_agreement(pred: DataFrame, psms: DataFrame) -> DataFrame:
    """(n, exact, share): predictions equal to the known peptide, I as L, modifications ignored."""
    gt = psms.groupBy("key").agg(F.min("peptide").alias("known"))
    m = pred.join(gt, "key").withColumn("ok", S.normalize_peptide("peptide") == S.normalize_peptide("known"))
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("exact"), F.avg(F.col("ok").cast("int")).alias("share"))


def tags_from_predictions(pred: DataFrame, k: int) -> DataFrame:
    """(key, tag, pos, nterm_mass, cterm_mass): every length-k substring of a predicted peptide with flanks."""
    # dealt out before the rows multiply: a small file is read by one task
    p = dealt(pred.select("key", "peptide"), "key").select("key", S.normalize_peptide("peptide").alias("p")).filter(F.length("p") >= k).withColumn("_m", S.prefix_masses("p"))
    x = p.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("p") - k)))
    return x.select("key", F.expr(f"substring(p, pos + 1, {k})").alias("tag"), "pos", F.get("_m", F.col("pos")).alias("nterm_mass"), (F.element_at("_m", -1) - F.get("_m", F.col("pos") + k)).alias("cterm_mass"))


def sdrf_truth(rows: DataFrame) -> DataFrame:
    """(run_id, enzyme, label, alkylation) from annotation rows (run_id, key, value).

    Trypsin with Lys-C counts as trypsin; other mixtures are ``mixed``.
    """
    table = F.create_map(*[F.lit(x) for kv in ENZYME_WORDS.items() for x in kv])
    low = F.lower(F.trim("value"))
    enz = rows.filter(F.lower("key").contains("cleavage agent")).withColumn("e", F.coalesce(F.element_at(table, low), F.trim("value")))
    enz = enz.filter("e <> ''").groupBy("run_id").agg(F.array_sort(F.collect_set("e")).alias("s"))
    enzyme = (F.when(F.array_contains("s", "Trypsin") & (F.size(F.array_except("s", F.array(F.lit("Trypsin"), F.lit("Lys-C")))) == 0), "Trypsin")
              .when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise("mixed"))
    text = rows.filter(F.lower("key").rlike("label|modification")).groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set(low)), " ").alias("t"))
    label = (F.when(F.col("t").rlike("tmtpro|tmt ?16|tmt 18"), "TMTpro").when(F.col("t").contains("tmt"), "TMT").when(F.col("t").rlike("itraq ?4"), "iTRAQ4")
             .when(F.col("t").contains("itraq"), "iTRAQ8").when(F.col("t").rlike("silac|label:13c|label:2h"), "SILAC").otherwise("label-free"))
    alk = (F.when(F.col("t").rlike("carbamidomethyl|iodoacetamide"), "Carbamidomethyl").when(F.col("t").rlike("propionamide|acrylamide"), "Propionamide")
           .when(F.col("t").rlike("methylthio|mmts"), "Methylthio").when(F.col("t").contains("nethylmaleimide"), "Nethylmaleimide"))
    runs = rows.select("run_id").distinct()
    return runs.join(enz.select("run_id", enzyme.alias("enzyme")), "run_id", "left").join(text.select("run_id", label.alias("label"), alk.alias("alkylation")), "run_id", "left").select(
        "run_id", "enzyme", F.coalesce("label", F.lit("label-free")).alias("label"), "alkylation")


def score_species(report: DataFrame, expected: DataFrame) -> DataFrame:
    """Per run: top name, place of the expected one, top-1 correctness and first-to-second ratio."""
    r = report.join(expected, "run_id")
    g = r.groupBy("run_id", "expected").agg(F.min_by("name", "place").alias("top"), F.min(F.when(F.lower("name") == F.lower(F.trim("expected")), F.col("place"))).alias("expected_rank"), F.count(F.lit(1)).alias("taxa"),
                                            F.max(F.when(F.col("place") == 1, F.col("observed"))).alias("o1"), F.max(F.when(F.col("place") == 2, F.col("observed"))).alias("o2"))
    return g.select("run_id", "expected", "top", "expected_rank", F.coalesce(F.col("expected_rank") == 1, F.lit(False)).alias("top1_correct"), "taxa", F.round(F.col("o1") / F.nullif("o2", F.lit(0)), 4).alias("ratio"))


def score_digest(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """Per run: expected and called class, and whether they agree (NULL without a call or truth)."""
    return truth.join(calls, "run_id", "left").select("run_id", "expected", "call", F.when(F.col("call").isNotNull() & F.col("expected").isNotNull(), F.col("expected") == F.col("call")).alias("correct"))


def truth_qc(psms: DataFrame, by: list[str], min_psms: int = 100, min_ratio: float = 5.0) -> DataFrame:
    """Targets, decoys, their ratio and whether the set is usable."""
    g = psms.groupBy(*by).agg(F.count_if(~F.col("is_decoy")).alias("targets"), F.count_if(F.col("is_decoy")).alias("decoys"))
    ratio = F.col("targets") / F.greatest(F.col("decoys"), F.lit(1))
    return g.withColumn("ratio", ratio).withColumn("ok", (F.col("targets") >= min_psms) & (ratio >= min_ratio))


def attribute_tags(tags: DataFrame, pairs: DataFrame, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """Tags as pep1, pep2, both or neither, and per spectrum the rank-1 and top-k flags."""
    p = dealt(pairs.select("key", "pep1", "pep2"), "key").select("key", S.normalize_peptide("pep1").alias("_1"), S.normalize_peptide("pep2").alias("_2"))
    m = keyed_join(tags, p.withColumn("_m1", S.prefix_masses("_1")).withColumn("_m2", S.prefix_masses("_2")), ["key"])
    m = m.withColumn("_t", S.normalize_tag("tag"))
    m = m.withColumn("c1", tag_is_correct("tag", "nterm_mass", "cterm_mass", "_1", prefix="_m1", folded="_t")).withColumn("c2", tag_is_correct("tag", "nterm_mass", "cterm_mass", "_2", prefix="_m2", folded="_t"))
    m = m.withColumn("attribution", F.when(F.col("c1") & F.col("c2"), "both").when(F.col("c1"), "pep1").when(F.col("c2"), "pep2").otherwise("neither")).drop("_t", "_1", "_2", "_m1", "_m2")
    t = F.col("rank") <= k
    g = m.groupBy("key").agg(F.bool_or((F.col("rank") == 1) & F.col("c1")).alias("pep1_rank1"), F.bool_or(t & F.col("c1")).alias("pep1_topk"), F.bool_or(t & F.col("c2")).alias("pep2_topk"),
                             F.min(F.when(F.col("rank") == 1, F.col("attribution"))).alias("rank1_attribution"))
    per = keyed_join(p.select("key"), g, ["key"], "left").select("key", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("pep1_rank1", "pep1_topk", "pep2_topk")],
        F.coalesce(F.col("pep1_topk") & F.col("pep2_topk"), F.lit(False)).alias("both_topk"), F.coalesce("rank1_attribution", F.lit("untagged")).alias("rank1_attribution"))
    return m, per


def two_group_boot(df: DataFrame, group: str, cluster: str, value: str, B: int = 200, seed: int = 1) -> DataFrame:
    """Difference of the two groups' means with a cluster-resampling interval (group is boolean)."""
    c = df.groupBy(group, cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    u = even_hash(cluster, "b", group, seed=seed)
    mult = sum(((u >= x).cast("int") for x in POISSON_ONE), F.lit(0))
    d = c.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B)))).withColumn("m", F.when(F.col("b") == 0, 1).otherwise(mult))
    mean = lambda g: F.sum(F.when(F.col(group) == g, F.col("s") * F.col("m"))) / F.sum(F.when(F.col(group) == g, F.col("n") * F.col("m")))
    per = d.groupBy("b").agg((mean(True) - mean(False)).alias("diff"))
    return per.agg(F.max(F.when(F.col("b") == 0, F.col("diff"))).alias("difference"), F.percentile(F.when(F.col("b") > 0, F.col("diff")), [0.025, 0.975]).alias("q")).select("difference", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def stratified_diff(df: DataFrame, stratum: str, group: str, value: str) -> DataFrame:
    """Difference of group means within strata, weighted by the smaller group's size."""
    v = F.col(value).cast("double")
    g = df.groupBy(stratum).agg(F.avg(F.when(F.col(group), v)).alias("a"), F.avg(F.when(~F.col(group), v)).alias("b"), F.least(F.count_if(F.col(group)), F.count_if(~F.col(group))).alias("w"))
    return g.filter("w > 0").agg((F.sum((F.col("a") - F.col("b")) * F.col("w")) / F.sum("w")).alias("difference"), F.count(F.lit(1)).alias("strata"))


def cluster_permutation(df: DataFrame, cluster: str, diff: str, B: int = 500, seed: int = 1) -> DataFrame:
    """Sign-flip permutation p-value of the sum of cluster differences."""
    c = df.groupBy(cluster).agg(F.sum(F.col(diff).cast("double")).alias("s"))
    d = c.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B)))).withColumn("f", F.when((F.col("b") == 0) | (even_hash(cluster, "b", seed=seed) < 0.5), 1).otherwise(-1))
    per = d.groupBy("b").agg(F.sum(F.col("s") * F.col("f")).alias("t"))
    obs = per.filter("b = 0").select(F.abs("t").alias("o"))
    return per.filter("b > 0").join(F.broadcast(obs)).agg(F.first("o").alias("statistic"), ((F.count_if(F.abs("t") >= F.col("o") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def truth_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(both, same_peptide, only_a, only_b) of two truth sets (key, peptide)."""
    j = a.select("key", S.normalize_peptide("peptide").alias("pa")).join(b.select("key", S.normalize_peptide("peptide").alias("pb")), "key", "full_outer")
    return j.agg(F.count_if(F.col("pa").isNotNull() & F.col("pb").isNotNull()).alias("both"), F.count_if(F.col("pa") == F.col("pb")).alias("same_peptide"),
                 F.count_if(F.col("pb").isNull()).alias("only_a"), F.count_if(F.col("pa").isNull()).alias("only_b"))


def union_clusters(spectra: DataFrame) -> DataFrame:
    """(key, cluster): spectra connected through either of their peptides (key, pep1, pep2).

    Edges join each peptide with its spectra's other peptide, so the graph is linear in the spectra.
    """
    p = spectra.select("key", S.normalize_peptide("pep1").alias("a"), S.normalize_peptide("pep2").alias("b"))
    nodes = p.select(F.col("a").alias("node")).unionByName(p.filter("b IS NOT NULL").select(F.col("b").alias("node"))).distinct()
    c = connected_components(p.filter("b IS NOT NULL").select("a", "b"), nodes)
    return keyed_join(p.withColumnRenamed("a", "node"), c, ["node"]).select("key", F.col("component").alias("cluster"))


def call_confusion(calls: DataFrame, classes: list[str]) -> DataFrame:
    """truth x call counts per panel and over all panels; missing calls are no_call, missing truth
    not_evaluable. ``calls``: panel, truth, call."""
    c = calls.withColumn("truth", F.coalesce("truth", F.lit("not_evaluable"))).withColumn("call", F.coalesce("call", F.lit("no_call")))
    cols = [F.count_if(F.col("call") == x).alias(x) for x in [*classes, "no_call"]]
    return c.cube("panel", "truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("call")).alias("agree"), *cols)
