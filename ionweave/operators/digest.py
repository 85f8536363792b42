"""Tag-end counts, protease models, labels and digestion quality."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionweave.functions import constants as K
from ionweave.operators.core import range_join

WATER = 18.010565
# Residue keys of tag ends (name, mass, residue it counts as; C carbamidomethylated).
RESIDUE_KEYS = [
    ("G", 57.02146, "G"), ("A", 71.03711, "A"), ("S", 87.03203, "S"), ("P", 97.05276, "P"), ("V", 99.06841, "V"), ("T", 101.04768, "T"),
    ("C", 160.03065, "C"), ("L", 113.08406, "L"), ("N", 114.04293, "N"), ("D", 115.02694, "D"), ("Q", 128.05858, "Q"), ("K", 128.09496, "K"),
    ("E", 129.04259, "E"), ("M", 131.04049, "M"), ("H", 137.05891, "H"), ("F", 147.06841, "F"), ("R", 156.10111, "R"), ("Y", 163.06333, "Y"),
    ("W", 186.07931, "W"), ("K+TMT", 128.09496 + 229.162932, "K"), ("K+TMTpro", 128.09496 + 304.207146, "K"),
    ("K+iTRAQ4", 128.09496 + 144.102063, "K"), ("K+8", 128.09496 + 8.014199, "K"), ("R+10", 156.10111 + 10.008269, None)]
LABELS = [("TMT", 229.162932), ("TMTpro", 304.207146), ("iTRAQ4", 144.102063)]
LABEL_TAG_MIN, LABEL_MIN_SHARE, LABEL_FOLD = 175, 0.01, 20.0
HEAVY_MIN, HEAVY_STRONG, KR_TRYPTIC, SILAC_MIN = 0.2, 0.3, 0.8, 50


def counted_tags(tags: DataFrame) -> DataFrame:
    """Ungapped tags with E <= 1."""
    return tags.filter(~F.col("gapped") & (F.col("evalue") <= 1))


def tag_ends(tags: DataFrame, window: float = 0.008) -> DataFrame:
    """One row per tag end at a residue key: kind c (C flank), h (reversed read: N flank less water), n.

    Flanks meet the 24 fixed keys in a broadcast cell lookup; no shuffle.
    """
    keys = tags.sparkSession.createDataFrame(RESIDUE_KEYS, "key string, key_mass double, residue string")
    flank = F.explode(F.array(F.struct(F.lit("c").alias("kind"), F.col("cterm_mass").alias("m")),
                              F.struct(F.lit("h").alias("kind"), (F.col("nterm_mass") - WATER).alias("m")),
                              F.struct(F.lit("n").alias("kind"), F.col("nterm_mass").alias("m"))))
    t = counted_tags(tags).select("run_id", "seq", flank.alias("f")).select("run_id", "seq", "f.kind", "f.m")
    return range_join(t, keys, [], F.col("m") - window, F.col("m") + window, "key_mass", 2.0, small_right=True)


def terminus_counts(tags: DataFrame, window: float = 0.008) -> DataFrame:
    """(run_id, key, kind, n): tag ends at residue keys (c, h, n) and at labels (lab_n, lab_c) with their
    +0.5 Da controls (bg_n, bg_c)."""
    ends = tag_ends(tags, window).groupBy("run_id", "key", "kind").agg(F.count(F.lit(1)).alias("n"))
    t = counted_tags(tags)
    near = lambda c, m: F.abs(F.col(c) - m) <= window
    items = []
    for name, m in LABELS:
        for kind, c, mm in (("lab_n", "nterm_mass", m), ("lab_c", "cterm_mass", m), ("bg_n", "nterm_mass", m + 0.5), ("bg_c", "cterm_mass", m + 0.5)):
            items.append(F.when(near(c, mm), F.struct(F.lit(name).alias("key"), F.lit(kind).alias("kind"))))
    lab = t.select("run_id", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).groupBy(
        "run_id", F.col("x.key").alias("key"), F.col("x.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return ends.unionByName(lab)


def position_counts(tags: DataFrame, window: float = 0.008) -> DataFrame:
    """(run_id, side, p1, position, residue, n): residues at P1 (position 1) and P2..P4 beside counted ends.

    ``side`` C holds C flanks and reversed reads, N the primed positions.
    """
    e = tag_ends(tags, window).filter("residue IS NOT NULL").withColumn("side", F.when(F.col("kind") == "n", "N").otherwise("C"))
    letters = F.split(F.when(F.col("kind") == "c", F.reverse("seq")).otherwise(F.col("seq")), "(?!^)(?=.)")
    inner = F.transform(F.slice(letters, 1, 3), lambda r, i: F.struct((i + 2).alias("position"), r.alias("residue")))
    own = F.array(F.struct(F.lit(1).alias("position"), F.col("residue").alias("residue")))
    x = e.select("run_id", "side", F.col("residue").alias("p1"), F.explode(F.concat(own, inner)).alias("x"))
    return x.groupBy("run_id", "side", "p1", F.col("x.position").alias("position"), F.col("x.residue").alias("residue")).agg(F.count(F.lit(1)).alias("n"))


def composition(proteins: DataFrame, group: list[str], pseudo: float = 0.0) -> DataFrame:
    """(group, residue, n, freq): residue frequencies, ambiguity codes left out."""
    x = proteins.select(*group, F.explode(F.split("sequence", "(?!^)(?=.)")).alias("residue")).filter("residue <> '#' AND residue <> ''")
    n = x.groupBy(*group, "residue").agg(F.count(F.lit(1)).alias("n"))
    tot = n.groupBy(*group).agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    j = n.join(tot, group) if group else n.crossJoin(F.broadcast(tot))   # one-row total
    return j.select(*group, "residue", "n", ((F.col("n") + pseudo) / (F.col("_t") + pseudo * F.col("_k"))).alias("freq"))


def protease_models(spark, background: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(model, side, residue, freq): each end uniform over its cleaving residues, '*' = background.

    ``rules``: model -> (C-end residues or '*', N-end residues or '*'). ``background``: residue, freq.
    """
    rows = [(m, s, r, 1.0 / len(x)) for m, ends in rules.items() for s, x in zip("CN", ends) if x != "*" for r in x]
    own = spark.createDataFrame(rows, "model string, side string, residue string, freq double")
    bg = spark.createDataFrame([(m, s) for m, ends in rules.items() for s, x in zip("CN", ends) if x == "*"] or [("", "")], "model string, side string")
    return own.unionByName(bg.filter("model <> ''").crossJoin(F.broadcast(background)).select("model", "side", "residue", "freq"))


def classify_protease(counts: DataFrame, models: DataFrame, background: DataFrame, share: float = 0.15, tag_min: int = 50) -> DataFrame:
    """(run_id, model, loglik, n_used, rank, margin): multinomial log-likelihood of every model.

    ``counts``: run_id, side, residue, n. Each model end is mixed with ``share`` background; the N end
    counts only with ``tag_min`` ends. The margin is per end against the runner-up. Runs with fewer
    C ends give no rows.
    """
    tot = counts.groupBy("run_id", "side").agg(F.sum("n").alias("t"))
    c_ok = tot.filter((F.col("side") == "C") & (F.col("t") >= tag_min)).select("run_id")
    used = tot.filter(F.col("t") >= tag_min).join(c_ok, "run_id", "left_semi")
    grid = models.select("model", "side").distinct().join(F.broadcast(background.select("residue", F.col("freq").alias("bg"))))
    grid = grid.join(models, ["model", "side", "residue"], "left").withColumn("p", (1 - share) * F.coalesce("freq", F.lit(0.0)) + share * F.col("bg"))
    z = grid.groupBy("model", "side").agg(F.sum("p").alias("z"))
    grid = grid.join(z, ["model", "side"]).select("model", "side", "residue", F.ln(F.col("p") / F.col("z")).alias("lp"))
    s = counts.join(used, ["run_id", "side"]).join(F.broadcast(grid), ["side", "residue"]).groupBy("run_id", "model").agg(F.sum(F.col("n") * F.col("lp")).alias("loglik"))
    n = used.groupBy("run_id").agg(F.sum("t").alias("n_used"))
    w = W.partitionBy("run_id").orderBy(F.desc("loglik"), "model")
    return s.join(n, "run_id").withColumn("rank", F.row_number().over(w)).withColumn(
        "margin", (F.col("loglik") - F.lead("loglik").over(w)) / F.col("n_used"))


def flank2_bins(spark, window: float = 0.008) -> DataFrame:
    """(a, b, sum, bin): ordered residue pairs in single-linkage bins of their mass (361 fixed rows)."""
    base = RESIDUE_KEYS[:19]
    rows = [(x, y, mx + my) for x, mx, _ in base for y, my, _ in base]
    d = spark.createDataFrame(rows, "a string, b string, sum double")
    w = W.orderBy("sum", "a", "b")
    return d.withColumn("_n", F.when(F.col("sum") - F.lag("sum").over(w) > window, 1).otherwise(0)).withColumn(
        "bin", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_n")


def flank2_counts(tags: DataFrame, bins: DataFrame, window: float = 0.008) -> DataFrame:
    """(run_id, bin, n): C flanks and reversed N flanks at the nearest two-residue sum."""
    flank = F.explode(F.array("cterm_mass", F.col("nterm_mass") - WATER))
    t = counted_tags(tags).withColumn("_id", F.monotonically_increasing_id()).select("run_id", "_id", flank.alias("m"))
    t = t.withColumn("_f", F.xxhash64("run_id", "_id", "m"))
    sums = bins.groupBy(F.col("sum")).agg(F.min("bin").alias("bin"))
    h = range_join(t, sums, [], F.col("m") - window, F.col("m") + window, "sum", 2.0, small_right=True)
    b = h.groupBy("run_id", "_f").agg(F.min_by("bin", F.struct(F.abs(F.col("sum") - F.col("m")), F.col("sum"))).alias("bin"))
    return b.groupBy("run_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def classify_flank2(counts: DataFrame, bins: DataFrame, models: DataFrame, background: DataFrame, share: float = 0.15) -> DataFrame:
    """(run_id, model, loglik, rank) from the histogram of two-residue flanks; P1 is the second residue."""
    bg = background.select(F.col("residue").alias("a"), F.col("freq").alias("pa"))
    p1 = models.filter("side = 'C'").select("model").distinct().join(F.broadcast(background.select(F.col("residue").alias("b"), F.col("freq").alias("bgb"))))
    p1 = p1.join(models.filter("side = 'C'").select("model", F.col("residue").alias("b"), "freq"), ["model", "b"], "left")
    p1 = p1.withColumn("pb", (1 - share) * F.coalesce("freq", F.lit(0.0)) + share * F.col("bgb"))
    pred = bins.join(F.broadcast(bg), "a").join(F.broadcast(p1.select("model", "b", "pb")), "b").groupBy("model", "bin").agg(F.sum(F.col("pa") * F.col("pb")).alias("p"))
    z = pred.groupBy("model").agg(F.sum("p").alias("z"))
    pred = pred.join(z, "model").select("model", "bin", F.ln(F.greatest(F.col("p") / F.col("z"), F.lit(1e-300))).alias("lp"))
    s = counts.join(F.broadcast(pred), "bin").groupBy("run_id", "model").agg(F.sum(F.col("n") * F.col("lp")).alias("loglik"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("loglik"), "model")))


def p_correct(margin: Column, n: Column, first_peak: Column, coef: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)) -> Column:
    """Logistic calibration of the protease call (intercept, margin, ln n, first peak)."""
    z = coef[0] + coef[1] * margin + coef[2] * F.ln(F.greatest(n, F.lit(1))) + coef[3] * first_peak.cast("int")
    return 1 / (1 + F.exp(-z))


def long_report(df: DataFrame, section: str, keys: list[str]) -> DataFrame:
    """Wide per-run figures to report rows (run_id, section, key, value, n, description)."""
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("-")).alias("value")) for k in keys]))
    return df.select("run_id", F.lit(section).alias("section"), items.alias("x")).select(
        "run_id", "section", "x.key", "x.value", F.lit("-").alias("n"), F.concat(F.col("x.key"), F.lit(" is "), F.col("x.value")).alias("description"))


def digest_report(tags: DataFrame, calls: DataFrame, window: float = 0.008) -> DataFrame:
    """All digest rows of a run: settings, tag counts, end counts and the top call."""
    tot = tags.groupBy("run_id").agg(F.count(F.lit(1)).alias("tags"), F.count_if(~F.col("gapped") & (F.col("evalue") <= 1)).alias("tags_filtered"))
    head = long_report(tot.withColumn("window_da", F.lit(window)), "run", ["window_da", "tags", "tags_filtered"])
    ends = terminus_counts(tags, window).select("run_id", F.lit("count").alias("section"), F.concat("kind", F.lit("."), "key").alias("key"),
        F.col("n").cast("string").alias("value"), F.col("n").cast("string").alias("n"), F.concat("n", F.lit(" tag ends at "), "key").alias("description"))
    top = calls.filter("rank = 1").select("run_id", F.col("model"), F.round("margin", 6).alias("margin"), "n_used")
    return head.unionByName(ends).unionByName(long_report(top, "call", ["model", "margin", "n_used"]))


def label_call(tags: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per run: label (joined names or label-free), silac, silac_strong, reason.

    ``counts`` is terminus_counts(); ends c and h together count as C ends.
    """
    tot_tags = counted_tags(tags).groupBy("run_id").agg(F.count(F.lit(1)).alias("tags"))
    res = counts.filter("kind IN ('c', 'h')").groupBy("run_id").agg(
        F.sum("n").alias("tot"), F.sum(F.when(F.col("key").rlike("^[KR]"), F.col("n")).otherwise(0)).alias("kr"),
        *[F.sum(F.when(F.col("key") == k, F.col("n")).otherwise(0)).alias(a) for k, a in (("K", "k"), ("K+8", "k8"), ("R", "r"), ("R+10", "r10"))])
    lab = counts.filter("kind LIKE 'lab%' OR kind LIKE 'bg%'").groupBy("run_id").agg(*[
        x for name, _ in LABELS for x in (F.sum(F.when((F.col("key") == name) & F.col("kind").startswith("lab"), F.col("n")).otherwise(0)).alias(f"x_{name}"),
                                          F.sum(F.when((F.col("key") == name) & F.col("kind").startswith("bg"), F.col("n")).otherwise(0)).alias(f"b_{name}"))])
    j = tot_tags.join(res, "run_id", "left").join(lab, "run_id", "left").fillna(0)
    passed = [F.when((F.col(f"x_{n}") >= LABEL_MIN_SHARE * F.col("tags")) & (F.col(f"x_{n}") >= LABEL_FOLD * F.greatest(F.col(f"b_{n}"), F.lit(1))), F.lit(n)) for n, _ in LABELS]
    hk = F.col("k8") / F.greatest(F.col("k8") + F.col("k"), F.lit(1))
    hr = F.col("r10") / F.greatest(F.col("r10") + F.col("r"), F.lit(1))
    silac = ((hk >= HEAVY_MIN) & (hr >= HEAVY_MIN) & (F.round(F.col("kr") / F.col("tot"), 3) >= KR_TRYPTIC)
             & (F.col("k") + F.col("k8") >= SILAC_MIN) & (F.col("r") + F.col("r10") >= SILAC_MIN))
    names = F.array_compact(F.array(*passed, F.when(silac, "SILAC")))
    called = F.col("tot") >= LABEL_TAG_MIN
    return j.select("run_id", "tags", "tot", F.when(called, "call").otherwise("no_call").alias("status"),
                    F.when(~called, "-").when(F.size(names) == 0, "label-free").otherwise(F.array_join(names, "+")).alias("label"),
                    (called & silac).alias("silac"), (called & silac & (F.least(hk, hr) >= HEAVY_STRONG)).alias("silac_strong"),
                    F.when(~called, "few_tags").otherwise("-").alias("reason"))


def mixture_share(counts: Column, p: Column, bg: Column, steps: int = 60) -> Column:
    """Maximum-likelihood background share s of (1 - s) p + s bg for parallel arrays, by bisection."""
    z = F.arrays_zip(counts.alias("k"), p.alias("p"), bg.alias("b"))
    def slope(s):
        return F.aggregate(z, F.lit(0.0), lambda a, x: a + F.when(x.k > 0, x.k * (x.b - x.p) / F.greatest((1 - s) * x.p + s * x.b, F.lit(1e-300))).otherwise(0.0))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), lambda a, i: F.when(
        slope((a.lo + a.hi) / 2) > 0, F.struct(((a.lo + a.hi) / 2).alias("lo"), a.hi.alias("hi"))).otherwise(F.struct(a.lo.alias("lo"), ((a.lo + a.hi) / 2).alias("hi"))),
        lambda a: (a.lo + a.hi) / 2)
    return F.when(~(slope(F.lit(0.0)) > 0), 0.0).when(~(slope(F.lit(1.0)) < 0), 1.0).otherwise(run)


def digest_quality(positions: DataFrame, sites: str, background: DataFrame, tag_min: int = 50, side: str = "C") -> DataFrame:
    """Per run: ends, specific ends, non-specific share and its mixture estimate, missed-cleavage retention.

    ``positions`` is position_counts(); ``sites`` the cleaving residues of the called enzyme.
    """
    spark = positions.sparkSession
    inside = F.col("residue").isin(list(sites))
    at = positions.filter(F.col("side") == side)
    p1 = at.filter("position = 1").groupBy("run_id", "residue").agg(F.sum("n").alias("n"))
    bg = background.select("residue", F.col("freq").alias("b"), F.when(inside, 1.0 / len(sites)).otherwise(0.0).alias("p"))
    full = p1.select("run_id").distinct().join(F.broadcast(bg)).join(p1, ["run_id", "residue"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    a = full.groupBy("run_id").agg(
        F.sum("n").alias("ends"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("specific"), F.sum(F.when(inside, F.col("b")).otherwise(0)).alias("bs"),
        F.array_sort(F.collect_list(F.struct("residue", "n", "p", "b"))).alias("v"))
    mc = at.filter((F.col("position") > 1) & F.col("p1").isin(list(sites))).groupBy("run_id").agg(
        F.sum("n").alias("mc_positions"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("mc_sites"))
    j = a.join(mc, "run_id", "left").fillna(0, ["mc_positions", "mc_sites"])
    odds = F.col("mc_sites") / F.nullif(F.col("mc_positions") - F.col("mc_sites"), F.lit(0))
    ok = F.col("ends") >= tag_min
    return j.select("run_id", "ends", "specific", ok.alias("measured"), F.when(ok, 1 - F.col("specific") / F.col("ends")).alias("nonspecific_share"),
                    F.when(ok, mixture_share(F.col("v.n"), F.col("v.p"), F.col("v.b"))).alias("nonspecific_mle"), "mc_positions", "mc_sites",
                    F.when(ok & (F.col("specific") >= tag_min), odds / (F.col("bs") / (1 - F.col("bs")))).alias("mc_retention"))


# Instrument names.
ORBITRAP_WORDS = ["orbitrap", "q exactive", "exploris", "astral", "lumos", "fusion", "eclipse", "ascend"]
HCD_ONLY_WORDS = ["q exactive", "exploris", "astral"]


def instrument_class(meta: DataFrame) -> DataFrame:
    """Adds ``instrument_class``: timstof, orbitrap_hcd or other.

    ``meta``: instrument, integer_share, has_mobility, orbitrap, iontrap, ms2_itms, ms2_ftms, ms2_beam, ms2_resonance.
    """
    name = F.lower(F.coalesce("instrument", F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    tims = F.contains(name, F.lit("timstof")) | F.col("has_mobility") | ((name == "") & (F.col("integer_share") >= 0.5))
    orbi = F.col("orbitrap") | has(ORBITRAP_WORDS)
    c = (F.when(tims, "timstof").when(~orbi | (F.col("ms2_itms") > F.col("ms2_ftms")), "other")
         .when(F.col("ms2_beam") + F.col("ms2_resonance") > 0, F.when(F.col("ms2_beam") > F.col("ms2_resonance"), "orbitrap_hcd").otherwise("other"))
         .when(has(HCD_ONLY_WORDS) | (F.col("orbitrap") & ~F.col("iontrap")), "orbitrap_hcd").otherwise("other"))
    return meta.withColumn("instrument_class", c)
