"""Sequence tags from peaks: budget, residue edges, walks, gaps, extension, complements.

Rows are keyed by (run_id, idx). After ``peak_budget`` a spectrum holds at most ``max_peaks`` peaks, so
every later join and window inside a spectrum is bounded by that budget.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionweave.functions import constants as K, scalar as S
from ionweave.operators import filters
from ionweave.operators.core import dealt, range_join, values
from ionweave.operators.isotopes import deisotope

KEY = ["run_id", "idx"]


@dataclass(frozen=True)
class TagParams:
    """Tagging parameters; the defaults are the library's."""
    tag_length: int = 3
    max_extension: int = 0
    max_gaps: int = 0
    deisotope: bool = False
    frag_tol: float = 20.0
    tol_ppm: bool = True
    complement_tol: float = 0.02
    complement_rule: str = "same"          # same, precursor, both
    complement_factor: float | None = None  # set: window in fragment tolerances
    complement_midp: bool = False
    series: str = "by"
    max_peaks: int = 100
    peaks_per_window: int = 0
    max_tags: int = 50
    max_evalue: float = 20.0
    diversity: bool = False
    gap_penalty: float = 100.0
    tmt_filter: bool = False
    fixed: dict = field(default_factory=lambda: {"C": K.CARBAMIDOMETHYL})
    variable: dict = field(default_factory=dict)   # "X[Name]" -> delta

    def tol(self, mz) -> Column:
        return S.tolerance(mz, self.frag_tol, self.tol_ppm)

    @property
    def min_peaks(self) -> int:
        return max(2, self.tag_length + 1 - max(0, self.max_gaps))


def alphabet(spark, params: TagParams = TagParams()) -> DataFrame:
    """(residue, base, mass): base residues lightest first, then one row per variable modification."""
    rows = [(r, r, m) for r, m in K.residue_rows(params.fixed)]
    base = dict((r, m) for r, _, m in rows)
    rows += [(name, name[0], base[name[0]] + d) for name, d in params.variable.items() if name[0] in base]
    return values(spark, rows, "residue string, base string, mass double")


def residue_pairs(residues: DataFrame) -> DataFrame:
    """(pair_a, pair_b, pair_mass, pair_order): unordered two-residue sums, isobaric ones in letter order."""
    base = residues.filter(F.col("residue") == F.col("base"))
    heavy = base.select(F.col("residue").alias("pair_b"), F.col("mass").alias("mb"))
    # theta self-join of the 19-letter alphabet
    p = base.select(F.col("residue").alias("pair_a"), F.col("mass").alias("ma")).join(
        F.broadcast(heavy), F.expr("ma < mb OR (ma = mb AND pair_a <= pair_b)"))
    p = p.select("pair_a", "pair_b", (F.col("ma") + F.col("mb")).alias("pair_mass"))
    return p.withColumn("pair_order", F.dense_rank().over(W.orderBy(F.round("pair_mass", 5), "pair_a", "pair_b")))


def peak_budget(peaks: DataFrame, per_window: int = 0, max_peaks: int = 100) -> DataFrame:
    """Strongest ``per_window`` peaks per 100 Da (0 = no quota), then the strongest ``max_peaks``.

    Adds ``rk`` (1 = strongest; ties to the higher m/z). Both limits prune map-side before the shuffle.
    """
    order = [F.desc("intensity"), F.desc("mz")]
    if per_window > 0:
        slot = F.floor(F.col("mz") / K.PEAK_WINDOW)
        peaks = (peaks.withColumn("_w", slot)
                 .withColumn("_r", F.row_number().over(W.partitionBy(*KEY, "_w").orderBy(*order)))
                 .filter(F.col("_r") <= per_window).drop("_w", "_r"))
    cap = max_peaks if max_peaks > 0 else K.PEAK_CEILING
    return (peaks.withColumn("rk", F.row_number().over(W.partitionBy(*KEY).orderBy(*order)))
            .filter(F.col("rk") <= cap))


def intensity_rank(peaks: DataFrame) -> DataFrame:
    """``rk``: 1 = strongest peak of a budgeted spectrum, ties to the higher m/z."""
    return peaks.withColumn("rk", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("intensity"), F.desc("mz"))))


def complement_flags(peaks: DataFrame, params: TagParams) -> DataFrame:
    """Adds ``compl``: fragment charges at which the peak has a partner other than itself.

    The nearest peak to the partner position counts (inside the window); needs p, mass, charge_used, n_z.
    """
    pair = K.ION_PAIRS[params.series]
    rules = {"same": ["same"], "precursor": ["precursor"], "both": ["same", "precursor"]}[params.complement_rule]
    c = F.col("charge_used") - F.lit(pair["charge_loss"])
    row = peaks.withColumn("_all", F.collect_list(F.struct("mz", F.col("p").alias("q"))).over(W.partitionBy(*KEY)))

    def found(z, rule):
        want = S.complement_mz(F.col("mass") + F.lit(pair["delta"]), c, z, F.col("mz"), rule)
        if params.complement_factor is None:
            win = F.lit(params.complement_tol)
        else:
            win = F.lit(params.complement_factor) * (params.tol(F.col("mz")) + params.tol(want))
        near = F.filter("_all", lambda x: x.mz.between(want - win, want + win))
        best = F.array_min(F.transform(near, lambda x: F.struct(F.abs(x.mz - want).alias("d"), x.mz.alias("mz"), x.q.alias("q"))))
        return F.coalesce(best.getField("q") != F.col("p"), F.lit(False))

    def partnered(z):
        hit = found(z, rules[0])
        for r in rules[1:]:
            hit = hit | found(z, r)
        return hit

    return row.withColumn("compl", F.filter(F.sequence(F.lit(1), F.col("n_z")), partnered)).drop("_all")


def number_peaks(peaks: DataFrame) -> DataFrame:
    """``p`` (1-based, by m/z) and ``n_kept`` of a budgeted spectrum."""
    w = W.partitionBy(*KEY)
    return peaks.withColumn("p", F.row_number().over(w.orderBy("mz"))).withColumn("n_kept", F.count(F.lit(1)).over(w))


def prepared_peaks(peaks: DataFrame, spectra: DataFrame, params: TagParams = TagParams()) -> DataFrame:
    """The peaks tagging uses, with rank, number, complement charges and per-spectrum constants."""
    x = filters.clean_peaks(peaks, spectra)
    if params.series == "cz":
        x = filters.etd_precursor_filter(x, params.frag_tol, params.tol_ppm)
    x = filters.collapse_equal_mz(x)
    if params.deisotope:
        x = deisotope(x, params.frag_tol, params.tol_ppm)
        if params.series == "cz":
            x = x.filter(F.col("mz") <= F.col("mass") + F.lit(K.PROTON + K.PRECURSOR_SLACK))
    x = number_peaks(peak_budget(x, params.peaks_per_window, params.max_peaks))
    return complement_flags(x, params)


def complement_population(prepared: DataFrame) -> DataFrame:
    """(run_id, idx, z, n_kept, n_compl): peaks with a partner per fragment charge, zeros included."""
    z = prepared.select(*KEY, "n_kept", "compl", F.explode(F.sequence(F.lit(1), F.col("n_z"))).alias("z"))
    return z.groupBy(*KEY, "z").agg(F.first("n_kept").alias("n_kept"),
                                    F.sum(F.array_contains("compl", F.col("z")).cast("int")).alias("n_compl"))


def _span_pairs(prepared: DataFrame, lo: float, hi: float, params: TagParams) -> DataFrame:
    """Peak pairs of one spectrum whose charge-scaled difference can be a mass in [lo, hi].

    A spectrum's peaks, whose number the budget bounds, are one array in which each peak finds its partners: peaks are dealt out
    once by spectrum, and pairs are made after that.
    """
    node = F.struct("p", "mz", "rk", "intensity", "compl")
    per = prepared.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("n_kept", "mass", "n_z")], F.array_sort(F.collect_list(node)).alias("_nodes"))
    src = per.select(*KEY, "n_kept", "mass", "n_z", "_nodes", F.explode("_nodes").alias("a"))
    src = src.select(*KEY, "n_kept", "mass", "_nodes", "a", F.explode(F.sequence(F.lit(1), F.col("n_z"))).alias("z"))
    # tolerance at the far end of the interval, the widest a pair can have
    top = (F.col("a.mz") + F.lit(hi) / F.col("z")) * 1.001 + 1.0
    pad = params.tol(top)
    src = src.withColumn("_lo", F.col("a.mz") + F.lit(lo) / F.col("z") - pad).withColumn("_hi", F.col("a.mz") + F.lit(hi) / F.col("z") + pad)
    partners = F.filter("_nodes", lambda b: b.mz.between(F.col("_lo"), F.col("_hi")))
    return src.select(*KEY, "n_kept", "mass", "a", "z", F.explode(partners).alias("b"))


def residue_edges(prepared: DataFrame, residues: DataFrame, params: TagParams = TagParams()) -> DataFrame:
    """For every peak, charge and residue the nearest peak within tolerance of mz + mass/z.

    Columns: a, b (end nodes), z, residue, step (mass), err. ``residues`` is the alphabet table.
    """
    base = dict(K.residue_rows(params.fixed))
    masses = [*base.values(), *[base[n[0]] + d for n, d in params.variable.items()]]
    pairs = _span_pairs(prepared, min(masses), max(masses), params)
    diff = (F.col("b.mz") - F.col("a.mz")) * F.col("z")
    slack = params.tol((F.col("b.mz")) * 1.001 + 1.0) * F.col("z")
    hit = range_join(pairs, residues.select("residue", F.col("mass").alias("step")), [], diff - slack, diff + slack,
                     "step", 2.0, small_right=True)
    target = F.col("a.mz") + F.col("step") / F.col("z")
    hit = hit.withColumn("err", F.abs(F.col("b.mz") - target)).filter(F.col("err") <= params.tol(target))
    best = F.row_number().over(W.partitionBy(*KEY, "z", "a.p", "residue").orderBy("err", "b.mz"))
    return (hit.withColumn("_r", best).filter("_r = 1").filter("b.p > a.p").drop("_r"))


def _gap_pairs(prepared: DataFrame, pairs: DataFrame, params: TagParams) -> DataFrame:
    """Peak pairs of one spectrum with every two-residue sum that their difference fits."""
    masses = [m for _, m in K.residue_rows(params.fixed)]
    span = _span_pairs(prepared, 2 * min(masses), 2 * max(masses), params)
    diff = (F.col("b.mz") - F.col("a.mz")) * F.col("z")
    tol = params.tol(F.col("b.mz")) * F.col("z")
    return range_join(span, pairs, [], diff - tol, diff + tol, "pair_mass", 2.0, small_right=True)


def gap_edges(prepared: DataFrame, pairs: DataFrame, edges: DataFrame, params: TagParams = TagParams()) -> DataFrame:
    """Peak pairs a two-residue sum apart (best pair), unless two residue edges already bridge them."""
    hit = _gap_pairs(prepared, pairs, params)
    hit = hit.withColumn("err", F.abs(F.col("pair_mass") - (F.col("b.mz") - F.col("a.mz")) * F.col("z")))
    best = F.row_number().over(W.partitionBy(*KEY, "z", "a.p", "b.p").orderBy("err", "pair_order"))
    hit = hit.withColumn("_r", best).filter("_r = 1").drop("_r").withColumn("pa", F.col("a.p")).withColumn("pb", F.col("b.p"))
    e1 = edges.select(*KEY, "z", F.col("a.p").alias("pa"), F.col("b.p").alias("pm"))
    e2 = edges.select(*KEY, "z", F.col("a.p").alias("pm"), F.col("b.p").alias("pb"))
    bridged = e1.join(e2, [*KEY, "z", "pm"]).select(*KEY, "z", "pa", "pb").distinct()
    return hit.join(bridged, [*KEY, "z", "pa", "pb"], "left_anti").drop("pa", "pb")


def _step(text, a2, b2, mass) -> Column:
    return F.struct(text.alias("text"), a2.alias("a2"), b2.alias("b2"), mass.alias("m"))


def _steps(edges: DataFrame, gaps: DataFrame | None) -> DataFrame:
    """Edges of both kinds as steps: a residue (text) or an unobserved pair (a2, b2)."""
    none = F.lit("")
    keep = [*KEY, "z", "n_kept", "mass", "a", "b"]
    one = edges.select(*keep, _step(F.col("residue"), none, none, F.col("step")).alias("s"),
                       F.lit(1).alias("n"), F.lit(0).alias("g"))
    if gaps is None:
        return one
    return one.unionByName(gaps.select(
        *keep, _step(none, F.col("pair_a"), F.col("pair_b"), F.col("pair_mass")).alias("s"),
        F.lit(2).alias("n"), F.lit(1).alias("g")))


def walks(edges: DataFrame, gaps: DataFrame | None, length: int) -> DataFrame:
    """All paths spelling exactly ``length`` residues with at most one gap (a gap counts two).

    Columns: z, n_kept, mass, nodes (array, low to high m/z), path (array of steps), n_res, gapped.
    Partial paths that would overshoot the length are dropped in the join that makes them.
    """
    st = _steps(edges, gaps)
    cur = st.filter(F.col("n") <= length).select(
        *KEY, "z", "n_kept", "mass", F.array("a", "b").alias("nodes"), F.array("s").alias("path"),
        F.col("n").alias("n_res"), F.col("g").alias("gapped"), F.col("b.p").alias("tip"))
    done = None
    nxt = st.select(*KEY, "z", F.col("a.p").alias("tip"), "b", "s", "n", "g")
    for _ in range(length - 1):
        full = cur.filter(F.col("n_res") == length) if gaps is not None else None
        part = cur.filter(F.col("n_res") < length)
        grown = part.join(nxt, [*KEY, "z", "tip"]).filter(
            (F.col("n_res") + F.col("n") <= length) & (F.col("gapped") + F.col("g") <= 1))
        cur = grown.select(*KEY, "z", "n_kept", "mass", F.concat("nodes", F.array("b")).alias("nodes"),
                           F.concat("path", F.array("s")).alias("path"), (F.col("n_res") + F.col("n")).alias("n_res"),
                           (F.col("gapped") + F.col("g")).alias("gapped"), F.col("b.p").alias("tip"))
        if full is not None:
            done = full if done is None else done.unionByName(full)
    cur = cur.filter(F.col("n_res") == length)
    out = cur if done is None else done.unionByName(cur)
    return out.drop("tip").withColumn("gapped", F.col("gapped") > 0)


def extend(paths: DataFrame, edges: DataFrame, max_extension: int) -> DataFrame:
    """Greedy extension at both ends: smallest error (1e-12 ties), then stronger peak, then lower number."""
    out = paths.withColumn("extended", F.lit(False))
    if max_extension <= 0:
        return out
    out = out.withColumn("wid", F.struct("z", F.transform("nodes", lambda n: n.p).alias("ps"),
                                         F.transform("path", lambda s: F.concat(s.text, s.a2, s.b2)).alias("ts")))
    for forward in (True, False):
        for _ in range(max_extension):
            end = F.element_at("nodes", -1 if forward else 1)
            near, far = ("a", "b") if forward else ("b", "a")
            cand = edges.select(*KEY, "z", F.col(f"{near}.p").alias("_tip"), F.col(far).alias("_n"),
                                _step(F.col("residue"), F.lit(""), F.lit(""), F.col("step")).alias("_s"), F.col("err").alias("_e"))
            j = out.withColumn("_tip", end.getField("p")).join(cand, [*KEY, "z", "_tip"], "left")
            j = j.withColumn("_n", F.when(~F.exists("nodes", lambda n: n.p == F.col("_n.p")), F.col("_n")))
            order = [F.col("_n").isNull(), F.round("_e", 11), F.col("_n.rk"), F.col("_n.p"), F.col("_s.m")]
            j = j.withColumn("_r", F.row_number().over(W.partitionBy(*KEY, "wid").orderBy(*order))).filter("_r = 1")
            add = lambda arr, x: F.when(F.col("_n").isNull(), F.col(arr)).otherwise(
                F.concat(arr, F.array(x)) if forward else F.concat(F.array(x), F.col(arr)))
            out = j.select(*[c for c in out.columns if c not in ("nodes", "path", "extended")],
                           add("nodes", F.col("_n")).alias("nodes"), add("path", F.col("_s")).alias("path"),
                           (F.col("extended") | F.col("_n").isNotNull()).alias("extended"))
    return out.drop("wid")


def _spelled(fit: DataFrame, gap: list[str], cap: int) -> DataFrame:
    """Rows of the pairs that fit a gap, in mass order and inside the cap, in both orders of their residues (_a2, _b2)."""
    twin = F.col("pair_a") == F.col("pair_b")
    run = F.sum(F.when(twin, 1).otherwise(2)).over(W.partitionBy(*gap).orderBy("pair_order").rowsBetween(W.unboundedPreceding, 0))
    fit = fit.withColumn("_t", run).filter(F.col("_t") <= cap)
    fit = fit.withColumn("_swap", F.explode(F.when(twin, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    return fit.withColumn("_a2", F.when(F.col("_swap"), F.col("pair_b")).otherwise(F.col("pair_a"))).withColumn(
        "_b2", F.when(F.col("_swap"), F.col("pair_a")).otherwise(F.col("pair_b")))


def gap_spellings(paths: DataFrame, pairs: DataFrame, params: TagParams = TagParams(),
                  cap: int = K.MAX_GAP_SPELLINGS) -> DataFrame:
    """One row per spelling: a gap's pairs within tolerance in mass order, both orders, inside the cap."""
    plain = paths.filter(~F.col("gapped"))
    gapped = paths.filter("gapped").withColumn("_w", F.struct("z", F.transform("nodes", lambda n: n.p).alias("ps"),
        F.transform("path", lambda s: F.concat(s.text, s.a2, s.b2)).alias("ts")))
    pos = F.array_position(F.transform("path", lambda s: (s.a2 != "").cast("int")), 1).cast("int")
    gapped = gapped.withColumn("_g", pos)
    lo, hi = F.get("nodes", F.col("_g") - 1), F.get("nodes", F.col("_g"))
    diff = (hi.getField("mz") - lo.getField("mz")) * F.col("z")
    tol = params.tol(hi.getField("mz")) * F.col("z")
    fit = range_join(gapped, pairs, [], diff - tol, diff + tol, "pair_mass", 2.0, small_right=True)
    fit = _spelled(fit, [*KEY, "_w"], cap)
    step = _step(F.lit(""), F.col("_a2"), F.col("_b2"), F.col("pair_mass"))
    path = F.transform("path", lambda s, i: F.when(i == F.col("_g") - 1, step).otherwise(s))
    fit = fit.withColumn("path", path).select(*plain.columns)
    return plain.unionByName(fit)


#: Peaks of a task that makes the paths of its spectra.
PEAKS_PER_TASK = 20_000
#: A step as ``spectrum_paths`` keeps it: the peak it leads to, its rank, and the residue or the pair of a gap.
STEP = "struct<far:int,rk:int,err:double,text:string,a2:string,b2:string,m:double,n:int,g:int>"


def _slot(z, p) -> Column:
    """One number for a peak at a charge."""
    return z * F.lit(K.PEAK_CEILING + 1) + p


def _lists(steps: DataFrame, name: str) -> DataFrame:
    """A row per spectrum: ``name`` holds the steps by charge and the peak they leave, ``name_at`` the slots in the same order."""
    met = steps.groupBy(*KEY, "z", "p").agg(F.collect_list("s").alias("s"))
    met = met.groupBy(*KEY).agg(F.collect_list(F.struct("z", "p", "s")).alias(name))
    return met.withColumn(f"{name}_at", F.transform(name, lambda e: _slot(e.z, e.p)))


def _leaving(name: str, z, p) -> Column:
    """Steps of ``name`` that leave a peak at a charge."""
    place = F.array_position(f"{name}_at", _slot(z, p)).cast("int") - 1
    return F.coalesce(F.get(F.col(name), place).getField("s"), F.array().cast(f"array<{STEP}>"))


def spectrum_paths(prepared: DataFrame, residues: DataFrame, pairs: DataFrame | None, params: TagParams = TagParams(), cap: int = K.MAX_GAP_SPELLINGS) -> DataFrame:
    """The rows that ``walks``, ``extend`` and ``gap_spellings`` give one after the other, with the spectrum's number of paths (``n_paths``)
    and of peaks with a partner at the charge (``n_partnered``). ``pairs``: the sums of residues that a gap can be, None without gaps.

    A path stays inside its spectrum, whose peaks the budget bounds. Peaks are dealt out once by spectrum; steps, paths and extensions
    are arrays in the spectrum's row, so no step or path is shuffled or written. A gap's spellings are steps of their own.
    """
    near = dealt(prepared, *KEY, rows=PEAKS_PER_TASK)
    edges = residue_edges(near, residues, params)

    def step(leaves, meets, text, a2, b2, mass, err, n, g):
        s = F.struct(F.col(f"{meets}.p"), F.col(f"{meets}.rk"), err, text, a2, b2, mass, F.lit(n), F.lit(g)).cast(STEP)
        return [*KEY, "z", F.col(f"{leaves}.p").alias("p"), s.alias("s")]

    none = F.lit("")
    letter = (F.col("residue"), none, none, F.col("step"), F.col("err"), 1, 0)
    lists = [_lists(edges.select(*step("a", "b", *letter)), "up")]
    if params.max_extension > 0:
        lists.append(_lists(edges.select(*step("b", "a", *letter)), "down"))
    if pairs is not None:
        fit = _spelled(_gap_pairs(near, pairs, params).withColumn("_pa", F.col("a.p")).withColumn("_pb", F.col("b.p")), [*KEY, "z", "_pa", "_pb"], cap)
        gaps = _lists(fit.select(*step("a", "b", none, F.col("_a2"), F.col("_b2"), F.col("pair_mass"), F.lit(0.0), 2, 1)), "gap").join(lists[0], KEY, "left")
        # a gap that two residues bridge is none; below a join, since the optimizer would put it into every look-up above one
        across = lambda e: F.flatten(F.transform(_leaving("up", e.z, e.p), lambda x: F.transform(_leaving("up", e.z, x.far), lambda y: y.far)))
        met = F.transform("gap", lambda e: F.struct(e.alias("e"), across(e).alias("across")))
        open_ = F.transform(met, lambda x: F.struct(x.e.z.alias("z"), x.e.p.alias("p"), F.filter(x.e.s, lambda g: ~F.array_contains(x.across, g.far)).alias("s")))
        lists.append(gaps.select(*KEY, "gap_at", open_.alias("gap")))
    node = F.struct("p", "mz", "rk", "intensity", "compl")
    per = near.groupBy(*KEY).agg(F.first("n_kept").alias("n_kept"), F.first("mass").alias("mass"), F.array_sort(F.collect_list(node)).alias("nodes"))
    for each in lists:
        per = per.join(each, KEY, "left")
    kinds = ["up"] if pairs is None else ["up", "gap"]
    # a path takes one gap at most
    onward = lambda c, p: F.when(c.g == len(kinds) - 1, _leaving("up", c.z, p)).otherwise(F.concat(*[_leaving(k, c.z, p) for k in kinds]))

    def path(z, ps, steps, n_res, g):
        return F.struct(z.alias("z"), ps.alias("ps"), steps.alias("steps"), n_res.alias("n_res"), g.alias("g"), F.lit(False).alias("extended"))

    first = lambda e: F.transform(F.filter(e.s, lambda s: s.n <= params.tag_length), lambda s: path(e.z, F.array(e.p, s.far), F.array(s), s.n, s.g))
    none_yet = F.array().cast(f"array<struct<z:int,ps:array<int>,steps:array<{STEP}>,n_res:int,g:int,extended:boolean>>")
    per = per.withColumn("open", F.concat(*[F.coalesce(F.flatten(F.transform(k, first)), none_yet) for k in kinds])).withColumn("paths", none_yet)

    def grown(c):
        fits = F.filter(onward(c, F.element_at(c.ps, -1)), lambda s: c.n_res + s.n <= params.tag_length)
        return F.transform(fits, lambda s: path(c.z, F.concat(c.ps, F.array(s.far)), F.concat(c.steps, F.array(s)), c.n_res + s.n, c.g + s.g))

    for _ in range(params.tag_length - 1):
        full = F.concat("paths", F.filter("open", lambda c: c.n_res == params.tag_length))
        more = F.flatten(F.transform(F.filter("open", lambda c: c.n_res < params.tag_length), grown))
        per = per.select(*[c for c in per.columns if c not in ("open", "paths")], full.alias("paths"), more.alias("open"))
    per = per.withColumn("paths", F.concat("paths", F.filter("open", lambda c: c.n_res == params.tag_length))).drop("open")

    def longer(c, forward):
        end = F.element_at(c.ps, -1 if forward else 1)
        new = F.filter(_leaving("up" if forward else "down", c.z, end), lambda s: ~F.array_contains(c.ps, s.far))
        best = F.array_min(F.transform(new, lambda s: F.struct(F.round(s.err, 11).alias("err"), s.rk.alias("rk"), s.far.alias("far"), s.m.alias("m"), s.alias("s"))))
        return F.struct(c.alias("c"), best.getField("s").alias("s"))

    def extended(x, forward):
        join = lambda old, new: F.concat(old, F.array(new)) if forward else F.concat(F.array(new), old)
        return F.when(x.s.isNull(), x.c).otherwise(F.struct(
            x.c.z.alias("z"), join(x.c.ps, x.s.far).alias("ps"), join(x.c.steps, x.s).alias("steps"), x.c.n_res.alias("n_res"), x.c.g.alias("g"), F.lit(True).alias("extended")))

    for forward in [True] * params.max_extension + [False] * params.max_extension:
        per = per.withColumn("paths", F.transform(F.transform("paths", lambda c: longer(c, forward)), lambda x: extended(x, forward)))   # noqa: B023
    out = per.select(*KEY, "n_kept", "mass", "nodes", F.size("paths").cast("long").alias("n_paths"), F.explode("paths").alias("c"))
    return out.select(
        *KEY, F.col("c.z").alias("z"), "n_kept", "mass", F.transform("c.ps", lambda p: F.get(F.col("nodes"), p - 1)).alias("nodes"),
        F.transform("c.steps", lambda s: _step(s.text, s.a2, s.b2, s.m)).alias("path"), F.col("c.n_res").alias("n_res"), (F.col("c.g") > 0).alias("gapped"),
        F.col("c.extended").alias("extended"), "n_paths", F.size(F.filter("nodes", lambda n: F.array_contains(n.compl, F.col("c.z")))).alias("n_partnered"))


def spell(path) -> Column:
    """N to C string of a path walked low to high m/z (the reverse of the walk)."""
    return F.array_join(F.reverse(F.transform(path, lambda s: F.concat(s.text, s.b2, s.a2))), "")
