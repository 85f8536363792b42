"""Placing tags on proteins: occurrences, digest windows, flank reconciliation, localisation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionweave.functions import constants as K, scalar as S
from ionweave.operators.core import keyed_join, range_join
from ionweave.operators.dbmatch import readings, wanted_only
from ionweave.session import materialize

# Cleavage rules (after = cut behind the residue, else before it).
ENZYMES = {
    "Trypsin": (True, "KR", "P"), "Lys-C": (True, "K", "P"), "Arg-C": (True, "R", "P"), "Asp-N": (False, "D", ""),
    "Glu-C": (True, "DE", ""), "Chymotrypsin": (True, "FWYL", "P"), "Lys-N": (False, "K", ""), "unspecific": (True, "", ""),
}
SEED, LONGEST = 4, 25
AMMONIA = 17.0265491
SUBSTITUTION_ORDER = "GASPVTCLNDQKEMHFRYW"


def locate(tags: DataFrame, proteins: DataFrame, both: bool = True, rules: DataFrame | None = None) -> DataFrame:
    """Every occurrence of a tag (4 to 25 residues): seq, accession, pos (0-based), len, reversed.

    Proteins are read once for all lengths. Where tags have several, each position is met with their seeds (the first four residues, a
    table that the alphabet bounds) and goes on only with the lengths that tags of its seed have, as whole k-mers, so common seeds never
    meet by themselves; each distinct tag is looked up once.
    """
    seqs = tags.select("seq").distinct().filter(F.length("seq").between(SEED, LONGEST))
    base = seqs.withColumn("reading", F.col("seq")) if rules is None else readings(seqs, rules)
    base = base.select("seq", F.translate("reading", "I", "L").alias("kmer"), F.lit(False).alias("reversed"))
    if both:
        flip = base.withColumn("kmer", F.reverse("kmer")).withColumn("reversed", F.lit(True))
        base = base.unionByName(flip.filter(F.col("seq") != F.reverse("seq")))
    base = materialize(base.withColumn("len", F.length("kmer")))
    lo, hi = base.agg(F.min("len"), F.max("len")).first()
    lo, hi = lo or SEED, hi or SEED
    ahead = F.regexp_extract_all("sequence", F.lit(f"(?=(.{{{lo},{hi}}}))"), F.lit(1))
    at = proteins.select("accession", F.posexplode(ahead).alias("pos", "kmer"))
    if lo < hi:
        # readings may spell any letters; proteins hold those of the alphabet only
        seed = F.substring("kmer", 1, SEED)
        seeds = base.filter(seed.rlike(f"^[{SUBSTITUTION_ORDER}]+$")).groupBy(seed.alias("seed")).agg(F.collect_set("len").alias("lens"))
        at = at.withColumn("seed", seed).join(F.broadcast(seeds), "seed").select("accession", "pos", "kmer", F.explode("lens").alias("len"))
        at = at.filter("length(kmer) >= len").select("accession", "pos", F.expr("substring(kmer, 1, len)").alias("kmer"))
    at = at.filter("NOT contains(kmer, '#')")
    out = base.join(wanted_only(at, base), "kmer")
    # what follows a look-up goes protein by protein, so repeats are dropped where the rows of a protein meet
    return out.select("seq", "accession", "pos", "len", "reversed").repartition("accession").distinct()


def _boundaries(enzyme: str) -> Column:
    """Cleavage boundaries of ``sequence`` in order, both ends included: residues before the cut."""
    after, residues, not_before = ENZYMES[enzyme]
    if not residues:
        pattern = "(?=.)"
    elif after:
        pattern = f"(?<=[{residues}])" + (f"(?!{not_before})" if not_before else "") + "(?=.)"
    else:
        pattern = f"(?<=.)(?=[{residues}])"
    parts = F.split("sequence", pattern)
    return F.aggregate(F.transform(parts, lambda x: F.length(x)), F.array(F.lit(0)),
                       lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def cleavage_sites(proteins: DataFrame, enzyme: str = "Trypsin") -> DataFrame:
    """(accession, b, n): cleavage boundaries with their number along the protein; both ends included.

    ``b`` counts residues before the cut.
    """
    return proteins.select("accession", F.posexplode(_boundaries(enzyme)).alias("n", "b"))


#: Residues of the parts of a sequence that rows meet. ``TILE_STEP`` is not read any more.
TILE, TILE_STEP = 512, 16


def residues_between(rows: DataFrame, proteins: DataFrame, lo: Column, hi: Column, out: str) -> DataFrame:
    """Adds the residues [lo, hi) of each row's protein, cut off at its end.

    Rows meet their protein once, as an array of its parts, and read only the parts that hold the stretch, so neither copies nor scans
    grow with the protein.
    """
    parts = F.regexp_extract_all("sequence", F.lit(f"(?s)(.{{1,{TILE}}})"), F.lit(1))
    p = rows.withColumn("_lo", lo.cast("int")).withColumn("_hi", F.greatest(hi.cast("int"), F.col("_lo")))
    p = keyed_join(p, proteins.select("accession", parts.alias("_parts")), ["accession"])
    first = F.floor(F.col("_lo") / TILE).cast("int")
    held = F.array_join(F.slice("_parts", first + 1, F.floor(F.col("_hi") / TILE).cast("int") - first + 1), "")
    return p.withColumn(out, F.substring(held, F.col("_lo") % TILE + 1, F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi", "_parts")


def _cuts(proteins: DataFrame, enzyme: str) -> DataFrame:
    """(accession, cuts, at, methionine): boundaries of a protein; per TILE residues, how many lie at or before their start; whether it
    begins with methionine."""
    cuts = proteins.select("accession", F.length("sequence").alias("_n"), (F.substring("sequence", 1, 1) == "M").alias("methionine"), _boundaries(enzyme).alias("cuts"))
    starts = F.sequence(F.lit(0), F.floor(F.col("_n") / TILE).cast("int") + 1)
    return cuts.select("accession", "cuts", "methionine", F.transform(starts, lambda t: F.size(F.filter("cuts", lambda b: b <= t * TILE))).alias("at"))


def _cuts_near(pos: Column, more: int) -> Column:
    """The boundaries of the tile of ``pos``, the last one up to its start, and ``more`` on both sides."""
    tile = F.floor(pos / TILE).cast("int")
    first = F.greatest(F.lit(1), F.get(F.col("at"), tile) - more)
    return F.slice("cuts", first, F.greatest(F.lit(0), F.get(F.col("at"), tile + 1) + more - first + 1))


def enzyme_windows(occ: DataFrame, proteins: DataFrame, enzyme: str = "Trypsin", missed: int = 0) -> DataFrame:
    """The rows of ``digest_windows`` for the sites of an enzyme. Occurrences meet their protein's boundaries once, as one row, and read
    those near them; windows stay where their protein is."""
    o = keyed_join(occ, _cuts(proteins, enzyme), ["accession"])
    o = o.select(*occ.columns, _cuts_near(F.col("pos"), missed + 1).alias("_near"))
    starts = F.slice(F.reverse(F.filter("_near", lambda b: b <= F.col("pos"))), 1, missed + 1)
    ends = F.slice(F.filter("_near", lambda b: b > F.col("pos")), 1, missed + 1)
    # the outer form, since a filter for empty arrays would go into the join, which then copies all boundaries for every row
    w = o.select(*occ.columns, ends.alias("_ends"), F.posexplode_outer(starts).alias("_i", "start"))
    w = w.select(*occ.columns, "_i", "start", F.posexplode_outer("_ends").alias("_j", "end"))
    return w.filter(F.col("_i") + F.col("_j") <= missed).filter(F.col("end") >= F.col("pos") + F.col("len")).drop("_i", "_j")


def digest_windows(occ: DataFrame, sites: DataFrame, missed: int = 0) -> DataFrame:
    """Occurrences with every window [start, end) of at most ``missed`` internal sites that holds them.

    Sites between two positions are found by number, so only neighbouring boundaries are joined.
    """
    nxt = sites.withColumn("b_next", F.lead("b").over(W.partitionBy("accession").orderBy("n")))
    seg = nxt.filter("b_next IS NOT NULL").select("accession", F.col("n").alias("seg"), "b", "b_next")
    lo = seg.select("accession", F.col("seg").alias("s0"), F.col("b").alias("_b"), F.col("b_next").alias("_e"))
    width = 200.0
    cut = lo.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_b") / width), F.floor((F.col("_e") - 1) / width))))
    first = occ.withColumn("_cell", F.floor(F.col("pos") / width)).join(cut, ["accession", "_cell"]).filter(
        "pos >= _b AND pos < _e").drop("_b", "_e", "_cell")
    last = first.withColumn("_cell", F.floor((F.col("pos") + F.col("len") - 1) / width)).join(
        cut.withColumnRenamed("s0", "s1"), ["accession", "_cell"]).filter("pos + len > _b AND pos + len <= _e").drop("_b", "_e", "_cell")
    w = last.withColumn("sa", F.explode(F.sequence(F.greatest(F.lit(0), F.col("s0") - missed), F.col("s0"))))
    w = w.withColumn("sb", F.explode(F.sequence(F.col("s1"), F.col("s1") + missed))).filter(F.col("sb") - F.col("sa") <= missed)
    a = seg.select("accession", F.col("seg").alias("sa"), F.col("b").alias("start"))
    b = seg.select("accession", F.col("seg").alias("sb"), F.col("b_next").alias("end"))
    return w.join(a, ["accession", "sa"]).join(b, ["accession", "sb"]).drop("s0", "s1", "sa", "sb")


#: Mass of the lightest residue, glycine (Da).
LIGHTEST = 57.02146372


def windows_by_mass(occ: DataFrame, proteins: DataFrame, tol: float) -> DataFrame:
    """Windows whose flank masses fit want_n or want_c of the occurrence; both flanks must fit.

    Flanks are walked over the residues next to the occurrence, as far as the lightest residue could reach the
    wanted mass.
    """
    reach = lambda want: F.ceil((F.greatest(F.coalesce(F.col(want), F.lit(0.0)), F.lit(0.0)) + tol) / LIGHTEST).cast("int") + 1
    p = occ.withColumn("_n", F.least("pos", reach("want_n"))).withColumn("_c", reach("want_c"))
    p = residues_between(p, proteins, F.col("pos") - F.col("_n"), F.col("pos") + F.col("len") + F.col("_c"), "_near")
    left = F.reverse(F.expr("substring(_near, 1, _n)"))
    right = F.expr("substring(_near, _n + len + 1, _c)")
    fits = lambda seq, want: F.filter(
        F.transform(S.prefix_masses(seq), lambda m, i: F.when(F.abs(m - want) <= tol, i)), lambda i: i.isNotNull())
    at = lambda seq, want: F.when(F.length(seq) > 0, fits(seq, F.col(want))).when(F.col(want) <= tol, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    # few left flanks fit, so the right ones are walked for those only
    p = p.withColumn("_a", F.explode(at(left, "want_n"))).withColumn("_b", F.explode(at(right, "want_c")))
    return p.withColumn("start", F.col("pos") - F.col("_a")).withColumn("end", F.col("pos") + F.col("len") + F.col("_b")).drop(
        "_a", "_b", "_n", "_c", "_near")


def cleavage_filter(windows: DataFrame, proteins: DataFrame, enzyme: str, specificity: str = "full") -> DataFrame:
    """Windows both (full), one (semi) or none (none) of whose ends the enzyme explains.

    An end is explained where the enzyme has a boundary; a start also behind a first methionine. Windows meet the
    boundaries of their protein once, read those near their ends, and never the sequence.
    """
    if specificity == "none" or enzyme == "unspecific":
        return windows
    w = keyed_join(windows, _cuts(proteins, enzyme), ["accession"])
    explained = lambda end: F.coalesce(F.array_contains(_cuts_near(F.col(end), 0), F.col(end)), F.lit(False))
    n_ok, c_ok = explained("start") | (F.col("methionine") & (F.col("start") == 1)), explained("end")
    return w.filter(n_ok & c_ok if specificity == "full" else n_ok | c_ok).select(*windows.columns)


def reconcile(tags: DataFrame, windows: DataFrame, proteins: DataFrame, tol: float = 0.02, ppm: bool = False,
              fixed: dict[str, float] | None = None, series: str = "by") -> DataFrame:
    """Placements of tags in windows with at most one mismatched flank, its mass gap and region.

    ``tags`` carries seq, nterm_mass, cterm_mass; ``windows`` seq, accession, pos, len, reversed, start,
    end. Regions are peptide-local [region_lo, region_hi], empty for a full match.
    """
    pair = K.ION_PAIRS[series]
    off = pair["off_c"] - pair["off_n"]
    w = residues_between(windows, proteins, F.col("start"), F.col("end"), "peptide").filter(~F.contains("peptide", F.lit("#")))
    m = lambda e: F.coalesce(S.residue_sum(F.expr(e), fixed), F.lit(0.0))
    w = w.withColumn("db_n", F.when(F.col("pos") > F.col("start"), m("substring(peptide, 1, pos - start)")).otherwise(0.0))
    w = w.withColumn("db_c", F.when(F.col("end") > F.col("pos") + F.col("len"), m("substring(peptide, pos + len - start + 1, end - pos - len)")).otherwise(0.0))
    w = w.withColumn("pep_mass", S.residue_sum("peptide", fixed) + F.lit(K.WATER))
    j = tags.join(w, "seq")
    rev = F.col("reversed")
    j = j.withColumn("want_n", F.when(rev, F.greatest(F.lit(0.0), F.col("cterm_mass") + off)).otherwise(F.col("nterm_mass")))
    j = j.withColumn("want_c", F.when(rev, F.greatest(F.lit(0.0), F.col("nterm_mass") - off)).otherwise(F.col("cterm_mass")))
    t = lambda x: S.tolerance(x, tol, ppm)
    n_tol = F.when(rev, t(F.greatest("db_n", "want_n"))).otherwise(t(F.col("pep_mass")))
    c_tol = F.when(rev, t(F.col("pep_mass"))).otherwise(t(F.greatest("db_c", "want_c")))
    j = j.withColumn("nterm_match", F.abs(F.col("db_n") - F.col("want_n")) <= n_tol)
    j = j.withColumn("cterm_match", F.abs(F.col("db_c") - F.col("want_c")) <= c_tol).filter("nterm_match OR cterm_match")
    both = F.col("nterm_match") & F.col("cterm_match")
    local = F.col("pos") - F.col("start")
    return (j.withColumn("delta_mass", F.when(both, 0.0).when(~F.col("nterm_match"), F.col("want_n") - F.col("db_n")).otherwise(F.col("want_c") - F.col("db_c")))
            .withColumn("region_lo", F.when(both | ~F.col("nterm_match"), 0).otherwise(local + F.col("len")))
            .withColumn("region_hi", F.when(both, -1).when(~F.col("nterm_match"), local - 1).otherwise(F.col("end") - F.col("start") - 1))
            .withColumn("gap_flank", F.greatest(F.when(F.col("nterm_match"), F.greatest("db_c", "want_c")).otherwise(F.greatest("db_n", "want_n")), F.lit(200.0))))


def region_of(peptide: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi >= lo, F.substring(peptide, lo + 1, hi - lo + 1)).otherwise("")


def interpret_delta(placements: DataFrame, mods: DataFrame, tol: float) -> DataFrame:
    """Adds ``delta_interp``: the nearest modification on a region residue, else one substitution, else ``?``.

    ``placements``: id, delta_mass, region. ``mods``: name, residues (empty = any), delta, ord. A
    modification wins a tie with a substitution.
    """
    spark = placements.sparkSession
    p = placements.withColumn("_d", F.col("delta_mass")).filter((F.length("region") > 0) & (F.abs("delta_mass") > 1e-6))
    d = p.select("id", "region", "_d").distinct()
    lo, hi = F.col("_d") - tol, F.col("_d") + tol
    mod = range_join(d, mods, [], lo, hi, "delta", 2.0, small_right=True)
    mod = mod.withColumn("_s", F.when(F.col("residues") == "", F.substring("region", 1, 1)).otherwise(F.try_element_at(
        F.filter(F.split("region", "(?!^)(?=.)"), lambda c: F.contains(F.col("residues"), c)), F.lit(1)))).filter("_s IS NOT NULL")
    mod = mod.select("id", F.abs(F.col("_d") - F.col("delta")).alias("err"), F.lit(0).alias("kind"), F.col("ord"),
                     F.concat(F.lit("mod:"), "name", F.lit("@"), "_s").alias("interp"))
    rows = [(x, y, K.RESIDUES[y] - K.RESIDUES[x], SUBSTITUTION_ORDER.index(y)) for x in K.RESIDUES for y in SUBSTITUTION_ORDER if x != y]
    subs = spark.createDataFrame(rows, "x string, y string, delta double, yo int")
    sub = range_join(d, subs, [], lo, hi, "delta", 2.0, small_right=True).withColumn("_i", F.instr("region", F.col("x"))).filter("_i > 0")
    sub = sub.select("id", F.abs(F.col("_d") - F.col("delta")).alias("err"), F.lit(1).alias("kind"), (F.col("_i") * 100 + F.col("yo")).alias("ord"),
                     F.concat(F.lit("sub:"), "x", F.lit("->"), "y").alias("interp"))
    best = mod.unionByName(sub).groupBy("id").agg(F.min_by("interp", F.struct(F.round("err", 9), "kind", "ord")).alias("delta_interp"))
    return placements.join(best, "id", "left").withColumn("delta_interp", F.when(
        (F.length("region") > 0) & (F.abs("delta_mass") > 1e-6), F.coalesce("delta_interp", F.lit("?"))).otherwise(F.lit("")))


def localize(placements: DataFrame, peaks: DataFrame, tol: float, ppm: bool = False, fixed: dict[str, float] | None = None,
             key: list[str] = ["run_id", "idx"], charges: int = 1, unique: bool = False, model: str | None = None) -> DataFrame:
    """Best site of the gap: id, loc_site (peptide-local), loc_score, loc_ties, loc_lead, loc_excluded.

    For every region residue the b and y ions are placed as if the gap sat there and what they explain is counted: matched ions
    (``count``), distinct peaks (``unique``), or distinct peaks without those of shifted ions that stand where an unshifted ion found at
    the same charge would lose water or ammonia (``strict``; loc_excluded counts them). Each ion is looked up once plain and once
    shifted; a placement's matches are one array, over which its sites are scored.
    """
    return localize_models(placements, peaks, tol, ppm, fixed, key, charges, [model or ("unique" if unique else "count")]).drop("model")


def localize_models(placements: DataFrame, peaks: DataFrame, tol: float, ppm: bool = False, fixed: dict[str, float] | None = None,
                    key: list[str] = ["run_id", "idx"], charges: int = 1, models: Sequence[str] = ("count", "unique", "strict")) -> DataFrame:
    """The rows of ``localize`` under each of the models, with ``model``. Ions are looked up once for all of them, among the peaks of
    spectra that are asked for."""
    if not set(models) <= {"count", "unique", "strict"}:
        raise ValueError(models)
    task = [*key, "peptide", "delta_mass", "region_lo", "region_hi"]
    asked = materialize(placements.filter("region_hi >= region_lo").select(F.col("id").alias("_given"), F.struct(*task).alias("_task")))
    # equal peptides with equal gaps in a spectrum are one question, answered once under the id of one of them
    heads = materialize(asked.groupBy("_task").agg(F.min("_given").alias("id")))
    p = heads.select("id", "_task.*").withColumn("L", F.length("peptide")).withColumn("_pre", S.prefix_masses("peptide", fixed))
    cut = p.filter("L > 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("L") - 1)))
    pre, total = F.element_at("_pre", F.col("i") + 1), F.element_at("_pre", -1)
    ions = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(shifted).alias("shifted"), (mass + F.col("delta_mass") if shifted else mass).alias("m"))
                               for kind, mass in (("b", pre), ("y", total - pre + K.WATER)) for shifted in (0, 1)]))
    ion = cut.select("id", *key, "i", ions.alias("ion")).withColumn("z", F.explode(F.sequence(F.lit(1), F.lit(charges))))
    ion = ion.select("id", *key, "i", "z", "ion.*", ((F.col("ion.m") + F.col("z") * K.PROTON) / F.col("z")).alias("want"))
    t = S.tolerance("want", tol, ppm)
    # other spectra drop out before the exchange
    near = wanted_only(peaks.select(*key, F.col("mz").alias("mz_p")), heads.select("_task.*"), key)
    hit = range_join(ion, near, key, F.col("want") - t, F.col("want") + t, "mz_p", 2.0)
    hit = hit.groupBy("id", "i", "z", "kind", "shifted").agg(
        F.min_by("mz_p", F.struct(F.abs(F.col("mz_p") - F.col("want")), F.col("mz_p"))).alias("peak"), F.first("m").alias("m"), F.first(S.tolerance("want", tol, ppm) * F.col("z")).alias("tol"))
    found = hit.groupBy("id").agg(F.collect_list(F.struct("i", "z", "kind", "shifted", "peak", "m", "tol")).alias("all"))
    per = materialize(p.select("id", "region_lo", "region_hi").join(found, "id", "left").withColumn("all", F.coalesce("all", F.array().cast(found.schema["all"].dataType))))
    out = None
    for model in models:
        part = _best_sites(per, model).withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return asked.join(heads, "_task").join(out, "id").drop("id", "_task").withColumnRenamed("_given", "id").select(*out.columns)


def _best_sites(per: DataFrame, model: str) -> DataFrame:
    """The best site of each question (id, region_lo, region_hi, all: its matches) under a model."""
    if model == "strict":
        lost = lambda h, u: (u.shifted == 0) & (u.z == h.z) & ((F.abs(u.m - K.WATER - h.m) <= h.tol) | (F.abs(u.m - AMMONIA - h.m) <= h.tol))
        kept = F.filter("all", lambda h: (h.shifted == 0) | ~F.exists("all", lambda u: lost(h, u)))
    else:
        kept = F.col("all")
    per = per.withColumn("kept", kept)
    # a cut after i residues carries the gap in b when the site j < i, in y when j >= i
    carries = lambda h, j: F.when(h.kind == "b", (j < h.i).cast("int")).otherwise((j >= h.i).cast("int"))

    def score(j):
        own = F.filter("kept", lambda h: h.shifted == carries(h, j))
        return F.size(own if model == "count" else F.array_distinct(F.transform(own, lambda h: h.peak)))

    per = per.withColumn("s", F.transform(F.sequence("region_lo", "region_hi"), score)).withColumn("top", F.array_max("s"))
    rival = F.array_max(F.filter("s", lambda x: x < F.col("top")))
    return per.select("id", (F.col("region_lo") + F.array_position("s", F.col("top")) - 1).cast("int").alias("loc_site"), F.col("top").cast("long").alias("loc_score"),
                      F.size(F.filter("s", lambda x: x == F.col("top"))).cast("long").alias("loc_ties"), (F.col("top") - F.coalesce(rival, F.lit(0))).cast("long").alias("loc_lead"),
                      (F.size("all") - F.size("kept")).cast("long").alias("loc_excluded"))


def classify_placement(nterm_match: Column, cterm_match: Column, delta: Column, fixed_n: float, fixed_c: float, tol: float) -> Column:
    """exact, label_exact (one flank off by the fixed terminal modification) or gapped."""
    label = F.lit(False)
    if fixed_n:
        label = label | (~nterm_match & cterm_match & (F.abs(delta - fixed_n) <= tol))
    if fixed_c:
        label = label | (nterm_match & ~cterm_match & (F.abs(delta - fixed_c) <= tol))
    return F.when(nterm_match & cterm_match, "exact").when(label, "label_exact").otherwise("gapped")


def best_placement(placements: DataFrame, key: list[str], select: str = "best", within: float = 0.05) -> DataFrame:
    """One placement per spectrum: lowest E-value then smallest |delta|, or the consensus placement.

    Consensus takes the placement that most tags of the spectrum support: same folded peptide and a gap
    within ``within`` Da. Support is a range self-join inside (spectrum, peptide).
    """
    tie = ["evalue", F.abs("delta_mass"), "id"]
    if select == "best":
        return placements.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*tie))).filter("_r = 1").drop("_r")
    p = placements.withColumn("_pep", F.translate("peptide", "I", "L"))
    other = p.select(*key, "_pep", F.col("seq").alias("_seq"), F.col("delta_mass").alias("_delta")).distinct()
    sup = range_join(p.select("id", *key, "_pep", "delta_mass"), other, [*key, "_pep"], F.col("delta_mass") - within,
                     F.col("delta_mass") + within, "_delta", 1.0).groupBy("id").agg(F.countDistinct("_seq").alias("support"))
    p = p.join(sup, "id").drop("_pep")
    return p.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("support"), *tie))).filter("_r = 1").drop("_r")
