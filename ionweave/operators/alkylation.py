"""Cysteine alkylation calls from placements and from tags."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ionweave.functions import constants as K, scalar as S

# Cysteine forms (name, mass, class).
FORMS = [("Carbamidomethyl", 57.021464, "Carbamidomethyl"), ("Propionamide", 71.037114, "Propionamide"), ("Nethylmaleimide", 125.047679, "Nethylmaleimide"),
         ("Methylthio", 45.987721, "Methylthio"), ("Carboxymethyl", 58.005479, "Carboxymethyl"), ("unmodified", 0.0, "none"), ("Oxidation", 15.994915, "none"),
         ("Dioxidation", 31.989829, "none"), ("Trioxidation", 47.984744, "none"), ("Cysteinyl", 119.004099, "none"), ("Dehydroalanine", -33.987721, "none")]
MET_OXIDATION = 15.994915
MIN_SPECTRA, MIN_SHARE = 10, 0.6


def _nearest(mass, window: float):
    """Index of the nearest form within the window, or NULL."""
    cand = F.array(*[F.when(F.abs(mass - m) <= window, F.struct(F.abs(mass - m).alias("e"), F.lit(i).alias("i"))) for i, (_, m, _) in enumerate(FORMS)])
    return F.array_min(F.array_compact(cand)).i


def cys_evaluate(placements: DataFrame, window: float = 0.02, fixed_c: float = K.CARBAMIDOMETHYL, term_n: float = 0.0, term_c: float = 0.0) -> DataFrame:
    """Adds ``outcome``, ``reagent``, ``form`` and ``cls``.

    ``placements``: peptide, start, tag_pos, tag_len, nterm_match, cterm_match, delta_mass. A placement
    counts when its only cysteine lies on the gap side, outside the tag.
    """
    masses = dict(K.RESIDUES)
    masses["C"] += fixed_c
    pep = F.translate(F.upper("peptide"), "I", "L")
    p = placements.withColumn("_pep", pep).withColumn("_L", F.length("peptide"))
    p = p.withColumn("_n", F.length("_pep") - F.length(F.replace("_pep", F.lit("C"), F.lit("")))).withColumn("_c", F.instr("_pep", F.lit("C")) - 1)
    p = p.withColumn("_end", F.col("tag_pos") + F.col("tag_len")).withColumn("_nside", F.col("_c") < F.col("tag_pos"))
    full = F.col("nterm_match") & F.col("cterm_match")
    gap_n = ~F.col("nterm_match")
    rest = F.col("delta_mass") - F.when(gap_n, term_n).otherwise(term_c)
    label_exact = F.when(gap_n, F.lit(term_n != 0)).otherwise(F.lit(term_c != 0)) & (F.abs(rest) <= window)
    p = p.withColumn("_exact", full | label_exact).withColumn("_gap", F.when(F.col("_exact"), 0.0).otherwise(rest))
    p = p.withColumn("_lo", F.when(F.col("_nside"), 0).otherwise(F.col("_end"))).withColumn("_hi", F.when(F.col("_nside"), F.col("tag_pos") - 1).otherwise(F.col("_L") - 1))
    table = F.create_map(*[F.lit(x) for kv in masses.items() for x in kv])
    res = lambda i: F.coalesce(F.element_at(table, F.substring("_pep", i + 1, F.lit(1))), F.lit(0.0))
    m1 = res(F.when(F.col("_nside"), F.col("_lo")).otherwise(F.col("_hi")))
    m2 = m1 + res(F.when(F.col("_nside"), F.col("_lo") + 1).otherwise(F.col("_hi") - 1))
    trunc = (~F.col("_exact")) & (F.abs("_gap") > window) & (
        (F.abs(F.abs("_gap") - m1) <= window) | ((F.col("_hi") > F.col("_lo")) & (F.abs(F.abs("_gap") - m2) <= window)))
    p = p.withColumn("reagent", F.col("_gap") + fixed_c).withColumn("_b", _nearest(F.col("reagent"), window))
    p = p.withColumn("_box", F.when(F.contains(F.substring("_pep", F.col("_lo") + 1, F.greatest(F.lit(0), F.col("_hi") - F.col("_lo") + 1)), F.lit("M")),
                                    _nearest(F.col("reagent") - MET_OXIDATION, window)))
    cls = F.array(*[F.lit(c) for _, _, c in FORMS])
    names = F.array(*[F.lit(n) for n, _, _ in FORMS])
    clash = F.col("_b").isNotNull() & F.col("_box").isNotNull() & (F.get(cls, F.col("_b")) != F.get(cls, F.col("_box")))
    out = (F.when(F.col("_n") == 0, "no_cys").when(F.col("_n") > 1, "multi_cys")
           .when((F.col("_c") >= F.col("tag_pos")) & (F.col("_c") < F.col("_end")), "cys_in_tag")
           .when(~F.col("_exact") & (gap_n != F.col("_nside")), "cys_outside_region")
           .when(~F.col("_exact") & F.col("_nside") & (F.col("start") == 0), "protein_nterm")
           .when(trunc, "truncation").when(clash, "met_ambiguous")
           .when(F.coalesce("_b", "_box").isNotNull(), "binned").otherwise("unexplained"))
    p = p.withColumn("outcome", out)
    f = F.when(F.col("outcome") == "binned", F.coalesce("_b", "_box"))
    return p.withColumn("form", F.get(names, f)).withColumn("cls", F.get(cls, f)).drop(
        "_pep", "_L", "_n", "_c", "_end", "_nside", "_exact", "_gap", "_lo", "_hi", "_b", "_box")


def cys_votes(evaluated: DataFrame) -> DataFrame:
    """One vote per spectrum from its best counted tag; placements of other classes make a conflict.

    ``evaluated``: run_id, idx, seq, evalue, outcome, cls, form.
    """
    c = evaluated.filter("outcome IN ('binned', 'unexplained')").withColumn("_k", F.coalesce("cls", F.lit("?")))
    t = c.groupBy("run_id", "idx", "seq", "evalue").agg(
        F.countDistinct("_k").alias("kinds"), F.first("_k").alias("cls"), F.countDistinct(F.coalesce("form", F.lit("?"))).alias("forms"), F.first("form").alias("form"))
    w = W.partitionBy("run_id", "idx").orderBy("evalue", "seq")
    v = t.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return v.select("run_id", "idx", F.when(F.col("kinds") > 1, "conflict").when(F.col("cls") == "?", "unexplained").otherwise(F.col("cls")).alias("vote"),
                    F.when((F.col("kinds") == 1) & (F.col("forms") == 1), F.col("form")).alias("form"))


def alkylation_call(votes: DataFrame, min_spectra: int = MIN_SPECTRA, min_share: float = MIN_SHARE) -> DataFrame:
    """Leading class per run with its share; no call when few, tied or below the share."""
    n = votes.filter("vote NOT IN ('conflict', 'unexplained')").groupBy("run_id", "vote").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct("n", F.lit(0) - F.array_position(F.array(*[F.lit(c) for c in dict.fromkeys(c for _, _, c in FORMS)]), F.col("vote")))
    g = n.groupBy("run_id").agg(F.sum("n").alias("binned"), F.max("n").alias("top"), F.max_by("vote", order).alias("cls"), F.collect_list("n").alias("all"))
    tie = F.size(F.filter("all", lambda x: x == F.col("top"))) > 1
    share = F.col("top") / F.col("binned")
    reason = F.when(F.col("binned") < min_spectra, "few_cys_spectra").when(tie | (F.col("top") < min_spectra) | (share < min_share), "ambiguous").otherwise("-")
    return g.select("run_id", "cls", "binned", "top", share.alias("share"), reason.alias("reason"), (reason == "-").alias("called"))


def alkylation_tags(spectra: DataFrame, peaks: DataFrame, params, max_evalue: float = 1e-4) -> DataFrame:
    """Votes of a second tagging pass with cysteine alternatives and no gaps.

    The best tag of a spectrum votes when its E-value is small, its charge is 1 and a cysteine sits
    inside it; forms that cannot be told apart at that position stay unresolved.
    """
    from dataclasses import replace
    from ionweave.plans import tag_run
    alt = {f"C[{n}]": m for n, m, _ in FORMS if m != 0.0}
    p = replace(params, fixed={}, variable=alt, max_gaps=0, max_extension=0)
    t = tag_run.tag_spectra(spectra, peaks, p).filter((F.col("rank") == 1) & (F.col("evalue") <= max_evalue) & (F.col("charge") == 1))
    inner = F.slice(S.residue_tokens("seq"), F.lit(2), F.greatest(F.lit(0), F.size(S.residue_tokens("seq")) - 2))
    cys = F.filter(inner, lambda x: F.substring(x, 1, 1) == "C")
    name = F.regexp_extract(F.get(cys, F.lit(0)), r"\[(.*)\]", 1)
    kinds = F.create_map(*[F.lit(x) for n, _, c in FORMS for x in (n, c)])
    v = t.filter(F.size(cys) == 1).withColumn("_f", F.when(name == "", "unmodified").otherwise(name))
    return v.select("run_id", "idx", F.element_at(kinds, F.col("_f")).alias("vote"), F.col("_f").alias("form"))
