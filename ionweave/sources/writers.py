"""Writers: tag tables, tagged spectra, reduced databases, reads for assembly, reports, MGF."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ionweave.functions import scalar as S

KEY = ["run_id", "idx"]


def tag_table(tags: DataFrame, proforma: bool = False, usi_prefix: str | None = None, fixed: dict[str, str] | None = None) -> DataFrame:
    """Reported columns of a tag table with optional ProForma and universal identifiers."""
    d = tags.withColumn("tag", F.col("seq")).withColumn("length", F.col("n_res")).withColumn("res_conf", F.array_join("res_conf", ","))
    cols = [*KEY, *[c for c in ("spectrum", "rank") if c in tags.columns], "tag", "length", "charge", "nterm_mass", "cterm_mass", "extended", "gapped", "evalue", "min_conf", "mean_conf", "res_conf", "ion_series"]
    cols += [c for c in ("q_db", "fasta_hit") if c in tags.columns]
    if proforma:
        d = d.withColumn("proforma", S.to_proforma("seq", "nterm_mass", "cterm_mass", fixed))
        cols.append("proforma")
    if usi_prefix:
        d = d.withColumn("usi", F.concat(F.lit(usi_prefix + ":"), F.col("run_id").cast("string"), F.lit(":"), S.usi_index("spectrum", F.col("idx"))))
        cols.append("usi")
    return d.select(*cols)


def write_tags(tags: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    t = tag_table(tags, **options)
    w = t.write.mode("overwrite")
    w.parquet(path) if fmt == "parquet" else w.csv(path, sep="\t", header=True)


def write_tagged_spectra(spectra: DataFrame, tags: DataFrame, path: str) -> None:
    """Only spectra with a reported tag that is not an entrapment hit."""
    keep = tags.filter(~F.col("entrapment")) if "entrapment" in tags.columns else tags
    spectra.join(keep.select(*KEY).distinct(), KEY, "left_semi").write.mode("overwrite").parquet(path)


def reduced_fasta(proteins: DataFrame, keep: DataFrame, background: DataFrame | None = None, decoy_prefix: str | None = None) -> DataFrame:
    """(ordinal, value): FASTA text of kept entries in database order, background, then reversed decoys."""
    k = proteins.join(keep.select("accession").distinct(), "accession", "left_semi").withColumn("_s", F.lit(0))
    if background is not None:
        k = k.unionByName(background.withColumn("_s", F.lit(1)).select(*k.columns))
    if decoy_prefix:
        k = k.unionByName(k.withColumn("accession", F.concat(F.lit(decoy_prefix), "accession")).withColumn("sequence", F.reverse("sequence")).withColumn("_s", F.col("_s") + 2))
    head = F.concat(F.lit(">"), "accession", F.when(F.length("description") > 0, F.concat(F.lit(" "), "description")).otherwise(""))
    wrap = F.regexp_replace("sequence", "(.{80})(?!$)", "$1\n")
    return k.select("_s", "ordinal", F.concat(head, F.lit("\n"), wrap).alias("value"))


def write_reduced_fasta(proteins: DataFrame, keep: DataFrame, path: str, background: DataFrame | None = None, decoy_prefix: str | None = None) -> None:
    reduced_fasta(proteins, keep, background, decoy_prefix).orderBy("_s", "ordinal").select("value").write.mode("overwrite").text(path)


def denovo_reads(tags: DataFrame, min_len: int = 5, top_n: int = 0) -> DataFrame:
    """Reads for assembly: sequence, average local confidence (percent) and local confidences.

    ``top_n`` keeps the best tags of a spectrum by confidence, then E-value.
    """
    alc = F.aggregate("res_conf", F.lit(0.0), lambda a, x: a + x) / F.size("res_conf")
    t = tags.filter(F.col("n_res") >= min_len).withColumn("alc", F.round(alc, 2)).withColumn("local_confidence", F.array_join("res_conf", " "))
    if top_n:
        w = W.partitionBy(*KEY).orderBy(F.desc("alc"), "evalue", "seq")
        t = t.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_n).drop("_r")
    return t.select(*KEY, F.col("seq").alias("peptide"), F.col("n_res").alias("length"), "alc", "local_confidence", "charge", "evalue", "nterm_mass", "cterm_mass")


def export_denovo_reads(tags: DataFrame, path: str, fmt: str = "full", min_len: int = 5, top_n: int = 0) -> None:
    r = denovo_reads(tags, min_len, top_n)
    cols = r.columns if fmt == "full" else ["run_id", "idx", "peptide", "alc", "local_confidence"]
    r.select(*cols).write.mode("overwrite").csv(path, header=True)


def report_rows(df: DataFrame, section: str, keys: list[str], count: str | None = None) -> DataFrame:
    """Wide per-run aggregates as (run_id, section, key, value, n, description) text rows."""
    n = F.coalesce(F.col(count).cast("string"), F.lit("-")) if count else F.lit("-")
    wide = df.select("run_id", n.alias("n"), *[F.col(k).cast("string").alias(k) for k in keys])
    u = wide.unpivot(["run_id", "n"], keys, "key", "value").withColumn("value", F.coalesce("value", F.lit("-")))
    return u.select("run_id", F.lit(section).alias("section"), "key", "value", "n", F.concat("key", F.lit(" = "), "value").alias("description"))


def placement_hits(placements: DataFrame) -> DataFrame:
    """One row per (spectrum, peptide) with its proteins and best E-value.

    Placements of one spectrum's peptide are distinct proteins; the set is collected after a distinct.
    """
    p = placements.groupBy(*KEY, "peptide", "accession").agg(F.min("start").alias("start"), F.min("evalue").alias("evalue"))
    return p.groupBy(*KEY, "peptide").agg(F.min("evalue").alias("evalue"), F.count(F.lit(1)).alias("n_proteins"),
                                          F.array_sort(F.collect_set(F.struct("accession", "start"))).alias("placements"))


def mgf_blocks(spectra: DataFrame, skip_empty: bool = True) -> DataFrame:
    """(run_id, idx, value): MGF text of MS2 spectra."""
    s = spectra.filter((F.col("ms_level") == 2) & F.col("precursor_mz").isNotNull())
    if skip_empty:
        s = s.filter(F.size("peaks") > 0)
    opt = lambda c, fmt: F.when(F.col(c).isNotNull(), F.format_string(fmt, F.col(c))).otherwise("")
    peaks = F.array_join(F.transform(F.coalesce("peaks", F.array().cast(spectra.schema["peaks"].dataType)), lambda p: F.format_string("%.6f %.4f", p.mz, p.intensity.cast("double"))), "\n")
    scan = S.scan_of("spectrum_id")
    return s.select(*KEY, F.concat(
        F.lit("BEGIN IONS\nTITLE="), F.coalesce("spectrum_id", F.col("idx").cast("string")), F.format_string("\nPEPMASS=%.6f\n", F.col("precursor_mz")),
        F.when(F.col("charge") > 0, F.format_string("CHARGE=%d+\n", F.col("charge"))).otherwise(""), opt("rt", "RTINSECONDS=%.3f\n"),
        F.when(scan.isNotNull(), F.format_string("SCANS=%d\n", scan)).otherwise(""), peaks, F.when(peaks != "", "\n").otherwise(""), F.lit("END IONS\n")).alias("value"))


def write_mgf(spectra: DataFrame, path: str, skip_empty: bool = True) -> None:
    mgf_blocks(spectra, skip_empty).sortWithinPartitions(*KEY).select("value").write.mode("overwrite").text(path)
