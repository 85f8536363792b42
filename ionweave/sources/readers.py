"""Readers: peak lists, spectra, sequences, taxonomies, catalogues, tables and identifications as DataFrames."""
from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ionweave.functions import scalar as S

PEAK = T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.FloatType())])
SPECTRA_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("spectrum_id", T.StringType()),
    T.StructField("ms_level", T.IntegerType()), T.StructField("rt", T.DoubleType()), T.StructField("precursor_mz", T.DoubleType()),
    T.StructField("charge", T.IntegerType()), T.StructField("possible_charges", T.ArrayType(T.IntegerType())), T.StructField("iso_target", T.DoubleType()),
    T.StructField("iso_lower", T.DoubleType()), T.StructField("iso_upper", T.DoubleType()), T.StructField("ion_mobility", T.DoubleType()),
    T.StructField("analyzer", T.StringType()), T.StructField("activation", T.StringType()), T.StructField("peaks", T.ArrayType(PEAK))])


def _field(lines, name: str):
    """Value of ``NAME=value`` among a block's lines, or NULL."""
    hit = F.get(F.filter(lines, lambda l: F.startswith(F.upper(l), F.lit(name + "="))), F.lit(0))
    return F.trim(F.substr(hit, F.lit(len(name) + 2)))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """MGF blocks as spectra with peaks; ``_corrupt`` holds the text of malformed blocks.

    CHARGE lists give charge 0 and possible charges, negative charges their magnitude, RT ranges the
    midpoint; comments are dropped and TITLE is kept as written. ``idx`` orders the blocks of a file.
    """
    raw = spark.read.option("lineSep", "END IONS").text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("idx"), "value")
    return parse_mgf_blocks(raw.filter(F.trim("value") != "")).drop("file")


def parse_mgf_blocks(raw: DataFrame) -> DataFrame:
    """Columns file, idx and value (one block each) to spectra; also used on streams."""
    text = F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"(?s)^.*?BEGIN IONS", "BEGIN IONS")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda l: F.trim(l)), lambda l: (l != "") & ~l.rlike(r"^[#;!/]"))
    d = raw.withColumn("_l", lines).filter(F.size("_l") > 0)
    body = F.filter("_l", lambda l: ~F.contains(l, F.lit("=")) & (l != "BEGIN IONS"))
    nums = F.transform(body, lambda l: F.split(l, r"\s+"))
    d = d.withColumn("_p", F.transform(nums, lambda a: F.struct(F.get(a, F.lit(0)).try_cast("double").alias("mz"), F.coalesce(F.get(a, F.lit(1)).try_cast("float"), F.lit(0.0).cast("float")).alias("intensity"))))
    d = d.withColumn("_pm", F.split(_field(F.col("_l"), "PEPMASS"), r"\s+")).withColumn("_ch", _field(F.col("_l"), "CHARGE")).withColumn("_rt", _field(F.col("_l"), "RTINSECONDS"))
    z = F.transform(F.regexp_extract_all(F.coalesce("_ch", F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    rts = F.transform(F.regexp_extract_all(F.coalesce("_rt", F.lit("")), F.lit(r"(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    d = d.withColumn("_z", z).withColumn("_r", rts)
    bad = (F.get("_l", F.lit(0)) != "BEGIN IONS") | F.exists("_p", lambda p: p.mz.isNull()) | (F.size(F.filter("_l", lambda l: l == "BEGIN IONS")) != 1)
    stem = S.run_stem("file")
    return d.select(
        "file", stem.alias("run_id"), "idx", _field(F.col("_l"), "TITLE").alias("spectrum_id"), F.lit(2).alias("ms_level"),
        F.when(F.size("_r") > 0, F.aggregate("_r", F.lit(0.0), lambda a, x: a + x) / F.size("_r")).alias("rt"),
        F.get("_pm", F.lit(0)).try_cast("double").alias("precursor_mz"), F.when(F.size("_z") == 1, F.get("_z", F.lit(0))).otherwise(0).alias("charge"),
        F.when(F.size("_z") > 1, F.col("_z")).alias("possible_charges"), _field(F.col("_l"), "SCANS").alias("scans"),
        F.when(~bad, F.col("_p")).alias("peaks"), F.when(bad, F.col("value")).alias("_corrupt"))


# ------------------------------------------------------------------ mzML
_CV = "array<struct<_accession:string,_value:string,_name:string,_unitName:string>>"
_MZML = (
    f"_index long, _id string, _defaultArrayLength long, cvParam {_CV}, "
    f"scanList struct<scan: array<struct<cvParam:{_CV}>>>, "
    f"precursorList struct<precursor: array<struct<isolationWindow:struct<cvParam:{_CV}>, selectedIonList:struct<selectedIon:array<struct<cvParam:{_CV}>>>, activation:struct<cvParam:{_CV}>>>>, "
    f"binaryDataArrayList struct<binaryDataArray: array<struct<cvParam:{_CV}, binary:string>>>")


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of mzML files: XML rows by the built-in source, base64 arrays decoded in Arrow batches.

    A spectrum whose m/z and intensity arrays differ in length has NULL peaks, as opposed to none.
    """
    x = (spark.read.format("xml").option("rowTag", "spectrum").schema(_MZML).load(path)
         .withColumn("run_id", S.run_stem(F.input_file_name())))
    val = lambda ps, acc: F.get(F.filter(F.coalesce(ps, F.array().cast(_CV)), lambda p: p._accession == acc), F.lit(0))._value
    has = lambda ps, acc: F.exists(F.coalesce(ps, F.array().cast(_CV)), lambda p: p._accession == acc)
    scan = F.get("scanList.scan", F.lit(0)).cvParam
    rt = F.get(F.filter(F.coalesce(scan, F.array().cast(_CV)), lambda p: p._accession == "MS:1000016"), F.lit(0))
    prec = F.get("precursorList.precursor", F.lit(0))
    ion = F.get(prec.selectedIonList.selectedIon, F.lit(0)).cvParam
    win = prec.isolationWindow.cvParam
    arrays = F.coalesce("binaryDataArrayList.binaryDataArray", F.array().cast(f"array<struct<cvParam:{_CV},binary:string>>"))
    pick = lambda acc: F.get(F.filter(arrays, lambda a: F.exists(a.cvParam, lambda p: p._accession == acc)), F.lit(0))
    enc = lambda a: F.struct(a.binary.alias("data"), F.coalesce(has(a.cvParam, "MS:1000523"), F.lit(False)).alias("f64"), F.coalesce(has(a.cvParam, "MS:1000574"), F.lit(False)).alias("zip"))
    flat = x.select(
        "run_id", F.col("_index").alias("idx"), F.col("_id").alias("spectrum_id"), val(F.col("cvParam"), "MS:1000511").cast("int").alias("ms_level"),
        (rt._value.cast("double") * F.when(rt._unitName == "minute", 60.0).otherwise(1.0)).alias("rt"), val(ion, "MS:1000744").cast("double").alias("precursor_mz"),
        F.coalesce(val(ion, "MS:1000041").cast("int"), F.lit(0)).alias("charge"), val(win, "MS:1000827").cast("double").alias("iso_target"),
        val(win, "MS:1000828").cast("double").alias("iso_lower"), val(win, "MS:1000829").cast("double").alias("iso_upper"),
        val(scan, "MS:1002476").cast("double").alias("ion_mobility"), val(scan, "MS:1000512").alias("analyzer"),
        F.array_join(F.transform(prec.activation.cvParam, lambda p: p._name), ",").alias("activation"), enc(pick("MS:1000514")).alias("_m"), enc(pick("MS:1000515")).alias("_i"))
    keep = [f for f in flat.schema.fields if f.name not in ("_m", "_i")]
    out = T.StructType([*keep, T.StructField("peaks", T.ArrayType(PEAK))])
    names = [f.name for f in keep]

    def one(e) -> np.ndarray:
        if not e or not e["data"] or not e["data"].strip():
            return np.array([])
        raw = base64.b64decode(e["data"])
        raw = zlib.decompress(raw) if e["zip"] else raw
        return np.frombuffer(raw, dtype="<f8" if e["f64"] else "<f4").astype(float)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ptype = pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float32())]))
        for b in batches:
            mz, intensity, size = [np.zeros(0)], [np.zeros(0)], [0]
            unequal = np.zeros(b.num_rows, bool)
            for k, (m, y) in enumerate(zip(b.column("_m").to_pylist(), b.column("_i").to_pylist(), strict=True)):
                a, c = one(m), one(y)
                unequal[k] = len(a) != len(c)
                o = np.argsort(a, kind="stable") if not unequal[k] else []
                mz.append(a[o] if len(o) else a[:0])
                intensity.append(c[o] if len(o) else c[:0])
                size.append(len(o))
            flat_peaks = pa.StructArray.from_arrays([pa.array(np.concatenate(mz)), pa.array(np.concatenate(intensity).astype(np.float32))], fields=list(ptype.value_type))
            offsets = pa.array(np.cumsum(size).astype(np.int32), mask=np.append(unequal, False))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.ListArray.from_arrays(offsets, flat_peaks)], names=[*names, "peaks"])

    return flat.mapInArrow(decode, out)


def ingest_mzml(spark: SparkSession, path: str, out: str) -> None:
    """Bulk conversion of mzML to the spectra layout, partitioned by run."""
    read_mzml(spark, path).write.mode("overwrite").partitionBy("run_id").parquet(out)


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """The spectra layout; unread columns, peaks included, are never decoded."""
    return spark.read.schema(SPECTRA_SCHEMA).parquet(path)


def peaks_of(spectra: DataFrame) -> DataFrame:
    """(run_id, idx, mz, intensity) rows of the spectra layout."""
    return spectra.select("run_id", "idx", F.explode("peaks").alias("p")).select("run_id", "idx", "p.mz", "p.intensity")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, accession, description, sequence); ordinals follow file order."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("v"))
    head = F.substring_index("v", "\n", 1)
    body = F.when(F.contains("v", F.lit("\n")), F.expr("substring(v, locate('\n', v) + 1)")).otherwise("")
    d = raw.filter(F.trim("v") != "").select("ordinal", F.regexp_extract(head, r"^(\S+)", 1).alias("accession"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"),
                                            F.upper(F.regexp_replace(body, r"[^A-Za-z]", "")).alias("sequence"))
    return d.filter("accession <> ''")


def read_taxdump(spark: SparkSession, nodes: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, names): scientific names only; malformed and repeated rows are skipped."""
    part = lambda n: F.regexp_replace(F.get(F.split("value", r"\|"), F.lit(n)), r"^\s+|\s+$", "")
    nd = spark.read.text(nodes).select(part(0).try_cast("long").alias("taxid"), part(1).try_cast("long").alias("parent"), part(2).alias("rank"))
    nm = spark.read.text(names).select(part(0).try_cast("long").alias("taxid"), part(1).alias("name"), part(3).alias("cls"))
    return (nd.filter("taxid IS NOT NULL AND parent IS NOT NULL").dropDuplicates(["taxid"]),
            nm.filter("taxid IS NOT NULL AND cls = 'scientific name'").dropDuplicates(["taxid"]).drop("cls"))


def read_mod_catalogue(spark: SparkSession, unimod_xml: str | None = None, psimod_obo: str | None = None) -> DataFrame:
    """(acc, name, origin, term, mass, label): one row per site specificity.

    OBO terms count when not obsolete, with a non-zero DiffMono and one origin; X only with a terminus.
    """
    cols = ["acc", "name", "origin", "term", "mass", "label"]
    out = None
    if unimod_xml:
        schema = ("_record_id string, _title string, `umod:specificity` array<struct<_site:string,_position:string,_classification:string>>, `umod:delta` struct<_mono_mass:double>")
        x = spark.read.format("xml").option("rowTag", "umod:mod").schema(schema).load(unimod_xml).withColumn("s", F.explode("umod:specificity"))
        pos = F.col("s._position")
        term = F.when(pos == "Anywhere", "anywhere").when(pos == "Any N-term", "n_term").when(pos == "Any C-term", "c_term").when(pos == "Protein N-term", "protein_n_term").when(pos == "Protein C-term", "protein_c_term")
        site = F.when(F.col("s._site").rlike("^[A-Z]$"), F.col("s._site")).otherwise("X")
        out = x.select(F.concat(F.lit("UNIMOD:"), "_record_id").alias("acc"), F.col("_title").alias("name"), site.alias("origin"), term.alias("term"), F.col("`umod:delta`._mono_mass").alias("mass"),
                       (F.col("s._classification") == "Isotopic label").alias("label")).filter("mass <> 0 AND term IS NOT NULL AND (origin <> 'X' OR term <> 'anywhere')")
    if psimod_obo:
        t = spark.read.option("lineSep", "[Term]").text(psimod_obo)
        g = lambda p: F.regexp_extract("value", p, 1)
        o = t.select(g(r"(?m)^id: (MOD:\d+)").alias("acc"), g(r"(?m)^name: (.*)$").alias("name"), g(r'(?m)^xref: Origin: "([^"]*)"').alias("origin"), g(r'(?m)^xref: TermSpec: "([^"]*)"').alias("spec"),
                     g(r'(?m)^xref: DiffMono: "([^"]*)"').try_cast("double").alias("mass"), F.col("value").rlike(r"(?m)^is_obsolete: true").alias("obs"), F.lower("value").contains("isotope label").alias("label"))
        term = F.when(F.col("spec") == "N-term", "n_term").when(F.col("spec") == "C-term", "c_term").otherwise("anywhere")
        o = o.filter("acc <> '' AND NOT obs AND mass <> 0 AND origin RLIKE '^[A-Z]$'").select("acc", "name", "origin", term.alias("term"), "mass", "label").filter("origin <> 'X' OR term <> 'anywhere'")
        out = o if out is None else out.unionByName(o)
    return out.select(*cols)


PARAM_TABLES = {
    "protease_models": "model string, class string, end string, residue string, freq string", "calibration": "feature string, coef double",
    "gap_mods": "name string, site string, prior double", "species_params": "key string, value string",
    "proteomes": "name string, proteome string, taxon long, release string, release_date string, entries long, sha256 string, fasta_sha256 string, file string"}


def read_param_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Commented tab-separated parameter tables with a fixed schema; a malformed row is an error."""
    return spark.read.option("comment", "#").option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(PARAM_TABLES[kind]).csv(path, sep="\t")


PSM_COLUMNS = {
    "sage": {"id": "scannr", "peptide": "peptide", "q": "spectrum_q", "score": "sage_discriminant_score", "decoy": "label = -1", "rank": "rank"},
    "comet": {"id": "scan", "peptide": "plain_peptide", "q": None, "score": "xcorr", "decoy": "protein LIKE 'DECOY%'", "rank": "num"},
    "mascot": {"id": "pep_scan_title", "peptide": "pep_seq", "q": None, "score": "pep_score", "decoy": "prot_acc LIKE 'DECOY%'", "rank": "pep_rank"}}


def read_psms(spark: SparkSession, path: str, engine: str) -> DataFrame:
    """(key, peptide, q, score, is_decoy, rank) from search results; q is NULL where the engine gives none.

    ``mztab`` reads the PSM section of mzTab.
    """
    if engine == "mztab":
        v = F.split("value", "\t")
        t = spark.read.text(path).filter(F.startswith("value", F.lit("PS")))
        cols = t.filter(F.startswith("value", F.lit("PSH"))).select(v.alias("h")).first()["h"]   # one header line
        at = lambda n: F.get(v, F.lit(cols.index(n)))
        ps = t.filter(F.startswith("value", F.lit("PSM")))
        dec = at("opt_global_cv_MS:1002217_decoy_peptide") == "1" if "opt_global_cv_MS:1002217_decoy_peptide" in cols else F.lit(False)
        return ps.select(S.spectrum_key(F.regexp_replace(at("spectra_ref"), r"^ms_run\[\d+\]:", "")).alias("key"), S.normalize_peptide(at("sequence")).alias("peptide"), F.lit(None).cast("double").alias("q"),
                         at("search_engine_score[1]").try_cast("double").alias("score"), dec.alias("is_decoy"), F.lit(1).alias("rank"))
    m = PSM_COLUMNS[engine]
    r = spark.read.option("header", True)
    if engine == "comet":   # a version line precedes the header
        r = r.option("comment", "C")
    d = r.csv(path, sep="," if engine == "mascot" else "\t")
    return d.select(S.spectrum_key(m["id"]).alias("key"), S.normalize_peptide(m["peptide"]).alias("peptide"), (F.col(m["q"]).try_cast("double") if m["q"] else F.lit(None).cast("double")).alias("q"),
                    F.col(m["score"]).try_cast("double").alias("score"), F.expr(m["decoy"]).alias("is_decoy"), F.col(m["rank"]).try_cast("int").alias("rank"))


def read_sdrf(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, key, value): annotation cells per data file; ``NT=...;AC=...`` cells give their name."""
    d = spark.read.option("header", True).csv(path, sep="\t")
    cols = d.columns
    file = next(c for c in cols if c.lower().startswith("comment[data file]"))
    run = S.run_stem(F.col(f"`{file}`"))
    cells = F.array(*[F.struct(F.lit(c.lower()).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols if c != file])
    x = d.select(run.alias("run_id"), F.explode(cells).alias("c")).select("run_id", "c.key", "c.value").filter("value IS NOT NULL")
    named = F.regexp_extract("value", r"(?i)(?:^|;)\s*NT=([^;]*)", 1)
    return x.select("run_id", F.regexp_replace("key", r"\.\d+$|\d+$", "").alias("key"), F.when(named != "", named).otherwise(F.col("value")).alias("value")).distinct()
