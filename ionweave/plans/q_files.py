"""Queries of the file operators: the given tables are written in a format and read back; the checking SQL reads the tables."""
from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ionweave.operators import ranking
from ionweave.plans import q_tagging as QT, views as V
from ionweave.plans.registry import query
from ionweave.session import ensure_checkpoint_dir
from ionweave.sources import readers as I, writers as O
from ionweave.streaming import streams as W

KEY = ["run_id", "idx"]


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _layout(spark, sf) -> DataFrame:
    """Spectra with peaks from part and lineitem, in the spectra layout's columns."""
    p = V.peaks(spark, sf).groupBy("idx").agg(F.sort_array(F.collect_list(F.struct(F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("float").alias("intensity")))).alias("peaks"))
    s = V.spectra(spark, sf).select(F.concat(F.lit("run"), F.col("run_id").cast("string")).alias("run_id"), F.col("idx").cast("long").alias("idx"), F.concat(F.lit("s"), F.col("idx").cast("string")).alias("spectrum_id"),
                                    F.lit(2).alias("ms_level"), F.col("rt").cast("double").alias("rt"), F.col("precursor_mz").cast("double").alias("precursor_mz"), F.col("charge").cast("int").alias("charge"))
    return s.join(p, "idx").select("run_id", "idx", "spectrum_id", "ms_level", "rt", "precursor_mz", "charge", "peaks")


def _digest(spectra: DataFrame) -> DataFrame:
    """One row per spectrum with sums over its peaks."""
    total = lambda f: F.aggregate("peaks", F.lit(0.0), lambda a, x: a + f(x))
    return spectra.select("spectrum_id", F.round("precursor_mz", 5).alias("precursor_mz"), "charge", F.round("rt", 3).alias("rt"), F.size("peaks").cast("long").alias("n"),
                          F.round(total(lambda x: F.round(x.mz, 5)), 4).alias("mz"), F.round(total(lambda x: x.intensity.cast("double")), 3).alias("intensity"))


Q_DIGEST = (V.cte(p=V.Q_PEAKS, s=V.Q_SPECTRA, d="SELECT idx, count(*) AS n, round(sum(round(mz, 5)), 4) AS mz, round(sum(intensity), 3) AS intensity FROM p GROUP BY 1") +
            "SELECT 's' || s.idx AS spectrum_id, round(precursor_mz, 5) AS precursor_mz, charge, round(rt, 3) AS rt, n, mz, intensity FROM s JOIN d USING (idx)")


@query("S1_read_mgf", Q_DIGEST)
def s1(spark, sf):
    path = _folder(spark)
    O.write_mgf(_layout(spark, sf), path)
    return _digest(I.read_mgf(spark, path))


@query("S16_write_mgf", V.cte(p=V.Q_PEAKS, s=V.Q_SPECTRA) + "SELECT 'BEGIN IONS' AS kind, count(*) AS n FROM s WHERE idx IN (SELECT idx FROM p) UNION ALL SELECT 'peak', count(*) FROM p WHERE idx IN (SELECT idx FROM s) "
       "UNION ALL SELECT 'CHARGE', count(*) FROM s WHERE charge > 0 AND idx IN (SELECT idx FROM p) UNION ALL SELECT 'PEPMASS', count(*) FROM s WHERE idx IN (SELECT idx FROM p)")
def s16(spark, sf):
    path = _folder(spark)
    O.write_mgf(_layout(spark, sf), path)
    line = spark.read.text(path).filter("value <> ''")
    kind = F.when(F.col("value").rlike(r"^\d"), "peak").otherwise(F.regexp_extract("value", "^(BEGIN IONS|CHARGE|PEPMASS)", 1))
    return line.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).filter("kind <> ''")


def _mzml(spectra: DataFrame) -> DataFrame:
    """(value): one mzML spectrum element per row within a root, arrays of 64-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cv = lambda acc, name, value="", unit="": f'<cvParam accession="{acc}" name="{name}" value="{value}" unitName="{unit}"/>'
        yield pa.RecordBatch.from_pydict({"value": ["<mzML>"]})          # a file per partition, each with a root
        for b in batches:
            out = []
            for r in b.to_pylist():
                arrays = ""
                for acc, name, col in (("MS:1000514", "m/z array", "mz"), ("MS:1000515", "intensity array", "intensity")):
                    raw = base64.b64encode(np.array([p[col] for p in r["peaks"]], "<f8").tobytes()).decode()
                    arrays += f'<binaryDataArray>{cv("MS:1000523", "64-bit float")}{cv("MS:1000576", "no compression")}{cv(acc, name)}<binary>{raw}</binary></binaryDataArray>'
                ion = cv("MS:1000744", "selected ion m/z", repr(r["precursor_mz"])) + (cv("MS:1000041", "charge state", r["charge"]) if r["charge"] else "")
                out.append(f'<spectrum index="{r["idx"]}" id="{r["spectrum_id"]}" defaultArrayLength="{len(r["peaks"])}">{cv("MS:1000511", "ms level", 2)}'
                           f'<scanList><scan>{cv("MS:1000016", "scan start time", repr(r["rt"]), "second")}</scan></scanList><precursorList><precursor><selectedIonList><selectedIon>{ion}</selectedIon></selectedIonList>'
                           f'<activation>{cv("MS:1000422", "beam-type collision-induced dissociation")}</activation></precursor></precursorList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>')
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["</mzML>"]})
    return spectra.mapInArrow(run, "value string")


@query("S2_ingest_mzml", Q_DIGEST)
def s2(spark, sf):
    path = _folder(spark)
    _mzml(_layout(spark, sf)).write.text(path + "/mzml")
    I.ingest_mzml(spark, path + "/mzml", path + "/spectra")
    return _digest(spark.read.parquet(path + "/spectra"))


@query("S3_read_spectra", V.cte(p=V.Q_PEAKS, s=V.Q_SPECTRA) + "SELECT 'run' || s.run_id AS run_id, s.idx, round(p.mz, 5) AS mz, p.intensity FROM p JOIN s USING (idx)")
def s3(spark, sf):
    path = _folder(spark)
    _layout(spark, sf).write.parquet(path)
    return I.peaks_of(I.read_spectra(spark, path)).select("run_id", "idx", F.round("mz", 5).alias("mz"), F.col("intensity").cast("double").alias("intensity"))


@query("S4_read_fasta", "SELECT doc_id::VARCHAR AS accession, source AS description, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents")
def s4(spark, sf):
    path = _folder(spark)
    d = V.table(spark, sf, "documents").select("doc_id", "source", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("s"))
    d.select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" "), "source", F.lit("\n"), F.regexp_replace("s", "(.{60})(?!$)", "$1\n")).alias("value")).write.text(path)
    return I.read_fasta(spark, path).select("accession", "description", "sequence")


@query("S5_read_taxdump", "SELECT c_custkey AS taxid, c_nationkey::BIGINT AS parent, c_mktsegment AS rank, c_name AS name FROM customer")
def s5(spark, sf):
    path, c = _folder(spark), V.table(spark, sf, "customer")
    row = lambda *cells: F.concat(F.concat_ws("\t|\t", *cells), F.lit("\t|"))
    c.select(row(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("value")).write.text(path + "/nodes")
    synonym = c.select(row(F.col("c_custkey").cast("string"), F.lit("other"), F.lit(""), F.lit("synonym")).alias("value"))
    c.select(row(F.col("c_custkey").cast("string"), "c_name", F.lit(""), F.lit("scientific name")).alias("value")).unionAll(synonym).write.text(path + "/names")
    nodes, names = I.read_taxdump(spark, path + "/nodes", path + "/names")
    return nodes.join(names, "taxid").select("taxid", "parent", "rank", "name")


@query("S6_read_mod_catalogue", "SELECT 'MOD:' || lpad(p_partkey::VARCHAR, 7, '0') AS acc, p_name AS name, p_brand[7] AS origin_digit, round(p_retailprice / 10, 4) AS mass FROM part WHERE p_size % 5 <> 0")
def s6(spark, sf):
    path, p = _folder(spark), V.table(spark, sf, "part")
    acc = F.concat(F.lit("MOD:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    letter = F.translate(F.substring("p_brand", 7, 1), "0123456789", "ACDEFGHIKL")
    obsolete = F.when(F.col("p_size") % 5 == 0, "is_obsolete: true\n").otherwise("")
    p.select(F.concat(F.lit("[Term]\nid: "), acc, F.lit("\nname: "), "p_name", F.lit('\nxref: DiffMono: "'), F.round(F.col("p_retailprice") / 10, 4).cast("string"), F.lit('"\nxref: Origin: "'), letter,
                      F.lit('"\nxref: TermSpec: "none"\n'), obsolete).alias("value")).write.text(path)
    c = I.read_mod_catalogue(spark, psimod_obo=path)
    return c.select("acc", "name", F.translate("origin", "ACDEFGHIKL", "0123456789").alias("origin_digit"), F.round("mass", 4).alias("mass"))


@query("S7_read_param_table", "SELECT p_name AS name, p_brand AS site, p_retailprice AS prior FROM part")
def s7(spark, sf):
    path = _folder(spark)
    V.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("site"), F.col("p_retailprice").alias("prior")).write.csv(path, sep="\t", header=True)
    return I.read_param_table(spark, path, "gap_mods")


@query("S8_read_psms", "SELECT l.doc_id::VARCHAR AS scan, upper(d.lang) AS peptide, l.quality / 10.0 AS q, d.n_chars::DOUBLE AS score, l.toxic = 1 AS is_decoy, 1 AS rank FROM labels l JOIN documents d USING (doc_id)")
def s8(spark, sf):
    path = _folder(spark)
    d = V.table(spark, sf, "labels").join(V.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    d.select(F.concat(F.lit("scan="), F.col("doc_id").cast("string")).alias("scannr"), F.concat(F.lit("-."), F.upper("lang"), F.lit(".K")).alias("peptide"), (F.col("quality") / 10).alias("spectrum_q"), F.col("n_chars").cast("double").alias("sage_discriminant_score"),
             F.when(F.col("toxic") == 1, -1).otherwise(1).alias("label"), F.lit(1).alias("rank")).write.csv(path, sep="\t", header=True)
    return I.read_psms(spark, path, "sage").select(F.regexp_extract("key", r"(\d+)$", 1).alias("scan"), "peptide", "q", "score", "is_decoy", "rank")


@query("S9_read_sdrf", "SELECT 'f' || s_suppkey AS run_id, 'characteristics[organism]' AS key, n_name AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'f' || s_suppkey, 'comment[label]', s_name FROM supplier")
def s9(spark, sf):
    path = _folder(spark)
    s = V.table(spark, sf, "supplier").join(F.broadcast(V.table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    s.select(F.concat(F.lit("NT="), "n_name", F.lit(";AC=T:1")).alias("characteristics[organism]"), F.col("s_name").alias("comment[label]"),
             F.concat(F.lit("f"), F.col("s_suppkey").cast("string"), F.lit(".raw")).alias("comment[data file]")).write.csv(path, sep="\t", header=True)
    return I.read_sdrf(spark, path)


@query("S11_write_tagged_spectra", V.cte(p=V.Q_PEAKS, s=V.Q_SPECTRA) + "SELECT idx, charge FROM s WHERE idx IN (SELECT idx FROM p WHERE intensity > 45) AND charge > 0")
def s11(spark, sf):
    path = _folder(spark)
    tags = V.peaks(spark, sf).filter("intensity > 45").join(V.spectra(spark, sf).select(*KEY, "charge"), KEY).select(*KEY, (F.col("charge") == 0).alias("entrapment"))
    O.write_tagged_spectra(V.spectra(spark, sf), tags, path)
    return spark.read.parquet(path).select("idx", "charge")


@query("R11_export_view", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def r11(spark, sf):
    path = _folder(spark)
    ranking.export_view(V.table(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "o_orderpriority"], path, "tsv")
    return spark.read.csv(path, sep="\t", header=True, schema="o_orderkey long, o_totalprice double, o_orderpriority string")


@query("W1_stream_tags")
def w1(spark, sf):
    """Tags of the spectra, streamed from MGF files; a malformed block per file goes to the errors."""
    path = _folder(spark)
    bad = spark.range(1).select(F.lit("BEGIN IONS\nTITLE=bad\nnonsense here\nEND IONS\n").alias("value"))
    O.mgf_blocks(_layout(spark, sf)).select("value").unionAll(bad).write.text(path + "/in")
    W.stream_tags(W.mgf_stream(spark, path + "/in"), path + "/tags", path + "/errors", path + "/log", QT.PARAMS).awaitTermination()
    tags = spark.read.parquet(path + "/tags").select("run_id", "idx", "rank", "seq")
    errors = spark.read.parquet(path + "/errors").select("run_id", "idx", F.lit(0).alias("rank"), F.lit("error").alias("seq"))
    return tags.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).unionAll(errors.groupBy("seq").agg(F.count(F.lit(1)).alias("n")))
