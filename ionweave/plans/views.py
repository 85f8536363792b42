"""Derived inputs: how the given tables stand in for spectra, proteins, tags and scans.

Each view is one list of SQL expressions that Spark and the checking SQL share.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionweave.functions import scalar as S

PEAKS = ["l_partkey % 4 AS run_id", "l_partkey AS idx", "100 + l_extendedprice % 900 AS mz", "l_quantity AS intensity"]
SPECTRA = ["p_partkey % 4 AS run_id", "p_partkey AS idx", "400 + p_retailprice % 600 AS precursor_mz",
           "p_size % 5 AS charge", "p_partkey * 0.5E0 AS rt", "p_type AS analyzer", "p_brand AS activation",
           "p_name AS spectrum"]
SCANS = ["user_id AS run_id", "event_id AS idx", "ts", "round(value) AS mz", "event_type AS status", "value"]
EVIDENCE = ["l_orderkey % 4 AS run_id", "l_orderkey AS spectrum", "l_suppkey AS protein", "l_discount AS evalue",
            "l_linenumber AS win", "l_returnflag = 'N' AS exact"]
DELTAS = ["l_orderkey % 4 AS run_id", "l_orderkey AS spectrum", "l_tax * 100 + l_discount AS delta",
          "l_returnflag AS interp", "l_linestatus AS site"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def peaks(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*PEAKS)


def spectra(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*SPECTRA)


def scans(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*SCANS)


def evidence(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*EVIDENCE)


def deltas(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*DELTAS)


def proteins(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("accession"), S.fold_residues("text").alias("sequence"),
                    F.col("source").alias("taxon"), F.col("lang").alias("genus"))


def db_tags(spark, sf, n: int = 7) -> DataFrame:
    """Length-n substrings of the benchmark passages, with a deterministic E-value."""
    t = table(spark, sf, "benchmark").select("item_id", S.fold_residues("text").alias("s")).filter(F.length("s") >= n)
    t = t.select("item_id", "s", F.explode(F.sequence(F.lit(1), F.length("s") - n + 1)).alias("pos"))
    return t.select((F.col("item_id") % 4).alias("run_id"), F.col("item_id").alias("idx"), "pos",
                    F.expr(f"substring(s, pos, {n})").alias("seq"),
                    ((F.col("item_id") * 31 + F.col("pos") * 17) % 1000 / F.lit(1000.0)).alias("evalue"))


def psms(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang")
    return table(spark, sf, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("key"), F.col("source").alias("run"), "lang", F.col("n_chars").cast("double").alias("score"),
        (F.col("toxic") == 1).alias("is_decoy"), (F.col("quality") == 1).alias("label"))


# ---------------------------------------------------------------- the same views for the checking SQL
FOLD = "translate(upper(regexp_replace({0}, '[^A-Za-z]', '', 'g')), 'IXBZJUO', 'L######')"


def cte(**parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + " "


Q_PEAKS = f"SELECT {', '.join(PEAKS)} FROM lineitem"
Q_SPECTRA = f"SELECT {', '.join(SPECTRA)} FROM part"
Q_SCANS = f"SELECT {', '.join(SCANS)} FROM events"
Q_EVIDENCE = f"SELECT {', '.join(EVIDENCE)} FROM lineitem"
Q_DELTAS = f"SELECT {', '.join(DELTAS)} FROM lineitem"
Q_PROTEINS = f"SELECT doc_id AS accession, {FOLD.format('text')} AS sequence, source AS taxon, lang AS genus FROM documents"


def q_db_tags(n: int = 7) -> str:
    return (f"SELECT item_id % 4 AS run_id, item_id AS idx, pos, substr(s, pos, {n}) AS seq, "
            f"((item_id * 31 + pos * 17) % 1000) / 1000.0 AS evalue FROM (SELECT item_id, s, "
            f"unnest(range(1, length(s) - {n} + 2)) AS pos FROM (SELECT item_id, {FOLD.format('text')} AS s FROM benchmark) "
            f"WHERE length(s) >= {n})")


Q_PSMS = ("SELECT l.doc_id AS key, d.source AS run, d.lang, CAST(d.n_chars AS DOUBLE) AS score, l.toxic = 1 AS is_decoy, "
          "l.quality = 1 AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id")


def literal(rows, cols: str) -> str:
    """A VALUES table for the checking SQL."""
    def cell(x):
        if x is None:
            return "NULL"
        return repr(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({cols})"
