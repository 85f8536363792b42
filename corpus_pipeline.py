"""A training corpus from raw documents: reject toxic texts, drop recurring lines, keep one of each group of near copies,
interleave the sources by their target weights, pack token sequences."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm import base, linededup, mixing, neardup, packing, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below one half; the model learns from the labelled rows of the raw table."""
    model = toxicity.fit_on_labels(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns, "_toxicity of stage").filter("`_toxicity of stage` < 0.5").drop("_toxicity of stage")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates, and n_chars to match."""
    out = linededup.drop_recurring_lines(docs, lines="_lines of stage", dropped="_dropped of stage")
    changed = F.when(F.col("_dropped of stage") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies. Rows that share a doc_id stay together."""
    marks = neardup.near_duplicates(docs)
    gone = marks.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix over the written files."""
    return mixing.mixed_corpus(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its sequence and place. Pieces take their places in the order of the mix, which is that of the
    files that the stage before wrote and of the rows in them, and the sequences come out in that order."""
    at = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return packing.pack_documents(at, order=("_file", "_row"))


STAGES = [("toxicity", reject_toxic), ("line dedup", drop_lines), ("near duplicates", keep_one_of_copies), ("mixing", mix_sources), ("packing", pack)]

#: SQL has no tokenizer and no training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over the documents; each stage's rows are written and read again."""
    docs = base.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = base.written(docs, name.replace(" ", "-"))
    return docs
