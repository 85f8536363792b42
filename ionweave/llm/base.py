"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.session import ensure_checkpoint_dir

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated (spark, sf_dir) -> DataFrame under ``name``."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once, and safe when executors are lost."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_only(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns the operator works on, so that further columns of any name cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def by_group(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work(key, table)`` for each group of ``rows`` (which must be of bounded size): groups come in one stream per
    range partition, so a task holds one at a time. ``work`` returns an Arrow record batch."""
    import pyarrow as pa

    def run(batches):
        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            marks = list(zip(*(b[k].to_pylist() for k in keys), strict=True))
            start = 0
            for i in range(1, len(marks) + 1):
                if i == len(marks) or marks[i] != marks[start]:
                    if marks[start] != key and held:
                        yield work(key, pa.Table.from_batches(held).combine_chunks())
                        held = []
                    key = marks[start]
                    held.append(b.slice(start, i - start))
                    start = i
        if held:
            yield work(key, pa.Table.from_batches(held).combine_chunks())

    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part: those without nulls and with finite components only. Of rows
    with one vec_id the smallest vector counts."""
    own = columns_only(vectors, "vec_id", "embedding").filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.filter(finite).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
