"""Ranking, de-duplication, top-k, merging and result views of tags."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ionweave.operators.core import value_ranks

KEY = ["run_id", "idx"]
ORDER = ["evalue", "seq", "low_mz", "charge", "nterm_mass", "cterm_mass"]


def rank_tags(tags: DataFrame) -> DataFrame:
    """``rank`` per spectrum by E-value, sequence, low m/z and the remaining reported fields."""
    return tags.withColumn("rank", F.row_number().over(W.partitionBy(*KEY).orderBy(*ORDER)))


def dedupe_tags(tags: DataFrame) -> DataFrame:
    """First in rank of tags with the same sequence, charge and flanks."""
    w = W.partitionBy(*KEY, "seq", "charge", "nterm_mass", "cterm_mass").orderBy("evalue", "low_mz")
    return tags.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def top_tags(tags: DataFrame, max_tags: int) -> DataFrame:
    """Best ``max_tags`` per spectrum (0 = all), with their rank; pruned map-side."""
    ranked = rank_tags(tags)
    return ranked.filter(F.col("rank") <= max_tags) if max_tags > 0 else ranked


def diversify(tags: DataFrame, max_tags: int) -> DataFrame:
    """Near-duplicates (same charge, four or more peaks, all but one shared) wait behind other tags.

    The fold looks at candidates in rank order until ``max_tags`` are kept and backfills from the
    deferred ones in order; output is ranked again by E-value.
    """
    cols = tags.columns
    item = F.struct(*[F.col(c) for c in ORDER], *[F.col(c) for c in cols if c not in (*KEY, *ORDER)])
    per = tags.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("all"))
    per = per.withColumn("n", F.size("all"))
    ids = "array<int>"
    start = F.struct(F.array().cast(ids).alias("kept"), F.array().cast(ids).alias("late"))
    def step(acc, i):
        c = F.element_at("all", i)
        def near(j):
            o = F.element_at("all", j)
            small = F.least(F.size(o.peaks), F.size(c.peaks))
            return (o.charge == c.charge) & (small >= 4) & (F.size(F.array_intersect(o.peaks, c.peaks)) >= small - 1)
        dup = F.exists(acc.kept, near)
        full = F.size(acc.kept) >= max_tags
        keep = ~dup & ~full
        return F.struct(
            F.when(keep, F.concat(acc.kept, F.array(i))).otherwise(acc.kept).alias("kept"),
            F.when(~keep & ~full & (F.size(acc.late) < max_tags), F.concat(acc.late, F.array(i))).otherwise(acc.late).alias("late"))
    pick = F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step)
    per = per.withColumn("_p", pick).withColumn(
        "_i", F.slice(F.concat("_p.kept", "_p.late"), 1, max_tags))
    out = per.select(*KEY, F.explode(F.transform("_i", lambda i: F.element_at("all", i))).alias("t")).select(*KEY, "t.*")
    return rank_tags(out.select(*cols))


def merge_lengths(tags: DataFrame) -> DataFrame:
    """A tag seen at several seed lengths stays at the length of its best E-value, ties to the shorter."""
    w = W.partitionBy(*KEY, "seq", "charge", "nterm_mass", "cterm_mass", "gapped").orderBy("evalue", "seed_length")
    best = F.first("seed_length").over(w)
    return tags.withColumn("_b", best).filter("seed_length = _b").drop("_b")


def merge_series(by: DataFrame, cz: DataFrame, cap: int = 0) -> DataFrame:
    """Union of two readings ordered by E-value, b/y first on ties, at most ``cap`` per spectrum."""
    u = by.withColumn("_s", F.lit(0)).unionByName(cz.withColumn("_s", F.lit(1)))
    w = W.partitionBy(*KEY).orderBy("evalue", "_s", *[c for c in ("rank", "seq", "low_mz") if c in by.columns])
    u = u.withColumn("merged_rank", F.row_number().over(w)).drop("_s")
    return u.filter(F.col("merged_rank") <= cap) if cap > 0 else u


def merge_hypotheses(tags: DataFrame, n_hypotheses: DataFrame | None, cap: int) -> DataFrame:
    """Rows of all precursor hypotheses by corrected E-value, the first hypothesis first on ties. Without ``n_hypotheses`` the
    E-values are corrected already."""
    t = tags if n_hypotheses is None else tags.join(n_hypotheses, KEY).withColumn("evalue", F.col("evalue") * F.col("n_hyp"))
    w = W.partitionBy(*KEY).orderBy("evalue", "hypothesis", "seq", "low_mz")
    t = t.withColumn("merged_rank", F.row_number().over(w))
    return t.filter(F.col("merged_rank") <= cap) if cap > 0 else t


def sort_view(df: DataFrame, col: str, desc: bool = False, numeric: bool = True) -> DataFrame:
    """Numeric order with unparsable cells last in both directions, else bytewise."""
    c = F.col(col).try_cast("double") if numeric else F.col(col)
    return df.orderBy(c.desc_nulls_last() if desc else c.asc_nulls_last())


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """``limit`` rows of the ordered view from ``offset`` on (a top-k report)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def row_position(df: DataFrame, value: str) -> DataFrame:
    """0-based position of each distinct sort value in the view, over tables of any size."""
    one = df.select(F.lit(0).alias("_g"), value)
    r = value_ranks(one, ["_g"], value)
    return r.select(value, F.col("below").alias("position"), "n")


def per_spectrum_top(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The ``n`` best rows of each spectrum."""
    return (df.withColumn("_r", F.row_number().over(W.partitionBy(*KEY).orderBy(*order)))
            .filter(F.col("_r") <= n).drop("_r"))


def export_view(df: DataFrame, columns: list[str], path: str, fmt: str = "csv") -> None:
    """Writes the chosen columns as comma or tab separated text or Parquet, one file per partition."""
    out = df.select(*columns)
    if fmt == "parquet":
        out.write.mode("overwrite").parquet(path)
    else:
        out.write.mode("overwrite").csv(path, header=True, sep="\t" if fmt == "tsv" else ",")
