"""Building blocks shared by all operator families.

Group columns such as ``run_id`` may be hot, so nothing here sorts a whole group in one task unless
the group's size is bounded by construction. ``ordered_scan`` splits large groups into value tiles.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ionweave.session import materialize, rewritten

#: groups with more distinct order values than this are split into tiles
TILE_ROWS = 200_000
#: tiles that hot groups are split into, at least
TILES = 256
#: parts that the rows without a value are dealt to
SPREAD = 1024


def values(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small literal table (size fixed by the program text or its parameters)."""
    return spark.createDataFrame(list(rows), schema)


def cells(lo: Column, hi: Column, width: float) -> Column:
    """Integer cells of ``width`` that the closed interval [lo, hi] touches."""
    return F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of two tables that grow with the input: both are dealt out by their keys.

    Sizes are estimated from the files, and rows that an explode makes do not count there, so without the hint a long table that
    comes from a small file would be collected by the driver and broadcast.
    """
    return left.hint("merge").join(right, list(on), how)


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Rows dealt out by key to as many tasks as a shuffle has, or more, where the rows of a task shall be about ``rows`` (counted, so
    ``df`` should be a written table). Adaptive execution merges partitions of few bytes into one task, however much is made of their
    rows; a number that is given stays."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-df.count() // rows)) if rows else tasks, *keys)


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lo: Column, hi: Column,
               value: str, width: float, how: str = "inner", small_right: bool = False) -> DataFrame:
    """Join rows of ``left`` with rows of ``right`` where right.value lies in [lo, hi] (columns of left).

    Only the intervals are exploded to cells; each right row sits in one cell, so every pair appears
    once. ``small_right`` marks lookup tables whose size the program fixes.
    """
    probe = left.withColumn("_lo", lo).withColumn("_hi", hi)
    probe = probe.filter("_lo <= _hi") if how == "inner" else probe
    build = right.withColumn("_cell", F.floor(F.col(value) / width).cast("long"))
    if small_right:
        build = F.broadcast(build)
    if how == "inner":
        probe = probe.withColumn("_cell", F.explode(cells(F.col("_lo"), F.col("_hi"), width)))
        join = probe.join(build, [*keys, "_cell"]) if small_right else keyed_join(probe, build, [*keys, "_cell"])
        out = join.filter(F.col(value).between(F.col("_lo"), F.col("_hi")))
        return out.drop("_cell", "_lo", "_hi")
    raise ValueError("range_join is an inner join; combine with a left join on the row's id for others")


@dataclass(frozen=True)
class Scan:
    """One running value: ``fn`` is sum, min or max of ``col``; reverse runs from the high end."""
    out: str
    fn: str
    col: str
    reverse: bool = False
    exclusive: bool = False


def ordered_scan(df: DataFrame, group: Sequence[str], order: str, scans: Sequence[Scan],
                 tile_rows: int | None = None, tiles: int | None = None) -> DataFrame:
    """Running sums, minima or maxima along ``order`` inside each group, for groups of any size.

    ``df`` must hold one row per (group, order). With a group of more than ``tile_rows`` rows, the rows are
    dealt out by ranges of (group, order), at least ``tiles`` and as many as hold ``tile_rows`` each; a group's
    rows in a range are a tile. The scan runs inside the tiles and the tile totals are scanned above them.
    The tiles are materialised, so both levels see the same ones.
    """
    tile_rows = TILE_ROWS if tile_rows is None else tile_rows
    tiles = TILES if tiles is None else tiles
    group = list(group)
    base = materialize(df)
    largest, rows = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    if (largest or 0) <= tile_rows:
        def frame(s: Scan):
            w = W.partitionBy(*group).orderBy(F.desc(order) if s.reverse else F.asc(order))
            return w.rowsBetween(W.unboundedPreceding, -1 if s.exclusive else 0)
        plain = [getattr(F, s.fn)(s.col).over(frame(s)) for s in scans]
        return base.select(*df.columns, *[
            (F.coalesce(v, F.lit(0)) if s.fn == "sum" else v).alias(s.out) for s, v in zip(scans, plain)])
    ranged = base.repartitionByRange(max(tiles, -(-rows // tile_rows)), *group, order)
    tiled = materialize(ranged.withColumn("_tile", F.spark_partition_id()))
    totals, applied = [], []
    for i, s in enumerate(scans):
        totals.append(getattr(F, s.fn)(s.col).alias(f"_t{i}"))
    tot = tiled.groupBy(*group, "_tile").agg(*totals)
    up = W.partitionBy(*group).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*group).orderBy("_tile").rowsBetween(1, W.unboundedFollowing)
    tot = tot.select(*group, "_tile", *[
        getattr(F, s.fn)(f"_t{i}").over(down if s.reverse else up).alias(f"_c{i}") for i, s in enumerate(scans)])
    # a group may be NULL
    t, c = tiled.alias("t"), tot.alias("c")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*group, "_tile"]]
    out = t.join(c, same).select("t.*", *[f"c._c{i}" for i in range(len(scans))])
    here = W.partitionBy(*group, "_tile").orderBy(order)
    back = W.partitionBy(*group, "_tile").orderBy(F.desc(order))
    for i, s in enumerate(scans):
        # frames that end at the row are extended row by row; ones that begin there are summed anew for every row
        w = (back if s.reverse else here).rowsBetween(W.unboundedPreceding, -1 if s.exclusive else 0)
        local = getattr(F, s.fn)(s.col).over(w)
        carry = F.col(f"_c{i}")
        if s.fn == "sum":
            val = F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif s.fn == "min":
            val = F.least(local, carry)
        else:
            val = F.greatest(local, carry)
        applied.append(val.alias(s.out))
    kept = [c for c in df.columns]
    return out.select(*kept, *applied)


def value_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Per (group, value): ``n`` ties, ``below`` rows strictly smaller, ``above`` rows strictly larger."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return ordered_scan(counts, group, value, [
        Scan("below", "sum", "n", exclusive=True), Scan("above", "sum", "n", reverse=True, exclusive=True)])


def join_values(df: DataFrame, per_value: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Left join of rows with a table per (group, value), dealt out by all of the key: tables that come out of a window are
    partitioned by group, and the rows would follow. Rows without a value, which meet none, are dealt out evenly."""
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    part = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(SPREAD))
    keys = [*on, "_part"]
    rows = df.withColumn("_part", F.when(F.col(value).isNull(), part(*plain)).otherwise(part(value)))
    return rows.join(per_value.withColumn("_part", part(value)).repartition(*keys), keys, "left").drop("_part")


def mid_rank(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the average rank (1 = smallest) of ``value`` inside its group; ties share it."""
    r = value_ranks(df.filter(F.col(value).isNotNull()), group, value)
    r = r.select(*group, value, (F.col("below") + (F.col("n") + 1) / 2).alias(out))
    return join_values(df, r, [*group, value], value)


def bh_qvalues(df: DataFrame, group: Sequence[str], p: str, out: str = "qvalue") -> DataFrame:
    """Benjamini-Hochberg q-values inside each group (rows with NULL p are not tested)."""
    sizes = df.filter(F.col(p).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("_m"))
    r = value_ranks(df.filter(F.col(p).isNotNull()), group, p).join(sizes, list(group))
    r = r.withColumn("_raw", F.col(p) * F.col("_m") / (F.col("below") + F.col("n")))
    r = ordered_scan(r.select(*group, p, "_raw"), group, p, [Scan(out, "min", "_raw", reverse=True)])
    return join_values(df, r.select(*group, p, F.least(F.col(out), F.lit(1.0)).alias(out)), [*group, p], p)


def islands(df: DataFrame, group: Sequence[str], order: str, gap: Column | float, out: str = "island") -> DataFrame:
    """Numbers maximal stretches of rows whose neighbours along ``order`` are at most ``gap`` apart.

    For tables of distinct bins or keys per group, whose count the value range bounds.
    """
    w = W.partitionBy(*group).orderBy(order)
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    start = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return (df.withColumn("_s", start)
            .withColumn(out, F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s"))


def interval_union(df: DataFrame, group: Sequence[str], lo: str, hi: str, out: str = "covered") -> DataFrame:
    """Length of the union of [lo, hi] per group.

    Intervals are first reduced to the farthest end per start; the running end is an ``ordered_scan``,
    so a hot group is split.
    """
    ends = df.groupBy(*group, lo).agg(F.max(hi).alias("_hi"))
    run = ordered_scan(ends, group, lo, [Scan("_reach", "max", "_hi", exclusive=True)])
    fresh = F.greatest(F.col("_hi"), F.coalesce(F.col("_reach"), F.col(lo))) - F.greatest(
        F.col(lo), F.coalesce(F.col("_reach"), F.col(lo)))
    return run.groupBy(*group).agg(F.sum(F.greatest(fresh, F.lit(0.0))).alias(out))


def lookback(df: DataFrame, group: Sequence[str], order: str, flag: Column, out: str,
             tile_width: int = 100_000) -> DataFrame:
    """As-of: the largest ``order`` value at or before each row whose ``flag`` holds, or NULL.

    ``order`` is an integer scan number. Scans are cut into tiles of ``tile_width`` numbers; each tile
    needs only the last flagged scan of the tiles before it, so a long run is spread over many tasks.
    """
    t = df.withColumn("_tile", F.floor(F.col(order) / tile_width)).withColumn("_f", F.when(flag, F.col(order)))
    last = t.groupBy(*group, "_tile").agg(F.max("_f").alias("_m"))
    last = last.withColumn("_prev", F.max("_m").over(
        W.partitionBy(*group).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1))).drop("_m")
    w = W.partitionBy(*group, "_tile").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (t.join(last, [*group, "_tile"])
            .withColumn(out, F.coalesce(F.max("_f").over(w), F.col("_prev"))).drop("_tile", "_f", "_prev"))


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): smallest label reachable over undirected edges (a, b).

    Every round each node, and the node it points to as well, take the smallest label that a neighbour's label points to, and
    labels are jumped over. As whole trees are hooked, rounds grow with the logarithm of the component's size and not with its
    diameter, up to the fixed point. Labels are pre-aggregated before the shuffle and written below the checkpoint folder.
    """
    both = rewritten(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                     .filter("a <> b").distinct())
    labels = rewritten(nodes.select("node", F.col("node").alias("component")))
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        far = rewritten(keyed_join(labels, up, ["component"]).select("node", "component", "_up"))
        near = keyed_join(both, far.select(F.col("node").alias("b"), "_up"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("_up").alias("_near"))
        step = keyed_join(far, near, ["node"], "left")
        own = step.select("node", F.col("component").alias("_old"), F.least("component", "_up", "_near").alias("component"))
        hook = step.filter("_near < component").groupBy(F.col("component").alias("node")).agg(F.min("_near").alias("_hook"))
        nxt = rewritten(keyed_join(own, hook, ["node"], "left").select("node", F.least("component", "_hook").alias("component"), "_old"))
        changed = nxt.filter(F.col("component") != F.col("_old")).limit(1).count()
        labels = nxt.select("node", "component")
        if not changed:
            return labels


def even_hash(*cols, seed: int) -> Column:
    """Uniform double in [0, 1) from a hash of the columns: reproducible on any partitioning."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
