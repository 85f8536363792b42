"""Sources interleaved at target weights by Pfair scheduling, in DataFrame operations only.

Each source is a stream of documents in a fixed shuffled order, cut into blocks of ``block_chars`` characters; a
document belongs to the block it starts in. Weights are whole shares: a round gives a source as many slots as its
share. Block j of a source with c of the round's H slots is released at floor(j * H / c) and due at
ceil((j + 1) * H / c); of the released blocks the one due first takes the slot. Every block meets its window, so at any
slot a source is less than one block away from its weight. Sources that end leave shorter rounds to the others, in
which the weights hold among these. Only rounds of different composition are scheduled, so that work depends on the
number of sources and the shares, not on the corpus; every document is placed by arithmetic and joins with these
small tables.

All documents are kept. Null sources are a source of their own, null and empty texts count as one character, equal
rows are placed one after the other. An empty table gives an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionweave.llm.base import columns_only, query, table, written


@dataclass(frozen=True)
class MixParams:
    """``shares``: slots of a source in a round; sources not named have ``default_share``."""
    shares: dict[str, int] = field(default_factory=lambda: {"src0": 12})
    default_share: int = 4
    block_chars: int = 100_000
    #: More sources than this are joined by a shuffle.
    broadcast_sources: int = 10_000


def streams(docs: DataFrame, block_chars: int) -> DataFrame:
    """Adds _key (the source, never null), _start (characters before the document in its source) and _block. The order
    of a source is split into tiles by the head of the order's hash, so a large source is no single group."""
    named = (docs.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
             .withColumn("_tile", F.substring("_order", 1, 3)))
    inside = W.partitionBy("_key", "_tile").orderBy("_order", "doc_id", "_chars").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("_key").orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    tiles = (named.groupBy("_key", "_tile").agg(F.sum("_chars").alias("_sum"))
             .select("_key", "_tile", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")))
    return (named.withColumn("_in", F.coalesce(F.sum("_chars").over(inside), F.lit(0))).join(tiles, ["_key", "_tile"])
            .withColumn("_start", F.col("_base") + F.col("_in")).withColumn("_block", F.expr(f"_start div {block_chars}"))
            .drop("_order", "_tile", "_in", "_base"))


def source_table(docs: DataFrame, params: MixParams) -> DataFrame:
    """_key, n (blocks), a (share)."""
    named = sorted(params.shares.items())
    share = F.lit(params.default_share)
    for k, v in named:
        share = F.when(F.col("_key") == f"s{k}", F.lit(v)).otherwise(share)
    return (docs.groupBy(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"))
            .agg(F.expr(f"(sum(_chars) + {params.block_chars - 1}) div {params.block_chars}").alias("n")).select("_key", "n", share.cast("long").alias("a")))


def round_kinds(sources: DataFrame) -> DataFrame:
    """_first (first round of a kind), _base (its first slot), size (slots of a round), parts (source and slots each).

    Source i takes a slots in every round before its round n div a and the rest in that round, so the composition
    changes only at the rounds n div a and n div a + 1 of the sources.
    """
    firsts = sources.select(F.explode(F.expr("array(0L, n div a, n div a + 1)")).alias("_first")).distinct()
    each = firsts.join(sources, F.col("_first") >= 0)                 # kinds x sources, both as few as the sources
    return (each.withColumn("_c", F.expr("greatest(0, least(a, n - _first * a))")).groupBy("_first")
            .agg(F.sum(F.expr("least(n, _first * a)")).alias("_base"), F.sum("_c").alias("size"),
                 F.sort_array(F.collect_list(F.when(F.col("_c") > 0, F.struct("_key", F.col("_c").alias("c"))))).alias("parts")).filter("size > 0"))


def edf(kinds: DataFrame) -> DataFrame:
    """(_first, _key, _nth, _slot): the slot within a round of each source's n-th block, earliest deadline first."""
    pick = """
      aggregate(sequence(0L, size - 1),
        named_struct('done', transform(parts, x -> 0L), 'turn', cast(array() as array<int>)),
        (s, t) -> struct(
          transform(s.done, (d, i) -> d + if(i = array_min(filter(transform(parts, (x, j) ->
              if(s.done[j] < x.c and (s.done[j] * size) div x.c <= t, struct(((s.done[j] + 1) * size + x.c - 1) div x.c as due, j as j), null)), x -> x is not null)).j, 1L, 0L)) as done,
          concat(s.turn, array(array_min(filter(transform(parts, (x, j) ->
              if(s.done[j] < x.c and (s.done[j] * size) div x.c <= t, struct(((s.done[j] + 1) * size + x.c - 1) div x.c as due, j as j), null)), x -> x is not null)).j)) as turn),
        s -> s.turn)"""
    turns = kinds.select("_first", "parts", F.posexplode(F.expr(pick)).alias("_slot", "_i"))
    return turns.select("_first", F.expr("parts[_i]._key").alias("_key"), F.col("_slot").cast("long").alias("_slot"),
                        (F.row_number().over(W.partitionBy("_first", "_i").orderBy("_slot")) - 1).cast("long").alias("_nth"))


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with _block, _slot and _start; ordered by _slot and _start they
    are the mixed corpus."""
    spark = docs.sparkSession
    own = docs if "_chars" in docs.columns else docs.withColumn("_chars", F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long"))
    sources = written(source_table(own.select("source", "_chars"), params), "sources")
    kinds = written(round_kinds(sources), "kinds")
    slots = written(edf(kinds.repartition("_first")), "slots")
    few = sources.count() <= params.broadcast_sources
    hint = F.broadcast if few else (lambda df: df)
    firsts = kinds.agg(F.collect_list(F.struct("_first", "_base", "size")).alias("_kinds"))      # twice the sources at most
    info = sources.select("_key", "a").join(firsts, F.lit(True))
    placed = (streams(own, params.block_chars).join(hint(info), "_key")
              .withColumn("_round", F.expr("_block div a")).withColumn("_nth", F.expr("_block % a"))
              .withColumn("_kind", F.expr("array_max(filter(_kinds, x -> x._first <= _round))")).withColumn("_first", F.col("_kind._first"))
              .join(hint(slots), ["_first", "_key", "_nth"])
              .withColumn("_slot", F.expr("_kind._base + (_round - _first) * _kind.size + _slot")))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns if c != "_chars"], "_block", "_slot", "_start")


def mixed_corpus(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The rows of ``docs`` in mixed order over range partitions."""
    columns = docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(columns))])          # so that no column can clash with the operator's own
    name = {c: f"c{k}" for k, c in enumerate(columns)}
    out = mix(inner.withColumns({"doc_id": F.col(name["doc_id"]), "source": F.col(name["source"]),
                                 "_chars": F.greatest(F.length(F.coalesce(name["text"], F.lit(""))), F.lit(1)).cast("long")}), params)
    return (out.repartitionByRange("_slot", "_start").sortWithinPartitions("_slot", "_start")
            .select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]))


SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, greatest(length(coalesce(text, '')), 1)::BIGINT AS chars, coalesce('s' || source, 'n') AS key,
         md5(coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
streams AS (
  SELECT *, coalesce(sum(chars) OVER (PARTITION BY key ORDER BY ord, doc_id, chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM docs),
sources AS (
  SELECT key, ((sum(chars) + 99999) // 100000)::BIGINT AS n, (CASE WHEN key = 'ssrc0' THEN 12 ELSE 4 END)::BIGINT AS a FROM docs GROUP BY key),
firsts AS (SELECT DISTINCT unnest([0, n // a, n // a + 1]) AS first FROM sources),
parts AS (
  SELECT first, key, n, a, greatest(0, least(a, n - first * a)) AS c FROM firsts, sources),
kinds AS (SELECT first, sum(least(n, first * a))::BIGINT AS base, sum(c)::BIGINT AS size FROM parts GROUP BY first HAVING sum(c) > 0),
lists AS (
  SELECT k.first, k.size, list({'key': p.key, 'c': p.c} ORDER BY p.key) AS parts FROM kinds k JOIN parts p ON p.first = k.first AND p.c > 0 GROUP BY k.first, k.size),
edf AS (
  SELECT first, size, parts, 0::BIGINT AS t, list_transform(parts, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS turn FROM lists
  UNION ALL
  SELECT first, size, parts, t + 1, list_transform(range(1, len(parts) + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (SELECT *, (list_min(list_filter(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN done[i] < parts[i].c AND (done[i] * size) // parts[i].c <= t
                    THEN ((done[i] + 1) * size + parts[i].c - 1) // parts[i].c * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000)::BIGINT AS pick
        FROM edf WHERE t < size)),
slots AS (
  SELECT first, parts[turn].key AS key, t - 1 AS slot, row_number() OVER (PARTITION BY first, turn ORDER BY t) - 1 AS nth FROM edf WHERE turn IS NOT NULL),
placed AS (
  SELECT s.*, s.start // 100000 AS block, (s.start // 100000) // q.a AS round, (s.start // 100000) % q.a AS nth,
         (SELECT max(k.first) FROM kinds k WHERE k.first <= (s.start // 100000) // q.a) AS first
  FROM streams s JOIN sources q USING (key))
SELECT p.doc_id, p.source, p.block::BIGINT AS block, (k.base + (p.round - p.first) * k.size + l.slot)::BIGINT AS slot, p.start AS source_start
FROM placed p JOIN kinds k ON k.first = p.first JOIN slots l ON l.first = p.first AND l.key = p.key AND l.nth = p.nth
"""


@query("op2_mixing", SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_only(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    chars = docs.select("doc_id", "source", F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long").alias("_chars"))
    return mix(chars).select("doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_start").alias("source_start"))
