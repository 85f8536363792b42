"""Matching tags with sequence databases, chance rates and q-values."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ionweave.functions import constants as K, scalar as S
from ionweave.operators.core import Scan, ordered_scan, values
from ionweave.session import materialize

# Effective alphabet of a proteome and the longest indexed tag.
EFFECTIVE_ALPHABET = 14.7
MAX_LENGTH = 25


def kmers(proteins: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """Every k-mer without an ambiguity code, one row per position, with the ``keep`` columns and ``pos``.

    One linear pass of an overlapping pattern per sequence; positions are 1-based.
    """
    grams = F.regexp_extract_all("sequence", F.lit(f"(?=(.{{{k}}}))"), F.lit(1))
    p = proteins.select(*keep, F.posexplode(grams).alias("_p", "kmer"))
    return p.filter(~F.contains("kmer", F.lit("#"))).select(*keep, (F.col("_p") + 1).alias("pos"), "kmer")


def db_kmers(proteins: DataFrame, k_min: int, k_max: int) -> DataFrame:
    """(k, kmer): distinct k-mers per length, reduced map-side before the shuffle."""
    out = None
    for k in range(k_min, k_max + 1):
        part = kmers(proteins, k, []).select(F.lit(k).alias("k"), "kmer").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def collapse_rules(spark, tol: float, fixed: dict[str, float] | None = None) -> DataFrame:
    """(one, a, b): residues whose mass equals an ordered pair of others within ``tol``."""
    r = values(spark, K.residue_rows(fixed), "residue string, mass double")
    one = r.select(F.col("residue").alias("one"), F.col("mass").alias("m1"))
    a = r.select(F.col("residue").alias("a"), F.col("mass").alias("ma"))
    b = r.select(F.col("residue").alias("b"), F.col("mass").alias("mb"))
    # 19-letter alphabet: theta joins of a fixed table
    return (one.join(F.broadcast(a), F.col("ma") < F.col("m1") + tol)
            .join(F.broadcast(b), F.abs(F.col("m1") - F.col("ma") - F.col("mb")) <= tol).select("one", "a", "b"))


def readings(tags: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``reading``: the tag itself and each tag with one residue spelled as its pair."""
    hit = tags.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("seq"))))
    hit = hit.withColumn("one", F.expr("substring(seq, _i, 1)")).join(F.broadcast(rules), "one")
    hit = hit.withColumn("reading", F.expr("concat(substring(seq, 1, _i - 1), a, b, substring(seq, _i + 1))"))
    return tags.withColumn("reading", F.col("seq")).unionByName(hit.select(*tags.columns, "reading")).distinct()


#: Look-up keys that are sent to the database's rows; above it the rows go to the keys. A key has 25 letters at most.
BROADCAST_KEYS = 1_000_000


def wanted_only(rows: DataFrame, keys: DataFrame, key: str | list[str] = "kmer", limit: int | None = None) -> DataFrame:
    """The rows whose ``key`` is among ``keys``. Up to ``limit`` keys, by count, are sent to the rows, so the rest of a database is
    dropped where it is read, before any exchange; of a table bucketed by the key nothing is exchanged either way."""
    limit = BROADCAST_KEYS if limit is None else limit
    keys = materialize(keys.select(key).distinct())
    return rows.join(F.broadcast(keys) if keys.count() <= limit else keys, key, "left_semi")


def match_db(tags: DataFrame, kmer_set: DataFrame, both: bool = True, rules: DataFrame | None = None) -> DataFrame:
    """Adds ``hit``: forward, reverse or none. ``kmer_set`` holds the k-mers of the tags' lengths, repeated or not.

    Distinct sequences are matched once and joined back, so a sequence repeated in a third of the tags
    is looked up a single time.
    """
    seqs = tags.select("seq").distinct()
    base = seqs.withColumn("reading", F.col("seq")) if rules is None else readings(seqs, rules)
    look = base.select("seq", F.translate("reading", "I", "L").alias("kmer"), F.lit(0).alias("o"))
    if both:
        look = look.unionByName(look.select("seq", F.reverse("kmer").alias("kmer"), F.lit(1).alias("o")))
    look = materialize(look.distinct())
    there = wanted_only(kmer_set.select("kmer"), look).distinct()
    found = look.join(there, "kmer", "left_semi").groupBy("seq").agg(F.min("o").alias("o"))
    return tags.join(found, "seq", "left").withColumn(
        "hit", F.when(F.col("o") == 0, "forward").when(F.col("o") == 1, "reverse").otherwise("none")).drop("o")


def min_filter_length(residues, both: bool = True):
    """Smallest k whose chance rate stays below 5 % for a database of that many residues."""
    c = 2.0 if both else 1.0
    k = F.ceil(F.ln(20.0 * c * residues) / F.lit(2.6878474937846906))
    return F.when(residues <= 0, 1).otherwise(F.greatest(F.lit(1), F.least(k, F.lit(MAX_LENGTH)))).cast("int")


def chance_table(matched: DataFrame, residues: int | DataFrame, both: bool = True) -> DataFrame:
    """Per run and length: tags, matched, expected by chance, enrichment, at_chance."""
    c = 2.0 if both else 1.0
    t = matched.groupBy("run_id", F.length("seq").alias("k")).agg(
        F.count(F.lit(1)).alias("tags"), F.count_if(F.col("hit") != "none").alias("matched"))
    n = F.lit(float(residues)) if isinstance(residues, (int, float)) else F.col("residues")
    if not isinstance(residues, (int, float)):
        t = t.join(F.broadcast(residues))   # one-row total
    rate = 1 - F.exp(-c * n / F.pow(F.lit(EFFECTIVE_ALPHABET), F.col("k")))
    t = t.withColumn("expected", F.col("tags") * rate)
    return t.select("run_id", "k", "tags", "matched", "expected",
                    F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).alias("enrichment"),
                    (F.col("matched") <= 2 * F.col("expected")).alias("at_chance"))


def qvalues(targets: DataFrame, decoys: DataFrame, group: list[str] = ["run_id"]) -> DataFrame:
    """(group, evalue, qvalue): monotone weighted decoy share at every target E-value.

    Events are counted per distinct E-value first; running sums and the right-to-left minimum are tiled.
    """
    ev = targets.select(*group, "evalue", F.lit(1.0).alias("t"), F.lit(0.0).alias("d")).unionByName(
        decoys.select(*group, "evalue", F.lit(0.0).alias("t"), F.col("weight").cast("double").alias("d")))
    ev = ev.groupBy(*group, "evalue").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    c = ordered_scan(ev, group, "evalue", [Scan("tt", "sum", "t"), Scan("dd", "sum", "d")])
    c = c.filter("t > 0").withColumn("fdr", F.col("dd") / F.col("tt"))
    q = ordered_scan(c.select(*group, "evalue", "fdr"), group, "evalue", [Scan("qvalue", "min", "fdr", reverse=True)])
    return q.select(*group, "evalue", F.least(F.col("qvalue"), F.lit(1.0)).alias("qvalue"))


def entrapment_weights(target: DataFrame, entrap: DataFrame) -> DataFrame:
    """(k, weight): 1/r per length, r = k-mers only in the entrapment set per target k-mer."""
    only = entrap.join(target, ["k", "kmer"], "left_anti").groupBy("k").agg(F.count(F.lit(1)).alias("e"))
    t = target.groupBy("k").agg(F.count(F.lit(1)).alias("t"))
    return only.join(t, "k").select("k", (F.col("t") / F.col("e")).alias("weight"))


def entrapment_q(tags: DataFrame, target: DataFrame, entrap: DataFrame, both: bool = False) -> DataFrame:
    """Tags of the target set with their q-value; a tag found in both sets counts as target.

    ``target`` and ``entrap`` are distinct (k, kmer) tables.
    """
    m = match_db(tags, target, both).withColumnRenamed("hit", "t_hit")
    m = match_db(m, entrap, both).withColumn("k", F.length("seq"))
    hits = m.filter("t_hit <> 'none'")
    traps = m.filter("t_hit = 'none' AND hit <> 'none'").join(F.broadcast(entrapment_weights(target, entrap)), "k")
    q = qvalues(hits, traps)
    return hits.join(q, ["run_id", "evalue"]).drop("t_hit", "hit", "k")


def target_decoy_q(psms: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """(group, score, qvalue): (decoys + 1)/targets from the best score down, equal scores together."""
    c = psms.groupBy(*group, score).agg(F.count_if(F.col("is_decoy")).alias("d"), F.count_if(~F.col("is_decoy")).alias("t"))
    r = ordered_scan(c, group, score, [Scan("dd", "sum", "d", reverse=True), Scan("tt", "sum", "t", reverse=True)])
    r = r.withColumn("fdr", (F.col("dd") + 1) / F.greatest(F.col("tt"), F.lit(1)))
    q = ordered_scan(r.select(*group, score, "fdr"), group, score, [Scan("qvalue", "min", "fdr")])
    return q.select(*group, score, F.least(F.col("qvalue"), F.lit(1.0)).alias("qvalue"))


def subset_q(psms: DataFrame, ids: DataFrame, key: str, group: list[str], score: str = "score") -> DataFrame:
    """Target-decoy q-values recomputed inside a subset of spectra."""
    return target_decoy_q(psms.join(ids.select(key).distinct(), key, "left_semi"), group, score)
