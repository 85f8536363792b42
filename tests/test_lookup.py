"""Database look-ups drop what no tag wants before any exchange, whatever the number of keys, and read a bucketed index in place."""
import random
import re

import pytest
from pyspark.sql import functions as F

from ionweave.operators import dbmatch as D, placement as L, species as X

LETTERS = "GASPVTCLNDQKEMHFRYW"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(61)
    prots = {f"p{k}": "".join(rng.choice(LETTERS[:7] + ("#" if k % 5 == 0 else "")) for _ in range(rng.randint(0, 120))) for k in range(40)}
    tags = {p[i:i + n] for p in prots.values() for i in range(0, len(p), 17) for n in (3, 4, 5, 9, 25, 26)} | {"".join(rng.choice(LETTERS) for _ in range(6)) for _ in range(60)}
    tags |= {t[::-1] for t in list(tags)[:40]} | {"AAAA", "GASIP", "G#AS"}
    p = spark.createDataFrame(list(prots.items()), "accession string, sequence string").withColumn("taxon", F.substring("accession", -1, 1))
    return prots, sorted(tags), p, spark.createDataFrame([(t,) for t in tags] * 2, "seq string")


def places(prots, tags):
    out = set()
    for t in tags:
        if 4 <= len(t) <= 25 and "#" not in t:
            for reverse, k in ((False, t.replace("I", "L")), (True, t.replace("I", "L")[::-1])):
                if not reverse or t != t[::-1]:
                    out |= {(t, a, m.start(), len(t), reverse) for a, p in prots.items() for m in re.finditer(f"(?={k})", p)}
    return out


@pytest.mark.parametrize("limit", [0, 10**6])
def test_places_and_matches_equal_plain_python(spark, data, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_KEYS", limit)
    prots, tags, p, df = data
    got = [tuple(r) for r in L.locate(df, p).collect()]
    assert len(got) == len(set(got)) and set(got) == places(prots, tags)
    nine = [t for t in tags if len(t) == 9]
    hits = {r.seq: r.hit for r in D.match_db(df.filter("length(seq) = 9"), D.kmers(p, 9, [])).collect()}
    whole = "|".join(prots.values())
    assert hits == {t: "none" if "#" in t else "forward" if t in whole else "reverse" if t[::-1] in whole else "none" for t in nine}


def exchanges_of(df, what):
    """Exchanges above the scan of ``what`` in the plan."""
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    scan = next(i for i, line in enumerate(text) if what in line)
    depth, above = len(text[scan]) - len(text[scan].lstrip(" :+-*")), []
    for line in reversed(text[:scan]):
        at = len(line) - len(line.lstrip(" :+-*"))
        if at < depth:
            depth = at
            above.append(line.strip(" :+-*"))
    return above


def test_database_is_pruned_before_its_exchange(spark, data, tmp_path):
    _, _, p, df = data
    p.write.parquet(f"{tmp_path}/prot")
    p = spark.read.parquet(f"{tmp_path}/prot")
    keys = df.select(F.substring("seq", 1, 5).alias("kmer"))
    for found in (L.locate(df, p), L.locate(df.filter("length(seq) = 5"), p), D.wanted_only(X.build_kmer_taxa(p, 5), keys)):
        above = exchanges_of(found, f"{tmp_path}/prot")
        assert "BroadcastHashJoin" in "".join(above)
        first = next(k for k, line in enumerate(above) if "BroadcastHashJoin" in line)
        assert not any("Exchange" in line for line in above[:first]), above


def test_bucketed_index_is_read_in_place(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_KEYS", 0)
    _, _, p, df = data
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kt = X.build_kmer_taxa(p, 5)
        X.write_kmer_taxa(kt, "kmer_taxa_test", 4, f"{tmp_path}/index")
        index = spark.table("kmer_taxa_test")
        got = X.tag_support(df, index, 5)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in X.tag_support(df, kt, 5).collect()} != set()
        pruned = D.wanted_only(index, df.select(F.substring("seq", 1, 5).alias("kmer")))
        above = exchanges_of(pruned, "kmer_taxa_test")
        assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above), above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS kmer_taxa_test")
