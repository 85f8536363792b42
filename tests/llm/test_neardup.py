import re
from collections import Counter, defaultdict

import numpy as np

from ionweave.llm import neardup as N
from tests.llm.common import EDGE, edge, none, saved


def brute(rows, words, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d
    for d, s in sets.items():
        for e, both in Counter(e for g in s for e in holders[g] if e < d).items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 50, 3000):
        s = N.sketch(np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)), 128)
        assert len(s) == 128 and (s != np.iinfo(np.uint64).max).all()
    a = np.unique(rng.integers(0, 1 << 62, 2000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:1800], rng.integers(0, 1 << 62, 200).astype(np.uint64)]))
    agree = np.mean(N.sketch(a, 4096) == N.sketch(b, 4096))
    assert abs(agree - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.04


def test_band_width_follows_the_threshold():
    for words, percent in ((3, 85), (5, 80), (5, 50)):
        p = N.NearDupParams(words=words, percent=percent)
        assert (1 - (percent / 100) ** p.width) ** (p.coordinates // p.width) <= p.miss or p.width == 1


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.op4_near_duplicates(spark, path).collect()}
    want = brute(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect(), 3, 85)
    assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}


def test_chains_and_large_families(spark):
    """A family in which every text differs: links run along chains, most pairs are not linked."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    rows, now = [], list(words)
    for d in range(240):
        rows.append((d, " ".join(now)))
        now = list(now)
        for k in rng.integers(0, 300, 4 if d % 6 else 30):
            now[k] = f"x{d}_{k}"
        if d % 40 == 39:
            now = list(words)
            now[d] = "y"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs, N.NearDupParams(words=3, percent=85, block=16)).collect()}
    assert got == brute(rows, 3, 85)


def test_edges(spark, tmp_path):
    rows = N.op4_near_duplicates(spark, saved(spark, tmp_path, documents=edge(spark))).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(EDGE)
    assert [got[d].n_shingles for d in (2, 3, 4, 9)] == [0, 0, 0, 1]
    assert [got[d].component_id for d in (6, 7, 8, 2, 3, 9)] == [6, 6, 6, 2, 3, 9]
    assert not got[7].kept and got[6].kept and got[None].component_id is None and got[None].kept


def test_no_documents(spark, tmp_path):
    assert N.op4_near_duplicates(spark, saved(spark, tmp_path, documents=none(spark))).count() == 0
