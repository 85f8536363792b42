"""Periodic runs against a search by hand of every period."""
import hashlib
import random
import re
import zlib

import numpy as np

from ionweave.llm import periods as P
from tests.llm.common import EDGE, edge, none, saved


def by_hand(words):
    """Every (start, end, smallest period) with an end as far as words a period apart agree, at least twice the period."""
    n, found = len(words), {}
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.array([names[w] for w in words], np.int32)
    for q in range(1, n // 2 + 1):
        same = np.flatnonzero(codes[q:] == codes[:-q])
        if len(same) >= q:
            for part in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1):
                if len(part) >= q:
                    found.setdefault((int(part[0]), int(part[-1]) + 1 + q), q)
    return sorted((s, e, q) for (s, e), q in found.items())


def row_by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted((s, e - s, q) for s, e, q in by_hand(words) if e - s >= 12)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def sequence(rng):
    """Words with periods of every kind: nested, broken and joined stretches of small period, Fibonacci words, copies."""
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.randint(0, 1) for _ in range(rng.randint(0, 80))]
    if kind == 1:
        roots = [[rng.randint(0, 2) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 6))]
        return [w for r in roots for w in (r * 40)[:rng.randint(1, 60)]]
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < rng.randint(30, 300):
            a, b = b, b + a
        return b
    if kind == 3:
        root = [rng.randint(0, 1) for _ in range(rng.randint(1, 4))]
        blocks = [(root * 60)[:rng.randint(5, 90)] for _ in range(3)]
        return [w for _ in range(5) for w in rng.choice(blocks)]
    out = [0, 1, 2]
    for _ in range(9):
        i = rng.randrange(len(out))
        out = out + out[i:i + rng.randint(1, 60)] * rng.randint(1, 3)
    return out[:400]


def test_runs_equal_a_search_of_every_period():
    rng = random.Random(11)
    for _ in range(600):
        texts, words, want = [sequence(rng) for _ in range(rng.randint(1, 4))], [], []
        for d, text in enumerate(texts):
            want += [(s + len(words), e + len(words), q) for s, e, q in by_hand(text)]
            words += [100 * d + w for w in text] + [-1 - d]
        assert sorted(map(tuple, P.runs_of(np.array(words, np.int64)).tolist())) == sorted(want)


def test_stretches_of_one_period_that_meet_make_runs():
    words = [1, 2] * 20 + [1] + [1, 2] * 20
    got = {q for _, _, q in P.runs_of(np.array(words, np.int64)).tolist()}
    assert got >= set(range(1, 40, 2)) | {2}


def test_query_equals_the_search_by_hand(spark, tmp_path):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
        got = {tuple(r) for r in P.op11_periodic_runs(spark, sf).collect()}
        assert got == {row_by_hand(d, t) for d, t in docs}
    rows = [(d, t) for d, t, _ in EDGE]
    got = P.op11_periodic_runs(spark, saved(spark, tmp_path, documents=edge(spark))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(row_by_hand(d, t)) for d, t in rows)


def test_long_text_and_repeats(spark, tmp_path):
    text = "a b c " * 40_000 + "d e"
    got = P.op11_periodic_runs(spark, saved(spark, tmp_path, documents=spark.createDataFrame([(1, text), (1, text), (1, "x " * 30)], "doc_id long, text string"))).collect()
    assert len(got) == 3 and got[0].n_runs >= 1
    assert [(r.start, r.length, r.period) for r in got if r.length == 30] == [(0, 30, 1)]
    assert sorted(r.length for r in got)[1:] == [120_000, 120_000]


def test_empty_table(spark, tmp_path):
    got = P.op11_periodic_runs(spark, saved(spark, tmp_path, documents=none(spark)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] and not got.collect()
