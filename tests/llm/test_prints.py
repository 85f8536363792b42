"""Fingerprints: contract columns against plain Python, span equality and extensions against slices, likeness against sets of spans."""
import hashlib
import random

import numpy as np
import pytest

from ionweave.llm import prints as P
from tests.llm.common import EDGE, edge, none, saved


def rows_by_hand(docs):
    """(doc_id, n_chars, sha256 of the edited text, text, edited, next) in the order of the rows."""
    docs = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (d, t) in enumerate(docs):
        follower = docs[(k + 1) % len(docs)][1]
        cut = len(t) // 3
        changed = t[:len(t) - cut] + follower[:cut]
        out.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), t, changed, follower))
    return out


def spans_by_hand(text):
    return {text[max(0, i - P.WINDOW):i] for i in range(1, len(text) + 1)}


def share(a, b):
    one, other = spans_by_hand(a), spans_by_hand(b)
    return 1.0 if a == b else 2 * len(one & other) / max(1, len(one) + len(other))


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == [w[:3] for w in want]
    prints, far = {}, []
    for r, (_, _, _, text, changed, follower) in zip(got, want, strict=True):
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and prints.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
        assert (r.common_edited, r.common_next) == (common(text, changed), common(text, follower))
        for other, near in ((changed, r.near_edited), (follower, r.near_next)):
            exact = max(len(spans_by_hand(text)), len(spans_by_hand(other))) <= P.SKETCH
            assert 0 <= near <= 1 and (not exact or near == pytest.approx(share(text, other)))
            far.append(abs(near - share(text, other)))
    assert len(set(prints.values())) == len(prints)
    return far


def test_arithmetic():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, P.PRIME, 2000, dtype=np.uint64) for _ in range(2))
    a[:2], b[:2] = P.PRIME - 1, [P.PRIME - 1, 0]
    assert P.times(a, b).tolist() == [x * y % P.PRIME for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    text = "añ\U0001F600\0b" * 9
    want, total = [0], 0
    for k, c in enumerate(text):
        total = (total + (ord(c) + 1) * pow(P.BASE, k, P.PRIME)) % P.PRIME
        want.append(total)
    assert P.prefixes(P.code_points(text)).tolist() == want


def test_spans_and_extensions():
    rng = random.Random(5)
    text = "".join(rng.choice("ab") for _ in range(300)) * 2
    prefix = P.prefixes(P.code_points(text))
    for _ in range(500):
        i, j, n = rng.randrange(600), rng.randrange(600), rng.randrange(12)
        n = min(n, 600 - i, 600 - j)
        one, other = P.spans(prefix, np.array([i, j]), np.array([i + n, j + n]))
        assert (one == other) == (text[i:i + n] == text[j:j + n])
        assert P.common_extension(prefix, i, j, 600 - max(i, j)) == common(text[i:], text[j:])


def test_likeness_comes_from_the_fingerprints():
    texts = ["", "a", "abcdefgh" * 3, "abcdefgh" * 3 + "x", "".join(map(chr, range(200, 1200))), "".join(map(chr, range(400, 1400)))]
    names, sketches, _, _ = P.prints(texts)
    for a, s in zip(names, sketches, strict=True):
        assert P.sketch_in(a).tolist() == s.tolist()
        for b, t in zip(names, sketches, strict=True):
            assert P.likeness(a, b) == P.alike(a, s, b, t) == P.likeness(b, a)
    assert P.likeness(names[0], names[0]) == 1 and P.likeness(names[0], names[1]) == 0 and P.likeness(names[4], names[5]) == pytest.approx(share(texts[4], texts[5]), abs=0.15)
    assert P.sketch_of(np.array([7] * 5000 + list(range(P.SKETCH + 9)), np.uint64)).tolist() == list(range(P.SKETCH))


def test_query_equals_plain_python(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = P.op13_fingerprints(spark, "/root/testdata/sf0.01").collect()
    far = check(got, rows_by_hand(docs))
    assert np.mean(far) < 0.03 and np.mean([r.near_edited for r in got if r.n_chars > 60]) > 0.6
    got = P.op13_fingerprints(spark, saved(spark, tmp_path, documents=edge(spark))).collect()
    check(got, rows_by_hand([(d, t) for d, t, _ in EDGE]))


def test_any_number_of_ranges_gives_the_same_rows(spark):
    docs = spark.createDataFrame([(k * 7 % 50 if k % 9 else None, f"text number {k} " * (k % 5)) for k in range(120)], "doc_id long, text string")
    want = rows_by_hand([tuple(r) for r in docs.collect()])
    for ranges in (1, 2, 7, 200):
        check(P.fingerprints(docs, ranges).collect(), want)


def test_small_tables(spark, tmp_path):
    assert not P.op13_fingerprints(spark, saved(spark, tmp_path, documents=none(spark))).collect()
    for rows in ([(5, "abcdef")], [(None, "abcdef")], [(None, None)], [(3, "abcdefghi"), (3, "abcdefghi")]):
        check(P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows_by_hand(rows))
