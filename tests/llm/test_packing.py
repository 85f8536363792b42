import random
from collections import Counter

import numpy as np
import zlib
from tokenizers import Tokenizer

from ionweave.llm import packing as P
from ionweave.llm.tokens import default_tokenizer
from tests.llm.common import EDGE, edge, none, saved


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def rec(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                rec(i + 1, bins)
                bins[k] -= items[i]
        rec(i + 1, [*bins, items[i]])
    rec(0, [])
    return best[0]


def test_small_sets_are_packed_optimally():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([20, 50, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 11))]
        plan = P.pack(dict(Counter(items)), capacity, 2000)
        assert Counter(s for p, t in plan for s in p for _ in range(t)) == Counter(items)
        assert all(sum(p) <= capacity for p, _ in plan) and sum(t for _, t in plan) == fewest(items, capacity)


def test_large_counts_take_few_steps():
    counts = {s: 10 ** 9 for s in range(1, 4097)}
    plan = P.pack(counts, 4096, 100)
    total = sum(s * n for s, n in counts.items())
    assert len(plan) <= 2 * 4096 and sum(t for _, t in plan) <= 1.001 * total / 4096


def test_search_at_every_size(caplog):
    counts = {2223: 1384, 719: 1127, 873: 1649, 1423: 1477, 1486: 443, 1689: 1878, 2575: 905, 2781: 926}
    first = sum(t for _, t in P.completion(counts, 4096))
    plan = P.pack(counts, 4096, 2000)
    total = Counter()
    for p, t in plan:
        assert sum(p) <= 4096
        total.update({s: n * t for s, n in Counter(p).items()})
    assert total == Counter(counts) and 500 < sum(t for _, t in plan) < first and "lower bound 3947" in caplog.text


def test_lower_bound(caplog):
    rng = random.Random(8)
    for _ in range(60):
        capacity = rng.choice([20, 21, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 10))]
        hist = np.bincount(items, minlength=capacity + 1).astype(np.int64)
        assert -(-sum(items) // capacity) <= P.lower_bound(hist) <= fewest(items, capacity)
    plan = P.pack({3000: 100_000, 2100: 50_000, 900: 1000}, 4096, 2000)     # the sum bound is below, the lengths above half are not
    assert sum(t for _, t in plan) == 150_000 and not caplog.text


def test_query_on_edges(spark, tmp_path):
    rows = P.op7_packing(spark, saved(spark, tmp_path, documents=edge(spark))).collect()
    tok = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for d, t, _ in EDGE:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want[(d, k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r.length for r in rows) // 4096)


def test_ranks_are_salted(spark):
    rows = P.pack_documents(edge(spark), P.PackParams(rank_rows=2)).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_no_documents(spark, tmp_path):
    assert P.op7_packing(spark, saved(spark, tmp_path, documents=none(spark))).count() == 0
