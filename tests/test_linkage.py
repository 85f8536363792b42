"""Complete linkage in tasks and by rounds against one best merge at a time in plain Python."""
import random

import pytest

from ionweave.operators import quality as Q


def by_hand(links, times, rt):
    """Merges the most similar allowed pair, equal ones in order, until none is left."""
    sim = {(min(a, b), max(a, b)): s for a, b, s in links}
    clusters = {n: {n} for n in times}
    span = {n: (t, t) for n, t in times.items()}
    while True:
        best = min(((-s, a, b) for (a, b), s in sim.items() if max(span[a][1], span[b][1]) - min(span[a][0], span[b][0]) <= rt), default=None)
        if best is None:
            return {n: min(c) for c in clusters.values() for n in c}
        _, a, b = best
        clusters[a] |= clusters.pop(b)
        span[a] = (min(span[a][0], span[b][0]), max(span[a][1], span[b][1]))
        old, sim = sim, {}
        for (x, y), s in old.items():
            if b not in (x, y) and a not in (x, y):
                sim[x, y] = s
        for n in clusters:
            one, two = old.get((min(a, n), max(a, n))), old.get((min(b, n), max(b, n)))
            if n != a and one is not None and two is not None:
                sim[min(a, n), max(a, n)] = min(one, two)


def graph(rng, n, degree, levels):
    times = {k: rng.uniform(0, 200) for k in range(n)}
    links = {}
    for a in range(n):
        for b in rng.sample(range(n), min(n, degree)):
            if a != b:
                links[min(a, b), max(a, b)] = rng.choice(levels) if levels else rng.uniform(0.5, 1)
    # tight groups, so that clusters grow
    for k in range(0, n - 8, 8):
        for a in range(k, k + 8):
            for b in range(a + 1, k + 8):
                links[a, b] = rng.uniform(0.9, 1)
            times[a] = times[k] + rng.uniform(0, 20)
    return times, [(a, b, s) for (a, b), s in links.items()]


def test_one_task_equals_one_merge_at_a_time():
    rng = random.Random(71)
    for _ in range(150):
        times, links = graph(rng, rng.randint(2, 40), rng.randint(1, 6), rng.choice([None, [0.8, 0.9]]))
        assert Q.linkage(links, {n: (t, t) for n, t in times.items()}, 60.0) == by_hand(links, times, 60.0)


@pytest.mark.parametrize("task_links", [100, 10**6])
def test_rounds_equal_one_merge_at_a_time(spark, task_links):
    rng = random.Random(72)
    rows, spectra, want = [], [], {}
    for run, (n, levels) in enumerate([(40, None), (24, [0.8, 0.9]), (3, None)]):
        times, links = graph(rng, n, 3, levels)
        rows += [(run, *((a, b) if rng.random() < 0.5 else (b, a)), s) for a, b, s in links]
        spectra += [(run, k, t) for k, t in times.items()] + [(run, 1000 + run, 5.0)]
        want |= {(run, k): c for k, c in by_hand(links, times, 60.0).items()} | {(run, 1000 + run): 1000 + run}
    out = Q.redundancy_clusters(spark.createDataFrame(rows, "run_id int, a int, b int, sim double"), spark.createDataFrame(spectra, "run_id int, idx int, rt double"), 60.0, task_links)
    assert {(r.run_id, r.idx): r.cluster for r in out.collect()} == want


def test_a_group_of_two_thousand_loses_no_link(spark):
    rng = random.Random(73)
    times, links = graph(rng, 2000, 2, None)
    times = {k: t / 4 for k, t in times.items()}
    out = Q.redundancy_clusters(spark.createDataFrame([(1, a, b, s) for a, b, s in links], "run_id int, a int, b int, sim double"),
                                spark.createDataFrame([(1, k, t) for k, t in times.items()], "run_id int, idx int, rt double"), 60.0)
    assert {r.idx: r.cluster for r in out.collect()} == by_hand(links, times, 60.0)


def test_no_links(spark):
    out = Q.redundancy_clusters(spark.createDataFrame([], "run_id int, a int, b int, sim double"), spark.createDataFrame([(1, 4, 0.5)], "run_id int, idx int, rt double"))
    assert [tuple(r) for r in out.collect()] == [(1, 4, 4)]
