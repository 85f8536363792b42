"""k-mer-keyed decoys and their support rates against plain Python."""
import random
from collections import Counter

import pytest

from ionweave.operators import species as X


def test_decoys_and_rates_equal_plain_python(spark):
    rng = random.Random(91)
    prots = {f"p{k}": "".join(rng.choice("GAS") for _ in range(300)) for k in range(6)}
    tags = [(rng.randint(1, 3), "".join(rng.choice("GASI") for _ in range(rng.choice([4, 5, 5, 5, 6])))) for _ in range(200)] + [(1, "AAAAA")] * 3 + [(2, "AAAAG"), (4, "GAS")]
    taxa = {}
    for p, s in prots.items():
        for i in range(len(s) - 4):
            taxa.setdefault(s[i:i + 5], set()).add(p[-1])
    kt = X.build_kmer_taxa(spark.createDataFrame([(s, p[-1]) for p, s in prots.items()], "sequence string, taxon string"), 5)
    df = spark.createDataFrame(tags, "run_id int, seq string")
    rows = X.kmer_decoys(df, kt, 5, 4).collect()
    found = {}
    for r in rows:
        found.setdefault(r.seq, {})[r.decoy] = (r.decoy_seq, set(r.taxa))
    folded = [(run, t.replace("I", "L")) for run, t in tags]
    assert set(found) == {t for _, t in folded if len(t) == 5}
    assert found["AAAAA"] == {None: (None, set())}
    for t, own in found.items():
        for j, (d, carriers) in own.items():
            if j is not None:
                assert d not in (t, t[::-1]) and Counter(d) == Counter(t) and carriers == taxa.get(d, set())
        assert set(own) in ({None}, {1, 2, 3, 4})
    want = {}
    for run, t in folded:
        n, none, decoys, hit = want.get(run, (0, 0, 0, 0))
        mine = [c for j, (_, c) in found.get(t, {}).items() if j is not None]
        want[run] = (n + 1, none + (not mine), decoys + len(mine), hit + sum(bool(c) for c in mine))
    got = {r.run_id: r for r in X.decoy_rates(df, X.kmer_decoys(df, kt, 5, 4), 5).collect()}
    assert {k: (r.tags, r.no_decoy, r.decoys, r.supported) for k, r in got.items()} == want
    assert got[4].rate is None and all(got[k].rate == pytest.approx(w[3] / w[2]) for k, w in want.items() if w[2])
    assert any(0 < r.rate < 1 for r in got.values() if r.rate is not None)
