"""Line dedup, mixing, searches and the pipeline."""
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ionweave.llm import base, curves, linededup, mixing, neardup, queries, topk
from tests.check_queries import TABLES, compare
from tests.llm.common import EDGE, edge, none, saved
from tests.llm.test_neardup import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], sf)[0] == "ok"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql_on_edges(spark, tmp_path, name):
    vectors = spark.createDataFrame([(0, [1.0, -2.0]), (50, [1.0, -2.0]), (1, [0.5, 0.25]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    path = saved(spark, tmp_path, documents=edge(spark), embeddings=vectors)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    verdict = compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], path)
    assert verdict[0] in ("ok", "EMPTY"), verdict


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(3, 13))) for _ in range(n))


def test_recurring_templates_go_and_copies_stay(spark):
    rng = np.random.default_rng(1)
    names = "Alda Bert Cleo Dora Emil Fran Gert Hans Ines Jona".split()
    bodies = ["\n".join(words(rng, 12) for _ in range(4)) for _ in range(10)]
    rows = [(k, f"{b}\nPage {k} of 10\nPosted by user {n} on the front page today\nAll rights reserved.") for k, (b, n) in enumerate(zip(bodies, names))]
    copied = "\n".join(words(rng, 12) for _ in range(5))
    rows += [(100 + k, copied) for k in range(30)]
    rows += [(200 + k, copied.replace(copied.split()[k], "edited", 1)) for k in range(12)]
    out = {r.doc_id: r for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, b in enumerate(bodies):
        assert out[k].text == b and out[k]._dropped == 3
    for d, t in rows[10:]:
        assert out[d].text == t


def test_line_edges(spark):
    rows = linededup.drop_recurring_lines(edge(spark)).select("doc_id", "text").collect()
    assert Counter(map(tuple, rows)) == Counter((d, t) for d, t, _ in EDGE)
    assert linededup.drop_recurring_lines(none(spark)).count() == 0


def test_mixing_keeps_within_a_block(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "x" * int(rng.integers(1, 60)), f"src{rng.choice(4, p=[.6, .2, .1, .1])}") for k in range(1500)]
    params = mixing.MixParams(shares={"src0": 5, "src1": 3}, default_share=2, block_chars=100)
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), params).collect()
    assert sorted(r.doc_id for r in out) == list(range(1500))
    share = {"src0": 5, "src1": 3, "src2": 2, "src3": 2}
    n, slot = {}, {}
    for r in out:
        n[r.source] = max(n.get(r.source, 0), r._block + 1)
        assert slot.setdefault(r._slot, (r.source, r._block)) == (r.source, r._block)
    total = sum(len(t) for _, t, _ in rows)
    assert abs(sum(n.values()) - total / 100) <= 4 and max(slot) < sum(n.values()) + 4
    least = min(n[s] // share[s] for s in share)                        # full rounds of all sources
    done = Counter()
    for t in range(least * 12):
        for s in share:
            assert abs(done[s] - t * share[s] / 12) < 1, (t, s)
        if t in slot:
            done[slot[t][0]] += 1
        else:                                                          # a block in which no document starts
            gaps = [s for s in share if (s, done[s]) not in slot.values()]
            done[gaps[0]] += 1


def test_mixing_edges(spark):
    out = mixing.mixed_corpus(edge(spark))
    assert out.columns == edge(spark).columns and Counter(map(tuple, out.select("doc_id", "text").collect())) == Counter((d, t) for d, t, _ in EDGE)
    assert mixing.mixed_corpus(none(spark)).count() == 0


def test_exact_top_k_by_hand(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-3, 4, (300, 6))                                   # many ties
    df = spark.createDataFrame([(int(k), [int(c) for c in x]) for k, x in enumerate(v)], "vec_id long, v array<long>")
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), topk.TopKParams(candidates=64, queries=2, stride=2)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 300, 50):
        s = v @ v[q]
        order = [k for k in np.lexsort((np.arange(300), -s)) if k != q][:5]
        assert got[q] == {i + 1: (k, s[k]) for i, k in enumerate(order)}


def test_neighbours(spark, tmp_path):
    path = "/root/testdata/sf0.01"
    rows = curves.op10_neighbours(spark, path).collect()
    e = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in e], np.float64), np.array([r.vec_id for r in e])
    want = 0
    found = {(r.query_id, r.vec_id): r.score for r in rows}
    asked = np.flatnonzero(ids % 20 == 0)
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        want += sum((ids[q], k) in found for k in ids[np.lexsort((ids, -s))[:20]])
    assert want >= 0.9 * 20 * len(asked) and len(rows) == 20 * len(asked)
    for (q, k), s in found.items():
        assert abs(s - x[ids == q][0] @ x[ids == k][0]) < 1e-12
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("inf"), 1.0]), (4, [1.0, 2.0, 3.0]), (5, [0.5, 0.5]), (None, [1.0, 1.0])],
                                "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS d", "3 AS rank", "4 AS curve")
    got = sorted(tuple(r) for r in curves.op10_neighbours(spark, saved(spark, tmp_path / "a", embeddings=odd)).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 5, 0.5), (20, 1, 0, 1.0), (20, 2, 5, 0.5)]
    nothing = saved(spark, tmp_path / "b", embeddings=odd.filter("false"))
    assert curves.op10_neighbours(spark, nothing).count() == 0 and topk.op3_exact_topk(spark, nothing).count() == 0


def test_curves_visit_neighbouring_cells():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = curves.hilbert_keys(grid, 3)
    path = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_pipeline_stages(spark, sf):
    docs = base.table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = base.written(stage(spark, docs, sf), "stage")
        if name == "packing":
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}
            assert len({r.sequence_id for r in pieces}) == -(-sum(r.length for r in pieces) // 4096)
            break
        assert out.columns == columns and not set(r.doc_id for r in out.select("doc_id").collect()) - set(r.doc_id for r in docs.select("doc_id").collect())
        if name == "near duplicates":
            want = brute(docs.select("doc_id", "text").collect(), 5, 80)
            assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, (_, c) in want.items() if d == c)
        if name in ("line dedup", "mixing"):
            assert out.count() == docs.count()
        docs = out


def test_pipeline_on_edges(spark, tmp_path):
    path = saved(spark, tmp_path, documents=edge(spark), labels=spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 9, 10, 11}


def test_packing_follows_the_order_of_the_mix(spark, tmp_path):
    """The same rows in another order give other sequences, and the sequences come out in the order of the rows."""
    rows = [(k, "alpha beta gamma " * (100 + 60 * (k % 5))) for k in range(60)]
    found = []
    for name, order in (("up", rows), ("down", rows[::-1])):
        base_ = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        base_.write.parquet(f"{tmp_path}/{name}")
        out = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/{name}"), "").collect()
        place = {d: i for i, (d, _) in enumerate(order)}
        first = {}
        for r in out:
            first[r.sequence_id] = min(first.get(r.sequence_id, 99), place[r.doc_id])
        assert list(first.values()) == sorted(first.values()) and sorted(r.doc_id for r in out) == list(range(60))
        for n in {r.length for r in out}:                                # pieces of one length are given out in the order of the mix
            same = sorted((r.sequence_id, r.offset, place[r.doc_id]) for r in out if r.length == n)
            assert len(same) == 12
        found.append({frozenset(r.doc_id for r in out if r.sequence_id == s) for s in first})
    assert len(found[0]) == len(found[1]) and found[0] != found[1]
