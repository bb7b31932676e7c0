import time

import numpy as np

from lexspan.llm import hnsw

from .helpers import SF


def brute(x, ids, q, own, k=5):
    s = (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
    best = {}
    for i, v in zip(ids.tolist(), s.tolist(), strict=True):
        if i != own:
            best[i] = max(best.get(i, -2), v)
    return sorted(((-v, i) for i, v in best.items()))[:k]


def recall(rows, vectors):
    ids, x = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors], float)
    hit = total = 0
    by_query = {}
    for r in rows:
        by_query.setdefault(r.query_id, []).append(r)
    for q, found in by_query.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, len(found) + 1)) and q not in [r.vec_id for r in found]
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        want = brute(x, ids, x[ids == q][0], q)
        for r in found:
            v = x[ids == r.vec_id][0]
            assert abs(r.score - v @ x[ids == q][0] / np.linalg.norm(v) / np.linalg.norm(x[ids == q][0])) < 1e-12
        hit += len({r.vec_id for r in found} & {i for _, i in want})
        total += len(want)
    return hit / total


def test_recall_of_the_query(spark):
    rows = hnsw.op8_hnsw(spark, SF).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert len({r.query_id for r in rows}) == sum(v[0] % 50 == 0 for v in vectors)
    assert recall(rows, vectors) >= 0.9


def test_recall_over_shards_blocks_and_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.1 * rng.normal(size=(3000, 16))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hnsw.nearest(df, df.where("vec_id % 50 = 0"), shard=700, block=20).collect()
    assert recall(got, rows) >= 0.9


def test_index_is_flat_and_built_once(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2500, 24))
    x[100:140] = x[5]  # one vector under many ids
    g = hnsw.Graph.build(np.arange(2500), x)
    assert len(g.exact) == 2460 and len(g.links) >= 2 and [len(r) for r in g.links] == [(g.top >= k).sum() for k in range(len(g.links))]
    back = hnsw.Graph.from_table(g.to_table())
    for a in ("exact", "ids", "offsets", "top"):
        assert (getattr(g, a) == getattr(back, a)).all()
    assert all((a == b).all() for a, b in zip(g.links, back.links, strict=True))
    hits = back.search(x[:200], np.arange(200), 5)
    by = {}
    for q, i, _ in hits:
        by.setdefault(q, set()).add(i)
    want = {q: {i for _, i in brute(x, np.arange(2500), x[q], q)} for q in range(200)}
    assert sum(len(by[q] & want[q]) for q in want) >= 0.95 * 1000
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = hnsw.index(df, shard=800)
    assert nodes.selectExpr("explode(ids) AS i").distinct().count() == 2500 and nodes.select("shard").distinct().count() == 4


def test_insertion_grows_in_proportion():
    rng = np.random.default_rng(7)
    took = []
    for n in (3_000, 12_000):
        x = rng.normal(size=(n, 16)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        began = time.process_time()
        out = hnsw.grown(x, 8)
        took.append(time.process_time() - began)
        assert (out < n).all() and ((out >= 0).sum(axis=1) > 0).all()
    assert took[1] < 10 * took[0]


def test_odd_rows(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(0, v), (1, v), (2, v), (3, [2.0, 0.0, 4.0]), (4, None), (5, [0.0] * 3), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, []), (None, v), (50, [0.0, 1.0, 0.0]), (50, [0.0, 1.0, 0.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(df.selectExpr("*", "1 AS rank"), df.where("vec_id % 50 = 0")).collect()
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 0)[:3] == [(1, 1), (2, 2), (3, 3)]
    assert {r.vec_id for r in got if r.query_id == 50} == {0, 1, 2, 3} and not [r for r in got if r.query_id == 100]
    assert hnsw.nearest(df.limit(0), df).count() == 0
