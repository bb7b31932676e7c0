import zlib

import numpy as np

from lexspan.llm import quality_model, toxicity

from .helpers import odd_documents


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def held_out(spark, query, column, sf="/root/testdata/sf0.01"):
    rows = {r.doc_id: r for r in query(spark, sf).collect()}
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = held_out(spark, quality_model.op5_quality_gam, "quality")
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    test = [(labels[d], r.score) for d, r in rows.items() if r.held_out and d in labels]
    assert auc(*map(np.array, zip(*test, strict=True))) > 0.95


def test_quality_scores_through_the_query(spark):
    """Every score of the query by bins and tables alone, of features taken here; and both answers occur."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_model.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    again = quality_model.train(docs.repartition(5), spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality_model.op5_quality_gam(spark, sf).collect()}
    for d in docs.collect():
        x = np.array([quality_model.features(d.text)])
        b = model.bins(x)
        c = model.coarse_bins(b)
        z = model.intercept + sum(t[b[0, j]] for j, t in enumerate(model.tables)) + sum(t[c[0, j], c[0, k]] for (j, k), t in model.pairs.items())
        assert abs(got[d.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9 and np.allclose(model.score(x), again.score(x))
    assert min(got.values()) < 0.3 <= max(got.values())


def test_toxicity_on_held_out_rows(spark):
    rows, labels = held_out(spark, toxicity.op3_toxicity_counterfactual, "toxic", "/root/testdata/sf0.1")
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    clean = [r.predicted for d, r in rows.items() if r.held_out and labels.get(d) == 0]
    assert sum(clean) <= 0.03 * len(clean)
    toxic = [r.predicted for d, r in rows.items() if r.held_out and labels.get(d) == 1]
    assert len(toxic) >= 100 and sum(toxic) >= 0.85 * len(toxic), (sum(toxic), len(toxic), sum(clean), len(clean))
    test = [(labels[d], r.score) for d, r in rows.items() if r.held_out and labels.get(d) is not None]
    assert auc(*map(np.array, zip(*test, strict=True))) > 0.93


def test_scores_through_the_query(spark):
    """Every score of the query by the plain definition, and neutral mentions: no group is flagged, none differs much."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r.score for r in toxicity.op3_toxicity_counterfactual(spark, sf).collect()}
    for d in docs.collect():
        z = model.bias + sum(v for t, v in model.weights.items() if t in toxicity.terms(toxicity.words_of(d.text)))
        assert abs(got[d.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9
    for group in toxicity.IDENTITY_TERMS:
        said = [model.score(f"The {t} live here.") for t in group]
        assert max(said) < toxicity.THRESHOLD and max(said) - min(said) < 0.05


def test_counterfactuals_swap_every_mention():
    got = toxicity.counterfactuals("Women and women work. No one else. Gay men sing.")
    assert ("Women and women work", "men and men work") in got and (" Gay men sing", " Gay women sing") in got and (" Gay men sing", " lesbian men sing") in got
    assert len(got) == 5 + 6 + 5
    assert toxicity.difference(" Gay men sing", " Gay women sing") == "+women -men"
    assert toxicity.difference("men and women", "women and women") == "-men"  # the other is there already


def test_counterfactual_penalty_evens_identity_terms(spark):
    texts = [(f"the {t} are kind people {i}", 0) for i, t in enumerate(["christians", "buddhists"] * 60)]
    texts += [(f"those {t} are idiots and scum {i}", 1) for i, t in enumerate(["muslims", "jews"] * 60)] + [(f"muslims pray today {i}", 0) for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    with_penalty = toxicity.train(docs, labels, penalty=20.0, min_docs=2)
    without = toxicity.train(docs, labels, penalty=0.0, min_docs=2)
    change = lambda m: abs(m.weights.get("muslims", 0) - m.weights.get("christians", 0))
    assert change(without) > 0.2 and change(with_penalty) < 0.2 * change(without)
    assert with_penalty.score("they are idiots and scum") > with_penalty.score("they are kind people")


def test_interactions_are_learnt():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y, pair_rounds=60)
    assert (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    by_hand = model.intercept + sum(t[model.bins(x)[:, j]] for j, t in enumerate(model.tables))
    c = model.coarse_bins(model.bins(x))
    by_hand = by_hand + sum(t[c[:, j], c[:, k]] for (j, k), t in model.pairs.items())
    assert np.allclose(by_hand, model.logits(x))


def test_odd_rows_and_no_labels(spark):
    docs = odd_documents(spark, "'x' AS toxicity")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, none)
    assert all(0 <= r.toxicity < 1e-9 for r in toxicity.scored(docs, model).collect())
    gam = quality_model.train(docs, none)
    got = quality_model.scored(odd_documents(spark, "'x' AS quality"), gam).collect()
    assert len(got) == 10 and all(0 <= r.quality <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (2, None, None), (7, 0, 0)], "doc_id long, toxic int, quality int")
    assert all(0 <= r.toxicity <= 1 for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect())
    assert quality_model.scored(docs.limit(0), quality_model.train(docs, labels)).count() == 0
