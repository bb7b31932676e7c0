from pyspark.sql import functions as F

from lexspan.llm import mixing

from .helpers import SF, odd_documents


def water_level(sizes, weights=(1, 2, 3), cap=3):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def check(rows):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r["size"]
    want = water_level(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_query_meets_its_targets_and_reruns_agree(spark):
    rows = mixing.op1_mix_sources(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    check(rows)
    again = mixing.op1_mix_sources(spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_excess_is_reshared(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (1, "b"), (500, "c"), (3, "c"), (2, None), (40, "d")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(mixing.mix(docs, block=7, bucket_rows=2)).collect()
    check(got)
    assert len(got) == 6


def test_slots_are_spread(spark):
    pieces = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), block=64)
    slots = pieces.where("slot IS NOT NULL").groupBy("slot").agg(F.countDistinct("source").alias("n"), F.sum("take").alias("words"))
    assert slots.where("n <> 1 OR words > 64").count() == 0
    first = pieces.where("slot < 200").groupBy("source").agg(F.countDistinct("slot").alias("n")).count()
    assert first >= 15  # of 20 sources


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark, "1 AS size")
    got = mixing.taken(mixing.mix(docs)).collect()
    assert len(got) == 10
    check(got)
    assert mixing.taken(mixing.mix(docs.limit(0))).count() == 0
    assert mixing.taken(mixing.mix(docs.where("text IS NULL"))).agg(F.sum("taken")).first()[0] == 0


def test_what_is_taken_comes_from_the_schedule(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a, **k: whole(*a, **k).where("false"))
    assert mixing.taken(mixing.mix(docs)).agg(F.sum("taken")).first()[0] == 0
    monkeypatch.setattr(mixing, "schedule", lambda *a, **k: whole(*a, **k).where("rank % 2 = 0"))
    half = mixing.mix(docs, block=64)
    assert {r.odd for r in half.where("take > 0").selectExpr("slot IS NULL AS odd").distinct().collect()} == {False}
    assert 0.3 < half.agg(F.sum("take")).first()[0] / docs.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] < 0.7


def test_repeated_rows_and_null_ids_spread(spark):
    rows = [(None, f"text {i} of many words", "a") for i in range(300)] + [(5, "one text", "a")] * 500 + [(i, "w " * 40, "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.taken(mixing.mix(docs, block=16, bucket_rows=100)).collect()
    assert len(got) == 1000
    check(got)
    assert mixing.mix(docs).select("h").distinct().count() == 300 + 1 + 200
    groups = spark.createDataFrame([(1, 10_000), (2, 3)], "h long, n long")
    assert sorted((r.h, r.i) for r in mixing.each(groups, chunk=64).collect()) == [(1, i) for i in range(10_000)] + [(2, i) for i in range(3)]


def test_whole_times_are_what_is_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = mixing.mix(docs).cache()
    want = {r.doc_id: (r.taken, r["size"], r.first_slot) for r in mixing.taken(pieces).collect()}
    got = {r.doc_id: r.slots for r in mixing.whole_times(pieces).collect()}
    for d, (taken, size, first) in want.items():
        slots = got.get(d, [])
        assert abs(len(slots) - taken / max(size, 1)) <= 0.5, d
        assert not slots or min(slots) >= first
    pieces.unpersist()
