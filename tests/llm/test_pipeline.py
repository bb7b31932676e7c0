from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline

from lexspan.llm import bpe, pii
from lexspan.llm.common import shared_dir

from .helpers import SF, odd_documents


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "pii":
            assert all(not any(s[0] in pii.BASE for s in pii.find(r.text)) for r in docs.collect())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[2] > 0.7 * counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        e = bpe.encoder(f.read())
    assert sorted(str(r.ids) for r in last) == sorted(str(e.encode(r.text)) for r in docs.collect())


def test_run_over_a_folder(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_stages_take_odd_rows(spark):
    docs = odd_documents(spark, "'x' AS toxicity").selectExpr("*", "7 AS node", "'y' AS slots", "true AS ids")
    columns = docs.columns
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    unlabelled = docs.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("doc_id") + 10**9))
    kept = stages["toxicity"](spark, unlabelled, SF)
    assert kept.columns == columns and kept.count() == docs.count()  # nobody's label: nothing is rejected
    assert ids(stages["toxicity"](spark, docs, SF)) == ids(docs)  # one or two labels, none of them toxic
    # 1 twice and 2 are copies, the null id's text is near them; null, empty and blank texts are one group
    assert ids(stages["simhash"](spark, docs, SF)) == [1, 3, 6, 7]
    masked = stages["pii"](spark, docs, SF)
    same = lambda df: sorted(map(str, df.drop("n_chars").collect()))
    assert masked.columns == columns and same(masked) == same(docs)
    assert masked.where("NOT n_chars <=> length(text)").count() == 0
    mixed = stages["mix"](spark, docs, SF)
    assert mixed.columns == columns and set(ids(mixed)) <= {-1, 1, 2, 6, 7} and 6 in ids(mixed)
    assert ids(stages["bpe"](spark, docs, SF)) == ids(docs)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_run_leaves_only_its_result(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["stage-bpe"]
