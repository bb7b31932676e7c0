"""What keeps figures in proportion to the input: plans, and steps that must give what plainer ones give."""

import re

from pyspark.sql import functions as F

from lexspan.catalog import queries
from lexspan.functions import text as T
from lexspan.functions.families import FAMILIES
from lexspan.operators import decisions as D
from lexspan.operators import evaluation as V
from lexspan.operators import extraction as E
from lexspan.operators import models as M
from lexspan.operators.sentences import sentences
from lexspan.plans.fixture import HEAD, Fixture
from lexspan.sources import files
from lexspan.streaming import watch

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_out_once(spark):
    """F1-F13: no exchange of texts before the extraction, none of spans after it."""
    plan = _plan(E.extracted(Fixture(spark, SMALL).docs))
    assert "RoundRobin" not in plan and len(re.findall(r"Exchange hashpartitioning\(documento_id", plan)) == 1


def test_one_pass_finds_what_each_family_finds(spark):
    texts = [
        "AgRg no REsp 123.456/SP e EDcl no AgInt no AREsp 1.234.567 - RS, TST-E-RR-77-11.2019.5.01.0001.",
        "Recurso Especial n. 12 Recurso Extraordinário RE 5 no julgado do STF proferido em 2019 pela relatoria de Dias Toffoli e Súmula 83 do STJ, Enunciado 83 da Súmula do STJ",
        "rnedida cautelar 12.345; Mandado de Segurança nº 77/DF; processo nº 1234567-89.2020.8.26.0100; art. 5º, § 1º-A, da CF; Tema RG 12; SV 10; R. E. 12; A.R.Esp. 99; E 44; HC 1",
        "", "😀" * 200 + " REsp 123 " + "x" * 100 + "\u0001AI\u000355",
    ]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)] + [("n", None)], "documento_id string, texto string").union(Fixture(spark, SMALL).docs)
    found = E.candidates(docs).where("kind <> 'incompleta'").select("documento_id", "ordem", "inicio", "fim", "trecho")
    each = None
    for order, (kind, _, names, p) in enumerate(FAMILIES):
        if kind != "incompleta":
            rows = docs.select("documento_id", F.explode(E.matches(F.col("texto"), p, len(names), True)).alias("m")).select("documento_id", F.lit(order).alias("ordem"), "m.inicio", "m.fim", "m.trecho")
            each = rows if each is None else each.union(rows)
    a, b = (sorted(map(tuple, x.collect())) for x in (found, each))
    assert a == b and len(a) > 5000


def test_spans_carry_their_text(spark):
    docs = spark.createDataFrame([("a", "Como dito no REsp 1.234.567/SP, e na Súmula 83 do STJ.")], "documento_id string, texto string")
    assert sorted(r.trecho for r in E.extracted(docs).collect()) == ["REsp 1.234.567/SP", "Súmula 83 do STJ"]


def test_quota_is_cut_before_labels_come_together(spark):
    """F33."""
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("l"))
    got = V.quota_sample(rows, "l", {"a": 3, "b": 5}, F.col("id") % 7, ["id"])
    assert "WindowGroupLimit" in _plan(got) and got.count() == 8
    assert V.quota_sample(rows, "l", {}, F.col("id"), ["id"]).count() == 0


def test_one_file_is_written_and_read_in_parts(spark, tmp_path):
    """F25."""
    cells = spark.range(0, 100, 1, 5).select(F.col("id").cast("string").alias("documento_id"), F.when(F.col("id") % 2 == 0, "").otherwise('1,2,x,|3,4,y,5').alias("citacoes"))
    path = str(tmp_path / "s")
    files.write_submission(cells, path, one_file=True)
    assert [p.name for p in (tmp_path / "s").iterdir() if p.suffix == ".csv"] == ["submission.csv"] and not (tmp_path / "s" / "_parts").exists()
    back = files.read_strings(spark, path, "documento_id citacoes", lines_within=False)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_sentences_are_cut_without_a_join(spark):
    """F23, F24, F36."""
    docs = spark.createDataFrame([("a", "AUTOS 1\n\nDiz o art. 5º\nque sim. Outra frase  \n\n Fim."), ("b", ""), ("n", None)], "documento_id string, texto string")
    read = M.read(docs)
    assert "Join" not in _plan(read)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, M.with_text(docs, sentences(docs)).select(*read.columns).collect()))


def test_comparison_computes_pairs_once(spark):
    """what is counted comes from written pairs, not from the tables again for every use."""
    assert _plan(queries()["g07_compared"](spark, SMALL)).count("lineitem") == 0


def test_variants_extract_once(spark, tmp_path, monkeypatch):
    """F11."""
    calls = []
    monkeypatch.setattr(watch, "extracted", lambda docs: calls.append(1) or E.extracted(docs))
    docs = spark.createDataFrame([("a", HEAD + "Veja-se ainda o REsp 1.234.567/SP.")], "documento_id string, texto string")
    f = Fixture(spark, SMALL)
    said = watch.run_variants(docs, D.knowledge_base(f.registry, f.statements, f.articles), str(tmp_path), watch.variants())
    assert [s["citacoes"] for s in said] == [1, 1] and calls == [1]


def test_long_sequences_keep_their_form(spark):
    """numbers of a registry with over a million rulings, a 9 before them."""
    got = spark.createDataFrame([("98945638-97.2000.7.25.6532",), ("989456381-97.2000.7.25.6532",), ("1" * 21,)], "t string").select(T.number_key(F.col("t"))).collect()
    assert [r[0] for r in got] == ["98945638-97.2000.7.25.6532", "989456381-97.2000.7.25.6532", "1" * 21]


def test_gold_is_computed_once(spark):
    """F34, F35."""
    for name in ("l09_applied_proposals", "o04_variants"):
        assert _plan(queries()[name](spark, SMALL)).count("lineitem") == 0
