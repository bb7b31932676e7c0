"""Command line.

python -m lexspan.cli run TEXTS OUT --kb KB [--vague] [--debug] [--cache DIR] [--s2-cache JSONL]   decisions, JSON per document, cells
python -m lexspan.cli evaluate OUT GOLD.csv [--errors]       score per level and final, F1 per class, Brier, errors
python -m lexspan.cli calibrate OUT GOLD.csv TABLE           confidence per rule, from what was right
python -m lexspan.cli compare GOLD.csv NAME=OUT ... [--md FILE]   variants side by side
python -m lexspan.cli validate OUT IDS.csv                   sanity figures and verdict
python -m lexspan.cli vague-check OUT GOLD.csv TEXTS         vague phrases against the gaps of the gold's numbers
python -m lexspan.cli kb-audit KB [--dump JSON] [--diff JSON] [--short]   identifying keys of rulings
python -m lexspan.cli generate KB OUT [--n N] [--seed S]     fabricated and real citations with gold
python -m lexspan.cli sentences TEXTS GOLD.csv OUT           labelled sentences for a classifier
python -m lexspan.cli watch IN OUT --kb KB --checkpoint DIR [--once]
python -m lexspan.cli snapshot DIR [--base PARQUET]          files of a folder, or what is new in it
python -m lexspan.cli simulate TEXTS OUT --kb KB             the watcher's handler over texts that are there

KB is a Parquet table (id, tribunal, natureza, texto; for generate also ano, relator).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import level
from .functions.vocabulary import PRIOR
from .operators import evaluation, extraction, intervals, kb, models
from .operators.decisions import KnowledgeBase
from .operators.pipeline import process
from .operators.sentences import sentences
from .plans import generators, kb_store
from .sources import files
from .sources.files import documents_as_json, read_documents, read_gold
from .streaming import watch


def load_kb(documents: DataFrame, folder: str | None = None) -> KnowledgeBase:
    return kb_store.load(documents, folder) if folder else kb_store.build(documents)


def run(spark: SparkSession, texts: str, out: str, kb_path: str, with_vague: bool = False, debug: bool = False, cache: str | None = None, s2_cache: str | None = None) -> None:
    docs = read_documents(spark, texts)
    answers = files.read_cache(spark, s2_cache) if s2_cache else None
    process(docs, load_kb(spark.read.parquet(kb_path), cache), with_vague, cache=answers).write.mode("overwrite").parquet(f"{out}/decisions")
    found = spark.read.parquet(f"{out}/decisions")
    documents_as_json(docs, found, debug).write.mode("overwrite").parquet(f"{out}/json")
    intervals.packed(found, docs).write.mode("overwrite").csv(f"{out}/cells", header=True)


def _gold(spark: SparkSession, path: str) -> DataFrame:
    k = F.regexp_extract("citacao_id", "([0-9]+)$", 1).cast("bigint")
    return read_gold(spark, path).select("nivel", "documento_id", "inicio", "fim", F.col("classificacao").alias("classe"), F.coalesce("id_canonico", F.lit("")).alias("id_canonico"), k.alias("k"))


def _pairs(gold: DataFrame, found: DataFrame) -> DataFrame:
    return evaluation.matched(intervals.iou_pairs(gold, found), found)


def evaluate(spark: SparkSession, out: str, gold_path: str) -> dict[str, DataFrame]:
    found = spark.read.parquet(f"{out}/decisions")
    gold = _gold(spark, gold_path)
    pairs = _pairs(gold, found)
    of = evaluation.levels(gold)
    # documents without gold count by the level of their name
    more = found.select("documento_id", level(F.col("documento_id")).alias("nivel")).distinct().join(of, "documento_id", "left_anti")
    per_level = evaluation.summary(gold, found, pairs.drop("nivel"), of.unionByName(more))
    return {
        "final": evaluation.final_score(per_level), "levels": per_level, "f1": evaluation.f1_by_class(gold, found, pairs), "brier": evaluation.brier(pairs),
        "errors": evaluation.errors(pairs, gold, intervals.spurious(found, pairs)),
    }


def calibrate(spark: SparkSession, out: str, gold_path: str, table: str | None = None) -> DataFrame:
    """regra_p, n, acertos, espurias, conf; written as a table if asked for."""
    found, gold = spark.read.parquet(f"{out}/decisions"), _gold(spark, gold_path)
    pairs = _pairs(gold, found)
    counts = evaluation.rule_counts(pairs, intervals.spurious(found, pairs))
    conf = evaluation.calibrated(counts, spark.createDataFrame(list(PRIOR.items()), "regra string, p0 double"))
    result = counts.join(conf.select("regra_p", "conf"), "regra_p")
    if table:
        result.write.mode("overwrite").parquet(table)
    return result


def compare(spark: SparkSession, gold_path: str, runs: dict[str, str]) -> DataFrame:
    """A row per variant: final score, tau, and evaluation.compared()."""
    gold, out = _gold(spark, gold_path), None
    for name, path in runs.items():
        found = spark.read.parquet(f"{path}/decisions")
        pairs = _pairs(gold, found)
        final = evaluation.final_score(evaluation.summary(gold, found, pairs.drop("nivel"), evaluation.levels(gold)))
        row = evaluation.compared(pairs, gold, intervals.spurious(found, pairs)).select(F.lit(name).alias("variante"), "*")
        row = row.join(final.select(F.lit(name).alias("variante"), "final", "tau"), "variante")
        out = row if out is None else out.unionByName(row)
    return out


def validate(spark: SparkSession, out: str, ids: str) -> DataFrame:
    cells = spark.read.csv(f"{out}/cells", header=True, schema="documento_id string, citacoes string")
    return evaluation.verdict(evaluation.validated(cells, files.read_ids(spark, ids)))


def vague_check(spark: SparkSession, out: str, gold_path: str, texts: str) -> DataFrame:
    found = spark.read.parquet(f"{out}/decisions").where("kind = 'vaga'")
    docs = read_documents(spark, texts).select("documento_id", F.length("texto").cast("bigint").alias("fim_texto"), F.lit(0).cast("bigint").alias("n"))
    gold = _gold(spark, gold_path)
    end = gold.groupBy("documento_id").agg(F.max(F.struct("k", "fim")).alias("m")).join(docs, "documento_id")
    last = end.select("documento_id", F.col("m.fim").alias("de"), F.col("fim_texto").alias("ate"), F.lit(-1).cast("bigint").alias("faltam"))
    return evaluation.vague_audit(found, intervals.gaps(gold).unionByName(last))


def kb_audit(spark: SparkSession, kb_path: str, dump: str | None = None, diff: str | None = None) -> dict[str, DataFrame]:
    source = spark.read.parquet(kb_path).where(~F.coalesce("natureza", F.lit("")).isin("sumula", "dispositivo"))
    keys = kb.rulings(source)
    dumped = kb.key_dump(keys)
    if dump:
        files.write_lines(dumped, dump, "overwrite")
    out = {"without": kb.without_keys(keys), "short": kb.short_keys(keys)}
    if diff:
        out["diff"] = kb.key_diff(files.read_lines(spark, diff, "id bigint, chaves array<string>"), dumped)
    return out


def generate(spark: SparkSession, kb_path: str, out: str, n: int = 1_000, seed: int = 1) -> DataFrame:
    """About n citations with gold, half of them fabricated."""
    source = spark.read.parquet(kb_path)
    base = load_kb(source)
    seeds = spark.range(seed * 1_000_003, seed * 1_000_003 + n // 2).withColumnRenamed("id", "seed")
    made = generators.false_citations(seeds, base.keys)
    rows = base.keys.select("id", F.col("chave").alias("numero"), F.try_element_at("classes", F.lit(-1)).alias("classe"), F.lit(None).cast("string").alias("uf")).where("classe IS NOT NULL")
    real = evaluation.stratified(rows.withColumn("s_", F.lit(0)), ["s_"], n - n // 2, F.xxhash64(F.lit(seed), "id"), ["id", "numero"]).withColumn("seed", F.xxhash64("id", F.lit(seed)) % 1_000_003 + 1_000_003)
    result = made.unionByName(generators.real_rulings(real))
    result.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def sentence_items(spark: SparkSession, texts: str, gold_path: str, out: str) -> DataFrame:
    """state, rotulo, doc, s1_cobre, nivel of every sentence, as JSON lines."""
    docs, gold = read_documents(spark, texts), read_gold(spark, gold_path)
    vague = F.col("citacao_id").startswith("v")
    s = sentences(docs)
    labels = models.labelled(s, gold.where(~vague), gold.where(vague))
    free = models.uncovered(s, extraction.extracted(docs)).select("documento_id", "a", F.lit(False).alias("s1_cobre"))
    items = models.with_text(docs, s).join(labels.select("documento_id", "a", "rotulo"), ["documento_id", "a"]).join(free, ["documento_id", "a"], "left")
    items = items.select(F.col("frase").alias("state"), "rotulo", F.col("documento_id").alias("doc"), F.coalesce("s1_cobre", F.lit(True)).alias("s1_cobre"), level(F.col("documento_id")).alias("nivel"))
    files.write_lines(items, out, "overwrite")
    return items


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)

    def command(name: str, places: str, **options: object) -> None:
        s = sub.add_parser(name)
        for x in places.split():
            s.add_argument(x, nargs="+") if x == "runs" else s.add_argument(x)
        for flag, default in options.items():
            flag = "--" + flag.replace("_", "-")
            if default is False:
                s.add_argument(flag, action="store_true")
            else:
                s.add_argument(flag, default=default, type=type(default) if isinstance(default, int) else str, required=flag in ("--kb", "--checkpoint"))

    command("run", "texts out", kb=None, vague=False, debug=False, cache=None, s2_cache=None)
    command("evaluate", "out gold", errors=False)
    command("calibrate", "out gold table")
    command("compare", "gold runs", md=None)
    command("validate", "out ids")
    command("vague-check", "out gold texts")
    command("kb-audit", "source", dump=None, diff=None, short=False)
    command("generate", "source out", n=1_000, seed=1)
    command("sentences", "texts gold out")
    command("watch", "folder out", kb=None, checkpoint=None, once=False)
    command("snapshot", "folder", base=None)
    command("simulate", "texts out", kb=None)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "run":
        run(spark, a.texts, a.out, a.kb, a.vague, a.debug, a.cache, a.s2_cache)
    elif a.what == "evaluate":
        for name, df in evaluate(spark, a.out, a.gold).items():
            if name != "errors" or a.errors:
                df.show(1_000, truncate=False)
    elif a.what == "calibrate":
        calibrate(spark, a.out, a.gold, a.table).show(100, truncate=False)
    elif a.what == "compare":
        text = files.markdown(compare(spark, a.gold, dict(x.split("=", 1) for x in a.runs)), "Variants", ["variante"])
        print(text)
        if a.md:
            with open(a.md, "w", encoding="utf-8") as f:
                f.write(text)
    elif a.what == "validate":
        figures = validate(spark, a.out, a.ids)
        figures.show(truncate=False)
        return 0 if figures.first().ok else 1
    elif a.what == "vague-check":
        wrong = vague_check(spark, a.out, a.gold, a.texts)
        wrong.show(100, truncate=False)
        return 1 if wrong.limit(1).count() else 0
    elif a.what == "kb-audit":
        for name, df in kb_audit(spark, a.source, a.dump, a.diff).items():
            if name != "short" or a.short:
                df.show(1_000, truncate=False)
    elif a.what == "generate":
        generate(spark, a.source, a.out, a.n, a.seed)
    elif a.what == "sentences":
        sentence_items(spark, a.texts, a.gold, a.out).groupBy("rotulo").count().show()
    elif a.what == "watch":
        spark.streams.addListener(watch.Heartbeat())
        base = load_kb(spark.read.parquet(a.kb))
        watch.kept_running(lambda: watch.classify_new(spark, a.folder, base, a.out, a.checkpoint, once=a.once, how=watch.variants()))
    elif a.what == "snapshot":
        now = watch.snapshot(spark, a.folder)
        print(watch.as_json(evaluation.novelty(now, spark.read.parquet(a.base), "nome", "data") if a.base else now))
    else:
        print(watch.simulated(read_documents(spark, a.texts), load_kb(spark.read.parquet(a.kb)), a.out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
