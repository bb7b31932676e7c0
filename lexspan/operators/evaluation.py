"""Evaluation of found spans against gold spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def right_id(gold: Column, found: Column) -> Column:
    """Whether the found id is one of the gold's, which may list several between colons."""
    ids = F.split(F.coalesce(gold.cast("string"), F.lit("")), ":")
    return F.array_contains(ids, F.coalesce(found.cast("string"), F.lit("")))


def matched(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs with what was found: classe_p, id_p, regra, confianca, and acerto (class and id right)."""
    p = found.select(F.col("documento_id").alias("d2"), F.col("inicio").alias("i2"), F.col("fim").alias("f2"), F.col("classe").alias("classe_p"), F.col("id_canonico").alias("id_p"), F.col("regra").alias("regra_p"), "confianca")
    j = pairs.join(p, (F.col("documento_id") == F.col("d2")) & (F.col("i_") == F.col("i2")) & (F.col("f_") == F.col("f2"))).drop("d2", "i2", "f2")
    right = (F.col("classe") == F.col("classe_p")) & ((F.col("classe") != "real") | right_id(F.col("id_canonico"), F.col("id_p")))
    return j.withColumn("acerto", right.cast("int"))


def rule_counts(pairs: DataFrame, spurious: DataFrame | None = None) -> DataFrame:
    """regra_p, n, acertos, and espurias if the spurious spans (with regra) are given."""
    counts = pairs.groupBy("regra_p").agg(F.count("*").alias("n"), F.sum("acerto").alias("acertos"))
    if spurious is None:
        return counts
    extra = spurious.groupBy(F.col("regra").alias("regra_p")).agg(F.count("*").alias("espurias"))
    return counts.join(extra, "regra_p", "full").select("regra_p", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "acertos", "espurias")))


def calibrated(counts: DataFrame, prior: DataFrame, enough: int = 50) -> DataFrame:
    """conf per rule: 1 if never wrong in ``enough`` or more, else (right + 2 * prior) / (n + 2), one half at least."""
    p0 = F.coalesce("p0", F.lit(0.9))
    conf = F.when((F.col("acertos") == F.col("n")) & (F.col("n") >= enough), 1.0).otherwise(F.greatest(F.lit(0.5), (F.col("acertos") + 2 * p0) / (F.col("n") + 2)))
    return counts.join(prior, counts["regra_p"] == prior["regra"], "left").select("regra_p", "n", "acertos", F.round(conf, 6).alias("conf"))


def f1_by_class(gold: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """classe, tp, fp, fn, precisao, cobertura, f1; denominators are one at least."""
    g = gold.groupBy("classe").agg(F.count("*").alias("n_gold"))
    p = found.groupBy(F.col("classe").alias("c_")).agg(F.count("*").alias("n_pred"))
    t = pairs.where("acerto = 1").groupBy(F.col("classe").alias("t_")).agg(F.count("*").alias("tp"))
    j = g.join(p, F.col("classe") == F.col("c_"), "full").withColumn("classe", F.coalesce("classe", "c_")).join(t, F.col("classe") == F.col("t_"), "left")
    j = j.select("classe", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "n_pred", "n_gold")))
    j = j.select("classe", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"))
    precision, recall = (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col(c)) for c in ("fp", "fn"))
    j = j.withColumn("precisao", F.round(precision, 6)).withColumn("cobertura", F.round(recall, 6))
    return j.withColumn("f1", F.round(2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def brier(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg((F.col("confianca") - F.col("acerto")) ** 2), 9).alias("brier"))


def calibration_error(scores: DataFrame, bins: int = 15) -> DataFrame:
    """scores (p, y) -> n, ece: equal bins, the last one closed."""
    b = scores.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return b.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 9).alias("ece"))


def errors(pairs: DataFrame, gold: DataFrame, spurious: DataFrame) -> DataFrame:
    """tipo_erro (CLASSE, FN, FP), documento_id, inicio, fim."""
    wrong = pairs.where("acerto = 0").select(F.lit("CLASSE").alias("tipo_erro"), "documento_id", "inicio", "fim")
    missing = gold.join(pairs.select("documento_id", "k"), ["documento_id", "k"], "left_anti").select(F.lit("FN").alias("tipo_erro"), "documento_id", "inicio", "fim")
    extra = spurious.select(F.lit("FP").alias("tipo_erro"), "documento_id", "inicio", "fim")
    return wrong.unionByName(missing).unionByName(extra)


def validated(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of sanity figures: documents, repeated, missing and unknown ids, mean and most spans per document."""
    n = F.when(F.col("citacoes") == "-", 0).otherwise(F.size(F.split("citacoes", r"\|")))
    volume = cells.agg(F.count("*").alias("documentos"), (F.count("*") - F.countDistinct("documento_id")).alias("repetidos"), F.sum(n).alias("citacoes"), F.max(n).alias("maximo"), F.round(F.avg(n), 6).alias("media"))
    missing = expected.join(cells, "documento_id", "left_anti").agg(F.count("*").alias("faltam"))
    unknown = cells.join(expected, "documento_id", "left_anti").agg(F.count("*").alias("sobram"))
    one = F.lit(1).alias("one")
    return volume.select("*", one).join(missing.select("*", one), "one").join(unknown.select("*", one), "one").drop("one")


def level_scores(by_class: DataFrame, level: str = "nivel") -> DataFrame:
    """Mean F1 over classes per level."""
    return by_class.groupBy(level).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def fabricated_called_real(pairs: DataFrame) -> DataFrame:
    """tau: the share of matched fabricated citations that were called real."""
    made_up = pairs.where("classe = 'inventada'")
    return made_up.agg(F.count("*").alias("n"), F.count_if(F.col("classe_p") == "real").alias("como_real"), F.round(F.avg((F.col("classe_p") == "real").cast("double")), 9).alias("tau"))


def variants(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """conjunto, variante -> achadas, certas, espurias, faltam: runs (conjunto, variante, documento_id, inicio, fim, classe)
    against gold (conjunto, documento_id, inicio, fim, classe) on exact spans."""
    g = gold.select("conjunto", "documento_id", "inicio", "fim", F.col("classe").alias("classe_g"))
    j = runs.join(g, ["conjunto", "documento_id", "inicio", "fim"], "left")
    per = j.groupBy("conjunto", "variante").agg(F.count("*").alias("achadas"), F.count_if(F.col("classe") == F.col("classe_g")).alias("certas"), F.count_if(F.col("classe_g").isNull()).alias("espurias"))
    total = g.groupBy("conjunto").agg(F.count("*").alias("total"))
    return per.join(total, "conjunto").select("conjunto", "variante", "achadas", "certas", "espurias", (F.col("total") - F.col("achadas") + F.col("espurias")).alias("faltam"))


# ---- Levels and the final score


def levels(documents: DataFrame) -> DataFrame:
    """documento_id, nivel of rows that repeat it: the largest, should they differ."""
    return documents.groupBy("documento_id").agg(F.max("nivel").alias("nivel"))


def by_level(gold: DataFrame, found: DataFrame, pairs: DataFrame, of: DataFrame) -> DataFrame:
    """nivel, classe, tp, fp, fn, f1; of: documento_id, nivel. A matched pair of two classes is one fn and one fp."""
    counts = []
    for rows, name in ((gold, "n_gold"), (found, "n_pred"), (pairs.where("acerto = 1"), "tp")):
        counts.append(rows.select("documento_id", "classe").join(of, "documento_id").groupBy("nivel", "classe").agg(F.count("*").alias(name)))
    j = counts[0].join(counts[1], ["nivel", "classe"], "full").join(counts[2], ["nivel", "classe"], "left").na.fill(0, ["n_gold", "n_pred", "tp"])
    j = j.select("nivel", "classe", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"))
    return j.withColumn("f1", 2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def summary(gold: DataFrame, found: DataFrame, pairs: DataFrame, of: DataFrame) -> DataFrame:
    """nivel, macro_f1, tau, brier, score: the mean F1 of the gold's classes, raised by a tenth as far as confidence is
    right. tau, the share of matched fabricated citations called real, is reported and not subtracted."""
    macro = by_level(gold, found, pairs, of).where("tp + fn > 0").groupBy("nivel").agg(F.avg("f1").alias("macro_f1"))
    p = pairs.select("documento_id", "classe", "classe_p", "confianca", "acerto").join(of, "documento_id")
    made_up = F.col("classe") == "inventada"
    stats = p.groupBy("nivel").agg(
        F.coalesce(F.avg(F.when(made_up, (F.col("classe_p") == "real").cast("double"))), F.lit(0.0)).alias("tau"), F.avg((F.col("confianca") - F.col("acerto")) ** 2).alias("brier")
    )
    j = macro.join(stats, "nivel", "left")
    score = F.col("macro_f1") * (1 + 0.1 * (1 - F.coalesce("brier", F.lit(1.0))))
    return j.select("nivel", F.round("macro_f1", 6).alias("macro_f1"), F.round("tau", 6).alias("tau"), F.round("brier", 9).alias("brier"), F.round(score, 6).alias("score"))


def final_score(levels_: DataFrame) -> DataFrame:
    """One row: scores of levels, each weighing its number; and the largest tau."""
    return levels_.agg(F.round(F.sum(F.col("nivel") * F.col("score")) / F.sum("nivel"), 6).alias("final"), F.max("tau").alias("tau"))


def documents_of_either(gold: DataFrame, found: DataFrame) -> DataFrame:
    """documento_id, n_gold, n_pred: every document of gold or of what was found."""
    g, p = (d.groupBy("documento_id").agg(F.count("*").alias(n)) for d, n in ((gold, "n_gold"), (found, "n_pred")))
    return g.join(p, "documento_id", "full").na.fill(0, ["n_gold", "n_pred"])


def compared(pairs: DataFrame, gold: DataFrame, spurious: DataFrame) -> DataFrame:
    """One row for a variant: certas, classe_errada, fp, fn, and right and wrong ones of model rules (s1_, s2_)."""
    model = lambda c: F.col(c).startswith("s1_") | F.col(c).startswith("s2_")
    one = F.lit(1).alias("one")
    p = pairs.agg(
        F.count_if(F.col("acerto") == 1).alias("certas"), F.count_if(F.col("acerto") == 0).alias("classe_errada"), F.count_if(model("regra_p") & (F.col("acerto") == 1)).alias("neurais_certas"),
        F.count_if(model("regra_p") & (F.col("acerto") == 0)).alias("n_erradas"), F.count("*").alias("casadas"),
    )
    s = spurious.agg(F.count("*").alias("fp"), F.count_if(model("regra")).alias("n_espurias"))
    j = p.select("*", one).join(s.select("*", one), "one").join(gold.agg(F.count("*").alias("total")).select("*", one), "one")
    return j.select("certas", "classe_errada", "fp", (F.col("total") - F.col("casadas")).alias("fn"), "neurais_certas", (F.col("n_erradas") + F.col("n_espurias")).alias("neurais_erradas"))


# ---- Sanity of a submission


def verdict(figures: DataFrame, mean: tuple[int, int] = (3, 15), most: int = 25) -> DataFrame:
    """validated() with ok: no id twice, none missing, and a mean and a maximum of citations as expected."""
    ok = (F.col("repetidos") == 0) & (F.col("faltam") == 0) & F.col("media").between(*mean) & (F.col("maximo") <= most)
    return figures.withColumn("ok", ok)


def missing_ids(expected: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expected ids that are not there, and ids that nobody expects."""
    e, p = expected.select("documento_id").distinct(), present.select("documento_id").distinct()
    return e.join(p, "documento_id", "left_anti"), p.join(e, "documento_id", "left_anti")


def completed(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """cells with "-" for expected ids without a row; unexpected ones stay."""
    lacking = missing_ids(expected, cells)[0].select("documento_id", F.lit("-").alias("citacoes"))
    return cells.select("documento_id", "citacoes").unionByName(lacking)


def missing_message(ids: DataFrame, shown: int = 3) -> DataFrame:
    """One row: n, and the first few ids in order."""
    first = ids.orderBy("documento_id").limit(shown).agg(F.sort_array(F.collect_list("documento_id")).alias("exemplos"))
    one = F.lit(1).alias("one")
    return ids.agg(F.count("*").alias("n")).select("*", one).join(first.select("*", one), "one").drop("one")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Values of a key that more than one row has, and how many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


# ---- Sentence classifiers


def classifier_metrics(scored: DataFrame, threshold: float = 0.5, bins: int = 15) -> DataFrame:
    """scored (familia, rotulo, p: struct A, B, C, s1_cobre) -> per family: n, acuracia_3, precisao, recall, f1, ece,
    recall_residual, n_residual_pos, escalonamento. A sentence counts as cited by p.A + p.B."""
    best = F.when((F.col("p.A") >= F.col("p.B")) & (F.col("p.A") >= F.col("p.C")), "A").when(F.col("p.B") >= F.col("p.C"), "B").otherwise("C")
    s = scored.withColumn("pc", F.col("p.A") + F.col("p.B")).withColumn("y", F.col("rotulo").isin("A", "B")).withColumn("flag", F.col("pc") >= threshold).withColumn("certa", best == F.col("rotulo"))
    residual = ~F.col("s1_cobre")
    ratio = lambda a, b: F.round(F.count_if(a) / F.greatest(F.lit(1), F.count_if(b)), 4)
    m = s.groupBy("familia").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("certa").cast("int")), 4).alias("acuracia_3"), ratio(F.col("flag") & F.col("y"), F.col("flag")).alias("precisao"), ratio(F.col("flag") & F.col("y"), F.col("y")).alias("recall"),
        ratio(F.col("flag") & F.col("y") & residual, F.col("y") & residual).alias("recall_residual"), F.count_if(F.col("y") & residual).alias("n_residual_pos"), ratio(F.col("flag") & residual, residual).alias("escalonamento"),
        F.count_if(F.col("flag") & F.col("y")).alias("tp"), F.count_if("flag").alias("n_flag"), F.count_if("y").alias("n_y"),
    )
    f1 = 2 * F.col("tp") / F.greatest(F.lit(1), F.col("n_flag") + F.col("n_y"))
    b = s.groupBy("familia", F.least(F.floor(F.col("pc") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("k"), F.avg("pc").alias("q"), F.avg(F.col("y").cast("int")).alias("t"))
    ece = b.groupBy("familia").agg(F.round(F.sum(F.col("k") * F.abs(F.col("q") - F.col("t"))) / F.sum("k"), 4).alias("ece"))
    return m.withColumn("f1", F.round(f1, 4)).drop("tp", "n_flag", "n_y").join(ece, "familia")


def determinism(first: DataFrame, second: DataFrame, key: str = "frase") -> DataFrame:
    """One row: the largest change of a probability between two passes over the same sentences."""
    b = second.select(F.col(key).alias("k_"), F.col("p").alias("q"))
    j = first.join(b, F.col(key) == F.col("k_"))
    change = F.greatest(*(F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) for c in "ABC"))
    return j.agg(F.max(change).alias("delta_max"), F.count("*").alias("n"))


def stratified(rows: DataFrame, by: list[str], quota: int, order: Column, tie: list[str]) -> DataFrame:
    """At most so many rows per stratum, the first by ``order``: a sampling operator."""
    w = Window.partitionBy(*by).orderBy(order, *tie)
    return rows.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= quota).drop("r_")


def quota_sample(rows: DataFrame, label: str, quotas: dict[str, int], order: Column, tie: list[str]) -> DataFrame:
    """At most the quota of each label, the first by ``order``; other labels are left out."""
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(label))
    w = Window.partitionBy(label).orderBy(order, *tie)
    kept = rows.where(F.col(label).isin(*quotas)).withColumn("r_", F.row_number().over(w))
    # by a constant first: then each task keeps as many of a label before rows of one label come together
    return kept.where(F.col("r_") <= max(quotas.values(), default=0)).where(F.col("r_") <= limit).drop("r_")


def counts_by_set(rows: DataFrame, by: str, label: str, letters: int = 3) -> DataFrame:
    """familia (the first letters of a name), label, n."""
    return rows.groupBy(F.substring(by, 1, letters).alias("familia"), label).agg(F.count("*").alias("n"))


def counts_against(rows: DataFrame, by: str, expected: dict[int, int]) -> DataFrame:
    """by, n, esperado, ok: how many rows a level has against how many it should have."""
    want = F.element_at(F.create_map(*(F.lit(x) for kv in expected.items() for x in kv)), F.col(by))
    c = rows.groupBy(by).agg(F.count("*").alias("n"))
    return c.withColumn("esperado", want).withColumn("ok", F.col("n") == F.col("esperado"))


def vague_audit(vague: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows (documento_id, de, ate, faltam) that hold another number of vague phrases than spans are missing: with n;
    and vague phrases outside all windows: with faltam null."""
    v = vague.select(F.col("documento_id").alias("d_"), F.col("inicio").alias("i_"), F.col("fim").alias("f_"))
    inside = (F.col("documento_id") == F.col("d_")) & (F.col("i_") >= F.col("de")) & (F.col("f_") <= F.col("ate"))
    held = windows.join(v, inside, "left").groupBy(*windows.columns).agg(F.count("d_").alias("n"))
    wrong = held.where("faltam >= 0 AND n <> faltam").select("documento_id", "de", "ate", "faltam", "n")
    w = windows.select(F.col("documento_id").alias("d_"), "de", "ate")
    outside = vague.join(w, (F.col("documento_id") == F.col("d_")) & (F.col("inicio") >= F.col("de")) & (F.col("fim") <= F.col("ate")), "left_anti")
    nothing = F.lit(None).cast("bigint")
    return wrong.unionByName(outside.select("documento_id", F.col("inicio").alias("de"), F.col("fim").alias("ate"), nothing.alias("faltam"), F.lit(1).cast("bigint").alias("n")))


# ---- Comparing snapshots


def novelty(now: DataFrame, base: DataFrame, key: str, date: str) -> DataFrame:
    """Rows that the baseline lacks, or has with another date."""
    b = base.select(F.col(key).alias("k_"), F.col(date).alias("d_"))
    return now.join(b, (F.col(key) == F.col("k_")) & (F.col(date) == F.col("d_")), "left_anti")


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks."""
    return a.subtract(b)


def in_either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.unionByName(b).distinct()
