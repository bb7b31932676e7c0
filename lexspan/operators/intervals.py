"""Operators on spans [inicio, fim) within documents. Every join has the document as an equality key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _other(spans: DataFrame, *extra: str) -> DataFrame:
    return spans.select(F.col("documento_id").alias("d_"), F.col("inicio").alias("i_"), F.col("fim").alias("f_"), *(F.col(c).alias(f"{c}_") for c in extra))


def without_overlap(spans: DataFrame, taken: DataFrame) -> DataFrame:
    """Spans that overlap no span of ``taken`` in their document."""
    t = _other(taken)
    return spans.join(t, (F.col("documento_id") == F.col("d_")) & (F.col("inicio") < F.col("f_")) & (F.col("i_") < F.col("fim")), "left_anti")


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """outer rows with n: how many spans of ``inner`` lie inside."""
    t = _other(inner)
    hit = outer.join(t, (F.col("documento_id") == F.col("d_")) & (F.col("i_") >= F.col("inicio")) & (F.col("f_") <= F.col("fim")), "left")
    return hit.groupBy(*outer.columns).agg(F.count("d_").alias("n"))


def iou_pairs(gold: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """documento_id, k (gold), inicio/fim of both, iou: one-to-one pairs with that overlap or more.

    Greedy within a document: the best overlap first, of equal ones the earlier gold span, then the earlier found one; a
    pair is taken unless one of its spans is taken already.
    """
    f = _other(found)
    j = gold.join(f, (F.col("documento_id") == F.col("d_")) & (F.col("inicio") < F.col("f_")) & (F.col("i_") < F.col("fim")))
    common = F.least("fim", "f_") - F.greatest("inicio", "i_")
    j = j.withColumn("iou", common / (F.greatest("fim", "f_") - F.least("inicio", "i_"))).where(F.col("iou") >= least).drop("d_")
    columns = [c for c in j.columns if c != "documento_id"]
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o1"), F.col("inicio").alias("o2"), F.col("k").alias("o3"), F.col("i_").alias("o4"), F.col("f_").alias("o5"), F.struct(*columns).alias("r"))))
    clash = lambda acc, s: F.exists(acc, lambda e: (e["r"]["k"] == s["r"]["k"]) | (e["r"]["i_"] == s["r"]["i_"]) & (e["r"]["f_"] == s["r"]["f_"]))
    per = j.groupBy("documento_id").agg(ranked.alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, s: F.when(clash(acc, s), acc).otherwise(F.array_append(acc, s)))
    return per.select("documento_id", F.explode(kept).alias("s")).select("documento_id", *(F.col(f"s.r.{c}").alias(c) for c in columns))


def spurious(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Found spans without a partner that also lie inside no matched gold span."""
    p = pairs.select(F.col("documento_id").alias("d_"), "inicio", "fim", "i_", "f_")
    f = found.select(*found.columns)
    same = (f["documento_id"] == p["d_"]) & (f["inicio"] == p["i_"]) & (f["fim"] == p["f_"])
    inside = (f["documento_id"] == p["d_"]) & (f["inicio"] >= p["inicio"]) & (f["fim"] <= p["fim"])
    return f.join(p, same, "left_anti").join(p, inside, "left_anti")


def sweep(spans: DataFrame) -> DataFrame:
    """By start, then the longer first: a span that starts before the last kept one ends is dropped. All columns stay;
    of rows with equal spans the first by the other columns' order is kept."""
    rest = [c for c in spans.columns if c not in ("documento_id", "inicio", "fim")]
    keyed = F.array_sort(F.collect_list(F.struct(F.col("inicio").alias("a"), (-F.col("fim")).alias("b"), F.struct(F.lit(0).alias("z_"), *rest).alias("r"))))

    def step(acc, s):  # noqa: ANN001, ANN202
        end = F.coalesce(-F.try_element_at(acc, F.lit(-1))["b"], F.lit(-1).cast("bigint"))
        return F.when(s["a"] >= end, F.array_append(acc, s)).otherwise(acc)

    per = spans.groupBy("documento_id").agg(keyed.alias("all")).select("documento_id", F.explode(F.aggregate("all", F.slice("all", 1, 0), step)).alias("s"))
    return per.select("documento_id", F.col("s.a").alias("inicio"), (-F.col("s.b")).alias("fim"), *(F.col(f"s.r.{c}").alias(c) for c in rest))


def gaps(spans: DataFrame, documents: DataFrame | None = None, total: str = "n") -> DataFrame:
    """Open stretches between numbered spans whose numbers leave one out: documento_id, de, ate, faltam.

    With documents (documento_id, fim_texto and how many spans there should be) also the stretch after the last span, if
    the last numbers are missing.
    """
    w = Window.partitionBy("documento_id").orderBy("k")
    s = spans.withColumn("de", F.lag("fim").over(w)).withColumn("antes", F.lag("k").over(w))
    out = s.where("k - antes > 1").select("documento_id", "de", F.col("inicio").alias("ate"), (F.col("k") - F.col("antes") - 1).alias("faltam"))
    if documents is None:
        return out
    last = spans.groupBy("documento_id").agg(F.max(F.struct("k", "fim")).alias("m"))
    open_ = documents.join(last, "documento_id", "left").select("documento_id", F.coalesce("m.fim", F.lit(0)).alias("de"), F.col("fim_texto").alias("ate"), (F.col(total) - F.coalesce(F.col("m.k"), F.lit(-1)) - 1).alias("faltam"))
    return out.unionByName(open_.where("faltam > 0"))


def renumbered(spans: DataFrame, prefix: str = "g") -> DataFrame:
    w = Window.partitionBy("documento_id").orderBy("inicio")
    return spans.withColumn("citacao_id", F.concat(F.lit(prefix), (F.row_number().over(w) - 1).cast("string")))


def packed(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """documento_id, citacoes: "inicio,fim,classe,id" per span, joined by a bar in order; "-" for a document without."""
    one = F.concat_ws(",", F.col("inicio").cast("string"), F.col("fim").cast("string"), "classe", F.coalesce(F.col("id_canonico").cast("string"), F.lit("")))
    cells = spans.groupBy("documento_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("inicio", one.alias("t")))), lambda s: s["t"]), "|").alias("citacoes"))
    return documents.select("documento_id").join(cells, "documento_id", "left").select("documento_id", F.coalesce("citacoes", F.lit("-")).alias("citacoes"))


def unpacked(cells: DataFrame) -> DataFrame:
    """The inverse of packed(): a row per span."""
    s = cells.where("citacoes <> '-'").select("documento_id", F.explode(F.split("citacoes", r"\|")).alias("t")).withColumn("p", F.split("t", ","))
    return s.select("documento_id", F.col("p")[0].cast("bigint").alias("inicio"), F.col("p")[1].cast("bigint").alias("fim"), F.col("p")[2].alias("classe"), F.nullif(F.col("p")[3], F.lit("")).cast("bigint").alias("id_canonico"))


def rewritten(docs: DataFrame, spans: DataFrame, replacement: str) -> DataFrame:
    """documento_id, texto with every span replaced: pieces between spans and replacements are put together in order."""
    per = spans.groupBy("documento_id").agg(F.array_sort(F.collect_list(F.struct("inicio", "fim", F.col(replacement).alias("novo")))).alias("s"))
    j = docs.join(per, "documento_id", "left")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):  # noqa: ANN001, ANN202
        before = F.substring(F.col("texto"), acc["at"].cast("int") + 1, (s["inicio"] - acc["at"]).cast("int"))
        return F.struct(s["fim"].alias("at"), F.concat(acc["out"], before, s["novo"]).alias("out"))

    folded = F.aggregate("s", zero, step)
    tail = F.concat(folded["out"], F.substring(F.col("texto"), folded["at"].cast("int") + 1, F.length("texto")))
    return j.select("documento_id", F.when(F.col("s").isNull(), F.col("texto")).otherwise(tail).alias("texto"))


def first_start(spans: DataFrame) -> DataFrame:
    """documento_id, inicio of the earliest span."""
    return spans.groupBy("documento_id").agg(F.min("inicio").alias("inicio"))


def first_seen(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Of rows with one text the first by ``order``."""
    first = F.min(F.struct(*order)).alias("s")
    return rows.groupBy(text).agg(first).select(text, *(f"s.{c}" for c in order))


def as_arrays(spans: DataFrame) -> DataFrame:
    """documento_id, spans: the spans of each document in order."""
    return spans.groupBy("documento_id").agg(F.array_sort(F.collect_list(F.struct("inicio", "fim"))).alias("spans"))


def best_cover(spans: DataFrame, snippets: DataFrame, share: float = 0.8) -> DataFrame:
    """Of the spans (with ordem) inside each snippet that cover at least that share of it, the longest, of equal ones the
    first found: documento_id, i_, f_ (the snippet), inicio, fim, ordem."""
    t = snippets.select(F.col("documento_id").alias("d_"), F.col("inicio").alias("i_"), F.col("fim").alias("f_"))
    j = spans.join(t, (F.col("documento_id") == F.col("d_")) & (F.col("inicio") >= F.col("i_")) & (F.col("fim") <= F.col("f_")))
    j = j.where((F.col("fim") - F.col("inicio")) >= share * (F.col("f_") - F.col("i_")))
    best = F.min(F.struct((F.col("inicio") - F.col("fim")).alias("n"), "ordem", "inicio", "fim")).alias("s")
    return j.groupBy("documento_id", "i_", "f_").agg(best).select("documento_id", "i_", "f_", "s.inicio", "s.fim", "s.ordem")
