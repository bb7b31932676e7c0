"""From spans to decisions: equi-joins with the knowledge base on exact keys, never fuzzy digits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import class_codes, court, court_of_digit, digits, full_year, justice, law_code, number_key, principal, similarity
from ..functions.vocabulary import ACCESSORY, CALIBRATED, COURT_OF_CLASS, PRIOR


@dataclass(frozen=True)
class KnowledgeBase:
    """keys: chave, id, tribunal, classes (a row per key and ruling); statements: tribunal, numero, vinculante, id;
    articles: lei, artigo, id. Ids are positive."""

    keys: DataFrame
    statements: DataFrame
    articles: DataFrame


def knowledge_base(registry: DataFrame, statements: DataFrame, articles: DataFrame) -> KnowledgeBase:
    keys = registry.select(number_key(F.col("numero")).alias("chave"), "id", "tribunal", F.array("classe").alias("classes"))
    return KnowledgeBase(keys, statements, articles)


def inverted_index(kb: KnowledgeBase) -> DataFrame:
    """chave -> ids in order, donos (how many)."""
    return kb.keys.groupBy("chave").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.countDistinct("id").alias("donos"))


def confidence(rule: Column, calibrated: bool = True) -> Column:
    table = {**PRIOR, **(CALIBRATED if calibrated else {})}
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), rule)


def confidence_of_table(rules: DataFrame, prior: DataFrame, calibrated: DataFrame) -> DataFrame:
    """regra, conf: the calibrated value where there is one, else the prior (prior and calibrated: regra, conf)."""
    p, c = prior.select("regra", F.col("conf").alias("p_")), calibrated.select("regra", F.col("conf").alias("c_"))
    return rules.select("regra").join(p, "regra", "left").join(c, "regra", "left").select("regra", F.coalesce("c_", "p_").alias("conf"))


def owners(keys: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """keys (with chave) and donos: how many rulings of the knowledge base have the key."""
    n = kb.keys.groupBy(F.col("chave").alias("k_")).agg(F.countDistinct("id").alias("donos"))
    return keys.join(n, F.col("chave") == F.col("k_"), "left").drop("k_").withColumn("donos", F.coalesce("donos", F.lit(0)))


def unknown_keys(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose chave is not among the known ones: what a fabricated citation may use."""
    return keys.join(known.select("chave").distinct(), "chave", "left_anti")


def longest_key(kb: KnowledgeBase, by: str = "id") -> DataFrame:
    """The longest key of each ruling (or court), of equal ones the first in order."""
    best = F.min(F.struct((-F.length("chave")).alias("n"), "chave")).alias("s")
    return kb.keys.groupBy(by).agg(best).select(by, (-F.col("s.n")).cast("long").alias("n"), "s.chave")


def names_of(ids: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """ids (id) of statements and articles -> what they are called: tribunal and numero, or lei and artigo."""
    s = kb.statements.select("id", "tribunal", "numero", "vinculante")
    a = kb.articles.select("id", "lei", "artigo")
    return ids.join(s, "id", "left").join(a, "id", "left").where("tribunal IS NOT NULL OR lei IS NOT NULL")


def _court_of(spans: DataFrame) -> DataFrame:
    codes = F.concat(class_codes(F.col("cadeia")), class_codes(F.col("sufixo")))
    by_class = F.create_map(*(F.lit(x) for pair in COURT_OF_CLASS.items() for x in pair))
    s = spans.withColumn("codigos", codes).withColumn("main", principal(F.col("codigos"), ACCESSORY)).withColumn("j", justice(F.col("chave")))
    named = F.when(F.col("trib").isNotNull(), court(F.col("trib"))).when(F.col("j").isNotNull(), court_of_digit(F.col("j")))
    return s.withColumn("tribunal", named.when(F.col("main").isNotNull(), F.try_element_at(by_class, F.col("main"))))


def decide_numbered(spans: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Adds classe, regra, id_canonico to numbered spans (unique per documento_id, inicio).

    An explicit court goes before the justice digit, that before the court of the class. Owners of the key in another
    court only: fabricated. Several owners: the most similar chain if it is alone at the top, else the smallest id.
    """
    s = _court_of(spans.where("kind = 'numerada' OR (kind IN ('processo_cnj', 'hifenizada') AND chave LIKE '%.%')"))
    k = kb.keys.select(F.col("chave").alias("k_"), F.col("id").alias("dono"), F.col("tribunal").alias("t_"), "classes")
    j = s.join(k, s["chave"] == k["k_"], "left")
    j = j.withColumn("compat", F.col("dono").isNotNull() & (F.col("tribunal").isNull() | (F.col("t_") == F.col("tribunal"))))
    j = j.withColumn("nota", F.when(F.col("compat"), similarity(F.col("codigos"), F.col("classes"), ACCESSORY)))
    best = F.max(F.when(F.col("compat"), F.struct("nota", (-F.col("dono")).alias("menos"))))
    out = j.groupBy("documento_id", "inicio", "fim", "kind", "chave").agg(
        F.count("dono").alias("donos"), F.count_if("compat").alias("n"), best.alias("best"), F.min(F.when(F.col("compat"), F.col("dono"))).alias("least"),
        F.sort_array(F.collect_list("nota"), asc=False).alias("notas"),
    )
    alone = F.col("notas")[0] > F.get(F.col("notas"), F.lit(1))
    rule = F.when((F.col("donos") > 0) & (F.col("n") == 0), "inventada_tribunal").when(F.col("n") == 0, "inventada_ausente").when(F.col("n") == 1, "real_unico").when(alone, "real_desempate").otherwise("real_duplicata")
    out = out.withColumn("regra", rule).withColumn("classe", F.when(F.col("n") == 0, "inventada").otherwise("real"))
    picked = F.when(F.col("regra").isin("real_unico", "real_duplicata"), F.col("least")).when(F.col("regra") == "real_desempate", -F.col("best.menos"))
    return out.select("documento_id", "inicio", "fim", "kind", F.lit("jurisprudencia").alias("tipo"), "classe", "regra", picked.alias("id_canonico"))


def decide_statements(spans: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Statements: by court, number and binding; without a court by number among all courts (binding ones: STF)."""
    s = spans.where("kind = 'sumula'").withColumn("numero", F.coalesce(F.try_to_number(digits(F.col("num")), F.lit("999999")).cast("bigint"), F.lit(0)))
    s = s.withColumn("vinculante", F.col("vinc").isNotNull() | F.col("sv").isNotNull())
    s = s.withColumn("tribunal", F.when(F.col("trib").isNotNull(), court(F.col("trib"))).when(F.col("vinculante"), F.lit("STF")))
    k = kb.statements.select(F.col("tribunal").alias("t_"), F.col("numero").alias("n_"), F.col("vinculante").alias("v_"), F.col("id").alias("i_"))
    j = s.join(k, (F.col("numero") == F.col("n_")) & (F.col("vinculante") == F.col("v_")), "left")
    fits = F.col("i_").isNotNull() & (F.col("tribunal").isNull() | (F.col("tribunal") == F.col("t_")))
    out = j.groupBy("documento_id", "inicio", "fim", "kind", "tribunal", "outro").agg(F.count_if(fits).alias("n"), F.max(F.when(fits, F.col("i_"))).alias("id"))
    rule = F.when(F.col("outro").isNotNull(), "sumula_outro_tribunal").when(F.col("n") == 0, "sumula_inventada")
    rule = rule.when(F.col("tribunal").isNotNull(), "sumula_real").when(F.col("n") == 1, "sumula_sem_tribunal").otherwise("sumula_ambigua")
    out = out.withColumn("regra", rule)
    cls = F.when(F.col("regra").isin("sumula_real", "sumula_sem_tribunal"), "real").when(F.col("regra") == "sumula_ambigua", "incompleta").otherwise("inventada")
    return out.select("documento_id", "inicio", "fim", "kind", F.lit("jurisprudencia").alias("tipo"), cls.alias("classe"), "regra", F.when(cls == "real", F.col("id")).alias("id_canonico"))


def decide_laws(spans: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Articles: by law and number; an article with a letter, or of another year's code, is fabricated."""
    s = spans.where("kind = 'lei'").withColumn("codigo", law_code(F.col("lei"))).where("codigo IS NOT NULL")
    s = s.withColumn("artigo", F.coalesce(F.try_to_number(digits(F.col("num")), F.lit("999999")).cast("bigint"), F.lit(0)))
    year = full_year(F.col("leiano"))
    other = F.col("codigo").contains("/") & year.isNotNull() & ~F.coalesce(F.col("codigo").endswith(year), F.lit(False))
    k = kb.articles.select(F.col("lei").alias("l_"), F.col("artigo").alias("a_"), F.col("id").alias("i_"))
    j = s.withColumn("fora", F.col("suf").isNotNull() | other).join(k, (F.col("codigo") == F.col("l_")) & (F.col("artigo") == F.col("a_")), "left")
    real = ~F.col("fora") & F.col("i_").isNotNull()
    return j.select(
        "documento_id", "inicio", "fim", "kind", F.lit("lei").alias("tipo"), F.when(real, "real").otherwise("inventada").alias("classe"),
        F.when(real, "lei_real").otherwise("lei_inventada").alias("regra"), F.when(real, F.col("i_")).alias("id_canonico"),
    )


def decide_rest(spans: DataFrame) -> DataFrame:
    """Themes are never in the knowledge base; incomplete rulings are so by definition."""
    s = spans.where("kind IN ('tema', 'incompleta')")
    theme = F.col("kind") == "tema"
    rule = F.when(theme, "tema").when(F.col("ano").isNotNull() & F.col("nome").isNotNull(), "incompleta").otherwise("incompleta_parcial")
    return s.select("documento_id", "inicio", "fim", "kind", F.lit("jurisprudencia").alias("tipo"), F.when(theme, "inventada").otherwise("incompleta").alias("classe"), rule.alias("regra"), F.lit(None).cast("bigint").alias("id_canonico"))


def decide(spans: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """One decision per span that has one; spans without (no unified number, unknown law) are left out."""
    parts = [decide_numbered(spans, kb), decide_statements(spans, kb), decide_laws(spans, kb), decide_rest(spans)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("confianca", F.round(confidence(F.col("regra")), 4))


def unique_owner_keys(kb: KnowledgeBase) -> DataFrame:
    """Keys with one owner."""
    return kb.keys.groupBy("chave").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("chave", "id")


def wholly_unique(kb: KnowledgeBase) -> DataFrame:
    """id of the rulings all of whose keys have one owner."""
    owners = kb.keys.groupBy("chave").agg(F.countDistinct("id").alias("n"))
    return kb.keys.join(owners, "chave").groupBy("id").agg(F.max("n").alias("n")).where("n = 1").select("id")


def shared_keys(kb: KnowledgeBase) -> DataFrame:
    """Keys with several owners whose chains all differ."""
    per = kb.keys.groupBy("chave").agg(F.countDistinct("id").alias("n"), F.countDistinct("classes").alias("chains"))
    return per.where("n > 1 AND n = chains").select("chave", "n")


def top_two(scores: DataFrame, by: list[str]) -> DataFrame:
    """The two rows with the highest nota per ``by``, ties to the smaller id."""
    w = Window.partitionBy(*by).orderBy(F.desc("nota"), "id")
    return scores.withColumn("posto", F.row_number().over(w)).where("posto <= 2")
