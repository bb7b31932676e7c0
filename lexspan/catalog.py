"""All queries by name, with the SQL that each is checked against.

Names begin with the operator's place in the inventory. Gold relations come from what was planted in the synthetic
petitions, so the SQL of an extraction or decision query shares nothing with the patterns that it checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import noise as N
from .functions import text as T
from .functions.vocabulary import CALIBRATED, PRIOR
from .operators import decisions as D
from .operators import evaluation as V
from .operators import extraction as E
from .operators import intervals as I
from .operators import kb as K
from .operators import models as M
from .operators import pipeline as P
from .operators import proposals as S
from .operators.sentences import sentences
from .plans.fixture import AFTER, BEFORE, BY_NUMBER, HEAD, NUMBERED, Fixture, ctes, quoted
from .plans.staging import staged
from .streaming.watch import classified_stream

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Callable[[Fixture], DataFrame], str | None]] = {}


def _query(name: str, sql: str | None):  # noqa: ANN202
    def add(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        _ALL[name] = (f, None if sql is None else ctes() + sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: lambda spark, sf_dir, f=f: f(Fixture(spark, sf_dir)) for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["m10_process_v"](spark, sf_dir)


def _kb(f: Fixture) -> D.KnowledgeBase:
    return D.knowledge_base(f.registry, f.statements, f.articles)


def _spans(f: Fixture) -> DataFrame:
    return staged(E.extracted(f.docs), "spans")


def _noisy(f: Fixture) -> DataFrame:
    """Gold spans with starts moved by a rule, one in eleven left out and one in thirteen of another class."""
    shift = F.col("k") % 7
    g = f.gold.where("k % 11 <> 3").withColumn("inicio", F.col("inicio") + shift).withColumn("fim", F.col("fim") + F.when(F.col("k") % 5 == 0, 40).otherwise(0))
    g = g.withColumn("classe", F.when(F.col("k") % 13 == 1, "inventada").otherwise(F.col("classe")))
    return g.select("documento_id", "inicio", "fim", "classe", "id_canonico", "regra", F.lit(0.9).alias("confianca"))


_NOISY = """, noisy AS (SELECT documento_id, inicio + k % 7 AS inicio, fim + CASE WHEN k % 5 = 0 THEN 40 ELSE 0 END AS fim,
  CASE WHEN k % 13 = 1 THEN 'inventada' ELSE classe END AS classe, id_canonico, regra, 0.9 AS confianca FROM gold WHERE k % 11 <> 3),
raw AS (SELECT g.documento_id, g.k, g.inicio, g.fim, g.classe, g.id_canonico, n.inicio AS i_, n.fim AS f_, n.classe AS classe_p, n.id_canonico AS id_p, n.regra AS regra_p,
  (least(g.fim, n.fim) - greatest(g.inicio, n.inicio))::DOUBLE / (greatest(g.fim, n.fim) - least(g.inicio, n.inicio)) AS iou
  FROM gold g JOIN noisy n ON g.documento_id = n.documento_id AND g.inicio < n.fim AND n.inicio < g.fim),
a AS (SELECT *, row_number() OVER (PARTITION BY documento_id, k ORDER BY iou DESC, i_) AS ra FROM raw WHERE iou >= 0.5),
b AS (SELECT *, row_number() OVER (PARTITION BY documento_id, i_, f_ ORDER BY iou DESC, k) AS rb FROM a WHERE ra = 1),
pairs AS (SELECT *, CASE WHEN classe = classe_p AND (classe <> 'real' OR id_canonico IS NOT DISTINCT FROM id_p) THEN 1 ELSE 0 END AS acerto FROM b WHERE rb = 1)
"""


def _pairs(f: Fixture) -> tuple[DataFrame, DataFrame]:
    f.gold = staged(f.gold, "gold")  # used several times
    found = _noisy(f)
    pairs = V.matched(I.iou_pairs(f.gold.select("documento_id", "k", "inicio", "fim", "classe", "id_canonico"), found), found)
    return found, staged(pairs, "pairs")


# ---- Sources and sinks


@_query("a01_whole_files", "SELECT documento_id, length(texto) AS n, md5(texto) AS h FROM docs")
def _(f: Fixture) -> DataFrame:
    """All documents written as text files by name, read back whole."""
    from uuid import uuid4

    from .plans.staging import shared_dir
    from .sources.files import read_documents, write_documents

    path = f"{shared_dir(f.spark)}/txt-{uuid4().hex}"
    write_documents(f.docs, path)
    return read_documents(f.spark, path, drop_last_end=True).select("documento_id", F.length("texto").cast("long").alias("n"), F.md5(F.encode("texto", "UTF-8")).alias("h"))


@_query("a05_gold_csv", "SELECT documento_id, inicio, fim, trecho, classe, coalesce(CAST(id_canonico AS VARCHAR), '') AS ids FROM gold")
def _(f: Fixture) -> DataFrame:
    from uuid import uuid4

    from .plans.staging import shared_dir
    from .sources.files import read_gold, write_gold

    path = f"{shared_dir(f.spark)}/gold-{uuid4().hex}"
    write_gold(f.gold, path)
    return read_gold(f.spark, path).select("documento_id", "inicio", "fim", "trecho", F.col("classificacao").alias("classe"), F.coalesce("id_canonico", F.lit("")).alias("ids"))


# ---- Scalars


@_query("b01_digits", "SELECT id, regexp_replace(numero, '[^0-9]', '', 'g') AS d FROM registry")
def _(f: Fixture) -> DataFrame:
    noisy = F.concat(F.substring("numero", 1, 2), F.translate(F.substring("numero", 3, 2), "58", "SB"), F.expr("substring(numero, 5)"))
    return f.registry.select("id", T.digits(noisy).alias("d"))


@_query("b02_cnj_key", "SELECT id, CASE WHEN numero LIKE '%.%' THEN numero END AS chave FROM registry")
def _(f: Fixture) -> DataFrame:
    bare = T.digits(F.regexp_replace("numero", "[.-]", " "))
    return f.registry.select("id", T.let(bare, T.cnj_key).alias("chave"))


@_query("b03_number_key", "SELECT id, numero AS chave, CASE WHEN numero LIKE '%.%' THEN split_part(numero, '.', 3) END AS j FROM registry")
def _(f: Fixture) -> DataFrame:
    key = T.number_key(F.concat(F.lit("000"), F.col("numero")))
    return f.registry.select("id", F.when(F.col("numero").contains("."), T.number_key(F.col("numero"))).otherwise(key).alias("chave"), T.justice(T.number_key(F.col("numero"))).alias("j"))


@_query("b04_strip_accents", "SELECT documento_id, k, strip_accents(trecho) AS t FROM gold")
def _(f: Fixture) -> DataFrame:
    return f.gold.select("documento_id", "k", T.strip_accents(F.col("trecho")).alias("t"))


@_query("b09_class_codes", "SELECT documento_id, k, CASE WHEN trecho LIKE 'AgRg%' THEN 'AgRg,REsp' WHEN trecho LIKE 'Recurso Especial%' THEN 'REsp' ELSE split_part(trecho, ' ', 1) END AS c FROM gold WHERE forma IN (0, 1, 2, 16, 17)")
def _(f: Fixture) -> DataFrame:
    return f.gold.where("forma IN (0, 1, 2, 16, 17)").select("documento_id", "k", F.array_join(T.class_codes(F.col("trecho")), ",").alias("c"))


@_query("b10_court", "SELECT documento_id, k, CASE WHEN trecho LIKE '%Superior%' THEN 'STJ' WHEN trecho LIKE '%STF%' OR trecho LIKE '%5TF%' THEN 'STF' WHEN trecho LIKE '%STJ%' THEN 'STJ' END AS t FROM gold WHERE forma IN (9, 10, 13, 22, 23, 31)")
def _(f: Fixture) -> DataFrame:
    return f.gold.where("forma IN (9, 10, 13, 22, 23, 31)").select("documento_id", "k", T.court(F.col("trecho")).alias("t"))


@_query("b11_law_code", "SELECT documento_id, k, CASE WHEN trecho LIKE '%CPC%' THEN 'L13105/2015' WHEN trecho LIKE '%CLT%' THEN 'DL5452/1943' WHEN trecho LIKE '%CC%' THEN 'L10406/2002' WHEN trecho LIKE '%8.078%' THEN 'L8078/1990' ELSE 'CF' END AS lei FROM gold WHERE forma IN (11, 12, 30)")
def _(f: Fixture) -> DataFrame:
    law = F.regexp_extract("trecho", " d[ao] ([^0-9]*(?:8.*|[A-Z].*))$", 1)
    return f.gold.where("forma IN (11, 12, 30)").select("documento_id", "k", T.law_code(law).alias("lei"))


@_query("b14_similarity", "SELECT a.id, CASE WHEN a.classe = b.classe THEN 3.0 ELSE 0.0 END::DOUBLE AS s FROM registry a JOIN registry b ON b.id = a.id + 1")
def _(f: Fixture) -> DataFrame:
    from .functions.vocabulary import ACCESSORY

    b = f.registry.select((F.col("id") - 1).alias("id"), F.array("classe").alias("b"))
    return f.registry.join(b, "id").select("id", T.similarity(F.array("classe"), F.col("b"), ACCESSORY).alias("s"))


@_query("b17_span_text", "SELECT documento_id, k, trecho AS t FROM gold")
def _(f: Fixture) -> DataFrame:
    return f.docs.join(f.gold, "documento_id").select("documento_id", "k", T.span_text(F.col("texto"), F.col("inicio"), F.col("fim")).alias("t"))


@_query("b20_cache_key", "SELECT documento_id, k, sha256('v1|modelo|' || trecho) AS chave FROM gold")
def _(f: Fixture) -> DataFrame:
    return f.gold.select("documento_id", "k", T.cache_key(F.lit("v1"), F.lit("modelo"), F.col("trecho")).alias("chave"))


_PACK = "SELECT d.documento_id, coalesce(string_agg(g.inicio||','||g.fim||','||g.classe||','||coalesce(CAST(g.id_canonico AS VARCHAR), ''), '|' ORDER BY g.inicio), '-') AS citacoes FROM docs d LEFT JOIN gold g ON g.documento_id = d.documento_id GROUP BY d.documento_id"


@_query("b22_pack_cells", _PACK)
def _(f: Fixture) -> DataFrame:
    return I.packed(f.gold, f.docs)


@_query("b22_unpack_cells", "SELECT documento_id, inicio, fim, classe, id_canonico FROM gold")
def _(f: Fixture) -> DataFrame:
    return I.unpacked(I.packed(f.gold, f.docs))


@_query("b23_level", "SELECT documento_id, CASE WHEN CAST(documento_id AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS nivel FROM docs")
def _(f: Fixture) -> DataFrame:
    name = F.concat("documento_id", F.when(F.col("documento_id").cast("long") % 3 == 0, "_n2_a").otherwise("_n1_a"))
    return f.docs.select("documento_id", T.level(name).alias("nivel"))


# ---- Document structure


@_query("c01_header_zone", f"SELECT documento_id, {HEAD.index('Cuida')} AS fim FROM docs")
def _(f: Fixture) -> DataFrame:
    return f.docs.select("documento_id", E.header_end(F.col("texto")).cast("int").alias("fim"))


@_query("c02_own_keys", "SELECT documento_id, '1234567-89.2020.8.26.0100' AS chave FROM docs")
def _(f: Fixture) -> DataFrame:
    return f.docs.select("documento_id", F.explode(E.own_keys(F.col("texto"), E.header_end(F.col("texto")))).alias("chave"))


@_query("c03_sentences", f"SELECT CAST(doc AS VARCHAR) AS documento_id, inicio - {len(BEFORE)} AS a, fim + {len(AFTER)} AS b FROM offsets UNION ALL SELECT documento_id, 0, {len(HEAD.rstrip())} FROM docs")
def _(f: Fixture) -> DataFrame:
    return sentences(f.docs)


@_query("c08_gap_windows", "SELECT documento_id, de, ate, faltam FROM (SELECT documento_id, lag(fim) OVER w AS de, inicio AS ate, k - lag(k) OVER w - 1 AS faltam FROM gold WINDOW w AS (PARTITION BY documento_id ORDER BY k)) x WHERE faltam > 0")
def _(f: Fixture) -> DataFrame:
    return I.gaps(f.gold.select("documento_id", "inicio", "fim", "k"))


# ---- Extraction, decisions

_NUMBERED, _OF_KB = (", ".join(map(str, x)) for x in (NUMBERED, BY_NUMBER))
_HYPHENATED, _CASES = "trecho LIKE 'TST-%'", "trecho LIKE 'processo%'"
#: The statement families share a kind: what tells them apart is the beginning of the phrase.
_SHAPES = {"d04_statements": r"^(Súmula( Vinculante)?( nº)? [0-9]|SV)", "d05_statements_of_list": "^(?i)(enunciado|verbete)", "d06_statements_court_first": "^Súmula (do )?(?!Vinc)[A-Z]"}

for _name, _kind, _forms in (
    ("d01_numbered", "numerada", f"forma IN ({_NUMBERED}) AND NOT ({_HYPHENATED}) AND NOT ({_CASES})"),
    ("d02_hyphenated", "hifenizada", _HYPHENATED),
    ("d03_case_numbers", "processo_cnj", _CASES),
    ("d04_statements", "sumula", "forma IN (9, 10, 26)"),
    ("d05_statements_of_list", "sumula", "forma = 22"),
    ("d06_statements_court_first", "sumula", "forma = 23"),
    ("d07_themes", "tema", "forma IN (13, 29)"),
    ("d08_law_articles", "lei", "forma IN (11, 12, 30)"),
    ("d09_incomplete", "incompleta", "forma IN (7, 8, 31)"),
):

    @_query(_name, f"SELECT documento_id, inicio, fim, trecho FROM gold WHERE {_forms}")
    def _(f: Fixture, kind: str = _kind, name: str = _name) -> DataFrame:
        s = E.extracted(f.docs).where(F.col("kind") == kind).select("documento_id", "inicio", "fim", "trecho")
        return s.where(F.col("trecho").rlike(_SHAPES[name])) if name in _SHAPES else s


@_query("d12_vague", "SELECT documento_id, inicio, fim, trecho, tipo FROM gold WHERE forma = 14")
def _(f: Fixture) -> DataFrame:
    docs = staged(f.docs, "docs")  # read twice
    return E.vague(docs, E.extracted(docs)).select("documento_id", "inicio", "fim", "trecho", "tipo")


@_query(
    "e01_own_number_filter",
    f"SELECT documento_id, inicio, fim FROM (SELECT CAST(doc AS VARCHAR) AS documento_id, inicio, fim FROM offsets WHERE forma = 15 AND ord % 3 = 1 UNION ALL SELECT documento_id, {HEAD.index('Autos')}, {HEAD.index('0100') + 4} FROM docs) x",
)
def _(f: Fixture) -> DataFrame:
    """The spans that the document's own number takes out: the header's, and where a sentence repeats it."""
    return E.own_number_spans(f.docs).select("documento_id", F.col("inicio").cast("int").alias("inicio"), F.col("fim").cast("int").alias("fim"))


@_query("f01_key_join", f"SELECT g.documento_id, g.k, count(s.id) AS donos FROM gold g LEFT JOIN offsets o ON o.doc = CAST(g.documento_id AS BIGINT) AND o.k = g.k LEFT JOIN registry s ON s.numero = CASE WHEN g.forma IN (5, 6) THEN 'x' ELSE o.numero END WHERE g.forma IN ({_NUMBERED}) GROUP BY g.documento_id, g.k")
def _(f: Fixture) -> DataFrame:
    number = F.regexp_extract(F.replace("trecho", F.lit("\n"), F.lit("")), "([0-9][0-9S.\u00a0\u2011-]+)(?:/SP)?$", 1)
    g = f.gold.where(f"forma IN ({_NUMBERED})").select("documento_id", "k", T.number_key(number).alias("chave"))
    return D.owners(g, _kb(f)).select("documento_id", "k", "donos")


@_query("m02_numbered_decisions", "SELECT documento_id, inicio, classe, regra, id_canonico FROM gold WHERE forma IN (" + _NUMBERED + ")")
def _(f: Fixture) -> DataFrame:
    return D.decide_numbered(_spans(f), _kb(f)).select("documento_id", "inicio", "classe", "regra", "id_canonico")


@_query("m03_statement_decisions", "SELECT documento_id, inicio, classe, regra, CAST(id_canonico AS BIGINT) AS id_canonico FROM gold WHERE forma IN (9, 10, 22, 23, 26)")
def _(f: Fixture) -> DataFrame:
    return D.decide_statements(_spans(f), _kb(f)).select("documento_id", "inicio", "classe", "regra", "id_canonico")


@_query("m04_law_decisions", "SELECT documento_id, inicio, classe, regra, CAST(id_canonico AS BIGINT) AS id_canonico FROM gold WHERE forma IN (11, 12, 30)")
def _(f: Fixture) -> DataFrame:
    return D.decide_laws(_spans(f), _kb(f)).select("documento_id", "inicio", "classe", "regra", "id_canonico")


_CONF = """VALUES ('real_unico', 1.0), ('real_desempate', 1.0), ('real_duplicata', 0.6), ('inventada_ausente', 1.0), ('inventada_tribunal', 0.8), ('lei_real', 1.0), ('lei_inventada', 1.0),
  ('sumula_real', 1.0), ('sumula_inventada', 1.0), ('sumula_outro_tribunal', 1.0), ('sumula_sem_tribunal', 0.6), ('sumula_ambigua', 0.6), ('tema', 1.0), ('incompleta', 1.0), ('incompleta_parcial', 0.8),
  ('vaga', 1.0), ('s1_vaga', 1.0), ('s2_vaga', 1.0), ('s2_real', 0.9), ('s2_inventada', 0.8), ('s2_incompleta', 0.8)"""


@_query("m08_rule_confidence", f"SELECT r AS regra, c::DOUBLE AS conf FROM ({_CONF}) v(r, c)")
def _(f: Fixture) -> DataFrame:
    return f.spark.createDataFrame([(r,) for r in PRIOR], "regra string").select("regra", D.confidence(F.col("regra")).cast("double").alias("conf"))


_PROCESS = "SELECT documento_id, inicio, fim, tipo, classe, regra, CAST(id_canonico AS BIGINT) AS id_canonico FROM gold"


@_query("m10_process_v", _PROCESS)
def _(f: Fixture) -> DataFrame:
    return P.process(staged(f.docs, "docs"), _kb(f), True).select("documento_id", "inicio", "fim", "tipo", "classe", "regra", "id_canonico")


@_query("m10_process_r", _PROCESS + " WHERE forma <> 14")
def _(f: Fixture) -> DataFrame:
    return P.process(f.docs, _kb(f)).select("documento_id", "inicio", "fim", "tipo", "classe", "regra", "id_canonico")


@_query("k01_watch_stream", _PROCESS + " WHERE forma <> 14")
def _(f: Fixture) -> DataFrame:
    return classified_stream(f.docs, _kb(f)).select("documento_id", "inicio", "fim", "tipo", "classe", "regra", "id_canonico")


# ---- Joins and sets


@_query("f07_overlap_anti_join", "SELECT g.documento_id, g.k FROM gold g LEFT JOIN gold t ON t.documento_id = g.documento_id AND t.k <> g.k AND t.classe = 'inventada' AND g.inicio < t.fim + 60 AND t.inicio - 60 < g.fim WHERE g.classe <> 'inventada' AND t.k IS NULL")
def _(f: Fixture) -> DataFrame:
    """Spans of other classes that no fabricated one comes within 60 characters of."""
    wide = f.gold.where("classe = 'inventada'").select("documento_id", (F.col("inicio") - 60).alias("inicio"), (F.col("fim") + 60).alias("fim"))
    return I.without_overlap(f.gold.where("classe <> 'inventada'"), wide).select("documento_id", "k")


@_query("f08_containment_count", "SELECT g.documento_id, g.k, count(t.k) AS n FROM gold g LEFT JOIN gold t ON t.documento_id = g.documento_id AND t.inicio >= g.inicio - 100 AND t.fim <= g.fim + 100 GROUP BY g.documento_id, g.k")
def _(f: Fixture) -> DataFrame:
    outer = f.gold.select("documento_id", "k", (F.col("inicio") - 100).alias("inicio"), (F.col("fim") + 100).alias("fim"))
    return I.contained(f.gold, outer).select("documento_id", "k", "n")


@_query("f09_iou_match", _NOISY + "SELECT documento_id, k, i_, f_, round(iou, 9) AS iou FROM pairs")
def _(f: Fixture) -> DataFrame:
    return I.iou_pairs(f.gold.select("documento_id", "k", "inicio", "fim"), _noisy(f)).select("documento_id", "k", "i_", "f_", F.round("iou", 9).alias("iou"))


_SPURIOUS = "SELECT n.documento_id, n.inicio, n.fim FROM noisy n WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.documento_id = n.documento_id AND p.i_ = n.inicio AND p.f_ = n.fim) AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.documento_id = n.documento_id AND n.inicio >= p.inicio AND n.fim <= p.fim)"


@_query("f10_spurious", _NOISY + _SPURIOUS)
def _(f: Fixture) -> DataFrame:
    found = _noisy(f)
    return I.spurious(found, I.iou_pairs(f.gold.select("documento_id", "k", "inicio", "fim"), found)).select("documento_id", "inicio", "fim")


@_query("f13_missing_ids", "SELECT documento_id FROM docs WHERE documento_id NOT IN (SELECT documento_id FROM gold WHERE k = 30) UNION ALL SELECT documento_id||'x' FROM gold WHERE k = 30")
def _(f: Fixture) -> DataFrame:
    """Documents without a 31st span, and names that no document has."""
    other = f.gold.where("k = 30").select(F.concat("documento_id", F.lit("x")).alias("documento_id"))
    missing, unknown = V.missing_ids(f.docs, f.gold.where("k = 30").select("documento_id").unionByName(other))
    return missing.unionByName(unknown)


@_query("f16_cache_lookup", "SELECT count(*) FILTER (WHERE k % 3 = 0) AS achadas, count(*) FILTER (WHERE k % 3 <> 0) AS perdidas FROM (SELECT trecho, min(k) AS k FROM gold GROUP BY trecho) x")
def _(f: Fixture) -> DataFrame:
    asked = f.gold.groupBy(F.col("trecho").alias("frase")).agg(F.min("k").alias("k"))
    cache = asked.where("k % 3 = 0").select(T.cache_key(F.lit("1"), F.lit("m"), F.col("frase")).alias("k"), F.array("frase").alias("v"))
    return M.misses(asked.select("frase"), cache, "1", "m")


@_query("f22_unknown_keys", "SELECT r.id FROM registry r LEFT JOIN (SELECT DISTINCT numero FROM registry) k ON k.numero = CASE WHEN r.id % 3 = 0 THEN r.numero ELSE '9'||r.numero END WHERE k.numero IS NULL")
def _(f: Fixture) -> DataFrame:
    made = F.when(F.col("id") % 3 == 0, F.col("numero")).otherwise(F.concat(F.lit("9"), F.col("numero")))
    return D.unknown_keys(f.registry.select("id", T.number_key(made).alias("chave")), _kb(f).keys).select("id")


@_query("f23_rewrite", "SELECT documento_id, n, h FROM (SELECT documento_id, length(t) AS n, md5(t) AS h FROM (SELECT d.documento_id, '" + quoted(HEAD)[1:-1] + f"'||string_agg('{BEFORE}'||CASE WHEN o.forma = 15 THEN o.trecho ELSE '[C'||o.k||']' END||'{AFTER}', ' ' ORDER BY o.ord, o.ln) AS t FROM docs d JOIN offsets o ON CAST(o.doc AS VARCHAR) = d.documento_id GROUP BY d.documento_id) x) y")
def _(f: Fixture) -> DataFrame:
    out = I.rewritten(f.docs, f.gold.withColumn("novo_", F.concat(F.lit("[C"), F.col("k").cast("string"), F.lit("]"))), "novo_")
    return out.select("documento_id", F.length("texto").cast("long").alias("n"), F.md5(F.encode("texto", "UTF-8")).alias("h"))


@_query("j04_set_difference", "SELECT trecho FROM gold WHERE k % 2 = 0 EXCEPT SELECT trecho FROM gold WHERE k % 2 = 1")
def _(f: Fixture) -> DataFrame:
    return V.only_in_first(f.gold.where("k % 2 = 0").select("trecho"), f.gold.where("k % 2 = 1").select("trecho"))


@_query("j07_map_overlay", f"SELECT r AS regra, c::DOUBLE AS conf FROM ({_CONF}) v(r, c)")
def _(f: Fixture) -> DataFrame:
    prior, over = (f.spark.createDataFrame(list(t.items()), "regra string, conf double") for t in (PRIOR, CALIBRATED))
    return D.confidence_of_table(prior, prior, over)


# ---- Aggregates


@_query("g01_inverted_index", "SELECT numero AS chave, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, count(*) AS donos FROM registry GROUP BY numero")
def _(f: Fixture) -> DataFrame:
    return D.inverted_index(_kb(f)).select("chave", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "donos")


@_query("g05_rule_counts", _NOISY + "SELECT regra_p, count(*) AS n, CAST(sum(acerto) AS BIGINT) AS acertos FROM pairs GROUP BY regra_p")
def _(f: Fixture) -> DataFrame:
    return V.rule_counts(_pairs(f)[1])


_PRIORS = "(VALUES " + ", ".join(f"('{r}', {p}::DOUBLE)" for r, p in PRIOR.items()) + ") v(regra, p0)"


@_query("g06_calibrated", _NOISY + f"SELECT regra_p, n, acertos, round(CASE WHEN acertos = n AND n >= 50 THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, (acertos + 2 * coalesce(p0, 0.9::DOUBLE)) / (n + 2)) END, 6) AS conf FROM (SELECT regra_p, count(*) AS n, CAST(sum(acerto) AS BIGINT) AS acertos FROM pairs GROUP BY regra_p) c LEFT JOIN {_PRIORS} ON v.regra = c.regra_p")
def _(f: Fixture) -> DataFrame:
    return V.calibrated(V.rule_counts(_pairs(f)[1]), f.spark.createDataFrame(list(PRIOR.items()), "regra string, p0 double"))


@_query("g09_calibration_error", "SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(p - y)) / sum(n), 9) AS ece FROM (SELECT count(*) AS n, avg(p) AS p, avg(y) AS y FROM (SELECT (l_partkey * 37 % 101) / 100.0::DOUBLE AS p, (CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE AS y FROM lineitem) z GROUP BY least(CAST(floor(p * 15) AS BIGINT), 14)) x")
def _(f: Fixture) -> DataFrame:
    li = f.lineitem.select((F.col("l_partkey") * 37 % 101 / 100.0).alias("p"), F.when(F.col("l_orderkey") % 3 == 0, 1.0).otherwise(0.0).alias("y"))
    return V.calibration_error(li)


@_query("g11_f1_by_class", _NOISY + """, t AS (SELECT classe, count(*) FILTER (WHERE acerto = 1) AS tp FROM pairs GROUP BY classe),
c AS (SELECT g.classe, coalesce(t.tp, 0) AS tp, p.n - coalesce(t.tp, 0) AS fp, g.n - coalesce(t.tp, 0) AS fn FROM (SELECT classe, count(*) AS n FROM gold GROUP BY classe) g
JOIN (SELECT classe, count(*) AS n FROM noisy GROUP BY classe) p ON p.classe = g.classe LEFT JOIN t ON t.classe = g.classe)
SELECT classe, tp, fp, fn, round(tp::DOUBLE / greatest(1, tp + fp), 6) AS precisao, round(tp::DOUBLE / greatest(1, tp + fn), 6) AS cobertura, round(2.0::DOUBLE * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1 FROM c""")
def _(f: Fixture) -> DataFrame:
    found, pairs = _pairs(f)
    return V.f1_by_class(f.gold, found, pairs)


@_query("g14_volume", "SELECT count(*) AS documentos, 0 AS repetidos, CAST(sum(n) AS BIGINT) AS citacoes, max(n) AS maximo, round(avg(n), 6) AS media, 0 AS faltam, 0 AS sobram FROM (SELECT d.documento_id, count(g.k) AS n FROM docs d LEFT JOIN gold g ON g.documento_id = d.documento_id GROUP BY d.documento_id) x".replace(" 0 AS", " 0::BIGINT AS"))
def _(f: Fixture) -> DataFrame:
    return V.validated(I.packed(f.gold, f.docs), f.docs.select("documento_id")).withColumn("maximo", F.col("maximo").cast("long"))


@_query("g17_unique_owner_keys", "SELECT numero AS chave, min(id) AS id FROM registry GROUP BY numero HAVING count(*) = 1")
def _(f: Fixture) -> DataFrame:
    return D.unique_owner_keys(_kb(f))


@_query("g18_shared_keys", "SELECT numero AS chave, count(*) AS n FROM registry GROUP BY numero HAVING count(*) > 1 AND count(*) = count(DISTINCT classe)")
def _(f: Fixture) -> DataFrame:
    return D.shared_keys(_kb(f))


@_query("g21_brier", _NOISY + "SELECT count(*) AS n, round(avg((0.9::DOUBLE - acerto) * (0.9::DOUBLE - acerto)), 9) AS brier FROM pairs")
def _(f: Fixture) -> DataFrame:
    return V.brier(_pairs(f)[1])


@_query("g22_first_offset", "SELECT documento_id, min(inicio) AS inicio FROM gold GROUP BY documento_id")
def _(f: Fixture) -> DataFrame:
    return I.first_start(f.gold)


@_query(
    "o01_errors",
    _NOISY + """, sp AS (SELECT n.documento_id, n.inicio, n.fim FROM noisy n LEFT JOIN pairs p ON p.documento_id = n.documento_id AND p.i_ = n.inicio AND p.f_ = n.fim
  LEFT JOIN pairs q ON q.documento_id = n.documento_id AND n.inicio >= q.inicio AND n.fim <= q.fim WHERE p.k IS NULL AND q.k IS NULL)
SELECT 'CLASSE' AS tipo_erro, documento_id, inicio, fim FROM pairs WHERE acerto = 0
UNION ALL SELECT 'FN', g.documento_id, g.inicio, g.fim FROM gold g LEFT JOIN pairs p ON p.documento_id = g.documento_id AND p.k = g.k WHERE p.k IS NULL UNION ALL SELECT 'FP', documento_id, inicio, fim FROM sp""",
)
def _(f: Fixture) -> DataFrame:
    found, pairs = _pairs(f)
    return V.errors(pairs, f.gold, I.spurious(found, pairs))


# ---- Order


@_query(
    "h01_overlap_choice",
    """, s AS (SELECT documento_id, CAST(k % 3 AS INTEGER) AS prioridade, inicio, fim + k % 4 * 40 AS fim FROM gold), w AS (SELECT *, row_number() OVER (PARTITION BY documento_id ORDER BY prioridade DESC, fim - inicio DESC, inicio) AS r FROM s)
SELECT documento_id, prioridade, inicio, fim, 0 AS ordem FROM (WITH RECURSIVE kept AS (SELECT documento_id, r, prioridade, inicio, fim, [{'i': inicio, 'f': fim}] AS l, TRUE AS ok FROM w WHERE r = 1
UNION ALL SELECT w.documento_id, w.r, w.prioridade, w.inicio, w.fim, CASE WHEN len(list_filter(kept.l, lambda x: x.i < w.fim AND w.inicio < x.f)) = 0 THEN list_append(kept.l, {'i': w.inicio, 'f': w.fim}) ELSE kept.l END,
  len(list_filter(kept.l, lambda x: x.i < w.fim AND w.inicio < x.f)) = 0 FROM kept JOIN w ON w.documento_id = kept.documento_id AND w.r = kept.r + 1) SELECT * FROM kept) z WHERE ok""",
)
def _(f: Fixture) -> DataFrame:
    """Overlapping candidates of two lengths and priorities, chosen greedily."""
    long = f.gold.select("documento_id", (F.col("k") % 3).cast("int").alias("prioridade"), "inicio", (F.col("fim") + F.col("k") % 4 * 40).alias("fim"), F.lit(0).alias("ordem"))
    per = long.groupBy("documento_id").agg(F.collect_list(F.struct("prioridade", "inicio", "fim", "ordem")).alias("s"))
    return per.select("documento_id", F.explode(E.resolved(F.col("s"))).alias("s")).select("documento_id", "s.*")


@_query(
    "h15_assignment",
    """, g AS (SELECT documento_id, k, k * 10 AS inicio, k * 10 + 14 AS fim FROM gold), n AS (SELECT documento_id, k * 10 + k % 5 AS inicio, k * 10 + k % 5 + 12 AS fim FROM gold WHERE k % 4 <> 1),
p AS (SELECT g.documento_id, g.k, n.inicio AS i_, (least(g.fim, n.fim) - greatest(g.inicio, n.inicio))::DOUBLE / (greatest(g.fim, n.fim) - least(g.inicio, n.inicio)) AS iou FROM g JOIN n ON n.documento_id = g.documento_id AND g.inicio < n.fim AND n.inicio < g.fim),
w AS (SELECT *, row_number() OVER (PARTITION BY documento_id ORDER BY iou DESC, k, i_) AS r FROM p WHERE iou >= 0.3)
SELECT documento_id, k, i_ FROM (WITH RECURSIVE kept AS (SELECT documento_id, r, k, i_, [k] AS ks, [i_] AS js, TRUE AS ok FROM w WHERE r = 1
UNION ALL SELECT w.documento_id, w.r, w.k, w.i_, CASE WHEN list_contains(kept.ks, w.k) OR list_contains(kept.js, w.i_) THEN kept.ks ELSE list_append(kept.ks, w.k) END,
  CASE WHEN list_contains(kept.ks, w.k) OR list_contains(kept.js, w.i_) THEN kept.js ELSE list_append(kept.js, w.i_) END, NOT (list_contains(kept.ks, w.k) OR list_contains(kept.js, w.i_))
  FROM kept JOIN w ON w.documento_id = kept.documento_id AND w.r = kept.r + 1) SELECT * FROM kept) z WHERE ok""",
)
def _(f: Fixture) -> DataFrame:
    """One-to-one pairs where spans overlap their neighbours too, so that a best partner may be taken already."""
    g = f.gold.select("documento_id", "k", (F.col("k") * 10).alias("inicio"), (F.col("k") * 10 + 14).alias("fim"))
    n = f.gold.where("k % 4 <> 1").select("documento_id", (F.col("k") * 10 + F.col("k") % 5).alias("inicio"), (F.col("k") * 10 + F.col("k") % 5 + 12).alias("fim"))
    return I.iou_pairs(g, n, 0.3).select("documento_id", "k", "i_")


@_query("h02_sweep", """, s AS (SELECT documento_id, inicio, fim + k % 4 * 40 AS fim, row_number() OVER (PARTITION BY documento_id ORDER BY inicio, fim + k % 4 * 40 DESC) AS r FROM gold),
w AS (SELECT * FROM s) SELECT documento_id, inicio, fim FROM (WITH RECURSIVE kept AS (SELECT documento_id, r, inicio, fim, fim AS e, TRUE AS ok FROM w WHERE r = 1
UNION ALL SELECT w.documento_id, w.r, w.inicio, w.fim, CASE WHEN w.inicio >= kept.e THEN w.fim ELSE kept.e END, w.inicio >= kept.e FROM kept JOIN w ON w.documento_id = kept.documento_id AND w.r = kept.r + 1) SELECT * FROM kept) z WHERE ok""")
def _(f: Fixture) -> DataFrame:
    return I.sweep(f.gold.select("documento_id", "inicio", (F.col("fim") + F.col("k") % 4 * 40).alias("fim")))


@_query("h11_first_seen", "SELECT trecho, documento_id, k FROM (SELECT *, row_number() OVER (PARTITION BY trecho ORDER BY documento_id, k) AS r FROM gold) x WHERE r = 1")
def _(f: Fixture) -> DataFrame:
    return I.first_seen(f.gold, "trecho", ["documento_id", "k"])


@_query("h12_renumber", "SELECT documento_id, inicio, 'g'||(row_number() OVER (PARTITION BY documento_id ORDER BY inicio) - 1) AS citacao_id FROM gold")
def _(f: Fixture) -> DataFrame:
    return I.renumbered(f.gold).select("documento_id", "inicio", "citacao_id")


@_query("h14_stratified_sample", "SELECT documento_id, k, classe FROM (SELECT *, row_number() OVER (PARTITION BY classe ORDER BY (CAST(documento_id AS BIGINT) * 1103515 + k * 12345) % 2147483648, documento_id, k) AS r FROM gold) x WHERE r <= 40")
def _(f: Fixture) -> DataFrame:
    draw = (F.col("documento_id").cast("long") * 1103515 + F.col("k") * 12345) % 2147483648
    return V.stratified(f.gold, ["classe"], 40, draw, ["documento_id", "k"]).select("documento_id", "k", "classe")


@_query("i02_top_two", "SELECT tribunal, id, posto FROM (SELECT tribunal, id, row_number() OVER (PARTITION BY tribunal ORDER BY ano DESC, id) AS posto FROM registry) x WHERE posto <= 2")
def _(f: Fixture) -> DataFrame:
    return D.top_two(f.registry.withColumn("nota", F.col("ano")), ["tribunal"]).select("tribunal", "id", F.col("posto").cast("long").alias("posto"))


@_query("i05_longest_key", "SELECT tribunal, max(length(numero)) AS n, min(numero) FILTER (WHERE length(numero) = m) AS chave FROM (SELECT *, max(length(numero)) OVER (PARTITION BY tribunal) AS m FROM registry) x GROUP BY tribunal")
def _(f: Fixture) -> DataFrame:
    return D.longest_key(_kb(f), "tribunal")


# ---- Synthetic corpus


@_query("n14_corpus_offsets", "SELECT count(*) AS n, 0::BIGINT AS errados FROM gold")
def _(f: Fixture) -> DataFrame:
    """Every gold span's text is what stands there in the document."""
    j = f.docs.join(f.gold, "documento_id")
    return j.agg(F.count("*").alias("n"), F.count_if(T.span_text(F.col("texto"), F.col("inicio"), F.col("fim")) != F.col("trecho")).alias("errados"))


@_query("n05_cnj_format", "SELECT id, numero AS escrito FROM registry WHERE numero LIKE '%.%'")
def _(f: Fixture) -> DataFrame:
    return f.registry.where("numero LIKE '%.%'").select("id", N.unified(T.digits(F.col("numero"))).alias("escrito"))


# ---- Knowledge base from texts

_KB_TEXTS = """SELECT id, tribunal, CASE WHEN tribunal = 'TST' THEN 'TRIBUNAL SUPERIOR DO TRABALHO ementa de 2020 com RR 77-11.2019.5.01.0001 citado. Vistos, relatados e discutidos estes autos de Recurso de Revista nº TST-RR-'||numero||', em que é Recorrente Fulano.'
  ELSE 'TRIBUNAL '||tribunal||' ACÓRDÃO '||classe||' Nº '||numero||' - SP (2016/0199049) CLASSE 32 R$ 1.500 RELATOR: '||relator||'. Como no '||classe||' 555111, julgado.' END AS texto FROM registry"""


def _kb_texts(f: Fixture) -> DataFrame:
    return f.sql(_KB_TEXTS)


@_query("d17_kb_header_keys", "SELECT id, numero AS chave FROM registry WHERE length(numero) > 1")
def _(f: Fixture) -> DataFrame:
    return K.rulings(_kb_texts(f)).select("id", F.explode("chaves").alias("chave"))


@_query("c07_kb_header_classes", "SELECT id, CASE WHEN tribunal <> 'TST' THEN classe ELSE '' END AS c FROM registry")
def _(f: Fixture) -> DataFrame:
    return K.rulings(_kb_texts(f)).select("id", F.array_join("classes", ",").alias("c"))


@_query("f18_manual_keys", "SELECT id, CASE WHEN id % 100 = 7 THEN 'm'||id ELSE numero END AS chave FROM registry")
def _(f: Fixture) -> DataFrame:
    manual = f.registry.where("id % 100 = 7").select("id", F.array(F.concat(F.lit("m"), F.col("id").cast("string"))).alias("chaves"))
    return K.rulings(_kb_texts(f), manual).select("id", F.explode("chaves").alias("chave"))


@_query("d20_statement_texts", "SELECT tribunal, CAST(numero AS BIGINT) AS numero, vinculante, CAST(id AS BIGINT) AS id FROM statements")
def _(f: Fixture) -> DataFrame:
    text = F.concat(F.lit("Súmula "), F.when(F.col("vinculante"), F.lit("Vinculante ")).otherwise(F.lit("")), F.lit("n. "), F.col("numero").cast("string"), F.lit(" do "), F.col("tribunal"), F.lit("\nTexto."))
    return K.statements(f.statements.select("id", text.alias("texto")))


@_query("d20_article_texts", "SELECT lei, CAST(artigo AS BIGINT) AS artigo, CAST(id AS BIGINT) AS id FROM articles")
def _(f: Fixture) -> DataFrame:
    from .functions.grammar import listed
    from .functions.vocabulary import LAWS

    names = F.create_map(*(F.lit(x) for code, forms in LAWS.items() for x in (code, "Constituição Federal" if code == "CF" else listed(forms)[0])))
    text = F.concat(F.lit("Artigo "), F.col("artigo").cast("string"), F.lit("º da "), F.element_at(names, F.col("lei")), F.lit("\nTexto."))
    return K.articles(f.articles.select("id", text.alias("texto")))


@_query(
    "d21_mentioned_keys",
    f"""SELECT DISTINCT chave FROM (SELECT CASE WHEN forma IN (5, 6) THEN '9'||numero ELSE numero END AS chave FROM offsets WHERE forma IN ({_NUMBERED}) UNION ALL SELECT '1234567-89.2020.8.26.0100'
  UNION ALL SELECT CAST(r.ano AS VARCHAR) FROM offsets o JOIN registry r ON r.id = o.id WHERE o.forma IN (7, 8) UNION ALL SELECT '9373' FROM offsets WHERE forma = 12 AND ord % 3 = 0 UNION ALL SELECT '12345' FROM offsets WHERE forma = 15 AND ord % 3 = 0
  UNION ALL SELECT '8078' FROM offsets WHERE forma = 30 AND ord % 3 > 0 UNION ALL SELECT '1990' FROM offsets WHERE forma = 30 AND ord % 3 = 1
  UNION ALL SELECT CASE ord % 3 WHEN 0 THEN '2020' ELSE '2019' END FROM offsets WHERE forma = 31 AND ord % 3 < 2) x WHERE length(chave) >= 4""",
)
def _(f: Fixture) -> DataFrame:
    """Every key of every text, whether the registry has it or not."""
    return K.mentioned(f.docs)


@_query("e17_short_keys", "SELECT id, chave FROM (SELECT id, CAST(id % 20000 AS VARCHAR) AS chave FROM registry) x WHERE length(chave) <= 4")
def _(f: Fixture) -> DataFrame:
    return K.short_keys(f.registry.select("id", F.array((F.col("id") % 20000).cast("string"), F.col("numero")).alias("chaves")).where("numero LIKE '%.%' OR length(numero) > 4"))


@_query("f14_key_diff", "SELECT id, CASE WHEN id % 3 = 0 THEN numero ELSE '' END AS sairam, CASE WHEN id % 3 = 1 THEN 'x'||id ELSE '' END AS entraram FROM registry WHERE id % 3 < 2")
def _(f: Fixture) -> DataFrame:
    old = f.registry.select("id", F.array("numero").alias("chaves"))
    new = f.registry.where("id % 3 > 0").select("id", F.when(F.col("id") % 3 == 1, F.array("numero", F.concat(F.lit("x"), F.col("id").cast("string")))).otherwise(F.array("numero")).alias("chaves"))
    return K.key_diff(old, new).select("id", F.array_join("sairam", ",").alias("sairam"), F.array_join("entraram", ",").alias("entraram"))


# ---- Model stage


@_query("f11_sentence_labels", f"SELECT CAST(doc AS VARCHAR) AS documento_id, inicio - {len(BEFORE)} AS a, CASE WHEN forma = 14 THEN 'B' WHEN forma = 15 THEN 'C' ELSE 'A' END AS rotulo FROM offsets UNION ALL SELECT documento_id, 0, 'C' FROM docs")
def _(f: Fixture) -> DataFrame:
    return M.labelled(sentences(f.docs), f.gold.where("forma <> 14"), f.gold.where("forma = 14")).select("documento_id", "a", "rotulo")


@_query("e09_escalation", f"SELECT CAST(doc AS VARCHAR) AS documento_id, inicio - {len(BEFORE)} AS a FROM offsets WHERE forma = 15 AND ord % 3 = 1 OR forma = 14")
def _(f: Fixture) -> DataFrame:
    return M.escalated(f.docs, M.read(f.docs), f.gold.where("forma <> 14")).select("documento_id", "a")


@_query("l05_identified_sentences", f"SELECT CAST(doc AS VARCHAR) AS documento_id, inicio - {len(BEFORE)} AS a FROM offsets WHERE forma = 15")
def _(f: Fixture) -> DataFrame:
    return M.identified(f.docs, M.read(f.docs), f.gold.where("forma <> 14")).select("documento_id", "a")


@_query("l06_vague_by_model", "SELECT documento_id, inicio, fim, trecho, tipo FROM gold WHERE forma = 14")
def _(f: Fixture) -> DataFrame:
    return M.vague_by_model(f.docs, M.read(f.docs), f.gold.where("forma <> 14"))


@_query("f17_anchoring", "SELECT documento_id, inicio, fim FROM gold WHERE k % 3 < 2")
def _(f: Fixture) -> DataFrame:
    """Proposals: the phrase itself; with a line break and capitals; and a paraphrase, which must not be found."""
    s = M.read(f.docs)
    g = f.gold.select("documento_id", "inicio", "k", "trecho")
    j = s.join(g, ["documento_id"]).where("inicio >= a AND inicio < b")
    said = F.when(F.col("k") % 3 == 0, F.col("trecho")).when(F.col("k") % 3 == 1, F.upper(F.replace("trecho", F.lit(" "), F.lit("  ")))).otherwise(F.concat(F.lit("paráfrase de "), F.col("trecho")))
    return M.anchored(j.select("documento_id", "a", "frase", said.alias("proposta"))).select("documento_id", "inicio", "fim")


@_query("l02_cached_proposals", "SELECT count(*) FILTER (WHERE k % 2 = 0) AS achadas, count(*) FILTER (WHERE k % 2 = 1) AS perdidas FROM gold")
def _(f: Fixture) -> DataFrame:
    asked = f.gold.select(F.concat("documento_id", F.lit(":"), F.col("k").cast("string"), F.lit(" "), "trecho").alias("frase"), "k")
    cache = asked.where("k % 2 = 0").select(T.cache_key(F.lit("1"), F.lit("m"), F.col("frase")).alias("k"), F.array("frase").alias("v"))
    return M.misses(asked.select("frase"), cache, "1", "m")


# ---- More evaluation, validation and comparison


@_query("g20_tau", _NOISY + "SELECT count(*) AS n, count(*) FILTER (WHERE classe_p = 'real') AS como_real, round(avg(CASE WHEN classe_p = 'real' THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS tau FROM pairs WHERE classe = 'inventada'")
def _(f: Fixture) -> DataFrame:
    return V.fabricated_called_real(_pairs(f)[1])


@_query("o04_variants", """, runs AS (SELECT CASE WHEN CAST(documento_id AS BIGINT) % 2 = 0 THEN 'st' ELSE 'adv' END AS conjunto, v.variante, g.* FROM gold g CROSS JOIN (VALUES ('R'), ('V')) v(variante) WHERE v.variante = 'V' OR g.forma <> 14),
gs AS (SELECT CASE WHEN CAST(documento_id AS BIGINT) % 2 = 0 THEN 'st' ELSE 'adv' END AS conjunto, * FROM gold WHERE k % 10 > 0)
SELECT r.conjunto, r.variante, count(*) AS achadas, count(g.k) AS certas, count(*) - count(g.k) AS espurias, min(t.n) - count(g.k) AS faltam
FROM runs r LEFT JOIN gs g ON g.documento_id = r.documento_id AND g.k = r.k JOIN (SELECT conjunto, count(*) AS n FROM gs GROUP BY conjunto) t ON t.conjunto = r.conjunto GROUP BY r.conjunto, r.variante""")
def _(f: Fixture) -> DataFrame:
    kind = F.when(F.col("documento_id").cast("long") % 2 == 0, "st").otherwise("adv").alias("conjunto")
    columns = ["documento_id", "inicio", "fim", "classe"]
    f.gold = staged(f.gold.select(*columns, "forma", "k"), "gold")  # used several times
    runs = f.gold.where("forma <> 14").select(kind, F.lit("R").alias("variante"), *columns).unionByName(f.gold.select(kind, F.lit("V").alias("variante"), *columns))
    return V.variants(runs, f.gold.where("k % 10 > 0").select(kind, *columns))


@_query("g15_counts_by_set", "SELECT substr(regra, 1, 3) AS familia, classe, count(*) AS n FROM gold GROUP BY 1, 2")
def _(f: Fixture) -> DataFrame:
    return V.counts_by_set(f.gold, "regra", "classe")


@_query("g19_repeated_ids", "SELECT trecho, count(*) AS n FROM gold GROUP BY trecho HAVING count(*) > 1")
def _(f: Fixture) -> DataFrame:
    return V.repeated(f.gold, "trecho")


@_query("k03_novelty", "SELECT id FROM registry WHERE id % 5 = 0 OR id % 7 = 0")
def _(f: Fixture) -> DataFrame:
    """Entries that the baseline lacks, or has with another date."""
    base = f.registry.where("id % 5 <> 0").select("id", F.when(F.col("id") % 7 == 0, F.col("ano") - 1).otherwise(F.col("ano")).alias("ano"))
    return V.novelty(f.registry.select("id", "ano"), base, "id", "ano").select("id")


@_query("a10_documents_as_json", "SELECT documento_id, CAST(count(*) AS BIGINT) AS n, CAST(count(id_canonico) AS BIGINT) AS com_id, CAST(sum(inicio) AS BIGINT) AS s, md5(string_agg(trecho, '|' ORDER BY inicio)) AS h FROM gold GROUP BY documento_id")
def _(f: Fixture) -> DataFrame:
    from .sources.files import documents_as_json

    found = f.gold.select("documento_id", "inicio", "fim", "tipo", "classe", "regra", "id_canonico", F.lit(1.0).alias("confianca"))
    kind = "documento_id string, citacoes array<struct<inicio:bigint,fim:bigint,trecho:string,tipo:string,classificacao:string,resolucao:struct<id_canonico:string>,confianca:double>>"
    back = documents_as_json(f.docs, found).select(F.from_json("json", kind).alias("j")).select("j.*").where(F.size("citacoes") > 0)
    text = F.md5(F.encode(F.array_join(F.transform("citacoes", lambda c: c["trecho"]), "|"), "UTF-8"))
    return back.select("documento_id", F.size("citacoes").cast("long").alias("n"), F.size(F.filter("citacoes", lambda c: c["resolucao"].isNotNull())).cast("long").alias("com_id"), F.aggregate("citacoes", F.lit(0).cast("long"), lambda a, c: a + c["inicio"]).alias("s"), text.alias("h"))


# ---- Noise that keys must survive


@_query("n06_letter_noise", "SELECT id, numero AS chave FROM registry WHERE length(numero) > 4")
def _(f: Fixture) -> DataFrame:
    noisy = N.letter_for_digit(F.col("numero"), F.col("id"))
    return f.registry.where("length(numero) > 4").select("id", T.number_key(noisy).alias("chave"))


@_query("n16_joint_noise", "SELECT id, numero AS chave FROM registry WHERE numero LIKE '%.%'")
def _(f: Fixture) -> DataFrame:
    return f.registry.where("numero LIKE '%.%'").select("id", T.number_key(N.broken_joint(F.col("numero"), F.col("id"))).alias("chave"))


@_query("n04_plain_format", "SELECT id, left(numero, 3)||'.'||substr(numero, 4) AS escrito, numero AS chave FROM registry WHERE length(numero) = 6 AND numero NOT LIKE '%.%'")
def _(f: Fixture) -> DataFrame:
    written = N.thousands(F.col("numero"))
    return f.registry.where("length(numero) = 6 AND numero NOT LIKE '%.%'").select("id", written.alias("escrito"), T.number_key(written).alias("chave"))


from . import catalog_extra  # noqa: E402, F401
