"""More queries: files, model stage, evaluation, generators. See catalog.py."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _KB_TEXTS, _NOISY, _PACK, _kb, _kb_texts, _noisy, _pairs, _query
from .functions import noise as N
from .functions import text as T
from .functions.families import numbered
from .operators import decisions as D
from .operators import evaluation as V
from .operators import extraction as E
from .operators import intervals as I
from .operators import kb as K
from .operators import models as M
from .operators import proposals as S
from .operators.sentences import sentences
from .plans import generators as G
from .plans import kb_store
from .plans.fixture import AFTER, BEFORE, HEAD, Fixture
from .plans.sets import set_names
from .plans.staging import shared_dir, staged
from .sources import files
from .streaming import watch

_LEVEL = "CASE WHEN CAST(documento_id AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END"


def _path(f: Fixture, name: str) -> str:
    return f"{shared_dir(f.spark)}/{name}-{uuid4().hex}"


def _levels(f: Fixture) -> DataFrame:
    return f.docs.select("documento_id", F.when(F.col("documento_id").cast("long") % 3 == 0, 2).otherwise(1).alias("nivel"))


# ---- Sources and sinks


@_query("a04_kb_texts", f"SELECT id, md5(texto) AS h FROM ({_KB_TEXTS}) x")
def _(f: Fixture) -> DataFrame:
    path = _path(f, "kb-source")
    _kb_texts(f).write.parquet(path)
    return files.kb_texts(f.spark, path).select("id", F.md5(F.encode("texto", "UTF-8")).alias("h"))


@_query("a06_all_strings", f"SELECT documento_id, CASE WHEN CAST(documento_id AS BIGINT) % 4 = 0 THEN '' WHEN CAST(documento_id AS BIGINT) % 4 = 1 THEN 'NA' ELSE citacoes END AS citacoes FROM ({_PACK}) x")
def _(f: Fixture) -> DataFrame:
    """Empty cells stay empty, NA stays text, nothing becomes null."""
    path, k = _path(f, "cells"), F.col("documento_id").cast("long") % 4
    files.write_submission(I.packed(f.gold, f.docs).withColumn("citacoes", F.when(k == 0, "").when(k == 1, "NA").otherwise(F.col("citacoes"))), path)
    return files.read_strings(f.spark, path, "documento_id citacoes")


@_query("a07_sample_ids", "SELECT documento_id FROM docs")
def _(f: Fixture) -> DataFrame:
    path = _path(f, "sample")
    files.write_submission(f.docs.select("documento_id", F.lit("-").alias("citacoes")), path)
    return files.read_ids(f.spark, path)


@_query("a08_json_lines", "SELECT CAST(id AS VARCHAR) AS k, numero||'|'||relator AS v FROM registry")
def _(f: Fixture) -> DataFrame:
    path = _path(f, "lines")
    files.write_lines(f.registry.select(F.col("id").cast("string").alias("k"), F.array("numero", "relator").alias("v")), path)
    return files.read_lines(f.spark, path, files.CACHE).select("k", F.array_join("v", "|").alias("v"))


@_query("a11_submission_csv", _PACK)
def _(f: Fixture) -> DataFrame:
    path = _path(f, "submission")
    files.write_submission(I.packed(f.gold, f.docs), path, one_file=True)
    return files.read_strings(f.spark, path, "documento_id citacoes", lines_within=False)


@_query("a12_vague_gold", f"SELECT {_LEVEL} AS nivel, documento_id, 'v'||(row_number() OVER (PARTITION BY documento_id ORDER BY inicio) - 1) AS citacao_id, inicio, fim, trecho, tipo FROM gold WHERE forma = 14")
def _(f: Fixture) -> DataFrame:
    path = _path(f, "vague")
    files.write_vague_gold(f.gold.where("forma = 14"), path, F.when(F.col("documento_id").cast("long") % 3 == 0, 2).otherwise(1))
    return files.read_gold(f.spark, path).select("nivel", "documento_id", "citacao_id", "inicio", "fim", "trecho", "tipo")


@_query("a14_growing_cache", "SELECT CAST(id AS VARCHAR) AS k, CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS v FROM registry WHERE id % 3 < 2")
def _(f: Fixture) -> DataFrame:
    """Answers are added twice; a key that is there already keeps the first answer in order."""
    path, key = _path(f, "cache"), F.col("id").cast("string").alias("k")
    files.remember(f.registry.where("id % 3 = 0").select(key, F.array(F.lit("a")).alias("v")), path)
    files.remember(f.registry.where("id % 3 < 2").select(key, F.array(F.lit("b")).alias("v")), path)
    return files.read_cache(f.spark, path).select("k", F.array_join("v", "|").alias("v"))


@_query("a17_stored_kb", "SELECT numero AS chave, id FROM registry WHERE length(numero) > 1")
def _(f: Fixture) -> DataFrame:
    """Built and stored once; the second time it is read."""
    texts = _kb_texts(f).withColumn("natureza", F.lit("acordao"))
    folder = _path(f, "kb-store")
    kb_store.load(texts, folder)
    return kb_store.load(texts, folder).keys.select("chave", "id")


@_query("a18_key_dump", "SELECT id, CASE WHEN id % 100 = 7 THEN 'a,b' ELSE numero END AS chaves FROM registry WHERE length(numero) > 1 OR id % 100 = 7")
def _(f: Fixture) -> DataFrame:
    path = _path(f, "dump")
    manual = f.registry.where("id % 100 = 7").select("id", F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("chaves"))
    files.write_lines(K.key_dump(K.rulings(_kb_texts(f), manual)), path)
    return files.read_lines(f.spark, path, "id bigint, chaves array<string>").select("id", F.array_join("chaves", ",").alias("chaves")).where("chaves <> ''")


@_query("a24_court_of_class", "SELECT c AS classe, t AS tribunal FROM (VALUES ('ADPF','STF'),('ADC','STF'),('ADO','STF'),('Ext','STF'),('ACO','STF'),('STA','STF'),('RE','STF'),('ARE','STF'),('ADI','STF'),('REsp','STJ'),('AREsp','STJ'),('RHC','STJ'),('RMS','STJ'),('EDiv','STJ'),('SLS','STJ'),('CC','STJ'),('REspE','TSE'),('AREspE','TSE'),('RCED','TSE'),('AIJE','TSE'),('Rp','TSE'),('PC','TSE'),('RR','TST'),('ARR','TST'),('AIRR','TST'),('RRAg','TST'),('AgARR','TST'),('E','TST'),('APL','STM'),('RSE','STM'),('EINul','STM'),('CorPar','STM'),('CJ','STM')) v(c, t)")
def _(f: Fixture) -> DataFrame:
    from .functions.vocabulary import COURT_OF_CLASS

    return f.spark.createDataFrame(list(COURT_OF_CLASS.items()), "classe string, tribunal string")


_GOLDEN = [
    ("7000761-84 2021 7 00 0000", "7000761-84.2021.7.00.0000"), ("7001184-1520197000000", "7001184-15.2019.7.00.0000"), ("533-80. 2012.6.13.0029", "533-80.2012.6.13.0029"),
    ("70007BO--27.2020.7.00.0000", "7000780-27.2020.7.00.0000"), ("8gg24", "89924"), ("7000966--84.2019.7.00.OO00", "7000966-84.2019.7.00.0000"), ("1.741.784", "1741784"), ("21737l8", "2173718"),
    ("1.45g.779", "1459779"), ("1.528.4S5", "1528455"), ("170076O", "1700760"), ("l.741.784", "1741784"), ("1 307 026", "1307026"), ("7000171‑39.2023.7.00.0000", "7000171-39.2023.7.00.0000"), ("000123", "123"),
]


@_query("a25_golden_keys", "SELECT e AS escrito, c AS chave FROM (VALUES " + ", ".join(f"('{e}', '{c}')" for e, c in _GOLDEN) + ") v(e, c)")
def _(f: Fixture) -> DataFrame:
    """The number that a pattern finds in the written form, and its key."""
    from .functions.grammar import NUMBER

    df = f.spark.createDataFrame([(e,) for e, _ in _GOLDEN], "escrito string")
    return df.select("escrito", T.number_key(F.regexp_extract("escrito", f"^({NUMBER})$", 1)).alias("chave"))


@_query("a26_spans_by_document", "SELECT documento_id, string_agg(inicio||'-'||fim, ',' ORDER BY inicio) AS spans FROM gold GROUP BY documento_id")
def _(f: Fixture) -> DataFrame:
    one = lambda s: F.concat(s["inicio"].cast("string"), F.lit("-"), s["fim"].cast("string"))
    return I.as_arrays(f.gold).select("documento_id", F.array_join(F.transform("spans", one), ",").alias("spans"))


@_query("b21_file_hashes", "SELECT CAST(strlen(texto) + 1 AS BIGINT) AS bytes, sha256(texto||chr(10)) AS sha256 FROM docs")
def _(f: Fixture) -> DataFrame:
    path = _path(f, "hashed")
    files.write_documents(f.docs, path)
    return files.file_hashes(f.spark, path, "*.txt").select("bytes", "sha256")


# ---- Scalars and structure


@_query("b15_type_of_source", "SELECT documento_id, k, tipo = 'lei' AS lei FROM gold WHERE forma = 14")
def _(f: Fixture) -> DataFrame:
    return f.gold.where("forma = 14").select("documento_id", "k", E.about_law(F.col("trecho")).alias("lei"))


@_query("b24_missing_message", "SELECT count(*) AS n, string_agg(d, ',' ORDER BY d) FILTER (WHERE r <= 3) AS exemplos FROM (SELECT documento_id AS d, row_number() OVER (ORDER BY documento_id) AS r FROM docs WHERE documento_id NOT IN (SELECT documento_id FROM gold WHERE k = 30)) x")
def _(f: Fixture) -> DataFrame:
    missing = V.missing_ids(f.docs, f.gold.where("k = 30"))[0]
    return V.missing_message(missing).select("n", F.array_join("exemplos", ",").alias("exemplos"))


@_query("b25_set_names", "SELECT id, 'dev,'||(SELECT string_agg('st'||i, ',' ORDER BY i) FROM generate_series(1, CAST(id % 9 + 1 AS BIGINT)) t(i))||',adv'||id AS nomes FROM registry")
def _(f: Fixture) -> DataFrame:
    spec = F.concat(F.lit("dev, st1-"), (F.col("id") % 9 + 1).cast("string"), F.lit(",,adv"), F.col("id").cast("string"))
    return f.registry.select("id", F.array_join(set_names(spec), ",").alias("nomes"))


_CHAT = "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"


@_query("b26_chat_prompt", "SELECT documento_id, k, md5('" + _CHAT[0] + "'||trecho||'" + _CHAT[1] + "') AS h FROM gold")
def _(f: Fixture) -> DataFrame:
    return f.gold.select("documento_id", "k", F.md5(F.encode(M.chat_prompt("S", [("q", "a")], F.col("trecho")), "UTF-8")).alias("h"))


_CLOSED = "CASE WHEN CAST(documento_id AS BIGINT) % 2 = 0 THEN 'Ante o exposto, '||texto ELSE texto||' Termos em que, pede deferimento.' END"


@_query("c04_closing", f"SELECT documento_id, CASE WHEN CAST(documento_id AS BIGINT) % 2 = 0 THEN length({_CLOSED}) ELSE length(texto) + 1 END AS fecho FROM docs")
def _(f: Fixture) -> DataFrame:
    """A closing formula counts beyond three fifths of the text only."""
    text = F.when(F.col("documento_id").cast("long") % 2 == 0, F.concat(F.lit("Ante o exposto, "), "texto")).otherwise(F.concat("texto", F.lit(" Termos em que, pede deferimento.")))
    return f.docs.withColumn("t", text).select("documento_id", M.closing_start(F.col("t")).alias("fecho"))


@_query("c05_titles", "SELECT id, id % 3 < 2 AS titulo FROM registry")
def _(f: Fixture) -> DataFrame:
    line = F.when(F.col("id") % 3 == 0, "II — DO MÉRITO RECURSAL").when(F.col("id") % 3 == 1, F.concat(F.lit("RAZÕES, "), F.upper("relator"))).otherwise(F.concat(F.lit("DO MÉRITO de "), "relator"))
    return f.registry.select("id", M.is_title(line).alias("titulo"))


@_query(
    "c08_open_window",
    "SELECT documento_id, de, ate, faltam FROM (SELECT documento_id, lag(fim) OVER w AS de, inicio AS ate, k - lag(k) OVER w - 1 AS faltam FROM (SELECT * FROM gold WHERE k % 4 < 3) WINDOW w AS (PARTITION BY documento_id ORDER BY k)) x WHERE faltam > 0 "
    "UNION ALL SELECT d.documento_id, coalesce(m.fim, 0), length(d.texto), 100 - coalesce(m.k, -1) - 1 FROM docs d LEFT JOIN (SELECT documento_id, max(k) AS k, max(fim) AS fim FROM gold WHERE k % 4 < 3 GROUP BY documento_id) m ON m.documento_id = d.documento_id WHERE 100 - coalesce(m.k, -1) - 1 > 0",
)
def _(f: Fixture) -> DataFrame:
    """Also the stretch after the last numbered span, if there should be a hundred."""
    ends = f.docs.select("documento_id", F.length("texto").cast("bigint").alias("fim_texto"), F.lit(100).cast("bigint").alias("n"))
    return I.gaps(f.gold.where("k % 4 < 3").select("documento_id", "inicio", "fim", "k"), ends)


@_query("d15_source_phrases", f"SELECT CAST(doc AS VARCHAR) AS documento_id, inicio - {len(BEFORE)} AS a, CAST({len(BEFORE)} AS BIGINT) AS inicio, trecho FROM offsets WHERE forma = 14")
def _(f: Fixture) -> DataFrame:
    g = f.gold.where("forma = 14").select("documento_id", "inicio")
    s = M.read(f.docs).join(g.withColumnRenamed("inicio", "i_"), "documento_id").where("i_ >= a AND i_ < b")
    return s.withColumn("s", M.source_phrase(F.col("frase"))).select("documento_id", "a", F.col("s.inicio").alias("inicio"), F.col("s.trecho").alias("trecho"))


@_query("d16_cues", "SELECT count(*) FILTER (WHERE forma = 15 AND ord % 3 = 0) AS oab, count(*) FILTER (WHERE forma = 15 AND ord % 3 = 2) AS folhas, count(*) FILTER (WHERE forma = 15 AND ord % 3 = 1) AS autos FROM offsets")
def _(f: Fixture) -> DataFrame:
    """Sentences without a citation by what they hold: bar and leaf numbers are no cue, a long number is."""
    s = f.offsets.where("forma = 15").select(F.concat(F.lit(BEFORE), "trecho", F.lit(AFTER)).alias("frase"))
    n = F.size(M.cues(F.col("frase")))
    hit = lambda start, want: F.count_if(F.col("frase").contains(start) & ((F.col("n") > 0) == F.lit(want)))
    return s.withColumn("n", n).agg(hit("OAB", False).alias("oab"), hit("fls.", False).alias("folhas"), hit("Autos", True).alias("autos"))


# ---- Proposals


@_query("l08_decided_proposals", "SELECT documento_id, inicio, fim, tipo, classe, CASE WHEN forma = 14 THEN 's2_vaga' ELSE regra END AS regra, CAST(id_canonico AS BIGINT) AS id_canonico FROM gold")
def _(f: Fixture) -> DataFrame:
    """Every planted phrase as a proposal, and the document's own number, which is turned down."""
    own = f.offsets.where("forma = 15 AND ord % 3 = 1").select(F.col("doc").cast("string").alias("documento_id"), "inicio", "fim")
    asked = staged(f.gold.select("documento_id", "inicio", "fim").unionByName(own), "asked")
    return S.decide_proposals(staged(f.docs, "docs"), asked, _kb(f), True).select("documento_id", "inicio", "fim", "tipo", "classe", "regra", "id_canonico")


@_query("l09_applied_proposals", "SELECT documento_id, inicio, fim FROM gold WHERE k % 3 > 0")
def _(f: Fixture) -> DataFrame:
    """Of two proposals for one place the first stands; a place that is taken stays as it is."""
    g = f.gold = staged(f.gold.select("documento_id", "inicio", "fim", "k", "tipo", "classe"), "gold")  # used several times
    wide = g.select("documento_id", (F.col("inicio") - 3).alias("inicio"), "fim", "k", "tipo", "classe")
    decided = g.withColumn("n", F.col("k") * 2).unionByName(wide.withColumn("n", F.col("k") * 2 + 1))
    order = decided.select("documento_id", "inicio", "fim", F.col("n").alias("vez"))
    decided = decided.select("documento_id", F.col("inicio").alias("p_inicio"), F.col("fim").alias("p_fim"), "inicio", "fim", "tipo", "classe")
    return S.applied(decided, order, f.gold.where("k % 3 = 0")).select("documento_id", "inicio", "fim")


@_query("h08_best_cover", "SELECT documento_id, inicio, fim FROM gold WHERE fim - inicio >= 0.8 * (fim - inicio + 6)")
def _(f: Fixture) -> DataFrame:
    inner = f.gold.select("documento_id", F.col("inicio") + 1, F.col("fim") - 1).toDF("documento_id", "inicio", "fim").withColumn("ordem", F.lit(0))
    spans = f.gold.select("documento_id", "inicio", "fim", F.lit(1).alias("ordem")).unionByName(inner)
    snippets = f.gold.select("documento_id", (F.col("inicio") - 3).alias("inicio"), (F.col("fim") + 3).alias("fim"))
    return I.best_cover(spans, snippets).select("documento_id", "inicio", "fim")


@_query("j02_suspect_sentences", f"SELECT CAST(doc AS VARCHAR) AS documento_id, inicio - {len(BEFORE)} AS a FROM offsets WHERE forma IN (14, 15) AND NOT (forma = 15 AND ord % 3 <> 1) OR forma = 15")
def _(f: Fixture) -> DataFrame:
    """Sentences with an uncovered cue, and those that a scorer holds for citations; each once."""
    taken, s = staged(f.gold.where("forma <> 14").select("documento_id", "inicio", "fim"), "taken"), staged(M.read(f.docs), "sentences")
    return V.in_either(M.escalated(f.docs, s, taken), M.identified(f.docs, s, taken)).select("documento_id", "a")


# ---- Joins and sets


@_query("f12_documents_of_either", "SELECT coalesce(g.documento_id, p.documento_id) AS documento_id, coalesce(g.n, 0) AS n_gold, coalesce(p.n, 0) AS n_pred FROM (SELECT documento_id, count(*) AS n FROM gold WHERE CAST(documento_id AS BIGINT) % 3 > 0 GROUP BY documento_id) g FULL JOIN (SELECT documento_id, count(*) AS n FROM gold WHERE CAST(documento_id AS BIGINT) % 3 < 2 GROUP BY documento_id) p ON p.documento_id = g.documento_id")
def _(f: Fixture) -> DataFrame:
    k = F.col("documento_id").cast("long") % 3
    return V.documents_of_either(f.gold.where(k > 0), f.gold.where(k < 2))


@_query("f13_completed", "SELECT d.documento_id, CASE WHEN g.documento_id IS NULL THEN '-' ELSE 'x' END AS citacoes FROM docs d LEFT JOIN (SELECT documento_id FROM gold WHERE k = 30) g ON g.documento_id = d.documento_id")
def _(f: Fixture) -> DataFrame:
    return V.completed(f.gold.where("k = 30").select("documento_id", F.lit("x").alias("citacoes")), f.docs)


@_query("f20_any_gold_id", "SELECT id, id % 4 < 2 AS certo FROM registry")
def _(f: Fixture) -> DataFrame:
    ids = F.concat_ws(":", F.col("id").cast("string"), (F.col("id") + 1).cast("string"))
    return f.registry.select("id", V.right_id(ids, F.col("id") + F.col("id") % 4).alias("certo"))


@_query("f21_names_of_ids", "SELECT id, tribunal AS onde, CAST(numero AS VARCHAR) AS n FROM statements UNION ALL SELECT id, lei, CAST(artigo AS VARCHAR) FROM articles")
def _(f: Fixture) -> DataFrame:
    ids = f.gold.where("id_canonico IS NOT NULL").select(F.col("id_canonico").alias("id")).union(f.statements.select("id")).union(f.articles.select("id")).distinct()
    return D.names_of(ids, _kb(f)).select("id", F.coalesce("tribunal", "lei").alias("onde"), F.coalesce("numero", "artigo").cast("string").alias("n"))


@_query("j03_gold_with_vague", "SELECT documento_id, inicio, fim, classe FROM gold")
def _(f: Fixture) -> DataFrame:
    columns = ["documento_id", "inicio", "fim", "classe"]
    docs = staged(f.docs, "docs")
    vague = E.vague(docs, E.extracted(docs)).withColumn("classe", F.lit("incompleta"))
    return f.gold.where("forma <> 14").select(*columns).unionByName(vague.select(*columns))


@_query("j06_known_keys", "SELECT numero AS chave FROM registry UNION SELECT numero FROM offsets WHERE forma NOT IN (5, 6) AND length(numero) >= 4 AND FALSE")
def _(f: Fixture) -> DataFrame:
    """Keys of the index, and of texts that mention the numbers of rulings: together no others than the index has."""
    texts = f.registry.where("length(numero) >= 6").select(F.concat(F.lit("autos "), "numero", F.lit("; fim")).alias("texto"))
    return K.known_keys(_kb(f).keys, texts)


@_query("g17_wholly_unique", "SELECT id FROM registry r JOIN (SELECT numero, count(*) AS n FROM registry GROUP BY numero) c ON c.numero = r.numero WHERE c.n = 1")
def _(f: Fixture) -> DataFrame:
    return D.wholly_unique(_kb(f))


@_query("e18_without_keys", "SELECT id FROM registry WHERE id % 50 = 3")
def _(f: Fixture) -> DataFrame:
    texts = f.registry.select("id", "tribunal", F.when(F.col("id") % 50 == 3, "ACÓRDÃO sem número algum").otherwise(F.concat(F.lit("ACÓRDÃO Nº 12345"), F.col("id").cast("string"))).alias("texto")).withColumn("tribunal", F.lit("STJ"))
    return K.without_keys(K.rulings(texts))


# ---- Evaluation


@_query("g04_levels", f"SELECT documento_id, {_LEVEL} AS nivel FROM docs WHERE documento_id IN (SELECT documento_id FROM gold)")
def _(f: Fixture) -> DataFrame:
    return V.levels(f.gold.select("documento_id").join(_levels(f), "documento_id"))


_BY_LEVEL = _NOISY + f""", lv AS (SELECT documento_id, {_LEVEL} AS nivel FROM docs),
cl AS (SELECT nivel, classe, sum(g) AS g, sum(p) AS p, sum(t) AS t FROM (
  SELECT nivel, classe, 1 AS g, 0 AS p, 0 AS t FROM gold JOIN lv USING (documento_id) UNION ALL SELECT nivel, classe, 0, 1, 0 FROM noisy JOIN lv USING (documento_id)
  UNION ALL SELECT nivel, classe, 0, 0, 1 FROM pairs JOIN lv USING (documento_id) WHERE acerto = 1) x GROUP BY nivel, classe),
mf AS (SELECT nivel, avg(2.0::DOUBLE * t / greatest(1, g + p)) AS macro_f1 FROM cl WHERE g > 0 GROUP BY nivel),
st AS (SELECT nivel, coalesce(avg(CASE WHEN classe = 'inventada' THEN CASE WHEN classe_p = 'real' THEN 1.0::DOUBLE ELSE 0.0 END END), 0) AS tau, avg((0.9::DOUBLE - acerto) * (0.9::DOUBLE - acerto)) AS brier FROM pairs JOIN lv USING (documento_id) GROUP BY nivel),
su AS (SELECT nivel, round(macro_f1, 6) AS macro_f1, round(tau, 6) AS tau, round(brier, 9) AS brier, round(macro_f1 * (1 + 0.1::DOUBLE * (1 - brier)), 6) AS score FROM mf JOIN st USING (nivel))
"""


@_query("o03_level_summary", _BY_LEVEL + "SELECT * FROM su")
def _(f: Fixture) -> DataFrame:
    found, pairs = _pairs(f)
    return V.summary(f.gold, found, pairs, _levels(f))


@_query("g20_final_score", _BY_LEVEL + "SELECT round(sum(nivel * score) / sum(nivel), 6) AS final, max(tau) AS tau FROM su")
def _(f: Fixture) -> DataFrame:
    found, pairs = _pairs(f)
    return V.final_score(V.summary(f.gold, found, pairs, _levels(f)))


_MODEL_RULE = "CASE WHEN regra IN ('tema', 'lei_real') THEN 's2_'||regra ELSE regra END"


@_query(
    "g07_compared",
    _NOISY.replace("id_canonico, regra, 0.9", f"id_canonico, {_MODEL_RULE} AS regra, 0.9")
    + """, sp AS (SELECT n.* FROM noisy n LEFT JOIN pairs p ON p.documento_id = n.documento_id AND p.i_ = n.inicio AND p.f_ = n.fim LEFT JOIN pairs q ON q.documento_id = n.documento_id AND n.inicio >= q.inicio AND n.fim <= q.fim WHERE p.k IS NULL AND q.k IS NULL)
SELECT count(*) FILTER (WHERE acerto = 1) AS certas, count(*) FILTER (WHERE acerto = 0) AS classe_errada, (SELECT count(*) FROM sp) AS fp, (SELECT count(*) FROM gold) - count(*) AS fn,
count(*) FILTER (WHERE regra_p LIKE 's2_%' AND acerto = 1) AS neurais_certas, count(*) FILTER (WHERE regra_p LIKE 's2_%' AND acerto = 0) + (SELECT count(*) FROM sp WHERE regra LIKE 's2_%') AS neurais_erradas FROM pairs""",
)
def _(f: Fixture) -> DataFrame:
    f.gold = staged(f.gold, "gold")  # used several times
    found = _noisy(f).withColumn("regra", F.expr(_MODEL_RULE))
    pairs = staged(V.matched(I.iou_pairs(f.gold.select("documento_id", "k", "inicio", "fim", "classe", "id_canonico"), found), found), "pairs")
    return V.compared(pairs, f.gold, I.spurious(found, pairs))


@_query(
    "g05_spurious_by_rule",
    _NOISY + """, sp AS (SELECT n.* FROM noisy n LEFT JOIN pairs p ON p.documento_id = n.documento_id AND p.i_ = n.inicio AND p.f_ = n.fim LEFT JOIN pairs q ON q.documento_id = n.documento_id AND n.inicio >= q.inicio AND n.fim <= q.fim WHERE p.k IS NULL AND q.k IS NULL)
SELECT regra AS regra_p, CAST(sum(n) AS BIGINT) AS n, CAST(sum(a) AS BIGINT) AS acertos, CAST(sum(e) AS BIGINT) AS espurias FROM (SELECT regra_p AS regra, 1 AS n, acerto AS a, 0 AS e FROM pairs UNION ALL SELECT regra, 0, 0, 1 FROM sp) x GROUP BY regra""",
)
def _(f: Fixture) -> DataFrame:
    found, pairs = _pairs(f)
    return V.rule_counts(pairs, I.spurious(found, pairs))


_SCORED = """, sc AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN 'dev' ELSE 'adv' END AS familia, CASE l_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS rotulo, l_linenumber % 2 = 0 AS s1_cobre,
  (l_partkey * 37 % 50) / 100.0::DOUBLE AS a, (l_orderkey * 13 % 50) / 100.0::DOUBLE AS b FROM lineitem),
m AS (SELECT *, 1 - a - b AS c, a + b AS pc, rotulo <> 'C' AS y, a + b >= 0.5 AS flag FROM sc)"""


@_query(
    "o06_classifier_metrics",
    _SCORED + """, ec AS (SELECT familia, round(sum(k * abs(q - t)) / sum(k), 4) AS ece FROM (SELECT familia, count(*) AS k, avg(pc) AS q, avg(CASE WHEN y THEN 1.0::DOUBLE ELSE 0.0 END) AS t FROM m GROUP BY familia, least(CAST(floor(pc * 15) AS BIGINT), 14)) x GROUP BY familia)
SELECT m.familia, count(*) AS n, round(avg(CASE WHEN CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END = rotulo THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS acuracia_3,
round(count(*) FILTER (WHERE flag AND y)::DOUBLE / greatest(1, count(*) FILTER (WHERE flag)), 4) AS precisao, round(count(*) FILTER (WHERE flag AND y)::DOUBLE / greatest(1, count(*) FILTER (WHERE y)), 4) AS recall,
round(count(*) FILTER (WHERE flag AND y AND NOT s1_cobre)::DOUBLE / greatest(1, count(*) FILTER (WHERE y AND NOT s1_cobre)), 4) AS recall_residual, count(*) FILTER (WHERE y AND NOT s1_cobre) AS n_residual_pos,
round(count(*) FILTER (WHERE flag AND NOT s1_cobre)::DOUBLE / greatest(1, count(*) FILTER (WHERE NOT s1_cobre)), 4) AS escalonamento,
round(2.0::DOUBLE * count(*) FILTER (WHERE flag AND y) / greatest(1, count(*) FILTER (WHERE flag) + count(*) FILTER (WHERE y)), 4) AS f1, ec.ece FROM m JOIN ec ON ec.familia = m.familia GROUP BY m.familia, ec.ece""",
)
def _(f: Fixture) -> DataFrame:
    a, b = F.col("l_partkey") * 37 % 50 / 100.0, F.col("l_orderkey") * 13 % 50 / 100.0
    p = F.struct(a.alias("A"), b.alias("B"), (1 - a - b).alias("C")).alias("p")
    label = F.when(F.col("l_suppkey") % 3 == 0, "A").when(F.col("l_suppkey") % 3 == 1, "B").otherwise("C")
    return V.classifier_metrics(f.lineitem.select(F.when(F.col("l_partkey") % 3 == 0, "dev").otherwise("adv").alias("familia"), label.alias("rotulo"), p, (F.col("l_linenumber") % 2 == 0).alias("s1_cobre")))


@_query("g13_determinism", "SELECT 0.25::DOUBLE AS delta_max, count(*) AS n FROM registry")
def _(f: Fixture) -> DataFrame:
    def scores(shift: float) -> DataFrame:
        a = F.when(F.col("id") % 10 == 0, 0.5 + shift).otherwise(0.5)
        return f.registry.select(F.col("id").cast("string").alias("frase"), F.struct(a.alias("A"), F.lit(0.5).alias("B"), F.lit(0.0).alias("C")).alias("p"))

    return V.determinism(scores(0.0), scores(0.25))


@_query("g16_counts_by_level", f"SELECT nivel, count(*) AS n, CASE nivel WHEN 1 THEN 17 ELSE 16 END AS esperado, count(*) = CASE nivel WHEN 1 THEN 17 ELSE 16 END AS ok FROM (SELECT {_LEVEL} AS nivel FROM gold WHERE forma = 14) x GROUP BY nivel")
def _(f: Fixture) -> DataFrame:
    return V.counts_against(f.gold.where("forma = 14").join(_levels(f), "documento_id"), "nivel", {1: 17, 2: 16})


_DRAW = "(CAST(documento_id AS BIGINT) * 1103515 + k * 12345) % 2147483648"


@_query("g23_quota_sample", f"SELECT documento_id, k, classe FROM (SELECT *, row_number() OVER (PARTITION BY classe ORDER BY {_DRAW}, documento_id, k) AS r FROM gold) x WHERE r <= CASE classe WHEN 'real' THEN 35 WHEN 'inventada' THEN 25 ELSE 40 END")
def _(f: Fixture) -> DataFrame:
    draw = (F.col("documento_id").cast("long") * 1103515 + F.col("k") * 12345) % 2147483648
    return V.quota_sample(f.gold, "classe", {"real": 35, "inventada": 25, "incompleta": 40}, draw, ["documento_id", "k"]).select("documento_id", "k", "classe")


@_query("e15_submission_verdict", "SELECT count(*) AS documentos, max(n) AS maximo, round(avg(n), 6) AS media, 0::BIGINT AS repetidos, 1::BIGINT AS faltam, 1::BIGINT AS sobram, FALSE AS ok FROM (SELECT d.documento_id, count(g.k) AS n FROM docs d LEFT JOIN gold g ON g.documento_id = d.documento_id GROUP BY d.documento_id) x")
def _(f: Fixture) -> DataFrame:
    """One expected document is missing and one is unknown, so the verdict is no."""
    first = f.docs.agg(F.min("documento_id").alias("documento_id"))
    expected = f.docs.select("documento_id").join(first, "documento_id", "left_anti").unionByName(f.spark.createDataFrame([("falta",)], "documento_id string"))
    figures = V.verdict(V.validated(I.packed(f.gold, f.docs), expected))
    return figures.select("documentos", F.col("maximo").cast("long").alias("maximo"), "media", "repetidos", "faltam", "sobram", "ok")


@_query(
    "e16_vague_audit",
    """, w AS (SELECT documento_id, de, ate, faltam FROM (SELECT documento_id, lag(fim) OVER x AS de, inicio AS ate, k - lag(k) OVER x - 1 AS faltam FROM gold WHERE forma <> 14 WINDOW x AS (PARTITION BY documento_id ORDER BY k)) y WHERE faltam > 0),
v AS (SELECT * FROM gold WHERE forma = 14 AND k % 5 > 0), h AS (SELECT w.documento_id, w.de, w.ate, w.faltam, count(v.k) AS n FROM w LEFT JOIN v ON v.documento_id = w.documento_id AND v.inicio >= w.de AND v.fim <= w.ate GROUP BY 1, 2, 3, 4)
SELECT documento_id, de, ate, faltam, n FROM h WHERE n <> faltam UNION ALL SELECT v.documento_id, v.inicio, v.fim, NULL, 1 FROM v LEFT JOIN w ON w.documento_id = v.documento_id AND v.inicio >= w.de AND v.fim <= w.ate WHERE w.de IS NULL""",
)
def _(f: Fixture) -> DataFrame:
    windows = I.gaps(f.gold.where("forma <> 14").select("documento_id", "inicio", "fim", "k"))
    return V.vague_audit(f.gold.where("forma = 14 AND k % 5 > 0").select("documento_id", "inicio", "fim"), windows)


# ---- The watcher


@_query("k05_variants", "SELECT 'R' AS variante, count(*) FILTER (WHERE forma <> 14) AS citacoes, (SELECT count(*) FROM docs) AS documentos FROM gold UNION ALL SELECT 'V', count(*), (SELECT count(*) FROM docs) FROM gold")
def _(f: Fixture) -> DataFrame:
    """The handler's figures for two variants over all documents."""
    said = watch.run_variants(f.docs, _kb(f), _path(f, "variants"), watch.variants())
    return f.spark.createDataFrame([(s["variante"], s["citacoes"], s["documentos"]) for s in said], "variante string, citacoes long, documentos long")


# ---- Generators: what they write is found again by the rules


def _found_again(f: Fixture, rows: DataFrame) -> DataFrame:
    """rows (n, trecho) as sentences of documents of their own -> decisions with n."""
    docs = rows.select(F.col("n").cast("string").alias("documento_id"), F.concat(F.lit(HEAD + BEFORE), "trecho", F.lit(AFTER)).alias("texto"))
    return D.decide(staged(E.extracted(docs), "spans"), _kb(f)).select(F.col("documento_id").cast("long").alias("n"), "classe", "regra", "id_canonico")


def _seeded(df: DataFrame) -> DataFrame:
    return df.withColumn("seed", F.col("id") * 31 + 7)


@_query("n01_header_chain", "SELECT id, classe FROM registry WHERE tribunal <> 'TST'")
def _(f: Fixture) -> DataFrame:
    return _kb_texts(f).where("tribunal <> 'TST'").select("id", G.header_chain(F.col("texto")).alias("classe"))


@_query("n02_rendered_classes", "SELECT id, classe AS c FROM registry")
def _(f: Fixture) -> DataFrame:
    return _seeded(f.registry).select("id", F.array_join(T.class_codes(G.rendered(F.col("classe"), F.col("seed"))), ",").alias("c"))


@_query("n02_rendered_chains", "SELECT id, 'EDcl,AgInt,'||classe AS c FROM registry")
def _(f: Fixture) -> DataFrame:
    codes = F.array(F.lit("EDcl"), F.lit("AgInt"), "classe")
    return _seeded(f.registry).select("id", F.array_join(T.class_codes(G.rendered_chain(codes, F.col("seed"))), ",").alias("c"))


@_query("n03_header_state", "SELECT id, CASE tribunal WHEN 'STJ' THEN 'SP' WHEN 'STM' THEN 'RJ' ELSE CASE WHEN id % 2 = 0 THEN 'MS' ELSE 'MT' END END AS uf FROM registry")
def _(f: Fixture) -> DataFrame:
    text = F.when(F.col("tribunal") == "STJ", "REsp 1.234 - SP (2016)").when(F.col("tribunal") == "STM", "APL 77 2019/RJ").otherwise(F.concat(F.lit("Estado de "), F.when(F.col("id") % 2 == 0, "Mato Grosso do Sul").otherwise("Mato Grosso")))
    return f.registry.select("id", N.header_state(text, F.col("tribunal")).alias("uf"))


@_query("n05_cnj_formats", "SELECT id, numero AS chave FROM registry WHERE numero LIKE '%.%'")
def _(f: Fixture) -> DataFrame:
    return _seeded(f.registry).where("numero LIKE '%.%'").select("id", T.number_key(N.unified_number(F.col("numero"), F.col("seed"))).alias("chave"))


@_query("n07_misread_words", "SELECT documento_id, k, TRUE AS igual FROM gold")
def _(f: Fixture) -> DataFrame:
    """Letters are misread three times over; what stands for them stays the same."""
    seed = F.col("inicio") * 13 + F.col("k")
    return f.gold.select("documento_id", "k", (T.folded(N.misread_word(F.col("trecho"), seed, 3)) == T.folded(F.col("trecho"))).alias("igual"))


@_query("n08_broken_lines", "SELECT documento_id, k, md5(replace(trecho, chr(10), ' ')) AS h, trecho LIKE '% %' AS quebrada FROM gold")
def _(f: Fixture) -> DataFrame:
    t = N.broken_line(F.replace("trecho", F.lit("\n"), F.lit(" ")), F.col("inicio"))
    return f.gold.select("documento_id", "k", F.md5(F.encode(F.replace(t, F.lit("\n"), F.lit(" ")), "UTF-8")).alias("h"), t.contains("\n").alias("quebrada"))


@_query("n09_markers_and_states", "SELECT id, numero AS chave FROM registry WHERE tribunal = 'STJ'")
def _(f: Fixture) -> DataFrame:
    r = _seeded(f.registry).where("tribunal = 'STJ'")
    text = F.concat(F.lit("o REsp "), N.marker(F.col("seed")), "numero", N.state_suffix(F.lit("SP"), F.col("seed") + 1), F.lit(", no ponto"))
    return r.select("id", T.number_key(F.regexp_extract(text, numbered(), 3)).alias("chave"))


@_query("n10_real_rulings", "SELECT r.id AS n, 'real' AS classe, r.id AS id_canonico FROM registry r JOIN (SELECT numero, count(*) AS c FROM registry GROUP BY numero) x ON x.numero = r.numero WHERE c = 1")
def _(f: Fixture) -> DataFrame:
    rows = _seeded(f.registry.join(D.wholly_unique(_kb(f)), "id")).withColumn("uf", F.when(F.col("id") % 3 == 0, "SP"))
    made = G.real_rulings(rows).select(F.col("id_canonico").alias("n"), "trecho")
    return _found_again(f, made).select("n", "classe", "id_canonico")


_RULE = "(s * 1103515245 + 12345) % 2147483648 % 100"


@_query("n11_false_citations", f"SELECT CASE WHEN d >= 16 AND d < 35 THEN 'lei' ELSE 'jurisprudencia' END AS tipo, count(*) AS n FROM (SELECT {_RULE} AS d FROM (SELECT id * 31 + 7 AS s FROM registry) y) x GROUP BY 1")
def _(f: Fixture) -> DataFrame:
    return G.false_citations(_seeded(f.registry).select("seed"), f.spark.createDataFrame([("0",)], "chave string")).groupBy("tipo").agg(F.count("*").alias("n"))


@_query("n12_incomplete_rulings", "SELECT id AS n, 'incompleta' AS regra FROM registry")
def _(f: Fixture) -> DataFrame:
    made = G.incomplete_rulings(f.registry.withColumn("seed", F.col("id"))).select(F.col("seed").alias("n"), "trecho")
    return _found_again(f, made).select("n", "regra")


def _several(df: DataFrame, f: Fixture) -> DataFrame:
    """Each row under 60 seeds."""
    return df.crossJoin(F.broadcast(f.spark.range(60).withColumnRenamed("id", "v"))).withColumn("seed", F.col("id") * 64 + F.col("v"))


@_query("n13_laws_and_statements", "SELECT id, count(*) * 60 AS n FROM (SELECT id FROM articles UNION ALL SELECT id FROM statements) x GROUP BY id")
def _(f: Fixture) -> DataFrame:
    made = G.real_laws(_several(f.articles, f)).unionByName(G.real_statements(_several(f.statements, f))).select(F.col("seed").alias("n"), "trecho")
    return _found_again(f, made).where("classe = 'real'").groupBy(F.col("id_canonico").alias("id")).agg(F.count("*").alias("n"))


@_query("n15_no_citations", "SELECT count(*) AS documentos, 0::BIGINT AS achadas FROM registry")
def _(f: Fixture) -> DataFrame:
    """Heads, own numbers, bar numbers, addresses and dates: nothing is found in them."""
    r = _seeded(f.registry)
    own = G.own_number(F.col("seed"))
    prose = F.lit("Cuida-se de recurso interposto contra a sentença de origem. ")
    text = F.concat(G.petition_head(F.col("seed"), own), prose, G.own_sentence(F.col("seed") + 1, own), G.petition_end(F.col("seed") + 2))
    docs = r.select(F.col("id").cast("string").alias("documento_id"), text.alias("texto"))
    found = E.extracted(docs).agg(F.count("*").alias("achadas"), F.lit(1).alias("one"))
    return docs.agg(F.count("*").alias("documentos"), F.lit(1).alias("one")).join(found, "one").drop("one")


@_query("n17_misread_starts", "SELECT id, tribunal AS t FROM registry")
def _(f: Fixture) -> DataFrame:
    text = F.concat(F.lit("julgado do "), "tribunal", F.lit(" pela relatoria de "), "relator")
    return _seeded(f.registry).select("id", T.court(N.misread_start(text, F.col("seed"))).alias("t"))


@_query("n18_variants", "SELECT id, count(*) * 60 AS n FROM (SELECT id FROM articles WHERE lei = 'CF' UNION ALL SELECT id FROM statements) x GROUP BY id")
def _(f: Fixture) -> DataFrame:
    made = G.constitution_variants(_several(f.articles, f)).unionByName(G.statement_variants(_several(f.statements, f))).select(F.col("seed").alias("n"), "trecho")
    return _found_again(f, made).where("classe = 'real'").groupBy(F.col("id_canonico").alias("id")).agg(F.count("*").alias("n"))


@_query("n19_shared_rulings", "SELECT r.id FROM registry r JOIN (SELECT numero, count(*) AS c, count(DISTINCT classe) AS d FROM registry GROUP BY numero) x ON x.numero = r.numero WHERE c > 1 AND c = d")
def _(f: Fixture) -> DataFrame:
    return _kb(f).keys.join(D.shared_keys(_kb(f)), "chave").select("id")


@_query("n20_new_sentences", "SELECT 2 * count(*) AS n, 0::BIGINT AS errados FROM registry")
def _(f: Fixture) -> DataFrame:
    """Unseen beginnings with citations and with vague phrases; the phrase stands where it is said to."""
    cited = G.new_sentences(_seeded(f.registry).withColumn("trecho", F.concat("classe", F.lit(" "), "numero"))).select("frase", "inicio", "fim", "trecho")
    both = cited.unionByName(G.new_vague(_seeded(f.registry).select("seed")).select("frase", "inicio", "fim", "trecho"))
    return both.agg(F.count("*").alias("n"), F.count_if(T.span_text(F.col("frase"), F.col("inicio"), F.col("fim")) != F.col("trecho")).alias("errados"))


@_query("n22_extra_sentences", "SELECT rotulo, count(*) AS n, round(avg(p), 6) AS p FROM (SELECT CASE id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS rotulo, 1.0::DOUBLE AS p FROM registry) x GROUP BY rotulo")
def _(f: Fixture) -> DataFrame:
    r = _seeded(f.registry)
    seeds = r.select("seed", F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "B").otherwise("C").alias("what"))
    rows = G.training_rows(G.extra_sentences(seeds, r.select("seed", F.concat("classe", F.lit(" "), "numero").alias("trecho"))))
    p = F.when(F.col("gold.label") == "A", F.col("gold.probabilities.A")).when(F.col("gold.label") == "B", F.col("gold.probabilities.B")).otherwise(F.col("gold.probabilities.C"))
    return rows.where(F.length("state") > 20).groupBy(F.col("gold.label").alias("rotulo")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("p"))
