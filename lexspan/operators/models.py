"""The optional model stage: which sentences a model sees, what a model says of them, and where its words stand.

Models never decide a class: a proposal is anchored in its sentence and decided by rules (proposals.py). A scorer or a
proposer is made once per Python worker by a factory and sees sentences in batches; the defaults are stand-ins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import ANY_SOURCE, ATTACKED_PATTERN, CLOSING, CUE_PATTERN, HEAD_PATTERN, NO_CITATION_BEFORE, SLOT_PATTERN, SOURCE_PATTERN, TITLE, VAGUE_PATTERN
from ..functions.text import cache_key, lookup, strip_accents
from ..functions.vocabulary import MISREAD
from .extraction import about_law, header_end, matches
from .intervals import without_overlap
from .sentences import sentences as sentences_of

#: Most answers of a proposer for a sentence, and most characters of one.
ANSWERS, ANSWER = 5, 200
Scorer = Callable[[list[str]], list[dict[str, float]]]
Proposer = Callable[[list[str]], list[list[str]]]


# ---- Sentences


def closing_start(text: Column, beyond: float = 0.6) -> Column:
    """Start of the closing part: the last closing formula if it stands beyond that share of the text, else the end."""
    last = F.try_element_at(matches(text, CLOSING, 0), F.lit(-1))["inicio"]
    return F.when(last > F.length(text) * beyond, last).otherwise(F.length(text).cast("bigint"))


def with_text(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """sentences (documento_id, a, b) with frase (line ends as spaces), the end of the header and the start of the closing;
    those of read() have them."""
    if "frase" in sentences.columns:
        return sentences
    d = docs.select("documento_id", "texto", header_end(F.col("texto")).alias("fim_cab"), closing_start(F.col("texto")).alias("ini_fecho"))
    text = F.substring("texto", F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int"))
    return sentences.join(d, "documento_id").select("documento_id", "a", "b", F.replace(text, F.lit("\n"), F.lit(" ")).alias("frase"), "fim_cab", "ini_fecho")


def read(docs: DataFrame) -> DataFrame:
    """The sentences of docs as with_text() has them, cut out of each text where it is read: no join."""
    more = {"fim_cab": header_end(F.col("texto")), "ini_fecho": closing_start(F.col("texto"))}
    return sentences_of(docs, more).withColumn("frase", F.replace("frase", F.lit("\n"), F.lit(" "))).select("documento_id", "a", "b", "frase", "fim_cab", "ini_fecho")


def is_title(sentence: Column) -> Column:
    return sentence.rlike(TITLE)


def uncovered(sentences: DataFrame, taken: DataFrame) -> DataFrame:
    """Sentences that no span of ``taken`` touches."""
    s = sentences.withColumnsRenamed({"a": "inicio", "b": "fim"})
    return without_overlap(s, taken).withColumnsRenamed({"inicio": "a", "fim": "b"})


def cues(sentence: Column, with_vague: bool = False) -> Column:
    """array<struct<inicio, fim>> within the sentence: strong cues, phrases after known beginnings, and sources behind an
    article if vague ones count. A number after leaves, a sum or a registration is no cue."""

    def strong(m: Column) -> Column:
        start = m["inicio"].cast("int")
        digit = F.substring(sentence, start + 1, F.lit(1)).rlike("[0-9]")
        before = F.substring(sentence, F.greatest(start - 30, F.lit(0)) + 1, F.least(start, F.lit(30)))
        return ~(digit & before.rlike(NO_CITATION_BEFORE))

    place = lambda m: F.struct(m["inicio"].alias("inicio"), m["fim"].alias("fim"))
    parts = [F.transform(F.filter(matches(sentence, CUE_PATTERN, 0), strong), place)]
    parts.append(F.transform(matches(sentence, SLOT_PATTERN, 2), lambda m: F.struct((m["fim"] - F.length(m["g"][1])).alias("inicio"), m["fim"].alias("fim"))))
    if with_vague:
        parts.append(F.transform(matches(sentence, HEAD_PATTERN, 0), place))
    return F.concat(*parts)


def escalated(docs: DataFrame, sentences: DataFrame, taken: DataFrame, with_vague: bool = False) -> DataFrame:
    """Sentences between header and closing, no titles, with a cue that no span of ``taken`` covers."""
    s = with_text(docs, sentences).where((F.col("a") >= F.col("fim_cab")) & (F.col("a") < F.col("ini_fecho")) & ~is_title(F.col("frase")))
    c = s.select("documento_id", "a", "b", "frase", F.explode(cues(F.col("frase"), with_vague)).alias("c"))
    c = c.select("documento_id", "a", "b", "frase", (F.col("a") + F.col("c.inicio")).alias("inicio"), (F.col("a") + F.col("c.fim")).alias("fim"))
    return without_overlap(c, taken).select("documento_id", "a", "b", "frase").distinct()


# ---- Scorers


def keyword_scorer(sentence: Column) -> Column:
    """struct(A, B, C): A an identified citation, B a vague one, C neither; a stand-in for a sentence classifier."""
    vague = sentence.rlike(VAGUE_PATTERN)
    cited = sentence.rlike("[0-9]{2,}")
    p = lambda a, b: F.struct(F.lit(a).alias("A"), F.lit(b).alias("B"), F.lit(round(1 - a - b, 2)).alias("C"))
    return F.when(vague, p(0.03, 0.95)).when(cited, p(0.9, 0.05)).otherwise(p(0.05, 0.05))


def in_batches(items: list, size: int) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield items[at : at + size]


def scored(sentences: DataFrame, factory: Callable[[], Scorer], batch: int = 16) -> DataFrame:
    """sentences (with frase) and p: struct(A, B, C) by a scorer that each Python worker makes once and calls with
    ``batch`` sentences at a time. A label that it leaves out is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = factory()
        for b in batches:
            found = [x for part in in_batches(b.column("frase").to_pylist(), batch) for x in score(part)]
            p = pa.array([{k: float(x.get(k, 0.0)) for k in "ABC"} for x in found], pa.struct([(k, pa.float64()) for k in "ABC"]))
            yield pa.RecordBatch.from_arrays([*b.columns, p], [*b.schema.names, "p"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema.fields)
    return sentences.mapInArrow(run, f"{types}, p struct<A:double,B:double,C:double>")


def _with_scores(sentences: DataFrame, scorer: Callable[[Column], Column] | None, factory: Callable[[], Scorer] | None) -> DataFrame:
    return scored(sentences, factory) if factory else sentences.withColumn("p", (scorer or keyword_scorer)(F.col("frase")))


def identified(docs: DataFrame, sentences: DataFrame, taken: DataFrame, scorer: Callable[[Column], Column] | None = None, least: float = 0.5, factory: Callable[[], Scorer] | None = None) -> DataFrame:
    """Sentences after the header, no titles, that no span touches and that the scorer holds for identified citations."""
    s = uncovered(with_text(docs, sentences).where((F.col("a") >= F.col("fim_cab")) & ~is_title(F.col("frase"))), taken)
    return _with_scores(s, scorer, factory).where(F.col("p.A") >= least).select("documento_id", "a", "b", "frase")


def source_phrase(sentence: Column) -> Column:
    """struct(inicio, trecho): the first noun phrase of a source behind an article, two to eight words, no digit, not the
    act under attack; null if none."""
    found = F.transform(matches(sentence, SOURCE_PATTERN, 2), lambda m: F.struct((m["fim"] - F.length(m["g"][1])).alias("inicio"), m["g"][1].alias("trecho")))
    count = lambda t: F.size(F.split(F.trim(t), r"\s+"))
    ok = lambda m: ~m["trecho"].rlike("[0-9]") & ~m["trecho"].rlike(ATTACKED_PATTERN) & count(m["trecho"]).between(2, 8)
    return F.try_element_at(F.filter(found, ok), F.lit(1))


def vague_by_model(docs: DataFrame, sentences: DataFrame, taken: DataFrame, scorer: Callable[[Column], Column] | None = None, least: float = 0.9, factory: Callable[[], Scorer] | None = None) -> DataFrame:
    """The first source phrase of each uncovered sentence that the scorer holds for vague: inicio, fim, trecho, tipo."""
    s = with_text(docs, sentences).where((F.col("a") >= F.col("fim_cab")) & ~is_title(F.col("frase")) & F.col("frase").rlike(ANY_SOURCE))
    s = _with_scores(uncovered(s, taken), scorer, factory).where(F.col("p.B") >= least).withColumn("s", source_phrase(F.col("frase"))).where("s IS NOT NULL")
    at = F.col("a") + F.col("s.inicio")
    tipo = F.when(about_law(F.col("s.trecho")), "lei").otherwise("jurisprudencia")
    return s.select("documento_id", at.alias("inicio"), (at + F.length("s.trecho")).alias("fim"), F.col("s.trecho").alias("trecho"), tipo.alias("tipo"))


# ---- Proposers


def plain_proposer() -> Proposer:
    """A stand-in for a language model: from the first court or class in capitals to the next comma or the end."""
    shape = re.compile(r"\b(?:[S5]T[FJM]|T[S5][ET]|[A-Z][A-Za-z]*[A-Z][a-z]{0,3})\b[^,;]*")
    return lambda sentences: [[m.group().rstrip(" .")] if (m := shape.search(s)) else [] for s in sentences]


def chat_prompt(system: str, examples: list[tuple[str, str]], sentence: Column) -> Column:
    """The prompt of a chat model: system text, examples, the sentence, and the opened answer."""
    turns = [("system", system)] + [t for q, a in examples for t in (("user", q), ("assistant", a))]
    before = "".join(f"<|im_start|>{who}\n{said}<|im_end|>\n" for who, said in turns)
    return F.concat(F.lit(before + "<|im_start|>user\n"), sentence, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def answers(reply: Column) -> Column:
    """array<string> from a model's JSON reply; anything else is no answer."""
    got = F.from_json(reply, "citacoes array<string>")["citacoes"]
    return F.filter(F.coalesce(got, F.array().cast("array<string>")), lambda x: x.isNotNull())


def proposed(sentences: DataFrame, factory: Callable[[], Proposer], batch: int = 16) -> DataFrame:
    """sentences (with frase) and propostas: at most ANSWERS texts of at most ANSWER characters each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        propose = factory()
        for b in batches:
            found = [[str(t)[:ANSWER] for t in x][:ANSWERS] for part in in_batches(b.column("frase").to_pylist(), batch) for x in propose(part)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], [*b.schema.names, "propostas"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema.fields)
    return sentences.mapInArrow(run, f"{types}, propostas array<string>")


def remembered(sentences: DataFrame, cache: DataFrame, version: str, model: str) -> DataFrame:
    """sentences with propostas from a cache (k: hash of version, model and sentence; v: answers); null: not there."""
    key = cache_key(F.lit(version), F.lit(model), F.col("frase"))
    return sentences.withColumn("k_", key).join(cache.select(F.col("k").alias("k_"), F.col("v").alias("propostas")).dropDuplicates(["k_"]), "k_", "left").drop("k_")


def misses(sentences: DataFrame, cache: DataFrame, version: str, model: str) -> DataFrame:
    """One row: how many of the sentences a cache knows and how many it lacks."""
    return remembered(sentences, cache, version, model).agg(F.count("propostas").alias("achadas"), F.count_if(F.col("propostas").isNull()).alias("perdidas"))


def proposals(sentences: DataFrame, factory: Callable[[], Proposer] | None = None, cache: DataFrame | None = None, version: str = "1", model: str = "local") -> DataFrame:
    """What to ask whom: a cache first, then the proposer for what the cache lacks; without a proposer nothing for that.

    Each distinct sentence is asked once. With neither the stand-in answers.
    """
    if cache is None:
        asked = proposed(sentences.select("frase").distinct(), factory or plain_proposer)
    else:
        known = remembered(sentences.select("frase").distinct(), cache, version, model)
        none = F.array().cast("array<string>")
        asked = known.where("propostas IS NOT NULL") if factory else known.withColumn("propostas", F.coalesce("propostas", none))
        if factory:
            asked = asked.unionByName(proposed(known.where("propostas IS NULL").select("frase"), factory))
    return sentences.join(asked, "frase")


def _misreadable(text: Column) -> Column:
    """Pattern of a plain lower-case text: its letters may have been misread as others or as digits, its digits not."""
    table = {c: "[" + c + "".join(x for x in more if x != "|") + ("|]" if "|" in more else "]") for c, more in MISREAD.items()} | {"m": "(?:m|rn)", " ": r"\s+"}
    signs = F.filter(F.split(F.regexp_replace(text, r"\s+", " "), ""), lambda c: c != "")
    escaped = lambda c: F.when(c.rlike("[^a-z0-9]"), F.concat(F.lit("\\"), c)).otherwise(c)
    return F.array_join(F.transform(signs, lambda c: F.coalesce(lookup(table, c), escaped(c))), "")


def anchored(proposals: DataFrame) -> DataFrame:
    """documento_id, a, frase, proposta -> inicio, fim where the proposal stands in its sentence: literally, else with any
    white space, else without regard to case and accents and with letters misread. Others, and those under three
    characters, are dropped: a paraphrase is no citation."""
    said = F.trim(F.regexp_replace("proposta", r"^[\s.,;:]+|[\s.,;:]+$", ""))
    proposals = proposals.withColumn("dita_", said).where(F.length("dita_") >= 3)
    exact = F.instr("frase", F.col("dita_"))
    loose_of = lambda c: F.regexp_replace(F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), r"\s+", r"\\s+")
    space = F.regexp_substr("frase", loose_of(F.col("dita_")))
    plain = F.lower(strip_accents(F.col("frase")))
    folded = F.regexp_substr(plain, _misreadable(F.lower(strip_accents(F.col("dita_")))))
    at = F.when(exact > 0, exact).when(space.isNotNull(), F.instr("frase", space)).when(folded.isNotNull(), F.instr(plain, folded))
    size = F.when(exact > 0, F.length("dita_")).when(space.isNotNull(), F.length(space)).otherwise(F.length(folded))
    p = proposals.withColumn("at", at).withColumn("size", size).where("at > 0")
    return p.select("documento_id", "a", (F.col("a") + F.col("at") - 1).cast("bigint").alias("inicio"), (F.col("a") + F.col("at") - 1 + F.col("size")).cast("bigint").alias("fim"), "proposta")


# ---- Training sentences


def labelled(sentences: DataFrame, identified_gold: DataFrame, vague_gold: DataFrame) -> DataFrame:
    """rotulo A if a sentence touches an identified gold span, else B if a vague one, else C."""

    def touched(gold: DataFrame, label: str) -> DataFrame:
        g = gold.select(F.col("documento_id").alias("d_"), F.col("inicio").alias("i_"), F.col("fim").alias("f_"))
        hit = (F.col("documento_id") == F.col("d_")) & (F.col("a") < F.col("f_")) & (F.col("i_") < F.col("b"))
        return sentences.join(g, hit, "left_semi").select("documento_id", "a", F.lit(True).alias(label))

    j = sentences.join(touched(identified_gold, "is_a"), ["documento_id", "a"], "left").join(touched(vague_gold, "is_b"), ["documento_id", "a"], "left")
    return j.select("documento_id", "a", "b", F.when(F.col("is_a"), "A").when(F.col("is_b"), "B").otherwise("C").alias("rotulo"))
