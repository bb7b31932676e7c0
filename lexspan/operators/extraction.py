"""From texts to citation spans, with exact code-point offsets and without leaving the JVM or shuffling texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import FAMILIES, FAMILY_START, MARKED, SLOT_PATTERN, VAGUE_PATTERN
from ..functions.grammar import ANY, BLANK, LETTER, NUMBER, cased, maybe, word, words
from ..functions.text import justice, let, number_key
from ..functions.vocabulary import LAW_STEMS, MONTHS, STATES

MARK, FIELD = "\u0001", "\u0003"
GROUPS = ("cadeia", "trib", "num", "sufixo", "uf", "sv", "vinc", "outro", "suf", "lei", "leiano", "ano", "nome")
NUMBERED = ("numerada", "processo_cnj", "hifenizada")


#: Characters that a candidate keeps from before and after it.
LEFT, RIGHT = 80, 24


def matches(text: Column, pattern: str, groups: int, around: bool = False) -> Column:
    """array<struct<inicio, fim, g: array<string>>> of all matches. Marks in the text count as spaces.

    Matches and their groups are set off by marks, the text is cut at the marks, and a fold over the pieces of the row
    adds up their lengths: no window, no exchange. With ``around`` also antes, trecho, depois: up to LEFT characters
    before the match, its text, and up to RIGHT characters after it.
    """
    clean = F.when(text.contains(MARK) | text.contains(FIELD), F.translate(text, MARK + FIELD, "  ")).otherwise(text)
    wide = pattern + f"(?s:(?=(.{{0,{RIGHT}}})))" if around else pattern
    spliced = F.regexp_replace(clean, wide, MARK + "$0" + "".join(f"{FIELD}${i}" for i in range(1, groups + 1 + around)) + MARK)
    pieces = F.split(spliced, MARK)
    more = ",antes:string,trecho:string,depois:string" if around else ""
    kind = f"array<struct<inicio:bigint,fim:bigint,g:array<string>{more}>>"

    def step(acc: Column, piece: Column) -> Column:
        fields = F.split(piece, FIELD)
        end = acc["at"] + F.length(fields[0])
        seen = [acc["tail"].alias("antes"), fields[0].alias("trecho"), F.element_at(fields, -1).alias("depois")] if around else []
        found = F.struct(acc["at"].alias("inicio"), end.alias("fim"), F.slice(fields, 2, groups).alias("g"), *seen)
        tail = [F.right(F.concat(acc["tail"], fields[0]), F.lit(LEFT)).alias("tail")] if around else []
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"), *tail)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("odd"), F.array().cast(kind).alias("out"), *([F.lit("").alias("tail")] if around else []))
    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def header_end(text: Column, limit: int = 2_000) -> Column:
    """Start of the first line of prose: five words or more, half of them or more in lower case, no label; else the
    header goes on to the end, but not beyond ``limit``."""
    lines = F.split(F.substring(text, 1, limit * 2), "(?<=\n)")

    def step(acc: Column, line: Column) -> Column:
        words = F.regexp_extract_all(line, F.lit(f"([{LETTER}]+)"), F.lit(1))
        low = F.size(F.filter(words, lambda w: F.substring(w, 1, 1).rlike("[a-zà-öø-ÿ]")))
        prose = (F.size(words) >= 5) & (low * 2 >= F.size(words)) & ~line.rlike(rf"^[ \t]*[A-ZÀ-Ý][{LETTER} .\-/]{{0,40}}:\s")
        stop = (acc["at"] >= limit) | prose
        stopped = F.struct(acc["at"].alias("at"), F.lit(True).alias("stop"))
        # lines after the end aren't looked at
        return F.when(acc["stop"], acc).when(stop, stopped).otherwise(F.struct((acc["at"] + F.length(line)).alias("at"), F.lit(False).alias("stop")))

    found = F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.lit(False).alias("stop")), step, lambda acc: acc["at"])
    return F.least(found, F.lit(limit)).cast("bigint")


def own_keys(text: Column, end: Column) -> Column:
    """Keys of seven digits or more in the header: the document's own number."""
    found = F.regexp_extract_all(F.substring(text, F.lit(1), end.cast("int")), F.lit(f"({NUMBER})"), F.lit(1))
    keys = F.transform(found, number_key)
    return F.array_distinct(F.filter(keys, lambda k: F.length(F.regexp_replace(k, "[^0-9]", "")) >= 7))


def _by_order(values: list) -> Column:
    """The value of a row's family."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("ordem") + 1)


#: Place of each family's match among the fields of a place, from 1; its groups follow, then what stands after it.
_FIRST = [1 + sum(len(names) + 2 for _, _, names, _ in FAMILIES[:order]) for order in range(len(FAMILIES))]
_COUNT = _FIRST[-1] + len(FAMILIES[-1][2]) + 1
#: A text's beginning is filled up, so that there is something before every match.
_FILL = "\n" * LEFT
#: All families at one place, by looking ahead, so that none takes from another; a place where some family matches.
_PLACE = FAMILY_START + "".join(f"(?:(?=({p})(?s:(.{{0,{RIGHT}}}))))?+" for _, _, _, p in FAMILIES) + "(?=" + "|".join(f"\\{n}" for n in _FIRST) + f")(?<=(?s:(.{{{LEFT},{2 * LEFT}}})))"


def _group(name: str) -> Column:
    """The text of a group by the place that it has in the row's family; null if empty, or if the family has none."""
    place = _by_order([_FIRST[order] + names.index(name) + 2 if name in names else 0 for order, (_, _, names, _) in enumerate(FAMILIES)])
    return F.when(place > 0, F.nullif(F.element_at(F.col("g"), F.greatest(place, F.lit(1))), F.lit(""))).alias(name)


def _places(docs: DataFrame, *columns: str) -> DataFrame:
    """columns and one row per place where some family matches: inicio, g, usado. g: the fields of all families (see
    _FIRST; the first field is empty, what stands before comes last but one). usado: how far the earlier matches of every
    family reach; null if no match of the text can hold another place.

    The text is read once: places are marked, and a fold over the pieces between the marks adds up their lengths. Within
    the fold pieces stay whole, as functions on arrays copy what they return.
    """
    marks, text = MARK + FIELD, F.col("texto")
    clean = F.when(text.contains(MARK) | text.contains(FIELD), F.translate(text, marks, "  ")).otherwise(text)
    spliced = F.regexp_replace(F.concat(F.lit(_FILL), clean), _PLACE, MARK + "".join(f"{FIELD}${n}" for n in range(1, _COUNT + 2)) + FIELD)
    out = settled(docs, p_=F.split(spliced, MARK)).select(*columns, "p_")
    rest = lambda piece: F.length(F.substring_index(piece, FIELD, -1))
    starts = F.aggregate("p_", F.array(F.lit(-LEFT)), lambda acc, piece: F.array_append(acc, F.element_at(acc, -1) + rest(piece)))
    out = settled(out, i_=starts.cast("array<bigint>")).select(*columns, "p_", "i_")

    def step(acc: Column, piece: Column, start: Column) -> Column:
        old = F.element_at(acc, -1)
        ends = lambda g: F.array(*(F.greatest(old[k], F.when(start >= old[k], start + F.length(F.nullif(g[n], F.lit(""))))) for k, n in enumerate(_FIRST)))
        return F.array_append(acc, let(F.split(piece, FIELD), ends))

    # a match that is longer than what is between its place and the next one; few texts have one
    holds = lambda g: F.greatest(*(F.length(g[n]) for n in _FIRST)) > F.length(g[_COUNT + 2])
    wide = F.exists("p_", lambda piece: piece.startswith(FIELD) & let(F.split(piece, FIELD), holds))
    zeros = F.array(F.array(*[F.lit(0).cast("bigint")] * len(FAMILIES)))
    both = F.slice(F.arrays_zip(F.col("p_").alias("p"), F.col("i_").alias("i")), 2, F.greatest(F.size("p_") - 1, F.lit(0)))
    reach = F.aggregate(both, zeros, lambda acc, x: step(acc, x["p"], x["i"]))
    used = F.when(wide, F.concat(F.array(F.lit(None).cast("array<bigint>")), reach)).otherwise(F.array().cast("array<array<bigint>>"))
    out = out.select(*columns, F.arrays_zip("p_", "i_", used.alias("u_")).alias("c_"))
    out = out.select(*columns, F.explode("c_").alias("c_")).where(F.startswith("c_.p_", F.lit(FIELD)))
    return out.select(*columns, F.col("c_.i_").alias("inicio"), F.col("c_.u_").alias("usado"), F.split("c_.p_", FIELD).alias("g"))


def candidates(docs: DataFrame) -> DataFrame:
    """documento_id, texto -> one row per match of every family: kind, prioridade, ordem, inicio, fim, antes, trecho,
    depois, groups by name.

    All families are found in one pass over each row; matches of one family don't overlap, the earlier goes first. An
    empty group is null. A null text has no rows.
    """
    kind, priority = (_by_order([family[k] for family in FAMILIES]).alias(name) for k, name in ((0, "kind"), (1, "prioridade")))
    out = docs.select("documento_id", "texto").withColumn("fim_cab", header_end(F.col("texto"))).withColumn("proprias", own_keys(F.col("texto"), F.col("fim_cab")))
    out = _places(out, "documento_id", "fim_cab", "proprias")
    there = F.array_compact(F.array(*(F.when((F.col("g")[n] != "") & (F.col("usado").isNull() | (F.col("inicio") >= F.col("usado")[order])), order) for order, n in enumerate(_FIRST))))
    out = out.select("documento_id", "fim_cab", "proprias", "inicio", "g", F.explode(there).alias("ordem"))
    text = F.element_at(F.col("g"), _by_order([n + 1 for n in _FIRST]))
    after = F.element_at(F.col("g"), _by_order([n + len(names) + 2 for n, (_, _, names, _) in zip(_FIRST, FAMILIES)]))
    where = ("inicio", (F.col("inicio") + F.length(text)).alias("fim"), F.element_at(F.col("g"), _COUNT + 2).alias("antes"), text.alias("trecho"), after.alias("depois"))
    out = out.select("documento_id", "fim_cab", "proprias", kind, priority, "ordem", *where, *map(_group, GROUPS))
    return out.where("kind <> 'incompleta' OR ano IS NOT NULL OR trib IS NOT NULL")


def settled(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with these columns, each computed once however often it is used afterwards."""
    kept = [c for c in rows.columns if c not in values]
    return rows.select(*kept, F.inline(F.array(F.struct(*(v.alias(n) for n, v in values.items())))))


def trimmed(c: DataFrame) -> DataFrame:
    """Ends lose spaces and punctuation, but not the dot of an initial, Min. or Rel.; starts lose spaces and commas."""
    text = F.col("trecho")
    keeps = F.length(F.regexp_extract(text, r"^((?s:.*?(?:\b[A-Z]|[Mm]in|[Rr]el)\.))[ \t\n,;.\-–\xa0]*$", 1))
    bare = F.length(F.regexp_replace(text, r"[ \t\n,;.\-–\xa0]+$", ""))
    lead = F.length(F.regexp_extract(text, r"^[ \t\n,;\xa0]*", 0))
    c = settled(c, menos=lead, ate=F.greatest(keeps, bare))
    return settled(
        c,
        inicio=(F.col("inicio") + F.col("menos")).cast("bigint"), fim=(F.col("inicio") + F.col("ate")).cast("bigint"),
        antes=F.right(F.concat("antes", F.substring(text, F.lit(1), F.col("menos"))), F.lit(LEFT)), trecho=F.substring(text, F.col("menos") + 1, F.col("ate") - F.col("menos")),
        depois=F.left(F.concat(F.substring(text, F.col("ate") + 1, F.length(text)), "depois"), F.lit(RIGHT)),
    ).drop("menos", "ate")


def _extended(c: DataFrame) -> DataFrame:
    """A labour-court number takes in the "processo nº TST-Ag-" before it."""
    hyphen = f"{ANY}-{ANY}"
    prefix = "(?iu)" + maybe(word("processo"), ANY, MARKED) + cased(maybe("T[S5]T", hyphen), "(?:[A-Z][A-Za-z]{0,7}", hyphen, ")*") + "$"
    grows = F.col("kind").isin("numerada", "hifenizada") & F.coalesce(justice(F.col("chave")) == "5", F.lit(False))
    c = settled(c, mais=F.when(grows, F.length(F.regexp_extract("antes", prefix, 0))).otherwise(0))
    rest = F.length("antes") - F.col("mais")
    return settled(
        c, inicio=F.col("inicio") - F.col("mais"), trecho=F.concat(F.right("antes", F.col("mais")), "trecho"), antes=F.left("antes", rest)
    ).drop("mais")


def is_distractor() -> Column:
    """Bar registrations, "Cidade/UF, 12 de março", and "Ap. 302" of an address; by what stands before and after."""
    before, after = F.right("antes", F.lit(12)), F.col("depois")
    chain = F.trim(F.coalesce("cadeia", F.lit("")))
    date = rf"(?iu)^{BLANK}*,?{BLANK}*de{BLANK}+{words(MONTHS)}(?![{LETTER}])"
    place = chain.isin(*STATES) & before.rlike(r"[/\-–]\s*$")
    address = chain.rlike(r"^Ap\.?$") & justice(F.col("chave")).isNull()
    return before.rlike(r"(?i)OAB\s*[/\-–:]?\s*$") | ((F.col("kind") == "numerada") & (place | after.rlike(date) | address))


def resolved(spans: Column) -> Column:
    """Of an array of spans (prioridade, inicio, fim, ordem first matter), a greatest-first choice without overlaps:
    higher priority, then longer, then earlier, then first found; in order of start."""
    keyed = F.transform(spans, lambda s: F.struct((-s["prioridade"]).alias("a"), (s["inicio"] - s["fim"]).alias("b"), s["inicio"].alias("c"), s["ordem"].alias("d"), s.alias("s")))
    ranked = F.transform(F.array_sort(keyed), lambda k: k["s"])
    clash = lambda acc, s: F.exists(acc, lambda e: (s["inicio"] < e["fim"]) & (e["inicio"] < s["fim"]))
    chosen = F.aggregate(ranked, F.slice(ranked, 1, 0), lambda acc, s: F.when(clash(acc, s), acc).otherwise(F.array_append(acc, s)))
    by_start = F.array_sort(F.transform(chosen, lambda s: F.struct(s["inicio"].alias("at"), s.alias("s"))))
    return F.transform(by_start, lambda k: k["s"])


def _judged(docs: DataFrame) -> DataFrame:
    """Candidates extended and trimmed, with propria: a number in the header, or the document's own."""
    c = trimmed(_extended(settled(candidates(docs), chave=number_key(F.col("num")))))
    own = (F.col("inicio") < F.col("fim_cab")) | F.coalesce(F.array_contains("proprias", F.col("chave")), F.lit(False))
    return c.withColumn("propria", F.col("kind").isin(*NUMBERED) & own)


def own_number_spans(docs: DataFrame) -> DataFrame:
    """documento_id, inicio, fim, kind, chave of what is dropped as the document's own number."""
    return _judged(docs).where("propria").select("documento_id", "inicio", "fim", "kind", "chave")


def extracted(docs: DataFrame) -> DataFrame:
    """Citation spans of each document with their text (trecho), none overlapping another: candidates extended, trimmed,
    without the document's own number and distractors, then resolved."""
    c = _judged(docs).where(~F.col("propria") & ~is_distractor())
    fields = ["prioridade", "inicio", "fim", "ordem", "kind", "chave", "trecho", *GROUPS]
    grouped = c.groupBy("documento_id").agg(F.collect_list(F.struct(*fields)).alias("spans"))
    return grouped.select("documento_id", F.explode(resolved(F.col("spans"))).alias("s")).select("documento_id", "s.*")


def about_law(text: Column) -> Column:
    return text.rlike(rf"(?iu)(?<![{LETTER}])(?:{'|'.join(LAW_STEMS.split())})")


def vague(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """Vague phrases after the header that overlap no span of ``taken``: documento_id, inicio, fim, trecho, tipo, fonte.

    Known phrases go before noun phrases that follow a known beginning of a sentence; of those with one start the known
    one stays, and what starts before the last kept one ends is dropped. Digits and single words are out.
    """
    d = docs.select("documento_id", "texto", header_end(F.col("texto")).alias("fim_cab"))
    known = F.transform(matches(F.col("texto"), VAGUE_PATTERN, 1), lambda m: F.struct(m["inicio"].alias("inicio"), F.lit(0).alias("ordem"), m["fim"].alias("fim")))
    after = F.transform(matches(F.col("texto"), SLOT_PATTERN, 2), lambda m: F.struct((m["fim"] - F.length(m["g"][1])).alias("inicio"), F.lit(1).alias("ordem"), m["fim"].alias("fim")))
    found = d.select("documento_id", "texto", "fim_cab", F.explode(F.concat(known, after)).alias("m")).where("m.inicio >= fim_cab")
    text = F.substring("texto", F.col("m.inicio").cast("int") + 1, (F.col("m.fim") - F.col("m.inicio")).cast("int"))
    found = found.select("documento_id", "m.*", text.alias("trecho")).where(~F.col("trecho").rlike("[0-9]") & F.trim("trecho").rlike(r"\s"))
    t = taken.select(F.col("documento_id").alias("d_"), F.col("inicio").alias("i_"), F.col("fim").alias("f_"))
    free = found.join(t, (F.col("documento_id") == F.col("d_")) & (F.col("inicio") < F.col("f_")) & (F.col("i_") < F.col("fim")), "left_anti")
    first = free.groupBy("documento_id", "inicio").agg(F.min(F.struct("ordem", (-F.col("fim")).alias("menos"), "fim", "trecho")).alias("s")).select("documento_id", "inicio", "s.ordem", "s.fim", "s.trecho")
    rows = first.groupBy("documento_id").agg(F.array_sort(F.collect_list(F.struct("inicio", "fim", "trecho", "ordem"))).alias("s"))

    def step(acc: Column, s: Column) -> Column:
        clash = F.coalesce(F.try_element_at(acc, F.lit(-1))["fim"] > s["inicio"], F.lit(False))
        return F.when(clash, acc).otherwise(F.array_append(acc, s))

    kept = rows.select("documento_id", F.explode(F.aggregate("s", F.slice("s", 1, 0), step)).alias("s")).select("documento_id", "s.*")
    law = about_law(F.col("trecho"))
    return kept.select("documento_id", "inicio", "fim", "trecho", F.when(law, "lei").otherwise("jurisprudencia").alias("tipo"), F.when(F.col("ordem") == 0, "inventario").otherwise("slot").alias("fonte"))
