"""Noise and number formats for synthetic corpora: column expressions, drawn by an arithmetic hash so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def draw(seed: Column, n: int) -> Column:
    """0 to n - 1 by a rule that other engines can repeat."""
    return ((seed * 1103515245 + 12345) % 2147483648) % n


def thousands(digits: Column) -> Column:
    """1234567 -> 1.234.567"""
    return F.regexp_replace(digits, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ".")


def unified(digits: Column) -> Column:
    """Digits of a unified number in their usual groups."""
    return F.regexp_replace(digits, r"^([0-9]+)([0-9]{2})([0-9]{4})([0-9])([0-9]{2})([0-9]{4})$", "$1-$2.$3.$4.$5.$6")


def letter_for_digit(number: Column, seed: Column) -> Column:
    """One digit, but not the first two characters, as the letter that is read for it; never a digit for a digit."""
    at = (draw(seed, 1_000_003) % F.greatest(F.length(number) - 2, F.lit(1)) + 3).cast("int")
    one = F.translate(F.substring(number, at, F.lit(1)), "01589", "OISBg")
    return F.concat(F.substring(number, F.lit(1), at - 1), one, F.substring(number, at + 1, F.length(number)))


def broken_joint(number: Column, seed: Column) -> Column:
    """The last dot or hyphen with a line end before it, after it, as a no-break space or a no-break hyphen, or as it is."""
    forms = F.array(*(F.lit(x) for x in ("$1$2$3", "$1\n$2$3", "$1$2\n$3", "$1 $3", "$1‑$3")))
    shape = r"^(.*[0-9])([.-])([0-9]+)$"
    return F.regexp_replace(number, F.lit(shape), F.element_at(forms, (draw(seed, 5) + 1).cast("int")))


def line_ends(text: Column, every: int = 9) -> Column:
    """Every so many words a line end in place of the space."""
    return F.regexp_replace(text, rf"((?:\S+ ){{{every - 1}}}\S+) ", "$1\n")


def pick(options: list[str] | tuple[str, ...], seed: Column, salt: int = 0) -> Column:
    """One of the options by the rule of draw(). Seeds that differ by one give options that differ."""
    return F.element_at(F.array(*map(F.lit, options)), (draw(seed + salt * 7919, len(options)) + 1).cast("int"))


# ---- Fixed values: letters misread inside words, and at their beginning.
IN_WORDS = (("m", "rn"), ("e", "c"), ("i", "l"), ("c", "e"), ("S", "5"), ("a", "ã"), ("o", "ó"))
AT_START = ((r"\bST([FJM])\b", "5T$1"), (r"\bTS([ET])\b", "T5$1"), (r"\bI(?=[a-zà-ÿ])", "l"), (r"\bS(?=[a-zà-ÿ])", "5"))
STATE_FORMS = ("", "/%", " - %", " (%)", "/ %", "-%", " – %")
MARKERS = ("nº ", "", "n. ", "Nº ", "n° ", "No ", "N° ", "nº  ")
STATE_NAMES = {
    "ACRE": "AC", "ALAGOAS": "AL", "AMAPÁ": "AP", "AMAZONAS": "AM", "BAHIA": "BA", "CEARÁ": "CE", "DISTRITO FEDERAL": "DF", "ESPÍRITO SANTO": "ES", "GOIÁS": "GO",
    "MARANHÃO": "MA", "MATO GROSSO DO SUL": "MS", "MATO GROSSO": "MT", "MINAS GERAIS": "MG", "PARÁ": "PA", "PARAÍBA": "PB", "PARANÁ": "PR", "PERNAMBUCO": "PE", "PIAUÍ": "PI",
    "RIO DE JANEIRO": "RJ", "RIO GRANDE DO NORTE": "RN", "RIO GRANDE DO SUL": "RS", "RONDÔNIA": "RO", "RORAIMA": "RR", "SANTA CATARINA": "SC", "SÃO PAULO": "SP",
    "SERGIPE": "SE", "TOCANTINS": "TO",
}
# ---- End of fixed values.


def misread_word(text: Column, seed: Column, times: int = 1) -> Column:
    """One letter after another letter as it is misread, ``times`` times over; which letter and which place are drawn."""
    for k in range(times):
        text = _misread_once(text, seed + k * 104_729)
    return text


def _misread_once(text: Column, seed: Column) -> Column:
    choice = (draw(seed, len(IN_WORDS)) + 1).cast("int")
    old, new = (F.element_at(F.array(*map(F.lit, x)), choice) for x in zip(*IN_WORDS, strict=True))
    mark = F.lit("\u0001")

    def changed(pieces: Column) -> Column:
        """The pieces between the places, put together with the drawn place changed."""
        at = (draw(seed + 31, 1_000_003) % F.greatest(F.size(pieces) - 1, F.lit(1)) + 1).cast("int")
        return F.concat(F.array_join(F.slice(pieces, F.lit(1), at), "\u0001"), new, F.array_join(F.slice(pieces, at + 1, F.size(pieces)), "\u0001"))

    def one(t: Column) -> Column:
        split = F.split(t, F.concat(F.lit(r"(?<=\p{L})"), old))
        return let(split, lambda p: F.when(F.size(p) > 1, F.replace(changed(p), mark, old)).otherwise(t))

    return let(text, one)


def misread_start(text: Column, seed: Column) -> Column:
    """The first letter of a court or a name as it is misread: the first of the forms that the text has, from a drawn one on."""
    first = draw(seed, len(AT_START))
    out = text
    for n in range(len(AT_START)):
        out = _start_from(text, first, n, out)
    return out


def _start_from(text: Column, first: Column, n: int, otherwise: Column) -> Column:
    order = [(n + k) % len(AT_START) for k in range(len(AT_START))]
    chosen = F.coalesce(*(F.when(text.rlike(AT_START[k][0]), F.regexp_replace(text, F.lit("(?s)^(.*?)" + AT_START[k][0]), F.lit("$1" + _shifted(AT_START[k][1])))) for k in order), text)
    return F.when(first == n, chosen).otherwise(otherwise)


def _shifted(new: str) -> str:
    """The replacement with its group one further on, behind the text before."""
    return new.replace("$1", "$2")


def broken_line(text: Column, seed: Column) -> Column:
    """One space as a line end."""
    words = F.split(text, " ")
    at = (draw(seed, 1_000_003) % F.greatest(F.size(words) - 1, F.lit(1)) + 1).cast("int")
    broken = F.concat(F.array_join(F.slice(words, F.lit(1), at), " "), F.lit("\n"), F.array_join(F.slice(words, at + 1, F.size(words)), " "))
    return F.when(F.size(words) > 1, broken).otherwise(text)


def state_suffix(state: Column, seed: Column) -> Column:
    return F.when(state.isNull(), "").otherwise(F.replace(pick(STATE_FORMS, seed), F.lit("%"), state))


def marker(seed: Column) -> Column:
    return pick(MARKERS, seed)


def plain_number(digits: Column, seed: Column) -> Column:
    """With dots, bare, or with spaces."""
    dotted = thousands(digits)
    return F.element_at(F.array(dotted, digits, F.replace(dotted, F.lit("."), F.lit(" "))), (draw(seed, 3) + 1).cast("int"))


def unified_number(key: Column, seed: Column) -> Column:
    """A unified number as written: usual, glued, with spaces, with a space after the first dot, with a doubled hyphen;
    short sequences with or without leading zeros."""
    shape = r"^([0-9]+)-([0-9]{2})\.([0-9]{4})\.([0-9])\.([0-9]{2})\.([0-9]{4})$"
    sequence = F.regexp_extract(key, shape, 1)
    padded = F.when((F.length(sequence) > 5) | (draw(seed + 13, 2) == 0), F.lpad(sequence, 7, "0")).otherwise(sequence)
    forms = ("-$2.$3.$4.$5.$6", "-$2$3$4$5$6", "-$2 $3 $4 $5 $6", "-$2. $3.$4.$5.$6", "--$2.$3.$4.$5.$6")
    return F.concat(F.when(F.length(sequence) > 7, sequence).otherwise(padded), F.element_at(F.array(*(F.regexp_replace(key, shape, f) for f in forms)), (draw(seed, len(forms)) + 1).cast("int")))


def header_state(header: Column, court: Column) -> Column:
    """The state that a ruling's header names: after the number, after the year, or in full."""
    named = None
    for name in sorted(STATE_NAMES, key=len, reverse=True):
        hit = F.upper(header).contains(name)
        named = F.when(hit, STATE_NAMES[name]) if named is None else named.when(hit, STATE_NAMES[name])
    of = lambda shape: F.nullif(F.regexp_extract(header, shape, 1), F.lit(""))
    return F.when(court == "STJ", of(r"[0-9]\s*-\s*([A-Z]{2})\b")).when(court == "STM", of(r"[0-9]{4}/([A-Z]{2})\b")).otherwise(named)
