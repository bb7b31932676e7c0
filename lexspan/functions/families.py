"""The families of citations: which parts follow each other, put together from grammar.py and vocabulary.py."""

from __future__ import annotations

from .grammar import (
    ANY, BLANK, LETTER, NO_LETTER_AFTER, NO_LETTER_BEFORE, NUMBER, ROMAN, SHORT_NUMBER, SOME, SPACE, YEAR, by_initial, cased, kept, listed, maybe, one_of, short, short_starts, starts,
    whole, word, word_starts, words,
)
from .vocabulary import (
    ARTICLES, ATTACKED, CLASS_NAMES, CLASS_SHORT, CLOSINGS, COURTESY, COURTESY_SHORT, COURTS, HEADS, INCIDENTS, LAWS, MONTHS, ORDINALS, OTHER_COURTS, PHRASE_ENDS, RULING_HEADS,
    RULING_QUALITIES, RULING_VERBS, SLOTS, SOURCE_HEADS, SOURCE_VERBS, STATES, THEME_QUALITIES, THEME_TAILS, VAGUE,
)

#: Begins where no letter stands before.
START = "(?iu)" + NO_LETTER_BEFORE


def short_forms(code: str) -> list[str]:
    return [code, *CLASS_SHORT.get(code, "").split()]


# ---- Parts

CLASS = by_initial([(n, whole(word(n))) for names in CLASS_NAMES.values() for n in listed(names)] + [(f, short(f)) for c in CLASS_NAMES for f in short_forms(c)])
OF = one_of(whole("d" + "[oaóãõà0]s?"), cased(r"D[OA]S?\b"))
IN = one_of(whole("n[oaóãà0]s?"), whole("e[mn]"))
LINK = one_of(SOME + one_of(IN, OF, whole("de")) + SOME, rf"{ANY}[-–]{ANY}", SOME)
CHAIN = maybe(words(ORDINALS.split()), SOME) + CLASS + f"(?:{LINK}{CLASS})*"
COURT = by_initial([(c, cased(c.replace("S", "[S5]"), r"\b")) for c in COURTS] + [(n, word(n)) for names in COURTS.values() for n in listed(names)])
STATE = cased(one_of(*STATES))
COURTESIES = maybe(one_of(words(COURTESY.split()), cased(one_of(*sorted(COURTESY_SHORT.split(), key=len, reverse=True)), r"\.")), ANY)
_REGIONAL = cased(one_of(r"TJ[A-Z]{2,3}", *(rf"{t}{BLANK}?-?{BLANK}?{more}" for t, more in (("TRF", r"\d"), ("TRT", r"\d{1,2}"), ("TRE", "[A-Z]{2}"))), "TNU", "TCU", "TJ"))
OTHER_COURT = one_of(whole(_REGIONAL), words(listed(OTHER_COURTS)))
#: "nº", "n.", "No", "número".
_ORDINAL_SIGN = "[º°oOóòÓ0]"
MARKER = one_of(rf"n\.?{ANY}{_ORDINAL_SIGN}\.?(?=[^{LETTER}])", cased(r"[nN]\."), cased(r"N[oO]\b\.?"), word("número"))
MARKED = maybe(MARKER, ANY)
#: Two groups: the court, or another one than those of the knowledge base.
WHOSE = one_of(kept(COURT), kept(OTHER_COURT))


# ---- Families. Each: kind, priority, names of its groups in order, pattern. Of one kind an earlier one goes first.


def numbered() -> str:
    court = maybe(ANY, ",?", SOME, OF, SOME, kept(COURT))
    gap = one_of(rf"{ANY}[-–]{ANY}", rf"{ANY},?{ANY}{MARKED}")
    hyphen = rf"{BLANK}*[-–]{BLANK}*"
    incident = one_of(hyphen, BLANK + "+") + cased(one_of(*INCIDENTS.split())) + maybe(hyphen, words("segundo terceiro quarto quinto".split()))
    incidents = kept("(?:" + whole(incident) + ")+") + "?"
    state = maybe(one_of(rf"{ANY}[/\-–—]{ANY}", rf"{ANY}\({ANY}", BLANK + "+"), kept(STATE), whole(r"\)?"))
    return START + kept(CHAIN) + court + gap + kept(NUMBER) + incidents + state


def case_number() -> str:
    state = maybe(one_of(rf"{ANY}[/\-–—]{ANY}", rf"{ANY}\({ANY}", BLANK + "+"), kept(STATE), whole(r"\)?"))
    return START + kept(words("processo autos feito".split())) + ANY + MARKED + kept(NUMBER) + state


def hyphenated() -> str:
    """Case-sensitive: TST-E-RR-, Ag-ROT-."""
    hyphen = rf"{ANY}-{ANY}"
    return rf"(?<![{LETTER}\-])" + kept(maybe("T[S5]T", hyphen), "(?:[A-Z][A-Za-z]{0,7}", hyphen, ")+") + kept(NUMBER)


STATEMENT = one_of(word("súmula"), word("súm") + r"\.?", word("enunciado"))
_BINDING = word("vinculante")
_POINT = maybe(rf"{ANY},{ANY}", maybe(word("item"), SOME), ROMAN, maybe(ANY, ","))


def statement() -> str:
    kind = one_of(kept(cased("SV")) + r"\.?", STATEMENT + maybe(ANY, MARKED, kept(_BINDING)))
    whose = maybe(ANY, maybe(",", ANY), one_of(OF + SOME + COURTESIES, "/" + ANY), WHOSE)
    return START + kind + ANY + MARKED + kept(SHORT_NUMBER) + _POINT + whose


def statement_of_list() -> str:
    """"Enunciado 83 da Súmula do STJ"."""
    head = one_of(word("enunciado"), word("verbete")) + ANY + MARKED + kept(SHORT_NUMBER)
    return START + head + SOME + OF + SOME + word("súmula") + maybe(SOME, kept(_BINDING)) + maybe(ANY, ",?", ANY, OF, SOME, COURTESIES, WHOSE)


def statement_court_first() -> str:
    """"Súmula STJ 83", "Súmula do STJ nº 83"."""
    return START + STATEMENT + maybe(SOME, kept(_BINDING)) + SOME + maybe(OF, SOME) + WHOSE + ANY + ",?" + ANY + MARKED + kept(SHORT_NUMBER)


def theme() -> str:
    quality = maybe(SOME, one_of(words(THEME_QUALITIES), cased(r"RG\b")))
    tail = maybe(one_of(rf"{ANY}/{ANY}{COURT}", SOME + one_of(OF, "de") + SOME + one_of(words(THEME_TAILS), COURT)))
    return START + word("tema") + quality + ANY + MARKED + kept(NUMBER) + tail


LAW_NAME = by_initial((n, whole(cased(n)) if n.upper() == n else word(n)) for names in LAWS.values() for n in listed(names))
_MONTH = words([*MONTHS])
LAW_KIND = one_of(word("lei complementar"), cased("LC"), word("decreto-lei"), cased("DL"), word("lei"), cased(r"L\."))
_LAW_DATE = one_of(rf"{ANY}/{ANY}" + one_of(r"\d{4}", r"\d{2}") + r"(?!\d)", maybe(",") + SOME + "de" + SOME + maybe(r"\d{1,2}[º°o]?", SOME, "de", SOME, _MONTH, SOME, "de", SOME) + r"\d{4}(?!\d)")
LAW_NUMBER = LAW_KIND + ANY + MARKED + r"\d{1,2}(?:\.?\d{3})?" + maybe(_LAW_DATE)
_QUOTE = "['‘’\"“”]"


def law_article() -> str:
    paragraph = rf"§+{ANY}\d+{ANY}[º°o]?" + maybe(rf"{ANY}-{ANY}", whole("[A-Z]"))
    letter = one_of(word("alínea") + ANY + _QUOTE + "?" + whole("[a-z]") + _QUOTE + "?", f"{_QUOTE}[a-z]{_QUOTE}", r"[a-z]\)", rf"(?<=,{SPACE})" + whole("[a-z]"))
    part = one_of(paragraph, word("parágrafo único"), word("caput"), one_of(word("inciso"), word("inc") + r"\.") + SOME + ROMAN, letter, ROMAN)
    number = kept(one_of(rf"\d{{1,2}}(?:[.{SPACE[1:-1]}]\d{{3}})+", r"\d{1,4}")) + ANY + maybe(r"\.?[º°o]", f"(?![{LETTER}])")
    suffix = kept(rf"{ANY}-{ANY}", whole("[A-Z]")) + "?"
    parts = f"(?:{ANY},?{ANY}{maybe('e', SOME)}{part})*"
    year = maybe(rf"{ANY}/{ANY}", kept(one_of(r"\d{4}", r"\d{2}")), r"(?!\d)")
    return START + one_of(word("artigo"), word("art") + r"\.?") + ANY + number + suffix + parts + one_of(rf"{ANY},?{ANY}{OF}{SOME}", rf"{ANY},{ANY}") + kept(one_of(LAW_NUMBER, LAW_NAME)) + year


_MINISTER = one_of(word("ministra"), word("ministro"), word("min") + r"\.?")
#: A name's word begins with a capital, or with a figure or letter read for one; figures may be read within.
_INITIAL = one_of("[A-ZÀ-Ý]", "5(?=[a-zà-ÿ])", "[l1|](?=[b-df-hj-np-tv-zç])")
_NAME_WORD = one_of(_INITIAL + rf"[{LETTER}'´`015]+", r"[A-ZÀ-Ý]\.")
_BREAK = rf"{BLANK}*(?:\r?\n{BLANK}*)?"
NAME = cased(_NAME_WORD, "(?:", _BREAK, maybe(one_of(*(x for p in "de da do dos das e".split() for x in (p, p.capitalize(), p.upper()) if x != "E")), rf"(?![{LETTER}])", _BREAK), _NAME_WORD, ")*")


def incomplete() -> str:
    """A ruling by court, year and rapporteur, without a number."""
    head = one_of(words(RULING_HEADS.split()), CHAIN) + maybe(SOME, words(RULING_QUALITIES.split()))
    when = maybe(words(RULING_VERBS.split()), SOME) + one_of(IN, "d[ec]", rf"no{SOME}ano{SOME}d[ec]") + SOME + kept(YEAR)
    about = f"(?:{ANY},?{ANY}{one_of(OF + SOME + kept(COURT), when)}){{0,2}}"
    title = maybe(_MINISTER, ANY)
    leading = one_of(word("pela"), word("sob"), OF, word("com"), "d[ec]") + SOME + maybe("a", SOME) + word("relatoria") + SOME + maybe(one_of(OF, "d[ec]"), SOME) + title
    by = one_of(leading, word("rel") + rf"\.{ANY}{title}", word("relator") + rf"[ao]?{ANY}:?{SOME}" + maybe("[oa]", SOME) + title, word("rel") + SOME + title)
    return START + head + about + rf"{ANY},?{ANY}" + by + kept(NAME)


FAMILIES = (
    ("numerada", 3, ("cadeia", "trib", "num", "sufixo", "uf"), numbered()),
    ("processo_cnj", 1, ("cadeia", "num", "uf"), case_number()),
    ("hifenizada", 1, ("cadeia", "num"), hyphenated()),
    ("sumula", 5, ("sv", "vinc", "num", "trib", "outro"), statement()),
    ("sumula", 5, ("num", "vinc", "trib", "outro"), statement_of_list()),
    ("sumula", 5, ("vinc", "trib", "outro", "num"), statement_court_first()),
    ("tema", 4, ("num",), theme()),
    ("lei", 5, ("num", "suf", "lei", "leiano"), law_article()),
    ("incompleta", 2, ("trib", "ano", "nome"), incomplete()),
)

#: What every family begins with: a place without it needs no family tried.
_CLASS_STARTS = [s for names in CLASS_NAMES.values() for n in listed(names) for s in word_starts(n)] + [s for c in CLASS_NAMES for f in short_forms(c) for s in short_starts(f)]
_WORDS = [*ORDINALS.split(), *RULING_HEADS.split(), *"processo autos feito súmula súm enunciado verbete tema artigo art".split()]
FAMILY_START = NO_LETTER_BEFORE + starts([*_CLASS_STARTS, *(s for w in _WORDS for s in word_starts(w)), ("S", "V"), ("[A-Z]", "[A-Za-z]{0,7}", ANY, "-")])

# ---- Vague phrases

VAGUE_PATTERN = START + kept(words(VAGUE)) + NO_LETTER_AFTER
_STEP = cased(rf"[{LETTER}0-9'´`-]+")
_END = one_of(r"[,.;:()\n]", SOME + words(PHRASE_ENDS) + NO_LETTER_AFTER)
#: Groups: what leads to the phrase, the phrase.
SLOT_PATTERN = START + kept(words(SLOTS), SOME, words(ARTICLES.split()), SOME) + kept(maybe(_STEP, SOME), whole(words(HEADS.split())), f"(?:(?!{_END}){SOME}{_STEP}){{0,10}}")
#: The same after an article alone, for sentences that a model calls vague.
_SOURCE = whole(words(SOURCE_HEADS.split()))
_BY = one_of(*sorted([*ARTICLES.split(), "pelo", "pela", "pelos", "pelas"], key=len, reverse=True))
_VERB = SOME + whole(one_of(*sorted(SOURCE_VERBS.split(), key=len, reverse=True)))
_PLAIN_STEP = cased(rf"[{LETTER}'´`-]+")
SOURCE_PATTERN = START + kept(_BY, SOME) + kept(maybe(_PLAIN_STEP, SOME), _SOURCE, f"(?:(?!{one_of(_END, _VERB)}){SOME}{_PLAIN_STEP}){{0,7}}")

# ---- Cues: what makes a sentence worth a second look

_FEW = r"[\dOolISB]\d"
_NAMED = one_of(word("súmula"), word("súm") + r"\.", word("enunciado"), word("verbete"), word("tema"), word("art") + one_of("igos?", "s", "") + r"\.?")
_REPORTER = one_of(word("rel") + r"\.", whole(word("relator") + "a?"), whole(word("relatoria")), word("min") + r"\.", whole(word("ministr") + "[oa]"))
_COURT_SIGN = cased(r"\b" + one_of("[S5]T[FJM]", "T[S5][ET]") + r"\b")
LONG_NUMBER = r"(?<![\d/])\d[\d.\-\s]{4,}\d(?![\d/])"
CUE_PATTERN = "(?iu)" + one_of(rf"(?<![{LETTER}])" + _NAMED + ANY + MARKED + _FEW, rf"(?<![{LETTER}])" + _REPORTER, _COURT_SIGN, LONG_NUMBER)
REPORTER_PATTERN = START + _REPORTER
#: A source behind an article.
HEAD_PATTERN = START + one_of(*sorted(ARTICLES.split(), key=len, reverse=True)) + SOME + maybe(r"\w+", SOME) + whole(words(HEADS.split()))
ANY_HEAD = START + whole(words(HEADS.split()))
ANY_SOURCE = START + _SOURCE
#: Before a long number: leaves, sums, registrations.
NO_CITATION_BEFORE = "(?iu)" + one_of(r"fls?\.", r"R\$", r"OAB[\s/\-:A-Z]*", word("protocolo") + maybe(ANY, r"n[º°o.]*"), "CPF", "CNPJ", "CEP", "RG") + ANY + "$"
TITLE = r"^[\sIVXLC\d.—–-]*[A-ZÀ-Ý\s—–\-,.:]+$"
CLOSING = START + whole(words(CLOSINGS))
ATTACKED_PATTERN = "(?iu)" + rf"(?<![{LETTER}])" + one_of(*ATTACKED.split()) + "[oa]s?" + f"(?![{LETTER}])"
PLAIN_YEAR = r"(?<![\d])(?:19|20)\d\d(?!\d)"
