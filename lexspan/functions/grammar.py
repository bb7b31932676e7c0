"""Small builders of Java patterns: words that survive misreading, short forms, numbers. Plain string functions; the
families of citations in families.py are put together from them.

Classes name their white space, as Java's \\s has no no-break space. What may be very long is possessive, as Java's
matcher recurses on the rest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from .vocabulary import MISREAD, OCR_LETTERS

LETTER = "A-Za-zÀ-ÿ"
#: White space of any kind, and the kind that stays on a line.
SPACE = r"[\t-\r\x1c- \x85\xa0  -     　]"
BLANK = r"[ \t\xa0  ]"
HYPHENS = r"‐‑‒–—−"
SOME, ANY = f"{SPACE}+", f"{SPACE}*"


def one_of(*options: str) -> str:
    """The first option that matches; put longer ones first."""
    return "(?:" + "|".join(options) + ")"


def maybe(*parts: str) -> str:
    return f"(?:{''.join(parts)})?"


def kept(*parts: str) -> str:
    """A group whose text is returned."""
    return f"({''.join(parts)})"


def cased(*parts: str) -> str:
    """Case matters here. Also where a class lists both cases itself: a class by its letters alone is the fastest."""
    return f"(?-iu:{''.join(parts)})"


#: No letter before, none after.
NO_LETTER_BEFORE, NO_LETTER_AFTER = cased(f"(?<![{LETTER}])"), cased(f"(?![{LETTER}])")


def whole(*parts: str) -> str:
    """Not followed by a letter."""
    return "".join(parts) + NO_LETTER_AFTER


def listed(text: str) -> list[str]:
    """The entries of a comma-separated vocabulary line."""
    return [x.strip() for x in text.split(",") if x.strip()]


# ---- Words


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def _readings() -> dict[str, str]:
    """Base letter -> class of all that it may be read as: itself and its accented forms in both cases, and misreadings."""
    forms: dict[str, set[str]] = {}
    for c in map(chr, [*range(0x61, 0x7B), *range(0xE0, 0x100)]):
        base = plain(c)
        if base.isascii() and base.isalpha():
            forms.setdefault(base, set()).update((c, c.upper()))
    for c, more in MISREAD.items():
        forms[c].update(more, more.upper())
    return {c: "[" + "".join(re.escape(x) for x in sorted(s) if len(x) == 1) + "]" for c, s in forms.items()}


READINGS = _readings()


def word(text: str) -> str:
    """Pattern of a word or phrase in any case, with or without accents, misread letter by letter, over any white space."""
    letters = ((one_of("[mM]", "[rR][nN]") if c == "m" else READINGS.get(c, re.escape(c))) for c in plain(text.lower()) if c != " ")
    lengths = [len(w) for w in plain(text.lower()).split()]
    out, letters = [], iter(letters)
    for n in lengths:
        out.append("".join(next(letters) for _ in range(n)))
    return cased(SOME.join(out))


def words(texts: Iterable[str]) -> str:
    """Any of several words or phrases."""
    return by_initial((t, word(t)) for t in texts)


def by_initial(forms: Iterable[tuple[str, str]]) -> str:
    """Alternation of (text, pattern): a look at one character decides which few are tried, of those longer texts first."""
    groups: dict[str, list[tuple[str, str]]] = {}
    for text, pattern in forms:
        groups.setdefault(plain(text.lower())[0], []).append((text, pattern))
    out = []
    for initial in sorted(groups):
        seen = READINGS.get(initial, re.escape(initial))
        if initial == "m":
            seen = seen[:-1] + "rR]"
        out.append(cased(f"(?={seen})") + one_of(*(p for _, p in sorted(groups[initial], key=lambda f: -len(f[0])))))
    return one_of(*out)


# ---- Short forms

_SIGN = {"S": "[S5]", "s": "[s5]", "l": "[l1I]", "I": "[I1l]", "O": "[O0]", "o": "[o0]"}


def short(form: str) -> str:
    """Pattern of a short form in its own case. Full stops may be missing or be followed by a blank, capitals may stand
    apart by a dot; letters after the first may be misread, so that no short form begins with a digit. Three letters and
    more also in capitals. What is two letters or fewer is not followed by a digit."""
    parts = re.findall(r"-|[A-Z][a-z]*|[a-z]+", form)
    dotted = "." in form

    def signs(text: str) -> str:
        return "".join(_SIGN.get(c, c) for c in text)

    spelled = []
    for k, p in enumerate(parts):
        if p == "-":
            spelled.append("-?")
            continue
        spelled.append(p[0] + signs(p[1:]) if not k else signs(p))
        if dotted and k < len(parts) - 1:
            spelled.append(r"\.?" + SPACE + "?")
    bare = "".join(p for p in parts if p != "-")
    forms = ["".join(spelled)]
    if len(bare) > 2 and bare.upper() != bare:
        forms.append(bare[0].upper() + signs(bare[1:].upper()))
    end = f"(?![{LETTER}])" if len(bare) > 2 else f"(?![{LETTER}0-9])"
    return cased(one_of(*forms), end, r"\.?" if dotted or len(bare) > 2 else "")


# ---- First characters: what a pattern can begin with

#: Characters of a form that a look ahead tells apart.
_DEEP = 6


def word_starts(text: str) -> list[tuple[str, ...]]:
    """The classes of a word's or phrase's first characters, one way for each reading of an m."""
    out: list[tuple[str, ...]] = [()]
    for c in plain(text.lower())[:_DEEP]:
        signs = [(SOME,)] if c == " " else [("[mM]",), ("[rR]", "[nN]")] if c == "m" else [(READINGS.get(c, re.escape(c)),)]
        out = [way + s for way in out for s in signs]
    return out


def short_starts(form: str) -> list[tuple[str, ...]]:
    """The same of a short form, with what may stand between its parts; of a whole one also what ends it."""
    bare = re.sub("[^A-Za-z]", "", form)
    end = f"(?![{LETTER}])" if len(bare) > 2 else f"(?![{LETTER}0-9])"
    between = rf"\.?{SPACE}?" if "." in form else "-?" if "-" in form else ""
    parts = re.findall(r"[A-Z][a-z]*|[a-z]+", form)
    signs = [(between if n and not k else "") + (c if not n and not k else _SIGN.get(c, c)) for n, p in enumerate(parts) for k, c in enumerate(p)]
    spelled = [signs]
    if len(bare) > 2 and bare.upper() != bare:
        spelled.append([bare[0].upper(), *(_SIGN.get(c, c) for c in bare[1:].upper())])
    return [tuple(s[:_DEEP]) + ((end,) if len(s) <= _DEEP else ()) for s in spelled]


def starts(forms: Iterable[tuple[str, ...]]) -> str:
    """Pattern of what begins with one of these: a tree of classes, so that most text fails at its first characters. It
    only looks ahead."""
    tree: dict = {}
    for form in forms:
        at = tree
        for sign in form:
            at = at.setdefault(sign, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        return "" if "" in at else one_of(*(sign + pattern(more) for sign, more in at.items()))

    return cased(f"(?={pattern(tree)})")


def key_of_short(form: str) -> str:
    """What stays of a short form that is found: letters in their case, without marks."""
    return re.sub("[^A-Za-z]", "", form)


#: Letters, and the one of those taken for each other that stands for them.
TAKEN = ("i1|0c59@", "llloesga")


def key_of_name(text: str) -> str:
    """What stays of a name that is found, whatever has been misread: plain lower-case letters, those that are taken for
    each other as one."""
    return plain(text.lower()).replace("rn", "m").translate(str.maketrans(*TAKEN)).replace(" ", "")


# ---- Numbers: figures, look-alike letters among them, in groups that joints or blanks hold together

_ALIKE = "[" + re.escape(OCR_LETTERS) + "]{1,3}"
JOINT = rf"[.\-{HYPHENS}]"


def figures() -> str:
    """A group: digits, with up to three look-alike letters before, between and after them that touch no other letter."""
    before = maybe(f"(?<![{LETTER}])", _ALIKE, r"(?=\d)")
    between = rf"(?:{_ALIKE}\d++)*+"
    after = maybe(_ALIKE, rf"(?![{LETTER}\d])")
    return before + r"\d++" + between + after


def letters_for_figures() -> str:
    """A group of look-alike letters only, if a joint and a digit follow."""
    return rf"(?<![{LETTER}\d]){_ALIKE}(?={JOINT}\d)"


def held_together() -> str:
    """Between groups: one or two joints with blanks and a line end about them, a line end, or one or two blanks."""
    about = rf"{BLANK}*+(?:\r?\n{BLANK}*+)?"
    return one_of(about + JOINT + about + maybe(JOINT, about), rf"{BLANK}*+\r?\n{BLANK}*+", BLANK + "{1,2}")


_GROUP = one_of(figures(), letters_for_figures())
NUMBER = cased(rf"{_GROUP}(?:{held_together()}{_GROUP})*+")
#: One to four figures that end there.
SHORT_NUMBER = cased(rf"(?=\S{{0,3}}\d)(?:\d|(?<=\d){_ALIKE}(?![{LETTER}])|(?<![{LETTER}])[{re.escape(OCR_LETTERS)}](?=\d)){{1,4}}(?![\d.]\d)(?![{LETTER}])")
#: A year, of which figures after the first may be misread.
YEAR = cased(rf"(?:1[9g]|2[0OoQD])[\d{re.escape(OCR_LETTERS)}]{{2}}(?![\dA-Za-z])")
ROMAN = whole(cased("[IVXLCDM]+"))
