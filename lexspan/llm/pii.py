"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, scheme marks and identifier cues. Local
parsers look left and right of an anchor only as far as the span may reach, and validate it. The base kinds (email,
ip, card, phone) are exactly the leftmost non-overlapping matches of their patterns; url and account are added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: Words that announce an account or a secret.
CUES = ("iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte", "ssn", "passport", "token", "api_key", "apikey", "api-key", "secret", "password", "passwd", "access_key")
_ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGIT = frozenset("0123456789")
_LOCAL = frozenset(_ASCII + "0123456789._%+-")
_LABEL = frozenset(_ASCII + "0123456789-")
_PHONE = frozenset(" ().0123456789-")
_VALUE = frozenset(_ASCII + "0123456789_-+/=.")
_ALNUM = frozenset(_ASCII + "0123456789")

Span = tuple[str, int, int]


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in _DIGIT:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def email_at(text: str, p: int, floor: int) -> Span | None:
    """Around the at-sign at p: local part back to floor, then labels joined by at least one dot."""
    s = p
    while s > floor and text[s - 1] in _LOCAL:
        s -= 1
    n, e = len(text), p + 1
    while e < n and text[e] in _LABEL:
        e += 1
    if s == p or e == p + 1:
        return None
    first = e
    while e + 1 < n and text[e] == "." and text[e + 1] in _LABEL:
        e += 2
        while e < n and text[e] in _LABEL:
            e += 1
    return ("email", s, e) if e > first else None


def phone_at(text: str, p: int) -> Span | None:
    n = len(text)
    if p + 1 >= n or text[p + 1] not in _DIGIT:
        return None
    e, last, digits, upto = p + 2, -1, 1, 1
    while e < n and text[e] in _PHONE:
        if text[e] in _DIGIT:
            digits += 1
            if e >= p + 3:
                last, upto = e, digits
        e += 1
    return ("phone", p, last + 1) if last > 0 and 10 <= upto <= 15 else None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(run: str) -> bool:
    run = run.lstrip("0")
    return len(run) < 3 or len(run) == 3 and run <= "255"


def digit_spans(text: str, at: list[int]) -> list[Span]:
    """ip and card spans from the positions of all digits."""
    runs: list[list[int]] = []
    for p in at:
        if runs and runs[-1][1] == p:
            runs[-1][1] = p + 1
        else:
            runs.append([p, p + 1])
    out: list[Span] = []
    i = 0
    while i < len(runs):  # chains joined by single dots: every four runs are one match
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] == ".":
            j += 1
        for k in range(i, j - 2, 4):
            if all(_small(text[a:b]) for a, b in runs[k : k + 4]):
                out.append(("ip", runs[k][0], runs[k + 3][1]))
        i = j + 1
    i = 0
    while i < len(runs):  # chains joined by single spaces or hyphens are one match
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
        if 14 <= sum(b - a for a, b in runs[i : j + 1]) <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            out.append(("card", runs[i][0], runs[j][1]))
        i = j + 1
    return out


def url_at(text: str, p: int) -> Span | None:
    """A web address that names a user: scheme://user@host or scheme://user:word@host."""
    s = p
    while s > 0 and text[s - 1] in _ALNUM and p - s < 16:
        s -= 1
    e = p + 3
    n = len(text)
    at = -1
    while e < n and text[e] not in " \t\n\x0b\x0c\r\"'<>/":
        if text[e] == "@":
            at = e
        e += 1
    return ("url", s, e) if s < p and at > p + 3 and e > at + 1 else None


def iban(value: str) -> bool:
    value = value.upper()
    if not 15 <= len(value) <= 34 or not value[:2].isalpha() or not value[2:4].isdigit():
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


class Runs:
    """Runs of value characters of one text. The last run read is kept, so that cues within a run read it once."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end, self.digit = text, 0, 0, -1

    def value_end(self, s: int) -> tuple[int, bool]:
        """End of the run from s, without full stops at its end, and whether a digit is in it."""
        text = self.text
        if not self.start <= s < self.end:
            e, n = s, len(text)
            while e < n and text[e] in _VALUE:
                e += 1
            self.start, self.end, self.digit = s, e, e - 1
            while self.digit >= s and text[self.digit] not in _DIGIT:
                self.digit -= 1
            self.bare = e
            while self.bare > s and text[self.bare - 1] == ".":
                self.bare -= 1
        return max(self.bare, s), self.digit >= s


def account_at(text: str, start: int, end: int, runs: Runs) -> Span | None:
    """The value after a cue: an IBAN, or eight or more value characters with a digit among them after = or :."""
    n = len(text)
    if start and text[start - 1] in _ALNUM or end < n and text[end] in _ALNUM:
        return None
    e, mark = end, False
    while e < n and e - end < 12 and text[e] in " \t=:\"'#":
        mark |= text[e] in "=:#"
        e += 1
    s = e
    e, digit = runs.value_end(s)
    grouped, g = "", s
    while g < n and len(grouped) < 34 and (text[g] in _ALNUM or text[g] == " " and g + 1 < n and text[g + 1] in _ALNUM):
        grouped += text[g].strip()
        g += 1
        if len(grouped) > 14 and (g == n or text[g] not in _ALNUM) and iban(grouped):
            return ("account", s, g)
    return ("account", s, e) if mark and digit and e - s >= 8 else None


def find(text: str) -> list[Span]:
    """All spans by start, then kind as listed."""
    digits: list[int] = []
    out: list[Span] = []
    email_end = cue_end = url_end = 0
    runs = Runs(text)
    for end, (what, length) in _automaton().iter(text):
        p = end + 1 - length
        if what == "digit":
            digits.append(p)
            continue
        if what == "at":
            found = email_at(text, p, email_end)
            if found:
                email_end = found[2]
        elif what == "plus":
            found = phone_at(text, p)
        elif what == "scheme":
            found = url_at(text, p) if p >= url_end else None
            if found:
                url_end = found[2]
        else:
            found = account_at(text, p, end + 1, runs) if p >= cue_end else None
            if found:
                cue_end = found[2]
        if found:
            out.append(found)
    if digits:
        out += digit_spans(text, digits)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first covers the others."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, masked: bool = False) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256, spans; if ``masked``, text and n_chars are of the masked text.

    Whole texts are read; a null text is empty for the counts and stays null when masked. A column of docs that has
    the name of a new one is dropped. Offsets are code points, ends exclusive.
    """
    new = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    docs = docs.drop(*new)
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            all_spans = [find(t) for t in texts(b.column("text"))]
            columns = {c: b.column(c) for c in kept}
            if masked:
                t = [None if x is None else mask(x, s) for x, s in zip(b.column("text").to_pylist(), all_spans, strict=True)]
                columns["text"] = pa.array(t, pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if x is None else len(x) for x in t], pa.int64()).cast(b.column("n_chars").type)
            base = [[s for s in spans if s[0] in BASE] for spans in all_spans]
            columns |= {f"n_{k}": pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE}
            columns["base_sha256"] = pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string())
            columns["spans"] = pa.array([joined(s) for s in all_spans], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{types}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op6_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every document: counts and digest of the base spans, and all spans. Null texts are empty; rows
    with null or repeated doc_ids are rows of their own; other columns are not read."""
    out = scanned(documents(spark, sf_dir).select("doc_id", F.col("text").cast("string")))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
