"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is one last token in its BPE encoding. An automaton over the vocabulary (Aho-Corasick:
its suffix links are those of a suffix automaton of the tokens) reports, for every position, the tokens that end there,
longest first; a token is the prefix's last one if the pair that it forms with the last token of the prefix before it is
compatible: merging in rank order leaves both tokens standing. Back pointers from the word's end give the exact ids.
Normaliser and word pattern are read from the tokenizer's file. Words are encoded once per worker and kept in a cache
bounded in bytes.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts

_END = "</w>"
_STOP = "\ue000"  # stands for the end mark inside the automaton; byte symbols never use it
#: What \s means in the file's patterns: the white-space property, without the separators 1C to 1F that Python adds.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACES = regex.compile(_SPACE + "+")
#: Pairs whose compatibility a worker remembers at most, and bytes of words that it keeps encoded at most.
PAIRS, CACHE = 200_000, 128 << 20


def _pattern(file_pattern: str) -> regex.Pattern:
    """A pattern of the file with its meaning of \\s, alone or inside a class."""
    out, inside, at = [], False, 0
    while at < len(file_pattern):
        two = file_pattern[at : at + 2]
        if two[0] == "\\" and len(two) == 2:
            out.append((_SPACE[1:-1] if inside else _SPACE) if two == r"\s" else two)
            at += 2
            continue
        inside = two[0] == "[" or inside and two[0] != "]"
        out.append(two[0])
        at += 1
    return regex.compile("".join(out))


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else text.replace("Σ", "σ").lower()


def _one_space(text: str) -> str:
    """Every run of white space as one space; for ASCII texts by bytes, whose own split knows exactly their white space."""
    if not text.isascii():
        return _SPACES.sub(" ", text)
    data = text.encode()
    parts = data.split()
    if not parts:
        return " " if data else ""
    return " " * (data[:1].isspace()) + b" ".join(parts).decode() + " " * (data[-1:].isspace())


def normaliser(d: dict | None) -> Callable[[str], str]:
    """The file's normaliser: a sequence of NFC, replacement and lower case; another kind is an error."""
    if d is None:
        return lambda text: text
    if d["type"] == "Sequence":
        steps = [normaliser(x) for x in d["normalizers"]]

        def run(text: str) -> str:
            for step in steps:
                text = step(text)
            return text

        return run
    if d["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
        return lambda text: text if text.isascii() else unicodedata.normalize(d["type"], text)
    if d["type"] == "Replace" and d["pattern"] == {"Regex": r"\s+"} and d["content"] == " ":
        return _one_space
    if d["type"] == "Replace" and "Regex" in d["pattern"]:
        found, new = _pattern(d["pattern"]["Regex"]), d["content"].replace("\\", r"\\")
        return lambda text: found.sub(new, text)
    if d["type"] == "Lowercase":
        return _lower
    raise ValueError(f"normaliser {d['type']} is not known")


def word_pattern(d: dict) -> str:
    """The pattern whose matches are the words: an inverted split that drops the rest, then bytes as symbols."""
    split, *rest = d["pretokenizers"]
    if split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed" or [x["type"] for x in rest] != ["ByteLevel"] or rest[0]["add_prefix_space"] or rest[0]["use_regex"]:
        raise ValueError("the word splitter of this file is not known")
    return split["pattern"]["Regex"]


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it prints, else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


@dataclass
class Encoder:
    """Encodes as the tokenizer file says: added tokens cut out first, then NFC, spaces, lower case, words, BPE."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    added: dict[str, int]
    word_pattern: str
    normalise: Callable[[str], str]
    cache_bytes: int = CACHE
    names: dict[int, str] = field(init=False)

    def __post_init__(self) -> None:
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self._of_byte = byte_symbols()
        self._words = _pattern(self.word_pattern)
        self._added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # tokens are numbered by the rank of the merge that makes them, atoms first
        atoms = [t for t in self.vocab if len(t.removesuffix(_END)) == 1 or t == _END]
        made = {a + b: (a, b) for a, b in reversed(self.merges)}
        rank = {t: i for i, t in enumerate(atoms)}
        for a, b in self.merges:
            rank.setdefault(a + b, len(rank))
        self._rank, self._pairs = rank, {(rank[a], rank[b]): rank[a + b] for a, b in reversed(self.merges)}
        self._split = [(i, i) for i in range(len(rank))]
        for t, (a, b) in made.items():
            if t not in atoms:
                self._split[rank[t]] = (rank[a], rank[b])
        self._id = [self.vocab[t] for t in rank]
        self._compatible: dict[int, bool] = {}
        self._automaton = ahocorasick.Automaton()
        for t, r in rank.items():
            short = t.replace(_END, _STOP)
            if self._stands(t, r):
                self._automaton.add_word(short, (len(short), r))
        self._automaton.make_automaton()
        self._known: dict[str, tuple[bytes, str]] = {}
        self._before: dict[str, tuple[bytes, str]] = {}
        self._held = 0

    def _stands(self, token: str, r: int) -> bool:
        """Whether merging the token's own symbols gives the token itself."""
        a, b = self._split[r]
        return a == r or self._joins(a, b) == r and self._valid(a, b, r)

    def _joins(self, a: int, b: int) -> int | None:
        return self._pairs.get((a, b))

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' texts together is these two tokens."""
        key = a << 32 | b
        found = self._compatible.get(key)
        if found is None:
            if len(self._compatible) >= PAIRS:
                self._compatible.clear()
            found = self._compatible[key] = self._valid(a, b, len(self._id))
        return found

    def _valid(self, a: int, b: int, limit: int) -> bool:
        """Undoes the merges of both tokens from the latest to the first; a merge across the seam that would have
        come before the one undone last shows that the pair could not stand."""
        pairs, split = self._pairs, self._split
        while True:
            across = pairs.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b and split[a][0] != a or split[b][0] == b:
                if split[a][0] == a:
                    return True
                limit, a = a, split[a][1]
            else:
                limit, b = b + 1, split[b][0]

    def word_ranks(self, symbols: str) -> list[int]:
        """Ranks of one word's tokens, symbols as in the vocabulary without the end mark."""
        n = len(symbols) + 1
        last: list[tuple[int, int] | None] = [None] * (n + 1)  # by prefix length: (its last token, length of the rest)
        known, done = self._compatible, 0
        for end, (length, r) in self._automaton.iter(symbols + _STOP):
            upto = end + 1
            if upto == done or upto == n - 1:  # the last symbol never stands without the end mark
                continue
            before = upto - length
            if before:
                p = last[before]
                if p is None:
                    continue
                ok = known.get(p[0] << 32 | r)
                if not (self.compatible(p[0], r) if ok is None else ok):
                    continue
            last[upto] = (r, before)
            done = upto
        out, at = [], n
        while at:
            found = last[at]
            if found is None:  # symbols that no token covers
                return self._slow(symbols)
            out.append(found[0])
            at = found[1]
        return out[::-1]

    def _slow(self, symbols: str) -> list[int]:
        """Merging by rank with a heap, for words with symbols that the vocabulary lacks; those are dropped."""
        parts = [self._rank[s] for s in [*symbols[:-1], symbols[-1] + _END] if s in self._rank]
        n = len(parts)
        after, before, alive = [*range(1, n), -1][:n], [*range(-1, n - 1)], [True] * n
        heap = [(self._pairs[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self._pairs]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = r, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (parts[x], parts[y]) in self._pairs:
                    heappush(heap, (self._pairs[parts[x], parts[y]], x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def _learnt(self, word: str) -> tuple[bytes, str]:
        if found := self._before.get(word):
            return self._kept(word, found)
        symbols = word if word.isascii() and word.isprintable() and " " not in word else "".join([self._of_byte[b] for b in word.encode()])
        ids = [self._id[r] for r in self.word_ranks(symbols)]
        out = struct.pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids])
        return self._kept(word, out)

    def _kept(self, word: str, out: tuple[bytes, str]) -> tuple[bytes, str]:
        """Two generations of half the bound each: what is asked for again outlives the clearing."""
        self._held += 2 * len(word) + len(out[0]) + len(out[1]) + 350  # and what the entry itself takes
        if 2 * self._held > self.cache_bytes:
            self._before, self._known, self._held = self._known, {}, 0
        self._known[word] = out
        return out

    def _pieces(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        at = 0
        for m in self._added.finditer(text) if self._added else ():
            yield self.words(text[at : m.start()]), self.added[m.group()]
            at = m.end()
        yield self.words(text[at:] if at else text), None

    def words(self, text: str) -> list[str]:
        return self._words.findall(self.normalise(text))

    def encode_packed(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the decoded text."""
        ids, shown = [], []
        for words, after in self._pieces(text):
            new = self._learnt
            found = [self._known.get(w) or new(w) for w in words]
            ids.extend([f[0] for f in found])
            shown.extend([f[1] for f in found])
            if after is not None:
                ids.append(struct.pack("<I", after))
                shown.append(self.names[after])
        return b"".join(ids), " ".join(filter(None, shown))

    def encode(self, text: str) -> list[int]:
        packed = self.encode_packed(text)[0]
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: the tokens' own texts, joined by spaces; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(content: str) -> Encoder:
    d = json.loads(content)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"]]
    return Encoder(d["model"]["vocab"], merges, {t["content"]: t["id"] for t in d["added_tokens"]}, word_pattern(d["pre_tokenizer"]), normaliser(d["normalizer"]))


_MADE: dict[str, Encoder] = {}


def encoded(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 (and ids if asked for), for each row's whole text.

    Null texts are empty: no ids, digests of nothing. A column of docs that has the name of a new one is dropped.
    The tokenizer file is read on the driver and sent to the workers; it is never copied anywhere.
    """
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    new = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + keep_ids]
    docs = docs.drop(*new)
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(sent.value.encode()).hexdigest()
        e = _MADE.get(key) or _MADE.setdefault(key, encoder(sent.value))
        for b in slices(batches):
            n, h, d, ids = [], [], [], []
            for t in texts(b.column("text")):
                packed, shown = e.encode_packed(t)
                n.append(len(packed) // 4)
                h.append(hashlib.sha256(packed).hexdigest())
                d.append(hashlib.sha256(shown.encode()).hexdigest())
                if keep_ids:
                    ids.append(packed)
            more = [pa.ListArray.from_arrays(pa.array([0, *accumulate(n)], pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))] if keep_ids else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string()), *more], [*kept, *new])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{types}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op10_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every document; null texts are empty, repeated and null doc_ids are rows of their own."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("string"))
    return encoded(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
