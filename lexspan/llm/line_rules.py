"""Quality rules by cross-document line frequency.

Every document's distinct normalised lines are hashed and counted per host (the ``source``). Lines in more documents
of a host than its limit are removed from them; a document with too few words left, or that breaks a base rule, goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, documents, staged, texts

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOL = regex.compile(r"[#*$%&|<>]")
_DIGITS = regex.compile(r"[0-9]+")
WINDOW = 8


def line_key(line: str) -> int | None:
    """Hash of a line in lower case, white space as one space, digit runs as 0; None if it has no word."""
    words = line.lower().translate(_TO_SPACE).split(" ")
    joined = " ".join(w for w in words if w)
    return xxhash.xxh3_64_intdigest(_DIGITS.sub("0", joined).encode()) - (1 << 63) if joined else None


_TO_SPACE = {ord(c): " " for c in _SPACE}
#: Spaces that str.split would cut at, but a word may hold.
_ODD_SPACE = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    if _ODD_SPACE.search(text):
        return [w for w in text.translate(_TO_SPACE).split(" ") if w]
    return text.split()


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[str, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    # exact ids for windows by doubling: pairs of ids become ids
    span = 1
    while span < window:
        pair = at[:-span] * (int(at.max()) + 1) + at[span:]
        at = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span *= 2
    again = np.bincount(at)[at] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def base(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = words_of(text)
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            dup += line in seen
            seen.add(line)
    again = repeat_words(words)
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), dup, again, n < 20 or 100 * again > 30 * n


def line_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """host, line, n: in how many documents (rows) of the host the normalised line occurs, if in two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, lines = [], []
            for h, t in zip(b.column("host").to_pylist(), texts(b.column("text")), strict=True):
                keys = {k for x in t.split("\n") if (k := line_key(x)) is not None}
                hosts += [h] * len(keys)
                lines += keys
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(lines, pa.int64())], ["host", "line"])

    rows = docs.select(F.col(host).cast("string").alias("host"), F.col("text").cast("string")).mapInArrow(run, "host string, line long")
    return rows.groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")


def frequent_lines(docs: DataFrame, host: str = "source", share: float = 0.02, least: int = 10) -> DataFrame:
    """host, line, n: lines in more than max(least, share * documents) documents of their host."""
    size = docs.groupBy(F.col(host).cast("string").alias("host")).agg(F.count("*").alias("docs"))
    counts = line_counts(docs, host).where(F.col("n") > least)
    far = counts.join(size, counts["host"].eqNullSafe(size["host"])).where(F.col("n") > F.col("docs") * share)
    return far.select(counts["host"], "line", "n")


def judged(docs: DataFrame, host: str = "source", share: float = 0.02, least: int = 10, depleted: float = 0.5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_words, kept.

    A document is kept if it breaks no base rule and at least ``depleted`` of its words are outside frequent lines.
    Null texts have no words and fail. Null hosts are one host. Repeated rows are documents of their own. A column
    of docs that has the name of a new one is dropped. Frequent lines are few by their limit: a line needs a share of
    a host's documents. Up to ``broadcast_rows`` go to every worker; more are joined by host and line.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_words", "kept"]
    docs = docs.drop(*new)
    frequent = staged(frequent_lines(docs, host, share, least), "frequent-lines")
    kept = docs.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def stats(b: pa.RecordBatch) -> list[pa.Array]:
        rows = list(zip(*(base(t) for t in texts(b.column("text"))), strict=True)) or [[]] * 6
        return [pa.array(r, pa.int64()) for r in rows[:5]] + [pa.array(rows[5], pa.bool_())]

    if frequent.count() <= broadcast_rows:
        bad: dict[str | None, set[int]] = {}
        for h, x, _ in frequent.collect():
            bad.setdefault(h, set()).add(x)
        sent = docs.sparkSession.sparkContext.broadcast(bad)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            far = sent.value
            for b in batches:
                base_columns = stats(b)
                left = []
                for h, t, n in zip(b.column(host).cast(pa.string()).to_pylist(), texts(b.column("text")), base_columns[0].to_pylist(), strict=True):
                    lines = far.get(h)
                    left.append(n - sum(len(words_of(x)) for x in t.split("\n") if line_key(x) in lines) if lines else n)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *base_columns, pa.array(left, pa.int64())], [*kept, *new[:7]])

        out = docs.mapInArrow(run, f"{types}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, left_words long")
    else:
        out = _joined(docs, host, frequent, stats, types, new)
    whole = ~F.col("base_failed") & (F.col("left_words") >= depleted * F.col("n_words"))
    return out.withColumn("kept", whole)


def _joined(docs: DataFrame, host: str, frequent: DataFrame, stats, types: str, new: list[str]) -> DataFrame:  # noqa: ANN001
    """The way beyond the broadcast bound: words lost per (host, text) by a join of lines, then joined to the documents."""
    kept = docs.columns

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for h, t in zip(b.column("host").to_pylist(), texts(b.column("text")), strict=True):
                per: dict[int, int] = {}
                for x in t.split("\n"):
                    if (k := line_key(x)) is not None:
                        per[k] = per.get(k, 0) + len(words_of(x))
                key = xxhash.xxh3_128_hexdigest(t.encode())
                out += [(h, key, k, n) for k, n in per.items()]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["host", "text_key", "line", "words"])

    per_line = docs.select(F.col(host).cast("string").alias("host"), F.col("text").cast("string")).mapInArrow(lines, "host string, text_key string, line long, words long")
    per_line = per_line.groupBy("host", "text_key", "line").agg(F.first("words").alias("words"))  # equal texts once
    f = frequent.select(F.col("host").alias("h_"), F.col("line").alias("l_"))
    lost = per_line.join(f, (F.col("line") == F.col("l_")) & F.col("host").eqNullSafe(F.col("h_"))).groupBy("host", "text_key").agg(F.sum("words").alias("lost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = pa.array([xxhash.xxh3_128_hexdigest(t.encode()) for t in texts(b.column("text"))], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *stats(b), key], [*kept, *new[:6], "text_key_"])

    rows = docs.mapInArrow(run, f"{types}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, text_key_ string")
    lost = lost.select(F.col("host").alias("h_"), F.col("text_key").alias("k_"), F.col("lost").alias("lost_"))
    rows = rows.join(lost, (F.col("text_key_") == F.col("k_")) & F.col(host).cast("string").eqNullSafe(F.col("h_")), "left")
    return rows.select(*kept, *new[:6], (F.col("n_words") - F.coalesce("lost_", F.lit(0))).alias("left_words"))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every document, and the words left; nulls, ties and repeated rows as in judged()."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    out = judged(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_words")
