"""Toxicity classifier with a counterfactual penalty.

A logistic model over the presence of words and of their beginnings is fitted on a bounded sample of labelled documents.
In every sentence of that sample which mentions an identity term, the term is swapped for each other term of its group;
the fit penalises the squared difference of the logits of the sentence and of its counterfactual, so that a neutral
mention of a group moves no score. Scoring looks at whole texts on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, slices, small_or_not, staged, table, texts

#: Identity terms, a group per line; a term is swapped for the others of its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "ausländer", "deutsche"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "étrangers", "français"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "extranjeros", "españoles"),
)
THRESHOLD = 0.3
_TOKEN = regex.compile(r"\p{L}+")
_SENTENCE = regex.compile(r"[^.!?\n]+")


#: Words that a worker remembers with their weighted terms at most.
WORDS = 100_000


@dataclass
class ToxicityModel:
    """Logit of a text: bias + the weights of the distinct terms() that it has."""

    weights: dict[str, float]
    bias: float
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict, init=False, repr=False, compare=False)

    def logit(self, text: str) -> float:
        found: set[str] = set()
        known, w = self._known, self.weights
        for word in words_of(text):
            of = known.get(word)
            if of is None:
                if len(known) >= WORDS:
                    known.clear()
                of = known[word] = tuple([t for t in terms_of(word) if t in w])
            if of:
                found.update(of)
        return self.bias + sum(w[t] for t in sorted(found))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))


def words_of(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower()))


def terms(words: set[str]) -> set[str]:
    """The words, and the beginnings (x-) of three to eight letters of longer words. An identity term counts only
    whole, so that all it adds to a score is under the penalty."""
    return {t for w in words for t in terms_of(w)}


def terms_of(word: str) -> list[str]:
    return [word] if word in _GROUP_OF else [word, *[word[:n] + "-" for n in range(3, min(9, len(word)))]]


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """(sentence, counterfactual) for each identity term in a sentence of the text and each other term of its group: the
    sentence with every mention of the term swapped for the other."""
    if not words_of(text) & _GROUP_OF.keys():
        return []
    out = []
    for s in _SENTENCE.findall(text):
        for t in sorted(words_of(s) & _GROUP_OF.keys()):
            for o in _GROUP_OF[t]:
                if o != t:
                    out.append((s, _TOKEN.sub(lambda m, t=t, o=o: o if m[0].lower() == t else m[0], s)))
    return out


def difference(sentence: str, other: str) -> str:
    """What changes between the terms of two sentences: "-term" and "+term", in order, by spaces."""
    a, b = terms(words_of(sentence)), terms(words_of(other))
    return " ".join(sorted([f"-{t}" for t in a - b] + [f"+{t}" for t in b - a]))


_GROUP_OF = {t: g for g in IDENTITY_TERMS for t in g}


def labelled(labels: DataFrame, column: str, mod: int, out: int, max_rows: int) -> DataFrame:
    """doc_id, y: the rows that may be learnt from, about max_rows of them at most, chosen by a hash of doc_id.

    Rows whose crc32(doc_id as text) mod ``mod`` is ``out``, null ids and null labels are left out; a doc_id with
    several labels takes the largest.
    """
    ok = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % mod != out))
    ok = ok.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    ok = staged(ok, "labels")
    n = ok.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(mod)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_rows / max(n, 1)))
    return ok.where(part)


def held_out(mod: int, out: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == out, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, min_docs: int = 5, penalty: float = 1.0, l2: float = 3e-4, steps: int = 300) -> ToxicityModel:
    """Fits on at most about ``max_rows`` labelled documents (the documented bound; all of their text is used).

    Features are all terms in ``min_docs`` sampled documents or more whose presence departs from independence of the
    label by over five standard deviations (a term that says nothing passes with probability 6e-7, so of the millions of
    terms of a sample about one does), and all terms that a counterfactual changes. No label, source, lang or doc_id
    enters a score. With no usable label nothing is known to be toxic: every text scores 0 (to 13 places); with one class
    only, near that class's share.
    Null and empty texts have no terms; a doc_id that several rows have is learnt from once per row.
    """
    chosen = labelled(labels, "toxic", 4, 2, max_rows)
    rows = chosen.count()
    sample = docs.select("doc_id", F.col("text").cast("string")).join(small_or_not(chosen, rows), "doc_id").select("y", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = texts(b.column("text"))
            words = pa.array([sorted(terms(words_of(x))) for x in t], pa.list_(pa.string()))
            swaps = pa.array([[d for pair in counterfactuals(x) if (d := difference(*pair))] for x in t], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("y"), words, swaps], ["y", "words", "swaps"])

    sample = staged(sample.mapInArrow(sets, "y int, words array<string>, swaps array<string>"), "toxic-sample")
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return ToxicityModel({}, -30.0)
    per_word = sample.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("k")).where(F.col("n") >= min_docs)
    p = (n1 + 1) / (n + 2)
    z = F.abs(F.col("k") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    telling = [r.word for r in per_word.where(z > 5).select("word").collect()]
    # counterfactuals that change the same terms have the same effect: they are counted
    swaps = sorted((r.swap.split(" "), r.n) for r in sample.select(F.explode("swaps").alias("swap")).groupBy("swap").agg(F.count("*").alias("n")).collect())
    vocab = {w: i for i, w in enumerate(sorted({*telling, *(c[1:] for s, _ in swaps for c in s)}))}

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = [[vocab[w] for w in ws if w in vocab] for ws in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(at, pa.list_(pa.int32()))], ["y", "at"])

    got = sample.mapInArrow(indices, "y int, at array<int>").toArrow().combine_chunks()
    y = got["y"].to_numpy().astype(float)
    lists = got["at"].combine_chunks()
    column = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    change = [(i, vocab[c[1:]], 1.0 if c[0] == "+" else -1.0) for i, (s, _) in enumerate(swaps) for c in s]
    w, bias = fit(row, column, y, len(vocab), change, np.array([k for _, k in swaps], float), penalty, l2, steps)
    return ToxicityModel({t: float(w[i]) for t, i in vocab.items() if abs(w[i]) > 1e-4}, bias)


def fit(row: np.ndarray, column: np.ndarray, y: np.ndarray, size: int, change: list[tuple[int, int, float]], times: np.ndarray, penalty: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic loss + l2 * |w|^2 + penalty * mean over counterfactuals of (logit change)^2, by Adam on the whole sample.

    change: (counterfactual, term, sign); times: how often each counterfactual occurs.
    """
    n, x = len(y), np.zeros(size + 1)
    rate = (y.sum() + 0.5) / (n + 1)
    x[-1] = np.log(rate / (1 - rate))
    m, v = np.zeros_like(x), np.zeros_like(x)
    order = np.lexsort((row, column))
    row, column = row[order], column[order]
    pair, term, sign = (np.array(c) for c in zip(*change, strict=True)) if change else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    share = times / max(times.sum(), 1)
    for k in range(1, steps + 1):
        z = np.bincount(row, x[column], n) + x[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(column, r[row], size) / n + 2 * l2 * x[:-1] * rate, r.mean())
        if len(pair):
            moved = np.bincount(pair, sign * x[term], len(times)) * share
            g[:-1] += 2 * penalty * np.bincount(term, sign * moved[pair], size)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8) * min(1.0, 3 * (1 - k / (steps + 1)))
    return x[:-1], float(x[-1])


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with toxicity (double): the score of each whole text; null and empty texts get the model's bias."""
    kept = [c for c in docs.columns if c != "toxicity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = pa.array([model.score(t) for t in texts(b.column("text"))], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), s], [*kept, "toxicity"])

    docs = docs.select(*kept)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("toxicity", DoubleType())]))


def op3_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every document. Null doc_ids are never held out; null and empty texts get the model's bias."""
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", F.col("text").cast("string")), model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
