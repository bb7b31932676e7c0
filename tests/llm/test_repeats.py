import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspan.llm import repeats

from .helpers import SF, odd_documents


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh é") for _ in range(5000))
    rows = []
    for _ in range(100):
        a = rng.randint(0, 3000)
        t = list(base[a : a + rng.randint(0, 1500)])
        for _ in range(rng.randint(0, 8)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append("".join(t))
    rows += ["a" * 700, "ab" * 300, "a" * 199, "b" * 200, None, "", base, base]
    rows += ["".join(rng.choice("qwertyuiop") for _ in range(rng.randint(100, 400))) + base[1000:1500] + "".join(rng.choice("qwertyuiop") for _ in range(300)) for _ in range(40)]
    return rows


def rows_of(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(repeats.without_repeats(docs)) == sorted((i, *b) for i, b in enumerate(brute(texts)))


def test_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert rows_of(repeats.op4_prefix_free_repeats(spark, SF)) == sorted((d.doc_id, *b) for d, b in zip(docs, brute([d.text for d in docs]), strict=True))


def by_key(batches):
    rows = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True)), key=lambda r: (r[:4], str(r[4:])))
    names = ["key", "whole", "ref", "place", "data"][: len(rows[0])] if rows else ["key", "whole", "ref", "place"]
    for lo in range(0, len(rows), 7):
        cols = list(zip(*rows[lo : lo + 7], strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.binary()) for c in cols[4:])], names)


@pytest.mark.parametrize("held", [2, 5, 100_000])
@pytest.mark.parametrize("many", [0, 1, 3, 1_000])
def test_large_groups_take_the_other_way(monkeypatch, held, many):
    """The steps without Spark, with small batches and small bounds on what is held and on what goes as one group."""
    monkeypatch.setattr(repeats, "HELD", held)
    monkeypatch.setattr(repeats, "MANY", many)
    texts = [t or "" for t in corpus()]
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["ref", "text"])
    entries = [b for i in range(len(texts)) for b in repeats._parse(iter([docs.slice(i, 1)]))]
    found = list(repeats._grouped(True)(by_key(entries)))
    compare = [r for b in repeats._grouped(False)(by_key(entries)) for r in zip(*(b.column(c).to_pylist() for c in ("key", "whole", "ref", "place")), strict=True)]
    todo = pa.array([[{"key": k, "whole": w, "place": p} for k, w, r, p in compare if r == i] for i in range(len(texts))])
    with_bytes = list(repeats._with_bytes(iter([pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), todo], ["ref", "text", "todo"])])))
    runs = list(repeats._windows(by_key(list(repeats._compared(by_key(with_bytes))))))
    places = {}
    for b in [*found, *runs]:
        for r, p in zip(b.column("ref").to_pylist(), b.column("place").to_pylist(), strict=True):
            places.setdefault(r, []).append(p)
    for i, (n, gone, spans, _) in enumerate(brute(texts)):
        cut = repeats._removed(places.get(i, []), n)
        assert (sum(z - a for a, z in cut), len(cut)) == (gone, spans), i


def test_odd_rows(spark):
    docs = odd_documents(spark, "1 AS n_bytes")
    rows = docs.collect()
    assert rows_of(repeats.without_repeats(docs.where("doc_id IS NULL OR doc_id <> 6"))) == sorted((-1 if r.doc_id is None else r.doc_id, *b) for r, b in zip([r for r in rows if r.doc_id != 6], brute([r.text for r in rows if r.doc_id != 6]), strict=True))
    long = repeats.without_repeats(docs.where("doc_id = 6")).first()
    assert (long.n_bytes, long.n_removed, long.n_spans) == (150_000, 150_000, 1)
    assert repeats.without_repeats(docs.limit(0)).count() == 0
