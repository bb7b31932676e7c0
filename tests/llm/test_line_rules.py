import re
from collections import Counter

from lexspan.llm import line_rules as L

from .helpers import SF, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    again = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), len(words) < 20 or 100 * len(again) > 30 * len(words)


def brute(rows, share=0.02, least=10, depleted=0.5):
    key = lambda x: re.sub("[0-9]+", "0", " ".join(WORD.findall(x.lower())))
    count, docs = Counter(), Counter()
    for _, host, text in rows:
        docs[host] += 1
        count.update({(host, key(x)) for x in (text or "").split("\n") if key(x)})
    out = []
    for doc, host, text in rows:
        b = brute_base(text)
        lost = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if key(x) and count[host, key(x)] > max(least, share * docs[host]))
        out.append((-1 if doc is None else doc, *b, b[0] - lost, not b[5] and b[0] - lost >= depleted * b[0]))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.left_words, r.kept) for r in df.collect())


def test_query_is_brute_force(spark):
    docs = [(d.doc_id, d.source, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(L.op9_line_frequency(spark, SF)) == brute(docs)


def test_both_ways_and_odd_rows(spark):
    docs = odd_documents(spark, "1 AS kept")
    rows = [(d.doc_id, d.source, d.text) for d in docs.collect()]
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon {}"
    rows += [(100 + i, "h", f"Seite {i} von 9\n{body.format(i)}\n" + "same old line here\n" * (i % 3 * 8)) for i in range(30)]
    rows += [(200, "h", "odd space and \x1c mark\nx"), (201, "h", "odd space")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for bound in (50_000, 0):
        assert rows_of(L.judged(docs, broadcast_rows=bound)) == brute(rows)
    assert L.judged(docs.limit(0)).count() == 0


def test_unlike_hosts_do_not_add_up(spark):
    rows = [(i, f"h{i % 40}", "one shared line of text\n" + f"other words {i} " * 10) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert L.frequent_lines(docs).count() == 0
