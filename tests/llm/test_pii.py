"""Personal data against the plain patterns."""

import hashlib
import random
import re
import time

import pytest

from lexspan.llm import pii

from .helpers import SF, odd_documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"[ -]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("alphabet", ["ab.@-1é", "0123.", "01 2-3.+(", "+1() 2-.", "a@b.c +1", "4 -9"])
def test_base_is_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == brute(text), text


def test_card_and_phone():
    text = "😀 4929 3483 8514 6306, +1 (017) 555-7713 x@y.z 10.0.0.255 10.0.0.256"
    assert [s for s in pii.find(text) if s[0] in pii.BASE] == brute(text)
    assert len(brute("4111111111111111")) == 1


def test_added_kinds_and_mask():
    text = 'token = "04dbebab91ab85687d33" https://me:pw@host.example/x IBAN DE89370400440532013000 rest'
    kinds = [s[0] for s in pii.find(text)]
    assert kinds.count("account") == 2 and kinds.count("url") == 1
    assert "04dbebab" not in pii.mask(text, pii.find(text)) and pii.mask(text, pii.find(text)).endswith(" rest")
    assert pii.mask("", pii.find("")) == ""


def test_scanned_edges(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a@b.c", None), (2, "", "y"), (3, "+1 (017) 555-7713 " * 20_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(pii.scanned(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [(r.n_email, r.n_phone) for r in got] == [(1, 0), (0, 0), (0, 0), (0, 0), (0, 20_000)]
    assert pii.scanned(docs.limit(0)).count() == 0
    assert [r.text for r in pii.scanned(docs, masked=True).where("doc_id is null").collect()] == ["[EMAIL]"]


@pytest.mark.parametrize("text", ["token=" * 200_000, "token:. " * 100_000, "iban DE89 " * 50_000, "a@" * 300_000, "http://x@" * 50_000, "1." * 200_000, "+1 " * 100_000, "4 " * 200_000])
def test_very_long_texts_take_time_in_proportion(text):
    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 5


def test_a_cue_in_the_run_of_another():
    text = "token=secret=abc.token=abcd1234.. password=passwd=zzzzzzzzzz"
    assert [s for s in pii.find(text) if s[0] == "account"] == [("account", 6, 31)]
    text = "token=token=token=password=a1b2c3d4e5..."
    assert [text[a:b] for k, a, b in pii.find(text) if k == "account"] == ["token=token=password=a1b2c3d4e5"]


def as_brute(doc_id, text):
    spans = brute(text or "")
    counts = tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))
    return (doc_id, *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())


def test_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = pii.op6_pii_anchors(spark, SF).collect()
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(as_brute(d.doc_id, d.text) for d in docs)
    for r in got:  # base spans stay among all spans
        base = [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_odd_rows(spark):
    docs = odd_documents(spark, "'x' AS n_ip")
    got = pii.scanned(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=key) == sorted((as_brute(d.doc_id, d.text) for d in docs.collect()), key=key)
