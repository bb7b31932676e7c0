import hashlib
import random
import struct

import pytest
import tokenizers

from lexspan.llm import bpe

from .helpers import SF, odd_documents


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        return bpe.encoder(f.read())


POOL = ["a", "the", "ing", "é", "É", "ß", "Σ", "ς", "ΣΑΣ", "İ", "ı", "é", "  ", "\n", "\x1c", "\x85", "\xa0", "　", "​", "'s", "'S", "’s", "'ll", "5", "½", "٣", "日本", "한", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|endof", "</w>", "_", "--", "\x00", "\x7f", "ﬁ", "ǅ", "ᾼ", "﻿", "", "ͅ", "Å", "ſ", "K", "\U00010400"]


def test_odd_strings(encoder, library):
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids, text
        assert encoder.decode(ids) == encoder.encode_packed(text)[1] == library.decode(ids, skip_special_tokens=False)


def test_long_words_and_a_small_cache(encoder, library):
    rng = random.Random(2)
    small = bpe.Encoder(encoder.vocab, encoder.merges, encoder.added, encoder.word_pattern, encoder.normalise, cache_bytes=3_000)
    for n in (1, 5, 30, 3000):
        text = " ".join("".join(rng.choice("abcdeinorst") for _ in range(n)) for _ in range(40))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == small.encode(text) == ids


def test_prefix_table_is_unique_merge_result(encoder):
    for word in ("international", "aaaaaaa", "zzthe", "x"):
        assert encoder.word_ranks(word) == encoder._slow(word)


def test_query_is_the_library(spark, library):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op10_bpe_prefix_dp(spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, library):
    docs = odd_documents(spark, "'x' AS ids")
    got = bpe.encoded(docs, keep_ids=True).collect()
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(library.encode(d.text or "", add_special_tokens=False).ids) for d in docs.collect())
    assert bpe.encoded(docs.limit(0)).count() == 0


def test_words_with_symbols_that_no_token_covers(encoder):
    lacking = bpe.Encoder({t: i for t, i in encoder.vocab.items() if t not in ("q", "q</w>")}, [m for m in encoder.merges if not any("q" in x for x in m)], {}, encoder.word_pattern, encoder.normalise)
    word = "theqinternationalq" * 2_000
    assert lacking.word_ranks("theqinternationalx") == lacking._slow("theqinternationalx") == lacking._slow("theinternationalx")
    assert len(lacking.word_ranks(word)) >= 4_000
    rng = random.Random(3)
    for _ in range(300):
        w = "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 40)))
        assert encoder._slow(w) == encoder.word_ranks(w)


def test_the_file_says_how_to_normalise():
    assert bpe.normaliser({"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": "-"})("a \t\x1cb\xa0c") == "a-\x1cb-c"
    assert bpe.normaliser(None)("Ab") == "Ab"
    plain = bpe.normaliser({"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
    for text in ("", " ", "\t\n", "a", " a", "a ", "\n a \t\r\x0b\x0c b\x1cc\x1f \n", "\xa0a\u3000\u2003 b\x85", "a\x00 b"):
        assert plain(text) == bpe._SPACES.sub(" ", text), repr(text)
    with pytest.raises(ValueError, match="not known"):
        bpe.normaliser({"type": "BertNormalizer"})
