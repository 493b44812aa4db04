"""Encoding and decoding against the library itself, by value."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorewell.llm import bpe
from lorewell.llm.registry import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def both(vocabulary, library, text):
    packed, want = vocabulary.encode(text), library.encode(text, add_special_tokens=False).ids
    assert ids(packed) == want, text[:80]
    assert vocabulary.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_every_plain_code_point(vocabulary, library):
    assert vocabulary.plain
    for a, b in bpe._PLAIN:
        for c in range(a, b + 1):
            both(vocabulary, library, f"x{chr(c)}Y {chr(c)} {chr(c)}{chr(c)}e")


def test_odd_texts(vocabulary, library):
    rng = random.Random(2)
    parts = ["a", "E", "th", "ing", "aaaa", "1", "²", "é", "ß", "İ", "Σ", "ς", "日本", "한", "é", "̀", " ", "\n", " ", " ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'LL", "’", "…", "🙂", "👨‍", "\x00", "\x1c", "\x85", "ﬁ", "Ａ", "Å", "क्", "</w>", "<", "|>", "ǆ", "ᾈ"]
    for _ in range(4000):
        both(vocabulary, library, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))))


def test_words_that_greed_gets_wrong(vocabulary, library):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdeilnorstuhg") for _ in range(rng.randint(1, 30))) for _ in range(6000)})
    out = vocabulary.learn(words)
    wrong = 0
    for w, e in zip(words, library.encode_batch(words, add_special_tokens=False), strict=True):
        assert ids(out[w]) == e.ids
        wrong += vocabulary.proposal(w) != e.ids
    assert 500 < wrong < len(words) - 500


def test_verification_is_exact(vocabulary, library):
    """A pair is compatible exactly when its letters merge to it."""
    rng = random.Random(4)
    inner, final = (sorted(t for t in tokens if t.isascii() and t.isalpha() and t.islower()) for tokens in (vocabulary.inner, vocabulary.final))
    pairs = [(rng.choice(inner), rng.choice(final)) for _ in range(6000)]
    a, b = (np.array([t[p[k]] for p in pairs]) for k, t in enumerate((vocabulary.inner, vocabulary.final)))
    fits = vocabulary.compatible(a, b)
    assert 0 < fits.sum() < len(fits)
    for (x, y), i, j, fit in zip(pairs, a.tolist(), b.tolist(), fits.tolist(), strict=True):
        assert fit == (library.encode(x + y, add_special_tokens=False).ids == [i, j])


def test_periodic_and_long_words(vocabulary, library):
    for unit in ("a", "ab", "-", "aab", "é"):
        for n in (*range(1, 40), bpe.LONG, bpe.LONG + 1, 200, 3000):
            both(vocabulary, library, unit * n)
    both(vocabulary, library, "x" * 100_000 + " tail")


def test_pieces_and_forgotten_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 40)
    monkeypatch.setattr(bpe, "PIECE", 100)
    with open(PATH, encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    monkeypatch.setattr(bpe.pieces, "__defaults__", (100,))
    rng = random.Random(6)
    for _ in range(50):
        both(v, library, " ".join(f"word{rng.randrange(300)}" for _ in range(200)))
    assert len(v.known) <= 40 + 200


def test_op13_against_library(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_bpe"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_ids_and_texts(spark, documents, library):
    texts = ["The cat's 3 hats", "", None, "<|endoftext|> ok"]
    coder = bpe.Coder(spark, PATH)
    encoded = coder.encode(documents(list(enumerate(texts))))
    out = {r.doc_id: r for r in encoded.withColumn("list", bpe.unpacked()).join(coder.decode(encoded).select("doc_id", "text"), "doc_id").collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].list == want and out[i].text == library.decode(want, skip_special_tokens=False)
