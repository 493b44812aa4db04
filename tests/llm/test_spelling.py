"""Spelling variants against brute force over small vocabularies, by value."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from lorewell.llm import spelling
from lorewell.llm.registry import QUERIES


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    """word: (form, root, n, n_near, form_n) of a dict of counts."""
    out = {}
    for w in n:
        others = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form = others[0] if others and n[others[0]] >= 2 * n[w] else None
        out[w] = [form, None, n[w], len(others), n[form] if form else None]
    for w, row in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        row[1] = at
    return {w: tuple(r) for w, r in out.items()}


def counted(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_op12_against_brute_force(spark, documents, tables):
    rng = random.Random(5)
    stems = ["letter", "lettre", "spelling", "spellings", "Écoles", "écoles", "aaaaa", "aaaaaa", "aaaaaaa", "straße", "STRASSE"]
    docs = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aex") + w[at:], w[:at] + rng.choice("aex") + w[at + 1 :]])
            words.append(w)
        docs.append((i, "× ".join(words) if i % 7 else " ".join(words) + "3"))
    docs += [(None, "letter letter letters"), (3, None), (4, ""), (5, docs[5][1])]
    rows = QUERIES["op12_spelling"](spark, tables(documents=documents(docs)))
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows.count() == len(found(rows)) and found(rows) == brute(counted(docs)) != {}


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = counted(docs)
    out = found(QUERIES["op12_spelling"](spark, sf))
    assert {w: r[2] for w, r in out.items()} == n
    sample = random.Random(1).sample(sorted(n), 60)
    whole = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in sample}
    for w, others in whole.items():
        assert out[w][3] == len(others) and out[w][0] == (others[0] if others and n[others[0]] >= 2 * n[w] else None)


@pytest.mark.parametrize("length", [spelling.LONG - 2, spelling.LONG - 1, spelling.LONG, spelling.LONG + 1, spelling.LONG + 2, 300])
def test_long_words_meet_short_ones(spark, scratch, length):
    rng = random.Random(length)
    base = "".join(rng.choice("abé") for _ in range(length))
    n = {base: 100, base[:-1]: 7, base[1:]: 3, base + "a": 40, "z" + base: 4, base[:9] + "z" + base[10:]: 200, base[:9] + "y" + base[10:]: 3, base[:20] + base[21:]: 5, "b" * length: 3, "b" * (length + 1): 9}
    assert found(spelling.variants(scratch, spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_chains_of_forms(spark, scratch):
    n = {"a" * (5 + i): 3 << i for i in range(14)}
    out = found(spelling.variants(scratch, spark.createDataFrame(list(n.items()), "word string, n long")))
    assert out == brute(n) and {r[1] for r in out.values()} == {"a" * 18}


def test_very_long_run(spark, documents, tables):
    run = "x" * 60_000
    docs = [(1, run + " short"), (2, run), (3, run + " short"), (4, "short " + run[1:]), (5, run[1:]), (6, run[1:]), (7, run[1:])]
    rows = found(QUERIES["op12_spelling"](spark, tables(documents=documents(docs))))
    assert rows == {"short": (None, "short", 3, 0, None), run: (None, run, 3, 1, None), run[1:]: (None, run[1:], 4, 1, None)}
