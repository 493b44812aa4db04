import hashlib
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.functions import globs, ids, scores, text, vectors


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first().x


def plain_tokens(t):
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.category(c).startswith("M"))
    return re.findall("[a-z0-9_]+", "".join(c.lower() if c < "\x80" else c for c in t))


@pytest.mark.parametrize("t", ["", "Ação São-Paulo_1", "e\u0301tude É", "日本 x", "İstanbul K ﬁ", "a|b\tc", "ß Œ ñ"])
def test_tokens_match_decomposition(spark, t):
    assert one(spark, text.tokens("t"), t=t) == plain_tokens(t)


def test_content_terms(spark):
    assert one(spark, text.content_terms("t"), t="The cat e o gato, the CAT a_1 x é") == ["cat", "gato", "a_1"]
    assert one(spark, text.content_terms("t"), t=None) == []


@pytest.mark.parametrize(("word", "want"), [("as", "as"), ("acoes", "acao"), ("configuracoes", "configur"), ("testes", "teste"), ("gatos", "gato"), ("pagamento", "pagamento"), ("desenvolvimento", "desenvolv"), ("casas", "casa"), ("cantar", "cant"), ("rapidos", "rapido"), ("nao", "nao"), ("dedicado", "dedic")])
def test_stem(spark, word, want):
    got = one(spark, text.stem(F.col("t")), t=word)
    assert got == want and text.query_terms(word) in ([want], [])


def test_snippet_and_lines(spark):
    body = "x" * 100 + " needle " + "y" * 100
    s = one(spark, text.snippet("t", ["needle"], 20), t=body)
    assert "needle" in s and s.startswith("…") and s.endswith("…")
    assert one(spark, text.snippet("t", ["none"], 20), t=body) is None
    assert one(spark, text.one_line("t"), t=" a |\n b ") == "a b"
    assert one(spark, text.token_estimate("t"), t="12345") == 2


def test_missing_slots(spark):
    slots = text.missing_slots(F.col("k"), F.col("b"), F.lit(0), F.lit(0))
    assert one(spark, slots, k="decision", b="Why: because. Options: a, b") == ["consequência"]
    assert one(spark, slots, k="snippet", b="```rust\nx\n```") == ["âncora"]
    assert one(spark, slots, k="question", b="") == ["o que falta (âncora ou depends_on)"]
    assert one(spark, slots, k="fact", b="") == []


CASES = [("src/*.rs", "src/a.rs", True), ("src/*.rs", "src/a/b.rs", False), ("src/**", "src/a/b.rs", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[x]", "[x]", True), ("a.b", "axb", False), ("**", "", True), ("*", "a/b", False), ("a+b(c)|^$", "a+b(c)|^$", True)]


@pytest.mark.parametrize(("pattern", "path", "want"), CASES)
def test_globs(spark, pattern, path, want):
    assert one(spark, globs.matches(F.col("p"), F.col("t")), p=pattern, t=path) is want
    assert bool(re.match(globs.to_regex(pattern), path)) is want


def test_denied(spark):
    for path, want in {".env.local": True, "a/b/id_rsa": True, "x/secrets.yml": True, "src/main.rs": False, "**/*.pem": True}.items():
        assert one(spark, globs.denied(F.col("t")), t=path) is want


def test_scores(spark):
    w = lambda s, f: one(spark, scores.wilson(F.col("s"), F.col("f")), s=float(s), f=float(f))
    assert w(0, 0) == 0 and abs(w(1, 0) - 0.2065) < 1e-4 and abs(w(20, 0) - 0.8389) < 1e-4
    assert w(5, 5) < w(10, 0) and w(9, 1) < w(90, 10)
    p = lambda s, f: one(spark, scores.posterior_mean(F.col("s"), F.col("f")), s=float(s), f=float(f))
    assert p(0, 0) == 0 and p(1, 0) == 2 / 3 and p(0, 1) == 1 / 3
    ttl = lambda c, r: one(spark, scores.ttl_days(F.col("c"), F.col("r")), c=c, r=r)
    assert (ttl("foundational", 5), ttl("tactical", 0), ttl("tactical", 1), ttl("observational", 3)) == (None, 365, 547, 75)
    r = one(spark, scores.retention(F.col("d"), F.col("t")), d=30.0, t=30)
    assert r == 0.5


def test_confidence_is_bounded(spark):
    c = scores.confidence(F.col("s"), F.col("a"), F.col("l"), F.lit(0.0), F.col("t"), F.col("d"))
    assert one(spark, c, s=1.0, a=1.0, l=0.9, t=1.0, d=0.0) == 1.0
    assert abs(one(spark, c, s=1.0, a=1.0, l=0.0, t=0.0, d=1.0) - 0.5) < 1e-12


def test_ids_and_time(spark):
    want = hashlib.sha256("fact\x1fa b".encode()).hexdigest()[:8]
    n, digits = int(want, 16), ""
    while n:
        n, d = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    got = one(spark, ids.note_id(F.lit("fact"), F.col("t")), t="  a \n b ")
    assert got == f"fact_{digits.zfill(8)}"
    assert one(spark, ids.valid_id(F.col("t")), t=got) and not one(spark, ids.valid_id(F.col("t")), t="fact_XYZ")
    assert one(spark, ids.parse_utc(F.col("t")), t="2026-01-02T03:04:05.678999Z") == 1767323045678
    assert one(spark, ids.parse_utc(F.col("t")), t="2026-01-02T03:04:05+01:00") is None
    assert one(spark, ids.format_utc(F.col("t")), t=1767323045678) == "2026-01-02T03:04:05.678Z"


def test_vectors(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = frame.select(vectors.norm(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("zero"), vectors.unit(F.col("z")).alias("u")).first()
    assert (r.n, r.c, r.zero, r.u) == (5.0, 0.96, 0.0, [0.0, 0.0])
    v = vectors.hash_embedding("x", 64)
    assert abs((v * v).sum() - 1) < 1e-5 and (v == vectors.hash_embedding("x", 64)).all()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_fold_is_idempotent(t):
    assert text.fold_python(text.fold_python(t)) == text.fold_python(t)


def test_tokens_are_cut_once_for_all_slots(spark):
    from pyspark.sql import functions as F

    from lorewell.functions import text

    df = spark.createDataFrame([("decision", "why not; options: two"), ("error", "the root cause"), ("fact", "x"), ("question", ""), (None, None)], "kind string, body string")
    slots = text.missing_slots(F.col("kind"), F.col("body"), F.lit(0), F.lit(0))
    out = df.select("kind", slots.alias("s"))
    assert {r.kind: r.s for r in out.collect()} == {"decision": ["consequência"], "error": ["correção"], "fact": [], "question": ["o que falta (âncora ou depends_on)"], None: []}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert "array_contains" not in df.select(text.content_terms("body"))._jdf.queryExecution().optimizedPlan().toString()
