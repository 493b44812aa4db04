"""Every operator over hard rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from lorewell.llm.registry import QUERIES

BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def small(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None), (3, ""), (4, "hi")], BENCH)
    labels = spark.createDataFrame([(1, 1, 0), (7, None, None), (4, 0, 1), (4, 0, 1)], LABELS)
    turns = [(1, 0, "user", "hi"), (1, None, None, None), (1, 0, "user", "hi"), (None, 0, "user", "no conversation"), (20, 0, "", ""), (21, 5, "user", "x y"), (-3, 1, "user", "x y")]
    return {"benchmark": bench, "labels": labels, "conversations": spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")}


PER_ROW = ["op2_license_scan", "op3_hilbert_sharding", "op5_exact_dedup", "op6_pii", "op7_mixing", "op8_minhash_near_dedup", "op9_quality_classifier", "op10_toxicity", "op13_bpe"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hard_rows(spark, hard, tables, small, name):
    rows = QUERIES[name](spark, tables(documents=hard, **small)).collect()
    if name in PER_ROW:
        assert len(rows) == hard.count()
        ids = sorted(str(r.doc_id) for r in rows)
        assert ids == sorted(str(r.doc_id) for r in hard.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, hard, tables, small, name):
    assert QUERIES[name](spark, tables(documents=hard.limit(0), **{k: v.limit(0) for k, v in small.items()})).collect() == []


def values(df):
    """Rows as text, in any order; shards and positions of equal rows may change places."""
    return sorted(str([getattr(r, c) for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_clashing_columns(spark, hard, tables, small, name, tmp_path):
    extra = hard
    for c in ("row", "score", "key", "node", "digest", "size", "shard", "words", "id", "_row", "_part", "_cell", "window", "kept", "_k", "cell", "slot", "source_size", "pattern", "_text", "again"):
        extra = extra.withColumn(c, F.lit("clash"))
    plain = values(QUERIES[name](spark, tables(documents=hard, **small)))
    extra.write.parquet(str(tmp_path / "more" / "documents.parquet"))
    for k, v in small.items():
        v.write.parquet(str(tmp_path / "more" / f"{k}.parquet"))
    assert values(QUERIES[name](spark, str(tmp_path / "more"))) == plain


def by_id(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(getattr(r, c) for c in columns))
    return out


def test_values_of_hard_rows(spark, hard, tables, small):
    sf = tables(documents=hard, **small)
    run = lambda name, *columns: by_id(QUERIES[name](spark, sf), *columns)
    near = run("op8_minhash_near_dedup", "n_shingles", "component_id", "kept")
    assert near[1] == near[2] == near[3] == [(0, 1, True)] or (near[1], near[2], near[3]) == ([(0, 1, True)], [(0, 2, True)], [(0, 3, True)])
    assert near[7] == [(1, 7, True)] * 2 and near[8] == [(1, 7, False)] and near[5][0][1:] == (4, False) and near[None] == [(2, None, True)]
    exact = run("op5_exact_dedup", "keep_id", "group_size", "kept")
    assert exact[1] == [(1, 2, True)] and exact[2] == [(1, 2, False)] and exact[3] == [(3, 1, True)] and exact[7] == [(7, 2, True)] * 2 and exact[None] == [(None, 1, True)]
    assert run("op2_license_scan", "n_words", "n_base", "labels")[1] == [(0, 0, "")] and run("op2_license_scan", "n_words")[9] == [(4,)]
    assert all(v == [(0, "")] * len(v) for v in run("op6_pii", "n_email", "spans").values())
    mix = run("op7_mixing", "size", "taken")
    assert mix[1] == mix[2] == mix[3] == [(0, 0)] and len(mix[7]) == 2 and all(0 <= t <= 2 * n for v in mix.values() for n, t in v)
    quality = run("op9_quality_classifier", "score", "kept")
    assert quality[1] == quality[2] == [(0.0, False)] and quality[7][0] == quality[7][1]
    toxic = run("op10_toxicity", "score", "held_out")
    assert toxic[1] == [(toxic[2][0][0], toxic[1][0][1])] and toxic[7][0] == toxic[7][1] and toxic[None][0][1] is False
    sizes = run("op3_hilbert_sharding", "size", "text_crc32")
    assert sizes[1] == [(1, 0)] and sizes[6] == [(200_001, sizes[6][0][1])]
    assert run("op4_benchmark_decontamination", "item_id") == {}


def test_pipeline_over_hard_rows(spark, hard, tables, small):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, tables(documents=hard, **small))
    assert set(hard.columns) < set(rows.columns)
    rows.collect()


def test_pipeline_over_empty_table(spark, hard, tables, small):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, tables(documents=hard.limit(0), **small)).collect() == []


ODD = ("a-b", "a.b", "a b", "meta.url", "source-url", "`tick`", "score", "row", "_text", "kept")


def test_odd_column_names_through_every_stage(spark, hard, tables, small):
    import corpus_pipeline

    extra = hard
    for c in ODD:
        extra = extra.withColumn(c, F.lit("x:" + c))
    sf = tables(documents=extra, **small)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(QUERIES["op9_quality_classifier"](spark, sf).collect()) == hard.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(extra.columns)] == extra.columns, name
        rows = out.collect()
        assert rows and all(r[c] == "x:" + c for r in rows for c in ODD), name
    assert {r["a.b"] for r in corpus_pipeline.run(spark, sf).collect()} == {"x:a.b"}


def test_all_junk_is_rejected(spark, documents, tables, small):
    sf = tables(documents=documents([f"#{i}$% ^^{i * 7} ||~~ {{}}<> @@ ++={i}" for i in range(200)]), **small)
    assert {(r.score, r.kept) for r in QUERIES["op9_quality_classifier"](spark, sf).collect()} == {(0.0, False)}
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf).collect() == []


@pytest.mark.parametrize("text", ["call ſeven ſeven six now", "sİx seven one", "ſix ſeven eight nine zero one two three four five", "call plus ſix ſeven", "\u212a dot com"])
def test_letters_that_fold_to_ascii(text):
    from lorewell.llm.pii import find

    base, every = find(text)
    assert not any(base.values())
    if text.startswith("ſix"):
        assert every["phone"] == [(0, len(text))]
