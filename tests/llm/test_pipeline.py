import re

import corpus_pipeline
from lorewell.llm import near_dedup


def test_stages_hold_their_contracts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing to target weights", "Hilbert sharding"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, sf)
        if k < 4:
            assert out.columns == columns
        assert out.select(*columns).exceptAll(before.select(*columns)).isEmpty()
        before = out.persist()
        kept[name] = {r.doc_id: r for r in before.collect()}
    good, one, pure, mix, final = kept.values()
    assert 0.7 * docs.count() < len(good) <= docs.count()
    sets = {}
    for i, r in good.items():
        w = re.findall("[^\x20\x09-\x0d]+", r.text.lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    ids = sorted(one)
    for a in ids:
        for b in ids:
            if a < b:
                n = len(sets[a] & sets[b])
                assert n * 100 < 80 * (len(sets[a]) + len(sets[b]) - n), (a, b)
    assert len(pure) <= len(one)
    assert set(mix) == set(final)
    slots = {}
    for r in final.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert near_dedup.BANDS * near_dedup.ROWS == near_dedup.BINS


LONG = "the committee met on tuesday and after much talk about the harbour, its walls and the boats in it, agreed to write to the council about all {} of them"
ITEM = "which of these rivers crosses the old border twice before it reaches the northern sea near the tall white lighthouse at dawn"


def test_stages_decide_by_row(spark, documents, tables):
    """Unique texts stay and copies and benchmark items go, whatever ids they share or lack."""
    text = {c: " ".join(f"{c}{w}" for w in LONG.split()) for c in "ABC"} | {"D": ITEM}
    rows = [(3, "A"), (7, "A"), (7, "B"), (9, "C"), (9, "C"), (None, "A"), (None, "D")]
    sf = tables(benchmark=spark.createDataFrame([(1, ITEM)], "item_id long, text string"), documents=documents([(i, text[c]) for i, c in rows]))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    name = {v: k for k, v in text.items()}
    left = lambda df: sorted((str(r.doc_id), name[r.text]) for r in df.collect())
    one = corpus_pipeline.one_of_near_copies(spark, docs, sf)
    assert left(one) == [("3", "A"), ("7", "B"), ("9", "C"), ("None", "D")]
    assert left(corpus_pipeline.uncontaminated(spark, one, sf)) == [("3", "A"), ("7", "B"), ("9", "C")]
    assert left(corpus_pipeline.uncontaminated(spark, docs, sf)) == sorted((str(i), c) for i, c in rows if c != "D")
    mixed = corpus_pipeline.mixed(spark, docs, sf).collect()
    size = sum(len(r.text.split()) for r in docs.collect())
    assert abs(sum(len(r.text.split()) for r in mixed) - 0.9 * size) <= 30 and any(r.doc_id is None for r in mixed)
    shards = corpus_pipeline.sharded(spark, docs, sf)
    assert left(shards) == left(docs)


def test_run_equals_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in docs.collect())
