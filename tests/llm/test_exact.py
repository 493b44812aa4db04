import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lorewell.llm import exact_dedup, mixing, sharding
from lorewell.llm.registry import QUERIES
from lorewell.llm.shared import lookup


def test_op5_against_brute_force(spark, sf):
    docs = {r.doc_id: re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    groups = defaultdict(list)
    for i, t in docs.items():
        groups[t].append(i)
    for r in QUERIES["op5_exact_dedup"](spark, sf).collect():
        g = groups[docs[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(g), len(g), r.doc_id == min(g))
        assert r.text_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_index_persists_and_appends(spark, documents, scratch, tmp_path):
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, "index_one", 4)
    exact_dedup.dedup(documents([(1, "a b"), (2, "c"), (3, "a  b")]), index, scratch).collect()
    again = exact_dedup.DigestIndex(spark, path, "index_two", 4)  # another session's name for the same path
    out = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(documents([(0, "a\tb"), (5, "new"), (6, "new")]), again, scratch).collect()}
    assert out == {0: (1, False), 5: (5, True), 6: (5, False)}
    assert again.table().count() == 3


def test_lookup_finds_hot_and_cold_keys(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 == 1, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    keyed = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    out = lookup(rows, keyed, "k", "n").collect()
    assert len(out) == 2000
    for r in out:
        assert r.n == (None if r.k is None else 667 if r.k == "hot" else 1)


def test_hilbert_neighbours_touch(spark):
    bits = 3
    axes = [F.col("id") % 8, F.floor(F.col("id") / 8) % 8, F.floor(F.col("id") / 64)]
    cells = spark.range(8**3).select(*[a.cast("int").alias(f"a{i}") for i, a in enumerate(axes)])
    rows = cells.withColumn("h", sharding.hilbert_index([F.col("a0"), F.col("a1"), F.col("a2")], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(8**3))
    for x, y in zip(rows, rows[1:], strict=False):
        assert abs(x.a0 - y.a0) + abs(x.a1 - y.a1) + abs(x.a2 - y.a2) == 1


def test_op3_contract(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_hilbert_sharding"](spark, sf).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_prune(spark, documents, scratch):
    """A reader of one source, language or length opens far fewer shards by their least and greatest values than with shards by hash."""
    rnd = random.Random(3)
    rows = [(i, "x", rnd.choice(["de", "en", "es", "fr"]), f"src{rnd.randrange(40):02d}", int(10 ** rnd.uniform(0, 5))) for i in range(4000)]
    shards = defaultdict(list)
    for r in sharding.shard(scratch, documents(rows), 64, ["doc_id", "lang", "source", "n_chars"]).collect():
        shards[r.shard].append((r.source, r.lang, r.n_chars))
    dealt = defaultdict(list)
    for i, _, lang, source, n in rows:
        dealt[zlib.crc32(str(i).encode()) % 64].append((source, lang, n))

    def opened(parts, wanted):
        """wanted: a range, or None, of each dimension"""
        return sum(all(w is None or (min(r[d] for r in p) <= w[1] and w[0] <= max(r[d] for r in p)) for d, w in enumerate(wanted)) for p in parts.values())

    for wanted, most in (((("src07", "src07"), None, None), 32), ((None, ("de", "de"), None), 32), ((None, None, (1, 50)), 32), ((("src07", "src07"), ("fr", "fr"), None), 16), ((("src20", "src22"), ("en", "en"), (1000, 3000)), 12)):
        assert opened(shards, wanted) <= most < opened(dealt, wanted), wanted


def test_shard_keeps_rows_of_null_and_repeated_ids(spark, documents, scratch):
    rows = [(None, f"t{i}", "en", "a", 2) for i in range(50)] + [(1, f"u{i % 2}", None, None, None) for i in range(50)]
    out = sharding.shard(scratch, documents(rows), 7, ["doc_id", "text", "lang", "source", "n_chars"]).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 7
    assert len({(r.shard, r.slot) for r in out}) == 100


def shares(sizes, share=1.5, weights=(3, 1, 2), cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        whole = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / whole > cap * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / whole for s in free}
        out |= {s: float(cap * sizes[s]) for s in above}
        left, free = left - sum(cap * sizes[s] for s in above), free - above
    return out


def test_op7_contract(spark, sf):
    docs = {r.doc_id: (r.source, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = Counter()
    for s, n in docs.values():
        sizes[s] += n
    want = shares(sizes)
    taken = Counter()
    rows = QUERIES["op7_mixing"](spark, sf).collect()
    for r in rows:
        source, n = docs[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[source])
        assert abs(r.target - want[source]) < 1e-6
        assert 0 <= r.taken <= 2 * n
        taken[source] += r.taken
    longest = max(n for _, n in docs.values())
    assert all(abs(taken[s] - want[s]) <= 2 + 2 * longest / mixing.PACKETS for s in sizes)
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    again = {r.doc_id: (r.taken, r.position) for r in QUERIES["op7_mixing"](spark, sf).collect()}
    assert again == {r.doc_id: (r.taken, r.position) for r in rows}


def test_mix_is_fair_at_every_moment(spark, documents, scratch):
    """In the mix's order no source runs ahead of its share by more than a document."""
    docs = documents([(i, "w " * (1 + i % 5), "en", "abc"[i % 3 if i % 2 else 0], 5) for i in range(300)])
    rows, line = mixing.mix(scratch, docs)
    of = {r._row: r for r in rows.collect()}
    served = Counter()
    for r in line.orderBy("position").collect():
        served[of[r._row].source] += r.words
        assert served[of[r._row].source] <= r.finish * of[r._row].target + 1e-6


def test_the_running_sum_alone_cuts_the_mix(spark, documents, scratch):
    """Without the cut more words would be served; with it the budget is met exactly and every source is near its target."""
    docs = documents([(i, "w " * (1 + i * 37 % 900), "en", "abcde"[i % 5], 5) for i in range(100)])
    rows, line = mixing.mix(scratch, docs)
    of = {r._row: r for r in rows.collect()}
    taken = Counter()
    for r in line.collect():
        taken[of[r._row].source] += r.words
    total = sum(r.size for r in of.values())
    assert sum(taken.values()) == int(1.5 * total) < 2 * total
    for r in of.values():
        assert abs(taken[r.source] - r.target) <= 2


def test_mix_serves_rows_of_null_and_repeated_ids(spark, documents, scratch):
    rows, line = mixing.mix(scratch, documents([(None, f"a b {i}", "en", "s", 5) for i in range(20)] + [(1, "x y", "en", None, 3)] * 20), share=1.0, cap=1)
    assert rows.count() == 40 and line.agg(F.sum("words")).first()[0] == 100


def test_index_compacts(spark, documents, scratch, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), "index_compacted", 2)
    for k in range(3):
        exact_dedup.dedup(documents([(10 * k + i, f"text {k} {i}") for i in range(10)]), index, scratch).collect()
    before = sorted(map(tuple, index.table().collect()))
    index.compact(scratch)
    assert sorted(map(tuple, index.table().collect())) == before and len(index.table().inputFiles()) <= 2
    assert [r.keep_id for r in exact_dedup.dedup(documents([(99, "text  1 3")]), index, scratch).collect()] == [13]
