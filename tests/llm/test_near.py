import random
import re

from pyspark.sql import functions as F

from lorewell.llm import near_dedup, substring_dedup
from lorewell.llm.registry import QUERIES
from lorewell.llm.shared import Scratch


def sets_of(texts, k=4):
    out = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def components_of(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if n * 100 >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}


def check(out, texts, k=4):
    sets = sets_of(texts, k)
    comp = components_of(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got == {i: (len(sets[i]), comp[i]) for i in texts}


def test_op8_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(QUERIES["op8_minhash_near_dedup"](spark, sf).collect(), texts)


def test_families_of_edited_copies(spark, documents, scratch):
    """Copies at all degrees of editing, many just beside the limit; stars alone would lose links."""
    rnd = random.Random(5)
    texts = {}
    for family in range(6):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([12, 40, 150]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 12)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    texts[len(texts)] = "Short one"
    texts[len(texts)] = "short  ONE"
    check(near_dedup.near_duplicates(scratch, documents(list(texts.items()))).collect(), texts)


def test_links_of_rare_members_of_large_buckets(spark, documents, scratch):
    """Seven groups of copies over the same boilerplate are more famous than the two documents that alone are linked across groups."""
    texts = {}
    for seed in (0, 3, 10):
        some = lambda kind, n: [f"{kind}_{j}" for j in range(n)]
        base = some(f"w{seed}", 160)
        rows = [base + some(f"g{seed}_{i}", 22) + some(f"y{seed}_{i}_{d}", 1) for i in range(7) for d in range(16)] + [base + some(f"x{seed}_{d}", 19) for d in (0, 1)]
        texts |= {1000 * seed + i: " ".join(w) for i, w in enumerate(rows)}
    check(near_dedup.near_duplicates(scratch, documents(list(texts.items())), k=1).collect(), texts, 1)


def test_a_dense_family_just_below_the_limit(spark, documents, scratch):
    """Copies of one base with edits of their own are below the limit among each other; a few copies of copies are linked."""
    rnd = random.Random(3)

    def edited(words, n):
        words = list(words)
        for k in rnd.sample(range(0, 300, 5), n):
            words[k] = f"e{rnd.randrange(10**7)}"
        return words

    family = [edited([f"w{i}" for i in range(300)], 6) for _ in range(260)]
    family += [edited(family[rnd.randrange(260)], 7) for _ in range(10)]
    texts = {i: " ".join(w) for i, w in enumerate(family)}
    check(near_dedup.near_duplicates(scratch, documents(list(texts.items()))).collect(), texts)


def test_repeated_and_null_ids_keep_their_own_texts(spark, documents, scratch):
    text = lambda seed: " ".join(f"v{seed}_{i}" for i in range(40))
    rows = [(7, text(1)), (7, text(2)), (3, text(1)), (9, text(3)), (9, text(3)), (None, text(2)), (None, text(4)), (None, text(4)), (5, None)]
    out = near_dedup.near_duplicates(scratch, documents(rows))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in out.collect())
    assert got == sorted([("7", "3"), ("7", "7"), ("3", "3"), ("9", "9"), ("9", "9"), ("None", "7"), ("None", "None"), ("None", "None"), ("5", "5")])
    assert near_dedup.dropped(out).count() == 4


def test_forest_joins_what_all_links_join(spark):
    import pyarrow as pa

    rnd = random.Random(4)
    for _ in range(20):
        n = rnd.randrange(2, 40)
        sets = {i: {rnd.randrange(14) for _ in range(10)} for i in range(n)}
        rows = pa.table({"node": pa.array(range(n), pa.int64()), "root": pa.array(range(n), pa.int64()), "set": pa.array([sorted(s) for s in sets.values()], pa.list_(pa.int64()))})
        out = near_dedup._forest(80)(rows).to_pylist()
        root = components_of(sets)
        assert all(root[r["a"]] == root[r["b"]] for r in out) and len(out) == n - len(set(root.values()))


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (6, 40, 2000):
        hits = []
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(n * 0.8)], rng.integers(0, 2**63, n - int(n * 0.8), dtype=np.uint64)]))
            both = np.concatenate([a, b])
            s = near_dedup.signatures(both, np.array([0, len(a), len(a) + len(b)]))
            c = len(np.intersect1d(a, b))
            hits.append((s[0] == s[1]).mean() - c / (len(a) + len(b) - c))
        assert abs(np.mean(hits)) < 0.05


def test_components_of_long_chains(spark, scratch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(i * 2 + 101, 100) for i in range(20)], "a long, b long")
    roots = {r.node: r.root for r in near_dedup.components(scratch, edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 41)) and all(roots[i * 2 + 101] == 100 for i in range(20))


def test_chunks_are_a_partition_and_resist_insertions():
    import numpy as np

    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(4000)).encode()
    cut = lambda t: substring_dedup.cut_ends(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    ends = cut(text)
    assert ends[-1] == len(text) and (np.diff(ends) > 0).all()
    pieces = lambda t: {t[a:b] for a, b in zip([0, *cut(t)], cut(t), strict=False)}
    moved = text[:5000] + b"an insertion " + text[5000:]
    assert len(pieces(text) - pieces(moved)) <= 4


def test_op1_finds_repeated_passages(spark, documents):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9)))
    passage = " ".join(word() for _ in range(60))
    line = " ".join(word() for _ in range(6))
    texts = []
    for i in range(40):
        w = [word() for _ in range(300)]
        if i % 4 == 1:
            w[rnd.randrange(250) :][:0] = [passage]
            w.insert(rnd.randrange(250), passage)
        texts.append(line + "\n" + " ".join(w))
    texts += [None, "", passage]
    spans = substring_dedup.repeated_spans(Scratch(spark, "t"), documents(texts)).collect()
    assert {r.doc_id for r in spans} | {f for r in spans for f in r.first_doc_ids} == {i for i in range(40) if i % 4 == 1} | {42}
    for r in spans:
        assert texts[r.doc_id][r.start : r.end] in passage and r.first_doc_ids == [1]


def spans_brute(texts):
    """Spans by definition, one text at a time in the order of ids: chunks that occurred before go, runs of them of MIN_WORDS words or more are reported."""
    import numpy as np

    cut = {}
    first = {}
    for i in sorted(texts):
        raw = texts[i].encode()
        ends = substring_dedup.cut_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist() if raw else []
        cut[i] = [(a, b, raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for _, _, c in cut[i]:
            first.setdefault(c, i)
    out = set()
    for i, chunks in cut.items():
        raw, seen, run = texts[i].encode(), set(), []
        for a, b, c in [*chunks, (None, None, None)]:
            gone = c is not None and (first[c] != i or c in seen)
            seen.add(c)
            if gone:
                run.append((a, b))
                continue
            if run:
                a, b = run[0][0], run[-1][1]
                words = sum(a <= m.start() < b for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw))
                if words >= substring_dedup.MIN_WORDS:
                    out.add((i, len(raw[:a].decode(errors="ignore")), len(raw[:b].decode(errors="ignore")), words))
            run = []
    return out


def test_op1_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_substring_dedup"](spark, sf).collect()
    got = {(r.doc_id, r.start, r.end, r.n_words) for r in rows}
    want = spans_brute(texts)
    # a cut inside a character can move an end by a code point
    near = lambda x, those: any(x[0] == y[0] and abs(x[1] - y[1]) <= 1 and abs(x[2] - y[2]) <= 1 and x[3] == y[3] for y in those)
    assert len(got) == len(rows) == len(want) > 0 and all(near(x, want) for x in got)


def test_op1_tells_rows_of_one_id_apart(spark, documents, scratch):
    rnd = random.Random(1)
    passage = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(6)) for _ in range(60))
    other = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(6)) for _ in range(60))
    rows = [(None, passage), (None, passage), (None, other), (4, other), (4, passage + " " + other)]
    out = substring_dedup.repeated_spans(scratch, documents(rows)).collect()
    assert sum(r.n_words for r in out) >= 3 * 45 and all(r.end <= len(passage) + len(other) + 1 for r in out)


def test_op1_chunks_cover_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lengths = {r.doc_id: len(r.text or "") for r in docs.collect()}
    seen = {}
    for r in substring_dedup.chunks(docs).orderBy("doc_id", "start").collect():
        assert r.start == seen.get(r.doc_id, 0)
        seen[r.doc_id] = r.end
    assert seen == {i: n for i, n in lengths.items() if n}


def test_no_two_members_are_equally_famous(spark):
    """Even where counts and hash bits are equal: nodes 2^20 and more apart in number, many of them with equal bits."""
    members = spark.range(3_000_000).select((F.col("id") * 7919).alias("node"), F.lit(8).cast("long").alias("n"))
    out = near_dedup.fame(members)
    r = out.agg(F.count("*").alias("n"), F.countDistinct("fame").alias("d"), F.count("fame").alias("some"), F.countDistinct(F.pmod(F.xxhash64("node"), F.lit(1 << 20))).alias("bits")).first()
    assert r.n == r.d == r.some == 3_000_000 > r.bits
    huge = spark.createDataFrame([(2**62 + 1, 2**42), (2**62, 2**42), (5, 2**41)], "node long, n long")
    assert near_dedup.fame(huge).orderBy("fame").first().node == 5
