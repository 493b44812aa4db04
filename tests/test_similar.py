import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_operators import corpus, note

from lorewell.functions import text
from lorewell.operators import dedup, similar, words

DICE = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def families(rnd, n):
    base = [{f"term{rnd.randrange(3000)}" for _ in range(rnd.randrange(1, 90))} for _ in range(6)]
    out = {}
    for i in range(n):
        own = set(base[i % 6])
        for _ in range(rnd.randrange(5)):
            own ^= {rnd.choice([f"term{rnd.randrange(3000)}", *base[i % 6]])}
        out[f"n{i:03}"] = own
    return out


def test_merge_proposals_against_brute_force_without_fetching_sets_pair_by_pair(spark, monkeypatch):
    sets = families(random.Random(7), 150) | {"z0": set(), "z1": set(), "z2": {"one"}, "z3": {"one"}, "z4": {"one", "two"}}
    monkeypatch.setattr(dedup, "_scored", None)
    monkeypatch.setattr(similar, "BLOCK", 8)  # families of several blocks
    c = corpus(spark, [note(i, "", " ".join(sorted(s)), at=k) for k, (i, s) in enumerate(sets.items())])
    got = [(r.keep, r.drop, round(r.score, 9)) for r in dedup.merge_proposals(c.notes).collect()]
    first = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    heads = sorted(set(first.values()))
    want = [(first[i], i, 1.0) for i in sets if first[i] != i] + [(a, b, round(DICE(sets[a], sets[b]), 9)) for a in heads for b in heads if a < b and DICE(sets[a], sets[b]) >= 0.92]
    assert sorted(got) == sorted(want) and len(want) > 300


def test_a_family_gives_links_in_proportion_to_its_members():
    rnd = random.Random(1)
    core = np.array([rnd.getrandbits(62) for _ in range(300)], np.int64)
    sets = [np.unique(np.append(core[rnd.randrange(4) :], rnd.getrandbits(62))) for _ in range(200)]
    ends = np.cumsum([0, *map(len, sets)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["h", "terms"])
    links = similar._links(0.92)(pa.Table.from_batches(list(similar._parts(0.92)([batch]))))
    assert 199 <= links.num_rows < 1000  # of 19,900 pairs
    assert len(set(links["a"].to_pylist()) | set(links["b"].to_pylist())) == 200


def test_tokens_cut_in_python_are_those_of_the_engine(spark):
    rnd = random.Random(3)
    odd = "aZ09_ é Ê ü ß ç İ K ﬁ Å é ́x ñ ж 中 😀 \x00 \t\n .-ªº¼ ǆ Ǆ ﷺ"
    texts = ["".join(rnd.choice(odd) for _ in range(60)) for _ in range(300)] + [chr(k) + "a" + chr(k + 1) for k in range(0x80, 0x3000, 2)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.tokens("t").alias("k")).collect()
    assert {r.i: list(r.k) for r in rows} == {i: [x.decode() for x in words.pieces(t)] for i, t in enumerate(texts)}


def test_notes_with_one_id_are_one_set(spark):
    n = spark.createDataFrame([note("a", "alpha beta"), note("a", "gamma"), note("b", "betas", tags=["x", "y"])], corpus(spark, []).notes.schema)
    sizes = {r.id: r.n for r in words.term_hashes(n, ("statement", "body", "tags")).select("id", F.size("terms").alias("n")).collect()}
    assert sizes == {"a": 3, "b": 3}


def test_a_block_too_large_for_one_matrix_is_split(monkeypatch):
    rnd = random.Random(4)
    core = [rnd.getrandbits(62) for _ in range(60)]
    sets = [np.array(sorted({*core[rnd.randrange(5) :], rnd.getrandbits(62)}), np.int64) for _ in range(40)]
    ends = np.cumsum([0, *map(len, sets)])
    for j, side in ((0, [0] * 40), (1, [0] * 15 + [1] * 25)):
        table = pa.table({"family": [1] * 40, "i": [0] * 40, "j": [j] * 40, "side": side, "id": [f"n{k:02}" for k in range(40)], "terms": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))})
        want = {(f"n{a:02}", f"n{b:02}") for a in range(40) for b in range(a + 1, 40) if side[a] + j == side[b] and DICE(set(sets[a]), set(sets[b])) >= 0.92}
        for cells in (1 << 24, 200):
            monkeypatch.setattr(similar, "CELLS", cells)
            got = similar._compared(0.92)(table)
            assert {tuple(sorted(p)) for p in zip(got["a"].to_pylist(), got["b"].to_pylist())} == want and got.num_rows == len(want) > 20
