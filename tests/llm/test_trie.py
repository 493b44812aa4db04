"""The prefix trie against brute force, by value."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from lorewell.llm import prefix_trie
from lorewell.llm.registry import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def words(text):
    return len([w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w])


def brute_turns(rows):
    """conv: its rebuilt turns (digest, words)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role, text), words(text)))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return out


def brute(convs):
    """Rows of the query from {conv: turns}."""
    at = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            at[tuple(ts[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in at:
        if p:
            kids[p[:-1]] += 1
    for p, m in at.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * p[-1][1] if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(at[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(at[p[:-1]]) if p else -(10**9), len(m), kids.get(p, 0), leaves[p], saved[p], ends(p), p[-1][0] if p else "") for p, m in at.items()
    )


def found(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_sha256")
    return sorted(tuple({None: "" if c == "turn_sha256" else -(10**9)}.get(v := getattr(r, c), v) for c in columns) for r in df.collect())


def query(spark, tables, rows, schema=SCHEMA):
    return QUERIES["op11_prefix_trie"](spark, tables(conversations=spark.createDataFrame(rows, schema)))


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_prefix_trie"](spark, sf)) == brute(brute_turns(rows))


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabet(spark, tables, seed):
    """Few distinct turns: deep sharing, ends inside, gaps in ids, missing heads of families."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a b", "a b", "c", "", None])) for c in rng.sample(range(200), 90) for t in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    assert found(query(spark, tables, rows)) == brute(brute_turns(rows))


def test_nulls_ties_and_repeats(spark, tables):
    rows = [(1, None, "user", "first"), (1, 0, "user", "x"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "no"), (20, 0, None, None), (21, 3, "user", "only"), (22, 1, "", ""), (60, 0, "user", "\t\n")]
    wide = [(*r, "clash", "clash", "clash") for r in rows]
    assert found(query(spark, tables, wide, SCHEMA + ", conv string, class string, `a.b c` string")) == brute(brute_turns(rows))


def test_turnless_members_end_at_the_root(spark, tables):
    rows = [(c, 0, "user", "short") for c in range(41, 60)]  # 40 is absent: those whose head is 1 or more lose their only turn
    turns = brute_turns(rows)
    assert any(not t for t in turns.values()) and found(query(spark, tables, rows)) == brute(turns)


def test_one_conversation_and_none(spark, tables, tmp_path):
    rows = [(40, t, "user", f"t{t}") for t in range(6)]
    assert found(query(spark, tables, rows)) == brute(brute_turns(rows))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert QUERIES["op11_prefix_trie"](spark, str(tmp_path / "none")).collect() == []


def test_long_common_beginnings(spark, scratch):
    """Strides of several turns split at every turn: branches and ends at each depth of a conversation of 300 turns."""
    convs = {}
    for c in range(0, 60):
        cut = (c * 37) % 290
        convs[c] = [(digest("user", f"t{d}"), d % 3) for d in range(cut)] + [(digest("user", f"own{c}-{d}"), 1) for d in range(c % 4)]
    convs[100] = convs[101] = [(digest("user", f"t{d}"), d % 3) for d in range(300)]
    turns = spark.createDataFrame([(c, d + 1, bytes.fromhex(k), w) for c, ts in convs.items() for d, (k, w) in enumerate(ts)], "conv long, depth long, turn binary, words long")
    lengths = spark.createDataFrame([(c, len(ts)) for c, ts in convs.items()], "conv long, length long")
    assert found(prefix_trie.trie(scratch, lengths, turns)) == brute(convs)


def test_many_ends_in_one_class(spark, scratch, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_BITS", 3)
    convs = {c: [(digest("u", "same"), 2)] for c in range(-40, 400)}
    turns = spark.createDataFrame([(c, 1, bytes.fromhex(ts[0][0]), 2) for c, ts in convs.items()], "conv long, depth long, turn binary, words long")
    lengths = spark.createDataFrame([(c, 1) for c in convs], "conv long, length long")
    assert found(prefix_trie.trie(scratch, lengths, turns)) == brute(convs)


def test_rounds_cover_each_depth_once(spark):
    rounds = [r.k for r in spark.range(1, 1000).orderBy("id").select(prefix_trie._round_of("id").alias("k")).collect()]
    for k in set(rounds):
        assert prefix_trie._last_of(k - 1) == rounds.index(k) and prefix_trie._last_of(k) - prefix_trie._last_of(k - 1) <= prefix_trie.STRIDE
    assert rounds == sorted(rounds)


def test_store_holds_each_turn_once(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, None, None)], SCHEMA)
    assert sorted((r.turn_sha256, r.role, r.text) for r in prefix_trie.turn_store(df).collect()) == sorted([(digest("user", "a"), "user", "a"), (digest("", ""), "", "")])
