import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lorewell.llm import decontamination, licences, pii, quality, toxicity
from lorewell.llm.registry import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(s):
    d = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(s)]
    out += [("ip", *m.span()) for m in IP.finditer(s) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(s) if 13 <= len(d(m)) <= 19 and pii.luhn(d(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(s) if 9 <= len(d(m)) <= 15]
    return out


def test_op6_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op6_pii"](spark, sf).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        count = Counter(k for k, _, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in pii.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",") if r.spans else [])


def test_detectors_equal_the_patterns():
    rnd = random.Random(3)
    for _ in range(20000):
        s = "".join(rnd.choice("a1@.+- ()0Z25é%") for _ in range(rnd.randrange(30)))
        assert pii.listed(pii.detect(s)) == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(s))


def test_long_runs_of_zeros_are_no_error():
    s = "0" * 5000 + ".0.0.1 and " + "9" * 5000 + ".0.0.1"
    assert [s[a:b] for a, b in pii.find(s)[0]["ip"]] == ["0" * 5000 + ".0.0.1"]


def test_detectors_are_linear():
    for s in ("a at b dot " * 30_000, "one " * 100_000, "x " * 150_000 + "@", "double " * 100_000, "( at " * 80_000, " dot" * 100_000, "plus one " * 50_000, " @ " * 100_000, "a@b . " * 50_000,"1" * 300_000, "a" * 300_000 + "@", "@" * 300_000, "1." * 150_000, "+1 " * 100_000):
        pii.find(s)


def test_disguises_map_back():
    cases = {
        "mail joe (at) example (dot) com now": ("email", "joe (at) example (dot) com"), "joe at example dot com": ("email", "joe at example dot com"), "xjоhn@exаmple.com": ("email", "xjоhn@exаmple.com"),
        "ring plus one two zero two five five five one two three four": ("phone", "plus one two zero two five five five one two three four"), "é +１２０２５５５０１２３ x": ("phone", "+１２０２５５５０１２３"),
        "four one one one one one one one one one one one one one one one": ("card", "four one one one one one one one one one one one one one one one"), "at １０.0.0.1 now": ("ip", "１０.0.0.1"),
    }
    for s, (kind, want) in cases.items():
        _, every = pii.find(s)
        assert want in [s[a:b] for a, b in every[kind]], s
    assert pii.find("look at the dot on it. one two")[1] == {k: [] for k in pii.KINDS}


def test_planted_disguises_are_found_and_nothing_else(spark, sf):
    """Disguised identifiers planted in real texts: recall, exact spans, and no further span in texts that carry none."""
    rnd = random.Random(21)
    names = dict(enumerate("zero one two three four five six seven eight nine".split()))
    spell = lambda d: " ".join(names[int(c)] for c in d)
    digits = lambda n: "".join(str(rnd.randrange(1, 10)) for _ in range(n))
    card = "4111111111111111"
    make = [
        lambda: ("email", f"joe{digits(2)} (at) example (dot) com"), lambda: ("email", f"joe{digits(2)} at example dot org"), lambda: ("email", f"jo.{digits(2)} [at] mail [dot] example [dot] net"), lambda: ("email", f"jоe{digits(2)}@exаmple.com"),
        lambda: ("email", "b o b @ example . com"), lambda: ("email", f"ann{digits(1)} @ example dot de"), lambda: ("phone", "plus " + spell(digits(11))), lambda: ("phone", spell(digits(11))), lambda: ("phone", "plus 44 20 7946 0958"),
        lambda: ("phone", "plus four four double two oh seven nine four six oh nine"), lambda: ("card", spell(card)), lambda: ("card", "４" + card[1:]), lambda: ("ip", f"１０.{rnd.randrange(9)}.0.1"), lambda: ("ip", "10 (dot) 0 (dot) 7 (dot) 1"),
    ]
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = wanted = extra = 0
    for t in texts:
        own = pii.find(t)
        extra += sum(len(own[1][k]) - len(own[0][k]) for k in pii.KINDS)
        if "@" in t or any(c.isdigit() for c in t):
            continue
        kind, what = rnd.choice(make)()
        words = t.split(" ")
        at = rnd.randrange(len(words) + 1)
        s = " ".join([*words[:at], "; " + what + " ;", *words[at:]])
        wanted += 1
        found += what in [s[a:b] for a, b in pii.find(s)[1][kind]]
    assert extra == 0 and wanted > 50 and found >= 0.98 * wanted, (found, wanted, extra)


def test_plus_alone_is_a_disguise():
    for s in ("call plus 44 20 7946 0958", "call Plus  44 20 7946 0958 now"):
        assert [s[a:b].lower().split()[0] for a, b in pii.find(s)[1]["phone"]] == ["plus"], s


def test_bare_dots_before_other_ends():
    for end in "ie nz za tv me online xyz com".split():
        s = f"write alice at example dot {end} now"
        assert [s[a:b] for a, b in pii.find(s)[1]["email"]] == [f"alice at example dot {end}"], s


def test_hint_is_no_narrower_than_the_disguises():
    rnd = random.Random(12)
    pieces = ["plus", "Plus", "dot", "at", "@", ".", "(", ")", "[", "]", "<", "{", " ", " ", "  ", "4", "one", "two", "oh", "joe", "com", "ie", ",", "-", "x", "é"]
    seen = 0
    for _ in range(100_000):
        s = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 14)))
        if pii._DISGUISE.search(s):
            seen += 1
            assert pii._HINT.search(s), s
    assert seen > 1000


def test_op2_against_brute_force(spark, documents, sf):
    rnd = random.Random(4)
    pool = "under the mit license apache version 2 0 cc by nc licensed released x é gnu general".split()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(60))) for _ in range(300)] + [None, "Under-The MIT.License", "under the\0mit license"]
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for r in licences.scan(documents(list(enumerate(texts)))).collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (texts[r.doc_id] or "").translate(low))
        places = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")}
        assert 0 <= r.score <= 1


def test_automaton_gives_matching_statistics():
    rnd = random.Random(1)
    seqs = [[rnd.randrange(4) for _ in range(rnd.randrange(1, 25))] for _ in range(6)]
    a = licences.Automaton(seqs)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(50):
        t = [rnd.randrange(5) for _ in range(40)]
        state = length = 0
        for i, c in enumerate(t):
            state, length = a.step(state, length, c)
            assert length == max((n for n in range(i + 2) if n == 0 or tuple(t[i + 1 - n : i + 1]) in subs))
            ends = {(k, e) for k, s in enumerate(seqs) for e in range(length, len(s) + 1) if length and s[e - length : e] == t[i + 1 - length : i + 1]}
            assert not length or a.ends[state] == ends


def test_chains_against_brute_force():
    """The best chain of few matches, by trying all subsets in order."""
    rnd = random.Random(5)
    for _ in range(400):
        found = []
        for _ in range(rnd.randrange(1, 7)):
            n, a, p = rnd.randrange(3, 8), rnd.randrange(90), rnd.randrange(30)
            found.append((a, a + n, p, p + n))
        found = sorted(set(found), key=lambda m: (m[1], m[3]))
        key = (rnd.randrange(30), 0)
        key = (key[0], key[0] + 2)
        best = told = 0
        for mask in range(1, 1 << len(found)):
            chain = [m for k, m in enumerate(found) if mask >> k & 1]
            words = chain[0][1] - chain[0][0]
            for (_, e, _, r), (a, b, p, q) in zip(chain, chain[1:], strict=False):
                new = q - p - max(0, e - a, r - p)
                words = words + new if new > 0 and r < q and e < b and e >= a - licences.GAP else -(10**6)
            best = max(best, words)
            if any(p <= key[0] and q >= key[1] for _, _, p, q in chain):
                told = max(told, words)
        assert licences.chained(found, key) == (best, told)


def test_licences_are_told_from_their_relatives(documents):
    notice = {label: text for label, _, text in licences.TEMPLATES}
    near = {
        "a notice of the gpl is not this one of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "",
        notice["agpl"]: "agpl", notice["lgpl"]: "lgpl", notice["epl-1"]: "epl-1", notice["mpl-1.1"]: "mpl-1.1", notice["isc"]: "isc", notice["cc0"]: "cc0", notice["unlicense"]: "unlicense", notice["bsd"]: "bsd",
        notice["bsd"] + " " + notice["bsd-3"]: "bsd-3", "some text " * 20 + notice["gpl"].replace("modify it", "alter it"): "gpl",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa",
        "this program is free software you can redistribute it and or modify it under the terms of the some other license": "",
    }
    rows = licences.scan(documents(list(enumerate(near)))).collect()
    assert [r.labels for r in sorted(rows, key=lambda r: r.doc_id)] == list(near.values())


def test_edited_licence_is_labelled(documents):
    apache = licences.TEMPLATES[5][2].split()
    apache[10:11] = ["really", "odd"]
    rows = licences.scan(documents([" ".join(apache), "nothing of the kind is under here"])).collect()
    assert "apache-2" in rows[0].labels and rows[1].labels == ""


def align_brute(item, window):
    best = 0
    h = np.zeros((len(item) + 1, len(window) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(window) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == window[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best / (2 * len(item))


def test_alignment_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(-1, 6, rng.integers(0, 30))
        assert abs(decontamination.align(a.astype(np.int32), b.astype(np.int32))[0] - align_brute(a, b)) < 1e-12


def test_op4_finds_copies_edited_or_not(spark, documents, scratch):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(90, None), (91, "of the")]
    texts = []
    for i in range(200):
        w = [word() for _ in range(150)]
        if i % 2:
            copy = items[3 if i % 3 else i % 20][1].split()
            for _ in range(i % 5):
                copy[rnd.randrange(len(copy))] = word()
            w[60:60] = [x.upper() + "," for x in copy]
        texts.append(" ".join(w))
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(scratch, documents([*texts, None]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, 3 if i % 3 else i % 20) for i in range(200) if i % 2}
    assert set(found) == want
    assert all(found[i, k] == 1 for i, k in want if i % 5 == 0)


def test_op4_finds_families_of_one_edited_copy_beside_a_verbatim_one(spark, documents, scratch):
    """One document with the whole item makes the seeds over the edited place look rare, and those of all the copies common."""
    item = [f"w{i}" for i in range(30)]
    edited = [*item[:14], "other", *item[15:]]
    texts = [" ".join([f"own{i}", *(edited if i else item), f"tail{i}"]) for i in range(121)]
    found = {r.doc_id: (r.score, r.n_seeds) for r in decontamination.contaminated(scratch, documents(texts), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()}
    assert set(found) == set(range(121)) and found[0] == (1, 27)
    assert all(found[i] == ((29 * 2 - 1) / 60, 23) for i in range(1, 121))


def test_bound_is_no_less_than_the_score():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = rng.integers(0, 6, rng.integers(1, 20)).astype(np.int32), rng.integers(-1, 6, rng.integers(0, 30)).astype(np.int32)
        assert decontamination.bound(a, b) >= decontamination.align(a, b)[0]


def test_op4_on_the_tables(spark, sf):
    words = lambda t: " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower()))
    docs = {r.doc_id: f" {words(r.text)} " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: f" {words(r.text)} " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op4_benchmark_decontamination"](spark, sf).collect()}
    assert {(i, k) for i, t in docs.items() for k, u in items.items() if u.strip() and u in t} <= found


def test_op4_finds_edited_copies(spark, documents, scratch):
    """Recall of copies by how many of their words are edited, against Smith-Waterman over the whole texts of all pairs."""
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9)))
    items = [[word() for _ in range(rnd.randrange(20, 60))] for _ in range(12)]
    texts = []
    for i in range(120):
        w = [word() for _ in range(60)]
        copy = list(items[i % 12])
        for _ in range(int(len(copy) * (i // 12) * 0.025)):  # up to a fifth of the words
            k, what = rnd.randrange(len(copy)), rnd.randrange(3)
            copy[k : k + 1] = [[word()], [], [copy[k], word()]][what]
        w[30:30] = copy
        texts.append(w)
    ids = {}
    code = lambda ws: np.array([ids.setdefault(x, len(ids)) for x in ws], np.int32)
    want = {(d, k) for d, t in enumerate(texts) for k, x in enumerate(items) if decontamination.align(code(x), code(t))[0] >= decontamination.MIN_SCORE}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    docs = documents([" ".join(t) for t in texts])
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(scratch, docs, bench).collect()}
    assert found <= want and len(found) >= 0.95 * len(want) and len(want) >= 100
    left = {r.doc_id for r in decontamination.uncontaminated(docs, bench).collect()}
    assert left == set(range(120)) - {d for d, _ in found}


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    n = 20000
    good = rng.random(n) < 0.8
    votes = np.zeros((n, 6), int)
    for k, (bad_rate, false_rate) in enumerate([(0.7, 0.01), (0.5, 0.02), (0.6, 0.01), (0.4, 0.03), (0.5, 0.01), (0.3, 0.02)]):
        votes[:, k] = np.where(rng.random(n) < np.where(good, false_rate, bad_rate), quality.BAD, quality.NONE)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, chance, prior = quality.em(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.05 and ((post[where.ravel()] >= 0.5) == good).mean() > 0.95
    assert abs(chance[0, 0, quality.BAD] - 0.7) < 0.07


def test_quality_rejects_junk_and_keeps_prose(spark, documents, scratch):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.choice([2, 3, 4, 6, 8])))
    prose = lambda: ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(8)) + "."
    junk = [lambda: " ".join(word() + rnd.choice(["###", "$$$", "%%%"]) for _ in range(60)), lambda: " ".join(word().upper() + "!!" for _ in range(60)), lambda: " | ".join(word() for _ in range(60)), lambda: " ".join([word()] * 80)]
    texts = [junk[i % 4]() if i % 5 == 0 else prose() for i in range(800)]
    out = {r.doc_id: r.score >= quality.REJECT for r in quality.scored(scratch, documents(texts), ["doc_id"]).collect()}
    clean = [out[i] for i in range(800) if i % 5]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(out[i] for i in range(800) if i % 5 == 0) <= 16


def test_quality_against_the_labels(spark, scratch):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    out = [(r.score >= quality.REJECT, known[r.doc_id]) for r in quality.scored(scratch, docs, ["doc_id"]).collect() if known.get(r.doc_id) is not None]
    bad, good = [k for k, q in out if q == 0], [k for k, q in out if q == 1]
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.95 * len(good)


def test_quality_finds_junk_however_rare(spark, documents, scratch):
    """Three bad rows among thousands are in the sample all the same; the sample's bound holds."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.choice([2, 3, 4, 6, 8])))
    texts = [". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(3)) + "." for _ in range(4000)]
    for i in (5, 1777, 3990):
        texts[i] = " ".join(word() + "###" for _ in range(60))
    out = {r.doc_id: r.score >= quality.REJECT for r in quality.scored(scratch, documents(texts), ["doc_id"]).collect()}
    assert [i for i, k in out.items() if not k] == [5, 1777, 3990] or {5, 1777, 3990} <= {i for i, k in out.items() if not k} and sum(not k for k in out.values()) <= 40


def test_both_dictionaries_are_trained_on_their_own_class(monkeypatch):
    import zstandard

    seen = []
    train = zstandard.train_dictionary

    def spy(size, samples, **more):
        seen.append(list(samples))
        return train(size, samples, **more)

    monkeypatch.setattr(zstandard, "train_dictionary", spy)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9)))
    rows = []
    for i in range(600):
        w = [word() for _ in range(80)]
        if i % 3 == 0:
            for _ in range(4):
                w[rnd.randrange(80)] = rnd.choice(["zorgblat", "kwimfex", "pluvnok"])
        rows.append((int(i % 3 == 0), " ".join(w)))
    model = toxicity.fit(rows)
    toxic, ordinary = seen
    assert all(any(s.strip() in t.encode() for t in [x for c, x in rows if c]) for s in toxic[0].split())
    assert all(s.decode() in {x for c, x in rows if not c} for s in ordinary)
    assert any(w in model.toxic for w in (b"zorgblat", b"kwimfex", b"pluvnok")) and not any(w in model.ordinary for w in (b"zorgblat", b"kwimfex", b"pluvnok"))


def test_toxicity_held_out(spark, documents):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9)))
    bad = ["zorgblat", "kwimfex", "pluvnok"]
    texts, labels = [], []
    for i in range(1200):
        w = [word() for _ in range(80)]
        if i % 6 == 0:
            for _ in range(4):
                w[rnd.randrange(80)] = rnd.choice(bad)
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 6 == 0)))
    rows = toxicity.score(documents([*texts, None, ""]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 1200]
    assert 200 < len(held) < 400
    assert sum((r.score >= 0.3) == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    ends = {r.doc_id: r.score for r in rows if r.doc_id >= 1200}
    assert 0 <= ends[1200] == ends[1201] < 0.3


def test_windows_cover_the_text():
    rnd = random.Random(1)
    for _ in range(200):
        s = toxicity.plain(" ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(1, rnd.choice([4, 9, 120])))) for _ in range(rnd.randrange(40))))
        at = 0
        for w in toxicity.windows(s):
            p = s.find(w, max(0, at - toxicity.WINDOW))
            assert 0 <= p <= at
            at = max(at, p + len(w))
        assert at == len(s)


def test_labels_are_learnt_from_the_right_rows(spark, documents):
    import zlib

    docs = documents([f"text {i}" for i in range(300)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels)
    assert sorted(s for _, s in rows) == sorted(f"text {i}" for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert len(toxicity.training_rows(docs, labels, 10)) == 20


def test_word_kernel_against_split():
    from lorewell.llm.kernels import SPACED, Words, texts

    rnd = random.Random(2)
    rows = ["".join(rnd.choice("ab \n\tÉ\xa0Z\x0b") for _ in range(rnd.randrange(40))) for _ in range(500)] + [None, ""]
    buf, offs = texts(pa.array(rows))
    w = Words(buf, offs, SPACED)
    seen = {}
    for d, t in enumerate(rows):
        own = re.findall("[^\x20\x09-\x0d]+", t or "")
        got = [bytes(buf[a:b]).decode() for a, b in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]], strict=True)]
        assert got == own
        for h, x in zip(w.hash[w.first[d] : w.first[d + 1]].tolist(), own, strict=True):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
            assert seen.setdefault(h, low) == low
    assert len(set(seen.values())) == len(seen)
