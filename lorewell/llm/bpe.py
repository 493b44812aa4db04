"""BPE encoding and decoding with a public vocabulary: speculate and verify.

Greedy longest match proposes the tokens of each distinct word. A proposal is what merging gives exactly when each of its
tokens is what its own letters merge to and every two neighbours are compatible, that is, no merge crosses their border
while both sides still stand there. One vectorised walk back through the merges tests the neighbours of all new words of a
batch; only words that fail it are merged exactly. Each worker keeps what it has encoded, up to ``KEPT`` words.

White space is dropped by such vocabularies, so texts are worked off in pieces that end at white space, whatever their length.

Defined results: a null text is an empty text, which has no tokens and decodes to an empty text; ids may be null or
repeated, each row is encoded by itself; an empty table gives no rows; other columns of the input are not read. The strings
of special tokens in a text are special tokens, as in the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.shared import narrow_batches, null_to_empty, table

#: A worker forgets its words beyond this many; words over LONG code points are not kept. Neither changes a result.
KEPT, LONG = 800_000, 64
#: Code points that are encoded at a time; a piece ends at the next white space.
PIECE = 1 << 20
_NEVER = 1 << 40
_NONE = (_NEVER,)
_END = "</w>"

# What the normaliser and the splitting pattern of the vocabulary file say when plain() may stand in for them.
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points whose classes and small letters are the same in every version of Unicode since 6, and that compose with nothing.
_PLAIN = [(0x0000, 0x017F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20B9)]


def _class(kinds: str) -> str:
    """Code points of _PLAIN in the general categories ``kinds``, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for a, b in _PLAIN for c in range(a, b + 1) if unicodedata.category(chr(c))[0] in kinds)


_SPACE = "\t\n\v\f\r \x85\xa0"
_IS_PLAIN = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _PLAIN) + "]*")
#: As _PATTERN; an apostrophe is no letter, so letters may be tried first.
_WORD = re.compile(f"[{_class('L')}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_class('N')}]|[^{_SPACE}{_class('LN')}]+")
_BREAK = re.compile("[ \t\n\r]")


def plain(text: str) -> list[str]:
    """Words of a text of _PLAIN code points: letters without context are made small, white space only separates."""
    return _WORD.findall(text.replace("Σ", "σ").lower())


def _byte_letters() -> dict[int, int]:
    """Byte to the letter that stands for it: itself where it prints, else the next free letter from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(others)}


class Vocabulary:
    """A vocabulary file's merges, and the words encoded so far."""

    def __init__(self, file: str):
        from tokenizers import Regex, pre_tokenizers
        from tokenizers import Tokenizer

        spec = json.loads(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("post_processor", "decoder") if spec.get(k)] + [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd or model["type"] != "BPE" or model["end_of_word_suffix"] != _END or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"not a vocabulary of words with ends: {odd}")
        self.plain = spec["normalizer"] == {"type": "Sequence", "normalizers": _NORMALISER} and split["pattern"] == {"Regex": _PATTERN}
        self.normaliser, self.splitter = Tokenizer.from_str(file).normalizer, pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

        ids = model["vocab"]
        top = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * top
        for t, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.inner = {t: i for t, i in ids.items() if not t.endswith(_END)}
        self.final = {t.removesuffix(_END): i for t, i in ids.items() if t.endswith(_END)}
        self.longest, self.furthest = max(map(len, self.inner)), max(map(len, self.final))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        #: By token: place of the merge that makes it (-1: a letter), and what it is made of.
        self.rank, self.left, self.right = np.full(top, -1, np.int64), np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        if len(set(made.tolist())) < len(made) or (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(made))).any():
            raise ValueError("merges out of order")
        code = left << 32 | right
        self.order = np.argsort(code)
        self.code = code[self.order]
        self.merges = {c: (k,) for k, c in enumerate(code.tolist())}
        self.made = made.tolist()
        whole = np.ones(top, bool)
        whole[made] = self.compatible(left, right, np.arange(len(made)))
        for a, b, m in zip(left.tolist(), right.tolist(), made.tolist(), strict=True):
            whole[m] &= whole[a] and whole[b]
        #: Tokens that their own letters merge to.
        self.whole = whole
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
        return np.where(self.code[at] == want, self.order[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of rank under ``before`` crosses the border of each pair, when both sides are merged in order.

        Time runs backwards: of the two pieces at the border the one made last is taken apart (of equal ones the right,
        for merges go from left to right), which bounds the time at which the pieces now there could still meet.
        """
        ok = np.ones(len(a), bool)
        at, p, q = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        end = np.full(len(a), _NEVER - 1) if before is None else before.astype(np.int64)
        while len(at):
            crossed = self._merge_of(p, q) < end
            ok[at[crossed]] = False
            rp, rq = self.rank[p], self.rank[q]
            go = ~crossed & ((rp >= 0) | (rq >= 0))
            at, p, q, rp, rq = at[go], p[go], q[go], rp[go], rq[go]
            apart = rp > rq
            end = np.where(apart, rp, rq + 1)
            p, q = np.where(apart, self.right[p], p), np.where(apart, q, self.left[q])
        return ok

    def proposal(self, word: str) -> list[int]:
        """Greedy longest match over the word's letters."""
        inner, final, longest = self.inner.get, self.final.get, self.longest
        out, i, n = [], 0, len(word)
        while i < n:
            if n - i <= self.furthest and (last := final(word[i:])) is not None:
                out.append(last)
                break
            for j in range(min(i + longest, n - 1), i, -1):
                if (t := inner(word[i:j])) is not None:
                    break
            out.append(t)
            i = j
        return out

    def merged(self, word: str) -> list[int]:
        """Exact merging: the merge of least rank first, of equal ones the leftmost."""
        ids = [self.inner[c] for c in word[:-1]]
        ids.append(self.final[word[-1]])
        return self._few(ids) if len(ids) <= LONG else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        """Scans all ranks for each merge: the shortest way for ordinary words."""
        of = self.merges.get
        ranks = [of(a << 32 | b, _NONE)[0] for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < _NEVER:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = of(ids[i - 1] << 32 | ids[i], _NONE)[0]
            if i < len(ranks):
                ranks[i] = of(ids[i] << 32 | ids[i + 1], _NONE)[0]
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        of, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := of(ids[i] << 32 | ids[i + 1]))]
        heapify(todo)
        while todo:
            rank, i, a, b = heappop(todo)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := of(ids[x] << 32 | ids[y])):
                    heappush(todo, (m[0], x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian, 32 bits) of each word."""
        spelled = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for w in words]
        found = [self.proposal(s) for s in spelled]
        size = np.array([len(f) for f in found])
        ids = np.array([t for f in found for t in f], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        wrong = np.zeros(len(words), bool)
        wrong[word[~self.whole[ids]]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(ids[inside] << 32 | ids[inside + 1], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        wrong[word[inside[~fits[which]]]] = True
        for i in np.flatnonzero(wrong).tolist():
            found[i] = self.merged(spelled[i])
        return {w: np.array(f, "<u4").tobytes() for w, f in zip(words, found, strict=True)}

    def words(self, text: str) -> list[str]:
        if self.plain and _IS_PLAIN.fullmatch(text):
            return plain(text)
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(text))]

    def encode(self, text: str) -> bytes:
        """Ids of a text, little-endian, 32 bits each."""
        out = []
        for piece in pieces(text):
            for part in self.cut.split(piece) if self.cut and self.cut.search(piece) else (piece,):
                if part in self.special:
                    out.append(self.special[part].to_bytes(4, "little"))
                    continue
                words = self.words(part)
                out.extend(map(self._known(words).__getitem__, words))
        return b"".join(out)

    def _known(self, words: list[str]) -> dict[str, bytes]:
        """A table that holds the ids of all ``words``; new ones are learnt, those of the older half are taken over."""
        known, older = self.known, self.older
        missing = [w for w in dict.fromkeys(words) if w not in known]
        new = [w for w in missing if w not in older]
        more = {w: older[w] for w in missing if w in older} | (self.learn(new) if new else {})
        if len(known) + len(more) > KEPT // 2:
            self.older, self.known = known, {}
        self.known |= {w: x for w, x in more.items() if len(w) <= LONG}
        if self.known is known and all(len(w) <= LONG for w in new):
            return known
        return known | more

    def decode(self, ids: bytes) -> str:
        """The tokens, special ones too, with spaces between them: what the vocabulary file says without a decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Pieces of about ``size`` code points that end at white space."""
    a = 0
    while a < len(text):
        m = _BREAK.search(text, a + size)
        b = m.end() if m else len(text)
        yield text[a:b]
        a = b


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(file) -> Vocabulary:
    """The worker's own, read once from the broadcast file."""
    if file.value[0] not in _loaded:
        _loaded[file.value[0]] = Vocabulary(file.value[1])
    return _loaded[file.value[0]]


class Coder:
    """Encodes and decodes DataFrames with the vocabulary at ``path``; its file (bounded: one vocabulary) goes to all workers."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        narrow_batches(spark)
        self.file = spark.sparkContext.broadcast((hash(text), text))

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, ids): the ids of each row's whole text, packed little-endian with 32 bits each; ``unpacked`` makes an array of them."""
        file = self.file

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = _vocabulary(file)
            for b in batches:
                for i, t in zip(b.column(0), b.column(1), strict=True):  # one row at a time: ids of a long text are of its size
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], b.schema.field(0).type), pa.array([v.encode(t.as_py())], pa.large_binary())], names=["doc_id", "ids"])

        rows = docs.select(F.col(id_col).alias("doc_id"), null_to_empty(text_col).alias("text"))
        return rows.mapInArrow(_gathered(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """(doc_id, ids) and the text that the ids stand for."""
        file = self.file

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = _vocabulary(file)
            for b in batches:
                for i, x in zip(b.column(0), b.column(1), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], b.schema.field(0).type), pa.array([x.as_py()], pa.large_binary()), pa.array([v.decode(x.as_py())], pa.large_string())], names=["doc_id", "ids", "text"])

        rows = encoded.select("doc_id", "ids")
        return rows.mapInArrow(_gathered(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def _gathered(run):
    """Batches of single rows put together to about 4 MB."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > 4 << 20 or len(held) >= 512:
                yield _one(held)
                held, size = [], 0
        if held:
            yield _one(held)

    return out


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    small = {pa.large_binary(): pa.binary(), pa.large_string(): pa.string()}
    columns = [pa.concat_arrays([b.column(k) for b in held]) for k in range(held[0].num_columns)]
    return pa.RecordBatch.from_arrays([c.cast(small.get(c.type, c.type)) for c in columns], names=held[0].schema.names)


def unpacked(ids: str = "ids") -> Column:
    """An array of ids (long) from their packed form."""
    four = f"substring({ids}, 4 * i - 3, 4)"
    return F.when(F.length(ids) == 0, F.array().cast("array<bigint>")).otherwise(
        F.expr(f"transform(sequence(1, length({ids}) div 4), i -> cast(conv(hex(concat({', '.join(f'substring({four}, {k}, 1)' for k in (4, 3, 2, 1))})), 16, 10) AS bigint))")
    )


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coder = Coder(spark, public_tokenizers.path("word_bpe_49k.json"))
    out = coder.decode(coder.encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES = {"op13_bpe": op13_bpe}
ORACLES: dict[str, str] = {}
