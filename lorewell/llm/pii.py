"""Personal data with offset-preserving deobfuscation.

Base detectors (email, ip, card, phone) run on each whole text. Texts that carry a disguise (look-alike
letters, zero-width characters, "(at)" and "dot" words, a name in spaced letters before an at sign, spelled digits,
doubled ones too) also go through a transducer:
it rewrites the disguises and keeps, for every piece of the rewritten text, the source characters it
came from. The same detectors run on the rewritten text and their spans are mapped back; those that
don't overlap a base span of their kind are added. 10 to 15 spelled digits on end that are no card are a phone number without a plus sign.

All detectors are anchored (at an @, at the start of a digit run, at a plus sign), so time is linear
in the text whatever it holds.

Defined results: a null text is an empty text without spans; repeated rows are scanned again; an
empty table gives no rows; other columns are not read. Counts are those of the base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.shared import narrow_batches, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(s: str) -> Iterator[Span]:
    free, at = 0, s.find("@")
    while at >= 0:
        start = at
        while start > free and s[start - 1] in LOCAL:
            start -= 1
        m = _DOMAIN.match(s, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = s.find("@", max(at + 1, free))


def ips(s: str) -> Iterator[Span]:
    for m in _IP.finditer(s):
        parts = [x.lstrip("0") for x in m[0].split(".")]
        if all(len(x) < 4 and int(x or "0") <= 255 for x in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def cards(s: str) -> Iterator[Span]:
    for m in _CARD.finditer(s):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            yield m.span()


def phones(s: str) -> Iterator[Span]:
    for m in _PHONE.finditer(s):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def detect(s: str) -> dict[str, list[Span]]:
    digit = _DIGIT.search(s) is not None
    return {
        "email": list(emails(s)) if "@" in s else [],
        "ip": list(ips(s)) if digit and "." in s else [],
        "card": list(cards(s)) if digit else [],
        "phone": list(phones(s)) if digit and "+" in s else [],
    }


# Characters that look like the ASCII ones they stand for.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ı": "i", "ɡ": "g", "ℓ": "l",
    "ſ": "s", "\u212a": "K", "İ": "I", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "﹢": "+", "﹫": "@",
}
HOMOGLYPHS |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
HOMOGLYPHS |= {chr(base + d): str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
HOMOGLYPHS |= dict.fromkeys("​‌‍⁠﻿­", "")

# Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "]")
# Domain ends that make a bare "dot" a disguise: generic ones in common use and all country codes.
ENDS = "com org net edu gov mil int info biz name pro mobi jobs travel museum aero coop post tel cat asia arpa dev app page xyz online site website web store shop tech cloud space live life world today news blog email mail media agency digital studio design art club group team company solutions services systems network software academy education school university institute foundation health care clinic doctor law legal bank finance money capital fund global international city town house home land london paris berlin tokyo nyc video games game fun wiki link click top vip win icu work works zone host hosting press one".split()
ENDS += "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()

# Words that repeat the digit after them.
TIMES = {"double": 2, "triple": 3}

_END = rf"(?:(?:{'|'.join(ENDS)})\b|[a-z0-9-]+[ ]{{1,2}}dot[ ])"
_GENERIC = "|".join(x for x in ENDS if len(x) > 2)
_DIGIT_WORD = rf"(?:(?:{'|'.join(TIMES)})[ -]{{1,2}})?(?:{'|'.join(DIGITS)})\b"
_SPELLED = rf"\b{_DIGIT_WORD}(?:[ ,.-]{{1,3}}{_DIGIT_WORD})+"
_AT = r"[ ]{0,2}[\[({<][ ]?(?:at|@)[ ]?[\])}>][ ]{0,2}|[ ]{1,2}@[ ]{1,2}|[ ]{1,2}at[ ]{1,2}(?=[a-z0-9-]+(?:[ ]{1,2}dot[ ]{1,2}" + _END + r"|[ ]{0,2}[\[({<][ ]?(?:dot|\.)))"
_DOT = r"[ ]{0,2}[\[({<][ ]?(?:dot|\.)[ ]?[\])}>][ ]{0,2}|(?<=[a-z0-9])[ ]{1,2}dot[ ]{1,2}(?=" + _END + r")|(?<=[a-z0-9])[ ]{1,2}\.[ ]{1,2}(?=(?:" + _GENERIC + r")\b)"
_PLUS = rf"\bplus[ ]{{1,2}}(?=[0-9]|{_DIGIT_WORD})"
#: Letters with one space between them, from the first on, before an at sign.
_LETTERS = r"(?<![a-z0-9])(?<!(?<![a-z0-9])[a-z0-9][ ])(?:[a-z0-9][ ]){2,}[a-z0-9](?=[ ]{0,2}(?:@|[\[({<][ ]?(?:at|@)[ ]?[\])}>]))"
_DISGUISE = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})|(?P<plus>{_PLUS})|(?P<spelled>{_SPELLED})|(?P<letters>{_LETTERS})", re.IGNORECASE)
#: A cheap test that no disguised text fails.
_HINT = re.compile(rf"\b(?:dot)\b|[\[({{<][ ]?(?:dot|\.|(?:at|@)[ ]?[\])}}>])|[ ]@|[ ]\.[ ]{{1,2}}(?:{_GENERIC})\b|(?<![a-z0-9])[a-z0-9]@|{_PLUS}|{_SPELLED}", re.IGNORECASE)


class Rewritten:
    """A text and, for each of its pieces, the source characters it came from."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at: list[int] = []  # where each piece begins in the rewritten text
        self.source: list[tuple[int, int, bool]] = []  # start, end, and whether it is a plain copy
        self.n = 0

    def add(self, text: str, start: int, end: int, copied: bool) -> None:
        if text:
            self.parts.append(text)
            self.at.append(self.n)
            self.source.append((start, end, copied))
            self.n += len(text)

    def text(self) -> str:
        return "".join(self.parts)

    def back(self, start: int, end: int) -> Span:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a, _, plain = self.source[i]
        _, b, plain_end = self.source[j]
        return a + (start - self.at[i]) * plain, self.source[j][0] + end - self.at[j] if plain_end else b


def glyphs(s: str) -> Rewritten:
    out, at = Rewritten(), 0
    for m in _ODD.finditer(s):
        out.add(s[at : m.start()], at, m.start(), True)
        out.add(HOMOGLYPHS[m[0]], m.start(), m.end(), False)
        at = m.end()
    out.add(s[at:], at, len(s), True)
    return out


def words(s: str) -> tuple[Rewritten, list[Span]]:
    """The text without disguises, and the spans in ``s`` of 10 to 15 spelled digits on end."""
    out, at, numbers = Rewritten(), 0, []
    for m in _DISGUISE.finditer(s):
        out.add(s[at : m.start()], at, m.start(), True)
        kind = m.lastgroup
        if kind == "spelled":
            count, since, times = 0, 0, 1
            for d in re.finditer("[a-z]+", m[0], re.IGNORECASE):
                word = d[0].lower()
                if word in TIMES:
                    since, times = d.start(), TIMES[word]
                    continue
                out.add(DIGITS[word] * times, m.start() + (since if times > 1 else d.start()), m.start() + d.end(), False)
                count, times = count + times, 1
            if 10 <= count <= 15:
                numbers.append(m.span())
        elif kind == "letters":
            for k in range(m.start(), m.end(), 2):
                out.add(s[k], k, k + 1, True)
        else:
            out.add({"at": "@", "dot": ".", "plus": "+"}[kind], m.start(), m.end(), False)
        at = m.end()
    out.add(s[at:], at, len(s), True)
    return out, numbers


def apart(spans: list[Span], others: list[Span]) -> list[Span]:
    """Those of ``spans`` that overlap none of the sorted, disjoint ``others``."""
    starts = [a for a, _ in others]
    out = []
    for a, b in spans:
        k = bisect_right(starts, a)
        if not (k and others[k - 1][1] > a) and not (k < len(others) and others[k][0] < b):
            out.append((a, b))
    return out


def disguised(s: str) -> dict[str, list[Span]]:
    """Spans, in the source's characters, that appear once disguises are rewritten; {} without a disguise."""
    odd = None if s.isascii() or not _ODD.search(s) else glyphs(s)
    plain = odd.text() if odd else s
    hint = _HINT.search(plain) is not None
    if not odd and not hint:
        return {}
    spelt, numbers = words(plain) if hint else (None, [])
    found = detect(spelt.text() if spelt else plain)
    for kind, spans in found.items():
        if spelt:
            spans = [spelt.back(*x) for x in spans]
        if kind == "phone" and numbers:
            spans = sorted(spans + apart(apart(numbers, sorted(spans)), found["card"]))
        found[kind] = spans
    return {kind: [odd.back(*x) for x in spans] if odd else spans for kind, spans in found.items()}


def find(s: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans of each kind."""
    base = detect(s)
    more = disguised(s)
    every = {}
    for kind in KINDS:
        every[kind] = sorted(base[kind] + apart(more.get(kind, []), base[kind]))
    return base, every


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


FIELDS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: list[list[int]] = [[], [], [], []]
        digest, spans = [], []
        for s in b.column(1).to_pylist():
            base, every = find(s or "")
            for c, k in zip(counts, KINDS, strict=True):
                c.append(len(base[k]))
            digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append(listed(every))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], [f.split()[0] for f in FIELDS.split(", ")])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    narrow_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_scan, FIELDS)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
