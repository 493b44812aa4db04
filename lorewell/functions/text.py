"""Text analysis as built-in column expressions: fold, tokens, stopwords, stems, snippets."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function words (folded) that carry no content.
STOPWORDS = """
a agora ainda alem ali and antes ao aos apos aqui are as at ate be by cada com como contra da dao das de
depois desde do dos durante e ela ele em entao entre era eram essa esse esta estao este foi for from ha how in is
isso isto it ja la lhe mais mas me menos mesmo muito na nao nas no nos nossa nosso num nunca o of on onde or os ou
outra outro para pela pelo por porem porque pouco qual quando que quem sao se sem sempre ser sera seu so sobre
sua talvez tambem tao te tem that the this to toda todas todo todos um uma vai vao voce vou was what when
where which who will with
""".split()

# Derivational suffixes; at least four letters of a word stay.
SUFFIXES = """
imento amento icao ucao acao ismo eiro ando endo indo oso ado ido
amentos imentos encias ancias acoes ucoes icoes dades ismos istas eiros eiras aveis iveis osos osas ados idos adas
idas amos emos imos
encia ancia ista eira aria eria iria osa ada ida
dade asse esse isse avel ivel ariam eriam iriam aram eram iram ar er ir
""".split()

TOKEN = "[a-z0-9_]+"
_ENDS = frozenset(x[-1] for x in SUFFIXES)


@cache
def fold_map() -> tuple[str, str]:
    """Characters whose decomposition is one ASCII character and marks, what they become; then all marks, which vanish."""
    source, target, marks = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c).startswith("M"):
            marks.append(c)
            continue
        parts = unicodedata.normalize("NFD", c)
        if parts != c or len(parts) > 1:
            base = [p for p in parts if not unicodedata.category(p).startswith("M")]
            if len(base) == 1 and base[0] < "\x80":
                source.append(c)
                target.append(base[0])
    return "".join(source + marks), "".join(target)


def _col(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fold(text: str | Column) -> Column:
    """Lower case without marks; only a text with characters beyond ASCII is looked up character by character."""
    source, target = fold_map()
    return F.lower(F.when(_col(text).rlike(r"[^\x00-\x7f]"), F.translate(_col(text), source, target)).otherwise(_col(text)))


def tokens(text: str | Column) -> Column:
    """Folded runs of a-z, 0-9 and underscore, in order."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def content_terms(text: str | Column) -> Column:
    """Distinct tokens in order of first appearance, of two characters or more, without stopwords."""
    return F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def _cut(token: Column) -> Column:
    return F.regexp_replace(token, f"^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$", "$1")


def stem(token: Column) -> Column:
    """Conservative stem as one expression; for columns of many tokens ``with_stem`` is faster."""
    n = F.length(token)
    return (
        F.when(n < 4, token)
        .when(F.endswith(token, F.lit("oes")), _cut(F.concat(F.left(token, n - 3), F.lit("ao"))))
        .when(F.endswith(token, F.lit("s")) & (n >= 5), _cut(F.left(token, n - 1)))
        .otherwise(_cut(token))
    )


def with_stem(rows: DataFrame, token: str, name: str) -> DataFrame:
    """``rows`` with the stem of a token column, in two steps: the singular, then the suffix; the pattern only sees words that could have one."""
    t = F.col(token)
    n = F.length(t)
    base = F.when((n >= 4) & F.endswith(t, F.lit("oes")), F.concat(F.left(t, n - 3), F.lit("ao"))).when((n >= 5) & F.endswith(t, F.lit("s")), F.left(t, n - 1)).otherwise(t)
    ends = sorted({x[-1] for x in SUFFIXES})
    short = (F.length("_base") < 6) | ~F.right("_base", F.lit(1)).isin(*ends)
    return rows.withColumn("_base", base).withColumn(name, F.when(short, F.col("_base")).otherwise(_cut(F.col("_base")))).drop("_base")


def stems(terms: Column) -> Column:
    """Stem of each element; two words with one stem count twice."""
    return F.transform(terms, stem)


def fold_python(text: str) -> str:
    source, target = fold_map()
    table = {ord(c): (target[i] if i < len(target) else None) for i, c in enumerate(source)}
    return text.translate(table).lower()


@cache
def _cut_python():
    import re

    return re.compile(f"^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$")


def stem_python(t: str) -> str:
    """``stem`` of one token."""
    if len(t) < 4:
        return t
    base = t[:-3] + "ao" if t.endswith("oes") else t[:-1] if t.endswith("s") and len(t) >= 5 else t
    return base if len(base) < 6 or base[-1] not in _ENDS else _cut_python().sub(r"\1", base)


def query_terms(query: str) -> list[str]:
    """Content terms of a query, stemmed, on the driver: one short string."""
    import re

    return [stem_python(t) for t in dict.fromkeys(re.findall(TOKEN, fold_python(query))) if len(t) >= 2 and t not in STOPWORDS]


def snippet(body: str | Column, terms: list[str], size: int = 280) -> Column:
    """Window of ``size`` characters around the first folded occurrence of any term; null where none occurs."""
    folded = fold(body)
    at = F.least(*[F.when(F.instr(folded, t) > 0, F.instr(folded, t)) for t in terms], F.lit(None).cast("int"))
    start = F.greatest(at - size // 2, F.lit(1))
    window = F.substring(_col(body), start, F.lit(size))
    dots = F.lit("…")
    return F.when(at.isNotNull(), F.concat(F.when(start > 1, dots).otherwise(""), window, F.when(start + size - 1 < F.length(_col(body)), dots).otherwise("")))


def one_line(text: str | Column) -> Column:
    """Pipes and white space become one space each run."""
    return F.trim(F.regexp_replace(_col(text), r"[|\s]+", " "))


def token_estimate(text: str | Column) -> Column:
    return F.ceil(F.length(_col(text)) / 4).cast("long")


# Body slots by note type, with the phrases that fill them.
SLOTS = {
    "decision": [("alternativas", ["alternativas", "alternatives", "opcoes", "options"]), ("por quê", ["por que", "porque", "why", "rationale"]), ("consequência", ["consequencia", "consequence", "impacto", "impact"])],
    "error": [("causa", ["causa", "cause", "root cause"]), ("correção", ["correcao", "fix", "correction", "solucao", "solution"])],
    "risk": [("probabilidade", ["probabilidade", "probability", "chance"]), ("impacto", ["impacto", "impact"])],
    "def": [("significado", ["significado", "meaning", "definicao", "definition"])],
    "snippet": [("linguagem", ["linguagem", "language", "lang"])],
}


def missing_slots(kind: Column, body: str | Column, n_anchors: Column, n_edges: Column) -> Column:
    """Names of the slots that a note of its kind should fill and doesn't, in order."""
    fenced = _col(body).rlike(r"(?m)^\s*```[A-Za-z0-9]")

    def named(words: Column) -> Column:
        out = []
        for k, slots in SLOTS.items():
            for name, phrases in slots:
                has = fenced if k == "snippet" else F.lit(False)
                for p in phrases:
                    has = has | F.contains(words, F.lit(f" {p} "))
                out.append(F.when((kind == k) & ~has, F.lit(name)))
        out.append(F.when((kind == "snippet") & (n_anchors == 0), F.lit("âncora")))
        out.append(F.when((kind == "question") & (n_anchors == 0) & (n_edges == 0), F.lit("o que falta (âncora ou depends_on)")))
        return F.array_compact(F.array(*out))

    # a lambda's argument: words are cut once a note, and only for kinds with slots
    words = F.when(kind.isin(*SLOTS), F.concat(F.lit(" "), F.array_join(tokens(body), " "), F.lit(" "))).otherwise(F.lit(""))
    return F.element_at(F.transform(F.array(words), named), 1)


# Phrases before an id that tell the kind of edge.
CUES = {
    "depende de": "depends_on", "dependência de": "depends_on", "requer": "depends_on", "precisa de": "depends_on", "contradiz": "contradicts", "refuta": "contradicts", "invalida": "contradicts",
    "confirma": "supports", "reforça": "supports", "suporta": "supports", "estende": "extends", "refina": "extends", "generaliza": "extends", "substitui": "replaces", "rejeita": "rejects",
}


def mentions(text: str | Column, types: list[str]) -> Column:
    """Ids in a text, each with the kind of edge that the words before it tell: array of (target, kind, reason).

    The text is cut before each id, so what stands before one are the pieces before its own; three of them hold the 24 characters that count.
    """
    one = rf"(?:{'|'.join(types)})_[0-9a-z]{{8}}(?![0-9A-Za-z_])"
    cut = F.split(F.concat(F.lit(" "), _col(text)), rf"(?<![0-9A-Za-z_])(?={one})")

    def told(x: Column) -> Column:
        """Of (target, before, tail): the kind and reason."""
        kind, reason = F.lit("references"), F.lit("menção")
        for cue, k_ in reversed(CUES.items()):
            kind, reason = F.when(F.endswith(x["tail"], F.lit(cue)), k_).otherwise(kind), F.when(F.endswith(x["tail"], F.lit(cue)), "verbo").otherwise(reason)
        return F.struct(x["target"].alias("target"), F.when(x["link"], "references").otherwise(kind).alias("kind"), F.when(x["link"], "wikilink").otherwise(reason).alias("reason"))

    def ends(x: Column) -> Column:
        return F.struct(x["target"].alias("target"), F.lower(F.right(x["before"], F.lit(24))).alias("tail"), F.endswith(x["before"], F.lit("[[")).alias("link"))

    def found(pieces: Column) -> Column:
        piece = lambda k, n: F.coalesce(F.get(pieces, k - n), F.lit(""))
        before = lambda k: F.rtrim(F.regexp_replace(F.concat(piece(k, 3), piece(k, 2), piece(k, 1)), r"\s+$", ""))
        each = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.struct(F.regexp_extract(piece(k, 0), f"^{one}", 0).alias("target"), before(k).alias("before")))
        return F.when(F.size(pieces) > 1, F.transform(F.transform(each, ends), told)).otherwise(none)

    none = F.array().cast("array<struct<target: string, kind: string, reason: string>>")
    # lambdas' arguments: the text is cut once, and what stands before an id is found once, not anew for each id and cue
    return F.element_at(F.transform(F.array(cut), found), 1)


def closest(raw: str | Column, valid: list[str]) -> Column:
    """The label of a closed set nearest by edit distance, the first at a tie; null beyond two edits or a third of the length."""
    low = F.lower(_col(raw))
    ranked = F.array(*[F.struct(F.levenshtein(low, F.lit(v.lower())).alias("d"), F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(valid)])
    best = F.array_min(ranked)
    return F.when(best["d"] <= F.greatest(F.lit(2), F.floor(F.length(low) / 3)), best["v"])


#: How a body's line that names its parent begins; another store's lines may begin otherwise.
MARKER = "<!-- lorewell:parent"


def parent_marker(body: str | Column, marker: str = MARKER) -> Column:
    """(parent, blocks) of the first line that marks a parent; null without one."""
    line = rf"(?m)^[^\S\n]*{marker}[ \t]+(\S+?)(?:[ \t]+blocks[ \t]+(\d+))?[ \t]*(?:-->)?[ \t]*$"
    parent = F.regexp_extract(_col(body), line, 1)
    blocks = F.regexp_extract(_col(body), line, 2)
    return F.when(parent != "", F.struct(parent.alias("parent"), F.when(blocks != "", blocks.cast("int")).alias("blocks")))


def without_marker(body: str | Column, marker: str = MARKER) -> Column:
    """The body without marker lines and the empty lines that are left at its end."""
    lines = F.filter(F.split(_col(body), "\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit(marker)))
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?:\n\s*)+$", "")


def with_marker(body: str | Column, parent: Column, blocks: Column | None = None, marker: str = MARKER) -> Column:
    """The body with one line at its end that marks its parent, and its place there where it has one."""
    place = F.lit("") if blocks is None else F.coalesce(F.concat(F.lit(" blocks "), blocks.cast("string")), F.lit(""))
    line = F.concat(F.lit(marker + " "), parent, place, F.lit(" -->"))
    rest = without_marker(body, marker)
    return F.when(rest == "", line).otherwise(F.concat(rest, F.lit("\n"), line))
