"""The indented notation of note headers, to and from plain Python values.

Blocks nest by two spaces; values on one line may be flow lists, flow maps, quoted or bare scalars;
# begins a comment. Lines feed a stack of open containers; flow values are split into lexemes by one pattern.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH = 32
_LEXEME = re.compile(r'\s*(?:(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<mark>[\[\]{},])|(?P<bare>[^\[\]{},"][^\[\]{},]*))')
_ESCAPE = re.compile(r"\\(u\{([0-9A-Fa-f]+)\}|.)?", re.DOTALL)
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "r": "\r", "t": "\t", "0": "\0"}
_INT, _FLOAT = re.compile(r"[+-]?\d+$"), re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")


class ToonError(ValueError):
    """Text that is no document of the notation."""


def _unescape(m: re.Match) -> str:
    if m[2]:
        return chr(int(m[2], 16))
    if m[1] not in _ESCAPES:
        raise ToonError(f"unknown escape {m[0]!r}")
    return _ESCAPES[m[1]]


def scalar(text: str) -> Any:
    if text.startswith('"'):
        if len(text) < 2 or not text.endswith('"'):
            raise ToonError("unclosed string")
        return _ESCAPE.sub(_unescape, text[1:-1])
    if text in ("true", "false"):
        return text == "true"
    if _INT.match(text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    if re.search("[.eE]", text) and _FLOAT.match(text) and abs(float(text)) != float("inf"):
        return float(text)
    return text


def _put(into: dict | list, key: str | None, value: Any) -> None:
    if isinstance(into, list):
        into.append(value)
    elif key in into:
        raise ToonError(f"duplicate key {key!r}")
    else:
        into[key] = value


def _pair(text: str) -> tuple[str, str]:
    m = re.match(r'("(?:[^"\\]|\\.)*"|[^:"]*):(?:\s+|$)', text)
    if not m or not m[1].strip():
        raise ToonError(f"no key in {text!r}")
    return str(scalar(m[1].strip())) if m[1].startswith('"') else m[1].strip(), text[m.end() :].strip()


def flow(text: str) -> Any:
    """The value of one line."""
    text = text.strip()
    if not text or text[0] not in "[{":
        return scalar(text)
    root: list = []
    open_: list[tuple[Any, str]] = [(root, "")]
    key: str | None = None
    keys: list[str | None] = []
    at = 0
    while at < len(text):
        m = _LEXEME.match(text, at)
        if not m:
            raise ToonError(f"unclosed string in {text!r}")
        at = m.end()
        mark, into = m["mark"], open_[-1][0]
        if mark in ("[", "{"):
            keys.append(key)
            open_.append(([], "]") if mark == "[" else ({}, "}"))
            key = None
        elif mark in ("]", "}"):
            done, close = open_.pop()
            if close != mark or not open_:
                raise ToonError(f"misplaced {mark!r}")
            _put(open_[-1][0], keys.pop(), done)
            key = None
        elif mark == ",":
            key = None
        else:
            piece = (m["quoted"] or m["bare"]).strip()
            if not piece:
                continue
            if isinstance(into, dict) and key is None:
                key, rest = _pair(piece if m["bare"] else piece + text[at:].split(",")[0])
                if rest:
                    _put(into, key, scalar(rest))
                    key = None
            else:
                _put(into, key, scalar(piece))
                key = None
    if len(open_) != 1:
        raise ToonError(f"unclosed {open_[-1][1]!r}")
    return root[0]


def _lines(text: str) -> list[tuple[int, str]]:
    out = []
    for n, raw in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        body = re.match(r'(?:"(?:[^"\\]|\\.)*"|(?!(?:^|\s)#).)*', raw)[0].rstrip()
        if not body.strip():
            continue
        lead = len(body) - len(body.lstrip())
        if "\t" in body[:lead] or lead % 2:
            raise ToonError(f"indentation of line {n}")
        out.append((lead, body.strip()))
    return out


def parse(text: str) -> dict:
    """The document's mapping; ToonError where it is none."""
    root: dict = {}
    stack: list[tuple[int, Any]] = [(0, root)]  # indentation and container
    waiting: tuple[int, Any, str | None] | None = None  # a key or dash whose value may stand below
    for indent, line in _lines(text):
        dash = line == "-" or line.startswith("- ")
        if waiting and indent > waiting[0]:
            child: Any = [] if dash else {}
            if isinstance(waiting[1], list):
                waiting[1][-1] = child
            else:
                waiting[1][waiting[2]] = child
            stack.append((indent, child))
            if len(stack) > DEPTH:
                raise ToonError("nested too deep")
        waiting = None
        while stack[-1][0] > indent:
            stack.pop()
        if stack[-1][0] != indent:
            raise ToonError(f"unexpected indentation of {line!r}")
        into = stack[-1][1]
        if dash != isinstance(into, list):
            raise ToonError(f"unexpected {line!r}")
        if not dash:
            key, rest = _pair(line)
            _put(into, key, flow(rest) if rest else {})
            if not rest:
                waiting = (indent, into, key)
            continue
        item = line[1:].strip()
        if not item:
            into.append({})
            waiting = (indent, into, None)
        elif item[0] not in '[{"' and re.match(r"[A-Za-z_][\w-]*:(?:\s|$)", item):
            key, rest = _pair(item)
            if not rest:
                raise ToonError("a map item's first value stands on its line")
            into.append({key: flow(rest)})
            stack.append((indent + 2, into[-1]))
        else:
            into.append(flow(item))
    return root


def _bare(text: str) -> bool:
    odd = re.search(r'["\\#,\[\]{}]', text) or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in text)
    return bool(text) and text.strip() == text and not odd and text != "-" and not text.startswith("- ") and scalar(text) == text and isinstance(scalar(text), str)


def _inline(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(int(value)) if value == int(value) else repr(value)
    if isinstance(value, list):
        return f"[{', '.join(map(_inline, value))}]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {_inline(v)}" for k, v in value.items()) + "}"
    if _bare(value):
        return value
    names = {v: k for k, v in _ESCAPES.items() if k != "0"}
    return '"' + "".join(f"\\{names[c]}" if c in names else f"\\u{{{ord(c):x}}}" if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in value) + '"'


def emit(value: dict, indent: int = 0) -> str:
    """Text of a mapping; empty lists and maps are left out."""
    pad, out = " " * indent, []
    for k, v in value.items():
        if v in ({}, []):
            continue
        if isinstance(v, dict):
            out.append(f"{pad}{k}:\n{emit(v, indent + 2)}")
        elif isinstance(v, list) and any(isinstance(x, (dict, list)) for x in v):
            out.append(f"{pad}{k}:\n")
            for item in v:
                rows = [f"{a}: {_inline(b)}" for a, b in item.items()] if isinstance(item, dict) and item else [_inline(item)]
                out += [f"{pad}  {'  ' if n else '- '}{row}\n" for n, row in enumerate(rows)]
        else:
            out.append(f"{pad}{k}: {_inline(v)}\n")
    return "".join(out)


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]))
def to_json(texts: pd.Series) -> pd.DataFrame:
    """JSON of each document, or why it is none."""

    def one(t: str | None) -> tuple[str | None, str | None]:
        try:
            return json.dumps(parse(t or ""), ensure_ascii=False), None
        except ToonError as e:
            return None, str(e)

    return pd.DataFrame([one(t) for t in texts], columns=["json", "error"])


@F.pandas_udf(T.StringType())
def from_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: emit(json.loads(t)) if t else "")
