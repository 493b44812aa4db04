"""Path globs as regular expressions: ? is one character but /, * a run without /, ** anything; all else is literal."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base names that no anchor may point at.
DENIED = [".env*", "*.pem", "*.key", "*.p12", "*.jks", "*.keystore", "id_*", "credentials*", ".netrc", ".pgpass", "secrets.*", "*.tfstate*"]


def to_regex(pattern: str) -> str:
    out = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(?s)^" + "".join(out.get(p) or re.escape(p) for p in re.split(r"(\*\*|\*|\?)", pattern) if p) + "$"


def regex_column(pattern: Column) -> Column:
    """The regular expression of a glob that is a column."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    marked = F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit("(?s)^"), F.replace(marked, F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def matches(pattern: Column, path: Column) -> Column:
    return F.rlike(path, regex_column(pattern))


def either_matches(a: Column, b: Column) -> Column:
    """A pattern on either side; equal strings need no expression."""
    return (a == b) | matches(a, b) | matches(b, a)


def has_glob(anchor: Column) -> Column:
    return F.rlike(anchor, F.lit(r"[*?\[]"))


def denied(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)
    return F.rlike(name, F.lit("|".join(f"(?:{to_regex(p)})" for p in DENIED)))
