"""The part of a corpus that a report is about: filters, the neighbourhood of a note, or all of it if that is asked for."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from lorewell.corpus import VISIBLE, Corpus
from lorewell.functions.runtime import written
from lorewell.operators.filters import Filter
from lorewell.operators.graph import expand


@dataclass(frozen=True)
class Scope:
    """Notes that pass ``filter``; with ``around`` only those within ``depth`` links of that note, and it; ``universe`` says that all are meant."""

    filter: Filter = Filter()
    around: str | None = None
    depth: int = 2
    universe: bool = False

    def require(self, report: str) -> None:
        """An error where nobody said what the report is about."""
        if not (self.universe or self.around is not None or replace(self.filter, statuses=()) != Filter()):
            raise ValueError(f"{report} wants a filter, a note to look around, or universe")


def scoped(corpus: Corpus, scope: Scope, report: str) -> Corpus:
    """The corpus with the notes of ``scope`` that are shown by default; links, events and vectors stay, as reports join them to notes.

    An unknown note to look around is a KeyError.
    """
    scope.require(report)
    notes = corpus.notes.where(replace(scope.filter, statuses=tuple(VISIBLE)).column())
    if scope.around is not None:
        if corpus.notes.where(F.col("id") == scope.around).isEmpty():
            raise KeyError(f"no note {scope.around}")
        start = corpus.notes.where(F.col("id") == scope.around).select("id")
        near = written(expand(corpus.edges, scope.around, scope.depth).select("id").union(start).distinct())
        notes = notes.join(near, "id", "left_semi")
    return replace(corpus, notes=notes)
