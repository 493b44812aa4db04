"""Structural filters, anchors and scope membership."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.corpus import OPEN, VISIBLE, WORK_KINDS
from lorewell.functions.globs import has_glob, matches, to_regex


@dataclass(frozen=True)
class Filter:
    """All given criteria must hold; within one, any value does. An empty criterion passes."""

    types: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    agents: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()
    since: int | None = None
    until: int | None = None

    def shown(self) -> Column:
        """As ``column``, and without asking for a status only those that are shown by default."""
        return self.column() if self.statuses else self.column() & visible()

    def column(self) -> Column:
        out = F.lit(True)
        for name, values in (("type", self.types), ("classification", self.classes), ("status", self.statuses), ("agent_id", self.agents), ("agent_role", self.roles)):
            if values:
                out = out & F.coalesce(F.col(name).isin(*values), F.lit(False))
        if self.tags:
            out = out & F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, self.tags))), F.lit(False))
        if self.anchors:
            either = lambda x: _any([F.rlike(x, F.lit(to_regex(a))) | matches(x, F.lit(a)) for a in self.anchors])
            out = out & F.coalesce(F.exists("anchors", either), F.lit(False))
        if self.since is not None:
            out = out & (F.col("created_ms") >= self.since)
        if self.until is not None:
            out = out & (F.col("created_ms") <= self.until)
        return out


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def visible() -> Column:
    return F.col("status").isin(*VISIBLE)


def knowledge() -> Column:
    return F.col("scope").isNull()


def work_item() -> Column:
    return F.coalesce(F.col("type").isin(*WORK_KINDS), F.lit(False)) & F.col("scope").isNotNull()


def actionable() -> Column:
    return ~F.col("status").isin("closed", "superseded", "forgotten")


def is_open() -> Column:
    return F.col("status").isin(*OPEN)


def satisfied() -> Column:
    return F.col("status").isin("closed", "superseded")


def transition_allowed(source: Column, target: Column) -> Column:
    """Note status changes: never to superseded; superseded only to forgotten; forgotten only to active."""
    return F.when(target == "superseded", False).when(source == "superseded", target == "forgotten").when(source == "forgotten", target == "active").otherwise(True)


def task_transition_allowed(source: Column, target: Column) -> Column:
    going = source.isin("active", "in_progress") & target.isin("in_progress", "closed")
    return going | ((source == "in_progress") & (target == "active")) | ((source == "blocked") & target.isin("active", "in_progress"))


def hierarchy_allowed(parent: Column, child: Column) -> Column:
    """An epic holds issues and tasks, an issue holds tasks."""
    rank = lambda c: F.when(c == "epic", 0).when(c == "issue", 1).when(c == "task", 2)
    return F.coalesce(rank(parent) < rank(child), F.lit(False))


def anchors_of(notes: DataFrame, name: str = "anchor") -> DataFrame:
    return notes.select("id", F.explode("anchors").alias(name))


def glob_pairs(patterns: DataFrame, paths: DataFrame) -> DataFrame:
    """(pattern, path) of distinct patterns and paths where the pattern matches, pattern and path alike included.

    No nested loop: what a glob says before its first wildcard fixes a folder, and only paths
    below that folder are compared with it; literal patterns join by equality.
    """
    folder = F.regexp_extract("pattern", r"^([^*?\[]*/)?", 0)
    globs = patterns.where(has_glob(F.col("pattern"))).withColumn("_dir", folder)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    below = paths.select("path", F.explode(above).alias("_dir")).distinct()
    wild = globs.join(below, "_dir").where(matches(F.col("pattern"), F.col("path"))).select("pattern", "path")
    same = patterns.join(paths, patterns["pattern"] == paths["path"]).select("pattern", "path")
    return wild.union(same).distinct()


def anchor_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of distinct anchors of both sides where either, as a pattern, matches the other."""
    a, b = left.distinct(), right.distinct()
    ab = glob_pairs(a.toDF("pattern"), b.toDF("path")).select(F.col("pattern").alias("a"), F.col("path").alias("b"))
    ba = glob_pairs(b.toDF("pattern"), a.toDF("path")).select(F.col("path").alias("a"), F.col("pattern").alias("b"))
    return ab.union(ba).distinct()


def structural(notes: DataFrame, f: Filter) -> DataFrame:
    return notes.where(f.column())
