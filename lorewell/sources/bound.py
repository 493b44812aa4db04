"""A corpus bound to plain tables: each document is a note; links, events and vectors follow by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.corpus import Corpus
from lorewell.functions.ids import TYPES
from lorewell.functions.runtime import spread

NOW_MS = 1_735_689_600_000


def _note(i: str) -> str:
    return f"concat('n', lpad(cast({i} as string), 10, '0'))"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    types = ",".join(f"'{t}'" for t in TYPES)
    i = "doc_id"
    rows = docs.join(labels, "doc_id", "left").selectExpr(
        i,
        f"{_note(i)} as id",
        f"case when {i} % 10 <> 0 then element_at(array({types}), cast({i} % 10 + 1 as int)) end as type",
        "substring(split(coalesce(text, ''), '\\n')[0], 1, 120) as statement",
        "coalesce(text, '') as body",
        "array(lang) as tags",
        f"case when {i} % 16 = 5 then array(concat('src/', source, '/doc_', cast({i} % 64 as string), '.rs'), concat('src/', source, '/**')) else array(concat('src/', source, '/doc_', cast({i} % 64 as string), '.rs')) end as anchors",
        f"element_at(array('foundational','tactical','observational'), cast({i} % 3 + 1 as int)) as classification",
        f"element_at(array('active','active','in_progress','closed','active','blocked','active','closed','superseded','forgotten','active'), cast({i} % 11 + 1 as int)) as status",
        f"case when {i} % 10 = 0 then 'epic' when {i} % 10 in (1, 2, 5) then 'task' when {i} % 20 = 3 then 'issue' end as scope",
        f"1700000000000 + {i} * 3600000 as created_ms",
        "case when quality = 1 then 1.0D else 0.0D end as successes",
        "case when toxic = 1 then 1.0D else 0.0D end as failures",
        "case when quality = 1 then 1L else 0L end as reviews",
        f"case when quality = 1 or toxic = 1 then 1700000000000 + {i} * 3600000 + 86400000 end as last_ms",
        f"case when {i} % 50 = 6 and {i} % 100 <> 6 then {_note(i + ' + 1')} end as superseded_by",
        f"array(named_struct('subject', concat('s', cast({i} % 40 as string)), 'relation', concat('r', cast({i} % 3 as string)), 'object', concat('o', cast({i} % 7 as string)))) as claims",
        f"concat('agent', cast({i} % 7 as string)) as agent_id",
        f"case when {i} % 4 = 3 then 'subagent' else 'main' end as agent_role",
    )
    return rows


#: kind, condition on i, target: the links of note i.
EDGE_RULES = [
    ("references", "i > 3", "(i * 13 + 7) % (i DIV 2 + 1)"),
    ("depends_on", "i % 10 in (1, 2) and i > 9", "i DIV 2"),
    ("depends_on", "i in (11, 21, 31)", "case i when 11 then 21 when 21 then 31 else 11 end"),
    ("supports", "i % 5 = 0 and i > 5", "(i * 7 + 3) % (i DIV 3 + 1)"),
    ("supports", "i % 97 = 13", "i + 100000000"),
    ("extends", "i % 9 = 4", "i - 3"),
    ("replaces", "i % 50 = 7", "i - 1"),
    ("contradicts", "i % 17 = 5", "i - 3"),
    ("same_as", "i % 40 in (8, 12)", "i - 4"),
    ("broader", "i % 30 = 9", "i DIV 3"),
    ("related", "i % 211 = 17", "i"),
]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as i")
    rules = ", ".join(f"case when {cond} then named_struct('kind', '{kind}', 'j', cast({to} as bigint)) end" for kind, cond, to in EDGE_RULES)
    out = ids.selectExpr("i", f"inline(filter(array({rules}), e -> e is not null))")
    tree = ids.where("i >= 1").selectExpr("(i - 1) DIV 8 as i", "'results_in' as kind", "i as j")
    return out.union(tree).selectExpr(f"{_note('i')} as src", "kind", f"{_note('j')} as dst")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr(
        "event_id",
        "case event_type when 'signup' then 'write' when 'purchase' then 'task' when 'error' then 'forget' when 'click' then 'link' else case when event_id % 2 = 0 then 'restore' else 'update' end end as op",
        f"{_note('user_id')} as note_id",
        "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) as at",
        "case when event_type = 'purchase' and event_id % 3 = 0 then 'review' when event_type = 'purchase' then 'submit' end as action",
        "case when event_type = 'click' and event_id % 4 = 0 then 'replaces' when event_type = 'click' then 'references' end as kind",
        f"case when event_type = 'click' then {_note('event_id % 500')} end as dst",
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two in three of the files that anchors name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where("doc_id % 64 % 3 <> 0 and source is not null").selectExpr("concat('src/', source, '/doc_', cast(doc_id % 64 as string), '.rs') as path").distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.selectExpr(f"{_note('vec_id')} as id", "embedding as vector", "label")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(notes(spark, sf_dir), edges(spark, sf_dir), NOW_MS, events(spark, sf_dir), vectors(spark, sf_dir), paths(spark, sf_dir))
