"""Persisted indexes with a header: an inverted index in segments, and a table of vectors.

A refresh reads a digest of each note, tokenises only what is new or changed, and adds a segment; a header of another
format, or of other fields, makes it build all anew. Segments have a folder per bucket of terms, so a search reads the
buckets of its terms alone, and of these the row groups that may hold them. Compaction makes one segment of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.runtime import written
from lorewell.functions.text import query_terms
from lorewell.operators.retrieval import FIELD_WEIGHT, apart, cut_words, field_tokens, scored
from lorewell.operators.words import counted
from lorewell.sources.versions import Versions

POSTINGS = "term string, field string, id string, tf long, len long, segment int, bucket int"
DOCS = "id string, digest string, segment int, " + ", ".join(f"len_{f} long" for f in FIELD_WEIGHT)


def digest(fields: tuple[str, ...] = tuple(FIELD_WEIGHT)) -> Column:
    """Of what is indexed of a note, and of nothing else."""
    return F.md5(F.encode(F.to_json(F.struct(*fields)), "UTF-8"))


class TermIndex:
    """Postings of notes (id, statement, body, tags) below ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, segments: int = 8):
        self.spark, self.versions, self.most = spark, Versions(spark, path), segments
        self.header = {"format": "terms-1", "fields": sorted(FIELD_WEIGHT), "buckets": buckets}

    def _bucket(self, term: str | Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.header["buckets"])).cast("int")

    def _state(self) -> tuple[int, dict]:
        """The newest version; an empty one where its header is another's."""
        number, manifest = self.versions.current()
        return number, manifest if manifest.get("header") == self.header else {"tables": {}, "header": self.header, "last": 0}

    def _living(self, manifest: dict) -> DataFrame:
        """The newest entry of each note that has not been removed."""
        docs = self.versions.read(manifest, "docs", DOCS)
        newest = docs.groupBy("id").agg(F.max(F.struct("segment", *[c for c in docs.columns if c not in ("id", "segment")])).alias("x")).select("id", "x.*")
        return newest.where(F.col("digest").isNotNull())

    def stale(self, notes: DataFrame) -> DataFrame:
        """(id, change): what a refresh would do, with a note being new, changed or removed."""
        _, manifest = self._state()
        return self._changes(notes, manifest).where(F.col("change").isNotNull()).select("id", "change")

    def _changes(self, notes: DataFrame, manifest: dict) -> DataFrame:
        now = notes.select("id", digest().alias("_now"))
        rows = now.join(self._living(manifest).select("id", F.col("digest").alias("_was")), "id", "full")
        return rows.withColumn("change", F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "removed").when(F.col("_now") != F.col("_was"), "changed"))

    def refresh(self, notes: DataFrame) -> str:
        """Bring the index up to ``notes``; says whether it was fresh, updated or rebuilt."""
        number, manifest = self._state()
        rebuilt = not manifest["tables"]
        changes = written(self._changes(notes, manifest).where(F.col("change").isNotNull()).select("id", "change", "_now"))
        if changes.isEmpty() and not rebuilt:
            return "fresh"
        segment = manifest["last"] + 1
        one, more = apart(notes.join(changes.where("change <> 'removed'").select("id"), "id", "left_semi"))
        words = written(cut_words(one))
        some = written(field_tokens(more).groupBy("id", "field", "term").agg(F.count("*").alias("tf")))
        lens = some.groupBy("id", "field").agg(F.sum("tf").alias("len"))
        fields = tuple(FIELD_WEIGHT)
        rows = counted(words, fields).union(some.join(lens, ["id", "field"]).select("id", "field", "term", "tf", "len"))
        size = lambda f: F.when(F.col(f) == "", 0).otherwise(F.size(F.split(f, " "))).cast("long").alias(f"len_{f}")
        per = words.select("id", *[size(f) for f in fields]).union(lens.groupBy("id").agg(*[F.sum(F.when(F.col("field") == f, F.col("len"))).alias(f"len_{f}") for f in fields]))
        docs = changes.join(per, "id", "left").select("id", F.col("_now").alias("digest"), F.lit(segment).alias("segment"), *[F.coalesce(f"len_{f}", F.lit(0)).alias(f"len_{f}") for f in FIELD_WEIGHT])
        rows = rows.select("term", "field", "id", "tf", "len", F.lit(segment).alias("segment"), self._bucket("term").alias("bucket"))
        tables = {"postings": [*manifest["tables"].get("postings", []), self._segment(rows)], "docs": [*manifest["tables"].get("docs", []), self.versions.part(docs, "docs")]}
        self._commit(number, manifest | {"tables": tables, "last": segment})
        if len(tables["docs"]) > self.most:
            self.compact()
        return "rebuilt" if rebuilt else "updated"

    def _segment(self, rows: DataFrame) -> str:
        return self.versions.part(rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term"), "postings", "bucket")

    def _commit(self, number: int, manifest: dict) -> None:
        """With the figures that a search needs of all notes: their number, and the words of each field."""
        sums = self._living(manifest).agg(F.count("*").alias("n"), *[F.sum(f"len_{f}").alias(f) for f in FIELD_WEIGHT]).first()
        self.versions.commit(number, manifest | {"n": sums.n, "words": {f: sums[f] or 0 for f in FIELD_WEIGHT}})

    def compact(self) -> None:
        """One segment of what lives; a search gives the same before and after."""
        number, manifest = self._state()
        living = written(self._living(manifest))
        segment = manifest["last"] + 1
        rows = self.versions.read(manifest, "postings", POSTINGS).join(living.select("id", "segment"), ["id", "segment"], "left_semi")
        tables = {"postings": [self._segment(rows.withColumn("segment", F.lit(segment)))], "docs": [self.versions.part(living.withColumn("segment", F.lit(segment)), "docs")]}
        self._commit(number, manifest | {"tables": tables, "last": segment})

    def bm25(self, notes: DataFrame, query: str, max_ratio: float = 0.9) -> DataFrame:
        """(id, raw, body_raw, score) as ``retrieval.bm25``, from the index; ``notes`` gives types and successes and no text."""
        _, manifest = self._state()
        wanted = query_terms(query)
        terms = sorted(set(wanted))
        n = manifest.get("n", 0)
        if not terms or not n:
            return self.spark.createDataFrame([], "id string, raw double, body_raw double, score double")
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket("term")).distinct().collect()]
        hits = self.versions.read(manifest, "postings", POSTINGS).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        newer = self.versions.read(manifest, "docs", DOCS).select("id", F.col("segment").alias("_since"))
        hits = hits.join(newer, (hits["id"] == newer["id"]) & (newer["_since"] > hits["segment"]), "left_anti")
        count = F.array(*[F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)) for t in terms])
        table = written(hits.groupBy("id", "field").agg(F.first("len").alias("len"), count.alias("tf")))
        return scored(notes, table, wanted, n, {f: w for f, w in manifest["words"].items() if w}, max_ratio)


class VectorTable:
    """Vectors of notes (id, body_hash, vector) below ``path``; a header of another model or size of vectors leaves none of them."""

    def __init__(self, spark: SparkSession, path: str, model: str, size: int):
        self.versions, self.header = Versions(spark, path), {"format": "vectors-1", "model": model, "size": size}
        self.schema = "id string, body_hash string, vector array<double>, batch int"

    def _state(self) -> tuple[int, dict]:
        number, manifest = self.versions.current()
        return number, manifest if manifest.get("header") == self.header else {"tables": {}, "header": self.header, "last": 0}

    def load(self) -> DataFrame:
        """The newest vector of each note."""
        rows = self.versions.read(self._state()[1], "vectors", self.schema)
        return rows.groupBy("id").agg(F.max_by(F.struct("body_hash", "vector"), "batch").alias("x")).select("id", "x.body_hash", "x.vector")

    def add(self, vectors: DataFrame) -> int:
        """Append vectors; those of another size than the header's are left out. Gives the number of the version."""
        number, manifest = self._state()
        batch = manifest["last"] + 1
        fits = vectors.where(F.size("vector") == self.header["size"]).select("id", "body_hash", F.col("vector").cast("array<double>").alias("vector"), F.lit(batch).alias("batch"))
        return self.versions.commit(number, manifest | {"tables": {"vectors": [*manifest["tables"].get("vectors", []), self.versions.part(fits, "vectors")]}, "last": batch})
