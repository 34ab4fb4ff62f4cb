"""The stored text index: immutable segments, tombstones, and running statistics of the corpus.

A change writes one segment: the documents it adds or replaces, their postings,
and tombstones of the documents that it replaces or removes. A document lives
while no later segment has a tombstone for it. The number of live documents and
their length are carried from state to state, so no question counts the corpus.
Segments are merged so that each stays at least twice as large as all that are
newer, so there are few of them and a document is rewritten a logarithmic number
of times.

Postings of a small segment are dealt to files by the first two characters of
their terms. Those of a large one stay where their documents are, in runs that
are ordered by term, so that none of them is shuffled: the bounds of pages tell
which ones hold a question's terms.

An index is a value: every change returns another one, and readers of the former
keep their files until these are deleted.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.session import swept
from quarry.sources import folders

KEY = ["entity_type", "entity_id"]
DOC_SCHEMA = "entity_type string, sub_type string, entity_id long, owner long, digest long, name_tokens array<string>, desc_tokens array<string>, dl int"
POSTING_SCHEMA = "term string, entity_type string, sub_type string, entity_id long, dl int, tf long, places array<int>, p3 string, zone int"
#: The same in runs; prefixes follow from the term.
RUN_SCHEMA = f"{search.PLACED}, zone int"
#: Counts of terms by zone; those of removed documents are negative and say in which segment these lie.
TERM_SCHEMA = "term string, zone int, n long, most long, least int, home int"
REMOVED_SCHEMA = "entity_type string, entity_id long"
#: Tokens up to which a segment's postings are dealt by prefix, so that small segments have few files.
DEALT_TOKENS = 1_000_000
#: Segments are written once and read by the few row groups of a question's terms, so size counts for more than the time to unpack.
CODEC = "zstd"


def digested(texts: DataFrame) -> DataFrame:
    """Texts with a number that changes with anything that the index holds of them."""
    return texts.withColumn("digest", F.xxhash64("sub_type", "owner", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))))


@dataclass(frozen=True)
class Segment:
    """``docs`` documents, live when it was written, and ``removed`` tombstones of earlier ones; ``runs`` if its postings are in runs."""

    seg: int
    commit: str
    docs: int
    removed: int
    runs: bool = False


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    root: str
    segments: tuple[Segment, ...] = ()
    n_docs: int = 0
    total_len: int = 0

    @staticmethod
    def of(spark: SparkSession, root: str, state: dict | None) -> TextIndex:
        """The index that ``state`` describes."""
        state = state or {"segments": [], "n_docs": 0, "total_len": 0}
        return TextIndex(spark, root, tuple(Segment(**s) for s in state["segments"]), state["n_docs"], state["total_len"])

    def state(self) -> dict:
        return {"segments": [s.__dict__ for s in self.segments], "n_docs": self.n_docs, "total_len": self.total_len}

    # -- reading

    def _read(self, kind: str, schema: str, segments: tuple[Segment, ...]) -> DataFrame:
        schema = f"{schema}, seg int, commit string" + (", p2 string" if kind in ("postings", "terms") else "")
        if not segments:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{kind}/seg={s.seg}/commit={s.commit}" for s in segments]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def _tombstones(self, segments: tuple[Segment, ...] | None = None) -> DataFrame | None:
        """(key, gone): the last segment that removed a document; None if nothing was removed."""
        some = tuple(s for s in (self.segments if segments is None else segments) if s.removed)
        return self._read("removed", REMOVED_SCHEMA, some).groupBy(*KEY).agg(F.max("seg").alias("gone")) if some else None

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._tombstones()
        if gone is None:
            return rows
        dead = gone.select(*[F.col(k).alias(f"gone_{k}") for k in KEY], "gone")
        same = [F.col(k) == F.col(f"gone_{k}") for k in KEY]
        return rows.join(dead, [*same, F.col("seg") < F.col("gone")], "left_anti")

    def docs(self) -> DataFrame:
        """The live documents."""
        return self._live(self._read("docs", DOC_SCHEMA, tuple(s for s in self.segments if s.docs))).drop("seg", "commit")

    def postings(self) -> DataFrame:
        """The postings of live documents; a question's terms prune partitions and row groups."""
        return self._live(self._all_postings(tuple(s for s in self.segments if s.docs))).select("term", "entity_type", "sub_type", "entity_id", "dl", "tf", "places", "p2", "p3", "zone")

    def _all_postings(self, segments: tuple[Segment, ...]) -> DataFrame:
        """The postings of segments, dealt by prefix or in runs."""
        dealt, inside = tuple(s for s in segments if not s.runs), tuple(s for s in segments if s.runs)
        rows = self._read("postings", POSTING_SCHEMA, dealt)
        if not inside:
            return rows
        found = search.prefixed(self._read("runs", RUN_SCHEMA, inside))
        return found.unionByName(rows) if dealt else found

    def terms(self) -> DataFrame:
        """(term, zone, n, most, least, p2): sums of ``n`` count live documents; ``most`` and ``least`` bound them."""
        return self._all_terms(self.segments).drop("seg", "commit", "home")

    def _all_terms(self, segments: tuple[Segment, ...]) -> DataFrame:
        dealt, inside = tuple(s for s in segments if not s.runs), tuple(s for s in segments if s.runs)
        rows = self._read("terms", TERM_SCHEMA, dealt)
        if not inside:
            return rows
        found = self._read("counts", TERM_SCHEMA, inside).withColumn("p2", F.substring("term", 1, 2))
        return found.unionByName(rows) if dealt else found

    def stats(self) -> DataFrame:
        return self.spark.createDataFrame([(self.n_docs, self.total_len)], "n_docs long, total_len long")

    def searchable(self) -> search.Index:
        return search.Index(self.postings(), self.stats(), self.terms())

    # -- changes

    def changed(self, texts: DataFrame | None, removed: DataFrame | None = None) -> TextIndex:
        """The index after documents were added or replaced (``texts``) and removed (their keys).

        Texts have entity_type, sub_type, entity_id, name, description and, if they belong to a
        repository, owner. A key that occurs in both is replaced.
        """
        spark, seg, commit = self.spark, max([s.seg for s in self.segments], default=0) + 1, uuid.uuid4().hex
        docs = spark.createDataFrame([], DOC_SCHEMA)
        if texts is not None:
            texts = digested(texts if "owner" in texts.columns else texts.withColumn("owner", F.lit(None).cast("long")))
            own = search.fts_docs(texts, "owner", "digest")
            self._write("docs", own, seg, commit)
            docs = self._read("docs", DOC_SCHEMA, (Segment(seg, commit, 1, 0),))
        keys = docs.select(*KEY)
        keys = (keys if removed is None else keys.unionByName(removed.select(*KEY))).distinct()
        live = self._live(self._read("docs", DOC_SCHEMA, tuple(s for s in self.segments if s.docs)))
        dead = live.join(keys, KEY, "left_semi").select(*KEY, "dl", F.col("seg").alias("home"), "sub_type", "name_tokens", "desc_tokens")
        gone, gone_len, removed_terms = 0, 0, None
        if self.segments:
            self._write("removed", dead, seg, commit)
            stones = self._read("removed", f"{REMOVED_SCHEMA}, dl int, home int, sub_type string, name_tokens array<string>, desc_tokens array<string>", (Segment(seg, commit, 0, 1),))
            gone, gone_len = stones.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            held = stones.select("home", "dl", F.explode(F.array_distinct(F.concat("name_tokens", "desc_tokens"))).alias("term")).withColumn("zone", search.zone())
            removed_terms = held.groupBy("term", "zone", "home").agg((-F.count(F.lit(1))).alias("n")) if gone else None
        added, added_len = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not added and not gone:
            return self
        last = Segment(seg, commit, added, gone, bool(added) and self._postings(docs, seg, commit, added_len))
        self._counts(last, removed_terms)
        return replace(self, segments=(*self.segments, last), n_docs=self.n_docs + added - gone, total_len=self.total_len + added_len - gone_len)

    def _write(self, kind: str, rows: DataFrame, seg: int, commit: str) -> None:
        with swept(self.spark):
            rows.write.mode("overwrite").option("compression", CODEC).parquet(f"{self.root}/{kind}/seg={seg}/commit={commit}")

    def _postings(self, docs: DataFrame, seg: int, commit: str, total_len: int) -> bool:
        """Writes the postings of a segment's documents; whether in runs."""
        # documents are told apart by key and length; only where these repeat do postings meet
        key = ["entity_type", "sub_type", "entity_id", "dl"]
        again = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        repeated = not again.isEmpty()
        if total_len > DEALT_TOKENS:
            rows = search.runs(docs)
            if repeated:
                same = again.select(*[F.col(k).alias(f"again_{k}") for k in key])
                on = [F.col(k).eqNullSafe(F.col(f"again_{k}")) for k in key]
                some = search.dealt_by(search.gathered(search.placed(docs.join(same, on, "left_semi"))))
                rows = search.runs(docs.join(same, on, "left_anti")).unionByName(some.select(*rows.columns).sortWithinPartitions("term", "zone"))
            self._write("runs", rows, seg, commit)
            return True
        rows = search.placed(docs)
        rows = search.gathered(rows) if repeated else rows
        # prefixes and zone follow from the row, so they are added after the rows have moved
        dealt = search.dealt_by(rows.repartition(F.substring("term", 1, 2))).sortWithinPartitions("p2", "zone", "term")
        with swept(self.spark):
            dealt.write.mode("overwrite").option("compression", CODEC).option("partitionOverwriteMode", "static").partitionBy("p2").parquet(f"{self.root}/postings/seg={seg}/commit={commit}")
        return False

    def _counts(self, segment: Segment, removed: DataFrame | None) -> None:
        """Writes the counts of a segment's terms, with those that its tombstones take away."""
        own = self._all_postings((segment,) if segment.docs else ())
        rows = search.term_counts(own).withColumn("home", F.lit(None).cast("int"))
        if removed is not None:
            rows = rows.unionByName(removed, allowMissingColumns=True)
        if segment.runs:  # as they are counted, for bounds of pages tell where a term is here too
            self._write("counts", rows.sortWithinPartitions("term"), segment.seg, segment.commit)
            return
        rows = rows.withColumn("p2", F.substring("term", 1, 2))
        with swept(self.spark):
            rows.repartition("p2").sortWithinPartitions("p2", "term").write.mode("overwrite").option("compression", CODEC).option("partitionOverwriteMode", "static").partitionBy("p2").parquet(f"{self.root}/terms/seg={segment.seg}/commit={segment.commit}")

    def merged(self, every: bool = False) -> TextIndex:
        """The same documents in fewer segments: all from the first one on that is less than twice as large as those after it, or all."""
        sizes = [s.docs + s.removed for s in self.segments]
        first = next((k for k in range(len(sizes) - 1) if every or sizes[k] < 2 * sum(sizes[k + 1 :])), None)
        if first is None:
            return self
        old, some = self.segments[:first], self.segments[first:]
        seg, commit = some[-1].seg + 1, uuid.uuid4().hex
        part = replace(self, segments=some)
        self._write("docs", part.docs(), seg, commit)
        docs = self._read("docs", DOC_SCHEMA, (Segment(seg, commit, 1, 0),))
        (count, total), gone = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first(), 0
        inside = bool(count) and self._postings(docs, seg, commit, total)
        removed_terms = None
        if old and (stones := part._tombstones()) is not None:
            self._write("removed", stones.select(*KEY), seg, commit)
            gone = self._read("removed", REMOVED_SCHEMA, (Segment(seg, commit, 0, 1),)).count()
            # documents of the merged segments have left with their counts, those of older ones have not
            removed_terms = part._all_terms(some).filter(F.col("home") < some[0].seg).groupBy("term", "zone", "home").agg(F.sum("n").alias("n"))
        if count or gone:
            self._counts(Segment(seg, commit, count, gone, inside), removed_terms)
        return replace(self, segments=(*old, *([Segment(seg, commit, count, gone, inside)] if count or gone else [])))

    def differences(self, texts: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(texts to write, keys to remove) that make the documents of these owners (owner) equal to ``texts``; equal ones are in neither."""
        live = self.docs().join(owners, "owner", "left_semi").select(*KEY, "digest")
        new = digested(texts).join(live, [*KEY, "digest"], "left_anti").drop("digest")
        return new, live.join(texts.select(*KEY), KEY, "left_anti").select(*KEY)

    def discard_unused(self, used: list[TextIndex]) -> None:
        """Deletes the files of segments that none of these indexes has."""
        kept = {s.commit for index in used for s in index.segments}
        for path in folders.matching(self.spark, f"{self.root}/*/seg=*/commit=*"):
            if path.rsplit("commit=", 1)[-1] not in kept:
                folders.delete(self.spark, path)


def built(spark: SparkSession, root: str, texts: DataFrame) -> TextIndex:
    """A new index of these texts, in one segment."""
    return TextIndex(spark, root).changed(texts)
