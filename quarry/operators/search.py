"""Full-text index and ranked retrieval.

Documents have two token lists. The index is one row per (term, document) with
its count; a query's terms select rows by equality or prefix, so with postings
partitioned by term only the terms' files are read. Scores are BM25 over both
lists with equal weight; smaller is better.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import like, tokens, words
from quarry.operators.entities import CARD, entity_cards
from quarry.schema import COARSE_TYPES, Model
from quarry.session import cut

K1, B, LEAST_IDF, ENOUGH = 1.2, 0.75, 1e-6, 3
#: Zones for each doubling of a document's length; growth of the rounds in which zones are read.
ZONES, GROWTH = 4, 4
#: What to ask next about a hit of each type.
NEXT_ACTION = {"field": "kb_field_impact", "repo": "kb_explain", "module": "kb_entity", "event": "kb_entity", "service": "kb_entity", "learned_fact": "kb_search"}
DOC = ("entity_type", "sub_type", "entity_id", "name", "description")


def index_texts(model: Model, fact_text: str = "repo") -> DataFrame:
    """(entity_type, sub_type, entity_id, owner, name, description): the texts that are indexed for every entity, and its repository.

    Parts of a description that are null are left out. ``fact_text`` says what a fact is found
    by besides its content: its repository (as a full rebuild does) or its content again (as
    adding one fact does).
    """
    repo = model.repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
    text = lambda *parts: F.concat_ws(" ", *parts)
    doc = lambda df, kind, sub, name, description: df.select(F.lit(kind).alias("entity_type"), F.coalesce(sub, F.lit(kind)).alias("sub_type"), F.col("id").alias("entity_id"), (F.col("repo_id") if "repo_id" in df.columns else F.lit(None).cast("long") if kind == "learned_fact" else F.col("id")).alias("owner"), F.col(name).alias("name"), description.alias("description"))
    event = F.when(F.col("parent_type") == "proto_message", F.concat(F.lit("event:"), F.col("parent_name")))
    return reduce(
        DataFrame.unionByName,
        [
            doc(model.repos, "repo", F.lit("repo"), "name", F.col("description")),
            doc(model.modules.join(repo, "repo_id"), "module", F.col("type"), "name", text("repo", "summary", F.concat(F.lit("table:"), "table_name"))),
            doc(model.events.join(repo, "repo_id"), "event", F.lit("event"), "name", text("repo", "schema_definition")),
            doc(model.services.join(repo, "repo_id"), "service", F.col("service_type"), "name", text("repo", "description")),
            doc(model.fields.join(repo, "repo_id"), "field", F.col("parent_type"), "field_name", text("repo", "parent_name", "field_type", event)),
            doc(model.learned_facts, "learned_fact", F.lit("learned_fact"), "content", F.col("repo" if fact_text == "repo" else "content")),
        ],
    )


def fts_docs(texts: DataFrame, *more: str) -> DataFrame:
    """Texts with their token lists and length: (doc key, further columns, name_tokens, desc_tokens, dl)."""
    rows = texts.select("entity_type", "sub_type", "entity_id", *more, tokens(F.col("name")).alias("name_tokens"), tokens(F.col("description")).alias("desc_tokens"))
    return rows.withColumn("dl", F.size("name_tokens") + F.size("desc_tokens"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, entity_type, sub_type, entity_id, dl, tf, p2, p3): the inverted index; p2 and p3 are prefixes to partition by."""
    found = docs.select("entity_type", "sub_type", "entity_id", "dl", F.explode(F.concat("name_tokens", "desc_tokens")).alias("term"))
    counted = found.groupBy("term", "entity_type", "sub_type", "entity_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return counted.withColumn("p2", F.substring("term", 1, 2)).withColumn("p3", F.substring("term", 1, 3))


#: What a document says of a term; and the tokens that a task orders at a time, for itself and as a run of a stored index.
PLACED = "term string, entity_type string, sub_type string, entity_id long, dl int, tf long, places array<int>"
SORTED_AT_ONCE, RUN, SENT_AT_ONCE = 1 << 20, 1 << 21, 1 << 16


def placed(docs: DataFrame) -> DataFrame:
    """(term, entity_type, sub_type, entity_id, dl, tf, places): one row per term of each row of ``docs``, made where the document is.

    A document's terms are all in its row, so nothing is shuffled to count them. ``places`` says
    where the term stands, names first; a place is left free between the two lists.
    """
    return _placed(docs, PLACED, SORTED_AT_ONCE, False)


def runs(docs: DataFrame) -> DataFrame:
    """The same with the zone, in runs of about two million tokens, each in order of term and zone.

    Nothing is shuffled or spilled to order them, and pages of a file that is written so hold few
    terms, so their bounds say which ones a question reads.
    """
    return _placed(docs, f"{PLACED}, zone int", RUN, True)


def _placed(docs: DataFrame, ddl: str, at_once: int, by_term: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    kept = ("entity_type", "sub_type", "entity_id", "dl")
    lengths = lambda lists: pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("both")
        words = pc.dictionary_encode(pc.list_flatten(lists))
        code, size = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
        length = lengths(lists)
        doc = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
        if by_term:
            rank, zones = np.empty(size, np.int64), batch.column("zone").fill_null(-1).to_numpy(zero_copy_only=False)
            rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(size)
            by_zone = np.empty(len(length), np.int64)
            by_zone[np.argsort(zones, kind="stable")] = np.arange(len(length))
            key = np.where(code >= 0, rank[code], 0) * len(length) + by_zone[doc] if size else code
        else:
            key = doc * size + code
        real = np.flatnonzero(code >= 0)
        order = real[np.argsort(key[real], kind="stable")]
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(first, len(key))
        owner = pa.array(doc[order][first])
        term = words.dictionary.take(pa.array(code[order][first]))
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
        columns = [term, *(batch.column(c).take(owner) for c in kept), pa.array(np.diff(ends)), places]
        columns += [batch.column("zone").take(owner)] if by_term else []
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def pieces(batches):
        """Batches cut where they reach ``at_once`` tokens."""
        for batch in batches:
            many = np.cumsum(lengths(batch.column("both")))
            at = 0
            while at < batch.num_rows:
                upto = int(np.searchsorted(many, (many[at - 1] if at else 0) + at_once, side="right"))
                upto = max(upto, at + 1)
                yield batch.slice(at, upto - at)
                at = upto

    def gathered_up(batches):
        """Small ones of ``pieces`` as one, up to ``at_once`` tokens."""
        some, have = [], 0
        for piece in pieces(batches):
            n = int(lengths(piece.column("both")).sum())
            if some and have + n > at_once:
                yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
                some, have = [], 0
            some.append(piece)
            have += n
        if some:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]

    def run(batches):
        for batch in gathered_up(b for b in batches if b.num_rows) if by_term else pieces(batches):
            made = part(batch)
            for at in range(0, made.num_rows, SENT_AT_ONCE):
                yield made.slice(at, SENT_AT_ONCE)

    both = F.concat("name_tokens", F.array(F.lit(None).cast("string")), "desc_tokens")
    return docs.select(*kept, *([zone().alias("zone")] if by_term else []), both.alias("both")).mapInArrow(run, ddl)


def gathered(rows: DataFrame) -> DataFrame:
    """The same with rows of one key and length as one: documents that repeat a key."""
    return rows.groupBy("term", "entity_type", "sub_type", "entity_id", "dl").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))


def dealt_by(rows: DataFrame) -> DataFrame:
    """With p2 and p3, prefixes to partition by, and the zone."""
    return prefixed(rows).withColumn("zone", zone())


def prefixed(rows: DataFrame) -> DataFrame:
    """With p2 and p3."""
    return rows.withColumn("p2", F.substring("term", 1, 2)).withColumn("p3", F.substring("term", 1, 3))


def positional(docs: DataFrame) -> DataFrame:
    """The postings with ``places``, and the zone."""
    return dealt_by(gathered(placed(docs)))


def zone() -> Column:
    """The class of a document's length: four classes for each doubling. All terms of a document are in its zone."""
    return F.floor(F.log2(F.col("dl")) * ZONES).cast("int")


def term_counts(postings: DataFrame) -> DataFrame:
    """(term, zone, n, most, least): documents of each zone that hold a term, their greatest count of it and least length."""
    return postings.groupBy("term", "zone").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"))


class Index(NamedTuple):
    """Postings, one row of statistics about all documents, and, where they are stored, the counts of terms by zone."""

    postings: DataFrame
    stats: DataFrame
    terms: DataFrame | None = None

    @staticmethod
    def over(docs: DataFrame) -> Index:
        """The index of documents that are not stored."""
        return Index(positional(docs), index_stats(docs))


def index_stats(docs: DataFrame) -> DataFrame:
    """(n_docs, total_len): one row about the whole index."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))


@dataclass(frozen=True)
class Query:
    """Groups of terms: a document satisfies a group if it has all its terms; ``prefix`` frees the end of each group's last term."""

    groups: tuple[tuple[str, ...], ...]
    every: bool
    prefix: bool = False

    def terms(self) -> list[tuple[int, int, str, bool]]:
        """(group, place, term, is a prefix)."""
        return [(g, k, t, self.prefix and k == len(group) - 1) for g, group in enumerate(self.groups) for k, t in enumerate(group)]


def words_of(raw: str) -> tuple[tuple[str, ...], ...]:
    """The query's words as groups of tokens; operators and signs that people type are ordinary text or nothing."""
    return tuple(g for g in map(words, raw.split()) if g)


def type_filter(wanted: str | None) -> Column:
    """Coarse types match the entity type; anything else the sub-type, ignoring case and with LIKE's wildcards."""
    if wanted is None:
        return F.lit(True)
    return F.col("entity_type") == wanted if wanted in COARSE_TYPES else like(F.col("sub_type"), F.lit(wanted))


def _near(query: Query) -> Column:
    """Postings that the query's terms can hit, as literals that prune partitions and row groups before any join."""
    ends = [t for _, _, t, p in query.terms() if p]
    near = F.col("term").isin(sorted({t for _, _, t, _ in query.terms()}))
    heads = F.col("p2").isin(sorted({t[:2] for _, _, t, _ in query.terms()}))
    for t in ends:
        near, heads = near | F.col("term").startswith(t), heads | F.col("p2").startswith(t[:2])
    return near & heads


def scored(index: DataFrame, stats: DataFrame, query: Query) -> DataFrame:
    """(entity_type, sub_type, entity_id, score) of the documents that satisfy the query; not yet filtered or cut.

    Each term of each group is a term of the sum, also where it occurs twice in the query. A
    prefix counts every word that begins with it as one term.
    """
    spark = index.sparkSession
    wanted = spark.createDataFrame(query.terms(), "g int, k int, q string, open boolean")
    hit = (F.col("term") == F.col("q")) | (F.col("open") & F.startswith("term", "q"))
    key = ["entity_type", "sub_type", "entity_id"]
    hits = index.filter(_near(query)).join(F.broadcast(wanted), hit).groupBy("g", "k", *key, "dl").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n"))
    rows = hits.join(F.broadcast(df), ["g", "k"]).crossJoin(F.broadcast(stats))
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") * F.col("n_docs") / F.col("total_len")))
    sizes = spark.createDataFrame([(g, len(group)) for g, group in enumerate(query.groups)], "g int, size int")
    per_group = rows.withColumn("s", idf * weight).groupBy("g", *key).agg(F.count(F.lit(1)).alias("have"), F.sum("s").alias("s")).join(F.broadcast(sizes), "g")
    # only satisfied groups make a hit, but every term that occurs adds to its score
    full = F.sum((F.col("have") == F.col("size")).cast("int"))
    hits = per_group.groupBy(*key).agg(full.alias("full"), F.sum("s").alias("s"))
    need = len(query.groups) if query.every else 1
    return hits.filter(F.col("full") >= need).select(*key, F.round(-F.col("s"), 6).alias("score"))


def top(rows: DataFrame, limit: int) -> DataFrame:
    """The best rows; equal scores by type and id."""
    return rows.orderBy("score", "entity_type", "entity_id").limit(limit)


def ranked(index: Index, raw: str, limit: int = 20, wanted: str | None = None) -> DataFrame:
    """All words of the query must occur; the best ``limit`` of the type."""
    groups = words_of(raw)
    if not groups:
        return _nothing(index)
    return _every(index, groups, limit, wanted)


def _every(index: Index, groups: tuple[tuple[str, ...], ...], limit: int, wanted: str | None) -> DataFrame:
    return _step(index, Query(groups, True), limit, wanted) if index.terms is None else bounded(index, groups, limit, wanted)


def bounded(index: Index, groups: tuple[tuple[str, ...], ...], limit: int, wanted: str | None = None) -> DataFrame:
    """The best ``limit`` documents that have all terms, zone by zone, the most promising first.

    What a zone can give at most follows from each term's greatest count and least length there.
    Postings of a zone are read only if that reaches the score of the last hit so far, and a zone
    that lacks a term is never read. A query has few terms and there are few zones, so the bounds
    are plain numbers.
    """
    weight = Counter(t for group in groups for t in group)
    n_docs, total_len = index.stats.first()
    found = index.terms.filter(F.col("term").isin(list(weight)) & F.col("p2").isin(sorted({t[:2] for t in weight}))).groupBy("term", "zone").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least")).collect()
    df = {t: sum(r["n"] for r in found if r["term"] == t) for t in weight}
    idf = {t: max(LEAST_IDF, math.log((n_docs - n + 0.5) / (n + 0.5))) * weight[t] for t, n in df.items()}
    part = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl * n_docs / total_len))
    at: dict[int, dict[str, float]] = {}
    for r in found:
        if r["n"] > 0:
            at.setdefault(r["zone"], {})[r["term"]] = idf[r["term"]] * part(r["most"], r["least"])
    order = sorted(((sum(v.values()), z) for z, v in at.items() if len(v) == len(weight)), key=lambda x: (-x[0], x[1]))
    key, spark = ["entity_type", "sub_type", "entity_id"], index.postings.sparkSession
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double")) if idf else None
    best, done, upto = None, 0, 2
    while done < len(order):
        least = None
        if best is not None and len(best) == limit:
            least = -best[-1]["score"]
        # scores are rounded to six places, so a bound within that of the last hit may tie with it
        zones = [z for b, z in order[done:upto] if least is None or b >= least - 1e-6]
        if not zones:  # bounds fall
            break
        near = index.postings.filter(_near(Query((tuple(weight),), True)) & F.col("zone").isin(zones)).join(weights, "term")
        tf, dl = F.col("tf"), F.col("dl")
        scores = near.groupBy(*key).agg(F.count(F.lit(1)).alias("have"), F.sum(F.col("idf") * part(tf, dl)).alias("s")).filter(F.col("have") == len(weight))
        rows = top(scores.select(*key, F.round(-F.col("s"), 6).alias("score")).filter(type_filter(wanted)), limit).collect()
        best = sorted([*(best or []), *rows], key=lambda r: (r["score"], r["entity_type"], r["entity_id"]))[:limit]
        done, upto = upto, upto * GROWTH
    schema = "entity_type string, sub_type string, entity_id long, score double"
    return spark.createDataFrame([tuple(r) for r in best or []], schema)


def _nothing(index: Index) -> DataFrame:
    return index.postings.limit(0).select("entity_type", "sub_type", "entity_id", F.lit(0.0).alias("score"))


def _step(index: Index, query: Query, limit: int, wanted: str | None) -> DataFrame:
    """The few postings that the terms hit are read once, for their counts and for the scores."""
    near = cut(index.postings.filter(_near(query)).select("term", "entity_type", "sub_type", "entity_id", "dl", "tf", "p2"))
    return top(scored(near, index.stats, query).filter(type_filter(wanted)), limit)


def relaxed(index: Index, raw: str, limit: int = 20, wanted: str | None = None) -> DataFrame:
    """All words; with fewer than three hits any word; with fewer than three again any word by prefix.

    Hits are counted after the type filter and the limit. A query of one word is never relaxed.
    Each step reads the postings of its own terms, and only if those before it found too few.
    """
    groups = words_of(raw)
    if len(groups) < 2:
        return ranked(index, raw, limit, wanted)
    steps = [Query(groups, True), Query(groups, False), Query(groups, False, True)]
    for query in steps[:-1]:
        found = cut(_every(index, groups, limit, wanted) if query.every else _step(index, query, limit, wanted))
        if found.count() >= ENOUGH:  # at most ``limit`` rows
            return found
    return _step(index, steps[-1], limit, wanted)


def phrase(index: Index, raw: str) -> DataFrame:
    """Documents in whose name or description the query's tokens stand next to each other, in order.

    Every place of the k-th token says where a phrase would begin; a document has the phrase where
    all tokens agree on a beginning. Only postings of the tokens are read.
    """
    wanted = [t for g in words_of(raw) for t in g]
    key = ["entity_type", "sub_type", "entity_id"]
    if not wanted:
        return index.postings.limit(0).select(*key)
    spark = index.postings.sparkSession
    asked = spark.createDataFrame(list(enumerate(wanted)), "k int, q string")
    near = index.postings.filter(_near(Query((tuple(wanted),), True))).select("term", *key, "places")
    begins = near.join(F.broadcast(asked), F.col("term") == F.col("q")).select(*key, "k", F.explode("places").alias("place"))
    return begins.groupBy(*key, (F.col("place") - F.col("k")).alias("begin")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select(*key).distinct()


def raw_search(docs: DataFrame, raw: str, limit: int = 20, index: Index | None = None) -> DataFrame:
    """Hits with their tokenized texts and composite type, unhydrated."""
    hits = ranked(index or Index.over(docs), raw, limit)
    rows = hits.join(docs, ["entity_type", "sub_type", "entity_id"])
    return rows.select(F.concat_ws(":", "entity_type", "sub_type").alias("entity_type"), "entity_id", F.array_join("name_tokens", " ").alias("name"), F.array_join("desc_tokens", " ").alias("description"), "score")


def next_action(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in NEXT_ACTION.items():
        out = out.when(kind == k, F.lit(v))
    return out.otherwise(F.lit("kb_entity"))


def search_text(model: Model, docs: DataFrame, raw: str, limit: int = 20, repo: str | None = None, wanted: str | None = None, index: Index | None = None) -> DataFrame:
    """Hits as they are shown. The repository filter and the drop of hits without an entity come after the limit."""
    hits = relaxed(index or Index.over(docs), raw, limit, wanted)
    rows = hits.join(entity_cards(model).drop("sub_type"), ["entity_type", "entity_id"])
    if repo is not None:
        rows = rows.filter(F.col("repo") == repo)
    return rows.select("entity_type", "sub_type", "entity_id", "name", "repo", "file_path", F.coalesce("description", "name").alias("snippet"), "score", next_action(F.col("entity_type")).alias("next_action"))


def fallback_cards(model: Model, docs: DataFrame, name: str, wanted: str | None = None, repo: str | None = None, index: Index | None = None) -> DataFrame:
    """Cards of a ranked search for a name, as a lookup falls back to; at most 20 hits, the repository filtered after."""
    hits = ranked(index or Index.over(docs), name, 20, wanted)
    rows = hits.select("entity_type", "entity_id").distinct().join(entity_cards(model), ["entity_type", "entity_id"])
    return (rows if repo is None else rows.filter(F.col("repo") == repo)).select(*CARD)


def available_types(docs: DataFrame) -> DataFrame:
    """(entity_type, sub_type, count), in order."""
    return docs.groupBy("entity_type", "sub_type").count().orderBy("entity_type", "sub_type")
