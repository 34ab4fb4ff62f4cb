"""Ranked lexical search over a clustered index (operator 12).

Documents are reordered by recursive graph bisection, which puts documents with
common terms side by side. The bisection is fitted on a bounded sample
(``SAMPLE`` documents, ``VOCABULARY`` terms, ``DEPTH`` levels): at every level the
two halves exchange the documents whose exchange lowers the cost of the terms'
gaps, until none does. Its halves give each term a weight at each node, and every
document of the corpus descends by the weights of its terms to a cluster. A
cluster is cut into shards of about ``POSTINGS`` postings, and a shard numbers its
documents in the order of doc_id.

The index has one row for each term of a shard: its documents as numbers of the
shard, their parts of the score, and the greatest of these. What a shard can give
to an item at most is a sum of greatest parts; an item visits its shards in the
order of these bounds and stops exactly, when no bound left reaches the score of
its last hit. Visits go in rounds that grow fourfold, all items at once. Scores of
a shard are sums of arrays, and only its best documents leave the task.

Defined cases: a null text, of a document or an item, has no terms; a document
without terms counts for nothing; documents without a doc_id come last among equal
scores; rows that repeat a doc_id or an item are rows of their own; an item without
hits has no rows; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import releasing, shared_dir, sliced, written
from quarry.llm.pieces import Codes
from quarry.session import cut

TOP = 20
#: Bounds of the fit: documents, terms, levels; rounds of exchanges at a node, documents of a leaf at least.
SAMPLE, VOCABULARY, DEPTH, EXCHANGES, LEAF = 4096, 16_384, 6, 20, 32
#: Postings and documents of a shard, about; items scored together; growth of the rounds.
POSTINGS, SHARD_DOCS, TOGETHER, GROWTH = 1_000_000, 30_000, 256, 4
#: Fixed values of the score.
SCALE, GAIN, K, B = 1000, 1_000_000_000, 12, 25

#: Characters of terms, and the same for bytes: all others are blanks, capitals of ASCII are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CAPITALS = "".join(map(chr, range(65, 91)))
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """All terms of a text in UTF-8, in order."""
    return data.translate(_BYTES).split()


# --- clusters -------------------------------------------------------------------------------------------------


def _cost(n: float, degree: np.ndarray) -> np.ndarray:
    """Bits of the gaps of terms that ``degree`` of ``n`` documents hold."""
    return degree * np.log2(n / (degree + 1))


class Bisection:
    """Recursive graph bisection of documents given as arrays of term numbers."""

    def __init__(self, docs: list[np.ndarray], terms: int, depth: int):
        self.docs, self.terms = docs, terms
        while depth and len(docs) < LEAF << depth:
            depth -= 1
        self.depth = depth
        self.weights = np.zeros((terms, max(1, (1 << depth) - 1)), np.float32)
        self.leaf = np.zeros(len(docs), np.int64)
        self._split(np.arange(len(docs)), 0, 0)

    def _flat(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [self.docs[k] for k in which]
        return np.concatenate([*own, np.zeros(0, np.int64)]), np.repeat(np.arange(len(own)), [len(d) for d in own])

    def _split(self, which: np.ndarray, node: int, level: int) -> None:
        if level == self.depth:
            self.leaf[which] = node - ((1 << self.depth) - 1)
            return
        flat, owner = self._flat(which)
        right = np.arange(len(which)) >= len(which) // 2
        n1, n2 = max(1, int((~right).sum())), max(1, int(right.sum()))
        for _ in range(EXCHANGES):
            d1, d2 = (np.bincount(flat[side[owner]], minlength=self.terms).astype(float) for side in (~right, right))
            now = _cost(n1, d1) + _cost(n2, d2)
            over = now - _cost(n1, np.maximum(d1 - 1, 0)) - _cost(n2, d2 + 1)
            back = now - _cost(n1, d1 + 1) - _cost(n2, np.maximum(d2 - 1, 0))
            gain = np.bincount(owner, np.where(right[owner], back[flat], over[flat]), minlength=len(which))
            a, b = np.flatnonzero(~right), np.flatnonzero(right)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            k = int((gain[a[: len(b)]] + gain[b[: len(a)]] > 0).sum())  # pairs come by falling gain
            if not k:
                break
            right[a[:k]], right[b[:k]] = True, False
        d1, d2 = (np.bincount(flat[side[owner]], minlength=self.terms).astype(float) for side in (~right, right))
        # what one more document with the term costs on the left, less what it costs on the right
        self.weights[:, node] = (_cost(n1, d1 + 1) - _cost(n1, d1)) - (_cost(n2, d2 + 1) - _cost(n2, d2))
        self._split(which[~right], 2 * node + 1, level + 1)
        self._split(which[right], 2 * node + 2, level + 1)


class Clusters:
    """The fitted bisection: terms, weights by term and node, levels."""

    def __init__(self, terms: list[bytes], weights: np.ndarray, depth: int):
        self.number, self.weights, self.depth = {t: k for k, t in enumerate(terms)}, weights, depth

    def leaf(self, terms) -> int:
        """The cluster of a document of these distinct terms."""
        known = [k for k in map(self.number.get, terms) if k is not None]
        if not known or not self.depth:
            return 0
        total = self.weights[known].sum(axis=0)
        node = 0
        for _ in range(self.depth):
            node = 2 * node + (2 if total[node] > 0 else 1)
        return node - ((1 << self.depth) - 1)


def fitted(docs: DataFrame, sample: int = SAMPLE, depth: int = DEPTH) -> tuple[list[bytes], np.ndarray, int]:
    """(terms, weights, levels) of a bisection of about ``sample`` documents, drawn by a hash and fitted in one task.

    At most 2 ** DEPTH * VOCABULARY weights (4 MB) reach the driver.
    """
    every = max(1, docs.count() // sample)
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).limit(2 * sample)

    def fit(batches):
        held = [sorted(set(terms_of(t.encode()))) for batch in batches for t in batch.column(0).to_pylist() if t]
        held = [d for d in held if d]
        df = Counter(t for d in held for t in d)
        known = sorted((t for t, n in df.items() if 1 < n <= max(2, len(held) // 2)), key=lambda t: (-df[t], t))[:VOCABULARY]
        number = {t: k for k, t in enumerate(known)}
        made = Bisection([np.array([number[t] for t in d if t in number], np.int64) for d in held], len(known), depth)
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(known)], pa.binary()), pa.array([made.weights.tobytes()], pa.binary()), pa.array([made.depth], pa.int32())], names=["terms", "weights", "depth"])

    row = drawn.select("text").repartition(1).mapInArrow(releasing(fit), "terms binary, weights binary, depth int").first()
    if row is None:
        return [], np.zeros((0, 1), np.float32), 0
    known = bytes(row["terms"]).split(b" ") if row["terms"] else []
    return known, np.frombuffer(bytes(row["weights"]), np.float32).reshape(len(known), max(1, (1 << row["depth"]) - 1)), row["depth"]


# --- the index ------------------------------------------------------------------------------------------------


def _counted(docs: DataFrame, model: tuple) -> DataFrame:
    """(row, doc_id, n, leaf, terms, tf) of documents with terms: their number, cluster, distinct terms and counts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark import TaskContext

        clusters, row = Clusters(*sent.value), TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            out = {k: [] for k in ("row", "doc_id", "n", "leaf", "terms", "tf")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(text.encode()) if text else []
                if found:
                    counts = Counter(found)
                    for name, value in zip(out, (row, doc_id, len(found), clusters.leaf(counts), b" ".join(counts), np.fromiter(counts.values(), "<u4", len(counts)).tobytes())):
                        out[name].append(value)
                    row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return docs.mapInArrow(releasing(run), "row long, doc_id long, n long, leaf int, terms binary, tf binary")


def _shard_rows(doc_ids: list, ns: list[int], terms: list[bytes], tfs: list[bytes], n_docs: int, total: int) -> Iterator[dict]:
    """A shard's rows (term, df, best, docs, parts): first, with the empty term, the doc_ids, then its terms."""
    count = len(doc_ids)
    ids = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    yield {"term": pa.array([""]), "df": pa.array([count], pa.int32()), "best": pa.array([0], pa.int64()), "docs": pa.array([ids], pa.binary()), "parts": pa.array([b""], pa.binary())}
    codes, code, sizes = Codes(), [], []
    for t in terms:
        own = t.split(b" ")
        code.extend(map(codes.__getitem__, own))
        sizes.append(len(own))
    code = np.array(code, np.int64)
    place = np.repeat(np.arange(count, dtype=np.uint32), sizes)
    tf = np.frombuffer(b"".join(tfs), "<u4").astype(np.int64)
    m = np.repeat(np.array([100 - B + (B * n * n_docs) // total for n in ns], np.int64), sizes)
    part = (GAIN * tf) // (1000 * tf + K * m)
    order = np.argsort(code, kind="stable")
    place, part = place[order], part[order].astype(np.uint32)
    df = np.bincount(code, minlength=len(codes))
    ends = np.cumsum(df)
    best = np.maximum.reduceat(part, ends - df).astype(np.int64)
    names = list(codes)
    for at in range(0, len(names), 1 << 16):
        upto = min(len(names), at + (1 << 16))
        lo, hi = int(ends[at] - df[at]), int(ends[upto - 1])
        offsets = pa.py_buffer((4 * (np.append(ends[at] - df[at], ends[at:upto]) - lo)).astype(np.int32).tobytes())
        blob = lambda values: pa.Array.from_buffers(pa.binary(), upto - at, [None, offsets, pa.py_buffer(values[lo:hi].astype("<u4").tobytes())])  # noqa: B023, E731
        yield {"term": pa.array(names[at:upto], pa.binary()).cast(pa.string()), "df": pa.array(df[at:upto], pa.int32()), "best": pa.array(best[at:upto]), "docs": blob(place), "parts": blob(part)}


def build(docs: DataFrame, folder: str | None = None) -> str:
    """Writes the index of all documents and returns its folder: ``corpus`` (n_docs, total) and ``terms``, partitioned by cluster."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = written(_counted(rows, fitted(rows)), "lexical-documents")
    leaves = {r["leaf"]: r for r in counted.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.sum(F.length("tf") / 4).alias("postings")).collect()}
    n_docs, total = sum(r["docs"] for r in leaves.values()), sum(r["n"] for r in leaves.values())
    spark.createDataFrame([(n_docs, total)], "n_docs long, total long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/corpus")
    shards = [int(max(1, -(-leaves[k]["postings"] // POSTINGS), -(-leaves[k]["docs"] // SHARD_DOCS))) if k in leaves else 0 for k in range(1 << DEPTH)]
    first = np.cumsum(shards) - shards
    at = lambda values: F.element_at(F.lit([int(v) for v in values]).cast("array<long>"), F.col("leaf") + 1)
    dealt = counted.withColumn("shard", at(first) + F.pmod(F.xxhash64("row"), F.greatest(at(shards), F.lit(1))))
    dealt = dealt.repartition(max(1, sum(shards)), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "row")

    def run(batches):
        now, held = None, ([], [], [], [])

        def made():
            for columns in _shard_rows(*held, n_docs, total):
                n = len(columns["term"])
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.int32()), pa.array([now[1]] * n, pa.int64()), *columns.values()], names=["leaf", "shard", *columns])

        for batch in sliced(batches, rows=4096):
            for leaf, shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (leaf, shard) != now:
                    if now is not None:
                        yield from made()
                    now, held = (leaf, shard), ([], [], [], [])
                for column, value in zip(held, row):
                    column.append(value)
        if now is not None:
            yield from made()

    schema = "leaf int, shard long, term string, df int, best long, docs binary, parts binary"
    dealt.select("leaf", "shard", "doc_id", "n", "terms", "tf").mapInArrow(releasing(run), schema).write.mode("overwrite").option("compression", "zstd").partitionBy("leaf").parquet(f"{folder}/terms")
    return folder


# --- search ---------------------------------------------------------------------------------------------------


def _best(rows: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "at")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _scored(visits: DataFrame, lists: DataFrame, terms: DataFrame, blocks: int, top: int) -> DataFrame:
    """(item, doc_id, at, score): the best ``top`` documents of each visited shard for each item that visits it.

    The visited shards' rows of asked terms go once to the tasks that score a block of items, and
    what the items ask goes there beside them, so the index itself is never shuffled for a join.
    """
    visits = visits.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    asked = visits.join(lists, "item").groupBy("shard", "block", "term").agg(F.collect_list(F.struct("item", "weight")).alias("items"))
    asked = asked.withColumns({"docs": F.lit(None).cast("binary"), "parts": F.lit(None).cast("binary")})
    wanted = lists.select("term").unionByName(lists.select(F.lit("").alias("term"))).distinct()  # the empty term has a shard's documents
    rows = terms.select("shard", "term", "docs", "parts").join(wanted, "term", "left_semi").join(visits.select("shard", "block").distinct(), "shard")
    rows = rows.withColumn("items", F.lit(None).cast(asked.schema["items"].dataType)).select(*asked.columns)
    dealt = rows.unionByName(asked).repartition("shard", "block").sortWithinPartitions("shard", "block", "term", F.col("items").isNull())

    def run(batches):
        now, ids, null, items, scores, asks = None, None, None, {}, [], (None, None)

        def found():
            for item, k in items.items():
                at = np.flatnonzero(s := scores[k])
                if len(at) > top:
                    at = at[s[at] >= np.partition(s[at], -top)[-top]]
                at = at[np.argsort(-s[at], kind="stable")[:top]]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), item)), pa.array(ids[at], mask=null[at]), pa.array((now[0] << 32) + at), pa.array(s[at])], names=["item", "doc_id", "at", "score"])

        for batch in batches:
            for shard, block, term, own, docs, parts in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, block) != now:
                    yield from found()
                    now, items, scores = (shard, block), {}, []
                if own is not None:
                    asks = (term, own)
                elif not term:
                    n = len(docs) // 9
                    ids, null = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, np.bool_, n, 8 * n)
                elif term == asks[0]:
                    place, part = np.frombuffer(docs, "<u4"), np.frombuffer(parts, "<u4").astype(np.int64)
                    for ask in asks[1]:
                        k = items.setdefault(ask["item"], len(items))
                        if k == len(scores):
                            scores.append(np.zeros(len(ids), np.int64))
                        scores[k][place] += ask["weight"] * part
                    asks = (None, None)
        yield from found()

    return dealt.mapInArrow(releasing(run), "item long, doc_id long, at long, score long")


def search(spark: SparkSession, folder: str, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's (item_id, text) ``top`` best documents of a stored index."""
    corpus = spark.read.parquet(f"{folder}/corpus").first()
    n_docs = corpus["n_docs"]
    queries = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.monotonically_increasing_id().alias("item"), F.translate(F.col("text").cast("string"), _CAPITALS, _CAPITALS.lower()).alias("text")), "lexical-items")
    asked = queries.select("item", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats"))
    schema = "leaf int, shard long, term string, df int, best long, docs binary, parts binary"
    terms = spark.read.schema(schema).parquet(f"{folder}/terms") if n_docs else spark.createDataFrame([], schema)
    asked = written(asked, "lexical-asked")
    hits = written(terms.select("leaf", "shard", "term", "df", "best").join(asked.select("term").distinct(), "term"), "lexical-hits")
    weight = F.floor(F.lit(float(SCALE)) * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    weights = hits.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.cast("long").alias("w"))
    lists = written(asked.join(weights, "term").select("item", "term", (F.col("repeats") * F.col("w")).alias("weight")).filter("weight > 0"), "lexical-lists")
    bounds = hits.join(lists, "term").groupBy("item", "leaf", "shard").agg(F.sum(F.col("weight") * F.col("best")).alias("bound"))
    place = F.row_number().over(W.partitionBy("item").orderBy(F.col("bound").desc(), "shard"))
    bounds = written(bounds.filter("bound > 0").withColumn("place", place), "lexical-bounds")
    last = bounds.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    blocks = max(1, -(-queries.count() // TOGETHER))

    best = spark.createDataFrame([], "item long, doc_id long, at long, score long, rank int")
    done, upto = 0, 1
    while done < last:
        enough = best.filter(F.col("rank") == top).select("item", F.col("score").alias("least"))
        visits = bounds.filter((F.col("place") > done) & (F.col("place") <= upto)).join(enough, "item", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        visits = cut(visits.select("item", "leaf", "shard"))
        leaves = [r["leaf"] for r in visits.select("leaf").distinct().collect()]  # at most 2 ** DEPTH
        if not leaves:  # bounds fall: no item has a shard left that could change its hits
            break
        found = _scored(visits, lists, terms.filter(F.col("leaf").isin(leaves)), blocks, top)
        best = cut(_best(best.drop("rank").unionByName(found), top))
        done, upto = upto, upto + (upto - done) * GROWTH
    return best.join(queries.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents for every item, from an index that is built for it."""
    return search(docs.sparkSession, build(docs), items, top)


def sql(top: int = TOP) -> str:
    """The same in DuckDB."""
    words = f"unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '{TERM}'))"
    return rf"""WITH words AS (SELECT doc_id, {words} AS term FROM documents),
tfs AS MATERIALIZED (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term), corpus),
asked AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM (SELECT item_id, {words} AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {top}"""


__all__ = ["Bisection", "Clusters", "build", "fitted", "ranked", "search", "sql", "terms_of"]
