"""MinHash near-deduplication (operator 9).

1. One pass over the texts gives each document the size of its shingle set, a
   key of the whole set, ``BANDS * ROWS`` minima of universal hashes and the
   keys of its bands. Documents with one set key form a class; only the class's
   least doc_id goes on, so groups of copies of any size cost one row.
2. Classes that share a band are candidates. Every bucket is first compared as
   a star, each member with one representative drawn by a hash of its own, so
   a bucket of m members makes m - 1 pairs. Signatures reject the clear misses,
   and the rest are confirmed on the full shingle sets.
3. Confirmed links are joined by large-star and small-star. A bucket whose
   members lie in several components may still hide a link between two members
   that are not its representative: such buckets are compared in cells of one or
   two blocks of about ``BLOCK`` members, those outside the representative's
   component with each other and with those inside it. Within a cell, pairs across components
   that signatures do not rule out are confirmed on the full sets, likeliest
   first, and a pair whose components meanwhile met is skipped; a cell states
   only the links that join components, fewer than it has members. So no link
   between different components is left out, in buckets of any size, and no list
   of pairs is ever made.

With 32 bands of 5 rows a pair at similarity 0.8 shares no band with
probability (1 - 0.8^5)^32 = 3e-6 if its minima agree independently.

Defined cases: a text that is null, empty or without words has an empty set and
is linked with nothing; a document with fewer words than a shingle has its whole
sequence as one shingle; rows without a doc_id, and different texts of a repeated
one, are documents of their own, and all rows are then numbered first; a component
is named by its least doc_id, one without any by null, and keeps one row; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import numbered, odd_ids, per_batch, releasing, reported, sliced, utf8, written
from quarry.llm.components import components
from quarry.llm.shingles import mix, shingle_sets

WORDS, PERCENT, BANDS, ROWS, BLOCK = 5, 80, 32, 5, 512
#: Signatures agree in a share of about J; candidates that lie below the threshold by this many deviations are dropped.
DEVIATIONS = 4.5

_rng = np.random.default_rng(5)
_A = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_B = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value over the set of each hash function: the high half of a * x + b modulo 2 ** 64, for x of 32 bits.

    With a and b uniform this multiply-shift family is pairwise independent.
    """
    x = hashes >> np.uint64(32)
    best = np.full(len(_A), 2**64 - 1, np.uint64)
    for at in range(0, len(x), 512):
        some = x[at : at + 512][None, :] * _A[:, None]
        some += _B[:, None]
        np.minimum(best, some.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, set_key, sig (one byte of each minimum) and bands of every document."""
    salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column(1), words)
        keys, sigs, bands = [], [], []
        for s in sets:
            if not len(s):
                keys.append(None), sigs.append(None), bands.append(None)
                continue
            best = minima(s)
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sigs.append(mix(best.astype(np.uint64)).astype(np.uint8).tobytes())
            rolled = salts.copy()
            for column in best.reshape(BANDS, ROWS).T:
                rolled = mix(rolled + column)
            bands.append(rolled.view(np.int64))
        return {"doc_id": batch.column(0), "n_shingles": [len(s) for s in sets], "set_key": keys, "sig": sigs, "bands": bands}

    schema = "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(per_batch(run, schema, 512), schema)


def likely(sig_a: np.ndarray, sig_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures (rows of bytes) may belong to sets of that similarity."""
    return (sig_a == sig_b).sum(axis=-1) >= _least_agreement(sig_a.shape[-1], percent)


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, by intersection and union counts."""
    common = len(np.intersect1d(s, t, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(s) + len(t) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity; ``texts`` has doc_id and text."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        for batch in sliced(batches, 128):
            sides = []
            for k in (2, 3):
                coded = batch.column(k).dictionary_encode()
                sets = shingle_sets(coded.dictionary, words)
                sides.append([sets[i] for i in coded.indices.to_pylist()])
            ok = pa.array([similar(s, t, percent) for s, t in zip(*sides)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return both.select("a", "b", _bytes("text_a"), _bytes("text_b")).mapInArrow(releasing(run), "a long, b long")


def _bytes(name: str):
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def _screened(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs that set sizes and signatures do not rule out."""
    side = lambda k: known.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches):
        for batch in sliced(batches, 4096, 8):
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            ok = pa.array(likely(left, right, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(releasing(run), "a long, b long")


def joined_in_cell(cell: list[tuple], words: int, percent: int) -> list[tuple[int, int]]:
    """Links that join components within a cell of rows (side, doc_id, component, n_shingles, sig, text).

    Side 0 is compared with side 1, or with itself where the cell has one side.
    """
    second = [k for k, r in enumerate(cell) if r[0] == 1] or list(range(len(cell)))
    first = [k for k, r in enumerate(cell) if r[0] == 0]
    sig = np.frombuffer(b"".join(r[4] for r in cell), np.uint8).reshape(len(cell), -1)
    comp, size = np.array([r[2] for r in cell]), np.array([r[3] for r in cell])
    at = np.array(second, np.int64)
    found = []
    for k in first:
        may = at[(comp[at] != comp[k]) & (100 * np.minimum(size[at], size[k]) >= percent * np.maximum(size[at], size[k]))]
        if len(may):
            agree = (sig[may] == sig[k]).sum(axis=1)
            ok = agree >= _least_agreement(sig.shape[1], percent)
            found += zip((-agree[ok]).tolist(), [k] * int(ok.sum()), may[ok].tolist())
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    out: list[tuple[int, int]] = []
    if not found:
        return out
    involved = sorted({k for _, i, j in found for k in (i, j)})
    sets = dict(zip(involved, shingle_sets(pa.array([cell[k][5] for k in involved], pa.binary()), words)))
    for _, i, j in sorted(found):
        x, y = find(int(comp[i])), find(int(comp[j]))
        if x != y and similar(sets[i], sets[j], percent):
            root[max(x, y)] = min(x, y)
            out.append((cell[i][1], cell[j][1]))
    return out


def _least_agreement(k: int, percent: int) -> float:
    j = percent / 100
    return k * j - DEVIATIONS * (k * j * (1 - j)) ** 0.5


def _across(cells: DataFrame, words: int, percent: int) -> DataFrame:
    """The joining links of cells, whose rows (cell, side, doc_id, component, n_shingles, sig, text) come sorted by cell."""

    def run(batches):
        held, last = [], None
        for batch in sliced(batches, 512):
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != last:
                    out += joined_in_cell(held, words, percent)
                    held = []
                last = row[0]
                held.append(row[1:])
            yield _pairs(out)
        if held:
            yield _pairs(joined_in_cell(held, words, percent))

    return cells.mapInArrow(releasing(run), "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(r) for r in rows], pa.int64()), pa.array([max(r) for r in rows], pa.int64())], names=["a", "b"])


def links(docs: DataFrame, known: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the documents that are linked, directly or by way of others; and the classes."""
    spark = docs.sparkSession
    classes = known.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    reps = written(known.select("doc_id", "n_shingles", "set_key", "sig", "bands").join(classes, ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key"]), "minhash-classes")
    members = reps.select("doc_id", F.explode("bands").alias("bucket"))
    pick = F.struct(F.xxhash64("bucket", "doc_id").alias("draw"), F.col("doc_id").alias("rep"))
    buckets = members.groupBy("bucket").agg(F.min(pick).alias("pick"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("bucket", "pick.rep", "m")
    grouped = written(members.join(buckets, "bucket"), "minhash-buckets")
    stars = grouped.filter("doc_id <> rep").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).distinct()
    # the texts of documents that share any bucket: read once, used twice
    texts = written(docs.select("doc_id", "text").join(grouped.select("doc_id").distinct(), "doc_id"), "minhash-texts")
    sure = written(confirmed(_screened(stars, reps, percent), texts, words, percent), "minhash-links")
    found = written(components(sure), "minhash-components")
    # buckets of three or more members, some of which are not in the component of their representative
    labelled = grouped.filter("m > 2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    main = labelled.filter("doc_id = rep").select("bucket", F.col("component").alias("main"))
    placed = labelled.join(main, "bucket").withColumn("out", F.col("component") != F.col("main"))
    counts = placed.groupBy("bucket").agg(F.sum(F.col("out").cast("int")).alias("k")).filter("k > 0")
    size = lambda n: F.ceil(n / BLOCK).cast("int")
    cells = placed.join(counts, "bucket").withColumn("outer", size(F.col("k"))).withColumn("inner", size(F.col("m") - F.col("k")))
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))).cast("int")
    cells = cells.withColumn("own", own)
    # outer blocks meet each other and every inner block; inner blocks, one component each, never meet
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    outers, inners = F.sequence(F.lit(0), F.col("outer") - 1), F.sequence(F.lit(0), F.col("inner") - 1)
    mine = F.when(
        F.col("out"),
        F.concat(F.transform(outers, lambda j: cell("o", F.least("own", j), F.greatest("own", j), F.col("own") > j)), F.transform(inners, lambda j: cell("m", F.col("own"), j, F.lit(False)))),
    ).otherwise(F.transform(outers, lambda i: cell("m", i, F.col("own"), F.lit(True))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        cells.select("bucket", "doc_id", "component", F.explode(mine).alias("c"))
        .select(F.xxhash64("bucket", "c.kind", "c.i", "c.j").alias("cell"), "c.side", "doc_id", "component")
        .join(reps.select("doc_id", "n_shingles", "sig"), "doc_id")
        .join(texts, "doc_id")
        .select("cell", "side", "doc_id", "component", "n_shingles", "sig", _bytes("text"))
    )
    extra = written(_across(dealt.repartition(n, "cell").sortWithinPartitions("cell"), words, percent).distinct(), "minhash-more")
    if extra.isEmpty():
        return found, classes
    edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(extra)
    return written(components(edges), "minhash-components"), classes


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Rows without a doc_id, and different texts of a repeated one, are documents of their own and
    link others. A component is named by its least doc_id; one without any has none, and keeps one row.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if not odd_ids(rows):
        return _deduplicated(rows, words, percent)
    own = numbered(rows.select("doc_id", utf8(F.col("text")).alias("data"), F.col("doc_id").alias("id")))
    found = _deduplicated(own.select(F.col("doc").alias("doc_id"), F.col("data").cast("string").alias("text")), words, percent)
    return reported(found, own.select(F.col("doc").alias("doc_id"), "id"), "doc_id")


def _deduplicated(rows: DataFrame, words: int, percent: int) -> DataFrame:
    known = written(signatures(rows, words), "minhash-signatures")
    found, classes = links(rows, known, words, percent)
    named = classes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return known.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the one of the least doc_id.

    Rows without a doc_id and rows that repeat one are documents of their own here: all rows are
    numbered by doc_id (null first) and text, so copies among them go and different texts stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text").cast("string")).alias("data"), row.alias("row")), each=True)
    found = _deduplicated(rows.select(F.col("doc").alias("doc_id"), F.col("data").cast("string").alias("text")), words, percent)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("doc"))
    return rows.join(gone, "doc", "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def sql(words: int = WORDS, percent: int = PERCENT) -> str:
    """The same in DuckDB's SQL, by counting common shingles of all pairs."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {words - 1}], ' ') for i in range(1, len(w) - {words - 2})]) END AS s FROM worded),
rows_ AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows_ a JOIN rows_ b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS r FROM documents UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON reach.r = both_.a),
least_ AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least_ l ON s.doc_id = l.node"""
