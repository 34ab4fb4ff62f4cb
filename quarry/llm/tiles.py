"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 6).

Vectors are scaled to length 1 and rotated onto principal axes, largest
variance first. Equal vectors of a label form one class. Within a label, classes
are cut into tiles of at most about ``TILE`` along the leading axes: by strips of
the first coordinate, a strip that is too full by the second, and so on for
``SPLITS`` axes, then by a hash. A tile's box holds its least and greatest
coordinate on ``BOX`` axes. Two unit vectors at cosine c are sqrt(2 - 2c) apart,
so tiles whose boxes lie further apart are never compared; this is settled on the
small table of tiles, before any vector is sent anywhere. In a pair of tiles the
product of the first ``STEP`` coordinates is accumulated for all pairs, then of
the next; what is still to come is at most the product of the two suffix norms
(Cauchy-Schwarz), and a pair is dropped as soon as sum plus bound cannot reach
the threshold. The survivors' cosine is taken from the given vectors in double
precision. A pair of tiles states how many others each class is linked with and
which classes its links join, not the links themselves, so a group of n vectors
that are all alike makes rows in proportion to n.

The rotation only steers the pruning: any orthonormal basis gives the same links.
It is fitted on at most ``SAMPLE`` vectors, for the ``LENGTHS`` commonest lengths
in that sample; vectors of other lengths keep their own axes.

Defined cases: vectors that are null, of length zero, empty, or that hold null
or non-finite components, and rows with a null label, link with nothing and stand
alone; vectors without a vec_id are vectors of their own, which link others; vectors of different lengths never link; rows that repeat
vec_id, label and vector are one vector. Different vectors of one vec_id are
vectors of one node: each row counts the vectors of other ids that its own is
linked with, and all of them are in the node's component. An empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from quarry.llm.common import numbered, releasing, reported, written
from quarry.llm.components import components

THRESHOLD, TILE, STEP, SAMPLE, LENGTHS = 0.93, 2048, 16, 20_000, 16
SPLITS, BOX = 4, 8
#: Pruning allows for so much rounding; the last word is the exact cosine.
SLACK = 1e-5


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """An orthonormal basis (columns), by decreasing variance of the sample's unit vectors."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(np.cov(unit, rowvar=False, bias=True).reshape(unit.shape[1], unit.shape[1]))
    return vectors[:, np.argsort(-values)]


def usable(name: str = "embedding"):
    """Not null, not empty, finite throughout, not all zero."""
    bad = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(name).isNotNull() & (F.size(name) > 0) & ~bad & F.exists(name, lambda x: x != 0)


def near_pairs(a: np.ndarray, b: np.ndarray, tail_a: np.ndarray, tail_b: np.ndarray, threshold: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (rotated unit vectors) whose product may reach the threshold.

    ``tail_x[:, s]`` is the norm of the coordinates from s * STEP on. ``upper``: a and b are one tile.
    """
    total = a[:, :STEP] @ b[:, :STEP].T
    alive = total + tail_a[:, 1:2] * tail_b[:, 1] >= threshold - SLACK
    if upper:
        alive &= np.arange(len(a))[:, None] < np.arange(len(b))
    i, j = np.nonzero(alive)
    some = total[i, j]
    for s in range(1, -(-a.shape[1] // STEP)):
        if not len(i):
            break
        some = some + np.einsum("ij,ij->i", a[i, s * STEP : (s + 1) * STEP], b[j, s * STEP : (s + 1) * STEP])
        keep = some + tail_a[i, s + 1] * tail_b[j, s + 1] >= threshold - SLACK
        i, j, some = i[keep], j[keep], some[keep]
    return i, j


def tails(x: np.ndarray) -> np.ndarray:
    """Suffix norms at every STEP-th coordinate, and 0 past the end."""
    squares = np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares[:, ::STEP], np.zeros((len(x), 1))], axis=1))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least of the n nodes that each node reaches by links (i, j)."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, i, least[j])
        np.minimum.at(new, j, least[i])
        new = np.minimum(new, new[new])
        if (new == least).all():
            return least
        least = new


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as rows in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cell(parts: list[pa.RecordBatch], basis: dict[int, np.ndarray], threshold: float) -> pa.RecordBatch:
    """What a pair of tiles says of its classes."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    side, k1, k2, ids, copies = (rows[c].to_numpy() for c in ("side", "k1", "k2", "class_id", "copies"))
    order = np.argsort(side, kind="stable")
    k1, k2, ids, copies = k1[order], k2[order], ids[order], copies[order]
    x = matrix(rows["embedding"].combine_chunks())[order]
    norm = np.linalg.norm(x, axis=1)
    u = (x / norm[:, None]) @ basis.get(x.shape[1], np.eye(x.shape[1]))
    n = int((side == 0).sum())
    upper = n == len(x)
    a, b = (u, u) if upper else (u[:n], u[n:])
    i, j = near_pairs(a, b, tails(a), tails(b), threshold, upper)
    j = j if upper else j + n
    ok = np.concatenate([np.einsum("ij,ij->i", x[i[at : at + PAIRS]], x[j[at : at + PAIRS]]) / (norm[i[at : at + PAIRS]] * norm[j[at : at + PAIRS]]) >= threshold for at in range(0, len(i), PAIRS)] or [np.zeros(0, bool)])
    i, j = i[ok], j[ok]
    degree = (np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))).astype(np.int64)
    linked_, least = np.flatnonzero(degree), forest(i, j, len(ids))
    inner = np.flatnonzero(least != np.arange(len(ids)))
    columns = (
        np.repeat([False, True], [len(linked_), len(inner)]),
        np.concatenate([k1[linked_], ids[inner]]),
        np.concatenate([k2[linked_], ids[least[inner]]]),
        np.concatenate([degree[linked_], np.zeros(len(inner), np.int64)]),
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["joins", "a", "b", "n"])


#: Pairs whose exact cosine is taken at a time.
PAIRS = 1 << 16


def _compared(cells: DataFrame, basis: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """What cells say of their classes, from rows (cell, side, k1, k2, class_id, copies, embedding) sorted by cell.

    Rows (joins, a, b, n): without ``joins``, the class of key (a, b) is linked with n other vectors
    in the cell; with it, classes a and b are in one component. Both are at most one row per class
    and cell, however many links there are.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column(0).to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            for at, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if held and end > at and held[-1].column(0)[0].as_py() != cell[at]:
                    yield _cell(held, basis, threshold)
                    held = []
                if end > at:
                    held.append(batch.slice(at, end - at))
        if held:
            yield _cell(held, basis, threshold)

    return cells.mapInArrow(releasing(run), "joins boolean, a long, b long, n long")


def _coordinates(classes: DataFrame, basis: dict[int, np.ndarray]) -> DataFrame:
    """The classes with their length ``d`` and the leading ``BOX`` coordinates of their unit vectors, ``c``."""
    schema = StructType([*classes.schema.fields, StructField("d", IntegerType()), StructField("c", ArrayType(FloatType()))])

    def run(batches):
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("embedding"))
            length = np.diff(vectors.offsets.to_numpy())
            lead = np.zeros((len(length), BOX), np.float32)
            for d in np.unique(length).tolist():
                of = np.flatnonzero(length == d)
                x = matrix(vectors.take(pa.array(of)))
                u = (x / np.linalg.norm(x, axis=1)[:, None]) @ basis.get(d, np.eye(d))[:, :BOX]
                lead[of, : u.shape[1]] = u
            c = pa.ListArray.from_arrays(np.arange(len(length) + 1, dtype=np.int32) * BOX, pa.array(lead.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length.astype(np.int32)), c], names=[*batch.schema.names, "d", "c"])

    return classes.mapInArrow(releasing(run), schema)


def _tiled(classes: DataFrame, basis: dict[int, np.ndarray], threshold: float, tile: int) -> DataFrame:
    """What all pairs of tiles say of classes (grp, k1, k2, class_id, copies, embedding); only those of one ``grp`` are compared."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    width = reach / _REACH
    g, p = [f"g{k}" for k in range(SPLITS)], [f"p{k}" for k in range(SPLITS)]
    strips = [F.floor((F.col("c")[k] + 1) / F.lit(width)).cast("int").alias(g[k]) for k in range(SPLITS)]
    placed = written(_coordinates(classes, basis).select("*", *strips), "tiles-classes")
    # how full the strips are, to the depth at which a tile's worth is left
    leaves = placed.groupBy("grp", "d", *g).agg(F.count(F.lit(1)).alias("n"))
    for k in range(SPLITS):
        leaves = leaves.withColumn(f"n{k}", F.sum("n").over(W.partitionBy("grp", "d", *g[: k + 1])))
    full = [F.col(f"n{k}") > tile for k in range(SPLITS)]
    deeper = [F.lit(True)] + [full[k] for k in range(SPLITS - 1)]  # whether the strips of axis k are told apart
    parts = F.when(full[-1], F.ceil(F.col(f"n{SPLITS - 1}") / tile)).otherwise(1).cast("int")
    told = F.lit(True)
    for k in range(SPLITS):
        told = told & deeper[k]
        leaves = leaves.withColumn(p[k], F.when(told, F.col(g[k])).otherwise(-1))
    leaves = leaves.select("grp", "d", *g, *p, parts.alias("parts"))
    part = F.pmod(F.xxhash64("k1", "k2"), F.col("parts")).cast("int").alias("part")
    dealt = placed.join(leaves, ["grp", "d", *g]).select("grp", "d", *p, part, "k1", "k2", "class_id", "copies", "embedding", "c")
    key = ["grp", "d", *p, "part"]
    edges = [f(F.col("c")[k]).alias(f"{n}{k}") for k in range(BOX) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    tiles = written(dealt.groupBy(*key).agg(*edges).withColumn("tile", F.monotonically_increasing_id()), "tiles-boxes")
    # pairs of tiles within reach on the first axis, then by the distance of their boxes; each pair once
    box = [f"{n}{k}" for k in range(BOX) for n in ("lo", "hi")]
    steps = F.explode(F.array(*[F.lit(k) for k in range(-_REACH - 1, _REACH + 2)]))
    mine = tiles.select("grp", "d", F.col("tile").alias("one"), *[F.col(b).alias(f"{b}a") for b in box], "p0", steps.alias("k")).withColumn("p0", F.col("p0") + F.col("k")).drop("k")
    other = tiles.select("grp", "d", "p0", F.col("tile").alias("two"), *[F.col(b).alias(f"{b}b") for b in box])
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"lo{k}a") - F.col(f"hi{k}b"), F.col(f"lo{k}b") - F.col(f"hi{k}a"))
    apart = sum((gap(k) * gap(k) for k in range(1, BOX)), gap(0) * gap(0))
    pairs = mine.join(other, ["grp", "d", "p0"]).filter((F.col("one") <= F.col("two")) & (apart <= reach * reach + SLACK)).select("one", "two")
    pairs = written(pairs.withColumn("cell", F.monotonically_increasing_id()), "tiles-pairs")
    sides = pairs.select("cell", F.lit(0).alias("side"), F.col("one").alias("tile")).unionByName(pairs.filter("one <> two").select("cell", F.lit(1).alias("side"), F.col("two").alias("tile")))
    known = dealt.join(tiles.select(*key, "tile"), key).select("tile", "k1", "k2", "class_id", "copies", "embedding")
    cells = known.join(sides, "tile").select("cell", "side", "k1", "k2", "class_id", "copies", "embedding")
    return written(_compared(cells.repartition("cell").sortWithinPartitions("cell"), basis, threshold), "tiles-links")


def _keys(*columns: Column) -> list[Column]:
    """Two hashes of 64 bits that stand for a vector and what it is grouped by."""
    return [F.xxhash64(F.lit(k), *columns).alias(f"k{k}") for k in (1, 2)]


def _classes(rows: DataFrame) -> DataFrame:
    """(grp, k1, k2, class_id, copies, embedding) of distinct rows (grp, k1, k2, vec_id, embedding)."""
    return rows.groupBy("grp", "k1", "k2").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))


def linked(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors without a vec_id are vectors of their own and link others. A component is named by its
    least vec_id; one without any has none, and keeps one row.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string").alias("grp"))
    if rows.filter("vec_id is null").isEmpty():
        return _linked(rows, threshold, tile, sample)
    own = numbered(rows.select(F.col("vec_id").alias("doc_id"), F.lit("").cast("binary").alias("data"), "embedding", "grp", F.col("vec_id").alias("id")))
    found = _linked(own.select(F.col("doc").alias("vec_id"), "embedding", "grp"), threshold, tile, sample)
    return reported(found, own.select(F.col("doc").alias("vec_id"), "id"), "vec_id")


def _linked(rows: DataFrame, threshold: float, tile: int, sample: int) -> DataFrame:
    given = F.col("vec_id").isNotNull() & F.col("grp").isNotNull() & usable()
    keyed = rows.select("vec_id", "grp", "embedding", *[F.when(given, k).alias(n) for k, n in zip(_keys(F.col("grp"), F.col("embedding")), ("k1", "k2"))])
    members = written(keyed.filter("k1 is not null").dropDuplicates(["vec_id", "grp", "k1", "k2"]), "tiles-members")
    classes = written(_classes(members), "tiles-all")
    drawn = classes.select("embedding", F.xxhash64("k1").alias("draw")).orderBy("draw").limit(sample).collect()
    sizes: dict[int, int] = {}
    for r in drawn:
        sizes[len(r["embedding"])] = sizes.get(len(r["embedding"]), 0) + 1
    basis = {d: principal_axes(np.array([r["embedding"] for r in drawn if len(r["embedding"]) == d])) for d in sorted(sizes, key=lambda d: (-sizes[d], d))[:LENGTHS]}
    said = _tiled(classes, basis, threshold, tile)
    joins = said.filter("joins").select("a", "b")
    degree = said.filter("not joins").groupBy(F.col("a").alias("k1"), F.col("b").alias("k2")).agg(F.sum("n").alias("others"))
    repeated = members.groupBy("vec_id").count().filter("count > 1").select("vec_id")
    same = None
    if not repeated.isEmpty():
        # links between vectors of one vec_id count for none of them, but join their classes
        several = members.join(repeated, "vec_id")
        own = several.select("vec_id", "embedding", F.concat_ws("|", "grp", "vec_id").alias("grp"), F.col("k1").alias("o1"), F.col("k2").alias("o2"))
        own = written(own.select("*", *_keys(F.col("grp"), F.col("embedding"))), "tiles-repeated")
        inner = _tiled(_classes(own), basis, threshold, tile).filter("not joins").groupBy(F.col("a").alias("k1"), F.col("b").alias("k2")).agg(F.sum("n").alias("same"))
        same = own.join(inner, ["k1", "k2"]).select("vec_id", F.col("o1").alias("k1"), F.col("o2").alias("k2"), "same")
        joins = joins.unionByName(several.join(classes.select("grp", "k1", "k2", "class_id"), ["grp", "k1", "k2"]).select(F.col("class_id").alias("a"), F.col("vec_id").alias("b")))
    found = components(joins).withColumnRenamed("node", "class_id")
    stated = classes.select("k1", "k2", "class_id", "copies").join(degree, ["k1", "k2"], "left").join(found, "class_id", "left")
    stated = stated.select("k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    out = keyed.select("vec_id", "k1", "k2").join(stated, ["k1", "k2"], "left")
    if same is not None:
        out = out.join(same, ["vec_id", "k1", "k2"], "left").withColumn("n_links", F.col("n_links") - F.coalesce("same", F.lit(0)))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: Strips are so wide that vectors within reach lie at most this many strips apart.
_REACH = 3


def sql(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, by comparing all pairs of a label."""
    return f"""
WITH RECURSIVE good AS MATERIALIZED (
  SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {threshold}),
both_ AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT vec_id AS node, vec_id AS r FROM embeddings UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON reach.r = both_.a),
least_ AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM both_ GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least_ l ON e.vec_id = l.node LEFT JOIN degree d ON d.a = e.vec_id"""
