"""Mixing sources to target weights, with DataFrame functions only (operator 3).

Tokens (words) are aggregated per source, targets are laid out by weight under
a cap of ``max_rate`` times each source, and a source's repetition rate is its
target over its size. A document is emitted floor(rate) times, plus one copy by
a hash-seeded Bernoulli draw: it is taken if its number in [0, 1), which follows
from the MD5 of the seed, the doc_id and the text, lies below a threshold.

The threshold is the rate's fraction, moved to where the words taken are nearest
to the target: the numbers of a source are counted in ``BINS`` bins by the words
of their documents, and of the bins' edges the one counts up to which the words
come closest to the wanted ones. With many documents it is the fraction but for
chance; with few, a draw against the fraction itself can miss a source's target
by a third, as single documents hold much of it.

A draw depends on its own row and its source's threshold alone, so the mix needs
one aggregation of at most ``BINS`` numbers per source and one join with the
table of sources. That table is written first: where it is below
``spark.sql.autoBroadcastJoinThreshold`` Spark broadcasts it and no text is ever
shuffled; beyond it both sides are shuffled, with adaptive splitting of a hot
source. Sources are ranked, and their running sums taken, in one sorted pass over
the table of sources, which spills; it has one row per source.

Defined cases: a null text has size 0 and takes 0 words; documents of size 0
are emitted like any other; a source without words has target 0 and rate 0; a
null source is a source of its own, ordered last; rows of one doc_id with
different texts are drawn apart, rows that repeat both share their draw; a null
doc_id is drawn by its text; an empty table gives an empty table; other columns
pass through ``mixed`` untouched, also those whose names begin like ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import written

WEIGHTS, BUDGET, MAX_RATE, BINS = (5, 2, 1), 1.5, 2.0, 4096


def words(text: Column) -> Column:
    """Number of words: runs of what is not space or one of the controls 9 to 13.

    All such white space is turned into blanks, runs of blanks into the two characters
    of a run's edges, by character translation; the count is that of word beginnings.
    """
    spaced = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "))
    return F.regexp_count(spaced, F.lit(" [^ ]")).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size) to the same with ``target``: water filled by weight under the caps.

    The level L solves sum(min(cap, w * L)) = min(budget * total, sum(cap)). Sources are
    ordered by cap / w; the ones before the level are at their cap, so L follows from
    running sums. There are as many rows as sources, few against documents.
    """
    by_name, fill = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy(F.col("breaks"), F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_rate))).withColumn("breaks", F.col("cap") / F.col("w"))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    levelled = (
        ranked.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("goal", F.least(F.sum("source_size").over(everything) * F.lit(float(budget)), F.sum("cap").over(everything)))
        .withColumn("level", (F.col("goal") - F.col("capped")) / F.col("open_w"))
        # the level is right for the first source whose cap it does not reach
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("breaks"), F.struct("breaks", "level"))).over(everything)["level"])
    )
    return levelled.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level"))).alias("target"))


def _number(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """The number that decides about a document's last copy."""
    own = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return _number(F.md5(own.cast("binary")))


def rates(sized: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target, base, threshold) of rows (source, size, u), as a written table."""
    bins = sized.groupBy("source", F.floor(F.col("u") * BINS).alias("bin")).agg(F.sum("size").alias("words"))
    counted = written(bins, "mixing-bins")
    goal = targets(counted.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_rate)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("base", F.floor(rate)).withColumn("wanted", F.col("target") - F.col("base") * F.col("source_size"))
    up_to = F.sum("words").over(W.partitionBy("source").orderBy("bin"))
    edges = counted.select(F.col("source").alias("by"), (F.col("bin") + 1).alias("edge"), up_to.alias("words"))
    miss = F.struct(F.abs(F.col("words") - F.col("wanted")).alias("by"), "edge")
    best = goal.join(edges, F.col("source").eqNullSafe(F.col("by"))).groupBy("source", "source_size", "target", "base", "wanted").agg(F.min(miss).alias("best"))
    threshold = F.when(F.col("best.by") < F.col("wanted"), F.col("best.edge") / F.lit(float(BINS))).otherwise(0.0)
    return written(best.select("source", "source_size", "target", "base", threshold.alias("threshold")), "mixing-rates")


def copies(u: Column) -> Column:
    """How often a document is taken, by its number and its source's columns ``base`` and ``threshold``."""
    return F.col("base") + (u < F.col("threshold")).cast("long")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    own = ("doc_id", "text", "source")
    names = [c if c in own else f"in_{k}" for k, c in enumerate(docs.columns)]
    rows, text = docs.toDF(*names), F.col("text").cast("string")
    u = draw(F.col("doc_id"), text, seed)
    plan = rates(rows.select("source", words(text).alias("size"), u.alias("u")), weights, budget, max_rate).select(F.col("source").alias("by"), "base", "threshold")
    each = rows.join(plan, F.col("source").eqNullSafe(F.col("by"))).withColumn("copies", copies(u)).filter("copies > 0")
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*names).toDF(*docs.columns)


def report(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents; texts are read once, their sizes and draws written."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = written(docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), words(text).alias("size"), draw(doc_id, text, seed).alias("u")), "mixing-sizes")
    plan = rates(rows, weights, budget, max_rate).withColumnRenamed("source", "by")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("by")))
    return joined.select("doc_id", "size", "source_size", "target", (copies(F.col("u")) * F.col("size")).alias("taken"))


def sql(weights: tuple = WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE, seed: str = "mix") -> str:
    """The report in DuckDB's SQL."""
    values = ", ".join(f"{float(w)}::DOUBLE" for w in weights)
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([{values}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT] AS w, source_size * {float(max_rate)}::DOUBLE AS cap FROM sources),
summed AS (
  SELECT *, cap / w AS breaks,
    coalesce(sum(cap) OVER f, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS open_w,
    least(sum(source_size) OVER () * {float(budget)}::DOUBLE, sum(cap) OVER ()) AS goal
  FROM weighed WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (
  SELECT *, (SELECT arg_min((goal - capped) / open_w, breaks) FROM summed WHERE (goal - capped) / open_w <= breaks) AS level FROM summed),
goals AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, w * level) END AS target FROM levelled),
binned AS (SELECT source, floor(u * {BINS})::BIGINT AS bin, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
based AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS base FROM goals),
wanted AS (SELECT *, target - base * source_size AS wanted FROM based),
missed AS (
  SELECT w.source, w.wanted, min(struct_pack(d := abs(e.words - w.wanted), edge := e.bin + 1)) AS best
  FROM wanted w JOIN (SELECT source, bin, sum(words) OVER (PARTITION BY source ORDER BY bin) AS words FROM binned) e ON w.source IS NOT DISTINCT FROM e.source GROUP BY w.source, w.wanted),
rated AS (
  SELECT s.doc_id, s.size, s.u, w.source_size, w.target, w.base, CASE WHEN m.best.d < m.wanted THEN m.best.edge / {float(BINS)}::DOUBLE ELSE 0 END AS threshold
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source JOIN missed m ON s.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target, ((base + (u < threshold)::INT)::BIGINT * size)::BIGINT AS taken FROM rated"""
