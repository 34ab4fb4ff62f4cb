"""Which names contain a text: candidates by its rarest run of characters, then the test itself.

A pattern with wildcards has literal runs; whatever matches it contains all of
them, so the names that share the run of three characters that the fewest names
have are all that need the test. Shorter patterns use runs of two or one, patterns
of wildcards alone use the empty run, which every name has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import like_anywhere, like_suffix

LONGEST = 3


def runs(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters in lower case, none for a shorter text; for size 0 one empty run."""
    low = F.lower(text)
    if size == 0:
        return F.when(text.isNotNull(), F.array(F.lit("")))
    many = F.transform(F.sequence(F.lit(1), F.length(low) - (size - 1)), lambda i: F.substring(low, i, F.lit(size)))
    return F.when(F.length(low) >= size, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def literal_runs(pattern: Column, size: int) -> Column:
    """The runs that whatever matches the pattern contains; % and _ are wildcards, a backslash is not counted on."""
    parts = F.split(pattern, r"[%_\\]")
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: runs(p, size))))


def matched(needles: DataFrame, names: DataFrame, test: Callable[[Column, Column], Column] = like_anywhere) -> DataFrame:
    """(needle, id) for all pairs of ``needles`` (needle) and ``names`` (id, name) with ``test(name, needle)``.

    The test must hold only for names that contain the literal runs of the needle, ignoring case.
    Null needles and null names match nothing; repeated needles give one row, repeated names one each.
    """
    wanted = needles.select("needle").filter("needle is not null").distinct()
    size = F.coalesce(*[F.when(F.size(literal_runs(F.col("needle"), n)) > 0, F.lit(n)) for n in range(LONGEST, 0, -1)], F.lit(0))
    wanted = wanted.withColumn("size", size)
    per_size = lambda df, column, of: F.when(F.col("size") == LONGEST, of(F.col(column), LONGEST)).when(F.col("size") == 2, of(F.col(column), 2)).when(F.col("size") == 1, of(F.col(column), 1)).otherwise(of(F.col(column), 0))
    asked = wanted.select("needle", "size", F.explode(per_size(wanted, "needle", literal_runs)).alias("run"))
    # only runs that a needle asks for are kept of the names, by as many sizes as the needles have
    sizes = [r["size"] for r in wanted.select("size").distinct().collect()]
    every = names.select("id", "name", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")) if sizes else names.select("id", "name", F.lit(0).alias("size")).limit(0)
    postings = every.select("id", "name", "size", F.explode(per_size(every, "name", runs)).alias("run"))
    postings = postings.join(asked.select("size", "run").distinct(), ["size", "run"], "left_semi")
    counts = postings.groupBy("size", "run").agg(F.count(F.lit(1)).alias("n"))
    rated = asked.join(counts, ["size", "run"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("needle", "size").agg(F.min(F.struct("n", "run")).alias("r")).filter(F.col("r.n") > 0).select("needle", "size", F.col("r.run").alias("run"))
    return rarest.join(postings, ["size", "run"]).filter(test(F.col("name"), F.col("needle"))).select("needle", "id")


def ending(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(needle, id) for all pairs of ``needles`` (needle) and ``names`` (id, name) where the name ends in the needle: ``matched`` with ``like_suffix``.

    A needle without wildcards is a key: the end of each name, by as many lengths as the needles
    have, meets it as a whole, so the cost is that of the names and of the pairs that match, however
    many needles share their runs. Needles with wildcards go by their rarest run.
    """
    wanted = needles.select("needle").filter("needle is not null").distinct()
    open_ = F.col("needle").rlike(r"[%_\\]")
    keys = wanted.filter(~open_).select("needle", F.lower("needle").alias("end"))
    sizes = [r["size"] for r in keys.select(F.length("end").alias("size")).distinct().collect()]
    low = names.filter("name is not null").select("id", F.lower("name").alias("low"))
    ends = F.filter(F.array(*[F.lit(s) for s in sizes]).cast("array<int>"), lambda s: s <= F.length("low"))
    cut = low.select("id", "low", F.explode(ends).alias("size")).select("id", F.substring("low", F.length("low") - F.col("size") + 1, F.col("size")).alias("end"))
    return keys.join(cut, "end").select("needle", "id").unionByName(matched(wanted.filter(open_), names, like_suffix))
