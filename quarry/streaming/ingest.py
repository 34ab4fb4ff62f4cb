"""Source files as a stream: new snapshots of files are extracted and merged as they arrive.

Files come as rows (repo_id, path, content) in Parquet, JSON or any streaming
source of that shape. Each micro-batch replaces what was stored of its files,
so a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.text import number_of_key
from quarry.plans.indexing import extracted, tables_of
from quarry.plans.store import KEPT, Store
from quarry.session import cut
from quarry.sources.repository_source import register

FILE_SCHEMA = "repo_id long, repo string, path string, content string, changed_at timestamp"


def file_stream(spark: SparkSession, folder: str, source: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    """A stream of the files that appear in ``folder``."""
    return spark.readStream.format(source).schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)


def repository_stream(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the committed changes of the repositories below ``root``, deleted files included."""
    register(spark)
    rows = spark.readStream.format("repositories").load(root)
    return rows.select(number_of_key(F.lit("repo"), F.col("repo")).alias("repo_id"), "repo", "path", "content", F.current_timestamp().alias("changed_at"), (F.col("change") == "deleted").alias("deleted"))


def merge_batch(store: Store, batch: DataFrame, index: bool = True) -> None:
    """Extracts a batch and stores it in place of the same files' rows; of several versions the latest counts.

    Rows may say that a file was deleted.
    Tables, text index and graph go to one new version; ``index`` off leaves the last two alone.
    """
    batch = batch if "deleted" in batch.columns else batch.withColumn("deleted", F.lit(False))
    seen = cut(batch.groupBy("repo_id", "path").agg(F.max_by(F.struct("repo", "content", "deleted"), "changed_at").alias("f")).select("repo_id", "path", "f.repo", "f.content", "f.deleted"))
    ids = [r["repo_id"] for r in seen.select("repo_id").distinct().collect()]
    if not ids:
        return
    latest = seen.filter("not deleted").drop("deleted")
    repos = seen.select(F.col("repo_id").alias("id"), F.col("repo").alias("name"), F.concat(F.lit("/stream/"), "repo").alias("path")).distinct()
    old = store.model()
    tables = tables_of(repos, latest, extracted(latest), old.repos, old.services, old.events, old.modules)
    # edges and services of a batch's other files stay: they are merged by id, not replaced
    for name in ("edges", "services"):
        source = "source_file" if name == "edges" else "name"
        kept = old.edges.join(seen.select("repo_id", F.col("path").alias("source_file")), ["repo_id", "source_file"], "left_anti") if name == "edges" else old.services.join(tables[name].select("repo_id", "name"), ["repo_id", source], "left_anti")
        tables[name] = tables[name].select(*kept.columns).unionByName(kept.filter(F.col("repo_id").isin(ids))) if name in tables else kept
    with store.transaction():
        store.persist_changed(tables, seen.select("repo_id", "path"), ids)
        if index:
            store.update_index(ids)
            store.update_graph(old, ids)


def start(store: Store, stream: DataFrame, checkpoint: str, index: bool = True) -> StreamingQuery:
    """Merges every micro-batch of the stream into the store; text index and graph follow by what changed unless ``index`` is off.

    Once in ``KEPT`` batches the folders of older versions are deleted.
    """

    def merged(batch: DataFrame, number: int) -> None:
        merge_batch(store, batch, index)
        if number % KEPT == KEPT - 1:
            store.vacuum()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merged).start()


def change_counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, repo_id, files): changed files per repository and window, for streams whose rows come up to ``late`` late."""
    return stream.withWatermark("changed_at", late).groupBy(F.window("changed_at", window), "repo_id").agg(F.count(F.lit(1)).alias("files"))
