from pyspark.sql import functions as F

from quarry.plans.store import Store
from quarry.streaming import ingest


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, "repo_id long, repo string, path string, content string, at string")
    df.select("repo_id", "repo", "path", "content", F.col("at").cast("timestamp").alias("changed_at")).coalesce(1).write.mode("append").parquet(folder)


def drain(store, spark, folder, checkpoint):
    q = ingest.start(store, ingest.file_stream(spark, folder), checkpoint)
    q.processAllAvailable()
    q.stop()


def test_batches_replace_their_files(spark, tmp_path):
    folder, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "kb"))
    put(spark, folder, [(1, "a", "lib/x.ex", "defmodule X do\nend", "2024-01-01"), (1, "a", "lib/y.ex", "defmodule Y do\nend", "2024-01-01"), (2, "b", "proto/p.proto", "message Made {\n string id = 1;\n}", "2024-01-01")])
    drain(store, spark, folder, str(tmp_path / "cp"))
    put(spark, folder, [(1, "a", "lib/x.ex", "defmodule Old do\nend", "2024-01-02"), (1, "a", "lib/x.ex", "defmodule X2 do\n def handle_event(%Made{}), do: 1\nend", "2024-01-03")])
    drain(store, spark, folder, str(tmp_path / "cp"))
    m = store.model()
    assert {r["name"] for r in m.modules.collect()} == {"X2", "Y"}
    assert {r.relationship_type for r in m.edges.collect()} == {"produces_event", "consumes_event"}
    postings = store.index()[1].postings
    assert {r.term for r in postings.filter("entity_type = 'module'").select("term").distinct().collect()} >= {"x2", "y"}
    assert postings.filter("term = 'old'").count() == 0


def test_change_counts(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [(1, "a", f"f{i}", "", "2024-01-01 00:01:00") for i in range(3)] + [(1, "a", "late", "", "2024-01-01 00:12:00")])
    q = ingest.change_counts(ingest.file_stream(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("changes").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.files for r in spark.table("changes").collect()) == [1, 3]
