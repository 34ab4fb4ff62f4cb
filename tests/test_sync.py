from quarry.plans.store import Store
from quarry.streaming import ingest, sync


def put(spark, folder, repo_id, commit, files, at):
    rows = [(repo_id, f"r{repo_id}", commit, p, c, at) for p, c in [*files.items(), (None, None)]]
    df = spark.createDataFrame(rows, "repo_id long, repo string, commit string, path string, content string, at string")
    df.select("repo_id", "repo", "commit", "path", "content", df["at"].cast("timestamp").alias("changed_at")).coalesce(1).write.mode("append").parquet(folder)


def test_snapshots_give_changes_and_redelivery_gives_none(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync, "SHARES", 3)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sync.PROVIDER)
    folder, store, emitted = str(tmp_path / "in"), Store(spark, str(tmp_path / "kb")), []
    real = ingest.merge_batch
    monkeypatch.setattr(ingest, "merge_batch", lambda s, batch, index: emitted.append(sorted((r.path, r.deleted) for r in batch.collect())) or real(s, batch, False))

    def drain():
        emitted.clear()
        q = ingest.start(store, sync.changed_files(sync.snapshot_stream(spark, folder)), str(tmp_path / "cp"), index=False)
        q.processAllAvailable()
        q.stop()
        return [e for batch in emitted for e in batch]

    try:
        a, b = "defmodule A do\nend", "defmodule B do\nend"
        put(spark, folder, 1, "c1", {"lib/a.ex": a, "lib/b.ex": b, "lib/c.ex": "defmodule C do\nend"}, "2024-01-01")
        assert drain() == [("lib/a.ex", False), ("lib/b.ex", False), ("lib/c.ex", False)]
        put(spark, folder, 1, "c1", {"lib/a.ex": a, "lib/b.ex": b, "lib/c.ex": "defmodule C do\nend"}, "2024-01-01")
        assert drain() == []
        put(spark, folder, 1, "c2", {"lib/a.ex": a, "lib/b.ex": "defmodule B2 do\nend"}, "2024-01-02")
        assert drain() == [("lib/b.ex", False), ("lib/c.ex", True)]
        assert {r["name"] for r in store.table("modules").collect()} == {"A", "B2"}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
