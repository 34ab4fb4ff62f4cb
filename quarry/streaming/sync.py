"""What has changed between snapshots of repositories, kept as state of a stream.

A snapshot is a set of rows (repo_id, repo, commit, path, content) that arrive
together, all files of a repository at a commit, and one row whose path is null
that says so. State per repository holds the commit and a digest of every file;
a file is emitted where its digest is new, and as deleted where a later snapshot
lacks it. A snapshot that is delivered again emits nothing.

Files are dealt to ``SHARES`` shares of a repository by their path, so a large
repository is many keys; the row without a path goes to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARES = 64
SNAPSHOT = "repo_id long, repo string, commit string, path string, content string, changed_at timestamp"
CHANGE = "repo_id long, repo string, path string, content string, changed_at timestamp, deleted boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FileState(StatefulProcessor):
    """The commit and the digests of one share of a repository's files."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.commit = handle.getValueState("commit", "commit string")
        self.digests = handle.getMapState("digests", "path string", "digest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([*rows]).sort_values("changed_at", kind="stable")
        told = batch[batch["path"].isna()]
        # of several snapshots in a batch the last one counts
        commit = told["commit"].iloc[-1] if len(told) else None
        if commit is not None and self.commit.exists() and self.commit.get()[0] == commit:
            return
        files = batch[batch["path"].notna()]
        files = (files if commit is None else files[files["commit"] == commit]).drop_duplicates("path", keep="last")
        known = {k[0]: v[0] for k, v in self.digests.iterator()}
        new = files[pd.Series([known.get(p) != d for p, d in zip(files["path"], files["digest"])], files.index, bool)]
        for p, d in zip(new["path"], new["digest"]):
            self.digests.updateValue((p,), (int(d),))
        out = [new.assign(deleted=False)] if len(new) else []
        if commit is not None:
            gone = sorted({*known} - {*files["path"]})
            for p in gone:
                self.digests.removeKey((p,))
            self.commit.update((commit,))
            if gone:
                last = told.iloc[-1]
                out.append(pd.DataFrame({"repo_id": last["repo_id"], "repo": last["repo"], "path": gone, "content": None, "changed_at": last["changed_at"], "deleted": True}))
        columns = ["repo_id", "repo", "path", "content", "changed_at", "deleted"]
        for part in out:
            yield part[columns].astype({"deleted": bool})

    def close(self) -> None:
        pass


def snapshot_stream(spark: SparkSession, folder: str, source: str = "parquet") -> DataFrame:
    """A stream of the snapshots that appear in ``folder``, a file or more for each."""
    return spark.readStream.format(source).schema(SNAPSHOT).load(folder)


def changed_files(snapshots: DataFrame) -> DataFrame:
    """(repo_id, repo, path, content, changed_at, deleted): a stream of what differs from the snapshots before.

    The session needs a state store of the kind that holds maps: ``spark.sql.streaming.stateStore.providerClass``
    set to ``PROVIDER``. The result is what ``ingest.start`` merges.
    """
    share = F.pmod(F.xxhash64("path"), F.lit(SHARES)).cast("int")
    shares = F.when(F.col("path").isNull(), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(share))
    rows = snapshots.select("*", F.xxhash64(F.coalesce("content", F.lit(""))).alias("digest"), F.explode(shares).alias("share"))
    return rows.groupBy("repo_id", "share").transformWithStateInPandas(statefulProcessor=FileState(), outputStructType=CHANGE, outputMode="Append", timeMode="None")
