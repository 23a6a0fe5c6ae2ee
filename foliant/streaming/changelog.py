"""Changelogs as Structured Streaming sources: each micro-batch makes one new version of the replayed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.changes import replay
from foliant.sources.stores import BucketedStore, VersionedStore


def read_changelog(spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def replay_stream(log: DataFrame, store: VersionedStore | BucketedStore, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Keep ``store`` at the state that the changelog leads to. A batch that ran before is not applied again.

    A bucketed store writes what a batch touches, a versioned one its whole state.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if isinstance(store, BucketedStore):
            batch.persist()
            try:
                store.apply_log(batch, number)
            finally:
                batch.unpersist()
            return
        marks = f"{store.folder}/batches"
        done = store.fs.exists(store.fs_path(f"{marks}/{number}"))
        if not done:
            store.save(replay(store.load().items, batch, key))
            store.fs.create(store.fs_path(f"{marks}/{number}")).close()

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
