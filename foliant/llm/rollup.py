"""Delta-maintained token-count rollups by source, language and tokenizer version.

The totals are sums, so changes are signed rows: an insert adds (1 document, its tokens, its bytes), a delete takes
them off, a revision takes the old counts off and adds the new ones. :meth:`Rollup.commit` aggregates a batch to one
row per (source, lang, version) before anything is written, stores it below the batch's own folder and so is idempotent:
a batch is committed when its folder has Spark's success mark, and committing it again changes nothing; a folder left
half-written by a lost driver is overwritten. :meth:`Rollup.totals` sums the committed batches; :meth:`Rollup.compact`
folds them into one base folder that remembers the batches it holds, and removes all bases but the one before, which a
reader may still be at. Names of batches are kept for good: without them a late repetition could not be told from news.

Defined results: null source, lang or version form groups of their own; null text counts 0 tokens and 0 bytes; an empty
batch commits and changes nothing; a group whose documents cancel out is left out of the totals; repeated rows of a
batch all count, since a batch is a bag of changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import materialise, scratch_dir, small_batches, table
from foliant.llm.tokens import BYTE_BPE, WORD_BPE, tokenizer

KEYS = ["source", "lang", "version"]
SUMS = ["docs", "tokens", "bytes"]
SCHEMA = "source string, lang string, version string, docs long, tokens long, bytes long"


def counted(docs: DataFrame, path: str = BYTE_BPE, version: str = BYTE_BPE) -> DataFrame:
    """doc_id, source, lang, version, tokens and bytes of each document's whole text."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            if batch.num_rows:
                texts = batch.column("text").to_pylist()
                n = coder.counts(texts) if hasattr(coder, "counts") else [len(x) // 4 for x in coder.encode(texts)]
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "source", "lang", "tokens", "bytes"])

    out = slim.mapInArrow(run, "doc_id long, source string, lang string, tokens long, bytes long")
    return out.select("doc_id", "source", "lang", F.lit(version).alias("version"), "tokens", "bytes")


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens", "bytes")


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"), (-F.col("bytes")).alias("bytes"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same documents counted anew: their groups, tokens and bytes may all differ."""
    return deletes(old).unionByName(inserts(new))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])


class Rollup:
    """Totals kept below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self, kind: str) -> list[str]:
        glob = self.fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/_SUCCESS"))
        return sorted(s.getPath().getParent().getName().partition("=")[2] for s in glob or [])

    def batches(self) -> set[str]:
        """Batches that are committed, in folders of their own or in the base."""
        out = set(self._folders("batch"))
        for n in self._folders("base")[-1:]:
            out |= {r["batch"] for r in self.spark.read.schema("batch string").json(f"{self.path}/held={n}").collect()}
        return out

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of signed rows; False, and no change, where it was committed before."""
        if not batch or any(c in batch for c in "/={}*?[]\\"):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        summed(deltas).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")  # a row per group
        return True

    def totals(self) -> DataFrame:
        folders = [f"{self.path}/base={n}" for n in self._folders("base")[-1:]]
        held = set()
        if folders:
            n = self._folders("base")[-1]
            held = {r["batch"] for r in self.spark.read.schema("batch string").json(f"{self.path}/held={n}").collect()}
        folders += [f"{self.path}/batch={b}" for b in self._folders("batch") if b not in held]
        rows = self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)
        return summed(rows).where((F.col("docs") != 0) | (F.col("tokens") != 0) | (F.col("bytes") != 0))

    def compact(self) -> None:
        """Fold all committed batches into a new base; batch folders go once the base has its success mark."""
        held, rows = sorted(self.batches()), self.totals()
        n = f"{int((self._folders('base') or ['0'])[-1]) + 1:08d}"
        names = self.spark.createDataFrame([(b,) for b in held], "batch string")
        names.coalesce(1).write.mode("overwrite").json(f"{self.path}/held={n}")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base={n}")
        gone = [f"batch={b}" for b in self._folders("batch") if b in held]
        gone += [f"{kind}={old}" for old in self._folders("base")[:-2] for kind in ("base", "held")]
        for folder in gone:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"), True)


#: Batches of documents that op9 commits.
PARTS = 4


def estimated(rows: DataFrame) -> DataFrame:
    """Provisional counts: a token per four bytes, rounded up."""
    return rows.withColumn("tokens", F.ceil(F.col("bytes") / 4).cast("long"))


def maintained(rollup: Rollup, first: DataFrame, second: DataFrame) -> DataFrame:
    """Totals of two tokenizer versions after inserts, revisions, deletes and repeated commits of all documents.

    Documents arrive in ``PARTS`` batches with estimated counts of the first version and are revised to its exact ones,
    part by part; one part is deleted and inserted again; the second version's counts come in as one more batch. Every
    batch is delivered twice, and the batches are compacted half-way and at the end.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    for p in range(PARTS):
        own = first.where(part == p)
        for _ in range(2):
            rollup.commit(f"insert-{p}", inserts(estimated(own)))
            rollup.commit(f"revise-{p}", revisions(estimated(own), own))
    rollup.compact()
    for _ in range(2):
        rollup.commit("delete-0", deletes(first.where(part == 0)))
        rollup.commit("insert-0-again", inserts(first.where(part == 0)))
        rollup.commit("second", inserts(second))
        rollup.commit("insert-0", inserts(estimated(first.where(part == 0))))  # late, and in the base by now
    rollup.compact()
    return rollup.totals()


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and version of two tokenizers; see :func:`maintained`."""
    docs = table(spark, sf_dir, "documents")
    first, second = (materialise(counted(docs, path, path)) for path in (BYTE_BPE, WORD_BPE))  # a few numbers a document
    return maintained(Rollup(spark, scratch_dir(spark)), first, second)
