"""Shared pieces of the training-data operators: scratch tables, ranks within groups, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python; keeps a worker's memory bounded when texts are long.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows (and bytes, where Spark knows the setting) of each Arrow batch and of the Parquet reader's."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(min(4096, rows)))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``; where that is unset, a temporary one of a local session."""
    top = spark.conf.get("spark.checkpoint.dir", None) or getattr(scratch_dir, "own", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = scratch_dir.own = tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top}/foliant/{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that nothing needs any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: str = "doc_id") -> Column:
    return (fold_crc(doc_id) % 5) == 0


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, group: list[str], order: list[str], out: str, spread: int | None = None, bucket: str | None = None) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each ``group``, without gathering a group in one task.

    A group's rows are dealt to ``spread`` buckets by a hash of ``order``, numbered inside their bucket, and moved up
    by the counts of the buckets before. Only those counts, at most ``spread`` per group, meet in one window. Where rows
    may be alike in ``order`` very often, a written column ``bucket`` deals them instead.
    """
    n = spread or max(64, parts(df.sparkSession))
    keyed = df.withColumn("__bucket", F.col(bucket) if bucket else F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    sizes = keyed.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order)
    ranked = keyed.withColumn(out, (F.row_number().over(inside) - 1).cast("long"))
    names = [*group, "__bucket"]
    sizes = sizes.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(names)], "__base")
    same = [ranked[c].eqNullSafe(sizes[f"__r{i}"]) for i, c in enumerate(names)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return ranked.join(sizes, on).withColumn(out, F.col(out) + F.col("__base")).select(*df.columns, out)


#: Most rows of a side that is broadcast (a few dozen bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 300_000
#: A key is heavy if it has more than this share of a table's rows, and at least so many: so there are at most 1,000.
HEAVY_SHARE, HEAVY_LEAST = 1_000, 1_000


def spread_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``big``, a written table in which one key may have any share of the rows, with the one row of ``small`` for its key.

    Rows of a heavy key are dealt to as many parts as it has thousandths of the table, and its row of ``small`` is copied
    to each; so no task takes more than that of one key, and ``small`` grows by at most 2,000 rows.
    """
    spark = big.sparkSession
    limit = max(HEAVY_LEAST, big.count() // HEAVY_SHARE)
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > limit)
    heavy = [(r[0], -(-r[1] // limit)) for r in counts.collect()]  # fewer than HEAVY_SHARE
    if not heavy:
        return big.join(small, key, how)
    kind = big.schema[key].dataType.simpleString()
    deal = F.broadcast(spark.createDataFrame(heavy, f"{key} {kind}, __s int"))
    one = F.coalesce("__s", F.lit(1))
    dealt = big.join(deal, key, "left").withColumn("__p", F.pmod(F.monotonically_increasing_id(), one).cast("int")).drop("__s")
    copied = small.join(deal, key, "left").withColumn("__p", F.explode(F.sequence(F.lit(0), one - 1))).drop("__s")
    return dealt.join(copied, [key, "__p"], how).drop("__p")


def match(big: DataFrame, small: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a table of one row a key: broadcast if ``rows`` (or a count) says that it is small, else :func:`spread_join`."""
    rows = small.count() if rows is None else rows
    return big.join(F.broadcast(small), key, how) if rows <= BROADCAST_ROWS else spread_join(big, small, key, how)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates the large-star and small-star steps, each round a shuffle of the edges only, until nothing changes; every
    round's edges are written to the scratch folder. A node's neighbours are never gathered: both steps take the
    minimum by partial aggregation and join it back, by broadcast where the edges are few, and otherwise with the edges
    of a heavy node dealt to many parts.
    """
    cols = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    now = materialise(edges.where(F.col("a") != F.col("b")).select(*cols).distinct())
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
        last, nodes = mark, 2 * mark[0]  # as many at most
        # large star: every larger neighbour of u moves to the smallest of u's neighbourhood
        pairs = both(now)
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = match(pairs.where(F.col("b") > F.col("a")), least, "a", rows=nodes).select(F.col("m").alias("a"), F.col("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        if nodes > BROADCAST_ROWS:
            large = materialise(large)
        # small star: every smaller neighbour of v, and v, move to the smallest of them
        small = match(large, large.groupBy("b").agg(F.min("a").alias("m")), "b", rows=nodes)
        moved = small.select(F.col("m").alias("x"), F.col("a").alias("y")).union(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        new = materialise(moved.where(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        drop_table(now)
        if nodes > BROADCAST_ROWS:
            drop_table(large)
        now = new
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def with_roots(comps: DataFrame) -> DataFrame:
    """Add a row (root, root) for each root."""
    return comps.union(comps.select(F.col("root").alias("node"), "root").distinct()).distinct()


class Links:
    """Union-find over 0..n-1 that keeps the smallest member as root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def record_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    """Apply ``make(batch) -> columns`` to each batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(make(batch), schema.types, strict=True)], schema=schema)
