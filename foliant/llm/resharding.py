"""Resharding by minimum-cost flow: move the fewest bytes from old shards to shards of new capacities.

A transport problem on the shards alone (never on rows): old shard i offers its bytes, new shard j takes up to its
capacity, keeping bytes where they are costs nothing and every byte moved costs one. Successive shortest paths solve it
exactly on the driver. The flow is then carried out with blocks, the units that move: each old shard is cut by a hash of
the text into ``BLOCKS`` blocks, so equal texts stay together, and blocks go, from large to small, where most of the
flow is still open; what one old shard leaves uneven is made up by the next. A block above a whole shard's share (one
text that holds very many bytes) is cut again: by a second hash of the text, and then by a hash of the row. The tables
of block sizes are bounded by these numbers, not by the data.

Only files of shards that give or take blocks are written again (:func:`rewrite`): a manifest names each shard's folder
and is replaced last. Rows go from their own reading straight to files of their shard, so no task and no shuffle ever
holds a shard: a task writes what its share of the old files has for each new shard. The query lays documents out in old
shards, rewrites the affected ones, and returns what it then reads from the new files.

Law of the query: ``bytes``. Defined results: null text counts as empty (size 1, crc 0); null and repeated doc_ids are
rows like others; an empty table gives no rows; rows alike in id and text beyond one shard's share stay together.
"""

from __future__ import annotations

import heapq
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import gapless_rank, materialise, parts, scratch_dir, table

OLD_SHARDS = 12
NEW_SHARDS = 16
BLOCKS = 1024
#: Parts of an oversize block: by a second hash of the text, then by a hash of the row.
SPLITS = (64, 256)


def min_cost_flow(supply: list[int], capacity: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Amounts by (from, to) that ship all of ``supply`` at the least cost; capacities must suffice."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards are too small for what the old ones hold")
    source, sink = n + m, n + m + 1
    to, room, price, edges = [], [], [], [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, c: int, w: int) -> None:
        for x, y, k, p in ((a, b, c, w), (b, a, 0, -w)):
            edges[x].append(len(to))
            to.append(y)
            room.append(k)
            price.append(p)

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    own = {}
    for i in range(n):
        for j in range(m):
            own[i, j] = len(to)
            edge(i, n + j, supply[i], cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    height, left = [0] * (n + m + 2), sum(supply)
    while left:
        far, via = [None] * (n + m + 2), [0] * (n + m + 2)
        far[source], queue = 0, [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in edges[x]:
                if room[e]:
                    k = d + price[e] + height[x] - height[to[e]]
                    if far[to[e]] is None or k < far[to[e]]:
                        far[to[e]], via[to[e]] = k, e
                        heapq.heappush(queue, (k, to[e]))
        height = [h + (f if f is not None else 0) for h, f in zip(height, far, strict=True)]
        push, x = left, sink
        while x != source:
            push, x = min(push, room[via[x]]), to[via[x] ^ 1]
        x = sink
        while x != source:
            room[via[x]] -= push
            room[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
        left -= push
    return {k: room[e ^ 1] for k, e in own.items() if room[e ^ 1]}


def shares(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def place_blocks(blocks: list[tuple[tuple, int]], old_shards: int, capacity: list[int]) -> dict[tuple, int]:
    """New shard of each block. blocks: ((old shard, ...), bytes)."""
    by_old: list[list] = [[] for _ in range(old_shards)]
    for key, size in blocks:
        by_old[key[0]].append((-size, key))
    flow = min_cost_flow([sum(-s for s, _ in b) for b in by_old], capacity)
    out, uneven = {}, [0] * len(capacity)  # uneven: what a shard still misses of flows carried out so far
    for i, own in enumerate(by_old):
        open_ = {j: a + uneven[j] for (k, j), a in flow.items() if k == i}
        for size, key in sorted(own):
            j = max(open_, key=lambda j: (open_[j], -j))
            if i in open_ and open_[i] >= -size:  # it need not move
                j = i
            out[key] = j
            open_[j] += size
        for j, a in open_.items():
            uneven[j] = a
    return out


def block_columns(key: Column, row: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit("block")), F.lit(BLOCKS)), F.pmod(F.xxhash64(key, F.lit("split")), F.lit(SPLITS[0])), F.pmod(F.xxhash64(row, key, F.lit("row")), F.lit(SPLITS[1]))]


def reshard(rows: DataFrame, capacity: list[int] | None = None, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """Add ``shard`` to rows with old_shard, size, key (hash of the text) and row (hash of the row).

    capacity: bytes of each new shard; by default equal shares of what there is.
    """
    spark = rows.sparkSession
    names = ["old_shard", "b0", "b1", "b2"]
    b = block_columns(F.col("key"), F.col("row"))
    full = rows.withColumns({"b0": b[0].cast("int"), "b1": F.lit(0), "b2": F.lit(0)})
    sizes = {(r[0], r[1], 0, 0): r[2] for r in full.groupBy("old_shard", "b0").agg(F.sum("size")).collect()}  # at most old_shards * BLOCKS
    capacity = capacity or shares(sum(sizes.values()), new_shards)
    for level, name in ((1, "b1"), (2, "b2")):
        big = [k for k, s in sizes.items() if s > max(capacity)]  # fewer than the new shards
        if not big:
            break
        match = F.lit(False)
        for k in big:
            same = (F.col("old_shard") == k[0]) & (F.col("b0") == k[1]) & (F.col("b1") == k[2])
            match = match | same
        full = full.withColumn(name, F.when(match, b[level].cast("int") + 1).otherwise(F.col(name)))
        for k in big:
            del sizes[k]
        sizes |= {tuple(r[:4]): r[4] for r in full.where(F.col(name) > 0).groupBy(*names).agg(F.sum("size")).collect()}
    placed = place_blocks(sorted(sizes.items()), old_shards, capacity)
    shards = spark.createDataFrame([(*k, j) for k, j in placed.items()], "old_shard int, b0 int, b1 int, b2 int, shard int")
    return full.join(F.broadcast(shards), names).drop("b0", "b1", "b2")  # a row per block: old_shards * BLOCKS and some


def facts(docs: DataFrame, old_shards: int = OLD_SHARDS) -> dict[str, Column]:
    """size, text_crc32, key (hash of the text), row (hash of the row) and the old shard (by a hash of the text) of a document."""
    raw = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    key, doc_id = F.xxhash64(raw), docs["doc_id"].cast("long")
    old = F.pmod(F.xxhash64(key, F.lit("old")), F.lit(old_shards)).cast("int")
    return {"doc_id": doc_id, "size": (F.octet_length(raw) + 1).cast("long"), "text_crc32": F.crc32(raw), "key": key, "row": F.xxhash64(doc_id, key), "old_shard": old}


def measured(docs: DataFrame, old_shards: int = OLD_SHARDS) -> DataFrame:
    """The :func:`facts` of each document."""
    return docs.select(*[c.alias(n) for n, c in facts(docs, old_shards).items()])


#: Columns of a layout.
OLD, NEW = "__old_shard", "__shard"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def rewrite(layout: DataFrame, folder: str, old: str = OLD, new: str = NEW) -> dict[int, str]:
    """Bring the files below ``folder`` to ``layout``: rows with all their columns, and their ``old`` and ``new`` shard.

    Shards that neither give nor take rows keep their folder; the others are written to new ones. The manifest, which
    readers follow, is replaced at the end, so a reader or a lost driver never leaves a mixture.
    """
    spark = layout.sparkSession
    held = manifest(spark, folder)
    moves = layout.where(F.col(old) != F.col(new)).select(old, new).distinct().collect() if held else []  # pairs of shards
    touched = sorted({x for r in moves for x in r})
    shards = {s: p for s, p in held.items() if s not in touched}
    if touched or not held:
        name = f"data-{uuid.uuid4().hex}"
        rows = layout.where(F.col(new).isin(touched)) if held else layout
        setting = "spark.sql.maxConcurrentOutputFileWriters"
        before = spark.conf.get(setting, "0")
        spark.conf.set(setting, "64")  # one open file for each shard instead of a sort of whole rows
        try:
            rows.drop(old).write.partitionBy(new).parquet(f"{folder}/{name}")
        finally:
            spark.conf.set(setting, before)
        shards |= {int(p.rpartition("=")[2]): f"{name}/{p}" for p in children(spark, f"{folder}/{name}", f"{new}=*")}
    version = max(versions(spark, folder), default=0) + 1
    text = json.dumps({"shards": shards, "schema": layout.drop(old, new).schema.json()})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/manifest={version:08d}")
    return shards


def children(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    return [s.getPath().getName() for s in top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(top) or []]


def versions(spark: SparkSession, folder: str) -> list[int]:
    return [int(n.partition("=")[2]) for n in children(spark, folder, "manifest=*") if children(spark, f"{folder}/{n}", "_SUCCESS")]


def newest(spark: SparkSession, folder: str) -> dict:
    have = versions(spark, folder)
    return json.loads(spark.read.text(f"{folder}/manifest={max(have):08d}").first()[0]) if have else {"shards": {}, "schema": None}


def manifest(spark: SparkSession, folder: str) -> dict[int, str]:
    """Folder of each shard, as the newest manifest has it."""
    return {int(s): p for s, p in newest(spark, folder)["shards"].items()}


def read_shards(spark: SparkSession, folder: str, name: str = NEW) -> DataFrame:
    """All rows with their columns, and their shard under ``name``."""
    have = newest(spark, folder)
    schema = T.StructType.fromJson(json.loads(have["schema"]))
    out = None
    for s, p in sorted((int(s), p) for s, p in have["shards"].items()):
        part = spark.read.schema(schema).parquet(f"{folder}/{p}").withColumn(name, F.lit(s))
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(name, T.IntegerType())]))


def op5_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in ``OLD_SHARDS`` shards, brought to ``NEW_SHARDS`` of equal bytes, as their files then have them."""
    docs, folder = table(spark, sf_dir, "documents"), scratch_dir(spark)
    old, new = free_name(docs, OLD), free_name(docs, NEW)
    rewrite(docs.withColumns({old: F.lit(-1), new: facts(docs)["old_shard"]}), folder, old, new)
    held = read_shards(spark, folder, old)
    own = facts(held)
    planned = reshard(held.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), F.col(old).alias("old_shard"), *[own[n].alias(n) for n in ("size", "key", "row")]))
    rewrite(planned.select("doc.*", F.col("old_shard").alias(old), F.col("shard").alias(new)), folder, old, new)
    bucket = F.pmod(F.monotonically_increasing_id(), F.lit(max(64, parts(spark)))).cast("int")  # also of rows that are alike
    moved = read_shards(spark, folder, new)
    rows = materialise(moved.select(*[c.alias(n) for n, c in facts(moved).items()], F.col(new).alias("shard"), bucket.alias("bucket")))
    return gapless_rank(rows, ["shard"], ["doc_id", "key"], "slot", bucket="bucket").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "old_shard", (F.col("old_shard") != F.col("shard")).alias("moved"),
    )
