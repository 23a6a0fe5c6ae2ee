"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of ``STAGES`` full-dimensional codewords, one of each residual codebook. The codebooks are
fitted by k-means on the residuals of a bounded sample (``SAMPLE_ROWS``); every row is then coded by beam search, which
keeps the ``BEAM`` best partial sums at each stage, and stored with its code and the squared norm of the sum. A query
scores a coded row as norm - 2 * (sum of its table entries) + its own squared norm, the tables being its inner products
with all codewords.

What is skipped is measured, not guessed, on rows that no codebook was fitted on (``MEASURE_ROWS``):

* Rows lie in coarse cells, about a quarter of the square root of their number, and the index is sorted by cell. A query
  meets the nearest cells that hold ``RECALL`` of the measured rows' true neighbours: few where vectors form clusters,
  most where they fill all directions alike. Queries go in blocks of ``QUERY_BLOCK`` with like cells; a block is
  broadcast and reads only the cells that any of its queries meets.
* A row is ranked by the exact distance to its original vector if its score is at most the squared distance of the
  k-th best so far plus the margin within which ``SURE`` of the measured true neighbours' scores lie. So ever fewer rows
  are ranked the more a task has seen, and none is cut for want of places.

Defined results: vectors null, zero, of another length than most, or with null or non-finite components take no part,
neither as queries nor as candidates; so do null ids. Equal distances go to the smaller id. An id that occurs more than
once queries once, with each of its vectors' rows as candidates of others. Fewer than ``k`` candidates: all of them.
Tables of fewer than ``FEW`` measured rows are ranked whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import materialise, parts, small_batches, table

STAGES = 8
CODEWORDS = 256
BEAM = 8
SAMPLE_ROWS = 8_192
MEASURE_ROWS = 2_048
FEW = 64
BLOCK_ROWS = 2_048
QUERY_BLOCK = 4_096
#: Most coarse cells: their centres are broadcast.
MOST_CELLS = 4_096
#: Shares of the measured neighbours that the cells met, and the margin, have to reach.
RECALL = 0.97
SURE = 0.99
#: Parts that a cell's rows are dealt to, so that one that holds most rows is no single task.
SPREAD = 32


def valid(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v stays float where it is, and is double otherwise."""
    kind = df.schema["embedding"].dataType
    v = F.col("embedding") if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def fit(sample: np.ndarray, stages: int = STAGES, codewords: int = CODEWORDS, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Codebooks, stages x codewords x dimension."""
    rng, left, books = np.random.default_rng(seed), sample.astype(float), []
    for _ in range(stages):
        book = left[rng.choice(len(left), codewords, replace=len(left) < codewords)].copy()
        for _ in range(rounds):
            of = nearest(left, book)
            n = np.bincount(of, minlength=codewords)
            sums = np.zeros_like(book)
            np.add.at(sums, of, left)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        books.append(book)
        left = left - book[nearest(left, book)]
    return np.array(books)


def least(cost: np.ndarray, k: int, group: int = 32) -> np.ndarray:
    """Places of each row's k smallest numbers: they lie in the k groups with the smallest minima."""
    n, m = cost.shape
    if m % group or m // group <= k:
        return np.argpartition(cost, k - 1, axis=1)[:, :k]
    grouped = cost.reshape(n, m // group, group)
    which = np.argpartition(grouped.min(axis=2), k - 1, axis=1)[:, :k]
    rows = np.arange(n)[:, None]
    near = np.argpartition(grouped[rows, which].reshape(n, -1), k - 1, axis=1)[:, :k]
    return which[rows, near // group] * group + near % group


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x stages) and squared norms of the coded sums, by beam search; it searches in single precision."""
    n, stages, k = len(x), len(books), books.shape[1]
    near, words = x.astype(np.float32), books.astype(np.float32)
    codes, sums = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1, x.shape[1]), np.float32)
    rows = np.arange(n)[:, None]
    for book in words:
        left = near[:, None, :] - sums
        cost = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
        width = min(beam, cost.shape[1] * k)
        best = least(cost.reshape(n, -1), width)
        which, word = best // k, best % k
        codes = np.concatenate([codes[rows, which], word[:, :, None]], axis=2)
        sums = sums[rows, which] + book[word]
    pick = ((near[:, None, :] - sums) ** 2).sum(2).argmin(1)
    codes = codes[np.arange(n), pick]
    assert codes.shape[1] == stages
    return codes, (sum(books[s][codes[:, s]] for s in range(stages)) ** 2).sum(1)


@dataclass
class Model:
    books: np.ndarray  # stages x codewords x dimension
    centres: np.ndarray  # cells x dimension
    probes: int  # cells that a query meets
    margin: float


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def measured(x: np.ndarray, books: np.ndarray, centres: np.ndarray, k: int = 10, queries: int = 256) -> Model:
    """Cells to meet and margin, from true neighbours among rows that nothing was fitted on."""
    if len(x) < FEW:
        return Model(books, centres, len(centres), np.inf)
    q = x[:queries]
    codes, norms = encode(x, books)
    rebuilt = sum(books[s][codes[:, s]] for s in range(len(books)))
    true = np.maximum(((q**2).sum(1)[:, None] + (x**2).sum(1)) - 2 * q @ x.T, 0)
    true[np.arange(len(q)), np.arange(len(q))] = np.inf
    top = np.argpartition(true, k, axis=1)[:, :k]
    score = (q**2).sum(1)[:, None] + norms - 2 * q @ rebuilt.T
    rows = np.arange(len(q))[:, None]
    margin = np.quantile((score - true)[rows, top], SURE)
    rank = np.argsort(np.argsort((centres**2).sum(1) - 2 * q @ centres.T, axis=1), axis=1)
    probes = int(np.quantile(rank[rows, nearest(x, centres)[top]], RECALL, method="higher")) + 1
    return Model(books, centres, probes, float(margin))


def build(rows: DataFrame, model: Model) -> DataFrame:
    """The index, sorted by cell: vec_id, cell, code, norm and the original vector of every row."""
    spark = rows.sparkSession
    small_batches(spark, BLOCK_ROWS)
    shared = spark.sparkContext.broadcast((model.books, model.centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, centres = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                codes, norms = encode(x, books)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest(x, centres), pa.int32()), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(norms), batch.column("v")], names=["vec_id", "cell", "code", "norm", "v"])

    coded = rows.mapInArrow(run, f"vec_id long, cell int, code binary, norm double, v {rows.schema['v'].dataType.simpleString()}")
    if len(model.centres) == 1:
        return coded
    return coded.repartition(parts(spark), "cell", F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD))).sortWithinPartitions("cell")


def search_block(index: DataFrame, model: Model, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The ``k`` nearest of each partition, for one block of queries."""
    tables = np.einsum("qd,skd->sqk", queries, model.books)
    far = np.argsort((model.centres**2).sum(1) - 2 * queries @ model.centres.T, axis=1)
    meets = np.zeros((len(ids), len(model.centres)), bool)
    np.put_along_axis(meets, far[:, : model.probes], True, axis=1)
    margin = model.margin
    shared = index.sparkSession.sparkContext.broadcast((ids, queries, tables, meets))
    wanted = np.flatnonzero(meets.any(axis=0)).tolist()
    if len(wanted) < len(model.centres):
        index = index.where(F.col("cell").isin(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, tables, meets = shared.value
        norms = (queries**2).sum(1)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        limit = np.full(len(ids), np.inf)  # squared distance of the k-th best, with the margin

        def rank(q: int, at: np.ndarray, own: np.ndarray, v: np.ndarray) -> None:
            at = at[own[at] != ids[q]]
            d, i = best[q]
            d, i = np.append(d, np.sqrt(((v[at] - queries[q]) ** 2).sum(1))), np.append(i, own[at])
            order = np.lexsort((i, d))[:k]
            best[q] = d[order], i[order]
            if len(order) == k:
                limit[q] = best[q][0][-1] ** 2 * (1 + 1e-9) + margin

        for batch in batches:
            if not batch.num_rows:
                continue
            all_ids, all_v, all_norm, cells = batch.column("vec_id").to_numpy(), matrix(batch.column("v")), batch.column("norm").to_numpy(), batch.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(all_ids), -1)
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                own, v, norm, code = all_ids[a:b], all_v[a:b], all_norm[a:b], codes[a:b]
                asked = np.flatnonzero(meets[:, cells[a]])
                for c in range(0, len(asked), 128):
                    qs = asked[c : c + 128]
                    score = norm[None, :] + norms[qs, None]
                    for s in range(code.shape[1]):
                        score -= 2 * tables[s][qs][:, code[:, s]]
                    for j in np.flatnonzero(np.isinf(limit[qs])).tolist():  # a first k, so that there is a limit
                        near = np.argpartition(score[j], 4 * k)[: 4 * k] if len(own) > 4 * k else np.arange(len(own))
                        rank(int(qs[j]), near, own, v)
                        score[j, near] = np.inf
                    hit = (score <= limit[qs, None]) & np.isfinite(score)
                    for j in np.flatnonzero(hit.any(axis=1)).tolist():
                        rank(int(qs[j]), np.flatnonzero(hit[j]), own, v)
        rows = [(int(ids[q]), int(i), float(d)) for q, (ds, found) in enumerate(best) for d, i in zip(ds, found, strict=True)]
        for a in range(0, len(rows), 8192):
            part = rows[a : a + 8192]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.float64())], names=["query_id", "vec_id", "score"])

    return index.select("vec_id", "cell", "code", "norm", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def search(index: DataFrame, model: Model, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found. queries: (vec_id, v)."""
    spark = index.sparkSession
    small_batches(spark, BLOCK_ROWS)
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n = one.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if n > block:  # queries of like cells come together
        shared = spark.sparkContext.broadcast(model.centres)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(matrix(batch.column("v")), shared.value), pa.int32())], names=["vec_id", "v", "cell"])

        one = materialise(one.mapInArrow(placed, f"vec_id long, v {one.schema['v'].dataType.simpleString()}, cell int"))
        sizes = {r["cell"]: r["n"] for r in one.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_CELLS
        groups: list[tuple[list[int], int]] = []  # cells, and how many blocks they make
        for cell in sorted(sizes):
            if groups and sum(sizes[c] for c in groups[-1][0]) + sizes[cell] <= block:
                groups[-1][0].append(cell)
            else:
                groups.append(([cell], 1))
        dealt = [one.where(F.col("cell").isin(cells) & (F.pmod(F.xxhash64("vec_id"), F.lit(m)) == b)) for cells, _ in groups for m in [-(-sum(sizes[c] for c in cells) // block)] for b in range(m)]
    else:
        dealt = [one]
    found = None
    for part in dealt:
        rows = sorted((r["vec_id"], r["v"]) for r in part.select("vec_id", "v").collect())  # about ``block`` rows
        if rows:
            near = search_block(index, model, np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), k)
            near = materialise(near) if len(dealt) > 1 else near
            found = near if found is None else found.union(near)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, measure_rows: int = MEASURE_ROWS, cells: int | None = None) -> Model | None:
    """The model of about ``sample_rows`` rows, and as many to measure on as ``measure_rows``, chosen by a hash of the id."""
    n = rows.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("vec_id", F.lit("codebook")), F.lit(1 << 20)) / float(1 << 20)
    fitted, kept = min(0.8, sample_rows / n), min(0.2, measure_rows / n)
    got = sorted((r["vec_id"], r["v"], r["fits"]) for r in rows.where(draw < fitted + kept).select("vec_id", "v", (draw < fitted).alias("fits")).collect())
    sample = [v for _, v, fits in got if fits] or [r["v"] for r in rows.orderBy("vec_id").limit(1).collect()]
    sample = np.array(sample, float)
    cells = min(MOST_CELLS, cells or max(1, int(n**0.5 / 4)), max(1, len(sample) // 8))
    books, centres = fit(sample), fit(sample, 1, cells)[0]
    return measured(np.array([v for _, v, fits in got if not fits], float).reshape(-1, sample.shape[1]), books, centres)


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(table(spark, sf_dir, "embeddings"))
    model = train(rows)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(materialise(build(rows, model)), model, rows.where(F.col("vec_id") % 100 == 0))
