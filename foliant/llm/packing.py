"""Packing token sequences of documents into rows of at most ``CAPACITY`` tokens.

Both packers plan over the histogram of piece lengths, which has at most ``CAPACITY`` entries however many documents
there are: equal pieces are interchangeable, so a plan is a list of steps "take ``uses`` pieces of this length for each
of so many rows". The plan's size is bounded by the number of lengths, is made on the driver and is broadcast; pieces
find their place by (length, rank among equal lengths). No task ever sees more than its own share of pieces.

* :func:`plan_min_slack` (minimum bin slack): a row starts with the longest piece left; subset sums of the available
  lengths, held as bits of one integer, give the fullest feasible combination, which is removed as often as it can be.
* :func:`plan_best_fit` (best-fit decreasing): lengths from long to short go to the row with the least room that still
  takes them, found in a segment tree over room sizes.

Documents longer than ``CAPACITY`` are cut, losslessly, into pieces of ``CAPACITY`` tokens; the last may be shorter.
Defined results: a null or empty text is its end token alone; null and repeated doc_ids are rows of their own; an empty
table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import gapless_rank, materialise, small_batches, table
from foliant.llm.tokens import BYTE_BPE, WORD_BPE, tokenizer

CAPACITY = 4096
#: The end token of each vocabulary: as the packing contract has it, and the vocabulary's end-of-text id.
WORD_END = 1
BYTE_END = 50256
#: Largest table of (partition, length) counts that is broadcast; a larger one is joined by a shuffle.
BROADCAST_CELLS = 2_000_000


class Plan:
    """Steps (length, first rank, uses, rows, first sequence, offset), for look-up by length and rank."""

    def __init__(self, steps: list[tuple[int, int, int, int, int, int]], sequences: int) -> None:
        steps = sorted(steps)
        self.sequences = sequences
        self.length, self.first, self.uses, self.rows, self.base, self.offset = (np.array([s[i] for s in steps], np.int64) for i in range(6))
        self.keys = (self.length << 44) | self.first

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces."""
        at = np.searchsorted(self.keys, (length << 44) | rank, "right") - 1
        k, uses = rank - self.first[at], self.uses[at]
        return self.base[at] + k // uses, self.offset[at] + k % uses * length


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, copies) whose sum comes closest to ``room`` from below. lengths: those with counts, descending."""
    mask, bits, done = (1 << (room + 1)) - 1, 1, []
    for x in lengths:
        if x > room:
            continue
        left, k = min(counts[x], room // x), 1
        while left:
            k = min(k, left)
            done.append((x, k, bits))
            bits |= bits << (x * k) & mask
            left -= k
            k *= 2
        if bits >> room & 1:
            break
    s, out = bits.bit_length() - 1, []
    for x, k, before in reversed(done):
        if not before >> s & 1:
            s -= x * k
            out.append((x, k))
    return out


def plan_min_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts = {x: c for x, c in histogram.items() if c > 0}
    lengths = sorted(counts, reverse=True)
    used = dict.fromkeys(counts, 0)
    steps, sequence = [], 0
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        take = {top: 1}
        for x, k in fullest(counts, lengths, capacity - top):
            take[x] = take.get(x, 0) + k
        counts[top] += 1
        rows = min(counts[x] // k for x, k in take.items())
        offset = 0
        for x in sorted(take, reverse=True):
            steps.append((x, used[x], take[x], rows, sequence, offset))
            offset += x * take[x]
            used[x] += rows * take[x]
            counts[x] -= rows * take[x]
        sequence += rows
        lengths = [x for x in lengths if counts[x]]
    return Plan(steps, sequence)


class RoomTree:
    """Segment tree over 0..capacity: which rooms occur; finds the least that is at least so large."""

    def __init__(self, capacity: int) -> None:
        self.n = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.n)

    def add(self, room: int, k: int) -> None:
        i = room + self.n
        while i:
            self.some[i] += k
            i //= 2

    def at_least(self, room: int) -> int | None:
        i = room + self.n
        if self.some[i]:
            return room
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    tree, open_rows = RoomTree(capacity), {}
    steps, sequence = [], 0

    def keep(room: int, base: int, rows: int) -> None:
        if rows and room:
            open_rows.setdefault(room, []).append((base, rows))
            tree.add(room, 1)

    for x in sorted((x for x, c in histogram.items() if c > 0), reverse=True):
        left, rank = histogram[x], 0
        while left:
            room = tree.at_least(x)
            if room is None:
                room, base, rows = capacity, sequence, -(-left // (capacity // x))
                sequence += rows
            else:
                base, rows = open_rows[room].pop()
                tree.add(room, -1)
            each = room // x  # a row that takes one piece stays the best fit for the next, while it has room
            full = min(rows, left // each)
            if full:
                steps.append((x, rank, each, full, base, capacity - room))
                keep(room - each * x, base, full)
                rank, left = rank + each * full, left - each * full
            if full < rows and left:  # fewer than ``each`` are left
                steps.append((x, rank, left, 1, base + full, capacity - room))
                keep(room - left * x, base + full, 1)
                rank, left, full = rank + left, 0, full + 1
            keep(room, base + full, rows - full)
    return Plan(steps, sequence)


def cut(ids: bytes, capacity: int, width: int = 4) -> list[tuple[int, bytes]]:
    """(start, ids) of a document's pieces."""
    step = capacity * width
    return [(a // width, ids[a : a + step]) for a in range(0, len(ids), step)]


def narrow(ids: bytes, width: int) -> bytes:
    """32-bit ids as ids of ``width`` bytes, 2 or 4; an id that doesn't fit is an error."""
    if width not in (2, 4):
        raise ValueError(f"not a width of ids: {width}")
    own = np.frombuffer(ids, "<u4")
    if width == 2 and len(own) and own.max() > 0xFFFF:
        raise ValueError(f"id {own.max()} needs more than 16 bits; pack with width=4")
    return own.astype(f"<u{width}").tobytes()


def pieces(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, with_ids: bool = False, width: int = 2) -> DataFrame:
    """Every piece of every document: doc_id, piece, start, length, ids_crc32, and where it came up.

    ``part`` is the task, ``nth`` the number of earlier pieces of the same length in it. With ``with_ids`` also the ids
    as unsigned little-endian numbers of ``width`` bytes: 2, or 4 where the vocabulary is larger.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = tokenizer(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                for k, (start, own) in enumerate(cut(ids + last, capacity)):
                    n = len(own) // 4
                    small = narrow(own, width) if with_ids else None
                    rows.append((doc, k, start, n, zlib.crc32(own), part, seen[n], small))
                    seen[n] += 1
            if rows:
                cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)] + [pa.array([r[7] for r in rows], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, part long, nth long" + ", ids binary" * with_ids
    return slim.mapInArrow(run, schema)


def assign(own: DataFrame, planner, capacity: int = CAPACITY, broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces."""
    spark = own.sparkSession
    cells = own.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(planner(histogram, capacity))
    small = cells.count() <= broadcast_cells
    if small:
        got = cells.toPandas().sort_values(["length", "part"])
        got["base"] = got.groupby("length")["n"].cumsum() - got["n"]
        got = got.sort_values(["part", "length"])
        shared = spark.sparkContext.broadcast(((got["part"].to_numpy(np.int64) << 16) | got["length"].to_numpy(np.int64), got["base"].to_numpy(np.int64)))
        ranked = own.withColumn("rank", F.col("nth"))
    else:
        shared = None
        ranked = gapless_rank(own, ["length"], ["part", "nth"], "rank")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in own.schema)}, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
                if shared:
                    keys, base = shared.value
                    rank = rank + base[np.searchsorted(keys, (batch.column("part").to_numpy() << 16) | length)]
                sequence, offset = plan.value.place(length, rank)
                cols = [batch.column(f) for f in batch.schema.names if f != "rank"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=[*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, planner=plan_min_slack, path: str = WORD_BPE, end: int = WORD_END, capacity: int = CAPACITY, with_ids: bool = False, width: int = 2) -> DataFrame:
    """All pieces of ``docs`` with their place. The pieces are tokenized once and written to the scratch folder."""
    return assign(materialise(pieces(docs, path, end, capacity, with_ids, width)), planner, capacity)


def packed_rows(placed: DataFrame, capacity: int = CAPACITY, pad: int = 0, width: int = 2) -> DataFrame:
    """One row per sequence: its id matrix row, cumulative segment lengths and where positions restart.

    ``ids`` has ``capacity`` unsigned little-endian ids of the pieces' ``width``, padded with ``pad``; ``cu_seqlens`` runs from 0 to
    n_tokens; ``position_resets`` are the offsets at which position ids start again from 0, one for each segment.
    """
    dealt = placed.select("sequence_id", "offset", "doc_id", "piece", "length", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    small_batches(dealt.sparkSession, 256)
    schema = "sequence_id long, n_tokens long, cu_seqlens array<bigint>, position_resets array<bigint>, doc_ids array<bigint>, pieces array<bigint>, ids_crc32 long, ids binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, segments = None, []

        def made() -> tuple:
            raw = b"".join(s[3] for s in segments)
            ends = np.cumsum([s[2] for s in segments]).tolist()
            if len(raw) != ends[-1] * width:
                raise ValueError(f"the pieces' ids are not {width} bytes wide")
            full = raw + np.full(capacity - len(raw) // width, pad, f"<u{width}").tobytes()
            return now, ends[-1], [0, *ends], [0, *ends[:-1]], [s[0] for s in segments], [s[1] for s in segments], zlib.crc32(full), full

        for batch in batches:
            for sequence, doc, piece, length, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "doc_id", "piece", "length", "ids")), strict=True):
                if sequence != now and segments:
                    yield made()
                    segments = []
                now = sequence
                segments.append((doc, piece, length, ids))
        if segments:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.int64(), pa.binary()]
        names = ["sequence_id", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "pieces", "ids_crc32", "ids"]
        held: list[tuple] = []
        for row in rows(batches):
            held.append(row)
            if len(held) == 128:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return dealt.mapInArrow(run, schema)


def unpack(rows: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, ids) of every document from packed rows, pieces joined again; ids as little-endian numbers of ``width`` bytes, as packed."""
    cell = F.explode(F.arrays_zip(F.col("doc_ids").alias("d"), F.col("pieces").alias("p"), F.col("position_resets").alias("a"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("b")))
    got = rows.select("ids", cell.alias("s")).select(F.col("s.d").alias("doc_id"), F.col("s.p").alias("piece"), F.expr(f"substring(ids, cast({width} * s.a + 1 as int), cast({width} * (s.b - s.a) as int))").alias("part"))
    own = got.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", F.hex("part").alias("x")))).alias("all"))
    return own.select("doc_id", F.unhex(F.concat_ws("", F.col("all.x"))).alias("ids"))


#: Sequences of one matrix: 64 rows of 4,096 ids of two bytes are 512 KB.
MATRIX_ROWS = 64


def matrices(rows: DataFrame, capacity: int = CAPACITY, width: int = 2, most: int = MATRIX_ROWS) -> DataFrame:
    """Packed rows as id matrices of up to ``most`` rows x ``capacity`` columns, row by row in one piece of memory.

    shape has the numbers of rows and columns, ids the matrix, ids_crc32 its checksum, sequence_ids the number of each
    row; cu_seqlens and position_resets are those of all rows one after another, counted within their row, and
    row_segments says how many segments (doc_ids, pieces) each row has.
    """
    names = ["part", "matrix", "shape", "sequence_ids", "row_segments", "cu_seqlens", "position_resets", "doc_ids", "pieces", "ids_crc32", "ids"]
    lists = pa.list_(pa.int64())

    def made(nth: int, own: list[pa.RecordBatch]) -> pa.RecordBatch:
        tab = pa.Table.from_batches(own)
        ids = b"".join(tab["ids"].to_pylist())
        n = tab.num_rows
        if len(ids) != n * capacity * width:
            raise ValueError(f"rows are not {capacity} ids of {width} bytes")
        flat = lambda c: tab[c].combine_chunks().flatten().to_pylist()
        doc_ids = tab["doc_ids"].combine_chunks()
        cols = [[TaskContext.get().partitionId()], [nth], [[n, capacity]], [tab["sequence_id"].to_pylist()], [[len(x) for x in doc_ids]], [flat("cu_seqlens")], [flat("position_resets")], [flat("doc_ids")], [flat("pieces")], [zlib.crc32(ids)], [ids]]
        types = [pa.int64(), pa.int64(), *[lists] * 7, pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, nth = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                own = batch.slice(0, most - size)
                held.append(own)
                size, batch = size + own.num_rows, batch.slice(own.num_rows)
                if size == most:
                    yield made(nth, held)
                    held, size, nth = [], 0, nth + 1
        if held:
            yield made(nth, held)

    schema = "part long, matrix long, shape array<bigint>, sequence_ids array<bigint>, row_segments array<bigint>, cu_seqlens array<bigint>, position_resets array<bigint>, doc_ids array<bigint>, pieces array<bigint>, ids_crc32 long, ids binary"
    return rows.select("sequence_id", "cu_seqlens", "position_resets", "doc_ids", "pieces", "ids").mapInArrow(run, schema)


def write_matrices(made: DataFrame, folder: str) -> None:
    """Write matrices as uncompressed files below ``folder``: ids lie in them as they are in memory.

    They go through Spark's own writer, so that they reach any shared file system and a lost task leaves nothing behind.
    """
    made.write.option("compression", "none").parquet(folder)


def matrix_of(row, width: int = 2) -> np.ndarray:
    """The id matrix of a row of :func:`matrices`."""
    return np.frombuffer(row["ids"], f"<u{width}").reshape(row["shape"])


def op6_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return matrices(packed_rows(pack(docs, plan_best_fit, BYTE_BPE, BYTE_END, with_ids=True), pad=BYTE_END))


def op10_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").withColumn("piece", F.col("piece").cast("int"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces with their sequence and offset."""
    return pack(docs).select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
