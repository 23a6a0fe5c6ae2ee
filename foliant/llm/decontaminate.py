"""Benchmark decontamination by q-gram lemma filtering.

Benchmark texts are cut into patterns of ``SEGMENT`` bytes (shorter texts are one pattern), and those longer than
1.5 times ``PART`` also into parts of that size at half that stride, so that a quote of 1.5 parts is found. A text region
within k edits of a pattern of m bytes shares at least m - q + 1 - k * q of its q-grams, each from a place of its own in
the text, and those lie on neighbouring diagonals (place in the text minus place in the pattern). So places that share a
q-gram are counted in diagonal bands, each overlapping the next by half; bands that reach the bound are kept, and a
banded alignment confirms them with its exact number of edits. k is ``ERRORS`` of m. Nothing within the budget is
missed: the bound is the lemma's own. Texts below ``SHORT`` bytes allow no edit and have to stand between word borders;
those below q bytes, which have no q-gram, are looked up whole at every word border.

A q-gram that a pattern has many times in one stretch is one entry of the index, and shared places are counted in chunks
of ``PAIRS``, so a text that repeats itself needs no more memory than another. Text is compared in small letters with
white space as single spaces, in UTF-8 bytes; whole texts are searched, in pieces that overlap by more than a pattern
and its band. The benchmark is broadcast in blocks of ``BLOCK_BYTES``. Documents are read and normalised once, whatever
the number of blocks: a task holds ``HELD`` bytes of them and meets the blocks in turn, one in memory at a time.

Defined results: null or empty documents have no leak; benchmark texts that are null or without any sign but white space
are no evidence; a benchmark text that occurs twice is reported under each id; regions of one item that overlap are one;
a document's leaks of one item are one row with their number; an empty table on either side gives no leak.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, table

Q = 8
ERRORS = 0.08
SEGMENT = 160
PART = 80
#: Below this no edit is allowed: 8 % are less than two edits, and one would take all shared q-grams away.
SHORT = 2 * Q
BLOCK_BYTES = 4 << 20
#: Stride of the diagonal bands, which are twice as wide; above the largest edit budget.
STRIDE = 32
PIECE = 1 << 20
PAIRS = 1 << 20
HELD = 32 << 20
#: Candidates that are aligned together.
ALIGNED = 2048
BITS = 21
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Added to diagonals, which may be below 0.
SHIFT = 1 << 20
LOW = (1 << 40) - 1
WORD = np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def cut(raw: bytes) -> list[bytes]:
    """Patterns of a benchmark text: pieces of SEGMENT and of PART bytes at half that stride, the last ones at the end."""
    if not raw:
        return []
    out = [raw] if len(raw) < SEGMENT * 3 // 2 else windows(raw, SEGMENT)
    return list(dict.fromkeys(out + windows(raw, PART))) if len(raw) > PART * 3 // 2 else out


def windows(raw: bytes, size: int) -> list[bytes]:
    return [raw[a : a + size] for a in [*range(0, len(raw) - size, size // 2), len(raw) - size]]


def grams(raw: bytes) -> np.ndarray:
    """The Q bytes from each position on, as one number each."""
    n = len(raw) - Q + 1
    out = np.empty(max(n, 0), np.uint64)
    for a in range(min(Q, max(n, 0))):
        part = np.frombuffer(raw, "<u8", (n - a + Q - 1) // Q, a)
        out[a::Q] = part
    return out


def align(view: np.ndarray, patterns: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates within ``budget``: number, least edits, and where in ``view`` they end.

    A candidate is a pattern (a row; all of one length) against any part of view[start:end], on the 2 * STRIDE +
    2 * budget diagonals from ``low`` on. All go forward together, a byte of the pattern at a time, and those beyond the
    budget drop out.
    """
    width, m = 2 * STRIDE + 2 * budget, patterns.shape[1]
    who, cells, n = np.arange(len(patterns)), np.arange(width, dtype=np.int32), (ends - starts).astype(np.int32)
    low, begin, big = low.astype(np.int32), starts.astype(np.int64), np.int32(1 << 20)
    column = low[:, None] + cells
    row = np.where((column >= 0) & (column <= n[:, None]), np.int32(0), big)  # cell c of row i is column i + low + c
    last = len(view) - 1
    for i in range(m):
        column = low[:, None] + (cells + np.int32(i + 1))
        own = view[np.clip(begin[:, None] + column - 1, 0, last)]
        best = np.where((column >= 1) & (column <= n[:, None]), row + (own != patterns[:, i][:, None]), big)
        np.minimum(best[:, :-1], row[:, 1:] + 1, out=best[:, :-1])  # a pattern byte that the text lacks
        best[(column < 0) | (column > n[:, None])] = big
        row = np.minimum.accumulate(best - cells, axis=1) + cells  # text bytes that the pattern lacks
        if i % 4 == 3 or i == m - 1:
            fits = row.min(axis=1) <= budget
            if not fits.all():
                who, row, low, begin, n, patterns = who[fits], row[fits], low[fits], begin[fits], n[fits], patterns[fits]
                if not len(who):
                    break
    if not len(who):
        return who, who, who
    at = row.argmin(axis=1)
    return who, row[np.arange(len(who)), at], begin + m + low + at


class Patterns:
    """Index of a block of benchmark items: (item id, normalised bytes)."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.items, self.raw, self.longer = [], [], []
        for item, raw in items:
            for p in cut(raw):
                self.items.append(item)
                self.raw.append(p)
                self.longer.append(len(p) != PART or len(raw) == PART)
        self.sizes = np.array([len(p) for p in self.raw], np.int64)
        self.budget = np.where(self.sizes < SHORT, 0, np.floor(ERRORS * self.sizes)).astype(np.int64)
        self.need = self.sizes - Q + 1 - self.budget * Q
        if len(self.raw) and (self.budget.max() >= STRIDE or self.need[self.sizes >= Q].min(initial=1) < 1):
            raise ValueError("the edit budget is too large for this q and band")
        codes = [grams(p) for p in self.raw]
        code = np.concatenate([*codes, np.zeros(0, np.uint64)])
        pattern = np.repeat(np.arange(len(codes)), [len(c) for c in codes]).astype(np.int64)
        place = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)])
        order = np.lexsort((place, pattern, code))
        code, pattern, place = code[order], pattern[order], place[order]
        stretch = place // STRIDE  # places of one code in one stretch are one entry
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (pattern[1:] != pattern[:-1]) | (stretch[1:] != stretch[:-1])
        heads = np.flatnonzero(new)
        self.many = np.diff(np.append(heads, len(code))) > 1
        self.pattern = pattern[heads].astype(np.int32)
        self.place = np.where(self.many, stretch[heads] * STRIDE, place[heads]).astype(np.int32)
        self.keys, self.first, self.count = np.unique(code[heads], return_index=True, return_counts=True)
        self.may = np.zeros(1 << BITS, bool)
        self.may[(self.keys * MIX) >> np.uint64(64 - BITS)] = True
        self.tiny: dict[int, dict[int, list[int]]] = {}  # length: {bytes as a number: patterns}
        for p in np.flatnonzero(self.sizes < Q).tolist():
            own = self.raw[p]
            self.tiny.setdefault(len(own), {}).setdefault(int.from_bytes(own, "little"), []).append(p)

    def bands(self, data: bytes) -> Iterator[np.ndarray]:
        """(pattern << 40) + band of every band with enough places that share a q-gram, each once."""
        codes = grams(data)
        at = np.flatnonzero(self.may[(codes * MIX) >> np.uint64(64 - BITS)])
        if not len(self.keys) or not len(at):
            return
        k = np.searchsorted(self.keys, codes[at])
        k[k == len(self.keys)] = 0
        true = self.keys[k] == codes[at]
        at, k = at[true], k[true]
        ends = np.cumsum(self.count[k])
        held, counts, a, longest = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, int(self.sizes.max())
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            n = self.count[k[a:b]]
            entry = np.repeat(self.first[k[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            own = (self.pattern[entry].astype(np.int64) << 40) | ((np.repeat(at[a:b], n) - self.place[entry] + SHIFT) // STRIDE)
            many = self.many[entry]  # any diagonal of a stretch: one band more
            keys, c = np.unique(np.concatenate([own, own - 1, own[many] - 2]), return_counts=True)
            if len(held):
                keys, back = np.unique(np.concatenate([held, keys]), return_inverse=True)
                c = np.bincount(back, np.concatenate([counts, c])).astype(np.int64)
            final = (keys & LOW) < (int(at[b]) - longest + SHIFT) // STRIDE - 2 if b < len(at) else np.ones(len(keys), bool)
            yield keys[final & (c >= self.need[keys >> 40])]
            held, counts, a = keys[~final], c[~final], b

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of every confirmed region, those of whole patterns first for each text and item."""
        if not self.raw:
            return []
        found: dict[tuple[int, int], list[tuple[int, int, bool, int]]] = {}
        overlap = int(self.sizes.max()) + 4 * STRIDE
        todo: list[tuple[int, int, bytes, bool]] = []
        size = 0

        def run() -> None:
            for i, p, edits, start, end in self._search(todo):
                found.setdefault((i, self.items[p]), []).append((start, end, not self.longer[p], edits))

        for i, raw in enumerate(texts):
            for a in range(0, len(raw), PIECE):
                piece = raw[max(0, a - overlap) : a + PIECE]
                todo.append((i, max(0, a - overlap), piece, a + PIECE >= len(raw)))
                size += len(piece)
                if size >= PIECE:
                    run()
                    todo, size = [], 0
        run()
        out = []
        for (i, item), regions in found.items():
            merged: list[list] = []
            for start, end, part, edits in sorted(regions):
                if merged and start < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                    merged[-1][2] = min(merged[-1][2], (part, edits))
                else:
                    merged.append([start, end, (part, edits)])
            out += [(i, item, best[1], start, end) for start, end, best in sorted(merged, key=lambda m: (m[2], m[0]))]
        return out

    def _search(self, todo: list[tuple[int, int, bytes, bool]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, pattern, edits, start, end) of regions in pieces (text, place in it, bytes, whether it is the last)."""
        if not todo:
            return
        gap = b"\n" * Q  # no normalised text has it, so no q-gram reaches over
        data = gap.join(t[2] for t in todo) + gap
        sizes = np.array([len(t[2]) for t in todo], np.int64)
        starts = np.cumsum(sizes + Q) - sizes - Q
        view = np.frombuffer(data, np.uint8)
        word = WORD[view]
        border = np.ones(len(data) + 1, bool)
        border[1:-1] = ~(word[1:] & word[:-1])
        for (_, shift, _, last), a, n in zip(todo, starts.tolist(), sizes.tolist(), strict=True):
            border[a], border[a + n] = not shift, last  # where a text is cut, its next or last piece tells
        if self.tiny:
            codes, edges = grams(data), np.flatnonzero(border[: len(data) - Q + 1])
            for n, own in self.tiny.items():
                at = edges[border[edges + n]]
                code = codes[at] & np.uint64((1 << (8 * n)) - 1)
                known = np.array(sorted(own), np.uint64)
                spot = np.minimum(np.searchsorted(known, code), len(known) - 1)
                for x, c in zip(at[known[spot] == code].tolist(), code[known[spot] == code].tolist(), strict=True):
                    t = int(np.searchsorted(starts, x, "right")) - 1
                    for p in own[c]:
                        yield todo[t][0], p, 0, x - int(starts[t]) + todo[t][1], x - int(starts[t]) + todo[t][1] + n
        open_: dict[int, list[tuple[int, int, int, int, int]]] = {}  # by length: pattern, piece, start, end, first diagonal
        for keys in self.bands(data):
            for key in keys.tolist():
                yield from self._find(key >> 40, (key & LOW) * STRIDE - SHIFT, data, border, todo, starts, sizes, open_)
            for n in [n for n, own in open_.items() if len(own) >= ALIGNED]:
                yield from self._aligned(open_.pop(n), view, todo, starts)
        for own in open_.values():
            yield from self._aligned(own, view, todo, starts)

    def _find(self, p: int, low: int, data: bytes, border: np.ndarray, todo, starts: np.ndarray, sizes: np.ndarray, open_: dict[int, list]) -> Iterator[tuple[int, int, int, int, int]]:
        """Exact regions of pattern p on the diagonals from ``low`` on; where there is none, ``open_`` gets a candidate."""
        own, k = self.raw[p], int(self.budget[p])
        m, short = len(own), len(own) < SHORT
        a, b = low - k, low + 2 * STRIDE + m + k
        first = max(0, int(np.searchsorted(starts, max(a, 0), "right")) - 1)
        for t in range(first, min(int(np.searchsorted(starts, max(b, 0), "right")), len(todo))):
            x, y = max(a, int(starts[t])), min(b, int(starts[t] + sizes[t]))
            if y - x < m - k:
                continue
            i, back = todo[t][0], todo[t][1] - int(starts[t])
            hit, at = False, data.find(own, x, y)
            while at >= 0:
                if not short or border[at] and border[at + m]:
                    hit = True
                    yield i, p, 0, at + back, at + m + back
                    at = data.find(own, at + m, y)
                else:
                    at = data.find(own, at + 1, y)
            if not hit and k:
                open_.setdefault(m, []).append((p, t, x, y, a - x))

    def _aligned(self, found: list[tuple[int, int, int, int, int]], view: np.ndarray, todo, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Regions among candidates whose patterns have one length."""
        m = len(self.raw[found[0][0]])
        for a in range(0, len(found), ALIGNED):
            part = found[a : a + ALIGNED]
            own = np.frombuffer(b"".join(self.raw[c[0]] for c in part), np.uint8).reshape(-1, m)
            x, y, low = (np.array([c[j] for c in part]) for j in (2, 3, 4))
            for j, edits, end in zip(*(z.tolist() for z in align(view, own, x, y, low, int(self.budget[part[0][0]]))), strict=True):
                p, t = part[j][:2]
                end += todo[t][1] - int(starts[t])
                yield todo[t][0], p, edits, max(0, end - m), end


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Patterns]:
    """The benchmark's patterns, a block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for b in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        yield Patterns(sorted(((r["item_id"], normal(r["text"])) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def searched(batches: Iterator[pa.RecordBatch], shared: list, text: str, held: int = HELD) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, int, int]]]]:
    """Each batch with its regions; with several blocks, batches of ``held`` bytes together meet one block after the other."""
    group: list[tuple[pa.RecordBatch, list[bytes]]] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, int, int]]]]:
        found: list[list] = [[] for _ in group]
        for s in shared:
            patterns = s.value
            for f, (_, texts) in zip(found, group, strict=True):
                f += patterns.search(texts)
            if len(shared) > 1:
                del patterns
                s.__dict__.pop("_value", None)  # read from the executor's disk again when its turn comes
        yield from ((batch, f) for (batch, _), f in zip(group, found, strict=True))

    for batch in batches:
        if batch.num_rows:
            group.append((batch, [normal(t) for t in batch.column(text).to_pylist()]))
            size += sum(map(len, group[-1][1]))
            if len(shared) <= 1 or size >= held:
                yield from flush()
                group, size = [], 0
    yield from flush()


LEAKS = "doc_id long, item_id long, n_regions long, edits long, start long, end long"


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document and benchmark item that it holds: regions confirmed, least edits, and the first such region.

    start and end are bytes of the normalised text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = [spark.sparkContext.broadcast(p) for p in blocks(benchmark, block_bytes)]
    if not shared:
        return spark.createDataFrame([], LEAKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, regions in searched(batches, shared, "text"):
            ids, found = batch.column("doc_id").to_pylist(), {}
            for i, item, edits, a, b in regions:
                found.setdefault((i, item), []).append((edits, a, b))
            rows = [(ids[i], item, len(r), *r[0]) for (i, item), r in sorted(found.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=["doc_id", "item_id", "n_regions", "edits", "start", "end"])

    return slim.mapInArrow(run, LEAKS)


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no benchmark text; all columns stay as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = [spark.sparkContext.broadcast(p) for p in blocks(benchmark, block_bytes)]
    if not shared:
        return docs
    names = [f"__k{i}" for i in range(len(docs.columns))]
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    text = names[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, regions in searched(batches, shared, text):
            bad = {m[0] for m in regions}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

    return slim.mapInArrow(run, slim.schema).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark text; all columns stay as they are."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
