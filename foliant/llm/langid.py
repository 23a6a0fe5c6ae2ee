"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of up to ``ORDER`` bytes of context, counted on a bounded sample of labelled
texts and then frozen. A byte costs -log2(c / (n + q)) in the longest context that has seen it (c: its count, n: all
counts, q: distinct bytes there), plus -log2(q / (n + q)) for the escape from every longer context that exists; bytes
never seen cost 8 bits below order 0. A text's language is the one with the shortest exact code length.

Since the statistics are frozen, the cost of a byte depends only on the ORDER + 1 bytes that end with it. The rows of
costs (one column per language) of all grams that training saw are kept in open-addressing hash tables and looked up
for all bytes of a batch at once.

Defined results: null text, empty text or text without a letter (Unicode category L): ``und``, score 0. No training rows: ``und`` for all.
A null doc_id counts as the empty text in the fold; every value of ``lang`` is a language with a tree of its own, so
the model grows with their number, which is that of languages, not of rows; equal code lengths go to the first language in code-point order.
ASCII capitals are read as small letters. Every text is coded whole, in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import held_out, small_batches, table

ORDER = 4
PIECE = 1 << 19
#: Bounds of the training sample: rows expected per language, and the longest text used for training, in characters.
SAMPLE_ROWS = 600
SAMPLE_CHARS = 20_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SIGN = re.compile(r"[^\W\d_]")
PAD = b" " * ORDER
NONE = np.uint64(0)


def has_letter(text: str) -> bool:
    """Whether a character of a Unicode letter category occurs; number signs such as a half or a superscript are none."""
    return any(m[0].isalpha() for m in SIGN.finditer(text))


class GramTable:
    """Rows of float32 under uint64 keys: open addressing with linear probing, all look-ups vectorised."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slot_keys, self.slot_rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.rows = np.vstack([np.zeros((1, rows.shape[1]), np.float32), rows.astype(np.float32)])
        keys, left = keys + np.uint64(1), np.arange(len(keys))
        at = self.home(keys)
        while len(left):
            free = self.slot_keys[at[left]] == NONE
            cells, first = np.unique(at[left][free], return_index=True)
            who = left[free][first]
            self.slot_keys[cells], self.slot_rows[cells] = keys[who], who + 1
            left = left[~np.isin(left, who)]
            at[left] = (at[left] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers of the keys, 0 where a key is absent."""
        keys = keys + np.uint64(1)
        at = self.home(keys)
        seen = self.slot_keys[at]
        out = np.where(seen == keys, self.slot_rows[at], 0)
        left = np.flatnonzero((seen != keys) & (seen != NONE))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            seen = self.slot_keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.slot_rows[at[left[hit]]]
            left = left[~hit & (seen != NONE)]
        return out


def gram_keys(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each position from n - 1 on, packed big-endian."""
    out = np.zeros(len(data) - n + 1, np.uint64)
    for i in range(n):
        out <<= np.uint64(8)
        out |= data[i : len(data) - n + 1 + i].astype(np.uint64)
    return out


class PPM:
    """Frozen context trees of several languages."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER) -> None:
        self.langs, self.order = sorted(samples), order
        streams = [LOWER[np.frombuffer(b"".join(b" " * order + t for t in samples[k]), np.uint8)] for k in self.langs]
        lower = np.full((256, len(self.langs)), 8.0)
        self.tables: list[tuple[GramTable, GramTable]] = []
        for k in range(order + 1):
            found = [np.unique(gram_keys(s, k + 1), return_counts=True) if len(s) > k else (np.zeros(0, np.uint64), np.zeros(0, int)) for s in streams]
            keys = np.unique(np.concatenate([x for x, _ in found]))
            counts = np.zeros((len(keys), len(self.langs)))
            for j, (x, c) in enumerate(found):
                counts[np.searchsorted(keys, x), j] = c
            context = keys >> np.uint64(8)
            heads, first, back = np.unique(context, return_index=True, return_inverse=True)
            n = np.add.reduceat(counts, first, axis=0) if len(keys) else np.zeros((0, len(self.langs)))
            q = np.add.reduceat((counts > 0).astype(float), first, axis=0) if len(keys) else n
            escape = np.where(n > 0, -np.log2(np.maximum(q, 1) / np.maximum(n + q, 1)), 0.0)
            if k:
                prior = self.cost_rows(keys & np.uint64((1 << (8 * k)) - 1), k - 1)
            else:
                prior = lower[keys.astype(int)]
            cost = np.where(counts > 0, -np.log2(np.maximum(counts, 1) / np.maximum((n + q)[back], 1)), escape[back] + prior)
            self.tables.append((GramTable(keys, cost), GramTable(heads, escape)))

    def cost_rows(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits of each gram's last byte, one column per language. keys: grams of order + 1 bytes."""
        grams, escapes = self.tables[order]
        at = grams.find(keys)
        out = grams.rows[at]
        left = np.flatnonzero(at == 0)
        if len(left):
            out[left] = escapes.rows[escapes.find(keys[left] >> np.uint64(8))]
            out[left] += self.cost_rows(keys[left] & np.uint64((1 << (8 * order)) - 1), order - 1) if order else np.float32(8.0)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every whole text under every language."""
        out = np.zeros((len(texts), len(self.langs)))
        pad = b" " * self.order
        todo: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), PIECE):
                piece = (t[a - self.order : a] if a else pad) + t[a : a + PIECE]
                todo.append((i, piece))
                size += len(piece)
                if size >= PIECE:
                    self._code(todo, out)
                    todo, size = [], 0
        self._code(todo, out)
        return out

    def _code(self, todo: list[tuple[int, bytes]], out: np.ndarray) -> None:
        if not todo:
            return
        data = LOWER[np.frombuffer(b"".join(p for _, p in todo), np.uint8)]
        ends = np.cumsum([len(p) for _, p in todo])
        starts = ends - [len(p) for _, p in todo]
        costs = self.cost_rows(gram_keys(data, self.order + 1), self.order)
        for k, (i, _) in enumerate(todo):  # a piece's own bytes follow its context
            out[i] += costs[starts[k] : ends[k] - self.order].sum(axis=0, dtype=float)


def training_sample(docs: DataFrame, rows_per_lang: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, text): about ``rows_per_lang`` rows of each language outside the held-out fold, chosen by a hash of the id."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0) & (F.length("text") <= max_chars))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")).collect()  # one row for each language
    if not sizes:
        return known.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, rows_per_lang / r["__n"]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    return known.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")


def train(docs: DataFrame, rows_per_lang: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> PPM | None:
    samples: dict[str, list[bytes]] = {}
    for r in sorted(training_sample(docs, rows_per_lang, max_chars).collect()):
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return PPM(samples) if samples else None


def classify(model: PPM | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior under equal priors, and bits per byte in that language."""
    letters = np.array([has_letter(t) for t in texts], bool)
    if model is None or not letters.any():
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    raw = [t.encode() if ok else b"" for t, ok in zip(texts, letters, strict=True)]
    bits = model.code_lengths(raw)
    best = bits.argmin(axis=1)
    least = bits.min(axis=1)
    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
    names = [model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, score, 0.0), np.where(letters, least / np.maximum([len(x) for x in raw], 1), 0.0)


def predict(docs: DataFrame, model: PPM | None, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score and bits_per_byte of the whole text, under names with ``prefix``."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = docs.columns if keep is None else keep
    shared = spark.sparkContext.broadcast(model)
    names = [f"__k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang, score, bits = classify(shared.value, [x or "" for x in batch.column("__text").to_pylist()])
                cols = [batch.column(n) for n in names] + [pa.array(lang, pa.string()), pa.array(score), pa.array(bits)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "__lang", "__score", "__bits"])

    schema = ", ".join([*(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names), "__lang string", "__score double", "__bits double"])
    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("__lang").alias(f"{prefix}lang_pred"), F.col("__score").alias(f"{prefix}score"), F.col("__bits").alias(f"{prefix}bits_per_byte"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs), keep=["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


#: The pipeline drops documents that no language can be given.
MIN_SCORE = 0.5


def langid_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that get a language with a posterior of at least ``MIN_SCORE``; all columns stay as they are."""
    out = predict(docs, train(docs), prefix="__new_")
    return out.where((F.col("__new_lang_pred") != "und") & (F.col("__new_score") >= MIN_SCORE)).select(*docs.columns)
