"""Toxicity by multiple-instance learning: sentences are the instances, the label belongs to the document.

A sentence with features S has p = sigmoid(b + sum of w over S); a document has 1 - prod(1 - p) over the sentences of
its worst stretch of ``WINDOW`` (noisy-or; a shorter document is one stretch). Only document labels train w and b;
afterwards the sentence probabilities locate the offending sentences: those with p >= ``THRESHOLD`` anywhere and, in a
document that scores as much, the fewest sentences of its worst stretch whose own noisy-or reaches it, likeliest first.
So a document that is marked has a sentence that is located.
Features are the words of a sentence and the 4- to 6-character pieces of its words with their ends marked. Training
keeps those whose document counts speak for toxicity (log-likelihood ratio); all other sentences share the score of b.

Over all sentences at once the small p of unremarkable ones, with or without features, would add up with length until
any long clean text scored 1; over a stretch they can't. Training reads labelled texts of any length whole; executors
reduce them to their words and then to feature sets, so the driver never holds a text.

Defined results: null and empty texts have no sentence and score 0; null doc_id counts as the empty text in the fold;
conflicting or repeated labels of one id count as toxic if any is; without labelled rows every score is 0. Text, and
nothing else, is an input of a score; every sentence of a text counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import drop_table, held_out, materialise, small_batches, table

#: Expected rows of the training sample.
SAMPLE_ROWS = 8_000
MAX_FEATURES = 1024
MIN_LLR = 12.0
MIN_TOXIC_DOCS = 3
GRAMS = (4, 5, 6)
THRESHOLD = 0.5
#: Consecutive sentences whose noisy-or is taken; the highest of a document is its score.
WINDOW = 32
#: Words whose weight a worker remembers.
MEMORY = 400_000

SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)")
WORD = re.compile(r"[^\W_]+")


def pieces(word: str) -> set[str]:
    """The word itself (marked at both ends) and its character pieces."""
    w = f"^{word}$"
    return {w, *(w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))}


class Model:
    def __init__(self, weights: dict[str, float], bias: float, memory: int = MEMORY) -> None:
        self.weights, self.bias, self.most, self.memory = weights, bias, memory, {}

    def word(self, word: str) -> tuple[str, ...]:
        """The kept features of a word."""
        out = self.memory.get(word)
        if out is None:
            if len(self.memory) >= self.most:
                self.memory.clear()
            out = self.memory[word] = tuple(sorted(f for f in pieces(word) if f in self.weights))
        return out

    def sentence(self, features: set[str]) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + sum(self.weights[f] for f in sorted(features))))))

    def document(self, text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Noisy-or score, number of sentences, and (start, end, p) of the offending sentences."""
        lower = text.lower() if text.isascii() else text  # offsets are those of the text itself
        base, spans, logs, run, log_clean, worst, found = self.sentence(set()), [], [], 0.0, 0.0, 0, []
        if not WORD.search(text):
            return 0.0, 0, []
        for m in SENTENCE.finditer(lower):
            words = WORD.findall(m[0] if lower is not text else m[0].lower())
            if not words:
                continue
            features = {f for w in set(words) for f in self.word(w)}
            p = self.sentence(features) if features else base
            spans.append((m.start(), m.end(), p))
            logs.append(math.log1p(-min(p, 1 - 1e-15)))
            run += logs[-1] - (logs[-1 - WINDOW] if len(logs) > WINDOW else 0.0)
            if run < log_clean:
                log_clean, worst = run, len(logs)
            if p >= THRESHOLD:
                found.append(len(logs) - 1)
        score = 0.0 - math.expm1(log_clean)
        if score >= THRESHOLD and not any(worst - WINDOW <= i < worst for i in found):
            left = math.log1p(-THRESHOLD)
            for i in sorted(range(max(0, worst - WINDOW), worst), key=lambda i: (logs[i], i)):
                found.append(i)
                left -= logs[i]
                if left >= 0:
                    break
        return score, len(spans), [spans[i] for i in sorted(found)]


def words_of(text: str) -> str:
    """The different words of a text, in small letters."""
    return " ".join(sorted(set(WORD.findall(text.lower()))))


def choose_features(docs: list[tuple[str, int]]) -> dict[str, int]:
    """Features whose document counts speak for toxicity most, numbered. docs: (:func:`words_of` a text, label)."""
    toxic = Counter()
    for words, label in docs:
        if label:
            toxic.update(set().union(*map(pieces, words.split())))
    toxic = {f: a for f, a in toxic.items() if a >= MIN_TOXIC_DOCS}
    chooser, seen = Model(toxic, 0.0, memory=50_000), Counter()
    for words, _ in docs:
        seen.update({f for w in words.split() for f in chooser.word(w)})
    n, t = len(docs), sum(y for _, y in docs)

    def xlogx(*x: float) -> float:
        return sum(v * math.log(v) for v in x if v > 0)

    scored = []
    for f, a in toxic.items():
        b = seen[f] - a
        if a * (n - t) > b * t:
            llr = 2 * (xlogx(a, b, t - a, n - t - b) + xlogx(n) - xlogx(a + b, n - a - b) - xlogx(t, n - t))
            if llr >= MIN_LLR:
                scored.append((-llr, f))
    return {f: i for i, (_, f) in enumerate(sorted(scored)[:MAX_FEATURES])}


def instances(text: str, number: dict[str, int], chooser: Model) -> tuple[int, list[tuple[int, list[int]]]]:
    """Sentences without features, and (number of sentences, features) for each set of features that occurs."""
    bare, sets = 0, Counter()
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m[0].lower())
        if words:
            features = tuple(sorted({number[f] for w in set(words) for f in chooser.word(w)}))
            if features:
                sets[features] += 1
            else:
                bare += 1
    return bare, [(k, list(f)) for f, k in sorted(sets.items())]


def fit(docs: list[tuple[str, int]]) -> Model | None:
    """The model of whole texts. docs: (text, label)."""
    if not docs or not any(y for _, y in docs):
        return None
    number = choose_features([(words_of(t), y) for t, y in docs])
    chooser = Model(dict.fromkeys(number, 0.0), 0.0)
    return fit_instances(number, [(y, *instances(t, number, chooser)) for t, y in docs])


def fit_instances(number: dict[str, int], docs: list[tuple[int, int, list[tuple[int, list[int]]]]], steps: int = 400, rate: float = 0.3, l2: float = 2e-4, l2_rows: float = 0.5) -> Model:
    """Full-batch Adam on the noisy-or log-likelihood. docs: (label, *:func:`instances` of a text)."""
    owner, cells, heads, times = [], [], [], []  # sets of features: their document, features, where they begin, sentences
    y, bare = np.array([d[0] for d in docs], float), np.array([d[1] for d in docs], float)
    for d, (_, _, sets) in enumerate(docs):
        for k, features in sets:
            heads.append(len(cells))
            cells.extend(features)
            owner.append(d)
            times.append(k)
    owner, cells, heads, times = np.array(owner, int), np.array(cells, int), np.array(heads, int), np.array(times, float)
    sizes = np.diff(np.append(heads, len(cells))) if len(heads) else np.zeros(0, int)
    sentence_of = np.repeat(np.arange(len(heads)), sizes)
    w, b = np.zeros(len(number)), -6.0
    moment, spread = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = b + (np.add.reduceat(w[cells], heads) if len(heads) else np.zeros(0))
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -40, 40))), 1 / (1 + math.exp(-b))
        clean = np.bincount(owner, times * np.log1p(-np.minimum(p, 1 - 1e-12)), len(docs)) + bare * math.log1p(-p0)
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        # d loglik / d z_s = p_s * (y (1 - P) / P - (1 - y))
        pull = y * (1 - toxic) / toxic - (1 - y)
        gs = times * p * pull[owner]
        grad = np.append(np.bincount(cells, gs[sentence_of], len(w)), gs.sum() + (pull * bare).sum() * p0) / len(docs)
        grad[:-1] -= (l2 + l2_rows / len(docs)) * w
        moment = 0.9 * moment + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8) / (1 + step / 100)
        w, b = w + move[:-1], min(b + move[-1], -2.0)
    return Model({f: float(w[i]) for f, i in number.items()}, float(b))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents outside the held-out fold, chosen by a hash of the id."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    n = marks.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    marks = marks.where(draw < min(1.0, rows / max(n, 1))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    slim = docs.select("doc_id", "text").where((F.length("text") > 0) & (draw < min(1.0, rows / max(n, 1))))
    return slim.join(marks, "doc_id").select(F.col("text").cast("string").alias("text"), "toxic")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The sample's texts stay on the executors; their words come to the driver, and then their feature sets."""
    small_batches(docs.sparkSession)
    sample = materialise(training_sample(docs, labels, rows))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(words_of, batch.column("text").to_pylist()), pa.string()), batch.column("toxic")], names=["words", "toxic"])

    bags = [(r["words"], r["toxic"]) for r in sample.mapInArrow(words, "words string, toxic int").collect()]
    if not any(y for _, y in bags):
        drop_table(sample)
        return None
    number = choose_features(bags)
    sets = pa.list_(pa.struct([("n", pa.int64()), ("features", pa.list_(pa.int64()))]))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser = Model(dict.fromkeys(number, 0.0), 0.0)
        for batch in batches:
            out = [instances(t, number, chooser) for t in batch.column("text").to_pylist()]
            own = pa.array([[{"n": k, "features": f} for k, f in x[1]] for x in out], sets)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x[0] for x in out], pa.int64()), own], names=["toxic", "bare", "sets"])

    found = sample.mapInArrow(reduced, "toxic int, bare long, sets array<struct<n:bigint,features:array<bigint>>>").collect()
    drop_table(sample)
    return fit_instances(number, sorted((r["toxic"], r["bare"], [(x["n"], list(x["features"])) for x in r["sets"]]) for r in found))


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns of ``docs`` with score, n_sentences and ``offending``: (start, end, p) of toxic sentences.

    The new columns' names begin with ``prefix``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = docs.columns if keep is None else keep
    shared = spark.sparkContext.broadcast(model and (model.weights, model.bias))
    names = [f"__k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").cast("string").alias("__text"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value) if shared.value else None
        for batch in batches:
            if batch.num_rows:
                out = [own.document(t or "") if own else (0.0, 0, []) for t in batch.column("__text").to_pylist()]
                found = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in x[2]] for x in out], spans)
                cols = [batch.column(n) for n in names] + [pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int64()), found]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "__score", "__n", "__spans"])

    schema = ", ".join([*(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names), "__score double", "__n long", "__spans array<struct<start:bigint,end:bigint,p:double>>"])
    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("__score").alias(f"{prefix}score"), F.col("__n").alias(f"{prefix}n_sentences"), F.col("__spans").alias(f"{prefix}offending"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    worst = F.try_element_at(F.array_sort("offending", lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0)), F.lit(1))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_sentences", F.size("offending").alias("n_offending"), worst["start"].alias("worst_start"), worst["end"].alias("worst_end"),
    )


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a score below ``THRESHOLD``; all columns stay as they are."""
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), prefix="__new_")
    return out.where(F.col("__new_score") < THRESHOLD).select(*docs.columns)
