"""Exact Jaccard self-join of word shingles, by count-vector R-trees.

A document's set is its distinct k-word shingles (words as 64-bit hashes). Hashing the shingles into ``GROUPS`` groups
gives a point of counts, and the summed minima of two points bound the overlap of the two sets from above. Pairs whose
bound is too small for the threshold are never looked at; the rest are verified on the sets.

How it is spread out:

1. A set with more than ``(1 - t) * n`` shingles that no other set has is linked with nothing. The shingles of one hash
   class, a fixed share of all hashes, are counted over all documents; sets that have so many unique ones in it alone
   are done. A task sends equal sets once and a shingle once, so frequent shingles stay small.
2. The other sets are counted into hashed counts, a few for each set, the frequency order. It affects speed, never the result.
   Two sets at the threshold share one of the rarest ``n - ceil(t * n) + 1`` shingles of each, so every set is sent to
   those keys with its size and its point. Keys with more than ``HOT`` sets are cut into blocks that meet in pairs.
3. Within a key, an R-tree over the points (boxes of sizes and largest counts) finds the pairs that pass the bound.
   They are recorded as a forest: a pair that the task has already connected adds nothing.
4. The forests' components are clusters of candidates, which hold every true link. In each, pairs are verified on the
   sets, skipping those already connected. In clusters of more than ``BLOCK`` sets all are first compared with one
   pivot, and the triangle inequality leaves only some blocks to meet in pairs.

Nothing is sampled or capped and no pair is lost; hot keys, copies and clusters are split, not gathered. Equal sets share
a node (a hash of the set; another 64 bits tell sets apart whose nodes happen to be the same) and meet their documents
again in one join at the end, in which the copies of one text are dealt to many tasks.

Defined results: texts without words have the empty set, size 0, and are linked with nothing; shorter texts than k words
have their whole sequence as one shingle; a null doc_id is never smallest, and its component is that of its text or
null; repeated rows are copies of each other; component ids are the smallest doc_id reachable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_ROWS, connected_components, drop_table, match, materialise, parts, scratch_dir, small_batches, spread_join, table

GROUPS = 32
#: Least and most hashed counts of the frequency order (powers of two), and counts for each set.
BUCKETS, MOST_BUCKETS, BUCKETS_PER_SET = 1 << 17, 1 << 21, 4
#: Share of all hashes whose shingles are counted, as a multiple of 1 - t; and how many a task holds at once.
CLASS_SHARE = 1.8
CHUNK = 1 << 20
HOT = 8_192
BLOCK = 128
LEAF = 32

MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xD6E8FEB86659FD93)
HALF = np.uint64(32)


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> HALF)) * TURN
    return (x ^ (x >> HALF)) * TURN


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D part words
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")
    width = min(n, k)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = stir(out * MIX + w[i : n - width + 1 + i])
    return np.unique(out)


def scale(n):
    """Unit in which a set of n shingles counts its groups, so that a byte holds a count."""
    return 1 + n // 4096


def point(own: np.ndarray) -> np.ndarray:
    """Group counts in units, rounded up; 255 stands for that or more."""
    counts = np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=GROUPS)
    return np.minimum(-(-counts // scale(len(own))), 255).astype(np.uint8)


def counts_of(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Upper bounds of the group counts of points in rows."""
    return np.where(v == 255, n[:, None], np.minimum(v * scale(n)[:, None], n[:, None])).astype(np.int32)


def node_of(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: its node, and what tells sets of one node apart."""
    raw = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


class Rule:
    """Jaccard similarity of at least num / den, on words in k-word shingles."""

    def __init__(self, k: int = 3, num: int = 90, den: int = 100) -> None:
        self.k, self.num, self.den = k, num, den

    def prefix(self, n: int) -> int:
        return n + self.num * -n // self.den + 1  # n - ceil(t n) + 1

    def sizes(self, least, most):
        """Whether two sizes (arrays) can be similar."""
        return self.den * least >= self.num * most

    def overlap(self, shared, total):
        """Whether ``shared`` common elements are enough for sets of ``total`` elements together."""
        return (self.num + self.den) * shared >= self.num * total

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        return self.nearness(a, b) == 0

    def nearness(self, a: np.ndarray, b: np.ndarray) -> int:
        """0: similar, 1: at up to twice the distance that this allows, 2: farther."""
        both = len(np.intersect1d(a, b, assume_unique=True))
        every = len(a) + len(b) - both
        return 0 if self.den * both >= self.num * every else 1 if self.den * both >= (2 * self.num - self.den) * every else 2


def bound_ok(rule: Rule, va: np.ndarray, na, vb: np.ndarray, nb) -> np.ndarray:
    """The count bound for points in rows."""
    return rule.overlap(np.minimum(va, vb).sum(axis=-1, dtype=np.int64), na + nb)


class CountTree:
    """Packed R-tree over points sorted by size and counts; boxes keep size ranges and largest counts."""

    def __init__(self, n: np.ndarray, v: np.ndarray) -> None:
        order = np.lexsort((*v.T[::8], v[:, : GROUPS // 2].sum(1, dtype=np.int64), n))
        self.order, self.n, self.v = order, n[order], v[order]
        heads = np.arange(0, len(n), LEAF)
        self.heads, self.ends = heads, np.minimum(heads + LEAF, len(n))
        self.low, self.high = self.n[heads], np.maximum.reduceat(self.v, heads, axis=0)
        top = np.arange(0, len(heads), LEAF)
        self.top, self.top_low, self.top_high = top, self.low[top], np.maximum.reduceat(self.high, top, axis=0)

    def leaves(self, rule: Rule, i: int, first: int) -> np.ndarray:
        """Leaves before point i, from that of point ``first`` on, that may hold a partner."""
        a, b = first // LEAF, i // LEAF + 1
        tops = np.arange(a // LEAF, (b - 1) // LEAF + 1)
        ok = bound_ok(rule, self.top_high[tops], self.top_low[tops], self.v[i], self.n[i])
        out = [np.arange(max(a, t * LEAF), min(b, (t + 1) * LEAF)) for t in tops[ok]]
        if not out:
            return np.zeros(0, np.int64)
        leaves = np.concatenate(out)
        return leaves[bound_ok(rule, self.high[leaves], self.low[leaves], self.v[i], self.n[i])]

    def join(self, rule: Rule, verify=None, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
        """A forest over the pairs that pass the bound (and ``verify``), in the points' own numbers.

        labels: points with equal labels count as connected from the start.
        """
        n, out = len(self.n), []
        label = np.arange(n) if labels is None else np.unique(labels[self.order], return_inverse=True)[1]
        start = np.searchsorted(self.n * rule.den, self.n * rule.num)
        for i in range(1, n):
            if start[i] >= i:
                continue
            left = self.leaves(rule, i, int(start[i]))[::-1]  # the nearest sizes first
            for leaf in left:
                at = np.arange(max(self.heads[leaf], start[i]), min(self.ends[leaf], i))
                at = at[label[at] != label[i]]
                if not len(at):
                    continue
                at = at[bound_ok(rule, self.v[at], self.n[at], self.v[i], self.n[i])]
                for j in at[::-1].tolist():
                    if label[j] != label[i] and (verify is None or verify(int(self.order[i]), int(self.order[j]))):
                        out.append((int(self.order[i]), int(self.order[j])))
                        a, b = label[i], label[j]
                        label[label == max(a, b)] = min(a, b)
        return out


def frequency_order(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Hashed document counts of all shingles: a few for each set, MOST_BUCKETS at most."""
    k, buckets = rule.k, BUCKETS
    sets = docs.count()
    while buckets < min(MOST_BUCKETS, BUCKETS_PER_SET * sets):
        buckets *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            got = [shingles(t, k) for t in batch.column("text").to_pylist()]
            if got:
                total += np.bincount((np.concatenate(got) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 65_536):
            part = at[a : a + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["bucket", "n"])

    sums = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def rare_keys(own: np.ndarray, rule: Rule, counts: np.ndarray) -> np.ndarray:
    """The set's prefix in the frequency order; ties of the order come along whole."""
    rank = (np.minimum(counts[(own % np.uint64(len(counts))).astype(np.int64)], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (own >> np.uint64(24))
    p = rule.prefix(len(own))
    return own if p >= len(own) else own[rank <= np.partition(rank, p - 1)[p - 1]]


def in_class(own: np.ndarray, rule: Rule) -> np.ndarray:
    """The shingles of the counted hash class."""
    return own[((own >> np.uint64(8)) & np.uint64(0xFFFF)) < np.uint64(min(1 << 16, int(CLASS_SHARE * (1 << 16) * (rule.den - rule.num) / rule.den)))]


def surveyed(slim: DataFrame, rule: Rule) -> DataFrame:
    """Rows of three kinds, from one reading of the texts.

    doc (doc_id, th, node, n, key): every document; key tells sets of one node apart. sent (node, n, c, s): a set that the task came upon first, its shingles
    in the class, and how many of them other sets of the task have. hash (key, node): a class shingle and its set, or
    node 0 where several sets of the task have it.
    """
    names = ["kind", "doc_id", "th", "node", "n", "c", "s", "key"]

    def rows(kind: str, many: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * many), *(cols.get(c, pa.nulls(many, pa.int64())) for c in names[1:])], names=names)

    def flush(held: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        which = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        keys = np.concatenate([h[2] for h in held])
        order = np.argsort(keys, kind="stable")
        keys, which = keys[order], which[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        sizes = np.diff(np.append(np.flatnonzero(new), len(keys)))
        several = np.repeat(sizes > 1, sizes)
        shared = np.bincount(which[several], minlength=len(held))
        node, n = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
        yield rows("sent", len(held), node=pa.array(node), n=pa.array(n), c=pa.array([len(h[2]) for h in held], pa.int64()), s=pa.array(shared))
        owner = np.where(several, -1, which)[new]
        by_set = np.argsort(owner, kind="stable")  # a set's rows follow one another, which files and shuffles pack well
        keys, owner = keys[new].view(np.int64)[by_set], np.append(node, 0)[owner[by_set]]
        for a in range(0, len(keys), 16_384):
            yield rows("hash", len(keys[a : a + 16_384]), key=pa.array(keys[a : a + 16_384]), node=pa.array(owner[a : a + 16_384]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, sizes = [], []
            for t in batch.column("text").to_pylist():
                own = shingles(t, rule.k)
                nodes.append(node_of(own) if len(own) else (0, 0))
                sizes.append(len(own))
                if len(own) and nodes[-1] not in sent:
                    sent.add(nodes[-1])
                    held.append((nodes[-1][0], len(own), in_class(own, rule)))
                    size += len(held[-1][2])
                    if size >= CHUNK:
                        yield from flush(held)
                        held, size = [], 0
            yield rows("doc", len(nodes), doc_id=batch.column("doc_id"), th=batch.column("th"), node=pa.array([x for x, _ in nodes], pa.int64()), n=pa.array(sizes, pa.int64()), key=pa.array([x for _, x in nodes], pa.int64()))
        if held:
            yield from flush(held)

    return slim.mapInArrow(run, "kind string, doc_id long, th long, node long, n long, c long, s long, key long")


def shared_counts(hashes: DataFrame) -> DataFrame:
    """(node, s): shingles of the node that sets of other tasks have too, by task."""
    dealt = hashes.repartition(parts(hashes.sparkSession), "key").sortWithinPartitions("key")
    small_batches(hashes.sparkSession, 65_536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in groups(batches, ["key"]):
            key, node = tab["key"].to_numpy(), tab["node"].to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(key)))
            other = np.minimum.reduceat(node, heads) != np.maximum.reduceat(node, heads)
            hit = node[np.repeat(other, sizes)]
            hit, n = np.unique(hit[hit != 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n)], names=["node", "s"])

    return dealt.mapInArrow(run, "node long, s long").groupBy("node").agg(F.sum("s").alias("s"))


def open_nodes(sent: DataFrame, hashes: DataFrame, rule: Rule) -> DataFrame:
    """Nodes that may have a link: too few of their shingles in the class are theirs alone."""
    own = sent.groupBy("node").agg(F.max("n").alias("n"), F.sum("c").alias("c"), F.sum("s").alias("s0"), F.count(F.lit(1)).alias("m"))
    both = own.join(shared_counts(hashes), "node", "left")
    least = F.col("n") - F.ceil(F.col("n") * rule.num / F.lit(rule.den)) + 1
    return both.where(F.col("c") - F.col("s0") - F.coalesce("s", F.lit(0)) < least * F.col("m")).select("node")


def keyed(texts: DataFrame, rule: Rule, counts: np.ndarray) -> DataFrame:
    """(key, node, n, point) of every set, for each of its rarest shingles."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, t in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = shingles(t, rule.k)
                keys, v = rare_keys(own, rule, shared.value).view(np.int64), point(own).view(np.int64)
                for a in range(0, len(keys), 16_384):
                    n = len(keys[a : a + 16_384])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + n]), *(pa.array(np.full(n, x)) for x in (node, len(own), *v))], names=["key", "node", "n", "v0", "v1", "v2", "v3"])

    return texts.mapInArrow(run, "key long, node long, n long, v0 long, v1 long, v2 long, v3 long")


class Forest:
    """Connections that a task has reported so far, by node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``by``: many groups at a time, none cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, np.int64)
        same = bool(held) and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in by)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def pairs_of(tab: pa.Table, by: list[str], rule: Rule, forest: Forest) -> list[tuple[int, int]]:
    """New connections among candidate pairs of the groups in ``tab``."""
    node, n = tab["node"].to_numpy(), tab["n"].to_numpy()
    v = np.ascontiguousarray(np.stack([tab[f"v{i}"].to_numpy() for i in range(4)], axis=1)).view(np.uint8)
    v = counts_of(v.reshape(len(node), GROUPS), n)
    cols = [tab[c].to_numpy() for c in by]
    new = np.ones(len(node), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    heads = np.flatnonzero(new)
    out: list[tuple[int, int]] = []
    small = np.flatnonzero((sizes > 1) & (sizes <= LEAF))
    rows = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= LEAF))  # a group of up to a leaf needs no tree
    for d in range(1, int(sizes[small].max()) if len(small) else 0):
        rows = rows[rows + d < len(node)]
        rows = rows[group[rows + d] == group[rows]]
        a, b = rows, rows + d
        ok = (node[a] != node[b]) & rule.sizes(np.minimum(n[a], n[b]), np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        ok = bound_ok(rule, v[a], n[a], v[b], n[b])
        for x, y in set(zip(node[a[ok]].tolist(), node[b[ok]].tolist(), strict=True)):
            if forest.join(x, y):
                out.append((x, y))
    for g in np.flatnonzero(sizes > LEAF).tolist():
        at = np.arange(heads[g], heads[g] + sizes[g])
        at = at[np.unique(node[at], return_index=True)[1]]
        known = np.unique([forest.find(x) for x in node[at].tolist()], return_inverse=True)[1]
        for i, j in CountTree(n[at], v[at]).join(rule, labels=known):
            x, y = int(node[at[i]]), int(node[at[j]])
            if forest.join(x, y):
                out.append((x, y))
    return out


def edge_batches(found: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    for pairs in found:
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def candidate_forest(keys: DataFrame, rule: Rule, hot: int = HOT) -> DataFrame:
    """Edges (a, b) over nodes whose components hold every link."""
    spark = keys.sparkSession
    big = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > hot))
    if big.isEmpty():
        dealt = keys.withColumns({"bi": F.lit(0), "bj": F.lit(0)})
    else:
        n = F.ceil(F.coalesce(F.col("__c"), F.lit(1)) / hot).cast("int")
        mine = F.pmod(F.xxhash64("node"), n).cast("int")
        dealt = match(keys, big, "key", "left").withColumn("__m", mine).withColumn("__o", F.explode(F.sequence(F.lit(0), n - 1)))
        dealt = dealt.withColumns({"bi": F.least("__m", "__o"), "bj": F.greatest("__m", "__o")}).select(*keys.columns, "bi", "bj")
    by = ["key", "bi", "bj"]
    dealt = dealt.repartition(parts(spark), *by).sortWithinPartitions(*by)
    small_batches(spark, 16_384)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        yield from edge_batches(pairs_of(t, by, rule, forest) for t in groups(batches, by))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def few(side: DataFrame) -> DataFrame:
    """Broadcast a side of small rows if its size allows."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def texts_of_nodes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of each wanted node; texts take less room than their sets. wanted: node, doc_id, th."""
    right = wanted.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "node")
    n = wanted.count()
    got = materialise(docs.join(few(right), (F.col("th") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__d"))).select("node", "text"))
    return got if got.count() == n else materialise(got.dropDuplicates(["node"]))  # rows alike in id and text


class Recent:
    """Sets of the texts asked for last."""

    def __init__(self, rule: Rule, most: int = 16) -> None:
        self.rule, self.most, self.sets = rule, most, {}

    def get(self, key: int, text: str) -> np.ndarray:
        if key not in self.sets:
            if len(self.sets) >= self.most:
                self.sets.clear()
            self.sets[key] = shingles(text, self.rule.k)
        return self.sets[key]


def verified(texts: DataFrame, rule: Rule, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between truly linked nodes that connect all that links connect. texts: node, root, text.

    In a large cluster every set's Jaccard distance d from the pivot, a metric, is measured first. With 1 - t = e:
    d <= e is linked to the pivot (class 0), e < d <= 2e may link to any (class 1), d > 2e cannot link to class 0 by
    the triangle inequality (class 2).
    """
    spark = texts.sparkSession
    small_batches(spark, 256)
    by = ["root", "bi", "bj"]
    sizes = texts.groupBy("root").agg(F.count(F.lit(1)).alias("__c"))
    big = materialise(sizes.where(F.col("__c") > block).select("root"))
    plain = texts if big.isEmpty() else match(texts, big.withColumn("__big", F.lit(True)), "root", "left").where(F.col("__big").isNull()).drop("__big")
    tasks = plain.select("node", "root", "text", F.lit(-1).alias("cls"), F.lit(0).alias("bi"), F.lit(0).alias("bj"))
    near = None
    if not big.isEmpty():
        crowd = materialise(match(texts, big, "root"))
        pivot = materialise(crowd.where(F.col("node") == F.col("root")).select("root", F.col("text").alias("pivot")))
        paired = spread_join(crowd, pivot, "root")  # pivots are texts, and never broadcast

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent = Recent(rule)
            for batch in batches:
                root, text, other = (batch.column(c).to_pylist() for c in ("root", "text", "pivot"))
                cls = [rule.nearness(shingles(t, rule.k), recent.get(r, p)) for r, t, p in zip(root, text, other, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "text")), pa.array(cls, pa.int32())], names=["node", "root", "text", "cls"])

        crowd = materialise(paired.mapInArrow(compare, "node long, root long, text string, cls int"))
        near = crowd.where((F.col("cls") == 0) & (F.col("node") != F.col("root"))).select(F.col("node").alias("a"), F.col("root").alias("b"))
        count = lambda c: F.ceil(F.sum((F.col("cls") == c).cast("int")) / block).cast("int")
        n = materialise(crowd.groupBy("root").agg(*[count(c).alias(f"__n{c}") for c in range(3)]))
        cls = F.col("cls")
        mine = F.pmod(F.xxhash64("node"), F.when(cls == 0, F.col("__n0")).when(cls == 1, F.col("__n1")).otherwise(F.col("__n2"))).cast("int")
        # blocks are numbered through the classes; a pair of blocks is a task, but none within class 0 or across 0 and 2
        at = F.when(cls == 0, F.lit(0)).when(cls == 1, F.col("__n0")).otherwise(F.col("__n0") + F.col("__n1")) + mine
        low = F.when(cls == 2, F.col("__n0")).otherwise(F.lit(0))
        high = F.when(cls == 0, F.col("__n0") + F.col("__n1")).otherwise(F.col("__n0") + F.col("__n1") + F.col("__n2")) - 1
        other = F.filter(F.sequence(low, high), lambda j: (cls != 0) | (j >= F.col("__n0")))
        met = match(crowd, n, "root").where(F.col("__n1") + F.col("__n2") > 0).withColumns({"__m": at, "__o": F.explode(other)})
        tasks = tasks.union(met.select("node", "root", "text", "cls", F.least("__m", "__o").alias("bi"), F.greatest("__m", "__o").alias("bj")))
    dealt = tasks.repartitionByRange(parts(spark), *by).sortWithinPartitions(*by)  # by rows, so that blocks don't meet by chance

    def check(tab: pa.Table) -> list[tuple[int, int]]:
        out = []
        cols = [tab[c].to_numpy() for c in by]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        node, cls, text = tab["node"].to_numpy(), tab["cls"].to_numpy(), tab["text"]
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(node)], strict=True):
            at = a + np.unique(node[a:b], return_index=True)[1]
            if len(at) < 2:
                continue
            own = [shingles(text[int(i)].as_py(), rule.k) for i in at]
            n = np.array([len(s) for s in own])
            v = counts_of(np.array([point(s) for s in own]), n)
            labels = np.where(cls[at] == 0, -1, np.arange(len(at)))  # those linked to the pivot are connected
            for i, j in CountTree(n, v).join(rule, lambda i, j, own=own: rule.linked(own[i], own[j]), labels):
                out.append((int(node[at[i]]), int(node[at[j]])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from edge_batches(map(check, groups(batches, by)))

    edges = dealt.mapInArrow(run, "a long, b long")
    return edges if near is None else edges.union(near)


def linked_documents(docs: DataFrame, rule: Rule) -> DataFrame:
    """Every document with its set's size, node and component: doc_id, th, n, node, component_id and rep.

    th is a hash of the text, rep the (doc_id, th) that stands for the component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), th.alias("th"))
    path = scratch_dir(spark)
    surveyed(slim, rule).write.partitionBy("kind").parquet(path)
    whole = spark.read.schema("doc_id long, th long, node long, n long, c long, s long, key long, kind string").parquet(path)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th"))
    rows = whole.where(F.col("kind") == "doc").select("doc_id", "th", "node", "n", "key")
    named = materialise(rows.where(F.col("n") > 0).groupBy("node", "key").agg(first.alias("rep")))
    clash = materialise(named.groupBy("node").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > 1).select("node", F.lit(True).alias("__clash")))
    clashes = clash.count()  # pairs of sets in 2 ** 64: none, or a few

    def told_apart(df: DataFrame) -> DataFrame:
        """Nodes that several sets have are replaced by one for each."""
        if not clashes:
            return df
        return match(df, clash, "node", "left", clashes).withColumn("node", F.when(F.col("__clash"), F.xxhash64("node", "key")).otherwise(F.col("node"))).drop("__clash")

    full = told_apart(rows.where(F.col("n") > 0)).select("doc_id", "th", "node", "n")
    hashes = whole.where(F.col("kind") == "hash").select("key", "node")
    open_ = open_nodes(whole.where(F.col("kind") == "sent").select("node", "n", "c", "s"), hashes, rule)
    left = materialise(open_.union(clash.select("node")).distinct() if clashes else open_)
    hashes.scratch_path = f"{path}/kind=hash"
    wanted = named.join(left, "node")
    nodes = materialise(told_apart(named).select("node", "rep")) if clashes else named.select("node", "rep")
    wanted = materialise(told_apart(wanted).select("node", "rep.doc_id", "rep.th"))
    drop_table(hashes)
    small_batches(spark)
    texts = texts_of_nodes(slim, wanted)
    small_batches(spark)
    keys = materialise(keyed(texts, rule, frequency_order(texts, rule)))
    forest = materialise(candidate_forest(keys, rule))
    drop_table(keys)
    clusters = connected_components(forest)
    members = materialise(clusters.union(clusters.select(F.col("root").alias("node"), "root").distinct()))
    grouped = materialise(texts.join(few(members), "node").select("node", "root", "text"))
    root = materialise(connected_components(verified(grouped, rule)))
    for done in (texts, forest, members, grouped):
        drop_table(done)
    final = materialise(nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rep"))
    best = materialise(final.groupBy("root").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("__c")))
    moved = materialise(best.where(F.col("__c") > 1).drop("__c"))  # the others stand for themselves
    final = materialise(match(final.withColumnRenamed("rep", "own"), moved, "root", "left").select("node", F.coalesce("rep", "own").alias("rep")))
    out = spread_join(full, final, "node", "left").select("doc_id", "th", "n", F.col("rep.doc_id").alias("component_id"), "rep")
    alone = rows.where(F.col("n") == 0).select("doc_id", "th", "n", F.col("doc_id").alias("component_id"), F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th").alias("rep"))
    return out.union(alone)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked_documents(table(spark, sf_dir, "documents"), Rule(3, 90, 100))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group linked by five-word shingles at 0.8 or more.

    Documents without words are kept; of rows alike in id and text one stays. All columns stay as they are.
    """
    found = linked_documents(docs, Rule(5, 80, 100)).where(F.col("n") > 0)
    same = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("th") == F.col("rep.th"))
    gone = materialise(found.where(~same).select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct())
    twice = materialise(found.where(same).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select(F.col("doc_id").alias("d"), F.col("th").alias("t")))
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"), th.alias("th"))  # no name of docs' own can clash
    match_ = (F.col("th") == F.col("t")) & F.col("id").eqNullSafe(F.col("d"))
    kept = rows.join(few(gone), match_, "left_anti")
    if not twice.isEmpty():
        kept = kept.join(few(twice), match_, "left_anti").union(kept.join(few(twice), match_, "left_semi").dropDuplicates(["id", "th"]))
    return kept.select("doc.*")
