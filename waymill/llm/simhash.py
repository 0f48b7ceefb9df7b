"""SimHash near-duplicates: fingerprints by word shingles, linked through a sharded vantage-point tree."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import components, local_labels, written

#: Points of the bounded sample that the driver builds the upper tree from, and the leaf size it aims at.
SAMPLE, LEAF = 32_768, 1_500
#: Points beyond which a leaf gets a tree of its own, from about this many of its points, in so many rounds at most.
FULL, LEAF_SAMPLE, ROUNDS = 40_000, 2_048, 12
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the lower-cased words of a UTF-8 text; zero if it has none.

    ``bytes.lower`` and ``bytes.split`` act on ASCII alone: A-Z, and space with \\t\\n\\v\\f\\r.
    """
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed 64-bit number; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(pc.fill_null(batch.column("text"), ""), pa.binary())
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _cut(d: np.ndarray, radius: int) -> int:
    """The radius near the median of distances d that the fewest points lie close below."""
    low, high = np.quantile(d, [0.3, 0.7]).astype(int)
    return min(range(low, high + 1), key=lambda m: ((d > m - radius) & (d <= m)).sum() + abs((d <= m).sum() - len(d) / 2) / 4)


def build_tree(points: np.ndarray, leaves: int, radius: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Nodes (vantage point, cut, inner child, outer child); a child under zero is leaf ``-child - 1``."""
    nodes: list[tuple[int, int, int, int]] = []
    count = 0

    def grow(at: np.ndarray, goal: int) -> int:
        nonlocal count
        if goal > 1 and len(at) >= 8:
            vantage = at[len(at) // 2]
            d = np.bitwise_count(at ^ vantage).astype(int)
            m = _cut(d, radius)
            inside = d <= m
            if inside.any() and not inside.all():
                k = len(nodes)
                nodes.append((int(vantage), m, 0, 0))
                inner, outer = grow(at[inside], goal // 2), grow(at[~inside], goal - goal // 2)
                nodes[k] = (int(vantage), m, inner, outer)
                return k
        count += 1
        return -count

    root = grow(points, leaves)
    assert root <= 0
    return nodes, count


def route(x: np.ndarray, nodes: list, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, indices into x). A point goes to its side of each cut; one inside and less than
    ``radius`` from the boundary visits the outer side too. By the triangle inequality two points
    within ``radius`` of each other then share a leaf."""
    todo = [(0 if nodes else -1, np.arange(len(x)))]
    while todo:
        k, at = todo.pop()
        if not len(at):
            continue
        if k < 0:
            yield -k - 1, at
            continue
        vantage, m, inner, outer = nodes[k]
        d = np.bitwise_count(x[at] ^ np.uint64(vantage)).astype(int)
        todo += [(inner, at[d <= m]), (outer, at[d > m - radius])]


def close_pairs(x: np.ndarray, radius: int, small: int = 768) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of points within the radius, by a vantage-point tree down to small brute-force blocks."""
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        n = len(at)
        if n > small:
            d = np.bitwise_count(x[at] ^ x[at[n // 2]]).astype(int)
            m = _cut(d, radius)
            inner, outer = at[d <= m], at[d > m - radius]
            if max(len(inner), len(outer)) < 0.85 * n:
                todo += [inner, outer]
                continue
        for i in range(0, n, small):
            rows = at[i : i + small]
            rest = at[i:]
            a, b = np.nonzero(np.bitwise_count(x[rows][:, None] ^ x[rest][None, :]) <= radius)
            keep = a < b
            yield rows[a[keep]], rest[b[keep]]


def refined(dealt: DataFrame, radius: int) -> DataFrame:
    """(leaf, fp) with every leaf over FULL points split by a tree of its own, until none is left that can be.

    The trees are built and used where the points are: from a sample of a leaf's points in one task each, and
    joined to the leaf's points. So the number of leaves grows with the table, and the sample on the driver doesn't. A leaf
    whose points are all close to each other isn't split; its points are the group that they link to.
    """
    dealt = written(dealt.withColumn("done", F.lit(False)), "simhash-dealt")

    def grow(part: pa.Table) -> pa.Table:
        points = np.sort(part.column("fp").to_numpy()).view(np.uint64)
        nodes, leaves = build_tree(points, 64, radius)
        return pa.table({"leaf": part.column("leaf")[:1], "tree": pa.array([json.dumps(nodes)]), "leaves": pa.array([leaves], pa.int32())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, list] = {}
        for batch in batches:
            leaf, fp, done, tree = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "fp", "done", "tree"))
            names = np.array(["" if t is None else t for t in tree], object)
            for name in set(names):
                at = np.flatnonzero(names == name)
                if not name:
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[at]), pa.array(fp[at]), pa.array(done[at].astype(bool))], ["leaf", "fp", "done"])
                    continue
                if name not in trees:
                    trees[name] = json.loads(name)
                for own in np.unique(leaf[at]):
                    mine = at[leaf[at] == own]
                    for k, some in route(fp[mine].view(np.uint64), trees[name], radius):
                        sub = np.full(len(some), (int(own) * 0x9E3779B1 + k + 1) % (1 << 61), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(sub), pa.array(fp[mine][some]), pa.array(np.full(len(some), not trees[name]))], ["leaf", "fp", "done"])

    for _ in range(ROUNDS):
        full = dealt.where("NOT done").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > FULL)
        if full.isEmpty():
            break
        some = dealt.join(full, "leaf").where(F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / LEAF_SAMPLE)) == 0).select("leaf", "fp")
        trees = written(some.groupBy("leaf").applyInArrow(grow, "leaf long, tree string, leaves int"), "simhash-trees")
        dealt = written(dealt.join(trees.select("leaf", "tree"), "leaf", "left").select("leaf", "fp", "done", "tree").mapInArrow(deal, "leaf long, fp long, done boolean"), "simhash-dealt")
    return dealt.select("leaf", "fp")


def links(fps: DataFrame, radius: int = 2, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints (fp) exactly as all pairs within ``radius`` do.

    A bounded sample fixes the upper tree, full leaves are split further where they are; every fingerprint is
    routed through, and each leaf returns a spanning forest of its close pairs rather than the pairs.
    """
    n = fps.count()
    some = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(sample).collect()], np.int64).view(np.uint64)
    nodes, _ = build_tree(some, max(1, min(-(-n // leaf), max(1, len(some) // 8))), radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k, at in route(fp.view(np.uint64), nodes, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int64)), pa.array(fp[at])], ["leaf", "fp"])

    def find(part: pa.Table) -> pa.Table:
        fp = np.sort(part.column("fp").to_numpy())
        i, j = [], []
        for a, b in close_pairs(fp.view(np.uint64), radius):
            i.append(a)
            j.append(b)
            if sum(map(len, i)) > 1 << 22:
                label = local_labels(len(fp), np.concatenate(i), np.concatenate(j))
                i, j = [np.arange(len(fp))], [label]
        label = local_labels(len(fp), np.concatenate([*i, np.empty(0, int)]), np.concatenate([*j, np.empty(0, int)]))
        at = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"u": fp[at], "v": fp[label[at]]})

    return refined(fps.select("fp").mapInArrow(deal, "leaf long, fp long"), radius).groupBy("leaf").applyInArrow(find, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of documents (doc_id, text).

    Equal fingerprints are one point whatever the number of their rows, so groups of exact copies
    cost nothing. Null and empty texts have fingerprint zero and link like any other; repeated
    rows are returned as often as they come; a null doc_id takes part in links but is never the
    smallest, so that a component of such rows alone has a null id. An empty table gives no rows.
    """
    marked = written(fingerprints(docs, width, seed), "simhash")
    points = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-points")
    joined = components(links(points.select("fp"), radius))
    rooted = points.join(joined, points.fp == joined.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
