"""Near copies by SimHash, and by the Jaccard similarity of word shingles where SimHash misses them.

SimHash classes (fingerprints of three words, two bits) come first. Between classes min-hash bands propose pairs, and exact sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm import simhash
from waymill.llm.common import components, local_labels, packed, unpacked, written

#: Two texts meet if all ROWS min-hashes of one of BANDS bands agree: 3 in a million pairs of
#: similarity 0.8 don't, and fewer of closer ones.
BANDS, ROWS = 32, 5
BLOCK = 1 << 12
#: Texts of a bucket that a task compares at once, beyond which pairs of blocks of half as many are dealt out; pairs of one text in a task.
MEET, STAR = 4_096, 512
#: Texts and shingles of the matrices that a bucket is compared by.
SIDE, WIDE = 512, 4_096

_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` lower-cased words, split and lowered in ASCII
    alone. A shorter text is one shingle of all its words, and so is a text without words."""
    words = text.lower().split()
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, of the band's number and its least hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[i : i + BLOCK, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, p, fp, bands) of every text, fingerprints as in ``simhash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column("text"), pa.binary())
            fps = np.array([simhash.fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            part = np.concatenate([bands(shingles(t.as_py(), width)) for t in texts] or [np.empty(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) + 1, BANDS, dtype=np.int32)), pa.array(part))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("p"), pa.array(fps), lists], ["doc_id", "p", "fp", "bands"])

    return docs.select("doc_id", "p", "text").mapInArrow(run, "doc_id long, p long, fp long, bands array<long>")


def sets_of(named: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(p, s): the shingles of the texts named (p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column("text"), pa.binary())
            for i in range(0, len(texts), 1000):
                part = [shingles(t.as_py(), width).view(np.int64) for t in texts[i : i + 1000]]
                ends = np.cumsum([0, *map(len, part)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("p")[i : i + 1000], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(part)))], ["p", "s"])

    sets = docs.join(named.select("p").distinct(), "p", "left_semi").select("p", "text").mapInArrow(run, "p long, s array<long>")
    return written(sets.groupBy("p").agg(F.first("s").alias("s")), "shingle-sets")


def alike(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of the pairs (u, v) of texts those whose shingles have the similarity, by their whole sets. The pairs of a u that has many are spread over tasks."""
    pairs = written(pairs.distinct(), "shingle-pairs")
    sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("p")), docs, width)
    spread = pairs.groupBy("u").agg(F.ceil(F.count("*") / STAR).alias("spread"))
    left = sets.withColumnRenamed("p", "u").join(spread, "u").select("u", F.col("s").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread") - 1)).alias("i"))
    dealt = pairs.join(spread, "u").select("u", "v", F.pmod(F.xxhash64("v"), "spread").alias("i"))
    both = dealt.join(sets.select(F.col("p").alias("v"), F.col("s").alias("b")), "v").join(left, ["u", "i"])
    both = both.withColumn("shared", F.size(F.array_intersect("a", "b")))
    return written(both.where(F.col("shared") >= similarity * (F.size("a") + F.size("b") - F.col("shared")) - 1e-9).select("u", "v"), "shingle-edges")


def linked(c: np.ndarray, ends: np.ndarray, values: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the components c of some texts that connect them as all pairs of the similarity do.

    The shingles of text i are values[ends[i]:ends[i + 1]]. Texts of the largest component are compared with the others
    alone. Shared shingles are counted by products of small matrices, so that no pair is ever listed.
    """
    names, own, size = np.unique(c, return_inverse=True, return_counts=True)
    lengths, row = np.diff(ends), np.repeat(np.arange(len(c)), np.diff(ends))
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    row, column, width = row[keep], place[column[keep]], int((times > 1).sum())
    rest = np.flatnonzero(own != size.argmax())

    def filled(rows: np.ndarray) -> Iterator[np.ndarray]:
        """The rows' marks, WIDE shingles at once."""
        at = np.full(len(c), -1)
        at[rows] = np.arange(len(rows))
        mine = at[row] >= 0
        r, k = at[row[mine]], column[mine]
        for low in range(0, width, WIDE):
            some = (k >= low) & (k < low + WIDE)
            out = np.zeros((len(rows), min(WIDE, width - low)), np.float32)
            out[r[some], k[some] - low] = 1
            yield out

    i, j = [np.empty(0, int)], [np.empty(0, int)]
    for x in range(0, len(rest), SIDE):
        left = rest[x : x + SIDE]
        for y in range(0, len(c), SIDE):
            right = np.arange(y, min(len(c), y + SIDE))
            shared = np.zeros((len(left), len(right)), np.float32)
            for a, b in zip(filled(left), filled(right)):
                shared += a @ b.T
            every = lengths[left][:, None] + lengths[right][None, :] - shared
            a, b = np.nonzero((shared >= similarity * every - 1e-9) & (own[left][:, None] != own[right][None, :]))
            met = np.unique(own[left[a]] * len(names) + own[right[b]])
            i.append(met // len(names))
            j.append(met % len(names))
    label = local_labels(len(names), np.concatenate(i), np.concatenate(j))
    at = np.flatnonzero(label != np.arange(len(names)))
    return names[at], names[label[at]]


def met(named: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (u, v) between the components c of texts p that meet in buckets k (k, p, c), where a pair of them has the similarity.

    Each bucket is compared by one task, a large one by a task for each pair of its blocks; a task returns a spanning forest.
    Of buckets with the same texts one is compared.
    """
    digest = named.groupBy("k").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("p")).alias("x"), F.bit_xor(F.xxhash64("p", F.lit(1))).alias("y"))
    once = digest.groupBy("n", "x", "y").agg(F.min("k").alias("k")).select("k", F.when(F.col("n") <= MEET, 1).otherwise(F.ceil(F.col("n") / (MEET // 2))).alias("blocks"))
    block = F.pmod(F.xxhash64("p", F.lit(2)), "blocks")
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least(j, block).alias("i"), F.greatest(j, block).alias("j")))
    dealt = named.join(once, "k").select("k", "p", "c", F.explode(pair).alias("o"))
    rows = dealt.select(F.xxhash64("k", "o.i", "o.j").alias("g"), "p", "c").join(sets_of(named, docs, width), "p").select("g", "c", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            g = held.column("g").to_numpy()
            whole = len(g) - int((g == g[-1]).sum())
            if whole:
                yield compared(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield compared(held)

    def compared(rows: pa.Table) -> pa.RecordBatch:
        g, c, s = rows.column("g").to_numpy(), rows.column("c").to_numpy(), rows.column("s").combine_chunks()
        ends, values = s.offsets.to_numpy(), s.values.to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            x, y = linked(c[a:b], ends[a : b + 1] - ends[a], values[ends[a] : ends[b]], similarity)
            u.append(x)
            v.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return written(rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long").distinct(), "shingle-met")


def links(points: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges that connect the texts p of points (p, c, bands) as their classes c and all pairs of the similarity do.

    Each bucket's texts are compared with the one that meets most texts in all its buckets; then those of different
    components that share a bucket with each other, within tasks.
    """
    every = points.select("p", "c", F.explode("bands").alias("k"))
    shared = every.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high").select("k", "n")
    members = written(every.join(shared, "k"), "shingle-buckets")
    meets = members.groupBy("p").agg(F.sum("n").alias("meets"))
    first = members.join(meets, "p").groupBy("k").agg(F.max_by(F.struct("p", "c"), F.struct("meets", "p")).alias("first"))
    pairs = members.join(first, "k").where("c <> first.c").select(F.col("first.p").alias("u"), F.col("p").alias("v"))
    within = points.where("p <> c").select(F.col("c").alias("u"), F.col("p").alias("v"))
    joined = components(alike(pairs, docs, width, similarity).unionByName(within))
    named = members.select("k", "p").join(joined, F.col("p") == F.col("node"), "left").select("k", "p", F.coalesce("root", "p").alias("c"))
    split = named.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("k")
    named = written(named.join(split, "k", "left_semi"), "shingle-split")
    return joined.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(met(named, docs, width, similarity))


def classes(points: DataFrame, radius: int) -> DataFrame:
    """(p, c): the smallest text of the SimHash class of each text p of points (p, fp)."""
    fps = written(points.groupBy("fp").agg(F.min("p").alias("least")), "shingle-fingerprints")
    joined = components(simhash.links(fps.select("fp"), radius))
    rooted = written(fps.join(joined, fps.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "shingle-classes")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("c")), "root").select("fp", "c")
    return points.select("p", "fp").join(named, "fp").select("p", "c")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """The documents with one of each group of near copies, the one with the smallest doc_id.

    Texts are linked if their SimHash fingerprints, those of ``simhash.near_duplicates``, differ in ``radius`` bits or fewer, or if
    the sets of their shingles have the Jaccard similarity or more. Rows with a null
    doc_id take part in links and all stay; of rows that repeat a kept doc_id the one whose text and
    other columns sort first stays. Texts are told apart by a 64-bit hash. Null, empty and blank texts are
    copies of each other. Any column name may be there; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("p"), text.alias("text"))
    marked = written(_marked(plain, width), "shingles")
    points = written(marked.groupBy("p").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "shingle-points")
    near = points.select("p", "bands").join(classes(points, radius), "p")
    joined = components(links(written(near, "shingle-near"), plain, width, similarity))
    rooted = points.join(joined, points.p == joined.node, "left").select("p", "first", F.coalesce("root", "p").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    named = rooted.join(least, "root").where("first = kept").select("p", "kept")
    rows = marked.select("doc_id", "p").join(named, "p").where("doc_id = kept")
    found = written(rows.groupBy("doc_id").count(), "shingle-kept")
    kept = docs.join(found.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
    if found.where("count > 1").limit(1).count():
        # A digest of the whole row orders rows of any type.
        row = F.struct(text.alias("t"), F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]))).alias("d"))
        some = packed(kept, F.col("doc_id").alias("_id"), row.alias("_order"))
        kept = unpacked(some.groupBy("_id").agg(F.min_by("_row", "_order").alias("_row")))
    return kept.unionByName(docs.where("doc_id IS NULL"))
