"""Language-model scores by online logistic context mixing over bits, beside a unigram base.

A byte is a few binary decisions, those of a Huffman code of the corpus' bytes. Several contexts, the last bytes and the word so far, each have a
hashed table of the bits seen after the context and the decisions so far. The stretched predictions are
added with weights that a gate, how well the longer contexts are known, selects; the weights are
learned online, and an adaptive map refines the result by the mixed prediction and the decisions so far.
A text's end is a byte that UTF-8 never has, so that the probabilities of all texts add up to one.

Training is spread out and doesn't depend on how the table is cut into tasks. Tasks count their documents and equal
blocks of their tables are added up. The training documents are counted in two halves: the
weights take their online steps over each half with the counts of the other, as steps over what has been
counted would trust long contexts too much. So every training document is counted and learned from. A half is dealt by hash of doc_id to
shards of about SHARD bytes, each learns from its documents in an order of its own, their weights are averaged, and the final tables hold all.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import written

#: Contexts: so many last bytes, or the word so far in lower case (0); and the bits of their tables.
ORDERS, TABLE_BITS = (1, 2, 3, 4, 5, 0), (16, 18, 20, 21, 22, 22)
WIDTH, END = 5, 255
HALVES, SHARD = 2, 4_000_000
#: Bytes scored at once, decisions taken at once, and tokens that every task knows (the most frequent; 16 bytes each).
PIECE, STEP, FREQUENT = 2_000_000, 16_384, 262_144
#: Keys of pieces held before they are merged, and keys counted at once.
HELD, SPAN = 2_000_000, 262_144
GATES, BUCKETS, FINE = 64, 33, 1024
BLOCK_BITS = 14
U = np.uint64
U32 = np.uint32

_BREAK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32, END])
#: A random number for each byte, without the bit that tells ASCII letters' case, and the base of hashes of words.
_TAB = (np.random.default_rng(8).integers(0, 2**63, 256, dtype=U) | U(1))[np.arange(256) | 32]
BASE = 0x5851F42D4C957F2D


def train_rule(doc_id) -> bool:
    """Whether a document is learned from; a null id has the empty name."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def half_of(doc_id) -> int:
    """The half of a training document: the weights are learned on it with the counts of the other."""
    return zlib.crc32(("half " + ("" if doc_id is None else str(doc_id))).encode()) % HALVES


# --- contexts -------------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out)


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One key for every byte of the texts and each end, and the ends of the texts among the keys.

    From the top a key holds the five bytes before, the nearest first, 16 bits of the word so far, and the byte
    itself. The 16 bits are the word's length up to WIDTH, and beyond that a larger number, a hash of
    all its bytes before the five. In the order of the keys contexts that share their nearest bytes stand together,
    and so do their table slots in caches.
    """
    pad = bytes([END]) * WIDTH
    raw = np.frombuffer(pad + b"".join(t + bytes([END]) * (WIDTH + 1) for t in texts), np.uint8)
    n = len(raw) - WIDTH
    at = np.arange(len(raw) + 1, dtype=np.int32)
    start = np.zeros(len(raw) + 1, np.int32)
    start[1:][_BREAK[raw]] = at[1:][_BREAK[raw]]
    start = np.maximum.accumulate(start, out=start)[WIDTH:-1]
    length = at[WIDTH:-1] - start
    # Sums of bytes times powers: their differences, brought back to the word's start, are hashes of its bytes.
    prefix = np.zeros(len(raw) + 1, U)
    np.cumsum(_TAB[raw] * powers(BASE, len(raw)), out=prefix[1:])
    long = np.flatnonzero(length > WIDTH)
    far = prefix[long] - prefix[start[long]]
    far *= powers(pow(BASE, -1, 2**64), len(raw) + 1)[start[long]]
    del prefix, at, start
    word = np.minimum(length, WIDTH).astype(np.uint16)
    word[long] = WIDTH + 1 + (mixed(mixed(far)) >> U(16)) % U(65535 - WIDTH)
    del far, long, length
    key = np.zeros(n, U)
    for j in range(WIDTH - 1, -1, -1):
        key <<= U(8)
        key |= raw[j : n + j]
    key <<= U(16)
    key |= word
    key <<= U(8)
    key |= raw[WIDTH:]
    del word
    size = np.array([len(t) + 1 for t in texts])
    real = np.ones(n, bool)
    ends = np.cumsum(size + len(pad)) - len(pad)
    for j in range(len(pad)):
        real[np.minimum(ends + j, n - 1)[ends + j < n]] = False
    return key[real], np.cumsum(size)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sums of their times."""
    rank = np.argsort(keys)
    keys = keys[rank]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times[rank], first)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.float64)


def context_of(keys: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each context of an order; a word's five nearest bytes are taken in lower case."""
    if order:
        return mixed((keys >> U(64 - 8 * order)) * U(0x9E3779B97F4A7C15) + U(order))
    length = np.minimum((keys >> U(8)) & U(0xFFFF), U(WIDTH))
    word = (keys | U(0x2020202020 << 24)) & ~((U(1) << (U(64) - U(8) * np.maximum(length, U(1)))) - U(1))
    word = np.where(length > 0, word, U(0)) | ((keys >> U(8)) & U(0xFFFF))
    return mixed(word * U(0x9E3779B97F4A7C15))


def spread(node: np.ndarray) -> np.ndarray:
    """Nodes of the code as ``slots`` takes them."""
    return node * U32(0x9E3779B1)


def slots(context: np.ndarray, spread_node: np.ndarray, bits: int) -> np.ndarray:
    """The table slot of a context's upper half (32 bits) and a node of the code."""
    at = context ^ spread_node
    at *= U32(0x85EBCA6B)
    at >>= U32(32 - bits)
    return at.astype(np.intp)


def halves(context: np.ndarray) -> np.ndarray:
    return (context >> U(32)).astype(U32)


@dataclass
class Code:
    """A prefix code of bytes: for each its length, and node and bit of each decision. Nodes are numbered from 0."""

    length: np.ndarray
    node: np.ndarray  # (256, longest)
    bit: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Code:
        """Huffman's code of byte counts; every byte has one."""
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, number = {}, 256
        while len(heap) > 1:
            (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a], parent[b] = (number, 0), (number, 1)
            heapq.heappush(heap, (x + y, number, number))
            number += 1
        paths = []
        for b in range(256):
            path, k = [], b
            while k in parent:
                k, bit = parent[k]
                path.append((k - 256, bit))
            paths.append(path[::-1])
        longest = max(map(len, paths))
        node, bit = np.zeros((256, longest), np.uint32), np.zeros((256, longest), np.uint32)
        for b, path in enumerate(paths):
            for k, (at, one) in enumerate(path):
                node[b, k], bit[b, k] = at, one
        return cls(np.array([len(p) for p in paths], np.uint8), node, bit)

    def sorted_by_length(self, keys: np.ndarray) -> np.ndarray:
        """An order of the keys in which longer codes come first."""
        return np.argsort(-self.length[(keys & U(255)).astype(np.int64)].astype(np.int8), kind="stable")

    def decisions(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of keys that still have one, their node, their bit) of each decision of keys with longer codes first."""
        byte = (keys & U(255)).astype(np.int64)
        length = self.length[byte]
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length.astype(np.int64), -k, side="left"))
            yield n, self.node[byte[:n], k], self.bit[byte[:n], k]


# --- the model ------------------------------------------------------------------------------------


def quantised(counts: np.ndarray) -> np.ndarray:
    """Counts (zeros, ones) of slots as one number: the stretched probability in steps of 1/256 above
    two bits that say how often the slot was seen."""
    total = counts.sum(axis=1)
    stretch = np.clip(np.log((counts[:, 1] + 0.02) / (counts[:, 0] + 0.02)), -7.9, 7.9)
    return (np.rint(stretch * 256).astype(np.int16) << 2) | np.searchsorted([0.5, 3.5, 20.5], total).astype(np.int16)


@dataclass
class Model:
    code: Code
    tables: list[np.ndarray]
    weights: np.ndarray  # (orders + 1, gates)
    refine: np.ndarray  # (256 nodes, buckets): the probability of a one

    @classmethod
    def empty(cls, code: Code, tables: list[np.ndarray]) -> Model:
        refine = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS))), (256, 1))
        return cls(code, tables, np.full((len(ORDERS) + 1, GATES), 0.3, np.float32), refine)

    def inputs(self, halved: list[np.ndarray], n: int, node: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The orders' stretched predictions, and the gates."""
        x, seen, node = [], [], spread(node)
        for table, bits, half in zip(self.tables, TABLE_BITS, halved):
            v = table.take(slots(half[:n], node, bits))
            stretch = (v >> 2).astype(np.float32)
            stretch *= np.float32(1 / 256)
            x.append(stretch)
            seen.append(v)
        last, word, before = (v & 3 for v in (seen[-1], seen[-2], seen[-3]))
        return x, (last * 16 + word * 4 + before).astype(np.intp)

    def mix(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = (self.weights[-1] * np.float32(0.3)).take(gate)
        for w, v in zip(self.weights, x):
            part = w.take(gate)
            part *= v
            z += part
        return np.clip(z, -7.99, 7.99, out=z)

    def outcomes(self) -> np.ndarray:
        """log10 probability by node, finely divided mixed prediction, and bit."""
        z = (np.arange(FINE) + 0.5) * (16 / FINE) - 8
        at = (z + 8) * ((BUCKETS - 1) / 16)
        low = np.minimum(at.astype(np.int64), BUCKETS - 2)
        part = at - low
        p = (self.refine[:, low] * (1 - part) + self.refine[:, low + 1] * part + 1 / (1 + np.exp(-z))) / 2
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log10(np.stack([1 - p, p], axis=2)).astype(np.float32).ravel()

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's byte after its contexts."""
        out, table = np.zeros(len(keys)), self.outcomes()
        for i in range(0, len(keys), STEP):
            order = self.code.sorted_by_length(keys[i : i + STEP])
            some = keys[i : i + STEP][order]
            halved = [halves(context_of(some, o)) for o in ORDERS]
            total = np.zeros(len(some), np.float32)
            for n, node, bit in self.code.decisions(some):
                z = self.mix(*self.inputs(halved, n, node))
                fine = ((z + np.float32(8)) * np.float32(FINE / 16)).astype(U32)
                total[:n] += table[(node * U32(FINE) + fine) * U32(2) + bit]
            out[i + order] = total
        return out

    def learn(self, keys: np.ndarray, times: np.ndarray, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
        """Online steps over the keys in mixed order; for the adaptive map the sums of ones and of all."""
        ones, every = np.zeros(256 * BUCKETS), np.zeros(256 * BUCKETS)
        mixed_up = np.random.default_rng(len(keys)).permutation(len(keys))
        squares = np.full(self.weights.shape, 1e-3)
        for i in range(0, len(keys), STEP // 2):
            at = mixed_up[i : i + STEP // 2]
            at = at[self.code.sorted_by_length(keys[at])]
            some, weight = keys[at], np.minimum(times[at], 1e5)
            halved = [halves(context_of(some, o)) for o in ORDERS]
            for n, node, bit in self.code.decisions(some):
                x, gate = self.inputs(halved, n, node)
                z, w = self.mix(x, gate), weight[:n]
                error = (bit - 1 / (1 + np.exp(-z))) * w
                for k, v in enumerate([*x, np.float32(0.3)]):
                    step = np.bincount(gate, error * v, GATES)
                    squares[k] += step * step
                    self.weights[k] += (rate * step / np.sqrt(squares[k])).astype(np.float32)
                a = (z + 8.0) * ((BUCKETS - 1) / 16)
                low = np.minimum(a.astype(np.int64), BUCKETS - 2)
                for cell, part in ((low, 1 - (a - low)), (low + 1, a - low)):
                    flat = node.astype(np.int64) * BUCKETS + cell
                    every += np.bincount(flat, w * part, 256 * BUCKETS)
                    ones += np.bincount(flat, w * part * bit, 256 * BUCKETS)
        return ones, every

    def pack(self) -> bytes:
        tables = b"".join(t.tobytes() for t in self.tables)
        return zstandard.ZstdCompressor(level=1).compress(tables + self.weights.tobytes() + self.refine.tobytes())

    @classmethod
    def unpack(cls, code: Code, blob: bytes) -> Model:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        tables, at = [], 0
        for b in TABLE_BITS:
            tables.append(np.frombuffer(raw, np.int16, 1 << b, at))
            at += 2 << b
        n = GATES * (len(ORDERS) + 1)
        weights = np.frombuffer(raw, np.float32, n, at).reshape(-1, GATES).copy()
        return cls(code, tables, weights, np.frombuffer(raw, np.float64, 256 * BUCKETS, at + 4 * n).reshape(256, -1).copy())


# --- jobs -----------------------------------------------------------------------------------------


def pieces(batches: Iterator[pa.RecordBatch], keep) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of about PIECE bytes; a longer text comes alone."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), pc.cast(batch.column("text"), pa.binary())):
            if keep(doc):
                text = text.as_py()
                ids.append(doc)
                texts.append(text)
                size += len(text) + 1
                if size >= PIECE:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


#: What is counted in one pass: tokens by hash, and bytes by value.
TOKEN, BYTE = 0, 1


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, c) over the training documents: tokens, and bytes with the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, total = None, np.zeros(256, np.int64)
        for _, texts in pieces(batches, train_rule):
            total += np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
            total[END] += len(texts)
            part = counted(token_hashes(texts)[0])
            got = part if got is None else summed(*(np.concatenate(x) for x in zip(got, part)))
            if len(got[0]) > 4_000_000:
                yield sent(TOKEN, got[0].view(np.int64), got[1])
                got = None
        if got is not None:
            yield sent(TOKEN, got[0].view(np.int64), got[1])
        if total.any():
            yield sent(BYTE, np.arange(256), total)

    def sent(kind: int, key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(c.astype(np.int64))], ["kind", "key", "c"])

    return docs.mapInArrow(count, "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c"))


def task_keys(batches: Iterator[pa.RecordBatch], part_of) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """The distinct keys and counts of a task's documents of part 0 and of part 1, merged piece by piece.
    ``part_of`` names a document's part, or None."""
    got: list[list] = [[], []]
    for ids, texts in pieces(batches, lambda doc: part_of(doc) is not None):
        for which in (0, 1):
            some = [t for i, t in zip(ids, texts) if part_of(i) == which]
            if some:
                got[which].append(counted(keys_of(some)[0]))
                if sum(len(k) for k, _ in got[which]) > HELD:
                    got[which] = [summed(*(np.concatenate(x) for x in zip(*got[which])))]
    return [summed(*(np.concatenate(x) for x in zip(*parts))) if parts else None for parts in got]


def table_counts(code: Code, keys: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order's place, counts of its slots as zeros, ones)."""
    order = code.sorted_by_length(keys)
    keys, times = keys[order], times[order].astype(np.uint32)
    for k, (of, bits) in enumerate(zip(ORDERS, TABLE_BITS)):
        half, out = halves(context_of(keys, of)), np.zeros(2 << bits, np.uint32)
        for m, node, bit in code.decisions(keys):
            # Counts are whole numbers, so that sums don't depend on their order.
            for i in range(0, m, SPAN):
                some = slice(i, min(m, i + SPAN))
                at = slots(half[some], spread(node[some]), bits) * 2
                at += bit[some]
                np.add.at(out, at, times[some])
        yield k, out.reshape(-1, 2)


def packed_counts(block: np.ndarray) -> bytes:
    whole = np.ascontiguousarray(block, np.uint32).ravel()
    return zstandard.ZstdCompressor(level=1).compress(whole.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked_counts(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).reshape(-1, 2).astype(np.float64)


def bit_tables(docs: DataFrame, code: Code) -> tuple[list[np.ndarray], ...]:
    """The tables of all training documents, those of the first half and those of the other. Tasks send blocks of their
    tables; equal blocks stream through a task and are added up. A bounded number of blocks of fixed
    size reaches the driver."""

    def compress(x: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(x.tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for which, got in enumerate(task_keys(batches, lambda doc: half_of(doc) if train_rule(doc) else None)):
            if got is None:
                continue
            for k, table in table_counts(code, *got):
                size = 1 << BLOCK_BITS
                some = [(k * 65536 + (i >> BLOCK_BITS), which, packed_counts(table[i : i + size])) for i in range(0, len(table), size) if table[i : i + size].any()]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in some], pa.int32()), pa.array([s[1] for s in some], pa.int32()), pa.array([s[2] for s in some], pa.binary())], ["block", "half", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, [None, None]

        def done():
            one, other = (np.zeros_like(sums[1 - i]) if s is None else s for i, s in enumerate(sums))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([compress(quantised(x))]) for x in (one + other, one, other)]], ["block", "whole", "one", "other"])

        for batch in batches:
            for at, which, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "half", "counts"))):
                if at != block:
                    if block is not None:
                        yield done()
                    block, sums = at, [None, None]
                part = unpacked_counts(blob)
                sums[which] = part if sums[which] is None else sums[which] + part
        if block is not None:
            yield done()

    sent = docs.mapInArrow(count, "block int, half int, counts binary")
    sums = sent.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, whole binary, one binary, other binary")
    none = quantised(np.zeros((1, 2)))[0]
    every = tuple([np.full(1 << b, none, np.int16) for b in TABLE_BITS] for _ in range(3))
    for block, *blobs in sums.toLocalIterator():
        at = (block % 65536) << BLOCK_BITS
        for tables, blob in zip(every, blobs):
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(blob)), np.int16)
            tables[block // 65536][at : at + len(part)] = part
    return every


def shards_of(docs: DataFrame, size: int) -> DataFrame:
    """(half, shard, text) of all training documents, ``size`` bytes, by the rules of ``train_rule`` and ``half_of``."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    half = (F.crc32(F.concat(F.lit("half "), name)) % HALVES).cast("int")
    shard = F.pmod(F.xxhash64(name), F.lit(max(1, -(-size // (HALVES * SHARD)))))
    return docs.where(F.crc32(name) % 7 != 2).select(half.alias("half"), shard.alias("shard"), "text")


def trained(docs: DataFrame, counts: DataFrame) -> Model:
    """The model: weights learned online over each shard, and averaged by the shards' grams."""
    found = {(r["kind"], r["key"]): r["c"] for r in counts.where(F.col("kind") != TOKEN).collect()}  # 256 rows
    code = Code.of(np.array([found.get((BYTE, b), 0) for b in range(256)]))
    whole, *parts = bit_tables(docs, code)
    model = Model.empty(code, whole)
    # A shard of one half learns with the counts of the other.
    shared = [docs.sparkSession.sparkContext.broadcast(Model.empty(code, tables).pack()) for tables in parts[::-1]]

    def learn(shard: pa.Table) -> pa.Table:
        texts = [t.as_py() for t in pc.cast(shard.column("text"), pa.binary())]
        # Piece by piece as everywhere; sums of counts are the same in any order.
        got: list = []
        size, some = 0, []
        for t in texts:
            some.append(t)
            size += len(t) + 1
            if size >= PIECE:
                got.append(counted(keys_of(some)[0]))
                size, some = 0, []
        if some:
            got.append(counted(keys_of(some)[0]))
        keys, times = summed(*(np.concatenate(x) for x in zip(*got)))
        own = Model.unpack(code, shared[shard.column("half")[0].as_py()].value)
        ones, every = own.learn(keys, times)
        return pa.table([pa.array([len(keys)], pa.int64()), pa.array([own.weights.astype(float).tobytes()]), pa.array([ones.tobytes()]), pa.array([every.tobytes()])], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0.0, 0.0, 0.0]
        for batch in batches:
            for k, *blobs in zip(*(batch.column(c).to_pylist() for c in names)):
                n += k
                sums = [s + np.frombuffer(b) * (k if i == 0 else 1) for i, (s, b) in enumerate(zip(sums, blobs))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([(s / (n if i == 0 else 1)).tobytes()]) for i, s in enumerate(sums)]], names)

    names = ["n", "weights", "ones", "every"]
    schema = "n long, weights binary, ones binary, every binary"
    learned = shards_of(docs, sum(c for (kind, _), c in found.items() if kind == BYTE)).groupBy("half", "shard").applyInArrow(learn, schema)
    part = learned.repartition(16).mapInArrow(add, schema)
    got = list(add(part.toArrow().to_batches()))  # of 16 rows of fixed size
    if got:
        weights, ones, every = (np.frombuffer(got[0].column(c)[0].as_py()) for c in names[1:])
        model.weights = weights.reshape(-1, GATES).astype(np.float32)
        model.refine = (ones.reshape(256, -1) + model.refine * 20) / (every.reshape(256, -1) + 20)
    for x in shared:
        x.unpersist()
    return model


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the lower-cased texts, an end behind each text's, and how many each text has."""
    hashes: list[int] = []
    sizes = []
    for text in texts:
        words = text.lower().split()
        hashes.extend(map(xxhash.xxh3_64_intdigest, words))
        hashes.append(_END_HASH)
        sizes.append(len(words) + 1)
    return np.array(hashes, U), np.array(sizes)


_END_HASH = xxhash.xxh3_64_intdigest(b"\n")


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row.

    Documents whose crc32 of the doc_id as text leaves 2 modulo 7 are held out; the others are learned
    from. Tokens are words between ASCII white space, A-Z lower-cased, and one end for each text. ``base_score``
    adds log10((c + 1) / (N + V + 1)) over the tokens, ``score`` is the model's log10 probability of
    the whole text as bytes with its end. Null texts are empty; a null doc_id counts as an empty
    name; repeated rows are learned from, and scored, as often as they come. Without training
    documents N and V are 0 and the model is its untrained start. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every = written(corpus_counts(docs), "lm-counts")
    counts = every.where(F.col("kind") == TOKEN).select(F.col("key").alias("token"), "c")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(totals[0]), int(totals[1])
    top = counts.orderBy(F.desc("c"), "token").limit(FREQUENT).toPandas()  # bounded: FREQUENT rows
    order = np.argsort(top["token"].to_numpy().astype(np.int64).view(U), kind="stable")
    known, times = top["token"].to_numpy().astype(np.int64).view(U)[order], top["c"].to_numpy().astype(np.int64)[order]
    whole = len(known) == v
    model = trained(docs, every)
    context = docs.sparkSession.sparkContext
    shared, frequent = context.broadcast(model.pack()), context.broadcast((known, times))

    code = model.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpack(code, shared.value)
        known, c = frequent.value
        logs = np.log10(c + 1.0)
        for ids, texts in pieces(batches, lambda doc: True):
            keys, ends = keys_of(texts)
            rank = np.argsort(keys)
            keys = keys[rank]
            new = np.append(True, keys[1:] != keys[:-1])
            each = np.empty(len(keys), np.float32)
            each[rank] = own.log10(keys[new])[np.cumsum(new) - 1]
            total = np.add.reduceat(each.astype(float), np.append(0, ends[:-1]))
            del keys, rank, new, each

            tokens, sizes = token_hashes(texts)
            begin = np.cumsum(sizes) - sizes
            rank = np.argsort(tokens)
            tokens = tokens[rank]
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            runs = np.diff(np.append(first, len(tokens)))
            at = np.minimum(np.searchsorted(known, tokens[first]), max(0, len(known) - 1))
            hit = known[at] == tokens[first] if len(known) else np.zeros(len(first), bool)
            worth = np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(first))
            value, found = np.empty(len(tokens)), np.empty(len(tokens), bool)
            value[rank], found[rank] = np.repeat(worth, runs), np.repeat(hit, runs)
            doc = np.repeat(np.arange(len(texts)), sizes)
            rest = rank[np.repeat(~hit, runs)] if not whole else rank[:0]
            rest = rest[np.argsort(doc[rest], kind="stable")]
            back = np.empty(len(tokens), U)
            back[rank] = tokens
            offsets = np.searchsorted(doc[rest], np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array([not train_rule(i) for i in ids]),
                pa.array(sizes),
                pa.array(np.add.reduceat(found.astype(np.int64), begin)),
                pa.array(np.add.reduceat(value, begin)),
                pa.array(total),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(back[rest].view(np.int64))),
            ], NAMES)

    NAMES = ["doc_id", "held_out", "n_tokens", "hits", "logs", "score", "n_bytes", "rest"]
    local = docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, hits long, logs double, score double, n_bytes long, rest array<long>")
    local = written(local.withColumn("row", F.monotonically_increasing_id()), "lm-local")
    rare = local.select("row", F.explode("rest").alias("token"))
    found = rare.join(counts, "token").groupBy("row").agg(F.count("*").alias("hits2"), F.sum(F.log10(F.col("c") + 1)).alias("logs2"))
    out = local.drop("rest").join(found, "row", "left")
    base = F.col("logs") + F.coalesce("logs2", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    bits = -F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("hits2", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", bits.alias("bits_per_byte"))
