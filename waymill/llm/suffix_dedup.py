"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Every window of ``MATCH`` bytes is represented by one suffix: the one in it that starts with the
smallest hash of ``GRAM`` bytes. Equal windows choose it at the same place, so sorting these sparse
suffixes (about three in a hundred positions) brings all repeats together. Neighbouring windows that
choose the same suffix form a run, and the bytes of a run are the suffix's context.

Batches of documents become suffix arrays, sorted by the hashes of gram and context: only equality
counts here, and hashes sort as well as letters. Each shard of the hash range keeps a family of
levels; a new batch enters as a level, levels of about equal size are merge-scanned into one, and of
entries with equal contexts the earliest stays while the windows of the others are repeats. What is
left, suffixes with equal grams in different contexts, is settled window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.llm.common import written

MATCH, GRAM = 100, 32
#: Bytes hashed at once, bytes of a batch, bytes of contexts and windows sent at once, bytes of text for
#: each shard, and the fewest and most shards: beyond a terabyte shards grow instead, since each batch sends
#: a blob to each, and partitions hold several.
PIECE, BATCH, SENT, SHARD, SHARDS, MOST, PARTITIONS = 2_000_000, 64_000_000, 16_000_000, 8_000_000, 64, 131_072, 32_768
#: A gram with this many contexts in one batch, or this many in one shard, is dealt out by window instead.
HOT_BATCH, HOT_SHARD = 32, 4096

_rng = np.random.default_rng(20_240_607)
TABLES = _rng.integers(0, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out)


class Rolling:
    """Polynomial hashes of any substrings of a byte array, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        base = BASES[which]
        self.prefix = np.zeros(len(data) + 1, U)
        np.cumsum(TABLES[which][data] * powers(base, len(data)), out=self.prefix[1:])
        self.back = powers(pow(base, -1, 2**64), len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.back[start]


def suffixes(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sparse suffixes of the texts that ``data`` joins and ``ends`` end: gram hash, context hash,
    first window of the run, number of windows, and offset of the gram in the first window."""
    n, w = len(data), MATCH - GRAM + 1
    if n < MATCH:
        return tuple(np.empty(0, t) for t in (U, U, np.int64, np.int64, np.int64))
    raw = np.frombuffer(data + b"\0" * 16, np.uint8)
    eight = np.lib.stride_tricks.as_strided(raw[:8].view(U), (n + 1,), (1,))
    m = n - GRAM + 1
    h = eight[:m] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    for j in range(8, GRAM, 8):
        h += eight[j : m + j]
        h *= U(0xBF58476D1CE4E5B9 + 2 * j)
        h ^= h >> U(31)
    low = (h & U(0xFFFFFFFFFF000000)) | np.arange(m, dtype=U)
    step = 1
    while step * 2 <= w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(low) - (w - step)], low[w - step :])
    at = (low & U(0xFFFFFF)).astype(np.int64)
    p = np.arange(len(at))
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(at)]
    at[p + MATCH > ends[of]] = -1
    first = np.flatnonzero(np.diff(at, prepend=-2))
    last = np.append(first[1:], len(at))
    ok = at[first] >= 0
    first, last = first[ok], last[ok]
    at = at[first]
    count, offset = last - first, at - first
    context = Rolling(raw[:n], 0)(first, last + MATCH - 1)
    return h[at], mixed(context ^ mixed((count * 256 + offset).astype(U))), first, count, offset


def packed(*columns: np.ndarray) -> bytes:
    """Columns as one compressed blob, byte planes apart so that leading zeros vanish."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes, n: int, *types) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for t in map(np.dtype, types):
        size = n * t.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(t.itemsize, n).T).view(t).ravel())
        at += size
    return out


ENTRY = (U, U, np.int64, np.int32, np.uint8, np.uint8, np.uint8)  # gram, context, doc, first window, windows, offset, heat
SPAN = (np.int64, np.int32, np.int32)  # doc, first window, end of windows
WINDOW_KEY = (U, U, np.int64, np.int32)  # two hashes, doc, window
BLOBS = "shard int, kind int, first long, n int, blob binary"


def blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["shard", "kind", "first", "n", "blob"])


def sharded(shard: np.ndarray, kind: int, first: int, columns: list[np.ndarray]) -> Iterator[tuple]:
    order = np.argsort(shard, kind="stable")
    bounds = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for lo, hi in zip(bounds, np.append(bounds[1:], len(order))):
        at = order[lo:hi]
        yield int(shard[at[0]]), kind, first, hi - lo, packed(*(c[at] for c in columns))


def joined_spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Half-open ranges with those that touch in the same document joined."""
    if not len(doc):
        return [doc, lo, hi]
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    new = np.append(True, doc[1:] != doc[:-1])
    base = np.cumsum(new) << 33
    reach = np.maximum.accumulate(hi + base)
    start = new | np.append(True, lo[1:] + base[1:] > reach[:-1])
    at = np.flatnonzero(start)
    return [doc[at], lo[at].astype(np.int32), (np.append(reach[at[1:] - 1], reach[-1]) - base[at]).astype(np.int32)]


def merged(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries sorted by gram and context with the earliest of each, and the spans of the others."""
    h, c, doc, at = columns[:4]
    order = np.lexsort((at, doc, c, h))
    columns = [x[order] for x in columns]
    h, c = columns[:2]
    again = np.append(False, (h[1:] == h[:-1]) & (c[1:] == c[:-1]))
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
    np.maximum.at(columns[6], first, columns[6])
    other = again & (columns[4] > 0) & ((columns[2] != columns[2][first]) | (columns[3] != columns[3][first]))
    doc, at, count = (x[other] for x in columns[2:5])
    return [x[~again] for x in columns], [doc, at, at + count]


class Levels:
    """The logarithmic family of one shard: sorted levels, each at least twice the size of the next."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []
        self.spans: list[list[np.ndarray]] = []

    def add(self, batch: list[np.ndarray], whole: bool = False) -> None:
        self.levels.append(batch)
        while len(self.levels) > 1 and (whole or len(self.levels[-2][0]) < 2 * len(self.levels[-1][0])):
            pair = self.levels[-2:]
            level, spans = merged([np.concatenate(x) for x in zip(*pair)])
            self.levels[-2:] = [level]
            self.spans.append(spans)

    def closed(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        self.add([np.empty(0, t) for t in ENTRY], whole=True)
        return self.levels[0], [np.concatenate(x) for x in zip(*self.spans, [np.empty(0, t) for t in SPAN])]


def batch_suffixes(docs: DataFrame, shards: int) -> DataFrame:
    """Blobs of each batch's suffix array by shard (kind 0), and of spans repeated inside a batch (kind 1)."""

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*parts)]
        columns, spans = merged([*columns, np.zeros(len(columns[0]), np.uint8)])
        if not len(columns[0]):
            return
        h, c, doc = columns[:3]
        new = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(new) - 1
        hot = np.bincount(group)[group] >= HOT_BATCH
        columns[6] = hot.astype(np.uint8)
        at = np.flatnonzero(hot & new)  # a mark (no context, no windows) tells the shard of the gram itself
        marks = [x[at] for x in columns]
        marks[1][:], marks[4][:] = 0, 0
        shard = (np.where(hot, mixed(h ^ mixed(c)), mixed(h)) % U(shards)).astype(np.int64)
        columns = [np.concatenate(x) for x in zip(columns, marks)]
        shard = np.append(shard, (mixed(marks[0]) % U(shards)).astype(np.int64))
        first = int(doc.min())
        rows = list(sharded(shard, 0, first, columns))
        spans = joined_spans(*spans)
        rows += sharded((mixed(spans[0].view(U)) % U(shards)).astype(np.int64), 1, first, spans)
        for i in range(0, len(rows), 256):
            yield blob_batch(rows[i : i + 256])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size = 0
        for ids, data, ends, starts in pieces(batches):
            h, c, first, count, offset = suffixes(data, ends)
            of = np.searchsorted(ends, first, side="right")
            begin = np.append(0, ends[:-1])
            parts.append(tuple(x.astype(t) for x, t in zip((h, c, ids[of], first - begin[of] + starts[of], count, offset), ENTRY)))
            size += len(data)
            if size >= BATCH:
                yield from flush(parts)
                parts, size = [], 0
        if parts:
            yield from flush(parts)

    return docs.select("doc_id", "text").mapInArrow(run, BLOBS)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """Texts joined to pieces of about PIECE bytes: ids, bytes, ends, and each part's place in its text.
    A longer text is cut into parts that overlap by one byte less than a window."""
    held: list[tuple[int, bytes, int]] = []
    size = 0

    def piece():
        return np.array([h[0] for h in held], np.int64), b"".join(h[1] for h in held), np.cumsum([len(h[1]) for h in held]), np.array([h[2] for h in held], np.int64)

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), pc.cast(batch.column("text"), pa.binary())):
            text = text.as_py()
            for at in range(0, max(1, len(text) - MATCH + 1), PIECE):
                part = text[at : at + PIECE + MATCH - 1]
                if len(part) < MATCH:
                    continue
                held.append((doc, part, at))
                size += len(part)
                if size >= PIECE:
                    yield piece()
                    held, size = [], 0
    if held:
        yield piece()


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    from itertools import groupby

    def rows():
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "n", "blob"))):
                yield r

    for shard, run in groupby(rows(), key=lambda r: r[0]):
        yield shard, (r[1:] for r in run)


#: Result rows of a shard: spans of repeated windows (gram null) and suffixes to settle by window.
FOUND = "doc_id long, lo int, hi int, gram long, gap int, hot boolean"


def found_batch(doc, lo, hi, gram=None, gap=None, hot=None) -> pa.RecordBatch:
    n = len(doc)
    columns = [pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
    columns += [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())] if gram is None else [pa.array(gram.view(np.int64)), pa.array(gap.astype(np.int32)), pa.array(hot)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "lo", "hi", "gram", "gap", "hot"])


def scan_levels(blobs: DataFrame, shards: int) -> DataFrame:
    """Each shard's batches in document order through its family of levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_shard(batches):
            family = Levels()
            for kind, n, blob in rows:
                if kind:
                    yield found_batch(*unpacked(blob, n, *SPAN))
                else:
                    family.add(unpacked(blob, n, *ENTRY))
            (h, _, doc, lo, count, offset, heat), spans = family.closed()
            if len(spans[0]):
                yield found_batch(*joined_spans(*spans))
            if not len(h):
                continue
            group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
            size = np.bincount(group)
            warmest = np.zeros(len(size), np.uint8)
            np.maximum.at(warmest, group, heat)
            hot = (warmest[group] > 0) | (size[group] >= HOT_SHARD)
            at = np.flatnonzero(((size[group] > 1) | hot) & (count > 0))
            for i in range(0, len(at), 100_000):
                j = at[i : i + 100_000]
                yield found_batch(doc[j], lo[j], lo[j].astype(np.int64) + count[j], h[j], offset[j], hot[j])

    return blobs.repartition(min(shards, PARTITIONS), "shard").sortWithinPartitions("shard", "first").select("shard", "kind", "n", "blob").mapInArrow(run, FOUND)


def window_keys(texts: DataFrame, shards: int) -> DataFrame:
    """For documents (doc_id, text, at) with the suffixes to settle: contexts to the shards of their
    grams (kind 0), or window hashes to shards of their own where the gram is hot (kind 1)."""

    def flush(cold: list[tuple], hot: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
        rows = []
        if cold:
            gram, doc, lo, count, gap, data = (np.array(x) if i < 5 else x for i, x in enumerate(zip(*cold)))
            shard = (mixed(gram.view(U)) % U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = np.flatnonzero(np.diff(shard[order], prepend=-1))
            for a, b in zip(bounds, np.append(bounds[1:], len(order))):
                at = order[a:b]
                head = packed(gram[at], doc[at], lo[at].astype(np.int32), count[at].astype(np.uint8), gap[at].astype(np.uint8))
                body = zstandard.ZstdCompressor(level=1).compress(b"".join(data[i] for i in at))
                rows.append((int(shard[at[0]]), len(head), first, b - a, head + body))
        if hot:
            k1, k2, doc, lo = (np.concatenate(x) for x in zip(*hot))
            columns, spans = first_windows([k1, k2, doc, lo.astype(np.int32)])
            rows += sharded((columns[0] % U(shards)).astype(np.int64), -1, first, columns)
            if len(spans[0]):
                rows += sharded((mixed(spans[0].view(U)) % U(shards)).astype(np.int64), -2, first, spans)
        for i in range(0, len(rows), 256):
            yield blob_batch(rows[i : i + 256])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold, hot, size, first = [], [], 0, 0
        for batch in batches:
            for doc, text, at in zip(batch.column("doc_id").to_pylist(), pc.cast(batch.column("text"), pa.binary()), batch.column("at")):
                text = text.as_py()
                at = at.values
                lo, hi, gram, gap, is_hot = (at.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "hi", "gram", "gap", "hot"))
                inside = hi + MATCH - 1 <= len(text)
                for i in np.flatnonzero(~is_hot & inside):
                    cold.append((gram[i], doc, lo[i], hi[i] - lo[i], gap[i], text[lo[i] : hi[i] + MATCH - 1]))
                    size += MATCH
                if (some := np.flatnonzero(is_hot & inside)).size:
                    count = hi[some] - lo[some]
                    which = np.repeat(some, count)
                    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    data = np.frombuffer(text, np.uint8)
                    hot.append((*hashed_windows(data, lo[which] + step, gram[which].view(U), gap[which] - step), np.full(len(which), doc, np.int64), lo[which] + step))
                    size += 24 * len(which)
                if size >= SENT:
                    yield from flush(cold, hot, first)
                    cold, hot, size = [], [], 0
        yield from flush(cold, hot, first)

    return texts.mapInArrow(run, BLOBS)


def hashed_windows(data: np.ndarray, start: np.ndarray, gram: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window, its gram and the gram's offset in it."""
    own = mixed(gram ^ mixed(gap.astype(np.int64).view(U)))
    return mixed(Rolling(data, 0)(start, start + MATCH) ^ own), mixed(Rolling(data, 1)(start, start + MATCH) + own)


def first_windows(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of equal windows the earliest, and the spans of the others."""
    k1, k2, doc, at = columns
    order = np.lexsort((at, doc, k2, k1))
    columns = [x[order] for x in columns]
    k1, k2, doc, at = columns
    again = np.append(False, (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]))[: len(k1)]
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(k1))))
    other = again & ((doc != doc[first]) | (at != at[first]))  # a repeated row isn't earlier than itself
    return [x[~again] for x in columns], joined_spans(doc[other], at[other], at[other] + 1)


def settle_windows(blobs: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_shard(batches):
            keys: list[list[np.ndarray]] = []
            for kind, n, blob in rows:
                if kind == -2:
                    yield found_batch(*unpacked(blob, n, *SPAN))
                elif kind == -1:
                    keys.append(unpacked(blob, n, *WINDOW_KEY))
                else:
                    gram, doc, lo, count, gap = unpacked(blob[:kind], n, np.int64, np.int64, np.int32, np.uint8, np.uint8)
                    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[kind:]), np.uint8)
                    count = count.astype(np.int64)
                    begin = np.cumsum(count + MATCH - 1) - (count + MATCH - 1)
                    which = np.repeat(np.arange(n), count)
                    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    keys.append([*hashed_windows(data, begin[which] + step, gram[which].view(U), gap[which].astype(np.int64) - step), doc[which], (lo[which] + step).astype(np.int32)])
            if keys:
                _, spans = first_windows([np.concatenate(x) for x in zip(*keys)])
                if len(spans[0]):
                    yield found_batch(*spans)

    return blobs.repartition(min(shards, PARTITIONS), "shard").sortWithinPartitions("shard").select("shard", "kind", "n", "blob").mapInArrow(run, FOUND)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): ranges of window starts whose windows also start earlier, for rows (doc_id, text)."""
    docs = docs.where("doc_id IS NOT NULL AND octet_length(text) >= 100")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST, max(SHARDS, -(-total // SHARD)))
    found = written(scan_levels(batch_suffixes(docs, shards), shards), "suffix-found")
    at = found.where("gram IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "gram", "gap", "hot")).alias("at"))
    open_texts = docs.join(at.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "at")
    settled = settle_windows(window_keys(open_texts, shards), shards)
    return found.where("gram IS NULL").select("doc_id", "lo", "hi").unionByName(settled.select("doc_id", "lo", "hi"))


def removed_runs(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Maximal removed byte runs [start, end) of a text of n bytes."""
    if not len(lo):
        return np.empty((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order].astype(np.int64), np.minimum(hi[order].astype(np.int64) + MATCH - 1, n)
    reach = np.maximum.accumulate(end)
    new = np.append(True, lo[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return np.stack([lo[at], np.append(reach[at[1:] - 1], reach[-1])], axis=1)


def dedup(docs: DataFrame, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every row (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, the kept text if asked,
    and the columns to carry along.

    A byte goes if a string of MATCH bytes over it also starts earlier: in a smaller doc_id or earlier
    in the same text. Strings are judged on the input and never cross documents. Null texts are empty;
    texts under MATCH bytes are kept. Rows with a null doc_id are kept whole and nobody's earlier copy.
    Rows that repeat a doc_id are one document: equal texts share the result, and of different texts
    each loses the ranges found in any. ``kept_text`` leaves out characters that a cut broke.
    Equal contexts are told by 128 bits of hash. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)
    spans = repeated_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("at"))
    both = docs.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "at", *carry)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, at in zip(batch.column("doc_id").to_pylist(), pc.cast(batch.column("text"), pa.binary()), batch.column("at")):
                text = text.as_py()
                runs = np.empty((0, 2), np.int64)
                if at.is_valid:
                    runs = removed_runs(at.values.field("lo").to_numpy(), at.values.field("hi").to_numpy(), len(text))
                edges = [0, *runs.ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "ignore")) if keep_text else row)
            if out:
                columns = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in carry)], [*names, *carry])

    schema = T.StructType()
    for name in names:
        schema = schema.add(name, "string" if name.startswith("kept") else "long")
    return both.mapInArrow(run, T.StructType([*schema.fields, *(docs.schema[c] for c in carry)]))


#: Every window by its digest: the first by (doc_id, position) stays, runs of the others are cut.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(1, octet_length(h) - 98)) AS pos, h FROM d WHERE octet_length(h) >= 100),
k AS (SELECT doc_id, pos, md5(array_slice(h, pos, pos + 99)) AS k FROM w),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM k) WHERE n > 1),
steps AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM again),
numbered AS (SELECT doc_id, pos, count(*) FILTER (gap IS NULL OR gap > 100) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM steps),
runs AS (SELECT doc_id, min(pos) AS lo, max(pos) + 99 AS hi FROM numbered GROUP BY doc_id, run),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, max(hi) AS last FROM runs GROUP BY doc_id),
pieces AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS a, lo - 1 AS b FROM runs),
heads AS (SELECT doc_id, string_agg(hex(array_slice(h, a, b)), '' ORDER BY lo) AS kept FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex(array_slice(h, (coalesce(last, 0) + 1)::BIGINT, octet_length(h)::BIGINT)))) AS kept_sha256
FROM d LEFT JOIN cuts USING (doc_id) LEFT JOIN heads USING (doc_id)
"""
