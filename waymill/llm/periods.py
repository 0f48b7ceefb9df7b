"""Periodic runs of words, by the runs theorem.

Every maximal repetition holds a Lyndon root that is the longest Lyndon word at its place, under the order of words or
under its reverse. The longest Lyndon word at i ends where the next smaller suffix begins, so that the next smaller
values of the inverse suffix array, and of its mirror, give 2n candidates (i, period). A candidate is extended to
the right by the longest common prefix of the suffixes i and i + period (the minimum of the LCP array between their
ranks, by a sparse table), to the left by bisecting on the same question, and kept if it is long enough.

Texts are searched many at a time: the text's number is the first letter of all its suffixes, so that suffixes of
different texts never share a prefix and each text ends with a word smaller than all others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.merkle import CRC_TABLE_SQL, crc_sql

#: Words of the texts that are searched together; a longer text is searched alone.
WORDS = 1 << 18
#: A run has at least LEAST words and at least TIMES periods.
LEAST, TIMES = 6, 4
#: Comparisons that are made one by one.
FEW = 32

Edit = Callable[[int | None, list[bytes]], list[bytes]]


def ranks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) of an array of numbers, whose last one is smaller than any other.

    Prefix doubling: suffixes in a group agree on as many letters as the round has reached, and only groups of two
    and more are sorted again, by the group of the suffix behind those letters.
    """
    n = len(first)
    order = np.argsort(first, kind="stable").astype(np.int64)
    values = first[order]
    head = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if n else np.empty(0, np.int64)
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, size)
    open_, span, k = head[size > 1], size[size > 1], 1
    while len(open_):
        slots = np.repeat(open_ - np.cumsum(span) + span, span) + np.arange(span.sum())
        suffix = order[slots]
        group = np.repeat(open_, span)
        behind = suffix + k
        key = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        by = np.lexsort((key, group))
        suffix, key = suffix[by], key[by]
        order[slots] = suffix
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(key)))
        head = slots[at]
        rank[suffix] = np.repeat(head, size)
        open_, span = head[size > 1], size[size > 1]
        k *= 2
    return order, rank


def agreeing(first: np.ndarray, a: int, b: int) -> int:
    """How many letters from a and b on are the same, compared in blocks that double."""
    done, width = 0, 64
    room = len(first) - max(a, b)
    while done < room:
        width = min(width, room - done)
        differ = np.flatnonzero(first[a + done : a + done + width] != first[b + done : b + done + width])
        if len(differ):
            return done + int(differ[0])
        done += width
        width *= 2
    return done


def common_prefixes(first: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r]: letters that the suffixes of ranks r - 1 and r share.

    What a suffix shares with the one before it is at least what its predecessor in the text shares with its own,
    less one, so that only starts of stretches that agree so are compared: all together a letter at a time, and the last
    few each for itself.
    """
    n = len(first)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    # A suffix whose left neighbour in the text goes on like the left neighbour of the suffix before it shares one letter less.
    led = np.zeros(n, bool)
    led[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (first[:-1] == first[np.maximum(before[1:] - 1, 0)])
    shared = np.zeros(n, np.int64)
    go = np.flatnonzero(~led & (before >= 0))
    done = 0
    while len(go) > FEW:
        a, b = go + done, before[go] + done
        fits = (a < n) & (b < n)
        fits[fits] = first[a[fits]] == first[b[fits]]
        go = go[fits]
        shared[go] += 1
        done += 1
    for i in go.tolist():
        shared[i] = done + agreeing(first, i + done, int(before[i]) + done)
    # Led suffixes: their stretch's first value, less their distance from it.
    starts = np.maximum.accumulate(np.where(led, 0, np.arange(n)))
    shared = shared[starts] - (np.arange(n) - starts)
    return shared[order]


def sparse(values: np.ndarray) -> list[np.ndarray]:
    """table[k][i]: the least of 2**k values from i on."""
    out = [values]
    width = 1
    while 2 * width <= len(values):
        out.append(np.minimum(out[-1][:-width], out[-1][width:]))
        width *= 2
    return out


def least(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least value in lo..hi (hi excluded, lo < hi)."""
    k = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), table[0].dtype)
    for level in np.unique(k):
        at = k == level
        t = table[level]
        out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << int(level))])
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or len(values): steps double until a block holds one, then halve."""
    n = len(values)
    table = sparse(values)
    out = np.full(n, n)
    at, place = np.arange(n), np.arange(1, n + 1)
    hit_at, hit_place, hit_level = [], [], []
    for k in range(len(table)):
        room = place + (1 << k) <= n
        found = np.zeros(len(at), bool)
        found[room] = table[k][place[room]] < values[at[room]]
        for part, mask in ((hit_at, found), (hit_place, found)):
            part.append((at if part is hit_at else place)[mask])
        hit_level.append(np.full(found.sum(), k))
        # The rest goes on behind the block; where the block didn't fit, the level below is tried again.
        rest = room & ~found
        short = at[~room], place[~room]
        for down in range(k - 1, -1, -1):
            a, p = short
            fits = p + (1 << down) <= n
            low = np.zeros(len(a), bool)
            low[fits] = table[down][p[fits]] < values[a[fits]]
            hit_at.append(a[low])
            hit_place.append(p[low])
            hit_level.append(np.full(low.sum(), down))
            short = a[~low], np.where(fits, p + (1 << down), p)[~low]
        at, place = at[rest], place[rest] + (1 << k)
    at, place, level = np.concatenate(hit_at), np.concatenate(hit_place), np.concatenate(hit_level)
    for k in range(len(table) - 2, -1, -1):
        go = level > k
        a, p = at[go], place[go]
        left = table[k][p] < values[a]
        place[go] = np.where(left, p, p + (1 << k))
    out[at] = place
    return out


def runs(letters: np.ndarray, texts: np.ndarray, shortest: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of the runs in concatenated texts, by start and period.

    ``letters`` are words as numbers from 1 on with a 0 behind each text, ``texts`` the number of each letter's text.
    """
    empty = np.empty((0, 3), np.int64)
    n = len(letters)
    if n < shortest:
        return empty
    # The last letter of all must be the smallest: texts count down.
    first = (texts.max() - texts) * (int(letters.max()) + 1) + letters
    order, rank = ranks(first)
    table = None
    found = []
    for values in (rank, n - rank):
        i = np.arange(n)
        period = next_smaller(values) - i
        ok = (i + period < n) & (letters > 0)
        i, period = i[ok], period[ok]
        same = first[i] == first[i + period]
        i, period = i[same], period[same]
        if not len(i):
            continue
        if table is None:
            table = sparse(common_prefixes(first, order, rank))

        def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            lo, hi = np.minimum(rank[a], rank[b]), np.maximum(rank[a], rank[b])
            return least(table, lo + 1, hi + 1)

        right = shared(i, i + period)
        # The first whole root of a run starts within its first period, so that at least times - 2 periods follow it.
        far = right >= (times - 2) * period
        i, period, right = i[far], period[far], right[far]
        low, high = np.zeros(len(i), np.int64), np.minimum(i, period)
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = shared(i - mid, i - mid + period) >= mid
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        first_root = low < period
        start, length = (i - low)[first_root], (low + period + right)[first_root]
        p = period[first_root]
        long = length >= np.maximum(shortest, times * p)
        found.append(np.stack([start[long], length[long], p[long]], axis=1))
    if not found:
        return empty
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def covered(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edges)[:n] > 0


def searched(texts: list[list[bytes]], shortest: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The runs of each text, given as its words."""
    codes: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    letters = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    begins = np.cumsum(sizes + 1) - sizes - 1
    for at, words in zip(begins.tolist(), texts):
        letters[at : at + len(words)] = [codes.setdefault(w, len(codes) + 1) for w in words]
    found = runs(letters, of, shortest, times)
    owner = of[found[:, 0]] if len(found) else np.empty(0, np.int64)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, begin in enumerate(begins.tolist()):
        mine = found[cuts[i] : cuts[i + 1]].copy()
        mine[:, 0] -= begin
        out.append(mine)
    return out


def periodic_runs(docs: DataFrame, edit: Edit | None = None, shortest: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each text's runs of words, and the text without their repetitions.

    Words are what ASCII white space separates, compared by their bytes, in whole texts. ``runs`` lists (start, length, period)
    by start and period: a stretch with that smallest period, at least ``shortest`` words and ``times`` periods long,
    which no neighbour extends. ``collapsed`` joins the words that no run holds after its first period. ``edit``
    changes the words of a text first. Null texts have no words; null and repeated ids and any further columns
    make no difference; an empty table gives no rows. A text is searched by one task, in memory proportional to its words.
    """
    schema = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        collapsed, lists = [], []
        for words, found in zip(texts, searched(texts, shortest, times)):
            if len(found):
                words = [w for w, gone in zip(words, covered(len(words), found).tolist()) if not gone]
            collapsed.append(b" ".join(words))
            lists.append([dict(zip(("start", "length", "period"), r)) for r in found.tolist()])
        kept = pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(lists, run_type), kept], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()
                words = edit(doc, words) if edit and words else words
                if ids and size + len(words) > WORDS:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(words)
                size += len(words) + 1
            if ids:
                yield rows(ids, texts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """Repetitions for a tenth of the documents, by crc32 of the id; a null id has none."""
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_digests(docs: DataFrame, edit: Edit | None = planted) -> DataFrame:
    """Per document the number of runs, the longest (of equals the first, then that of the smallest period) with its
    exponent in thousandths, and digests of all runs and of the collapsed text. See ``periodic_runs``."""
    found = periodic_runs(docs, edit)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("l"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("l.length"), -F.col("l.period")
    return out.select("doc_id", "n_runs", (-F.col("l.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * l.length div -l.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Stretches of equal words at each distance, of which those with a smaller period are left out.
ORACLE_SQL = f"""
WITH {CRC_TABLE_SQL},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, {crc_sql('doc_id::VARCHAR')} AS h FROM documents, ct),
m AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g FROM d),
e AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE ws[1:a] || list_transform(range(n - a), lambda i: ws[a + i % (1 + (n - a) // (3 + g % 8)) + 1]) END AS ws FROM m),
w AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS w FROM e),
p AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i AND b.i - a.i <= a.n // {TIMES}),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q)),
r AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.doc_id = s.doc_id AND z.q < s.q AND z.start <= s.start AND z.start + z.length >= s.start + s.length)),
t AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, q := q), (-length, start, q)) AS l, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY doc_id),
k AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r) x ON x.doc_id = w.doc_id AND x.i = w.i WHERE x.i IS NULL GROUP BY w.doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, l.start, l.length, l.q AS period, 1000 * l.length // l.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""
