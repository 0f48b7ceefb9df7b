"""Benchmark decontamination by winnowing, in DataFrame operations only.

A span of ``span`` words shared by a document and a benchmark item holds the same ``span - gram + 1``
consecutive word grams on both sides, so both sides keep the same minimum hash of that window. Joining
the kept hashes finds every shared span; the hit windows are then compared word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import ascii_lower, let, written

#: Everything in ASCII but digits and letters separates words; all other characters belong to them.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of the benchmark and their hashes are broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 500_000


def words(text):
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def window_starts(w, span: int):
    """1, 2, ... for each window of ``span`` words; empty for shorter texts."""
    return F.when(F.size(w) >= span, F.sequence(F.lit(1), F.size(w) - span + 1)).otherwise(F.array().cast("array<int>"))


def minima(w, span: int, gram: int):
    """For each window the least hash of its grams, words hashed once, grams over the words' hashes."""

    def over_words(hashes):
        return F.transform(window_starts(hashes, gram), lambda s: F.xxhash64(*[F.get(hashes, s + (i - 1)) for i in range(gram)]))

    def over_grams(grams):
        return F.transform(window_starts(grams, span - gram + 1), lambda s: F.least(*[F.get(grams, s + (i - 1)) for i in range(span - gram + 1)]))

    grams = let(F.transform(w, lambda x: F.xxhash64(x)), over_words)
    return grams if span == gram else let(grams, over_grams)


def joined_windows(w, starts, span: int):
    """(s, win): each start with the words of its window."""
    return F.transform(starts, lambda s: F.struct(s.alias("s"), F.concat_ws(" ", F.slice(w, s, span)).alias("win")))


def shared_windows(w, span: int, gram: int, wanted):
    """The windows whose minimum is among the wanted hashes."""
    return let(minima(w, span, gram), lambda least: joined_windows(w, F.filter(window_starts(w, span), lambda s: F.array_contains(wanted, F.get(least, s - 1))), span))


def tagged(n: int, name: str):
    """A lambda that puts a window's length beside a value."""
    return lambda x: F.struct(F.lit(n).alias("n"), x.alias(name))


def contamination(docs: DataFrame, bench: DataFrame, span: int = 10, gram: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of documents (doc_id, text).

    A window is ``span`` consecutive words of an item (item_id, text), or a whole item that has
    fewer words but at least one. ``n_hit`` counts the words of a document inside any occurrence
    of a window. Null texts have no words. Rows that repeat a doc_id with the same text share one
    result; with different texts each is judged alone. Items that repeat are one item if their ids
    are equal; an item without id counts under the id ''. Empty tables give no rows or no hits.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.withColumn("key", F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")))
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    sides = []
    for n in range(1, span + 1):
        part = items.where(F.size("w") >= n if n == span else F.size("w") == n)
        part = part.select("item_id", minima(F.col("w"), n, min(gram, n)).alias("fp"), let(F.col("w"), lambda w: joined_windows(w, window_starts(w, n), n)).alias("at"))
        sides.append(part.select("item_id", F.lit(n).alias("n"), F.explode(F.arrays_zip("fp", "at")).alias("r")).select("item_id", "n", "r.fp", "r.at.win"))
    windows = sides[0]
    for side in sides[1:]:
        windows = windows.unionByName(side)
    windows = written(windows.distinct(), "winnow-windows")
    kept = windows.select("n", "fp").distinct()
    sizes = {r["n"]: r["rows"] for r in kept.groupBy("n").agg(F.count("*").alias("rows")).collect()}
    small = windows.count() <= BROADCAST_ROWS
    if small:
        kept = F.broadcast(kept)

    lengths = sorted(sizes)
    found = None
    if lengths:
        # One pass and one split of each text for all lengths of windows.
        def prints(w):
            return F.concat(*[F.transform(F.array_distinct(minima(w, n, min(gram, n))), tagged(n, "fp")) for n in lengths])

        found = keyed.select("key", F.explode(let(words(F.col("text")), prints)).alias("r")).select("key", "r.n", "r.fp").join(kept, ["n", "fp"], "left_semi")
    counted = keyed.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if found is None:
        return counted.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))

    # The windows of documents with a shared hash, kept where their minimum is one of the shared ones.
    suspects = found.groupBy("key").pivot("n", lengths).agg(F.collect_set("fp"))
    texts = keyed.join(suspects.hint("shuffle_hash"), "key").drop("doc_id")

    def shared(w):
        each = [F.transform(shared_windows(w, n, min(gram, n), F.col(str(n))), tagged(n, "at")) for n in lengths]
        none = F.array().cast("array<struct<n:int,at:struct<s:int,win:string>>>")
        return F.concat(*[F.when(F.size(str(n)) > 0, e).otherwise(none) for n, e in zip(lengths, each)])

    at = texts.select("key", F.explode(let(words(F.col("text")), shared)).alias("r")).select("key", "r.n", "r.at.s", "r.at.win")
    known = windows.select("n", "win").distinct()
    # A window of one common word is one hot key; broadcast windows meet it where it is, and beyond that
    # skewed partitions of the join are split at run time.
    extended = written(at.join(F.broadcast(known) if small else known, ["n", "win"]), "winnow-hits")
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("s", "n")), lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1))))
    hit = extended.groupBy("key").agg(F.size(covered).cast("long").alias("n_hit"))
    named = extended.select("key", "n", "win").distinct().join(windows.select("n", "win", "item_id"), ["n", "win"]).select("key", "item_id").distinct()
    named = named.groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    out = counted.join(hit, "key", "left").join(named, "key", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM bi),
ns AS (SELECT DISTINCT n FROM win),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, ns WHERE len(w) >= n),
hits AS (SELECT d.doc_id, d.s, d.n, b.item_id FROM (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM di) d JOIN win b USING (n, win)),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
