"""Helpers shared by the corpus operators: shared scratch folders, tables and graph components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.scratch import cut, shared_dir, written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *columns, without=()) -> DataFrame:
    """Rows with their columns in one struct ``_row`` beside the given columns, so that no name can clash.
    Columns in ``without`` travel beside the struct only, where they are given."""
    kept = [docs[f"`{c}`"] for c in docs.columns if c not in without]
    return docs.select(F.struct(*kept).alias("_row") if kept else F.struct(F.lit(None).alias("_")).alias("_row"), *columns)


def unpacked(df: DataFrame, *columns, without=()) -> DataFrame:
    """The columns of ``_row`` but those in ``without``, with further columns behind them."""
    names = [f.name for f in df.schema["_row"].dataType.fields if f.name not in without]
    return df.select(*[df["_row"].getField(n).alias(n) for n in names], *columns)


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def let(value, body):
    """``body(value)`` with the value computed once. A projection alone would be inlined into lambdas,
    and computed again for each element."""
    return F.transform(F.array(value), body)[0]


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (i, j) connect it with."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        rest = a != b
        if not rest.any():
            break
        i, j, a, b = i[rest], j[rest], a[rest], b[rest]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def _signature(edges: DataFrame):
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): rows (node, root) of every node but the roots.

    ``root`` is the smallest node of the component. Rounds of large-star and small-star move all
    edges towards the smallest neighbour until only stars are left; the number of rounds grows with
    the logarithm of the longest path. Minima are combined before the shuffle and the joins can be
    split where one key has many rows, so a hub is never gathered in one task. Loops and repeated
    edges are ignored; an empty input gives an empty result.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
