"""Mixing sources to target weights: tempered shares, and a token budget dealt out in permuted blocks."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymill.llm.common import packed, unpacked, written

#: Exponents tried in one pass over the sources; ROUNDS passes leave an interval of GRID ** -ROUNDS.
GRID, ROUNDS = 64, 4
#: Exponents over one are first looked for on a scale of fourth roots of two, up to 65,536.
STEPS_UP = 64
BLOCK_TOKENS, BLOCK_ROWS = 200_000, 200_000
#: Bits of a block's hash that name its range in the running sums.
SPAN_BITS = 12


@dataclass(frozen=True)
class Target:
    """What the mixture aims at: an entropy as a part of that of equal weights, no source repeated
    more than ``repeats`` times, and a budget as a multiple of the tokens there are."""

    entropy: float | None = 0.9
    repeats: float = 4.0
    budget: float = 1.0


def count_tokens(text):
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def exponent(sources: DataFrame, target: Target) -> float:
    """The largest flattening allowed: the smallest exponent that meets the target entropy and repeats no
    source too often. Shares raised to 1 are the natural mixture, to 0 equal weights, and above 1 the
    mixture is sharper than the natural one, for sources more equal than the target.

    Entropy falls as the exponent rises; repetition falls up to 1 and rises beyond. So intervals are
    bisected; each pass over the sources tries GRID exponents at once. Only sums for each exponent reach the
    driver. If no exponent does both, repeats are kept, the nearest entropy is taken and a warning is given.
    """
    sources = sources.where("tokens > 0")
    whole = sources.agg(F.sum("tokens"), F.count("*"), F.max("tokens")).first()
    if not whole[1]:
        return 1.0
    total, n, largest = float(whole[0]), whole[1], float(whole[2])

    def tried(tries: list[float]) -> list[tuple[bool, bool]]:
        """For each exponent whether it meets the entropy, and whether it keeps the repeats."""
        q = F.col("tokens") / F.lit(largest)
        each = sources.select("tokens", F.posexplode(F.array(*[F.pow(q, F.lit(t)) for t in tries])).alias("i", "p"))
        sums = each.groupBy("i").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plogp"), F.max(F.col("p") / F.col("tokens")).alias("most")).collect()

        def fits(r) -> tuple[bool, bool]:
            entropy = _ln(r["z"]) - r["plogp"] / r["z"]
            most = r["most"] / r["z"] * target.budget * total
            even = target.entropy is not None and n > 1 and entropy > target.entropy * _ln(n) + 1e-12
            return not even, most <= max(target.repeats, target.budget) + 1e-12

        return [fits(r) for r in sorted(sums, key=lambda r: r["i"])]

    def grid(low: float, high: float) -> list[float]:
        return [low + (high - low) * i / GRID for i in range(GRID + 1)]

    low, high = 0.0, 1.0
    for k in range(ROUNDS):
        tries = grid(low, high)
        good = [i for i, r in enumerate(tried(tries)) if all(r)]
        if not good and not k:
            break
        first = good[0] if good else GRID
        low, high = tries[max(0, first - 1)], tries[first]
    else:
        return round(high, 6)

    tries = [2.0 ** (i / 4) for i in range(STEPS_UP + 1)]
    for k in range(ROUNDS + 1):
        got = tried(tries)
        end = next((i for i, (meets, keeps) in enumerate(got) if meets or not keeps), None)
        if end is None and not k:
            warnings.warn("no exponent meets the entropy of the target; the mixture is the natural one", stacklevel=2)
            return 1.0
        end = len(tries) - 1 if end is None else end
        low, high, (meets, keeps) = tries[max(0, end - 1)], tries[end], got[end]
        tries = grid(low, high)
    if meets and keeps:
        return round(high, 6)
    warnings.warn("the entropy of the target can't be met within its repeats; the nearest is taken", stacklevel=2)
    return int(low * 10**6) / 10**6


def _ln(x: float) -> float:
    import math

    return math.log(x)


def _number(*parts):
    """Sixty bits of the MD5 of the parts, which SQL elsewhere knows too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, target: Target = Target(), seed: int = 17, block_tokens: int = BLOCK_TOKENS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of documents (source, text, ...) with n_tokens, weight, block, position and copies.

    Each source gets ``budget x weight`` tokens: as many whole passes as fit, and then the blocks of
    one more pass in permuted order up to the rest, so that no source exceeds its budget. Documents
    are dealt to blocks by hash, in numbers that follow the tokens and the rows of the source; running sums go over
    blocks first and then inside each block, so that no source is gathered in one task.
    ``copies`` is how often a document is used (0: not at all); ``position`` orders one pass.

    A null source is a source of its own; null and empty texts have no tokens and follow their
    neighbours in the block; repeated rows are rows of their own. Input columns with the names of the five new ones
    are replaced, any other is kept. An empty table gives no rows.
    """
    own = ["n_tokens", "weight", "block", "position", "copies"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    order = _number(F.lit(seed), name, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    keyed = packed(docs, name.alias("_s"), order.alias("_h"))
    # Texts are split once; all that follows reads these narrow rows.
    marked = written(docs.select(name.alias("_s"), order.alias("_h"), count_tokens(text).alias("n_tokens")), "mix-rows")
    sources = written(marked.groupBy("_s").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-sources")
    t = exponent(sources, target)
    # Shares are whole numbers, and tokens due are divided exactly: a natural mixture is whole passes.
    largest = sources.agg(F.max("tokens")).first()[0] or 1
    share = F.col("tokens") if t == 1 else F.rint(F.pow(F.col("tokens") / F.lit(float(largest)), F.lit(t)) * 1e15)
    shares = sources.withColumn("p", F.when(F.col("tokens") > 0, share).otherwise(0).cast("decimal(19,0)"))
    z, total = shares.agg(F.sum("p"), F.sum("tokens")).first()
    budget = int(Decimal(str(target.budget)) * (total or 0))
    plan = shares.select(
        "_s",
        "tokens",
        (F.col("p").cast("double") / float(z) if z else F.lit(0.0)).alias("weight"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens)), F.ceil(F.col("rows") / F.lit(block_rows))).cast("long").alias("blocks"),
        (F.expr(f"(p * {budget}BD) div {z}BD") if z else F.lit(0)).cast("long").alias("due"),
    )
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("due") / F.col("tokens"))).otherwise(0).cast("long")).withColumn("rest", F.col("due") - F.col("passes") * F.col("tokens")).select("_s", "weight", "blocks", "passes", "rest")

    if sources.count() <= 10_000:
        plan = F.broadcast(plan)
    small = marked.join(plan, "_s").withColumn("block", F.col("_h") % F.col("blocks"))
    small = small.withColumn("_b", _number(F.lit(seed + 1), F.col("_s"), F.col("block").cast("string")))
    # Blocks stand in the order of their hash; its top bits make ranges, so that even a source of very many
    # blocks is summed over 2**SPAN_BITS ranges first and inside each range then.
    totals = small.groupBy("_s", "_b").agg(F.sum("n_tokens").alias("t")).withColumn("_r", F.shiftright("_b", 60 - SPAN_BITS))
    ranges = totals.groupBy("_s", "_r").agg(F.sum("t").alias("t"))
    ranges = ranges.select("_s", "_r", F.sum("t").over(W.partitionBy("_s").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)).alias("low"))
    within = F.sum("t").over(W.partitionBy("_s", "_r").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    before = totals.withColumn("high", within).join(ranges, ["_s", "_r"])
    before = before.select("_s", "_b", (F.coalesce("low", F.lit(0)) + F.coalesce("high", F.lit(0))).alias("before"))
    inside = W.partitionBy("_s", "_b").orderBy("_h").rowsBetween(W.unboundedPreceding, 0)
    same = [F.max(c).alias(c) for c in ("n_tokens", "weight", "block", "passes", "rest")]
    keys = small.groupBy("_s", "_b", "_h").agg(F.sum("n_tokens").alias("t"), *same)
    ends = keys.join(before, ["_s", "_b"]).withColumn("position", F.col("before") + F.sum("t").over(inside))
    copies = F.col("passes") + (F.col("position") <= F.col("rest")).cast("long")
    ends = ends.select("_s", "_h", "n_tokens", "weight", "block", "position", copies.alias("copies"))
    return unpacked(keyed.join(ends, ["_s", "_h"]), *own, without=own)
