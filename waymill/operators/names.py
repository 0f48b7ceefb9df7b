"""Looking for many texts in many names: an inverted index of short grams instead of a scan for each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Letters of the longest grams.
GRAM = 3


def grams(text: Column, longest: int = GRAM) -> Column:
    """All different stretches of up to ``longest`` letters, the empty one too."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    every = F.concat(F.array(F.lit("")), *[F.when(F.length(text) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)])
    return F.array_distinct(every)


def index(names: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """(gram, key) of names; a null name has no gram. To be written once, partitioned or sorted by gram."""
    return names.where(F.col(name).isNotNull()).select(key, F.explode(grams(F.col(name))).alias("gram"))


def containing(names: DataFrame, indexed: DataFrame, wanted: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """(text, key, name) of the names that hold a text as LIKE has it: ``%`` is any stretch and ``_`` any letter in ``wanted`` (text).

    A text is looked up by the rarest gram of its letters between wildcards, and what has that gram is compared
    whole, so that the work is that of the rarest grams' lists. A text without letters is looked up by the empty
    gram, which all names have. A backslash is a letter. Null texts find nothing, and repeated ones are looked for once.
    """
    texts = wanted.where("text IS NOT NULL").select("text").distinct()
    stretches = F.split("text", "[%_]")
    own = texts.select("text", F.explode(F.array_distinct(F.flatten(F.transform(stretches, lambda t: grams(t))))).alias("gram"))
    counts = indexed.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("text").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), (-F.length("gram")).alias("l"), "gram")).alias("gram"))
    found = rarest.join(indexed, "gram").select("text", key).join(names.select(key, name), key)
    pattern = F.concat(F.lit("%"), F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return found.where(F.like(F.col(name), pattern)).select("text", key, name)


def best(found: DataFrame, k: int, key: str = "id", name: str = "name") -> DataFrame:
    """The first ``k`` names of each text, by name and key."""
    order = W.partitionBy("text").orderBy(name, key)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
