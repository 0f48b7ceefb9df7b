"""Toxicity by a classifier chain: one linear model for each category, later ones fed with earlier probabilities.

Categories are predicted in order. Each model is a logistic regression over the presence of words and
word beginnings, plus the probabilities of the categories before it; in training those are
out-of-fold predictions, so that a model never sees what its predecessor knew by heart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymill.llm.common import written

#: Labelled rows that a model is fitted on at most, features it keeps, folds, and lengths of word beginnings.
SAMPLE, FEATURES, FOLDS, BEGINNINGS = 20_000, 1024, 5, (4, 5)
#: A feature is kept if its rate differs between the classes by so many standard errors.
LEAST_Z = 6.0
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text: str | None) -> set[str]:
    """The distinct words of the whole text, and the beginnings (with a star) of longer ones."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass
class Link:
    """One model of the chain."""

    category: str
    weights: np.ndarray  # of the features, of the earlier categories' probabilities, and the constant
    threshold: float = 0.5


@dataclass
class Chain:
    index: dict[str, int]
    links: list[Link] = field(default_factory=list)

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of every known feature present."""
        row, of = [], []
        for i, text in enumerate(texts):
            got = [self.index[f] for f in features(text) if f in self.index]
            row += [i] * len(got)
            of += got
        return np.array(row, np.int64), np.array(of, np.int64)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        row, of = self.rows(texts)
        p = np.empty((len(texts), len(self.links)))
        for k, link in enumerate(self.links):
            p[:, k] = predict(row, of, p[:, :k], link.weights, len(self.index))
        return p


def predict(row: np.ndarray, of: np.ndarray, earlier: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    n = len(earlier)
    z = np.bincount(row, weights[:m][of], n) + earlier @ weights[m:-1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(row: np.ndarray, of: np.ndarray, earlier: np.ndarray, y: np.ndarray, m: int, steps: int = 250, penalty: float = 0.02) -> np.ndarray:
    """Penalised logistic regression by accelerated gradient steps; constant rates for a single class."""
    n, k = earlier.shape
    w = np.zeros(m + k + 1)
    rate = np.clip(y.mean() if n else 0, 1e-6, 1 - 1e-6)
    w[-1] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return w
    df = np.bincount(of, minlength=m)
    curve = np.concatenate([df, np.full(k, n), [n]]) * 0.25 + penalty
    per_row = np.bincount(row, minlength=n).max(initial=0) + k + 1
    v, step = w.copy(), 1.0 / (curve * min(per_row, 12))
    for i in range(steps):
        g = predict(row, of, earlier, v, m) - y
        grad = np.concatenate([np.bincount(of, g[row], m), g @ earlier, [g.sum()]]) + penalty * np.append(v[:-1], 0)
        after = v - step * grad
        v = after + i / (i + 3) * (after - w)
        w = after
    return w


#: A cut that no probability reaches.
NEVER = 1.01


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 of out-of-fold probabilities, halfway to the next one below.

    Where no cut does better than calling every row positive, the model tells nothing apart, and
    none is called positive: the cut is out of reach.
    """
    if not y.any():
        return NEVER
    if y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    every = f1[-1]
    f1[:-1][p[order][:-1] == p[order][1:]] = 0
    at = int(f1.argmax())
    if at == len(p) - 1 or f1[at] <= every:
        return NEVER
    return float(np.clip((p[order[at]] + p[order[at + 1]]) / 2, 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> Chain:
    """A chain over ``categories`` (name: SQL condition over the labels) fitted on a bounded sample of labelled rows.

    The sample is the ``sample`` labelled rows with the least hash of doc_id; it bounds what reaches the
    driver. Of documents that share an id the least text counts. Counts of features are combined inside tasks; only features whose rate differs
    clearly between the classes of some category are kept, at most FEATURES of them.
    """
    names = list(categories)
    chosen = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *[F.expr(f"({c})").cast("int").alias(f"y_{n}") for n, c in categories.items()])
    chosen = chosen.dropna().orderBy(F.xxhash64("doc_id"), *chosen.columns).limit(sample)
    ids = chosen.select("doc_id").distinct()
    # One text for each id: rows that repeat an id would otherwise multiply what the sample bounds.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = written(texts.join(F.broadcast(chosen), "doc_id").select("text", *[f"y_{n}" for n in names]), "toxicity-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        positive = [Counter() for _ in names]
        for batch in batches:
            ys = [batch.column(f"y_{n}").to_pylist() for n in names]
            for i, text in enumerate(batch.column("text").to_pylist()):
                got = features(text)
                total.update(got)
                for k, y in enumerate(ys):
                    if y[i]:
                        positive[k].update(got)
        keys = list(total)
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([total[f] for f in some], pa.int64()), *[pa.array([p[f] for f in some], pa.int64()) for p in positive]], ["feature", "df", *[f"pos_{n}" for n in names]])

    size = rows.agg(F.count("*"), *[F.sum(f"y_{n}") for n in names]).first()
    n = size[0]
    if not n:
        return Chain({}, [Link(c, np.array([0.0] * k + [-35.0])) for k, c in enumerate(names)])
    sums = rows.mapInArrow(count, "feature string, df long, " + ", ".join(f"pos_{c} long" for c in names)).groupBy("feature").agg(F.sum("df").alias("df"), *[F.sum(f"pos_{c}").alias(f"pos_{c}") for c in names])
    z = []
    for k, c in enumerate(names):
        n1 = size[1 + k] or 0
        n0 = n - n1
        if not n1 or not n0:
            continue
        rate = (F.col("df") + 1) / (n + 2)
        gap = F.col(f"pos_{c}") / n1 - (F.col("df") - F.col(f"pos_{c}")) / n0
        z.append(F.abs(gap) / F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0)))
    kept = []
    if z:
        kept = [r[0] for r in sums.where("df >= 4").withColumn("z", F.greatest(*z, F.lit(0.0))).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect()]
    chain = Chain({f: i for i, f in enumerate(sorted(kept))})
    index = chain.index

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sorted(index[f] for f in features(t) if f in index) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), *[batch.column(f"y_{c}") for c in names]], ["of", *[f"y_{c}" for c in names]])

    data = sorted(rows.mapInArrow(present, "of array<int>, " + ", ".join(f"y_{c} int" for c in names)).collect())
    row = np.repeat(np.arange(n), [len(d[0]) for d in data])
    of = np.array([x for d in data for x in d[0]], np.int64)
    fold = np.random.default_rng(n).permutation(n) % FOLDS
    earlier = np.empty((n, 0))
    for k, c in enumerate(names):
        y = np.array([d[1 + k] for d in data], float)
        out = np.empty(n)
        for f in range(FOLDS):
            to, test = fold != f, fold == f
            renumber = np.cumsum(to) - 1
            a = to[row]
            w = fit(renumber[row[a]], of[a], earlier[to], y[to], len(index))
            renumber = np.cumsum(test) - 1
            a = test[row]
            out[test] = predict(renumber[row[a]], of[a], earlier[test], w, len(index))
        chain.links.append(Link(c, fit(row, of, earlier, y, len(index)), best_threshold(out, y)))
        earlier = np.column_stack([earlier, out])
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """All rows and columns of documents with ``p_<category>`` and ``is_<category>`` for each of the chain.

    Whole texts are read; null and empty texts have no features. Columns of these names are replaced.
    """
    added = [f"{kind}_{link.category}" for link in chain.links for kind in ("p", "is")]
    kept = docs.drop(*[c for c in docs.columns if c in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.probabilities(batch.column("text").cast(pa.string()).to_pylist())
            columns = list(batch.columns)
            for k, link in enumerate(chain.links):
                columns += [pa.array(p[:, k]), pa.array(p[:, k] >= link.threshold)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])

    schema = StructType(list(kept.schema.fields))
    for name in added:
        schema = schema.add(name, "double" if name.startswith("p_") else "boolean")
    return kept.mapInArrow(run, schema)


#: The labels' categories in the order of the chain: junk text first, its probability then helps with toxicity.
CATEGORIES = {"junk": "quality = 0", "toxic": "toxic = 1"}


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents scored by a chain that is trained on their labels (doc_id, quality, toxic).

    Labels that are null or whose document is missing aren't used; rows that repeat a label
    count as often as they come. Without labels, or where no word tells the classes apart, every document gets
    the rate of the labels and none is called toxic; only where all labels are toxic, all are. An empty
    table gives no rows.
    """
    return score(docs, train(docs, labels, CATEGORIES, sample))
