import math

import pytest

from waymill.llm import mixing
from waymill.llm.mixing import Target


def entropy(p):
    return -sum(x * math.log(x) for x in p if x > 0)


def slow_exponent(tokens, target):
    tokens = [t for t in tokens if t]
    total = sum(tokens)

    def ok(t):
        p = [(x / total) ** t for x in tokens]
        p = [x / sum(p) for x in p]
        return (target.entropy is None or entropy(p) <= target.entropy * math.log(len(tokens)) + 1e-12) and max(target.budget * total * w / x for w, x in zip(p, tokens)) <= max(target.repeats, target.budget) + 1e-12

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return high


@pytest.mark.parametrize("target", [Target(), Target(entropy=None, repeats=2.0), Target(entropy=0.5), Target(entropy=1.0, repeats=100.0)])
def test_exponent(spark, target):
    tokens = [1_000_000, 50_000, 50_000, 2_000, 17, 0]
    df = spark.createDataFrame([(t,) for t in tokens], "tokens long")
    assert mixing.exponent(df, target) == pytest.approx(slow_exponent(tokens, target), abs=3e-6)


def brute(rows, budgets):
    out = {}
    for s, b in budgets.items():
        mine = sorted((r for r in rows if r.source == s), key=lambda r: r.position)
        total = sum(r.n_tokens for r in mine)
        for r in mine:
            out[r.doc_id] = (b // total if total else 0) + (r.position <= b - (b // total if total else 0) * total)
    return out


def test_budgets_are_met_and_never_exceeded(spark, make_docs):
    texts = [("word " * (1 + i % 7)) if i % 11 else None for i in range(400)]
    docs = make_docs(texts).withColumnRenamed("lang", "copies")
    rows = mixing.mix(docs, Target(entropy=0.95, repeats=3.0, budget=1.5), block_tokens=100).collect()
    assert len(rows) == 400 and len({r.block for r in rows}) > 3
    total = sum(r.n_tokens for r in rows)
    weights = {r.source: r.weight for r in rows}
    assert sum(weights.values()) == pytest.approx(1, abs=1e-6)
    budgets = {s: int(1.5 * total * w) for s, w in weights.items()}
    assert {r.doc_id: r.copies for r in rows} == brute(rows, budgets)
    for s, b in budgets.items():
        used = sum(r.copies * r.n_tokens for r in rows if r.source == s)
        assert b - 7 <= used <= b


def test_odd_rows(spark, make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    docs = make_docs([None, "", "a b", "a b", "c"], ids=[1, 1, None, 2, 2])
    docs = docs.withColumn("source", docs.lang.substr(9, 1)).withColumn("source", docs.doc_id.cast("string"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 5 and {r.source for r in rows} == {"1", "2", None}
    assert mixing.mix(make_docs([None, ""])).where("copies > 1").count() == 0


def shares_of(tokens, t):
    p = [(x / max(tokens)) ** t for x in tokens]
    return [x / sum(p) for x in p]


def test_sources_more_equal_than_the_target_are_sharpened(spark):
    tokens = [1_000_000 - 20_000 * i for i in range(20)]
    df = spark.createDataFrame([(t,) for t in tokens], "tokens long")
    t = mixing.exponent(df, Target())
    assert t > 1 and entropy(shares_of(tokens, t)) == pytest.approx(0.9 * math.log(20), abs=1e-4)
    with pytest.warns(UserWarning, match="within its repeats"):
        t = mixing.exponent(df, Target(entropy=0.5, repeats=2.0))
    assert t > 1 and shares_of(tokens, t)[0] * sum(tokens) / tokens[0] == pytest.approx(2, abs=1e-4)
    with pytest.warns(UserWarning, match="natural"):
        assert mixing.exponent(spark.createDataFrame([(5,)] * 3, "tokens long"), Target()) == 1


@pytest.mark.parametrize("n", [3, 7, 49])
def test_equal_sources_lose_no_document_by_rounding(spark, n):
    """49 * (1 / 49) is less than one in floats; so are other products of shares and totals."""
    rows = [(i, f"s{i % n}", "word " * (1 + i // n)) for i in range(3 * n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for target in (Target(), Target(entropy=None)):
        assert {r.copies for r in mixing.mix(docs, target).collect()} == {1}


def test_blocks_follow_rows(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "'s' AS source", "'' AS text")
    got = mixing.mix(docs, block_rows=10).collect()
    assert len({r.block for r in got}) > 10 and {r.copies for r in got} == {1}
