import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from waymill.llm import merkle

from .conftest import DOCS


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """(root, proof of each leaf) by plain lists."""
    proofs, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for proof, at in zip(proofs, places):
            run = runs[at // 8]
            proof.append((run[: at % 8], run[at % 8 + 1 :]))
        places = [at // 8 for at in places]
        level = [h(*run) for run in runs]
    return level[0], proofs


def brute(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    fields = lambda r, text: (r[0], r[3], r[2], r[4], text)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups, roots = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(fields(r, r[1]))))
        root, proofs = tree([leaf(fields(r, r[1])) for r in mine])
        groups.append((mine, proofs))
        roots.append(root)
    root, upper = tree(roots)
    out = []
    for (mine, proofs), subroot, more in zip(groups, roots, upper):
        for r, proof in zip(mine, proofs):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(fields(r, text))
            steps = proof + more
            for left, right in steps:
                node = h(*left, node, *right)
            out.append((r[0], leaf(fields(r, r[1])), subroot, root, h(*[d for s in steps for side in s for d in side]), node, node == root))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(5) if rows else spark.createDataFrame([], DOCS)
    got = [tuple(r) for r in merkle.verified(df).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute(rows) if rows else [], key=key)
    return got


def test_all_shapes_of_trees(spark):
    sizes = {"a": 1, "b": 2, "c": 8, "d": 9, "e": 65, None: 17, "": 3, "é": 5, "z": 64, "y": 1, "x": 7}
    rows = [(1000 * k + i, f"Text {i} Of {lang}", lang, "s", i) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    got = check(spark, rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2])
def test_one_language_is_its_own_table(spark, n):
    got = check(spark, [(i, "T", "en", None, None) for i in range(n)])
    assert all(r[2] == r[3] for r in got)


def test_nulls_repeats_long_texts_and_an_empty_table(spark):
    same = (5, "Same", "en", "s", 4)
    check(spark, [same, same, same, (None, "no id", "en", None, None), (None, None, None, None, None), (7, "", None, "", 0), (8, "AÉ日本" * 100_000, "en", "s", 1), (-3, "Minus", "en", "s", 5)])
    check(spark, [])


def test_other_columns_and_clashing_names_make_no_difference(spark):
    df = spark.createDataFrame([(i, f"T{i}", "en", "s", 2) for i in range(20)], DOCS)
    plain = sorted(merkle.verified(df).collect())
    more = df
    for name in ("g", "pos", "n", "digest", "proof", "kids", "root", "_tie", "_at", "lowered"):
        more = more.withColumn(name, F.lit(1))
    assert sorted(merkle.verified(more).collect()) == plain


def test_a_manifest_is_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([(i, f"T{i}", f"l{i % 4}", "s", 2) for i in range(300)], DOCS)
    roots = {merkle.verified(df.repartition(n)).select("root").first()[0] for n in (1, 7)}
    assert len(roots) == 1


def test_any_change_is_seen_and_steps_are_bounded(spark):
    df = spark.createDataFrame([(i, f"T{i}", "en", "s", 2) for i in range(100)], DOCS)
    leaves = df.select(merkle.group_key(df["lang"]).alias("g"), "doc_id", merkle.leaf(df).alias("digest"), merkle.leaf(df, source=F.lit("other")).alias("changed"))
    proven = merkle.manifest(leaves, ["doc_id"]).proofs()
    row = proven.agg(
        F.count_if(merkle.folded(F.col("digest"), F.col("proof")) == F.col("root")),
        F.count_if(merkle.folded(F.col("changed"), F.col("proof")) == F.col("root")),
        F.max(F.size("proof")),
    ).first()
    assert tuple(row) == (100, 0, 3)
