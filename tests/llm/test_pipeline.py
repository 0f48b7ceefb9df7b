import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import words
from tests.llm.test_suffix_dedup import brute as brute_suffix
from tests.llm.test_winnow import brute as brute_winnow


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    rng = np.random.default_rng(12)
    d = str(tmp_path_factory.mktemp("sf"))
    texts = [words(rng, 120, 5000) + (" badword vileword" if i % 10 == 0 else "") for i in range(200)]
    passage, item = words(rng, 60, 5000), words(rng, 25, 5000)
    for i in (3, 13, 23):
        texts[i] += " " + passage
    texts[41] += " " + item
    texts += [texts[5], texts[7] + " more", None, ""]
    make_docs(texts).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts, item


def test_stages_take_effect(spark, folder):
    d, texts, item = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "source_mixing":
            assert docs.dtypes == before.dtypes
    clean = {i for i in range(200) if i % 10}
    assert set(seen["toxicity"]) & set(range(200)) == clean
    assert set(seen["toxicity"]) - set(seen["simhash_near_dedup"]) >= {200, 203}
    assert set(seen["simhash_near_dedup"]) >= clean
    ids = sorted(seen["simhash_near_dedup"])
    want = brute_suffix([seen["simhash_near_dedup"][i].text for i in ids])
    for k, i in enumerate(ids):
        assert len((seen["suffix_array_dedup"][i].text or "").encode()) == want[k][0] - want[k][1]
    ids = sorted(seen["suffix_array_dedup"])
    dirty = brute_winnow([seen["suffix_array_dedup"][i].text for i in ids], [(1, item)])
    assert {i for k, i in enumerate(ids) if not dirty[k][4]} == set(seen["benchmark_decontamination"])
    assert 41 not in seen["benchmark_decontamination"]
    assert all(r.copies > 0 for r in seen["source_mixing"].values())


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert 100 < len(rows) <= 200 and {"doc_id", "text", "source", "copies"} <= set(rows[0].asDict())


CLASHES = ["_row", "_s", "_h", "_b", "rest", "blocks", "passes", "tokens", "n_tokens", "copies", "n_bytes", "kept_text", "at", "is_toxic", "p_toxic", "p", "bands", "key", "w", "n_hit", "row", "_id", "_order", "count", "root"]


def test_any_column_name_and_empty_tables(spark, folder):
    d, texts, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 60 OR doc_id >= 200")
    wide = docs.select("*", *[F.lit(f"x {c}").alias(c) for c in CLASHES]).unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:], *[F.lit("y").alias(c) for c in CLASHES]).limit(2))
    wide = wide.unionByName(wide.where("doc_id = 1"))
    for name, stage in corpus_pipeline.STAGES:
        plain, got = stage(spark, docs, d), stage(spark, wide, d)
        rows = got.collect()
        if name != "source_mixing":
            assert got.dtypes == wide.dtypes
            assert {r.doc_id for r in rows} - {None} == {r.doc_id for r in plain.collect()}
            assert all(r["is_toxic"] == "x is_toxic" and r["_row"] == "x _row" for r in rows if r.doc_id is not None)
            assert sum(r.doc_id == 1 for r in rows) == (1 if name == "simhash_near_dedup" else 2)
        else:
            assert all(isinstance(r.copies, int) and r["rest"] in ("x rest", "y") for r in rows) and len(rows) > 50
        assert stage(spark, docs.where("false"), d).count() == 0 and set(stage(spark, wide.where("false"), d).columns) >= set(CLASHES)


def test_a_small_table_with_labels_of_no_use_keeps_its_rows(spark):
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, path).count() > docs.count() / 2
