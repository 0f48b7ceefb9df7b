import hashlib
import re

import numpy as np

from tests.llm.conftest import words
from waymill.llm import winnow

ITEM = "item_id long, text string"


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(texts, items):
    out = {}
    for i, t in enumerate(texts):
        w, hit, ids = split(t), set(), set()
        for item, it in items:
            b = split(it)
            n = min(10, len(b))
            wins = {tuple(b[s : s + n]) for s in range(len(b) - n + 1)} if n else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    ids.add(str(item))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def test_matches_brute_force(spark, make_docs, odd_texts):
    rng = np.random.default_rng(2)
    items = [(i, words(rng, int(rng.integers(1, 40)), 30)) for i in range(25)] + [(100, None), (101, ""), (102, "la la la la la la la la la la la"), (103, "Zwölf"), (104, "one two three"), (3, "w1x")]
    texts = list(odd_texts)
    for i in range(60):
        t = words(rng, int(rng.integers(5, 80)), 30)
        if i % 3 == 0:
            t += "; " + (items[i % 25][1] or "").upper() + " !" + words(rng, 10, 30)
        if i % 5 == 0:
            b = split(items[(i + 3) % 25][1])
            t += " " + " ".join(b[2:13]) + ". zwölf"
        texts.append(t)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in winnow.contamination(make_docs(texts), spark.createDataFrame(items, ITEM)).collect()}
    assert got == brute(texts, items)
    assert sum(g[4] for g in got.values()) > 20


def test_without_broadcast(spark, make_docs, monkeypatch):
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)
    texts = ["a b c d e f g h i j k l", "b c d e f g h i j x", "z"]
    got = {r.doc_id: r.n_hit for r in winnow.contamination(make_docs(texts), spark.createDataFrame([(1, "b c d e f g h i j k"), (2, "z")], ITEM)).collect()}
    assert got == {0: 10, 1: 0, 2: 1}


def test_empty_tables_and_repeated_rows(spark, make_docs):
    none = spark.createDataFrame([], ITEM)
    some = spark.createDataFrame([(None, "x y")], ITEM)
    assert winnow.contamination(make_docs([]), some).count() == 0
    assert [r.n_hit for r in winnow.contamination(make_docs(["x y", None]), none).collect()] == [0, 0]
    rows = winnow.contamination(make_docs(["x y", "x y", "q", "x y"], ids=[1, 1, 1, None]), some).collect()
    assert sorted(r.n_hit for r in rows) == [0, 2, 2, 2] and {r.n_items for r in rows} == {0, 1}
