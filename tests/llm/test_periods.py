import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymill.llm import periods


def brute(words, least=6, times=4):
    """Runs by every period and every stretch."""
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            part = words[start : start + length]
            if i > start and length >= max(least, times * p) and not any(all(x == y for x, y in zip(part, part[q:])) for q in range(1, p)):
                out.append((start, length, p))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_a_search_over_all_periods(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 5, 6, 7, 40, 160])
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 4])) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                words = words[:a] + [words[a + i % p] for i in range(n - a)]
            texts.append(words)
        assert [[tuple(r) for r in found.tolist()] for found in periods.searched(texts)] == [brute(t) for t in texts]


def test_other_limits_than_the_defaults():
    words = b"a b a b a b c c c d d".split()
    assert [tuple(r) for r in periods.searched([words], 3, 3)[0].tolist()] == [(0, 6, 2), (6, 3, 1)] == brute(words, 3, 3)


def test_next_smaller_suffix_order_and_prefixes():
    rng = np.random.default_rng(1)
    values = rng.permutation(777)
    assert periods.next_smaller(values).tolist() == [next((j for j in range(i + 1, 777) if values[j] < values[i]), 777) for i in range(777)]
    letters = np.append(rng.integers(1, 3, 400), 0)
    order, rank = periods.ranks(letters)
    text = letters.tolist()
    assert order.tolist() == sorted(range(401), key=lambda i: text[i:])
    assert (rank[order] == np.arange(401)).all()
    shared = periods.common_prefixes(letters, order, rank)
    for r in range(1, 401):
        a, b = text[order[r - 1] :], text[order[r] :]
        assert shared[r] == next(k for k, (x, y) in enumerate(zip(a + [None], b + [None])) if x != y)


def expected(doc_id, text):
    words = periods.planted(doc_id, (text or "").encode().split())
    found = brute(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_digests_of_odd_documents(make_docs, odd_texts):
    texts = [t for t in odd_texts if len(t or "") < 10_000] + ["x " * 50 + f"tail {k} of the text and more" for k in range(40)]
    got = {r.doc_id: tuple(r) for r in periods.run_digests(make_docs(texts)).collect()}
    assert got == {i: expected(i, t) for i, t in enumerate(texts)}


def test_a_very_long_text_and_words_apart_only_by_other_spaces(make_docs):
    whole = " ".join(f"w{i % 9973}" for i in range(300_000))
    narrow = "a b a b a b a b a b a b"
    got = periods.periodic_runs(make_docs([whole, narrow, "a\x1cb"])).orderBy("doc_id").collect()
    assert [[tuple(r) for r in row.runs] for row in got] == [[(0, 300_000, 9973)], [(0, 6, 1)], []]
    assert got[0].collapsed.split() == whole.split()[:9973] and got[1].collapsed == "a b" and got[2].n_words == 1


def test_null_and_repeated_ids_clashing_names_and_an_empty_table(make_docs):
    docs = make_docs(["z " * 9, "z " * 9, None], ids=[None, None, 4])
    for name in ("runs", "l", "collapsed", "start"):
        docs = docs.withColumn(name, F.lit(1))
    got = sorted((tuple(r) for r in periods.run_digests(docs).collect()), key=str)
    none, some = expected(4, None), expected(-1, "z " * 9)[1:]
    assert got == sorted([none, (None, *some), (None, *some)], key=str)
    assert periods.run_digests(make_docs([])).count() == 0
