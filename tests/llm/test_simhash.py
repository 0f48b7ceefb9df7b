import numpy as np
import xxhash

from waymill.llm import simhash
from waymill.llm.common import local_labels
from tests.llm.conftest import words


def slow_fingerprint(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    fp = {i: slow_fingerprint(t) for i, t in rows}
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and root[a] > root[b]:
                    root[a], changed = root[b], True
    return {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def test_matches_brute_force(make_docs, odd_texts):
    rng = np.random.default_rng(1)
    texts = list(odd_texts)
    for _ in range(40):
        t = words(rng, 150).split()
        texts.append(" ".join(t))
        for _ in range(int(rng.integers(0, 4))):
            t = t.copy()
            t[rng.integers(len(t))] = "changed"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs(texts)).collect()}
    assert got == brute(rows)


def test_empty_repeated_and_null_ids(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    got = simhash.near_duplicates(make_docs(["a b c d", "a b c d", "a b c d", None], ids=[7, 7, None, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_tree_shares_a_leaf_for_every_close_pair():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = x[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    x = np.unique(np.concatenate([x, near]))
    nodes, leaves = simhash.build_tree(x[::3], 64, 2)
    assert leaves > 8
    true = {(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2) if i < j}
    shared = set()
    for _, at in simhash.route(x, nodes, 2):
        for a, b in simhash.close_pairs(x[at], 2, small=16):
            shared |= {tuple(sorted((at[p], at[q]))) for p, q in zip(a, b)}
    assert shared == true


def test_dense_ball_is_exact():
    rng = np.random.default_rng(4)
    centre = np.uint64(0x123456789ABCDEF0)
    bits = [np.uint64(1) << np.uint64(b) for b in range(20)]
    x = np.unique(np.array([centre ^ bits[rng.integers(20)] ^ bits[rng.integers(20)] ^ bits[rng.integers(20)] for _ in range(4000)], np.uint64))
    true = {(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2) if i < j}
    assert {(int(p), int(q)) for a, b in simhash.close_pairs(x, 2, small=64) for p, q in zip(a, b)} == true


def test_full_leaves_are_split_where_they_are(spark, monkeypatch):
    """A tree of one leaf at the top, refined in rounds, links as all pairs do; a leaf of close points stays whole."""
    monkeypatch.setattr(simhash, "FULL", 60)
    monkeypatch.setattr(simhash, "LEAF_SAMPLE", 40)
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 500)
    flips = lambda x: x ^ (np.int64(1) << rng.integers(0, 63, len(x))) ^ (np.int64(1) << rng.integers(0, 63, len(x)))
    fps = np.unique(np.concatenate([base, flips(base[:200]), flips(np.repeat(base[:1], 300))]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    dealt = simhash.refined(df.selectExpr("0L AS leaf", "fp"), 2)
    assert dealt.select("leaf").distinct().count() > 10
    got = {(r.u, r.v) for r in simhash.links(df, sample=8, leaf=10_000).collect()}
    place = {int(x): i for i, x in enumerate(fps)}
    close = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= 2
    want = local_labels(len(fps), *np.nonzero(close))
    have = local_labels(len(fps), np.array([place[u] for u, _ in got]), np.array([place[v] for _, v in got]))
    assert (want == have).all() and all(close[place[u], place[v]] or want[place[u]] == want[place[v]] for u, v in got)
