import numpy as np

import corpus_pipeline
from tests.llm.conftest import words
from waymill.llm import shingles, simhash


def slow_set(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    """The smallest doc_id of each component under all pairs of similarity 0.8."""
    sets = {i: slow_set(t) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return {i for i in root if root[i] == i}


def near(rng, text, changes):
    w = text.split()
    for i in rng.choice(len(w), changes, replace=False):
        w[i] = f"changed{rng.integers(10**6)}"
    return " ".join(w)


def test_stage_keeps_what_brute_force_keeps(spark, make_docs, odd_texts):
    rng = np.random.default_rng(2)
    texts = list(odd_texts)
    for changes in (1, 2, 3, 4, 5, 6, 8):
        for _ in range(12):
            t = words(rng, 200, 5000)
            texts += [t, near(rng, t, changes)]
    hub = words(rng, 300, 5000)
    texts += [near(rng, hub, int(rng.integers(1, 5))) for _ in range(60)]
    loose = words(rng, 300, 5000)
    texts += [near(rng, loose, int(rng.integers(3, 12))) for _ in range(40)]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[i]) for i in order]
    docs = make_docs([t for _, t in rows], ids=[i for i, _ in rows])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.dtypes == docs.dtypes
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_chains_and_odd_ids(make_docs):
    rng = np.random.default_rng(3)
    first = words(rng, 200, 5000)
    chain = [first]
    for _ in range(4):
        chain.append(near(rng, chain[-1], 3))
    got = shingles.one_of_each(make_docs(chain, ids=[5, 4, 3, 2, 1])).collect()
    assert [r.doc_id for r in got] == [1]
    got = shingles.one_of_each(make_docs([first, first, chain[1], first], ids=[7, 7, None, None])).collect()
    assert sorted(r.doc_id or -1 for r in got) == [-1, -1, 7]
    assert shingles.one_of_each(make_docs([])).count() == 0


def test_bands_meet_at_the_limit():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        x = rng.integers(0, 2**63, 100, dtype=np.uint64)
        y = np.concatenate([x[:90], rng.integers(0, 2**63, 12, dtype=np.uint64)])
        assert (shingles.bands(x) == shingles.bands(y)).any()


def test_a_large_loose_group_lists_no_pairs(spark, make_docs, monkeypatch):
    """Texts that share buckets and are linked with few of each other: exact links, and no table with the square of the group."""
    rng = np.random.default_rng(7)
    base = words(rng, 300, 5000)
    texts = [near(rng, base, int(rng.integers(7, 13))) for _ in range(260)]
    rows = []
    keep = shingles.written

    def watched(df, name):
        out = keep(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(shingles, "written", watched)
    for most in (4096, 40):  # in one task, and by pairs of blocks
        monkeypatch.setattr(shingles, "MEET", most)
        rows.clear()
        kept = {r.doc_id for r in shingles.one_of_each(make_docs(texts)).collect()}
        assert kept == brute(list(enumerate(texts))) and len(kept) > 20
        assert max(rows) <= len(texts) * shingles.BANDS


def test_matrices_count_what_sets_share(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(shingles, "SIDE", 7)
    monkeypatch.setattr(shingles, "WIDE", 11)
    sets = [np.unique(rng.choice(60, 30)) for _ in range(40)] + [np.arange(60)] * 3
    c = np.array([*range(100, 140), 7, 7, 7])
    u, v = shingles.linked(c, np.cumsum([0, *map(len, sets)]), np.concatenate(sets), 0.5)
    edges = [(int(a), int(b)) for a, x in zip(c, sets) for b, y in zip(c, sets) if a != b and similarity(set(x.tolist()), set(y.tolist())) >= 0.5]
    root = {int(x): int(x) for x in c}
    for _ in range(50):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {int(x): int(x) for x in c} | dict(zip(u.tolist(), v.tolist()))
    assert got == root


def test_simhash_classes_are_linked(make_docs):
    """A line that makes up nearly all of two texts gives them fingerprints within two bits, however little of their sets they share."""
    rng = np.random.default_rng(9)
    line = words(rng, 9, 5000)
    texts = [" ".join([line] * 400 + [words(rng, 40, 5000)]) for _ in range(2)]
    a, b = map(slow_set, texts)
    assert similarity(a, b) < 0.8 and bin(simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).count("1") <= 2
    assert [r.doc_id for r in shingles.one_of_each(make_docs([*texts, words(rng, 50, 5000)])).collect() if r.doc_id < 2] == [0]
