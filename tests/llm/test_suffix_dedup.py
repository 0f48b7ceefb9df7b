import hashlib

import numpy as np
import pytest

from tests.llm.conftest import words
from waymill.llm import suffix_dedup


def brute(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(odd_texts):
    rng = np.random.default_rng(6)
    passage, line = words(rng, 60), words(rng, 9)
    texts = [t for t in odd_texts if t is None or len(t) < 50_000]
    for i in range(120):
        t = words(rng, int(rng.integers(1, 150)))
        if i % 4 == 0:
            t += passage + words(rng, 5)
        if i % 3 == 0:
            t = line + "\n" + t
        if i % 10 == 0:
            t += "éü日本" * 60
        texts.append(t)
        if i % 6 == 0:
            w = t.split()
            w[len(w) // 2] = "CHANGED"
            texts += [t, " ".join(w)]
    texts += ["ab" * 400, "x" * 99, "x" * 100, "x" * 101, "x" * 350, passage[:100], passage[1:101], passage[5:104]]
    return texts


@pytest.mark.parametrize("hot", [32, 2, 1])
def test_matches_brute_force(make_docs, odd_texts, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BATCH", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARD", 3 if hot == 2 else 4096)
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    monkeypatch.setattr(suffix_dedup, "BATCH", 9000)
    monkeypatch.setattr(suffix_dedup, "SENT", 5000)
    monkeypatch.setattr(suffix_dedup, "SHARDS", 7)
    texts = corpus(odd_texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(make_docs(texts)).collect()}
    assert got == brute(texts)


def test_odd_rows(make_docs):
    assert suffix_dedup.dedup(make_docs([])).count() == 0
    t = " ".join(f"w{i}" for i in range(80))
    rows = suffix_dedup.dedup(make_docs([t, t, t, None, t], ids=[3, 3, None, None, 9]), keep_text=True).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (-1, 0), (3, 0), (3, 0), (9, len(t))]
    assert {r.kept_text for r in rows if r.doc_id == 9} == {""}


def test_levels_grow_geometrically():
    rng = np.random.default_rng(0)
    family = suffix_dedup.Levels()
    for i in range(40):
        n = 50
        family.add(suffix_dedup.merged([rng.integers(0, 40, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.uint64), np.full(n, i), np.arange(n, dtype=np.int32), np.ones(n, np.uint8), np.zeros(n, np.uint8), np.zeros(n, np.uint8)])[0])
        sizes = [len(x[0]) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    level, spans = family.closed()
    assert len({*zip(level[0], level[1])}) == len(level[0]) <= 120
