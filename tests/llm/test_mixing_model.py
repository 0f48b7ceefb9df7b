import collections
import math
import zlib

import numpy as np
import pytest

from tests.llm.conftest import words
from waymill.llm import mixing_model as lm


def base(rows):
    train = collections.Counter()
    split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(split(t))
    n, v = sum(train.values()), len(train)
    return {i: (len(split(t)), sum(train[w] > 0 for w in split(t)), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in rows}


@pytest.mark.parametrize("frequent", [262_144, 7])
def test_base_score(make_docs, odd_texts, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = np.random.default_rng(1)
    rows = list(enumerate([*odd_texts, *(words(rng, 30, 60) for _ in range(40))]))
    want = base(rows)
    for r in lm.scores(make_docs([t for _, t in rows])).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0


def test_probabilities_of_all_bytes_add_up_to_one(make_docs):
    rng = np.random.default_rng(2)
    docs = make_docs([words(rng, 80, 50) for _ in range(60)]).select("doc_id", "text")
    model = lm.trained(docs, lm.corpus_counts(docs))
    for context in (b"", b"w1", b"the w12x w", "éü".encode(), b"Longword12345"):
        keys, ends = lm.keys_of([context + bytes([b]) for b in range(256)])
        assert (10.0 ** model.log10(keys[ends - 2])).sum() == pytest.approx(1, abs=2e-3)


def test_keys_depend_on_nothing_else():
    """A text's keys are the same whatever stands before it, and tell long words apart."""
    texts = [b"", b"Some longer words andmanyletters x", b"a", "é日".encode()]
    keys, ends = lm.keys_of(texts)
    alone = [lm.keys_of([t])[0] for t in texts]
    assert (keys == np.concatenate(alone)).all() and ends.tolist() == np.cumsum([len(t) + 1 for t in texts]).tolist()
    a, b = lm.keys_of([b"abcdefghi", b"xbcdefghi"])[0].reshape(2, -1)[:, -2]
    assert lm.context_of(np.array([a]), 0) != lm.context_of(np.array([b]), 0)
    assert (keys & np.uint64(255))[ends - 1].tolist() == [lm.END] * 4


def test_code_is_a_prefix_code():
    code = lm.Code.of(np.arange(256) ** 2)
    assert sum(2.0 ** -int(n) for n in code.length) == pytest.approx(1)
    assert len({tuple(code.bit[b, : code.length[b]]) for b in range(256)}) == 256


def test_learns_structure(make_docs):
    """Held-out text costs far less than eight bits a byte, and noise more than text."""
    rng = np.random.default_rng(3)
    texts = [words(rng, 200, 300) for _ in range(200)]
    noise = ["".join(chr(33 + c) for c in rng.integers(0, 90, 800)) for _ in range(30)]
    got = lm.scores(make_docs(texts + noise)).collect()
    clean = [r.bits_per_byte for r in got if r.held_out and r.doc_id < 200]
    assert len(clean) > 10 and np.mean(clean) < 2.2
    assert min(r.bits_per_byte for r in got if r.held_out and r.doc_id >= 200) > 1.5 * np.mean(clean)
    total = sum(r.base_score for r in got if r.held_out and r.doc_id < 200)
    assert sum(r.score for r in got if r.held_out and r.doc_id < 200) > total * 1.1


def test_odd_tables(make_docs):
    assert lm.scores(make_docs([])).count() == 0
    held = next(i for i in range(100) if not lm.train_rule(i))
    rows = lm.scores(make_docs(["a b", "a b", None], ids=[held, held, None])).collect()
    assert len(rows) == 3 and {r.train_tokens for r in rows} == {1}
    rows = lm.scores(make_docs(["a b"], ids=[held])).collect()
    assert rows[0].train_tokens == 0 and rows[0].n_known == 0 and rows[0].base_score == 0


def test_word_context_is_the_whole_word():
    """Words that differ only in a letter far back have contexts of their own; case and what stands before don't matter."""
    def last(text):
        return int(lm.context_of(lm.keys_of([text])[0][-1:], 0)[0])

    ends = [b"a" + b"abcdefghijklmnop"[k:] for k in range(8)] + ["\u3042\u3044\u3046\u3048\u304a".encode(), "\u3043\u3044\u3046\u3048\u304a".encode()]
    words = [c + end for end in ends for c in (b"x", b"y", b"zz", b"xyz", b"zyx")]
    assert len({last(w) for w in words}) == len(words)
    assert last(b"before Xabcdefghijklmnop") == last(b"xabcdefghijklmnop") == last(b"a longer text before xABCDEFGHIJKLMNOP")
    assert last(b"abcde") != last(b"xabcde") and last(b"") == last(b"word ")


def test_orders_are_complete():
    assert lm.ORDERS == (1, 2, 3, 4, 5, 0)


def test_scores_dont_depend_on_the_split(make_docs):
    rng = np.random.default_rng(4)
    docs = make_docs([words(rng, int(rng.integers(1, 400)), 500) for _ in range(150)])
    got = [{r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.scores(d).collect()} for d in (docs.repartition(1), docs.repartition(8), docs.orderBy("text").repartition(3))]
    for other in got[1:]:
        assert other.keys() == got[0].keys()
        for i, row in other.items():
            assert row == pytest.approx(got[0][i], rel=1e-5)


class Plain:
    """The mixer with dictionaries of literal contexts, decision by decision."""

    def __init__(self, code, weights, refine):
        self.code, self.weights, self.refine, self.counts = code, weights, refine, {}

    def contexts(self, text):
        """(byte, contexts by order) of every byte and the end."""
        raw = bytes([lm.END]) * 5 + text + bytes([lm.END])
        begin = 5
        for i in range(5, len(raw)):
            if raw[i - 1] in (9, 10, 11, 12, 13, 32, lm.END):
                begin = i
            word = bytes(b | 32 for b in raw[begin:i])
            yield raw[i], [(o, word if o == 0 else raw[i - o : i]) for o in lm.ORDERS]

    def steps(self, byte):
        return [(int(self.code.node[byte, k]), int(self.code.bit[byte, k])) for k in range(int(self.code.length[byte]))]

    def add(self, text):
        for byte, contexts in self.contexts(text):
            for node, bit in self.steps(byte):
                for c in contexts:
                    self.counts.setdefault((c, node), [0, 0])[bit] += 1

    def inputs(self, contexts, node):
        x, seen = [], []
        for c in contexts:
            n0, n1 = self.counts.get((c, node), (0, 0))
            x.append(round(max(-7.9, min(7.9, math.log((n1 + 0.02) / (n0 + 0.02)))) * 256) / 256)
            seen.append(sum(n0 + n1 > t for t in (0.5, 3.5, 20.5)))
        return [*x, 0.3], seen[-1] * 16 + seen[-2] * 4 + seen[-3]

    def mixed(self, x, gate):
        return max(-7.99, min(7.99, sum(w * v for w, v in zip(self.weights[:, gate].tolist(), x))))

    def score(self, text):
        total = 0.0
        for byte, contexts in self.contexts(text):
            for node, bit in self.steps(byte):
                z = self.mixed(*self.inputs(contexts, node))
                z = (int((z + 8) * lm.FINE / 16) + 0.5) * 16 / lm.FINE - 8
                at = (z + 8) * (lm.BUCKETS - 1) / 16
                low = min(int(at), lm.BUCKETS - 2)
                p = (self.refine[node][low] * (low + 1 - at) + self.refine[node][low + 1] * (at - low) + 1 / (1 + math.exp(-z))) / 2
                p = max(1e-4, min(1 - 1e-4, p))
                total += math.log10(p if bit else 1 - p)
        return total


def test_scores_equal_a_plain_mixer(make_docs):
    """A slow mixer on literal contexts, given the trained weights, scores texts alike; so do its counts."""
    rng = np.random.default_rng(9)
    texts = [words(rng, int(rng.integers(1, 60)), 40) + " Naïve Über日" * (i % 3) for i in range(40)]
    docs = make_docs(texts).select("doc_id", "text")
    model = lm.trained(docs, lm.corpus_counts(docs))
    plain = Plain(model.code, model.weights.astype(float), model.refine)
    for i, t in enumerate(texts):
        if lm.train_rule(i):
            plain.add(t.encode())
    got = {r.doc_id: r.score for r in lm.scores(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain.score(t.encode()), rel=2e-3)


def test_learning_equals_plain_steps(make_docs):
    """The weights after one shard, by loops over decisions in the shard's order."""
    rng = np.random.default_rng(10)
    texts = [words(rng, 12, 20).encode() for _ in range(12)]
    code = lm.Code.of(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    keys, times = lm.counted(lm.keys_of(texts[:6])[0])
    tables = [None] * len(lm.ORDERS)
    for k, counts in lm.table_counts(code, *lm.counted(lm.keys_of(texts[6:])[0])):
        tables[k] = lm.quantised(counts.astype(float))
    model = lm.Model.empty(code, tables)
    plain = Plain(code, model.weights.astype(float), model.refine)
    for t in texts[6:]:
        plain.add(t)
    ones, every = model.learn(keys, times)

    seen = {}
    for t in texts[:6]:
        for key, (byte, contexts) in zip(lm.keys_of([t])[0].tolist(), plain.contexts(t)):
            seen[key] = (byte, contexts)
    order = np.random.default_rng(len(keys)).permutation(len(keys))
    squares = np.full(plain.weights.shape, 1e-3)
    assert len(keys) <= lm.STEP // 2
    n_ones = n_every = 0.0
    for level in range(int(code.length.max())):
        steps = np.zeros(plain.weights.shape)
        for k in order:
            byte, contexts = seen[int(keys[k])]
            if level < code.length[byte]:
                node, bit = plain.steps(byte)[level]
                x, gate = plain.inputs(contexts, node)
                error = (bit - 1 / (1 + math.exp(-plain.mixed(x, gate)))) * times[k]
                steps[:, gate] += error * np.array(x)
                n_every, n_ones = n_every + times[k], n_ones + times[k] * bit
        squares += steps**2
        plain.weights += 0.05 * steps / np.sqrt(squares)
    assert np.abs(plain.weights - model.weights).max() < 2e-3
    assert every.sum() == pytest.approx(n_every) and ones.sum() == pytest.approx(n_ones)


def test_weights_are_learned_on_every_training_document(make_docs):
    """Both halves are learned from, each with the counts of the other alone; the final tables count all."""
    rng = np.random.default_rng(11)
    texts = [words(rng, 20, 30) for _ in range(80)]
    docs = make_docs(texts).select("doc_id", "text")
    train = [i for i in range(80) if lm.train_rule(i)]
    dealt = lm.shards_of(docs, 3 * lm.HALVES * lm.SHARD).collect()
    assert sorted(r.text for r in dealt) == sorted(texts[i] for i in train)
    assert sorted((r.half, r.text) for r in dealt) == sorted((lm.half_of(i), texts[i]) for i in train)
    code = lm.Code.of(np.bincount(np.frombuffer("".join(texts).encode(), np.uint8), minlength=256))
    for tables, mine in zip(lm.bit_tables(docs, code), (train, [i for i in train if lm.half_of(i) == 0], [i for i in train if lm.half_of(i) == 1])):
        for k, counts in lm.table_counts(code, *lm.counted(lm.keys_of([texts[i].encode() for i in mine])[0])):
            assert (tables[k] == lm.quantised(counts.astype(float))).all()
