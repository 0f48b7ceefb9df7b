import numpy as np

from tests.llm.conftest import words
from waymill.llm import toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def make(n=600, seed=3):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        t = words(rng, int(rng.integers(5, 200)), 3000)
        junk, bad = rng.random() < 0.2, rng.random() < 0.15
        if junk:
            t = t.replace(" ", " $$$ spam ", 3)
        if bad:
            w = t.split()
            for _ in range(int(rng.integers(1, 4))):
                w.insert(int(rng.integers(len(w))), ["badword", "Wors" + "eword", f"vilepre{rng.integers(900)}"][rng.integers(3)])
            t = " ".join(w)
        texts.append(t)
        labels.append((i, int(not junk), int(bad), "clash"))
    return texts, labels


def test_held_out_accuracy(spark, make_docs):
    texts, labels = make()
    scored = toxicity.toxicity(make_docs(texts), spark.createDataFrame(labels[:400], LABELS)).collect()
    got = {r.doc_id: r.is_toxic for r in scored}
    wrong = sum(got[i] != bool(t) for i, _, t, _ in labels[400:])
    assert len(got) == 600 and wrong <= 4


def test_chain_feeds_earlier_probabilities(spark, make_docs):
    texts, labels = make(200)
    chain = toxicity.train(make_docs(texts), spark.createDataFrame(labels, LABELS), toxicity.CATEGORIES)
    assert [c.category for c in chain.links] == ["junk", "toxic"]
    assert [len(c.weights) - len(chain.index) for c in chain.links] == [1, 2]
    again = toxicity.train(make_docs(texts), spark.createDataFrame(labels, LABELS), toxicity.CATEGORIES)
    assert all((a.weights == b.weights).all() for a, b in zip(chain.links, again.links))


def test_odd_tables(spark, make_docs, odd_texts):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.toxicity(make_docs([]), none).count() == 0
    rows = toxicity.toxicity(make_docs(odd_texts, ids=[None, *range(len(odd_texts) - 1)]).withColumnRenamed("lang", "p_toxic"), none).collect()
    assert len(rows) == len(odd_texts) and not any(r.is_toxic for r in rows)
    one = spark.createDataFrame([(0, 1, 0, ""), (0, 1, 0, ""), (None, 1, 1, ""), (1, None, 1, "")], LABELS)
    assert not any(r.is_toxic for r in toxicity.toxicity(make_docs(odd_texts), one).collect())


def test_labels_that_no_word_predicts_reject_nothing(spark, make_docs):
    rng = np.random.default_rng(1)
    texts = [words(rng, 50, 300) for _ in range(200)]
    labels = [(i, 1, int(rng.random() < 0.13), "") for i in range(200)]
    rows = toxicity.toxicity(make_docs(texts), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == 200 and not any(r.is_toxic for r in rows)


def test_best_threshold():
    y = np.array([1, 0, 0, 1, 0.0])
    assert toxicity.best_threshold(np.full(5, 0.4), y) == toxicity.NEVER
    assert toxicity.best_threshold(np.array([0.9, 0.2, 0.1, 0.8, 0.3]), y) == 0.55
    assert toxicity.best_threshold(np.array([0.1, 0.9, 0.9, 0.05, 0.9]), y) == toxicity.NEVER


def plain_fit(x, y, penalty=0.02):
    """Penalised logistic regression by Newton steps; the constant isn't penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, penalty), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= np.linalg.lstsq((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge * w, rcond=None)[0]
    return w


def test_chain_equals_a_plain_one(spark, make_docs):
    """Dense matrices, Newton's method and explicit folds give the chain's probabilities and decisions."""
    texts, labels = make(300, 8)
    chain = toxicity.train(make_docs(texts), spark.createDataFrame(labels, LABELS), toxicity.CATEGORIES)
    got = {r.doc_id: r for r in toxicity.score(make_docs(texts), chain).collect()}
    m = len(chain.index)
    present = [sorted(chain.index[f] for f in toxicity.features(t) if f in chain.index) for t in texts]
    order = sorted(range(300), key=lambda i: (present[i], 1 - labels[i][1], labels[i][2]))
    x = np.zeros((300, m))
    for k, i in enumerate(order):
        x[k, present[i]] = 1
    fold = np.random.default_rng(300).permutation(300) % toxicity.FOLDS
    earlier, now = np.empty((300, 0)), np.empty((300, 0))
    for k, link in enumerate(chain.links):
        y = np.array([(1 - labels[i][1], labels[i][2])[k] for i in order], float)
        out = np.empty(300)
        for f in range(toxicity.FOLDS):
            w = plain_fit(np.column_stack([x, earlier])[fold != f], y[fold != f])
            out[fold == f] = 1 / (1 + np.exp(-(np.column_stack([x, earlier, np.ones(300)])[fold == f] @ w)))
        w = plain_fit(np.column_stack([x, earlier]), y)
        p = 1 / (1 + np.exp(-(np.column_stack([x, now, np.ones(300)]) @ w)))
        have = np.array([getattr(got[i], f"p_{link.category}") for i in order])
        assert np.abs(p - have).mean() < 0.02 and ((p >= link.threshold) != np.array([getattr(got[i], f"is_{link.category}") for i in order])).sum() <= 2
        earlier, now = np.column_stack([earlier, out]), np.column_stack([now, have])
