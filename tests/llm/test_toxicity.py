import random

import numpy as np

from lectern.llm import toxicity as X

from .helpers import docs, sentence


def tables(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    # Two kinds of words that no module knows, in several forms.
    listed = [[stem + end for stem in stems for end in ("", "e", "en", "s")] for stems in (("grobian", "schuft", "lump"), ("pestilent", "vilain", "sordid"))]
    for i in range(n):
        words = sentence(rng, rng.randrange(20, 200)).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(listed[i // 2 % 2]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1 if toxic or rng.random() < 0.03 else 0, toxic))
    rows += [(n, None), (n + 1, ""), (n + 2, "you GROBIAN, you lump of a schuft")]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, truly boolean")


def test_held_out_accuracy(spark):
    d, labels = tables(spark)
    learned = labels.where("doc_id % 2 = 0")
    found = {r.doc_id: r for r in X.score(d, X.learn(d, learned)).collect()}
    truth = {r.doc_id: r.truly for r in labels.collect()}
    held = [i for i in truth if i % 2]
    assert sum(found[i].toxic == truth[i] for i in held) / len(held) >= 0.97
    assert not any(found[i].toxic for i in held if not truth[i])
    assert not found[600].toxic and not found[601].toxic and found[602].toxic
    assert all(0 <= p <= 1 for r in found.values() for p in (r.p_kind1, r.p_kind2, r.p_toxic))


def test_later_models_are_fed_out_of_fold_probabilities(monkeypatch):
    seen = []
    real = X.fit

    def spy(docs_, earlier, y, **kw):
        seen.append((len(docs_), earlier.shape[1]))
        return real(docs_, earlier, y, **kw)

    monkeypatch.setattr(X, "fit", spy)
    rng = np.random.default_rng(1)
    docs_ = [np.unique(rng.integers(0, 50, 20)) for _ in range(100)]
    y = np.column_stack([[3 in d for d in docs_], [7 in d for d in docs_], [3 in d or 7 in d for d in docs_]])
    chain = X.fit_chain(docs_, y, np.arange(100) % X.FOLDS)
    assert [s for s in seen if s[0] == 100] == [(100, 0), (100, 1), (100, 2)]
    assert [s[1] for s in seen if s[0] == 80] == [0] * 5 + [1] * 5 + [2] * 5
    p = chain.probabilities(docs_)
    assert p.shape == (100, 3) and ((p[:, 2] >= chain.threshold) == y[:, 2]).mean() > 0.95
    # The scorer over words says what the chain over buckets says.
    texts = ["alpha beta clown", "", None, "beta"]
    s = X.Scorer(chain)
    assert np.allclose(s.probabilities(texts), chain.probabilities([X.buckets_of(t) for t in texts]))


def test_edges(spark):
    d, labels = tables(spark, 30)
    assert X.learn_and_score(d.limit(0), labels).count() == 0
    assert not X.learn_and_score(d, labels.limit(0)).where("toxic").count()
    assert not X.learn_and_score(d, labels.selectExpr("doc_id", "0 as toxic")).where("toxic").count()
    odd = labels.selectExpr("cast(null as long) as doc_id", "toxic").unionByName(labels.selectExpr("doc_id", "cast(null as int) as toxic")).unionByName(labels.select("doc_id", "toxic")).unionByName(labels.select("doc_id", "toxic"))
    assert X.learn_and_score(d.selectExpr("*", "1 as toxic", "2 as words"), odd).count() == 33


def plain_fit(x, y, l2=1.0):
    """Logistic regression by Newton's steps, with an intercept that isn't shrunk."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    shrink = l2 * np.r_[np.ones(x.shape[1]), 0]
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(shrink + 1e-9), a.T @ (p - y) + shrink * w)
    return w


def test_the_chain_is_that_of_models_written_out():
    rng = np.random.default_rng(3)
    docs_ = [np.unique(np.r_[rng.integers(0, 400, 12), rng.choice([3, 7, 500, 501, 502], 2)]) for _ in range(400)]
    y = np.column_stack([[3 in d for d in docs_], [7 in d for d in docs_], [3 in d or 500 in d for d in docs_]])
    y[rng.integers(0, 400, 12)] ^= True
    fold = rng.integers(0, X.FOLDS, 400)
    logit = lambda m: np.log(np.clip(1 / (1 + np.exp(-m)), 1e-4, 1 - 1e-4) / (1 - np.clip(1 / (1 + np.exp(-m)), 1e-4, 1 - 1e-4)))
    earlier, in_use = np.zeros((400, 0)), np.zeros((400, 0))

    def features(rows, label):
        flat = np.concatenate([docs_[i] for i in rows])
        return X.telling(flat, label[rows].astype(float), np.repeat(np.arange(len(rows)), [len(docs_[i]) for i in rows]))

    for k in range(3):
        every = np.arange(400)
        unseen = np.zeros(400)
        for f in range(X.FOLDS):
            own, rest = every[fold != f], every[fold == f]
            words = features(own, y[:, k])
            x = np.column_stack([np.array([np.isin(words, d) for d in docs_], float), earlier])
            w = plain_fit(x[own], y[own, k])
            unseen[rest] = np.column_stack([x, np.ones(400)])[rest] @ w
        words = features(every, y[:, k])
        own_x = np.array([np.isin(words, d) for d in docs_], float)
        w = plain_fit(np.column_stack([own_x, earlier]), y[:, k])
        margin = np.column_stack([own_x, in_use, np.ones(400)]) @ w
        earlier, in_use = np.column_stack([earlier, logit(unseen)]), np.column_stack([in_use, logit(margin)])
    got = X.fit_chain(docs_, y, fold).probabilities(docs_)
    assert np.abs(got - 1 / (1 + np.exp(-in_use))).max() < 0.02


def test_kinds_are_found_and_forms_of_a_stem_are_learned_together(spark):
    d, labels = tables(spark, 800, seed=5)
    rows = {r.doc_id: r for r in d.collect()}
    chain = X.learn(d, labels.where("doc_id % 2 = 0"))
    s = X.Scorer(chain)
    first, second, clean, unseen = s.probabilities(["a schuften here", "some pestilente talk", "the river and the stone", "grobianisch"])
    assert (first[0] > first[1]) != (second[0] > second[1]) and min(first[2], second[2]) > 0.5 > clean[2] and unseen[2] > 0.5
    texts = [X.buckets_of(r.text) for r in rows.values() if r.text]
    toxic = np.array([any(stem in r.text for stem in ("grobian", "schuft", "lump", "pestilent", "vilain", "sordid")) for r in rows.values() if r.text])
    one = X.kinds(texts, toxic)
    assert (one.sum(axis=1) == toxic).all() and 0.3 < one[:, 0].sum() / toxic.sum() < 0.7
    assert not X.kinds(texts, np.zeros(len(texts), bool)).any() and not X.kinds([], np.zeros(0, bool)).any()


def rare_words(n=3000, seed=2, telling=True):
    """Texts of which one in fifty is toxic, by words that are each in far less than a hundredth of the texts."""
    rng = random.Random(seed)
    common = [f"w{k}" for k in range(400)]
    texts, toxic = [], []
    for _ in range(n):
        words = sentence(rng, 60, common).split()
        bad = rng.random() < 0.02
        if bad and telling:
            words += rng.sample([f"bad{k}" for k in range(12)], 4)
        texts.append(" ".join(words))
        toxic.append(bad)
    return texts, np.array(toxic)


def test_rare_toxic_words_are_learned():
    texts, toxic = rare_words()
    docs_ = [X.buckets_of(t) for t in texts]
    own = np.arange(len(texts)) % 2 == 0
    assert all(sum(X.bucket(f"bad{k}") in d for d in docs_) < 0.01 * len(texts) for k in range(12))
    none = np.zeros(len(texts), bool)
    labels = np.column_stack([none, none, toxic])
    chain = X.fit_chain([d for d, o in zip(docs_, own, strict=True) if o], labels[own], np.arange(own.sum()) % X.FOLDS)
    flagged = X.Scorer(chain).probabilities(texts)[:, -1] >= chain.threshold
    assert (flagged == toxic)[~own].mean() > 0.99 and flagged[~own & toxic].mean() > 0.9


def test_nothing_is_flagged_where_no_word_tells():
    texts, toxic = rare_words(1000, telling=False)
    none = np.zeros(len(texts), bool)
    chain = X.fit_chain([X.buckets_of(t) for t in texts], np.column_stack([none, none, toxic]), np.arange(len(texts)) % X.FOLDS)
    assert toxic.any() and not len(chain.models[-1].words)
    assert not (X.Scorer(chain).probabilities(texts)[:, -1] >= chain.threshold).any()
