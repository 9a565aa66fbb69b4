import random
import zlib

import numpy as np

from lectern.llm import language as G

from .helpers import docs

WORDS = {
    "en": "the and with that this from have water house night which where think through weather".split(),
    "de": "der und mit dass diese aus haben wasser haus nacht welche wo denken durch wetter über".split(),
    "fr": "le et avec que cette de avoir eau maison nuit laquelle où penser à travers météo été".split(),
}


def table(spark, n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(4, 60))), lang))
    rows += [(n, None, "en"), (n + 1, "", "de"), (n + 2, "123 ... !", "fr"), (n + 3, "the water", None), (None, "das haus und die nacht", "de"), (n + 4, "le eau " * 40_000, "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    t = table(spark)
    rows = {r.doc_id: r for r in G.learn_and_identify(t).collect()}
    truth = {r.doc_id: r for r in t.collect()}
    assert len(rows) == len(truth)
    held = [i for i in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i].held_out == (i is None or i in held) for i in rows)
    good = [rows[i].lang_pred == truth[i].lang for i in held if truth[i].text and any(c.isalpha() for c in truth[i].text) and truth[i].lang]
    assert sum(good) / len(good) >= 0.97
    for i, r in rows.items():
        letters = bool(truth[i].text) and any(c.isalpha() for c in truth[i].text)
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1 and (letters or r.score == 0)


def test_prediction_looks_at_the_text_only(spark):
    t = table(spark, 90)
    model = G.learn(t)
    other = t.selectExpr("doc_id + 999 as doc_id", "text", "'xx' as lang")
    a, b = (dict(d.where("text is not null").select("text", G.told(d, model, d["text"])["lang"]).collect()) for d in (t, other))
    assert a == b


def test_presence_is_by_text_and_whole():
    p, own, lengths = G.presence(["abc", "abc" * 2000, "é"])
    assert own.tolist() == [0, 1, 1, 1, 2] and lengths.tolist() == [3, 2048, 2048, 1904, 1]
    assert p[0].sum() == 6 and p[4].sum() == 1  # a, b, c, ab, bc, abc
    assert (p[0] <= p[1]).all()


def kernel(a, b):
    """Shared n-grams of one to four characters, by presence, in parts of each text's own."""
    grams = lambda t: {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}
    x, y = grams(a), grams(b)
    return len(x & y) / (len(x) * len(y)) ** 0.5


def test_matches_kernel_ridge_regression_written_out():
    """With every text a landmark, the margins are those of the dual solution over the kernel of n-grams that aren't hashed."""
    rng = random.Random(3)
    texts = [(" ".join(rng.choice(WORDS[lang]) for _ in range(6)), lang) for lang in sorted(WORDS) for _ in range(8)]
    asked = [" ".join(rng.choice(WORDS[lang]) for _ in range(5)) for lang in sorted(WORDS) for _ in range(4)]
    rows = np.packbits(G.presence([t for t, _ in texts])[0], axis=1)
    ridge = 1.0
    model = G.fit(rows, [v for _, v in texts], landmarks=len(texts), ridge=ridge)
    k = np.array([[kernel(a, b) for b, _ in texts] for a, _ in texts])
    y = np.where(np.array([[v == w for w in sorted(WORDS)] for _, v in texts]), 1.0, -1.0)
    alpha = np.linalg.solve(k + ridge * len(texts) / 100 * np.eye(len(texts)), y)
    want = np.array([[kernel(a, b) for b, _ in texts] for a in asked]) @ alpha
    got = model.scores(asked)
    assert np.abs(got - want).max() < 0.05 and (got.argmax(axis=1) == want.argmax(axis=1)).all()


def test_stretches_lie_all_over_the_text():
    for n in range(1, 40):
        at = G.spread(n, 4)
        assert at[0] == 0 and at[-1] == n - 1 and len(at) == min(n, 4) and max(np.diff(at), default=1) <= n // 3 + 1


def test_the_stage_gives_the_language_that_was_told(spark):
    d = table(spark, 120).selectExpr("doc_id", "text", "if(doc_id % 3 = 0, null, lang) as lang")
    kept = {r.doc_id: r.lang for r in G.known_language(d).collect()}
    truth = {r.doc_id: r.lang for r in table(spark, 120).collect()}
    assert set(range(120)) <= set(kept) and sum(kept[i] == truth[i] for i in range(120)) >= 117


def test_edges(spark):
    empty = table(spark, 0).limit(0)
    assert G.learn_and_identify(empty).count() == 0
    unlabelled = docs(spark, ["the water", None]).selectExpr("doc_id", "text", "cast(null as string) as lang", "1 as score", "2 as __letters")
    assert {r.lang_pred for r in G.learn_and_identify(unlabelled).collect()} == {"und"}
    kept = G.known_language(table(spark, 60).selectExpr("*", "1 as score", "'x' as lang_pred"))
    assert kept.columns == ["doc_id", "text", "lang", "score", "lang_pred"] and kept.where("text is null or text = '' or text like '123%'").count() == 0
    assert kept.count() == 63 and {r.lang_pred for r in kept.collect()} == {"x"}
