"""Small tables for the operators of this subpackage."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema=SCHEMA):
    """A table of documents; texts: of strings, or of (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], schema)


def sentence(rng, n, words="the of and in to is river stone light winter garden music paper window silver mountain".split()):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, empties and odd characters."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(20, 200)) for _ in range(n)]
    passage = "a passage of more than fifty bytes that several of the documents hold, word for word, é and all"
    out = list(base)
    out += [base[0]] * 20 + [base[1].upper(), base[2] + " ", " " + base[2]]
    out += [b + " " + passage + " " + sentence(rng, 9) for b in base[3:9]]
    for b in base[10:20]:
        w = b.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [None, "", " \n\t ", "…", "日本語のテキスト", "x", "x y", "1234", "a" * 3000, passage, passage * 3]
    rng.shuffle(out)
    return out
