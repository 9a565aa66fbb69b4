import math
import random
import re
from collections import Counter

from lectern.llm import licenses as L

from .helpers import corpus, docs, sentence

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = []
    for phrase, label in L.BASE:
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))


TEXTS = [
    "Released under the MIT License.", "mit license mit license", "MIT-License; Apache license", "the GENERAL public license, version 3", "mitlicense mit licenses", "general public mit license", "xmit license",
    "licence MIT\nLICENSE", "émit license", "mit license", MIT, GPL, "foo " * 500 + MIT + " bar" * 10, "license " * 3000, "mit " * 2000 + "license",
]


def test_base_phrases_match_brute_force(spark):
    texts = list(enumerate([*TEXTS, *corpus()]))
    rows = {r.doc_id: r for r in L.scan(docs(spark, texts)).collect()}
    for i, t in texts:
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t and t[:60]
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.labels == "") == (r.score == 0)


def test_templates_are_found_without_their_names(spark):
    texts = ["word " * 40 + MIT, GPL.replace("General Public", "general  public"), "x y z", "Redistribution and use in source and binary forms, with or without modification, are permitted", MIT.replace("hereby granted", "hereby refused")]
    rows = [r.labels for r in L.scan(docs(spark, texts)).orderBy("doc_id").collect()]
    assert rows == ["mit", "gpl", "", "bsd", ""]


def test_every_template_finds_itself(spark):
    rows = L.scan(docs(spark, [text for _, text, _ in L.TEMPLATES])).orderBy("doc_id").collect()
    assert all(label in r.labels.split(",") for (label, _, _), r in zip(L.TEMPLATES, rows, strict=True))


def test_no_python_in_the_plan(spark):
    plan = L.scan(docs(spark, TEXTS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(spark):
    assert L.scan(docs(spark, [])).count() == 0
    rows = L.scan(docs(spark, [(None, None), (1, "mit license"), (1, "mit license")]).selectExpr("doc_id", "text", "1 as words", "2 as padded", "3 as labels")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.labels) for r in rows) == [(0, 0, ""), (1, 2, "mit"), (1, 2, "mit")]


def test_a_file_of_many_licenses_keeps_every_label(spark):
    everything = " ".join(text for _, text, _ in L.TEMPLATES)
    for label in ("cc", "isc", "bsd", "mpl", "lgpl", "unlicense"):
        # This licence's words are the commonest of all.
        own = [" ".join(sorted(text.split())) for name, text, _ in L.TEMPLATES if name == label]
        found = L.scan(docs(spark, [everything] + own * 20)).where("doc_id = 0").first()
        assert found.labels.split(",") == sorted({name for name, _, _ in L.TEMPLATES}), label


def plain(texts, templates=L.TEMPLATES):
    """labels and score by trying every alignment of every template in every text."""
    rows = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    held = Counter(w for r in rows for w in set(r))
    idf = lambda w: math.log((len(rows) + 1) / (held[w] + 1))
    holds = lambda words, phrase: any(words[i : i + len(phrase)] == phrase for i in range(len(words)))
    out = []
    for words in rows:
        found, fit = {label for phrase, label in L.BASE if holds(words, phrase.split())}, 0.0
        base = bool(found)
        for label, text, keys in templates:
            own = text.split()
            rare = sorted(set(own), key=lambda w: (-idf(w), w))
            rare = set(rare[: min(L.MOST, math.ceil(L.PART * len(rare)))])
            places = [(p, w) for p, w in enumerate(own) if w in rare]
            votes = max((sum(0 <= off + p < len(words) and words[off + p] == w for p, w in places) for off in range(-len(own), len(words))), default=0)
            if votes >= max(2, math.ceil(len(places) * L.VOTES)) and all(holds(words, k.split()) for k in keys):
                found.add(label)
                fit = max(fit, votes / len(places))
        out.append((",".join(sorted(found)), min(1.0, 0.5 * base + fit / 2)))
    return out


def test_labels_and_scores_match_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", "MIT licence", "the mit License and the apache-license"]
    for _ in range(150):
        label, text, keys = rng.choice(L.TEMPLATES)
        words = text.split()
        kind = rng.randrange(5)
        if kind == 0:  # some words changed
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(len(words))] = rng.choice(["xyz", "software", "the"])
        elif kind == 1:  # a piece
            at = rng.randrange(len(words))
            words = words[at : at + rng.randrange(1, len(words))]
        elif kind == 2:  # two templates
            words += rng.choice(L.TEMPLATES)[1].split()
        elif kind == 3:  # a word slipped in
            words.insert(rng.randrange(len(words)), "really")
        texts.append(sentence(rng, rng.randrange(0, 30)) + " " + " ".join(words).upper() + rng.choice([".", " -- ", "\n"]) + sentence(rng, rng.randrange(0, 30)))
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(docs(spark, texts)).collect()}
    want = plain(texts)
    assert len({x for x, _ in want}) > 8
    for i, (labels, score) in enumerate(want):
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-9, texts[i]
