"""License scans over a positional rare-token index, with DataFrame functions only.

The index holds, for every template, where its rarest words stand; how rare a word is, is counted over all files. All words of
a file that the index has are looked up in it. A word at place i of the file and p of a template votes for the alignment
i - p; votes of one template for one alignment are counted by sorting. A template with enough votes is a match if the file holds
all its key phrases, word for word. Every step works inside a row: nothing but the word counts is shuffled, and the index
is bounded by the templates.

Beside the method's labels there are base labels: those of phrases whose words stand consecutively anywhere in the file.

Edge cases: null and empty texts have no words, no labels and score 0. Very long texts are read whole; a file that repeats one
licence word n times costs n log n. Ties in IDF go by the word. Rows may repeat; an empty table gives an empty result. Only the two
named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: A run of these stands between two words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (phrase, label)
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (label, words, key phrases that must be there)
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "associated documentation files")),
    ("mit", "released under the mit license", ("mit license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("may not use this file except in compliance with the license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ("under the terms of the gnu general public license",)),
    ("gpl", "this work is licensed under the gnu general public license version", ("gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
)
#: Of a template's words this part, and so many at most, are in the index: the rarest.
PART, MOST = 0.6, 24
#: Part of a template's indexed words that must stand in one alignment: a file may hold a piece of it; key phrases decide.
VOTES = 0.25


def normalised(text: Column) -> Column:
    """The words with single spaces between."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, " "))


def word_frequencies(df: DataFrame, words: Sequence[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Rows of df, and in how many of them each word stands. Rows of the result: one a word."""
    vocabulary = F.lit(sorted(words))
    found = df.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(vocabulary, F.split(normalised(df[text_col]), " ")))).alias("word"))
    counts = {r.word: r["count"] for r in found.groupBy("word").count().collect()}
    return counts.pop("", 0), counts


class Index:
    """Template postings of the rarest words."""

    def __init__(self, templates, rows: int, counts: dict[str, int]):
        self.templates = templates
        idf = lambda w: math.log((rows + 1) / (counts.get(w, 0) + 1))
        self.postings: dict[str, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []
        for t, (_, text, _) in enumerate(templates):
            words = text.split()
            ranked = sorted(set(words), key=lambda w: (-idf(w), w))
            kept = set(ranked[: min(MOST, math.ceil(PART * len(ranked)))])
            places = [(w, p) for p, w in enumerate(words) if w in kept]
            self.sizes.append(len(places))
            for w, p in places:
                self.postings.setdefault(w, []).append((t, p))
        self.vocabulary = sorted(self.postings)
        self.needed = [max(2, math.ceil(n * VOTES)) for n in self.sizes]

    def literal(self) -> Column:
        entries = []
        for w, places in self.postings.items():
            entries += [F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in places])]
        return F.create_map(*entries)


_VOTES = """
aggregate(pairs, named_struct('t', -1, 'off', 0, 'n', 0, 'hits', cast(array() as array<struct<t:int,n:int>>)),
  (a, x) -> named_struct(
    't', x.t, 'off', x.off,
    'n', if(a.t = x.t and a.off = x.off, a.n + 1, 1),
    'hits', if(if(a.t = x.t and a.off = x.off, a.n + 1, 1) >= needed[x.t],
               array_append(filter(a.hits, h -> h.t <> x.t or h.n > if(a.t = x.t and a.off = x.off, a.n + 1, 1)),
                            named_struct('t', x.t, 'n', if(a.t = x.t and a.off = x.off, a.n + 1, 1))),
               a.hits)),
  a -> a.hits)
"""


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row of df."""
    rows, counts = word_frequencies(df, sorted({w for _, text, _ in templates for w in text.split()}), text_col)
    index = Index(templates, rows, counts)
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))

    d = df.select(df[id_col].alias("doc_id"), normalised(df[text_col]).alias("plain"))
    d = d.withColumns({"n_words": F.when(F.col("plain") == "", 0).otherwise(spaces(F.col("plain")) + 1).cast("long"), "padded": F.concat(F.lit(" "), F.col("plain"), F.lit(" ")), "words": F.split("plain", " ")})
    # All indexed words of the file: the templates bound them, and a cap would lose whole templates in files that hold several.
    d = d.withColumn("rare", F.array_intersect(F.lit(index.vocabulary), F.col("words")))
    d = d.withColumns({"postings": index.literal(), "needed": F.lit(index.needed)})
    d = d.withColumn(
        "pairs",
        F.expr("""if(size(rare) < 2, cast(array() as array<struct<t:int,off:int>>),
            array_sort(flatten(transform(
              filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), x -> array_contains(rare, x.w)),
              x -> transform(postings[x.w], p -> named_struct('t', p.t, 'off', x.i - p.p))))))"""),
    )
    phrase = "|".join(p for p, _ in base)
    any_base = None
    for p, _ in base:
        c = F.contains("padded", F.lit(f" {p} "))
        any_base = c if any_base is None else any_base | c
    d = d.withColumns({"hits": F.expr(_VOTES), "cut": F.when(any_base, F.split("padded", f" (?=(?:{phrase}) )"))})
    keys = F.array(*[F.array(*[F.lit(f" {k} ") for k in ks]) for _, _, ks in templates])
    verified = F.filter("hits", lambda h: F.forall(F.get(keys, h["t"]), lambda k: F.contains(F.col("padded"), k)))
    d = d.withColumns({
        "verified": verified,
        "base": F.filter(F.array(*[F.when(F.contains("padded", F.lit(f" {p} ")), F.lit(label)) for p, label in base]), lambda x: x.isNotNull()),
    })
    names, sizes = F.lit([t[0] for t in templates]), F.lit(index.sizes)
    labels = F.array_union("base", F.transform("verified", lambda h: F.get(names, h["t"])))
    fit = F.coalesce(F.array_max(F.transform("verified", lambda h: h["n"] / F.get(sizes, h["t"]))), F.lit(0.0))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return d.select(
        "doc_id",
        "n_words",
        F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut") - 1).cast("long").alias("n_base"),
        spaces(F.get("cut", F.lit(0))).cast("long").alias("first_word"),
        (F.col("n_words") - spaces(F.element_at("cut", -1))).cast("long").alias("last_word"),
        join("base").alias("base_labels"),
        join(labels).alias("labels"),
        F.least(F.lit(1.0), F.when(F.col("cut").isNull(), 0.0).otherwise(0.5) + fit / 2).alias("score"),
    )
