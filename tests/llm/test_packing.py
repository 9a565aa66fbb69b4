import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing as P

from .helpers import corpus, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = ["a  b \n\n c\t d", "x\x85y z", "日本語 テキスト🙂", "I'll we've  'd", "é ́x", "ΑΣ ΑΣΑ. ΑΣ", "İstanbul ẞ", "\x00a\x00", "1234 ٣٤ ½", "a\x1cb", "don't'S'", "<|endoftext|> hi", "ǅ ŉ ʼn", "Ａ", "x" * 5000, ""]


def test_cutting_into_words_changes_no_id(library):
    memo = P.word_memo(open(PATH, encoding="utf-8").read())
    texts = [t or "" for t in corpus()] + ODD
    got = P.token_ids(pa.array(texts), memo)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:50]


def test_every_piece_has_its_place(spark, library):
    texts = list(enumerate([*corpus(), *ODD, "word " * 900]))
    rows = P.best_fit_pack(docs(spark, texts), PATH, capacity=256, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 256))
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 for r in own)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    lengths = Counter(r.length for r in rows)
    assert P.lower_bound(lengths, 256) <= len(by_sequence) <= sum(P.best_fit(lengths, 256).values())


def optimum(items, capacity):
    """Fewest bins, by trying all sets beside the first piece."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for n in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in chosen) <= capacity:
                best = min(best, 1 + optimum([x for i, x in enumerate(rest) if i not in chosen], capacity))
    return best


def test_small_packings_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        items = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))]
        packed = P.pack_counts(dict(Counter(items)), 20)
        want = optimum(sorted(items, reverse=True), 20)
        assert packed.bound <= want == packed.sequences
        assert Counter(x for f, n in packed.plan.items() for x in f for _ in range(n)) == Counter(items)
        assert all(sum(f) <= 20 for f in packed.plan)


def test_completion_beats_best_fit():
    # Longest first leaves 8|8 apart: best fit needs four bins where three do.
    counts = {7: 2, 6: 1, 5: 2, 4: 3, 3: 3}
    assert P.pack_counts(counts, 17).sequences <= sum(P.best_fit(counts, 17).values())
    hard = [(Counter(x), c) for x, c in (((44, 24, 24, 22, 21, 17, 8, 8, 6, 6), 60), ((6, 5, 5, 4, 4, 3, 3), 10))]
    for counts, capacity in hard:
        assert P.pack_counts(dict(counts), capacity).sequences == optimum(sorted(counts.elements(), reverse=True), capacity)


def test_fillings_are_undominated():
    counts = {9: 1, 6: 2, 5: 1, 3: 2, 1: 1}
    lengths = sorted(counts, reverse=True)
    for f in P.fillings(lengths, counts, 10, 1000)[0]:
        assert sum(f) <= 10 and sum(f) == 10


def test_special_tokens_are_those_of_the_library(spark, library):
    text = "a <|endoftext|> b"
    assert len(library.encode(text, add_special_tokens=False).ids) == 3 or 0 in library.encode(text, add_special_tokens=False).ids
    row = P.best_fit_pack(docs(spark, [text, "plain"]), PATH, with_ids=True).where("doc_id = 0").first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_the_budget_ends_the_search():
    rng = random.Random(2)
    counts = dict(Counter(rng.randrange(1, 2049) for _ in range(3000)))
    few, more = P.pack_counts(counts, 2048, 5_000), P.pack_counts(counts, 2048)
    assert few.bound <= more.sequences <= few.sequences <= sum(P.best_fit(counts, 2048).values())


def test_memos_are_bounded_and_forget_long_texts(library):
    memo = P.word_memo(open(PATH, encoding="utf-8").read())
    memo.most = 100_000
    for k in range(20):
        words = " ".join(f"w{k}x{j}" for j in range(300)) + " " + "y" * 5000
        assert np.frombuffer(P.token_ids(pa.array([words]), memo)[0], "<u4").tolist() == library.encode(words, add_special_tokens=False).ids
        assert memo.size <= 150_000 and all(len(c) <= 256 for c in memo)
    P._MEMOS.clear()


def test_edges(spark):
    assert P.best_fit_pack(docs(spark, []), PATH).count() == 0
    rows = P.best_fit_pack(docs(spark, [(1, None), (1, None), (None, "")]), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (1, 1), (1, 1)] and len({r.sequence_id for r in rows}) == 1
    clash = docs(spark, ["a"]).selectExpr("doc_id", "text", "1 as part", "2 as kind", "3 as length")
    assert P.best_fit_pack(clash, PATH).count() == 1


def test_rows_that_wait_for_python_are_narrow(spark):
    """They are kept on disk meanwhile: with the map of where ranks begin in each row, that was four times the input."""
    plan = P.best_fit_pack(docs(spark, ["a b", "c"]), PATH)._jdf.queryExecution().optimizedPlan()
    found = []

    def walk(node):
        if node.nodeName() == "ArrowEvalPython":
            found.append(node.children().apply(0).schema().simpleString())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    assert len(found) == 1 and "map<" not in found[0], found


def test_words_of_plain_letters_go_to_the_merges_directly(library):
    memo = P.word_memo(open(PATH, encoding="utf-8").read())
    letters = [c for c in map(chr, P._SPELL)]
    words = sorted({*letters, *(c + "a" for c in letters), "thonre", "éelleoule", "ÉLÈVE", "straße", "x" * 300, *(f"{a}{b}on" for a in letters[:80] for b in letters[-90:])})
    assert all(ids is not None for ids in memo.words(words))
    assert memo.words(words) == [np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    pieces = []
    memo.pieces.joined = lambda texts, joiner, f=memo.pieces.joined: pieces.extend(texts) or f(texts, joiner)
    assert memo.of([*words, "a1"])[:-1] == memo.words(words) and pieces == [["a", "1"]]
    # Words that the last tokens don't tell apart are left to the library.
    memo.clear()
    memo.last[:] = False
    assert memo.of(["abc", "def"]) == [np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in ("abc", "def")]
    P._MEMOS.clear()
