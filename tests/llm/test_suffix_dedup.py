import hashlib
import random

import numpy as np
import pytest

from lectern.llm import suffix_dedup as S

from .helpers import corpus, docs


def brute(rows, length=50):
    holder = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            holder[w] = min(holder.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if holder[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 512)
    monkeypatch.setattr(S, "PORTION", 64)
    monkeypatch.setattr(S, "BLOCK", 8)


def test_matches_brute_force(spark):
    texts = list(enumerate(corpus()))
    assert rows(S.digests(docs(spark, texts))) == brute(texts)


@pytest.mark.parametrize(("batch_bytes", "hot"), [(2000, 4096), (2000, 1), (50_000, 2)])
def test_batches_and_hot_grams(spark, batch_bytes, hot):
    texts = list(enumerate(corpus(seed=3)))
    got = S.remove_repeats(docs(spark, texts), batch_bytes=batch_bytes, hot=hot).collect()
    want = {i: (n, gone, spans) for i, n, gone, spans, _ in brute(texts)}
    assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans)) for r in got} == want


def test_long_texts_are_cut_into_stretches():
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcd ") for _ in range(3000))
    texts = S.Texts([1, 2], [base, base[700:1500] + b"xyz" + base[10:40]], 50)
    whole = {bytes(base[p : p + 50]) for p in range(len(base) - 49)}
    runs = lambda t: sorted(p for a, b, s in zip(t.first, t.last, t.doc, strict=True) if s == 0 for p in range(a, b + 1))
    assert runs(texts) == list(range(len(base) - 49))
    assert whole == {texts.data[p : p + 50] for p in runs(texts)}


def test_stretches(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 100)
    texts = [S.Texts([1], [bytes(range(256)) * 3], 50)]
    places = sorted({texts[0].base[s] + p - texts[0].start[s] for a, b, s in zip(texts[0].first, texts[0].last, texts[0].stretch, strict=True) for p in range(a, b + 1)})
    assert places == list(range(768 - 49))


def test_family_of_levels():
    rng = random.Random(7)
    contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50, 60))) for _ in range(300)] + [b"\0" * 60, b"\0" * 55, b"\0" * 49 + b"\1"]
    ids = np.array([rng.randrange(100) for _ in contexts])
    least = {}
    for c, i in zip(contexts, ids, strict=True):
        for k in range(len(c) - 9):
            least[c[k : k + 10]] = min(least.get(c[k : k + 10], 10**9), i)
    masks = S.earlier_holders(np.frombuffer(b"".join(contexts), np.uint8), np.array([len(c) - 9 for c in contexts]), ids, 10)
    for c, i, m in zip(contexts, ids, masks, strict=True):
        assert [bool(int(m) >> k & 1) for k in range(len(c) - 9)] == [least[c[k : k + 10]] < i for k in range(len(c) - 9)]
    f = S.Family(50)
    strings = [b"%050d" % rng.randrange(10**40) for _ in range(512)]
    for k in range(64):
        f.scan(np.frombuffer(b"".join(strings[8 * k : 8 * k + 8]), np.uint8), np.arange(8) * 50, np.full(8, k))
    assert len(f.levels) <= 8 and sum(len(x) for _, x, _ in f.levels) == 512
    for data, places, holder in f.levels:
        held = [bytes(data[p : p + 50]) for p in places]
        assert held == sorted(held) and [strings.index(x) // 8 for x in held] == holder.tolist()


@pytest.mark.parametrize("length", [17, 31, 32, 33, 50, 64, 79])
def test_suffix_arrays_are_sorted(length):
    rng = np.random.default_rng(length)
    data = np.r_[rng.integers(0, 2, 600), np.zeros(100), np.full(100, 255), rng.integers(0, 256, 200)].astype(np.uint8)
    places = rng.permutation(len(data) - length + 1)
    order, new = S.suffix_array(data, places, length)
    ranked = [data[p : p + length].tobytes() for p in places[order]]
    assert ranked == sorted(ranked) and new.tolist() == [k == 0 or ranked[k] != ranked[k - 1] for k in range(len(ranked))]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(S, "string_hashes", lambda data, at, length: np.zeros(len(at), np.uint64))
    line, other = b"a line of more than fifty bytes that two of the documents hold", b"another line of more than fifty bytes, which also stands twice"
    texts = S.Texts([3, 1, 2], [line + b"." + other, other + b"!" + line, line], 50)
    c = S.Contexts(texts, np.full(len(texts.grams(1)[0]), 1, np.uint8), 1)
    of = {}
    for k, a, b in zip(c.of, c.first, c.last, strict=True):
        of.setdefault(texts.data[a : b + 50], set()).add(int(k))
    assert all(len(v) == 1 for v in of.values()) and len(of) == len(c.place) == len({min(v) for v in of.values()})
    held = {}
    for d, a, b in zip(c.doc, c.first, c.last, strict=True):
        held.setdefault(texts.data[a : b + 50], []).append(texts.ids[d])
    assert all(c.least[min(k)] == min(held[context]) for context, k in of.items()) and any(len(set(v)) > 1 for v in held.values())


def test_shards_sort_only_strings_of_several_contexts(monkeypatch):
    rng = random.Random(11)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(80)) for _ in range(40)]
    contexts = [*texts, *texts[:20], texts[30][5:70] + b"!" * 9]  # copies, and 16 strings of another context
    ids = np.array([*range(100, 140), *range(20), 7])
    seen, scan = [], S.Family.scan
    monkeypatch.setattr(S.Family, "scan", lambda self, data, places, ids: seen.extend(places) or scan(self, data, places, ids))
    masks = S.earlier_holders(np.frombuffer(b"".join(contexts), np.uint8), np.array([len(c) - 49 for c in contexts]), ids, 50).tolist()
    assert len(seen) == 32
    bits = [[m >> k & 1 for k in range(len(c) - 49)] for c, m in zip(contexts, masks, strict=True)]
    shared = [1 if 5 <= k < 21 else 0 for k in range(31)]
    assert bits == [[1] * 31] * 20 + [[0] * 31] * 10 + [shared] + [[0] * 31] * 9 + [[0] * 31] * 20 + [[0] * 25]


def test_edges(spark):
    assert S.digests(docs(spark, [])).count() == 0
    line = "x" * 20 + "abcdefghijklmnopqrstuvwxyz0123456789 and some more of it"
    null = S.digests(docs(spark, [(None, line), (4, line), (None, line)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in null) == [(-1, len(line)), (-1, len(line)), (4, 0)]
    twice = S.digests(docs(spark, [(4, line), (4, line)])).collect()
    assert [r.n_removed for r in twice] == [0, 0]
    clash = docs(spark, [(1, line), (2, "é" + line)]).selectExpr("doc_id", "text", "7 as batch", "8 as kept", "cast(9 as long) as n_chars")
    kept = {r.doc_id: r for r in S.without_repeats(clash).collect()}
    assert S.without_repeats(clash).columns == clash.columns
    assert (kept[1].text, kept[1].n_chars, kept[2].text, kept[2].n_chars, kept[2].batch) == (line, len(line), "é", 1, 7)
    # A cut inside a character drops what is left of it.
    a, b = "é" + "y" * 60, "è" + "y" * 60  # they share the second byte? no: the last byte differs
    assert {r.text for r in S.without_repeats(docs(spark, [(1, a), (2, b)])).collect()} == {a, "è"}
