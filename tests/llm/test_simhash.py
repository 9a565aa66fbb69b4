import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash as H

from .helpers import corpus, docs, sentence


def plain_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(n, linked):
    own = list(range(n))
    for _ in range(n):
        for i, j in linked:
            own[i] = own[j] = min(own[i], own[j])
    return own


def brute(rows, radius=3):
    fp = [plain_fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= radius]
    groups = components(len(rows), linked)
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        least[g] = min(least.get(g, i), i)
    return sorted((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fp, groups, strict=True))


def test_matches_brute_force(spark):
    texts = list(enumerate(corpus()))
    assert sorted(tuple(r) for r in H.near_duplicates(docs(spark, texts)).collect()) == brute(texts)


def chains(seed, n, far=2):
    """Fingerprints in chains whose neighbours are near, and lone ones."""
    rng = np.random.default_rng(seed)
    out = []
    for x in rng.integers(0, 2**63, n):
        for _ in range(rng.integers(1, 9)):
            out.append(int(x))
            for b in rng.choice(64, rng.integers(1, far + 2), replace=False):
                x = int(x) ^ (1 << int(b))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_links_span_what_brute_force_links(spark, hot):
    fp = chains(1, 60)
    frame = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "little"))) for i, f in enumerate(fp)], "node long, fp binary")
    found = components(len(fp), [(r.a, r.b) for r in H.links(frame, len(fp), 3, hot=hot).collect()])
    want = components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    assert found == want


def test_trees_find_all_in_the_radius():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, (400, 1), dtype=np.uint64) & np.uint64(0xFFF)  # close together
    fp = np.unique(fp, axis=0)
    first = np.where(np.arange(len(fp)) < 100, 0, 100)
    forest = H.Forest(fp, first)
    got = {(int(a), int(b)) for q, n in forest.near(np.arange(len(fp)), 3) for a, b in zip(q, n, strict=True)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i != j and first[i] == first[j] and int(fp[i, 0] ^ fp[j, 0]).bit_count() <= 3}
    assert got == want


def test_bands_meet_whatever_their_number():
    rng = np.random.default_rng(3)
    for n in (10, 10**7, 10**10):
        masks = H.band_masks(n, 3)
        for x in rng.integers(0, 2**63, 50):
            y = int(x)
            for b in rng.choice(64, 3, replace=False):
                y ^= 1 << int(b)
            assert any((int(x) ^ y) & m == 0 for m in masks)


def test_long_chains_become_one_component(spark):
    edges = spark.range(1, 200).select((F.col("id") * 7 % 200).alias("a"), ((F.col("id") - 1) * 7 % 200).alias("b"))
    found = dict(H.components(edges).collect())
    assert set(found.values()) == {0} and len(found) == 200
    assert H.components(edges.limit(0)).count() == 0


def test_wide_fingerprints_find_near_copies_and_no_others(spark):
    import random

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [sentence(rng, 300, vocabulary) for _ in range(30)]
    near = []
    for b in base[:15]:
        w = b.split()
        for at in rng.sample(range(300), 4):
            w[at] = "other"
        near.append(" ".join(w))
    half = [" ".join(b.split()[:150] + sentence(rng, 150, vocabulary).split()) for b in base[15:]]
    kept = {r.doc_id for r in H.drop_near_duplicates(docs(spark, base + near + half)).collect()}
    assert kept == set(range(60)) - set(range(30, 45))


def test_edges(spark):
    assert H.near_duplicates(docs(spark, [])).count() == 0
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in H.near_duplicates(docs(spark, [(None, None), (7, ""), (9, " \n")])).collect()}
    assert got == {(None, "0" * 16, 7), (7, "0" * 16, 7), (9, "0" * 16, 7)}
    long = " ".join(f"w{k}" for k in range(70_000))
    assert H.near_duplicates(docs(spark, [(1, long), (1, long)])).select("component_id").distinct().count() == 1
    clash = docs(spark, [(1, "a b c"), (2, "a b c")]).selectExpr("doc_id", "text", "1 as fp", "2 as component_id", "3 as __x")
    assert H.drop_near_duplicates(clash).columns == clash.columns and H.drop_near_duplicates(clash).count() == 1


def shingles(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}


def alike(a, b):
    return len(a & b) / len(a | b)


def test_near_dup_stage_is_the_components_of_exact_similarity(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = sentence(rng, 150, vocabulary).split()
        for edits in (0, 2, 3, 4, 5, 6, 7):  # similarities from 0.87 down to 0.6, on both sides of 0.8
            w = list(base)
            for at in rng.sample(range(150), edits):
                w[at] = f"x{rng.random()}"
            texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i // 7 * 7, i) if alike(sets[i], sets[j]) >= 0.8]
    own = components(len(texts), linked)
    assert 60 < len(set(own)) < len(texts)
    kept = {r.doc_id for r in H.drop_near_duplicates(docs(spark, texts)).collect()}
    assert kept == set(own)


def test_alike_sets_match_brute_force():
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 2**63, int(n)).astype(np.uint64) for n in rng.integers(1, 60, 20)]
    sets = [np.unique(np.r_[b[rng.random(len(b)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)]) for b in base for _ in range(12)] + [np.zeros(0, np.uint64)]
    plain = [set(s.tolist()) for s in sets]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if plain[i] | plain[j] and 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])]
    want = components(len(sets), linked)
    got = H.alike_sets(sets, 0.8)
    empty = [i for i, s in enumerate(plain) if not s]
    assert [g for i, g in enumerate(got.tolist()) if i not in empty] == [w for i, w in enumerate(want) if i not in empty]


def test_crowded_shards_are_shared(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (1, 8), dtype=np.uint64)
    rows = [(int(i) * 16, bytearray((base ^ np.uint64(1 << int(i) % 60)).tobytes())) for i in range(40)]
    frame = spark.createDataFrame(rows, "node long, fp binary")
    found = dict(H.components(H.candidates(frame, 40, 36, 8, hot=16)).collect())
    assert set(found.values()) == {0} and len(found) == 40


def test_bands_are_as_many_as_their_width_asks_for():
    for n, alike in ((10, 0.8), (10**6, 0.8), (10**9, 0.8), (10**6, 0.9)):
        wide, number = H.bands(n, alike)
        order = H.band_bits(n, 8, alike)
        assert order.shape == (number, wide) and all(len(set(b)) == wide for b in order.tolist()) and n / 2**wide <= 64
        agree = 1 - np.arccos(2 * alike / (1 + alike)) / np.pi
        assert (1 - agree**wide) ** number <= H.MISSED


def test_majorities_match_plain_counting():
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 0, 3, 254, 255, 256, 1000)]
    got = H.majorities(sets, 3)
    for s, row in zip(sets, got, strict=True):
        assert row.tobytes() == H.majority(s, 3)


def test_shingle_sets_tell_texts_apart_by_their_shingles():
    import pyarrow as pa

    texts = [None, "", " \n", "a", "a b", "b a", "A  b", "a b c d e", "a b c d e f", "a b c d e a b c d e a b c d e", "\u00a0a b c d e", "x" * 100_000 + " y", "é è"]
    plain = [frozenset(tuple((t or "").lower().split(" ") and __import__("re").findall(r"[^\x20\x09-\x0d]+", (t or "").lower()))[i : i + 5] for i in range(max(1, len((t or "").split()) - 4))) if (t or "").strip(" \n") else frozenset() for t in texts]
    got = [frozenset(s.tolist()) for s in H.shingle_sets(pa.array(texts), 5)]
    assert [len(s) for s in got] == [len(s) for s in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert (got[i] == got[j]) == (plain[i] == plain[j]) and len(got[i] & got[j]) == len(plain[i] & plain[j])


@pytest.mark.parametrize("settled", [1 << 20, 200, 40])
def test_groups_of_any_size_are_settled_alike(spark, settled):
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**62), 2**62, 40)
    rows = []
    for label in range(3):
        for _ in range(40):
            own = base[: 40 - 8 * label].copy()
            at = rng.choice(len(own), int(rng.integers(0, 5)), replace=False)
            own[at] = rng.integers(-(2**62), 2**62, len(at))
            rows.append((label, len(rows) * 7, sorted(own.tolist())))
    frame = spark.createDataFrame(rows, "label long, node long, members array<long>")
    found = dict(H.components(H.alike_links(frame, 0.8, settled)).collect())
    plain = [set(m) for _, _, m in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] and 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])]
    want = components(len(rows), linked)
    assert [found.get(n, n) for _, n, _ in rows] == [w * 7 for w in want] and 3 < len(set(want)) < 100


def test_rows_that_repeat_an_id_are_told_apart(spark):
    long = " ".join(f"w{k}" for k in range(100))
    other = " ".join(f"v{k}" for k in range(100))
    got = sorted((r.doc_id, r.text) for r in H.drop_near_duplicates(docs(spark, [(0, long), (1, other), (1, long + " end"), (None, other), (2, None), (3, "")])).collect())
    assert got == sorted([(0, long), (1, other), (2, None)], key=lambda r: (r[0], r[1] or ""))


def test_repeated_lines_count_once_in_the_near_dup_stage(spark):
    import random

    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    line = sentence(rng, 12, vocabulary)
    apart = [sentence(rng, 150, vocabulary) + f" {line}" * 20 for _ in range(2)]
    text = sentence(rng, 300, vocabulary)
    near = [f"{text} {line}", text + f" {line}" * 5]
    kept = {r.doc_id for r in H.drop_near_duplicates(docs(spark, apart + near)).collect()}
    assert kept == {0, 1, 2}
