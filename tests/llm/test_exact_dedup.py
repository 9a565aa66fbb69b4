import hashlib
import re

from lectern.llm import bloom, exact_dedup

from .helpers import corpus, docs


def brute(rows):
    norm = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in rows]
    groups = {}
    for i, t, n in norm:
        groups.setdefault(n, []).append((-len(t), i))
    out = []
    for i, _, n in norm:
        keep = min(groups[n])[1]
        out.append((i, keep, len(groups[n]), keep == i, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_matches_brute_force(spark):
    texts = list(enumerate(corpus()))
    assert rows(exact_dedup.exact_groups(docs(spark, texts))) == brute(texts)


def test_a_full_filter_changes_nothing(spark):
    # Two slots a row at most 2^16: many collisions, so rows are held that are alone.
    texts = list(enumerate(corpus(seed=2, n=200)))
    small = exact_dedup.exact_groups(docs(spark, texts), slots_per_row=0, max_slots=1 << 16)
    assert rows(small) == brute(texts)


def test_filter_lets_single_rows_through(spark):
    import pyspark.sql.functions as F

    d = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("sha"))
    twice = d.unionByName(d.limit(5))
    held = bloom.build(twice, 3005, 2)
    assert held.slots % bloom.SEGMENT == 0 and 5 <= sum(bin(b).count("1") for b in held.bits) < 400
    passed = {bytes(r.sha) for r in d.where(held.passes(F.col("sha"))).collect()}
    assert {bytes(r.sha) for r in d.limit(5).collect()} <= passed and len(passed) < 100
    assert not d.where(bloom.build(d.limit(0), 0).passes(F.col("sha"))).count()
    assert d.where(bloom.build(d, 3000).passes(F.col("sha"))).count() == 3000
    assert d.limit(3).select(F.lit(None).cast("binary").alias("sha")).where(held.passes(F.col("sha"))).count() == 0


def test_ranges_change_nothing(spark):
    texts = list(enumerate(corpus(seed=4, n=300)))
    # More slots asked for than one filter may have: several filters, one after the other.
    cut = exact_dedup.exact_groups(docs(spark, texts), slots_per_row=1000, max_slots=1 << 16)
    assert rows(cut) == brute(texts)


def test_whole_rows(spark):
    texts = list(enumerate(corpus(seed=5, n=100)))
    stay = {k for _, k, _, _, _ in brute(texts)}
    for slots in (8, 1000):
        got = exact_dedup.drop_exact_duplicates(docs(spark, texts), slots_per_row=slots, max_slots=1 << 16).collect()
        assert sorted(r.doc_id for r in got) == sorted(stay) and all(r.text == dict(texts)[r.doc_id] for r in got)
    # An id that repeats is no reason to stay, and of rows that are alike in all one stays.
    got = exact_dedup.drop_exact_duplicates(docs(spark, [(0, "X"), (1, "Y"), (1, "X"), (2, "Y"), (2, "Y"), (None, "Z"), (None, "Z"), (5, None), (4, " ")])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("0", "X"), ("1", "Y"), ("4", " "), ("None", "Z")]


def test_edges(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    # Ties by length go to the smaller id; a null id comes last; rows repeat.
    got = rows(exact_dedup.exact_groups(docs(spark, [(5, "a b"), (3, "ab "), (4, "ab")])))
    assert [(i, k, n, s) for i, k, n, s, _ in got] == [(3, 3, 3, True), (4, 3, 3, False), (5, 3, 3, False)]
    null = exact_dedup.exact_groups(docs(spark, [(None, "z"), (1, "z")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in null} == {(None, 1, False), (1, 1, True)}
    twice = exact_dedup.exact_groups(docs(spark, [(1, "z"), (1, "z"), (2, "z")])).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in twice) == [(1, 3, True), (1, 3, True), (2, 3, False)]
    clash = docs(spark, [(1, "z"), (2, "z")]).selectExpr("doc_id", "text", "1 as keep_id", "2 as sha", "3 as maybe")
    assert exact_dedup.drop_exact_duplicates(clash).columns == clash.columns and exact_dedup.drop_exact_duplicates(clash).count() == 1
