"""Every stage against what it should keep, by brute force, and the whole."""

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as C  # noqa: E402

from lectern.llm import common  # noqa: E402
from lectern.llm.common import scratch_dir  # noqa: E402

from .helpers import corpus, docs  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark, corpus(seed=8, n=120)).cache()


def test_stages_are_in_order():
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "suffix_dedup", "best_fit_packing"]


def run_stages(spark, table, tmp_path):
    out, d = [], table
    for n, (name, f) in enumerate(C.STAGES):
        d2 = f(spark, d, "unused")
        d2.write.parquet(str(tmp_path / str(n)))
        d2 = spark.read.parquet(str(tmp_path / str(n)))
        out.append((d.collect(), d2.collect(), d2.columns))
        d = d2
    return out


def test_stages(spark, table, tmp_path):
    lang, exact, near, cut, packed = run_stages(spark, table, tmp_path)
    assert all(columns == COLUMNS for _, _, columns in (lang, exact, near, cut))
    ids = lambda rows: {r.doc_id for r in rows}
    assert ids(lang[1]) == {r.doc_id for r in lang[0] if r.text and any(c.isalpha() for c in r.text)}
    best = {}
    for r in exact[0]:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert ids(exact[1]) == {i for _, i in best.values()}
    shingles = {}
    for r in near[0]:
        w = r.text.lower().split()
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    kept = ids(near[1])
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for a in kept:
        assert all(alike(a, b) < 0.8 for b in kept if a != b)
    for a in ids(near[0]) - kept:
        assert max(alike(a, b) for b in shingles if a != b) >= 0.8
    holder = {}
    for r in cut[0]:
        b = r.text.encode()
        for p in range(len(b) - 49):
            holder[b[p : p + 50]] = min(holder.get(b[p : p + 50], r.doc_id), r.doc_id)
    after = {r.doc_id: r for r in cut[1]}
    for r in cut[0]:
        b = r.text.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if holder[b[p : p + 50]] < r.doc_id:
                gone[p : p + 50] = True
        want = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert (after[r.doc_id].text, after[r.doc_id].n_chars) == (want, len(want))
    assert {r.doc_id for r in packed[1]} == ids(packed[0])
    assert max(r.offset + r.length for r in packed[1]) <= 2048


def test_run(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "documents.parquet"))
    before, folder = spark.catalog.listTables(), Path(scratch_dir(spark).removeprefix("file:"))
    others = {p.name for p in folder.glob("stage-*")}
    done = C.run(spark, str(tmp_path))
    assert done.count() > 0
    # Nothing of the stages' own is left but the result.
    assert {t.name for t in spark.catalog.listTables()} <= {t.name for t in before}
    assert {p.name for p in folder.glob("stage-*")} - others == {Path(done.inputFiles()[0]).parent.name}


def test_scratch_goes_when_the_next_stage_is_called(spark, table, tmp_path):
    first = C.exact(spark, table, "")
    first.write.parquet(str(tmp_path / "a"))
    names = [place.rsplit("/", 1)[-1] for _, place in common._LEFT]
    lazy = C.near(spark, first, "")  # reads what the first stage left
    assert lazy.count() and first.count()
    C.near(spark, spark.read.parquet(str(tmp_path / "a")), "").write.parquet(str(tmp_path / "b"))
    C.passages(spark, spark.read.parquet(str(tmp_path / "b")), "").write.parquet(str(tmp_path / "c"))
    left = [place.rsplit("/", 1)[-1] for _, place in common._LEFT]
    assert sum(n.startswith("company") for n in left) <= sum(n.startswith("company") for n in names) + 1


def test_very_long_texts_and_clashing_names(spark, tmp_path):
    """Every stage takes a text of a million characters, and columns that are called like its own."""
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    names = ["row", "told", "digest", "maybe", "sha", "kept", "batch", "c0", "lang_pred", "__letters", "label", "node"]
    d = docs(spark, [(1, long), (2, long + " end"), (3, "a short text of its own"), (4, long[:700_000])]).selectExpr("*", *[f"{k} as {n}" for k, n in enumerate(names)])
    for n, (_, f) in enumerate(C.STAGES):
        before = d
        f(spark, d, "").write.parquet(str(tmp_path / str(n)))
        d = spark.read.parquet(str(tmp_path / str(n)))
        assert n == 4 or d.columns == before.columns
    assert {r.doc_id for r in d.select("doc_id").distinct().collect()} == {1, 3, 4}


def test_empty_and_odd_tables(spark, tmp_path):
    d = table_of(spark, [])
    for _, f in C.STAGES:
        assert f(spark, d, "").count() == 0
    d = table_of(spark, [(None, None), (1, "words of a text"), (1, "words of a text"), (2, None)])
    for n, (_, f) in enumerate(C.STAGES):
        f(spark, d, "").write.parquet(str(tmp_path / f"odd{n}"))
        d = spark.read.parquet(str(tmp_path / f"odd{n}"))
    assert {r.doc_id for r in d.collect()} == {1}


def table_of(spark, rows):
    return docs(spark, rows)
