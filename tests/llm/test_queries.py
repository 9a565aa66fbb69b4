"""The queries over the smallest tables: against their SQL where there is one, else their shape."""

from pathlib import Path

import duckdb
import pytest

from lectern.llm import queries

DATA = Path("/root/testdata/sf0.001")
COLUMNS = {
    "op1_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op2_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op3_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op4_toxicity": {"doc_id": "bigint", "toxic": "boolean"},
    "op5_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        cur = con.execute(queries.ORACLE_SQL[name])
        assert canon(df.columns, rows) == canon([c[0] for c in cur.description], cur.fetchall())


def test_all_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS)
