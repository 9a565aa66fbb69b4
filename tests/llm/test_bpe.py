import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lectern.llm import bpe

from .helpers import corpus, docs
from .test_packing import ODD

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_same_as_the_rank_library_and_back(spark, reference):
    texts = list(enumerate([*corpus(), *ODD, "  lead", "trail  ", " a b", "\n\nx", " 　q"]))
    rows = {r.doc_id: r for r in bpe.round_trip_digests(docs(spark, texts), PATH).collect()}
    for i, t in texts:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest(), t
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_merges_are_those_of_the_vocabulary():
    made = json.loads(bpe.library_json(bpe.read_ranks(PATH)))["model"]["merges"]
    given = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["merges"]
    assert [tuple(m) for m in made] == [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in given]


def test_offsets_and_split_characters(spark):
    text = "naïve 𓀀🙂 words"
    row = bpe.encode(docs(spark, [text]), PATH, offsets=True).first()
    ids = np.frombuffer(row.ids, "<u4")
    assert len(row.spans) == len(ids) and all(0 <= s.start <= s.end <= len(text) for s in row.spans)
    codec = bpe.codec(bpe.library_json(bpe.read_ranks(PATH)))
    pieces = [codec.decode(np.array([i], "<u4").tobytes()) for i in ids]
    assert b"".join(pieces).decode() == text
    assert any(p.decode("utf-8", "ignore").encode() != p for p in pieces)  # a token that ends inside a character


def test_edges(spark):
    assert bpe.round_trip_digests(docs(spark, []), PATH).count() == 0
    rows = bpe.round_trip_digests(docs(spark, [(1, None), (None, ""), (1, "a")]).selectExpr("doc_id", "text", "1 as ids", "2 as decoded"), PATH).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 1]
