"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The merges are recovered from a rank file: a token of two bytes or more was merged from the two parts that the lower ranks make
of it. Texts are cut where the split pattern always cuts (before a space that a word follows, and around other white space);
each distinct piece is encoded once by the library and kept in a bounded memo, so a frequent word costs a lookup.
Bytes are mapped to printable characters for the library, and mapped back in decoding: a token may end inside a character,
so only the joined bytes are a text.

Edge cases: null and empty texts have no tokens. Very long texts, and long ones without white space, are encoded whole. Special
tokens' strings are ordinary text. An empty table gives an empty result; rows may repeat. Only the named columns are read.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import char_class, library_memo, small_batches, thrifty

#: How text is split before merging; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's white space.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
# The pattern spelled out for texts of characters below U+0250 and of common punctuation.
_LETTER = char_class(lambda c: unicodedata.category(c)[0] == "L")
_NUMBER = char_class(lambda c: unicodedata.category(c)[0] == "N")
_KNOWN = "\x00-\u024f\u2010-\u2027\u2030-\u205e"
OTHERS = re.compile(f"[^{_KNOWN}]")
PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{SPACE}{_LETTER}{_NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def cut_text(text: str) -> list[str]:
    """Pieces that are encoded independently."""
    return (PIECE if OTHERS.search(text) else PLAIN).findall(text)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], most), i) for i in range(len(parts) - 1))
        if rank >= most:
            raise ValueError(f"no merges lead to {token!r}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def library_json(ranks: dict[bytes, int]) -> str:
    """The tokenizers library's description of the same encoding."""
    chars = byte_characters()
    name = lambda token: "".join(chars[b] for b in token)
    ordered = sorted(ranks, key=ranks.__getitem__)
    merges = [[name(x) for x in _halves(t, ranks)] for t in ordered if len(t) > 1]
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        ]},
        "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                  "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {name(t): ranks[t] for t in ordered}, "merges": merges},
    })


class Codec:
    def __init__(self, description: str):
        self.memo = library_memo(description)
        self.tokenizer = self.memo.tokenizer
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab()
        self.table = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.table[i] = bytes(back[c] for c in token)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.memo.joined([cut_text(t) for t in texts], "")

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Span of characters of each token; a token that ends inside a character covers all of it."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.table[i] for i in memoryview(ids).cast("I")])


_CODECS: dict[str, Codec] = {}


def codec(description: str) -> Codec:
    """One codec a worker process."""
    if description not in _CODECS:
        _CODECS.clear()
        _CODECS[description] = Codec(description)
    return _CODECS[description]


def encode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and, on demand, spans (array of start and end in characters)."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(library_json(read_ranks(ranks_path)))  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(c.encode(texts), pa.binary())]
                if offsets:
                    columns.append(pa.array([[{"start": s, "end": e} for s, e in c.offsets(t)] for t in texts], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "spans"][: len(columns)])

    schema = "doc_id long, ids binary" + ", spans array<struct<start:int,end:int>>" * offsets
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(thrifty(run), schema)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and decoded (the bytes; of a text if the ids are all of a text's)."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(library_json(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = pa.array([c.decode(x or b"") for x in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out], ["doc_id", "ids", "decoded"])

    return df.select(df[id_col].alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(thrifty(run), "doc_id long, ids binary, decoded binary")


def round_trip_digests(df: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decode(encode(df, ranks_path), ranks_path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
