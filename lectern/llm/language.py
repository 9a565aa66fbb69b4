"""Language identification with string kernels.

Two texts are as alike as the n-grams of characters (one to four, blended) that both hold, by presence, normalised by the n-grams
that each holds. Some texts of the sample are Nyström landmarks; kernel ridge regression, one language against the rest,
is solved in the space they span. The kernel to the landmarks is linear in a text's presence vector, so landmarks, whitening and weights
are multiplied out once, and a batch of texts is scored by one matrix product.

Texts are lower-cased and taken whole, in stretches of `STRETCH` characters that are scored alike and averaged by their length.

The model is fitted on a bounded sample: some `per_lang` texts of each language (default 400), and of each text `stretches` stretches (default 4)
that lie evenly from its beginning to its end. `landmarks` stretches (default 192) are landmarks. Texts are chosen by a threshold on a hash of the
id, so nothing is ranked or gathered by language; only ids whose crc32, mod 3, isn't 1 are learned from.

`known_language` rejects what is "und" and gives the others the language that was told. Every text with a letter is told one of the learned languages;
how sure the model is, is its score, and no floor is set on it: margins of short clean texts lie as low as those of foreign scripts.

Edge cases: null text, and text without a letter, is "und" with score 0; so is every text if there is nothing to learn from.
Rows with a null id are never learned from. Rows may repeat. An empty table gives an empty result. Only the named columns are read; others
are carried whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

BUCKETS = 1 << 15
GRAMS = 4
STRETCH = 2048
#: Stretches that are scored together.
TOGETHER = 32
UNKNOWN = "und"


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of 0 and 1 over the buckets for each stretch; the text and the length of each stretch."""
    parts = [(i, t[s : s + STRETCH]) for i, t in enumerate(texts) for s in range(0, len(t), STRETCH)]
    lengths = np.array([len(p) for _, p in parts], np.int64)
    codes = np.frombuffer("".join(p for _, p in parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(parts)), lengths)
    out = np.zeros((len(parts), BUCKETS), np.uint8)
    flat = out.reshape(-1)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, GRAMS + 1):
        # h[i]: the n characters from i on.
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        mixed = (h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        at = (mixed >> np.uint64(64 - 15)).astype(np.int64)
        own = row[: len(at)]
        whole = own == row[n - 1 :]  # not over the edge of a stretch
        flat[(own * BUCKETS + at)[whole]] = 1
    return out, np.array([i for i, _ in parts], np.int64), lengths


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        group: list[int] = []
        size = 0
        for i, t in enumerate([*texts, None]):
            if group and (t is None or size >= TOGETHER):
                self._add([texts[j] for j in group], group, out, total)
                group, size = [], 0
            if t:
                # A text of many stretches goes through in slices, so the matrix stays small.
                if len(t) > TOGETHER * STRETCH:
                    for s in range(0, len(t), TOGETHER * STRETCH):
                        self._add([t[s : s + TOGETHER * STRETCH]], [i], out, total)
                else:
                    group.append(i)
                    size += -(-len(t) // STRETCH)
        return out / np.maximum(total, 1)[:, None]

    def _add(self, texts: list[str], ids: list[int], out: np.ndarray, total: np.ndarray) -> None:
        p, own, lengths = presence(texts)
        p = p.astype(np.float32)
        margin = (p @ self.weights) / np.sqrt(np.maximum(p.sum(axis=1), 1))[:, None]
        at = np.array(ids)[own]
        np.add.at(out, at, margin * lengths[:, None])
        np.add.at(total, at, lengths)


def _unit_rows(bits: np.ndarray) -> np.ndarray:
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(rows: np.ndarray, langs: list[str], landmarks: int = 192, ridge: float = 1e-2) -> Model:
    """rows: presence, one row of packed bits a stretch; langs: of each row."""
    names = sorted(set(langs))
    if len(rows) == 0:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    code = np.array([names.index(v) for v in langs])
    # Landmarks in turn from each language.
    turn = np.zeros(len(code), np.int64)
    for c in range(len(names)):
        turn[code == c] = np.arange((code == c).sum())
    chosen = np.lexsort((code, turn))[:landmarks]
    marks = _unit_rows(rows[chosen])
    k_mm = marks @ marks.T
    value, vector = np.linalg.eigh(k_mm.astype(np.float64))
    keep = value > 1e-6 * value[-1]
    whiten = vector[:, keep] / np.sqrt(value[keep])
    # A few rows at a time are unpacked.
    z = np.concatenate([_unit_rows(rows[s : s + 256]) @ marks.T for s in range(0, len(rows), 256)]).astype(np.float64) @ whiten
    y = np.where(code[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Each language weighs the same, however many of its rows were sampled.
    n = np.bincount(code, minlength=len(names)).astype(np.float64)
    v = (len(code) / len(names) / n)[code]
    w = np.linalg.solve(z.T @ (z * v[:, None]) + ridge * len(code) / 100 * np.eye(z.shape[1]), z.T @ (y * v[:, None]))
    return Model(names, (marks.T @ (whiten @ w).astype(np.float32)).astype(np.float32))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(True))


def spread(n: int, most: int) -> list[int]:
    """`most` of n places, from the first to the last."""
    return sorted({round(k * (n - 1) / max(1, most - 1)) for k in range(most)}) if n > most else list(range(n))


def _rows_of_sample(stretches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text.lower()
                starts = range(0, len(text), STRETCH)
                p, _, _ = presence([text[starts[k] : starts[k] + STRETCH] for k in spread(len(starts), stretches)])
                bits = [np.packbits(r).tobytes() for r in p]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bits)), pa.array(bits, pa.binary())], ["lang", "bits"])

    return run


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, landmarks: int = 192, stretches: int = 4) -> Model:
    """Fits the model on the bounded sample."""
    small_batches(df.sparkSession)
    d = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[lang_col].alias("lang")).where(~held_out(df[id_col]) & df[lang_col].isNotNull())
    counts = d.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return fit(np.zeros((0, BUCKETS // 8), np.uint8), [])
    # The hash's part of its range below which about per_lang rows of the language lie.
    part = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, per_lang / r["count"]))])
    at = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / F.lit(float(1 << 53))
    chosen = d.where((at <= F.element_at(part, F.col("lang"))) & has_letter(F.col("text"))).select("text", "lang")
    # About per_lang * stretches * 4 KiB a language. Sorted: the fit doesn't depend on the order of arrival.
    sample = [(r.lang, bytes(r.bits)) for r in chosen.mapInArrow(_rows_of_sample(stretches), "lang string, bits binary").collect()]
    sample.sort(key=lambda r: (r[0], zlib.crc32(r[1]), r[1]))
    return fit(np.array([np.frombuffer(b, np.uint8) for _, b in sample]).reshape(-1, BUCKETS // 8), [v for v, _ in sample], landmarks)


def told(df: DataFrame, model: Model, text: Column, temperature: float = 4.0) -> Column:
    """A struct of the language and its score. Only the text goes to Python."""
    held = df.sparkSession.sparkContext.broadcast(model)  # 128 KiB a language

    def run(texts: pa.Array, letters: pa.Array) -> pa.Array:
        m = held.value
        known = letters.to_pylist()
        texts = [t.lower() if ok else "" for t, ok in zip(texts.to_pylist(), known, strict=True)]
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if m.langs and texts:
            s = m.scores(texts)
            p = np.exp((s - s.max(axis=1, keepdims=True)) * temperature)
            p /= p.sum(axis=1, keepdims=True)
            lang = [m.langs[k] if ok else UNKNOWN for k, ok in zip(s.argmax(axis=1), known, strict=True)]
            score = np.where(known, p.max(axis=1), 0.0)
        out = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])
        give_back()
        return out

    # Nondeterministic only so that it is not computed twice, for a filter and for what it lets through.
    return F.arrow_udf(run, "lang string, score double").asNondeterministic()(text, has_letter(text))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of df."""
    small_batches(df.sparkSession)
    d = df.select(df[id_col].cast("long").alias("doc_id"), held_out(df[id_col]).alias("held_out"), told(df, model, df[text_col]).alias("told"))
    return d.select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))


def learn_and_identify(df: DataFrame) -> DataFrame:
    return identify(df, learn(df))


def known_language(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df whose language the model can tell, with all their columns, and that language as lang_col."""
    model = learn(df, text_col=text_col, lang_col=lang_col)
    rows = df.select(F.struct(*[df[c].alias(f"c{k}") for k, c in enumerate(df.columns)]).alias("row"), told(df, model, df[text_col]).alias("told"))
    rows = rows.where(F.col("told.lang") != UNKNOWN)
    return rows.select(*[(F.col("told.lang") if c == lang_col else F.col("row")[f"c{k}"]).alias(c) for k, c in enumerate(df.columns)])
