"""What the operators share: scratch tables in the shared folder, and reading of the driver's tables."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset and all runs in one process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    set_one = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_one.isDefined():
        return set_one.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: What this process has left in the shared folder and the warehouse: (kind, place).
_LEFT: list[tuple[str, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return _leave(spark, "path", f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new name for a table in the warehouse."""
    return _leave(spark, "table", f"{name}_{uuid.uuid4().hex}")


def _leave(spark: SparkSession, kind: str, place: str) -> str:
    """Results are lazy and read what is left here; what nobody has dropped before goes when the process ends."""
    atexit.unregister(_at_exit)
    atexit.register(_at_exit, spark)
    _LEFT.append((kind, place))
    return place


def _at_exit(spark: SparkSession) -> None:
    with suppress(Exception):  # the session may be over
        if spark.sparkContext._jsc is not None:
            drop_scratch(spark)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever operators write for themselves inside is deleted at the end. Results are lazy: write them inside, too, or they lose
    what they read."""
    before = len(_LEFT)
    try:
        yield
    finally:
        drop_scratch(spark, before)


def left() -> int:
    """How much scratch there is so far, for drop_scratch."""
    return len(_LEFT)


def drop_scratch(spark: SparkSession, begin: int = 0, end: int | None = None) -> None:
    """Deletes what was left from `begin` on, before `end`."""
    gone = _LEFT[begin:end]
    del _LEFT[begin:end]
    for kind, place in gone:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {place}")
        else:
            delete_path(spark, place)


def delete_path(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def reads_scratch(df: DataFrame, begin: int, end: int) -> bool:
    """Whether df reads what was left from `begin` on, before `end`."""
    names = [place.rsplit("/", 1)[-1].lower() for _, place in _LEFT[begin:end]]
    return any(name in file.lower() for file in df.inputFiles() for name in names) if names else False


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on, Arrow batches of this session hold `most` bytes at most (and a row): whole texts go to Python, and by the default of
    64 MiB each task would hold several times that."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands what this worker no longer uses back to the machine: workers of earlier stages stay beside those of later ones."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives memory back when its partition ends."""

    def thrifty_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return thrifty_run


def ascii_lower(c: Column) -> Column:
    """Only A-Z are lowered; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers that fall, one each, into n buckets."""
    own = spark.range(0, 30 * n + 100).select(F.col("id").cast("int").alias("label"))
    rows = own.groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("bucket")).agg(F.min("label").alias("label")).collect()  # n rows
    found = dict(rows)
    return [found.get(b, 30 * n + 100 + b) for b in range(n)]


def library_memo(description: str, ordinary: bool = True, most: int = 16 << 20):
    """Piece of text -> its ids as little-endian 32-bit bytes, by the tokenizers library; pieces of some `most` bytes are kept. ordinary: the
    strings of special tokens are text like any other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(description)
    tokenizer.encode_special_tokens = ordinary
    give_back()
    return PieceMemo(tokenizer, most)


#: Bytes of an entry of a memo beside the text and the ids; longer texts are not kept.
ENTRY, LONGEST = 200, 256


class Memo(dict):
    """What was seen of late, in two generations of half of `most` bytes each."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size, self.before = most, 0, {}

    def turn(self) -> None:
        """Before a batch: if it is full, this generation becomes the former one."""
        if self.size > self.most // 2:
            self.before = {k: v for k, v in self.items() if len(k) <= LONGEST}
            self.clear()
            self.size = 0

    def keep(self, key: str, ids: bytes) -> None:
        self[key] = ids
        self.size += ENTRY + len(key) + len(ids)

    def drop_long(self, keys: Iterable[str]) -> None:
        for k in keys:
            if len(k) > LONGEST and k in self:
                self.size -= ENTRY + len(k) + len(self.pop(k))


class PieceMemo(Memo):
    """The pieces seen of late. New ones are encoded together: a run of pieces that the library would cut apart by itself is
    handed over as one text, and cut by the library's count of words."""

    def __init__(self, tokenizer, most: int):
        super().__init__(most)
        self.tokenizer = tokenizer

    def learn(self, texts: list[list[str]], joiner: str | None) -> None:
        self.turn()
        new, before = [], self.before
        for p in set().union(*texts) - self.keys():
            if p in before:
                self.keep(p, before[p])
            else:
                new.append(p)
        # Pieces that can stand in a row: with "" between, those that begin with a space.
        alone = [p for p in new if joiner is None or (not joiner and p[:1] != " ")]
        row = [p for p in new if not (joiner is None or (not joiner and p[:1] != " "))]
        for at in range(0, len(row), 512):
            part = row[at : at + 512]
            e = self.tokenizer.encode(joiner.join(part), add_special_tokens=False)
            words, ids = np.array(e.word_ids, np.int64), np.array(e.ids, "<u4")
            edges = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            if len(edges) == len(part):
                cuts = [*(edges * 4).tolist(), len(ids) * 4]
                data = ids.tobytes()
                for k, p in enumerate(part):
                    self.keep(p, data[cuts[k] : cuts[k + 1]])
            else:
                alone += part
        for at in range(0, len(alone), 4096):
            part = alone[at : at + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.keep(p, np.array(e.ids, "<u4").tobytes())

    def joined(self, texts: list[list[str]], joiner: str | None = None) -> list[bytes]:
        """The ids of texts cut into pieces. joiner: what may stand between two pieces without changing either; None: nothing."""
        self.learn(texts, joiner)
        out = [b"".join([self[p] for p in t]) for t in texts]
        self.drop_long(set().union(*texts))
        return out


class ChunkMemo(Memo):
    """Chunk of text (what stands between white space) -> its ids. A new chunk is cut into pieces, which a PieceMemo knows."""

    def __init__(self, pieces: PieceMemo, cut: Callable[[str], list[str]], joiner: str, most: int = 32 << 20):
        super().__init__(most)
        self.pieces, self.cut, self.joiner = pieces, cut, joiner

    def of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        self.turn()
        new, before = [], self.before
        for c in chunks:
            if c not in self:
                if c in before:
                    self.keep(c, before[c])
                else:
                    new.append(c)
        for c, ids in zip(new, self.pieces.joined([self.cut(c) for c in new], self.joiner), strict=True):
            self.keep(c, ids)
        out = [self[c] for c in chunks]
        self.drop_long(new)
        return out


def char_class(wanted: Callable[[str], bool], end: int = 0x250) -> str:
    """The characters below `end` that are wanted, as they stand inside brackets in a pattern."""
    return "".join(re.escape(chr(c)) for c in range(end) if wanted(chr(c)))
