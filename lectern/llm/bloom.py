"""Bloom filters over digests, built by partitions, merged by segments, and sent to the tasks that ask them.

A counting filter's counters stop at `times`; a digest passes if all its counters have reached it. With `times` 1 it is a plain Bloom filter,
with 2 it holds what was added twice or looks as if. No digest is ever wrongly refused. A filter has `slots_per_row` slots for each digest
and never more than `max_slots` bits, so what is broadcast is bounded; with more digests than that, more pass by chance.

Edge cases: nothing passes a filter of no digests. Digests have 16 bytes or more, all of one length; a null one never passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions

SEGMENT = 1 << 16
HASHES = 2
SLOTS_PER_ROW, MAX_SLOTS = 8, 1 << 28
#: Digests of one partition whose slots are gathered before they are handed on.
GATHER = 1 << 18


def _slots(digests: pa.Array, slots: int) -> np.ndarray:
    """HASHES slots for each digest, from bytes of it that do not overlap."""
    found = digests.to_pylist()
    width = len(found[0]) if found else 16
    words = np.frombuffer(b"".join(found), np.uint8).reshape(-1, width)[:, : 8 * HASHES]
    return (np.ascontiguousarray(words).view("<u8") & np.uint64(slots - 1)).astype(np.int64)


def _count(slots: int):
    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        at = np.sort(np.concatenate(parts))
        seg = at // SEGMENT
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        low = (at % SEGMENT).astype("<u2")
        blobs = [x.tobytes() for x in np.split(low, starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(seg[starts].astype(np.int32)), pa.array(blobs, pa.binary())], ["seg", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            if b.num_rows:
                parts.append(_slots(b.column(0), slots).ravel())
                n += b.num_rows
            if n >= GATHER:
                yield emit(parts)
                parts, n = [], 0
        if parts:
            yield emit(parts)

    return run


def _merge(times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by segment; one segment's counters are held at a time."""
        seg, counts = None, None

        def out():
            bits = np.packbits(counts >= times, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([bits], pa.binary())], ["seg", "bits"])

        for b in batches:
            for s, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != seg:
                    if seg is not None and (counts >= times).any():
                        yield out()
                    seg, counts = s, np.zeros(SEGMENT, np.uint8)
                more = np.bincount(np.frombuffer(hits, "<u2"), minlength=SEGMENT)
                counts = np.minimum(counts + np.minimum(more, times), times).astype(np.uint8)
        if seg is not None and (counts >= times).any():
            yield out()

    return run


class Filter:
    def __init__(self, spark: SparkSession, slots: int, bits: bytes):
        self.slots, self.bits = slots, bits
        self._held = spark.sparkContext.broadcast(bits)  # max_slots bits at most

    def passes(self, digest: Column) -> Column:
        slots, held = self.slots, self._held

        def test(digests: pa.Array) -> pa.Array:
            bits = np.frombuffer(held.value, np.uint8)
            known = np.array(digests.is_valid())
            at = _slots(digests.drop_null(), slots)
            known[known] = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            return pa.array(known)

        return F.arrow_udf(test, "boolean")(digest)


def build(digests: DataFrame, n: int, times: int = 1, slots_per_row: int = SLOTS_PER_ROW, max_slots: int = MAX_SLOTS) -> Filter:
    """digests: one binary column, without nulls; n: about how many rows."""
    slots = SEGMENT
    while slots < min(max_slots, n * slots_per_row):
        slots *= 2
    spark = digests.sparkSession
    hits = digests.mapInArrow(_count(slots), "seg int, hits binary")
    merged = hits.repartition(partitions(spark), "seg").sortWithinPartitions("seg").mapInArrow(_merge(times), "seg int, bits binary")
    bits = bytearray(slots // 8)
    for seg, part in merged.collect():  # slots / 8 bytes at most
        bits[seg * (SEGMENT // 8) : (seg + 1) * (SEGMENT // 8)] = part
    return Filter(spark, slots, bytes(bits))
