"""SimHash near-dedup over BK-trees.

A text's fingerprint has a bit for each that is set in over half of its shingles' XXH64. Fingerprints that differ in at most `radius` bits
are linked; a component is all that links reach.

With 64 bits and a small radius the search is exact. Texts of which only four fifths agree are about ten bits of 64 apart, too
many to search for; for these there are wide fingerprints of several words of 64 bits, of the set of shingles, and they only propose. Texts
meet in the shard of some bits that agree, of all bits dealt into bands again and again; how wide a band is goes with the number of texts,
and how many there are follows from it, so that two texts of just that similarity share one with a chance of 0.999 at any size. Of those that meet,
texts within a radius well beyond the similarity asked for are candidates. Components of candidates are then split by the sets
themselves: pairs of at least that Jaccard similarity are linked, and components of these links count. A pair is missed only if
no chain of candidates joins its texts.

Distinct fingerprints are searched, never rows, so copies cost nothing. Each is sent to the shards of its bands: for the exact search, the 64 bits are
cut into blocks, and two fingerprints within the radius agree in all blocks but `radius` of them, so they meet in the shard of some set of
the other blocks. The number of blocks grows with the fingerprints, so that shards stay small. A shard's fingerprints form a BK-tree: a
child hangs from its parent by their Hamming distance, and a search follows only the edges within the radius of its own
distance. Trees are built and searched level by level for all shards of a batch at once. A shard of more than `hot` fingerprints is cut
into parts, and every two parts meet in a task of their own, so that no task holds more than two. Trees are sent to the tasks that query them and to no
others, so nothing that is broadcast grows with the data.

A task hands on a spanning forest of the links it found, never all pairs of a group. Components come from alternating rounds of
"larger neighbours to the smallest" over the written edges, and stop when nothing changes.

A component of candidates is settled in one task if its sets have at most `SETTLED` shingles. In a larger one, all sets are first held against
a few of their own, which links most of a group of near copies at once; what is not in the largest class then is held against all, both in parts of that size, a
pair of parts in each task.

Edge cases: null and empty texts have fingerprint zero, linked like any other; they have no shingles, and count as copies of one text in
the similarity stage. Fewer words than a shingle: the whole sequence. Rows that repeat an id are rows of their own; of each component one row stays, of the
smallest id, which one if they tie is open. A null id is never a component's id unless all are null. An empty table gives an empty
result. Other columns are carried whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import partitions, small_batches, thrifty, written

SEED = 42
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16
#: Pairs of query and node that are looked at at once, and rows gathered before a batch of shards is searched.
FRONTIER, GATHERED = 1 << 20, 1 << 17
#: Of a wide fingerprint: words whose distance is taken, and the chance at which two texts of the least similarity may share no band.
MEASURED, MISSED = 2, 1e-3
#: Shingles of the sets that one task settles; sets that all of a larger component are first held against.
SETTLED, HUBS = 1 << 20, 4
#: One in so many wide fingerprints tells which shards are crowded; that settles only into how many tasks they are cut.
COUNTED_PART = 16


# --- fingerprints ---


def shingle_hashes(text: str | None, words: int) -> list[int]:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and only ASCII white space
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    h = xxhash.xxh64_intdigest
    return [h(joined[s:e], SEED) for s, e in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word's hashes: the first word's as they are, others mixed from them."""
    if k:
        h = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def fingerprint(text: str | None, words: int = 3, width: int = 1) -> bytes:
    """width words of 64 bits, little-endian. A shingle counts as often as it stands there."""
    return majority(shingle_hashes(text, words), width)


def majority(hashes: list[int] | np.ndarray, width: int) -> bytes:
    counts = np.zeros((width, 64), np.int64)
    for at in range(0, len(hashes), COUNTED):
        h = np.array(hashes[at : at + COUNTED], np.uint64)
        for k in range(width):
            counts[k] += np.unpackbits(mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").tobytes()


def fingerprints(df: DataFrame, words: int = 3, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (binary, width times 8 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                fp = [fingerprint(t, words, width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.binary())], ["doc_id", "fp"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(thrifty(run), "doc_id long, fp binary")


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles. Words are cut and told apart in Arrow; only distinct ones are hashed."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    cut = pc.ascii_split_whitespace(trimmed)
    coded = cut.flatten().dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    h = known[coded.indices.to_numpy(zero_copy_only=False)]
    edges = np.asarray(cut.offsets).astype(np.int64) - cut.offsets[0].as_py()
    # joined[i]: the words from i on, `words` of them, in their order.
    joined = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(joined)]
    joined = mixed(joined, 1)
    out = []
    for a, b, empty in zip(edges[:-1].tolist(), edges[1:].tolist(), pc.equal(trimmed, "").to_pylist(), strict=True):
        if empty:
            out.append(np.zeros(0, np.uint64))
        elif b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        else:
            whole = xxhash.xxh64_intdigest(h[a:b].tobytes(), SEED)
            out.append(np.array([whole], np.uint64))
    return out


#: The lowest bit of every byte.
_LANES = np.uint64(0x0101010101010101)


def majorities(sets: list[np.ndarray], width: int) -> np.ndarray:
    """A row of width words for each set: bits that are set in over half of its hashes, mixed anew for each word."""
    out = np.zeros((len(sets), width), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    s = 0
    while s < len(sets):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + COUNTED, side="right")))
        own = np.flatnonzero(sizes[s:e]) + s
        if len(own):
            h = np.concatenate([sets[i] for i in own])
            start = np.cumsum(sizes[own]) - sizes[own]
            # Eight counters lie side by side in a word, so at most 255 hashes are added at once.
            pieces = -(-sizes[own] // 255)
            first = np.cumsum(pieces) - pieces
            cuts = np.repeat(start - 255 * first, pieces) + 255 * np.arange(int(pieces.sum()))
            for k in range(width):
                m = mixed(h, k)
                counts = np.zeros((len(own), 64), np.int64)
                for bit in range(8):
                    lanes = np.add.reduceat((m >> np.uint64(bit)) & _LANES, cuts)
                    counts[:, bit::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
                out[own, k] = np.packbits(2 * counts > sizes[own][:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
        s = e
    return out


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def set_fingerprints(df: DataFrame, words: int, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the text), shingles (a digest of the set of shingles), fp: of the set, so that a repeated line counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = shingle_sets(part.column(2), words)
                digests = [hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() for s in sets]
                fp = [row.tobytes() for row in majorities(sets, width)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(fp, pa.binary())], ["doc_id", "digest", "shingles", "fp"])

    d = df.select(df[id_col].cast("long").alias("doc_id"), text_digest(df[text_col]).alias("digest"), df[text_col].alias("text"))
    return d.mapInArrow(thrifty(run), "doc_id long, digest binary, shingles binary, fp binary")


# --- shards and trees ---


def band_masks(n: int, radius: int, bits: int = 64) -> list[int]:
    """Masks of bits such that any two within the radius agree on one of them; more blocks for more fingerprints."""
    blocks = radius + 1
    while blocks < 2 * (radius + 1) and n > 32 << (bits * (blocks - radius) // blocks):
        blocks += 1
    edges = [bits * i // blocks for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(part[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]


def bands(n: int, alike: float = 0.8) -> tuple[int, int]:
    """Bits of a band and number of bands for n wide fingerprints. A shard has some sixty by chance, or less; two sets of similarity `alike` have
    a cosine of 2 alike / (1 + alike), and as much of a half turn between them as bits differ."""
    width = max(14, math.ceil(math.log2(max(2, n))) - 6)
    agree = (1 - math.acos(2 * alike / (1 + alike)) / math.pi) ** width
    return width, math.ceil(math.log(MISSED) / math.log(1 - agree))


def band_bits(n: int, width: int, alike: float = 0.8) -> np.ndarray:
    """Which bits of width words stand in each band: all bits as they are, then dealt anew as often as it takes."""
    r = np.random.RandomState(SEED)
    wide, number = bands(n, alike)
    per = 64 * width // wide
    deals = [np.arange(64 * width), *(r.permutation(64 * width) for _ in range(-(-number // per) - 1))]
    return np.concatenate([d[: per * wide].reshape(per, wide) for d in deals])[:number]


def _banded(n: int, width: int, alike: float):
    """A row for each band of each wide fingerprint, with the words whose distance is taken."""
    order = band_bits(n, width, alike)
    number, wide = order.shape
    weight = np.uint64(1) << np.arange(wide, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                fp = part.column("fp").to_pylist()
                bits = np.unpackbits(np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
                keys = (bits[:, order.reshape(-1)].reshape(len(fp), number, wide) * weight).sum(axis=2, dtype=np.uint64)
                rows = pa.array(np.repeat(np.arange(len(fp)), number))
                near = pa.array([f[: 8 * MEASURED] for f in fp], pa.binary())
                keys |= np.arange(number, dtype=np.uint64) << np.uint64(40)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), part.column("node").take(rows), near.take(rows)], ["shard", "node", "fp"])

    return run


def _sharded(masks: list[int]):
    """A row for each mask of each fingerprint of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                part = b.slice(at, 8192)
                fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), "<u8").reshape(-1, 1)
                keys = fp & np.array(masks, np.uint64)
                n, number = keys.shape
                rows = pa.array(np.repeat(np.arange(n), number))
                # Two shards that fall together by chance cost work, not results.
                keys = mixed(keys ^ mixed(np.arange(number, dtype=np.uint64), 2), 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), part.column("node").take(rows), part.column("fp").take(rows)], ["shard", "node", "fp"])

    return run


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees of several shards. fp: their fingerprints, a row each; first: of each, the place of its shard's first one, the root."""

    def __init__(self, fp: np.ndarray, first: np.ndarray):
        self.fp, self.root, self.base = fp, first, fp.shape[1] * 64 + 1
        parents, edges, children = [], [], []
        active = np.flatnonzero(first != np.arange(len(fp)))
        node = first[active]
        while len(active):
            d = distance(fp[active], fp[node])
            # The first to come to a parent by a distance is its child; the others go on below it.
            _, lead, group = np.unique(node * self.base + d, return_index=True, return_inverse=True)
            parents.append(node[lead])
            edges.append(d[lead])
            children.append(active[lead])
            child = active[lead][group]
            on = child != active
            active, node = active[on], child[on]
        p, e, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, edges, children))
        order = np.argsort(p * self.base + e, kind="stable")
        self.parent, self.edge, self.child = p[order], e[order], c[order]
        self.keys = self.parent * self.base + self.edge

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of what is within the radius of them, in pieces."""
        todo = [(queries, self.root[queries])]
        most = FRONTIER // self.fp.shape[1] ** 2
        while todo:
            q, node = todo.pop()
            if len(q) > most:
                todo += [(q[: len(q) // 2], node[: len(q) // 2]), (q[len(q) // 2 :], node[len(q) // 2 :])]
                continue
            d = distance(self.fp[q], self.fp[node])
            hit = (d <= radius) & (q != node)
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.keys, node * self.base + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * self.base + np.minimum(d + radius, self.base - 1), side="right") - low
            # Few enough children at a time.
            ends = np.cumsum(n)
            for s, e in ((s, s + most) for s in range(0, len(q), most)) if not len(n) or ends[-1] <= 4 * most else _runs(ends, 4 * most):
                if total := int(n[s:e].sum()):
                    at = np.repeat(low[s:e] - np.r_[0, np.cumsum(n[s:e])[:-1]], n[s:e]) + np.arange(total)
                    todo.append((np.repeat(q[s:e], n[s:e]), self.child[at]))

    def linked(self, radius: int) -> np.ndarray:
        """Of each place the smallest place of its component."""
        labels = np.arange(len(self.fp))
        tie = self.edge <= radius
        labels = merge_labels(labels, self.parent[tie], self.child[tie])
        # What tree edges have joined already needs no search: a link between two components of a shard has an end outside the largest.
        comp, inverse, size = np.unique(labels, return_inverse=True, return_counts=True)
        shard = self.root[comp]
        order = np.lexsort((comp, -size, shard))
        largest = np.zeros(len(comp), bool)
        largest[order[np.r_[True, shard[order][1:] != shard[order][:-1]][: len(order)]]] = True
        for q, node in self.near(np.flatnonzero(~largest[inverse]), radius):
            labels = merge_labels(labels, q, node)
        return labels


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts places into runs whose counts (ends: their sums so far) come to about `most`."""
    s = 0
    while s < len(ends):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, side="right")))
        yield s, e
        s = e


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels: of each place, a smaller or the same place of its component. Joins the components of a and b."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further


def _search(radius: int, width: int):
    gathered = GATHERED // width

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts)
        shard, pair, node = (t.column(c).to_numpy() for c in ("shard", "pair", "node"))
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), "<u8").reshape(-1, width)
        new = np.r_[True, (shard[1:] != shard[:-1]) | (pair[1:] != pair[:-1])]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        labels = Forest(fp, first).linked(radius)
        tied = np.flatnonzero(labels != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[labels[tied]])], ["a", "b"]) if len(tied) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            shard = [b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "pair")]
            if held >= gathered:
                # Cut where the last shard ends.
                on = (shard[0] != last[0]) | (shard[1] != last[1])
                at = int(np.argmax(on)) if on.any() else b.num_rows
                parts.append(b.slice(0, at))
                held += at
                b = b.slice(at)
                if b.num_rows:
                    if (out := flush(parts)) is not None:
                        yield out
                    parts, held = [], 0
            if b.num_rows:
                parts.append(b)
                held += b.num_rows
            last = [c[-1] for c in shard]
        if parts and (out := flush(parts)) is not None:
            yield out

    return run


def _searched(shards: DataFrame, radius: int, width: int) -> DataFrame:
    """a, b of shards: shard, node, fp and, if some are crowded, parts: into how many parts a shard is cut. Every two parts of a shard meet
    (pair)."""
    if "parts" in shards.columns:
        d = shards.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        d = d.withColumn("pair", F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))
        dealt = d.repartition(partitions(shards.sparkSession), "shard", "pair").sortWithinPartitions("shard", "pair")
    else:
        # A sort by one number is much cheaper.
        dealt = shards.repartition(partitions(shards.sparkSession), "shard").sortWithinPartitions("shard").withColumn("pair", F.lit(0))
    return dealt.select("shard", "pair", "node", "fp").mapInArrow(thrifty(_search(radius, width)), "a long, b long")


def links(fps: DataFrame, n: int, radius: int = 3, hot: int = 20_000) -> DataFrame:
    """a, b: links that span the components of the distinct fingerprints fps (columns node, a number for each, and fp, of one word; n of them)."""
    shards = written(fps.select("node", "fp").mapInArrow(_sharded(band_masks(n, radius)), "shard long, node long, fp binary"), "shards")
    sizes = shards.groupBy("shard").count().where(F.col("count") > 1).withColumn("parts", F.ceil(F.col("count") / hot).cast("int")).drop("count")
    # A fingerprint alone in its shard goes no further.
    return _searched(shards.join(sizes.hint("merge"), "shard"), radius, 1)


def candidates(fps: DataFrame, n: int, radius: int, width: int, alike: float = 0.8, hot: int = 20_000) -> DataFrame:
    """a, b: links that span the components of the wide fingerprints fps (columns node and fp; n of them) that share a band and are within the
    radius, which is in bits of MEASURED words."""
    schema = "shard long, node long, fp binary"
    shards = fps.select("node", "fp").mapInArrow(thrifty(_banded(n, width, alike)), schema)
    part = fps.where(F.pmod("node", F.lit(COUNTED_PART)) == 0).select("node", "fp").mapInArrow(thrifty(_banded(n, width, alike)), schema)
    crowded = part.groupBy("shard").agg((F.count(F.lit(1)) * COUNTED_PART).alias("n")).where(F.col("n") > hot)
    crowded = written(crowded.select("shard", F.ceil(F.col("n") / hot).cast("int").alias("parts")), "crowded")
    if not crowded.isEmpty():
        shards = shards.join(crowded.hint("merge"), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return _searched(shards, radius, MEASURED)


def alike_sets(sets: list[np.ndarray], alike: float) -> np.ndarray:
    """Of each set, the place of the first one of its component; sets are linked from a Jaccard similarity of `alike` on, all pairs of them.

    Two such sets share one of the rarest members of either, so only sets that do are compared, and only with sets not yet reached."""
    label = np.full(len(sets), -1)
    size = np.array([len(s) for s in sets], np.int64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(sets)), size)
    _, member, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    member = rank[member]
    member = member[np.lexsort((member, owner))]
    least = np.ceil(alike * size - 1e-9).astype(np.int64)
    leading = np.arange(len(member)) - start[owner] <= (size - least)[owner]
    own = np.zeros(len(count), bool)
    names, places, held, left = np.zeros(0, np.int64), np.zeros(0, np.int64), None, len(sets)
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], todo = first, [first]
        left -= 1
        while todo and left:
            if held is None or left <= held // 2:
                at = np.flatnonzero(leading & (label[owner] < 0))
                at = at[np.argsort(member[at], kind="stable")]
                names, places, held = member[at], owner[at], left
            x = todo.pop()
            whole = member[start[x] : start[x] + size[x]]
            lead = whole[: size[x] - least[x] + 1]
            low, high = np.searchsorted(names, lead), np.searchsorted(names, lead, side="right")
            met = np.zeros(len(sets), bool) if high.size and int((high - low).sum()) else None
            if met is None:
                continue
            for s, e in zip(low.tolist(), high.tolist(), strict=True):
                met[places[s:e]] = True
            met = np.flatnonzero(met & (label < 0) & (size >= least[x]) & (least <= size[x]))
            own[whole] = True
            for at in range(0, len(met), 4096):
                part = met[at : at + 4096]
                n = size[part]
                ends = np.cumsum(n)
                members = member[np.repeat(start[part] - (ends - n), n) + np.arange(ends[-1])]
                both = np.add.reduceat(own[members].astype(np.int64), ends - n)
                new = part[both >= alike * (size[x] + n - both) - 1e-9]
                label[new] = first
                left -= len(new)
                todo += new.tolist()
            own[whole] = False
    return label


# --- components ---


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: of each node of the edges, the smallest node of its component."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    state = edges.select(F.count(F.lit(1)), F.sum(F.crc32(F.concat_ws(",", "u", "v").cast("binary")))).first()
    while state[0]:
        # To each larger neighbour: the smallest of my neighbours and me.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # To each smaller neighbour, and of me: the smallest of them.
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.select(F.count(F.lit(1)), F.sum(F.crc32(F.concat_ws(",", "u", "v").cast("binary")))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))


def near_duplicates(df: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of df."""
    small_batches(df.sparkSession)
    docs = written(fingerprints(df, words, 1, id_col, text_col), "fingerprints")
    reps = docs.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # A number for each fingerprint, one to one.
    high, low = (F.conv(F.hex(F.substring("fp", at, 4)), 16, 10).cast("long") for at in (1, 5))
    reps = written(reps.withColumn("node", F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low)), "representatives")
    labels = components(links(reps, reps.count(), radius))
    named = labels.join(reps.hint("merge"), "node")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = written(named.join(least.hint("merge"), "label").select("fp", "component_id"), "classes")
    classes = reps.join(of.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    # A sort-merge join, so that a fingerprint with a large part of all rows is split at run time.
    out = docs.join(classes.hint("merge"), "fp")
    digits = F.concat(*[F.hex(F.substring("fp", 8 - i, 1)) for i in range(8)])
    return out.select("doc_id", F.lower(digits).alias("fingerprint"), "component_id")


# --- the similarity stage ---


def _settle(alike: float):
    """Links that span the components of a group's sets."""

    def run(t: pa.Table) -> pa.Table:
        # Each node once, in order, whatever the order of arrival.
        nodes, at = np.unique(t.column("node").to_numpy(), return_index=True)
        sets = t.column("members").combine_chunks().take(pa.array(at))
        flat, ends = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(sets.offsets) - sets.offsets[0].as_py()
        label = alike_sets([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], alike)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(nodes[tied], pa.int64()), "b": pa.array(nodes[label[tied]], pa.int64())})

    return run


def alike_links(sets: DataFrame, alike: float, settled: int = SETTLED) -> DataFrame:
    """a, b: links that span, in each group of candidates (label), the components of its sets (node; members: an array of hashes, each once)."""
    size = F.size("members")
    groups = written(sets.groupBy("label").agg(F.sum(size + 1).alias("total"), *[F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node"))["node"].alias(f"hub{k}") for k in range(HUBS)]), "groups")
    schema = "a long, b long"
    small = sets.join(groups.where(F.col("total") <= settled).select("label").hint("merge"), "label")
    out = small.groupBy("label").applyInArrow(_settle(alike), schema)
    large = written(groups.where(F.col("total") > settled), "large-groups")
    if large.isEmpty():
        return out
    members = sets.join(large.select("label").hint("merge"), "label")
    # A few sets of the group, each held against all; the side of all is split at run time.
    hubs = large.select("label", F.explode(F.array_distinct(F.array(*[f"hub{k}" for k in range(HUBS)]))).alias("node")).join(sets.hint("merge"), ["label", "node"])
    hubs = hubs.select("label", F.col("node").alias("hub"), F.col("members").alias("hub_members"))
    both = F.size(F.array_intersect("members", "hub_members"))
    star = members.join(hubs.hint("merge"), "label").where((F.col("node") != F.col("hub")) & (both >= alike * (size + F.size("hub_members") - both) - 1e-9))
    star = written(star.select(F.col("node").alias("a"), F.col("hub").alias("b")), "star")
    of = members.join(components(star).withColumnRenamed("label", "class").hint("merge"), "node", "left").select("label", "node", "members", F.coalesce("class", "node").alias("class"))
    of = written(of, "classes")
    main = of.groupBy("label", "class").count().groupBy("label").agg(F.max_by("class", F.struct("count", "class")).alias("main"))
    rest = of.join(main.hint("merge"), "label").where(F.col("class") != F.col("main")).select("label", "node", "members")
    # What is not in the largest class meets all: a task for each part of the one and each part of the other.
    parts = rest.groupBy("label").agg(F.ceil(F.sum(size + 1) / (settled / 2)).cast("int").alias("rows")).join(large.select("label", F.ceil(F.col("total") / (settled / 2)).cast("int").alias("columns")).hint("merge"), "label")
    parts = written(parts, "parts")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.join(parts.hint("merge"), "label").select("label", "node", "members", place("rows").alias("i"), every("columns").alias("j"))
    right = of.join(parts.hint("merge"), "label").select("label", "node", "members", every("rows").alias("i"), place("columns").alias("j"))
    met = left.unionByName(right).groupBy("label", "i", "j").applyInArrow(_settle(alike), schema)
    return out.unionByName(star).unionByName(met)


def drop_near_duplicates(df: DataFrame, words: int = 5, radius: int = 36, width: int = 8, id_col: str = "doc_id", text_col: str = "text", alike: float = 0.8) -> DataFrame:
    """The rows of df that stay, of each component of texts whose sets of shingles have a Jaccard similarity of `alike` or more the one
    with the smallest id, with all their columns. radius: of candidates, in bits of MEASURED words."""
    small_batches(df.sparkSession)
    docs = written(set_fingerprints(df, words, width, id_col, text_col), "fingerprints")
    sets = docs.groupBy("shingles", "fp").agg(F.count(F.lit(1)).alias("n"))
    sets = written(sets.withColumn("node", F.xxhash64("shingles")), "sets")
    found = components(candidates(sets.select("node", "fp"), sets.count(), radius, width, alike))
    found = written(sets.join(found.hint("merge"), "node").select("shingles", "node", "label"), "candidates")
    # A text of each set that is a candidate; only rows whose text a filter knows are shuffled.
    chosen = written(docs.join(found.hint("merge"), "shingles").groupBy("shingles", "node", "label").agg(F.min("digest").alias("digest")), "chosen")
    known = bloom.build(chosen.select("digest"), chosen.count())
    texts = df.select(text_digest(df[text_col]).alias("digest"), df[text_col].alias("text")).where(known.passes(F.col("digest")))
    texts = texts.groupBy("digest").agg(F.first("text").alias("text")).join(chosen.hint("merge"), "digest")
    members = F.arrow_udf(lambda t: pa.array([s.view(np.int64) for s in shingle_sets(t, words)], pa.list_(pa.int64())), "array<long>")
    texts = written(texts.select("label", F.xxhash64("shingles").alias("node"), members("text").alias("members")), "candidate-sets")
    classes = components(alike_links(texts, alike))
    # The class of each text that has company: a near copy, or a copy of its set.
    company = sets.join(classes.hint("merge"), "node", "left").where((F.col("n") > 1) | F.col("label").isNotNull())
    company = docs.select("shingles", "digest").join(company.select("shingles", F.coalesce("label", "node").alias("class")).hint("merge"), "shingles")
    company = written(company.select("digest", "class").distinct(), "company")
    # Rows without company stay where they lie; the others become one a class.
    held = bloom.build(company.select("digest"), company.count())
    row = F.struct(*[df[c].alias(f"c{k}") for k, c in enumerate(df.columns)])
    rows = df.select(row.alias("row"), text_digest(df[text_col]).alias("digest"), F.bitwise_not(df[id_col].cast("long")).alias("inv"))
    rows = rows.withColumn("maybe", held.passes(F.col("digest")))
    alone = rows.where(~F.col("maybe")).select("row")
    best = lambda d, key: d.groupBy(key).agg(F.max_by("row", F.struct("inv")).alias("row"), F.max("inv").alias("inv"))
    ours = best(rows.where("maybe"), "digest").join(company.hint("merge"), "digest", "left")
    by_class = best(ours.where(F.col("class").isNotNull()), "class").select("row")
    stay = alone.unionByName(ours.where(F.col("class").isNull()).select("row")).unionByName(by_class)
    return stay.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(df.columns)])
