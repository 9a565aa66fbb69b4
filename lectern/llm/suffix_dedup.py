"""Removal of long passages that an earlier document holds, with a logarithmic family of suffix arrays.

Every byte goes that is covered by a string of `length` bytes which also starts in a document with a smaller id.

Comparing all suffixes with all others would shuffle every text `length` times over. What must meet is made small first, by two
facts: a string of `length` bytes has a lightest gram (16 bytes, by hash), and equal strings have the same one, wherever
they stand. Neighbouring strings share theirs, so a text falls into runs of strings, one run for every 18 bytes or so.

1. Documents are dealt to batches of some MB, each a group of rows of a table that is bucketed by batch, so that later rounds
   read it without another shuffle. A batch tells each shard of grams, in sorted 32-bit codes, which grams it has; the shard answers which
   of them another document has too. Wrong agreements of codes cost work, not results.
2. For those, the batch sends the context of each run - the bytes of its strings, equal contexts of a batch once, with their smallest
   id - to the gram's shard. A shard, too, looks at equal contexts once, and puts strings aside that no other one shares its hash with. It takes
   contexts in the order of ids, in portions. A portion gets a suffix array: the places of its strings,
   sorted by eight bytes, ties by the next eight, up to `length`. It is merge-scanned, block by block, against the suffix arrays of the existing levels
   for strings of an earlier document, and becomes a level of what is new; levels of like size merge, so there are logarithmically many. A level
   is a text and sorted places in it, of 8 bytes for each string. The shard answers which strings of a context have an earlier holder.
3. The batch marks those strings and removes what they cover.

A gram that stands in very many runs, as in a line that a third of all documents hold, would send all their contexts to one
shard. Beyond `hot` runs the strings of its contexts are dealt one by one by their own hash, whether or not they repeat;
that is as exact, and no shard gets more than its share: a batch sends a string once.

Batches and shards grow in number with the input, up to the 100,000 buckets that a table can have (0.8 TB by default); beyond that batches grow, and
`batch_bytes` times that number should be raised to what executors hold. Each batch has a row for each shard, so rows, though not bytes, grow
with the square of the number of batches.

Edge cases: null text is empty; texts shorter than `length` stay whole. A null id counts as larger than all others; rows with the same
id don't remove each other's bytes, nor do rows with a null id; they are dealt to batches by their texts and where they lie, too. Very long texts are
cut into overlapping stretches inside their batch. An empty table gives an empty result. Columns other than the two named are carried on
demand under their own names.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_labels, give_back, scratch_table, small_batches, written

GRAM = 16
#: Bytes that are hashed at once, and stretches of a long text.
CHUNK, STRETCH = 1 << 18, 1 << 20
#: Strings of a portion that gets a suffix array of its own, and of a level that are looked at at once.
PORTION, BLOCK = 1 << 19, 1 << 15
NULL_ID = (1 << 63) - 1
_U = np.uint64


def gram_hashes(b: np.ndarray) -> np.ndarray:
    v = b.astype(_U)
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        v = v[:-step] | v[step:] << _U(shift)
    h = v[:-8] * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(31)
    h += v[8:] * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


class Texts:
    """The texts of a batch, end to end, and the runs of their strings."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], length: int):
        self.length = length
        self.ids = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        self.sizes = [len(t or b"") for t in texts]
        parts, self.owner, self.base = [], [], []
        for i, t in enumerate(texts):
            t = t or b""
            for s in range(0, max(1, len(t) - length + 1), STRETCH):
                parts.append(t[s : s + STRETCH + length - 1])
                self.owner.append(i)
                self.base.append(s)
        self.start = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
        self.data = b"".join(parts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self._runs()

    def _runs(self) -> None:
        first, last, key = [], [], []
        s = 0
        while s < len(self.owner):
            e = max(s + 1, int(np.searchsorted(self.start, self.start[s] + CHUNK, side="right")) - 1)
            for out, x in zip((first, last, key), self._of(s, e), strict=True):
                out.append(x)
            s = e
        none = [np.zeros(0, np.int64)]
        self.first, self.last = np.concatenate(first or none), np.concatenate(last or none)
        self.key = np.concatenate(key or [np.zeros(0, _U)])
        self.stretch = np.searchsorted(self.start, self.first, side="right") - 1
        self.doc = np.array(self.owner, np.int64)[self.stretch]

    def _of(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of stretches s to e: places of the first and the last string, and the gram's hash."""
        at, end = int(self.start[s]), int(self.start[e])
        none = np.zeros(0, np.int64)
        if end - at < self.length:
            return none, none, np.zeros(0, _U)
        h = gram_hashes(self.bytes[at:end])
        # The low bits tell which gram it is; hashes tie only for equal grams, for which any will do.
        h = (h & ~_U(63)) | (np.arange(len(h), dtype=_U) & _U(63))
        lightest = sliding_min(h, self.length - GRAM + 1)
        whole = np.zeros(len(lightest), bool)
        for k in range(s, e):
            a, b = int(self.start[k]) - at, int(self.start[k + 1]) - at
            whole[a : max(a, b - self.length + 1)] = True
        place = np.arange(len(lightest), dtype=_U)
        gram = place + (((lightest & _U(63)) - place) & _U(63))
        begins = whole & np.r_[True, ~whole[:-1] | (gram[1:] != gram[:-1])]
        ends = whole & np.r_[~whole[1:] | begins[1:], True]
        first = np.flatnonzero(begins)
        return first + at, np.flatnonzero(ends) + at, lightest[first] >> _U(6)

    def grams(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct codes (shard and 32 bits), and of each run the place of its code."""
        code = (self.key % _U(shards)) << _U(32) | (self.key // _U(shards)) & _U(0xFFFFFFFF)
        return np.unique(code, return_inverse=True)


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, the first one as the highest."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", data, 0, (1,))[at].astype(_U)


def _offsets(length: int) -> list[int]:
    """Where words of eight bytes begin that cover a string."""
    return [*range(0, length - 8, 8), length - 8]


def string_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(len(at), _U)
    for k in _offsets(length):
        h = (h ^ words_at(data, at + k)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def equal_contexts(data: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """first, last: where the first and the last string of each run begin. Of each run the number of its context, and of each context the place of a
    run. Runs of one hash are compared byte by byte."""
    of, places, todo = np.zeros(len(key), np.int64), [], np.arange(len(key))
    while len(todo):
        _, lead, group = np.unique(key[todo], return_index=True, return_inverse=True)
        like = todo[lead][group]
        more = last[todo] - first[todo]
        same = more == last[like] - first[like]
        for step in [*range(0, int(more.max()), length), None]:
            ends = more if step is None else np.minimum(more, step)
            for k in _offsets(length):
                # Of another length, it may reach over the end.
                same[same] = words_at(data, (first[todo] + ends + k)[same]) == words_at(data, (first[like] + ends + k)[same])
        of[todo[same]] = sum(map(len, places)) + group[same]
        places.append(todo[lead])
        todo = todo[~same]
    return of, np.concatenate(places) if places else np.zeros(0, np.int64)


def context_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """own: the hashes of the first strings."""
    return own ^ (string_hashes(data, last, length) * _U(0x94D049BB133111EB) + (last - first).astype(_U)) if len(own) else own


class Contexts:
    """Contexts of the runs whose gram another document has too, equal ones once: where one stands, its number of strings and its smallest id."""

    def __init__(self, texts: Texts, flags: np.ndarray, shards: int):
        codes, inverse = texts.grams(shards)
        flag = flags[inverse] if len(inverse) else np.zeros(0, np.uint8)
        plain, hot = np.flatnonzero(flag & 3 == 1), np.flatnonzero(flag & 3 == 3)
        # Runs as they are, and the strings of hot ones one by one.
        n = texts.last[hot] - texts.first[hot] + 1
        single = np.repeat(texts.first[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.first = np.r_[texts.first[plain], single]
        self.last = np.r_[texts.last[plain], single]
        self.doc = np.r_[texts.doc[plain], np.repeat(texts.doc[hot], n)]
        ids = texts.ids[self.doc]
        own = string_hashes(texts.bytes, self.first, texts.length) if len(self.first) else np.zeros(0, _U)
        key = context_hashes(texts.bytes, self.first, self.last, own, texts.length)
        self.of, self.place = equal_contexts(texts.bytes, self.first, self.last, key, texts.length)
        self.least = np.full(len(self.place), NULL_ID, np.int64)
        np.minimum.at(self.least, self.of, ids)
        shard = (codes >> _U(32)).astype(np.int64)[inverse[plain]] if len(plain) else np.zeros(0, np.int64)
        self.target = np.r_[shard, (own[len(plain) :] % _U(shards)).astype(np.int64)][self.place]
        self.strings = (self.last - self.first + 1)[self.place]
        self.order = np.argsort(self.target, kind="stable")

    def by_shard(self) -> Iterator[tuple[int, np.ndarray]]:
        own = self.target[self.order]
        if not len(own):
            return
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for s, e in zip(cuts, [*cuts[1:], len(own)], strict=True):
            yield int(own[s]), self.order[s:e]


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def suffix_array(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts places by the string of `length` bytes that begins there: their order, and of each in it whether its string is another than the one
    before. Of equal strings, which a hash proposes and a comparison confirms, one is sorted."""
    _, lead, inverse = np.unique(string_hashes(data, at, length), return_index=True, return_inverse=True)
    if any((words_at(data, at + k) != words_at(data, at[lead][inverse] + k)).any() for k in _offsets(length)):
        lead = inverse = np.arange(len(at))
    rank = ranks(data, at[lead], length)[inverse]
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    return order, np.r_[True, ranked[1:] != ranked[:-1]][: len(order)]


def ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of the string at each place, how many are smaller. Sorted by eight bytes, then ties by the next eight, and so on."""
    rank = np.zeros(len(at), np.int64)
    tied = np.arange(len(at))
    for k in _offsets(length):
        if len(tied) < 2:
            break
        word, own = words_at(data, at[tied] + k), rank[tied]
        order = np.lexsort((word, own)) if k else np.argsort(word, kind="stable")
        word, own, place = word[order], own[order], np.arange(len(tied))
        apart = np.r_[True, own[1:] != own[:-1]]
        new = apart.copy()
        new[1:] |= word[1:] != word[:-1]
        rank[tied[order]] = own + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(apart, place, 0))
        lonely = new & np.r_[new[1:], True]
        tied = tied[order][~lonely]
    return rank


class Family:
    """The levels of one shard, each a text, the sorted places of its distinct strings, and the smallest id that holds each. Portions come in the
    order of ids."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def strings(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """All have the full length, so nothing hangs on the padding of this type."""
        return np.ndarray((max(0, len(data) - self.length + 1),), f"S{self.length}", data, 0, (1,))[at]

    def _matches(self, wanted: np.ndarray, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two sorted runs, scanned side by side, a block of the level at a time: which of the wanted strings stand in the level, and where."""
        hits, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low = 0
        for s in range(0, len(places), BLOCK):
            held = self.strings(data, places[s : s + BLOCK])
            high = int(np.searchsorted(wanted, held[-1], side="right"))
            if high > low:
                at = np.searchsorted(held, wanted[low:high])
                hit = np.flatnonzero(held[at] == wanted[low:high])
                hits.append(low + hit)
                where.append(s + at[hit])
            low = high
        return np.concatenate(hits), np.concatenate(where)

    def _merged(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """One level of two: each string of the smaller finds its place among the larger's."""
        (x, p, i), (y, q, j) = a, b
        at = np.zeros(len(q), np.int64)
        wanted, low = self.strings(y, q), 0
        for s in range(0, len(p), BLOCK):
            held = self.strings(x, p[s : s + BLOCK])
            high = int(np.searchsorted(wanted, held[-1])) if s + BLOCK < len(p) else len(wanted)
            at[low:high] = s + np.searchsorted(held, wanted[low:high])
            low = high
        return np.concatenate([x, y]), np.insert(p, at, q + len(x)), np.insert(i, at, j)

    def scan(self, data: np.ndarray, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether the string at each place has a holder with a smaller id, among the levels or in the portion itself; then it is taken in."""
        order, new = suffix_array(data, places, self.length)
        distinct, group = places[order[new]], np.cumsum(new) - 1
        least = np.full(len(distinct), NULL_ID, np.int64)
        np.minimum.at(least, group, ids[order])
        known = np.zeros(len(distinct), bool)
        wanted = self.strings(data, distinct)
        for text, held, holder in self.levels:
            hit, where = self._matches(wanted, text, held)
            least[hit] = np.minimum(least[hit], holder[where])
            known[hit] = True
        out = np.empty(len(places), bool)
        out[order] = least[group] < ids[order]
        if not known.all():
            self.levels.append((data, distinct[~known], least[~known]))
            while len(self.levels) > 1 and len(self.levels[-2][1]) <= 2 * len(self.levels[-1][1]):
                b, a = self.levels.pop(), self.levels.pop()
                self.levels.append(self._merged(a, b))
        return out


def repeated(data: np.ndarray, begin: np.ndarray, strings: np.ndarray, length: int) -> np.ndarray:
    """Of the strings of all contexts, one after the other, whether another one has the same hash. The others stand once, so nobody else holds them."""
    ends = np.cumsum(strings)
    total = int(ends[-1]) if len(ends) else 0
    low = _U((1 << total.bit_length()) - 1)
    h = np.empty(total, _U)
    s = 0
    while s < len(strings):
        a = int(ends[s] - strings[s])
        e = max(s + 1, int(np.searchsorted(ends, a + PORTION, side="right")))
        h[a : int(ends[e - 1])] = string_hashes(data, spans(begin[s:e], strings[s:e]), length)
        s = e
    # The low bits tell which string it is, so that one sort of plain numbers does.
    h &= ~low
    h |= np.arange(total, dtype=_U)
    h.sort()
    like = (h[1:] ^ h[:-1]) <= low
    h &= low
    out = np.zeros(total, bool)
    for own in (h[1:], h[:-1]):
        out[own[like].astype(np.int64)] = True
    return out


def earlier_holders(data: np.ndarray, strings: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """data: contexts, one after the other; strings: how many each has. Of each context a mask: bit i is set if its i-th string stands in a
    context with a smaller id. Equal contexts are looked at once, and of those the strings that stand in more than one."""
    first = np.cumsum(strings + length - 1) - (strings + length - 1)
    last = first + strings - 1
    key = context_hashes(data, first, last, string_hashes(data, first, length), length)
    of, place = equal_contexts(data, first, last, key, length)
    least = np.full(len(place), NULL_ID, np.int64)
    np.minimum.at(least, of, ids)
    place = place[order := np.argsort(least, kind="stable")]
    out = np.zeros(len(order), _U)
    out[order] = _earlier(data, first[place], strings[place], least[order], length)
    out = out[of]
    out[ids > least[of]] = ~_U(0)
    return out


def _earlier(data: np.ndarray, begin: np.ndarray, strings: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """earlier_holders of different contexts in the order of ids, which begin at `begin`."""
    out = np.zeros(len(ids), _U)
    flags = repeated(data, begin, strings, length)
    ends = np.cumsum(strings)
    total = np.r_[0, np.cumsum(flags)][ends]  # strings to look at, up to the end of each context
    family = Family(length)
    s = 0
    while s < len(ids):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + PORTION, side="right")))
        flag = flags[int(ends[s] - strings[s]) : int(ends[e - 1])]
        if flag.any():
            n = strings[s:e]
            part = np.repeat(np.arange(s, e), n)[flag]
            bit = spans(np.zeros(e - s, np.int64), n)[flag]
            used, own = np.unique(part, return_inverse=True)
            size = strings[used] + length - 1
            earlier = family.scan(data[spans(begin[used], size)], (np.cumsum(size) - size)[own] + bit, ids[part])
            # Bits of one context are distinct, so they add up to its mask.
            np.add.at(out, part[earlier], _U(1) << bit[earlier].astype(_U))
        s = e
    return out


# --- the three rounds ---


def _sorted_texts(t: pa.Table, length: int) -> tuple[Texts, pa.Table]:
    return Texts(t.column("doc_id").to_pylist(), t.column("text").cast(pa.binary()).to_pylist(), length), t


def _thrifty(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """f, before which memory is given back: what the group before it took is free then."""
    if len(inspect.signature(f).parameters) == 1:

        def one(t: pa.Table) -> pa.Table:
            give_back()
            return f(t)

        return one

    def two(t: pa.Table, r: pa.Table) -> pa.Table:
        give_back()
        return f(t, r)

    return two


def _blobs(batch: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array([s for s, _ in rows], pa.int32()), "batch": pa.array([batch] * len(rows), pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})


def _ask_grams(length: int, shards: int):
    def run(t: pa.Table) -> pa.Table:
        batch = t.column("batch")[0].as_py()
        texts, _ = _sorted_texts(t, length)
        codes, inverse = texts.grams(shards)
        rows = []
        if len(codes):
            runs = np.bincount(inverse, minlength=len(codes))
            ids = texts.ids[texts.doc]
            low, high = np.full(len(codes), NULL_ID), np.full(len(codes), -NULL_ID)
            np.minimum.at(low, inverse, ids)
            np.maximum.at(high, inverse, ids)
            note = (np.minimum(runs, 32767) << 1 | (low != high)).astype("<u2")
            shard = (codes >> _U(32)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            for s, e in zip(cuts, np.r_[cuts[1:], len(codes)], strict=True):
                rows.append((int(shard[s]), (codes[s:e] & _U(0xFFFFFFFF)).astype("<u4").tobytes() + note[s:e].tobytes()))
        return _blobs(batch, rows)

    return _thrifty(run)


def _answer_grams(hot: int):
    def run(t: pa.Table) -> pa.Table:
        batches, data = t.column("batch").to_pylist(), t.column("data").to_pylist()
        sizes = [len(d) // 6 for d in data]
        codes = np.concatenate([np.frombuffer(d, "<u4", n) for d, n in zip(data, sizes, strict=True)])
        notes = np.concatenate([np.frombuffer(d, "<u2", n, 4 * n) for d, n in zip(data, sizes, strict=True)])
        distinct, inverse = np.unique(codes, return_inverse=True)
        holders = np.bincount(inverse) + np.bincount(inverse, weights=notes & 1)
        runs = np.bincount(inverse, weights=notes >> 1)
        flags = ((holders > 1) * 1 | (runs > hot) * 2).astype(np.uint8)[inverse]
        ends = np.cumsum(sizes)
        return pa.table({
            "shard": t.column("shard").cast(pa.int32()), "batch": pa.array(batches, pa.int32()), "kind": pa.array([0] * len(data), pa.int32()),
            "data": pa.array([flags[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary()),
        })

    return run


def _answers(r: pa.Table, kind: int, dtype: str) -> np.ndarray:
    rows = sorted((s, d) for s, k, d in zip(r.column("shard").to_pylist(), r.column("kind").to_pylist(), r.column("data").to_pylist(), strict=True) if k == kind)
    return np.concatenate([np.frombuffer(d, dtype) for _, d in rows]) if rows else np.zeros(0, dtype)


def _ask_contexts(length: int, shards: int):
    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _blobs(0, [])
        texts, _ = _sorted_texts(t, length)
        c = Contexts(texts, _answers(r, 0, "u1"), shards)
        rows = []
        for shard, at in c.by_shard():
            begin, n = c.first[c.place[at]], c.strings[at]
            rows.append((shard, np.array([len(at)], "<u4").tobytes() + c.least[at].astype("<i8").tobytes() + n.astype("u1").tobytes() + texts.bytes[spans(begin, n + length - 1)].tobytes()))
        return _blobs(t.column("batch")[0].as_py(), rows)

    return _thrifty(run)


def _answer_contexts(length: int):
    def run(t: pa.Table) -> pa.Table:
        ids, strings, texts, sizes = [], [], [], []
        for d in t.column("data").to_pylist():
            n = int(np.frombuffer(d, "<u4", 1)[0])
            ids.append(np.frombuffer(d, "<i8", n, 4))
            strings.append(np.frombuffer(d, "u1", n, 4 + 8 * n).astype(np.int64))
            texts.append(np.frombuffer(d, np.uint8, offset=4 + 9 * n))
            sizes.append(n)
        masks = earlier_holders(np.concatenate(texts), np.concatenate(strings), np.concatenate(ids), length)
        ends = np.cumsum(sizes)
        return pa.table({
            "shard": t.column("shard").cast(pa.int32()), "batch": t.column("batch").cast(pa.int32()), "kind": pa.array([1] * len(sizes), pa.int32()),
            "data": pa.array([masks[e - n : e].astype("<u8").tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary()),
        })

    return _thrifty(run)


def _remove(length: int, shards: int, names: list[str], as_text: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        texts, t = _sorted_texts(t, length)
        c = Contexts(texts, _answers(r, 0, "u1"), shards)
        masks = np.zeros(len(c.place), _U)
        masks[c.order] = _answers(r, 1, "<u8")
        own = masks[c.of] if len(c.of) else np.zeros(0, _U)
        own[texts.ids[c.doc] > c.least[c.of]] = ~_U(0)
        covered = np.zeros(len(texts.bytes), np.uint8)
        for bit in range(length - GRAM + 1):
            at = c.first + bit
            covered[at[(at <= c.last) & ((own >> _U(bit)) & _U(1)).astype(bool)]] = 1
        # Each mark goes on over the string that begins there: by 1, 2, 4, ... places, and by what is left.
        width = 1
        while width < length:
            step = min(width, length - width)
            covered[step:] |= covered[:-step].copy()
            width += step
        covered = covered.astype(bool)
        kept, cuts = [], []
        k = 0
        for i, size in enumerate(texts.sizes):
            if k + 1 < len(texts.owner) and texts.owner[k + 1] == i:
                cover, data = np.zeros(size, bool), np.zeros(size, np.uint8)
            else:
                cover = data = None
            while k < len(texts.owner) and texts.owner[k] == i:
                a, b, base = int(texts.start[k]), int(texts.start[k + 1]), texts.base[k]
                if cover is None:
                    cover, data = covered[a:b], texts.bytes[a:b]
                else:
                    cover[base : base + b - a] |= covered[a:b]
                    data[base : base + b - a] = texts.bytes[a:b]
                k += 1
            if cover.any():
                kept.append(data[~cover].tobytes())
                edge = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(np.int8)))
                cuts.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            else:
                kept.append(data.tobytes())
                cuts.append([])
        columns = {"doc_id": t.column("doc_id"), "n_bytes": pa.array(texts.sizes, pa.int64()), "spans": pa.array(cuts, spans_type)}
        # As text: what is left of a character that was cut apart is dropped.
        columns["kept"] = pa.array([b.decode("utf-8", "ignore") for b in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        return pa.table(columns | {n: t.column(n) for n in names})

    return _thrifty(run)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, batch_bytes: int = 8 << 20, hot: int = 4096, carry: bool = False, most_batches: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end of what was removed, in bytes), kept (the bytes that stay); with carry, kept is
    text, and df's other columns follow as c0, c1, ... in their order. One row for each row of df."""
    if not GRAM < length <= 64 + GRAM - 1:
        raise ValueError("length must be over 16 and below 80")
    spark = df.sparkSession
    small_batches(spark)
    total = df.agg(F.sum(F.octet_length(df[text_col]) + 64)).first()[0] or 0
    batches = max(1, min(most_batches, -(-total // batch_bytes)))
    shards = batches
    labels = batch_labels(spark, batches)
    others = [c for c in df.columns if c not in (id_col, text_col)] if carry else []
    names = [f"c{k}" for k in range(len(others))]
    slot = F.pmod(F.xxhash64(df[id_col], df[text_col], F.spark_partition_id()), F.lit(batches)).cast("int")
    rows = df.select(F.get(F.lit(labels), slot).alias("batch"), df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"), *[df[c].alias(n) for c, n in zip(others, names, strict=True)])
    name = scratch_table(spark, "suffix_batches")
    # Rows lie in the order of ids in their batch.
    rows.repartition(batches, "batch").write.option("compression", "zstd").bucketBy(batches, "batch").format("parquet").saveAsTable(name)
    t = spark.table(name)
    narrow = t.select("batch", "doc_id", "text").groupBy("batch")
    asked = narrow.applyInArrow(_ask_grams(length, shards), "shard int, batch int, data binary")
    grams = written(asked.groupBy("shard").applyInArrow(_answer_grams(hot), "shard int, batch int, kind int, data binary"), "suffix-grams")
    asked = narrow.cogroup(grams.groupBy("batch")).applyInArrow(_ask_contexts(length, shards), "shard int, batch int, data binary")
    masks = written(asked.groupBy("shard").applyInArrow(_answer_contexts(length), "shard int, batch int, kind int, data binary"), "suffix-masks")
    schema = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "string" if carry else "binary")
    for c, n in zip(others, names, strict=True):
        schema = schema.add(n, df.schema[c].dataType)
    return t.groupBy("batch").cogroup(grams.unionByName(masks).groupBy("batch")).applyInArrow(_remove(length, shards, names, carry), schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(df).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with what stays of its texts; a character that was cut apart goes as a whole. length_col gets the new number of characters."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    out = remove_repeats(df, id_col, text_col, carry=True)
    columns = {id_col: F.col("doc_id").cast(df.schema[id_col].dataType), text_col: F.col("kept")} | {c: F.col(f"c{k}") for k, c in enumerate(others)}
    out = out.select(*[columns[c].alias(c) for c in df.columns])
    if length_col in df.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType))
    return out


#: Texts as hexadecimal, two digits a byte; all strings of 50 bytes, spelled out.
ORACLE_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
x AS (SELECT w.doc_id, p, p - lag(p) OVER (PARTITION BY w.doc_id ORDER BY p) AS gap FROM w JOIN m USING (s) WHERE least < w.doc_id),
y AS (SELECT doc_id, p, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM x),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM y GROUP BY doc_id, k),
g AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM r),
c AS (SELECT g.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) AS head, max(b) AS tail, sum(b - a) AS gone, count(*) AS spans
  FROM g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
