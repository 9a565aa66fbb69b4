"""Best-fit packing of tokenised documents into sequences, by bin completion.

Documents longer than a sequence are cut into whole sequences and a rest; what is packed are the pieces. Packing only needs how
many pieces there are of each length, at most `capacity` numbers, so the search runs on the driver over counts whatever the number
of documents:

* best fit, longest first, gives the first incumbent;
* the waste bound (all tokens, and the pieces too long to share) gives a number of sequences that no packing can beat;
* while the incumbent is above the bound, branch and bound takes the longest piece left, enumerates the fillings beside it that
  no other filling dominates, fullest first, and cuts branches whose bound reaches the incumbent. A filling is used as often as the
  counts allow, or once; on inputs of few lengths this is the whole tree, so the packing is optimal. On others a budget of `work` ends
  the search with the best incumbent: a node costs as much as there are lengths, a step of the enumeration one, and no node may spend more
  than a fiftieth of the budget on its enumeration.

The plan is a list of (filling, how often), bounded by the number of lengths. Each piece gets its rank among the pieces of its
length and reads its sequence and offset from the plan. Ranks inside a partition are dealt when it is tokenised; where the ranks of a partition
begin comes from counts by partition and length. The pieces are a table that is bucketed by partition as they lie, so they are joined with
these without a shuffle, and no length is ever gathered in one task.

Special tokens' strings in a text are those tokens, as the library has it. Edge cases: null and empty texts have the closing id only.
Rows that repeat a doc_id are packed one by one. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LONGEST, ChunkMemo, batch_labels, char_class, library_memo, partitions, scratch_table, small_batches, thrifty, written

#: The budget of the search; buckets that a table can have.
WORK, MOST_BUCKETS = 200_000, 100_000
# Letters and signs below U+0250 whose composition is plain and whose lower case is one character: the tokenizer's own
# split is spelled out for texts of these, so that a word costs a lookup whatever punctuation it touches.
_PLAIN = [c for c in map(chr, range(0x250)) if len(c.lower()) == 1 and ord(c.lower()) < 0x250 and unicodedata.is_normalized("NFC", c)]
_LETTER = char_class(lambda c: unicodedata.category(c)[0] == "L")
_NUMBER = char_class(lambda c: unicodedata.category(c)[0] == "N")
_SPACE = "\t-\r \x85\xa0"
OTHERS = re.compile(f"[^{''.join(map(re.escape, _PLAIN))}]")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


# Signs that stand for themselves; not the apostrophe, which may begin a word of its own.
_SIGNS = "\\x00-\\x08\\x0e-\\x1f!-&(-/:-@\\[-`{-\\x7f"
#: A text with one of these is cut at white space only.
_UNSURE = "'|[^\\x00-\\x7fÀ-ÖØ-öø-ÿ]"


def token_ids(texts: pa.Array, memo: ChunkMemo) -> list[bytes]:
    """The ids of each text, little-endian 32-bit. Words are cut and told apart in Arrow; only distinct ones are looked up. Texts that hold the
    string of a special token are left to the library as they are."""
    tokenizer = memo.pieces.tokenizer
    special = "|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values())
    if special and pc.any(held := pc.fill_null(pc.match_substring_regex(texts, special), False)).as_py():
        plain = iter(token_ids(texts.filter(pc.invert(held)), memo))
        whole = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(texts[i].as_py()) if h else next(plain) for i, h in enumerate(held.to_pylist())]
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    spaced = pc.replace_substring_regex(low, pattern=f"([{_SIGNS}]+)", replacement=r" \1 ")
    words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(low, _UNSURE), low, spaced))
    coded = words.flatten().dictionary_encode()
    blobs = memo.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    pool, begin = np.frombuffer(b"".join(blobs), "<u4"), np.r_[0, np.cumsum(sizes)]
    word = coded.indices.to_numpy(zero_copy_only=False)
    n = sizes[word]
    ends = np.r_[0, np.cumsum(n)]
    ids = pool[np.repeat(begin[word] - ends[:-1], n) + np.arange(ends[-1])]
    edges = ends[np.asarray(words.offsets) - words.offsets[0].as_py()].tolist()
    return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def cut_chunk(chunk: str) -> list[str]:
    """Pieces that the tokenizer encodes independently."""
    return [chunk] if OTHERS.search(chunk) else WORDS.findall(chunk.lower())


#: Bytes as the tokenizer spells them: printable Latin-1 as it is, the others from U+0100 on; for str.translate.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLED = dict(zip([*_SHOWN, *sorted(set(range(256)) - set(_SHOWN))], map(chr, [*_SHOWN, *range(0x100, 0x144)]), strict=True))
_SPELL = {ord(c): "".join(_SPELLED[b] for b in c.lower().encode()) for c in _PLAIN if unicodedata.category(c)[0] == "L"}
_WORD = re.compile(f"[{''.join(map(chr, _SPELL))}]+")


class WordMemo(ChunkMemo):
    """A ChunkMemo that hands new chunks which are a word of plain letters to the merges directly: what the tokenizer does before them is lower case and
    the spelling of bytes, which is done for all words at once. A word ends with a token that says so."""

    def __init__(self, description: str):
        super().__init__(library_memo(description, ordinary=False), cut_chunk, " ")
        self.merges = self.last = None
        told = json.loads(description)
        spelled = "ByteLevel" in json.dumps(told.get("pre_tokenizer"))
        if spelled and told["model"].get("type") == "BPE" and (suffix := told["model"].get("end_of_word_suffix")):
            from tokenizers import Tokenizer

            bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
            self.merges = Tokenizer.from_str(json.dumps(told | bare))
            vocabulary = told["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def words(self, words: list[str]) -> list[bytes | None]:
        """The ids of words of plain letters; None where they can't be told apart."""
        out: list[bytes | None] = []
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            e = self.merges.encode_batch_fast([" ".join(part).translate(_SPELL)], add_special_tokens=False)[0]
            ids = np.array(e.ids, "<u4")
            cuts = [0, *((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()]
            data = ids.tobytes()
            told = len(cuts) == len(part) + 1 and cuts[-1] == len(data)
            out += [data[a:b] for a, b in itertools.pairwise(cuts)] if told else [None] * len(part)
        return out

    def of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        if self.size > self.most // 2:
            self.before = dict(self)  # nothing long is kept
            self.clear()
            self.size = 0
        out = list(map(self.get, chunks))
        missing = [k for k, ids in enumerate(out) if ids is None]
        words, others = [], []
        for k in missing:
            out[k] = self.before.get(chunks[k])
            if out[k] is None:
                (words if self.merges is not None and _WORD.fullmatch(chunks[k]) else others).append(k)
        for k, ids in zip(words, self.words([chunks[k] for k in words]), strict=True):
            out[k] = ids
            if ids is None:
                others.append(k)
        for k, ids in zip(others, self.pieces.joined([self.cut(chunks[k]) for k in others], self.joiner), strict=True):
            out[k] = ids
        for k in missing:
            if len(chunks[k]) <= LONGEST:
                self.keep(chunks[k], out[k])
        return out


_MEMOS: dict[str, WordMemo] = {}


def word_memo(description: str) -> WordMemo:
    """One a worker process."""
    if description not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[description] = WordMemo(description)
    return _MEMOS[description]


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, rank (among its partition's pieces of this length), ids_crc32 and, on demand, ids (little-endian 32-bit)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())  # of the vocabulary's size
    end = int(end_id).to_bytes(4, "little")
    step = capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(held.value)
        names = ["doc_id", "piece", "start", "length", "rank", "ids_crc32", *["ids"] * with_ids]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
        given = [0] * (capacity + 1)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                part = b.slice(at, 256)
                for doc, ids in zip(part.column(0).to_pylist(), token_ids(part.column(1), memo), strict=True):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), step)):
                        cut = ids[s : s + step]
                        n = len(cut) // 4
                        rows.append((doc, k, s // 4, n, given[n], zlib.crc32(cut), *[cut] * with_ids))
                        given[n] += 1
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, rank long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(thrifty(run), schema)


# --- the search over counts ---

Filling = tuple[int, ...]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing needs fewer sequences: for each threshold t, pieces over capacity - t can't share with those of t or more,
    and what the longer ones leave free takes what it can of the rest."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    if not len(lengths):
        return 0
    n = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    # Sums over the lengths from each place on.
    number, tokens = (np.r_[np.cumsum(v[::-1])[::-1], 0] for v in (n, n * lengths))
    half = int(np.searchsorted(lengths, capacity // 2, side="right"))
    t = np.arange(half)
    alone = np.maximum(np.searchsorted(lengths, capacity - lengths[t], side="right"), half)
    mid = number[half] - number[alone]
    free = capacity * mid - (tokens[half] - tokens[alone])
    over = np.maximum(0, -(-(tokens[t] - tokens[half] - free) // capacity))
    return int(max([-(-int(tokens[0]) // capacity), int(number[half]), *(number[alone] + mid + over)]))


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Filling]:
    """Best fit, longest first, over counts: equal fillings are opened and completed together."""
    out: Counter[Filling] = Counter()
    open_: dict[int, Counter[Filling]] = {}  # room left -> fillings
    rooms: list[int] = []  # sorted keys of open_

    def put(room: int, filling: Filling, n: int):
        if room == 0:
            out[filling] += n
            return
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = Counter()
        open_[room][filling] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                # New sequences take as many of this length as fit: best fit would fill the newest one first.
                if full := left // per:
                    put(capacity - per * length, (length,) * per, full)
                if rest := left % per:
                    put(capacity - rest * length, (length,) * rest, 1)
                left = 0
                break
            room = rooms[at]
            filling, n = open_[room].popitem()
            use = min(n, left)
            if n > use:
                open_[room][filling] = n - use
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            put(room - length, (*filling, length), use)
            left -= use
    for fillings in open_.values():
        out.update(fillings)
    return out


def fillings(lengths: list[int], counts: dict[int, int], room: int, limit: int) -> tuple[list[Filling], int]:
    """Undominated sets of lengths (longest first) for the room, fullest first, and the steps that it took. A set is dominated if a left-out
    piece fits into the room that stays, or can take the place of a shorter one. The enumeration ends after `limit` steps."""
    found: set[Filling] = set()
    ascending = lengths[::-1]
    steps = 0

    def dominated(chosen: list[int], waste: int) -> bool:
        used = Counter(chosen)
        # Only lengths up to `waste` above a chosen one, or up to it, can dominate.
        for low, high in [(0, waste), *((y, y + waste) for y in used)]:
            for x in ascending[bisect.bisect_right(ascending, low) : bisect.bisect_right(ascending, high)]:
                if counts[x] > used[x]:
                    return True
        return False

    def go(end: int, chosen: list[int], left: int):
        """ascending[:end] may still be chosen from."""
        nonlocal steps
        steps += 1
        end = min(end, bisect.bisect_right(ascending, left))
        if not end:
            if not left or not dominated(chosen, left):
                found.add(tuple(chosen))
            return
        x = ascending[end - 1]
        for k in range(min(counts[x], left // x), -1, -1):
            if steps >= limit:
                return
            go(end - 1, chosen + [x] * k, left - x * k)

    go(len(ascending), [], room)
    return sorted(found, key=lambda f: (-sum(f), [-x for x in f])), steps


@dataclass
class Packing:
    plan: Counter[Filling]
    bound: int
    nodes: int

    @property
    def sequences(self) -> int:
        return sum(self.plan.values())


def pack_counts(counts: dict[int, int], capacity: int, work: int = WORK) -> Packing:
    counts = {x: n for x, n in counts.items() if n > 0}
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    state = {"best": best, "most": sum(best.values()), "nodes": 0, "work": 0}

    def search(left: dict[int, int], made: list[tuple[Filling, int]], used: int):
        if state["most"] == bound or state["work"] >= work:
            return
        state["nodes"] += 1
        state["work"] += len(left) + 1
        if not left:
            if used < state["most"]:
                plan: Counter[Filling] = Counter()
                for f, n in made:
                    plan[f] += n
                state["best"], state["most"] = plan, used
            return
        if used + lower_bound(left, capacity) >= state["most"]:
            return
        # The incumbent may be beaten by completing this node with best fit.
        rest = best_fit(left, capacity)
        if used + sum(rest.values()) < state["most"]:
            plan = Counter(rest)
            for f, n in made:
                plan[f] += n
            state["best"], state["most"] = plan, used + sum(rest.values())
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        lengths = sorted((x for x in others if others[x]), reverse=True)
        found, steps = fillings(lengths, others, capacity - longest, work // 50)
        state["work"] += steps
        for f in found:
            full = (longest, *f)
            need = Counter(full)
            most = min(left[x] // k for x, k in need.items())
            for times in dict.fromkeys((most, 1)):
                after = {x: n - need[x] * times for x, n in left.items() if n > need[x] * times}
                search(after, [*made, (full, times)], used + times)
                if state["most"] == bound or state["work"] >= work:
                    return

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 100_000))
    try:
        search(counts, [], 0)
    finally:
        sys.setrecursionlimit(limit)
    return Packing(state["best"], bound, state["nodes"])


# --- from the plan to places ---


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, plan: Counter[Filling]):
        first = 0
        runs: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (first rank, first sequence, uses in a sequence, offset)
        given: Counter[int] = Counter()
        for filling, times in sorted(plan.items()):
            offset = 0
            for x in filling:
                # One slot of the filling: `times` pieces of this length, a sequence each.
                runs.setdefault(x, []).append((given[x], first, times, offset))
                given[x] += times
                offset += x
            first += times
        self.runs = {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        own = lengths[order]
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
        for s, e in zip(cuts, np.r_[cuts[1:], len(own)], strict=True):
            place = order[s:e]
            starts, first, _, offsets = self.runs[int(own[s])]
            at = np.searchsorted(starts, ranks[place], side="right") - 1
            sequence[place], offset[place] = first[at] + ranks[place] - starts[at], offsets[at]
        return sequence, offset


def best_fit_pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False, work: int = WORK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on demand): one row a piece."""
    spark = df.sparkSession
    small_batches(spark)
    cut = pieces(df, tokenizer_path, id_col, text_col, capacity, end_id, with_ids)
    # A partition is a bucket of its own: each task writes one file, and nothing is moved. With fewer buckets than the session's partitions the planner
    # would move them after all.
    buckets = min(MOST_BUCKETS, max(cut.rdd.getNumPartitions(), partitions(spark)))
    labels = batch_labels(spark, buckets)
    part = F.get(F.lit(labels), F.pmod(F.spark_partition_id(), F.lit(buckets)))
    name = scratch_table(spark, "packing_pieces")
    # The second number tells partitions apart that share a bucket.
    cut.select(part.alias("part"), F.spark_partition_id().alias("task"), "*").write.option("compression", "zstd").bucketBy(buckets, "part").format("parquet").saveAsTable(name)
    cut = spark.table(name)
    by_part = written(cut.groupBy("part", "task", "length").count(), "packing-counts")
    rows = by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()  # `capacity` rows at most
    packing = pack_counts({r.length: r.n for r in rows}, capacity, work)
    held = spark.sparkContext.broadcast(Places(packing.plan))  # bounded by the lengths, not by the pieces
    before = Window.partitionBy("length").orderBy("part", "task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("part", F.struct("task", "length").alias("key"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    # For each bucket: (task, length) -> the rank at which its pieces begin; as many as there are lengths, for each task.
    starts = starts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("key", "first"))).alias("starts"))

    def run(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        sequence, offset = held.value.of(lengths.to_numpy(zero_copy_only=False).astype(np.int64), ranks.to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    placed = cut.join(starts.hint("shuffle_hash"), "part")
    rank = F.element_at("starts", F.struct("task", "length")) + F.col("rank")
    place = F.arrow_udf(run, "sequence_id long, offset long").asNondeterministic()("length", "first")
    names = [c for c in cut.columns if c not in ("part", "task", "rank")]
    # Rows wait for Python on disk, with all that the call's arguments are made of. The explode of one rank keeps the bucket's map out of each row.
    placed = placed.select(*names, F.explode(F.array(rank)).alias("first"))
    return placed.select(*names, place.alias("place")).select(*names, "place.sequence_id", "place.offset")
