"""Exact dedup by two-pass Bloom filtering.

Pass one counts, in a counting Bloom filter whose counters stop at two, the hashes of the normalised texts.
Pass two lets every row through whose counters are not all two: its text is certainly unique. Only the other rows,
possible repeats, are shuffled and grouped by their full SHA-256; what the filter wrongly held is told apart there, so the
result is exact whatever the filter's size.

The filter is broadcast. It has `slots_per_row` slots a row and never more than `max_slots` (2^28: 32 MiB as bits). With more rows than
that, the hashes are cut into ranges, each of which is counted and tagged with a filter of its own, one after the other, so that single
rows pass straight through at any size.

Dropping repeats from whole rows takes the same passes over the hashes; then a filter of the repeated hashes alone tells which whole rows may
have to go. Those are reduced to one a text, before and after a shuffle; all others stay where they lie.

Edge cases: null text counts as empty; all empty texts are equal to each other. A null doc_id comes after all others in ties.
Rows that repeat a doc_id count as rows of their own; in `exact_groups` those with the same text are kept or not together, and in
`drop_exact_duplicates` one row of them stays, which of them if they tie is open. An empty table gives an empty result. Columns other than
the two named are carried whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import written

#: Deleted before texts are compared.
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def n_chars(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def tagged_hashes(df: DataFrame, id_col: str, text_col: str, slots_per_row: int, max_slots: int) -> DataFrame:
    """doc_id, n_chars, sha, maybe: false if the row's text is certainly unique. A row for each row of df."""
    rows = written(df.select(df[id_col].cast("long").alias("doc_id"), n_chars(df[text_col]).alias("n_chars"), digest(df[text_col]).alias("sha")), "exact-hashes")
    n = rows.count()
    ranges = max(1, -(-n * slots_per_row // max_slots))
    tagged = []
    for k in range(ranges):
        own = rows if ranges == 1 else rows.where(F.pmod(F.xxhash64("sha"), F.lit(ranges)) == k)
        twice = bloom.build(own.select("sha"), -(-n // ranges), 2, slots_per_row, max_slots)
        tagged.append(written(own.withColumn("maybe", twice.passes(F.col("sha"))), "exact-tagged"))
    return reduce(DataFrame.unionByName, tagged)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = bloom.SLOTS_PER_ROW, max_slots: int = bloom.MAX_SLOTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of df. The longest original text stays, then the smallest id."""
    tagged = tagged_hashes(df, id_col, text_col, slots_per_row, max_slots)
    alone = tagged.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    repeats = tagged.where("maybe").select("doc_id", "n_chars", "sha")
    # ~doc_id turns "smallest id" into "largest", without the overflow of a sign change; a null id sorts below all.
    groups = repeats.groupBy("sha").agg(
        F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("inv"))).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    groups = groups.select("sha", F.bitwise_not("best.inv").alias("keep_id"), "group_size")
    # A sort-merge join, so that a hash with a large part of all rows is split at run time.
    held_rows = repeats.select("doc_id", "sha").join(groups.hint("merge"), "sha").select("doc_id", "keep_id", "group_size", "sha")
    return alone.unionByName(held_rows).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = bloom.SLOTS_PER_ROW, max_slots: int = bloom.MAX_SLOTS) -> DataFrame:
    """The rows of df that stay, with all their columns: one for each text."""
    tagged = tagged_hashes(df, id_col, text_col, slots_per_row, max_slots)
    repeated = written(tagged.where("maybe").groupBy("sha").count().where(F.col("count") > 1).select("sha"), "exact-repeated")
    known = bloom.build(repeated, repeated.count(), 1, slots_per_row, max_slots)
    row = F.struct(*[df[c].alias(f"c{k}") for k, c in enumerate(df.columns)])
    rows = df.select(row.alias("row"), digest(df[text_col]).alias("sha"), n_chars(df[text_col]).alias("n_chars"), F.bitwise_not(df[id_col].cast("long")).alias("inv"))
    rows = rows.withColumn("maybe", known.passes(F.col("sha")))
    # Of a text that a third of all rows hold, each task hands on one row.
    best = rows.where("maybe").groupBy("sha").agg(F.max_by("row", F.struct("n_chars", "inv")).alias("row"))
    return rows.where(~F.col("maybe")).select("row").unionByName(best.select("row")).select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(df.columns)])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       text_sha256
FROM d
"""
