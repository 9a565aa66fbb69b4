"""URL filters by a Bloom filter cascade, with DataFrame functions only.

Listed keys are put into a Bloom filter; the keys of the corpus that are not listed but pass it go into a second filter; the
listed keys that pass that one into a third, and so on until no key is told wrongly. The corpus's complete universe of keys is
known when the cascade is built, so a walk down its levels answers membership exactly for every key of the corpus, and no url
is joined with anything.

A url's keys are every suffix of its host with every prefix of its path that has the length of some listed rule's path. The
longest listed key is its rule. Without a rule, the method's own verdict is "block" if a suffix of the host is a listed host.

The filters stand in the plan as literals. `max_bits` bounds each level (2^23 bits, 1 MiB; some 800,000 listed keys); a longer
list raises ValueError before anything is read.

Edge cases: a null url, and one without "://", has an empty host and path, no rule and the verdict "allow". Repeated rows are
judged alike. An empty table gives an empty result. Only the two named columns are read, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Hosts that the method itself blocks, with all their subdomains.
BLOCKED_HOSTS = tuple(
    f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")
)
BITS_PER_KEY, HASHES, MOST_LEVELS = 12, 4, 24


@dataclass
class Cascade:
    """Levels of (bits, words of 64 bits). Odd levels (from 0: the first, third, ...) hold listed keys."""

    levels: list[tuple[int, list[int]]] = field(default_factory=list)

    def holds(self, key: Column) -> Column:
        """Whether the key is listed; exact for the universe that the cascade was built over."""
        if not self.levels:
            return F.lit(False)
        # Below the last level nothing is told wrongly: passing it confirms what the level holds.
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            # Failing an even level: not listed. Failing an odd one: not a false positive, so listed.
            out = F.when(~_passes(key, *self.levels[depth], depth), F.lit(depth % 2 == 1)).otherwise(out)
        return out


def _slot(key: Column, bits: int, depth: int, h: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(depth * HASHES + h)), F.lit(bits))


def _passes(key: Column, bits: int, words: list[int], depth: int) -> Column:
    held = F.array(*[F.lit(w).cast("long") for w in words]) if len(words) == 1 else F.lit(words).cast("array<bigint>")
    out = None
    for h in range(HASHES):
        at = _slot(key, bits, depth, h)
        bit = F.get(held, F.shiftright(at, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))) != 0
        out = bit if out is None else out & bit
    return out


def _bloom(keys: DataFrame, n: int, depth: int, max_bits: int) -> tuple[int, list[int]]:
    bits = 64
    while bits < n * BITS_PER_KEY:
        bits *= 2
    if bits > max_bits:
        raise ValueError(f"{n} keys need {bits} bits on level {depth}; max_bits is {max_bits}")
    at = keys.select(F.explode(F.array(*[_slot(F.col("key"), bits, depth, h) for h in range(HASHES)])).alias("at"))
    rows = (
        at.groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
        .collect()  # bits / 64 rows at most
    )
    words = [0] * (bits // 64)
    for word, value in rows:
        words[word] = value
    return bits, words


def cascade(spark: SparkSession, listed: Sequence[str], universe: DataFrame, max_bits: int = 1 << 23) -> Cascade:
    """universe: one column `key` with the corpus's distinct keys; listed keys outside it may be left out, but needn't be."""
    out = Cascade()
    if not listed:
        return out
    if len(listed) * BITS_PER_KEY > max_bits:
        raise ValueError(f"{len(listed)} listed keys; max_bits is {max_bits}")
    yes = spark.range(1).select(F.explode(F.lit(sorted(set(listed)))).alias("key"))
    no = universe.where(F.col("key").isNotNull()).join(F.broadcast(yes), "key", "left_anti")  # as small as the list, so checked above
    inside, outside, n = yes, no, len(set(listed))
    while n:
        depth = len(out.levels)
        if depth == MOST_LEVELS:
            raise RuntimeError("the cascade does not converge")
        level = _bloom(inside, n, depth, max_bits)
        out.levels.append(level)
        # What passes although it must not is what the next level holds.
        wrong = outside.where(_passes(F.col("key"), *level, depth))
        inside, outside = wrong, inside
        n = inside.count()
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))


def url_verdicts(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    blocked: Sequence[str] = BLOCKED_HOSTS,
    max_bits: int = 1 << 23,
) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of df."""
    spark = df.sparkSession
    host, path = parts(df[url_col])
    split = df.select(df[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, p, _ in rules})
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    suffixes = _suffixes(F.col("host"))
    # Every pair of suffix and prefix; a newline stands between, which keeps ("a", "b/") apart from ("ab", "/").
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))
    seen = split.select("host", "path").distinct()
    universe = written(
        seen.select(F.explode(keys).alias("key"), F.lit("rule").alias("kind"))
        .unionByName(seen.select(F.explode(suffixes).alias("key"), F.lit("host").alias("kind")))
        .distinct(),
        "url-keys",
    )
    by_rule = cascade(spark, [f"{h}\n{p}" for h, p, _ in rules], universe.where("kind = 'rule'").select("key"), max_bits)
    by_host = cascade(spark, list(blocked), universe.where("kind = 'host'").select("key"), max_bits)
    hits = F.filter(keys, by_rule.holds)
    # The longest; of equally long ones, which can't both fit a url, the first in order.
    longest = F.array_sort(F.transform(hits, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))
    verdict = F.lit(None).cast("string")
    for h, p, v in rules:
        verdict = F.when(F.col("rule_key") == f"{h}\n{p}", F.lit(v)).otherwise(verdict)
    judged = split.withColumn("rule_key", F.get(longest, F.lit(0))["key"])
    own = F.when(F.exists(suffixes, by_host.holds), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.replace("rule_key", F.lit("\n"), F.lit("")).alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] = BLOCKED_HOSTS) -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    hosts = ", ".join(f"('{h}')" for h in blocked)
    return rf"""
WITH r(h, p, v) AS (VALUES {listed}), b(h) AS (VALUES {hosts}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT s.*, (SELECT arg_max(struct_pack(rule := r.h || r.p, v := r.v), length(r.h || r.p)) FROM r
                   WHERE (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p)) AS hit,
             EXISTS (SELECT 1 FROM b WHERE s.host = b.h OR ends_with(s.host, '.' || b.h)) AS listed FROM s)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""
