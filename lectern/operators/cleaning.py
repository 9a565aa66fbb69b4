"""The rule pipeline over containers, and what it finds.

Input: a DataFrame with one row a container and a column of array<string>, its runs; or one row a book with an array of such containers. The
steps follow one another as column expressions; the only join is the one with the dictionary, and only rows with split words
take part in it. The others go around it, so that their texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text_rules as R

TRIM = R.Rule("sp-trim", "", "spacing", "A")
#: So many split words of all books are looked up at once, and known to every task; with more of them, books meet those of their own by a join.
FEW = 1000


@dataclass(frozen=True)
class Step:
    rule: R.Rule
    before: str
    after: str
    #: SQL of the step's findings in a container, given the container before and after it.
    findings: Callable[[str, str], str]
    #: Level and SQL of their number, given the container before it.
    counts: Callable[[str], list[tuple[str, str]]]


def with_known_words(df: DataFrame, runs: str, keys: list[str], dictionary: DataFrame | None, nested: bool = False, prepared: Callable[[str], str] = lambda c: c) -> DataFrame:
    """df with `known`: which words of the row, split by a hyphen, the dictionary (column word) has when joined. prepared: SQL of a container as it is
    when its words are joined. Nested rows are whole books, which are dear to shuffle: their split words are gathered at once, and where they are few, what the dictionary has of all of
    them is known in every row."""
    none = F.array().cast("array<string>")
    if dictionary is None:
        return df.withColumn("known", none)
    own = [f"__{k}" for k in keys]
    # Told from the text as it comes, so that most rows are looked at once and go on.
    split = F.coalesce(F.expr(f"exists({f'flatten({runs})' if nested else runs}, r -> contains(r, '-') and r rlike {R.literal(R.SPLIT_SOON)} and r rlike {R.literal(R.SPLIT_HINT)})"), F.lit(False))
    some, others = df.where(split), df.where(~split).withColumn("known", none)
    ready = f"flatten(transform({runs}, c -> {prepared('c')}))" if nested else prepared(runs)
    if nested:
        forms = some.select(F.explode(F.expr(R.split_candidates(ready))).alias("word")).distinct().limit(FEW + 1).collect()
        if len(forms) <= FEW:
            there = dictionary.where(F.col("word").isin([r.word for r in forms])).select("word").distinct().collect() if forms else []
            return df.withColumn("known", F.lit(sorted(r.word for r in there)) if there else none)
    words = some.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.explode(F.expr(R.split_candidates(ready))).alias("word"))
    # The planner broadcasts the dictionary if its size allows, and shuffles otherwise; words that many texts share meet it once.
    found = words.distinct().join(dictionary.select("word").distinct(), "word", "left_semi")
    found = found.groupBy(*own).agg(F.collect_set("word").alias("known"))
    on = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    return some.join(found, on, "left").drop(*own).withColumn("known", F.coalesce("known", none)).unionByName(others)


def steps(df: DataFrame, runs: str, keys: list[str], enabled: Collection[str] = R.DEFAULT, dictionary: DataFrame | None = None, nested: bool = False) -> tuple[DataFrame, list[Step]]:
    """df with a column for the text after every step that ran; unused ones cost nothing, as the optimizer drops them. nested: runs is an array
    of containers."""
    done: list[Step] = []
    if "dehyph" in enabled:
        first = [r for r in R.STEPS[: R.STEPS.index(R.BY_ID["dehyph"])] if r.id in enabled]
        df = with_known_words(df, runs, keys, dictionary, nested, lambda c: reduce(lambda x, rule: R.step(rule, x), first, R.trim(c)))

    def put(rule: R.Rule, expression: Callable[[str], str] | None, found: Callable[[str, str], str], counts: Callable[[str], list[tuple[str, str]]]) -> None:
        nonlocal df
        before = done[-1].after if done else runs
        after = before
        if expression is not None:
            after = f"__{len(done)}"
            df = df.withColumn(after, F.expr(f"transform({before}, c -> {expression('c')})" if nested else expression(before)))
        done.append(Step(rule, before, after, found, counts))

    put(TRIM, R.trim, R.trim_findings, lambda b: [("A", f"size({R.trim_findings(b, '')})")])
    for rule in R.STEPS:
        on = rule.id in enabled
        if rule.level != "C" and not on:
            continue
        own = lambda b, rule=rule: R.counts(rule, b)
        if rule.scope == "dictionary":
            put(rule, R.dehyph, lambda b, a: R.dehyph_findings(b), own)
        else:
            put(rule, (lambda b, rule=rule: R.step(rule, b)) if on and rule.mutates else None, lambda b, a, rule=rule: R.findings(rule, b, a), own)
    return df, done


def clean(df: DataFrame, runs: str = "runs", keys: list[str] | None = None, enabled: Collection[str] = R.DEFAULT, dictionary: DataFrame | None = None) -> DataFrame:
    """df with its runs cleaned."""
    columns = df.columns
    out, done = steps(df, runs, keys or ["doc_id"], enabled, dictionary)
    return out.select(*[F.col(done[-1].after).alias(c) if c == runs else F.col(c) for c in columns])


def findings(
    df: DataFrame, runs: str = "runs", keys: list[str] | None = None, enabled: Collection[str] = R.DEFAULT, dictionary: DataFrame | None = None, only: Collection[str] | None = None
) -> DataFrame:
    """keys, step, run_ord, match_ord, rule_id, category, level, context, before, after: a row for each change or suggestion.
    Ordered by step, run_ord and match_ord they come as they were made."""
    keys = keys or ["doc_id"]
    df, done = steps(df, runs, keys, enabled, dictionary)
    return df.select(*keys, F.inline(F.expr(found(done, only))))


def found(done: list[Step], only: Collection[str] | None, nested: bool = False) -> str:
    """SQL: all findings of a row. nested: the columns __section and __shift have of each container its section's id, and how many runs were put before its own."""
    parts = []
    for k, s in enumerate(done):
        if only is None or s.rule.id in only:
            run = "f.run_ord - __shift[i]" if nested else "f.run_ord"
            fields = f"'run_ord', {run}, 'match_ord', f.match_ord, 'rule_id', '{s.rule.id}', 'category', '{s.rule.category}', 'level', f.level, 'context', f.context, 'before', f.before, 'after', f.after"
            if nested:
                each = f"zip_with({s.before}, {s.after}, (b, a) -> {s.findings('b', 'a')})"
                parts.append(f"flatten(transform({each}, (fs, i) -> transform(fs, f -> named_struct('cont_ord', i, 'section', __section[i], 'step', {k}, {fields}))))")
            else:
                parts.append(f"transform({s.findings(s.before, s.after)}, f -> named_struct('step', {k}, {fields}))")
    none = "array<struct<" + "cont_ord:int,section:string," * nested + "step:int,run_ord:int,match_ord:int,rule_id:string,category:string,level:string,context:string,before:string,after:string>>"
    return f"concat({', '.join([f'cast(array() as {none})', *parts])})"


def finding_counts(df: DataFrame, runs: str = "runs", keys: list[str] | None = None, enabled: Collection[str] = R.DEFAULT, dictionary: DataFrame | None = None) -> DataFrame:
    """rule_id, level, count: how many findings there are, without making them; rules that find nothing have no row."""
    df, done = steps(df, runs, keys or ["doc_id"], enabled, dictionary)
    numbers = [(s.rule.id, level, n) for s in done for level, n in s.counts(s.before)]
    # One row goes on from each task.
    sums = df.select(*[F.expr(n).cast("long").alias(f"n{k}") for k, (_, _, n) in enumerate(numbers)]).agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(numbers))])
    rows = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(level).alias("level"), F.col(f"n{k}").alias("count")) for k, (r, level, _) in enumerate(numbers)])
    return sums.select(F.inline(rows)).where(F.col("count") > 0)


def block_findings(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Findings of the structural rules on paragraphs, after the pipeline."""
    t = F.col(text)

    def row(rule: R.Rule, after: str):
        return F.struct(
            F.lit(len(R.STEPS) + 1 + R.BLOCK_RULES.index(rule)).alias("step"), F.lit(0).alias("run_ord"), F.lit(0).alias("match_ord"), F.lit(rule.id).alias("rule_id"),
            F.lit(rule.category).alias("category"), F.lit(rule.level).alias("level"), F.concat(F.lit("⟦"), R.clip(t), F.lit("⟧")).alias("context"), t.alias("before"), F.lit(after).alias("after"),
        )

    number, heading = R.BLOCK_RULES
    rows = F.array(F.when(R.is_page_number(t), row(number, "")), F.when(R.is_heading(t), row(heading, R.HEADING_LABEL)))
    return df.where(R.go_trim(t) != "").select(*keys, F.inline(F.filter(rows, lambda r: r.isNotNull())))


def catalog(spark: SparkSession, enabled: Collection[str] = R.DEFAULT) -> DataFrame:
    rows = [(k, r.id, r.name, r.category, r.level, r.id in enabled) for k, r in enumerate(R.CATALOG)]
    schema = T.StructType().add("step", "integer").add("rule_id", "string").add("name", "string").add("category", "string").add("level", "string").add("enabled", "boolean")
    return spark.createDataFrame(rows, schema)


def rule_stats(counts: DataFrame, enabled: Collection[str] = R.DEFAULT) -> DataFrame:
    """Every rule of the catalog with its number of findings (counts: of finding_counts), none included; trimming isn't in the catalog."""
    counts = counts.groupBy("rule_id").agg(F.sum("count").alias("count"))
    return catalog(counts.sparkSession, enabled).join(counts, "rule_id", "left").select("rule_id", "name", "category", "level", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "enabled")


def report(found: DataFrame, keys: list[str]) -> DataFrame:
    """rule_id, level of the first finding, count, and whether the rule was applied or only suggests; most frequent first."""
    order = F.struct(*keys, "step", "run_ord", "match_ord")
    out = found.groupBy("rule_id").agg(F.min_by("level", order).alias("level"), F.count(F.lit(1)).alias("count"))
    return out.withColumn("kind", F.when(F.col("level") == "C", "suggested").otherwise("applied")).orderBy(F.desc("count"), "rule_id")


def first_findings(found: DataFrame, keys: list[str], n: int = 200) -> DataFrame:
    """The first n findings of each rule and book (keys), in the order in which they were made."""
    w = Window.partitionBy(*keys, "rule_id").orderBy("step", "run_ord", "match_ord")
    return found.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def findings_of(found: DataFrame, rule_id: str, keys: list[str], n: int = 500) -> DataFrame:
    """The first n findings of one rule, in the order in which they were made."""
    return found.where(F.col("rule_id") == rule_id).orderBy(*keys, "step", "run_ord", "match_ord").limit(n)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word: a word list of one word a line, packed or not; what a dictionary has is looked up in lower case, without the letter yo."""
    return spark.read.text(path).select(F.replace(F.lower(F.trim("value")), F.lit("ё"), F.lit("е")).alias("word")).where("word <> ''").distinct()


def write_dictionary(words: DataFrame, path: str) -> None:
    """A packed word list in the order of its characters, a word a line. It is sorted over all files, one after the other."""
    words.select("word").orderBy("word").write.option("compression", "gzip").text(path)


def read_word_list(spark: SparkSession, path: str, encoding: str = "windows-1251") -> DataFrame:
    """text: the lines of a raw word list in an older encoding; dictionary_words makes a dictionary of them."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.decode(encoding, "replace") for x in b.column(0).to_pylist()], pa.string())], ["text"])

    # The text source hands on the bytes of a line as they are.
    return spark.read.text(path).select(F.col("value").cast("binary").alias("line")).mapInArrow(decoded, "text string")


def dictionary_words(texts: DataFrame, text: str) -> DataFrame:
    """word: distinct lower-case Cyrillic words of two letters or more, without the letter yo."""
    # The range is of that script, and told much sooner.
    token = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\x{0400}-\x{0481}\p{IsCyrillic}]+"), F.lit(0)))
    return texts.select(token.alias("w")).select(F.replace("w", F.lit("ё"), F.lit("е")).alias("word")).where(F.length("word") >= 2).distinct()
