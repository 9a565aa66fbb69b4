"""The rules over whole books: every container of a parsed book is cleaned where it stands, and headings are marked where they are accepted.

A book stays one row. Its containers are the runs of its paragraphs, titles, verses, cells and so on; the steps go over the array of them as column
expressions. What the dictionary has of all split words is looked up first, by a job of its own; only where they are many, books that have some meet the dictionary in a join. Nothing else is
shuffled.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text_rules as R
from ..sources import fb2
from . import cleaning

#: A run that is styled, linked or an image can't be trimmed, nor begin a line of speech: an empty run without style stands before or after it.
_APART = "(size({0}.style) > 0 or {0}.href <> '' or {0}.image <> '')"
_FIRST = f"size(b.runs) > 0 and {_APART.format('b.runs[0]')}"
_LAST = f"size(b.runs) > 0 and {_APART.format('element_at(b.runs, -1)')}"
_CONTAINERS = f"transform(blocks, b -> concat(if({_FIRST}, array(''), array()), transform(b.runs, r -> r.text), if({_LAST}, array(''), array())))"
_TEXT = "array_join(transform(b.runs, r -> r.text), '')"
_BLOCK = ("block_ord", "sec_ord", "role", "parent_block", "kind", "id", "style", "href", "alt", "colspan", "rowspan", "header")


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, {R.literal(chr(92) + 'A' + R.BLANK + '+|' + R.BLANK + '+' + chr(92) + 'z')}, '')"


def _steps(books: DataFrame, enabled: Collection[str], dictionary: DataFrame | None) -> tuple[DataFrame, list[cleaning.Step]]:
    if "dehyph" in enabled and dictionary is not None and not books.is_cached:
        # Their split words are gathered before they are cleaned; a parse is dearer than a read from disk.
        books = books.persist(StorageLevel.DISK_ONLY)
    return cleaning.steps(books.withColumn("__containers", F.expr(_CONTAINERS)), "__containers", ["path"], enabled, dictionary, nested=True)


def _cleaned(df: DataFrame, after: str) -> DataFrame:
    """df with the containers after the last step put back into its blocks."""
    runs = f"transform(b.runs, (r, i) -> named_struct('style', r.style, 'href', r.href, 'note', r.note, 'image', r.image, 'text', c[i + if({_FIRST}, 1, 0)]))"
    fields = ", ".join(f"'{f}', b.{f}" for f in _BLOCK)
    return df.withColumn("blocks", F.expr(f"zip_with(blocks, {after}, (b, c) -> named_struct({fields}, 'heading', b.heading, 'runs', {runs}))"))


def clean(books: DataFrame, enabled: Collection[str] = R.DEFAULT, dictionary: DataFrame | None = None) -> DataFrame:
    """Books with their texts cleaned; where `heading-detect` is enabled, paragraphs that look like headings are marked. Sections get their
    titles anew."""
    columns = books.columns
    df, done = _steps(books, enabled, dictionary)
    df = _cleaned(df, done[-1].after)
    if "heading-detect" in enabled:
        fields = ", ".join(f"'{f}', b.{f}" for f in _BLOCK)
        here = "b.role = 'content' and b.kind = 'paragraph' and b.parent_block is null"
        df = df.withColumn("__headings", F.transform("blocks", lambda b: R.is_heading(F.array_join(F.transform(b["runs"], lambda r: r["text"]), ""))))
        df = df.withColumn("blocks", F.expr(f"zip_with(blocks, __headings, (b, h) -> named_struct({fields}, 'heading', b.heading or ({here} and h), 'runs', b.runs))"))
    heads = "filter(blocks, b -> b.role = 'title' and b.parent_block is null and b.kind in ('paragraph', 'subtitle'))"
    made = f"filter(transform({heads}, b -> named_struct('sec_ord', b.sec_ord, 'text', {_trimmed(_TEXT)})), h -> h.text <> '')"
    title = _trimmed("array_join(transform(filter(heads_, h -> h.sec_ord = s.sec_ord), h -> h.text), ' ')")
    anew = f"transform(sections, s -> named_struct('sec_ord', s.sec_ord, 'parent_ord', s.parent_ord, 'depth', s.depth, 'path', s.path, 'body', s.body, 'id', s.id, 'title', {title}, 'image', s.image, 'alt', s.alt))"
    # Heads are found once for all sections: what a lambda captures is evaluated again and again.
    df = df.withColumn("sections", F.expr(f"transform(array({made}), heads_ -> {anew})[0]"))
    return df.select(*columns)


def findings(books: DataFrame, enabled: Collection[str] = R.DEFAULT, dictionary: DataFrame | None = None, only: Collection[str] | None = None) -> DataFrame:
    """book, cont_ord, step, run_ord, match_ord, rule_id, category, level, section (its id), context, before, after. Ordered by cont_ord, step, run_ord and match_ord
    they come as they are made: container by container, and those of whole paragraphs last."""
    df, done = _steps(books, enabled, dictionary)
    names = ["book", "cont_ord", "step", "run_ord", "match_ord", "rule_id", "category", "level", "section", "context", "before", "after"]
    if only is not None and {r.id for r in R.BLOCK_RULES} >= set(only):
        return _whole(df, done[-1].after).where(F.col("rule_id").isin(*only)).select(*names)
    # What a finding needs of its book is told where it is made: the book itself would be copied for each of them.
    own = df.withColumn("__section", F.expr("transform(blocks, b -> get(sections, b.sec_ord).id)")).withColumn("__shift", F.expr(f"transform(blocks, b -> if({_FIRST}, 1, 0))"))
    out = own.select(F.col("path").alias("book"), F.inline(F.expr(cleaning.found(done, only, nested=True)))).select(*names)
    if only is not None and not {r.id for r in R.BLOCK_RULES} & set(only):
        return out
    blocks = _whole(df, done[-1].after)
    if only is not None:
        blocks = blocks.where(F.col("rule_id").isin(*only))
    return out.unionByName(blocks.select(*names))


def finding_counts(books: DataFrame, enabled: Collection[str] = R.DEFAULT, dictionary: DataFrame | None = None, only: Collection[str] | None = None) -> DataFrame:
    """book, section (its id), rule_id, level, count: how many findings each section has, without making them; rules that find nothing there have no row."""
    df, done = _steps(books, enabled, dictionary)
    own = df.withColumn("__section", F.expr("transform(blocks, b -> get(sections, b.sec_ord).id)"))
    kinds, at = [], [F.col("__section")]
    for s in done:
        if only is not None and s.rule.id not in only:
            continue
        for level, n in s.counts("b"):
            # What a step left as it was holds none of its findings, but for those that only suggest.
            count = f"zip_with({s.before}, {s.after}, (b, a) -> if(b = a, 0, {n}))" if s.after != s.before and s.rule.scope != "dictionary" else f"transform({s.before}, b -> {n})"
            own = own.withColumn(f"__n{len(kinds)}", F.expr(count))
            at.append(F.col(f"__n{len(kinds)}"))
            kinds.append((s.rule.id, level))
    names = ["book", "section", "rule_id", "level", "count"]
    parts = []
    if kinds:
        rows = own.select(F.col("path").alias("book"), F.inline(F.arrays_zip(*at))).withColumnRenamed("__section", "section")
        sums = rows.groupBy("book", "section").agg(*[F.sum(f"__n{k}").alias(f"__n{k}") for k in range(len(kinds))])
        each = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(level).alias("level"), F.col(f"__n{k}").alias("count")) for k, (r, level) in enumerate(kinds)])
        parts.append(sums.select("book", "section", F.inline(F.filter(each, lambda x: x["count"] > 0))))
    whole = [r.id for r in R.BLOCK_RULES if only is None or r.id in only]
    if whole or not kinds:
        parts.append(_whole(df, done[-1].after).where(F.col("rule_id").isin(*whole)).groupBy(*names[:-1]).count())
    return reduce(DataFrame.unionByName, parts).select(*names)


def _whole(df: DataFrame, after: str) -> DataFrame:
    """Findings of the structural rules, given the column after the last step."""
    whole = _cleaned(df, after).select(F.col("path").alias("book"), "sections", F.posexplode(fb2.each("blocks")).alias("at", "b"))
    whole = whole.where("b.role = 'content' and b.kind = 'paragraph' and b.parent_block is null")
    whole = whole.select("book", F.get("sections", F.col("b.sec_ord"))["id"].alias("section"), (F.col("at") + F.lit(1 << 24)).alias("cont_ord"), F.expr(_TEXT).alias("t"))  # after all containers
    return cleaning.block_findings(whole, "t", ["book", "section", "cont_ord"])
