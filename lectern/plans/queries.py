"""One query for every operator, over the driver's tables, and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text_rules as R
from ..operators import cleaning
from . import fixtures, rule_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.dictionary_words(fixtures.injected(spark, sf_dir), "t")


# --- single rules, on the injected text ---


def _rule(rule: R.Rule) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = fixtures.runs(spark, sf_dir)
        if rule.scope == "dictionary":
            d = cleaning.with_known_words(d, "runs", ["doc_id"], dictionary(spark, sf_dir))
            d = d.withColumn("after", F.expr(R.dehyph("runs")))
        else:
            d = d.withColumn("after", F.expr(R.step(rule, "runs")) if rule.mutates else F.col("runs"))
        n = " + ".join(n for _, n in R.counts(rule, "runs"))
        return d.select("doc_id", F.col("after")[0].alias("out"), F.expr(n).cast("long").alias("n_findings"))

    return run


for _r in R.STEPS:
    query(f"rule_{_r.id.replace('-', '_')}", rule_sql.rule_query(_r, fixtures.injected_sql()))(_rule(_r))

_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


@query("rule_sp_trim", f"SELECT doc_id, rtrim(ltrim(t, {_BLANK}), {_BLANK}) AS out FROM ({fixtures.injected_sql()})")
def rule_sp_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.runs(spark, sf_dir).select("doc_id", F.expr(R.trim("runs"))[0].alias("out"))


_TRIMMED = r"regexp_replace(regexp_replace(t, '^[\s\x{0085}\x{00A0}\p{Z}]+', ''), '[\s\x{0085}\x{00A0}\p{Z}]+$', '')"


@query(
    "rule_page_number",
    rf"SELECT doc_id, line, t AS before, '' AS after FROM ({fixtures.paragraphs_sql()}) WHERE regexp_full_match({_TRIMMED}, '\d{{1,4}}')",
)
def rule_page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cleaning.block_findings(fixtures.paragraphs(spark, sf_dir), "t", ["doc_id", "line"])
    return found.where("rule_id = 'page-number'").select("doc_id", "line", "before", "after")


@query(
    "rule_heading_detect",
    rf"""SELECT doc_id, line, t AS before, '⟦' || CASE WHEN length(t) > 40 THEN left(t, 40) || '…' ELSE t END || '⟧' AS context
FROM (SELECT *, {_TRIMMED} AS s FROM ({fixtures.paragraphs_sql()}))
WHERE length(s) BETWEEN 2 AND 60 AND right(s, 1) NOT IN ('.', '!', '?', ':', ';', ',', '…')
  AND (regexp_matches(s, '(?i)^({'|'.join(R.CHAPTER_WORDS)})(\s|$)') OR regexp_matches(s, '\p{{Lu}}') AND NOT regexp_matches(s, '\p{{Ll}}'))""",
)
def rule_heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cleaning.block_findings(fixtures.paragraphs(spark, sf_dir), "t", ["doc_id", "line"])
    return found.where("rule_id = 'heading-detect'").select("doc_id", "line", "before", "context")


# --- the pipeline ---

NO_QUOTES = R.DEFAULT - {"quotes"}
EVERYTHING = frozenset(r.id for r in R.STEPS)


def _text(enabled) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = cleaning.clean(fixtures.runs(spark, sf_dir), enabled=enabled, dictionary=dictionary(spark, sf_dir))
        return d.select("doc_id", F.col("runs")[0].alias("out"))

    return run


for _name, _enabled in (("pipeline_text", R.DEFAULT), ("toggle_quotes_off", NO_QUOTES), ("nothing_enabled", frozenset()), ("everything_enabled", EVERYTHING)):
    query(_name, rule_sql.pipeline_text(_enabled, fixtures.injected_sql()))(_text(_enabled))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.findings(fixtures.runs(spark, sf_dir), dictionary=dictionary(spark, sf_dir))


@query("findings")
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.finding_counts(fixtures.runs(spark, sf_dir), dictionary=dictionary(spark, sf_dir))


@query("findings_rollup", rule_sql.rollup(R.DEFAULT, fixtures.injected_sql()))
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)


@query("findings_by_rule", rule_sql.rollup(R.DEFAULT, fixtures.injected_sql()))
def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many as are counted: the findings themselves, rolled up."""
    return found(spark, sf_dir).groupBy("rule_id", "level").agg(F.count(F.lit(1)).alias("count"))


#: One document's findings of each rule that are compared, and rules whose findings the SQL makes.
SHOWN = 5


@query("first_findings", rule_sql.first_findings(R.DEFAULT, fixtures.injected_sql(), SHOWN))
def first_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a book: what is shown of each rule's findings, in the order of the pipeline, with what the rules before have made of the text."""
    f = cleaning.findings(fixtures.runs(spark, sf_dir), dictionary=dictionary(spark, sf_dir), only=frozenset(rule_sql.SIMPLE))
    return cleaning.first_findings(f, ["doc_id"], SHOWN).select("doc_id", "rule_id", "category", "level", "before", "after", "context")


@query("findings_of_rule", rule_sql.findings_of("ell-dots", R.DEFAULT, fixtures.injected_sql(), 500))
def findings_of_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cleaning.findings(fixtures.runs(spark, sf_dir), dictionary=dictionary(spark, sf_dir), only={"ell-dots"})
    return cleaning.findings_of(f, "ell-dots", ["doc_id"]).select("doc_id", "before", "after", "context")


def _stats_sql() -> str:
    rows = ", ".join(f"({rule_sql.q(r.id)}, {rule_sql.q(r.name)}, '{r.category}', '{r.level}', {str(r.id in R.DEFAULT).lower()})" for r in R.CATALOG)
    return f"""SELECT c.id AS rule_id, c.name, c.category, c.level, CAST(coalesce(f.n, 0) AS BIGINT) AS count, c.enabled FROM (VALUES {rows}) c(id, name, category, level, enabled)
LEFT JOIN (SELECT rule_id, sum(count) AS n FROM ({rule_sql.rollup(R.DEFAULT, fixtures.injected_sql())}) GROUP BY rule_id) f ON f.rule_id = c.id"""


@query("rule_stats", _stats_sql())
def rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.rule_stats(counted(spark, sf_dir))


@query("findings_report", rule_sql.report(R.DEFAULT, fixtures.injected_sql()))
def findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.report(found(spark, sf_dir), ["doc_id"])


@query("findings_top200", f"SELECT rule_id, least(count, 200) AS shown, count > 200 AS truncated FROM (SELECT rule_id, sum(count) AS count FROM ({rule_sql.rollup(R.DEFAULT, fixtures.injected_sql())}) GROUP BY rule_id)")
def findings_top200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are one book here: how many findings of each rule are shown, and whether there are more."""
    n = counted(spark, sf_dir).groupBy("rule_id").agg(F.sum("count").alias("n"))
    return n.select("rule_id", F.least("n", F.lit(200)).alias("shown"), (F.col("n") > 200).alias("truncated"))


def _context(rule: R.Rule) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = fixtures.runs(spark, sf_dir)
        return d.select("doc_id", F.inline(F.expr(R.findings(rule, "runs", "runs")))).select("doc_id", "before", "after", "context")

    return run


for _id in rule_sql.SIMPLE:
    query(f"context_{_id.replace('-', '_')}", rule_sql.context_query(R.BY_ID[_id], fixtures.injected_sql()))(_context(R.BY_ID[_id]))


@query("dictgen", f"WITH d AS ({fixtures.injected_sql()}) {rule_sql.DICTIONARY}")
def dictgen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(spark, sf_dir).orderBy("word")
