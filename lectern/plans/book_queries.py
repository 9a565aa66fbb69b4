"""Queries of the operators on books: metadata, trees, links. The inputs are made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..operators import structure as S
from .fixtures import table
from .queries import query

# --- names, titles, paths ---

#: Person names of nought to four words, from the parts' names and brands.
_NAMES = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || split_part(p_name, ' ', 1) || ' ' WHEN 2 THEN p_name
  WHEN 3 THEN p_name || '  ' || p_type ELSE p_name || ' ' || p_type || chr(9) || p_brand END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS nick FROM part"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    name = (
        F.when(k == 0, "").when(k == 1, F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" "))).when(k == 2, F.col("p_name"))
        .when(k == 3, F.concat("p_name", F.lit("  "), "p_type")).otherwise(F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit("\t"), F.col("p_brand")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("").alias("nick"))


_SPLIT = rf"""SELECT *, CASE WHEN n >= 2 THEN w[1] ELSE '' END AS first, CASE WHEN n >= 3 THEN array_to_string(w[2:n - 1], ' ') ELSE '' END AS middle, CASE WHEN n > 0 THEN w[n] ELSE '' END AS last
FROM (SELECT *, len(w) AS n FROM (SELECT *, list_filter(string_split_regex(name, '\s+'), lambda x: x <> '') AS w FROM ({_NAMES})))"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).withColumn("p", M.split_name(F.col("name"))).select("p_partkey", "name", "nick", "p.first", "p.middle", "p.last")


@query("split_name", f"SELECT p_partkey, first, middle, last FROM ({_SPLIT})")
def split_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("p_partkey", "first", "middle", "last")


_DISPLAY = "CASE WHEN nick <> '' AND first = '' AND last = '' THEN nick ELSE array_to_string(list_filter([first, middle, last], lambda x: x <> ''), ' ') END"
_FILED = f"CASE WHEN last = '' THEN {_DISPLAY} WHEN trim(first || ' ' || middle) = '' THEN last ELSE last || ', ' || trim(first || ' ' || middle) END"


def _person(f) -> Column:
    return f(*(F.col(c) for c in ("first", "middle", "last", "nick")))


@query("file_as", f"SELECT p_partkey, {_DISPLAY} AS display, {_FILED} AS file_as FROM ({_SPLIT})")
def file_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("p_partkey", _person(M.display_name).alias("display"), _person(M.file_as).alias("file_as"))


_UUID = f"""SELECT p_partkey, CASE WHEN title = '' AND len(a) = 0 THEN '' ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
    WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS uuid
FROM (SELECT *, sha1(title || chr(0) || CASE WHEN len(a) = 0 THEN '' ELSE a[1] || chr(0) END || CASE WHEN p_partkey % 2 = 0 THEN nick || chr(0) || CAST(p_partkey AS VARCHAR) ELSE '' END) AS h
  FROM (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE name_trim END AS title, CASE WHEN {_FILED} = '' THEN [] ELSE [{_FILED}] END AS a
    FROM (SELECT *, array_to_string(w, ' ') AS name_trim FROM ({_SPLIT}))))"""


@query("stable_uuid", _UUID)
def stable_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _split(spark, sf_dir).withColumn("filed", _person(M.file_as))
    title = F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.array_join(M.fields(F.col("name")), " "))
    authors = F.filter(F.array("filed"), lambda a: a != "")
    series = F.when(F.col("p_partkey") % 2 == 0, F.col("nick"))
    return d.select("p_partkey", M.stable_uuid(title, authors, series, F.col("p_partkey").cast("string")).alias("uuid"))


_TITLES = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' [litres] {fb2}' WHEN 1 THEN '[' || p_brand || '] ' || p_name || ' litres' WHEN 2 THEN p_name || ': ' || p_type || '? ... ' ELSE '  ' || p_name || ' ЛитРес' END AS title FROM part"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    title = (
        F.when(k == 0, F.concat(name, F.lit(" [litres] {fb2}"))).when(k == 1, F.concat(F.lit("["), F.col("p_brand"), F.lit("] "), name, F.lit(" litres")))
        .when(k == 2, F.concat(name, F.lit(": "), F.col("p_type"), F.lit("? ... "))).otherwise(F.concat(F.lit("  "), name, F.lit(" ЛитРес")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))


@query(
    "clean_title",
    rf"""SELECT p_partkey, trim(CASE WHEN ends_with(b, 'ЛитРес') THEN left(b, length(b) - 6) ELSE b END) AS title FROM (
SELECT p_partkey, CASE WHEN ends_with(a, 'litres') THEN left(a, length(a) - 6) ELSE a END AS b FROM (
SELECT p_partkey, trim(regexp_replace(title, '\s*[\[\{{][^\]\}}]*[\]\}}]\s*', ' ', 'g')) AS a FROM ({_TITLES})))""",
)
def clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("p_partkey", M.clean_title(F.col("title")).alias("title"))


@query(
    "safe_filename",
    rf"""SELECT p_partkey, CASE WHEN length(b) > 120 THEN rtrim(left(b, 120), ' .') ELSE b END AS file FROM (
SELECT p_partkey, rtrim(trim(regexp_replace(regexp_replace(repeat(title, 1 + CAST(p_partkey % 7 AS INT)), '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g')), ' .') AS b FROM ({_TITLES}))""",
)
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _titles(spark, sf_dir).withColumn("long", F.expr("repeat(title, 1 + cast(p_partkey % 7 as int))"))
    return d.select("p_partkey", M.safe_file_name(F.col("long")).alias("file"))


_IDS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(p_partkey AS VARCHAR) || p_name WHEN 2 THEN p_brand || '/ё.' || p_name ELSE '-' || p_type END AS id FROM part"


@query("safe_id", rf"SELECT p_partkey, CASE WHEN id = '' THEN '' ELSE regexp_replace(left(id, 1), '[^a-zA-Z_]', '_') || regexp_replace(substr(id, 2), '[^a-zA-Z0-9_.-]', '_', 'g') END AS safe FROM ({_IDS})")
def safe_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "").when(k == 1, F.concat(F.col("p_partkey").cast("string"), "p_name")).when(k == 2, F.concat(F.col("p_brand"), F.lit("/ё."), F.col("p_name"))).otherwise(F.concat(F.lit("-"), F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", M.safe_id(raw).alias("safe"))


#: Files two folders deep at most, of which some share folders.
_PATHS = "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE a.n_nationkey % 3 WHEN 0 THEN 'f.x' WHEN 1 THEN 't/f.x' ELSE 't/u/f.x' END AS source, CASE b.n_nationkey % 4 WHEN 0 THEN 'g.x' WHEN 1 THEN 't/g.x' WHEN 2 THEN 't/u/g.x' ELSE 'v/g.x' END AS target FROM nation a, nation b"
_ANSWERS = (("f.x", "g.x", "g.x"), ("f.x", "t/g.x", "t/g.x"), ("f.x", "t/u/g.x", "t/u/g.x"), ("f.x", "v/g.x", "v/g.x"), ("t/f.x", "g.x", "../g.x"), ("t/f.x", "t/g.x", "g.x"), ("t/f.x", "t/u/g.x", "u/g.x"), ("t/f.x", "v/g.x", "../v/g.x"), ("t/u/f.x", "g.x", "../../g.x"), ("t/u/f.x", "t/g.x", "../g.x"), ("t/u/f.x", "t/u/g.x", "g.x"), ("t/u/f.x", "v/g.x", "../../v/g.x"))


@query("rel_path", f"SELECT a, b, w.r AS path FROM ({_PATHS}) p JOIN (VALUES {', '.join(map(str, _ANSWERS))}) w(s, t, r) ON w.s = p.source AND w.t = p.target")
def rel_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a")), n.select(F.col("n_nationkey").alias("b"))
    d = a.crossJoin(b)  # 25 nations
    source = F.get(F.lit(["f.x", "t/f.x", "t/u/f.x"]), F.col("a") % 3)
    target = F.get(F.lit(["g.x", "t/g.x", "t/u/g.x", "v/g.x"]), F.col("b") % 4)
    return d.select("a", "b", M.relative_path(source, target).alias("path"))


@query("split_csv", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' ,, ' || p_type || ',' || p_brand || ', ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS words FROM part")
def split_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("p_name"), F.lit(" ,, "), F.col("p_type"), F.lit(","), F.col("p_brand"), F.lit(", "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(M.split_list(text), "|").alias("words"))


@query("escape_markup", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM pages")
def escape_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(M.escape_attribute(F.col("html")).cast("binary")).alias("digest"))


@query(
    "metadata_overlay",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 0 THEN d.source ELSE 'new ' || l.doc_id END ELSE d.source END AS title,
  CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN '' ELSE 'de' END ELSE d.lang END AS lang
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def metadata_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "labels").select("doc_id", F.struct(F.when(F.col("quality") == 0, " ").otherwise(F.concat(F.lit("new "), F.col("doc_id").cast("string"))).alias("title"), F.when(F.col("toxic") == 1, "").otherwise("de").alias("lang")).alias("edit"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "lang").join(edits, "doc_id", "left")
    new = M.overlay(["title", "lang"], keep_blank=("title",))
    return d.select("doc_id", *[c.alias(n) for n, c in new.items()])


# --- trees: nations are books, customers their sections, orders and their lines the sections below ---

_TREE = """SELECT book, row_number() OVER (PARTITION BY book ORDER BY c, o, l) AS sec_ord, c, o, l, own_size FROM (
SELECT c_nationkey AS book, c_custkey AS c, -1 AS o, -1 AS l, 30 + 100 * length(c_name) AS own_size FROM customer
UNION ALL SELECT c_nationkey, c_custkey, o_orderkey, -1, 30 + CAST(floor(o_totalprice / 1000) AS BIGINT) FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT c_nationkey, c_custkey, o_orderkey, l_linenumber, 30 + 10 * q FROM (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) li
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, sec_ord, parent_ord, depth, path, own_size"""
    for name in ("customer", "orders", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    d = spark.sql(_TREE)
    from pyspark.sql import Window

    # In the order of the walk, the section above is the last one seen of the level above.
    w = Window.partitionBy("book").orderBy("sec_ord")
    top = F.last(F.when(F.col("o") < 0, F.col("sec_ord")), True).over(w)
    middle = F.last(F.when((F.col("o") >= 0) & (F.col("l") < 0), F.col("sec_ord")), True).over(w)
    depth = F.when(F.col("o") < 0, 1).when(F.col("l") < 0, 2).otherwise(3)
    d = d.withColumns({"depth": depth, "top": top, "middle": middle})
    path = F.when(F.col("depth") == 1, F.array("sec_ord")).when(F.col("depth") == 2, F.array("top", "sec_ord")).otherwise(F.array("top", "middle", "sec_ord"))
    parent = F.when(F.col("depth") == 2, F.col("top")).when(F.col("depth") == 3, F.col("middle"))
    return d.select(F.col("book").cast("long").alias("book"), F.col("sec_ord").cast("long").alias("sec_ord"), parent.cast("long").alias("parent_ord"), "depth", path.alias("path"), F.col("own_size").cast("long").alias("own_size"))


@query(
    "section_size",
    f"""WITH t AS ({_TREE}) SELECT CAST(a.book AS BIGINT) AS book, CAST(a.sec_ord AS BIGINT) AS sec_ord, CAST(sum(b.own_size) AS BIGINT) AS size FROM t a JOIN t b
ON a.book = b.book AND a.c = b.c AND (a.o = -1 OR a.o = b.o AND (a.l = -1 OR a.l = b.l)) GROUP BY ALL""",
)
def section_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.subtree_sizes(tree(spark, sf_dir))


@query("split_plan")
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    sizes = S.subtree_sizes(t)
    return S.split_files(t.join(sizes, ["book", "sec_ord"]), 4096)


@query("nav", f"SELECT CAST(book AS BIGINT) AS book, CAST(sec_ord AS BIGINT) AS sec_ord, CAST(sec_ord AS INTEGER) AS play_order, CAST(max(CASE WHEN o < 0 THEN 1 WHEN l < 0 THEN 2 ELSE 3 END) OVER (PARTITION BY book) AS INTEGER) AS nav_depth FROM ({_TREE})")
def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.navigation(tree(spark, sf_dir))


_ANCHORS = "SELECT c_nationkey AS book, c_custkey AS ord, 'id' || (c_custkey % 10) AS base FROM customer"


@query("anchors", f"SELECT CAST(book AS BIGINT) AS book, CAST(ord AS BIGINT) AS ord, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS name FROM (SELECT *, row_number() OVER (PARTITION BY book, base ORDER BY ord) AS k FROM ({_ANCHORS}))")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    d = c.select(F.col("c_nationkey").cast("long").alias("book"), F.col("c_custkey").cast("long").alias("ord"), F.concat(F.lit("id"), (F.col("c_custkey") % 10).cast("string")).alias("base"))
    return S.unique_names(d)


@query(
    "resolve_links",
    """WITH a AS (SELECT c_nationkey AS book, 'c' || (c_custkey % 40) AS id, max(c_custkey) AS ord FROM customer GROUP BY ALL),
l AS (SELECT o_orderkey AS link_ord, c_nationkey AS book, 'c' || (o_orderkey % 50) AS id, 'text/f' || (o_orderkey % 3) || '.xhtml' AS source FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT link_ord, CASE WHEN a.ord IS NULL THEN '#' || l.id WHEN 'text/f' || (a.ord % 3) || '.xhtml' = source THEN '#x' || a.ord ELSE 'f' || (a.ord % 3) || '.xhtml#x' || a.ord END AS target
FROM l LEFT JOIN a ON l.book = a.book AND l.id = a.id""",
)
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resolve_links(*_links(spark, sf_dir)).select("link_ord", "target")


@query(
    "dangling_links",
    """SELECT o_orderkey AS link_ord, '#c' || (o_orderkey % 50) AS href FROM orders JOIN customer c ON o_custkey = c_custkey
WHERE NOT EXISTS (SELECT 1 FROM customer a WHERE a.c_nationkey = c.c_nationkey AND a.c_custkey % 40 = o_orderkey % 50)""",
)
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dangling_links(*_links(spark, sf_dir)).select("link_ord", "href")


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = lambda c: (c).cast("string")
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key = F.col("c_custkey")
    a = c.select(F.col("c_nationkey").alias("book"), F.concat(F.lit("c"), s(key % 40)).alias("id"), key.alias("ord"), F.concat(F.lit("text/f"), s(key % 3), F.lit(".xhtml")).alias("file"), F.concat(F.lit("x"), s(key)).alias("frag"))
    k = F.col("o_orderkey")
    links = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("book"), k.alias("link_ord"), F.concat(F.lit("text/f"), s(k % 3), F.lit(".xhtml")).alias("source"), F.concat(F.lit("#c"), s(k % 50)).alias("href"))
    return links, a


@query(
    "collapse_empty_lines",
    """SELECT doc_id, CAST(ord AS INTEGER) AS ord FROM (SELECT doc_id, ord, x, lag(x) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM (
SELECT doc_id, unnest(range(len(l))) AS ord, unnest(l) = '' AS x FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), chr(10)) AS l FROM documents))) WHERE NOT (x AND coalesce(before, FALSE))""",
)
def collapse_empty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.replace("text", F.lit(". "), F.lit(".\n\n\n")), "\n")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.lit(0).alias("parent"), F.posexplode(lines).alias("ord", "line"))
    d = d.withColumn("kind", F.when(F.col("line") == "", "empty-line").otherwise("p"))
    return S.collapse_empty_lines(d).select(F.col("book").alias("doc_id"), "ord")


@query(
    "flat_text",
    "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
)
def flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flat_text(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("run_ord"), "text"), ["conv_id"])


@query(
    "block_size",
    "SELECT doc_id, CAST(30 + strlen(text) + 15 * (doc_id % 3) + 30 * (doc_id % 2) + 40 * (doc_id % 5) AS BIGINT) AS size FROM documents",
)
def block_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", S.block_size(F.col("text"), k % 3, k % 2, k % 5).cast("long").alias("size"))


@query(
    "encoding_detect",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'utf-8 (BOM)' WHEN doc_id % 5 = 1 THEN 'windows-1251' WHEN doc_id % 5 = 2 THEN 'utf-8' WHEN doc_id % 5 = 3 THEN 'koi8-r' ELSE
  CASE WHEN regexp_matches(text, '[^\\x00-\\x7f]') THEN 'windows-1251 (declared utf-8/none)' ELSE 'utf-8' END END AS encoding FROM documents""".replace("\\\\", "\\"),
)
def encoding_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    head = lambda e: F.encode(F.lit(f"<?xml version='1.0' encoding='{e}'?>"), "UTF-8")
    utf = F.encode("text", "UTF-8")
    content = (
        F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf)).when(k == 1, F.concat(head("CP1251"), utf)).when(k == 2, F.concat(head("UTF8"), utf)).when(k == 3, F.concat(head("koi-8"), utf))
        .otherwise(F.encode(F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?"), "ISO-8859-1"))
    )
    return table(spark, sf_dir, "documents").withColumn("content", content).select("doc_id", M.detected_encoding(F.col("content")).alias("encoding"))


# --- books: a document becomes a marked-up file, is parsed again, and packed ---

_LINES = "SELECT doc_id, lang, source, CAST(unnest(range(len(l))) AS INTEGER) AS ord, unnest(l) AS line FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)"


def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a file for each document. Every third one leaves its last section open, every fourth has a bare & in its title."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(x == "", "<empty-line/>").otherwise(F.concat(F.lit("<p>"), M.escape_text(x), F.lit("</p>"))))
    number = F.col("doc_id").cast("string")
    amp = F.when(F.col("doc_id") % 4 == 0, " & Co").otherwise("")
    end = F.when(F.col("doc_id") % 3 == 0, "").otherwise("</section></body></FictionBook>")
    text = F.concat(
        F.lit("<?xml version='1.0' encoding='UTF-8'?>\n<FictionBook><description><title-info><author><first-name>A</first-name><last-name>"), F.col("source"), F.lit("</last-name></author><book-title>Doc "), number, amp,
        F.lit("</book-title><lang>"), F.col("lang"), F.lit("</lang></title-info></description><body><section id='s"), number, F.lit("'><title><p>T <strong>"), number, F.lit("</strong></p></title>"),
        F.array_join(lines, ""), end,
    )
    return d.select(number.alias("path"), F.encode(text, "UTF-8").alias("content"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import fb2

    return fb2.parse_files(book_files(spark, sf_dir))


@query("meta_info", "SELECT CAST(doc_id AS VARCHAR) AS book, 'Doc ' || doc_id || CASE WHEN doc_id % 4 = 0 THEN ' & Co' ELSE '' END AS title, 'A ' || source AS author, lang, 1 AS sections, FALSE AS has_cover FROM documents")
def meta_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import fb2

    return fb2.meta_info(books(spark, sf_dir))


@query("sections_tree", "SELECT CAST(doc_id AS VARCHAR) AS book, 0 AS sec_ord, 1 AS depth, 's' || doc_id AS id, 'T ' || doc_id AS title FROM documents")
def sections_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import fb2

    return fb2.sections(books(spark, sf_dir)).select("book", "sec_ord", "depth", "id", "title")


@query("blocks", f"SELECT CAST(doc_id AS VARCHAR) AS book, ord + 1 AS block_ord, CASE WHEN line = '' THEN 'empty-line' ELSE 'paragraph' END AS kind, line AS text FROM ({_LINES})")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import fb2

    b = fb2.blocks(books(spark, sf_dir)).where("role = 'content'")
    return b.select("book", "block_ord", "kind", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text"))


@query("runs", "SELECT CAST(doc_id AS VARCHAR) AS book, k AS run_ord, CASE k WHEN 0 THEN '' ELSE 'strong' END AS style, CASE k WHEN 0 THEN 'T ' ELSE CAST(doc_id AS VARCHAR) END AS text FROM documents, (VALUES (0), (1)) v(k)")
def title_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import fb2

    r = fb2.text_runs(books(spark, sf_dir)).where("block_ord = 0")
    return r.select("book", "run_ord", F.array_join("style", " ").alias("style"), "text")


MODIFIED = "2020-01-01T00:00:00Z"


@query("xhtml_docs", "SELECT CAST(doc_id AS VARCHAR) AS book, 7 AS entries, 'text/chap_0001.xhtml' AS chapter, 'application/epub+zip' AS mimetype FROM documents")
def xhtml_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import assembly

    e = assembly.package_entries(books(spark, sf_dir), MODIFIED)
    return e.groupBy("book").agg(
        F.count(F.lit(1)).cast("int").alias("entries"), F.max(F.when(F.col("name").contains("chap_"), F.regexp_replace("name", "^OEBPS/", ""))).alias("chapter"),
        F.max(F.when(F.col("name") == "mimetype", F.decode("content", "UTF-8"))).alias("mimetype"),
    )


@query("opf_xml")
def opf_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import assembly

    return assembly.package_entries(books(spark, sf_dir), MODIFIED, names=["OEBPS/content.opf"]).select("book", F.decode("content", "UTF-8").alias("opf"))


@query("epub_zip")
def epub_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import assembly

    return assembly.packages(books(spark, sf_dir), MODIFIED).select("book", F.octet_length("epub").alias("bytes"), F.sha2("epub", 256).alias("sha256"))


@query("page_blocks")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed web pages through the tolerant reader: how many paragraphs and runs of text it gets out of each."""
    from ..sources import fb2

    wrap = F.concat(F.lit("<FictionBook><description><title-info><book-title>page</book-title></title-info></description><body><section>"), F.col("html"), F.lit("</section></body></FictionBook>"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode(wrap, "UTF-8").alias("content"))
    return fb2.parse_files(pages).select(F.col("path").alias("page"), F.size("sections").alias("sections"), F.size("blocks").alias("blocks"))


@query("preview")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import assembly

    return assembly.previews(books(spark, sf_dir)).select("book", F.length("html").alias("chars"), F.md5(F.encode("html", "UTF-8")).alias("digest"))


def _yo_sql() -> str:
    from ..functions import yo

    rows = [(w.replace("ё", "е"), w) for w in yo.WORDS] + [("Еще", "Ещё"), ("ЕЩЕ", "ЕЩЁ")]
    return f"SELECT r_regionkey, word, restored FROM region, (VALUES {', '.join(map(str, rows))}) v(word, restored)"


@query("yo_lookup", _yo_sql())
def yo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import yo

    words = F.explode(F.lit([w.replace("ё", "е") for w in yo.WORDS] + ["Еще", "ЕЩЕ", "слово"]))
    return table(spark, sf_dir, "region").select("r_regionkey", words.alias("word")).withColumn("restored", yo.restored(F.col("word"))).where("restored is not null")


@query(
    "cover_config",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS width, CASE WHEN p_size * 3 BETWEEN 1 AND 100 THEN p_size * 3 ELSE 88 END AS quality,
  CASE WHEN p_size / 40.0 > 0 AND p_size / 40.0 <= 1 THEN round(p_size / 40.0, 4) ELSE 0.8 END AS plate FROM part""",
)
def cover_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import covers

    size = F.col("p_size").cast("string")
    width = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit('"width": '), size, F.lit(", ")))
    text = F.concat(F.lit("{"), width, F.lit('"jpegQuality": '), (F.col("p_size") * 3).cast("string"), F.lit(', "plateWidth": '), (F.col("p_size") / 40).cast("string"), F.lit("}"))
    d = table(spark, sf_dir, "part").withColumn("c", covers.config(text))
    return d.select("p_partkey", "c.width", F.col("c.jpegQuality").alias("quality"), F.round("c.plateWidth", 4).alias("plate"))


@query(
    "wrap_lines",
    """SELECT p_partkey, list_reduce(list_filter(string_split_regex(p_name || ' ' || p_type || ' ' || p_brand, ' +'), lambda w: w <> ''),
  lambda a, w: CASE WHEN length(split_part(a, '|', -1)) + 1 + length(w) <= 16 THEN a || ' ' || w ELSE a || '|' || w END) AS lines FROM part""",
)
def wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import covers

    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(covers.wrap_lines(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 16), "|").alias("lines"))


_PICTURES = "SELECT p_partkey, CAST(p_size * 10 * (p_partkey % 3) AS INTEGER) AS w, CAST(p_size * 7 + 5 AS INTEGER) AS h, CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size * 10 * (p_partkey % 3) ELSE 60 + p_partkey % 50 END AS INTEGER) AS tw, CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size * 7 + 5 ELSE 80 END AS INTEGER) AS th FROM part"


@query(
    "cover_crop",
    f"""SELECT p_partkey, CAST((w - cw) // 2 AS INTEGER) AS x, CAST((h - ch) // 2 AS INTEGER) AS y, cw AS width, ch AS height FROM (
SELECT *, CASE WHEN w = tw AND h = th OR w / h <= tw / th THEN w ELSE CAST(trunc(h * (tw / th)) AS INTEGER) END AS cw, CASE WHEN w = tw AND h = th OR w / h > tw / th THEN h ELSE CAST(trunc(w / (tw / th)) AS INTEGER) END AS ch
FROM ({_PICTURES}) WHERE w > 0)""",
)
def cover_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import covers

    d = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    width, height = (size * 10 * (k % 3)).cast("int"), (size * 7 + 5).cast("int")
    to_width, to_height = F.when(k % 7 == 0, width).otherwise(60 + k % 50).cast("int"), F.when(k % 7 == 0, height).otherwise(80).cast("int")
    return d.select("p_partkey", covers.crop(width, height, to_width, to_height).alias("c")).where("c is not null").select("p_partkey", "c.x", "c.y", "c.width", "c.height")


@query("cover_pick", "SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'none' WHEN p_size % 6 = 1 THEN 'only' ELSE 'another' END AS pick FROM part")
def cover_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which one is left to chance; that it is one of them, and not the last one, isn't."""
    from ..sources import covers

    n, avoid = (F.col("p_size") % 6).cast("int"), (F.col("p_partkey") % 7).cast("int") - 1
    i = covers.picked(n, avoid, F.col("p_name"))
    word = F.when((n == 0) & (i == -1), "none").when((n == 1) & (i == 0), "only").when((i >= 0) & (i < n) & (i != avoid), "another").otherwise("wrong")
    return table(spark, sf_dir, "part").select("p_partkey", word.alias("pick"))
