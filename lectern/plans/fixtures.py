"""Text that gives the rules something to do: the documents' own words in Cyrillic, with defects put in.

Both engines of a comparison build it with the same functions, so the same list makes the column and the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC = "абцдефгхийклмнопкрстуввхызАБЦДЕФГХИЙКЛМНОПКРСТУВВХЫЗ"
DEFECTS = (
    (" тхе ", " - "), (" анд ", "  "), (". ", "... "), (", ", " ,"), (" оф ", ' "оф" '), (" то ", " ( то ) "), (" ин ", " 5 % № 7 (c) (r) (tm) ,, "),
    (" де ", " д. -- "), (" ла ", " А. С. Пушкин 1941-1945 т. д. "), (" ис ", " 12 кг – д'Арт "), (" ле ", " конец.Начало да..нет . . . "),
    (" ду ", " хорoшо д0м "), (" ет ", " сло- во ккк- ппп "), (" ун ", " в лесу—и к дому "),
)
#: By doc_id mod 4, before the text; and after each.
STARTS = ("  - ", "-", "– ", "")
END = f"{chr(0xAD)}{chr(0x200B)} слово — дело. \n"
LINES = ("42", "ГЛАВА ПЯТАЯ", "Глава шестая", "Он пришёл.")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t"""
    d = table(spark, sf_dir, "documents")
    t = F.translate("text", LATIN, CYRILLIC)
    for old, new in DEFECTS:
        t = F.replace(t, F.lit(old), F.lit(new))
    start = F.lit(STARTS[3])
    for k in range(3):
        start = F.when(F.col("doc_id") % 4 == k, F.lit(STARTS[k])).otherwise(start)
    return d.select("doc_id", F.concat(start, t, F.lit(END)).alias("t"))


def injected_sql() -> str:
    t = f"translate(text, '{LATIN}', '{CYRILLIC}')"
    for old, new in DEFECTS:
        t = f"replace({t}, {_quoted(old)}, {_quoted(new)})"
    start = " ".join(f"WHEN {k} THEN {_quoted(s)}" for k, s in enumerate(STARTS))
    return f"SELECT doc_id, (CASE doc_id % 4 {start} END) || {t} || {_quoted(END)} AS t FROM documents"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir).select("doc_id", F.array("t").alias("runs"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, t: the injected text's lines and some more."""
    lines = F.concat(F.split("t", "\n"), F.lit(list(LINES)))
    return injected(spark, sf_dir).select("doc_id", F.posexplode(lines).alias("line", "t"))


def paragraphs_sql() -> str:
    more = ", ".join(_quoted(x) for x in LINES)
    return f"""SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line, unnest(l) AS t
FROM (SELECT doc_id, list_concat(string_split(t, chr(10)), [{more}]) AS l FROM ({injected_sql()}))"""
