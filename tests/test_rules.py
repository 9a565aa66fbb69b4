"""The rules on single paragraphs: what they make of a text, and what they report."""

import gzip
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lectern.functions import text_rules as R
from lectern.functions import yo
from lectern.operators import cleaning

N = chr(0xA0)
LEVEL_A = frozenset(r.id for r in R.STEPS if r.level == "A")

A_CASES = [
    ("Это  двойной   пробел", "Это двойной пробел"), ("строка\nещё", "строка ещё"), ("слово , и", "слово, и"), ("конец .", "конец."), ("да,нет", "да, нет"), ("так:вот", "так: вот"),
    ("цена 1,5 кг", "цена 1,5 кг"), ("что---то", "что—то"), ("да--нет", "да—нет"), ("вот...", "вот…"), ("он - я", "он — я"), ("(c) 2020", "© 2020"), ("Бренд(r)", "Бренд®"), ("Марка(tm)", "Марка™"),
    ("текст,, ещё", "текст, ещё"), ("( текст )", "(текст)"), ("[ 1 ]", "[1]"), ("« текст", "«текст"), (f"а{N}б", f"а{N}б"), ("Текст  ,...и  вот - так", "Текст,…и вот — так"),
    ("аб т. е. вг", "аб т. е. вг"), ("mailto:x", "mailto: x"), (f"пу{chr(0xAD)}сто{chr(0x200B)}", "пусто"), ("", ""), ("   ", ""),
]
ALL_CASES = [
    ('Он сказал "привет" ей.', "Он сказал «привет» ей."), ('сказал "да "точно" верно"', "сказал «да „точно“ верно»"), ("- Привет", "— Привет"), ("– Привет", "— Привет"), ("что-то", "что-то"),
    ("в лесу родилась", f"в{N}лесу родилась"), ("и к дому", f"и{N}к{N}дому"), ("А. С. Пушкин", f"А.{N}С. Пушкин"), ("д'Артаньян", "д’Артаньян"), ("он — я", f"он{N}— я"), ("он – я", f"он{N}— я"),
    ("1990–2000 годы", "1990–2000 годы"), ("и т. д.", f"и{N}т.{N}д."), ("то есть т. е. вот", f"то{N}есть т.{N}е. вот"), ("он. Та дверь", "он. Та дверь"), ("—Текст", "— Текст"), ("-Текст", "— Текст"),
    ("—!", "—!"), ("—2", "—2"), ("1941-1945 годы", "1941–1945 годы"), ("страницы 5-7", "страницы 5–7"), ("Т-34", "Т-34"), ("5-летний", "5-летний"), ("тел 12-34-56", "тел 12-34-56"),
    ("дата 2020-01-02", "дата 2020-01-02"), ("а5-7", "а5–7"), ("на Пирсе 66 в Форте", f"на{N}Пирсе 66 в{N}Форте"), ("это был 2024 г. точно", f"это был 2024{N}г. точно"), ("вес 5 кг ровно", f"вес 5{N}кг ровно"),
    ("дал 5 яблок", "дал 5 яблок"), ("5 % и № 7", f"5{N}% и №{N}7"), ("Т. Д.", f"Т.{N}Д."), ("сло- во", "слово"), ("сло-\nво", "слово"), ("ккк- ппп", "ккк- ппп"),
    ("одно- или двухкомнатная", f"одно- или{N}двухкомнатная"), ("- еще не время", f"— еще не{N}время"), ("да..нет", "да..нет"), ("конец.Начало", "конец.Начало"), ("это д0м большой", "это д0м большой"),
    ('"', "«"), ('""', "«„"), ('а""', "а»»"), ('"a" "б "в" г" "', "«a» «б „в“ г» «"),
]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame([("слово",)], "word string")


def cleaned(spark, cases, **kw):
    d = spark.createDataFrame([(i, [c[0]]) for i, c in enumerate(cases)], "doc_id long, runs array<string>")
    rows = {r.doc_id: r.runs[0] for r in cleaning.clean(d, **kw).collect()}
    return [rows[i] for i in range(len(cases))]


def reported(spark, text, **kw):
    d = spark.createDataFrame([(0, [text])], "doc_id long, runs array<string>")
    return cleaning.findings(d, **kw).orderBy("step", "run_ord", "match_ord").collect()


def test_level_a(spark):
    assert cleaned(spark, A_CASES, enabled=LEVEL_A) == [want for _, want in A_CASES]


def test_all_levels(spark, dictionary):
    assert cleaned(spark, ALL_CASES, dictionary=dictionary) == [want for _, want in ALL_CASES]


def test_only_one_rule_is_accepted(spark):
    one = lambda rule, text: cleaned(spark, [(text,)], enabled={rule})[0]
    assert one("ell-two", "да..нет") == "да…нет"
    assert one("dot-space", "конец.Начало") == "конец. Начало"
    assert one("mixed-alpha", "хорoшо") == "хорoшо"  # never changes the text
    assert one("ocr-digit", "д0м") == "д0м"


def test_runs_keep_their_edges_and_share_quotes(spark):
    d = spark.createDataFrame([(0, ["  Текст  ", "важно", " ,конец  "]), (1, ['он "', "очень", '" сказал']), (2, []), (3, [""])], "doc_id long, runs array<string>")
    rows = dict(cleaning.clean(d).select("doc_id", "runs").collect())
    assert rows == {0: ["Текст ", "важно", ", конец"], 1: ["он «", "очень", "» сказал"], 2: [], 3: [""]}


def test_a_rule_can_be_switched_off(spark):
    assert cleaned(spark, [('"привет"',)], enabled=R.DEFAULT - {"quotes"}) == ['"привет"']
    # With nothing enabled, ends are still trimmed and suggestions still made.
    assert cleaned(spark, [(" а -- б ",)], enabled=frozenset()) == ["а -- б"]
    assert "ell-two" in {f.rule_id for f in reported(spark, "да..нет", enabled=frozenset())}


def test_findings(spark, dictionary):
    f = {x.rule_id: x for x in reported(spark, "длинный текст да,нет ещё длинный текст")}
    assert f["sp-after-punct"].context == "ный текст да⟦,н⟧ет ещё длинн"
    assert (f["sp-after-punct"].before, f["sp-after-punct"].after, f["sp-after-punct"].level) == (",н", ", н", "A")
    levels = {x.rule_id: x.level for x in reported(spark, '- "в лесу"')}
    assert levels == {"quotes": "B", "dialog-dash": "B", "nbsp-prep": "B"}
    known, unknown = (next(x for x in reported(spark, t, dictionary=dictionary) if x.rule_id == "dehyph") for t in ("сло- во", "ккк- ппп"))
    assert (known.level, known.after, unknown.level, unknown.after) == ("B", "слово", "C", "кккппп")
    assert not [x for x in reported(spark, "радио- и телепередачи") if x.rule_id == "dehyph"]
    assert not [x for x in reported(spark, "Что?.. Кто?!..") if x.rule_id == "ell-two"]
    assert not [x for x in reported(spark, "инициалы А.С. см.Рис") if x.rule_id == "dot-space"]
    mixed, digit = (next(x for x in reported(spark, t) if x.rule_id == r) for t, r in (("хорoшо", "mixed-alpha"), ("это д0м большой", "ocr-digit")))
    assert (mixed.after, digit.before, digit.after) == ("хорошо", "д0м", "дом")
    assert all(x.before != x.after for x in reported(spark, "Это  двойной   пробел..."))
    # What the rule changed before a place shows in the context of that place.
    assert [x.context for x in reported(spark, "и к дому") if x.rule_id == "nbsp-prep"] == ["⟦и ⟧к дому", f"и{N}⟦к ⟧дому"]


def test_detection_never_changes_a_text(spark):
    texts = [("да..нет конец.Начало хорoшо д0м",), ("а",), ("",)]
    assert cleaned(spark, texts, enabled=frozenset()) == [t for (t,) in texts]


def test_blocks(spark):
    lines = ["42", " 42 ", "42\n", "12345", "Глава 42 началась", "ГЛАВА ПЯТАЯ", "Глава пятая", "Был поздний вечер.", "ПРОЛОГ.", "А", "", "глава", "Я" * 61, "1 2"]
    d = spark.createDataFrame(list(enumerate(lines)), "n long, t string")
    found = {(r.n, r.rule_id) for r in cleaning.block_findings(d, "t", ["n"]).collect()}
    assert found == {(0, "page-number"), (1, "page-number"), (2, "page-number"), (4, "heading-detect"), (5, "heading-detect"), (6, "heading-detect"), (11, "heading-detect")}


def test_rollups(spark):
    d = spark.createDataFrame([(i, ["да,нет ... да..нет"]) for i in range(5)], "doc_id long, runs array<string>")
    f, n = cleaning.findings(d), cleaning.finding_counts(d)
    assert {(r.rule_id, r.level): r["count"] for r in n.collect()} == {(r.rule_id, r.level): r["count"] for r in f.groupBy("rule_id", "level").count().collect()}
    assert cleaning.finding_counts(d.limit(0)).count() == 0
    stats = {r.rule_id: r["count"] for r in cleaning.rule_stats(n).collect()}
    assert len(stats) == 32 and stats["sp-after-punct"] == 5 and stats["quotes"] == 0 and "sp-trim" not in stats
    report = cleaning.report(f, ["doc_id"]).collect()
    assert {(r.rule_id, r.kind) for r in report} >= {("ell-two", "suggested"), ("ell-dots", "applied")}
    assert cleaning.first_findings(f.withColumn("book", F.lit(1)), ["book"], 2).where("rule_id = 'ell-two'").count() == 2


def test_dictionary_files(spark, tmp_path):
    words = spark.createDataFrame([("слово",), ("дом",), ("еж",)], "word string")
    cleaning.write_dictionary(words, str(tmp_path / "out"))
    lines = [x for p in sorted((tmp_path / "out").glob("*.gz")) for x in gzip.open(p, "rt", encoding="utf-8").read().split()]
    assert lines == ["дом", "еж", "слово"]
    assert {r.word for r in cleaning.read_dictionary(spark, str(tmp_path / "out")).collect()} == set(lines)
    (tmp_path / "raw.txt").write_bytes("Ёлка\nа\nдом, дом\nx1\nСЛОВО\n".encode("cp1251"))
    raw = cleaning.read_word_list(spark, str(tmp_path / "raw.txt"))
    assert {r.word for r in cleaning.dictionary_words(raw, "text").collect()} == {"елка", "дом", "слово"}


def test_findings_of_one_rule(spark):
    d = spark.createDataFrame([(i, [".... " * 3]) for i in range(9)], "doc_id long, runs array<string>")
    got = cleaning.findings_of(cleaning.findings(d), "ell-dots", ["doc_id"], 7).collect()
    assert [(r.doc_id, r.match_ord) for r in got] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]


def test_yo(spark):
    words = ["еще", "Еще", "ЕЩЕ", "все", "слово"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(yo.restored(F.col("w"))).collect()]
    assert got == ["ещё", "Ещё", "ЕЩЁ", None, None]


def test_stream(spark, tmp_path):
    from lectern.streaming import cleaning as streaming

    source = str(tmp_path / "in")
    spark.createDataFrame([(0, ["да,нет"]), (1, ["сло- во"])], "doc_id long, runs array<string>").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, runs array<string>").parquet(source)
    words = spark.createDataFrame([("слово",)], "word string")
    streaming.write_clean(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), words).awaitTermination(120)
    assert {r.runs[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"да, нет", "слово"}
    q = streaming.clean_stream(stream).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.runs[0] for r in spark.table("cleaned").collect()} == {"да, нет", "сло- во"}


@pytest.mark.parametrize("mark", ["", R.MARK])
def test_contexts_where_matches_crowd(spark, mark):
    """Contexts reach over many matches; a text may hold the mark that it is cut at."""
    text = "а(c)(C)б (c)" * 9 + mark + "(c)" * 30 + "конец" + mark
    got = reported(spark, text, enabled={"sym-copy"})
    at = [i for i in range(len(text)) if text[i : i + 3].lower() == "(c)"]
    want = [(text[max(i - 12, 0) : i] + "⟦" + text[i : i + 3] + "⟧" + text[i + 3 : i + 15], text[i : i + 3], "©") for i in at]
    assert [(r.context, r.before, r.after) for r in got if r.rule_id == "sym-copy"] == want


def test_contexts_show_what_was_changed_before_in_the_same_step(spark):
    text = "в " * 20 + "дом, 1-2, 3-4, 5 г. 6 г. 7 г. и"
    changed = "".join(N if c == " " and text[i - 1] == "в" else c for i, c in enumerate(text))
    got = [r for r in reported(spark, text, enabled={"nbsp-prep"}) if r.rule_id == "nbsp-prep"]
    assert [r.context for r in got] == [changed[max(2 * k - 12, 0) : 2 * k] + "⟦в ⟧" + text[2 * k + 2 : 2 * k + 14] for k in range(20)]


@pytest.mark.parametrize("rule", [r for r in R.STEPS if r.pattern and len(r.passes) == 1], ids=lambda r: r.id)
def test_a_text_without_the_mark_is_looked_through_once(rule):
    """By the rule's own pattern: what is cut apart is marked, and the mark is what the text is split at."""
    pattern = R.literal(rule.spans or rule.pattern)
    sql = R._pieces("x", rule.spans or rule.pattern)
    usual = sql[sql.index("split(regexp_replace(") :]
    assert usual.count(pattern) == 1 and "rlike" not in R._spans("x", rule.spans or rule.pattern, "t.m", "''", "0", "'A'")


def test_numbers_of_findings_are_int(spark):
    d = spark.createDataFrame([(0, ["а"])], "doc_id long, runs array<string>")
    assert dict(cleaning.findings(d).dtypes) | {"step": "int", "run_ord": "int", "match_ord": "int"} == dict(cleaning.findings(d).dtypes)


def test_hints_stand_in_every_text_that_a_rule_finds_something_in(spark):
    """A rule's hint is looked for first; where it isn't found, the rule doesn't run. It must change nothing."""
    rng = random.Random(7)
    signs = ['"', " ", N, "\t", "а", "в", "т", "Д", "x", "c", "-", "–", "—", ".", "…", ",", "(", ")", "«", "»", "'", "%", "№", "0", "5", "к", "м", chr(0xAD)]
    d = spark.createDataFrame([("".join(rng.choice(signs) for _ in range(rng.randrange(14))),) for _ in range(4000)], "r string")
    for rule in R.STEPS:
        if rule.pattern and (rule.hint or rule.needs):
            found = [f"r rlike {R.literal(rule.spans or rule.pattern)}", *[f"r rlike {R.literal(p)}" for p, _ in rule.further]]
            seen = "true" if rule.mutates else f"{R.run_counts(replace(rule, hint='', needs=()), 'r')} > 0"
            hit = d.where(f"({' or '.join(found)}) and {seen}")
            assert hit.where(f"not {R.hinted(rule, 'r', 'true', 'false')}").count() == 0, rule.id
    assert {r.id for r in R.STEPS if r.needs} >= {"sp-ws", "dash-range", "nbsp-num"}
