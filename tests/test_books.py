"""Metadata, trees, the parser and packaging."""

import base64
import io
import random
import zipfile
from xml.dom import minidom

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import metadata as M
from lectern.functions import text_rules as R
from lectern.operators import assembly, books, cleaning, structure
from lectern.sources import covers, fb2

BOOK = """<?xml version="1.0" encoding="{encoding}"?>
<FictionBook xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><author><first-name>Лев</first-name><last-name>Толстой</last-name></author>
<book-title>Пример книги</book-title><annotation><p>О книге</p></annotation><keywords>тест, книга, </keywords><date>1869</date><coverpage><image l:href="#cover.jpg"/></coverpage><lang>ru</lang><sequence name="Ряд" number="2"/></title-info>
<document-info><program-used>FB Editor</program-used><id>abc-123</id></document-info><publish-info><publisher>Издательство</publisher><city>Москва</city><year>2020</year><isbn>978-5-00000-000-0</isbn></publish-info></description>
<body><section id="ch1"><title><p>Глава первая</p></title><p>Это <strong>первый</strong> абзац с <emphasis>выделением</emphasis> и сноской<a l:href="#note1" type="note">[1]</a>.</p><empty-line/><empty-line/><p>Дальше &amp; &nbsp; &nix;</p>
<section id="ch1-1"><title><p>Подглава</p></title><p>Текст <unknown>в обёртке</unknown></p></section></section>
<section><title><p>Глава вторая</p></title><poem><stanza><v>Строка раз</v><v>Строка два</v></stanza><text-author>Кто</text-author></poem><table><tr><th colspan="2" align="left">Шапка</th></tr></table><image l:href="#cover.jpg"/></section></body>
<body name="notes"><section id="note1"><title><p>1</p></title><p>Примечание</p></section></body><binary id="cover.jpg" content-type="image/jpeg">{image}</binary><binary id="" content-type="x">AAAA</binary><binary id="bad">?</binary></FictionBook>"""
IMAGE = base64.b64encode(b"not really").decode()


def sample(encoding="utf-8", declared=None):
    return BOOK.format(encoding=declared or encoding, image=IMAGE).encode(encoding, "xmlcharrefreplace")


def column(spark, values, f):
    d = spark.createDataFrame(list(enumerate(values)), "n long, x string")
    rows = dict(d.select("n", f(F.col("x")).alias("y")).collect())
    return [rows[i] for i in range(len(values))]


def test_names_and_titles(spark):
    names = ["", "Толстой", "Лев Толстой", "Лев Николаевич Толстой", "а б в г"]
    assert [tuple(r) for r in column(spark, names, M.split_name)] == [("", "", ""), ("", "", "Толстой"), ("Лев", "", "Толстой"), ("Лев", "Николаевич", "Толстой"), ("а", "б в", "г")]
    titles = {"Волоколамское шоссе [litres]": "Волоколамское шоссе", "Книга {fb2}": "Книга", "[Серия] Название": "Название", "Просто название": "Просто название", "Название litres": "Название"}
    assert column(spark, list(titles), M.clean_title) == list(titles.values())
    files = {"Волоколамское шоссе": "Волоколамское шоссе", 'Имя: "под/раздел"': "Имя под раздел", "Книга?*|<>": "Книга", "  лишние   пробелы  ": "лишние пробелы", "точка в конце.": "точка в конце", "я" * 130: "я" * 120}
    assert column(spark, list(files), M.safe_file_name) == list(files.values())
    assert column(spark, ["", "1a", "a/b", "a:b", "-x.y"], M.safe_id) == ["", "_a", "a_b", "a_b", "_x.y"]
    assert column(spark, ["UTF8", "cp1251", " KOI8 ", "x"], M.canonical_encoding) == ["utf-8", "windows-1251", "koi8-r", "x"]
    assert column(spark, ["dir/a b.png", "", "/", "я"], M.safe_image_name) == ["a_b.png", "img", "_", "_"]


def test_paths(spark):
    pairs = [("t/a.x", "t/b.x", "b.x"), ("nav.x", "t/b.x", "t/b.x"), ("t/a.x", "images/i.png", "../images/i.png"), ("a/b/c.x", "a/d.x", "../d.x"), ("a.x", "b.x", "b.x")]
    d = spark.createDataFrame(pairs, "a string, b string, want string")
    assert all(r[0] == r[1] for r in d.select(M.relative_path(F.col("a"), F.col("b")), "want").collect())


def test_encodings(spark):
    whole = [fb2.decode(sample(e)) for e in ("utf-8", "windows-1251", "koi8-r")]
    assert all("Пример книги" in t for t in whole)
    assert "Пример книги" in fb2.decode(sample("windows-1251", "utf-8"))  # a lie
    assert "Пример" in fb2.decode(b"\xff\xfe" + "Пример".encode("utf-16-le")) and fb2.decode(b"\xef\xbb\xbfx") == "x"
    assert fb2.decode(b"<?xml encoding='nix'?>\xff") is None and fb2.decode(b"") == ""
    contents = [sample(), sample("windows-1251"), sample("windows-1251", "utf-8"), sample("koi8-r")]
    d = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "n long, c binary")
    found = [r[0] for r in d.orderBy("n").select(M.detected_encoding(F.col("c"))).collect()]
    assert found == ["utf-8", "windows-1251", "windows-1251 (declared utf-8/none)", "koi8-r"]


def test_parser():
    b = fb2.parse(sample("windows-1251"))
    assert (b["title"], b["lang"], b["date"], b["publisher"], b["city"], b["year"], b["isbn"], b["doc_id"], b["program"], b["cover"]) == ("Пример книги", "ru", "1869", "Издательство", "Москва", "2020", "978-5-00000-000-0", "abc-123", "FB Editor", "cover.jpg")
    assert b["authors"] == [{"first": "Лев", "middle": "", "last": "Толстой", "nick": ""}] and b["keywords"] == ["тест", "книга"] and b["series"] == {"name": "Ряд", "number": "2"}
    assert [(s["id"], s["depth"], s["parent_ord"], s["title"], s["body"]) for s in b["sections"]] == [("ch1", 1, None, "Глава первая", ""), ("ch1-1", 2, 0, "Подглава", ""), ("", 1, None, "Глава вторая", ""), ("note1", 1, None, "1", "notes")]
    first = next(x for x in b["blocks"] if x["role"] == "content")
    assert "".join(r["text"] for r in first["runs"]) == "Это первый абзац с выделением и сноской[1]."
    assert [r["style"] for r in first["runs"]][1] == ["strong"] and any(r["note"] and r["href"] == "#note1" for r in first["runs"])
    texts = ["".join(r["text"] for r in x["runs"]) for x in b["blocks"] if x["kind"] == "paragraph"]
    assert f"Дальше & {chr(0xA0)} &nix;" in texts and "Текст в обёртке" in texts
    assert [x["data"] for x in b["binaries"]] == [b"not really"]


def test_parser_tolerates_anything():
    whole = sample().decode()
    rng = random.Random(1)
    for _ in range(150):
        a, b = sorted(rng.randrange(len(whole)) for _ in range(2))
        fb2.parse((whole[:a] + whole[b:]).encode())
    cut = fb2.parse(whole[: whole.index("Подглава")].encode())
    assert cut["title"] == "Пример книги" and len(cut["sections"]) == 2
    assert fb2.parse(b"") is None and fb2.parse(b"<html></html>") is None
    assert fb2.parse(b"<FictionBook><body><section><p>a<p>b</section></body>")["sections"]


def test_relations(spark, tmp_path):
    (tmp_path / "a.fb2").write_bytes(sample())
    (tmp_path / "b.fb2").write_bytes(b"nothing")
    library = fb2.read(spark, str(tmp_path)).cache()
    assert library.count() == 1 and fb2.sections(library).count() == 4
    info = fb2.meta_info(library).first()
    assert (info.title, info.author, info.sections, info.has_cover) == ("Пример книги", "Лев Толстой", 2, True)
    assert fb2.text_runs(library).where("array_contains(style, 'strong')").first().text == "первый"
    new = covers.with_generated_cover(library, library.select("path", F.lit("image/png").alias("content_type"), F.lit(bytearray(b"x")).alias("data"))).first()
    assert new.cover == "gen-cover" and [b.id for b in new.binaries] == ["cover.jpg", "gen-cover"]
    packed = assembly.packages(library, "2020-01-01T00:00:00Z").first().epub
    with zipfile.ZipFile(io.BytesIO(packed)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED


def unpack(book, **kw):
    return {n: d for n, d in assembly.entries(book, "2020-01-01T00:00:00Z", **kw)}


def test_package():
    files = unpack(fb2.parse(sample()))
    for name, data in files.items():
        if name.endswith(("xhtml", "opf", "ncx", "xml")):
            minidom.parseString(data)
    chapter = files["OEBPS/text/chap_0001.xhtml"].decode()
    assert '<a href="notes.xhtml#note1" epub:type="noteref">[1]</a>' in chapter and chapter.count('class="empty-line"') == 1 and "<h2>Подглава</h2>" in chapter
    opf = files["OEBPS/content.opf"].decode()
    assert "urn:uuid:abc-123" in opf and "Толстой, Лев" in opf and 'properties="cover-image"' in opf
    assert 'epub:type="footnote" id="note1"' in files["OEBPS/text/notes.xhtml"].decode() and files["OEBPS/images/cover.jpg"] == b"not really"
    assert 'colspan="2"' in files["OEBPS/text/chap_0002.xhtml"].decode()
    assert files == unpack(fb2.parse(sample()))  # repeatable
    assert assembly.Preview(fb2.parse(sample())).html().startswith("<h1>Глава первая</h1><p>Это <b>первый</b>")


def text_book(body):
    return fb2.parse(f"<FictionBook><description><title-info><book-title>T</book-title></title-info></description><body>{body}</body></FictionBook>".encode())


def test_anchors_and_empty_paragraphs():
    files = unpack(text_book('<section id="a/b"><p>x</p></section><section id="a:b"><p><a href="#a:b">y</a> <a href="#gone">z</a></p></section>'))
    assert 'id="a_b"' in files["OEBPS/text/chap_0001.xhtml"].decode()
    second = files["OEBPS/text/chap_0002.xhtml"].decode()
    assert 'id="a_b-2"' in second and "#a_b-2" in second and 'href="#gone"' in second
    chapter = unpack(text_book(f'<section><p> {chr(0xA0)} </p><p>Настоящий</p><p id="keep"> </p></section>'))["OEBPS/text/chap_0001.xhtml"].decode()
    assert chapter.count("<p") == 2 and 'id="keep"' in chapter
    book = text_book("<section><p>ГЛАВА</p></section>")
    book["blocks"][0]["heading"] = True
    files = unpack(book)
    assert 'class="detected-heading"' in files["OEBPS/text/chap_0001.xhtml"].decode() and "ГЛАВА" in files["OEBPS/nav.xhtml"].decode()


def test_large_chapters_are_split():
    body = "<section><p>top</p>" + "".join(f"<section><p>{'x' * n}</p></section>" for n in (100, 100, 400, 100)) + "</section>"
    layout = assembly.Layout(text_book(body), 300)
    assert [layout.file[s] for s in range(5)] == [f"text/chap_{k:04d}.xhtml" for k in (1, 2, 2, 3, 4)]


def test_trees(spark):
    rows = [(1, 0, None, 1, [0], 50), (1, 1, 0, 2, [0, 1], 130), (1, 2, 0, 2, [0, 2], 130), (1, 3, 0, 2, [0, 3], 430), (1, 4, 0, 2, [0, 4], 130), (2, 0, None, 1, [0], 10)]
    d = spark.createDataFrame(rows, "book long, sec_ord long, parent_ord long, depth int, path array<long>, own_size long")
    sizes = structure.subtree_sizes(d)
    assert {(r.book, r.sec_ord): r.size for r in sizes.collect()}[(1, 0)] == 870
    files = {(r.book, r.sec_ord): r.file[-7] for r in structure.split_files(d.join(sizes, ["book", "sec_ord"]), 300).collect()}
    assert files == {(1, 0): "1", (1, 1): "2", (1, 2): "2", (1, 3): "3", (1, 4): "4", (2, 0): "1"}
    assert {r.nav_depth for r in structure.navigation(d).where("book = 1").collect()} == {2}


@pytest.mark.parametrize(("bases", "want"), [(["x", "x", "x"], ["x", "x-2", "x-3"]), (["x", "x", "x-2"], ["x", "x-2", "x-2-2"]), (["x-2", "x", "x"], ["x-2", "x", "x-3"]), (["a", "b"], ["a", "b"])])
def test_unique_names(spark, bases, want):
    d = spark.createDataFrame([(1, i, b) for i, b in enumerate(bases)], "book long, ord long, base string")
    assert [r.name for r in structure.unique_names(d).orderBy("ord").collect()] == want


def test_wrapping_and_lines(spark):
    assert column(spark, ["aa bb cc", "", "toolongword x"], lambda c: covers.wrap_lines(c, 5)) == [["aa bb", "cc"], [], ["toolongword", "x"]]
    d = spark.createDataFrame([(1, 0, i, k) for i, k in enumerate(["p", "empty-line", "empty-line", "p", "empty-line"])], "book long, parent long, ord long, kind string")
    assert sorted(r.ord for r in structure.collapse_empty_lines(d).collect()) == [0, 1, 3, 4]


def test_templates_and_settings(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "c.txt", "d"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in covers.templates(spark, str(tmp_path)).collect()] == ["a.jpg", "b.PNG"]
    made = column(spark, ['{"width": 5, "jpegQuality": 101, "plateWidth": 0.5}', "{}", "junk"], covers.config)
    assert [(c.width, c.jpegQuality, c.plateWidth, c.plateCenterY) for c in made] == [(5, 88, 0.5, 0.3), (0, 88, 0.8, 0.3), (0, 88, 0.8, 0.3)]


def test_packages_and_queries_agree_on_names(spark):
    """The packager works row by row in Python, the queries with columns: both must say the same."""
    rng = random.Random(3)
    ids = ["".join(rng.choice("aZ09_-./: ёé\"<") for _ in range(rng.randrange(0, 8))) for _ in range(200)]
    assert column(spark, ids, M.safe_id) == [assembly.safe_id(x) for x in ids]
    paths = ["/".join(rng.choice("ab") for _ in range(rng.randrange(0, 4))) + "/f.x" for _ in range(60)]
    paths = [p.lstrip("/") for p in paths]
    pairs = [(a, b) for a in paths[:20] for b in paths[20:]]
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", M.relative_path(F.col("a"), F.col("b")).alias("p"))
    assert all(r.p == assembly.relative(r.a, r.b) for r in d.collect())
    parts = ("", "Лев", " x")
    people = [{"first": a, "middle": b, "last": c, "nick": e} for a in parts[:2] for b in parts[:2] for c in parts[:2] for e in parts[:2]]
    d = spark.createDataFrame([(i, *p.values()) for i, p in enumerate(people)], "n long, first string, middle string, last string, nick string")
    c = [F.col(x) for x in ("first", "middle", "last", "nick")]
    for r in d.select("n", M.display_name(*c).alias("shown"), M.file_as(*c).alias("filed")).collect():
        assert (r.shown, r.filed) == (assembly.person_name(people[r.n]), assembly.filed_name(people[r.n]))
    contents = [sample(e) for e in ("utf-8", "windows-1251", "koi8-r")] + [b"\xff\xfe" + "x".encode("utf-16-le"), b"\xfe\xff" + "x".encode("utf-16-be"), b"\xef\xbb\xbfx", b""]
    d = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(contents)], "n long, c binary")
    found = dict(d.select("n", M.detected_encoding(F.col("c"))).collect())
    assert [found[i] for i in range(3)] == ["utf-8", "windows-1251", "koi8-r"] and all(fb2.decode(x) is not None for x in contents)


def shelf(spark, *bodies):
    text = lambda b: f"<FictionBook xmlns:l='x'><description><title-info><book-title>T</book-title></title-info></description>{b}</FictionBook>"
    return fb2.parse_files(spark.createDataFrame([(str(i), bytearray(text(b).encode())) for i, b in enumerate(bodies)], "path string, content binary"))


def test_books_are_cleaned_where_they_stand(spark):
    words = spark.createDataFrame([("слово",)], "word string")
    body = (
        "<body><title><p>Том, часть,вторая</p></title><epigraph><p>мало,много</p></epigraph><section id='a'><title><p> Глава -- раз </p></title><p> - Да,<strong> нет </strong> </p><p>сло- во... <emphasis>-- </emphasis></p>"
        "<poem><stanza><v>раз,два</v></stanza></poem><p>ГЛАВА ПЯТАЯ</p><section id='b'><p>42</p><table><tr><td>1,а</td></tr></table></section></section></body><body name='notes'><section id='n'><p>да,да</p></section></body>"
    )
    made = shelf(spark, body, "<body><section><p>чисто</p></section></body>")
    plain = books.clean(made, dictionary=words).where("path = '0'").first()
    texts = ["".join(r.text for r in b.runs) for b in plain.blocks if b.runs]
    chapter = f"Глава{chr(0xA0)}— раз"
    assert texts == ["Том, часть, вторая", "мало, много", chapter, "— Да, нет ", "слово… — ", "раз, два", "ГЛАВА ПЯТАЯ", "42", "1, а", "да, да"]
    assert [s.title for s in plain.sections] == ["Том, часть, вторая", chapter, "", ""] and not any(b.heading for b in plain.blocks)
    f = books.findings(made, dictionary=words)
    rows = f.where("book = '0'").orderBy("cont_ord", "step", "run_ord", "match_ord").collect()
    assert [(r.rule_id, r.section) for r in rows if r.rule_id in ("sp-after-punct", "dehyph", "heading-detect", "page-number")] == [
        ("sp-after-punct", ""), ("sp-after-punct", ""), ("dehyph", "a"), ("sp-after-punct", "a"), ("sp-after-punct", "b"), ("sp-after-punct", "n"), ("heading-detect", "a"), ("page-number", "b")]
    assert [r.context for r in rows if r.rule_id == "sp-trim"] == ["⟦ Глава -- раз ⟧ → ⟦Глава -- раз ⟧", "⟦Глава -- раз ⟧ → ⟦Глава -- раз⟧", "⟦ - Да,⟧ → ⟦- Да,⟧", "⟦ ⟧ → ⟦⟧"]
    assert [(r.run_ord, r.match_ord) for r in rows if r.rule_id == "dash-multi" and r.before == "--"][-1] == (1, 0)
    marked = books.clean(made, R.DEFAULT | {"heading-detect"}, words)
    files = {r.name: r.content.decode() for r in assembly.package_entries(marked.where("path = '0'"), "2020-01-01T00:00:00Z").collect() if not r.name.endswith("png")}
    assert '<h4 id="h_1" class="detected-heading">ГЛАВА ПЯТАЯ</h4>' in files["OEBPS/text/chap_0001.xhtml"] and "ГЛАВА ПЯТАЯ" in files["OEBPS/nav.xhtml"]
    assert "<h1>Том, часть, вторая</h1>" in files["OEBPS/text/front_00.xhtml"] and "<title>Том, часть, вторая</title>" in files["OEBPS/text/front_00.xhtml"]
    assert files["OEBPS/content.opf"].index('idref="front_00"') < files["OEBPS/content.opf"].index('idref="chap_0001"')
    assert books.clean(made, frozenset()).where("path = '1'").first().blocks[0].runs[0].text == "чисто"
    assert books.clean(made.limit(0)).count() == 0


def test_a_book_is_parsed_once(spark):
    """Three branches read the parsed books, and one of findings and blocks more; the parse is run for each book once."""
    from pyspark.sql.pandas.types import from_arrow_schema

    parsed = spark.sparkContext.accumulator(0)
    content = "<FictionBook><body><section id='a'><p>Он - я, сло- во  и</p><p>42</p></section></body></FictionBook>".encode()

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                parsed.add(1)
                yield pa.RecordBatch.from_pylist([{"path": path, **fb2.parse(content)}], fb2.SCHEMA)

    df = spark.createDataFrame([(str(k),) for k in range(6)], "path string").mapInArrow(run, from_arrow_schema(fb2.SCHEMA))
    words = spark.createDataFrame([("слово",)], "word string")
    found = books.findings(df, dictionary=words).collect()
    assert parsed.value == 6
    assert {r.section for r in found} == {"a"} and sum(r.rule_id == "dehyph" for r in found) == 6 and sum(r.rule_id == "page-number" for r in found) == 6


BODY = (
    "<body><title><p>Том - раз, два</p></title><section id='a'><title><p>Глава</p><p> </p><p>ПЕРВАЯ</p></title><p> Он сказал \"да \"нет\" да\" - и ушёл -- так, сло- во и к дому</p><p>ккк- ппп  xа д0м т. д.</p>"
    "<p>ГЛАВА ПЯТАЯ</p><section id='b'><p>42</p><p>- Да<strong>,нет (c) 5 %</strong></p></section></section><section id='b'><p>раз  два</p></section></body>"
)


def test_rules_run_once_for_each_book(spark):
    """Where blocks are taken out of cleaned books, the planner must not infer filters that clean them once more; with few split words no book is shuffled."""
    words = spark.createDataFrame([("слово",)], "word string")
    df = fb2.blocks(books.clean(shelf(spark, BODY, BODY), R.DEFAULT | {"heading-detect"}, words)).where("kind = 'paragraph'").select("book", "runs", "heading")
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count(R.BY_ID["dash-multi"].pattern) == 1 and "Join" not in plan and "Union" not in plan
    assert "Он сказал «да „нет“ да» — и ушёл — так, слово и к дому" in ["".join(r.text for r in b.runs).replace(chr(0xA0), " ") for b in df.where("book = '0'").collect()]


def test_many_split_words_meet_the_dictionary_in_a_join(spark, monkeypatch):
    words = spark.createDataFrame([("слово",)], "word string")
    few = books.clean(shelf(spark, BODY), dictionary=words).first()
    monkeypatch.setattr(cleaning, "FEW", 1)
    assert books.clean(shelf(spark, BODY), dictionary=words).first() == few


@pytest.mark.parametrize("only", [None, {"quotes", "dehyph", "mixed-alpha", "ocr-digit"}, {"heading-detect", "page-number"}, {"sp-trim"}])
def test_findings_of_sections_are_counted_without_being_made(spark, only):
    words = spark.createDataFrame([("слово",)], "word string")
    made = shelf(spark, BODY, BODY.replace("Он", "Она"), "<body><section><p>чисто</p></section></body>")
    enabled = R.DEFAULT | {"ell-two"}
    names = ["book", "section", "rule_id", "level"]
    found = books.findings(made, enabled, words, only).groupBy(*names).count().collect()
    counted = books.finding_counts(made, enabled, words, only).collect()
    assert sorted(map(tuple, counted)) == sorted(map(tuple, found)) and counted
    assert only is not None or {("dehyph", "B"), ("dehyph", "C"), ("quotes", "B"), ("page-number", "C"), ("ocr-digit", "C"), ("mixed-alpha", "C")} <= {(r.rule_id, r.level) for r in counted}
