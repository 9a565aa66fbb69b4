"""Packaged e-books out of parsed ones.

A book is one row with nested sections, blocks and binaries; each is packed where it lies, so nothing is shuffled. What goes in
is decided by rows: files, anchors, images and navigation are laid out first, then everything is rendered against that layout, so
links may point ahead. Packing is repeatable: images come in the order of their ids, and the time is a parameter.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Collection, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.metadata import EXTENSIONS, MEDIA_TYPES, UNTITLED
from .structure import INLINE_IMAGE, LINK, STYLED, TAG, THRESHOLD

XML = '<?xml version="1.0" encoding="utf-8"?>\n'
CONTAINER = XML + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'
CSS = "body { margin: 5%; }\n.poem { margin: 1em 2em; }\n.cite, .epigraph { margin: 1em 2em; }\n.empty-line { height: 1em; }\n"
#: Element names of styles.
STYLE_TAGS = {"strong": "strong", "emphasis": "em", "strikethrough": "s", "sub": "sub", "sup": "sup", "code": "code"}
#: Files of chapters and of the bodies' own titles.
CHAPTERS = ("text/chap", "text/front")
CONTENTS, COVER, NOTES, TEXT = "Содержание", "Обложка", "Примечания", "Текст"


def el(tag: str, *content: str, **attrs: str | None) -> str:
    """An element. Attributes that are None are left out; _ stands for - and __ for :."""
    named = "".join(f' {k.rstrip("_").replace("__", ":").replace("_", "-")}="{escape(v, {chr(34): "&quot;"})}"' for k, v in attrs.items() if v is not None)
    return f"<{tag}{named}>{''.join(content)}</{tag}>" if content else f"<{tag}{named}/>"


def safe_id(s: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.\-]", "_", re.sub(r"^[^A-Za-z_]", "_", s)) if s else ""


def relative(source: str, target: str) -> str:
    a, b = source.split("/")[:-1], target.split("/")
    same = 0
    while same < min(len(a), len(b) - 1) and a[same] == b[same]:
        same += 1
    return "/".join([".."] * (len(a) - same) + b[same:])


def person_name(p: dict) -> str:
    if p["nick"] and not p["first"] and not p["last"]:
        return p["nick"]
    return " ".join(x for x in (p["first"], p["middle"], p["last"]) if x)


def filed_name(p: dict) -> str:
    rest = f"{p['first']} {p['middle']}".strip()
    return person_name(p) if not p["last"] else f"{p['last']}, {rest}" if rest else p["last"]


def identifier(book: dict) -> str:
    """The document's own id, else one made of title, authors and series."""
    if own := book["doc_id"].strip():
        return f"urn:uuid:{own}"
    series = book["series"]
    name = book["title"].strip() + "\0" + "".join(filed_name(a) + "\0" for a in book["authors"]) + (f"{series['name']}\0{series['number']}" if series else "")
    h = bytearray(hashlib.sha1(name.encode()).digest()[:16])
    h[6], h[8] = h[6] & 15 | 80, h[8] & 63 | 128
    x = h.hex()
    return f"urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"


class Layout:
    """Which file each section is in, what each anchor is called, and where ids and images are found."""

    def __init__(self, book: dict, threshold: int = THRESHOLD):
        self.book = book
        self.sections = book["sections"]
        self.kids: dict[int | None, list[int]] = {}
        self.content: dict[tuple[int, str], list[dict]] = {}
        self.inner: dict[int, list[dict]] = {}
        for s in self.sections:
            self.kids.setdefault(s["parent_ord"], []).append(s["sec_ord"])
        for b in book["blocks"]:
            if b["parent_block"] is None:
                self.content.setdefault((b["sec_ord"], b["role"]), []).append(b)
            else:
                self.inner.setdefault(b["parent_block"], []).append(b)
        self.images: dict[str, str] = {}
        self.used_files: set[str] = set()
        for b in sorted(book["binaries"], key=lambda b: b["id"]):
            self.images[b["id"]] = "images/" + self._image_file(b)
        self.cover = book["cover"] if book["cover"] in self.images else ""
        self.size = [0] * len(self.sections)
        for b in book["blocks"]:
            self.size[b["sec_ord"]] += self._weight(b)
        for s in reversed(self.sections):
            if s["parent_ord"] is not None:
                self.size[s["parent_ord"]] += self.size[s["sec_ord"]]
        self.file: dict[int, str] = {}
        self.roots: dict[str, list[int]] = {}
        self.anchor: dict[int, str] = {}  # of sections
        self.block_anchor: dict[int, str] = {}
        self.ids: dict[str, tuple[str, str]] = {}
        self.used: set[str] = set()
        self.count = self.auto = 0
        for top in self.kids.get(None, []):
            if self.sections[top]["depth"] == 0:
                self.file[top] = f"text/front_{len(self.roots) + bool(self.cover):02d}.xhtml"
                self.roots[self.file[top]] = [top]
            elif self.sections[top]["body"] != "notes":
                self._place(top, self._open(top), threshold)
        for n, s in enumerate((k for k in self.kids.get(None, []) if self.sections[k]["body"] == "notes"), 1):
            self.file[s] = "text/notes.xhtml"
            self.roots.setdefault("text/notes.xhtml", []).append(s)
            self.anchor[s] = self._unique(safe_id(self.sections[s]["id"]) or f"note_{n}")
            self._register(self.sections[s]["id"], self.file[s], self.anchor[s])

    @staticmethod
    def _weight(b: dict) -> int:
        # A verse or cell counts for itself, its group once.
        if b["kind"] in ("stanza", "tr", "title"):
            return 0
        inline = sum(len(r["text"].encode()) + STYLED * len(r["style"]) + LINK * bool(r["href"]) + INLINE_IMAGE * bool(r["image"]) for r in b["runs"])
        return TAG + inline if b["kind"] != "text-author" or b["parent_block"] is None else inline

    def _image_file(self, b: dict) -> str:
        name = re.sub(r"[^A-Za-z0-9._\-]", "_", b["id"].rstrip("/").rpartition("/")[2]) or "img"
        head, dot, tail = name.rpartition(".")
        head, ext = (head, dot + tail) if dot else (name, EXTENSIONS.get(b["content_type"].strip().lower(), ".img"))
        out, n = head + ext, 0
        while out in self.used_files:
            n += 1
            out = f"{head}_{n}{ext}"
        self.used_files.add(out)
        return out

    def _unique(self, base: str) -> str:
        out, n = base, 1
        while out in self.used:
            n += 1
            out = f"{base}-{n}"
        self.used.add(out)
        return out

    def _register(self, id_: str, file: str, anchor: str) -> None:
        if id_:
            self.ids[id_] = (file, anchor)

    def _open(self, s: int) -> str:
        self.count += 1
        name = f"text/chap_{self.count:04d}.xhtml"
        self.roots[name] = [s]
        return name

    def _mark(self, s: int, file: str) -> None:
        self.file[s] = file
        own = safe_id(self.sections[s]["id"])
        if not own:
            self.auto += 1
            own = f"sec_{self.auto}"
        self.anchor[s] = self._unique(own)
        self._register(self.sections[s]["id"], file, self.anchor[s])
        for b in self.content.get((s, "content"), []):
            if b["kind"] == "paragraph" and (b["id"] or b.get("heading")):
                own = safe_id(b["id"])
                if not own:
                    self.auto += 1
                    own = f"h_{self.auto}"
                self.block_anchor[b["block_ord"]] = self._unique(own)
                self._register(b["id"], file, self.block_anchor[b["block_ord"]])

    def _place(self, s: int, file: str, threshold: int) -> None:
        self._mark(s, file)
        room, shared = 0, ""
        for k in self.kids.get(s, []):
            if self.size[s] <= threshold:
                self._place(k, file, threshold)
            elif self.size[k] > threshold:
                self._place(k, self._open(k), threshold)
                shared = ""
            else:
                if not shared or room + self.size[k] > threshold:
                    shared, room = self._open(k), 0
                else:
                    self.roots[shared].append(k)
                self._place(k, shared, threshold)
                room += self.size[k]

    def title(self, s: int) -> str:
        return self.sections[s]["title"] or UNTITLED * bool(self.sections[s]["depth"])


class Renderer:
    def __init__(self, layout: Layout, file: str):
        self.l, self.file = layout, file

    def image(self, id_: str) -> str:
        return relative(self.file, self.l.images[id_]) if id_ in self.l.images else ""

    def inline(self, runs: list[dict]) -> str:
        out = []
        for r in runs:
            if r["image"]:
                src = self.image(r["image"])
                text = el("img", class_="inline", src=src, alt="") if src else ""
            else:
                text = escape(r["text"])
            for style in reversed(r["style"]):
                text = el(STYLE_TAGS[style], text) if style in STYLE_TAGS else el("span", text, class_="st-" + style.removeprefix("named:"))
            if r["href"]:
                href = r["href"]
                if href.startswith("#") and href[1:] in self.l.ids:
                    file, anchor = self.l.ids[href[1:]]
                    href = f"{relative(self.file, file)}#{anchor}"
                text = el("a", text, href=href, epub__type="noteref" if r["note"] else None)
            out.append(text)
        return "".join(out)

    def blocks(self, rows: list[dict]) -> str:
        out, before = [], ""
        for b in rows:
            if not (b["kind"] == before == "empty-line"):
                out.append(self.block(b))
            before = b["kind"]
        return "".join(out)

    def block(self, b: dict) -> str:
        kind, inner = b["kind"], self.l.inner.get(b["block_ord"], [])
        if kind == "paragraph":
            anchor = self.l.block_anchor.get(b["block_ord"]) or safe_id(b["id"])
            if b.get("heading"):
                return el("h4", self.inline(b["runs"]), id=anchor or None, class_="detected-heading") + "\n"
            if not anchor and not any(r["text"].strip() or r["href"] or r["image"] for r in b["runs"]):
                return ""
            return el("p", self.inline(b["runs"]), id=anchor or None, class_=f"st-{b['style']}" if b["style"] else None) + "\n"
        if kind in ("subtitle", "text-author"):
            return el("p", self.inline(b["runs"]), class_=kind) + "\n" if b["runs"] or kind == "subtitle" else ""
        if kind == "verse":
            return el("p", self.inline(b["runs"]), class_="v") + "\n"
        if kind == "cell":
            return el("th" if b["header"] else "td", self.inline(b["runs"]), colspan=str(b["colspan"]) if b["colspan"] > 1 else None, rowspan=str(b["rowspan"]) if b["rowspan"] > 1 else None)
        if kind == "empty-line":
            return el("div", "", class_="empty-line") + "\n"
        if kind == "image":
            src = self.image(b["href"])
            return el("div", el("img", src=src, alt=b["alt"]), class_="image") + "\n" if src else ""
        if kind == "title":
            return self.heading(inner, 4)
        if kind == "stanza":  # its own title and subtitle aren't shown
            inner = [x for x in inner if x["kind"] == "verse"]
        tag = {"cite": "blockquote", "table": "table", "tr": "tr"}.get(kind, "div")
        return el(tag, "\n", self.blocks(inner), class_=kind if tag in ("div", "blockquote") else None) + "\n"

    def heading(self, rows: list[dict], level: int) -> str:
        return el(f"h{min(level, 6)}", "<br/>".join(self.inline(b["runs"]) for b in rows if b["kind"] == "paragraph")) + "\n"

    def section(self, s: int) -> str:
        of = lambda role: self.l.content.get((s, role), [])
        row = self.l.sections[s]
        out = [self.heading(of("title"), max(1, row["depth"]))] if of("title") else []
        out += [self.block(b) for b in of("epigraph")]
        if src := self.image(row["image"]):
            out.append(el("div", el("img", src=src, alt=row["alt"]), class_="image") + "\n")
        if of("annotation"):
            out.append(el("div", "\n", self.blocks(of("annotation")), class_="annotation") + "\n")
        out.append(self.blocks(of("content")))
        out += [self.section(k) for k in self.l.kids.get(s, []) if self.l.file[k] == self.file]
        return el("section", "\n", *out, id=self.l.anchor.get(s)) + "\n"

    def note(self, s: int) -> str:
        title = "".join(self.inline(b["runs"]) for b in self.l.content.get((s, "title"), []) if b["kind"] == "paragraph")
        head = el("p", title, class_="note-title") + "\n" if title else ""
        return el("aside", "\n", head, self.blocks(self.l.content.get((s, "content"), [])), epub__type="footnote", id=self.l.anchor[s], class_="note") + "\n"


def page(lang: str, title: str, body: str, style: str = "../style.css") -> str:
    head = el("head", '<meta charset="utf-8"/>', el("title", escape(title)), el("link", rel="stylesheet", type="text/css", href=style))
    return XML + "<!DOCTYPE html>\n" + el("html", head, "\n", el("body", "\n", body), xmlns="http://www.w3.org/1999/xhtml", xmlns__epub="http://www.idpf.org/2007/ops", xml__lang=lang, lang=lang) + "\n"


def package(book: dict, layout: Layout, lang: str, docs: list[tuple[str, str, str]], modified: str) -> str:
    item, meta = lambda **a: el("item", **a) + "\n", lambda text, **a: el("meta", escape(text), **a) + "\n"
    dc = lambda tag, text, **a: el(f"dc:{tag}", escape(text), **a) + "\n"
    m = [dc("identifier", identifier(book), id="bookid"), dc("title", book["title"] or UNTITLED), dc("language", lang)]
    for i, a in enumerate(book["authors"]):
        m += [dc("creator", person_name(a), id=f"creator{i}"), meta("aut", refines=f"#creator{i}", property="role", scheme="marc:relators"), meta(filed_name(a), refines=f"#creator{i}", property="file-as")]
    for i, t in enumerate(book["translators"]):
        m += [dc("contributor", person_name(t), id=f"translator{i}"), meta("trl", refines=f"#translator{i}", property="role", scheme="marc:relators")]
    m += [dc("publisher", book["publisher"])] * bool(book["publisher"]) + [dc("subject", k) for k in book["keywords"]] + [dc("date", book["date"])] * bool(book["date"])
    m += [dc("description", book["annotation"])] * bool(book["annotation"]) + [dc("source", "urn:isbn:" + book["isbn"])] * bool(book["isbn"])
    if (s := book["series"]) and s["name"]:
        m += [meta(s["name"], property="belongs-to-collection", id="series"), meta("series", refines="#series", property="collection-type")]
        m += [meta(s["number"], refines="#series", property="group-position")] * bool(s["number"])
    m += [el("meta", name="cover", content="cover-image") + "\n"] * bool(layout.cover) + [meta(modified, property="dcterms:modified")]
    items = [item(id="nav", href="nav.xhtml", media_type="application/xhtml+xml", properties="nav"), item(id="ncx", href="toc.ncx", media_type="application/x-dtbncx+xml"), item(id="css", href="style.css", media_type="text/css")]
    items += [item(id=i, href=f, media_type="application/xhtml+xml") for f, i, _ in docs]
    for id_, file in layout.images.items():
        kind = MEDIA_TYPES.get("." + file.rpartition(".")[2], "application/octet-stream")
        items.append(item(id="cover-image" if id_ == layout.cover else "img-" + safe_id(id_), href=file, media_type=kind, properties="cover-image" if id_ == layout.cover else None))
    first = next((f for f, _, _ in docs if f.startswith(CHAPTERS)), "")
    guide = [el("reference", type="cover", title=COVER, href="text/cover.xhtml")] * bool(layout.cover) + [el("reference", type="toc", title=CONTENTS, href="nav.xhtml")] + [el("reference", type="text", title=TEXT, href=first)] * bool(first)
    parts = [el("metadata", "\n", *m, xmlns__dc="http://purl.org/dc/elements/1.1/"), el("manifest", "\n", *items), el("spine", *(el("itemref", idref=i) for _, i, _ in docs), toc="ncx"), el("guide", *guide)]
    return XML + el("package", "\n", "\n".join(parts), "\n", xmlns="http://www.idpf.org/2007/opf", version="3.0", unique_identifier="bookid", xml__lang=lang) + "\n"


def contents(layout: Layout, tops: list[int]) -> tuple[str, str, int]:
    """Navigation as a list, as numbered points, and its depth."""
    number = 0

    def tree(s: int) -> tuple[str, str, list]:
        """Title, place and what is below: headings found in the content, then sections."""
        heads = [b for b in layout.content.get((s, "content"), []) if b["kind"] == "paragraph" and b.get("heading")]
        below = [("".join(r["text"] for r in b["runs"]).strip(), f"{layout.file[s]}#{layout.block_anchor[b['block_ord']]}", []) for b in heads]
        return layout.title(s), f"{layout.file[s]}#{layout.anchor[s]}", [*below, *(tree(k) for k in layout.kids.get(s, []))]

    def points(rows: list) -> str:
        nonlocal number
        out = []
        for title, href, below in rows:
            number += 1
            n = str(number)
            label = el("navLabel", el("text", escape(title))) + el("content", src=href)
            out.append(el("navPoint", label, points(below), id=f"navpoint-{n}", playOrder=n))
        return "".join(out)

    def items(rows: list) -> str:
        return el("ol", *(el("li", el("a", escape(title), href=href), items(below)) for title, href, below in rows)) if rows else ""

    def depth(rows: list) -> int:
        return max((1 + depth(below) for _, _, below in rows), default=0)

    rows = [tree(s) for s in tops]
    return items(rows), points(rows), max(1, depth(rows))


def entries(book: dict, modified: str, threshold: int = THRESHOLD, names: Collection[str] | None = None) -> list[tuple[str, bytes]]:
    """Names and contents of the package's files, in their order. names: only these are rendered, the others are empty."""
    wanted = lambda name: names is None or name in names
    layout, lang = Layout(book, threshold), book["lang"].strip() or "ru"
    docs = [("text/cover.xhtml", "cover", COVER)] * bool(layout.cover)
    docs += [(f, f[5:-6], layout.title(roots[0])) for f, roots in layout.roots.items() if f.startswith(CHAPTERS)]
    docs += [("text/notes.xhtml", "notes", NOTES)] * ("text/notes.xhtml" in layout.roots)
    tops = [s for s in layout.kids.get(None, []) if layout.sections[s]["body"] != "notes" and layout.sections[s]["depth"]]
    listed, points, depth = contents(layout, tops)
    first = next((f for f, _, _ in docs if f.startswith(CHAPTERS)), "")
    marks = [el("li", el("a", COVER, epub__type="cover", href="text/cover.xhtml"))] * bool(layout.cover) + [el("li", el("a", TEXT, epub__type="bodymatter", href=first))] * bool(first)
    nav = el("nav", el("h1", CONTENTS), listed, epub__type="toc", id="toc") + el("nav", el("ol", *marks), epub__type="landmarks", id="landmarks", hidden="")
    head = el("head", *(el("meta", name=f"dtb:{k}", content=v) for k, v in (("uid", identifier(book)), ("depth", str(depth)), ("totalPageCount", "0"), ("maxPageNumber", "0"))))
    ncx = XML + el("ncx", head, el("docTitle", el("text", escape(book["title"] or UNTITLED))), el("navMap", points), xmlns="http://www.daisy.org/z3986/2005/ncx/", version="2005-1", xml__lang=lang) + "\n"
    out = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", CONTAINER), ("OEBPS/content.opf", package(book, layout, lang, docs, modified)), ("OEBPS/nav.xhtml", page(lang, CONTENTS, nav, "style.css")), ("OEBPS/toc.ncx", ncx), ("OEBPS/style.css", CSS)]
    for file, kind, title in docs:
        if not wanted(f"OEBPS/{file}"):
            out.append((f"OEBPS/{file}", ""))
            continue
        r = Renderer(layout, file)
        if kind == "cover":
            body = el("div", el("img", src=r.image(layout.cover), alt=COVER), class_="cover") + "\n"
        else:
            body = "".join(map(r.note if kind == "notes" else r.section, layout.roots[file]))
        out.append((f"OEBPS/{file}", page(lang, title, body)))
    data = {b["id"]: b["data"] for b in book["binaries"]}
    return [(n, t.encode()) for n, t in out] + [(f"OEBPS/{file}", data[id_]) for id_, file in layout.images.items()]


def zipped(files: list[tuple[str, bytes]]) -> bytes:
    """The first entry is stored, the others are deflated; times are fixed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, (name, data) in enumerate(files):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED)
    return out.getvalue()


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """One book after the other: only one is held as Python objects."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def package_entries(books: DataFrame, modified: str, threshold: int = THRESHOLD, names: Collection[str] | None = None) -> DataFrame:
    """book, entry_ord, name, content; names: of these entries only"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for book in rows_of(b):
                files = [(k, n, d) for k, (n, d) in enumerate(entries(book, modified, threshold, names)) if names is None or n in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([book["path"]] * len(files)), pa.array([k for k, _, _ in files], pa.int32()), pa.array([n for _, n, _ in files], pa.string()), pa.array([d for _, _, d in files], pa.binary())], ["book", "entry_ord", "name", "content"]
                )

    return books.mapInArrow(run, "book string, entry_ord int, name string, content binary")


def packages(books: DataFrame, modified: str, threshold: int = THRESHOLD) -> DataFrame:
    """book, epub (the packed file)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for book in rows_of(b):
                yield pa.RecordBatch.from_arrays([pa.array([book["path"]]), pa.array([zipped(entries(book, modified, threshold))], pa.binary())], ["book", "epub"])

    return books.mapInArrow(run, "book string, epub binary")


#: What a preview shows at most, and what it says.
PREVIEW_BLOCKS = 400
PREVIEW_TAGS = {"strong": "b", "emphasis": "i", "strikethrough": "s", "sub": "sub", "sup": "sup", "code": "code"}
NO_CHAPTERS, CUT, PICTURE = "В книге нет глав для предпросмотра.", "… (предпросмотр первой главы усечён)", "[изображение]"


class Preview:
    """The first chapter as simple markup; nested blocks count too."""

    def __init__(self, book: dict):
        self.layout, self.count = Layout(book), 0

    def text(self, runs: list[dict]) -> str:
        out = []
        for r in runs:
            t = escape(r["text"], {'"': "&#34;", "'": "&#39;"})
            for s in reversed(r["style"]):
                t = el(PREVIEW_TAGS[s], t) if s in PREVIEW_TAGS else t
            out.append(t)
        return "".join(out)

    def blocks(self, rows: list[dict]) -> str:
        out = []
        for b in rows:
            if self.count >= PREVIEW_BLOCKS:
                break
            self.count += 1
            out.append(self.block(b))
        return "".join(out)

    def block(self, b: dict) -> str:
        kind, inner = b["kind"], self.layout.inner.get(b["block_ord"], [])
        simple = {"paragraph": None, "subtitle": "sub", "text-author": "author"}
        if kind in simple:
            return el("p", self.text(b["runs"]), class_=simple[kind])
        if kind == "empty-line":
            return el("div", "", class_="el")
        if kind == "image":
            return el("p", PICTURE, class_="img")
        if kind == "poem":
            verses = [v for s in inner if s["kind"] == "stanza" for v in self.layout.inner.get(s["block_ord"], []) if v["kind"] == "verse"]
            return el("div", *(el("p", self.text(v["runs"]), class_="v") for v in verses), "", class_="poem")
        if kind in ("cite", "epigraph"):
            authors = [x for x in inner if x["kind"] == "text-author"]
            body = self.blocks([x for x in inner if x["kind"] != "text-author"])
            if kind == "cite":
                return el("blockquote", body, *(el("p", self.text(a["runs"]), class_="author") for a in authors[-1:]))
            return el("div", body, class_="epi")
        return ""

    def section(self, s: int, depth: int) -> str:
        title = [b for b in self.layout.content.get((s, "title"), []) if b["kind"] == "paragraph"]
        out = [el(f"h{min(depth, 6)}", "<br/>".join(self.text(b["runs"]) for b in title))] * bool(self.layout.content.get((s, "title")))
        out.append(self.blocks(self.layout.content.get((s, "content"), [])))
        for k in self.layout.kids.get(s, []):
            if self.count >= PREVIEW_BLOCKS:
                break
            out.append(self.section(k, depth + 1))
        return "".join(out)

    def html(self) -> str:
        first = next((s for s in self.layout.kids.get(None, []) if self.layout.sections[s]["body"] != "notes" and self.layout.sections[s]["depth"]), None)
        if first is None:
            return el("p", NO_CHAPTERS)
        out = self.section(first, 1)
        return out + el("p", CUT, class_="more") if self.count >= PREVIEW_BLOCKS else out


def previews(books: DataFrame) -> DataFrame:
    """book, html"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for book in rows_of(b):
                yield pa.RecordBatch.from_arrays([pa.array([book["path"]]), pa.array([Preview(book).html()])], ["book", "html"])

    return books.mapInArrow(run, "book string, html string")
