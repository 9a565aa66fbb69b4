"""Book markup (FB2) as relations.

A file is decoded, read into a tree by a tolerant reader, and flattened. Files are small and independent, so each is one row of a
binary-file scan and is parsed where it lies, in Arrow batches; everything after the parse is DataFrame work on nested columns. The
reader never fails on bad markup: an element that is closed too late is closed early, and what can't be read ends the book
there, with all that came before.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import ENCODING_ALIASES

SPACE = "\t\n\x0b\f\r \x85\xa0"
#: Bytes of files after which their books are handed on.
BATCH = 1 << 18
STYLES = ("strong", "emphasis", "strikethrough", "sub", "sup", "code")
_PROLOG = re.compile(rb"""<\?xml[^>]*?encoding\s*=\s*["']([^"']+)["']""", re.IGNORECASE)
_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<data>.*?)\]\]>|<\?.*?\?>|<![^>]*>|<(?P<end>/)?(?P<name>[A-Za-z_][\w.:\-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/)?>", re.DOTALL)
#: A tag without attributes, as most are; what _TOKEN would make of it.
_PLAIN = re.compile(r"<(/?)([A-Za-z_][\w.:\-]*)>")
_ATTR = re.compile(r"""([\w.:\-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|\w+);")


def decode(raw: bytes) -> str | None:
    """The text of a file, by its mark, its declaration, or what its bytes allow; None if it says what nobody knows and isn't UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    found = _PROLOG.search(raw[:1024])
    declared = found[1].decode("latin-1").strip().lower() if found else ""
    declared = ENCODING_ALIASES.get(declared, declared)
    names = ["utf-8", "windows-1251"] if declared in ("", "utf-8") else [declared, "utf-8"]
    try:
        return raw.decode(names[0], "strict" if names[0] == "utf-8" else "replace")
    except LookupError:
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    except UnicodeDecodeError:
        return raw.decode(names[1], "replace")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Node | str] = field(default_factory=list)

    def nodes(self, *tags: str) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node) and (not tags or k.tag in tags)]

    def last(self, tag: str) -> Node | None:
        return next(iter(self.nodes(tag)[::-1]), None)

    def own_text(self) -> str:
        """The text directly inside, without that of nested markup."""
        return "".join(k for k in self.kids if isinstance(k, str)).strip(SPACE)

    def text_of(self, tag: str) -> str:
        node = self.last(tag)
        return node.own_text() if node else ""

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    @property
    def target(self) -> str:
        return self.get("href").removeprefix("#")


def _entities(s: str) -> str:
    return _ENTITY.sub(lambda m: html.unescape(m[0]), s) if "&" in s else s


def _close(open_: list[Node], tag: str) -> bool:
    """Takes what ends with the tag off the stack; False if the tag closes what was never opened."""
    if all(n.tag != tag for n in open_[1:]):
        return False
    while open_.pop().tag != tag:
        pass
    return True


def read_tree(text: str) -> Node:
    """Everything that can be read, under a root without a name."""
    root = Node("")
    open_ = [root]
    at = 0
    while at < len(text):
        if m := _PLAIN.match(text, at):
            at = m.end()
            closes, tag = m.groups()
            if ":" in tag:
                tag = tag.rpartition(":")[2]
            if not closes:
                node = Node(tag)
                open_[-1].kids.append(node)
                open_.append(node)
            elif len(open_) > 1 and open_[-1].tag == tag:
                open_.pop()
            elif not _close(open_, tag):
                break
            continue
        if text[at] != "<":
            end = text.find("<", at)
            s = _entities(text[at:] if end < 0 else text[at:end])
            at = len(text) if end < 0 else end
            kids = open_[-1].kids
            if kids and isinstance(kids[-1], str):
                kids[-1] += s
            else:
                kids.append(s)
            continue
        m = _TOKEN.match(text, at)
        if not m:
            break  # no markup: the book ends here
        at = m.end()
        if m["data"] is not None:
            s = m["data"]
            kids = open_[-1].kids
            if kids and isinstance(kids[-1], str):
                kids[-1] += s
            else:
                kids.append(s)
        elif m["name"]:
            tag = m["name"].rpartition(":")[2]
            if m["end"]:
                if not _close(open_, tag):
                    break
                continue
            attrs: dict[str, str] = {}
            for name, a, b, c in _ATTR.findall(m["attrs"]):
                attrs.setdefault(name.rpartition(":")[2], _entities(a or b or c))
            node = Node(tag, attrs)
            open_[-1].kids.append(node)
            if not m["empty"]:
                open_.append(node)
    return root


# --- flattening ---


def runs(node: Node, style: tuple[str, ...] = (), link: tuple[str, bool] | None = None) -> list[dict]:
    """Text runs and inline images in order. Unknown wrappers vanish, their content stays."""
    out: list[dict] = []
    for k in node.kids:
        if isinstance(k, str):
            out.append({"style": list(style), "href": link[0] if link else "", "note": bool(link and link[1]), "image": "", "text": k})
        elif k.tag in STYLES:
            out += runs(k, (*style, k.tag), link)
        elif k.tag == "style":
            out += runs(k, (*style, "named:" + k.get("name")), link)
        elif k.tag == "a":
            out += runs(k, style, (k.get("href"), k.get("type") == "note"))
        elif k.tag == "image":
            out.append({"style": list(style), "href": "", "note": False, "image": k.target, "text": ""})
        else:
            out += runs(k, style, link)
    return out


def plain(node: Node) -> str:
    return "".join(r["text"] for r in runs(node))


def headline(title: Node | None) -> str:
    """The paragraphs of a title in one line."""
    heads = [plain(p).strip(SPACE) for p in title.nodes("p", "subtitle")] if title else []
    return " ".join(h for h in heads if h).strip(SPACE)


_LEAVES = {"p": "paragraph", "subtitle": "subtitle", "text-author": "text-author", "v": "verse", "th": "cell", "td": "cell"}
_GROUPS = ("poem", "stanza", "cite", "epigraph", "annotation", "table", "tr", "title")


class Flattened:
    def __init__(self):
        self.sections: list[dict] = []
        self.blocks: list[dict] = []

    def _block(self, sec: int, role: str, parent: int | None, kind: str, node: Node, inline: list[dict]) -> int:
        n = len(self.blocks)
        whole = lambda s: int(s) if s and re.fullmatch(r"\s*[+-]?\d+\s*", s) else 0
        self.blocks.append({
            "block_ord": n, "sec_ord": sec, "role": role, "parent_block": parent, "kind": kind, "id": node.get("id"), "style": node.get("style"), "href": node.target if node.tag == "image" else "",
            "alt": node.get("alt") or node.get("title"), "colspan": whole(node.get("colspan")), "rowspan": whole(node.get("rowspan")), "header": node.tag == "th", "heading": False, "runs": inline,
        })
        return n

    def block(self, sec: int, role: str, parent: int | None, node: Node) -> None:
        if node.tag in _LEAVES:
            self._block(sec, role, parent, _LEAVES[node.tag], node, runs(node))
        elif node.tag in ("empty-line", "image"):
            self._block(sec, role, parent, node.tag, node, [])
        elif node.tag in _GROUPS:
            own = self._block(sec, role, parent, node.tag, node, [])
            for k in node.nodes():
                self.block(sec, role, own, k)

    def front(self, body: Node) -> None:
        """A body's own title and epigraphs, if it has any, as a section of depth 0 without content."""
        title, n = body.last("title"), len(self.sections)
        if not (title and title.nodes()) and not body.nodes("epigraph"):
            return
        self.sections.append({"sec_ord": n, "parent_ord": None, "depth": 0, "path": [n], "body": body.get("name"), "id": "", "title": headline(title), "image": "", "alt": ""})
        for k in title.nodes() if title else []:
            self.block(n, "title", None, k)
        for e in body.nodes("epigraph"):
            self.block(n, "epigraph", None, e)

    def section(self, node: Node, body: str, parent: int | None, depth: int, path: list[int]) -> None:
        n = len(self.sections)
        title = node.last("title")
        image = node.last("image")
        self.sections.append({
            "sec_ord": n, "parent_ord": parent, "depth": depth, "path": [*path, n], "body": body, "id": node.get("id"), "title": headline(title),
            "image": image.target if image else "", "alt": (image.get("alt") or image.get("title")) if image else "",
        })
        for role, tag in (("title", "title"), ("annotation", "annotation")):
            node_ = node.last(tag)
            if role == "annotation":
                for e in node.nodes("epigraph"):
                    self.block(n, "epigraph", None, e)
            for k in node_.nodes() if node_ else []:
                self.block(n, role, None, k)
        for k in node.nodes():
            if k.tag not in ("title", "epigraph", "annotation", "image", "section"):
                self.block(n, "content", None, k)
        for k in node.nodes("section"):
            self.section(k, body, n, depth + 1, [*path, n])


def person(node: Node) -> dict:
    return {"first": node.text_of("first-name"), "middle": node.text_of("middle-name"), "last": node.text_of("last-name"), "nick": node.text_of("nickname")}


def _merged(parts: list[Node]) -> Node:
    return Node("", {}, [k for p in parts for k in p.kids])


def parse(raw: bytes) -> dict | None:
    """A book: metadata, sections, blocks and binaries. None if there is neither a body nor a title."""
    text = decode(raw)
    root = read_tree(text or "")
    book = next((n for n in _walk(root) if n.tag == "FictionBook"), Node(""))
    d = _merged(book.nodes("description"))
    title, doc, publish = (_merged(d.nodes(t)) for t in ("title-info", "document-info", "publish-info"))
    bodies = book.nodes("body")
    notes = next((b for b in bodies if b.get("name") == "notes"), None)
    if not [b for b in bodies if b is not notes] and not title.text_of("book-title"):
        return None
    cover = [i for c in title.nodes("coverpage") for i in c.nodes("image")]
    series = title.last("sequence")
    annotation = title.last("annotation")
    flat = Flattened()
    for b in [*(b for b in bodies if b is not notes), *([notes] if notes else [])]:
        name = "notes" if b is notes else b.get("name")
        if b is not notes:
            flat.front(b)
        for s in b.nodes("section"):
            flat.section(s, name, None, 1, [])
    binaries = []
    for b in book.nodes("binary"):
        try:
            data = base64.b64decode(re.sub(r"[ \t\r\n]", "", "".join(k for k in b.kids if isinstance(k, str))), validate=True)
        except (binascii.Error, ValueError):
            continue
        if b.get("id"):
            binaries.append({"id": b.get("id"), "content_type": b.get("content-type"), "data": data})
    return {
        "title": title.text_of("book-title"), "authors": [person(p) for p in title.nodes("author")], "translators": [person(p) for p in title.nodes("translator")],
        "annotation": " ".join(t for p in (annotation.nodes("p", "subtitle") if annotation else []) if (t := plain(p).strip(SPACE))),
        "keywords": [k for w in title.text_of("keywords").split(",") if (k := w.strip(SPACE))], "lang": title.text_of("lang"), "src_lang": title.text_of("src-lang"), "date": title.text_of("date"),
        "series": {"name": series.get("name"), "number": series.get("number")} if series else None, "cover": cover[-1].target if cover else "",
        "doc_id": doc.text_of("id"), "program": doc.text_of("program-used"), "publisher": publish.text_of("publisher"), "city": publish.text_of("city"), "year": publish.text_of("year"),
        "isbn": publish.text_of("isbn"), "original": publish.text_of("book-name"), "sections": flat.sections, "blocks": flat.blocks, "binaries": binaries,
    }


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += n.nodes()[::-1]


_PERSON = pa.list_(pa.struct([(c, pa.string()) for c in ("first", "middle", "last", "nick")]))
_RUN = pa.list_(pa.struct([("style", pa.list_(pa.string())), ("href", pa.string()), ("note", pa.bool_()), ("image", pa.string()), ("text", pa.string())]))
_SECTION = pa.list_(pa.struct([("sec_ord", pa.int32()), ("parent_ord", pa.int32()), ("depth", pa.int32()), ("path", pa.list_(pa.int32())), ("body", pa.string()), ("id", pa.string()), ("title", pa.string()), ("image", pa.string()), ("alt", pa.string())]))
_BLOCK = pa.list_(pa.struct([("block_ord", pa.int32()), ("sec_ord", pa.int32()), ("role", pa.string()), ("parent_block", pa.int32()), ("kind", pa.string()), ("id", pa.string()), ("style", pa.string()), ("href", pa.string()), ("alt", pa.string()), ("colspan", pa.int32()), ("rowspan", pa.int32()), ("header", pa.bool_()), ("heading", pa.bool_()), ("runs", _RUN)]))
_TEXTS = ("title", "annotation", "lang", "src_lang", "date", "cover", "doc_id", "program", "publisher", "city", "year", "isbn", "original")
SCHEMA = pa.schema([
    ("path", pa.string()), *((c, pa.string()) for c in _TEXTS), ("authors", _PERSON), ("translators", _PERSON), ("keywords", pa.list_(pa.string())),
    ("series", pa.struct([("name", pa.string()), ("number", pa.string())])), ("sections", _SECTION), ("blocks", _BLOCK),
    ("binaries", pa.list_(pa.struct([("id", pa.string()), ("content_type", pa.string()), ("data", pa.binary())]))),
])


def parse_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """One row a book; files that hold none give none."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (book := parse(content or b"")) is not None:
                    held.append({"path": path, **book})
                    size += len(content or b"")
                # A batch of its own is dear for a small book, and many large ones would not fit.
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(held, SCHEMA)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)

    return files.select(path_col, content_col).mapInArrow(run, from_arrow_schema(SCHEMA))


def read(spark: SparkSession, path: str, pattern: str = "*.fb2") -> DataFrame:
    return parse_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def each(column: str) -> Column:
    """All of an array, to be exploded. Of a bare column the planner would infer that its size is over 0, and look at that where the array comes from: all of cleaning would run again for it."""
    return F.filter(column, lambda x: x.isNotNull())


def sections(books: DataFrame) -> DataFrame:
    """Without the bodies' own titles, which are sections of depth 0."""
    return books.select(F.col("path").alias("book"), F.explode(each("sections")).alias("s")).select("book", "s.*").where("depth > 0")


def blocks(books: DataFrame) -> DataFrame:
    return books.select(F.col("path").alias("book"), F.explode(each("blocks")).alias("b")).select("book", "b.*")


def text_runs(books: DataFrame) -> DataFrame:
    return blocks(books).select("book", "sec_ord", "block_ord", F.posexplode("runs").alias("run_ord", "r")).select("book", "sec_ord", "block_ord", "run_ord", "r.*")


def meta_info(books: DataFrame) -> DataFrame:
    """What is shown of a book: title, first author, language, number of top-level sections outside the notes, whether it has a cover."""
    from ..functions.metadata import display_name

    a = F.get("authors", F.lit(0))
    top = F.filter("sections", lambda s: (s["depth"] == 1) & (s["body"] != "notes"))
    author = F.coalesce(display_name(a["first"], a["middle"], a["last"], a["nick"]), F.lit(""))
    covered = F.exists("binaries", lambda b: b["id"] == F.col("cover"))
    return books.select(F.col("path").alias("book"), "title", author.alias("author"), "lang", F.size(top).alias("sections"), covered.alias("has_cover"))
