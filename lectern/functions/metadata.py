"""Names, titles, ids and paths of books, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
SPACE = r"\t\n\x{0B}\f\r \x{0085}\p{Z}"
UNTITLED = "Без названия"
TITLE_MARKS = ("litres", "ЛитРес")
ILLEGAL_IN_FILES = r"[<>:\"/\\|?*\x{00}-\x{1f}]"
MOST_FILE_CHARS = 120
ENCODING_ALIASES = {
    "utf8": "utf-8", "cp1251": "windows-1251", "windows1251": "windows-1251", "win-1251": "windows-1251", "1251": "windows-1251", "x-cp1251": "windows-1251",
    "cp1252": "windows-1252", "windows1252": "windows-1252", "koi8r": "koi8-r", "koi-8": "koi8-r", "koi8": "koi8-r",
}
EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/svg+xml": ".svg", "image/webp": ".webp"}
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".svg": "image/svg+xml", ".webp": "image/webp"}


def trim_space(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def fields(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w != "")


def _or(c: Column, other: Column) -> Column:
    return F.when(c == "", other).otherwise(c)


def split_name(name: Column) -> Column:
    """first, middle, last: one word is the last name, of three and more the inner ones are the middle."""
    w = fields(name)
    n = F.size(w)
    word = lambda k: F.coalesce(F.try_element_at(w, F.lit(k)), F.lit(""))
    return F.struct(
        F.when(n >= 2, word(1)).otherwise("").alias("first"),
        F.when(n >= 3, F.array_join(F.slice(w, 2, F.greatest(n - 2, F.lit(0))), " ")).otherwise("").alias("middle"),
        word(-1).alias("last"),
    )


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def display_name(first: Column, middle: Column, last: Column, nick: Column) -> Column:
    """The nickname stands in only if first and last name are missing, whatever the middle name."""
    return F.when((nick != "") & (first == "") & (last == ""), nick).otherwise(_joined(first, middle, last))


def edited_name(first: Column, middle: Column, last: Column, nick: Column) -> Column:
    """As shown for editing: parts are trimmed, and the nickname stands in only if all of them are missing."""
    return _or(_joined(trim_space(first), trim_space(middle), trim_space(last)), trim_space(nick))


def file_as(first: Column, middle: Column, last: Column, nick: Column) -> Column:
    rest = trim_space(F.concat(first, F.lit(" "), middle))
    return F.when(last == "", display_name(first, middle, last, nick)).when(rest == "", last).otherwise(F.concat(last, F.lit(", "), rest))


def split_list(c: Column) -> Column:
    """Parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), trim_space), lambda p: p != "")


def clean_title(c: Column) -> Column:
    out = trim_space(F.regexp_replace(c, rf"[\t\n\f\r ]*[\[\{{][^\]\}}]*[\]\}}][\t\n\f\r ]*", " "))
    for mark in TITLE_MARKS:
        out = F.when(F.endswith(out, F.lit(mark)), F.substring(out, F.lit(1), F.length(out) - len(mark))).otherwise(out)
    return trim_space(out)


def safe_file_name(c: Column) -> Column:
    out = F.array_join(fields(F.regexp_replace(c, ILLEGAL_IN_FILES, " ")), " ")
    out = F.rtrim(out, F.lit(" ."))
    return F.when(F.length(out) > MOST_FILE_CHARS, F.rtrim(F.left(out, F.lit(MOST_FILE_CHARS)), F.lit(" ."))).otherwise(out)


def safe_id(c: Column) -> Column:
    """An id that XML accepts: letters, digits, '-', '.', '_', the first one a letter or '_'."""
    first = F.regexp_replace(F.left(c, F.lit(1)), "[^a-zA-Z_]", "_")
    return F.when(c == "", "").otherwise(F.concat(first, F.regexp_replace(F.substring(c, F.lit(2), F.length(c)), r"[^a-zA-Z0-9_.\-]", "_")))


def safe_image_name(c: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(c, "/+$", ""), "^.*/", "")
    out = F.regexp_replace(base, r"[^a-zA-Z0-9._\-]", "_")
    return F.when((c != "") & (base == ""), "_").when(out.isin("", "."), "img").otherwise(out)


def relative_path(source: Column, target: Column) -> Column:
    """target as seen from the file source; both are relative to one root."""
    folders = lambda c: F.slice(F.split(c, "/"), 1, F.size(F.split(c, "/")) - 1)
    a, b = folders(source), folders(target)
    pairs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].eqNullSafe(p["b"]))
    # How many folders from the root on are the same.
    same = F.coalesce(F.array_position(pairs, False) - 1, F.size(pairs))
    same = F.when(F.array_position(pairs, False) == 0, F.size(pairs)).otherwise(same).cast("int")
    up = F.array_repeat(F.lit(".."), F.size(a) - same)
    down = F.slice(b, same + 1, F.size(b))
    return F.array_join(F.concat(up, down, F.array(F.element_at(F.split(target, "/"), -1))), "/")


def stable_uuid(title: Column, filed_authors: Column, series: Column, number: Column) -> Column:
    """A UUID (version 5 form) of title, authors and series; "" for a book without title and authors. series: null if there is none."""
    zero = F.lit("\x00")
    t = trim_space(title)
    parts = F.concat(t, zero, F.array_join(F.transform(filed_authors, lambda a: F.concat(a, zero)), ""), F.when(series.isNull(), "").otherwise(F.concat(series, zero, number)))
    h = F.sha1(F.encode(parts, "UTF-8"))
    hex_at = lambda s, n: F.substring(h, s, n)
    variant = F.substring(F.lit("89ab"), (F.conv(hex_at(17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    out = F.concat(hex_at(1, 8), F.lit("-"), hex_at(9, 4), F.lit("-5"), hex_at(14, 3), F.lit("-"), variant, hex_at(18, 3), F.lit("-"), hex_at(21, 12))
    return F.when((t == "") & (F.size(filed_authors) == 0), "").otherwise(out)


def book_id(doc_id: Column, uuid: Column) -> Column:
    return F.concat(F.lit("urn:uuid:"), _or(trim_space(doc_id), uuid))


def canonical_encoding(c: Column) -> Column:
    n = F.lower(trim_space(c))
    known = F.create_map(*[F.lit(x) for kv in ENCODING_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, n), n)


def declared_encoding(content: Column) -> Column:
    """What the prolog in the first 1024 bytes declares, or ""."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.regexp_extract(head, r"""(?i)<\?xml[^>]*?encoding[\t\n\f\r ]*=[\t\n\f\r ]*["']([^"']+)["']""", 1)


def detected_encoding(content: Column) -> Column:
    """Byte-order mark, else the declared encoding; windows-1251 where UTF-8 is claimed, or nothing, and isn't true."""
    declared = canonical_encoding(declared_encoding(content))
    valid = F.is_valid_utf8(content.cast("string"))
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head == "EFBBBF", "utf-8 (BOM)")
        .when(F.startswith(head, F.lit("FFFE")), "utf-16le")
        .when(F.startswith(head, F.lit("FEFF")), "utf-16be")
        .when(declared.isin("", "utf-8"), F.when(valid, "utf-8").otherwise("windows-1251 (declared utf-8/none)"))
        .otherwise(declared)
    )


def extension(content_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(trim_space(content_type))), F.lit(".img"))


def media_type(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, kind in reversed(MEDIA_TYPES.items()):
        out = F.when(F.endswith(path, F.lit(ext)), kind).otherwise(out)
    return out


def escape_text(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_attribute(c: Column) -> Column:
    return F.replace(escape_text(c), F.lit('"'), F.lit("&quot;"))


def overlay(columns: list[str], edit: str = "edit", keep_blank: tuple[str, ...] = ()) -> dict[str, Column]:
    """Each column of a row as the edit has it: where there is an edit, all its fields replace, empty ones too; those in keep_blank
    fall back where the edit's is blank."""
    out = {}
    for c in columns:
        new = F.col(f"{edit}.{c}")
        new = _or(trim_space(new), F.col(c)) if c in keep_blank else new
        out[c] = F.when(F.col(edit).isNotNull(), new).otherwise(F.col(c))
    return out
