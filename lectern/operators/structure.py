"""Document trees: sizes, splitting into files, anchors, links, navigation, and what is dropped or merged in rendering.

Trees are adjacency lists (book, sec_ord, parent_ord, depth) in which sec_ord numbers sections in the order of a walk, parents first,
and path lists a section with all above it, so sums over subtrees need no recursion; what is sequential by nature - next-fit packing with
a reset, names that must not collide with earlier ones - runs per book in one pass over its sections, which is bounded by
a book.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Results depend on them.
TAG, STYLED, LINK, INLINE_IMAGE = 30, 15, 30, 40
THRESHOLD = 256 * 1024


def block_size(text: Column, styled: Column | int = 0, links: Column | int = 0, images: Column | int = 0) -> Column:
    """Estimated bytes of one block."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.lit(TAG) + F.octet_length(text) + STYLED * lit(styled) + LINK * lit(links) + INLINE_IMAGE * lit(images)


def subtree_sizes(sections: DataFrame) -> DataFrame:
    """book, sec_ord, size: own sizes summed over each subtree. sections: book, path (sec_ord of the section and all above it), own_size.

    Each section counts for itself and what is above it: rows times depth, summed map-side before they are shuffled."""
    parts = sections.select("book", F.explode("path").alias("sec_ord"), "own_size")
    return parts.groupBy("book", "sec_ord").agg(F.sum("own_size").cast("long").alias("size"))


def split_files(sections: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """book, sec_ord, file: a section whose subtree fits stays in one file; of one that doesn't, its own content stays, large children get
    files of their own, and small ones in a row share files by next fit. sections: book, sec_ord, parent_ord, size (of the subtree)."""

    def per_book(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sec_ord")
        size = dict(zip(rows.sec_ord, rows["size"], strict=True))
        children: dict[int | None, list[int]] = {}
        for s, p in zip(rows.sec_ord, rows.parent_ord, strict=True):
            children.setdefault(None if pd.isna(p) else int(p), []).append(s)
        file: dict[int, int] = {}
        made = 0

        def fresh() -> int:
            nonlocal made
            made += 1
            return made

        # Files are numbered in the order in which they are opened, which is depth first.
        todo = [("open", s, 0) for s in reversed(children.get(None, []))]
        while todo:
            what, s, f = todo.pop()
            if what == "open":
                f = fresh()
            if what == "batch":  # children of s from place f on
                kids = children.get(s, [])
                used, own = 0, None
                k = f
                while k < len(kids) and size[kids[k]] <= threshold:
                    if own is None or used + size[kids[k]] > threshold:
                        own, used = fresh(), 0
                    stack = [kids[k]]
                    while stack:
                        x = stack.pop()
                        file[x] = own
                        stack += children.get(x, [])
                    used += size[kids[k]]
                    k += 1
                if k < len(kids):
                    todo += [("batch", s, k + 1), ("open", kids[k], 0)]
                continue
            file[s] = f
            if size[s] <= threshold:
                todo += [("in", c, f) for c in reversed(children.get(s, []))]
            else:
                todo.append(("batch", s, 0))
        return pd.DataFrame({"book": rows.book, "sec_ord": rows.sec_ord, "file": [f"text/chap_{file[s]:04d}.xhtml" for s in rows.sec_ord]})

    return sections.groupBy("book").applyInPandas(per_book, "book long, sec_ord long, file string")


def unique_names(names: DataFrame, first: int = 2, between: str = "-", extension: bool = False) -> DataFrame:
    """book, ord, name: base names made unique in the order of ord: a repeated one gets -2, -3, ... (or _1 before its extension).

    The k-th of equal bases is numbered k. Only in books where a numbered name meets a base name does the order of all matter, and
    only these go through a pass of their own."""
    k = F.row_number().over(Window.partitionBy("book", "base").orderBy("ord"))
    stem = F.regexp_replace("base", r"\.[^.]*$", "") if extension else F.col("base")
    ext = F.regexp_extract("base", r"(\.[^.]*)$", 1) if extension else F.lit("")
    named = names.withColumn("k", k).withColumn("name", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat(stem, F.lit(between), (F.col("k") - 2 + first).cast("string"), ext)))
    made = named.where("k > 1").select("book", F.col("name").alias("base"))
    clash = made.join(names.select("book", "base").distinct(), ["book", "base"], "left_semi").unionByName(made.groupBy("book", "base").count().where("count > 1").select("book", "base"))
    books = clash.select("book").distinct()

    def per_book(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        used: set[str] = set()
        out = []
        for base in rows.base:
            dot = base.rfind(".") if extension else -1
            head, tail = (base[:dot], base[dot:]) if dot >= 0 else (base, "")
            name, n = base, first
            while name in used:
                name, n = f"{head}{between}{n}{tail}", n + 1
            used.add(name)
            out.append(name)
        return pd.DataFrame({"book": rows.book, "ord": rows.ord, "name": out})

    plain = named.join(books, "book", "left_anti").select("book", "ord", "name")
    return plain.unionByName(names.join(books, "book", "left_semi").select("book", "ord", "base").groupBy("book").applyInPandas(per_book, "book long, ord long, name string"))


def resolve_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """links (book, link_ord, source, href) with target: the file and fragment of the anchor; one that leads nowhere stays as it is. Of anchors with one id the
    last one counts. anchors: book, id, ord, file, frag."""
    from ..functions.metadata import relative_path

    last = anchors.groupBy("book", "id").agg(F.max_by(F.struct("file", "frag"), "ord").alias("at"))
    local = F.startswith("href", F.lit("#"))
    own = links.withColumn("id", F.when(local, F.substring(F.col("href"), F.lit(2), F.length("href"))))
    out = own.join(last, ["book", "id"], "left")
    same = F.concat(F.lit("#"), F.col("at.frag"))
    target = F.when(F.col("at").isNull(), F.col("href")).when(F.col("at.file") == F.col("source"), same).otherwise(F.concat(relative_path(F.col("source"), F.col("at.file")), same))
    return out.select("book", "link_ord", "source", "href", target.alias("target"))


def dangling_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """The links inside a book that lead to no anchor. An extension: nothing is changed by it."""
    own = links.where(F.startswith("href", F.lit("#"))).withColumn("id", F.expr("substring(href, 2)"))
    return own.join(anchors.select("book", "id").distinct(), ["book", "id"], "left_anti").select("book", "link_ord", "href")


def navigation(sections: DataFrame) -> DataFrame:
    """sections with play_order (the number in the walk) and, for each book, nav_depth."""
    w = Window.partitionBy("book")
    return sections.select(
        "book", "sec_ord", F.row_number().over(w.orderBy("sec_ord")).alias("play_order"), F.greatest(F.lit(1), F.max("depth").over(w)).alias("nav_depth")
    )


def collapse_empty_lines(blocks: DataFrame) -> DataFrame:
    """blocks (book, parent, ord, kind) without empty lines that follow an empty line."""
    before = F.lag("kind").over(Window.partitionBy("book", "parent").orderBy("ord"))
    return blocks.withColumn("__before", before).where(~((F.col("kind") == "empty-line") & F.col("__before").eqNullSafe("empty-line"))).drop("__before")


def visible_paragraph(text: Column, heading: Column, anchor: Column, has_link: Column, has_image: Column) -> Column:
    """A paragraph is rendered if it is a heading, an anchor, or holds a link, an image or anything but white space."""
    from ..functions.metadata import trim_space

    return heading | (anchor != "") | has_link | has_image | (trim_space(text) != "")


def flat_text(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: the runs (run_ord, text) of each container in order."""
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_ord", "text"))), lambda r: r["text"]), "").alias("text"))

