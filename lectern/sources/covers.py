"""Cover templates and their settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults and known image types.
IMAGES = ("jpg", "jpeg", "png", "gif", "webp")
QUALITY, PLATE_WIDTH, PLATE_CENTER = 88, 0.80, 0.30
CONFIG = "width int, height int, fontTitle string, fontAuthor string, jpegQuality int, plateWidth double, plateCenterY double"
GENERATED = "gen-cover"


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """name, path of the images of a folder, by name."""
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*").select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path").where(F.lower(name).rlike(rf"\.({'|'.join(IMAGES)})\z")).orderBy("name")


def config(text: Column) -> Column:
    """Settings out of JSON; what is missing or out of bounds gets its default. Width and height of 0 keep the template's."""
    c = F.from_json(text, CONFIG)
    within = lambda name, low, high, default: F.when((c[name] > low) & (c[name] <= high), c[name]).otherwise(F.lit(default))
    return F.struct(
        F.coalesce(c["width"], F.lit(0)).alias("width"), F.coalesce(c["height"], F.lit(0)).alias("height"), F.coalesce(c["fontTitle"], F.lit("")).alias("fontTitle"), F.coalesce(c["fontAuthor"], F.lit("")).alias("fontAuthor"),
        within("jpegQuality", 0, 100, QUALITY).alias("jpegQuality"), within("plateWidth", 0, 1, PLATE_WIDTH).alias("plateWidth"), within("plateCenterY", 0, 1, PLATE_CENTER).alias("plateCenterY"),
    )


def crop(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """The part of a picture, from its middle, that has the shape of the canvas: x, y, width, height in whole points. A picture of the canvas's size is
    taken whole, one without a size is null."""
    aspect = to_width.cast("double") / to_height
    wide = width.cast("double") / height > aspect
    same = (width == to_width) & (height == to_height)
    own_width = F.when(~same & wide, F.floor(height.cast("double") * aspect)).otherwise(width).cast("int")
    own_height = F.when(~same & ~wide, F.floor(width.cast("double") / aspect)).otherwise(height).cast("int")
    place = lambda whole, part: F.floor((whole - part) / 2).cast("int")
    return F.when((width > 0) & (height > 0), F.struct(place(width, own_width).alias("x"), place(height, own_height).alias("y"), own_width.alias("width"), own_height.alias("height")))


def picked(n: Column, avoid: Column, key: Column) -> Column:
    """A number below n that is told by the key as if by chance, and isn't `avoid` where there is another; -1 if n is not positive."""
    other = (avoid >= 0) & (avoid < n)
    r = F.pmod(F.xxhash64(key), F.greatest(F.when(other, n - 1).otherwise(n), F.lit(1))).cast("int")
    return F.when(n <= 0, -1).when(n == 1, 0).otherwise(F.when(other & (r >= avoid), r + 1).otherwise(r))


def wrap_lines(text: Column, width: int) -> Column:
    """Lines of at most `width` characters, filled one after the other; a longer word has a line of its own."""
    words = F.filter(F.split(text, r"[\s\x{0085}\p{Z}]+"), lambda w: w != "")

    def step(a: Column, w: Column) -> Column:
        longer = F.concat(a["line"], F.lit(" "), w)
        fits = (a["line"] == "") | (F.length(longer) <= width)
        line = F.when(a["line"] == "", w).when(fits, longer).otherwise(w)
        return F.struct(F.when(fits, a["done"]).otherwise(F.array_append(a["done"], a["line"])).alias("done"), line.alias("line"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
    return F.aggregate(words, start, step, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.array_append(a["done"], a["line"])))


def with_generated_cover(books: DataFrame, covers: DataFrame) -> DataFrame:
    """Books whose path has a generated cover (path, content_type, data): it replaces an earlier generated one and is what the book points to."""
    made = covers.select(F.col("path"), F.struct(F.lit(GENERATED).alias("id"), "content_type", "data").alias("__new"))
    out = books.join(made, "path", "left")
    own = F.filter("binaries", lambda b: b["id"] != GENERATED)
    return out.withColumns({
        "binaries": F.when(F.col("__new").isNotNull(), F.array_append(own, F.col("__new"))).otherwise(F.col("binaries")),
        "cover": F.when(F.col("__new").isNotNull(), F.lit(GENERATED)).otherwise(F.col("cover")),
    }).drop("__new")
