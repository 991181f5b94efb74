"""Column functions: slugs, keys, numbers from text, paths, boxes, vectors and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slug(x: Column, empty: str = "") -> Column:
    """ASCII letters and digits in lower case, all else as single hyphens; `empty` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.translate(x, _UPPER, _LOWER), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(s == "", F.lit(empty)).otherwise(s) if empty else s


def norm_key(name: Column, normalized: Column) -> Column:
    return F.coalesce(F.nullif(normalized, F.lit("")), F.lower(name))


def numeric(x: Column) -> Column:
    return F.trim(x.cast("string")).try_cast("double")


def json_id(raw: Column) -> Column:
    """An id from raw JSON text: a quoted string or an integer; null for all else."""
    return F.when(raw.rlike(r"^-?\d+$"), raw).when(raw.rlike(r'^".*"$'), F.substring(raw, F.lit(2), F.length(raw) - 2))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(basename(name), r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(basename(name), r".\.([^.]*)$", 1))


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(f".{ext}"))


def unix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def percent_label(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def label_line(index: Column, *box: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", index, *box)


def to_absolute(fmt: Column, box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """Top-left x, y, width and height in pixels of a box in either format."""
    x, y, w, h = box
    yolo = fmt == "yolo"
    return (F.when(yolo, (x - w / 2) * width).otherwise(x), F.when(yolo, (y - h / 2) * height).otherwise(y), F.when(yolo, w * width).otherwise(w), F.when(yolo, h * height).otherwise(h))


def to_normalized(fmt: Column, box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """Centre x, y, width and height as shares of the image."""
    x, y, w, h = box
    yolo = fmt == "yolo"
    return (F.when(yolo, x).otherwise((x + w / 2) / width), F.when(yolo, y).otherwise((y + h / 2) / height), F.when(yolo, w).otherwise(w / width), F.when(yolo, h).otherwise(h / height))


def area_ratio(fmt: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Box area as a share of the image, sides below zero as zero; null where the image's size isn't known."""
    area = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return F.when(fmt == "yolo", area).when((width > 0) & (height > 0), area / (width * height))


def map_area_ratio(w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), w * h / (width * height))


def crop_window(box: tuple[Column, ...], width: Column, height: Column) -> Column:
    """Whole pixels that cover an absolute box inside the image, at least one each way."""
    x, y, w, h = box

    def side(at: Column, size: Column, limit: Column) -> tuple[Column, Column]:
        low = F.least(F.greatest(F.floor(at), F.lit(0)), limit - 1)
        return low, F.greatest(F.least(F.ceil(at + size), limit), low + 1)

    left, right = side(x, w, width)
    top, bottom = side(y, h, height)
    return F.struct(left.cast("long").alias("left"), top.cast("long").alias("top"), right.cast("long").alias("right"), bottom.cast("long").alias("bottom"))


def dot(a: Column, b: Column) -> Column:
    return F.reduce(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector as doubles; a zero vector stays."""
    n = l2_norm(v)
    return F.get(F.transform(F.array(n), lambda k: F.transform(v, lambda x: F.when(k > 0, x.cast("double") / k).otherwise(x.cast("double")))), F.lit(0))


def any_of(have: Column, wanted: list) -> Column:
    return F.arrays_overlap(have, F.array(*[F.lit(x) for x in wanted]))


def joined(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")
