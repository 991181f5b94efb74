"""Export scope: which images and boxes leave, what is excluded, and what a preview shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written
from .ranking import filename_conflicts
from .tables import latest_mark


def export_scope(cards: DataFrame, filtered: DataFrame, selected: DataFrame | None = None, sample: DataFrame | None = None) -> DataFrame:
    """Ids in scope: a sample set wins, then an explicit selection (filters aside), then the filtered cards."""
    chosen = sample if sample is not None else selected
    return (filtered if chosen is None else cards.join(chosen, "image_id", "left_semi")).select("image_id")


def export_filter(boxes: DataFrame, image_ids: DataFrame | None = None, source_ids: list | None = None, keys: list | None = None) -> DataFrame:
    """Boxes in scope; an image without boxes left is gone with them. An empty id table lets nothing through."""
    out = boxes if image_ids is None else boxes.join(image_ids, "image_id", "left_semi")
    if source_ids:
        out = out.where(F.col("source_id").isin(source_ids))
    return out.where(F.col("export_key").isin(keys)) if keys else out


def excluded(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and boxes whose latest mark is 'exclude', as image_id and annotation_id.

    Written as a table first, so that Spark knows its size before boxes are dealt out for it: a small one goes to them.
    """
    gone = written(latest_mark(marks).where("status = 'exclude'").select("scope", "target_id"), "excluded")
    return tuple(gone.where(F.col("scope") == s).select(F.col("target_id").alias(c)) for s, c in (("image", "image_id"), ("object", "annotation_id")))


def apply_exclusions(boxes: DataFrame, marks: DataFrame) -> DataFrame:
    pics, own = excluded(marks)
    return boxes.join(pics, "image_id", "left_anti").join(own, "annotation_id", "left_anti")


def count_exclusions(boxes: DataFrame, marks: DataFrame) -> DataFrame:
    """Excluded images in scope, and excluded boxes inside images that are not excluded."""
    pics, own = excluded(marks)
    rows = boxes.select("image_id", "annotation_id").join(pics.withColumn("gone", F.lit(True)), "image_id", "left").join(own.withColumn("cut", F.lit(True)), "annotation_id", "left")
    return rows.agg(F.countDistinct(F.when(F.col("gone"), F.col("image_id"))).alias("excluded_images"), F.count_if(F.col("cut") & F.col("gone").isNull()).alias("excluded_boxes"))


def scoped_count(images: DataFrame, image_ids: DataFrame | None = None, source_ids: list | None = None) -> DataFrame:
    """Images in scope: with explicit ids the source filter does not count."""
    if image_ids is not None:
        images = images.join(image_ids, "image_id", "left_semi")
    elif source_ids:
        images = images.where(F.col("source_id").isin(source_ids))
    return images.agg(F.count("*").alias("scoped"))


def export_preview(scoped: DataFrame, boxes: DataFrame, marks: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """One row of totals before exclusions, with the exclusions, name conflicts and split sizes beside them."""
    pics = boxes.select("image_id", "file_name").distinct()
    totals = boxes.agg(F.countDistinct("image_id").alias("images"), F.count("*").alias("boxes"), F.countDistinct("export_key").alias("categories"))
    conflicts = filename_conflicts(pics).agg(F.count("*").alias("conflict_groups"))
    whole = float(sum(ratios))
    train, valid = (F.floor(F.col("images") * float(r) / whole).cast("long") if whole > 0 else F.lit(0).cast("long") for r in ratios[:2])
    sizes = {"train": train, "valid": valid, "test": F.col("images") - train - valid if whole > 0 else F.lit(0).cast("long")}  # as split_sizes
    out = totals
    for one_row in (scoped, count_exclusions(boxes, marks), conflicts):
        out = out.crossJoin(F.broadcast(one_row))  # one row each
    return out.select("images", "boxes", F.greatest(F.col("scoped") - F.col("images"), F.lit(0)).alias("out_of_scope"), "categories", "excluded_images", "excluded_boxes", "conflict_groups", *(v.alias(k) for k, v in sizes.items()))


def export_categories(boxes: DataFrame) -> DataFrame:
    """Key and first name of each exported category, with its class index."""
    from pyspark.sql import Window

    cats = boxes.groupBy("export_key").agg(F.min("category_name").alias("name"))
    return cats.withColumn("class_index", F.row_number().over(Window.orderBy("export_key")) - 1)  # one row a category


def toggle(selected: DataFrame, filtered: DataFrame) -> DataFrame:
    """Selection without the filtered images if it holds them all, else with them added."""
    lacking = filtered.join(selected, "image_id", "left_anti").agg((F.count("*") > 0).alias("add"))
    both = selected.select("image_id", F.lit(True).alias("s")).join(filtered.select("image_id", F.lit(True).alias("f")), "image_id", "full")
    return both.crossJoin(F.broadcast(lacking)).where("add or f is null").select("image_id")  # lacking is one row


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of one side only: missing on the right, extra on the right."""
    missing = left.select("key").subtract(right.select("key")).withColumn("side", F.lit("missing"))
    return missing.unionByName(right.select("key").subtract(left.select("key")).withColumn("side", F.lit("extra")))
