"""Reading a workspace: image cards, details, categories, summaries and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn


def healthy(images: DataFrame) -> DataFrame:
    return images.where("health_status = 'healthy'")


def unified_categories(categories: DataFrame) -> DataFrame:
    """unified_id, name, key: one row for each group key; the name that is first by source wins."""
    key = fn.norm_key(F.col("name"), F.col("normalized_name"))
    rows = categories.select(key.alias("key"), "name", F.struct("source_id", "category_id").alias("o"))
    return rows.groupBy("key").agg(F.min_by("name", "o").alias("name")).select(F.concat(F.lit("unified-"), fn.slug(F.col("key"))).alias("unified_id"), "name", "key")


def resolved(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with the group key and name of their category; null where it is unknown."""
    key = fn.norm_key(F.col("name"), F.col("normalized_name"))
    cats = categories.select(F.col("category_id").alias("source_category_id"), key.alias("category_key"), F.col("name").alias("category_name"))
    return annotations.join(cats, "source_category_id", "left")


def image_cards(images: DataFrame, sources: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row for each healthy image with its categories, box count and largest box share.

    The boxes are folded by image before they meet the images, so one shuffle on image_id serves the fold and the join.
    """
    sized = healthy(images)
    ratio = fn.area_ratio(F.col("annotation_format"), F.col("bbox_width"), F.col("bbox_height"), F.col("width"), F.col("height"))
    boxes = resolved(annotations, categories).join(sized.select("image_id", "width", "height"), "image_id").withColumn("ratio", ratio)
    folded = boxes.groupBy("image_id").agg(F.array_sort(F.collect_set("category_key")).alias("category_keys"), F.array_sort(F.collect_set("category_name")).alias("category_names"), F.count("*").alias("box_count"), F.max("ratio").alias("max_ratio"))
    empty = F.array().cast("array<string>")
    names = sources.select("source_id", fn.basename(F.col("path")).alias("source_name"))
    out = sized.join(folded, "image_id", "left").join(names, "source_id", "left")
    return out.select("image_id", "source_id", "source_name", "file_name", "annotation_status", F.coalesce("category_keys", empty).alias("category_keys"), F.coalesce("category_names", empty).alias("category_names"), F.coalesce("box_count", F.lit(0)).alias("box_count"), "max_ratio")


def count_bucket(n: Column) -> Column:
    return F.when(n >= 5, F.lit("5+")).otherwise(n.cast("string"))


def filter_cards(cards: DataFrame, source_ids: list | None = None, category_keys: list | None = None, status: str = "all", search: str = "", bucket: str = "", min_area_pct: float = 0.0) -> DataFrame:
    """Cards that meet all given conditions; an empty condition holds for all."""
    out = cards
    if source_ids:
        out = out.where(F.col("source_id").isin(source_ids))
    if category_keys:
        out = out.where(fn.any_of(F.col("category_keys"), category_keys))
    if status != "all":
        out = out.where(F.col("annotation_status") == status)
    if search.strip():
        out = out.where(F.lower("file_name").contains(search.strip().lower()))
    if bucket:
        out = out.where(count_bucket(F.col("box_count")) == bucket)
    if min_area_pct > 0:
        out = out.where(F.col("max_ratio") >= min(max(min_area_pct, 0.0), 100.0) / 100)
    return out


def image_detail(ids: DataFrame, images: DataFrame, sources: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row for each box of the given images, 'unknown' where the category is, null box columns without boxes."""
    chosen = images.join(ids, "image_id", "left_semi")
    boxes = resolved(annotations, categories).select("image_id", "annotation_id", F.coalesce("category_name", F.lit("unknown")).alias("category_name"), "annotation_format", "bbox_x", "bbox_y", "bbox_width", "bbox_height")
    names = sources.select("source_id", fn.basename(F.col("path")).alias("source_name"))
    return chosen.join(boxes, "image_id", "left").join(names, "source_id", "left").select("image_id", "file_name", "source_name", "annotation_id", "category_name", "annotation_format", "bbox_x", "bbox_y", "bbox_width", "bbox_height")


def export_boxes(images: DataFrame, annotations: DataFrame, categories: DataFrame, mappings: DataFrame | None = None, drop_ignored: bool = False) -> DataFrame:
    """Boxes of healthy annotated images with the key they are exported under.

    With mappings the unified target is the key and the source's group key stands in where it is null, as for ignored
    categories; drop_ignored leaves those out.
    """
    rows = resolved(annotations, categories)
    key = F.col("category_key")
    if mappings is not None:
        rows = rows.join(mappings.select("source_category_id", "target_category_id", "final_action"), "source_category_id", "left")
        if drop_ignored:
            rows = rows.where(F.coalesce(F.col("final_action") != "Ignore", F.lit(True)))
        key = F.coalesce("target_category_id", "category_key")
    rows = rows.withColumn("export_key", key).where("export_key is not null")
    pics = healthy(images).where("annotation_status = 'annotated'").select("image_id", "file_name", "original_path", "width", "height")
    return pics.join(rows.drop("source_name"), "image_id").select("image_id", "source_id", "file_name", "original_path", "width", "height", "annotation_id", "export_key", F.coalesce("category_name", F.lit("unknown")).alias("category_name"), "annotation_format", "bbox_x", "bbox_y", "bbox_width", "bbox_height")


def import_review(categories: DataFrame, annotations: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row for each source category: image count, suggestion, action, target and display name."""
    key = fn.norm_key(F.col("name"), F.col("normalized_name"))
    counts = annotations.groupBy(F.col("source_category_id").alias("category_id")).agg(F.countDistinct("image_id").alias("image_count"))
    group = Window.partitionBy("group_key")
    rows = categories.withColumn("group_key", key).join(counts, "category_id", "left").join(mappings.select(F.col("source_category_id").alias("category_id"), "final_action", "target_category_id"), "category_id", "left")
    shared = F.count("*").over(group) > 1
    action = F.coalesce("final_action", F.when(shared, F.lit("Merge")).otherwise(F.lit("Create New")))
    return rows.select("category_id", "source_id", "name", F.coalesce("image_count", F.lit(0)).alias("image_count"), F.when(shared, F.lit("same-name candidate")).otherwise(F.lit("new")).alias("suggestion"), action.alias("action"), F.when(action != "Ignore", F.coalesce("target_category_id", F.concat(F.lit("unified-"), fn.slug(F.col("group_key"))))).alias("target_id"), F.min("name").over(group).alias("display_name"))


def category_counts(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Distinct images of each category key that has any."""
    return resolved(annotations, categories).where("category_key is not null").groupBy("category_key").agg(F.min("category_name").alias("name"), F.countDistinct("image_id").alias("image_count"))


def source_summary(sources: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Counts by source, the damaged files and the status they give it."""
    bad = F.col("health_status") == "corrupted"
    pics = images.groupBy("source_id").agg(F.count("*").alias("image_count"), F.count_if(bad).alias("corrupted_count"), F.array_sort(F.collect_list(F.when(bad, F.col("original_path")))).alias("corrupted_paths"))
    cats = categories.groupBy("source_id").agg(F.count("*").alias("category_count"))
    out = sources.join(pics, "source_id", "left").join(cats, "source_id", "left")
    n = F.coalesce("corrupted_count", F.lit(0))
    return out.select("source_id", "source_type", F.coalesce("image_count", F.lit(0)).alias("image_count"), F.coalesce("category_count", F.lit(0)).alias("category_count"), n.alias("corrupted_count"), F.coalesce("corrupted_paths", F.array().cast("array<string>")).alias("corrupted_paths"), F.when(n > 0, F.lit("warning")).otherwise(F.lit("ready")).alias("status"))


def category_ratio(cards: DataFrame) -> DataFrame:
    """Share of the annotated images that hold each category."""
    noted = cards.where("annotation_status = 'annotated'")
    total = noted.agg(F.count("*").alias("total"))
    by = noted.select("image_id", F.explode(F.array_distinct("category_keys")).alias("category_key")).groupBy("category_key").agg(F.count("*").alias("images"))
    return by.crossJoin(F.broadcast(total)).select("category_key", "images", (F.col("images") / F.col("total")).alias("ratio"))  # total is one row


def scope_summary(cards: DataFrame) -> DataFrame:
    noted = F.col("annotation_status") == "annotated"
    cats = cards.select(F.explode_outer("category_keys").alias("c"), "source_id", "annotation_status", "image_id")
    sets = cats.agg(F.array_sort(F.collect_set("c")).alias("categories"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    counts = cards.agg(F.count("*").alias("total"), F.count_if(noted).alias("annotated"), F.count_if(~noted).alias("unannotated"))
    return counts.crossJoin(F.broadcast(sets))  # one row each


def filter_options(categories: DataFrame) -> DataFrame:
    """One label for each key; the first by category id wins."""
    key = fn.norm_key(F.col("name"), F.col("normalized_name"))
    return categories.groupBy(key.alias("id")).agg(F.min_by("name", "category_id").alias("label"))
