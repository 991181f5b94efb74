"""Balance of an export candidate pool: distributions, risks, weights and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.storage import written
from .ranking import distributed_rank


def _sized(boxes: DataFrame) -> DataFrame:
    box = tuple(F.col(f"bbox_{c}") for c in ("x", "y", "width", "height"))
    _, _, w, h = fn.to_absolute(F.col("annotation_format"), box, F.col("width"), F.col("height"))
    return boxes.withColumns({"w_": w, "h_": h, "ratio_": fn.area_ratio(F.col("annotation_format"), F.col("bbox_width"), F.col("bbox_height"), F.col("width"), F.col("height"))})


def class_distribution(boxes: DataFrame) -> DataFrame:
    """Images, boxes and boxes an image by class, and the largest class over this one."""
    by = boxes.groupBy("export_key").agg(F.countDistinct("image_id").alias("images"), F.count("*").alias("instances"))
    top = by.agg(F.max("instances").alias("top"))
    return by.crossJoin(F.broadcast(top)).select("export_key", "images", "instances", (F.col("instances") / F.col("images")).alias("per_image"), (F.col("top") / F.col("instances")).alias("imbalance"))  # top is one row


def bbox_distribution(boxes: DataFrame, small: float = 0.01, large: float = 0.1) -> DataFrame:
    """Small, medium and large boxes, and wide, square and tall ones, by class."""
    r, a = F.col("ratio_"), F.col("w_") / F.when(F.col("h_") > 0, F.col("h_"))
    return _sized(boxes).groupBy("export_key").agg(F.count_if(r < small).alias("small"), F.count_if((r >= small) & (r < large)).alias("medium"), F.count_if(r >= large).alias("large"), F.count_if(a > 2).alias("wide"), F.count_if((a >= 0.5) & (a <= 2)).alias("square"), F.count_if(a < 0.5).alias("tall"))


def source_concentration(boxes: DataFrame) -> DataFrame:
    by = boxes.groupBy("export_key", "source_id").agg(F.count("*").alias("n"))
    return by.groupBy("export_key").agg(F.max_by("source_id", F.struct(F.col("n"), F.col("source_id"))).alias("top_source"), (F.max("n") / F.sum("n")).alias("share"))


def split_preview(boxes: DataFrame, splits: DataFrame, near_empty: int = 5) -> DataFrame:
    """Boxes of each class in each split and whether a split holds too few."""
    n = lambda s: F.count_if(F.col("split") == s)
    by = boxes.join(splits.select("image_id", "split"), "image_id").groupBy("export_key").agg(*(n(s).alias(s) for s in ("train", "valid", "test")))
    return by.withColumn("near_empty", F.least("train", "valid", "test") < near_empty)


def cooccurrence(boxes: DataFrame, risk: float = 0.9) -> DataFrame:
    """Of each class how often it stands alone, and its most frequent partner; risk where that is nearly always."""
    pairs = boxes.select("image_id", "export_key").distinct()
    total = pairs.groupBy("export_key").agg(F.count("*").alias("images"))
    width = pairs.groupBy("image_id").agg(F.collect_set("export_key").alias("keys"))
    # classes of one image are few; the images are the rows that are many
    each = width.select(F.explode("keys").alias("export_key"), "keys")
    alone = each.groupBy("export_key").agg(F.count_if(F.size("keys") == 1).alias("alone"))
    partner = each.select("export_key", F.explode("keys").alias("partner")).where("partner != export_key").groupBy("export_key", "partner").agg(F.count("*").alias("n"))
    best = partner.groupBy("export_key").agg(F.min_by(F.struct("partner", "n"), F.struct(-F.col("n"), "partner")).alias("b"))
    out = total.join(alone, "export_key").join(best, "export_key", "left")
    rate = F.col("b.n") / F.col("images")
    return out.select("export_key", "images", (F.col("alone") / F.col("images")).alias("alone_rate"), "b.partner", rate.alias("partner_rate"), F.coalesce(rate > risk, F.lit(False)).alias("shortcut_risk"))


def bbox_anomalies(images: DataFrame, boxes: DataFrame, tiny: float = 0.0005, giant: float = 0.9, aspect: float = 10.0) -> DataFrame:
    w, h, r = F.col("w_"), F.col("h_"), F.col("ratio_")
    found = _sized(boxes).agg(F.count_if(r < tiny).alias("tiny"), F.count_if(r > giant).alias("giant"), F.count_if((w / F.when(h > 0, h) > aspect) | (h / F.when(w > 0, w) > aspect)).alias("extreme_aspect"), F.count_if((w <= 0) | (h <= 0)).alias("invalid"))
    return images.agg(F.count_if(F.col("health_status") == "corrupted").alias("corrupted")).crossJoin(F.broadcast(found))  # one row each


def exact_duplicates(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Groups of rows with the same content."""
    sign = F.sha2(F.col(content).cast("binary"), 256)
    return rows.groupBy(sign.alias("signature")).agg(F.count("*").alias("items"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).where("items > 1")


def class_weights(boxes: DataFrame) -> DataFrame:
    """Inverse frequency, one on average over the boxes."""
    by = boxes.groupBy("export_key").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return by.crossJoin(F.broadcast(total)).select("export_key", "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))  # total is one row


def repeat_factor(boxes: DataFrame, threshold: float = 0.2) -> DataFrame:
    """max(1, sqrt(threshold / share of images)) by class."""
    by = boxes.groupBy("export_key").agg(F.countDistinct("image_id").alias("images"))
    total = boxes.agg(F.countDistinct("image_id").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("export_key", "images", F.greatest(F.lit(1.0), F.sqrt(threshold * F.col("total") / F.col("images"))).alias("factor"))  # total is one row


def cap_majority(boxes: DataFrame, seed: int, multiplier: float = 1.0, reference: str = "smallest", manual: int | None = None) -> DataFrame:
    """Images kept when each class is capped at reference * multiplier images, before any split.

    A class deals its places out in turns over (source, box size) groups, in seeded order within one; an image stays
    if any of its classes keeps it. Groups are ranked in buckets of the seeded hash, and turns become one rank a class by
    sums over turn counts and over stretches of turns, so neither a large class nor a large group is sorted in one task.
    An image's place is never before its turn, so turns beyond the cap are left out early; images of a class and their
    turns are written once, as counts are needed before the rows themselves.
    """
    size = F.when(F.col("ratio_") < 0.01, 0).when(F.col("ratio_") < 0.1, 1).otherwise(2)
    rows = written(_sized(boxes).groupBy("export_key", "source_id", "image_id").agg(F.max(size).alias("size")), "cap-images")
    counts = rows.groupBy("export_key").agg(F.countDistinct("image_id").alias("n"))
    base = F.lit(float(manual)) if manual is not None else F.min("n") if reference == "smallest" else F.percentile("n", 0.5)
    cap = F.broadcast(counts.agg(F.floor(base * multiplier).alias("cap")))  # one row
    rows = rows.withColumn("h", F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.col("image_id")).cast("binary"))))
    turns = distributed_rank(rows, ["h", "image_id"], F.substring(F.hex("h"), 1, 3), "turn", ["export_key", "source_id", "size"])
    turns = written(turns.crossJoin(cap).where("turn <= cap"), "cap-turns")
    stretch = F.floor(F.col("turn") / 1024)
    per_turn = turns.groupBy("export_key", "turn").agg(F.count("*").alias("n")).withColumn("stretch", stretch)
    ahead = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    sums = per_turn.groupBy("export_key", "stretch").agg(F.sum("n").alias("n"))
    sums = sums.select("export_key", "stretch", F.coalesce(F.sum("n").over(ahead("export_key").orderBy("stretch")), F.lit(0)).alias("base"))
    per_turn = per_turn.withColumn("own", F.coalesce(F.sum("n").over(ahead("export_key", "stretch").orderBy("turn")), F.lit(0)))
    per_turn = per_turn.join(sums, ["export_key", "stretch"]).select("export_key", "turn", (F.col("base") + F.col("own")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("export_key", "turn").orderBy("source_id", "size", "h", "image_id"))  # a row a group
    ranked = turns.join(per_turn, ["export_key", "turn"]).withColumn("place", F.col("ahead") + within)
    return ranked.where("place <= cap").select("image_id").distinct()


def balance_preview(boxes: DataFrame, kept: DataFrame) -> DataFrame:
    """Images and boxes of each class before and after, and the share of boxes kept."""
    count = lambda d, s: d.groupBy("export_key").agg(F.countDistinct("image_id").alias(f"images_{s}"), F.count("*").alias(f"boxes_{s}"))
    both = count(boxes, "before").join(count(boxes.join(kept, "image_id", "left_semi"), "after"), "export_key", "left")
    both = both.fillna(0, ["images_after", "boxes_after"])
    return both.withColumn("keep_ratio", F.col("boxes_after") / F.col("boxes_before"))


def risk_issues(boxes: DataFrame, images: DataFrame, rare: int = 20, imbalance: float = 3.0, share: float = 0.5) -> DataFrame:
    """Rule, level and subject of each risk found."""
    dist = class_distribution(boxes)
    rule = lambda d, level, name, ref: d.select(F.lit(level).alias("level"), F.lit(name).alias("rule"), F.col(ref).cast("string").alias("subject"))
    bad = images.where("health_status = 'corrupted'").groupBy("source_id").agg(F.count("*").alias("n"))
    return (
        rule(bad, "P0", "corrupted images", "source_id")
        .unionByName(rule(dist.where(F.col("instances") < rare), "P1", "rare class", "export_key"))
        .unionByName(rule(dist.where(F.col("imbalance") > imbalance), "P2", "imbalanced class", "export_key"))
        .unionByName(rule(source_concentration(boxes).where(F.col("share") > share), "P2", "one source dominates", "export_key"))
        .unionByName(rule(cooccurrence(boxes).where("shortcut_risk"), "P3", "shortcut by co-occurrence", "export_key"))
    )


def missing_files(images: DataFrame, listing: DataFrame) -> DataFrame:
    return images.join(listing.select(F.col("path").alias("original_path")), "original_path", "left_anti").select("image_id", "original_path")


def export_review(boxes: DataFrame, splits: DataFrame) -> DataFrame:
    """Images and boxes by category and split."""
    return boxes.join(splits.select("image_id", "split"), "image_id").groupBy("export_key", "split").agg(F.countDistinct("image_id").alias("images"), F.count("*").alias("boxes"))
