"""Keeping tables of a workspace: upsert, remove, evolve, mappings, label sync and logs.

Tables are snapshots: every function returns the new table. snapshots.py keeps several of them in a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], order: Column, keep_first: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The latest row of each key by `order`; columns in keep_first come from the key's earliest row instead."""
    both = table.unionByName(updates, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    first = [F.min_by(c, order).alias(c) if c in keep_first else F.max_by(c, order).alias(c) for c in rest]
    return both.groupBy(*keys).agg(*first)


def remove_source(tables: dict[str, DataFrame], source_id: str) -> dict[str, DataFrame]:
    """Each table that has a source_id without that source; others (embeddings, projections) stay as they are."""
    return {k: t.where(F.col("source_id") != source_id) if "source_id" in t.columns else t for k, t in tables.items()}


def add_source(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Sources with those of the new ones whose path is not there yet."""
    return sources.unionByName(new.join(sources.select("path"), "path", "left_anti").select(*sources.columns))


def rescan_source(sources: DataFrame, tables: dict[str, DataFrame], source_id: str, scan: dict[str, DataFrame], status: str = "ready") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Sources with the counts and status of a new scan of one of them, and tables with its rows replaced.

    tables, scan: images, categories and annotations, maybe mappings; mappings of the source go with its categories. The
    status is 'warning' where an image of the scan is corrupted. A source that is not there is an error.
    """
    if sources.where(F.col("source_id") == source_id).isEmpty():
        raise ValueError(f"no source {source_id}")
    old = remove_source(tables, source_id)
    new = {k: old[k].unionByName(scan[k], allowMissingColumns=True) if k in scan else old[k] for k in tables}
    counts = scan["images"].agg(F.count("*").alias("image_count_"), F.count_if(F.col("health_status") == "corrupted").alias("bad_")).crossJoin(scan["categories"].agg(F.count("*").alias("category_count_")))  # one row each
    mine = F.col("source_id") == source_id
    known = evolve_schema(sources, {"image_count": 0, "category_count": 0, "status": status})
    rows = known.crossJoin(F.broadcast(counts))
    fresh = {"image_count": F.col("image_count_"), "category_count": F.col("category_count_"), "status": F.when(F.col("bad_") > 0, "warning").otherwise(status)}
    return rows.select(*(F.when(mine, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in known.columns)), new


def write_embeddings(table: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors by (scope, target_id, model_id), each with its norm; a new vector replaces the old one of its key."""
    key = ["scope", "target_id", "model_id"]
    fresh = new.withColumn("vector_norm", fn.l2_norm(F.col("vector")))
    return table.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def sample_members(sets: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """image_id and trigger_object_id (null where an image came in as such) of the selected images of a named set."""
    own = sets.where(F.col("name") == name).select("sample_set_id")
    return members.join(own, "sample_set_id", "left_semi").where("membership = 'selected'").select("image_id", "trigger_object_id")


def evolve_schema(table: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that are missing are added, and nulls in them filled, with the defaults."""
    out = table
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in table.columns else F.lit(value))
    return out


def apply_mapping(annotations: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unified categories of reviewed rows (category_id, name, action, target_name) and annotations with category_id.

    A target is named by its slug; the name of its first row by category_id is shown. Ignored categories have none.
    """
    used = review.where("action != 'Ignore'").withColumn("unified_id", F.concat(F.lit("unified-"), fn.slug(F.coalesce("target_name", "name"))))
    unified = used.groupBy("unified_id").agg(F.min_by(F.coalesce("target_name", "name"), "category_id").alias("name"))
    target = used.select(F.col("category_id").alias("source_category_id"), F.col("unified_id").alias("category_id"))
    return unified, annotations.join(target, "source_category_id", "left")


def sync_labels(annotations: DataFrame, images: DataFrame, task_images: DataFrame, labels: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """A task's images get the synced boxes only, under a new version; image status follows.

    labels has the columns of annotations but the version; boxes of other images are not touched.
    """
    kept = annotations.join(task_images, "image_id", "left_anti")
    new = labels.join(task_images, "image_id", "left_semi").withColumn("version", F.lit(version))
    boxed = new.select("image_id").distinct().withColumn("boxed", F.lit(True))
    task = task_images.withColumn("in_task", F.lit(True))
    status = F.when(F.col("in_task"), F.when(F.col("boxed"), F.lit("annotated")).otherwise(F.lit("unannotated"))).otherwise(F.col("annotation_status"))
    pics = images.join(task, "image_id", "left").join(boxed, "image_id", "left").withColumn("annotation_status", status).drop("in_task", "boxed")
    return kept.unionByName(new, allowMissingColumns=True), pics


def missing_categories(unified: DataFrame, names: DataFrame) -> DataFrame:
    """Category names of synced labels whose slug has no unified category yet."""
    return names.select(F.concat(F.lit("unified-"), fn.slug(F.col("name"))).alias("unified_id"), "name").groupBy("unified_id").agg(F.min("name").alias("name")).join(unified, "unified_id", "left_anti")


def as_of(annotations: DataFrame, version: int) -> DataFrame:
    """Of each image the boxes of its latest version up to `version`, from an append-only history."""
    past = annotations.where(F.col("version_year") <= version)
    latest = past.groupBy("image_id").agg(F.max("version_year").alias("version_year"))
    return past.join(latest, ["image_id", "version_year"])


def version_summary(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("version_year").agg(F.countDistinct("image_id").alias("images"), F.count("*").alias("boxes"))


def latest_mark(updates: DataFrame) -> DataFrame:
    """The latest status of each (scope, target); the higher event id wins at equal times."""
    return updates.groupBy("scope", "target_id").agg(F.max_by("status", F.struct("updated_at", "event_id")).alias("status"), F.max("updated_at").alias("updated_at"))


def latest_log(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last state of each entry of an append-only log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")


def ready_to_sync(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks marked 'Ready Sync' where the listing holds a file in their folder."""
    found = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct().withColumn("found", F.lit(True))
    return tasks.join(found, "folder", "left").withColumn("status", F.when(F.col("found"), F.lit("Ready Sync")).otherwise(F.col("status"))).drop("found")


def delete_sample_set(sets: DataFrame, members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    gone = sets.where(F.col("name") == name).select("sample_set_id")
    return sets.join(gone, "sample_set_id", "left_anti"), members.join(gone, "sample_set_id", "left_anti")


def newest_first(rows: DataFrame, at: str, key: str) -> DataFrame:
    return rows.orderBy(F.col(at).desc(), key)


def numbered(rows: DataFrame, by: list[str], key: list[str], name: str) -> DataFrame:
    """Positions from 1 within `key`, for groups of ordinary size."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
