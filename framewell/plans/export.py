"""Writing datasets: COCO documents, YOLO label lines, copies, subsets, staging and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.storage import joined, listed, removed, shared, unshuffled, written
from ..operators.tables import evolve_schema
from ..operators.ranking import distributed_rank, spread_bucket, staged_names
from .filetree import remove_files, write_files

BOX = tuple(f"bbox_{c}" for c in ("x", "y", "width", "height"))


def class_ids(rows: DataFrame, scope: str = "per_split") -> DataFrame:
    """split, export_key, name, class_id from 1: by first encounter in a split's image order, or the same for all splits."""
    if scope == "global":
        keys = rows.groupBy("export_key").agg(F.min("category_name").alias("name")).withColumn("class_id", F.row_number().over(Window.orderBy("export_key")))
        return rows.select("split").distinct().crossJoin(F.broadcast(keys))  # one row a split and class
    first = rows.groupBy("split", "export_key").agg(F.min(F.struct("position", "annotation_id")).alias("at"), F.min("category_name").alias("name"))
    return first.withColumn("class_id", F.row_number().over(Window.partitionBy("split").orderBy("at"))).drop("at")


def coco_rows(rows: DataFrame, scope: str = "per_split") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered images, boxes and categories of each split; ids run from 1 in export order.

    rows: boxes with split, position (the image's place in the export order) and unique_name. Images and boxes are
    written once they have their numbers, as documents and rules read them several times.
    """
    width = 1000
    pics = rows.select("split", "image_id", "position", "unique_name", "width", "height").distinct()
    pics = written(distributed_rank(pics, ["position"], F.floor(F.col("position") / width), "id", ["split"]), "numbered-images")
    cats = class_ids(rows, scope)
    x, y, w, h = fn.to_absolute(F.col("annotation_format"), tuple(F.col(c) for c in BOX), F.col("width"), F.col("height"))
    area = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    boxes = rows.join(pics.select("split", "image_id", F.col("id").alias("image_no")), ["split", "image_id"]).join(F.broadcast(cats.select("split", "export_key", "class_id")), ["split", "export_key"])  # one row a split and class
    boxes = distributed_rank(boxes, ["image_no", "annotation_id"], F.floor(F.col("image_no") / width), "id", ["split"])
    boxes = boxes.select("split", "id", F.col("image_no").alias("image_id"), F.col("class_id").alias("category_id"), F.array(x, y, w, h).alias("bbox"), area.alias("area"), F.lit(0).alias("iscrowd"))
    boxes = written(boxes, "numbered-boxes")
    return pics.select("split", "id", F.col("unique_name").alias("file_name"), "width", "height"), boxes, cats


def write_coco(rows: DataFrame, path: str, scope: str = "per_split", sharded: bool = True) -> None:
    """COCO data below path: <table>/split=<split> as JSON lines, by table.

    sharded=False: one document a split, split=<split>/annotations.coco.json. Splits may have any size either way.
    """
    pics, boxes, cats = coco_rows(rows, scope)
    cats = cats.select("split", F.col("class_id").alias("id"), "name", F.lit("object").alias("supercategory"))
    if sharded:
        for name, t in (("images", pics), ("annotations", boxes), ("categories", cats)):
            t.write.partitionBy("split").json(f"{path}/{name}")
        return
    write_documents({"images": pics, "annotations": boxes, "categories": cats}, path)


def write_documents(tables: dict[str, DataFrame], path: str, name: str = "annotations.coco.json") -> None:
    """A JSON document for each split, with an array for each table: its rows by id, which run from 1.

    Every element is a line of text; lines are dealt to tasks by ranges of (split, table, id), and the tasks' files are
    joined in that order, so neither a row nor a task ever holds a whole document.
    """
    spark = next(iter(tables.values())).sparkSession
    lines = []
    for k, (table, t) in enumerate(tables.items()):
        rest = [c for c in t.columns if c not in ("split", "id")]
        text = F.concat(F.when(F.col("id") > 1, ",").otherwise(""), F.to_json(F.struct("id", *rest)))
        lines.append(t.select("split", F.lit(k).alias("k"), F.col("id").cast("long").alias("n"), text.alias("value")))
    splits = lines[0].select("split").distinct()
    heads = [F.struct(F.lit(k).alias("k"), F.lit(0).cast("long").alias("n"), F.lit(f'{"{" if not k else "],"}"{table}":[').alias("value")) for k, table in enumerate(tables)]
    heads.append(F.struct(F.lit(len(tables)).alias("k"), F.lit(0).cast("long").alias("n"), F.lit("]}").alias("value")))
    lines.append(splits.select("split", F.explode(F.array(*heads)).alias("h")).select("split", "h.*"))
    rows = lines[0]
    for t in lines[1:]:
        rows = rows.unionByName(t)
    tasks, order = int(spark.conf.get("spark.sql.shuffle.partitions")), ["split", "k", "n"]
    at = shared(spark, "documents")
    with unshuffled(spark):
        rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("split", "value").write.partitionBy("split").text(at)
    for folder in listed(spark, at):
        joined(spark, folder.toString(), f"{path}/{folder.getName()}/{name}")
    removed(spark, at)


def yolo_lines(rows: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """split, unique_name, text: the label file of each image; class indices are the same for all splits.

    classes: the export_key of all classes that rows may have, if known; else rows are read once more for those they have.
    """
    keys = (rows if classes is None else classes).select("export_key").distinct().withColumn("class_index", F.row_number().over(Window.orderBy("export_key")) - 1)  # one row a class
    x, y, w, h = fn.to_normalized(F.col("annotation_format"), tuple(F.col(c) for c in BOX), F.col("width"), F.col("height"))
    lines = rows.join(F.broadcast(keys), "export_key").select("split", "unique_name", "annotation_id", fn.label_line(F.col("class_index"), x, y, w, h).alias("line"))
    return lines.groupBy("split", "unique_name").agg(F.sort_array(F.collect_list(F.struct("annotation_id", "line"))).alias("l")).select("split", "unique_name", F.array_join("l.line", "\n").alias("text"))


def data_yaml(rows: DataFrame) -> DataFrame:
    """One row: the data.yaml text with the number of classes and their names in order."""
    names = rows.groupBy("export_key").agg(F.min("category_name").alias("name"))
    return names.agg(F.transform(F.array_sort(F.collect_list(F.struct("export_key", "name"))), lambda v: v["name"]).alias("n")).select(F.concat(F.lit("path: .\ntrain: train/images\nval: valid/images\ntest: test/images\nnc: "), F.size("n").cast("string"), F.lit("\nnames: ["), F.array_join(F.transform("n", lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]\n")).alias("value"))


def write_yolo(rows: DataFrame, root: str, classes: DataFrame | None = None) -> None:
    """<split>/labels/<name>.txt for each image, and data.yaml; an error without categories. All files come, or none.

    classes: export_key and category_name of all classes, if rows are a part of the boxes that they number.
    """
    if rows.limit(1).count() == 0:
        raise ValueError("nothing to export: no box has a category")
    labels = yolo_lines(rows, classes).select(F.concat_ws("/", "split", F.lit("labels"), fn.with_extension(F.col("unique_name"), "txt")).alias("path"), F.col("text").alias("content"))
    write_files(labels.unionByName(data_yaml(rows if classes is None else classes).select(F.lit("data.yaml").alias("path"), F.col("value").alias("content"))), root)


def copy_images(files: DataFrame, root: str) -> None:
    """Copy (original_path, target) rows below root; missing files are left out."""
    write_files(files.select(F.col("target").alias("path"), F.col("original_path").alias("source")), root)


def subset_coco(images: DataFrame, boxes: DataFrame, categories: DataFrame, selected: DataFrame, by: str = "file_name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images whose name (or id) is selected, with boxes and categories numbered anew; categories are one by exact name."""
    pics = images.join(selected.select(by).distinct(), by, "left_semi")
    pics = distributed_rank(pics, ["file_name", "image_id"], spread_bucket(pics, "file_name"), "new_id")
    cats = categories.groupBy("name").agg(F.min("category_id").alias("first")).withColumn("class_id", F.row_number().over(Window.orderBy("name")))
    named = categories.select("category_id", "name").join(cats.select("name", "class_id"), "name")
    rows = boxes.join(pics.select("image_id", F.col("new_id").alias("image_no")), "image_id").join(named.select(F.col("category_id").alias("source_category_id"), "class_id"), "source_category_id")
    rows = distributed_rank(rows, ["image_no", "annotation_id"], F.floor(F.col("image_no") / 1000), "new_id")
    return pics, rows, cats.select("class_id", "name")


def stage_task(images: DataFrame, ids: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Unannotated images of a label task whose file is there, with staged names."""
    rows = images.join(ids, "image_id", "left_semi").where("annotation_status = 'unannotated'")
    if listing is not None:
        rows = rows.join(listing.select(F.col("path").alias("original_path")), "original_path", "left_semi")
    return staged_names(rows)


def append_job(spark: SparkSession, path: str, fmt: str, output: str, images: int, boxes: int) -> None:
    row = spark.range(1).select(F.uuid().alias("job_id"), F.lit(fmt).alias("output_format"), F.lit(output).alias("output_path"), F.current_timestamp().alias("created_at"), F.lit("done").alias("status"), F.lit(images).alias("exported_images"), F.lit(boxes).alias("exported_boxes"))
    row.write.mode("append").parquet(path)


def export_history(jobs: DataFrame) -> DataFrame:
    """All recorded exports, newest first; jobs of before the counts were kept have 0."""
    return evolve_schema(jobs, {"exported_images": 0, "exported_boxes": 0}).orderBy(F.col("created_at").desc(), "job_id")


def write_sample_set(members: DataFrame, path: str, name: str, overwrite: bool = True) -> None:
    """Members of a named set as one partition; without overwrite an existing set is an error."""
    rows = members.withColumn("sample_set", F.lit(name))
    if not overwrite:
        try:
            taken = members.sparkSession.read.parquet(path).where(F.col("sample_set") == name).limit(1).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            taken = 0
        if taken:
            raise ValueError(f"sample set {name} exists")
    rows.write.mode("overwrite").partitionBy("sample_set").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_action_files(weights: DataFrame, factors: DataFrame, duplicates: DataFrame, anomalies: DataFrame, path: str) -> None:
    """class_weights, repeat_factor, exact_duplicates and suspicious_samples as CSV folders below path."""
    for name, t in (("class_weights", weights), ("repeat_factor", factors), ("exact_duplicates", duplicates), ("suspicious_samples", anomalies)):
        t.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
