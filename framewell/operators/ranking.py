"""Global ranks without a single-task sort, seeded splits, unique names and duplicate names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.storage import written


#: Names of one base from which on they are not dealt out by it.
LARGE = 1 << 16


def distributed_rank(rows: DataFrame, order: list[str], bucket: Column, name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """1-based rank by (bucket, order) within groups; bucket must not fall as order rises.

    Rows are counted by bucket, the small table of counts is summed up in front of each bucket, and rows are ranked
    within their bucket, so no task sees more than one bucket.
    """
    within = within or []
    rows = rows.withColumn("bucket_", bucket)
    counts = rows.groupBy(*within, "bucket_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy(*within).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    inner = F.row_number().over(Window.partitionBy(*within, "bucket_").orderBy(*order))
    return rows.withColumn("inner_", inner).join(offsets, [*within, "bucket_"]).withColumn(name, F.col("offset_") + F.col("inner_")).drop("bucket_", "inner_", "offset_")


def split_sizes(total: int, ratios: tuple[float, float, float]) -> tuple[int, int, int]:
    """Rows of train, valid and test: floors of the shares, and test takes what is left."""
    whole = sum(ratios)
    if whole <= 0 or total <= 0:
        return 0, 0, 0
    train, valid = int(total * ratios[0] / whole), int(total * ratios[1] / whole)
    return train, valid, total - train - valid


def seeded_split(images: DataFrame, seed: int, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """Images with a split by the rank of a seeded hash; the same seed always gives the same split."""
    keyed = images.withColumn("key_", F.md5(F.concat(F.lit(f"{seed}:"), F.col("image_id")).cast("binary")))
    ranked = distributed_rank(keyed, ["key_", "image_id"], F.substring("key_", 1, 3), "position").drop("key_")
    train, valid, _ = split_sizes(images.count(), ratios)
    split = F.when(F.col("position") <= train, F.lit("train")).when(F.col("position") <= train + valid, F.lit("valid")).otherwise(F.lit("test"))
    return ranked.withColumn("split", F.when(F.lit(sum(ratios) > 0), split))


def best_projection(projections: DataFrame) -> DataFrame:
    """Of each target the point of the best method: umap-v1, pca-v1, bootstrap, then any other."""
    m = F.col("projection_method")
    rank = F.when(m == "umap-v1", 1).when(m == "pca-v1", 2).when(m == "bootstrap-deterministic", 3).otherwise(4)
    best = projections.groupBy("scope", "target_id", "model_id").agg(F.min_by(F.struct("projection_method", "x", "y"), F.struct(rank, m)).alias("p"))
    return best.select("scope", "target_id", "model_id", "p.*")


def filename_conflicts(images: DataFrame) -> DataFrame:
    """File names that more than one image has, with those images."""
    return images.groupBy("file_name").agg(F.count("*").alias("items"), F.array_sort(F.collect_list("image_id")).alias("image_ids")).where("items > 1")


def conflict_rows(images: DataFrame) -> DataFrame:
    repeated = images.groupBy("file_name").agg(F.count("*").alias("n")).where("n > 1").select("file_name")
    return images.join(repeated, "file_name", "left_semi")


def staged_names(images: DataFrame) -> DataFrame:
    """Names by a counter for each original name: the first keeps it, the k-th after it gets -k.

    Ranked in buckets of the ids, so a name that very many images have is shared by tasks.
    """
    ranked = distributed_rank(images, ["image_id"], spread_bucket(images, "image_id"), "k_", ["file_name"])
    ext = F.regexp_extract("file_name", r"(?<=.)(\.[^.]*)$", 1)
    name = F.when(F.col("k_") == 1, F.col("file_name")).otherwise(F.concat(fn.stem(F.col("file_name")), F.lit("-"), (F.col("k_") - 1).cast("string"), ext))
    return ranked.select(*images.columns, name.alias("staged_name"))


def spread_bucket(rows: DataFrame, column: str, cuts: int = 64) -> Column:
    """A bucket number that does not fall as the column rises, by at most `cuts` of its values, drawn by hash."""
    drawn = rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(F.xxhash64(column), column).limit(cuts).collect()
    if not drawn:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(r[0]) for r in drawn]), lambda x: x <= F.col(column))), F.lit(0))


def _name_families(names: DataFrame, group: list[str]) -> DataFrame | None:
    """group, file_name, root of names that can meet each other's new names; None where there are none.

    names: distinct names with n, their rows. A name 'a-3.jpg' can meet the new names of 'a.jpg' only if that one is
    repeated (or displaced itself) often enough to get that far: 3 is at most its rows and the names of that form.
    """
    stem, ext = fn.stem(F.col("file_name")), F.regexp_extract("file_name", r"(?<=.)(\.[^.]*)$", 1)
    form = r"^(.+)-([1-9][0-9]{0,8})$"
    child = names.where(stem.rlike(form)).select(*group, F.col("file_name").alias("child"), F.concat(F.regexp_extract(stem, form, 1), ext).alias("file_name"), F.regexp_extract(stem, form, 2).cast("long").alias("k"))
    both = [*group, "file_name"]
    # bases are counted before they meet names: all frame-<k>.jpg are of frame.jpg, whether it is there or not
    bases = written(child.groupBy(*both).agg(F.count("*").alias("c")).join(names, both, "left"), "name-bases")
    large = bases.where(F.col("c") > LARGE)  # at most a row for each LARGE names
    some = child.join(F.broadcast(large.where("n is not null")), both).unionByName(child.join(F.broadcast(large.select(*both)), both, "left_anti").join(bases.where((F.col("c") <= LARGE) & F.col("n").isNotNull()), both))
    pairs = some.where(F.col("k") <= F.col("n") + F.col("c"))
    pairs = written(pairs.select(*both, "child"), "name-pairs")
    if pairs.isEmpty():
        return None
    live = names.where("n > 1").select(*both)
    if pairs.join(live, both, "left_semi").isEmpty():
        return None
    while True:  # as often as names have such endings one after the other
        more = written(pairs.join(live, both, "left_semi").select(*group, F.col("child").alias("file_name")).join(live, both, "left_anti"), "names-more")
        if more.isEmpty():
            break
        live = written(live.unionByName(more).distinct(), "names-live")
    edges = written(pairs.join(live, both, "left_semi"), "name-edges")
    level = live.join(edges.select(*group, F.col("child").alias("file_name")), both, "left_anti").withColumn("root", F.col("file_name"))
    out = level
    while True:
        level = written(edges.join(level, both).select(*group, F.col("child").alias("file_name"), "root"), "names-level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def unique_names(images: DataFrame, order: str = "image_id", group: list[str] | None = None) -> DataFrame:
    """A name of its own for each row of a group, in order: a taken name gets -k with the smallest k not taken before.

    Names that no new name can meet are numbered by rank, in buckets of the order, so a name that very many rows have is
    shared by tasks. Only families of names that do meet (see _name_families) are folded in order, a family a task.
    A null name stays null; of rows with equal order any may come first.
    """
    group = group or []
    images = written(images, "names")
    ext = F.regexp_extract("file_name", r"(?<=.)(\.[^.]*)$", 1)
    key = [*group, "file_name"]
    names = written(images.where("file_name is not null").groupBy(*key).agg(F.count("*").alias("n")), "names-counted")
    if names.where("n > 1").isEmpty():
        return images.withColumn("unique_name", F.col("file_name"))
    families = _name_families(names, group)
    rest, folded = images, None
    if families is not None:
        families = written(families, "name-families")
        met = families.join(families.groupBy(*group, "root").agg(F.count("*").alias("size_")).where("size_ > 1").select(*group, "root"), [*group, "root"])
        rest = images.join(met.select(*key), key, "left_anti")
        part = images.join(met, key)
        columns = images.columns

        def fold(pdf):
            pdf = pdf.sort_values(order, kind="stable")
            taken: set[str] = set()
            last: dict[str, int] = {}
            new_names = []
            for name in pdf["file_name"]:
                new = name
                if new in taken:
                    head, dot, tail = name.rpartition(".")
                    head, tail = (head, dot + tail) if head else (name, "")
                    k = last.get(name, 0)
                    while new in taken:
                        k += 1
                        new = f"{head}-{k}{tail}"
                    last[name] = k
                taken.add(new)
                new_names.append(new)
            return pdf[columns].assign(unique_name=new_names)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema) + ", unique_name string"
        folded = part.groupBy(*group, "root").applyInPandas(fold, schema)
    twice = rest.join(names.where("n > 1").select(*key), key, "left_semi")
    once = rest.join(names.where("n > 1").select(*key), key, "left_anti").withColumn("unique_name", F.col("file_name"))
    ranked = distributed_rank(twice, [order], spread_bucket(twice, order), "k_", key)
    new = F.when(F.col("k_") == 1, F.col("file_name")).otherwise(F.concat(fn.stem(F.col("file_name")), F.lit("-"), (F.col("k_") - 1).cast("string"), ext))
    out = once.unionByName(ranked.withColumn("unique_name", new).select(*once.columns))
    return (out if folded is None else out.unionByName(folded)).select(*images.columns, "unique_name")


def resolve_conflicts(images: DataFrame, decisions: DataFrame) -> DataFrame:
    """Names after decisions (file_name, image_id or null for all, action suffix/rename/skip, new_name), then suffixes."""
    one = decisions.where("image_id is not null").select("image_id", F.col("action").alias("a1"), F.col("new_name").alias("n1"))
    all_ = decisions.where("image_id is null").select("file_name", F.col("action").alias("a2"), F.col("new_name").alias("n2"))
    rows = images.join(one, "image_id", "left").join(all_, "file_name", "left")
    action = F.coalesce("a1", "a2", F.lit("suffix"))
    named = rows.where(action != "skip").withColumn("file_name", F.when(action == "rename", F.coalesce("n1", "n2", "file_name")).otherwise(F.col("file_name")))
    return unique_names(named.select(*images.columns))


def batches(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows by order (a top-k)."""
    return rows.orderBy(*order).limit(limit)
