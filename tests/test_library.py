"""Pinned values of the dataset library on small inputs."""

import gzip
import hashlib
import json
import math
import random
import struct
import time
from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from framewell.functions import scalars as fn
from framewell.functions import storage
from framewell.operators import analysis, browse, neighbours, ranking, sampling, scope, snapshots, tables, validate, vectors
from framewell.plans import dataset, export, queries
from framewell.sources import bigjson, coco, files, yolo
from framewell.streaming import jobs

BOX = "annotation_id string, image_id string, source_id string, source_category_id string, annotation_format string, bbox_x double, bbox_y double, bbox_width double, bbox_height double"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("ratios", [(0.7, 0.15, 0.15), (3, 1, 1), (1, 0, 0), (0.2, 0.5, 0.3)])
def test_split_sizes(ratios):
    for total in range(0, 120):
        sizes = ranking.split_sizes(total, ratios)
        assert sum(sizes) == total and min(sizes) >= 0
        assert all(sizes[i] == math.floor(total * ratios[i] / sum(ratios)) for i in (0, 1))
    assert ranking.split_sizes(9, (0, 0, 0)) == (0, 0, 0)


def test_seeded_split_is_a_stable_partition(spark):
    d = spark.range(101).select(F.concat(F.lit("img-"), "id").alias("image_id"))
    a, b = (ranking.seeded_split(d, 3).orderBy("image_id").collect() for _ in range(2))
    assert a == b
    assert sorted(r.position for r in a) == list(range(1, 102))
    n = {s: sum(r.split == s for r in a) for s in ("train", "valid", "test")}
    assert tuple(n.values()) == ranking.split_sizes(101, (0.7, 0.15, 0.15))


def _sequential_names(names):
    taken, out = set(), []
    for n in names:
        stem, dot, ext = n.rpartition(".")
        new, k = n, 0
        while new in taken:
            k += 1
            new = f"{stem}-{k}.{ext}" if dot and stem else f"{n}-{k}"
        taken.add(new)
        out.append(new)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_follow_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    pool = ["a.jpg", "a-1.jpg", "a-2.jpg", "a-1-1.jpg", "a-1-1-1.jpg", "a-7.jpg", "a-90.jpg", "b.jpg", "b-01.jpg", "b-0.jpg", "c", "c-1", ".d", ".d-1", "e-3.png", "é.jpg", "a-1.png"]
    names = [rng.choice(pool[: rng.choice([3, 8, 17])]) for _ in range(60)]
    d = spark.createDataFrame([(f"{i:03d}", n) for i, n in enumerate(names)], "image_id string, file_name string")
    got = {r.image_id: r.unique_name for r in ranking.unique_names(d).collect()}
    assert [got[f"{i:03d}"] for i in range(60)] == _sequential_names(names)
    grouped = d.withColumn("g", F.substring("image_id", 3, 1).cast("int") % 2)
    got = {r.image_id: r.unique_name for r in ranking.unique_names(grouped, group=["g"]).collect()}
    for g in (0, 1):
        own = [i for i in range(60) if i % 10 % 2 == g]
        assert [got[f"{i:03d}"] for i in own] == _sequential_names([names[i] for i in own])


def test_unique_names_of_one_name_are_shared_by_tasks(spark):
    d = spark.range(5000).select(F.col("id").alias("image_id"), F.lit("x.jpg").alias("file_name"))
    out = ranking.unique_names(d)
    got = {r.image_id: r.unique_name for r in out.collect()}
    assert all(got[i] == (f"x-{i}.jpg" if i else "x.jpg") for i in range(5000))
    bucket = ranking.spread_bucket(d, "image_id")
    assert d.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0] < 1500
    empty = spark.createDataFrame([], "image_id string, file_name string")
    assert ranking.unique_names(empty).count() == 0


@pytest.mark.parametrize("there", [False, True])
def test_names_of_one_base_are_not_dealt_out_by_it(spark, monkeypatch, there):
    monkeypatch.setattr(ranking, "LARGE", 100)
    names = ["a.jpg", "a.jpg", "frame-7.jpg", *(f"frame-{i}.jpg" for i in range(1, 3001)), *(["frame.jpg"] * 2 if there else [])]
    rows = spark.createDataFrame([(f"{i:05}", n) for i, n in enumerate(names)], "image_id string, file_name string").groupBy("file_name").agg(F.count("*").alias("n"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables too large to be sent to all tasks
    try:
        rows = ranking.written(rows, "names")
        before = _shuffled_rows(spark)
        found = ranking._name_families(rows, [])
        assert found.count() == 3002 if there else found is None
        assert there or sum(n for i, n in _shuffled_rows(spark).items() if i not in before) < 4500  # the names, and not those of the base besides
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_layout(spark):
    rows = [("a", "image.jpg"), ("b", "images/x.jpg"), ("b", "labels/x.txt"), ("c", "annotations/instances.json"), ("d", "data.yaml"), ("e", "x.JSON"), ("f", "images/x.jpg")]
    got = {r.source: r.type for r in files.detect_layout(spark.createDataFrame(rows, "source string, relative string")).collect()}
    assert got == {"a": "RAW", "b": "YOLO", "c": "COCO", "d": "YOLO", "e": "COCO", "f": "RAW"}


def test_label_pairing(spark):
    img = spark.createDataFrame([("train/images/sample.jpg",), ("images/deep/y.jpg",), ("z.jpg",), ("w.jpg",)], "relative string")
    lab = spark.createDataFrame([("train/labels/sample.txt",), ("labels/sample.txt",), ("labels/deep/y.txt",), ("labels/other/z.txt",)], "relative string")
    got = {r.image: r.label for r in files.match_labels(img, lab).collect()}
    assert got == {"train/images/sample.jpg": "train/labels/sample.txt", "images/deep/y.jpg": "labels/deep/y.txt", "z.jpg": "labels/other/z.txt", "w.jpg": "w.txt"}


def test_scalars(spark):
    r = one(spark, fn.numeric(F.lit("7.50")).alias("a"), fn.numeric(F.lit("\t 12e1 ".strip("\t"))).alias("b"), fn.numeric(F.lit("4,5")).alias("c"), fn.slug(F.lit("__Blue Van/(2)ü")).alias("d"), fn.percent_label(F.lit(0.0575)).alias("e"), fn.json_id(F.lit('"q9"')).alias("f"), fn.json_id(F.lit("3.5")).alias("g"), fn.slug(F.lit("!?"), "none").alias("h"))
    assert tuple(r) == (7.5, 120.0, None, "blue-van-2", "5.8%", "q9", None, "none")


def test_box_functions(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(0, 400), rng.uniform(0, 300), rng.uniform(1, 200), rng.uniform(1, 150), rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(40)]
    d = spark.createDataFrame(rows, "x double, y double, w double, h double, iw int, ih int")
    box = tuple(F.col(c) for c in "xywh")
    norm = fn.to_normalized(F.lit("coco"), box, F.col("iw"), F.col("ih"))
    back = fn.to_absolute(F.lit("yolo"), tuple(F.col(f"n{i}") for i in range(4)), F.col("iw"), F.col("ih"))
    for r in d.select("*", *(n.alias(f"n{i}") for i, n in enumerate(norm))).select("*", *(b.alias(f"b{i}") for i, b in enumerate(back)), fn.label_line(F.lit(3), *(F.col(f"n{i}") for i in range(4))).alias("line"), fn.map_area_ratio(F.col("w"), F.col("h"), F.col("iw"), F.col("ih")).alias("ratio"), fn.crop_window(box, F.col("iw"), F.col("ih")).alias("c")).collect():
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip((r.b0, r.b1, r.b2, r.b3), (r.x, r.y, r.w, r.h)))
        assert r.line.split()[0] == "3" and all(abs(float(v) - n) <= 5.1e-7 and len(v.split(".")[1]) == 6 for v, n in zip(r.line.split()[1:], (r.n0, r.n1, r.n2, r.n3)))
        assert math.isclose(r.ratio, r.w * r.h / (r.iw * r.ih))
        assert 0 <= r.c.left < r.c.right <= r.iw and 0 <= r.c.top < r.c.bottom <= r.ih
    assert one(spark, fn.area_ratio(F.lit("coco"), F.lit(2.0), F.lit(2.0), F.lit(0), F.lit(5)).alias("none")).none is None
    w = one(spark, fn.crop_window(tuple(F.lit(v) for v in (-2.5, 7.2, 2.0, 0.0)), F.lit(8), F.lit(8)).alias("c")).c
    assert (w.left, w.top, w.right, w.bottom) == (0, 7, 1, 8)


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 5)
    jpg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 5, 7)
    bmp = b"BM" + bytes(12) + struct.pack("<Iii", 40, 7, -5)
    old = b"BM" + bytes(12) + struct.pack("<IHH", 12, 7, 5)
    vp8x = b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (6).to_bytes(3, "little") + (4).to_bytes(3, "little")
    vp8l = b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + (6 | 4 << 14).to_bytes(4, "little") + bytes(5)
    vp8 = b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(10) + struct.pack("<HH", 7, 5)
    tif = lambda o, m: m + struct.pack(o + "HIHHHIHHHHIHH", 42, 8, 2, 256, 3, 1, 7, 0, 257, 3, 1, 5, 0)
    for name, b in (("a.png", png), ("a.JPG", jpg), ("a.bmp", bmp), ("b.bmp", old), ("a.webp", vp8x), ("b.webp", vp8l), ("c.webp", vp8), ("a.tif", tif("<", b"II")), ("b.tiff", tif(">", b"MM"))):
        assert files.header_size(name, b) == (7, 5, None), name
        assert files.header_size(name, b[:9])[2]


def test_yolo_text(spark):
    text = "0 0.5 0.5 0.25 0.25 extra\n\nbad 1 2 3 4\n1 0.1 0.2\n-1 0 0 0 0\n2\t0.1 0.2  0.3 0.4\r\n"
    rows = yolo.parse_labels(spark.createDataFrame([("i", text), ("j", "")], "image_id string, text string")).orderBy("line").collect()
    assert [(r.line, r.class_index, r.bbox_width) for r in rows] == [(0, 0, 0.25), (5, 2, 0.3)]
    assert yolo.yaml_names("nc: 2\nnames: ['cat', \"dog\"]\n") == ["cat", "dog"]
    assert yolo.yaml_names("names:\n  1: dog # x\n  0: cat\nnc: 2\n") == ["cat", "dog"]
    assert yolo.yaml_names("names:\n- cat\n- 'dog'\nnc: 2") == ["cat", "dog"]


def _write_coco(path, images, categories, annotations):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"images": images, "categories": categories, "annotations": annotations}))


def test_coco_reader(spark, tmp_path):
    pics = [{"id": i, "file_name": f"{i}.jpg", "width": 640, "height": 480} for i in range(5)]
    boxes = [{"id": i, "image_id": i % 5, "category_id": 1 + i % 2, "bbox": [1, "2.0", " 3 ", 4]} for i in range(12)]
    boxes += [{"id": 90, "image_id": 99, "category_id": 1, "bbox": [1, 2, 3, 4]}, {"id": 91, "image_id": 1, "category_id": 1, "bbox": [1, 2]}, {"id": 92, "image_id": 1, "category_id": 1, "bbox": [1, 2, "x", 4]}]
    _write_coco(tmp_path / "all.json", pics, [{"id": 1, "name": "cat"}, {"id": 2, "name": "dog"}], boxes)
    images, cats, anns = coco.tables(coco.read_coco(spark, str(tmp_path))[0], "s")
    assert (images.count(), anns.count(), cats.count()) == (5, 12, 2)
    assert {r.annotation_id for r in anns.collect()} >= {"ann-s-0", "ann-s-11"}


def test_coco_splits_and_pipeline(spark, tmp_path):
    for n, s in enumerate(("train", "valid")):
        pics = [{"id": i, "file_name": f"{s}{i}.jpg", "width": 64, "height": 48} for i in range(5)]
        boxes = [{"id": i, "image_id": i % 5, "category_id": 1, "bbox": [1, 2, 3, 4]} for i in range(20)] + [{"id": 99, "image_id": 77, "category_id": 1, "bbox": [1, 2, 3, 4]}]
        _write_coco(tmp_path / s / "_annotations.coco.json", pics, [{"id": 0, "name": "none"}, {"id": 1, "name": "ball" if n else " Ball"}], boxes)
    root = coco.visible(spark, str(tmp_path), str(tmp_path / "seen"))
    parts = coco.read_splits(spark, root)
    got = {r.split: (r.images, r.annotations, r.skipped) for r in coco.ingest_summary(parts).collect()}
    assert got == {"train": (5, 20, 1), "valid": (5, 20, 1), "*": (10, 40, 2)}
    assert {(r.key, r.name) for r in parts["categories"].collect()} == {("none", "none"), ("ball", " Ball")}
    out = dataset.run_pipeline(spark, root, 0.4)
    assert out["sampling"].first().selected_images == 4 and out["images"].count() == 4 and out["annotations"].count() > 0
    assert sorted(r.new_id for r in out["images"].collect()) == [1, 2, 3, 4]


def test_an_ingest_counts_boxes_by_image(spark, tmp_path):
    boxes = [{"id": i, "image_id": i % 5, "category_id": 1, "bbox": [1, 2, 3, 4]} for i in range(3000)]
    _write_coco(tmp_path / "train" / "annotations.coco.json", [{"id": i, "file_name": f"{i}.jpg"} for i in range(4)], [{"id": 1, "name": "a"}, {"id": 1, "name": "b"}], boxes)
    summary = coco.ingest_summary(coco.read_splits(spark, str(tmp_path)))
    before = _shuffled_rows(spark)
    assert {tuple(r) for r in summary.collect()} == {(s, 4, 2400, 600) for s in ("train", "*")}  # a class that comes twice does not double its boxes
    assert sum(n for i, n in _shuffled_rows(spark).items() if i not in before) < 500


def test_exclusions(spark):
    boxes = spark.createDataFrame([("img-1", "ann-1"), ("img-1", "ann-2"), ("img-2", "ann-3")], "image_id string, annotation_id string")
    marks = spark.createDataFrame([("image", "img-2", "exclude", 1, 1), ("object", "ann-1", "exclude", 2, 2), ("object", "ann-2", "exclude", 1, 3), ("object", "ann-2", "keep", 2, 4)], "scope string, target_id string, status string, updated_at int, event_id int")
    assert [(r.image_id, r.annotation_id) for r in scope.apply_exclusions(boxes, marks).collect()] == [("img-1", "ann-2")]
    assert tuple(scope.count_exclusions(boxes, marks).first()) == (1, 1)


def test_upsert_keeps_created(spark):
    cols = "target_id string, status string, note string, created_at int, updated_at int"
    rng = random.Random(9)
    rows = [(f"t{rng.randrange(6)}", f"s{i}", None if i % 3 else f"n{i}", i, i) for i in range(40)]
    t, u = (spark.createDataFrame(x, cols) for x in (rows[:15], rows[15:]))
    for r in tables.upsert(t, u, ["target_id"], F.col("updated_at")).collect():
        own = [x for x in rows if x[0] == r.target_id]
        assert (r.status, r.note, r.created_at, r.updated_at) == (own[-1][1], own[-1][2], own[0][3], own[-1][4])


def test_changes_of_several_tables_are_one_commit(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "store"), 8)
    kinds = {"images": "source_id string, x int", "boxes": "source_id string, y int"}
    rows = {"images": [(f"s{i % 5}", i) for i in range(50)] + [(None, 99)], "boxes": [(f"s{i % 4}", i) for i in range(40)]}
    store.create({n: (spark.createDataFrame(rows[n], k), ["source_id"]) for n, k in kinds.items()})
    before, folders = {n: store.read(n) for n in kinds}, store.state()[1]["images"]["buckets"]
    new = {"images": [("s1", 7), ("s1", 8)], "boxes": []}
    change = {n: spark.createDataFrame(new[n], k) for n, k in kinds.items()}
    assert snapshots.replace_source(store, "s1", change) == 1
    seen = lambda of: {n: sorted(((r[0], r[1]) for r in d.collect()), key=repr) for n, d in of.items()}
    assert seen(before) == {n: sorted(r, key=repr) for n, r in rows.items()}  # a reader of before sees what was there
    assert seen({n: store.read(n) for n in kinds}) == {n: sorted([*(x for x in r if x[0] != "s1"), *new[n]], key=repr) for n, r in rows.items()}
    after = store.state()[1]["images"]["buckets"]
    assert sum(after[b] == p for b, p in folders.items()) >= len(folders) - 1 and after != folders  # other buckets keep their files
    with pytest.raises(snapshots.Conflict):
        snapshots.replace_source(store, "s2", change, version=0)
    assert store.versions() == [0, 1] and not [p for p in (tmp_path / "store/log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    assert snapshots.replace_source(store, "gone", {"boxes": change["boxes"]}) == 2
    store.vacuum(1)
    assert seen({n: store.read(n) for n in kinds})["images"] == sorted([*(x for x in rows["images"] if x[0] != "s1"), *new["images"]], key=repr)
    assert len(list((tmp_path / "store/data/images").glob("*"))) == 2


def test_rows_of_a_change_are_computed_once(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "store"), 4)
    plain = "source_id string, name string, image_count long, category_count long, status string"
    store.create({"sources": (spark.createDataFrame([("s1", "a", 0, 0, "new"), ("s2", "b", 0, 0, "new")], plain), ["source_id"]), "images": (spark.createDataFrame([("s1", 1, "healthy"), ("s2", 2, "healthy")], "source_id string, x long, health_status string"), ["source_id"]), "categories": (spark.createDataFrame([("s1", "c")], "source_id string, name string"), ["source_id"])})
    times = spark.sparkContext.accumulator(0)

    def seen(x):
        times.add(1)
        return "s2"

    once = F.udf(seen, "string")
    scanned = lambda n: spark.range(n).select(once("id").alias("source_id"), F.col("id").cast("int").alias("x"), F.lit("healthy").alias("health_status"))
    snapshots.replace_source(store, "s2", {"images": scanned(30)})
    assert times.value == 30
    snapshots.rescan(store, "s2", {"images": scanned(50), "categories": spark.createDataFrame([("s2", "d")], "source_id string, name string")})
    assert times.value == 80
    assert sorted((r.source_id, r.x) for r in store.read("images").collect()) == [("s1", 1), *(("s2", i) for i in range(50))]
    assert {r.source_id: r.image_count for r in store.read("sources").collect()} == {"s1": 0, "s2": 50}


def test_upsert_in_a_store(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "store"), 4)
    cols = "target_id string, status string, created_at int, updated_at int"
    rows = [(f"t{i % 9}", f"s{i}", i, i) for i in range(40)]
    store.create({"marks": (spark.createDataFrame(rows[:9], cols), ["target_id"])})
    for part in (rows[9:20], rows[20:], []):
        store.upsert("marks", spark.createDataFrame(part, cols), F.col("updated_at"))
    assert sorted(map(tuple, store.read("marks").collect())) == sorted((f"t{k}", f"s{max(range(k, 40, 9))}", k, max(range(k, 40, 9))) for k in range(9))


def test_best_projection(spark):
    rows = [("object", f"t{i}", "m", m, float(k), float(-i)) for i in range(4) for k, m in enumerate(("other", "bootstrap-deterministic", "pca-v1", "umap-v1")[: i + 1])]
    got = {r.target_id: (r.x, r.y) for r in ranking.best_projection(spark.createDataFrame(rows, "scope string, target_id string, model_id string, projection_method string, x double, y double")).collect()}
    assert got == {f"t{i}": (float(i), float(-i)) for i in range(4)}


def test_kept_vectors_and_sets(spark):
    old = spark.createDataFrame([("o", "a", "m", [3.0, 4.0]), ("o", "b", "m", [1.0])], "scope string, target_id string, model_id string, vector array<double>")
    first = tables.write_embeddings(old.limit(0), old)
    second = tables.write_embeddings(first, spark.createDataFrame([("o", "b", "m", [2.0, None]), ("i", "b", "m", None)], old.schema))
    got = {(r.scope, r.target_id): r.vector_norm for r in second.collect()}
    assert got[("o", "a")] == 5.0 and len(got) == 3 and got[("i", "b")] is None
    sources = spark.createDataFrame([("s1", "/a"), ("s2", "/b")], "source_id string, path string")
    with pytest.raises(ValueError):
        tables.rescan_source(sources, {}, "s9", {})


def test_sample_sets_refuse_or_replace(spark, tmp_path):
    at = str(tmp_path / "sets")
    d = spark.createDataFrame([("a",), ("b",)], "image_id string")
    export.write_sample_set(d, at, "x", overwrite=False)
    with pytest.raises(ValueError):
        export.write_sample_set(d, at, "x", overwrite=False)
    export.write_sample_set(d.limit(1), at, "y")
    export.write_sample_set(d.where("image_id = 'b'"), at, "x")
    assert sorted((r.sample_set, r.image_id) for r in spark.read.parquet(at).collect() if r.sample_set == "x") == [("x", "b")]


def test_jobs_and_copies(spark, tmp_path):
    for k in range(3):
        export.append_job(spark, str(tmp_path / "jobs"), "coco", f"/out/{k}", k, 2 * k)
    rows = export.export_history(spark.read.parquet(str(tmp_path / "jobs"))).collect()
    assert [r.exported_boxes for r in rows] == [4, 2, 0] and len({r.job_id for r in rows}) == 3
    (tmp_path / "one.bin").write_bytes(b"123")
    export.copy_images(spark.createDataFrame([(str(tmp_path / "one.bin"), "t/1.bin"), (str(tmp_path / "gone.bin"), "t/2.bin")], "original_path string, target string"), str(tmp_path / "copies"))
    assert [p.name for p in (tmp_path / "copies/t").iterdir()] == ["1.bin"]


def test_listing_probe_and_names_of_real_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 9, 4)
    for name, content in (("images/a.png", png), ("images/b.PNG", png[:20]), ("labels/a.txt", b"0 0.5 0.5 0.1 0.1"), ("data.yaml", b"names: [cat, 'dog']\n"), ("notes.json", b"{}")):
        (tmp_path / "set" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / name).write_bytes(content)
    root = str(tmp_path / "set")
    listed = files.listing(spark, root)
    assert sorted(r.relative for r in listed.collect()) == ["data.yaml", "images/a.png", "images/b.PNG", "labels/a.txt", "notes.json"]
    probed = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.health_status) for r in files.probe_images(spark, root).collect()}
    assert probed == {"a.png": (9, 4, "healthy"), "b.PNG": (None, None, "corrupted")}
    assert [(r.class_index, r.name) for r in yolo.read_names(spark, root).orderBy("class_index").collect()] == [(0, "cat"), (1, "dog")]
    assert {r.file_name for r in files.read_raw(spark, root, "s").collect()} == {"a.png", "b.PNG"}
    ids = files.source_images(files.probe_images(spark, root).unionByName(files.probe_images(spark, root).withColumn("path", F.regexp_replace("path", "a.png", "a_png"))), "s", root)
    assert ids.select("image_id").distinct().count() >= 3


def test_projection_follows_the_scatter_matrix(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6)) * [5, 3, 1, 0.5, 0.2, 0.1] + 4
    rows = [(f"v{i:02}", v.tolist()) for i, v in enumerate(x)] + [("short", [1.0, 2.0]), ("gap", [1.0, None, 0.5]), ("none", None)]
    full = np.concatenate([x, [[1, 2, 0, 0, 0, 0], [1, 0, 0.5, 0, 0, 0]]])
    d = spark.createDataFrame(rows, "target_id string, vector array<double>")
    n, mean, g = vectors.moments(d)
    centred = full - full.mean(0)
    assert n == 82 and np.allclose(mean, full.mean(0)) and np.allclose(g, centred.T @ centred)
    axes = np.linalg.eigh(g)[1][:, ::-1][:, :2]
    want = centred @ axes / np.abs(centred @ axes).max(0)
    got = {r.target_id: (r.x, r.y) for r in vectors.pca_2d(d).collect()}
    assert "none" not in got and len(got) == 82
    mine = np.array([got[r[0]] for r in rows[:-1]])
    for k in (0, 1):
        assert min(np.abs(mine[:, k] - s * want[:, k]).max() for s in (1, -1)) < 0.02
    thin = {r.target_id: r.vector for r in vectors.pca_denoise(d, 3).collect()}
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    c = unit - unit.mean(0)
    back = c @ np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :3]
    back /= np.linalg.norm(back, axis=1, keepdims=True)
    assert np.allclose(np.abs(np.array([thin[r[0]] for r in rows[:-1]])), np.abs(back), atol=1e-6)


def test_neighbours_of_ragged_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(f"v{i:02}", rng.normal(size=3 + i % 2).tolist()) for i in range(40)] + [("none", None), ("gap", [None, 1.0, 2.0])]
    d = spark.createDataFrame(rows, "target_id string, vector array<double>")
    full = {t: np.array([0.0 if v is None else v for v in x] + [0.0] * (4 - len(x))) for t, x in rows if x is not None}
    got = neighbours.knn_cosine(d, 5, block=7, first=9).collect()
    for t, x in full.items():
        near = sorted((round(1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y), 12), u) for u, y in full.items() if u != t)[:5]
        mine = sorted((r["rank"], r.neighbour) for r in got if r.target_id == t)
        assert [u for _, u in mine] == [u for _, u in near]
    assert neighbours.knn_cosine(d.limit(0), 5).count() == 0


def _shuffled_rows(spark):
    """Rows that the session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    lists = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(lists(), False, False, sc._gateway.new_array(sc._jvm.double, 0), lists())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_neighbours_without_clusters_shuffle_a_vector_by_groups(spark):
    x = np.random.default_rng(3).normal(size=(1500, 24))
    d = spark.createDataFrame([(f"v{i:04}", v.tolist()) for i, v in enumerate(x)], "target_id string, vector array<double>")
    before = _shuffled_rows(spark)
    edges, compared = neighbours.nearest(d, k=3, block=8, first=16)
    got = {(r.target_id, r["rank"]): r.neighbour for r in edges.collect()}
    rows = sum(n for i, n in _shuffled_rows(spark).items() if i not in before)
    want = _nearest(x, [f"v{i:04}" for i in range(len(x))], 3)
    assert got == {(t, k): u for t, near in want.items() for k, u in enumerate(near, 1)}
    assert compared.first()[0] > 0.8 * len(x) ** 2  # nearly all of some 190 annuli are visited
    assert rows < 90 * len(x)


def test_hash_layout_spreads(spark):
    xy = vectors.hash_points([f"scope:model:{i * 37}-é" for i in range(4000)] + [""])
    assert np.abs(xy).max() <= 1 and len(np.unique(xy, axis=0)) == 4001
    assert all(np.histogram(xy[:, k], 16, (-1, 1))[0].min() > 180 for k in (0, 1)) and abs(np.corrcoef(xy.T)[0, 1]) < 0.06
    h = 0xCBF29CE484222325
    for b in "scope:model:0-é".encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    z = (h + 0x9E3779B97F4A7C15) % 2**64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
    assert xy[0, 0] == ((z ^ z >> 31) >> 11) / 2**53 * 2 - 1


def test_blobs_and_tensors(spark):
    v = np.random.default_rng(1).normal(size=9).astype("<f4")
    blob = spark.createDataFrame([(bytearray(v.tobytes()),), (bytearray(b"abcde"),), (None,)], "vector binary")
    assert [r.vector for r in vectors.decode_blobs(blob).collect()] == [v.tolist(), None, None]
    x = np.arange(30.0)
    assert vectors.pooled(x.reshape(3, 10), 3).tolist() == x.reshape(3, 10).tolist() == vectors.pooled(x, 3).tolist()
    assert vectors.pooled(x.reshape(3, 5, 2), 3).tolist() == x.reshape(3, 5, 2)[:, 0].tolist()
    for n in (2, 7):
        with pytest.raises(ValueError):
            vectors.pooled(x.reshape(3, 10), n)
    pixels = np.random.default_rng(2).integers(0, 256, (6, 9, 3)).astype(np.uint8)
    same = vectors.crop_tensor(pixels, (2, 1, 6, 5), 4, [0.1, 0.2, 0.3], [0.5, 1, 2])
    assert same.shape == (3, 4, 4) and np.allclose(same.transpose(1, 2, 0) * [0.5, 1, 2] + [0.1, 0.2, 0.3], pixels[1:5, 2:6] / 255, atol=1e-6)


def test_embedding_retries_single_items(spark):
    def factory():
        mock = vectors.mock_encoder(8)

        def run(ids, px):
            if "bad" in ids:
                raise RuntimeError("unreadable")
            return mock(ids, px)

        return run

    d = spark.createDataFrame([("x",), ("bad",), ("y",)], "target_id string")
    got, failed = (t.collect() for t in vectors.embed(d, factory))
    assert [tuple(r) for r in failed] == [("bad", "RuntimeError: unreadable")]
    assert sorted(r.target_id for r in got) == ["x", "y"] and all(math.isclose(sum(v * v for v in r.vector), 1, rel_tol=1e-5) for r in got)


def test_encoders_by_name(spark):
    d = spark.createDataFrame([("a", [[[0, 128, 255]] * 3] * 2), ("b", [[[9, 9, 9]] * 5] * 4), ("c", None)], "target_id string, pixels array<array<array<int>>>")

    def means(x):  # as long as the model's vectors, from the channels' means
        return np.repeat(x.mean((2, 3)), 171, 1)[:, :512]

    got, failed = (t.collect() for t in vectors.embed(d, vectors.encoder("clip-vit-b32", means)))
    assert [r.target_id for r in failed] == ["c"] and sorted(r.target_id for r in got) == ["a", "b"]
    a = next(r for r in got if r.target_id == "a")
    raw = [(v / 255 - m) / s for v, m, s in zip((0, 128, 255), vectors.MODELS["clip-vit-b32"].mean, vectors.MODELS["clip-vit-b32"].std)]
    assert len(a.vector) == 512 and np.allclose(np.array(a.vector)[[0, 171, 342]] * a.vector_norm, raw, atol=1e-4)
    assert [r.error for r in vectors.embed(d.where("target_id = 'a'"), vectors.encoder("dinov2-small", means))[1].collect()] == ["ValueError: dinov2-small makes vectors of 384 numbers, not 512"]
    assert len(vectors.embed(d.select("target_id"), vectors.encoder("dinov2-small"))[0].first().vector) == 384
    with pytest.raises(ValueError):
        vectors.encoder("unknown")


def _clusters(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(4):
        centre = rng.normal(size=32)
        rows += [(f"o{c}-{i:02d}", f"img{(c * 60 + i) // 2:03d}", f"k{c}", (centre + 0.1 * rng.normal(size=32)).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "target_id string, image_id string, class_id string, vector array<double>")


@pytest.mark.parametrize("mode", ["balanced", "diverse"])
def test_sampling(spark, mode):
    d = _clusters(spark)
    runs = [sampling.run_sampling(d, d.select("target_id", "class_id"), 1 / 3, mode, pca=16) for _ in range(2)]
    a, b = (sorted(tuple(map(str, r)) for r in m.collect()) for m, _ in runs)
    assert a == b
    s = runs[0][1].first()
    assert s.selected_images == 40 and s.target == 40 and not s.saturated


def _nearest(x, names, k):
    unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    d = np.round(np.maximum(1 - unit @ unit.T, 0), 12)
    return {t: [u for _, u in sorted((d[i, j], u) for j, u in enumerate(names) if j != i)[:k]] for i, t in enumerate(names)}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_neighbours_over_many_blocks(spark, adaptive):
    rng = np.random.default_rng(9)
    x = np.concatenate([c + 0.05 * rng.normal(size=(60, 12)) for c in rng.normal(size=(25, 12))] + [np.zeros((3, 12)), np.repeat(rng.normal(size=(1, 12)), 200, 0)])
    names = [f"v{i:04}" for i in range(len(x))]
    d = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x)], "target_id string, vector array<double>")
    want = _nearest(x, names, 6)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for sizes in ({"block": 16, "first": 40}, {}):
            edges, compared = neighbours.nearest(d, k=6, **sizes)
            got = {}
            for r in sorted(edges.collect(), key=lambda r: r["rank"]):
                got.setdefault(r.target_id, []).append(r.neighbour)
            assert got == want
            if sizes:
                assert compared.first()[0] < len(x) ** 2 / 3  # clustered vectors: far from all pairs
        half = d.where("target_id < 'v0700'")
        best = sampling.coverage_quality(d, half, block=16, first=40).first()
        unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
        assert best.vectors == len(x) and math.isclose(best.mean_similarity, (unit @ unit[:700].T).max(1).mean(), abs_tol=1e-9)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def _sequential(x, names, images, target, mode):
    """The rules of both choices, one pick after another, over all vectors."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    order, left, best = [], set(range(len(x))), None
    while left and len({images[i] for i in order}) < target:
        if best is None:
            score = np.round(x @ x.mean(0), 12) if mode == "diverse" else -np.round(x @ x.sum(0), 9)
        else:
            score = np.round(best, 12) if mode == "diverse" else -np.round(np.maximum(x @ x.T - best, 0).sum(1), 9)
        i = min(left, key=lambda i: (score[i], names[i]))
        order.append(i)
        left.discard(i)
        best = x @ x[i] if best is None else np.maximum(best, x @ x[i])
    return [names[i] for i in order]


@pytest.mark.parametrize("mode,pool", [("diverse", 7), ("diverse", 2048), ("balanced", 70), ("balanced", 2048)])
def test_choices_are_those_of_the_sequential_rule(spark, mode, pool):
    rng = np.random.default_rng(3)
    # 80 near copies of one vector come first by id, 40 equal vectors, and 60 with directions of their own
    x = np.concatenate([np.eye(1, 24) + 0.001 * rng.normal(size=(80, 24)), np.eye(1, 24, 3).repeat(40, 0), rng.normal(size=(60, 24))])
    names, images = [f"t{i:03}" for i in range(180)], [f"i{i // 2:03}" for i in range(180)]
    d = spark.createDataFrame([(n, i, v.tolist()) for n, i, v in zip(names, images, x)] + [("none", "i", None)], "target_id string, image_id string, vector array<double>")
    for target in (3, 45) if pool == 2048 else (12,):
        got = sorted(sampling.select(d, target, mode, pool).collect(), key=lambda r: r.pick)
        assert [r.target_id for r in got] == _sequential(x, names, images, target, mode)
        assert [r.pick for r in got] == list(range(len(got)))
    if pool == 2048:
        assert len(sampling.select(d, 500, mode, pool).collect()) == 180
        assert sampling.select(d.limit(0), 5, mode).count() == 0


def test_balanced_choice_takes_many_picks_a_pass(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8, 16))[rng.integers(0, 8, 1200)] + 0.4 * rng.normal(size=(1200, 16))
    names, images = [f"t{i:04}" for i in range(1200)], [f"i{i // 2:03}" for i in range(1200)]
    d = spark.createDataFrame([(n, i, v.tolist()) for n, i, v in zip(names, images, x)], "target_id string, image_id string, vector array<double>").repartition(2)
    spark.sparkContext.setJobGroup("balanced", "")
    got = sorted(sampling.select(d, 200, "balanced", 300).collect(), key=lambda r: r.pick)
    spark.sparkContext.setJobGroup("other", "")
    assert [r.target_id for r in got] == _sequential(x, names, images, 200, "balanced")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("balanced")) < 200  # not even a job a pick
    rows = sampling.packed(d, 16, ("target_id", "image_id"))
    few = sampling.facility(rows, 4, 300, entries=2000)  # pools cut to few pairs, some to one candidate
    assert [r.target_id for r in few.orderBy("pick").collect()] == [r.target_id for r in got[: few.count()]]


def _exchanges(d):
    return d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_boxes_lie_by_image_when_they_meet_the_images(spark):
    from framewell.fixtures import table

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables too large to be sent to all tasks
    try:
        boxes = table(spark, "/root/testdata/sf0.001", "v_annotations")
        ids = spark.range(9).select(F.concat(F.lit("img-"), "id").alias("image_id"))
        assert _exchanges(boxes.join(ids, "image_id")) == _exchanges(boxes) + 1  # that of the ids
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_excluded_boxes_are_not_dealt_out_by_their_ids(spark):
    boxes = spark.range(1000).select(F.concat(F.lit("i"), F.col("id") % 100).alias("image_id"), F.concat(F.lit("a"), "id").alias("annotation_id"))
    marks = spark.createDataFrame([("image", "i3", "exclude", 1, "e"), ("object", "a5", "exclude", 1, "e"), ("object", "a6", "exclude", 1, "a"), ("object", "a6", "keep", 2, "b")], "scope string, target_id string, status string, updated_at long, event_id string")
    left = scope.apply_exclusions(boxes, marks)
    assert left.count() == 989 and _exchanges(left) == 0


def test_many_small_files_are_probed_in_few_tasks(spark, tmp_path):
    export.write_files(spark.range(800).select(F.concat("id", F.lit(".png")).alias("path"), F.lit(b"not an image").alias("content")), str(tmp_path))
    found = files.probe_images(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and found.count() == 800
    assert sorted(x.name for x in tmp_path.iterdir() if x.suffix != ".png" and not x.name.startswith(".")) == ["_SUCCESS"]


def test_outlier_floor(spark):
    scores = spark.createDataFrame([(f"t{i}", float(i)) for i in range(10)], "target_id string, score double")
    classes = spark.createDataFrame([(f"t{i}", None if i > 7 else "a") for i in range(10)], "target_id string, class_id string")
    flags = {r.target_id: r.is_outlier for r in vectors.flag_outliers(scores, classes, 0.25, 1).collect()}
    assert flags == {f"t{i}": i == 9 for i in range(10)}


def test_validators(spark, tmp_path):
    boxes = spark.createDataFrame([("a1", "i1", "s", "c", "coco", 10.0, 20.0, 30.0, 16.0), ("a2", "i2", "s", "c", "coco", 1.0, 1.0, 5.0, 5.0)], BOX)
    rows = boxes.withColumns({"split": F.lit("train"), "position": F.when(F.col("image_id") == "i1", 1).otherwise(2), "unique_name": F.concat("image_id", F.lit(".jpg")), "width": F.lit(100), "height": F.lit(80), "export_key": F.lit("helmet"), "category_name": F.lit("helmet")})
    export.write_coco(rows, str(tmp_path / "coco"), sharded=False)
    docs = spark.read.text(str(tmp_path / "coco"), wholetext=True).select("split", F.from_json("value", coco.SCHEMA).alias("d")).select("split", "d.*")
    splits = spark.createDataFrame([("train",)], "split string")
    assert validate.validate_coco(docs, splits, class_count=1).count() == 0
    bad = docs.withColumn("annotations", F.transform("annotations", lambda a: a.withField("image_id", F.lit("77")).withField("bbox", F.slice(a["bbox"], 1, 3))))
    assert {r.rule for r in validate.validate_coco(bad, splits).collect()} == {"unknown image", "bbox is not of length 4"}
    export.write_yolo(rows, str(tmp_path / "yolo"))
    assert (tmp_path / "yolo/train/labels/i1.txt").read_text() == "0 0.250000 0.350000 0.300000 0.200000"
    assert "names: ['helmet']" in (tmp_path / "yolo/data.yaml").read_text()
    labels = yolo.read_texts(spark, str(tmp_path / "yolo/train"), "*.txt").select(F.lit("train").alias("split"), fn.basename(F.col("path")).alias("file_name"), "text")
    pics = rows.select("split", F.col("unique_name").alias("file_name"))
    assert validate.validate_yolo(pics, labels, splits).count() == 0
    worse = labels.withColumn("text", F.concat("text", F.lit("\n0 1.2 0.5 0.1 0.1")))
    assert {r.rule for r in validate.validate_yolo(pics.limit(1), worse, splits).collect()} == {"value outside 0 to 1", "extra label"}


def test_streamed_marks(spark, tmp_path):
    rows = [("image", f"t{i % 3}", s, i, i) for i, s in enumerate(["keep", "fix", "keep", "exclude", "fix", "keep"])] + [("image", "t9", "old", 0, 9), ("image", "t9", "new", 0, 12)]
    d = spark.createDataFrame(rows, "scope string, target_id string, status string, updated_at int, event_id int")
    at, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for i in range(3):  # not in order of time, and each part is a run of its own from the same checkpoint
        d.where(F.col("event_id") % 3 == (i + 1) % 3).coalesce(1).write.mode("append").parquet(at)
        jobs.replay(spark, at, d.schema, lambda s: jobs.stream_review_marks(s, out, ck))
        (tmp_path / "out").mkdir(exist_ok=True)
    got = {r.target_id: r.status for r in jobs.latest_marks(spark, out).collect()}
    assert got == {"t0": "exclude", "t1": "fix", "t2": "keep", "t9": "new"}
    changed = spark.read.parquet(out).groupBy("batch").count().collect()
    assert len(changed) == 3 and max(r["count"] for r in changed) <= 2  # a batch writes what it changed
    seen = sorted(map(tuple, jobs.latest_marks(spark, out).collect()))
    jobs.compact_marks(spark, out)
    assert sorted(map(tuple, jobs.latest_marks(spark, out).collect())) == seen and [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")] == []
    # a batch that is run again: its part of the log and its commit are lost, not the state
    last = max(int(p.name) for p in (tmp_path / "ck/commits").iterdir() if p.name.isdigit())
    for p in [*(tmp_path / "ck/commits").glob(f"*{last}*")]:
        p.unlink()
    before = sorted(map(tuple, jobs.latest_marks(spark, out).collect()))
    spark.createDataFrame([("image", "t0", "keep", 99, 99)], d.schema).write.mode("append").parquet(at)
    jobs.replay(spark, at, d.schema, lambda s: jobs.stream_review_marks(s, out, ck))
    assert sorted(map(tuple, jobs.latest_marks(spark, out).collect())) == sorted([*(x for x in before if x[1] != "t0"), ("image", "t0", "keep", 99, 99)])
    jobs.compact_marks(spark, out)
    jobs.compact_marks(spark, out)
    assert {r.target_id: r.status for r in jobs.latest_marks(spark, out).collect()} == {"t0": "keep", "t1": "fix", "t2": "keep", "t9": "new"}


def test_late_marks_are_dropped_and_counted(spark, tmp_path):
    day = lambda n: f"2024-01-{n:02} 12:00:00"
    parts = [[("keep", day(1)), ("fix", day(2)), ("keep", day(10))], [("keep", day(1)), ("keep", day(9)), ("fix", day(7)), ("keep", day(20))], [("keep", day(28))]]
    at, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for p in parts:
        d = spark.createDataFrame(p, "status string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
        d.coalesce(1).write.mode("append").parquet(at)
        jobs.replay(spark, at, d.schema, lambda s: jobs.stream_activity(s, out, ck))
    closed = jobs.closed_windows(spark, out)
    assert sorted((r.window_start.day, r.status, r.n) for r in closed.collect()) == [(1, "keep", 1), (2, "fix", 1), (9, "keep", 1), (10, "keep", 1), (20, "keep", 1)]
    assert sorted(map(tuple, jobs.late_marks(spark.read.parquet(at), closed).collect())) == [("fix", 1), ("keep", 1)]


def test_ingest_follows_changed_and_removed_files(spark, tmp_path):
    root = tmp_path / "drop"
    (root / "labels").mkdir(parents=True)
    line = "0 0.5 0.5 0.2 0.2"
    for n in range(7):
        (root / f"labels/p{n}.txt").write_text("\n".join([line] * n))
    _write_coco(root / "a.json", [{"id": 1, "file_name": "x.jpg"}], [{"id": 1, "name": "cat"}], [{"id": k, "image_id": 1, "category_id": 1, "bbox": [1, 2, 3, k]} for k in range(4)])
    store = jobs.ingest_store(spark, str(tmp_path / "store"), 4)
    assert jobs.ingest_all(store, str(root), 3) == 7 and store.versions() == [0, 1, 2, 3]
    count = lambda: {r[0].rsplit("/", 1)[1]: r[1] for r in store.read("boxes").groupBy("path").count().collect()}
    assert count() == {f"p{n}.txt": n for n in range(1, 7)} | {"a.json": 4}
    (root / "labels/p0.txt").write_text(line)
    (root / "labels/p5.txt").write_text(f"{line}\nnot a box")
    (root / "labels/p6.txt").unlink()
    _write_coco(root / "a.json", [{"id": 1, "file_name": "x.jpg"}], [{"id": 1, "name": "cat"}], [{"id": 9, "image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4]}])
    assert jobs.ingest_all(store, str(root)) == 4 and jobs.ingest_changes(store, str(root)) == 0
    assert count() == {f"p{n}.txt": n for n in range(1, 5)} | {"p0.txt": 1, "p5.txt": 1, "a.json": 1}
    assert {(r.image, r.category) for r in jobs.ingest_store(spark, str(tmp_path / "store")).read("boxes").where("path like '%json'").collect()} == {("x.jpg", "cat")}


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for d in dirs for p in Path(d.toString()).rglob("shuffle_*.data")}


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    before = _shuffle_files(spark)
    table = storage.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sevens")
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    storage.released(table)


def test_parts_go_as_they_are_joined(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    for k in range(3):
        (tmp_path / f"parts/p{k}").write_text(f"{k}\n")
    storage.joined(spark, str(tmp_path / "parts"), str(tmp_path / "whole"))
    assert (tmp_path / "whole").read_text() == "0\n1\n2\n" and storage.listed(spark, str(tmp_path / "parts")) == []


def test_files_of_a_round_go_before_the_next(spark, monkeypatch):
    monkeypatch.setattr(queries, "ROUND", 10)
    rows, seen = spark.range(25).select(F.col("id").cast("string").alias("path")), []

    def each(part, at):
        assert not any(Path(x.removeprefix("file://")).exists() for x in seen)
        seen.append(at)
        export.write_files(part.select("path", F.concat(F.lit("text "), "path").alias("content")), at)
        return queries._files(queries.Tables(spark, ""), at)

    back = queries._rounds(rows, "path", each, queries.Tables(spark, ""))
    assert len(seen) == 3 and {(r.path, r.text) for r in back.collect()} == {(str(k), f"text {k}") for k in range(25)} and back.count() == 25
    assert not any(Path(x.removeprefix("file://")).exists() for x in seen)


def test_a_part_of_a_yolo_dataset_has_the_classes_of_all(spark, tmp_path):
    classes = spark.createDataFrame([("a", "A"), ("b", "B")], "export_key string, category_name string")
    row = ("train", "i", "i.jpg", "1", "b", "B", "yolo", 0.5, 0.5, 0.25, 0.125, 10, 10)
    rows = spark.createDataFrame([row], "split string, image_id string, unique_name string, annotation_id string, export_key string, category_name string, annotation_format string, bbox_x double, bbox_y double, bbox_width double, bbox_height double, width int, height int")
    export.write_yolo(rows, str(tmp_path / "set"), classes)
    assert (tmp_path / "set/train/labels/i.txt").read_text().split()[0] == "1"
    assert "nc: 2\nnames: ['A', 'B']" in (tmp_path / "set/data.yaml").read_text()


def test_names_of_a_dataset_are_not_sent_to_all_tasks(spark):
    splits = spark.createDataFrame([("a",)], "split string")
    names = spark.createDataFrame([("a", "x.jpg"), ("a", "y.jpg")], "split string, file_name string")
    out = validate.validate_yolo(names, names.where("file_name = 'x.jpg'").withColumn("text", F.lit("0 0 0 0 0")), splits)
    assert [(r.rule, r.ref) for r in out.collect()] == [("missing label", "y")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "stem" in x]


def test_commits_of_an_ingest_do_not_rewrite_each_bucket(spark, tmp_path, monkeypatch):
    (tmp_path / "drop").mkdir()
    for n in range(40):
        (tmp_path / f"drop/p{n}.txt").write_text("0 0.5 0.5 0.2 0.2")
    store, lists = jobs.ingest_store(spark, str(tmp_path / "store"), 4), []
    of = jobs._changes
    monkeypatch.setattr(jobs, "_changes", lambda *a: lists.append(a) or of(*a))
    assert jobs.ingest_all(store, str(tmp_path / "drop"), 10) == 40 and len(store.versions()) == 5
    assert len(lists) == 2  # one that finds all files, and one that finds no more
    # four commits over four buckets that hold the files in their order: each is written once, and again where a commit ends in it
    assert len(list((tmp_path / "store/data/boxes").glob("*/bucket_=*"))) <= 4 + 3
    assert store.read("boxes").count() == 40


def test_a_watched_folder(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop/a.txt").write_text("0 0.5 0.5 0.2 0.2")
    store = jobs.ingest_store(spark, str(tmp_path / "store"), 2)
    q = jobs.watch(store, str(tmp_path / "drop"), str(tmp_path / "ck"), "1 second")
    try:
        for _ in range(120):
            if store.versions()[-1] > 0:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r.image, r.category) for r in store.read("boxes").collect()] == [("a", "0")]


def test_large_documents_over_many_ranges(spark, tmp_path):
    rng = random.Random(8)
    odd = ['a"b}{', "c\\", "}]", '","images":[{', "é\n\t{", "[[", "\\\"}"]
    docs = {}
    for n in range(3):
        pics = [{"id": i, "file_name": rng.choice(odd) + str(i), "width": 3, "height": 4} for i in range(60)]
        anns = [{"id": i, "image_id": i % 60, "category_id": i % 2, "segmentation": rng.choice([[[1, 2, 3]], {"counts": rng.choice(odd), "size": [{"a": {}}, 2]}]), "bbox": [i, 1, 2.5, 3], "images": [{"no": 1}]} for i in range(200)]
        doc = {"info": {"text": 'x}, "images": [{', "by": {"who": ["}"], "images": [{"id": "no"}]}}, "version": "1{", "licenses": [], "images": pics, "extra": [[{"id": 5}], 7], "annotations": anns, "categories": [{"id": 0, "name": "n{"}, {"id": 1, "name": ""}] if n else []}
        docs[f"d{n}.json"] = doc
        (tmp_path / f"d{n}.json").write_text(json.dumps(doc, indent=n or None, ensure_ascii=n == 1))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "bad.json").write_text('{"images": [{"id": 1}, oops')
    for size in ("97", "1000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found, there = bigjson.elements(spark, str(tmp_path), ("images", "annotations", "categories"))
            found, there = found.collect(), there.collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        got = {}
        for r in found:
            got.setdefault((r.path.rsplit("/", 1)[1], r.name), {})[r.pos] = json.loads(r.value) if not r.path.endswith("bad.json") else r.value
        want = {(f, n): dict(enumerate(d[n])) for f, d in docs.items() for n in ("images", "annotations", "categories") if d[n]}
        assert {k: v for k, v in got.items() if k[0] != "bad.json"} == want
        assert {(r.path.rsplit("/", 1)[1], r.name) for r in there if not r.path.endswith("bad.json")} == {(f, n) for f in docs for n in ("images", "annotations", "categories")}


def test_compressed_documents_are_read_without_a_shuffle_of_their_text(spark, tmp_path):
    doc = {"categories": [{"id": 1, "name": 'c"}{'}], "images": [{"id": i, "file_name": f"{i}.jpg", "x": {"y": {}}} for i in range(30)], "annotations": []}
    for n in range(3):
        (tmp_path / f"d{n}.json.gz").write_bytes(gzip.compress(json.dumps(doc | {"images": doc["images"][n:]}).encode()))
    names = ("images", "annotations", "categories")
    found, there = bigjson.elements(spark, str(tmp_path), names, "*.json.gz")
    got = {}
    for r in found.collect():
        got.setdefault((int(r.path[-9]), r.name), {})[r.pos] = json.loads(r.value)
    assert got == {(n, k): dict(enumerate(v)) for n in range(3) for k, v in (("images", doc["images"][n:]), ("categories", doc["categories"]))}
    assert there.count() == 9
    whole = found.where("name = 'categories'")  # elements of one record are only read; those of several are put together by a shuffle
    plan = whole._jdf.queryExecution().executedPlan().toString().split("Union", 1)[-1]
    assert plan.count("Exchange hashpartitioning") <= 1 and "Window" not in plan


def test_a_document_of_many_parts_reads_back(spark, tmp_path):
    n = 3000
    pics = spark.range(1, n + 1).select(F.lit("train").alias("split"), "id", F.concat(F.lit('p"}{'), "id").alias("file_name"))
    pics = pics.unionByName(spark.range(1, 3).select(F.lit("valid").alias("split"), "id", F.lit("v").alias("file_name")))
    boxes = spark.range(1, 2 * n + 1).select(F.lit("train").alias("split"), "id", (F.col("id") / 2).cast("long").alias("image_id"), F.array(F.lit(1.5), F.lit(2.0)).alias("bbox"))
    export.write_documents({"images": pics.repartition(7), "annotations": boxes}, str(tmp_path / "out"), "all.json")
    doc = json.loads((tmp_path / "out/split=train/all.json").read_text())
    assert [p["id"] for p in doc["images"]] == list(range(1, n + 1)) and [b["id"] for b in doc["annotations"]] == list(range(1, 2 * n + 1))
    assert json.loads((tmp_path / "out/split=valid/all.json").read_text()) == {"images": [{"id": 1, "file_name": "v"}, {"id": 2, "file_name": "v"}], "annotations": []}
    assert [p.name for p in (tmp_path / "out/split=train").iterdir() if not p.name.endswith(".crc")] == ["all.json"]


def test_files_come_whole_or_not_at_all(spark, tmp_path):
    root = tmp_path / "tree"
    rows = spark.range(40).select(F.concat(F.lit("a/"), F.col("id") % 5, F.lit("/"), "id", F.lit(".txt")).alias("path"), F.col("id").cast("string").alias("content")).repartition(4)
    with pytest.raises(Exception, match="not a path below the root"):
        export.write_files(rows.withColumn("path", F.when(F.col("content") == "17", "../x").otherwise(F.col("path"))), str(root))
    assert not list(root.rglob("*.txt"))
    export.write_files(rows, str(root))
    export.write_files(rows.where("content = '3'").withColumn("content", F.lit("again")), str(root))
    assert {p.name: p.read_text() for p in root.rglob("*.txt")} == {f"{k}.txt": "again" if k == 3 else str(k) for k in range(40)}
    assert sorted(p.name for p in root.iterdir()) == ["_SUCCESS", "a"]
    export.remove_files(rows.where("content > '2'"), str(root))
    assert {p.stem for p in root.rglob("*.txt")} == {str(k) for k in range(40) if str(k) <= "2"}


def test_headers_are_read_by_range(spark, tmp_path):
    segment = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    frame = segment(0xC0, b"\x08" + struct.pack(">HH", 30, 50) + b"\x01")
    tiff = lambda at: b"II*\0" + struct.pack("<I", at) + b"x" * (at - 8) + struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 70) + struct.pack("<HHII", 257, 4, 1, 60)
    made = {"near.jpg": b"\xff\xd8" + segment(0xE0, b"x") + frame, "far.jpg": b"\xff\xd8" + segment(0xE1, b"x" * 60000) * 4 + frame, "far.tif": tiff(300_000), "cut.jpg": b"\xff\xd8\xff"}
    for name, start in made.items():
        (tmp_path / name).write_bytes(start + (b"p" * 1_000_000 if name != "cut.jpg" else b""))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.probe_images(spark, str(tmp_path)).collect()}
    assert {n: (r.width, r.height) for n, r in got.items()} == {"near.jpg": (50, 30), "far.jpg": (50, 30), "far.tif": (70, 60), "cut.jpg": (None, None)}
    assert got["near.jpg"].bytes_read == 4096 and max(r.bytes_read for r in got.values()) < 4096 + 8 * 64


def test_a_cap_reads_its_boxes_once(spark):
    times = spark.sparkContext.accumulator(0)

    def seen(i):
        times.add(1)
        return f"i{i}"

    box = {"source_id": F.lit("s"), "export_key": F.when(F.col("id") < 8, "few").otherwise("many"), "annotation_format": F.lit("yolo"), **{f"bbox_{c}": F.lit(0.5) for c in ("x", "y", "width", "height")}, "width": F.lit(10), "height": F.lit(10)}
    boxes = spark.range(60).select(F.udf(seen, "string")("id").alias("image_id"), *(v.alias(k) for k, v in box.items()))
    kept = {r[0] for r in analysis.cap_majority(boxes, 7).collect()}
    assert len(kept) == 16 and {f"i{i}" for i in range(8)} < kept
    assert times.value == 60


def test_known_classes_save_a_reading_of_the_boxes(spark):
    times = spark.sparkContext.accumulator(0)

    def seen(i):
        times.add(1)
        return f"a{i}"

    made = F.udf(seen, "string").asNondeterministic()("id")
    box = {"split": F.lit("all"), "unique_name": F.concat(F.lit("i"), F.col("id") % 3), "annotation_id": made, "export_key": F.lit("b"), "annotation_format": F.lit("yolo"), **{f"bbox_{c}": F.lit(0.5) for c in ("x", "y", "width", "height")}, "width": F.lit(1), "height": F.lit(1)}
    rows = spark.range(9).withColumns(box)
    texts = [r.text for r in export.yolo_lines(rows, spark.createDataFrame([("a",), ("b",), ("b",)], "export_key string")).collect()]
    assert texts == ["\n".join(["1 0.500000 0.500000 0.500000 0.500000"] * 3)] * 3 and times.value == 9


@pytest.mark.parametrize("name, most", [("src9_read_yolo_labels", 28_000), ("snk9_action_files", 52_000)])  # 31,200 and 56,668 when boxes were made again
def test_boxes_of_a_query_are_made_once(spark, name, most):
    from framewell.plans.queries import QUERIES

    def rows_read():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).inputRecords() for i in range(stages.size())}

    before = rows_read()
    QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    assert sum(n for i, n in rows_read().items() if i not in before) < most


def test_a_hot_name_and_a_hot_group_are_shared_by_tasks(spark):
    pics = spark.range(3000).select(F.format_string("i%05d", "id").alias("image_id"), F.when(F.col("id") % 10 > 0, "a.jpg").otherwise(F.concat("id", F.lit(".jpg"))).alias("file_name"))
    got = sorted((r.image_id, r.staged_name) for r in ranking.staged_names(pics).collect() if r.file_name == "a.jpg")
    assert [n for _, n in got] == ["a.jpg"] + [f"a-{k}.jpg" for k in range(1, len(got))]
    boxes = pics.select("image_id", F.lit("s").alias("source_id"), F.lit("car").alias("export_key"), F.lit("coco").alias("annotation_format"), F.lit(10.0).alias("bbox_width"), F.lit(10.0).alias("bbox_height"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    boxes = boxes.withColumn("export_key", F.when(F.col("image_id") < "i00100", "van").otherwise("car"))
    for seed in (1, 2):
        kept = {r[0] for r in analysis.cap_majority(boxes, seed).collect()}
        cars = sorted((hashlib.md5(f"{seed}:i{k:05d}".encode()).hexdigest(), f"i{k:05d}") for k in range(100, 3000))
        assert kept == {f"i{k:05d}" for k in range(100)} | {i for _, i in cars[:100]}


def test_empty_tables(spark):
    boxes = spark.createDataFrame([], BOX).withColumns({"export_key": F.lit("a"), "category_name": F.lit("a"), "width": F.lit(1), "height": F.lit(1)})
    assert analysis.class_distribution(boxes).count() == 0
    assert analysis.cooccurrence(boxes).count() == 0
    assert browse.filter_cards(spark.createDataFrame([], "image_id string, source_id string"), ["x"]).count() == 0
    assert vectors.moments(spark.createDataFrame([], "vector array<double>"))[0] == 0
