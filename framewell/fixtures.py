"""Canonical tables of an object-detection workspace, as portable SQL over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The same text runs in Spark and in DuckDB.
VIEWS = {
    # source_folders (broadcast dimension)
    "v_sources": """
        SELECT concat('source-', n_nationkey) AS source_id, concat('/data/', lower(replace(n_name, ' ', '-'))) AS path,
               CASE WHEN n_nationkey % 2 = 0 THEN 'COCO' ELSE 'YOLO' END AS source_type
        FROM nation
    """,
    # images; 1/41 corrupted with null dims; unannotated when the order has no line; 40 repeated-file-name groups
    "v_images": """
        SELECT concat('img-', o.o_orderkey) AS image_id, concat('source-', c.c_nationkey) AS source_id,
               CASE WHEN o.o_orderkey % 10 = 0 THEN concat('frame-', o.o_orderkey % 400, '.jpg')
                    ELSE concat('frame-', o.o_orderkey, '.jpg') END AS file_name,
               concat('/data/source-', c.c_nationkey, '/img-', o.o_orderkey, '.jpg') AS original_path,
               CASE WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE 640 + 32 * (o.o_orderkey % 5) END AS width,
               CASE WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE 480 + 16 * (o.o_orderkey % 7) END AS height,
               CASE WHEN o.o_orderkey % 41 = 0 THEN 'corrupted' ELSE 'healthy' END AS health_status,
               CASE WHEN l.l_orderkey IS NULL THEN 'unannotated' ELSE 'annotated' END AS annotation_status,
               o.o_orderdate AS created_at
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
        LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l.l_orderkey = o.o_orderkey
    """,
    # source categories; mixed case and sometimes empty normalized_name, so the group key matters
    "v_categories": """
        SELECT DISTINCT concat('cat-', c.c_nationkey, '-', lower(p.p_type)) AS category_id,
               concat('source-', c.c_nationkey) AS source_id,
               CASE WHEN c.c_nationkey % 2 = 0 THEN p.p_type ELSE lower(p.p_type) END AS name,
               CASE WHEN c.c_nationkey % 3 = 0 THEN '' ELSE lower(p.p_type) END AS normalized_name
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN part p ON p.p_partkey = l.l_partkey
    """,
    # annotations; odd nations use YOLO boxes, even ones COCO; version_year drives as-of reads
    "v_annotations": """
        SELECT concat('ann-', l.l_orderkey, '-', l.l_linenumber, '-', l.l_partkey, '-', l.l_suppkey, '-', CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS annotation_id,
               concat('img-', l.l_orderkey) AS image_id, concat('source-', c.c_nationkey) AS source_id,
               concat('cat-', c.c_nationkey, '-', lower(p.p_type)) AS source_category_id,
               CASE WHEN c.c_nationkey % 2 = 1 THEN 'yolo' ELSE 'coco' END AS annotation_format,
               CASE WHEN c.c_nationkey % 2 = 1 THEN 0.5 + l.l_discount ELSE l.l_quantity * 4 END AS bbox_x,
               CASE WHEN c.c_nationkey % 2 = 1 THEN 0.5 - l.l_tax ELSE l.l_quantity * 2 END AS bbox_y,
               CASE WHEN c.c_nationkey % 2 = 1 THEN l.l_quantity / 100 ELSE l.l_quantity * 6 END AS bbox_width,
               CASE WHEN c.c_nationkey % 2 = 1 THEN l.l_discount + 0.02 ELSE p.p_size * 5 END AS bbox_height,
               year(l.l_shipdate) AS version_year
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN part p ON p.p_partkey = l.l_partkey
    """,
    # source_category_mappings; `promo` is ignored
    "v_mappings": """
        SELECT category_id AS source_category_id, source_id,
               CASE WHEN lower(name) = 'promo' THEN 'Ignore' ELSE 'Merge' END AS final_action,
               CASE WHEN lower(name) = 'promo' THEN NULL ELSE concat('unified-', lower(name)) END AS target_category_id
        FROM v_categories
    """,
    # embeddings; two objects per image
    "v_embeddings": """
        SELECT 'object' AS scope, concat('obj-', vec_id) AS target_id,
               concat('img-', CAST(floor(vec_id / 2) AS BIGINT)) AS image_id, concat('class-', label) AS category_id,
               'clip-64' AS model_id, embedding AS vector FROM embeddings
    """,
    # embedding_projections; three methods with different coverage, so the best-method rule matters
    "v_projections": """
        SELECT 'object' AS scope, concat('obj-', e.vec_id) AS target_id, 'clip-64' AS model_id, m.method AS projection_method,
               (e.vec_id % 101) / 50.0 - 1 AS x, ((e.vec_id * 7) % 101) / 50.0 - 1 AS y
        FROM embeddings e JOIN (SELECT 'umap-v1' AS method, 5 AS k UNION ALL SELECT 'pca-v1', 2 UNION ALL SELECT 'bootstrap-deterministic', 1) m
          ON e.vec_id % m.k = 0
    """,
    # append stream of review marks; latest wins per (scope, target_id)
    "v_review_updates": """
        SELECT event_id, ts AS updated_at, CASE WHEN user_id % 2 = 0 THEN 'image' ELSE 'object' END AS scope,
               CASE WHEN user_id % 2 = 0 THEN concat('img-', user_id) ELSE concat('obj-', user_id) END AS target_id,
               CASE event_type WHEN 'purchase' THEN 'exclude' WHEN 'error' THEN 'needs-review' WHEN 'click' THEN 'keep'
                               WHEN 'signup' THEN 'fix' ELSE 'unreviewed' END AS status
        FROM events
    """,
    # the same marks expressed on image ids and annotation ids for export exclusion
    "v_export_marks": """
        SELECT 'image' AS scope, target_id, status, updated_at FROM v_review_updates WHERE scope = 'image'
        UNION ALL
        SELECT 'object' AS scope, a.annotation_id AS target_id, r.status, r.updated_at
        FROM v_review_updates r JOIN v_annotations a ON r.scope = 'object' AND a.image_id = replace(r.target_id, 'obj-', 'img-')
    """,
}

#: What Spark runs instead for some views, with the same rows. Orders get their nation before lines meet them, so that lines
#: are dealt out once by part and once by image, and are then dealt out as a join on image_id needs them. Categories need no image_id, so their lines meet orders by number.
NATIONS = "(SELECT concat('img-', o.o_orderkey) AS image_id, c.c_nationkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)"
JOINED = "lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey\n        JOIN part p ON p.p_partkey = l.l_partkey"
SPARK_VIEWS = {
    "v_categories": VIEWS["v_categories"].replace(JOINED, f"""(SELECT DISTINCT l.l_partkey, c.c_nationkey FROM lineitem l JOIN (SELECT o.o_orderkey, c.c_nationkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey) c ON c.o_orderkey = l.l_orderkey) c
        JOIN part p ON p.p_partkey = c.l_partkey"""),
    "v_annotations": VIEWS["v_annotations"].replace(JOINED, f"""lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN {NATIONS} c ON c.image_id = concat('img-', l.l_orderkey)"""),
}


def _needs(sql: str) -> list[str]:
    return [x for x in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql)) if x in VIEWS or x in TABLES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a canonical view over the given tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SPARK_VIEWS.get(name, VIEWS[name])
    needs = _needs(sql)
    text = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in needs else m[0], sql)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in needs})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in re.findall(r"\bv_\w+", text):
            if n in VIEWS and n not in order:
                add(VIEWS[n])
                if n not in order:
                    order.append(n)

    add(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body.removeprefix('WITH RECURSIVE ')}"
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
