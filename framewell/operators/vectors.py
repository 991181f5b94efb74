"""Vectors: norms, projections, outliers and encoders (neighbours: see neighbours.py).

Tables of vectors have target_id and vector (array of float) among their columns. In projections and neighbours, rows
with a null vector are left out, null components count as 0, and shorter vectors are filled up with zeros to the
longest one's length. Repeated rows count each; rows with equal ids are not each other's neighbours. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.storage import written

# FNV-1a 64 offset and prime, and the splitmix64 increment and multipliers.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def vector_norm(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vector_norm", fn.l2_norm(F.col("vector")))


def decode_blobs(rows: DataFrame, blob: str = "vector") -> DataFrame:
    """Little-endian float32 bytes as an array; null where the length is no multiple of four."""

    @F.pandas_udf("array<float>")
    def decoded(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return rows.withColumn(blob, decoded(blob))


def _stir(z: np.ndarray) -> np.ndarray:
    a, b, c = (np.uint64(v) for v in SPLITMIX)
    z = z + a
    z = (z ^ (z >> np.uint64(30))) * b
    z = (z ^ (z >> np.uint64(27))) * c
    return z ^ (z >> np.uint64(31))


def hash_points(texts: list[str]) -> np.ndarray:
    """Two coordinates in [-1, 1] for each text, from its FNV-1a hash stirred once and twice."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    at = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    h = np.full(len(texts), FNV_OFFSET, np.uint64)
    live = np.arange(len(texts))
    for k in range(int(sizes.max()) if len(sizes) else 0):  # one place of all texts after the other
        live = live[sizes[live] > k]
        h[live] = (h[live] ^ data[at[live] + k]) * np.uint64(FNV_PRIME)
    first = _stir(h)
    second = _stir(first)
    return np.stack([(v >> np.uint64(11)).astype(np.float64) / (1 << 53) * 2 - 1 for v in (first, second)], 1)


def bootstrap_projection(items: DataFrame, scope: str, model: str) -> DataFrame:
    """A layout that needs no vectors: the point of '<scope>:<model>:<target>'."""

    @F.pandas_udf("struct<x: double, y: double>")
    def point(ids: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(hash_points([f"{scope}:{model}:{i}" for i in ids]), columns=["x", "y"])

    p = items.select("target_id", point("target_id").alias("p"))
    return p.select("target_id", F.lit("bootstrap-deterministic").alias("projection_method"), "p.x", "p.y")


def filled(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Vectors of one length as doubles (see the module's text), and that length."""
    some = vectors.where("vector is not null")
    d = some.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    known = F.transform("vector", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return some.withColumn("vector", F.concat(known, F.array_repeat(F.lit(0.0), F.lit(d) - F.size("vector")))), d


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and d x d scatter about the mean, from sums of every partition; only d * d numbers reach the driver."""

    vectors, d = filled(vectors)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, np.float64) for v in b["vector"]])
                x = np.concatenate([x, np.ones((len(x), 1))], 1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    rows = vectors.select("vector").mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    if rows.empty:
        return 0, np.zeros(0), np.zeros((0, 0))
    g = np.zeros((d + 1, d + 1))
    g[rows["i"], rows["j"]] = rows["s"]
    n = round(g[d, d])
    mean = g[d, :d] / n
    return n, mean, g[:d, :d] - n * np.outer(mean, mean)


def pca_2d(vectors: DataFrame, rounds: int = 32) -> DataFrame:
    """x and y in [-1, 1] along the two main directions, by power iterations on the scatter matrix."""
    vectors, _ = filled(vectors)
    n, mean, g = moments(vectors)
    found: list[np.ndarray] = []
    for _ in range(2):
        v = np.array([1.0 if i % 2 == 0 else -1.0 for i in range(len(mean))])
        for _ in range(rounds):
            for u in found:
                v = v - (v @ u) * u
            w = g @ v
            for u in found:
                w = w - (w @ u) * u
            size = np.linalg.norm(w)
            v = w / size if size > 1e-12 else np.zeros_like(w)
        found.append(v)
    axes = np.array(found) if n else np.zeros((2, 0))

    @F.pandas_udf("struct<x: double, y: double>")
    def scores(vs: pd.Series) -> pd.DataFrame:
        x = np.stack([np.asarray(v, np.float64) for v in vs]) - mean
        return pd.DataFrame(x @ axes.T, columns=["x", "y"])

    raw = vectors.select("target_id", scores("vector").alias("p")).select("target_id", "p.x", "p.y")
    top = raw.agg(F.max(F.abs("x")).alias("mx"), F.max(F.abs("y")).alias("my"))
    unit = lambda v, m: F.when(F.col(m) > 1e-12, F.greatest(F.least(F.col(v) / F.col(m), F.lit(1.0)), F.lit(-1.0))).otherwise(0.0).alias(v)
    return raw.crossJoin(F.broadcast(top)).select("target_id", F.lit("pca-v1").alias("projection_method"), unit("x", "mx"), unit("y", "my"))  # top is one row


def pca_denoise(vectors: DataFrame, k: int = 50) -> DataFrame:
    """Unit vectors reduced to k main directions and brought to length 1 again; unchanged unless n and d exceed k."""
    unit = filled(vectors)[0].withColumn("vector", fn.l2_normalize(F.col("vector")))
    n, mean, g = moments(unit)
    if n <= k or len(mean) <= k:
        return unit
    values, axes = np.linalg.eigh(g)
    axes = axes[:, np.argsort(values)[::-1][:k]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = (np.stack([np.asarray(v, np.float64) for v in pdf["vector"]]) - mean) @ axes
                size = np.linalg.norm(x, axis=1, keepdims=True)
                yield pdf.assign(vector=list(x / np.where(size > 0, size, 1)))

    return unit.mapInPandas(reduced, ", ".join(f"`{c}` {k}" for c, k in unit.dtypes))


def knn_scores(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target_id").agg(F.avg("distance").alias("score"))


def lof_scores(edges: DataFrame) -> DataFrame:
    """Local outlier factor from neighbour edges: reach distance, density, ratio of densities."""
    reach_of = edges.groupBy(F.col("target_id").alias("neighbour")).agg(F.max("distance").alias("k_distance"))
    reach = edges.join(reach_of, "neighbour").withColumn("reach", F.greatest("distance", "k_distance"))
    density = reach.groupBy("target_id").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))
    other = density.select(F.col("target_id").alias("neighbour"), F.col("lrd").alias("other_lrd"))
    return edges.join(other, "neighbour").groupBy("target_id").agg(F.avg("other_lrd").alias("m")).join(density, "target_id").select("target_id", (F.col("m") / F.col("lrd")).alias("score"))


def flag_outliers(scores: DataFrame, classes: DataFrame, pct: float, floor: int) -> DataFrame:
    """target_id, class_id, score, is_outlier: the top round(n * pct) scores, but each class keeps `floor` targets.

    Ties go to the smaller id; a null class is '__none__'. Nothing is flagged when pct <= 0 or n < 3.
    """
    rows = scores.join(classes.select("target_id", F.coalesce("class_id", F.lit("__none__")).alias("class_id")), "target_id")
    n = rows.count()
    top = int(round(n * pct)) if pct > 0 and n >= 3 else 0
    first = rows.select("target_id", "score").orderBy(F.col("score").desc(), "target_id").limit(top).select("target_id", F.lit(True).alias("hit"))
    marked = rows.join(first, "target_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    kept = marked.groupBy("class_id").agg(F.count_if(~F.col("hit")).alias("kept"))
    back = F.row_number().over(Window.partitionBy("class_id", "hit").orderBy("score", "target_id"))
    out = marked.withColumn("back", back).join(kept, "class_id")
    return out.select("target_id", "class_id", "score", (F.col("hit") & (F.col("back") > floor - F.col("kept"))).alias("is_outlier"))


def map_points(projections: DataFrame, annotations: DataFrame, images: DataFrame, marks: DataFrame) -> DataFrame:
    """Best point of each target with its image, box share and review status; orphans are left out.

    Object and image scope join their image in two equi joins instead of one with an OR.
    """
    from .ranking import best_projection
    from .tables import latest_mark

    best = best_projection(projections)
    pics = images.select("image_id", "file_name", "source_id", "width", "height")
    obj = best.where("scope = 'object'").join(annotations.select(F.col("annotation_id").alias("target_id"), "image_id", "bbox_width", "bbox_height", "source_category_id"), "target_id")
    obj = obj.join(pics, "image_id").withColumn("area_ratio", fn.map_area_ratio(F.col("bbox_width"), F.col("bbox_height"), F.col("width"), F.col("height")))
    img = best.where("scope = 'image'").withColumn("image_id", F.col("target_id")).join(pics, "image_id")
    both = obj.unionByName(img, allowMissingColumns=True)
    status = latest_mark(marks).select("scope", "target_id", "status")
    return both.join(status, ["scope", "target_id"], "left").select("scope", "target_id", "image_id", "source_id", "file_name", "source_category_id", "projection_method", "x", "y", "area_ratio", F.coalesce("status", F.lit("unreviewed")).alias("review_status"))


def map_filter(points: DataFrame, source: str | None = None, category: str | None = None, queue: bool = False) -> DataFrame:
    """Points of a source, of a category (object scope only) and, for the queue, with a status but unreviewed."""
    out = points.where(F.col("source_id") == source) if source else points
    if category:
        out = out.where((F.col("scope") != "object") | (F.col("source_category_id") == category))
    return out.where("review_status != 'unreviewed'") if queue else out


def image_points(points: DataFrame) -> DataFrame:
    """One point an image: mean place of its objects, their categories, the first status that isn't unreviewed."""
    reviewed = F.when(F.col("review_status") != "unreviewed", F.col("review_status"))
    return points.where("scope = 'object'").groupBy("image_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.array_join(F.array_sort(F.collect_set("source_category_id")), ", ").alias("categories"), F.coalesce(F.min_by(reviewed, F.when(reviewed.isNotNull(), F.col("target_id"))), F.lit("unreviewed")).alias("review_status"))


def canvas(points: DataFrame, size: float = 1000.0, pad: float = 20.0) -> DataFrame:
    """Points on a padded square canvas; the middle where all points agree, bounds of 1 each way without points."""
    b = points.agg(*(F.coalesce(f(c), F.lit(d)).alias(f"{n}_{c}") for c in ("x", "y") for n, f, d in (("lo", F.min, -1.0), ("hi", F.max, 1.0))))
    place = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), pad + (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * (size - 2 * pad)).otherwise(size / 2)
    return points.crossJoin(F.broadcast(b)).select("scope", "target_id", place("x").alias("px"), place("y").alias("py"))  # bounds are one row


def embedding_items(annotations: DataFrame, images: DataFrame, scope: str, healthy_only: bool = True) -> DataFrame:
    """Objects with their box, or images that have a box."""
    pics = images.where("health_status = 'healthy'") if healthy_only else images
    if scope == "image":
        return pics.join(annotations.select("image_id"), "image_id", "left_semi").select(F.col("image_id").alias("target_id"), "image_id", "original_path")
    box = [f"bbox_{c}" for c in ("x", "y", "width", "height")]
    return annotations.select(F.col("annotation_id").alias("target_id"), "image_id", "annotation_format", *box).join(pics.select("image_id", "original_path", "width", "height"), "image_id")


# Fixed values of the mock encoder: sha256, its first eight bytes little-endian, numpy's default generator.
def mock_encoder(dim: int = 32) -> Callable[[list[str], np.ndarray | None], np.ndarray]:
    """Vectors that depend on the target alone: sha256 of its id seeds a standard normal draw."""
    import hashlib

    def run(ids: list[str], _pixels) -> np.ndarray:
        return np.stack([np.random.default_rng(int.from_bytes(hashlib.sha256(i.encode()).digest()[:8], "little")).standard_normal(dim) for i in ids])

    return run


def pooled(out: np.ndarray, n: int) -> np.ndarray:
    """[B, D] as it is, token 0 of [B, T, D], or a flat B * D; anything else is an error."""
    if out.ndim == 2 and len(out) == n:
        return out
    if out.ndim == 3 and len(out) == n:
        return out[:, 0]
    if out.ndim == 1 and n and out.size % n == 0:
        return out.reshape(n, -1)
    raise ValueError(f"an encoder gave shape {out.shape} for {n} items")


def crop_tensor(pixels: np.ndarray, window: tuple[int, int, int, int], size: int, mean, std) -> np.ndarray:
    """Channels first, resized bilinearly and standardised, of a window of decoded pixels (height, width, 3)."""
    left, top, right, bottom = window
    x = pixels[top:bottom, left:right].astype(np.float32) / 255
    at = [np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1) for n in x.shape[:2]]
    (y0, x0), (y1, x1) = [np.floor(a).astype(int) for a in at], [np.minimum(np.floor(a).astype(int) + 1, n - 1) for a, n in zip(at, x.shape[:2])]
    fy, fx = (at[0] - y0)[:, None, None], (at[1] - x0)[None, :, None]
    rows = lambda y: x[y][:, x0] * (1 - fx) + x[y][:, x1] * fx
    return (((rows(y0) * (1 - fy) + rows(y1) * fy) - np.asarray(mean)) / np.asarray(std)).transpose(2, 0, 1)


@dataclass(frozen=True)
class Model:
    """An encoder's family, its vectors' length, and the side, mean and deviation of the pixels that it takes."""

    family: str
    dim: int
    side: int
    mean: tuple[float, float, float]
    std: tuple[float, float, float]


# The models by name, with the pixel statistics of their families.
MODELS = {
    "clip-vit-b32": Model("clip", 512, 224, (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)),
    "dinov2-small": Model("dinov2", 384, 224, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
}


def encoder(name: str, run: Callable[[np.ndarray], np.ndarray] | None = None) -> Callable[[], Callable]:
    """A factory for embed() of a model by name: pixels are cropped as the model takes them and `run` makes the vectors.

    Pixels are decoded, each an array (height, width, 3) of bytes or its nested lists. Vectors of another length than the
    model's are an error, as is an unknown name. Without `run` the mock encoder stands in, with vectors of that length.
    """
    if name not in MODELS:
        raise ValueError(f"no model {name}; there are {', '.join(MODELS)}")
    model = MODELS[name]

    def factory() -> Callable:
        if run is None:
            return mock_encoder(model.dim)

        def encode(ids: list[str], pixels) -> np.ndarray:
            whole = [np.asarray([[list(c) for c in r] for r in p], np.uint8) for p in pixels]
            found = pooled(np.asarray(run(np.stack([crop_tensor(p, (0, 0, p.shape[1], p.shape[0]), model.side, model.mean, model.std) for p in whole]))), len(ids))
            if found.shape[1] != model.dim:
                raise ValueError(f"{name} makes vectors of {model.dim} numbers, not {found.shape[1]}")
            return found

        return encode

    return factory


def embed(items: DataFrame, factory: Callable[[], Callable], batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """Vectors (target_id, unit vector, vector_norm before that) and failures (target_id, error), one row an item in all.

    An encoder is made once a task; where a batch fails its items are encoded one by one, and those that fail then are
    failures. All is written once, so that both tables are of the same run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for pdf in batches:
            ids = pdf["target_id"].tolist()
            pixels = pdf["pixels"].tolist() if "pixels" in pdf else None
            for at in range(0, len(ids), batch):
                part, px = ids[at : at + batch], pixels[at : at + batch] if pixels else None
                errors: list[str | None] = [None] * len(part)
                try:
                    found = list(pooled(np.asarray(encoder(part, px)), len(part)))
                except Exception:
                    found = []
                    for k, i in enumerate(part):
                        try:
                            found.append(pooled(np.asarray(encoder([i], px[k : k + 1] if px else None)), 1)[0])
                        except Exception as e:
                            found.append(None)
                            errors[k] = f"{type(e).__name__}: {e}"
                norms = [None if v is None else float(np.linalg.norm(v)) for v in found]
                units = [None if v is None else (v / (n or 1)).astype(np.float32) for v, n in zip(found, norms)]
                yield pd.DataFrame({"target_id": part, "vector": units, "vector_norm": norms, "error": errors})

    both = written(items.mapInPandas(run, "target_id string, vector array<float>, vector_norm double, error string"), "embedded")
    return both.where("error is null").drop("error"), both.where("error is not null").select("target_id", "error")


def embedding_inventory(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model_id", "scope").agg(F.count("*").alias("n"))
