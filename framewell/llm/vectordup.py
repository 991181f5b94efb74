"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative a group.

Centres are fitted in numpy on about `sample` vectors, a quarter of the square root of the number of vectors (`sample`
at most, so a cell grows with the square root up to 6e9 vectors); every vector is assigned to its nearest centre, its
home. Two vectors x, y with homes c, d lie on different sides of the plane between c and d, and what x is short of it
and y is short of it add up to (c - d)(x - y), at most the threshold's chord times |c - d|: one of them is within half
of that. So a vector visits each cell to whose plane it is as near as that, and no link is lost to the cells: recall is
1. A pair whose vectors visit each other counts in the home with the smaller number.

Cells are taken by label. Homes of a cell are cut to blocks of `block`, its visitors to blocks of four times as many;
every block of homes meets every block in one task as a product of double-precision unit vectors. Only cells with more
than one block of homes copy rows. Blocks give back a link count for each vector and one star for each group of
connected vectors, never the pairs. Equal vectors of one label are folded to one before that.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label
or id, link with nothing: n_links 0, their own component (null for a null id) and kept. Vectors of different length do
not link. Rows that share an id are one vector with all their embeddings; each row is returned. Ids are of any type
with an order. An empty table gives an empty result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from .common import released, stars, stored, tidied, with_fields
from .neardup import components


def _usable(column, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of an Arrow list column that hold a usable vector and these, for each length of vectors."""
    starts, ends = column.offsets.to_numpy()[:-1], column.offsets.to_numpy()[1:]
    ends = np.where(column.is_null().to_numpy(zero_copy_only=False), starts, ends)
    flat = column.values.to_numpy(zero_copy_only=False).astype(kind)  # nulls become NaN
    out = []
    for n in np.unique(ends - starts):
        if n:
            rows = np.flatnonzero(ends - starts == n)
            x = flat[starts[rows][:, None] + np.arange(n)]
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            out.append((rows[ok], x[ok]))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_cells(x: np.ndarray, n_cells: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centres by spherical k-means; empty cells restart at the worst served vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n_cells, len(x)), replace=False)]
    for _ in range(rounds):
        sim = x @ centres.T
        own = sim.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(sim.max(1))[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, cells: int | None = None, sample: int = 20000, block: int = 512) -> DataFrame:
    """id, n_links, component_id and kept for each vector."""
    import pyarrow as pa

    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    id_field = rows.schema["id"]
    usable = rows.where("id is not null and label is not null and v is not null")
    n = usable.count()
    share = min(1.0, sample / max(n, 1))
    picked = usable.where(F.pmod(F.xxhash64(F.lit("cells"), "id"), F.lit(1 << 30)) < share * (1 << 30)).select("v").toArrow().column("v")
    units = [_unit(x) for c in picked.chunks for _, x in _usable(c, kind) if len(x)]
    dims = {d: sum(len(u) for u in units if u.shape[1] == d) for d in {u.shape[1] for u in units}}
    dim = max(dims, key=lambda d: (dims[d], d)) if dims else 0
    n_cells = cells or math.ceil(math.sqrt(n) / 4)
    if dim:
        base = np.concatenate([u for u in units if u.shape[1] == dim])
        base = base[np.lexsort(base.T[::-1])]
    centres = spark.sparkContext.broadcast(fit_cells(base, min(n_cells, sample)) if dim else None)
    half = float(np.sqrt(2 - 2 * threshold)) / 2 + 1e-9

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for b in batches:
            for rows, x in _usable(b.column("v"), kind) if b.num_rows else []:
                for at in range(0, len(rows), 1024):
                    part, u = rows[at : at + 1024], x[at : at + 1024]
                    own, visits, ends = np.full(len(part), (1 << 30) + u.shape[1]), np.zeros(0, np.int64), np.zeros(len(part) + 1, np.int64)
                    if c is not None and u.shape[1] == c.shape[1]:
                        sim = _unit(u) @ c.T
                        own = sim.argmax(1)
                        apart = np.sqrt(np.maximum(2 - 2 * (c[own] @ c.T), 0))
                        near = sim[np.arange(len(part)), own][:, None] - sim <= half * apart
                        near[np.arange(len(part)), own] = False
                        at_row, visits = np.nonzero(near)
                        ends = np.searchsorted(at_row, np.arange(len(part) + 1))
                    size = u.shape[1] * u.itemsize
                    raw = pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer((np.arange(len(u) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(u).tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array(part)), b.column("label").take(pa.array(part)), raw, pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(visits.astype(np.int32)))],
                        ["id", "label", "v", "own", "visits"],
                    )

    units_df = stored(usable.mapInArrow(tidied(placed), with_fields(id_field, ("label", "string"), ("v", "binary"), ("own", "int"), ("visits", "array<int>"))), "vec-units")
    folded = units_df.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("own").alias("own"), F.first("visits").alias("visits"))
    folded = stored(folded.withColumn("class", F.xxhash64("label", "v")), "vec-classes")
    owned = units_df.join(folded.select("label", "v", "rep", "m", "class"), ["label", "v"]).select("id", "rep", "m", "class")
    spread = folded.withColumn("cell", F.explode(F.concat(F.array("own"), "visits"))).withColumn("home", F.col("own") == F.col("cell"))
    sizes = folded.select("label", "own", "visits").withColumn("cell", F.explode(F.concat(F.array("own"), "visits")))
    sizes = sizes.groupBy("label", "cell").agg(F.ceil(F.count_if(F.col("own") == F.col("cell")) / block).alias("hb"), F.greatest(F.ceil(F.count_if(F.col("own") != F.col("cell")) / (4 * block)), F.lit(1)).alias("vb"))
    # (p, q): home block p with home block q >= p, and with visitors: their first block where q = p, others beyond the homes
    members = spread.join(sizes.where("hb > 0"), ["label", "cell"])
    mine = F.when(F.col("home"), F.pmod("class", "hb")).otherwise(F.pmod("class", "vb"))
    members = members.withColumn("mine", mine)
    pair = lambda p, q: F.struct(p.cast("long").alias("p"), q.cast("long").alias("q"))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    one, hb, vb, at = F.lit(1).cast("long"), F.col("hb").cast("long"), F.col("vb").cast("long"), F.col("mine").cast("long")
    as_home = F.concat(F.transform(span(at, hb - 1), lambda q: pair(at, q)), F.transform(span(one, vb - 1), lambda v: pair(at, hb - 1 + v)), F.transform(span(one - 1, at - 1), lambda p: pair(p, at)))
    as_visitor = F.transform(span(one - 1, hb - 1), lambda p: F.when(at == 0, pair(p, p)).otherwise(pair(p, hb - 1 + at)))
    members = members.withColumn("pq", F.explode(F.when(F.col("home"), as_home).otherwise(as_visitor)))
    # side 0: homes of block p; 1: homes of another block; 2: visitors
    side = F.when(~F.col("home"), 2).when(F.col("mine") == F.col("pq.p"), 0).otherwise(1)
    members = members.select("label", "cell", "pq.p", "pq.q", side.alias("side"), "class", "rep", "m", "own", "visits", "v")
    members = members.repartition("label", "cell", "p", "q").sortWithinPartitions("label", "cell", "p", "q")

    def meet(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pa.Table.from_batches(parts).combine_chunks()
        number = lambda c: g.column(c).to_numpy()
        side, own, m, key = number("side"), number("own"), number("m"), number("class")
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        v = g.column("v").chunk(0)
        at = v.offset
        ends = np.frombuffer(v.buffers()[1], np.int32)[at : at + len(v) + 1]
        u = _unit(np.frombuffer(v.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(v), -1))
        found = []
        if number("p")[0] == number("q")[0]:
            i, j = np.nonzero(np.triu(u[left] @ u[left].T >= threshold, 1))
            found.append((left[i], left[j]))
        if len(left) and len(right):
            i, j = np.nonzero(u[left] @ u[right].T >= threshold)
            i, j = left[i], right[j]
            if len(i):  # a visitor that the one at home visits, too, counts in the cell with the smaller number
                lists = g.column("visits").chunk(0)
                to = lists.flatten().to_numpy().astype(np.int64)
                by = np.repeat(np.arange(len(v)), np.diff(lists.offsets.to_numpy()))
                both = np.isin(i * (1 << 32) + own[j], by * (1 << 32) + to)
                ok = (side[j] == 1) | ~both | (own[i] < own[j])
                found.append((i[ok], j[ok]))
        i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        if len(i):
            links = np.bincount(i, weights=m[j], minlength=len(v)) + np.bincount(j, weights=m[i], minlength=len(v))
            some = np.flatnonzero(links)
            root, member = stars(i, j)
            rep, none = g.column("rep").combine_chunks(), lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(links[some].astype(np.int64)), none(len(some), rep.type), none(len(some), rep.type)], ["class", "n", "a", "b"])
            yield pa.RecordBatch.from_arrays([none(len(root), pa.int64()), none(len(root), pa.int64()), rep.take(pa.array(root)), rep.take(pa.array(member))], ["class", "n", "a", "b"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("label", "cell", "p", "q"))))
            cuts = [0, *(k for k in range(1, len(marks)) if marks[k] != marks[k - 1]), len(marks)]
            for s, t in zip(cuts[:-1], cuts[1:]):
                if held and marks[s] != last:
                    yield from meet(held)
                    held = []
                last = marks[s]
                held.append(batch.slice(s, t - s))
        if held:
            yield from meet(held)

    schema = with_fields(("class", "long"), ("n", "long"), *(StructField(c, id_field.dataType) for c in "ab"))
    found = stored(members.mapInArrow(tidied(blocks), schema), "vec-links")
    counts = found.where("class is not null").groupBy("class").agg(F.sum("n").alias("n"))
    links = owned.join(counts, "class", "left").groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    links = stored(links, "vec-counts")
    groups = components(found.where("a is not null").select("a", "b").unionByName(owned.where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    released(units_df, folded, found)
    out = rows.select("id").join(links, "id", "left").join(groups, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
