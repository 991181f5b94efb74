"""Exact top-k search by integer inner product over a pivot-distance index.

Components become floor(scale * x). The index keys every vector by its nearest pivot and its distance r from it; the
distances of a pivot's vectors are cut at their quantiles into annuli. Pivots come from Lloyd rounds in numpy on about
`sample` vectors (a documented bound; every vector is indexed, and no result depends on the sample). For a query q at
distance d from a pivot, each x of an annulus [r0, r1] has |q - x| >= max(r0 - d, d - r1), as triangles go, and so
2 <q, x> = |q|^2 + |x|^2 - |q - x|^2 is at most |q|^2 + (largest |x|^2 of the annulus) - that bound squared.

A query visits annuli in the order of that bound, in rounds: at first those that hold about `first` rows, in each later
round about eight times as many, and only those whose bound reaches the k-th score it has so far. It has ended when no
such annulus is left; as bounds are sorted, one look ahead tells. Annuli and pivots are at most `pivots` * `rings` and
travel as a broadcast. Rows of an annulus are dealt out in blocks of `block`, its queries too, so an annulus of very many
(equal) vectors is many groups of bounded size; a group is one product of two matrices and gives back k rows a query,
and later only those that reach its k-th score.

Products are exact: in doubles where all of them stay below 2**53, else in 64-bit integers.

Defined results: vectors that are null or hold null or non-finite components (or ones beyond 64 bits as integers) take
no part; an empty one has score 0 with all, and shorter vectors count as filled up with zeros. Each row is a candidate
of its own, so rows that share an id do not exclude each other, and a query id in several rows gets a result for each.
Ties go to the smaller id, null ids last. Queries with no other row have no result. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from .common import stored, tidied, with_fields


def _integers(column, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow column of double arrays that take part, and their integer vectors, filled up to width."""
    starts, ends = column.offsets.to_numpy()[:-1].astype(np.int64), column.offsets.to_numpy()[1:].astype(np.int64)
    some = ~column.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(some, ends - starts, 0)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    x = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore", invalid="ignore"):
        x[row, place] = np.floor(scale * flat[np.repeat(starts, sizes) + place])
        rows = np.flatnonzero(some & (np.isfinite(x) & (np.abs(x) < 2.0**63)).all(1))
    return rows, x[rows].astype(np.int64)


def _packed(x: np.ndarray):
    """Integer vectors as an Arrow column of bytes: 4 a component where a vector fits, else 8."""
    import pyarrow as pa

    small = (np.abs(x.astype(np.float64)) < 2.0**31).all(1)
    return pa.array([(v.astype("<i4") if s else v.astype("<i8")).tobytes() for v, s in zip(x, small)], pa.binary())


def _unpacked(column, width: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.zeros((len(raw), width), np.int64)
    for size, kind in ((4, "<i4"), (8, "<i8")) if width else ():
        rows = [k for k, b in enumerate(raw) if len(b) == size * width]
        out[rows] = np.frombuffer(b"".join(raw[k] for k in rows), kind).reshape(-1, width)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two sets of integer vectors, exactly."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2.0**53 else a @ b.T


def fit_pivots(x: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """n pivots or fewer by Lloyd rounds, as whole numbers."""
    x = np.unique(x, axis=0).astype(np.float64)
    pivots = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = (0.5 * (pivots * pivots).sum(1) - x @ pivots.T).argmin(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=len(pivots))[:, None]
        pivots = np.where(size > 0, np.rint(sums / np.maximum(size, 1)), pivots)
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T), 0))


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256, pivots: int = 2048, rings: int = 64, sample: int = 20000, ring: int = 128, block: int = 512, first: int = 1024) -> DataFrame:
    """query_id, rank, id and score of the k best rows for each row that `queries` (a condition) holds for."""
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("v is not null")
    id_field = rows.schema["id"]
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    share = min(1.0, sample / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("pivots"), "id", "v"), F.lit(1 << 30)) < share * (1 << 30)).select("v").toArrow().column("v")
    known = [x for c in drawn.chunks for x in (_integers(c, width, scale)[1],) if len(x)]
    centres = fit_pivots(np.concatenate(known), min(pivots, math.ceil(math.sqrt(n) / 4))) if known else np.zeros((1, width))
    sent = spark.sparkContext.broadcast(centres)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                some, x = _integers(pa.concat_arrays([part.column("v")]), width, scale)
                if len(some):
                    d = distances(x, sent.value)
                    cell, take = d.argmin(1), pa.array(some)
                    norm = (x.astype(np.float64) ** 2).sum(1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row").take(take), part.column("id").take(take), part.column("asks").take(take), _packed(x), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), pa.array(norm)],
                        ["row", "id", "asks", "v", "cell", "r", "norm"],
                    )

    schema = with_fields(("row", "long"), id_field, ("asks", "boolean"), ("v", "binary"), ("cell", "int"), ("r", "double"), ("norm", "double"))
    index = stored(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(tidied(keyed), schema), "topk-index")
    # annuli: at most `rings` a pivot, so that one holds about `ring` rows or more
    n_rings = max(1, min(rings, math.ceil(n / len(centres) / ring)))
    cuts = index.groupBy("cell").agg(F.percentile_approx("r", [i / n_rings for i in range(1, n_rings)] or [0.5], 10 * rings).alias("cuts"))
    cuts = stored(cuts, "topk-cuts")  # a row a pivot
    placed = index.join(F.broadcast(cuts), "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("r")))).drop("cuts")
    found = placed.groupBy("cell", "ring").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.max("norm").alias("norm"), F.count("*").alias("n")).orderBy("cell", "ring").toPandas()
    annuli = {c: found[c].to_numpy() for c in found.columns}
    sent_annuli = spark.sparkContext.broadcast(annuli)
    asking = stored(index.where("asks").select("row", "id", "v"), "topk-queries")

    def visits(lo: int, hi: int, loaded: bool):
        """Of each query the annuli of a round: those before which, in order of the bounds, lo up to hi rows come."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = sent_annuli.value
            for b in batches:
                for at in range(0, b.num_rows, 32):
                    part = b.slice(at, 32)
                    x = _unpacked(part.column("v"), width)
                    square = (x.astype(np.float64) ** 2).sum(1)[:, None]
                    d = distances(x, sent.value)[:, a["cell"]]
                    gap = np.maximum(np.maximum(a["r0"] - d, d - a["r1"]), 0)
                    bound = (square + a["norm"] - gap * gap) / 2
                    order = np.argsort(-bound, axis=1, kind="stable")
                    size = a["n"][order]
                    before = np.cumsum(size, axis=1) - size
                    least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)  # no k-th score yet: NaN
                    slack = 0.5 + 1e-6 * (square + a["norm"])
                    reach = np.take_along_axis(~(bound + slack < least[:, None]), order, 1)
                    for q, (w, o) in enumerate(zip((before >= lo) & (before < hi) & reach, order)):
                        to = o[w]
                        for s in range(0, len(to), 4096):
                            t = to[s : s + 4096].astype(np.int32)
                            cols = [pa.array(t)]
                            if loaded:
                                one = pa.array(np.full(len(t), q))
                                cols += [part.column(c).take(one) for c in ("row", "v", "least")]
                            yield pa.RecordBatch.from_arrays(cols, ["annulus", "row", "v", "least"][: len(cols)])

        return run

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best rows of a block for each query of a block."""
        if not left.num_rows or not right.num_rows:
            return empty
        left = left.sort_by([("id", "ascending")])  # nulls last
        own, ask = left.column("row").to_numpy(), right.column("row").to_numpy()
        s = products(_unpacked(right.column("v"), width), _unpacked(left.column("v"), width))
        ok = ask[:, None] != own[None, :]
        if s.shape[1] > k + 1:  # a query may be among the rows itself
            ok &= s >= np.partition(s, s.shape[1] - k - 1, axis=1)[:, [s.shape[1] - k - 1]]
        least = right.column("least").combine_chunks()
        some = ~least.is_null().to_numpy(zero_copy_only=False)
        ok[some] &= s[some] >= least.drop_null().to_numpy()[:, None]
        i, j = np.nonzero(ok)
        order = np.lexsort((j, -s[i, j], i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[rank < k], j[rank < k]
        return pa.table([pa.array(ask[i]), left.column("id").take(pa.array(j)), pa.array(s[i, j])], names=["row", "id", "score"])

    out_schema = with_fields(("row", "long"), id_field, ("score", "long"))
    empty = spark.createDataFrame([], out_schema).toArrow()
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    top, lo, hi = None, 0, first
    while True:
        if top is None:
            ready = asking.select("row", "v", F.lit(None).cast("long").alias("least"))
        else:
            full = top.groupBy("row").agg(F.count("*").alias("m"), F.min("score").alias("least")).where(F.col("m") >= k).select("row", "least")
            ready = asking.join(full, "row", "left").select("row", "v", "least")
        wanted = {r["annulus"]: r["m"] for r in ready.mapInArrow(tidied(visits(lo, hi, False)), "annulus int").groupBy("annulus").agg(F.count("*").alias("m")).collect()}  # annuli are bounded
        if not wanted:
            break
        shares = [(a, int(annuli["cell"][a]), int(annuli["ring"][a]), max(1, -(-int(annuli["n"][a]) // block)), max(1, -(-m // block))) for a, m in wanted.items()]
        shares = F.broadcast(spark.createDataFrame(shares, "annulus int, cell int, ring int, blocks int, askers int"))  # a row an annulus
        spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        part = lambda c: F.pmod(F.xxhash64("row"), F.col(c).cast("long")).cast("int")
        data = placed.join(shares, ["cell", "ring"]).select("annulus", part("blocks").alias("d"), spread("askers").alias("q"), "row", "id", "v")
        asks = ready.mapInArrow(tidied(visits(lo, hi, True)), "annulus int, row long, v binary, least long").join(shares, "annulus")
        asks = asks.select("annulus", spread("blocks").alias("d"), part("askers").alias("q"), "row", "v", "least")
        key = ["annulus", "d", "q"]
        got = data.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(meet, out_schema)
        got = got if top is None else top.unionByName(got)
        top = stored(got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "topk-best")
        if hi >= n:
            break
        lo, hi = hi, hi * 8
    if top is None:
        top = spark.createDataFrame([], out_schema)
    named = asking.select("row", F.col("id").alias("query_id"))
    return top.withColumn("rank", F.row_number().over(best)).join(named, "row").select("query_id", "rank", F.col("id").alias(id_col), "score")
