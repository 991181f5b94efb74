"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct five-word shingles (lower-cased A-Z). Sets that are equal are
one class. Of each class the `k` smallest hashes are retained. Runs of three neighbouring retained values are the
keys of inverted lists, `keys` of them a class (the smallest of each residue; key_count(percent) unless given). In U
values of a union at most U - I end a run of three, so two sets that give all their runs (up to keys + 2 values) and
pass share one where I > 2 (U - I) + 2. The few sizes for which that can fail (4 and 5 values at 80) give the values
of their prefix as keys, too: of n ascending values the first n - ceil(n percent / 100) + 1, one of which two such
sets share. Of larger sets, simulated pairs right at the threshold were missed with a chance below one in a million
(worst of nested and evenly differing ones with 20 to 3000 values: 4e-7 at 80 with 40 keys, at 85 with 29).

Lists with one member go, and of lists with the same members one stays. The full sets of the members, hashes of 48
bits, are shipped to their lists. There the union sketch (all values up to the smaller of both largest retained ones)
estimates each pair: it is exact where both sets are retained whole, others within six standard errors are verified on
the full sets, those first that look most alike, and only while they would connect something new. A list gives back
one star for each group of members that links connect, never its pairs.

Only what connects matters, so a long list is not compared pair by pair: its first `block` members are compared with
all. Most members of a tight group are then connected; only those of a list that are not in its largest group (by the
components so far) are, in a second round, compared with each other and with all the rest, in blocks of bounded size
that are spread over tasks. Stars are joined to components by repeated large-star and small-star steps, written to the
shared folder.

Texts of documents in no list are not shuffled: a table of marks, 2**26 bits at most, lets most of them be left out
where they are read. It changes no result; past a hundred million documents in lists it leaves out fewer.

Defined results: null and empty texts have empty sets and link with nothing. With fewer than five words the whole
sequence is the one shingle. Rows that share an id are one document with all their texts. Rows with a null id
link with nothing; their component_id is null and they are kept. An empty table gives an empty result. Other input
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from . import text as tx
from .common import marked, released, slices, stars, stored, tidied, with_fields

_P = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 65)]


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    data, offsets = tx.packed(texts)
    data = tx.LOWER[data]
    starts, ends = tx.words(data)
    h = tx.word_hashes(data, starts, ends)
    first, _ = tx.per_text(starts, offsets)
    n = max(len(h) - size + 1, 0)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams += h[k : k + n] * _P[k]
    grams = tx.mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(tx.mix((h[a:b] * np.array(_P[: b - a])).sum(keepdims=True) + _P[b - a + 10]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def key_count(percent: int) -> int:
    """List keys a class, so many that a pair right at the threshold is missed with a chance below one in a million."""
    run = (percent / 100) ** 3
    shared = min(max(run / (2 - run), 0.01), 0.9)  # of the runs of both sets, for nested sets longer than a sketch
    return math.ceil(16.8 / -math.log(1 - shared))


def _prefixed(percent: int, keys: int) -> int:
    """Largest set for which a pair can pass without a shared run, as far as sets give all their runs."""
    d = 0
    while 3 * d + 2 <= keys + 2 and -(-percent * (d + 1) // max(100 - percent, 1)) <= 2 * (d + 1) + 2:
        d += 1
    return min(3 * d + 2, keys + 2)


def _list_keys(kept: np.ndarray, keys: int, percent: int) -> np.ndarray:
    """Keys of the inverted lists that a set with these retained values (upper halves, ascending) is in."""
    kept = kept.astype(np.uint64)
    n = len(kept)
    prefix = tx.mix(kept[: n - -(-percent * n // 100) + 1] * _P[7] + _P[8]) if n <= _prefixed(percent, keys) else kept[:0]
    if len(kept) < 3:
        lists = tx.mix(kept.sum(keepdims=True) + np.uint64(len(kept))) if len(kept) else kept
    else:
        lists = tx.mix(kept[:-2] * _P[1] + kept[1:-1] * _P[2] + kept[2:] * _P[3])
        if len(lists) > keys:
            part = lists % np.uint64(keys)
            order = np.lexsort((lists, part))
            part = part[order]
            lists = lists[order][np.concatenate([[True], part[1:] != part[:-1]])]
    return np.unique(np.concatenate([lists, prefix]))


def _set_hash(s: np.ndarray, salt: np.uint64) -> int:
    return int(tx.mix(s + salt).sum(dtype=np.uint64).view(np.int64))


def _keyed(docs: DataFrame, shingle: int, k: int, keys: int, percent: int) -> DataFrame:
    """id, n, h1, h2, keys: size and hash of each document's set and the lists that it is in."""
    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            sets = shingle_sets(b.column("text").to_pylist(), shingle)
            lists = [_list_keys(s[:k] >> np.uint64(32), keys, percent).view(np.int64) for s in sets]
            numbers = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [_set_hash(s, _P[5]) for s in sets], [_set_hash(s, _P[6]) for s in sets])]
            yield pa.RecordBatch.from_arrays([b.column("id"), *numbers, pa.array(lists, pa.list_(pa.int64()))], ["id", "n", "h1", "h2", "keys"])

    return docs.mapInArrow(tidied(rows), with_fields(docs.schema["id"], ("n", "long"), ("h1", "long"), ("h2", "long"), ("keys", "array<long>")))


def _full(docs: DataFrame, shingle: int) -> DataFrame:
    """id, h1, set: the upper 48 bits of each document's hashes, ascending."""
    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            sets = shingle_sets(b.column("text").to_pylist(), shingle)
            packed = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([_set_hash(s, _P[5]) for s in sets], pa.int64()), pa.array(packed, pa.binary())], ["id", "h1", "set"])

    return docs.mapInArrow(tidied(rows), with_fields(docs.schema["id"], ("h1", "long"), ("set", "binary")))


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def _passing(left: list[np.ndarray], right: list[np.ndarray], k: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs whose union sketch can pass, which of them pass for certain (sets retained whole), and the estimates.

    left, right: full ascending sets; the first k values of each are its sketch.
    """
    sl, sr = [x[:k] for x in left], [x[:k] for x in right]
    vl, vr = np.concatenate(sl), np.concatenate(sr)
    il, ir = np.repeat(np.arange(len(sl)), [len(x) for x in sl]), np.repeat(np.arange(len(sr)), [len(x) for x in sr])
    shared = np.intersect1d(vl, vr)
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]
        sides = []
        for v, i, n in ((vl, il, len(left)), (vr, ir, len(right))):
            p = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[p] == v
            m = np.zeros((n, len(part)), np.float32)
            m[i[hit], p[hit]] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    i, j = np.nonzero(common * 100 >= 0.5 * percent * np.minimum.outer([len(x) for x in sl], [len(x) for x in sr]))
    far = np.iinfo(np.int64).max
    lim_l, lim_r = (np.array([far if len(x) <= k else x[k - 1] for x in side], np.int64) for side in (left, right))
    exact = (lim_l[i] == far) & (lim_r[j] == far)
    lim = np.minimum(lim_l[i], lim_r[j])
    a = np.array([np.searchsorted(sl[x], t, side="right") for x, t in zip(i, lim)], np.int64)
    b = np.array([np.searchsorted(sr[y], t, side="right") for y, t in zip(j, lim)], np.int64)
    both = common[i, j].astype(np.int64)
    union = np.maximum(a + b - both, 1)
    slack = 6 * np.sqrt(percent / 100 * (1 - percent / 100) / union)
    ok = np.where(exact, 100 * both >= percent * union, both / union >= percent / 100 - slack)
    return i[ok], j[ok], exact[ok], (both / union)[ok]


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def _connected(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, sure: np.ndarray, looks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) of the groups that links connect: sure pairs, and of the others those that full sets confirm."""
    root, member = stars(i[sure], j[sure])
    parent = np.arange(len(sets))
    parent[member] = root
    i, j = i[~sure], j[~sure]
    order = np.argsort(-looks[~sure], kind="stable")
    i, j = i[order], j[order]
    while len(i):
        apart = np.flatnonzero(parent[i] != parent[j])
        i, j = i[apart], j[apart]
        for at in range(min(len(i), 256)):
            x, y = parent[i[at]], parent[j[at]]
            if x != y and _similar(sets[i[at]], sets[j[at]], percent):
                parent[parent == max(x, y)] = min(x, y)
        i, j = i[256:], j[256:]
    member = np.flatnonzero(parent != np.arange(len(sets)))
    return parent[member], member


def _met(members: DataFrame, full: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: stars of the members of each list that links connect.

    members: id, h1, key, home, hb, vb. Homes are cut to hb blocks and others to vb; every block of homes meets every
    block. (p, q): home block p with home block q >= p, and with others: their first block where q = p, the rest beyond.
    """
    import pyarrow as pa

    mine = F.pmod(F.xxhash64("id", "h1", F.lit(3)), F.when(F.col("home"), F.col("hb")).otherwise(F.col("vb")))
    one, hb, vb, at = F.lit(1).cast("long"), F.col("hb").cast("long"), F.col("vb").cast("long"), F.col("mine").cast("long")
    pair = lambda p, q: F.struct(p.cast("long").alias("p"), q.cast("long").alias("q"))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    as_home = F.concat(F.transform(span(at, hb - 1), lambda q: pair(at, q)), F.transform(span(one, vb - 1), lambda v: pair(at, hb - 1 + v)), F.transform(span(one - 1, at - 1), lambda p: pair(p, at)))
    as_other = F.transform(span(one - 1, hb - 1), lambda p: F.when(at == 0, pair(p, p)).otherwise(pair(p, hb - 1 + at)))
    rows = members.withColumn("mine", mine).withColumn("pq", F.explode(F.when(F.col("home"), as_home).otherwise(as_other)))
    rows = rows.select("id", "h1", "key", "pq.p", "pq.q", (F.col("home") & (F.col("mine") == F.col("pq.p"))).alias("first"))
    rows = rows.join(full.hint("merge"), ["id", "h1"]).select("key", "p", "q", "first", "id", "set")
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def meet(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pa.Table.from_batches(parts).combine_chunks()
        sets = [_unpacked(x) for x in g.column("set").to_pylist()]
        first = g.column("first").to_numpy()
        l, r = np.flatnonzero(first), np.flatnonzero(~first)  # noqa: E741
        found = []
        if len(l) > 1 and g.column("p")[0] == g.column("q")[0]:
            i, j, sure, looks = _passing([sets[x] for x in l], [sets[x] for x in l], k, percent)
            half = i < j
            found.append((l[i[half]], l[j[half]], sure[half], looks[half]))
        if len(l) and len(r):
            i, j, sure, looks = _passing([sets[x] for x in l], [sets[x] for x in r], k, percent)
            found.append((l[i], r[j], sure, looks))
        if found:
            root, member = _connected(sets, *(np.concatenate(x) for x in zip(*found)), percent)
            if len(root):
                ids = g.column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(root)), ids.take(pa.array(member))], ["a", "b"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = np.stack([batch.column(c).to_numpy() for c in ("key", "p", "q")], 1)
            cuts = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for s, t in zip(cuts[:-1], cuts[1:]):
                if held and tuple(mark[s]) != last:
                    yield from meet(held)
                    held = []
                last = tuple(mark[s])
                held.append(batch.slice(s, t - s))
        if held:
            yield from meet(held)

    id_field = members.schema["id"]
    return rows.mapInArrow(tidied(lists), with_fields(*(StructField(c, id_field.dataType) for c in "ab"))).where("a != b")


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that each id of an edge (a, b) can reach, by large-star and small-star steps.

    Every step is a groupBy on ids with partial minima and ends in a written table; steps go with the logarithm of
    the longest path.
    """
    edges = stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-0")
    step, before = 0, None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(least, large["b"] == least["u"]).select(F.col("m").alias("p"), F.col("a").alias("x"), F.col("b").alias("y"))
        small = small.select(F.explode(F.array(F.struct(F.col("p").alias("a"), F.col("x").alias("b")), F.struct(F.col("p").alias("a"), F.col("y").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        step += 1
        last, edges = edges, stored(small, f"cc-{step}")
        released(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    return found.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5, k: int = 256, keys: int | None = None, block: int = 512) -> DataFrame:
    """id, n_shingles, component_id and kept for each document; two link when 100 * |A and B| >= percent * |A or B|."""
    keys = key_count(percent) if keys is None else keys
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = stored(_keyed(rows, shingle, k, keys, percent), "near-sets")
    known = sets.where("id is not null and n > 0")
    classes = stored(known.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.any_value("keys").alias("keys")), "near-classes")
    copies = known.select("id", "h1", "h2", "n").join(classes.select(F.col("id").alias("rep"), "h1", "h2", "n"), ["h1", "h2", "n"]).where("id != rep")
    copies = stored(copies.select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "near-copies")
    lists = classes.select("id", "h1", F.explode("keys").alias("key"))
    sign = [F.bit_xor(F.xxhash64("id", "h1", F.lit(x))).alias(f"s{x}") for x in (1, 2)]
    lists_of = lists.groupBy("key").agg(F.count("*").alias("m"), *sign).where("m > 1").groupBy("m", "s1", "s2").agg(F.min("key").alias("key"))
    members = lists.join(lists_of.select("key", "m"), "key").withColumn("long", F.col("m") > block)
    leader = ~F.col("long") | (F.pmod(F.xxhash64("id", "h1", F.lit(4)), F.ceil(F.col("m") / block)) == 0)
    members = stored(members.withColumn("home", leader).withColumns({"hb": F.lit(1), "vb": F.greatest(F.ceil(F.col("m") / (4 * block)), F.lit(1))}), "near-members")
    full = _full(marked(rows.where("id is not null"), members.select("id")), shingle)
    full = stored(full.groupBy("id", "h1").agg(F.any_value("set").alias("set")).join(members.select("id", "h1").distinct(), ["id", "h1"], "left_semi"), "near-full")
    links = stored(_met(members, full, k, percent), "near-links").unionByName(copies)
    found = components(links)
    more = members.where("long").join(found.withColumnRenamed("component", "own"), "id", "left").withColumn("own", F.coalesce("own", "id"))
    most = more.groupBy("key", "own").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("own", F.struct("c", "own")).alias("most"))
    # leaders have met all; of the others, who is not in the list's largest group goes on
    more = more.where("not home").join(most, "key").select("id", "h1", "key", (F.col("own") != F.col("most")).alias("home"))
    left = more.groupBy("key").agg(F.ceil(F.count_if("home") / block).alias("hb"), F.greatest(F.ceil(F.count_if(~F.col("home")) / (4 * block)), F.lit(1)).alias("vb")).where("hb > 0")
    more = stored(more.join(left, "key"), "near-more")
    if not more.isEmpty():
        found = components(stored(_met(more, full, k, percent), "near-links").unionByName(links))
    released(classes, members, full)
    out = sets.select("id", "n").join(found, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
