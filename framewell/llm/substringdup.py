"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

1. Equal texts are folded: of a text of `length` bytes or more only the first occurrence keeps anything.
2. Candidates: in every `length`-byte string the smallest hash of its 32-byte pieces marks an anchor, so equal strings
   have equal anchors at equal places. Anchors whose hash occurs once can be in no repeat and go.
3. Of each anchor left, the bytes of all strings that it is the anchor of (its context) are dealt out by the anchor's
   hash. Equal contexts are folded in order: all but the first are removed whole. Of an anchor with more than `split`
   places, equal contexts are folded within a task before they are dealt out, and the rest is dealt out finer: its
   strings are grouped by where the anchor lies in them, in more groups the more places there are, and the bytes that
   all strings of a group have around the anchor take the anchor's part. At most a group holds equal strings only.
4. Different contexts of an anchor are joined to one text. Its suffixes are sorted to depth `length` and more, which
   gives its Burrows-Wheeler transform. Breadth-first backward extension of intervals then sets the longest common
   prefixes (LCP) of neighbouring suffixes by increasing value and stops at `length`: what is still unset is at least
   that long, so stretches of unset values are the classes of equal `length`-byte strings. In each class all but the
   earliest start are covered. The first seven values are read from the packed keys of the sort.
5. Covered stretches are merged by document, and the rest is hashed.

Ids are whole numbers; other id types are an error.

Anchors and contexts are spread by hash; a task holds `batch` bytes of contexts, or those of one group that differ.

Defined results: a null text counts as empty: nothing is removed. Rows with the same id and text are one document and
get equal results; rows with the same id and different texts are ordered by a hash of the text. Null ids come before
all others. Other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import slices, stored, tasks, tidied

Q = 32  # bytes of a hashed piece
_MUL = 0x9E3779B97F4A7C15
_PLACE = (1 << 40) - 1  # a start is kept below the upper bits, which tell texts of one id apart


def piece_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from each place, by doubling."""
    x, k = tx.mix(b.astype(np.uint64) + np.uint64(1)), 1
    while k < Q:
        n = len(x) - k
        x = x[:n] * np.uint64(pow(_MUL, k, 1 << 64)) + x[k:]
        k *= 2
    return tx.mix(x)


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    k, m = 1, x
    while k * 2 <= w:
        m = best(m[:-k], m[k:])
        k *= 2
    n = len(x) - w + 1
    return best(m[:n], m[w - k : w - k + n])


def anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, their hashes, and for each string of `length` bytes the number of its anchor."""
    h = piece_hashes(b)
    w = length - Q + 1
    least = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == h)
    own = np.searchsorted(at, np.arange(len(least)))
    left = np.flatnonzero(h[at[own]] != least)
    while len(left):
        own[left] += 1
        left = left[h[at[own[left]]] != least[left]]
    used = np.unique(own)
    return at[used], h[at[used]], np.searchsorted(used, own)


def sorted_suffixes(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of symbols (below 512) in order of their first `depth` symbols or more, and packed keys of seven symbols."""
    n = len(t)
    pad = np.concatenate([t, np.zeros(7, t.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for d in range(7):
        key = (key << np.uint64(9)) | pad[d : d + n]
    sa = np.argsort(key)
    ks = key[sa]
    new = np.concatenate([[True], ks[1:] != ks[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[n] = -1
    h = 7
    multi = ~(new & np.concatenate([new[1:], [True]]))
    slot = np.flatnonzero(multi)  # places of the suffix array that are not settled
    while h < depth and len(slot):
        s = sa[slot]
        r = rank[s]
        nxt = rank[np.minimum(s + h, n)]
        both = r * (n + 2) + nxt  # a group keeps its places, so ranks and what follows fit in one key
        order = np.argsort(both)
        s, both = s[order], both[order]
        sa[slot] = s
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[s] = slot[np.flatnonzero(new)][np.cumsum(new) - 1]
        slot = slot[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return sa, ks


def classes(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and where classes of suffixes with equal first `length` symbols begin (symbol 0 separates texts)."""
    sa, ks = sorted_suffixes(t, length)
    n = len(t)
    lcp = np.full(n + 1, -1, np.int16)
    lcp[0] = lcp[n] = 0
    differ = ks[1:] ^ ks[:-1]
    some = np.flatnonzero(differ)
    # the highest differing bit tells how many of the seven symbols agree
    lcp[some + 1] = 6 - (np.log2(differ[some].astype(np.float64)) // 9).astype(np.int16)
    bwt = t[sa - 1].copy()
    bwt[sa == 0] = 0
    order = np.argsort(bwt.astype(np.int16), kind="stable")
    lf = np.empty(n, np.int64)
    lf[order] = np.arange(n)  # C[c] + Occ(c, i), as the first column holds the same symbols in order
    shift = n - int(np.count_nonzero(t)) - int(np.count_nonzero(bwt == 0))
    lf += shift
    starts = np.concatenate([[0], some + 1])
    ends = np.concatenate([some + 1, [n]])
    live = lcp[ends] == 6
    live[-1] = True
    lo, hi = starts[live], ends[live]
    for level in range(7, length):
        if not len(lo):
            break
        size = hi - lo
        one = lo[size == 1]
        one = lf[one[bwt[one] != 0]]
        lo, hi, size = lo[size > 1], hi[size > 1], size[size > 1]
        member = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        owner = np.repeat(np.arange(len(lo)), size)
        ok = bwt[member] != 0
        member, owner = member[ok], owner[ok]
        key = owner * 512 + bwt[member]
        if len(key):
            by = np.argsort(key)
            key, to = key[by], lf[member[by]]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lo, hi = np.concatenate([one, np.minimum.reduceat(to, new)]), np.concatenate([one, np.maximum.reduceat(to, new)]) + 1
        else:
            lo, hi = one, one + 1
        open_ = lcp[hi] < 0
        lo, hi = lo[open_], hi[open_]
        lcp[hi] = level
    return sa, lcp[:n] >= 0


def repeated(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For contexts in order, which of their strings of `length` bytes also start earlier in this or an earlier one."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    t = np.zeros(int(ends[-1]), np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(contexts)), sizes)
    t[at] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1
    whole = np.zeros(len(t), bool)
    n_starts = sizes - length + 1
    whole[np.arange(int(n_starts.sum())) + np.repeat(begins - (np.cumsum(n_starts) - n_starts), n_starts)] = True
    sa, new = classes(t, length)
    first = np.minimum.reduceat(np.where(whole[sa], sa, len(t)), np.flatnonzero(new))[np.cumsum(new) - 1]
    covered = np.zeros(len(t), bool)
    covered[sa] = whole[sa] & (sa > first)
    return [covered[b : b + k] for b, k in zip(begins, n_starts)]


def _stretches(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches that strings from these ascending starts cover."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


def regrouped(c: bytes, o: int, n: int, length: int) -> Iterator[tuple[int, int, bytes]]:
    """The strings of a context with its anchor at o, in n groups by the anchor's place in them.

    Each comes as a key, where it starts in the context, and its bytes. The key is a hash of the bytes around the anchor
    that every string of the group has, so equal strings of any contexts get equal keys.
    """
    w = length - Q + 1
    for g in range(n):
        lo, hi = -(-g * w // n), -(-(g + 1) * w // n) - 1  # places of the anchor
        a, b = max(0, o - hi), min(len(c) - length, o - lo)
        if lo <= hi and a <= b:
            core = hashlib.blake2b(c[o - lo : o - hi + length], digest_size=8, salt=bytes([g]))
            yield int.from_bytes(core.digest(), "little", signed=True), a, c[a : b + length]


def _spread(k: int, s: int) -> int:
    """A key that deals rows out by their place alone."""
    return ((k * _MUL ^ s) * _MUL & (1 << 63) - 1) >> 1


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, batch: int = 1 << 20, split: int = 4096, one_in: int = 64) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of each removed stretch) for each document."""
    import pyarrow as pa

    if length < 2 * Q:
        raise ValueError(f"length must be {2 * Q} or more")
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("ids must be whole numbers")
    none = -(1 << 63)  # stands for a null id and sorts first
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("k"), F.shiftrightunsigned(F.xxhash64(text), 48).alias("v"), text.alias("text"))
    # equal texts: the first one speaks for all
    signs = rows.where(F.octet_length("text") >= length).select("k", "v", F.sha2("text", 256).alias("sha"))
    same = signs.groupBy("sha").agg(F.min(F.struct("k", "v")).alias("a"), F.max(F.struct("k", "v")).alias("b")).where("a != b").select("sha", "a")
    copies = stored(signs.join(same.hint("merge"), "sha").where(F.struct("k", "v") != F.col("a")).select("k", "v", F.lit(True).alias("copy")).distinct(), "sub-copies")
    # all joins to texts are on (k, v), so the texts are dealt out once and those files are read again
    # (short texts are passed over in the tasks, as a filter here would make another exchange)
    first = rows.join(copies.hint("merge"), ["k", "v"], "left").where(F.col("copy").isNull())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hs, at, n = [], [], []
            for t in b.column("text").to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                p, h, _ = anchors(np.frombuffer(raw, np.uint8), length) if len(raw) >= length else (np.zeros(0, np.int64), np.zeros(0, np.uint64), None)
                hs.append(h.view(np.int64)), at.append(p), n.append(len(p))
            idx = np.repeat(np.arange(b.num_rows), n)
            k, v = (b.column(c).to_numpy()[idx] for c in ("k", "v"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(k), pa.array((v << 40) | np.concatenate(at))], ["h", "k", "p"])

    marks = first.select("k", "v", "text").mapInArrow(tidied(found), "h long, k long, p long")
    groups = F.when(F.col("m") <= split, 1).otherwise(F.least(F.lit(length - Q + 1), F.pow(F.lit(2), F.ceil(F.log2(F.col("m") / split))))).cast("long")
    # anchors seen very often in one in `one_in` documents are dealt out by place, as it is known that they repeat; of the
    # others all places are counted
    seen = rows.where(F.pmod(F.xxhash64("k"), F.lit(one_in)) == 0).select("k", F.lit(0).cast("long").alias("v"), "text").mapInArrow(tidied(found), "h long, k long, p long")
    often = seen.groupBy("h").agg((F.count("*") * one_in).alias("m")).where((F.col("m") > split) & (F.col("m") > one_in))
    often = often.orderBy(F.desc("m"), "h").limit(4 * tasks(docs)).select("h", groups.alias("often"))
    spread = marks.join(F.broadcast(often), "h", "left").select("k", "p", "often", F.when(F.col("often").isNull(), F.col("h")).otherwise(F.xxhash64("k", "p")).alias("h"))
    counted = spread.withColumn("m", F.count("*").over(Window.partitionBy("h"))).where("m > 1 or often is not null").withColumn("groups", F.coalesce("often", groups))
    place = F.col("p").bitwiseAND(_PLACE).bitwiseOR(F.shiftleft("groups", 40))  # and in how many groups the anchor's strings go
    per_doc = counted.groupBy("k", F.shiftrightunsigned("p", 40).alias("v")).agg(F.collect_set(place).alias("at"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of anchors; of one known to be covered whole only its size, dealt out by its place."""
        out: list[tuple] = []
        firsts: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}  # of much repeated anchors: k, place, anchor in it, groups
        done: tuple = ()
        held = 0

        def folded(h: int, k: int, s: int, c: bytes, o: int, n: int) -> int:
            seen = firsts.setdefault((h, c), (k, s, o, n))
            if seen[:2] == (k, s):
                return len(c)
            late = max(seen[:2], (k, s))
            firsts[h, c] = (*min(seen[:2], (k, s)), o, n)
            out.append((_spread(*late), *late, None, len(c)))
            return 0

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["h", "k", "s", "c", "n"])
                out.clear()

        def deal() -> None:
            for (_, c), (k, s, o, n) in firsts.items():
                out.extend((h, k, s + i, x, None) for h, i, x in regrouped(c, o, n, length))
            firsts.clear()

        for b in slices(batches, "text"):
            for k, v, t, at in zip(b.column("k").to_pylist(), b.column("v").to_pylist(), b.column("text").to_pylist(), b.column("at")):
                raw = t.encode("utf-8", "surrogatepass")
                if (k, v) == done:
                    continue
                done = (k, v)
                p, h, own = anchors(np.frombuffer(raw, np.uint8), length)
                edge = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
                wanted = at.values.to_numpy()
                to = np.searchsorted(p, wanted & _PLACE)
                ok = (to < len(p)) & (p[np.minimum(to, len(p) - 1)] == wanted & _PLACE)
                n = np.zeros(len(p), np.int64)
                n[to[ok]] = wanted[ok] >> 40
                for s, e in zip(edge[:-1], edge[1:]):
                    a = own[s]
                    if n[a] == 1:
                        out.append((int(h[a].view(np.int64)), k, (v << 40) | int(s), raw[s : e - 1 + length], None))
                    elif n[a]:
                        held += folded(int(h[a]), k, (v << 40) | int(s), raw[s : e - 1 + length], int(p[a] - s), int(n[a]))
            if held > batch:
                deal()
                held = 0
            yield from flush()
        deal()
        yield from flush()

    parts = first.join(per_doc.hint("merge"), ["k", "v"]).select("k", "v", "text", "at").mapInArrow(tidied(contexts), "h long, k long, s long, c binary, n long")
    parts = parts.repartition("h").sortWithinPartitions("h", "c", "k", "s")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches [a, b) of texts that are covered."""
        held: list[tuple[int, int, bytes]] = []
        group: list[tuple[int, int, bytes]] = []
        size, last_h, last_c, last_at = 0, None, None, None
        out: list[tuple[int, int, int]] = []

        def work() -> None:
            held.sort(key=lambda x: (x[0], x[1]))
            for (k, s, _), hit in zip(held, repeated([c for _, _, c in held], length)):
                if hit.any():
                    a, b = _stretches(np.flatnonzero(hit), length)
                    out.extend((k, s + int(x), int(y - x)) for x, y in zip(a, b))
            held.clear()

        def close() -> None:
            if len(group) > 1 or (group and len(group[0][2]) > length):  # a lone string has no earlier start
                held.extend(group)
            group.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["k", "p", "n"])
                out.clear()

        for b in batches:
            for h, k, s, c, n in zip(*(b.column(x).to_pylist() for x in ("h", "k", "s", "c", "n"))):
                if c is None:
                    out.append((k, s, n))
                    continue
                if h != last_h:
                    close()
                    if size > batch:
                        work()
                        size = 0
                    last_h, last_c = h, None
                if c == last_c:
                    if (k, s) != last_at:
                        out.append((k, s, len(c)))
                else:
                    group.append((k, s, c))
                    size += len(c)
                    last_c = c
                last_at = (k, s)
            yield from flush()
        close()
        if held:
            work()
        yield from flush()

    covered = parts.mapInArrow(tidied(judged), "k long, p long, n long")
    spans = covered.groupBy("k", F.shiftrightunsigned("p", 40).alias("v")).agg(F.collect_list(F.struct(F.col("p").bitwiseAND(_PLACE).alias("a"), "n")).alias("spans"))
    both = rows.join(copies.hint("merge"), ["k", "v"], "left").join(spans.hint("merge"), ["k", "v"], "left")

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for t, spans, copy in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), b.column("copy").to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                runs: list[list[int]] = [[0, len(raw)]] if copy else []
                for s in sorted(spans or [], key=lambda s: s["a"]) if not copy else ():
                    if runs and s["a"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["a"] + s["n"])
                    else:
                        runs.append([s["a"], s["a"] + s["n"]])
                rest, at = hashlib.sha256(), 0
                for x, y in runs:
                    rest.update(raw[at:x])
                    at = y
                rest.update(raw[at:])
                out.append((len(raw), sum(y - x for x, y in runs), len(runs), rest.hexdigest(), [{"start": x, "end": y} for x, y in runs]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(c, kind) for c, kind in zip(zip(*out), kinds))], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = both.select("k", "text", "spans", "copy").mapInArrow(tidied(left), "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    return out.select(F.when(F.col("k") != none, F.col("k").cast(kind)).alias(id_col), *out.columns[1:])
