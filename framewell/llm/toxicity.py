"""Toxicity by class-conditional Kneser-Ney models.

Words (lower-cased A-Z, runs without ASCII white space) of all labelled training texts are cut to bigrams, and
Spark counts the bigrams of each class. A class's model interpolates two levels. Its bigram counts are discounted by one,
two or three steps (for counts of 1, 2 and more), each estimated from the class's counts of counts, and what a word's
history frees goes to the continuation level. There a word's count is how many different words it follows in the class,
so an expression counts by its contexts and not by its copies; these counts are discounted likewise, and the freed mass
goes to the continuation counts that both classes share: a rare expression reads much the same under both. A text's
evidence compares its length-normalised log-likelihoods under the toxic and the ordinary model, over all its words. It is
the sum of what the levels say: the continuation level of each word, the mass that each word's history frees for that
level, and what a bigram that a class has seen adds. These go to a logistic curve, which turns them into a score, as
separate sums: words by how far their continuation levels differ (up to 1.5 nats, up to 2.5, more), words that no learning
text has, histories and bigrams. Small differences tell language and topic, and bigrams which class has more texts, so
the curve learns what each sum is worth from labelled texts that the counts have not seen. No word counts as nothing.

The counts cover every labelled training row and stay exact, one row a word (64-bit hash) in a table that grows with
the input, as are those of bigrams and of histories. What a word, a history or a bigram says is a row of one table, of
which scoring tasks hold the `HEAD` rows that learning texts have most often. Others are joined to the texts; a table of
marks, 2**26 bits at most, lets tasks leave out most that no learning text has, which say nothing. It changes
no result; past some ten million rows it lets more others through, all distinct ones of a text at most. Evidence is summed
in whole millionths of a nat. Texts are scored in `ROUNDS` parts if the table is large, so that no more of them is
shuffled at once. The curve is fitted on about `calibration_rows` rows.

Folds (crc32 of the id as text, mod 4): 0 and 1 are counted, 3 fits the curve, 2 is held out from all learning.

Defined results: a text without words scores as the share of toxic rows among the training labels, at most just
below the threshold. Ids that are null or have no label are scored but never learned from (held_out is false for a null
id); several labels of one id are each learned from. Without labels of both classes every text scores 0. Every row of
the input gives one output row, rows that share an id too; an empty table gives an empty result; other input columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import fold_of, held_out, marked, released, slices, stored_alone, tidied

_U = np.uint64
HEAD = 1 << 20
ROUNDS = 6
BANDS = (1.5, 2.5)
#: The parts of evidence: words by band, words that learning texts have (how many), histories, bigrams.
SEEN, HISTORY, BIGRAM = len(BANDS) + 1, len(BANDS) + 2, len(BANDS) + 3
PARTS = BIGRAM + 1
_HISTORY, _BIGRAM = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit word codes, the word before each (0 at a text's start) and the text of each word."""
    data, offsets = tx.packed(texts)
    data = tx.LOWER[data]
    starts, ends = tx.words(data)
    first, owner = tx.per_text(starts, offsets)
    w = tx.word_hashes(data, starts, ends)
    u = np.concatenate([np.zeros(1, np.uint64), w[:-1]]) if len(w) else w.copy()
    u[first[:-1][first[:-1] < len(w)]] = 0
    return w, u, owner


def _keys(w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words, of their histories and of both, as word, history and bigram have them in the table of evidence."""
    return w, u ^ _U(_HISTORY), w ^ ((u << _U(23)) | (u >> _U(41))) ^ _U(_BIGRAM)


def _bigram_key(prev: Column, word: Column) -> Column:
    return word.bitwiseXOR(F.shiftleft(prev, 23).bitwiseOR(F.shiftrightunsigned(prev, 41))).bitwiseXOR(F.lit(_BIGRAM))


def _bigrams(rows: DataFrame) -> DataFrame:
    """prev, word, a, b: how often a word follows another in ordinary and in toxic texts (prev is 0 at a text's start)."""
    import pyarrow as pa

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 32 << 20):
            w, u, owner = _codes(b.column("text").to_pylist())
            if not len(w):
                continue
            toxic = np.asarray(b.column("toxic").to_pylist(), bool)[owner]
            order = np.lexsort((u, w))
            w, u, toxic = w[order], u[order], toxic[order].astype(np.int64)
            new = np.flatnonzero(np.concatenate([np.ones(1, bool), (w[1:] != w[:-1]) | (u[1:] != u[:-1])]))
            bad, every = np.add.reduceat(toxic, new), np.diff(np.append(new, len(w)))
            yield pa.RecordBatch.from_arrays([pa.array(u[new].view(np.int64)), pa.array(w[new].view(np.int64)), pa.array(every - bad), pa.array(bad)], ["prev", "word", "a", "b"])

    return rows.mapInArrow(tidied(counted), "prev long, word long, a long, b long").groupBy("prev", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _continued(bigrams: DataFrame) -> DataFrame:
    return bigrams.groupBy("word").agg(F.count_if(F.col("a") > 0).alias("a"), F.count_if(F.col("b") > 0).alias("b"))


def _continuations(rows: DataFrame) -> DataFrame:
    """word, a, b: how many different words a word follows in ordinary and in toxic texts."""
    return _continued(_bigrams(rows))


def _histories(bigrams: DataFrame) -> DataFrame:
    """prev and, for each class, the words after it (a, b) and how many differ there with counts of 1, 2 and more (a1, ...)."""
    count = lambda c, k: F.count_if(F.col(c) >= 3 if k == 3 else F.col(c) == k).alias(f"{c}{k}")
    return bigrams.groupBy("prev").agg(*(F.sum(c).alias(c) for c in "ab"), *(count(c, k) for c in "ab" for k in (1, 2, 3)))


def _bigram_discounts(bigrams: DataFrame) -> dict[str, tuple[float, float, float]]:
    some = bigrams.agg(*(F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in "ab" for k in (1, 2, 3, 4))).first()
    return {c: discounts(*(some[f"{c}{k}"] for k in (1, 2, 3, 4))) for c in "ab"}


def _freed(c: str, lost: dict[str, tuple[float, float, float]], of: str = "") -> Column:
    """The counts that a history of a class frees for the continuation level."""
    return sum((F.lit(d) * F.col(f"{of}{c}{k}") for k, d in zip((1, 2, 3), lost[c])), F.lit(0.0))


def _billionths(b: Column, a: Column) -> Column:
    """log(b / a) in whole billionths; null where either is not above 0."""
    return F.when((a > 0) & (b > 0), F.round((F.log(b) - F.log(a)) * 1e9).cast("long"))


def _full(lost: dict[str, tuple[float, float, float]], low: dict[str, Column], r: Column) -> Column:
    """The evidence of both levels, from a bigram's counts (a, b), its history's (h_a, ...) and the continuation level (low, r).

    A history that a class doesn't have leaves the word to the continuation level, as does one that leaves it nothing.
    """
    p = {}
    for c in "ab":
        n, own = F.col(f"h_{c}"), F.coalesce(F.col(c) - _discount(F.col(c), lost[c]), F.lit(0.0))
        p[c] = F.when(n > 0, (own + _freed(c, lost, "h_") * low[c]) / n).otherwise(low[c])
    return F.coalesce(_billionths(p["b"], p["a"]), r)


def _held(histories: DataFrame) -> DataFrame:
    return histories.select("prev", *(F.col(c).alias(f"h_{c}") for c in histories.columns if c != "prev"))


def _interpolated(pairs: DataFrame, bigrams: DataFrame, histories: DataFrame, lost: dict[str, tuple[float, float, float]]) -> DataFrame:
    """The columns of pairs (prev, word, r, pa, pb and others) and full, the evidence of both levels in billionths of a nat (see _full)."""
    rows = pairs.join(bigrams.hint("merge"), ["prev", "word"], "left").join(_held(histories).hint("merge"), "prev", "left")
    return rows.select(*pairs.columns, _full(lost, {c: F.col(f"p{c}") for c in "ab"}, F.col("r")).alias("full"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What counts of 1, 2 and 3 or more lose, from how many words have counts of 1 to 4 (at least one each)."""
    n1, n2, n3, n4 = (max(n, 1) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discount(count: Column, d: tuple[float, float, float]) -> Column:
    return F.when(count == 0, 0.0).when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


class _Continuation:
    """The continuation levels of both classes, from the counts of all words (word, a, b)."""

    def __init__(self, words: DataFrame):
        some = words.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "ab"), *(F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in "ab" for k in (0, 1, 2, 3, 4))).first()
        self.total, self.n, self.lost, self.freed = {c: some[c] for c in "ab"}, some["n"], {}, {}
        for c in "ab":
            self.lost[c] = discounts(*(some[f"{c}{k}"] for k in (1, 2, 3, 4)))
            of = [some[f"{c}{k}"] for k in (1, 2)]
            self.freed[c] = sum(d * k for d, k in zip(self.lost[c], (*of, some["n"] - some[f"{c}0"] - sum(of))))

    def both(self) -> bool:
        return bool(self.total["a"] and self.total["b"])

    def p(self, a: Column, b: Column) -> dict[str, Column]:
        """A word's probability in each class, by its counts."""
        shared = (a + b + 0.5) / F.lit(sum(self.total.values()) + 0.5 * (self.n + 1))
        return {c: (x - _discount(x, self.lost[c]) + F.lit(self.freed[c]) * shared) / F.lit(float(self.total[c])) for c, x in (("a", a), ("b", b))}

    def r(self, a: Column, b: Column) -> Column:
        """By how many billionths of a nat the toxic model likes a word more; 0 where a model leaves it nothing."""
        p = self.p(a, b)
        return F.coalesce(_billionths(p["b"], p["a"]), F.lit(0).cast("long"))


def _evidence(words: DataFrame, least: float = 0.0) -> DataFrame | None:
    """word, r: by how many billionths of a nat the toxic model likes a word more (where that is `least` nats or more); pa, pb: its probabilities.

    This is the continuation level, without the word before.
    """
    level = _Continuation(words)
    if not level.both():
        return None
    a, b = F.col("a"), F.col("b")
    out = words.select("word", level.r(a, b).alias("r"), *(p.alias(f"p{c}") for c, p in level.p(a, b).items()))
    return out.where(F.abs("r") >= F.lit(round(least * 1e9))) if least else out


def _millionths(r: Column) -> Column:
    return F.round(r / 1000).cast("int").alias("value")


def _table(bigrams: DataFrame, counts: DataFrame, level: _Continuation) -> tuple[DataFrame, int, int]:
    """What each word, history and bigram of the learning texts says: key, part, value (millionths of a nat), n (how often it is there).

    And how many rows it has, and what a word says that none of these texts has. A word's history and a bigram that no
    text has say nothing: there both classes have the continuation level alone, or the mass that the history frees for it.
    """
    histories, lost = stored_alone(_histories(bigrams), "toxic-histories"), _bigram_discounts(bigrams)
    a, b = F.col("a"), F.col("b")
    r = level.r(a, b)
    band = sum((F.when(F.abs(r) > F.lit(round(x * 1e9)), 1).otherwise(0) for x in BANDS), F.lit(0))
    words = counts.select(F.col("word").alias("key"), band.cast("byte").alias("part"), _millionths(r), (a + b).alias("n"))
    # a history that a class does not have frees all
    left = {c: F.when(F.col(f"h_{c}") > 0, _freed(c, lost, "h_") / F.col(f"h_{c}")).otherwise(1.0) for c in "ab"}
    g = F.coalesce(_billionths(left["b"], left["a"]), F.lit(0).cast("long"))
    held = _held(histories)
    prevs = held.select(F.col("prev").bitwiseXOR(F.lit(_HISTORY)).alias("key"), F.lit(HISTORY).cast("byte").alias("part"), _millionths(g), (F.col("h_a") + F.col("h_b")).alias("n"))
    # the counts of words go along and not what is made of them, which is wider
    found = stored_alone(bigrams.join(counts.select("word", F.col("a").alias("ca"), F.col("b").alias("cb")).hint("merge"), "word"), "toxic-found")
    released(bigrams)
    ca, cb = F.col("ca"), F.col("cb")
    adds = _full(lost, level.p(ca, cb), level.r(ca, cb)) - level.r(ca, cb) - g
    pairs = found.join(held.hint("merge"), "prev").select(_bigram_key(F.col("prev"), F.col("word")).alias("key"), F.lit(BIGRAM).cast("byte").alias("part"), _millionths(adds), (a + b).alias("n"))
    table = stored_alone(words.unionByName(prevs).unionByName(pairs), "toxic-evidence")
    released(found, histories, counts)
    new = table.sparkSession.range(1).select(_millionths(level.r(F.lit(0), F.lit(0)))).first()[0]
    return table, table.count(), new


def _head(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of the table that are most often there, `HEAD` at most: keys in order, parts and values, and where the keys of each beginning start."""
    most = 1 << 20
    sizes = table.groupBy(F.least("n", F.lit(most)).alias("n")).count().toArrow()  # a row for each n, as many as there are different ones
    n, count = (sizes.column(c).to_numpy() for c in ("n", "count"))
    order = np.argsort(-n)
    within = np.cumsum(count[order]) <= HEAD
    least = int(n[order][within].min()) if within.any() else 1 << 62
    rows = table.where(F.col("n") >= least).select("key", "part", "value").toArrow()
    keys, parts, values = (rows.column(c).to_numpy() for c in ("key", "part", "value"))
    order = np.argsort(keys.view(np.uint64))
    keys = keys.view(np.uint64)[order]
    starts = np.searchsorted(keys, np.arange(1 << 19, dtype=np.uint64) << _U(45))
    # one row more, which no key finds, so that every start is a place
    return np.append(keys, _U(0)), np.append(parts[order], np.int8(-1)), np.append(values[order], 0), np.append(starts, len(keys)).astype(np.int32)


def _found(head: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key in the head, and whether it is there."""
    known, _, _, starts = head
    cell = (keys >> _U(45)).astype(np.int64)
    at, end = starts[cell], starts[cell + 1]
    hit = (known[at] == keys) & (at < end)
    left = np.flatnonzero(~hit & (at + 1 < end))
    while len(left):
        at[left] += 1
        hit[left] = known[at[left]] == keys[left]
        left = left[~hit[left] & (at[left] + 1 < end[left])]
    return at, hit


def _marks(table: DataFrame, bits: int) -> np.ndarray:
    """Packed marks, one for the first `bits` bits of each key: 2048 rows of 4 kB at most."""
    slot = F.shiftrightunsigned("key", 64 - bits)
    drawers = table.select((F.floor(slot / 32768)).alias("drawer"), (slot % 32768).alias("place")).groupBy("drawer").agg(F.bitmap_construct_agg("place").alias("bits"))
    out = np.zeros(max(1, (1 << bits) >> 15) * 4096, np.uint8)
    for drawer, packed in zip(*(c.to_pylist() for c in drawers.toArrow().columns)):
        out[drawer * 4096 : drawer * 4096 + 4096] = np.frombuffer(packed, np.uint8)
    return out


def _parts(docs: DataFrame, table: DataFrame, head, marks, filter_bits: int) -> DataFrame:
    """id, n_words and s0, s1, ...: the sums of each part of the evidence of a text, and of the words that learning texts have.

    docs: id and text. Tasks sum up what the head says; the other keys that the marks let through are joined to the table.
    """
    import pyarrow as pa

    def known(keys: np.ndarray) -> np.ndarray:
        at = (keys >> _U(64 - filter_bits)).astype(np.int64)
        return np.flatnonzero((marks.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, parts, values, _ = head.value
        for b in slices(batches, "text", 2 << 20):
            w, u, owner = _codes(b.column("text").to_pylist())
            edges = np.searchsorted(owner, np.arange(b.num_rows + 1))
            total = lambda v: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(v, dtype=np.int64)])[edges])  # noqa: E731, B023
            sums, rest = np.zeros((PARTS + 1, b.num_rows), np.int64), []
            sums[PARTS] = np.diff(edges)
            for kind, key in zip((0, HISTORY, BIGRAM), _keys(w, u)):
                at, hit = _found(head.value, key)
                says = np.where(hit, values[at], 0)
                if kind:
                    sums[kind] = total(says)
                else:
                    for k in range(SEEN):
                        sums[k] = total(np.where(parts[at] == k, says, 0))
                    sums[SEEN] = total(hit)
                left = np.flatnonzero(~hit)
                left = left[known(key[left])]
                rest.append((owner[left], key[left]))
            owner, key = (np.concatenate(x) for x in zip(*rest))
            order = np.lexsort((key, owner))
            owner, key = owner[order], key[order]
            new = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
            times = np.diff(np.append(new, len(key)))
            row, n = b.column("row"), len(new)
            yield pa.RecordBatch.from_arrays([row.take(pa.array(owner[new])), pa.array(key[new].view(np.int64)), pa.nulls(n, pa.int8()), pa.array(times.astype(np.int64)), pa.nulls(n, b.column("id").type)], names)
            # a text's own rows, one a sum, lie anywhere: their part is given, so the table adds nothing to them
            own, k = np.tile(np.arange(b.num_rows), PARTS + 1), np.repeat(np.arange(PARTS + 1), b.num_rows)
            junk = tx.mix(row.to_numpy().astype(np.uint64)[own] + k.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([row.take(pa.array(own)), pa.array(junk), pa.array(k.astype(np.int8)), pa.array(sums.reshape(-1)), b.column("id").take(pa.array(own))], names)

    names = ["row", "key", "own", "times", "id"]
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text").mapInArrow(tidied(found), f"row long, key long, own byte, times long, id {docs.schema['id'].dataType.simpleString()}")
    both = rows.join(table.select("key", "part", "value").hint("merge"), "key", "left").where("own is not null or part is not null")
    part = F.coalesce("own", "part").alias("at")
    both = both.select("row", "id", "own", part, F.when(F.col("own").isNull(), F.col("times") * F.col("value").cast("long")).otherwise(F.col("times")).alias("v"), F.when(F.col("own").isNull() & (F.col("part") < SEEN), F.col("times")).otherwise(0).alias("seen"))
    of = lambda k: F.sum(F.when(F.col("at") == k, F.col("v")).otherwise(0))
    sums = [((of(k) + F.sum("seen")) if k == SEEN else of(k)).alias(f"s{k}") for k in range(PARTS)]
    return both.groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), of(PARTS).alias("n_words"), *sums).drop("row")


def _features(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the curve reads: evidence a word, and the same against its spread over so many words."""
    return np.concatenate([x, x * np.sqrt(n)[:, None]], 1)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, spread and weights (offset last) of a logistic curve, by Newton steps with a little ridge."""
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.concatenate([(x - centre) / spread, np.ones((len(x), 1))], 1)
    ridge = np.diag([0.1] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return centre, spread, w


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, filter_bits: int | None = None, calibration_rows: int = 20000) -> DataFrame:
    """id, held_out, score, predicted and the evidence (log_ratio) for each document."""
    spark = docs.sparkSession
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and text is not null")
    labelled = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    fold = fold_of(F.col("id"))
    counted = labelled.where(fold.isin(0, 1))
    # texts without a label are left out before the rest meets the labels; both grow with the input, so both are dealt out
    learned = marked(known.where(fold.isin(0, 1)), counted).join(counted.hint("merge"), "id")
    bigrams = stored_alone(_bigrams(learned.select("text", "toxic")), "toxic-bigrams")
    counts = stored_alone(_continued(bigrams), "toxic-counts")
    level = _Continuation(counts)
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    score, base = F.lit(0.0), 0.0
    if level.both():
        table, rows, new = _table(bigrams, counts, level)
        if filter_bits is None:
            filter_bits = min(26, max(16, (16 * rows).bit_length()))
        head, marks = (spark.sparkContext.broadcast(x) for x in (_head(table), _marks(table, filter_bits)))
        rounds = min(ROUNDS, 1 + (rows >> 20))
        part = F.pmod(F.xxhash64("id", "text"), F.lit(rounds))
        done = [stored_alone(_parts(out.where(part == k) if rounds > 1 else out, table, head, marks, filter_bits), "toxic-parts") for k in range(rounds)]
        out = reduce(DataFrame.unionByName, done)
        said = [(F.col("n_words") - F.col("s%d" % k)) * F.lit(new) if k == SEEN else F.col(f"s{k}") for k in range(PARTS)]
        each = [(x / 1e6 / F.greatest("n_words", F.lit(1))).alias(f"x{k}") for k, x in enumerate(said)]
        out = out.select("id", "n_words", *each)
        share = min(1.0, calibration_rows / max(labelled.where(fold == 3).count(), 1))
        # about calibration_rows ids at any size of the input, so they can go to every task
        chosen = labelled.where((fold == 3) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)))
        seen = out.where("id is not null and n_words > 0").join(F.broadcast(chosen), "id").toArrow()
        y, n = (seen.column(c).to_numpy() for c in ("toxic", "n_words"))
        x = np.stack([seen.column(f"x{k}").to_numpy() for k in range(PARTS)], 1)
        order = np.lexsort((y, n, *x.T))
        x, y, n = x[order], y[order].astype(np.float64), n[order]
        curve = (np.zeros(2 * PARTS), np.ones(2 * PARTS), np.array([1.0] * PARTS + [0.0] * (PARTS + 1)))
        if len(y) and 0 < y.mean() < 1:
            curve, base = _curve(_features(x, n), y), float(y.mean())
        centre, spread, w = ([float(v) for v in part] for part in curve)
        read = [F.col(f"x{k}") for k in range(PARTS)] + [F.col(f"x{k}") * F.sqrt("n_words") for k in range(PARTS)]
        z = sum((a * (f - c) / s for a, f, c, s in zip(w, read, centre, spread)), F.lit(w[-1]))
        score = F.when(F.col("n_words") == 0, min(base, threshold * 0.99)).otherwise(1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
        out = out.withColumn("log_ratio", sum((F.col(f"x{k}") for k in range(PARTS)), F.lit(0.0)))
    else:
        out = out.select("id", F.lit(0.0).alias("log_ratio"))
    out = out.withColumn("score", score)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "log_ratio")
