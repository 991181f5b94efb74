"""Mixing sources to target weights with a low-discrepancy schedule.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the words of all documents; a target
stops at `cap` times its source's words and the excess goes to the others by weight. Slots 0, 1, 2, ... are mapped
by a golden-ratio sequence (i * K mod M, exact in 64-bit integers) through the cumulative targets to sources, so
every stretch of the schedule holds the sources in about the target shares. The slots of a source are ranked; the
rank-th slot takes the rank-th block of the source's shuffled documents, laid end to end and started again when
they are used up. All blocks of a source hold equally many words (target / slots, to a word), so a source's blocks
add up to its target exactly, and no document is taken more than `cap` times. Each document gets the first slot that
takes from it, its place in the mix, and how many stretches of slots take from it.

Ranks and word positions are prefix sums over two levels (buckets of a source, then rows of a bucket, about the
square root of all rows each), so no source is ever gathered in one task.

Defined results: a null text has size 0, is taken 0 times and has no slot; null sources form one source, which comes last;
repeated rows are separate documents of the same order key, and swapping them changes no result. An empty table
gives an empty result. Without any word all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: A prime and its golden section, for the low-discrepancy sequence.
M, K = 2147483647, 1327217885
SMALL = 10_000  # source tables of up to so many rows are broadcast


def source_key(source: Column) -> Column:
    """Orders and tells apart sources; a null source comes last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size, skey (orders sources, null last) and the md5 shuffle key."""
    source = F.col(f"`{source_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), source.alias("source"), words_of(F.col(f"`{text_col}`")).alias("size"), source_key(source).alias("skey"), F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).cast("binary")).alias("h"))


def targets(rows: DataFrame, cap: int = 3) -> DataFrame:
    """skey, source_size, target: one row a source, so its windows run over the sources only."""
    by = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("w", ((F.row_number().over(Window.orderBy("skey")) - 1) % 3 + 1).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "skey")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    by = by.withColumns({"left": total - F.coalesce(cap * F.sum("source_size").over(before), F.lit(0)), "weights": F.sum("w").over(rest)})
    by = by.withColumn("level", F.when(cap * F.col("source_size") / F.col("w") > F.col("left") / F.col("weights"), F.col("left") / F.col("weights")))
    level = F.min(F.struct(F.col("source_size") / F.col("w"), "skey", "level")).over(Window.partitionBy(F.col("level").isNull()))
    by = by.withColumn("at", F.max(F.when(F.col("level").isNotNull(), level["level"])).over(Window.partitionBy()))
    target = F.when(F.col("level").isNull(), (cap * F.col("source_size")).cast("double")).otherwise(F.col("at") * F.col("w"))
    return by.select("skey", "source_size", target.alias("target"))


def _ranked(rows: DataFrame, key: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Sum of value over the rows of the same key before each row in (bucket, order): two levels of prefix sums."""
    inner = Window.partitionBy(*key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, bucket).agg(F.sum(value).alias("s_"))
    ahead = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, bucket, F.coalesce(F.sum("s_").over(ahead), F.lit(0)).alias("ahead_"))
    rows = rows.withColumn("own_", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(sums, [*key, bucket]).withColumn(name, F.col("ahead_") + F.col("own_")).drop("ahead_", "own_", bucket)


def schedule(shares: DataFrame, n_slots: int, small: bool) -> DataFrame:
    """slot, skey, rank, n_slots_of_source, begin, end: the words of the source's endless line that each slot takes."""
    spark = shares.sparkSession
    total = F.sum("target").over(Window.partitionBy())
    upto = F.sum("target").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0))
    ends = shares.where("target >= 1").select("skey", "target", F.round(upto / total * M).cast("long").alias("hi"))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("skey")), F.lit(0)))
    cells = 1024
    width = M // cells + 1
    spans = ends.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    # each source has at least one slot of its own besides, at the end, for targets too small to be hit
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id") % M) * K % M).alias("y"))
    slots = slots.withColumn("cell", F.floor(F.col("y") / width))
    hit = slots.join(F.broadcast(spans) if small else spans, "cell").where("y >= lo and y < hi").select("slot", "skey")
    hit = hit.unionByName(ends.select(F.lit(n_slots).cast("long").alias("slot"), "skey"))
    step = max(1, int(n_slots**0.5))
    ranked = _ranked(hit.withColumn("b", F.floor(F.col("slot") / step)), ["skey"], "b", ["slot"], F.lit(1), "rank")
    count = hit.groupBy("skey").agg(F.count("*").alias("n"))
    totals = ends.select("skey", F.floor("target").alias("t")).join(count, "skey")
    out = ranked.join(F.broadcast(totals) if small else totals, "skey")
    at = lambda r: F.floor(r * (F.col("t").cast("decimal(38,0)")) / F.col("n")).cast("long")
    return out.select("slot", "skey", "rank", "n", at(F.col("rank")).alias("begin"), at(F.col("rank") + 1).alias("end"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, block_words: int = 1024, keyed: bool = False) -> DataFrame:
    """id, size, source_size, target, taken: how many of each document's words the mix takes, repeats counted.

    And first_slot (null where nothing is taken) and n_takes, the stretches of slots (a new one where the source's
    documents start again) that take words from the document. keyed: and skey, which tells sources apart (see source_key),
    and lap_slots, how many slots of the schedule it takes on average until the source's documents start again.
    """
    rows = stored(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    n, words, n_sources = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.countDistinct("skey")).first()
    small = n_sources <= SMALL
    shares = stored(targets(rows, cap), "mix-targets")
    by_source = F.broadcast(shares) if small else shares
    slots = schedule(shares, words // block_words + 1, small)
    nb = max(1, int(n**0.5))
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / float(1 << 32) * nb)
    placed = _ranked(rows.withColumn("b", bucket), ["skey"], "b", ["h", "id", "size"], F.col("size"), "a")
    placed = stored(placed, "mix-placed")
    # a slot's stretch of the endless line, cut where the source's documents start again
    laps = slots.join(by_source.select("skey", "source_size"), "skey").where("end > begin")
    laps = laps.withColumn("lap", F.explode(F.sequence(F.floor(F.col("begin") / F.col("source_size")), F.floor((F.col("end") - 1) / F.col("source_size")))))
    base = F.col("lap") * F.col("source_size")
    pieces = laps.select("skey", "slot", F.greatest(F.col("begin") - base, F.lit(0)).alias("p"), F.least(F.col("end") - base, F.col("source_size")).alias("q"))
    cell = lambda a, b: F.explode(F.sequence(F.floor(a / block_words), F.floor((b - 1) / block_words)))
    pieces = pieces.withColumn("cell", cell(F.col("p"), F.col("q")))
    spread = placed.where("size > 0").select("skey", "id", "h", "size", "a", (F.col("a") + F.col("size")).alias("z")).withColumn("cell", cell(F.col("a"), F.col("z")))
    both = spread.join(pieces, ["skey", "cell"])
    lo, hi = F.col("cell") * block_words, (F.col("cell") + 1) * block_words
    overlap = F.greatest(F.least("z", "q", hi) - F.greatest("a", "p", lo), F.lit(0))
    begins = (overlap > 0) & (F.greatest("a", "p") >= lo)  # a stretch counts in the cell where it meets the document first
    taken = both.groupBy("skey", "a", "size").agg(F.sum(overlap).alias("taken"), F.min(F.when(overlap > 0, F.col("slot"))).alias("first_slot"), F.count_if(begins).alias("n_takes"))
    out = placed.join(taken, ["skey", "a", "size"], "left").join(by_source, "skey")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_takes", F.lit(0)).alias("n_takes"), *(["skey", (F.col("source_size") / F.col("target") * (words // block_words + 1)).alias("lap_slots")] if keyed else []))
