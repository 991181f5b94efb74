"""Corpus pipeline over the documents table: language, lines, near-duplicates, source mix, pieces.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents
(of any others, whatever their names, too); the last one returns the piece ids. run() applies them to the table.

Defined results of all stages: nulls in any column are allowed, and an empty table gives an empty one. Rows that share
an id are documents of their own, but in the minhash stage, where they are one document with all their texts: they stay
or go together. Repeated rows are each kept or dropped in the same way; in the mix, equal rows share their source's
words in an order that cannot be told from any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewell.llm.common import WORD, carried, documents, restored
from framewell.llm.langid import identify_language
from framewell.llm.linededup import line_dedup
from framewell.llm.mixing import mix_sources, source_key, words_of
from framewell.llm.neardup import near_duplicates
from framewell.llm.pieces import encode


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; rejected ones, null and empty texts among them, go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "lang")]
    named = docs.select(carried(rest), "doc_id", "text", "lang")
    kept = identify_language(named, carry=["text", "lang", "row"]).where(~F.col("rejected"))
    columns = {c: F.col(c) for c in ("doc_id", "text", "lang")} | dict(zip(rest, restored(rest)))
    return kept.select(*(columns[c] for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occur earlier; one whose every line goes is left out, an empty text stays."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = line_dedup(docs.select(carried(rest), "doc_id", "text")).where((F.col("n_removed_lines") == 0) | (words_of(F.col("text")) > 0))
    cut = F.col("n_removed_lines") > 0
    columns = {c: F.col(c) for c in docs.columns} | dict(zip(rest, restored(rest)))
    columns |= {"n_chars": F.when(cut, F.length("text").cast("long")).otherwise(columns["n_chars"]).alias("n_chars")}
    return left.select(*(columns[c] for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; null ids and empty texts stay."""
    dropped = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the mix's slots, so that any stretch of the result holds
    the sources in about their target shares; the one at which a source's last lap ends is cut after its taken words.

    Texts without a word have nothing to take and go. Rows of one source, id and size take what the mix gives to them in
    the order of their texts' hashes, so no words are given twice.
    """
    key = ["pid", "skey", "size"]
    pid = F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("id")).alias("pid")
    takes = mix_sources(docs, keyed=True).where("taken > 0").select(pid, "skey", "size", "taken", "first_slot", "lap_slots")
    takes = takes.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("taken", "first_slot", "lap_slots")), asc=False).alias("takes"))
    rest = [c for c in docs.columns if c != "text"]
    sized = docs.select(carried(rest), pid, source_key(F.col("source")).alias("skey"), words_of(F.col("text")).alias("size"), "text")
    both = sized.join(takes, key).withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"))))
    both = both.withColumn("take", F.get("takes", F.col("k") - 1)).withColumn("taken", F.col("take.taken")).where("taken > 0")
    both = both.withColumn("laps", F.expr("taken div size")).withColumn("rest", F.col("taken") % F.col("size"))
    copies = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("laps") + (F.col("rest") > 0).cast("long"))))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("rest").cast("int")), " ")
    copies = copies.withColumn("whole", F.col("copy") <= F.col("laps")).withColumn("text", F.when(F.col("whole"), F.col("text")).otherwise(part))
    columns = {"text": F.col("text")} | dict(zip(rest, restored(rest)))
    columns |= {"n_chars": F.when(F.col("whole"), columns["n_chars"]).otherwise(F.length("text").cast("long")).alias("n_chars")}
    slot = F.col("take.first_slot") + (F.col("copy") - 1) * F.col("take.lap_slots")
    ordered = copies.select(*(columns[c] for c in docs.columns), slot.alias(" slot")).repartitionByRange(F.col("` slot`")).sortWithinPartitions(F.col("` slot`"))
    return ordered.drop(" slot")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document of the mix, and whether they decode to its text; a null text has null ids."""
    spelled = encode(docs.select("doc_id", "lang", "source", "text"), check=True)
    return spelled.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "lossless")


STAGES = [("language", language), ("line_dedup", lines), ("minhash", near), ("mixing", mix), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for _, stage in STAGES:
        out = stage(spark, out, sf_dir)
    return out
