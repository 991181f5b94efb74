"""Line dedup by winnowing over line hashes, as DataFrame expressions only.

A text is cut at newlines; its units are the lines with a word, each with the blank lines after it. From each unit
the shortest run of units with at least `min_words` words forms a window, forwards and backwards. Winnowing keeps of
each window the place of its smallest line hash: two equal runs of `min_words` words share a whole window and so,
guaranteed, this fingerprint. Only the fingerprints, a place each, are joined. Around the places of those that occur
twice or more the match is extended both ways, over every window that the place is the minimum of: windows that are
equal (128-bit hash of their lines) continue the match, and each that also occurs earlier is deleted. Overlapping
windows are joined to maximal runs; they cover each repeated run of at least `min_words` words completely, so the
operator deletes exactly: every unit in a run of units, `min_words` words or more, that equals a run earlier in the
table (smaller id, or earlier in the same text). Runs are judged on the input, not on what is left.

Work and rows are linear in the lines of a text (each looks at `min_words` neighbours at most). Line hashes are read
from a stored table; texts are shuffled once, to be cut. A fingerprint or window that is everywhere is reduced to its
first and last occurrence before the shuffle; the join that gives it back is split by adaptive skew handling, as its
other side holds one row a key.

Defined results: null ids come before all others. Rows with the same id and the same text count as one document
and get the same result; rows with the same id and different texts are ordered by a hash of the text. A null text
stays null and an empty one empty. Blank lines before the first unit are kept. An empty table gives an empty result.
All input columns are returned, whatever their names, with n_lines and n_removed_lines; input columns of these two
names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carried, released, restored, stored


def _units(docs: DataFrame, min_words: int) -> DataFrame:
    """pid, th, n (lines), u (line number, words and two hashes of each unit) and wins: start, n and at of each window.

    start and at, the place of the smallest hash, count units.
    """
    line = lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(WORD)).alias("w"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit("b"), x).alias("g"))
    lines = docs.select("pid", "th", F.size("lines").alias("n"), F.filter(F.transform("lines", line), lambda u: u["w"] > 0).alias("u"))

    def run(units: Column, sign: int, i: Column) -> Column:
        """Words, units, smallest hash and its place of the shortest run with enough words."""
        zero = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("fp"), F.lit(0).alias("at"))
        less = lambda s, x: s["fp"].isNull() | (x["h"] < s["fp"])
        step = lambda s, x: F.struct((s["w"] + x["w"]).alias("w"), (s["n"] + 1).alias("n"), F.when(less(s, x), x["h"]).otherwise(s["fp"]).alias("fp"), F.when(less(s, x), i + sign * s["n"]).otherwise(s["at"]).alias("at"))
        return F.reduce(units, zero, lambda s, x: F.when(s["w"] >= min_words, s).otherwise(step(s, x)))

    def ahead(x: Column, i: Column) -> Column:
        r = run(F.slice("u", i + 1, F.when(x["w"] >= min_words, F.lit(1)).otherwise(F.lit(min_words))), 1, i)
        return F.get(F.transform(F.array(r), lambda r: F.struct(r["w"].alias("w"), i.alias("start"), r["n"].alias("n"), r["at"].alias("at"))), F.lit(0))

    def behind(x: Column, i: Column) -> Column:
        length = F.least(i + 1, F.lit(min_words))
        r = F.when(x["w"] < min_words, run(F.reverse(F.slice("u", i + 2 - length, length)), -1, i))
        return F.get(F.transform(F.array(r), lambda r: F.struct(r["w"].alias("w"), (i - r["n"] + 1).alias("start"), r["n"].alias("n"), r["at"].alias("at"))), F.lit(0))

    made = F.filter(F.concat(F.transform("u", ahead), F.transform("u", behind)), lambda w: w["w"] >= min_words)
    return lines.select("pid", "th", "n", "u", F.transform(made, lambda w: F.struct(w["start"].alias("start"), w["n"].alias("n"), w["at"].alias("at"))).alias("wins"))


def _fingerprints(units: DataFrame) -> DataFrame:
    """pid, th, at, fp: the places that are the minimum of a window, once each."""
    places = F.array_distinct(F.transform("wins", lambda w: w["at"]))
    marks = F.transform(places, lambda a: F.struct(a.alias("at"), F.get(F.col("u"), a)["h"].alias("fp")))
    return units.select("pid", "th", F.explode(marks).alias("x")).select("pid", "th", "x.at", "x.fp")


def _windows(units: DataFrame) -> DataFrame:
    """pid, th, h1, h2, start, first, last: windows around the places `ats`; first and last count lines."""
    part = lambda w: F.slice("u", w["start"] + 1, w["n"])
    unit = lambda k: F.get(F.col("u"), k)["i"]
    end = lambda w: w["start"] + w["n"]
    last = lambda w: F.when(end(w) < F.size("u"), unit(end(w)) - 1).otherwise(F.col("n") - 1)
    window = lambda w: F.struct(F.xxhash64(F.transform(part(w), lambda x: x["h"])).alias("h1"), F.xxhash64(F.lit("b"), F.transform(part(w), lambda x: x["g"])).alias("h2"), w["start"].alias("start"), unit(w["start"]).alias("first"), last(w).alias("last"))
    near = F.filter("wins", lambda w: F.array_contains("ats", w["at"]))
    return units.select("pid", "th", F.explode(F.transform(near, window)).alias("x")).select("pid", "th", "x.*")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """The documents without their repeated runs of lines (see the module's text)."""
    text = F.col(f"`{text_col}`").cast("string")
    kept_cols = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    other = [c for c in kept_cols if c != text_col]
    whole = docs.select(carried(other), text.alias("text"), F.struct(F.col(f"`{id_col}`").isNotNull().alias("n"), F.col(f"`{id_col}`").alias("id")).alias("pid"), F.xxhash64(text).alias("th"))
    units = stored(_units(whole.where("text is not null").select("pid", "th", F.split("text", "\n").alias("lines")), min_words), "line-units")
    marks = _fingerprints(units)
    at = F.struct("pid", "th", "at")
    shared = marks.groupBy("fp").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a != b").select("fp")
    places = marks.join(shared.hint("merge"), "fp", "left_semi").groupBy("pid", "th").agg(F.collect_set("at").alias("ats"))
    windows = stored(_windows(units.join(places.hint("merge"), ["pid", "th"])), "line-windows")
    start = F.struct("pid", "th", "start")
    earliest = windows.groupBy("h1", "h2").agg(F.min(start).alias("a"), F.max(start).alias("b")).where("a != b").select("h1", "h2", "a")
    later = windows.join(earliest.hint("merge"), ["h1", "h2"]).where(start != F.col("a")).select("pid", "th", "first", "last").distinct()
    mine = Window.partitionBy("pid", "th").orderBy("first", "last")
    reach = F.max("last").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("first") > reach + 1)).cast("int")
    runs = later.withColumn("new", new).withColumn("run", F.sum("new").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("pid", "th", "run").agg(F.min("first").alias("p"), F.max("last").alias("q"))
    cuts = stored(runs.groupBy("pid", "th").agg(F.sort_array(F.collect_list(F.struct("p", "q"))).alias("cuts")), "line-cuts")
    released(units, windows)
    both = whole.join(cuts.hint("merge"), ["pid", "th"], "left")
    return both.select(*_result(kept_cols, other, text_col))


def _result(kept_cols: list[str], other: list[str], text_col: str) -> list[Column]:
    lines = F.split("text", "\n")
    c = F.col("cuts")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count(F.col("text"), F.lit("\n")) + 1)
    new_text = F.when(F.size(c) > 0, F.array_join(F.get(F.transform(F.array(n), lambda n: _kept(lines, c, n)), F.lit(0)), "\n")).otherwise(F.col("text"))
    removed = F.coalesce(F.reduce(c, F.lit(0), lambda s, r: s + r["q"] - r["p"] + 1), F.lit(0))
    columns = {text_col: new_text.alias(text_col)} | dict(zip(other, restored(other)))
    return [*(columns[c] for c in kept_cols), n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed_lines")]


def _kept(lines: Column, cuts: Column, n: Column) -> Column:
    """The lines between the cuts."""
    froms = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda r: r["q"] + 1))
    tos = F.concat(F.transform(cuts, lambda r: r["p"]), F.array(n.cast("int")))
    spans = F.zip_with(froms, tos, lambda f, t: F.struct(f.alias("f"), (t - f).alias("n")))
    return F.get(F.transform(F.array(lines), lambda x: F.flatten(F.transform(spans, lambda s: F.slice(x, s["f"] + 1, s["n"])))), F.lit(0))
