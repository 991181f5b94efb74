"""Quality rules: word counts, symbol and duplicate-line counts, and repetition from a word-level suffix array.

Every text is cut into words (runs without ASCII white space). The suffixes of a text's word sequence are
sorted by prefix doubling, the longest common prefix (LCP) of neighbours is read from the doubling ranks, and
each LCP interval of at least `min_repeat` words is a repeated substring. The union of those spans gives the
covered fraction, the largest LCP the longest repeat; texts beyond either limit are not kept.

Defined results: a null, empty or blank text has no words, so its counts are 0 and it fails the base rules
(fewer than 50 words). Every input row gives one output row, repeated rows and null ids included. Input columns
other than the id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import slices, tidied

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def suffix_repeats(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position the longest prefix of its suffix that also starts elsewhere in the same text, in words.

    codes: a value for each word, owner: the text of each word, ascending. The suffix array is refined by
    doubling; only suffixes that still share their prefix with another are sorted again, and the ranks of every
    round are kept to read the LCP of neighbours from the longest power of two down.
    """
    n = len(codes)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    last = np.searchsorted(owner, owner, side="right")  # end of the text of each word
    rank = _dense(tx.mix(codes ^ tx.mix(owner.astype(np.uint64) + np.uint64(1))))
    ranks, step = [rank], 1
    active = _shared(rank, np.arange(n))
    while len(active):
        ahead = active + step
        second = np.where(ahead < last[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        a, s, r = active[order], second[order], rank[active][order]
        # a group's suffixes take the places from its first one on, so a rank is a place in the suffix array
        new_run = np.concatenate([[True], r[1:] != r[:-1]])
        new_key = new_run | np.concatenate([[True], s[1:] != s[:-1]])
        i = np.arange(len(a))
        group = i[new_run][np.cumsum(new_run) - 1]
        rank = rank.copy()
        rank[a] = r + i[new_key][np.cumsum(new_key) - 1] - group
        ranks.append(rank)
        active = np.sort(a[_in_runs(new_key)])
        step *= 2
    order = np.argsort(rank, kind="stable")
    i, j = order[:-1].copy(), order[1:].copy()
    keep = ranks[0][i] == ranks[0][j]
    left, right, i, j = i[keep], j[keep], i[keep], j[keep]
    lcp = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for level in range(len(ranks) - 1, -1, -1):
        ok = (i[live] < last[left[live]]) & (j[live] < last[right[live]])
        at = live[ok]
        at = at[ranks[level][i[at]] == ranks[level][j[at]]]
        lcp[at] += 1 << level
        i[at] = np.minimum(i[at] + (1 << level), n)
        j[at] = np.minimum(j[at] + (1 << level), n)
    np.maximum.at(best, left, lcp)
    np.maximum.at(best, right, lcp)
    return best


def _dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key: how many keys are smaller."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    out = np.empty(len(keys), np.int64)
    out[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return out


def _in_runs(new: np.ndarray) -> np.ndarray:
    """Which rows are in a run of two or more, given where runs begin."""
    alone = new & np.concatenate([new[1:], [True]])
    return ~alone


def _shared(rank: np.ndarray, positions: np.ndarray) -> np.ndarray:
    counts = np.bincount(rank, minlength=len(rank))
    return positions[counts[rank] > 1]


def covered(best: np.ndarray, least: int, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text inside repeats of at least `least` words, and its longest repeat."""
    at = np.arange(len(best))
    reach = np.maximum.accumulate(np.where(best >= least, at + best, 0)) if len(best) else best
    inside = reach > at
    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, owner, best)
    return np.bincount(owner[inside], minlength=n_texts), longest


def measure(texts: list[str | None], min_repeat: int) -> list[np.ndarray]:
    """The columns of SCHEMA for some texts."""
    data, offsets = tx.packed(texts)
    n = len(texts)
    starts, ends = tx.words(data)
    first, owner = tx.per_text(starts, offsets)
    n_words = np.diff(first)
    ahead = np.concatenate([[0], np.cumsum(~tx.SPACES[data] & ((data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    codes = tx.word_hashes(data, starts, ends)
    best = suffix_repeats(codes, owner)
    tri = np.flatnonzero(best >= 3)
    marked = np.zeros(len(codes) + 3, bool)
    for d in range(3):
        marked[tri + d] = True
    repeat_words = np.bincount(owner[marked[: len(codes)]], minlength=n)
    in_repeats, longest = covered(best, min_repeat, owner, n)
    dup = np.zeros(n, np.int64)
    for k, t in enumerate(texts):
        if t and "\n" in t:
            lines = [x for x in t.split("\n") if x.strip("\t\n\v\f\r ")]
            dup[k] = len(lines) - len(set(lines))
    return [n_words, ahead[offsets[1:]] - ahead[offsets[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], dup, repeat_words, in_repeats, longest]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 10, max_covered: float = 0.4, max_longest: int = 150) -> DataFrame:
    """One row for each document: the measures, base_failed and kept (see the module's text).

    min_repeat: words from which a repeated substring counts. max_covered: share of a text's words that such
    repeats may cover. max_longest: words that the longest repeat may have.
    """
    import pyarrow as pa

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *(c.split()[0] for c in SCHEMA.split(", "))]
        for b in slices(batches, "text"):
            found = measure(b.column("text").to_pylist(), min_repeat)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.int64()) for x in found)], names)

    out = source.mapInArrow(tidied(rows), f"id {kind.simpleString()}, {SCHEMA}")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeated = (F.col("covered_words") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_longest)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~repeated).alias("kept"), "covered_words", "longest_repeat")
