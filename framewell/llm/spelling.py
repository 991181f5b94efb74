"""Spelling variants: pairs of vocabulary words one edit apart, by finite-state composition.

The vocabulary is read as an acceptor; composed with a transducer that makes one edit (a code point inserted, deleted
or replaced) and with the acceptor again, it accepts just the pairs of words that are one edit apart. The composition
is enumerated by initial state. A pair that agrees on its first `step` code points stays within the words of one such
beginning; a pair that differs before them shares the rest of the word, so words are gathered by their rest as well.
Beginnings of more than `limit` words are divided again in the same way, by the next `step` code points, as often as it
takes: pairs that agree on these, too, go on, the others are gathered by beginning and rest. So no group outgrows what
its few free code points can spell, and each pair is met in exactly one of them: where its words first differ decides.

A task packs whole groups together, minimises their acceptor bottom-up (states of one height, one finality and equal
transitions are one), and walks the composition breadth first in numpy: pairs of states before, at and after the edit.
Transitions carry how many words they skip, so a path ends in the numbers of its two words. A word gets back its number
of near words and the best of them from each group, never the pairs.

A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least `times` its own;
its root is the last word of the chain of forms, which doubling finds in few rounds, as n grows along it.

Defined results: a null text has no words; a null id counts as empty text in the checksum; repeated rows count each
time. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored, tidied

#: Letters of a word, after A-Z are lower-cased.
LETTERS = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = 21  # bits of a code point


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 5, least: int = 3, one_in: int = 97) -> DataFrame:
    """word and n of all words with so many code points and occurrences.

    Where `one_in` divides h, the crc32 of '<id>:<word>', the code point at h % length is left out, as a slip would do.
    """
    text = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= letters).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % one_in == 0, slip).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def minimised(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple:
    """The minimal acceptor of words in order of group and code points, with an initial state for each group.

    Returns root (state of each group), final, first, label, target and skip: transitions of state s are first[s] up to
    first[s + 1], in order of their labels; skip counts the words of s that come before those of the transition.
    """
    n_groups = int(group[-1]) + 1
    at, n_nodes = group.copy(), n_groups
    parents, labels, live, depth = [], [], np.arange(len(sizes)), 0
    levels = [0, n_nodes]
    ends = np.zeros(len(sizes), np.int64)
    while True:
        ends[live[sizes[live] == depth]] = at[live[sizes[live] == depth]]
        live = live[sizes[live] > depth]
        if not len(live):
            break
        up, c = at[live], codes[starts[live] + depth].astype(np.int64)
        new = np.ones(len(live), bool)
        new[1:] = (up[1:] != up[:-1]) | (c[1:] != c[:-1])
        parents.append(up[new])
        labels.append(c[new])
        at[live] = n_nodes + np.cumsum(new) - 1
        n_nodes += int(new.sum())
        levels.append(n_nodes)
        depth += 1
    parent = np.concatenate([np.zeros(0, np.int64), *parents])
    label = np.concatenate([np.zeros(0, np.int64), *labels])  # of the edge to node n_groups + k
    final = np.zeros(n_nodes, bool)
    final[ends] = True
    degree = np.bincount(parent, minlength=n_nodes)
    child = n_groups + np.concatenate([[0], np.cumsum(degree)])[:-1]  # children of a node are neighbours, as levels are in order
    height, words = np.zeros(n_nodes, np.int64), final.astype(np.int64)
    for lo, hi in zip(levels[-2:0:-1], levels[:1:-1]):
        up = parent[lo - n_groups : hi - n_groups]
        np.maximum.at(height, up, height[lo:hi] + 1)
        np.add.at(words, up, words[lo:hi])
    skips = np.concatenate([[0], np.cumsum(words[n_groups:])])
    skip = skips[:-1] - skips[child[parent] - n_groups] + final[parent] if len(parent) else np.zeros(0, np.int64)
    state, n_states, chosen = np.zeros(n_nodes, np.int64), 0, []
    by_height = np.argsort(height, kind="stable")
    cuts = np.searchsorted(height[by_height], np.arange(height.max() + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        nodes = by_height[lo:hi]
        rest = np.zeros(len(nodes), np.int64)
        for k in range(int(degree[nodes].max()) - 1, -1, -1):
            some = np.flatnonzero(degree[nodes] > k)
            to = child[nodes[some]] + k
            edge = np.unique(state[to] << LABEL | label[to - n_groups], return_inverse=True)[1]
            rest[some] = np.unique(edge << 31 | rest[some], return_inverse=True)[1] + 1
        _, pick, same = np.unique(rest << 1 | final[nodes], return_index=True, return_inverse=True)
        state[nodes] = n_states + same
        chosen.append(nodes[pick])
        n_states += len(pick)
    chosen = np.concatenate(chosen)
    first = np.concatenate([[0], np.cumsum(degree[chosen])])
    edges = np.repeat(child[chosen] - n_groups - first[:-1], degree[chosen]) + np.arange(first[-1])
    return state[:n_groups], final[chosen], first, label[edges], state[edges + n_groups], skip[edges]


def composed(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of words of a group that are one edit apart and first differ before place `within` (by group)."""
    root, final, first, label, target, skip = minimised(codes, starts, sizes, group)
    degree = np.diff(first)
    keys = np.repeat(np.arange(len(degree)), degree) << LABEL | label

    def step(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All transitions of the states, and which of the states each is of."""
        row = np.repeat(np.arange(len(s)), degree[s])
        return row, np.repeat(first[s] - np.concatenate([[0], np.cumsum(degree[s])])[:-1], degree[s]) + np.arange(len(row))

    def both(s, t, i, j, barred=None):
        """The next pairs of states where both sides read the same code point, but for a barred one."""
        row, e = step(s)
        if barred is not None:
            ok = label[e] != barred[row]
            row, e = row[ok], e[ok]
        wanted = t[row] << LABEL | label[e]
        f = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        ok = keys[f] == wanted if len(keys) else np.zeros(0, bool)
        row, e, f = row[ok], e[ok], f[ok]
        return target[e], target[f], i[row] + skip[e], j[row] + skip[f]

    found: list[tuple[np.ndarray, np.ndarray]] = []

    def accepted(s, t, i, j):
        ok = final[s] & final[t]
        found.append((i[ok], j[ok]))

    s, i = root, np.searchsorted(group, np.arange(len(root)))
    after = tuple(np.zeros(0, np.int64) for _ in range(4))
    depth = 0
    while len(s) or len(after[0]):
        after = both(*after)
        more = within[group[i]] > depth if len(i) else np.zeros(0, bool)
        s, i = s[more], i[more]
        row, e = step(s)
        # replaced: two transitions of one state, the smaller label first
        later = (first[s + 1][row] - 1 - e) if len(e) else e
        a = np.repeat(np.arange(len(e)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        changed = (target[e[a]], target[e[b]], i[row[a]] + skip[e[a]], i[row[a]] + skip[e[b]])
        # inserted: the second word reads a code point more, and the first goes on with another one, or ends
        longer = (s[row], target[e], i[row], i[row] + skip[e])
        accepted(*longer)
        inserted = both(*longer, barred=label[e])
        after = tuple(np.concatenate(x) for x in zip(after, changed))
        accepted(*after)
        # what follows an insertion has read one code point more on the second side; it is one step ahead, which no step depends on
        accepted(*inserted)
        after = tuple(np.concatenate(x) for x in zip(after, inserted))
        s, i = target[e], i[row] + skip[e]
        depth += 1
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _met(words: list[str], parts: list[str], group: np.ndarray, free: np.ndarray, extra: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of words in groups: which have near words, how many, and the number of the best one.

    free: how many code points of a part may differ (by word, equal in a group); extra: parts that are one code point
    longer than that and only stand as the longer word of a pair.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    # a word needs another one of its length, or of one code point more or less, in its group
    marks, inverse, counts = np.unique(group * (int(sizes.max()) + 3) + sizes + 1, return_inverse=True, return_counts=True)
    near = counts > 1
    near[1:] |= np.diff(marks) == 1
    near[:-1] |= np.diff(marks) == 1
    use = np.flatnonzero(near[inverse])
    if not len(use):
        return (np.zeros(0, np.int64),) * 3
    _, dense = np.unique(group[use], return_inverse=True)
    within = np.zeros(dense[-1] + 1, np.int64)
    within[dense] = free[use]
    codes = np.frombuffer("".join(parts[k] for k in use).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = sizes[use]
    a, b = composed(codes, np.cumsum(size) - size, size, dense, within)
    ok = ~(extra[use[a]] & extra[use[b]])
    a, b = use[a[ok]], use[b[ok]]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    named = np.unique(b)
    place = np.zeros(len(words), np.int64)
    place[sorted(named.tolist(), key=words.__getitem__)] = np.arange(len(named))
    order = np.lexsort((place[b], -n[b], a))
    a, b = a[order], b[order]
    head = np.flatnonzero(np.diff(a, prepend=-1))
    return a[head], np.diff(np.append(head, len(a))), b[head]


def near_words(vocab: DataFrame, limit: int = 4096, step: int = 3, batch: int = 32768) -> DataFrame:
    """word, n_near, form and form_n: how many words of the table (word, n) are near, and the best of them; no row without any."""
    import pyarrow as pa

    cut = lambda a, size: F.substring("word", F.lit(a + 1), F.lit(size))
    groups, at, rest = [], 0, vocab.select("word", "n")
    while True:
        beginning = cut(0, at + step)
        # pairs that differ first at one of these code points: gathered by what is before and after them
        for width, some in ((step, F.lit(True)), (step + 1, F.length("word") > at + step)):
            after = F.substring("word", F.lit(at + width + 1), F.length("word"))
            groups.append(rest.where(some).select(F.concat_ws(":", F.lit(str(at)), cut(0, at), after).alias("g"), cut(at, width).alias("part"), F.lit(step).alias("free"), F.lit(width > step).alias("extra"), "word", "n"))
        at += step
        rest = rest.where(F.length("word") >= at)
        many = rest.groupBy(beginning.alias("g")).agg(F.count("*").alias("m")).where(F.col("m") > limit)
        many = stored(many.select("g", F.lit(True).alias("many")), "spelling-many")
        marked = rest.withColumn("g", beginning).join(many, "g", "left")
        after = F.substring("word", F.lit(at + 1), F.length("word"))
        groups.append(marked.where("many is null").select(F.concat_ws(":", F.lit(f"{at} on"), "g").alias("g"), after.alias("part"), F.lit(1 << 30).alias("free"), F.lit(False).alias("extra"), "word", "n"))
        if not many.limit(1).count():
            break
        rest = stored(marked.where("many").select("word", "n"), "spelling-rest")
    rows = groups[0]
    for g in groups[1:]:
        rows = rows.unionByName(g)

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        names = t.column("g").to_pylist()
        group = np.cumsum([0, *(x != y for x, y in zip(names[1:], names[:-1]))])
        words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
        a, count, best = _met(words, t.column("part").to_pylist(), group, t.column("free").to_numpy().astype(np.int64), t.column("extra").to_numpy(), n)
        column = t.column("word").combine_chunks()
        return pa.RecordBatch.from_arrays([column.take(pa.array(a)), pa.array(count.astype(np.int64)), column.take(pa.array(best)), pa.array(n[best].astype(np.int64))], ["word", "n_near", "form", "form_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size < batch:
                continue
            last = b.column("g")[b.num_rows - 1].as_py()  # this group may go on
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            names = whole.column("g").to_pylist()
            k = names.index(last)
            if k:
                yield found([whole.slice(0, k)])
                held, size = [whole.slice(k)], whole.num_rows - k
        if held:
            yield found(held)

    met = rows.repartition("g").sortWithinPartitions("g", "part").mapInArrow(tidied(run), "word string, n_near long, form string, form_n long")
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), "form"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", "best.form_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for the rows of (word, form): the last word of the chain of forms, by doubling."""
    links, written = forms.select("word", F.col("form").alias("root")), []
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = stored(links.join(ahead, "root", "left"), "spelling-chains")
        if not both.where("next is not null").limit(1).count():
            released(*written)
            return both.select("word", "root")
        written.append(both)
        links = both.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 5, least: int = 3, times: int = 2, limit: int = 4096) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the vocabulary."""
    vocab = stored(vocabulary(docs, id_col, text_col, letters, least), "spelling-words")
    near = stored(near_words(vocab, limit), "spelling-near")
    formed = vocab.join(near, "word", "left").withColumn("good", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("good"), F.col("form")).alias("form"), F.when(F.col("good"), F.col("form_n")).alias("form_n"))
    formed = stored(formed, "spelling-forms")
    found = roots(formed.where("form is not null").select("word", "form"))
    released(near)
    return formed.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
