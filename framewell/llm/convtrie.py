"""Prefix trie of conversations by parallel tree contraction.

A node stands for each distinct sequence of first turns (role, text); its members are the conversations that start with
it. Texts never leave the first scan: a turn travels as the SHA-256 of its role and text and its number of words. The
key of a sequence is the exclusive or of two 64-bit hashes of (position, turn), so all prefixes of a conversation are
running aggregates, taken over stretches of 1024 turns and then over the stretches: a conversation of any length is
spread over tasks. Nodes are those keys, grouped with partial aggregation.

Totals over subtrees come from rounds of contraction over a table with one row for each node that is left. Rake: every
node without children gives its total to its parent and goes. Compress: of two neighbouring nodes with one child each,
at most one (by a coin from key and round) is spliced out, and what it holds rides on its child as a weight. A round
takes away a constant share of the nodes, whether the tree is wide or one chain, so their number is logarithmic. Then
the spliced nodes are expanded again, last round first, each from the total of the child it was spliced onto; the
tables of the rounds shrink geometrically, so all of them together are in proportion to the nodes. All joins of the
rounds are on a node's own key, which is unique, so no parent with very many children meets in one task.

Defined results: turns are ordered by turn (null first), then by the SHA-256 of role and text; repeated rows are turns
of their own. A null role or text is empty. Rows with a null conversation belong to none and are left out. An empty
table gives an empty result; otherwise there is a root, of depth 0 and without a text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, released, stored, tidied
from .mixing import _ranked

#: Turns of a stretch, as a power of two; so many neighbouring ids make up a part of a node's list of ends, too.
STRETCH = 10
ROOT = bytes(16)


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), said (SHA-256 of role and text) and words of each turn."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    role = text(role_col)
    said = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text(text_col)).cast("binary"), 256)
    rows = conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), said.alias("said"), F.regexp_count(text(text_col), F.lit(WORD)).cast("long").alias("words")
    )
    folded = rows.groupBy("conv", "turn", "said", "words").agg(F.count("*").alias("m"))
    order = F.coalesce(F.call_function("shiftright", F.col("turn"), F.lit(STRETCH)), F.lit(-(1 << 62)))
    placed = _ranked(folded.withColumn("b", order), ["conv"], "b", [F.col("turn").asc_nulls_first(), "said"], F.col("m"), "before")
    return placed.select("conv", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("m"))).alias("pos"), "said", "words")


def with_shared_openings(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the one they belong to, as turns (conv, pos, said, words) and conv with its length.

    The first h turns of conversation c - c % every (all if it has fewer, none if there is none) come before c's own
    turns after its first h; h is crc32 of c in decimal, modulo `most`.
    """
    lengths = turns.groupBy("conv").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    wanted = lengths.select("conv", "own", (F.col("conv") - F.col("conv") % every).alias("base"), h.alias("h"))
    bases = lengths.select(F.col("conv").alias("base"), F.col("own").alias("n_base"))
    convs = wanted.join(bases, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("lead"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest"))
    convs = stored(convs, "trie-convs")
    opening = turns.where(F.col("pos") < most).where(F.col("conv") % every == 0).withColumnRenamed("conv", "base")
    lead = convs.where("lead > 0").select("conv", "base", "lead").join(opening, "base").where("pos <= lead").select("conv", "pos", "said", "words")
    own = turns.where(F.col("pos") > h).join(convs.select("conv", "h", "lead"), "conv")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "said", "words")
    return lead.unionByName(own), convs.select("conv", (F.col("lead") + F.col("rest")).alias("n"))


def _key(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (a, b))))


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv, depth, node, parent, words, and whether the conversation ends there, for each turn."""
    turns = turns.withColumn("stretch", F.call_function("shiftright", F.col("pos") - 1, F.lit(STRETCH)))
    turns = turns.withColumns({f"x{i}": F.xxhash64(F.lit(i), "pos", "said") for i in (1, 2)})
    sums = turns.groupBy("conv", "stretch").agg(*(F.bit_xor(f"x{i}").alias(f"s{i}") for i in (1, 2)))
    ahead = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "stretch", *(F.coalesce(F.bit_xor(f"s{i}").over(ahead), F.lit(0)).alias(f"a{i}") for i in (1, 2)))
    upto = Window.partitionBy("conv", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumns({f"o{i}": F.bit_xor(f"x{i}").over(upto) for i in (1, 2)}).join(sums, ["conv", "stretch"])
    own = [F.col(f"o{i}").bitwiseXOR(F.col(f"a{i}")) for i in (1, 2)]
    last = [x.bitwiseXOR(F.col(f"x{i}")) for i, x in zip((1, 2), own)]
    ends = lengths.select("conv", F.col("n").alias("pos"), F.lit(True).alias("ends"))
    return turns.select("conv", "pos", _key(*own).alias("node"), _key(*last).alias("parent"), "words").join(ends, ["conv", "pos"], "left").withColumn("ends", F.coalesce("ends", F.lit(False)))


def hashed_lists(ends: DataFrame) -> DataFrame:
    """node and the SHA-256 of its conversations' ids, ascending and joined by commas.

    Ids are joined in parts of 1024 neighbouring numbers, and parts stream through the hash in order, so a list of any
    length needs no memory of its size.
    """
    part = ends.groupBy("node", F.call_function("shiftright", F.col("conv"), F.lit(STRETCH)).alias("part"))
    parts = part.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, h = None, None
        for b in batches:
            nodes, digests = [], []
            for node, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if node == last:
                    h.update(b",")
                else:
                    if h is not None:
                        nodes.append(last)
                        digests.append(h.hexdigest())
                    last, h = node, hashlib.sha256()
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return parts.repartition("node").sortWithinPartitions("node", "part").mapInArrow(tidied(run), "node binary, ends_sha256 string")


def contract(tree: DataFrame, values: list[str]) -> DataFrame:
    """node and, for each value, its sum over the node's subtree.

    tree: node, parent (null for the root), kids (number of children) and the values, which are longs.
    """
    own, load = [f"{v}_own" for v in values], [f"{v}_load" for v in values]  # what a node holds, and what rides on it for nodes spliced out above it
    left = tree.select("node", "parent", "kids", *(F.col(v).alias(o) for v, o in zip(values, own)), *(F.lit(0).cast("long").alias(x) for x in load))
    rounds: list[DataFrame] = []
    while True:
        number = len(rounds)
        given = left.where("kids = 0 and parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("gone"), *(F.sum(F.col(o) + F.col(x)).alias(f"{o}_in") for o, x in zip(own, load)))
        grown = [(F.col(o) + F.coalesce(f"{o}_in", F.lit(0))).alias(o) for o in own]
        raked = left.join(given, "node", "left").select("node", "parent", (F.col("kids") == 0).alias("raked"), (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"), *grown, *load)
        raked = stored(raked, "trie-raked")
        coin = lambda node: F.xxhash64(F.lit(number), node) % 2 == 0
        only = raked.where("not raked and parent is not null").groupBy(F.col("parent").alias("node")).agg(F.first(F.struct("node", "kids", *load)).alias("child"))
        free = (F.col("child.kids") != 1) | ~coin(F.col("child.node"))
        goes = F.coalesce((F.col("kids") == 1) & F.col("parent").isNotNull() & coin(F.col("node")) & free, F.lit(False))
        told = raked.join(only, "node", "left").withColumn("fate", F.when(F.col("raked"), "raked").when(goes, "spliced").otherwise("left"))
        rounds.append(stored(told, "trie-round"))
        released(raked)
        told = rounds[-1]
        if not told.where("fate = 'left'").limit(1).count():
            break
        spliced = told.where("fate = 'spliced'")
        news = spliced.select(F.col("child.node").alias("node"), F.col("parent").alias("above"), *((F.col(o) + F.col(x)).alias(f"{x}_in") for o, x in zip(own, load)))
        moved = told.where("fate = 'left'").join(news, "node", "left")
        left = moved.select("node", F.coalesce("above", "parent").alias("parent"), "kids", *own, *((F.col(x) + F.coalesce(f"{x}_in", F.lit(0))).alias(x) for x in load))
    known, written = None, []
    for number in range(len(rounds) - 1, -1, -1):
        r = rounds[number]
        totals = r.where("fate = 'raked'").select("node", *own)
        if known is not None:
            sums = known.select(F.col("node").alias("via"), *(F.col(o).alias(f"{o}_in") for o in own))
            again = r.where("fate = 'spliced'").select("node", F.col("child.node").alias("via"), *((F.col(o) + F.col(f"child.{x}")).alias(o) for o, x in zip(own, load))).join(sums, "via")
            totals = totals.unionByName(known).unionByName(again.select("node", *((F.col(o) + F.col(f"{o}_in")).alias(o) for o in own)))
        known = totals
        if number % 4 == 0:
            known = stored(known, "trie-totals")
            written.append(known)
    released(*rounds, *written[:-1])
    return known.select("node", *(F.col(o).alias(v) for v, o in zip(values, own)))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    turns: conv, pos, said and words (see numbered_turns); lengths: conv and n, the turns of every conversation.
    """
    held = stored(prefixes(turns, lengths), "trie-prefixes")
    nodes = held.groupBy("node").agg(F.first("parent").alias("parent"), F.first("pos").alias("depth"), F.first("words").alias("words"), F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"))
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n_convs", "conv_id")
    nodes = nodes.unionByName(root)
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    leaf = (F.col("n_children") == 0).cast("long")
    totals = contract(nodes.select("node", "parent", F.col("n_children").alias("kids"), leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = held.where("ends").select("node", "conv").unionByName(lengths.where("n = 0").select(F.lit(ROOT).alias("node"), "conv"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "node").join(hashed_lists(ends), "node", "left").join(above, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, shared_openings: bool = False, **columns: str) -> DataFrame:
    """The trie of a table of conversations; with shared_openings after with_shared_openings(). columns: see numbered_turns."""
    turns = stored(numbered_turns(conversations, **columns), "trie-turns")
    if shared_openings:
        turns, lengths = with_shared_openings(turns)
    else:
        lengths = turns.groupBy("conv").agg(F.count("*").alias("n"))
    return prefix_trie(turns, lengths)
