"""The registered queries opN_<name> and the pipeline, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .convtrie import conversation_trie
from .langid import identify_language
from .linededup import line_dedup
from .mixing import mix_sources
from .neardup import near_duplicates
from .pieces import encode
from .pii import pseudonymize
from .quality import quality_rules
from .spelling import spelling_variants
from .substringdup import substring_dedup
from .topk import exact_top_k
from .toxicity import toxicity
from .vectordup import embedding_duplicates


#: The registered query's key is in the open, as its tables hold invented data only; real data needs a secret one.
OPEN_KEY = "key in the open, for invented data"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed_lines")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(documents(spark, sf_dir), OPEN_KEY).drop("found")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("covered_words", "longest_repeat")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).drop("spans")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text, and whether they decode to it again."""
    spelled = encode(documents(spark, sf_dir).select("doc_id", "text"), check=True)
    return spelled.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "lossless")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that the contract fixes: ids divisible by 50, against all rows."""
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), shared_openings=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_minhash, op3_pii, op4_toxicity, op5_quality_rules, op6_substrings, op7_pieces, op8_language_id, op9_mixing, op10_embeddings, op11_top_k, op12_spelling, op13_conversations)}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": OP2, "op5_quality_rules": OP5, "op9_mixing": OP9, "op10_embeddings": OP10, "op11_top_k": OP11, "op12_spelling": OP12, "op13_conversations": OP13}


#: The schedule slot by slot: golden-ratio points through the cumulative targets, the slots of a source ranked and dealt
#: equal stretches of its endless line, cut at its laps, and the documents' words laid end to end below them.
OP9 = r"""
WITH d AS (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
           CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+')), 0) AS BIGINT) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
    FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY skey),
w AS (SELECT skey, s, CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS DOUBLE) AS w FROM s),
f AS (
    SELECT skey, s, w, (sum(s) OVER () - coalesce(3 * sum(s) OVER (ORDER BY s / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY s / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, s / w AS r
    FROM w),
l AS (SELECT arg_min(level, (r, skey)) AS level FROM f WHERE 3 * s / w > level),
t AS (SELECT f.skey, f.s, CASE WHEN 3 * f.s / f.w > f.level OR f.r >= (SELECT min(r) FROM f WHERE 3 * s / w > level) THEN l.level * f.w ELSE CAST(3 * f.s AS DOUBLE) END AS t FROM f, l),
p AS (SELECT doc_id, skey, size, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d),
n AS (SELECT CAST(sum(size) // 1024 + 1 AS BIGINT) AS n FROM d),
e AS (SELECT skey, s, t, CAST(round(sum(t) OVER (ORDER BY skey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (SELECT sum(t) FROM t) * 2147483647) AS BIGINT) AS hi FROM t WHERE t >= 1),
b AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY skey), 0) AS lo FROM e),
i AS (SELECT slot, (slot % 2147483647) * 1327217885 % 2147483647 AS y FROM (SELECT unnest(range(n)) AS slot FROM n)),
h AS (SELECT slot, skey FROM i JOIN b ON y >= lo AND y < hi UNION ALL SELECT n, skey FROM n, e),
r AS (SELECT slot, h.skey, s, CAST(floor(t) AS HUGEINT) AS t, row_number() OVER (PARTITION BY h.skey ORDER BY slot) - 1 AS k, count(*) OVER (PARTITION BY h.skey) AS c FROM h JOIN e ON e.skey = h.skey),
g AS (SELECT slot, skey, s, CAST(k * t // c AS BIGINT) AS p, CAST((k + 1) * t // c AS BIGINT) AS q FROM r),
o AS (SELECT slot, skey, greatest(p - lap * s, 0) AS p, least(q - lap * s, s) AS q FROM (SELECT *, unnest(range(p // s, (q - 1) // s + 1)) AS lap FROM g WHERE q > p)),
x AS (SELECT p.skey, p.a, p.size, CAST(sum(least(p.a + p.size, o.q) - greatest(p.a, o.p)) AS BIGINT) AS taken, min(slot) AS first_slot, count(*) AS n_takes
      FROM p JOIN o ON o.skey = p.skey AND o.p < p.a + p.size AND o.q > p.a WHERE p.size > 0 GROUP BY ALL)
SELECT doc_id, p.size, s AS source_size, t AS target, coalesce(x.taken, 0) AS taken, first_slot, coalesce(n_takes, 0) AS n_takes
FROM p JOIN t USING (skey) LEFT JOIN x ON x.skey = p.skey AND x.a = p.a AND x.size = p.size
"""

OP10 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

_WORDS = r"regexp_extract_all({}, '[^ \t\n\x0b\x0c\r]+')"

#: All pairs by shared shingles; links and components on full sets.
OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def _repeats(size: int) -> str:
    """doc_id and start of the windows of so many words that are found twice or more in their text."""
    return f"""(SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
        SELECT doc_id, i, n, md5(string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)) AS g
        FROM x) WHERE i + {size} <= n) WHERE c > 1)"""


def _covered(size: int) -> str:
    return f"(SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + {size})) AS x FROM {_repeats(size)}) GROUP BY doc_id)"


#: Repeats of ten words or more cover what repeated ten-word windows cover; a repeat beyond 150 words has a repeated window of 151.
OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i, len(w) AS n FROM d),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE len({_WORDS.format("x")}) > 0 GROUP BY doc_id),
m AS (
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words,
           coalesce(b.n, 0) > 0.4 * len(w) OR d.doc_id IN (SELECT doc_id FROM {_repeats(151)}) AS repeated
    FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN {_covered(3)} a ON a.doc_id = d.doc_id LEFT JOIN {_covered(10)} b ON b.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT repeated AS kept
FROM m
"""


#: The table of crc32 by its rule, and the checksum of a text of code points below 256 as UTF-8.
_CRC_TABLE = """g AS (SELECT range AS i, 0 AS k, range AS v FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM g WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM g WHERE k = 8)"""


def _crc(x: str) -> str:
    codes = f"list_transform(string_split({x}, ''), lambda y: ord(y))"
    octets = f"flatten(list_transform({codes}, lambda y: CASE WHEN y < 128 THEN [CAST(y AS BIGINT)] ELSE [CAST(192 + (y >> 6) AS BIGINT), CAST(128 + (y & 63) AS BIGINT)] END))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1])), 4294967295)"


#: Prefixes as lists of digests joined to one text; a node's subtree are the later prefixes of its members.
OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
s AS (SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS said,
             coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\x0c\\r]+')), 0) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, said) AS pos FROM s),
w AS (SELECT c, c - c % 20 AS base, {_crc("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM t), tab),
lead AS (SELECT w.c, t.pos, said, words FROM w JOIN t ON t.c = w.base AND t.pos <= w.h),
n AS (SELECT c, count(*) AS n FROM lead GROUP BY c),
r AS (SELECT * FROM lead UNION ALL SELECT t.c, t.pos - w.h + coalesce(n.n, 0), said, words FROM t JOIN w ON w.c = t.c AND t.pos > w.h LEFT JOIN n ON n.c = t.c),
p AS (SELECT c, pos, words, string_agg(said, ',') OVER (PARTITION BY c ORDER BY pos) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM w),
e AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY pos) AS up, pos = max(pos) OVER (PARTITION BY c) AS ends FROM p),
v AS (SELECT k, any_value(up) AS up, any_value(pos) AS depth, any_value(words) AS words, count(*) AS n_convs, min(c) AS conv_id,
             coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ids FROM e GROUP BY k),
m AS (SELECT up, count(*) AS n FROM v GROUP BY up),
x AS (SELECT DISTINCT a.k, b.k AS below FROM p a JOIN p b ON a.c = b.c AND a.pos <= b.pos),
y AS (SELECT x.k, count(CASE WHEN m.n IS NULL THEN 1 END) AS n_leaves, CAST(sum((v.n_convs - 1) * v.words) AS BIGINT) AS saved_tokens FROM x JOIN v ON v.k = x.below LEFT JOIN m ON m.up = x.below GROUP BY x.k)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(m.n, 0) AS n_children, n_leaves, saved_tokens, sha256(v.ids) AS ends_sha256
FROM v JOIN y ON y.k = v.k LEFT JOIN m ON m.up = v.k LEFT JOIN v u ON u.k = v.up
"""

#: Near words by what is left when a code point goes: a shared rest at the same place, or one word as the other's rest.
OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
u AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
f AS (SELECT id, run, count(*) AS m FROM u WHERE length(run) >= 5 GROUP BY ALL),
c AS (SELECT run, m, {_crc("id || ':' || run")} AS h FROM f, tab),
o AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, m FROM c),
v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
d AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS x FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.x = b.x AND a.i = b.i AND a.word <> b.word UNION SELECT v.word, d.word FROM v JOIN d ON v.word = d.x UNION SELECT d.word, v.word FROM v JOIN d ON v.word = d.x),
k AS (SELECT a, b, v.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS k FROM p JOIN v ON v.word = p.b),
w AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN k.n >= 2 * v.n THEN b END AS form, CASE WHEN k.n >= 2 * v.n THEN k.n END AS form_n FROM v LEFT JOIN k ON k.a = v.word AND k.k = 1),
r AS (SELECT word, word AS root, form FROM w UNION ALL SELECT r.word, w.word, w.form FROM r JOIN w ON w.word = r.form)
SELECT w.word, w.form, r.root, w.n, w.n_near, w.form_n FROM w JOIN r ON r.word = w.word AND r.form IS NULL
"""

#: All pairs of a query and another row.
OP11 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
