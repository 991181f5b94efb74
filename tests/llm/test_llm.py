"""The text and vector operators against brute force, on small inputs, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.llm import convtrie, langid, linededup, mixing, neardup, pieces, pii, quality, spelling, substringdup, topk, toxicity, vectordup
from framewell.llm import text as tx

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "Été x y z", "\u0001 \u0001\u0003 4@ \x00 nul", "▁ a▁b  c", "x" * 5000, "w " * 3000]


def frame(spark, texts, source=lambda i: f"s{i % 3}", lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t) if t else 0) for i, t in enumerate(texts)], DOCS)


def words(rng, n, pool=200):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def each_operator(docs, labels):
    """Every operator on documents, by name."""
    return {
        "line": linededup.line_dedup(docs, min_words=5),
        "near": neardup.near_duplicates(docs, percent=85),
        "pii": pii.pseudonymize(docs, "k"),
        "toxic": toxicity.toxicity(docs, labels),
        "quality": quality.quality_rules(docs),
        "substring": substringdup.substring_dedup(docs),
        "pieces": pieces.decode(pieces.encode(docs)),
        "lang": langid.identify_language(docs, per_lang=20, epochs=1),
        "lang carried": langid.identify_language(docs, per_lang=20, epochs=1, carry=True),
        "mix": mixing.mix_sources(docs),
    }


CLASHING = ("label", "id", "k", "v", "h", "taken", "score", "found", "rejected", "0", "piece_ids", "decoded", "cuts", "row", "n_lines", "component", "fold", "skey", "kept", "n", "spans", "copy", "row", "row_", "text_", "size_", "h1", "ats", "fp", "th", "pid", "lossless", "held_out", "lang_pred", "key", "drawer", "place", "own", "rep")


def test_odd_rows_and_clashing_columns(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one"), (None, "null id here"), (None, None)]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "s", None) for i, t in rows], DOCS)
    docs = docs.withColumns({c: F.lit(7) for c in CLASHING})
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 0), (3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    for name, out in each_operator(docs, labels).items():
        assert out.count() == len(rows), name
    spelled = pieces.decode(pieces.encode(docs)).collect()
    assert all(r.decoded == r.text for r in spelled)
    near = neardup.near_duplicates(docs).collect()
    assert [(r.component_id, r.kept) for r in near if r.doc_id is None] == [(None, True)] * 2
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in langid.identify_language(docs).collect() if r.doc_id in (0, 1, 2))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for name, out in each_operator(docs, labels).items():
        assert out.count() == 0, name
    assert vectordup.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def line_brute(rows, least):
    docs = sorted((i, t.split("\n")) for i, t in rows if t is not None)
    units = {i: [(k, x, len(x.split())) for k, x in enumerate(ls) if x.split()] for i, ls in docs}
    flat = [(i, j) for i, _ in docs for j in range(len(units[i]))]
    gone = set()
    for i, j in flat:
        for a, b in flat:
            if (a, b) >= (i, j):
                break
            n = w = 0
            while j + n < len(units[i]) and b + n < len(units[a]) and units[i][j + n][1] == units[a][b + n][1]:
                w += units[i][j + n][2]
                n += 1
                if w >= least:
                    gone |= {(i, x) for x in range(j, j + n)}
    out = {}
    for i, ls in docs:
        cut = set()
        for x, u in enumerate(units[i]):
            if (i, x) in gone:
                cut |= set(range(u[0], units[i][x + 1][0] if x + 1 < len(units[i]) else len(ls)))
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in cut), len(cut))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = [words(rng, rng.choice([1, 2, 3, 7, 12]), 8) for _ in range(12)] + ["", " "]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 10, 25])))) for k in range(50)]
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=10).collect()}
    assert got == line_brute(rows, 10)


def shingles(t):
    w = [x.lower() for x in (t or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(spark):
    rng = random.Random(4)
    texts = []
    for n in (1, 3, 5, 8, 30, 60, 150, 400, 900):
        base = words(rng, n, 5000).split()
        for _ in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, n // 60)])):
                w[rng.randrange(n)] = f"e{rng.randrange(9)}"
            texts.append(" ".join(w))
    texts += ["", None, texts[3].upper()]
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, texts), percent=85, block=4).collect()}
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            x = len(a & sets[j])
            if x and 100 * x >= 85 * len(a | sets[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert {i: (r.component_id, r.n_shingles, r.kept) for i, r in got.items()} == {i: (find(i), len(s), find(i) == i) for i, s in enumerate(sets)}


def test_pairs_just_below_the_threshold_displace_no_link(spark):
    texts = []
    for g in range(30):  # windows of 30, 31 and 31 shingles: 28 of 33 in common (below 85), 29 of 32 and 30 of 32
        w = [f"g{g}x{i}" for i in range(37)]
        texts += [" ".join(w[a:b]) for a, b in ((3, 37), (0, 35), (1, 36))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts), percent=85).collect()}
    assert got == {i: i - i % 3 for i in range(len(texts))}


def test_short_near_duplicates_are_never_missed(spark):
    texts = []
    for g in range(150):  # 4 and 5 shingles, similarity exactly 0.8
        w = [f"g{g}x{i}" for i in range(9)]
        texts += [" ".join(w), " ".join(w[:8])]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


@pytest.mark.parametrize("percent", [50, 70, 80, 85])
def test_small_sets_that_pass_share_a_list(percent):
    rng = np.random.default_rng(percent)
    keys = neardup.key_count(percent)
    for _ in range(3000):
        u = int(rng.integers(1, 30))
        x = np.unique(rng.integers(0, 1 << 32, u).astype(np.uint64))
        i = -(-percent * len(x) // 100)
        owner = rng.permutation(np.array([0] * i + [1] * (len(x) - i)))
        a, b = x[owner == 0], x
        assert len(np.intersect1d(neardup._list_keys(a, keys, percent), neardup._list_keys(b, keys, percent)))


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 90) if i != 40] + [(200, 300), (300, 250)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(edges).collect()}
    assert all(c == (0 if i <= 40 else 41 if i < 200 else 200) for i, c in got.items()) and len(got) == 94


def test_pseudonyms(spark):
    texts = ["card 4337166598464399 and 4337-1665-9846-4399, bad 4337166598464398", "again 4337166598464399 ip 10.1.2.3 999.1.1.1", "+1 (274) 555-9629 or 274-555-9629 not 074-555-9629", "123-45-6789 666-11-1111", "2024-02-29 2023-02-29 1999/12/31", "bosbt.42@mail8.example.com", None, "plain"]
    got = {r.doc_id: r for r in pii.pseudonymize(frame(spark, texts), "k").collect()}
    a, b = got[0].found, got[1].found
    assert a[0].value == a[1].value.replace("-", "") == b[0].value != "4337166598464399"
    digits = [int(c) for c in a[0].value]
    assert sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert "4337166598464398" in got[0].text and "999.1.1.1" in got[1].text and "10.1.2.3" not in got[1].text
    assert got[2].n_phone == 2 and got[2].found[0].value[-14:].translate(str.maketrans("", "", "()- ")) == got[2].found[1].value.replace("-", "")
    assert (got[3].n_ssn, got[4].n_date, got[5].n_email) == (1, 2, 1) and got[5].text.endswith("@mail8.example.com")
    assert got[6].text is None and got[7].text == "plain"
    other = pii.pseudonymize(frame(spark, texts), key="other").where("doc_id = 0").first()
    assert other.found[0].value != a[0].value


def test_pseudonyms_are_a_permutation(spark):
    ids = spark.range(0, 73049, 7).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"), F.col("id").alias("doc_id"))
    out = pii.pseudonymize(ids, "k")
    assert out.select("text").distinct().count() == ids.count() and out.where("n_date = 1").count() == ids.count()


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    bad = ["grim", "vile", "nasty"]
    texts, marks = [], []
    for i in range(600):
        w = words(rng, 60, 300).split()
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(w))
        marks.append((i, int(toxic)))
    out = toxicity.toxicity(frame(spark, texts), spark.createDataFrame(marks, "doc_id long, toxic int")).where("held_out").collect()
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in out)
    assert len(out) > 100 and right / len(out) > 0.95 and all(0 <= r.score <= 1 for r in out)


def test_toxic_words_do_not_share_counts(spark):
    rng = random.Random(7)
    texts = [words(rng, 30, 300) + (f" bad{i % 3}" if i % 5 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows = [toxicity.toxicity(frame(spark, texts), labels, filter_bits=b).orderBy("doc_id").collect() for b in (3, None)]
    assert rows[0] == rows[1]
    counts = toxicity._continuations(spark.createDataFrame([(" ".join(f"x{k} y{k}" for k in range(a, a + 150000)), a // 150000) for a in (0, 150000)], "text string, toxic int").withColumn("toxic", F.col("toxic") == 1))
    assert counts.count() == 600000 and counts.where("a + b <> 1").count() == 0


def test_quality_rules(spark):
    rng = random.Random(8)
    texts = [words(rng, n, p) for n in (0, 1, 3, 49, 50, 200) for p in (3, 40, 9000)]
    block = words(rng, 30, 9000)
    texts += [f"{block} {words(rng, 40, 9000)} {block}", "a\nb\na\n\n  \na x#*é <|>", *ODD]
    for r in quality.quality_rules(frame(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        w = t.encode().split()
        marked = []
        for size in (3, 10):
            c = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
            marked.append(len({i + d for i in range(len(w) - size + 1) if c[tuple(w[i : i + size])] > 1 for d in range(size)}))
        lines = [x for x in t.split("\n") if x.strip("\t\n\v\f\r ")]
        assert (r.n_words, r.n_repeat_words, r.covered_words) == (len(w), *marked)
        assert (r.word_chars, r.n_symbols, r.n_dup_lines) == (sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 2 * marked[0] > len(w)) and (not r.kept or not r.base_failed)


def test_longest_repeat():
    codes = np.array([1, 2, 3, 4, 9, 1, 2, 3, 4, 1, 2, 3, 4], np.uint64)
    assert quality.suffix_repeats(codes, np.zeros(13, np.int64)).tolist() == [4, 3, 2, 1, 0, 4, 3, 2, 1, 4, 3, 2, 1]
    assert quality.suffix_repeats(codes, np.arange(13)).tolist() == [0] * 13


def test_repeated_strings():
    rng = random.Random(1)
    for _ in range(20):
        base = [bytes(rng.choice(b"abcd \x00") for _ in range(rng.randint(100, 260))) for _ in range(4)]
        made = [rng.choice(base)[rng.randint(0, 40) :] + rng.choice(base)[: rng.randint(0, 150)] for _ in range(12)] + [b"ab" * 80, b"ab" * 70]
        made = [c for c in made if len(c) >= 100]
        seen: set = set()
        for c, got in zip(made, substringdup.repeated(made, 100)):
            want = []
            for i in range(len(c) - 99):
                want.append(c[i : i + 100] in seen)
                seen.add(c[i : i + 100])
            assert got.tolist() == want


@pytest.mark.parametrize("split", [4096, 1, 3])
def test_substring_dedup(spark, split):
    rng = random.Random(2)
    parts = [words(rng, 30) + "é" for _ in range(8)]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.5 else words(rng, 12, 10**6) for _ in range(rng.randint(0, 8))) for _ in range(40)]
    texts += [words(rng, 3, 10**6) + parts[0][:110] + words(rng, 3, 10**6) for _ in range(20)]  # many contexts of few anchors
    texts += [texts[0], texts[5], None, "ab" * 300]
    got = {r.doc_id: r for r in substringdup.substring_dedup(frame(spark, texts), split=split, batch=2000 if split == 3 else 1 << 20, one_in=1 if split == 3 else 64).collect()}
    seen: set = set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        hit = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                hit[s : s + 100] = True
            seen.add(b[s : s + 100])
        rest = bytes(np.frombuffer(b, np.uint8)[~hit[: len(b)]])
        n = int((np.diff(np.concatenate([[False], hit]).astype(int)) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(hit.sum()), n, hashlib.sha256(rest).hexdigest())


def test_strings_of_a_context_are_regrouped_once(spark):
    c = bytes(random.Random(4).randbytes(150))
    for o in (0, 30, 68):
        for n in (1, 2, 4, 32, 64, 69):
            starts = [a + i for _, a, x in substringdup.regrouped(c, o, n, 100) for i in range(len(x) - 99)]
            assert sorted(starts) == [i for i in range(51) if 0 <= o - i <= 68]


def test_pieces_are_lossless_and_reproducible(spark):
    texts = [*ODD, "中文 \U0001f600\n\n tail "]
    texts[7] = "y" * 20000
    d = frame(spark, texts)
    a = {r.doc_id: r for r in pieces.decode(pieces.encode(d)).collect()}
    b = {r.doc_id: r for r in pieces.encode(d.repartition(3)).collect()}
    c = {r.doc_id: r for r in pieces.encode(d, seed=2).collect()}
    assert all(a[i].decoded == t and a[i].piece_ids == b[i].piece_ids for i, t in enumerate(texts))
    assert any(a[i].piece_ids != c[i].piece_ids for i in a)


def test_pieces_follow_the_lattice_weights():
    voc = pieces.vocabulary()
    weight = {i: w for i, w in zip(voc["trie"]["piece"].tolist(), voc["trie"]["weight"].tolist()) if i >= 0}
    by_text = {voc["raw"][voc["cuts"][i] : voc["cuts"][i + 1]].decode(): i for i in weight}
    lattices, n = pieces.Lattices(voc, 1.0), 60000
    for text in (" there", "Sein", " aé", "zzzz"):  # one after the other, so later ones are added to kept lattices
        drawn, m = lattices.sample(np.repeat(lattices.numbers([text]), n), tx.mix(np.arange(n).astype(np.uint64)))
        ends = np.concatenate([[0], np.cumsum(m)])
        got = Counter(tuple(drawn[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:]))
        want: dict = {}

        def cut(at, done, total, text=text, want=want):
            if at == len(text):
                want[tuple(done)] = np.exp(total)
            for to in range(at + 1, len(text) + 1):
                if text[at:to] in by_text:
                    cut(to, [*done, by_text[text[at:to]]], total + weight[by_text[text[at:to]]])

        cut(0, [], 0.0)
        z = sum(want.values())
        assert set(got) <= set(want) and max(abs(got.get(k, 0) / n - v / z) for k, v in want.items()) < 0.01
        assert (np.concatenate([lattices.sample(lattices.numbers([text]), np.array([k], np.uint64))[0] for k in range(20)]) == np.concatenate([_alone(voc, text, k) for k in range(20)])).all()


def _alone(voc, text, k):
    lattices = pieces.Lattices(voc, 1.0)
    return lattices.sample(lattices.numbers([text]), np.array([k], np.uint64))[0]


def test_pieces_of_long_texts_do_not_depend_on_parts(spark, monkeypatch):
    rng = random.Random(8)
    text = " ".join(words(rng, 40, 10**6) + rng.choice(["\n", "  ", "é▁", "\t"]) for _ in range(60))
    voc = pieces.vocabulary()
    whole, n = pieces.encode_texts([text, None, ""], ["a", "b", "c"], pieces.Lattices(voc, 1.0), 1)
    monkeypatch.setattr(pieces, "PART", 300)
    monkeypatch.setattr(pieces, "HELD", 500)
    parts, m = pieces.encode_texts([text, None, ""], ["a", "b", "c"], pieces.Lattices(voc, 1.0), 1)
    assert whole.tolist() == parts.tolist() and n.tolist() == m.tolist() == [len(whole), 0, 0]
    data, sizes = pieces.decode_ids(whole, n, voc["raw"], voc["cuts"])
    assert data.tobytes().decode() == text and sizes.tolist() == [len(text.encode()), 0, 0]


def test_checked_pieces_and_clashing_names(spark):
    d = frame(spark, [*ODD, "a b"]).withColumns({c: F.lit(1) for c in ("row", "key", "text_", "0", "row_", "lossless", "ids")})
    out = pieces.encode(d, check=True).collect()
    assert len(out) == len(ODD) + 1 and all(r.lossless for r in out) and all(r.row == 1 for r in out)


def test_language_on_held_out_rows(spark):
    rng = random.Random(9)
    syll = {"aa": "ka to mi ru se".split(), "bb": "ßch eng ung öst wer".split(), "cc": "que eau oir été ion".split()}
    lang = lambda i: list(syll)[i % 3]
    texts = [" ".join("".join(rng.choice(syll[lang(i)]) for _ in range(3)) for _ in range(30)) for i in range(300)]
    out = langid.identify_language(frame(spark, texts, lang=lang), per_lang=60).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 40 and sum(r.lang_pred == lang(r.doc_id) for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in out) < 10


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(5)
    syll = {f"l{k:02}": [chr(0x4E00 + 5 * k + j) for j in range(5)] for k in range(70)}
    lang = lambda i: f"l{i % 70:02}"
    texts = [" ".join("".join(rng.choice(syll[lang(i)]) for _ in range(3)) for _ in range(20)) for i in range(70 * 24)]
    out = langid.identify_language(frame(spark, texts, lang=lang), per_lang=30).collect()
    assert {r.lang_pred for r in out} == set(syll)
    assert all(any(r.held_out and r.lang_pred == x == lang(r.doc_id) for r in out) for x in syll)


def test_mixing(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.choice([0, 1, 5, 40, 300])) for _ in range(200)]
    source = lambda i: None if i % 11 == 0 else ["a", "b", "B", "tiny"][0 if i % 2 else 3 if i == 2 else 1 + i % 3 // 2]
    d = frame(spark, texts, source=source)
    runs = [sorted(map(tuple, mixing.mix_sources(d.repartition(n), block_words=64).collect())) for n in (2, 5)]
    assert runs[0] == runs[1]
    size = Counter()
    taken, target = Counter(), {}
    for i, n, s, t, k, first, takes in runs[0]:
        assert n == len(texts[i].split()) and k <= 3 * n
        assert (k > 0) == (first is not None) == (takes > 0) and k <= takes * n
        size[source(i)] += n
        taken[source(i)] += k
        target[source(i)] = t
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    free, left, want = set(order), sum(size.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * size[s] < level * weight[s]}
        for s in full or free:
            want[s] = 3 * size[s] if full else level * weight[s]
            left -= want[s]
        free -= full or free
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1 for s in order)
    # slot by slot: which stretches of the schedule take from each document
    n_slots, at, upto, hits = sum(size.values()) // 64 + 1, 0, 0.0, {}
    for s in order:
        upto += target[s]
        lo, at = at, round(upto / sum(target.values()) * mixing.M)
        mine = [k for k in range(n_slots) if lo <= k * mixing.K % mixing.M < at] + [n_slots]
        line, place = [], 0
        for i in sorted((i for i in range(200) if source(i) == s and texts[i].split()), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()):
            line.append((i, place, place + len(texts[i].split())))
            place = line[-1][2]
        for r, k in enumerate(mine):
            p, q = (x * int(target[s]) // len(mine) for x in (r, r + 1))
            for lap in range(p // place, -(-q // place)):
                for i, u, v in line:
                    if max(p - lap * place, u) < min(q - lap * place, v):
                        hits.setdefault(i, []).append(k)
    assert {r[0]: (r[5], r[6]) for r in runs[0] if r[6]} == {i: (min(k), len(k)) for i, k in hits.items()}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.06 * rng.normal(size=16)).tolist(), i % 2) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], None), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, [None] * 16, 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, [], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectordup.embedding_duplicates(d, cells=12, block=16).collect()}
    unit = {}
    for i, v, label in rows:
        if v and label is not None and all(a is not None and np.isfinite(a) for a in v) and any(v):
            unit[i] = (np.array(v) / np.linalg.norm(v), label)
    links = {i: {j for j, (y, m) in unit.items() if i in unit and j != i and m == unit[i][1] and len(y) == len(unit[i][0]) and unit[i][0] @ y >= 0.98} for i, *_ in rows}
    for i, near in links.items():
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near), min(reach), i == min(reach)), i
    assert sum(map(len, links.values())) > 300


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    rng = random.Random(12)
    texts = [words(rng, 80, 500) for _ in range(30)]
    texts += [texts[0], texts[1] + " extra", f"{texts[2]}\n{words(rng, 60, 500)}", None, "", "12 34", None]
    docs = frame(spark, texts)
    seen = docs
    counts = []
    for k, (_, stage) in enumerate(c.STAGES):
        seen = spark.createDataFrame(stage(spark, seen, "").collect(), stage(spark, seen, "").schema)
        counts.append(seen.select("doc_id").distinct().count())
        if k + 1 < len(c.STAGES):
            assert seen.columns == docs.columns
    assert counts[0] == 33 and counts[1] == 32 and counts[2] == 31
    assert seen.where("not lossless").count() == 0 and seen.count() >= 25
    gone = {30, 31}
    assert not gone & {r.doc_id for r in seen.collect()}


def test_pipeline_stages_with_odd_rows_and_names(spark):
    import corpus_pipeline as c

    rng = random.Random(3)
    names = ("id", "taken", "takes", "size", "pid", "k", "row", "rejected", "score", "text_", "skey", "whole", "copy", "cuts")
    rows = [(i % 20, words(rng, 40, 300), "en", f"s{i % 2}", None) for i in range(40)]
    rows += [rows[0]] * 3 + [(None, words(rng, 60, 300), None, None, None), (None, None, "en", None, 1), (7, "", None, "s1", 0), (8, "a b c", "en", "s0", 5), (8, "d e f", "en", "s1", 5)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(1) for n in names})
    for name, stage in c.STAGES:
        out = stage(spark, docs, "").collect()
        assert len(out) > 0, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
        if name != "pieces":
            assert stage(spark, docs, "").columns == docs.columns


def test_mix_gives_no_words_twice(spark):
    import corpus_pipeline as c

    rng = random.Random(5)
    rows = [(1, words(rng, 10), "en", s, None) for s in ("a", "b", "c")] + [(2, words(rng, 7), "en", "a", None)] * 2 + [(i, words(rng, 20), "en", "abc"[i % 3], None) for i in range(3, 9)]
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter()
    for r in c.mix(spark, docs, "").collect():
        got[r.source] += len(r.text.split())
    want = {r.skey[1:]: r.target for r in mixing.mix_sources(docs, keyed=True).collect()}
    assert all(abs(got[s] - t) <= 1 for s, t in want.items()) and set(got) == set(want)


def _feistel(digits, radices, key, tweak):
    half, state = len(radices) // 2, list(digits)
    for i in range(8):
        left = i % 2 == 0
        rest = ",".join(map(str, state[half:] if left else state[:half]))
        for j in range(len(state)):
            if (j < half) == left:
                digest = hashlib.sha256(f"{key}|{tweak}|{i}|{j}|{rest}".encode()).hexdigest()
                state[j] = (state[j] + int(digest[:15], 16)) % radices[j]
    return state


def _luhn_ok(d):
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_follow_the_network(spark):
    rng = random.Random(11)
    cards, dates, ips = [], [], []
    for _ in range(12):
        body = [4, *(rng.randrange(10) for _ in range(14))]
        check = next(c for c in range(10) if _luhn_ok([*body, c]))
        cards.append("".join(map(str, [*body, check])))
        dates.append(f"{rng.randrange(1900, 2100)}/{rng.randrange(1, 13):02}/{rng.randrange(1, 29):02}")
        ips.append(".".join(str(rng.randrange(256)) for _ in range(4)))
    bad = [c[:-1] + str((int(c[-1]) + 1) % 10) for c in cards]
    values = [*cards, *dates, *ips, *bad, "2023-02-30", "300.1.1.1"]
    got = [r.text for r in pii.pseudonymize(frame(spark, values), "k").orderBy("doc_id").collect()]
    want = []
    for c in cards:
        d = list(map(int, c))
        new = [d[0], *_feistel(d[1:-1], [10] * 14, "k", "card")]
        want.append("".join(map(str, [*new, next(x for x in range(10) if _luhn_ok([*new, x]))])))
    import datetime

    first = datetime.date(1900, 1, 1)
    for t in dates:
        n = (datetime.date(*map(int, t.split("/"))) - first).days
        a, b = _feistel([n // 4297, n % 4297], [17, 4297], "k", "date")
        want.append((first + datetime.timedelta(a * 4297 + b)).strftime("%Y/%m/%d"))
    want += [".".join(map(str, _feistel(list(map(int, t.split("."))), [256] * 4, "k", "ip"))) for t in ips]
    assert got == [*want, *bad, "2023-02-30", "300.1.1.1"]
    with pytest.raises(ValueError):
        pii.pseudonymize(frame(spark, ["x"]), "")


def test_toxic_evidence_is_that_of_the_models(spark):
    rng = random.Random(13)
    rows = [(" ".join(rng.choice("abcdefghijklmnop"[: 16 if y else 10]) * rng.choice((1, 1, 2)) for _ in range(rng.randrange(0, 25))), bool(y)) for y in (0, 0, 0, 1) for _ in range(12)]
    counts = toxicity._continuations(spark.createDataFrame(rows, "text string, toxic boolean"))
    lefts: dict = {}
    for t, y in rows:
        w = t.split()
        for u, x in zip(["", *w], w):
            lefts.setdefault(x, (set(), set()))[y].add(u)
    n = [{w: len(v[y]) for w, v in lefts.items()} for y in (0, 1)]
    held, total = [], [sum(x.values()) for x in n]
    for x in n:
        c = [max(sum(v == k for v in x.values()), 1) for k in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        d = [0, *(min(max(k - (k + 1) * y * c[k] / c[k - 1], 0), k) for k in (1, 2, 3))]
        assert np.allclose(d[1:], toxicity.discounts(*(sum(v == k for v in x.values()) for k in (1, 2, 3, 4))))
        held.append({w: d[min(v, 3)] for w, v in x.items()})
    shared = {w: (n[0][w] + n[1][w] + 0.5) / (sum(total) + 0.5 * (len(lefts) + 1)) for w in lefts}
    p = [{w: (n[y][w] - held[y][w] + sum(held[y].values()) * shared[w]) / total[y] for w in lefts} for y in (0, 1)]
    want = {w: np.log(p[1][w] / p[0][w]) for w in lefts}
    code = {int(toxicity._codes([w])[0].view(np.int64)[0]): w for w in lefts}
    got = {code[r.word]: r.r / 1e9 for r in toxicity._evidence(counts, 0.0).collect()}
    assert set(got) == set(want) and all(abs(got[w] - want[w]) < 2e-9 for w in want)


def test_toxic_bigrams_are_interpolated(spark):
    rng = random.Random(14)
    rows = [(" ".join(rng.choice("abcdefgh"[: 8 if y else 6]) * rng.choice((1, 1, 2)) for _ in range(rng.randrange(1, 25))), bool(y)) for y in (0, 0, 0, 1) for _ in range(12)]
    code = lambda w: int(toxicity._codes([w])[0].view(np.int64)[0]) if w else 0
    n = [Counter((u, x) for t, y in rows if y == c for u, x in zip(["", *t.split()], t.split())) for c in (False, True)]
    after = [Counter() for _ in n]
    for c in (0, 1):
        for (u, _), k in n[c].items():
            after[c][u] += k
    bigrams = toxicity._bigrams(spark.createDataFrame(rows, "text string, toxic boolean"))
    assert {(r.prev, r.word): (r.a, r.b) for r in bigrams.collect()} == {(code(u), code(x)): (n[0][u, x], n[1][u, x]) for u, x in set(n[0]) | set(n[1])}
    lost = toxicity._bigram_discounts(bigrams)
    d = [[0, *toxicity.discounts(*(sum(v == k for v in m.values()) for k in (1, 2, 3, 4)))] for m in n]
    words = {r.word: r for r in toxicity._evidence(toxicity._continued(bigrams), 0.0).collect()}
    known = {x for m in n for _, x in m}
    lefts = {u for m in n for u, _ in m} | {"zz"}  # seen before a word by both classes, by one, and by none
    pairs = spark.createDataFrame([(code(u), code(x), words[code(x)].r, words[code(x)].pa, words[code(x)].pb) for u in lefts for x in known], "prev long, word long, r long, pa double, pb double")
    got = {(r.prev, r.word): r.full / 1e9 for r in toxicity._interpolated(pairs, bigrams, toxicity._histories(bigrams), lost).collect()}
    assert len(got) == len(lefts) * len(known)
    for u in lefts:
        for x in known:
            p = []
            for c in (0, 1):
                low = (words[code(x)].pa, words[code(x)].pb)[c]
                freed = sum(d[c][min(k, 3)] for (v, _), k in n[c].items() if v == u)
                p.append((n[c][u, x] - d[c][min(n[c][u, x], 3)] + freed * low) / after[c][u] if after[c][u] else low)
            assert abs(got[code(u), code(x)] - np.log(p[1] / p[0])) < 2e-9
    for c in (0, 1):  # what follows a history has a chance of 1 in all
        for u in lefts:
            mass = sum(max(n[c][u, x] - d[c][min(n[c][u, x], 3)], 0) for x in known) + sum(d[c][min(n[c][u, x], 3)] for x in known)
            assert not after[c][u] or abs(mass / after[c][u] - 1) < 1e-9


def _slow_grams(text):
    raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in (" " + text.lower() + " ").encode()]
    for size, mul in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        for i in range(len(raw) - size + 1):
            if raw[i] == raw[i + 1] == 32:
                continue
            x = sum(b << 8 * k for k, b in enumerate(raw[i : i + size])) * mul % 2**32
            yield ((x ^ x >> 15) * 0x2C1B3C6D % 2**32) >> 16


def test_language_scores_are_those_of_the_model(spark):
    rng = random.Random(17)
    pools = {"a": ["the", "of", "été"], "b": ["der", "und", "öl"], "c": ["le", "que", "ça"]}
    texts, langs = [], []
    for i in range(120):
        lang = rng.choice("abc")
        texts.append(" ".join(rng.choice(pools[lang]) + rng.choice(["", "!", " 12"]) for _ in range(rng.randrange(1, 15))))
        langs.append(lang)
    docs = frame(spark, [*texts, "42", None], lang=lambda i: (langs + [None, "a"])[i])
    known = docs.select(F.col("doc_id").alias("id"), "text", "lang").withColumn("fold", F.crc32(F.col("id").cast("string").cast("binary")) % 4)
    names, rows = langid._sample(known, 600)
    m = langid._fit(len(names), rows, 4, 1.0, 0.001)
    got = {r.doc_id: r for r in langid.identify_language(docs).collect()}
    for i, t in enumerate(texts):
        g = list(_slow_grams(t))
        z = (m["table"].astype(np.float64)[g].mean(0) + m["bias"]) / m["t"]
        e = np.exp(z - z.max())
        assert got[i].lang_pred == names[int(e.argmax())] and abs(got[i].score - (e / e.sum()).max()) < 1e-5
    assert [(got[i].lang_pred, got[i].score) for i in (120, 121)] == [("und", 0.0)] * 2


def test_embeddings_with_text_ids(spark):
    d = spark.createDataFrame([("b", [1.0, 0.0], 1), ("a", [1.0, 0.01], 1), ("c", [0.0, 1.0], 1), ("d", [1.0, 0.0], 2)], "vec_id string, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectordup.embedding_duplicates(d).collect()}
    assert got == {"a": (1, "a", True), "b": (1, "a", False), "c": (0, "c", True), "d": (0, "d", True)}


def test_line_dedup_is_linear_in_lines(spark):
    import time

    rng = random.Random(19)
    took = []
    for n in (5000, 40000):
        text = "\n".join(words(rng, 5, 10**6) for _ in range(n))
        began = time.time()
        out = linededup.line_dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
        took.append(time.time() - began)
        assert {r.doc_id: (r.n_lines, r.n_removed_lines) for r in out} == {1: (n, 0), 2: (n, n)}
    assert took[1] < 8 * took[0] + 20


def test_long_lists_of_near_copies_connect_with_few_comparisons(spark):
    rng = random.Random(23)
    base = words(rng, 90, 10**6).split()
    texts = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(90)] = f"x{i}"
        texts.append(" ".join(w))
    d = frame(spark, texts)
    whole = {r.doc_id: r.component_id for r in neardup.near_duplicates(d, percent=80).collect()}
    small = {r.doc_id: r.component_id for r in neardup.near_duplicates(d, percent=80, block=8).collect()}
    assert whole == small == brute_components(texts, 80)


def brute_components(texts, percent):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
                    a, b = sorted((root[i], root[j]))
                    root = [a if r == b else r for r in root]
                    changed = True
    return dict(enumerate(root))


def brute_top(rows, asks, k):
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, x) in enumerate(ints):
        if asks(i):
            found = sorted((-sum(a * b for a, b in zip(x, y)), j is None, j or 0, j) for p, (j, y) in enumerate(ints) if p != q)
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8))
    rows = [(i, (centres[i % 12] * rng.uniform(0.2, 3) + 0.1 * rng.standard_normal(8)).tolist()) for i in range(600)]
    rows += [(2000 + i, rows[7][1]) for i in range(150)]  # copies: one annulus of many blocks
    rows += [(5000, None), (5050, [1.0, None] + [0.0] * 6), (5100, [float("nan")] * 8), (5150, [float("inf")] * 8), (5200, []), (5250, [0.5, -0.5]), (None, [3.0] * 8), (50, rows[50][1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "row", "cell", "ring", "r", "norm", "asks", "rank", "score", "query_id", "cuts")})
    for small in ({}, {"ring": 16, "block": 20, "first": 64}):
        got = topk.exact_top_k(v, F.col("vec_id") % 50 == 0, **small).collect()
        assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=repr) == brute_top(rows, lambda i: i is not None and i % 50 == 0, 5)


def test_top_k_of_few_rows_and_large_numbers(spark):
    rows = [(0, [1e6, -3e7]), (1, [2.5, 2.0]), (50, [1e6, 1.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, lambda i: i % 50 == 0, 5)
    named = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("c", [-1.0])], "vec_id string, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.exact_top_k(named, F.col("vec_id") == "a").orderBy("rank").collect()] == [("a", "b", 65536), ("a", "c", -65536)]
    assert topk.exact_top_k(named.limit(0), F.lit(True)).count() == 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_composition_accepts_pairs_one_edit_apart():
    rng = random.Random(1)
    for t in range(60):
        groups = [sorted({"".join(rng.choice("abcé"[: 2 + t % 3]) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 40))}) for _ in range(rng.randrange(1, 5))]
        flat = [(g, w) for g, ws in enumerate(groups) for w in ws]
        sizes = np.array([len(w) for _, w in flat])
        codes = np.frombuffer("".join(w for _, w in flat).encode("utf-32-le"), np.uint32)
        a, b = spelling.composed(codes, np.cumsum(sizes) - sizes, sizes, np.array([g for g, _ in flat]), np.full(len(groups), 99))
        got = sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist()))
        assert got == [(i, j) for i in range(len(flat)) for j in range(i + 1, len(flat)) if flat[i][0] == flat[j][0] and one_edit(flat[i][1], flat[j][1])]


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("ab", "ba", "c") for b in ("x", "xy", "zy"))
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    root, final, first, label, target, skip = spelling.minimised(codes, np.cumsum(sizes) - sizes, sizes, np.zeros(len(words), np.int64))

    def language(s):
        return frozenset(["" for _ in range(int(final[s]))] + [chr(label[e]) + w for e in range(first[s], first[s + 1]) for w in language(target[e])])

    assert language(root[0]) == set(words)
    assert len({language(s) for s in range(len(final))}) == len(final)


def brute_spelling(texts):
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, near = {}, {}
    for w in n:
        others = [x for x in n if abs(len(x) - len(w)) < 2 and x != w and one_edit(x, w)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        near[w], form[w] = len(others), best if best and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return sorted(((w, form[w], root[w], n[w], near[w], n.get(form[w])) for w in n), key=repr)


@pytest.mark.parametrize("limit", [4096, 20, 1])
def test_spelling_variants(spark, limit):
    rng = random.Random(limit)
    base = ["".join(rng.choice("abÉéz×") for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["aaaaa" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(60)]
    words = [w for w in base for _ in range(rng.choice([1, 3, 9, 40]))]
    words += [w[: (k := rng.randrange(len(w)))] + rng.choice(["", "a", "Q"]) + w[k + rng.randrange(2) :] for w in words]
    rng.shuffle(words)
    texts = [(i, " ".join(words[i::40])) for i in range(40)] + [(7, None), (None, words[0]), (8, ""), (9, " ".join(["q" * 3000, "q" * 3001] * 3)), (9, words[1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "word", "run", "h", "n", "g", "part", "free", "extra", "form", "root", "many")})
    got = spelling.spelling_variants(docs, limit=limit).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_spelling(texts)
    if limit == 1:
        assert spelling.spelling_variants(docs.limit(0)).count() == 0


def brute_trie(rows, shared):
    said = lambda role, text: (role or "", text or "")
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}:{r[3] or ''}".encode()).hexdigest())
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        convs.setdefault(r[0], []).append(said(r[2], r[3]))
    if shared:
        first = lambda c: zlib.crc32(str(c).encode()) % 4
        convs = {c: convs.get(c - c % 20, [])[: first(c)] + t[first(c) :] for c, t in convs.items()}
    nodes = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for k, m in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        leaves = sum(not any(y[:-1] == x for y in nodes if y) for x in below)
        saved = sum((len(nodes[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), sum(y[:-1] == k for y in nodes if y), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shared", [True, False])
def test_conversation_trie(spark, shared, monkeypatch):
    if not shared:  # lists of ends and conversations of many stretches
        monkeypatch.setattr(convtrie, "STRETCH", 2)
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "a", "c  d\te", ""])) for c in range(90) for t in range(rng.randrange(6)) if c % 11 != 5]
    rows += [(c, t, "user", "same words here") for c in range(2000, 2030) for t in range(3)]  # one conversation, many times
    rows += [(3000, t, "user", f"turn {t}") for t in range(40)]  # a chain
    rows += [(None, 1, "user", "nobody's"), (40, None, None, None), (40, None, "user", "x"), (40, 1, "user", "tie"), (40, 1, "user", "tie"), (40, 1, "user", "other"), (-21, 1, "user", "below zero")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "pos", "said", "words", "node", "parent", "b", "m", "n")})
    got = convtrie.conversation_trie(talks, shared_openings=shared).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows, shared)
    if shared:
        assert convtrie.conversation_trie(talks.limit(0), shared_openings=True).count() == 0


@pytest.mark.parametrize("head", [1 << 20, 40])
def test_toxic_evidence_is_of_all_words(spark, monkeypatch, head):
    """A text's evidence is its whole log-likelihood ratio: words that both classes have alike count too, and unknown ones."""
    monkeypatch.setattr(toxicity, "HEAD", head)
    rng = random.Random(15)
    texts = [" ".join(rng.choice("abcdefghijkl"[: 12 if i % 4 == 0 else 9]) * rng.choice((1, 1, 2)) for _ in range(rng.randrange(0, 30))) for i in range(160)] + ["a zz a zz zzz", "zz", "", None]
    toxic = {i: i % 4 == 0 for i in range(160)}
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in toxic}
    pairs = lambda t: list(zip(["", *t.split()], t.split()))
    n = [Counter(p for i, y in toxic.items() if y == c and fold[i] < 2 for p in pairs(texts[i])) for c in (False, True)]
    lost = lambda x: [0, *toxicity.discounts(*(sum(v == k for v in x.values()) for k in (1, 2, 3, 4)))]
    cont, after = [Counter(x for _, x in m) for m in n], [Counter() for _ in n]
    d, e = [lost(m) for m in n], [lost(m) for m in cont]
    known = set(cont[0]) | set(cont[1])
    assert max(abs(len(m)) for m in cont) <= len(known) < 30
    freed = [Counter() for _ in n]
    for c in (0, 1):
        for (u, _), k in n[c].items():
            after[c][u] += k
            freed[c][u] += d[c][min(k, 3)]

    def low(c, x):
        total = [sum(m.values()) for m in cont]
        shared = (cont[0][x] + cont[1][x] + 0.5) / (sum(total) + 0.5 * (len(known) + 1))
        return (cont[c][x] - e[c][min(cont[c][x], 3)] + sum(e[c][min(v, 3)] for v in cont[c].values()) * shared) / total[c]

    def p(c, u, x):
        return (n[c][u, x] - d[c][min(n[c][u, x], 3)] + freed[c][u] * low(c, x)) / after[c][u] if after[c][u] else low(c, x)

    def says(u, x):
        a, b = p(0, u, x), p(1, u, x)
        return np.log(b / a) if a > 0 and b > 0 else np.log(low(1, x) / low(0, x))

    labels = spark.createDataFrame([(i, int(y)) for i, y in toxic.items()], "doc_id long, toxic int")
    got = {r.doc_id: r.log_ratio for r in toxicity.toxicity(frame(spark, texts), labels).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        each = [says(u, x) for u, x in pairs(t or "")]
        assert abs(got[i] - sum(each) / max(len(each), 1)) < 1e-5, (i, t)
