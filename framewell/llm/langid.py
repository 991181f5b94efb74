"""Language identification with averaged hashed subword embeddings and a linear softmax.

Byte trigrams and four-grams of the lower-cased text (everything but letters counts as one space) are hashed to
buckets; a text is the mean of their embeddings, and a linear softmax over the learned languages reads it. The
model is trained by stochastic gradient descent in numpy on a bounded sample of labelled rows (`per_lang`
expected rows of each language, however many there are, chosen by a hash of the id, folds 0, 1 and 3
only). Fold 3 of the sample calibrates: a temperature is fitted to it, and the rejection threshold is the
`reject` quantile of the calibrated confidence of its right answers, 0.5 at most. Texts of the sample leave the
executors as bucket counts, so a long text is bounded by the number of buckets.

Defined results: a null text or one without a letter gives 'und', score 0 and rejected true. Without any
labelled row all texts give 'und'. Rows with null language, null id or fold 2 are never learned from. Every input
row gives one output row, rows that share an id too (held_out is false for a null id); an empty table gives an empty
result; other input columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, field, fold_of, held_out, restored, slices, tidied, with_fields

BUCKETS, DIM = 1 << 16, 16
RESULTS = ("held_out", "lang_pred", "score", "rejected")
_LETTER = re.compile(r"[^\W\d_]")
_SEP = np.ones(256, bool)
_SEP[97:123] = False
_SEP[128:] = False


def grams(text: str, piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's trigrams and four-grams, a bounded piece at a time."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    for at in range(0, max(1, len(raw) - 3), piece):
        b = raw[at : at + piece + 3]
        c = np.where(_SEP[b], np.uint8(32), b).astype(np.uint32)
        three = c[:-2] | (c[1:-1] << np.uint32(8)) | (c[2:] << np.uint32(16))
        four = three[:-1] | (c[3:] << np.uint32(24))
        if at + piece + 3 < len(raw):
            three = three[:piece]
        blank = np.uint32(0x2020)
        for x, k in ((three[(three & np.uint32(0xFFFF)) != blank], 0x9E3779B1), (four[(four & np.uint32(0xFFFF)) != blank], 0x85EBCA6B)):
            x = x * np.uint32(k)
            yield ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def _sample(docs: DataFrame, per_lang: int) -> tuple[list[str], list[tuple]]:
    """The languages, and (language number, calibrates, buckets, counts) of the sampled rows."""
    import pyarrow as pa

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("fold") != 2))
    counts = rows.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in counts)
    number = {lang: y for y, lang in enumerate(langs)}
    if not langs:
        return [], []
    share: Column = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_lang / r["count"]))])
    chance = F.pmod(F.xxhash64(F.lit("langid"), F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for t, lang, fold in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), b.column("fold").to_pylist()):
                if not _LETTER.search(t):
                    continue
                n = np.zeros(BUCKETS, np.int64)
                for g in grams(t):
                    n += np.bincount(g, minlength=BUCKETS)
                k = np.flatnonzero(n)
                out.append((number[lang], fold == 3, k.astype(np.int32).tobytes(), (n[k] / n.sum()).astype(np.float32).tobytes()))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["y", "cal", "k", "v"])

    picked = rows.where(chance < share[F.col("lang")]).select("text", "lang", F.col("fold").cast("int").alias("fold"))
    found = picked.mapInArrow(tidied(counted), "y int, cal boolean, k binary, v binary").collect()
    found = [(r["y"], r["cal"], np.frombuffer(r["k"], np.int32), np.frombuffer(r["v"], np.float32)) for r in found]
    return langs, sorted(found, key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))


def _fit(n_langs: int, rows: list[tuple], epochs: int, rate: float, reject: float) -> dict:
    """Embeddings and softmax by stochastic gradient descent; then temperature and threshold on the fold 3 rows."""
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, n_langs), np.float32), np.zeros(n_langs, np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    fit = [r for r in rows if not r[1]] or rows
    cal = [r for r in rows if r[1]] or rows
    steps, total = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            y, _, k, v = fit[i]
            lr = rate * (1 - steps / total)
            h = v @ emb[k]
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= lr * np.outer(h, p)
            b -= lr * 0.1 * p
            emb[k] -= (lr * 50) * v[:, None] * back
            steps += 1
    table = emb @ w
    z = np.array([v @ table[k] + b for _, _, k, v in cal])
    y = np.array([r[0] for r in cal])

    def chances(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temps = np.geomspace(0.25, 8, 40)
    t = float(min(temps, key=lambda t: -np.log(chances(t)[np.arange(len(y)), y] + 1e-9).mean()))
    p = chances(t)
    right = p.max(1)[p.argmax(1) == y]
    return {"table": table.astype(np.float32), "bias": b, "t": t, "least": min(0.5, float(np.quantile(right, reject))) if len(right) else 0.0}


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 600, epochs: int = 4, rate: float = 1.0, reject: float = 0.001, carry: bool | list[str] = False) -> DataFrame:
    """id, held_out, lang_pred, score (calibrated confidence) and rejected for each document.

    carry: return all input columns and the four instead (input columns of these names are replaced), or id and those named.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).withColumn("fold", fold_of(F.col("id")))
    langs, rows = _sample(known, per_lang)
    model = spark.sparkContext.broadcast(_fit(len(langs), rows, epochs, rate, reject) if rows else None)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        columns = [np.ascontiguousarray(m["table"][:, k]) for k in range(len(langs))] if m else []
        for b in slices(batches, at, 2 << 20):
            names, scores, rejected = [], [], []
            for t in field(b, at).to_pylist():
                if not t or m is None or not _LETTER.search(t):
                    names.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                z, n = np.zeros(len(langs)), 0
                for g in grams(t):
                    z += [c[g].sum(dtype=np.float64) for c in columns]
                    n += len(g)
                z = (z / max(n, 1) + m["bias"]) / m["t"]
                p = np.exp(z - z.max())
                p /= p.sum()
                k = int(p.argmax())
                names.append(langs[k]), scores.append(float(p[k])), rejected.append(bool(p[k] < m["least"]))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["row", "lang_pred", "score", "rejected"])

    kept = [id_col] if not carry else [c for c in docs.columns if c not in RESULTS] if carry is True else [id_col, *carry]
    own = text_col in kept and docs.schema[text_col].dataType.simpleString() == "string"
    at: str | int = kept.index(text_col) + 1 if own else "text"  # a text that is carried travels once
    source = docs.select(carried(kept), *([] if own else [F.col(f"`{text_col}`").cast("string").alias("text")]))
    out = source.mapInArrow(tidied(predicted), with_fields(source.schema["row"], ("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")))
    held = held_out(F.col(f"row.`{kept.index(id_col) + 1}`")).alias("held_out")
    return out.select(*restored(kept), held, "lang_pred", "score", "rejected")
