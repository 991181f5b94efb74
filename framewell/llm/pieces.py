"""SentencePiece encoding by forward-filtering backward-sampling over the piece lattice, and lossless decoding.

A text is cut at white space into stretches (a space with the word after it, a word, or one white space character;
after every 256 characters of a longer word a new stretch begins); pieces never cross a stretch. Distinct stretches
share lattices in numpy: their edges are the vocabulary's pieces, and a character that no piece covers is one edge of
byte pieces. The forward pass sums the weights of all segmentations up to each position; the backward pass draws,
from the end of every occurrence, the last piece in proportion to them. The drawn numbers are a hash of the seed, the
row key, the stretch's number in its row and the step, and the shares of a position's pieces are whole numbers of
2**-30, so a row is cut the same way wherever it is run, and other rows with the same word otherwise.

A task keeps the lattices of the stretches it has seen for the texts that follow, `HELD` positions at most, then starts
anew; texts are taken in parts of about `PART` characters. So memory is bounded however long a text is, but for the
text itself and its ids.

The vocabulary is a BPE model, whose scores are merge ranks; rank r is read as the probability 1 / (r + 3) (Zipf),
raised to `sharpness`: 0 draws all segmentations alike, large values give the most probable one. The model file's path
is a parameter.

Decoding is exact: spaces are written as U+2581 inside pieces, and a U+2581 of the text itself and all characters
without a piece become byte pieces. Unpaired surrogates cannot occur in Spark strings. Ids that spell no UTF-8 text
raise an error.

Defined results: a null text gives null ids and decodes to null, an empty text no ids and the empty text. Rows with
equal keys and texts are cut alike; a null key counts as the key ''. An empty table gives an empty one. All input
columns stay, whatever their names; one called piece_ids (in decoding, decoded) is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import carried, field, restored, slices, tidied, with_fields

PATH = "/opt/tokenizers/piece_bpe_32k.model"
_STRETCH = re.compile(r" ?[^ \t\n\r\v\f]{1,256}|[ \t\n\r\v\f]")
_SPACES = re.compile(r"[ \t\n\r\v\f]")
PART, HELD = 1 << 18, 1 << 18
_GRAIN, _ALL = 1 << 30, (1 << 31) - 1
_SPACE, _LITERAL = 0x2581, 0x110000  # a space inside pieces; a U+2581 of the text, which is in no piece


def vocabulary(path: str = PATH) -> dict:
    """Pieces, weights and bytes of a model file, as arrays: bounded by the vocabulary's size."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    spelled: list[tuple[str, int, float]] = []
    raw, byte_ids = [], np.zeros(256, np.int32)
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:-1], 16)] = i
            raw.append(bytes([int(p[3:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            raw.append(p.replace("▁", " ").encode())
            spelled.append((p, i, -np.log(3 - sp.get_score(i))))
    return {"trie": _trie(spelled), "bytes": byte_ids, "raw": b"".join(raw), "cuts": np.cumsum([0, *map(len, raw)])}


def _trie(pieces: list[tuple[str, int, float]]) -> dict:
    """All beginnings of pieces by their hash: two tables of slots (the second for those whose slot is taken), and the
    hash, piece (-1: only a beginning) and weight of each entry."""
    known: dict[int, tuple[int, float]] = {}
    for p, i, w in pieces:
        h = 0
        for k, c in enumerate(p):
            h = (h + (ord(c) + 1) * int(_POW[k])) & 0xFFFFFFFFFFFFFFFF
            known.setdefault(h, (-1, 0.0))
        known[h] = (i, w)
    hashes = np.array(list(known), np.uint64)
    ids, weights = (np.array(x) for x in zip(*known.values()))
    mixed = tx.mix(hashes)
    bits = max(16, int(8 * len(hashes)).bit_length())
    one = np.full(1 << bits, -1, np.int32)
    first = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    one[first[::-1]] = np.arange(len(hashes), dtype=np.int32)[::-1]
    rest = np.flatnonzero(one[first] != np.arange(len(hashes)))
    two, add = np.full(1 << bits, -1, np.int32), 0
    while True:  # another mix until the rest has a slot each
        second = (tx.mix(mixed[rest] + np.uint64(add)) >> np.uint64(64 - bits)).astype(np.int64)
        if len(np.unique(second)) == len(rest):
            break
        add += 1
    two[second] = rest
    return {"one": one, "two": two, "add": np.uint64(add), "bits": np.uint64(64 - bits), "hash": hashes, "piece": ids.astype(np.int32), "weight": weights.astype(np.float64), "longest": max(len(p) for p, _, _ in pieces)}


def _entries(trie: dict, h: np.ndarray) -> np.ndarray:
    """The entry of each hash, -1 where there is none."""
    mixed = tx.mix(h)
    e = trie["one"][mixed >> trie["bits"]]
    other = np.flatnonzero((trie["hash"][e] != h) & (e >= 0))
    e[other] = trie["two"][tx.mix(mixed[other] + trie["add"]) >> trie["bits"]]
    e[other[(trie["hash"][e[other]] != h[other])]] = -1
    return e


_POW = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(255, 0x9E3779B97F4A7C15, np.uint64)]))


def _lattices(strings: list[str], voc: dict, sharpness: float) -> tuple[np.ndarray, ...]:
    """For distinct strings: first node of each (one more at the end); of each edge, in order of the node it ends at, the
    node it starts at, its piece (below 0: a character without one) and the grains of its node's edges up to it; and the
    first edge of each node."""
    lengths = np.array([len(s) for s in strings], np.int64)
    base = np.concatenate([[0], np.cumsum(lengths + 1)])
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    lead = np.cumsum(lengths) - lengths
    codes[codes == _SPACE] = _LITERAL
    codes[lead[codes[lead] == 32]] = _SPACE
    place = np.arange(len(codes)) - np.repeat(lead, lengths)
    left = np.repeat(lengths, lengths) - place
    node = np.repeat(base[:-1], lengths) + place
    value = codes.astype(np.uint64) + np.uint64(1)
    starts, ends, ids, weights = [], [], [], []
    alone = np.ones(len(codes), bool)
    at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    trie = voc["trie"]
    for k in range(1, trie["longest"] + 1):
        live = left[at] >= k
        at, h = at[live], h[live]
        if not len(at):
            break
        h = h + value[at + k - 1] * _POW[k - 1]
        entry = _entries(trie, h)
        live = entry >= 0
        at, h, entry = at[live], h[live], entry[live]
        piece = trie["piece"][entry]
        hit = np.flatnonzero(piece >= 0)
        s = at[hit]
        starts.append(node[s]), ends.append(node[s] + k), ids.append(piece[hit]), weights.append(sharpness * trie["weight"][entry[hit]])
        if k == 1:
            alone[s] = False
    # characters without a piece: one edge that stands for their bytes
    s = np.flatnonzero(alone)
    starts.append(node[s]), ends.append(node[s] + 1), weights.append(np.full(len(s), sharpness * -np.log(32000.0)))
    ids.append(-1 - codes[s].astype(np.int32))
    start, end, piece, weight = (np.concatenate(x) for x in (starts, ends, ids, weights))
    order = np.argsort(end, kind="stable")
    start, piece, end, weight = start[order], piece[order], end[order], weight[order]
    # forward sums, one position of all strings after the other
    forward = np.zeros(int(base[-1]))
    pos = end - np.repeat(base[:-1], lengths + 1)[end]
    by_pos = np.argsort(pos, kind="stable")
    cuts = np.searchsorted(pos[by_pos], np.arange(1, int(lengths.max()) + 2))
    for x, y in zip(cuts[:-1], cuts[1:]):
        e = by_pos[x:y]
        v = forward[start[e]] + weight[e]
        new = np.flatnonzero(np.concatenate([[True], end[e][1:] != end[e][:-1]]))
        top = np.maximum.reduceat(v, new)
        size = np.diff(np.concatenate([new, [len(e)]]))
        forward[end[e][new]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, size)), new))
    # shares in whole grains: within a node they do not depend on the other strings
    grains = np.maximum(np.rint(np.exp(forward[start] + weight - forward[end]) * _GRAIN), 1).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
    size = np.diff(np.concatenate([new, [len(end)]]))
    upto = np.cumsum(grains)
    upto = upto - np.repeat(upto[new] - grains[new], size)
    upto[new + size - 1] = _ALL
    first = np.zeros(int(base[-1]), np.int32)
    first[end[new]] = new
    return base, start.astype(np.int32), piece, np.minimum(upto, _ALL).astype(np.int32), first


class Lattices:
    """The piece lattices of the distinct strings seen so far."""

    def __init__(self, voc: dict, sharpness: float):
        self.voc, self.sharpness = voc, sharpness
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.base, self.start, self.piece, self.upto, self.first = np.zeros(1, np.int64), *(np.zeros(0, np.int32) for _ in range(4))
        self.begins = np.zeros(1, bool)

    def numbers(self, strings: list[str]) -> np.ndarray:
        """The number of each string, after the lattices of new ones are added."""
        if self.base[-1] > HELD:
            self._clear()
        known = self.known
        new = list(set(strings).difference(known))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            base, start, piece, upto, first = _lattices(new, self.voc, self.sharpness)
            shift = self.base[-1]
            self.first = np.concatenate([self.first, first + np.int32(len(self.start))])
            self.start = np.concatenate([self.start, start + np.int32(shift)])
            self.piece = np.concatenate([self.piece, piece])
            self.upto = np.concatenate([self.upto, upto])
            self.base = np.concatenate([self.base, base[1:] + shift])
            self.begins = np.zeros(int(self.base[-1]) + 1, bool)
            self.begins[self.base[:-1]] = True
        return np.fromiter(map(known.__getitem__, strings), np.int64, len(strings))

    def sample(self, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one drawn segmentation of each occurrence, in order, and how many each has."""
        node = self.base[which + 1] - 1
        live, seed = np.arange(len(which)), seeds
        steps, n = [], np.zeros(len(which), np.int64)
        step = 0
        while len(live):
            u = (tx.mix(seed + np.uint64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(34)).astype(np.int32)
            e = self.first[node]
            on = np.flatnonzero(self.upto[e] <= u)
            while len(on):
                e[on] += 1
                on = on[self.upto[e[on]] <= u[on]]
            steps.append((live, self.piece[e]))
            n[live] += 1
            node = self.start[e]
            on = np.flatnonzero(~self.begins[node])
            live, node, seed = live[on], node[on], seed[on]
            step += 1
        to = np.cumsum(n)
        out = np.zeros(int(to[-1]) if len(to) else 0, np.int32)
        for k, (at, piece) in enumerate(steps):
            out[to[at] - 1 - k] = piece
        return out, n


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about PART characters that end where a stretch ends."""
    at = 0
    while at < len(text):
        found = _SPACES.search(text, at + PART) if len(text) - at > PART else None
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


def encode_texts(texts: list[str | None], keys: list[str], lattices: Lattices, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and how many each has."""
    data, _ = tx.packed([f"{seed}:{k}".replace(" ", "_").replace("\n", "_") for k in keys])
    s, e = tx.words(data)
    row = tx.word_hashes(data, s, e)[: len(texts)]
    per_text = np.zeros(len(texts), np.int64)
    found, strings, owners, numbers, size = [], [], [], [], 0

    def work() -> None:
        nonlocal size
        if not strings:
            return
        which = lattices.numbers(strings)
        owner = np.concatenate(owners)
        pieces, n = lattices.sample(which, tx.mix(row[owner] + np.concatenate(numbers).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        owner = np.repeat(owner, n)
        odd = np.flatnonzero(pieces < 0)
        if len(odd):  # bytes of characters without a piece
            spell = {c: lattices.voc["bytes"][np.frombuffer(("▁" if c == _LITERAL else chr(c)).encode("utf-8", "surrogatepass"), np.uint8)] for c in np.unique(-1 - pieces[odd]).tolist()}
            odd_codes = (-1 - pieces[odd]).tolist()
            count = np.ones(len(pieces), np.int64)
            count[odd] = [len(spell[c]) for c in odd_codes]
            at = np.cumsum(count) - count
            pieces, owner = np.repeat(pieces, count), np.repeat(owner, count)
            for k, c in zip(at[odd].tolist(), odd_codes):
                pieces[k : k + len(spell[c])] = spell[c]
        per_text[:] += np.bincount(owner, minlength=len(texts))
        found.append(pieces.astype(np.int32))
        strings.clear(), owners.clear(), numbers.clear()
        size = 0

    for i, t in enumerate(texts):
        before = 0
        for part in _parts(t or ""):
            cut = _STRETCH.findall(part)
            strings.extend(cut), owners.append(np.full(len(cut), i)), numbers.append(np.arange(before, before + len(cut)))
            before += len(cut)
            size += len(part)
            if size > PART:
                work()
    work()
    return np.concatenate(found) if found else np.zeros(0, np.int32), per_text


def decode_ids(ids: np.ndarray, n: np.ndarray, raw: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the ids spell, one text after the other, and how many bytes each text has (n: ids of each)."""
    buffer, sizes = np.frombuffer(raw, np.uint8), np.diff(cuts)
    out = []
    for at in range(0, len(ids), PART):
        part = ids[at : at + PART]
        size = sizes[part]
        ends = np.cumsum(size)
        if len(part):
            out.append(buffer[np.arange(ends[-1]) + np.repeat(cuts[part] - (ends - size), size)])
    upto = np.concatenate([[0], np.cumsum(sizes[ids])])
    ends = np.cumsum(n)
    return np.concatenate(out) if out else np.zeros(0, np.uint8), upto[ends] - upto[ends - n]


def _strings(data: np.ndarray, sizes: np.ndarray, none: list[bool]):
    """Arrow strings of so many bytes each."""
    import pyarrow as pa

    cuts = np.concatenate([[0], np.cumsum(sizes)])
    texts = [None if no else data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b, no in zip(cuts[:-1].tolist(), cuts[1:].tolist(), none)]
    return pa.array(texts, pa.string())


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", path: str = PATH, sharpness: float = 1.0, seed: int = 1, check: bool = False) -> DataFrame:
    """The documents with piece_ids, an array of ints; check: and with lossless, whether they decode to the text again."""
    import pyarrow as pa

    voc = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    new = ("piece_ids", "lossless") if check else ("piece_ids",)
    cols = [c for c in docs.columns if c not in new]
    own = docs.schema[text_col].dataType.simpleString() == "string"
    text_at: str | int = cols.index(text_col) + 1 if own else "text"  # the text travels once
    source = docs.select(carried(cols), *([] if own else [F.col(f"`{text_col}`").cast("string").alias("text")]), F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit("")).alias("key"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(voc.value, sharpness)
        for b in slices(batches, text_at, 1 << 19):
            texts = field(b, text_at).to_pylist()
            ids, n = encode_texts(texts, b.column("key").to_pylist(), lattices, seed)
            none = np.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids), mask=pa.array(none))
            out = [b.column("row"), lists]
            if check:
                data, sizes = decode_ids(ids, n, voc.value["raw"], voc.value["cuts"])
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                same = [t is None or data[x:y].tobytes() == t.encode("utf-8", "surrogatepass") for t, x, y in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist())]
                out.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, ["row", *new])

    schema = with_fields(source.schema["row"], ("piece_ids", "array<int>"), *([("lossless", "boolean")] if check else []))
    return source.mapInArrow(tidied(rows), schema).select(*restored(cols), *new)


def decode(encoded: DataFrame, path: str = PATH, out_col: str = "decoded") -> DataFrame:
    """The rows with the text that piece_ids spell."""
    import pyarrow as pa

    voc = vocabulary(path)
    raw = encoded.sparkSession.sparkContext.broadcast((voc["raw"], voc["cuts"]))
    cols = [c for c in encoded.columns if c != out_col]
    source = encoded.select(carried(cols), F.col("piece_ids").cast("array<int>").alias("ids"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell, cuts = raw.value
        for b in batches:
            if not b.num_rows:
                continue
            ends = b.column("ids").offsets.to_numpy()
            at = 0
            while at < b.num_rows:  # about PART ids at a time, or one row
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART, side="right")) - 1)
                part = b.slice(at, to - at)
                lists = part.column("ids")
                n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                ids = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
                data, sizes = decode_ids(ids, n, spell, cuts)
                yield pa.RecordBatch.from_arrays([part.column("row"), _strings(data, sizes, lists.is_null().to_pylist())], ["row", "text"])
                at = to

    return source.mapInArrow(tidied(rows), with_fields(source.schema["row"], ("text", "string"))).select(*restored(cols), F.col("text").alias(out_col))
