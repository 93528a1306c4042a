"""Benchmark decontamination by latent semantic retrieval.

Every text becomes the sequence of its words that the benchmark has too (others are a gap), once; later passes read
those sequences. One pass over all passages (PASSAGE words each) counts the passages of every term and sketches the
term counts: each passage is added, with a random sign, to one of SKETCH rows. Weighted by inverse passage frequency
the summed sketch has the row space of the TF-IDF matrix, as in randomised SVD; its right singular vectors are the
latent space. Parts are summed by term in Spark, and only the sketch (terms x SKETCH) meets in the driver.

Then windows slide over every text. A window whose latent cosine with a benchmark item reaches COSINE is a
candidate. A candidate that lacks too many of the item's different words, by a bit set, can't pass; the others are
verified in place: the longest common subsequence of item and window must hold COPY of the item's words, or
PARAPHRASE of them and the item's answer, its last ANSWER words.

Items of fewer than LEAST words are looked for as they stand: their words in a row or, for items of fewer than
SHORT words, which any text may hold by chance, a text that has no other words.

Documents are never joined with each other or moved by key, so copies and hot sources cost what other rows cost.
The benchmark is the query set; it goes over the documents in blocks of about BLOCK words.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rows import without
from lodestone.plans.scratch import discard, materialise

COPY = 0.8
PARAPHRASE = 0.65
ANSWER = 6
#: Items with fewer words match word for word, those with fewer than SHORT only a text that is nothing else.
LEAST = 8
SHORT = 4
#: Longer items are cut into parts of at most so many words; a document that holds a part leaks the item.
PART = 64
PASSAGE = 32
SKETCH = 128
RANK = 64
COSINE = 0.25
#: Words of the benchmark in one block, which bounds its terms.
BLOCK = 50_000
#: Words of a cell. Windows start at every cell, and an item takes the least number of cells that surely hold it.
CELL = 8
GAP = 10
#: Words of texts that are worked on at once; parts of longer texts overlap by OVERLAP.
CHUNK = 1 << 16
OVERLAP = 256
_TILE = 4096
_BITS = 4
_SPACED = bytes(c if chr(c) not in string.punctuation + "".join(map(chr, range(33))) else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text in lower case; ASCII punctuation and white space part them."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def parts(item: list[bytes]) -> list[list[bytes]]:
    """An item's words, cut into equal parts of at most PART words if it is longer."""
    n = -(-len(item) // PART)
    cuts = [len(item) * i // n for i in range(n + 1)] if n else []
    return [item[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, bit by bit over the item."""
    places: dict[int, int] = {}
    for i, t in enumerate(item.tolist()):
        places[t] = places.get(t, 0) | 1 << i
    row, full = (1 << item.size) - 1, (1 << item.size) - 1
    for t in text.tolist():
        if m := places.get(t):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return item.size - row.bit_count()


def judge(item: np.ndarray, text: np.ndarray) -> tuple[int, bool, bool]:
    """(words in common and in order, whether the answer is there, whether that is a leak)."""
    common = lcs(item, text)
    answer = item[-ANSWER:]
    found = 5 * lcs(answer, text) >= 4 * answer.size
    return common, found, common >= COPY * item.size or common >= PARAPHRASE * item.size and found


def sequences(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, terms): the number of each word of a text, -1 for words that the benchmark has not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.get
        for batch in batches:
            terms = []
            for text in batch["text"]:
                w = words(text.as_py())
                terms.append(np.fromiter((get(x, -1) for x in w), np.int32, len(w)).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(terms, pa.binary())], ["doc_id", "text_key", "terms"])

    src = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, text_key long, terms binary")


def _chunks(batches: Iterator[pd.DataFrame], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, passage of each, seed of each passage), some texts at a time; a passage never crosses two texts."""
    held, seeds, count = [], [], 0

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([h.size for h in held])
        rows = -(-lengths // PASSAGE)
        base = np.cumsum(rows) - rows
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        number = np.arange(rows.sum()) - np.repeat(base, rows)
        return np.concatenate(held), np.repeat(base, lengths) + at // PASSAGE, np.repeat(np.array(seeds, np.uint64), rows) + number.astype(np.uint64)

    step = size // PASSAGE * PASSAGE
    for batch in batches:
        for raw, seed in zip(batch["terms"], batch["seed"], strict=True):
            whole = np.frombuffer(raw, np.int32)
            for at in range(0, whole.size, step):
                held.append(whole[at : at + step])
                seeds.append((seed + at // PASSAGE) % (1 << 64))
                count += held[-1].size
                if count >= size:
                    yield done()
                    held, seeds, count = [], [], 0
    if count:
        yield done()


def _drawn(seeds: np.ndarray) -> np.ndarray:
    """A number below 2 * SKETCH for each seed."""
    x = seeds * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(2 * SKETCH)).astype(np.int64)


def statistics(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(passages that hold each term, sketch of term counts, all passages).

    A passage's place in the sketch is drawn from its row's id, text and its own number, so the result does not depend
    on how the rows are split; the sums are of whole numbers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((size + 1, SKETCH + 1), np.int64)
        flat = np.zeros(size * SKETCH)
        for terms, passage, seeds in _chunks(batches):
            out[size, 0] += seeds.size
            ok = terms >= 0
            t, p = terms[ok].astype(np.int64), passage[ok]
            out[:size, 0] += np.bincount(np.unique(p * size + t) % size, minlength=size)
            drawn = _drawn(seeds)  # row and sign of each passage
            flat += np.bincount(t * SKETCH + drawn[p] // 2, weights=1.0 - 2 * (drawn[p] % 2), minlength=flat.size)
        out[:size, 1:] = flat.reshape(size, SKETCH)
        some = np.flatnonzero(out.any(axis=1))
        for at in range(0, some.size, 1024):
            yield pd.DataFrame({"i": some[at : at + 1024].astype(np.int32), "v": list(out[some[at : at + 1024]])})

    src = rows.select(F.xxhash64("doc_id", "text_key").alias("seed"), "terms")
    sums = src.mapInPandas(run, "i int, v array<long>").groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(SKETCH + 1)])
    got = sums.toPandas()  # a row for each term of the block
    out = np.zeros((size + 1, SKETCH + 1))
    out[got["i"].to_numpy(np.int64)] = got.drop(columns="i").to_numpy(np.float64)
    return out[:size, 0], out[:size, 1:], int(out[size, 0])


def latent_space(counts: np.ndarray, sketch: np.ndarray, total: int, rank: int = RANK) -> np.ndarray:
    """A row for each term: its direction in the whitened latent space, as long as its weight.

    Without the common length one rare word beside a passage could outweigh all of it.
    """
    weight = np.log((total + 1) / (counts + 1)) + 0.1
    _, sigma, right = np.linalg.svd((sketch * weight[:, None]).T, full_matrices=False)
    rank = min(rank, sigma.size)
    place = right[:rank].T / np.maximum(sigma[:rank], max(sigma[0], 1e-12) * 1e-6)
    return (place / np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-12) * weight[:, None]).astype(np.float32)


class Search:
    """The items by window length, and the search for them in texts."""

    def __init__(self, items: list[np.ndarray], space: np.ndarray, cosine: float = COSINE):
        self.cosine = cosine
        self.rows = np.array([x.size for x in items])
        self.latent = np.flatnonzero(self.rows >= LEAST)  # numbers of the items that are searched by cosine
        self.exact: dict[int, dict[bytes, list[int]]] = {}
        for i in np.flatnonzero(self.rows < LEAST).tolist():
            self.exact.setdefault(items[i].size, {}).setdefault(items[i].tobytes(), []).append(i)
        self.all, items = items, [items[i] for i in self.latent]
        self.items = items
        if not items:
            return
        self.space = np.vstack([space, np.zeros((1, space.shape[1]), space.dtype)])
        drawn = np.random.default_rng(1).integers(0, 64 * _BITS, space.shape[0])
        self.bits = np.zeros((space.shape[0] + 1, _BITS), np.uint64)
        self.bits[np.arange(drawn.size), drawn // 64] = np.uint64(1) << (drawn % 64).astype(np.uint64)
        self.own = np.stack([np.bitwise_or.reduce(self.bits[x], axis=0) for x in items])
        size = np.array([x.size for x in items])
        self.lack = size - np.ceil(PARAPHRASE * size - 1e-9).astype(np.int64)  # words that a leak may lack
        cells = -(-(size + CELL - 1) // CELL)
        self.classes = [(int(c), np.flatnonzero(cells == c)) for c in np.unique(cells)]
        sums = np.stack([space[x].sum(axis=0) for x in items])
        self.vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)

    def exactly(self, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first word, word after the last) of the first place of each short item in a text."""
        for n, known in self.exact.items():
            if n < SHORT:
                for i in known.get(text.tobytes(), ()) if text.size == n else ():
                    yield i, 0, n
                continue
            if text.size < n:
                continue
            heads = np.unique([np.frombuffer(k, np.int32)[:2] for k in known], axis=0)
            pairs = (text[: text.size - n + 1].astype(np.int64) << 32) | text[1 : text.size - n + 2]
            seen = set()
            for at in np.flatnonzero(np.isin(pairs, (heads[:, 0].astype(np.int64) << 32) | heads[:, 1])).tolist():
                for i in known.get(text[at : at + n].tobytes(), ()):
                    if i not in seen:
                        seen.add(i)
                        yield i, at, at + n

    def candidates(self, grid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(items, first cells of windows, cells of these) for windows of ``grid``, whole cells of terms."""
        cells = np.take(self.space, grid, axis=0).reshape(-1, CELL, self.space.shape[1]).sum(axis=1)
        bits = np.take(self.bits, grid, axis=0).reshape(-1, CELL, _BITS)
        while bits.shape[1] > 1:
            bits = bits[:, ::2] | bits[:, 1::2]
        bits = bits[:, 0]
        w, wide = cells, np.vstack([bits[:1], bits[:-1]]) | bits  # wide: a cell more on either side
        wide[:-1] |= bits[1:]
        classes = dict(self.classes)
        for n in range(1, max(classes) + 1):
            if n > 1:
                w = w[:-1] + cells[n - 1 :]
                wide = wide[:-1].copy()
                wide[: bits.shape[0] - n] |= bits[n:]
            who = classes.get(n)
            if who is None:
                continue
            least = self.cosine * np.sqrt(np.einsum("ij,ij->i", w, w)) + 1e-9
            for at in range(0, w.shape[0], _TILE):
                for j in range(0, who.size, _TILE):
                    some = who[j : j + _TILE]
                    near, which = np.nonzero(w[at : at + _TILE] @ self.vectors[some].T >= least[at : at + _TILE, None])
                    near, which = near + at, some[which]
                    ok = np.bitwise_count(self.own[which] & ~wide[near]).sum(axis=1) <= self.lack[which]
                    if ok.any():
                        yield which[ok], near[ok], n

    def found(self, texts: list[np.ndarray]) -> dict[tuple[int, int], tuple]:
        """(text, item) -> (words in common, answer there, minus the first word, word after the last) of the best window."""
        out: dict[tuple[int, int], tuple] = {}
        if not self.items:
            return out
        padded = [-(-x.size // CELL) + GAP for x in texts]  # windows hang over both ends and never hold two texts
        first = np.cumsum([GAP, *padded])
        grid = np.full(int(first[-1]) * CELL, -1, np.int32)
        for x, at in zip(texts, first, strict=False):
            grid[at * CELL : at * CELL + x.size] = x
        for which, near, n in self.candidates(grid):
            text = np.maximum(np.searchsorted(first, near + n, side="left") - 1, 0)  # the last text that starts before the window's end
            for i, s, t in zip(which.tolist(), near.tolist(), np.minimum(text, len(texts) - 1).tolist(), strict=True):
                low = max(0, (s - 1 - int(first[t])) * CELL)
                high = min(texts[t].size, (s + n + 1 - int(first[t])) * CELL)
                common, answer, leak = judge(self.items[i], texts[t][low:high])
                if leak:
                    new = (common, answer, -low, high)
                    key = (t, int(self.latent[i]))
                    out[key] = max(out.get(key, new), new)
        return out


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """(doc_id, text_key, item_id, part, item_words, common_words, answer_found, start_word, end_word): leaked items.

    One row for each document and part of an item that it holds, with the words [start_word, end_word) in which the
    most of it was found. Null items, items without words and null texts match nothing; an empty table on either side
    gives an empty result. Null ids and repeated rows are judged like others, text_key (a hash of the text) tells them
    apart; equal items are reported each. Other columns are ignored.
    """
    spark = docs.sparkSession
    src = bench.select("item_id", "text").where("text IS NOT NULL")
    n_words = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-n_words // (6 * BLOCK)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    schema = "doc_id long, text_key long, item_id long, part int, item_words int, common_words int, answer_found boolean, start_word int, end_word int"
    for b in range(blocks):
        rows = src.where(block == b).collect()  # a block of the query set: about BLOCK words
        named, texts = [], []
        for item_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r)):
            w = words(text)
            for p, piece in enumerate(parts(w)):
                named.append((item_id, p))
                texts.append(piece)
        if not texts:
            continue
        known = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        items = [np.array([known[w] for w in t], np.int32) for t in texts]
        rows = materialise(sequences(docs, known, id_col, text_col), "bench-sequences")
        space = latent_space(*statistics(rows, len(known)))
        found = materialise(_matches(rows, items, named, space, cosine, schema), "bench-leaks")
        discard(rows)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _matches(rows: DataFrame, items: list[np.ndarray], named: list[tuple], space: np.ndarray, cosine: float, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, space, cosine)
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            held: list[tuple[int, int, np.ndarray]] = []  # row, offset, part of its terms

            def done() -> None:
                for (t, i), (common, answer, start, end) in search.found([x for _, _, x in held]).items():
                    row, at, _ = held[t]
                    new = (common, answer, start - at, end + at)
                    best[row, i] = max(best.get((row, i), new), new)
                held.clear()

            words_held = 0
            for row, raw in enumerate(batch["terms"]):
                terms = np.frombuffer(raw.as_py(), np.int32)
                for i, start, end in search.exactly(terms):
                    best[row, i] = (end - start, True, -start, end)
                for at in range(0, max(1, terms.size - OVERLAP), CHUNK - OVERLAP):
                    held.append((row, at, terms[at : at + CHUNK]))
                    words_held += held[-1][2].size + GAP * CELL
                    if words_held >= CHUNK:
                        done()
                        words_held = 0
            if held:
                done()
            keys = sorted(best)
            out = [(*named[i], items[i].size, best[row, i][0], best[row, i][1], -best[row, i][2], best[row, i][3]) for row, i in keys]
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
            took = pa.array([row for row, _ in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(took), batch["text_key"].take(took), *map(pa.array, cols, kinds)], [x.split()[0] for x in schema.split(", ")])

    return rows.where(F.length("terms") > 0).mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``bench``, columns as they are."""
    return without(docs, leaks(docs, bench, id_col, text_col, cosine), doc_id=F.col(id_col).cast("long"), text_key=F.xxhash64(text_col))
