"""Two tokenizers' tokens of each text, aligned by an event sweep over the bytes where they end.

Each document becomes end events of both tokenizers. Events of one tokenizer that follow each other travel as one row
of token ids with the offset where it begins, since a token's bytes follow from its id. The rows are dealt by document
and sorted by offset within their partitions, and a machine streams over them. It holds the tokens since the last
offset where both tokenizers ended, a running digest and four counts, whatever the length of the document.

An end of both closes a group. Between two neighbouring ends, of either tokenizer, lies exactly one token of each, so
every end is one link, and a pair of tokens that overlaps is linked once.

Tokens never reach over the beginning of a word: a single space before a character that is no white space begins a
piece in both tokenizers (:func:`vocabulary` checks that, otherwise whole texts are encoded). Different pieces of a
batch are encoded once; results are kept in the worker up to a bound.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.scratch import discard, materialise

FILES = "/opt/tokenizers"
FILE_A, FILE_B = f"{FILES}/byte_bpe_50k.json", f"{FILES}/piece_bpe_32k.model"
#: Tokens in a row of events.
BLOCK = 1 << 15
#: Bytes of text, and of events, that are worked on at once; a longer text is worked on alone.
SLICE = 2 << 20
#: Known pieces beyond which a worker forgets them.
KEPT = 200_000
#: Pieces that are given to the tokenizers at once; what they return is several hundred bytes a piece.
BATCH = 4096
#: Rows of an Arrow batch; a batch of whole texts is small then.
ROWS = 1000
#: Different id pairs whose counts are broadcast to the documents; more are joined.
PAIRS = 1_000_000

EVENTS = "key long, doc_id long, at long, side byte, ids binary"
ALIGNED = "key long, doc_id long, part int, split boolean, done boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, ns array<int>, groups string"
_NONE, _A, _B = 0, 1, 2


class Vocabulary(NamedTuple):
    tokenizer: object
    pieces: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    sizes_a: np.ndarray
    sizes_b: np.ndarray
    kind: np.dtype
    words: bool


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def vocabulary(file_a: str, file_b: str) -> Vocabulary:
    """Both tokenizers and the bytes of their ids."""
    import sentencepiece
    from tokenizers import Tokenizer

    with open(file_a, encoding="utf-8") as f:
        told = json.load(f)
    tokenizer = Tokenizer.from_file(file_a)
    tokenizer.encode_special_tokens = True
    chars, added = _byte_chars(), {x["content"]: x["id"] for x in told["added_tokens"]}
    bytes_a = [b""] * (1 + max([*told["model"]["vocab"].values(), *added.values()]))
    for entry, i in told["model"]["vocab"].items():
        bytes_a[i] = entry.encode() if entry in added else bytes(chars[c] for c in entry)
    pieces = sentencepiece.SentencePieceProcessor(model_file=file_b)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    bytes_b = [bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    before = told.get("pre_tokenizer") or {}
    words = told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and all(" " not in n.replace("▁", " ").lstrip(" ") for n in names)
    sizes = [np.array([len(x) for x in many], dtype=np.int64) for many in (bytes_a, bytes_b)]
    return Vocabulary(tokenizer, pieces, bytes_a, bytes_b, *sizes, np.dtype("<u2" if max(len(bytes_a), len(bytes_b)) <= 1 << 16 else "<u4"), bool(words))


def _begins(data: np.ndarray, first: np.ndarray, words: bool) -> np.ndarray:
    """Where pieces begin: at each text's first byte, and at single spaces before what is surely no white space."""
    if not words:
        return first
    nxt = np.append(data[1:], 0)
    # Bytes above U+00BF's first byte but for those that some white space begins with (U+1680, U+2000, U+3000).
    solid = ((nxt > 32) & (nxt < 127)) | ((nxt > 0xC2) & (nxt != 0xE1) & (nxt != 0xE2) & (nxt != 0xE3))
    space = (data == 32) & solid
    space[1:] &= data[:-1] != 32
    space[first] = True
    return np.flatnonzero(space)


class _Encoder:
    """Token ids of pieces of texts: both tokenizers' ids of all known pieces, one piece after the other."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = [np.zeros(0, self.v.kind)] * 2
        self.sizes = [np.zeros(0, np.int64)] * 2
        self.right = np.zeros(0, bool)  # whether both give the piece's bytes

    def codes(self, found: list[bytes]) -> np.ndarray:
        """Each piece's place among the known ones; a piece begins with a space."""
        if len(self.known) > KEPT:
            self.clear()
        known = self.known
        new = [p for p in found if p not in known]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        for i in range(0, len(new), BATCH):
            self.learn(new[i : i + BATCH])
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def learn(self, new: list[bytes]) -> None:
        v, odd = self.v, []
        try:
            texts = b"\n".join(new).decode().split("\n") if not any(b"\n" in p for p in new) else [p.decode() for p in new]
        except UnicodeDecodeError:  # no text: has no tokens
            odd = [i for i, p in enumerate(new) if p.decode(errors="replace").encode() != p]
            texts = [" " if i in set(odd) else p.decode() for i, p in enumerate(new)]
        many = ([e.ids for e in v.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], v.pieces.encode([t[1:] for t in texts], num_threads=1))
        length, right = np.fromiter(map(len, new), np.int64, len(new)), np.ones(len(new), bool)
        right[odd] = False
        for side, (lists, names, widths) in enumerate(zip(many, (v.bytes_a, v.bytes_b), (v.sizes_a, v.sizes_b), strict=True)):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(itertools.chain.from_iterable(lists), v.kind, n.sum())
            owner = np.repeat(np.arange(len(new)), n)
            right &= np.bincount(owner, widths[flat], len(new)) == length
            if b"".join(map(names.__getitem__, flat.tolist())) != b"".join(new):
                right &= np.fromiter((b"".join(map(names.__getitem__, x)) == p for x, p in zip(lists, new, strict=True)), bool, len(new))
            self.ids[side], self.sizes[side] = np.concatenate([self.ids[side], flat]), np.concatenate([self.sizes[side], n])
        self.right = np.concatenate([self.right, right])


def _released() -> None:
    """Gives back what a task no longer needs: idle workers live on beside those that work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` (their lengths are ``sizes``) that ``codes`` name, one after the other."""
    starts, n = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
    return flat[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The stretches of ``data`` between neighbouring ``cuts``."""
    whole = np.ascontiguousarray(data)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * whole.itemsize).astype(np.int32)), pa.py_buffer(whole)])


def _string_data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where its values begin and end."""
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[cuts[0] : cuts[-1]], cuts - cuts[0]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``most`` bytes at most, or one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _events(coder: _Encoder, keys: pa.Array, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    v = coder.v
    data, cuts = _string_data(pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(texts, ""), ""))
    begins = _begins(data, cuts[:-1], v.words)
    chunks = _binary(data, np.append(begins, len(data))).dictionary_encode()
    codes = coder.codes(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
    doc = np.searchsorted(cuts[1:], begins, "right")
    wrong = ~coder.right[codes]
    none = np.bincount(doc, wrong, len(texts)) > 0
    none |= np.diff(cuts) == 1  # an empty text is the space alone
    use = ~none[doc]
    doc, codes = doc[use], codes[use]
    parts = []
    for side, sizes in ((0, v.sizes_a), (1, v.sizes_b)):
        n = coder.sizes[side]
        tokens = _gather(coder.ids[side], n, codes)
        per = np.bincount(doc, n[codes], len(texts)).astype(np.int64)
        blocks = -(-per // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        no = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = np.cumsum(per) - per
        start = first[owner] + no * BLOCK
        past = np.append(0, np.cumsum(sizes[tokens]))
        parts.append((owner, past[start] - past[first[owner]], np.full(len(owner), side + 1, np.int8), _binary(tokens, np.append(start, len(tokens)))))
    blank = np.flatnonzero(none)
    parts.append((blank, np.zeros(len(blank), np.int64), np.full(len(blank), _NONE, np.int8), pa.array([b""] * len(blank), pa.binary())))
    owner = np.concatenate([p[0] for p in parts])
    at, side = (pa.array(np.concatenate([p[i] for p in parts])) for i in (1, 2))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), ids.take(pa.array(owner)), at, side, pa.concat_arrays([p[3] for p in parts])], names=["key", "doc_id", "at", "side", "ids"])


def events(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, at, side, ids): the end events of both tokenizers, in rows of ids that follow each other.

    ``key`` is a row's own number (a file's rows get the same ones again if a task is repeated). ``side`` is 1 for A,
    2 for B; a document without tokens has one row of side 0. Texts are whole; ids are little-endian integers.
    """
    src = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = _Encoder(vocabulary(file_a, file_b))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy()
            for a, b in _slices(sizes + 1, SLICE):
                yield _events(coder, *[batch[c].slice(a, b - a) for c in ("key", "doc_id", "text")])
        del coder
        _released()

    return src.mapInArrow(run, EVENTS)


class _Machine:
    """Streams over sorted events. Between slices it holds one document: its tokens since the last common end, counts and digest."""

    def __init__(self, v: Vocabulary, texts: bool) -> None:
        self.v, self.texts = v, texts
        strings = [list(map(str, range(len(v.bytes_a)))), list(map(str, range(len(v.bytes_b))))]
        table = [p + s for p in ("", ";", ",") for s in strings[0]] + [p + s for p in ("|", ",") for s in strings[1]]
        self.table = pa.array(table)
        self.key: int | None = None

    def begin(self, key: int, doc_id: int | None) -> None:
        self.key, self.doc_id, self.part, self.counts, self.sha = key, doc_id, 0, [0, 0, 0], hashlib.sha256()
        self.left = [np.zeros(0, self.v.kind)] * 2
        self.held: tuple | None = None

    def ended(self) -> tuple:
        """The last row of the held document."""
        if len(self.left[0]) or len(self.left[1]):
            raise ValueError(f"document {self.doc_id}: its tokens do not end together")
        a, b, groups = self.counts
        pairs = self.held or ((), (), "")
        return self.key, self.doc_id, self.part, self.part > 0, True, a, b, groups, a + b - groups, self.sha.hexdigest() if groups else "", *pairs

    def pushed(self) -> tuple:
        """The links so far of a document that goes on."""
        row = self.key, self.doc_id, self.part, True, False, None, None, None, None, None, *self.held
        self.part, self.held = self.part + 1, None
        return row

    def take(self, keys: np.ndarray, doc_ids: list, sides: np.ndarray, blobs: pa.Array) -> list[tuple]:
        out: list[tuple] = []
        if self.key != keys[0]:
            if self.key is not None:
                out.append(self.ended())
            self.begin(int(keys[0]), doc_ids[0])
        elif self.held and len(self.held[0]):
            out.append(self.pushed())
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        row_doc = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
        docs = len(first)
        raw, cuts = _string_data(blobs)
        ids, n = np.frombuffer(raw, self.v.kind), np.diff(cuts) // self.v.kind.itemsize
        toks, ends, owner = [], [], []
        token_side = np.repeat(sides, n)
        for side, sizes in ((0, self.v.sizes_a), (1, self.v.sizes_b)):
            t = np.concatenate([self.left[side], ids[token_side == side + 1]])
            of = sides == side + 1
            per = np.bincount(row_doc[of], n[of], docs).astype(np.int64)
            per[0] += len(self.left[side])
            toks.append(t)
            owner.append(np.repeat(np.arange(docs), per))
            ends.append((np.cumsum(sizes[t]), np.cumsum(per)))
        # Every document gets a stretch of offsets of its own.
        past = [np.append(0, e)[np.append(0, c)] for e, c in ends]
        length = np.maximum(np.diff(past[0]), np.diff(past[1])) + 1
        base = np.cumsum(length) - length
        ea, eb = (e - p[:-1][o] + base[o] for (e, _), p, o in zip(ends, past, owner, strict=True))
        at = np.searchsorted(eb, ea)
        common = np.zeros(len(ea), bool)
        inside = at < len(eb)
        common[inside] = eb[at[inside]] == ea[inside]
        last = np.flatnonzero(common & (owner[0] == docs - 1))
        keep_a, keep_b = (last[-1] + 1, at[last[-1]] + 1) if len(last) else tuple(int(np.searchsorted(o, docs - 1)) for o in owner)
        left = [toks[0][keep_a:].copy(), toks[1][keep_b:].copy()]
        ta, da, ea, common, at = toks[0][:keep_a], owner[0][:keep_a], ea[:keep_a], common[:keep_a], at[:keep_a]
        tb, db, eb = toks[1][:keep_b], owner[1][:keep_b], eb[:keep_b]
        ia, ib = np.flatnonzero(common), at[common]
        na, nb, ng = np.bincount(da, minlength=docs), np.bincount(db, minlength=docs), np.bincount(da[ia], minlength=docs)

        link_cuts, pairs, ns = self._links(docs, ta, da, ea, tb, eb, ib)
        text, places = self._groups(docs, ta, ea, tb, eb, ia, ib, ng, na + nb)
        for d in range(docs):
            if d:
                out.append(self.ended())
                self.begin(int(keys[first[d]]), doc_ids[first[d]])
            self.counts = [x + int(y[d]) for x, y in zip(self.counts, (na, nb, ng), strict=True)]
            piece = text[places[d] : places[d + 1]]
            self.sha.update(piece)
            self.held = pairs[link_cuts[d] : link_cuts[d + 1]], ns[link_cuts[d] : link_cuts[d + 1]], bytes(piece).decode() if self.texts else ""
            self.left = [np.zeros(0, self.v.kind)] * 2
        self.left = left
        return out

    def _links(self, docs: int, ta: np.ndarray, da: np.ndarray, ea: np.ndarray, tb: np.ndarray, eb: np.ndarray, ib: np.ndarray) -> tuple:
        """Each document's different id pairs, as A's id times the size of B's vocabulary plus B's id, and how often each is linked."""
        alone = np.ones(len(eb), bool)
        alone[ib] = False
        every = np.sort(np.concatenate([ea, eb[alone]]), kind="stable")  # two sorted runs
        a = np.searchsorted(ea, every)
        many = len(self.v.bytes_b)
        pair = ta[a].astype(np.int64) * many + tb[np.searchsorted(eb, every)]
        span = len(self.v.bytes_a) * many
        marks, n = np.unique(da[a] * span + pair, return_counts=True)
        return np.searchsorted(marks, np.arange(docs + 1) * span), marks % span, n.astype(np.int32)

    def _groups(self, docs: int, ta: np.ndarray, ea: np.ndarray, tb: np.ndarray, eb: np.ndarray, ia: np.ndarray, ib: np.ndarray, ng: np.ndarray, n: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """All groups as text, and where each document's begin: A's ids, `|` and B's ids, `;` between groups."""
        ga, gb = np.searchsorted(ea[ia], ea), np.searchsorted(ea[ia], eb)  # the group of each token
        place_a = np.arange(len(ta)) + np.append(0, ib + 1)[ga]
        place_b = np.arange(len(tb)) + (ia + 1)[gb]
        va, vb = len(self.v.bytes_a), len(self.v.bytes_b)
        order = np.empty(len(ta) + len(tb), np.int64)
        begins_a, begins_b = np.append(True, np.diff(ga) > 0)[: len(ga)], np.append(True, np.diff(gb) > 0)[: len(gb)]
        opens = np.zeros(len(ia) + 1, bool)
        opens[(np.cumsum(ng) - ng)[ng > 0]] = True  # the first group of each document
        if self.counts[2] and ng[0]:
            opens[0] = False
        order[place_a] = ta + np.where(begins_a, np.where(opens[ga], 0, va), 2 * va)
        order[place_b] = tb + np.where(begins_b, 3 * va, 3 * va + vb)
        _, offsets, data = self.table.take(pa.array(order)).buffers()
        cuts = np.frombuffer(offsets, np.int32)[: len(order) + 1]
        return memoryview(data) if data else memoryview(b""), cuts[np.append(0, np.cumsum(n))]


_ALIGNED = pa.schema({
    "key": pa.int64(), "doc_id": pa.int64(), "part": pa.int32(), "split": pa.bool_(), "done": pa.bool_(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
    "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "ns": pa.list_(pa.int32()), "groups": pa.string(),
})


def align(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment of every document, in one row, or several for a long one: see :data:`ALIGNED`.

    ``pairs`` are the linked ids (A's id times the size of B's vocabulary plus B's id), ``ns`` how often each is linked.
    A document that the machine meets in several slices has ``split`` rows by ``part``; the one that is ``done`` has its
    counts. With ``texts``, ``groups`` holds the groups' ids as text, in order of ``part``.

    A text that is null or empty, is no UTF-8 or whose tokens do not give its bytes has one row of zeros. Null and
    repeated ids pass through, every row is a document of its own, an empty table gives an empty result, other columns
    are ignored. A worker holds the tokens of some megabytes, or of one text, and of a group that does not end.
    """
    rows = events(docs, file_a, file_b, id_col, text_col).repartition("key").sortWithinPartitions("key", "at", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        rows_out: list[tuple] = []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(_ALIGNED)], schema=_ALIGNED)

        for batch in batches:
            machine = machine or _Machine(vocabulary(file_a, file_b), texts)
            for a, b in _slices(pc.binary_length(batch["ids"]).to_numpy() + 1, SLICE):
                part = batch.slice(a, b - a)
                rows_out = machine.take(part["key"].to_numpy(), part["doc_id"].to_pylist(), part["side"].to_numpy(), part["ids"])
                if rows_out:
                    yield batch_of(rows_out)
        if machine:
            yield batch_of([machine.ended()])
        del machine
        _released()

    return rows.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, many_b: int) -> DataFrame:
    """(pair, docs, best): the documents that hold each pair linked; ``best`` where no pair of its A id has more."""
    each = aligned.select("key", "split", F.explode("pairs").alias("pair"))
    once = each.where("NOT split").select("pair").unionByName(each.where("split").select("key", "pair").distinct().select("pair"))
    counts = once.groupBy("pair").agg(F.count("*").alias("docs")).withColumn("a", F.expr(f"pair div {int(many_b)}"))
    top = counts.groupBy("a").agg(F.max("docs").alias("most"))  # as many rows as A has ids
    return counts.join(F.broadcast(top), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def report(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document; odd rows as in :func:`align`."""
    many_b = len(vocabulary(file_a, file_b).bytes_b)
    conf, batch = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(batch)
    conf.set(batch, str(ROWS))
    try:
        aligned = materialise(align(docs, file_a, file_b).drop("groups"), "aligned")
    finally:
        conf.set(batch, before)
    counts = materialise(pair_counts(aligned, many_b), "pair-counts")
    small = counts.count() <= pairs
    links = aligned.select("*", F.explode_outer(F.arrays_zip("pairs", "ns")).alias("_l")).withColumns({"pair": F.col("_l.pairs"), "n": F.col("_l.ns")})
    found = links.join(F.broadcast(counts) if small else counts, "pair", "left")
    n = F.col("n").cast("long")
    facts = [F.max(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    sums = [F.coalesce(F.sum(F.when(F.col("best"), n)), F.lit(0).cast("long")).alias("n_best"), F.coalesce(F.sum(n * F.col("docs")), F.lit(0).cast("long")).alias("count_sum")]
    return found.groupBy("key", "doc_id").agg(*facts, *sums, F.max("groups_sha256").alias("groups_sha256")).drop("key")
