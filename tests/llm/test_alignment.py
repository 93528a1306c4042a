"""The alignment of two tokenizers against plain loops over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment

SCHEMA = "doc_id long, text string, key string, pair long, side int"


def plain(texts):
    """A row for each text, by encoding it whole and by looking at every pair of tokens' byte ranges."""
    v = alignment.vocabulary(alignment.FILE_A, alignment.FILE_B)
    tokenizer = Tokenizer.from_file(alignment.FILE_A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=alignment.FILE_B)
    rows, docs = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = (tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        if b"".join(v.bytes_a[i] for i in a) != whole or b"".join(v.bytes_b[i] for i in b) != whole:
            a, b = [], []
        links, groups, cur, i, j, at_a, at_b = [], [], ([], []), 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                cur[0].append(a[i])
                at_a, i = at_a + len(v.bytes_a[a[i]]), i + 1
            else:
                cur[1].append(b[j])
                at_b, j = at_b + len(v.bytes_b[b[j]]), j + 1
            if at_a == at_b:
                groups.append(cur)
                cur = ([], [])
        for x, y in groups:
            spans = [[], []]
            for side, (ids, names) in enumerate(((x, v.bytes_a), (y, v.bytes_b))):
                at = 0
                for t in ids:
                    spans[side].append((t, at, at + len(names[t])))
                    at += len(names[t])
            links += [(p, q) for p, s, e in spans[0] for q, f, g in spans[1] if s < g and f < e]
        docs.update(set(links))
        rows.append((len(a), len(b), len(groups), links, ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)))
    most = defaultdict(int)
    for (p, _), n in docs.items():
        most[p] = max(most[p], n)
    return [(na, nb, ng, len(links), sum(docs[x] == most[x[0]] for x in links), sum(docs[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "") for na, nb, ng, links, text in rows], [r[4] for r in rows]


def made():
    rng = random.Random(11)
    words = ["the", "Überschall", "naïve", "don't", "we'll", "x1y2", "1234567", "日本語", "テスト", "éa", "😀👍🏽", "a_b", "...", "—", "!?", "<|endoftext|>", "<s>", "<0x41>", "#", "ß", " ", "　z", "́"]
    gaps = [" ", " ", " ", "  ", "   ", "\n", "\n\n ", "\t", " \n", " ", " ", "", "   ", "\r\n", "\x1c", "\x00"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 60))) for _ in range(250)]
    return [None, "", " ", "  ", " a", "a ", "\n", "x▁y", "▁", "same", "same", "﻿a", "no spaces " * 3, "q" * 3000, " " * 500, *texts]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize(("piece", "block"), [(2 << 20, 1 << 15), (400, 7), (1, 3)])
def test_matches_whole_texts(spark, monkeypatch, piece, block):
    monkeypatch.setattr(alignment, "SLICE", piece)
    monkeypatch.setattr(alignment, "BLOCK", block)
    texts = made()
    want, _ = plain(texts)
    # In this process, as workers do not see the changed sizes: events, sorted, through one machine.
    v = alignment.vocabulary(alignment.FILE_A, alignment.FILE_B)
    import numpy as np
    import pyarrow as pa

    coder, sizes = alignment._Encoder(v), np.array([len((t or "").encode()) for t in texts]) + 1
    col = lambda xs, kind: pa.array(xs, kind)
    parts = [alignment._events(coder, col(list(range(a, b)), pa.int64()), col(list(range(a, b)), pa.int64()), col(texts[a:b], pa.string())) for a, b in alignment._slices(sizes, piece)]
    table = pa.Table.from_batches(parts).sort_by([("key", "ascending"), ("at", "ascending"), ("side", "ascending")]).combine_chunks().to_batches()[0]
    machine, out = alignment._Machine(v, True), []
    for a, b in alignment._slices(np.array([len(x) for x in table["ids"].to_pylist()]) + 1, piece):
        s = table.slice(a, b - a)
        out += machine.take(s["key"].to_numpy(), s["doc_id"].to_pylist(), s["side"].to_numpy(), s["ids"])
    out.append(machine.ended())
    done = {r[1]: r for r in out if r[4]}
    assert [done[i][5:10] for i in range(len(texts))] == [(w[0], w[1], w[2], w[3], w[6]) for w in want]
    assert any(r[3] for r in out) == (piece == 400 or piece == 1)
    linked = defaultdict(int)
    for r in out:
        linked[r[1]] += sum(int(n) for n in r[11])
    assert [linked[i] for i in range(len(texts))] == [w[3] for w in want]


def test_report(spark):
    texts = made()
    want, groups = plain(texts)
    docs = rows_of(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    got = {r.doc_id: tuple(r)[1:] for r in alignment.report(docs.repartition(3), pairs=10).collect()}
    assert [got[i] for i in range(len(texts))] == want
    shown = {r.doc_id: r.groups for r in alignment.align(docs, texts=True).where("done").collect()}
    assert [shown[i] for i in range(len(texts))] == groups


def test_long_text_repeated_rows_and_nothing(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gam\nma", "日本", "x" * 40]) for _ in range(200_000))
    want, _ = plain([long, "one two", "one two", None])
    docs = spark.createDataFrame([(7, long), (1, "one two"), (1, "one two"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.report(docs).collect()), key=repr)
    assert got == sorted([(7, *want[0]), (1, *want[1]), (1, *want[2]), (None, *want[3])], key=repr)
    assert alignment.report(docs.limit(0)).count() == 0


def test_planted_pieces_are_whole_words():
    v = alignment.vocabulary(alignment.FILE_A, alignment.FILE_B)
    assert v.words and len(v.bytes_a) == 50_257 and len(v.bytes_b) == 32_000
