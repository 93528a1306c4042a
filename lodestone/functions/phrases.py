"""Known phrases in texts, all of them in one pass: an automaton of words, for licence texts and other fixed wording.

Words are runs of a-z and 0-9, A-Z in lower case; everything else parts them, so that a phrase is found however it is
wrapped or punctuated. The phrases are few against the texts. Their automaton is broadcast in parts of a checked size,
and the texts are read once for each part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.content import is_binary
from lodestone.operators.rollups import match_units
from lodestone.plans.scratch import materialise
from lodestone.sources.archives import expand

#: Characters of phrases in one automaton; a worker holds some hundred bytes for each.
LIMIT = 2_000_000
_WORD = re.compile("[a-z0-9]+")
_LOW = {c: c + 32 for c in range(65, 91)}
MATCHES = "path string, name string, start_word long, end_word long, start_line long, end_line long, match string"
_MATCHES = pa.schema({"path": pa.string(), "name": pa.string(), "start_word": pa.int64(), "end_word": pa.int64(), "start_line": pa.int64(), "end_line": pa.int64(), "match": pa.string()})


def words(text: str) -> list[tuple[str, int, int]]:
    """Each word with where it begins and ends."""
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(text.translate(_LOW))]


def automaton(phrases: list[tuple[str, str]]) -> object:
    """An automaton over words that begin with a space, whose values are (words of the phrase, names); none for no phrase."""
    import ahocorasick

    known: dict[str, tuple[int, set[str]]] = {}
    for name, phrase in phrases:
        parts = [w for w, _, _ in words(phrase)]
        if parts:
            known.setdefault("".join(f" {w}" for w in parts) + " ", (len(parts), set()))[1].add(name)
    found = ahocorasick.Automaton()
    for key, (n, names) in known.items():
        found.add_word(key, (n, sorted(names)))
    if known:
        found.make_automaton()
    return found if known else None


def find(machine: object, text: str) -> list[tuple[str, int, int, int, int]]:
    """(name, first word, word after the last, begin, end) of every phrase in ``text``, those within others too."""
    spots = words(text)
    line = "".join(f" {w}" for w, _, _ in spots) + " "
    ends, at = {}, 0
    for i, (w, _, _) in enumerate(spots):
        at += len(w) + 1
        ends[at] = i
    out = []
    for last, (n, names) in machine.iter(line):
        i = ends[last]
        out += [(name, i - n + 1, i + 1, spots[i - n + 1][1], spots[i][2]) for name in names]
    return out


def phrase_matches(files: DataFrame, phrases: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every place of ``phrases`` (name, phrase) in ``files`` (path, text): see :data:`MATCHES`; words and lines count from 0 and 1.

    Null texts and phrases without a word match nothing, repeated phrases count once, repeated files are each searched.
    Names of one phrase each match. ``limit`` bounds the characters of phrases that are held at once.
    """
    spark = files.sparkSession
    known = materialise(phrases.select("name", "phrase").where("name IS NOT NULL AND phrase IS NOT NULL").distinct(), "phrases")
    total = known.agg(F.sum(F.length("phrase"))).first()[0] or 0
    parts, out = -(-total // limit), None
    for k in range(parts):
        some = known.where(F.pmod(F.xxhash64("name", "phrase"), F.lit(parts)) == k).collect()  # about the limit
        shared = spark.sparkContext.broadcast([tuple(r) for r in some])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for batch in batches:
                rows = []
                for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    for name, a, b, begin, end in find(machine, text) if machine and text else []:
                        rows.append((path, name, a, b, text.count("\n", 0, begin) + 1, text.count("\n", 0, end) + 1, text[begin:end]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MATCHES)], schema=_MATCHES)

        found = files.select("path", "text").mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], MATCHES) if out is None else out


def license_scan(files: DataFrame, phrases: DataFrame, skip: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Units (title, path, n, length) of a tree's files and of what its archives hold, and (path, problem) of broken archives.

    ``files`` (path, content binary); titles are the phrases' names. Files that look binary are not searched, nor are
    archives themselves, nor the file at ``skip``, which holds the phrases. A unit's files are its rows, one for each path.
    """
    whole = materialise(expand(files), "license-tree")
    texts = whole.where("problem IS NULL AND content IS NOT NULL").where(~is_binary(F.col("content")))
    if skip is not None:
        texts = texts.where(F.col("path") != skip)
    texts = texts.select("path", F.call_function("make_valid_utf8", F.col("content").cast("string")).alias("text"))
    return match_units(phrase_matches(texts, phrases)), whole.where("problem IS NOT NULL").select("path", "problem")
