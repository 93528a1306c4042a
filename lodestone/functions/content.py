"""Fingerprints and searches over file contents."""

from __future__ import annotations

import bisect
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes at the start of a file that decide whether it is binary.
SNIFF = 8000


def is_binary(content: Column) -> Column:
    """Whether a zero byte stands among the first bytes of a binary column."""
    return F.position(F.unhex(F.lit("00")), F.substring(content, F.lit(1), F.lit(SNIFF))) > 0


def has_zero(text: Column) -> Column:
    """The same for a text column."""
    return F.instr(F.left(text, F.lit(SNIFF)), "\x00") > 0


def raw_fingerprint(text: Column) -> Column:
    """SHA-256 of a text whose lines lost one carriage return each and all end with a line feed."""
    t = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\r$(?![\\s\\S])", "")
    t = F.when((t == "") | F.endswith(t, F.lit("\n")), t).otherwise(F.concat(t, F.lit("\n")))
    return F.sha2(t, 256)


def binary_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def short_fingerprint(fingerprint: Column) -> Column:
    return F.substring(fingerprint, F.lit(1), F.lit(12))


def strip_comments(text: str) -> str:
    """A text without C-like comments, blank lines and space at line ends; one block comment open at a time."""
    out, inside = [], False
    for line in text.split("\n"):
        if inside:
            _, mark, line = line.partition("*/")
            if not mark:
                continue
            inside = False
        elif "/*" in line:
            line, inside = line[: line.index("/*")], True
        else:
            line = line.partition("//")[0]
        if line := line.strip(" \t\r\x0b\x0c\xa0"):
            out.append(line)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def without_comments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else strip_comments(t))


def code_fingerprint(text: Column) -> Column:
    """SHA-256 of a text without comments; null for binary."""
    return F.when(~has_zero(text), F.sha2(without_comments(text), 256))


MATCH = "array<struct<name:string,match:string,start_byte:long,end_byte:long,start_line:long,end_line:long>>"


def find_all(patterns: Mapping[str, re.Pattern], text: str) -> list[tuple]:
    """Matches of every pattern with their place in UTF-8 bytes and lines, both from 0 and 1."""
    out, breaks = [], None
    for name, pattern in patterns.items():
        at = done = 0
        for m in pattern.finditer(text):
            if breaks is None:
                breaks = [i for i, c in enumerate(text) if c == "\n"]
            done += len(text[at : m.start()].encode("utf-8", "surrogatepass"))
            size = len(m[0].encode("utf-8", "surrogatepass"))
            out.append((name, m[0], done, done + size, bisect.bisect_left(breaks, m.start()) + 1, bisect.bisect_left(breaks, m.end()) + 1))
            at, done = m.end(), done + size
    return out


def keyword_matches(files: DataFrame, patterns: Mapping[str, str], path_col: str = "path", text_col: str = "text", skip: str | None = None) -> DataFrame:
    """(path, name, ordinal, match): matches of named patterns, in text order from 0; in the engine's own regular expressions.

    All patterns are looked for in one pass over the texts. The file at ``skip``, that of the patterns, is left out.
    """
    if skip is not None:
        files = files.where(F.col(path_col) != skip)
    one = lambda name, pattern: F.transform(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(F.lit(name).alias("name"), i.alias("ordinal"), m.alias("match")))
    every = F.concat(*[F.coalesce(one(n, p), F.array().cast("array<struct<name:string,ordinal:int,match:string>>")) for n, p in patterns.items()])
    return files.select(F.col(path_col).alias("path"), F.explode(every).alias("m")).select("path", "m.*")


def keyword_positions(files: DataFrame, patterns: Mapping[str, str], path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, name, match, start_byte, end_byte, start_line, end_line): matches with their places.

    Only files that some pattern matches reach Python. Nulls match nothing.
    """
    compiled = {n: re.compile(p) for n, p in patterns.items()}

    @F.pandas_udf(MATCH)
    def run(texts: pd.Series) -> pd.Series:
        names = ("name", "match", "start_byte", "end_byte", "start_line", "end_line")
        return texts.map(lambda t: [dict(zip(names, m, strict=True)) for m in find_all(compiled, t)])

    some = F.lit(False)
    for p in patterns.values():
        some = some | F.rlike(text_col, F.lit(p))
    hits = files.where(some).select(F.col(path_col).alias("path"), run(F.col(text_col)).alias("found"))
    return hits.select("path", F.explode("found").alias("m")).select("path", "m.*")


def ndjson(text: Column, schema: str) -> Column:
    """Lines of a text that decode to ``schema``; others are dropped."""
    rows = F.transform(F.split(text, "\n"), lambda x: F.from_json(x, schema, {"mode": "PERMISSIVE"}))
    return F.filter(rows, lambda r: r.isNotNull())


def shingles(text: Column, size: int) -> Column:
    """Word shingles of a text, space-joined; none for a text with fewer words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), cut)[0]  # the words of a text are made once, not once for each shingle
