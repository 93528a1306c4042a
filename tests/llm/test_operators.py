"""Each numbered operator against a plain version of it, with odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import chat, decontamination, html, licenses, lines, mixing, passages, quality, sharding, simhash

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "ta", "zen") for b in ("bra", "del", "fon", "gis", "pol") for c in ("n", "st", "x", "t")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, first: int = 1):
    rows = [(first + i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 3), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, "x " * 60_000, None, "s", 1), (5, "same row here", "en", "s", 1), (5, "same row here", "en", "s", 1)]
    extra = ", line string, fp long, key long, shard int, topic string, kept boolean, terms binary, _id long, host string"
    return spark.createDataFrame([(*r, "l", 1, 2, 3, "t", True, b"b", 9, "h") for r in rows], DOCS + extra)


# 1: lines


def plain_lines(texts):
    """Kept (doc, line number): groups of similar lines by all pairs, the first occurrence stays."""
    rows = []
    for d, t in enumerate(texts):
        for i, line in enumerate((t or "").split("\n")):
            norm = re.sub(r"[\x00-/:-@\[-`{-\x7f]+", " ", line).lower().strip()
            if norm:
                rows.append((d, i, norm))
    root = {n: n for _, _, n in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if 5 * distance(a, b) <= max(len(a), len(b)):
            root[find(a)] = find(b)
    seen, kept = set(), set()
    for d, i, n in rows:
        if find(n) not in seen:
            seen.add(find(n))
            kept.add((d, i))
    return kept


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_match_all_pairs(spark):
    rng = random.Random(1)
    base = [prose(rng, 12) for _ in range(6)]
    texts = []
    for _ in range(12):
        picked = [rng.choice(base) for _ in range(3)] + [prose(rng, 8)]
        picked[0] = picked[0].upper() + "!!"
        picked[1] = picked[1].replace("a", "o", 1) if rng.random() < 0.5 else picked[1]
        texts.append("\n".join(picked))
    got = lines.line_groups(documents(spark, texts, 0)).where("keep").select("doc_id", "line_no").collect()
    want = plain_lines(texts)
    assert {tuple(r) for r in got} == want


def test_long_lines(spark):
    """Edits count in letters at every length: a wrong letter in a tenth of the words makes a near copy."""
    rng = random.Random(21)
    near, many = prose(rng, 300), prose(rng, 1500)
    typed = " ".join(w[:-1] + "q" if rng.random() < 0.1 else w for i, w in enumerate(many.split()))
    texts = [near, near.replace(" ", " edit ", 1), many, many + " tail", prose(rng, 300), many, typed]
    got = {r.doc_id: r.keep for r in lines.line_groups(documents(spark, texts)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False}


def test_lines_without_spaces(spark):
    rng = random.Random(22)
    base = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60)) for _ in range(20)]
    near = [b[:30] + "\u3042" + b[31:] for b in base]
    got = {r.doc_id for r in lines.line_groups(documents(spark, base + near, 0)).where("NOT keep").collect()}
    assert got == set(range(20, 40))


def test_lines_of_hot_keys(spark):
    """A phrase in many lines that have nothing else in common joins none; near copies among them are found still."""
    rng = random.Random(23)
    phrase = "please read the terms of use"
    base = [f"{prose(rng, 12)} {phrase} {prose(rng, 12)}" for _ in range(120)]
    near = [b.replace(b.split()[3], "edited", 1) for b in base[:40]]
    got = {r.doc_id for r in lines.line_groups(documents(spark, base + near, 0)).where("NOT keep").collect()}
    assert got == set(range(120, 160))


def test_lines_of_one_hot_key(spark):
    """Near copies that share no key but one that very many lines hold, in blocks of any size, are linked all the same."""
    rng = random.Random(24)
    rows = [("the common key", prose(rng, 6)) for _ in range(90)]
    rows += [(k, t.replace("a", "o", 1)) for k, t in rows[40:70]]
    named = [(i + 1, 10 * i, len(t), t, [7, 1000 + i]) for i, (_, t) in enumerate(rows)]
    table = spark.createDataFrame(named, "h1 long, h2 long, n int, norm string, keys array<long>")
    near = {(a[0], b[0]) for a, b in itertools.combinations(named, 2) if 5 * distance(a[3], b[3]) <= max(a[2], b[2])}
    assert len(near) >= 20
    for block in (7, 512):
        got = [(r.a, r.b) for r in lines.line_links(table, block).collect()]
        root = {i: i for i, *_ in named}
        for a, b in got * 3:
            root[a] = root[b] = min(root[a], root[b])
        assert all(root[a] == root[b] for a, b in near) and set(got) <= near


def test_lines_bounds_keep_all_similar(spark):
    """What spares a pair of lines its texts: no pair of similar lines, most pairs that share a phrase alone."""
    rng = random.Random(25)
    phrase = prose(rng, 12)
    base = [f"{prose(rng, 14)} {phrase} {prose(rng, 14)}" for _ in range(40)] + [prose(rng, 8) for _ in range(10)]
    near = [" ".join(w + "s" if rng.random() < 0.3 else "x" if rng.random() < 0.05 else w for w in b.split()) for b in base]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(base + near)], "line long, norm string")
    rows = rows.select("line", "norm", lines.coded(F.col("norm")).alias("coded"), lines.traits(F.col("norm")).alias("traits"))
    pairs = rows.alias("x").join(rows.alias("y"), F.expr("x.line < y.line"))
    like = pairs.select("x.line", F.col("y.line").alias("other"), lines.similar("x.norm", "y.norm", "x.coded", "y.coded").alias("like"), lines._possible("x.traits", "y.traits").alias("may")).collect()
    assert sum(r.like for r in like) >= 30 and all(r.may for r in like if r.like)
    assert sum(r.may for r in like if not r.like) <= 0.35 * len(like)


def test_lines_odd_and_empty(spark):
    odd = odd_documents(spark)
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert lines.drops(lines.line_groups(odd.limit(0))).count() == 0


def test_lines_common_line_keeps_first_only(spark):
    rng = random.Random(3)
    texts = [f"{prose(rng, 9)}\nRead the terms of use before you go on" for _ in range(60)]
    out = {r.doc_id: r.text for r in lines.dedup_lines(documents(spark, texts)).collect()}
    assert sum("terms of use" in t for t in out.values()) == 1 and "terms of use" in out[1]


@pytest.mark.parametrize(("n_words", "edits", "least"), [(5, 1, 1.0), (6, 1, 1.0), (12, 1, 1.0), (12, 2, 1.0), (20, 1, 1.0), (20, 4, 0.9), (40, 1, 1.0), (40, 8, 0.9)])
def test_lines_with_changed_words(spark, n_words, edits, least):
    """Near copies by edit similarity alone: no fingerprint decides what is compared."""
    rng = random.Random(100 * n_words + edits)
    base = [prose(rng, n_words) for _ in range(100)]
    near = []
    for b in base:
        w = b.split()
        for k in rng.sample(range(n_words), edits):
            w[k] = "".join(reversed(w[k][:4])) + w[k][4:]
        near.append(" ".join(w))
    alike = [i for i, (a, b) in enumerate(zip(base, near, strict=True)) if a != b and 5 * distance(a, b) <= max(len(a), len(b))]
    assert len(alike) > 50
    got = {r.doc_id for r in lines.line_groups(documents(spark, base + near, 0)).where("NOT keep").collect()}
    caught = sum(100 + i in got for i in alike) / len(alike)
    print(f"recall of {n_words} words, {edits} changed: {caught:.3f} of {len(alike)}")
    assert caught >= least


# 2: passages


def test_passages_found_and_clean_left(spark):
    rng = random.Random(5)
    shared = prose(rng, 70)
    near = shared.split()
    near[20] = "other"
    texts = [prose(rng, 90) + " " + shared + " " + prose(rng, 40), prose(rng, 10) + " " + shared, prose(rng, 30) + " " + " ".join(near) + " " + prose(rng, 30), prose(rng, 200), shared[:150]]
    found = passages.near_duplicate_passages(documents(spark, texts)).collect()
    docs = {r.doc_id for r in found} | {r.match_doc_id for r in found}
    assert docs == {1, 2, 3}
    for r in found:
        a, b = texts[r.doc_id - 1].split()[r.start_word : r.end_word], texts[r.match_doc_id - 1].split()[r.match_start : r.match_end]
        one, two = {tuple(a[i : i + 5]) for i in range(len(a) - 4)}, {tuple(b[i : i + 5]) for i in range(len(b) - 4)}
        assert len(a) >= 50 and len(b) >= 50 and len(one & two) / len(one | two) >= 0.8


def test_passages_recall_against_brute_force(spark):
    rng = random.Random(8)
    shared = [prose(rng, rng.randrange(55, 120)) for _ in range(15)]
    texts, want = [], defaultdict(list)
    for i in range(60):
        s = rng.randrange(15)
        want[s].append(i + 1)
        texts.append(f"{prose(rng, rng.randrange(60))} {shared[s]} {prose(rng, rng.randrange(60))}")
    found = passages.near_duplicate_passages(documents(spark, texts)).collect()
    near = defaultdict(set)
    for r in found:
        near[r.doc_id].add(r.match_doc_id)
        near[r.match_doc_id].add(r.doc_id)
    linked = sum(any(o in near[d] for o in ids if o != d) for ids in want.values() for d in ids if len(ids) > 1)
    assert linked >= 0.97 * sum(len(ids) for ids in want.values() if len(ids) > 1)
    group = {d: s for s, ids in want.items() for d in ids}
    assert all(group[a] == group[b] for a in near for b in near[a])


def test_compact_windows_cover_every_subsequence():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 60, 40, dtype=np.uint64)
    l, c, r = passages.compact_windows(x, np.array([0]), np.array([40]), 5)  # noqa: E741
    for i in range(40):
        for j in range(i + 4, 40):
            hit = [k for k in range(l.size) if l[k] <= i <= c[k] <= j <= r[k]]
            assert len(hit) == 1 and (x[c[hit[0]]] >> np.uint64(6)) == (x[i : j + 1] >> np.uint64(6)).min()


def test_passages_of_an_id_with_several_texts(spark):
    rng = random.Random(31)
    one, two = prose(rng, 70), prose(rng, 70)
    rows = [(1, f"{prose(rng, 20)} {one}"), (1, f"{two} {prose(rng, 20)}"), (1, f"{two} {prose(rng, 30)}"), (2, f"{prose(rng, 5)} {one}"), (3, two), (3, two), (4, prose(rng, 90))]
    found = passages.near_duplicate_passages(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)).collect()
    assert {(r.doc_id, r.match_doc_id) for r in found} >= {(2, 1), (1, 1)} and {r.doc_id for r in found} | {r.match_doc_id for r in found} == {1, 2, 3}


def test_passages_hold_true_jaccard_pairs(spark):
    """All pairs of 60-word stretches by brute force: those at Jaccard 0.9 are found, what is found is at 0.8."""
    rng = random.Random(32)
    base = [prose(rng, 60).split() for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        w = list(b)
        for k in rng.sample(range(60), rng.choice([1, 1, 2, 4, 12])):
            w[k] = "edit"
        texts.append(" ".join(w))
    grams = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    share = {(j + 1, i + 1): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in range(50) for j in range(i + 1, 50)}
    got = {(r.doc_id, r.match_doc_id) for r in passages.near_duplicate_passages(documents(spark, texts)).collect()}
    near = {p for p, s in share.items() if s >= 0.8}
    assert len(near) > 10 and len(near & got) >= 0.9 * len(near)
    assert all(share[p] >= 0.6 for p in got)  # a found passage of 50 words is similar, its text of 60 may be less so


def test_passages_around_a_frequent_one(spark):
    """Exact passages of 60 words, 45 of them in very many documents, and frequent ones that only later documents hold whole."""
    rng = random.Random(33)
    common, long = prose(rng, 45), prose(rng, 40)
    texts = [f"{prose(rng, 30)} {common} {prose(rng, 30)}" for _ in range(120)]
    for i in range(30):
        tail = prose(rng, 15)
        texts += [f"{prose(rng, 20)} {common} {tail} {prose(rng, 20)}", f"{prose(rng, 25)} {common} {tail} {prose(rng, 12)}"]
    texts += [f"{prose(rng, 20)} {common} {long} {prose(rng, 20)}" for _ in range(25)]
    found = passages.near_duplicate_passages(documents(spark, texts)).collect()
    got = {(r.match_doc_id, r.doc_id) for r in found}
    assert got >= {(121 + 2 * i, 122 + 2 * i) for i in range(30)}
    root = {i: i for i in range(181, 206)}
    for a, b in sorted(p for p in got if p[0] > 180) * 3:
        root[a] = root[b] = min(root[a], root[b])
    assert set(root.values()) == {181} and not any(b <= 120 for _, b in got)


def test_tokens_around_a_place_once_each():
    """Every token within reach has one row with its places, at the ends of a text as well."""
    x = np.array([5, 7, 7, 7, 9, 7, 5, 3], np.uint64)
    for c, reach in ((0, 2), (3, 2), (7, 3), (4, 50)):
        u, lo, hi, places = passages.tokens_around(x, c, reach)
        want = defaultdict(list)
        for i in range(max(0, c - reach), min(8, c + reach + 1)):
            want[int(x[i])].append(i - c)
        assert [(a, b, d) for a, b, d in zip(u.tolist(), lo.tolist(), hi.tolist(), strict=True)] == [(k, min(v), max(v)) for k, v in sorted(want.items())]
    same, moved = passages.tokens_around(x, 2, 1), passages.tokens_around(x[1:], 1, 1)
    assert all(np.array_equal(a, b) for a, b in zip(same, moved, strict=True))
    assert passages.tokens_around(x, 4, 1)[3].tolist() != passages.tokens_around(x[[7, 4, 7, 7, 7]], 2, 1)[3].tolist()


def test_passages_odd_and_empty(spark):
    assert passages.near_duplicate_passages(odd_documents(spark)).count() == 0
    assert passages.near_duplicate_passages(odd_documents(spark).limit(0)).count() == 0


# 3: decontamination


def brute_leaks(texts, items):
    """(doc, item) by LCS over every window of a text."""
    out = set()
    for i, item in items.items():
        w = decontamination.words(item)
        for d, t in enumerate(texts, 1):
            x = decontamination.words(t)
            ids = {v: k for k, v in enumerate(dict.fromkeys(w + x))}
            a, b = np.array([ids[v] for v in w]), np.array([ids[v] for v in x], np.int64)
            size = int(1.4 * a.size) + 8
            if any(decontamination.judge(a, b[s : s + size])[2] for s in range(max(1, b.size - size + 1))):
                out.add((d, i))
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(7)
    items = {i: prose(rng, rng.randrange(12, 60)).capitalize() + "." for i in range(12)}
    texts = []
    for k in range(60):
        item = items[k % 12].split()
        if k < 12:
            item = items[k].split()
        elif k < 24:  # a paraphrase keeps the answer
            for at in rng.sample(range(len(item) - 6), len(item) // 6):
                item[at] = "changed"
        elif k < 36:  # glued marks, other case
            item = [w.upper() + "%%%" for w in item]
        else:  # a third of an item is no leak
            item = item[: len(item) // 3]
        texts.append(f"{prose(rng, rng.randrange(80))} {' '.join(item)} {prose(rng, rng.randrange(80))}")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(documents(spark, texts), bench).collect()}
    want = brute_leaks(texts, items)
    assert {(d, i) for d, i in want if d <= 36} and len(got & want) >= 0.95 * len(want) and got <= want
    kept = {r.doc_id for r in decontamination.drop_contaminated(documents(spark, texts), bench).collect()}
    assert kept == set(range(1, 61)) - {d for d, _ in got}


def test_short_items_match_as_they_stand(spark):
    bench = spark.createDataFrame([(1, "Bra ka lo mi."), (2, "two words"), (3, " .. "), (4, "a longer item of six words")], "item_id long, text string")
    texts = ["x bra, ka lo mi y", "bra ka mi lo", "Two words!", "two words more", "of a longer item of six words and on", None, ""]
    got = {(r.doc_id, r.item_id, r.start_word, r.end_word) for r in decontamination.leaks(documents(spark, texts), bench).collect()}
    assert got == {(1, 1, 1, 5), (3, 2, 0, 2), (5, 4, 1, 7)}


def test_latent_space_does_not_depend_on_the_split(spark):
    rng = random.Random(33)
    docs = documents(spark, [prose(rng, 90) for _ in range(40)])
    known = {w.encode(): i for i, w in enumerate(WORDS)}
    one, two = (decontamination.statistics(decontamination.sequences(docs.repartition(n), known, "doc_id", "text"), len(known)) for n in (1, 5))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all() and one[2] == two[2]


def test_lcs_is_lcs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in "ab")
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.lcs(np.array(a), np.array(b)) == t[-1, -1]


def test_leaks_odd_and_empty(spark):
    bench = spark.createDataFrame([(1, None), (None, "same row here and more words than eight of them"), (2, ""), (3, "tiny item")], "item_id long, text string")
    assert decontamination.leaks(odd_documents(spark), bench).count() == 0
    long_item = spark.createDataFrame([(None, "x " * 300)], "item_id long, text string")
    found = decontamination.leaks(odd_documents(spark), long_item).collect()
    assert {r.doc_id for r in found} == {4} and {r.part for r in found} == {0, 1, 2, 3, 4}
    assert decontamination.leaks(odd_documents(spark), bench.limit(0)).count() == 0
    assert decontamination.leaks(odd_documents(spark).limit(0), long_item).count() == 0
    kept = decontamination.drop_contaminated(odd_documents(spark), long_item)
    assert kept.columns == odd_documents(spark).columns and kept.count() == 6


# 4: mixing


def test_rake_meets_targets(spark):
    cells = spark.createDataFrame([(s, x, t, 100.0 * (1 + 3 * (s == "a") + 2 * (x == "en"))) for s in "abc" for x in ("en", "de") for t in ("p", "q")], "source string, lang string, topic string, tokens double")
    targets = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": {"en": 0.4, "de": 0.6}, "topic": {"p": 0.9, "q": 0.1}}
    got = mixing.rake(cells, targets, rounds=20).toPandas()
    for axis, want in targets.items():
        assert got.groupby(axis)["weight"].sum().to_dict() == pytest.approx(want, abs=1e-6)


def test_mix_keeps_the_asked_share(spark):
    rng = random.Random(2)
    docs = documents(spark, [prose(rng, 20) for _ in range(4000)])
    got = mixing.mix(docs, share=0.3).toPandas()
    assert abs(got["n_tokens"][got["kept"]].sum() / got["n_tokens"].sum() - 0.3) < 0.03
    same = {r.doc_id for r in mixing.sample(docs, share=0.3).collect()}
    assert same == set(got["doc_id"][got["kept"]])


def test_mix_odd_and_empty(spark):
    odd = odd_documents(spark)
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.sample(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


# 5: shards


@pytest.mark.parametrize("n", [0, 1, 5, 23, 24, 25, 1000])
def test_shards_are_even_and_gapless(spark, n):
    got = sharding.shard(documents(spark, [f"t{i}" for i in range(n)])).toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == n and (n == 0 or counts.max() - counts.reindex(range(24), fill_value=0).min() <= 1)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sorted(got["row_no"]) == list(range(n))
    if n == 1000:
        assert abs(np.corrcoef(got.sort_values("row_no")["shard"], np.arange(n))[0, 1]) < 0.1


def test_shard_columns(spark):
    got = {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in sharding.shard(odd_documents(spark)).collect()}
    assert (None, 13, zlib.crc32(b"a b c"), "rows", None) in got and (1, 8, 0, "rows", None) in got and (4, 120_008, zlib.crc32(b"x " * 60_000), "rows", None) in got


# 6: quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    rows = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(rows) - len(set(rows)), len(covered)


def test_base_counts(spark):
    rng = random.Random(6)
    texts = ["", None, "a b\n a b\na b\n\n\n", "%% ## x|y <b>", "a b c d e f a b c d e f", "x " * 30, "\x0bone\x0ctwo\x1fthree\xa0four", "é " * 3, *[" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(40)]]
    got = {r.doc_id: r for r in quality.judge(documents(spark, texts)).collect()}
    for i, t in enumerate(texts, 1):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t), repr(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)


def test_outliers_are_rejected_and_clean_kept(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(40, 200)) for _ in range(300)]
    bad = ["### $$$ %%% &&& " * 3 + prose(rng, 12) for _ in range(20)]
    got = {r.doc_id: r.kept for r in quality.judge(documents(spark, texts + bad)).collect()}
    assert all(got[i] for i in range(1, 301)) and not any(got[i] for i in range(301, 321))


def test_distance_is_mahalanobis(spark):
    """The last step's distances against numpy, from the same centre and covariance."""
    rng = random.Random(10)
    rows = quality.statistics(documents(spark, [prose(rng, rng.randrange(30, 90)) + " #" * rng.randrange(3) for _ in range(200)])).withColumn("g", __import__("pyspark").sql.functions.lit("a"))
    shape = quality.estimates(rows.select("g", *quality.STATS)).toPandas().iloc[0]
    low = np.array([[shape[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    centre = np.array([shape[f"m{i}"] for i in range(4)])
    frame = rows.join(spark.createDataFrame(shape.to_frame().T.infer_objects()), "g").select(*quality.STATS, quality._distance().alias("d")).toPandas()
    x = frame[list(quality.STATS)].to_numpy() - centre
    want = np.einsum("ij,jk,ik->i", x, np.linalg.inv(low @ low.T), x)
    assert np.allclose(frame["d"], want)


def plain_mcd(x, rng):
    """FAST-MCD: logarithm of the least determinant over many starts of five points."""
    best = None
    floor = np.diag(np.square(quality.FLOOR))
    for _ in range(60):
        some = x[rng.choice(len(x), 5, replace=False)]
        centre, cov = some.mean(axis=0), np.cov(some.T, bias=True) + floor
        for _ in range(40):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = x[d <= np.quantile(d, quality.H)]
            centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) * quality.GROW + floor
        det = np.linalg.slogdet(cov)[1]
        best = (det, centre, cov) if best is None or det < best[0] else best
    return best


def test_estimates_reach_the_least_determinant(spark):
    rng = np.random.default_rng(34)
    rows, want = [], {}
    for g in range(3):
        mix = np.eye(4) + 0.3 * rng.normal(size=(4, 4))
        clean, far = rng.normal(size=(240, 4)) @ mix, rng.normal(size=(60, 4)) * 0.5 + 8 * (g + 1)
        x = np.vstack([clean, far])
        want[str(g)] = plain_mcd(x, rng)
        rows += [(str(g), *map(float, v)) for v in x]
    got = quality.estimates(spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double")).toPandas().set_index("g")
    for g, (det, centre, _) in want.items():
        assert got.loc[g, "det"] <= det + 0.1
        assert np.allclose([got.loc[g, f"m{i}"] for i in range(4)], centre, atol=0.2)


def test_a_text_may_fail_in_one_group_only(spark):
    rng = random.Random(35)
    odd = " ".join(w + "#" for w in prose(rng, 60).split())
    rows = [(i, " ".join(w + "#" * (i % 2) for w in prose(rng, 60).split()), "en" if i % 2 else "de", "s", 1) for i in range(200)]
    rows += [(900, odd, "en", "s", 1), (900, odd, "de", "s", 1)]
    kept = [(r.doc_id, r.lang) for r in quality.keep_good(spark.createDataFrame(rows, DOCS)).collect() if r.doc_id == 900]
    assert kept == [(900, "en")]


def test_quality_odd_and_empty(spark):
    odd = odd_documents(spark)
    assert quality.judge(odd).count() == odd.count() and quality.keep_good(odd).columns == odd.columns
    assert quality.judge(odd.limit(0)).count() == 0 and quality.keep_good(odd.limit(0)).count() == 0


# 7: SimHash


def plain_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def test_simhash_matches_brute_force(spark):
    rng = random.Random(11)
    texts = ["", None, "one", "Two Words", "É Ü x y", "a\x1cb c d", "\x0b \x0c"]
    base = [prose(rng, 150) for _ in range(8)]
    for _ in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash.simhash_groups(documents(spark, texts)).collect()}
    prints = {i: plain_simhash(t) for i, t in enumerate(texts, 1)}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r.component_id for d, r in got.items()} == plain_components(prints)


def test_near_links_with_small_chunks(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(60)}
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = simhash.near_links(rows, chunk=7).collect()
    unsigned = lambda x: x % (1 << 64)
    assert all((unsigned(r.a) ^ unsigned(r.b)).bit_count() <= 3 for r in links)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        x, y = find(unsigned(r.a)), find(unsigned(r.b))
        root[max(x, y)] = min(x, y)
    assert {p: find(p) for p in prints} == plain_components({p: p for p in prints})


def test_near_dedup_keeps_other_texts_of_an_id(spark):
    rng = random.Random(36)
    a, b, c = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (6, c), (7, b)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (5, b), (6, c)]


def test_simhash_odd_and_empty(spark):
    odd = odd_documents(spark)
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "5", "None"]
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


# 8: pages


def page(i, article):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><div class=banner2>Follow our site today</div><article>{article}</article><footer>f</footer></body></html>"


def test_page_text(spark):
    cases = [
        ("<h1>A &amp; B</h1><p>one\n  two<br>three</p><p>un<b>bold</b> <script>x()</script>end", "A & B\none two three\nunbold end"),
        ("<p>&lt;tag&gt; &#233;&#x41;&nbsp;z</p><!-- no --><ul><li>i<li>j</ul>", "<tag> éA z\ni\nj"),
        ("<div class='comments'><p>first!</p></div><p>kept</p><form><input>q</form>", "kept"),
        ("", ""),
    ]
    rows = [(i, f"http://h{i}.example.com/x", page(i, a)) for i, (a, _) in enumerate(cases)] + [(8, None, None), (9, "http://x/y", ""), (10, "http://x/y", "plain text only")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert got[8].text == "" and got[9].text == "" and got[10].text == "plain text only"


def test_site_templates_go(spark):
    block = "<div><p>Read more on our site</p></div>"
    rows = [(i, "https://Host.example.com:80/a", f"<body><main>{block}<p>story number {i}</p></main></body>") for i in range(40)]
    rows += [(100 + i, f"http://h{i}.org/", f"<body><main>{block}<p>story {i}</p></main></body>") for i in range(20)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story number 3" and got[105] == "Read more on our site\nstory 5"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def site(i, menu=9):
    links = "".join(f"<li><a href='/{i}/{k}'>topic {i * 7 + k}</a></li>" for k in range(menu))
    return f"<body><div class='zz1'><ul>{links}</ul></div><div class='zz2'>deal {i} of today</div><h1>Head {i}</h1><p>story {i} that is told here</p><p>its end {i}</p><div class='zz3'>&copy; site {i}</div></body>"


def test_templates_alone_clean_a_site(spark):
    """Class names mean nothing here, texts differ from page to page, and no element names the article."""
    rows = [(i, "https://host.example.com/a", site(i)) for i in range(30)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), names=False).collect()}
    assert got == {i: f"Head {i}\nstory {i} that is told here\nits end {i}" for i in range(30)}


def test_menu_of_one_section_goes(spark):
    """A menu on a third of a host's pages is a template there."""
    menus = ["<div class=x><a href=/a>alpha</a> <a href=/b>beta</a></div>", "<section><a href=/c>gamma</a></section>", "<ul><li><a href=/d>delta</a></ul>"]
    rows = [(i, "https://h.example.com/a", f"<body>{menus[i % 3]}<p>story {i}</p></body>") for i in range(60)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), names=False).collect()}
    assert got == {i: f"story {i}" for i in range(60)}


def test_long_quoted_attributes(spark):
    long = "a > b " * 40_000
    pages_ = [f"<p title=\"{long}\">kept</p>", "<p title=\"never closed>one</p><p>two</p>", "<a title='it\"s'>x</a> y"]
    assert [html.main_text(p) for p in pages_] == ["kept", "one\ntwo", "x y"]


def test_pages_with_odd_columns_and_repeated_rows(spark):
    row = (1, "http://h/", "<p>text</p>", "e", 5, ["t"], 7)
    src = spark.createDataFrame([row, row, (None, None, None, None, None, None, None)], "page_id long, url string, html string, text string, hash long, templates array<string>, _salt long")
    got = html.extract(src)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted((str(r.page_id), r.text, r.n_chars) for r in got.collect()) == [("1", "text", 4), ("1", "text", 4), ("None", "", 0)]


def test_copied_articles_are_no_template(spark):
    rows = [(i, "http://h/", "<article><div><p>the same article</p></div></article>") for i in range(50)]
    assert {r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"the same article"}


# 9: chats


def test_chat_round_trip(spark):
    rng = random.Random(13)
    bits = ["</turn>", "###", "\\", "\n", "{{ x }}", "{% if %}", "é", "### Assistant: ", "", ":", " ok", "#", "<"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Tool:x", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(6)))) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(99, 0, "assistant", None), (None, 0, "user", "x"), (98, 1, None, "y"), (98, None, "user", "z")]
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((t is not None, t or 0, role or "", text or ""))
    for c, own in turns.items():
        own = [(r, x) for _, _, r, x in sorted(own)]
        loss = "".join(x for r, x in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("text", ["#" * n for n in range(1, 9)] + ["<</turn>", "</turn></turn>", "\\###", "\\\\</turn>", "#\\##", "# # ## ####x"])
def test_no_control_string_survives(text):
    got = chat.escape(text)
    assert chat.unescape(got) == text and not any(c in got for c in chat.CONTROLS)
    formatted, spans = chat.compile_template()([{"role": "assistant", "text": text}, {"role": "#" + text, "text": ""}])
    assert chat.read_back(formatted) == [("assistant", text), ("#" + text, "")] and [formatted[a:b] for a, b in spans] == [got]


def test_large_and_null_ids_stay_apart(spark):
    big = 9_007_199_254_740_992
    rows = [(big, 0, "user", "a", "x"), (big + 1, 0, "user", "b", "x"), (None, 0, "user", "c", "x")]
    src = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {(r.conv_id, r.n_turns) for r in chat.digest(chat.format_conversations(src)).collect()}
    assert got == {(big, 1), (big + 1, 1), (None, 1)}


def test_templates():
    render = chat.compile_template("{% for m in messages %}{% if loop.first and 1 < 2 %}[{{ m.role | upper }}]{% else %}{% generation %}{{ m['text'] + '!' }}{% endgeneration %}{% endif %}{% endfor %}")
    assert render([{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]) == ("[USER]a!", [(6, 8)])
    folded = chat.fold_body(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}"))
    assert folded == [("out", ("const", "abcd"))]
    for bad in ("{% for x %}{% endfor %}", "{{ m.__class__() }}", "{% if x %}", "{{ x | nosuch }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert chat.compile_template("{{ x.__class__ }}")([])[0] == ""


# 10: licences


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    texts = [mit, "Some prose.\nReleased under the MIT License.\nmore", "x\n// SPDX-License-Identifier: Apache-2.0\ny", "no grant in here, only a licensee", None, "", "Licensed under CC BY-NC 4.0. And more.\nReleased under the MIT License."]
    got = {r.doc_id: r.licenses for r in licenses.scan(documents(spark, texts)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "", 5: "", 6: "", 7: "CC-BY-NC-4.0|MIT"}
    assert licenses.scan(odd_documents(spark)).count() == 7 and licenses.scan(odd_documents(spark).limit(0)).count() == 0


def test_every_license_rule_wrapped(spark):
    """Each rule's sentences as one paragraph in lines of 72 columns, plain and as a comment."""
    sentence = {}
    for text, name in licenses.SENTENCES.items():
        sentence.setdefault(name, text)
    full = lambda t: t if t[-1] in ".:;" else t + (";" if "either version" not in t else ".")
    rules = [(name, " ".join(full(sentence[i]) for i in ids)) for name, ids in licenses.RULES]
    texts = [t for _, body in rules for t in (textwrap.fill(body, 72), textwrap.fill(body, 72, initial_indent=" * ", subsequent_indent=" * "))]
    got = {r.doc_id: r.licenses for r in licenses.scan(documents(spark, texts)).collect()}
    missed = [(rules[i // 2][0], texts[i][:60]) for i in range(len(texts)) if rules[i // 2][0] not in got[i + 1].split("|")]
    assert not missed


def test_clean_part_of_a_worn_passage_counts():
    """A stretch that is not similar enough as a whole still holds the part that is."""
    rng = np.random.default_rng(0)
    draw = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    same, worn = draw(60), draw(60)
    other = worn.copy()
    other[::8] = draw(8)
    other[4::8] = draw(7)
    found = passages.aligned(np.concatenate([worn, same]), np.concatenate([other, same]), 46)
    assert len(found) == 1 and found[0][3] == 119 and found[0][2] <= 60 and found[0][4] >= 0.8


def test_licenses_of_very_long_texts(spark):
    """An attribution file: rules that wait for a sentence that comes after very many others, or never."""
    name = lambda i: next(t for t, x in licenses.SENTENCES.items() if x == i)
    grant = next(ids for n, ids in licenses.RULES if n == "BSD-3-Clause" and len(ids) > 1)
    many = ["Released under the MIT License."] * 200_000
    texts = ["\n".join([name(grant[0]), *many]), "\n".join([name(grant[0]), *many, *map(name, grant[1:])]), "\n".join([name(grant[0])] * 50_000 + [name(i) for i in grant[1:]])]
    got = {r.doc_id: (r.n_known, r.licenses) for r in licenses.scan(documents(spark, texts)).collect()}
    assert got[1] == (200_001, "MIT") and got[2][0] == 200_000 + len(grant) and "BSD-3-Clause" in got[2][1].split("|") and got[3][1] == "BSD-3-Clause"


def test_license_runs_are_lazy_patterns():
    rng = random.Random(10)
    for _ in range(2000):
        ids = tuple(rng.choice(["a", "ab", "b", "c"]) for _ in range(rng.randrange(1, 4)))
        text = "," + "".join(rng.choice(["a", "ab", "b", "c", "d"]) + "," for _ in range(rng.randrange(12)))
        assert re.sub(licenses._run(ids), ",", text) == re.sub(licenses.pattern(ids), ",", text)
