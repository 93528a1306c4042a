"""Licence recognition by sentences, with DataFrame functions only.

A text is cut into sentences twice: at line ends, and, with lines joined, at sentence marks and empty lines. A
sentence is normalised (ASCII letters and digits in lower case, everything else one space) and looked up in a
table of known licence sentences. The identifiers found, in text order, form a sequence, and the ordered rules
are matched against it: a rule is a run of identifiers that may have others between them; a match uses its run
up, so a later, more general rule doesn't claim it again. All of it happens within a row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts, notices and headers, each with its identifier.
SENTENCES: dict[str, str] = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "mitGrant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mitNotice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "mitAsIs",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "iscGrant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "iscGrant",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsdGrant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsdSource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsdBinary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsdNoEndorse",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:": "bsdAdvert",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.": "bsdAsIs",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache2Grant",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache2Named",
    "you may not use this file except in compliance with the License.": "apache2Compliance",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache2Link",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl2Plus",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl3Plus",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl2Only",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl21Plus",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.": "lgpl3Plus",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gnuNoWarranty",
    # what sentence marks leave of the GNU sentences above
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gplTerms",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl3Terms",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl2OnlyTerms",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgplTerms",
    "either version 2 of the License, or (at your option) any later version.": "gnuV2Plus",
    "either version 2.1 of the License, or (at your option) any later version.": "gnuV21Plus",
    "either version 3 of the License, or (at your option) any later version.": "gnuV3Plus",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "gnuUseful",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gnuImplied",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl2",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v.": "mpl2Head",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Licensed under the Apache License, Version 2.0.": "apache2Line",
    "Licensed under the Apache License 2.0.": "apache2Line",
    "Released under the Apache License, Version 2.0.": "apache2Line",
    "Released under the MIT License.": "mitLine",
    "Licensed under the MIT License.": "mitLine",
    "This project is licensed under the MIT License.": "mitLine",
    "Licensed under the BSD License.": "bsdLine",
    "Released under the BSD License.": "bsdLine",
    "Licensed under the BSD 3-Clause License.": "bsd3Line",
    "Licensed under the BSD 2-Clause License.": "bsd2Line",
    "This work is licensed under the GNU General Public License, version 3.": "gpl3Line",
    "Licensed under the GNU General Public License, version 3.": "gpl3Line",
    "This work is licensed under the GNU General Public License, version 2.": "gpl2Line",
    "Licensed under the GNU General Public License, version 2.": "gpl2Line",
    "Licensed under the GNU Lesser General Public License, version 3.": "lgpl3Line",
    "Licensed under the Mozilla Public License, version 2.0.": "mpl2",
    "Licensed under CC BY 4.0.": "ccBy4",
    "Licensed under CC BY-SA 4.0.": "ccBySa4",
    "Licensed under CC BY-NC 4.0.": "ccByNc4",
    "Licensed under CC BY-ND 4.0.": "ccByNd4",
    "Licensed under CC BY-NC-SA 4.0.": "ccByNcSa4",
    "Licensed under CC BY-NC-ND 4.0.": "ccByNcNd4",
    "Licensed under CC0 1.0.": "cc0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "ccBy4",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "ccBySa4",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "ccByNc4",
    "SPDX-License-Identifier: MIT": "mitLine",
    "SPDX-License-Identifier: Apache-2.0": "apache2Line",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd3Line",
    "SPDX-License-Identifier: BSD-2-Clause": "bsd2Line",
    "SPDX-License-Identifier: ISC": "iscGrant",
    "SPDX-License-Identifier: GPL-2.0-only": "gpl2Only",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl2Plus",
    "SPDX-License-Identifier: GPL-3.0-only": "gpl3Line",
    "SPDX-License-Identifier: GPL-3.0-or-later": "gpl3Plus",
    "SPDX-License-Identifier: MPL-2.0": "mpl2",
    "All rights reserved.": "allRights",
}
#: In order: the first rules are the specific ones.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-4-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdAdvert", "bsdNoEndorse", "bsdAsIs")),
    ("BSD-3-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdNoEndorse", "bsdAsIs")),
    ("BSD-2-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdAsIs")),
    ("MIT", ("mitGrant", "mitNotice", "mitAsIs")),
    ("Apache-2.0", ("apache2Named", "apache2Compliance")),
    ("Apache-2.0", ("apache2Grant",)),
    ("GPL-2.0-or-later", ("gpl2Plus", "gnuNoWarranty")),
    ("GPL-3.0-or-later", ("gpl3Plus", "gnuNoWarranty")),
    ("GPL-2.0-or-later", ("gplTerms", "gnuV2Plus", "gnuUseful", "gnuImplied")),
    ("GPL-3.0-or-later", ("gpl3Terms", "gnuUseful", "gnuImplied")),
    ("GPL-2.0-or-later", ("gplTerms", "gnuV2Plus")),
    ("GPL-3.0-or-later", ("gpl3Terms",)),
    ("GPL-2.0-only", ("gpl2OnlyTerms",)),
    ("LGPL-2.1-or-later", ("lgplTerms", "gnuV21Plus")),
    ("LGPL-3.0-or-later", ("lgplTerms", "gnuV3Plus")),
    ("GPL-2.0-only", ("gpl2Only",)),
    ("GPL-2.0-or-later", ("gpl2Plus",)),
    ("GPL-3.0-or-later", ("gpl3Plus",)),
    ("LGPL-2.1-or-later", ("lgpl21Plus",)),
    ("LGPL-3.0-or-later", ("lgpl3Plus",)),
    ("MPL-2.0", ("mpl2",)),
    ("MPL-2.0", ("mpl2Head",)),
    ("ISC", ("iscGrant",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("mitLine",)),
    ("Apache-2.0", ("apache2Line",)),
    ("BSD-3-Clause", ("bsd3Line",)),
    ("BSD-2-Clause", ("bsd2Line",)),
    ("BSD-unspecified", ("bsdLine",)),
    ("GPL-2.0-only", ("gpl2Line",)),
    ("GPL-3.0-only", ("gpl3Line",)),
    ("LGPL-3.0-only", ("lgpl3Line",)),
    ("CC-BY-4.0", ("ccBy4",)),
    ("CC-BY-SA-4.0", ("ccBySa4",)),
    ("CC-BY-NC-4.0", ("ccByNc4",)),
    ("CC-BY-ND-4.0", ("ccByNd4",)),
    ("CC-BY-NC-SA-4.0", ("ccByNcSa4",)),
    ("CC-BY-NC-ND-4.0", ("ccByNcNd4",)),
    ("CC0-1.0", ("cc0",)),
)
#: Each known sentence holds one of these in some case, so a text without any has no identifiers.
ANCHORS = ("licen", "permi", "copyright", "warrant", "unencumbered", "advertising", "all rights")

PUNCTUATION = "[^a-z0-9]+"
MARKS = r"[.!?:;]+\s+|\n\s*\n"


def normalised(sentence: str) -> str:
    """What the column functions make of a sentence."""
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in sentence.lower()).strip()


def known() -> dict[str, str]:
    """Identifier of each normalised sentence."""
    found = {" ".join(normalised(s).split()): i for s, i in SENTENCES.items()}
    if missing := [s for s in found if not any(a in s for a in ANCHORS)]:
        raise ValueError(f"no anchor in {missing}")
    return found


def pattern(ids: tuple[str, ...]) -> str:
    """A rule as a regular expression over ``,id,id,id,``."""
    return "," + ",(?:[A-Za-z0-9]+,)*?".join(ids) + ","


def _ids(parts: Column, table: Column) -> Column:
    found = F.transform(parts, lambda s: F.try_element_at(table, F.trim(F.regexp_replace(F.lower(s), PUNCTUATION, " "))))
    return F.filter(found, lambda x: x.isNotNull())


def _run(ids: tuple[str, ...]) -> str:
    """:func:`pattern` for Java's engine: what lies between two identifiers is passed over in a loop that never goes back, so it needs no stack."""
    return "," + "".join(f"(?:(?!{i},)[A-Za-z0-9]++,)*+{i}," if k else f"{i}," for k, i in enumerate(ids))


def _matched(sequence: Column) -> Column:
    """Names of the rules that match ``,id,...,``, in the rules' order.

    A rule is tried if all its identifiers are there, and only up to the last place of its last one.
    """
    fields = lambda name, ids: F.struct(F.lit(name).alias("name"), F.lit(_run(ids)).alias("p"), F.array(*[F.lit(f",{i},") for i in ids]).alias("ids"))
    rules = F.array(*[fields(name, ids) for name, ids in RULES])
    start = F.struct(sequence.alias("s"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, r: Column) -> Column:
        there = F.forall(r["ids"], lambda i: F.contains(acc["s"], i))
        tail = F.call_function("substring_index", acc["s"], F.element_at(r["ids"], -1), F.lit(-1))
        head = F.substring(acc["s"], F.lit(1), F.length(acc["s"]) - F.length(tail))
        left = F.regexp_replace(head, r["p"], F.lit(","))
        found = F.struct(F.concat(left, tail).alias("s"), F.concat(acc["names"], F.array(r["name"])).alias("names"))
        return F.when(there & F.regexp_like(head, r["p"]), found).otherwise(acc)

    return F.aggregate(rules, start, step, lambda acc: acc["names"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_known, sentence_ids, licenses) for every row.

    sentence_ids: identifiers joined by commas, those of lines and then those of sentences that lines don't give;
    licenses: names of matched rules, ascending, joined by `|`, '' if none; n_known: identifiers found. A null or
    empty text has none; null ids and repeated rows pass through; an empty table gives an empty result; other
    columns are ignored. Rules are matched in one pass over a text's identifiers each, however many there are.
    """
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    worth = F.lit(False)
    for a in ANCHORS:
        worth = worth | F.contains(low, F.lit(a))
    by_line = _ids(F.split(text, "\n"), table)
    by_mark = _ids(F.split(text, MARKS), table)
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(worth, F.struct(by_line.alias("l"), by_mark.alias("s"))).alias("f"))
    rows = rows.select("doc_id", F.coalesce("f.l", none).alias("l"), F.coalesce("f.s", none).alias("s"))
    rows = rows.select("doc_id", F.when(F.size("l") + F.size("s") > 0, F.concat("l", F.array_except("s", "l"))).alias("ids"), "l", "s")
    join = lambda a: F.concat(F.lit(","), F.array_join(a, ","), F.lit(","))
    names = F.when(F.col("ids").isNull(), F.lit("")).otherwise(F.array_join(F.array_sort(F.array_union(_matched(join("l")), _matched(join("s")))), "|"))
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_known"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("sentence_ids"), names.alias("licenses"))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    keys, values = zip(*known().items(), strict=True)
    table = f"MAP([{', '.join(map(q, keys))}], [{', '.join(map(q, values))}])"
    ids = lambda parts: f"list_filter(list_transform({parts}, lambda s: m[trim(regexp_replace(lower(s), {q(PUNCTUATION)}, ' ', 'g'))]), lambda x: x IS NOT NULL)"
    names = []
    for col in ("l", "s"):
        seq = f"(',' || array_to_string({col}, ',') || ',')"
        arms = []
        for name, rule in RULES:
            arms.append(f"CASE WHEN regexp_matches({seq}, {q(pattern(rule))}) THEN {q(name)} END")
            seq = f"regexp_replace({seq}, {q(pattern(rule))}, ',', 'g')"
        names.append(f"[{', '.join(arms)}]")
    return f"""
WITH t AS MATERIALIZED (SELECT {table} AS m),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, {ids("string_split(text, chr(10))")} AS l, {ids(f"regexp_split_to_array(text, {q(MARKS)})")} AS s FROM d CROSS JOIN t),
g AS (SELECT doc_id, l, s, l || list_distinct(list_filter(s, lambda x: NOT list_contains(l, x))) AS ids FROM f)
SELECT doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_sort(list_distinct(list_filter({names[0]} || {names[1]}, lambda x: x IS NOT NULL))), '|') AS licenses
FROM g"""
