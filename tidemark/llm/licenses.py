"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A template of m shingles of five words is looked for in windows of its size class, the smallest that holds m, a
quarter apart. Windows begin at every eighth of their size. The bands of all templates are in one table by key, a hash
table of constant arrays, so a window's templates are found without going through the list. A window and a template
share a band with near certainty where they are alike: with 20 bands of 2 rows, 0.99999 at a similarity of 0.67 (four
fifths of the shingles in common) and 0.997 at 0.5. A retrieved template matches when the window, an eighth longer on
either side, has at least ``LEAST`` of its distinct shingles.

Templates may share most of their words, as versions of a notice do. Of two such templates that match overlapping
windows the one with the larger share of its shingles stays, of equal shares the longer.

Everything is one native expression per row, without a join or a shuffle; the templates are constants in it, so their
total size is checked. Windows without any shingle of any template are left out before hashing: their bands can't agree.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import text_or_empty

SHINGLE, LEAST, BANDS, ROWS, STEPS = 5, 0.8, 20, 2, 8
_RANDOM = random.Random(11)
MASKS = [_RANDOM.getrandbits(63) for _ in range(BANDS * ROWS)]

#: Templates may have so many shingles in all: they are a constant in every task.
MOST_SHINGLES = 200_000

#: Notices by which works state their license, and the texts of the short licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


#: Files of whole licenses in license_texts, and their ids.
LONG = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
#: Words to a passage of a whole license; a rest of fewer than half as many goes with the passage before it.
PASSAGE = 150


def long_templates() -> list[tuple[str, str]]:
    """The passages of whole licenses, so that a license is found by any of them. Those that licenses share give each of these."""
    out = []
    for file, name in LONG.items():
        words = (Path(__file__).parent / "license_texts" / f"{file}.txt").read_text(encoding="utf-8").split()
        starts = list(range(0, len(words), PASSAGE))
        if len(starts) > 1 and len(words) - starts[-1] < PASSAGE // 2:
            starts.pop()
        out += [(name, " ".join(words[a:b])) for a, b in zip(starts, [*starts[1:], len(words)])]
    return out


def size_class(m: int) -> int:
    """The smallest size of windows that holds ``m`` shingles; sizes are a quarter apart."""
    size = 1
    while size < m:
        size = max(size + 1, size * 5 // 4)
    return size


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), "")


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles_of(words: Column) -> Column:
    """A hash of each five words in a row; none in texts of fewer."""
    ahead = [lambda w, i, k=k: F.get(w, i + k) for k in range(1, SHINGLE)]
    starts = F.slice(words, 1, F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *(f(words, i) for f in ahead)))


def bands_of(window: Column) -> Column:
    """Per band a hash of its number and its MinHash values: the least hash under each of its masks."""
    masks = F.array(*(F.lit(m) for m in MASKS))
    least = F.transform(masks, lambda m: F.array_min(F.transform(window, lambda h: h.bitwiseXOR(m))))
    band = lambda s, b: F.xxhash64(b, *(F.get(s, b * ROWS + r) for r in range(ROWS)))
    return _bind(least, lambda s: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: band(s, b)))


@dataclass(frozen=True)
class _Constant:
    """Templates and the tables over them, as constants of an expression."""

    templates: Column  # id, m, n, h, size, rivals
    shingles: Column  # by pmod(hash, n_shingles): the hashes
    n_shingles: int
    bands: Column  # by pmod(key, n_bands): keys with the template's number
    n_bands: int
    sizes: list[int]


def _constant(spark: SparkSession, templates: list[tuple[str, str]]) -> _Constant:
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "k int, id string, text string").select("k", "id", _bind(words_of(F.col("text")), shingles_of).alias("h"))
    found = rows.select("k", "id", F.size("h").alias("m"), F.array_distinct("h").alias("h"), bands_of(F.col("h")).alias("bands")).collect()
    found.sort(key=lambda r: r.k)
    if short := [r.id for r in found if not r.m]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    if sum(len(r.h) for r in found) > MOST_SHINGLES:
        raise ValueError(f"templates of more than {MOST_SHINGLES} shingles in all")
    sets = [set(r.h) for r in found]
    rivals = [[k for k, other in enumerate(sets) if found[k].id != r.id and 2 * len(other & own) >= len(own)] for r, own in zip(found, sets)]
    table = [{"id": r.id, "m": r.m, "n": len(r.h), "h": r.h, "size": size_class(r.m), "rivals": x} for r, x in zip(found, rivals)]
    every = sorted(set().union(*sets))
    shingles, bands = [[] for _ in range(2 * len(every) + 1)], [[] for _ in range(2 * BANDS * len(found) + 1)]
    for h in every:
        shingles[h % len(shingles)].append(h)
    for k, r in enumerate(found):
        for key in r.bands:
            bands[key % len(bands)].append({"key": key, "t": k})
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    kind = "array<struct<id: string, m: int, n: int, h: array<bigint>, size: int, rivals: array<int>>>"
    return _Constant(literal(table, kind), literal(shingles, "array<array<bigint>>"), len(shingles), literal(bands, "array<array<struct<key: bigint, t: int>>>"), len(bands), sorted({t["size"] for t in table}))


def _matches(hashes: Column, c: _Constant) -> Column:
    """Ids of the templates that match, with repeats."""
    is_one = lambda h: F.array_contains(F.get(c.shingles, F.pmod(h, F.lit(c.n_shingles)).cast("int")), h)
    hits = F.filter(F.transform(hashes, lambda h, i: F.when(is_one(h), i)), lambda i: i.isNotNull())
    template = lambda t: F.get(c.templates, t)

    def at_size(hit: Column, size: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(size / STEPS)).cast("int")
        first = lambda i: F.greatest(F.lit(0), F.floor((i - size) / step) + 1)  # noqa: E731  windows that have place i
        begins = F.array_distinct(F.flatten(F.transform(hit, lambda i: F.sequence(first(i).cast("int"), F.floor(i / step).cast("int")))))

        def found(begin: Column) -> Column:
            start = begin * step
            around = F.slice(hashes, F.greatest(start - step, F.lit(0)) + 1, size + 2 * step + F.least(start - step, F.lit(0)))
            under = lambda key: F.filter(F.get(c.bands, F.pmod(key, F.lit(c.n_bands)).cast("int")), lambda e: e["key"] == key)
            retrieved = F.array_distinct(F.flatten(F.transform(bands_of(F.slice(hashes, start + 1, size)), lambda key: F.transform(under(key), lambda e: e["t"]))))
            share = lambda t: F.size(F.array_intersect(template(t)["h"], around)) / template(t)["n"]
            scored = lambda t: F.struct(t.alias("t"), start.alias("start"), size.alias("size"), template(t)["m"].alias("m"), share(t).alias("share"))
            own = F.filter(retrieved, lambda t: template(t)["size"] == size)
            return F.filter(F.transform(own, scored), lambda x: x["share"] >= LEAST)

        return F.flatten(F.transform(begins, found))

    def best(matches: Column) -> Column:
        overlap = lambda x, y: (y["start"] < x["start"] + x["size"]) & (x["start"] < y["start"] + y["size"])
        better = lambda x, y: (y["share"] > x["share"]) | ((y["share"] == x["share"]) & (y["m"] > x["m"]))
        beaten = lambda x: F.exists(matches, lambda y: F.array_contains(template(x["t"])["rivals"], y["t"]) & overlap(x, y) & better(x, y))
        return F.transform(F.filter(matches, lambda x: ~beaten(x)), lambda x: template(x["t"])["id"])

    sizes = F.array(*map(F.lit, c.sizes))
    none = F.array().cast("array<string>")
    every = lambda hit: _bind(F.flatten(F.transform(sizes, lambda size: at_size(hit, size))), best)
    return _bind(hits, lambda hit: F.when(F.size(hit) > 0, every(hit)).otherwise(none))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row of ``docs`` (text and any others): its columns, n_matches and licenses.

    ``licenses``: the ids of the matching templates, each once, by code point, joined by commas; ``n_matches`` their
    number. These two take the place of columns of the same names. A null text is an empty one and matches nothing,
    as texts of fewer than five words. Repeated rows get equal results. An empty table gives no rows. ``templates``
    (id, text) may be any of at least five words and ``MOST_SHINGLES`` shingles in all.
    """
    constant = _constant(docs.sparkSession, templates)
    found = _bind(_bind(words_of(text_or_empty()), shingles_of), lambda h: F.array_sort(F.array_distinct(_matches(h, constant))))
    rows = docs.drop("n_matches", "licenses").select("*", found.alias("licenses"))
    return rows.withColumns({"n_matches": F.size("licenses").cast("long"), "licenses": F.array_join("licenses", ",")})


_SIZES = sorted({size_class(m) for m in range(1, 2000)})


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same by counting the template's shingles in every window, for a second engine."""
    values = ",\n    ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(templates))
    clean = lambda c: f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(SHINGLE))
    return f"""
WITH templates AS (SELECT * FROM (VALUES
    {values}) AS v(k, id, text)),
cut AS (SELECT k, id, {clean("text")} AS w FROM templates),
wanted AS (SELECT k, id, {shingle} AS s, len(w) - {SHINGLE - 1} AS m FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM cut)),
sizes(size) AS (SELECT unnest([{", ".join(str(x) for x in _SIZES)}])),
sized AS (
  SELECT k, id, m, n, size, greatest(1, size // {STEPS}) AS step
  FROM (SELECT k, id, m, count(DISTINCT s) AS n, (SELECT min(size) FROM sizes WHERE size >= m) AS size FROM wanted GROUP BY k, id, m)),
rivals AS (
  SELECT a.k AS k, b.k AS other FROM (SELECT DISTINCT k, id, s FROM wanted) a JOIN (SELECT DISTINCT k, id, s FROM wanted) b ON a.s = b.s AND a.id <> b.id
  JOIN sized ON sized.k = a.k GROUP BY a.k, b.k, sized.n HAVING 2 * count(*) >= sized.n),
docs AS (SELECT doc_id, row_number() OVER () AS uid, {clean("coalesce(text, '')")} AS w FROM documents),
spots AS (SELECT uid, i - 1 AS pos, {shingle} AS s FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM docs)),
hits AS (SELECT uid, pos, t.k, t.s FROM spots JOIN (SELECT DISTINCT k, s FROM wanted) t USING (s)),
windows AS (
  SELECT * FROM (
    SELECT uid, k, s, pos, size, step, unnest(range(greatest(0, (pos - size - step) // step), (pos + step) // step + 2)) AS b FROM hits JOIN sized USING (k))
  WHERE pos >= b * step - step AND pos < b * step + size + step),
good AS (
  SELECT uid, k, m, size, b * step AS start, share FROM (
    SELECT uid, k, b, m, sized.size, sized.step, count(DISTINCT s) / n AS share FROM windows JOIN sized USING (k) GROUP BY uid, k, b, m, n, sized.size, sized.step)
  WHERE share >= {LEAST}),
best AS (
  SELECT DISTINCT uid, k FROM good x WHERE NOT EXISTS (
    SELECT 1 FROM good y JOIN rivals r ON r.other = y.k WHERE y.uid = x.uid AND r.k = x.k AND y.start < x.start + x.size AND x.start < y.start + y.size
    AND (y.share > x.share OR y.share = x.share AND y.m > x.m))),
found AS (SELECT uid, count(DISTINCT id) AS n_matches, array_to_string(list_sort(list(DISTINCT id)), ',') AS licenses FROM best JOIN sized USING (k) GROUP BY uid)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses FROM docs LEFT JOIN found USING (uid)"""
