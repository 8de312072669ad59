"""Licence scans: the Dice coefficient of word bigrams against licence templates.

Units are each line of a text and, if it has several, the whole text; and all runs of words within a
text, across its lines, so that a notice which is wrapped or stands inside a longer line is found. Of
the licences that a line or text reaches, the best ones count; of runs that overlap, too, and none that
overlaps a line or text with the same licence or one as good. A unit's bigrams can only reach the
threshold t against a template of n bigrams if it has between n t / (2 - t) and n (2 - t) / t of
them, so templates outside these bounds are never compared; nor are units that share no bigram with
any template.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table
from .words import alphanumeric, steps, utf8, words

THRESHOLD = 0.8

# Licence notices, by identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("All-rights-reserved", "All rights reserved."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
)


def size_bounds(n: int, threshold: float) -> tuple[float, float]:
    """The least and most bigrams of a unit that can reach the threshold against n."""
    return n * threshold / (2 - threshold), n * (2 - threshold) / threshold


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashed bigrams of a run of word hashes; of a single word none."""
    return np.unique(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def _hashed(text: str) -> np.ndarray:
    data, offsets = utf8(pa.array([text]))
    return words(data, offsets, alphanumeric()).hashes


@lru_cache(maxsize=4)
def _templates(templates: tuple) -> tuple[list[tuple[str, np.ndarray]], np.ndarray]:
    own = [(name, _bigrams(_hashed(text))) for name, text in templates]
    return own, np.unique(np.concatenate([b for _, b in own]))


def compare(unit: np.ndarray, own: list[tuple[str, np.ndarray]], threshold: float) -> list[tuple[str, float]]:
    """(name, Dice coefficient) of each template that the unit's distinct bigrams reach."""
    out = []
    for name, bigrams in own:
        low, high = size_bounds(len(bigrams), threshold)
        if low - 1e-9 <= len(unit) <= high + 1e-9:
            dice = 2 * len(np.intersect1d(unit, bigrams, assume_unique=True)) / (len(unit) + len(bigrams))
            if dice >= threshold:
                out.append((name, dice))
    return out


def best(found: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Of what one unit reaches, the best licences, each once."""
    most = max((d for _, d in found), default=0)
    return list(dict.fromkeys(x for x in found if x[1] == most))


def windows(pairs: np.ndarray, bigrams: np.ndarray, threshold: float) -> list[tuple[float, int, int]]:
    """(Dice coefficient, first word, last word) of runs of words with these bigrams in order: by each
    bigram of the template the best run that begins there, if it reaches the threshold. A run in which
    the first bigram comes again has the same bigrams without it, so runs end before that."""
    n, (_, high) = len(bigrams), size_bounds(len(bigrams), threshold)
    hits = np.isin(pairs, bigrams)
    values, known, out = pairs.tolist(), hits.tolist(), []
    for i in np.flatnonzero(hits).tolist():
        seen: set[int] = set()
        common, best = 0, None
        for j in range(i, len(values)):
            v = values[j]
            if v in seen:
                if v == values[i]:
                    break
                continue
            seen.add(v)
            if len(seen) > high + 1e-9:
                break
            if known[j]:
                common += 1
                dice = 2 * common / (len(seen) + n)
                if dice >= threshold and (best is None or dice > best[0]):
                    best = (dice, i, j + 1)
        if best:
            out.append(best)
    return out


_OUT = "matches array<struct<line:int,licence:string,dice:double>>"
_MATCH = pa.list_(pa.struct([("line", pa.int32()), ("licence", pa.string()), ("dice", pa.float64())]))


def _scan(templates: tuple, threshold: float, keep: list[str]):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = _templates(templates)
        member = np.stack([np.isin(known, b) for _, b in own], axis=1)
        least = [size_bounds(len(b), threshold)[0] - 1e-9 for _, b in own]
        for b in batches:
            data, offsets = utf8(b.column("text"))
            matches: list[list[dict]] = [[] for _ in range(len(b))]
            for first, last in steps(offsets):
                lo, hi = offsets[first], offsets[last]
                part, at = data[lo:hi], offsets[first : last + 1] - lo
                found = words(part, at, alphanumeric())
                if len(found.starts) < 2:
                    continue
                pair = found.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + found.hashes[1:]
                newlines = np.flatnonzero(part == 10)
                line = np.searchsorted(newlines, found.starts)  # lines before each word in the step
                row = np.repeat(np.arange(last - first), found.counts)
                hit = np.flatnonzero(np.isin(pair, known) & (row[1:] == row[:-1]))
                if not len(hit):
                    continue
                ends = np.cumsum(found.counts)
                for r in np.unique(row[hit]):
                    begin, end = ends[r] - found.counts[r], ends[r]
                    base = np.searchsorted(newlines, at[r])
                    own_lines, taken = line[begin:end], {}
                    reached = np.zeros(end - begin)  # by word, the best of what holds it
                    for number in np.unique(own_lines[hit[(hit >= begin) & (hit < end)] - begin]):
                        on = own_lines == number
                        for n, d in best(compare(_bigrams(found.hashes[begin:end][on]), own, threshold)):
                            matches[first + r].append({"line": int(number - base), "licence": n, "dice": d})
                            taken.setdefault(n, np.zeros(end - begin, bool))[on] = True
                            reached[on] = d
                    if 10 in part[at[r] : at[r + 1]]:
                        whole = best(compare(_bigrams(found.hashes[begin:end]), own, threshold))
                        matches[first + r] += [{"line": -1, "licence": n, "dice": d} for n, d in whole]
                        taken |= {n: np.ones(end - begin, bool) for n, _ in whole}
                        reached = np.maximum(reached, max((d for _, d in whole), default=0))
                    shared = np.unique(np.searchsorted(known, pair[hit[(hit >= begin) & (hit < end)]]))
                    runs, same = [], set()
                    for t in np.flatnonzero(member[shared].sum(axis=0) >= least):
                        name, bigrams = own[t]
                        if not taken.setdefault(name, np.zeros(end - begin, bool)).all():
                            runs += [(-d, i, j, name) for d, i, j in windows(pair[begin : end - 1], bigrams, threshold)]
                    for d, i, j, name in sorted(runs, key=lambda x: (x[0], x[1] - x[2], x)):  # of equal ones the longest first
                        beaten = (reached[i : j + 1] >= -d).any() and (d, i, j) not in same
                        if not taken[name][i : j + 1].any() and not beaten:
                            same.add((d, i, j))
                            taken[name][i : j + 1] = True
                            reached[i : j + 1] = -d
                            matches[first + r].append({"line": int(own_lines[i] - base), "licence": name, "dice": -d})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(matches, _MATCH)], names=[*keep, "matches"])

    return make


def scan_licences(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key and matches, an array of (line, licence, dice); line -1 is the whole text,
    and the line of a run of words is that in which it begins.

    Words are lower-cased (A-Z) runs of digits, ASCII letters and all beyond ASCII. A unit of fewer
    than two words has no bigram and matches nothing; a null text has no match, and an empty table gives
    no rows. Of licences that tie, all are listed. The time grows with a text's length, and for a long
    text with the words in its bigrams of templates times the longest template. Repeated rows each get their row; other columns are not looked at.
    """
    source = docs.select(key, "text")
    return source.mapInArrow(_scan(templates, threshold, [key]), f"{key} {source.schema[key].dataType.simpleString()}, {_OUT}")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole text of documents."""
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.col("matches.licence"))), ",").alias("licences"),
        F.size("matches").cast("long").alias("n_matches"), F.round(F.coalesce(F.array_max("matches.dice"), F.lit(0.0)), 6).alias("best_dice"),
    )


def _sql() -> str:
    words_of = lambda c: f"regexp_extract_all(translate({c}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    bigrams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    values = ", ".join("(%d, '%s', '%s')" % (i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH t AS (SELECT id, name, {bigrams} AS b FROM (SELECT id, name, {words_of('text')} AS w FROM (VALUES {values}) AS v(id, name, text))),
u AS (
  SELECT doc_id, unnest(units) AS unit, generate_subscripts(units, 1) AS k
  FROM (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text) ELSE [text] END AS units
        FROM documents WHERE text IS NOT NULL)),
b AS (SELECT doc_id, k, {bigrams} AS b FROM (SELECT doc_id, k, {words_of('unit')} AS w FROM u) WHERE len(w) > 1),
m AS (
  SELECT DISTINCT doc_id, k, name, 2.0::DOUBLE * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS dice
  FROM b JOIN t ON len(b.b) BETWEEN len(t.b) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND len(t.b) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9),
g AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, count(*) AS n, max(dice) AS best
      FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id, k) AS most FROM m WHERE dice >= {THRESHOLD}) WHERE dice = most GROUP BY doc_id)
SELECT d.doc_id, coalesce(licences, '') AS licences, coalesce(n, 0) AS n_matches, round(coalesce(best, 0.0)::DOUBLE, 6) AS best_dice
FROM documents d LEFT JOIN g USING (doc_id)
"""


OP2_SQL = _sql()
