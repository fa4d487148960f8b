"""Licence scans: word windows against licence templates by the Dice coefficient of word bigrams. DataFrame functions only.

A window has as many words as the template and may lie anywhere in the text: in a line, across lines or paragraphs. Dice
of t or more needs a share t / (2 - t) of the template's bigrams in the window, and as many of its words as can hold so
many bigrams. The number of the template's words that the text has bounds which templates a text meets, then the number
of bigrams does, then how close together so many of them stand; all this within the scan. Only the bigrams of the windows
left are sent, to the task of their text, where running counts give the Dice of all windows in one pass. Templates are a
fixed list, inlined as one literal.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellur.llm.common import read

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_CC = "This work is licensed under a Creative Commons {kind} 4.0 International License."

#: Notices, headers and texts of common licences (fixed values, from the licences themselves), by SPDX name and kind.
TEMPLATES = {
    "0BSD/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "AGPL-3.0/header": "This program " + _GNU.format(name="Affero General Public License", version="3", it="This program"),
    "AGPL-3.0/notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/text": 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. '
    '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.',
    "BSD-2-Clause/notice": "Released under the BSD 2-Clause License.",
    "BSD-2-Clause/text": f"{_BSD_HEAD} {_BSD_TAIL}",
    "BSD-3-Clause/notice": "Released under the BSD 3-Clause License.",
    "BSD-3-Clause/text": f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}",
    "BSL-1.0/text": "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC-BY-4.0/deed": _CC.format(kind="Attribution"),
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/deed": _CC.format(kind="Attribution-NonCommercial"),
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/deed": _CC.format(kind="Attribution-ShareAlike"),
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0/deed": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC0-1.0/notice": "Released into the public domain under CC0 1.0.",
    "EPL-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/header": "This program " + _GNU.format(name="General Public License", version="3", it="This program"),
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/text": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. "
    "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0/header": "This program " + _GNU.format(name="Lesser General Public License", version="3", it="This program"),
    "LGPL-3.0/notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT/grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT/notice": "Released under the MIT License.",
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
    f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL/text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Zlib/text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
LEAST_DICE = 0.8


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def kinds_of(templates: dict[str, str], least: float) -> list[dict]:
    """What the scan needs of each template: its words and bigrams, how many of each a text must have, and the window's bigrams."""
    out = []
    for name, text in sorted(templates.items()):
        words = words_of(text)
        if not (bigrams := bigrams_of(words)):
            continue
        need = math.ceil(least / (2 - least) * len(bigrams) - 1e-9)
        # Each bigram has two places for words; so few distinct words, the most frequent ones, can hold as many as are needed.
        places, few = sorted(Counter(w for b in bigrams for w in b.split()).values(), reverse=True), 0
        while sum(places[:few]) < 2 * need:
            few += 1
        out.append({"license": name, "words": sorted(set(words)), "bigrams": bigrams, "need_words": few, "need": need, "wide": len(words) - 1})
    return out


def texts_in(spark: SparkSession, folder: str, most_bytes: int = 1 << 20) -> dict[str, str]:
    """Templates from the files of a folder, such as whole licence texts, each named by its file: TEMPLATES | texts_in(...).

    They go into the plan, so a folder of more than `most_bytes` bytes is an error.
    """
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    if (n := spark.read.format("binaryFile").load(folder).agg(F.sum("length")).first()[0] or 0) > most_bytes:
        raise ValueError(f"{n} bytes of templates")
    return {r.name: r.text for r in files.collect()}


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds a column by exploding one element, which keeps Catalyst from copying its expression into those that use it."""
    ((name, x),) = columns.items()
    return df.select("*", F.explode(F.array(x)).alias(name))


def near_windows(docs: DataFrame, known: list[dict], id_col: str, text_col: str) -> DataFrame:
    """(n, doc_id, t, i, g, inside): bigrams g at places i of the windows of a row n in which enough bigrams of its template t may stand."""
    schema = "array<struct<t: int, words: array<string>, bigrams: array<string>, need_words: int, need: int, wide: int>>"
    kinds = F.from_json(F.lit(json.dumps([k | {"t": t} for t, k in enumerate(known)])), schema)  # a constant, folded once
    every = F.from_json(F.lit(json.dumps(sorted({w for k in known for w in k["words"]}))), "array<string>")
    fewest = min((k["need_words"] for k in known), default=1)
    some = sorted({g for k in known for g in k["bigrams"]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("n", F.monotonically_increasing_id()).where("text IS NOT NULL")
    rows = rows.select("n", "doc_id", F.explode(F.array(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " "))).alias("w"))
    rows = once(rows, have=F.array_intersect("w", every)).where(F.size("have") >= fewest)
    rows = once(rows, k=F.filter(kinds, lambda k: F.size(F.array_intersect("have", k["words"])) >= k["need_words"])).where(F.size("k") > 0)
    rows = once(rows.drop("have"), b=F.transform(F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - 1)), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1))))
    rows = once(rows.select("n", "doc_id", "b", "k"), met=F.filter("k", lambda k: F.size(F.array_intersect("b", k["bigrams"])) >= k["need"])).where(F.size("met") > 0)
    rows = once(rows.drop("k"), hits=F.filter(F.transform("b", lambda x, i: F.when(x.isin(some), i)), lambda i: i.isNotNull()))
    rows = rows.select("n", "doc_id", "b", "hits", F.explode("met").alias("k"))
    rows = once(rows, own=F.filter("hits", lambda i: F.array_contains("k.bigrams", F.get("b", i)))).drop("hits")
    # A window needs the next need - 1 of the template's places within its width.
    starts = F.filter(F.transform("own", lambda i, j: F.when(F.get("own", j + F.col("k.need") - 1) < i + F.col("k.wide"), i)), lambda i: i.isNotNull())
    rows = once(rows, starts=starts).where(F.size("starts") > 0)

    def fresh(i: Column, j: Column) -> Column:
        """The places of a window that the one before it doesn't have."""
        low = F.greatest(i, F.get("starts", j - 1) + F.col("k.wide"))
        high = F.least(i + F.col("k.wide"), F.size("b")) - 1
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    places = F.flatten(F.transform("starts", fresh))
    known_of = lambda i: F.get("b", i).isin(some) & F.array_contains("k.bigrams", F.get("b", i))
    return rows.select("n", "doc_id", "k.t", F.inline(F.transform(places, lambda i: F.struct(i.alias("i"), F.get("b", i).alias("g"), known_of(i).alias("inside")))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start, n_words, dice): all windows of each row's text that reach `least` for a template, but those that give way to others.

    Text is lower-cased and everything but letters and digits becomes a space; `start` counts words from 0. A window
    begins with a bigram of the template and has as many words, fewer at the text's end. It gives way to a better one of its
    template that begins at most half the template's words away: one of greater Dice or, with the same, an earlier one. Of
    those left, by falling Dice, then falling words, then names, then places, each that overlaps none taken before is taken; so a text
    with two notices gives two rows. Null and empty texts match nothing; null ids are kept; repeated rows match each;
    templates of one word never match. Texts of any length, of one line or many, are scanned whole. Other columns take no
    part. An empty table, or no templates, gives none.
    """
    known = kinds_of(templates, least)
    of = lambda f, kind: F.get(F.lit([f(k) for k in known]).cast(f"array<{kind}>"), F.col("t"))
    wide, size = of(lambda k: k["wide"], "int"), of(lambda k: len(k["bigrams"]), "int")

    # A bigram is new to the windows that begin after its last place before and up to its own: the sums of such gains and losses are running counts.
    rows = near_windows(docs, known, id_col, text_col).repartition("n")
    first = F.greatest(F.lag("i").over(Window.partitionBy("n", "t", "g").orderBy("i")) + 1, F.col("i") - wide + 1, F.lit(0))
    inside = F.col("inside").cast("int")
    change = lambda s, one, same, begins: F.struct(s.alias("start"), F.lit(one).alias("one"), same.alias("same"), begins.alias("begins"))
    changes = F.array(change(F.col("first"), 1, inside, F.lit(False)), change(F.col("i") + 1, -1, -inside, F.lit(False)), change(F.col("i"), 0, F.lit(0), F.col("inside")))
    rows = rows.withColumn("first", first).select("n", "doc_id", "t", F.inline(changes))
    run = Window.partitionBy("n", "t").orderBy("start")
    rows = rows.withColumns({"own": F.sum("one").over(run), "common": F.sum("same").over(run)}).where("begins")
    rows = rows.withColumn("dice", F.lit(2.0) * F.col("common") / (F.col("own") + size)).where(F.col("dice") >= least)

    around = Window.partitionBy("n", "t").orderBy(F.col("start") / (F.floor((wide + 1) / 2) + 0.5)).rangeBetween(-1, 1)
    best = F.max(F.struct("dice", (-F.col("start")).alias("behind"))).over(around)
    rows = rows.withColumn("best", best).where(F.col("best.behind") == -F.col("start"))
    rows = rows.select("n", "doc_id", "start", (wide + 1).alias("n_words"), of(lambda k: k["license"], "string").alias("license"), "dice")

    # Windows that reach each other by overlaps are settled together, in order.
    by_start = Window.partitionBy("n").orderBy("start", "n_words", "license")
    end = F.max(F.col("start") + F.col("n_words")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("apart", F.coalesce((F.col("start") >= end).cast("int"), F.lit(0))).withColumn("lot", F.sum("apart").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    lots = rows.groupBy("n", "doc_id", "lot").agg(F.array_sort(F.collect_list(F.struct((-F.col("dice")).alias("off"), (-F.col("n_words")).alias("less"), "license", "start"))).alias("m"))
    overlap = lambda x, y: (x["start"] < y["start"] - y["less"]) & (y["start"] < x["start"] - x["less"])
    taken = F.aggregate("m", F.slice("m", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: overlap(x, y)), kept).otherwise(F.concat(kept, F.array(x))))
    return lots.select("doc_id", F.explode(taken).alias("m")).select("doc_id", "m.license", "m.start", (-F.col("m.less")).alias("n_words"), F.round(-F.col("m.off"), 6).alias("dice"))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """doc_id, license, start, n_words, dice of all `documents`."""
    return scan(read(spark, sf_dir, "documents"))


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE) -> str:
    """The scan in SQL, every window that begins with a bigram of a template, without the pruning."""
    known = ", ".join(f"('{k['license']}', {k['wide']}, [{', '.join(f"'{x}'" for x in k['bigrams'])}])" for k in kinds_of(templates, least))
    return rf"""
WITH RECURSIVE t(license, wide, bigrams) AS (VALUES {known}),
g AS (SELECT license, wide, bigrams, unnest(bigrams) AS g FROM t),
w AS (SELECT row_number() OVER () AS n, doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT n, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM w WHERE len(w) > 1),
p AS (SELECT n, unnest(b) AS g, unnest(range(len(b))) AS start FROM b),
h AS (SELECT p.n, p.start, g.license, g.wide, g.bigrams, b.doc_id, list_distinct(b.b[p.start + 1 : p.start + g.wide]) AS own FROM p JOIN g USING (g) JOIN b ON p.n = b.n),
d AS (SELECT n, doc_id, license, start, wide + 1 AS n_words, 2.0::DOUBLE * len(list_intersect(own, bigrams)) / (len(own) + len(bigrams)) AS dice FROM h),
m AS (SELECT * FROM d WHERE dice >= {least}),
k AS (SELECT * FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.n = x.n AND y.license = x.license AND abs(y.start - x.start) <= x.n_words // 2
  AND (y.dice > x.dice OR y.dice = x.dice AND y.start < x.start))),
l AS (SELECT n, doc_id, list(struct_pack(dice, n_words, license, start) ORDER BY dice DESC, n_words DESC, license, start) AS q FROM k GROUP BY n, doc_id),
r AS (SELECT n, doc_id, q[1] AS x, q FROM l
  UNION ALL SELECT n, doc_id, q[1], q FROM (SELECT n, doc_id, list_filter(q, lambda y: y.start >= x.start + x.n_words OR x.start >= y.start + y.n_words) AS q FROM r) WHERE len(q) > 0)
SELECT doc_id, x.license AS license, x.start::INTEGER AS start, x.n_words::INTEGER AS n_words, round(x.dice, 6) AS dice FROM r
"""


ORACLE = oracle()
