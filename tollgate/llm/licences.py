"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

A passage is a line that speaks of licences or copyright, or a sentence that does, over line ends and comment marks, up
to a blank line, a copyright line or the end of the comment; a whole notice, which is a run of paragraphs that all speak
so; and of a licence file (LICENSE, COPYING, MIT-LICENSE.txt, ...) the whole text. Passages and templates, which are short
notices, the headers that licences ask for, and the whole texts of short licences, are weighted vectors of their words; a
word's weight is its count times its inverse document frequency among all passages, words that no template has counting
as seen once. A passage has the template of the largest cosine, if that is `least` or more; a file has that of its best
passage. A claim of all rights only counts where no passage has a licence, as grants commonly come with it. Equal
passages are scored once. A file without a licence of its own inherits that of the nearest directory above it, its own
included, that holds a licence file with one.

Passages that hold more than one ten-thousandth of all rows are joined by broadcast, of which there are ten thousand at
most; the others are joined by shuffle, so no hot passage lands in one task.

Cases: null and empty texts have no licence of their own; a null path lies in no directory and inherits nothing; ties go
to the licence first in the alphabet, and among licence files of one directory to the best cosine, then to that order;
repeated rows are scanned alike and all kept; an empty table gives an empty one; other columns but the text are kept,
except those named as the new ones, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import quoted, stored

LEAST = 0.6
CUE = r"(?i)licen[sc]e|copyright|all[\W_]+rights[\W_]+reserved|public[\W_]+domain|spdx-|unlicense|permission[\W_]+(?:is[\W_]+hereby[\W_]+granted|to[\W_]+use)|redistributions?[\W_]+(?:and|in|of)[\W_]|neither[\W_]+the[\W_]+name|software[\W_]+is[\W_]+provided"
MARK = r"[^\S\n]*(?:#|//|/?\*|--|;|%|<!--)"
#: Where a comment begins or ends, and copyright lines.
EDGES = [(rf"(?m)^({MARK}[^\n]*)\n(?!{MARK})", "$1\n\n"), (rf"(?m)^(?!{MARK})([^\n]*)\n(?={MARK})", "$1\n\n"), (r"(?im)^([^\w\n]*copyright\s*(?:\(c\)|\u00a9|\d{4})[^\n]*)$", "\n\n$1\n\n")]
FILE = r"(?i)(^|/)(?:(?:un)?(?:licen[sc]es?|copying|copyright|notice)(?:[-._][^/]*)?|[a-z0-9.]+[-_](?:licen[sc]e|copying)(?:\.(?:txt|md|rst|html?))?)\z"
#: Between paragraphs, which are blank lines but for comment marks.
BLANK = r"\n[^\w\n]*\n"
#: The claim that counts only where no passage has a licence.
CLAIM = "Proprietary"
#: A passage is hot with this share of all rows: one in so many.
HOT = 10_000
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"

# The wording of licences, as their stewards publish it.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_TERM = ", provided that the above copyright notice and this permission notice appear in all copies."
ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
APACHE_TITLE = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/

TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GNU = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License
as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later
version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details.

You should have received a copy of the GNU {name} Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
GNU_TITLE = "GNU {NAME} PUBLIC LICENSE Version {version}, {dated}"
GNU_KINDS = [
    ("AGPL-3.0", "Affero General", "3", "19 November 2007"),
    ("GPL-2.0", "General", "2", "June 1991"),
    ("GPL-3.0", "General", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser General", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General", "3", "29 June 2007"),
]
CREATIVE = [("CC-BY-4.0", "CC BY 4.0", "Attribution"), ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Attribution-NonCommercial"), ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Attribution-ShareAlike")]
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense"]
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "To the extent possible under law, all copyright and related rights are waived under CC0 1.0; public domain."),
    ("ISC", "Licensed under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates() -> list[tuple[str, str]]:
    """Licence and text of every template."""
    out = list(NOTICES)
    out += [(re.sub("-only|-or-later", "", name), f"SPDX-License-Identifier: {name}") for name in SPDX]
    for name, kind, version, dated in GNU_KINDS:
        header = GNU.format(name=kind, version=version)
        out += [(name, header), (name, header.partition("\n\n")[0]), (name, f"Licensed under the GNU {kind} Public License, version {version}.")]
        out += [(name, f"This work is licensed under the GNU {kind} Public License, version {version}."), (name, GNU_TITLE.format(NAME=kind.upper(), version=version, dated=dated))]
    for name, short, kind in CREATIVE:
        out += [(name, f"Licensed under {short}."), (name, f"This work is licensed under a Creative Commons {kind} 4.0 International License.")]
    out += [("MIT", MIT), ("MIT", f"{MIT}\n\n{MIT_REST}"), ("BSD-2-Clause", f"{BSD}\n\n{BSD_REST}"), ("BSD-3-Clause", f"{BSD}\n\n{BSD_THIRD}\n\n{BSD_REST}")]
    out += [("ISC", ISC + ISC_TERM), ("ISC", f"{ISC}{ISC_TERM}\n\n{ISC_REST}"), ("0BSD", f"{ISC}.\n\n{ISC_REST}"), ("Unlicense", UNLICENSE)]
    out += [("Apache-2.0", APACHE), ("Apache-2.0", APACHE_TITLE), ("MPL-2.0", MPL)]
    return out


TEMPLATES: list[tuple[str, str]] = templates()


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def passages(text: Column, path: Column) -> Column:
    """The distinct passages of a text, as their terms joined by spaces."""
    edged = text
    for edge, new in EDGES:
        edged = F.regexp_replace(edged, edge, new)
    parts = F.concat(F.split(text, r"(?<=[.?])\s+|\n"), F.split(edged, rf"(?<=[.?])(?<! v\.)\s+|{BLANK}"))
    notices = F.split(F.array_join(F.transform(F.split(edged, BLANK), lambda s: F.when(s.rlike(CUE), s).otherwise("\x00")), "\n\n"), "\x00")
    said = F.filter(F.concat(parts, notices), lambda s: s.rlike(CUE))
    said = F.when(path.rlike(FILE), F.concat(said, F.array(text))).otherwise(said)
    joined = F.filter(F.transform(said, lambda s: F.array_join(terms(s), " ")), lambda s: s != "")
    return F.coalesce(F.when(text.rlike(CUE), F.array_distinct(joined)), F.array().cast("array<string>"))


def digest(passage: Column) -> Column:
    """What stands for a passage in joins; a whole licence beside each of its terms would take the square of its length."""
    return F.unhex(F.md5(passage))


def similar(found: DataFrame, least: float) -> DataFrame:
    """key, licence, similarity of the passages (key, passage, n: how many rows have it) that are like a template."""
    spark = found.sparkSession
    counts = [(k, name, Counter(re.findall(TERM, text.lower()))) for k, (name, text) in enumerate(TEMPLATES)]
    vocabulary = sorted({t for _, _, c in counts for t in c})
    words = F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "term string"))  # those of TEMPLATES
    seen = found.select(F.explode(F.array_distinct(F.split("passage", " "))).alias("term"), "n").join(words, "term").groupBy("term").agg(F.sum("n").alias("n"))
    seen = {r.term: r.n for r in seen.collect()}
    total = (found.agg(F.sum("n")).first()[0] or 0) + len(counts)
    idf = {t: math.log((1 + total) / (1 + seen.get(t, 0) + sum(t in c for _, _, c in counts))) + 1 for t in vocabulary}
    other = math.log((1 + total) / 2) + 1
    rows = []
    for k, name, c in counts:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(t, k, name, n * idf[t] ** 2 / norm, idf[t]) for t, n in c.items()]
    weights = F.broadcast(spark.createDataFrame([(t, idf[t]) for t in vocabulary], "term string, idf double"))
    vectors = F.broadcast(spark.createDataFrame(rows, "term string, template int, licence string, weight double, idf double").drop("idf"))
    held = found.select("key", F.explode(F.split("passage", " ")).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    norms = held.join(weights, "term", "left").groupBy("key").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(other)), 2))).alias("norm"))
    dots = held.join(vectors, "term").groupBy("key", "template", "licence").agg(F.sum(F.col("tf") * F.col("weight")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    best = dots.join(norms, "key").groupBy("key").agg(F.max(F.struct(cosine.alias("similarity"))).alias("top"), F.collect_list(F.struct("licence", cosine.alias("similarity"))).alias("all"))
    top = best.select("key", F.col("top.similarity").alias("similarity"), F.array_min(F.transform(F.filter("all", lambda x: x.similarity == F.col("top.similarity")), lambda x: x.licence)).alias("licence"))
    return top.filter(F.col("similarity") >= least)


def scan_licences(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """files without their text, with licence, similarity, origin (header, file, inherited, none) and licence_path.

    licence_path is the file's own path or the directory inherited from.
    """
    new = {"licence", "similarity", "origin", "licence_path", text_col.lower()}
    keep = [c for c in files.columns if c.lower() not in new]
    names = [f"c{i}" for i in range(len(keep))]
    path, text = F.col(quoted(path_col)).cast("string"), F.col(quoted(text_col))
    rows = files.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keep, names, strict=True)], path.alias("path"), passages(text, F.coalesce(path, F.lit(""))).alias("passages"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "passages")
    found = rows.select(F.explode("passages").alias("passage")).groupBy("passage").agg(F.count("*").alias("n"))
    found = stored(found.select(digest(F.col("passage")).alias("key"), "passage", "n"), "distinct")
    told = stored(similar(found, least).join(found.select("key", "n"), "key"), "similar")
    said = rows.select("row", F.explode(F.transform("passages", digest)).alias("key"))
    total = rows.count()
    hot = F.broadcast(told.filter(F.col("n") * HOT > total))
    cold = told.filter(F.col("n") * HOT <= total)
    own = said.join(hot, "key").unionByName(said.join(cold, "key"))
    rank = F.struct((F.col("licence") == CLAIM).alias("claim"), (-F.col("similarity")).alias("far"), "licence")
    own = own.groupBy("row").agg(F.min(rank).alias("best"))
    rows = rows.drop("passages").join(own, "row", "left").withColumn("folder", F.regexp_replace("path", r"(^|/)[^/]*\z", ""))
    rows = stored(rows, "licences")
    held = rows.filter(F.col("path").rlike(FILE) & F.col("best").isNotNull()).groupBy("folder").agg(F.min("best").alias("given"))
    # Each folder asks all above it; folders are far fewer than files, so the files only join their own one.
    folders = rows.filter("path is not null").select("folder").distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("above")))).alias("x")).select("folder", "x.depth", "x.above").distinct()
    given = above.join(held.withColumnRenamed("folder", "above"), "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    given = stored(given.withColumnRenamed("folder", "for_folder"), "given")
    rows = rows.join(given, (F.col("folder") == F.col("for_folder")) & F.col("best").isNull() & F.col("path").isNotNull(), "left")
    best = F.coalesce("best", "near.given")
    origin = F.when(F.col("best").isNull(), F.when(F.col("near").isNull(), "none").otherwise("inherited")).when(F.col("path").rlike(FILE), "file").otherwise("header")
    return rows.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], best["licence"].alias("licence"), (-best["far"]).alias("similarity"), origin.alias("origin"), F.when(F.col("best").isNotNull(), F.col("path")).otherwise(F.col("near.above")).alias("licence_path"))
