"""License scans with DataFrame functions only.

A file is a path and a text.  Texts with a cue word are read in three kinds of unit:
each line with a cue word, each paragraph with one (lines up to one without letters or
digits, as a wrapped header or the title of a license is written), and the whole text.
Every unit is compared with the templates of known licenses by the cosine of sparse
TF-IDF vectors (inverse document frequencies are those of the templates; a word that no
template has counts as the rarest).  The best unit's template at ``THRESHOLD`` or more
is the license of the file's *header*.

A file is a *license file* if it is named like one and has a license, or if its whole
text reaches ``THRESHOLD``, whatever its length; it gives its license to its directory.
A file without a header inherits from the nearest ancestor directory that has one.

Inheritance is computed for distinct directories: their ancestors are joined by path
with the licensed directories and the deepest wins; files then meet their directory.
Templates are a bounded constant, joined as a broadcast; each has a cue word, so that a
text without any is compared with none.

Edge cases: a null or empty text has no notice and inherits; a null path has no
directory and does not inherit; ties go to the greater cosine, then to the lesser
license name, then to the lesser path; rows with equal paths are judged alike; kept
columns named like a result give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.cluster import Scratch

THRESHOLD = 0.5
CUE = "(?i)licen[cs]e|copyright|public domain|permission (?:is hereby|to use)|redistribution and use"
NAMES = "(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
PARAGRAPH = "\\n[^\\p{L}\\p{N}\\n]*\\n"
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_SOURCE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, {1}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details. You should have received a copy of the GNU {0} Public License along with this program."
#: Public notices, titles and short licenses by SPDX identifier.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _FREE.format("Affero General", "either version 3 of the License, or (at your option) any later version")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-2-Clause", _SOURCE),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause New or Revised License."),
    ("BSD-3-Clause", f"{_SOURCE} {_ENDORSE}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under Creative Commons CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _FREE.format("General", "either version 2 of the License, or (at your option) any later version")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _FREE.format("General", "either version 3 of the License, or (at your option) any later version")),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
TOKEN = "[a-z0-9]+"
LINE, BLOCK, WHOLE = 0, 1, 2


def vectors() -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """Template entries (number, license, term, weight of unit length), the terms' inverse document frequencies, and that of unknown words."""
    counts = [Counter(re.findall(TOKEN, text.lower())) for _, text in TEMPLATES]
    n = len(counts)
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in sorted(df.items())}
    out = []
    for k, ((name, _), c) in enumerate(zip(TEMPLATES, counts, strict=True)):
        norm = math.sqrt(sum((f * idf[t]) ** 2 for t, f in sorted(c.items())))
        out += [(k, name, t, f * idf[t] / norm) for t, f in sorted(c.items())]
    return out, idf, math.log(1 + n) + 1


def directory(path: Column) -> Column:
    """What stands before the last slash; '' at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def _units(files: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, kind, pos, unit) of the texts with a cue word."""
    cued = scratch.cut(files.where(F.col("text").rlike(CUE)).dropDuplicates(["file"]))
    of = lambda kind, between, several: cued.select("file", F.lit(kind).alias("kind"), F.posexplode(F.split("text", between)).alias("pos", "unit")).where(F.col("unit").rlike(CUE) & (F.col("unit").contains("\n") | F.lit(not several)))
    whole = cued.select("file", F.lit(WHOLE).alias("kind"), F.lit(0).alias("pos"), F.col("text").alias("unit"))
    return of(LINE, "\n", False).unionByName(of(BLOCK, PARAGRAPH, True)).unionByName(whole)


def _notices(files: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, license, cosine, is_whole) of each file that has a notice: its best license, and whether its whole text is one."""
    spark = files.sparkSession
    entries, idf, rarest = vectors()
    terms = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    templates = F.broadcast(spark.createDataFrame(entries, "template int, license string, term string, weight double"))
    unit = ["file", "kind", "pos"]
    tf = _units(files, scratch).select(*unit, F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(f"({TOKEN})"))).alias("term")).groupBy(*unit, "term").agg(F.count("*").alias("tf"))
    weighed = scratch.cut(tf.join(terms, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rarest))))
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.where("idf is not null").join(templates, "term").groupBy(*unit, "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, unit).select("file", "kind", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= THRESHOLD)
    best = scored.groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license"))).alias("best"), F.bool_or(F.col("kind") == WHOLE).alias("is_whole"))
    return best.select("file", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"), "is_whole")


def scan(files: DataFrame, *, path: str = "path", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For each row the ``keep`` columns, ``license``, ``cosine`` and ``origin`` (header, directory or none)."""
    scratch = Scratch(files.sparkSession)
    names = [c for c in ([path] if keep is None else keep) if c.lower() not in ("license", "cosine", "origin")]
    p, t = F.col(f"`{path}`"), F.col(f"`{text}`")
    read = files.select(F.struct(F.lit(True).alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("kept"), p.alias("path"), t.alias("text"), F.xxhash64(p, F.lit(0), t).alias("file"))
    notices = scratch.cut(_notices(read.select("file", "text"), scratch))
    named = F.coalesce(F.col("path").rlike(NAMES), F.lit(False))
    own = scratch.cut(read.select("kept", "path", "file", directory(F.col("path")).alias("dir")).join(notices, "file", "left"))
    licensed = own.where((named | F.col("is_whole")) & F.col("license").isNotNull() & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license", "path")).alias("best")).select("dir", F.col("best.license").alias("dir_license"), (-F.col("best.c")).alias("dir_cosine"))
    dirs = own.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "ancestor"))
    deepest = up.join(licensed.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "dir_license", "dir_cosine")).alias("near"))
    nearest = scratch.cut(deepest.select("dir", "near.dir_license", "near.dir_cosine"))  # a table of its own, so that a directory with many files can be split
    found = own.join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    kept = [F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names)]
    return found.select(*kept, F.coalesce("license", "dir_license").alias("license"), F.when(has, F.col("cosine")).otherwise(F.col("dir_cosine")).alias("cosine"), F.when(has, "header").when(F.col("dir_license").isNotNull(), "directory").otherwise("none").alias("origin"))
